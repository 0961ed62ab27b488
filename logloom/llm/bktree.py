"""Burkhard-Keller trees over 64-bit fingerprints, built and searched for many fingerprints at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LEAF, STEP = 16, 256


class BKTree:
    """A node holds a fingerprint; its children are keyed by their members' Hamming distance to it. Up to LEAF
    members that share all distances so far stay together as a leaf, which is compared member by member."""

    def __init__(self, prints: np.ndarray, members: np.ndarray | None = None):
        self.prints = prints
        members = np.arange(len(prints)) if members is None else members
        self.children: dict[int, BKTree] = {}
        self.pivot = None
        self.bucket = members
        if len(members) > LEAF:
            self.pivot, rest = members[0], members[1:]
            far = np.bitwise_count(prints[rest] ^ prints[self.pivot])
            if not far.any():
                return  # equal fingerprints: one leaf
            self.bucket = None
            for edge in np.unique(far):
                self.children[int(edge)] = BKTree(prints, rest[far == edge])

    def search(self, queries: np.ndarray, which: np.ndarray, radius: int, found: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Calls found(query numbers, member numbers) with pairs at most `radius` apart; only edges within the
        radius of a query's distance to the node are followed."""
        if self.bucket is not None:
            step = max(1, (1 << 20) // max(1, len(self.bucket)))
            for at in range(0, len(which), step):
                part = which[at : at + step]
                near = np.bitwise_count(queries[part][:, None] ^ self.prints[self.bucket][None, :]) <= radius
                q, m = np.nonzero(near)
                if len(q):
                    found(part[q], self.bucket[m])
            return
        far = np.bitwise_count(queries[which] ^ self.prints[self.pivot]).astype(np.int16)
        if len(here := which[far <= radius]):
            found(here, np.full(len(here), self.pivot))
        for edge, child in self.children.items():
            if len(on := which[np.abs(far - edge) <= radius]):
                child.search(queries, on, radius, found)


class Labels:
    """Components of numbered items; the smaller one takes the larger one's label."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.members: dict[int, list[int]] = {}

    def spanning(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, the smallest node of their component) of all others in components of several."""
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for members in self.members.values():
            own = nodes[members]
            least = own.min()
            us.append(own[own != least])
            vs.append(np.full(len(us[-1]), least))
        return np.concatenate(us), np.concatenate(vs)

    def join(self, a: int, b: int) -> None:
        x, y = int(self.of[a]), int(self.of[b])
        if x == y:
            return
        one, two = self.members.pop(x, [x]), self.members.pop(y, [y])
        if len(one) < len(two):
            one, two, x = two, one, y
        self.of[two] = x
        one.extend(two)
        self.members[x] = one


def link(prints: np.ndarray, radius: int, own: np.ndarray | None = None, accept: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, groups: np.ndarray | None = None) -> Labels:
    """Components of the fingerprints that a chain of pairs within the radius ties. own: which of them the tree
    holds, the others search in it (None: it holds all, and all search). accept: a further test of pairs. groups:
    items of one are tied from the start. A pair that is tied already is not looked at."""
    labels = Labels(len(prints))
    if groups is not None:
        order = np.argsort(groups, kind="stable")
        for i, j in zip(order.tolist(), order[1:].tolist()):
            if groups[i] == groups[j]:
                labels.join(i, j)

    def found(q: np.ndarray, m: np.ndarray) -> None:
        while True:
            new = labels.of[q] != labels.of[m]
            q, m = q[new], m[new]
            if not len(q):
                return
            a, b = q[:STEP], m[:STEP]
            if accept is not None:
                yes = accept(a, b)
                a, b = a[yes], b[yes]
            for i, j in zip(a.tolist(), b.tolist()):
                labels.join(i, j)
            q, m = q[STEP:], m[STEP:]

    if len(prints) > 1:
        everything = np.arange(len(prints))
        whole = own is None or own.all()
        BKTree(prints, everything if whole else everything[own]).search(prints, everything if whole else everything[~own], radius, found)
    return labels
