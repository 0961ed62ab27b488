"""Benchmark decontamination by the q-gram lemma.

A benchmark item of m characters that lies in a text with at most k = EDITS * m edits shares at least
m - q + 1 - k * q of its character q-grams with it, and their diagonals (text position less item position) differ by
k at most. Shared q-grams are counted per item in bands of 2 (k + 1) diagonals that overlap by half, so one band
holds all of them; only bands that reach the bound are kept, and each is verified by an alignment within the band.
The filter loses nothing: what it drops has more edits. q is the largest up to Q for which the bound is positive.

Texts are compared with letters in lower case and runs of white space as one space. The items' q-gram index is built
on the driver and sent to all tasks, in parts of PART_CHARS characters at most, each with a scan of its own; the size
is measured first. Nothing is shuffled, so copies and frequent passages make no hot task. A q-gram that many items
share meets each of them wherever a text has it, which the lemma needs; such hits are counted HITS at a time, for
stretches of text and halves of the items, so they take time but no memory. Alignments end once no diagonal can keep
the budget, so an item that has only its beginning in common with a text costs about that beginning.

Null texts and items are empty; an empty item matches nothing. An item of fewer than LEAST characters is no evidence
inside a longer text: it is found only where it is the whole text. Items whose id is null or repeated are looked for
each. Texts of any length are read whole, in overlapping parts. Rows that repeat a doc_id are each searched, and
equal findings are reported once per row. An empty benchmark finds nothing, and an
empty table gives an empty result. Other columns are not read; without_leaks() passes them, whatever their names."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, with_text

EDITS, Q, LEAST = 0.08, 11, 16
PART_CHARS = 8 << 20
CHUNK, HITS = 2 << 20, 4 << 20
_B = np.uint32(0x9E3779B1)

#: Lower-case letters of the first code points; others stay.
_LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in ((i, chr(i)) for i in range(0x530))], np.uint32)


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points, lower-cased, runs of white space as one space; and the place of each in the text."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.where(a < len(_LOWER), _LOWER[np.minimum(a, len(_LOWER) - 1)], a)
    space = (low == 32) | ((low >= 9) & (low <= 13)) | (low == 0xA0) | (low == 0)
    keep = np.ones(len(a), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    low = np.where(space, np.uint32(32), low)
    return low[keep], np.flatnonzero(keep)


def gram_hashes(a: np.ndarray, q: int) -> np.ndarray:
    """A 32-bit hash of each q-gram, by doubling. Two q-grams with one hash only cost an alignment more."""
    with np.errstate(over="ignore"):
        power, width, have, out, done = _B, 1, a.astype(np.uint32) + np.uint32(1), None, 0
        while True:
            if q & width:
                if out is None:
                    out, done = have, width
                else:
                    n = len(a) - done - width + 1
                    if n <= 0:
                        return np.zeros(0, np.uint32)
                    out = out[:n] * power + have[done : done + n]
                    done += width
            if width * 2 > q:
                break
            n = len(have) - width
            if n <= 0:
                return np.zeros(0, np.uint32)
            have = have[:n] * power + have[width : width + n]
            power, width = power * power, width * 2
        n = len(a) - q + 1
        out = out[: max(0, n)]
        return (out ^ (out >> np.uint32(15))) * _B


@dataclass
class Index:
    """The q-grams of some items of one q, in the order of their hashes."""

    q: int
    items: list[np.ndarray]
    ids: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    seen: np.ndarray
    least: int = 0  # shorter items must be the whole text

    def half(self, number: int) -> Index:
        """The first or the second half of the items."""
        middle = len(self.items) // 2
        part = slice(0, middle) if number == 0 else slice(middle, None)
        mine = self.item < middle if number == 0 else self.item >= middle
        return Index(self.q, self.items[part], self.ids[part], self.hashes[mine], self.item[mine] - (part.start or 0), self.at[mine], self.seen, self.least)


def plan_of(m: int, edits: float, q: int) -> tuple[int, int]:
    """k and q for an item of m characters."""
    k = int(edits * m)
    q = min(q, m)
    while q > 1 and m - q + 1 - k * q < 1:
        q -= 1
    return k, q


def build(items: list[tuple[int | None, str]], edits: float = EDITS, q: int = Q, least: int = 0) -> list[Index]:
    by_q: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item_id, text in items:
        a = normalized(text.strip())[0]
        if len(a):
            by_q.setdefault(plan_of(len(a), edits, q)[1], []).append((item_id, a))
    out = []
    for size, group in sorted(by_q.items()):
        hashes = [gram_hashes(a, size) for _, a in group]
        item = np.repeat(np.arange(len(group)), [len(h) for h in hashes])
        at = np.concatenate([np.arange(len(h)) for h in hashes])
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        seen = np.zeros(1 << 20, bool)
        seen[h >> np.uint32(12)] = True
        out.append(Index(size, [a for _, a in group], np.array([i for i, _ in group], object), h[order], item[order], at[order], seen, least))
    return out


def banded(items: list[np.ndarray], texts: list[np.ndarray], starts: np.ndarray, slack: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least edits of each item against any part of its text that keeps within the diagonals starts ..
    starts + slack, and the end of such a part; both ends of the text are free. Those of more than `most` edits are
    not told apart: their alignments end as soon as all diagonals have more."""
    c, rows = len(items), max(map(len, items))
    width = slack + 1
    a = np.zeros((c, rows), np.int32)
    t = np.full((c, rows + width), -1, np.int32)
    for i, (x, y) in enumerate(zip(items, texts)):
        a[i, : len(x)] = x
        lo = int(starts[i])
        part = y[max(0, lo) : lo + rows + width]
        off = max(0, -lo)
        t[i, off : off + len(part)] = part
    big = np.int32(1 << 28)
    lens, sizes = np.array([len(x) for x in items]), np.array([len(y) for y in texts])
    steps = np.arange(width, dtype=np.int32)
    best, end = np.full(c, big, np.int64), np.zeros(c, np.int64)
    on = np.arange(c)
    place = starts[:, None] + steps
    cost = np.where((place >= 0) & (place <= sizes[:, None]), np.int32(0), big)
    for i in range(rows + 1):
        done = lens[on] == i
        if done.any():
            at = cost[done].argmin(axis=1)
            best[on[done]], end[on[done]] = cost[done][np.arange(done.sum()), at], starts[on[done]] + i + at
        if i % 8 == 0 or done.any():
            stay = ~done & (cost.min(axis=1) <= most[on])
            if not stay.all():
                on, a, t, cost = on[stay], a[stay], t[stay], cost[stay]
                if not len(on):
                    break
        if i == rows:
            break
        window = t[:, i : i + width]
        step = cost + np.where(window < 0, big, (window != a[:, i : i + 1]).astype(np.int32))
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        step = np.minimum(np.minimum.accumulate(step - steps, axis=1) + steps, big)
        # an insertion needs a character of the text
        nxt = starts[on, None] + i + 1 + steps
        cost = np.where((nxt >= 0) & (nxt <= sizes[on, None]), step, big)
    return best, end


def search(indexes: list[Index], texts: list[np.ndarray], edits: float = EDITS) -> Iterator[tuple[int, object, int, int, int, int]]:
    """(text number, item id, start, end, edits, shared q-grams) of items in normalised texts, places in these."""
    for index in indexes:
        joined = np.concatenate([x for t in texts for x in (t, np.zeros(1, np.uint32))]) if texts else np.zeros(0, np.uint32)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        h = gram_hashes(joined, index.q)
        maybe = np.flatnonzero(index.seen[h >> np.uint32(12)])
        yield from _meet(index, texts, begins, maybe, h[maybe], edits)


def _meet(index: Index, texts: list[np.ndarray], begins: np.ndarray, place: np.ndarray, h: np.ndarray, edits: float) -> Iterator[tuple[int, object, int, int, int, int]]:
    """search() of the q-grams h at places of the joined texts."""
    lo, hi = np.searchsorted(index.hashes, h, "left"), np.searchsorted(index.hashes, h, "right")
    n = hi - lo
    hit = n > 0
    place, h, lo, n = place[hit], h[hit], lo[hit], n[hit]
    total = int(n.sum())
    if not total:
        return
    lens = np.array([len(a) for a in index.items])
    k = (edits * lens).astype(np.int64)
    if total > HITS:
        # Stretches overlap by the longest part of a text that an item can take, so each band is whole in one of them.
        reach = int((lens + 2 * (k + 1)).max())
        middle = place[len(place) // 2]
        first, second = place <= middle + reach, place >= middle - reach
        if max(first.sum(), second.sum()) <= 0.8 * len(place):
            for part in (first, second):
                yield from _meet(index, texts, begins, place[part], h[part], edits)
            return
        if len(index.items) > 1:
            for number in (0, 1):
                yield from _meet(index.half(number), texts, begins, place, h, edits)
            return
    which = np.repeat(lo, n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(place, n)
    text = np.searchsorted(begins, at, "right") - 1
    item = index.item[which]
    # Bands of half the width: two neighbours are one band of the lemma's, and such bands overlap by half.
    low = int(lens.max()) + 1
    half = (at - begins[text] - index.at[which] + low) // (k[item] + 1)
    span = int((len(texts[int(np.argmax([len(t) for t in texts]))]) + 2 * low)) + 2
    keys, count = np.unique((text * len(index.items) + item) * span + half, return_counts=True)
    after = np.searchsorted(keys, keys + 1)
    both = count + np.where((after < len(keys)) & (keys[np.minimum(after, len(keys) - 1)] == keys + 1), count[np.minimum(after, len(keys) - 1)], 0)
    before = np.searchsorted(keys, keys - 1)
    alone = keys[np.minimum(before, len(keys) - 1)] != keys - 1  # the band that ends with this half has no other
    need = np.maximum(lens - index.q + 1 - k * index.q, 1)
    bands = np.concatenate([keys, keys[alone] - 1])
    shared = np.concatenate([both, count[alone]])
    item = np.concatenate([keys, keys[alone]]) // span % len(index.items)
    text = np.concatenate([keys, keys[alone]]) // span // len(index.items)
    half = bands - (text * len(index.items) + item) * span
    good = np.flatnonzero(shared >= need[item])
    good = good[np.lexsort((lens[item[good]], text[good]))]
    starts = half * (k[item] + 1) - low - k[item]
    for at in range(0, len(good), 256):
        some = good[at : at + 256]
        pats, hay, most = [index.items[i] for i in item[some]], [texts[d] for d in text[some]], k[item[some]]
        cost, end = banded(pats, hay, starts[some], int(4 * most.max() + 2), most)
        yes = np.flatnonzero(cost <= most)
        if not len(yes):
            continue
        # The same backwards from the end found gives the start.
        back_t = [hay[j][: end[j]][::-1] for j in yes]
        _, back = banded([pats[j][::-1] for j in yes], back_t, -most[yes], int(2 * most[yes].max()), most[yes])
        for j, b in zip(yes.tolist(), back.tolist()):
            if len(pats[j]) < index.least and not (b >= end[j] - 1 and end[j] >= len(hay[j]) - 1):
                continue
            yield int(text[some[j]]), index.ids[item[some[j]]], int(end[j]) - b, int(end[j]), int(cost[j]), int(shared[some[j]])


def leaks_in(text: str, indexes: list[Index], longest: int, edits: float = EDITS) -> list[tuple[object, int, int, int, int]]:
    return [f[1:] for f in leaks_of([text], indexes, longest, edits)]


def leaks_of(texts: list[str], indexes: list[Index], longest: int, edits: float = EDITS) -> list[tuple[int, object, int, int, int, int]]:
    """(text number, item id, start, end, edits, shared) with places in the texts as they are; of findings of one
    item that overlap, the one with the fewest edits."""
    parts, owner, offset, places = [], [], [], []
    overlap = 2 * longest + 16
    for number, text in enumerate(texts):
        norm, place = normalized(text)
        places.append(place)
        for at in range(0, max(1, len(norm)), CHUNK):
            parts.append(norm[at : at + CHUNK + overlap])
            owner.append(number)
            offset.append(at)
    found: dict = {}
    for p, item, a, b, e, s in search(indexes, parts, edits):
        key = (owner[p], item, offset[p] + a, offset[p] + b)
        found[key] = (e, max(s, found.get(key, (e, 0))[1]))
    out: list = []
    taken: dict = {}  # spans of an item do not overlap, so those about a place are its neighbours in order
    for (number, item, a, b), (e, s) in sorted(found.items(), key=lambda f: (f[0][0], str(f[0][1]), f[1][0], f[0][2])):
        spans = taken.setdefault((number, item), [])
        i = bisect_left(spans, (a, b))
        if (i == len(spans) or spans[i][0] >= b) and (i == 0 or spans[i - 1][1] <= a):
            spans.insert(i, (a, b))
            place = places[number]
            out.append((number, item, int(place[a]), int(place[b - 1]) + 1, e, s))
    return out


def indexes_of(benchmark: DataFrame, item_id: str, item_text: str, edits: float, q: int) -> Iterator[tuple[list[Index], int]]:
    """The items' indexes, in parts of bounded size, and the longest item's length."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("item"))
    total, longest = items.agg(F.coalesce(F.sum(F.length("item")), F.lit(0)), F.coalesce(F.max(F.length("item")), F.lit(0))).first()
    parts = max(1, -(-total // PART_CHARS))
    for part in range(parts):
        here = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(parts)) == part)
        yield build([(r[0], r[1]) for r in here.toLocalIterator()], edits, q, LEAST), longest


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", edits: float = EDITS, q: int = Q) -> DataFrame:
    """(doc_id, item_id, start, end, edits, shared): code points [start, end) of a document hold the item."""
    rows, out = with_text(docs, id_col, text_col), None
    for built, longest in indexes_of(benchmark, item_id, item_text, edits, q):
        index = docs.sparkSession.sparkContext.broadcast(built)

        def work(batches: Iterator[pa.RecordBatch], index=index, longest=longest) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", 1 << 20):
                found = leaks_of(b.column("text").to_pylist(), index.value, longest, edits)
                ids = b.column("doc_id").to_pylist()
                cols = [[ids[f[0]] for f in found], *([f[i] for f in found] for i in range(1, 6))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start", "end", "edits", "shared"])

        found = rows.mapInArrow(work, "doc_id long, item_id long, start long, end long, edits long, shared long")
        out = found if out is None else out.union(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", edits: float = EDITS, q: int = Q) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    for built, longest in indexes_of(benchmark, item_id, item_text, edits, q):
        index = docs.sparkSession.sparkContext.broadcast(built)

        def work(batches: Iterator[pa.RecordBatch], index=index, longest=longest) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text_col, 1 << 20):
                leaky = {f[0] for f in leaks_of([t or "" for t in b.column(text_col).to_pylist()], index.value, longest, edits)}
                yield b.filter(pa.array([i not in leaky for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
