from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import simhash as S
from logloom.llm.bktree import link
from logloom.llm.graph import components
from logloom.llm.queries import op7

SF = "/root/testdata/sf0.001"


def fp_of(text: str) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def brute_components(ids, prints, radius=3):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least: dict = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_query_is_exact(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    prints = [fp_of(t) for _, t in docs]
    want = dict(zip((d for d, _ in docs), zip((f"{p:016x}" for p in prints), brute_components([d for d, _ in docs], prints))))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op7(spark, SF).collect()} == want


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 120), st.integers(0, 10))
def test_trees_link_as_all_pairs_do(seed, n, radius):
    rng = random.Random(seed)
    centers = [rng.getrandbits(64) for _ in range(3)]
    prints = [rng.choice(centers) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for _ in range(n)]
    prints = [p & (2**64 - 1) for p in prints]
    labels = link(np.array(prints, np.uint64), radius)
    want = brute_components(list(range(n)), prints, radius)
    groups = lambda x: {frozenset(np.flatnonzero(np.array(x) == v).tolist()) for v in set(x)}
    assert groups(labels.of.tolist()) == groups(want)
    own = np.array([rng.random() < 0.5 for _ in range(n)])
    cross = link(np.array(prints, np.uint64), radius, own)
    for i in range(n):
        for j in range(n):
            if own[i] and not own[j] and (prints[i] ^ prints[j]).bit_count() <= radius:
                assert cross.of[i] == cross.of[j]


def test_large_shards_are_cut_and_wide_groupings_exact(spark, monkeypatch):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 9))) for _ in range(120)}
    rows = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(sorted(prints))]
    frame = spark.createDataFrame(rows, "node long, fp long")
    from pyspark.sql import functions as F

    for count, part in ((100, 7), (100, 512), (10**9, 16), (10**12, 16)):
        shards = frame.select(F.explode(S.shard_keys(F.col("fp"), count, 3)).alias("key"), "fp", "node")
        tied = {r.node: r.component for r in components(S.cell_links(S.cells(shards, part), 3)).collect()}
        got = [tied.get(i, i) for i, _ in rows]
        assert got == brute_components([i for i, _ in rows], sorted(prints))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark, docs_frame):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [[word() for _ in range(200)] for _ in range(12)]
    rows = []
    for g, words in enumerate(texts):
        for c in range(4):
            w = list(words)
            for _ in range(c):
                w[rng.randrange(200)] = word()
            rows.append((g * 10 + c, " ".join(w)))
    docs = docs_frame([*rows, (900, None), (901, ""), (902, " \n"), (None, rows[0][1])], "gone", "_gone", "component")
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs).collect()}
    for g in range(12):
        assert all(got[g * 10 + c] == g * 10 for c in range(4)), g
    assert got[900] == got[901] == got[902] == 900 and got[None] == 0
    left = S.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r.doc_id if r.doc_id is not None else -1 for r in left.collect()) == [-1, *(g * 10 for g in range(12)), 900]


def test_near_duplicates_are_of_sets(spark, docs_frame):
    """Against all pairs' set similarity: copies that repeat a line more or less often, and short texts at 0.8."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(40):
        words, line = [word() for _ in range(150)], [word() for _ in range(8)]
        for c, times in enumerate((1, 10, 30)):
            rows.append((g * 10 + c, " ".join([*words, *line * times])))
    for g in range(40, 200):
        words = [word() for _ in range(9)]
        rows += [(g * 10, " ".join(words[:8])), (g * 10 + 1, " ".join(words))]
    shingles = lambda t: frozenset(zip(*(t.split()[i:] for i in range(5))))
    sets = {d: shingles(t) for d, t in rows}
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {d: min(o for o in sets if o // 10 == d // 10 and similar(d, o) >= 0.8) for d in sets}
    assert all(w == d // 10 * 10 for d, w in want.items())
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs_frame(rows)).collect()}
    assert got == want
    prints = {d: S.fingerprint(np.unique(S.shingle_hashes(t, 5))) for d, t in rows}
    assert all((prints[d] ^ prints[w]).bit_count() <= 26 for d, w in want.items())


def test_pairs_about_the_bound_are_told_by_their_sets(spark, docs_frame, monkeypatch):
    """Substitutions give similarities from 0.7 to 0.9; cells are cut small."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(25):
        words = [word() for _ in range(230)]
        for c in range(8):
            w = list(words)
            for _ in range(rng.randrange(9)):
                w[rng.randrange(230)] = word()
            rows.append((g * 10 + c, " ".join(w)))
    sets = {d: frozenset(zip(*(t.split()[i:] for i in range(5)))) for d, t in rows}
    root = {d: d for d in sets}
    for d in sets:
        for o in [o for o in sets if o < d and o // 10 == d // 10]:
            if root[o] != root[d] and len(sets[o] & sets[d]) >= 0.8 * len(sets[o] | sets[d]):
                least, other = sorted((root[o], root[d]))
                root = {k: least if v == other else v for k, v in root.items()}
    assert 25 < len(set(root.values())) < 150
    assert {r.doc_id: r.component_id for r in S.near_duplicates(docs_frame(rows)).collect()} == root
    monkeypatch.setattr(S, "FEW", 0)
    for cut in ((3, 1 << 20), (512, 6000)):
        monkeypatch.setattr(S.cells, "__defaults__", cut)
        assert {r.doc_id: r.component_id for r in S.near_duplicates(docs_frame(rows)).collect()} == root


def test_odd_rows(spark, docs_frame):
    docs = docs_frame([(5, "a b c d"), (3, "A B C D"), (3, "a b c d"), (9, "other words are here"), (7, None), (8, ""), (None, "a b c d"), (None, "unlike all else here"), (11, "one"), (12, "x " * 300_000)], "fp", "node", "component_id")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in S.simhash_components(docs).collect())
    assert got == sorted([("5", "3"), ("3", "3"), ("3", "3"), ("9", "9"), ("7", "7"), ("8", "7"), ("None", "3"), ("None", "None"), ("11", "11"), ("12", "12")])
    assert S.simhash_components(docs.limit(0)).count() == 0 and S.near_duplicates(docs.limit(0)).count() == 0
