from __future__ import annotations

import math

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import topk
from logloom.llm.queries import TOP_K_SQL, op10

SF = "/root/testdata/sf0.001"


def brute(x, ids, q, q_id, k):
    rows = [(-sum(int(a) * int(b) for a, b in zip(v, q)), int(i)) for v, i in zip(x, ids) if i != q_id]
    return [(i, -s) for s, i in sorted(rows)[:k]]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 300), st.integers(1, 12), st.integers(1, 12), st.integers(0, 3))
def test_bounds_lose_nothing(seed, n, d, k, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(-(10**spread), 10**spread + 1, (n, d)).astype(float) * (10.0**9 if seed % 5 == 0 else 1)
    ids = rng.permutation(n)
    q, q_ids = rng.integers(-5, 6, (4, d)).astype(float), np.array([0, 1, 5, -1])
    whole, half = topk.Best(k), topk.Best(k)
    topk.search(x, ids, q, q_ids, np.arange(4), whole, {})
    for part in (slice(0, n // 2), slice(n // 2, n)):  # the second part starts with the first one's bar
        if len(ids[part]):
            topk.search(x[part], ids[part], q, q_ids, np.arange(4), half, {})
    for i in range(4):
        want = brute(x, ids, q[i], q_ids[i], k)
        assert [(v, -s) for s, v in whole.held.get(i, [])] == [(v, -s) for s, v in half.held.get(i, [])] == want


def test_reading_stops_early():
    """Lists are read to the end only where nothing tells candidates apart."""
    rng = np.random.default_rng(5)
    n, ids = 4096, np.arange(4096)
    plain = np.round(rng.normal(size=(n, 64)) * 128)
    steep = np.round(np.exp(rng.normal(size=(n, 3)) * 3))
    exact = lambda x, q: np.sort(x @ q)[-10:][::-1].tolist()
    read = lambda x, ids, q, bar: topk.Lists(x, ids).read(q[None], np.array([-1]), 10, [bar])[0]
    few = read(steep, ids, np.array([2.0, 1.0, 3.0]), None)
    assert few.depth <= n / 4 and few.scores.tolist() == exact(steep, np.array([2.0, 1.0, 3.0]))
    # With a bar from elsewhere even a block without near ones is left half-read, and one far below it at once.
    bar = int(exact(plain[1:], plain[0])[-1])
    some = read(plain[1:], ids[1:], plain[0], bar)
    assert some.depth < 0.7 * n and some.scores.tolist() == exact(plain[1:], plain[0])
    assert read(plain[1:], ids[1:], plain[0], 10**9).depth <= n / 8


def test_query_is_its_sql(spark, monkeypatch):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(TOP_K_SQL).fetchall())
    assert sorted(tuple(r) for r in op10(spark, SF).collect()) == want
    for name, few in (("CANDIDATES", 37), ("SAMPLE", 50), ("QUERY_CELLS", 128)):
        monkeypatch.setattr(topk, name, few)
    assert sorted(tuple(r) for r in op10(spark, SF).collect()) == want


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [-0.0001, 0.0]), (100, [9.0]), (200, []), (9, [])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r)[:4] for r in topk.top_k(frame).collect())
    one = 1024 * 1024 + 512 * 512
    assert got == [(0, 1, 1, one), (0, 2, 2, one), (0, 3, 8, -1024), (100, 1, 7, 9 * 1024 * 1024), (200, 1, 9, 0)]
    assert topk.top_k(frame.limit(0)).count() == 0


def test_components_of_any_size(spark):
    values = [1e17, -1e17, 0.5, -3e15, 1.7e308, -1.7e308, 5e-324, -5e-324, 123456789.123, 9e15, 1e17]
    frame = spark.createDataFrame([(i * 50, [v, 1.0]) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    whole = lambda v: math.floor(v * 1024) if abs(v) < 2**60 else int(v) * 1024
    got = sorted(tuple(r) for r in topk.top_k(frame).collect())
    want = []
    for q in range(0, 11, 2):
        scores = sorted((-(whole(values[q]) * whole(v) + 1024 * 1024), i * 50) for i, v in enumerate(values) if i != q)
        want += [(q * 50, r, i, max(-(2**63), min(2**63 - 1, -s)), str(-s)) for r, (s, i) in enumerate(scores, 1)]
    assert got == want
