"""Exact top-k inner products by aggregation without random access.

For each query every component is a list of the candidates in the order of that component's share of the score. Lists
are read from their best ends, STEP entries at a time and to the same depth; what was read of a candidate is its known
share, and a component not yet read lies between the list's far end and the last value read, which gives a lower and
an upper bound of its score. A candidate is open while its upper bound reaches the bar; one of which nothing was read
is bounded by the sum of the last values read, so reading stops when outsiders cannot qualify and few candidates are
open (or the lists end). The open ones' scores are then resolved. The bar is the k-th best lower bound, or the k-th
best score of the blocks that the task has resolved before or of a first pass over a bounded sample of the candidates,
so that blocks without good candidates are left early. Bounds are worked out for some queries at once, as products
with what was read of the lists.

Queries are sent to all tasks in blocks of QUERY_CELLS components at most, so what is broadcast has a fixed bound, and
the candidates are read where they lie: no vector is shuffled, only k rows for each query and task. With more queries
than a block holds there is a scan of the candidates for each block.

A query is a row whose id is divisible by `every`; a query's own rows are those with its id. Vectors that are null,
or hold a null or a value that is not finite, and rows without id take no part; only vectors of a query's length are
its candidates, and vectors of no components score 0. Equal rows of a query are one query; other repeated rows are
candidates each. Ties go to the smaller id. Components and scores are exact integers of any size: where 64 bits are
too few, Python's are used. A score beyond a long is returned as the nearest long; `exact_score` has its digits, and
ranks go by it. An empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tasks_for

QUERY_CELLS, CANDIDATES, SAMPLE, TOGETHER, STEP = 1 << 21, 4096, 4096, 128, 1 / 8
LONG = 2**63 - 1


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value), exactly: as doubles if these are below 2 ** 53, else as Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)  # scale is a power of two, so this is exact up to overflow
    if not scaled.size or float(np.abs(scaled).max()) < 2**53:
        return scaled
    exact = [math.floor(v * scale) if abs(v) < 2**60 else int(v) * scale for v in values.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(values.shape)


def together(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and q in a type in which sums of their products are exact."""
    if x.dtype != object and q.dtype != object and x.size and q.size and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < 2**53:
        return x, q
    whole = lambda a: a if a.dtype == object else np.array([int(v) for v in a.ravel().tolist()], object).reshape(a.shape)
    return (x, q) if not (x.size and q.size) else (whole(x), whole(q))


@dataclass
class Reading:
    """What came of one query's lists: rows that may be among its best, their scores, and the entries read."""

    rows: np.ndarray
    scores: np.ndarray
    depth: int


class Lists:
    """The sorted lists of a block of candidates."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, axis=0)
        self.place = np.empty(x.shape, np.int32)  # of each value in its list, from the low end
        np.put_along_axis(self.place, order, np.arange(len(x), dtype=np.int32)[:, None], axis=0)

    def read(self, q: np.ndarray, own: np.ndarray, k: int, bars: list[int | None]) -> list[Reading]:
        """For each query the rows whose scores may be among its k best and are not under its bar."""
        n, kind = len(self.x), self.x.dtype
        out = [Reading(np.zeros(0, int), np.zeros(0), 0)] * len(q)
        bars = list(bars)
        if kind != object:  # what is beyond all scores of this type
            on = np.array([i for i, b in enumerate(bars) if b is None or b < 2**60], int)
            bars = [None if b is None or b <= -(2**60) else b for b in bars]
        else:
            on = np.arange(len(q))
        rising, falling = np.where(q > 0, q, 0), np.where(q < 0, q, 0)  # by the end that is best for the query
        open_ = own[:, None] != self.ids[None, :]
        depth, step = 0, max(1, math.ceil(n * STEP))
        while len(on):
            depth = min(n, depth + step)
            high, low = self.place >= n - depth, self.place < depth  # what was read from either end
            a, b = rising[on], falling[on]
            unsure = np.array([i for i, j in enumerate(on.tolist()) if bars[j] is None or depth == step], int)
            if len(unsure):
                lower = a[unsure] @ np.where(high, self.x, self.sorted[0]).T + b[unsure] @ np.where(low, self.x, self.sorted[-1]).T
                for i, known in zip(on[unsure].tolist(), lower):
                    known = np.sort(known[open_[i]])
                    if len(known) >= k and (bars[i] is None or known[-k] > bars[i]):
                        bars[i] = known[-k]
            upper = a @ np.where(high, self.x, self.sorted[n - depth]).T + b @ np.where(low, self.x, self.sorted[depth - 1]).T
            done = np.zeros(len(on), bool)
            for at, i in enumerate(on.tolist()):
                if bars[i] is not None:
                    open_[i] &= upper[at] >= bars[i]
                if depth == n or open_[i].sum() <= max(2 * k, n // 16):
                    done[at] = True
                    out[i] = self.resolve(q[i], np.flatnonzero(open_[i]), k, bars[i], depth)
            on = on[~done]
        return out

    def resolve(self, q: np.ndarray, rows: np.ndarray, k: int, bar: int | None, depth: int) -> Reading:
        scores = self.x[rows] @ q
        if bar is not None:
            rows, scores = rows[scores >= bar], scores[scores >= bar]
        best = sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k]
        return Reading(rows[best], scores[best], depth)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, k: int):
        self.k = k
        self.held: dict[int, list[tuple]] = {}

    def bar(self, i: int, first: int | None = None) -> int | None:
        held = self.held.get(i, ())
        own = -held[-1][0] if len(held) == self.k else None
        return own if first is None or own is not None and own > first else first

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        new = [(-int(s), int(v)) for s, v in zip(scores, ids)]
        if new:
            self.held[i] = sorted(self.held.get(i, []) + new)[: self.k]


def search(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, which: np.ndarray, best: Best, bars: dict[int, int]) -> None:
    """Adds a block of candidates to the best of the queries; which: the queries' numbers in `best`."""
    x, queries = together(x, queries)
    lists = Lists(x, ids)
    for at in range(0, len(queries), TOGETHER):
        part = slice(at, at + TOGETHER)
        numbers = which[part].tolist()
        for i, got in zip(numbers, lists.read(queries[part], query_ids[part], best.k, [best.bar(i, bars.get(i)) for i in numbers])):
            best.add(i, got.scores, ids[got.rows])


def _by_length(ids: pa.Array, vectors: pa.Array, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, places, ids, components) of the vectors of each length."""
    lens = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lens).tolist():
        at = np.flatnonzero(lens == d)
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield d, at, ids.to_numpy(zero_copy_only=False)[at], integers(flat.reshape(len(at), d), scale)


def _scan(rows: DataFrame, queries: pa.Table, bars: dict[int, int], k: int, scale: int) -> DataFrame:
    """(q, query_id, vec_id, exact): k rows at most for each query and task; q is the query's place."""
    sent = rows.sparkSession.sparkContext.broadcast((queries, bars))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first = sent.value
        by_length = {d: (at, ids, v) for d, at, ids, v in _by_length(table.column("id").combine_chunks(), table.column("v").combine_chunks(), scale)}
        best = Best(k)
        for b in batches:
            for start in range(0, b.num_rows, CANDIDATES):
                part = b.slice(start, CANDIDATES)
                for d, _, ids, x in _by_length(part.column("id"), part.column("v"), scale):
                    if d in by_length:
                        at, q_ids, q = by_length[d]
                        search(x, ids, q, q_ids, at, best, first)
        found = [(i, v, str(-s)) for i, held in best.held.items() for s, v in held]
        q = pa.array([f[0] for f in found], pa.int64())
        yield pa.RecordBatch.from_arrays([q, table.column("id").combine_chunks().take(q), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string())], ["q", "query_id", "vec_id", "exact"])

    return rows.mapInArrow(work, "q long, query_id long, vec_id long, exact string")


def _bars(found: DataFrame, k: int) -> dict[int, int]:
    """The k-th best score of each query that has as many; k rows a query of one block at most."""
    held: dict[int, list[int]] = {}
    for r in found.toLocalIterator():
        held.setdefault(r.q, []).append(int(r.exact))
    return {q: sorted(s)[-k] for q, s in held.items() if len(s) >= k}


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score, exact_score); the score is the inner product of floor(scale * component), and
    scale a power of two."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda c: c.cast("double")).alias("v"))
    asked = materialize(rows.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id", "v"]).withColumn("cells", F.greatest(F.size("v"), F.lit(1))), "queries")
    (cells,) = asked.agg(F.coalesce(F.sum("cells"), F.lit(0))).first()
    blocks = max(1, -(-cells // QUERY_CELLS))
    n, tasks = rows.count(), tasks_for(vectors.sparkSession)
    sample = rows.where(F.pmod(F.xxhash64("id", "v", F.lit(11)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30)))
    if n <= 8 * tasks * CANDIDATES:  # few rows lie in few files: all tasks get some
        rows = rows.repartition(max(1, min(tasks, -(-n // CANDIDATES))))
    out = None
    for block in range(blocks):
        queries = asked.where(F.pmod(F.xxhash64("id", "v", F.lit(7)), F.lit(blocks)) == block).select("id", "v").toArrow()  # about QUERY_CELLS components
        first = _bars(_scan(sample, queries, {}, k, scale), k) if n > 2 * SAMPLE else {}
        found = materialize(_scan(rows, queries, first, k, scale).withColumn("block", F.lit(block)), "best")
        out = found if out is None else out.union(found)

    # Digits compare as numbers by sign, length and text; `nines` turns a negative number's around.
    exact = F.col("exact")
    digits = F.ltrim(exact, F.lit("-"))
    minus = F.startswith(exact, F.lit("-"))
    size = F.when(minus, -F.length(digits)).otherwise(F.length(digits))
    nines = F.when(minus, F.translate(digits, "0123456789", "9876543210")).otherwise(digits)
    order = Window.partitionBy("block", "q").orderBy(F.desc("size"), F.desc("nines"), "vec_id")
    ranked = out.withColumns({"size": size, "nines": nines}).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.coalesce(exact.try_cast("bigint"), F.when(minus, F.lit(-LONG - 1)).otherwise(F.lit(LONG)))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"), exact.alias("exact_score"))
