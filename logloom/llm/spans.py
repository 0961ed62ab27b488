"""Substring dedup by sliding sentence spans.

A text is cut into sentences; one of more than LONG words is cut where its content says so (before words whose hash is
the least among NEAR words on either side), so text without stops has units too, and a passage has the same ones from
whichever word of a sentence it begins or is edited at. A run is RUN consecutive units, and as many more as it takes to have WORDS words. All runs are
hashed; a run that occurs in several documents is first in the one with the smallest id (and at its first place
there). Units that any non-first run covers are removed.

Only (hash, document) pairs are shuffled, once per document and hash; counts combine map-side, and the joins are
plain ones that AQE can split where a passage is in a large share of all documents. A text is parsed once more only if
something is removed from it.

Null texts are empty, and nothing is removed from them. Rows that repeat a doc_id are documents of their own, in the
order in which they are read, and rows without id come after all others; where there are any, the texts are written
once more with their rows' numbers, so that both passes see the same. Texts of less than a run have no run. An empty
table gives an empty result; columns other than the id and the text are not read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices, with_text

RUN, WORDS, LONG, NEAR = 3, 10, 16, 2
STOP = re.compile(r"""[.!?]+["')\]»”]*(?=\s)|\n+""")
TOKEN = re.compile(r"\S+")
_P = np.uint64(0x100000001B3)


def cuts(words: list[str]) -> list[int]:
    """Where the units of a long sentence start. Equal words are equally least, so what repeats is cut alike all along.
    Where no word is least over LONG words, the least within is, and so on in the parts."""
    h = [*map(xxhash.xxh64_intdigest, words)]
    n = len(h)
    out = [0]
    for i in [*(i for i in range(1, n) if h[i] == min(h[max(0, i - NEAR) : i + NEAR + 1])), n]:
        todo = [(out[-1], i)]
        while todo:
            a, b = todo.pop()
            if b - a > LONG:
                at = min(range(a + 1, b), key=h.__getitem__)
                todo += [(at, b), (a, at)]
            elif b < n:
                out.append(b)
    return out


def units(text: str) -> tuple[list[int], list[int], list[int]]:
    """Ends of the units (each starts where the last ended), their numbers of words, their hashes."""
    ends, words, hashes = [], [], []
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = text
    at = 0
    for end in [*(m.end() for m in STOP.finditer(low)), len(low)]:
        part = low[at:end]
        w = part.split()
        if not w:
            if ends:
                ends[-1] = end  # white space goes with what came before
                at = end
            continue
        if len(w) <= LONG:
            ends.append(end)
            words.append(len(w))
            hashes.append(xxhash.xxh64_intdigest(" ".join(w)))
        else:
            first = cuts(w)
            starts = [m.start() for m in TOKEN.finditer(part)]
            for a, b in zip(first, [*first[1:], len(w)]):
                ends.append(at + starts[b] if b < len(w) else end)
                words.append(b - a)
                hashes.append(xxhash.xxh64_intdigest(" ".join(w[a:b])))
        at = end
    if ends:
        ends[-1] = len(low)
    return ends, words, hashes


def run_hashes(words: list[int], hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each unit with which a run starts: the run's hash and the unit after its last."""
    n = len(words)
    if n < RUN:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(words)])
    after = np.maximum(np.searchsorted(total, total[:-1] + WORDS, "left"), np.arange(n) + RUN)
    after = after[after <= n]
    m = len(after)
    h = np.array(hashes, np.uint64)
    out = np.zeros(m, np.uint64)
    length = after - np.arange(m)
    with np.errstate(over="ignore"):
        for step in range(int(length.max()) if m else 0):
            on = np.flatnonzero(length > step)
            out[on] = (out[on] ^ h[on + step]) * _P + (h[on + step] >> np.uint64(17))
    return out, after


def covered(text: str, away: np.ndarray | None) -> tuple[list[tuple[int, int]], int]:
    """The spans of the units that runs cover which are not first, and how many units these are. away: hashes of the
    runs that another document has first."""
    ends, words, hashes = units(text)
    run, after = run_hashes(words, hashes)
    gone = np.ones(len(run), bool)
    gone[np.unique(run, return_index=True)[1]] = False  # later places in the same document
    if away is not None:
        gone |= np.isin(run, away.view(np.uint64))
    mark = np.zeros(len(ends) + 1, np.int64)
    np.add.at(mark, np.flatnonzero(gone), 1)
    np.add.at(mark, after[gone], -1)
    cover = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
    cut = np.flatnonzero(np.diff(cover) > 1) + 1
    return [(ends[part[0] - 1] if part[0] else 0, ends[part[-1]]) for part in np.split(cover, cut) if len(part)], len(cover)


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, removed): each row's text without the removed units; `removed` are
    the code points [start, end) of the text as it was. A row in which nothing is removed has its whole text."""
    rows = with_text(docs, id_col, text_col)
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        rows = rows.withColumn("key", F.col("doc_id"))
    else:
        # Ids, then rows, as one number.
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        place = F.coalesce("doc_id", F.lit(2**63 - 1)).cast("decimal(20,0)") * F.lit(2**62).cast("decimal(19,0)") + F.col("row")
        rows = rows.withColumn("key", place.cast("decimal(38,0)"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            numbers, again, once = [], [], []
            for text in b.column("text").to_pylist():
                _, words, hashes = units(text)
                run, _ = run_hashes(words, hashes)
                once.append(np.unique(run))
                numbers.append(len(words))
                again.append(len(once[-1]) < len(run))
            runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, once)]), pa.int32()), pa.array(np.concatenate(once).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(numbers, pa.int64()), pa.array(again, pa.bool_()), runs], ["key", "units", "again", "runs"])

    kind = rows.schema["key"].dataType.simpleString()
    parsed = materialize(rows.select("key", "text").mapInArrow(parse, f"key {kind}, units long, again boolean, runs array<long>"), "runs")
    runs = parsed.select("key", F.explode("runs").alias("run"))
    shared = materialize(runs.groupBy("run").agg(F.min("key").alias("home"), F.max("key").alias("last")).where("last > home").select("run", "home"), "shared-runs")
    away = runs.join(shared, "run").where("key > home").groupBy("key").agg(F.collect_list("run").alias("away"))
    told = materialize(parsed.select("key", "units", "again").join(away, "key", "left"), "away")
    discard(parsed)
    discard(shared)
    joined = rows.join(told, "key").select("doc_id", "text", "units", "again", "away")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in slices(batches, "text"):
            out: list[list] = [[], [], []]
            for text, again, away in zip(b.column("text").to_pylist(), b.column("again").to_pylist(), b.column("away")):
                spans, removed = covered(text, away.values.to_numpy() if away.is_valid else None) if again or away.is_valid else ([], 0)
                at, kept = 0, []
                for start, end in spans:
                    kept.append(text[at:start])
                    at = end
                for c, v in zip(out, ("".join([*kept, text[at:]]), removed, [{"start": x, "end": y} for x, y in spans])):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out[0], pa.string()), b.column("units"), pa.array(out[1], pa.int64()), pa.array(out[2], kind)], ["doc_id", "text", "n_sentences", "n_removed", "removed"])

    return joined.mapInArrow(remove, "doc_id long, text string, n_sentences long, n_removed long, removed array<struct<start:long,end:long>>")
