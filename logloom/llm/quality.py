"""Quality classifier: a weak-label model over heuristic labellers trains a hashed linear scorer.

Each labeller votes to reject or to keep a document, or abstains: by its symbols, capitals, stutter, sentence stops,
repeated lines, insults, emptiness, and by the rows that label it. Expectation-maximisation over the counts of all
documents' vote patterns estimates how each labeller votes on good, junk and toxic documents (a Dawid-Skene model),
and so each pattern's posterior of not being good. Posteriors of a bounded sample of labelled documents (SAMPLE; of all, if none is
labelled) train a logistic scorer on hashed words and votes by the text; its score judges every document.

Texts are read once, into a table of votes and hashed features. All documents' votes are counted; only the counts, at most 3 to the number of labellers, come to the driver. The
sample is drawn by a hash of the id, at a rate that gives SAMPLE documents at any size. The weights sent to tasks have
BUCKETS entries. While it trains, the driver's Python holds the sample's buckets twice at most, in whole blocks that it gives back.

A null text is empty, and an empty text is rejected by its labeller. Null labels abstain; of repeated label rows the
worst counts; labels without document do nothing. Rows that repeat an id are judged each; a null id is kept as it is
and has no labels. An empty table gives an empty result. Only the id and text columns are read; keep_good() passes the
others, whatever their names."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, unused, with_text

SAMPLE, BUCKETS, ROUNDS, REJECT, CHUNK = 20_000, 1 << 20, 100, 0.5, 1 << 20
HEAD, OFTEN, VOTE, SILENT = 4, 4, 3.0, 0.3
KEEP_VOTE, REJECT_VOTE, ABSTAIN = 0, 1, 2
STYLE = ("symbols", "capitals", "stutter", "stops", "lines", "insults", "empty")
LABELS = ("labelled quality", "labelled toxic")
ASPECTS = ("junk", "toxic")
ONE_SIDED = ("stops", "insults", "empty")
#: What each labeller's rejection speaks of.
ASPECT_OF = tuple("toxic" if name in ("insults", "labelled toxic") else "junk" for name in STYLE + LABELS)

# Common English insults.
INSULTS = frozenset("idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns dumb imbecile jerk bastard bitch asshole fool ugly retard crap shit fuck".split())
LETTERS = re.compile(r"[^\W\d_]+")
SYMBOLS = "%$#*&|!~^=_<>{}[]\\"


def style_votes(text: str) -> list[int]:
    """The votes by the text, in the order of STYLE."""

    def vote(value: float, reject: float, keep: float) -> int:
        return REJECT_VOTE if value > reject else KEEP_VOTE if value < keep else ABSTAIN

    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return [ABSTAIN] * (len(STYLE) - 1) + [REJECT_VOTE]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    upper, lower = int(((codes >= 65) & (codes <= 90)).sum()), int(((codes >= 97) & (codes <= 122)).sum())
    lines = [s for s in text.split("\n") if s.strip()]
    few = n < 20
    return [
        vote(sum(map(text.count, SYMBOLS)) / len(text), 0.04, 0.01),
        ABSTAIN if few else vote(upper / max(1, upper + lower), 0.5, 0.2),
        ABSTAIN if few else vote(sum(map(eq, words, words[1:])) / n, 0.2, 0.05),
        ABSTAIN if n < 100 else REJECT_VOTE if sum(map(text.count, ".!?")) * 200 < n else ABSTAIN,
        ABSTAIN if len(lines) < 4 else vote(1 - len(set(lines)) / len(lines), 0.5, 0.1),
        REJECT_VOTE if len(INSULTS.intersection(LETTERS.findall(text.lower()))) >= 2 else ABSTAIN,
        ABSTAIN,
    ]


def features(text: str, votes: list[int]) -> np.ndarray:
    """Hashed distinct words, beginnings of the longer ones by how many words share them, and each rejection by the
    text."""
    words = set(LETTERS.findall(text.lower()))
    heads = Counter(w[:HEAD] for w in words if len(w) > HEAD)
    names = [w.encode("utf-8", "surrogatepass") for w in (*words, *(f"{h}\0{i}" for h, n in heads.items() for i in range(min(n, OFTEN))))] + [f"\0{s}".encode() for s, v in zip(STYLE, votes) if v == REJECT_VOTE]
    return np.unique(np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % BUCKETS).astype("<i4")


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (one row each) and their counts. Returns each pattern's posterior
    of rejection, the classes' shares (good first, then ASPECTS), and the probabilities of [labeller, class, vote].
    It starts from: a document is bad in an aspect if a labeller of that aspect rejects it. An abstention says
    nothing, except that a labeller that can only reject keeps what it does not reject; but it is held to overlook
    SILENT of the bad at least, as it may know only some of their forms."""
    rejects = votes == REJECT_VOTE
    silent = np.array([name in ONE_SIDED for name in STYLE + LABELS])
    votes = np.where((votes == ABSTAIN) & silent, KEEP_VOTE, votes)
    named = np.stack([rejects[:, [a == x for a in ASPECT_OF]].any(axis=1) for x in ASPECTS], axis=1).reshape(len(votes), len(ASPECTS))
    good = np.where(named.any(axis=1), 0.05, 0.95)
    spread = (named + 0.01) / (named + 0.01).sum(axis=1, keepdims=True)
    post = np.concatenate([good[:, None], (1 - good)[:, None] * spread], axis=1)
    classes = post.shape[1]
    own = np.array([[k > 0 and ASPECTS[k - 1] == a for k in range(classes)] for a in ASPECT_OF])
    prior = np.where(own[..., None], [1.0, 2.0], [2.0, 0.1])  # a labeller is more often right than wrong
    shares, table = np.full(classes, 1 / classes), prior / prior.sum(axis=2, keepdims=True)
    for _ in range(rounds):
        weight = post * counts[:, None]
        shares = (weight.sum(axis=0) + 1) / (counts.sum() + classes)
        for j in range(votes.shape[1]):
            for v in (KEEP_VOTE, REJECT_VOTE):
                table[j, :, v] = weight[votes[:, j] == v].sum(axis=0) + prior[j, :, v]
        table /= table.sum(axis=2, keepdims=True)
        quiet = np.where(silent[:, None] & own, np.maximum(table[..., KEEP_VOTE], SILENT), table[..., KEEP_VOTE])
        table = np.stack([quiet, 1 - quiet], axis=2)
        log = np.repeat(np.log(shares)[None, :], len(votes), axis=0)
        for j in range(votes.shape[1]):
            for v in (KEEP_VOTE, REJECT_VOTE):
                log[votes[:, j] == v] += np.log(table[j, :, v])
        new = np.exp(log - np.logaddexp.reduce(log, axis=1)[:, None])
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        if done:
            break
    return 1 - post[:, 0], shares, table


def vote_buckets() -> np.ndarray:
    return np.array([zlib.crc32(f"\0{s}".encode()) % BUCKETS for s in STYLE])


class Sample:
    """The buckets of rows (id, differences, target), in the order of the ids and then the differences. These are one
    block, which goes back to the system as a whole, and are undone one row at a time: the driver has few bytes to
    spare, and many small objects would stay with it."""

    def __init__(self, rows: Iterable[tuple[int, bytes, float]]):
        self.block, self.ends = bytearray(), array("q", [0])
        ids, targets = array("q"), array("d")
        for number, found, target in rows:
            self.block += found
            self.ends.append(len(self.block))
            ids.append(number)
            targets.append(target)
        by_id = groupby(sorted(range(len(ids)), key=ids.__getitem__), ids.__getitem__)
        self.order = [i for _, same in by_id for i in sorted(same, key=lambda i: bytes(self.block[self.ends[i] : self.ends[i + 1]]))]
        self.target = np.array(targets)[self.order]

    def __len__(self) -> int:
        return len(self.order)

    def __iter__(self) -> Iterator[np.ndarray]:
        for i in self.order:
            yield np.cumsum(np.frombuffer(self.block, "<i4", (self.ends[i + 1] - self.ends[i]) // 4, self.ends[i]), dtype=np.int32)


def fit(rows: list[np.ndarray] | Sample, target: np.ndarray, rounds: int = ROUNDS, least: int = 3, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights per bucket and the bias of a logistic scorer, by full-batch Adagrad; buckets that fewer than `least`
    rows have keep the weight they start with. The bias stays the rows' mean log odds and no weight is negative: a text is rejected for
    what it has, and neither kept for its length nor rejected for its brevity. A rejecting vote weighs VOTE at first
    and is drawn towards that, so that few rows suffice."""
    weights = np.zeros(BUCKETS, np.float32)
    weights[vote_buckets()] = VOTE
    if not rows:
        return weights, -VOTE / 2
    seen = np.zeros(BUCKETS, np.int32)
    for r in rows:
        seen[r] += 1  # a row has a bucket once
    used = np.flatnonzero(seen >= least)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    flat, ends = np.empty(int(seen[used].sum()), np.int32), np.zeros(len(rows) + 1, np.int64)
    for i, r in enumerate(rows):
        kept = (p := place[r])[p >= 0]
        ends[i + 1] = ends[i] + len(kept)
        flat[ends[i] : ends[i + 1]] = kept
    counts = np.diff(ends)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(flat), CHUNK)), len(rows))).tolist()
    mean = float(np.clip(target.mean(), 0.01, 0.3))
    start = weights[used].astype(float)
    w, bias = start.copy(), float(np.log(mean / (1 - mean)))
    sums = np.full(len(used), 1e-6)
    for _ in range(rounds):
        g = ridge * (w - start)
        for a, b in zip(cuts, cuts[1:]):
            part, full = flat[ends[a] : ends[b]], a + np.flatnonzero(counts[a:b])
            z = np.full(b - a, bias)
            z[full - a] += np.add.reduceat(w[part], ends[full] - ends[a])
            error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target[a:b]
            g += np.bincount(part, np.repeat(error, counts[a:b]), len(used))
        sums += g * g
        w = np.maximum(w - 0.3 * g / np.sqrt(sums), 0)
    weights[used] = w
    return weights, float(bias)


def featurized(rows: DataFrame, text_col: str, code: str, found: str, keep_text: bool) -> DataFrame:
    """rows with the votes by their texts, as one number, and the differences of the texts' buckets: a table, so that texts are read once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            codes, buckets = [], []
            for t in b.column(text_col).to_pylist():
                votes = style_votes(t or "")
                codes.append(sum(v * 3**i for i, v in enumerate(votes)))
                buckets.append(np.diff(features(t or "", votes), prepend=np.int32(0)).astype("<i4").tobytes())
            b = b.append_column(code, pa.array(codes, pa.int64())).append_column(found, pa.array(buckets, pa.binary()))
            yield b if keep_text else b.drop_columns([text_col])

    fields = [f for f in rows.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*fields, T.StructField(code, T.LongType()), T.StructField(found, T.BinaryType())])
    return materialize(rows.mapInArrow(read, schema), "features", "zstd")


def train(read: DataFrame, labels: DataFrame, label_id: str = "doc_id", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The scorer's weights and bias. read: (doc_id, code, found)."""
    known = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = known.select("doc_id", F.when(F.col("quality").isNull(), ABSTAIN).otherwise((F.col("quality") == 0).cast("int")).alias("q"), F.when(F.col("toxic").isNull(), ABSTAIN).otherwise((F.col("toxic") == 1).cast("int")).alias("t")).where(f"q <> {ABSTAIN} or t <> {ABSTAIN}")
    voted = read.select("doc_id", "code").join(known, "doc_id", "left")
    patterns = voted.groupBy("code", F.coalesce("q", F.lit(ABSTAIN)).alias("q"), F.coalesce("t", F.lit(ABSTAIN)).alias("t")).count().collect()  # 3 ** 9 rows at most
    table = np.array([[r.code // 3**i % 3 for i in range(len(STYLE))] + [r.q, r.t] for r in patterns], np.int64).reshape(-1, len(STYLE) + 2)
    posterior, _, _ = estimate(table, np.array([r["count"] for r in patterns], float))
    of = {(r.code, r.q, r.t): p for r, p in zip(patterns, posterior)}

    n = known.count()
    ids = known if n else read.select("doc_id", F.lit(ABSTAIN).alias("q"), F.lit(ABSTAIN).alias("t")).where("doc_id is not null").distinct()
    n = n or ids.count()
    rate = min(1.0, sample / max(1, n))
    chosen = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) < int(rate * (1 << 30)))
    picked = read.select("doc_id", "code", "found").join(F.broadcast(chosen), "doc_id")  # about SAMPLE rows
    trained = Sample((r.doc_id, r.found, of[(r.code, r.q, r.t)]) for r in picked.toLocalIterator())
    return fit(trained, trained.target)


def reject_scores(found: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The probability that a document is bad, by the differences of its buckets."""
    lens = pc.binary_length(found).to_numpy(zero_copy_only=False) // 4
    ends = np.cumsum(lens)
    total = lambda values: np.concatenate([[0], np.cumsum(values)])
    steps = total(np.frombuffer(b"".join(found.to_pylist()), "<i4").astype(np.int64))
    buckets = steps[1:] - np.repeat(steps[ends - lens], lens)
    sums = total(weights[buckets].astype(np.float64))
    z = sums[ends] - sums[ends - lens] + bias
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", sample: int = SAMPLE, reject: float = REJECT) -> DataFrame:
    """(doc_id, reject_score, keep): the scorer's probability that a document is bad; it is kept below `reject`."""
    read = featurized(with_text(docs, id_col, text_col), "text", "code", "found", keep_text=False)
    weights, bias = train(read, labels, label_id, sample)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = reject_scores(b.column("found"), model.value, bias)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(p < reject)], ["doc_id", "reject_score", "keep"])

    return read.select("doc_id", "found").mapInArrow(score, "doc_id long, reject_score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", sample: int = SAMPLE, reject: float = REJECT) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps."""
    code, found = unused(docs, "code"), unused(docs, "found")
    read = featurized(docs, text_col, code, found, keep_text=True)
    weights, bias = train(read.select(F.col(id_col).cast("long").alias("doc_id"), F.col(code).alias("code"), F.col(found).alias("found")), labels, label_id, sample)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = reject_scores(b.column(found), model.value, bias) < reject
            yield b.drop_columns([code, found]).filter(pa.array(good))

    return read.mapInArrow(keep, docs.schema)
