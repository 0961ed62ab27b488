"""Language-model scores by subword lattices.

An existing vocabulary's scores weight its pieces; a word's probability is the sum over all its segmentations, got by
a forward recursion in log space (a character outside the vocabulary is spelled in bytes). As these scores are of
other texts, `rounds` of expectation-maximisation over all distinct training words fit the weights (the pieces stay as
they are). Corpus counts refine it: the lattice has an edge over a whole known word besides, weighted by the word's count, with the mass that absolute
discounting takes from the counts left to the segmentations. This is done per class of documents (the language
column's hash; a document's class is not told to the model) and a document's probability is marginal over classes
and segmentations. Scores are base-10 logarithms.

The counts of all training documents are used, so they grow with the corpus; they are never collected or broadcast.
Each task cuts its documents into blocks and writes, once, each block's distinct words and each document as counts of
the block's words. Words meet the corpus counts by a join and return to their block as a dictionary that is no larger
than the block. So a frequent word is one row per block, and nothing is grouped by document. A word's lattice weights
travel as 32-bit floats of its log probability, whatever its length: a score is off by a few 1e-8 of itself.

Null texts are empty; a text without words still has its end. A null id is held out unless its hash says otherwise
(crc32 of the empty string). Null languages are a class of their own. Rows that repeat an id are scored and counted
each. With no training document all counts are 0. An empty table gives an empty result."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import larger, materialize, tasks_for, words_of

CLASSES, BLOCK_CHARS, BLOCK_WORDS = 8, 24 << 20, 1 << 20
DISCOUNT, STOP, BYTES = 0.75, 0.3, 1e-3
#: Words of more characters are looked at one by one.
LONG = 256
LN10 = math.log(10)


@dataclass
class Pieces:
    """A piece vocabulary for whole arrays of words. weight: natural logarithms of the pieces' probabilities, in the
    order of `text`; byte: that of one byte of a character that is no piece; stop: the chance that a piece ends a word."""

    text: list[str]
    weight: np.ndarray
    byte: float = math.log(BYTES / 256)
    stop: float = STOP

    @classmethod
    def load(cls, path: str) -> Pieces:
        """A sentencepiece model. Scores of a unigram model are log probabilities; those of a merge model are
        ranks, which Zipf's law (rank + 2.7) turns into probabilities. Bytes share the mass BYTES."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        score = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                score.setdefault(model.id_to_piece(i), model.get_score(i))
        if all(s == round(s) for s in score.values()):
            score = {p: -math.log(2.7 - s) for p, s in score.items()}
        lower: dict[str, float] = {}
        for p, s in score.items():  # words are lower-cased
            q = p.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            lower[q] = s if q not in lower else float(np.logaddexp(lower[q], s))
        weight = np.array(list(lower.values()))
        return cls(list(lower), weight + math.log1p(-BYTES) - np.logaddexp.reduce(weight))

    def __post_init__(self):
        self.longest = max(map(len, self.text), default=1)
        keys = np.array([_hash(p) for p in self.text], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[keys >> np.uint64(42)] = True

    def edges(self, codes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """codes: words of one length as rows of code points. (start, end, rows, piece numbers) of the pieces in them;
        piece number -1: the bytes of a character that is no piece."""
        out = []
        with np.errstate(over="ignore"):
            for i in range(codes.shape[1]):
                h = np.zeros(len(codes), np.uint64)
                for j in range(i + 1, min(codes.shape[1], i + self.longest) + 1):
                    h = (h + codes[:, j - 1]) * _PRIME
                    rows = np.flatnonzero(self.filter[(h ^ (h >> np.uint64(31))) * _MIX >> np.uint64(42)])
                    key = (h[rows] ^ (h[rows] >> np.uint64(31))) * _MIX
                    at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    hit = self.keys[at] == key
                    rows, number = rows[hit], self.order[at[hit]]
                    if j == i + 1 and len(rows) < len(codes):
                        other = np.ones(len(codes), bool)
                        other[rows] = False
                        other = np.flatnonzero(other)
                        rows, number = np.concatenate([rows, other]), np.concatenate([number, np.full(len(other), -1)])
                    if len(rows):
                        out.append((i, j, rows, number))
        return out

    def cost(self, codes: np.ndarray, start: int, rows: np.ndarray, number: np.ndarray) -> np.ndarray:
        w = self.weight[number]
        if len(raw := np.flatnonzero(number < 0)):
            c = codes[rows[raw], start].astype(np.int64)
            w[raw] = self.byte * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        return w + math.log1p(-self.stop)

    def forward(self, codes: np.ndarray, edges: list) -> np.ndarray:
        """Log-space forward recursion: for each row and place, the log sum over all segmentations up to it."""
        alpha = np.full((codes.shape[1] + 1, len(codes)), -np.inf)
        alpha[0] = 0.0
        for i, j, rows, number in edges:  # in the order of their starts
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.cost(codes, i, rows, number))
        return alpha

    def long_edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for one long word (a row of code points): starts, ends and piece numbers, in the order of starts.
        All places are looked at together, one length of pieces after another."""
        n = len(codes)
        h, out = np.zeros(n, np.uint64), []
        with np.errstate(over="ignore"):
            for length in range(1, min(n, self.longest) + 1):
                h = (h[: n - length + 1] + codes[length - 1 :]) * _PRIME
                key = (h ^ (h >> np.uint64(31))) * _MIX
                at = np.flatnonzero(self.filter[key >> np.uint64(42)])
                found = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
                hit = self.keys[found] == key[at]
                at, number = at[hit], self.order[found[hit]]
                if length == 1:
                    other = np.ones(n, bool)
                    other[at] = False
                    other = np.flatnonzero(other)
                    at, number = np.concatenate([at, other]), np.concatenate([number, np.full(len(other), -1)])
                out.append((at, at + length, number))
        start, end, number = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(start, kind="stable")
        return start[order], end[order], number[order]

    def long_forward(self, n: int, edges: tuple[np.ndarray, np.ndarray, np.ndarray], cost: np.ndarray, backward: bool = False) -> np.ndarray:
        """forward() of one long word; backward: from its end."""
        alpha = [-math.inf] * (n + 1)
        alpha[n if backward else 0] = 0.0
        start, end, cost = edges[0].tolist(), edges[1].tolist(), cost.tolist()
        steps = zip(reversed(end), reversed(start), reversed(cost)) if backward else zip(start, end, cost)
        for i, j, w in steps:
            a, b = alpha[j], alpha[i] + w
            if a < b:
                a, b = b, a
            alpha[j] = a if b == -math.inf else a + math.log1p(math.exp(b - a))
        return np.array(alpha)

    def groups(self, words: list[str]):
        """(places in `words`, code points) of words of one length, their start mark before them, in parts."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lens):
            places = np.flatnonzero(lens == n)
            step = max(1, (1 << 20) // int(n + 1))
            for at in range(0, len(places), step):
                part = places[at : at + step]
                raw = "".join("\u2581" + words[i] for i in part.tolist()).encode("utf-32-le", "surrogatepass")
                yield part, np.frombuffer(raw, "<u4").reshape(len(part), -1).astype(np.uint64)

    def log_words(self, words: list[str], others: tuple[Pieces, ...] = ()) -> np.ndarray:
        """log10 of each word's probability: the sum over all its segmentations; a row for each word, a column for
        this model and for each of the others, which have the same pieces."""
        models = (self, *others)
        out = np.zeros((len(words), len(models)))
        for part, codes in self.groups(words):
            long = codes.shape[1] > LONG
            edges = [self.long_edges(row) for row in codes] if long else self.edges(codes)
            for i, m in enumerate(models):
                if long:
                    last = np.array([m.long_forward(len(row), e, m.cost(row[e[0]][:, None], 0, np.arange(len(e[0])), e[2]))[-1] for row, e in zip(codes, edges)])
                else:
                    last = m.forward(codes, edges)[-1]
                out[part, i] = (last + math.log(m.stop) - math.log1p(-m.stop)) / LN10
        return out

    def expected(self, words: list[str]) -> np.ndarray:
        """How often each piece is expected in the segmentations of the words, each counted once; last, how many
        words, and how many pieces and characters in bytes there are."""
        out = np.zeros(len(self.text) + 2)
        out[-2] = len(words)
        for _, codes in self.groups(words):
            if codes.shape[1] > LONG:
                for row in codes:
                    start, end, number = edges = self.long_edges(row)
                    w = self.cost(row[start][:, None], 0, np.arange(len(start)), number)
                    alpha, beta = self.long_forward(len(row), edges, w), self.long_forward(len(row), edges, w, backward=True)
                    share = np.exp(alpha[start] + w + beta[end] - alpha[-1])
                    out[: len(self.text)] += np.bincount(number[number >= 0], share[number >= 0], len(self.text))
                    out[-1] += share.sum()
                continue
            edges = self.edges(codes)
            alpha = self.forward(codes, edges)
            beta = np.full(alpha.shape, -np.inf)
            beta[-1] = -alpha[-1]
            for i, j, rows, number in reversed(edges):
                w = self.cost(codes, i, rows, number) + beta[j, rows]
                share = np.exp(alpha[i, rows] + w)
                beta[i, rows] = np.logaddexp(beta[i, rows], w)
                out[: len(self.text)] += np.bincount(number[number >= 0], share[number >= 0], len(self.text))
                out[-1] += share.sum()
        return out

    def fitted(self, expected: np.ndarray) -> Pieces:
        """Weights by expected counts; the scores so far count as a hundredth of an occurrence of each piece on average."""
        n, words, uses = expected[:-2], expected[-2], expected[-1]
        prior = np.exp(self.weight) * len(n) * 0.01
        total = (n + prior).sum()
        raw = BYTES + max(0.0, uses - n.sum())  # characters in bytes
        mass = total / (total + raw)
        return Pieces(self.text, np.log(n + prior) - math.log(total) + math.log(mass), math.log((1 - mass) / 256 + 1e-12), float(min(0.9, max(0.05, words / max(uses, 1.0)))))


_PRIME, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h + ord(c)) * int(_PRIME) % 2**64
    return (h ^ (h >> 31)) * int(_MIX) % 2**64


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: (block, id, word, c0..) and (block, null, null, ..., document)."""
    from pyspark import TaskContext

    names = ["block", "id", "word", *(f"c{k}" for k in range(CLASSES)), "doc_id", "held_out", "tokens"]
    number = TaskContext.get().partitionId() << 32
    words: defaultdict[bytes, int] = defaultdict(count().__next__)
    counts: list = []
    chars = 0

    def out() -> Iterator[pa.RecordBatch]:
        n = len(words)
        table = np.zeros((n, CLASSES), np.int64)
        for k, ids, tf in counts:
            table[ids, k] += tf
        every = list(words)
        for at in range(0, n, 1 << 16):
            end = min(n, at + (1 << 16))
            cols = [pa.array(np.full(end - at, number)), pa.array(np.arange(at, end)), pa.array(every[at:end], pa.binary()).cast(pa.string()), *(pa.array(table[at:end, k]) for k in range(CLASSES)), pa.nulls(end - at, pa.int64()), pa.nulls(end - at, pa.bool_()), pa.nulls(end - at, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    for batch in batches:
        docs: list[list] = [[], [], [], []]
        for doc, text, k, held in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "k", "held_out"))):
            tokens = words_of(text)
            ids, tf = np.unique(np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens)), return_counts=True)
            if not held:
                counts.append((k, ids, tf))
            packed = np.concatenate([np.diff(ids, prepend=0), tf]).astype("<u4")
            for c, v in zip(docs, (number, doc, held, zlib.compress(packed.tobytes(), 1))):
                c.append(v)
            chars += len(text)
            if chars >= BLOCK_CHARS or len(words) >= BLOCK_WORDS:
                yield from out()
                number, chars = number + 1, 0
                words, counts = defaultdict(count().__next__), []
        n = len(docs[0])
        yield pa.RecordBatch.from_arrays([pa.array(docs[0], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), *([pa.array(np.zeros(n, np.int64))] * CLASSES), pa.array(docs[1], pa.int64()), pa.array(docs[2], pa.bool_()), pa.array(docs[3], pa.binary())], names)
    yield from out()


def score_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang", folds: int = 5, held_out_fold: int = 1, rounds: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; the model and the base
    learn from rows whose crc32(id) mod `folds` is not `held_out_fold`."""
    spark = docs.sparkSession
    pieces = Pieces.load(vocabulary)
    kind = F.pmod(F.xxhash64(F.concat(F.lit("0"), F.col(class_col).cast("string"))), F.lit(CLASSES)).cast("int") if class_col else F.lit(0)
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held_out_fold
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), kind.alias("k"), held.alias("held_out"))
    cs = [f"c{k}" for k in range(CLASSES)]
    schema = "block long, id long, word string, " + "".join(f"{c} long, " for c in cs) + "doc_id long, held_out boolean, tokens binary"
    blocks = materialize(rows.mapInArrow(_blocks, schema), "blocks")
    in_docs, in_words = blocks.where("word is null"), blocks.where("word is not null")

    known = sum((F.col(c) for c in cs), F.lit(0))
    counts = materialize(in_words.groupBy("word").agg(*(F.sum(c).alias(c) for c in cs)), "counts")
    ends = {r[0]: r[1] for r in rows.where(~F.col("held_out")).groupBy("k").count().collect()}  # CLASSES rows at most
    classes = sorted(ends) or [0]
    fitted = {k: pieces for k in classes}
    for _ in range(rounds):
        current = spark.sparkContext.broadcast(fitted)  # CLASSES times the vocabulary file at most

        def expect(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros(len(p.text) + 2) for k, p in current.value.items()}
            for b in larger(batches):
                words = np.array(b.column("word").to_pylist(), object)
                for k, p in current.value.items():
                    total[k] += p.expected(words[b.column(cs[k]).to_numpy() > 0].tolist())
            for k, t in total.items():
                some = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(some), pa.array(t[some])], ["k", "piece", "n"])

        sums = counts.where(known > 0).mapInArrow(expect, "k long, piece long, n double").groupBy("k", "piece").agg(F.sum("n").alias("n"))
        expected = {k: np.zeros(len(pieces.text) + 2) for k in classes}
        for k, piece, n in sums.toLocalIterator():  # a row for each class and piece of the vocabulary at most
            expected[k][piece] = n
        fitted = {k: p.fitted(expected[k]) if expected[k][-2] else p for k, p in fitted.items()}
    final = spark.sparkContext.broadcast(fitted)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word's weight: log10 of its segmentations' sum in each class that has documents, as floats, then a
        (count, class) for each class that has the word."""
        for b in larger(batches):
            table = np.stack([b.column(c).to_numpy() for c in cs], axis=1)
            words = b.column("word").to_pylist()
            first, *others = final.value.values()
            head = first.log_words(words, tuple(others)).astype("<f4")
            keyed = (table << 8) | np.arange(CLASSES)
            packed = [h.tobytes() + k[t > 0].astype("<u8").tobytes() for h, k, t in zip(head, keyed, table)]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(packed, pa.binary()), *(b.column(c) for c in cs)], ["word", "weight", *cs])

    words = materialize(counts.mapInArrow(weigh, "word string, weight binary, " + ", ".join(f"{c} long" for c in cs)), "words")
    zero = F.lit(0).cast("long")
    got = words.agg(F.count(F.when(known > 0, 1)).alias("v"), *(F.coalesce(F.sum(c), zero).alias(f"n{k}") for k, c in enumerate(cs)), *(F.count(F.when(F.col(c) > 0, 1)).alias(f"t{k}") for k, c in enumerate(cs))).first()
    model = Model(np.array([got[f"n{k}"] for k in range(CLASSES)], float), np.array([got[f"t{k}"] for k in range(CLASSES)], float), np.array([ends.get(k, 0) for k in range(CLASSES)], float), got["v"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return model.score(left, right)

    dictionary = in_words.select("block", "id", "word").join(words.select("word", "weight"), "word").select(F.col("block").alias("of_block"), "id", "weight")
    # Blocks are of one size, so their number is that of tasks: a task's share does not grow with the table.
    n = max(tasks_for(spark), 2 * in_docs.select("block").distinct().count())
    met = in_docs.select("block", "doc_id", "held_out", "tokens").repartition(n, "block").groupBy("block").cogroup(dictionary.repartition(n, "of_block").groupBy("of_block"))
    return met.applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@dataclass
class Model:
    """Totals of the training documents: words, distinct words and documents by class, distinct words over all."""

    words: np.ndarray
    types: np.ndarray
    documents: np.ndarray
    distinct: int

    def score(self, docs: pa.Table, dictionary: pa.Table) -> pa.Table:
        n_end = self.documents.sum()
        total, distinct = self.words.sum() + n_end, self.distinct + (n_end > 0)
        base_of = lambda c: np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        classes = np.flatnonzero(self.documents > 0) if n_end else np.array([0])
        head = 4 * len(classes)
        size = 1 + max(dictionary.column("id").to_numpy().max(initial=-1), -1)
        counts, sub = np.zeros((int(size), CLASSES)), np.zeros((int(size), len(classes)))
        for ids, weights in zip(dictionary.column("id").chunks, dictionary.column("weight").chunks):
            raw = weights.to_pylist()
            at = ids.to_numpy()
            lens = np.fromiter(map(len, raw), np.int64, len(raw))
            flat = np.frombuffer(b"".join(raw), np.uint8)
            starts = np.cumsum(lens) - lens
            sub[at] = flat[starts[:, None] + np.arange(head)].view("<f4")
            many = (lens - head) // 8
            for i in range(int(many.max(initial=0))):
                on = np.flatnonzero(many > i)
                entry = flat[(starts[on] + head + 8 * i)[:, None] + np.arange(8)].view("<u8")[:, 0]
                counts[at[on], (entry & np.uint64(255)).astype(int)] += (entry >> np.uint64(8)).astype(np.int64)
        every = counts.sum(axis=1)
        base = base_of(every)
        whole = self.words.sum()
        logs = np.zeros((int(size), len(classes)))
        with np.errstate(divide="ignore", invalid="ignore", under="ignore"):
            for i, k in enumerate(classes):
                # A class backs off to all classes' counts, these to its segmentations. Far words underflow in the
                # sums; their logarithm is that of the last step alone.
                p, far = 10.0 ** sub[:, i], sub[:, i]
                for own, n, types in ((every, whole, self.distinct), (counts[:, k], self.words[k], self.types[k])):
                    if n:
                        p = (np.maximum(own - DISCOUNT, 0) + DISCOUNT * types * p) / n
                        far = far + math.log10(DISCOUNT * types / n)
                logs[:, i] = np.where(p > 1e-290, np.log10(p), far)
        end = (self.documents[classes] + 1) / (self.documents[classes] + self.words[classes] + 2)
        prior = np.log10((self.documents[classes] + 1) / (self.documents[classes] + 1).sum())
        out: list[list] = [[], [], [], []]
        for raw in docs.column("tokens").to_pylist():
            ids, tf = np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64).reshape(2, -1)
            ids = np.cumsum(ids)
            n = int(tf.sum())
            by_class = tf @ logs[ids] + n * np.log10(1 - end) + np.log10(end) + prior
            top = by_class.max()
            for c, v in zip(out, (n + 1, int(tf[every[ids] > 0].sum()) + int(n_end > 0), float(tf @ base[ids] + base_of(n_end)), float(top + np.log10((10.0 ** (by_class - top)).sum())))):
                c.append(v)
        n_train = np.full(len(out[0]), int(total), np.int64)
        return pa.table([docs.column("doc_id"), docs.column("held_out"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(n_train), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
