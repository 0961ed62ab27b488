from __future__ import annotations

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from logloom.llm.lattice import Pieces, score_documents

SF = "/root/testdata/sf0.001"

PATH = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(p: Pieces, word: str) -> float:
    """log10 of the sum, by listing every segmentation."""
    weight = dict(zip(p.text, p.weight))
    text = "▁" + word

    def total(at: int, used: int) -> float:
        if at == len(text):
            return p.stop * (1 - p.stop) ** (used - 1)
        out = 0.0
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in weight:
                out += math.exp(weight[text[at:end]]) * total(end, used + 1)
            elif end == at + 1:
                out += math.exp(p.byte * len(text[at].encode())) * total(end, used + 1)
        return out

    return math.log10(total(0, 0))


def test_forward_sums_all_segmentations():
    p = Pieces.load(PATH)
    words = ["a", "the", "thorn", "été", "日x", "q" * 9, "thndhain,"]
    got = p.log_words(words)[:, 0]
    assert np.allclose(got, [all_segmentations(p, w) for w in words], rtol=1e-9)
    assert np.isfinite(p.log_words(["x" * 100_000])).all()


def test_long_words_are_read_alike(monkeypatch):
    from logloom.llm import lattice

    p = Pieces.load(PATH)
    words = ["thornintheside" * 12, "日本x" * 40, "a" * 90, "été" * 50]
    one, counts = p.log_words(words), p.expected(words)
    monkeypatch.setattr(lattice, "LONG", 10)
    assert np.allclose(p.log_words(words), one, rtol=1e-9) and np.allclose(p.expected(words), counts, rtol=1e-6, atol=1e-9)
    began = time.perf_counter()
    assert np.isfinite(p.log_words(["日本語の文" * 40_000, "x" * 200_000])).all() and time.perf_counter() - began < 20


def test_expectation_raises_the_likelihood():
    p = Pieces.load(PATH)
    words = ["thorn", "thorny", "horn", "north", "northern"] * 3
    before = p.log_words(words).sum()
    for _ in range(3):
        p = p.fitted(p.expected(words))
        after = p.log_words(words).sum()
        assert after > before
        before = after
    e = p.expected(words)
    assert e[-2] == len(words) and abs(np.exp(p.weight).sum() + 256 * math.exp(p.byte) - 1) < 1e-6


def test_base_and_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in score_documents(docs, PATH).collect()}
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    counts, tokens = Counter(), {}
    for r in docs.collect():
        tokens[r.doc_id] = [*re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(lower)), None]
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            counts.update(tokens[r.doc_id])
    n, v = sum(counts.values()), len(counts)
    for i, w in tokens.items():
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 5 == 1)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and math.isfinite(r.score) and r.score < 0
    trained = [r for r in got.values() if not r.held_out]
    assert sum(r.score for r in trained) > sum(r.base_score for r in trained)


def plain_forward(weight, byte, stop, text):
    """Natural logarithms of the sums over all segmentations of each beginning of a text."""
    longest = max(map(len, weight))
    alpha = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            w = weight.get(text[start:end], byte * len(text[start:end].encode()) if end == start + 1 else None)
            if w is not None:
                a, b = alpha[end], alpha[start] + w + math.log1p(-stop)
                alpha[end] = max(a, b) + math.log1p(math.exp(min(a, b) - max(a, b)))
    return alpha


def plain_counts(weight, byte, stop, text):
    """Expected uses of pieces, and of pieces and bytes' characters together, by listing all segmentations."""
    total, uses, every = 0.0, Counter(), 0.0
    stay = math.log1p(-stop)

    def walk(at, p, path):
        nonlocal total, every
        if at == len(text):
            total += p
            every += p * len(path)
            for x in path:
                uses[x] += p
            return
        for end in range(at + 1, len(text) + 1):
            piece = text[at:end]
            if piece in weight:
                walk(end, p * math.exp(weight[piece] + stay), [*path, piece])
            elif end == at + 1:
                walk(end, p * math.exp(byte * len(piece.encode()) + stay), [*path, None])

    walk(0, 1.0, [])
    return {x: n / total for x, n in uses.items() if x is not None}, every / total


def test_score_by_brute_force(spark):
    """The whole model in plain Python: fitting by listed segmentations, discounted counts, the mixture of classes."""
    texts = [("en", "the cat sat the mat"), ("en", "a cat and the dog"), ("de", "der hund sah die katze"), (None, "日本 x9 the"), ("en", "unseen wörds dog"), ("de", "日" * 50_000 + " der"), ("fr", ""), ("en", "THE the Cat")]
    rows = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts)], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    kind = {r[0]: r[1] for r in rows.select("doc_id", F.pmod(F.xxhash64(F.concat(F.lit("0"), F.col("lang"))), F.lit(8)).cast("int")).collect()}
    got = {r.doc_id: r for r in score_documents(rows, PATH).collect()}
    train = [i for i in kind if zlib.crc32(str(i).encode()) % 5 != 1]
    assert all(got[i].held_out == (i not in train) for i in kind) and {4, 5} & set(kind) and len(train) < len(kind)
    words = {i: t.lower().split() for i, (_, t) in enumerate(texts)}
    classes = sorted({kind[i] for i in train})
    counts = {k: Counter(w for i in train if kind[i] == k for w in words[i]) for k in classes}
    every = sum(counts.values(), Counter())
    first = Pieces.load(PATH)
    models = {k: (dict(zip(first.text, first.weight.tolist())), first.byte, first.stop) for k in classes}
    for _ in range(2):
        for k, (weight, byte, stop) in models.items():
            if not counts[k]:
                continue
            n, uses = Counter(), 0.0
            for w in counts[k]:
                got_n, got_uses = plain_counts(weight, byte, stop, "\u2581" + w)
                n.update(got_n)
                uses += got_uses
            prior = {p: math.exp(w) * len(weight) * 0.01 for p, w in weight.items()}
            total = sum(prior.values()) + sum(n.values())
            raw = 1e-3 + max(0.0, uses - sum(n.values()))
            mass = total / (total + raw)
            new = {p: math.log(n[p] + prior[p]) - math.log(total) + math.log(mass) for p in weight}
            models[k] = (new, math.log((1 - mass) / 256 + 1e-12), min(0.9, max(0.05, len(counts[k]) / max(uses, 1.0))))
    docs = Counter(kind[i] for i in train)
    priors = {k: (docs[k] + 1) / sum(docs[c] + 1 for c in classes) for k in classes}

    def log10_word(k, w):
        weight, byte, stop = models[k]
        log = (plain_forward(weight, byte, stop, "\u2581" + w)[-1] + math.log(stop) - math.log1p(-stop)) / math.log(10)
        p, far = (10**log if log > -290 else 0.0), log
        for c, n, types in ((every[w], sum(every.values()), len(every)), (counts[k][w], sum(counts[k].values()), len(counts[k]))):
            if n:
                p, far = (max(c - 0.75, 0) + 0.75 * types * p) / n, far + math.log10(0.75 * types / n)
        return math.log10(p) if p > 1e-290 else far

    for i, w in words.items():
        by_class = []
        for k in classes:
            n_k = sum(counts[k].values())
            end = (docs[k] + 1) / (docs[k] + n_k + 2)
            by_class.append(sum(log10_word(k, x) for x in w) + len(w) * math.log10(1 - end) + math.log10(end) + math.log10(priors[k]))
        top = max(by_class)
        want = top + math.log10(sum(10 ** (b - top) for b in by_class))
        assert abs(got[i].score - want) < 1e-6 * abs(want), (i, got[i].score, want)


def test_odd_rows(spark, docs_frame):
    docs = docs_frame([(0, None), (1, ""), (2, "A b  a\u00a0c"), (2, "A b  a\u00a0c"), (None, "x"), (3, "é " * 5), (4, "w" * 50_000)], "lang", "word", "block")
    got = score_documents(docs, PATH).collect()
    assert len(got) == 7 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 2, 4, 4, 6]
    assert score_documents(docs.limit(0), PATH).count() == 0
    only = score_documents(docs_frame([(1, "held out only")], "lang"), PATH, folds=1, held_out_fold=0).first()
    assert only.held_out and only.train_tokens == 0 and only.n_known == 0 and math.isfinite(only.score)
    assert score_documents(spark.read.parquet(f"{SF}/documents.parquet"), PATH, class_col=None).count() == 200
