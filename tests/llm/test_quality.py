from __future__ import annotations

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from logloom.llm import quality as Q

SF = "/root/testdata/sf0.001"


def test_estimate_finds_labellers_accuracies():
    rng = np.random.default_rng(1)
    n, labellers = 20_000, len(Q.STYLE) + len(Q.LABELS)
    kind = rng.choice(3, n, p=[0.7, 0.2, 0.1])  # good, junk, toxic
    votes = np.full((n, labellers), Q.ABSTAIN)
    for j, aspect in enumerate(Q.ASPECT_OF):
        own = kind == 1 + Q.ASPECTS.index(aspect)
        says = rng.random(n) < 0.8
        votes[says & own & (rng.random(n) < 0.85), j] = Q.REJECT_VOTE
        votes[says & ~own & (rng.random(n) < 0.6), j] = Q.KEEP_VOTE
        votes[~own & (rng.random(n) < 0.01), j] = Q.REJECT_VOTE
    for j, name in enumerate(Q.STYLE + Q.LABELS):
        if name in Q.ONE_SIDED:
            votes[votes[:, j] == Q.KEEP_VOTE, j] = Q.ABSTAIN
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, shares, table = Q.estimate(patterns, counts.astype(float))
    assert np.abs(shares - [0.7, 0.2, 0.1]).max() < 0.05
    assert ((posterior[where.ravel()] > 0.5) == (kind > 0)).mean() > 0.95
    assert table[0, 1, Q.REJECT_VOTE] > 0.5 > table[0, 0, Q.REJECT_VOTE]


def test_style_votes():
    prose = "This is a quite ordinary sentence, one of many. It says nothing at all of interest to anyone. " * 2
    of = lambda text: dict(zip(Q.STYLE, Q.style_votes(text)))
    assert Q.REJECT_VOTE not in Q.style_votes(prose)
    assert of(prose.upper())["capitals"] == of(prose.replace(" ", "%%% "))["symbols"] == of("word " * 50)["stutter"] == of("")["empty"] == of("you idiot, you moron")["insults"] == Q.REJECT_VOTE
    assert of("\n".join(["same line"] * 9))["lines"] == Q.REJECT_VOTE and of("a " * 10 + " ".join(f"w{i}" for i in range(300)))["stops"] == Q.REJECT_VOTE


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, rest = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = Q.judge(docs, train).join(rest, "doc_id")
    table = {(r.quality, r.toxic): r.kept for r in got.groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert table[(1, 0)] > 0.98 and table[(0, 0)] < 0.05 and table[(1, 1)] < 0.2, table


def test_odd_rows(spark, docs_frame):
    good = "A plain text with some words in it, and then a second sentence that ends here."
    docs = docs_frame([*((i, f"{good} Number {i}.") for i in range(60)), *((100 + i, "BAD!! " * 40) for i in range(12)), (200, None), (201, ""), (None, good), (0, good), (300, good * 2000)], "keep", "q")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, None) for i in range(6)] + [(5, None, None), (None, 0, 1), (5, 1, 0), (999, 0, 1)], "doc_id long, quality int, toxic int")
    got = Q.judge(docs, labels)
    by = {(r.doc_id, i): r.keep for i, r in enumerate(got.collect())}
    assert len(by) == docs.count() and not any(k for (d, _), k in by.items() if d in (200, 201) or d is not None and 100 <= d < 112)
    assert all(k for (d, _), k in by.items() if d is None or d < 100 or d == 300)
    left = Q.keep_good(docs, labels)
    assert left.columns == docs.columns and left.count() == 63
    assert Q.judge(docs.limit(0), labels).count() == 0 and Q.judge(docs, labels.limit(0)).count() == docs.count()


def plain_model(patterns: list[tuple[int, ...]], counts: list[int]) -> list[float]:
    """Each pattern's posterior of rejection by expectation-maximisation, in plain Python."""
    names = Q.STYLE + Q.LABELS
    classes = ("good", "junk", "toxic")
    silent = [n in Q.ONE_SIDED for n in names]
    seen = [[Q.KEEP_VOTE if v == Q.ABSTAIN and silent[j] else v for j, v in enumerate(p)] for p in patterns]
    post = []
    for p in patterns:
        named = [any(v == Q.REJECT_VOTE and Q.ASPECT_OF[j] == a for j, v in enumerate(p)) for a in classes[1:]]
        good = 0.05 if any(named) else 0.95
        spread = [n + 0.01 for n in named]
        post.append([good, *((1 - good) * s / sum(spread) for s in spread)])
    own = [[c == Q.ASPECT_OF[j] for c in classes] for j in range(len(names))]
    for _ in range(100):
        shares = [(sum(w * p[c] for w, p in zip(counts, post)) + 1) / (sum(counts) + 3) for c in range(3)]
        reject = {}
        for j in range(len(names)):
            for c in range(3):
                keep, drop = (1.0, 2.0) if own[j][c] else (2.0, 0.1)
                for s, p, w in zip(seen, post, counts):
                    keep += w * p[c] * (s[j] == Q.KEEP_VOTE)
                    drop += w * p[c] * (s[j] == Q.REJECT_VOTE)
                quiet = keep / (keep + drop)
                reject[j, c] = 1 - (max(quiet, Q.SILENT) if silent[j] and own[j][c] else quiet)
        new = []
        for s in seen:
            like = []
            for c in range(3):
                log = math.log(shares[c])
                for j, v in enumerate(s):
                    log += 0 if v == Q.ABSTAIN else math.log(reject[j, c] if v == Q.REJECT_VOTE else 1 - reject[j, c])
                like.append(log)
            top = max(like)
            total = sum(math.exp(x - top) for x in like)
            new.append([math.exp(x - top) / total for x in like])
        change = max(abs(a - b) for x, y in zip(new, post) for a, b in zip(x, y))
        post = new
        if change < 1e-9:
            break
    return [1 - p[0] for p in post]


def plain_scorer(rows: list[set[int]], target: list[float]) -> tuple[dict[int, float], float]:
    votes = {zlib.crc32(f"\0{s}".encode()) % Q.BUCKETS for s in Q.STYLE}
    seen = Counter(b for r in rows for b in r)
    weights = {b: Q.VOTE for b in votes}
    used = sorted(b for b in seen if seen[b] >= 3)
    start = {b: weights.get(b, 0.0) for b in used}
    w, sums = dict(start), {b: 1e-6 for b in used}
    mean = min(0.3, max(0.01, sum(target) / len(target)))
    bias = math.log(mean / (1 - mean))
    for _ in range(Q.ROUNDS):
        g = {b: w[b] - start[b] for b in used}
        for r, t in zip(rows, target):
            z = bias + sum(w[b] for b in r if b in w)
            error = 1 / (1 + math.exp(-max(-50, min(50, z)))) - t
            for b in r:
                if b in g:
                    g[b] += error
        for b in used:
            sums[b] += g[b] ** 2
            w[b] = max(0.0, w[b] - 0.3 * g[b] / math.sqrt(sums[b]))
    return weights | w, bias


def test_scores_by_brute_force(spark):
    """Votes, the weak-label model, the sample, the scorer and its scores in plain Python, over a table."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r.reject_score for r in Q.judge(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    told = {r.doc_id: (int(r.quality == 0), int(r.toxic == 1)) for r in labels.collect()}
    style = {d: tuple(Q.style_votes(t)) for d, t in texts.items()}
    pattern = {d: (*style[d], *told.get(d, (Q.ABSTAIN, Q.ABSTAIN))) for d in texts}
    counts = Counter(pattern.values())
    posterior = dict(zip(counts, plain_model(list(counts), list(counts.values()))))
    buckets = {}
    for d, t in texts.items():
        words = set(re.findall(r"[^\W\d_]+", t.lower()))
        heads = Counter(w[:4] for w in words if len(w) > 4)
        names = [*words, *(f"{h}\0{i}" for h, n in heads.items() for i in range(min(n, 4))), *(f"\0{s}" for s, v in zip(Q.STYLE, style[d]) if v == Q.REJECT_VOTE)]
        buckets[d] = {zlib.crc32(n.encode()) % Q.BUCKETS for n in names}
    sample = sorted(d for d in told if d in texts)
    weights, bias = plain_scorer([buckets[d] for d in sample], [posterior[pattern[d]] for d in sample])
    for d in texts:
        want = 1 / (1 + math.exp(-(bias + sum(weights.get(b, 0.0) for b in buckets[d]))))
        assert abs(got[d] - want) < 1e-4, (d, got[d], want)


def test_fitting_holds_one_copy_of_the_buckets(monkeypatch):
    """Beside some arrays of BUCKETS entries and of CHUNK: in the driver of the pipeline there is little room for more."""
    monkeypatch.setattr(Q, "CHUNK", 1 << 16)
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(10_000, 3000, replace=False)).astype("<i4") for _ in range(3000)]
    size = sum(r.nbytes for r in rows)
    tracemalloc.start()
    weights, _ = Q.fit(rows, rng.random(len(rows)), rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (weights > 0).sum() > len(Q.STYLE)
    assert peak < 1.2 * size + 4 * weights.nbytes, (peak, size)


def test_sample_is_in_order():
    rows = [(7, b"\1\0\0\0\2\0\0\0", 0.5), (-3, b"", 0.1), (7, b"\1\0\0\0", 0.25), (0, b"\5\0\0\0\5\0\0\0", 1.0)]
    found = Q.Sample(rows)
    assert len(found) == 4 and [r.tolist() for r in found] == [[], [5, 10], [1], [1, 3]] and found.target.tolist() == [0.1, 1.0, 0.25, 0.5]
    assert not len(Q.Sample([])) and Q.fit(Q.Sample([]), Q.Sample([]).target)[1] == -Q.VOTE / 2
