from __future__ import annotations

import corpus_pipeline as P
from logloom.llm import decontaminate, pii, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "simhash", "decontaminate", "pii", "pack"]
    now, kept = docs, {r.doc_id: r.text for r in docs.collect()}
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        got = {r.doc_id: r.text for r in out.collect()}
        if name == "quality":
            want = {r.doc_id for r in quality.judge(now, labels).collect() if r.keep}
        elif name == "simhash":
            want = {r.doc_id for r in simhash.near_duplicates(now).collect() if r.component_id == r.doc_id}
        elif name == "decontaminate":
            want = set(kept) - {r.doc_id for r in decontaminate.find_leaks(now, items).collect()}
            flat = lambda t: " ".join(t.lower().split())
            assert not any(flat(i.text) in flat(t) for i in items.collect() for t in got.values())
        else:
            want = set(kept)
            assert not any(pii.find(out).select("base").where("size(base) > 0").collect())
        assert set(got) == want and 0 < len(got) <= len(kept)
        now, kept = out, got
    pieces = P.STAGES[-1][1](spark, now, SF).collect()
    assert {r.doc_id for r in pieces} == set(kept)


def test_run(spark):
    assert P.run(spark, SF).count() > 0


def test_simhash_stage_against_an_exact_join(spark):
    """The stage keeps what an exact join of shingle sets keeps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets, root = {}, {}
    for r in docs.collect():
        w = r.text.lower().split()
        sets[r.doc_id] = frozenset(zip(*(w[i:] for i in range(5)))) or frozenset([tuple(w)])
    for d in sorted(sets):
        root[d] = d
        for o in [o for o in root if o < d and root[o] != root[d] and len(sets[o] & sets[d]) >= 0.8 * len(sets[o] | sets[d])]:
            least, other = sorted((root[o], root[d]))
            root = {k: least if v == other else v for k, v in root.items()}
    gone = {d for d, r in root.items() if r != d}
    got = set(sets) - {r.doc_id for r in P.distinct(spark, docs, SF).collect()}
    assert gone and got == gone
