from __future__ import annotations

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm.spans import LONG, NEAR, RUN, WORDS, cuts, dedup_spans, run_hashes, units

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Per doc_id in order; runs as texts, not hashes."""
    home: dict = {}
    parsed = {}
    for key, text in rows:
        ends, _, _ = units(text)
        starts = [0, *ends[:-1]]
        words = [text[s:e].lower().split() for s, e in zip(starts, ends)]
        runs = []
        for i in range(len(words)):
            j, have = i, []
            while j < len(words) and (j - i < RUN or sum(map(len, have)) < WORDS):
                have.append(tuple(words[j]))
                j += 1
            if len(have) >= RUN and sum(map(len, have)) >= WORDS:
                runs.append((tuple(have), i, j))
                home[tuple(have)] = min(home.get(tuple(have), key), key)
        parsed[key] = (text, starts, ends, runs)
    out = {}
    for key, (text, starts, ends, runs) in parsed.items():
        gone, seen = set(), set()
        for run, i, j in runs:
            if home[run] < key or run in seen:
                gone.update(range(i, j))
            seen.add(run)
        out[key] = "".join(text[starts[i] : ends[i]] for i in range(len(ends)) if i not in gone) if ends else text
    return out


def test_same_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute(sorted((r.doc_id, r.text) for r in docs.collect()))
    got = dedup_spans(docs).collect()
    assert {r.doc_id: r.text for r in got} == want and any(r.n_removed for r in got)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .!\n\tÀİ", max_size=200))
def test_units_cover_the_text(text):
    ends, words, hashes = units(text)
    assert ends == sorted(set(ends)) and len(ends) == len(words) == len(hashes) and (not ends or ends[-1] == len(text))
    assert all(0 < w <= LONG for w in words) and sum(words) == len(text.lower().split())
    run, after = run_hashes(words, hashes)
    assert len(run) == len(after) and all(a - i >= RUN for i, a in enumerate(after))


def test_odd_rows(spark, docs_frame):
    p = "One sentence of six words here. Another sentence of six words here. And a third one of seven words here. "
    docs = docs_frame([(1, p + "Own end of the first."), (2, "Own start of two. " + p), (3, None), (4, ""), (None, p), (5, p), (5, p), (6, p + p), (7, "w " * 5000), (8, "w " * 5000 + "x")], "key", "run", "away")
    got = {}
    for r in dedup_spans(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].n_removed == 0 and got[1][0].text.startswith(p)
    assert got[2][0].text == "Own start of two." and [x[:] for x in got[2][0].removed] == [(17, 18 + len(p))]
    assert got[3][0].text == got[4][0].text == "" and got[None][0].text == "" and [r.text for r in got[5]] == ["", ""]
    assert got[6][0].text == "" and 0 < len(got[7][0].text) < 200 and got[8][0].text.strip().endswith("x")
    alone = dedup_spans(docs_frame([(5, p), (5, p), (None, p + "Own end."), (6, "x"), (None, "And more. " + p), (-5, "y")])).collect()
    assert sorted(r.text for r in alone if r.doc_id == 5) == ["", p]
    assert sorted(r.text.strip() for r in alone if r.doc_id is None) == ["And more.", "Own end."]
    nulls = dedup_spans(docs_frame([(None, p + f"Own end of {i}.") for i in range(40)])).collect()
    assert sum(r.n_removed == 0 for r in nulls) == 1 and all(r.text.endswith(".") for r in nulls)
    assert dedup_spans(docs.limit(0)).count() == 0


def test_long_passages_are_caught(spark, docs_frame):
    passage = " ".join(f"word{i}" for i in range(60)) + "."  # one sentence of 60 words
    docs = docs_frame([(i, f"Begin number {i} is here. {passage} It ends as {i} does.") for i in range(5)])
    got = {r.doc_id: r.text for r in dedup_spans(docs).collect()}
    assert passage in got[0] and all("word30" not in got[i] and f"number {i}" in got[i] for i in range(1, 5))


def test_passages_in_mid_sentence_are_caught_at_any_offset(spark, docs_frame):
    passage = " ".join(f"word{i}" for i in range(70))
    before = lambda k: " ".join(f"own{k}x{i}" for i in range(k))
    docs = docs_frame([(k, f"{before(k)} {passage} {before(k + 40)}") for k in range(20)])
    got = {r.doc_id: r.text for r in dedup_spans(docs).collect()}
    assert passage in got[0] and all(w in got[k] for k in range(20) for w in (before(k), before(k + 40)))
    assert all(sum(w.startswith("word") for w in got[k].split()) <= 17 for k in range(1, 20))  # over three quarters go
    edited = docs_frame([(0, passage), (1, passage.replace("word5 ", "").replace("word60", "new and newer"))])
    assert sum(w.startswith("word") for w in {r.doc_id: r.text for r in dedup_spans(edited).collect()}[1].split()) <= 35


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=LONG + 1, max_size=120), st.integers(1, 20))
def test_cuts_do_not_depend_on_the_offset(words, offset):
    one, two = set(cuts(words)), {i - offset for i in cuts(["z"] * offset + words)}
    least = {i for i in range(NEAR, len(words)) if min(words[max(0, i - NEAR) : i + NEAR + 1], key=xxhash.xxh64_intdigest) == words[i]}
    assert least <= one and least <= two and max(b - a for a, b in zip(sorted(one), [*sorted(one)[1:], len(words)])) <= LONG


def test_where_no_word_is_least():
    words = sorted((f"w{i}" for i in range(100)), key=xxhash.xxh64_intdigest)
    for w in (words, words[::-1]):
        at = cuts(w)
        assert at[0] == 0 and at == sorted(set(at)) and max(b - a for a, b in zip(at, [*at[1:], 100])) <= LONG
