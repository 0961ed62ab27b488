from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm.decontaminate import build, find_leaks, leaks_in, normalized, plan_of, without_leaks

ITEM = "the quick brown fox jumps over the lazy dog and then it goes home to rest a while"


def least_edits(item: str, text: str) -> int:
    """Of the item against any part of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def flat(text: str) -> str:
    return "".join(map(chr, normalized(text)[0]))


def test_no_item_within_the_budget_is_lost():
    rng = random.Random(3)
    alphabet = "abcde "
    for round_ in range(150):
        item = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 90))).strip() or "a"
        s = list(item)
        for _ in range(rng.randrange(0, 10)):
            p = rng.randrange(len(s) + 1)
            what = rng.random()
            if what < 0.4 and s:
                s[p % len(s)] = rng.choice(alphabet)
            elif what < 0.7 and s:
                del s[p % len(s)]
            else:
                s.insert(p, rng.choice(alphabet))
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) + "".join(s) + "".join(rng.choice(alphabet) for _ in range(60))
        m = len(flat(item))
        k, _ = plan_of(m, 0.1, 5)
        best = least_edits(flat(item), flat(text))
        found = leaks_in(text, build([(1, item)], 0.1, 5), m, 0.1)
        assert bool(found) == (best <= k), (round_, item, text, best, k)
        if found:
            _, start, end, edits, _ = min(found, key=lambda f: f[3])
            assert edits == best and least_edits(flat(item), flat(text[start:end])) == edits


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=40), st.text(max_size=40))
def test_exact_items_are_found_anywhere(before, after):
    text = before + ITEM.upper().replace(" ", " \n ") + after
    found = leaks_in(text, build([(7, ITEM)]), len(ITEM))
    assert any(f[0] == 7 and f[3] == 0 and flat(text[f[1] : f[2]]) == ITEM for f in found)


def test_tables(spark, docs_frame):
    docs = docs_frame([(1, "x " + ITEM + " y"), (2, None), (3, ""), (4, "clean words of no harm " * 2000), (5, ITEM * 2), (5, ITEM * 2), (None, ITEM), (6, "z" * 300_000 + ITEM)], "item_id", "edits")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, "another item that nobody has at all here")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.start, r.end, r.edits) for r in find_leaks(docs, items).collect())
    n = len(ITEM)
    assert got == sorted([("1", 1, 2, 2 + n, 0), *[("5", 1, 0, n, 0), ("5", 1, n, 2 * n, 0)] * 2, ("None", 1, 0, n, 0), ("6", 1, 300_000, 300_000 + n, 0)])
    left = without_leaks(docs, items)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4] and left.columns == docs.columns
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0
    assert without_leaks(docs, items.limit(0)).count() == docs.count()


def test_short_items_must_be_the_whole_text(spark, docs_frame):
    docs = docs_frame([(1, "a b c d e"), (2, " Yes. "), (3, "he said yes. and no"), (4, "a")])
    items = spark.createDataFrame([(1, "a"), (2, "yes.")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()) == [(2, 2), (4, 1)]


def test_stretches_and_halves_find_the_same(monkeypatch):
    from logloom.llm import decontaminate

    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefghij klm") for _ in range(n))
    start = some(60)
    items = [(i, start + some(60)) for i in range(40)]
    text = "".join(rng.choice([start + some(30), items[rng.randrange(40)][1], some(50)]) for _ in range(80))
    whole = sorted(leaks_in(text, build(items), 120))
    assert len(whole) > 10
    for hits in (3000, 200, 20):
        monkeypatch.setattr(decontaminate, "HITS", hits)
        assert sorted(leaks_in(text, build(items), 120)) == whole


def test_templated_items_take_bounded_memory_and_linear_time():
    """Thousands of items with one beginning against texts that repeat it."""
    import time
    import tracemalloc

    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop qrs") for _ in range(n))
    start = some(60)
    took = []
    for n in (300, 600, 1200):
        index = build([(i, start + some(120)) for i in range(n)])
        text = "".join(start + some(3) for _ in range(20))
        tracemalloc.start()
        began = time.perf_counter()
        assert leaks_in(text, index, 180) == []
        took.append(time.perf_counter() - began)
        assert tracemalloc.get_traced_memory()[1] < 700 << 20
        tracemalloc.stop()
    assert took[2] < 6 * took[0] + 5


def test_parts_of_long_texts_overlap(monkeypatch):
    from logloom.llm import decontaminate

    monkeypatch.setattr(decontaminate, "CHUNK", 50)
    text = "ab " * 40 + ITEM + " cd" * 40
    assert [f[1:4] for f in leaks_in(text, build([(1, ITEM)]), len(ITEM))] == [(120, 120 + len(ITEM), 0)]
