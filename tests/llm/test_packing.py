from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logloom.llm.packing import bpe_encoder, first_fit_decreasing, pack_documents

SF = "/root/testdata/sf0.001"

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing(lengths):
    bins, offsets = first_fit_decreasing(np.array(lengths, int), 64)
    room: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((b for b, r in enumerate(room) if r >= lengths[i]), None)
        if at is None:
            room.append(64)
            at = len(room) - 1
        assert (bins[i], offsets[i]) == (at, 64 - room[at])
        room[at] -= lengths[i]


def check(docs, rows, size):
    slow = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, text in docs:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(by_doc[doc], key=lambda r: r.start)
        assert [r.start for r in mine] == list(np.cumsum([0, *(r.length for r in mine)])[:-1]) and sum(r.length for r in mine) == len(ids) == mine[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    fill = []
    for rows_ in by_seq.values():
        rows_.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows_] == list(np.cumsum([0, *(r.length for r in rows_)])[:-1])
        fill.append(sum(r.length for r in rows_))
    assert max(fill) <= size
    return sum(fill) / (len(fill) * size)


def test_documents_are_cut_and_packed_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert check([(r.doc_id, r.text) for r in docs.collect()], pack_documents(docs, PATH).collect(), 1024) > 0.98


def test_fast_and_slow_encoders_agree():
    encode, slow = bpe_encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["", " ", "a  b\n\n c", "été 日本 \U0001f600", "x<|endoftext|>y", "don't I'LL 12345 !!!???", "\x00\x1f\u200b", "a" * 3000]
    for t, ids in zip(texts, encode(texts)):
        assert list(ids) == slow.encode(t, add_special_tokens=False).ids


def test_long_runs():
    encode, slow = bpe_encoder(PATH), Tokenizer.from_file(PATH)
    for t in ("x" + " " * 2_000_000, "x" + "\n" * 2_000_000, "\u3000" * 50_000 + "y", "ab" * 200_000):
        assert list(encode([t])[0]) == slow.encode(t, add_special_tokens=False).ids


def test_encoders_agree_on_every_code_point():
    encode, slow = bpe_encoder(PATH), Tokenizer.from_file(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}b {chr(c)}{chr(c)}1 {chr(c)}!  {chr(c)}" for c in points[at : at + 4096])
        assert list(encode([text])[0]) == slow.encode(text, add_special_tokens=False).ids


def test_equal_rows_go_to_many_groups(spark, monkeypatch):
    from logloom.llm import packing

    monkeypatch.setattr(packing.pack, "__defaults__", (1024, 64, 17))
    rows = spark.range(2000, numPartitions=4).selectExpr("cast(null as long) doc_id", "'some words' text")
    got = pack_documents(rows, PATH).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.sequence_id >> 32, []).append(r)
    assert len(got) == 2000 and len(groups) == 32 and max(map(len, groups.values())) < 128
    assert len({(r.sequence_id, r.offset) for r in got}) == 2000


def test_odd_rows(spark, docs_frame):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "word " * 5000), (4, "<|endoftext|>")]
    docs = docs_frame(rows, "start", "pack_group")
    assert check(rows, pack_documents(docs, PATH).collect(), 1024) > 0
    twice = pack_documents(docs_frame([(7, "same text"), (7, "same text")]), PATH).collect()
    assert len(twice) == 2 and {(r.start, r.offset) for r in twice} == {(0, 0), (0, twice[0].length)}
    assert pack_documents(docs.limit(0), PATH).count() == 0
