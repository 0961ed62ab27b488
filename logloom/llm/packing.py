"""Packs token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

A document's ids, closed by the end id, are cut at every `size` ids. The pieces are dealt into groups by a hash of
their row's number, so a group is a random sample of lengths with about GROUP pieces however many there are, however
long a document is or however often it occurs, and first-fit decreasing runs in each group by itself. The winner of the tree's root is the bin with the most room; the way down
prefers the left child wherever its best bin still fits, which is the first fit. What stays free is padding; a
sequence whose fill is a power of two needs none.

A null text is an empty one and still has the end id. Rows that repeat a doc_id are packed one by one; a null doc_id
is kept. An empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, with_text

GROUP = 8192


class TournamentTree:
    """Capacities of bins in order; each inner node holds the larger of its children."""

    def __init__(self, leaves: int):
        self.width = 1 << max(0, (leaves - 1).bit_length())
        self.room = [0] * (2 * self.width)
        self.used = 0

    def open(self, capacity: int) -> int:
        self.used += 1
        self.set(self.used - 1, capacity)
        return self.used - 1

    def set(self, at: int, capacity: int) -> None:
        room, i = self.room, at + self.width
        room[i] = capacity
        while i > 1:
            i >>= 1
            best = max(room[2 * i], room[2 * i + 1])
            if room[i] == best:
                return
            room[i] = best

    def first_fit(self, need: int) -> int | None:
        room, i = self.room, 1
        if room[1] < need:
            return None
        while i < self.width:
            i *= 2
            if room[i] < need:
                i += 1
        return i - self.width


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece; lengths are 1 to size, ties go in the given order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = TournamentTree(max(1, len(lengths)))
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at = tree.first_fit(need)
        if at is None:
            at = tree.open(size)
        room = tree.room[at + tree.width]
        bins[i], offsets[i] = at, size - room
        tree.set(at, room - need)
    return bins, offsets


#: White space of this many characters in a row is left to the slow encoder: the fast one's pattern recurses on it.
LONG_SPACE = re.compile(r"\s{10000}")


@lru_cache(maxsize=2)
def bpe_encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """The ids that `tokenizers` gives for a tokenizer file, without added special tokens.

    A `.tiktoken` file of the same name holds the same vocabulary and merges; where there is one, its encoder finds the
    same ids faster, as both cut texts by one pattern (their classes agree on every code point, which a test goes
    through) and merge each part by rank. Texts with a special token's string or a very long run of white space are
    left to `tokenizers`."""
    import base64
    import os

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    specials = [t.content for t in slow.get_added_tokens_decoder().values()]
    one = lambda t: np.array(slow.encode(t, add_special_tokens=False).ids, "<u4")
    twin = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(twin):
        return lambda texts: [one(t) for t in texts]
    import public_tokenizers
    import tiktoken

    with open(twin, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    hard = lambda t: any(s in t for s in specials) or len(t) >= 10000 and LONG_SPACE.search(t) is not None
    return lambda texts: [one(t) if hard(t) else np.array(fast.encode_ordinary(t), "<u4") for t in texts]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids, cut at every `size`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe_encoder(tokenizer)
        for b in slices(batches, "text"):
            cols: list[list] = [[], [], [], [], []]
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist())):
                raw = ids.tobytes() + int(end_id).to_bytes(4, "little")
                total = len(ids) + 1
                for start in range(0, total, size):
                    part = raw[4 * start : 4 * (start + size)]
                    for c, value in zip(cols, (doc, start, len(part) // 4, zlib.crc32(part), total)):
                        c.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return with_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(cut: DataFrame, size: int = 1024, group: int = GROUP, seed: int = 17) -> DataFrame:
    """pieces() with sequence_id and offset."""
    cut = materialize(cut, "pieces")  # a narrow table, so that texts are not encoded twice
    groups = max(1, math.ceil(cut.count() / group))

    def fill(table: pa.Table) -> pa.Table:
        order = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(order.column("length").to_numpy(), size)
        base = int(order.column("pack_group")[0].as_py()) << 32
        return order.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))

    # Rows of a written table have the same numbers whenever it is read.
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(pieces(docs, tokenizer, id_col, text_col, size, end_id), size)
