"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by BK-trees.

Every fingerprint goes to the shards whose key is one of its bit groups (or, for wide radii, one of its least
shingles), so that any two that must be linked meet in a shard; each shard has a BK-tree, and a search follows only
the edges within the radius. Shards are dealt out by their key instead of broadcast: together they hold every
document's fingerprint, which has no size bound. A shard of more than PART members is cut into parts, and each pair
of parts becomes a cell with a tree of its own, so no task gets a whole large group. Cells return spanning links
only; the links' components are found by rounds of joins (graph.py).

Nulls, ties, repeats: a null text is an empty one, and all texts without words have the fingerprint zero and are
linked like any others; rows of one doc_id are linked only as their fingerprints are; a row whose doc_id is null gets
the component of its fingerprint, but gives no component its id. An empty table gives an empty result. Only the id
and text columns are read, so other columns may have any name."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bktree import link
from .common import materialize, runs, slices, tasks_for, unused, with_text, words_of
from .graph import components

PART, PART_BYTES = 512, 32 << 20
#: Rows of three numbers that are broadcast at most.
FEW = 1 << 20
SEED = 42


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of that many words, repeats included; of the whole sequence, if it has fewer."""
    w = words_of(text)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else [], np.uint64)
    parts = zip(*(w[i:] for i in range(words)))
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(SEED)), np.uint64, len(w) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is 1 in over half of the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): each row's fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            prints = np.array([fingerprint(shingle_hashes(t.as_py(), shingle)) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return with_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, fp long")


def shard_keys(fp, count: int, radius: int):
    """The keys of a fingerprint's shards: with radius r and b bit groups, two fingerprints at most r apart agree in
    b - r groups at least, so each choice of b - r groups is a table of shards. b grows with the number of distinct
    fingerprints, so that a shard of evenly spread ones stays small; each choice is exact."""
    b = radius + 1
    while count > 64 << (64 * (b - radius) // b) and b < 2 * radius + 1:
        b += 1
    edges = [64 * i // b for i in range(b + 1)]
    keys = []
    for table, chosen in enumerate(combinations(range(b), b - radius)):
        key = F.lit(table).cast("long")
        for i in chosen:
            width = edges[i + 1] - edges[i]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        keys.append(key)
    return F.array(*keys)


def cells(shards: DataFrame, part: int = PART, part_bytes: int = PART_BYTES) -> DataFrame:
    """shards (key, node, ...) with the columns a, b, own: a shard of up to `part` members is the cell (0, 0); of a
    larger one, or one whose members' `bytes` (if there is such a column) are more than `part_bytes`, each pair of
    parts is a cell, whose tree holds the rows that are `own` and is searched by the others (by all, within one part).
    Only the table of large shards' sizes is joined; AQE splits what is uneven."""
    size = F.sum("bytes") if "bytes" in shards.columns else F.lit(0)
    parts = F.greatest(F.ceil(F.col("n") / part), F.ceil(F.col("size") / part_bytes)).cast("int")
    large = materialize(shards.groupBy("key").agg(F.count(F.lit(1)).alias("n"), size.alias("size")).select("key", F.least(parts, F.col("n")).cast("int").alias("m")).where("m > 1"), "large-shards")
    if large.isEmpty():
        return shards.withColumns({"a": F.lit(0), "b": F.lit(0), "own": F.lit(True)})
    own = F.pmod(F.xxhash64("node", "key"), F.col("m")).cast("int")
    joined = shards.join(large, "key", "left").withColumn("p", F.when(F.col("m").isNull(), F.lit(0)).otherwise(own))
    met = joined.withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("m"), F.lit(1)) - 1)))
    return met.withColumns({"a": F.least("p", "o"), "b": F.greatest("p", "o"), "own": F.col("p") <= F.col("o")}).drop("p", "o", "m")


def equal_share(differences: np.ndarray) -> np.ndarray:
    """Of the half bytes of each row, the share that is 0."""
    return (((differences & 15) == 0).mean(axis=1) + ((differences >> 4) == 0).mean(axis=1)) / 2


def _dealt(cell_rows: DataFrame) -> DataFrame:
    return cell_rows.repartition(tasks_for(cell_rows.sparkSession), "key", "a", "b").sortWithinPartitions("key", "a", "b")


def _own(rows: pa.Table) -> np.ndarray | None:
    return rows.column("own").to_numpy() if rows.column("a")[0] != rows.column("b")[0] else None


def cell_links(cell_rows: DataFrame, radius: int) -> DataFrame:
    """(u, v): for each cell, every node tied to another with the smallest of its ties."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["key", "a", "b"]):
            if len(rows) > 1:
                nodes = rows.column("node").to_numpy()
                labels = link(rows.column("fp").to_numpy().view(np.uint64), radius, _own(rows))
                yield pa.RecordBatch.from_arrays([*map(pa.array, labels.spanning(nodes))], ["u", "v"])

    return _dealt(cell_rows).mapInArrow(work, "u long, v long")


def _named(docs: DataFrame, by: str, nodes: DataFrame, tied: DataFrame) -> DataFrame:
    """docs with component_id: nodes (by, node) names each class of equal rows by its smallest id."""
    named = nodes.join(tied, "node", "left").select(by, F.coalesce("component", "node").alias("component_id"))
    return docs.join(materialize(named, "named"), by, "left")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): fingerprints link at `radius` or fewer differing bits; component_id is the
    smallest doc_id reachable over links, the row's own included. Exact for any number of documents."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "prints")
    every = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct-prints")
    nodes = every.where("node is not null")
    shards = nodes.select(F.explode(shard_keys(F.col("fp"), nodes.count(), radius)).alias("key"), "fp", "node")
    tied = components(cell_links(cells(shards), radius))
    return _named(prints, "fp", nodes, tied)


# Near-duplicates of a stated similarity -----------------------------------------------------------------------------

HASHES, BANDS, BITS = 512, 10, 4
#: Odd multipliers, by a fixed rule; each gives the shingles another order.
ORDERS = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little")) | 1 for i in range(HASHES)], np.uint64)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048, None] * ORDERS).min(axis=0), out=least)
    return least


def similarity_of(differences: np.ndarray) -> np.ndarray:
    """Jaccard similarity estimated from least hashes: equal ones, less those of BITS bits that are so by chance."""
    return 1 - (1 - equal_share(differences)) / (1 - 2.0**-BITS)


def estimated_links(cell_rows: DataFrame, radius: int, similarity: float, margin: float) -> DataFrame:
    """Two kinds of rows. (u, v): nodes tied by pairs whose estimate is above the similarity by the margin. (key, a, b,
    own, u): nodes of a cell that belong to pairs within the margin and not tied by then; their sets must tell."""
    names = ["key", "a", "b", "own", "u", "v"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["key", "a", "b"]):
            if len(rows) < 2:
                continue
            nodes, own = rows.column("node").to_numpy(), _own(rows)
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(nodes), -1)
            unsure: list[tuple[np.ndarray, np.ndarray]] = []

            def accept(x, y, sig=sig, unsure=unsure):
                told = similarity_of(sig[x] ^ sig[y])
                between = (told >= similarity - margin) & (told < similarity + margin)
                unsure.append((x[between], y[between]))
                return told >= similarity + margin

            labels = link(rows.column("fp").to_numpy().view(np.uint64), radius, own, accept)
            u, v = labels.spanning(nodes)
            none = pa.nulls(len(u), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), none, none, pa.nulls(len(u), pa.bool_()), pa.array(u), pa.array(v)], names)
            if unsure:
                x, y = (np.concatenate(side) for side in zip(*unsure))
                apart = labels.of[x] != labels.of[y]
                if apart.any():
                    some = rows.take(pa.array(np.unique(np.concatenate([x[apart], y[apart]]))))
                    yield pa.Table.from_arrays([*(some.column(c) for c in ("key", "a", "b", "own", "node")), pa.nulls(len(some), pa.int64())], names).combine_chunks().to_batches()[0]

    return _dealt(cell_rows).mapInArrow(work, "key long, a int, b int, own boolean, u long, v long")


def exact_links(cell_rows: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(u, v): nodes of each cell tied by pairs whose sets have the similarity. `group` is what is tied already."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["key", "a", "b"]):
            if len(rows) < 2:
                continue
            nodes, groups = rows.column("node").to_numpy(), rows.column("group").to_numpy()
            sets = [np.frombuffer(x, "<u8") for x in rows.column("members").to_pylist()]

            def accept(x, y, sets=sets):
                return np.array([alike(sets[i], sets[j], similarity) for i, j in zip(x.tolist(), y.tolist())], bool)

            labels = link(rows.column("fp").to_numpy().view(np.uint64), radius, _own(rows), accept, groups)
            yield pa.RecordBatch.from_arrays([*map(pa.array, labels.spanning(nodes))], ["u", "v"])

    return _dealt(cell_rows).mapInArrow(work, "u long, v long")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have the Jaccard similarity; sets of no members are equal."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 26, margin: float = 0.09) -> DataFrame:
    """(doc_id, component_id): texts whose sets of word shingles are `similar` (Jaccard) are linked.

    Fingerprints are of the sets too: each shingle counts once, so a line that is repeated in one text does not part
    it from a copy. At 0.8 such fingerprints differ in about 10 bits, in 12 where the sets have 4 and 5 shingles,
    with a standard deviation of 3; the radius is over four of these beyond. That is too many for bit groups; shards
    are therefore the texts that share a pair of least shingles (BANDS pairs: a pair of texts at 0.8 meets with
    probability 0.99996). In a shard the BK-tree finds fingerprints within the radius. Most of these pairs are told
    by the similarity estimated from 512 four-bit least hashes (standard error 0.018 at 0.8): it decides alone where
    it is five standard errors (`margin`) off. What it leaves open is decided by the sets themselves, which are made
    of the texts anew, for open nodes only, and meet in the open cells. Texts with equal sets are one node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            prints, sigs, bands, whole, sizes = [], [], [], [], []
            for t in b.column("text"):
                hashes = np.unique(shingle_hashes(t.as_py(), shingle))
                prints.append(fingerprint(hashes))
                whole.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                sizes.append(8 * len(hashes))
                least = least_hashes(hashes)
                four = ((least >> np.uint64(32)) & np.uint64(15)).astype(np.uint8)
                sigs.append((four[::2] | four[1::2] << 4).tobytes())
                bands.append(((least[: 2 * BANDS : 2] * np.uint64(31)) ^ least[1 : 2 * BANDS : 2]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(np.array(whole, np.uint64).view(np.int64)), pa.array(sizes, pa.int64())], ["doc_id", "fp", "sig", "bands", "whole", "bytes"])

    texts = with_text(docs, id_col, text_col)
    rows = materialize(texts.mapInArrow(work, "doc_id long, fp long, sig binary, bands array<long>, whole long, bytes long"), "sketches")
    nodes = materialize(rows.where("doc_id is not null").groupBy("whole").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("fp", "sig", "bands", "bytes"))), "sketch-nodes")
    shards = nodes.select(F.posexplode("bands").alias("table", "value"), "fp", "node", "sig", "bytes").select(F.xxhash64("table", "value").alias("key"), "fp", "node", "sig", "bytes")
    told = materialize(estimated_links(cells(shards), radius, similarity, margin), "estimated")
    sure, open_ = told.where("key is null").select("u", "v"), told.where("key is not null").select("key", "a", "b", "own", F.col("u").alias("node"))
    tied = components(sure)
    if not open_.isEmpty():
        tied = components(sure.union(_verified(texts, open_, nodes, tied, shingle, radius, similarity)))
    return _named(rows.select("doc_id", "whole"), "whole", nodes.select("whole", "node"), tied).select("doc_id", "component_id")


def _verified(texts: DataFrame, open_: DataFrame, nodes: DataFrame, tied: DataFrame, shingle: int, radius: int, similarity: float) -> DataFrame:
    """(u, v) of the pairs in open cells whose sets are similar. Cells whose nodes are tied by now are left out."""
    groups = open_.join(tied, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    apart = groups.groupBy("key", "a", "b").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key", "a", "b")
    left = materialize(groups.join(apart, ["key", "a", "b"], "left_semi"), "open-cells")
    asked = materialize(left.select("node").distinct().join(nodes.select("node", "whole", "fp"), "node").select(F.col("node").alias("doc_id"), "whole", "fp"), "asked")
    if asked.count() <= FEW:  # then the texts need not be dealt out to find theirs
        asked = F.broadcast(asked)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [np.unique(shingle_hashes(t.as_py(), shingle)).astype("<u8").tobytes() for t in b.column("text")]
            # Of a doc_id's texts only the one that the node stands for.
            mine = np.array([xxhash.xxh64_intdigest(f) for f in found], np.uint64).view(np.int64) == b.column("whole").to_numpy()
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("fp"), pa.array(found, pa.binary())], ["node", "fp", "members"])
            yield out.filter(pa.array(mine))

    members = texts.join(asked, "doc_id").select("doc_id", "text", "whole", "fp").mapInArrow(sets, "node long, fp long, members binary").dropDuplicates(["node"])
    return materialize(exact_links(left.join(materialize(members, "sets"), "node"), radius, similarity), "verified")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, with all their columns, but those near_duplicates() ties to a smaller id. Rows of one id
    stay or go together; a row without id stays."""
    found = near_duplicates(docs, id_col, text_col, **how)
    name = unused(docs, "gone")
    gone = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
