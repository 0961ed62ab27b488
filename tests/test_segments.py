from __future__ import annotations

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from logloom import errors as E
from logloom.operators.replay import live
from logloom.schema import TableSchema
from logloom.sources.index import Index, decode_index, encode_index
from logloom.sources.segments import check_preamble, preamble, raw_lines, read_jsonl, read_segments, source_hash, write_segments

TABLE = TableSchema.of("messages", {"body": "text", "created_at": "int", "score": "float", "seen": "bool"}, ["created_at"])
HASH = "0" * 16


def ops(spark, n, size=10):
    return spark.range(1, n + 1).select(F.col("id").alias("tx_id"), F.when(F.col("id") % 5 == 0, "D").otherwise("R").alias("op"), F.concat(F.lit("m"), F.col("id") % 7).alias("id"), F.concat(F.lit("a\tb\n\\"), F.repeat(F.lit("x"), F.lit(size))).alias("body"), F.col("id").alias("created_at"), (F.col("id") / 4).alias("score"), (F.col("id") % 2 == 0).alias("seen"))


def test_round_trip_and_order(spark, tmp_path):
    folder = str(tmp_path / "t")
    log = ops(spark, 200)
    assert write_segments(log, folder, TABLE, HASH, segment_bytes=2000) > 3
    back = read_segments(spark, folder, TABLE)
    names = list(TABLE.fields)
    put = lambda df: sorted(tuple(r) for r in df.where("op = 'R'").select("tx_id", *names).collect())
    assert put(back) == put(log) and back.count() == 200
    whole = live(back, names, [F.asc("chunk"), F.desc("pos")])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, live(log, names).collect()))
    text = (tmp_path / "t" / sorted(os.listdir(folder))[-1]).read_text()
    assert text.startswith("SIX\t1\ttable\tmessages\t") and "@lookup\tid\tunique\n@lookup\tcreated_at\tmany\n@data\nR\t1\tm1\ta\\tb\\n\\\\xxxxxxxxxx\t1\t0.25\tfalse\n" in text


def test_segments_are_as_many_as_the_bytes_need(spark, tmp_path):
    """Not one for each task at least; long lines leave no numbers out; headers are looked at in one job, whatever the files."""
    assert write_segments(ops(spark, 200), str(tmp_path / "small"), TABLE, HASH) == 1 and (tmp_path / "small" / "zzz.6").exists()
    assert write_segments(ops(spark, 0), str(tmp_path / "none"), TABLE, HASH) == 0
    folder, log = str(tmp_path / "long"), ops(spark, 20, size=3000)
    n = write_segments(log, folder, TABLE, HASH, segment_bytes=500)
    names = sorted((x for x in os.listdir(folder) if x.endswith(".6")), reverse=True)
    assert 16 <= n <= 20 and names == [f"zz{c}.6" for c in "zyxwvutsrqponmlkjihg"[:n]]
    found = [int(x.split("\t")[1]) for n in names for x in (tmp_path / "long" / n).read_text().split("@data\n")[1].splitlines()]
    assert found == list(range(1, 21))
    spark.sparkContext.setJobGroup("headers", "headers")
    back = read_segments(spark, folder, TABLE)
    spark.sparkContext.setJobGroup("after", "after")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers")) == 1
    assert back.count() == 20 and back.where("op = 'D'").count() == 4


def test_headers_are_judged_alike(spark, tmp_path):
    """What check_preamble refuses is found among many, carriage returns and other hashes are fine."""
    head, line = preamble(TABLE, "0123456789abcdEF"), "R\t1\tm1\ta\\\\n\\tb\t1\t1\ttrue\n"
    good = {"zzz": head + line, "zzy": head.replace("\n", "\r\n") + line, "zzx": head, "zzw": "", "zzv": "m2\tplain\t1\t1\ttrue\n", "zzu": "\n\n" + line.replace("\n", "\r\r\n")}
    bad = [head.replace("EF", "xy"), head.replace("messages", "other"), head.replace("created_at\tint", "created_at\ttext"), "@field\tid\tid\n" + line, head.replace("@data\n", "")]
    for i, text in enumerate([None, *bad]):
        folder = tmp_path / str(i)
        folder.mkdir()
        for name, body in (good | ({"zyz": text} if text is not None else {})).items():
            (folder / f"{name}.6").write_bytes(body.encode())
        if text is None:
            rows = read_segments(spark, str(folder), TABLE).collect()
            assert sorted((r.chunk, r.id, r.body) for r in rows) == [("zzu", "m1", "a\\n\tb"), ("zzv", "m2", "plain"), ("zzy", "m1", "a\\n\tb"), ("zzz", "m1", "a\\n\tb")]
            continue
        with pytest.raises(E.BadMagic):
            check_preamble(text, TABLE)
        for mode in ("strict", "recover"):
            with pytest.raises(E.BadMagic):
                read_segments(spark, str(folder), TABLE, mode)


def test_torn_tails_and_bad_lines(spark, tmp_path):
    head = preamble(TABLE, HASH)
    good = "R\t1\tm1\thello\t1\t1\ttrue\n"

    def folder(name, body):
        (tmp_path / name).mkdir()
        (tmp_path / name / "zzz.6").write_text(head + body)
        return str(tmp_path / name)

    torn = folder("torn", good + "R\t2\tm2\tpartial body")
    with pytest.raises(E.CorruptData):
        read_segments(spark, torn, TABLE)
    assert read_segments(spark, torn, TABLE, "recover").count() == 1
    for i, line in enumerate(("R\t2\tmissing\n", "R\tx\tm1\thello\t1\t1\ttrue\n", "R\t2\tm1\thel\\qlo\t1\t1\ttrue\n", "R\t2\tm1\thello\t 1\t1\ttrue\n", "R\t2\tm1\thello\t1\t1\tyes\n", "D\t2\tm1\textra\n", "R\t7\n", "D\t7\n")):
        with pytest.raises(PySparkException):
            read_segments(spark, folder(f"bad{i}", good + line), TABLE).collect()
    old = read_segments(spark, folder("old", "m9\thello\t1\tinf\ttrue\r\n\n"), TABLE).collect()
    assert (old[0].tx_id, old[0].op, old[0].score) == (0, "R", float("inf"))


def test_torn_operations_are_no_old_rows(spark, tmp_path):
    pair = TableSchema.of("pairs", {"x": "text"})
    (tmp_path / "zzz.6").write_text("R\t7\n")
    with pytest.raises(PySparkException, match="expected 3, found 2"):
        read_segments(spark, str(tmp_path), pair).collect()


def test_old_segments(spark, tmp_path):
    """Without a preamble, with the line of names, with marks anywhere; the hash goes by the lines as they are."""
    (tmp_path / "zzz.6").write_text("id\tbody\tcreated_at\tscore\tseen\nm1\ta\t1\t1\ttrue\n@later\textra\nR\t5\tm2\tb\t2\t1\tfalse\r\n\n")
    (tmp_path / "zzy.6").write_text("R\t6\tm1\tc\t3\t1\ttrue\nSIX\t1\tx\nD\t7\tm2\n")
    rows = {(r.tx_id, r.op, r.id) for r in read_segments(spark, str(tmp_path), TABLE).collect()}
    assert rows == {(0, "R", "m1"), (5, "R", "m2"), (6, "R", "m1"), (7, "D", "m2")}
    lines = [(r.chunk, r.line) for r in raw_lines(spark, str(tmp_path), TABLE).collect()]
    assert [c for c, _ in lines] == ["zzz", "zzz", "zzy", "zzy"] and lines[1][1].endswith("false\r")
    h = 0xCBF29CE484222325
    for c, line in lines:
        for byte in f"{c}\0{line}\n".encode():
            h = (h ^ byte) * 0x100000001B3 % 2**64
    assert source_hash(lines) == f"{h:016x}" and source_hash([]) == "cbf29ce484222325"


def test_index_codec():
    index = Index("t", "a" * 16, "b" * 16, [("m1", "zzz", 2**40, 7, 2**63), ("é", "zzy", 0, 0, 1)], [("id", "m1", "m1"), ("x", "\t", "é")])
    data = encode_index(index)
    assert data.startswith(b"SIXB\0\x02\0\0\0\x01\0\0\0t") and decode_index(data) == index and index.is_current("t", "a" * 16, "b" * 16)
    for bad in (data[:-1], data + b"x", data[:20], b"", b"nonsense", b"SIXB\tx\tt\ta\tb\n", b"SIXB\t1\tt\ta\tb\nrow\tx\n", b"\xff"):
        with pytest.raises(E.FormatError):
            decode_index(bad)
    old = decode_index(b"SIXB\t1\tt\ta\tb\nrow\tm\\t1\tzzz\t4\t5\t6\n\nlookup\tid\tm1\tm1\n")
    assert old.rows == [("m\t1", "zzz", 4, 5, 6)] and old.lookups == [("id", "m1", "m1")] and not old.is_current("t", "a", "b")


def test_preamble():
    check_preamble(preamble(TABLE, "f" * 16), TABLE)
    check_preamble("m1\told row\t1\t1\ttrue\n", TABLE)
    with pytest.raises(E.BadMagic):
        check_preamble("SIX\t1\ttable\tother\tdeadbeef\n", TABLE)
    with pytest.raises(E.FormatError):
        check_preamble(preamble(TableSchema.of("messages", {"body": "text"}), HASH), TABLE)


def test_empty_folder_and_json(spark, tmp_path):
    assert read_segments(spark, str(tmp_path), TABLE).count() == 0
    (tmp_path / "log.jsonl").write_text('{"_v":1,"_tx":3,"_op":"put","_ts":"x","table":"messages","data":{"id":"a","body":"b","created_at":5,"score":1.0,"seen":true}}\n{"_v":1,"_tx":4,"_op":"delete","table":"messages","data":{"id":"a"}}\n{"_v":1,"_tx":5,"_op":"put","table":"other","data":{"id":"a"}}\n')
    rows = read_jsonl(spark, str(tmp_path / "log.jsonl"), TABLE).orderBy("tx_id").collect()
    assert [(r.tx_id, r.op, r.id, r.body) for r in rows] == [(3, "R", "a", "b"), (4, "D", "a", None)]
