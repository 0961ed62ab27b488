from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from logloom.functions.text import escape, has_bad_escape, parse, segment_name, unescape
from logloom.functions.values import equals, float_text, text_of, typed_key

FLOATS = [0.0, -0.0, 1.0, -1.5, 1e20, 1.5e-7, 123456.789, 1e22, 5e-324, 1.7976931348623157e308, 0.1, 100.0, 12345678.9, math.inf, -math.inf, math.nan]


def test_float_text():
    assert [float_text(x) for x in (1.0, 1e20, -0.0, math.nan, math.inf, 1.5e-7)] == ["1", "100000000000000000000", "-0", "NaN", "inf", "0.00000015"]


def test_float_text_in_columns(spark):
    rows = spark.createDataFrame([(x,) for x in FLOATS], "x double").select("x", text_of(F.col("x"), "float").alias("t")).collect()
    for r in rows:
        if r.x != 5e-324:  # the JVM gives more digits than needed here
            assert r.t == float_text(r.x), r
        assert repr(float(r.t)) == repr(r.x)


def test_typed_key():
    assert typed_key("int", "42") == 42 and typed_key("int", 42) == 42
    for bad in ("042", "+42", " 42 ", "4.0", "", "-0", "9223372036854775808"):
        assert typed_key("int", bad) is None
    assert typed_key("bool", True) is True and typed_key("bool", "TRUE") is None
    assert typed_key("float", "1") == 1.0 and typed_key("float", "1.0") is None and typed_key("float", "1e3") is None


def test_zeros_are_different_keys(spark):
    rows = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "x double")
    assert [str(r.x) for r in rows.where(equals(F.col("x"), "float", "0")).collect()] == ["0.0"]
    assert [str(r.x) for r in rows.where(equals(F.col("x"), "float", "-0")).collect()] == ["-0.0"]


def test_escape_round_trip(spark):
    texts = ["", "a\tb", "a\nb\r", "\\", "\\\\", "\\t", "\\\\t\\\t\n", "x\\n\ny", "é\U0001f600\\", "\\r\\\r"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e")).select("t", "e", unescape(F.col("e")).alias("u"), has_bad_escape(F.col("e")).alias("b")).collect()
    for r in rows:
        assert r.u == r.t and not r.b and not set("\t\n\r") & set(r.e)
    bad = spark.createDataFrame([("\\x",), ("a\\",), ("\\\\\\",)], "t string").select(has_bad_escape(F.col("t")).alias("b")).collect()
    assert all(r.b for r in bad)


@pytest.mark.parametrize("kind, good, bad", [("int", ["1", "+1", "-01"], [" 1", "1 ", "1.0", "x", ""]), ("bool", ["true", "false"], ["TRUE", "t", "1", "yes"]), ("float", ["1", "1e3", "inf", "NaN", "-.5", "1."], [" 1", "1d", "1f", "", "."])])
def test_strict_parse(spark, kind, good, bad):
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", parse(F.col("t"), kind).alias("v")).collect()
    assert [r.v is not None for r in rows] == [True] * len(good) + [False] * len(bad)


def test_segment_names(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (46655,)], "n long").select(segment_name(F.col("n")).alias("s")).collect()
    assert [r.s for r in rows] == ["zzz", "zzy", "zzx", "000"]
