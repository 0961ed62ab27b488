"""Texts of values: lookup keys are compared as texts, so a key is made canonical before it becomes a typed literal."""

from __future__ import annotations

import math
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

INT = re.compile(r"-?(0|[1-9][0-9]*)")


def float_text(value: float) -> str:
    """The shortest digits that give the value back, never with an exponent."""
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "inf" if value > 0 else "-inf"
    text = format(Decimal(repr(value)), "f")
    return text[:-2] if text.endswith(".0") else text


def key_text(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return float_text(value) if isinstance(value, float) else str(value)


def typed_key(kind: str, key: object) -> object | None:
    """The value of the kind whose text is the key's text, or None if no value has it."""
    text = key_text(key)
    if kind in ("id", "text"):
        return text
    if kind == "int":
        return int(text) if INT.fullmatch(text) and text != "-0" and -(2**63) <= int(text) < 2**63 else None
    if kind == "bool":
        return {"true": True, "false": False}.get(text)
    if text in ("NaN", "inf", "-inf"):
        return float(text)
    if not re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", text):
        return None
    value = float(text)
    return value if float_text(value) == text else None


def equals(column: Column, kind: str, key: object) -> Column:
    """column = key by their texts, as a typed comparison that can be pushed down."""
    value = typed_key(kind, key)
    if value is None:
        return F.lit(False)
    if kind == "float" and value == 0:  # 0 and -0 have different texts
        return column.between(0.0, 0.0) & (column.cast("string") == ("-0.0" if key_text(key).startswith("-") else "0.0"))
    return column == F.lit(value)


def text_of(column: Column, kind: str) -> Column:
    """The canonical text of a column's values. Floats: as above for magnitudes that need no exponent on either side,
    by decimals; the rest from Spark's text, expanded."""
    if kind in ("id", "text"):
        return column
    if kind != "float":
        return column.cast("string")
    text = column.cast("string")
    special = F.when(F.isnan(column), "NaN").when(column == float("inf"), "inf").when(column == float("-inf"), "-inf")
    short = F.when(~F.contains(text, F.lit("E")), F.regexp_replace(text, r"\.0$", ""))
    # With an exponent: digits and the place of the point, then zeros on either side. Each step is one variable.
    whole, frac = F.regexp_extract(text, r"([0-9]+)\.", 1), F.regexp_replace(F.regexp_extract(text, r"\.([0-9]+)", 1), "^0$", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    parts = F.struct(F.concat(whole, frac).alias("d"), (F.length(whole) + power).alias("p"))
    left = lambda x: F.when(x["p"] > 0, F.rpad(F.substring(x["d"], F.lit(1), x["p"]), x["p"], "0")).otherwise("0")
    right = lambda x: F.when(x["p"] > 0, F.substring(x["d"], x["p"] + 1, F.length(x["d"]))).otherwise(F.concat(F.repeat(F.lit("0"), -x["p"]), x["d"]))
    point = lambda r: F.when(r == "", r).otherwise(F.concat(F.lit("."), r))
    spelled = F.transform(F.array(parts), lambda x: F.concat(left(x), F.get(F.transform(F.array(right(x)), point), F.lit(0))))
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    return F.coalesce(special, short, F.concat(sign, F.get(spelled, F.lit(0))))
