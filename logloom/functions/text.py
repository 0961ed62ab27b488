"""Column expressions of the text codec: escapes, strict parsing, segment names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four escaped characters.
ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))
# What each kind's text may be.
STRICT = {"int": r"\A[+-]?[0-9]+\z", "bool": r"\A(true|false)\z", "float": r"\A[+-]?(inf|infinity|nan|NaN|Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)\z"}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def escape(c: Column) -> Column:
    for plain, escaped in ESCAPES:  # the backslash first
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def has_bad_escape(c: Column) -> Column:
    """A backslash that is followed by none of \\ t n r, reading from the left."""
    return F.regexp_replace(c, r"\\[\\tnr]", "").contains("\\")


def unescape(c: Column) -> Column:
    """Pairs of backslashes are taken out first, as each run of them pairs from its left."""

    def undo(part: Column) -> Column:
        for plain, escaped in ESCAPES[1:]:
            part = F.replace(part, F.lit(escaped), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(c, r"\\\\"), undo), "\\")


def parse(c: Column, kind: str) -> Column:
    """The value of a text; null where it is none of the kind's."""
    if kind in ("id", "text"):
        return F.when(~F.contains(c, F.lit("\\")), c).when(~has_bad_escape(c), unescape(c))  # most texts have no escape
    fine = c.rlike(STRICT[kind])
    if kind == "float":
        low = F.lower(F.regexp_replace(c, r"\A\+", ""))
        special = F.when(low.isin("inf", "infinity"), float("inf")).when(low.isin("-inf", "-infinity"), float("-inf")).when(low.isin("nan", "-nan"), float("nan"))
        return F.when(fine, F.coalesce(special, c.try_cast("double")))
    return F.when(fine, c.try_cast("bigint" if kind == "int" else "boolean"))


def segment_name(number: Column) -> Column:
    """Segment 0 is zzz, the last (46,655) is 000: base 36, counted down."""
    return F.lower(F.lpad(F.conv((F.lit(36**3 - 1) - number).cast("string"), 10, 36), 3, "0"))


def name_of(number: int) -> str:
    """segment_name of one number."""
    left, digits = 36**3 - 1 - number, "0123456789abcdefghijklmnopqrstuvwxyz"
    return digits[left // 1296] + digits[left // 36 % 36] + digits[left % 36]
