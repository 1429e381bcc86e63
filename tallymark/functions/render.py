"""Typed values as text, one Column expression for each Spark type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ReconcileError


def plain_double(c: Column) -> Column:
    """Decimal text without an exponent, with at least one fraction digit; NaN and infinities by name."""
    shown = c.cast("double").cast("string")
    parts = r"^(-?)([0-9]+)[.]([0-9]+)E(-?[0-9]+)$"
    sign, whole, fraction, ten = (F.regexp_extract(shown, parts, i) for i in (1, 2, 3, 4))
    e = F.when(ten == "", F.lit(0)).otherwise(ten.try_cast("int"))
    digits = F.concat(whole, F.when(fraction == "0", "").otherwise(fraction))
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(F.lit(0), n))
    large = F.when(F.length(digits) - 1 <= e,
        F.concat(digits, zeros(e - F.length(digits) + 1), F.when(e >= 0, F.lit("")))).otherwise(F.concat(F.left(digits, e + 1), F.lit("."),
        F.right(digits, F.length(digits) - e - 1)))
    small = F.concat(F.lit("0."), zeros(-e - 1), digits)
    return F.when(shown.rlike(parts), F.concat(sign, F.when(e >= 0, large).otherwise(small))).otherwise(shown)


def rendered(c: Column, kind: T.DataType) -> Column:
    """The value's text; null becomes the empty text."""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType, T.IntegralType)):
        out = c.cast("string")
    elif isinstance(kind, T.DecimalType):
        out = c.cast("string")
        tiny = r"^(-?)0E-([0-9]+)$"
        out = F.when(out.rlike(tiny), F.concat(F.lit("0."), F.repeat(F.lit("0"), F.regexp_extract(out, tiny, 2).try_cast("int")))).otherwise(out) if kind.scale > 6 else out
    elif isinstance(kind, T.FractionalType):
        out = plain_double(c)
    elif isinstance(kind, T.BooleanType):
        out = F.when(c, "TRUE").when(~c, "FALSE")
    elif isinstance(kind, T.DateType):
        out = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        micro = F.date_format(c, "SSSSSS")
        out = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micro == "000000", "").when(micro.endswith("000"), F.concat(F.lit("."), F.left(micro, F.lit(3)))).otherwise(F.concat(F.lit("."), micro)))
    elif isinstance(kind, T.NullType):
        out = F.lit("")
    elif type(kind).__name__ == "TimeType":
        out = F.date_format(F.concat(F.lit("2000-01-01 "), c.cast("string")).cast("timestamp"), "HH:mm:ss")
    else:
        raise ReconcileError("INVALID_ARG", f"values of type {kind.simpleString()} can't be compared as text")
    return F.coalesce(out, F.lit(""))
