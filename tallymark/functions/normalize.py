"""The form in which cells are compared, as Column expressions. No cell is ever null here: an absent value is the empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import CompareOptions
from .declared import DeclaredType

PAD = " \t"
MOST_DIGITS = 48
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def trimmed(v: Column) -> Column:
    """Without spaces and tabs at both ends; other white space is data."""
    return F.btrim(v, F.lit(PAD))


def unpadded(v: Column) -> Column:
    return F.rtrim(v, F.lit(PAD))


def ascii_upper(v: Column) -> Column:
    return F.translate(v, LOWER, UPPER)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once. Higher-order functions aren't compiled, so this is for rare cases only."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scientific(v: Column) -> Column:
    """Plain text of a number with an exponent or very many digits; null where that gets too long."""
    mantissa = r"^[+-]?([0-9]*)[.]?([0-9]*)"
    zeros = lambda k: F.repeat(F.lit("0"), F.greatest(F.lit(0), F.least(k, F.lit(60))).cast("int"))
    ten = F.regexp_extract(v, r"[eE]([+-]?[0-9]+)\z", 1)
    fraction = F.regexp_extract(v, mantissa, 2)
    read = F.struct(
        F.ltrim(F.concat(F.regexp_extract(v, mantissa, 1), fraction), F.lit("0")).alias("led"),
        (F.when(ten == "", F.lit(0)).otherwise(ten.try_cast("int")).cast("long") - F.length(fraction)).alias("unit"),
        v.startswith("-").alias("negative"),
    )

    def with_digits(p: Column) -> Column:
        digits = F.rtrim(p["led"], F.lit("0"))
        shift = p["unit"] + F.length(p["led"]) - F.length(digits)
        return F.struct(digits.alias("d"), shift.alias("shift"), F.length(digits).alias("n"), p["negative"].alias("negative"), ((F.length(p["led"]) <= MOST_DIGITS) & p["unit"].isNotNull()).alias("able"))

    def plain(p: Column) -> Column:
        cut = (p["n"] + p["shift"]).cast("int")
        inside = F.concat(F.left(p["d"], cut), F.lit("."), F.right(p["d"], p["n"] - cut))
        out = F.when(p["shift"] >= 0, F.concat(p["d"], zeros(p["shift"]))).when(cut > 0, inside).otherwise(F.concat(F.lit("0."), zeros(-p["shift"] - p["n"]), p["d"]))
        signed = F.concat(F.when(p["negative"], "-").otherwise(""), out)
        return F.when(~p["able"], F.lit(None)).when(p["d"] == "", F.lit("0")).otherwise(signed)

    return _let(_let(_let(read, with_digits), plain), lambda out: F.when(F.length(out) <= MOST_DIGITS, out))


def canonical_decimal(v: Column) -> Column:
    """Plain decimal text without redundant zeros, sign or exponent; null if ``v`` is no number, has over 48 significant digits, or gets longer than 48 characters."""
    number = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)"
    # sign, digits before the point without leading zeros, digits behind it without trailing ones
    parts = F.regexp_replace(v, r"^[+]?(-?)0*([0-9]*)(?:[.]([0-9]*?)0*)?\z", "$1$2.$3")
    short = F.rtrim(F.regexp_replace(parts, r"^(-?)[.]", "$10."), F.lit("."))
    plain = v.rlike(number + r"\z") & (F.length(v) < MOST_DIGITS)
    return F.when(plain, F.regexp_replace(short, r"^-0\z", "0")).when(v.rlike(number + r"([eE][+-]?[0-9]+)?\z"), _scientific(v))


def canonical_timestamp(v: Column, strict: bool = False) -> Column:
    """Trailing zeros of a fraction go, and the dot if nothing is left behind it. A fraction is any digits after a last dot (after a colon, if ``strict``)."""
    fits = v.rlike(r"(?s)^.*:[^.]*[.][0-9]+\z" if strict else r"(?s)^.+[.][0-9]+\z") & (F.octet_length(v) <= MOST_DIGITS) & ~v.contains('"')
    return F.when(fits, F.rtrim(F.rtrim(v, F.lit("0")), F.lit("."))).otherwise(v)


def canonical_boolean(v: Column, true_words: str = CompareOptions.true_words, false_words: str = CompareOptions.false_words) -> Column:
    """1 or 0 for the words of the two lists (A-Z folded, the first list wins), anything else as it is."""
    fold = lambda words: [w.strip(PAD).translate(str.maketrans(LOWER, UPPER)) for w in words.split(",") if w.strip(PAD)]
    word = ascii_upper(v)
    plain = ~v.contains('"')
    return F.when(plain & word.isin(fold(true_words)), F.lit("1")).when(plain & word.isin(fold(false_words)), F.lit("0")).otherwise(v)


def normalized(v: Column, declared: DeclaredType, options: CompareOptions, name: str = "") -> Column:
    """What two cells must share to be equal."""
    out = trimmed(v) if options.trim else v
    if not options.trim and options.char_ignore_pad and declared.kind == "CHAR":
        out = unpadded(v)
    if name in options.comparators:
        return F.coalesce(options.comparators[name](out), F.lit(""))
    if declared.numeric and options.numeric:
        return F.coalesce(canonical_decimal(out), out)
    if declared.kind == "BOOLEAN" and options.booleans:
        return canonical_boolean(out, options.true_words, options.false_words)
    if declared.kind == "TIMESTAMP":
        return canonical_timestamp(out, options.timestamp_strict)
    return out


def integer_digits(c: Column) -> Column:
    """Digits before the point of a canonical decimal; the 0 of 0.5 counts."""
    return F.length(F.split_part(F.ltrim(c, F.lit("-")), F.lit("."), F.lit(1)))


def fraction_digits(c: Column) -> Column:
    return F.length(F.split_part(c, F.lit("."), F.lit(2)))


def truncated(v: Column, most: int) -> Column:
    """The longest run of whole characters from the start within ``most`` bytes."""
    part = F.substring(F.encode(v, "UTF-8"), 1, most)
    # a cut character leaves a lead byte with too few continuation bytes behind it
    tail = F.expr("0")
    for back in (1, 2, 3):
        lead = F.conv(F.hex(F.substring(part, -back, 1)), 16, 10).cast("int")
        need = F.when(lead >= 240, 4).when(lead >= 224, 3).when(lead >= 192, 2).otherwise(1)
        tail = F.when((lead >= 192) & (need > back) & (F.length(part) >= back), F.lit(back)).otherwise(tail)
    kept = F.substring(part, F.lit(1), F.length(part) - tail)
    return F.when(F.octet_length(v) <= most, v).otherwise(F.decode(kept, "UTF-8"))
