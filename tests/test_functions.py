import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymark import Dialect, Limits, ReconcileError
from tallymark.functions import normalize, render
from tallymark.functions.declared import parse_type
from tallymark.functions.segments import edit_script, rebuilt, segments
from tallymark.sources import json_rows, strict_csv


def model_decimal(v):
    import re

    if not re.fullmatch(r"[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?", v):
        return None
    mantissa, _, ten = v.lower().partition("e")
    digits = mantissa.lstrip("+-").replace(".", "").lstrip("0")
    if len(digits) > 48 or abs(int(ten or 0)) > 2**31 - 1:
        return None
    if not digits:
        return "0"
    if abs(int(ten or 0)) > 5000:
        return None
    out = format(Decimal(v), "f")
    if "." in out:
        out = out.rstrip("0").rstrip(".")
    return out if len(out) <= 48 else None


def test_canonical_decimal(spark):
    rnd = random.Random(2)
    texts = ["", "+", ".", "-", "0", "-0", "-0.00", "+.5", "5.", "1e5", "1E-3", "1e", "1.2.3", " 1", "1\n", "0e9", "9" * 48, "9" * 49, "1e47", "1e48",
        "0." + "0" * 50 + "1", "." + "1" * 47, "." + "1" * 48, "1e99999999999", "-12.340e2", "١"]
    texts += ["".join(rnd.choice("0123456789..eE+-0000") for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "v string").select("v", normalize.canonical_decimal(F.col("v")).alias("c")).collect()
    assert [(r.v, r.c) for r in got if r.c != model_decimal(r.v)] == []


@pytest.mark.parametrize("v,c", [("12:00:00.500", "12:00:00.5"), ("12:00:00.000", "12:00:00"), ("31.01.2000", "31.01.2"), (".5", ".5"), ("a.5\n", "a.5\n"), ("x", "x"), ("a\nb.10", "a\nb.1")])
def test_canonical_timestamp(spark, v, c):
    assert spark.range(1).select(normalize.canonical_timestamp(F.lit(v))).first()[0] == c


def test_strict_timestamp_boolean_truncation(spark):
    row = spark.range(1).select(
        normalize.canonical_timestamp(F.lit("31.01.2000"), True), normalize.canonical_boolean(F.lit("yes")), normalize.canonical_boolean(F.lit("N")),
            normalize.canonical_boolean(F.lit("ß")), normalize.truncated(F.lit("aé€😀"), 4), normalize.truncated(F.lit("aé€😀"), 6), normalize.truncated(F.lit("aé€😀"), 9),
            normalize.truncated(F.lit("abc"), 9)
    ).first()
    assert list(row) == ["31.01.2000", "1", "0", "ß", "aé", "aé€", "aé€", "abc"]


@pytest.mark.parametrize("text,kind", [("VARCHAR(20)", ("VARCHAR", 20, -1)), ("decimal ( 12 , 2 )", ("DECIMAL", 12, 2)), (" char(3)", ("CHAR", 3, -1)),
    ("WIDGET", ("UNKNOWN", -1, -1)), ("double  precision", ("DECIMAL", -1, -1)), ("VARCHARX(3)", ("UNKNOWN", 3, -1)), ("INT(", ("INTEGER", -1, -1)),
    (None, ("UNKNOWN", -1, -1))])
def test_types(text, kind):
    t = parse_type(text)
    assert (t.kind, t.size, t.scale) == kind


def test_rendering(spark):
    df = spark.sql("SELECT 1.0D a, 1e7D b, 1.5e-5D c, -12345678.9D d, cast(null as int) e, true f, timestamp'2024-01-02 03:04:05.120' g, timestamp'2024-01-02 03:04:05' h, date'2024-01-02' i, cast(0 as decimal(20,10)) j, 1.2345678912e9D k")
    got = df.select(*[render.rendered(F.col(f.name), f.dataType) for f in df.schema.fields]).first()
    assert list(got) == ["1.0", "10000000", "0.000015", "-12345678.9", "", "TRUE", "2024-01-02T03:04:05.120", "2024-01-02T03:04:05", "2024-01-02", "0.0000000000", "1234567891.2"]
    with pytest.raises(ReconcileError):
        render.rendered(F.lit(b"x"), spark.sql("select cast('x' as binary) b").schema[0].dataType)


def parsed(text, **how):
    st = strict_csv.ParseStats()
    data = text if isinstance(text, bytes) else text.encode()
    return [[strict_csv.text_of(v) for v in r] for r in strict_csv.parse(data, how.get("dialect", Dialect()), how.get("limits", Limits()), st)], st


@pytest.mark.parametrize(
    "text,expected",
    [
        ('a,"b,c"\n', [["a", "b,c"]]), ('"a\nb",c\r\nd,e\rf,g', [["a\nb", "c"], ["d", "e"], ["f", "g"]]), ('a"b,c\n', [['a"b', "c"]]), ('"a" \t,b\n', [["a", "b"]]),
            ("a,b\n\n\r\nc,d\n", [["a", "b"], ["c", "d"]]), ('""\nx\n', [[""], ["x"]]),
        ("a,b,", [["a", "b", ""]]), ("﻿a\n", [["a"]]), (' "a",b\n', [[' "a"', "b"]]), ("a,b\nc,d,,\n", [["a", "b"], ["c", "d"]]), ("", []),
        ('"he said ""x"""\n', [['he said "x"']]), (",\n", [["", ""]]),
    ],
)
def test_grammar(text, expected):
    assert parsed(text)[0] == expected


@pytest.mark.parametrize("text,status", [('"a"b,c\n', "BAD_CONTENT"), ('a,"b\n', "UNTERMINATED_QUOTE"), ("a,b\nc\n", "RAGGED_ROW"), ("a,b\nc,d,e\n", "RAGGED_ROW")])
def test_grammar_errors(text, status):
    with pytest.raises(ReconcileError) as e:
        parsed(text)
    assert e.value.status == status


def test_bytes_that_are_not_utf8_come_back():
    rows, _ = parsed(b"caf\xe9,\xff\n")
    assert b",".join(strict_csv.bytes_of(v) for v in rows[0]) == b"caf\xe9,\xff"
    with pytest.raises(ReconcileError):
        strict_csv.sniff(b"  <!DOCTYPE html>")
    with pytest.raises(ReconcileError):
        parsed("abc\n", limits=Limits(max_bytes=2))
    assert parsed("a\t\"b\"\n", dialect=Dialect("\t"))[0] == [["a", "b"]]


def test_quoting_round_trip():
    rnd = random.Random(4)
    for _ in range(500):
        rows = [["".join(rnd.choice('ab,"\n\r é') for _ in range(rnd.randint(0, 6))) for _ in range(3)] for _ in range(4)]
        text = "".join(",".join('"' + v.replace('"', '""') + '"' for v in r) + rnd.choice(["\n", "\r\n"]) for r in rows)
        assert parsed(text)[0] == rows


def test_json_rows():
    assert list(json_rows.parse_rows(' [ {"a":1.50,"b":"x"} , {"b":null,"a":true} ] ', ["a", "b"])) == [["1.50", "x"], ["TRUE", ""]]
    assert list(json_rows.parse_rows("[]", ["a"])) == []
    for bad in ('[{"a":1,"a":2}]', '[{"a":1,"c":2}]', '[{}]', '[{"a":[1]}]', '[{"a":1},]', '[{"a":1}] x', '[{"a":1}', "{}", '[{"a":NaN}]', '[1]'):
        with pytest.raises(ReconcileError):
            list(json_rows.parse_rows(bad, ["a"]))


def test_segments_rebuild_and_are_short():
    rnd = random.Random(6)
    pairs = [("the quick fox", "the slow fox"), ("naïve", "naive"), ("漢字仮名", "漢字名"), ("", "x"), ("abc", "abc"),
        ("a b c", "c b a")] + [("".join(rnd.choice("ab é漢") for _ in range(rnd.randint(0, 30))),
        "".join(rnd.choice("ab é漢") for _ in range(rnd.randint(0, 30)))) for _ in range(400)]
    for s, t in pairs:
        a, b = s.encode(), t.encode()
        for mode in ("word", "character", "both"):
            found = segments(a, b, mode)
            assert (not found) == (a == b)
            if found:
                assert rebuilt(a, b, found) == (a, b)
                for op, x, n in found:
                    (b if op == "INSERT" else a)[x : x + n].decode()
    assert segments(b"the quick fox", b"the slow fox") == [("EQUAL", 0, 4), ("DELETE", 4, 5), ("INSERT", 4, 4), ("EQUAL", 9, 4)]
    assert edit_script([b"a"] * 70, [b"b"] * 70) is None
    assert segments(b"x" * 5000, b"y") == [("DELETE", 0, 5000), ("INSERT", 0, 1)]
