"""Queries that state the rules of the grammar, headers, errors, sources, limits and output one by one, and the SQL that says the same."""

from __future__ import annotations

import gzip
import io
import json
import uuid
import zlib
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .errors import ReconcileError
from .functions import normalize
from .functions.declared import parse_type
from .functions.segments import cell_segments, pieces
from .options import CompareOptions, Dialect, DiffOptions, EmitOptions, HeaderLayout, Limits
from .operators.moves import moved_rows
from .plans.compare import compare
from .plans.header import Header, find_target_header, resolve_source
from .plans.storage import SharedFile, shared_dir
from .registry import HEADERS as COLUMNS
from .registry import P1, P4, P5, P6, POLICY, UNMOVED, diff_of, oracle_pair, query, sides, table
from .sinks import emitters
from .sources import strict_csv
from .sources.tables import Source, numbered, parse_stats, try_parse_column
from .streaming.snapshots import reconcile_stream

#: customers as texts: n the name, k the key; the same SQL in both engines
C = "(SELECT c_custkey, c_name AS n, cast(c_custkey AS string) AS k FROM {customer})"
#: rule, a text, the records that it holds (cells joined by |), the error that ends it
GRAMMAR = [
    ("G1", """'"' || n || ',' || chr(10) || k || '",b'""", ["n || ',' || chr(10) || k || '|b'"], None),
    ("G2", """n || 'a"b,c'""", ["""n || 'a"b|c'"""], None),
    ("G3", """'"' || n || '" ' || chr(9) || ',b'""", ["n || '|b'"], None),
    ("G4", """'a,b' || chr(10) || '"' || n || '"x,b'""", ["'a|b'"], "BAD_CONTENT"),
    ("G5", "n || chr(13) || k || chr(10) || n || chr(13) || chr(10) || k", ["n", "k", "n", "k"], None),
    ("G6", "n || chr(10) || chr(10) || chr(13) || chr(10) || k", ["n", "k"], None),
    ("G7", "n || ','", ["n || '|'"], None),
    ("G8", """n || chr(10) || '"' || k""", ["n"], "UNTERMINATED_QUOTE"),
    ("G8 pair", """'a' || chr(10) || '"b""' || n""", ["'a'"], "UNTERMINATED_QUOTE"),
    ("G9", "'a,b' || chr(10) || n", ["'a|b'"], "RAGGED_ROW"),
    ("G10 empty", "'a,b' || chr(10) || n || ',' || k || ',,'", ["'a|b'", "n || '|' || k"], None),
    ("G10 filled", "'a,b' || chr(10) || n || ',b,c'", ["'a|b'"], "RAGGED_ROW"),
    ("G11", "n || ',b' || chr(10) || k || ',d'", ["n || '|b'", "k || '|d'"], None),
    ("G12", "'﻿' || n", ["n"], None),
    ("G14", "'  ' || n || '  , ' || k", ["'  ' || n || '  | ' || k"], None),
    ("G19", """'"",' || n || ',,'""", ["'|' || n || '||'"], None),
]


def expected(cases, source: str = C.format(customer="customer")) -> str:
    parts = []
    for rule, _, records, status in cases:
        parts += [f"SELECT '{rule}' AS rule, c_custkey, {i} AS rec, NULL AS status, {value} AS value FROM {source}" for i, value in enumerate(records, 1)]
        if status:
            parts.append(f"SELECT '{rule}', c_custkey, NULL, '{status}', NULL FROM {source}")
    return "SELECT rule, c_custkey, rec::BIGINT AS rec, status::VARCHAR AS status, value::VARCHAR AS value FROM (" + " UNION ALL ".join(parts) + ")"


def parsed(spark: SparkSession, sf_dir: str, cases, dialect: Dialect = Dialect(), limits: Limits = Limits()) -> DataFrame:
    rows = spark.sql("SELECT * FROM " + C, customer=table(spark, sf_dir, "customer"))
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism)  # few bytes, so one task reads them all, but a text for each rule
    texts = rows.select("c_custkey", F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.expr(text).alias("text")) for rule, text, _, _ in cases])).alias("x"))
    out = try_parse_column(texts.select("c_custkey", "x.rule", "x.text"), "text", dialect, limits)
    return out.select("rule", "c_custkey", "rec", "status", F.when(F.col("cells").isNotNull(), F.concat_ws("|", "cells")).alias("value"))


@query(expected(GRAMMAR))
def csv_grammar(spark, sf_dir):
    return parsed(spark, sf_dir, GRAMMAR)


DIALECT = [("G15", """'''' || n || ';x'';' || k || '"'""", ["n || ';x|' || k || '\"'"], None), ("G15 tab", "n || chr(9) || k", ["n || chr(9) || k"], None)]


@query(expected(DIALECT))
def csv_dialect(spark, sf_dir):
    return parsed(spark, sf_dir, DIALECT, Dialect(";", "'"))


LIMITED = [
    ("G16 rows", "n || chr(10) || k || chr(10) || n", ["n", "k"], "INVALID_ARG"), ("G16 columns", "n || ',b,c,d'", [], "INVALID_ARG"),
    ("G16 bytes", "repeat(n, 10)", [], "TOO_LARGE"), ("G16 within", "n || ',b' || chr(10) || k || ',d'", ["n || '|b'", "k || '|d'"], None),
]


@query(expected(LIMITED))
def csv_limits(spark, sf_dir):
    return parsed(spark, sf_dir, LIMITED, limits=Limits(max_bytes=100, max_rows=2, max_columns=3))


STATED = """'a,"b"' || chr(10) || '"' || n || '","x""' || chr(10) || '",' || chr(10) || chr(10)"""


@query(f"""SELECT c_custkey, strlen({STATED})::BIGINT AS bytes, 4::BIGINT AS line_feeds, 8::BIGINT AS quotes, 2::BIGINT AS "rows", 4::BIGINT AS fields, 2::BIGINT AS columns, 3::BIGINT AS quoted, 1::BIGINT AS escaped,
 1::BIGINT AS multiline, 1::BIGINT AS ragged_normalized, 1::BIGINT AS blank_lines FROM {C.format(customer="customer")}""")
def csv_statistics(spark, sf_dir):
    rows = spark.sql(f"SELECT c_custkey, {STATED} AS text FROM {C}", customer=table(spark, sf_dir, "customer"))
    return parse_stats(rows, "text").select("c_custkey", "stats.*")


@query("SELECT c_custkey, hex(c_name) || 'E9' AS broken, hex(c_name) || 'F48FBFA9' AS whole, false AS same, NULL::VARCHAR AS status FROM customer")
def non_utf8(spark, sf_dir):
    """A byte that is no UTF-8 and the code point that stands for it are different, and both come back as they went in."""
    raw = lambda tail: F.concat(F.encode("c_name", "UTF-8"), F.unhex(F.lit(tail)))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(raw("E9"), F.unhex(F.lit("2C")), raw("F48FBFA9")).alias("text"))
    a, b = F.col("cells")[0], F.col("cells")[1]
    back = lambda c: F.hex(emitters.restored(c).cast("binary"))
    return try_parse_column(rows, "text").select("c_custkey", back(a).alias("broken"), back(b).alias("whole"), (a == b).alias("same"), "status")


def _written(spark: SparkSession, lines: DataFrame) -> str:
    """The path of one text file in the shared folder."""
    path = f"{shared_dir(spark)}/law-{uuid.uuid4().hex}"
    lines.coalesce(1).write.text(path)
    return path + "/part-*"


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name || ', \"' || c_mktsegment || '\"' AS c_name FROM customer")
def csv_file_scan(spark, sf_dir):
    """A whole file through the strict scan, one task, below a header of four rows."""
    name = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(","), emitters.csv_quoted(name, guard=False))
    head = spark.createDataFrame([(v,) for v in ("KEY,", ",REQUIRED", "INTEGER,VARCHAR(80)", "c_custkey,c_name")], "value string").coalesce(1)
    side = Source.csv(_written(spark, head.union(table(spark, sf_dir, "customer").select(line)))).open(spark, Dialect(), Limits())
    model = resolve_source(side.first, HeaderLayout())
    return side.rows.where(F.col("rec") > model.rows).select(*[F.col(f"v{i}").alias(n) for i, n in enumerate(model.names)])


KINDS = ("bytes", "dataframe", "deflate", "embedded", "fast_csv", "gzip", "json_file", "json_rows", "parquet", "path", "reader", "rows", "stream", "string", "utf_16", "with_header")


@query("SELECT kind, n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation, (VALUES " + ", ".join(f"('{k}')" for k in KINDS) + ") v(kind)")
def sources_agree(spark, sf_dir):
    """Every kind of source opens the same table (a reference table of 25 rows) to the same rows."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name").orderBy(F.col("n_nationkey").cast("int"))
    held = [list(r) for r in rows.collect()]
    body = "".join(f"{a},{strict_csv.quote_field(b)}\n" for a, b in held)
    header, text = Header.names_only("n_nationkey", "n_name"), "n_nationkey,n_name\n" + body
    objects = json.dumps([dict(zip(header.names, r, strict=True)) for r in held])
    file = lambda t: _written(spark, spark.createDataFrame([(t,)], "value string"))
    spot = f"{shared_dir(spark)}/law-{uuid.uuid4().hex}"
    rows.write.parquet(spot)
    packer = zlib.compressobj()
    made = {
        "bytes": Source.bytes(text.encode()), "dataframe": Source.dataframe(rows, header),
        "deflate": Source.bytes(packer.compress(text.encode()) + packer.flush(), "deflate"),
        "embedded": Source.embedded(spark.createDataFrame([(text,)], "value string"), "value"), "fast_csv": Source.fast_csv(file(body), header),
        "gzip": Source.bytes(gzip.compress(text.encode()), "gzip"),
        "json_file": Source.json_file(file(objects), header), "json_rows": Source.json_rows(objects, header), "parquet": Source.parquet(spark, spot, header=header),
        "path": Source.csv(file(text)),
        "reader": Source.reader(io.StringIO(text)), "rows": Source.rows(held, header), "stream": Source.stream(io.BytesIO(text.encode()), size_hint=len(text)),
        "string": Source.string(text),
        "utf_16": Source.reader(io.BytesIO(text.encode("utf-16")), "utf-16"), "with_header": Source.string(body).with_header(header),
    }
    out = None
    for kind in KINDS:
        one = made[kind].open(spark, Dialect(), Limits()).rows.where("rec > 1" if made[kind] not in (made["dataframe"],) else "true")
        one = one.where("v0 <> 'n_nationkey'").select(F.lit(kind).alias("kind"), F.col("v0").alias("n_nationkey"), F.col("v1").alias("n_name"))
        out = one if out is None else out.union(one)
    return out


def _status(attempt) -> str:
    try:
        attempt()
    except ReconcileError as e:
        return e.status
    return "OK"


ERRORS = [
    ("bad gzip", "BAD_CONTENT"), ("column order", "COLUMN_ORDER"), ("date compare", "UNIMPLEMENTED"), ("duplicate key", "DUPLICATE_KEY"), ("empty target", "NO_HEADER"),
        ("equal delimiter and quote", "INVALID_ARG"), ("html page", "BAD_CONTENT"),
    ("inflated too large", "TOO_LARGE"), ("json text", "BAD_CONTENT"), ("long header", "INVALID_ARG"), ("lost key column", "MISSING_KEY_COLUMN"),
        ("missing file", "IO_ERROR"), ("negative size hint", "INVALID_ARG"), ("no key", "MISSING_KEY_COLUMN"),
    ("other names", "NO_HEADER"), ("ragged row", "RAGGED_ROW"), ("several files", "INVALID_ARG"), ("short source", "NO_HEADER"), ("size hint too large", "TOO_LARGE"),
        ("too large", "TOO_LARGE"), ("two widths", "COLUMN_ORDER"),
    ("unclosed quote", "UNTERMINATED_QUOTE"), ("unknown encoding", "INVALID_ARG"), ("usual", "OK"), ("wrong row", "RAGGED_ROW"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ERRORS) + ') v("case", status)')
def error_statuses(spark, sf_dir):
    """The status with which each kind of input that can't be compared is refused, on the nations at hand (a reference table of 25 rows)."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("c_custkey"), F.col("n_name").alias("c_name"))
    key, lines = Header.of(("c_custkey", "INTEGER", True), "c_name"), [f"{a},{b}" for a, b in rows.orderBy("c_custkey").collect()]
    body = "\n".join(lines)
    one = HeaderLayout(rows=1)
    source, head = Source.dataframe(rows, key, ["c_custkey"]), "c_custkey,c_name\n"
    diff = lambda s, t, **o: _status(lambda: compare(spark, s, t, DiffOptions(header=one, detect_moves=False, **o)))
    opened = lambda s, **limits: _status(lambda: s.open(spark, Dialect(), Limits(**limits)))
    few = Source.string("KEY,\n,\nINTEGER,\n" + head + body)
    usual = lambda t, **o: _status(lambda: compare(spark, few, Source.string(t), DiffOptions(**o)))
    lost = CompareOptions(allow_removed_columns=True, allow_added_columns=True)
    parts = f"{shared_dir(spark)}/law-{uuid.uuid4().hex}"
    spark.createDataFrame([("a",), ("b",)], "value string").repartition(2).write.option("maxRecordsPerFile", 1).text(parts)
    got = {
        "bad gzip": opened(Source.bytes(b"no gzip", "gzip")), "column order": usual("c_name,c_custkey\n" + body),
            "date compare": _status(lambda: CompareOptions(date_compare="loose")),
            "duplicate key": diff(source, Source.dataframe(rows.union(rows.where("c_custkey = '5'")), key, ["c_custkey"])),
        "empty target": usual(""), "equal delimiter and quote": _status(lambda: Dialect(",", ",")), "html page": opened(Source.string("<!DOCTYPE html>")),
            "inflated too large": opened(Source.bytes(gzip.compress(b"a" * 10_000), "gzip"), max_bytes=1000),
        "json text": opened(Source.string('{"a": 1}')), "long header": _status(lambda: HeaderLayout(rows=65)),
            "lost key column": usual("c_name,extra\n" + body, compare=lost), "missing file": opened(Source.csv(f"{shared_dir(spark)}/nothing-here.csv")),
        "negative size hint": _status(lambda: Source.stream(io.BytesIO(), -1)),
            "no key": diff(Source.dataframe(rows, Header.names_only("c_custkey", "c_name"), ["c_custkey"]), source, require_key=True),
            "other names": usual("one,two\n" + body), "ragged row": opened(Source.string("a,b\nc")),
        "several files": opened(Source.csv(parts)), "short source": _status(lambda: compare(spark, Source.string("a,b\n"), few)),
            "size hint too large": opened(Source.stream(io.BytesIO(b"a"), 2000), max_bytes=1000), "too large": opened(Source.string(body), max_bytes=10),
        "two widths": usual("c_custkey,c_name,c_custkey\n1,2,3"), "unclosed quote": opened(Source.string('"a')), "unknown encoding": opened(Source.bytes(b"a", "brotli")),
            "usual": usual(head + body), "wrong row": opened(Source.rows([["1"]], key)),
    }
    return spark.createDataFrame(sorted(got.items()), "case string, status string")


HEADERS = [
    ("four rows", "key=0 required=1 names=a,b rows=4"), ("one row", "key= required= names=a,b rows=1"), ("two rows", "key=0 required= names=a,b rows=2"),
        ("three rows", "key=0 required=1 names=a,b rows=3"), ("no rows", "key= required= names=column_1,column_2 rows=0"),
    ("names first", "key=0 required= names=a,b rows=2"), ("target at 1", "rows=1 source=0,1 target=0,1"), ("target at 4", "rows=4 source=0,1 target=0,1"),
        ("blanks around", "rows=1 source=0,1 target=0,1"), ("added", "rows=1 source=0,1 target=0,2"), ("removed", "rows=1 source=0 target=0"),
    ("added not allowed", "COLUMN_ORDER"), ("places changed", "COLUMN_ORDER"), ("no names", "rows=0 source=0,1 target=0,1"), ("too deep", "NO_HEADER"),
        ("built", "key=0 required=1 names=a,b rows=4"), ("unknown key", "INVALID_ARG"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in HEADERS) + ') v("case", found)')
def header_rules(spark, sf_dir):
    said = lambda v: ",".join(map(str, v))

    def model(m) -> str:
        required = [i for i, q in enumerate(m.required) if q]
        return f"key={said(m.key_columns)} required={said(required)} names={said(m.label(i) for i in range(m.width))} rows={m.rows}"

    def target(first, source, *allowed) -> str:
        rows, plan = find_target_header(first, source, *(a in allowed for a in ("added", "removed")))
        return f"rows={rows} source={said(plan.source)} target={said(plan.target)}"

    rows = [["KEY", ""], [" ", "required"], ["INTEGER", "VARCHAR(3)"], ["a", "b"], ["1", "x"]]
    source = resolve_source(rows, HeaderLayout())
    cases = {
        "four rows": lambda: model(source), "one row": lambda: model(resolve_source([["a", "b"]], HeaderLayout(1))),
            "two rows": lambda: model(resolve_source([["key", ""], ["a", "b"]], HeaderLayout(2))),
            "three rows": lambda: model(resolve_source([["KEY", ""], ["", "REQUIRED"], ["a", "b"]], HeaderLayout(3))),
        "no rows": lambda: model(resolve_source([["1", "x"]], HeaderLayout(0))),
            "names first": lambda: model(resolve_source([["a", "b"], ["KEY", ""]], HeaderLayout(2, key=2, name=1))), "target at 1": lambda: target([["a", "b"]], source),
            "target at 4": lambda: target(rows, source),
        "blanks around": lambda: target([[" a", "b\t"]], source), "added": lambda: target([["a", "n", "b"]], source, "added"),
            "removed": lambda: target([["a"]], source, "removed"), "added not allowed": lambda: target([["a", "n", "b"]], source, "removed"),
            "places changed": lambda: target([["b", "a"]], source, "added", "removed"),
        "no names": lambda: target([["1", "x"]], resolve_source([["1", "x"]], HeaderLayout(0))), "too deep": lambda: target([["-", "-"]] * 8 + [["a", "b"]], source),
            "built": lambda: model(Header.builder().column("a", "INTEGER").key().column("b", "VARCHAR(3)").required().build().model()),
        "unknown key": lambda: Header.builder().column("a").keys("z"),
    }

    def found(attempt) -> str:
        try:
            return attempt()
        except ReconcileError as e:
            return e.status

    return spark.createDataFrame([(name, found(attempt)) for name, attempt in cases.items()], "case string, found string")


TYPES = [
    ("VARCHAR(20)", "VARCHAR", 20, -1, True, False), ("char(3)", "CHAR", 3, -1, True, False), (" integer ", "INTEGER", -1, -1, False, True),
        ("INTEGER(4)", "INTEGER", 4, -1, False, True), ("DECIMAL(18,2)", "DECIMAL", 18, 2, False, True), ("NUMERIC(6)", "DECIMAL", 6, -1, False, True),
    ("DATE", "DATE", -1, -1, False, False), ("TIMESTAMP", "TIMESTAMP", -1, -1, False, False), ("BOOLEAN", "BOOLEAN", -1, -1, False, False),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{k}', {s}, {c}, {x}, {n})" for t, k, s, c, x, n in TYPES) + ") v(declared, kind, size, scale, is_text, is_number)")
def declared_types(spark, sf_dir):
    rows = [(t, d.kind, d.size, d.scale, d.text, d.numeric) for t, d in ((t, parse_type(t)) for t, *_ in TYPES)]
    return spark.createDataFrame(rows, "declared string, kind string, size int, scale int, is_text boolean, is_number boolean")


@query("SELECT * FROM (VALUES ('column', 'key', 1, 'b', '', 'KEY'), ('column', 'required', 0, 'a', '', 'REQUIRED'), ('column', 'type', 0, 'a', 'INTEGER', 'DECIMAL')) v(what, part, \"column\", name, source, target)")
def metadata_findings(spark, sf_dir):
    """A target whose marker and type rows say something else than the source's: findings, not errors."""
    s, t = Source.string("KEY,\n,\nINTEGER,DATE\na,b\n1,x\n"), Source.string("KEY,KEY\nREQUIRED,\nDECIMAL,DATE\na,b\n1,x\n")
    found = compare(spark, s, t).schema_findings
    return spark.createDataFrame([("column", f["row"], f["column"], f["name"], f["source"], f["target"]) for f in found], "what string, part string, column int, name string, source string, target string")


@query("SELECT * FROM (VALUES ('different', 1), ('help', 0), ('ingest', 0), ('missing file', 2), ('no such format', 2), ('parse', 0), ('same', 0), ('too large', 2), ('unclosed quote', 2)) v(\"case\", code)")
def cli_exit_codes(spark, sf_dir):
    file = lambda text: _written(spark, spark.createDataFrame([(text,)], "value string"))
    head = "KEY,\n,\nINTEGER,\n" + "a,b\n"
    one, two, bad, none = file(head + "1,x"), file(head + "1,y"), file(head + '"1,x'), f"{shared_dir(spark)}/nothing-here.csv"
    runs = {"same": ["diff", one, one], "different": ["diff", one, two, "--format", "csv"], "missing file": ["diff", one, none], "unclosed quote": ["diff", one, bad],
        "no such format": ["diff", one, two, "--format", "pdf"], "parse": ["parse", one], "ingest": ["ingest", one], "too large": ["diff", one, two, "--max-mb", "0"],
        "help": ["--help"]}
    with _silent():
        return spark.createDataFrame([(name, cli.main(args, spark, io.StringIO())) for name, args in runs.items()], "case string, code int")


class _silent:
    """Without the command line's own messages."""

    def __enter__(self):
        import contextlib

        self.held = contextlib.ExitStack()
        self.held.enter_context(contextlib.redirect_stderr(io.StringIO()))
        self.held.enter_context(contextlib.redirect_stdout(io.StringIO()))

    def __exit__(self, *error):
        self.held.close()


@query(P1 + """SELECT unnest(['matching        by key', 'columns         6 compared', 'unchanged       ' || count(*) FILTER (kind = 'unchanged'), 'modified        ' || count(*) FILTER (kind = 'modified') || '  (' || sum(nc) || ' cells)',
 'added           ' || count(*) FILTER (kind = 'added'), 'deleted         ' || count(*) FILTER (kind = 'deleted'), 'moved           0', 'suppressed      ' || sum(np) || ' cells differ only in formatting',
 'findings        ' || sum(nf) || ' cells in ' || sum(nf) || ' rows (' || sum(nf) || ' required empty, 0 too long, 0 not numeric, 0 out of precision)', 'report rows     ' || count(*)]) AS line FROM d""")
def human_counts(spark, sf_dir):
    """EM12: the command line's counts."""
    text = cli.counts_text(diff_of(spark, sf_dir, "orders", UNMOVED).summary)
    return spark.createDataFrame([(x,) for x in text.splitlines()], "line string")


@query(P6 + " SELECT k AS key, 0 AS line, CASE WHEN c THEN 'modified' ELSE 'unchanged' END AS role, CASE WHEN c THEN '~' ELSE ' ' END AS marker, tr AS number, t1 AS text, CASE WHEN c THEN s1 END AS old FROM d")
def presentation_inline(spark, sf_dir):
    return _presented(spark, sf_dir, "inline")


@query(P6 + " SELECT k AS key, 0 AS line, CASE WHEN c THEN 'modified' ELSE 'unchanged' END AS role, CASE WHEN c THEN '~' ELSE ' ' END AS marker, tr AS number, t1 AS text, NULL::VARCHAR AS old FROM d UNION ALL SELECT NULL, 1, 'modified', '~', sr, s1, NULL FROM d WHERE c")
def presentation_stacked(spark, sf_dir):
    return _presented(spark, sf_dir, "stacked")


def _presented(spark, sf_dir, layout: str) -> DataFrame:
    p = diff_of(spark, sf_dir, "customer", POLICY).present(layout)
    return p.select(F.when(F.col("line") == 0, F.col("cells")[0]["text"]).alias("key"), "line", "role", "marker", "number", F.col("cells")[1]["text"].alias("text"), F.col("cells")[1]["old"].alias("old"))


@query(P1 + """SELECT report_pos, '{"schemaVersion":1,"kind":"' || kind || '","sourceRow":' || coalesce(sr::VARCHAR, 'null') || ',"targetRow":' || coalesce(tr::VARCHAR, 'null') || ',"moved":false,"moveDistance":0'
 || CASE WHEN nf > 0 THEN ',"findings":[{"column":5,"name":"o_orderpriority","kind":"requiredEmpty"}]' ELSE '' END || '}' AS value FROM p WHERE report_pos < 123""")
def emit_max_rows(spark, sf_dir):
    """LIM1: the first rows of the report; the limit is the feature."""
    return diff_of(spark, sf_dir, "orders", UNMOVED).emit("jsonl", EmitOptions(max_rows=123, include_values=False)).where("part = 1").select("report_pos", "value")


@query("""SELECT c_custkey, left(c_name, 7) AS cut, c_name AS whole, repeat('é', 3) || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'x' END AS parted FROM customer""")
def truncated_values(spark, sf_dir):
    """LIM2, NORM11: at most so many bytes, and no character in part."""
    odd = F.concat(F.repeat(F.lit("é"), F.lit(3)), F.when(F.col("c_custkey") % 2 == 0, "é").otherwise("xé"))
    return table(spark, sf_dir, "customer").select("c_custkey", normalize.truncated(F.col("c_name"), 7).alias("cut"),
        normalize.truncated(F.col("c_name"), 1000).alias("whole"), normalize.truncated(odd, 7).alias("parted"))


LOWER = "value"
for _code in (11, 14, 15, 26, 27, 28, 29, 30, 31):  # the reports write hexadecimal digits in lower case
    LOWER = f"replace({LOWER}, 'u{_code:04X}', 'u{_code:04x}')"


@query(f"SELECT c_custkey, {LOWER} AS value FROM (SELECT c_custkey, substr(to_json(v), 2, length(to_json(v)) - 2) AS value FROM (SELECT c_custkey, c_name || chr((1 + c_custkey % 127)::INT) || '\"' || chr(92) || chr(10) || chr(9) || chr(13) || chr(8) || chr(12) || 'é' AS v FROM customer))")
def json_escape(spark, sf_dir):
    tail = F.lit('"\\\n\t\r\b\f' + "é")
    return table(spark, sf_dir, "customer").select("c_custkey", emitters.json_escaped(F.concat("c_name", F.expr("chr(1 + c_custkey % 127)"), tail)).alias("value"))


CELL = "'<td class=\"px-cell' || CASE WHEN {c} THEN ' px-changed' ELSE '' END || '\">' || CASE WHEN {c} THEN '<span class=\"px-old\">' || {old} || '</span><span class=\"px-new\">' || {new} || '</span>' ELSE {new} END || '</td>'"


def _html_oracle(old: str, new: str) -> str:
    cells = " || ".join([CELL.format(c="false", old="''", new=v) for v in ("t.p_partkey", "t.p_name", "t.p_brand", "t.p_type")] + [CELL.format(c="s.p_size <> t.p_size",
        old=old, new=new), CELL.format(c="false", old="''", new="t.p_retailprice")])
    return f"WITH {oracle_pair('part')} SELECT t.r AS target_row, '<tr class=\"px-row px-' || CASE WHEN s.p_size <> t.p_size THEN 'modified' ELSE 'unchanged' END || '\"><td class=\"px-num\">' || t.r || '</td>' || {cells} || '</tr>' AS value FROM s JOIN t USING (p_partkey)"


def _html(spark, sf_dir, cell_diff: str) -> DataFrame:
    keyed = Header([(n, t, i == 0, q) for i, (n, t, _, q) in enumerate(COLUMNS["part"].columns)])
    s, t = sides(spark, sf_dir, "part")
    diff = compare(spark, Source.dataframe(s, keyed, ["ord"]), Source.dataframe(t, keyed, ["ord"]), replace(UNMOVED, validate=False))
    return diff.emit("html", EmitOptions(class_prefix="px", cell_diff=cell_diff)).where("part = 1").select((F.col("report_pos") + 5).alias("target_row"), "value")


@query(_html_oracle("s.p_size", "t.p_size"))
def emit_html_cells(spark, sf_dir):
    return _html(spark, sf_dir, "none")


@query(_html_oracle("'<del class=\"px-del\">' || s.p_size || '</del>'", "CASE WHEN s.p_size <> t.p_size THEN '<ins class=\"px-ins\">' || t.p_size || '</ins>' ELSE t.p_size END"))
def emit_html_marked(spark, sf_dir):
    return _html(spark, sf_dir, "word")


@query(P1 + "SELECT x AS after, (SELECT min(report_pos) FROM p WHERE report_pos > x AND report_pos <= x + 1000 AND kind <> 'unchanged') AS found FROM (SELECT unnest([-1, 0, 100, 5000]) AS x)")
def next_change(spark, sf_dir):
    diff = diff_of(spark, sf_dir, "orders", UNMOVED)
    return spark.createDataFrame([(x, diff.find_next_change(x, 1000)) for x in (-1, 0, 100, 5000)], "after int, found long")


#: a word between two others is changed, so what stays, goes and comes is known: in words whole, in characters from the first difference on
P7 = """(SELECT c_custkey, strlen(c_name) AS a, c_name || ' xab ' || c_mktsegment AS source, c_name || ' xcb ' || c_mktsegment AS target, strlen(c_mktsegment) AS z FROM customer)"""


def _segments_oracle(mode: str) -> str:
    cut, size = ("(a + 1)", 3) if mode == "word" else ("(a + 2)", 1)
    return " UNION ALL ".join([
        f"SELECT c_custkey, 0 AS n, 'EQUAL' AS op, 0 AS start, ({cut})::INT AS len, source[1:{cut}] AS text FROM {P7}",
            f"SELECT c_custkey, 1, 'DELETE', ({cut})::INT, {size}, '{'xab' if mode == 'word' else 'a'}' FROM {P7}",
        f"SELECT c_custkey, 2, 'INSERT', ({cut})::INT, {size}, '{'xcb' if mode == 'word' else 'c'}' FROM {P7}",
            f"SELECT c_custkey, 3, 'EQUAL', ({cut} + {size})::INT, (strlen(source) - {cut} - {size})::INT, source[{cut} + {size} + 1:] FROM {P7}",
    ])


def _segments(spark, sf_dir, mode: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", *[F.concat("c_name", F.lit(f" {w} "), "c_mktsegment").alias(n) for n, w in (("source", "xab"), ("target", "xcb"))])
    rows = rows.withColumn("found", cell_segments(F.col("source"), F.col("target"), mode)).withColumn("texts", pieces(F.col("source"), F.col("target"), F.col("found")))
    return rows.select("c_custkey", F.posexplode(F.arrays_zip("found", "texts")).alias("n", "g")).select("c_custkey", "n", "g.found.op", "g.found.start", "g.found.len", "g.texts.text")


@query(_segments_oracle("word"))
def segments_word(spark, sf_dir):
    """SEG2 to SEG6, SEG9: the exact segments and their texts."""
    return _segments(spark, sf_dir, "word")


@query(_segments_oracle("character"))
def segments_character(spark, sf_dir):
    return _segments(spark, sf_dir, "character")


@query(_segments_oracle("character"))
def segments_refined(spark, sf_dir):
    """Word by word first, and inside the changed word by character."""
    return _segments(spark, sf_dir, "both")


@query(P1 + "SELECT row_number() OVER (ORDER BY tr NULLS LAST, sr) - 1 AS report_pos, k AS o_orderkey, kind, false AS moved FROM d")
def unordered_report(spark, sf_dir):
    """WIN6: without an order of the source no move is looked for and deletions stand at the end."""
    rows = diff_of(spark, sf_dir, "orders", DiffOptions(source_ordered=False)).ordered_rows()
    return rows.select("report_pos", F.coalesce("t0", "s0").alias("o_orderkey"), "kind", "moved")


@query("SELECT event_id, v, v AS timestamp, v AS boolean, v AS strict FROM (SELECT event_id, CASE event_id % 2 WHEN 0 THEN '\"12:00:01.500' ELSE 'YES\"' END AS v FROM events)")
def embedded_quotes(spark, sf_dir):
    """NORM5: a value that holds a quote is compared as it is."""
    v = F.when(F.col("event_id") % 2 == 0, '"12:00:01.500').otherwise('YES"')
    return table(spark, sf_dir, "events").select("event_id", v.alias("v"), normalize.canonical_timestamp(v).alias("timestamp"),
        normalize.canonical_boolean(v).alias("boolean"), normalize.canonical_timestamp(v, True).alias("strict"))


@query(P6 + " SELECT k AS key, s1 AS source, t1 AS target FROM d WHERE c AND s1 LIKE '%1'")
def own_comparator(spark, sf_dir):
    """A column compared in a form of the caller's own: here in lower case, but for names that end with 1."""
    options = replace(POLICY, compare=replace(POLICY.compare, comparators={"c_name": lambda c: F.when(c.endswith("1"), c).otherwise(F.lower(c))}))
    return diff_of(spark, sf_dir, "customer", options).cells().select("key", "source", "target")


@query(P5 + " SELECT count(*) AS changed, count(*) FILTER (source <> '') AS filled FROM d")
def changed_count(spark, sf_dir):
    return diff_of(spark, sf_dir, "conversations", UNMOVED).cells().agg(F.count("*").alias("changed"), F.count(F.when(F.col("source") != "", 1)).alias("filled"))


@query(P1 + """SELECT value FROM (SELECT '{"schemaVersion":1,"kind":"' || kind || '","sourceRow":' || coalesce(sr::VARCHAR, 'null') || ',"targetRow":' || coalesce(tr::VARCHAR, 'null') || ',"moved":false,"moveDistance":0' || CASE WHEN nf > 0 THEN ',"findings":[{"column":5,"name":"o_orderpriority","kind":"requiredEmpty"}]' ELSE '' END || '}' AS value FROM p)""")
def written_report(spark, sf_dir):
    """EM10: a report written as files, and read back."""
    path = f"{shared_dir(spark)}/law-{uuid.uuid4().hex}"
    diff_of(spark, sf_dir, "orders", UNMOVED).write(path, "jsonl", EmitOptions(include_values=False))
    return spark.read.text(path)


@query(P1 + "SELECT kind, count(*) AS n FROM d GROUP BY kind UNION ALL SELECT 'report', count(*) FROM d")
def summary_read(spark, sf_dir):
    """SRC22: a summary's text read again."""
    text = diff_of(spark, sf_dir, "orders", UNMOVED).emit("summary").first().value
    rows = emitters.read_summary(text)["rows"]
    return spark.createDataFrame([(k, v) for k, v in rows.items() if v], "kind string, n long")


@query(f"WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS s_idx, count(*) OVER () AS n FROM orders) SELECT s_idx AS t_idx, 0::BIGINT AS d FROM s WHERE false UNION ALL SELECT 0, -(n - 1) FROM s WHERE s_idx = n - 1 UNION ALL SELECT n - 1, n - 1 FROM s WHERE s_idx = 0")
def dragged_rows(spark, sf_dir):
    """WIN2, WIN3: the first row dragged to the end and the last to the front: two moved rows, all others stay."""
    rows = numbered(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "s_idx", first=0).select("s_idx")
    last = rows.agg(F.max("s_idx")).first()[0]
    at = F.when(F.col("s_idx") == 0, last).when(F.col("s_idx") == last, 0).otherwise(F.col("s_idx"))
    found = moved_rows(rows.select("s_idx", at.alias("t_idx")))
    return found.select("t_idx", F.col("move_distance").alias("d"))


def _cell_rows() -> str:
    cells = [("o_orderkey", "CASE WHEN sr IS NOT NULL THEN k END", "CASE WHEN tr IS NOT NULL THEN k END", "false", "false"), ("o_custkey", "s1", "t1", "false", "false"),
        ("o_orderstatus", "s2", "t2", "false", "p2"), ("o_totalprice", "s3", "t3", "c3", "p3"), ("o_orderdate", "s4", "t4", "false", "false"),
        ("o_orderpriority", "s5", "t5", "c5", "false")]
    return " UNION ALL ".join(
        f"SELECT report_pos, kind, sr AS source_row, tr AS target_row, {i} AS \"column\", '{name}' AS name, CASE WHEN tr IS NULL OR {c} OR {p} THEN {s} END AS source, CASE WHEN tr IS NOT NULL THEN {t} END AS target, {c} AS changed, {p} AS suppressed FROM p" for i, (name, s, t, c, p) in enumerate(cells)
    )


@query(P1 + _cell_rows())
def report_cells(spark, sf_dir):
    """EM11: the typed report, every cell of it."""
    rows = diff_of(spark, sf_dir, "orders", UNMOVED).report()
    cells = rows.select("report_pos", "kind", "source_row", "target_row", F.explode("cells").alias("c"))
    return cells.select("report_pos", "kind", "source_row", "target_row", "c.column", "c.name", "c.source", "c.target", "c.changed", "c.suppressed")


@query("SELECT 'column_2' AS name, n_name AS source, lower(n_name) AS target FROM nation WHERE n_nationkey % 5 = 0")
def nameless_columns(spark, sf_dir):
    """HDR8, EM9: files without a name row; columns are called by their places, and rows matched by content and likeness."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name").orderBy("k").collect()  # a reference table of 25 rows
    body = lambda change: "".join(f"{r.k},{strict_csv.quote_field(change(r))}\n" for r in rows)
    one, two = body(lambda r: r.n_name), body(lambda r: r.n_name.lower() if r.k % 5 == 0 else r.n_name)
    return compare(spark, Source.string(one), Source.string(two), DiffOptions(header=HeaderLayout(rows=0))).cells().select("name", "source", "target")


META_LINE = "'1,' || kind || ',{side},false,0,' || coalesce(sr::VARCHAR, '') || ',' || coalesce(tr::VARCHAR, '') || ',' || nc || ',' || nf"


@query(P1 + f"""SELECT '{",".join(emitters.META)}' AS line UNION ALL SELECT {META_LINE.format(side="source")} FROM p WHERE kind IN ('modified', 'deleted') UNION ALL SELECT {META_LINE.format(side="target")} FROM p WHERE kind <> 'deleted'""")
def streamed_report(spark, sf_dir):
    """EM14: a report written to a stream on the driver, a partition at a time."""
    path = f"{shared_dir(spark)}/law-{uuid.uuid4().hex}"
    with SharedFile(spark, path) as out:
        size = emitters.emit_to(diff_of(spark, sf_dir, "orders", UNMOVED), out, "csv", EmitOptions(include_values=False))
    lines = spark.read.text(path, lineSep="\n").select(F.col("value").alias("line"))
    return lines if size == out.length() else lines.where(F.lit(False))


@query("""SELECT sum(strlen(c_custkey::VARCHAR) + strlen(c_name) + 4)::BIGINT AS bytes, count(*)::BIGINT AS line_feeds, 2 * count(*)::BIGINT AS quotes, count(*)::BIGINT AS "rows", 2 * count(*)::BIGINT AS fields, 2::BIGINT AS columns, count(*)::BIGINT AS quoted, true AS same FROM customer""")
def ingest_reports(spark, sf_dir):
    """SRC1, EM15: what the command line says of a file, of its bytes and of its records."""
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit('"'))
    file, said = _written(spark, table(spark, sf_dir, "customer").select(line)), {}
    for command in ("ingest", "parse"):
        out = io.StringIO()
        cli.main([command, file], spark, out)
        said[command] = json.loads(out.getvalue())
    names = ("bytes", "line_feeds", "quotes", "rows", "fields", "columns", "quoted")
    same = all(said["ingest"][n] == said["parse"][n] for n in names[:3])
    return spark.createDataFrame([(*(said["parse"][n] for n in names), same)], ", ".join(f"{n} long" for n in names) + ", same boolean")


@query(P4 + " SELECT k AS event_id, CASE WHEN tr IS NULL THEN 'deleted' WHEN c1 OR c4 THEN 'modified' ELSE 'unchanged' END AS kind, (c1::INT + c4::INT)::BIGINT AS changed_cells FROM d")
def streamed_snapshot(spark, sf_dir):
    """A stream of rows, taken as it stands in one micro-batch, against the table's snapshot."""
    s, t = sides(spark, sf_dir, "events")
    spot = f"{shared_dir(spark)}/law-{uuid.uuid4().hex}"
    t.write.parquet(spot + "/in")
    open_rows = lambda rows: Source.dataframe(rows, COLUMNS["events"], ["ord"])

    def keep(diff, number: int) -> None:
        diff.classified.select(F.coalesce("t0", "s0").alias("event_id"), "kind", F.col("changed_cells").cast("long").alias("changed_cells")).write.parquet(f"{spot}/out{number}")

    reconcile_stream(spark.readStream.schema(t.schema).parquet(spot + "/in"), lambda: open_rows(s), open_rows, keep, spot + "/checkpoint", UNMOVED).awaitTermination()
    return spark.read.parquet(f"{spot}/out0")
