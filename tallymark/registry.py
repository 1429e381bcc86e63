"""Queries that show each operator on the driver's tables, and the SQL that says the same.

Both sides of a pair are derived by one SQL text, run by Spark here and by DuckDB in the oracle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import normalize, render
from .functions.segments import slice_bytes
from .operators import match, report
from .options import CompareOptions, DiffOptions, EmitOptions
from .plans.compare import Diff, compare
from .plans.header import Header
from .sinks import emitters
from .sources.tables import Source, parse_column

#: name -> (source SQL, target SQL); tables in braces
PAIRS = {
    "orders": (
        """SELECT o_orderkey * 2 AS ord, cast(o_orderkey AS string) AS o_orderkey, cast(o_custkey AS string) AS o_custkey, o_orderstatus,
 cast(cast(o_totalprice AS decimal(18,2)) AS string) AS o_totalprice, cast(cast(o_orderdate AS date) AS string) AS o_orderdate, o_orderpriority FROM {orders}""",
        """SELECT CASE WHEN o_orderkey % 997 = 500 THEN o_orderkey - 100000000 ELSE o_orderkey * 2 END AS ord, cast(o_orderkey AS string) AS o_orderkey,
 cast(o_custkey AS string) AS o_custkey, CASE WHEN o_orderkey % 60 = 11 THEN concat(' ', o_orderstatus, ' ') ELSE o_orderstatus END AS o_orderstatus,
 CASE WHEN o_orderkey % 50 = 3 THEN cast(cast(o_totalprice AS decimal(18,2)) + 1.50 AS string)
 WHEN o_orderkey % 40 = 5 THEN concat(cast(cast(o_totalprice AS decimal(18,2)) AS string), '0') ELSE cast(cast(o_totalprice AS decimal(18,2)) AS string) END AS o_totalprice,
 cast(cast(o_orderdate AS date) AS string) AS o_orderdate, CASE WHEN o_orderkey % 77 = 9 THEN '' ELSE o_orderpriority END AS o_orderpriority
 FROM {orders} WHERE o_orderkey % 101 <> 7
 UNION ALL SELECT o_orderkey * 2 + 1, cast(o_orderkey + 10000000 AS string), cast(o_custkey AS string), o_orderstatus, cast(cast(o_totalprice AS decimal(18,2)) AS string),
 cast(cast(o_orderdate AS date) AS string), o_orderpriority FROM {orders} WHERE o_orderkey % 97 = 11""",
    ),
    "lineitem": (
        "SELECT l_returnflag, l_linestatus, cast(cast(l_quantity AS int) AS string) AS qty FROM {lineitem}",
        """SELECT l_returnflag, l_linestatus, cast(cast(l_quantity AS int) AS string) AS qty FROM {lineitem} WHERE l_partkey % 20 <> 3
 UNION ALL SELECT l_returnflag, l_linestatus, cast(cast(l_quantity AS int) AS string) AS qty FROM {lineitem} WHERE l_partkey % 30 = 4""",
    ),
    "part": (
        """SELECT p_partkey AS ord, cast(p_partkey AS string) AS p_partkey, p_name, p_brand, p_type, cast(p_size AS string) AS p_size, cast(cast(p_retailprice AS decimal(18,2)) AS string) AS p_retailprice FROM {part}""",
        """SELECT p_partkey AS ord, cast(p_partkey AS string) AS p_partkey, p_name, p_brand, p_type, cast(CASE WHEN p_partkey % 9 = 2 THEN p_size + 100 ELSE p_size END AS string) AS p_size,
 cast(cast(p_retailprice AS decimal(18,2)) AS string) AS p_retailprice FROM {part}""",
    ),
    "events": (
        """SELECT event_id AS ord, cast(event_id AS string) AS event_id, cast(date_trunc('second', ts) AS string) AS ts, cast(user_id AS string) AS user_id, event_type, cast(cast(value AS decimal(12,2)) AS string) AS value, props FROM {events}""",
        """SELECT event_id AS ord, cast(event_id AS string) AS event_id,
 concat(cast(date_trunc('second', ts) AS string), CASE WHEN event_id % 29 = 3 THEN '.500' WHEN event_id % 4 = 0 THEN '.000' ELSE '' END) AS ts, cast(user_id AS string) AS user_id, event_type,
 cast(cast(CASE WHEN event_id % 13 = 1 THEN value + 1 ELSE value END AS decimal(12,2)) AS string) AS value, props FROM {events} WHERE event_id % 31 <> 6""",
    ),
    "conversations": (
        "SELECT cast(conv_id AS string) AS conv_id, cast(turn AS string) AS turn, role, text FROM {conversations}",
        """SELECT cast(conv_id AS string) AS conv_id, cast(turn AS string) AS turn, role,
 CASE WHEN turn % 2 = 1 THEN concat(replace(text, 'a', 'A'), '(s)') WHEN conv_id % 5 = 0 THEN replace(text, 'e', 'E') ELSE text END AS text FROM {conversations}""",
    ),
    "customer": (
        "SELECT cast(c_custkey AS string) AS c_custkey, c_name, cast(c_nationkey AS string) AS c_nationkey, c_mktsegment FROM {customer}",
        """SELECT cast(c_custkey AS string) AS c_custkey, 'x' AS extra, CASE WHEN c_custkey % 17 = 4 THEN upper(c_name) ELSE c_name END AS c_name, cast(c_nationkey AS string) AS c_nationkey FROM {customer}""",
    ),
}
KEY, REQ = True, True
HEADERS = {
    "orders": Header.of(("o_orderkey", "VARCHAR(20)", KEY), ("o_custkey", "INTEGER"), ("o_orderstatus", "CHAR(1)"), ("o_totalprice", "DECIMAL(18,2)"),
        ("o_orderdate", "DATE"), ("o_orderpriority", "VARCHAR(20)", False, REQ)),
    "lineitem": Header.of(("l_returnflag", "CHAR(1)"), ("l_linestatus", "CHAR(1)"), ("qty", "INTEGER")),
    "part": Header.of(("p_partkey", "INTEGER"), ("p_name", "VARCHAR(60)"), ("p_brand", "VARCHAR(20)"), ("p_type", "VARCHAR(40)"), ("p_size", "INTEGER"),
    ("p_retailprice", "DECIMAL(18,2)")),
    "events": Header.of(("event_id", "INTEGER", KEY), ("ts", "TIMESTAMP"), ("user_id", "INTEGER"), ("event_type", "VARCHAR(20)"), ("value", "DECIMAL(12,2)"),
    ("props", "VARCHAR")),
    "conversations": Header.of(("conv_id", "INTEGER", KEY), ("turn", "INTEGER", KEY), ("role", "VARCHAR(20)"), ("text", "VARCHAR")),
    "customer": Header.of(("c_custkey", "INTEGER", KEY), ("c_name", "VARCHAR(40)"), ("c_nationkey", "INTEGER"), ("c_mktsegment", "VARCHAR(20)")),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sides(spark: SparkSession, sf_dir: str, pair: str) -> list[DataFrame]:
    return [spark.sql(sql, **{pair: table(spark, sf_dir, pair)}) for sql in PAIRS[pair]]


def diff_of(spark: SparkSession, sf_dir: str, pair: str, options: DiffOptions = DiffOptions()) -> Diff:
    s, t = sides(spark, sf_dir, pair)
    order = ["ord"] if "ord" in s.columns else ["conv_id", "turn"] if pair == "conversations" else ["c_custkey"] if pair == "customer" else None
    target = HEADERS[pair] if pair != "customer" else Header.names_only(*t.columns)
    return compare(spark, Source.dataframe(s, HEADERS[pair], order), Source.dataframe(t, target, order), options)


UNMOVED = DiffOptions(detect_moves=False)


def oracle_pair(pair: str) -> str:
    """CTEs s, t with r, the record number (four header rows above; order as in the query)."""
    order = {"conversations": "conv_id, turn", "customer": "c_custkey"}.get(pair, "ord")
    s, t = (sql.replace("{" + pair + "}", pair) for sql in PAIRS[pair])
    rows = 1 if pair == "customer" else 4
    return f"s AS (SELECT *, row_number() OVER (ORDER BY {order}) + 4 AS r FROM ({s})), t AS (SELECT *, row_number() OVER (ORDER BY {order}) + {rows} AS r FROM ({t}))"


P1 = f"""WITH {oracle_pair("orders")}, j AS (
 SELECT coalesce(t.o_orderkey, s.o_orderkey) AS k, s.r AS sr, t.r AS tr, s.o_orderstatus AS s2, t.o_orderstatus AS t2, s.o_totalprice AS s3, t.o_totalprice AS t3, s.o_orderpriority AS s5, t.o_orderpriority AS t5, s.o_custkey AS s1, t.o_custkey AS t1, s.o_orderdate AS s4, t.o_orderdate AS t4,
 s.r IS NOT NULL AND t.r IS NOT NULL AND s.o_totalprice::DECIMAL(18,3) <> t.o_totalprice::DECIMAL(18,3) AS c3, s.r IS NOT NULL AND t.r IS NOT NULL AND s.o_orderpriority <> t.o_orderpriority AS c5,
 s.r IS NOT NULL AND t.r IS NOT NULL AND s.o_totalprice <> t.o_totalprice AND s.o_totalprice::DECIMAL(18,3) = t.o_totalprice::DECIMAL(18,3) AS p3, s.r IS NOT NULL AND t.r IS NOT NULL AND s.o_orderstatus <> t.o_orderstatus AS p2,
 s.r IS NOT NULL AND t.r IS NOT NULL AND s.o_orderkey::BIGINT % 997 = 500 AS moved FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey),
 d AS (SELECT *, CASE WHEN sr IS NULL THEN 'added' WHEN tr IS NULL THEN 'deleted' WHEN c3 OR c5 THEN 'modified' ELSE 'unchanged' END AS kind, c3::INT + c5::INT AS nc, p2::INT + p3::INT AS np, (coalesce(t5, s5) = '')::INT AS nf FROM j),
 o AS (SELECT *, CASE WHEN tr IS NULL THEN coalesce(max(CASE WHEN tr IS NOT NULL THEN sr END) OVER (ORDER BY sr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS anchor FROM d WHERE sr IS NOT NULL UNION ALL SELECT *, NULL FROM d WHERE sr IS NULL),
 b AS (SELECT o.*, coalesce(CASE WHEN o.tr IS NULL THEN coalesce(a.tr + 1, 0) END, o.tr) AS bucket, CASE WHEN o.tr IS NULL THEN 0 ELSE 1 END AS side FROM o LEFT JOIN d a ON a.sr = o.anchor AND a.tr IS NOT NULL),
 p AS (SELECT *, row_number() OVER (ORDER BY bucket, side, sr) - 1 AS report_pos FROM b),
 m AS (SELECT k, moved, CASE WHEN moved THEN row_number() OVER (ORDER BY tr) - row_number() OVER (ORDER BY sr) ELSE 0 END AS dist FROM d WHERE sr IS NOT NULL AND tr IS NOT NULL)
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


COUNTS = ("unchanged", "modified", "added", "deleted", "moved", "report", "changed", "suppressed", "finding_rows", "requiredEmpty")


@query(
    P1
    + """SELECT count(*) FILTER (kind = 'unchanged') AS unchanged, count(*) FILTER (kind = 'modified') AS modified, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'deleted') AS deleted,
 count(*) FILTER (moved) AS moved, count(*) AS report, sum(nc)::BIGINT AS changed, sum(np)::BIGINT AS suppressed, sum(nf)::BIGINT AS finding_rows, sum(nf)::BIGINT AS "requiredEmpty" FROM d"""
)
def diff_keyed_counts(spark, sf_dir):
    return diff_of(spark, sf_dir, "orders").counts().select(*COUNTS)


@query(P1 + "SELECT k AS o_orderkey, kind, sr AS source_row, tr AS target_row, nc::BIGINT AS changed_cells FROM d")
def diff_keyed_rows(spark, sf_dir):
    rows = diff_of(spark, sf_dir, "orders", UNMOVED).classified
    return rows.select(F.coalesce("t0", "s0").alias("o_orderkey"), "kind", F.col("s_row").alias("source_row"), F.col("t_row").alias("target_row"), F.col("changed_cells").cast("long").alias("changed_cells"))


@query(P1 + "SELECT k AS o_orderkey, tr AS target_row FROM d WHERE kind = 'added'")
def rows_added(spark, sf_dir):
    return diff_of(spark, sf_dir, "orders", UNMOVED).classified.where("kind = 'added'").select(F.col("t0").alias("o_orderkey"), F.col("t_row").alias("target_row"))


@query(P1 + "SELECT k AS o_orderkey, sr AS source_row FROM d WHERE kind = 'deleted'")
def rows_deleted(spark, sf_dir):
    return diff_of(spark, sf_dir, "orders", UNMOVED).classified.where("kind = 'deleted'").select(F.col("s0").alias("o_orderkey"), F.col("s_row").alias("source_row"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey * 1000000 + l_suppkey) AS first FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT l_partkey * 1000000 + l_suppkey) > 1")
def duplicate_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("number"))
    return match.duplicate_keys(rows, ["l_orderkey", "l_linenumber"], "number").drop("second")


CELLS = """SELECT k AS key, name, source, target FROM (SELECT k, 'o_totalprice' AS name, s3 AS source, t3 AS target, c3 AS c, p3 AS p FROM d UNION ALL SELECT k, 'o_orderpriority', s5, t5, c5, false FROM d UNION ALL SELECT k, 'o_orderstatus', s2, t2, false, p2 FROM d)"""


@query(P1 + CELLS + " WHERE c")
def changed_cells(spark, sf_dir):
    return diff_of(spark, sf_dir, "orders", UNMOVED).cells().select("key", "name", "source", "target")


@query(P1 + f"SELECT name, count(*) AS n FROM ({CELLS} WHERE c) GROUP BY name")
def changed_cells_by_column(spark, sf_dir):
    return diff_of(spark, sf_dir, "orders", UNMOVED).changes_by_column()


@query(P1 + CELLS + " WHERE p")
def suppressed_cells(spark, sf_dir):
    return diff_of(spark, sf_dir, "orders", UNMOVED).cells(report.SUPPRESSED).select("key", "name", "source", "target")


@query("""SELECT o_orderkey, '+00' || p || '000' AS v1, p || 'e3' AS v2, '-' || p || 'E-4' AS v3, rtrim(rtrim(p, '0'), '.') AS c1, ((p::DECIMAL(18,2) * 1000)::BIGINT)::VARCHAR AS c2,
 CASE WHEN p::DECIMAL(18,2) = 0 THEN '0' ELSE '-' || rtrim((p::DECIMAL(18,6) / 10000)::DECIMAL(18,6)::VARCHAR, '0') END AS c3, NULL::VARCHAR AS c4 FROM (SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::VARCHAR AS p FROM orders)""")
def canonical_decimal(spark, sf_dir):
    p = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    v = [F.concat(F.lit("+00"), p, F.lit("000")), F.concat(p, F.lit("e3")), F.concat(F.lit("-"), p, F.lit("E-4")), F.concat(p, F.lit("x"))]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(f"v{i + 1}") for i, c in enumerate(v)])
    return rows.select("o_orderkey", "v1", "v2", "v3", *[normalize.canonical_decimal(F.col(f"v{i}")).alias(f"c{i}") for i in (1, 2, 3, 4)])


@query("""SELECT event_id, v, CASE WHEN regexp_matches(v, '^.+[.][0-9]+$') THEN rtrim(rtrim(v, '0'), '.') ELSE v END AS c FROM (
 SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 3 = 0 THEN '.500' WHEN event_id % 3 = 1 THEN '.000' ELSE '' END AS v FROM events)""")
def canonical_timestamp(spark, sf_dir):
    v = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, ".500").when(F.col("event_id") % 3 == 1, ".000").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", v.alias("v")).withColumn("c", normalize.canonical_timestamp(F.col("v")))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' ELSE '1' END AS c FROM part""")
def canonical_boolean(spark, sf_dir):
    words = F.element_at(F.array(*map(F.lit, ("Yes", "f", "t", "NO", "maybe", "1"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", normalize.canonical_boolean(words).alias("c"))


@query("""SELECT c_custkey, trim(v, ' ' || chr(9)) AS trimmed, rtrim(v, ' ' || chr(9)) AS unpadded FROM (SELECT c_custkey, ' ' || chr(9) || c_name || '  ' || chr(9) AS v FROM customer)""")
def trim_and_char_pad(spark, sf_dir):
    v = F.concat(F.lit(" \t"), F.col("c_name"), F.lit("  \t"))
    return table(spark, sf_dir, "customer").select("c_custkey", normalize.trimmed(v).alias("trimmed"), normalize.unpadded(v).alias("unpadded"))


@query(P1 + "SELECT k AS key, 'o_orderpriority' AS name, 'requiredEmpty' AS kind, sr AS source_row, tr AS target_row FROM d WHERE nf > 0")
def validation_findings(spark, sf_dir):
    return diff_of(spark, sf_dir, "orders", UNMOVED).findings().select("key", "name", F.col("finding").alias("kind"), "source_row", "target_row")


STRICT = Header.of(("o_orderkey", "VARCHAR(3)", KEY), ("o_custkey", "INTEGER(2)"), ("o_orderstatus", "INTEGER"), ("o_totalprice", "DECIMAL(6,1)"), ("o_orderdate", "DATE"), ("o_orderpriority", "VARCHAR(5)", False, REQ))


@query(
    P1
    + """SELECT sum((length(k) > 3)::INT + (coalesce(t5, s5) <> '' AND length(coalesce(t5, s5)) > 5)::INT)::BIGINT AS "tooLong", count(*) AS "notNumeric", sum((coalesce(t5, s5) = '')::INT)::BIGINT AS "requiredEmpty",
 sum((length(coalesce(t1, s1)) > 2)::INT + (coalesce(t3, s3)::DECIMAL(18,2) >= 100000 OR length(rtrim(split_part(coalesce(t3, s3), '.', 2), '0')) > 1)::INT)::BIGINT AS precision FROM d"""
)
def findings_summary(spark, sf_dir):
    s, t = sides(spark, sf_dir, "orders")
    return compare(spark, Source.dataframe(s, STRICT, ["ord"]), Source.dataframe(t, STRICT, ["ord"]), UNMOVED).counts().select("tooLong", "notNumeric", "requiredEmpty", "precision")


MULTISET = """WITH s AS (SELECT *, count(*) AS n FROM ({s}) GROUP BY ALL), t AS (SELECT *, count(*) AS n FROM ({t}) GROUP BY ALL)
SELECT coalesce(s.l_returnflag, t.l_returnflag) AS l_returnflag, coalesce(s.l_linestatus, t.l_linestatus) AS l_linestatus, coalesce(s.qty, t.qty) AS qty, least(coalesce(s.n, 0), coalesce(t.n, 0)) AS unchanged,
 greatest(coalesce(t.n, 0) - coalesce(s.n, 0), 0) AS added, greatest(coalesce(s.n, 0) - coalesce(t.n, 0), 0) AS deleted FROM s FULL JOIN t USING (l_returnflag, l_linestatus, qty)"""


@query(MULTISET.replace("{s}", PAIRS["lineitem"][0]).replace("{t}", PAIRS["lineitem"][1]).replace("{lineitem}", "lineitem"))
def all_keys_multiset(spark, sf_dir):
    rows = diff_of(spark, sf_dir, "lineitem", replace(UNMOVED, similarity=False)).classified
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).cast("long").alias(kind)
    return rows.groupBy(*[F.coalesce(f"t{i}", f"s{i}").alias(n) for i, n in enumerate(("l_returnflag", "l_linestatus", "qty"))]).agg(of("unchanged"), of("added"), of("deleted"))


@query(f"WITH {oracle_pair('part')} SELECT s.p_partkey AS source, t.p_partkey AS target, s.p_size AS source_size, t.p_size AS target_size FROM s JOIN t USING (p_partkey) WHERE s.p_size <> t.p_size")
def similarity_pairs(spark, sf_dir):
    # all pairs, however many rows have changed, unless a limit is set
    found = diff_of(spark, sf_dir, "part", replace(UNMOVED, pair_all=UNMOVED.max_pair_work is None))
    if found.truncated:  # the result has no place to say so
        raise RuntimeError("pairing by likeness gave up at its limits, so pairs would be missing")
    rows = found.classified.where("kind = 'modified'")
    return rows.select(F.col("s0").alias("source"), F.col("t0").alias("target"), F.col("s4").alias("source_size"), F.col("t4").alias("target_size"))


@query(P1 + "SELECT k AS o_orderkey, moved, dist AS move_distance FROM m")
def move_flags(spark, sf_dir):
    return diff_of(spark, sf_dir, "orders").classified.where("s_idx is not null and t_idx is not null").select(F.col("t0").alias("o_orderkey"), "moved", "move_distance")


@query(P1 + "SELECT report_pos, k AS o_orderkey, kind FROM p")
def anchored_report(spark, sf_dir):
    return diff_of(spark, sf_dir, "orders", UNMOVED).ordered_rows().select("report_pos", F.coalesce("t0", "s0").alias("o_orderkey"), "kind")


@query(P1 + "SELECT row_number() OVER (ORDER BY tr NULLS LAST, sr) - 1 AS report_pos, k AS o_orderkey, kind FROM d")
def end_report(spark, sf_dir):
    return diff_of(spark, sf_dir, "orders", replace(UNMOVED, deleted="end")).ordered_rows().select("report_pos", F.coalesce("t0", "s0").alias("o_orderkey"), "kind")


@query(P1 + "SELECT report_pos, k AS o_orderkey FROM (SELECT row_number() OVER (ORDER BY bucket, side, sr) - 1 AS report_pos, k FROM b WHERE kind <> 'unchanged' OR moved OR np > 0 OR nf > 0)")
def changes_only(spark, sf_dir):
    return diff_of(spark, sf_dir, "orders").ordered_rows(True).select("report_pos", F.coalesce("t0", "s0").alias("o_orderkey"))


@query(P1 + "SELECT report_pos, k AS o_orderkey, kind FROM p WHERE report_pos BETWEEN 500 AND 549")
def page(spark, sf_dir):
    return diff_of(spark, sf_dir, "orders", UNMOVED).page(500, 50).select("report_pos", F.element_at("key", 1).alias("o_orderkey"), "kind")


@query(P1 + "SELECT report_pos, k AS o_orderkey, kind FROM p WHERE kind <> 'unchanged' ORDER BY report_pos LIMIT 20")
def top_n_changes(spark, sf_dir):
    """A top-k report: the limit is the feature."""
    return diff_of(spark, sf_dir, "orders", UNMOVED).ordered_rows().where("kind <> 'unchanged'").orderBy("report_pos").limit(20).select("report_pos", F.coalesce("t0", "s0").alias("o_orderkey"), "kind")


POLICY = DiffOptions(CompareOptions(allow_added_columns=True, allow_removed_columns=True), detect_moves=False)
P6 = f"""WITH {oracle_pair("customer")}, j AS (SELECT c_custkey AS k, s.r AS sr, t.r AS tr, s.c_name AS s1, t.c_name AS t1, s.c_nationkey AS s2 FROM s JOIN t USING (c_custkey)), d AS (SELECT *, s1 <> t1 AS c FROM j)"""


@query(P6 + " SELECT k AS key, 'c_name' AS name, s1 AS source, t1 AS target FROM d WHERE c")
def column_policy(spark, sf_dir):
    return diff_of(spark, sf_dir, "customer", POLICY).cells().select("key", "name", "source", "target")


@query("SELECT * FROM (VALUES ('columnAdded', 1, 'extra'), ('columnRemoved', 3, 'c_mktsegment')) v(kind, \"column\", name)")
def column_policy_findings(spark, sf_dir):
    return spark.createDataFrame([(f["kind"], f["column"], f["name"]) for f in diff_of(spark, sf_dir, "customer", POLICY).schema_findings], "kind string, column int, name string")


@query(
    P1
    + """SELECT '{"schemaVersion":1,"identical":false,"rows":{"unchanged":' || count(*) FILTER (kind = 'unchanged') || ',"modified":' || count(*) FILTER (kind = 'modified') || ',"added":' || count(*) FILTER (kind = 'added') || ',"deleted":' || count(*) FILTER (kind = 'deleted')
 || ',"moved":' || count(*) FILTER (moved) || ',"report":' || count(*) || '},"cells":{"changed":' || sum(nc) || ',"suppressed":' || sum(np) || '},"findings":{"total":' || sum(nf) || ',"rows":' || sum(nf) || ',"requiredEmpty":' || sum(nf)
 || ',"tooLong":0,"notNumeric":0,"precision":0,"enabled":true},"matching":{"allKeys":false,"pairedBySimilarity":0,"pairingTruncated":false,"movesForcedOff":false},"columns":{"compared":6,"added":0,"removed":0},"targetHeader":{"rows":4,"namesOnly":false},"schemaFindings":[],"schemaFindingCount":0}' AS value FROM d"""
)
def summary_json(spark, sf_dir):
    return diff_of(spark, sf_dir, "orders").emit("summary").select("value")


def _json_cell(name: str, s: str, t: str, changed: str, suppressed: str) -> str:
    return f"""'{{"name":"{name}"' || CASE WHEN tr IS NULL OR {changed} OR {suppressed} THEN coalesce(',"source":"' || {s} || '"', '') ELSE '' END || coalesce(',"target":"' || {t} || '"', '') || CASE WHEN {changed} THEN ',"changed":true' ELSE '' END || CASE WHEN {suppressed} THEN ',"suppressed":true' ELSE '' END || '}}'"""


K0 = "CASE WHEN sr IS NOT NULL THEN k END", "CASE WHEN tr IS NOT NULL THEN k END"
JSON_CELLS = " || ',' || ".join([_json_cell("o_orderkey", *K0, "false", "false"), _json_cell("o_custkey", "s1", "t1", "false", "false"),
    _json_cell("o_orderstatus", "s2", "t2", "false", "p2"), _json_cell("o_totalprice", "s3", "t3", "c3", "p3"), _json_cell("o_orderdate", "s4", "t4", "false", "false"),
    _json_cell("o_orderpriority", "s5", "t5", "c5", "false")])


@query(
    P1
    + f"""SELECT report_pos, '{{"schemaVersion":1,"kind":"' || kind || '","sourceRow":' || coalesce(sr::VARCHAR, 'null') || ',"targetRow":' || coalesce(tr::VARCHAR, 'null') || ',"moved":false,"moveDistance":0,"cells":[' || {JSON_CELLS} || ']'
 || CASE WHEN nf > 0 THEN ',"findings":[{{"column":5,"name":"o_orderpriority","kind":"requiredEmpty"}}]' ELSE '' END || '}}' AS value FROM p"""
)
def emit_jsonl(spark, sf_dir):
    return diff_of(spark, sf_dir, "orders", UNMOVED).emit("jsonl").where("part = 1").select("report_pos", "value")


def _csv_line(side: str, letter: str) -> str:
    cells = [f"CASE WHEN {letter}r IS NOT NULL THEN k ELSE '' END", *[f"coalesce({letter}{i}, '')" for i in (1, 2, 3, 4, 5)]]
    cells[2] = f"CASE WHEN {letter}2 LIKE ' %' THEN '\"' || {letter}2 || '\"' ELSE coalesce({letter}2, '') END"
    return f"'1,' || kind || ',{side},false,0,' || coalesce(sr::VARCHAR, '') || ',' || coalesce(tr::VARCHAR, '') || ',' || nc || ',' || nf || ',' || {' || $comma$,$comma$ || '.join(cells)}"


@query(P1 + f"SELECT report_pos, 0 AS line, {_csv_line('source', 's')} AS value FROM p WHERE kind IN ('modified', 'deleted') UNION ALL SELECT report_pos, CASE kind WHEN 'modified' THEN 1 ELSE 0 END, {_csv_line('target', 't')} FROM p WHERE kind <> 'deleted'")
def emit_csv(spark, sf_dir):
    return diff_of(spark, sf_dir, "orders", UNMOVED).emit("csv").where("part = 1").select("report_pos", "line", "value")


@query("""SELECT p_partkey, CASE WHEN v LIKE '=%' OR v LIKE '@%' THEN '"''' || replace(v, '"', '""') || '"' WHEN v LIKE '-%' AND NOT regexp_matches(v, '^-[0-9]+$') THEN '"''' || v || '"' WHEN v LIKE '%,%' OR v LIKE '%"%' OR v LIKE ' %' THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS value FROM (
 SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@"' WHEN 3 THEN ' ' WHEN 4 THEN 'a,"' ELSE '' END || CASE WHEN p_partkey % 12 = 1 THEN p_partkey::VARCHAR ELSE p_name END AS v FROM part)""")
def emit_csv_guard(spark, sf_dir):
    lead = F.element_at(F.array(*map(F.lit, ("=", "-", '@"', " ", 'a,"', ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    v = F.concat(lead, F.when(F.col("p_partkey") % 12 == 1, F.col("p_partkey").cast("string")).otherwise(F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", emitters.csv_quoted(v).alias("value"))


ESCAPED = "replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(f"SELECT doc_id AS id, md5({ESCAPED.format(c='text')}) AS value FROM documents UNION ALL SELECT page_id, md5({ESCAPED.format(c='html')}) FROM pages")
def html_escape(spark, sf_dir):
    docs, pages = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "pages").select("page_id", "html")
    return docs.union(pages).toDF("id", "v").select("id", F.md5(emitters.html_escaped(F.col("v"))).alias("value"))


P5 = f"WITH {oracle_pair('conversations')}, d AS (SELECT conv_id, turn, s.text AS source, t.text AS target FROM s JOIN t USING (conv_id, turn) WHERE trim(s.text, ' ' || chr(9)) <> trim(t.text, ' ' || chr(9)))"


def _rebuilt(spark, sf_dir, mode: str) -> DataFrame:
    cells = diff_of(spark, sf_dir, "conversations", UNMOVED).segments(mode)
    side = lambda ops: F.concat_ws("", F.transform(F.filter("segments", lambda g: g["op"].isin(*ops)),
        lambda g: slice_bytes(F.when(g["op"] == "INSERT", F.col("target")).otherwise(F.col("source")), g["start"], g["len"])))
    return cells.select("key", side(("EQUAL", "DELETE")).alias("source"), side(("EQUAL", "INSERT")).alias("target"))


@query(P5 + " SELECT conv_id || '|' || turn AS key, source, target FROM d")
def segments_rebuild_word(spark, sf_dir):
    return _rebuilt(spark, sf_dir, "word")


@query(P5 + " SELECT conv_id || '|' || turn AS key, source, target FROM d")
def segments_rebuild_character(spark, sf_dir):
    return _rebuilt(spark, sf_dir, "character")


@query(P5 + " SELECT conv_id || '|' || turn AS key, source, target FROM d")
def segments_rebuild_both(spark, sf_dir):
    return _rebuilt(spark, sf_dir, "both")


@query(P5 + " SELECT conv_id || '|' || turn AS key, md5(source) AS source, md5(target) AS target FROM d")
def conversations_diff(spark, sf_dir):
    return diff_of(spark, sf_dir, "conversations").cells().select("key", F.md5("source").alias("source"), F.md5("target").alias("target"))


P4 = f"""WITH {oracle_pair("events")}, d AS (SELECT coalesce(t.event_id, s.event_id) AS k, s.r AS sr, t.r AS tr, s.ts AS s1, t.ts AS t1, s.value AS s4, t.value AS t4, t.r IS NOT NULL AND s.ts <> t.ts AND t.ts NOT LIKE '%.000' AS c1, t.r IS NOT NULL AND t.ts LIKE '%.000' AS p1, t.r IS NOT NULL AND s.value <> t.value AS c4 FROM s LEFT JOIN t ON s.event_id = t.event_id)"""


@query(P4 + " SELECT k AS event_id, CASE WHEN tr IS NULL THEN 'deleted' WHEN c1 OR c4 THEN 'modified' ELSE 'unchanged' END AS kind, (c1::INT + c4::INT)::BIGINT AS changed_cells, p1::BIGINT AS suppressed_cells FROM d")
def event_snapshot_diff(spark, sf_dir):
    rows = diff_of(spark, sf_dir, "events", UNMOVED).classified
    return rows.select(F.coalesce("t0", "s0").alias("event_id"), "kind", F.col("changed_cells").cast("long").alias("changed_cells"), F.col("suppressed_cells").cast("long").alias("suppressed_cells"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name || ', \"' || c_mktsegment || '\"' || chr(10) || 'x' AS c_name FROM customer")
def csv_roundtrip(spark, sf_dir):
    """The law of the strict parser: a table written as CSV, with every kind of quoting, and parsed is the table."""
    name = F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"\nx'))
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(","), emitters.csv_quoted(name, guard=False))
    parts = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 1000).alias("part")).agg(F.concat_ws("\r\n", F.collect_list(line)).alias("body"))
    return parse_column(parts, "body").select(F.col("cells")[0].alias("c_custkey"), F.col("cells")[1].alias("c_name"))


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def json_rows_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    text = rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns)))).first()[0]  # a reference table of 25 rows
    side = Source.json_rows(text, Header.names_only(*rows.columns)).open(spark, None, None)
    return side.rows.toDF("rec", *rows.columns).drop("rec")


@query("SELECT o_custkey, o_orderkey::VARCHAR AS o_orderkey, o_orderstatus || ',' || o_orderpriority AS status FROM orders")
def embedded_csv_rows(spark, sf_dir):
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(',"'), F.col("o_orderstatus"), F.lit(","), F.col("o_orderpriority"), F.lit('"'))
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat_ws("\n", F.collect_list(line)).alias("csv"))
    return parse_column(held, "csv").select("o_custkey", F.col("cells")[0].alias("o_orderkey"), F.col("cells")[1].alias("status"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' WHEN strftime(ts, '%f') LIKE '%000' THEN '.' || left(strftime(ts, '%f'), 3) ELSE '.' || strftime(ts, '%f') END AS ts,
 strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS flag, value::DECIMAL(12,2)::VARCHAR AS value, '' AS missing, CASE event_id WHEN 0 THEN '0.0' ELSE (event_id * 10000000)::VARCHAR END AS big FROM events""")
def sql_value_rendering(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.col("ts").cast("date").alias("day"), (F.col("event_id") % 2 == 0).alias("flag"),
        F.col("value").cast("decimal(12,2)").alias("value"), F.lit(None).cast("int").alias("missing"), (F.col("event_id") * 10000000).cast("double").alias("big"))
    return rows.select("event_id", *[render.rendered(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields[1:]])


@query(P6 + " SELECT k AS key, 0 AS line, CASE WHEN c THEN 'deleted' ELSE 'unchanged' END AS role, CASE WHEN c THEN sr ELSE tr END AS number, s1 AS name FROM d UNION ALL SELECT k, 1, 'added', tr, t1 FROM d WHERE c")
def presentation_unified(spark, sf_dir):
    p = diff_of(spark, sf_dir, "customer", POLICY).present("unified")
    return p.select(F.col("cells")[0]["text"].alias("key"), "line", "role", "number", F.col("cells")[1]["text"].alias("name"))


@query(P6 + " SELECT k AS key, 'source' AS pane, CASE WHEN c THEN 'modified' ELSE 'unchanged' END AS role, sr AS number, s1 AS name FROM d UNION ALL SELECT k, 'target', CASE WHEN c THEN 'modified' ELSE 'unchanged' END, tr, t1 FROM d")
def presentation_side_by_side(spark, sf_dir):
    p = diff_of(spark, sf_dir, "customer", POLICY).present("sideBySide")
    return p.select(F.col("cells")[0]["text"].alias("key"), "pane", "role", "number", F.col("cells")[1]["text"].alias("name"))


@query(f"WITH {oracle_pair('part')} SELECT t.r AS target_row, '<tr class=\"tally-row tally-' || CASE WHEN s.p_size <> t.p_size THEN 'modified' ELSE 'unchanged' END || '\"><td class=\"tally-num\">' || t.r || '</td></tr>' AS value FROM s JOIN t USING (p_partkey)")
def emit_html_rows(spark, sf_dir):
    keyed = Header([(n, t, i == 0, q) for i, (n, t, _, q) in enumerate(HEADERS["part"].columns)])
    s, t = sides(spark, sf_dir, "part")
    diff = compare(spark, Source.dataframe(s, keyed, ["ord"]), Source.dataframe(t, keyed, ["ord"]), replace(UNMOVED, validate=False))
    return diff.emit("html", EmitOptions(include_values=False)).where("part = 1").select((F.col("report_pos") + 5).alias("target_row"), "value")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the whole report of the orders pair, moves and findings included."""
    return diff_of(spark, sf_dir, "orders").report()

