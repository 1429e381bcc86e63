"""The report rows: kinds, cell flags, findings, moves, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import canonical_decimal, fraction_digits, integer_digits, normalized, trimmed
from ..options import DiffOptions
from ..plans.header import HeaderModel
from .order import last_before, ranked

CHANGED, SUPPRESSED, REQUIRED_EMPTY, TOO_LONG, NOT_NUMERIC, PRECISION = 1, 2, 4, 8, 16, 32
FINDINGS = ((REQUIRED_EMPTY, "requiredEmpty"), (TOO_LONG, "tooLong"), (NOT_NUMERIC, "notNumeric"), (PRECISION, "precision"))
FINDING = sum(f for f, _ in FINDINGS)


def findings_of(v: Column, number: Column | None, i: int, model: HeaderModel, options: DiffOptions) -> Column | None:
    """Finding flags of a value of column i, ``number`` being its canonical decimal; None where its declaration asks for nothing."""
    declared = model.types[i]
    cell = trimmed(v) if options.compare.trim else v
    checks = []
    if declared.text and declared.size > 0:
        checks.append(F.when(F.length(cell) > declared.size, TOO_LONG).otherwise(0))
    if declared.numeric:
        checks.append(F.when(number.isNull() | cell.contains('"'), NOT_NUMERIC).otherwise(0))
        whole, part = integer_digits(number), fraction_digits(number)
        over = None
        if declared.kind == "INTEGER":
            over = part > 0
            if declared.size > 0:
                over |= whole > declared.size
        elif declared.size > 0:
            scale = max(declared.scale, 0)
            over = part > scale
            if scale <= declared.size:
                over |= whole > declared.size - scale
        if over is not None:
            checks.append(F.when(F.coalesce(over, F.lit(False)), PRECISION).otherwise(0))
    if not checks and not model.required[i]:
        return None
    flags = sum(checks[1:], checks[0]) if checks else F.lit(0)
    return F.when(cell == "", F.lit(REQUIRED_EMPTY if model.required[i] else 0)).otherwise(flags)


def classified(joined: DataFrame, model: HeaderModel, options: DiffOptions) -> DataFrame:
    """kind, f0.. (flags of each cell) and counts added to the joined rows. Absent sides are null here, and stay so in s.. and t.. ."""
    n = model.width
    both = F.col("s_idx").isNotNull() & F.col("t_idx").isNotNull()
    numeric = [i for i in range(n) if options.validate and model.types[i].numeric]
    # a projection of its own, so that each number is read once
    value = lambda i: trimmed(F.coalesce(f"t{i}", f"s{i}")) if options.compare.trim else F.coalesce(f"t{i}", f"s{i}")
    joined = joined.select("*", *[canonical_decimal(value(i)).alias(f"_c{i}") for i in numeric])
    flags = []
    for i in range(n):
        s, t = F.col(f"s{i}"), F.col(f"t{i}")
        same_raw = s == t
        # equal bytes have equal forms, so most cells are never normalized
        same = same_raw | (normalized(s, model.types[i], options.compare, model.label(i)) == normalized(t, model.types[i], options.compare, model.label(i)))
        flag = F.when(both & ~same, CHANGED)
        if options.count_suppressed:
            flag = flag.when(both & ~same_raw, SUPPRESSED)
        flag = flag.otherwise(0)
        found = findings_of(F.coalesce(t, s), F.col(f"_c{i}") if i in numeric else None, i, model, options) if options.validate else None
        flags.append((flag + found if found is not None else flag).cast("int").alias(f"f{i}"))
    out = joined.select("*", *flags).drop(*[f"_c{i}" for i in numeric])
    bits = lambda bit: sum((F.when(F.col(f"f{i}").bitwiseAND(bit) != 0, 1).otherwise(0) for i in range(n)), F.lit(0))
    kind = F.when(F.col("s_idx").isNull(), "added").when(F.col("t_idx").isNull(), "deleted").when(F.col("changed_cells") > 0, "modified").otherwise("unchanged")
    return out.withColumn("changed_cells", bits(CHANGED)).withColumn("suppressed_cells", bits(SUPPRESSED)).withColumn("finding_cells", bits(FINDING)).withColumn("kind", kind)


def placed(rows: DataFrame, matches: DataFrame, deleted: str) -> DataFrame:
    """bucket and side added, which with s_idx or t_idx give the report's order: target rows in target order, each deleted row before the target row that follows its anchor.

    A deleted row's anchor is the last matched row before it in the source; without one it stands first, with ``deleted`` = end after everything. There
    buckets go on by source place, so that however many rows are deleted, they fall into blocks.
    """
    gone = F.col("t_idx").isNull()
    if deleted == "end":
        return rows.withColumn("bucket", F.when(gone, F.col("s_idx") + F.lit(2**62)).otherwise(F.col("t_idx"))).withColumn("side", F.when(gone, 0).otherwise(1))
    seen = last_before(matches.select(F.col("s_idx").alias("s"), "t_idx"), "s", "t_idx", "last")
    anchors = seen.where("t_idx is null").select(F.col("s").alias("s_idx"), F.coalesce(F.col("last") + 1, F.col("s") - F.lit(2**62)).alias("anchor"))
    out = rows.join(anchors, "s_idx", "left")
    return out.withColumn("bucket", F.when(gone, F.col("anchor")).otherwise(F.col("t_idx"))).withColumn("side", F.when(gone, 0).otherwise(1)).drop("anchor")


def positioned(rows: DataFrame) -> DataFrame:
    """report_pos (from 0) along the report's order."""
    at = rows.withColumn("_idx", F.coalesce("t_idx", "s_idx"))
    return ranked(at, "bucket", ["bucket", "side", "_idx"], "report_pos").drop("_idx")


def cells_of(model: HeaderModel) -> Column:
    """A struct for each cell; source is there only where it says more than target."""
    cell = lambda i: F.struct(
        F.lit(i).alias("column"), F.lit(model.label(i)).alias("name"),
        F.when(F.col("t_idx").isNull() | (F.col(f"f{i}").bitwiseAND(CHANGED | SUPPRESSED) != 0), F.col(f"s{i}")).alias("source"), F.col(f"t{i}").alias("target"),
        (F.col(f"f{i}").bitwiseAND(CHANGED) != 0).alias("changed"), (F.col(f"f{i}").bitwiseAND(SUPPRESSED) != 0).alias("suppressed"), F.col(f"f{i}").alias("flags"),
    )
    return F.array(*[cell(i) for i in range(model.width)])


def finding_list(model: HeaderModel) -> Column:
    """A struct for each finding, by column and then kind."""
    none = F.lit(None).cast("int")

    def one(i: int, flag: int, kind: str) -> Column:
        t = model.types[i]
        limit = F.lit(t.size) if flag == TOO_LONG else none
        size, scale = (F.lit(t.size), F.lit(t.scale)) if flag == PRECISION else (none, none)
        s = F.struct(F.lit(i).alias("column"), F.lit(model.label(i)).alias("name"), F.lit(kind).alias("kind"), limit.alias("limit"), size.alias("precision"), scale.alias("scale"))
        return F.when(F.col(f"f{i}").bitwiseAND(flag) != 0, s)

    able = [(i, flag, kind) for i in range(model.width) for flag,
        kind in FINDINGS if (model.required[i] if flag == REQUIRED_EMPTY else model.types[i].text and model.types[i].size > 0 if flag == TOO_LONG else model.types[i].numeric)]
    if not able:
        return F.array().cast("array<struct<column:int,name:string,kind:string,limit:int,precision:int,scale:int>>")
    return F.array_compact(F.array(*[one(*x) for x in able]))
