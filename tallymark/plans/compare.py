"""compare(): from two sources to a report."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ReconcileError
from ..functions.segments import cell_segments
from ..operators import match
from ..operators import report as reporting
from ..operators.moves import moved_rows
from ..options import Dialect, DiffOptions, EmitOptions, Limits
from ..sources.tables import Side, Source
from .header import LOOK, ColumnPlan, HeaderModel, find_target_header, metadata_disagreements, resolve_source
from .storage import stage

SCHEMA_VERSION = 1
MOST_SCHEMA_FINDINGS = 64


def _body(side: Side, columns: list[int], skip: int, prefix: str) -> DataFrame:
    """{prefix}_idx (0-based place), {prefix}_row (record number) and the chosen cells, never null."""
    cells = [F.coalesce(F.col(f"v{c}"), F.lit("")).alias(f"{prefix}{i}") for i, c in enumerate(columns)]
    rows = side.rows.where(F.col("rec") > skip) if skip else side.rows
    return rows.select((F.col("rec") - skip - 1).alias(f"{prefix}_idx"), F.col("rec").alias(f"{prefix}_row"), *cells)


@dataclass
class Diff:
    """The result of a comparison. Everything is lazy but the checks: nothing is computed before it is asked for."""

    model: HeaderModel
    options: DiffOptions
    joined: DataFrame
    plan: ColumnPlan
    target_rows: int
    source_stats: object = None
    target_stats: object = None
    truncated: bool = False
    schema_findings: list[dict] = field(default_factory=list)
    schema_finding_count: int = 0

    @property
    def columns(self) -> list[str]:
        return [self.model.label(i) for i in range(self.model.width)]

    @property
    def key_columns(self) -> list[str]:
        return [self.model.label(i) for i in self.model.key_columns]

    @property
    def tracks_moves(self) -> bool:
        return self.options.detect_moves and self.options.source_ordered

    @property
    def placement(self) -> str:
        return self.options.deleted if self.options.source_ordered else "end"

    @cached_property
    def matches(self) -> DataFrame:
        """s_idx, t_idx, via of all rows; the joined rows are written, so only these columns are read."""
        return self.joined.select("s_idx", "t_idx", "via")

    @cached_property
    def moves(self) -> DataFrame:
        return stage(moved_rows(self.matches.where("s_idx is not null and t_idx is not null")), "moves")

    @cached_property
    def classified(self) -> DataFrame:
        """A row for each report row, in no order: kind, moved, flags and values."""
        rows = self.joined
        if not self.tracks_moves:
            return rows.withColumn("move_distance", F.lit(0).cast("long")).withColumn("moved", F.lit(False))
        rows = rows.join(self.moves.withColumn("moved", F.lit(True)), "t_idx", "left")
        return rows.withColumn("moved", F.coalesce("moved", F.lit(False))).withColumn("move_distance", F.coalesce("move_distance", F.lit(0)))

    def ordered_rows(self, changes_only: bool = False) -> DataFrame:
        """``classified`` with report_pos. For the whole report positions are found from row numbers alone and joined once; of a part, from the part."""
        if changes_only:
            return reporting.positioned(reporting.placed(self.classified, self.matches, self.placement).where(~self.quiet))
        name = F.coalesce("t_idx", -1 - F.col("s_idx")).alias("_row")
        places = reporting.positioned(reporting.placed(self.matches.select("s_idx", "t_idx"), self.matches, self.placement))
        return self.classified.withColumn("_row", name).join(places.select(name, "bucket", "side", "report_pos"), "_row").drop("_row")

    @cached_property
    def _indexes(self) -> dict[bool, DataFrame]:
        return {}

    def index(self, changes_only: bool = False) -> DataFrame:
        """``ordered_rows`` written once in order, so that a page, the next change and a walk through the rows read only their part."""
        if changes_only not in self._indexes:
            rows = self.ordered_rows(changes_only)
            self._indexes[changes_only] = stage(rows.repartitionByRange("report_pos").sortWithinPartitions("report_pos"), "report")
        return self._indexes[changes_only]

    def first_rows(self, most: int, changes_only: bool = False) -> DataFrame:
        """The first ``most`` of ``ordered_rows``: each task passes on its own first ones, nothing else is numbered."""
        rows = reporting.placed(self.classified, self.matches, self.placement)
        rows = rows.where(~self.quiet) if changes_only else rows
        return reporting.positioned(rows.orderBy("bucket", "side", F.coalesce("t_idx", "s_idx")).limit(most))

    @property
    def quiet(self) -> Column:
        return (F.col("kind") == "unchanged") & ~F.col("moved") & (F.col("suppressed_cells") == 0) & (F.col("finding_cells") == 0)

    def report(self, changes_only: bool = False, include_values: bool = True, indexed: bool = False) -> DataFrame:
        """The versioned report: one row for each target row and each deleted row; from the written ``index`` if ``indexed``."""
        rows = self.index(changes_only) if indexed else self.ordered_rows(changes_only)
        keys = F.array(*[F.coalesce(f"t{i}", f"s{i}") for i in self.model.key_columns]) if self.model.key_columns else F.lit(None).cast("array<string>")
        cells = [reporting.cells_of(self.model).alias("cells")] if include_values else []
        return rows.select(
            "report_pos", F.lit(SCHEMA_VERSION).alias("schema_version"), "kind", "moved", F.col("move_distance").cast("int").alias("move_distance"),
            F.col("s_row").alias("source_row"), F.col("t_row").alias("target_row"),
            "changed_cells", "suppressed_cells", "finding_cells", keys.alias("key"), *cells, reporting.finding_list(self.model).alias("findings"),
        )

    def rows(self, **how):
        """Report rows in order, one at a time, on the driver."""
        return self.report(indexed=True, **how).orderBy("report_pos").toLocalIterator()

    def page(self, start: int, size: int, changes_only: bool = False) -> DataFrame:
        """Report rows from position ``start``."""
        start = max(0, start)
        return self.report(changes_only, indexed=True).where((F.col("report_pos") >= start) & (F.col("report_pos") < start + max(0, size)))

    def find_next_change(self, after: int, most: int = 100_000) -> int | None:
        """Position of the first row behind ``after`` that isn't plainly unchanged, among the next ``most``."""
        rows = self.index().where((F.col("report_pos") > after) & (F.col("report_pos") <= after + most)).where("kind <> 'unchanged' or moved")
        return rows.agg(F.min("report_pos")).first()[0]

    def cells(self, flag: int = reporting.CHANGED) -> DataFrame:
        """kind, rows, key, column, name, source and target of every cell with the flag."""
        cells = reporting.cells_of(self.model)
        rows = self.classified.where(" or ".join(f"f{i} & {flag} <> 0" for i in range(self.model.width)))
        keys = F.concat_ws("|", *[F.coalesce(f"t{i}", f"s{i}") for i in self.model.key_columns]) if self.model.key_columns else F.lit(None).cast("string")
        one = rows.select("kind", F.col("s_row").alias("source_row"), F.col("t_row").alias("target_row"), keys.alias("key"), F.explode(F.filter(cells, lambda c: c["flags"].bitwiseAND(flag) != 0)).alias("c"))
        return one.select("kind", "source_row", "target_row", "key", "c.column", "c.name", "c.source", "c.target")

    def changes_by_column(self) -> DataFrame:
        """name, n: changed cells of each column."""
        return self.cells().groupBy("name").agg(F.count("*").alias("n"))

    def findings(self) -> DataFrame:
        """source_row, target_row, key and the finding, a row for each."""
        keys = F.concat_ws("|", *[F.coalesce(f"t{i}", f"s{i}") for i in self.model.key_columns]) if self.model.key_columns else F.lit(None).cast("string")
        return self.classified.where("finding_cells > 0").select("kind", F.col("s_row").alias("source_row"), F.col("t_row").alias("target_row"), keys.alias("key"),
            F.explode(reporting.finding_list(self.model)).alias("f")).select("kind", "source_row", "target_row", "key", "f.column", "f.name",
            F.col("f.kind").alias("finding"), "f.limit", "f.precision", "f.scale")

    def segments(self, mode: str = "word", cap: int = 4096) -> DataFrame:
        """``cells()`` with the segments inside each changed cell."""
        return self.cells().withColumn("segments", cell_segments(F.col("source"), F.col("target"), mode, cap))

    def counts(self) -> DataFrame:
        """One row of all counts: a single aggregate over the joined rows."""
        n = self.model.width
        having = lambda flag: sum((F.when(F.col(f"f{i}").bitwiseAND(flag) != 0, 1).otherwise(0) for i in range(n)), F.lit(0))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        kinds = [total((F.col("kind") == k).cast("int")).alias(k) for k in ("unchanged", "modified", "added", "deleted")]
        return self.classified.agg(
            *kinds, total(F.col("moved").cast("int")).alias("moved"), F.count("*").alias("report"), total("changed_cells").alias("changed"),
                total("suppressed_cells").alias("suppressed"), total((F.col("finding_cells") > 0).cast("int")).alias("finding_rows"),
            *[total(having(flag)).alias(name) for flag, name in reporting.FINDINGS],
            total(((F.col("via") == "likeness") & F.col("s_idx").isNotNull() & F.col("t_idx").isNotNull()).cast("int")).alias("paired"),
        )

    @cached_property
    def summary(self) -> dict:
        c = self.counts().first()
        return {
            "schemaVersion": SCHEMA_VERSION, "identical": not (c.modified or c.added or c.deleted or c.moved),
            "rows": {k: c[k] for k in ("unchanged", "modified", "added", "deleted", "moved", "report")}, "cells": {"changed": c.changed, "suppressed": c.suppressed},
            "findings": {"total": c.requiredEmpty + c.tooLong + c.notNumeric + c.precision, "rows": c.finding_rows, **{k: c[k] for _, k in reporting.FINDINGS},
            "enabled": self.options.validate},
            "matching": {"allKeys": not self.model.key_columns, "pairedBySimilarity": c.paired, "pairingTruncated": self.truncated,
            "movesForcedOff": self.options.detect_moves and not self.options.source_ordered},
            "columns": {"compared": self.model.width, "added": len(self.plan.added), "removed": len(self.plan.removed)},
            "targetHeader": {"rows": self.target_rows, "namesOnly": self.target_rows == 1},
            "schemaFindings": self.schema_findings, "schemaFindingCount": self.schema_finding_count,
        }

    def emit(self, format: str, options: EmitOptions = EmitOptions()) -> DataFrame:
        """part (0 head, 1 rows, 2 foot), report_pos, line (0 or 1), value: the lines of a jsonl, csv, html or summary report; ``emit_text`` and ``write`` put them in order."""
        from ..sinks import emitters

        return emitters.emit(self, format, options)

    def emit_text(self, format: str, options: EmitOptions = EmitOptions()) -> str:
        from ..sinks import emitters

        return emitters.text(self, format, options)

    def write(self, path: str, format: str, options: EmitOptions = EmitOptions()) -> None:
        """Text files whose concatenation in order of name is the report."""
        from ..sinks import emitters

        emitters.write(self, path, format, options)

    def present(self, layout: str = "unified", changes_only: bool = False) -> DataFrame:
        from .present import present

        return present(self, layout, changes_only)


def compare(spark: SparkSession, source: Source | DataFrame, target: Source | DataFrame, options: DiffOptions = DiffOptions(), source_dialect: Dialect = Dialect(),
    target_dialect: Dialect | None = None, limits: Limits = Limits()) -> Diff:
    """Compare two sources; the source's header is the authority. Raises ReconcileError for what can't be compared: headers, broken input, duplicate keys."""
    source, target = (Source.dataframe(x) if isinstance(x, DataFrame) else x for x in (source, target))
    with ThreadPoolExecutor(2) as both:  # the two sides are read and numbered side by side; what is wrong with the source is told first
        opened = [both.submit(inheritable_thread_target(spark)(side.open), spark, dialect, limits) for side, dialect in ((source, source_dialect), (target, target_dialect or source_dialect))]
        s = opened[0].result()
        model = s.model or resolve_source(s.first, options.header)
        if options.require_key and not model.key_columns:
            raise ReconcileError("MISSING_KEY_COLUMN", "the source declares no key column")
        t = opened[1].result()
    policy = options.compare
    if not t.first and not t.width and model.rows:
        raise ReconcileError("NO_HEADER", "the target has no rows, so no header")
    t_rows, plan = find_target_header(t.first[:LOOK], model, policy.allow_added_columns, policy.allow_removed_columns)
    if t.model is not None:
        t_rows = t.model.rows
    left = _body(s, plan.source, model.rows, "s")
    right = _body(t, plan.target, t_rows, "t")
    findings = [{"kind": "columnAdded", "column": c, "name": t.first[t_rows - 1][c]} for c in plan.added] + [{"kind": "columnRemoved", "column": c, "name": model.label(c)} for c in plan.removed]
    disagreements = metadata_disagreements(model, t.first, t_rows, plan.projected)
    compared = model.project(plan.source)
    diff = joined_rows(left, right, compared, options)
    return Diff(compared, options, diff[0], plan, t_rows, s.stats, t.stats, diff[1], findings + disagreements[: max(0, MOST_SCHEMA_FINDINGS - len(findings))], len(findings) + len(disagreements))


def joined_rows(left: DataFrame, right: DataFrame, model: HeaderModel, options: DiffOptions) -> tuple[DataFrame, bool]:
    """Source and target rows side by side, each row of either once, with their kinds and flags, written once; whether pairing by likeness gave up early."""
    finish = lambda rows: reporting.classified(rows, model, options)
    if model.key_columns:
        return match.by_key(left, right, model, options, finish), False
    joined, short = match.by_content(left, right, model, options), False
    if options.similarity:
        joined, short = match.by_likeness(stage(joined, "joined"), model, options)
    return stage(finish(joined), "classified"), short
