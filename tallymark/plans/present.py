"""The report laid out for display: one or two presentation rows for each report row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYOUTS = ("inline", "stacked", "unified", "sideBySide")


def present(diff, layout: str = "unified", changes_only: bool = False) -> DataFrame:
    """report_pos, line, pane, role, marker, moved, number and cells (name, text, old, changed).

    inline: one row whose changed cells hold both values. stacked: a modified row's new values over its old ones, of which only changed cells show.
    unified: a modified row is a deleted and an added one. sideBySide: a row in either pane, with gaps where a side is absent.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"no such layout: {layout}")
    r = diff.report(changes_only)
    new = lambda c: F.coalesce(c["target"], c["source"])
    old = lambda c: F.coalesce(c["source"], c["target"])
    cell = lambda c, text, was=None: F.struct(c["name"].alias("name"), text.alias("text"), (was if was is not None else F.lit(None).cast("string")).alias("old"), c["changed"].alias("changed"))
    marker = lambda role: F.when(role == "modified", "~").when(role == "added", "+").when(role == "deleted", "-").otherwise(" ")

    def row(line: int, pane, role, number, cells):
        return F.struct(F.lit(line).alias("line"), F.lit(pane).cast("string").alias("pane"), role.alias("role"), number.cast("long").alias("number"), cells.alias("cells"))

    kind, gap = F.col("kind"), F.lit("gap")
    empty = F.transform("cells", lambda c: cell(c, F.lit("")))
    after, before = F.transform("cells", lambda c: cell(c, new(c))), F.transform("cells", lambda c: cell(c, old(c)))
    number = F.coalesce("target_row", "source_row")
    if layout == "inline":
        lines = F.array(row(0, None, kind, number, F.transform("cells", lambda c: cell(c, new(c), F.when(c["changed"], c["source"])))))
    elif layout == "stacked":
        under = F.transform("cells", lambda c: cell(c, F.when(c["changed"], c["source"]).otherwise("")))
        lines = F.when(kind == "modified", F.array(row(0, None, kind, number, after), row(1, None, kind, F.col("source_row"), under))).otherwise(F.array(row(0, None, kind, number, after)))
    elif layout == "unified":
        lines = F.when(kind == "modified", F.array(row(0, None, F.lit("deleted"), F.col("source_row"), before),
            row(1, None, F.lit("added"), F.col("target_row"), after))).otherwise(F.array(row(0, None, kind, number, after)))
    else:
        left = F.when(kind == "added", row(0, "source", gap, F.lit(None), empty)).otherwise(row(0, "source", kind, F.col("source_row"), before))
        right = F.when(kind == "deleted", row(1, "target", gap, F.lit(None), empty)).otherwise(row(1, "target", kind, F.col("target_row"), after))
        lines = F.array(left, right)
    out = r.select("report_pos", "moved", F.explode(lines).alias("p"))
    return out.select("report_pos", "p.line", "p.pane", "p.role", F.concat(F.when(F.col("moved"), F.lit("↕")).otherwise(""), marker(F.col("p.role"))).alias("marker"), "moved", "p.number", "p.cells")
