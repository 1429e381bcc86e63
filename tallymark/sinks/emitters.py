"""Reports as text: JSON Lines, CSV, HTML and a summary."""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ReconcileError
from ..functions.normalize import truncated
from ..functions.segments import DELETE, EQUAL, segments
from ..operators import report
from ..options import EmitOptions
from ..sources.strict_csv import PRIVATE, bytes_of

FORMATS = ("jsonl", "csv", "html", "summary")
#: fixed values: the meta columns of a CSV report
META = ("schemaVersion", "kind", "side", "moved", "moveDistance", "sourceRow", "targetRow", "changedCells", "findings")
MOST_SEGMENTS = 128
#: bytes that a report is passed on by, and report rows of which the driver holds the lines at a time
PIECE, HELD_ROWS = 1 << 20, 50_000
#: stand-ins for bytes that were not UTF-8
BROKEN = f"[{chr(PRIVATE)}-{chr(PRIVATE + 255)}]"
BROKEN_RE = re.compile(f"{BROKEN}+")


def json_escaped(c: Column) -> Column:
    """Inside of a JSON string: short escapes, other control characters as \\u00xx in lower case, everything else as it is; broken bytes as \\ufffd."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, short in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(short))
    rest = out
    for code in range(32):
        if chr(code) not in "\n\r\t\b\f":
            rest = F.replace(rest, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    out = F.when(out.rlike("[\\x00-\\x1f]"), rest).otherwise(out)
    return F.when(out.rlike(BROKEN), F.regexp_replace(out, BROKEN, r"\\ufffd")).otherwise(out)


def html_escaped(c: Column) -> Column:
    out = c
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("\x00", "�")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def csv_quoted(c: Column, guard: bool = True, delimiter: str = ",") -> Column:
    """A CSV field: quoted for the delimiter, quotes, line ends and leading blanks; with ``guard``, what a spreadsheet would take for a formula gets an apostrophe.

    A formula starts with = + @, a tab or a CR, or with - unless a digit follows and the whole is a plain number; such a value is quoted even without the guard."""
    special = re.escape(delimiter)
    formula = c.rlike(r"(?s)^[=+@\t\r]") | (c.startswith("-") & ~c.rlike(r"^-[0-9]+[.]?[0-9]*\z"))
    quoted = F.concat(F.lit('"'), F.when(formula, F.lit("'" if guard else "")).otherwise(F.lit("")), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(formula | c.rlike(f'[{special}"\\n\\r]|^[ \\t]'), quoted).otherwise(c)


def _clipped(c: Column, most: int) -> Column:
    return truncated(c, most) if most > 0 else c


def _jsonl(diff, rows: DataFrame, o: EmitOptions) -> Column:
    null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    yes = lambda c: F.when(c, "true").otherwise("false")
    head = [F.lit('{"schemaVersion":1,"kind":"'), F.col("kind"), F.lit('","sourceRow":'), null("s_row"), F.lit(',"targetRow":'), null("t_row"), F.lit(',"moved":'),
        yes(F.col("moved")), F.lit(',"moveDistance":'), F.col("move_distance").cast("string")]
    name = lambda i: _json_text(diff.model.label(i))
    if o.include_values:
        cells = []
        for i in range(diff.model.width):
            flag, s, t = F.col(f"f{i}"), F.col(f"s{i}"), F.col(f"t{i}")
            differs = F.col("t_idx").isNull() | (flag.bitwiseAND(report.CHANGED | report.SUPPRESSED) != 0)
            shown = lambda v, key: F.concat(F.lit(f',"{key}":"'), json_escaped(_clipped(v, o.max_cell_bytes)), F.lit('"'))
            part = [F.lit(f'{{"name":"{name(i)}"'), F.when(differs & s.isNotNull(), shown(s, "source")).otherwise(""),
                F.when(t.isNotNull(), shown(t, "target")).otherwise(""), F.when(flag.bitwiseAND(report.CHANGED) != 0, ',"changed":true').otherwise(""),
                F.when(flag.bitwiseAND(report.SUPPRESSED) != 0, ',"suppressed":true').otherwise("")]
            used = [F.when(differs, s), t]
            if o.max_cell_bytes > 0:
                part.append(F.when(F.greatest(*[F.coalesce(F.octet_length(u), F.lit(0)) for u in used]) > o.max_cell_bytes, ',"truncated":true').otherwise(""))
            part.append(F.when(F.coalesce(used[0].rlike(BROKEN), F.lit(False)) | F.coalesce(t.rlike(BROKEN), F.lit(False)), ',"invalidUtf8":true').otherwise(""))
            cells.append(F.concat(*part, F.lit("}")))
        head += [F.lit(',"cells":['), F.concat_ws(",", *cells), F.lit("]")]

    def finding(f):
        extra = F.concat(F.when(f["kind"] == "tooLong", F.concat(F.lit(',"limit":'), f["limit"].cast("string"))).otherwise(""),
            F.when(f["kind"] == "precision", F.concat(F.lit(',"precision":'), f["precision"].cast("string"), F.lit(',"scale":'),
            f["scale"].cast("string"))).otherwise(""))
        return F.concat(F.lit('{"column":'), f["column"].cast("string"), F.lit(',"name":"'), json_escaped(f["name"]), F.lit('","kind":"'), f["kind"], F.lit('"'), extra, F.lit("}"))

    found = F.transform(report.finding_list(diff.model), finding)
    return F.concat(*head, F.when(F.col("finding_cells") > 0, F.concat(F.lit(',"findings":['), F.concat_ws(",", found), F.lit("]"))).otherwise(""), F.lit("}"))


def _json_text(s: str) -> str:
    out = json.dumps(s, ensure_ascii=False)[1:-1].replace("\x7f", "\x7f")
    return BROKEN_RE.sub(lambda m: "\\ufffd" * len(m[0]), out)


def _csv(diff, rows: DataFrame, o: EmitOptions) -> Column:
    """Array of one or two lines."""
    d = o.csv_delimiter
    put = lambda c: csv_quoted(c, o.csv_guard, d)
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def line(side: str, letter: str) -> Column:
        meta = [F.lit("1"), F.col("kind"), F.lit(side), F.when(F.col("moved"), "true").otherwise("false"), F.col("move_distance").cast("string"), number("s_row"),
            number("t_row"), F.col("changed_cells").cast("string"), F.size(report.finding_list(diff.model)).cast("string")]
        values = [put(_clipped(F.coalesce(F.col(f"{letter}{i}"), F.lit("")), o.max_cell_bytes)) for i in range(diff.model.width)] if o.include_values else []
        return F.concat_ws(d, *meta, *values)

    s, t = line("source", "s"), line("target", "t")
    return F.when(F.col("kind") == "modified", F.array(s, t)).when(F.col("kind") == "deleted", F.array(s)).otherwise(F.array(t))


def _escape(v: str) -> str:
    return BROKEN_RE.sub("�", v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;").replace("\x00", "�"))


def _clip(v: str, most: int) -> str:
    raw = v.encode()
    return v if not most or len(raw) <= most else raw[:most].decode(errors="ignore")


def html_cell(source: str | None, target: str | None, flag: int, o: EmitOptions) -> str:
    c = lambda *names: " ".join(f"{o.class_prefix}-{n}" for n in names)
    changed = bool(flag & report.CHANGED)
    names = ["cell", *["changed"] * changed, *["suppressed"] * bool(flag & report.SUPPRESSED), *["finding"] * bool(flag & report.FINDING)]
    first = next((f' data-finding="{kind}"' for bit, kind in report.FINDINGS if flag & bit), "")
    if changed and source is not None and target is not None:
        found = segments(source.encode(), target.encode(), o.cell_diff) if o.cell_diff != "none" else []
        if not found or len(found) > MOST_SEGMENTS:
            old, new = _escape(_clip(source, o.max_cell_bytes)), _escape(_clip(target, o.max_cell_bytes))
        else:
            s, t, old, new = source.encode(), target.encode(), "", ""
            for op, start, n in found:  # marked values are written whole
                if op == EQUAL:
                    same = _escape(s[start : start + n].decode(errors="replace"))
                    old, new = old + same, new + same
                elif op == DELETE:
                    old += f'<del class="{c("del")}">{_escape(s[start : start + n].decode(errors="replace"))}</del>'
                else:
                    new += f'<ins class="{c("ins")}">{_escape(t[start : start + n].decode(errors="replace"))}</ins>'
        inside = f'<span class="{c("old")}">{old}</span><span class="{c("new")}">{new}</span>'
    else:
        inside = _escape(_clip(target if target is not None else source or "", o.max_cell_bytes))
    return f'<td class="{c(*names)}"{first}>{inside}</td>'


def _html(diff, rows: DataFrame, o: EmitOptions) -> Column:
    n = diff.model.width
    p = lambda *names: " ".join(f"{o.class_prefix}-{x}" for x in names)
    mark = lambda c, name: F.when(c, f" {p(name)}").otherwise("")
    head = [F.lit(f'<tr class="{p("row")} {o.class_prefix}-'), F.col("kind"), mark(F.col("moved"), "moved"), mark(F.col("finding_cells") > 0, "finding"),
        F.lit(f'"><td class="{p("num")}">'), F.coalesce("t_row", "s_row").cast("string"), F.lit("</td>")]
    if not o.include_values:
        return F.concat(*head, F.lit("</tr>"))
    if o.cell_diff == "none":
        return F.concat(*head, *[plain_cell(F.col(f"s{i}"), F.col(f"t{i}"), F.col(f"f{i}"), o) for i in range(n)], F.lit("</tr>"))

    @F.pandas_udf("string")
    def render(flags: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series(["".join(html_cell(s[i], t[i], int(fl[i]), o) for i in range(n)) for fl, s, t in zip(flags, source, target, strict=True)])

    side = lambda c: F.array(*[F.col(f"{c}{i}") for i in range(n)])
    return F.concat(*head, render(F.array(*[F.col(f"f{i}") for i in range(n)]), side("s"), side("t")), F.lit("</tr>"))


def plain_cell(source: Column, target: Column, flag: Column, o: EmitOptions) -> Column:
    """``html_cell`` without marking inside changed cells."""
    c = lambda name: f"{o.class_prefix}-{name}"
    has = lambda bits: flag.bitwiseAND(bits) != 0
    name = lambda cond, word: F.when(cond, f" {c(word)}").otherwise("")
    found = F.lit("")
    for bit, kind in reversed(report.FINDINGS):
        found = F.when(has(bit), f' data-finding="{kind}"').otherwise(found)
    shown = lambda v: F.regexp_replace(html_escaped(_clipped(v, o.max_cell_bytes)), f"{BROKEN}+", "\ufffd")
    both = F.concat(F.lit(f'<span class="{c("old")}">'), shown(source), F.lit(f'</span><span class="{c("new")}">'), shown(target), F.lit("</span>"))
    inside = F.when(has(report.CHANGED) & source.isNotNull() & target.isNotNull(), both).otherwise(shown(F.coalesce(target, source, F.lit(""))))
    return F.concat(F.lit(f'<td class="{c("cell")}'), name(has(report.CHANGED), "changed"), name(has(report.SUPPRESSED), "suppressed"),
        name(has(report.FINDING), "finding"), F.lit('"'), found, F.lit(">"), inside, F.lit("</td>"))


def head_and_foot(diff, format: str, o: EmitOptions) -> tuple[list[str], list[str]]:
    p = o.class_prefix
    if format == "csv":
        names = ['"' + diff.model.label(i).replace('"', '""') + '"' for i in range(diff.model.width)] if o.include_values else []
        return [o.csv_delimiter.join([*META, *names])], []
    if format == "html":
        names = "".join(f'<th class="{p}-th">{_escape(diff.model.label(i))}</th>' for i in range(diff.model.width)) if o.include_values else ""
        return [f'<div class="{p}-report" data-schema-version="1"><table class="{p}-table">', f'<thead><tr><th class="{p}-th {p}-num">row</th>{names}</tr></thead>', "<tbody>"], ["</tbody></table></div>"]
    if format == "summary":
        return [summary_json(diff.summary)], []
    return [], []


def summary_json(summary: dict) -> str:
    return BROKEN_RE.sub(lambda m: "\\ufffd" * len(m[0]), json.dumps(summary, ensure_ascii=False, separators=(",", ":")))


def read_summary(text: str) -> dict:
    """A summary report read again; of this version only."""
    try:
        found = json.loads(text)
    except ValueError as e:
        raise ReconcileError("BAD_CONTENT", f"not a summary: {e}") from None
    if not isinstance(found, dict) or found.get("schemaVersion") != 1 or not isinstance(found.get("rows"), dict):
        raise ReconcileError("INVALID_ARG", "not a summary of version 1")
    return found


def lines(diff, format: str, o: EmitOptions = EmitOptions()) -> DataFrame:
    """report_pos, line, value of the rows' part of a report."""
    rows = diff.first_rows(o.max_rows, o.changes_only) if o.max_rows > 0 else diff.ordered_rows(o.changes_only)
    if format == "csv":
        return rows.select("report_pos", F.posexplode(_csv(diff, rows, o)).alias("line", "value"))
    value = _jsonl(diff, rows, o) if format == "jsonl" else _html(diff, rows, o)
    return rows.select("report_pos", F.lit(0).alias("line"), value.alias("value"))


def emit(diff, format: str, o: EmitOptions = EmitOptions()) -> DataFrame:
    if format not in FORMATS:
        raise ValueError(f"no such format: {format}")
    spark = diff.joined.sparkSession
    head, foot = head_and_foot(diff, format, o)
    ends = spark.createDataFrame([*[(0, -1, i, v) for i, v in enumerate(head)], *[(2, 2**62, i, v) for i, v in enumerate(foot)]], "part int, report_pos long, line int, value string")
    if format == "summary":
        return ends
    return lines(diff, format, o).select(F.lit(1).alias("part"), "report_pos", "line", "value").union(ends)


def text(diff, format: str, o: EmitOptions = EmitOptions()) -> str:
    """The whole report on the driver, a partition at a time."""
    return "".join(f"{r.value}\n" for r in emit(diff, format, o).orderBy("part", "report_pos", "line").toLocalIterator())


def emit_to(diff, stream, format: str, o: EmitOptions = EmitOptions()) -> int:
    """Write the report's bytes to a binary stream; returns how many. Bytes of the input that weren't UTF-8 come out of CSV as they went in.

    Lines are put together where they lie; the driver holds one partition's bytes at a time, of about ``HELD_ROWS`` rows, and passes them on in pieces."""

    def run(batches):
        for b in batches:
            whole = "\n".join([*b.column(0).to_pylist(), ""])
            raw = bytes_of(whole) if format == "csv" else whole.encode()
            for at in range(0, len(raw), PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([raw[at : at + PIECE]], pa.binary())], names=["piece"])

    n, order = 0, ["part", "report_pos", "line"]
    ordered = emit(diff, format, o).repartitionByRange(1 + diff.joined.count() // HELD_ROWS, *order).sortWithinPartitions(*order)
    for r in ordered.select("value").mapInArrow(run, "piece binary").toLocalIterator():
        n += stream.write(r.piece)
    return n


def restored(c: Column) -> Column:
    """Text in which stand-ins for bytes that were not UTF-8 are those bytes again; it may not be UTF-8 then."""
    raw = lambda b: F.lit(bytes([b])).cast("string")
    pairs = F.array(*[F.struct(F.lit(chr(PRIVATE + b)).alias("stand"), raw(b).alias("raw")) for b in range(128, 256)])
    return F.when(c.rlike(BROKEN), F.aggregate(pairs, c, lambda out, p: F.replace(out, p["stand"], p["raw"]))).otherwise(c)


def write(diff, path: str, format: str, o: EmitOptions = EmitOptions()) -> None:
    """A distributed sort, then one text file for each part. Bytes of the input that weren't UTF-8 come out of CSV as they went in."""
    ordered = emit(diff, format, o).orderBy("part", "report_pos", "line")
    ordered.select((restored(F.col("value")) if format == "csv" else F.col("value")).alias("value")).write.text(path)
