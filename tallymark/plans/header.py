"""Header rows, and how a target's columns line up with the source's. Driver only: a few rows each."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..errors import ReconcileError
from ..functions.declared import DeclaredType, parse_type
from ..options import HeaderLayout

PAD = " \t"
#: rows of a target in which its header is looked for
LOOK = 8


@dataclass(frozen=True)
class HeaderModel:
    """The columns of a table. names is None where there is no name row."""

    width: int
    names: tuple[str, ...] | None
    key: tuple[bool, ...]
    required: tuple[bool, ...]
    types: tuple[DeclaredType, ...]
    #: header rows above the data
    rows: int = 0
    #: the header rows' cells, and the rows (from 1) of the markers, types and names; 0: none
    cells: tuple[tuple[str, ...], ...] = ()
    layout: HeaderLayout = field(default_factory=lambda: HeaderLayout(rows=0))

    @property
    def key_columns(self) -> list[int]:
        return [i for i, k in enumerate(self.key) if k]

    def label(self, i: int) -> str:
        return self.names[i] if self.names else f"column_{i + 1}"

    def project(self, columns: list[int]) -> HeaderModel:
        pick = lambda x: tuple(x[i] for i in columns)
        return replace(self, width=len(columns), names=pick(self.names) if self.names else None, key=pick(self.key), required=pick(self.required), types=pick(self.types))


class Header:
    """Declares the columns of rows that carry no header themselves."""

    def __init__(self, columns: list[tuple[str, str, bool, bool]]):
        self.columns = columns

    @classmethod
    def names_only(cls, *names: str) -> Header:
        return cls([(n, "", False, False) for n in names])

    @classmethod
    def of(cls, *columns: tuple) -> Header:
        """(name[, type[, key[, required]]]) for each column."""
        return cls([(*c, *("", False, False)[len(c) - 1 :]) for c in ((c,) if isinstance(c, str) else tuple(c) for c in columns)])

    @classmethod
    def of_rows(cls, *rows: list[str]) -> Header:
        """One row of names, or four rows: key markers, required markers, types, names."""
        if len(rows) == 1:
            return cls.names_only(*rows[0])
        if len(rows) != 4 or len({len(r) for r in rows}) != 1:
            raise ReconcileError("INVALID_ARG", "a header is one row, or four of one width")
        return cls([(n, t, _marks(k, "KEY"), _marks(q, "REQUIRED")) for k, q, t, n in zip(*rows, strict=True)])

    @classmethod
    def builder(cls) -> HeaderBuilder:
        return HeaderBuilder()

    @property
    def names(self) -> list[str]:
        return [c[0] for c in self.columns]

    def model(self) -> HeaderModel:
        if not self.columns:
            raise ReconcileError("INVALID_ARG", "a header needs a column")
        plain = all(not t and not k and not q for _, t, k, q in self.columns)
        rows = tuple(zip(*self.rows(), strict=True)) and tuple(tuple(r) for r in self.rows())
        return HeaderModel(len(self.columns), tuple(self.names), tuple(c[2] for c in self.columns), tuple(c[3] for c in self.columns),
            tuple(parse_type(c[1]) for c in self.columns), len(rows), rows, HeaderLayout(rows=1 if plain else 4))

    def rows(self) -> list[list[str]]:
        if all(not t and not k and not q for _, t, k, q in self.columns):
            return [self.names]
        return [["KEY" if k else "" for _, _, k, _ in self.columns], ["REQUIRED" if q else "" for *_, q in self.columns], [t for _, t, _, _ in self.columns], self.names]


class HeaderBuilder:
    def __init__(self):
        self._columns: list[list] = []

    def column(self, name: str, type: str = "") -> HeaderBuilder:
        self._columns.append([name, type, False, False])
        return self

    def key(self) -> HeaderBuilder:
        self._columns[-1][2] = True
        return self

    def required(self) -> HeaderBuilder:
        self._columns[-1][3] = True
        return self

    def keys(self, *names: str) -> HeaderBuilder:
        unknown = set(names) - {c[0] for c in self._columns}
        if unknown:
            raise ReconcileError("INVALID_ARG", f"no such columns: {sorted(unknown)}")
        for c in self._columns:
            c[2] |= c[0] in names
        return self

    def build(self) -> Header:
        return Header([tuple(c) for c in self._columns])


def _marks(cell: str, word: str) -> bool:
    return cell.strip(PAD).upper() == word


def resolve_source(first: list[list[str]], layout: HeaderLayout) -> HeaderModel:
    """Columns from a source's first rows. Any text but the marker leaves a column unmarked."""
    if len(first) < layout.rows:
        raise ReconcileError("NO_HEADER", f"the source has {len(first)} rows; its header takes {layout.rows}")
    width = len(first[0]) if first else 0
    row = lambda n: first[n - 1] if n else [""] * width
    names = tuple(row(layout.name)) if layout.name else None
    return HeaderModel(
        width, names, tuple(_marks(c, "KEY") for c in row(layout.key)), tuple(_marks(c, "REQUIRED") for c in row(layout.required)),
            tuple(parse_type(c) for c in row(layout.type)), layout.rows, tuple(map(tuple, first[: layout.rows])), layout
    )


def _same(a, b) -> bool:
    return [x.strip(PAD) for x in a] == [x.strip(PAD) for x in b]


@dataclass(frozen=True)
class ColumnPlan:
    """Which columns are compared, by their places on either side, and what only one side has."""

    source: list[int]
    target: list[int]
    added: list[int]
    removed: list[int]

    @property
    def projected(self) -> bool:
        return bool(self.added or self.removed)


def merge_names(source: list[str], target: list[str], allow_added: bool, allow_removed: bool) -> ColumnPlan | None:
    """Walks both lists in order; a name that only one side has is added or removed where allowed. Columns that changed places never fit."""
    s, t = [n.strip(PAD) for n in source], [n.strip(PAD) for n in target]
    plan, i, j = ColumnPlan([], [], [], []), 0, 0
    while i < len(s) or j < len(t):
        if i < len(s) and j < len(t) and s[i] == t[j]:
            plan.source.append(i)
            plan.target.append(j)
            i, j = i + 1, j + 1
        elif j < len(t) and t[j] not in s[i:]:
            if not allow_added or t[j] in s:
                return None
            plan.added.append(j)
            j += 1
        elif i < len(s) and s[i] not in t[j:]:
            if not allow_removed or s[i] in t:
                return None
            plan.removed.append(i)
            i += 1
        else:
            return None
    return plan


def find_target_header(first: list[list[str]], source: HeaderModel, allow_added: bool, allow_removed: bool) -> tuple[int, ColumnPlan]:
    """(header rows of the target, column plan): the first of its first rows that holds the source's names."""
    whole = list(range(source.width))
    if source.names is None:
        if first and len(first[0]) != source.width:
            raise ReconcileError("COLUMN_ORDER", f"the source has {source.width} columns, the target {len(first[0])}")
        return source.rows, ColumnPlan(whole, whole, [], [])
    for n, row in enumerate(first[:LOOK], 1):
        if _same(row, source.names):
            return n, ColumnPlan(whole, whole, [], [])
    if allow_added or allow_removed:
        best = None
        for n, row in enumerate(first[:LOOK], 1):
            plan = merge_names(list(source.names), row, allow_added, allow_removed)
            if plan and plan.source and (best is None or len(plan.source) > len(best[1].source)):
                best = n, plan
        if best:
            lost = [source.label(i) for i in best[1].removed if source.key[i]]
            if lost:
                raise ReconcileError("MISSING_KEY_COLUMN", f"the target lacks the key column {lost[0]}")
            return best
    raise _mismatch(first, source)


def _mismatch(first: list[list[str]], source: HeaderModel) -> ReconcileError:
    names = [n.strip(PAD) for n in source.names or ()]
    if not first:
        return ReconcileError("NO_HEADER", "the target has no rows, so no header")
    likeness = [len(set(names) & {c.strip(PAD) for c in row}) for row in first[:LOOK]]
    n = max(range(len(likeness)), key=lambda i: (likeness[i], -i))
    row = [c.strip(PAD) for c in first[n]]
    if not likeness[n] or 2 * likeness[n] < min(len(names), len(row)):
        return ReconcileError("NO_HEADER", f"no row among the target's first {min(LOOK, len(first))} resembles the source's column names")
    if len(row) != len(names):
        return ReconcileError("COLUMN_ORDER", f"the source has {len(names)} columns, the target's row {n + 1} has {len(row)}")
    at = next(i for i, (a, b) in enumerate(zip(names, row, strict=True)) if a != b)
    if sorted(row) == sorted(names):
        return ReconcileError("COLUMN_ORDER", f"the target has the source's columns in another order, first at column {at + 1}: {names[at]!r} against {row[at]!r}")
    return ReconcileError("COLUMN_ORDER", f"column {at + 1} is {names[at]!r} in the source and {row[at]!r} in the target")


def metadata_disagreements(source: HeaderModel, target: list[list[str]], target_rows: int, projected: bool) -> list[dict]:
    """Cells of the key, required and type rows that differ; only where both name rows stand at one place below others and no column is left out."""
    if projected or source.names is None or source.layout.name != target_rows or target_rows < 2:
        return []
    out = []
    for part in ("key", "required", "type"):
        n = getattr(source.layout, part)
        if n and n <= len(target) and n < target_rows:
            out += [{"kind": "metadataDisagreement", "row": part, "column": i, "name": source.label(i), "source": a, "target": b} for i,
                (a, b) in enumerate(zip(source.cells[n - 1], target[n - 1], strict=False)) if a != b]
    return out
