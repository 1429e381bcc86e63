"""Settings, with their defaults."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .errors import ReconcileError


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    strip_bom: bool = True

    def __post_init__(self):
        if len(self.delimiter.encode()) != 1 or len(self.quote.encode()) != 1:
            raise ReconcileError("INVALID_ARG", "delimiter and quote are one byte each")
        if self.delimiter == self.quote or {self.delimiter, self.quote} & {"\r", "\n"}:
            raise ReconcileError("INVALID_ARG", "delimiter and quote must differ and can't be line ends")


@dataclass(frozen=True)
class Limits:
    """None: no limit."""

    max_bytes: int | None = 150 * 1024 * 1024
    max_rows: int | None = None
    max_columns: int | None = None


@dataclass(frozen=True)
class HeaderLayout:
    """Header rows above the data, and which (from 1) holds what; 0 where there is none. Without a statement, the rows are, in order, key, required, type, name, the last always being the names."""

    rows: int = 4
    key: int | None = None
    required: int | None = None
    type: int | None = None
    name: int | None = None

    def __post_init__(self):
        if not 0 <= self.rows <= 64:
            raise ReconcileError("INVALID_ARG", f"header rows must be 0 to 64, not {self.rows}")
        for i, part in enumerate(("key", "required", "type"), 1):
            if getattr(self, part) is None:  # the name row is never read for markers
                object.__setattr__(self, part, i if self.rows > i else 0)
        if self.name is None:
            object.__setattr__(self, "name", self.rows)
        for part in ("key", "required", "type", "name"):
            if getattr(self, part) > self.rows:
                raise ReconcileError("INVALID_ARG", f"the {part} row {getattr(self, part)} is beyond the {self.rows} header rows")


@dataclass(frozen=True)
class CompareOptions:
    trim: bool = True
    char_ignore_pad: bool = True
    numeric: bool = True
    booleans: bool = True
    true_words: str = "TRUE,T,YES,Y,1"
    false_words: str = "FALSE,F,NO,N,0"
    date_compare: str = "exact"
    #: only texts with a colon before the dot count as timestamps; off, any text that ends in .digits does
    timestamp_strict: bool = False
    allow_added_columns: bool = False
    allow_removed_columns: bool = False
    #: name of a column -> function of a trimmed Column that gives the form to compare
    comparators: dict = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if self.date_compare != "exact":
            raise ReconcileError("UNIMPLEMENTED", "dates are compared as text only")


@dataclass(frozen=True)
class DiffOptions:
    compare: CompareOptions = CompareOptions()
    header: HeaderLayout = HeaderLayout()
    detect_moves: bool = True
    source_ordered: bool = True
    count_suppressed: bool = True
    validate: bool = True
    require_key: bool = False
    #: anchored: a deletion stands after the last matched row before it; end: after all others
    deleted: str = "anchored"
    similarity: bool = True
    similarity_k: int | None = None
    similarity_percent: int | None = None
    max_pair_work: int | None = None
    #: pairing by likeness ends only when every row has been looked at, whatever the work; ``max_pair_work`` is without effect then
    pair_all: bool = False

    def __post_init__(self):
        if self.deleted not in ("anchored", "end"):
            raise ReconcileError("INVALID_ARG", f"deleted rows stand anchored or at the end, not {self.deleted}")

    @property
    def k(self) -> int:
        return 16 if self.similarity_k is None else min(4096, max(1, self.similarity_k))

    @property
    def percent(self) -> int:
        return 50 if self.similarity_percent is None else min(100, max(0, self.similarity_percent))

    @property
    def work(self) -> int | None:
        return None if self.pair_all else self.max_pair_work or 4_000_000


CLASS_PREFIX = re.compile(r"[A-Za-z][A-Za-z0-9_-]{0,31}\Z")


@dataclass(frozen=True)
class EmitOptions:
    changes_only: bool = False
    include_values: bool = True
    #: none, word, character or both: marking of changes inside cells, in HTML
    cell_diff: str = "none"
    max_cell_bytes: int = 0
    max_rows: int = 0
    csv_guard: bool = True
    csv_delimiter: str = ","
    class_prefix: str = "tally"

    def __post_init__(self):
        if not CLASS_PREFIX.match(self.class_prefix):
            raise ReconcileError("INVALID_ARG", "a class prefix is a letter and up to 31 letters, digits, _ or -")
        if self.cell_diff not in ("none", "word", "character", "both"):
            raise ReconcileError("INVALID_ARG", f"no such cell diff: {self.cell_diff}")
        if len(self.csv_delimiter.encode()) != 1 or self.csv_delimiter in '"\r\n':
            raise ReconcileError("INVALID_ARG", "a CSV delimiter is one byte and no quote or line end")
