"""Declared column types."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: fixed values: spellings of each type
SPELLINGS = {
    "VARCHAR": ("VARCHAR", "VARCHAR2", "TEXT", "STRING", "CHARACTER VARYING"),
    "CHAR": ("CHAR", "CHARACTER"),
    "DECIMAL": ("DECIMAL", "NUMERIC", "NUMBER", "FLOAT", "REAL", "DOUBLE", "DOUBLE PRECISION"),
    "INTEGER": ("INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT"),
    "BOOLEAN": ("BOOL", "BOOLEAN"),
    "DATE": ("DATE",),
    "TIMESTAMP": ("TIMESTAMP", "DATETIME"),
}
KIND_OF = {word: kind for kind, words in SPELLINGS.items() for word in words}
LONGEST, MOST = 40, 100_000_000


@dataclass(frozen=True)
class DeclaredType:
    """size and scale are -1 where not declared; they bear on findings only."""

    kind: str = "UNKNOWN"
    size: int = -1
    scale: int = -1

    @property
    def numeric(self) -> bool:
        return self.kind in ("DECIMAL", "INTEGER")

    @property
    def text(self) -> bool:
        return self.kind in ("VARCHAR", "CHAR")


def _number(digits: str) -> int:
    """Digits are taken as long as the number is below MOST."""
    if not digits:
        return -1
    n = 0
    for d in digits:
        if n < MOST:
            n = n * 10 + int(d)
    return n


def parse_type(text: str | None) -> DeclaredType:
    """A type row's cell; what isn't known, or is longer than 40 bytes, is UNKNOWN, and a malformed suffix is no error."""
    head, paren, rest = (text or "").partition("(")
    name = re.sub(r"[ \t]+", " ", head.strip(" \t"))
    kind = KIND_OF.get("".join(chr(ord(c) - 32) if "a" <= c <= "z" else c for c in name), "UNKNOWN") if len(name.encode()) <= LONGEST else "UNKNOWN"
    m = re.match(r"[ \t]*([0-9]*)[ \t]*(?:,[ \t]*([0-9]*))?", rest) if paren else None
    return DeclaredType(kind, _number(m[1]), _number(m[2] or "")) if m else DeclaredType(kind)
