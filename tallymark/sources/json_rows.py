"""A JSON array of flat objects as rows; numbers keep their text, and anything irregular is an error with line and column."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from ..errors import ReconcileError

BLANK = re.compile(r"[ \t\r\n]*")


class _Text(str):
    """A literal kept as written."""


def _pairs(pairs: list[tuple]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise KeyError(k)
        out[k] = v
    return out


def _constant(name: str):
    raise ValueError(f"{name} is no JSON value")


def parse_rows(text: str, names: list[str]) -> Iterator[list[str]]:
    """Rows in the order of ``names``; null is the empty text, true and false are TRUE and FALSE. Objects are decoded one at a time."""
    decoder = json.JSONDecoder(object_pairs_hook=_pairs, parse_float=_Text, parse_int=_Text, parse_constant=_constant, strict=False)

    def fail(why: str, at: int):
        line = text.count("\n", 0, at) + 1
        return ReconcileError("BAD_CONTENT", f"{why} at line {line}, column {at - (text.rfind(chr(10), 0, at) + 1) + 1}")

    skip = lambda i: BLANK.match(text, i).end()
    at = skip(1 if text.startswith("﻿") else 0)
    if text[at : at + 1] != "[":
        raise fail("rows are a JSON array", at)
    at = skip(at + 1)
    known, number = set(names), 0
    while text[at : at + 1] != "]" or number:
        if text[at : at + 1] != "{":
            raise fail("a row is a JSON object" if at < len(text) else "the array ends too soon", at)
        try:
            row, end = decoder.raw_decode(text, at)
        except KeyError as e:
            raise fail(f"the key {e.args[0]!r} stands twice in the row", at) from None
        except json.JSONDecodeError as e:
            raise fail(e.msg, e.pos) from None
        except ValueError as e:
            raise fail(str(e), at) from None
        unknown, missing = set(row) - known, known - set(row)
        if unknown or missing:
            raise fail(f"unknown key {sorted(unknown)[0]!r}" if unknown else f"missing key {sorted(missing)[0]!r}", at)
        nested = next((k for k, v in row.items() if isinstance(v, (dict, list))), None)
        if nested is not None:
            raise fail(f"the value of {nested!r} is nested", at)
        yield ["" if (v := row[n]) is None else ("TRUE" if v else "FALSE") if isinstance(v, bool) else str(v) for n in names]
        number += 1
        at = skip(end)
        if text[at : at + 1] == ",":
            at = skip(at + 1)
        elif text[at : at + 1] == "]":
            break
        else:
            raise fail("a comma or the array's end is missing" if at < len(text) else "the array ends too soon", at)
    at = skip(at + 1)
    if at < len(text):
        raise fail("something follows the array", at)
