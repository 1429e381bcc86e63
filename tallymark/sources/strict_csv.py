"""Strict CSV: RFC 4180 with errors that name the place, and nothing repaired in silence."""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from functools import cache

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..errors import ReconcileError
from ..options import Dialect, Limits
from ..plans.storage import stage

#: bytes that are not UTF-8 become the last 256 code points, so differing bytes stay different and come back on output
PRIVATE = 0x10FF00
#: what those code points themselves are in UTF-8; their bytes get stand-ins too, so that nothing else looks like one
TAKEN = re.compile(rb"\xf4\x8f[\xbc-\xbf][\x80-\xbf]")
#: records, and bytes in their fields, of many texts that are passed on together
BATCH, BATCH_BYTES = 10_000, 1 << 22


def _keep(error: UnicodeError):
    if isinstance(error, UnicodeDecodeError):
        return "".join(chr(PRIVATE + b) for b in error.object[error.start : error.end]), error.end
    raise error


codecs.register_error("tallymark-keep", _keep)


def text_of(raw: bytes) -> str:
    out = raw.decode("utf-8", "tallymark-keep")
    if b"\xf4\x8f" in raw and TAKEN.search(raw):
        parts, at = [], 0
        for m in TAKEN.finditer(raw):
            parts += [raw[at : m.start()].decode("utf-8", "tallymark-keep"), *(chr(PRIVATE + b) for b in m[0])]
            at = m.end()
        out = "".join([*parts, raw[at:].decode("utf-8", "tallymark-keep")])
    return out


def bytes_of(text: str) -> bytes:
    """The bytes that ``text_of`` read."""
    if text.isascii() or max(map(ord, text)) < PRIVATE:
        return text.encode()
    return b"".join(bytes([ord(c) - PRIVATE]) if PRIVATE <= ord(c) <= PRIVATE + 255 else c.encode() for c in text)


@dataclass
class ParseStats:
    bytes: int = 0
    line_feeds: int = 0
    quotes: int = 0
    rows: int = 0
    fields: int = 0
    columns: int = 0
    quoted: int = 0
    escaped: int = 0
    multiline: int = 0
    ragged_normalized: int = 0
    blank_lines: int = 0


def sniff(data: bytes) -> None:
    """Refuse a web page or JSON in place of CSV."""
    head = data[:512].removeprefix(codecs.BOM_UTF8).lstrip(b" \t\r\n").lower()
    if head.startswith((b"<!doctype html", b"<html", b"<?xml", b"{", b"[")):
        raise ReconcileError("BAD_CONTENT", f"this is not CSV: it begins with {head[:16].decode('latin-1')!r}")


def inflated(data: bytes, encoding: str | None, most: int | None = None) -> bytes:
    """The bytes under an encoding. Inflating stops beyond ``most`` bytes, so a small file can't fill the memory."""
    if encoding in (None, "", "identity"):
        return data
    if encoding not in ("gzip", "deflate"):
        raise ReconcileError("INVALID_ARG", f"unknown encoding {encoding}")
    out: list[bytes] = []
    size = 0
    try:
        while data:
            worker = zlib.decompressobj(31 if encoding == "gzip" else 15)
            part = worker.decompress(data, 0 if most is None else most - size + 1)
            out.append(part)
            size += len(part)
            if most is not None and size > most:
                raise ReconcileError("TOO_LARGE", f"the inflated bytes are more than the limit of {most}")
            if not worker.eof:
                raise ReconcileError("BAD_CONTENT", f"the {encoding} data ends early")
            data = worker.unused_data if encoding == "gzip" else b""
    except zlib.error as e:
        raise ReconcileError("BAD_CONTENT", f"not {encoding} data: {e}") from None
    return b"".join(out)


@cache
def _fields(mark: bytes, delimiter: bytes) -> tuple[re.Pattern, re.Pattern]:
    """What a quoted and a bare field look like."""
    d, q = re.escape(delimiter), re.escape(mark)
    blanks = b"[ ]*" if delimiter == b"\t" else b"[\t]*" if delimiter == b" " else b"[ \t]*"
    quoted = re.compile(q + b"((?:[^" + q + b"]|" + q + q + b")*+)" + q + blanks)  # a pair of quotes is never taken apart
    return quoted, re.compile(b"[^" + d + b"\r\n]*")


def parse(data: bytes | Iterable[bytes], dialect: Dialect = Dialect(), limits: Limits = Limits(), stats: ParseStats | None = None) -> Iterator[list[bytes]]:
    """Records as lists of field values (quotes removed, pairs of quotes collapsed), from bytes or from chunks of them, wherever those are cut.

    LF, CRLF and CR end records, mixed too; an empty line is no record; blanks are data, but those between a closing quote and the next
    delimiter are skipped; a quote inside a bare field is data. Errors carry byte, row and field. Of chunks, only the field being read is held.
    """
    st = stats if stats is not None else ParseStats()
    chunks = iter((data,) if isinstance(data, bytes) else data)
    mark, pair, delimiter = dialect.quote.encode(), dialect.quote.encode() * 2, dialect.delimiter.encode()
    quoted, bare = _fields(mark, delimiter)
    held, at, passed, more = b"", 0, 0, True

    def longer() -> bool:
        """What is left, and another chunk behind it; False after the last."""
        nonlocal held, at, passed, more
        for chunk in chunks:
            if not chunk:
                continue
            st.bytes += len(chunk)
            st.line_feeds += chunk.count(b"\n")
            st.quotes += chunk.count(mark)
            if limits.max_bytes is not None and st.bytes > limits.max_bytes:
                raise ReconcileError("TOO_LARGE", f"{st.bytes} bytes are more than the limit of {limits.max_bytes}")
            held, passed, at = held[at:] + chunk, passed + at, 0
            return True
        more = False
        return False

    while len(held) < 3 and longer():
        pass
    if dialect.strip_bom and held.startswith(codecs.BOM_UTF8):
        at = 3
    record: list[bytes] = []
    any_quoted = False
    while at < len(held) or record or (more and longer()):
        is_quoted = held[at : at + 1] == mark
        m = (quoted if is_quoted else bare).match(held, at)
        # what ends a field, and the LF of a CRLF, must be in sight; a quote before the end may be the first of a pair
        if more and (m is None or m.end() + 2 > len(held)) and longer():
            continue
        if m is None:
            raise ReconcileError("UNTERMINATED_QUOTE", f"the quote opened in row {st.rows + 1}, field {len(record) + 1} is never closed")
        if is_quoted:
            value = m[1]
            st.quoted += 1
            if pair in value:
                value = value.replace(pair, mark)
                st.escaped += 1
            st.multiline += b"\n" in value or b"\r" in value
            any_quoted = True
        else:
            value = m[0]
        at = m.end()
        end = held[at : at + 1]
        if end == delimiter:
            record.append(value)
            at += 1
            if at < len(held) or (more and longer()):
                continue
            record.append(b"")  # a delimiter at the very end opens one more, empty field
        elif end in (b"\n", b"\r", b""):
            after = at + (2 if held[at : at + 2] == b"\r\n" else 1)
            if not record and not value and not any_quoted:
                if end:
                    st.blank_lines += 1
                    at = after
                continue
            record.append(value)
            at = after
        else:
            raise ReconcileError("BAD_CONTENT", f"byte 0x{end[0]:02x} after the closing quote at byte {passed + at}, row {st.rows + 1}, field {len(record) + 1}")
        st.rows += 1
        if limits.max_rows is not None and st.rows > limits.max_rows:
            raise ReconcileError("INVALID_ARG", f"more than {limits.max_rows} rows")
        if st.rows == 1:
            st.columns = len(record)
            if limits.max_columns is not None and st.columns > limits.max_columns:
                raise ReconcileError("INVALID_ARG", f"more than {limits.max_columns} columns")
        elif len(record) < st.columns:
            raise ReconcileError("RAGGED_ROW", f"row {st.rows} has {len(record)} fields, not {st.columns}")
        elif len(record) > st.columns:
            if any(record[st.columns :]):
                raise ReconcileError("RAGGED_ROW", f"row {st.rows} has {len(record)} fields, not {st.columns}, and those beyond aren't empty")
            st.ragged_normalized += 1
            record = record[: st.columns]
        st.fields += len(record)
        yield record
        record, any_quoted = [], False


ROWS = "rec long, cells array<string>, status string, message string, stats array<long>"
_TYPES = (pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.int64()))
_NAMES = ["rec", "cells", "status", "message", "stats"]


def row_batches(data: bytes, dialect: Dialect, limits: Limits, encoding: str | None, sniffed: bool) -> Iterator[pa.RecordBatch]:
    """Numbered records; at the end a row of statistics (rec 0), or the error that stopped the parse (rec -1)."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    stats, out = ParseStats(), []
    try:
        data = inflated(data, encoding, limits.max_bytes)
        if sniffed:
            sniff(data)
        for record in parse(data, dialect, limits, stats):
            out.append((stats.rows, [text_of(v) for v in record], None, None, None))
            if len(out) >= BATCH:
                yield batch(out)
                out = []
        out.append((0, None, None, None, list(asdict(stats).values())))
    except ReconcileError as e:
        out.append((-1, None, e.status, e.message, None))
    if out:
        yield batch(out)


def scan(spark: SparkSession, contents: DataFrame, dialect: Dialect = Dialect(), limits: Limits = Limits(), encoding: str | None = None, sniffed: bool = True) -> tuple[DataFrame, ParseStats]:
    """(rec, cells) of one file's ``content``, parsed where it lies, and the statistics. One file is one task: only the file's start tells what its quotes mean."""

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                yield from row_batches(raw.as_py(), dialect, limits, encoding, sniffed)

    rows = stage(contents.select("content").mapInArrow(run, ROWS), "csv")
    ends = rows.where("rec <= 0").collect()
    bad = next((r for r in ends if r.rec < 0), None)
    if bad:
        raise ReconcileError(bad.status, bad.message)
    if not ends:
        raise ReconcileError("IO_ERROR", "no such file")
    return rows.where("rec > 0").select("rec", "cells"), ParseStats(*ends[0].stats)


def read_files(spark: SparkSession, path: str, limits: Limits | None = None) -> DataFrame:
    """content of the one file at ``path``; its size is looked at before it is read."""
    try:
        files = spark.read.format("binaryFile").load(path)
        found = files.select("path", "length").limit(2).collect()
    except (AnalysisException, Py4JJavaError) as e:
        raise ReconcileError("IO_ERROR", f"{path} can't be read: {str(e).splitlines()[0]}") from None
    if not found:
        raise ReconcileError("IO_ERROR", f"no file at {path}")
    if len(found) > 1:
        raise ReconcileError("INVALID_ARG", f"{path} is several files; a source is one")
    if limits and limits.max_bytes is not None and found[0].length > limits.max_bytes:
        raise ReconcileError("TOO_LARGE", f"{found[0].length} bytes are more than the limit of {limits.max_bytes}")
    return files.select("content")


def byte_counts(contents: DataFrame) -> dict[str, int]:
    """Bytes, line feeds and quotes of a file, counted where it lies."""

    def run(batches):
        for b in batches:
            raws = [v.as_py() for v in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f(r) for r in raws], pa.int64()) for f in (len, lambda r: r.count(b"\n"), lambda r: r.count(b'"'))], names=["bytes", "line_feeds", "quotes"])

    return contents.select("content").mapInArrow(run, "bytes long, line_feeds long, quotes long").first().asDict()


def from_bytes(spark: SparkSession, data: bytes) -> DataFrame:
    return spark.createDataFrame([(bytearray(data),)], "content binary")


def quote_field(value: str, dialect: Dialect = Dialect()) -> str:
    if any(c in value for c in (dialect.delimiter, dialect.quote, "\r", "\n")):
        return dialect.quote + value.replace(dialect.quote, dialect.quote * 2) + dialect.quote
    return value
