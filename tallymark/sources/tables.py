"""What can be compared. Each source opens as a ``Side``: numbered rows of text, and the columns' declaration."""

from __future__ import annotations

import codecs
from collections.abc import Iterable
from dataclasses import dataclass
from dataclasses import fields as dataclass_fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ReconcileError
from ..functions.render import rendered
from ..options import Dialect, HeaderLayout, Limits
from ..plans.header import LOOK, Header, HeaderModel
from ..plans.storage import stage
from . import json_rows, strict_csv


@dataclass
class Side:
    """rows: rec (record number from 1, header rows counted) and v0..vn, the header rows left in; model: set where the source declares it itself."""

    rows: DataFrame
    width: int
    first: list[list[str]]
    model: HeaderModel | None = None
    stats: strict_csv.ParseStats | None = None


def numbered(df: DataFrame, order: list[Column | str], name: str = "rec", first: int = 1) -> DataFrame:
    """``df`` with its rows numbered along ``order``, which must tell all rows apart for the numbers to be the same at every run.

    Rows are range-partitioned, sorted and written once; each part counts for itself from where the parts before end. Small parts are merged by Spark.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    spread = stage(spread, "numbered")
    part = F.shiftright("_at", 33)
    sizes = spread.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a part
    placed = spread.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + first).drop("_part", "_before", "_at")


def _spread(rows: DataFrame, width: int) -> DataFrame:
    return rows.select("rec", *[F.col("cells")[i].alias(f"v{i}") for i in range(width)])


class Source:
    """One side of a comparison; open it with ``compare``."""

    def open(self, spark: SparkSession, dialect: Dialect, limits: Limits) -> Side:
        raise NotImplementedError

    @staticmethod
    def csv(path: str, encoding: str | None = None, sniff: bool = True) -> Source:
        return CsvSource(path=path, encoding=encoding, sniff=sniff)

    @staticmethod
    def bytes(data: bytes, encoding: str | None = None, sniff: bool = True) -> Source:
        return CsvSource(data=data, encoding=encoding, sniff=sniff)

    @staticmethod
    def string(text: str) -> Source:
        return CsvSource(data=text.encode("utf-8", "replace"))

    @staticmethod
    def reader(stream, charset: str | None = None) -> Source:
        """A text stream, or a binary one in another charset, read as characters: a surrogate without its pair, or a byte that the charset lacks, becomes U+FFFD."""
        if charset is None:
            return CsvSource(data="".join(iter(lambda: stream.read(1 << 20), "")).encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode())
        decode, parts = codecs.getincrementaldecoder(charset)("replace"), []
        while part := stream.read(1 << 20):
            parts.append(decode.decode(part))
        return CsvSource(data="".join([*parts, decode.decode(b"", True)]).encode("utf-8", "replace"))

    @staticmethod
    def stream(stream, size_hint: int | None = None, encoding: str | None = None, sniff: bool = True) -> Source:
        """A binary stream, read when the comparison begins. ``size_hint`` is how many bytes are expected, 0 or None if unknown; it is checked against the limit before anything is read, and is no limit itself."""
        if size_hint is not None and size_hint < 0:
            raise ReconcileError("INVALID_ARG", "a size hint is not negative")
        return CsvSource(stream=stream, size_hint=size_hint or 0, encoding=encoding, sniff=sniff)

    @staticmethod
    def fast_csv(path: str, header: Header, **options) -> Source:
        """Spark's own CSV reader, for large trusted files: splits one file, but pads short rows and drops fields beyond the header."""
        return FastCsvSource(path, header, options)

    @staticmethod
    def dataframe(df: DataFrame, header: Header | None = None, order_by: list | None = None, key: list[str] = (), record: str | None = None) -> Source:
        """Any DataFrame. ``order_by`` gives the row order (without it, all columns do); ``record`` names a column of record numbers instead."""
        return TableSource(df, header or Header.of(*[(f.name, _declared(f.dataType.simpleString()), f.name in key) for f in df.schema.fields if f.name != record]), order_by, record)

    @staticmethod
    def parquet(spark: SparkSession, path: str, **how) -> Source:
        return Source.dataframe(spark.read.parquet(path), **how)

    @staticmethod
    def jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None, header: Header | None = None, order_by: list | None = None, **partitioning) -> Source:
        """A database table or query; the header's width must be the query's."""
        return Source.dataframe(spark.read.jdbc(url, table, properties=properties or {}, **partitioning), header, order_by)

    @staticmethod
    def rows(rows: Iterable[list], header: Header) -> Source:
        return RowsSource(rows, header)

    @staticmethod
    def json_rows(text: str | bytes, header: Header) -> Source:
        return JsonSource(header, text=text)

    @staticmethod
    def json_file(path: str, header: Header) -> Source:
        return JsonSource(header, path=path)

    @staticmethod
    def embedded(df: DataFrame, column: str) -> Source:
        """A CSV table held in one text value: the only row of ``df``."""
        return CsvSource(contents=df.select(F.encode(F.coalesce(F.col(f"`{column}`"), F.lit("")), "UTF-8").alias("content")))

    def with_header(self, header: Header) -> Source:
        return DeclaredSource(self, header)


def _declared(kind: str) -> str:
    return {"string": "", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}.get(kind,
        kind.upper() if kind in ("int", "bigint", "smallint", "tinyint") or kind.startswith("decimal") else "")


@dataclass
class CsvSource(Source):
    path: str | None = None
    data: bytes | None = None
    contents: DataFrame | None = None
    encoding: str | None = None
    sniff: bool = True
    stream: object = None
    size_hint: int = 0

    def open(self, spark, dialect, limits):
        if self.stream is not None and self.data is None:
            self.data = self._drained(limits)
        contents = self.contents if self.contents is not None else strict_csv.from_bytes(spark, self.data) if self.path is None else strict_csv.read_files(spark, self.path, limits)
        rows, stats = strict_csv.scan(spark, contents, dialect, limits, self.encoding, self.sniff)
        first = [r.cells for r in rows.where(F.col("rec") <= max(LOOK, 64)).orderBy("rec").collect()]
        return Side(_spread(rows, stats.columns), stats.columns, first, stats=stats)


    def _drained(self, limits: Limits) -> bytes:
        parts, size = [], self.size_hint
        while True:
            if limits.max_bytes is not None and size > limits.max_bytes:
                raise ReconcileError("TOO_LARGE", f"the stream has more than the limit of {limits.max_bytes} bytes")
            part = self.stream.read(1 << 20)
            if not part:
                return b"".join(parts)
            parts.append(part)
            size = sum(map(len, parts))


@dataclass
class FastCsvSource(Source):
    path: str
    header: Header
    options: dict

    def open(self, spark, dialect, limits):
        schema = ", ".join(f"v{i} string" for i in range(len(self.header.columns)))
        df = spark.read.csv(self.path, schema=schema, sep=dialect.delimiter, quote=dialect.quote, escape=dialect.quote, emptyValue="", nullValue="", **self.options)
        names = Header(self.header.columns)
        return TableSource(df, names, None, None).open(spark, dialect, limits)


@dataclass
class TableSource(Source):
    df: DataFrame
    header: Header
    order_by: list | None
    record: str | None

    def open(self, spark, dialect, limits):
        model = self.header.model()
        fields = [f for f in self.df.schema.fields if f.name != self.record and f.name not in [c for c in self.order_by or () if isinstance(c, str) and c not in self.header.names]]
        if len(fields) != model.width:
            raise ReconcileError("INVALID_ARG", f"the header declares {model.width} columns, the rows have {len(fields)}")
        cells = [rendered(F.col(f"`{f.name}`"), f.dataType).alias(f"v{i}") for i, f in enumerate(fields)]
        if self.record:
            return Side(self.df.select((F.col(f"`{self.record}`").cast("long") + model.rows).alias("rec"), *cells), model.width, [list(r) for r in model.cells], model)
        keys = [F.col(f"`{c}`") if isinstance(c, str) else c for c in self.order_by or [f.name for f in fields]]
        placed = self.df.select(*[k.alias(f"_o{i}") for i, k in enumerate(keys)], *cells)
        rows = numbered(placed, [f"_o{i}" for i in range(len(keys))], first=model.rows + 1)
        return Side(rows.select("rec", *[f"v{i}" for i in range(model.width)]), model.width, [list(r) for r in model.cells], model)


@dataclass
class RowsSource(Source):
    given: Iterable[list]
    header: Header

    def open(self, spark, dialect, limits):
        model = self.header.model()
        data = []
        for n, row in enumerate(self.given, 1):
            if len(row) != model.width:
                raise ReconcileError("RAGGED_ROW", f"row {n} has {len(row)} values, not {model.width}")
            data.append((n + model.rows, ["" if v is None else str(v) for v in row]))
        return Side(_spread(spark.createDataFrame(data, "rec long, cells array<string>"), model.width), model.width, [list(r) for r in model.cells], model)


@dataclass
class JsonSource(Source):
    header: Header
    text: str | bytes | None = None
    path: str | None = None

    def open(self, spark, dialect, limits):
        model, names = self.header.model(), self.header.names
        contents = strict_csv.read_files(spark, self.path) if self.path else strict_csv.from_bytes(spark, self.text if isinstance(self.text, bytes) else self.text.encode())
        skip = model.rows

        def run(batches):
            kinds = [pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]
            put = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["rec", "cells", "status", "message"])
            for b in batches:
                for raw in b.column(0):
                    out = []
                    try:
                        for n, row in enumerate(json_rows.parse_rows(strict_csv.text_of(raw.as_py()), names), 1):
                            out.append((n + skip, row, None, None))
                            if len(out) >= strict_csv.BATCH:
                                yield put(out)
                                out = []
                    except ReconcileError as e:
                        out.append((-1, None, e.status, e.message))
                    if out:
                        yield put(out)

        rows = stage(contents.mapInArrow(run, "rec long, cells array<string>, status string, message string"), "json")
        bad = rows.where("rec < 0").head()
        if bad:
            raise ReconcileError(bad.status, bad.message)
        return Side(_spread(rows, model.width), model.width, [list(r) for r in model.cells], model)


@dataclass
class DeclaredSource(Source):
    """A body without header rows, and its declaration."""

    body: Source
    header: Header

    def open(self, spark, dialect, limits):
        model, side = self.header.model(), self.body.open(spark, dialect, limits)
        if side.model is not None:
            raise ReconcileError("INVALID_ARG", "this source declares its columns already")
        if side.first and [c.strip() for c in side.first[0]] in ([c.strip() for c in r] for r in model.cells):
            raise ReconcileError("INVALID_ARG", "the body declares its columns itself")
        if side.first and side.width != model.width:
            raise ReconcileError("COLUMN_ORDER", f"the header declares {model.width} columns, the body has {side.width}")
        rows = side.rows.withColumn("rec", F.col("rec") + model.rows) if side.first else spark.createDataFrame([], ", ".join(["rec long", *[f"v{i} string" for i in range(model.width)]]))
        return Side(rows, model.width, [list(r) for r in model.cells], model, side.stats)


def parse_column(df: DataFrame, column: str, dialect: Dialect = Dialect(), limits: Limits = Limits()) -> DataFrame:
    """(the other columns of df, rec, cells) for each record of the CSV table in each row's text; a broken text raises. Distributed by row."""
    others = [c for c in df.columns if c != column]
    return _parsed(df, column, dialect, limits, False).select(*[F.col(f"`{c}`") for c in others], "rec", "cells")


def try_parse_column(df: DataFrame, column: str, dialect: Dialect = Dialect(), limits: Limits = Limits()) -> DataFrame:
    """As ``parse_column``, with ``status`` and ``message``: after its good records a broken text has one row with the error, and rec null. The column may be binary."""
    return _parsed(df, column, dialect, limits, True)


def _parsed(df: DataFrame, column: str, dialect: Dialect, limits: Limits, keep_errors: bool) -> DataFrame:
    others = [c for c in df.columns if c != column]
    schema = df.select(*[F.col(f"`{c}`") for c in others], F.lit(None).cast("long").alias("rec"), F.lit(None).cast("array<string>").alias("cells"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("message")).schema

    def run(batches):
        for b in batches:
            at, recs, cells, errors, size = [], [], [], [], 0

            def put() -> pa.RecordBatch:
                same = [b.column(j).take(pa.array(at, pa.int32())) for j in range(len(others))]
                more = [pa.array(recs, pa.int64()), pa.array(cells, pa.list_(pa.string())), *[pa.array([e and getattr(e, n) for e in errors], pa.string()) for n in ("status", "message")]]
                return pa.RecordBatch.from_arrays([*same, *more], names=[*others, "rec", "cells", "status", "message"])

            for i, text in enumerate(b.column(len(others)).to_pylist()):
                try:
                    for n, r in enumerate(strict_csv.parse(text.encode() if isinstance(text, str) else text or b"", dialect, limits), 1):
                        at.append(i)
                        recs.append(n)
                        cells.append([strict_csv.text_of(v) for v in r])
                        errors.append(None)
                        size += sum(map(len, r))
                        if len(at) >= strict_csv.BATCH or size >= strict_csv.BATCH_BYTES:
                            yield put()
                            at, recs, cells, errors, size = [], [], [], [], 0
                except ReconcileError as e:
                    if not keep_errors:
                        raise
                    at.append(i)
                    recs.append(None)
                    cells.append(None)
                    errors.append(e)
            if at:
                yield put()

    return df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{column}`")).mapInArrow(run, schema)


def parse_stats(df: DataFrame, column: str, dialect: Dialect = Dialect(), limits: Limits = Limits()) -> DataFrame:
    """(the other columns of df, stats) with the parser's statistics of the CSV table in each row's text; a broken text raises."""
    others = [c for c in df.columns if c != column]
    names = [f.name for f in dataclass_fields(strict_csv.ParseStats)]

    def run(batches):
        for b in batches:
            found = []
            for text in b.column(len(others)).to_pylist():
                stats = strict_csv.ParseStats()
                for _ in strict_csv.parse((text or "").encode(), dialect, limits, stats):
                    pass
                found.append({n: getattr(stats, n) for n in names})
            kind = pa.struct([(n, pa.int64()) for n in names])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(found, kind)], names=[*others, "stats"])

    struct = F.struct(*[F.lit(0).cast("long").alias(n) for n in names])
    schema = df.select(*[F.col(f"`{c}`") for c in others], struct.alias("stats")).schema
    return df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{column}`")).mapInArrow(run, schema)
