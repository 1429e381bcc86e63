"""Shared plumbing: reading tables, the shared folder, and byte-level word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes that separate words in the contracts: \x20 and \x09-\x0D, which is what bytes.split() splits at
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and driver and executors are one machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallymark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: folders that materialize has written and nothing has deleted yet, in order
written: list[str] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: one evaluation, short lineage, survives lost executors. Deleted by ``clean`` or at the end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written.append(path)
    with contextlib.suppress(Exception):  # best effort: a store may refuse deletion at exit
        where, files = _located(spark, path)
        files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clean(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete what ``materialize`` has written, from the ``since``-th folder on, but for the last ``keep``. For when results that were made of it are written themselves."""
    stop = len(written) - keep
    for path in written[since:stop]:
        with contextlib.suppress(Exception):
            where, files = _located(spark, path)
            files.delete(where, True)
    del written[since:stop]


def bare(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Only the named columns, under the given names; whatever else the table carries is dropped before any join."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def utf8(column: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(f"`{column}`"), F.lit("")).cast("binary")


def release() -> None:
    """At the end of a task: hand freed memory back, since Python workers stay for later tasks while others run beside them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for b in batches:
            yield from fn(b)
        release()

    return df.mapInArrow(run, ddl)


def lean(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of at most 2000 rows: whole texts travel, so a batch of the usual 10000 takes tens of MB in each of several copies."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 2000:
        spark.conf.set(name, "2000")
    return spark


class Remembered:
    """A dictionary of at most ``2 * most`` entries that forgets what was not asked for lately: entries asked for move to the young half, and when that is full the old half goes."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def take(self, keys) -> tuple[dict, list]:
        """Those of the keys that are known, and the rest."""
        young, old, got, rest = self.young, self.old, {}, []
        for k in keys:
            v = young.get(k)
            if v is None:
                v = old.get(k)
                if v is None:
                    rest.append(k)
                    continue
                young[k] = v
            got[k] = v
        return got, rest

    def put(self, more: dict) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        self.young.update(more)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(column: str = "doc_id") -> Column:
    """Unsigned crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(f"`{column}`").cast("string").cast("binary"))


def with_key(docs: DataFrame, doc_id: str = "doc_id", key: str = "_key") -> DataFrame:
    """docs with a key of its own for each row: doc_id where that is whole, unique and never null, else a row number of a written copy."""
    if docs.schema[doc_id].dataType.simpleString() in ("bigint", "int"):
        n, ids, kinds = bare(docs, doc_id=doc_id).agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
        if n == ids == kinds:
            return docs.withColumn(key, F.col(f"`{doc_id}`").cast("long"))
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
