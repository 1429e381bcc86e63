"""Results that are needed more than once, written to the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import io
import tempfile
import uuid

from pyspark.sql import DataFrame

from ..errors import ReconcileError


def shared_dir(spark) -> str:
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ReconcileError("INVALID_ARG", "spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallymark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: folders that stage has written and nothing has deleted yet
written: list[str] = []


def clean(spark) -> None:
    """Delete all that ``stage`` has written in this process. Diffs made before are of no use then."""
    for path in written:
        with contextlib.suppress(Exception):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    written.clear()


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df``, written once as Parquet and read back: evaluated once, short lineage, whole after the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written.append(path)
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


class SharedFile(io.RawIOBase):
    """A new file, in the shared folder say, as a binary stream that the driver writes; nothing of it is held."""

    def __init__(self, spark, path: str):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._where, self._out = where, self._files.create(where)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._out.write(bytes(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self._out.close()
        super().close()

    def length(self) -> int:
        """Bytes in the file; those just written count when it is closed."""
        return self._files.getFileStatus(self._where).getLen()
