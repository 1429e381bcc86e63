"""Rows that share a key, compared with each other in tasks of bounded memory, however many share one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows that a task holds at once; a group of more is compared in pairs of blocks of half as many
MOST = 20_000


def whole_groups(batches: Iterator[pa.RecordBatch], most: int = MOST) -> Iterator[tuple[bool, np.ndarray]]:
    """(False, matrix of whole groups) or (True, rows of a group of more than ``most`` rows), from batches of longs sorted by their first column, the key.

    The matrix has a row for each column. A large group passes through without being held."""
    held: list[np.ndarray] = []
    size, large = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        m = np.stack([c.to_numpy() for c in batch.columns])
        if large is not None:
            own = int(np.searchsorted(m[0], large, side="right"))
            if own:
                yield True, m[:, :own]
            m = m[:, own:]
            if not m.shape[1]:
                continue
            large = None
        held.append(m)
        size += m.shape[1]
        if size > most:
            m = np.concatenate(held, axis=1)
            last = int(np.searchsorted(m[0], m[0][-1]))  # the last group may go on
            if last:
                yield False, m[:, :last]
            m = m[:, last:]
            if m.shape[1] > most:
                large = m[0][-1]
                yield True, m
                held, size = [], 0
            else:
                held, size = [m], m.shape[1]
    if size:
        yield False, np.concatenate(held, axis=1)


def block_pairs(rows: DataFrame, key: str, member: str, most: int = MOST) -> DataFrame:
    """rows of large groups, each for every pair (i, j) of blocks of its group that its own ``block`` is in: groups (key, i, j) have some ``most`` rows.

    Blocks are dealt by a hash of the member, and counts of groups are combined before they are joined, so no task gets a group."""
    half = max(1, most // 2)
    number = rows.groupBy(key).agg(F.ceil(F.count("*") / F.lit(half)).cast("int").alias("blocks"))
    dealt = rows.join(number, key).withColumn("block", F.pmod(F.xxhash64(member, F.lit("block")), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select(*rows.columns, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
