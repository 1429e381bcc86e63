"""Running values along a dense order, without a window over all rows.

Rows are cut into blocks of the order; windows run inside blocks, and one row a block, of which there are a few
thousand for a thousand million rows, carries what the blocks before leave behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: order values in a block, as a power of two
BLOCK_BITS = 18


def block_of(order: str) -> Column:
    return F.shiftright(F.col(order), BLOCK_BITS)


def ranked(df: DataFrame, block_by: str, order: list[str], name: str, within: list[str] = ()) -> DataFrame:
    """``name``: 0-based rank along ``order``, whose first element is ``block_by``; among equal ``within`` columns if any are given."""
    keys = [*within, "_b"]
    rows = df.withColumn("_b", block_of(block_by))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_b") if not within else Window.partitionBy(*within).orderBy("_b")
    before = sizes.select(*keys, (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    inside = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return inside.join(before, keys).withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_b", "_r", "_before")


def last_before(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``name``: the last non-null ``value`` at or before each row."""
    rows = df.withColumn("_b", block_of(order))
    left = rows.where(F.col(value).isNotNull()).groupBy("_b").agg(F.max_by(value, order).alias("_v"))
    blocks = rows.select("_b").distinct().join(left, "_b", "left")
    carried = blocks.select("_b", F.last("_v", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    here = F.last(value, ignorenulls=True).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(carried, "_b").withColumn(name, F.coalesce(here, "_carried")).drop("_b", "_carried")
