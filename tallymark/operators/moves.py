"""Which matched rows have moved, and where deleted rows stand."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stage
from .order import block_of, ranked


#: runs (24 bytes each) up to which one task decides them all
FEW = 200_000


def staying(values: list[int], sizes: list[int] | None = None) -> list[bool]:
    """Which of distinct values are in the longest increasing subsequence that patience finds: piles by lower bound, walked back from the last pile's top.

    With ``sizes`` each value begins a run of so many consecutive values, no other value lies within it, and the whole run stays or goes. A run lies
    on consecutive piles, a later one covers it from its first pile on, so its last value is on top until all of it is covered: piles are kept as
    stretches, one for each run of which something shows.
    """
    sizes = sizes or [1] * len(values)
    #: of each stretch: the first value that shows, its pile, the run
    shown, piles, runs = [], [], []
    back = [-1] * len(values)
    for i, (v, n) in enumerate(zip(values, sizes, strict=True)):
        at = bisect_left(shown, v)
        last = runs[at - 1] if at else -1
        back[i] = last
        pile = piles[at - 1] + (values[last] + sizes[last] - shown[at - 1]) if at else 0
        # what lies on the piles that the run takes is covered, of the last stretch perhaps a part
        stop, over = at, pile + n
        while stop < len(piles) and piles[stop] + (values[runs[stop]] + sizes[runs[stop]] - shown[stop]) <= over:
            stop += 1
        if stop < len(piles) and piles[stop] < over:
            shown[stop], piles[stop] = shown[stop] + over - piles[stop], over
        shown[at:stop], piles[at:stop], runs[at:stop] = [v], [pile], [i]
    keep = [False] * len(values)
    i = runs[-1] if runs else -1
    while i >= 0:
        keep[i] = True
        i = back[i]
    return keep


def stretches(runs: DataFrame) -> DataFrame:
    """stretch, s_rank, t_rank, n of the runs (_b, s_rank, t_rank, n) that may have moved. A run whose source places exceed all before it and are below all after it
    stays in any case, and parts the rest into stretches that can be decided each by itself."""
    along = Window.partitionBy("_b").orderBy("t_rank")
    sums = runs.groupBy("_b").agg(F.max("s_rank").alias("hi"), F.min("s_rank").alias("lo"))
    w = Window.orderBy("_b")
    around = sums.select("_b", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("hi"), F.min("lo").over(Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)).alias("lo"))
    # what follows is what precedes in the other order; a frame that ends unbounded costs a pass for each row
    after = Window.partitionBy("_b").orderBy(F.desc("t_rank"))
    most = F.greatest(F.max("s_rank").over(along.rowsBetween(Window.unboundedPreceding, 0)), F.coalesce("hi", F.lit(-1)))
    least = F.least(F.min("s_rank").over(after.rowsBetween(Window.unboundedPreceding, 0)), F.coalesce("lo", F.lit(2**62)))
    fixed = runs.join(around, "_b").withColumn("p", ((most == F.col("s_rank")) & (least == F.col("s_rank"))).cast("int"))
    # stretch: runs that stay before, counted by block
    counts = fixed.groupBy("_b").agg(F.sum("p").alias("kept"))
    before = counts.select("_b", (F.sum("kept").over(w) - F.col("kept")).alias("before"))
    return fixed.withColumn("q", F.sum("p").over(along.rowsBetween(Window.unboundedPreceding, 0))).join(before, "_b").where("p = 0").select((F.col("before") + F.col("q")).alias("stretch"), "s_rank", "t_rank", "n")


def moved_rows(matches: DataFrame) -> DataFrame:
    """(t_idx, move_distance) of the rows of matches (s_idx, t_idx) that are outside the longest increasing run of source places along the target.

    Rows that follow each other on both sides are one run, which stays or goes as a whole, so there are some three runs for each displaced row or block,
    however many rows there are. Running extremes, blockwise, settle the many runs that stay in any case, and only the stretches between are looked at run by run.
    """
    m = stage(ranked(ranked(matches.select("s_idx", "t_idx"), "s_idx", ["s_idx"], "s_rank"), "t_idx", ["t_idx"], "t_rank"), "ranks")
    along = Window.partitionBy("_b").orderBy("t_rank")
    # the first row of a block begins a run; a run that is cut there is two that stay or go together
    begins = F.coalesce((F.lag("s_rank").over(along) + 1 != F.col("s_rank")).cast("int"), F.lit(1))
    cut = m.withColumn("_b", block_of("t_rank")).withColumn("begins", begins).withColumn("run", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = stage(cut.groupBy("_b", "run").agg(F.min("s_rank").alias("s_rank"), F.min("t_rank").alias("t_rank"), F.count("*").alias("n")).drop("run"), "runs")
    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t_rank")
        return part[[not k for k in staying(part.s_rank.tolist(), part.n.tolist())]][["s_rank", "t_rank", "n"]]

    # few runs are one stretch, as finding where to part them would take longer than to decide them
    free = runs.select(F.lit(0).alias("stretch"), "s_rank", "t_rank", "n") if runs.count() <= FEW else stretches(runs)
    gone = free.groupBy("stretch").applyInPandas(pick, "s_rank long, t_rank long, n long")
    rows = gone.select((F.col("t_rank") - F.col("s_rank")).alias("move_distance"), F.explode(F.expr("sequence(t_rank, t_rank + n - 1)")).alias("t_rank"))
    return rows.join(m.select("t_rank", "t_idx"), "t_rank").select("t_idx", "move_distance")
