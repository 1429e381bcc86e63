"""Mixing sources to target word counts by entropy balancing, with DataFrame operations only.

Each document gets a rate between 0 and ``cap`` copies. Of all rates that give every source its target number of words, those
nearest to equal ones in (bounded, Fermi-Dirac) relative entropy are exponentially tilted by the constraint's own terms, the document sizes:
rate = cap * odds / (1 + odds), odds = exp(tilt of the source * size / mean size) / (cap - 1). The tilts solve a convex dual with one
unknown for each source. Newton's method on it needs two sums a source and step, made over (source, size, number of documents) rows, since
documents of equal source and size have equal rates. From tilt 0 the steps approach the root from one side, as the sums are concave for
positive and convex for negative tilts when cap is 2, so they need no damping.

Rates become copies of documents for each (source, size) group: the group's copies are rounded by a hash, a source's remaining words are made up
by its groups from large sizes to small, and inside a group the documents of least hash get the extra copy, of equal rows the first.

Only (key, source, size, hash) of the documents is moved about; copies are joined back to the documents by key, so a hot source is no hot key there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, with_key

SHARE, WEIGHTS, CAP = 1.5, (3, 1, 2), 2
#: Newton steps in one job, steps after which they count as failed, and the relative distance from the targets at which they end
STEPS, FAILED, NEAR = 6, 600, 1e-6
#: documents of a group that are ranked together
TOGETHER = 64


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sid, target, mean added to sizes (source, source_size, n): ``share`` of all words by weight, no source above ``cap`` times its size.

    Sources take the weights in turn, by code point, null last. What a source can't take is shared again among the others by weight: all end
    at the lesser of their limit and level * weight, and the level follows from sums along the order of limit / weight.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w)  # one row a source
    rows = rows.withColumn("limit", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("w"))
    along = Window.orderBy("ratio", "sid")
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after))
    rows = rows.withColumn("level", F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(everything))
    return rows.select("source", "sid", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("w"), F.col("limit"))).alias("target"), (F.col("source_size") / F.greatest("n", F.lit(1))).alias("mean"))


def rate(cap: int) -> Column:
    """Copies of a document, from tilt, size and mean; a source at its limit has tilt null and all copies."""
    odds = F.exp(F.least(F.greatest(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(-700.0)), F.lit(700.0))) / F.lit(float(cap - 1))
    return F.when(F.col("mean") == 0, F.lit(1.0)).when(F.col("tilt").isNull(), F.lit(float(cap))).otherwise(F.lit(float(cap)) * odds / (F.lit(1.0) + odds))


def tilts(groups: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """sources with the ``tilt`` that solves the dual; null where the target is the source's limit. Steps go on until every source is at its target."""
    free = (F.col("source_size") > 0) & (F.col("target") < F.lit(cap * (1 - 1e-9)) * F.col("source_size"))
    state = sources.withColumn("tilt", F.when(free, F.lit(0.0)))
    keep = ["sid", "source", "source_size", "target", "mean"]
    for _ in range(FAILED // STEPS):
        for _ in range(STEPS):
            r = rate(cap)
            words = F.col("n") * F.col("size")
            sums = groups.join(state, "sid").groupBy("sid").agg(
                *[F.first(c).alias(c) for c in (*keep[1:], "tilt")], F.sum(words * r).alias("f"),
                F.sum(words * F.col("size") / F.col("mean") * r * (F.lit(1.0) - r / F.lit(float(cap)))).alias("slope")
            )
            off = F.abs(F.col("f") - F.col("target")) / F.col("target")
            # a source that has arrived stays, so that rounding does not move it on
            step = F.when((F.col("slope") > 0) & (off > NEAR / 10), (F.col("f") - F.col("target")) / F.col("slope")).otherwise(F.lit(0.0))
            state = sums.select(*keep, (F.col("tilt") - step).alias("tilt"), off.alias("off"))
        state = materialize(state, "tilts")
        far = state.where(F.col("tilt").isNotNull()).agg(F.max("off")).first()[0]
        if far is None or far <= NEAR:
            return state.select(*keep, "tilt")
    raise RuntimeError(f"a source is still {far:.2g} of its target away from it after {FAILED} steps")


def allotted(groups: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """sid, size, n, rate, copies: whole copies of each group; a source's words differ from its target by less than its smallest movable document."""
    out = groups.join(sources, "sid").select("sid", "size", "n", "target", rate(cap).alias("rate"))
    # rounded up or down by a hash of the group, so that errors don't add up where most groups have one document
    up = F.shiftrightunsigned(F.xxhash64("sid", "size"), 11) / F.lit(float(1 << 53))
    out = materialize(out.withColumn("copies", F.least(F.floor(F.col("n") * F.col("rate") + up), F.lit(cap) * F.col("n")).cast("long")), "copies")
    out = filled(out, cap)
    # where all smaller documents are used up, the next larger one goes beyond the target, and they make up for that; the nearer of both holds
    lack = out.groupBy("sid").agg(_lack(), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    stuck = out.join(lack, "sid").where((F.abs("lack") >= F.col("least")) & (F.col("size") > F.abs("lack")) & (_room(cap) > 0))
    step = materialize(stuck.groupBy("sid").agg(F.min("size").alias("size"), F.first(F.signum("lack")).cast("long").alias("more")), "steps")
    if not step.isEmpty():
        beyond = out.join(step.select("sid"), "sid", "left_semi").join(step, ["sid", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more")
        beyond = filled(materialize(beyond, "copies"), cap)
        far = lambda t, name: t.groupBy("sid").agg(F.abs(_lack()).alias(name))
        nearer = far(beyond, "there").join(far(out, "here"), "sid").where("there < here").select("sid")
        better = beyond.join(nearer, "sid", "left_semi").select("sid", "size", F.col("copies").alias("better"))
        out = out.join(better, ["sid", "size"], "left").withColumn("copies", F.coalesce("better", "copies"))
    return out.select("sid", "size", "n", "rate", "copies")


def _lack() -> Column:
    """Words that a source has too few, below 0 too many."""
    return (F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("lack")


def _room(cap: int) -> Column:
    """Copies of a group that can be added, or taken off where the source has too many words."""
    return F.when(F.col("lack") > 0, F.lit(cap) * F.col("n") - F.col("copies")).otherwise(F.col("copies"))


def filled(out: DataFrame, cap: int) -> DataFrame:
    """Moves copies toward the targets, from large sizes to small, until no source has a movable group within its lack.

    A pass moves the groups that fit one after the other, by running sums, and what fits of the next. Lacks at least halve in each, so passes are few.
    """
    while True:
        able = out.join(out.groupBy("sid").agg(_lack()), "sid").withColumn("room", _room(cap)).where((F.col("room") > 0) & (F.col("size") > 0) & (F.col("size") <= F.abs("lack")))
        larger = Window.partitionBy("sid").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
        left = F.abs("lack") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(larger), F.lit(0))
        number = F.least(F.col("room"), F.floor(left / F.col("size"))).cast("long")
        moved = able.withColumn("number", number).where("number > 0").select("sid", "size", (F.col("number") * F.signum("lack").cast("long")).alias("more"))
        moved = materialize(moved, "moved")
        if moved.isEmpty():
            return out
        out = materialize(out.join(moved, ["sid", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more"), "copies")


def extra_bounds(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """source, size, bound: the e-th least (h, key) of each group of which e documents, more than none and fewer than all, get an extra copy.

    Hashes are dealt into ranges of about ``TOGETHER`` documents; counts find the range, and only that is ranked, so no task gets a group. Equal
    rows share a hash: as many as there are of one row may come together in a range.
    """
    some = groups.where("e > 0 and e < n").select(F.col("source").alias("s"), F.col("size").alias("z"), "e", F.greatest(F.lit(1.0), F.floor(F.col("n") / F.lit(TOGETHER))).alias("ranges"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    ranged = rows.join(some, same).select("source", "size", "h", "key", "e", F.floor(F.col("h") / F.lit(float(1 << 63)) * F.col("ranges")).alias("range"))
    counted = ranged.groupBy("source", "size", "range", "e").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("source", "size").orderBy("range"))
    at = counted.withColumn("upto", upto).where("upto >= e and upto - c < e").select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("range").alias("r"),
        (F.col("e") - F.col("upto") + F.col("c")).alias("rank"))
    inside = ranged.join(at, same & (F.col("range") == F.col("r"))).select("source", "size", "h", "key", "rank")
    placed = inside.withColumn("k", F.row_number().over(Window.partitionBy("source", "size").orderBy("h", "key")))
    return placed.where("k = rank").select("source", "size", F.struct("h", "key").alias("bound"))


ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def decided(docs: DataFrame, share: float, weights: tuple[int, ...], cap: int, doc_id: str, text: str, source: str) -> DataFrame:
    """(whole, of, key, size, source_size, target, rate, copies, taken): every row of docs as a struct ``whole``, with what the mix decides for it."""
    if cap != 2:
        raise ValueError("the Newton steps are proven for at most 2 copies")
    # the columns of docs stay inside a struct, so none of them clashes with a column used here
    keyed = with_key(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(f"`{doc_id}`").alias("id")), doc_id="id", key="key").drop("id")
    own = lambda c: F.col("whole").getField(c)
    h = F.shiftrightunsigned(F.xxhash64(own(doc_id), own(text), F.lit("copies")), 1)
    size = F.coalesce(F.regexp_count(own(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialize(keyed.select("key", own(source).alias("source"), size.alias("size"), h.alias("h")), "sizes")
    counted = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = materialize(targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n")), share, weights, cap), "sources")
    groups = materialize(counted.join(sources.select(F.col("source").alias("s"), "sid"), F.col("source").eqNullSafe(F.col("s"))).select("sid", "size", "n"), "groups")
    solved = materialize(tilts(groups, sources, cap), "solved")
    named = allotted(groups, solved, cap).join(sources.select("sid", "source", "source_size", "target"), "sid")
    whole = F.floor(F.col("copies") / F.col("n")).cast("long")
    named = materialize(named.select("source", "size", "n", "source_size", "target", "rate", whole.alias("b"), (F.col("copies") - whole * F.col("n")).alias("e")), "allotted")
    bounds = extra_bounds(rows, named).select(F.col("source").alias("s"), F.col("size").alias("z"), "bound")
    plan = materialize(named.join(bounds, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").select(F.col("source").alias("s"),
        F.col("size").alias("z"), "source_size", "target", "rate", "b", "bound"), "plan")
    found = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    copies = F.col("b") + F.coalesce((F.struct("h", "key") <= F.col("bound")).cast("long"), F.lit(0))
    found = found.select("key", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    # the slim side is hashed, a small share of what its partition of documents takes, and texts are streamed past it, neither sorted nor held
    return keyed.join(found.hint("shuffle_hash"), "key")


def mix(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with size (words), source_size, target, rate, copies (0 to ``cap``) and taken (copies * size) added.

    Reruns agree: which documents get the extra copy is decided by a hash of id and text, and among equal rows, of which any may, by a row number.
    A null text has size 0; a null source is a source, the last. Sources without words have target 0 and keep their documents once. An empty
    table stays empty. Columns of docs that bear the added names are replaced; any other name is free. RuntimeError if the dual is not solved.
    """
    out = decided(docs, share, weights, cap, doc_id, text, source)
    return out.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def mixed_rows(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row of docs, all its columns unchanged, as often as ``mix`` gives it copies."""
    out = decided(docs, share, weights, cap, doc_id, text, source).where("copies > 0")
    return out.select("whole", F.explode(F.expr("sequence(1L, copies)"))).select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])
