"""Connected components of a distributed graph, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (columns a, b); nodes of one component, and no others, share a root.

    In each round every node points at the neighbour of least hashed priority (or stays, if its own is less), pointers are
    followed a few steps, and edges move to what their ends point at. Priorities are dealt anew each round, so chains and
    stars alike shrink by a constant factor; all steps are joins and aggregates, and nothing but an edge count reaches the driver.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct(), "edges")
    pointers: list[DataFrame] = []
    for k in range(rounds):
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        first = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("p"), F.col(c).alias("n"))  # noqa: B023, E731
        point = both.groupBy("node").agg(F.min(first("other")).alias("m")).select("node", F.when(F.col("m") < first("node"), F.col("m.n")).otherwise(F.col("node")).alias("root"))
        point = materialize(point, "point")
        for _ in range(2):
            nxt = point.select(F.col("node").alias("root"), F.col("root").alias("far"))
            point = point.join(nxt, "root").select("node", F.col("far").alias("root"))
        point = materialize(point, "pointer")
        at = lambda c: point.select(F.col("node").alias(c), F.col("root").alias(f"{c}2"))  # noqa: B023, E731
        moved = edges.join(at("a"), "a").join(at("b"), "b").where("a2 <> b2")
        edges = materialize(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        pointers.append(point)
    else:
        raise RuntimeError(f"not contracted after {rounds} rounds")
    if not pointers:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = pointers[-1]
    for point in reversed(pointers[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = point.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return out


def smallest_members(members: DataFrame, components: DataFrame) -> DataFrame:
    """node, component: the least ``id`` among the members (columns node, id; a row for each node) of the node's component. Nodes without edges stand alone.

    A root may stand for a third of all nodes. Least ids are written, so that the join back has an exchange on both sides, whose large partitions Spark splits.
    """
    least = materialize(members.join(components, "node").groupBy("root").agg(F.min("id").alias("component")), "least")
    placed = components.join(least, "root").select("node", "component")
    return members.join(placed, "node", "left").select("node", F.coalesce("component", "id").alias("component"))
