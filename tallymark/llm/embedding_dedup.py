"""Near-duplicate vectors by random-hyperplane signs, exact cosines and connected components.

Equal vectors are one class first. Each class gets a sign pattern in every table; classes that agree in all signs of a
table are candidates. A sketch of 128 signs, compared inside the bucket, lets only pairs out whose
cosine can hardly be below the threshold's neighbourhood, so a full bucket doesn't pour out all its pairs. The sketch holds the signs of
the first tables, so a bucket of a later table sees which of its pairs already met in one of them and leaves those out: near pairs, which meet
in most tables, are let out once or twice. Every pair let out is then decided by its cosine in double precision.

The signs a table grow with the logarithm of the number of classes, so that buckets of unrelated vectors stay small, and the
tables with them, so that a pair at the threshold is missed with the same probability at every size: with 20 signs and 64
tables a pair at cosine 0.95 is missed with probability (1 - (1 - 0.1012)^20)^64 < 0.0004.
The sketch of such a pair differs in 13 of 128 signs on average and in more than 40 with probability below 1e-9.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare, map_batches, materialize, partitions, release
from .components import connected_components, smallest_members
from .groups import MOST, block_pairs, whole_groups

#: least signs a table, and the probability that a pair at the threshold is missed
SIGNS, MISS, SEED = 20, 0.0004, 20240229
SKETCH, SKETCH_MOST = 128, 40
#: rows of a bucket that are compared with the others at a time
BLOCK = 512


def rows_by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix of doubles) for each length among the lists of an Arrow column without nulls in it."""
    lens = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lens)
    for n in np.unique(lens):
        at = np.flatnonzero(lens == n)
        yield at, flat[(ends[at] - n)[:, None] + np.arange(n)] if n else np.zeros((len(at), 0))


def table_plan(classes: int, least: float, miss: float = MISS, signs: int = SIGNS) -> tuple[int, int]:
    """(tables, signs): a sign for each doubling of the classes, and as many tables as ``miss`` asks for at cosine ``least``."""
    signs = min(max(signs, math.ceil(math.log2(max(classes, 1)))), 40)
    agree = (1 - math.acos(least) / math.pi) ** signs
    return (1 if agree == 1 else math.ceil(math.log(miss) / math.log1p(-agree))), signs


def planes(dims: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, count))


def packed(bits: np.ndarray) -> np.ndarray:
    """(n, k) booleans with k at most 64 as n longs."""
    return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sketch_tables(tables: int, signs: int) -> int:
    """How many of the first tables' signs each half of the sketch holds, side by side from its lowest bit."""
    return min(SKETCH // 2 // signs, tables // 2)


def signed(classes: DataFrame, tables: int, signs: int, seed: int) -> DataFrame:
    """key, id, s1, s2: a row for each class (columns id, v) and table."""
    both = 2 * sketch_tables(tables, signs)
    more = SKETCH // 2 - both // 2 * signs

    def run(batches) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, x in rows_by_length(batch.column(1)):
                dims = x.shape[1]
                if dims not in drawn:
                    drawn.clear()  # one length's planes at a time
                    drawn[dims] = planes(dims, tables * signs, seed), planes(dims, 2 * more, seed + 1)
                hyper, second = drawn[dims]
                step = max(1, 2_560_000 // (tables * signs))
                for k in range(0, len(at), step):
                    part = unit(x[k : k + step])
                    sides = (part @ hyper > 0).reshape(len(part), tables, signs)
                    # lengths that agree in their last 11 bits may share keys; cosines tells them apart
                    keys = packed(sides.reshape(-1, signs)) | np.tile(np.arange(tables, dtype=np.int64) << signs, len(part)) | np.int64(dims & 2047) << 52
                    rest = (part @ second > 0).reshape(len(part), 2, more)
                    halves = np.concatenate([sides[:, :both].reshape(len(part), 2, -1), rest], axis=2)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.repeat(c, tables)) for c in (ids[at[k : k + step]], packed(halves[:, 0]), packed(halves[:, 1])))], names=["key", "id", "s1", "s2"])
        release()

    return classes.select("id", "v").mapInArrow(run, "key long, id long, s1 long, s2 long")


def close_pairs(m: np.ndarray, tables: int, signs: int, most: int, cross: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids a < b of pairs of equal key whose sketches differ in at most ``most`` signs and which meet in no earlier table of the sketch.

    m: rows key, id, s1, s2, sorted by key. cross: numbers that must differ within a pair."""
    key, ids, sketch = m[0], m[1], m[2:4].view(np.uint64)
    each = sketch_tables(tables, signs)
    ones = np.uint64((1 << signs) - 1)

    def out(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = sketch[:, a] ^ sketch[:, b]
        keep = np.bitwise_count(d).astype(int).sum(axis=0) <= most
        if cross is not None:
            keep &= cross[a] != cross[b]
        table = (key[a] >> signs) & ((1 << (52 - signs)) - 1)
        for t in range(2 * each):
            keep &= (t >= table) | ((d[t // each] >> np.uint64(t % each * signs)) & ones != 0)
        a, b = ids[a[keep]], ids[b[keep]]
        return np.minimum(a, b), np.maximum(a, b)

    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=int)
    size = np.diff(np.r_[cut, len(key)])
    yield out(cut[size == 2], cut[size == 2] + 1)
    firsts, seconds, held = [], [], 0
    for at, n in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        for i in range(at, at + n, BLOCK):
            stop = min(i + BLOCK, at + n)
            for j in range(i, at + n, 8 * BLOCK):
                end = min(j + 8 * BLOCK, at + n)
                r, c = np.nonzero(sum(np.bitwise_count(s[i:stop, None] ^ s[None, j:end]).astype(np.int16) for s in sketch) <= most)
                up = r + i < c + j
                firsts.append(r[up] + i)
                seconds.append(c[up] + j)
                held += len(firsts[-1])
                if held > 500_000:
                    yield out(np.concatenate(firsts), np.concatenate(seconds))
                    firsts, seconds, held = [], [], 0
    if held:
        yield out(np.concatenate(firsts), np.concatenate(seconds))


def candidates(classes: DataFrame, tables: int, signs: int, seed: int, held: int = MOST) -> DataFrame:
    """Distinct pairs a < b of classes to be decided by their cosine. Buckets of more than ``held`` classes are compared in pairs of blocks, so that no task holds one."""
    spread = signed(classes, tables, signs, seed).repartition(partitions(classes.sparkSession), "key").sortWithinPartitions("key", "id")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for late, m in whole_groups(batches, held):
            none = pa.array(np.zeros(m.shape[1], dtype=np.int64))
            if late:
                yield pa.RecordBatch.from_arrays([none, none, *(pa.array(c) for c in m), pa.array(np.ones(m.shape[1], dtype=bool))], names=names)
            else:
                for a, b in close_pairs(m, tables, signs, SKETCH_MOST):
                    none = pa.nulls(len(a), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, none, none, pa.array(np.zeros(len(a), dtype=bool))], names=names)
        release()

    names = ["a", "b", "key", "id", "s1", "s2", "late"]
    found = materialize(spread.mapInArrow(run, "a long, b long, key long, id long, s1 long, s2 long, late boolean"), "near")
    pairs, late = found.where("not late").select("a", "b"), found.where("late").select("key", "id", "s1", "s2")
    if not late.isEmpty():

        def block(table: pa.Table) -> pa.Table:
            m = np.stack([table.column(c).to_numpy() for c in ("key", "id", "s1", "s2")])
            apart = table.column("i")[0].as_py() != table.column("j")[0].as_py()
            got = list(close_pairs(m, tables, signs, SKETCH_MOST, table.column("block").to_numpy() if apart else None))
            return pa.table([np.concatenate([p[k] for p in got]) for k in (0, 1)], names=["a", "b"])

        pairs = pairs.union(block_pairs(late, "key", "id", held).groupBy("key", "i", "j").applyInArrow(block, "a long, b long"))
    return pairs.distinct()


def cosines(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs whose cosine, in double precision, is ``least`` or more."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(batch.num_rows, dtype=bool)
        for (at, x), (_, y) in zip(rows_by_length(batch.column(2)), rows_by_length(batch.column(3)), strict=True):
            keep[at] = (unit(x) * unit(y)).sum(axis=1) >= least
        yield batch.select([0, 1]).filter(pa.array(keep))

    return map_batches(pairs.join(side("a"), "a").join(side("b"), "b").where("size(va) = size(vb)").select("a", "b", "va", "vb"), run, "a long, b long")


def near_vectors(vectors: DataFrame, least: float = 0.95, miss: float = MISS, signs: int = SIGNS, seed: int = SEED, vec_id: str = "vec_id", vector: str = "embedding", held: int = MOST) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors.

    n_links counts the other rows linked directly, equal vectors among them; component_id is the least vec_id reachable; kept marks
    it. Vectors that are null, empty, zero or hold null, NaN or infinite components link with nothing and stand alone; vectors of different
    lengths don't link. Rows with a null vec_id count and link like others and get their component's id, null if no member has one. Rows that
    share a vec_id are each judged by their own vector. Other columns are ignored; an empty table gives an empty result.
    """
    if not 0.9 <= least <= 1:
        raise ValueError("the sketch finds pairs of cosine 0.9 or more")
    rows = bare(vectors, vec_id=F.col(f"`{vec_id}`").cast("long"), v=F.col(f"`{vector}`").cast("array<double>"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.coalesce(~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", F.when(sound, F.col("v")).alias("v"))
    # equal vectors are one class, found by a hash and by their content; its number is given where the classes are written, since ids may repeat or be null
    hashed = rows.select("vec_id", "v", F.xxhash64(F.col("v")).alias("class")).where("v is not null")
    classes = materialize(hashed.groupBy("class", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "classes")
    pairs = materialize(candidates(classes, *table_plan(classes.count(), least, miss, signs), seed, held), "pairs")
    links = materialize(cosines(pairs, classes, least), "links")
    both = links.union(links.select("b", "a")).toDF("id", "other")
    others = both.join(classes.select(F.col("id").alias("other"), "n"), "other").groupBy("id").agg(F.sum("n").alias("more"))
    placed = smallest_members(classes.select(F.col("id").alias("node"), F.col("least").alias("id")), connected_components(links))
    by_class = classes.join(others, "id", "left").join(placed.withColumnRenamed("node", "id"), "id").select("class", "v", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component")
    found = hashed.join(by_class, ["class", "v"]).select("vec_id", "n_links", "component")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    return found.union(alone).select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
