"""Which source row is which target row."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ReconcileError
from ..functions.normalize import normalized
from ..options import DiffOptions
from ..plans.header import HeaderModel
from ..plans.storage import stage
from .order import ranked

#: cells of unmatched source rows beyond which pairing by likeness is given up (after signatures have shrunk to one column)
MOST_CELLS, SIGNATURE = 1 << 20, 8


def forms(side: str, model: HeaderModel, options: DiffOptions) -> list[Column]:
    """Compared forms of the cells of a side (columns s0.. or t0..)."""
    return [normalized(F.col(f"{side}{i}"), model.types[i], options.compare, model.label(i)) for i in range(model.width)]


def keys_of(df: DataFrame, side: str, model: HeaderModel, options: DiffOptions) -> DataFrame:
    out = forms(side, model, options)
    return df.select("*", *[out[i].alias(f"_k{n}") for n, i in enumerate(model.key_columns)])


def duplicate_keys(side: DataFrame, names: list[str], number: str) -> DataFrame:
    """(keys, rows with them, first and second of their numbers) of keys that stand more than once. Both steps combine on the map side, so a hot key moves as one row a task."""
    first = side.groupBy(*names).agg(F.count("*").alias("n"), F.min(number).alias("first")).where("n > 1")
    rows = side.select(*names, F.col(number).alias("number")).join(first, names).where("number > first")
    return rows.groupBy(*names, "n", "first").agg(F.min("number").alias("second"))


def by_key(source: DataFrame, target: DataFrame, model: HeaderModel, options: DiffOptions, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Full outer join on the compared form of the key columns, ``finish``ed and written once, as all else starts from it.

    Rows of a key are counted where the join has brought them together, and those of a key that stands more than once on a side are not joined; if there are any, the first
    is reported."""
    keys = [f"_k{n}" for n in range(len(model.key_columns))]
    one = Window.partitionBy(*keys)
    s, t = (keys_of(df, side, model, options).withColumn(f"_{side}n", F.count("*").over(one)) for df, side in ((source, "s"), (target, "t")))
    same = [s[k] == t[k] for k in keys]
    out = s.join(t, [*same, s["_sn"] == 1, t["_tn"] == 1], "full_outer")
    out = out.select(*[F.coalesce(s[k], t[k]).alias(k) for k in keys], *[c for df in (s, t) for c in df.columns if c not in keys], F.lit("key").alias("via"))
    out = stage(finish(out), "joined")
    most = out.agg(F.max("_sn"), F.max("_tn")).first()
    for side, name, n in zip("st", ("source", "target"), most, strict=True):
        if (n or 0) > 1:
            found = duplicate_keys(out.where(F.col(f"_{side}n") > 1), keys, f"{side}_row").orderBy("second").head()
            shown = ", ".join(f"{model.label(i)}={found[f'_k{n}']!r}" for n, i in enumerate(model.key_columns))
            raise ReconcileError("DUPLICATE_KEY", f"the {name} has the key {shown} in row {found['first']} and again in row {found['second']}")
    return out.drop(*keys, "_sn", "_tn")


def by_content(source: DataFrame, target: DataFrame, model: HeaderModel, options: DiffOptions) -> DataFrame:
    """The k-th target row of some content is the k-th source row of that content; full outer join on content and k.

    Content is moved and compared as two independent 64-bit hashes of all compared forms and where they end, 128 bits in all."""
    names = ["_h", "_g"]

    def counted(df: DataFrame, side: str) -> DataFrame:
        parts = forms(side, model, options)
        seeded = [F.xxhash64(F.lit(seed), *[x for v in parts for x in (v, F.octet_length(v))]).alias(n) for seed, n in enumerate(names)]
        return ranked(df.select("*", *seeded), f"{side}_idx", [f"{side}_idx"], "_nth", within=names)

    return counted(source, "s").join(counted(target, "t"), [*names, "_nth"], "full_outer").drop(*names, "_nth").withColumn("via", F.lit("content"))


def likeness_pairs(left: pd.DataFrame, width: int, k: int, percent: int, most_work: int | None) -> tuple[list[tuple[int, int]], bool]:
    """Greedy pairs (source, target) of unmatched rows, in target order, and whether the work ran out.

    ``left`` has side, idx, raw and norm (lists). A target's candidates share one of its first signature cells (those with any text), taken cell by cell
    and in source order, up to k. The best share of equal cells wins, the earliest on a tie, if it reaches ``percent``. Without ``most_work`` nothing is given up.
    """
    sources = left[left.side == "s"].sort_values("idx")
    targets = left[left.side == "t"].sort_values("idx")
    columns = SIGNATURE
    while most_work is not None and columns > 1 and len(sources) * columns > MOST_CELLS:
        columns -= 1
    if most_work is not None and len(sources) * columns > MOST_CELLS:
        return [], True
    signature = lambda raw: [c for c in range(width) if raw[c] != ""][:columns]
    rows = dict(zip(sources.idx, (tuple(n) for n in sources.norm), strict=True))
    holders: dict = defaultdict(list)
    for idx, raw, norm in zip(sources.idx, sources.raw, sources.norm, strict=True):
        for c in signature(raw):
            holders[c, norm[c]].append(idx)
    used: set = set()
    pairs, work = [], 0
    for idx, raw, norm in zip(targets.idx, targets.raw, targets.norm, strict=True):
        if most_work is not None and work > most_work:
            return pairs, True
        candidates: dict = {}
        for c in signature(raw):
            held = holders.get((c, norm[c]), ())
            passed = 0
            for h in held:
                if len(candidates) >= k:
                    break
                if h in used:
                    passed += 1
                else:
                    candidates[h] = None
            if passed > 32:  # so a row that is used up is passed by few times only
                holders[c, norm[c]] = [h for h in held if h not in used]
            if len(candidates) >= k:
                break
        best, top = None, -1
        for h in candidates:
            work += width
            score = 100 * sum(a == b for a, b in zip(rows[h], norm, strict=True)) // width
            if score > top or (score == top and h < best):
                best, top = h, score
        if best is not None and top >= percent:
            used.add(best)
            pairs.append((best, idx))
    return pairs, False


def cells_of(df: DataFrame, side: str, model: HeaderModel, options: DiffOptions) -> DataFrame:
    """{side}_idx, c, v: the compared form of each cell with any text."""
    each = [F.when(F.col(f"{side}{i}") != "", F.struct(F.lit(i).alias("c"), v.alias("v"))) for i, v in enumerate(forms(side, model, options))]
    return df.select(f"{side}_idx", F.inline(F.array_compact(F.array(*each))))


def by_likeness(joined: DataFrame, model: HeaderModel, options: DiffOptions) -> tuple[DataFrame, bool]:
    """Pairs up unmatched rows of ``joined``; whether it gave up early. The pairing is greedy along the target, so one task does it; its work has fixed bounds."""
    cells = lambda side: F.array(*[F.col(f"{side}{i}") for i in range(model.width)])
    norm = lambda side: F.array(*forms(side, model, options))
    alone = stage(joined.where("s_idx is null or t_idx is null"), "unmatched")
    sizes = {r.s: r.n for r in alone.groupBy(F.col("t_idx").isNull().alias("s")).agg(F.count("*").alias("n")).collect()}
    if not sizes.get(True) or not sizes.get(False):
        return joined, False
    if options.work is not None and sizes[True] > MOST_CELLS:
        return joined, True
    own = lambda side: [c for c in joined.columns if c.startswith(side)]
    s, t = alone.where("t_idx is null").select(*own("s")), alone.where("s_idx is null").select(*own("t"))
    # a target that shares no cell with any source has no candidate; the last target shows whether the work ran out before the end
    some = cells_of(t, "t", model, options).join(cells_of(s, "s", model, options).select("c", "v").distinct(), ["c", "v"], "left_semi").select("t_idx").distinct()
    some = some.union(t.agg(F.max("t_idx"))).distinct()
    sides = s.select(F.lit("s").alias("side"), F.col("s_idx").alias("idx"), cells("s").alias("raw"), norm("s").alias("norm"))
    sides = sides.union(t.join(some, "t_idx", "left_semi").select(F.lit("t"), "t_idx", cells("t"), norm("t")))
    width, k, percent, work = model.width, options.k, options.percent, options.work

    def pair(left: pd.DataFrame) -> pd.DataFrame:
        pairs, short = likeness_pairs(left, width, k, percent, work)
        return pd.DataFrame([*pairs, *([(-1, -1)] if short else [])], columns=["s_idx", "t_idx"], dtype="int64")

    pairs = stage(sides.groupBy().applyInPandas(pair, "s_idx long, t_idx long"), "pairs")
    short = not pairs.where("s_idx < 0").isEmpty()
    pairs = pairs.where("s_idx >= 0")
    paired = pairs.join(s, "s_idx").join(t, "t_idx").withColumn("via", F.lit("likeness")).select(*joined.columns)
    rest = [alone.where("t_idx is null").join(pairs.select("s_idx"), "s_idx", "left_anti").select(*joined.columns), alone.where("s_idx is null").join(pairs.select("t_idx"), "t_idx", "left_anti").select(*joined.columns)]
    return reduce(DataFrame.unionByName, [joined.where("s_idx is not null and t_idx is not null"), paired, *rest]), short
