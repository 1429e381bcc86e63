"""Removal of passages that occur elsewhere, with suffix automata of reference shards.

The corpus is its own reference, so one broadcast automaton of it would grow with the input. It is cut into shards by
content instead. Every window (35 words) has a minimizer: the least hashed run of 16 words inside it. Equal windows have equal
minimizers, so consecutive windows with one minimizer, a *run*, go together to the shard of that minimizer, and all occurrences
of a window meet there. Runs whose minimizer occurs once can't hold a repeated window and go no further. Equal runs are sent
once, with their number. Each shard builds a suffix automaton of its runs and streams the same runs through it: wherever the
match reaches a whole window, the automaton's weighted number of occurrences tells if it also starts anywhere else.

A minimizer with very many different runs (a common phrase in ever new surroundings) would be too much for one shard. Its runs are cut
anew by a longer minimizer, halfway from the last to the window, and so on until the runs that meet are few or the minimizer is the window
itself. Automata judge the pieces, and the runs they came from gather the verdicts.

Runs count as equal where both the hash of the minimizer and that of the whole run agree, so two different runs are taken for one only if
64-bit hashes clash within one minimizer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import bare, map_batches, materialize, partitions, utf8, with_key

WINDOW, ANCHOR = 35, 16
#: words in one automaton, and different runs of a minimizer from which they are cut anew
SHARD_WORDS, WIDE = 20_000, 256
MEMO = 400_000
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)

_memo: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    memo = _memo
    fresh = set(words).difference(memo)
    if len(memo) + len(fresh) > MEMO:
        memo.clear()
        fresh = set(words)
    digest = xxhash.xxh3_64_intdigest
    for w in fresh:
        memo[w] = digest(w)
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(count - 1, base, dtype=np.uint64)])


UP, DOWN = powers(ODD, 4096), powers(INVERSE, 4096)


class Hasher:
    """Hashes of any ranges of a word sequence, the same wherever the range stands."""

    def __init__(self, words: list[bytes]):
        h = word_hashes(words)
        n = len(h)
        self.up, down = (UP, DOWN) if n < len(UP) else (powers(ODD, n + 1), powers(INVERSE, n))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(h * down[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.up[start] + (stop - start).astype(np.uint64))


def leftmost_least(v: np.ndarray, width: int) -> np.ndarray:
    """Position of the first least value in each range of ``width`` values."""
    at, have = np.arange(len(v)), 1
    while have < width:
        shift = min(have, width - have)
        a, b = at[: len(at) - shift], at[shift:]
        at = np.where(v[b] < v[a], b, a)
        have += shift
    return at


def runs_of(words: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(minimizer, hash of the run's words, first window, number of windows) of the runs of a document."""
    none = np.zeros(0, dtype=np.int64)
    if len(words) < window:
        return none, none, none, none
    h = Hasher(words)
    at = np.arange(len(words) - anchor + 1)
    grams = h.ranges(at, at + anchor)
    least = leftmost_least(grams, window - anchor + 1)
    first = np.flatnonzero(np.r_[True, np.diff(least) != 0])
    number = np.diff(np.r_[first, len(least)])
    whole = h.ranges(first, first + number + window - 1)
    return grams[least[first]].view(np.int64), whole.view(np.int64), first, number


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(key, doc_id, text) with a key of its own for each row."""
    return with_key(bare(docs, doc_id=doc_id, text=utf8(text)), key="key")


def run_rows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = [(key, *runs_of(raw.split(), window, anchor)) for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        got = [g for g in got if len(g[1])]
        if got:
            m, g, at, n = (np.concatenate([x[i] for x in got]) for i in (1, 2, 3, 4))
            key = np.repeat(np.array([x[0] for x in got], dtype=np.int64), [len(x[1]) for x in got])
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(g), pa.array(key), pa.array(at * 64 + n)], names=["m", "g", "key", "at"])

    return map_batches(rows.select("key", "text"), run, "m long, g long, key long, at long")


def reference_rows(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """m, g, c, words of the wanted runs (columns m, g, c, key, at)."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("m", "g", "c", "at")).alias("runs"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for raw, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = raw.split()
            for r in runs:
                start, n = divmod(r["at"], 64)
                out.append((r["m"], r["g"], r["c"], b" ".join(words[start : start + n + window - 1])))
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["m", "g", "c", "words"])

    return map_batches(rows.join(lists, "key").select("text", "runs"), run, "m long, g long, c long, words binary")


def cut_anew(found: DataFrame, window: int, anchor: int) -> DataFrame:
    """pm, pg, off, m, g, c, words: the runs of ``found`` (m, g, c, words) cut by minimizers of ``anchor`` words, with the run and the window of it that each piece begins with."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for pm, pg, c, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            words = raw.split(b" ")
            m, g, first, number = (x.tolist() for x in runs_of(words, window, anchor))
            out += [(pm, pg, at, m[i], g[i], c, b" ".join(words[at : at + number[i] + window - 1])) for i, at in enumerate(first)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["pm", "pg", "off", "m", "g", "c", "words"])

    return map_batches(found.select("m", "g", "c", "words"), run, "pm long, pg long, off int, m long, g long, c long, words binary")


def judged(found: DataFrame, window: int, anchor: int, shard_words: int, wide: int) -> DataFrame:
    """m, g, mask of the runs of ``found`` (m, g, c, words; each different run once) that hold repeated windows. ``found`` is cut by minimizers of ``anchor`` words."""
    # only the few wide minimizers come back; where the minimizer is the window, all runs that meet are equal
    wide_m = materialize(found.groupBy("m").agg(F.count("*").alias("kinds")).where(F.lit(anchor < window) & (F.col("kinds") > wide)).select("m"), "wide")
    some = not wide_m.isEmpty()
    narrow = found.join(wide_m, "m", "left_anti") if some else found
    dealt = narrow.select("m", "g", "c", "words").repartition(partitions(found.sparkSession), "m").sortWithinPartitions("m", "g")
    marks = dealt.mapInArrow(lambda b: judge_shards(b, window, shard_words), "m long, g long, mask long")
    if not some:
        return marks
    longer = (anchor + window + 1) // 2
    parts = materialize(cut_anew(found.join(wide_m, "m", "left_semi"), window, longer), "parts")
    # pieces whose minimizer occurs once hold no repeated window
    often = materialize(parts.groupBy("m").agg(F.sum("c").alias("n")).where("n > 1").select("m"), "often")
    pieces = materialize(parts.join(often, "m", "left_semi").groupBy("m", "g").agg(F.sum("c").alias("c"), F.min("words").alias("words")), "pieces")
    below = materialize(judged(pieces, window, longer, shard_words, wide), "judged")
    gathered = parts.select("pm", "pg", "off", "m", "g").join(below, ["m", "g"]).groupBy("pm", "pg").agg(F.bit_or(F.expr("shiftleft(mask, off)")).alias("mask"))
    return marks.union(gathered)


def judge_shards(batches: Iterator[pa.RecordBatch], window: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    """(m, g, mask) of runs with repeated windows; batches (m, g, c, words) are sorted by m."""

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        automaton = SuffixAutomaton()
        split = [(m, g, c, words.split(b" ")) for m, g, c, words in rows]
        for _, _, c, words in split:
            automaton.add(words, c)
        number, holding, out = automaton.occurrences(), automaton.holding(window), []
        for m, g, _, words in split:
            mask = 0
            for i, (state, length) in enumerate(automaton.walk(words), 1 - window):
                if length >= window and number[holding[state]] > 1:
                    mask |= 1 << i
            if mask:
                out.append((m, g, mask))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["m", "g", "mask"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > shard_words and row[0] != held[-1][0]:
                yield judge(held)
                held, size = [], 0
            held.append(row)
            size += row[3].count(b" ") + 1
    if held:
        yield judge(held)


def repeated_runs(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS, wide: int = WIDE) -> DataFrame:
    """key, runs (first window * 64 + number of windows, and the mask of those windows that occur elsewhere) of rows (key, text)."""
    spark = rows.sparkSession
    if not 0 < anchor <= window or window - anchor > 40:
        raise ValueError("a run has as many windows as fit a mask: window - anchor is at most 40")
    runs = materialize(run_rows(rows, window, anchor), "runs")
    # what these joins look up is written first: then both sides have an exchange, and Spark splits the rows of a hot minimizer or window
    often = materialize(runs.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m"), "often")
    shared = materialize(runs.join(often, "m", "left_semi"), "shared")
    kinds = shared.groupBy("m", "g").agg(F.count("*").alias("c"), F.min(F.struct("key", "at")).alias("one")).select("m", "g", "c", "one.key", "one.at")
    found = materialize(reference_rows(rows, kinds, window), "reference")
    marks = shared.join(judged(found, window, anchor, shard_words, wide), ["m", "g"])
    return marks.groupBy("key").agg(F.collect_list(F.struct("at", "mask")).alias("runs"))


def covered(n_words: int, runs: list[dict] | None, window: int) -> np.ndarray:
    """Which words lie in repeated windows. A run has at most ``window`` windows, so its repeated ones cover one stretch, from the first's start to the last's end."""
    edge = np.zeros(n_words + 1, dtype=np.int32)
    for r in runs or ():
        start, mask = r["at"] >> 6, r["mask"]
        edge[start + (mask & -mask).bit_length() - 1] += 1
        edge[start + mask.bit_length() - 1 + window] -= 1
    return np.cumsum(edge)[:n_words] > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space), spans (removed [start, stop) word spans), a row for each row.

    A word goes if a window of ``window`` words that covers it also starts anywhere else in the corpus, the same document included, so of
    equal long texts none stays. Texts that are null, empty or shorter than a window lose nothing. Null or repeated doc_ids are told apart
    by row; other columns are ignored; an empty table gives an empty result.
    """
    rows = keyed(docs, text, doc_id)
    marks = repeated_runs(rows.select("key", "text"), window)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, gone, sha, kept, spans = [], [], [], [], []
        for raw, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = raw.split()
            edge = np.zeros(0, dtype=np.int64)
            if runs:
                out = covered(len(words), runs, window)
                edge = np.flatnonzero(np.diff(np.r_[False, out, False].astype(np.int8)))
            stops = [0, *edge.tolist(), len(words)]
            left = b" ".join([w for a, b in zip(stops[::2], stops[1::2], strict=True) for w in words[a:b]] if len(edge) else words)
            n.append(len(words))
            gone.append(int((edge[1::2] - edge[::2]).sum()))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode())
            spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
        columns = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(rows.join(marks, "key", "left").select("doc_id", "text", "runs"), run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:int,stop:int>>")
