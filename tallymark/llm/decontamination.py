"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised into words and built into one automaton. A document's words stream through it; after
each word the automaton's state and length give the longest run, ending there, that also occurs inside an
item. A run of 13 words or more covers an item's window; items shorter than that must occur whole.

The automaton is broadcast, so its size is bounded: items are cut into shards of at most ``SHARD_WORDS``
words, the documents are read once for each shard (one, for any usual benchmark), and what the shards find is put together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .automaton import SuffixAutomaton
from .common import bare, map_batches, materialize, release, utf8

WINDOW = 13
#: words of items in one broadcast automaton (some 200 MB in a Python worker)
SHARD_WORDS = 400_000
#: maps A-Z to a-z, keeps 0-9, a-z and all bytes of non-ASCII code points, and makes anything else a space
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def normal_words(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


class ItemMatcher:
    """Finds the windows of items in documents."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.automaton = window, SuffixAutomaton()
        words = [(name, normal_words(raw)) for name, raw in items]
        words = [(name, w) for name, w in words if w]
        for _, w in words:
            self.automaton.add(w)
        self.full = self.automaton.holding(window)
        #: items by the state of a whole window; short items, and how many words they have, by theirs
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        for name, w in words:
            for i, (state, length) in enumerate(self.automaton.walk(w)):
                if length >= window:
                    self.items.setdefault(self.full[state], set()).add(name)
                elif i + 1 == len(w):
                    while self.automaton.longest[self.automaton.link[state]] >= length:
                        state = self.automaton.link[state]
                    self.short.setdefault(state, (length, set()))[1].add(name)
        # a short item that the current run ends with lies on the state's chain of links
        self.shorter = [-1] * len(self.full)
        for s in sorted(range(1, len(self.full)), key=self.automaton.longest.__getitem__):
            up = self.automaton.link[s]
            self.shorter[s] = s if s in self.short else self.shorter[up] if up > 0 else -1

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, stop) of words inside windows, joined where they touch, and the items whose windows occur."""
        spans: list[list[int]] = []
        found: set[str] = set()
        window, full, items, short, shorter = self.window, self.full, self.items, self.short, self.shorter
        step, link, longest = self.automaton.step, self.automaton.link, self.automaton.longest
        state, length = 0, 0
        for i, word in enumerate(words):
            nxt = step[state].get(word)
            while nxt is None and state:
                state = link[state]
                length = longest[state]
                nxt = step[state].get(word)
            if nxt is None:
                length = 0
                continue
            state, length = nxt, length + 1
            reach = 0
            if length >= window:
                reach = window
                found |= items[full[state]]
            at = shorter[state]
            while at > 0:
                n, names = short[at]
                if n <= length:
                    reach = max(reach, n)
                    found |= names
                at = shorter[link[at]] if link[at] > 0 else -1
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return [(a, b) for a, b in spans], found


def item_shards(items: DataFrame, item_id: str, text: str, shard_words: int, unnamed: bool = False) -> Iterable[list[tuple[str, bytes]]]:
    """Items in order of id, in lists of at most ``shard_words`` words (or of one longer item)."""
    # a code point outside words may part two words, so half the bytes bound the words of a text
    sized = bare(items, item=F.col(f"`{item_id}`").cast("string"), raw=utf8(text)).where("length(raw) > 0")
    sized = sized if unnamed else sized.where("item is not null")
    part, size = [], 0
    for row in sized.orderBy("item", "raw").toLocalIterator():
        n = len(normal_words(bytes(row.raw)))
        if part and size + n > shard_words:
            yield part
            part, size = [], 0
        part.append((row.item, bytes(row.raw)))
        size += n
    if part:
        yield part


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, text: str = "text", item_id: str = "item_id", item_text: str = "text", unnamed: bool = False) -> DataFrame:
    """docs with ``n_words``, ``spans`` (word spans inside occurring windows) and ``items`` (ids of items with occurring windows, as strings, sorted) added.

    A null or wordless text has no words, spans or items; a null or wordless item matches nothing; items with a null id are
    left out, or matched with the rest and listed as one null, the last, where ``unnamed``; equal items are each found. Repeated rows and ids are each judged alone. Columns of docs called n_words, spans or items are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    shards = iter(item_shards(items, item_id, item_text, shard_words, unnamed))
    first = next(shards, [])
    second = next(shards, None)
    if second is None:
        rows = docs.select(*[F.col(f"`{c}`") for c in keep])
        return _matched(rows, first, window, keep.index(text), rows.schema)
    # more items than one automaton holds: the texts are read for each, only what is found is written, and that is brought to the documents once
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("whole"))
    keyed = materialize(whole.withColumn("key", F.monotonically_increasing_id()), "keyed")
    texts = keyed.select("key", F.col("whole").getField(text).alias("text"))
    kind = keyed.select("key").schema
    found = [materialize(_matched(texts, part, window, 1, kind).where(F.lit(n == 0) | (F.size("spans") > 0)), "hits") for n, part in enumerate(chain([first, second], shards))]
    together = reduce(DataFrame.union, found).groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def joined(batch: pa.RecordBatch):
        spans = [merged([(s["start"], s["stop"]) for s in row]) for row in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(spans, SPANS), pa.array([in_order(row) for row in batch.column(3).to_pylist()], pa.list_(pa.string()))], names=batch.schema.names)

    out = keyed.join(map_batches(together, joined, together.schema), "key")
    return out.select(*[F.col("whole").getField(c).alias(c) for c in keep], "n_words", "spans", "items")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def in_order(names: Iterable[str | None]) -> list[str | None]:
    """Different names by code point, null last."""
    return sorted(set(names), key=lambda name: (name is None, name or ""))


def _matched(rows: DataFrame, part: list[tuple[str, bytes]], window: int, where: int, kept: StructType) -> DataFrame:
    """The columns ``kept`` of rows with n_words, spans and items of this part, found in the text at place ``where``."""
    sent, token = rows.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex
    names = kept.fieldNames()

    def run(batches):
        matcher = _matcher(sent, token, window)
        for batch in batches:
            raws = batch.column(where).cast(pa.large_binary() if pa.types.is_large_string(batch.column(where).type) else pa.binary()).to_pylist()
            n, spans, found = [], [], []
            for raw in raws:
                words = normal_words(raw or b"")
                got, its = matcher.match(words)
                n.append(len(words))
                spans.append(merged(got))
                found.append(in_order(its))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(spans, SPANS), pa.array(found, pa.list_(pa.string()))], names=[*names, "n_words", "spans", "items"])
        release()

    schema = StructType([*kept.fields, StructField("n_words", LongType()),
        StructField("spans", ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))),
        StructField("items", ArrayType(StringType()))])
    return rows.mapInArrow(run, schema)


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and out[-1]["stop"] >= a:
            out[-1]["stop"] = max(out[-1]["stop"], b)
        else:
            out.append({"start": a, "stop": b})
    return out


_built: dict = {}


def _matcher(sent, token: str, window: int) -> ItemMatcher:
    """One automaton a worker, kept while the same items are asked for."""
    if (token, window) not in _built:
        _built.clear()
        _built[token, window] = ItemMatcher(sent.value, window)
    return _built[token, window]


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``find_items`` plus ``n_hit`` (words in spans) and ``contaminated`` (some word hit, and at least 1 in ``share``). Items with a null id count too."""
    found = find_items(docs, items, window, text=text, item_id=item_id, item_text=item_text, unnamed=True)
    out = found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, max_span: int | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``judge`` plus ``clean_text``: the text without the spans that exceed a limit.

    Those are all spans in a contaminated document, elsewhere those of more than ``max_span`` words (None: no such limit). What lies between
    removed words goes with them; a null text stays null.
    """
    out = judge(docs, items, window, share, text, item_id, item_text)
    over = "contaminated" if max_span is None else f"contaminated or (s.stop - s.start > {int(max_span)})"
    removed = F.expr(f"filter(spans, s -> {over})")

    def cut(batches):
        for batch in batches:
            texts, spans = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            out = [None if not t.is_valid else t.as_py() if not len(s) else without(t.as_py(), s.as_py()) for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())], names=[*batch.schema.names[:-2], "clean_text"])

    keep = [F.col(f"`{c}`") for c in out.columns if c != "clean_text"]
    schema = out.select(*keep, F.lit(None).cast("string").alias("clean_text")).schema  # nullable
    return out.select(*keep, F.col(f"`{text}`").alias("_text"), removed.alias("_removed")).mapInArrow(cut, schema)


def without(text: str, spans: list[dict]) -> str:
    """The text less the given word spans."""
    raw = text.encode()
    fold = np.frombuffer(raw.translate(FOLD), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[False, fold, False].astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    kept, at = [], 0
    for s in spans:
        kept.append(raw[at : starts[s["start"]]])
        at = int(stops[s["stop"] - 1])
    return b"".join([*kept, raw[at:]]).decode()
