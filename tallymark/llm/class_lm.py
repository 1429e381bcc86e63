"""Class-based bigram language model: exchange clustering of words into classes.

log p(text) is the sum, over its tokens, of log P(class | class before) and log P(token | class). Tokens are the words of the
text and an end. Training runs over all training documents:

1. Units. The frequent words (those above a count that at most ``KEPT`` words reach) are units of their own; other words stand for
   each other by their endings, in ``TAILS`` units. Texts are written as numbers of units. Their bigrams are counted and written in blocks, each
   with all bigrams of its units in both directions.
2. Exchange. In a round every task walks through its blocks and moves each unit to the class that raises the likelihood of the training
   bigrams most, against class bigrams that it keeps up to date with its own moves. The true class bigrams of the round's result are then
   counted anew: a round that doesn't raise the likelihood is undone. After a round that gains less than ``LEAST_GAIN`` of the likelihood (for all units;
   less for fewer) half as many units are tried, so that moves get in each other's way less, and rounds end when fewer than ``LEAST_SHARE`` would be.

Transitions are interpolated with class frequencies; emissions are counts plus 0.1, of every word its own count. Each class that words
without a unit can fall into keeps room for an unknown one, so probabilities sum to one.

The vocabulary and its counts are a table that grows with the corpus, and so do the bigrams until all of the units' are seen. What reaches the
driver or every executor has a fixed bound: the frequent words with counts and classes, and ``CLASSES`` squared bigrams.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bare, crc_of_id, map_batches, materialize, partitions, release, utf8

#: most words that are units of their own (every executor knows them), units of other words by ending, classes
KEPT, TAILS, CLASSES = 60_000, 4096, 64
ADD = 0.1
END = b""
#: words counted in a worker before they are passed on, and tokens whose bigrams are
FLUSH, CHUNK = 300_000, 1_000_000
#: different bigrams in a worker before they are passed on
MERGED = 4_000_000
#: bigrams that a task merges or a block holds, units whose counts are unpacked together
BLOCK, SLICE = 500_000, 1000
#: relative gain of likelihood that a round of all units must bring, and least share of units that a round tries
LEAST_GAIN, LEAST_SHARE = 1e-3, 1 / 4


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from; a null id is not among them."""
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(10)) == 0, F.lit(False))


def tokens_of(raw: bytes) -> list[bytes]:
    """Words (A-Z folded), then the end, which is the empty string."""
    out = raw.lower().split()
    out.append(END)
    return out


def tail_group(word: bytes, tails: int) -> int:
    """Group of a word that is no unit of its own: by its last three bytes less punctuation, which tells languages and endings apart."""
    return zlib.crc32(word.rstrip(b".,;:!?|)\"'")[-3:]) % tails


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary; empty: the end of a document), c: over all documents of ``docs`` (column raw)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total.update(tokens_of(raw))
                if len(total) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "c"])
                    total.clear()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "c"])
        release()

    return docs.select("raw").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(vocabulary: DataFrame, kept: int) -> list[tuple[bytes, int]]:
    """(word, count) of the words above the least count that at most ``kept`` words reach, most frequent first, the end before all.

    The count is read off a histogram of counts in steps of a 16th of a doubling, so that nothing but these words leaves the executors."""
    step = F.floor(F.log2("c") * 16).cast("int").alias("step")
    sizes = {r.step: r.n for r in vocabulary.where(F.length("word") > 0).groupBy(step).agg(F.count("*").alias("n")).collect()}  # some 1000 rows at most
    least, room = 64 * 16, kept
    for s in sorted(sizes, reverse=True):
        room -= sizes[s]
        if room < 0:
            break
        least = s
    rows = vocabulary.where((F.length("word") == 0) | (step >= least)).collect()  # at most kept + 1 rows
    found = sorted(((bytes(r.word), r.c) for r in rows if r.word), key=lambda r: (-r[1], r[0]))
    return [(END, next((r.c for r in rows if not r.word), 0)), *found]


class Units:
    """Unit of every token: 0 the end, then the frequent words, then the tails of all others."""

    def __init__(self, words: list[bytes], tails: int):
        self.place = {w: i for i, w in enumerate(words)}
        self.tails, self.first_tail = tails, len(words)
        self.size = self.first_tail + tails
        #: how the numbers are written
        self.kind = np.min_scalar_type(self.size - 1)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Units of the words, and those words, in order, that have none of their own."""
        got = list(map(self.place.get, words))
        if None not in got:
            return np.array(got, dtype=np.int32), []
        rare = [w for w, u in zip(words, got, strict=True) if u is None]
        x = np.array([-1 if u is None else u for u in got], dtype=np.int32)
        first, tails = self.first_tail, self.tails
        x[x < 0] = [first + tail_group(w, tails) for w in rare]
        return x, rare


def numbered(rows: DataFrame, units) -> DataFrame:
    """key, doc_id, n, ids (units of the tokens as bytes, of the units' ``kind``), rare (words without a unit, and how often) of every row (doc_id, raw). units: a broadcast ``Units``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        u = units.value
        n, ids, words, times, ends = [], [], [], [], [0]
        for raw in batch.column(1).to_pylist():
            x, rare = u(tokens_of(raw))
            n.append(len(x))
            ids.append(x.astype(u.kind).tobytes())
            here = Counter(rare)
            words += here
            times += here.values()
            ends.append(len(words))
        pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "k"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=["doc_id", "n", "ids", "rare"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = map_batches(rows.select("doc_id", "raw"), run, f"doc_id {kind}, n long, ids binary, rare array<struct<word:binary,k:long>>")
    return materialize(out.withColumn("key", F.monotonically_increasing_id()), "numbered")  # written, so the keys stay


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order, and the sums of their counts."""
    code, c = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, dtype=np.int64)
    return code[first], np.add.reduceat(c[order], first) if len(code) else c


#: bigrams in order of code, as bytes: the unit * 2 + back of each run, how many bigrams it has, the others' units (32 bits each), and counts in as many bytes as the largest takes
PACKED = "part int, heads binary, sizes binary, others binary, counts binary"


def packed(parts: list[int], codes: list[np.ndarray], counts: list[np.ndarray], size: int) -> pa.RecordBatch:
    rows = []
    for code, c in zip(codes, counts, strict=True):
        head = code // size
        first = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
        rows.append([head[first].astype(np.int32), np.diff(np.r_[first, len(code)]).astype(np.int32), (code % size).astype(np.int32), c.astype(np.min_scalar_type(int(c.max())))])
    names = [field.split()[0] for field in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *(pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in range(4))], names=names)


def unpacked(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, codes, counts) of each row, read where they lie."""
    for i, part in enumerate(batch.column(0).to_pylist()):
        heads, sizes, others, counts = (batch.column(k)[i].as_buffer() for k in range(1, 5))
        others = np.frombuffer(others, np.int32)
        c = np.frombuffer(counts, f"u{len(counts) // len(others)}")
        yield part, np.repeat(np.frombuffer(heads, np.int32).astype(np.int64), np.frombuffer(sizes, np.int32)) * size + others, c.astype(np.int64)


def unit_blocks(texts: DataFrame, size: int, kind: np.dtype) -> DataFrame:
    """Blocks (``PACKED``) of whole units with all their bigrams over ``texts`` (column ids).

    code: (unit * 2 + back) * size + other, for the bigrams of a unit with the one after it, or before it where back is 1. The end stands before a
    text's first word too. A worker counts in arrays and deals whole arrays to the parts, so no row is made for a bigram; a part is merged as it
    arrives. A unit has at most two bigrams with each other unit, so a part is bounded whatever the corpus.
    """
    parts = partitions(texts.sparkSession)

    def count(batches) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        tokens = 0

        def add() -> None:
            x = np.concatenate(held).astype(np.int64)
            # a text's last token is the end, so what stands before a first word is what ends the text before
            found[:] = [summed(*zip(*found, np.unique(np.r_[0, x[:-1]] * size + x, return_counts=True), strict=True))]

        def flush() -> Iterator[pa.RecordBatch]:
            pair, c = found[0]
            found[:] = [(pair[:0], c[:0])]
            for back in (0, 1):
                unit, other = (pair % size, pair // size) if back else (pair // size, pair % size)
                part = unit % parts
                order = np.lexsort((other, unit, part)) if back else np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                for p in range(parts):
                    at = order[cut[p] : cut[p + 1]]
                    if len(at):
                        yield packed([p], [(unit[at] * 2 + back) * size + other[at]], [c[at]], size)

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.append(np.frombuffer(raw, kind))
                tokens += len(held[-1])
                if tokens >= CHUNK:
                    add()
                    held, tokens = [], 0
                    if len(found[0][0]) > MERGED:
                        yield from flush()
        if held:
            add()
        yield from flush()
        release()

    def merge(batches) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[list, list]] = {}
        waiting: dict[int, int] = {}
        for batch in batches:
            for part, code, c in unpacked(batch, size):
                codes, counts = found.setdefault(part, ([], []))
                codes.append(code)
                counts.append(c)
                waiting[part] = waiting.get(part, 0) + len(code)
                if waiting[part] > max(BLOCK, len(codes[0])):
                    one = summed(codes, counts)
                    found[part], waiting[part] = ([one[0]], [one[1]]), 0
        for part in list(found):
            code, c = summed(*found.pop(part))
            unit = code // (2 * size)
            at = 0
            while at < len(code):
                stop = int(np.searchsorted(unit, unit[min(at + BLOCK, len(code)) - 1], side="right"))
                yield packed([part], [code[at:stop]], [c[at:stop]], size)
                at = stop
        release()

    dealt = texts.select("ids").mapInArrow(count, PACKED).repartitionById(parts, "part")
    return dealt.mapInArrow(merge, PACKED)


def block_bigrams(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(unit, other, whether other is before it, count) of the bigrams of each block."""
    for _, code, c in unpacked(batch, size):
        head = code // size
        yield head // 2, code % size, head % 2 == 1, c


def summed_bigrams(rows: DataFrame, width: int) -> np.ndarray:
    """Class bigrams from rows (pair, c) with pair = class * width + class after."""
    cc = np.zeros(width * width)
    for r in rows.groupBy("pair").agg(F.sum("c").alias("c")).collect():  # at most width * width rows
        cc[r.pair] = r.c
    return cc.reshape(width, width)


def pair_batch(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["pair", "c"])


def class_bigrams(blocks: DataFrame, of: np.ndarray, width: int) -> np.ndarray:
    """Bigrams of the classes ``of`` the units."""
    sent, size = blocks.sparkSession.sparkContext.broadcast(of), len(of)

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width)
        for batch in batches:
            for u, o, back, c in block_bigrams(batch, size):
                on = ~back
                total += np.bincount(sent.value[u[on]] * width + sent.value[o[on]], weights=c[on], minlength=width * width)
        yield pair_batch(total)

    return summed_bigrams(blocks.mapInArrow(run, "pair long, c long"), width)


def f(x: np.ndarray) -> np.ndarray:
    """x log x; counts are whole numbers, so max(x, 1) only serves x = 0."""
    return x * np.log(np.maximum(x, 1.0))


def likelihood(cc: np.ndarray) -> float:
    """Of the training bigrams under class bigrams, but for a term that no exchange changes."""
    return float(f(cc).sum() - f(cc.sum(axis=1)).sum() - f(cc.sum(axis=0)).sum())


class Table:
    """Class bigrams with what the gain of a move needs. ``both`` holds them twice, row k being what follows class k and then what precedes it; ``logs`` are x log x of its cells."""

    def __init__(self, cc: np.ndarray):
        self.width = len(cc)
        self.both = np.concatenate([cc, cc.T], axis=1)
        self.logs = f(self.both)
        #: tokens before and after, by class
        self.sums = np.concatenate([cc.sum(axis=1), cc.sum(axis=0)])

    @property
    def cc(self) -> np.ndarray:
        return self.both[:, : self.width]

    def shift(self, k: int, near: np.ndarray, own: float, sign: int) -> None:
        """Put a unit with these bigrams (to classes, then from classes; with itself) into class k, or take it out where ``sign`` is -1."""
        w = self.width
        out, into = near[:w], near[w:]
        if sign < 0:
            near, out, into, own = -near, -out, -into, -own
        self.both[k] += near
        self.both[:, k] += into
        self.both[:, w + k] += out
        self.both[k, k] += own
        self.both[k, w + k] += own
        self.sums[:w] += into
        self.sums[w:] += out
        self.sums[k] += out.sum() + own
        self.sums[w + k] += into.sum() + own
        self.logs[k] = f(self.both[k])
        self.logs[:, k], self.logs[:, w + k] = f(self.both[:, k]), f(self.both[:, w + k])

    def gains(self, near: np.ndarray, own: float) -> np.ndarray:
        """Likelihood gained by putting a unit that is in no class into each; class 0 takes none."""
        w = self.width
        some = np.flatnonzero(near)
        gain = (f(self.both[:, some] + near[some]) - self.logs[:, some]).sum(axis=1)
        # the cell of a class with itself is met twice; sums change by the unit's neighbours whatever its class, and by the unit itself in the class it enters
        out, into, d = near[:w], near[w:], self.both.diagonal()
        before, after = self.sums[:w] + into, self.sums[w:] + out
        x = np.stack([d + out + into + own, d, before, after, d + out, d + into, before + (out.sum() + own), after + (into.sum() + own)])
        x = f(x)
        gain += x[:4].sum(axis=0) - x[4:].sum(axis=0)
        gain[0] = -np.inf
        return gain

    def best(self, home: int, near: np.ndarray, own: float) -> int:
        """The class of most gain for a unit that is in none; its home on a tie."""
        gain = self.gains(near, own)
        k = int(gain.argmax())
        return k if gain[k] > gain[home] + 1e-9 else home


def neighbours(u: np.ndarray, o: np.ndarray, back: np.ndarray, c: np.ndarray, of: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, float]]:
    """(unit, bigrams to each class and then from each, with itself) of the units of a block, under the classes ``of`` the others when a slice is begun."""
    starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
    for s in range(0, len(starts), SLICE):
        first = starts[s : s + SLICE]
        stop = starts[s + SLICE] if s + SLICE < len(starts) else len(u)
        part = slice(first[0], stop)
        at = np.repeat(np.arange(len(first)), np.diff(np.r_[first, stop]))
        same = o[part] == u[part]
        cell = at * 2 * width + of[o[part]] + np.where(back[part], width, 0)
        table = np.bincount(cell, weights=np.where(same, 0, c[part]), minlength=len(first) * 2 * width).reshape(-1, 2 * width)
        own = np.bincount(at, weights=np.where(same & ~back[part], c[part], 0), minlength=len(first))
        for i, unit in enumerate(u[first].tolist()):
            yield unit, table[i], own[i]


def moved(blocks: DataFrame, of: np.ndarray, cc: np.ndarray, share: float, turn: int) -> np.ndarray:
    """Classes after a round in which a ``share`` of the units, others each turn, move to their best class; the end stays."""
    sent = blocks.sparkSession.sparkContext.broadcast((of, cc))
    width, size = len(cc), len(of)

    def run(batches) -> Iterator[pa.RecordBatch]:
        of, cc = sent.value
        table, now = Table(cc), of.copy()
        units, classes = [], []
        for batch in batches:
            for u, o, back, c in block_bigrams(batch, size):
                for unit, near, own in neighbours(u, o, back, c, now, width):
                    if not unit or share < 1 and (unit * 2654435761 + turn * 40503) % 65536 >= share * 65536:
                        continue
                    home = int(now[unit])
                    table.shift(home, near, own, -1)
                    best = table.best(home, near, own)
                    table.shift(best, near, own, 1)
                    if best != home:
                        now[unit] = best
                        units.append(unit)
                        classes.append(best)
        yield pa.RecordBatch.from_arrays([pa.array([np.array(units, np.int32).tobytes()], pa.binary()), pa.array([np.array(classes, np.int32).tobytes()], pa.binary())], names=["u", "k"])
        release()

    out = of.copy()
    for r in blocks.mapInArrow(run, "u binary, k binary").collect():  # at most a row a unit in all
        out[np.frombuffer(r.u, np.int32)] = np.frombuffer(r.k, np.int32)
    return out


def exchange(blocks: DataFrame, of: np.ndarray, width: int, log: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class bigrams) after rounds of moves from ``of``; the likelihood of each accepted round is added to ``log``."""
    cc, share, turn = class_bigrams(blocks, of, width), 1.0, 0
    while width > 2 and share >= LEAST_SHARE:
        turn += 1
        tried = moved(blocks, of, cc, share, turn)
        now = class_bigrams(blocks, tried, width)
        rise = likelihood(now) - likelihood(cc)
        if rise > 0:
            of, cc = tried, now
            if log is not None:
                log.append(likelihood(cc))
        if rise <= LEAST_GAIN * share * abs(likelihood(cc)):
            # tasks moved too much at once, or little is left to be gained
            share /= 2
    return of, cc


class Classes:
    """What training has found: the units and their classes, counts of the units, the table of all words (word, c), how many tokens and different words there are, and the number of classes."""

    def __init__(self, units: Units, of: np.ndarray, counts: np.ndarray, vocabulary: DataFrame, total: int, kinds: int, width: int):
        self.units, self.of, self.counts, self.vocabulary, self.total, self.kinds, self.width = units, of, counts, vocabulary, total, kinds, width


def train(rows: DataFrame, kept: int = KEPT, tails: int = TAILS, classes: int = CLASSES, log: list[float] | None = None) -> tuple[Classes, DataFrame]:
    """Classes of all words of the rows (doc_id, raw) that are not held out, and all rows as numbers of units."""
    spark = rows.sparkSession
    vocabulary = materialize(word_counts(rows.where(~held_out())), "vocabulary")
    total, kinds = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    often = frequent(vocabulary, kept)
    units = Units([w for w, _ in often], tails)
    texts = numbered(rows, spark.sparkContext.broadcast(units))
    width = max(2, min(classes, units.size))
    # the end has class 0 to itself; others start by frequency, in turn, the tails after them
    of = np.r_[0, 1 + np.arange(units.size - 1) % (width - 1)].astype(np.int64)
    blocks = materialize(unit_blocks(texts.where(~held_out()), units.size, units.kind), "blocks")
    of, _ = exchange(blocks, of, width, log)
    return Classes(units, of, np.array([c for _, c in often], dtype=np.int64), vocabulary, total, kinds, width), texts


class ClassModel:
    def __init__(self, cc: np.ndarray, kinds: np.ndarray, mass: np.ndarray, open_classes: np.ndarray):
        """cc: class bigrams. Of each class: distinct training words, their tokens, and whether unknown words can fall into it."""
        k = len(cc)
        base = (mass + ADD) / (mass.sum() + ADD * k)
        before = cc.sum(axis=1, keepdims=True)
        followers = (cc > 0).sum(axis=1, keepdims=True)
        # Witten-Bell: a class passes on as much as it has followers
        seen = before + followers > 0
        self.transition = np.log10(np.where(seen, (cc + followers * base) / np.maximum(before + followers, 1), base))
        self.room = np.log10(np.maximum(mass + ADD * (kinds + open_classes), 1e-300))

    def terms(self, c: np.ndarray) -> float:
        """Transition terms less the emissions' denominators, from the tokens' classes; log10(c + 0.1) of each token is still to be added."""
        return float(self.transition[np.r_[0, c[:-1]], c].sum() - self.room[c].sum())


def fitted(found: Classes, texts: DataFrame) -> ClassModel:
    """The model of the classes, with class bigrams, tokens and words of the training rows."""
    width, of, kind = found.width, found.of, found.units.kind
    first_tail, tails = found.units.first_tail, found.units.tails
    sent = texts.sparkSession.sparkContext.broadcast(of)

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                c = sent.value[np.frombuffer(raw, kind)]
                total += np.bincount(np.r_[0, c[:-1]] * width + c, minlength=width * width)
        yield pair_batch(total)

    def by_tail(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(tails, dtype=np.int64)
        for batch in batches:
            own = [tail_group(w, tails) for w in batch.column(0).to_pylist() if w not in known.value]
            total += np.bincount(np.array(own, dtype=np.int64), minlength=tails)
        yield pair_batch(total)

    cc = summed_bigrams(texts.where(~held_out()).select("ids").mapInArrow(run, "pair long, c long"), width)
    known = texts.sparkSession.sparkContext.broadcast(found.units.place)
    kinds = np.bincount(of[:first_tail], weights=found.counts > 0, minlength=width)
    rows = found.vocabulary.select("word").mapInArrow(by_tail, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
    for r in rows.collect():  # a row an ending's unit
        kinds[of[first_tail + r.pair]] += r.c
    open_classes = np.zeros(width)
    open_classes[of[first_tail:]] = 1
    return ClassModel(cc, kinds, cc.sum(axis=0), open_classes)


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **sizes) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row; learns from the rows not held out.

    score: log10 probability of the text under the class model; base_score: the same under single words with 0.1 added. A null or empty
    text has the end as its only token. Without training rows every token is unknown. Null and repeated doc_ids and repeated rows are
    scored row by row; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    found, texts = train(bare(docs, doc_id=doc_id, raw=utf8(text)), **sizes)
    model = fitted(found, texts)
    sent = spark.sparkContext.broadcast((model, found.of, found.counts, found.units.first_tail))
    kind_of_ids = found.units.kind

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model, of, counts, first_tail = sent.value
        logs = np.log10(counts + ADD)
        emitted, known, terms = [], [], []
        for raw in batch.column(3).to_pylist():
            x = np.frombuffer(raw, kind_of_ids)
            own = x[x < first_tail]
            emitted.append(float(logs[own].sum()))
            known.append(int((counts[own] > 0).sum()))
            terms.append(model.terms(of[x]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(emitted, pa.float64()), pa.array(known, pa.int64()), pa.array(terms, pa.float64())], names=["key", "doc_id", "n", "emitted", "known", "terms"])

    kind = docs.schema[doc_id].dataType.simpleString()
    mine = map_batches(texts.select("key", "doc_id", "n", "ids"), run, f"key long, doc_id {kind}, n long, emitted double, known long, terms double")
    # words without a unit bring their counts along from the vocabulary
    looked = texts.select("key", F.inline("rare")).join(found.vocabulary, "word", "left")
    rest = looked.groupBy("key").agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("found"))
    done = mine.join(rest, "key", "left")
    emitted = F.col("emitted") + F.coalesce("more", F.lit(0.0))
    score = emitted + F.col("terms")
    base_room = float(np.log10(found.total + ADD * (found.kinds + 1)))
    return done.select(
        "doc_id", held_out().alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(found.total).cast("long").alias("train_tokens"),
        (emitted - F.col("n") * F.lit(base_room)).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n")).alias("perplexity"),
    )
