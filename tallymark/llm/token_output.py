"""Token ids as fixed-width bit-packed binary shards.

A shard is one byte string: header, document table, block offsets, payload. Every id takes the fewest
bits that hold the vocabulary; each block of ids starts at a byte boundary, so any range of ids is read by
unpacking the blocks it touches, with numpy and without a loop over ids.

Shards are the rows of a table that Spark commits (binary column ``shard``), so a lost executor or a
second attempt of a task never leaves half a file behind, on any store that Spark can write.
``export_shards`` puts them into plain files where a training job wants such.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Remembered, bare, map_batches, materialize, partitions, release, utf8
from .token_counts import LATIN, MEMO_CHARS, byte_alphabet, chunks_of, groups

HEAD = struct.Struct("<4sHHIQII")  # magic, version, bits, documents, ids, ids a block, blocks
MAGIC, VERSION = b"TMTK", 1
BLOCK = 4096
#: ids after which a shard is closed
SHARD = 2_000_000
#: half the chunks whose ids a Python worker remembers, and marks that never join letters before them (an apostrophe may)
REMEMBERED, MARKS = 150_000, b".,;:!?|)#$%&*\"-_=+/"


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_block(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit order: bit j of id i is bit i * bits + j of the block."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_block(raw, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = [pack_block(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    null = np.packbits(np.array([d is None for d in doc_ids], dtype=np.uint8), bitorder="little")
    return b"".join([
        HEAD.pack(MAGIC, VERSION, bits, len(doc_ids), len(ids), block, len(blocks)),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), null.tobytes(), np.cumsum([0, *lengths]).astype("<u8").tobytes(), offsets.tobytes(), *blocks,
    ])


class Shard:
    """Random access to a packed shard; ``raw`` may be bytes or a memory map."""

    def __init__(self, raw):
        self.raw = memoryview(raw)
        magic, version, self.bits, self.n_docs, self.n_ids, self.block, blocks = HEAD.unpack_from(self.raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        at = HEAD.size
        ids = np.frombuffer(self.raw, dtype="<i8", count=self.n_docs, offset=at)
        at += 8 * self.n_docs
        null = np.unpackbits(np.frombuffer(self.raw, dtype=np.uint8, count=(self.n_docs + 7) // 8, offset=at), count=self.n_docs, bitorder="little")
        at += (self.n_docs + 7) // 8
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.bounds = np.frombuffer(self.raw[at : at + 8 * (self.n_docs + 1)], dtype="<u8").astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.offsets = np.frombuffer(self.raw[at : at + 8 * (blocks + 1)], dtype="<u8").astype(np.int64)
        self.payload = at + 8 * (blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard, by unpacking only the blocks that hold them."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError((start, stop, self.n_ids))
        if start == stop:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        raw = self.raw[self.payload + int(self.offsets[first]) : self.payload + int(self.offsets[last + 1])]
        if self.block * self.bits % 8 == 0:  # whole blocks end at bytes: one unpacking for all
            got = unpack_block(raw, min((last + 1) * self.block, self.n_ids) - first * self.block, self.bits)
        else:
            got = np.concatenate([unpack_block(self.raw[self.payload + int(self.offsets[b]) : self.payload + int(self.offsets[b + 1])],
                min(self.block, self.n_ids - b * self.block), self.bits) for b in range(first, last + 1)])
        return got[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.bounds[i]), int(self.bounds[i + 1]))


class Encoder:
    """Ids from the tokenizers library. White space never reaches a token of ``word``-type files, so the ids of chunks are remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        pre = self.tokenizer.to_str()
        self.by_chunk = '"behavior":"Removed","invert":true' in pre.replace(": ", ":").replace(", ", ",")
        self.memo = Remembered(REMEMBERED)
        self.folds = "Lowercase" in pre
        self.hint = os.path.commonprefix([t.content for t in self.tokenizer.get_added_tokens_decoder().values()]).encode()
        if self.by_chunk:
            ends = [t.endswith("</w>") for t in (self.tokenizer.id_to_token(i) or "" for i in range(self.vocabulary))]
            self.by_chunk, self.ends_word = any(ends), np.array(ends)
            spec = json.loads(pre) | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
            self.plain = Tokenizer.from_str(json.dumps(spec))
            self.shown = dict(enumerate(byte_alphabet())) | {32: " "}

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def raw_letters(self, words: list[bytes]) -> list[bytes]:
        """As ``raw`` for words of lower-case letters only. Each is one pre-token, so the library's model alone does; its last id, and no other, ends a word, so many go through as one text."""
        out: list[bytes] = []
        for i in range(0, len(words), 4000):
            text = b" ".join(words[i : i + 4000]).decode("latin-1").translate(self.shown)
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
            out += [raw[x:y] for x, y in zip(at, at[1:], strict=False)]
        return out

    def ids_of(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Ids of different chunks. Marks behind letters are a pre-token of their own, so both are looked up apart."""
        got, fresh = self.memo.take(chunks)
        plain, marked, rest = set(), [], []
        for w in fresh:
            base = w.rstrip(MARKS)
            if not (base.isalpha() or base and not base.translate(None, LATIN) and base.decode().isalpha()):
                rest.append(w)
            elif len(base) == len(w):
                plain.add(w)
            else:
                marked.append((w, base, w[len(base) :]))
        known, bases = self.memo.take({b for _, b, _ in marked}.difference(got, plain))
        got |= known
        letters = [*plain, *bases]
        learned = dict(zip(letters, self.raw_letters([w.lower() if w.isascii() else w.decode().lower().encode() for w in letters]), strict=True))
        learned.update(zip(rest, self.raw([w.decode() for w in rest]), strict=True))
        self.memo.put(learned if max(map(len, learned), default=0) <= MEMO_CHARS else {k: v for k, v in learned.items() if len(k) <= MEMO_CHARS})
        got |= learned
        marks = {t for _, _, t in marked}
        ids = dict(zip(marks, self.raw([t.decode() for t in marks]), strict=True))
        for w, b, t in marked:
            got[w] = got[b] + ids[t]
        return got

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8) as little-endian unsigned 32-bit integers."""
        if not self.by_chunk:
            return self.raw([t.decode() for t in texts])
        split = [chunks_of(t, self.folds, self.hint) for t in texts]
        chunks: set[bytes] = set()
        chunks.update(*split)
        got = self.ids_of(chunks)
        return [b"".join(map(got.__getitem__, words)) for words in split]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text.encode()])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def dealt_by_range(rows: DataFrame, column: str) -> DataFrame:
    """Rows dealt to partitions that follow each other along a long column, nulls first. Only that column is read to find the bounds; repartitionByRange would read the texts twice."""
    n = partitions(rows.sparkSession)
    found = rows.select(F.percentile_approx(column, [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    bounds = sorted(set(found))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(column))) if bounds else F.lit(0)
    return rows.repartitionById(len(bounds) + 1, F.when(F.col(column).isNull(), 0).otherwise(part).cast("int"))


def write_shards(docs: DataFrame, tokenizer: str, end_id: int | None = 1, shard_ids: int = SHARD) -> DataFrame:
    """Shards of all documents in ascending doc_id order (nulls first, ties by text): part, seq, first (ids before it in its part), n_docs, n_ids, shard.

    The range partitioning carries the order across shards, so only one pass sorts and nothing is gathered.
    The result is a committed table in the shared folder.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        bits = bits_for(max(enc.vocabulary, (end_id or 0) + 1))
        tail = b"" if end_id is None else struct.pack("<I", end_id)
        doc_ids, lengths, held, size, seq, first = [], [], [], 0, 0, 0

        def close():
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([len(doc_ids)], pa.int64()),
                    pa.array([size], pa.int64()), pa.array([pack_shard(doc_ids, lengths, ids, bits)], pa.binary())],
                names=["part", "seq", "first", "n_docs", "n_ids", "shard"],
            )

        for batch in batches:
            encoded = (raw for texts in groups(batch.column(1).to_pylist()) for raw in enc.encode_many(texts))
            for d, raw in zip(batch.column(0).to_pylist(), encoded, strict=True):
                raw += tail
                doc_ids.append(d)
                lengths.append(len(raw) // 4)
                held.append(raw)
                size += len(raw) // 4
                if size >= shard_ids or len(doc_ids) >= 65536:
                    yield close()
                    first, seq = first + size, seq + 1
                    doc_ids, lengths, held, size = [], [], [], 0
        if doc_ids:
            yield close()
        release()

    ordered = dealt_by_range(bare(docs, doc_id=F.col("doc_id").cast("long"), raw=utf8()), "doc_id").sortWithinPartitions("doc_id", "raw")
    return materialize(ordered.mapInArrow(run, "part int, seq int, first long, n_docs long, n_ids long, shard binary"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids) of every document in ``shards``."""
    # one row for each range partition: as many as the writer had partitions, whatever the input
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = Shard(raw.as_buffer())
            crc, step = [], max(1, s.n_docs // 64)
            for i in range(0, s.n_docs, step):  # a few documents at a time: the unpacked ids take twice the room
                j = min(s.n_docs, i + step)
                ids, lo = s.ids(int(s.bounds[i]), int(s.bounds[j])).astype("<u4"), s.bounds[i]
                crc += [zlib.crc32(ids[a - lo : b - lo]) for a, b in zip(s.bounds[i:j], s.bounds[i + 1 : j + 1], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(start + s.bounds[:-1], pa.int64()), pa.array(np.diff(s.bounds), pa.int64()),
                pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = shards.select("part", "first", "shard").join(F.broadcast(base), "part")
    return map_batches(placed.select((F.col("base") + F.col("first")).alias("start"), "shard"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int | None = 1) -> DataFrame:
    """Write every text's ids (null: empty, so only the end id) as shards, and read them back.

    Ties of doc_id are ordered by text, null ids come first, equal rows give equal ids; an empty table gives no shard
    and no row; columns besides doc_id and text are ignored; a very long text stays whole in one shard.
    """
    return read_shards(write_shards(docs, tokenizer, end_id))


def export_shards(shards: DataFrame, folder: str) -> int:
    """Write every shard as a plain file ``part-seq.tmtk`` into a folder that all nodes share; returns the number of files.

    Each file is written under another name and then renamed, so a second attempt replaces it whole.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for part, seq, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            name = f"{root}/{part:06d}-{seq:06d}.tmtk"
            own = f"{name}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(own) as out:
                out.write(raw)
            store.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return map_batches(shards.select("part", "seq", "shard"), run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
