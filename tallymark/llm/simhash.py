"""Near-duplicate documents by SimHash fingerprints, found with Golay-code keys.

Two fingerprints of 64 bits link if at most four bits differ. The bits lie in three segments; by the pigeonhole
either one segment is equal and another differs in at most two bits, or all three differ in one or two. A segment is
read as a word of the perfect binary Golay code (23, 12, 7): any word has one codeword within distance 3, and the
codewords within distance 4 are that one or, from distance 3, six. Words that differ in at most two bits always share
one of those, so the indices of these few codewords serve as hash keys for "differs in at most two bits". Fingerprints
that share a key are compared, and the links joined up.

Equal fingerprints are one node, so copies cost nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare, map_batches, materialize, partitions, utf8
from .components import connected_components, smallest_members
from .groups import MOST, block_pairs, whole_groups

SEED, WIDTH, MAX_BITS = 42, 4, 4
#: fixed value: generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0xAE3
#: first bit and number of bits of the segments; a code word has 23, the rest are zero
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def fingerprint(raw: bytes, width: int = WIDTH) -> int:
    """64-bit SimHash of the text's shingles of ``width`` words (A-Z folded), each with weight 1; 0 without words."""
    words = raw.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.r_[0, ends[: n - 1]].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, n, 65536):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + 65536], stops[k : k + 65536], strict=True)], dtype="<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row; a null text has no words."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.array([fingerprint(raw, width) for raw in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return map_batches(bare(docs, doc_id=F.col(f"`{doc_id}`").cast("long"), raw=utf8(text)), run, "doc_id long, fp long")


class Golay:
    """Codeword indices within distance 4 of words of 23 bits."""

    def __init__(self):
        # remainder of x^i modulo the generator, for every bit i
        rest = [1]
        for _ in range(22):
            r = rest[-1] << 1
            rest.append(r ^ GENERATOR if r >> 11 else r)
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        self.tables = [np.bitwise_xor.reduce(bits * np.array((rest + [0])[8 * k : 8 * k + 8]), axis=1) for k in range(3)]
        near: dict[int, list[int]] = {}
        for weight in range(5):
            for at in combinations(range(23), weight):
                s = 0
                for i in at:
                    s ^= rest[i]
                near.setdefault(s, []).append(sum(1 << i for i in at))
        self.number = np.array([len(near[s]) for s in range(2048)])
        self.errors = np.array([near[s] + [0] * (6 - len(near[s])) for s in range(2048)])

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, 6) indices, and which of them hold."""
        a, b, c = self.tables
        s = a[words & 255] ^ b[(words >> 8) & 255] ^ c[words >> 16]
        return (words[:, None] ^ self.errors[s]) >> 11, np.arange(6) < self.number[s][:, None]


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows such that any two fingerprints of at most four differing bits share a key."""
    u = fps.view(np.uint64)
    parts = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    coded = [golay().keys(p) for p in parts]
    keys, owners = [], []
    table = 0
    for i in range(3):
        for j in range(3):
            if i != j:  # segment i equal, j within two bits
                idx, held = coded[j]
                row, col = np.nonzero(held)
                keys.append((table << 40) | (parts[i][row] << 12) | idx[row, col])
                owners.append(fps[row])
                table += 1
    (x, hx), (y, hy), (z, hz) = coded
    held = hx[:, :, None, None] & hy[:, None, :, None] & hz[:, None, None, :]
    row, i, j, k = np.nonzero(held)
    keys.append((table << 40) | (x[row, i] << 24) | (y[row, j] << 12) | z[row, k])
    owners.append(fps[row])
    return np.concatenate(keys), np.concatenate(owners)


def spanning_links(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that join up exactly what all links (at most ``most`` differing bits) among distinct fingerprints join up."""
    left, out = fps.view(np.uint64), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= most
            if near.any():
                got = left[near]
                out += [(int(x.view(np.int64)), int(v)) for v in got.view(np.int64)]
                front += list(got)
                left = left[~near]
    return out


def links_of(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the groups of equal key, sorted by key."""
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[cut, len(keys)])
    two = cut[size == 2]
    a, b = fps[two], fps[two + 1]
    near = np.bitwise_count((a ^ b).view(np.uint64)) <= most
    more = [p for at, n in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True) for p in spanning_links(fps[at : at + n], most)]
    return np.r_[a[near], np.array([p[0] for p in more], dtype=np.int64)], np.r_[b[near], np.array([p[1] for p in more], dtype=np.int64)]


def links_of_groups(batches: Iterator[pa.RecordBatch], most: int, held: int = MOST) -> Iterator[pa.RecordBatch]:
    """a, b, late: the links of groups of batches (key, fp) sorted by key; of groups of more than ``held`` rows the rows themselves, late."""
    for late, m in whole_groups(batches, held):
        a, b = m if late else links_of(m[0], m[1], most)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), late))], names=["a", "b", "late"])


def fingerprint_links(fps: DataFrame, most: int = MAX_BITS, held: int = MOST) -> DataFrame:
    """Links a, b that join up exactly the distinct fingerprints (column fp) of at most ``most`` (up to four) differing bits.

    Groups of more than ``held`` fingerprints are linked in pairs of blocks, so that no task holds one."""
    if not 0 <= most <= 4:
        raise ValueError("the keys find links of up to four differing bits")

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(0).to_numpy()
        for k in range(0, len(column), 1000):
            keys, owners = golay_keys(column[k : k + 1000])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners)], names=["key", "fp"])

    # dealt anew: Spark merges the small distinct fingerprints into few tasks, and each becomes some 170 rows
    apart = fps.select("fp").distinct().repartition(partitions(fps.sparkSession), F.xxhash64("fp"))
    keyed = map_batches(apart, deal, "key long, fp long")
    grouped = keyed.repartition(partitions(fps.sparkSession), "key").sortWithinPartitions("key", "fp")
    found = materialize(grouped.mapInArrow(lambda batches: links_of_groups(batches, most, held), "a long, b long, late boolean"), "links")
    links, late = found.where("not late").select("a", "b"), found.where("late").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if not late.isEmpty():

        def block(table: pa.Table) -> pa.Table:
            fps = np.sort(table.column("fp").to_numpy())
            a, b = links_of(np.zeros(len(fps), dtype=np.int64), fps, most)
            return pa.table([a, b], names=["a", "b"])

        links = links.union(block_pairs(late, "key", "fp", held).groupBy("key", "i", "j").applyInArrow(block, "a long, b long"))
    return links.distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, most: int = MAX_BITS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach, itself included), one row for each row of docs.

    Texts without words, null ones among them, have fingerprint zero and link like any other. Rows with a null doc_id
    take part, and their component_id is null only if no member has an id. Repeated rows give repeated rows; an empty table none.
    """
    printed = materialize(fingerprints(docs, width, text, doc_id), "fingerprints")
    nodes = printed.groupBy("fp").agg(F.min("doc_id").alias("id")).withColumnRenamed("fp", "node")
    # written, so that the join has an exchange on both sides and Spark splits the rows of a hot fingerprint
    placed = materialize(smallest_members(nodes, connected_components(fingerprint_links(printed, most))), "placed")
    out = printed.join(placed.withColumnRenamed("node", "fp"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
