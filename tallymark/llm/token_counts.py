"""Token counts by rank-synchronous array merging.

A byte-pair encoder replaces, in every pre-token, the adjacent pair of lowest rank until no ranked pair
is left. Here the distinct pre-tokens of a batch lie in one ragged numpy array; each round looks up all
adjacent pairs at once, finds each sequence's lowest rank, applies that pair in every sequence, and
retires the sequences that have none. What survives is counted; no token string is ever built.

Words repeat, so the counts of white-space separated chunks are remembered per worker, up to a bound.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Remembered, bare, map_batches, utf8

NONE = np.int64(2**31 - 1)
#: half the chunks that a Python worker remembers, and the longest that is remembered
MEMO, MEMO_CHARS = 200_000, 64
#: bytes of Latin-1 text: no code point above U+00FF, so no combining mark, and lower case one code point at a time
LATIN = bytes(range(0xC4))
#: fixed value: the pre-token pattern of byte-level encoders whose file states none
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def chunks_of(raw: bytes, fold: bool, hint: bytes) -> list[bytes]:
    """A text's UTF-8 bytes, split at ASCII white space; other white space stays inside a chunk. ``fold``: A-Z may become a-z where no special string
    (all begin with ``hint``) or combining mark could make that matter, so more chunks are equal."""
    if fold and hint not in raw and not raw.translate(None, LATIN):
        raw = raw.lower()
    return raw.split()


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable Latin-1, else the next free code point from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return [chr(hidden.get(b, b)) for b in range(256)]


class RankMerger:
    """Counts tokens as the BPE tokenizer in ``path`` (a tokenizers .json file) would give them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        unsupported = [k for k in ("dropout", "continuing_subword_prefix", "unk_token", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or unsupported:
            raise ValueError(f"not a plain byte-level BPE model: {unsupported or model.get('type')}")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_alphabet()
        self.base = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        # the suffix belongs to the right half only, so plain joining gives the merged symbol
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int64)
        # a pair may be applied everywhere at once if no pair that its result takes part in ranks lower
        used_first = np.full(self.size, NONE)
        np.minimum.at(used_first, left, np.arange(len(left)))
        np.minimum.at(used_first, right, np.arange(len(right)))
        self.everywhere = used_first[self.made] > np.arange(len(left))

        steps = (spec.get("normalizer") or {}).get("normalizers") or [s for s in [spec.get("normalizer")] if s]
        kinds = {s["type"] for s in steps}
        if kinds - {"NFC", "Lowercase", "Replace"}:
            raise ValueError(f"normalizers not supported: {kinds}")
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec["pre_tokenizer"]]
        split = next((p for p in pre if p["type"] == "Split"), None)
        #: white space never reaches a token, so texts may be cut there
        self.by_chunk = bool(split and split["behavior"] == "Removed" and split["invert"])
        if split and not self.by_chunk:
            raise ValueError("this kind of Split is not supported")
        self.pattern = regex.compile(split["pattern"]["Regex"] if split else BYTE_LEVEL)
        tokens = spec.get("added_tokens") or []
        odd = sorted({k for t in tokens for k in ("lstrip", "rstrip", "single_word", "normalized") if t.get(k)})
        if odd:
            raise ValueError(f"added tokens with these settings are not supported: {odd}")
        added = sorted((t["content"] for t in tokens), key=len, reverse=True)
        #: what every special string begins with, possibly nothing
        self.hint = os.path.commonprefix(added)
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.memo = Remembered(MEMO)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], NONE)

    def surviving(self, pretokens: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty pre-token."""
        lens = np.fromiter(map(len, pretokens), dtype=np.int64, count=len(pretokens))
        counts = np.zeros(len(pretokens), dtype=np.int64)
        if not len(pretokens):
            return counts
        raw = np.frombuffer(b"".join(pretokens), dtype=np.uint8)
        sym, ends = self.base[raw], np.cumsum(lens)
        sym[ends - 1] = self.last[raw[ends - 1]]
        live = np.arange(len(pretokens))
        while len(live):
            starts = np.cumsum(lens) - lens
            rank = np.full(len(sym), NONE)
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
            rank[starts + lens - 1] = NONE
            best = np.minimum.reduceat(rank, starts)
            over = best == NONE
            counts[live[over]] = lens[over]
            if over.all():
                break
            own = np.repeat(best, lens)
            at = np.flatnonzero((rank == own) & (own != NONE))
            # of overlapping pairs (aaa) every second is taken from the left; of unsafe ones only the first
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            at = at[(at - np.repeat(at[run], np.diff(np.r_[run, len(at)]))) % 2 == 0]
            seq = np.searchsorted(starts, at, side="right") - 1
            take = self.everywhere[rank[at]] | np.r_[True, np.diff(seq) != 0]
            at, seq = at[take], seq[take]
            sym[at] = self.made[rank[at]]
            keep = np.repeat(~over, lens)
            keep[at + 1] = False
            sym = sym[keep]
            lens = lens - np.bincount(seq, minlength=len(lens))
            lens, live = lens[~over], live[~over]
        return counts

    def pretokens(self, piece: str) -> list[bytes]:
        if self.nfc and not piece.isascii():
            piece = unicodedata.normalize("NFC", piece)
        if self.lower:  # one code point at a time: no final-sigma rule
            piece = piece.lower() if piece.isascii() else "".join([c.lower() for c in piece])
        return [m.encode() for m in self.pattern.findall(piece)]

    def count_pieces(self, pieces: Iterable[str]) -> list[int]:
        """Token counts of pieces of text, special strings among them included."""
        flat: dict[bytes, int] = {}
        parts: list[tuple[int, list[int]]] = []
        for piece in pieces:
            cut = self.special.split(piece) if self.special and self.hint in piece else [piece]
            fixed = len(cut) // 2
            parts.append((fixed, [flat.setdefault(t, len(flat)) for p in cut[::2] if p for t in self.pretokens(p)]))
        got = self.surviving(list(flat))
        return [fixed + int(got[own].sum()) if own else fixed for fixed, own in parts]

    def count(self, texts: list[bytes]) -> list[int]:
        split = [chunks_of(t, self.lower, self.hint.encode()) if self.by_chunk else [t] if t else [] for t in texts]
        chunks: set[bytes] = set()
        chunks.update(*split)
        got, fresh = self.memo.take(chunks)
        learned = dict(zip(fresh, self.count_pieces([w.decode() for w in fresh]), strict=True))
        self.memo.put({k: v for k, v in learned.items() if len(k) <= MEMO_CHARS})
        got |= learned
        return [sum(map(got.__getitem__, words)) for words in split]


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def groups(texts: list, size: int = 3_000_000) -> Iterable[list]:
    """Runs of texts of a bounded total length (or of one longer text)."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    Whole texts are counted, without special tokens added. A null text counts as empty (0 bytes, 0 tokens);
    null or repeated ids and repeated rows pass through, one row out for each row in; other columns are ignored.
    An empty table gives an empty result. ``tokenizer`` is the path of a tokenizers .json file on every node.
    """

    def run(batch: pa.RecordBatch):
        column = batch.column(1)
        sizes = pc.binary_length(column).cast(pa.int64())
        counter = merger(tokenizer)
        n = pa.array([c for part in groups(column.to_pylist()) for c in counter.count(part)], type=pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(bare(docs, doc_id=doc_id, raw=utf8(text)), run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
