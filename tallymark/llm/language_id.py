"""Language identification in two levels: the family first, then the languages within it.

Every text is a vector of hashed byte 2-, 3- and 4-gram counts (log-scaled, unit length) of all its letters.
One linear support vector machine for each family against the rest names the family; within it, one machine
for each pair of its languages votes. Machines are fitted by dual coordinate descent on a bounded sample of
labelled rows; prediction reads whole texts and nothing but texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bare, crc_of_id, map_batches, utf8

DIMS = 4096
#: labelled rows a language that the machines are fitted on (in expectation; chosen by a hash of the id)
SAMPLE = 500
#: languages that are learned: the most frequent labels, so that a dirty column adds no machines without end
MOST_LANGUAGES = 200
#: largest violation of the optimum's conditions at which a machine counts as fitted, and passes after which it counts as failed
NEAR, PASSES = 0.02, 2000
#: fixed values: language families by ISO 639-1 code; a language not listed is a family of its own
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es pt it ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "indic": "hi bn ur pa mr gu ne si",
    "semitic": "ar he am mt",
    "celtic": "ga gd cy br",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
LETTER = regex.compile(r"\p{L}")
#: bytes of letters: A-Z folded, everything that is neither an ASCII letter nor non-ASCII made a space
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def counts(raw: bytes) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    a = np.frombuffer(b" " + b" ".join(raw.translate(FOLD).split()) + b" ", dtype=np.uint8).astype(np.uint32)
    total = np.zeros(DIMS, dtype=np.int64)
    h = a
    for n in (2, 3, 4):
        h = (h[:-1] * np.uint32(0x01000193)) ^ a[n - 1 :]
        mixed = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMS.bit_length() + 1)
        total += np.bincount(mixed, minlength=DIMS)
    return total


def scaled(total: np.ndarray) -> np.ndarray:
    x = np.log1p(total).astype(np.float32)
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0) -> np.ndarray:
    """Linear machine (last weight: the bias) with squared hinge loss, by dual coordinate descent until no row violates the optimum by more than ``NEAR``; y is +1 or -1."""
    x = np.c_[x, np.ones(len(x), dtype=np.float32)].astype(np.float64)
    share = {s: cost * len(y) / (2 * max(1, int((y == s).sum()))) for s in (1, -1)}  # sides weigh the same
    add = np.array([1 / (2 * share[s]) for s in y])
    q, alpha, w = (x * x).sum(axis=1) + add, np.zeros(len(x)), np.zeros(x.shape[1])
    order, able = np.random.default_rng(7), np.arange(len(x))
    for _ in range(PASSES):
        worst, rest = 0.0, []
        for i in order.permutation(able).tolist():
            slope = y[i] * (x[i] @ w) - 1 + add[i] * alpha[i]
            violation = abs(slope) if alpha[i] > 0 else max(0.0, -slope)
            worst = max(worst, violation)
            if alpha[i] > 0 or slope < NEAR:
                rest.append(i)
            if violation > 1e-9:
                new = max(0.0, alpha[i] - slope / q[i])
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if worst <= NEAR:
            if len(able) == len(x):
                return w.astype(np.float32)
            able = np.arange(len(x))  # rows left aside are looked at once more
        else:
            able = np.array(sorted(rest))
    raise RuntimeError("a language machine was not fitted")


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


class LanguageModel:
    def __init__(self, x: np.ndarray, labels: list[str]):
        langs, names = sorted(set(labels)), np.array(labels)
        self.langs = langs
        self.families: dict[str, list[str]] = {}
        for code in langs:
            self.families.setdefault(FAMILY_OF.get(code.lower().split("-")[0], code), []).append(code)
        family = np.array([FAMILY_OF.get(s.lower().split("-")[0], s) for s in labels])
        self.names = sorted(self.families)
        self.against_rest = [fit_svm(x, np.where(family == f, 1, -1)) for f in self.names] if len(self.names) > 1 else []
        self.pairs = {(a, b): fit_svm(x[at], np.where(names[at] == a, 1, -1)) for codes in self.families.values() for i,
            a in enumerate(codes) for b in codes[i + 1 :] for at in [np.flatnonzero((names == a) | (names == b))]}

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """Language and score (product of the logistic of the deciding margins, so 0 to 1) of each row; ties go to the first by code point."""
        squash = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
        if self.against_rest:
            m = np.stack([margin(x, w) for w in self.against_rest], axis=1)
            p = squash(m)
            p /= p.sum(axis=1, keepdims=True)
            family, sure = m.argmax(axis=1), p[np.arange(len(x)), m.argmax(axis=1)]
        else:
            family, sure = np.zeros(len(x), dtype=int), np.ones(len(x))
        out: list[tuple[str, float]] = [("und", 0.0)] * len(x)
        for f, name in enumerate(self.names):
            at = np.flatnonzero(family == f)
            codes = self.families[name]
            votes, strength = np.zeros((len(at), len(codes))), np.zeros((len(at), len(codes)))
            for i, a in enumerate(codes):
                for j in range(i + 1, len(codes)):
                    p = squash(margin(x[at], self.pairs[a, codes[j]]))
                    votes[:, i] += p >= 0.5
                    votes[:, j] += p < 0.5
                    strength[:, i] += p
                    strength[:, j] += 1 - p
            rivals = max(1, len(codes) - 1)
            best = (votes + strength / (2 * rivals)).argmax(axis=1)  # equal votes: by strength
            inner = strength[np.arange(len(at)), best] / rivals if len(codes) > 1 else np.ones(len(at))
            for k, row in enumerate(at):
                out[row] = (codes[best[k]], float(min(1.0, max(0.0, sure[row] * inner[k]))))
        return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from; a null id is not among them."""
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, most: int = MOST_LANGUAGES) -> LanguageModel | None:
    """Fit on about ``sample`` rows a language, out of the labelled rows with a text that are not held out; None without any.

    Chosen by a hash of the id, so the same rows at every run; languages with fewer rows give all. Of more than ``most`` labels the most frequent
    are learned, ties by code point. Features are counted on the executors.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    if not sizes:
        return None
    rates = F.create_map(*[F.lit(v) for r in sizes for v in (r.lang, min(1.0, sample / r.n))])
    share = F.coalesce(F.try_element_at(rates, F.col("lang")), F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = bare(rows.where(draw < share), lang="lang", raw=utf8(), doc_id="doc_id")

    def features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = []
        for raw in batch.column(1).to_pylist():
            c = counts(raw)
            at = np.flatnonzero(c)
            got.append(at.astype("<u2").tobytes() + c[at].astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.binary())], names=["lang", "doc_id", "sparse"])

    ddl = f"lang string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, sparse binary"
    found = sorted(map_batches(picked, features, ddl).collect(), key=lambda r: (r.lang, r.doc_id is None, r.doc_id or 0, bytes(r.sparse)))
    x = np.zeros((len(found), DIMS), dtype=np.float32)
    for i, r in enumerate(found):
        n = len(r.sparse) // 6
        x[i, np.frombuffer(r.sparse, dtype="<u2", count=n)] = np.frombuffer(r.sparse, dtype="<u4", count=n, offset=2 * n)
    return LanguageModel(scaled(x), [r.lang for r in found]) if found else None


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """docs with ``lang_pred`` and ``score``, from the text alone.

    ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned. Repeated rows get equal answers;
    columns of docs called lang_pred or score are replaced; an empty table stays empty.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    where = keep.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # families x DIMS and pairs x DIMS weights: bounded by the languages
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(where).to_pylist()
        out = [("und", 0.0)] * len(texts)
        able = [i for i, t in enumerate(texts) if t and sent.value is not None and LETTER.search(t)]
        for k in range(0, len(able), 256):
            part = able[k : k + 256]
            for i, got in zip(part, sent.value.predict(scaled(np.stack([counts(texts[i].encode()) for i in part]))), strict=True):
                out[i] = got
        columns = [*batch.columns, pa.array([c for c, _ in out], pa.string()), pa.array([s if math.isfinite(s) else 0.0 for _, s in out], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    return map_batches(docs.select(*[F.col(f"`{c}`") for c in keep]), run, schema)
