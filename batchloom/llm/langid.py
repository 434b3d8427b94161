"""Language identification by nearest centroids.

A text is a vector of TF-IDF weights of hashed character n-grams (1 to 3 bytes inside words, with word edges), scaled to length one.
Each language has several centroids, found by spherical k-means on its training texts. A text gets the language of the centroid with
the greatest cosine. It is rejected when its cosine distance exceeds that language's limit: a quantile of the distances of training texts
of like length from their own language, plus a margin.

Document frequencies come from all training texts (one pass, a vector of DIMENSIONS counts from each task, combined before the shuffle).
Centroids are fitted on the driver on the n-gram counts of at most FIT_PER_LANG distinct whole texts of each language (those with the least hash of
their text), of any length: counts have a fixed size. More than MAX_LANGS languages raise. Prediction is one narrow pass without a shuffle.

Defined results. Null text or no letter: ``und``, score 0, not rejected. No training rows, or an empty table: every text is ``und``. Equal cosines: the
language that sorts first. Repeated rows get the same result. Columns named lid_lang, lid_score or lid_rejected are replaced.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from batchloom.llm.durable import written
from batchloom.llm.textblocks import arrow_limits, replaced

DIMENSIONS = 1 << 12
CENTROIDS = 4
FIT_PER_LANG = 600
MAX_LANGS = 1000
_MARGIN = 0.1
_U = np.uint32
_FOLD = np.full(256, 32, dtype=np.uint8)  # everything that is no letter is a gap
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def counts(texts: list[bytes]) -> np.ndarray:
    """n-gram counts, one row for each text. Texts are lower-cased before (non-ASCII letters by the caller)."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for i, t in enumerate(texts):
        out[i] = _count(t)
    return out


def _count(text: bytes) -> np.ndarray:
    a = _FOLD[np.frombuffer(b" " + text + b" ", dtype=np.uint8)]
    if len(a) > 2:
        a = a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))]  # one gap between words
    if len(a) < 3:
        return np.zeros(DIMENSIONS, dtype=np.float32)
    x = a.astype(_U)
    two = x[:-1] * _U(0x9E3779B1) + x[1:] * _U(0x85EBCA6B)
    three = two[:-1] * _U(0xC2B2AE35) + x[2:] * _U(0x27D4EB2F) + _U(7)
    slots = np.concatenate(((x * _U(0x165667B1)) >> _U(20), two >> _U(20), (three ^ (three >> _U(15))) * _U(0x2C1B3C6D) >> _U(20)))
    return np.bincount(slots.astype(np.int64), minlength=DIMENSIONS).astype(np.float32)


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def k_means(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by cosine; the first is the mean's direction, each next start is the text least like those before."""
    start = [v.mean(axis=0)]
    near = v @ (start[0] / max(np.linalg.norm(start[0]), 1e-9))
    for _ in range(1, min(k, len(v))):
        start.append(v[int(np.argmin(near))])
        near = np.maximum(near, v @ start[-1])
    c = np.stack(start)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-9)
    return c


def _length_class(sizes: np.ndarray) -> np.ndarray:
    """Texts of like length are alike far from a centroid: classes by powers of four of the length."""
    return np.minimum(np.log2(np.maximum(sizes, 1)) // 2, 9).astype(np.int64)


class Model:
    def __init__(self, langs: list[str], centroids: np.ndarray, owner: np.ndarray, idf: np.ndarray, limit: np.ndarray):
        self.langs, self.centroids, self.owner, self.idf, self.limit = langs, centroids, owner, idf, limit

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine, rejected."""
        cosine = weighted(counts(texts), self.idf) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        lang, score = self.owner[best], np.clip(cosine[np.arange(len(texts)), best], 0, 1)
        size = _length_class(np.array([len(t) for t in texts], dtype=np.int64))
        return lang, score, 1 - score > self.limit[lang, size]


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each slot, and texts; over all rows of (id, text)."""

    def each(batches):
        total, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for b in batches:
            for t in b.column(0).cast(pa.large_binary()).to_pylist():
                total += _count(t or b"") > 0
                n += 1
        at = np.append(np.flatnonzero(total), DIMENSIONS)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.append(total, n)[at])], ["slot", "n"])

    df, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
    for r in texts.mapInArrow(each, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        if r.slot == DIMENSIONS:
            n = r.n
        else:
            df[r.slot] = r.n
    return df, n


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the rows whose language is not null."""
    arrow_limits(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.lower(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    df, n = document_frequency(known.select("t"))
    if not n:
        return None
    lettered = known.where(F.col("t").rlike(r"\p{L}")).withColumn("h", F.xxhash64("t"))
    first = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    keys = written(lettered.select("l", "h").distinct().withColumn("r", first).where(F.col("r") <= FIT_PER_LANG).select("l", "h"))
    langs = keys.select("l").distinct().limit(MAX_LANGS + 1).count()
    if langs > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    rows = lettered.join(F.broadcast(keys), ["l", "h"]).dropDuplicates(["l", "h"]).select("l", "h", "t")  # at most MAX_LANGS * FIT_PER_LANG keys

    def sparse(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(2).cast(pa.large_binary()).to_pylist()]
            c = [_count(t) for t in texts]
            at = [np.flatnonzero(x).astype(np.int32) for x in c]
            n = [x[i].astype(np.int32) for x, i in zip(c, at, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], ["l", "h", "size", "at", "n"])

    samples = rows.mapInArrow(sparse, "l string, h long, size long, at array<int>, n array<int>").orderBy("l", "h")
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    known_langs, found, limits = [], [], []
    for lang, group in itertools.groupby(samples.toLocalIterator(), key=lambda r: r.l):  # one language at a time in memory
        group = list(group)
        c = np.zeros((len(group), DIMENSIONS), dtype=np.float32)
        for i, r in enumerate(group):
            c[i, r["at"]] = r["n"]
        v = weighted(c, idf)
        centroids = k_means(v, CENTROIDS)
        far = 1 - (v @ centroids.T).max(axis=1)
        size = _length_class(np.array([r["size"] for r in group], dtype=np.int64))
        known_langs.append(lang)
        found.append(centroids)
        limits.append([min(1.0, np.quantile(far[size == s] if (size == s).sum() >= 20 else far, 0.995) + _MARGIN) for s in range(10)])
    if not found:
        return None
    return Model(known_langs, np.concatenate(found), np.repeat(np.arange(len(found)), [len(c) for c in found]), idf, np.array(limits))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All rows and columns with lid_lang (nearest language), lid_score (its cosine) and lid_rejected."""
    arrow_limits(docs.sparkSession)
    docs = replaced(docs, "lid_lang", "lid_score", "lid_rejected")
    own = docs.columns
    names = [f"c{i}" for i in range(len(own))]
    plain = docs.toDF(*names)
    text = names[own.index(text_col)]
    if model is None:
        return plain.withColumns({"lid_lang": F.lit("und"), "lid_score": F.lit(0.0), "lid_rejected": F.lit(False)}).toDF(*own, "lid_lang", "lid_score", "lid_rejected")
    out = StructType(list(plain.schema.fields)).add("lid_lang", StringType()).add("lid_score", DoubleType()).add("lid_rejected", BooleanType())
    ready = plain.select("*", F.when(F.col(text).rlike(r"\p{L}"), F.lower(text)).alias("lid_text"))

    def each(batches):
        for b in batches:
            texts = b.column(len(names)).cast(pa.large_binary()).to_pylist()
            lang, score, far = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
            some = [i for i, t in enumerate(texts) if t]
            for a in range(0, len(some), 256):
                at = some[a : a + 256]
                lang[at], score[at], far[at] = model.predict([texts[i] for i in at])
            said = pa.array([model.langs[x] if x >= 0 else "und" for x in lang.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], said, pa.array(score), pa.array(far)], [*names, "lid_lang", "lid_score", "lid_rejected"])

    return ready.mapInArrow(each, out).toDF(*own, "lid_lang", "lid_score", "lid_rejected")
