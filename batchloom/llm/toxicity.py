"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's chance of being toxic is a logistic function of its words (hashed whole words and word
beginnings); a document's is the noisy-or of its sentences, 1 - prod(1 - p). Training sees document labels only: it maximises their
likelihood by Adam over whole bags, so blame settles on the sentences that explain the labels. The model then scores every sentence
of every document and names the offending ones.

Fitting uses at most FIT_ROWS labelled texts (those with the least hash; copies with one label count once), at most FIT_BYTES of text,
no text over a hundredth of that; the sample is
the only thing that reaches the driver and its bound does not grow. Scoring is one narrow pass over whole texts without a shuffle.

Defined results. Sentences end at ``.``, ``!``, ``?`` or a line end; words are runs of ASCII letters, digits and bytes above 0x7F, with
A-Z lower-cased. A null, empty or wordless text scores 0 (no sentence). Without any labelled document every score is 0, and an
empty table gives no rows. Repeated rows get the same result. Columns named tox_score or tox_sentences are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from batchloom.llm.textblocks import Words, arrow_limits, mix, replaced

DIMENSIONS = 1 << 16
FIT_ROWS = 8_000
FIT_BYTES = 10 << 20
BEGINNINGS = (4, 5)
#: Bytes of the sample that are cut into words at a time; sentences whose words are weighed at a time.
PART_BYTES = 1 << 20
PART_SENTENCES = 1 << 14
_GAP = np.ones(256, dtype=bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?\n\r")] = True


class Bags:
    """Sentences and word slots of texts: ``slots`` has one row for each kind of feature."""

    def __init__(self, texts: list[bytes]):
        self.words = w = Words(texts, lower=True, separators=_GAP)
        stops = np.concatenate(([0], np.cumsum(_STOP[w.buf])))
        place = stops[w.start]  # stops before the word; a text ends with one
        new = np.ones(len(w), dtype=bool)
        new[1:] = place[1:] != place[:-1]
        self.first = np.flatnonzero(new)  # first word of each sentence
        self.doc = w.doc[self.first] if len(w) else w.doc
        self.sentence = np.cumsum(new) - 1
        end = w.end
        kinds = [w.hashes()]
        for n in BEGINNINGS:
            w.end = np.minimum(end, w.start + n)
            kinds.append(mix(w.hashes() + np.uint64(n)))
        w.end = end
        self.slots = np.stack([(h % np.uint64(DIMENSIONS)).astype(np.uint16) for h in kinds])  # DIMENSIONS fit 16 bits

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Chance of each sentence."""
        if not len(self.first):
            return np.zeros(0)
        each = sum(weights[s] for s in self.slots)
        return 1 / (1 + np.exp(-np.clip(np.add.reduceat(each, self.first) + bias, -30, 30)))


class _Sample:
    """Bags of many texts, without their words, made and worked on a part at a time: the driver holds 6 bytes a word, a text number a sentence and one part's arrays."""

    def __init__(self, texts: list[bytes]):
        slots, sizes, doc, starts, words, a = [], [], [], [np.zeros(1, np.int64)], 0, 0
        ends = np.cumsum([len(t) for t in texts])
        while a < len(texts):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PART_BYTES, side="right")))
            part = Bags(texts[a:z])
            slots.append(part.slots)
            sizes.append(np.diff(np.append(part.first, len(part.words))).astype(np.int32))
            doc.append((part.doc + a).astype(np.int32))
            starts.append(part.words.first[1:] + words)
            words += len(part.words)
            a = z
        self.slots, self.sizes, self.doc, self.starts = np.concatenate(slots, axis=1), np.concatenate(sizes), np.concatenate(doc), np.concatenate(starts)

    def _parts(self) -> Iterator[tuple[slice, slice]]:
        """Sentences, and their words, of a part."""
        first = np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64)))
        for a in range(0, len(self.sizes), PART_SENTENCES):
            z = min(a + PART_SENTENCES, len(self.sizes))
            yield slice(a, z), slice(int(first[a]), int(first[z]))

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Chance of each sentence."""
        out = np.zeros(len(self.sizes))
        for some, words in self._parts():
            each = sum(weights[s[words]] for s in self.slots)
            out[some] = np.add.reduceat(each, np.cumsum(self.sizes[some]) - self.sizes[some])
        return 1 / (1 + np.exp(-np.clip(out + bias, -30, 30)))

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sum, for each slot, of the values of its words' sentences."""
        out = np.zeros((len(self.slots), DIMENSIONS))
        for some, words in self._parts():
            each = np.repeat(values[some], self.sizes[some])
            for total, s in zip(out, self.slots, strict=True):
                np.add.at(total, s[words], each)
        return sum(out)


def noisy_or(chance: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    return -np.expm1(np.bincount(doc, weights=np.log1p(-np.minimum(chance, 1 - 1e-13)), minlength=docs))


def train(texts: list[bytes], labels: np.ndarray, rounds: int = 60, rate: float = 0.1, decay: float = 4e-3, least_docs: int = 12) -> tuple[np.ndarray, float]:
    """Weights of the slots and the bias, by full-batch Adam on the documents' log-likelihood. A slot needs ``least_docs`` documents; weights shrink by soft thresholding, so that words without evidence get none."""
    weights, bias = np.zeros(DIMENSIONS), -5.0
    if not len(labels):
        return weights, -30.0
    bags = _Sample(texts)
    y, n = labels.astype(np.float64), len(labels)
    keep = np.zeros(DIMENSIONS, dtype=np.int32)
    for s in bags.slots:
        for a, z in itertools.pairwise(bags.starts.tolist()):
            keep[np.unique(s[a:z])] += 1
    keep = keep >= least_docs
    m, v, mb, vb = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = bags.scores(weights, bias)
        doc = np.clip(noisy_or(p, bags.doc, n), 1e-6, 1 - 1e-6)
        # d(-log likelihood)/d(sentence logit): y=1: -(1-P)/P * p, y=0: p
        g = np.where(y == 1, -(1 - doc) / doc, 1.0)[bags.doc] * p / n
        grad = bags.summed(g) * keep
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        weights -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * decay / (np.sqrt(v / (1 - 0.99**t)) + 1e-6) * 0.05, 0)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", where=None) -> tuple[np.ndarray, float]:
    """A model of the labelled documents for which ``where`` holds."""
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    known = docs.where(F.col(text_col).isNotNull() & (F.lit(True) if where is None else where)).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    known = known.where(F.octet_length("t") <= FIT_BYTES // 100)
    keys = known.select("i", F.xxhash64("t").alias("h")).join(marked, "i").groupBy("h", "y").agg(F.min("i").alias("i")).orderBy("h", "y").limit(FIT_ROWS)  # texts stay where they are
    found = known.withColumn("h", F.xxhash64("t")).join(F.broadcast(keys), ["i", "h"]).dropDuplicates(["h", "y"])
    rows = found.orderBy("h", "y").select("t", "y", F.octet_length("t").alias("n"))
    texts, y, held = [], [], 0
    for r in rows.toLocalIterator():
        held += r.n
        if held > FIT_BYTES:
            break
        texts.append(r.t.encode())
        y.append(r.y)
    return train(texts, np.array(y, dtype=np.int64))


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All rows and columns with tox_score and tox_sentences: (start, end, score) of sentences with at least ``threshold``; start and end are byte offsets in the UTF-8 text."""
    arrow_limits(docs.sparkSession)
    docs = replaced(docs, "tox_score", "tox_sentences")
    weights, bias = model[0].astype(np.float32), model[1]
    own = docs.columns
    names = [f"c{i}" for i in range(len(own))]
    plain = docs.toDF(*names)
    at = own.index(text_col)
    span = StructType().add("start", IntegerType()).add("end", IntegerType()).add("score", DoubleType())
    out = StructType(list(plain.schema.fields)).add("tox_score", DoubleType()).add("tox_sentences", ArrayType(span))

    def each(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(at).cast(pa.large_binary()).to_pylist()]
            found, spans, a = np.zeros(len(texts)), [[] for _ in texts], 0
            while a < len(texts):
                z, held = a, 0
                while z < len(texts) and (z == a or held + len(texts[z]) <= 1 << 20):
                    held += len(texts[z])
                    z += 1
                bags = Bags(texts[a:z])
                p = bags.scores(weights, bias)
                found[a:z] = noisy_or(p, bags.doc, z - a)
                last = np.append(bags.first[1:], len(bags.words)) - 1 if len(p) else bags.first
                for s in np.flatnonzero(p >= threshold).tolist():
                    d = int(bags.doc[s])
                    spans[a + d].append({"start": int(bags.words.start[bags.first[s]] - bags.words.offset[d]), "end": int(bags.words.end[last[s]] - bags.words.offset[d]), "score": float(p[s])})
                a = z
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.clip(found, 0, 1)), pa.array(spans, kind)], [*names, "tox_score", "tox_sentences"])

    return plain.mapInArrow(each, out).toDF(*own, "tox_score", "tox_sentences")
