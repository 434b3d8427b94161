"""Benchmark decontamination: MinHash containment search with size partitions, verified by exact shingle containment.

A text contains an item when at least ``threshold`` of the item's distinct 5-word shingles are among the text's. Whole long texts and short
items have a tiny Jaccard similarity, so both sides are partitioned by size. Items form classes by their number of shingles (powers of two). For each
class a text is reduced to the shingles that items of the class have (a sorted table); what is left, R, is small, and texts fall into partitions
by the size of R. In the partition of sizes up to u, containment of an item of n shingles means a Jaccard similarity with R of at least
t*n / (u + n - t*n), so class and partition together tell how many MinHash functions leave a chance below MISS of finding no equal minimum. In
partitions where that is fewer than R has shingles, items are found by equal minima; in the others (items of a few shingles, or long texts that
share shingles with many items) R's shingles are looked up one by one, which cannot miss. An R of fewer than t * n shingles is not searched.
Candidates are verified against the whole text's shingles.

The items' shingles go to every executor. Their number is checked: more than ITEM_SHINGLES are searched in parts of the items (by
hash of the item id), one pass over the texts for each part. The search is one narrow pass without a shuffle.

Defined results. Words: as in ``textblocks`` with A-Z lower-cased. A null, empty or wordless text or item matches nothing; so do empty tables. An item of
fewer than five words is one shingle and is contained only in a text of just those words. Null ids take no part. Equal items each give a
row, and so do repeated rows of a text. Shingles are compared by 64-bit hashes. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.durable import without_ids
from batchloom.llm.textblocks import Words, arrow_limits, blocks, mix, shingle_sets

THRESHOLD = 0.8
#: Chance that MinHash misses an item that a text contains. The recall of the search is at least 1 - MISS.
MISS = 1e-9
ITEM_SHINGLES = 4_000_000
_U = np.uint64


def functions_needed(n: int, u: int, threshold: float = THRESHOLD) -> int:
    """MinHash functions for items of at least n shingles and reduced texts of up to u."""
    j = min(1.0, threshold * n / (u + n - threshold * n))
    return 1 if j >= 1 else math.ceil(math.log(MISS) / math.log1p(-j))


def _seeds(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


class _Class:
    """The items of one class of sizes: an index of their shingles, and a table from (function, minimum) to items for each number of functions."""

    def __init__(self, members: list[int], sets: list[np.ndarray], threshold: float):
        self.members, self.sets, self.threshold = np.array(members), sets, threshold
        size = np.array([len(s) for s in sets], dtype=np.int64)
        self.least = int(size.min())
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], np.repeat(np.arange(len(sets)), size)[order]
        self.known = np.unique(self.every)
        self.tables: dict[int, dict[int, np.ndarray]] = {}

    def reduce(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, s)
        at[at == len(self.known)] = 0
        return s[self.known[at] == s]

    def table(self, k: int) -> dict[int, np.ndarray]:
        if k not in self.tables:
            found: dict[int, list[int]] = {}
            seeds = _seeds(k)
            for i, s in enumerate(self.sets):
                for low in set(signature(s, seeds).tolist()):
                    found.setdefault(low, []).append(i)
            self.tables[k] = {x: np.array(v) for x, v in found.items()}
        return self.tables[k]

    def candidates(self, s: np.ndarray) -> tuple[np.ndarray, bool]:
        """Items that a text with shingles s may contain, and whether MinHash has found them."""
        r = self.reduce(s)
        if len(r) < self.threshold * self.least - 1e-9 or not len(r):
            return np.zeros(0, dtype=np.int64), False
        k = functions_needed(self.least, 1 << int(len(r) - 1).bit_length(), self.threshold)
        if k < len(r):
            table = self.table(k)
            found = [table[x] for x in signature(r, _seeds(k)).tolist() if x in table]
        else:
            a, b = np.searchsorted(self.every, r, "left"), np.searchsorted(self.every, r, "right")
            found = [self.owner[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return (self.members[np.unique(np.concatenate(found))] if found else np.zeros(0, dtype=np.int64)), k < len(r)


def signature(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least value of each function; functions differ by a seed that is mixed in, so equal values mean equal function and shingle."""
    return mix(s[None, :] ^ seeds[:, None]).min(axis=1)


class Items:
    """The items by classes of sizes, behind a table of all their shingles."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], threshold: float = THRESHOLD):
        self.ids, self.sets, self.threshold = ids, sets, threshold
        self.known = np.unique(np.concatenate(sets)) if sets else np.zeros(0, _U)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.known >> _U(44)).astype(np.int64)] = True
        classes: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                classes.setdefault(len(s).bit_length(), []).append(i)
        self.classes = [_Class(members, [sets[i] for i in members], threshold) for _, members in sorted(classes.items())]

    def reduce(self, s: np.ndarray) -> np.ndarray:
        """The shingles of a text that some item has."""
        s = s[self.maybe[(s >> _U(44)).astype(np.int64)]]
        if not len(s):
            return s
        at = np.searchsorted(self.known, s)
        at[at == len(self.known)] = 0
        return s[self.known[at] == s]

    def search(self, s: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, item shingles, shared shingles) of the items a text with shingles s contains."""
        return [x[:3] for x in self.found(s)]

    def found(self, s: np.ndarray) -> list[tuple[int, int, int, bool]]:
        """As ``search``, with whether MinHash has found the item."""
        r = self.reduce(s)
        out = []
        for c in self.classes if len(r) else ():
            some, by_minima = c.candidates(r)
            for i in some.tolist():
                shared = int(np.isin(self.sets[i], r, assume_unique=True).sum())  # r has every shingle of the text that an item has
                if shared >= self.threshold * len(self.sets[i]) - 1e-9:
                    out.append((self.ids[i], len(self.sets[i]), shared, by_minima))
        return out


def _parts(items: DataFrame, id_col: str, text_col: str) -> int:
    """Passes needed: words bound shingles from above."""
    n = items.select(F.sum(F.length(text_col)).alias("n")).first().n or 0
    return max(1, -(-(n // 2) // ITEM_SHINGLES))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc, item, n_item, n_shared): the items that each text contains."""
    arrow_limits(docs.sparkSession)
    items = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), text_col)
    schema = "doc long, item long, n_item int, n_shared int"
    parts, out = _parts(items, "i", "t"), None
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part).orderBy("i", "t").collect()
        known = Items([r.i for r in rows], shingle_sets(Words([(r.t or "").encode() for r in rows], lower=True)), threshold)
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def each(batches, shared=shared):
            known = shared.value
            for ids, block in blocks(batches):
                found = [(i, *x) for i, s in zip(ids.tolist(), shingle_sets(Words(block, lower=True)), strict=True) for x in known.search(s)]
                if found:
                    cols = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc", "item", "n_item", "n_shared"])

        one = texts.mapInArrow(each, schema)
        out = one if out is None else out.unionByName(one)
    return out


def without_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` that contain no item; rows with a null id stay. Texts are not shuffled, but for those that a bit set of the ids found cannot rule out."""
    return without_ids(docs, id_col, contained_items(docs, items, id_col, text_col, **more).select("doc"))
