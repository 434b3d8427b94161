"""Vectorised text kernels shared by the operators: words, hashes and shingles of many texts at once.

All kernels work on the UTF-8 bytes of a *block* of whole texts laid end to end. A block holds about
``BLOCK_BYTES`` of text (one longer text makes a block of its own), which bounds a Python worker's memory.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 2 << 20
#: Bytes of text, and numbers, that a kernel takes at a time: its arrays stay in a core's cache.
SLICE = 1 << 16
_U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)


def arrow_limits(spark: SparkSession, mb: int = 8) -> None:
    """Keeps each Arrow batch sent to Python small, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def replaced(df: DataFrame, *outputs: str) -> DataFrame:
    """The frame without columns that bear the name of an output (in any case): the output replaces them."""
    names = {o.lower() for o in outputs}
    return df.drop(*[c for c in df.columns if c.lower() in names])


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def ids_and_texts(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    """Columns 0 (an integer id) and 1 (text, null counts as empty) of a batch."""
    texts = batch.column(1).cast(pa.large_binary())
    return np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64), [t or b"" for t in texts.to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Regroups batches of (id, text, ...) into blocks of whole texts with about ``limit`` bytes each."""
    ids: list[int] = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for i, t in zip(*ids_and_texts(batch), strict=True):
            if texts and held + len(t) > limit:
                yield np.array(ids, dtype=np.int64), texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t)
    if texts:
        yield np.array(ids, dtype=np.int64), texts


def keyed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Blocks of (ids, text keys, texts) from columns (id, text, key of the text)."""
    ids: list[int] = []
    keys: list[int] = []
    texts: list[bytes] = []
    held = 0
    for b in batches:
        for i, t, h in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
            t = t or b""
            if texts and held + len(t) > BLOCK_BYTES:
                yield np.array(ids, np.int64), np.array(keys), texts
                ids, keys, texts, held = [], [], [], 0
            ids.append(i)
            keys.append(h)
            texts.append(t)
            held += len(t)
    if texts:
        yield np.array(ids, np.int64), np.array(keys), texts


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=_U)
    if n > 1:
        out[1] = base
        done = 2
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * _U(pow(base, done, 1 << 64))
            done += more
    return out


@functools.cache
def _slice_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, 2 * SLICE), _powers(_BASE_INV, 2 * SLICE)


class Words:
    """The words of a block of texts: maximal runs of bytes outside a separator class.

    ``start``/``end`` are byte offsets in ``buf``; ``doc`` numbers the text of each word; ``first`` has, for each
    text, the index of its first word (one entry more than texts).
    """

    def __init__(self, texts: list[bytes], lower: bool = False, separators: np.ndarray | None = None):
        self.raw = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(self.raw, dtype=np.uint8)
        if lower:
            buf = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
        self.buf = buf
        gap = (buf == 32) | ((buf >= 9) & (buf <= 13)) if separators is None else separators[buf]
        word = ~gap
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2].astype(np.int64), edge[1::2].astype(np.int64)  # the block ends with a separator
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, self.offset)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever the word stands."""
        out = np.empty(len(self.start), dtype=_U)
        edges = np.unique(np.append(np.searchsorted(self.start, np.arange(0, len(self.buf), SLICE)), len(out)))
        for a, z in itertools.pairwise(edges.tolist()):
            s, e = self.start[a:z], self.end[a:z]
            lo, hi = int(s[0]), int(e[-1])
            up, down = _slice_powers() if hi - lo <= 2 * SLICE else (_powers(_BASE, hi - lo), _powers(_BASE_INV, hi - lo))
            total = np.zeros(hi - lo + 1, dtype=_U)
            np.cumsum((self.buf[lo:hi].astype(_U) + _U(1)) * up[: hi - lo], out=total[1:])
            out[a:z] = (total[e - lo] - total[s - lo]) * down[s - lo]
        return mix(out + (self.end - self.start).astype(_U) * _U(_MULT))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (in order); runs may cross texts, callers mask those."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out = np.zeros(n, dtype=_U)
    for a in range(0, n, SLICE):
        x = out[a : a + SLICE]
        for i in range(a, a + k):
            x *= _U(_MULT)
            x += h[i : i + len(x)]
            x ^= x >> _U(29)
        x[:] = mix(x)
    return out


def shingle_sets(words: Words, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, the whole sequence as one; with none, empty."""
    h = words.hashes()
    grams = window_hashes(h, k)
    out = []
    for a, b in itertools.pairwise(words.first.tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(window_hashes(h[a:b], b - a) ^ _U(b - a))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
