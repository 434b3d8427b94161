"""Substring dedup by super-k-mer partitioning.

Method. A *window* is k consecutive words of one text. Its *minimiser* is the least hash among its m-word runs; consecutive
windows that share it form a super-k-mer, which travels as one packed string (windows overlap, so its words are sent once) to
the bucket of that minimiser. All occurrences of a window meet in one bucket, where windows are sorted by hash and doc id and
equal neighbours are compared byte for byte, so counts are exact.

Skew. There are at least 64 buckets for each key (as far as MOST_BUCKETS go), so a key's load is the sum of many. Bucket sizes are counted over all
texts first. A bucket above WORKER_WINDOWS and above four times the mean of a key (a very common word run, or a passage that a large part of
the texts share) is not sent to one place: its windows are reduced to 128-bit digests, the least and greatest
doc id of each digest come from an aggregation that combines before it shuffles, and only digests with two documents are joined
back to their occurrences (an equi-join whose large partitions adaptive execution may split).

Scale. Shuffled are packed super-k-mers (about 3 words for each window before compression), spans, and those texts that a bit set of
fixed size cannot rule out as unchanged; the others are passed on where they are read. A worker holds a block of texts or the rows of one key.

Defined results. Null text: no words. Null id: the row is passed through unchanged. Fewer than k words: nothing is removed.
A window that repeats only inside its own document, or in rows with the same id, stays. Rows with equal id are told apart by text.
An empty table gives no rows. Columns named sk_kept, sk_words or sk_removed are replaced. Words are maximal runs of bytes other than space and 0x09-0x0D, compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from batchloom.llm import packing
from batchloom.llm.durable import id_filter, may_be_in, written
from batchloom.llm.textblocks import BLOCK_BYTES, Words, arrow_limits, keyed_blocks, mix, replaced, window_hashes

_U = np.uint64
#: Buckets for each key; with many keys at most MOST_BUCKETS, whose counts a task holds.
BUCKETS_PER_KEY = 64
LEAST_BUCKETS, MOST_BUCKETS = 1 << 14, 1 << 22
#: A bucket is common above this many windows, and above COMMON_KEYS times what a key holds on average.
WORKER_WINDOWS = 1 << 16
COMMON_KEYS = 4
SPANS = "sk_id long, sk_text int, sk_start int, sk_end int"


def text_key(text: str) -> Column:
    """32 bits that tell apart rows with one id and different texts."""
    return F.shiftright(F.xxhash64(text), 32).cast("int")


def _least(g: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    have, width = g, 1
    while width * 2 <= w:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    return have if width == w else np.minimum(have[: len(g) - w + 1], have[w - width : w - width + len(g) - w + 1])


def _super_kmers(words: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window (a word index), number of windows and minimiser of each super-k-mer of a block."""
    n = len(words) - k + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(_U)
    least = _least(mix(window_hashes(words.hashes(), m)), k - m + 1)
    inside = words.doc[:n] == words.doc[k - 1 :]
    new = np.ones(n, dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (words.doc[1:n] != words.doc[: n - 1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new & inside)
    stop = np.append(np.flatnonzero(new), n)
    count = stop[np.searchsorted(stop, first, side="right")] - first
    return first, count, least[first]


def _single_spaced(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The block's words with one space after each, and where each word starts and ends in it."""
    size = words.end - words.start
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1])) if len(size) else size
    keep = np.zeros(len(words.buf), dtype=bool)
    step = np.zeros(len(words.buf) + 1, dtype=np.int8)
    step[words.start] += 1
    step[words.end + 1] -= 1  # the word and the separator after it
    keep = np.cumsum(step[:-1], dtype=np.int8) > 0
    out = words.buf.copy()
    out[words.end] = 32
    return out[keep].tobytes(), start, start + size


def bucket_count(keys: int) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, BUCKETS_PER_KEY * keys))


def bucket_sizes(texts: DataFrame, k: int, m: int, buckets: int) -> DataFrame:
    """(bucket, windows): windows of all texts by bucket of their minimiser."""

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for _, _, block in keyed_blocks(batches):
            _, n, least = _super_kmers(Words(block), k, m)
            total += np.bincount((mix(least) % _U(buckets)).astype(np.int64), weights=n + k - 1, minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _common_buckets(texts: DataFrame, k: int, m: int, keys: int) -> frozenset[int]:
    """Buckets too large for one worker. What reaches the driver is at most ``keys / COMMON_KEYS`` numbers."""
    sizes = written(bucket_sizes(texts, k, m, bucket_count(keys)))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return frozenset(r.bucket for r in sizes.where(F.col("n") > max(WORKER_WINDOWS, COMMON_KEYS * total // keys)).collect())


def _send(keys: int, common: frozenset[int], k: int, m: int):
    buckets = bucket_count(keys)
    mark = np.zeros(buckets, dtype=bool)
    mark[list(common)] = True

    def send(batches):
        for ids, texts_key, texts in keyed_blocks(batches):
            words = Words(texts)
            first, count, least = _super_kmers(words, k, m)
            bucket = (mix(least) % _U(buckets)).astype(np.int64)
            usual = ~mark[bucket]
            first, count, bucket = first[usual], count[usual], bucket[usual]
            if not len(first):
                continue
            flat, start, end = _single_spaced(words)
            doc = words.doc[first]
            a, b = start[first], end[first + count + k - 2]
            to: list[int] = []
            out: list[bytes] = []
            for key, at in packing.split_by(bucket % keys):
                text = b"\n".join([flat[x:y] for x, y in zip(a[at].tolist(), b[at].tolist(), strict=True)])
                to.append(key)
                here, times = np.unique(doc[at], return_counts=True)  # super-k-mers stand in document order
                out.append(packing.pack(np.diff(ids[here], prepend=0), texts_key[here].astype(np.int32), times.astype(np.int32), (first[at] - words.first[doc[at]]).astype(np.int32), count[at].astype(np.int32), text))
            yield packing.rows(to, out)

    return send


def _repeats(raw: bytes, begin: np.ndarray, finish: np.ndarray, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows also start in a document with a smaller id. Windows are raw[begin:finish]; exact."""
    out = np.zeros(len(h), dtype=bool)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    some = np.zeros(len(h), dtype=bool)
    some[order[1:][same]] = some[order[:-1][same]] = True
    some = np.flatnonzero(some)  # the others have a hash of their own
    order = some[np.lexsort((doc[some], h[some]))]
    hs, ds = h[order], doc[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = hs[1:] != hs[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    again = np.flatnonzero(~new)
    me, top = order[again], order[head[again]]
    pairs = zip(begin[me].tolist(), finish[me].tolist(), begin[top].tolist(), finish[top].tolist(), strict=True)
    equal = np.fromiter((raw[a:b] == raw[c:d] for a, b, c, d in pairs), dtype=bool, count=len(again))
    out[me] = equal & (ds[again] > doc[top])
    mixed = np.unique(head[again[~equal]]).tolist()  # different windows with one hash
    for g in mixed:
        least: dict[bytes, int] = {}
        stop = g + 1
        while stop < len(order) and not new[stop]:
            stop += 1
        for i in order[g:stop].tolist():
            text = raw[begin[i] : finish[i]]
            out[i] = least.setdefault(text, int(doc[i])) < doc[i]
    return out


def _receive(k: int):
    def receive(values: list[bytes]) -> Iterator[pa.RecordBatch]:
        got = [packing.unpack(v, "int64", "int32", "int32", "int32", "int32", "bytes") for v in values]
        ids = np.concatenate([np.repeat(np.cumsum(g[0]), g[2]) for g in got])
        keys = np.concatenate([np.repeat(g[1], g[2]) for g in got])
        at, count = (np.concatenate([g[i] for g in got]) for i in (3, 4))
        words = Words([g[5] for g in got])
        h = window_hashes(words.hashes(), k)
        base = np.concatenate(([0], np.cumsum(count.astype(np.int64) + k - 1)[:-1]))  # first word of each super-k-mer
        total = int(count.sum())
        which = np.repeat(np.arange(len(count)), count)
        place = np.arange(total) - np.repeat(np.cumsum(count, dtype=np.int64) - count, count)
        window = base[which] + place
        hit = _repeats(words.raw, words.start[window], words.end[window + k - 1], h[window], ids[which])
        edge = hit.copy()
        edge[1:] &= ~(hit[:-1] & (which[1:] == which[:-1]))
        first = np.flatnonzero(edge)
        last = hit.copy()
        last[:-1] &= ~(hit[1:] & (which[1:] == which[:-1]))
        last = np.flatnonzero(last)
        s = which[first]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[s]), pa.array(keys[s]), pa.array((at[s] + place[first]).astype(np.int32)), pa.array((at[s] + place[last] + k).astype(np.int32))],
            ["sk_id", "sk_text", "sk_start", "sk_end"],
        )

    return receive


def _common_windows(common: frozenset[int], keys: int, k: int, m: int):
    """Digest, id, text key and first word of each window whose bucket is common."""
    buckets = bucket_count(keys)
    mark = np.zeros(buckets, dtype=bool)
    mark[list(common)] = True

    def each(batches):
        for ids, texts_key, texts in keyed_blocks(batches):
            words = Words(texts)
            first, count, least = _super_kmers(words, k, m)
            hot = mark[(mix(least) % _U(buckets)).astype(np.int64)]
            first, count = first[hot], count[hot]
            if not len(first):
                continue
            window = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            flat, start, end = _single_spaced(words)
            digest = [hashlib.blake2b(flat[a:b], digest_size=16).digest() for a, b in zip(start[window].tolist(), end[window + k - 1].tolist(), strict=True)]
            doc = words.doc[window]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest, pa.binary()), pa.array(ids[doc]), pa.array(texts_key[doc].astype(np.int32)), pa.array((window - words.first[doc]).astype(np.int32))],
                ["digest", "sk_id", "sk_text", "sk_start"],
            )

    return each


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, m: int = 3) -> DataFrame:
    """(sk_id, sk_text, spans): for each text with words to remove, its word ranges as packed little-endian int32 pairs."""
    spark = docs.sparkSession
    arrow_limits(spark)
    keys = packing.key_count(spark)
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), text_key(text_col).alias("h"))
    common = _common_buckets(texts, k, m, keys)
    spans = packing.exchange(texts.mapInArrow(_send(keys, common, k, m), "key int, packed binary"), _receive(k), SPANS)
    if common:
        windows = written(texts.mapInArrow(_common_windows(common, keys, k, m), "digest binary, sk_id long, sk_text int, sk_start int"))
        least = written(windows.groupBy("digest").agg(F.min("sk_id").alias("least"), F.max("sk_id").alias("most")).where("least < most").drop("most"))
        again = windows.join(least, "digest").where("sk_id > least")  # its own exchange, so that a hot digest's partition can be split
        spans = spans.unionByName(again.select("sk_id", "sk_text", "sk_start", (F.col("sk_start") + k).alias("sk_end")))
    return spans.groupBy("sk_id", "sk_text").agg(F.collect_list(F.struct("sk_start", "sk_end")).alias("spans"))


def _cut(texts: list[bytes], spans: pa.ListArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """For each text of a block: kept words joined by a space, words, removed words. ``spans`` has lists of (first word, end), or null."""
    words = Words(texts)
    n = len(words)
    at = np.repeat(words.first[:-1], spans.value_lengths().fill_null(0).to_numpy())
    begin, end = (c.to_numpy() for c in spans.flatten().flatten())
    gone = np.bincount(at + begin, minlength=n + 1) - np.bincount(at + end, minlength=n + 1)
    keep = np.cumsum(gone[:n]) == 0
    doc, a, z = words.doc[keep], words.start[keep], words.end[keep]
    inner = np.ones(len(doc), dtype=bool)
    inner[:-1] = doc[1:] == doc[:-1]
    inner[-1:] = False
    step = np.zeros(len(words.buf) + 1, dtype=np.int8)
    step[a] += 1
    step[z + inner] -= 1  # a space follows all but a text's last word
    buf = words.buf.copy()
    buf[z] = 32
    kept = buf[np.cumsum(step[:-1], dtype=np.int8) > 0]
    offset = np.concatenate(([0], np.cumsum(np.bincount(doc, weights=z - a + inner, minlength=len(texts))))).astype(np.int32)
    have, left = np.diff(words.first), np.bincount(doc, minlength=len(texts))
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offset), pa.py_buffer(kept)), have, have - left


def with_repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, m: int = 3) -> DataFrame:
    """All rows and columns of ``docs``, with columns sk_kept (kept words joined by one space), sk_words and sk_removed."""
    spans = written(repeated_spans(docs, id_col, text_col, k, m))
    docs = replaced(docs, "sk_kept", "sk_words", "sk_removed")
    own = docs.columns
    names = [f"c{i}" for i in range(len(own))]
    plain = docs.toDF(*names)
    i, t = names[own.index(id_col)], names[own.index(text_col)]
    plain = may_be_in(plain, i, id_filter(spans, "sk_id"), "sk_some")
    joined = plain.where("sk_some").withColumn("sk_id", F.col(i).cast("long")).withColumn("sk_text", text_key(t)).join(spans.hint("shuffle_hash"), ["sk_id", "sk_text"], "left")
    joined = joined.select(*names, "spans").unionByName(plain.where("not sk_some").select(*names, F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    at, schema = len(own), joined.select(*names).schema

    def cut(batches):
        for b in batches:
            text = b.column(names.index(t)).cast(pa.large_binary())
            size = np.cumsum(pc.binary_length(text).fill_null(0).to_numpy())
            a, done = 0, 0
            while a < len(b):
                z = max(a + 1, int(np.searchsorted(size, done + BLOCK_BYTES, side="right")))
                kept, have, gone = _cut([x or b"" for x in text.slice(a, z - a).to_pylist()], b.column(at).slice(a, z - a))
                yield pa.RecordBatch.from_arrays([*[c.slice(a, z - a) for c in b.columns[:at]], kept, pa.array(have), pa.array(gone)], [*names, "sk_kept", "sk_words", "sk_removed"])
                a, done = z, size[z - 1]

    out = StructType(list(schema.fields)).add("sk_kept", StringType()).add("sk_words", LongType()).add("sk_removed", LongType())
    return joined.select(*names, "spans").mapInArrow(cut, out).toDF(*own, "sk_kept", "sk_words", "sk_removed")
