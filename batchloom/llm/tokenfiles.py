"""Token-ID files: tokenise texts, write their ids in ascending id order as checksummed blocks, and read them back.

Texts are range-partitioned and sorted by document id; then one task tokenises them, codes the ids in blocks of at most ``idcoder.BLOCK_IDS``
and writes the blocks as rows of a Parquet folder by Spark's committer, so a lost executor costs a task. The tokenizer's pre-tokenizer never
joins across ASCII white space, so the distinct words between it are encoded once, many as one text, and kept (about CACHE words a worker), and a block of texts
is looked up at once by the words' hashes; a text that holds the string of a special token is encoded whole, as the library finds it.
Reading back needs no shuffle of ids: a task sums up the documents' pieces in its blocks, and the few pieces of a document that
ends in another task are joined by their checksums. The place of a partition's first id needs the number of ids of each partition:
that many numbers reach the driver.

Defined results. Null text: as empty, only the end id. Null document ids come first; rows with equal ids follow each other in order of their
texts' hash. An empty table gives no blocks and no rows. Ids of 65536 and above raise. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import functools
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchloom.llm import idcoder
from batchloom.llm.durable import written
from batchloom.llm.textblocks import Words, arrow_limits

CACHE = 2_000_000
TEXT_BYTES = 1 << 20
LONG_WORD = 64
#: Stands between words that are encoded as one text: a word of one id that no other word without this character holds.
MARK, JOINED = b"^", 1000
#: The normalizer and pre-tokenizer for which ``Pieces`` knows where words are cut.
CUT_BY = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
_LETTER, _OTHER, _UNSURE, _GAP = range(4)
_KIND = np.full(256, _UNSURE, np.uint8)
_KIND[33:127] = _OTHER
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = _LETTER
_KIND[[39, *range(48, 58)]] = _UNSURE
_KIND[[*range(9, 14), 32]] = _GAP
FILES = "part int, seq int, n_ids long, block binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Pieces(Words):
    """Words cut further, where every text is cut by CUT_BY: into runs of letters, lower-cased, and runs of other characters.

    That holds for words of ASCII and of the letters U+00C0 to U+00FF, which no normalisation joins; words with an apostrophe, a digit
    or any other character stay whole and unchanged. ``sure``: whether a word is such a run, which nothing cuts or changes any more.
    Where texts are not cut by CUT_BY, ``finer`` is false and all words stay whole.
    """

    def __init__(self, texts: list[bytes], finer: bool):
        super().__init__(texts)
        if not finer:
            self.sure = np.zeros(len(self), bool)
            return
        kind, buf = _KIND[self.buf], self.buf.copy()
        second = np.flatnonzero(buf == 0xC3) + 1
        kind[second] = np.where((buf[second] == 0x97) | (buf[second] == 0xB7), _UNSURE, _LETTER)  # the signs of multiplication and division
        whole = np.unique(np.searchsorted(self.start, np.flatnonzero(kind == _UNSURE), "right")) - 1
        inside = np.zeros(len(kind), np.int8)
        inside[self.start[whole]], inside[self.end[whole]] = 1, -1
        kind[np.cumsum(inside, dtype=np.int8).view(bool)] = _UNSURE
        buf[(buf - np.uint8(65) < 26) & (kind == _LETTER)] += np.uint8(32)
        second = second[(kind[second] == _LETTER) & (buf[second] < 0x9F)]
        buf[second] += np.uint8(32)
        cut = np.append(np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1]))), len(kind))
        word = kind[cut[:-1]] != _GAP
        self.start, self.end = cut[:-1][word], cut[1:][word]
        self.sure = kind[self.start] != _UNSURE
        self.raw, self.buf = buf.tobytes(), buf
        self.first = np.searchsorted(self.start, self.offset)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))


def _ids(tokenizer, texts: list[bytes]) -> list[np.ndarray]:
    return [np.array(e.ids, dtype=np.int64) for e in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


class Tokens:
    """Encodes texts word by word; the ids of known words stand one after the other in ``flat``, and their hashes in an open table."""

    def __init__(self, spec: str, end_id: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, parts = Tokenizer.from_str(spec), json.loads(spec)
        self.special = [t["content"].encode() for t in parts.get("added_tokens", [])]
        self.finer = (parts.get("normalizer"), parts.get("pre_tokenizer")) == CUT_BY
        runs = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, CUT_BY[1]["pretokenizers"][1]]}
        self.of_runs = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": runs})) if self.finer else self.tokenizer
        self.end = np.zeros(0, np.int64) if end_id is None else np.array([end_id], np.int64)
        mark = self.whole([MARK])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.words = 0
        self.flat, self.start = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64)
        self.keys, self.number = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int32)

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return _ids(self.tokenizer, texts)

    def several(self, words: list[bytes], sure: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids of each); ``sure``: those of ``Pieces``. Words are encoded as texts of many, with MARK between them; a word that holds it is encoded alone."""
        encode = functools.partial(_ids, self.of_runs) if sure else self.whole
        alone = [i for i, w in enumerate(words) if self.mark is None or MARK in w]
        n, parts = np.zeros(len(words), np.int64), encode([words[i] for i in alone])
        n[alone] = [len(x) for x in parts]
        rest = [w for w in words if self.mark is not None and MARK not in w]
        ids = [np.zeros(0, np.int64), *encode([(b" " + MARK + b" ").join([*rest[a : a + JOINED], b""]) for a in range(0, len(rest), JOINED)])]
        ids = np.concatenate(ids)
        ends = np.flatnonzero(ids == self.mark)
        together = np.ones(len(words), dtype=bool)
        together[alone] = False
        n[together] = np.diff(ends, prepend=-1) - 1
        out = np.empty(int(n.sum()), np.int64)
        own = np.repeat(together, n)
        out[own] = ids[ids != self.mark]
        if alone:
            out[~own] = np.concatenate(parts)
        return out, n

    def added(self, words: list[bytes], sure: bool = False) -> np.ndarray:
        """Encodes the words; returns their numbers."""
        ids, n = self.several(words, sure)
        at, used = self.words, int(self.start[self.words])
        while used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        while at + len(n) + 1 > len(self.start):
            self.start = np.append(self.start, np.zeros_like(self.start))
        self.flat[used : used + len(ids)] = ids
        self.start[at + 1 : at + 1 + len(n)] = used + np.cumsum(n)
        self.words += len(words)
        return np.arange(at, self.words)

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the word of each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        mask, left = len(self.keys) - 1, np.arange(len(hashes))
        at = (hashes & np.uint64(mask)).astype(np.int64)
        while len(left):
            key = self.keys[at]
            same = key == hashes[left]
            out[left[same]] = self.number[at[same]]
            on = ~same & (key != 0)
            left, at = left[on], (at[on] + 1) & mask
        return out

    def keep(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Puts distinct hashes that are not there yet into the table, which stays half empty."""
        if 2 * self.words > len(self.keys):
            old, old_numbers = self.keys[self.keys != 0], self.number[self.keys != 0]
            size = 2 * len(self.keys)
            while 2 * self.words > size:
                size *= 2
            self.keys, self.number = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            hashes, numbers = np.concatenate((old, hashes)), np.concatenate((old_numbers, numbers))
        mask = len(self.keys) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        while len(hashes):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]
            won = self.keys[at] == hashes
            self.number[at[won]] = numbers[won]
            hashes, numbers, at = hashes[~won], numbers[~won], (at[~won] + 1) & mask

    def numbers(self, w: Pieces) -> np.ndarray:
        """The number of each word; words not seen before are encoded."""
        hashes = np.maximum(w.hashes(), np.uint64(1))
        out = self.found(hashes)
        long = np.flatnonzero(w.end - w.start > LONG_WORD)  # equal hashes of different long words can be constructed
        out[long] = 0
        unseen = np.flatnonzero(out < 0)
        for sure in (True, False):
            new = unseen[w.sure[unseen] == sure]
            if not len(new):
                continue
            kinds, first, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            at = new[first]
            numbers = self.added([w.raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)], sure)
            self.keep(kinds, numbers)
            out[new] = numbers[which]
        if len(long):
            texts = [w.raw[a:b] for a, b in zip(w.start[long].tolist(), w.end[long].tolist(), strict=True)]
            place = {t: i for i, t in enumerate(dict.fromkeys(texts))}
            out[long] = self.added(list(place))[[place[t] for t in texts]]
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        raw = b"\n".join(texts)
        special = [s for s in self.special if s in raw]
        plain = [not any(s in t for s in special) for t in texts]
        if self.words > CACHE or self.start[self.words] > 8 * CACHE:
            self.clear()
        w = Pieces([t if p else b"" for t, p in zip(texts, plain, strict=True)], self.finer)
        word = self.numbers(w)
        n = self.start[word + 1] - self.start[word]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.repeat(self.start[word] - upto[:-1], n) + np.arange(int(upto[-1]))]
        cut = upto[w.first].tolist()
        out = [np.concatenate((ids[a:b], self.end)) for a, b in itertools.pairwise(cut)]
        for i in [i for i, p in enumerate(plain) if not p]:
            out[i] = np.concatenate((self.whole([texts[i]])[0], self.end))
        return out


@functools.lru_cache(maxsize=1)
def _tokens(spec: str, end_id: int | None) -> Tokens:
    """A worker's words, for all of its tasks."""
    return Tokens(spec, end_id)


def tokenised(batches: Iterator[pa.RecordBatch], spec: str, end_id: int | None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ids) for batches of (id, text), in their order."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    state = _tokens(spec, end_id)
    docs: list[int | None] = []
    texts: list[bytes] = []
    held = 0

    def flush():
        for doc, ids in zip(docs, state.encode(texts), strict=True):
            if len(ids) and int(ids.max()) > 65535:
                raise ValueError("ids above 65535 do not fit the file format")
            yield doc, ids

    for b in batches:
        for doc, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            docs.append(doc)
            texts.append(t or b"")
            held += len(texts[-1])
            if held > TEXT_BYTES:
                yield from flush()
                docs, texts, held = [], [], 0
    if docs:
        yield from flush()


def _blocks(rows: Iterator[tuple[int | None, np.ndarray]]):
    """Cuts a run of documents into (ids, first row number, document ids, ids of each document); long documents span blocks."""
    ids, docs, sizes, held, first, row = [], [], [], 0, 0, -1
    for doc, x in rows:
        row += 1
        at = 0
        while at < len(x):
            if held == idcoder.BLOCK_IDS:
                yield np.concatenate(ids), first, np.array(docs, np.int64), np.array(sizes, np.int64)
                ids, docs, sizes, held = [], [], [], 0
            if not docs:
                first = row
            part = x[at : at + idcoder.BLOCK_IDS - held]
            ids.append(part)
            docs.append(np.iinfo(np.int64).min if doc is None else doc)
            sizes.append(len(part))
            held += len(part)
            at += len(part)
    if docs:
        yield np.concatenate(ids), first, np.array(docs, np.int64), np.array(sizes, np.int64)


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Tokenises the texts and writes their ids as blocks in ascending id order; returns the files' rows (part, seq, n_ids, block)."""
    arrow_limits(docs.sparkSession, 2)
    spec = open(tokenizer or default_tokenizer()).read()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    ordered = texts.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("t"))

    def each(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, block in enumerate(_blocks(tokenised(batches, spec, end_id))):
            columns = ((part, pa.int32()), (seq, pa.int32()), (len(block[0]), pa.int64()), (idcoder.pack_blocks([block])[0], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in columns], ["part", "seq", "n_ids", "block"])

    return written(ordered.mapInArrow(each, FILES))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, int, np.ndarray, np.ndarray]]:
    """(part, seq, ids, first row, document ids, sizes) of each block of (part, seq, block)."""
    for b in batches:
        for part, seq, block in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            yield part, seq, *idcoder.unpack_blocks([block])[0]


def _doc_id(d: int) -> int | None:
    return None if d == np.iinfo(np.int64).min else d


def read(files: DataFrame) -> DataFrame:
    """(part, seq, row, id, ids): the documents' pieces, row numbering the documents of a part in order; ids are packed little-endian uint32."""
    arrow_limits(files.sparkSession, 1)

    def each(batches):
        for part, seq, ids, first, docs, sizes in _unpacked(batches):
            raw, cut = ids.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(sizes.astype(np.int64) * 4))).tolist()
            out = [(part, seq, first + j, _doc_id(d), raw[cut[j] : cut[j + 1]]) for j, d in enumerate(docs.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "row", "id", "ids"])

    return files.select("part", "seq", "block").mapInArrow(each, "part int, seq int, row long, id long, ids binary")


def _sums(batches):
    """(part, row, id, seq, n, crc) of the run of consecutive blocks of this task that hold a document."""
    out: list[list] = []
    for part, seq, ids, first, docs, sizes in _unpacked(batches):
        raw, at = ids.astype("<u4").tobytes(), 0
        for j, (d, n) in enumerate(zip(docs.tolist(), sizes.tolist(), strict=True)):
            piece = raw[at : at + 4 * n]
            at += 4 * n
            if not j and out and out[-1][0] == part and out[-1][1] == first and out[-1][6] == seq - 1:
                out[-1][4:] = [out[-1][4] + n, zlib.crc32(piece, out[-1][5]), seq]
            else:
                out.append([part, first + j, _doc_id(d), seq, n, zlib.crc32(piece), seq])
        if len(out) > 10_000:
            yield _sum_rows(out[:-1])
            out = out[-1:]
    if out:
        yield _sum_rows(out)


def _sum_rows(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["part", "row", "id", "seq", "n", "crc"])


def joined_crc(first: int, second: int, size: int) -> int:
    """The crc32 of two byte strings after each other, from theirs and the second's size: a zero bit is a linear map of the checksum."""
    step = [0xEDB88320] + [1 << i for i in range(31)]

    def apply(table: list[int], x: int) -> int:
        out = 0
        for column in table:
            if x & 1:
                out ^= column
            x >>= 1
        return out

    bits = 8 * size
    while bits:
        if bits & 1:
            first = apply(step, first)
        step = [apply(step, column) for column in step]
        bits >>= 1
    return first ^ second


def documents_of(files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32): start counts the ids of all documents before; every value is taken from the blocks read back."""
    arrow_limits(files.sparkSession, 1)
    sums = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    total, starts = 0, []
    for part, n in sums:
        starts.append((part, total))
        total += n
    starts = files.sparkSession.createDataFrame(starts, "part int, before long")

    @F.pandas_udf("long")
    def crc(pieces):
        import pandas as pd

        return pd.Series([functools.reduce(lambda a, p: (joined_crc(a[0], p["crc"], 4 * p["n"]), 0), found[1:], (found[0]["crc"], 0))[0] for found in pieces])

    pieces = files.select("part", "seq", "block").mapInArrow(_sums, "part int, row long, id long, seq int, n long, crc long")
    docs = pieces.groupBy("part", "row").agg(F.first("id").alias("id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("seq", "n", "crc"))).alias("x"))
    docs = docs.select("part", "row", "id", "n_tokens", crc("x").alias("ids_crc32"))
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    found = docs.withColumn("b", F.coalesce(before, F.lit(0))).join(F.broadcast(starts), "part")
    return found.select("id", (F.col("before") + F.col("b")).alias("start"), "n_tokens", "ids_crc32")
