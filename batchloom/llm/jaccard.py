"""Exact Jaccard join of word-shingle sets as a metric-space join.

1 - Jaccard is a metric. The join returns the connected components of "similarity at least 0.8" (distance T = 0.2), exactly.

* Equal sets collapse first: each set goes on once, under a number of its own (an id may stand on rows with different sets).
* Common shingles. A sketch of CELLS counters, filled over all texts, ranks shingles: rare first, common last. The ranking is one fixed
  total order of shingles, so the prefix theorem holds: two sets within T share a shingle among the first n - ceil(0.8 n) + 1 of each.
* Pivots. Almost any two documents are at distance exactly 1, where no pivot tells them apart, so pivots are drawn where documents meet: the
  documents with one prefix shingle, in order of size and cut where sizes differ by more than a quarter, elect the one with the least
  random number as their pivot. Two linked documents share a prefix shingle, hence a pivot, so they meet in its region. Short lists (at most
  SHORT) name their pairs instead; of a pair that shares all of its prefix shingles in short lists enough of them must be shared.
  A list of f documents thus makes f rows, never f * f. Who has no partner in a region by the same count of shared prefix shingles leaves it.
* Regions. In a region documents are connected through pivots again and again: the shingles that most of the open documents have are the
  region's centre, the document nearest to it is the pivot, and what lies within T of it is linked. What is then outside the largest
  component is compared with the whole region. Links come back as a spanning forest.
* Large regions (over REGION_SHINGLES) are cut into parts, which are joined as above, and each names its first pivot. Every document learns its
  distances to up to PIVOTS of them and is at home in the Voronoi cell of the nearest, in a ring of RING of the distance. Pairs inside the
  largest group of connected pivots are done; any other document visits, by the triangle inequality, the rings within T of its own
  distance in the cells whose pivot is at most 2T farther than its nearest. Cells are joined in blocks of bounded size.

Scale. Text is scanned three times and never shuffled; what is shuffled are prefix shingles (a fifth of all) and the sets of documents that meet
others, once for each of their pivots. Broadcast: the sketch's ranks (CELLS bytes) and a bit set. No component or region is collected.

Defined results. A null, empty or wordless text has no shingles and is linked with nothing; an empty table gives no rows. Rows with a null id are
left out. Fewer than k words: the whole sequence is one shingle. Rows with one id count as copies of each other only if their sets link; a
component is named by its least id, so two components can bear one name where that id stands on different texts. Shingles are compared by
64-bit hashes and sets by 128-bit digests. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchloom.llm import packing
from batchloom.llm.durable import components, discard, id_filter, may_be_in, without_ids, written
from batchloom.llm.textblocks import BLOCK_BYTES, Words, arrow_limits, blocks, keyed_blocks, mix, shingle_sets

_U = np.uint64
CELL_BITS = 20
CELLS = 1 << CELL_BITS
COMMON_CELLS = 1 << 16
_CHUNKS = 1024
SIMILAR = (80, 100)
SHORT = 8
REGION_SHINGLES = 1 << 21
PIVOTS = 8
ROUNDS = 8
RING = 0.1
_T, _EPS = 0.2, 1e-9


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> _U(64 - CELL_BITS)).astype(np.int64)


def linked(shared, a, b):
    """Similarity of at least 0.8 from the intersection's and the sets' sizes, in integers."""
    return SIMILAR[1] * shared >= SIMILAR[0] * (a + b - shared)


def prefix_size(n: int) -> int:
    return n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1 if n else 0


def _common_cells(texts: DataFrame, k: int) -> np.ndarray:
    """A rank from 0 (rare) for each cell of shingles, from counts over all texts; cells that stand out from the mean count as common."""

    def count(batches):
        total = np.zeros(CELLS, dtype=np.int32)
        for _, block in blocks(batches):
            total += np.bincount(_cell(np.concatenate(shingle_sets(Words(block, lower=True), k))), minlength=CELLS).astype(np.int32)
        yield packing.rows(list(range(_CHUNKS)), [packing.pack(x) for x in total.reshape(_CHUNKS, -1)])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // _CHUNKS, dtype=np.int64)
        for value in table.column("packed").to_pylist():
            total += packing.unpack(value, "int32")[0]
        mean = total.mean()
        at = np.flatnonzero(total > mean + 6 * math.sqrt(mean) + 3)
        cell = at + int(table.column("key")[0].as_py()) * (CELLS // _CHUNKS)
        return pa.table([pa.array(cell.astype(np.int32)), pa.array(np.maximum(total[at] - mean, 1).astype(np.int64))], names=["cell", "n"])

    counts = texts.mapInArrow(count, "key int, packed binary").groupBy("key").applyInArrow(add, "cell int, n long")
    rank = np.zeros(CELLS, dtype=np.uint8)
    for r in counts.orderBy(F.desc("n"), "cell").limit(COMMON_CELLS).toLocalIterator():
        rank[r.cell] = 1 + min(60, int(math.log2(r.n + 1)))
    return rank


def _signatures(texts: DataFrame, rank: np.ndarray, k: int) -> DataFrame:
    """id, h (of the text), n, digest of the set (null if empty) and prefix in rank order."""

    def sign(batches):
        for ids, hashes, block in keyed_blocks(batches):
            size, digest, prefix = [], [], []
            for s in shingle_sets(Words(block, lower=True), k):
                r = rank[_cell(s)]
                p = prefix_size(len(s))
                first = s[np.argsort(r, kind="stable")[:p]] if r.any() else s[:p]  # s ascends, so ties of rank stand in hash order
                size.append(len(s))
                digest.append(_digest(s) if len(s) else None)
                prefix.append(first.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hashes), pa.array(size, pa.int32()), pa.array(digest, pa.binary()), pa.array(prefix, pa.binary())], ["id", "h", "n", "digest", "prefix"])

    return texts.mapInArrow(sign, "id long, h long, n int, digest binary, prefix binary")


def _send_prefixes(keys: int):
    """Of a shingle the top 40 bits travel: an accidental match can only add a meeting."""

    def send(batches):
        for b in batches:
            prefix = [np.frombuffer(x, _U) for x in b.column(2).to_pylist()]
            if not prefix:
                continue
            size = np.array([len(p) for p in prefix], dtype=np.int64)
            s = np.concatenate(prefix)
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)
            ids, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            to, out = [], []
            for key, at in packing.split_by((mix(s) % _U(keys)).astype(np.int64)):
                rows, times = np.unique(row[at], return_counts=True)  # shingles stand in order of their documents
                to.append(key)
                out.append(packing.pack(s[at] >> _U(24), np.diff(ids[rows], prepend=0), n[rows].astype(np.int32), times.astype(np.int32), np.diff(place[at], prepend=0).astype(np.int32)))
            yield packing.rows(to, out)

    return send


def _meetings(values: list[bytes], buckets: int):
    """(lead, doc, n_lead, n_doc, shared, wide) for the prefix shingles of this key: pairs from short lists, each document's pivot from long ones (wide);
    and, packed by buckets of documents (doc is the bucket, lead null), 32 bits of each shingle that a document has in common with another."""
    got = [packing.unpack(v, "uint64", "int64", "int32", "int32", "int32") for v in values]
    s = np.concatenate([g[0] for g in got])
    ids, n = (np.concatenate([np.repeat(x, g[3]) for g, x in ((g, np.cumsum(g[1]) if i == 1 else g[2]) for g in got)]) for i in (1, 2))
    place = np.concatenate([np.cumsum(g[4]) for g in got])
    order = np.lexsort((n, s))
    s, ids, n, place = s[order], ids[order], n[order].astype(np.int64), place[order].astype(np.int64)
    cut = np.flatnonzero((s[1:] != s[:-1]) | (SIMILAR[0] * n[1:] > SIMILAR[1] * n[:-1])) + 1  # linked documents stand between two cuts
    first, size = np.concatenate(([0], cut)), np.diff(np.concatenate(([0], cut, [len(s)])))
    found = []
    for length in range(2, SHORT + 1):
        at = first[size == length]
        for i, j in itertools.combinations(range(length), 2) if len(at) else ():
            x, y = at + i, at + j
            need = -(-SIMILAR[0] * (n[x] + n[y]) // sum(SIMILAR))
            # shingles before this one in rank order that only one side has cannot be shared later
            ok = (SIMILAR[0] * n[y] <= SIMILAR[1] * n[x]) & (1 + np.minimum(n[x] - place[x] - 1, n[y] - place[y] - 1) + np.minimum(place[x], place[y]) >= need)
            x, y = x[ok], y[ok]
            swap = ids[y] < ids[x]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            found.append(np.stack([ids[x], ids[y], n[x], n[y], np.zeros_like(x)], axis=1))
    long_ = np.flatnonzero(size > SHORT)
    if len(long_):
        run = np.repeat(long_, size[long_])
        at = np.repeat(first[long_] - (np.cumsum(size[long_]) - size[long_]), size[long_]) + np.arange(len(run))
        order = np.lexsort((mix(ids[at].astype(_U)), run))
        head = np.concatenate(([True], run[order][1:] != run[order][:-1]))
        lead = np.repeat(at[order][head], size[long_])
        other = ids[lead] != ids[at]
        lead, at = lead[other], at[other]
        found.append(np.stack([ids[lead], ids[at], n[lead], n[at], np.ones_like(at)], axis=1))
    if found:
        rows, times = np.unique(np.concatenate(found), axis=0, return_counts=True)
        cols = [rows[:, 0], rows[:, 1], rows[:, 2].astype(np.int32), rows[:, 3].astype(np.int32), times.astype(np.int64), rows[:, 4] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols] + [pa.nulls(len(rows), pa.binary())], MET)
    at = np.flatnonzero(np.repeat(size > 1, size))
    to, out = [], []
    for bucket, here in packing.split_by((mix(ids[at].astype(_U)) % _U(buckets)).astype(np.int64)):
        some = at[here][np.argsort(ids[at[here]], kind="stable")]
        rows, times = np.unique(ids[some], return_counts=True)
        to.append(bucket)
        out.append(packing.pack(np.diff(rows, prepend=0), times.astype(np.int32), s[some].astype(np.uint32)))
    none = [pa.nulls(len(to), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.bool_())]
    yield pa.RecordBatch.from_arrays([none[0], pa.array(to, pa.int64()), none[1], none[1], none[2], none[3], pa.array(out, pa.binary())], MET)


def _briefs(values: list[bytes]):
    """(doc, brief) for each document of a bucket."""
    got = [packing.unpack(v, "int64", "int32", "uint32") for v in values]
    ids = np.concatenate([np.repeat(np.cumsum(g[0]), g[1]) for g in got])
    s = np.concatenate([g[2] for g in got])
    order = np.lexsort((s, ids))
    ids, s = ids[order], s[order]
    cut = np.flatnonzero(np.diff(ids)) + 1
    yield pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate(([0], cut))]), pa.array([x.tobytes() for x in np.split(s, cut)], pa.binary())], ["doc", "brief"])


MET = ["lead", "doc", "n_lead", "n_doc", "shared", "wide", "brief"]


def _sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The shingle sets of a region's texts, a block at a time."""
    out, block, held = [], [], 0
    for t in texts:
        block.append(t.encode())
        held += len(block[-1])
        if held > BLOCK_BYTES:
            out += shingle_sets(Words(block, lower=True), k)
            block, held = [], 0
    return out + shingle_sets(Words(block, lower=True), k)


class _Index:
    """An inverted index of sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        every = np.concatenate(sets) if len(sets) else np.zeros(0, _U)
        order = np.argsort(every, kind="stable")
        self.keys, self.owner = every[order], np.repeat(np.arange(len(sets)), self.size)[order]

    def shared(self, query: np.ndarray) -> np.ndarray:
        """How many shingles each set has of the query."""
        a, b = np.searchsorted(self.keys, query, "left"), np.searchsorted(self.keys, query, "right")
        n = b - a
        reads = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.owner[reads], minlength=len(self.size))

    def distances(self, query: np.ndarray) -> np.ndarray:
        shared = self.shared(query)
        return 1 - shared / np.maximum(len(query) + self.size - shared, 1)

    def near(self, query: np.ndarray) -> np.ndarray:
        shared = self.shared(query)
        return np.flatnonzero((shared > 0) & linked(shared, self.size, len(query)))

    def centre(self, some: np.ndarray) -> np.ndarray:
        """The shingles that at least half of some sets have."""
        inside = np.zeros(len(self.size), dtype=bool)
        inside[some] = True
        keys, n = np.unique(self.keys[inside[self.owner]], return_counts=True)
        return keys[2 * n >= len(some)]


class _Forest:
    def __init__(self, n: int):
        self.root, self.a, self.b = list(range(n)), [], []

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def link(self, x: int, others: np.ndarray) -> None:
        for y in others.tolist():
            if (rx := self.find(x)) != (ry := self.find(y)):
                self.root[ry] = rx
                self.a.append(x)
                self.b.append(y)


def joined(sets: list[np.ndarray]) -> tuple[list[tuple[int, int]], int]:
    """A spanning forest of the links among sets, and the first pivot (0 if none was needed)."""
    index, forest, open_, pivots = _Index(sets), _Forest(len(sets)), np.arange(len(sets)), []
    for _ in range(ROUNDS):
        if len(open_) < 4 or not len(centre := index.centre(open_)):
            break
        pivots.append(int(open_[np.argmin(index.distances(centre)[open_])]))
        near = index.near(sets[pivots[-1]])
        forest.link(pivots[-1], near)
        before, open_ = len(open_), np.setdiff1d(open_, near)
        if before - len(open_) < max(2, before // 50):
            break
    root = np.array([forest.find(x) for x in range(len(sets))], dtype=np.int64)
    done = root == np.argmax(np.bincount(root)) if len(root) else root
    for x in np.flatnonzero(~done).tolist():
        forest.link(x, index.near(sets[x]))
    return list(zip(forest.a, forest.b, strict=True)), pivots[0] if pivots else 0


def _partnered(table: pa.Table) -> pa.Table:
    """The (lead, doc) that has enough prefix shingles in common with another document of the region for the sets to be linked."""
    ids, n = table.column("doc").to_pylist(), np.array(table.column("n").to_pylist(), dtype=np.int64)
    prefix = [np.unique(np.frombuffer(w, np.uint32)) for w in table.column("brief").to_pylist()]
    index, kept = _Index(prefix), []
    for i, p in enumerate(prefix):
        shared = index.shared(p)
        beyond = SIMILAR[0] * np.maximum(n, n[i]) // SIMILAR[1]
        ok = (shared > 0) & (shared + beyond >= -(-SIMILAR[0] * (n + n[i]) // sum(SIMILAR))) & (SIMILAR[0] * np.maximum(n, n[i]) <= SIMILAR[1] * np.minimum(n, n[i]))
        ok[i] = False
        if ok.any():
            kept.append(ids[i])
    lead = table.column("lead")[0].as_py()
    return pa.table([pa.array([lead] * len(kept), pa.int64()), pa.array(kept, pa.int64())], names=["lead", "doc"])


def _with_partners(met: DataFrame, briefs: DataFrame) -> DataFrame:
    """``met`` less the wide rows that meet no partner in their region, judged by all shared prefix shingles; regions too large for one task keep all."""
    wide = met.where("wide")
    total = wide.groupBy("lead").agg(F.max("n_lead").alias("n_lead"), F.sum("n").alias("total"))
    small = written(total.where(F.col("total") + F.col("n_lead") <= REGION_SHINGLES * SIMILAR[1] // (SIMILAR[1] - SIMILAR[0])).select("lead", F.lit(True).alias("judged"), "n_lead"))
    rows = wide.select("lead", "doc", "n").join(small.select("lead"), "lead").unionByName(small.select("lead", F.col("lead").alias("doc"), F.col("n_lead").alias("n")))
    rows = written(rows)
    rows = rows.join(briefs, "doc")
    small = small.drop("n_lead")
    kept = rows.groupBy("lead").applyInArrow(_partnered, "lead long, doc long").withColumn("kept", F.lit(True))
    met = met.join(small, "lead", "left").join(kept, ["lead", "doc"], "left")
    met = met.withColumn("wide", F.col("wide") & (F.col("judged").isNull() | F.col("kept").isNotNull()))
    return written(met.where("wide or paired").drop("judged", "kept", "paired"))


def _in_stars(met: DataFrame) -> DataFrame:
    """``met`` with a family's pairs gathered: both documents of a pair whose least partner is the same meet in that one's region, so their own pair goes."""
    pairs = met.where("not wide")
    least = written(pairs.groupBy("doc").agg(F.min("lead").alias("m")))
    seen = pairs.join(least.toDF("lead", "m_lead"), "lead", "left").join(least.toDF("doc", "m_doc"), "doc")
    star = F.col("lead") == F.col("m_doc")
    seen = seen.where(star | F.col("m_lead").isNull() | (F.col("m_lead") != F.col("m_doc"))).withColumn("wide", star)
    return met.where("wide").unionByName(seen.select(*met.columns))


def _region(table: pa.Table, k: int) -> pa.Table:
    """Links of a region (or part of one) as (a, b, pivot, lead): among its wide documents, and between its lead and the others; and its first pivot."""
    ids, wide = table.column("doc").to_pylist(), table.column("wide").to_pylist()
    sets = _sets(table.column("t").to_pylist(), k)
    lead = table.column("lead")[0].as_py()
    at = ids.index(lead)
    every = [i for i, w in enumerate(wide) if w or i == at]
    pairs, pivot = joined([sets[i] for i in every]) if any(wide) else ([], 0)
    out = [(ids[every[x]], ids[every[y]], False) for x, y in pairs] + [(lead, ids[every[pivot]], True)]
    narrow = [i for i, w in enumerate(wide) if not w and i != at]
    out += [(lead, ids[narrow[i]], False) for i in _Index([sets[i] for i in narrow]).near(sets[at]).tolist()]
    a, b, p = zip(*out, strict=True)
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(p, pa.bool_())], names=["a", "b", "pivot"])


def _measure(table: pa.Table, k: int) -> pa.Table:
    """For a part of a large region, each document's distances to the region's pivots (those of other parts stand in rows with a rank)."""
    rank = table.column("rank").to_pylist()
    sets = _sets(table.column("t").to_pylist(), k)
    pivots = sorted((r, i) for i, r in enumerate(rank) if r is not None)
    own = [i for i, r in enumerate(rank) if r is None]
    index = _Index([sets[i] for i in own])
    far = np.stack([index.distances(sets[i]) for _, i in pivots], axis=1)
    some = table.select(["lead", "doc", "n"]).take(pa.array(own, pa.int64()))
    return some.append_column("far", pa.array(far.tolist(), pa.list_(pa.float64())))


def _main_group(table: pa.Table) -> pa.Table:
    """The largest group of pivots that documents within T connect, as a bit mask, from (lead, mask, documents with it)."""
    masks, n = table.column("mask").to_pylist(), table.column("m").to_pylist()
    groups: list[list[int]] = []  # mask and documents; masks of different groups have no bit in common
    for mask, count in zip(masks, n, strict=True):
        same = [g for g in groups if g[0] & mask]
        every = functools.reduce(operator.or_, [g[0] for g in same], mask)
        groups = [g for g in groups if not g[0] & mask] + [[every, count + sum(g[1] for g in same)]]
    best = max(groups, key=lambda g: (g[1], g[0]))[0] if groups else 0
    return pa.table([table.column("lead").slice(0, 1), pa.array([best], pa.int32())], names=["lead", "main"])


def _block(table: pa.Table, k: int) -> pa.Table:
    """Links between a block's documents at home and its visitors."""
    ids, visits = table.column("doc").to_pylist(), table.column("visits").to_pylist()
    sets = _sets(table.column("t").to_pylist(), k)
    home = [i for i, v in enumerate(visits) if not v]
    index, forest = _Index([sets[i] for i in home]), _Forest(len(sets))
    at = np.array(home, dtype=np.int64)
    for i, v in enumerate(visits):
        if v and len(at):
            forest.link(i, at[index.near(sets[i])])
    return pa.table([pa.array([ids[x] for x in forest.a], pa.int64()), pa.array([ids[y] for y in forest.b], pa.int64())], names=["a", "b"])


def _across_parts(large: DataFrame, pivots: DataFrame, k: int) -> DataFrame:
    """Links of large regions across their parts. ``large``: (lead, doc, n, part, t) of wide documents; ``pivots``: (lead, doc, rank, t, parts)."""
    rows = large.select("lead", "part", "doc", "n", "t", F.lit(None).cast("int").alias("rank"))
    sent = pivots.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "doc", F.lit(0).alias("n"), "t", "rank")
    far = rows.unionByName(sent).groupBy("lead", "part").applyInArrow(lambda x: _measure(x, k), "lead long, doc long, n int, far array<double>")
    close = F.aggregate(F.transform("far", lambda d, i: F.when(d <= _T + _EPS, F.get(F.array(*[F.lit(1 << b) for b in range(PIVOTS)]), i)).otherwise(0)), F.lit(0), lambda x, y: x.bitwiseOR(y))
    near = F.array_min("far")
    far = written(far.withColumns({"mask": close, "nearest": near, "home": (F.array_position("far", near) - 1).cast("int")}).withColumn("ring", F.floor(F.col("nearest") / RING).cast("int")))
    main = far.where("mask > 0").groupBy("lead", "mask").agg(F.count("*").alias("m")).groupBy("lead").applyInArrow(_main_group, "lead long, main int")
    far = far.join(main, "lead", "left").withColumn("open", F.col("mask").bitwiseAND(F.coalesce("main", F.lit(0))) == 0)
    names = pivots.groupBy("lead").agg(F.array_sort(F.collect_list(F.struct("rank", "doc"))).alias("names"))
    to_pivot = far.join(names, "lead").select(F.col("doc").alias("a"), F.explode(F.filter(F.transform("names", lambda p, i: F.when(F.get("far", i) <= _T + _EPS, p["doc"])), lambda x: x.isNotNull())).alias("b"))

    def rings(d, i):
        inside = d <= F.col("nearest") + 2 * _T + _EPS
        low, high = F.floor((d - _T - _EPS) / RING), F.floor((d + _T + _EPS) / RING)
        every = F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(int(1 / RING) + 1)).cast("int"))
        return F.when(inside, F.transform(every, lambda r: F.struct(i.cast("int").alias("home"), r.alias("ring")))).otherwise(F.array().cast("array<struct<home:int,ring:int>>"))

    visitors = far.where("open").select("lead", "doc", "n", F.explode(F.flatten(F.transform("far", rings))).alias("v")).select("lead", "doc", "n", "v.home", "v.ring")
    cell = ["lead", "home", "ring"]
    rows_of = far.groupBy(*cell).agg(F.ceil(F.sum("n") / REGION_SHINGLES).cast("int").alias("rows"))
    sizes = written(rows_of.join(visitors.groupBy(*cell).agg(F.ceil(F.sum("n") / REGION_SHINGLES).cast("int").alias("cols")), cell))

    def place(count: str):
        return F.pmod(F.xxhash64("doc"), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = far.join(sizes, cell).select(*cell, "doc", place("rows").alias("i"), every("cols").alias("j"), F.lit(False).alias("visits"))
    right = visitors.join(sizes, cell).select(*cell, "doc", every("rows").alias("i"), place("cols").alias("j"), F.lit(True).alias("visits"))
    sets = large.select("lead", "doc", "t")
    blocks_ = left.unionByName(right).join(sets, ["lead", "doc"])
    links = blocks_.groupBy(*cell, "i", "j").applyInArrow(lambda x: _block(x, k), "a long, b long")
    return to_pivot.where("a <> b").unionByName(links)


def _links(texts: DataFrame, numbered: DataFrame, k: int) -> DataFrame:
    """(a, b): a spanning set of the links between sets, by their numbers."""
    spark = texts.sparkSession
    buckets = max(1, packing.key_count(spark) // packing.KEYS_PER_PARTITION)
    sent = numbered.select("id", "n", "prefix").mapInArrow(_send_prefixes(buckets), "key int, packed binary")
    every = written(packing.exchange(sent, lambda values: _meetings(values, buckets), "lead long, doc long, n_lead int, n_doc int, shared long, wide boolean, brief binary"))
    briefs = packing.exchange(every.where("lead is null").select(F.col("doc").cast("int").alias("key"), F.col("brief").alias("packed")), _briefs, "doc long, brief binary")
    met = every.where("lead is not null").groupBy("lead", "doc", "n_lead", "n_doc", "wide").agg(F.sum("shared").alias("shared"))
    need = F.ceil(SIMILAR[0] * (F.col("n_lead") + F.col("n_doc")) / sum(SIMILAR))
    beyond = F.greatest(*[F.floor(F.lit(SIMILAR[0]) * F.col(c) / SIMILAR[1]) for c in ("n_lead", "n_doc")])  # most shingles outside a prefix
    met = met.where(F.col("wide") | (F.col("shared") + beyond >= need - 1e-6))
    met = written(met.groupBy("lead", "doc").agg(F.max("n_lead").alias("n_lead"), F.max("n_doc").alias("n"), F.bool_or("wide").alias("wide"), F.bool_or(~F.col("wide")).alias("paired")))
    met = written(_in_stars(_with_partners(met, briefs)))
    leads = met.groupBy("lead").agg(F.max("n_lead").alias("n"), F.bool_or("wide").alias("wide"), F.sum("n").alias("total"))
    leads = written(leads.withColumn("parts", F.ceil((F.col("total") + F.col("n")) / REGION_SHINGLES).cast("int")).drop("total"))
    some = leads.where("parts = 1").select("lead", F.col("lead").alias("doc"), "n", "wide", F.lit(0).alias("part"), "parts")
    large = leads.where("parts > 1")
    copies = large.select("lead", F.col("lead").alias("doc"), "n", "wide", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
    others = met.select("lead", "doc", "n", "wide").join(large.select("lead", "parts"), "lead", "left").fillna(1, ["parts"])
    others = others.select("lead", "doc", "n", "wide", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), "parts")
    members = others.unionByName(some).unionByName(copies)
    # each document's text goes to its regions, found again by id and hash; a bit set skips most other texts
    places = members.groupBy("doc").agg(F.collect_list(F.struct("lead", "part", "parts", "n", "wide")).alias("places")).withColumnRenamed("doc", "set")
    places = written(places.join(numbered.select(F.col("id").alias("set"), "doc", "h"), "set"))
    found = may_be_in(texts, "id", id_filter(places, "doc"), "hit").where("hit").groupBy("id", "h").agg(F.first("t").alias("t"))
    met = found.join(places, (F.col("id") == F.col("doc")) & (found["h"] == places["h"])).select(F.col("set").alias("doc"), "t", F.explode("places").alias("p")).select("doc", "t", "p.*")
    found = written(met.select("lead", "part", "doc", "wide", "t").groupBy("lead", "part").applyInArrow(lambda x: _region(x, k), "a long, b long, pivot boolean"))
    links = found.where("not pivot and a <> b").select("a", "b")
    if large.limit(1).count():
        whole = written(met.where("parts > 1 and wide").dropDuplicates(["lead", "doc"]))
        first = F.row_number().over(Window.partitionBy("lead").orderBy(F.xxhash64("doc"), "doc"))
        pivots = found.where("pivot").select(F.col("a").alias("lead"), F.col("b").alias("doc")).distinct()
        pivots = pivots.join(whole.select("lead", "doc", "t", "parts"), ["lead", "doc"]).withColumn("rank", first).where(F.col("rank") <= PIVOTS)
        links = links.unionByName(_across_parts(whole, written(pivots.withColumn("rank", F.col("rank") - 1)), k))
    return links


def _representatives(signed: DataFrame) -> DataFrame:
    """(digest, doc, h, n, prefix, copies): a row for each set. Prefixes of sets without copies are not shuffled."""
    signed = signed.where("n > 0").withColumn("d", F.xxhash64("digest"))
    first = written(signed.groupBy("digest", "d").agg(F.min(F.struct("id", "h")).alias("r"), F.count("*").alias("copies")).where("copies > 1"))
    seen = may_be_in(signed, "d", id_filter(first, "d"), "hit")
    cols = ["digest", F.col("id").alias("doc"), "h", "n", "prefix"]
    first = first.select(F.col("digest").alias("x"), "copies", "r")
    told = seen.where("hit").join(first, F.col("digest") == F.col("x"), "left").where(F.col("x").isNull() | (F.struct("id", "h") == F.col("r")))
    kept = told.select(*cols, F.coalesce("copies", F.lit(1).cast("long")).alias("copies")).dropDuplicates(["digest"])
    return seen.where("not hit").select(*cols, F.lit(1).cast("long").alias("copies")).unionByName(kept)


def _row_components(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n, digest, component): one row for each row of ``docs`` with an id."""
    arrow_limits(docs.sparkSession)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    signed = written(_signatures(texts, _common_cells(texts, k), k))
    rows = written(signed.select("id", "n", "digest"))
    # from here to the components, id is the number of a set; it holds once it is written
    numbered = written(_representatives(signed).withColumn("id", F.monotonically_increasing_id()))
    discard(signed)
    joined_ = written(components(_links(texts, numbered, k)).join(numbered.select("id", "doc", "digest"), "id"))
    least = joined_.groupBy("component").agg(F.min("doc").alias("least"))
    named = joined_.join(least, "component").select("digest", "least")
    alone = numbered.where("copies > 1").select("digest", "doc").join(named.select("digest"), "digest", "left_anti").toDF("digest", "least")
    named = written(named.unionByName(alone))
    out = rows.join(named, "digest", "left")
    return out.select("id", "n", "digest", F.coalesce("least", "id").alias("component"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(id, n_shingles, component): one row for each row of ``docs`` with an id."""
    return _row_components(docs, id_col, text_col, k).select("id", F.col("n").cast("long").alias("n_shingles"), "component")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """The rows of ``docs`` less those whose component has a smaller id; rows without id or shingles stay."""
    found = written(_row_components(docs, id_col, text_col, k))
    gone = found.where("component < id").select("id", "digest")
    mixed = written(gone.select("id").distinct().join(found.where("component >= id"), "id", "left_semi"))  # ids of which only some rows go
    if not mixed.limit(1).count():
        return without_ids(docs, id_col, gone.select("id"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (names[docs.columns.index(c)] for c in (id_col, text_col))

    def digest(t):
        s = shingle_sets(Words([(t or "").encode()], lower=True), k)[0]
        return _digest(s) if len(s) else None

    seen = may_be_in(docs.toDF(*names), key, id_filter(mixed, "id"), "m_hit")
    plain = without_ids(seen.where("not m_hit").select(*names), key, gone.select("id"))
    told = seen.where("m_hit").withColumn("m_digest", F.udf(digest, "binary")(text))
    told = told.join(gone.toDF("g_id", "g_digest"), (F.col(key) == F.col("g_id")) & (F.col("m_digest") == F.col("g_digest")), "left_anti")
    return plain.unionByName(told.select(*names)).toDF(*docs.columns)
