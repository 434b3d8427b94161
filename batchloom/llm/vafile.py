"""Exact top-k inner-product search with vector-approximation files.

Method. The approximation file holds, for blocks of candidates of one order of magnitude, a small cell number for each component (CELL_BITS bits) and the cells' edges, which are placed by
quantiles of the block: each cell holds equally many values, between the least and the greatest of them. So neither an outlier nor a skewed component widens the cells of other rows.
Phase 1 scans it: a cell's edges bound the component from both sides, so sums bound a query's score from both sides. A first scan keeps each task's k largest lower bounds of each query; the k-th largest
of them all is the query's limit. A second scan of the cells, with the limits, lets only candidates pass whose upper bound reaches it: nothing else is written. Phase 2 reads exact vectors in order of the bounds: the WAVE * k
candidates of greatest upper bound first; their k-th score is then the threshold for all others, of which only those with an upper bound
at least as large are read (equal ones too, so that the smaller id wins). Then the k-th result is certain.

Scale. The search is the stated query set against all rows, in blocks. Queries are sent to the blocks of cells, an eighth of the vectors' size, in parts of
QUERY_ROWS; cells are copied once for each part. Exact vectors stay where they are, but for those that survive: a bit set of their ids,
whose size is fixed, picks them out. No list of a query's survivors is collected; thresholds come from ranks.

Defined results. Vectors that are null or hold null or non-finite components take no part, nor do null ids. Only vectors of the same length are compared.
With fewer than k candidates a query gets all of them; a query without candidates has no rows, nor has an empty table. Scores are exact
whatever the size of the components; one beyond 64 bits counts as the nearest 64-bit integer. Repeated rows count as that many candidates, but
never for a query with the same id; equal query rows are one query, and query rows with one id and different vectors share one list.
Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.llm import packing
from batchloom.llm.durable import id_filter, may_be_in, written
from batchloom.llm.textblocks import arrow_limits

BLOCK_ROWS = 2048
QUERY_ROWS = 2048
CELL_BITS = 6
WAVE = 4
_SMALL = float(1 << 25)  # products of smaller components are summed in 64 bits
_MOST = (1 << 63) - 1
_SLACK = 1e-9


def usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) as doubles; what exceeds the range of doubles is left at its end."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * 256.0), -np.finfo(float).max, np.finfo(float).max)


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, row by row, of scaled vectors."""
    small = np.maximum(np.abs(queries).max(axis=1, initial=0), np.abs(vectors).max(axis=1, initial=0)) < _SMALL
    out = np.zeros(len(queries), dtype=np.int64)
    out[small] = (queries[small].astype(np.int64) * vectors[small].astype(np.int64)).sum(axis=1)
    for i in np.flatnonzero(~small).tolist():
        score = sum(int(a) * int(b) for a, b in zip(queries[i].tolist(), vectors[i].tolist(), strict=True))
        out[i] = max(-_MOST - 1, min(_MOST, score))
    return out


def _by_length(batch: pa.RecordBatch, column: int):
    """(length, rows, matrix of scaled vectors) for the vectors of a batch."""
    lists = batch.column(column)
    flat, size = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(lists.offsets.to_numpy())
    start = np.concatenate(([0], np.cumsum(size)))
    for d, at in packing.split_by(size.astype(np.int64)):
        yield d, at, scaled(flat[start[at][:, None] + np.arange(d)]) if d else np.zeros((len(at), 0))


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def cut(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a block by quantiles: (cell of each row and component, least and greatest value of each component's cells)."""
    n, d = x.shape
    k = min(1 << CELL_BITS, n)
    edge = np.arange(k + 1) * n // k
    order = np.argsort(x, axis=0, kind="stable")
    ranked = np.take_along_axis(x, order, axis=0)
    cells = np.empty((n, d), dtype=np.uint8)
    np.put_along_axis(cells, order, np.repeat(np.arange(k, dtype=np.uint8), np.diff(edge))[:, None], axis=0)
    return cells, ranked[edge[:-1]].T, ranked[edge[1:] - 1].T


def _cells(batches):
    """The approximation file: one row for each length, magnitude and up to BLOCK_ROWS vectors of (id, hash, vector)."""
    for b in batches:
        ids, hashes = _longs(b.column(0)), _longs(b.column(1))
        for d, at, x in _by_length(b, 2):
            for _, alike in packing.split_by(np.frexp(np.abs(x).max(axis=1, initial=0))[1].astype(np.int64)):
                for a in range(0, len(alike), BLOCK_ROWS):
                    rows = alike[a : a + BLOCK_ROWS]
                    value = packing.pack(ids[at[rows]], hashes[at[rows]], *cut(x[rows]))
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([value], pa.binary())], ["d", "packed"])


def _queries(batches):
    """One row for each part and length of (part, id, hash, vector, limit)."""
    for b in batches:
        parts, ids, hashes = _longs(b.column(0)), _longs(b.column(1)), _longs(b.column(2))
        limits = b.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
        for d, at, x in _by_length(b, 3):
            for part, rows in packing.split_by(parts[at]):
                value = packing.pack(ids[at[rows]], hashes[at[rows]], x[rows], limits[at[rows]])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([d], pa.int32()), pa.array([value], pa.binary())], ["part", "d", "asked"])


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of each query with each row of cells; wide enough for rounding."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        lo, hi = (np.take_along_axis(edge, cells.T.astype(np.int64), axis=1).T for edge in (low, high))
        scale = np.abs(queries) @ (np.maximum(np.abs(lo), np.abs(hi)).T) * _SLACK + 1
        upper = plus @ hi.T + minus @ lo.T + scale
        lower = plus @ lo.T + minus @ hi.T - scale
    return np.where(np.isnan(lower), -np.inf, lower), np.where(np.isnan(upper), np.inf, upper)


def _blocks(batches):
    """Blocks of cells with the queries sent to them: (packed queries, ids, hashes and limits of the queries, ids and hashes of the candidates, lower and upper bounds, same id)."""
    for b in batches:
        for d, asked, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            qi, qh, q, limit = packing.unpack(asked, "int64", "int64", "float64", "float64")
            ci, ch, cells, low, high = packing.unpack(packed, "int64", "int64", "uint8", "float64", "float64")
            k = min(1 << CELL_BITS, len(ci))
            lower, upper = bounds(q.reshape(len(qi), d), cells.reshape(len(ci), d), low.reshape(d, k), high.reshape(d, k))
            yield asked, (qi, qh, limit), (ci, ch), lower, upper, qi[:, None] == ci[None, :]


def _limits(k: int):
    """(query_id, qh, lower): the k largest lower bounds of each query over the blocks of a task."""

    def each(batches):
        best: dict[bytes, tuple] = {}
        for asked, (qi, qh, _), _, lower, _, own in _blocks(batches):
            lower[own] = -np.inf
            every = np.concatenate((best[asked][2], lower), axis=1) if asked in best else lower
            top = np.partition(every, every.shape[1] - k, axis=1)[:, -k:] if every.shape[1] > k else every
            best[asked] = qi, qh, top
        for qi, qh, top in best.values():
            n = top.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, n)), pa.array(np.repeat(qh, n)), pa.array(top.ravel())], ["query_id", "qh", "lower"])

    return each


def _survivors(batches):
    """(query_id, qh, vec_id, h, upper) of the candidates whose upper bound reaches the query's limit."""
    for _, (qi, qh, limit), (ci, ch), _, upper, own in _blocks(batches):
        row, at = np.nonzero((upper >= limit[:, None]) & ~own)
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qi[row], qh[row], ci[at], ch[at], upper[row, at])], ["query_id", "qh", "vec_id", "h", "upper"])


def _score(batches):
    """(query_id, vec_id, score) of pairs (query_id, vec_id, query vector, vector)."""
    for b in batches:
        out = np.zeros(b.num_rows, dtype=np.int64)
        vectors = {d: (at, x) for d, at, x in _by_length(b, 3)}
        for d, at, q in _by_length(b, 2):
            out[at] = exact_scores(q, vectors[d][1])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, its k best other rows by inner product of the integer vectors."""
    spark = vectors.sparkSession
    arrow_limits(spark)
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    good = vectors.where(F.col(id_col).isNotNull() & usable(vector_col))
    columns = F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v")
    rows = good.select(*columns).select("i", F.xxhash64("v").alias("h"), "v")
    asked = written(good.where(queries).select(*columns).distinct().select("i", F.xxhash64("v").alias("h"), "v"))
    parts = max(1, math.ceil(asked.count() / QUERY_ROWS))
    cells = rows.mapInArrow(_cells, "d int, packed binary").withColumn("salt", F.pmod(F.xxhash64("packed"), F.lit(salts)).cast("int"))
    cells = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def pairs(limits: DataFrame) -> DataFrame:
        asking = limits.select(F.pmod(F.xxhash64("i", "h"), F.lit(parts)).cast("int").alias("part"), "i", "h", "v", "limit").mapInArrow(_queries, "part int, d int, asked binary")
        sent = asking.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return cells.join(sent.hint("shuffle_hash"), ["part", "salt", "d"]).select("d", "asked", "packed")

    def best(order: Column, name: str):
        return F.row_number().over(Window.partitionBy("query_id", "qh").orderBy(order, *(["vec_id", "h"] if name == "place" else []))).alias(name)

    none = F.lit(float("-inf"))
    lowest = pairs(asked.withColumn("limit", none)).mapInArrow(_limits(k), "query_id long, qh long, lower double")
    limit = lowest.select("query_id", "qh", "lower", best(F.desc("lower"), "r")).where(F.col("r") <= k)
    limit = limit.groupBy("query_id", "qh").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(none).alias("limit"))
    limit = limit.select(F.col("query_id").alias("i"), F.col("qh").alias("h"), "limit")
    limited = written(asked.join(limit, ["i", "h"], "left").select("i", "h", "v", F.coalesce("limit", none).alias("limit")))
    kept = written(pairs(limited).mapInArrow(_survivors, "query_id long, qh long, vec_id long, h long, upper double"))
    foremost = written(kept.select("*", best(F.desc("upper"), "place")).where(F.col("place") <= WAVE * k).drop("place"))
    read = may_be_in(rows, "i", id_filter(kept, "vec_id"), "hit").where("hit").dropDuplicates(["i", "h"]).select(F.col("i").alias("vec_id"), "h", "v")
    exact = written(read)
    asked = asked.select(F.col("i").alias("query_id"), F.col("h").alias("qh"), F.col("v").alias("q"))

    def scored(some: DataFrame) -> DataFrame:
        both = some.select("query_id", "qh", "vec_id", "h").join(exact, ["vec_id", "h"]).join(asked, ["query_id", "qh"])
        return both.select("query_id", "vec_id", "q", "v").mapInArrow(_score, "query_id long, vec_id long, score long")

    first = written(scored(foremost))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    certain = ranked.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    rest = kept.exceptAll(foremost).join(certain, "query_id").where(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
    every = first.unionByName(scored(rest))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
