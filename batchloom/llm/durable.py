"""Cutting lineage, and connected components.

``written`` stores a frame as Parquet in the shared folder named by ``spark.checkpoint.dir`` and reads it back: lost executors then cost a
re-read, not a recomputation. Where the setting is absent, a folder below the warehouse is used on a local master; any other master raises.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.stored import remove, stored


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of frames that ``written`` made, once nothing reads them any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, path)


written = stored


LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
FOREST_LINKS = 1_000_000


@dataclass(frozen=True)
class IdFilter:
    """A bit set that holds all of some ids (and by chance others), as rows of (f_word, f_bits)."""

    rows: DataFrame
    bits: int


def id_filter(ids: DataFrame, id_col: str) -> IdFilter:
    """A bit set with 16 bits for each id, from LEAST_BITS to MOST_BITS (2 million rows of 12 bytes); beyond 2^27 ids it rules out fewer and fewer."""
    size = max(LEAST_BITS, min(MOST_BITS, 1 << (16 * ids.count()).bit_length()))
    x = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(size))
    bits = ids.select(x.alias("x")).select(F.shiftright("x", 6).cast("int").alias("f_word"), F.expr("shiftleft(1L, cast(x % 64 as int))").alias("b"))
    return IdFilter(written(bits.groupBy("f_word").agg(F.bit_or("b").alias("f_bits"))), size)


def may_be_in(df: DataFrame, id_col: str, found: IdFilter, flag: str) -> DataFrame:
    """``df`` with a boolean column that is true for every id in the filter. The filter is broadcast; its size is bounded."""
    x = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(found.bits))
    seen = df.withColumns({"f_x": x}).withColumn("f_word", F.shiftright("f_x", 6).cast("int")).join(F.broadcast(found.rows), "f_word", "left")
    hit = F.coalesce(F.expr("(shiftrightunsigned(f_bits, cast(f_x % 64 as int)) & 1L) = 1L"), F.lit(False))
    return seen.withColumn(flag, hit).drop("f_x", "f_word", "f_bits")


def without_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is not among ``ids`` (one column); rows with a null id stay. Only rows that the bit set cannot rule out are shuffled."""
    ids = written(ids.toDF("gone").where("gone is not null").distinct())
    names = [f"c{i}" for i in range(len(df.columns))]
    key = names[df.columns.index(id_col)]
    seen = may_be_in(df.toDF(*names), key, id_filter(ids, "gone"), "f_hit")
    checked = seen.where("f_hit").join(ids, F.col(key) == F.col("gone"), "left_anti")
    return seen.where("not f_hit").unionByName(checked).select(*names).toDF(*df.columns)


def _forest(batches):
    """A spanning forest of each run of up to FOREST_LINKS links; connected components stay the same."""

    def reduced(a: list[int], b: list[int]) -> pa.RecordBatch:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        u, v = [], []
        for x, y in zip(a, b, strict=True):
            if (rx := find(x)) != (ry := find(y)):
                root[max(rx, ry)] = min(rx, ry)
                u.append(x)
                v.append(y)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    a: list[int] = []
    b: list[int] = []
    for batch in batches:
        a += batch.column(0).to_pylist()
        b += batch.column(1).to_pylist()
        if len(a) >= FOREST_LINKS:
            yield reduced(a, b)
            a, b = [], []
    yield reduced(a, b)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id reachable from each id that has a link. Nothing but a count per round reaches the driver.

    Links that repeat a connection inside a task go first. Each round draws a random order (a hash), points every node at its first
    neighbour in that order, follows the pointers one step, and contracts the links to what the ends point at. A constant part of the nodes
    goes each round whatever the shape (stars, chains), so links shrink geometrically. Joins are equi-joins that adaptive execution can
    split; minima combine before they are shuffled.
    """
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = written(edges.mapInArrow(_forest, "u long, v long").distinct())
    steps: list[DataFrame] = []
    while edges.limit(1).count() or not steps:

        def place(x: str, n: int = len(steps)):
            return F.struct(F.xxhash64(F.col(x), F.lit(n)).alias("h"), F.col(x).alias("x"))

        both = edges.union(edges.select("v", "u"))
        to = both.groupBy("u").agg(F.min(place("v")).alias("m")).select(F.col("u").alias("id"), F.least(place("u"), F.col("m"))["x"].alias("p"))
        up = to.select(F.col("id").alias("p"), F.col("p").alias("q"))
        to = written(to.join(up, "p").select("id", F.col("q").alias("p")))
        steps.append(to)
        ends = edges.join(to.select(F.col("id").alias("u"), F.col("p").alias("pu")), "u").join(to.select(F.col("id").alias("v"), F.col("p").alias("pv")), "v")
        edges = written(ends.select(F.col("pu").alias("u"), F.col("pv").alias("v")).where("u <> v").mapInArrow(_forest, "u long, v long").distinct())
    label = steps[0]
    for step in steps[1:]:
        label = label.join(step.select(F.col("id").alias("p"), F.col("p").alias("q")), "p", "left").select("id", F.coalesce("q", "p").alias("p"))
    label = written(label)
    return label.join(label.groupBy("p").agg(F.min("id").alias("component")), "p").select("id", "component")
