"""State carried along all rows of a declared order, or along groups of any size, without a window over one partition.

Rows are range-partitioned by the order and written once, each with its block (range partition) and place in it. A *carry* is then a two-level scan: every block is summed up by an aggregation (sum, last non-missing
value, count; one row a block), the blocks before each block are combined, and rows add what comes before their block to what comes before them in it. RETAIN sums, counters and carried values, and the queue that LAG
and DIF read, are of this kind. A recurrence ``s = a * s + b``, held between bounds, is a map of s that is closed under composition: runs of rows are composed where they lie, the runs' maps are
applied one after the other in a stream that keeps one number for each group, and every row applies its own composed map to its run's start. So a group of any size takes the same few jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.stored import stored

RUN_ROWS = 4096
#: About the rows of a block; the number of blocks grows with the rows, so that no task sorts or buffers more than a few blocks.
BLOCK_ROWS = 250_000


@dataclass(frozen=True)
class Placed:
    """Rows with ``_p_`` (block) and ``_k_`` (place in the block, from 0), written once; reading them again draws no new boundaries."""

    rows: DataFrame


def placed(df: DataFrame, order: Sequence[str | Column]) -> Placed:
    full = -(-df.count() // BLOCK_ROWS)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), full)
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m_", F.monotonically_increasing_id())
    rows = stored(ranged.select(*df.columns, F.shiftright("_m_", 33).cast("int").alias("_p_"), F.col("_m_").bitwiseAND((1 << 33) - 1).alias("_k_")))
    return Placed(rows.withMetadata("_p_", {"tasks": min(parts, max(full, df.sparkSession.sparkContext.defaultParallelism))}))


@dataclass(frozen=True)
class Carry:
    """What a retained variable keeps: ``kind`` is sum (missing values skipped), strict (missing after one missing value) or last (the last value that isn't missing)."""

    kind: str
    value: Column
    start: Column | None = None


def _dealt(rows: DataFrame) -> DataFrame:
    """Placed rows with each block in one partition, in as many partitions as there are full blocks; once for several calls, which the metadata of ``_p_`` tell."""
    known = rows.schema["_p_"].metadata
    if known.get("dealt"):
        return rows
    return rows.repartition(known.get("tasks") or rows.select("_p_").distinct().count() or 1, "_p_").withMetadata("_p_", {"dealt": True})


def carried(rows: DataFrame, carries: dict[str, Carry]) -> DataFrame:
    """Adds retained variables to placed rows; all of them share one pass over the blocks and one window."""
    values = {f"_x{i}_": c.value for i, c in enumerate(carries.values())}
    rows = rows.withColumns(values)
    sums, folds, adds, ends = [], [], [], []
    inside = Window.partitionBy("_p_").orderBy("_k_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = Window.orderBy("_p_").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    for i, (name, c) in enumerate(carries.items()):
        x = F.col(f"_x{i}_")
        if c.kind == "last":
            # a block's last value is looked up at its place: max_by of text or structs would sort all rows that a task reads
            at = rows.where(x.isNotNull()).groupBy("_p_").agg(F.max("_k_").alias("_k_"))
            ends.append(rows.select("_p_", "_k_", x.alias(f"_s{i}_")).join(F.broadcast(at), ["_p_", "_k_"]).select("_p_", f"_s{i}_"))
            folds.append(F.last(f"_s{i}_", ignorenulls=True).over(blocks).alias(f"_s{i}_"))
            here = F.coalesce(F.last(x, ignorenulls=True).over(inside), F.col(f"_s{i}_"))
            adds.append((F.coalesce(here, c.start) if c.start is not None else here).alias(name))
        elif c.kind in ("sum", "strict"):
            sums += [F.sum(x).alias(f"_s{i}_"), F.count(F.when(x.isNull(), 1)).alias(f"_m{i}_")]
            folds += [F.coalesce(F.sum(f"_s{i}_").over(blocks), F.lit(0)).alias(f"_s{i}_"), F.coalesce(F.sum(f"_m{i}_").over(blocks), F.lit(0)).alias(f"_m{i}_")]
            total = F.coalesce(F.sum(x).over(inside), F.lit(0)) + F.col(f"_s{i}_")
            total = total + c.start if c.start is not None else total
            gaps = F.col(f"_m{i}_") + F.sum(x.isNull().cast("int")).over(inside)
            adds.append((total if c.kind == "sum" else F.when(gaps == 0, total)).alias(name))
        else:
            raise ValueError(c.kind)
    totals = rows.groupBy("_p_").agg(F.count("*").alias("_n_"), *sums)  # one row a block, as are the ends
    before = reduce(lambda a, b: a.join(F.broadcast(b), "_p_", "left"), ends, totals).select("_p_", *folds)
    keep = [c for c in rows.columns if c not in values and c not in carries]
    return _dealt(rows).join(F.broadcast(before), "_p_").select(*keep, *adds)


def queued(rows: DataFrame, name: str, x: Column, n: int = 1, reached: Column | None = None) -> DataFrame:
    """Adds what a queue of length ``n`` gives: the value of ``x`` ``n`` calls before, over the rows that reach the call (all without ``reached``), across groups and blocks.

    Inside a block it is a window; a block's first ``n`` calls take the last ``n`` calls of the blocks before, which are n rows a block. Rows that don't reach the call get null.
    """
    here = F.lit(True) if reached is None else F.coalesce(reached, F.lit(False))
    rows = _dealt(rows.withColumns({"_g_": here, "_x_": x}))
    w = Window.partitionBy("_p_", "_g_").orderBy("_k_")
    rows = rows.withColumns({"_i_": (F.row_number().over(w) - 1).cast("long"), "_l_": F.lag("_x_", n).over(w)})
    calls = rows.where("_g_").groupBy("_p_").agg(F.count("*").alias("_c_"))
    before = calls.select("_p_", "_c_", F.coalesce(F.sum("_c_").over(Window.orderBy("_p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b_"))  # one row a block
    known = rows.join(F.broadcast(before), "_p_", "left")
    tail = known.where(F.col("_g_") & (F.col("_i_") >= F.col("_c_") - n)).select((F.col("_b_") + F.col("_i_") + n).alias("_r_"), F.col("_x_").alias("_t_"))
    known = known.withColumn("_r_", F.when(F.col("_g_") & (F.col("_i_") < n), F.col("_b_") + F.col("_i_")))
    value = F.when(F.col("_g_"), F.when(F.col("_i_") < n, F.col("_t_")).otherwise(F.col("_l_")))
    keep = [c for c in rows.columns if c not in ("_g_", "_x_", "_i_", "_l_", name)]
    return known.join(F.broadcast(tail), "_r_", "left").select(*keep, value.alias(name))


# recurrences
def composed(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each row the composition of the maps s -> min(high, max(low, a * s + b)) from the row where ``first`` was last set; by doubling, so a run takes logarithmically many vector steps."""
    a, b, low, high = a.copy(), b.copy(), low.copy(), high.copy()
    start = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
    step = 1
    with np.errstate(invalid="ignore", over="ignore"):
        while step < len(a):
            at = np.flatnonzero(np.arange(len(a)) - step >= start)
            if not len(at):
                break
            p = at - step
            gain = a[at]

            def through(x, gain=gain, at=at):  # a bound of the earlier map, seen through the later one
                return np.where(gain == 0, b[at], gain * x + b[at])

            one, two = through(low[p]), through(high[p])
            new_low = np.clip(np.fmin(one, two), low[at], high[at])
            new_high = np.clip(np.fmax(one, two), low[at], high[at])
            new = gain * a[p], through(b[p]), new_low, new_high
            for array, value in zip((a, b, low, high), new, strict=True):
                array[at] = value
            step *= 2
    return a, b, low, high


def _runs(batches):
    """Adds (_run_, _end_, _a_, _b_, _lo_, _hi_) to sorted rows whose first columns are the group key's hash and the maps (a, b, low, high)."""
    run = 0
    for whole in batches:
        for at in range(0, whole.num_rows, RUN_ROWS):
            batch = whole.slice(at, RUN_ROWS)
            group = batch.column(0).to_numpy(zero_copy_only=False)
            maps = [np.array(batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=float) for i in range(1, 5)]
            missing = np.isnan(maps[0]) | np.isnan(maps[1])
            maps[2], maps[3] = np.where(np.isnan(maps[2]), -np.inf, maps[2]), np.where(np.isnan(maps[3]), np.inf, maps[3])
            first = np.concatenate(([True], group[1:] != group[:-1]))
            last = np.concatenate((first[1:], [True]))
            number = run + np.cumsum(first) - 1
            run = int(number[-1]) + 1
            a, b, low, high = composed(*[np.where(missing, np.nan, m) if i < 2 else m for i, m in enumerate(maps)], first)
            # once missing, missing to the end of the run and after it
            gone = np.isnan(a) | np.isnan(b)
            made = [pa.array(number), pa.array(last), *[pa.array(np.where(gone, np.nan, m)) for m in (a, b, low, high)]]
            yield pa.RecordBatch.from_arrays([*batch.columns[5:], *made], [*batch.schema.names[5:], "_run_", "_end_", "_a_", "_b_", "_lo_", "_hi_"])


def _starts(start: float):
    """(group, block, run, a, b, low, high) in order to (block, run, s): the state each run starts in."""

    def each(batches):
        key, s = object(), start
        for b in batches:
            out = []
            for group, block, run, a, x, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != key:
                    key, s = group, start
                out.append((block, run, s))
                s = s if s != s else min(high, max(low, a * s + x)) if a == a else float("nan")
            if out:
                p, r, v = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(r, pa.int64()), pa.array(v, pa.float64())], ["_q_", "_u_", "_s_"])

    return each


def bounded_recurrence(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], gain: Column, add: Column, out: str, start: float = 0.0, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """All rows with ``out``: s = min(high, max(low, gain * s + add)) along each group in order, from ``start``. A missing gain or add makes the rest of the group missing.

    A group may hold all rows: one write, one stream of run maps (a row for RUN_ROWS rows), one join on the run.
    """
    if out in df.columns:
        df = df.drop(out)
    own = df.columns
    none = F.lit(None).cast("double")
    maps = [gain.cast("double"), add.cast("double"), none if low is None else low.cast("double"), none if high is None else high.cast("double")]
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    rows = df.select(group.alias("_g_"), *[m.alias(f"_m{i}_") for i, m in enumerate(maps)], *own)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "_g_", *order).sortWithinPartitions("_g_", *order)
    ranged = ranged.select("_g_", *[f"_m{i}_" for i in range(4)], *own, F.col("_g_").alias("_key_"), F.spark_partition_id().alias("_blk_"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields[5:])
    runs = stored(ranged.mapInArrow(_runs, f"{kinds}, _run_ long, _end_ boolean, _a_ double, _b_ double, _lo_ double, _hi_ double"))
    ends = runs.where("_end_").select("_key_", "_blk_", "_run_", "_a_", "_b_", "_lo_", "_hi_")
    starts = ends.repartition("_key_").sortWithinPartitions("_key_", "_blk_", "_run_").mapInArrow(_starts(start), "_q_ int, _u_ long, _s_ double")
    s = F.least(F.col("_hi_"), F.greatest(F.col("_lo_"), F.col("_a_") * F.col("_s_") + F.col("_b_")))
    joined = runs.join(starts, (F.col("_blk_") == F.col("_q_")) & (F.col("_run_") == F.col("_u_")))
    gone = F.isnan("_s_") | F.isnan("_a_") | F.isnan("_b_")
    return joined.select(*own, F.when(~gone, s).alias(out))


def streamed(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], step: Callable[[object, dict], object], start: object, out: str, kind: str = "double") -> DataFrame:
    """Any recurrence: ``step(state, row)`` in Python along each group, for state that no map above describes. A group streams through one task, which keeps its state and one batch."""
    own = df.columns

    def each(batches):
        key, state = None, start
        for b in batches:
            found = []
            for row in b.to_pylist():
                if row["_g_"] != key:
                    key, state = row["_g_"], start
                state = step(state, row)
                found.append(state)
            if found:
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], pa.array(found)], [*own, out])

    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    lined = df.withColumn("_g_", group).repartition("_g_").sortWithinPartitions("_g_", *order)
    return lined.mapInArrow(each, f"{kinds}, {out} {kind}")
