"""DATA-step operators as DataFrame functions: statements, dataset options and order-sensitive state.

Row order exists only where a key is declared: every order-sensitive operator takes ``order`` (columns that make rows unique within
``by``). State within BY groups becomes window expressions over one (by, order) specification, so any number of retained variables
costs one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from batchloom.missing import col
from batchloom.stored import stored


def options(df: DataFrame, where: Column | str | None = None, keep: Sequence[str] = (), drop: Sequence[str] = (), rename: dict[str, str] | None = None, obs: int | None = None, firstobs: int | None = None, order: Sequence[str | Column] = ()) -> DataFrame:
    """Dataset options in their order: drop and keep, rename, where (new names), then rows firstobs to obs by the declared order."""
    if drop:
        df = df.drop(*drop)
    if keep:
        df = df.select(*keep)
    if rename:
        df = df.withColumnsRenamed(rename)
    if where is not None:
        df = df.where(where)
    if obs is not None or firstobs is not None:
        if not order:
            raise ValueError("OBS= and FIRSTOBS= need a declared order")
        df = df.orderBy(*order)
        if firstobs and firstobs > 1:
            df = df.offset(firstobs - 1)
        if obs is not None:
            df = df.limit(max(0, obs - max(firstobs or 1, 1) + 1))
    return df


def assign(df: DataFrame, **values: Column) -> DataFrame:
    """Assignments that do not depend on each other, in one projection."""
    return df.withColumns({k: col(v) for k, v in values.items()})


def choose(*branches: tuple[Column, object], otherwise=None) -> Column:
    """IF / ELSE IF / ELSE: the value of the first condition that holds."""
    out = None
    for cond, value in branches:
        out = F.when(cond, col(value)) if out is None else out.when(cond, col(value))
    return out.otherwise(col(otherwise))


def truncate(df: DataFrame, **lengths: int) -> DataFrame:
    """LENGTH of text variables."""
    return df.withColumns({k: F.substring(k, 1, n) for k, n in lengths.items()})


def labelled(df: DataFrame, **formats: str) -> DataFrame:
    """FORMAT statement: the format is kept as column metadata and applied on display only."""
    for name, fmt in formats.items():
        df = df.withMetadata(name, {"format": fmt})
    return df


def over_array(names: Sequence[str], f: Callable[[Column, int], Column]) -> dict[str, Column]:
    """ARRAY with a DO loop: f(column, index from 1) for each member, for ``withColumns``."""
    return {name: f(F.col(name), i) for i, name in enumerate(names, 1)}


def output_each(df: DataFrame, first: int, last: int | Column, name: str = "i") -> DataFrame:
    """DO i = first TO last; OUTPUT; END: a row for each step."""
    stop = col(last)
    return df.withColumn(name, F.explode(F.when(stop >= first, F.sequence(F.lit(first), stop.cast("int")))))


def outputs(df: DataFrame, **targets: Column) -> dict[str, DataFrame]:
    """Several output datasets of one step, by condition."""
    return {name: df.where(cond) for name, cond in targets.items()}


def call_missing(df: DataFrame, *names: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({n: F.lit(None).cast(kinds[n]) for n in names})


def concatenate(*frames: DataFrame) -> DataFrame:
    """SET a b: rows of all, columns by name, missing where a frame lacks one."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def interleave(frames: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """SET a b; BY k: rows of all in key order, equal keys in order of the frames."""
    tagged = [f.withColumn("_source_", F.lit(i)) for i, f in enumerate(frames)]
    return concatenate(*tagged).orderBy(*by, "_source_").drop("_source_")


#: Rows that ``recurrence`` folds at a time.
RUN_ROWS = 4096


def spec(by: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    if not order:
        raise ValueError("an order-sensitive operator needs a declared order")
    return Window.partitionBy(*by).orderBy(*order)


def running_sum(x: str | Column, w: WindowSpec, skip_missing: bool = True) -> Column:
    """Sum so far in the group. ``total + x`` skips missing values; ``total = total + x`` stays missing after one (skip_missing=False)."""
    x = F.col(x) if isinstance(x, str) else x
    rows = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.coalesce(F.sum(x).over(rows), F.lit(0))
    if skip_missing:
        return total
    return F.when(F.sum(x.isNull().cast("int")).over(rows) == 0, total)


def counter(w: WindowSpec) -> Column:
    return F.row_number().over(w).cast("long")


def carried_forward(x: str, w: WindowSpec) -> Column:
    """The last value so far that isn't missing."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def first_flag(by: Sequence[str], w: WindowSpec) -> Column:
    """FIRST.last-of-by: 1 where a new value of the by columns starts along w (w partitions by a prefix of them)."""
    before = [F.lag(c).over(w).eqNullSafe(F.col(c)) for c in by]
    same = F.row_number().over(w) > 1
    for b in before:
        same = same & b
    return (~same).cast("int")


def last_flag(by: Sequence[str], w: WindowSpec) -> Column:
    after = F.lead(F.lit(1)).over(w).isNotNull()
    for c in by:
        after = after & F.lead(c).over(w).eqNullSafe(F.col(c))
    return (~after).cast("int")


def lag(x: str, w: WindowSpec, n: int = 1) -> Column:
    return F.lag(x, n).over(w)


def dif(x: str, w: WindowSpec, n: int = 1) -> Column:
    return F.col(x) - F.lag(x, n).over(w)


def recurrence(df: DataFrame, by: Sequence[str], order: Sequence[str], inputs: Sequence[str], start: Column, step: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """General RETAIN: state = step(state, row) along each group, kept for every row.

    A group is cut into runs of RUN_ROWS rows by its order. Each pass folds one run of every group from the state the run before ended in, so a state
    array is copied at most RUN_ROWS times a row and no row holds more than one run; there are as many passes as the longest group has runs.
    """
    names = list(dict.fromkeys([*by, *order, *inputs]))
    rows = df.select(*names).withColumn("_run_", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / RUN_ROWS).cast("int"))
    row = F.struct(*order, *[i for i in inputs if i not in order])
    runs = rows.groupBy(*by, "_run_").agg(F.array_sort(F.collect_list(row)).alias("_rows_"))
    most = 0
    if df.take(1):
        runs = stored(runs)
        most = runs.agg(F.max("_run_")).first()[0]
    kind = df.select(start.alias("s")).schema["s"].dataType.simpleString()

    def fold(acc: Column, row: Column) -> Column:
        s = step(acc["s"], row)
        return F.struct(s.alias("s"), F.concat(acc["a"], F.array(s)).alias("a"))

    done, state = None, None
    for n in range(most + 1):
        now = runs.where(F.col("_run_") == n)
        if state is None:
            now = now.withColumn("_s_", start)
        else:
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by], F.lit(True))
            now = now.join(state, same).drop(*[f"_k_{k}" for k in by])
        first = F.struct(F.col("_s_").alias("s"), F.array().cast(f"array<{kind}>").alias("a"))
        folded = now.withColumn("_states_", F.aggregate("_rows_", first, fold, lambda acc: acc["a"]))
        folded = stored(folded) if most else folded
        state = folded.select(*[F.col(k).alias(f"_k_{k}") for k in by], F.element_at("_states_", -1).alias("_s_"))
        part = folded.select(*by, F.explode(F.arrays_zip("_rows_", "_states_")).alias("x")).select(*by, "x._rows_.*", F.col("x._states_").alias(out))
        done = part if done is None else done.unionByName(part)
    return done


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "_n_") -> DataFrame:
    """MONOTONIC() / _N_ by a declared order over all rows without a single-partition window.

    Rows are range-partitioned, sorted and written once with their place in the partition; the partitions are counted from what was written
    and offsets added. Written once, since range boundaries come from a sample: two runs could draw two different ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.columns
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m_", F.monotonically_increasing_id())
    placed = stored(ranged.select(*own, F.shiftright("_m_", 33).alias("_p_"), F.col("_m_").bitwiseAND((1 << 33) - 1).alias("_k_")))
    counts = placed.groupBy("_p_").agg(F.count("*").alias("_c_"))  # one row a partition
    before = counts.select("_p_", F.coalesce(F.sum("_c_").over(Window.orderBy("_p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b_"))
    return placed.join(F.broadcast(before), "_p_").select(*own, (F.col("_b_") + F.col("_k_") + 1).alias(name))
