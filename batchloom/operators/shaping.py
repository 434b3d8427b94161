"""SORT, TRANSPOSE, RANK and STANDARD as DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.operators.summaries import running_total


#: Most columns that TRANSPOSE makes.
ID_VALUES = 10_000


def keys(by: Sequence[str]) -> list[Column]:
    """Sort keys from names; ``-name`` is descending. Missing values are least."""
    return [F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_first() for k in by]


def sort(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.orderBy(*keys(by))


def _ranked(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    if not order:
        raise ValueError("NODUPKEY needs a declared order to say which row is first")
    plain = [k.lstrip("-") for k in by]
    return df.withColumn("_r_", F.row_number().over(Window.partitionBy(*plain).orderBy(*keys(order))))


def nodupkey(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key by the declared order."""
    return _ranked(df, by, order).where("_r_ = 1").drop("_r_")


def dupout(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows that ``nodupkey`` drops."""
    return _ranked(df, by, order).where("_r_ > 1").drop("_r_")


def noduprecs(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    return _ranked(df, by, order).where(F.col("_r_") <= k).drop("_r_")


def transpose(df: DataFrame, var: Sequence[str], by: Sequence[str] = (), id_: str | None = None, values: Sequence[object] | None = None, prefix: str = "", name: str = "_NAME_", order: Sequence[str] = (), let: bool = False, kind: str = "double") -> DataFrame:
    """PROC TRANSPOSE: a row for each BY group and variable, a column for each ID value (or COL1.. by the declared order without ID).

    ``values`` fixes the ID values; otherwise they are found by a distinct pass. An ID that repeats in a BY group raises at run time unless ``let``
    (then the last by ``order`` stays).
    """
    if id_ is None:
        if not order:
            raise ValueError("TRANSPOSE without ID needs a declared order")
        df = df.withColumn("_c_", F.row_number().over(Window.partitionBy(*by).orderBy(*keys(order))))
        id_, prefix = "_c_", prefix or "COL"
    if values is None:
        found = df.select(id_).where(F.col(id_).isNotNull()).distinct().limit(ID_VALUES + 1).collect()
        if len(found) > ID_VALUES:
            raise ValueError(f"TRANSPOSE would make more than {ID_VALUES} columns of {id_}")
        values = sorted(r[0] for r in found)
    last: list[str] = []
    if let:  # the last row by order stays; a descending key counts backwards
        kinds = dict(df.dtypes)
        for i, o in enumerate(order):
            plain = o.lstrip("-")
            if o.startswith("-") and kinds[plain] == "string":
                raise ValueError("LET needs an order without descending text")
            backwards = kinds[plain] in ("date", "timestamp")
            x = F.unix_micros(F.col(plain).cast("timestamp")) if o.startswith("-") and backwards else F.col(plain)
            df = df.withColumn(f"_o{i}_", -x if o.startswith("-") else x)
            last.append(f"_o{i}_")
    long = df.select(*by, id_, *[F.col(v).cast(kind) for v in var], *last)
    long = long.unpivot([c for c in long.columns if c not in var], list(var), name, "_v_")

    def cell(v: object) -> Column:
        here = F.col(id_) == v
        if let:
            return F.max_by(F.when(here, F.col("_v_")), F.when(here, F.struct(*last))) if last else F.max(F.when(here, F.col("_v_")))
        return F.when(F.count(F.when(here, 1)) > 1, F.raise_error(F.lit(f"ID value {v} occurs twice in a BY group")).cast(kind)).otherwise(F.max(F.when(here, F.col("_v_"))))

    return long.groupBy(*by, name).agg(*[cell(v).alias(f"{prefix}{v}") for v in values])


def stack(df: DataFrame, ids: Sequence[str], var: Sequence[str], name: str = "_NAME_", value: str = "COL1") -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(var), name, value)


def rank(df: DataFrame, var: str, out: str, by: Sequence[str] = (), descending: bool = False, ties: str = "MEAN", groups: int | None = None) -> DataFrame:
    """PROC RANK: ties get their MEAN, LOW, HIGH or DENSE rank; GROUPS=k gives floor(rank * k / (n + 1)). Missing values get no rank."""
    if not by:
        return _rank_all(df, var, out, descending, ties.upper(), groups)
    key = F.col(var).desc() if descending else F.col(var).asc()
    part = [*by, F.col(var).isNull()]
    low = F.rank().over(Window.partitionBy(*part).orderBy(key)).cast("double")
    same = F.count("*").over(Window.partitionBy(*part, var))
    value = {"LOW": low, "HIGH": low + same - 1, "MEAN": low + (same - 1) / 2, "DENSE": F.dense_rank().over(Window.partitionBy(*part).orderBy(key)).cast("double")}[ties.upper()]
    if groups:
        value = F.floor(value * groups / (F.count(var).over(Window.partitionBy(*part)) + 1)).cast("double")
    return df.withColumn(out, F.when(F.col(var).isNotNull(), value))


def _rank_all(df: DataFrame, var: str, out: str, descending: bool, ties: str, groups: int | None) -> DataFrame:
    """Ranks over all rows: rows are counted by value, the counts summed in order over range partitions, and joined back."""
    counts = df.where(F.col(var).isNotNull()).groupBy(F.col(var).alias("_v_")).agg(F.count("*").alias("_c_"))
    counts = running_total(counts.withColumn("_one_", F.lit(1)), "_v_", "_c_", "_upto_")
    counts = running_total(counts, "_v_", "_one_", "_place_")
    total = counts.agg(F.max("_upto_").alias("_n_"), F.max("_place_").alias("_k_"))  # one row
    counts = counts.join(F.broadcast(total))
    low = F.col("_n_") - F.col("_upto_") + 1 if descending else F.col("_upto_") - F.col("_c_") + 1
    dense = F.col("_k_") - F.col("_place_") + 1 if descending else F.col("_place_")
    low, same = low.cast("double"), F.col("_c_")
    value = {"LOW": low, "HIGH": low + same - 1, "MEAN": low + (same - 1) / 2, "DENSE": dense.cast("double")}[ties]
    if groups:
        value = F.floor(value * groups / (F.col("_n_") + 1)).cast("double")
    ranks = counts.select("_v_", value.alias("_rank_"))
    return df.join(ranks, F.col(var) == F.col("_v_"), "left").select(*[F.col(c) for c in df.columns if c != out], F.col("_rank_").alias(out))


def standardize(df: DataFrame, var: Sequence[str], by: Sequence[str] = (), mean: float = 0.0, std: float = 1.0) -> DataFrame:
    """PROC STANDARD: values scaled to a mean and standard deviation. The statistics are aggregated first and joined, so no row order or single partition is needed."""
    stats = [F.avg(v).alias(f"_m_{v}") for v in var] + [F.stddev_samp(v).alias(f"_s_{v}") for v in var]
    if by:
        w = Window.partitionBy(*by)
        scaled = {v: F.try_divide(F.col(v) - F.avg(v).over(w), F.stddev_samp(v).over(w)) * std + mean for v in var}
        return df.withColumns(scaled)
    out = df.join(F.broadcast(df.agg(*stats)))  # one row
    return out.withColumns({v: F.try_divide(F.col(v) - F.col(f"_m_{v}"), F.col(f"_s_{v}")) * std + mean for v in var}).select(*df.columns)
