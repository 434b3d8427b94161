"""Exact order statistics by refinement: quantiles, modes and extremes without a buffer that grows with a group.

A number is mapped to a 64-bit integer in the same order (sign, exponent and mantissa, by arithmetic). A first pass counts each group's numbers by the upper 16 bits; the counts, summed in order, say
which bins hold the wanted ranks. Only those bins are counted by 16 bits more, and so on, until a bin is one number: four histograms whatever the data, for all variables and quantiles of a
call at once. Where every wanted bin holds at most as many numbers as a histogram has bins, they are listed and the rest of the histograms is left out. A bin's counts are combined before they are shuffled, and no window holds more than the 65,536 bins of one prefix. After 32 bits the numbers left are few or equal;
they are written once with their counts, so that the last two passes don't read the source again.

Missing numbers (null, NaN) take no part. A group without numbers has no row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.stored import stored

LEVELS = (48, 32, 16, 0)  # bits that a bin leaves out
_STEP = 16
BIN_NUMBERS = 1 << _STEP
_MANTISSA = 1 << 52


def with_key(df: DataFrame, x: str, key: str) -> DataFrame:
    """Adds the integer of a double column that has the order of the numbers; both zeros are 0."""
    a = F.abs(F.col(x))
    guess = F.when(a >= F.lit(2.0**-1022), F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(F.least(a, F.lit(1.7976931348623157e308)))).cast("int"))))
    df = df.withColumn("_guess_", guess)
    e = F.col("_guess_")
    # the logarithm is rounded: the power of two decides
    df = df.withColumn("_exp_", e + F.when(a >= F.pow(F.lit(2.0), e + 1), 1).otherwise(0) - F.when(a < F.pow(F.lit(2.0), e), 1).otherwise(0))
    e = F.col("_exp_")
    mantissa = ((a / F.pow(F.lit(2.0), e) - 1) * float(_MANTISSA)).cast("long")
    size = F.when(a == float("inf"), F.lit(2047 << 52)).when(e.isNull(), (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")).otherwise((e + 1023).cast("long") * _MANTISSA + mantissa)
    return df.withColumn(key, F.when(F.col(x) < 0, -size).otherwise(size)).drop("_guess_", "_exp_")


def value_of(key: Column) -> Column:
    """The number of an integer that ``with_key`` made."""
    size = F.abs(key)
    e, m = F.shiftright(size, 52), size.bitwiseAND(_MANTISSA - 1)
    number = F.when(e == 2047, F.lit(float("inf"))).when(e == 0, m.cast("double") * F.lit(2.0**-537) * F.lit(2.0**-537)).otherwise((m / float(_MANTISSA) + 1) * F.pow(F.lit(2.0), (e - 1023).cast("double")))
    return F.when(key < 0, -number).otherwise(number)


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def long_numbers(df: DataFrame, var: Sequence[str], by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(g0.., v, x): each row's numbers, one a row, v the variable's place."""
    g = [f"g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(n) for b, n in zip(by, g, strict=True)], F.posexplode(F.array(*[F.col(v).cast("double") for v in var])).alias("v", "x"))
    return rows.where(F.col("x").isNotNull() & ~F.isnan("x")), g


def quantiles(df: DataFrame, var: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by.., v, values): for each group and variable (its place in ``var``) the array of exact quantiles, interpolated between neighbouring ranks at p * (n - 1)."""
    rows, g = long_numbers(df, var, by)
    rows = with_key(rows, "x", "key").select(*g, "v", "key")
    place = [*g, "v"]

    def histogram(source: DataFrame, level: int, count: Column) -> DataFrame:
        """(place, up, bin, c, upto): counts of the bins of a level, summed in order within their bin of the level before."""
        counted = source.groupBy(*place, F.shiftright("key", LEVELS[level]).alias("bin")).agg(count.alias("c"))
        counted = counted.withColumn("up", F.shiftright("bin", _STEP) if level else F.lit(0).cast("long"))
        w = Window.partitionBy(*place, "up").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counted.withColumn("upto", F.sum("c").over(w))

    first = histogram(rows, 0, F.count("*")).withColumn("n", F.sum("c").over(Window.partitionBy(*place)))
    at = [p * (F.col("n") - 1) for p in probs]
    ranks = F.array(*[F.struct(F.lit(j).alias("p"), F.lit(side).alias("side"), (F.ceil(x) if side else F.floor(x)).cast("long").alias("rank"), x.alias("at")) for j, x in enumerate(at) for side in (0, 1)])
    held = F.filter(ranks, lambda r: (r["rank"] >= F.col("upto") - F.col("c")) & (r["rank"] < F.col("upto")))
    state = first.select(*place, "bin", "c", (F.col("upto") - F.col("c")).alias("before"), F.explode(held).alias("r"))
    state = stored(state.select(*place, "bin", "c", "r.p", "r.side", "r.at", (F.col("r.rank") - F.col("before")).alias("rest")))
    names = [f"s_{x}" for x in (*place, "bin")]
    left, count = rows, F.count("*")
    for level in range(1, len(LEVELS)):
        wanted = state.select(*place, "bin").distinct().toDF(*names)
        wanted = wanted if by else F.broadcast(wanted)  # without groups: a row for each variable and rank
        inside = left.withColumn("b", F.shiftright("key", LEVELS[level - 1])).join(wanted, _same([*place, "b"], names)).drop("b", *names)
        if (state.agg(F.max("c")).first()[0] or 0) <= BIN_NUMBERS:  # every wanted bin is as short as a histogram
            k = F.col("k") if level > 2 else F.lit(1).cast("long")
            listed = inside.groupBy(*place, F.shiftright("key", LEVELS[level - 1]).alias("bin")).agg(F.array_sort(F.collect_list(F.struct("key", k.alias("k")))).alias("list")).toDF(*names, "list")
            at = F.aggregate("list", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("key")), lambda u, e: F.when(u["n"] > F.col("rest"), u).otherwise(F.struct((u["n"] + e["k"]).alias("n"), e["key"].alias("key"))), lambda u: u["key"])
            picked = F.get("list", F.col("rest").cast("int"))["key"] if level <= 2 else at
            state = state.join(listed, _same([*place, "bin"], names)).select(*place, picked.alias("bin"), "p", "side", "at")
            break
        if level == 2:
            left = inside = stored(inside.groupBy(*place, "key").agg(F.count("*").alias("k")))
            count = F.sum("k")
        finer = histogram(inside, level, count)
        finer = finer.select(*[F.col(c).alias(f"s_{c}") for c in place], F.col("up").alias("s_bin"), F.col("bin").alias("finer"), F.col("c").alias("n_finer"), "upto")
        begins = F.col("upto") - F.col("n_finer")
        state = state.join(finer, _same([*place, "bin"], names)).where((F.col("rest") >= begins) & (F.col("rest") < F.col("upto")))
        state = stored(state.select(*place, F.col("finer").alias("bin"), F.col("n_finer").alias("c"), "p", "side", "at", (F.col("rest") - begins).alias("rest")))
    value = value_of(F.col("bin"))
    low, high = F.max(F.when(F.col("side") == 0, value)), F.max(F.when(F.col("side") == 1, value))
    share = F.max(F.col("at") - F.floor("at"))
    one = state.groupBy(*place, "p").agg(F.when(share == 0, low).otherwise(low * (1 - share) + high * share).alias("q"))
    out = one.groupBy(*place).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "q"))), lambda s: s["q"]).alias("values"))  # one entry a quantile
    return out.toDF(*by, "v", "values")


def modes(df: DataFrame, var: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by.., v, mode): the most frequent number of each group and variable, the least of equals."""
    rows, g = long_numbers(df, var, by)
    counts = rows.groupBy(*g, "v", "x").agg(F.count("*").alias("c"))
    return counts.groupBy(*g, "v").agg(F.max_by("x", F.struct("c", -F.col("x"))).alias("mode")).toDF(*by, "v", "mode")


def extremes(df: DataFrame, var: Sequence[str], k: int = 5, by: Sequence[str] = (), id_: Sequence[str] = ()) -> DataFrame:
    """(by.., v, side, place, value, id..): the k least (side LOW) and greatest (HIGH) observations of each group and variable. Ties go by the id columns.

    Each partition keeps its own first k of a group before anything is shuffled.
    """
    rows, g = long_numbers(df.select(*by, *id_, *var), var, [*by, *id_])
    names = [f"i{i}" for i in range(len(id_))]
    rows = rows.toDF(*g[: len(by)], *names, "v", "x")
    part = [*g[: len(by)], "v"]
    out = None
    for side, order in (("LOW", [F.asc("x"), *names]), ("HIGH", [F.desc("x"), *names])):
        ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("place") <= k)
        ranked = ranked.select(*part, F.lit(side).alias("side"), "place", F.col("x").alias("value"), *names)
        out = ranked if out is None else out.unionByName(ranked)
    return out.toDF(*by, "v", "side", "place", "value", *id_)
