"""MEANS/SUMMARY, FREQ, REPORT and TABULATE as DataFrame functions."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.operators import orderstats
from batchloom.stored import stored


def _percentile(p: float):
    return lambda x: F.percentile(x, F.lit(p))


def _skewness(x: Column) -> Column:
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def _kurtosis(x: Column) -> Column:
    n = F.count(x)
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))


#: Statistics by keyword. All ignore missing values; sums of squares are corrected (CSS) or not (USS).
STATISTICS = {
    "N": F.count, "NMISS": lambda x: F.count(F.when(x.isNull(), 1)), "SUM": F.sum, "MEAN": F.avg, "STD": F.stddev_samp, "VAR": F.var_samp, "MIN": F.min, "MAX": F.max,
    "RANGE": lambda x: F.max(x) - F.min(x), "USS": lambda x: F.sum(x * x), "CSS": lambda x: F.var_pop(x) * F.count(x), "CV": lambda x: F.try_divide(F.stddev_samp(x) * 100, F.avg(x)),
    "STDERR": lambda x: F.stddev_samp(x) / F.sqrt(F.nullif(F.count(x), F.lit(0))), "MEDIAN": _percentile(0.5), "Q1": _percentile(0.25), "Q3": _percentile(0.75), "MODE": lambda x: F.mode(x, True),
    "QRANGE": lambda x: F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25)), "SKEW": _skewness, "SKEWNESS": _skewness, "KURT": _kurtosis, "KURTOSIS": _kurtosis,
    **{f"P{p}": _percentile(p / 100) for p in (1, 5, 10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90, 95, 99)},
}


#: Statistics by rank: the quantiles that each is made of. MEANS and UNIVARIATE take them from ``orderstats``; the columns above serve cells of reports.
QUANTILES = {"MEDIAN": (0.5,), "Q1": (0.25,), "Q3": (0.75,), "QRANGE": (0.25, 0.75), **{f"P{p}": (p / 100,) for p in (1, 5, 10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90, 95, 99)}}
BY_RANK = (*QUANTILES, "MODE")


def by_rank(df: DataFrame, wanted: Sequence[tuple[str, str, str]], by: Sequence[str]) -> DataFrame:
    """(by.., names): statistics (keyword, variable, name) that need ranks, of all groups in one run."""
    var = list(dict.fromkeys(v for _, v, _ in wanted))
    probs = sorted({p for k, _, _ in wanted for p in QUANTILES.get(k, ())})
    out = None
    if probs:
        found = orderstats.quantiles(df, var, probs, by)

        def value(v: str, p: float) -> Column:
            return F.max(F.when(F.col("v") == var.index(v), F.get("values", F.lit(probs.index(p)))))

        cells = [((value(v, QUANTILES[k][-1]) - value(v, QUANTILES[k][0])) if k == "QRANGE" else value(v, QUANTILES[k][0])).alias(name) for k, v, name in wanted if k in QUANTILES]
        out = found.groupBy(*by).agg(*cells)
    if any(k == "MODE" for k, _, _ in wanted):
        cells = [F.max(F.when(F.col("v") == var.index(v), F.col("mode"))).alias(name) for k, v, name in wanted if k == "MODE"]
        most = orderstats.modes(df, var, by).groupBy(*by).agg(*cells)
        out = most if out is None else beside(out, most, by)
    return out


def beside(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join on key columns where missing equals missing; without keys the right side is one row."""
    if not by:
        return left.join(F.broadcast(right), how="left")
    names = [f"_k{i}_" for i in range(len(by))]
    right = right.withColumnsRenamed(dict(zip(by, names, strict=True)))
    return left.join(right, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)]), "left").drop(*names)


#: Statistics that WEIGHT and FREQ variables change, from x, its weight and its count; MIN, MAX, RANGE stay as they are.
WEIGHTED = ("N", "NMISS", "SUM", "SUMWGT", "MEAN", "USS", "CSS", "VAR", "STD", "CV", "MIN", "MAX", "RANGE")


def weighted(keyword: str, v: str, weight: str | None, count: str | None) -> Column:
    """A statistic of ``v`` with a weight and a count for each row."""
    if keyword not in WEIGHTED:
        raise ValueError(f"{keyword} with WEIGHT or FREQ")
    x = F.col(v).cast("double")
    f = F.floor(count).cast("double") if count else F.lit(1.0)
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    here = F.when(x.isNotNull(), f)
    n, total, sums, squares = F.sum(here), F.sum(here * w), F.sum(f * w * x), F.sum(f * w * x * x)
    css = squares - F.try_divide(sums * sums, total)
    var = F.when(n > 1, css / (n - 1))
    made = {"N": n.cast("long"), "NMISS": F.sum(F.when(x.isNull(), f).otherwise(0)).cast("long"), "SUM": sums, "SUMWGT": total, "MEAN": F.try_divide(sums, total), "USS": squares, "CSS": css, "VAR": var, "STD": F.sqrt(var), "CV": F.try_divide(F.sqrt(var) * 100, F.try_divide(sums, total))}
    return made[keyword] if keyword in made else STATISTICS[keyword](F.col(v))


def means(df: DataFrame, var: Sequence[str], stats: dict[str, Sequence[str] | str | None] | Sequence[str], by_class: Sequence[str] = (), nway: bool = True, types: Sequence[Sequence[str]] | None = None, missing: bool = False, freq: str | None = "_FREQ_", type_: str | None = "_TYPE_", by: Sequence[str] = (), weight: str | None = None, count: str | None = None) -> DataFrame:
    """PROC MEANS / SUMMARY with OUTPUT.

    ``stats`` maps a keyword to output names, one for each variable (a text with ``{}`` is filled with the variable; None gives
    ``var_KEYWORD``). Without ``nway`` every subset of the class variables is summarised, or those in ``types``. ``_TYPE_`` has a bit for each
    class variable, the first one highest. Rows with a missing class value are left out unless ``missing``. ``by`` groups stand beside the
    class variables and are part of every row. ``count`` names a FREQ variable (a row counts that often; below 1 or missing: not at all),
    ``weight`` a WEIGHT variable (below 0 or missing counts as 0); both only with the statistics in WEIGHTED.
    """
    if not isinstance(stats, dict):
        stats = dict.fromkeys(stats)
    asked: list[tuple[str, str, str]] = []
    for keyword, names in stats.items():
        names = [f"{v}_{keyword.lower()}" for v in var] if names is None else [names.format(v) for v in var] if isinstance(names, str) else list(names)
        asked += [(keyword.upper(), v, name) for v, name in zip(var, names, strict=False)]
    return named_means(df, asked, by_class, nway, types, missing, freq, type_, by, weight, count)


def named_means(df: DataFrame, asked: Sequence[tuple[str, str, str]], by_class: Sequence[str] = (), nway: bool = True, types: Sequence[Sequence[str]] | None = None, missing: bool = False, freq: str | None = "_FREQ_", type_: str | None = "_TYPE_", by: Sequence[str] = (), weight: str | None = None, count: str | None = None) -> DataFrame:
    """``means`` of single statistics (keyword, variable, output name)."""
    if by_class and not missing:
        df = df.dropna(subset=list(by_class))
    ranked = [] if weight or count else [a for a in asked if a[0] in BY_RANK]
    aggs = [(weighted(k, v, weight, count) if weight or count else STATISTICS[k](F.col(v))).alias(name) for k, v, name in asked if (k, v, name) not in ranked]
    if count:
        df = df.where(F.col(count) >= 1)
    if freq:
        aggs.append((F.sum(F.floor(count)) if count else F.count("*")).cast("long").alias(freq))
    k = len(by_class)
    every = (1 << k) - 1
    whole = [*by, *by_class]
    if nway or not by_class:
        out = df.groupBy(*whole).agg(*(aggs or [F.count("*").alias("_rows_")])).drop("_rows_")
        out = beside(out, by_rank(df, ranked, whole), whole) if ranked else out
        out = out.withColumn(type_, F.lit(every).cast("long")) if type_ else out
    else:
        level = (F.lit(every) - F.grouping_id()).cast("long").alias("_level_")
        types = types if types is not None else [c for n in range(k + 1) for c in itertools.combinations(by_class, n)]
        cols = [F.col(c) for c in whole]  # the by columns are in every set, so their bits of the grouping id are 0
        out = df.groupingSets([[F.col(c) for c in (*by, *t)] for t in types], *cols).agg(level, *aggs)
        if ranked:  # each row once for each set of class variables, as for the other statistics
            kinds = dict(df.dtypes)
            sets = [F.struct(F.lit(sum(1 << (k - 1 - i) for i, c in enumerate(by_class) if c in t)).cast("long").alias("_level_"), *[(F.col(c) if c in t else F.lit(None).cast(kinds[c])).alias(c) for c in by_class]) for t in types]
            vars_ = list(dict.fromkeys(v for _, v, _ in ranked))
            rows = df.select(*by, *[F.col(v).alias(f"_v{i}_") for i, v in enumerate(vars_)], F.explode(F.array(*sets)).alias("_s_")).select(*by, "_s_.*", *[f"_v{i}_" for i in range(len(vars_))])
            out = beside(out, by_rank(rows, [(s, f"_v{vars_.index(v)}_", name) for s, v, name in ranked], [*whole, "_level_"]), [*whole, "_level_"])
        out = out.withColumnRenamed("_level_", type_) if type_ else out.drop("_level_")
    names = [*([] if nway or not by_class else [type_] if type_ else []), *[name for _, _, name in asked], *([freq] if freq else []), *([type_] if type_ and (nway or not by_class) else [])]
    return out.select(*whole, *names) if whole or names else out


def remerged(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Group statistics beside every detail row, without a join."""
    w = Window.partitionBy(*by)
    return df.withColumns({k: v.over(w) for k, v in aggregates.items()})


def _count(weight: str | None) -> Column:
    return F.sum(weight) if weight else F.count("*")


def _with_totals(df: DataFrame, by: Sequence[str], **sums: tuple[str, ...]) -> DataFrame:
    """Sums of COUNT by groups beside each row. Totals are aggregated (partial sums first) and joined, so no window holds all rows."""
    for name, keys in sums.items():
        keys = (*by, *keys)
        total = df.groupBy(*keys).agg(F.sum("COUNT").alias(name))
        if keys:
            total = total.toDF(*[f"_k{i}_" for i in range(len(keys))], name)
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}_")) for i, c in enumerate(keys)])
            df = df.join(total, same).drop(*[f"_k{i}_" for i in range(len(keys))])
        else:
            df = df.join(F.broadcast(total))  # one row
    return df


def running_total(df: DataFrame, column: str, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of ``value`` so far in order of ``column``. Without groups the rows are range-partitioned, and the sums of the partitions before are added."""
    if by:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(parts, F.col(column).asc_nulls_first()).withColumn("_p_", F.spark_partition_id()))
    sums = placed.groupBy("_p_").agg(F.sum(value).alias("_s_"))  # one row a partition
    before = sums.select("_p_", F.coalesce(F.sum("_s_").over(Window.orderBy("_p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b_"))
    inside = placed.withColumn("_i_", F.sum(value).over(Window.partitionBy("_p_").orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return inside.join(F.broadcast(before), "_p_").withColumn(out, F.col("_b_") + F.col("_i_")).drop("_p_", "_i_", "_b_")


def frequencies(df: DataFrame, column: str, cumulative: bool = True, missing: bool = False, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One-way table: COUNT (with ``weight`` its sum), PERCENT and, unless NOCUM, CUM_FREQ and CUM_PCT in order of the values, in each group of ``by``."""
    if not missing:
        df = df.where(F.col(column).isNotNull())
    out = _with_totals(df.groupBy(*by, column).agg(_count(weight).alias("COUNT")), by, _t_=())
    out = out.withColumn("PERCENT", F.try_divide(F.col("COUNT") * 100, F.col("_t_")))
    if cumulative:
        out = running_total(out, column, "COUNT", "CUM_FREQ", by)
        out = out.withColumn("CUM_PCT", F.try_divide(F.col("CUM_FREQ") * 100, F.col("_t_")))
    return out.drop("_t_")


def nway_frequencies(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """TABLES a*b*c: COUNT and PERCENT of the total of each combination that occurs."""
    df = df.dropna(subset=list(columns))
    out = _with_totals(df.groupBy(*by, *columns).agg(_count(weight).alias("COUNT")), by, _t_=())
    return out.withColumn("PERCENT", F.try_divide(F.col("COUNT") * 100, F.col("_t_"))).drop("_t_")


def crosstab(df: DataFrame, rows: str, cols: str, sparse: bool = False, percents: bool = True, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Two-way table: COUNT and percents of the total, the row and the column. ``sparse`` adds cells without observations."""
    df = df.where(F.col(rows).isNotNull() & F.col(cols).isNotNull())
    out = df.groupBy(*by, rows, cols).agg(_count(weight).alias("COUNT"))
    if sparse:  # the values of two class variables, each distinct
        if by:
            raise ValueError("SPARSE with BY groups")
        out = stored(out)
        one, other = out.select(rows).distinct(), out.select(cols).distinct()
        if one.count() * other.count() > TABLE_CELLS:
            raise ValueError(f"SPARSE would make more than {TABLE_CELLS} cells of {rows} and {cols}")
        every = one.crossJoin(other)
        out = every.join(out, [rows, cols], "left").fillna(0, ["COUNT"])
    if percents:
        out = _with_totals(out, by, _t_=(), _r_=(rows,), _c_=(cols,))
        out = out.withColumns({k: F.try_divide(F.col("COUNT") * 100, F.col(v)) for k, v in (("PERCENT", "_t_"), ("PCT_ROW", "_r_"), ("PCT_COL", "_c_"))}).drop("_t_", "_r_", "_c_")
    return out


def chi_square(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """CHISQ of a two-way table: N, DF, CHISQ, PHI, CONTINGENCY and CRAMER_V, in one row. From the cells that occur and the margins: cells without observations add nothing to the sum of O * O / E."""
    cells = _with_totals(crosstab(df, rows, cols, percents=False), (), _n_=(), _r_=(rows,), _c_=(cols,))
    share = F.try_divide(F.col("COUNT").cast("double") * F.col("COUNT"), F.col("_r_").cast("double") * F.col("_c_"))
    out = cells.agg((F.max("_n_") * (F.sum(share) - 1)).alias("CHISQ"), F.max("_n_").alias("N"), F.countDistinct(rows).alias("r"), F.countDistinct(cols).alias("c"))
    out = out.withColumn("CHISQ", F.greatest(F.col("CHISQ"), F.when(F.col("CHISQ").isNotNull(), 0.0)))
    phi = F.sqrt(F.try_divide(F.col("CHISQ"), F.col("N")))
    return out.select(
        "N", ((F.col("r") - 1) * (F.col("c") - 1)).alias("DF"), "CHISQ", phi.alias("PHI"), F.sqrt(F.try_divide(F.col("CHISQ"), F.col("CHISQ") + F.col("N"))).alias("CONTINGENCY"),
        F.try_divide(phi, F.sqrt((F.least("r", "c") - 1).cast("double"))).alias("CRAMER_V"),
    )


def upper_gamma(a: Column, x: Column, terms: int = 400) -> Column:
    """The regularised upper incomplete gamma function of a (a multiple of 1/2, at least 1/2) and x >= 0, by its series below a + 1 and its continued fraction above. Both have as many terms as stated and a more."""
    half = F.pmod(a * 2, F.lit(2.0)) == 1.0
    steps = F.sequence(F.lit(1).cast("int"), F.floor(a).cast("int"))
    below = F.when(F.floor(a) >= F.when(half, 1).otherwise(2), F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.when(a - i > 0, F.log(F.greatest(a - i, F.lit(0.5)))).otherwise(0.0))).otherwise(0.0)
    log_gamma = below + F.when(half, F.lit(0.5723649429247001)).otherwise(0.0)  # log of the gamma function at 1/2
    front = F.exp(a * F.log(F.greatest(x, F.lit(1e-300))) - x - log_gamma)
    count = F.sequence(F.lit(1), F.lit(terms) + F.ceil(a).cast("int"))
    series = F.aggregate(count, F.struct((1 / a).alias("t"), (1 / a).alias("s")), lambda u, n: F.struct((u["t"] * x / (a + n)).alias("t"), (u["s"] + u["t"] * x / (a + n)).alias("s")), lambda u: u["s"])
    tiny = F.lit(1e-300)

    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def lentz(u: Column, n: Column) -> Column:
        an = -n * (n - a)
        b = u["b"] + 2
        d = 1 / safe(an * u["d"] + b)
        c = safe(b + an / u["c"])
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (u["h"] * d * c).alias("h"))

    b0 = x + 1 - a
    first = F.struct(b0.alias("b"), F.lit(1e300).alias("c"), (1 / safe(b0)).alias("d"), (1 / safe(b0)).alias("h"))
    fraction = F.aggregate(count, first, lentz, lambda u: u["h"])
    return F.when(x <= 0, 1.0).when(x < a + 1, F.greatest(F.lit(0.0), 1 - front * series)).otherwise(F.least(F.lit(1.0), front * fraction))


#: Most cells (row values times column values) of a table that ``association`` and SPARSE fill.
TABLE_CELLS = 4_000_000


def association(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """MEASURES of a two-way table of ordered values: (STATISTIC, VALUE) with Pearson's chi-square and its p-value, gamma, Kendall's tau-b, Stuart's tau-c, Somers' D both ways, and Spearman's correlation of mid-ranks.

    Concordant and discordant pairs come from sums over the cells above and to one side of each cell: two windows over the table, whose number of cells is checked first; rows are counted once.
    """
    cells = stored(crosstab(df, rows, cols, percents=False).select(F.col(rows).alias("i"), F.col(cols).alias("j"), F.col("COUNT").cast("double").alias("n")))
    r, c = (stored(cells.groupBy(k).agg(F.sum("n").alias(f"n{k}"))) for k in "ij")
    if r.count() * c.count() > TABLE_CELLS:
        raise ValueError(f"MEASURES of a table of more than {TABLE_CELLS} cells")

    def ranked(m: DataFrame, k: str) -> DataFrame:  # as many rows as the variable has values
        w = Window.orderBy(k).rowsBetween(Window.unboundedPreceding, -1)
        return m.withColumn(f"r{k}", F.coalesce(F.sum(f"n{k}").over(w), F.lit(0.0)) + (F.col(f"n{k}") + 1) / 2)

    table = ranked(r, "i").join(F.broadcast(ranked(c, "j"))).join(cells, ["i", "j"], "left").fillna(0.0, ["n"])  # as many cells as checked above
    left = Window.partitionBy("i").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    right = Window.partitionBy("i").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("j").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumns({"_l_": F.sum("n").over(left), "_g_": F.sum("n").over(right)})
    table = table.withColumns({"same": F.coalesce(F.sum("_l_").over(up), F.lit(0.0)), "against": F.coalesce(F.sum("_g_").over(up), F.lit(0.0))})
    n, ri, rj = F.col("n"), F.col("ri"), F.col("rj")
    one = table.agg(
        F.sum(n).alias("N"), F.sum(n * F.col("same")).alias("C"), F.sum(n * F.col("against")).alias("D"), F.sum(n * F.col("ni")).alias("RR"), F.sum(n * F.col("nj")).alias("CC"), F.countDistinct("i").cast("double").alias("R"), F.countDistinct("j").cast("double").alias("K"),
        F.sum(n * ri * rj).alias("xy"), F.sum(n * ri * ri).alias("xx"), F.sum(n * rj * rj).alias("yy"), (F.sum(n) * (F.sum(F.try_divide(n * n, F.col("ni") * F.col("nj"))) - 1)).alias("X"),
    )
    N, C, D, RR, CC, R, K = (F.col(x) for x in ("N", "C", "D", "RR", "CC", "R", "K"))
    m, mean = F.least(R, K), (N + 1) / 2
    spearman = F.try_divide(F.col("xy") - N * mean * mean, F.sqrt((F.col("xx") - N * mean * mean) * (F.col("yy") - N * mean * mean)))
    free = (R - 1) * (K - 1)
    values = {
        "CHISQ": F.col("X"), "DF": free, "PROB": F.when(free > 0, upper_gamma(F.greatest(free, F.lit(1.0)) / 2, F.col("X") / 2)), "GAMMA": F.try_divide(C - D, C + D), "KENDALL_TAU_B": F.try_divide(2 * (C - D), F.sqrt((N * N - RR) * (N * N - CC))),
        "STUART_TAU_C": F.try_divide(2 * m * (C - D), N * N * (m - 1)), "SOMERS_D_C_R": F.try_divide(2 * (C - D), N * N - RR), "SOMERS_D_R_C": F.try_divide(2 * (C - D), N * N - CC), "SPEARMAN": spearman,
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("STATISTIC"), v.cast("double").alias("VALUE")) for k, v in values.items()])).alias("x")).select("x.*")


def report(df: DataFrame, group: Sequence[str], analysis: dict[str, str], totals: bool = False, order: bool = True, breaks: Sequence[int] = ()) -> DataFrame:
    """PROC REPORT: GROUP columns with ANALYSIS statistics (name of the variable to keyword). ``totals`` adds all break rows and the grand total, ``breaks`` those of single
    BREAK and RBREAK statements: summaries by the first n group columns (0: the grand total). ``_BREAK_`` tells the rows apart."""
    aggs = [STATISTICS[k.upper()](F.col(v)).alias(v) for v, k in analysis.items()]
    sets = [[F.col(g) for g in group[:n]] for n in dict.fromkeys((len(group), *breaks))]
    grouped = df.rollup(*group) if totals else df.groupingSets(sets, *[F.col(g) for g in group]) if breaks else df.groupBy(*group)
    out = grouped.agg(*aggs, *([F.grouping_id().cast("long").alias("_BREAK_")] if totals or breaks else []))
    return out.orderBy(*[F.col(g).asc_nulls_last() for g in group]) if order else out


def tabulate(df: DataFrame, rows: str, cols: str, values: Sequence[str | int], var: str, stat: str = "SUM", total: str | None = None) -> DataFrame:
    """PROC TABULATE of a row and a column class: a column for each of ``values``, and with ``total`` one over all of them."""
    aggs = [STATISTICS[stat.upper()](F.when(F.col(cols) == v, F.col(var))).alias(str(v)) for v in values]
    if total:
        aggs.append(STATISTICS[stat.upper()](F.col(var)).alias(total))
    return df.groupBy(rows).agg(*aggs)


@dataclass(frozen=True)
class Cell:
    """A crossing of a table: class variables, analysis variable (None for counts), statistic, and for percents the class variables of the denominator."""

    classes: tuple[str, ...]
    var: str | None
    stat: str
    of: tuple[str, ...] | None = None

    @property
    def name(self) -> str:
        return "_".join(x for x in (self.var, self.stat.lower()) if x)


PERCENTS = ("PCTN", "PCTSUM", "ROWPCTN", "ROWPCTSUM", "COLPCTN", "COLPCTSUM")


def tabulate_cells(df: DataFrame, by_class: Sequence[str], cells: Sequence[Cell]) -> DataFrame:
    """All crossings of a table: a row for each combination of class values of each crossing, the class variables, ``_type_`` (a digit for each, 1 where it takes part) and a column for each statistic.

    One GROUPING SETS pass makes all crossings and the denominators of percents, which are coarser sets; it is written once, as it has as many rows as the table has cells. Rows with a missing class value take no part.
    """
    df = df.dropna(subset=list(by_class)) if by_class else df
    sets = list(dict.fromkeys(x for c in cells for x in (c.classes, c.of) if x is not None))

    def base(c: Cell) -> str:  # what a percent is a percent of
        return f"{c.var}_sum" if c.stat.endswith("SUM") and c.stat in PERCENTS else "n" if c.stat in PERCENTS else c.name

    aggs = {"n": F.count("*").cast("long")}
    for c in cells:
        if base(c) not in aggs:
            aggs[base(c)] = STATISTICS["SUM" if c.stat in PERCENTS else c.stat](F.col(c.var)) if c.var else F.count("*").cast("long")
    key = F.concat(*[(1 - F.grouping(c)).cast("string") for c in by_class]) if by_class else F.lit("")
    grouped = df.groupingSets([[F.col(c) for c in x] for x in sets], *map(F.col, by_class)) if by_class else df.groupBy()
    table = stored(grouped.agg(key.alias("_type_"), *[v.alias(f"_{k}_") for k, v in aggs.items()]))

    def kind(classes: Sequence[str]) -> str:
        return "".join("1" if c in classes else "0" for c in by_class)

    out = None
    names = list(dict.fromkeys(c.name for c in cells))
    for classes in dict.fromkeys(c.classes for c in cells):
        part = table.where(F.col("_type_") == kind(classes))
        mine = {c.name: c for c in cells if c.classes == classes}
        for of in dict.fromkeys(c.of for c in mine.values() if c.of is not None):
            wanted = [c for c in mine.values() if c.of == of]
            whole = table.where(F.col("_type_") == kind(of)).select(*of, *[F.col(f"_{base(c)}_").alias(f"_of_{c.name}_") for c in wanted])
            part = beside(part, whole, list(of))
        value = {n: (F.try_divide(F.col(f"_{base(c)}_") * 100, F.col(f"_of_{n}_")) if c.of is not None else F.col(f"_{base(c)}_")) for n, c in mine.items()}
        part = part.select(*by_class, "_type_", *[value[n].alias(n) for n in names if n in value])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select(*by_class, "_type_", *names)


def format_value(x: str | Column, mapping: dict[object, str] | None = None, ranges: Sequence[tuple[float | None, float | None, bool, bool, str]] = (), other: str | None = None) -> Column:
    """A user format: single values, or ranges (low, high, low included, high included, label) with None for LOW and HIGH."""
    x = F.col(x) if isinstance(x, str) else x
    tests: list[tuple[Column, str]] = [(x == k, v) for k, v in (mapping or {}).items()]
    for low, high, with_low, with_high, label in ranges:
        parts = [x.isNotNull()]
        if low is not None:
            parts.append(x >= low if with_low else x > low)
        if high is not None:
            parts.append(x <= high if with_high else x < high)
        tests.append((reduce(lambda a, b: a & b, parts), label))
    out = None
    for cond, label in tests:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(F.lit(other) if other is not None else x.cast("string"))


#: What UNIVARIATE reports of a variable.
UNIVARIATE = ("N", "NMISS", "MEAN", "STD", "VAR", "SKEW", "KURT", "USS", "CSS", "CV", "STDERR", "MIN", "P1", "P5", "P10", "Q1", "MEDIAN", "Q3", "P90", "P95", "P99", "MAX", "RANGE", "QRANGE", "MODE")


def univariate(df: DataFrame, var: str | Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """PROC UNIVARIATE: moments, quantiles and mode. Of several variables: a row for each group and variable, named in ``_VAR_``."""
    names = [var] if isinstance(var, str) else list(var)
    wide = named_means(df, [(k, v, f"_{i}_{k}") for i, v in enumerate(names) for k in UNIVARIATE], by, missing=True, freq=None, type_=None)
    if isinstance(var, str):
        return wide.select(*by, *[F.col(f"_0_{k}").alias(k) for k in UNIVARIATE])
    rows = F.array(*[F.struct(F.lit(v).alias("_VAR_"), *[F.col(f"_{i}_{k}").cast("double").alias(k) for k in UNIVARIATE]) for i, v in enumerate(names)])
    return wide.select(*by, F.explode(rows).alias("_x_")).select(*by, "_x_.*")


#: Most ranges that are broadcast; longer tables are merged with the values in order.
FORMAT_RANGES = 20_000
GROUP_RANGES = 64


def range_table(ranges: DataFrame, start: str, end: str, label: str, with_start: str | None = None, with_end: str | None = None) -> DataFrame:
    """(low, high, closed_low, closed_high, label) of a table of ranges, written once; a null start or end is open. Ranges that overlap are refused."""
    from batchloom.operators import scans

    lows, highs = (F.coalesce(F.col(c).cast("double"), F.lit(x)) for c, x in ((start, float("-inf")), (end, float("inf"))))
    closed = [F.lit(True) if c is None else F.coalesce(F.col(c).cast("boolean"), F.lit(True)) for c in (with_start, with_end)]
    table = ranges.select(lows.alias("low"), highs.alias("high"), closed[0].alias("closed_low"), closed[1].alias("closed_high"), F.col(label).cast("string").alias("label"))
    rows = scans.placed(table, ["low", F.desc("closed_low"), "high"]).rows
    before = scans.queued(rows, "before", F.struct("high", "closed_high"), 1)
    touch = (F.col("before.high") == F.col("low")) & F.col("before.closed_high") & F.col("closed_low")
    bad = before.where((F.col("before.high") > F.col("low")) | touch | (F.col("high") < F.col("low"))).select("low", "high").limit(1).collect()
    if bad:
        raise ValueError(f"the range from {bad[0][0]} to {bad[0][1]} overlaps the one before it or is empty")
    return rows.drop("_p_", "_k_")


def format_ranges(df: DataFrame, x: str, table: DataFrame, out: str, other: str | None = None) -> DataFrame:
    """Adds the label of the range that holds ``x`` (``other`` where none does) from a table that ``range_table`` made.

    Up to FORMAT_RANGES ranges are sorted and cut into groups of GROUP_RANGES, which are broadcast; bisection finds the group among the groups' first ranges, a literal array, then the range in its group. Beyond that, ranges and values are put in one order and each value takes the last range that begins
    at or before it, carried over range partitions, so neither side is held whole.
    """
    from batchloom.operators import scans

    n = table.count()
    missing = F.lit(other).cast("string")
    v = F.col(x).cast("double")
    if 0 < n <= FORMAT_RANGES:
        place = F.row_number().over(Window.orderBy("low", F.desc("closed_low"))) - 1  # FORMAT_RANGES rows at most
        groups = table.withColumn("_g_", F.floor(place / GROUP_RANGES).cast("int")).groupBy("_g_").agg(F.array_sort(F.collect_list(F.struct("low", (~F.col("closed_low")).alias("open"), "high", "closed_high", "label"))).alias("_r_"))
        groups = stored(groups)
        heads = groups.select("_g_", F.get("_r_", F.lit(0)).alias("h")).select("_g_", "h.low", "h.open").orderBy("_g_").collect()  # FORMAT_RANGES / GROUP_RANGES rows at most
        lows = F.split(F.lit(",".join(repr(h.low) for h in heads)), ",").cast("array<double>")
        opens = F.split(F.lit(",".join(str(h.open).lower() for h in heads)), ",").cast("array<boolean>")

        def last(size: Column, turns: int, begins) -> Column:
            """The last place whose range begins at or before v, by bisection; -1 if none does."""

            def step(s: Column, _: Column) -> Column:
                mid = F.shiftright(s["a"] + s["b"], 1)
                return F.when(s["a"] >= s["b"], s).when(begins(mid), F.struct((mid + 1).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), mid.alias("b")))

            return F.aggregate(F.sequence(F.lit(0), F.lit(turns)), F.struct(F.lit(0).alias("a"), size.alias("b")), step, lambda s: s["a"] - 1)

        def before(low: Column, open_: Column) -> Column:
            return (low < v) | (low == v) & ~open_

        number = v.isNotNull() & ~F.isnan(v)
        joined = df.withColumn("_at_", F.when(number, last(F.lit(len(heads)), len(heads).bit_length(), lambda i: before(F.get(lows, i), F.get(opens, i)))))
        joined = joined.join(F.broadcast(groups), F.col("_at_") == F.col("_g_"), "left")
        inner = last(F.size("_r_"), GROUP_RANGES.bit_length(), lambda i: before(F.get("_r_", i)["low"], F.get("_r_", i)["open"]))
        found = F.get("_r_", F.when(F.col("_r_").isNotNull(), inner))
        inside = (found["high"] > v) | (found["high"] == v) & found["closed_high"]
        return joined.select(*df.columns, F.when(inside, found["label"]).otherwise(missing).alias(out))
    names = [f"c{i}" for i in range(len(df.columns))]
    values = df.toDF(*names).withColumn("_v_", F.col(names[df.columns.index(x)]).cast("double"))
    known = values.where(F.col("_v_").isNotNull() & ~F.isnan("_v_"))
    # at one number: ranges that begin there, then values, then ranges that begin just above it
    marks = table.select(F.col("low").alias("_v_"), F.when(F.col("closed_low"), 0).otherwise(2).alias("_o_"), F.struct("high", "closed_high", "label").alias("_mark_"))
    every = known.withColumn("_o_", F.lit(1)).unionByName(marks, allowMissingColumns=True).withColumn("_h_", F.xxhash64(*names))
    rows = scans.carried(scans.placed(every, ["_v_", "_o_", "_h_"]).rows, {"_last_": scans.Carry("last", F.col("_mark_"))}).where("_o_ = 1")
    inside = (F.col("_last_.high") > F.col("_v_")) | (F.col("_last_.high") == F.col("_v_")) & F.col("_last_.closed_high")
    done = rows.select(*names, F.when(inside, F.col("_last_.label")).otherwise(missing).alias(out))
    rest = values.where(F.col("_v_").isNull() | F.isnan("_v_")).select(*names, missing.alias(out))
    return done.unionByName(rest).toDF(*df.columns, out)
