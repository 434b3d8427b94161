"""Queries of MEANS, FREQ, REPORT, TABULATE and user formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchloom.operators import summaries as s
from batchloom.plans.registry import Tables, query, rounded


@query("""SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
 round(sum(l_extendedprice), 2) AS total, count(*) AS _FREQ_, CAST(3 AS BIGINT) AS _TYPE_ FROM lineitem GROUP BY ALL""")
def means_nway(t: Tables):
    stats = {"N": ["n"], "MEAN": ["mean"], "STD": ["std"], "MIN": ["min"], "MAX": ["max"], "SUM": ["total"]}
    return rounded(s.means(t.lineitem, ["l_extendedprice"], stats, ["l_returnflag", "l_linestatus"]), total=2)


@query("""SELECT count(o_totalprice) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count(*) AS _FREQ_, CAST(0 AS BIGINT) AS _TYPE_ FROM orders""")
def means_global(t: Tables):
    return rounded(s.means(t.orders, ["o_totalprice"], {"N": ["n"], "SUM": ["total"], "MEAN": ["mean"]}), total=2)


@query("""SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total, count(*) AS _FREQ_, CAST(3 - grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS _TYPE_ FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def means_cube_type_freq(t: Tables):
    return rounded(s.means(t.orders, ["o_totalprice"], {"SUM": ["total"]}, ["o_orderstatus", "o_orderpriority"], nway=False), total=2)


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS _FREQ_, CAST(3 - grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS _TYPE_, max(o_totalprice) AS top FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))""")
def means_types(t: Tables):
    return s.means(t.orders, ["o_totalprice"], {"MAX": ["top"]}, ["o_orderstatus", "o_orderpriority"], nway=False, types=[["o_orderstatus"], ["o_orderpriority"]])


@query("""SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 4) AS median, round(quantile_cont(l_quantity, 0.25), 4) AS q1, round(quantile_cont(l_quantity, 0.75), 4) AS q3, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, count(*) AS _FREQ_ FROM lineitem GROUP BY 1""")
def means_median_pctl(t: Tables):
    asked = [("MEDIAN", "l_quantity", "median"), ("Q1", "l_quantity", "q1"), ("Q3", "l_quantity", "q3"), ("P90", "l_extendedprice", "p90")]
    return rounded(s.named_means(t.lineitem, asked, ["l_returnflag"], type_=None))


@query("""WITH x AS (SELECT o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders)
SELECT o_orderstatus, count(*) - count(v) AS nmiss, round(max(v) - min(v), 4) AS range, round(sum(v * v) / 1e6, 2) AS uss, round(var_pop(v) * count(v) / 1e6, 2) AS css, round(stddev_samp(v) * 100 / avg(v), 4) AS cv, round(stddev_samp(v) / sqrt(count(v)), 4) AS stderr, round(var_samp(v) / 1e6, 3) AS var FROM x GROUP BY 1""")
def means_nmiss_range_uss_css(t: Tables):
    x = t.orders.select("o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("v"))
    out = s.means(x, ["v"], {k: [k.lower()] for k in ("NMISS", "RANGE", "USS", "CSS", "CV", "STDERR", "VAR")}, ["o_orderstatus"], freq=None, type_=None)
    return rounded(out.withColumns({c: F.col(c) / 1e6 for c in ("uss", "css", "var")}), uss=2, css=2, var=3)


@query("""SELECT l_returnflag, round(skewness(l_quantity), 6) AS skew, round(kurtosis(l_quantity), 6) AS kurt, count(*) AS _FREQ_ FROM lineitem GROUP BY 1""")
def means_skew_kurt(t: Tables):
    return rounded(s.means(t.lineitem, ["l_quantity"], {"SKEW": ["skew"], "KURT": ["kurt"]}, ["l_returnflag"], type_=None), 6)


@query("""WITH x AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS seg, c_acctbal FROM customer)
SELECT seg, round(sum(c_acctbal), 2) AS total, count(*) AS _FREQ_, true AS kept FROM x WHERE seg IS NOT NULL GROUP BY 1 UNION ALL SELECT seg, round(sum(c_acctbal), 2), count(*), false FROM x GROUP BY 1""")
def means_missing_class(t: Tables):
    x = t.customer.select(F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("seg"), "c_acctbal")
    a, b = (s.means(x, ["c_acctbal"], {"SUM": ["total"]}, ["seg"], missing=m, type_=None).withColumn("kept", F.lit(not m)) for m in (False, True))
    return rounded(a.unionByName(b), total=2)


@query("""SELECT l_linestatus, round(sum(l_quantity), 2) AS total_l_quantity, round(sum(l_extendedprice), 2) AS total_l_extendedprice, round(avg(l_quantity), 4) AS l_quantity_mean, round(avg(l_extendedprice), 4) AS l_extendedprice_mean FROM lineitem GROUP BY 1""")
def means_output_naming(t: Tables):
    return rounded(s.means(t.lineitem, ["l_quantity", "l_extendedprice"], {"SUM": "total_{}", "MEAN": None}, ["l_linestatus"]).drop("_TYPE_", "_FREQ_"), total_l_quantity=2, total_l_extendedprice=2)


@query("""SELECT event_type, count(*) AS COUNT, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS PERCENT FROM events GROUP BY 1""")
def freq_oneway(t: Tables):
    return rounded(s.frequencies(t.events, "event_type", cumulative=False), 6)


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, n AS COUNT, round(n * 100 / sum(n) OVER (), 6) AS PERCENT, CAST(sum(n) OVER (ORDER BY event_type) AS BIGINT) AS CUM_FREQ, round(sum(n) OVER (ORDER BY event_type) * 100 / sum(n) OVER (), 6) AS CUM_PCT FROM c""")
def freq_cumulative(t: Tables):
    return rounded(s.frequencies(t.events, "event_type"), 6)


@query("""WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_orderstatus, o_orderpriority, n AS COUNT, round(n * 100 / sum(n) OVER (), 6) AS PERCENT, round(n * 100 / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS PCT_ROW, round(n * 100 / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS PCT_COL FROM c""")
def freq_crosstab(t: Tables):
    return rounded(s.crosstab(t.orders, "o_orderstatus", "o_orderpriority"), 6)


@query("""WITH r AS (SELECT c_nationkey, c_mktsegment FROM customer), c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM r GROUP BY ALL)
SELECT a.c_nationkey, b.c_mktsegment, coalesce(n, 0) AS COUNT FROM (SELECT DISTINCT c_nationkey FROM r) a CROSS JOIN (SELECT DISTINCT c_mktsegment FROM r) b LEFT JOIN c ON c.c_nationkey = a.c_nationkey AND c.c_mktsegment = b.c_mktsegment""")
def freq_sparse(t: Tables):
    return s.crosstab(t.customer, "c_nationkey", "c_mktsegment", sparse=True, percents=False)


@query("""WITH c AS (SELECT o_orderstatus r, o_orderpriority c, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY r) * sum(n) OVER (PARTITION BY c) / sum(n) OVER () AS e FROM c), x AS (SELECT sum((n - e) * (n - e) / e) AS q, max(t) AS t FROM e)
SELECT CAST(t AS BIGINT) AS N, (SELECT (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) FROM c) AS DF, round(q, 6) AS CHISQ, round(sqrt(q / t), 6) AS PHI, round(sqrt(q / (q + t)), 6) AS CONTINGENCY, round(sqrt(q / t) / sqrt((SELECT least(count(DISTINCT r), count(DISTINCT c)) - 1 FROM c)), 6) AS CRAMER_V FROM x""")
def freq_chisq(t: Tables):
    return rounded(s.chi_square(t.orders, "o_orderstatus", "o_orderpriority"), 6)


@query("""SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total_vendas, count(*) AS qtd, round(avg(o_totalprice), 4) AS ticket FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) > 10""")
def sql_group_having(t: Tables):
    t.orders.createOrReplaceTempView("bl_orders")
    out = t.spark.sql("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total_vendas, count(*) AS qtd, round(mean(o_totalprice), 4) AS ticket FROM bl_orders WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority HAVING count(*) > 10")
    t.spark.catalog.dropTempView("bl_orders")
    return out


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def sql_count_distinct(t: Tables):
    return t.orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"))


@query("SELECT o_orderkey, o_orderpriority, round(o_totalprice * 100 / sum(o_totalprice) OVER (PARTITION BY o_orderpriority), 6) AS pct FROM orders")
def sql_remerge(t: Tables):
    out = s.remerged(t.orders, ["o_orderpriority"], total=F.sum("o_totalprice"))
    return out.select("o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") * 100 / F.col("total"), 6).alias("pct"))


@query("SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice, count(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def report_group(t: Tables):
    return rounded(s.report(t.orders, ["o_orderpriority", "o_orderstatus"], {"o_totalprice": "SUM", "o_orderkey": "N"}), 2)


@query("SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice, CAST(grouping(o_orderpriority, o_orderstatus) AS BIGINT) AS _BREAK_ FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def report_rollup(t: Tables):
    return rounded(s.report(t.orders, ["o_orderpriority", "o_orderstatus"], {"o_totalprice": "SUM"}, totals=True), 2)


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS F, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS O, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def tabulate_pivot(t: Tables):
    return rounded(s.tabulate(t.lineitem, "l_returnflag", "l_linestatus", ["F", "O"], "l_quantity", total="total"), 2)


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'Fechado' WHEN 'O' THEN 'Aberto' ELSE 'Outro' END AS label, count(*) AS n FROM orders GROUP BY 1")
def format_value_map(t: Tables):
    return t.orders.groupBy(s.format_value("o_orderstatus", {"F": "Fechado", "O": "Aberto"}, other="Outro").alias("label")).agg(F.count("*").alias("n"))


#: The ranges of a price format.
PRICE_BANDS = ((None, 1000.0, True, False, "Baixo"), (1000.0, 1500.0, True, False, "Medio"), (1500.0, None, True, True, "Alto"))


@query("SELECT CASE WHEN p_retailprice < 1000 THEN 'Baixo' WHEN p_retailprice < 1500 THEN 'Medio' WHEN p_retailprice >= 1500 THEN 'Alto' END AS band, count(*) AS n, max(p_retailprice) AS top FROM part GROUP BY 1")
def format_range(t: Tables):
    return t.part.groupBy(s.format_value("p_retailprice", ranges=PRICE_BANDS).alias("band")).agg(F.count("*").alias("n"), F.max("p_retailprice").alias("top"))


@query("""SELECT count(value) AS N, count(*) - count(value) AS NMISS, round(avg(value), 6) AS MEAN, round(stddev_samp(value), 6) AS STD, min(value) AS MIN, round(quantile_cont(value, 0.25), 4) AS Q1, round(quantile_cont(value, 0.5), 4) AS MEDIAN, round(quantile_cont(value, 0.75), 4) AS Q3, max(value) AS MAX, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS QRANGE FROM events""")
def univariate(t: Tables):
    out = s.univariate(t.events, "value").select("N", "NMISS", "MEAN", "STD", "MIN", "Q1", "MEDIAN", "Q3", "MAX", "QRANGE")
    return rounded(out, MEAN=6, STD=6, MIN=12, MAX=12)
