"""Queries of exact order statistics and of state carried over all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from batchloom.lang.program import Program
from batchloom.operators import orderstats, scans
from batchloom.operators import summaries as s
from batchloom.plans.registry import Tables, query, rounded
from batchloom.sources import Library
from batchloom.stored import shared_folder

_RANKED = {"P1": "quantile_cont({0}, 0.01)", "P5": "quantile_cont({0}, 0.05)", "Q1": "quantile_cont({0}, 0.25)", "MEDIAN": "quantile_cont({0}, 0.5)", "Q3": "quantile_cont({0}, 0.75)", "P99": "quantile_cont({0}, 0.99)", "QRANGE": "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"}
_LINE_VARS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT " + ", ".join(f"round({f.format(v)}, 6) AS {v}_{k.lower()}" for k, f in _RANKED.items() for v in _LINE_VARS) + ", count(*) AS n FROM lineitem")
def order_statistics(t: Tables):
    """All quantiles of four variables over all rows in one run."""
    return rounded(s.means(t.lineitem, _LINE_VARS, dict.fromkeys(_RANKED), freq="n", type_=None), 6)


@query("""WITH m AS (SELECT o_orderstatus, o_orderpriority, o_totalprice, count(*) AS c FROM orders GROUP BY GROUPING SETS ((o_totalprice, o_orderstatus, o_orderpriority), (o_totalprice, o_orderstatus), (o_totalprice, o_orderpriority), (o_totalprice)))
SELECT x.*, y.mode FROM (SELECT o_orderstatus, o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(sum(o_totalprice), 2) AS total, count(*) AS _FREQ_, CAST(3 - grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS _TYPE_ FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)) x
JOIN (SELECT o_orderstatus, o_orderpriority, arg_max(o_totalprice, (c, -o_totalprice)) AS mode FROM m GROUP BY 1, 2) y ON x.o_orderstatus IS NOT DISTINCT FROM y.o_orderstatus AND x.o_orderpriority IS NOT DISTINCT FROM y.o_orderpriority""")
def order_statistics_by_types(t: Tables):
    """Quantiles and modes of every subset of two class variables."""
    return rounded(s.means(t.orders, ["o_totalprice"], {"MEDIAN": ["med"], "P90": ["p90"], "SUM": ["total"], "MODE": ["mode"]}, ["o_orderstatus", "o_orderpriority"], nway=False), total=2)


@query("""WITH v AS (SELECT event_type, event_id, value FROM events WHERE value IS NOT NULL), r AS (
 SELECT event_type, 'LOW' AS side, value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS place FROM v UNION ALL
 SELECT event_type, 'HIGH', value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) FROM v)
SELECT event_type, side, CAST(place AS INTEGER) AS place, value, event_id FROM r WHERE place <= 5""")
def extreme_observations(t: Tables):
    """The five least and greatest values of each event type, with their rows."""
    return orderstats.extremes(t.events, ["value"], 5, ["event_type"], ["event_id"]).drop("v")


# state along all rows; 1e-10 keeps decimal ties from falling to either side when they are rounded
_ALL = "WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
_BY_TIME = "proc sort data=events out=s; by ts event_id; run;"


@query(f"""SELECT event_id, round(sum(value) OVER w, 4) AS total, CAST(row_number() OVER w AS BIGINT) AS n, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS last_purchase,
last_value(CASE WHEN event_type = 'error' THEN props END IGNORE NULLS) OVER w AS last_error FROM events {_ALL}""")
def retain_over_all_rows(t: Tables):
    """A running sum, a counter, and a number and a text carried forward, along all events."""
    carries = {
        "total": scans.Carry("sum", F.col("value")), "n": scans.Carry("sum", F.lit(1).cast("long")), "last_purchase": scans.Carry("last", F.when(F.col("event_type") == "purchase", F.col("value"))),
        "last_error": scans.Carry("last", F.when(F.col("event_type") == "error", F.col("props"))),
    }
    rows = scans.carried(scans.placed(t.events, ["ts", "event_id"]).rows, carries)
    return rows.select("event_id", F.round("total", 4).alias("total"), "n", "last_purchase", "last_error")


@query("""WITH x AS (SELECT event_id, event_type, ts, value, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS k FROM events)
SELECT event_id, lag(value) OVER w AS a, lag(value, 3) OVER w AS b, CASE WHEN event_type = 'error' THEN lag(value, 2) OVER e END AS c FROM x WINDOW w AS (ORDER BY ts, event_id), e AS (PARTITION BY event_type = 'error' ORDER BY ts, event_id)""")
def lag_queue(t: Tables):
    """LAG along all events, and a queue that only one kind of event reaches."""
    rows = scans.placed(t.events, ["ts", "event_id"]).rows
    rows = scans.queued(scans.queued(rows, "a", F.col("value")), "b", F.col("value"), 3)
    return scans.queued(rows, "c", F.col("value"), 2, F.col("event_type") == "error").select("event_id", "a", "b", "c")


@query("""WITH RECURSIVE x AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, i, least(300.0, greatest(0.0, 50 * 0.9 + value - 10)) AS s FROM x WHERE i = 1 UNION ALL SELECT x.event_id, x.i, least(300.0, greatest(0.0, r.s * 0.9 + x.value - 10)) FROM r JOIN x ON x.i = r.i + 1)
SELECT event_id, round(s + 1e-10, 6) AS s FROM r""")
def recurrence_over_all_rows(t: Tables):
    """A decaying level between 0 and 300 along all events: one group that holds every row."""
    out = scans.bounded_recurrence(t.events, [], ["ts", "event_id"], F.lit(0.9), F.col("value") - 10, "s", 50.0, F.lit(0.0), F.lit(300.0))
    return out.select("event_id", F.round(F.col("s") + 1e-10, 6).alias("s"))


# program text
def _text(t: Tables, program: str, result: str, *names: str):
    return Program(t.spark, {n: getattr(t, n) for n in names}).run(program).frame(result)


@query(f"""SELECT event_id, round(100 + sum(value) OVER w, 4) AS total, CAST(row_number() OVER w AS DOUBLE) AS n, coalesce(last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w, -1) AS last_error FROM events {_ALL}""")
def retain_text(t: Tables):
    """RETAIN and sum statements without BY run along the whole sorted dataset."""
    out = _text(t, f"{_BY_TIME} data r; set s; retain total 100 last_error -1; total + value; n + 1; if event_type = 'error' then last_error = event_id; keep event_id total n last_error; run;", "r", "events")
    return out.select("event_id", F.round("total", 4).alias("total"), F.col("n").cast("double").alias("n"), "last_error")


@query("""WITH x AS (SELECT *, CASE WHEN event_type = 'error' THEN lag(value) OVER (PARTITION BY event_type = 'error' ORDER BY user_id, ts, event_id) END AS d FROM events) SELECT event_id, lag(value, 2) OVER (ORDER BY user_id, ts, event_id) AS a, d FROM x""")
def lag_text_guarded(t: Tables):
    """LAG2 spans the groups of BY; LAG inside IF counts the rows that reach it."""
    return _text(t, "proc sort data=events out=s; by user_id ts event_id; run; data r; set s; by user_id; a = lag2(value); if event_type = 'error' then d = lag(value); keep event_id a d; run;", "r", "events")


@query("""WITH RECURSIVE x AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, i, greatest(0.0, 5 * 0.8 + value / 2 - 40) AS s FROM x WHERE i = 1 UNION ALL SELECT x.event_id, x.i, greatest(0.0, r.s * 0.8 + x.value / 2 - 40) FROM r JOIN x ON x.i = r.i + 1) SELECT event_id, round(s + 1e-10, 6) AS s FROM r""")
def recurrence_text(t: Tables):
    out = _text(t, f"{_BY_TIME} data r; set s; retain s 5; s = max(0, s * 0.8 + value / 2 - 40); keep event_id s; run;", "r", "events")
    return out.select("event_id", F.round(F.col("s") + 1e-10, 6).alias("s"))


@query("""WITH n AS (SELECT o_orderkey, o_totalprice, 1 + CAST(floor(ln(o_totalprice / 1000) / ln(2)) AS INTEGER) AS k FROM orders WHERE o_totalprice >= 1000)
SELECT o_orderkey, CAST(coalesce(k, 0) AS DOUBLE) AS halvings, o_totalprice / power(2, coalesce(k, 0)) AS rest FROM orders LEFT JOIN n USING (o_orderkey, o_totalprice)""")
def do_while_text(t: Tables):
    """How often a price can be halved before it is below 1000."""
    return _text(t, "data r; set orders; rest = o_totalprice; halvings = 0; do while (rest >= 1000); rest = rest / 2; halvings = halvings + 1; end; keep o_orderkey halvings rest; run;", "r", "orders")


@query("SELECT l_orderkey, l_linenumber, CAST(i AS DOUBLE) AS i, l_extendedprice / l_quantity * i AS part FROM lineitem, unnest(range(1, CAST(l_quantity AS BIGINT) + 1, 7)) AS u(i) WHERE l_extendedprice / l_quantity * i <= 20000")
def do_bounds_text(t: Tables):
    """A loop bounded by a column, with OUTPUT and LEAVE inside."""
    return _text(t, "data r; set lineitem; do i = 1 to l_quantity by 7; part = l_extendedprice / l_quantity * i; if part > 20000 then leave; output; end; keep l_orderkey l_linenumber i part; run;", "r", "lineitem")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus IN ('O', 'P') AND o_totalprice > 200000 THEN 'large' WHEN o_orderstatus IN ('O', 'P') THEN 'open' ELSE 'none' END AS state, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_totalprice * 2 END AS twice FROM orders""")
def select_when_text(t: Tables):
    """SELECT/WHEN, and RETURN, which skips the rest of the step for a row."""
    program = """data r; length state $ 8; set orders;
    select (o_orderstatus); when ('F') state = 'done'; when ('O', 'P') do; if o_totalprice > 200000 then state = 'large'; else state = 'open'; end; otherwise state = 'none'; end;
    if substr(o_orderpriority, 1, 1) = '1' then return; twice = o_totalprice * 2; keep o_orderkey state twice; run;"""
    return _text(t, program, "r", "orders")


@query("""WITH x AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER () AS n FROM orders), s AS (SELECT min(i) AS stop FROM x WHERE o_totalprice > 350000 AND o_orderdate >= TIMESTAMP '1996-01-01')
SELECT o_orderkey, CAST(i = n AS INTEGER) AS is_last FROM x, s WHERE i < coalesce(stop, n + 1)""")
def stop_text(t: Tables):
    """STOP at the first large order from 1996 on; END= marks the last row of the input."""
    return _text(t, "proc sort data=orders out=s; by o_orderdate o_orderkey; run; data r; set s end=eof; is_last = eof; if o_totalprice > 350000 and datepart(o_orderdate) >= '01JAN1996'd then stop; keep o_orderkey is_last; run;", "r", "orders")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * 2, 6) AS x1, round(l_tax * 2, 6) AS x2, round(l_discount, 6) AS x3, round(l_quantity * 2 + l_tax * 2 + l_discount, 6) AS total FROM lineitem WHERE l_quantity > 10 AND l_tax < 0.05")
def variable_lists_text(t: Tables):
    """Numbered and prefix lists in KEEP, DROP, ARRAY and SUM(OF), and WHERE ALSO."""
    program = """data a; set lineitem; x1 = l_quantity; x2 = l_tax; x3 = l_discount; yy = 1; yz = 2; keep l_orderkey l_linenumber l_quantity l_tax x1-x3 y:; run;
    data r; set a(drop=y:); where l_quantity > 10; where also l_tax < 0.05; array v{*} x1-x2; do i = 1 to dim(v); v{i} = v{i} * 2; end; total = sum(of x1-x3); drop l_quantity l_tax; run;"""
    return rounded(_text(t, program, "r", "lineitem").drop("i"), 6).select("l_orderkey", "l_linenumber", "x1", "x2", "x3", "total")


# tables and formats
@query("""WITH x AS (SELECT l_returnflag AS i, CAST(l_quantity / 10 AS INTEGER) AS j, l_linestatus FROM lineitem), c AS MATERIALIZED (SELECT i, j, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY ALL),
r AS (SELECT i, sum(n) AS n, sum(sum(n)) OVER (ORDER BY i) - (sum(n) - 1) / 2 AS k FROM c GROUP BY i), k AS (SELECT j, sum(n) AS n, sum(sum(n)) OVER (ORDER BY j) - (sum(n) - 1) / 2 AS k FROM c GROUP BY j),
p AS (SELECT sum(CASE WHEN (a.i < b.i AND a.j < b.j) THEN a.n * b.n ELSE 0 END) AS con, sum(CASE WHEN a.i < b.i AND a.j > b.j THEN a.n * b.n ELSE 0 END) AS dis FROM c a, c b),
t AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * n) FROM r) AS rr, (SELECT sum(n * n) FROM k) AS kk, (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM k) AS nk, (SELECT sum(c.n * c.n / (r.n * k.n)) FROM c JOIN r USING (i) JOIN k USING (j)) AS s,
 (SELECT corr(r.k, k.k) FROM x JOIN r USING (i) JOIN k USING (j)) AS rho)
SELECT s.* FROM p, t, (VALUES (1)) o, LATERAL (SELECT * FROM (VALUES ('CHISQ', round(t.n * (t.s - 1), 4)), ('DF', CAST((nr - 1) * (nk - 1) AS DOUBLE)), ('GAMMA', round((con - dis) / (con + dis), 8)), ('KENDALL_TAU_B', round(2 * (con - dis) / sqrt((n * n - rr) * (n * n - kk)), 8)),
 ('STUART_TAU_C', round(2 * least(nr, nk) * (con - dis) / (n * n * (least(nr, nk) - 1)), 8)), ('SOMERS_D_C_R', round(2 * (con - dis) / (n * n - rr), 8)), ('SOMERS_D_R_C', round(2 * (con - dis) / (n * n - kk), 8)), ('SPEARMAN', round(rho, 8))) AS v(STATISTIC, VALUE)) s""")
def freq_measures(t: Tables):
    """Rank association of return flag and quantity band, as program text."""
    x = t.lineitem.select("l_returnflag", F.bround(F.col("l_quantity") / 10, 0).cast("int").alias("band"))
    out = Program(t.spark, {"x": x}).run("proc freq data=x; tables l_returnflag*band / measures out=r; run;").frame("r")
    return out.where("STATISTIC <> 'PROB'").select("STATISTIC", F.when(F.col("STATISTIC") == "CHISQ", F.round("VALUE", 4)).otherwise(F.round("VALUE", 8)).alias("VALUE"))


_BANDS = "SELECT o_orderkey AS k, CAST(o_orderkey * 25 AS DOUBLE) AS low, CAST(o_orderkey * 25 + 20 AS DOUBLE) AS high, 'band ' || o_orderkey AS label FROM orders"
_BANDED = f"""WITH b AS ({_BANDS}) SELECT l_orderkey, l_linenumber, coalesce(label, 'none') AS band FROM lineitem LEFT JOIN b ON k = CAST(floor(l_extendedprice / 25) AS BIGINT) AND l_extendedprice <= high"""


def _bands(t: Tables):
    return s.range_table(t.orders.selectExpr("o_orderkey * 25.0D AS low", "o_orderkey * 25.0D + 20 AS high", "concat('band ', o_orderkey) AS label"), "low", "high", "label")


@query(_BANDED)
def format_ranges_from_table(t: Tables):
    """A format with a range for each order, searched by bisection in sorted arrays."""
    return s.format_ranges(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", _bands(t), "band", "none").drop("l_extendedprice")


@query(_BANDED)
def format_ranges_in_order(t: Tables):
    """The same with ranges and values merged in order, as for range tables of any size."""
    most, s.FORMAT_RANGES = s.FORMAT_RANGES, 0
    try:
        return s.format_ranges(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", _bands(t), "band", "none").drop("l_extendedprice")
    finally:
        s.FORMAT_RANGES = most


# procedures whose options used to be lost
@query("SELECT o_orderstatus, round(avg(o_shippriority), 6) AS ship, round(sum(o_totalprice), 2) AS total, max(o_shippriority) AS top, round(quantile_cont(o_totalprice, 0.5), 4) AS mid, count(*) AS _freq_ FROM (SELECT *, CAST(o_orderkey % 7 AS DOUBLE) AS o_shippriority FROM orders) GROUP BY 1")
def proc_means_named(t: Tables):
    """OUTPUT with statistics of single variables, each named."""
    program = "proc means data=o nway; class o_orderstatus; var o_totalprice p; output out=r(drop=_type_) mean(p)=ship sum=total max(p)=top median(o_totalprice)=mid; run;"
    o = t.orders.drop("o_shippriority").withColumn("p", (F.col("o_orderkey") % 7).cast("double"))
    return rounded(Program(t.spark, {"o": o}).run(program).frame("r"), ship=6, total=2)


@query("SELECT round(avg(l_quantity), 6) AS l_quantity_mean, round(avg(l_tax), 6) AS l_tax_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std, round(stddev_samp(l_tax), 6) AS l_tax_std FROM lineitem")
def proc_means_autoname(t: Tables):
    return rounded(_text(t, "proc means data=lineitem; var l_quantity l_tax; output out=r(drop=_freq_ _type_) mean= std= / autoname; run;", "r", "lineitem"), 6)


@query("""SELECT 'status' AS tab, o_orderstatus AS v, o_orderpriority AS p, count(*) AS COUNT FROM orders GROUP BY ALL UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), o_orderpriority, count(*) FROM orders GROUP BY ALL""")
def proc_freq_parentheses(t: Tables):
    """``tables p*(status y)`` makes two crosstabs."""
    p = Program(t.spark, {"orders": t.orders}).run("data o; set orders; y = year(o_orderdate); run; proc freq data=o; tables o_orderpriority*(o_orderstatus y) / nopercent; run;")
    parts = [p.frame(f"freq_o_orderpriority_{n}").select(F.lit(tab).alias("tab"), F.col(n).cast("string").alias("v"), F.col("o_orderpriority").alias("p"), "COUNT") for n, tab in (("o_orderstatus", "status"), ("y", "year"))]
    return parts[0].unionByName(parts[1])


_REPORT = "proc report data=orders out=r; column o_orderstatus o_orderpriority o_totalprice; define o_orderstatus / group; define o_orderpriority / group; define o_totalprice / analysis sum; {} run;"
_REPORT_SQL = "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS _BREAK_ FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority){})"


@query(_REPORT_SQL.format(", (o_orderstatus)"))
def proc_report_break(t: Tables):
    return rounded(_text(t, _REPORT.format("break after o_orderstatus / summarize;"), "r", "orders"), 2)


@query(_REPORT_SQL.format(", ()"))
def proc_report_rbreak(t: Tables):
    return rounded(_text(t, _REPORT.format("rbreak after / summarize;"), "r", "orders"), 2)


@query(_REPORT_SQL.format(", (o_orderstatus), ()"))
def proc_report_breaks(t: Tables):
    return rounded(_text(t, _REPORT.format("break before o_orderstatus / summarize; rbreak before / summarize;"), "r", "orders"), 2)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > 1")
def proc_sort_dupout(t: Tables):
    program = "proc sort data=orders out=s; by o_custkey o_orderdate o_orderkey; run; proc sort data=s nodupkey out=u dupout=d(keep=o_custkey o_orderkey); by o_custkey; run;"
    return _text(t, program, "d", "orders")


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS m1, round(avg(l_tax), 6) AS m2, round(quantile_cont(l_quantity, 0.99), 6) AS p1, round(quantile_cont(l_tax, 0.99), 6) AS p2 FROM lineitem GROUP BY 1")
def proc_univariate_output(t: Tables):
    return rounded(_text(t, "proc univariate data=lineitem; class l_returnflag; var l_quantity l_tax; output out=r mean=m1 m2 p99=p1 p2; run;", "r", "lineitem"), 6)


@query("SELECT r_name AS a, n_name AS b FROM region JOIN nation ON r_regionkey = n_regionkey")
def proc_datasets_rename(t: Tables):
    """CHANGE and EXCHANGE of dataset names."""
    program = "data x; set nation; k = n_regionkey; b = n_name; keep k b; run; data y; set region; k = r_regionkey; a = r_name; keep k a; run; proc datasets; change x=z; exchange z=y; quit; proc sort data=y; by k; run; data r; merge y z; by k; keep a b; run;"
    return _text(t, program, "r", "nation", "region")


# SQL: missing values, literals, INTO, INSERT, CORR
def _gaps(t: Tables):
    return t.customer.selectExpr("c_custkey", "c_nationkey", "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS v", "concat(c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN '\\\\x' ELSE '' END) AS s")


_GAPS = "x AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS v, c_mktsegment || CASE WHEN c_custkey % 5 = 0 THEN '\\x' ELSE '' END AS s FROM customer)"


def _sql(t: Tables, text: str, result: str = "r"):
    return Program(t.spark, {"x": _gaps(t), "nation": t.nation, "region": t.region, "orders": t.orders}).run(f"proc sql noprint; {text} quit;").frame(result)


@query(f"WITH {_GAPS} SELECT c_custkey FROM x WHERE v IS NULL OR v + 1 < 2000 AND c_nationkey NOT IN (3, 4)")
def sql_missing_expressions(t: Tables):
    """A missing value is less than every number in sums too, and in no list."""
    return _sql(t, "create table r as select c_custkey from x where v + 1 < 2000 and (v = . or c_nationkey not in (3, 4));")


@query(f"WITH {_GAPS}, k AS (SELECT DISTINCT v FROM x WHERE c_custkey % 3 = 0) SELECT c_custkey FROM x SEMI JOIN k ON x.v IS NOT DISTINCT FROM k.v")
def sql_missing_equals_missing(t: Tables):
    return _sql(t, "create table k as select distinct v from x where mod(c_custkey, 3) = 0; create table r as select p.c_custkey from x p, k q where p.v = q.v;")


@query(f"WITH {_GAPS} SELECT c_custkey, s FROM x WHERE s = 'BUILDING\\x' OR contains(s, 'MACH')")
def sql_literals_contains(t: Tables):
    """A backslash is an ordinary character; CONTAINS."""
    return _sql(t, "create table r as select c_custkey, s from x where s = 'BUILDING\\x' or s contains 'MACH';")


@query(f"WITH {_GAPS} SELECT c_custkey, v * 2 AS twice FROM x WHERE v * 2 > 9000")
def sql_calculated_where(t: Tables):
    return _sql(t, "create table r as select c_custkey, v * 2 as twice from x where calculated twice > 9000;")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus IN (SELECT DISTINCT o_orderstatus FROM orders WHERE o_totalprice > 300000) AND o_custkey >= (SELECT min(o_custkey) FROM orders WHERE o_totalprice > 300000)""")
def sql_into_lists(t: Tables):
    """Two targets of INTO, one of them a list."""
    p = Program(t.spark, {"orders": t.orders}).run("proc sql noprint; select distinct quote(o_orderstatus) as q, m.k into :states separated by ',', :least from orders, (select min(o_custkey) as k from orders where o_totalprice > 300000) m where o_totalprice > 300000; quit;")
    return p.run("data r; set orders; where o_orderstatus in (&states) and o_custkey >= &least; keep o_orderkey; run;").frame("r")


@query("SELECT CAST(n_nationkey AS DOUBLE) AS k, n_name AS n FROM nation UNION ALL SELECT 100, 'it''s' UNION ALL SELECT NULL, 'two' UNION ALL SELECT 101, NULL")
def sql_insert_values(t: Tables):
    """CREATE TABLE with columns, INSERT by SELECT, VALUES and SET."""
    return _sql(t, "create table r (k num, n char(30)); insert into r select n_nationkey, n_name from nation; insert into r values (100, 'it''s') values (., 'two'); insert into r set k = 101;")


@query("SELECT n_regionkey AS k FROM nation WHERE n_nationkey > 12 EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey < 2")
def sql_except_corr(t: Tables):
    return _sql(t, "create table r as select n_regionkey as k, n_name from nation where n_nationkey > 12 except corr select r_regionkey as k, r_name from region where r_regionkey < 2;")


@query(f"WITH {_GAPS} SELECT c_custkey, round(v - (SELECT avg(v) FROM x WHERE c_nationkey > 3), 6) AS d FROM x WHERE c_nationkey > 3 AND v > (SELECT avg(v) FROM x WHERE c_nationkey > 3)")
def sql_remerge_scalar(t: Tables):
    """Statistics of all rows beside every row: one row is aggregated, no window holds the table."""
    return rounded(_sql(t, "create table r as select c_custkey, v - avg(v) as d from x where c_nationkey > 3 having v > avg(v);"), 6)


# versioned libraries
@query("""WITH b AS (SELECT c_custkey AS k, c_name AS n, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal FROM supplier),
u AS (SELECT c_custkey AS k, 'new' AS n, -c_acctbal AS v FROM customer WHERE c_custkey % 11 = 0 UNION ALL SELECT c_custkey + 2000000, 'added', c_acctbal FROM customer WHERE c_custkey % 13 = 0)
SELECT * FROM u UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM u)""")
def library_upsert(t: Tables):
    """Overwrite, append, index and keyed upsert of a library's dataset, each a version."""
    d = Library(t.spark, f"{shared_folder(t.spark)}/{uuid.uuid4().hex}").versions("x")
    d.overwrite(t.customer.selectExpr("c_custkey AS k", "c_name AS n", "c_acctbal AS v").repartitionByRange(4, "k"))
    d.append(t.supplier.selectExpr("s_suppkey + 1000000 AS k", "s_name AS n", "s_acctbal AS v"))
    d.create_index("k")
    new = t.customer.where("c_custkey % 11 = 0").selectExpr("c_custkey AS k", "'new' AS n", "-c_acctbal AS v")
    d.upsert(new.unionByName(t.customer.where("c_custkey % 13 = 0").selectExpr("c_custkey + 2000000 AS k", "'added' AS n", "c_acctbal AS v")), ["k"])
    return d.read()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def library_index_lookup(t: Tables):
    """Orders of one customer through an index of the sorted dataset: only matching files are opened."""
    d = Library(t.spark, f"{shared_folder(t.spark)}/{uuid.uuid4().hex}").versions("o")
    d.overwrite(t.orders.repartitionByRange(8, "o_custkey"))
    d.create_index("o_custkey")
    return d.lookup("o_custkey", t.orders.agg(F.min("o_custkey")).first()[0]).select("o_orderkey", "o_totalprice")


# tables, merges, lookups and lines as text
@query("""WITH s AS (SELECT o_orderstatus, o_orderpriority, CAST(1 - grouping(o_orderstatus) AS VARCHAR) || CAST(1 - grouping(o_orderpriority) AS VARCHAR) AS _type_, round(sum(o_totalprice), 2) AS o_totalprice_sum, round(avg(o_totalprice), 4) AS o_totalprice_mean,
 round(100 * sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS o_totalprice_pctsum, round(CASE WHEN grouping(o_orderpriority) = 0 THEN 100.0 * count(*) / sum(CASE WHEN grouping(o_orderpriority) = 0 THEN count(*) END) OVER (PARTITION BY o_orderstatus) ELSE 100 END, 6) AS rowpctn FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus))) SELECT * FROM s""")
def proc_tabulate_algebra(t: Tables):
    """Nesting, concatenation, several statistics and percents of coarser crossings in one pass."""
    program = "proc tabulate data=orders out=r; class o_orderstatus o_orderpriority; var o_totalprice; table o_orderstatus, (o_orderpriority all)*(o_totalprice*(sum mean pctsum) rowpctn); run;"
    return rounded(_text(t, program, "r", "orders"), o_totalprice_sum=2, o_totalprice_pctsum=6, rowpctn=6)


@query("""WITH a AS (SELECT c_custkey AS k, c_name AS n, row_number() OVER (ORDER BY c_custkey) AS i FROM customer), b AS (SELECT s_suppkey AS k, s_name AS m, row_number() OVER (ORDER BY s_suppkey DESC) AS i FROM supplier)
SELECT CASE WHEN b.i IS NOT NULL THEN b.k ELSE a.k END AS k, n, m FROM a FULL JOIN b USING (i)""")
def merge_text_one_to_one(t: Tables):
    """MERGE without BY pairs rows by place."""
    program = "data a; set customer; k = c_custkey; n = c_name; keep k n; run; data b; set supplier; k = s_suppkey; m = s_name; keep k m; run; proc sort data=a; by k; run; proc sort data=b; by descending k; run; data r; merge a b; run;"
    return _text(t, program, "r", "customer", "supplier")


@query("""WITH x AS (SELECT c_nationkey AS k, 0 AS src, c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, 1, s_suppkey FROM supplier) SELECT k, src, id, CAST(row_number() OVER w AS DOUBLE) AS n, CAST(row_number() OVER (PARTITION BY k ORDER BY src, id) = 1 AS INTEGER) AS start FROM x WINDOW w AS (ORDER BY k, src, id)""")
def set_by_text(t: Tables):
    """SET of two datasets with BY interleaves them; a counter runs along the result."""
    program = """data a; set customer; k = c_nationkey; id = c_custkey; src = 0; keep k id src; run; data b; set supplier; k = s_nationkey; id = s_suppkey; src = 1; keep k id src; run;
    proc sort data=a; by k id; run; proc sort data=b; by k id; run; data r; set a b; by k; n + 1; start = first.k; run;"""
    return _text(t, program, "r", "customer", "supplier").withColumn("n", F.col("n").cast("double"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN n_name END AS n_name, CAST(CASE WHEN s_acctbal > 0 THEN CASE WHEN n_name IS NULL THEN 1 ELSE 0 END END AS INTEGER) AS rc FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey + 3""")
def hash_find_guarded(t: Tables):
    """find() under IF, with an expression as KEY:."""
    program = "data r; set supplier; declare hash h(dataset: 'nation'); h.definekey('n_nationkey'); h.definedata('n_name'); h.definedone(); if s_acctbal > 0 then rc = h.find(key: s_nationkey + 3); keep s_suppkey n_name rc; run;"
    return _text(t, program, "r", "supplier", "nation")


@query("SELECT 'large ' || CAST(o_orderkey AS VARCHAR) || ' status=' || o_orderstatus || ' day ' || strftime(o_orderdate, '%Y-%m-%d') AS line FROM orders WHERE o_totalprice > 300000")
def put_lines(t: Tables):
    """PUT of values under a condition, as rows of the dataset _log_."""
    program = Program(t.spark, {"orders": t.orders}).run("data _null_; set orders; if o_totalprice > 300000 then put 'large' o_orderkey o_orderstatus= 'day' o_orderdate yymmdd10.; run;")
    return program.frame("_log_").select(F.regexp_replace("line", "o_orderstatus=", "status=").alias("line"))


# functions and informats that had no query
@query("""SELECT l_orderkey, l_linenumber, round(greatest(l_quantity, l_tax, l_discount) - least(l_quantity, l_tax, l_discount), 6) AS r, round(l_quantity * l_quantity + l_tax * l_tax + l_discount * l_discount, 6) AS u,
round(l_quantity * l_quantity + l_tax * l_tax + l_discount * l_discount - (l_quantity + l_tax + l_discount) * (l_quantity + l_tax + l_discount) / 3, 4) AS c FROM lineitem""")
def fn_wanted_numbers(t: Tables):
    """RANGE, USS and CSS of a row's values."""
    out = _text(t, "data r; set lineitem; r = range(l_quantity, l_tax, l_discount); u = uss(l_quantity, l_tax, l_discount); c = css(l_quantity, l_tax, l_discount); keep l_orderkey l_linenumber r u c; run;", "r", "lineitem")
    return rounded(out, 6, c=4)


@query("""SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS h, CAST(round(o_totalprice, 2) AS DOUBLE) AS e, CAST((o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 50 AS DOUBLE) AS s, round(o_orderkey % 1000 / 1000.0, 6) AS p FROM orders""")
def fn_input_wanted(t: Tables):
    """Informats HEX, COMMAX, TIME and PERCENT over text made from the orders."""
    x = t.orders.selectExpr("o_orderkey", "hex(o_orderkey) AS a", "translate(format_number(o_totalprice, 2), '.,', ',.') AS b", "format_string('%02d:%02d:%02d', o_orderkey % 24, o_orderkey % 60, o_orderkey % 50) AS c", "concat(cast(o_orderkey % 1000 / 10 AS decimal(10, 1)), '%') AS d")
    out = Program(t.spark, {"x": x}).run("data r; set x; h = input(a, hex8.); e = input(b, commax20.2); s = input(c, time8.); p = input(d, percent8.); keep o_orderkey h e s p; run;").frame("r")
    return rounded(out, e=2, p=6)


@query("SELECT c_custkey, substr(c_name, 3, 5) AS a, rtrim(c_mktsegment) AS b, c_mktsegment || '-' || trim(c_name) AS c FROM customer")
def sql_text_functions(t: Tables):
    """SUBSTR, TRIM and CATX in SQL."""
    return _text(t, "proc sql; create table r as select c_custkey, substr(c_name, 3, 5) as a, trim(c_mktsegment) as b, catx('-', c_mktsegment, c_name) as c from customer; quit;", "r", "customer")


@query("""SELECT o_custkey, 'o_totalprice' AS _name_, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS F, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'O') AS O, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def transpose_let(t: Tables):
    """LET keeps the last of the rows with one ID value."""
    return _text(t, "proc sort data=orders out=s; by o_custkey o_orderdate o_orderkey; run; proc transpose data=s out=r let; by o_custkey; id o_orderstatus; var o_totalprice; run;", "r", "orders")


_CNTLIN = """data f; set orders; length label $ 20; fmtname = 'band'; start = o_orderkey * 25; end = start + 20; label = 'band ' || strip(put(o_orderkey, 12.)); keep fmtname start end label; run;
proc format cntlin=f; run;"""


@query(_BANDED.replace("'none'", "CAST(l_extendedprice AS VARCHAR)").replace("coalesce(label, CAST(l_extendedprice AS VARCHAR))", "coalesce(label, 'none')"))
def format_cntlin_text(t: Tables):
    """A format with a range for each order, read from a dataset and used by PUT."""
    out = _text(t, _CNTLIN + " data r; set lineitem; band = put(l_extendedprice, band.); if substr(band, 1, 4) ne 'band' then band = 'none'; keep l_orderkey l_linenumber band; run;", "r", "orders", "lineitem")
    return out


@query(f"WITH b AS ({_BANDS}), x AS (SELECT coalesce(label, 'none') AS band, l_quantity FROM lineitem LEFT JOIN b ON k = CAST(floor(l_extendedprice / 25) AS BIGINT) AND l_extendedprice <= high) SELECT band, count(*) AS n, round(sum(l_quantity), 2) AS total FROM x WHERE band <> 'none' GROUP BY 1")
def class_format_cntlin(t: Tables):
    """Classes are the labels of a format whose ranges are a table."""
    out = _text(t, _CNTLIN + " proc means data=lineitem nway; class l_extendedprice; format l_extendedprice band.; var l_quantity; output out=r(drop=_type_ _freq_) n=n sum=total; run;", "r", "orders", "lineitem")
    return out.where("l_extendedprice LIKE 'band%'").select(F.col("l_extendedprice").alias("band"), "n", F.round("total", 2).alias("total"))
