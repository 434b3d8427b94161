"""Queries that run statements of procedures, SQL, DATA steps and libraries as program text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from batchloom.functions import formats, text
from batchloom.lang.program import Program
from batchloom.operators import shaping, summaries
from batchloom.plans.diagnose import diagnose, run_report
from batchloom.plans.lineage import JobGraph, gate, lint, preflight
from batchloom.plans.registry import Tables, query, rounded
from batchloom.sources import Library, described, export_csv, import_csv
from batchloom.stored import shared_folder


def _run(t: Tables, program: str, result: str, *names: str, **more):
    return Program(t.spark, {n: getattr(t, n) for n in names}, **more).run(program).frame(result)


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"


# procedures
@query("SELECT o_orderstatus, CAST(sum(o_shippriority) AS DOUBLE) AS COUNT, round(100.0 * sum(o_shippriority) / sum(sum(o_shippriority)) OVER (), 6) AS PERCENT FROM (SELECT *, o_orderkey % 5 AS o_shippriority FROM orders) WHERE o_totalprice > 1000 GROUP BY 1")
def proc_freq_where(t: Tables):
    o = t.orders.withColumn("w", F.col("o_orderkey") % 5)
    out = Program(t.spark, {"orders": o}).run("proc freq data=orders; where o_totalprice > 1000; tables o_orderstatus / nocum out=r; weight w; run;").frame("r")
    return rounded(out.withColumn("COUNT", F.col("COUNT").cast("double")), 6)


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS COUNT, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS PERCENT, CAST(sum(count(*)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS BIGINT) AS CUM_FREQ FROM orders GROUP BY 1, 2")
def proc_freq_by(t: Tables):
    return rounded(_run(t, "proc freq data=orders; by o_orderpriority; tables o_orderstatus / out=r; run;", "r", "orders").drop("CUM_PCT"), 6)


@query("SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS COUNT, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS PERCENT FROM orders GROUP BY ALL")
def proc_freq_three_way(t: Tables):
    return rounded(_run(t, "data o; set orders; y = year(o_orderdate); run; proc freq data=o; tables o_orderstatus*o_orderpriority*y / out=r; run;", "r", "orders"), 6)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 100 QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) = 1")
def proc_sort_where(t: Tables):
    program = "proc sort data=customer out=s; by c_mktsegment c_custkey; run; proc sort data=s nodupkey out=u(keep=c_custkey c_mktsegment); where c_acctbal > 100; by c_mktsegment; run;"
    return _run(t, program, "u", "customer")


@query("""SELECT o_orderpriority, o_orderstatus, CASE WHEN o_orderstatus IS NULL THEN 0 ELSE 1 END::BIGINT AS _type_, count(*) AS _freq_, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority))""")
def proc_means_by_class(t: Tables):
    return rounded(_run(t, "proc means data=orders; by o_orderpriority; class o_orderstatus; var o_totalprice; output out=r sum=total; run;", "r", "orders"), 2)


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS m, round(sum(l_quantity * l_extendedprice), 2) AS s, round(sum(l_quantity), 2) AS w, count(*) AS n FROM lineitem GROUP BY 1")
def proc_means_weight(t: Tables):
    program = "proc means data=lineitem nway; class l_returnflag; var l_extendedprice; weight l_quantity; output out=r(drop=_type_ _freq_) mean=m sum=s sumwgt=w n=n; run;"
    return _run(t, program, "r", "lineitem").select("l_returnflag", F.round("m", 4).alias("m"), F.round("s", 2).alias("s"), F.round("w", 2).alias("w"), "n")


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS n, round(sum(l_linenumber * l_extendedprice), 2) AS s, CAST(sum(l_linenumber) AS BIGINT) AS _freq_ FROM lineitem GROUP BY 1")
def proc_means_freq(t: Tables):
    return rounded(_run(t, "proc means data=lineitem nway; class l_returnflag; var l_extendedprice; freq l_linenumber; output out=r(drop=_type_) n=n sum=s; run;", "r", "lineitem"), 2)


@query("SELECT l_returnflag, l_linestatus, CASE WHEN l_linestatus IS NULL THEN 2 ELSE 1 END::BIGINT AS _type_, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def proc_means_ways(t: Tables):
    return rounded(_run(t, "proc means data=lineitem; class l_returnflag l_linestatus; var l_quantity; ways 1; output out=r(drop=_freq_) sum=q; run;", "r", "lineitem"), 2)


@query("SELECT count(l_quantity) AS l_quantity_n, round(avg(l_quantity), 4) AS l_quantity_mean, round(stddev_samp(l_quantity), 4) AS l_quantity_std, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max FROM lineitem")
def proc_means_default(t: Tables):
    return rounded(_run(t, "proc means data=lineitem; var l_quantity; run;", "_means_", "lineitem").drop("_type_", "_freq_"), 4)


@query("SELECT o_orderpriority, 'total' AS _name_, max(t) FILTER (s = 'F') AS st_F, max(t) FILTER (s = 'O') AS st_O FROM (SELECT o_orderpriority, o_orderstatus AS s, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY 1, 2) GROUP BY 1")
def proc_transpose_where(t: Tables):
    program = """proc sql; create table x as select o_orderpriority, o_orderstatus, round(sum(o_totalprice), 0.01) as total from orders group by o_orderpriority, o_orderstatus order by o_orderpriority; quit;
    proc transpose data=x out=r prefix=st_; where o_orderstatus ne 'P'; by o_orderpriority; id o_orderstatus; var total; run;"""
    return _run(t, program, "r", "orders")


_BAND = "CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END"
_FORMATS = "proc format; value band low-<0='debt' 0-<5000='low' 5000-high='high'; value $seg 'BUILDING'='B' other='-'; run;"


@query(f"SELECT c_custkey, {_BAND} AS band, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE '-' END AS seg FROM customer")
def put_user_format(t: Tables):
    return _run(t, _FORMATS + "data r; set customer; band = put(c_acctbal, band.); seg = put(c_mktsegment, $seg.); keep c_custkey band seg; run;", "r", "customer")


@query(f"SELECT {_BAND} AS c_acctbal, count(*) AS _freq_, CAST(sum(c_custkey) AS BIGINT) AS k FROM customer GROUP BY 1")
def class_user_format(t: Tables):
    return _run(t, _FORMATS + "proc means data=customer nway; class c_acctbal; var c_custkey; format c_acctbal band.; output out=r(drop=_type_) sum=k; run;", "r", "customer").withColumn("k", F.col("k").cast("long"))


@query(f"SELECT c_custkey, {_BAND} AS band FROM customer")
def sql_user_format(t: Tables):
    return _run(t, _FORMATS + "proc sql; create table r as select c_custkey, put(c_acctbal, band.) as band from customer; quit;", "r", "customer")


@query(f"SELECT {_BAND} AS c_acctbal, c_mktsegment, round(avg(c_custkey), 4) AS c_custkey FROM customer WHERE c_nationkey > 3 GROUP BY 1, 2")
def proc_report_text(t: Tables):
    program = _FORMATS + "proc report data=customer nowd; where c_nationkey > 3; column c_acctbal c_mktsegment c_custkey; define c_acctbal / group format=band.; define c_mktsegment / group 'segment'; define c_custkey / analysis mean 'key'; format c_acctbal band.; run;"
    return rounded(_run(t, program, "_report_", "customer"), 4)


@query("""SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS P, round(sum(o_totalprice), 2) AS "all" FROM orders GROUP BY 1""")
def proc_tabulate_text(t: Tables):
    return rounded(_run(t, "proc tabulate data=orders; class o_orderpriority o_orderstatus; var o_totalprice; table o_orderpriority, (o_orderstatus all)*o_totalprice*sum; run;", "_tabulate_", "orders"), 2)


@query("SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS DOUBLE) AS r FROM customer WHERE c_acctbal > 0")
def proc_rank_text(t: Tables):
    return _run(t, "proc rank data=customer out=r(keep=c_custkey r) ties=low; where c_acctbal > 0; by c_mktsegment; var c_nationkey; ranks r; run;", "r", "customer").select("c_custkey", "r")


@query("SELECT s_suppkey, s_name FROM supplier")
def proc_copy_delete(t: Tables):
    place = _folder(t)
    program = f"libname lib '{place}'; proc copy in=work out=lib; select supplier nation; run; proc delete data=lib.nation supplier; run; data r; set lib.supplier; keep s_suppkey s_name; run;"
    return _run(t, program, "r", "supplier", "nation")


# SQL
@query("SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_tax * 100) AS mx, least(l_quantity, l_tax * 100) AS mn, round(l_quantity + l_tax, 4) AS s, round((l_quantity + l_discount) / 2, 4) AS m, round(l_extendedprice, 1) AS r FROM lineitem")
def sql_row_functions(t: Tables):
    out = _run(t, "proc sql; create table r as select l_orderkey, l_linenumber, max(l_quantity, l_tax * 100) as mx, min(l_quantity, l_tax * 100) as mn, sum(l_quantity, l_tax) as s, mean(l_quantity, l_discount) as m, round(l_extendedprice, 0.1) as r from lineitem; quit;", "r", "lineitem")
    return out.withColumns({"s": F.round("s", 4), "m": F.round("m", 4)})


@query("SELECT c_custkey, replace(replace(c_name, 'C', ''), '#', '') AS nm, CAST(floor((date_diff('day', DATE '1959-12-27', DATE '2024-01-03')) / 7.0) - floor(date_diff('day', DATE '1959-12-27', DATE '2023-12-20') / 7.0) AS INTEGER) AS weeks, CAST(NULL AS DATE) AS bad, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS seg FROM customer")
def sql_dialect_functions(t: Tables):
    return _run(t, "proc sql; create table r as select c_custkey, compress(c_name, 'C#') as nm, intck('WEEK', '20DEC2023'd, '03JAN2024'd) as weeks, mdy(2, 30, 2025) as bad, propcase(c_mktsegment) as seg from customer; quit;", "r", "customer")


@query("SELECT c_custkey, ratio FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS v, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE round(c_acctbal / (c_custkey % 3), 4) END AS ratio FROM customer) WHERE v IS NULL OR v < 600")
def sql_missing_rules(t: Tables):
    x = t.customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS v", "c_acctbal AS a", "c_custkey % 3 AS b")
    return Program(t.spark, {"x": x}).run("proc sql; create table r as select c_custkey, round(a / b, 0.0001) as ratio from x where v < 600; quit;").frame("r")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def sql_outobs(t: Tables):
    return _run(t, "proc sql outobs=12; create table r as select o_orderkey, o_totalprice from orders order by 2 desc, 1; quit;", "r", "orders")


@query("SELECT c_mktsegment, count(*) AS n FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 100) GROUP BY 1")
def sql_inobs(t: Tables):
    return _run(t, "proc sort data=customer out=s; by c_custkey; run; proc sql inobs=100; create table r as select c_mktsegment, count(*) as n from s group by c_mktsegment; quit;", "r", "customer")


@query("SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 3")
def sql_remerge_text(t: Tables):
    return rounded(_run(t, "proc sql; create table r as select o_orderkey, o_totalprice / sum(o_totalprice) as share from orders group by o_custkey having count(o_orderkey) > 3; quit;", "r", "orders"), 6)


@query("SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (), 4) AS off FROM customer")
def sql_remerge_all(t: Tables):
    return rounded(_run(t, "proc sql; create table r as select c_custkey, c_acctbal - mean(c_acctbal) as off from customer; quit;", "r", "customer"), 4)


@query("SELECT c_custkey AS k, c_name AS name, CAST(NULL AS VARCHAR) AS place FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def sql_outer_union_text(t: Tables):
    return _run(t, "proc sql; create table r as select c_custkey as k, c_name as name from customer outer union corr select s_name as place, s_suppkey as k from supplier; quit;", "r", "customer", "supplier")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10")
def sql_having_calculated(t: Tables):
    return _run(t, "proc sql; create table r as select o_orderstatus, count(*) as n from orders group by o_orderstatus having calculated n > 10; quit;", "r", "orders")


@query("SELECT c_custkey, c_acctbal * 2 AS dbl FROM customer WHERE c_acctbal > 0")
def sql_in_job_text(t: Tables):
    return _run(t, "%let least = 0; proc sql; create table a as select c_custkey, c_acctbal * 2 as dbl from customer where c_acctbal > &least; quit; data r; set a; run;", "r", "customer")


@query("SELECT o_orderkey, o_orderstatus, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS n, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def sql_monotonic_where(t: Tables):
    return _run(t, "proc sort data=orders out=s; by o_totalprice o_orderkey; run; proc sql; create table r as select o_orderkey, o_orderstatus, monotonic() as n, o_totalprice from s where o_orderstatus = 'F'; quit;", "r", "orders").withColumn("n", F.col("n").cast("long"))


@query("SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE c_acctbal END FROM customer WHERE CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE c_acctbal END >= 0")
def sql_insert_update_delete(t: Tables):
    program = """proc sql; create table r as select s_suppkey as k, s_acctbal as v, 0 as even from supplier;
    insert into r select c_custkey, c_acctbal, mod(c_custkey, 2) = 0 from customer;
    update r set v = 0.0 where even = 1; delete from r where v < 0; quit; data r; set r; drop even; run;"""
    return _run(t, program, "r", "supplier", "customer")


# DATA steps
@query("SELECT event_id, lag(value) OVER w AS a, lag(value, 2) OVER w AS b, value - lag(value) OVER w AS d FROM events WINDOW w AS (ORDER BY user_id, ts, event_id)")
def lag_text(t: Tables):
    return _run(t, "proc sort data=events out=s; by user_id ts event_id; run; data r; set s; by user_id; a = lag(value); b = lag2(value); d = dif(value); keep event_id a b d; run;", "r", "events")


@query("""WITH a AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
b AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
g AS (SELECT coalesce(x.k, y.k) AS k, x.n AS na, y.n AS nb, unnest(range(1, greatest(coalesce(x.n, 0), coalesce(y.n, 0)) + 1)) AS i FROM (SELECT DISTINCT k, n FROM a) x FULL JOIN (SELECT DISTINCT k, n FROM b) y ON x.k = y.k)
SELECT g.k, c_custkey, s_suppkey FROM g LEFT JOIN a ON a.k = g.k AND a.i = least(g.i, na) LEFT JOIN b ON b.k = g.k AND b.i = least(g.i, nb)""")
def merge_text_many_to_many(t: Tables):
    program = """data a; set customer; k = c_nationkey; keep k c_custkey; run; data b; set supplier; k = s_nationkey; keep k s_suppkey; run;
    proc sort data=a; by k c_custkey; run; proc sort data=b; by k s_suppkey; run; data r; merge a b; by k; run;"""
    return _run(t, program, "r", "customer", "supplier")


@query("SELECT c_custkey, n_name, CASE WHEN n_name IS NULL THEN 1 ELSE 0 END AS rc FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey + 5")
def hash_text(t: Tables):
    """Keys are shifted, so that some customers find no nation."""
    program = """data later; set nation; c_nationkey = n_nationkey + 5; run; proc sort data=later; by n_nationkey; run;
    data r; set customer; declare hash h(dataset: 'later'); h.defineKey('c_nationkey'); h.defineData('n_name'); h.defineDone(); rc = h.find(); keep c_custkey n_name rc; run;"""
    return _run(t, program, "r", "customer", "nation")


@query("SELECT s_suppkey, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_acctbal + 1 > 0 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey = 1")
def library_in_place(t: Tables):
    """A step, a sort, SQL and an append that all rewrite the dataset they read."""
    place = _folder(t)
    program = f"""libname lib '{place}'; data lib.y; set supplier; keep s_suppkey s_acctbal; run; data first; set lib.y; where s_suppkey = 1; run;
    data lib.y; set lib.y; s_acctbal = s_acctbal + 1; run; proc sort data=lib.y; by s_suppkey; run; proc sql; delete from lib.y where s_acctbal <= 0; quit; proc append base=lib.y data=first; run;"""
    return _run(t, program, "lib.y", "supplier")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT NULL, 'none'")
def library_append(t: Tables):
    """Rows appended twice, one of them without a key, are there once."""
    library = Library(t.spark, _folder(t))
    x = t.nation.select("n_nationkey", "n_name")
    library.write(x.where("n_nationkey < 5"), "n")
    more = x.unionByName(t.spark.createDataFrame([(None, "none")], x.schema))
    for _ in range(2):
        library.append(more, "n", ["n_nationkey"], ["n_name"])
    return library.read("n")


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def csv_round_trip(t: Tables):
    place = _folder(t)
    export_csv(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), place, ";")
    return import_csv(t.spark, place, ";", schema="o_orderkey long, o_totalprice double, o_orderpriority string")


@query("SELECT s_suppkey, s_name FROM supplier")
def proc_import_export(t: Tables):
    place = _folder(t)
    return _run(t, f"proc export data=supplier outfile='{place}' dbms=csv replace; run; proc import datafile='{place}' out=r dbms=csv; getnames=yes; run;", "r", "supplier").selectExpr("cast(s_suppkey as bigint) as s_suppkey", "s_name")


# functions and formats
@query("""SELECT o_orderkey, CAST(second(o_orderdate) AS INTEGER) AS s, o_orderdate::DATE + INTERVAL (3723) SECOND AS dt, DATE '2024-02-29' AS today, TIMESTAMP '2024-02-29 10:20:30' AS now, 37230.0::DOUBLE AS clock, DATE '2024-02-29' - o_orderdate::DATE AS act,
CAST((2024 - year(o_orderdate)) * 360 + (2 - month(o_orderdate)) * 30 + 29 - least(day(o_orderdate), 30) AS INTEGER) AS d360 FROM orders""")
def fn_moments(t: Tables):
    program = "data r; set orders; s = second(o_orderdate); dt = dhms(datepart(o_orderdate), 1, 2, 3); today = today(); now = datetime(); clock = time(); act = datdif(datepart(o_orderdate), today(), 'ACT/ACT'); d360 = datdif(datepart(o_orderdate), today(), '30/360'); keep o_orderkey s dt today now clock act d360; run;"
    out = _run(t, program, "r", "orders", run_at="2024-02-29 10:20:30")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("dt", "now")}).withColumn("act", F.col("act").cast("long"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS plain, array_to_string(list_transform(string_split(lower(p_brand), '#'), lambda w: upper(w[1:1]) || w[2:]), '#') AS parts FROM part")
def fn_propcase(t: Tables):
    return t.part.select("p_partkey", text.propcase(F.col("p_type")).alias("plain"), text.propcase(F.col("p_brand"), "#").alias("parts"))


@query("SELECT event_id, date_trunc('second', ts) AS a, date_trunc('second', ts) AS b, date_trunc('second', ts) AS c, CAST(NULL AS TIMESTAMP) AS d FROM events")
def fn_input_datetimes(t: Tables):
    ts = F.col("ts").cast("timestamp")
    made = {"a": F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), "b": formats.put(ts, "E8601DT."), "c": formats.put(ts, "DATETIME20."), "d": F.lit("no time")}
    return t.events.select("event_id", *[formats.input_(v, "ANYDTDTM.").cast("timestamp_ntz").alias(k) for k, v in made.items()])


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS time8, strftime(ts, '%H:%M') AS hhmm, lpad(CAST(event_id % 30 AS VARCHAR), 2, '0') || ':00:05' AS secs FROM events")
def fn_put_times(t: Tables):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", formats.put(ts, "TIME8.").alias("time8"), formats.put(ts, "HHMM5.").alias("hhmm"), formats.put(F.col("event_id") % 30 * 3600 + 5, "TIME8.").alias("secs"))


@query("SELECT l_orderkey, l_linenumber, rtrim(rtrim(printf('%.2f', l_extendedprice), '0'), '.') AS b, CASE WHEN l_discount = 0 THEN '0' ELSE rtrim(rtrim(printf('%.2f', l_discount), '0'), '.') END AS small, '1E-12' AS tiny, '0.3333333333' AS third, '1/3' AS fract FROM lineitem")
def fn_put_best(t: Tables):
    k = t.lineitem.select("l_orderkey", "l_linenumber", formats.put(F.col("l_extendedprice"), "BEST12.").alias("b"), formats.put(F.col("l_discount"), "BEST12.").alias("small"), formats.put(F.lit(1e-12), "BEST12.").alias("tiny"), formats.put(F.lit(1 / 3), "BEST12.").alias("third"), formats.put(F.lit(1 / 3), "FRACT8.").alias("fract"))
    return k


@query("SELECT c_custkey, c_acctbal - floor(c_acctbal) > 0.5 AS up, 'ABC' AS e FROM customer")
def fn_ebcdic(t: Tables):
    code = F.lit("ÁÂÃ")
    return t.customer.select("c_custkey", (F.col("c_acctbal") - F.floor("c_acctbal") > 0.5).alias("up"), formats.input_(code, "$EBCDIC3.").alias("e"))


# whole tables without groups
@query("SELECT o_orderkey, CAST(rank() OVER (ORDER BY o_custkey) AS DOUBLE) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2 AS r FROM orders")
def rank_all(t: Tables):
    return shaping.rank(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "r").select("o_orderkey", "r")


@query("SELECT l_partkey, count(*) AS COUNT, CAST(sum(count(*)) OVER (ORDER BY l_partkey) AS BIGINT) AS CUM_FREQ FROM lineitem GROUP BY 1")
def freq_many_values(t: Tables):
    return summaries.frequencies(t.lineitem, "l_partkey").select("l_partkey", "COUNT", "CUM_FREQ")


@query("""SELECT 's_acctbal' AS "column", count(*) AS count, round(avg(s_acctbal), 4) AS mean, round(stddev_samp(s_acctbal), 4) AS std FROM supplier UNION ALL SELECT 's_name', count(*), NULL, NULL FROM supplier""")
def table_described(t: Tables):
    return rounded(described(t.supplier.select("s_acctbal", "s_name")).select("column", "count", "mean", "std"), 4)


# programs as data
_PROGRAMS = {"a": "data stage.x; set raw.s; run;", "b": "proc append base=mart.y data=stage.x; run;", "c": "data mart.z; merge mart.y raw.gone; by k; d = today(); run;"}


@query("SELECT * FROM (VALUES ('RAW.S', 'present'), ('RAW.GONE', 'missing_source'), ('STAGE.X', 'missing_upstream'), ('MART.Y', 'missing_upstream')) AS v(dataset, status)")
def preflight_status(t: Tables):
    return preflight(t.spark, _PROGRAMS, exists=lambda name: name == "RAW.S")


@query("SELECT * FROM (VALUES ('b', 'append_not_idempotent'), ('c', 'many_to_many_merge'), ('c', 'run_date')) AS v(job, lint)")
def lint_findings(t: Tables):
    return t.spark.createDataFrame([(job, name) for job, program in _PROGRAMS.items() for name, _ in lint(program)], "job string, lint string")


@query("SELECT * FROM (VALUES ('a', ''), ('b', 'a'), ('c', 'b')) AS v(task_key, depends_on)")
def workflow_tasks(t: Tables):
    graph = JobGraph()
    for name, program in _PROGRAMS.items():
        graph.add(name, program)
    return t.spark.createDataFrame([(x["task_key"], ",".join(x["depends_on"])) for x in graph.to_workflow()["tasks"]], "task_key string, depends_on string")


@query("SELECT * FROM (VALUES ('STRICT', 0, 'PASS'), ('STRICT', 1, 'BLOCK'), ('LENIENT', 1, 'WARN'), ('LENIENT', 2, 'BLOCK'), ('FORCE', 9, 'WARN'), ('SKIP', 9, 'SKIP')) AS v(mode, missing, result)")
def gate_results(t: Tables):
    cases = [("STRICT", 0), ("STRICT", 1), ("LENIENT", 1), ("LENIENT", 2), ("FORCE", 9), ("SKIP", 9)]
    return t.spark.createDataFrame([(mode, n, gate(n, 10, mode)) for mode, n in cases], "mode string, missing int, result string")


@query("SELECT * FROM (VALUES ('no_table', 'program'), ('no_column', 'unresolved_column'), ('text_number', 'bad_value'), ('dynamic', 'unsupported')) AS v(name, category)")
def error_categories(t: Tables):
    def of(run) -> str:
        try:
            run()
        except Exception as e:  # the error is what is asked for
            return diagnose(e).category
        return "none"

    p = Program(t.spark, {"nation": t.nation})
    cases = {"no_table": lambda: p.run("data r; set nothing; run;"), "no_column": lambda: t.nation.select("nope"), "text_number": lambda: t.nation.selectExpr("cast(n_name as int)").collect(), "dynamic": lambda: p.run("proc glm data=nation; run;")}
    return t.spark.createDataFrame([(k, of(f)) for k, f in cases.items()], "name string, category string")


@query("SELECT * FROM (VALUES ('a', 'DONE', 2.0, NULL), ('b', 'FAILED', 1.0, 'program'), ('*', '1 of 2 done', 3.0, NULL)) AS v(job, status, seconds, category)")
def run_report_rows(t: Tables):
    return run_report(t.spark, [("a", "DONE", 2, None), ("b", "FAILED", 1, ValueError("x"))]).drop("advice")


@query("SELECT user_id, CAST(sum(new) AS BIGINT) AS n FROM (SELECT user_id, CASE WHEN coalesce(value, 0) > 10 THEN 1 ELSE 0 END AS new FROM events) GROUP BY 1")
def put_log_count(t: Tables):
    """PUT under a condition: lines of the log, counted by the user they name."""
    log = Program(t.spark, {"events": t.events}).run("data _null_; set events; if value > 10 then put user_id=; run;").frame("_log_")
    lines = log.select(F.regexp_extract("line", r"^user_id=(\d+)$", 1).cast("long").alias("user_id")).groupBy("user_id").agg(F.count("*").alias("n"))
    return t.events.select("user_id").distinct().join(lines, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("n"))

