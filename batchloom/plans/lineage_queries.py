"""Queries of reconciliation, inventory and job order."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchloom.plans import lineage_tables as lt
from batchloom.plans.lineage import JobGraph, inventory
from batchloom.plans.reconcile import reconcile
from batchloom.plans.registry import Tables, query
from batchloom.sources import table_statistics

_PROGRAMS = {
    "load": "libname raw '/in'; data stage.clients; set raw.clients; run;",
    "score": "proc sql; create table mart.score as select * from stage.clients c, raw.usage u where c.id = u.id; quit;",
    "report": "proc means data=mart.score; var x; output out=mart.summary mean=m; run; data work.t; set work.u; run;",
}


@query("""SELECT 'row_count' AS "check", CAST(count(*) AS DOUBLE) AS expected, CAST(count(*) AS DOUBLE) AS actual, true AS ok FROM orders UNION ALL SELECT 'distinct_keys', count(DISTINCT o_orderkey), count(DISTINCT o_orderkey), true FROM orders UNION ALL SELECT 'sum_o_totalprice', round(sum(o_totalprice), 2), round(sum(o_totalprice), 2), true FROM orders
UNION ALL SELECT 'damaged_text', 0, 0, true UNION ALL SELECT 'missing_rows', 0, 0, true UNION ALL SELECT 'extra_rows', 0, 0, true""")
def reconcile_ok(t: Tables):
    out = reconcile(t.orders, t.orders.orderBy("o_orderdate"), ["o_orderkey"], ["o_totalprice"])
    return out.withColumns({c: F.round(c, 2) for c in ("expected", "actual")})


@query("""SELECT "check", round(expected, 2) AS expected, round(actual, 2) AS actual, ok FROM (SELECT 'row_count' AS "check", CAST(count(*) AS DOUBLE) AS expected, CAST(count(*) FILTER (o_orderkey % 10 <> 0) AS DOUBLE) AS actual, false AS ok FROM orders UNION ALL SELECT 'distinct_keys', count(DISTINCT o_orderkey), count(DISTINCT o_orderkey) FILTER (o_orderkey % 10 <> 0), false FROM orders
UNION ALL SELECT 'sum_o_totalprice', sum(o_totalprice), sum(o_totalprice) FILTER (o_orderkey % 10 <> 0), false FROM orders UNION ALL SELECT 'damaged_text', 0, 0, true UNION ALL SELECT 'missing_rows', 0, count(*) FILTER (o_orderkey % 10 = 0), false FROM orders UNION ALL SELECT 'extra_rows', 0, 0, true)""")
def reconcile_diff(t: Tables):
    out = reconcile(t.orders, t.orders.where("o_orderkey % 10 <> 0"), ["o_orderkey"], ["o_totalprice"])
    return out.withColumns({c: F.round(c, 2) for c in ("expected", "actual")})


@query("""SELECT * FROM (VALUES ('MART.SCORE', 'INTERMEDIATE', 'report', 'score'), ('MART.SUMMARY', 'TARGET', '', 'report'), ('RAW.CLIENTS', 'SOURCE', 'load', ''), ('RAW.USAGE', 'SOURCE', 'score', ''), ('STAGE.CLIENTS', 'INTERMEDIATE', 'score', 'load')) AS v(dataset, role, readers, writers)""")
def inventory_roles(t: Tables):
    return inventory(t.spark, _PROGRAMS)


@query("SELECT * FROM (VALUES (1, 'load'), (2, 'score'), (3, 'report')) AS v(n, job)")
def execution_order(t: Tables):
    graph = JobGraph()
    for name, text in _PROGRAMS.items():
        graph.add(name, text)
    return t.spark.createDataFrame(list(enumerate(graph.order(), 1)), "n int, job string")


@query("SELECT 'n_nationkey' AS \"column\", count(*) AS rows, CAST(0 AS BIGINT) AS missing FROM nation UNION ALL SELECT 'n_name', count(*), 0 FROM nation UNION ALL SELECT 'n_regionkey', count(*), 0 FROM nation")
def table_stats(t: Tables):
    return table_statistics(t.nation).select("column", "rows", "missing")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(value) AS n, round(sum(value), 4) AS sum, count(*) AS _FREQ_ FROM events GROUP BY ALL")
def windowed_means(t: Tables):
    from batchloom.streaming import windowed_means as windowed

    out = windowed(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", ["N", "SUM"], ["event_type"], every="1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("sum", 4).alias("sum"), "_FREQ_")


# lineage of a table of programs: one for each nation, customer and order
def _programs(t: Tables):
    load = t.nation.selectExpr("concat('load_', n_nationkey) AS job", "concat('/* data x; */ libname raw ''/in''; data stage.nation', n_nationkey, '; set raw.region', n_regionkey, '; run;') AS text")
    cust = t.customer.selectExpr("concat('cust_', c_custkey) AS job", "concat('data mart.cust', c_custkey, '; set stage.nation', c_nationkey, '; by k; retain n 0; run;') AS text")
    order = t.orders.selectExpr("concat('order_', o_orderkey) AS job", "concat('proc sql; create table mart.order', o_orderkey, ' as select * from mart.cust', o_custkey, ' c, raw.rates r where c.id ne r.id; quit; proc means data=mart.order', o_orderkey, '; run;') AS text")
    return load.unionByName(cust).unionByName(order)


_USES = """u AS (SELECT 'load_' || n_nationkey AS job, 'RAW.REGION' || n_regionkey AS r, 'STAGE.NATION' || n_nationkey AS w FROM nation UNION ALL SELECT 'cust_' || c_custkey, 'STAGE.NATION' || c_nationkey, 'MART.CUST' || c_custkey FROM customer
 UNION ALL SELECT 'order_' || o_orderkey, 'MART.CUST' || o_custkey, 'MART.ORDER' || o_orderkey FROM orders UNION ALL SELECT 'order_' || o_orderkey, 'RAW.RATES', NULL FROM orders UNION ALL SELECT 'order_' || o_orderkey, 'MART.ORDER' || o_orderkey, NULL FROM orders),
i AS (SELECT dataset, sum(r) AS readers, sum(w) AS writers FROM (SELECT r AS dataset, 1 AS r, 0 AS w FROM u UNION ALL SELECT w, 0, 1 FROM u WHERE w IS NOT NULL) GROUP BY 1),
inv AS (SELECT dataset, CASE WHEN readers > 0 AND writers > 0 THEN 'INTERMEDIATE' WHEN readers > 0 THEN 'SOURCE' ELSE 'TARGET' END AS role, CAST(readers AS BIGINT) AS readers, CAST(writers AS BIGINT) AS writers FROM i)"""


@query("""SELECT construct, tier, count(*) AS n, count(DISTINCT job) AS jobs FROM (SELECT 'load_' || n_nationkey AS job, unnest(['LIBNAME', 'DATA_STEP_SIMPLE']) AS construct, 'RULE' AS tier FROM nation UNION ALL SELECT 'cust_' || c_custkey, 'DATA_STEP_COMPLEX', 'LLM' FROM customer
UNION ALL SELECT 'order_' || o_orderkey, 'PROC_SQL', 'RULE' FROM orders UNION ALL SELECT 'order_' || o_orderkey, 'PROC_MEANS', 'LLM' FROM orders) GROUP BY ALL""")
def program_blocks(t: Tables):
    """Blocks of every program by construct."""
    return lt.block_table(_programs(t)).groupBy("construct", "tier").agg(F.count("*").alias("n"), F.countDistinct("job").alias("jobs"))


@query(f"WITH {_USES} SELECT * FROM inv")
def program_inventory(t: Tables):
    """Role, readers and writers of every dataset that the programs name."""
    return lt.inventory_table(lt.uses(lt.block_table(_programs(t))))


@query("""SELECT 'load_' || n_nationkey AS job, 1 AS level FROM nation UNION ALL SELECT 'cust_' || c_custkey, CASE WHEN n_nationkey IS NULL THEN 1 ELSE 2 END FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'order_' || o_orderkey, CASE WHEN c_custkey IS NULL THEN 1 WHEN n_nationkey IS NULL THEN 2 ELSE 3 END FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def program_levels(t: Tables):
    """The level of every job: what can run together, in which order."""
    return lt.job_levels(lt.uses(lt.block_table(_programs(t))))


@query("SELECT 'cust_' || c_custkey AS job, 'order_sensitive' AS lint FROM customer UNION ALL SELECT 'order_' || o_orderkey, 'null_filter' FROM orders")
def program_lints(t: Tables):
    return lt.lint_table(_programs(t)).select("job", "lint")


def _preflight(t: Tables):
    known = t.region.where("r_regionkey <> 2").selectExpr("concat('raw.region', r_regionkey) AS dataset").unionByName(t.orders.where("o_orderkey % 5 = 0").selectExpr("concat('mart.order', o_orderkey) AS dataset"))
    return lt.preflight_table(lt.inventory_table(lt.uses(lt.block_table(_programs(t)))), known)


_PREFLIGHT = f"""WITH {_USES}, k AS (SELECT 'RAW.REGION' || r_regionkey AS dataset FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'MART.ORDER' || o_orderkey FROM orders WHERE o_orderkey % 5 = 0),
p AS (SELECT inv.dataset, CASE WHEN k.dataset IS NOT NULL THEN 'present' WHEN writers > 0 THEN 'missing_upstream' ELSE 'missing_source' END AS status FROM inv LEFT JOIN k USING (dataset) WHERE readers > 0)"""


@query(_PREFLIGHT + " SELECT * FROM p")
def program_preflight(t: Tables):
    """Whether everything that the programs read is there, comes from another job, or from nowhere."""
    return _preflight(t)


@query(_PREFLIGHT + """, c AS (SELECT count(*) FILTER (status = 'missing_source') AS missing, count(*) AS total FROM p)
SELECT mode, missing, total, CASE WHEN mode = 'SKIP' THEN 'SKIP' WHEN missing = 0 THEN 'PASS' WHEN mode = 'FORCE' OR mode = 'LENIENT' AND missing < 0.2 * total THEN 'WARN' ELSE 'BLOCK' END AS result FROM c, (VALUES ('STRICT'), ('LENIENT'), ('FORCE'), ('SKIP')) AS m(mode)""")
def program_gate(t: Tables):
    return lt.gate_table(_preflight(t))
