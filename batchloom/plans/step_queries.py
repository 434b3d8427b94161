"""Queries of DATA-step statements, merges, order-sensitive state, sorts, transposes and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchloom import missing as m
from batchloom.operators import datastep as d
from batchloom.operators import merging as j
from batchloom.operators import shaping as h
from batchloom.plans.registry import Tables, long, query, rounded


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 1000 AND c_mktsegment = 'BUILDING'")
def ds_where_keep(t: Tables):
    return t.customer.where("c_acctbal > 1000 AND c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")


@query("SELECT o_orderkey AS order_id, o_custkey, o_totalprice AS amount FROM orders WHERE o_totalprice > 100000")
def ds_drop_rename(t: Tables):
    return d.options(t.orders, where="amount > 100000", drop=["o_orderstatus", "o_orderdate", "o_orderpriority"], rename={"o_orderkey": "order_id", "o_totalprice": "amount"})


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' WHEN c_acctbal < 5000 THEN 'LOW' ELSE 'HIGH' END AS band FROM customer")
def ds_if_else(t: Tables):
    return t.customer.select("c_custkey", d.choose((F.col("c_acctbal") < 0, "DEBT"), (F.col("c_acctbal") < 5000, "LOW"), otherwise="HIGH").alias("band"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * 1 AS l_quantity, l_discount * 2 AS l_discount, l_tax * 3 AS l_tax FROM lineitem")
def ds_array_unroll(t: Tables):
    arr = ["l_quantity", "l_discount", "l_tax"]
    return t.lineitem.select("l_orderkey", "l_linenumber", *arr).withColumns(d.over_array(arr, lambda c, i: c * i))


@query("SELECT p_partkey, CAST(i AS INTEGER) AS i, round(p_retailprice * i, 2) AS price FROM part, unnest(range(1, 4)) AS u(i)")
def ds_do_output_explode(t: Tables):
    return d.output_each(t.part, 1, 3).select("p_partkey", "i", F.round(F.col("p_retailprice") * F.col("i"), 2).alias("price"))


@query("SELECT 'open' AS target, count(*) AS n FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'big', count(*) FROM orders WHERE o_totalprice > 200000")
def ds_multi_output(t: Tables):
    out = d.outputs(t.orders, open=F.col("o_orderstatus") == "O", big=F.col("o_totalprice") > 200000)
    return d.concatenate(*[f.agg(F.count("*").alias("n")).select(F.lit(k).alias("target"), "n") for k, f in out.items()])


@query("SELECT l_orderkey, l_linenumber, CAST((l_discount > 0.05) AS INTEGER) + CAST((l_quantity > 25) AS INTEGER) AS score FROM lineitem")
def ds_bool_arith(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", (m.number(F.col("l_discount") > 0.05) + m.number(F.col("l_quantity") > 25)).alias("score"))


@query("SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, CAST(NULL AS VARCHAR) AS extra FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier")
def ds_set_concat(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    b = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit("supplier").alias("extra"))
    return d.concatenate(a, b)


@query("SELECT k, name, row_number() OVER (ORDER BY k, src, name) AS n FROM (SELECT c_custkey AS k, c_name AS name, 0 AS src FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier)")
def ds_set_interleave(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    b = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return d.numbered(d.interleave([a.withColumn("src", F.lit(0)), b.withColumn("src", F.lit(1))], ["k"]), ["k", "src", "name"], "n").drop("src")


@query("SELECT c_custkey, substr(c_name, 1, 10) AS c_name FROM customer")
def ds_length_trunc(t: Tables):
    return d.truncate(t.customer.select("c_custkey", "c_name"), c_name=10)


@query("""WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer)
SELECT c_custkey, CAST((v IS NULL OR v < 100) AS INTEGER) AS lt, CAST(coalesce(v > 100, false) AS INTEGER) AS gt, CAST((v IS DISTINCT FROM 100) AS INTEGER) AS ne, round(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE v / (c_custkey % 3) END, 6) AS ratio FROM x""")
def null_safe_compare(t: Tables):
    x = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("v"))
    v = F.col("v")
    return x.select("c_custkey", m.number(m.less(v, 100)).alias("lt"), m.number(m.greater(v, 100)).alias("gt"), m.number(m.not_equal(v, 100.0)).alias("ne"), F.round(m.divide(v, F.col("c_custkey") % 3), 6).alias("ratio"))


@query("SELECT c_custkey, CAST(NULL AS DOUBLE) AS c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer")
def ds_call_missing(t: Tables):
    return d.call_missing(t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), "c_acctbal", "c_mktsegment")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < TIMESTAMP '1998-03-01 00:00:00'")
def ds_date_literals(t: Tables):
    return t.orders.where("o_orderdate >= DATE'1998-01-01' AND o_orderdate < TIMESTAMP'1998-03-01 00:00:00'").select("o_orderkey", "o_orderdate")


_CUST = "(SELECT c_custkey + 10 AS k, c_name, c_acctbal FROM customer)"
_ORD = "(SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)"


def _customers(t: Tables):
    """Keys are moved by ten, so that some on either side have no match."""
    return t.customer.select((F.col("c_custkey") + 10).alias("k"), "c_name", "c_acctbal")


def _totals(t: Tables):
    return t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"SELECT k, c_name, c_acctbal, n, total FROM {_CUST} JOIN {_ORD} USING (k)")
def merge_inner(t: Tables):
    return j.merge(_customers(t), _totals(t), ["k"], "inner")


@query(f"SELECT k, c_name, c_acctbal, n, total FROM {_CUST} LEFT JOIN {_ORD} USING (k)")
def merge_left(t: Tables):
    return j.merge(_customers(t), _totals(t), ["k"], "left")


@query(f"SELECT k, c_name, c_acctbal, n, total FROM {_CUST} RIGHT JOIN {_ORD} USING (k)")
def merge_right(t: Tables):
    return j.merge(_customers(t), _totals(t), ["k"], "right")


@query(f"SELECT k, c_name, c_acctbal, n, total FROM {_CUST} FULL JOIN {_ORD} USING (k)")
def merge_full(t: Tables):
    return j.merge(_customers(t), _totals(t), ["k"])


@query(f"SELECT k, c_name, c_acctbal, CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS total FROM {_CUST} WHERE k NOT IN (SELECT k FROM {_ORD})")
def merge_left_anti(t: Tables):
    return j.merge(_customers(t), _totals(t), ["k"], "left_only")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def left_semi(t: Tables):
    return t.customer.join(t.orders.where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query(f"SELECT k, c_name, c_acctbal, n, total, CASE WHEN c.c_name IS NULL THEN 0 ELSE 1 END AS ina, CASE WHEN o.n IS NULL THEN 0 ELSE 1 END AS inb FROM {_CUST} c FULL JOIN {_ORD} o USING (k)")
def merge_both_flags(t: Tables):
    return j.merge(_customers(t), _totals(t), ["k"], flags=("ina", "inb"))


@query("""WITH a AS (SELECT c_name, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS p FROM customer), b AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS p FROM orders) SELECT c_name, c_acctbal, o_orderkey, o_totalprice FROM a FULL JOIN b USING (p)""")
def merge_one_to_one(t: Tables):
    out = j.merge_one_to_one(t.customer, t.orders, ["c_acctbal", "c_custkey"], ["o_totalprice", "o_orderkey"])
    return out.select("c_name", "c_acctbal", "o_orderkey", "o_totalprice")


@query("""WITH a AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
b AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
g AS (SELECT coalesce(x.k, y.k) AS k, x.n AS na, y.n AS nb, unnest(range(1, greatest(coalesce(x.n, 0), coalesce(y.n, 0)) + 1)) AS i FROM (SELECT DISTINCT k, n FROM a) x FULL JOIN (SELECT DISTINCT k, n FROM b) y ON x.k = y.k)
SELECT g.k, c_custkey, s_suppkey FROM g LEFT JOIN a ON a.k = g.k AND a.i = least(g.i, na) LEFT JOIN b ON b.k = g.k AND b.i = least(g.i, nb)""")
def merge_sequential(t: Tables):
    a = t.customer.select(F.col("c_nationkey").alias("k"), "c_custkey")
    b = t.supplier.select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return j.merge_sequential(a, b, ["k"], ["c_custkey"], ["s_suppkey"])


@query("""WITH t AS (SELECT c_custkey + 10 AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_acctbal + 1 END AS c_acctbal FROM customer)
SELECT coalesce(m.c_custkey, t.c_custkey) AS c_custkey, m.c_name, coalesce(t.c_acctbal, m.c_acctbal) AS c_acctbal FROM customer m FULL JOIN t ON m.c_custkey = t.c_custkey""")
def update_master(t: Tables):
    trans = t.customer.select((F.col("c_custkey") + 10).alias("c_custkey"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    return j.update(t.customer.select("c_custkey", "c_name", "c_acctbal"), trans, ["c_custkey"])


@query("SELECT c_custkey, n_name, CASE WHEN n_name IS NULL THEN 0 ELSE 1 END AS rc FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey + 5")
def hash_lookup(t: Tables):
    table = t.nation.withColumn("c_nationkey", F.col("n_nationkey") + 5)  # keys are shifted, so that some customers find no nation
    return j.hash_lookup(t.customer.select("c_custkey", "c_nationkey"), table, ["c_nationkey"], ["n_name"], found="rc").drop("c_nationkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus = 'F'")
def left_join_on_between(t: Tables):
    on = (F.col("c_custkey") == F.col("o_custkey")) & F.col("o_totalprice").between(1000, 50000) & (F.col("o_orderstatus") == "F")
    return t.customer.join(t.orders, on, "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P'")
def outer_to_inner(t: Tables):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").where("o_orderstatus = 'P'").select("c_custkey", "o_orderkey")


@query("SELECT r_name, s.o_orderstatus FROM region CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) s")
def cross_sparse(t: Tables):
    return t.region.select("r_name").crossJoin(t.orders.select("o_orderstatus").distinct())


@query("SELECT p_partkey, label FROM part JOIN (VALUES (0.0, 1000.0, 'low'), (1000.0, 1500.0, 'mid'), (1500.0, 1e9, 'high')) AS b(lo, hi, label) ON p_retailprice >= lo AND p_retailprice < hi")
def range_join(t: Tables):
    bands = t.spark.createDataFrame([(0.0, 1000.0, "low"), (1000.0, 1500.0, "mid"), (1500.0, 1e9, "high")], "lo double, hi double, label string")
    return t.part.join(F.broadcast(bands), (F.col("p_retailprice") >= F.col("lo")) & (F.col("p_retailprice") < F.col("hi"))).select("p_partkey", "label")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def join_cardinality(t: Tables):
    return j.duplicate_keys(t.orders, ["o_custkey"])


def _events(t: Tables):
    return t.events, d.spec(["user_id"], ["ts", "event_id"])


@query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS total FROM events")
def retain_running_sum(t: Tables):
    e, w = _events(t)
    return e.select("event_id", "user_id", F.round(d.running_sum("value", w), 6).alias("total"))


@query("""WITH x AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, round(CASE WHEN sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER w = 0 THEN sum(v) OVER w END, 6) AS strict FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def retain_strict_sum(t: Tables):
    e, w = _events(t)
    e = e.withColumn("v", F.when(F.col("event_id") % 50 != 0, F.col("value")))
    return e.select("event_id", F.round(d.running_sum("v", w, skip_missing=False), 6).alias("strict"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
def retain_counter(t: Tables):
    e, w = _events(t)
    return e.select("event_id", d.counter(w).alias("n"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def retain_locf(t: Tables):
    e, w = _events(t)
    return e.withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value"))).select("event_id", d.carried_forward("p", w).alias("last_purchase"))


@query("""WITH RECURSIVE x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, greatest(0.0, 0.0 * 0.9 + value - 10) AS s FROM x WHERE i = 1 UNION ALL SELECT x.user_id, x.event_id, x.i, greatest(0.0, r.s * 0.9 + x.value - 10) FROM r JOIN x ON x.user_id = r.user_id AND x.i = r.i + 1)
SELECT user_id, event_id, round(s, 6) AS s FROM r""")
def retain_recurrence(t: Tables):
    out = d.recurrence(t.events, ["user_id"], ["ts", "event_id"], ["value"], F.lit(0.0), lambda s, r: F.greatest(F.lit(0.0), s * 0.9 + r["value"] - 10), "s")
    return out.select("user_id", "event_id", F.round("s", 6).alias("s"))


@query("""SELECT event_id, CAST(coalesce(lag(event_id) OVER w IS NULL, true) AS INTEGER) AS first_user, CAST(lead(event_id) OVER w IS NULL AS INTEGER) AS last_user,
CAST(lag(event_type) OVER w IS DISTINCT FROM event_type OR lag(event_id) OVER w IS NULL AS INTEGER) AS first_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def first_last(t: Tables):
    e, w = _events(t)
    return e.select("event_id", d.first_flag(["user_id"], w).alias("first_user"), d.last_flag(["user_id"], w).alias("last_user"), d.first_flag(["user_id", "event_type"], w).alias("first_type"))


@query("SELECT event_id, lag(value) OVER w AS lag1, lag(value, 2) OVER w AS lag2, value - lag(value) OVER w AS dif1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_dif(t: Tables):
    e, w = _events(t)
    return e.select("event_id", d.lag("value", w).alias("lag1"), d.lag("value", w, 2).alias("lag2"), d.dif("value", w).alias("dif1"))


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders")
def monotonic(t: Tables):
    return d.numbered(t.orders, ["o_orderdate", "o_orderkey"], "n").select("o_orderkey", "o_orderpriority", "n")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_k_group(t: Tables):
    return h.top_k(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["-o_totalprice", "o_orderkey"], 2)


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, rank() OVER w AS lo, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS same, dense_rank() OVER w AS dn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey))
SELECT c_custkey, lo + (same - 1) / 2 AS mean_rank, CAST(dn AS DOUBLE) AS dense, floor((lo + (same - 1) / 2) * 4 / (n + 1)) AS quartile FROM r""")
def rank_groups(t: Tables):
    x = t.customer.select("c_custkey", "c_mktsegment", "c_nationkey")
    for name, more in (("mean_rank", {}), ("dense", {"ties": "DENSE"}), ("quartile", {"groups": 4})):
        x = h.rank(x, "c_nationkey", name, ["c_mktsegment"], **more)
    return x.select("c_custkey", "mean_rank", "dense", "quartile")


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def standardize(t: Tables):
    return rounded(h.standardize(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]), 6)


@query("""SELECT c_custkey, n, CASE WHEN n >= 20 THEN 'ALTO' WHEN n >= 10 THEN 'MEDIO' ELSE 'BAIXO' END AS risco, CAST((total > 1000000) AS INTEGER) + CAST((n > 10) AS INTEGER) AS score
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE n IS NOT NULL""")
def churn_score(t: Tables):
    x = j.merge(t.customer.select(F.col("c_custkey").alias("k")), _totals(t), ["k"], "inner")
    risk = d.choose((F.col("n") >= 20, "ALTO"), (F.col("n") >= 10, "MEDIO"), otherwise="BAIXO")
    return x.select(F.col("k").alias("c_custkey"), "n", risk.alias("risco"), (m.number(F.col("total") > 1000000) + m.number(F.col("n") > 10)).alias("score"))


@query("SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey")
def sort_by(t: Tables):
    return h.sort(t.orders.select("o_custkey", "o_orderkey"), ["-o_custkey", "o_orderkey"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def sort_nodupkey(t: Tables):
    return h.nodupkey(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1")
def sort_dupout(t: Tables):
    return h.dupout(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def sort_noduprecs(t: Tables):
    return h.noduprecs(t.orders.select("o_orderstatus", "o_orderpriority"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 91 OFFSET 9")
def obs_firstobs(t: Tables):
    return d.options(t.orders, keep=["o_orderkey"], firstobs=10, obs=100, order=["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def outobs(t: Tables):
    return h.sort(t.orders.select("o_orderkey", "o_totalprice"), ["-o_totalprice", "o_orderkey"]).limit(25)


@query("""SELECT o_orderpriority, 'o_totalprice' AS _NAME_, round(max(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS st_F, round(max(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS st_O, round(max(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS st_P FROM orders GROUP BY 1""")
def transpose_long_wide(t: Tables):
    x = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.max("o_totalprice"), 2).alias("o_totalprice"))
    return h.transpose(x, ["o_totalprice"], ["o_orderpriority"], "o_orderstatus", prefix="st_")


@query("""WITH x AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) SELECT n_regionkey, 'n_nationkey' AS _NAME_, CAST(max(n_nationkey) FILTER (i = 1) AS DOUBLE) AS COL1, CAST(max(n_nationkey) FILTER (i = 2) AS DOUBLE) AS COL2, CAST(max(n_nationkey) FILTER (i = 3) AS DOUBLE) AS COL3, CAST(max(n_nationkey) FILTER (i = 4) AS DOUBLE) AS COL4, CAST(max(n_nationkey) FILTER (i = 5) AS DOUBLE) AS COL5 FROM x GROUP BY 1""")
def transpose_no_id(t: Tables):
    return h.transpose(t.nation.select("n_regionkey", "n_nationkey"), ["n_nationkey"], ["n_regionkey"], order=["n_nationkey"], values=[1, 2, 3, 4, 5])


@query("SELECT l_orderkey, l_linenumber, l_partkey, v.n AS _NAME_, v.x AS COL1 FROM lineitem, (VALUES ('q', l_quantity), ('d', l_discount)) AS v(n, x)")
def transpose_wide_long(t: Tables):
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    return h.stack(x, ["l_orderkey", "l_linenumber", "l_partkey"], ["q", "d"])


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_custkey AS k, c_acctbal AS bal, CAST(NULL AS VARCHAR) AS s_name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_name FROM supplier")
def outer_union_corr(t: Tables):
    return j.outer_union_corr(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")), t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), "s_name"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def except_(t: Tables):
    return t.orders.select(F.col("o_custkey").alias("k")).subtract(t.customer.where("c_acctbal > 0").select("c_custkey"))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct(t: Tables):
    return t.customer.select("c_mktsegment", "c_nationkey").distinct()


@query("""WITH cur AS (SELECT c_custkey AS k, c_mktsegment AS seg, DATE '2020-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to FROM customer),
inc AS (SELECT c_custkey + 10 AS k, CASE WHEN c_custkey % 3 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS seg FROM customer)
SELECT cur.k, cur.seg, valid_from, CASE WHEN inc.k IS NOT NULL AND inc.seg <> cur.seg THEN DATE '2024-01-01' END AS valid_to FROM cur LEFT JOIN inc ON inc.k = cur.k UNION ALL
SELECT inc.k, inc.seg, DATE '2024-01-01', NULL FROM inc LEFT JOIN cur ON cur.k = inc.k AND cur.seg = inc.seg WHERE cur.k IS NULL""")
def scd2(t: Tables):
    cur = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.lit("2020-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    inc = t.customer.select((F.col("c_custkey") + 10).alias("k"), F.when(F.col("c_custkey") % 3 == 0, "CHANGED").otherwise(F.col("c_mktsegment")).alias("seg"))
    return j.scd2(cur, inc, ["k"], ["seg"], "2024-01-01")


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def upsert(t: Tables):
    x = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    return j.upsert(x, x.where("s_suppkey % 2 = 0").withColumn("s_acctbal", F.lit(0.0)), ["s_suppkey"])


@query("""WITH x AS (SELECT user_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions FROM x GROUP BY 1""")
def sessions(t: Tables):
    e, w = _events(t)
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 30 MINUTE")
    return e.select("user_id", long(F.coalesce(gap, F.lit(True))).alias("new")).groupBy("user_id").agg(F.sum("new").alias("sessions"))
