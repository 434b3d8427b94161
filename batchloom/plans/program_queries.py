"""Queries that run program text."""

from __future__ import annotations

from batchloom.lang.program import Program
from batchloom.plans.registry import Tables, query


def _run(t: Tables, text: str, result: str, *names: str):
    return Program(t.spark, {n: getattr(t, n) for n in names}).run(text).frame(result)


@query("SELECT c_custkey, c_name, c_mktsegment AS segment, round(n, 0) AS n FROM customer JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE c_acctbal > 100 AND n > 5")
def job_customers(t: Tables):
    text = """
    /* customers with their orders */
    data work.cust (keep=c_custkey c_name segment);
      set customer; where c_acctbal > 100; rename c_mktsegment=segment;
    run;
    proc sql; create table work.n as select o_custkey, count(*) as k from orders group by o_custkey;
      create table work.out as select c.c_custkey, c.c_name, c.segment, n.k * 1.0 as orders_n from work.cust c left join work.n n on c.c_custkey = n.o_custkey where n.k > 5;
    quit;
    """
    out = _run(t, text, "work.out", "customer", "orders")
    return out.selectExpr("c_custkey", "c_name", "segment", "round(cast(orders_n as double), 0) AS n")


@query("""SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w, 2) AS acum, CAST(row_number() OVER w AS BIGINT) AS rank_cli, CAST(row_number() OVER w = 1 AS INTEGER) AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def job_sales(t: Tables):
    text = """
    %macro accumulate(ds_in=, ds_out=, key=);
      proc sort data=&ds_in. out=work.s; by &key o_orderdate o_orderkey; run;
      data &ds_out;
        set work.s; by &key;
        retain acum 0 rank_cli 0;
        if first.&key then do; acum = 0; rank_cli = 0; end;
        acum + o_totalprice;
        rank_cli + 1;
        first = first.&key;
        keep &key o_orderkey acum rank_cli first;
      run;
    %mend accumulate;
    %accumulate(ds_in=orders, ds_out=work.acum, key=o_custkey);
    """
    out = _run(t, text, "work.acum", "orders")
    return out.selectExpr("o_custkey", "o_orderkey", "round(acum, 2) AS acum", "cast(rank_cli as bigint) AS rank_cli", "first")


@query("""SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS media FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def job_report(t: Tables):
    text = """
    %let cut = P;
    data work.x; set orders; if o_orderstatus ne "&cut"; run;
    proc means data=work.x noprint nway;
      class o_orderpriority; var o_totalprice;
      output out=work.totals(drop=_type_ _freq_) sum=total mean=media;
    run;
    """
    return _run(t, text, "work.totals", "orders").selectExpr("o_orderpriority", "round(total, 2) AS total", "round(media, 4) AS media")


@query("""WITH x AS (SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 3 WHEN c_acctbal < 2000 THEN 2 ELSE 1 END * 1.5 + CAST(c_mktsegment = 'BUILDING' AS INTEGER) * 2 AS score FROM customer)
SELECT c_custkey, round(CAST(score AS DOUBLE), 4) AS score, CASE WHEN score >= 4.5 THEN 'ALTO' WHEN score >= 3 THEN 'MEDIO' ELSE 'BAIXO' END AS cd_risco FROM x""")
def job_churn(t: Tables):
    text = """
    data work.scored;
      length cd_risco $10;
      set customer;
      array w{2} _temporary_ (1.5 2);
      array f{2} f1 f2;
      if c_acctbal < 0 then f1 = 3; else if c_acctbal < 2000 then f1 = 2; else f1 = 1;
      f2 = (c_mktsegment = 'BUILDING');
      score = 0;
      do i = 1 to 2; score = score + f{i} * w{i}; end;
      if score >= 4.5 then cd_risco = 'ALTO'; else if score >= 3 then cd_risco = 'MEDIO'; else cd_risco = 'BAIXO';
      keep c_custkey score cd_risco;
    run;
    """
    return _run(t, text, "work.scored", "customer").selectExpr("c_custkey", "round(score, 4) AS score", "cd_risco")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 3")
def job_merge(t: Tables):
    text = """
    proc sort data=nation; by n_regionkey; run;
    data both; merge nation(in=a rename=(n_regionkey=k)) region(in=b rename=(r_regionkey=k)); by k; if a and b and n_nationkey > 3; keep n_name r_name; run;
    """
    return _run(t, text, "both", "nation", "region")


@query("SELECT o_orderkey, o_totalprice * 2 AS dbl, o_totalprice * 2 + 1 AS plus FROM orders WHERE o_totalprice * 2 > 100000")
def sql_calculated(t: Tables):
    return _run(t, "proc sql; create table r as select o_orderkey, o_totalprice * 2 as dbl, calculated dbl + 1 as plus from orders where o_totalprice * 2 > 100000; quit;", "r", "orders")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) AS INTEGER) AS n FROM orders")
def sql_monotonic(t: Tables):
    return _run(t, "proc sort data=orders out=s; by o_custkey o_orderkey; run; proc sql; create table r as select o_orderkey, monotonic() as n from s; quit;", "r", "orders")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01' AND o_orderdate < TIMESTAMP '1998-06-01 00:00:00'")
def sql_date_literal(t: Tables):
    return _run(t, "proc sql; create table r as select o_orderkey from orders where datepart(o_orderdate) >= '01JAN1998'd and o_orderdate < '01JUN1998:00:00:00'dt; quit;", "r", "orders")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def sql_into_macro(t: Tables):
    program = Program(t.spark, {"orders": t.orders}).run("proc sql; select avg(o_totalprice) into :m from orders; quit;")
    return program.run("data r; set orders; where o_totalprice > &m; keep o_orderkey; run;").frame("r")


@query("WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS v, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END AS s FROM customer) SELECT c_custkey FROM x WHERE v IS NULL OR trim(s) = ''")
def sql_case_missing(t: Tables):
    x = t.customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS v", "CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END AS s")
    return Program(t.spark, {"x": x}).run("proc sql; create table r as select c_custkey from x where v = . or s = ''; quit;").frame("r")


@query("SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 100")
def sql_group_alias(t: Tables):
    return _run(t, "proc sql; create table r as select cast(year(o_orderdate) as bigint) as y, count(*) as n from orders group by calculated y having calculated n > 100; quit;", "r", "orders")


@query("SELECT o_orderstatus, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS big FROM orders GROUP BY 1")
def sql_boolean_sum(t: Tables):
    return _run(t, "proc sql; create table r as select o_orderstatus, sum(o_totalprice gt 100000) as big from orders group by o_orderstatus; quit;", "r", "orders")
