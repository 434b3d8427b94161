"""Queries of scalar functions, formats, informats and SQL-dialect rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchloom.functions import dates as dt
from batchloom.functions import numbers as n
from batchloom.functions import text as x
from batchloom.functions.formats import input_, put
from batchloom.plans.registry import Tables, long, query, rounded


@query("""SELECT p_partkey, substr(p_name, 2, 5) AS sub, substr(p_name, 3) AS tail, upper(p_type) AS up, lower(p_brand) AS low, trim('  ' || p_brand || '  ') AS stripped, rtrim(p_brand || '  ') || '|' AS trimmed, ltrim('  ' || p_brand) AS lefted, replace(p_name, 'a', 'XY') AS tran,
 CAST(instr(p_name, 'e') AS INTEGER) AS idx, CAST(greatest(length(rtrim(p_name)), 1) AS INTEGER) AS len, repeat(p_brand, 3) AS rep, reverse(p_brand) AS rev, translate(p_brand, 'ab#', 'xy-') AS trans FROM part""")
def fn_string(t: Tables):
    b, name = F.col("p_brand"), F.col("p_name")
    return t.part.select(
        "p_partkey", x.substr(name, 2, 5).alias("sub"), x.substr(name, 3).alias("tail"), x.upcase(F.col("p_type")).alias("up"), x.lowcase(b).alias("low"), x.strip(F.concat(F.lit("  "), b, F.lit("  "))).alias("stripped"),
        F.concat(x.trim(F.concat(b, F.lit("  "))), F.lit("|")).alias("trimmed"), x.left(F.concat(F.lit("  "), b)).alias("lefted"), x.tranwrd(name, "a", "XY").alias("tran"), x.index(name, "e").alias("idx"), x.length(name).alias("len"),
        x.repeat(b, 2).alias("rep"), x.reverse(b).alias("rev"), x.translate(b, "xy-", "ab#").alias("trans"),
    )


@query("""WITH w AS (SELECT p_partkey, p_name, p_brand, list_filter(string_split_regex(p_name || '-' || p_brand, '[ #-]+'), lambda s: s <> '') AS l FROM part)
SELECT p_partkey, l[1] AS w1, l[2] AS w2, l[-1] AS w_last, l[99] AS w99, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, regexp_replace(p_brand, '[A-Za-z\\s]', '', 'g') AS no_letters, replace(p_name, ' ', '') AS no_blanks FROM w""")
def fn_scan_compress(t: Tables):
    s = F.concat("p_name", F.lit("-"), "p_brand")
    return t.part.select(
        "p_partkey", x.scan(s, 1, " #-").alias("w1"), x.scan(s, 2, " #-").alias("w2"), x.scan(s, -1, " #-").alias("w_last"), x.scan(s, 99, " #-").alias("w99"), x.compress(F.col("p_brand"), None, "kd").alias("digits"),
        x.compress(F.col("p_brand"), None, "as").alias("no_letters"), x.compress(F.col("p_name")).alias("no_blanks"),
    )


@query("""WITH c AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN ' ' WHEN c_custkey % 3 = 1 THEN NULL ELSE c_mktsegment END AS s FROM customer)
SELECT c_custkey, concat_ws('-', trim(c_name), nullif(trim(s), '')) AS catx, trim(c_name) || coalesce(trim(s), '') AS cats, rtrim(c_name) || coalesce(rtrim(s), '') AS catt, c_name || coalesce(s, '') AS cat, coalesce(nullif(trim(s), ''), 'none') AS coal FROM c""")
def fn_cat_family(t: Tables):
    c = t.customer.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, " ").when(F.col("c_custkey") % 3 == 2, F.col("c_mktsegment")).alias("s"))
    a, s = F.col("c_name"), F.col("s")
    return c.select("c_custkey", x.catx("-", a, s).alias("catx"), x.cats(a, s).alias("cats"), x.catt(a, s).alias("catt"), x.cat(a, s).alias("cat"), n.coalescec(s, "none").alias("coal"))


@query("""SELECT p_partkey, CAST(instr(substr(lower(p_name), 2), 'a') + CASE WHEN instr(substr(lower(p_name), 2), 'a') > 0 THEN 1 ELSE 0 END AS INTEGER) AS found, CAST(CASE WHEN instr(reverse(substr(p_name, 1, 8)), 'a') > 0 THEN length(substr(p_name, 1, 8)) - instr(reverse(substr(p_name, 1, 8)), 'a') + 1 ELSE 0 END AS INTEGER) AS back FROM part""")
def fn_find(t: Tables):
    return t.part.select("p_partkey", x.find(F.col("p_name"), "A", "i", 2).alias("found"), x.find(F.col("p_name"), "a", "", -8).alias("back"))


@query("""SELECT c_custkey, abs(c_acctbal) AS abs, ceil(c_acctbal) AS ceil, floor(c_acctbal) AS floor, round(c_acctbal, 0) AS r0, round(c_acctbal - 7 * trunc(c_acctbal / 7), 6) AS mod, trunc(c_acctbal) AS int, CAST(sign(c_acctbal) AS DOUBLE) AS sign, round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6) AS sqrt,
 round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS log, round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 6) AS log10, round(exp(c_acctbal / 10000), 6) AS exp FROM customer""")
def fn_numeric(t: Tables):
    b = F.col("c_acctbal")
    out = t.customer.select("c_custkey", n.abs_(b).alias("abs"), n.ceil(b).alias("ceil"), n.floor(b).alias("floor"), n.round_(b, 1).alias("r0"), n.mod(b, 7).alias("mod"), n.int_(b).alias("int"), n.sign(b).alias("sign"), n.sqrt(b).alias("sqrt"), n.log(b).alias("log"), n.log10(b).alias("log10"), n.exp(b / 10000).alias("exp"))
    return rounded(out, 6)


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_discount END AS b, CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE l_tax END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, a, greatest(a, b, c) AS mx, least(a, b, c) AS mn, round(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0), 6) AS sm, round(list_avg(list_filter([a, b, c], lambda v: v IS NOT NULL)), 6) AS mean, CAST((b IS NULL)::INT + (c IS NULL)::INT AS INTEGER) AS nmiss, CAST(3 - (b IS NULL)::INT - (c IS NULL)::INT AS INTEGER) AS n, round(greatest(a, b, c) - least(a, b, c), 6) AS rng FROM r""")
def fn_row_stats(t: Tables):
    r = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.when(F.col("l_orderkey") % 3 != 0, F.col("l_discount")).alias("b"), F.when(F.col("l_orderkey") % 2 != 0, F.col("l_tax")).alias("c"))
    v = [F.col(c) for c in "abc"]
    return rounded(r.select("l_orderkey", "l_linenumber", "a", n.max_(*v).alias("mx"), n.min_(*v).alias("mn"), n.sum_(*v).alias("sm"), n.mean(*v).alias("mean"), n.nmiss(*v).alias("nmiss"), n.n(*v).alias("n"), n.range_(*v).alias("rng")), 6)


@query("""SELECT o_orderkey, CAST(date_diff('month', CAST(o_orderdate AS DATE), DATE '2002-03-15') AS INTEGER) AS months, CAST(date_diff('year', CAST(o_orderdate AS DATE), DATE '2002-03-15') AS INTEGER) AS years, CAST(date_diff('quarter', CAST(o_orderdate AS DATE), DATE '2002-03-15') AS INTEGER) AS qtrs,
 CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-03-15') AS INTEGER) AS days, CAST(floor((DATE '2002-03-15' - DATE '1959-12-27') / 7) - floor((CAST(o_orderdate AS DATE) - DATE '1959-12-27') / 7) AS INTEGER) AS weeks FROM orders""")
def fn_intck(t: Tables):
    d, e = F.col("o_orderdate").cast("date"), F.lit("2002-03-15").cast("date")
    return t.orders.select("o_orderkey", *[dt.intck(i, d, e).alias(a) for i, a in (("MONTH", "months"), ("YEAR", "years"), ("QTR", "qtrs"), ("DAY", "days"), ("WEEK", "weeks"))])


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, CAST(date_trunc('month', d + INTERVAL 2 MONTH) AS DATE) AS mb, last_day(CAST(d - INTERVAL 1 MONTH AS DATE)) AS me, CAST(d + INTERVAL 3 MONTH AS DATE) AS ms, CAST(date_trunc('year', d + INTERVAL 1 YEAR) AS DATE) AS yb, CAST(date_trunc('quarter', d + INTERVAL 3 MONTH) AS DATE) AS qb, d + 10 AS ds FROM d""")
def fn_intnx(t: Tables):
    d = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", dt.intnx("MONTH", d, 2).alias("mb"), dt.intnx("MONTH", d, -1, "E").alias("me"), dt.intnx("MONTH", d, 3, "S").alias("ms"), dt.intnx("YEAR", d, 1).alias("yb"), dt.intnx("QTR", d, 1).alias("qb"), dt.intnx("DAY", d, 10).alias("ds"))


@query("""SELECT event_id, CAST(ts AS DATE) AS d, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS DOUBLE) AS secs, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS dd, CAST(quarter(ts) AS INTEGER) AS q, CAST(dayofweek(ts) + 1 AS INTEGER) AS wd, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi,
 CASE WHEN day(ts) <= 28 THEN make_date(year(ts), 2, day(ts)) WHEN day(ts) = 29 THEN DATE '2024-02-29' END AS feb, CAST(hour(ts) * 3600 + 90 AS DOUBLE) AS hms FROM events""")
def fn_dateparts(t: Tables):
    ts = F.col("ts")
    return t.events.select("event_id", dt.datepart(ts).alias("d"), dt.timepart(ts).alias("secs"), dt.year(ts).alias("y"), dt.month(ts).alias("m"), dt.day(ts).alias("dd"), dt.qtr(ts).alias("q"), dt.weekday(ts).alias("wd"), dt.hour(ts).alias("h"), dt.minute(ts).alias("mi"), dt.mdy(2, dt.day(ts), dt.year(ts)).alias("feb"), dt.hms(dt.hour(ts), 1, 30).alias("hms"))


@query("""SELECT o_orderkey, upper(strftime(o_orderdate, '%d%b%Y')) AS date9, strftime(o_orderdate, '%m/%d/%Y') AS mmddyy10, strftime(o_orderdate, '%Y-%m-%d') AS yymmdd10, strftime(o_orderdate, '%d/%m/%Y') AS ddmmyy10, strftime(o_orderdate, '%Y%m%d') AS yymmddn8, upper(strftime(o_orderdate, '%b%y')) AS monyy5, upper(strftime(o_orderdate, '%b%Y')) AS monyy7,
 strftime(o_orderdate, '%A, %B %d, %Y') AS weekdate, strftime(o_orderdate, '%d.%m.%Y') AS eurdfde, strftime(o_orderdate, '%d %B %Y') AS nldate, upper(strftime(o_orderdate, '%d%b%Y:%H:%M:%S')) AS datetime20, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS e8601dt, strftime(o_orderdate, '%Y-%m-%d') AS e8601da, '01:02:03' AS time8, '01:02' AS hhmm FROM orders""")
def fn_put_dates(t: Tables):
    d = F.col("o_orderdate")
    names = {"DATE9.": "date9", "MMDDYY10.": "mmddyy10", "YYMMDD10.": "yymmdd10", "DDMMYY10.": "ddmmyy10", "YYMMDDN8.": "yymmddn8", "MONYY5.": "monyy5", "MONYY7.": "monyy7", "WEEKDATE.": "weekdate", "EURDFDE.": "eurdfde", "NLDATE.": "nldate", "DATETIME20.": "datetime20", "E8601DT.": "e8601dt", "E8601DA.": "e8601da"}
    return t.orders.select("o_orderkey", *[put(d, f).alias(a) for f, a in names.items()], put(F.lit(3723), "TIME8.").alias("time8"), put(F.lit(3723), "HHMM5.").alias("hhmm"))


@query("""SELECT o_orderkey, '$' || format('{:,.2f}', o_totalprice) AS dollar, format('{:,.2f}', o_totalprice) AS comma, printf('%.1f%%', 100 * (o_orderkey % 8) / 8.0) AS pct, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS z8, CAST(o_orderkey AS VARCHAR) AS best, substr(o_orderpriority, 1, 3) AS chr3, CASE WHEN o_orderkey < 1000000 THEN lpad(CAST(o_orderkey AS VARCHAR), 6, ' ') ELSE lpad(regexp_replace(regexp_replace(printf('%.2E', CAST(o_orderkey AS DOUBLE)), '[.]?0*E', 'E'), 'E[+]0*', 'E'), 6, ' ') END AS f6 FROM orders""")
def fn_put_numeric(t: Tables):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return t.orders.select("o_orderkey", put(p, "DOLLAR12.2").alias("dollar"), put(p, "COMMA12.2").alias("comma"), put((k % 8) / 8, "PERCENT8.1").alias("pct"), put(k, "Z8.").alias("z8"), put(k, "BEST12.").alias("best"), put(F.col("o_orderpriority"), "$CHAR3.").alias("chr3"), put(k, "6.").alias("f6"))


@query("""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders) SELECT o_orderkey, d AS a, d AS b, d AS c, d AS e, d AS any_, CAST(d AS TIMESTAMP) AS ts FROM d""")
def fn_input_dates(t: Tables):
    d = F.col("o_orderdate")

    def text(fmt: str):
        return F.when(F.col("o_orderkey") % 10 == 0, "junk").otherwise(put(d, fmt))

    return t.orders.select("o_orderkey", input_(text("DATE9."), "DATE9.").alias("a"), input_(text("MMDDYY10."), "MMDDYY10.").alias("b"), input_(text("YYMMDD10."), "YYMMDD10.").alias("c"), input_(text("DDMMYY10."), "DDMMYY10.").alias("e"), input_(text("DATE9."), "ANYDTDTE.").alias("any_"), input_(text("DATETIME20."), "DATETIME20.").cast("timestamp_ntz").alias("ts"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS comma, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS dollar, CAST(o_orderkey AS DOUBLE) AS best, substr(o_orderpriority, 1, 3) AS chr3, CAST(o_orderkey AS DOUBLE) AS hex FROM orders""")
def fn_input_numeric(t: Tables):
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    bad = k % 10 == 0
    return t.orders.select("o_orderkey", input_(F.when(bad, "n/a").otherwise(put(p, "COMMA12.2")), "COMMA12.2").alias("comma"), input_(F.when(bad, "n/a").otherwise(put(p, "DOLLAR12.2")), "DOLLAR12.2").alias("dollar"), input_(k.cast("string"), "BEST12.").alias("best"), input_(F.col("o_orderpriority"), "$CHAR3.").alias("chr3"), input_(F.hex(k), "HEX8.").alias("hex"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) SELECT c_custkey, coalesce(v, -1.0) AS coal, CASE WHEN v IS NULL THEN -9 WHEN v > 0 THEN 1 ELSE 0 END AS ifn, CASE WHEN v > 0 THEN 'pos' ELSE 'neg' END AS ifc FROM c""")
def fn_conditional(t: Tables):
    c = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("v"))
    v = F.col("v")
    return c.select("c_custkey", n.coalesce(v, -1.0).alias("coal"), n.ifn(v > 0, 1, 0, -9).alias("ifn"), n.ifc(v > 0, "pos", "neg").alias("ifc"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS v, CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_name END AS s FROM customer) SELECT c_custkey, CAST(v IS NULL AS INTEGER) AS miss_n, CAST(trim(s) = '' AS INTEGER) AS miss_c, CAST((v IS NULL)::INT + (trim(s) = '')::INT AS INTEGER) AS cmiss FROM c""")
def fn_missing_count(t: Tables):
    c = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("v"), F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_name")).alias("s"))
    return c.select("c_custkey", n.missing(F.col("v")).alias("miss_n"), n.missing(F.col("s")).alias("miss_c"), n.cmiss(F.col("v"), F.col("s")).alias("cmiss"))


@query("SELECT p_partkey, CAST(coalesce(nullif(regexp_extract_all(p_brand, '[0-9]'), []) IS NOT NULL, false) AS INTEGER) AS has_digit, CAST(CASE WHEN regexp_matches(p_name, '[A-Za-z]') THEN 1 ELSE 0 END AS INTEGER) AS has_alpha, CAST(length(rtrim(p_name)) AS INTEGER) AS lengthn, p_brand || '|' AS right_ FROM part")
def fn_wanted_strings(t: Tables):
    b = F.col("p_brand")
    return t.part.select("p_partkey", (x.anydigit(b) > 0).cast("int").alias("has_digit"), (x.anyalpha(F.col("p_name")) > 0).cast("int").alias("has_alpha"), x.lengthn(F.col("p_name")).alias("lengthn"), F.concat(x.strip(x.right(F.concat(b, F.lit("  ")))), F.lit("|")).alias("right_"))


@query("SELECT props, CAST(length(props) AS INTEGER) AS n, count(*) AS rows FROM events GROUP BY ALL")
def fn_over_json_text(t: Tables):
    return t.events.groupBy("props").agg(F.count("*").alias("rows")).select("props", x.lengthn(F.col("props")).alias("n"), long("rows").alias("rows"))
