"""Exact order statistics and state along all rows, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchloom.lang.program import Program
from batchloom.operators import orderstats, scans, summaries

NUMBERS = [0.0, -0.0, 1.0, -1.0, 0.1, 1e-320, -1e-320, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1e300, 3.0, 2.9999999999999996, 4.0, 3.9999999999999996, 1024.0, 1023.9999999999999, float("inf"), -float("inf")]


def test_keys_keep_the_order_of_numbers(spark):
    r = random.Random(1)
    xs = NUMBERS + [r.uniform(-1, 1) * 10.0 ** r.randint(-300, 300) for _ in range(400)]
    got = orderstats.with_key(spark.createDataFrame([(x,) for x in xs], "x double"), "x", "key").select("x", "key", orderstats.value_of(F.col("key")).alias("y")).collect()
    assert all(g.x == g.y for g in got)
    assert [g.key for g in sorted(got, key=lambda g: g.x)] == sorted(g.key for g in got)


@pytest.mark.parametrize("listed", [0, 20, 1 << 16])
def test_quantiles_modes_and_extremes(spark, monkeypatch, listed):
    """With all histograms, with some, and with the numbers of the first bins listed."""
    monkeypatch.setattr(orderstats, "BIN_NUMBERS", listed)
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([None, float("nan"), r.gauss(0, 5), float(r.randint(0, 3)), -1e9]), float(r.randint(0, 9)), i) for i in range(700)] + [("hot", 7.25, 1.0, 1000 + i) for i in range(500)] + [("none", None, None, 5000)]
    df = spark.createDataFrame(rows, "g string, x double, y double, id long")
    probs = (0.01, 0.25, 0.5, 0.9)
    got = {(q.g, q.v): list(q.values_) for q in orderstats.quantiles(df, ["x", "y"], probs, ["g"]).withColumnRenamed("values", "values_").collect()}
    modes = {(m.g, m.v): m.mode for m in orderstats.modes(df, ["x", "y"], ["g"]).collect()}
    for g in {x[0] for x in rows}:
        for v in (0, 1):
            xs = [x[1 + v] for x in rows if x[0] == g and x[1 + v] is not None and not math.isnan(x[1 + v])]
            if not xs:
                assert (g, v) not in got
                continue
            assert got[g, v] == pytest.approx(list(np.quantile(xs, probs)), rel=1e-12)
            assert modes[g, v] == min(set(xs), key=lambda z: (-xs.count(z), z))
    least = orderstats.extremes(df, ["x"], 3, ["g"], ["id"]).where("g = 'a' and side = 'LOW'").orderBy("place").collect()
    assert [(e.value, e.id) for e in least] == sorted((x[1], x[3]) for x in rows if x[0] == "a" and x[1] is not None and not math.isnan(x[1]))[:3]
    assert orderstats.quantiles(df.limit(0), ["x"], [0.5]).count() == 0


def test_means_has_no_percentile_buffer(spark):
    df = spark.range(50).selectExpr("id % 3 as k", "cast(id as double) as x")
    out = summaries.means(df, ["x"], ["MEDIAN", "MODE", "N"], ["k"])
    assert "percentile" not in out._jdf.queryExecution().analyzed().toString()
    assert out.count() == 3
    assert [(r._VAR_, r.MEDIAN) for r in summaries.univariate(df.selectExpr("x", "-x as y"), ["x", "y"]).collect()] == [("x", 24.5), ("y", -24.5)]


def test_carries_over_blocks(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, r.randint(1, 9)]), r.choice([None, "a", "b"])) for i in range(300)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "id long, x long, s string")
    out = scans.carried(scans.placed(df, ["id"]).rows, {"total": scans.Carry("sum", F.col("x"), F.lit(100)), "strict": scans.Carry("strict", F.when(F.col("id") < 250, F.coalesce("x", F.lit(0)))), "last": scans.Carry("last", F.col("s"), F.lit("none"))})
    total, strict, last = 100, 0, "none"
    got = {o.id: o for o in out.collect()}
    for i, x, s in rows:
        total += x or 0
        strict = None if i >= 250 else strict + (x or 0)
        last = s or last
        assert (got[i].total, got[i].strict, got[i].last) == (total, strict, last)


@pytest.mark.parametrize("n", [1, 2, 40])
def test_queue_spans_blocks_and_counts_reached_rows(spark, n):
    rows = [(i, None if i % 7 == 0 else i * 10, i % 3 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x long, hit boolean")
    out = scans.queued(scans.queued(scans.placed(df, ["id"]).rows, "a", F.col("x"), n), "b", F.col("x"), n, F.col("hit"))
    got = {o.id: (o.a, o.b) for o in out.collect()}
    queue = [x for _, x, hit in rows if hit]
    for i, _, hit in rows:
        assert got[i] == (rows[i - n][1] if i >= n else None, queue[i // 3 - n] if hit and i // 3 >= n else None)


def test_recurrence_of_a_hot_group_and_of_many(spark):
    r = random.Random(4)
    rows = [("hot" if i < 9000 else f"g{i % 50}", i, r.choice([0.0, 0.5, 1.0, -1.5, 0.9]), r.uniform(-5, 5), r.choice([None, -3.0]), r.choice([None, 8.0])) for i in range(10000)] + [("gap", i, 1.0, None if i == 3 else 1.0, None, None) for i in range(6)]
    df = spark.createDataFrame(rows, "g string, id long, a double, b double, low double, high double")
    got = {(o.g, o.id): o.s for o in scans.bounded_recurrence(df, ["g"], ["id"], F.col("a"), F.col("b"), "s", 2.0, F.col("low"), F.col("high")).collect()}
    streamed = {(o.g, o.id): o.t for o in scans.streamed(df.where("g <> 'gap'"), ["g"], ["id"], lambda s, x: min(x["high"] or math.inf, max(-math.inf if x["low"] is None else x["low"], x["a"] * s + x["b"])), 2.0, "t").collect()}
    state = {}
    for g, i, a, b, low, high in rows:
        s = state.get(g, 2.0)
        state[g] = None if s is None or b is None else min(math.inf if high is None else high, max(-math.inf if low is None else low, a * s + b))
        assert got[g, i] == (None if state[g] is None else pytest.approx(state[g], rel=1e-6, abs=1e-6))
        assert g == "gap" or streamed[g, i] == pytest.approx(state[g], rel=1e-9, abs=1e-9)
    assert scans.bounded_recurrence(df.limit(0), [], ["id"], F.col("a"), F.col("b"), "s").count() == 0


@pytest.mark.parametrize("most", [0, 100])
def test_format_ranges_with_open_and_closed_ends(spark, monkeypatch, most):
    """By bisection in groups, and merged in order; ranges that touch, points, open starts and infinite ends."""
    monkeypatch.setattr(summaries, "FORMAT_RANGES", most)
    monkeypatch.setattr(summaries, "GROUP_RANGES", 3)
    rows = [(None, -5.0, True, False, "low"), (-5.0, -5.0, True, True, "point"), (-5.0, 0.0, False, True, "a"), (0.0, 1.0, False, False, "b"), (1.0, 1.0, True, True, "one"), (2.0, 3.0, True, True, "c"), (3.0, 4.0, False, False, "d"), (5.0, None, False, True, "high")]
    table = summaries.range_table(spark.createDataFrame(rows, "lo double, hi double, s boolean, e boolean, label string"), "lo", "hi", "label", "s", "e")
    values = [-100.0, -5.0, -4.9, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 3.5, 4.0, 4.5, 5.0, 5.1, 1e300, None, float("nan")] * 3
    df = spark.createDataFrame(list(enumerate(values)), "id long, x double")
    got = {r.id: r.f for r in summaries.format_ranges(df, "x", table, "f", "none").collect()}

    def label(x):
        for lo, hi, s, e, name in rows:
            lo, hi = -math.inf if lo is None else lo, math.inf if hi is None else hi
            if x is not None and (lo < x or lo == x and s) and (x < hi or x == hi and e):
                return name
        return "none"

    assert got == {i: label(x) for i, x in enumerate(values)}
    assert summaries.format_ranges(df, "x", table.limit(0), "f", "none").where("f <> 'none'").count() == 0


@pytest.mark.parametrize("bad", [[(0.0, 2.0), (1.0, 3.0)], [(0.0, 1.0), (1.0, 2.0)], [(2.0, 1.0)], [(0.0, 9.0), (1.0, 2.0)]])
def test_overlapping_ranges_are_refused(spark, bad):
    with pytest.raises(ValueError):
        summaries.range_table(spark.createDataFrame([(a, b, "x") for a, b in bad], "lo double, hi double, label string"), "lo", "hi", "label")


def test_association_matches_pairs(spark):
    """Concordant and discordant pairs one by one; the p-value against the integral."""
    r = random.Random(6)
    rows = [(r.randint(0, 3), r.randint(0, 4)) for _ in range(120)]
    got = {x.STATISTIC: x.VALUE for x in summaries.association(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    pairs = [(np.sign(x[0] - y[0]), np.sign(x[1] - y[1])) for i, x in enumerate(rows) for y in rows[:i]]
    c, d = sum(p * q > 0 for p, q in pairs), sum(p * q < 0 for p, q in pairs)
    ta, tb = sum(p != 0 for p, _ in pairs), sum(q != 0 for _, q in pairs)
    assert got["GAMMA"] == pytest.approx((c - d) / (c + d)) and got["KENDALL_TAU_B"] == pytest.approx((c - d) / math.sqrt(ta * tb)) and got["SOMERS_D_C_R"] == pytest.approx((c - d) / ta)
    x, k = got["CHISQ"], got["DF"]
    t = np.linspace(0, x, 400_001)[1:]
    density = t ** (k / 2 - 1) * np.exp(-t / 2) / (2 ** (k / 2) * math.gamma(k / 2))
    assert got["PROB"] == pytest.approx(1 - float(np.sum((density[1:] + density[:-1]) / 2) * (t[1] - t[0])), abs=1e-4)
    values = spark.range(1).select(summaries.upper_gamma(F.lit(0.5), F.lit(0.02)).alias("a"), summaries.upper_gamma(F.lit(0.5), F.lit(8.0)).alias("b"), summaries.upper_gamma(F.lit(3.0), F.lit(1.5)).alias("c"), summaries.upper_gamma(F.lit(50.0), F.lit(60.0)).alias("d")).first()
    assert values.a == pytest.approx(math.erfc(math.sqrt(0.02)), rel=1e-9) and values.b == pytest.approx(math.erfc(math.sqrt(8)), rel=1e-9)
    assert values.c == pytest.approx(math.exp(-1.5) * (1 + 1.5 + 1.5**2 / 2), rel=1e-9)
    assert values.d == pytest.approx(math.exp(-60) * sum(60.0**i / math.factorial(i) for i in range(50)), rel=1e-7)


def test_blocks_grow_with_the_rows(spark, monkeypatch, tmp_path):
    """A task held a fixed share of all rows before: as many blocks as shuffle partitions, and a sort of what it read for each block's last value."""
    monkeypatch.setattr(scans, "BLOCK_ROWS", 100)
    df = spark.range(3000).select("id", F.when(F.col("id") % 7 == 0, F.struct(F.col("id").cast("string").alias("t"))).alias("mark"))
    rows = scans.placed(df, ["id"]).rows
    assert rows.groupBy("_p_").count().agg(F.max("count")).first()[0] < 400 and rows.select("_p_").distinct().count() >= 25
    out = scans.queued(scans.carried(rows, {"last": scans.Carry("last", F.col("mark"))}), "before", F.col("id"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "max_by" not in plan
    got = out.select("id", "last.t", "before").orderBy("id").collect()
    assert [(r.t, r.before) for r in got] == [(str(i - i % 7), i - 1 if i else None) for i in range(3000)]


def test_formats_of_ranges_merge_in_blocks_that_grow(spark, monkeypatch):
    """PUT and CLASS with a format of ranges from a dataset: no block holds a fixed share of the values."""
    seen, placed = [], scans.placed

    def watched(df, order):
        seen.append(placed(df, order))
        return seen[-1]

    monkeypatch.setattr(scans, "BLOCK_ROWS", 100)
    monkeypatch.setattr(summaries, "FORMAT_RANGES", 0)
    monkeypatch.setattr(scans, "placed", watched)
    spark.range(1000).selectExpr("'band' AS fmtname", "id * 10.0D AS start", "id * 10.0D + 5 AS end", "concat('b', id) AS label").createOrReplaceTempView("block_ranges")
    tables = {"f": spark.table("block_ranges"), "x": spark.range(3000).selectExpr("id * 1.0D AS v")}
    put = Program(spark, tables).run("proc format cntlin=f; run; data r; set x; b = put(v, band.); run;").frame("r")
    assert {r.b.strip() for r in put.where("v % 10 <= 5").collect()} == {f"b{i}" for i in range(300)}
    classes = Program(spark, tables).run("proc format cntlin=f; run; proc means data=x nway; class v; format v band.; var v; output out=r(drop=_type_ _freq_) n=n; run;").frame("r")
    assert classes.where("v LIKE 'b%' AND n = 6").count() == 300
    assert len(seen) == 4
    for p in seen:
        assert p.rows.groupBy("_p_").count().agg(F.max("count")).first()[0] < 400
