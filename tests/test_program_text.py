"""Program text: refusals, library versions, and operators whose errors show only at size."""

import pytest
from pyspark.sql import functions as F

from batchloom.lang.program import Program
from batchloom.lang.sql import remerged, with_missing
from batchloom.lang.statements import UnsupportedConstruct
from batchloom.operators import datastep, merging, shaping
from batchloom.plans.diagnose import diagnose
from batchloom.sources import Library


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "b", 3.0), (4, None, 4.0)], "id long, g string, x double")


@pytest.mark.parametrize("text", [
    "proc freq data=t; tables g; exact chisq; run;", "proc report data=t; compute x; run;", "proc sort data=t nodupkey out=u; by g; run;", "proc sql outobs=2; create table r as select id from t; quit;",
    "proc sql; create table r as select monotonic() as n from t; quit;", "data r; set t; y = lag(x); run;", "proc tabulate data=t; class g; var x; table g, x*mean*sum; run;", "proc tabulate data=t; class g; var x; table g*(x, mean; run;", "proc tabulate data=t; class g; var x; table g, nosuch; run;", "proc sql; create table r as select propcase(g, 'a', 'b') as p from t; quit;",
    "proc transpose data=t out=r; var x; copy id; run;", "data r; set t end=e key=k; run;", "proc sort data=t; by g; run; data r; set t; retain s 0; s = s * s + x; run;", "proc means data=t; var x; output out=r mean(x)=a b; run;",
    "proc means data=t; var x; output out=r idgroup(max(x)=y); run;", "proc means data=t nosuch; run;", "proc freq data=t; tables g id / nosuch; run;", "proc freq data=t; tables g * / out=r; run;", "proc sort data=t nosuch; by g; run;",
    "proc rank data=t nosuch; run;", "proc univariate data=t; var x; output out=r pctlpts=2.5; run;", "proc datasets; rebuild t; quit;", "proc report data=t; column g x; define g / group; define x / sum; break between g; run;", "data r; set t; return; run;",
    "proc print data=t nosuch; run;", "proc standard data=t nosuch; run;", "proc append base=u data=t nosuch; run;", "proc contents data=t nosuch; run;", "proc transpose data=t nosuch out=r; var x; run;", "proc tabulate data=t nosuch; run;", "proc export data=t nosuch; run;",
])
def test_what_cannot_be_done_raises(spark, t, text):
    with pytest.raises(UnsupportedConstruct) as e:
        Program(spark, {"t": t}).run(text)
    assert diagnose(e.value).category == "unsupported"


def test_lag_inside_if_counts_the_rows_that_reach_it(spark, t):
    """g, id order: 4 (no g), 1, 2, 3; rows 4 and 3 pass, so 3 gets the x of 4. Row 4 is the first call."""
    out = Program(spark, {"t": t}).run("proc sort data=t; by g id; run; data r; set t; by g; if x > 1 then y = lag(x); run;").frame("r")
    assert {r.id: r.y for r in out.collect()} == {1: None, 2: None, 3: 4.0, 4: None}


def test_where_of_output_datasets(spark, t):
    p = Program(spark, {"t": t}).run("data r(where=(x > 1)); set t; run; data a(keep=id) b(where=(id = 4)); set t; run;")
    assert [r.id for r in p.frame("r").orderBy("id").collect()] == [3, 4] and p.frame("b").count() == 1 and p.frame("a").columns == ["id"]


def test_library_versions(spark, t, tmp_path):
    """Five kinds of statement rewrite the dataset that they read; frames made before keep the old version."""
    p = Program(spark, {"t": t}).run(f"libname l '{tmp_path}'; data l.y; set t; run; data before; set l.y; run;")
    p.run("data l.y; set l.y; z = 1; run; proc sort data=l.y; by id; run; proc sql; update l.y set x = 0 where x is null; delete from l.y where id = 4; insert into l.y select id, g, x, 2 as z from before where id = 4; quit; proc append base=l.y data=l.y; run;")
    assert p.frame("l.y").count() == 8 and p.frame("before").columns == ["id", "g", "x"] and p.frame("before").count() == 4
    assert sorted(r.x for r in Library(spark, str(tmp_path)).read("y").collect()) == [0.0, 0.0, 1.0, 1.0, 3.0, 3.0, 4.0, 4.0]
    assert not [f for f in tmp_path.iterdir() if "__" in f.name]


def test_append_and_copy_see_datasets_of_earlier_runs(spark, t, tmp_path):
    """A new program has read nothing yet: APPEND must not replace the dataset, COPY must not miss it."""
    a, b = tmp_path / "a", tmp_path / "b"
    Program(spark, {"t": t}).run(f"libname l '{a}'; data l.y; set t; run; data l.z; set t(where=(id = 1)); run;")
    p = Program(spark, {"t": t}).run(f"libname l '{a}'; libname m '{b}'; proc append base=l.y data=t(where=(id > 2)); run; proc append base=l.new data=t; where id = 1; run; proc copy in=l out=m; exclude z; run;")
    assert sorted(r.id for r in Library(spark, str(a)).read("y").collect()) == [1, 2, 3, 3, 4, 4]
    assert p.frame("l.new").count() == 1 and Library(spark, str(a)).members() == ["new", "y", "z"]
    assert Library(spark, str(b)).members() == ["new", "y"] and Library(spark, str(b)).read("y").count() == 6
    assert Library(spark, str(tmp_path / "none")).members() == []


def test_included_files_run(spark, t, tmp_path):
    (tmp_path / "macros.sas").write_bytes("/* caf\xe9 */ %macro keep(n); data r; set t(where=(id > &n)); run; %mend;".encode("latin-1"))
    (tmp_path / "start.sas").write_text(f"%let low = 2; %include '{tmp_path}/macros.sas';")
    (tmp_path / "loop.sas").write_text(f"%include '{tmp_path}/loop.sas';")
    p = Program(spark, {"t": t}).run(f"%let at = {tmp_path}; %include \"&at/start.sas\" / source2; %keep(&low);")
    assert sorted(r.id for r in p.frame("r").collect()) == [3, 4]
    for text in ("%include 'no/such/file.sas';", "%include fileref;", f"%include '{tmp_path}/loop.sas';"):
        with pytest.raises(UnsupportedConstruct):
            Program(spark, {"t": t}).run(text)


def test_sql_comparisons_with_missing():
    assert with_missing("x < 6") == "coalesce(x < 6, x IS NULL)"
    assert with_missing("6 > x") == "coalesce(x < 6, x IS NULL)"
    assert with_missing("a.x >= b.y") == "coalesce(b.y <= a.x, b.y IS NULL)"
    assert with_missing("x + 1 < 6") == "coalesce(x + 1 < 6, (x + 1) IS NULL)" and with_missing("a.x = b.x") == "(a.x <=> b.x)" and with_missing("x <> 6") == "(NOT (x <=> 6))"


def test_remerge_leaves_plain_grouping_alone():
    for text in ("select g, sum(x) as s from t group by g", "select sum(x) as s from t", "select count(*) as n from t", "select year(d) as y, count(*) as n from t group by calculated y having calculated n > 1"):
        assert remerged(text) == text


def test_numbers_are_unique_at_size(spark):
    """A million rows in 16 partitions with another column kept."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(1_000_000).select(F.xxhash64("id").alias("k"), "id", F.rand(1).alias("more"))
        out = datastep.numbered(df, ["k", "id"])
        one = out.agg(F.count_distinct("_n_").alias("d"), F.min("_n_").alias("a"), F.max("_n_").alias("b")).first()
        assert tuple(one) == (1_000_000, 1, 1_000_000)
        assert out.orderBy("k", "id").limit(1000).where(F.col("_n_") > 1000).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_recurrence_over_several_runs(spark, monkeypatch):
    monkeypatch.setattr(datastep, "RUN_ROWS", 7)
    df = spark.range(60).select((F.col("id") % 3).alias("g"), "id")
    out = datastep.recurrence(df, ["g"], ["id"], ["id"], F.lit(0).cast("long"), lambda s, r: s * 2 % 1009 + r["id"], "s")
    got = {(r.g, r.id): r.s for r in out.collect()}
    for g in range(3):
        s = 0
        for i in range(g, 60, 3):
            s = s * 2 % 1009 + i
            assert got[g, i] == s
    assert datastep.recurrence(df.limit(0), ["g"], ["id"], ["id"], F.lit(0).cast("long"), lambda s, r: s + r["id"], "s").count() == 0


@pytest.mark.parametrize("ties", ["MEAN", "LOW", "HIGH", "DENSE"])
@pytest.mark.parametrize("down", [False, True])
def test_rank_of_all_rows_equals_rank_of_one_group(spark, ties, down):
    df = spark.range(50).select("id", F.when(F.col("id") % 9 != 0, F.col("id") % 7).alias("x"), F.lit(1).alias("g"))
    a = shaping.rank(df, "x", "r", [], down, ties, 4 if ties == "MEAN" else None).select("id", "r")
    b = shaping.rank(df, "x", "r", ["g"], down, ties, 4 if ties == "MEAN" else None).select("id", "r")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_hash_lookup_of_a_wide_table_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merging, "HASH_BYTES", 10)
    table = spark.createDataFrame([(1, "long text of the table")], "k long, v string")
    out = merging.hash_lookup(spark.range(3).toDF("k"), table, ["k"], ["v"])
    assert [r.v for r in out.orderBy("k").collect()] == [None, "long text of the table", None]


def test_transpose_refuses_too_many_columns(spark, monkeypatch):
    monkeypatch.setattr(shaping, "ID_VALUES", 3)
    with pytest.raises(ValueError):
        shaping.transpose(spark.range(9).withColumn("v", F.lit(1)), ["v"], [], "id")


def test_comments_are_found_as_one_character_after_another():
    import random

    from batchloom.lang.statements import without_comments

    def plainly(text):
        out, i, start = [], 0, True
        while i < len(text):
            c = text[i]
            if text.startswith("/*", i):
                end = text.find("*/", i + 2)
                i = len(text) if end < 0 else end + 2
                out.append(" ")
            elif start and (c == "*" or text.startswith("%*", i)):
                end = text.find(";", i)
                i = len(text) if end < 0 else end + 1
            elif c in "'\"":
                end = text.find(c, i + 1)
                end = len(text) if end < 0 else end + 1
                out.append(text[i:end])
                i, start = end, False
            else:
                out.append(c)
                start = c == ";" or (start and c.isspace())
                i += 1
        return "".join(out)

    draw = random.Random(3)
    for _ in range(20_000):
        text = "".join(draw.choices("a ;*/%'\"\n", k=draw.randint(0, 14)))
        assert without_comments(text) == plainly(text), text


def test_programs_are_parsed_once_and_heavy_datasets_do_not_meet_in_one_task(spark, monkeypatch):
    from batchloom.plans import lineage_tables as lt

    texts = [(f"w{i}", f"data lib.hub; set raw.a{i}; run;") for i in range(2)] + [(f"r{i}", f"data lib.out{i}; set lib.hub raw.rates; run;") for i in range(30)] + [("end", "data lib.end; set lib.out1; run;")]
    use = lt.uses(lt.block_table(spark.createDataFrame(texts, "job string, text string")))
    assert use._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    monkeypatch.setattr(lt, "HEAVY_READERS", 10)
    got = {r.job: r.level for r in lt.job_levels(use).collect()}
    assert got == {"w0": 1, "w1": 1, "end": 3} | {f"r{i}": 2 for i in range(30)}
