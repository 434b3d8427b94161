import pytest

from batchloom.lang.program import Program
from batchloom.lang.statements import Macros, UnsupportedConstruct, split_statements, without_comments
from batchloom.plans.lineage import JobGraph, blocks, classify, gate, lint


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "a", 10.0), (2, "b", None), (3, "a", 5.0), (4, "c", -1.0)], "id long, g string, x double")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_comments_and_quotes():
    assert without_comments("a = 'x;/*y*/'; * gone; /* gone */ b;").split() == ["a", "=", "'x;/*y*/';", "b;"]
    assert split_statements("a='x;y'; b") == ["a='x;y'", "b"]


def test_macros():
    m = Macros()
    assert m.expand("%let a=x; %let b=a; &a..&b._raw &&&b '&a'").split() == ["x.a_raw", "x", "'&a'"]
    text = m.expand("%macro t(n=2, d=); %do i=1 %to &n; s&i=&d; %end; %if &n > 1 %then %do; many; %end; %else %do; one; %end; %mend; %t(d=q, n=2)")
    assert text.split() == ["s1=q;", "s2=q;", "many;"]
    assert m.expand("%eval(2 + 3*(4-1))") == "11"
    with pytest.raises(UnsupportedConstruct):
        m.expand("%let x = %sysfunc(today());")


def test_missing_rules(spark, people):
    p = Program(spark, {"p": people}).run("data lt; set p; if x < 6; run; data ne; set p; where g ne 'a'; run; data m; set p; if x = .; run; data z; set p; y = x / 0; w = (x > 0) + 1; run;")
    assert rows(p.frame("lt"), "id") == [(2,), (3,), (4,)]
    assert rows(p.frame("ne"), "id") == [(2,), (4,)]
    assert rows(p.frame("m"), "id") == [(2,)]
    assert rows(p.frame("z"), "y", "w") == [(None, 1), (None, 1), (None, 2), (None, 2)]


def test_conditions_keep_their_value(spark, people):
    out = Program(spark, {"p": people}).run("data r; set p; if x > 6 then do; x = 0; y = 1; end; else y = 2; run;").frame("r")
    assert rows(out, "id", "x", "y") == [(1, 0.0, 1), (2, None, 2), (3, 5.0, 2), (4, -1.0, 2)]


def test_retain_first_last(spark, people):
    text = """proc sort data=p; by g id; run;
    data r; set p; by g; retain t 0 n 0 s; if first.g then do; t = 0; n = 0; s = .; end; t + x; n + 1; if x > 7 then s = x; f = first.g; l = last.g; run;"""
    out = Program(spark, {"p": people}).run(text).frame("r")
    assert rows(out, "id", "t", "n", "s", "f", "l") == [(1, 10.0, 1, 10.0, 1, 0), (2, 0.0, 1, None, 1, 1), (3, 15.0, 2, 10.0, 0, 1), (4, -1.0, 1, None, 1, 1)]


def test_retain_needs_order_and_reset(spark, people):
    with pytest.raises(UnsupportedConstruct):
        Program(spark, {"p": people}).run("data r; set p; retain t 0; t + x; run;")


def test_outputs_loops_arrays(spark, people):
    text = """data a(keep=id k) b; set p; array v{2} v1 v2; do k = 1 to 2; v{k} = x * k; output a; end; if g = 'a' then output b; run;"""
    p = Program(spark, {"p": people}).run(text)
    assert len(p.frame("a").collect()) == 8 and p.frame("a").columns == ["id", "k"]
    assert rows(p.frame("b"), "id", "v2") == [(1, 20.0), (3, 10.0)]


def test_merge_with_flags(spark, people):
    other = spark.createDataFrame([("a", "A"), ("z", "Z")], "g string, name string")
    text = "data r; merge p(in=i) o(in=j); by g; if i and not j; run; data f; merge p o; by g; run;"
    p = Program(spark, {"p": people, "o": other}).run(text)
    assert rows(p.frame("r"), "id") == [(2,), (4,)] and p.frame("f").count() == 5


def test_procedures(spark, people):
    text = """proc format; value band low-<0='neg' 0-high='pos'; run;
    proc means data=p nway; class g; var x; output out=m(drop=_type_) mean=avg n=k; run;
    proc freq data=p; tables g / nocum out=fr; run;
    proc rank data=p out=rk; var x; ranks r; run;
    proc transpose data=p out=tr prefix=c; id id; var x; run;
    proc sort data=p out=sorted; by g id; run; proc sort data=sorted nodupkey out=u; by g; run;
    proc append base=all data=p; run; proc append base=all data=p; run;
    proc datasets; delete u; quit;"""
    p = Program(spark, {"p": people}).run(text)
    assert rows(p.frame("m"), "g", "avg", "k", "_freq_") == [("a", 7.5, 2, 2), ("b", None, 0, 1), ("c", -1.0, 1, 1)]
    assert rows(p.frame("fr"), "g", "COUNT") == [("a", 2), ("b", 1), ("c", 1)]
    assert p.frame("tr").columns == ["_name_", "c1", "c2", "c3", "c4"]
    assert p.frame("all").count() == 8 and "u" not in p.data and p.formats["band"]["ranges"]


def test_sql_statements(spark, people):
    text = """proc sql; create table t as select g, sum(x) as s from p group by g having calculated s > 0 order by s desc;
    insert into t select 'q', 1.0 from p where id = 1; update t set s = s + 1 where g = 'q'; delete from t where g = 'a';
    select count(*) into :n from p; select g into :list separated by ',' from t; quit;"""
    p = Program(spark, {"p": people}).run(text)
    assert rows(p.frame("t"), "g", "s") == [("q", 2.0)] and p.macros.variables["n"] == "4" and p.macros.variables["list"] == "q"


def test_unsupported(spark):
    for text in ("proc optmodel; run;", "data a; infile 'x'; run;", "proc sql; connect to oracle; quit;"):
        with pytest.raises(UnsupportedConstruct):
            Program(spark).run(text)


def test_classify_and_blocks():
    assert classify("data a; set b; run;") == "DATA_STEP_SIMPLE" and classify("data a; retain x; run;") == "DATA_STEP_COMPLEX"
    assert classify("data a; declare hash h(); run;") == "HASH_OBJECT" and classify("%macro a; %sysfunc(x) %mend;") == "MACRO_DYNAMIC"
    assert classify("proc tabulate; run;") == "PROC_TABULATE" and classify("proc iml; run;") == "UNKNOWN" and classify("%go(1)") == "MACRO_INVOCATION"
    found = blocks("/* PROC MEANS - note */ libname x '/p'; data x.out(keep=id) y; merge a b; by k; run; proc sql; create table z as select * from q, r w; quit;")
    assert [b.construct for b in found] == ["LIBNAME", "DATA_STEP_SIMPLE", "PROC_SQL"]
    assert found[1].inputs == ("A", "B") and found[1].outputs == ("X.OUT", "Y") and found[2].inputs == ("Q", "R") and found[2].outputs == ("Z",)


def test_graph_gate_lint():
    g = JobGraph()
    g.add("b", "data l.y; set l.x; run;")
    g.add("a", "data l.z; set l.y work.q; run;")
    g.add("c", "data work.q; set l.w; run;")
    assert g.edges() == {("b", "a")} and g.order() == ["b", "a", "c"]
    g.explicit += [("a", "b")]
    assert g.order() == ["c", "a", "b"]
    assert [gate(0, 5), gate(1, 5), gate(1, 10, "LENIENT"), gate(2, 10, "LENIENT"), gate(9, 10, "FORCE"), gate(1, 1, "SKIP")] == ["PASS", "BLOCK", "WARN", "BLOCK", "WARN", "SKIP"]
    assert "append_not_idempotent" in dict(lint("proc append base=a data=b; run;"))
