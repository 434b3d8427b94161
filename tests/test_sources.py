import zipfile

import pytest

from batchloom.operators import datastep, merging, shaping
from batchloom.plans.reconcile import RunState
from batchloom.sources import Library, decode, export_csv, import_csv, program_files
from batchloom.streaming import windowed_means


def test_library_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    lib = Library(spark, str(tmp_path))
    lib.write(df, "T")
    lib.append(spark.createDataFrame([(2, "x"), (3, "c")], "k long, v string"), "T", ["k"])
    lib.append(spark.createDataFrame([(3, "c")], "k long, v string"), "T", ["k"])
    assert sorted(map(tuple, lib.read("t").collect())) == [(1, "a"), (2, "b"), (3, "c")]
    export_csv(df, str(tmp_path / "csv"), ";")
    assert import_csv(spark, str(tmp_path / "csv"), ";", schema="k long, v string").count() == 2


def test_program_files(tmp_path):
    assert decode("é".encode("latin-1")) == ("é", "latin-1") and decode(b"\xef\xbb\xbfa")[0] == "a"
    (tmp_path / "b.sas").write_text("data b;")
    (tmp_path / "autoexec_x.sas").write_text("x")
    (tmp_path / "old.sas").write_text("x")
    assert [n for n, _ in program_files(str(tmp_path), ["old*"])] == ["b.sas"]
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("q/a.sas", "data a;")
    assert list(program_files(str(tmp_path / "p.zip"))) == [("q/a.sas", "data a;")]


def test_run_state(tmp_path):
    calls = []

    def bad():
        raise ValueError("no")

    state = RunState(str(tmp_path / "s.json"))
    state.run({"a": lambda: calls.append("a"), "b": bad})
    state = RunState(str(tmp_path / "s.json"))
    assert state.jobs["b"].startswith("FAILED") and state.pending(["a", "b"]) == ["b"]


def test_empty_frames(spark):
    e = spark.createDataFrame([], "k long, x double")
    assert datastep.numbered(e, ["k"]).count() == 0
    assert merging.merge(e, e.withColumnRenamed("x", "y"), ["k"]).count() == 0
    assert shaping.nodupkey(e, ["k"], ["x"]).count() == 0


def test_guards(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k long, x double")
    with pytest.raises(ValueError):
        merging.assert_unique(df, ["k"])
    with pytest.raises(ValueError):
        datastep.spec(["k"], [])
    with pytest.raises(ValueError):
        shaping.nodupkey(df, ["k"], [])
    with pytest.raises(Exception, match="occurs twice"):
        shaping.transpose(df.withColumn("g", df.k), ["x"], ["g"], "k").collect()


def test_missing_keys_match(spark):
    a = spark.createDataFrame([(None, 1)], "k long, x int")
    b = spark.createDataFrame([(None, 2)], "k long, y int")
    assert [tuple(r) for r in merging.merge(a, b, ["k"], "inner").collect()] == [(None, 1, 2)]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:02:00", "a", 3.0), ("2024-01-01 01:00:00", "a", 5.0), ("2024-01-01 03:00:00", "b", 7.0)], "t string, k string, v double").selectExpr("cast(t as timestamp) t", "k", "v")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_means(stream, "t", "v", ["SUM"], ["k"]).writeStream.format("memory").queryName("w").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert (4.0, 2) in [(r["sum"], r["_FREQ_"]) for r in spark.sql("select * from w").collect()]
