"""Versioned datasets: append without the base, crashes at each step, pinned frames, upserts and indexed lookups."""

import pytest
from pyspark.sql import functions as F

from batchloom.lang.program import Program
from batchloom.sources import Library, versions
from batchloom.sources.versions import Versions


@pytest.fixture
def data(spark, tmp_path):
    v = Versions(spark, f"{tmp_path}/d.parquet")
    v.overwrite(spark.range(0, 100).selectExpr("id", "id % 7 as g").repartitionByRange(5, "id"))
    return v


def test_append_reads_nothing_of_the_base(spark, data, tmp_path):
    before = data.read()
    for f in tmp_path.rglob("*.parquet"):
        if f.is_file():
            f.chmod(0o000)
    moved = [(f, f.with_suffix(".gone")) for f in tmp_path.rglob("part-*") if f.is_file()]
    for f, g in moved:
        f.rename(g)  # a base that cannot be read
    data.append(spark.range(100, 110).selectExpr("cast(id as int) as id", "'x' as extra"))
    for f, g in moved:
        g.rename(f)
        f.chmod(0o644)
    out = data.read()
    assert out.count() == 110 and out.where("extra = 'x' and g is null").count() == 10 and dict(out.dtypes)["id"] == "bigint"
    assert before.count() == 100 and data.read(1).count() == 100


@pytest.mark.parametrize("step", ["write_text", "move"])
@pytest.mark.parametrize("change", ["append", "overwrite"])
def test_a_crash_leaves_the_version_before(spark, data, monkeypatch, step, change):
    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions, step, crash)
        with pytest.raises(OSError):
            getattr(data, change)(spark.range(5).selectExpr("id", "id as g"))
    assert data.numbers() == [1] and data.read().count() == 100
    getattr(data, change)(spark.range(5).selectExpr("id", "id as g"))
    assert data.read().count() == (105 if change == "append" else 5)
    data.vacuum()
    assert data.numbers() == [2] and data.read().count() == (105 if change == "append" else 5)


def test_two_writers(spark, data):
    data.publish(["x"], data.read().schema, {}, 1)
    with pytest.raises(OSError):
        data.publish(["y"], data.read(1).schema, {}, 1)


def test_lookup_opens_only_matching_files(spark, data):
    data.create_index("id")
    found = data.lookup("id", 42)
    assert [tuple(r) for r in found.collect()] == [(42, 0)] and len(found.inputFiles()) == 1
    data.append(spark.range(500, 505).selectExpr("id", "id as g"))
    later = data.lookup("id", 42)
    assert later.count() == 1 and len(later.inputFiles()) < len(data.read().inputFiles())  # and what was appended since
    assert data.lookup("id", 503).count() == 1 and data.lookup("id", 10_000).count() == 0 and data.lookup("g", 3).count() == 14


def test_upsert_rewrites_only_touched_files(spark, data):
    data.create_index("id")
    old = data.read()
    files = set(data.read().inputFiles())
    data.upsert(spark.createDataFrame([(42, -1), (1000, -2)], "id long, g long"), ["id"])
    kept = files & set(data.read().inputFiles())
    assert len(kept) == len(files) - 1
    rows = {r.id: r.g for r in data.read().collect()}
    assert rows[42] == -1 and rows[1000] == -2 and len(rows) == 101 and data.read().count() == 101 and old.where("g = 0").count() == 15
    data.upsert(spark.createDataFrame([(43, -5)], "id long, g long"), ["id"])
    data.upsert(spark.createDataFrame([(42, -9), (None, 1)], "id long, g long"), ["id"])
    data.upsert(spark.createDataFrame([(None, 2)], "id long, g long"), ["id"])
    rows = {r.id: r.g for r in data.read().collect()}
    assert (rows[42], rows[43], rows[None], len(rows)) == (-9, -5, 2, 102)


def test_plain_folders_and_program_text(spark, tmp_path):
    spark.range(10).selectExpr("id as k").write.parquet(f"{tmp_path}/p.parquet")
    p = Program(spark, {"n": spark.range(10, 12).selectExpr("id as k")}).run(f"libname l '{tmp_path}'; proc append base=l.p data=n; run; proc datasets lib=l; modify p; index create k; quit; data r; set l.p; where k > 8; run;")
    assert sorted(r.k for r in p.frame("r").collect()) == [9, 10, 11]
    assert Library(spark, str(tmp_path)).versions("p").lookup("k", 3).count() == 1
