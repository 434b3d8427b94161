"""Lineage of a table of programs: blocks, datasets, job levels, inventory, preflight, gate and lints as Spark jobs.

Each text is split where it lies; what is shuffled are names. Jobs meet over the datasets that they read and write, never as pairs: a dataset with many writers and readers makes a row for each of
them. Levels are found in rounds, as many as the longest chain of jobs; a round settles every job whose datasets have all been written.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.plans.lineage import CONFIDENCE, IGNORED_LIBRARIES, TIER_OF, blocks, lint
from batchloom.stored import stored

#: More readers than this make a dataset a heavy one; there are at most rows / HEAVY_READERS of them.
HEAVY_READERS = 100_000

_BLOCKS = "job string, n int, construct string, tier string, confidence double, inputs array<string>, outputs array<string>"


def _permanent(names: tuple[str, ...]) -> list[str]:
    return [n for n in names if "." in n and n.split(".")[0] not in IGNORED_LIBRARIES]


def _split(batches):
    for b in batches:
        rows = []
        for job, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for n, x in enumerate(blocks(text or ""), 1):
                tier = TIER_OF[x.construct]
                rows.append((job, n, x.construct, tier, CONFIDENCE[tier], _permanent(x.inputs), _permanent(x.outputs)))
        if rows:
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["job", "n", "construct", "tier", "confidence", "inputs", "outputs"])


def _lint(batches):
    for b in batches:
        rows = [(job, name, advice) for job, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for name, advice in lint(text or "")]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["job", "lint", "advice"])


def block_table(programs: DataFrame) -> DataFrame:
    """(job, n, construct, tier, confidence, inputs, outputs) of every block of the programs (job, text); datasets are permanent ones in upper case."""
    return programs.select("job", "text").mapInArrow(_split, _BLOCKS)


def lint_table(programs: DataFrame) -> DataFrame:
    """(job, lint, advice)."""
    return programs.select("job", "text").mapInArrow(_lint, "job string, lint string, advice string")


def uses(block_rows: DataFrame) -> DataFrame:
    """(job, dataset, reads, writes): one row for each job and dataset."""

    def named(c: str):
        return F.transform(c, lambda d: F.struct(d.alias("dataset"), F.lit(c == "inputs").alias("reads"), F.lit(c == "outputs").alias("writes")))

    # both lists in one explode: a union of two would parse every program twice
    rows = block_rows.select("job", F.explode(F.concat(named("inputs"), named("outputs"))).alias("u")).select("job", "u.*")
    return rows.groupBy("job", "dataset").agg(F.max("reads").alias("reads"), F.max("writes").alias("writes"))


def inventory_table(use: DataFrame) -> DataFrame:
    """(dataset, role, readers, writers): SOURCE is only read, TARGET only written, INTERMEDIATE both, UNRESOLVED holds a macro variable; readers and writers are counted."""
    found = use.groupBy("dataset").agg(F.count(F.when(F.col("reads"), 1)).alias("readers"), F.count(F.when(F.col("writes"), 1)).alias("writers"))
    role = F.when(F.contains("dataset", F.lit("&")), "UNRESOLVED").when((F.col("readers") > 0) & (F.col("writers") > 0), "INTERMEDIATE").when(F.col("readers") > 0, "SOURCE").otherwise("TARGET")
    return found.select("dataset", role.alias("role"), "readers", "writers")


def job_levels(use: DataFrame) -> DataFrame:
    """(job, level): 1 for jobs that wait for none, else one more than the greatest level of the jobs that write what they read; null on cycles and behind them. A job does not wait for itself."""
    use = stored(use)
    jobs = use.select("job").distinct()
    writes = use.where("writes").select("dataset", F.col("job").alias("writer"))
    many = writes.groupBy("dataset").agg(F.count("*").alias("n"), F.min("writer").alias("one"))
    # datasets with so many readers that their rows would fill one task of a join: they meet a broadcast of themselves instead
    heavy = F.broadcast(stored(use.where("reads").groupBy("dataset").count().where(F.col("count") > HEAVY_READERS).select("dataset")))

    def on_dataset(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
        light = rows.join(heavy, "dataset", "left_anti").join(table, "dataset", how)
        return light.unionByName(rows.join(heavy, "dataset", "left_semi").join(F.broadcast(table.join(heavy, "dataset", "left_semi")), "dataset", how))

    # what a job waits for: datasets that another job writes
    waits = stored(on_dataset(use.where("reads"), many, "inner").where((F.col("n") > 1) | (F.col("one") != F.col("job"))).select("job", "dataset", "n", F.col("writes").alias("own")))
    settled = stored(jobs.join(waits.select("job").distinct(), "job", "left_anti").withColumn("level", F.lit(1)))
    round_ = 1
    while True:
        done = writes.join(settled.select(F.col("job").alias("writer")), "writer").groupBy("dataset").agg(F.count("*").alias("done"))
        left = on_dataset(waits.join(settled, "job", "left_anti"), done, "left")
        ready = left.groupBy("job").agg(F.min(F.coalesce(F.col("done"), F.lit(0)) + F.col("own").cast("int") >= F.col("n")).alias("ready")).where("ready").select("job")
        round_ += 1
        ready = stored(ready.withColumn("level", F.lit(round_)))
        if not ready.limit(1).count():
            return jobs.join(settled, "job", "left")
        settled = stored(settled.unionByName(ready))


def preflight_table(inventory: DataFrame, known: DataFrame) -> DataFrame:
    """(dataset, status) of what jobs read: present among ``known`` (dataset), written by another job first (missing_upstream), or provided by nothing (missing_source)."""
    read = inventory.where("readers > 0 and role <> 'UNRESOLVED'").join(known.select(F.upper("dataset").alias("k")).distinct(), F.col("dataset") == F.col("k"), "left")
    return read.select("dataset", F.when(F.col("k").isNotNull(), "present").when(F.col("writers") > 0, "missing_upstream").otherwise("missing_source").alias("status"))


def gate_table(preflight: DataFrame) -> DataFrame:
    """(mode, missing, total, result) of the four modes: STRICT blocks on any missing source, LENIENT on a fifth or more, FORCE never, SKIP does not look."""
    counts = preflight.agg(F.count(F.when(F.col("status") == "missing_source", 1)).alias("missing"), F.count("*").alias("total"))
    rows = counts.withColumn("mode", F.explode(F.array(*map(F.lit, ("STRICT", "LENIENT", "FORCE", "SKIP")))))
    warn = (F.col("mode") == "FORCE") | (F.col("mode") == "LENIENT") & (F.col("missing") < 0.2 * F.col("total"))
    return rows.select("mode", "missing", "total", F.when(F.col("mode") == "SKIP", "SKIP").when(F.col("missing") == 0, "PASS").when(warn, "WARN").otherwise("BLOCK").alias("result"))
