"""Reconciliation of two datasets: counts, sums, keys, rows on one side only, and damaged characters."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.0001


def _differs(a, b):
    return F.abs(a - b) > TOLERANCE * F.greatest(F.abs(a), F.lit(1e-12))


def reconcile(expected: DataFrame, actual: DataFrame, keys: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """(check, expected, actual, ok), one row a check; relative tolerance of 0.01 % for counts and sums. Each frame is aggregated once."""
    texts = [c for c, t in expected.dtypes if t == "string" and c in actual.columns]

    def profile(df: DataFrame) -> DataFrame:
        bad = reduce(lambda x, y: x | y, [F.coalesce(F.col(c).contains("�"), F.lit(False)) for c in texts], F.lit(False))
        return df.agg(
            F.count("*").cast("double").alias("row_count"), F.count_distinct(F.struct(*keys)).cast("double").alias("distinct_keys"),
            *[F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(f"sum_{c}") for c in numbers], F.coalesce(F.sum(bad.cast("double")), F.lit(0.0)).alias("damaged_text"),
        )

    a, b = profile(expected), profile(actual)
    both = a.select(F.struct(*a.columns).alias("a")).join(b.select(F.struct(*b.columns).alias("b")))  # one row each
    checks = [F.struct(F.lit(c).alias("check"), F.col(f"a.{c}").alias("expected"), F.col(f"b.{c}").alias("actual"), (~_differs(F.col(f"a.{c}"), F.col(f"b.{c}")) if c != "damaged_text" else F.col("b.damaged_text") <= F.col("a.damaged_text")).alias("ok")) for c in a.columns]
    out = both.select(F.explode(F.array(*checks)).alias("x")).select("x.*")
    for name, left, right in (("missing_rows", expected, actual), ("extra_rows", actual, expected)):
        other = right.select(*[F.col(k).alias(f"_o_{k}") for k in keys]).distinct()
        alone = left.join(other, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]), "left_anti")
        out = out.unionByName(alone.agg(F.count("*").cast("double").alias("actual")).select(F.lit(name).alias("check"), F.lit(0.0).alias("expected"), "actual", (F.col("actual") == 0).alias("ok")))
    return out


class RunState:
    """Progress of jobs in a JSON file that is replaced atomically: DONE jobs are skipped on the next run, FAILED ones are tried again."""

    def __init__(self, path: str):
        self.path = path
        self.jobs: dict[str, str] = {}
        if os.path.exists(path):
            with open(path) as f:
                self.jobs = json.load(f)

    def pending(self, names: Sequence[str]) -> list[str]:
        return [n for n in names if self.jobs.get(n) != "DONE"]

    def mark(self, name: str, status: str) -> None:
        self.jobs[name] = status
        with open(f"{self.path}.new", "w") as f:
            json.dump(self.jobs, f, indent=1, sort_keys=True)
        os.replace(f"{self.path}.new", self.path)

    def run(self, jobs: dict[str, object]) -> dict[str, str]:
        """Runs callables in order; one that fails does not stop the rest."""
        for name in self.pending(list(jobs)):
            try:
                jobs[name]()
                self.mark(name, "DONE")
            except Exception as e:
                self.mark(name, f"FAILED: {e}"[:500])
        return self.jobs
