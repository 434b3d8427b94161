"""Datasets as versions: a manifest names the folders that a version is made of, and one rename publishes it.

A dataset's folder holds part folders (``d-..``), each written once and never changed, and ``_versions/<number>.json``. A new version is a new manifest: APPEND adds a folder to the list and reads nothing of the
base; an overwrite names only its own folder; an upsert rewrites the files that may hold a key and keeps all others. A crash before the rename leaves the version before it as it was. Frames that were read
from a version keep its files until ``vacuum``. Where the store's rename is not atomic (object stores), two writers at once need a lock. A folder of plain Parquet files is version 0 of itself.

An index of a column has, for every file, the least and greatest value and a bit set of hashes with eight bits for each row. Lookups open only files that range and bits cannot rule out, and the
files that were appended after the index was made.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from batchloom.stored import exists, move, names, remove, stored, write_text

BITS_PER_ROW, LEAST_BITS, MOST_BITS = 8, 1 << 10, 1 << 27
#: Most files that a lookup names one by one; beyond that the condition alone prunes.
LOOKUP_FILES = 5_000


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # manifests
    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names(self.spark, f"{self.path}/_versions") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, number: int | None = None) -> dict:
        """The manifest of a version, by default the newest; a plain folder is version 0."""
        known = self.numbers()
        if not known:
            return {"number": 0, "parts": ["."], "schema": None, "indexes": {}}
        number = known[-1] if number is None else number
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{number:020d}.json", wholetext=True).first()[0])

    def publish(self, parts: list[str], schema: StructType, indexes: dict, after: int) -> int:
        """Makes the next version visible by one rename; fails if another writer has published it."""
        number = after + 1
        target = f"{self.path}/_versions/{number:020d}.json"
        waiting = f"{self.path}/_versions/.new-{uuid.uuid4().hex}"
        write_text(self.spark, waiting, json.dumps({"number": number, "parts": parts, "schema": schema.json(), "indexes": indexes}))
        if exists(self.spark, target):
            remove(self.spark, waiting)
            raise OSError(f"version {number} of {self.path} has been published by another writer")
        move(self.spark, waiting, target)
        return number

    def _places(self, manifest: dict) -> list[str]:
        return [self.path if p == "." else f"{self.path}/{p}" for p in manifest["parts"]]

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version; the frame stays on its files whatever is published later."""
        m = self.manifest(number)
        if m["schema"] is None:
            return self.spark.read.parquet(self.path)
        schema = StructType.fromJson(json.loads(m["schema"]))
        if not m["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*self._places(m))

    def _write(self, df: DataFrame, partition_by: Sequence[str] = ()) -> str:
        part = f"d-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{part}")
        return part

    # changes
    def overwrite(self, df: DataFrame, partition_by: Sequence[str] = ()) -> int:
        known = self.numbers()
        return self.publish([self._write(df, partition_by)], df.schema, {}, known[-1] if known else 0)

    def append(self, df: DataFrame, partition_by: Sequence[str] = ()) -> int:
        """Adds rows as a folder of their own. Columns that the base has take its types; columns that either side lacks are missing there."""
        m = self.manifest()
        base = StructType.fromJson(json.loads(m["schema"])) if m["schema"] else self.spark.read.parquet(self.path).schema
        kinds = {f.name.lower(): f for f in base}
        new = df.select(*[F.col(f"`{c}`").cast(kinds[c.lower()].dataType).alias(kinds[c.lower()].name) if c.lower() in kinds else F.col(f"`{c}`") for c in df.columns])
        schema = StructType([*base.fields, *[f for f in new.schema if f.name.lower() not in kinds]])
        return self.publish([*m["parts"], self._write(new, partition_by)], schema, m["indexes"], m["number"])

    def upsert(self, df: DataFrame, key: Sequence[str]) -> int:
        """Rows of ``df`` replace those with their key (missing equals missing), others are added. Of the indexed dataset's files only those that may hold one of the keys are rewritten; without an index on
        the first key all are. Keys are distinct in ``df``."""
        m, df = self.manifest(), stored(df)
        files = self._touched(m, key[0], df.select(F.col(key[0]).alias("k")).distinct()) if key[0] in m["indexes"] else None
        base = self.read(m["number"])
        schema = base.schema
        here = base.withColumn("_f_", F.col("_metadata.file_path"))
        old = here if files is None else here.join(F.broadcast(files), "_f_", "left_semi")  # a row for each touched file
        names_ = [f"_k{i}_" for i in range(len(key))]
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(key, names_, strict=True)])
        kept = old.drop("_f_").join(df.select(*[F.col(k).alias(n) for k, n in zip(key, names_, strict=True)]), same, "left_anti")
        part = self._write(kept.unionByName(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])))
        if files is None:
            return self.publish([part], schema, {}, m["number"])
        gone = {r[0] for r in files.collect()}  # names of touched files, which are as many as the task rewrites
        rest = [f for f in self._files(m) if f not in gone]
        name = self.path.rsplit("/", 1)[-1]
        relative = [f.rsplit(f"/{name}/", 1)[1] for f in rest]
        return self.publish([*relative, part], schema, m["indexes"], m["number"])

    def _files(self, m: dict) -> list[str]:
        return sorted(r[0] for r in self.read(m["number"]).select(F.col("_metadata.file_path")).distinct().collect())  # one name a file

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all but the newest ``keep`` versions, and folders that none of those names. Frames of deleted versions can no longer be read."""
        known = self.numbers()
        manifests = [self.manifest(n) for n in known[-keep:]]
        used = {p.split("/")[0] for m in manifests for p in m["parts"]} | {i["folder"].split("/")[-1] for m in manifests for i in m["indexes"].values()}
        for n in known[:-keep]:
            remove(self.spark, f"{self.path}/_versions/{n:020d}.json")
        for name in names(self.spark, self.path):
            if name.startswith("d-") and name not in used:
                remove(self.spark, f"{self.path}/{name}")
        for name in names(self.spark, f"{self.path}/_index"):
            if name not in used:
                remove(self.spark, f"{self.path}/_index/{name}")

    # indexes
    def create_index(self, column: str) -> int:
        """Ranges and bit sets of a column for every file, as a new version."""
        m = self.manifest()
        base = self.read(m["number"])
        rows = base.select(F.col("_metadata.file_path").alias("file"), F.col(column).alias("k"))
        ranges = rows.groupBy("file").agg(F.min("k").alias("least"), F.max("k").alias("most"), F.count("*").alias("n"), F.count(F.when(F.col("k").isNull(), 1)).alias("nulls"))
        size = F.greatest(F.lit(LEAST_BITS), F.least(F.lit(MOST_BITS), F.pow(F.lit(2), F.ceil(F.log2(F.col("n") * BITS_PER_ROW + 1))).cast("long")))
        ranges = stored(ranges.withColumn("bits", size))
        slot = F.pmod(F.xxhash64("k"), F.col("bits"))
        words = rows.where("k is not null").join(F.broadcast(ranges.select("file", "bits")), "file").select("file", slot.alias("s"))  # a row for each file
        words = words.select("file", F.shiftright("s", 6).alias("word"), F.expr("shiftleft(1L, cast(s % 64 as int))").alias("b")).groupBy("file", "word").agg(F.bit_or("b").alias("b"))
        folder = f"{self.path}/_index/x-{uuid.uuid4().hex}"
        ranges.write.parquet(f"{folder}/ranges")
        words.write.parquet(f"{folder}/words")
        return self.publish(m["parts"], base.schema, {**m["indexes"], column: {"folder": folder}}, m["number"])

    def _index(self, m: dict, column: str) -> tuple[DataFrame, DataFrame]:
        folder = m["indexes"][column]["folder"]
        return self.spark.read.parquet(f"{folder}/ranges"), self.spark.read.parquet(f"{folder}/words")

    def _touched(self, m: dict, column: str, keys: DataFrame) -> DataFrame:
        """(_f_): files of a version that may hold one of the keys, with those that the index does not know."""
        ranges, words = self._index(m, column)
        listed = self.read(m["number"]).select(F.col("_metadata.file_path").alias("file")).distinct()
        unknown = listed.join(ranges.select("file"), "file", "left_anti")
        sizes = ranges.select("bits").distinct()  # one row for each power of two
        asked = keys.where("k is not null").join(F.broadcast(sizes)).select("k", "bits", F.pmod(F.xxhash64("k"), F.col("bits")).alias("s")).withColumn("word", F.shiftright("s", 6))
        near = words.join(ranges.select("file", "bits", "least", "most"), "file").join(asked, ["bits", "word"]).where((F.col("k") >= F.col("least")) & (F.col("k") <= F.col("most")))
        hit = near.where(F.expr("(shiftrightunsigned(b, cast(s % 64 as int)) & 1L) = 1L")).select("file")
        nulls = ranges.where("nulls > 0").join(F.broadcast(keys.where("k is null").limit(1)), how="left_semi").select("file")  # one row
        found = hit.union(nulls).distinct().join(listed, "file", "left_semi").union(unknown).distinct()
        return stored(found.select(F.col("file").alias("_f_")))

    def lookup(self, column: str, value: object) -> DataFrame:
        """The rows whose column equals a value. With an index the plan opens only the files that may hold it."""
        m = self.manifest()
        base = self.read(m["number"])
        test: Column = F.col(column) == F.lit(value)
        if column not in m["indexes"]:
            return base.where(test)
        key = self.spark.range(1).select(F.lit(value).cast(base.schema[column].dataType).alias("k"))
        files = self._touched(m, column, key).limit(LOOKUP_FILES + 1).collect()
        if not files:
            return base.limit(0)
        if len(files) > LOOKUP_FILES:
            return base.where(test)
        return self.spark.read.schema(base.schema).parquet(*[f[0] for f in files]).where(test)
