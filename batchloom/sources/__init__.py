"""Reading and writing datasets: libraries, CSV import and export, append, text with uncertain encoding, and table statistics."""

from __future__ import annotations

import fnmatch
import io
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchloom.sources.versions import Versions
from batchloom.stored import exists, names, remove, stored

#: Encodings tried in order.
ENCODINGS = ("utf-8-sig", "utf-8", "latin-1")


class Library:
    """A name for a place of datasets: a folder of Parquet datasets or a catalog schema."""

    def __init__(self, spark: SparkSession, place: str, catalog: bool = False):
        self.spark, self.place, self.catalog = spark, place.rstrip("/"), catalog

    def path(self, member: str) -> str:
        return f"{self.place}.{member}" if self.catalog else f"{self.place}/{member.lower()}.parquet"

    def versions(self, member: str) -> Versions:
        if self.catalog:
            raise ValueError("a catalog keeps its own versions")
        return Versions(self.spark, self.path(member))

    def read(self, member: str) -> DataFrame:
        """The newest version; the frame stays on it whatever is written later."""
        return self.spark.read.table(self.path(member)) if self.catalog else self.versions(member).read()

    def write(self, df: DataFrame, member: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
        """Overwrites by default, so a job can run again; ``append`` adds rows without reading the base. A sort of the whole frame is not kept."""
        path = self.path(member)
        if not self.catalog:
            adds = mode == "append" and self.has(member)
            (self.versions(member).append if adds else self.versions(member).overwrite)(df, partition_by)
            return
        if mode != "overwrite":
            df.write.mode(mode).partitionBy(*partition_by).saveAsTable(path)
            return
        # the frame may read the table it replaces: the new one is written beside it, then takes its place
        new = f"{path}__new_{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).saveAsTable(new)
        self.spark.sql(f"DROP TABLE IF EXISTS {path}")
        self.spark.sql(f"ALTER TABLE {new} RENAME TO {path}")

    def has(self, member: str) -> bool:
        return self.spark.catalog.tableExists(self.path(member)) if self.catalog else exists(self.spark, self.path(member))

    def members(self) -> list[str]:
        """Names of the datasets, sorted; versions that are being written are left out."""
        if self.catalog:
            return sorted(t.name for t in self.spark.catalog.listTables(self.place) if not t.isTemporary and "__new_" not in t.name)
        return [n.removesuffix(".parquet") for n in names(self.spark, self.place) if n.endswith(".parquet")]

    def delete(self, member: str) -> None:
        if self.catalog:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.path(member)}")
        else:
            remove(self.spark, self.path(member))

    def append(self, df: DataFrame, member: str, key: Sequence[str], order: Sequence[str] = ()) -> None:
        """Adds the rows whose key the dataset doesn't have, so a repeated run adds nothing. Keys match null-safely.

        Of rows with one key the first by ``order`` counts (by all columns without one).
        """
        place = Window.partitionBy(*key).orderBy(*(order or [c for c in df.columns if c not in key] or key))
        first = df.withColumn("_r_", F.row_number().over(place)).where("_r_ = 1").drop("_r_")
        here = self.read(member).select(*[F.col(k).alias(f"_k_{k}") for k in key])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key])
        self.write(stored(first.join(here, same, "left_anti")), member, "append")


def import_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, schema: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """PROC IMPORT DBMS=CSV. With a schema the file is read once; without, types are inferred by a first pass."""
    reader = spark.read.option("header", header).option("sep", delimiter).option("encoding", encoding)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def export_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).option("sep", delimiter).csv(path)


def decode(data: bytes) -> tuple[str, str]:
    """Text and the encoding that fitted."""
    for name in ENCODINGS:
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 decodes everything")


def program_files(root: str, exclude: Sequence[str] = (), skip: str = "autoexec*") -> Iterator[tuple[str, str]]:
    """(name, text) of the program files in a folder or zip archive, sorted, without excluded globs and start-up files."""
    path = Path(root)
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            found = [(n, z.read(n)) for n in sorted(z.namelist())]
    elif path.is_file():
        found = [(path.name, path.read_bytes())]
    else:
        found = [(str(p.relative_to(path)), p.read_bytes()) for p in sorted(path.rglob("*")) if p.is_file()]
    for name, data in found:
        base = name.rsplit("/", 1)[-1].lower()
        if base.endswith(".sas") and not fnmatch.fnmatch(base, skip) and not any(fnmatch.fnmatch(name, g) for g in exclude):
            yield name, decode(io.BytesIO(data).getvalue())[0]


def table_statistics(df: DataFrame) -> DataFrame:
    """One row a column: name, type, rows, missing and distinct values (approximate), in one pass."""
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"m{i}"), F.approx_count_distinct(f"`{c}`").alias(f"d{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("n").alias("rows"), F.col(f"m{i}").alias("missing"), F.col(f"d{i}").alias("distinct")) for i, (c, t) in enumerate(df.dtypes)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def described(df: DataFrame) -> DataFrame:
    """Count, mean, standard deviation, least and greatest value of each column as text, one row a column, in one pass."""
    aggs = []
    for i, (c, t) in enumerate(df.dtypes):
        x = F.col(f"`{c}`")
        number = t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")
        plain = F.lit(None).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), (F.avg(x) if number else F.max(plain)).alias(f"m{i}"), (F.stddev_samp(x) if number else F.max(plain)).alias(f"s{i}"), F.min(x).cast("string").alias(f"l{i}"), F.max(x).cast("string").alias(f"h{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(name) for k, name in zip("nmslh", ("count", "mean", "std", "min", "max"), strict=True)]) for i, c in enumerate(df.columns)])
    return df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*")


def sample(df: DataFrame, n: int = 5) -> list[dict]:
    """The first rows that a read gives, as dictionaries: a look at a table, not a random sample."""
    return [r.asDict() for r in df.limit(n).collect()]


def contents(df: DataFrame) -> DataFrame:
    """PROC CONTENTS: position, name, type and format of each variable."""
    rows = [(i, f.name, f.dataType.simpleString(), f.metadata.get("format")) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "num int, name string, type string, format string")
