"""MERGE, UPDATE, hash lookup and set operators. BY keys match null-safely: a missing key is a value."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _on(a: DataFrame, b: DataFrame, by: Sequence[str]):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in by])


def duplicate_keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The frame, unless a key repeats (runs a job)."""
    if duplicate_keys(df, by).limit(1).count():
        raise ValueError(f"keys {list(by)} are not unique")
    return df


def merge(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "full", flags: tuple[str, str] | None = None) -> DataFrame:
    """MERGE a b; BY k. ``how`` states the IN= condition: inner (both), left (IF a), right, full, left_only, right_only, not_both.

    Columns of both sides: the right value wins where the right side has the key. Keys must be unique on one side at least;
    many-to-many is what a join gives, not the sequential pairing (see ``merge_sequential``).
    """
    a = left.withColumn("_ina_", F.lit(1))
    b = right.select(*[F.col(c).alias(f"_b_{c}") for c in right.columns], F.lit(1).alias("_inb_"))
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in by])
    joined = a.join(b, on, {"inner": "inner", "left": "left", "right": "right"}.get(how, "full"))
    has_a, has_b = F.coalesce("_ina_", F.lit(0)), F.coalesce("_inb_", F.lit(0))
    cond = {"left_only": (has_a == 1) & (has_b == 0), "right_only": (has_a == 0) & (has_b == 1), "not_both": has_a != has_b}.get(how)
    if cond is not None:
        joined = joined.where(cond)
    out = [F.when(has_a == 1, F.col(k)).otherwise(F.col(f"_b_{k}")).alias(k) for k in by]
    for c in left.columns:
        if c not in by:
            out.append(F.when(has_b == 1, F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c) if c in right.columns else F.col(c))
    out += [F.col(f"_b_{c}").alias(c) for c in right.columns if c not in by and c not in left.columns]
    if flags:
        out += [has_a.alias(flags[0]), has_b.alias(flags[1])]
    return joined.select(*out)


def merge_one_to_one(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """MERGE a b without BY: rows paired by position in the declared orders."""
    from batchloom.operators.datastep import numbered

    out = merge(numbered(left, left_order, "_pos_"), numbered(right, right_order, "_pos_"), ["_pos_"], "full")
    return out.drop("_pos_")


def merge_sequential(left: DataFrame, right: DataFrame, by: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """MERGE BY with repeats on both sides: the i-th rows of a group pair up; the shorter side's last row is kept to the end of the group."""

    def placed(df, order):
        w = Window.partitionBy(*by)
        return df.withColumns({"_i_": F.row_number().over(w.orderBy(*order)), "_last_": F.count("*").over(w)})

    a, b = placed(left, left_order), placed(right, right_order)
    size = a.groupBy(*by).agg(F.max("_last_").alias("_na_"))
    other = b.groupBy(*by).agg(F.max("_last_").alias("_nb_"))
    groups = merge(size, other, by, "full").withColumn("_i_", F.explode(F.sequence(F.lit(1), F.greatest("_na_", "_nb_").cast("int"))))
    x = groups.withColumn("_j_", F.least("_i_", "_na_")).withColumn("_k_", F.least("_i_", "_nb_"))
    a, b = a.withColumnRenamed("_i_", "_j_").drop("_last_"), b.withColumnRenamed("_i_", "_k_").drop("_last_")
    same = [c for c in right.columns if c in left.columns and c not in by]
    out = merge(x, a, [*by, "_j_"], "left")
    out = merge(out.withColumnsRenamed({c: f"_l_{c}" for c in same}), b, [*by, "_k_"], "left")
    cols = [F.coalesce(c, f"_l_{c}").alias(c) if c in same else F.col(c) for c in dict.fromkeys([*left.columns, *right.columns])]
    return out.select(*cols)


def update(master: DataFrame, transactions: DataFrame, by: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """UPDATE master trans; BY k: values that aren't missing overwrite; new keys are added; with an order, later transactions win."""
    values = [c for c in transactions.columns if c not in by and c not in order]
    if order:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        transactions = transactions.select(*by, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in values]).dropDuplicates(list(by))
    renamed = transactions.select(*by, *[F.col(c).alias(f"_t_{c}") for c in values])
    out = merge(master, renamed, by, "full")
    return out.select(*[F.coalesce(f"_t_{c}", c).alias(c) if c in values else F.col(c) for c in master.columns], *[F.col(f"_t_{c}").alias(c) for c in values if c not in master.columns])


HASH_ROWS = 1_000_000
HASH_BYTES = 64 << 20


def hash_lookup(df: DataFrame, table: DataFrame, by: Sequence[str], data: Sequence[str], order: Sequence = (), found: str | None = None) -> DataFrame:
    """Hash object find(): data columns of the table's first row of each key (by the declared order), missing if absent.

    The table is broadcast only if it has at most HASH_ROWS rows and HASH_BYTES of values (counted); larger ones are joined by shuffle.
    """
    if order:
        first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        table = table.withColumn("_r_", first).where("_r_ = 1").drop("_r_")
    else:
        table = table.dropDuplicates(list(by))
    table = table.select(*by, *data, F.lit(1).alias("_found_"))
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in (*by, *data)), F.lit(0))
    size = table.limit(HASH_ROWS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    small = size.n <= HASH_ROWS and size.b <= HASH_BYTES
    right = F.broadcast(table) if small else table
    out = df.join(right, _on(df, table, by), "left")
    cols = [df[c] for c in df.columns if c not in data] + [table[c] for c in data]
    if found:
        cols.append(F.coalesce(table["_found_"], F.lit(0)).alias(found))
    return out.select(*cols)


def outer_union_corr(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scd2(current: DataFrame, incoming: DataFrame, by: Sequence[str], values: Sequence[str], day, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Slowly changing dimension, type 2: changed keys get their open row closed on ``day`` and a new open row; new keys a row; the rest stays."""
    new = incoming.select(*by, *[F.col(v).alias(f"_n_{v}") for v in values], F.lit(True).alias("_new_"))
    joined = current.join(new, _on(current, new, by), "left").select(*[current[c] for c in current.columns], *[new[f"_n_{v}"] for v in values], new["_new_"])
    differs = reduce(lambda a, b: a | b, [~F.col(v).eqNullSafe(F.col(f"_n_{v}")) for v in values])
    changed = F.col("_new_").isNotNull() & F.col(end).isNull() & differs
    kept = joined.withColumn(end, F.when(changed, F.lit(day).cast("date")).otherwise(F.col(end))).select(*current.columns)
    open_rows = current.where(F.col(end).isNull())
    same = reduce(lambda a, b: a & b, [incoming[v].eqNullSafe(open_rows[v]) for v in values], _on(incoming, open_rows, by))
    added = incoming.join(open_rows, same, "left_anti").select(*by, *values, F.lit(day).cast("date").alias(start), F.lit(None).cast("date").alias(end))
    return kept.unionByName(added)


def upsert(base: DataFrame, changes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of ``changes`` replace those with their key; other rows stay."""
    return base.join(changes, _on(base, changes, by), "left_anti").unionByName(changes)
