"""Packed exchange: instead of millions of tiny rows, each block of texts sends one compressed row to each key it has data for.

A key stands for a part of a hash range; the number of keys follows ``spark.sql.shuffle.partitions``, so what one key holds
stays the same when data and partitions grow together. Receivers get the rows of a key together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

KEYS_PER_PARTITION = 8


def key_count(spark: SparkSession) -> int:
    return KEYS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings as one compressed value, read again by ``unpack``. Numbers are stored byte plane by byte plane."""
    raw = [p if isinstance(p, bytes) else np.ascontiguousarray(np.ravel(p)).view(np.uint8).reshape(-1, p.itemsize).T.tobytes() for p in parts]
    head = np.array([len(raw), *map(len, raw)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(raw))


def unpack(value: bytes, *kinds: str) -> list:
    """The parts of a packed value; a kind is a numpy type or 'bytes'."""
    raw = zstandard.ZstdDecompressor().decompress(value)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8).tolist()
    out, at = [], 8 * (n + 1)
    for size, kind in zip(sizes, kinds, strict=True):
        part = raw[at : at + size]
        out.append(part if kind == "bytes" else np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel())
        at += size
    return out


def split_by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct key with the positions that have it."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cut):
        yield int(key[part[0]]), part


def rows(keys: list[int], values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(values, pa.binary())], ["key", "packed"])


def exchange(packed: DataFrame, receive: Callable[[list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Brings the packed rows of each key together and hands them to ``receive``."""

    def each(table: pa.Table) -> pa.Table:
        out = list(receive(table.column("packed").to_pylist()))
        return pa.Table.from_batches(out) if out else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    return packed.groupBy("key").applyInArrow(each, schema)
