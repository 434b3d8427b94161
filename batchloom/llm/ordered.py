"""Pieces of text in a declared order, folded into one digest for each key without holding a key's pieces together.

SHA-256 has to see its input in order, so the pieces of a key meet in one task; they stream through it, sorted on disk by Spark, and the state is one digest object.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame


def _digests(separator: bytes):
    def each(batches):
        key, state = None, None
        for b in batches:
            keys, values = [], []
            for k, piece in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                if state is None or k != key:
                    if state is not None:
                        keys.append(key)
                        values.append(state.hexdigest())
                    key, state = k, hashlib.sha256(piece)
                else:
                    state.update(separator)
                    state.update(piece)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(values)], ["key", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], b.schema.field(0).type), pa.array([state.hexdigest()])], ["key", "sha256"])

    return each


def ordered_digests(pieces: DataFrame, key: str, order: list[str], piece: str, separator: str) -> DataFrame:
    """(key, sha256): the lowercase SHA-256 of each key's pieces, in order and joined by the separator."""
    kind = dict(pieces.dtypes)[key]
    lined = pieces.select(key, *order, piece).repartition(key).sortWithinPartitions(key, *order)
    return lined.select(key, piece).mapInArrow(_digests(separator.encode()), f"key {kind}, sha256 string")
