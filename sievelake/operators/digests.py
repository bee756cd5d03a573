"""Digests of ordered lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_digest(rows: DataFrame, keys: list[str], order: str, line: Column) -> DataFrame:
    """``keys`` and ``digest``: SHA-256 of each key's lines in order, joined by newlines.

    The digest is one of the whole sequence, so a key is one stream; it is sorted
    outside memory and hashed batch by batch, and no row holds more than a line.
    Without keys there is one row, of no lines too; a null line counts as empty.
    """
    names = [f"k{i}" for i in range(len(keys))]
    flat = rows.select(*[F.col(k).cast("string").alias(n) for k, n in zip(keys, names)], F.col(order).alias("at"), F.coalesce(line, F.lit("")).alias("line"))
    dealt = (flat.repartition(*names) if keys else flat.repartition(1)).sortWithinPartitions(*names, "at", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = (None if keys else ()), (None if keys else hashlib.sha256())
        first, done = True, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(names))]
            lines = batch.column(len(names) + 1).to_pylist()
            for i, text in enumerate(lines):
                key = tuple(c[i] for c in columns)
                if state is None or key != now:
                    if state is not None:
                        done.append((*now, state.hexdigest()))
                    now, state, first = key, hashlib.sha256(), True
                state.update((text if first else "\n" + text).encode())
                first = False
        if state is not None:
            done.append((*now, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], pa.string()) for i in range(len(names) + 1)], names=[*names, "digest"])

    made = dealt.mapInArrow(run, ", ".join(f"{n} string" for n in [*names, "digest"]))
    if not keys:
        return made.agg(F.coalesce(F.max("digest"), F.lit(hashlib.sha256(b"").hexdigest())).alias("digest"))
    types = dict(rows.select(*keys).dtypes)
    return made.select(*[F.col(n).cast(types[k]).alias(k) for k, n in zip(keys, names)], "digest")
