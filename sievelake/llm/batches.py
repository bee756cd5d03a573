"""Arrow batches of whole documents, cut to a bounded number of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of an Arrow batch that the JVM hands to Python, and bytes of text handled at a time.
ROWS_PER_BATCH = 1024
SLICE_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """Limit the Arrow batches of the session that runs ``df`` by rows and bytes."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (rows + 1, from 0) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    rows = len(column)
    if not rows or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(rows + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + rows + 1]
    if column.null_count:
        lengths = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        if lengths.sum() != offsets[-1] - offsets[0]:
            return byte_view(column.fill_null(b""))
        offsets = np.concatenate([[offsets[0]], offsets[0] + np.cumsum(lengths)])
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in pieces of about ``limit`` bytes of text; a row stays whole."""
    for batch in batches:
        _, offsets = byte_view(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def joined(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one, up to about ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs [start, start + length), one after the other."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    ends = np.cumsum(lengths)
    return out + np.repeat(starts - (ends - lengths), lengths)
