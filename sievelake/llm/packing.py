"""Packing by power-of-two decomposition.

Each document's ids are cut into as many full sequences as fit, then into the
binary digits of the rest, longest first. Every piece is a sequence of its own
in the bucket of its length, so there is no padding and no sequence crosses
documents. A trainer draws batches from one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.batches import bounded, byte_view, slices
from sievelake.llm.subwords import byte_bpe

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int"


def piece_lengths(tokens: int, longest: int) -> list[int]:
    """``longest`` as often as it fits, then the binary digits of the rest in falling order."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 1024, end_id: int = 0
) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit numbers.

    A document is its ids and then ``end_id``: a null or empty text is one piece
    that holds ``end_id`` alone. Rows that repeat, or have a null id, are packed
    each for itself. Other columns are ignored, whatever their names. An empty
    table gives no rows. ``sequence_id`` holds the partition, the place in it and
    the bucket (log2 of the length): it is unique and no shuffle is needed.
    Memory: one slice of a few MB of text and its ids, or one longer document.
    """
    if longest < 1 or longest & (longest - 1) or longest > 1 << 15:
        raise ValueError("longest must be a power of two, 32768 at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, place = byte_bpe(tokenizer_path), TaskContext.get().partitionId() << 36
        for batch in slices(batches, "text"):
            flat, bounds = encoder.encode(*byte_view(batch.column(1)))
            keys = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for key, begin, end in zip(keys, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                tokens = end - begin + 1
                data = np.append(flat[begin:end], np.uint32(end_id)).astype("<u4").tobytes()
                start = 0
                for length in piece_lengths(tokens, longest):
                    bucket = length.bit_length() - 1
                    rows.append((key, start, length, data[4 * start : 4 * (start + length)], tokens, place | bucket, 0, bucket))
                    place += 16
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return bounded(chosen).mapInArrow(run, SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the pieces so that each bucket, sequences of one length, is a folder of its own; fails if something is there."""
    pieces.write.partitionBy("bucket").mode("errorifexists").parquet(path)


NAMES = [field.split()[0] for field in SCHEMA.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
