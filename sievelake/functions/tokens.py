"""Token counts of a tokenizer file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def token_counts(rows: DataFrame, keys: list[str], text: str, tokenizer_path: str) -> DataFrame:
    """``keys``, ``n_tokens``, ``restored``: whether decoding gives the text back. Null texts have no tokens."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_tokens long, restored boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            ids = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            back = [tokenizer.decode(i, skip_special_tokens=False) == t for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(i) for i in ids], pa.int64()), pa.array(back, pa.bool_())], names=[*keys, "n_tokens", "restored"])

    return rows.select(*keys, text).mapInArrow(run, schema)
