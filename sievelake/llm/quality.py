"""Quality rules: word statistics and zstandard compression bands.

The ratio of raw to compressed bytes tells repetitive text (high) and random or
encoded text (low). What is usual depends on the length, as a short text has
little to refer back to: each band holds up to a length. The whole text must lie
in its band, and so must the fixed chunks that make up most of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.batches import bounded, byte_view, slices
from sievelake.llm.words import blanks, word_array, word_spans

#: (bytes below which the band holds, lowest and highest ratio kept) at level 3. Prose lies at about
#: 0.9-1.6, 1.3-2.0, 1.7-2.3, 2.1-2.5 and 2.3-3.2; base64 stays under 1.4 at any length.
BANDS = ((256, 0.0, 2.5), (1024, 1.1, 3.0), (4096, 1.4, 3.5), (16384, 1.45, 4.0), (None, 1.45, 4.5))
CHUNK_BYTES, CHUNK_SHARE, LEVEL = 2048, 0.5, 3
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, odd_chunks double, kept boolean, reason string"


def band(size: int) -> tuple[float, float]:
    return next((low, high) for below, low, high in BANDS if below is None or size < below)


def compression(text: bytes, packer) -> tuple[float | None, float]:
    """Ratio of the whole text (None if empty), and the share of its bytes in chunks out of their bands.
    A rest shorter than half a chunk belongs to the chunk before."""
    if not text:
        return None, 0.0
    ratio = len(text) / len(packer.compress(text))
    if len(text) < 3 * CHUNK_BYTES // 2:
        low, high = band(len(text))
        return ratio, 0.0 if low <= ratio <= high else 1.0
    cuts = list(range(0, len(text), CHUNK_BYTES)) + [len(text)]
    if cuts[-1] - cuts[-2] < CHUNK_BYTES // 2:
        del cuts[-2]
    odd = 0
    for a, b in zip(cuts, cuts[1:]):
        low, high = band(b - a)
        if not low <= (b - a) / len(packer.compress(text[a:b])) <= high:
            odd += b - a
    return ratio, odd / len(text)


def repeated_words(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text (its word numbers ``ids[bounds[i]:bounds[i + 1]]``), how many words lie in windows that occur twice."""
    n, out = len(ids), np.zeros(len(bounds) - 1, np.int64)
    if n < WINDOW:
        return out
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = text[: n - WINDOW + 1] == text[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return out
    keys = text[at].astype(np.uint64)
    for k in range(WINDOW):
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64)
    keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    a, b = at[order[1:][same]], at[order[:-1][same]]
    equal = text[a] == text[b]
    for k in range(WINDOW):
        equal &= ids[a + k] == ids[b + k]
    if not equal.all():  # two windows share a key: decide by the words themselves
        rows = np.column_stack([text[at], *[ids[at + k] for k in range(WINDOW)]])
        _, back, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        twice = at[counts[back.ravel()] > 1]
    else:
        twice = np.concatenate([a, b])
    covered = np.zeros(n, bool)
    for k in range(WINDOW):
        covered[twice + k] = True
    np.add.at(out, text[covered], 1)
    return out


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measure(column: pa.Array, packer) -> list[pa.Array]:
    """The columns of MEASURES for whole texts; null is none."""
    data, offsets = byte_view(column)
    starts, ends, bounds = word_spans(data, offsets)
    words = word_array(data, starts, ends).dictionary_encode()
    ids = words.indices.to_numpy().astype(np.int64)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    n_words = np.diff(bounds)
    chars = total(((data & 0xC0) != 0x80) & ~blanks(data))
    symbols = total(_SYMBOL[data])
    repeats = repeated_words(ids, bounds)
    base = (n_words < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n_words)
    raw, spans = data.tobytes(), list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
    lines, ratios, odd, kept, reasons = [], [], [], [], []
    for (a, b), failed, n in zip(spans, base.tolist(), n_words.tolist()):
        text = raw[a:b]
        ratio, share = compression(text, packer)
        low, high = band(len(text))
        reason = None
        if failed:
            reason = "few words" if n < MIN_WORDS else "repeated windows"
        elif ratio > high:
            reason = "repetitive"
        elif ratio < low:
            reason = "incompressible"
        elif share > CHUNK_SHARE:
            reason = "odd chunks"
        lines.append(duplicate_lines(text))
        ratios.append(ratio)
        odd.append(share)
        reasons.append(reason)
        kept.append(reason is None)
    numbers = [pa.array(x, pa.int64()) for x in (n_words, chars, symbols, lines, repeats)]
    return [*numbers, pa.array(base), pa.array(ratios, pa.float64()), pa.array(odd, pa.float64()), pa.array(kept, pa.bool_()), pa.array(reasons, pa.string())]


def _packer():
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and MEASURES of each row; rejected rows stay, with a reason.

    A null or empty text has no words and is rejected. Null and repeated ids are
    rows of their own; other columns are ignored, whatever their names; an empty
    table gives no rows. Memory: a slice of a few MB of text or one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, names = _packer(), ["doc_id", *[f.split()[0] for f in MEASURES.split(", ")]]
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), *measure(batch.column(1), packer)], names=names)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded(chosen).mapInArrow(run, f"doc_id long, {MEASURES}")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names.

    Null and empty texts go, repeated rows are judged each, nulls in other columns
    stay as they are; an empty table gives no rows.
    """
    columns = docs.columns
    at, kept = columns.index(text_col), [f.split()[0] for f in MEASURES.split(", ")].index("kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _packer()
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=[str(i) for i in range(batch.num_columns)])
            for part in slices(iter([batch]), str(at)):
                part = part.filter(measure(part.column(at), packer)[kept])
                yield pa.RecordBatch.from_arrays(part.columns, names=columns)

    return bounded(docs).mapInArrow(run, docs.schema)
