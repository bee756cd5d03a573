"""Words of whole texts: runs without a space, tab, newline, vertical tab, form feed or return."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from sievelake.llm.batches import gather

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: The same for bytes.translate, which is several times as fast as looking up an array.
_BLANKS, _TO_BLANK, _TO_LOWER = np.flatnonzero(_BLANK).astype(np.uint8).tobytes(), _BLANK.tobytes(), _LOWER.tobytes()


def blanks(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(_TO_BLANK), bool)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case, all others as they are."""
    return np.frombuffer(data.tobytes().translate(_TO_LOWER), np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin (texts + 1). Words end with their text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    dark = ~blanks(data)
    head = np.zeros(len(data), bool)
    head[offsets[:-1][offsets[:-1] < len(data)]] = True
    begin = dark & (head | ~np.concatenate([[False], dark[:-1]]))
    starts = np.flatnonzero(begin)
    tail = np.zeros(len(data), bool)
    tail[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(dark & (tail | ~np.concatenate([dark[1:], [False]]))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as an Arrow array of bytes."""
    dark = data.tobytes().translate(None, _BLANKS)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(dark)])


def byte_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Some runs of the data as an Arrow array of bytes."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[gather(starts, lengths)]))])
