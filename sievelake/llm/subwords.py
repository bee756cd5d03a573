"""Byte-level BPE ids of whole texts.

Texts are cut where a space follows a visible character. A pretoken of the
vocabulary's pattern never spans such a place and the pattern never looks
behind, so the ids of a text are those of its chunks, one after the other.
Each distinct chunk of a batch is encoded once.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

from sievelake.llm.batches import byte_view, gather

#: The split pattern of the public byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of characters other than ASCII and letters from U+00C0 to U+023F, which all Unicode versions class alike.
_RARE = np.zeros(256, np.int64)
_RARE[[0xC2, *range(0xC9, 0x100)]] = 1
#: Bytes that, last in a plain character, are no white space.
_SOLID = np.ones(256, bool)
_SOLID[[*range(9, 14), *range(28, 33)]] = False
#: Longer chunks go to the library, whose merges stay fast.
_LONG = 400


#: Chunks whose ids a worker keeps.
_CACHED = 500_000


def _fit(store: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The store with ``more`` after its first ``used`` values; grows by doubling."""
    if used + len(more) > len(store):
        store = np.concatenate([store, np.zeros(max(len(store), len(more)), store.dtype)])
    store[used : used + len(more)] = more
    return store


def _visible_bytes() -> dict[str, int]:
    """Which byte each character of the vocabulary file stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: each non-empty text, and each space after a character that isn't white space."""
    cut = np.flatnonzero(data == 0x20)
    cut = cut[cut >= 3]
    last, middle, first = data[cut - 1], data[cut - 2], data[cut - 3]
    wide = ((middle == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((first >= 0xE1) & (first <= 0xE3) & (middle >= 0x80))
    cut = cut[_SOLID[last] & ~wide]
    begins = offsets[:-1][np.diff(offsets) > 0]
    marked = np.zeros(len(data), bool)
    marked[cut] = True
    marked[begins] = True
    return np.flatnonzero(marked)


class ByteBpe:
    """Encodes like the ``tokenizers`` library with ``add_special_tokens=False``."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        self.size = len(stored["model"]["vocab"])
        special = {t["content"] for t in stored.get("added_tokens", ())}
        of = _visible_bytes()
        ranks = {bytes(of[c] for c in piece): i for piece, i in stored["model"]["vocab"].items() if piece not in special}
        self.special = [s.encode() for s in special]
        self.fast = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of_id = np.zeros(max(ranks.values()) + 1, np.int64)
        self.begins_word = np.zeros(self.size, bool)
        for piece, i in ranks.items():
            self.bytes_of_id[i], self.begins_word[i] = len(piece), piece[0] == 0x20
        self.clear()

    def clear(self) -> None:
        """Forget all chunks."""
        self.slots: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.used = 0

    def slots_of(self, chunks: pa.Array) -> np.ndarray:
        """Where the ids of distinct chunks are kept: ``ids[starts[slot]:][:lengths[slot]]``. New chunks are
        encoded together; the cache holds a bounded number of chunks, besides those of this call."""
        listed = chunks.to_pylist()
        if len(self.slots) + len(listed) > _CACHED:
            self.clear()
        found = [self.slots.get(c, -1) for c in listed]
        slot = np.array(found, np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            ids, counts = self._encode_chunks(chunks.take(pa.array(new)))
            base = len(self.slots)
            self.starts = _fit(self.starts, base, self.used + np.cumsum(counts) - counts)
            self.lengths = _fit(self.lengths, base, counts)
            self.ids = _fit(self.ids, self.used, ids)
            self.used += len(ids)
            slot[new] = np.arange(base, base + len(new))
            self.slots.update(zip([listed[i] for i in new.tolist()], range(base, base + len(new))))
        return slot

    def fresh(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, one after the other, and how many each has; none is kept."""
        return self._encode_chunks(chunks) if len(chunks) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, one after the other, and how many each has.

        Chunks that begin with a space, end visibly and hold plain characters are
        encoded as one text: their borders are places where texts may be cut, and
        the bytes of the ids tell which chunk each belongs to.
        """
        data, offsets = byte_view(chunks)
        lengths, raw = np.diff(offsets), data.tobytes()
        rare = np.add.reduceat(_RARE[data], offsets[:-1])
        easy = (data[offsets[:-1]] == 0x20) & _SOLID[data[offsets[1:] - 1]] & (rare == 0) & (lengths <= _LONG)
        if any(s in raw for s in self.special):
            easy &= [not any(s in raw[a:b] for s in self.special) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        counts = np.zeros(len(chunks), np.int64)
        text = data[np.repeat(easy, lengths)].tobytes().decode()
        ids = self.fast.encode_to_numpy(text, disallowed_special=())
        reach = np.cumsum(self.bytes_of_id[ids])
        counts[easy] = np.diff(np.searchsorted(reach, np.cumsum(lengths[easy]), side="right"), prepend=0)
        hard = np.flatnonzero(~easy)
        spans = zip(offsets[hard].tolist(), offsets[hard + 1].tolist())
        others = [self.library.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids if rare[k] or b - a > _LONG or any(s in raw[a:b] for s in self.special) else self.fast.encode_ordinary(raw[a:b].decode()) for k, (a, b) in zip(hard.tolist(), spans)]
        counts[hard] = [len(x) for x in others]
        flat = np.empty(int(counts.sum()), np.uint32)
        flat[np.repeat(easy, counts)] = ids
        flat[np.repeat(~easy, counts)] = np.fromiter((i for x in others for i in x), np.uint32, int(counts[hard].sum()))
        return flat, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids begin (texts + 1)."""
        starts = chunk_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        bounds = np.append(starts, len(data)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        slot = self.slots_of(coded.dictionary)[coded.indices.to_numpy()]
        lengths = self.lengths[slot]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[gather(self.starts[slot], lengths)], ends[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each Python worker and vocabulary file."""
    return ByteBpe(path)
