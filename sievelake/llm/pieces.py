"""SentencePiece BPE by vectorised merge rounds.

All words of a slice lie in flat arrays of symbols. A round finds the best pair
rank of each word (a segmented minimum), merges its leftmost non-overlapping
occurrences at once, and compacts; words without a pair leave. Rounds go on
until no word is left.

The library merges one pair at a time, best score first and leftmost among
equals. Merging all occurrences of a piece at once gives the same result unless
the new piece at once takes part in a pair that is as good or better; such
pieces (``hasty``) are merged one occurrence a round.

A word ends where a space mark follows another character: no piece of the model
holds such a place, so no merge can cross it (checked when the model is loaded).
"""

from __future__ import annotations

import codecs
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.batches import bounded, byte_view, gather, slices

MARK = "▁"
_NONE = np.iinfo(np.int32).max
_CACHE_WORDS, _CACHE_IDS = 300_000, 3_000_000
#: Rounds after which a word of equal-ranked runs is finished with a heap instead.
_ROUNDS = 400
codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class PieceModel:
    """A BPE model with identity normalisation, byte fallback or an unknown id, and a space put in front."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or kinds & {4, 5} or train.treat_whitespace_as_suffix:
            raise ValueError("only plain BPE models with identity normalisation are supported")
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
        if any(b == MARK != a for piece in normal for a, b in zip(piece, piece[1:])):
            raise ValueError("a piece of this model crosses words")
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.byte_ids = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6} if train.byte_fallback else {}
        self.symbols = {piece: i for piece, (i, _) in normal.items()}
        for piece in normal:
            for char in piece:
                self.symbols.setdefault(char, len(model.pieces) + len(self.symbols))
        self.base = len(model.pieces)
        scores = sorted({s for _, s in normal.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        pairs, hasty = [], set()
        for piece, (i, score) in normal.items():
            for k in range(1, len(piece)):
                left, right = self.symbols.get(piece[:k]), self.symbols.get(piece[k:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, i, rank_of[score]))
                    for part in (piece[:k], piece[k:]):
                        if len(part) > 1 and normal[part][1] <= score:
                            hasty.add(self.symbols[part])
        pairs.sort()
        self.pair_keys, self.pair_ids, self.pair_ranks = (np.array(x, t) for x, t in zip(zip(*pairs), (np.int64, np.int64, np.int32)))
        self.hasty = np.zeros(max(self.symbols.values()) + 1, bool)
        self.hasty[list(hasty)] = True
        shown = [self._shown(p) for p in model.pieces]
        self.out_starts = np.cumsum([0, *map(len, shown)])[:-1].astype(np.int64)
        self.out_lengths = np.array([*map(len, shown)], np.int64)
        self.out_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.opens = np.array([p.type == 1 and p.piece.startswith(MARK) for p in model.pieces])
        self.clear()

    @staticmethod
    def _shown(p) -> bytes:
        if p.type == 6:
            return bytes([int(p.piece[3:-1], 16)])
        return {1: p.piece.replace(MARK, " "), 2: " ⁇ "}.get(p.type, "").encode()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank _NONE if there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.pair_ranks[at], _NONE), self.pair_ids[at]

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over flat symbols; -2 - c stands for a character c that no piece holds.
        Returns the remaining symbols and their words, in order."""
        done_symbols, done_words, rounds = [], [], 0
        rank, merged = np.full(len(symbols), _NONE, np.int32), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            inside = word[1:] == word[:-1]
            r, m = self._pairs(symbols[:-1], symbols[1:])
            rank[:-1], merged[:-1] = np.where(inside, r, _NONE), m
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(symbols)))
            if (best == _NONE).any():
                over = np.repeat(best == _NONE, counts)
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                symbols, word, rank, merged = symbols[~over], word[~over], rank[~over], merged[~over]
                counts, best = counts[best != _NONE], best[best != _NONE]
                if not len(symbols):
                    break
            if rounds >= _ROUNDS:
                s, w = self._one_by_one(symbols, word)
                done_symbols.append(s)
                done_words.append(w)
                break
            rounds += 1
            hit = np.flatnonzero(rank == np.repeat(best, counts))
            new_word = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
            run = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | new_word[1:]])
            place = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            # A word that has a hasty piece among its hits takes its leftmost hit alone.
            hasty = np.logical_or.reduceat(self.hasty[merged[hit]], np.flatnonzero(new_word))[np.cumsum(new_word) - 1]
            hit = hit[np.where(hasty, new_word, place % 2 == 0)]
            symbols[hit] = merged[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))
            symbols, word, rank, merged = symbols[keep], word[keep], rank[keep], merged[keep]
            for i in (at, at[at > 0] - 1):
                inner = i[i + 1 < len(symbols)]
                r, m = self._pairs(symbols[inner], symbols[inner + 1])
                rank[i] = _NONE
                rank[inner], merged[inner] = np.where(word[inner] == word[inner + 1], r, _NONE), m
        if not done_symbols:
            return symbols, word
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _one_by_one(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Finish long words in n log n steps: a heap of pairs by rank and place."""
        n, sym = len(symbols), symbols.tolist()
        after = [i + 1 if i + 1 < n and word[i + 1] == word[i] else -1 for i in range(n)]
        before = [i - 1 if i and word[i - 1] == word[i] else -1 for i in range(n)]
        table = {int(k): (int(r), int(i)) for k, r, i in zip(self.pair_keys, self.pair_ranks, self.pair_ids)}
        heap: list[tuple] = []

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (found := table.get(sym[i] << 32 | sym[j])):
                heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n):
            push(i)
        alive = [True] * n
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], after[i] = to, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        left = np.array(alive)
        return np.array(sym, np.int64)[left], word[left]

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and how many each has."""
        texts = [w.decode("utf-8", "replace").replace(" ", MARK) for w in words]
        chars = "".join(texts)
        points = np.frombuffer(chars.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        kinds, back = np.unique(points, return_inverse=True)
        table = np.array([self.symbols.get(chr(c), -2 - c) for c in kinds], np.int64)
        word = np.repeat(np.arange(len(texts)), [*map(len, texts)])
        symbols, word = self.merge(table[back], word)
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.base))
        if len(odd):
            names = {i: s for s, i in self.symbols.items() if i >= self.base}
            extra = [[self.byte_ids.get(b, self.unknown) for b in (chr(-2 - s) if s < 0 else names[s]).encode()] if self.byte_ids else [self.unknown] for s in symbols[odd].tolist()]
            sizes = np.ones(len(symbols), np.int64)
            sizes[odd] = [*map(len, extra)]
            place = (np.cumsum(sizes) - sizes)[odd]
            symbols, word = np.repeat(symbols, sizes), np.repeat(word, sizes)
            for start, ids in zip(place.tolist(), extra):
                symbols[start : start + len(ids)] = ids
        return symbols.astype(np.int32), np.bincount(word, minlength=len(texts))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids begin (texts + 1)."""
        if data.tobytes().find(MARK.encode()) >= 0:
            raw = data.tobytes()
            texts = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        filled = np.flatnonzero(np.diff(offsets) > 0)
        if not len(filled):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        begins = offsets[:-1][filled]
        data = np.insert(data, begins, 0x20)
        shift = np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        offsets = offsets + shift
        space = data == 0x20
        cut = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        starts = np.union1d(cut, begins + np.arange(len(begins)))
        bounds = np.append(starts, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        slot = self._slots_of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        lengths = self.lengths[slot]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[gather(self.starts[slot], lengths)], ends[np.searchsorted(starts, offsets)]

    def _slots_of(self, words: list[bytes]) -> np.ndarray:
        if len(self.slots) > _CACHE_WORDS or len(self.ids) > _CACHE_IDS:
            self.clear()
        new = [w for w in words if w not in self.slots]
        if new:
            ids, lengths = self._encode_words(new)
            base = len(self.starts)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])
            self.slots.update(zip(new, range(base, base + len(new))))
        return np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of runs of ids; the space in front goes, each stray byte becomes U+FFFD."""
        lengths = self.out_lengths[ids]
        data = self.out_bytes[gather(self.out_starts[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])
        begin, end = ends[bounds[:-1]], ends[bounds[1:]]
        filled = np.flatnonzero(np.diff(bounds) > 0)
        begin[filled] += self.opens[ids[bounds[:-1][filled]]]
        return [data[a:b].decode("utf-8", "each_byte") for a, b in zip(begin.tolist(), end.tolist())]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One model for each Python worker and file."""
    return PieceModel(path)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``ids`` and ``decoded``, the text of these ids.

    No begin or end ids, no sampling. A null or empty text has no ids and decodes
    to an empty text. Null and repeated ids stay rows of their own; other columns
    are ignored, whatever their names; an empty table gives no rows. Memory: one
    slice of a few MB of text, or one longer document, and a bounded word cache.
    """

    def run(batches):
        model = piece_model(model_path)
        for batch in slices(batches, "text"):
            ids, bounds = model.encode(*byte_view(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(model.decode(ids, bounds), pa.string())], names=["doc_id", "ids", "decoded"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded(chosen).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
