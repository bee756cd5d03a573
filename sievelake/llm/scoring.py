"""Language-model scoring of whole texts.

Counts of all words of all training texts give an exact add-one unigram baseline
and, through the words' subword ids, the count tables of the attention model
(see ``attention``). Training windows cover all training texts, or a fixed share
of their units of words; groups of windows train copies of the
model, whose average starts the next round. Every text
is then scored in overlapping windows, each id once. A word's probability is an
even mixture of the attention model's and its share among all training words;
both sum to one over words, and so does the mixture.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm import attention
from sievelake.llm.attention import ACTIVE, WINDOW, Prior, Scorer
from sievelake.llm.batches import bounded, byte_view, gather, joined, slices
from sievelake.llm.subwords import ByteBpe, byte_bpe
from sievelake.llm.words import byte_runs, lower_ascii, word_array, word_spans
from sievelake.session import materialize

#: At most so many frequent words, of so many bytes, are sent to all workers; the counts of all others are joined.
FREQUENT, FREQUENT_BYTES = 131_072, 32
#: Words of a unit; one in so many units trains, whatever the size of the corpus (1: all of them); windows of a group
#: that trains a copy; rounds of averaging, each over its own part of the windows.
UNIT, EVERY, GROUP, ROUNDS = 128, 1, 25_000, 2
#: Neighbouring windows that are dealt together; copies whose parameters are added up at a time, and parameters of a block.
DEALT, ADDED, PART = 64, 64, 4096
#: Occurrences from which a longer word is sent to all workers too.
HOT = 20_000
#: Bytes of text handled at a time when windows are cut, and when texts are scored.
SLICE, SCORED_SLICE = 4 << 20, 2 << 20
#: Bytes of text whose words are counted together before they are shuffled.
COUNTED = 12 << 20
#: Occurrences of words that aren't frequent, on average, in a bucket in which they meet their counts, and texts in one in
#: which what they add is summed.
BUCKET, TEXTS = 500_000, 20_000


def held_out(id_col: Column) -> Column:
    """crc32 of the id's decimal text mod 7 is 2; a null id is training text."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(7)) == 2, F.lit(False))


def _words(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Lower-case words of whole texts, dictionary-encoded, where each text's words begin, and the texts' bytes."""
    data, offsets = byte_view(column)
    data = lower_ascii(data)
    starts, ends, bounds = word_spans(data, offsets)
    return word_array(data, starts, ends).dictionary_encode(), bounds, data


def word_counts(docs: DataFrame) -> DataFrame:
    """``word``, ``n_all``, ``n_train`` over all rows of (doc_id, text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(joined(batches, COUNTED), "text", COUNTED):
            coded, bounds, _ = _words(batch.column(1))
            n, index = len(coded.dictionary), coded.indices.to_numpy()
            learns = ~np.asarray(batch.column(2))
            trained = np.bincount(index[np.repeat(learns, np.diff(bounds))], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.cast(pa.binary()), pa.array(np.bincount(index, minlength=n)), pa.array(trained)], names=["word", "n_all", "n_train"]
            )

    counted = bounded(docs).mapInArrow(run, "word binary, n_all long, n_train long")
    return counted.groupBy("word").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))


def spelled(encoder: ByteBpe, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of distinct words, each after a space, and where each word's ids begin (words + 1)."""
    data, offsets = byte_view(words)
    data = np.insert(data, offsets[:-1], 0x20)
    bounds = offsets + np.arange(len(offsets))
    chunks = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    ids, lengths = encoder.fresh(chunks)
    return ids, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


class Frequent(NamedTuple):
    """Words that all workers know, their counts in training texts, their subword ids and where each word's ids begin,
    and how often they occur in all texts together."""

    words: pa.Array
    n_train: np.ndarray
    ids: np.ndarray
    bounds: np.ndarray
    n_all: int

    def spelled(self, encoder: ByteBpe, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Subword ids, where those of each of the distinct words begin in them and how many it has, and its place here (-1: none).
        Only words that aren't here are encoded."""
        place = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        ids, bounds = spelled(encoder, words.take(pa.array(new)))
        starts, sizes = self.bounds[place], self.bounds[place + 1] - self.bounds[place]
        starts[new], sizes[new] = len(self.ids) + bounds[:-1], np.diff(bounds)
        return np.concatenate([self.ids, ids]), starts, sizes, place


NONE = Frequent(pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(1, np.int64), 0)


def subword_counts(words: DataFrame, path: str) -> DataFrame:
    """``kind``, ``a``, ``b``, ``n``: counts in training words of ids (u, a), of ids that begin (f, a) or end (l, a) words,
    and of neighbours (p, a, b) within words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, bounds = spelled(encoder, batch.column(0))
            ids, n = ids.astype(np.int64), batch.column(1).to_numpy()
            weight = np.repeat(n, np.diff(bounds))
            inner = np.ones(len(ids), bool)
            inner[bounds[1:] - 1] = False
            at = np.flatnonzero(inner)
            parts = [("u", ids, weight), ("f", ids[bounds[:-1]], n), ("l", ids[bounds[1:] - 1], n), ("p", ids[at] << 32 | ids[at + 1], weight[at])]
            for kind, key, count in parts:
                known, back = np.unique(key, return_inverse=True)
                sums = np.bincount(back, count, minlength=len(known)).astype(np.int64)
                a, b = (known >> 32, known & 0xFFFFFFFF) if kind == "p" else (known, np.zeros_like(known))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(known), pa.string()), pa.array(a), pa.array(b), pa.array(sums)], names=["kind", "a", "b", "n"])

    rows = words.filter("n_train > 0").select("word", "n_train").mapInArrow(run, "kind string, a long, b long, n long")
    return rows.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def fit_prior(counts: DataFrame, train_texts: int, vocabulary: int, begins_word: np.ndarray) -> Prior:
    """The count model. The driver gets the counts of single ids, and the pairs of entries: ACTIVE squared at most."""
    single = counts.filter("kind != 'p'").select("kind", "a", "n").toArrow().to_pydict()
    flat = {k: np.zeros(vocabulary + 1) for k in "ufl"}
    for kind, a, n in zip(single["kind"], single["a"], single["n"]):
        flat[kind][a] = n
    flat["u"][vocabulary] = flat["f"][vocabulary] = train_texts
    begins = np.append(begins_word, True)
    entry = attention.entries_of(flat["u"], begins, ACTIVE).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = entry[batch.column(0).to_numpy()], entry[batch.column(1).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), batch.column(2)], names=["a", "b", "n"])

    merged = counts.filter("kind = 'p'").select("a", "b", "n").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros((ACTIVE, ACTIVE))
    pairs[merged.column("a").to_numpy(), merged.column("b").to_numpy()] = merged.column("n").to_numpy()
    by_entry = lambda x: np.bincount(entry, x, minlength=ACTIVE)
    return Prior(vocabulary, begins, flat["u"], pairs, by_entry(flat["l"]), by_entry(flat["f"]))


def training_windows(docs: DataFrame, path: str, prior, every: int) -> DataFrame:
    """A row for each window of ``window_bytes``, with the entries as an array, and the row it is dealt with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = pa.FixedSizeListArray.from_arrays(pa.array(_entries(batch.column(0)).ravel()), WINDOW + 1)
            rows = np.repeat(batch.column(1).to_numpy(), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([w.cast(pa.list_(pa.int16())), pa.array(rows)], names=["w", "row"])

    return window_bytes(docs, path, prior, every).mapInArrow(run, "w array<short>, row long")


def _entries(column: pa.Array) -> np.ndarray:
    """Windows (rows of WINDOW + 1 entries) from their bytes."""
    return byte_view(column)[0].view(np.int16).reshape(-1, WINDOW + 1)


def window_bytes(docs: DataFrame, path: str, prior, every: int, frequent=None) -> DataFrame:
    """Windows of WINDOW + 1 16-bit entries (-1 is none) that cover all chosen units of all training texts, each id once: ``w``, the bytes
    of up to DEALT neighbouring ones, their number ``n``, and ``row``: a number of their own, so that equal texts are dealt to different groups.

    A unit is a run of UNIT words, ends of texts among them; a hash of the row and the unit's place choose one in ``every``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, model, base = byte_bpe(path), prior.value, TaskContext.get().partitionId() << 36
        known = frequent.value if frequent else NONE
        for batch in slices(batches, "text", SLICE):
            data, offsets = byte_view(batch.column(0))
            first, last, bounds = word_spans(data, offsets)
            lengths, h = np.diff(bounds) + 1, batch.column(1).to_numpy()
            text = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            kept = (place // UNIT + h[text]) % every == 0
            is_end = place == (lengths - 1)[text]
            chosen = np.flatnonzero(kept[~is_end])
            text, place, is_end = text[kept], place[kept], is_end[kept]
            if not len(text):
                continue
            cut = word_array if len(chosen) == len(first) else byte_runs
            coded = cut(lower_ascii(data), first[chosen], last[chosen]).dictionary_encode()
            ids, starts, sizes, _ = known.spelled(encoder, coded.dictionary)
            entries = np.append(model.entry[ids], model.end_entry)
            starts, sizes = np.append(starts, len(ids)), np.append(sizes, 1)
            at = np.full(len(text), len(starts) - 1, np.int64)
            at[~is_end] = coded.indices.to_numpy()
            # Each text's first unit is led by an end.
            opens = place == 0
            runs = np.repeat(at, 1 + opens)
            lead = np.cumsum(1 + opens) - 1 - opens
            runs[lead[opens]] = len(starts) - 1
            line = entries.astype(np.int16)[gather(starts[runs], sizes[runs])]
            begins = np.cumsum(sizes[runs]) - sizes[runs]
            head = opens | np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)])
            low = begins[lead[head]]
            high = np.append(low[1:], len(line))
            n = -(-(high - low - 1) // WINDOW)
            begun = np.cumsum(n) - n
            # Each run's first entry is looked back at only; a window's is the last target of the one before it.
            targets = np.full((int(n.sum()), WINDOW), -1, np.int16)
            flat = targets.ravel()
            for to, i, j in zip((begun * WINDOW).tolist(), (low + 1).tolist(), high.tolist()):
                flat[to : to + j - i] = line[i:j]
            w = np.empty((len(targets), WINDOW + 1), np.int16)
            w[:, 1:] = targets
            w[1:, 0] = targets[:-1, -1]
            w[begun[n > 0], 0] = line[low[n > 0]]
            cuts = np.append(np.arange(0, len(w), DEALT), len(w))
            rows = base + np.arange(len(cuts) - 1)
            base += len(rows)
            packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((cuts * (2 * WINDOW + 2)).astype(np.int32)), pa.py_buffer(w)])
            yield pa.RecordBatch.from_arrays([packed, pa.array(rows), pa.array(np.diff(cuts))], names=["w", "row", "n"])

    chosen = docs.filter("not held_out").select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("h"))
    return bounded(chosen).mapInArrow(run, "w binary, row long, n long")


def _trainer(start, prior, turn: int):
    """Trains a copy of the broadcast parameters on a group of windows; returns it in blocks."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        windows = _entries(group.column("w"))
        # Four entries at a time: any order will do that doesn't hang on how the windows arrive.
        order = np.lexsort([*np.ascontiguousarray(windows[:, :WINDOW]).view(np.int64).T, windows[:, WINDOW]])
        params = attention.unflatten(start.value, ACTIVE)
        trained = attention.flatten(attention.train(params, prior.value, windows[order], rate=0.01 / (1 + turn), seed=turn))
        cuts = np.append(np.arange(0, len(trained), PART), len(trained)).astype(np.int32)
        blocks = pa.ListArray.from_arrays(pa.array(cuts), pa.array(trained.astype(np.float32)))
        bundle, weight = key[0].as_py() // ADDED, len(windows)
        return pa.table({"bundle": pa.array([bundle] * len(blocks), pa.int32()), "block": pa.array(range(len(blocks)), pa.int32()), "weight": pa.array([weight] * len(blocks), pa.int64()), "values": blocks})

    return run


def _added(group: pa.Table) -> pa.Table:
    """The weighted sum of a block's parameters over up to ADDED copies."""
    values, weight = group.column("values").combine_chunks(), group.column("weight").to_numpy()
    total = weight.astype(np.float64) @ values.flatten().to_numpy().reshape(len(weight), -1)
    return pa.table({"block": group.column("block")[:1], "weight": pa.array([int(weight.sum())], pa.int64()), "total": pa.array([total], pa.list_(pa.float64()))})


def train_model(windows: DataFrame, prior, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Average of copies trained on groups of windows, round by round; a round takes its own share of the windows, so all train
    once. The number of groups follows the number of windows; the parameters are averaged in Spark, so the driver gets one set
    of them a round."""
    spark = windows.sparkSession
    flat = attention.flatten(attention.initial(ACTIVE))
    dealt = windows.withColumn("turn", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(rounds)))
    sizes = {r["turn"]: r["n"] for r in dealt.groupBy("turn").agg(F.sum("n").alias("n")).collect()}
    for turn in sorted(sizes):
        trainer = _trainer(spark.sparkContext.broadcast(flat), prior, turn)
        group = F.pmod(F.xxhash64("row"), F.lit(-(-sizes[turn] // GROUP))).cast("int")
        copies = dealt.filter(F.col("turn") == turn).select(group.alias("g"), "w").groupBy("g").applyInArrow(trainer, "bundle int, block int, weight long, values array<float>")
        sums = copies.groupBy("bundle", "block").applyInArrow(_added, "block int, weight long, total array<double>")
        each = sums.select("block", "weight", F.posexplode("total").alias("pos", "value"))
        mean = each.groupBy("block", "pos").agg((F.sum("value") / F.sum("weight")).alias("value")).toArrow()
        flat = np.zeros(len(flat))
        flat[mean.column("block").to_numpy().astype(np.int64) * PART + mean.column("pos").to_numpy()] = mean.column("value").to_numpy()
        flat = flat.astype(np.float32)
    return attention.unflatten(flat, ACTIVE)


def frequent_words(words: DataFrame, encoder: ByteBpe) -> Frequent:
    """The words whose counts over all texts reach the level that FREQUENT words reach, by eighths of powers of two, and
    longer ones with over HOT occurrences: their bytes are at most those of the corpus divided by HOT."""
    short = words.filter(F.octet_length("word") <= FREQUENT_BYTES)
    level = F.floor(F.log2(F.col("n_all").cast("double")) * 8).cast("int")
    sizes = sorted(((r["level"], r["n"]) for r in short.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for at, n in sizes:
        if total + n > FREQUENT:
            break
        total, least = total + n, at
    brief = F.octet_length("word") <= FREQUENT_BYTES
    chosen = words.filter((brief & (F.lit(False) if least is None else level >= least)) | (~brief & (F.col("n_all") > HOT)))
    found = chosen.select("word", "n_train", "n_all").toArrow().combine_chunks()
    listed = pa.chunked_array(found.column("word").chunks, pa.binary()).combine_chunks().cast(pa.large_binary())
    return Frequent(listed, found.column("n_train").to_numpy().astype(np.int64), *spelled(encoder, listed), int(found.column("n_all").to_numpy().sum()))


SCORED = "part int, row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, words binary, sizes binary, rows binary, logs binary"
_POWERS = np.random.default_rng(0).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def bucket_of(words: pa.Array, buckets: int) -> np.ndarray:
    """The bucket in which each word meets its counts."""
    data, offsets = byte_view(words)
    if not len(data):
        return np.zeros(len(words), np.int64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    sums = np.add.reduceat((data + np.uint64(1)) * _POWERS[place % 64], offsets[:-1])
    return (sums >> np.uint64(32)).astype(np.int64) % buckets


def _packed(words: pa.Array, bucket: np.ndarray, *values: np.ndarray) -> tuple[list[int], list[pa.Array]]:
    """The buckets that occur, and for each the bytes of its words, of their sizes (32 bits) and of each of the values."""
    order = np.argsort(bucket, kind="stable")
    data, offsets = byte_view(words.take(pa.array(order)))
    at = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    cuts = list(zip(at[:-1].tolist(), at[1:].tolist()))
    arrays = [np.diff(offsets).astype(np.int32), *(v[order] for v in values)]
    columns = [[data[offsets[i] : offsets[j]].tobytes() for i, j in cuts]] + [[x[i:j].tobytes() for i, j in cuts] for x in arrays]
    return bucket[order][at[:-1]].tolist(), [pa.array(c, pa.binary()) for c in columns]


def _unpacked(words: pa.ChunkedArray, sizes: pa.ChunkedArray) -> pa.Array:
    """The words that ``_packed`` put together."""
    offsets = np.concatenate([[0], np.cumsum(byte_view(sizes)[0].view(np.int32), dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(byte_view(words)[0]))])


def score_texts(docs: DataFrame, path: str, prior, params, frequent, buckets: int, train_texts: int, train_tokens: int) -> DataFrame:
    """Rows of texts (``part`` 0: sums over frequent words and the end) and of all other words of some texts (``part``: one
    more than their bucket), each with its text's row and the attention model's natural logarithm."""
    share_of = 1.0 / max(train_tokens, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, model = byte_bpe(path), prior.value
        scorer, base = Scorer(model, params.value), TaskContext.get().partitionId() << 36
        # Counts of the frequent words, then of the end, then of the words that are joined later.
        counts = np.concatenate([frequent.value.n_train, [train_texts, 0]]).astype(np.float64)
        logs, shares, end = np.log10(counts + 1), counts * share_of, len(counts) - 2
        for batch in slices(batches, "text", SCORED_SLICE):
            coded, bounds, _ = _words(batch.column(1))
            rows, index = batch.num_rows, coded.indices.to_numpy()
            lengths = np.diff(bounds)
            text = np.repeat(np.arange(rows), lengths + 1)
            is_end = np.zeros(len(text), bool)
            is_end[np.cumsum(lengths + 1) - 1] = True
            ids, starts, spans, place = frequent.value.spelled(encoder, coded.dictionary)
            kind = np.full(len(text), end, np.int64)
            kind[~is_end] = place[index]
            sizes = np.ones(len(text), np.int64)
            sizes[~is_end] = spans[index]
            begins = np.cumsum(sizes) - sizes
            line = np.full(int(sizes.sum()), model.end, np.int64)
            line[np.repeat(~is_end, sizes)] = ids[gather(starts[index], sizes[~is_end])]
            edges = np.append(begins[np.cumsum(lengths + 1) - lengths - 1], len(line))
            log_p = scorer.word_logs(line, edges, begins) if len(text) else np.zeros(0)
            rare = kind < 0
            mixed = np.where(rare, 0.0, np.log10(0.5 * np.exp(log_p) + 0.5 * shares[kind] + 1e-300))
            add = lambda x: np.bincount(text, x, minlength=rows)
            key = base + np.arange(rows)
            base += rows
            known = add(counts[kind] > 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(rows, np.int32)), pa.array(key), batch.column(0), batch.column(2), pa.array(lengths.astype(np.int64) + 1), pa.array(known),
                 pa.array(add(logs[kind])), pa.array(add(mixed)), *(pa.nulls(rows, pa.binary()) for _ in range(4))], names=NAMES
            )
            if rare.any():
                at = index[rare[~is_end]]
                used, of = np.unique(at, return_inverse=True)
                bucket = bucket_of(coded.dictionary.take(pa.array(used)), buckets)[of]
                found, packed = _packed(coded.dictionary.take(pa.array(at)), bucket, key[text[rare]], log_p[rare])
                empty = [pa.nulls(len(found), t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([k + 1 for k in found], pa.int32()), *empty, *packed], names=NAMES)

    return bounded(docs).mapInArrow(run, SCORED)


NAMES = [f.split()[0] for f in SCORED.split(", ")]


def rare_counts(words: DataFrame, buckets: int) -> DataFrame:
    """``part``, ``words``, ``sizes``, ``counts``: training words and their counts by the bucket they meet in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches, COUNTED):
            if batch.num_rows:
                found, packed = _packed(batch.column(0).cast(pa.large_binary()), bucket_of(batch.column(0), buckets), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([k + 1 for k in found], pa.int32()), *packed], names=["part", "words", "sizes", "counts"])

    return words.filter("n_train > 0").select("word", "n_train").mapInArrow(run, "part int, words binary, sizes binary, counts binary")


def _mixer(train_tokens: int, buckets: int):
    """What the words of a bucket add to the sums of their texts, by bucket of texts: the bytes of rows, of logarithms of
    counts, of numbers of known words and of scores."""
    share = 0.5 / max(train_tokens, 1)

    def run(met: pa.Table, counted: pa.Table) -> pa.Table:
        counts = np.append(byte_view(counted.column("counts"))[0].view(np.int64), 0)
        words = _unpacked(met.column("words"), met.column("sizes"))
        n = counts[pc.index_in(words, value_set=_unpacked(counted.column("words"), counted.column("sizes"))).fill_null(-1).to_numpy()]
        mixed = np.log10(0.5 * np.exp(byte_view(met.column("logs"))[0].view(np.float64)) + n * share + 1e-300)
        row, sums = _by_row(byte_view(met.column("rows"))[0].view(np.int64), np.log10(n + 1.0), n > 0, mixed)
        bucket = _row_bucket(row, buckets)
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        packed = [pa.array([x[order[i:j]].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary()) for x in (row, *sums)]
        return pa.Table.from_arrays([pa.array(bucket[order][at[:-1]], pa.int64()), *packed], names=["texts", *ADDS])

    return run


#: What words that aren't frequent add to a text.
ADDS = ["row", "more", "more_known", "more_score"]


def _row_bucket(rows: np.ndarray, buckets: int) -> np.ndarray:
    """Rows of a partition are numbered from a multiple of 2 ** 36 on."""
    return ((rows >> 36) * 7919 + (rows & ((1 << 36) - 1))) % buckets


def _by_row(rows: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct rows and the sums of the values over each."""
    known, back = np.unique(rows, return_inverse=True)
    return known, [np.bincount(back, v, minlength=len(known)) for v in values]


def _text_sums(group: pa.Table) -> pa.Table:
    """The sums of ``_mixer`` over all buckets of words."""
    row, (more, known, score) = _by_row(byte_view(group.column("row"))[0].view(np.int64), *(byte_view(group.column(c))[0].view(np.float64) for c in ADDS[1:]))
    return pa.table({"row": pa.array(row), "more": pa.array(more), "more_known": pa.array(known.astype(np.int64)), "more_score": pa.array(score)})


class Model(NamedTuple):
    """``words`` (word, n_all, n_train) and totals of the training texts, and the broadcast count model, parameters and frequent words."""

    words: DataFrame
    train_texts: int
    train_tokens: int
    kinds: int
    prior: Any
    params: Any
    frequent: Any
    buckets: int
    texts: int


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))


def fit(chosen: DataFrame, tokenizer_path: str, every: int = EVERY) -> Model:
    """The model of the training rows of (doc_id, text, held_out)."""
    context = chosen.sparkSession.sparkContext
    words = materialize(word_counts(chosen), "words")
    rows = chosen.agg(F.count("*").alias("all"), F.count_if(~F.col("held_out")).alias("train")).first()
    texts = rows["train"]
    totals = words.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.count_if(F.col("n_train") > 0).alias("v"), F.coalesce(F.sum("n_all"), F.lit(0)).alias("all")).first()
    encoder = byte_bpe(tokenizer_path)
    counts = materialize(subword_counts(words, tokenizer_path), "subwords")
    prior = context.broadcast(fit_prior(counts, texts, encoder.size, encoder.begins_word))
    known = frequent_words(words, encoder)
    frequent, buckets = context.broadcast(known), -(-(totals["all"] - known.n_all) // BUCKET) or 1
    windows = materialize(window_bytes(chosen, tokenizer_path, prior, every, frequent), "windows")
    return Model(words, texts, totals["n"] + texts, totals["v"] + (texts > 0), prior, context.broadcast(train_model(windows, prior)), frequent, buckets, rows["all"])


def language_model_scores(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``: log10 probabilities.

    A null or empty text is its end alone. Rows with null ids are training text.
    Null and repeated ids stay rows of their own; other columns are ignored,
    whatever their names; an empty table gives no rows. Counts cover all training
    words, and the attention parameters learn from all units of words of all
    training texts, or from one in ``every`` of them. To all workers go: the count
    tables (ACTIVE squared), the model and FREQUENT words at most.
    """
    chosen = prepared(docs, id_col, text_col)
    return score_with(fit(chosen, tokenizer_path, every), chosen, tokenizer_path)


def score_with(model: Model, chosen: DataFrame, tokenizer_path: str) -> DataFrame:
    """Scores of rows (doc_id, text, held_out), the same that ``model.words`` counts."""
    words, train_tokens = model.words, model.train_tokens
    scored = materialize(score_texts(chosen, tokenizer_path, model.prior, model.params, model.frequent, model.buckets, model.train_texts, train_tokens), "scored")
    # Words that occur very often were met in score_texts, so no bucket is large here.
    met = scored.filter("part > 0").select("part", "words", "sizes", "rows", "logs").groupBy("part")
    adds = met.cogroup(rare_counts(words, model.buckets).groupBy("part")).applyInArrow(_mixer(train_tokens, -(-model.texts // TEXTS) or 1), "texts long, row binary, more binary, more_known binary, more_score binary")
    rare = adds.groupBy("texts").applyInArrow(_text_sums, "row long, more double, more_known long, more_score double")
    out = scored.filter("part = 0").join(rare, "row", "left")
    zero = F.lit(0)
    base = F.col("base") + F.coalesce("more", zero) - F.col("n_tokens") * float(np.log10(train_tokens + model.kinds + 1.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", zero)).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )
