"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes of up to 64 bits: principal axes, rotated so that the
signs lose least (iterative quantisation), learned on a bounded sample. Codes are
cut into bytes, each with an index of its own. If two codes differ in r bits, they
differ in at most r // 8 bits in some byte (one less in the later bytes), so
probing all byte values within these radii finds every code within r; codes
beyond r are dropped and the others reranked by their floats.

Rows and queries meet on (byte position, byte value): neighbouring values that
few rows have share a cell, a value that many have is dealt to several. A row
goes to one cell of each position, a query to the cells that hold a value it
probes. The radius is the one within which the sample has the wanted share of
true neighbours, at the rank that the sample's share of all rows makes of k;
queries that find fewer than k rows are asked again with a wider one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.skew import join_counted
from sievelake.session import materialize

#: Vectors that codes and radius are learned on, queries among them, and the share of true neighbours the radius must hold.
SAMPLE, SAMPLE_QUERIES, WANTED = 8192, 512, 0.95
#: Rows of a cell and queries that meet them at a time; queries whose best rows a task holds; lengths of vectors that may occur.
INDEX_BLOCK, QUERY_BLOCK, HELD, MOST_LENGTHS = 8192, 2048, 100_000, 32
_VALUES = np.arange(256, dtype=np.uint8)
_BITS = np.bitwise_count(_VALUES)
#: Byte values by the number of bits they set: XOR-ing a byte with the first ones gives its neighbours.
_MASKS = [_VALUES[_BITS <= r] for r in range(9)]


class Codes:
    """Rotation, mean and radius learned on a sample."""

    def __init__(self, sample: np.ndarray, k: int, total: int | None = None, rounds: int = 30):
        """``total``: rows that the sample stands for."""
        n, dim = sample.shape
        bits = min(64, dim)
        self.dim, self.bytes = dim, -(-bits // 8)
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, :bits]
        flat = centred @ axes
        rotation = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(flat @ rotation > 0, 1.0, -1.0).T @ flat)
            rotation = (u @ v).T
        self.axes = axes @ rotation
        self.radius = self._fit_radius(sample, max(1, round(k * n / max(total or n, n))))

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes."""
        return np.packbits((vectors - self.mean) @ self.axes > 0, axis=1)

    def _fit_radius(self, sample: np.ndarray, k: int) -> int:
        codes, near = self.encode(sample), []
        for q in range(min(SAMPLE_QUERIES, len(sample))):
            scores = sample @ sample[q]
            scores[q] = -np.inf
            best = np.argpartition(-scores, min(k, len(sample) - 1) - 1)[:k] if len(sample) > 1 else []
            near.append(np.bitwise_count(codes[best] ^ codes[q]).sum(axis=1))
        found = np.concatenate(near) if near else np.zeros(0)
        return int(np.quantile(found, WANTED, method="higher")) if len(found) else 0

    def reaches(self, radius: int) -> list[int]:
        """Differing bits within which each byte is probed; -1 is not at all."""
        least, more = divmod(radius, self.bytes)
        return [min(8, least if s <= more else least - 1) for s in range(self.bytes)]


class Cells:
    """Which cell holds each (position, value), and how many parts each cell has."""

    def __init__(self, counts: np.ndarray):
        """``counts``: rows of each value, a row for each position."""
        self.of, sizes = np.zeros(counts.shape, np.int64), []
        for s, row in enumerate(counts):
            spans = [(0, 256)]
            while spans:
                low, high = spans.pop()
                if high - low > 1 and row[low:high].sum() > INDEX_BLOCK:
                    middle = (low + high) // 2
                    spans += [(middle, high), (low, middle)]
                else:
                    self.of[s, low:high] = len(sizes)
                    sizes.append(int(row[low:high].sum()))
        self.parts = np.array([-(-n // INDEX_BLOCK) for n in sizes])
        self.position = np.zeros(len(sizes), np.int64)
        for s, row in enumerate(self.of):
            self.position[row] = s

    def probed(self, reaches: list[int]) -> list[list[np.ndarray]]:
        """For each position and value of a query the cells that hold rows it probes."""
        return [[(lambda c: c[self.parts[c] > 0])(np.unique(row[_MASKS[r] ^ np.uint8(v)])) if r >= 0 else np.zeros(0, np.int64) for v in range(256)] for row, r in zip(self.of, reaches)]


def probe(rows: np.ndarray, asked: np.ndarray, position: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, rows) by the value that the queries have at a position: the rows with a value within reach of it."""
    order = np.argsort(rows[:, position], kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows[:, position], minlength=256))])
    for value in np.unique(asked[:, position]):
        values = (_MASKS[reach] ^ value).astype(np.int64)
        yield np.flatnonzero(asked[:, position] == value), np.concatenate([order[starts[v] : starts[v + 1]] for v in values])


def merged(known: list[tuple[float, int]], rows: np.ndarray, vectors: np.ndarray, query: np.ndarray, rough: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[float, int]]:
    """The best ``k`` (negated score, id) of those known and of some rows, each id once; scores are inner products in double
    precision, of the rows whose rough ones may be among the best."""
    floor = -np.inf if len(known) < k else -known[-1][0]
    if len(rough) > k:
        floor = max(floor, np.partition(rough, len(rough) - k)[len(rough) - k])
    near = rough >= floor - 1e-9 * max(1.0, abs(floor)) if np.isfinite(floor) else np.ones(len(rough), bool)
    rows = rows[near]
    exact = (vectors[rows] * query).sum(axis=1)
    found = {i: x for x, i in known}
    for r, x in zip(rows.tolist(), exact.tolist()):
        found.update(dict.fromkeys(ids[r], -x))
    return sorted((x, i) for i, x in found.items())[:k]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``v`` (doubles) of the rows with an id and a vector that isn't null, zero, or with null or non-finite components."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    chosen = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return chosen.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


CODED = "key long, ids array<long>, v array<double>, h long, code binary"


def _coded(rows: DataFrame, codes: Codes) -> DataFrame:
    """``rows`` (key, ids, v) with ``h``, a hash of the vector, and ``code``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = codes.encode(_matrix(batch.column(2), codes.dim)) if batch.num_rows else np.zeros((0, codes.bytes), np.uint8)
            flat = pa.Array.from_buffers(pa.binary(codes.bytes), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=["key", "ids", "v", "h", "code"])

    return rows.select("key", "ids", "v", F.xxhash64("v").alias("h")).mapInArrow(run, CODED)


def _code_bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _tally(rows: DataFrame, size: int, places) -> np.ndarray:
    """How often each place, numbers under ``size`` that ``places`` makes of codes, occurs. The driver gets ``size`` numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(places(batch.column(0)), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    out = np.zeros(size, np.int64)
    for r in rows.select("code").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r["place"]] = r["n"]
    return out


def _search(index: DataFrame, queries: DataFrame, codes: Codes, cells: Cells, radius: int, k: int) -> DataFrame:
    """``key``, ``vec_id``, ``score``: for each query (coded) the best ``k`` ids within the radius of those cells that it probes
    and that one task was dealt."""
    reaches, width = codes.reaches(radius), codes.bytes
    probed = cells.probed(reaches)

    def touched(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = [probed[s][v] for row in code.tolist() for s, v in enumerate(row)]
        lengths = [*map(len, lists)]
        return np.repeat(np.repeat(np.arange(len(code)), width), lengths), np.concatenate([np.zeros(0, np.int64), *lists])

    asked = _tally(queries, len(cells.parts), lambda column: touched(_code_bytes(column, width))[1])
    turns = -(-asked // QUERY_BLOCK)

    def deal(stored: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                code, h = _code_bytes(batch.column(4), width), batch.column(3).to_numpy()
                if stored:
                    row, cell = np.repeat(np.arange(len(code)), width), cells.of[np.tile(np.arange(width), len(code)), code.ravel()]
                else:
                    row, cell = touched(code)
                mine, other = (cells.parts, turns) if stored else (turns, cells.parts)
                copies = other[cell]
                row, cell = np.repeat(row, copies), np.repeat(cell, copies)
                own, met = (h[row] >> 8) % np.maximum(mine[cell], 1), np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                part, turn = (own, met) if stored else (met, own)
                for at in range(0, len(row), 8192):
                    piece = slice(at, at + 8192)
                    taken = batch.take(pa.array(row[piece]))
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(x[piece].astype(np.int32)) for x in (cell, part, turn)), taken.column(0), taken.column(1), taken.column(2), taken.column(4)],
                        names=["cell", "part", "turn", "key", "ids", "v", "code"],
                    )

        return run

    def search(group: pa.Table, best: dict[int, list]) -> None:
        """Merge what the queries of a cell find in it into ``best``."""
        is_query = np.asarray(group.column("key").is_valid())
        queries_, stored = group.filter(pa.array(is_query)), group.filter(pa.array(~is_query))
        if not len(queries_) or not len(stored):
            return
        position = int(cells.position[group.column("cell")[0].as_py()])
        a, b = (_code_bytes(t.column("code"), width) for t in (queries_, stored))
        vectors, rows, ids, keys = _matrix(queries_.column("v"), codes.dim), _matrix(stored.column("v"), codes.dim), stored.column("ids").to_pylist(), queries_.column("key").to_pylist()
        whole = lambda x: np.pad(x, ((0, 0), (0, 8 - width))).copy().view(np.uint64).ravel()
        wide_a, wide_b = whole(a), whole(b)
        for who, near in probe(b, a, position, reaches[position]):
            if not len(near):
                continue
            places, codes_near = rows[near].T, wide_b[near]
            for at in range(0, len(who), 256):
                some = who[at : at + 256]
                rough = vectors[some] @ places
                close = np.bitwise_count(wide_a[some, None] ^ codes_near[None, :]) <= radius
                for i, q in enumerate(some.tolist()):
                    known = best.get(keys[q], [])
                    if len(known) >= k:
                        close[i] &= rough[i] >= -known[-1][0] - 1e-9 * max(1.0, abs(known[-1][0]))
                    hit = np.flatnonzero(close[i])
                    if len(hit):
                        best[keys[q]] = merged(known, near[hit], rows, vectors[q], rough[i, hit], ids, k)

    def flushed(best: dict[int, list]) -> pa.RecordBatch:
        rows = [(key, i, -x) for key, pairs in best.items() for x, i in pairs]
        best.clear()
        keys_, ids_, scores_ = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(keys_, pa.int64()), pa.array(ids_, pa.int64()), pa.array(scores_, pa.float64())], names=["key", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come one after the other; a group is complete when the next one begins."""
        held, now, best = [], None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if held and tuple(place[low]) != now:
                    search(pa.Table.from_batches(held), best)
                    held = []
                    if len(best) > HELD:
                        yield flushed(best)
                now = tuple(place[low])
                held.append(batch.slice(low, high - low))
        if held:
            search(pa.Table.from_batches(held), best)
        yield flushed(best)

    dealt = "cell int, part int, turn int, key long, ids array<long>, v array<double>, code binary"
    met = index.mapInArrow(deal(True), dealt).unionByName(queries.mapInArrow(deal(False), dealt))
    place = ["cell", "part", "turn"]
    return met.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "key long, vec_id long, score double")


def _best(hits: DataFrame, k: int) -> DataFrame:
    """``key``, ``near``: the best ``k`` of each key's hits, best first; a row may have been found at several positions."""
    once = hits.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc("vec_id"))
    some = once.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    return some.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))


def search_length(index: DataFrame, queries: DataFrame, dim: int, total: int, k: int) -> DataFrame:
    """``key``, ``near`` of queries (key, v) among ``index`` (v, ids, all with ``dim`` components, ``total`` rows)."""
    sample = index.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow().column(0)
    codes = Codes(_matrix(sample, dim), k, total)
    index = materialize(_coded(index.select(F.lit(None).cast("long").alias("key"), "ids", "v"), codes), "index")
    todo = materialize(_coded(queries.select("key", F.lit(None).cast("array<long>").alias("ids"), "v"), codes), "queries")
    width = codes.bytes
    places = lambda column: (np.arange(width) * 256 + _code_bytes(column, width)).ravel()
    cells = Cells(_tally(index, width * 256, places).reshape(width, 256))
    # A query's own row may be among its hits, so k + 1 are kept; fewer only if the index holds no more.
    least = min(k + 1, index.agg(F.sum(F.size("ids"))).first()[0] or 0)
    done, radius = None, codes.radius
    while True:
        best = materialize(_best(_search(index, todo, codes, cells, radius, k + 1), k + 1), "best")
        done = best if done is None else done.unionByName(best)
        full = best.filter(F.size("near") >= least)
        short = todo.join(full.select("key"), "key", "left_anti").select(*todo.columns)
        if radius >= 8 * width or not short.limit(1).count():
            return done
        todo, done, radius = materialize(short, "queries"), done.filter(F.size("near") >= least), min(8 * width, 2 * radius + width)


def nearest(rows: DataFrame, query_every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found of each row whose id is divisible by ``query_every``.

    Nearness is the inner product of the original vectors in double precision;
    ties go to the smaller id; rows with the query's own id are no candidates.
    Equal vectors are searched and indexed once: a copy beyond the k + 1 with the
    smallest ids cannot be among the k nearest, so only those are carried (Spark
    prunes them before the shuffle). Null, zero or non-finite vectors take no
    part; ties and repeated rows are ranked by id. Vectors are searched among those of their own length; over MOST_LENGTHS
    lengths raise. Memory of a task: a block of rows and one of queries. Extra
    columns are ignored; an empty table gives no rows.
    """
    chosen = usable(rows, id_col, vector_col)
    copies = chosen.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("copy") <= k + 1)
    index = materialize(copies.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    lengths = {r["dim"]: r["n"] for r in index.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors have {len(lengths)} different lengths")
    queries = chosen.filter(F.col("id") % query_every == 0)
    keys = materialize(queries.groupBy("v").agg(F.min("id").alias("key"), F.count("*").alias("n")), "keys")
    found = rows.sparkSession.createDataFrame([], "key long, near array<struct<n:int,vec_id:long,score:double>>")
    for dim, total in sorted(lengths.items()):
        found = found.unionByName(search_length(index.filter(F.size("v") == dim), keys.filter(F.size("v") == dim), dim, total, k))
    near = keys.select("key", "n").join(found, "key")
    asked = join_counted(queries.select("id", "v"), keys.select("v", "key", "n"), ["v"]).select(F.col("id").alias("query_id"), "key")
    ranked = join_counted(asked, near.select("key", "near", "n"), ["key"])
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    flat = ranked.select("query_id", F.posexplode(others).alias("pos", "x"))
    return flat.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
