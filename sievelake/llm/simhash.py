"""SimHash near-duplicates by tiled exact comparison.

Texts become fingerprints: a bit is set if it is set in over half of the hashes
of the text's word shingles. Fingerprints are made distinct, sorted into classes
(by population count, or by size for a similarity bound) and classes into tiles.
Each pair of tiles that can hold a link is one group: numpy compares it by
exclusive-or and bit counts, in small sub-tiles, skipping pairs of sub-tiles
whose population counts, segment by segment, differ beyond the radius. A group
returns a spanning forest of its links, never all pairs, and the forests are
merged by alternating stars, so that nothing of the size of the corpus meets on
the driver or in one task.

In similarity mode the components of the fingerprints are candidates: within
each, the shingle sets themselves are compared (``verified_links``), every pair
of texts that isn't connected already, so no true link of a candidate component
is lost, however dense it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.batches import bounded, byte_view, gather, slices
from sievelake.llm.skew import join_counted
from sievelake.llm.words import lower_ascii, word_spans
from sievelake.session import materialize

#: Distinct fingerprints of a tile, rows of a sub-tile, and hashes whose bits are counted at a time.
TILE, SUB, BLOCK = 16384, 256, 65_025
#: Differing bits of 256 within which texts of similarity 0.8 fall: their fingerprints differ in 39 on
#: average (angle arccos(8/9) of pi) with a deviation of 5.7; unrelated texts differ in 128.
RADIUS_80 = 54
#: Shingle hashes and sets of a tile of exact comparison; representatives of a group of similar texts that meet other tiles.
SET_TILE, SETS_PER_TILE, REPRESENTATIVES = 1 << 20, 4096, 4
#: Groups beyond a tile that are broadcast at most; with more they meet their texts in a shuffle.
LARGE_GROUPS = 500_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of a hash: a splitmix64 step."""
    z = h + np.uint64(int(_GOLDEN) * k % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the unsigned 64-bit hashes; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1)
        whole = len(bits) // 255 * 255
        if whole:
            counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def shingle_hashes(data: bytes, starts: list[int], ends: list[int], width: int, distinct: bool) -> np.ndarray:
    """XXH64 (seed 42) of the ``width``-word windows of lower-case text, joined by one space;
    fewer words make one shingle, none make none."""
    from xxhash import xxh64_intdigest

    words = [data[a:b] for a, b in zip(starts, ends)]
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(line, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends_in_line = np.cumsum(lengths)
    begins = (ends_in_line - lengths)[: len(words) - width + 1].tolist()
    stops = (ends_in_line - 1)[width - 1 :].tolist()
    hashes = np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(begins, stops)), np.uint64, len(begins))
    return np.unique(hashes) if distinct else hashes


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, n_words: int = 1, distinct: bool = False) -> DataFrame:
    """``doc_id``, ``t1``, ``t2`` (128 bits of the text), ``w0`` .. (64 bits of the fingerprint each, as signed long)
    and ``size`` (number of shingles) of each row."""
    names = [f"w{k}" for k in range(n_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = byte_view(batch.column(1))
            data = lower_ascii(data)
            starts, ends, bounds = word_spans(data, offsets)
            raw, a, b, edges = data.tobytes(), starts.tolist(), ends.tolist(), bounds.tolist()
            columns: list[list[int]] = [[] for _ in names]
            sizes = []
            for i, j in zip(edges[:-1], edges[1:]):
                hashes = shingle_hashes(raw, a[i:j], b[i:j], width, distinct)
                sizes.append(len(hashes))
                for k, column in enumerate(columns):
                    column.append(majority(_mix(hashes, k) if k else hashes))
            arrays = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns]
            known = [batch.column(i) for i in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([*known, *arrays, pa.array(sizes, pa.int64())], names=["doc_id", "t1", "t2", *names, "size"])

    text = F.col(text_col).cast("string")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *text_key(text))
    return bounded(chosen).mapInArrow(run, "doc_id long, t1 long, t2 long, " + ", ".join(f"{n} long" for n in names) + ", size long")


def text_key(text: Column) -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def hexadecimal(*words: str) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(F.col(w)), 16, "0")) for w in words])


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int, sizes: tuple | None = None, ratio: float = 0.0) -> list[tuple[int, int]]:
    """Links between two tiles of fingerprints (rows of 64-bit words), or within one (``right`` None).

    Indices count the left rows first, then the right ones. With ``ratio``, sizes
    of linked rows differ by that ratio at most. The links returned are a spanning
    forest of all links.
    """
    both = left if right is None else np.concatenate([left, right])
    n, words = both.shape
    size = None if sizes is None else np.concatenate(sizes).astype(np.float64)
    counts = np.bitwise_count(np.ascontiguousarray(both).view(np.uint16).reshape(n, 4 * words)).astype(np.int16)

    def arranged(rows: np.ndarray) -> list[np.ndarray]:
        keys = counts[rows].T[::-1] if size is None else (counts[rows].sum(axis=1), size[rows])
        rows = rows[np.lexsort(keys)]
        return [rows[i : i + SUB] for i in range(0, len(rows), SUB)]

    subs_a = arranged(np.arange(len(left)))
    subs_b = subs_a if right is None else arranged(np.arange(len(left), n))
    low_a, high_a = (np.array([f(counts[s], axis=0) for s in subs_a]) for f in (np.min, np.max))
    low_b, high_b = (np.array([f(counts[s], axis=0) for s in subs_b]) for f in (np.min, np.max))

    def distances(i: int, j: int) -> np.ndarray:
        """Differing bits of two sub-tiles; beyond the radius where sizes differ, or for pairs met before."""
        rows_a, rows_b = subs_a[i], subs_b[j]
        d = np.bitwise_count(both[rows_a, 0][:, None] ^ both[rows_b, 0][None, :])
        if words > 1:
            d = d.astype(np.uint16)
            for k in range(1, words):
                d += np.bitwise_count(both[rows_a, k][:, None] ^ both[rows_b, k][None, :])
        if size is not None:
            x, y = size[rows_a][:, None], size[rows_b][None, :]
            d = np.where((x >= ratio * y) & (y >= ratio * x), d, radius + 1)
        if right is None and i == j:
            d = np.where(np.tri(len(rows_a), dtype=bool), radius + 1, d)
        return d

    parent, comp, found = list(range(n)), np.arange(n), []
    for i in range(len(subs_a)):
        gap = np.maximum(0, np.maximum(low_b - high_a[i], low_a[i] - high_b)).sum(axis=1)
        if size is not None:
            mine, other = size[subs_a[i]], [(size[s].min(), size[s].max()) for s in subs_b]
            gap = np.where([mine.max() < ratio * x or mine.min() * ratio > y for x, y in other], radius + 1, gap)
        for j in np.flatnonzero(gap <= radius).tolist():
            if right is None and j < i:
                continue
            rows_a, rows_b = subs_a[i], subs_b[j]
            label = comp[rows_a[0]]
            if (comp[rows_a] == label).all() and (comp[rows_b] == label).all():
                continue
            at = np.flatnonzero(distances(i, j) <= radius)
            u, v = rows_a[at // len(rows_b)], rows_b[at % len(rows_b)]
            apart = comp[u] != comp[v]
            if not apart.any():
                continue
            u, v = u[apart], v[apart]
            _, first = np.unique(comp[u] * n + comp[v], return_index=True)
            for p, q in zip(u[first].tolist(), v[first].tolist()):
                x, y = _root(parent, p), _root(parent, q)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((p, q))
            comp = _settled(parent)
    return sorted(found)


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _settled(parent: list[int]) -> np.ndarray:
    roots = np.array(parent)
    while True:
        up = roots[roots]
        if (up == roots).all():
            return roots
        roots = up


def links(nodes: DataFrame, n_words: int, radius: int, ratio: float | None = None) -> DataFrame:
    """Links between distinct fingerprints that connect what all links connect: rows ``a``, ``b`` of nodes.

    ``nodes``: node, w0 .., size. The driver sees the number of nodes in each
    class: 65 classes of population counts, or one for each factor of size.
    """
    words = [f"w{k}" for k in range(n_words)]
    if ratio is None:
        klass, reach = F.bit_count("w0").cast("int"), radius
        for w in words[1:]:
            klass = klass + F.bit_count(w).cast("int")
    else:
        klass, reach = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / math.log(1 / ratio) + 1e-9).cast("int"), 1
    spread = nodes.withColumn("class", klass)
    counts = {r["class"]: r["n"] for r in spread.groupBy("class").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return nodes.sparkSession.createDataFrame([], "a string, b string")
    tiles = F.create_map(*[F.lit(x) for c, n in sorted(counts.items()) for x in (c, -(-n // TILE))])
    own = F.shiftleft(F.col("class").cast("long"), 32) + F.pmod(F.xxhash64("node"), F.element_at(tiles, F.col("class")).cast("long"))
    spread = spread.withColumn("tile", own)
    around = F.flatten(
        F.transform(
            F.filter(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: F.col("class") + d), lambda c: F.map_contains_key(tiles, c)),
            lambda c: F.transform(
                F.sequence(F.lit(0), F.element_at(tiles, c) - 1),
                lambda u: F.shiftleft(c.cast("long"), 32) + u,
            ),
        )
    )
    dealt = spread.withColumn("other", F.explode(around)).select(
        F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", *words, "size"
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        values = np.ascontiguousarray(group[words].to_numpy(np.int64)).view(np.uint64)
        size, lo, hi = group["size"].to_numpy(), group["lo"].iloc[0], group["hi"].iloc[0]
        is_left = (group["tile"] == lo).to_numpy()
        keep = np.concatenate([np.flatnonzero(is_left), np.flatnonzero(~is_left)])
        values, size, n = values[keep], size[keep], int(is_left.sum())
        sizes = None if ratio is None else ((size,) if lo == hi else (size[:n], size[n:]))
        found = tile_links(values if lo == hi else values[:n], None if lo == hi else values[n:], radius, sizes, ratio or 0.0) if len(values) > 1 and n else []
        name = lambda i: "".join(f"{int(w):016x}" for w in values[i]) + ("" if ratio is None else f"/{size[i]}")
        return pd.DataFrame([(name(i), name(j)) for i, j in found], columns=["a", "b"])

    return dealt.groupBy("lo", "hi").applyInPandas(run, "a string, b string")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node of each node's component, by alternating large and small stars.

    Each round is written to the shared folder. A round moves every edge towards
    the smallest neighbour; the number of rounds grows with the logarithm of the
    longest path. A node with very many edges, as each root has, meets its
    smallest neighbour by broadcast.
    """
    def stars(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        return join_counted(pairs, materialize(least, "least"), ["u"])

    edges = materialize(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a != b").distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u != v").distinct(), "large")
        small = stars(large)
        edges = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = materialize(edges.filter("a != b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def shingle_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``node``, ``group``, ``set`` (hashes of the distinct shingles): made again for ``members`` (node, group, least), from the row
    that stands for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = byte_view(batch.column(2))
            data = lower_ascii(data)
            starts, ends, bounds = word_spans(data, offsets)
            raw, a, b, edges = data.tobytes(), starts.tolist(), ends.tolist(), bounds.tolist()
            sets = [shingle_hashes(raw, a[i:j], b[i:j], width, True).view(np.int64) for i, j in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["node", "group", "set"])

    known = members.select(
        "node", "group", F.col("least.no_id").alias("x"), F.coalesce("least.doc_id", F.lit(0)).alias("i"), F.col("least.t1").alias("t1"), F.col("least.t2").alias("t2")
    )
    known = materialize(known, "compared")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).isNull().alias("x"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("i"), *text_key(text), text.alias("text"))
    texts = rows.join(known.hint("shuffle_hash"), ["x", "i", "t1", "t2"]).select("node", "group", "text")
    sets = bounded(texts).mapInArrow(run, "node string, group string, set array<long>")
    return materialize(sets.groupBy("node").agg(F.first("group").alias("group"), F.first("set").alias("set")), "sets")


def set_forest(flat: np.ndarray, bounds: np.ndarray, least: float, labels: np.ndarray) -> list[tuple[int, int]]:
    """Links of sets (``flat[bounds[i]:bounds[i + 1]]``) with a Jaccard similarity of at least ``least`` that connect
    what all such links connect, given that sets of equal ``labels`` are connected."""
    n, sizes, comp, found = len(bounds) - 1, np.diff(bounds), labels.copy(), []
    if n < 2 or (comp == comp[0]).all():
        return found
    _, codes = np.unique(flat, return_inverse=True)
    counts = np.bincount(codes)
    rows = np.repeat(np.arange(n), sizes)[np.argsort(codes, kind="stable")]
    first = np.cumsum(counts) - counts
    for x in np.argsort(-sizes, kind="stable").tolist():
        open_ = (comp != comp[x]) & (sizes >= least * sizes[x]) & (sizes * least <= sizes[x])
        if not open_.any():
            continue
        mine = codes[bounds[x] : bounds[x + 1]]
        if sizes[x]:
            common = np.bincount(rows[gather(first[mine], counts[mine])], minlength=n)
            open_ &= common >= least * (sizes + sizes[x] - common)
        for y in np.flatnonzero(open_).tolist():
            if comp[y] != comp[x]:
                comp[comp == comp[y]] = comp[x]
                found.append((x, y))
    return found


def _compare(dealt: DataFrame, tile: Column, least: float) -> DataFrame:
    """Links ``a``, ``b`` among the rows (group, node, set, label) that share a tile, within each of their groups."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group = table.column("group").combine_chunks().dictionary_encode().indices.to_numpy()
        node, label = table.column("node").to_pylist(), table.column("label").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        sets = table.column("set").combine_chunks()
        offsets, values = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy()
        found: list[tuple[int, int]] = []
        order = np.argsort(group, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            lengths = offsets[rows + 1] - offsets[rows]
            links_ = set_forest(values[gather(offsets[rows], lengths)], np.concatenate([[0], np.cumsum(lengths)]), least, label[rows])
            found += [(rows[x], rows[y]) for x, y in links_]
        return pa.table({"a": pa.array([node[x] for x, _ in found], pa.string()), "b": pa.array([node[y] for _, y in found], pa.string())})

    return dealt.select(tile.alias("tile"), "group", "node", "label", "set").groupBy("tile").applyInArrow(run, "a string, b string")


def verified_links(sets: DataFrame, least: float) -> DataFrame:
    """Links ``a``, ``b`` between nodes of a group whose ``set`` have a similarity of at least ``least``; they connect what all
    such links connect. ``sets``: node, group, set.

    Groups within a tile's bounds (nearly all) are compared whole, many in one
    task. A larger one is dealt to tiles by hash: first each tile is compared,
    then a few representatives of each set of connected texts, which joins what
    is dense. Then the texts outside the group's largest set of connected texts
    meet all tiles, so that every pair not connected has been compared. What is
    sent grows with the tiles only by the texts outside.
    """
    weighed = sets.select("node", "group", F.size("set").cast("long").alias("size"))
    sums = lambda rows, *by: rows.groupBy(*by).agg(F.greatest(F.ceil(F.sum("size") / SET_TILE), F.ceil(F.count("*") / SETS_PER_TILE), F.lit(1)).cast("int").alias("tiles"))
    groups = materialize(sums(weighed, "group"), "groups")
    large = materialize(groups.filter("tiles > 1"), "large")
    n_large = large.count()
    few_rows = lambda table: F.broadcast(table) if n_large <= LARGE_GROUPS else table
    total = weighed.agg(F.sum("size").alias("s"), F.count("*").alias("n")).first()
    parts = max(1, -(-(total["s"] or 0) // (2 * SET_TILE)), -(-total["n"] // SETS_PER_TILE))
    alone = sets.join(few_rows(large), "group", "left").withColumn("label", F.col("node"))
    tile = F.when(F.col("tiles").isNull(), F.pmod(F.xxhash64("group"), F.lit(parts))).otherwise(F.xxhash64("group", F.pmod(F.xxhash64("node"), F.col("tiles"))))
    found = materialize(_compare(alone, tile, least), "verified")
    if not n_large:
        return found
    dense = materialize(alone.filter("tiles IS NOT NULL").drop("label"), "dense")

    def labelled(links_: DataFrame) -> DataFrame:
        roots = components(links_).withColumnRenamed("root", "label")
        return materialize(dense.join(roots, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")

    once = labelled(found)
    own = F.pmod(F.xxhash64("node"), F.col("tiles"))
    place = Window.partitionBy("group", "own", "label").orderBy(F.xxhash64(F.lit(2), "node"), "node")
    few = once.withColumn("own", own).select("node", "group", "own", "label", F.row_number().over(place).alias("k")).filter(F.col("k") <= REPRESENTATIVES)
    few = materialize(once.drop("tiles").join(few.select("node"), "node"), "representatives")
    few = few.join(few_rows(sums(few.withColumn("size", F.size("set").cast("long")), "group")), "group")
    more = _compare(few, F.xxhash64("group", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("tiles"))), least)
    found = materialize(found.unionByName(more), "verified")
    twice = labelled(found)
    main = twice.groupBy("group", "label").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    twice = twice.join(few_rows(main), "group").withColumn("outside", F.col("label") != F.col("main"))
    outside = materialize(sums(twice.filter("outside").withColumn("size", F.size("set").cast("long")), "group").withColumnRenamed("tiles", "rest"), "outside")
    twice = twice.join(few_rows(outside), "group")
    tile_of = lambda n: F.pmod(F.xxhash64(F.lit(4), "node"), F.col(n)).cast("int")
    # Tiles of the texts outside are numbered 0 .., all others -1, -2 ...
    among = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda j: F.struct(F.least(j, tile_of("rest")).alias("lo"), F.greatest(j, tile_of("rest")).alias("hi")))
    across = F.transform(F.sequence(F.lit(1), F.col("tiles")), lambda j: F.struct((-j).alias("lo"), tile_of("rest").alias("hi")))
    inside = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda j: F.struct((-1 - tile_of("tiles")).alias("lo"), j.alias("hi")))
    dealt = twice.withColumn("pair", F.explode(F.when(F.col("outside"), F.concat(among, across)).otherwise(inside))).select("group", "node", "label", "set", "pair.*")
    last = _compare(dealt, F.xxhash64("group", "lo", "hi"), least)
    return materialize(found.unionByName(last), "verified")


def grouped(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int, n_words: int, distinct: bool, ratio: float | None) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints with their ``node``, and for each node ``first``: the smallest (id, text) of its component, null ids last."""
    words = [f"w{k}" for k in range(n_words)]
    node = hexadecimal(*words) if ratio is None else F.concat(hexadecimal(*words), F.lit("/"), F.col("size"))
    prints = materialize(fingerprints(docs, id_col, text_col, width, n_words, distinct).withColumn("node", node), "prints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")
    keys = prints.groupBy("node").agg(F.min(row).alias("least"), *[F.first(w).alias(w) for w in words], F.first("size").alias("size"), F.count("*").alias("n"))
    nodes = materialize(keys, "nodes")
    roots = components(links(nodes, n_words, radius, ratio))
    if ratio is not None:
        roots = materialize(roots, "candidates")
        both = roots.select("node", F.col("root").alias("group")).union(roots.select("root", "root").distinct())
        sets = shingle_sets(docs, nodes.select("node", "least").join(both, "node"), id_col, text_col, width)
        roots = components(verified_links(sets, ratio))
    rooted = nodes.select("node", "least", "n").join(roots, "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted")
    firsts = rooted.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("n"))
    return prints, materialize(join_counted(rooted.withColumnRenamed("n", "rows"), firsts, ["root"]).select("node", "first", F.col("rows").alias("n")), "named")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2,
    n_words: int = 1, distinct: bool = False, ratio: float | None = None,
) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``component_id``: one row per row of ``docs``.

    Words are lower-cased in A-Z. Fingerprints of ``64 * n_words`` bits link at
    ``radius`` or fewer differing bits. With ``ratio`` their components are only
    candidates: texts link if their sets of shingles have a Jaccard similarity of
    at least that. ``distinct`` counts each shingle once.
    ``component_id`` is the smallest id that chains of links reach, the row's own
    included; null ids count only where a component has no other, and then it is
    null. Null and empty texts have fingerprint zero and link like any other.
    Repeated rows share a fingerprint. Extra columns are ignored, whatever their
    names. An empty table gives no rows.
    """
    prints, named = grouped(docs, id_col, text_col, width, radius, n_words, distinct, ratio)
    fingerprint = hexadecimal(*[f"w{k}" for k in range(n_words)])
    return join_counted(prints, named, ["node"]).select("doc_id", fingerprint.alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = RADIUS_80,
    n_words: int = 4, ratio: float | None = 0.8,
) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the smallest id, null ids last.

    By default texts are linked whose sets of five-word shingles have a Jaccard
    similarity of 0.8 or more: 256-bit fingerprints that differ in RADIUS_80 bits
    at most, of texts whose numbers of shingles allow it, are candidates, and the
    sets of all texts that chains of candidates connect decide. Of rows equal in
    id and text the one whose other columns come first as JSON stays. Empty and
    null texts are one group. An empty table gives no rows.
    """
    _, named = grouped(docs, id_col, text_col, width, radius, n_words, True, ratio)
    chosen = named.select("first.*").distinct()
    taken = {c.lower() for c in docs.columns}
    prefix = "_"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    text = F.col(text_col).cast("string")
    t1, t2 = text_key(text)
    keyed = docs.withColumns({prefix + "a": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), prefix + "b": F.col(id_col).isNull(), prefix + "c": t1, prefix + "d": t2})
    names = [prefix + c for c in "abcd"]
    chosen = materialize(chosen.select(F.coalesce("doc_id", F.lit(0)).alias(names[0]), F.col("no_id").alias(names[1]), F.col("t1").alias(names[2]), F.col("t2").alias(names[3])), "chosen")
    kept = keyed.join(chosen, names, "left_semi")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    once = Window.partitionBy(*names).orderBy(F.to_json(F.struct(*rest)) if rest else F.lit(0))
    return kept.withColumn(prefix + "n", F.row_number().over(once)).filter(F.col(prefix + "n") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
