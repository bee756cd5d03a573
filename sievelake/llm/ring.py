"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of 2^32 places; the points cut the
ring into arcs, and a key belongs to the shard at the end of its arc. Shards
have a capacity. Arcs are filled in clockwise order, keys within an arc in order
of their place: what finds its shard full goes on clockwise to the next shard
with room. That order makes the keys of an arc that go to one shard a run, so
the whole assignment is a plan of at most one run for each arc and one for each
time a shard fills, and is worked out from the counts of the arcs alone.
"""

from __future__ import annotations

import bisect
import json
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.session import materialize

RING = 1 << 32
#: Parts of an arc that are ranked by themselves; they bound the rows that one task must sort. A part is large if it has over
#: ``EQUAL`` rows and four times the mean; so many equal rows have parts of their own.
CELLS_PER_ARC, EQUAL = 64, 20_000


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, in order; a place taken twice goes to the smaller shard."""
    points: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            points.setdefault(zlib.crc32(f"shard {shard} point {v}".encode()), shard)
    return sorted(points.items())


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard may hold: without slack they add up to all rows and differ by one at most."""
    if slack:
        return [-(-int(rows * (1 + slack) * 1000) // (1000 * shards)) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def fill(counts: dict[int, int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first rank, end rank, shard, first slot) that place every key; walks the arcs clockwise."""
    left, used, runs = list(room), [0] * len(room), []
    for arc in sorted(counts):
        rank, todo, at = 0, counts[arc], arc
        while todo:
            shard = owners[at % len(owners)]
            take = min(todo, left[shard])
            if take:
                runs.append((arc, rank, rank + take, shard, used[shard]))
                left[shard] -= take
                used[shard] += take
                rank, todo = rank + take, todo - take
            at += 1
    return runs


def arc_of(place: Column, points: list[tuple[int, int]]) -> Column:
    """Number of the first point at or after a place; past the last point, the first one.

    A table of equal parts of the ring gives the first candidate, and the few
    points inside the part decide.
    """
    parts = 1 << max(len(points) - 1, 1).bit_length() + 2
    width = RING // parts
    places = [p for p, _ in points]
    first = [bisect.bisect_left(places, i * width) for i in range(parts)] + [len(places)]
    most = max(b - a for a, b in zip(first, first[1:]))
    begins, known = F.array(*[F.lit(x) for x in first]), F.array(*[F.lit(p) for p in [*places, *[RING] * most]])
    start = F.element_at(begins, (F.floor(place / width) + 1).cast("int"))
    arc = start
    for k in range(most):
        arc = arc + F.when(F.element_at(known, start + k + 1) < place, 1).otherwise(0)
    return F.when(arc == len(places), 0).otherwise(arc).cast("int")


def shard_rows(rows: DataFrame, key: Column, tie: Column, shards: int, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """``rows`` with ``shard``, ``slot`` (gapless from 0 in each shard) and ``home_shard`` (before overflow).

    ``key`` decides the place, ``tie`` (a long) orders and spreads rows of equal
    keys, so that a key that holds a third of all rows is still ranked in many
    parts. Rows equal in both are alike and may trade slots; if they are very
    many, they come after all others of their arc, in parts by number. Without ``slack``
    the counts of shards differ by one at most; with it, no shard exceeds
    (1 + slack) times the mean. Null keys have a place like any other. The driver
    holds the counts of the arcs: shards times ``vnodes`` numbers.
    """
    points = ring_points(shards, vnodes)
    place = F.pmod(F.xxhash64(key), F.lit(RING))
    cell = F.pmod(F.xxhash64("_place", "_tie"), F.lit(CELLS_PER_ARC)).cast("long")
    placed = rows.withColumn("_place", place).withColumn("_tie", tie).withColumn("_arc", arc_of(F.col("_place"), points)).withColumn("_cell", cell)
    placed = materialize(placed, "placed")
    sizes = materialize(placed.groupBy("_arc", "_cell").agg(F.count("*").alias("_n")), "sizes")
    facts = sizes.agg(F.max("_n").alias("most"), F.avg("_n").alias("mean")).first()
    limit = max(EQUAL, 4 * int(facts["mean"] or 0))
    if (facts["most"] or 0) > limit:
        # Of large parts, and of rows that are equal so often, there are at most the number of rows divided by the limit.
        large = F.broadcast(sizes.filter(F.col("_n") > limit).select("_arc", "_cell"))
        alike = placed.join(large, ["_arc", "_cell"]).groupBy("_place", "_tie").agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
        number = F.shiftleft(F.row_number().over(Window.orderBy("_place", "_tie")).cast("long"), 24)
        alike = F.broadcast(alike.select("_place", "_tie", number.alias("_many"), F.ceil(F.col("_n") / limit).alias("_parts")))
        own = F.col("_many") + F.pmod(F.monotonically_increasing_id(), F.col("_parts"))
        placed = materialize(placed.join(alike, ["_place", "_tie"], "left").withColumn("_cell", F.coalesce(own, "_cell")).drop("_many", "_parts"), "placed")
        sizes = placed.groupBy("_arc", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_arc").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "cells")
    counts = {r["_arc"]: r["n"] for r in cells.groupBy("_arc").agg(F.sum("_n").alias("n")).collect()}
    runs = fill(counts, [s for _, s in points], capacities(sum(counts.values()), shards, slack))
    plan = F.from_json(
        F.lit(json.dumps([dict(zip(("_arc", "a", "b", "shard", "s"), run)) for run in runs])),
        "array<struct<_arc:int,a:long,b:long,shard:int,s:long>>",
    )
    plan = rows.sparkSession.range(1).select(F.inline(plan)).withColumnRenamed("_arc", "_run_arc")
    rank = F.row_number().over(Window.partitionBy("_arc", "_cell").orderBy("_place", "_tie")) - 1
    ranked = placed.withColumn("_rank", rank).join(cells.drop("_n"), ["_arc", "_cell"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    owner = F.element_at(F.array(*[F.lit(s) for _, s in points]), F.col("_arc") + 1)
    joined = ranked.join(F.broadcast(plan), (F.col("_arc") == F.col("_run_arc")) & (F.col("_rank") >= F.col("a")) & (F.col("_rank") < F.col("b")))
    return joined.withColumn("slot", F.col("s") + F.col("_rank") - F.col("a")).withColumn("home_shard", owner).select(
        *[c for c in rows.columns], "shard", "slot", "home_shard"
    )


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes and 1; null text: 1), ``text_crc32`` (null text: null), ``shard``, ``slot``, ``home_shard``.

    Every row is placed, repeated ones and those with null ids too; null ids
    share a place and are told apart by their texts. Other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return shard_rows(narrow, F.col("doc_id"), F.coalesce("text_crc32", F.lit(-1).cast("long")), shards, vnodes, slack)
