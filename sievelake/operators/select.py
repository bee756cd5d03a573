"""Deterministic samples, quotas, budgets, chunks and packing offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.hashing import sha256_hex
from sievelake.session import materialize


def hash_rank(seed: int, *identity: Column) -> Column:
    """32 hex digits that order rows the same way wherever they are."""
    return F.substring(sha256_hex(F.concat_ws("\0", F.lit(str(seed)), *[c.cast("string") for c in identity])), 1, 32)


def bottom_k(rows: DataFrame, strata: list[str], rank: Column, key: str, k: int) -> DataFrame:
    """The k rows of each stratum with the smallest rank; Spark keeps k of each task before the shuffle."""
    window = Window.partitionBy(*strata).orderBy(rank, key)
    return rows.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k).drop("_rank")


def prefix_quota(rows: DataFrame, keys: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """Rows in order until those before reach the limit; the row that crosses it is in."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_before", F.coalesce(F.sum(size).over(before), F.lit(0))).filter(F.col("_before") < limit).drop("_before")


def chunk_views(rows: DataFrame, keys: list[str], order: str, body: str, n: int = 3) -> DataFrame:
    """Groups of n rows in order, joined by newlines; a rest of fewer goes."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    placed = rows.withColumn("chunk", F.floor(place / n))
    grouped = placed.groupBy(*keys, "chunk").agg(F.count("*").alias("_n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, body))), lambda x: x[body]), "\n").alias("view"))
    return grouped.filter(F.col("_n") == n).drop("_n")


def batches(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / n))


def token_budget(rows: DataFrame, key: str, stratum: str, size: str, rank: str, budget: int) -> DataFrame:
    """Rows within a budget: every stratum gets its share, filled in order of rank and skipping what is too large; then what
    is left goes to the others in order of rank.

    All rows are kept if they fit. The first pass runs by stratum over batches of
    (rank, key, size) in order, carrying one number; the second goes once over what
    was left in order of rank, again as a stream of narrow rows with one number.
    """
    narrow = materialize(rows.select(F.col(key).alias("key"), F.col(stratum).alias("stratum"), F.col(size).cast("long").alias("size"), F.col(rank).alias("rank")), "budget")
    totals = narrow.groupBy("stratum").agg(F.sum("size").alias("total"))
    whole = narrow.agg(F.sum("size")).first()[0] or 0
    if whole <= budget:
        return rows
    quotas = totals.select("stratum", F.floor(F.lit(budget).cast("decimal(38,0)") * F.col("total") / whole).cast("long").alias("quota"))
    schema = "key long, size long, rank string, quota long, chosen boolean"

    def fill(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, left = None, 0
        for frame in groups:
            chosen = []
            for name, n, quota in zip(frame["stratum"], frame["size"], frame["quota"]):
                if name != current:
                    current, left = name, quota
                fits = n <= left
                left -= n if fits else 0
                chosen.append(fits)
            yield frame.assign(chosen=chosen)[["key", "size", "rank", "quota", "chosen"]]

    joined = narrow.join(quotas, "stratum").repartition("stratum").sortWithinPartitions("stratum", "rank", "key")
    first = materialize(joined.select("key", "stratum", "size", "rank", "quota").mapInPandas(fill, schema), "first-pass")
    rest = budget - (first.filter("chosen").agg(F.sum("size")).first()[0] or 0)
    smaller = first.filter(~F.col("chosen") & (F.col("size") <= rest)).withColumn("stratum", F.lit("")).withColumn("quota", F.lit(rest).cast("long"))
    second = smaller.select("key", "stratum", "size", "rank", "quota").coalesce(1).sortWithinPartitions("rank", "key").mapInPandas(fill, schema)
    chosen = first.filter("chosen").select("key").union(second.filter("chosen").select("key"))
    return rows.join(chosen.withColumnRenamed("key", key), key, "left_semi")


def round_robin(rows: DataFrame, group: str, order: str, target: int) -> DataFrame:
    """Rows by turns from each group until the target: ``turn``, then the group's name."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("turn", turn).orderBy("turn", group).limit(target)


def bundle_round_robin(bundles: DataFrame, group: str, order: str, size: str, target: int) -> DataFrame:
    """``group``, ``order``, ``size``, ``turn`` of the bundles taken by turns, each whole or not at all.

    Turn by turn and group by group (in order of name) a bundle is taken if the
    total stays within the target, and skipped if not. All bundles before the
    first that doesn't fit are one prefix, found by running sums; what is left of
    the target is then smaller than a bundle, and the search goes on behind with
    those that still fit, until none does. Empty bundles and null sizes count for nothing.
    """
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    todo = bundles.select(F.col(group), F.col(order), F.coalesce(F.col(size), F.lit(0)).cast("long").alias(size)).withColumn("turn", turn).withColumn("_at", F.struct("turn", group))
    todo, left, taken = materialize(todo.filter(F.col(size) > 0), "bundles"), target, None
    while left > 0:
        fitting = todo.filter(F.col(size) <= left)
        sums = fitting.groupBy("turn").agg(F.sum(size).alias("_sum"))
        before = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
        inside = Window.partitionBy("turn").orderBy(group)
        placed = materialize(fitting.join(sums, "turn").withColumn("_upto", F.col("_base") + F.sum(size).over(inside)).drop("_base"), "bundle-sums")
        # Everything up to the first that doesn't fit.
        over = placed.filter(F.col("_upto") > left).agg(F.min("_at").alias("at")).first()["at"]
        part = placed if over is None else placed.filter(F.col("_at") < F.struct(F.lit(over["turn"]).alias("turn"), F.lit(over[group]).alias(group)))
        part = materialize(part.drop("_upto"), "bundles-taken")
        taken = part if taken is None else taken.unionByName(part)
        if over is None:
            break
        left -= part.agg(F.sum(size)).first()[0] or 0
        todo = materialize(placed.filter(F.col("_at") > F.struct(F.lit(over["turn"]).alias("turn"), F.lit(over[group]).alias(group))).drop("_upto"), "bundles")
        if not todo.limit(1).count():
            break
    taken = todo.limit(0) if taken is None else taken
    return taken.select(group, order, size, "turn")


def running_offsets(rows: DataFrame, keys: list[str], order: str, size: Column, parts: int = 64) -> DataFrame:
    """``start`` of each row in its key's stream. Two levels: parts of the order are summed first, so that no task sorts a
    whole key; the parts' sums are a table of keys times ``parts``."""
    sized = rows.withColumn("_size", size.cast("long"))
    edges = sized.select(F.percentile_approx(F.col(order), F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000).alias("e")).first()["e"] or []
    part = F.lit(0)
    for e in sorted(set(edges)):
        part = part + F.when(F.col(order) > e, 1).otherwise(0)
    placed = sized.withColumn("_part", part)
    sums = placed.groupBy(*keys, "_part").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.withColumn("_in", F.coalesce(F.sum("_size").over(inner), F.lit(0))).join(sums, [*keys, "_part"])
    return joined.withColumn("start", F.col("_base") + F.col("_in")).drop("_size", "_part", "_in", "_base")


def shard_of(position: Column, shard_tokens: int) -> Column:
    return F.floor(position / shard_tokens)


def seeded_order(seed: int, *identity: Column) -> Column:
    """A shuffle's order: the same rows, another seed, another order."""
    return F.xxhash64(F.lit(seed), *identity)
