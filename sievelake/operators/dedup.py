"""Exact deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.operators.select import running_offsets


def exact_dedup(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``. ``row_number() <= 1`` lets Spark
    prune each key on the map side, so that a hot key moves one row per task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def differences(seen: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that only one side has."""
    missing = expected.exceptAll(seen).select(F.lit("missing").alias("side"), "*")
    return missing.unionByName(seen.exceptAll(expected).select(F.lit("unexpected").alias("side"), "*"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that a frame lacks are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def admission(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, digest, split) with the first ``reason`` against each: source not in the plan or not
    reviewed, a training copy of held-out text, a later copy in its split."""
    held = rows.filter("split = 'val'").select("digest").distinct().withColumn("held", F.lit(True))
    joined = rows.join(plan.withColumn("planned", F.lit(True)), "source", "left").join(held, "digest", "left")
    early = F.when(F.col("planned").isNull(), "not_in_plan").when(~F.col("reviewed"), "license").when((F.col("split") == "train") & F.col("held"), "held_out_duplicate")
    marked = joined.withColumn("early", early)
    first = marked.filter("early IS NULL").groupBy("split", "digest").agg(F.min("doc_id").alias("first"))
    marked = marked.join(first, ["split", "digest"], "left")
    return marked.withColumn("reason", F.coalesce("early", F.when(F.col("doc_id") != F.col("first"), "exact_duplicate"))).select("doc_id", "reason")


def union_in_order(parts: list[DataFrame], orders: list[str]) -> DataFrame:
    """All rows with ``source_ordinal`` and ``place``, their part and their place in it: the order of files written one after the other."""
    placed = []
    for ordinal, (part, order) in enumerate(zip(parts, orders, strict=True)):
        numbered = running_offsets(part.withColumn("_order", F.col(order)), [], "_order", F.lit(1))
        placed.append(numbered.withColumn("source_ordinal", F.lit(ordinal)).withColumnRenamed("start", "place").drop("_order"))
    return union_all(placed)


def deep_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key``, ``path``, ``a``, ``b`` of the leaves (key, path, value) that only one side has or whose values differ; nulls equal nulls."""
    a = left.select(key, "path", F.struct("value").alias("a"))
    b = right.select(key, "path", F.struct("value").alias("b"))
    joined = a.join(b, [key, "path"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return joined.select(key, "path", F.col("a.value").alias("a"), F.col("b.value").alias("b"))
