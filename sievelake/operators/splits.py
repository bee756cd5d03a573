"""Deterministic hash splits: a group never crosses splits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.hashing import unit_interval


def two_way_split(group: Column, eval_fraction: float, seed: int, namespace: str = "repository\0") -> Column:
    """``val`` where the seeded hash of the group falls below the fraction, else ``train``."""
    key = F.concat(F.lit(f"{seed}:{namespace}"), group)
    return F.when(unit_interval(key) < eval_fraction, "val").otherwise("train")


def ratio_split(group: Column, ratios: Mapping[str, float], seed: int) -> Column:
    """First name whose cumulative ratio exceeds the hash; the last name takes the rest."""
    draw = unit_interval(F.concat(F.lit(f"{seed}:"), group))
    names = list(ratios)
    edge, chosen = 0.0, None
    for name in names[:-1]:
        edge += ratios[name]
        chosen = F.when(draw < edge, name) if chosen is None else chosen.when(draw < edge, name)
    return F.lit(names[-1]) if chosen is None else chosen.otherwise(names[-1])


def assigned_split(rows: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to reviewed assignments; ``assigned`` is false where none exists."""
    return rows.join(plan.withColumn("assigned", F.lit(True)), keys, "left").withColumn(
        "assigned", F.coalesce("assigned", F.lit(False))
    )


def crossing_groups(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that appear in more than one split."""
    return (
        rows.groupBy(group)
        .agg(F.count_distinct(split).alias("n_splits"))
        .filter(F.col("n_splits") > 1)
    )
