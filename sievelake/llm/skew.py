"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has over one in so many of the rows that have a partner: there are fewer hot keys than this, and they
#: are broadcast. Parts that a hot key's rows are dealt to, should the others need a shuffle.
SHARE, PARTS = 10_000, 1024


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], share: int = SHARE) -> DataFrame:
    """The inner join of ``rows`` with ``keyed``, one row for each key and ``n``, how many of ``rows`` have that key.

    Keys with over one in ``share`` of all ``n`` are broadcast, at any size of the
    tables; should the others need a shuffle, rows that have met their partner are
    spread in it by number, so that no key is large. Rows are read once. Keys must
    not be null; ``n`` isn't returned.
    """
    hot = (keyed.agg(F.sum("n")).first()[0] or 0) // share
    partner = [c for c in keyed.columns if c not in on and c != "n"]
    held = F.struct(*partner)
    some = F.broadcast(keyed.filter(F.col("n") > hot).select(*on, held.alias("_met")))
    marked = rows.join(some, on, "left").withColumn("_part", F.when(F.col("_met").isNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))))
    cold = keyed.filter(F.col("n") <= hot).select(*on, F.lit(0).cast("long").alias("_part"), held.alias("_cold"))
    joined = marked.join(cold, [*on, "_part"], "left").withColumn("_met", F.coalesce("_met", "_cold")).filter("_met IS NOT NULL")
    return joined.select(*rows.columns, *[F.col(f"_met.{c}").alias(c) for c in partner])
