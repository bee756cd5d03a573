"""Routing, transition and n-gram statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.operators.select import running_offsets


def transitions(rows: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Rows with ``next`` and its place ``t``; the last of each key has none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    stepped = rows.withColumn("next", F.lead(state).over(w)).withColumn("t", F.row_number().over(w) - 1)
    return stepped.filter(F.col("next").isNotNull())


def transition_counts(rows: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    return transitions(rows, keys, order, state).groupBy(F.col(state).alias("a"), F.col("next").alias("b")).agg(F.count("*").alias("n"))


def run_lengths(rows: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """``state``, ``length`` of each run of equal states."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.coalesce((F.col(state) != F.lag(state).over(w)).cast("int"), F.lit(0))
    runs = rows.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run", F.col(state).alias("state")).agg(F.count("*").alias("length")).drop("_run")


def entropy(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Natural-log entropy of counts by key."""
    total = counts.groupBy(*keys).agg(F.sum(n).alias("_t"), F.sum(F.col(n) * F.log(n)).alias("_s"))
    return total.select(*keys, (F.log("_t") - F.col("_s") / F.col("_t")).alias("entropy"))


def local_entropy(rows: DataFrame, keys: list[str], order: list[str], state: str, window: int = 32) -> DataFrame:
    """Mean entropy of transitions in windows of ``window`` of them, by key."""
    stepped = transitions(rows, keys, order, state).withColumn("_w", F.floor(F.col("t") / window))
    counts = stepped.groupBy(*keys, "_w", state, "next").agg(F.count("*").alias("n"))
    return entropy(counts, [*keys, "_w"]).groupBy(*keys).agg(F.avg("entropy").alias("local_entropy"))


def load_statistics(slots: DataFrame, group: str, expert: str, experts: int) -> DataFrame:
    """Entropy, variation, largest share and unused experts by group; experts without a slot count as zero."""
    counts = slots.groupBy(group, expert).agg(F.count("*").alias("n"))
    mean = F.col("total") / experts
    sums = counts.groupBy(group).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum(F.col("n") * F.log("n")).alias("nl"), F.max("n").alias("top"), F.count("*").alias("used"))
    return sums.select(
        group, "total", (F.log("total") - F.col("nl") / F.col("total")).alias("entropy"), (F.sqrt(F.col("sq") / experts - mean * mean) / mean).alias("load_cv"),
        (F.col("top") / F.col("total")).alias("max_share"), (F.lit(experts) - F.col("used")).alias("unused"),
    )


def enrichment(slots: DataFrame, category: str, expert: str) -> DataFrame:
    """p(category, expert) / p(expert) over p(category): how much more often than over all."""
    counts = slots.groupBy(category, expert).agg(F.count("*").alias("n"))
    by = lambda c: F.sum("n").over(Window.partitionBy(*c))
    return counts.withColumn("enrichment", (F.col("n") / by([category])) / (by([expert]) / by([]))).select(category, expert, "enrichment")


def mutual_information(rows: DataFrame, x: str, y: str) -> DataFrame:
    """In bits."""
    counts = rows.groupBy(x, y).agg(F.count("*").alias("n"))
    a, b = counts.groupBy(x).agg(F.sum("n").alias("nx")), counts.groupBy(y).agg(F.sum("n").alias("ny"))
    total = counts.agg(F.sum("n").alias("t"))
    joined = counts.join(a, x).join(b, y).crossJoin(total)
    p = F.col("n") / F.col("t")
    return joined.agg(F.sum(p * F.log2(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("bits"))


def same_adjacency(rows: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Share of transitions that stay, and the share that chance would give."""
    counts = transition_counts(rows, keys, order, state)
    share = counts.agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)) / F.sum("n")).alias("same"))
    states = rows.groupBy(state).agg(F.count("*").alias("n"))
    chance = states.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("baseline"))
    return share.crossJoin(chance)


def ngram_statistics(grams: DataFrame, order: str, bucket: str, gram: str) -> DataFrame:
    """Used buckets, distinct n-grams and collisions by order. Distinct pairs are made first, so the counts are sums."""
    distinct = grams.groupBy(order, bucket, gram).agg(F.count("*").alias("n"))
    buckets = distinct.groupBy(order, bucket).agg(F.count("*").alias("g"), F.sum("n").alias("n"))
    return buckets.groupBy(order).agg(
        F.count("*").alias("utilized_rows"), F.sum("g").alias("distinct_ngrams"), (F.sum("g") - F.count("*")).alias("collisions"), F.sum("n").alias("lookups")
    )


def coactivation(tokens: DataFrame, order: str, experts: str) -> DataFrame:
    """``a`` < ``b``, ``weight``: experts used by one token, and by one token and the next at the same place."""
    current = tokens.select(F.array_distinct(experts).alias("e"))
    inside = current.select(F.explode("e").alias("a"), "e").select("a", F.explode("e").alias("b")).filter("a < b")
    w = Window.partitionBy("sequence").orderBy(order)
    pairs = tokens.withColumn("_p", F.lag(experts).over(w)).filter(F.col("_p").isNotNull())
    zipped = pairs.select(F.explode(F.arrays_zip(F.col("_p").alias("x"), F.col(experts).alias("y"))).alias("z")).select(F.col("z.x").alias("x"), F.col("z.y").alias("y"))
    across = zipped.filter("x IS NOT NULL AND y IS NOT NULL AND x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return inside.unionByName(across).groupBy("a", "b").agg(F.count("*").alias("weight"))


#: Experts that are packed on the driver at most: a model's, not a corpus's.
MOST_EXPERTS = 4096


def expert_pages(load: DataFrame, edges: DataFrame, per_page: int) -> dict[int, int]:
    """Page of each expert, from ``load`` (expert, n) and ``edges`` (a, b, weight).

    A page opens with the most loaded expert left and grows by the one with the
    most weight to its members, then the most load, then the smallest number.
    The weights to the open page are kept as one array, updated by each member.
    """
    rows = load.orderBy("expert").limit(MOST_EXPERTS + 1).toPandas()
    if len(rows) > MOST_EXPERTS:
        raise ValueError(f"more than {MOST_EXPERTS} experts")
    names, heavy = rows["expert"].to_numpy(), rows["n"].to_numpy(dtype=np.float64)
    place = {int(e): i for i, e in enumerate(names)}
    weight = np.zeros((len(names), len(names)))
    for r in edges.groupBy("a", "b").agg(F.sum("weight").alias("w")).toLocalIterator():
        if r["a"] in place and r["b"] in place:
            i, j = place[r["a"]], place[r["b"]]
            weight[i, j] += r["w"]
            weight[j, i] += r["w"] if i != j else 0
    page, free = np.full(len(names), -1), np.ones(len(names), bool)
    for n in range(len(names)):
        if n % per_page == 0:
            near = np.zeros(len(names))
        best = np.lexsort((names, -heavy, -near, ~free))[0]
        page[best], free[best] = n // per_page, False
        near += weight[best]
    return {int(e): int(p) for e, p in zip(names, page)}


def router_top_k(scores: Column, k: int) -> Column:
    """Structs (weight, expert) of the k largest scores, weights adding up to one; ties to the smaller expert."""
    ranked = F.slice(F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("expert")))), 1, k)
    total = F.aggregate(ranked, F.lit(0.0), lambda a, x: a - x["s"])
    return F.transform(ranked, lambda x: F.struct((-x["s"] / total).alias("weight"), x["expert"].alias("expert")))


def nucleus(rows: DataFrame, keys: list[str], p: str, item: str, top_k: int = 40, top_p: float = 0.95) -> DataFrame:
    """The likeliest items until their sum reaches ``top_p``, renormalised."""
    w = Window.partitionBy(*keys).orderBy(F.desc(p), item)
    ranked = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_k)
    before = F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(p)
    kept = ranked.withColumn("_b", before).filter(F.col("_b") < top_p)
    return kept.withColumn("share", F.col(p) / F.sum(p).over(Window.partitionBy(*keys))).drop("_r", "_b")


def scaled_trace(layer: Column, expert: Column, step: Column, layers: int, experts: int) -> tuple[Column, Column]:
    """A trace of a small model stretched over more layers and experts."""
    return layer % layers, (expert + step) % experts


def regrouped(dispatch: Column, layers: int) -> tuple[Column, Column]:
    """Token and layer of the n-th dispatch."""
    return F.floor(dispatch / layers), dispatch % layers


def histogram_bin(value: Column, low: float, high: float, bins: int) -> Column:
    return F.least(F.greatest(F.floor((value - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))


def log_natural_to_bits(x: Column) -> Column:
    return x / math.log(2)


def token_records(dispatches: DataFrame, order: str, layers: int) -> DataFrame:
    """``token``, ``experts`` (by layer) of a trace whose dispatches go through layers 0, 1, .. again and again; any other order raises."""
    placed = running_offsets(dispatches, [], order, F.lit(1))
    token, layer = regrouped(F.col("start"), layers)
    strict = F.when(F.col("layer") == layer, F.col("layer")).otherwise(F.raise_error(F.lit("dispatches don't go through the layers in order")).cast("int"))
    grouped = placed.select(token.alias("token"), F.struct(strict.alias("layer"), "experts").alias("x")).groupBy("token").agg(F.sort_array(F.collect_list("x")).alias("x"))
    whole = F.when(F.size("x") == layers, F.col("x")).otherwise(F.raise_error(F.lit("the last token lacks layers")).cast("array<struct<layer:int,experts:array<bigint>>>"))
    return grouped.select("token", F.transform(whole, lambda e: e["experts"]).alias("experts"))


def most_frequent(rows: DataFrame, item: str, n: int) -> DataFrame:
    """The n items that occur most, ties to the smaller."""
    return rows.groupBy(item).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(item)).limit(n)
