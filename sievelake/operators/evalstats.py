"""Evaluation statistics: pass@k, rollups, paired differences, bootstrap, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.operators.select import running_offsets


def pass_at_k(results: DataFrame, task: str, correct: Column, k: int) -> DataFrame:
    """``pass_at_k`` (mean over tasks with at least k draws), ``n_tasks``, ``n_excluded``: unbiased, missing draws aren't failures."""
    tasks = results.groupBy(task).agg(F.count("*").alias("n"), F.count_if(correct).alias("c"))
    fail = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * F.greatest(F.col("n") - F.col("c") - i, F.lit(0)) / (F.col("n") - i))
    enough = F.col("n") >= k
    return tasks.agg(F.avg(F.when(enough, 1 - fail)).alias("pass_at_k"), F.count_if(enough).alias("n_tasks"), F.count_if(~enough).alias("n_excluded"))


def rollup(rows: DataFrame, keys: list[str], category: str, correct: Column) -> DataFrame:
    """Counts and rates by keys, and by keys and category (null: all), in one pass."""
    both = rows.withColumn("_ok", correct).groupingSets([[F.col(k) for k in keys], [F.col(k) for k in [*keys, category]]], *[F.col(k) for k in [*keys, category]])
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("_ok")).alias("n_correct"), F.try_divide(F.count_if(F.col("_ok")), F.count("*")).alias("accuracy"))


def paired_delta(left: DataFrame, right: DataFrame, key: str, loss: str, weight: str) -> DataFrame:
    """Weighted mean of the paired differences, its error from the effective number, and a 95 % interval."""
    both = left.select(key, F.col(loss).alias("a"), F.col(weight).alias("w")).join(right.select(key, F.col(loss).alias("b")), key)
    sums = both.withColumn("x", F.col("b") - F.col("a")).agg(
        F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("sx2"),
    )
    mean, effective = F.col("sx") / F.col("sw"), F.col("sw") * F.col("sw") / F.col("sw2")
    error = F.sqrt(F.greatest(F.col("sx2") / F.col("sw") - mean * mean, F.lit(0.0)) / F.greatest(effective - 1, F.lit(1.0)))
    return sums.select("n", mean.alias("delta"), error.alias("se"), (mean - 1.96 * error).alias("low"), (mean + 1.96 * error).alias("high"))


def cluster_bootstrap(clusters: DataFrame, key: str, value: str, weight: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """Mean and 95 % interval of sum(value) / sum(weight) over resampled clusters.

    Draws come from hashes: draw j of resample i takes the cluster of that number.
    The clusters are numbered in order of a hash, part by part; each resample is a
    group of as many draws.
    """
    numbered = running_offsets(clusters.select(value, weight, F.xxhash64(key).alias("_at")), [], "_at", F.lit(1)).select(value, weight, F.col("start").cast("int").alias("c"))
    n = clusters.count()
    draws = clusters.sparkSession.range(resamples).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("j"))
    picked = draws.select("i", F.pmod(F.xxhash64(F.lit(seed), "i", "j"), F.lit(max(n, 1))).cast("int").alias("c")).join(numbered, "c")
    means = picked.groupBy("i").agg((F.sum(value) / F.sum(weight)).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def transition_kind(before: Column, after: Column) -> Column:
    return F.when(before & after, "retained").when(after, "gained").when(before, "lost").otherwise("remained_wrong")


def full_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has; empty when all rows are paired."""
    a, b = left.select(*keys).withColumn("_a", F.lit(1)), right.select(*keys).withColumn("_b", F.lit(1))
    return a.join(b, keys, "full").filter("_a IS NULL OR _b IS NULL").select(*keys, F.when(F.col("_a").isNull(), "left").otherwise("right").alias("missing_in"))


def matrix_gaps(observed: DataFrame, axes: list[DataFrame]) -> DataFrame:
    """Cells of the axes' product that were not observed, and observed ones outside it. The product is a
    stated experiment's grid, not data."""
    grid = axes[0]
    for axis in axes[1:]:
        grid = grid.crossJoin(axis)
    seen = observed.select(*grid.columns).distinct()
    return grid.exceptAll(seen).withColumn("side", F.lit("missing")).unionByName(seen.exceptAll(grid).withColumn("side", F.lit("unexpected")))


def lower_percentiles(values: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """``share``, ``value``: the sample at place int((n - 1) * share), from a histogram of numbers that is summed part by part."""
    counts = values.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    ranked = running_offsets(counts, [], value, F.col("n")).withColumn("upto", F.col("start") + F.col("n"))
    total = counts.agg(F.sum("n").alias("total"))
    asked = values.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in shares])).alias("share")).crossJoin(total)
    hit = asked.join(ranked, F.col("upto") > F.floor((F.col("total") - 1) * F.col("share")))
    return hit.groupBy("share").agg(F.min(value).alias("value"))


def finite_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``field``, ``observed_count``, ``sum``, ``max`` of finite values; null, not zero, where none is."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    fine = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    return long.groupBy("field").agg(F.count(fine).alias("observed_count"), F.sum(fine).alias("sum"), F.max(fine).alias("max"))


def parity(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Largest and mean difference, and the relative L2 norm."""
    d = F.col(a) - F.col(b)
    return rows.agg(F.max(F.abs(d)).alias("max_abs"), F.avg(F.abs(d)).alias("mean_abs"), F.sqrt(F.sum(d * d) / F.greatest(F.sum(F.col(a) * F.col(a)), F.lit(1e-24))).alias("relative_l2"))


def ablation_deltas(normal: DataFrame, ablated: DataFrame, metric: str, value: str) -> DataFrame:
    joined = normal.select(metric, F.col(value).alias("a")).join(ablated.select(metric, F.col(value).alias("b")), metric)
    return joined.filter("a IS NOT NULL AND b IS NOT NULL").select(metric, (F.col("b") - F.col("a")).alias("delta"))


def trend(rows: DataFrame, key: str, order: str, value: str, flat: float = 1e-3) -> DataFrame:
    """stable, increasing, decreasing or non_monotone by key."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order))
    steps = rows.withColumn("_d", step)
    shape = F.when(F.max(F.abs("_d")) < flat, "stable").when(F.bool_and(F.col("_d") >= 0), "increasing").when(F.bool_and(F.col("_d") <= 0), "decreasing").otherwise("non_monotone")
    return steps.groupBy(key).agg(shape.alias("trend"))


def best_safe(rows: DataFrame, key: str, score: str, safe: Column) -> DataFrame:
    """The key with the best score among safe rows."""
    return rows.filter(safe).agg(F.max_by(key, F.struct(score, key)).alias(key), F.max(score).alias(score))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def moving_average(rows: DataFrame, key: str, order: str, value: str, n: int, full_only: bool = True) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - n, 0)
    out = rows.withColumn("average", F.avg(value).over(w))
    return out.withColumn("_n", F.count("*").over(w)).filter(F.col("_n") == n).drop("_n") if full_only else out


def ledger_upsert(ledger: DataFrame, new: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """The ledger with new keys added (what it has stays), and the keys whose values conflict."""
    joined = ledger.select(*keys, F.col(value).alias("_old")).join(new.select(*keys, F.col(value).alias("_new")), keys, "full")
    merged = joined.select(*keys, F.coalesce("_old", "_new").alias(value))
    return merged, joined.filter("_old IS NOT NULL AND _new IS NOT NULL AND _old != _new")
