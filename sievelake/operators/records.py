"""Sample records: validity, gates, trajectories, coverage and serialisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.hashing import canonical_json, sha256_hex
from sievelake.operators.filters import first_reason

#: Names that records may use.
SPLITS = ["train", "val", "test"]
STATUSES = ["PASS", "FAIL", "ERROR", "NOT_RUN"]
EVENT_TYPES = ["EVIDENCE", "PLAN", "ACTION", "OBSERVATION", "DIAGNOSIS", "VERIFY", "FINAL", "WRONG_HYPOTHESIS", "FAILURE_OUTPUT", "RECOVERY_ACTION", "TOOL_CALL", "TOOL_RESULT"]
MASKED = ["WRONG_HYPOTHESIS", "FAILURE_OUTPUT"]
DIGEST = "^[0-9a-f]{64}$"


def sample_violations() -> Column:
    """Names of the checks that a sample record (columns of that name) fails."""
    c = F.col
    checks = {
        "sample_id": c("sample_id").isNull() | ~c("sample_id").rlike("^ds2-[0-9a-f]{64}$"),
        "content_sha256": c("content_sha256").isNull() | ~c("content_sha256").rlike(DIGEST),
        "language": c("language").isNull(),
        "split": c("split").isNull() | ~c("split").isin(SPLITS),
        "token_count": c("token_count").isNull() | (c("token_count") < 0),
        "rejection_reason": F.coalesce(~c("accepted"), F.lit(False)) & c("rejection_reason").isNull(),
        "created_at": F.try_to_timestamp(c("created_at")).isNull(),
        "parent_sample_ids": c("parent_sample_ids").isNull() | F.exists("parent_sample_ids", lambda x: x.isNull()),
    }
    return F.array_compact(F.array(*[F.when(broken, name) for name, broken in checks.items()]))


def verification_valid() -> Column:
    c = F.col
    hashes = F.lit(True)
    for name in ("test_hash", "environment_hash"):
        hashes = hashes & (c(name).isNull() | c(name).rlike(DIGEST))
    passing = (c("status") != "PASS") | ((c("failed") == 0) & ~c("timed_out"))
    return c("status").isin(STATUSES) & (c("passed") >= 0) & (c("failed") >= 0) & passing & hashes


def critic_valid() -> Column:
    return F.col("verdict").isin("PASS", "FAIL", "UNCERTAIN") & F.col("confidence").between(0, 1)


def accepted(verdict: Column, made_by_critic: Column, fresh_context: Column) -> Column:
    """Tests passed, both hashes known, and an independent review agrees."""
    objective = (F.col("status") == "PASS") & (F.col("passed") > 0) & F.col("test_hash").isNotNull() & F.col("environment_hash").isNotNull()
    return objective & (~made_by_critic | fresh_context) & (verdict == "PASS")


def tests_turn(tests: Column, before: str, after: str) -> Column:
    return (F.size(tests) > 0) & F.forall(tests, lambda t: (t.before_status == before) & (t.after_status == after))


def repair_reason() -> Column:
    """The first thing that keeps a repair task from being accepted."""
    return first_reason([
        ("fail_to_pass", ~tests_turn(F.col("fail_to_pass"), "FAIL", "PASS")), ("pass_to_pass", ~tests_turn(F.col("pass_to_pass"), "PASS", "PASS")),
        ("environment_mismatch", ~F.col("environment_before").eqNullSafe(F.col("environment_after"))), ("critic_rejected", ~F.col("critic_passed")),
        ("diff_not_inspected", ~F.col("diff_inspected")),
    ])


def stop_pairs(rows: DataFrame) -> DataFrame:
    """``pair_id``, ``valid``: one sample that should stop, one that should not, of different scopes."""
    return rows.groupBy("pair_id").agg(
        ((F.count("*") == 2) & (F.count_distinct("stop_should_happen") == 2) & (F.count_distinct("requested_scope") == 2)).alias("valid")
    )


def complete_pairs(rows: DataFrame, pair: str) -> DataFrame:
    """Rows without a pair, and rows whose pair is there."""
    both = F.count("*").over(Window.partitionBy(pair)) == 2
    return rows.withColumn("_both", both).filter(F.col(pair).isNull() | F.col("_both")).drop("_both")


def trajectories(events: DataFrame, key: str, order: str) -> DataFrame:
    """``key``, ``events`` (ordered structs with sequence, masks and weights), ``ends_final``, ``valid``.
    One key's events must fit a task: a trajectory is one record."""
    c = F.col
    masked = c("known_bad") | c("type").isin(MASKED)
    rows = events.select(key, order, "type", "content", "known_bad", F.when(masked, 0.0).otherwise(1.0).alias("loss_mask"), F.when(masked, 0.0).otherwise(1.0).alias("target_weight"))
    whole = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "type", "content", "known_bad", "loss_mask", "target_weight"))).alias("events"))
    numbered = F.transform("events", lambda e, i: F.struct(i.alias("sequence"), e.type.alias("type"), e.content.alias("content"), e.known_bad.alias("known_bad"), e.loss_mask.alias("loss_mask"), e.target_weight.alias("target_weight")))
    ends = F.element_at("events", -1).type == "FINAL"
    known = F.forall("events", lambda e: e.type.isin(EVENT_TYPES) & e.content.isNotNull())
    return whole.select(key, numbered.alias("events"), ends.alias("ends_final"), (ends & known).alias("valid"))


def family_metrics(candidates: DataFrame, reviews: DataFrame, key: str, family: str, size: str) -> DataFrame:
    """Counts and rates by family. Candidates without a review are pending."""
    joined = candidates.select(key, F.col(family).alias("family"), F.col(size).alias("size")).join(reviews, key, "left")
    reviewed, passed = F.count("accepted"), F.count_if(F.col("accepted"))
    return joined.groupBy("family").agg(
        F.count("*").alias("candidates"), reviewed.alias("reviewed"), (F.count("*") - reviewed).alias("pending"),
        F.round(F.try_divide(passed, reviewed), 6).alias("acceptance_of_reviewed"), F.round(F.try_divide(passed, F.count("*")), 6).alias("acceptance_of_candidates"),
        F.round(F.try_divide(F.count_if(F.col("flagged")), reviewed), 6).alias("flag_rate"), F.round(F.avg("size"), 6).alias("mean_size"),
    )


def coverage(rows: DataFrame, stratum: str, weight: str, required: list[str], least_docs: int, least_weight: int) -> DataFrame:
    """Every required stratum with its counts, what it lacks and whether it passes."""
    have = rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("docs"), F.sum(weight).alias("preds"))
    need = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in required])).alias("stratum"))
    full = need.join(have, "stratum", "left").na.fill(0, ["docs", "preds"])
    return full.select("stratum", "docs", "preds", F.greatest(F.lit(0), least_docs - F.col("docs")).alias("shortfall"), ((F.col("docs") >= least_docs) & (F.col("preds") >= least_weight)).alias("passed"))


def spans(rows: DataFrame, key: str, order: str, size: Column, weight: Column) -> DataFrame:
    """Where each part lies in its key's serialisation, and its weight."""
    sized = rows.select(key, order, size.cast("long").alias("n"), weight.alias("weight"))
    stop = F.sum("n").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("stop", stop).select(key, order, (F.col("stop") - F.col("n")).alias("start"), "stop", "weight")


def explode_tasks(parents: DataFrame, key: str, families: list[str]) -> DataFrame:
    rows = parents.select(key, F.explode(F.array(*[F.lit(x) for x in families])).alias("task_family"))
    return rows.withColumn("sample_id", sha256_hex(F.concat(F.col(key), F.lit(":"), F.col("task_family"))))


def resolve_pointers(notes: DataFrame, archive: DataFrame, note: str) -> DataFrame:
    """Notes with the content that ``<mem:NNNNNN>`` points to; null where it doesn't exist."""
    number = F.nullif(F.regexp_extract(note, r"<mem:(\d{6})>", 1), F.lit("")).cast("long")
    return notes.withColumn("number", number).join(archive, "number", "left")


def failure_valid() -> Column:
    return (F.col("recurrence_count") >= 1) & F.col("objectively_verified") & F.col("failure_type").isNotNull()


def failure_id() -> Column:
    return sha256_hex(canonical_json({"student": F.col("student"), "failure_type": F.col("failure_type")}))
