"""Queries over admission, repair and recovery records."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.operators import overlap, training_records
from sievelake.operators.filters import python_parse_status
from sievelake.plans.text_queries import LEXEMES, UNIT
from sievelake.registry import register
from sievelake.session import table
from sievelake.sources import readers

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@register("remaining_candidates", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def remaining_candidates(spark, d):
    """Candidates that no review of an earlier run covers."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@register("full_admission", f"""
WITH r AS (SELECT doc_id, source, lang, sha256(text) AS digest, ' ' || array_to_string({LEXEMES.replace('(text', '(lower(text)')}, ' ') || ' ' AS line, CASE WHEN {UNIT.format("'42:repository' || chr(0) || source")} < 0.2 THEN 'validation' ELSE 'train' END AS split FROM documents),
h AS (SELECT DISTINCT digest FROM r WHERE split = 'validation' AND doc_id % 13 > 0),
e AS (SELECT r.*, CASE WHEN source = 'src3' THEN 'not_in_reviewed_source_plan' WHEN lang = 'fr' THEN 'license_not_in_reviewed_allowlist' WHEN doc_id % 13 = 0 THEN 'not_in_frozen_retained_splits'
  WHEN split = 'train' AND digest IN (SELECT digest FROM h) THEN 'exact_heldout_duplicate' END AS early FROM r),
f AS (SELECT e.*, min(CASE WHEN early IS NULL THEN doc_id END) OVER (PARTITION BY split, digest) AS first FROM e),
b AS (SELECT {LEXEMES.replace('(text', '(lower(text)')} AS t FROM benchmark),
o AS (SELECT doc_id FROM r WHERE EXISTS (SELECT 1 FROM b WHERE len(t) >= 12 AND contains(line, ' ' || array_to_string(t, ' ') || ' ')))
SELECT doc_id, coalesce(early, CASE WHEN doc_id <> first THEN 'exact_duplicate' WHEN doc_id IN (SELECT doc_id FROM o) THEN 'evaluation_overlap' WHEN doc_id % 17 = 0 THEN 'python_ast_fail' END) AS reason,
 early IS NULL AND doc_id = first AND (doc_id IN (SELECT doc_id FROM o) OR doc_id % 17 = 0) AS quarantined FROM f
""")
def full_admission(spark, d):
    """All reasons against files, in order, with the quarantine of overlaps and of source that doesn't parse."""
    from sievelake.operators import splits

    docs = table(spark, d, "documents")
    n, split = F.col("doc_id"), F.when(splits.two_way_split(F.col("source"), 0.2, 42) == "val", "validation").otherwise("train")
    path = F.concat(F.lit("f"), n.cast("string"))
    rows = docs.select("doc_id", "source", path.alias("path"), F.lit("r1").alias("revision"), F.when(F.col("lang") == "fr", "other").otherwise("MIT").alias("license"), F.lit("l1").alias("license_sha256"), F.sha2("text", 256).alias("digest"), F.sha2("text", 256).alias("stated_digest"))
    plan = docs.select("source", F.when(split == "validation", "val").otherwise("train").alias("planned_split")).distinct().filter("source != 'src3'").withColumns({"revision": F.lit("r1"), "license_sha256": F.lit("l1")})
    assignments = docs.filter(n % 13 > 0).select("source", path.alias("path"), split.alias("split"))
    flagged = overlap.phrase_containment(docs, "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text").select("doc_id")
    code = F.when(n % 17 == 0, "def broken(").otherwise("x = 1")
    status = F.when(python_parse_status(code) == "parsed", "python_ast_pass").otherwise("python_ast_fail")
    return training_records.admitted(rows, plan, assignments, ["MIT"], flagged, status)


def _repairs(spark, d):
    n = F.col("doc_id")
    digest = lambda x: F.sha2(x.cast("string"), 256)
    case = lambda before, broken: F.array(F.struct(F.lit(before).alias("before_status"), F.when(broken, "FAIL").otherwise("PASS").alias("after_status"), digest(n).alias("test_hash")))
    result = lambda bad: F.struct(F.when(bad, "FAIL").otherwise("PASS").alias("status"), (n % 5 + 1).alias("passed"), digest(n).alias("test_hash"), F.lit("e").alias("environment_hash"))
    return table(spark, d, "labels").select(
        "doc_id", F.concat(F.lit("org/r"), (n % 4).cast("string")).alias("repository"), n.cast("string").alias("issue_id"), F.sha1(n.cast("string")).alias("base_commit"),
        F.when(n % 11 == 0, "main").otherwise(F.sha1((n + 1).cast("string"))).alias("fixed_commit"), F.when(n % 19 == 0, " ").otherwise("mend it").alias("task_description"), digest(n + 2).alias("environment_hash"),
        digest(n + 3).alias("patch_sha256"), case("FAIL", n % 6 == 0).alias("fail_to_pass"), case("PASS", n % 9 == 0).alias("pass_to_pass"), F.concat(F.lit("patch "), n.cast("string")).alias("candidate_patch"),
        result(n % 7 == 0).alias("f2p"), result(F.lit(False)).alias("p2p"),
        F.struct(F.when(F.col("quality") == 1, "PASS").otherwise("UNCERTAIN").alias("verdict"), F.when(n % 8 > 0, "m1").otherwise("").alias("critic_model"), F.lit("v1").alias("critic_version")).alias("critic"),
        F.when(n % 5 == 0, "m1").otherwise("m2").alias("generator_model"), (F.col("toxic") == 0).alias("diff_inspected"), (n % 10 == 0).alias("fresh_context"),
    )


@register("repair_records", """
WITH l AS (SELECT doc_id AS n, quality, toxic, sha256(doc_id::VARCHAR) AS t, sha256('patch ' || doc_id) AS patch FROM labels),
x AS (SELECT *, 'org/r' || n % 4 AS repo, sha1(n::VARCHAR) AS base, CASE WHEN n % 11 = 0 THEN 'main' ELSE sha1((n + 1)::VARCHAR) END AS fixed, sha256((n + 2)::VARCHAR) AS env,
  CASE WHEN n % 7 = 0 THEN 'objective_tests_failed_or_missing' WHEN toxic <> 0 THEN 'candidate_diff_not_inspected' WHEN n % 5 = 0 AND n % 8 > 0 AND n % 10 > 0 THEN 'critic_context_not_independent'
   WHEN n % 8 = 0 THEN 'critic_identity_missing' WHEN quality <> 1 THEN 'critic_uncertain' END AS reason FROM l)
SELECT 'forge:' || repo || ':' || n || ':' || base AS source_id,
 'forge-' || sha256('{"base":"' || base || '","candidate_patch":"' || patch || '","environment":"' || env || '","fixed":"' || fixed || '","issue":"' || n || '","repo":"' || repo || '"}') AS sample_id,
 repo, fixed AS commit_sha, patch AS candidate_patch_sha256, sha256('{"fail_to_pass":"' || t || '","pass_to_pass":"' || t || '"}') AS test_hash, env AS environment_hash, n % 7 > 0 AS test_verified, reason IS NULL AS accepted, reason AS rejection_reason,
 CASE WHEN reason IS NULL THEN 'verified_posttraining' ELSE 'rejected_candidate' END AS quality_tier,
 CASE WHEN n % 11 = 0 THEN 'commits' WHEN n % 19 = 0 THEN 'description' WHEN n % 6 = 0 THEN 'fail_to_pass' WHEN n % 9 = 0 THEN 'pass_to_pass' END AS task_fault FROM x
""")
def repair_records(spark, d):
    """Candidate repairs as sample records, accepted or with the first reason against them."""
    return training_records.repair_records(_repairs(spark, d))


@register("recovery_rows", """
WITH l AS (SELECT doc_id AS n, quality FROM labels)
SELECT 'recovery-' || sha256('{"actions":["look","mend ' || n % 3 || '"],"diagnosis":"' || CASE WHEN n % 6 = 0 THEN ' ' ELSE 'd' || n END || '","environment_hash":"e","parent":"p' || n || '","test_hash":' || CASE WHEN n % 4 = 0 THEN 'null' ELSE '"t"' END || '}') AS sample_id,
 'p' || n AS parent_sample_id, 'typo' AS failure_type, CASE WHEN n % 6 = 0 THEN ' ' ELSE 'd' || n END AS diagnosis, quality = 1 AND n % 4 > 0 AS recovery_verified, quality = 1 AND n % 4 > 0 AS accepted,
 (n % 5)::BIGINT AS recurrence_count, n % 3 * 0.75 AS confidence_before_failure,
 CASE WHEN n % 6 = 0 THEN 'incomplete' WHEN n % 5 < 1 THEN 'recurrence_count' WHEN n % 3 * 0.75 > 1 THEN 'confidence' WHEN n % 14 = 0 THEN 'parent' END AS fault FROM l
""")
def recovery_rows(spark, d):
    """Recoveries of failures: identity, verification and the first fault."""
    n = F.col("doc_id")
    parent = F.concat(F.lit("p"), n.cast("string"))
    rows = table(spark, d, "labels").select(
        parent.alias("parent_sample_id"), F.when(n % 14 == 0, "other").otherwise(parent).alias("sample_id"), F.lit("typo").alias("failure_type"), (n % 5).alias("recurrence_count"), ((n % 3) * 0.75).cast("double").alias("confidence"),
        F.when(n % 6 == 0, " ").otherwise(F.concat(F.lit("d"), n.cast("string"))).alias("diagnosis"), F.array(F.lit("look"), F.concat(F.lit("mend "), (n % 3).cast("string"))).alias("actions"), F.lit("done").alias("final_result"),
        F.lit("teacher").alias("recovery_source"), F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("status"), F.lit(2).alias("passed"), F.when(n % 4 > 0, "t").alias("test_hash"), F.lit("e").alias("environment_hash"),
    )
    return training_records.recovery_rows(rows)


@register("token_weights")
def token_weights(spark, d):
    """Conversations serialised with a weight for each token; only what the assistant says is a target."""
    turns = table(spark, d, "conversations").withColumn("type", F.when(F.col("role") == "assistant", "ACTION").otherwise("OBSERVATION"))
    event = F.struct("turn", "type", F.col("text").alias("content"), F.lit(1.0).alias("loss_mask"), F.lit(1.0).alias("target_weight"), (F.col("turn") % 5 == 3).alias("known_bad"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(event)).alias("events")).withColumn("head", F.lit("go on"))
    made = training_records.token_weights(rows, "conv_id", "head", "events", TOKENIZER, 0, 0)
    return made.select("conv_id", F.size("ids").alias("n_ids"), "n_targets", F.aggregate("weights", F.lit(0.0), lambda a, w: a + w).alias("weight"))


@register("tokenizer_report")
def tokenizer_report(spark, d):
    """What a public vocabulary makes of each language."""
    return training_records.tokenizer_report(table(spark, d, "documents"), "lang", "text", TOKENIZER)


@register("trace_validity", """
SELECT CASE WHEN event_id % 9 = 0 THEN false WHEN event_id % 7 = 0 THEN false WHEN event_id % 5 = 0 THEN false ELSE true END AS valid, count(*) AS n FROM events GROUP BY 1
""")
def trace_validity(spark, d):
    """Routing records with a token, layers named by digits and no negative expert."""
    n = F.col("event_id")
    layers = F.create_map(F.when(n % 7 == 0, "l0").otherwise("0"), F.array(F.col("user_id"), F.when(n % 5 == 0, F.lit(-1).cast("long")).otherwise(n)))
    rows = table(spark, d, "events").select(F.when(n % 9 > 0, n).alias("token"), layers.alias("layers"))
    return rows.groupBy(training_records.trace_valid(F.col("token"), F.col("layers")).alias("valid")).agg(F.count("*").alias("n"))


@register("first_definitions", """
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 1 + doc_id % 3 END::INT AS line, CASE WHEN doc_id % 4 = 3 THEN 'no_definition' ELSE 'complete' END AS status FROM documents
""")
def first_definitions(spark, d):
    """The first function of a name in code that may break off."""
    n = F.col("doc_id")
    name = F.when(n % 4 == 3, "g").otherwise("f")
    code = F.concat(F.repeat(F.lit("x = 1\n"), (n % 3).cast("int")), F.lit("def "), name, F.lit("(a):\n    return a\n"), F.when(n % 2 == 0, "def f(b):\n    return (").otherwise("y = 2\n"))
    made = table(spark, d, "documents").select("doc_id", training_records.first_definition(code, F.when(n % 4 == 3, "other").otherwise("f")).alias("x"))
    return made.select("doc_id", "x.line", "x.status")


@register("strongest_biases", """
WITH c AS (SELECT event_type, user_id % 10 AS e, count(*) AS n FROM events GROUP BY ALL),
x AS (SELECT event_type, e, n, (n / sum(n) OVER (PARTITION BY event_type)) / (sum(n) OVER (PARTITION BY e) / sum(n) OVER ()) AS r FROM c),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY r DESC, e) = 1)
SELECT event_type, e, round(r, 6) AS enrichment FROM b WHERE n >= 10 ORDER BY r DESC, event_type LIMIT 6
""")
def strongest_biases(spark, d):
    """The expert that each category prefers most, for the six strongest preferences with enough evidence."""
    from sievelake.operators import routing

    slots = table(spark, d, "events").withColumn("e", F.col("user_id") % 10)
    best = routing.enrichment(slots, "event_type", "e").groupBy("event_type").agg(F.max_by(F.struct("e", "enrichment"), F.struct("enrichment", -F.col("e"))).alias("b"))
    counts = slots.groupBy("event_type", "e").agg(F.count("*").alias("n"))
    rows = best.select("event_type", "b.e", "b.enrichment").join(counts, ["event_type", "e"]).filter("n >= 10")
    return rows.orderBy(F.desc("enrichment"), "event_type").limit(6).select("event_type", "e", F.round("enrichment", 6).alias("enrichment"))


@register("verified_shards", "SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1")
def verified_shards(spark, d):
    """Records of shards whose digests and numbers of records are those of a manifest."""
    docs = table(spark, d, "documents").select("lang", "doc_id", F.to_json(F.struct("doc_id", "lang")).alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    shards = docs.groupBy(F.col("lang").alias("path")).agg(F.encode(body, "utf-8").alias("content"), F.count("*").alias("records"))
    manifest = shards.select("path", F.sha2("content", 256).alias("sha256"), "records")
    rows = readers.verified_shards(shards.select("path", "content"), manifest, "doc_id long, lang string")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
