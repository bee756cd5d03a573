"""Queries over streams, each held against its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.operators import evalstats
from sievelake.plans.text_queries import NORMAL
from sievelake.registry import register
from sievelake.session import table
from sievelake.sources import readers, writers
from sievelake.streaming import streams


@register("streaming_dedup", f"SELECT count(DISTINCT sha256({NORMAL})) AS n_texts FROM documents")
def streaming_dedup(spark, d):
    """Distinct normalised texts of a stream of files."""
    made = streams.drain(streams.streaming_dedup(streams.folder_stream(spark, f"{d}/documents.parquet"), "text").select("digest"))
    return made.agg(F.count("*").alias("n_texts"))


@register("streaming_window_30s", """
SELECT time_bucket(INTERVAL '30 seconds', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2
""")
def streaming_window_30s(spark, d):
    """Counts and means of half minutes."""
    made = streams.drain(streams.sampled_windows(streams.folder_stream(spark, f"{d}/events.parquet"), "ts"), "update", lambda m: evalstats.latest(m, ["start", "event_type"], "batch"))
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@register("streaming_quality", "SELECT event_type, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1")
def streaming_quality(spark, d):
    made = streams.drain(streams.running_quality(streams.folder_stream(spark, f"{d}/events.parquet")), "update", lambda m: evalstats.latest(m, ["event_type"], "batch"))
    return made.select("event_type", F.round("total", 4).alias("total"), "n")


@register("streaming_collapse", """
WITH r AS (SELECT user_id, event_id, value < 10 AS low, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, value < 10 ORDER BY event_id) AS g FROM events),
c AS (SELECT user_id, CASE WHEN low THEN count(*) ELSE 0 END AS n FROM r GROUP BY user_id, low, g)
SELECT user_id, max(n)::INT AS longest, max(n) >= 3 AS collapsed FROM c GROUP BY 1
""")
def streaming_collapse(spark, d):
    """Longest runs of low values by user, kept as state."""
    return streams.drain(streams.collapse_signals(streams.folder_stream(spark, f"{d}/events.parquet"), 10.0, 3), "update", lambda m: evalstats.latest(m, ["user_id"], "batch").drop("batch"))


@register("streaming_leases")
def streaming_leases(spark, d):
    """Tasks after all lease and completion events of a stream; leases end by timers of event time."""
    events = streams.folder_stream(spark, f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "purchase", "complete").otherwise("lease")
    rows = events.select((F.col("event_id") % 97).alias("task"), F.col("ts").alias("at"), F.col("event_id").alias("event"), kind.alias("kind"), (F.col("user_id") % 3).cast("string").alias("owner"))
    last = F.struct("batch", "change")
    made = streams.drain(streams.lease_timers(rows, 3600.0), "update", lambda m: m.groupBy("task").agg(*[F.max_by(c, last).alias(c) for c in ("status", "owner", "n_leases")]))
    return made.select("task", "status", "owner", "n_leases")


@register("resumed_reader", "SELECT doc_id FROM documents WHERE doc_id >= 37 ORDER BY doc_id LIMIT 25")
def resumed_reader(spark, d):
    return streams.after_cursor(table(spark, d, "documents").select("doc_id"), "doc_id", 37, 25)


@register("json_field_harvest", """
SELECT event_id, 'k' AS label, (props->>'$.k') AS value FROM events UNION ALL SELECT event_id, 'note', 'n' || user_id FROM events
""")
def json_field_harvest(spark, d):
    """Strings under given names at any depth of JSON."""
    k = F.get_json_object("props", "$.k")
    made = F.concat(F.lit('{"a": [{"note": "n'), F.col("user_id"), F.lit('"}], "b": {"c": {"k": "'), k, F.lit('"}}, "k": 5}'))
    return readers.json_fields(table(spark, d, "events").select("event_id", made.alias("body")), "event_id", "body", ["note", "k"])


@register("byte_range_fetch", "SELECT doc_id, sha256(encode(text)[5:14]) AS part_sha256 FROM documents WHERE octet_length(encode(text)) >= 14")
def byte_range_fetch(spark, d):
    """Bytes of objects, by digest, offset and length."""
    docs = table(spark, d, "documents").filter(F.octet_length("text") >= 14).select("doc_id", F.encode("text", "utf-8").alias("content"))
    objects = docs.select(F.sha2("content", 256).alias("key"), "content").dropDuplicates(["key"])
    ranges = docs.select("doc_id", F.sha2("content", 256).alias("key"), F.lit(4).alias("byte_offset"), F.lit(10).alias("byte_length"))
    return readers.byte_ranges(readers.verified_objects(objects, ranges.select("key").distinct()), ranges).select("doc_id", F.sha2("part", 256).alias("part_sha256"))


@register("export_check", f"""
SELECT count(*) AS n, true AS complete, count(*) FILTER (WHERE doc_id % 50 = 0) AS bad_headers, 0::BIGINT AS bad_raw, count(*) FILTER (WHERE sha256(text) <> sha256({NORMAL})) AS bad_normalized,
 sha256(string_agg(lpad(doc_id::VARCHAR, 9, '0') || chr(0) || sha256(text), chr(10) ORDER BY doc_id)) AS inventory FROM documents
""")
def export_check(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("repository"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("file_path"), F.col("text").alias("body"), "doc_id")
    head = F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.concat(F.lit("<repo>"), "repository", F.lit("<file>"), "file_path", F.lit("\n")))
    rows = docs.withColumns({"text": F.concat(head, "body"), "raw_sha256": F.sha2("body", 256), "normalized_sha256": F.sha2("body", 256)})
    return readers.export_check(rows, table(spark, d, "documents").count())


@register("object_references", "SELECT sha256(text) AS key, octet_length(encode(text))::INT AS size, false AS payload_retained FROM documents")
def object_references(spark, d):
    return writers.references(table(spark, d, "documents").select(F.encode("text", "utf-8").alias("content")))


@register("synthetic_mixture")
def synthetic_mixture(spark, d):
    return readers.synthetic(spark, 1000, 7).groupBy("kind").agg(F.count("*").alias("n"))
