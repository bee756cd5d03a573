"""Queries that write files to the shared folder and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievelake.operators import dedup
from sievelake.registry import register
from sievelake.session import table, work_dir
from sievelake.sources import readers, writers
from sievelake.streaming import streams


def _folder(spark, name):
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("tolerant_json_lines", "SELECT doc_id, lang FROM documents")
def tolerant_json_lines(spark, d):
    """Records of JSON lines among which some are broken or blank."""
    path = _folder(spark, "lines")
    docs = table(spark, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang")).alias("value"))
    broken = docs.filter("doc_id % 50 = 0").select(F.concat(F.substring("value", 1, 9), F.lit("\n")).alias("value"))
    docs.select("value").union(broken).write.text(path)
    return readers.json_lines(spark, path, "doc_id long, lang string", tolerant=True)


@register("strict_json_lines", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def strict_json_lines(spark, d):
    """Records of JSON lines written once."""
    path = _folder(spark, "strict")
    writers.write_once(table(spark, d, "documents").select("doc_id", "lang"), path)
    return readers.json_lines(spark, path, "doc_id long, lang string").groupBy("lang").agg(F.count("*").alias("n"))


@register("bounded_json_scan", "SELECT source, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY 1")
def bounded_json_scan(spark, d):
    """Records with provenance and an allowed licence, within a budget of bytes."""
    path = _folder(spark, "bounded")
    docs = table(spark, d, "documents")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    writers.write_once(docs.select("source", F.lit("u").alias("source_url"), F.lit("r").alias("revision"), F.lit("MIT").alias("license"), "text"), path)
    return readers.bounded_json(spark, path, size).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@register("durable_log", "SELECT doc_id, lang, true AS done FROM documents UNION ALL SELECT NULL, lang, false FROM (SELECT DISTINCT lang FROM documents)")
def durable_log(spark, d):
    """Finished records of logs, and the logs whose last line is cut."""
    path = _folder(spark, "log")
    docs = table(spark, d, "documents").select("lang", "doc_id", F.to_json(F.struct("doc_id", "lang")).alias("line"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"]), "\n")
    logs = docs.groupBy("lang").agg(F.concat(whole, F.lit("\n"), F.lit('{"cut')).alias("value"))
    logs.write.option("lineSep", "\u0000").partitionBy("lang").text(path)
    done, pending = readers.durable_json(spark, f"{path}/*", "doc_id long, lang string")
    pending = pending.select(F.lit(None).cast("long").alias("doc_id"), F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"), F.lit(False).alias("done"))
    return done.select("doc_id", "lang", F.lit(True).alias("done")).union(pending)


@register("csv_roundtrip", "SELECT doc_id::VARCHAR AS doc_id, lang, source, n_chars::VARCHAR AS n_chars FROM documents")
def csv_roundtrip(spark, d):
    path = _folder(spark, "csv")
    writers.wide_csv(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), path)
    return readers.csv_rows(spark, path)


@register("junit_scan", "SELECT count(*) AS tests, sum(n // 7)::BIGINT AS failures, sum(n % 3)::BIGINT AS errors FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def junit_scan(spark, d):
    """Totals over the suites of test reports."""
    path = _folder(spark, "junit")
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    suite = F.format_string('<testsuite tests="1" failures="%d" errors="%d"></testsuite>', F.floor(F.col("n") / 7), F.col("n") % 3)
    # One report file for each source, as a test run writes them.
    report = F.concat(F.lit("<testsuites>"), suite, F.lit("</testsuites>"))
    counts.select("source", report.alias("value")).write.partitionBy("source").text(path)
    return readers.junit_totals(spark, path)


@register("binary_traces", "SELECT event_id % 4 AS layer, count(*) AS n, sum(event_id % 97)::BIGINT AS tokens, sum(user_id % 6)::BIGINT AS first_experts FROM events GROUP BY 1")
def binary_traces(spark, d):
    """Dispatches of binary routing traces, one file for each kind of event."""
    word = lambda c: F.reverse(F.lpad(F.hex(c.cast("long")), 8, "0"))
    swapped = lambda c: F.regexp_replace(word(c), "(.)(.)", "$2$1")
    row = F.concat(swapped(F.col("event_id") % 4), swapped(F.col("event_id") % 97), swapped(F.col("user_id") % 6), swapped(F.col("user_id") % 5), F.lit("0000403f"), F.lit("0000803e"))
    events = table(spark, d, "events").select((F.col("event_id") % 64).alias("file"), "event_id", row.alias("row"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "row"))), lambda x: x["row"]), "")
    files = events.groupBy("file").agg(F.unhex(joined).alias("content")).select(F.col("file").cast("string").alias("path"), "content")
    rows = readers.traces(files, 2).filter((F.element_at("weights", 1) == 0.75) & (F.element_at("weights", 2) == 0.25))
    return rows.groupBy(F.col("layer").cast("long").alias("layer")).agg(F.count("*").alias("n"), F.sum("token").alias("tokens"), F.sum(F.element_at("experts", 1)).alias("first_experts"))


@register("sinks_roundtrip", """
WITH f AS (SELECT count(*) AS n, sum(doc_id)::BIGINT AS s FROM documents), t AS (SELECT count(DISTINCT sha256(text)) AS n FROM documents)
SELECT sink, n, s FROM f, (VALUES ('manifest'), ('partitions'), ('replaced'), ('shards')) v(sink) UNION ALL SELECT 'objects', n, 0 FROM t
""")
def sinks_roundtrip(spark, d):
    """What comes back from each kind of writer."""
    docs, base = table(spark, d, "documents").select("doc_id", "lang", "text"), _folder(spark, "sinks")
    ids = docs.select("doc_id", "lang")
    writers.sorted_manifest(ids, "doc_id", f"{base}/manifest")
    writers.spill_partitions(ids, f"{base}/partitions", ["lang"])
    writers.replace(ids.limit(1), f"{base}/replaced")
    writers.replace(ids, f"{base}/replaced")
    writers.record_shards(ids, f"{base}/shards", 100)
    contents = docs.select(F.encode("text", "utf-8").alias("content"))
    added = [writers.put_objects(contents, f"{base}/objects") for _ in range(2)]
    read = {"manifest": spark.read.json(f"{base}/manifest"), "partitions": spark.read.parquet(f"{base}/partitions"), "replaced": spark.read.parquet(f"{base}/replaced"), "shards": spark.read.json(f"{base}/shards")}
    rows = [frame.agg(F.lit(name).alias("sink"), F.count("*").alias("n"), F.sum("doc_id").cast("long").alias("s")) for name, frame in read.items()]
    objects = readers.verified_objects(spark.read.parquet(f"{base}/objects"), spark.read.parquet(f"{base}/objects").select("key"))
    rows.append(objects.agg(F.lit("objects").alias("sink"), F.count("content").alias("n"), F.lit(added[1]).cast("long").alias("s")))
    return dedup.union_all(rows)


@register("union_in_order", """
WITH u AS (SELECT 0 AS source_ordinal, doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents UNION ALL SELECT 1, item_id, row_number() OVER (ORDER BY item_id) - 1 FROM benchmark) SELECT * FROM u
""")
def union_in_order(spark, d):
    """Two sources one after the other, with each row's place."""
    return dedup.union_in_order([table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "benchmark").select(F.col("item_id").alias("id"))], ["id", "id"])


def _segments(spark, d):
    """Logs of documents, one for each source, whose last line is cut."""
    path = _folder(spark, "segments")
    docs = table(spark, d, "documents").select("source", "doc_id", F.to_json(F.struct("doc_id", "lang")).alias("line"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"]), "\n")
    docs.groupBy("source").agg(F.concat(whole, F.lit("\n"), F.lit('{"cut')).alias("value")).repartition(4, "source").write.option("lineSep", "\u0000").partitionBy("source").text(path)
    return path


@register("streaming_log", "SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1")
def streaming_log(spark, d):
    """Finished records of a stream of log segments."""
    stream = streams.durable_records(streams.log_stream(spark, f"{_segments(spark, d)}/*", 8), "doc_id long, lang string")
    return streams.drain(stream).groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@register("line_ingest", "SELECT doc_id, lang FROM documents WHERE doc_id % 40 < 25")
def line_ingest(spark, d):
    """Lines of each file up to the first that is too long: the 26th of forty."""
    n = F.col("doc_id")
    docs = table(spark, d, "documents").select(F.floor(n / 40).alias("path"), "doc_id", F.to_json(F.struct("doc_id", "lang", F.when(n % 40 == 25, F.repeat(F.lit("x"), 2000)).alias("pad"))).alias("line"))
    body = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"]), "\n"), F.lit("\n"))
    lines = readers.ingested_lines(docs.groupBy("path").agg(body.alias("body")), 1000)
    return lines.select(F.from_json("json", "doc_id long, lang string").alias("r")).select("r.*")


@register("resumed_shards", """
SELECT n AS first, 0::BIGINT AS again, total - n AS rest, total AS n_read FROM (SELECT count(*) FILTER (WHERE doc_id % 3 = 0) AS n, count(*) AS total FROM documents)
""")
def resumed_shards(spark, d):
    """What three runs of a writer add: a part, the same part, everything."""
    path, docs = _folder(spark, "resumed"), table(spark, d, "documents").select("doc_id", "lang")
    added = [writers.resumed_shards(rows, path, "doc_id", 100) for rows in (docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 = 0"), docs)]
    return spark.read.json(path).agg(*[F.lit(n).cast("long").alias(name) for name, n in zip(("first", "again", "rest"), added)], F.count_distinct("doc_id").alias("n_read"))
