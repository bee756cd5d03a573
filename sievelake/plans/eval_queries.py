"""Queries over evaluation, routing and replay operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievelake.functions import hashing, text
from sievelake.operators import dedup, digests, evalstats, routing, simulate
from sievelake.plans.text_queries import LEXEMES
from sievelake.registry import register
from sievelake.session import table


def labelled(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")


LABELLED = "l AS (SELECT l.*, d.source, d.lang, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


@register("pass_at_k", f"""
WITH {LABELLED}, t AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS c FROM l GROUP BY 1)
SELECT round(avg(1 - greatest(n - c, 0) / n * greatest(n - c - 1, 0) / (n - 1)) FILTER (WHERE n >= 2), 9) AS pass_at_k, count(*) FILTER (WHERE n >= 2) AS n_tasks, count(*) FILTER (WHERE n < 2) AS n_excluded FROM t
""")
def pass_at_k(spark, d):
    return evalstats.pass_at_k(labelled(spark, d), "source", (F.col("quality") == 1) & (F.col("toxic") == 0), 2).withColumn("pass_at_k", F.round("pass_at_k", 9))


@register("grouping_rollup", f"""
WITH {LABELLED} SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS n_correct, count(*) FILTER (WHERE quality = 1) / count(*) AS accuracy FROM l GROUP BY GROUPING SETS ((lang), (lang, source))
""")
def grouping_rollup(spark, d):
    return evalstats.rollup(labelled(spark, d), ["lang"], "source", F.col("quality") == 1)


@register("completion_summary", f"""
WITH {LABELLED} SELECT lang, count(*) AS n, round(avg(quality), 9) AS accuracy, round(avg(toxic), 9) AS repetition_rate, count(*) FILTER (WHERE n_chars > 3000) AS n_truncated,
 CASE WHEN count(*) FILTER (WHERE n_chars > 9000000) > 0 THEN 1.0 END AS rate_of_none FROM l GROUP BY 1
""")
def completion_summary(spark, d):
    """Rates by group; null where nothing was counted."""
    long = F.count_if(F.col("n_chars") > 9_000_000)
    return labelled(spark, d).groupBy("lang").agg(
        F.count("*").alias("n"), F.round(F.avg("quality"), 9).alias("accuracy"), F.round(F.avg("toxic"), 9).alias("repetition_rate"), F.count_if(F.col("n_chars") > 3000).alias("n_truncated"),
        F.try_divide(long.cast("double"), long).alias("rate_of_none"),
    )


@register("paired_weighted_delta", """
WITH p AS (SELECT (l.quality + l.toxic * 0.5)::DOUBLE AS b, (d.n_chars % 7)::DOUBLE / 7 AS a, d.n_chars::DOUBLE AS w FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
s AS (SELECT count(*) AS n, sum(w) AS sw, sum(w * w) AS sw2, sum(w * (b - a)) AS sx, sum(w * (b - a) * (b - a)) AS sx2 FROM p),
m AS (SELECT n, sx / sw AS delta, sqrt(greatest(sx2 / sw - (sx / sw) * (sx / sw), 0) / greatest(sw * sw / sw2 - 1, 1)) AS se FROM s)
SELECT n, round(delta, 6) AS delta, round(se, 6) AS se, round(delta - 1.96 * se, 6) AS low, round(delta + 1.96 * se, 6) AS high FROM m
""")
def paired_weighted_delta(spark, d):
    docs = table(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 7).cast("double") / 7).alias("loss"), F.col("n_chars").cast("double").alias("w"))
    scored = table(spark, d, "labels").select("doc_id", (F.col("quality") + F.col("toxic") * 0.5).alias("loss"), F.lit(1.0).alias("w"))
    out = evalstats.paired_delta(docs, scored, "doc_id", "loss", "w")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("delta", "se", "low", "high")])


@register("cluster_bootstrap")
def cluster_bootstrap(spark, d):
    """Mean quality over resampled sources, from hashed draws."""
    clusters = labelled(spark, d).groupBy("source").agg(F.sum(F.col("quality") * F.col("n_chars")).alias("v"), F.sum("n_chars").alias("w"))
    return evalstats.cluster_bootstrap(clusters, "source", "v", "w", 500)


@register("paired_outcomes", """
WITH p AS (SELECT quality = 1 AS a, (doc_id + toxic) % 3 > 0 AS b FROM labels)
SELECT CASE WHEN a AND b THEN 'retained' WHEN b THEN 'gained' WHEN a THEN 'lost' ELSE 'remained_wrong' END AS kind, count(*) AS n FROM p GROUP BY 1
""")
def paired_outcomes(spark, d):
    kind = evalstats.transition_kind(F.col("quality") == 1, (F.col("doc_id") + F.col("toxic")) % 3 > 0)
    return table(spark, d, "labels").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@register("unpaired_rows", """
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'left' ELSE 'right' END AS missing_in FROM (SELECT doc_id FROM documents WHERE doc_id % 3 > 0) a FULL JOIN (SELECT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL
""")
def unpaired_rows(spark, d):
    return evalstats.full_pairs(table(spark, d, "documents").filter("doc_id % 3 > 0"), table(spark, d, "labels"), ["doc_id"])


@register("matrix_completeness", """
WITH o AS (SELECT DISTINCT event_type AS kind, user_id % 12 AS slot FROM events WHERE event_id % 7 = 0), g AS (SELECT kind, slot FROM (SELECT unnest(['view', 'click', 'error', 'refund']) AS kind), (SELECT unnest(range(0, 10)) AS slot))
SELECT 'missing' AS side, * FROM (SELECT * FROM g EXCEPT SELECT * FROM o) UNION ALL SELECT 'unexpected', * FROM (SELECT * FROM o EXCEPT SELECT * FROM g)
""")
def matrix_completeness(spark, d):
    seen = table(spark, d, "events").filter("event_id % 7 = 0").select(F.col("event_type").alias("kind"), (F.col("user_id") % 12).alias("slot"))
    kinds = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("view", "click", "error", "refund")])).alias("kind"))
    return evalstats.matrix_gaps(seen, [kinds, spark.range(10).withColumnRenamed("id", "slot")])


@register("review_join", """
SELECT d.source, count(*) AS candidates, count(l.doc_id) AS reviewed, count(*) FILTER (WHERE l.quality = 1) AS accepted, count(*) FILTER (WHERE l.doc_id IS NULL) AS pending FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1
""")
def review_join(spark, d):
    """Reviews, pending candidates (anti join) and accepted ones (semi join)."""
    docs, reviews = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id", "quality")
    count = lambda frame, name: frame.groupBy("source").agg(F.count("*").alias(name))
    out = count(docs, "candidates")
    for frame, name in ((docs.join(reviews, "doc_id", "left_semi"), "reviewed"), (docs.join(reviews.filter("quality = 1"), "doc_id", "left_semi"), "accepted"), (docs.join(reviews, "doc_id", "left_anti"), "pending")):
        out = out.join(count(frame, name), "source", "left")
    return out.na.fill(0)


@register("lower_percentiles", """
WITH v AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS r, count(*) OVER () AS t FROM events), a AS (SELECT unnest([0.5, 0.9, 0.99])::DOUBLE AS share)
SELECT share, user_id AS value FROM a JOIN v ON r = floor((t - 1) * share)
""")
def lower_percentiles(spark, d):
    return evalstats.lower_percentiles(table(spark, d, "events"), "user_id", [0.5, 0.9, 0.99])


@register("efficiency_summary", """
WITH v AS (SELECT CASE WHEN event_id % 50 = 0 THEN 'nan'::DOUBLE ELSE value END AS value, user_id::DOUBLE AS user_id, NULL::DOUBLE AS nothing FROM events),
u AS (SELECT 'value' AS field, value AS v FROM v UNION ALL SELECT 'user_id', user_id FROM v UNION ALL SELECT 'nothing', nothing FROM v)
SELECT field, count(*) FILTER (WHERE isfinite(v)) AS observed_count, round(sum(v) FILTER (WHERE isfinite(v)), 4) AS sum, max(v) FILTER (WHERE isfinite(v)) AS max FROM u GROUP BY 1
""")
def efficiency_summary(spark, d):
    rows = table(spark, d, "events").select(F.when(F.col("event_id") % 50 == 0, float("nan")).otherwise(F.col("value")).alias("value"), "user_id", F.lit(None).cast("double").alias("nothing"))
    return evalstats.finite_summary(rows, ["value", "user_id", "nothing"]).withColumn("sum", F.round("sum", 4))


@register("numeric_parity", """
WITH p AS (SELECT l_extendedprice AS a, l_extendedprice * (1 + l_discount / 1000) AS b FROM lineitem)
SELECT round(max(abs(a - b)), 6) AS max_abs, round(avg(abs(a - b)), 6) AS mean_abs, round(sqrt(sum((a - b) * (a - b)) / greatest(sum(a * a), 1e-24)), 9) AS relative_l2 FROM p
""")
def numeric_parity(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 + F.col("l_discount") / 1000)).alias("b"))
    return evalstats.parity(rows, "a", "b").select(F.round("max_abs", 6).alias("max_abs"), F.round("mean_abs", 6).alias("mean_abs"), F.round("relative_l2", 9).alias("relative_l2"))


@register("ablation_deltas", """
SELECT a.event_type AS metric, round(b.v - a.v, 6) AS delta FROM (SELECT event_type, avg(value) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1) a JOIN (SELECT event_type, avg(value) AS v FROM events WHERE user_id % 2 = 1 GROUP BY 1) b ON a.event_type = b.event_type
""")
def ablation_deltas(spark, d):
    half = lambda r: table(spark, d, "events").filter(F.col("user_id") % 2 == r).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("v"))
    return evalstats.ablation_deltas(half(0), half(1), "metric", "v").withColumn("delta", F.round("delta", 6))


@register("trend_shapes", """
WITH s AS (SELECT event_type, date_part('hour', ts) // 6 AS h, count(*)::DOUBLE AS v FROM events GROUP BY ALL), x AS (SELECT *, v - lag(v) OVER (PARTITION BY event_type ORDER BY h) AS d FROM s)
SELECT event_type, CASE WHEN max(abs(d)) < 0.001 THEN 'stable' WHEN bool_and(d >= 0) THEN 'increasing' WHEN bool_and(d <= 0) THEN 'decreasing' ELSE 'non_monotone' END AS trend FROM x GROUP BY 1
""")
def trend_shapes(spark, d):
    rows = table(spark, d, "events").groupBy("event_type", F.floor(F.hour("ts") / 6).alias("h")).agg(F.count("*").cast("double").alias("v"))
    return evalstats.trend(rows, "event_type", "h", "v")


@register("best_safe_setting", """
SELECT arg_max(l_shipmode, {'s': s, 'k': l_shipmode}) AS l_shipmode, max(s) AS s FROM (SELECT l_linenumber::VARCHAR AS l_shipmode, round(avg(l_extendedprice), 6) AS s, count(*) AS n FROM lineitem GROUP BY 1) WHERE n > 100
""")
def best_safe_setting(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("string").alias("l_shipmode")).agg(F.round(F.avg("l_extendedprice"), 6).alias("s"), F.count("*").alias("n"))
    return evalstats.best_safe(rows, "l_shipmode", "s", F.col("n") > 100)


@register("latest_metric_per_key", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def latest_metric_per_key(spark, d):
    return evalstats.latest(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


@register("moving_average_21", """
SELECT event_id, round(a, 6) AS average FROM (SELECT event_id, avg(value) OVER w AS a, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) WHERE n = 21
""")
def moving_average_21(spark, d):
    return evalstats.moving_average(table(spark, d, "events"), "event_type", "event_id", "value", 21).select("event_id", F.round("average", 6).alias("average"))


@register("log_window_rates", """
SELECT event_id, round((value - lag(value) OVER w) / nullif(epoch(ts - lag(ts) OVER w), 0), 6) + 0.0 AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
""")
def log_window_rates(spark, d):
    """Change of a counter over the seconds since the row before."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)) / 1e6
    return table(spark, d, "events").select("event_id", (F.round(F.try_divide(F.col("value") - F.lag("value").over(w), F.nullif(seconds, F.lit(0.0))), 6) + 0.0).alias("rate"))


@register("weighted_loss", """
SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS loss, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 9) AS share FROM lineitem GROUP BY 1
""")
def weighted_loss(spark, d):
    """Token-weighted means and mixture shares."""
    rows = table(spark, d, "lineitem").groupBy("l_returnflag").agg((F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")).alias("loss"), F.sum("l_quantity").alias("q"))
    return rows.select("l_returnflag", F.round("loss", 9).alias("loss"), F.round(F.col("q") / F.sum("q").over(Window.partitionBy()), 9).alias("share"))


@register("source_inventory", "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())")
def source_inventory(spark, d):
    docs = table(spark, d, "documents")
    sets = [["source", "lang"], ["source"], ["lang"], []]
    return docs.groupingSets([[F.col(c) for c in s] for s in sets], F.col("source"), F.col("lang")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@register("ordered_fingerprint", "SELECT lang, sha256(string_agg(doc_id || chr(0) || sha256(text), chr(10) ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY 1")
def ordered_fingerprint(spark, d):
    """A digest of ids and text digests, in order of id."""
    rows = table(spark, d, "documents").select("lang", "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("\0"), F.sha2("text", 256)).alias("line"))
    return digests.ordered_digest(rows, ["lang"], "doc_id", F.col("line")).withColumnRenamed("digest", "fingerprint")


@register("microbench", """
SELECT l_shipdate::DATE AS day, round(sum(l_quantity) / sum(l_tax + 1), 6) AS rate, round(max(l_quantity) - min(l_quantity), 6) AS spread, median(l_quantity) AS median FROM lineitem GROUP BY 1
""")
def microbench(spark, d):
    return table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_quantity") / F.sum(F.col("l_tax") + 1), 6).alias("rate"), F.round(F.max("l_quantity") - F.min("l_quantity"), 6).alias("spread"), F.median("l_quantity").alias("median"))


@register("histogram_bins", "SELECT event_type, least(greatest(floor(value / 10), 0), 9)::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL")
def histogram_bins(spark, d):
    return table(spark, d, "events").groupBy("event_type", routing.histogram_bin(F.col("value"), 0.0, 100.0, 10).alias("bin")).agg(F.count("*").alias("n"))


@register("ledger_upsert", """
WITH o AS (SELECT doc_id, quality FROM labels WHERE doc_id % 2 = 0), n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels WHERE doc_id % 3 = 0)
SELECT count(*) AS n, sum(coalesce(o.quality, n.quality))::BIGINT AS total, count(*) FILTER (WHERE o.quality <> n.quality) AS n_conflicts FROM o FULL JOIN n ON o.doc_id = n.doc_id
""")
def ledger_upsert(spark, d):
    """What the ledger has stays; values that conflict are told."""
    rows = table(spark, d, "labels").select("doc_id", "quality")
    new = rows.filter("doc_id % 3 = 0").withColumn("quality", F.when(F.col("doc_id") % 10 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    merged, conflicts = evalstats.ledger_upsert(rows.filter("doc_id % 2 = 0"), new, ["doc_id"], "quality")
    return merged.agg(F.count("*").alias("n"), F.sum("quality").alias("total")).crossJoin(conflicts.agg(F.count("*").alias("n_conflicts")))


@register("role_transitions", """
WITH t AS (SELECT role AS a, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT a, b, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY 1, 2
""")
def role_transitions(spark, d):
    return routing.transition_counts(table(spark, d, "conversations"), ["conv_id"], ["turn"], "role")


@register("role_run_lengths", """
WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS x FROM events),
r AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c), l AS (SELECT user_id, run, event_type AS state, count(*) AS length FROM r GROUP BY ALL)
SELECT state, length, count(*) AS n FROM l GROUP BY 1, 2
""")
def role_run_lengths(spark, d):
    return routing.run_lengths(table(spark, d, "events"), ["user_id"], ["event_id"], "event_type").groupBy("state", "length").agg(F.count("*").alias("n"))


@register("local_entropy", """
WITH t AS (SELECT user_id % 8 AS g, event_type AS a, lead(event_type) OVER w AS b, row_number() OVER w - 1 AS t FROM events WINDOW w AS (PARTITION BY user_id % 8 ORDER BY event_id)),
c AS (SELECT g, t // 32 AS w, a, b, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY ALL), e AS (SELECT g, w, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS e FROM c GROUP BY 1, 2)
SELECT g, round(avg(e), 6) AS local_entropy FROM e GROUP BY 1
""")
def local_entropy(spark, d):
    rows = table(spark, d, "events").withColumn("g", F.col("user_id") % 8)
    return routing.local_entropy(rows, ["g"], ["event_id"], "event_type").withColumn("local_entropy", F.round("local_entropy", 6))


@register("expert_load", """
WITH c AS (SELECT event_type, user_id % 40 AS e, count(*) AS n FROM events WHERE user_id % 40 < 37 GROUP BY ALL),
s AS (SELECT event_type, sum(n) AS total, sum(n * n) AS sq, sum(n * ln(n)) AS nl, max(n) AS top, count(*) AS used FROM c GROUP BY 1)
SELECT event_type, total::BIGINT AS total, round(ln(total) - nl / total, 6) AS entropy, round(sqrt(sq / 40 - (total / 40) * (total / 40)) / (total / 40), 6) AS load_cv, round(top / total, 6) AS max_share, 40 - used AS unused FROM s
""")
def expert_load(spark, d):
    slots = table(spark, d, "events").withColumn("e", F.col("user_id") % 40).filter("e < 37")
    out = routing.load_statistics(slots, "event_type", "e", 40)
    return out.select("event_type", "total", *[F.round(c, 6).alias(c) for c in ("entropy", "load_cv", "max_share")], "unused")


@register("expert_enrichment", """
WITH c AS (SELECT event_type, user_id % 10 AS e, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, e, round((n / sum(n) OVER (PARTITION BY event_type)) / (sum(n) OVER (PARTITION BY e) / sum(n) OVER ()), 6) AS enrichment FROM c
""")
def expert_enrichment(spark, d):
    return routing.enrichment(table(spark, d, "events").withColumn("e", F.col("user_id") % 10), "event_type", "e").withColumn("enrichment", F.round("enrichment", 6))


@register("mutual_information", """
WITH c AS (SELECT event_type AS x, user_id % 10 AS y, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM c)
SELECT round(sum(n / t * log2(n * t / (nx * ny))), 9) AS bits FROM m
""")
def mutual_information(spark, d):
    return routing.mutual_information(table(spark, d, "events").withColumn("y", F.col("user_id") % 10), "event_type", "y").withColumn("bits", F.round("bits", 9))


@register("same_adjacency", """
WITH t AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events), s AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT round((SELECT count(*) FILTER (WHERE a = b) / count(*) FROM t WHERE b IS NOT NULL), 9) AS same, round((SELECT sum(n * n) / (sum(n) * sum(n)) FROM s), 9) AS baseline
""")
def same_adjacency(spark, d):
    out = routing.same_adjacency(table(spark, d, "events"), ["user_id"], ["event_id"], "event_type")
    return out.select(F.round("same", 9).alias("same"), F.round("baseline", 9).alias("baseline"))


@register("ngram_bucket_stats", f"""
WITH w AS (SELECT list_transform({LEXEMES}, lambda x: length(x)::BIGINT) AS t FROM conversations), o AS (SELECT unnest([2, 3]) AS ord),
g AS (SELECT ord, t, unnest(range(1, len(t) + 1)) AS i FROM w, o),
k AS (SELECT ord, CASE WHEN i >= 3 AND ord = 3 THEN t[i - 2] + 1 ELSE 0 END AS c, CASE WHEN i >= 2 THEN t[i - 1] + 1 ELSE 0 END AS b, t[i] + 1 AS a FROM g),
h AS (SELECT ord, c, b, a, CASE WHEN ord = 3 THEN ((((17 * 65599 + c) % 2147483647) * 65599 + b) % 2147483647 * 65599 + a) % 2147483647 ELSE (((17 * 65599 + b) % 2147483647) * 65599 + a) % 2147483647 END % 64 AS bucket FROM k),
p AS (SELECT ord, bucket, c, b, a, count(*) AS n FROM h GROUP BY ALL), q AS (SELECT ord, bucket, count(*) AS g, sum(n) AS n FROM p GROUP BY 1, 2)
SELECT ord, count(*) AS utilized_rows, sum(g)::BIGINT AS distinct_ngrams, (sum(g) - count(*))::BIGINT AS collisions, sum(n)::BIGINT AS lookups FROM q GROUP BY 1
""")
def ngram_bucket_stats(spark, d):
    """Rolling-hash buckets of token n-grams that reset with each text."""
    rows = table(spark, d, "conversations").select(F.transform(text.lexemes(F.col("text")), lambda x: F.length(x).cast("long")).alias("t"))
    rows = rows.filter(F.size("t") > 0).select("t", F.explode(F.sequence(F.lit(0), F.size("t") - 1)).alias("i"))
    grams = None
    for order in (2, 3):
        back = lambda k: F.when(F.col("i") >= k, F.try_element_at("t", F.col("i") - k + 1) + 1).otherwise(0)
        part = rows.select(F.lit(order).alias("ord"), hashing.rolling_hash(F.col("t"), F.col("i"), order, 64, 17).alias("bucket"), F.struct(back(0).alias("a"), back(1).alias("b"), (back(2) if order == 3 else F.lit(0)).cast("long").alias("c")).alias("gram"))
        grams = part if grams is None else grams.unionByName(part)
    return routing.ngram_statistics(grams, "ord", "bucket", "gram")


@register("horizon_targets", """
WITH t AS (SELECT conv_id, turn, lead(turn, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations) SELECT conv_id, count(h) AS n_targets, sum(h)::BIGINT AS target_sum FROM t GROUP BY 1
""")
def horizon_targets(spark, d):
    """Targets two steps ahead."""
    rows = table(spark, d, "conversations").withColumn("h", F.lead("turn", 2).over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.groupBy("conv_id").agg(F.count("h").alias("n_targets"), F.sum("h").alias("target_sum"))


def _traces(spark, d):
    e = F.col("user_id")
    return table(spark, d, "events").select("event_id", (e % 4).alias("sequence"), F.array(e % 6, (e + F.col("event_id")) % 6).alias("experts"))


@register("coactivation_edges", """
WITH t AS (SELECT event_id, user_id % 4 AS s, user_id % 6 AS x, (user_id + event_id) % 6 AS y FROM events), p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM t WINDOW w AS (PARTITION BY s ORDER BY event_id)),
e AS (SELECT least(x, y) AS a, greatest(x, y) AS b FROM t WHERE x <> y UNION ALL SELECT least(px, x), greatest(px, x) FROM p WHERE px <> x UNION ALL SELECT least(py, y), greatest(py, y) FROM p WHERE py <> y)
SELECT a, b, count(*) AS weight FROM e GROUP BY 1, 2
""")
def coactivation_edges(spark, d):
    return routing.coactivation(_traces(spark, d), "event_id", "experts")


@register("expert_pages")
def expert_pages(spark, d):
    """Pages of experts that are used together; six experts, so the packing runs on the driver."""
    rows = _traces(spark, d)
    load = rows.select(F.explode("experts").alias("expert")).groupBy("expert").agg(F.count("*").alias("n"))
    pages = routing.expert_pages(load, routing.coactivation(rows, "event_id", "experts"), 2)
    return spark.createDataFrame(sorted(pages.items()), "expert long, page int")


@register("prefetch_metrics", """
WITH t AS (SELECT list_distinct([user_id % 6, (user_id + 1) % 6]) AS want, list_distinct([event_id % 6, (event_id * 2) % 6]) AS got FROM events)
SELECT round(sum(len(list_intersect(want, got))) / sum(len(want)), 9) AS recall, round(sum(len(list_intersect(want, got))) / sum(len(got)), 9) AS precision FROM t
""")
def prefetch_metrics(spark, d):
    """Recall and precision of predicted sets."""
    u, e = F.col("user_id"), F.col("event_id")
    rows = table(spark, d, "events").select(F.array_distinct(F.array(u % 6, (u + 1) % 6)).alias("want"), F.array_distinct(F.array(e % 6, (e * 2) % 6)).alias("got"))
    both = F.sum(F.size(F.array_intersect("want", "got")))
    return rows.agg(F.round(both / F.sum(F.size("want")), 9).alias("recall"), F.round(both / F.sum(F.size("got")), 9).alias("precision"))


@register("router_top_k", """
WITH v AS (SELECT vec_id, unnest(embedding[1:8]) AS s, generate_subscripts(embedding[1:8], 1) - 1 AS e FROM embeddings), x AS (SELECT vec_id, e, exp(s::DOUBLE) AS s FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, e) AS r FROM x)
SELECT vec_id, e::INT AS expert, round(s / sum(s) OVER (PARTITION BY vec_id), 6) AS weight FROM r WHERE r <= 2
""")
def router_top_k(spark, d):
    scores = F.transform(F.slice("embedding", 1, 8), lambda s: F.exp(s.cast("double")))
    rows = table(spark, d, "embeddings").select("vec_id", F.explode(routing.router_top_k(scores, 2)).alias("x"))
    return rows.select("vec_id", "x.expert", F.round("x.weight", 6).alias("weight"))


@register("dispatch_slots", "SELECT event_id, user_id % 6 AS expert, row_number() OVER (PARTITION BY user_id % 6 ORDER BY event_id) - 1 AS slot FROM events")
def dispatch_slots(spark, d):
    slot = F.row_number().over(Window.partitionBy("expert").orderBy("event_id")) - 1
    return table(spark, d, "events").select("event_id", (F.col("user_id") % 6).alias("expert")).withColumn("slot", slot)


@register("nucleus_filter", """
WITH c AS (SELECT event_type AS k, user_id AS i, count(*)::DOUBLE AS n FROM events GROUP BY ALL), p AS (SELECT k, i, n / sum(n) OVER (PARTITION BY k) AS p FROM c),
r AS (SELECT *, row_number() OVER w AS r, sum(p) OVER (PARTITION BY k ORDER BY p DESC, i ROWS UNBOUNDED PRECEDING) - p AS b FROM p WINDOW w AS (PARTITION BY k ORDER BY p DESC, i))
SELECT k, count(*) AS n, round(max(p), 6) AS top FROM r WHERE r <= 40 AND b < 0.95 GROUP BY 1
""")
def nucleus_filter(spark, d):
    counts = table(spark, d, "events").groupBy(F.col("event_type").alias("k"), F.col("user_id").alias("i")).agg(F.count("*").cast("double").alias("n"))
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("k")))
    return routing.nucleus(p, ["k"], "p", "i").groupBy("k").agg(F.count("*").alias("n"), F.round(F.max("p"), 6).alias("top"))


@register("scaled_trace", "SELECT event_id % 3 AS layer, (user_id % 6 + event_id) % 16 AS expert, event_id // 3 AS token, count(*) AS n FROM events GROUP BY ALL")
def scaled_trace(spark, d):
    layer, expert = routing.scaled_trace(F.col("event_id"), F.col("user_id") % 6, F.col("event_id"), 3, 16)
    token, _ = routing.regrouped(F.col("event_id"), 3)
    return table(spark, d, "events").groupBy(layer.alias("layer"), expert.alias("expert"), token.alias("token")).agg(F.count("*").alias("n"))


@register("cross_record_transitions", """
WITH t AS (SELECT event_id, user_id % 4 AS s, user_id % 6 AS x, (user_id + event_id) % 6 AS y FROM events), p AS (SELECT x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM t WINDOW w AS (PARTITION BY s ORDER BY event_id)),
e AS (SELECT px AS a, x AS b FROM p WHERE px IS NOT NULL UNION ALL SELECT py, y FROM p WHERE py IS NOT NULL) SELECT a, b, count(*) AS n FROM e GROUP BY 1, 2
""")
def cross_record_transitions(spark, d):
    """Transitions between consecutive records, place by place."""
    rows = _traces(spark, d).withColumn("p", F.lag("experts").over(Window.partitionBy("sequence").orderBy("event_id"))).filter("p IS NOT NULL")
    pairs = rows.select(F.explode(F.arrays_zip(F.col("p").alias("a"), F.col("experts").alias("b"))).alias("z")).select("z.a", "z.b")
    return pairs.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))


@register("loop_signals", "SELECT user_id, count(*) FILTER (WHERE r > 1) AS n_loops FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS r FROM events) GROUP BY 1")
def loop_signals(spark, d):
    """Calls that repeat an earlier call with the same result."""
    r = F.row_number().over(Window.partitionBy("user_id", "event_type", "props").orderBy("event_id"))
    return table(spark, d, "events").withColumn("r", r).groupBy("user_id").agg(F.count_if(F.col("r") > 1).alias("n_loops"))


@register("curve_ends", "SELECT user_id, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value FROM events GROUP BY 1")
def curve_ends(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("value", "event_id").alias("first_value"), F.max_by("value", "event_id").alias("last_value"))


@register("event_props_json", "SELECT (props->>'$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1")
def event_props_json(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@register("cache_simulation")
def cache_simulation(spark, d):
    """Two-tier caches of several sizes and policies over one trace, each event's page predicted by the one before."""
    events = table(spark, d, "events").select("event_id", (F.col("user_id") % 50).alias("page"), (F.col("user_id") * 7 % 50).alias("guess"))
    trace = events.select(F.col("event_id").alias("order"), F.array("page").alias("pages"), F.array("guess").alias("predicted"))
    sizes = {page: 500_000 + 20_000 * page for page in range(50)}
    rows = [(f"{p}-{v}", v * 1_000_000, v * 2_000_000, p, [1, 2] if p == "pinned" else [], 5e8, 1e-4, 1e10, 1e-5, 1e-3) for v in (4, 16) for p in ("lru", "lfu", "pinned")]
    return simulate.cache_replay(trace, sizes, spark.createDataFrame(rows, simulate.SCENARIO))


@register("lease_queue_replay")
def lease_queue_replay(spark, d):
    """Tasks after all lease and completion events."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, d, "events").select((F.col("event_id") % 97).alias("task"), at.alias("at"), F.col("event_id").alias("event"), F.when(F.col("event_type") == "purchase", "complete").otherwise("lease").alias("kind"), (F.col("user_id") % 3).cast("string").alias("owner"))
    return simulate.lease_states(rows, 3600.0)


@register("critic_cache", "SELECT user_id, event_type, arg_max(value, event_id) AS value, count(*) AS n_puts FROM events GROUP BY 1, 2")
def critic_cache(spark, d):
    """The last judgement for each key of inputs."""
    rows = table(spark, d, "events").withColumn("key", F.struct("user_id", "event_type"))
    return simulate.critic_cache(rows, "key", "event_id", "value").select("key.user_id", "key.event_type", "value", "n_puts")


@register("generator_quality", "SELECT user_id % 5 AS model, event_type AS metric, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def generator_quality(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("model"), F.col("event_type").alias("metric")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@register("field_retention", """
WITH f AS (SELECT conv_id, 'f' || turn AS field, text AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
x AS (SELECT *, r <= greatest(n // 2, 1) AND turn_ok AS same FROM (SELECT *, r % 3 > 0 AS turn_ok FROM f))
SELECT conv_id, count(*) AS n_fields, count(*) FILTER (WHERE same) AS n_exact, round(count(*) FILTER (WHERE same) / count(*), 9) AS retention, coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE NOT same), '') AS lost FROM x GROUP BY 1
""")
def field_retention(spark, d):
    """Which turns come back with their text after the first half was kept and each third one changed."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    facts = table(spark, d, "conversations").select("conv_id", F.concat(F.lit("f"), "turn").alias("field"), F.col("text").alias("v"), F.row_number().over(order).alias("r"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    back = facts.filter(F.col("r") <= F.greatest(F.floor(F.col("n") / 2), F.lit(1))).withColumn("v", F.when(F.col("r") % 3 == 0, F.concat("v", F.lit("!"))).otherwise(F.col("v")))
    made = simulate.field_retention(facts, back, "conv_id", "field", "v")
    return made.withColumns({"retention": F.round("retention", 9), "lost": F.array_join("lost", ",")})


@register("compacted_fields", """
WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), a AS (SELECT conv_id, n, greatest(floor(n / 1.5), 1)::INT AS x FROM n)
SELECT conv_id, n AS n_before, greatest(floor(x / 1.5), 1)::INT AS n_after, round(greatest(floor(x / 1.5), 1) / n, 9) AS retention FROM a
""")
def compacted_fields(spark, d):
    return simulate.compacted_fields(table(spark, d, "conversations"), "conv_id", "turn", 2, 1.5).withColumn("retention", F.round("retention", 9))


@register("experiment_grid", "SELECT t AS task, r AS ratio, q AS retrieval FROM (SELECT DISTINCT event_type AS t FROM events), (SELECT unnest([1, 2, 4]) AS r), (SELECT unnest([true, false]) AS q)")
def experiment_grid(spark, d):
    """Every task with every setting."""
    tasks = table(spark, d, "events").select(F.col("event_type").alias("task")).distinct()
    return tasks.withColumn("ratio", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4)))).withColumn("retrieval", F.explode(F.array(F.lit(True), F.lit(False))))


@register("step_events", """
SELECT a.event_id, a.value AS view_value, b.value AS click_value FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id // 20 = b.event_id // 20 AND a.event_type = 'view' AND b.event_type = 'click'
""")
def step_events(spark, d):
    """Metrics and events of the same step."""
    rows = table(spark, d, "events").withColumn("step", F.floor(F.col("event_id") / 20))
    views = rows.filter("event_type = 'view'").select("event_id", "user_id", "step", F.col("value").alias("view_value"))
    clicks = rows.filter("event_type = 'click'").select("user_id", "step", F.col("value").alias("click_value"))
    return views.join(clicks, ["user_id", "step"]).select("event_id", "view_value", "click_value")


@register("most_frequent_items", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def most_frequent_items(spark, d):
    return routing.most_frequent(table(spark, d, "events"), "event_type", 3)


@register("token_records", """
WITH p AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, user_id FROM events QUALIFY i < (SELECT count(*) // 4 * 4 FROM events))
SELECT i // 4 AS token, string_agg(user_id % 6 || '+' || (user_id + 1) % 6, ',' ORDER BY i) AS experts FROM p GROUP BY 1
""")
def token_records(spark, d):
    """Tokens of a trace of four layers, from its dispatches in order."""
    events = table(spark, d, "events").select("event_id", "user_id")
    whole = events.count() // 4 * 4
    first = F.row_number().over(Window.orderBy("event_id")) - 1
    trace = events.withColumn("i", first).filter(F.col("i") < whole).select("event_id", (F.col("i") % 4).cast("int").alias("layer"), F.array(F.col("user_id") % 6, (F.col("user_id") + 1) % 6).alias("experts"))
    made = routing.token_records(trace, "event_id", 4)
    return made.select("token", F.array_join(F.transform("experts", lambda e: F.array_join(e.cast("array<string>"), "+")), ",").alias("experts"))


@register("deep_differences", """
WITH a AS (SELECT event_id, 'k' AS path, (props->>'$.k') AS value FROM events UNION ALL SELECT event_id, 'kind', event_type FROM events),
b AS (SELECT event_id, 'k' AS path, CASE WHEN event_id % 10 = 0 THEN 'changed' ELSE (props->>'$.k') END AS value FROM events UNION ALL SELECT event_id, 'kind', event_type FROM events WHERE event_id % 15 > 0)
SELECT event_id, path, a.value AS a, b.value AS b FROM a FULL JOIN b USING (event_id, path) WHERE a.event_id IS NULL OR b.event_id IS NULL OR a.value IS DISTINCT FROM b.value
""")
def deep_differences(spark, d):
    """Leaves of records that differ or that one side lacks."""
    events, n, k = table(spark, d, "events"), F.col("event_id"), F.get_json_object("props", "$.k")
    leaves = lambda rows, value: rows.select("event_id", F.lit("k").alias("path"), value.alias("value"))
    kinds = events.select("event_id", F.lit("kind").alias("path"), F.col("event_type").alias("value"))
    changed = leaves(events, F.when(n % 10 == 0, "changed").otherwise(k)).union(kinds.filter(n % 15 > 0))
    return dedup.deep_differences(leaves(events, k).union(kinds), changed, "event_id")
