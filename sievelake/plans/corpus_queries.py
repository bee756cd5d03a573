"""Queries over deduplication, joins, selection and transformation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievelake.functions import hashing, text
from sievelake.operators import dedup, neardup, overlap, select, splits, transform
from sievelake.operators.filters import quality_reason
from sievelake.plans.text_queries import LEXEMES, NORMAL, UNIT
from sievelake.registry import register
from sievelake.session import materialize, table

#: Distinct 5-token shingles of texts that have 64 or more.
SETS = f"""
tok AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {LEXEMES} AS l FROM documents)),
win AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS g FROM tok WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
uniq AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM win WHERE g IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS n FROM uniq GROUP BY 1 HAVING count(*) >= 64),
-- classes --
flat AS MATERIALIZED (SELECT doc_id, n, g FROM uniq JOIN sizes USING (doc_id) WHERE g IN (SELECT g FROM uniq GROUP BY g HAVING count(*) > 1)),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS c FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (SELECT a, b, c / (na + nb - c) AS jaccard FROM common WHERE c / (na + nb - c) >= 0.85)"""


#: The same for the smallest id of each distinct set.
CLASSES = """class AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY k) AS class FROM (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(0) ORDER BY g)) AS k FROM uniq GROUP BY 1 HAVING count(*) >= 64)),"""
FIRST_SETS = SETS.replace("-- classes --", CLASSES).replace("JOIN sizes USING (doc_id)", "JOIN (SELECT doc_id, n FROM class WHERE doc_id = class) USING (doc_id)")
SETS = SETS.replace("-- classes --\n", "")


def sets(spark, d):
    return neardup.shingle_sets(table(spark, d, "documents"), "doc_id", "text")


def first_sets(spark, d):
    return materialize(neardup.representatives(materialize(sets(spark, d), "shingle-sets"), "doc_id"), "representatives")


@register("near_dup_classes", f"WITH {FIRST_SETS} SELECT doc_id, class FROM class")
def near_dup_classes(spark, d):
    """The class of each text that is compared: the smallest id with the same set of shingles."""
    return neardup.set_classes(sets(spark, d), "doc_id")


@register("near_dup_pairs", f"WITH {FIRST_SETS} SELECT a, b, round(jaccard, 9) AS jaccard FROM pairs")
def near_dup_pairs(spark, d):
    """All pairs of classes whose shingle sets are alike, by their smallest ids; exact, by prefix filtering."""
    return neardup.similar_pairs(first_sets(spark, d), "doc_id").select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@register("near_dup_lsh_recall")
def near_dup_lsh_recall(spark, d):
    """How many of the exact pairs the bands find."""
    made = first_sets(spark, d)
    exact = neardup.similar_pairs(made, "doc_id")
    banded = neardup.band_pairs(made, "doc_id").select("a", "b", F.lit(True).alias("found"))
    return exact.join(banded, ["a", "b"], "left").agg(F.count("*").alias("n_pairs"), F.count("found").alias("n_found"))


@register("near_dup_lsh_pairs", f"WITH {FIRST_SETS} SELECT a, b, round(jaccard, 9) AS jaccard FROM pairs")
def near_dup_lsh_pairs(spark, d):
    """The same pairs from bands of MinHash signatures, verified."""
    made = first_sets(spark, d)
    return neardup.similar_pairs(made, "doc_id", candidates=neardup.band_pairs(made, "doc_id")).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@register("file_removal_reasons", """
WITH b AS (SELECT doc_id, doc_id % 7 AS tree, lang || doc_id % 3 AS style, lang = 'en' AS python FROM documents),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY tree, style) AS copy, min(CASE WHEN python THEN doc_id END) OVER (PARTITION BY tree) AS first FROM b)
SELECT doc_id, CASE WHEN python AND copy <> first THEN 'short_ast_duplicate' WHEN doc_id <> copy THEN 'exact_normalized' END AS reason FROM f
""")
def file_removal_reasons(spark, d):
    """Why short source files go: same text, or in Python the same syntax tree in another style."""
    n = F.col("doc_id")
    style = F.concat(F.lit("  # "), "lang", (n % 3).cast("string"))
    docs = table(spark, d, "documents").select("doc_id", "lang", F.concat(F.lit("def f(a):\n    return a + "), (n % 7).cast("string"), style, F.lit("\n")).alias("body"))
    return neardup.removal_reasons(docs, "doc_id", "body", F.col("lang") == "en")


@register("near_dup_greedy_kept", f"""
WITH RECURSIVE {SETS},
e AS MATERIALIZED (SELECT a, b FROM pairs),
n AS MATERIALIZED (SELECT DISTINCT b AS id FROM e),
o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS r FROM n),
w(r, dropped) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT w.r + 1, CASE WHEN (SELECT count(*) FROM e WHERE e.b = o.id AND NOT list_contains(w.dropped, e.a)) > 0 THEN list_append(w.dropped, o.id) ELSE w.dropped END FROM w JOIN o ON o.r = w.r + 1)
SELECT doc_id, NOT list_contains((SELECT dropped FROM w ORDER BY r DESC LIMIT 1), doc_id) AS kept FROM documents
""")
def near_dup_greedy_kept(spark, d):
    """In order of id, a text stays unless a text that stays is its near-duplicate."""
    return neardup.greedy_near_dedup(table(spark, d, "documents"), "doc_id", "text")


@register("families_union_find", f"""
WITH RECURSIVE h AS (SELECT source, sha256({NORMAL}) AS digest FROM documents),
e AS (SELECT DISTINCT x.source AS a, y.source AS b FROM h x JOIN h y ON x.digest = y.digest),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS node, min(b) AS family FROM r GROUP BY 1
""")
def families_union_find(spark, d):
    """Sources that share a text are one family, named by its smallest."""
    hashed = table(spark, d, "documents").select("source", hashing.sha256_hex(text.normalize(F.col("text"))).alias("digest")).distinct()
    first = hashed.groupBy("digest").agg(F.min("source").alias("a"))
    edges = hashed.join(first, "digest").select("a", F.col("source").alias("b")).filter("a != b").distinct()
    return neardup.families(edges, table(spark, d, "documents").select(F.col("source").alias("node")).distinct())


@register("split_dedup", f"""
WITH h AS (SELECT doc_id, source, sha256({NORMAL}) AS digest, CASE WHEN {UNIT.format("'42:repository' || chr(0) || source")} < 0.2 THEN 'val' ELSE 'train' END AS split FROM documents),
k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY split, digest ORDER BY doc_id) = 1)
SELECT split, count(*) AS n FROM k x WHERE split = 'val' OR NOT EXISTS (SELECT 1 FROM h WHERE h.split = 'val' AND h.digest = x.digest) GROUP BY 1
""")
def split_dedup(spark, d):
    """One text in each split, and no training text that is held out."""
    hashed = table(spark, d, "documents").select("doc_id", hashing.sha256_hex(text.normalize(F.col("text"))).alias("digest"), splits.two_way_split(F.col("source"), 0.2, 42).alias("split"))
    kept = dedup.exact_dedup(hashed, ["split", "digest"], ["doc_id"])
    held = kept.filter("split = 'val'")
    clean = kept.filter("split = 'train'").join(held.select("digest"), "digest", "left_anti")
    return clean.select("split").unionAll(held.select("split")).groupBy("split").agg(F.count("*").alias("n"))


@register("duplicate_abort_check", f"SELECT sha256({NORMAL}) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_abort_check(spark, d):
    """Digests that occur more than once."""
    return dedup.repeated(table(spark, d, "documents").select(hashing.sha256_hex(text.normalize(F.col("text"))).alias("digest")), ["digest"])


@register("distinct_references", "SELECT count(DISTINCT sha256(text)) AS n_references FROM benchmark")
def distinct_references(spark, d):
    return table(spark, d, "benchmark").agg(F.count_distinct(F.sha2("text", 256)).alias("n_references"))


@register("set_differences", """
WITH a AS (SELECT DISTINCT user_id % 50 AS k FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id % 60 AS k FROM events WHERE event_type = 'click')
SELECT 'missing' AS side, k FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'unexpected', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
""")
def set_differences(spark, d):
    events = table(spark, d, "events")
    seen = events.filter("event_type = 'view'").select((F.col("user_id") % 50).alias("k")).distinct()
    wanted = events.filter("event_type = 'click'").select((F.col("user_id") % 60).alias("k")).distinct()
    return dedup.differences(seen, wanted)


@register("mixed_columns_union", """
SELECT 'doc' AS kind, doc_id AS id, lang, NULL::BIGINT AS turn FROM documents UNION ALL SELECT 'conv', conv_id, NULL, turn FROM conversations
""")
def mixed_columns_union(spark, d):
    docs = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "lang")
    return dedup.union_all([docs, table(spark, d, "conversations").select(F.lit("conv").alias("kind"), F.col("conv_id").alias("id"), "turn")])


@register("three_way_split", f"""
WITH u AS (SELECT source, {UNIT.format("'7:' || source")} AS u FROM documents)
SELECT source, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM u GROUP BY ALL
""")
def three_way_split(spark, d):
    return table(spark, d, "documents").groupBy("source", splits.ratio_split(F.col("source"), {"train": 0.8, "val": 0.1, "test": 0.1}, 7).alias("split")).agg(F.count("*").alias("n"))


@register("assigned_split", """
WITH p AS (SELECT 'src' || i AS source, CASE WHEN i % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM range(0, 15) r(i))
SELECT d.source, p.split, p.source IS NOT NULL AS assigned, count(*) AS n FROM documents d LEFT JOIN p ON p.source = d.source GROUP BY ALL
""")
def assigned_split(spark, d):
    plan = spark.range(15).select(F.concat(F.lit("src"), F.col("id")).alias("source"), F.when(F.col("id") % 4 == 0, "val").otherwise("train").alias("split"))
    return splits.assigned_split(table(spark, d, "documents"), plan, ["source"]).groupBy("source", "split", "assigned").agg(F.count("*").alias("n"))


@register("split_leakage_check", f"""
WITH h AS (SELECT sha256({NORMAL}) AS digest, CASE WHEN {UNIT.format("'42:repository' || chr(0) || source")} < 0.2 THEN 'val' ELSE 'train' END AS split FROM documents)
SELECT digest, count(DISTINCT split) AS n_splits FROM h GROUP BY 1 HAVING count(DISTINCT split) > 1
""")
def split_leakage_check(spark, d):
    """Texts that lie in both splits."""
    rows = table(spark, d, "documents").select(hashing.sha256_hex(text.normalize(F.col("text"))).alias("digest"), splits.two_way_split(F.col("source"), 0.2, 42).alias("split"))
    return splits.crossing_groups(rows, "digest", "split")


@register("benchmark_overlap", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark),
sd AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 8 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) END)) AS s FROM d),
lb AS (SELECT item_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 8 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) END) AS l FROM b),
sb AS (SELECT item_id, len(l) AS n, unnest(l) AS s FROM lb)
SELECT doc_id, item_id AS ref, round(count(*) / first(n), 9) AS overlap FROM sd JOIN sb USING (s) GROUP BY 1, 2 HAVING count(*) / first(n) >= 0.8
""")
def benchmark_overlap(spark, d):
    """Documents that hold most word shingles of a benchmark item."""
    found = overlap.shingle_overlap(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")
    return found.withColumn("overlap", F.round("overlap", 9))


@register("benchmark_phrase_containment", f"""
WITH d AS (SELECT doc_id, ' ' || array_to_string({LEXEMES.replace('(text', '(lower(text)')}, ' ') || ' ' AS line FROM documents),
b AS (SELECT item_id, {LEXEMES.replace('(text', '(lower(text)')} AS t FROM benchmark)
SELECT doc_id, item_id AS ref FROM d JOIN b ON len(t) >= 12 AND contains(line, ' ' || array_to_string(t, ' ') || ' ')
""")
def benchmark_phrase_containment(spark, d):
    """Documents that hold a whole benchmark item, token for token."""
    return overlap.phrase_containment(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


@register("benchmark_task_screen", f"""
WITH d AS (SELECT doc_id, ' ' || array_to_string({LEXEMES.replace('(text', '(lower(text)')}, ' ') || ' ' AS line FROM documents),
b AS (SELECT item_id, text FROM benchmark UNION ALL SELECT 100000 + doc_id, substr(text, 1, 400) FROM documents WHERE doc_id % 100 = 0),
t AS (SELECT item_id, {LEXEMES.replace('(text', '(lower(text)')} AS t FROM b),
k AS (SELECT item_id, 'reference' AS kind, t FROM t WHERE len(t) >= 32 UNION ALL SELECT item_id, 'prompt', t FROM t WHERE len(t) >= 12)
SELECT doc_id, item_id AS ref, kind FROM d JOIN k ON contains(line, ' ' || array_to_string(t, ' ') || ' ')
""")
def benchmark_task_screen(spark, d):
    """Documents that hold a task's reference of 32 tokens or a prompt's prose of 12; prompts come as docstrings with examples."""
    docs = table(spark, d, "documents")
    tasks = table(spark, d, "benchmark").select("item_id", "text").union(docs.filter("doc_id % 100 = 0").select(100000 + F.col("doc_id"), F.substring("text", 1, 400)))
    prompt = F.concat(F.lit('def f(x):\n    """  # '), "text", F.lit('\n    >>> f(1)\n    2\n    """\n    return x'))
    return overlap.task_screen(docs, "doc_id", "text", tasks.withColumn("prompt", prompt), "item_id", "prompt", "text")


@register("clean_corpus", f"""
WITH d AS (SELECT *, ' ' || array_to_string({LEXEMES.replace('(text', '(lower(text)')}, ' ') || ' ' AS line FROM documents), b AS (SELECT {LEXEMES.replace('(text', '(lower(text)')} AS t FROM benchmark)
SELECT source, count(*) AS n FROM d WHERE length(regexp_replace(text, '\\s+', '', 'g')) >= 64 AND NOT EXISTS (SELECT 1 FROM b WHERE len(t) >= 12 AND contains(line, ' ' || array_to_string(t, ' ') || ' '))
 AND doc_id NOT IN (WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS l FROM documents)
   SELECT doc_id FROM t WHERE len(l) >= 32 AND list_max(map_values(list_histogram(l))) / len(l) > 0.8) GROUP BY 1
""")
def clean_corpus(spark, d):
    """Documents of good quality without benchmark items."""
    good = table(spark, d, "documents").filter(quality_reason(F.col("text")).isNull())
    hits = benchmark_phrase_containment(spark, d).select("doc_id").distinct()
    return good.join(hits, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@register("import_resolution", """
WITH m AS (SELECT lang, source, CASE WHEN doc_id % 3 = 0 THEN 'pkg.shared' ELSE 'pkg.m' || doc_id END AS module, doc_id AS target FROM documents),
e AS (SELECT doc_id, lang, source, 'pkg.m' || (doc_id + 20) AS module FROM documents UNION ALL SELECT doc_id, lang, source, 'pkg.shared' FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id, module, min(target) AS target FROM e JOIN m USING (lang, source, module) GROUP BY 1, 2 HAVING count(*) = 1
""")
def import_resolution(spark, d):
    """Imports that name exactly one file of their repository."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    n = F.col("doc_id")
    modules = docs.select("lang", "source", F.when(n % 3 == 0, "pkg.shared").otherwise(F.concat(F.lit("pkg.m"), n)).alias("module"), n.alias("target"))
    body = F.concat(F.lit("import os\nfrom pkg.m"), n + 20, F.lit(" import x\n"), F.when(n % 5 == 0, "import pkg.shared\n").otherwise(""))
    edges = docs.select("doc_id", "lang", "source", F.explode(overlap.imports(body)).alias("module"))
    return overlap.resolve_unique(edges, modules, ["lang", "source", "module"]).select("doc_id", "module", "target")


@register("relative_imports", """
WITH f AS (SELECT DISTINCT 'web/' || lang || '/' || source || CASE WHEN doc_id % 2 = 0 THEN '.ts' ELSE '.js' END AS path FROM documents),
e AS (SELECT doc_id, 'web/' || lang || '/' || source AS base FROM documents),
j AS (SELECT doc_id, path FROM e JOIN f ON f.path IN (base || '.ts', base || '.js', base || '/index.ts'))
SELECT doc_id, min(path) AS path FROM j GROUP BY 1 HAVING count(*) = 1
""")
def relative_imports(spark, d):
    """Relative imports that lead to exactly one file."""
    docs, n = table(spark, d, "documents").select("doc_id", "lang", "source"), F.col("doc_id")
    files = docs.select(F.concat(F.lit("web/"), "lang", F.lit("/"), "source", F.when(n % 2 == 0, ".ts").otherwise(".js")).alias("path")).distinct()
    place = overlap.relative_candidates(F.concat(F.lit("web/"), F.col("lang"), F.lit("/x.ts")), F.concat(F.lit("./"), "source"), [".ts", ".js", "/index.ts"])
    found = docs.select("doc_id", F.explode(place).alias("path")).join(files, "path")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n = 1").drop("n")


@register("hash_bottom_k_sample", """
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY substr(sha256('42' || chr(0) || doc_id), 1, 32), doc_id) AS r FROM documents) WHERE r <= 20
""")
def hash_bottom_k_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return select.bottom_k(docs, ["lang"], select.hash_rank(42, F.col("doc_id")), "doc_id", 20)


@register("prefix_quota", """
SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (PARTITION BY lang, source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 5000
""")
def prefix_quota(spark, d):
    return select.prefix_quota(table(spark, d, "documents"), ["lang", "source"], ["doc_id"], "n_chars", 5000).select("doc_id")


@register("token_budget_selection")
def token_budget_selection(spark, d):
    docs = table(spark, d, "documents").withColumn("rank", select.hash_rank(42, F.col("doc_id")))
    return select.token_budget(docs, "doc_id", "source", "n_chars", "rank", 100_000).select("doc_id", "source", "n_chars")


@register("chunk_views_of_three", """
WITH p AS (SELECT source, doc_id, text, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 3 AS chunk FROM documents)
SELECT source, chunk, sha256(string_agg(text, chr(10) ORDER BY doc_id)) AS view_sha256 FROM p GROUP BY 1, 2 HAVING count(*) = 3
""")
def chunk_views_of_three(spark, d):
    views = select.chunk_views(table(spark, d, "documents").select("source", "doc_id", "text"), ["source"], "doc_id", "text")
    return views.select("source", "chunk", F.sha2("view", 256).alias("view_sha256"))


@register("batch_assignment", """
WITH b AS (SELECT lang, (row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1) // 4 AS batch FROM documents) SELECT lang, batch, count(*) AS n FROM b GROUP BY ALL
""")
def batch_assignment(spark, d):
    return select.batches(table(spark, d, "documents"), ["lang", "source"], "doc_id", 4).groupBy("lang", "batch").agg(F.count("*").alias("n"))


@register("round_robin", """
SELECT source, doc_id, turn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 50
""")
def round_robin(spark, d):
    """Turns from each source until 50."""
    return select.round_robin(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 50)


@register("bundle_round_robin", """
WITH RECURSIVE b AS (SELECT source, doc_id, doc_id % 6 AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY turn, source) AS r FROM b),
w(r, total, taken) AS (SELECT 0::BIGINT, 0::BIGINT, false UNION ALL SELECT o.r, CASE WHEN w.total + o.size <= 403 THEN w.total + o.size ELSE w.total END, w.total + o.size <= 403 FROM w JOIN o ON o.r = w.r + 1)
SELECT o.source, o.doc_id, o.size, o.turn FROM w JOIN o ON o.r = w.r WHERE w.taken AND o.size > 0
""")
def bundle_round_robin(spark, d):
    """Bundles by turns from each source, whole ones only, until 403 items."""
    docs = table(spark, d, "documents").select("source", "doc_id", (F.col("doc_id") % 6).alias("size"))
    return select.bundle_round_robin(docs, "source", "doc_id", "size", 403)


@register("pack_offsets", """
SELECT doc_id, lang, (sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) - n_chars)::BIGINT AS start, n_chars FROM documents
""")
def pack_offsets(spark, d):
    """Where each text starts in its language's stream."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return select.running_offsets(rows, ["lang"], "doc_id", F.col("n_chars"))


@register("shard_index", """
WITH o AS (SELECT (sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) - n_chars)::BIGINT AS a, n_chars AS n, lang FROM documents),
s AS (SELECT lang, unnest(range(a // 50000, (a + greatest(n, 1) - 1) // 50000 + 1)) AS shard, a, n FROM o)
SELECT lang, shard, sum(least(a + n, (shard + 1) * 50000) - greatest(a, shard * 50000))::BIGINT AS n_tokens FROM s GROUP BY ALL
""")
def shard_index(spark, d):
    """Tokens in each shard of fixed size."""
    rows = pack_offsets(spark, d).withColumn("stop", F.col("start") + F.col("n_chars"))
    last = F.floor((F.col("start") + F.greatest("n_chars", F.lit(1)) - 1) / 50000)
    parts = rows.withColumn("shard", F.explode(F.sequence(select.shard_of(F.col("start"), 50000), last)))
    size = F.least("stop", (F.col("shard") + 1) * 50000) - F.greatest("start", F.col("shard") * 50000)
    return parts.groupBy("lang", "shard").agg(F.sum(size).alias("n_tokens"))


@register("packed_boundary_masks", f"""
WITH t AS (SELECT conv_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i, turn FROM (SELECT conv_id, turn, {LEXEMES} AS w FROM conversations)),
p AS (SELECT conv_id, turn, i, length(tok) AS v, lead(length(tok)) OVER (PARTITION BY conv_id ORDER BY turn, i) AS nv, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn, i) AS nt FROM t)
SELECT conv_id, count(*) AS n, sum(CASE WHEN nt IS NULL OR nt <> turn THEN -100 ELSE nv END)::BIGINT AS target_sum FROM p GROUP BY 1
""")
def packed_boundary_masks(spark, d):
    """Next-token targets, masked where the next token is of another text."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(text.lexemes(F.col("text"))).alias("i", "tok"))
    w = Window.partitionBy("conv_id").orderBy("turn", "i")
    target = F.when(F.lead("turn").over(w) == F.col("turn"), F.lead(F.length("tok")).over(w)).otherwise(-100)
    return rows.withColumn("target", target).groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("target").alias("target_sum"))


@register("token_to_document", """
WITH o AS (SELECT doc_id, (sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) - n_chars)::BIGINT AS a, n_chars AS n, lang FROM documents),
q AS (SELECT DISTINCT lang, unnest(range(0, 20)) * 4999 AS pos FROM documents)
SELECT q.lang, pos, doc_id, pos - a AS inside FROM q JOIN o ON o.lang = q.lang AND pos >= a AND pos < a + n
""")
def token_to_document(spark, d):
    """Which text holds a position of the stream: the range is cut into blocks, so the join has keys."""
    rows, block = pack_offsets(spark, d), 8192
    spread = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_chars")) / block))))
    asked = rows.select("lang").distinct().select("lang", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).select("lang", (F.col("i") * 4999).cast("long").alias("pos")).withColumn("block", F.floor(F.col("pos") / block))
    hit = asked.join(spread, ["lang", "block"]).filter("pos >= start AND pos < start + n_chars")
    return hit.select("lang", "pos", "doc_id", (F.col("pos") - F.col("start")).alias("inside"))


@register("seeded_shuffle")
def seeded_shuffle(spark, d):
    """A seeded order of whole texts, and the first texts of two epochs."""
    docs = table(spark, d, "documents")
    for epoch in (0, 1):
        order = Window.partitionBy("source").orderBy(select.seeded_order(42 + epoch, F.col("doc_id")), "doc_id")
        docs = docs.withColumn(f"epoch_{epoch}", F.row_number().over(order))
    return docs.select("doc_id", "source", "epoch_0", "epoch_1")


@register("fim_eligibility", """
SELECT lang, length(text) >= 128 AND lang IN ('en', 'de') AND NOT (contains(text, '<fim_prefix>') OR contains(text, '<fim_suffix>') OR contains(text, '<fim_middle>')) AS eligible, count(*) AS n FROM documents GROUP BY ALL
""")
def fim_eligibility(spark, d):
    lang = F.when(F.col("lang").isin("en", "de"), "Python").otherwise("Text")
    return table(spark, d, "documents").groupBy("lang", transform.eligible(F.lit("code"), lang, F.col("text")).alias("eligible")).agg(F.count("*").alias("n"))


def _rewritten(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    identity = F.concat_ws("\0", F.lit("42"), "source", F.col("doc_id").cast("string"), F.lit(transform.FORMAT))
    allowed = transform.eligible(F.lit("code"), F.lit("Python"), F.col("text"))
    return transform.fill_in_middle(docs, "text", allowed, identity, 0.4)


#: A line with its end, in the SQL's dialect.
LINES = r"[^\n\r\x{0B}\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\x{0B}\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}])"
NUMBER = "(('0x' || substr(h, {}, 16))::UBIGINT)"


@register("fim_char_transform", f"""
WITH x AS (SELECT doc_id, text, length(text) AS size, sha256('42' || chr(0) || source || chr(0) || doc_id || chr(0) || 'psm_literal_markers_v1') AS h FROM documents),
e AS (SELECT *, size >= 128 AND {NUMBER.format(1)}::DOUBLE / 18446744073709551616.0 < 0.4 AS applied, regexp_extract_all(text, '{LINES}') AS ll FROM x),
b AS (SELECT *, list_filter(list_transform(range(1, len(ll) + 1), lambda i: list_sum(list_transform(ll[1:i], lambda s: length(s)))::BIGINT), lambda v: v < size) AS ends FROM e),
a AS (SELECT *, CASE WHEN len(ends) >= 2 THEN {NUMBER.format(17)} % (len(ends) - 1)::UBIGINT ELSE 1 + {NUMBER.format(17)} % greatest(size - 2, 1)::UBIGINT END::BIGINT AS p FROM b),
c AS (SELECT *, p + 1 + (CASE WHEN len(ends) >= 2 THEN {NUMBER.format(33)} % greatest(len(ends) - p - 1, 1)::UBIGINT ELSE {NUMBER.format(33)} % greatest(size - p - 1, 1)::UBIGINT END)::BIGINT AS q FROM a),
s AS (SELECT *, CASE WHEN len(ends) >= 2 THEN ends[p + 1] ELSE p END AS start, CASE WHEN len(ends) >= 2 THEN ends[q + 1] ELSE q END AS stop FROM c)
SELECT doc_id, applied, CASE WHEN applied THEN start::BIGINT END AS start, CASE WHEN applied THEN stop::BIGINT END AS stop, CASE WHEN applied THEN CASE WHEN len(ends) >= 2 THEN 'line_boundary' ELSE 'unicode_character' END END AS cut_unit,
 sha256(CASE WHEN applied THEN '<fim_prefix>' || substr(text, 1, start) || '<fim_suffix>' || substr(text, stop + 1) || '<fim_middle>' || substr(text, start + 1, stop - start) ELSE text END) AS fim_sha256 FROM s
""")
def fim_char_transform(spark, d):
    """Texts with a middle part moved to the end, cut at line ends or characters."""
    return _rewritten(spark, d).select("doc_id", "applied", "start", "stop", "cut_unit", F.sha2("fim_text", 256).alias("fim_sha256"))


@register("fim_roundtrip", f"""
WITH x AS (SELECT length(text) >= 128 AND ('0x' || substr(sha256('42' || chr(0) || source || chr(0) || doc_id || chr(0) || 'psm_literal_markers_v1'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.4 AS applied FROM documents)
SELECT applied, count(*) AS n, 0::BIGINT AS n_changed FROM x GROUP BY 1
""")
def fim_roundtrip(spark, d):
    """Texts whose rewriting doesn't restore to what they were: none."""
    made = _rewritten(spark, d).withColumn("back", transform.restore(F.col("fim_text"), F.col("applied")))
    return made.groupBy("applied").agg(F.count("*").alias("n"), F.count_if(F.col("back") != F.col("text")).alias("n_changed"))


@register("fim_token_minimums")
def fim_token_minimums(spark, d):
    """Texts cut where tokens begin, with at least 16 tokens in each part."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    identity = F.concat_ws("\0", F.lit("42"), "source", F.col("doc_id").cast("string"), F.lit(transform.TOKEN_FORMAT))
    allowed = transform.eligible(F.lit("code"), F.lit("Python"), F.col("text"))
    made = transform.fill_in_middle_tokens(docs, "text", allowed, identity, 0.4, "/opt/tokenizers/byte_bpe_50k.json")
    return made.select("doc_id", "eligible", "applied", "skip_reason", "start", "stop", F.array_join(F.col("span_tokens").cast("array<string>"), ",").alias("span_tokens"), F.sha2("fim_text", 256).alias("fim_sha256"))


@register("dependency_contexts", """
WITH RECURSIVE nb AS (SELECT a.doc_id, a.n_chars, b.doc_id AS neighbour, b.n_chars AS nn, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id) AS r FROM documents a JOIN documents b ON b.source = a.source AND b.lang = a.lang AND b.doc_id > a.doc_id AND b.doc_id <= a.doc_id + 100 WHERE a.n_chars <= 8192),
w(doc_id, r, total, files) AS (SELECT DISTINCT doc_id, 0::BIGINT, n_chars, []::BIGINT[] FROM nb UNION ALL
 SELECT w.doc_id, nb.r, CASE WHEN len(files) < 3 AND total + nn <= 8192 THEN total + nn ELSE total END, CASE WHEN len(files) < 3 AND total + nn <= 8192 THEN list_append(files, neighbour) ELSE files END FROM w JOIN nb ON nb.doc_id = w.doc_id AND nb.r = w.r + 1)
SELECT doc_id, arg_max(total, r)::BIGINT AS total, array_to_string(arg_max(files, r), ',') AS files FROM w GROUP BY 1 HAVING len(arg_max(files, r)) > 0
""")
def dependency_contexts(spark, d):
    """Texts with up to three neighbours that fit with them."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    other = docs.select("source", "lang", F.col("doc_id").alias("neighbour"), F.col("n_chars").alias("neighbour_size"))
    near = docs.select("doc_id", "source", "lang").join(other, ["source", "lang"]).filter("neighbour > doc_id AND neighbour <= doc_id + 100").select("doc_id", "neighbour", "neighbour_size")
    return transform.dependency_contexts(docs.select("doc_id", "n_chars"), "doc_id", "n_chars", near).withColumn("files", F.array_join(F.col("files").cast("array<string>"), ","))


@register("foundation_admission", f"""
WITH r AS (SELECT doc_id, source, sha256({NORMAL}) AS digest, CASE WHEN {UNIT.format("'42:repository' || chr(0) || source")} < 0.2 THEN 'val' ELSE 'train' END AS split FROM documents),
p AS (SELECT 'src' || i AS source, i % 6 > 0 AS reviewed FROM range(0, 18) t(i)),
j AS (SELECT r.*, p.source IS NULL AS unplanned, p.reviewed FROM r LEFT JOIN p ON p.source = r.source),
h AS (SELECT DISTINCT digest FROM r WHERE split = 'val'),
f AS (SELECT j.*, h.digest IS NOT NULL AS held, row_number() OVER (PARTITION BY split, j.digest, unplanned OR NOT reviewed OR (split = 'train' AND h.digest IS NOT NULL) ORDER BY doc_id) AS rn FROM j LEFT JOIN h ON h.digest = j.digest)
SELECT coalesce(CASE WHEN unplanned THEN 'not_in_plan' WHEN NOT reviewed THEN 'license' WHEN split = 'train' AND held THEN 'held_out_duplicate' WHEN rn > 1 THEN 'exact_duplicate' END, 'admitted') AS reason, count(*) AS n FROM f GROUP BY 1
""")
def foundation_admission(spark, d):
    """Reasons for which records are not admitted: plan, licence, held-out copies, copies."""
    plan = spark.range(18).select(F.concat(F.lit("src"), F.col("id")).alias("source"), (F.col("id") % 6 > 0).alias("reviewed"))
    rows = table(spark, d, "documents").select("doc_id", "source", hashing.sha256_hex(text.normalize(F.col("text"))).alias("digest"), splits.two_way_split(F.col("source"), 0.2, 42).alias("split"))
    return dedup.admission(rows, plan).groupBy(F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n"))


@register("bpe_token_counts")
def bpe_token_counts(spark, d):
    """Tokens of a public vocabulary, and whether decoding restores the text."""
    from sievelake.functions.tokens import token_counts

    return token_counts(table(spark, d, "conversations"), ["conv_id", "turn"], "text", "/opt/tokenizers/byte_bpe_50k.json")
