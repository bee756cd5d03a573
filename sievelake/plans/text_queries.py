"""Queries over scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import hashing, scalars, text
from sievelake.operators import dedup, splits
from sievelake.registry import register
from sievelake.session import table

#: The same classes and steps in DuckDB's regular expressions.
SPACES = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NORMAL = rf"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[{SPACES}]+$', '')"
LEXEMES = rf"regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACES}]')"
UNIT = "('0x' || substr(sha256({}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"
#: Sample paths, chosen by id, for the operators on file names.
PATHS = ["src/a.py", "tests/unit/b.py", "README.md", "package.json", "conf/app.yaml", "lib/x_test.go", "Makefile", "include/a.h", "web/App.tsx", "notes", "src/.hidden", "CMakeLists.txt", "a/Testing/z.rs"]


def sample_path(number):
    return F.element_at(F.array(*[F.lit(p) for p in PATHS]), (F.pmod(number, F.lit(len(PATHS))) + 1).cast("int"))


SAMPLE_PATH = f"([{', '.join(repr(p) for p in PATHS)}])[doc_id % {len(PATHS)} + 1]"


@register("exact_dedup_split", f"""
WITH h AS (SELECT doc_id, lang, source, sha256({NORMAL}) AS digest FROM documents),
k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id) = 1),
s AS (SELECT CASE WHEN {UNIT.format("'42:repository' || chr(0) || source")} < 0.2 THEN 'val' ELSE 'train' END AS split, lang FROM k)
SELECT split, lang, count(*) AS n_docs FROM s GROUP BY split, lang
""")
def exact_dedup_split(spark, d, eval_fraction=0.2, seed=42):
    """Keep the lowest id of each normalised text, split by source, count by split and language."""
    docs = table(spark, d, "documents")
    hashed = docs.select("doc_id", "lang", "source", hashing.sha256_hex(text.normalize(F.col("text"))).alias("digest"))
    kept = dedup.exact_dedup(hashed, ["digest"], ["doc_id"])
    named = kept.withColumn("split", splits.two_way_split(F.col("source"), eval_fraction, seed))
    return named.groupBy("split", "lang").agg(F.count("*").alias("n_docs"))


@register("content_hashes", f"""
SELECT doc_id, sha256(text) AS raw_sha256, sha256({NORMAL}) AS normalized_sha256, round({UNIT.format('text')}, 9) AS draw FROM documents
""")
def content_hashes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", hashing.sha256_hex(t).alias("raw_sha256"), hashing.sha256_hex(text.normalize(t)).alias("normalized_sha256"),
        F.round(hashing.unit_interval(t), 9).alias("draw"),
    )


@register("header_roundtrip", """
SELECT doc_id, length('<repo>' || source || '<file>' || doc_id || chr(10) || text) AS n_full, sha256(text) AS body_sha256 FROM documents
""")
def header_roundtrip(spark, d):
    head = text.header(F.col("source"), F.col("doc_id").cast("string"))
    full = table(spark, d, "documents").withColumn("full", F.concat(head, F.col("text")))
    return full.select("doc_id", F.length("full").cast("long").alias("n_full"), hashing.sha256_hex(text.strip_header(F.col("full"), head)).alias("body_sha256"))


@register("file_roles", f"""
WITH p AS (SELECT doc_id, {SAMPLE_PATH} AS path FROM documents),
n AS (SELECT *, string_split(path, '/')[-1] AS name, list_transform(string_split(path, '/'), lambda x: lower(x)) AS parts FROM p),
e AS (SELECT *, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS ext FROM n),
r AS (SELECT *, CASE WHEN ext IN ('.md', '.rst', '.txt') THEN 'documentation'
  WHEN list_has_any(parts, ['test', 'tests', '__tests__', 'testing']) OR starts_with(lower(name), 'test_') OR regexp_matches(lower(name), '(_test\\.go|\\.test\\.js|\\.spec\\.ts)$') THEN 'test'
  WHEN name IN ('Makefile', 'Dockerfile', 'CMakeLists.txt') OR lower(name) IN ('package.json', 'pyproject.toml', 'cargo.toml', 'go.mod') THEN 'build'
  WHEN ext IN ('.json', '.yaml', '.yml', '.toml', '.csproj', '.props', '.targets') THEN 'configuration' ELSE 'implementation' END AS role FROM e),
l AS (SELECT *, CASE WHEN role = 'documentation' THEN 'technical' WHEN role IN ('build', 'configuration') THEN 'context' ELSE 'code' END AS kind,
  CASE WHEN ext = '.h' THEN 'C++' WHEN name = 'Makefile' THEN 'Makefile' WHEN name = 'CMakeLists.txt' THEN 'CMake' WHEN ext = '.py' THEN 'Python'
  WHEN ext = '.md' THEN 'Markdown' WHEN ext = '.go' THEN 'Go' WHEN ext = '.tsx' THEN 'TypeScript' WHEN ext = '.rs' THEN 'Rust' END AS language FROM r)
SELECT role, kind, language, CASE WHEN role = 'test' THEN 'issues_prs_commits_tests_reviews' WHEN kind = 'technical' THEN 'technical_documentation_text_to_code'
  WHEN kind = 'general' THEN 'algorithms_math_reasoning' ELSE 'file_level_code' END AS category, count(*) AS n FROM l GROUP BY ALL
""")
def file_roles(spark, d):
    """Role, kind, language and category of file paths."""
    named = table(spark, d, "documents").select(sample_path(F.col("doc_id")).alias("path"))
    named = named.withColumn("role", scalars.role(F.col("path")))
    named = named.withColumns({"kind": scalars.kind_of_role(F.col("role")), "language": scalars.language(F.col("path"), "C++")})
    named = named.withColumn("category", scalars.foundation_category(F.col("role"), F.col("kind")))
    return named.groupBy("role", "kind", "language", "category").agg(F.count("*").alias("n"))


@register("language_aliases", """
WITH a AS (SELECT ([NULL, 'GO', 'Shell', 'CSS', 'Rust'])[doc_id % 5 + 1] AS declared, (['Python', 'Go', 'HTML'])[doc_id % 3 + 1] AS inferred FROM documents),
n AS (SELECT coalesce(declared, inferred) AS name FROM a)
SELECT CASE name WHEN 'GO' THEN 'Go' WHEN 'Shell' THEN 'Bash' WHEN 'HTML' THEN 'HTML/CSS' WHEN 'CSS' THEN 'HTML/CSS' ELSE name END AS language, count(*) AS n FROM n GROUP BY 1
""")
def language_aliases(spark, d):
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % len(names) + 1).cast("int"))
    name = scalars.language_alias(pick([None, "GO", "Shell", "CSS", "Rust"]), pick(["Python", "Go", "HTML"]))
    return table(spark, d, "documents").groupBy(name.alias("language")).agg(F.count("*").alias("n"))


@register("spdx_expressions", """
WITH t AS (SELECT doc_id, (['MIT', 'Apache-2.0 OR MIT', 'GPL-2.0-only', ''])[doc_id % 4 + 1] AS e, text FROM documents),
f AS (SELECT doc_id, CASE WHEN e = '' THEN text ELSE '/* SPDX-License-Identifier: ' || e || ' */' || chr(10) || text END AS text FROM t),
x AS (SELECT regexp_replace(trim(regexp_extract(substr(text, 1, 3000), 'SPDX-License-Identifier:[ \\t]*([^\\r\\n]+)', 1)), '[*/ ]+$', '') AS spdx FROM f)
SELECT nullif(spdx, '') AS spdx, count(*) AS n FROM x GROUP BY 1
""")
def spdx_expressions(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("MIT", "Apache-2.0 OR MIT", "GPL-2.0-only", "")]), (F.col("doc_id") % 4 + 1).cast("int"))
    full = F.when(name == "", F.col("text")).otherwise(F.concat(F.lit("/* SPDX-License-Identifier: "), name, F.lit(" */\n"), F.col("text")))
    return table(spark, d, "documents").groupBy(scalars.spdx_expression(full).alias("spdx")).agg(F.count("*").alias("n"))


@register("url_host_groups", f"""
WITH h AS (SELECT nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www[.]', ''), '') AS host FROM pages),
s AS (SELECT host, CASE WHEN {UNIT.format("'42' || chr(0) || 'web:' || host")} < 0.03 THEN 'val' ELSE 'train' END AS split FROM h)
SELECT host, split, count(*) AS n_pages FROM s GROUP BY ALL
""")
def url_host_groups(spark, d):
    """Pages by host, hosts split as a whole."""
    hosts = table(spark, d, "pages").select(scalars.url_host(F.col("url")).alias("host"))
    draw = hashing.unit_interval(F.concat(F.lit("42\0web:"), F.col("host")))
    return hosts.groupBy("host", F.when(draw < 0.03, "val").otherwise("train").alias("split")).agg(F.count("*").alias("n_pages"))


@register("corpus_kinds", """
WITH k AS (SELECT source, CASE WHEN doc_id % 7 = 0 THEN 'technical' WHEN ('0x' || substr(sha256(text), 1, 8))::UBIGINT % 10 = 0 THEN 'context' ELSE 'code' END AS kind FROM documents)
SELECT source, kind, count(*) AS n FROM k GROUP BY ALL
""")
def corpus_kinds(spark, d):
    lang = F.when(F.col("doc_id") % 7 == 0, "Markdown").otherwise("Python")
    return table(spark, d, "documents").groupBy("source", scalars.corpus_kind(F.col("text"), lang).alias("kind")).agg(F.count("*").alias("n"))


@register("lexeme_stats_by_lang", f"""
WITH t AS (SELECT lang, length(text) AS c, octet_length(encode(text)) AS b, len(string_split(text, chr(10))) AS l, len({LEXEMES}) AS n FROM documents)
SELECT lang, sum(n)::BIGINT AS n_tokens, round(sum(n) / sum(c), 6) AS per_char, round(sum(n) / sum(b), 6) AS per_byte, round(sum(n) / sum(l), 6) AS per_line FROM t GROUP BY lang
""")
def lexeme_stats_by_lang(spark, d):
    """Tokens for each character, byte and line."""
    t = table(spark, d, "documents").select("lang", F.length("text").alias("c"), F.octet_length("text").alias("b"), F.size(F.split("text", "\n")).alias("l"), F.size(text.lexemes(F.col("text"))).alias("n"))
    per = lambda c: F.round(F.sum("n") / F.sum(c), 6)
    return t.groupBy("lang").agg(F.sum("n").alias("n_tokens"), per("c").alias("per_char"), per("b").alias("per_byte"), per("l").alias("per_line"))


@register("word_and_code_tokens", r"""
SELECT lang, sum(len(regexp_extract_all(lower(text), '[a-z0-9_]+')))::BIGINT AS n_words,
  sum(len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^A-Za-z0-9_\s]')))::BIGINT AS n_code FROM documents GROUP BY lang
""")
def word_and_code_tokens(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(F.size(text.ascii_words(t))).alias("n_words"), F.sum(F.size(text.code_tokens(t))).alias("n_code"))


@register("shingle_counts", f"""
WITH t AS (SELECT doc_id, {LEXEMES} AS l, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents),
s AS (SELECT doc_id, len(l) AS n, len(list_distinct(list_transform(range(1, greatest(len(l) - 3, 1)), lambda i: array_to_string(l[i:i + 4], ' ')))) AS five,
 CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 8 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')))) END AS eight FROM t)
SELECT doc_id, n::BIGINT AS n_lexemes, five::BIGINT AS n_five, eight::BIGINT AS n_eight FROM s
""")
def shingle_counts(spark, d):
    """Distinct 5-token windows (none for shorter texts) and 8-word windows (one for shorter texts)."""
    five = text.let(text.lexemes(F.col("text")), lambda l: F.struct(F.size(l).cast("long").alias("n"), F.size(text.shingle_hashes(l, 5)).cast("long").alias("five")))
    eight = F.size(text.shingle_hashes(text.ascii_words(F.col("text")), 8, keep_short=True)).cast("long")
    rows = table(spark, d, "documents").select("doc_id", five.alias("f"), eight.alias("n_eight"))
    return rows.select("doc_id", F.col("f.n").alias("n_lexemes"), F.col("f.five").alias("n_five"), "n_eight")


@register("stable_ids", """
SELECT doc_id, 'ds2-' || sha256('{"content_sha256":"' || sha256(text) || '","parents":["p' || doc_id % 3 || '"],"schema_version":1,"source_id":"' || source || '"}') AS sample_id,
  sha256('{"lang": "' || lang || '", "n": ' || n_chars || '}') AS fingerprint FROM documents
""")
def stable_ids(spark, d):
    """Identifiers from canonical JSON, and fingerprints from JSON with spaces."""
    parents = F.array(F.concat(F.lit("p"), F.col("doc_id") % 3))
    sample = hashing.stable_id("ds2-", {"schema_version": F.lit(1), "source_id": F.col("source"), "content_sha256": F.sha2("text", 256), "parents": F.sort_array(parents)})
    return table(spark, d, "documents").select("doc_id", sample.alias("sample_id"), F.sha2(hashing.spaced_json({"n": F.col("n_chars"), "lang": F.col("lang")}), 256).alias("fingerprint"))


@register("float_equivalence", """
WITH v AS (SELECT l_returnflag, l_extendedprice * (1 - l_discount) AS a, l_extendedprice - l_extendedprice * l_discount AS b, round(l_extendedprice, 0) AS c, l_extendedprice AS e FROM lineitem)
SELECT l_returnflag, count(*) FILTER (WHERE abs(a - b) <= greatest(1e-9 * greatest(abs(a), abs(b)), 1e-9)) AS n_same,
  count(*) FILTER (WHERE abs(c - e) <= greatest(1e-9 * greatest(abs(c), abs(e)), 1e-9)) AS n_whole, count(*) AS n_arrays FROM v GROUP BY 1
""")
def float_equivalence(spark, d):
    """Values, and arrays of them, equal within a tolerance."""
    price, rate = F.col("l_extendedprice"), F.col("l_discount")
    a, b = price * (1 - rate), price - price * rate
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(scalars.close(a, b)).alias("n_same"), F.count_if(scalars.close(F.round(price, 0), price)).alias("n_whole"),
        F.count_if(scalars.arrays_close(F.array(a, price), F.array(b, price))).alias("n_arrays"),
    )


@register("repetition_flags", rf"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text || CASE WHEN conv_id % 5 = 0 THEN ' x y z x y z a b c d e f' ELSE '' END), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACES}]') AS w FROM conversations)
SELECT conv_id, turn, len(w) >= 12 AND list_bool_or(list_transform(range(3, 12), lambda s: 2 * s <= len(w) AND
  coalesce(list_bool_or(list_transform(range(1, greatest(len(w) - 2 * s + 2, 2)), lambda i: w[i:i + s - 1] = w[i + s:i + 2 * s - 1])), false))) AS repeats FROM t
""")
def repetition_flags(spark, d):
    """Texts in which a window of 3 to 11 tokens is directly repeated."""
    more = F.when(F.col("conv_id") % 5 == 0, " x y z x y z a b c d e f").otherwise("")
    tokens = text.lexemes(F.lower(F.concat("text", more)))
    return table(spark, d, "conversations").select("conv_id", "turn", text.adjacent_repeat(tokens).alias("repeats"))


@register("phrase_repetition")
def phrase_repetition(spark, d):
    """Phrases three times in a row; needs back-references, which DuckDB lacks."""
    return table(spark, d, "conversations").select("conv_id", "turn", text.phrase_repeat(F.col("text")).alias("repeats"))


@register("code_extraction", r"""
WITH t AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN text || chr(10) || '```python' || chr(10) || 'x = ' || turn || chr(10) || '```' WHEN 1 THEN 'def f():' || chr(10) || text ELSE '. ' || replace(replace(text, '=', '-'), chr(10), ' ') END AS text FROM conversations),
k AS (SELECT *, CASE WHEN regexp_matches(text, '(?s)```(?:[A-Za-z0-9_+.-]+)?\s*\n(.*?)```') THEN 'fenced'
  WHEN regexp_matches(text, '(?m)^\s*(?:def |class |from |import |return\b|print\(|for\b|if\b|while\b|[A-Za-z_]\w*\s*=)') THEN 'raw' ELSE 'no_code' END AS extraction FROM t)
SELECT conv_id, turn, extraction, sha256(CASE extraction WHEN 'fenced' THEN trim(regexp_extract(text, '(?s)```(?:[A-Za-z0-9_+.-]+)?\s*\n(.*?)```', 1), chr(10) || chr(13)) WHEN 'raw' THEN trim(text, chr(10) || chr(13)) END) AS code_sha256 FROM k
""")
def code_extraction(spark, d):
    t, third = F.col("text"), F.col("conv_id") % 3
    made = F.when(third == 0, F.concat(t, F.lit("\n```python\nx = "), F.col("turn"), F.lit("\n```"))).when(third == 1, F.concat(F.lit("def f():\n"), t)).otherwise(F.concat(F.lit(". "), F.translate(t, "=\n", "- ")))
    found = table(spark, d, "conversations").select("conv_id", "turn", text.extract_code(made).alias("x"))
    return found.select("conv_id", "turn", "x.extraction", F.sha2("x.code", 256).alias("code_sha256"))


@register("context_buckets", """
WITH n AS (SELECT greatest(n_chars // 4, 0) AS n FROM documents)
SELECT CASE WHEN n <= 1 THEN 1 ELSE (1::BIGINT << length(bin(n - 1))::BIGINT) END AS bucket, count(*) AS n_docs FROM n GROUP BY 1
""")
def context_buckets(spark, d):
    return table(spark, d, "documents").groupBy(scalars.next_power_of_two(F.floor(F.col("n_chars") / 4)).alias("bucket")).agg(F.count("*").alias("n_docs"))


@register("patch_leak_lines", """
WITH j AS (SELECT d.doc_id, d.text AS patch, b.text AS description FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40),
l AS (SELECT doc_id, trim(unnest(string_split(patch || chr(10) || substr(description, 1, 40 + (doc_id % 2)::INT * 20), chr(10)))) AS line, description FROM j)
SELECT doc_id, count(DISTINCT line) AS n_leaked FROM l WHERE length(line) >= 24 AND contains(lower(description), lower(line)) GROUP BY doc_id
""")
def patch_leak_lines(spark, d):
    """Lines of a patch that its description gives away."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("description"))
    docs = table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % 40).join(items, "item_id")
    patch = F.concat("text", F.lit("\n"), F.substring(F.col("description"), F.lit(1), (40 + F.col("doc_id") % 2 * 20).cast("int")))
    leaks = docs.select("doc_id", F.size(text.leaked_lines(patch, F.col("description"))).cast("long").alias("n_leaked"))
    return leaks.filter("n_leaked > 0")


@register("failure_priorities", """
WITH f AS (SELECT doc_id, doc_id % 15 + 1 AS r, (['invented_api', 'typo', 'loop_after_correct'])[doc_id % 3 + 1] AS t, quality = 1 AS v, toxic = 1 AS c FROM labels)
SELECT doc_id, 1.0 + least(r - 1, 10) * 0.5 + (t IN ('invented_api', 'loop_after_correct'))::INT * 2.0 + v::INT * 2.0 + c::INT * 1.0 AS priority FROM f
""")
def failure_priorities(spark, d):
    kind = F.element_at(F.array(F.lit("invented_api"), F.lit("typo"), F.lit("loop_after_correct")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, d, "labels").select("doc_id", scalars.failure_priority(F.col("doc_id") % 15 + 1, kind, F.col("quality") == 1, F.col("toxic") == 1).alias("priority"))


@register("learning_rates", """
SELECT s AS step, round(CASE WHEN s < 100 THEN (s + 1) / 100.0 * 0.0003 ELSE (0.1 + 0.9 * 0.5 * (1 + cos(pi() * least((s - 100) / 900.0, 1.0)))) * 0.0003 END, 12) AS rate FROM range(0, 1200) t(s)
""")
def learning_rates(spark, d):
    return spark.range(1200).select(F.col("id").alias("step"), F.round(scalars.learning_rate(F.col("id"), 3e-4, 100, 1000, 0.1), 12).alias("rate"))


@register("size_projection", """
SELECT l AS layers, w AS width, l * (4 * w * w + 8 * w * w + 2 * w) + 32000 * w + w AS parameters FROM (SELECT unnest([8, 16, 24])::BIGINT AS l), (SELECT unnest([256, 512, 1024])::BIGINT AS w)
""")
def size_projection(spark, d):
    """Parameters over a grid of depths and widths."""
    grid = spark.range(1).select(F.explode(F.array(F.lit(8), F.lit(16), F.lit(24)).cast("array<long>")).alias("layers")).select("layers", F.explode(F.array(F.lit(256), F.lit(512), F.lit(1024)).cast("array<long>")).alias("width"))
    return grid.withColumn("parameters", scalars.parameter_count(F.col("layers"), F.col("width"), F.lit(32000).cast("long")))


@register("loss_units", """
SELECT event_type, round(avg(exp(value / 100)), 6) AS perplexity, round(avg(value / ln(2)), 6) AS bits FROM events GROUP BY 1
""")
def loss_units(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(scalars.perplexity_ratio(F.col("value") / 100)), 6).alias("perplexity"), F.round(F.avg(scalars.nats_to_bits(F.col("value"))), 6).alias("bits"))


@register("head_tail_truncation", f"""
WITH t AS (SELECT doc_id, {LEXEMES} AS w FROM documents)
SELECT doc_id, sha256(array_to_string(CASE WHEN len(w) <= 31 THEN w ELSE list_concat(w[1:15], w[len(w) - 15:len(w)]) END, ' ')) AS kept_sha256 FROM t
""")
def head_tail_truncation(spark, d):
    kept = scalars.head_tail(text.lexemes(F.col("text")), 31)
    return table(spark, d, "documents").select("doc_id", F.sha2(F.array_join(kept, " "), 256).alias("kept_sha256"))


@register("home_redaction")
def home_redaction(spark, d):
    """User folders out of texts; needs look-behind, which DuckDB lacks."""
    made = F.concat(F.lit("see /home/someone/x and C:\\Users\\Some One\\y: "), F.substring("text", 1, 40))
    return table(spark, d, "conversations").select("conv_id", "turn", text.redact_home(made).alias("text"))


@register("stop_scope_metrics", """
SELECT count(*) FILTER (WHERE quality = 1 AND doc_id % 2 = 0 AND toxic = 0) AS premature_stop, count(*) FILTER (WHERE quality = 1 AND doc_id % 2 <> 0 AND toxic = 1) AS missed_stop,
  count(*) FILTER (WHERE quality = 1 AND doc_id % 2 = 0 AND toxic = 1) AS correct_stop FROM labels
""")
def stop_scope_metrics(spark, d):
    found = scalars.stop_metrics(F.col("quality") == 1, F.col("doc_id") % 2 == 0, F.col("toxic") == 1)
    return table(spark, d, "labels").agg(*[F.count_if(c).alias(n) for n, c in found.items()])


@register("outcome_mapping", """
WITH o AS (SELECT (['pass', 'wrong', 'syntax_error', 'timeout', 'no_code'])[doc_id % 5 + 1] AS o, toxic = 1 AS v, quality = 1 AS strict, doc_id % 3 = 0 AS rep FROM labels),
m AS (SELECT *, CASE WHEN v THEN 'EXPLICIT_CONSTRAINT_VIOLATION' WHEN o = 'pass' THEN 'TARGET_PASS' WHEN o = 'wrong' THEN 'WRONG_ANSWER' WHEN o = 'syntax_error' THEN 'SYNTAX_ERROR' WHEN o = 'timeout' THEN 'TIMEOUT' ELSE 'INCOMPLETE' END AS t FROM o)
SELECT array_to_string(list_filter([t, CASE WHEN strict THEN 'STRICT_FULL_OUTPUT_PASS' END, CASE WHEN rep THEN 'REPETITION' END], lambda x: x IS NOT NULL), '|') AS labels, count(*) AS n FROM m GROUP BY 1
""")
def outcome_mapping(spark, d):
    """One outcome and further labels for each result."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("pass", "wrong", "syntax_error", "timeout", "no_code")]), (F.col("doc_id") % 5 + 1).cast("int"))
    labels = F.array_compact(F.array(scalars.target_outcome(name, F.col("toxic") == 1), F.when(F.col("quality") == 1, "STRICT_FULL_OUTPUT_PASS"), F.when(F.col("doc_id") % 3 == 0, "REPETITION")))
    return table(spark, d, "labels").groupBy(F.array_join(labels, "|").alias("labels")).agg(F.count("*").alias("n"))


@register("continuation_kinds", r"""
WITH t AS (SELECT conv_id % 4 > 0 AS complete, CASE conv_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN chr(10) || 'def g(): pass' ELSE text END AS tail, conv_id % 7 = 0 AS rep, conv_id % 11 = 0 AS dam, conv_id % 13 = 0 AS ov FROM conversations)
SELECT CASE WHEN NOT complete THEN 'no_complete_target' WHEN trim(tail) = '' THEN 'none' WHEN rep THEN 'repetition_after_target' WHEN dam THEN 'syntax_damage_after_target' WHEN ov THEN 'target_redefined_after_correct'
 WHEN regexp_matches(tail, '(?m)^\s*(?:async\s+)?def\s+') THEN 'additional_definition' ELSE 'other_trailing_content' END AS kind, count(*) AS n FROM t GROUP BY 1
""")
def continuation_kinds(spark, d):
    c = F.col("conv_id")
    tail = F.when(c % 5 == 0, "  ").when(c % 5 == 1, "\ndef g(): pass").otherwise(F.col("text"))
    kind = scalars.continuation_kind(c % 4 > 0, tail, c % 7 == 0, c % 11 == 0, c % 13 == 0)
    return table(spark, d, "conversations").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
