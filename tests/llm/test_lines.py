from collections import defaultdict

from pyspark.sql import functions as F

from sievelake.llm import lines, queries
from tests.oracle import compare

SF = "/root/testdata/sf0.01"


def brute(rows, min_sites):
    """(id, site, text) rows to texts."""
    sites, first = defaultdict(set), {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, site, text in order:
        for pos, line in enumerate((text or "").split("\n")):
            kernel = line.strip("\t\v\f\r ")
            if kernel:
                sites[kernel] |= {site} - {None}
                first.setdefault(kernel, (i, text, pos))
    out = []
    for i, _, text in rows:
        kept = [
            line for pos, line in enumerate((text or "").split("\n"))
            if not (k := line.strip("\t\v\f\r ")) or len(sites[k]) < min_sites or first[k] == (i, text, pos)
        ]
        out.append((i, None if text is None else "\n".join(kept)))
    return out


def test_against_brute_force(spark):
    rows = []
    for i in range(60):
        own = [f"line {i} {k}" for k in range(3)]
        shared = [f"shared {k}" for k in range(40) if i % (k + 2) == 0]
        rows.append((i if i % 17 else None, f"s{i % 23}" if i % 7 else None, "\n".join([*own, "", *shared, " menu \r", own[0]])))
    rows += [(70, "a", None), (71, "b", ""), (72, "c", "menu"), (72, "c", "menu"), (3, "z", "menu\nmenu\n\n x"), (74, None, "\n")]
    rows = [r for i, r in enumerate(rows) if r[0] is not None or i in (17,)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, pos int, dropped_lines string")
    out = lines.dedup_lines(docs, min_sites=5)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(brute(rows, 5), key=str)


def test_near_threshold_is_exact(spark):
    docs = spark.range(0, 400).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id")).alias("source"),
        F.array_join(F.transform(F.sequence(F.lit(90), F.lit(110)), lambda k: F.when(F.col("id") < k, F.concat(F.lit("on "), k)).otherwise(F.concat(F.lit("own "), F.col("id"), F.lit(" "), k))), "\n").alias("text"),
    )
    known = lines.boilerplate(lines.occurrences(docs, "doc_id", "text", "source"), min_sites=100)
    assert known.count() == 11


def test_one_line_on_every_page(spark, monkeypatch):
    """A line that a third of all rows hold is broadcast; others are met in the shuffle."""
    monkeypatch.setattr(lines.join_counted, "__defaults__", (4,))
    rows = [(i, f"s{i % 23}", "\n".join([f"own {i}", "menu", *[f"shared {k}" for k in range(5) if i % (k + 2) == 0]])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert sorted(((r.doc_id, r.text) for r in lines.dedup_lines(docs, min_sites=5).collect()), key=str) == sorted(brute(rows, 5), key=str)


def test_very_long_text(spark):
    body = "\n".join(f"line {i}" for i in range(60_000))
    rows = [(1, "a", body), *[(i, f"s{i}", f"line {i}\nline 59999") for i in range(2, 14)]]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert sorted(((r.doc_id, r.text) for r in lines.dedup_lines(docs).collect()), key=str) == sorted(brute(rows, 10), key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert lines.dedup_lines(docs).count() == 0


def test_sql(spark):
    assert compare(spark, queries.op5_line_spread, queries.oracle_sql()["op5_line_spread"], SF) == 1000
