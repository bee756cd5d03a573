import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sievelake.llm import packing, quality, simhash
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_quality import verdict

SF = "/root/testdata/sf0.001"


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b) if a or b else True


def brute(rows):
    """(id, source, text) rows to kept (id, text), stage by stage, by plain pairwise comparison."""
    rows = [r for r in rows if verdict(r[2])]
    sources = {i: s for i, s, _ in rows}
    texts = sorted(brute_lines(rows, 10))
    grams = []
    for _, t in texts:
        words = t.encode().lower().split()
        grams.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if group[i] != group[j] and similar(grams[i], grams[j]):
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    assert sources
    return [texts[i] for i in range(len(texts)) if group[i] == i]


def test_pipeline_against_brute_force(spark):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t in brute(rows)}
    got: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got.keys() == want.keys()
    for i, pieces in got.items():
        pieces.sort(key=lambda r: r.start)
        assert np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist() == want[i]
        assert [p.length for p in pieces] == packing.piece_lengths(len(want[i]), 1024)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_next = stage(spark, docs, SF)
        assert docs_next.columns == docs.columns and docs_next.dtypes == docs.dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "packing"]


def test_edges_from_end_to_end(spark):
    """Nulls in every column, repeats, empty and very long texts, clashing names; and an empty table."""
    words = [f"{a}{b}" for a in "abcdefghijkl" for b in ("an", "el", "or", "ith", "ume", "yst", "ack", "oft")]
    prose = lambda k, n: " ".join(random.Random(k).choices(words, k=n))
    long = " ".join(prose(k, 90) + f" tail {k * k}" for k in range(700))
    rows = [(1, prose(1, 80), "s1"), (1, prose(1, 80), "s1"), (None, prose(5, 80), None), (None, prose(5, 80), "s2"), (4, None, "s"), (5, "", None), (6, "few words", "s"), (7, long, "s3"), (8, prose(11, 300), None)]
    docs = spark.createDataFrame([(*r, r[1], "x", 3) for r in rows], "doc_id long, text string, source string, _a string, `0` string, size int")
    judged, out = {(r.doc_id, r.n_words): r.kept for r in quality.quality(docs).collect()}, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.dtypes == docs.dtypes
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = {(i, t) for i, t, _ in rows if t and judged[i, len(t.split())]}
    assert kept == sorted(want, key=str) and len(kept) >= 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, out, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(p.length for p in pieces) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in kept)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_keep_one_edges(spark):
    base = " ".join(f"w{i}" for i in range(300))
    near = base.replace("w150", "other")
    rows = [(4, base, "x"), (2, near, "y"), (None, base, "z"), (9, None, "a"), (8, "", "b"), (7, "c", "c"), (7, "c", "d"), (7, "unlike the others", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _a string")
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(2, near), (7, "c"), (7, "unlike the others"), (8, "")]
    assert simhash.keep_one(docs.limit(0)).count() == 0
