import numpy as np
import pytest

from sievelake.llm import mih
from sievelake.llm.queries import op1_mih_neighbours


def brute(rows, every, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, v in usable:
        if q % every == 0:
            scored = sorted((-float((v * w).sum()), i) for i, w in usable if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_probing_finds_every_code_within_the_radius(monkeypatch):
    """Over all positions, probing meets every pair of codes within the radius, cell by cell."""
    monkeypatch.setattr(mih, "INDEX_BLOCK", 40)
    rng = np.random.default_rng(0)
    for dim in (64, 20, 5):
        vectors = rng.normal(size=(500, dim))
        codes = mih.Codes(vectors, 10)
        rows = codes.encode(vectors)
        asked = rows[::61]
        cells = mih.Cells(np.stack([np.bincount(c, minlength=256) for c in rows.T]))
        for radius in (0, 1, 3, 7, 8, 15, 24, 64):
            reaches = codes.reaches(radius)
            probed = cells.probed(reaches)
            met = [set() for _ in asked]
            for s in range(codes.bytes):
                if reaches[s] < 0:
                    continue
                for who, near in mih.probe(rows, asked, s, reaches[s]):
                    for q in who.tolist():
                        met[q] |= set(near.tolist())
                        assert set(cells.of[s, rows[near, s]].tolist()) <= set(probed[s][asked[q, s]].tolist())
            for q, code in enumerate(asked):
                want = np.flatnonzero(np.bitwise_count(rows ^ code).sum(axis=1) <= radius)
                assert set(want.tolist()) <= met[q]


def shares(vectors, k=20):
    """Shares of all rows that a query visits and reranks, and its recall, over a hundred queries."""
    codes = mih.Codes(vectors[: mih.SAMPLE], k, len(vectors))
    rows, reaches = codes.encode(vectors), codes.reaches(codes.radius)
    visited = reranked = hits = 0
    for q in range(0, len(vectors), len(vectors) // 100):
        bits = np.bitwise_count(rows ^ rows[q])
        visited += (bits <= np.array(reaches)).any(axis=1).mean()
        close = bits.sum(axis=1) <= codes.radius
        reranked += close.mean()
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits += close[np.argsort(-scores)[:k]].mean()
    n = len(range(0, len(vectors), len(vectors) // 100))
    return visited / n, reranked / n, hits / n


def test_clustered_vectors_are_pruned():
    """Where neighbours are near, most rows are never visited."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(400, 64))
    vectors = centres[rng.integers(0, 400, 20_000)] + 0.25 * rng.normal(size=(20_000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    visited, reranked, recall = shares(vectors)
    assert visited < 0.2 and reranked < 0.05 and recall >= 0.9


def test_hot_vectors_and_values(spark, monkeypatch):
    """A third of all rows share one vector, another third one byte of their codes."""
    for name, value in (("INDEX_BLOCK", 50), ("QUERY_BLOCK", 8), ("WANTED", 1.0)):
        monkeypatch.setattr(mih, name, value)
    monkeypatch.setattr(mih.join_counted, "__defaults__", (4,))
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 0.5, 0.0, -1.0, 0.25, 3.0, 1.0, 0.5, 0.125]) for i in range(400)]
    rows += [(i, (np.array([4.0] * 8 + [0.0, 0.0]) + 0.01 * rng.normal(size=10)).tolist() if i < 800 else rng.normal(size=10).tolist()) for i in range(400, 1200)]
    got = {}
    for r in mih.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows, 20, 5)
    assert got.keys() == want.keys()
    hits = sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want) and got[40] == [i for i, _ in want[40]]


def test_other_lengths_are_searched_among_themselves(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4 if i % 3 else 7).tolist()) for i in range(90)]
    monkeypatch.setattr(mih, "WANTED", 1.0)
    got = {}
    for r in mih.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in (0, 20, 40, 60, 80):
        assert got[q] == [i for i, _ in brute([r for r in rows if len(r[1]) == len(rows[q][1])], 20, 4)[q]]
    monkeypatch.setattr(mih, "MOST_LENGTHS", 1)
    with pytest.raises(ValueError):
        mih.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall_and_scores(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, vectors = brute(rows, 20, 20), dict(rows)
    got = {}
    for r in op1_mih_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert abs(r.score - float(np.dot(np.array(vectors[r.query_id], float), np.array(vectors[r.vec_id], float)))) < 1e-12
    assert got.keys() == want.keys()
    assert all([x[0] for x in v] == list(range(1, 21)) for v in got.values())
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_copies_ties_nulls_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(mih, "INDEX_BLOCK", 16)
    monkeypatch.setattr(mih, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 0.5, 0.0]) for i in range(0, 60)] + [(i, rng.normal(size=3).round(1).tolist()) for i in range(60, 100)]
    rows += [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 0.0]), (160, [float("nan"), 1.0, 0.0]), (180, [float("inf"), 1.0, 0.0]), (None, [1.0, 1.0, 1.0]), (200, [])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    monkeypatch.setattr(mih, "WANTED", 1.0)
    got = {}
    for r in mih.nearest(frame, 20, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 20, 20)
    for q in (0, 20, 40):
        assert got[q] == [i for i, _ in want[q]]
    assert got.keys() == want.keys()
    few = frame.filter("vec_id < 5")
    assert [(r.rank, r.vec_id) for r in mih.nearest(few, 20, 20).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert mih.nearest(frame.limit(0)).count() == 0
    assert mih.nearest(frame.filter("vec_id = 0")).count() == 0
