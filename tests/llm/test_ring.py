from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievelake.llm import ring
from sievelake.llm.queries import op2_shard_ring


def rows(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"), F.lit(1).alias("shard"))


def check(out, shards):
    slots = {s: sorted(r.slot for r in out if r.shard == s) for s in range(shards)}
    assert all(v == list(range(len(v))) for v in slots.values())
    return [len(v) for v in slots.values()]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 1001])
def test_counts_differ_by_one(spark, n):
    out = ring.shard_documents(rows(spark, n), shards=8).collect()
    sizes = check(out, 8)
    assert len(out) == n and max(sizes) - min(sizes) <= 1


def brute(keys, points, room):
    """Keys one by one, arc by arc, each to the first shard with room."""
    used, at = Counter(), {}
    for arc in sorted(keys):
        for key in keys[arc]:
            k = arc
            while used[points[k % len(points)][1]] >= room[points[k % len(points)][1]]:
                k += 1
            at[key] = points[k % len(points)][1]
            used[at[key]] += 1
    return at


def test_overflow_goes_clockwise(spark):
    n, points = 400, ring.ring_points(4, 8)
    placed = rows(spark, n).withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(ring.RING))).withColumn("arc", ring.arc_of(F.col("place"), points))
    known = placed.collect()
    for r in known:
        assert r.arc == next((i for i, (p, _) in enumerate(points) if p >= r.place), 0)
    out = ring.shard_documents(rows(spark, n), shards=4, vnodes=8).collect()
    arc = {r.doc_id: r.arc for r in known}
    by_shard = Counter(brute({a: [k for k in arc if arc[k] == a] for a in set(arc.values())}, points, ring.capacities(n, 4, 0.0)).values())
    assert Counter(r.shard for r in out) == by_shard
    got = {a: Counter(r.shard for r in out if arc[r.doc_id] == a) for a in set(arc.values())}
    want = brute({a: [k for k in arc if arc[k] == a] for a in set(arc.values())}, points, ring.capacities(n, 4, 0.0))
    for a in got:
        assert got[a] == Counter(want[k] for k in arc if arc[k] == a)
    assert all(r.home_shard == points[arc[r.doc_id]][1] for r in out)


def test_slack_bounds_loads_and_limits_movement(spark):
    n = 4000
    small = {r.doc_id: r.shard for r in ring.shard_documents(rows(spark, n), shards=8, slack=0.25).collect()}
    grown = {r.doc_id: r.shard for r in ring.shard_documents(rows(spark, n), shards=9, slack=0.25).collect()}
    assert max(Counter(small.values()).values()) <= 1.25 * n / 8 + 1
    assert sum(small[k] != grown[k] for k in small) < 0.35 * n


def test_movement_without_slack(spark):
    """With exact capacities a shard more moves under a fifth of the rows (an ideal plan moves a ninth), and a hundredth more rows hardly any."""
    n = 20_000
    place = lambda rows_, shards: {r.doc_id: r.shard for r in ring.shard_documents(rows_, shards=shards).collect()}
    eight, nine, more = place(rows(spark, n), 8), place(rows(spark, n), 9), place(rows(spark, n + n // 100), 8)
    assert sum(eight[k] != nine[k] for k in eight) < 0.22 * n
    assert sum(eight[k] != more[k] for k in eight) < 0.02 * n


def test_equal_rows_hold_a_third(spark, monkeypatch):
    """Rows equal in id and text, or without an id, are ranked in parts; others keep their places whatever the partitions."""
    monkeypatch.setattr(ring, "EQUAL", 50)
    hot = spark.range(1500).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text")).union(spark.range(500).select(F.lit(None).cast("long"), F.lit(None).cast("string")))
    docs = hot.union(rows(spark, 3000).select("doc_id", "text").filter("doc_id != 5"))
    outs = [ring.shard_documents(d, shards=8).collect() for d in (docs.repartition(3), docs.repartition(5))]
    for out in outs:
        sizes = check(out, 8)
        assert len(out) == 4999 and max(sizes) - min(sizes) <= 1
        cells = Counter(r.slot for r in out if r.doc_id == 5)
        assert sum(cells.values()) == 1500
    first, second = ({r.doc_id: (r.shard, r.slot) for r in out if r.doc_id not in (5, None)} for out in outs)
    assert first == second


def test_nulls_repeats_and_hot_keys(spark):
    data = [(None, None), (None, "a"), (1, ""), (1, ""), (1, "é" * 5)] + [(7, f"t{i}") for i in range(40)]
    out = ring.shard_documents(spark.createDataFrame(data, "doc_id long, text string"), shards=3).collect()
    sizes = check(out, 3)
    assert sorted(sizes) == [15, 15, 15]
    assert sorted((r.doc_id or -1, r.size) for r in out)[:5] == [(-1, 1), (-1, 2), (1, 1), (1, 1), (1, 11)]


def test_query(spark):
    import zlib

    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op2_shard_ring(spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in out} == {k: (len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in text.items()}
    assert check(out, 8) == [25] * 8 and {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
