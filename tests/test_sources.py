import struct
import subprocess

import pytest
from pyspark.sql import functions as F

from sievelake.operators import records, select
from sievelake.sources import readers, writers


def write(path, body, mode="w"):
    with open(path, mode) as f:
        f.write(body)
    return str(path)


def test_json_readers(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"a": 1}\n\n{"a": 2}\n{bad\n')
    assert readers.json_lines(spark, path, "a long", tolerant=True).count() == 2
    with pytest.raises(Exception):
        readers.json_lines(spark, path, "a long").collect()


def test_bounded_json(spark, tmp_path):
    row = '{"source":"s","source_url":"u","revision":"r","license":"%s","text":"hello"}\n'
    path = write(tmp_path / "b.jsonl", row % "MIT" * 3)
    assert readers.bounded_json(spark, path, 15).count() == 3
    for body, most in ((row % "MIT" * 3, 14), (row % "GPL-3.0", 99), ('{"source":"s"}\n', 99)):
        with pytest.raises(ValueError):
            readers.bounded_json(spark, write(tmp_path / "c.jsonl", body), most)


def test_durable_tail(spark, tmp_path):
    path = write(tmp_path / "log.jsonl", '{"a": 1}\n{"a": 2}\n{"a": 3')
    done, pending = readers.durable_json(spark, path, "a long")
    assert sorted(r.a for r in done.collect()) == [1, 2] and [r.pending for r in pending.collect()] == ['{"a": 3']


def test_csv_and_junit(spark, tmp_path):
    assert readers.csv_rows(spark, write(tmp_path / "x.csv", "a,b\n1,2\n")).collect() == [("1", "2")]
    body = '<testsuites><testsuite tests="3" failures="1" errors="0"/><testsuite tests="4" failures="0" errors="2"/></testsuites>'
    assert tuple(readers.junit_totals(spark, write(tmp_path / "x.xml", body)).first()) == (7, 1, 2)


def test_json_fields_at_any_depth(spark):
    deep = '"end"'
    for i in range(14):
        deep = '{"answer": "level %d", "x": [%s]}' % (i, deep)
    rows = spark.createDataFrame([(1, deep), (2, '{"answer": ["not", {"answer": 5}], "prompt": null}'), (3, "{bad"), (4, None), (5, '[{"prompt": "p"}]'), (6, '"answer"')], "k long, body string")
    got = sorted((r.k, r.label, r.value) for r in readers.json_fields(rows, "k", "body", ["answer", "prompt"]).collect())
    assert got == sorted([(1, "answer", f"level {i}") for i in range(14)] + [(5, "prompt", "p")])
    assert readers.json_fields(rows.limit(0), "k", "body", ["answer"]).count() == 0


def test_traces(spark, tmp_path):
    record = struct.pack("<ii2i2f", 1, 5, 3, 4, 0.75, 0.25)
    write(tmp_path / "t.bin", record * 3, "wb")
    files = spark.read.format("binaryFile").load(str(tmp_path / "t.bin"))
    rows = readers.traces(files, 2).collect()
    assert [(r.n, r.layer, r.token, r.experts) for r in rows] == [(i, 1, 5, [3, 4]) for i in range(3)]
    write(tmp_path / "u.bin", record + b"x", "wb")
    with pytest.raises(Exception, match="inside a record"):
        readers.traces(spark.read.format("binaryFile").load(str(tmp_path / "u.bin")), 2).collect()


def test_git_blobs(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    git("init", "-q")
    write(tmp_path / "b.txt", "two\n")
    write(tmp_path / "a.txt", "one\r\n")
    git("add", "-A")
    git("commit", "-qm", "x")
    write(tmp_path / "a.txt", "not committed")
    rows = readers.git_blobs(spark, spark.createDataFrame([("r", str(tmp_path), "HEAD")], "repository string, folder string, revision string")).collect()

    assert [r.path for r in rows] == ["a.txt", "b.txt"] and rows[1].content == b"two\n" and b"not" not in rows[0].content


def test_writers(spark, tmp_path):
    rows = spark.range(10).select("id", (F.col("id") % 2).alias("split"))
    writers.write_once(rows, f"{tmp_path}/once")
    with pytest.raises(Exception):
        writers.write_once(rows, f"{tmp_path}/once")
    for n in (10, 5):
        writers.replace(rows.limit(n), f"{tmp_path}/r")
        assert spark.read.parquet(f"{tmp_path}/r").count() == n
    writers.sorted_manifest(rows, "id", f"{tmp_path}/m")
    with pytest.raises(ValueError):
        writers.sorted_manifest(rows, "split", f"{tmp_path}/m2")
    writers.record_shards(rows.coalesce(1), f"{tmp_path}/s", 4)
    assert sorted(r.n for r in spark.read.json(f"{tmp_path}/s").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()) == [2, 4, 4]
    writers.spill_partitions(rows, f"{tmp_path}/p", ["split"])
    assert spark.read.parquet(f"{tmp_path}/p").filter("split = 1").count() == 5
    writers.wide_csv(rows.withColumn("x", F.lit(None).cast("string")), f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").filter("x = 'null'").count() == 10


def test_object_store(spark, tmp_path):
    rows = spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "content binary")
    assert [writers.put_objects(rows, f"{tmp_path}/cas"), writers.put_objects(rows, f"{tmp_path}/cas")] == [2, 0]
    stored = spark.read.parquet(f"{tmp_path}/cas")
    keys = rows.select(F.sha2("content", 256).alias("key")).distinct()
    assert sorted(bytes(r.content) for r in readers.verified_objects(stored, keys).collect()) == [b"a", b"b"]
    bad = stored.withColumn("content", F.lit(b"z"))
    with pytest.raises(Exception, match="digest"):
        readers.verified_objects(bad, keys).collect()


def test_token_shards(spark):
    import hashlib

    ids = list(range(250, 268))
    docs = spark.createDataFrame([(0, ids[:11]), (11, ids[11:])], "start long, ids array<int>")
    got = {r.shard: (r.n_tokens, r.sha256) for r in writers.token_shards(docs, 7).collect()}
    want = {i: (len(ids[i * 7 : i * 7 + 7]), hashlib.sha256(b"".join(x.to_bytes(2, "little") for x in ids[i * 7 : i * 7 + 7])).hexdigest()) for i in range(3)}
    assert got == want


def test_offsets_and_pairs(spark):
    rows = spark.createDataFrame([(i, "k", i % 4) for i in range(50)], "i long, k string, n long")
    got = {r.i: r.start for r in select.running_offsets(rows, ["k"], "i", F.col("n"), parts=5).collect()}
    assert got == {i: sum(j % 4 for j in range(i)) for i in range(50)}
    pairs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "i long, p string")
    assert sorted(r.i for r in records.complete_pairs(pairs, "p").collect()) == [1, 2, 4]


def test_ingest_stops(spark):
    files = spark.createDataFrame([("a", '{"x":1}\n\n{"x":2}\n{"x":3'), ("b", "ok\n" + "y" * 50 + "\nlater\n"), ("c", "no end"), ("d", ""), ("e", None), ("f", "z" * 50 + "\nq\n")], "path string, body string")
    got = sorted((r.path, r.line, r.json) for r in readers.ingested_lines(files, 20).collect())
    assert got == [("a", 0, '{"x":1}'), ("a", 2, '{"x":2}'), ("b", 0, "ok")]


def test_resumed_shards(spark, tmp_path):
    rows = spark.range(25).withColumnRenamed("id", "k")
    path = str(tmp_path / "out")
    assert [writers.resumed_shards(r, path, "k", 4) for r in (rows.filter("k < 10"), rows.filter("k < 10"), rows, rows.limit(0))] == [10, 0, 15, 0]
    assert sorted(r.k for r in spark.read.json(path).collect()) == list(range(25))
    assert max(len(p.read_text().splitlines()) for p in (tmp_path / "out").glob("part-*")) <= 4


def test_streaming_log_holds_back_the_tail(spark, tmp_path):
    from sievelake.streaming import streams

    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "1.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": 3')
    (folder / "2.jsonl").write_text('{"a": 4}\n')
    made = streams.drain(streams.durable_records(streams.log_stream(spark, str(folder)), "a long"))
    assert sorted(r.a for r in made.collect()) == [1, 2, 4]
