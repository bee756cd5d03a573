"""Readers with the guards that corpora need."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.session import materialize

PROVENANCE = ["source", "source_url", "revision", "license", "text"]
LICENSES = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC0-1.0", "Unlicense"]


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, tolerant: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped. ``tolerant`` drops bad lines, otherwise one aborts the read."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def bounded_json(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """JSON records with provenance; aborts past the byte budget, on a missing key or a licence that isn't allowed."""
    rows = spark.read.schema(", ".join(f"{c} string" for c in PROVENANCE)).json(path)
    missing = F.lit(False)
    for c in PROVENANCE:
        missing = missing | F.col(c).isNull()
    facts = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(missing).alias("missing"), F.count_if(~F.col("license").isin(LICENSES)).alias("refused")).first()
    if (facts["bytes"] or 0) > max_bytes:
        raise ValueError(f"{facts['bytes']} bytes of text exceed the budget of {max_bytes}")
    if facts["missing"] or facts["refused"]:
        raise ValueError(f"{facts['missing']} records lack provenance, {facts['refused']} have a licence that is not allowed")
    return rows


def durable_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of finished lines of an append-only log, and the unfinished last line of each file.
    A bad line that a newline ends aborts."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("body"))
    cut = F.length("body") - F.length(F.substring_index("body", "\n", -1))
    parts = files.select("path", F.substring(F.col("body"), F.lit(1), cut).alias("done"), F.substring_index("body", "\n", -1).alias("pending"))
    lines = parts.select("path", F.posexplode(F.split("done", "\n")).alias("line", "json")).filter(F.trim("json") != "")
    parsed = F.from_json("json", schema, {"mode": "FAILFAST"})
    return lines.select("path", "line", parsed.alias("r")).select("path", "line", "r.*"), parts.filter("pending != ''").select("path", "pending")


def ingested_lines(files: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """``path``, ``line``, ``json`` of the lines of files (path, body) up to the first that is longer than ``most_bytes`` or not
    ended by a newline: what comes after either is not taken. Blank lines are skipped, null bodies have none."""
    lines = F.split("body", "\n")
    whole = F.slice(lines, F.lit(1), F.size(lines) - 1)
    too_long = F.array_position(F.transform(whole, lambda x: F.octet_length(x) > most_bytes), True)
    taken = F.when(too_long > 0, F.slice(whole, F.lit(1), (too_long - 1).cast("int"))).otherwise(whole)
    return files.select("path", F.posexplode(taken).alias("line", "json")).filter(F.trim("json") != "")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def junit_totals(spark: SparkSession, path: str) -> DataFrame:
    """Tests, failures and errors over the suites of JUnit reports."""
    suites = spark.read.format("xml").option("rowTag", "testsuite").schema("_tests long, _failures long, _errors long").load(path)
    return suites.agg(*[F.sum(f"_{c}").alias(c) for c in ("tests", "failures", "errors")])


def json_fields(rows: DataFrame, key: str, body: str, fields: list[str]) -> DataFrame:
    """``key``, ``label``, ``value`` of the strings under these names at any place of JSON documents, however deep.

    One level at a time; what holds further levels is written to the shared
    folder, until nothing does. Items of lists have no name of their own, so
    strings in them are not taken. Bad documents and nulls give no rows.
    """
    spark, level, found = rows.sparkSession, rows.select(F.col(key).alias("key"), F.col(body).alias("json")), None
    while True:
        parsed = level.select("key", F.try_parse_json("json").alias("v"))
        inside = spark.sql("SELECT h.key, e.key AS label, e.value AS v FROM {level} h, LATERAL variant_explode(h.v) e", level=parsed)
        strings = inside.filter(F.col("label").isin(fields) & (F.schema_of_variant("v") == "STRING"))
        hits = strings.select(F.col("key").alias(key), "label", F.try_variant_get("v", "$", "string").alias("value"))
        found = hits if found is None else found.unionAll(hits)
        json = inside.select("key", F.to_json("v").alias("json"))
        level = materialize(json.filter(F.substring("json", 1, 1).isin("{", "[")), "json-level")
        if not level.limit(1).count():
            return found


def traces(files: DataFrame, top_k: int) -> DataFrame:
    """``path``, ``n``, ``layer``, ``token``, ``experts``, ``weights`` of binary routing traces (path, content): for each dispatch
    two 32-bit integers, then k expert numbers and k weights, little-endian. A rest of fewer bytes aborts."""
    import numpy as np

    kind = np.dtype([("layer", "<i4"), ("token", "<i4"), ("experts", "<i4", (top_k,)), ("weights", "<f4", (top_k,))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(content) % kind.itemsize:
                    raise ValueError(f"{path} ends inside a record")
                rows = np.frombuffer(content, kind)
                if (rows["layer"] < 0).any() or (rows["experts"] < 0).any():
                    raise ValueError(f"{path} has negative numbers")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array(rows["layer"].astype("i4")), pa.array(rows["token"].astype("i4")),
                     pa.array(rows["experts"].tolist(), pa.list_(pa.int32())), pa.array(rows["weights"].tolist(), pa.list_(pa.float32()))],
                    names=["path", "n", "layer", "token", "experts", "weights"],
                )

    return files.select("path", "content").mapInArrow(run, "path string, n long, layer int, token int, experts array<int>, weights array<float>")


def verified_objects(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Contents of the wanted keys; one whose digest isn't its key aborts."""
    found = objects.join(wanted, "key")
    return found.withColumn("content", F.when(F.sha2("content", 256) == F.col("key"), F.col("content")).otherwise(F.raise_error(F.lit("content differs from its digest")).cast("binary")))


def verified_shards(files: DataFrame, manifest: DataFrame, schema: str) -> DataFrame:
    """Records of JSON-lines shards (path, content) that a manifest (path, sha256, records) names. A shard that is missing, whose
    digest differs or that holds another number of records aborts; blank lines are no records, a null content is a missing shard."""
    joined = manifest.join(files, "path", "left")
    lines = F.filter(F.split(F.decode("content", "utf-8"), "\n"), lambda x: F.trim(x) != "")
    fault = F.when(F.col("content").isNull(), "is missing").when(F.sha2("content", 256) != F.col("sha256"), "has another digest").when(F.size(lines) != F.col("records"), "has another number of records")
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("shard "), "path", F.lit(" "), fault)).cast("array<string>")).otherwise(lines)
    rows = joined.select("path", F.explode(checked).alias("line"))
    return rows.select("path", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("path", "r.*")


def capped_traces(spark: SparkSession, path: str, most: int = 1_000_000) -> DataFrame:
    """The first records of a routing trace in JSON lines (token, layers); an invalid one among them aborts."""
    from sievelake.operators.training_records import trace_valid

    rows = spark.read.schema("token long, layers map<string,array<long>>").json(path).limit(most)
    valid = trace_valid(F.col("token"), F.col("layers"))
    return rows.withColumn("token", F.when(valid, F.col("token")).otherwise(F.raise_error(F.lit("invalid routing record")).cast("long")))


def byte_ranges(objects: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges`` (key, byte_offset, byte_length) with the bytes they name."""
    return ranges.join(objects, "key").withColumn("part", F.substring(F.col("content"), (F.col("byte_offset") + 1).cast("int"), F.col("byte_length").cast("int"))).drop("content")


def export_check(records: DataFrame, expected_rows: int) -> DataFrame:
    """Rows, wrong headers, wrong raw and normalised digests of an export (repository, file_path, text, body, raw_sha256,
    normalized_sha256), and the digest of its inventory in order of path."""
    from sievelake.functions.text import header, normalize
    from sievelake.operators.digests import ordered_digest

    head = header(F.col("repository"), F.col("file_path"))
    inventory = ordered_digest(records, [], "file_path", F.concat(F.col("file_path"), F.lit("\0"), F.col("raw_sha256")))
    facts = records.agg(
        F.count("*").alias("n"), (F.count("*") == expected_rows).alias("complete"), F.count_if(~F.col("text").startswith(head)).alias("bad_headers"), F.count_if(F.sha2("body", 256) != F.col("raw_sha256")).alias("bad_raw"),
        F.count_if(F.sha2(normalize(F.col("body")), 256) != F.col("normalized_sha256")).alias("bad_normalized"),
    )
    return facts.crossJoin(inventory.withColumnRenamed("digest", "inventory"))


def synthetic(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """A seeded mixture of kinds of short documents; the same numbers give the same rows."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(100))
    kind = F.when(draw < 50, "code").when(draw < 80, "general").when(draw < 95, "technical").otherwise("context")
    words = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("id"), i), 256), 1, 5))
    return spark.range(n).select("id", kind.alias("kind"), F.array_join(words, " ").alias("text"))


def git_blobs(spark: SparkSession, repositories: DataFrame) -> DataFrame:
    """``repository``, ``path``, ``mode``, ``oid``, ``size``, ``content`` of the committed files at (repository, folder, revision).
    One Git process for each repository, on the executor that gets it; the folder must be on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import subprocess

        for batch in batches:
            for name, folder, revision in zip(*(c.to_pylist() for c in batch.columns)):
                listed = subprocess.run(["git", "-C", folder, "ls-tree", "-r", "-l", "-z", revision], check=True, capture_output=True).stdout
                entries = []
                for entry in filter(None, listed.split(b"\0")):
                    facts, _, path = entry.partition(b"\t")
                    mode, kind, oid, size = facts.split()
                    entries.append((path.decode("utf-8", "replace"), mode.decode(), kind.decode(), oid.decode(), int(size) if size.isdigit() else None))
                entries.sort()
                blobs = [e for e in entries if e[2] == "blob"]
                asked = "".join(f"{e[3]}\n" for e in blobs).encode()
                data, at = subprocess.run(["git", "-C", folder, "cat-file", "--batch"], input=asked, check=True, capture_output=True).stdout, 0
                for path, mode, _, oid, _ in blobs:
                    end = data.index(b"\n", at)
                    size = int(data[at:end].split()[2])
                    content, at = data[end + 1 : end + 1 + size], end + 2 + size
                    yield pa.RecordBatch.from_pylist([{"repository": name, "path": path, "mode": mode, "oid": oid, "size": size, "content": content}])

    return repositories.select("repository", "folder", "revision").mapInArrow(run, "repository string, path string, mode string, oid string, size long, content binary")
