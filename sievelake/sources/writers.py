"""Writers that never overwrite what they should not, and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_once(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Fails if something is there."""
    rows.write.mode("errorifexists").format(kind).save(path)


def replace(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replaces a dataset when all of it is written: the new files go beside it first."""
    spark, staging = rows.sparkSession, f"{path}.staging"
    rows.write.mode("overwrite").format(kind).save(staging)
    jvm = spark._jvm.org.apache.hadoop.fs
    target, made = jvm.Path(path), jvm.Path(staging)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm.Path(f"{path}.old")
    files.delete(old, True)
    if files.exists(target):
        files.rename(target, old)
    if not files.rename(made, target):
        raise OSError(f"could not move {staging} to {path}")
    files.delete(old, True)


def sorted_manifest(rows: DataFrame, key: str, path: str) -> None:
    """Rows in order of a key that must not repeat, in files that follow one another."""
    if rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        raise ValueError(f"{key} repeats")
    rows.orderBy(key).write.mode("errorifexists").json(path)


def record_shards(rows: DataFrame, path: str, most: int) -> None:
    rows.write.option("maxRecordsPerFile", most).mode("errorifexists").json(path)


def resumed_shards(rows: DataFrame, path: str, key: str, most: int) -> int:
    """Adds the rows whose key no finished shard of the folder holds, in further shards of ``most`` records at most; returns how
    many. A run that broke off left whole shards or nothing, so the next one goes on where it ended."""
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(place) and files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")):
        kind = dict(rows.dtypes)[key]
        done = spark.read.schema(f"`{key}` {kind}").json(path).select(key).distinct()
        rows = rows.join(done, key, "left_anti").select(*rows.columns)
    n = rows.count()
    if n:
        rows.write.option("maxRecordsPerFile", most).mode("append").json(path)
    return n


def spill_partitions(rows: DataFrame, path: str, keys: list[str]) -> None:
    rows.write.partitionBy(*keys).mode("errorifexists").parquet(path)


def wide_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("nullValue", "null").mode("errorifexists").csv(path)


def put_objects(contents: DataFrame, path: str) -> int:
    """Adds contents that a content-addressed folder lacks, by digest; returns how many. Twice is as once."""
    spark = contents.sparkSession
    keyed = contents.select(F.sha2("content", 256).alias("key"), "content").dropDuplicates(["key"]).withColumn("prefix", F.substring("key", 1, 2))
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    if store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        keyed = keyed.join(spark.read.parquet(path).select("key"), "key", "left_anti")
    keyed = keyed.select("key", "content", "prefix")
    n = keyed.count()
    if n:
        keyed.write.mode("append").partitionBy("prefix").parquet(path)
    return n


def references(contents: DataFrame) -> DataFrame:
    """Digest and size without the payload."""
    return contents.select(F.sha2("content", 256).alias("key"), F.octet_length("content").alias("size"), F.lit(False).alias("payload_retained"))


def token_shards(offsets: DataFrame, shard_tokens: int) -> DataFrame:
    """``shard``, ``n_tokens``, ``sha256`` of the little-endian 16-bit ids of each shard, from documents (start, ids).
    Ids are dealt to their shards; a shard's size bounds what one task holds."""
    flat = offsets.select("start", F.posexplode("ids").alias("i", "id")).withColumn("pos", F.col("start") + F.col("i"))
    shards = flat.groupBy(F.floor(F.col("pos") / shard_tokens).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("t"))
    hexed = F.array_join(F.transform("t", lambda x: F.concat(F.lpad(F.hex(x["id"] % 256), 2, "0"), F.lpad(F.hex(F.floor(x["id"] / 256)), 2, "0"))), "")
    return shards.select("shard", F.size("t").alias("n_tokens"), F.sha2(F.unhex(hexed), 256).alias("sha256"))


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
