"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from sievelake.functions.hashing import sha256_hex
from sievelake.functions.text import normalize
from sievelake.session import work_dir
from sievelake.sources.readers import ingested_lines


def folder_stream(spark: SparkSession, path: str, kind: str = "parquet", per_batch: int = 1) -> DataFrame:
    """New files of a folder; the checkpoint remembers what was read. The last character as a class makes the path a
    pattern, which may also name a single file."""
    schema = spark.read.format(kind).load(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(kind).load(f"{path[:-1]}[{path[-1]}]")


def streaming_dedup(stream: DataFrame, body: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """The first row of each normalised text, for ever or within a watermark on (column, delay)."""
    keyed = stream.withColumn("digest", sha256_hex(normalize(F.col(body))))
    if watermark:
        return keyed.withWatermark(*watermark).dropDuplicatesWithinWatermark(["digest"])
    return keyed.dropDuplicates(["digest"])


def sampled_windows(stream: DataFrame, at: str, seconds: int = 30, late: str = "10 minutes") -> DataFrame:
    """Counts and means by tumbling window and kind of event."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    grouped = timed.groupBy(F.window(at, f"{seconds} seconds").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def running_quality(stream: DataFrame) -> DataFrame:
    """Sums and counts that each batch updates."""
    return stream.groupBy("event_type").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def collapse_signals(stream: DataFrame, threshold: float, run: int) -> DataFrame:
    """``user_id``, ``longest``: the longest run of values under the threshold so far, by user; kept as state."""

    def update(key, frames, state):
        now, longest = state.get if state.exists else (0, 0)
        for value in pd.concat(list(frames)).sort_values("event_id")["value"]:
            now = now + 1 if value < threshold else 0
            longest = max(longest, now)
        state.update((now, longest))
        yield pd.DataFrame({"user_id": [key[0]], "longest": [longest], "collapsed": [longest >= run]})

    return stream.groupBy("user_id").applyInPandasWithState(update, "user_id long, longest int, collapsed boolean", "now int, longest int", "update", GroupStateTimeout.NoTimeout)


def log_stream(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """``path``, ``body``: new segments of a log, each whole."""
    read = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_batch).load(path)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def durable_records(stream: DataFrame, schema: str) -> DataFrame:
    """``path``, ``line`` and the records of finished lines; an unfinished last line is held back, a bad finished one aborts."""
    return ingested_lines(stream, 1 << 30).select("path", "line", F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("path", "line", "r.*")


def lease_timers(stream: DataFrame, lease_seconds: float, late: str = "0 seconds") -> DataFrame:
    """``task``, ``status``, ``owner``, ``n_leases``, ``at`` after each change, from events (task, at timestamp, event, kind, owner).

    A lease holds for ``lease_seconds`` of event time. A timer ends it when the
    watermark passes its end, with no further event of the task; an event after
    the end finds the task pending as well. Only the owner of a running lease
    completes a task. State is one small row a task. Events with null tasks or
    times are dropped; events of one time go by their number.
    """

    def update(key, frames, state):
        status, owner, until, leases = state.get if state.exists else ("pending", None, 0, 0)
        changes = []
        if state.hasTimedOut:
            if status == "leased":
                status, owner = "pending", None
                changes.append((status, owner, leases, until))
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "event"])
            for at, kind, who in zip((rows["at"].astype("int64") // 10**3 if str(rows["at"].dtype).endswith("[ns]") else rows["at"].astype("datetime64[us]").astype("int64")), rows["kind"], rows["owner"]):
                if status == "leased" and until <= at:
                    status, owner = "pending", None
                    changes.append((status, owner, leases, until))
                if kind == "lease" and status == "pending":
                    status, owner, until, leases = "leased", who, int(at + lease_seconds * 1e6), leases + 1
                elif kind == "complete" and status == "leased" and owner == who:
                    status = "done"
                else:
                    continue
                changes.append((status, owner, leases, int(at)))
        state.update((status, owner, until, leases))
        if status == "leased":
            state.setTimeoutTimestamp(max(until // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        made = pd.DataFrame(changes, columns=["status", "owner", "n_leases", "at"])
        made.insert(0, "task", key[0])
        made["change"] = range(len(made))
        made["at"] = pd.to_datetime(made["at"], unit="us", utc=True)
        yield made

    timed = stream.select("task", F.col("at").cast("timestamp").alias("at"), "event", "kind", "owner").filter("task IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    schema = "task long, status string, owner string, n_leases int, at timestamp, change int"
    return timed.groupBy("task").applyInPandasWithState(update, schema, "status string, owner string, until long, n_leases int", "update", GroupStateTimeout.EventTimeTimeout)


def after_cursor(rows: DataFrame, order: str, cursor: int, n: int) -> DataFrame:
    """The next n rows from a cursor: a resumed reader sees what an uninterrupted one sees."""
    return rows.filter(F.col(order) >= cursor).orderBy(order).limit(n)


def drain(stream: DataFrame, mode: str = "append", finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there and read what it wrote (for ``update``: every update, with its batch)."""
    spark = stream.sparkSession
    base = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    made = spark.read.parquet(out)
    return finish(made) if finish else made.drop("batch")
