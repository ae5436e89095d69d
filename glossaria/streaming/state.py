"""Streams of file saves: debounce, throttle, tombstones, and an index that follows changed files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..operators.chains import greedy
from ..sources.scratch import small


def debounce(events: DataFrame, by: str, ts: str = "ts", gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """One row per burst: events of a key closer than the gap. Works on streams (append, with watermark) and tables."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    out = events.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def throttle(firings: DataFrame, by: str, ts: str = "ts", seconds: int = 300) -> DataFrame:
    """Of a key's firings, each that comes at least so long after the last one let through.

    A firing blocks the time behind it like an interval, so the greedy choice of intervals that don't overlap decides; a busy
    key is spread over blocks of its firings. Of rows at one time the least counts.
    """
    gap = seconds * 1_000_000
    rest = [c for c in firings.columns if c not in (by, ts)]
    edits = firings.where(F.col(by).isNotNull()).select(F.col(by).alias("file"), F.unix_micros(F.col(ts).cast("timestamp")).alias("start"), (F.unix_micros(F.col(ts).cast("timestamp")) + gap).alias("end"), F.struct(ts, *rest).alias("row"))
    chosen = greedy(edits, span=256 * gap)
    return chosen.select(*[F.col("file").alias(by) if c == by else F.col(f"row.{c}") for c in firings.columns])


def throttle_stream(events: DataFrame, by: str, ts: str = "ts", seconds: int = 300, late: str = "1 minute") -> DataFrame:
    """The same on a stream: the last time let through is the state of a key."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for x in frames:
            keep = []
            for t in sorted(x[ts]):
                now = int(t.timestamp() * 1000)
                if last is None or now - last >= seconds * 1000:
                    last = now
                    keep.append((key[0], t))
            yield pd.DataFrame(keep, columns=[by, ts])
        state.update((last,))

    schema = f"{by} {events.schema[by].dataType.simpleString()}, {ts} timestamp"
    return events.withWatermark(ts, late).groupBy(by).applyInPandasWithState(run, schema, "last long", "append", "NoTimeout")


def alive(keys: DataFrame, tombstones: DataFrame, now, suppress: str = "1 hour") -> DataFrame:
    """Keys without a tombstone (key, deleted_at) in the time before now."""
    return keys.join(tombstones.where(F.col("deleted_at") > now - F.expr(f"interval {suppress}")).select("key"), "key", "left_anti")


def purge(tombstones: DataFrame, now, keep: str = "24 hours") -> DataFrame:
    return tombstones.where(F.col("deleted_at") > now - F.expr(f"interval {keep}"))


def not_dirty(events: DataFrame, dirty: DataFrame, on: str) -> DataFrame:
    """Events whose file or folder has no uncommitted change (stream-static anti join)."""
    return events.join(small(dirty.select(on).distinct()), on, "left_anti")


def current(changes: DataFrame) -> DataFrame:
    """The rows in force after a log of (file, version, deleted, key, locale, value): each file's latest version."""
    w = Window.partitionBy("file")
    latest = changes.withColumn("_v", F.max("version").over(w)).where("version = _v").drop("_v")
    return latest.where("not deleted")


def follow(changes: DataFrame, path: str, checkpoint: str):
    """Keep a table of catalogue rows at a path in step with a stream of changed files: each batch replaces its files' rows.

    Versions of the table are folders by batch; a batch that is done again after a failure writes the same folder.
    """

    def upsert(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(batch.schema).parquet(f"{path}/{n - 1}") if n else spark.createDataFrame([], batch.schema)
        kept = old.join(batch.select("file").distinct(), "file", "left_anti")
        kept.unionByName(current(batch)).write.mode("overwrite").parquet(f"{path}/{n}")

    return changes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_changes(changes: DataFrame, path: str, checkpoint: str):
    """Keep what a stream of changed files says, batch by batch: a batch writes only the rows of its own files, deletions too.

    A batch that is done again after a failure overwrites its own folder, and one that fails halfway leaves nothing that
    latest() reads, so neither changes what other batches wrote.
    """

    def append(batch: DataFrame, n: int) -> None:
        newest = batch.withColumn("_v", F.max("version").over(Window.partitionBy("file"))).where("version = _v").drop("_v")
        newest.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows in force in the folder of log_changes(): each file's rows of its last batch, without deleted files."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    last = rows.groupBy("file").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["file", "batch"], "left_semi").where("not deleted").select(*schema.fieldNames())


def compact(spark: SparkSession, path: str, schema: StructType, upto: int) -> None:
    """Put the rows in force after a batch into one folder, that batch's, in the place of all earlier ones; later batches stay."""
    from ..sources.sinks import swapped

    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    old = rows.where(F.col("batch") <= upto)
    last = old.groupBy("file").agg(F.max("batch").alias("batch"))
    kept = old.join(last, ["file", "batch"], "left_semi").where("not deleted").withColumn("batch", F.lit(upto).cast("long")).unionByName(rows.where(F.col("batch") > upto))
    swapped(spark, path, lambda staged: kept.write.partitionBy("batch").parquet(staged))


def until_stable(step, state, most: int = 2):
    """Repeat step(state) -> (state, mark) until the mark stays the same or the passes are used up."""
    last = None
    for _ in range(most):
        state, mark = step(state)
        if mark == last:
            break
        last = mark
    return state
