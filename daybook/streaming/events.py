"""Event streams: windows with a watermark, debounce by session, and keyed application of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of Parquet event files; event time as TIMESTAMP, which watermarks ask for."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, by: str = "user_id", quiet: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of a key's events with no gap of `quiet`: the debounce, of which the last event counts."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("last")
    found = events.groupBy(F.session_window("ts", quiet).alias("w"), by).agg(F.count("*").alias("n"), last)
    return found.select(by, F.col("w.start").alias("start"), F.col("last.ts").alias("last_ts"), "n", F.col("last.event_type").alias("last_type"))


def apply_batches(stream: DataFrame, target: str, keys: list[str], checkpoint: str):
    """Writes every micro-batch's last rows by key as a delta of its own below `target`; a replayed batch writes the same delta again.

    Nothing that is there is read or rewritten, so no batch can lose another's rows. `applied` gives the table.
    """
    from ..operators.incremental import upsert

    def apply(batch: DataFrame, number: int) -> None:
        upsert(batch.limit(0), batch, keys).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def applied(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The table that the deltas make: of each key the row of the last batch that had it."""
    deltas = spark.read.parquet(target)
    rest = [c for c in deltas.columns if c not in (*keys, "batch")]
    last = deltas.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("last"))
    return last.select(*keys, *(F.col("last")[c].alias(c) for c in rest))


def compact(spark: SparkSession, target: str, keys: list[str], into: str) -> None:
    """Writes the table into another folder as batch -1 of it, for the deltas to come."""
    applied(spark, target, keys).write.mode("overwrite").parquet(f"{into}/batch=-1")
