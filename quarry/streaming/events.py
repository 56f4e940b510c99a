"""Running counts, and keyed state over a stream of events or turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.streaming import runs, state


def day_counts(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    """(day, n): the state holds one row a day, and each batch writes the counts anew, the open day too."""
    at = at or runs.folder(spark, "day-counts")
    days = runs.source(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    days = days.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")
    runs.drain(days, "complete", lambda df, _: df.write.mode("overwrite").parquet(f"{at}/days"), at)
    return spark.read.parquet(f"{at}/days")


def keyed(spark: SparkSession, stream: DataFrame, keys: list[str], processor, at: str, clock: str = "None") -> DataFrame:
    """The last row that a processor gave for each key; a batch's rows go to a folder of its own."""
    with runs.settings(spark, {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}):
        rows = stream.groupBy(*keys).transformWithStateInPandas(processor, processor.OUTPUT, "Update", clock)
        runs.drain(rows, "update", lambda df, n: df.write.mode("overwrite").parquet(f"{at}/rows/batch={n}"), at)
    names = [c.strip().split()[0] for c in processor.OUTPUT.split(",")]
    return spark.read.parquet(f"{at}/rows").groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("x")).select("x.*")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ms``, their time in milliseconds, whatever the session's time zone."""
    rows = runs.source(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return rows.select("at", F.unix_millis("at").alias("ms"), "event_id", "user_id", "event_type", "value")


def running_mastery(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    """(user_id, event_type, attempts, mastery)"""
    return keyed(spark, log(spark, sf_dir).drop("at"), ["user_id", "event_type"], state.Mastery(), at or runs.folder(spark, "mastery"))


def rolling_timings(spark: SparkSession, sf_dir: str, at: str | None = None, window: int = 200) -> DataFrame:
    """(event_type, n, last, p95) over the last values of each type."""
    rows, processor = log(spark, sf_dir).select("ms", "event_id", "event_type", "value"), state.Timings(window)
    return keyed(spark, rows.mapInPandas(processor.last, rows.schema), ["event_type"], processor, at or runs.folder(spark, "timings"))


def rolling_memory(spark: SparkSession, sf_dir: str, at: str | None = None, window: int = 6, after: int = 12, chars: int = 1200) -> DataFrame:
    """(conv_id, messages, recent, summary)"""
    rows = runs.source(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return keyed(spark, rows, ["conv_id"], state.Memory(window, after, chars), at or runs.folder(spark, "memory"))


def expiring_cache(spark: SparkSession, sf_dir: str, at: str | None = None, ttl: int = 86_400_000, late: str = "0 seconds") -> DataFrame:
    """(user_id, event_type, value, expired): the last value of each key, and whether its time was over before the log ends."""
    rows = log(spark, sf_dir).withWatermark("at", late)
    return keyed(spark, rows, ["user_id", "event_type"], state.Cache(ttl), at or runs.folder(spark, "cache"), "EventTime")
