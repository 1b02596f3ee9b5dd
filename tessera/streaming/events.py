"""Streams over the events table: windows, late data, duplicates, joins and state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import scratch, table

#: Deliveries are parted at this moment: what came before arrives first.
PARTED = "2024-01-20"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream; ts is a timestamp with zone, as watermarks need it."""
    schema = table(spark, sf_dir, "events").schema
    # a pattern, since the table may be one file or a folder of part files
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def written(stream: DataFrame) -> DataFrame:
    """Run an append stream over all that its source holds into Parquet files in the shared folder, and read them back."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession)
    _run(stream, path, scratch(spark))
    return spark.read.schema(stream.schema).parquet(path)


def _run(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> None:
    """once: one batch and no more; streams with state in processing time would have empty batches without end."""
    trigger = {"once": True} if once else {"availableNow": True}
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start().awaitTermination()


def delivered(deliveries: list[DataFrame], plan: Callable[[DataFrame], DataFrame], once: bool = False) -> DataFrame:
    """What a stream makes of several deliveries of files, each a run of its own that goes on from the checkpoint of the one before."""
    spark = deliveries[0].sparkSession
    source, path, checkpoint = (scratch(spark) for _ in range(3))
    stream = None
    for rows in deliveries:
        rows.write.mode("append").parquet(source)
        stream = plan(spark.readStream.schema(rows.schema).parquet(source))
        _run(stream, path, checkpoint, once)
    return spark.read.schema(stream.schema).parquet(path)


def _two_deliveries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    parted = F.lit(PARTED).cast("timestamp")
    return events.where(F.col("ts") < parted), events.where(F.col("ts") >= parted)


def plain(at: Column) -> Column:
    return at.cast("timestamp_ntz")


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows in complete mode: the same rows as the batch query. The sink holds a row for each day and type."""
    counts = event_stream(spark, sf_dir).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    path, checkpoint = scratch(spark), scratch(spark)

    def replaced(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    counts.writeStream.outputMode("complete").foreachBatch(replaced).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(path).select(plain(F.col("window.start")).alias("day"), "event_type", "n", "total")


def closed_days(spark: SparkSession, sf_dir: str, delay: str = "1 hour") -> DataFrame:
    """Append mode: a window comes out once the watermark has passed it, so the last one stays open."""
    counts = event_stream(spark, sf_dir).withWatermark("ts", delay).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return written(counts).select(plain(F.col("window.start")).alias("day"), "n")


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 12 hours every 6 that the watermark has passed."""
    counts = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "12 hours", "6 hours")).agg(F.count("*").alias("n"))
    return written(counts).select(plain(F.col("window.start")).alias("start"), "n")


def closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, ended by a pause of an hour, that the watermark has passed."""
    counts = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return written(counts).select("user_id", plain(F.col("session_window.start")).alias("start"), "n")


def late_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second delivery also repeats the first days' events; their windows are closed, so they change nothing."""
    first, second = _two_deliveries(spark, sf_dir)
    late = first.where(F.col("ts") < F.lit("2024-01-05").cast("timestamp"))
    found = delivered([first, second.unionByName(late)], lambda s: s.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")))
    return found.select(plain(F.col("window.start")).alias("day"), "n")


def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is delivered twice at once, those of the last half day again with the next delivery; each id comes out once."""
    first, second = _two_deliveries(spark, sf_dir)
    again = first.where(F.col("ts") >= F.lit(PARTED).cast("timestamp") - F.expr("INTERVAL 12 HOURS"))
    once = delivered([first.unionByName(first), second.unionByName(again)], lambda s: s.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"]))
    return once.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


def clicks_and_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-stream join: purchases within two hours after a click of the same user; the watermarks bound the state."""
    events = event_stream(spark, sf_dir)
    clicks = events.where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("clicker"), F.col("ts").alias("clicked")).withWatermark("clicked", "1 hour")
    bought = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", "ts").withWatermark("ts", "1 hour")
    joined = clicks.join(bought, F.expr("clicker = user_id AND ts > clicked AND ts <= clicked + INTERVAL 2 HOURS"))
    return written(joined.select("click", "purchase"))


def named_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-static join with the nations, then a batch count of what it wrote."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = event_stream(spark, sf_dir).join(nations, F.col("user_id") % 25 == F.col("n_nationkey"), "left").select("event_id", "n_name")
    return written(joined).groupBy("n_name").agg(F.count("*").alias("n"))


def _running(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    n, total = state.get if state.exists else (0, 0.0)
    for frame in frames:
        n, total = n + len(frame), total + float(frame["value"].sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom state: a count and a sum for each user that live from one delivery to the next; the last row of a user holds all of its events."""
    found = delivered(
        list(_two_deliveries(spark, sf_dir)),
        lambda s: s.groupBy("user_id").applyInPandasWithState(_running, "user_id long, n long, total double", "n long, total double", "append", "NoTimeout"),
    )
    return found.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))
