"""Streams of job events: state machine, fences, durations, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read(spark: SparkSession, folder: str, schema: T.StructType = EVENTS, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stage_durations(events: DataFrame) -> DataFrame:
    """Micros from each event of a job to its next one; the last has none.

    Two levels, so that a job with a third of all events is no single sort: the
    next event is looked for within the job's day, and for a day's last event it
    is the first one of the job's next day with any."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events.select("user_id", "event_id", "ts", F.col("event_type").alias("stage"), us.alias("us"), F.to_date("ts").alias("day"))
    days = e.groupBy("user_id", "day").agg(F.min("us").alias("opens"))
    after = days.select("user_id", "day", F.lead("opens").over(Window.partitionBy("user_id").orderBy("day")).alias("after"))
    within = F.lead("us").over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    return e.withColumn("next", within).join(after, ["user_id", "day"]).select("user_id", "event_id", "stage", (F.coalesce("next", "after") - F.col("us")).alias("micros"))


def _timed(events: DataFrame, watermark: str) -> DataFrame:
    """Event time with a zone (stored times have none) and its watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def deduplicated(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Late and repeated events are dropped; state is bounded by the watermark."""
    return _timed(events, watermark).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, width: str = "1 hour", watermark: str = "1 day") -> DataFrame:
    """Events and values by type in tumbling windows."""
    return _timed(events, watermark).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 day") -> DataFrame:
    return _timed(events, watermark).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


FENCE_OUT = "id string, revision bigint, verdict string"
FENCE_STATE = "fence bigint"


def _fence(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    fence = state.get[0] if state.exists else -1
    for frame in frames:
        rows = []
        for revision in frame.sort_values("revision")["revision"]:
            if revision > fence:
                rows.append((key[0], int(revision), "ACCEPTED"))
                fence = int(revision)
            else:
                rows.append((key[0], int(revision), "REJECTED"))
        yield pd.DataFrame(rows, columns=["id", "revision", "verdict"])
    state.update((int(fence),))


def fenced(tickets: DataFrame) -> DataFrame:
    """Monotonic version check per id: a ticket at or below the fence is late or
    a repeat and is rejected.  State is one number per id."""
    return tickets.groupBy("id").applyInPandasWithState(_fence, FENCE_OUT, FENCE_STATE, "append", GroupStateTimeout.NoTimeout)


def fenced_batch(tickets: DataFrame) -> DataFrame:
    """The same check over a bounded table, ordered by arrival.

    A ticket passes if no revision as high arrived before it.  Repeats are
    reduced to the first arrival of each revision before ids are brought
    together; the verdict is joined back."""
    arrival = F.struct("loaded_at", "sequence", "revision")
    first = tickets.groupBy("id", "revision").agg(F.min(arrival).alias("first"))
    above = Window.partitionBy("id").orderBy(F.desc("revision")).rowsBetween(Window.unboundedPreceding, -1)
    fence = first.withColumn("higher", F.min("first").over(above)).select("id", "revision", "first", "higher")
    ok = (arrival == F.col("first")) & (F.col("higher").isNull() | (F.col("higher") > F.col("first")))
    return tickets.join(fence, ["id", "revision"]).select("id", "revision", "sequence", "loaded_at", F.when(ok, "ACCEPTED").otherwise("REJECTED").alias("verdict"))


def journal(stream: DataFrame, folder: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Append a stream to a journal exactly once: each micro-batch overwrites
    the folder of its own number, so a replayed batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
