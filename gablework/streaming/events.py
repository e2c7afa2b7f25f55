"""Streams of events: daily counts, first signals, usage, limits by key. Each agrees with its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ensure_checkpoint_dir


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the parquet files of a table."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return source.parquet(path if not path.endswith(".parquet") or _is_dir(spark, path) else path.rsplit("/", 1)[0], **({} if _is_dir(spark, path) else {"pathGlobFilter": path.rsplit("/", 1)[1]}))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def daily_counts(events: DataFrame, late: str = "60 days") -> DataFrame:
    """(day, event_type, n) by event time; events later than the watermark are left out."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def first_signals(events: DataFrame, late: str = "60 days") -> DataFrame:
    """(user_id, event_type): each signal of each owner once within the watermark; its state is dropped thereafter."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")


def usage(events: DataFrame) -> DataFrame:
    """(user_id, n): a running count of each owner's events."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"))


def limited(events: DataFrame, most: int, seconds: int, late: str = "60 days") -> DataFrame:
    """(user_id, event_id, allowed) of a sliding limit by key, the allowed hits of the last window (at most `most`) being the state.

    A key's state ends once the watermark has passed its last window.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        for pdf in frames:
            pdf = pdf.sort_values(["t", "event_id"])
            ok = []
            for x in pdf["t"]:
                kept = [k for k in kept if x - k < seconds]
                ok.append(len(kept) < most)
                if ok[-1]:
                    kept.append(float(x))
            yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"], "allowed": ok})
        state.update((kept,))
        ends = int((max(kept, default=0.0) + seconds) * 1000)
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))

    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    rows = at.select("user_id", "event_id", "at", F.col("at").cast("double").alias("t"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, allowed boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All that is there now, through the stream, as a table. Results go to files of the shared checkpoint folder."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{name}-{spark._jvm.java.util.UUID.randomUUID()}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{mode}-{number if mode != 'complete' else 'all'}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(stream.schema).parquet(f"{base}/out")
