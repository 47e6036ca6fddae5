"""Scenes captioned as soon as their key frame and their speech have arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fragmenta.operators.docs import KEY
from fragmenta.settings import SETTINGS


def arrivals(spark: SparkSession, base: str, name: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files of a table, with the time each row was read as ``arrived``."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern, so that a table may be a single file.
    return reader.parquet(f"{base}/{name}.parque[t]").withColumn("arrived", F.current_timestamp())


def ready_all(keyframes: DataFrame, speech: DataFrame, late: str | None = None) -> DataFrame:
    """``video_id, scene_idx, keyframe_path, asr_text, a_time, complete`` of all pairs of arrivals with one key.

    A stream-stream join. Without ``late`` a side waits for the other for ever, so every
    pair is found and the state holds what still waits. With it (``6 hours``) the state is
    bounded: what waited so long comes out alone, its other side null and ``complete``
    false, for a later run to take up.
    """
    a = keyframes.select(*KEY, "keyframe_path", F.col("arrived").alias("a_time"))
    b = speech.select(F.col("video_id").alias("_v"), F.col("scene_idx").alias("_s"), "asr_text", F.col("arrived").alias("b_time"))
    same = (F.col("video_id") == F.col("_v")) & (F.col("scene_idx") == F.col("_s"))
    if late is None:
        met = a.join(b, same)
    else:
        span = F.expr(f"b_time BETWEEN a_time - INTERVAL {late} AND a_time + INTERVAL {late}")
        met = a.withWatermark("a_time", late).join(b.withWatermark("b_time", late), same & span, "full_outer")
    keys = [F.coalesce(k, o).alias(k) for k, o in zip(KEY, ("_v", "_s"))]
    return met.select(*keys, "keyframe_path", "asr_text", "a_time", (F.col("a_time").isNotNull() & F.col("b_time").isNotNull()).alias("complete"))


def ready(keyframes: DataFrame, speech: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The complete pairs of ``ready_all``, each key once, and without the keys of the table ``done``."""
    met = ready_all(keyframes, speech).drop("a_time", "complete")
    met = met if done is None else met.join(done.select(*KEY).distinct(), KEY, "left_anti")
    return met.dropDuplicates(KEY)


def prefer_given(given: DataFrame, arriving: DataFrame) -> DataFrame:
    """Of a stream of arrivals those whose video has nothing in the table ``given``: what was computed before goes first, for whole videos."""
    return arriving.join(given.select("video_id").distinct(), "video_id", "left_anti")


def start(stream: DataFrame, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None, once: bool = True, mode: str = "append") -> StreamingQuery:
    """Runs ``work`` on every micro-batch and appends the result to ``out``.

    Each batch has its own folder, written over if the batch is repeated after a failure,
    so nothing is lost or doubled. ``once`` ends when all that is there has been read;
    otherwise a batch is made every few seconds.
    """
    def flush(batch: DataFrame, number: int) -> None:
        done = work(batch) if work else batch
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(flush).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": f"{SETTINGS.stream_batch_sec} seconds"}
    return writer.trigger(**trigger).start()
