"""Sliding windows that begin where each video begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.settings import SETTINGS


def event_windows(scenes: DataFrame, width: float = SETTINGS.window_sec, step: float = SETTINGS.window_step_sec) -> DataFrame:
    """``video_id, event_idx, win_no, start, end, center_scene_idx, scene_indices, event_summary``.

    ``scenes(video_id, scene_idx, start, end, scene_summary)``, one row per scene. Windows
    start at the start of the scene with the least index and every ``step`` seconds after,
    while that is before the video's end. A scene belongs to a window that it overlaps;
    windows without scenes or without text have no row and no number. ``event_idx`` counts
    over all videos, in the order of their names.
    """
    span = scenes.groupBy("video_id").agg(F.min_by("start", "scene_idx").alias("origin"), F.max("end").alias("last"))
    # Each scene finds its windows by arithmetic, one more on either side, and the exact test follows.
    placed = scenes.join(span, "video_id").where("last > origin")
    low = F.greatest(F.lit(0), F.floor((F.col("start") - width - F.col("origin")) / step))
    high = F.least(F.ceil((F.col("end") - F.col("origin")) / step), F.ceil((F.col("last") - F.col("origin")) / step) - 1)
    spread = placed.withColumn("_lo", low.cast("bigint")).withColumn("_hi", high.cast("bigint")).where("_hi >= _lo").withColumn("win_no", F.explode(F.sequence("_lo", "_hi")))
    w0 = F.col("origin") + F.col("win_no") * F.lit(step)
    spread = spread.withColumn("w0", w0).where((F.col("end") > F.col("w0")) & (F.col("start") < F.col("w0") + width))
    member = F.struct("scene_idx", F.coalesce("scene_summary", F.lit("")).alias("text"))
    grouped = spread.groupBy("video_id", "win_no").agg(F.min("w0").alias("start"), F.array_sort(F.collect_list(member)).alias("m"))
    text = F.array_join(F.filter(F.col("m.text"), lambda x: x != ""), " ")
    middle = F.element_at(F.col("m.scene_idx"), (F.floor(F.size("m") / 2) + 1).cast("int"))
    events = grouped.select(
        "video_id", "win_no", "start", (F.col("start") + width).alias("end"), middle.alias("center_scene_idx"), F.col("m.scene_idx").alias("scene_indices"), text.alias("event_summary")
    ).where("event_summary <> ''")
    return running_number(events, "video_id", "win_no", "event_idx")


def running_number(df: DataFrame, group: str, order: str, name: str, prefix: int = 8) -> DataFrame:
    """``df`` numbered from 0 by (group, order) over everything, without one global sort.

    Rows are numbered inside groups; the counts of groups are summed up inside buckets
    of groups with a common prefix (which keeps the order of names), and only one row
    for each bucket is summed up in one place.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_b", F.substring(group, 1, prefix))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("_b").agg(F.sum("_n").alias("_s")).select("_b", F.coalesce(F.sum("_s").over(earlier("_b")), F.lit(0)).alias("_o"))
    inside = counts.withColumn("_i", F.coalesce(F.sum("_n").over(earlier("_b", group)), F.lit(0)))
    offsets = inside.join(buckets, "_b").select(group, (F.col("_o") + F.col("_i")).alias("_offset"))
    number = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return df.withColumn("_r", number).join(offsets, group).withColumn(name, F.col("_offset") + F.col("_r")).drop("_r", "_offset")


def resolve_events(results: DataFrame, scenes: DataFrame) -> DataFrame:
    """``results`` whose event rows take the times of their centre scene, where it is known.

    ``results`` has ``video_id, center_scene_idx, start, end``; rows without a centre stay.
    """
    centre = scenes.select("video_id", F.col("scene_idx").alias("center_scene_idx"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    joined = results.join(centre, ["video_id", "center_scene_idx"], "left")
    return joined.withColumn("start", F.coalesce("_s", "start")).withColumn("end", F.coalesce("_e", "end")).drop("_s", "_e")
