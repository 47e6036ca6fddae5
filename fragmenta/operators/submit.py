"""The wide result table, its checks, and quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.operators.intervals import iou
from fragmenta.settings import SETTINGS


def _wide(queries: DataFrame, results: DataFrame, n: int, pick) -> DataFrame:
    row = F.struct("slot", "video_id", "start", "end")
    listed = results.where(F.col("slot") <= n).groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    joined = queries.select("query_id").join(listed, "query_id", "left").withColumn("n", F.coalesce(F.size("r"), F.lit(0)))
    cols: list[Column] = []
    for i in range(1, n + 1):
        video, start, end = pick(F.col("r"), F.greatest(F.col("n"), F.lit(0)), i)
        cols += [video.alias(f"video_file_{i}"), F.round(start, 3).alias(f"start_{i}"), F.round(end, 3).alias(f"end_{i}")]
    return joined.select("query_id", *cols)


def padded(queries: DataFrame, results: DataFrame, n: int = SETTINGS.final_top_n) -> DataFrame:
    """One row per query with ``n`` slots; missing ones repeat the last, a query without results gets a fixed fragment."""
    def pick(r: Column, size: Column, i: int) -> tuple[Column, Column, Column]:
        x = F.when(size > 0, F.get(r, F.least(F.lit(i), size) - 1))
        return F.coalesce(x["video_id"], F.lit(SETTINGS.pad_video)), F.coalesce(x["start"], F.lit(SETTINGS.pad_start)), F.coalesce(x["end"], F.lit(SETTINGS.pad_end))

    return _wide(queries, results, n, pick)


def empty_padded(queries: DataFrame, results: DataFrame, n: int = SETTINGS.final_top_n) -> DataFrame:
    """One row per query with ``n`` slots; missing ones are empty, with times 0."""
    def pick(r: Column, size: Column, i: int) -> tuple[Column, Column, Column]:
        x = F.when(size >= i, F.get(r, F.lit(i - 1)))
        return F.coalesce(x["video_id"], F.lit("")), F.coalesce(x["start"], F.lit(0.0)), F.coalesce(x["end"], F.lit(0.0))

    return _wide(queries, results, n, pick)


def fill_rate(submission: DataFrame) -> DataFrame:
    """``n_rows, n_columns, fill``: size of the table and the share of first slots with a proper video name."""
    named = F.col("video_file_1").rlike("^video_[a-f0-9]+$").cast("double")
    return submission.agg(F.count("*").alias("n_rows"), F.round(F.avg(named), 6).alias("fill")).withColumn("n_columns", F.lit(len(submission.columns)))


def composite_recall(results: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5), least: float = SETTINGS.positive_iou) -> DataFrame:
    """``k, success_rate, video_recall`` for each k, and their mean over all k in ``composite``.

    ``truth(query_id, true_video, true_start, true_end)``. A query succeeds at k if one of
    its first k fragments lies in a true video with an IoU of ``least`` or more; its video
    is recalled if the video alone is right. Queries without results count as failed.
    """
    met = truth.join(results.select("query_id", "slot", "video_id", "start", "end"), "query_id", "left")
    right = F.coalesce(F.col("video_id") == F.col("true_video"), F.lit(False))
    close = F.coalesce(iou(F.col("start"), F.col("end"), F.col("true_start"), F.col("true_end")) >= least, F.lit(False))
    first = met.groupBy("query_id").agg(F.min(F.when(right & close, F.col("slot"))).alias("hit"), F.min(F.when(right, F.col("slot"))).alias("video"))
    each = first.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    rate = lambda c: F.round(F.avg(F.coalesce((F.col(c) <= F.col("k")).cast("double"), F.lit(0.0))), 6)
    rates = each.groupBy("k").agg(rate("hit").alias("success_rate"), rate("video").alias("video_recall"))
    # A handful of rows, one for each k.
    return rates.withColumn("composite", F.round((F.avg("success_rate").over(Window.partitionBy()) + F.avg("video_recall").over(Window.partitionBy())) / 2, 6))
