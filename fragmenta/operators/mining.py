"""Training pairs for a reranker from past questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.operators.intervals import iou, overlap_join, sound
from fragmenta.settings import SETTINGS


def positives(questions: DataFrame, scenes: DataFrame, least: float = SETTINGS.positive_iou) -> DataFrame:
    """``query_id, video_id, scene_idx``: scenes with text that cover a question's fragment with an IoU of ``least`` or more."""
    asked = questions.where(sound()).select("query_id", "video_id", F.col("start").alias("a0"), F.col("end").alias("a1"))
    shown = scenes.where(sound() & (F.col("summary") != "")).select("video_id", "scene_idx", F.col("start").alias("b0"), F.col("end").alias("b1"))
    met = overlap_join(asked, shown, "video_id", ("a0", "a1"), ("b0", "b1"))
    return met.where(iou(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")) >= least).select("query_id", "video_id", "scene_idx").distinct()


def hard_negatives(hits: DataFrame, good: DataFrame, n: int = SETTINGS.negatives) -> DataFrame:
    """``query_id, video_id, scene_idx, rank, summary, neg_no``: the first ``n`` hits with text that aren't positive, of queries that have a positive."""
    asked = good.select("query_id").distinct()
    bad = hits.where("summary <> ''").join(asked, "query_id", "left_semi").join(good, ["query_id", "video_id", "scene_idx"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("rank", "scene_idx")
    return bad.withColumn("neg_no", F.row_number().over(order)).where(F.col("neg_no") <= n).select("query_id", "video_id", "scene_idx", "rank", "summary", "neg_no")


def triplets(questions: DataFrame, scenes: DataFrame, hits: DataFrame, n: int = SETTINGS.negatives) -> DataFrame:
    """``query_id, query, positive, negative, neg_no``: the question with its first positive and each negative; again for the English text if it differs."""
    good = positives(questions, scenes)
    text = scenes.select("video_id", "scene_idx", "summary")
    first = good.join(text, ["video_id", "scene_idx"]).groupBy("query_id").agg(F.min_by("summary", "scene_idx").alias("positive"))
    bad = hard_negatives(hits, good, n).select("query_id", "neg_no", F.col("summary").alias("negative"))
    english = F.when((F.col("question_en") != "") & (F.lower("question_en") != F.lower("question")), F.col("question_en"))
    texts = questions.select("query_id", F.explode(F.array_compact(F.array("question", english))).alias("query"))
    return texts.join(first, "query_id").join(bad, "query_id").select("query_id", "query", "positive", "negative", "neg_no")


def labelled_pairs(found: DataFrame, seed: int = 42) -> DataFrame:
    """``query, passage, label``: both pairs of each triplet, in an order made by ``seed``."""
    pairs = F.array(F.struct(F.col("positive").alias("passage"), F.lit(1.0).alias("label")), F.struct(F.col("negative").alias("passage"), F.lit(0.0).alias("label")))
    rows = found.select("query", F.inline(pairs))
    return rows.orderBy(F.xxhash64("query", "passage", "label", F.lit(seed)))
