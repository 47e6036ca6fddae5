"""Fusion of ranked lists, rerank, clustering by video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.functions.text import blank_to_null, has_russian, strip, words
from fragmenta.operators.intervals import expand, suppress
from fragmenta.settings import SETTINGS


def rrf(candidates: DataFrame, identity: list[str], k: int = SETTINGS.rrf_k) -> DataFrame:
    """Reciprocal rank fusion: one row for each ``identity`` of a query, with ``rrf_score`` and ``position``.

    ``candidates`` has ``query_id, channel_ord, rank`` and a payload, which is that of the
    first occurrence. With the source in ``identity`` channels do not add up, without it
    they do. Equal scores keep the order of channels, then ranks.
    """
    payload = [c for c in candidates.columns if c not in ("query_id", *identity)]
    first = F.struct("channel_ord", "rank")
    merged = candidates.groupBy("query_id", *identity).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("rrf_score"), F.min_by(F.struct(*payload), first).alias("_p")
    )
    flat = merged.select("query_id", *identity, "rrf_score", "_p.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "channel_ord", "rank")
    return flat.withColumn("position", F.row_number().over(order))


def query_texts(queries: DataFrame, translations: DataFrame) -> DataFrame:
    """``query_id, main, english``: the corrected question, else the given; the translation if it is another text, else null."""
    given = translations.select("query_id", "corrected_question", "translated_question")
    joined = queries.select("query_id", "question").join(given, "query_id", "left")
    main = F.coalesce(blank_to_null(strip(F.col("corrected_question"))), F.col("question"))
    english = blank_to_null(strip(F.col("translated_question")))
    return joined.select("query_id", main.alias("main"), F.when(F.lower(english) != F.lower(strip(main)), english).alias("english"))


def passage(cols: list[str], lang: Column) -> Column:
    """The text of a candidate that is compared with the query.

    The event text if there is one; else the caption in the query's language (else in the
    other, else the summary) and the speech; else the summary, else the question.
    """
    def text(name: str) -> Column:
        return blank_to_null(F.col(name)) if name in cols else F.lit(None).cast("string")

    russian, english, summary = text("llm_caption_ru"), text("llm_caption_en"), text("summary")
    caption = F.when(lang == "ru", F.coalesce(russian, english, summary)).otherwise(F.coalesce(english, russian, summary))
    scene = blank_to_null(strip(F.concat_ws(" ", caption, text("asr_text"))))
    return F.coalesce(text("event_summary"), scene, summary, text("question"), F.lit(""))


def query_language(text: Column) -> Column:
    """``ru`` if any Russian letter occurs, else ``en``."""
    return F.when(has_russian(text), "ru").otherwise("en")


def lexical_score(query: Column, text: Column) -> Column:
    """Stand-in of a cross-encoder: the share of the query's distinct words that the text has, as a logit."""
    asked = F.array_distinct(words(query))
    share = F.try_divide(F.size(F.array_intersect(asked, words(text))).cast("double"), F.size(asked).cast("double"))
    return F.round(F.log((F.coalesce(share, F.lit(0.0)) + 0.05) / (1.05 - F.coalesce(share, F.lit(0.0)))), 6)


def rerank(candidates: DataFrame, keep: int = SETTINGS.rerank_keep, boost: float = SETTINGS.train_boost) -> DataFrame:
    """The ``keep`` best candidates by ``score_main``, or ``score_en`` where that is higher; direct answers get ``boost``.

    Adds ``reranker_score``; ``position`` becomes the new place, ties keep the old order.
    """
    score = F.greatest("score_main", "score_en") + F.when(F.col("source") == "train_high", boost).otherwise(0.0)
    order = Window.partitionBy("query_id").orderBy(F.desc("reranker_score"), "position")
    ranked = candidates.withColumn("reranker_score", score).withColumn("_place", F.row_number().over(order))
    return ranked.where(F.col("_place") <= keep).withColumn("position", F.col("_place")).drop("_place")


def cluster(candidates: DataFrame, n: int = SETTINGS.final_top_n, score: str = "reranker_score") -> DataFrame:
    """The ``n`` best of each query, video by video: videos by the sum of their scores, ties by first place.

    Queries with no more than ``n`` candidates keep their order. Adds ``slot`` from 1.
    """
    by_query, by_video = Window.partitionBy("query_id"), Window.partitionBy("query_id", "video_id")
    summed = candidates.withColumn("_n", F.count("*").over(by_query)).withColumn("_s", F.round(F.sum(score).over(by_video), 9)).withColumn("_f", F.min("position").over(by_video))
    few = F.col("_n") <= n
    order = Window.partitionBy("query_id").orderBy(F.when(few, 0.0).otherwise(-F.col("_s")), F.when(few, 0).otherwise(F.col("_f")), "position")
    return summed.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= n).drop("_n", "_s", "_f")


def finish(candidates: DataFrame, keep: int = SETTINGS.rerank_keep, n: int = SETTINGS.final_top_n, threshold: float = SETTINGS.suppress_iou) -> DataFrame:
    """Rerank, bring fragments to length, suppress overlaps, cluster by video."""
    best = rerank(candidates, keep)
    spans = best.withColumn("_x", expand(F.col("start"), F.col("end"), F.col("source")))
    spans = spans.withColumn("start", F.col("_x.start")).withColumn("end", F.col("_x.end")).drop("_x")
    return cluster(suppress(spans, ["query_id"], "video_id", "position", threshold), n)
