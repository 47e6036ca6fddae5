"""The pipeline end to end: documents, windows, hybrid search, result table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmenta.operators import docs, fusion, retrieval, submit, windows
from fragmenta.operators.intervals import suppress
from fragmenta.settings import SETTINGS, Settings

_PAYLOAD = ["query_id", "channel_ord", "rank", "source", "video_id", "start", "end", "doc_id"]


@dataclass
class Corpus:
    """What search needs: vectors and texts of scenes (and past questions and events), each with its times."""

    scenes: DataFrame
    train: DataFrame | None = None
    events: DataFrame | None = None


def build_documents(scenes: DataFrame, segments: DataFrame, captions: DataFrame, train: DataFrame, settings: Settings = SETTINGS) -> tuple[DataFrame, DataFrame]:
    """Scene and event documents of raw scenes, speech segments, captions and past questions."""
    kept = docs.drop_short(scenes, settings.min_scene_sec)
    speech = docs.segment_text(kept, segments, settings.asr_margin_sec, settings.asr_min_fraction)
    made = docs.scene_docs(kept, speech, captions, docs.train_questions(kept, train))
    return made, windows.event_windows(made, settings.window_sec, settings.window_step_sec)


def channel(hits: DataFrame, corpus: DataFrame, source: str, order: int) -> DataFrame:
    """A ranked list as candidates."""
    payload = corpus.select("doc_id", "video_id", "start", "end")
    return hits.join(payload, "doc_id").select("query_id", F.lit(order).alias("channel_ord"), "rank", F.lit(source).alias("source"), "video_id", "start", "end", "doc_id")


def past_questions(queries: DataFrame, train: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Close past questions in two lists. A query that is itself a row of ``train`` names it in ``own``, and that row is left out."""
    vectors = queries.select("query_id", "vec")
    if "own" in queries.columns:
        near = retrieval.dense_topk(train, vectors, settings.train_top_k + 1).drop("rank").join(queries.select("query_id", "own"), "query_id")
        near = retrieval.top(near.where("own is null or own <> doc_id").drop("own"), "query_id", "score", "doc_id", settings.train_top_k)
    else:
        near = retrieval.dense_topk(train, vectors, settings.train_top_k)
    hits = retrieval.train_match(near, settings.train_low, settings.train_high)
    order = F.when(F.col("source") == "train_high", 0).otherwise(1)
    return hits.join(train.select("doc_id", "video_id", "start", "end"), "doc_id").select("query_id", order.alias("channel_ord"), F.col("list_rank").alias("rank"), *_PAYLOAD[3:])


def candidates(queries: DataFrame, corpus: Corpus, settings: Settings = SETTINGS) -> DataFrame:
    """All channels of all queries as one long table.

    ``queries(query_id, question, english, vec, vec_en)``: past questions in two lists,
    then for either wording dense search of scenes and events and sparse search of both.
    """
    parts = [past_questions(queries, corpus.train, settings)] if corpus.train is not None else []
    kinds = [("scenes", corpus.scenes, "summary")] + ([("events", corpus.events, "event_summary")] if corpus.events is not None else [])
    weights = {kind: retrieval.sparse_weights(rows.select("doc_id", F.col(text).alias("text"))) for kind, rows, text in kinds}
    wordings = [("main", 2, queries.select("query_id", "vec", F.col("question").alias("text"))), ("en", 6, queries.where("english is not null").select("query_id", F.col("vec_en").alias("vec"), F.col("english").alias("text")))]
    for tag, order, asked in wordings:
        terms = retrieval.query_weights(asked.select("query_id", "text"))
        for at, (kind, rows, _) in enumerate(kinds):
            parts.append(channel(retrieval.dense_topk(rows, asked.select("query_id", "vec"), settings.dense_top_k), rows, f"dense_{kind}_{tag}", order + at))
            parts.append(channel(retrieval.sparse_topk(weights[kind], terms, settings.sparse_top_k), rows, f"sparse_{kind}_{tag}", order + 2 + at))
    return docs.union_all([p.select(*_PAYLOAD) for p in parts])


def fused(found: DataFrame, settings: Settings = SETTINGS, by_source: bool = True) -> DataFrame:
    """Fusion, suppression and the cut to what is reranked."""
    identity = ["video_id", "start", "end", *(["source"] if by_source else [])]
    merged = fusion.rrf(found, identity, settings.rrf_k)
    return suppress(merged, ["query_id"], "video_id", "position", settings.suppress_iou).where(F.col("position").isNotNull())


def search(queries: DataFrame, corpus: Corpus, settings: Settings = SETTINGS) -> DataFrame:
    """The ranked fragments of each query: ``query_id, slot, video_id, start, end, ...``.

    ``queries`` are those of ``candidates``; passages are compared by the lexical
    stand-in of a cross-encoder.
    """
    first = best(fused(candidates(queries, corpus, settings), settings), settings)
    return fusion.finish(scored(first, queries, corpus), settings.rerank_keep, settings.final_top_n, settings.suppress_iou)


def best(kept: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """The candidates that are reranked."""
    return retrieval.top(kept.withColumn("_p", -F.col("position")), "query_id", "_p", "position", settings.rerank_candidates, "_r").drop("_p", "_r")


def scored(found: DataFrame, queries: DataFrame, corpus: Corpus) -> DataFrame:
    """Candidates with the scores of both wordings of their query."""
    fields = ("summary", "llm_caption_ru", "llm_caption_en", "asr_text", "question", "event_summary")
    parts = [p for p in (("scenes", corpus.scenes), ("train", corpus.train), ("events", corpus.events)) if p[1] is not None]
    # Ids are those of one table, so a text belongs to (kind, id).
    texts = docs.union_all([rows.select(F.lit(kind).alias("_kind"), "doc_id", *[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in fields]) for kind, rows in parts])
    kind = F.when(F.col("source").startswith("train"), "train").when(F.contains("source", F.lit("_events")), "events").otherwise("scenes")
    asked = queries.select("query_id", F.col("question").alias("main"), "english")
    joined = found.withColumn("_kind", kind).join(texts, ["_kind", "doc_id"], "left").join(asked, "query_id")
    main = fusion.lexical_score(F.col("main"), fusion.passage(texts.columns, fusion.query_language(F.col("main"))))
    english = F.when(F.col("english").isNotNull(), fusion.lexical_score(F.col("english"), fusion.passage(texts.columns, F.lit("en"))))
    return joined.withColumn("score_main", main).withColumn("score_en", english).drop("_kind", *fields, "main", "english")


def submission(queries: DataFrame, results: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """One wide row for each query."""
    return submit.padded(queries, results, settings.final_top_n)
