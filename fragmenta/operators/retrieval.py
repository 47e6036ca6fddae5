"""Exact search: dense inner product, sparse product, BM25, late interaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.functions.text import words
from fragmenta.operators import blocks
from fragmenta.operators.blocks import DECIMALS
from fragmenta.settings import SETTINGS


def top(df: DataFrame, query: str, score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The ``k`` best rows of each query, ranked from 1; ties by ``tie``. Partial limits run before the shuffle."""
    order = Window.partitionBy(query).orderBy(F.desc(score), tie)
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int = SETTINGS.dense_top_k, unit: bool = True) -> DataFrame:
    """``query_id, doc_id, score, rank``: exact search of every query over all vectors.

    ``corpus(doc_id, vec)``, ``queries(query_id, vec)``. Vectors of another length than
    most queries', with NaN or infinite numbers or (with ``unit``, which makes the score
    the cosine) all zero take no part. Each pair of blocks hands on its own best.
    """
    dim = queries.select(F.mode(F.size("vec"), True)).scalar()
    asked, rows = (df.select(F.col(i).cast("bigint").alias("id"), "vec").where(F.col("id").isNotNull() & (F.size("vec") == dim)) for df, i in ((queries, "query_id"), (corpus, "doc_id")))
    return top(blocks.dense(rows, asked, k, unit), "query_id", "score", "doc_id", k)


def train_match(hits: DataFrame, low: float = SETTINGS.train_low, high: float = SETTINGS.train_high) -> DataFrame:
    """Hits of past questions at ``low`` or better, in two lists: ``train_high`` from ``high`` on, else ``train_low``."""
    labelled = hits.where(F.col("score") >= low).withColumn("source", F.when(F.col("score") >= high, "train_high").otherwise("train_low"))
    place = Window.partitionBy("query_id", "source").orderBy("rank")
    return labelled.withColumn("list_rank", F.row_number().over(place))


def counted_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, length, terms, counts)``: the counted words of each text that has any."""
    tokens = df.select(F.col(id_col).cast("bigint").alias("id"), words(F.col(text_col)).alias("words")).where("id is not null and size(words) > 0")
    return tokens.mapInArrow(blocks.counted, "id bigint, length int, terms array<string>, counts array<int>")


def sparse_weights(docs: DataFrame) -> DataFrame:
    """``doc_id, terms, weights`` of ``docs(doc_id, text)``: the stand-in of a sparse encoder."""
    weight = F.transform("counts", lambda n: F.log1p(n) / F.sqrt("length"))
    return counted_words(docs, "doc_id", "text").select(F.col("id").alias("doc_id"), "terms", weight.alias("weights"))


def query_weights(queries: DataFrame) -> DataFrame:
    """``query_id, terms, weights`` of ``queries(query_id, text)``."""
    return counted_words(queries, "query_id", "text").select(F.col("id").alias("query_id"), "terms", F.col("counts").cast("array<double>").alias("weights"))


def sparse_vectors(df: DataFrame, id_col: str) -> DataFrame:
    """``<id_col>, terms, weights`` of a table with one row for each term, as an encoder or an index gives it."""
    listed = df.groupBy(id_col).agg(F.collect_list(F.struct("term", "weight")).alias("_w"))  # the terms of one text
    return listed.select(id_col, F.col("_w.term").alias("terms"), F.col("_w.weight").alias("weights"))


def sparse_topk(docs: DataFrame, queries: DataFrame, k: int = SETTINGS.sparse_top_k) -> DataFrame:
    """``query_id, doc_id, score, rank``: product of sparse vectors over the terms in common.

    ``docs(doc_id, terms, weights)``, ``queries(query_id, terms, weights)``; scores above
    0 only, ties in document order.
    """
    rows, asked = (df.select(F.col(i).cast("bigint").alias("id"), "terms", "weights").where("id is not null") for df, i in ((docs, "doc_id"), (queries, "query_id")))
    return top(blocks.sparse(rows, asked, k), "query_id", "score", "doc_id", k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = SETTINGS.sparse_top_k, k1: float = SETTINGS.bm25_k1, b: float = SETTINGS.bm25_b) -> DataFrame:
    """``query_id, doc_id, score, rank`` by Okapi BM25 with the non-negative idf ln(1 + (N - df + 0.5) / (df + 0.5)).

    ``docs(doc_id, text)``, ``queries(query_id, text)``; a word repeated in a query counts
    again. How many documents have a word is counted in one pass, before the shuffle as
    far as it goes; their number and mean length come with it, as the counts of no word.
    """
    split = docs.select(words(F.col("text")).alias("w"))
    seen = split.select(F.size("w").alias("n"), F.explode(F.concat(F.array(F.lit("")), F.coalesce(F.array_distinct("w"), F.array().cast("array<string>")))).alias("term"))
    counts = seen.groupBy("term").agg(F.count("*").alias("df"), F.avg(F.when(F.col("term") == "", F.col("n"))).alias("mean"))
    total, mean = (counts.where("term = ''").select(c).scalar() for c in ("df", "mean"))
    asked = counted_words(queries, "query_id", "text").select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("terms", "counts")).alias("_t")).select("query_id", F.col("_t.terms").alias("term"), F.col("_t.counts").alias("qtf"))
    idf = F.log1p((total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(counts, "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight"))
    norm = k1 * (1 - b + b * F.col("length") / F.coalesce(F.nullif(mean, F.lit(0.0)), F.lit(1.0)))
    held = counted_words(docs, "doc_id", "text").withColumn("norm", norm)
    rows = held.select(F.col("id").alias("doc_id"), "terms", F.transform("counts", lambda tf: tf * (k1 + 1) / (tf + F.col("norm"))).alias("weights"))
    return sparse_topk(rows, sparse_vectors(weighed, "query_id"), k)


def maxsim(candidates: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, doc_id, score``: late interaction of each candidate pair.

    ``queries(query_id, vecs)``, ``docs(doc_id, vecs)``: for each query vector its best
    product with a document vector, summed up. Only the given pairs are scored.
    """
    q, d = queries.withColumnRenamed("vecs", "_q"), docs.withColumnRenamed("vecs", "_d")
    joined = candidates.join(q, "query_id").join(d, "doc_id")
    score = F.aggregate(F.transform("_q", lambda x: F.array_max(F.transform("_d", lambda y: dot(x, y)))), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return joined.select("query_id", "doc_id", F.round(score, DECIMALS).alias("score"))
