"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmenta.llm import bpe, knn, language, overlap, packing, residue, truncation
from fragmenta.session import table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Train rows and evaluation rows that ask the same question."""
    pairs = overlap.overlaps(table(spark, base, "train_qa"), table(spark, base, "queries"), "qa_id", "query_id")
    return pairs.withColumn("query_id", F.col("query_id").cast("int"))


def p1_report(spark: SparkSession, base: str) -> DataFrame:
    """Overlaps per evaluation split and source of either side."""
    pairs = p1_found(spark, base)
    asked = table(spark, base, "queries").select("query_id", "split", F.col("source").alias("query_source"))
    trained = table(spark, base, "train_qa").select("qa_id", F.col("source").alias("train_source"))
    return (
        pairs.join(asked, "query_id").join(trained, "qa_id").groupBy("split", "query_source", "train_source")
        .agg(F.countDistinct("query_id").alias("queries"), F.countDistinct("qa_id").alias("train_rows"), F.count("*").alias("pairs"))
    )


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Most similar vectors of every vector of either table."""
    parts = [knn.neighbour_pairs(table(spark, base, name)).select(F.lit(name).alias("meta_table"), "doc_id_a", "doc_id_b") for name in ("scenes_meta", "train_meta")]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Captions that lost their end."""
    return truncation.truncated(table(spark, base, "captions"), "caption_id", ["vlm_caption", "llm_caption_en"]).distinct()


def p4_rates(spark: SparkSession, base: str) -> DataFrame:
    """How often each source cuts each field."""
    return truncation.rates(table(spark, base, "captions"), "caption_id", ["vlm_caption", "llm_caption_en"])


def _spoken(spark: SparkSession, base: str) -> DataFrame:
    scenes = table(spark, base, "scenes")
    parts = [
        table(spark, base, "train_qa").select(F.lit("train_qa.question").alias("field"), F.col("qa_id").alias("rec_id"), F.col("question").alias("text"), language.label_code(F.col("question_lang")).alias("label")),
        scenes.select(F.lit("scenes.asr_text").alias("field"), F.col("row_id").alias("rec_id"), F.col("asr_text").alias("text"), language.label_code(F.col("asr_lang")).alias("label")),
        scenes.select(F.lit("scenes.llm_caption_ru").alias("field"), F.col("row_id").alias("rec_id"), F.col("llm_caption_ru").alias("text"), F.lit("ru").alias("label")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_segments(spark: SparkSession, base: str) -> DataFrame:
    """Language and confidence of every stretch of every text."""
    return language.segments(_spoken(spark, base))


def p5_texts(spark: SparkSession, base: str) -> DataFrame:
    """The language of every text as a whole."""
    return language.text_languages(p5_segments(spark, base))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Stretches of texts whose label is missing or wrong, or that mix languages."""
    return language.mislabelled(p5_segments(spark, base)).select("field", "rec_id", "seg_no", "lang").distinct()


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(table(spark, base, "documents"))


def p7_containers(spark: SparkSession, base: str) -> DataFrame:
    """Container and place of every document with a token, per container kind."""
    kinds = table(spark, base, "containers").select("container_kind", "capacity").collect()  # a fixed table of three rows
    documents = table(spark, base, "documents")
    return packing.fill(bpe.sizes(documents), [tuple(k) for k in kinds], n_rows=documents.count())


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents with something that stands where content should."""
    return residue.residue(table(spark, base, "documents")).select("doc_id").distinct()


def p8_report(spark: SparkSession, base: str) -> DataFrame:
    """Documents with residue per source and kind."""
    documents = table(spark, base, "documents")
    found = residue.residue(documents).join(documents.select("doc_id", "source"), "doc_id")
    return found.select("source", "doc_id", F.explode("kinds").alias("kind")).groupBy("source", "kind").agg(F.countDistinct("doc_id").alias("documents"))


QUERIES: dict = {"p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p4_found": p4_found, "p4_rates": p4_rates, "p5_found": p5_found, "p5_segments": p5_segments, "p5_texts": p5_texts, "p6_ids": p6_ids, "p7_containers": p7_containers, "p8_found": p8_found, "p8_report": p8_report}
ORACLE: dict = {}
