"""Tables through the readers, writers and model seams, each with the SQL it must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmenta.operators import docs, models, retrieval
from fragmenta.plans import run
from fragmenta.plans.core_queries import _C, _OK, _OKS, _S, _TOKENS, _captions, _hashed, _sound
from fragmenta.session import own_folder, table
from fragmenta.sources import readers, writers
from fragmenta.streaming import ready

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    """Registers a query under its name, with its SQL."""
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _place(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{own_folder(spark)}/io-{uuid.uuid4().hex}"


@query("SELECT caption_id, video_id, scene_idx, vlm_caption, llm_caption_ru, array_to_string(synthetic_queries, ' | ') AS synthetic FROM captions")
def json_lines_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Captions written and read as one JSON document a line."""
    path = f"{_place(spark)}/captions.jsonl"
    cols = ["caption_id", "video_id", "scene_idx", "vlm_caption", "llm_caption_ru", "synthetic_queries"]
    writers.json_lines(table(spark, base, "captions").select(*cols), path)
    schema = "caption_id bigint, video_id string, scene_idx int, vlm_caption string, llm_caption_ru string, synthetic_queries array<string>"
    return readers.json_lines(spark, path, schema).select(*cols[:-1], F.array_join("synthetic_queries", " | ").alias("synthetic"))


@query("SELECT query_id, question FROM queries")
def csv_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Questions written and read as a CSV file."""
    path = f"{_place(spark)}/queries.csv"
    writers.csv_file(table(spark, base, "queries").select("query_id", "question"), path)
    return readers.csv(spark, path, readers.QUERIES, ("query_id", "question"))


@query(f"""WITH {_S}, {_OKS} SELECT video_id, 'audio_' || video_id AS audio_key, scene_idx, "start", "end" FROM ok""")
def shots_document(spark: SparkSession, base: str) -> DataFrame:
    """Scenes nested by video in a JSON document, read again and flattened; of two entries of a video the last stays."""
    path = f"{_place(spark)}/shots.json"
    scene = F.struct("scene_idx", "start", "end")
    nested = _sound(spark, base).groupBy("video_id").agg(F.collect_list(scene).alias("scenes"))  # as the document holds them
    entries = nested.select("video_id", F.explode(F.array(F.struct(F.lit("old").alias("audio_key"), F.slice("scenes", 1, 0).alias("scenes")), F.struct(F.concat(F.lit("audio_"), "video_id").alias("audio_key"), "scenes"))).alias("e"))
    writers.json_lines(entries.select("video_id", "e.*"), path)
    # One document a line, which is how a list of documents comes in parts.
    read = spark.read.schema(readers.SHOTS).json(path).select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    last = docs.latest(read, ["video_id"], ["_file", "_at"])
    return docs.flatten_scenes(last).select("video_id", "audio_key", "scene_idx", "start", "end")


@query("""SELECT event_idx, video_id, center_scene_idx FROM events_doc UNION ALL SELECT event_idx, video_id, center_scene_idx FROM events_doc WHERE event_idx % 2 = 0""")
def overwrite_and_append(spark: SparkSession, base: str) -> DataFrame:
    """Events written, written over, and half of them appended."""
    path = f"{_place(spark)}/events.parquet"
    events = table(spark, base, "events_doc").select("event_idx", "video_id", "center_scene_idx")
    writers.atomic(events.limit(1), path)
    writers.atomic(events, path)
    writers.append(events.where("event_idx % 2 = 0"), path)
    return spark.read.parquet(writers.restored(spark, readers.first_existing(spark, [f"{path}.none", path])))


@query("SELECT topic, count(*) AS n FROM train_qa GROUP BY topic")
def cached_result(spark: SparkSession, base: str) -> DataFrame:
    """A result that is made once and then read from where its inputs name it."""
    folder, rows = _place(spark), table(spark, base, "train_qa")
    make = lambda: rows.groupBy("topic").agg(F.count("*").alias("n"))
    writers.cached(spark, folder, [rows], "settings", make)
    return writers.cached(spark, folder, [rows], "settings", lambda: 1 / 0)


@query(f"""WITH {_S}, v AS (SELECT video_id, max("end") AS duration FROM s WHERE {_OK} GROUP BY video_id),
  n AS (SELECT *, greatest(1, CAST(ceil(duration / 10.0) AS BIGINT)) AS n FROM v)
  SELECT video_id, CAST(i AS INTEGER) AS scene_idx, i * 10000 AS start_ms, CAST(round(least(duration, (i + 1) * 10.0) * 1000) AS BIGINT) AS end_ms FROM (SELECT *, unnest(range(n)) AS i FROM n)""")
def model_shots(spark: SparkSession, base: str) -> DataFrame:
    """Shot detection through its seam, by the stand-in of equal lengths."""
    videos = _sound(spark, base).groupBy("video_id").agg(F.max("end").alias("duration"))
    found = models.apply_model(videos, models.fixed_shots(), "video_id string, scene_idx int, start double, end double")
    return found.select("video_id", "scene_idx", *[F.round(F.col(c) * 1000).cast("bigint").alias(f"{c}_ms") for c in ("start", "end")])


@query(f"""WITH {_C}, {_S} SELECT c.video_id, c.scene_idx, CASE WHEN c.vlm_caption <> '' THEN 'keyframes/' || c.video_id || '__' || c.scene_idx || '.jpg' ELSE '' END AS keyframe_path FROM c""")
def model_keyframes(spark: SparkSession, base: str) -> DataFrame:
    """Key frames through their seam; a caption stands for the video that has them."""
    rows = _captions(spark, base).select("video_id", "scene_idx", F.coalesce("vlm_caption", F.lit("")).alias("video_path"))
    return models.apply_model(rows, models.fixed_keyframes(), "video_id string, scene_idx int, keyframe_path string")


@query(f"""WITH x AS (SELECT row_id AS id, scene_summary AS t FROM scenes), {_hashed("v", "x")} SELECT id AS row_id, place, round(r[place + 1], 6) AS value FROM (SELECT id, r, unnest(range(96)) AS place FROM v_r) WHERE r[place + 1] <> 0""")
def dense_encoding(spark: SparkSession, base: str) -> DataFrame:
    """The dense output of the encoder's stand-in: places that aren't 0."""
    rows = table(spark, base, "scenes").select("row_id", F.posexplode(models.hashed_vector(F.col("scene_summary"))).alias("place", "v"))
    return rows.where("v <> 0").select("row_id", F.col("place").cast("bigint").alias("place"), F.round(F.col("v").cast("double"), 6).alias("value"))


@query(f"""WITH w AS (SELECT row_id, {_TOKENS.replace("{x}", "scene_summary")} AS w FROM scenes)
  SELECT row_id, term, round(ln(1 + count(*)) / sqrt(n), 6) AS weight FROM (SELECT row_id, len(w) AS n, unnest(w) AS term FROM w) GROUP BY row_id, n, term""")
def sparse_encoding(spark: SparkSession, base: str) -> DataFrame:
    """The sparse output of the encoder's stand-in, one row for each term of a text, as the index stores it."""
    found = retrieval.sparse_weights(table(spark, base, "scenes").select(F.col("row_id").alias("doc_id"), F.col("scene_summary").alias("text")))
    terms = found.select(F.col("doc_id").alias("row_id"), F.explode(F.arrays_zip("terms", "weights")).alias("t"))
    return terms.select("row_id", F.col("t.terms").alias("term"), F.round(F.col("t.weights"), 6).alias("weight"))


@query(f"""WITH x AS (SELECT row_id, unnest({_TOKENS.replace("{x}", "scene_summary")}) AS w FROM scenes) SELECT row_id, count(DISTINCT w) AS vectors, round(sum(DISTINCT CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 96), 6)::DOUBLE AS places FROM x GROUP BY row_id""")
def multi_vector_encoding(spark: SparkSession, base: str) -> DataFrame:
    """The multi-vector output of the encoder's stand-in: one vector for each distinct word."""
    found = table(spark, base, "scenes").select("row_id", models.word_vectors(F.col("scene_summary")).alias("vecs")).where("vecs is not null")
    place = lambda v: F.array_position(F.transform(v, F.abs), F.lit(1.0).cast("float")) - 1
    return found.select("row_id", F.size("vecs").cast("bigint").alias("vectors"), F.aggregate(F.array_distinct(F.transform("vecs", place)), F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double").alias("places"))


@query(f"""WITH {_C}, {_S} SELECT c.video_id, c.scene_idx, CASE WHEN s.video_id IS NOT NULL AND trim(coalesce(c.vlm_caption, '')) = '' THEN 'A scene of ' || c.video_id || ': Describe the scene.' ELSE c.vlm_caption END AS vlm_caption
  FROM c LEFT JOIN (SELECT video_id, scene_idx FROM s) s USING (video_id, scene_idx)""")
def retried_captions(spark: SparkSession, base: str) -> DataFrame:
    """Failed captions made again where the scene and its video are known."""
    captions = _captions(spark, base).select(*docs.KEY, "vlm_caption")
    frames = captions.select(*docs.KEY, F.lit("").alias("keyframe_path"))
    scenes = table(spark, base, "scenes").where("video_id is not null and scene_idx is not null").select(*docs.KEY).distinct()
    videos = scenes.select("video_id").distinct().withColumn("video_path", F.concat("video_id", F.lit(".mp4")))
    return run.retry_failed(captions, frames, scenes, videos, run.Models())


@query("""SELECT DISTINCT c.video_id, c.scene_idx, length(any_value('A scene of ' || c.video_id || ': ' || 'Describe the scene.')) AS told FROM captions c JOIN scenes s ON c.video_id = s.video_id AND c.scene_idx = s.scene_idx
  WHERE c.video_id NOT IN (SELECT video_id FROM captions WHERE source = 'teammate_dump' AND video_id IS NOT NULL) GROUP BY ALL""")
def stream_captions(spark: SparkSession, base: str) -> DataFrame:
    """Scenes captioned as their parts arrive, but for videos that one source has captioned before."""
    place = _place(spark)
    given = table(spark, base, "captions").where("source = 'teammate_dump'")
    a = ready.arrivals(spark, base, "captions", table(spark, base, "captions").schema).select(*docs.KEY, F.col("caption_id").cast("string").alias("keyframe_path"), "arrived")
    b = ready.arrivals(spark, base, "scenes", table(spark, base, "scenes").schema).select(*docs.KEY, "asr_text", "arrived")

    def told(batch: DataFrame) -> DataFrame:
        asked = batch.withColumn("prompt", docs.prompt(F.lit(None).cast("string")))
        return models.apply_model(asked.select(*docs.KEY, "keyframe_path", "prompt"), models.fixed_captions(), "video_id string, scene_idx int, vlm_caption string")

    ready.start(ready.ready(ready.prefer_given(given, a), b), f"{place}/out", f"{place}/checkpoint", told).awaitTermination()
    out = spark.read.schema("video_id string, scene_idx int, vlm_caption string").parquet(f"{place}/out/batch=*")
    return out.select(*docs.KEY, F.length("vlm_caption").cast("bigint").alias("told"))
