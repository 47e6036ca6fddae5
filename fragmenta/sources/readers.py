"""Readers of the pipeline's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmenta.operators.docs import latest
from fragmenta.operators.periods import file_stem

# Extensions of media files.
VIDEO_TYPES = ("mp4", "mkv", "avi", "webm")
SHOTS = "video_id STRING, audio_key STRING, scenes ARRAY<STRUCT<scene_idx:INT,start:DOUBLE,end:DOUBLE,description:STRING,description_en:STRING,keyframe_time:DOUBLE,keyframe_path:STRING>>"
SCENES = "video_id STRING, scene_idx INT, start DOUBLE, end DOUBLE, asr_text STRING, vlm_caption STRING, llm_caption_en STRING, llm_caption_ru STRING, scene_summary STRING"
EVENTS = "video_id STRING, event_idx INT, start DOUBLE, end DOUBLE, center_scene_idx INT, scene_indices ARRAY<INT>, event_summary STRING"
TRAIN = "video_file STRING, start DOUBLE, end DOUBLE, question_ru STRING, question_en STRING, question STRING, answer_en STRING, topic STRING"
QUERIES = "query_id INT, question STRING"
TRANSLATIONS = "query_id INT, corrected_question STRING, translated_question STRING"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or any match of a pattern) exists."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def media_files(spark: SparkSession, folder: str, types: tuple[str, ...] = VIDEO_TYPES) -> DataFrame:
    """``path, video_id, length, modified`` of the media files below a folder; contents aren't read."""
    pattern = "*.{" + ",".join(t for x in types for t in (x, x.upper())) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", file_stem(F.col("path")).alias("video_id"), "length", F.col("modificationTime").alias("modified"))


def json_documents(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """A JSON file (an object or a list); no rows if it doesn't exist. Of entries with one ``key`` the last stays."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).json(path, multiLine=True)
    # A file is read by one task from its beginning; of several files the last by path counts.
    return df if key is None else latest(df.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at")), [key], ["_file", "_at"]).drop("_file", "_at")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file of one JSON document a line; blank lines are skipped; no rows if it doesn't exist."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path: str, schema: str | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file with a header and quoted texts over several lines, read by column name.

    Columns of ``schema`` that the file lacks are null; those in ``required`` must be there.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="\0")  # so that a quoted empty text isn't null
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    if schema is None:
        return raw
    kinds = [x.strip().split(" ", 1) for x in schema.split(",")]
    return raw.select(*[(F.col(n) if n in raw.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds])


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of several places that exists."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {paths}")
