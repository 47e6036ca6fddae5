"""Scene documents: tables of scenes, speech, captions and questions put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.functions.text import blank_to_null, squeeze, strip, without_prefix
from fragmenta.operators.intervals import covered, overlap_join, sound
from fragmenta.operators.periods import file_stem
from fragmenta.settings import SETTINGS

KEY = ["video_id", "scene_idx"]


def seconds(frame: Column, fps: Column) -> Column:
    """A frame number as seconds, three decimals; a missing rate counts as the default."""
    return F.round(frame / F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(SETTINGS.default_fps)), 3)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each key, by ``order``. Pre-aggregated before the shuffle, so a key with many versions costs no more than others."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v"))
    return last.select(*keys, *[F.col("_v")[c].alias(c) for c in rest]).select(*df.columns)


def flatten_scenes(shots: DataFrame) -> DataFrame:
    """One row for each scene of the nested shot table, with its video."""
    return shots.select("video_id", "audio_key", F.inline("scenes"))


def with_keyframe(scenes: DataFrame) -> DataFrame:
    """A missing key frame time becomes the middle of the scene."""
    given = F.col("keyframe_time") if "keyframe_time" in scenes.columns else F.lit(None).cast("double")
    return scenes.withColumn("keyframe_time", F.coalesce(given, F.round(F.round((F.col("start") + F.col("end")) * 500, 6)) / 1000))


def drop_short(scenes: DataFrame, least: float = SETTINGS.min_scene_sec) -> DataFrame:
    """Scenes of at least ``least`` seconds, numbered anew from 0 per video in the old order; ``old_idx`` keeps the old number."""
    kept = scenes.where(F.col("end") - F.col("start") >= least)
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("scene_idx", "start", "end")) - 1
    return kept.withColumn("old_idx", F.col("scene_idx")).withColumn("scene_idx", number.cast("int"))


def short_counts(scenes: DataFrame, least: float = SETTINGS.min_scene_sec) -> DataFrame:
    """``video_id, scenes, removed`` of each video."""
    return scenes.groupBy("video_id").agg(F.count("*").alias("scenes"), F.count_if(F.col("end") - F.col("start") < least).alias("removed"))


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of ``first``, and those of ``second`` whose key ``first`` lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti").select(*first.columns))


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``todo`` that aren't in ``done``."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def split_present(df: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is known, and the others."""
    keys = known.select(key).distinct()
    return df.join(keys, key, "left_semi"), df.join(keys, key, "left_anti")


def transcripts(raw: DataFrame, path: str = "path", order: str = "file_no") -> DataFrame:
    """Transcripts by the stem of their file; of files with one stem the last wins."""
    return latest(raw.withColumn("video_id", file_stem(F.col(path))), ["video_id"], [order])


def resolve_audio(videos: DataFrame, files: DataFrame) -> DataFrame:
    """``video_id, audio_path``: the audio file of a video's hash, else its own file, else null.

    ``videos(video_id, audio_key, video_path)``, ``files(path)``; of several audio files
    the first by path.
    """
    listed = files.select("path", F.regexp_extract(file_stem(F.col("path")), "^audio_(.+)$", 1).alias("hash")).where("hash <> ''")
    first = listed.groupBy("hash").agg(F.min("path").alias("audio"))
    keyed = videos.withColumn("hash", without_prefix(F.col("audio_key"), "video_"))
    return keyed.join(first, "hash", "left").select("video_id", F.coalesce("audio", "video_path").alias("audio_path"))


def segment_text(scenes: DataFrame, segments: DataFrame, margin: float = SETTINGS.asr_margin_sec, fraction: float = SETTINGS.asr_min_fraction) -> DataFrame:
    """``video_id, scene_idx, asr_text``: the speech of each scene, in segment order.

    ``segments(video_id, seg_idx, start, end, text)``. A segment belongs to every scene,
    widened by ``margin`` and cut at 0, that holds more than ``fraction`` of it. Scenes
    without speech have an empty text.
    """
    wide = scenes.where(sound()).select(*KEY, F.greatest(F.lit(0.0), F.col("start") - margin).alias("a0"), (F.col("end") + margin).alias("a1"))
    spoken = segments.where(sound() & (strip(F.col("text")) != "")).select("video_id", "seg_idx", F.col("start").alias("b0"), F.col("end").alias("b1"), strip(F.col("text")).alias("text"))
    met = overlap_join(wide, spoken, "video_id", ("a0", "a1"), ("b0", "b1"))
    held = met.where(covered(F.col("b0"), F.col("b1"), F.col("a0"), F.col("a1")) > fraction)
    texts = held.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x.text), " ").alias("asr_text"))
    return scenes.select(*KEY).join(texts, KEY, "left").select(*KEY, F.coalesce("asr_text", F.lit("")).alias("asr_text"))


def extractions(keyframes: DataFrame, speech: DataFrame) -> DataFrame:
    """``video_id, scene_idx, keyframe_path, asr_text``: either side may be missing, then it is empty."""
    joined = keyframes.join(speech, KEY, "full_outer")
    return joined.select(*KEY, *[F.coalesce(c, F.lit("")).alias(c) for c in ("keyframe_path", "asr_text")])


def upsert_transcripts(known: DataFrame, new: DataFrame) -> DataFrame:
    """``known`` extractions with the texts of ``new`` in place of theirs, an empty one too; new keys have no key frame."""
    fresh = new.select(*KEY, F.coalesce("asr_text", F.lit("")).alias("_new"))
    joined = known.join(fresh, KEY, "full_outer")
    return joined.select(*KEY, F.coalesce("keyframe_path", F.lit("")).alias("keyframe_path"), F.coalesce("_new", "asr_text", F.lit("")).alias("asr_text"))


def question_text(columns: list[str], suffix_en: bool = False) -> Column:
    """The Russian question, else the English, else the plain one; with ``suffix_en`` the English one is added if it differs."""
    have = {c: blank_to_null(F.col(c)) for c in ("question_ru", "question_en", "question") if c in columns}
    main = F.coalesce(*have.values(), F.lit(""))
    if not suffix_en or "question_en" not in have:
        return main
    english = have["question_en"]
    return F.when(english.isNotNull() & (F.lower(english) != F.lower(main)), F.concat_ws(" ", main, english)).otherwise(main)


def asked_texts(columns: list[str]) -> Column:
    """The texts a question adds to a scene: the Russian (else plain) one, and the English one if it differs."""
    null = F.lit(None).cast("string")
    first = F.coalesce(*[F.col(c) for c in ("question_ru", "question") if c in columns], null)
    english = F.col("question_en") if "question_en" in columns else null
    second = F.when(first.isNull() | (F.lower(english) != F.lower(first)), english)
    return F.array_compact(F.array(first, second))


def train_questions(scenes: DataFrame, train: DataFrame) -> DataFrame:
    """``video_id, scene_idx, train_queries``: distinct texts of the questions that overlap a scene, in order of ``qa_id``."""
    missing = {"video_file", "start", "end"} - set(train.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    asked = train.where(sound()).select(file_stem(F.col("video_file")).alias("video_id"), "qa_id", F.col("start").alias("b0"), F.col("end").alias("b1"), asked_texts(train.columns).alias("texts")).where(F.size("texts") > 0)
    spans = scenes.where(sound()).select(*KEY, F.col("start").alias("a0"), F.col("end").alias("a1"))
    met = overlap_join(spans, asked, "video_id", ("a0", "a1"), ("b0", "b1")).where("least(a1, b1) > greatest(a0, b0)")
    first = met.select(*KEY, "qa_id", F.posexplode("texts").alias("at", "text")).groupBy(*KEY, "text").agg(F.min(F.struct("qa_id", "at")).alias("first"))
    return first.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x.text).alias("train_queries"))


def scene_summary(vlm: Column, llm_en: Column, llm_ru: Column, asr: Column, synthetic: Column, train: Column) -> Column:
    """The parts of a scene that have text, one a line."""
    listed = [blank_to_null(F.array_join(x, " | ")) for x in (synthetic, train)]
    parts = [F.coalesce(blank_to_null(llm_en), blank_to_null(vlm)), blank_to_null(llm_ru), blank_to_null(asr), *listed]
    return F.concat_ws("\n", *parts)


def scene_docs(scenes: DataFrame, speech: DataFrame, captions: DataFrame, asked: DataFrame) -> DataFrame:
    """The scene documents; scenes drive, what is missing is empty."""
    cols = ["vlm_caption", "llm_caption_en", "llm_caption_ru", "synthetic_queries"]
    base = scenes.select(*KEY, "start", "end").join(speech.select(*KEY, "asr_text"), KEY, "left")
    base = base.join(captions.select(*KEY, *cols), KEY, "left").join(asked.select(*KEY, "train_queries"), KEY, "left")
    texts = {c: F.coalesce(c, F.lit("")) for c in ("asr_text", *cols[:3])}
    summary = scene_summary(texts["vlm_caption"], texts["llm_caption_en"], texts["llm_caption_ru"], texts["asr_text"], F.col("synthetic_queries"), F.col("train_queries"))
    return base.select(*KEY, "start", "end", *[t.alias(c) for c, t in texts.items()], summary.alias("scene_summary"))


def scene_metadata(docs: DataFrame) -> DataFrame:
    """What the index keeps of a scene document."""
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("asr_text", "llm_caption_en", "llm_caption_ru")]
    return docs.select(F.coalesce("video_id", F.lit("")).alias("video_id"), F.coalesce("scene_idx", F.lit(0)).alias("scene_idx"), F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce("end", F.lit(0.0)).alias("end"), *texts, F.coalesce("scene_summary", F.lit("")).alias("summary"))


def event_metadata(docs: DataFrame) -> DataFrame:
    """What the index keeps of an event document."""
    return docs.select(
        F.coalesce("video_id", F.lit("")).alias("video_id"), F.coalesce("event_idx", F.lit(0)).alias("event_idx"), F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce("end", F.lit(0.0)).alias("end"),
        F.coalesce("center_scene_idx", F.lit(0)).alias("center_scene_idx"), F.coalesce("scene_indices", F.array().cast("array<int>")).alias("scene_indices"), F.coalesce("event_summary", F.lit("")).alias("event_summary"),
    )


def failed(captions: DataFrame, frames: DataFrame) -> DataFrame:
    """``video_id, scene_idx`` of the captions that are empty and have no key frame."""
    joined = captions.join(frames.select(*KEY, "keyframe_path"), KEY, "left")
    return joined.where(blank_to_null(squeeze(F.coalesce("vlm_caption", F.lit("")))).isNull() & blank_to_null(F.col("keyframe_path")).isNull()).select(*KEY).distinct()


def prompt(asr: Column, template: str = "Speech: {asr}\nDescribe the scene.", simple: str = "Describe the scene.", most: int = SETTINGS.prompt_max_chars) -> Column:
    """The caption prompt: with the speech, at most ``most`` characters of it, or the simple one."""
    speech = F.substring(strip(F.coalesce(asr, F.lit(""))), 1, most)
    before, after = template.split("{asr}")
    return F.when(speech != "", F.concat(F.lit(before), speech, F.lit(after))).otherwise(F.lit(simple))


def once_per_audio(scenes: DataFrame, audio: DataFrame) -> DataFrame:
    """``audio_path, videos, scenes``: files to transcribe, each once, with what waits for it."""
    joined = scenes.join(audio.where("audio_path is not null"), "video_id")
    return joined.groupBy("audio_path").agg(F.countDistinct("video_id").alias("videos"), F.count("*").alias("scenes"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows of the parts, by column name."""
    return reduce(DataFrame.unionByName, parts)
