"""The offline build and the search as stages that read and write tables.

Every stage writes its tables whole and under their final name only when done, so a run
can begin at any stage and a failed one leaves what was there before.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmenta.functions import spell, text
from fragmenta.operators import docs, fusion, models
from fragmenta.plans import pipeline
from fragmenta.settings import SETTINGS, Settings
from fragmenta.sources import readers, writers
from fragmenta.streaming import ready

STAGES = ("shots", "extract", "caption", "documents", "index", "search")


@dataclass
class Models:
    """The seams that need a model, each with its stand-in."""

    shots: models.Factory = field(default_factory=models.fixed_shots)
    keyframes: models.Factory = field(default_factory=models.fixed_keyframes)
    speech: models.Factory = field(default_factory=models.fixed_speech)
    captions: models.Factory = field(default_factory=models.fixed_captions)


def preprocess(queries: DataFrame, train: DataFrame, id_col: str = "query_id", text_col: str = "question", correct: bool = True, russian: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(<id_col>, <text_col>)`` normalised, corrected and with foreign scripts read out.

    ``russian`` is the seam for a Russian correction model: it takes and gives
    ``(<id_col>, <text_col>)`` of the texts that are mainly Cyrillic.
    """
    spark = queries.sparkSession
    clean = queries.select(id_col, text.normalize(F.col(text_col)).alias(text_col))
    if correct:
        terms = spell.whitelist(train, [c for c in ("question_en", "answer_en") if c in train.columns], "topic")
        keep = terms.select("term").union(spark.createDataFrame([(w,) for w in spell.DOMAIN_WORDS], "term string")).distinct()
        clean = spell.correct(clean, id_col, text_col, terms.where("n is not null"), keep).select(id_col, F.coalesce("corrected", text_col).alias(text_col))
    if russian is not None:
        cyrillic = F.coalesce(text.main_script(F.col(text_col)) == "ru", F.lit(False))
        clean = clean.where(~cyrillic).unionByName(russian(clean.where(cyrillic)).select(id_col, text_col))
    return clean.select(id_col, text.transliterate(F.col(text_col)).alias(text_col))


def retry_failed(captions: DataFrame, frames: DataFrame, scenes: DataFrame, videos: DataFrame, made: Models) -> DataFrame:
    """``captions`` with a new row for every failed scene whose video is known; a replaced row loses its optional fields."""
    again = docs.failed(captions, frames).join(scenes.select(*docs.KEY), docs.KEY).join(videos.select("video_id", "video_path"), "video_id").where("video_path is not null")
    shot = models.apply_model(again, made.keyframes, "video_id string, scene_idx int, keyframe_path string").where("keyframe_path <> ''")
    told = models.apply_model(shot.withColumn("prompt", docs.prompt(F.lit(None).cast("string"))), made.captions, "video_id string, scene_idx int, vlm_caption string")
    rest = docs.pending(captions, told, docs.KEY)
    return rest.unionByName(told, allowMissingColumns=True)


@dataclass
class Pipeline:
    """``inputs`` holds ``videos, train_qa, queries`` as Parquet (and may hold ``translations``); ``root`` gets the tables."""

    spark: SparkSession
    inputs: str
    root: str
    models: Models = field(default_factory=Models)
    settings: Settings = SETTINGS
    dim: int = 96

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(writers.restored(self.spark, f"{self.root}/{name}.parquet"))

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.inputs}/{name}.parquet")

    def write(self, df: DataFrame, name: str) -> None:
        writers.atomic(df, f"{self.root}/{name}.parquet")

    def run(self, from_stage: str = "shots", streaming: bool = False, to_stage: str = "search") -> dict[str, float]:
        """Runs the stages between the two, both included; gives the seconds of each.

        With ``streaming`` scenes are captioned as their parts arrive, in place of the
        batch stage.
        """
        first, last = STAGES.index(from_stage), STAGES.index(to_stage)
        took = {}
        for stage in STAGES[first : last + 1]:
            began = time.perf_counter()
            self._caption_stream() if stage == "caption" and streaming else getattr(self, f"_{stage}")()
            took[stage] = time.perf_counter() - began
        return took

    def _shots(self) -> None:
        videos = self.given("videos")
        found = models.apply_model(videos.select("video_id", "duration"), self.models.shots, "video_id string, scene_idx int, start double, end double")
        self.write(docs.with_keyframe(docs.drop_short(found, self.settings.min_scene_sec)).drop("old_idx"), "scenes_raw")

    def _extract(self) -> None:
        videos, scenes = self.given("videos"), self.read("scenes_raw")
        frames = models.apply_model(scenes.join(videos.select("video_id", "video_path"), "video_id", "left").select(*docs.KEY, "video_path"), self.models.keyframes, "video_id string, scene_idx int, keyframe_path string")
        spoken = models.apply_model(videos.select("video_id", "duration"), self.models.speech, "video_id string, seg_idx int, start double, end double, text string")
        self.write(frames, "keyframes")
        self.write(docs.segment_text(scenes, spoken, self.settings.asr_margin_sec, self.settings.asr_min_fraction), "speech")
        self.write(docs.extractions(self.read("keyframes"), self.read("speech")), "extractions")

    def _told(self, found: DataFrame) -> DataFrame:
        asked = found.withColumn("prompt", docs.prompt(F.col("asr_text"), most=self.settings.prompt_max_chars))
        return models.apply_model(asked.select(*docs.KEY, "keyframe_path", "prompt"), self.models.captions, "video_id string, scene_idx int, vlm_caption string")

    def _caption(self) -> None:
        todo = self.read("extractions")
        known = f"{self.root}/captions.parquet"
        if not readers.exists(self.spark, known):
            self.write(self._told(todo), "captions")
            return
        fresh = self._told(docs.pending(todo, self.read("captions"), docs.KEY))
        writers.append(fresh, known)

    def _caption_stream(self) -> None:
        a = ready.arrivals(self.spark, self.root, "keyframes", self.read("keyframes").schema)
        b = ready.arrivals(self.spark, self.root, "speech", self.read("speech").schema)
        place = f"{self.root}/caption_stream"
        ready.start(ready.ready(a, b), f"{place}/out", f"{place}/checkpoint", self._told).awaitTermination()
        out = self.spark.read.schema("video_id string, scene_idx int, vlm_caption string").parquet(f"{place}/out/batch=*")
        self.write(out.select(*docs.KEY, "vlm_caption").dropDuplicates(docs.KEY), "captions")

    def _documents(self) -> None:
        captions = self.read("captions")
        for name, kind in (("llm_caption_en", "string"), ("llm_caption_ru", "string"), ("synthetic_queries", "array<string>")):
            if name not in captions.columns:
                captions = captions.withColumn(name, F.lit(None).cast(kind))
        scenes, train = self.read("scenes_raw"), self.given("train_qa")
        made = docs.scene_docs(scenes, self.read("speech"), captions, docs.train_questions(scenes, train))
        self.write(made, "scenes")
        self.write(pipeline.windows.event_windows(self.read("scenes"), self.settings.window_sec, self.settings.window_step_sec), "events")

    def _index(self) -> None:
        meta = docs.scene_metadata(self.read("scenes"))
        key = F.xxhash64("video_id", "scene_idx")
        self.write(meta.select(key.alias("doc_id"), "*", models.hashed_vector(F.col("summary"), self.dim).alias("vec")), "scenes_index")
        events = docs.event_metadata(self.read("events"))
        self.write(events.select(F.col("event_idx").alias("doc_id"), "*", models.hashed_vector(F.col("event_summary"), self.dim).alias("vec")), "events_index")
        train = self.given("train_qa")
        asked = train.select(F.col("qa_id").alias("doc_id"), docs.file_stem(F.col("video_file")).alias("video_id"), "start", "end", docs.question_text(train.columns).alias("question"), docs.question_text(train.columns, True).alias("_t"))
        self.write(asked.withColumn("vec", models.hashed_vector(F.col("_t"), self.dim)).drop("_t"), "train_index")

    def _search(self) -> None:
        given = self.given("queries").select("query_id", "question")
        has = readers.exists(self.spark, f"{self.inputs}/translations.parquet")
        other = self.given("translations") if has else self.spark.createDataFrame([], readers.TRANSLATIONS)
        texts = fusion.query_texts(given, other)
        asked = texts.select("query_id", F.coalesce("main", F.lit("")).alias("question"), "english", models.hashed_vector(F.coalesce("main", F.lit("")), self.dim).alias("vec"), models.hashed_vector(F.col("english"), self.dim).alias("vec_en"))
        corpus = pipeline.Corpus(self.read("scenes_index"), self.read("train_index"), self.read("events_index"))
        results = pipeline.search(asked, corpus, self.settings)
        self.write(results, "results")
        writers.csv_file(pipeline.submission(given, self.read("results"), self.settings).orderBy("query_id"), f"{self.root}/submission.csv")
