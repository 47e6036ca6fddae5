from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fragmenta.operators import docs, mining


def test_short_scenes_are_dropped_and_renumbered(spark):
    df = spark.createDataFrame([("v", 0, 0.0, 1.5), ("v", 1, 1.5, 3.5), ("v", 2, 3.5, 9.0)], "video_id string, scene_idx int, start double, end double")
    got = docs.with_keyframe(docs.drop_short(df)).orderBy("scene_idx").collect()
    assert [(r.old_idx, r.scene_idx, r.keyframe_time) for r in got] == [(1, 0, 2.5), (2, 1, 6.25)]
    assert docs.short_counts(df).first().removed == 1


def test_frame_to_seconds(spark):
    df = spark.createDataFrame([(50, 25.0), (50, 0.0), (30, None), (1, 3.0)], "f int, fps double")
    assert [r[0] for r in df.select(docs.seconds(F.col("f"), F.col("fps"))).collect()] == [2.0, 2.0, 1.2, 0.333]


def test_latest_version(spark):
    df = spark.createDataFrame([("v", 1, "old", 1), ("v", 1, "new", 2), ("w", 1, None, None)], "video_id string, scene_idx int, x string, t int")
    assert sorted((r.video_id, r.x) for r in docs.latest(df, docs.KEY, ["t"]).collect()) == [("v", "new"), ("w", None)]


def test_segment_text(spark):
    scenes = spark.createDataFrame([("v", 0, 10.0, 20.0), ("v", 1, 40.0, 50.0), ("v", 2, None, 3.0)], "video_id string, scene_idx int, start double, end double")
    segs = [("v", 2, 7.5, 10.0, " late "), ("v", 1, 7.0, 10.0, "half"), ("v", 0, 20.0, 21.4, "first"), ("v", 3, 12.0, 12.0, "zero"), ("v", 4, 11.0, 12.0, " ")]
    got = docs.segment_text(scenes, spark.createDataFrame(segs, "video_id string, seg_idx int, start double, end double, text string"))
    assert sorted((r.scene_idx, r.asr_text) for r in got.collect()) == [(0, "first late"), (1, ""), (2, "")]


def test_upsert_takes_empty_texts_too(spark):
    known = spark.createDataFrame([("v", 0, "k.jpg", "old"), ("v", 1, "m.jpg", "stays")], "video_id string, scene_idx int, keyframe_path string, asr_text string")
    new = spark.createDataFrame([("v", 0, ""), ("v", 7, "new")], "video_id string, scene_idx int, asr_text string")
    assert sorted(tuple(r) for r in docs.upsert_transcripts(known, new).collect()) == [("v", 0, "k.jpg", ""), ("v", 1, "m.jpg", "stays"), ("v", 7, "", "new")]


def test_scene_summary(spark):
    df = spark.createDataFrame([("", "A", "Б", "", ["x", "y"], None)], "en string, vlm string, ru string, asr string, syn array<string>, q array<string>")
    got = df.select(docs.scene_summary(*(F.col(c) for c in ("vlm", "en", "ru", "asr", "syn", "q")))).first()[0]
    assert got == "A\nБ\nx | y"


def test_train_questions_need_real_overlap(spark):
    scenes = spark.createDataFrame([("v", 0, 0.0, 10.0)], "video_id string, scene_idx int, start double, end double")
    rows = [("c/v.mp4", 1, 10.0, 12.0, None, "touch", None), ("v", 3, 1.0, 2.0, None, "Hi", "hi"), ("v", 2, 1.0, 2.0, "да", "x", "yes"), ("v", 4, 1.0, 2.0, "да", "x", None)]
    train = spark.createDataFrame(rows, "video_file string, qa_id int, start double, end double, question_ru string, question string, question_en string")
    assert docs.train_questions(scenes, train).first().train_queries == ["да", "yes", "Hi"]
    with pytest.raises(ValueError):
        docs.train_questions(scenes, train.drop("video_file"))


def test_audio_resolution_and_priority(spark):
    videos = spark.createDataFrame([("video_a", "video_a", "a.mp4"), ("video_b", "video_b", "b.mp4"), ("video_c", "video_c", None)], "video_id string, audio_key string, video_path string")
    files = spark.createDataFrame([("x/audio_a.wav",), ("x/audio_a.mp3",)], "path string")
    assert {r.video_id: r.audio_path for r in docs.resolve_audio(videos, files).collect()} == {"video_a": "x/audio_a.mp3", "video_b": "b.mp4", "video_c": None}
    first, second = (spark.createDataFrame(r, "video_id string, n int") for r in ([("a", 1)], [("a", 2), ("b", 3)]))
    assert sorted(tuple(r) for r in docs.prefer(first, second, "video_id").collect()) == [("a", 1), ("b", 3)]


def test_prompt_and_failed(spark):
    df = spark.createDataFrame([("\n hello " + "x" * 3000,), (" ",), (None,)], "asr string")
    got = [r[0] for r in df.select(docs.prompt(F.col("asr"))).collect()]
    assert got[0].startswith("Speech: hello xx") and len(got[0]) < 2100 and got[1] == got[2] == "Describe the scene."
    captions = spark.createDataFrame([("v", 0, ""), ("v", 1, ""), ("v", 2, "ok")], "video_id string, scene_idx int, vlm_caption string")
    frames = spark.createDataFrame([("v", 0, "k")], "video_id string, scene_idx int, keyframe_path string")
    assert [(r.video_id, r.scene_idx) for r in docs.failed(captions, frames).collect()] == [("v", 1)]


def test_triplets(spark):
    asked = spark.createDataFrame([(1, "v", 0.0, 10.0, "вопрос", "question"), (2, "w", 0.0, 1.0, "no scene", "")], "query_id int, video_id string, start double, end double, question string, question_en string")
    scenes = spark.createDataFrame([("v", 0, 0.0, 10.0, "good"), ("v", 1, 50.0, 60.0, "bad"), ("v", 2, 70.0, 80.0, "")], "video_id string, scene_idx int, start double, end double, summary string")
    hits = spark.createDataFrame([(1, "v", 0, 1, "good"), (1, "v", 2, 2, ""), (1, "v", 1, 3, "bad"), (2, "v", 1, 1, "bad")], "query_id int, video_id string, scene_idx int, rank int, summary string")
    got = mining.triplets(asked, scenes, hits)
    assert sorted((r.query, r.positive, r.negative) for r in got.collect()) == [("question", "good", "bad"), ("вопрос", "good", "bad")]
    assert mining.labelled_pairs(got).count() == 4


def test_flatten_split_and_resume(spark):
    shots = spark.createDataFrame([("v", "a", [(0, 0.0, 5.0), (1, 5.0, 9.0)]), ("w", None, [])], "video_id string, audio_key string, scenes array<struct<scene_idx:int,start:double,end:double>>")
    flat = docs.flatten_scenes(shots)
    assert [(r.video_id, r.scene_idx) for r in flat.orderBy("scene_idx").collect()] == [("v", 0), ("v", 1)]
    known = spark.createDataFrame([("v", 0)], "video_id string, scene_idx int")
    assert [r.scene_idx for r in docs.pending(flat, known, docs.KEY).collect()] == [1]
    given, rest = docs.split_present(flat, known, "video_id")
    assert (given.count(), rest.count()) == (2, 0)
    audio = spark.createDataFrame([("v", "x.wav")], "video_id string, audio_path string")
    assert tuple(docs.once_per_audio(flat, audio).first()) == ("x.wav", 1, 2)


def test_metadata_has_defaults(spark):
    scene = spark.createDataFrame([("v", None, None, 1.0, None, "c", None, None)], "video_id string, scene_idx int, start double, end double, asr_text string, llm_caption_en string, llm_caption_ru string, scene_summary string")
    assert tuple(docs.scene_metadata(scene).first()) == ("v", 0, 0.0, 1.0, "", "c", "", "")
    event = spark.createDataFrame([(None, 3, 0.0, 1.0, None, None, "t")], "video_id string, event_idx int, start double, end double, center_scene_idx int, scene_indices array<int>, event_summary string")
    assert tuple(docs.event_metadata(event).first()) == ("", 3, 0.0, 1.0, 0, [], "t")


def test_question_forms(spark):
    rows = [("да", "Yes", "x"), ("", "Yes", "x"), (None, None, "x"), ("same", "SAME", None), (None, None, None)]
    df = spark.createDataFrame(rows, "question_ru string, question_en string, question string")
    got = [tuple(r) for r in df.select(docs.question_text(df.columns), docs.question_text(df.columns, True), docs.asked_texts(df.columns)).collect()]
    assert got == [("да", "да Yes", ["да", "Yes"]), ("Yes", "Yes", ["", "Yes"]), ("x", "x", ["x"]), ("same", "same", ["same"]), ("", "", [])]
