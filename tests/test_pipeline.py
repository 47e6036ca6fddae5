from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fragmenta.plans import run


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("inputs"))
    spark.createDataFrame([("video_0a", 65.0, "video_0a.mp4"), ("video_0b", 31.0, "video_0b.mp4"), ("video_0c", 12.0, None)], "video_id string, duration double, video_path string").write.parquet(f"{base}/videos.parquet")
    train = [(1, "c/video_0a.mp4", 0.0, 20.0, "красный шар", "red ball", "x", "a", "toys"), (2, "video_0b", 5.0, 12.0, None, "blue bird", None, "b", "birds")]
    spark.createDataFrame(train, "qa_id bigint, video_file string, start double, end double, question_ru string, question_en string, question string, answer_en string, topic string").write.parquet(f"{base}/train_qa.parquet")
    spark.createDataFrame([(1, "red ball"), (2, None), (3, "красный шар")], "query_id int, question string").write.parquet(f"{base}/queries.parquet")
    return base


def test_whole_run(spark, inputs, tmp_path):
    job = run.Pipeline(spark, inputs, f"{tmp_path}/batch")
    assert list(job.run()) == list(run.STAGES)
    rows = {r.query_id: r for r in spark.read.csv(f"{tmp_path}/batch/submission.csv", header=True, inferSchema=True).collect()}
    assert set(rows) == {1, 2, 3} and rows[1].video_file_1 == "video_0a" and rows[2].video_file_1 == "video_00000000"
    assert job.read("scenes").where("train_queries is not null" if "train_queries" in job.read("scenes").columns else "scene_summary like '%red ball%'").count() > 0
    assert list(job.run("documents", to_stage="index")) == ["documents", "index"]


def test_streamed_captions_equal_batch(spark, inputs, tmp_path):
    batch, stream = (run.Pipeline(spark, inputs, f"{tmp_path}/{n}") for n in "ab")
    batch.run(to_stage="caption")
    stream.run(to_stage="caption", streaming=True)
    assert sorted(map(tuple, batch.read("captions").collect())) == sorted(map(tuple, stream.read("captions").collect()))


def test_captions_resume_and_retry(spark, inputs, tmp_path):
    job = run.Pipeline(spark, inputs, f"{tmp_path}/r")
    job.run(to_stage="caption")
    n = job.read("captions").count()
    job.run("caption", to_stage="caption")
    assert job.read("captions").count() == n
    captions, frames = job.read("captions").withColumn("llm_caption_en", F.lit("kept")), job.read("keyframes").withColumn("keyframe_path", F.lit(""))
    broken = captions.withColumn("vlm_caption", F.when(F.col("scene_idx") == 0, "").otherwise(F.col("vlm_caption")))
    mended = run.retry_failed(broken, frames, job.read("scenes_raw"), job.given("videos"), run.Models())
    rows = {(r.video_id, r.scene_idx): r for r in mended.collect()}
    assert len(rows) == n and rows["video_0a", 0].vlm_caption and rows["video_0a", 0].llm_caption_en is None and rows["video_0a", 1].llm_caption_en == "kept"
    assert rows["video_0c", 0].vlm_caption == ""


def test_preprocess(spark, inputs):
    queries = spark.createDataFrame([(1, "ReD  balI blau"), (2, "привeт"), (3, None)], "query_id int, question string")
    got = {r.query_id: r.question for r in run.preprocess(queries, spark.read.parquet(f"{inputs}/train_qa.parquet"), russian=lambda df: df.withColumn("question", F.upper("question"))).collect()}
    assert got[2] == "ПРИВЕТ" and got[3] is None and len(got) == 3


def test_search_covers_every_channel(spark):
    """An event, a translation and a past question each bring what the scenes' main wording can't; ids of the tables overlap."""
    from fragmenta.operators.models import hashed_vector
    from fragmenta.plans import pipeline

    def corpus(rows, name):
        return spark.createDataFrame(rows, f"doc_id bigint, video_id string, start double, end double, {name} string").withColumn("vec", hashed_vector(F.col(name)))

    scenes = corpus([(1, "video_0a", 0.0, 10.0, "red ball"), (2, "video_0b", 0.0, 10.0, "шар")], "summary")
    events = corpus([(1, "video_0c", 0.0, 110.0, "шар синий"), (2, "video_0d", 0.0, 110.0, "red ball park")], "event_summary")
    train = corpus([(1, "video_0e", 3.0, 9.0, "красный шар"), (2, "video_0f", 3.0, 9.0, "красный шар")], "question")
    asked = spark.createDataFrame([(7, "красный шар", "red ball", 1)], "query_id bigint, question string, english string, own bigint")
    asked = asked.withColumns({"vec": hashed_vector(F.col("question")), "vec_en": hashed_vector(F.col("english"))})
    full = pipeline.Corpus(scenes, train, events)
    rows = pipeline.candidates(asked, full).collect()
    assert [s for _, s in sorted({(r.channel_ord, r.source) for r in rows})] == ["train_high", *[f"{way}_{kind}_{tag}" for tag in ("main", "en") for way in ("dense", "sparse") for kind in ("scenes", "events")]]
    assert {r.video_id for r in rows if r.source == "train_high"} == {"video_0f"}  # without the query's own row
    found = {r.video_id: r for r in pipeline.search(asked, full).collect()}
    assert set(found) == {"video_0a", "video_0b", "video_0c", "video_0d", "video_0f"}
    assert found["video_0f"].slot == 1 and found["video_0f"].reranker_score > 5 and found["video_0a"].score_en > found["video_0a"].score_main
