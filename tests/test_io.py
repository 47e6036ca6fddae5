from __future__ import annotations

from pyspark.sql import functions as F

from fragmenta.operators.periods import interval_rows, periods_and_gaps
from fragmenta.sources import readers, writers
from fragmenta.streaming import periods, ready


def test_files_round_trip(spark, tmp_path):
    base = str(tmp_path)
    df = spark.createDataFrame([("v", 1, "a\nb \"c\""), ("w", 2, "д")], "video_id string, n int, t string")
    writers.atomic(df, f"{base}/t")
    writers.atomic(df.limit(1), f"{base}/t")
    assert spark.read.parquet(f"{base}/t").count() == 1
    (tmp_path / "t").rename(tmp_path / "t.old")  # as a run leaves it that stops between the two moves
    assert spark.read.parquet(writers.restored(spark, f"{base}/t")).count() == 1
    odd = spark.createDataFrame([(1, ' "a", b\n\\c '), (2, ""), (3, None)], "query_id int, question string")
    writers.csv_file(odd, f"{base}/odd.csv")
    assert sorted(map(tuple, readers.csv(spark, f"{base}/odd.csv", readers.QUERIES).collect())) == sorted(map(tuple, odd.collect()))
    writers.json_lines(df, f"{base}/j")
    assert sorted(r.t for r in readers.json_lines(spark, f"{base}/j", "video_id string, n int, t string").collect()) == ["a\nb \"c\"", "д"]
    assert readers.json_lines(spark, f"{base}/none", "a int").count() == 0
    (tmp_path / "q.csv").write_text('query_id,question\n1,"two\nlines ""q"""\n2,x\n', encoding="utf-8")
    rows = readers.csv(spark, f"{base}/q.csv", readers.QUERIES, ("query_id",)).orderBy("query_id").collect()
    assert (rows[0].query_id, rows[0].question) == (1, 'two\nlines "q"')
    (tmp_path / "shots.json").write_text('[{"video_id": "v", "audio_key": "1"}, {"video_id": "v", "audio_key": "2"}]')
    assert [r.audio_key for r in readers.json_documents(spark, f"{base}/shots.json", readers.SHOTS, "video_id").collect()] == ["2"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "video_a.MP4").write_bytes(b"x")
    (tmp_path / "m" / "note.txt").write_bytes(b"x")
    assert [r.video_id for r in readers.media_files(spark, f"{base}/m").collect()] == ["video_a"]


def test_cache_follows_its_inputs(spark, tmp_path):
    base = str(tmp_path)
    made = []

    def result(n):
        spark.range(n).write.mode("overwrite").parquet(f"{base}/in")
        source = spark.read.parquet(f"{base}/in")
        return writers.cached(spark, f"{base}/cache", [source], "settings", lambda: made.append(n) or source).count()

    assert result(3) == 3 and result(5) == 5 and made == [3, 5]
    source = spark.read.parquet(f"{base}/in")
    assert writers.cached(spark, f"{base}/cache", [source], "settings", lambda: made.append(0)).count() == 5 and made == [3, 5]


def _part(spark, rows, schema, path, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{n}")


def test_ready_join_and_resume(spark, tmp_path):
    base = str(tmp_path)
    a, b = "video_id string, scene_idx int, keyframe_path string", "video_id string, scene_idx int, asr_text string"
    spark.createDataFrame([("v", 1, "k1"), ("v", 2, "k2"), ("v", 2, "k2")], a).write.parquet(f"{base}/kf.parquet")
    spark.createDataFrame([("v", 2, "s2"), ("v", 1, "s1"), ("v", 3, "s3")], b).write.parquet(f"{base}/asr.parquet")
    done = spark.createDataFrame([("v", 2)], "video_id string, scene_idx int")

    def run():
        kf, asr = ready.arrivals(spark, base, "kf", a, 1), ready.arrivals(spark, base, "asr", b, 1)
        ready.start(ready.ready(kf, asr, done), f"{base}/out", f"{base}/cp").awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(f"{a}, asr_text string").parquet(f"{base}/out/batch=*").collect())

    assert run() == [("v", 1, "k1", "s1")]
    assert run() == [("v", 1, "k1", "s1")]


def test_streamed_periods_equal_batch(spark, tmp_path):
    base = str(tmp_path)
    schema = "v string, start double, end double"
    parts = [[("a", 0.0, 5.0), ("b", 1.0, 2.0)], [("a", 4.0, 9.0), ("a", 20.0, 30.0)], [("a", 9.0, 10.0), ("b", 3.0, 4.0)]]
    for n, rows in enumerate(parts):
        _part(spark, rows, schema, f"{base}/in", n)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    found = periods.running_cells(interval_rows(stream, "t", F.col("v")))
    query = found.writeStream.outputMode("update").format("memory").queryName("running").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.table("running")
    assert sorted((r.video_id, r.s, r.e, r.change) for r in changes.collect() if r.video_id == "b") == [("b", 1000, 2000, 1), ("b", 3000, 4000, 1)]
    batch = spark.createDataFrame([r for p in parts for r in p], schema)
    want = {tuple(r) for r in periods_and_gaps(interval_rows(batch, "t", F.col("v"))).collect()}
    assert {tuple(r) for r in periods_and_gaps(periods.standing(changes)).collect()} == want


def test_what_waited_too_long_comes_out_alone(spark, tmp_path):
    base = str(tmp_path)
    a, b = "video_id string, scene_idx int, keyframe_path string, arrived timestamp", "video_id string, scene_idx int, asr_text string, arrived timestamp"
    hour = lambda h: f"2024-01-0{1 + h // 24} {h % 24:02d}:00:00"
    for n, (key, at) in enumerate([(1, 0), (2, 0), (9, 30), (10, 40)]):
        _part(spark, [("v", key, f"k{key}", hour(at))], a.replace("timestamp", "string"), f"{base}/kf", n)
        _part(spark, [("v", 2 if key == 1 else key + 50, f"s{key}", hour(at))], b.replace("timestamp", "string"), f"{base}/asr", n)
    read = lambda name, schema: spark.readStream.schema(schema.replace("timestamp", "string")).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/{name}").withColumn("arrived", F.col("arrived").cast("timestamp"))
    met = ready.ready_all(read("kf", a), read("asr", b), "6 hours")
    ready.start(met, f"{base}/out", f"{base}/cp").awaitTermination()
    out = spark.read.schema("video_id string, scene_idx int, keyframe_path string, asr_text string, a_time timestamp, complete boolean").parquet(f"{base}/out/batch=*").collect()
    assert {(r.scene_idx, r.keyframe_path, r.asr_text, r.complete) for r in out} >= {(1, "k1", None, False), (2, "k2", "s1", True), (52, None, "s2", False)}


def test_model_batches_are_bounded(spark):
    from fragmenta.operators import models

    make = lambda: lambda batch: batch.assign(n=len(batch))
    sizes = [r.n for r in models.apply_model(spark.range(0, 300, 1, 1), make, "id bigint, n bigint").collect()]
    assert sorted(set(sizes)) == [44, 128] and len(sizes) == 300
    assert models.first_there(spark, [("/none/there", None), (None, make)]) is make
