from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fragmenta.functions import spell, text
from fragmenta.operators import fusion, models, retrieval, submit


def test_dense_topk_equals_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8)).astype(np.float32)
    v[7] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0] * 7), (902, [0.0] * 8), (903, [float("nan")] * 8)]
    corpus = spark.createDataFrame(rows, "doc_id bigint, vec array<float>")
    queries = corpus.where("doc_id < 5 or doc_id > 899").withColumnRenamed("doc_id", "query_id")
    got = {(r.query_id, r.rank): r.doc_id for r in retrieval.dense_topk(corpus, queries, 6).collect()}
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
    for q in range(5):
        score = np.round(u @ u[q], 6)
        assert [got[q, r] for r in range(1, 7)] == sorted(range(200), key=lambda i: (-score[i], i))[:6]
    assert {q for q, _ in got} == set(range(5))
    assert retrieval.dense_topk(corpus.limit(0), queries, 3).count() == 0 == retrieval.dense_topk(corpus, queries.limit(0), 3).count()


def test_train_match(spark):
    hits = spark.createDataFrame([(1, i, s, i) for i, s in enumerate([0.90, 0.885, 0.85, 0.79], 1)], "query_id int, doc_id int, score double, rank int")
    assert [(r.source, r.list_rank) for r in retrieval.train_match(hits).orderBy("rank").collect()] == [("train_high", 1), ("train_high", 2), ("train_low", 1)]


def test_bm25_and_sparse_handle_empty_texts(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat cat"), (3, ""), (4, None), (5, "bird")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "Cat"), (2, ""), (3, None)], "query_id int, text string")
    assert [r.doc_id for r in retrieval.bm25_topk(docs, queries).orderBy("rank").collect()] == [2, 1]
    assert retrieval.bm25_topk(docs.limit(0), queries).count() == 0


def test_maxsim(spark):
    q = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]])], "query_id int, vecs array<array<double>>")
    d = spark.createDataFrame([(5, [[0.5, 0.5], [1.0, 0.0]])], "doc_id int, vecs array<array<double>>")
    pairs = spark.createDataFrame([(1, 5)], "query_id int, doc_id int")
    assert retrieval.maxsim(pairs, q, d).first().score == 1.5


def _two_channels(spark):
    rows = [(1, 0, 1, "A", "x"), (1, 0, 2, "A", "y"), (1, 1, 1, "B", "y"), (1, 1, 2, "B", "x")]
    return spark.createDataFrame(rows, "query_id int, channel_ord int, rank int, source string, video_id string").withColumns({"start": F.lit(0.0), "end": F.lit(1.0)})


def test_rrf_both_ways(spark):
    found = _two_channels(spark)
    split = fusion.rrf(found, ["video_id", "start", "end", "source"]).orderBy("position").collect()
    assert [(r.source, r.video_id) for r in split] == [("A", "x"), ("B", "y"), ("A", "y"), ("B", "x")]
    summed = fusion.rrf(found, ["video_id", "start", "end"]).orderBy("position").collect()
    assert [r.video_id for r in summed] == ["x", "y"] and abs(summed[0].rrf_score - (1 / 61 + 1 / 62)) < 1e-9


def test_cluster(spark):
    rows = [("a", 9.0), ("b", 8.0), ("c", 1.0), ("a", 1.0), ("b", 7.0), ("c", 1.0)]
    df = spark.createDataFrame([(1, i, v, s) for i, (v, s) in enumerate(rows, 1)], "query_id int, position int, video_id string, reranker_score double")
    assert [(r.video_id, r.position) for r in fusion.cluster(df).orderBy("slot").collect()] == [("b", 2), ("b", 5), ("a", 1), ("a", 4), ("c", 3)]
    assert [r.position for r in fusion.cluster(df.limit(3)).orderBy("slot").collect()] == [1, 2, 3]


def test_rerank_boost(spark):
    df = spark.createDataFrame([(1, 1, "dense", 1.0, 2.0), (1, 2, "train_high", 0.0, None), (1, 3, "dense", 2.0, None)], "query_id int, position int, source string, score_main double, score_en double")
    assert [(r.source, r.reranker_score) for r in fusion.rerank(df, 2).orderBy("position").collect()] == [("train_high", 5.0), ("dense", 2.0)]


def test_wide_tables(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    results = spark.createDataFrame([(1, 1, "a", 0.0, 1.23456), (1, 2, "b", 2.0, 3.0)], "query_id int, slot int, video_id string, start double, end double")
    rows = {r.query_id: r for r in submit.padded(queries, results).collect()}
    assert [rows[1][f"video_file_{i}"] for i in range(1, 6)] == ["a", "b", "b", "b", "b"] and rows[1].end_1 == 1.235
    assert rows[2].video_file_5 == "video_00000000" and rows[2].end_1 == 30.0
    blank = {r.query_id: r for r in submit.empty_padded(queries, results).collect()}
    assert [blank[1][f"video_file_{i}"] for i in range(1, 6)] == ["a", "b", "", "", ""] and blank[2].end_1 == 0.0
    assert submit.fill_rate(submit.padded(queries, results)).first().fill == 0.5


def test_composite_recall(spark):
    truth = spark.createDataFrame([(1, "a", 0.0, 10.0), (2, "b", 0.0, 10.0)], "query_id int, true_video string, true_start double, true_end double")
    results = spark.createDataFrame([(1, 1, "a", 50.0, 60.0), (1, 2, "a", 0.0, 9.0)], "query_id int, slot int, video_id string, start double, end double")
    rates = {r.k: (r.success_rate, r.video_recall) for r in submit.composite_recall(results, truth).collect()}
    assert rates == {1: (0.0, 0.5), 3: (0.5, 0.5), 5: (0.5, 0.5)}


def _one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(f(F.col("t"))).collect()]


def test_text_functions(spark):
    assert _one(spark, text.normalize, "climactIc  shOt", "NASA", "camelCase", "aBCd", "", None, "привeт мир", "ab аб") == ["climactic shot", "NASA", "camelcase", "aBCd", "", None, "привет мир", "ab аб"]
    assert _one(spark, text.main_script, "hello мир", "мир a", "", None) == ["en", "ru", "en", None]
    assert _one(spark, text.has_russian, "hello мир", "hi") == [True, False]
    assert _one(spark, text.transliterate, "letter ع here", "буква ع тут", "ما", "幹嘛 x", "plain", None) == ["letter ع here  letter ain here", "буква ع тут  буква айн тут", "ما  ma", "幹嘛 x  gan ma x", "plain", None]
    df = spark.createDataFrame([("«a»", 'say "b"​  c'), ("a", 'x "y"')], "o string, c string")
    assert [r[0] for r in df.select(text.restore_quotes(F.col("o"), F.col("c"))).collect()] == ["say «b» c", 'x "y"']
    assert _one(spark, lambda c: text.without_prefix(c, "video_"), "video_a", "x_video_b", "c") == ["a", "x_b", "c"]


def test_whitelist_and_spelling(spark):
    df = spark.createDataFrame([("Cat cat dog", None, "sea-life")], "q string, a string, topic string")
    assert {r.term for r in spell.whitelist(df, ["q", "a"], "topic").collect()} == {"cat", "sea", "life"}
    assert spell.damerau("abdc", "abcd") == 1 and spell.damerau("ca", "abc") == 2 and spell.damerau("", "ab") == 2
    terms = spark.createDataFrame([("station", 5), ("nation", 9), ("abcd", 1)], "term string, n bigint")
    keep = spark.createDataFrame([("cat",)], "term string")
    asked = spark.createDataFrame([(1, "The Staiton, cat xx STAITON"), (2, None), (3, "")], "id int, t string")
    got = {r.id: r.corrected for r in spell.correct(asked, "id", "t", terms, keep).collect()}
    assert got[1] == "The Station, cat xx STAITON" and got[2] is None


def test_models(spark):
    videos = spark.createDataFrame([("v", 25.0)], "video_id string, duration double")
    shots = models.apply_model(videos, models.fixed_shots(), "video_id string, scene_idx int, start double, end double")
    assert [(r.start, r.end) for r in shots.orderBy("scene_idx").collect()] == [(0.0, 10.0), (10.0, 20.0), (20.0, 25.0)]
    vec = spark.createDataFrame([("a b",), ("",)], "t string").select(models.hashed_vector(F.col("t"), 16)).collect()
    assert abs(sum(x * x for x in vec[0][0]) - 1) < 1e-6 and vec[1][0] is None


def test_long_words_are_searched_exactly(spark):
    """Around the length where pieces take the place of forms, against all pairs; a run of letters costs no more."""
    import random

    rng = random.Random(3)
    terms = ["".join(rng.choice("abcd") for _ in range(n)) for n in (22, 23, 24, 25, 26, 27, 40, 90) for _ in range(4)]
    words = []
    for t in terms:
        for _ in range(3):
            w = list(t)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(w) - 1)
                kind = rng.randrange(4)
                if kind == 0:
                    del w[i]
                elif kind == 1:
                    w.insert(i, rng.choice("abcd"))
                elif kind == 2:
                    w[i] = rng.choice("abcd")
                else:
                    w[i], w[i + 1] = w[i + 1], w[i]
            words.append("".join(w))
    known = spark.createDataFrame([(t, 1) for t in terms], "term string, n bigint")
    got = {r.word: (r.fix, r.distance) for r in spell.closest(spark.createDataFrame([(w,) for w in [*words, "a" * 5_000]], "word string"), known).collect()}
    want = {w: min((spell.damerau(w, t), t) for t in terms) for w in words}
    assert got == {w: (t, d) for w, (d, t) in want.items() if d <= 2} and len(got) > 40


def test_repeated_ids_keep_their_texts(spark):
    asked = spark.createDataFrame([(1, "the staiton"), (1, "a nation"), (None, "the staiton")], "id int, t string")
    terms = spark.createDataFrame([("station", 5), ("nation", 9), ("the", 9)], "term string, n bigint")
    keep = spark.createDataFrame([("the",)], "term string")
    got = sorted((r.t, r.corrected) for r in spell.correct(asked, "id", "t", terms, keep).collect())
    assert got == [("a nation", "a nation"), ("the staiton", "the station"), ("the staiton", "the station")]
