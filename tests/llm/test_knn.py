from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from fragmenta.llm import knn

SCHEMA = "doc_id bigint, vec array<float>, id int, h string"


def brute(ids, v, k):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(u @ u.T, knn.DECIMALS)
    np.fill_diagonal(s, -9)
    return {ids[i]: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k] if s[i, j] > -2] for i in range(len(ids))}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(150, 96))
    v = np.concatenate([c + 0.3 * rng.normal(size=(12, 96)) for c in centres]).astype(np.float32)
    ids = list(range(10, 10 + len(v)))
    df = spark.createDataFrame([(i, x.tolist(), 1, "x") for i, x in zip(ids, v)], SCHEMA)
    got: dict = {}
    for r in knn.neighbours(df).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    want = brute(ids, v.astype(np.float64), 5)
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in ids]) >= 0.98


def test_copies_bad_vectors_and_ties(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 96)).astype(np.float32)
    rows = [(i, base[0].tolist()) for i in range(20)] + [(100 + i, base[i].tolist()) for i in range(1, 6)] + [(200, (base[1] * 2).tolist())]
    bad = [(300, None), (301, [1.0] * 95), (302, [1.0] * 97), (303, [0.0] * 96), (304, [float("nan")] * 96), (305, [float("inf")] * 96), (306, [None] * 96), (None, base[2].tolist())]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], SCHEMA)
    got: dict = {}
    for r in knn.neighbours(df).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    assert set(got) == {i for i, _ in rows}
    assert got[0] == [1, 2, 3, 4, 5] and got[19] == [0, 1, 2, 3, 4]
    assert got[101][0] == 200 and got[200][0] == 101
    assert got == brute([i for i, _ in rows], np.array([v for _, v in rows], np.float64), 5)
    pairs = knn.neighbour_pairs(df).collect()
    assert len({tuple(p) for p in pairs}) == len(pairs) and all(p.doc_id_a < p.doc_id_b for p in pairs)


def test_slices_of_a_list_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = (np.ones(96) + 0.05 * rng.normal(size=(300, 96))).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 1, "x") for i, x in enumerate(v)], SCHEMA)
    monkeypatch.setattr(knn, "SLICE", 3)
    monkeypatch.setattr(knn, "PROBES", 100)
    monkeypatch.setattr(knn, "RERANK", 400)
    got: dict = {}
    for r in knn.neighbours(df, probes=100).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    want = brute(list(range(300)), v.astype(np.float64), 5)
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) >= 0.99


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, [1.0] * 96, 1, "x")], SCHEMA)
    assert knn.neighbours(df).count() == 0 and knn.neighbours(df.limit(0)).count() == 0


def test_recall_where_a_list_has_several_groups(spark, monkeypatch, tmp_path):
    """As in a large table: groups of few rows, more groups than lists, and no centroid near a group."""
    monkeypatch.setattr(knn, "MAX_LISTS", 128)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(1500, 96))
    v = np.repeat(centres, 8, axis=0) + 0.33 * rng.normal(size=(12_000, 96))
    ids = np.arange(12_000)
    pq.write_table(pa.table({"doc_id": ids, "vec": pa.array(list(v.astype(np.float32)))}), tmp_path / "rows.parquet")
    got: dict = {}
    for r in knn.neighbours(spark.read.parquet(str(tmp_path / "rows.parquet"))).collect():
        got.setdefault(r.id, set()).add(r.other)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u[:1000] @ u.T
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(got[i] & set(want[i])) / 5 for i in range(1000)]) >= 0.99


def test_a_list_in_slices_gives_each_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 96)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 1, "x") for i, x in enumerate(v)], SCHEMA)
    monkeypatch.setattr(knn, "SLICE", 50)
    rows = knn.neighbours(df, probes=12).collect()
    assert len(rows) == 5 * 400 == len({(r.id, r.other) for r in rows})
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r.id, r.rank)):
        got.setdefault(r.id, []).append(r.cosine)
    assert all(c == sorted(c, reverse=True) for c in got.values())
