from __future__ import annotations

import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fragmenta.operators import intervals, windows
from fragmenta.operators.interval_map import IntervalMap
from fragmenta.operators.periods import file_stem, interval_rows, periods_and_gaps


def brute(rows):
    """Periods and gaps of (key, s, e) rows, by sorting."""
    out = set()
    for key in {r[0] for r in rows}:
        merged = []
        for s, e in sorted((s, e) for k, s, e in rows if k == key):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(key, "period", s, e) for s, e in merged}
        out |= {(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if b[0] - a[1] < 21_600_000}
    return out


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)), max_size=40))
def test_interval_map_equals_sorting(pairs):
    known = IntervalMap()
    for s, n in pairs:
        known.add(s, s + n)
    found = {("k", "period", s, e) for s, e in zip(known.starts, known.ends)} | {("k", "gap", s, e) for s, e in known.gaps()}
    assert found == brute([("k", s, s + n) for s, n in pairs])


def test_periods_over_cells_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [("v%d" % rng.choice([0, 0, 0, 1, 2]), s := rng.randrange(0, 90_000_000), s + rng.choice([1, 500, 40_000, 9_000_000])) for _ in range(600)]
    rows += rows[:50] + [("hot", 5, 50_000_000), ("hot", 3_600_000, 3_600_001), ("hot", 50_000_000, 50_000_002)]
    df = spark.createDataFrame([("t", k, s, e) for k, s, e in rows], "src_table string, video_id string, s bigint, e bigint")
    found = [tuple(r) for r in periods_and_gaps(df).collect()]
    assert len(found) == len(set(found))
    assert {r[1:] for r in found} == brute(rows)


def test_interval_rows_leave_out_what_counts_for_nothing(spark):
    nan = float("nan")
    data = [("a", 0.0, 1.0), ("a", 0.0, 0.0004), (None, 0.0, 1.0), (" ", 0.0, 1.0), ("a", nan, 1.0), ("a", None, 1.0), ("a", 2.0, 1.0), ("a", 0.0, float("inf"))]
    df = spark.createDataFrame([(*r, "x", 1) for r in data], "v string, start double, end double, s string, cell int")
    assert [tuple(r) for r in interval_rows(df, "t", F.col("v")).collect()] == [("t", "a", 0, 1000)]
    assert periods_and_gaps(interval_rows(df.limit(0), "t", F.col("v"))).count() == 0


def test_file_stem(spark):
    df = spark.createDataFrame([("clips/v_1.mp4",), ("v_1",), ("a\\b\\v.MKV",), (None,), (".hidden",), ("x.y.z",)], "p string")
    assert [r[0] for r in df.select(file_stem(F.col("p"))).collect()] == ["v_1", "v_1", "v", None, ".hidden", "x.y"]


def test_iou_and_share(spark):
    df = spark.createDataFrame([(0.0, 10.0, 5.0, 15.0), (0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    assert [round(r[0], 6) for r in df.select(intervals.iou(*map(F.col, "abcd"))).collect()] == [0.333333, 0.0]
    segs = spark.createDataFrame([(7.0, 10.0), (7.5, 10.0), (20.0, 23.0), (12.0, 12.0)], "s double, e double")
    got = [round(r[0], 6) for r in segs.select(intervals.covered(F.col("s"), F.col("e"), F.lit(8.5), F.lit(21.5))).collect()]
    assert got == [0.5, 0.6, 0.5, 0.0]


def test_expand(spark):
    rows = [(100.0, 110.0, "dense"), (0.0, 20.0, "dense"), (0.0, 150.0, None), (0.0, 300.0, "bm25"), (1.0, 2.0, "train_low")]
    df = spark.createDataFrame(rows, "s double, e double, src string").select(intervals.expand(*map(F.col, ("s", "e", "src"))).alias("x"))
    assert [(r.x.start, r.x.end) for r in df.collect()] == [(50.0, 160.0), (0.0, 65.0), (20.0, 130.0), (44.0, 256.0), (1.0, 2.0)]


def test_suppress_in_order(spark):
    spans = [(0.0, 10.0), (1.0, 11.0), (9.0, 19.0), (8.0, 18.0)]
    df = spark.createDataFrame([(1, i, "v", s, e) for i, (s, e) in enumerate(spans)] + [(1, 9, "w", 0.0, 10.0)], "query_id int, position int, video_id string, start double, end double")
    kept = intervals.suppress(df, ["query_id"], "video_id", "position", 0.3)
    assert sorted(r.position for r in kept.collect()) == [0, 2, 9]
    again = intervals.suppress(kept, ["query_id"], "video_id", "position", 0.3)
    assert again.count() == kept.count()


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(8)
    make = lambda n: [("v", i, s := rng.uniform(-100, 9000), s + rng.choice([0.5, 20.0, 64.0, 700.0, 30_000.0])) for i in range(n)]
    a, b = make(80), make(70)
    left = spark.createDataFrame(a, "video_id string, i int, a0 double, a1 double")
    right = spark.createDataFrame(b, "video_id string, j int, b0 double, b1 double")
    got = [(r.i, r.j) for r in intervals.overlap_join(left, right, "video_id", ("a0", "a1"), ("b0", "b1")).collect()]
    want = {(x[1], y[1]) for x in a for y in b if x[2] <= y[3] and y[2] <= x[3]}
    assert len(got) == len(set(got)) and set(got) == want


def test_event_windows(spark):
    scenes = spark.createDataFrame([("v", 0, 3.5, 20.0, "a"), ("v", 1, 20.0, 31.0, "b"), ("w", 0, 1.0, 1.0, "c"), ("x", 4, 0.0, 5.0, "")], "video_id string, scene_idx int, start double, end double, scene_summary string")
    rows = windows.event_windows(scenes).orderBy("event_idx").collect()
    assert [(r.start, r.scene_indices, r.center_scene_idx, r.event_idx, r.event_summary) for r in rows] == [
        (3.5, [0, 1], 1, 0, "a b"), (13.5, [0, 1], 1, 1, "a b"), (23.5, [1], 1, 2, "b"),
    ]


def test_running_number_is_global(spark):
    rows = [(f"video_{i % 37:02d}_{i % 5}", i) for i in range(300)]
    df = windows.running_number(spark.createDataFrame(rows, "g string, o int"), "g", "o", "n")
    got = [(r.g, r.o) for r in df.orderBy("n").collect()]
    assert got == sorted(rows) and [r.n for r in df.orderBy("n").collect()] == list(range(300))
