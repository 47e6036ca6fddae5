"""Continuous periods and gaps of the intervals of each entity.

Each Arrow batch is folded into keyed state: one ordered disjoint-interval map per
(source, entity, cell), where a cell is a fixed stretch of time. Insertion locates
overlaps by binary search. The maps are merged after one shuffle of the already
collapsed intervals; what is left between cells is one row per cell.

A cell of ``CELL_MS`` milliseconds can hold at most ``CELL_MS / 2`` disjoint
intervals, so the state of one key is bounded however many rows one entity has, and
a hot entity is spread over its cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.operators.interval_map import IntervalMap
from fragmenta.session import cut

#: Length of a cell; at most this many / 2 intervals are ever held for one key.
CELL_MS = 3_600_000
#: A stretch of this length or more ends a recording and is no gap.
GAP_LIMIT_MS = 21_600_000
#: Intervals that one task holds before it hands its maps on.
STATE_LIMIT = 500_000

_KEYS = ["src_table", "video_id", "cell"]
_PART = "src_table string, video_id string, cell bigint, s bigint, e bigint"


def millis(seconds: Column) -> Column:
    """Seconds as whole milliseconds; null for null, NaN and infinite times."""
    sound = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < 9.0e15)
    return F.when(sound, F.round(seconds * 1000).cast("bigint"))


def file_stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def interval_rows(df: DataFrame, src: str, video: Column) -> DataFrame:
    """``(src_table, video_id, s, e)`` of the rows that count.

    Rows with a null, NaN or infinite time, without a video (null or blank), or whose
    rounded end isn't after the rounded start are left out.
    """
    rows = df.select(F.lit(src).alias("src_table"), video.alias("video_id"), millis(F.col("start")).alias("s"), millis(F.col("end")).alias("e"))
    return rows.where("trim(video_id) <> '' and s < e")


def _emit(state: dict[tuple, IntervalMap]) -> Iterator[pd.DataFrame]:
    if state:
        yield pa.table(
            {
                "src_table": pa.array([k[0] for k, m in state.items() for _ in m.starts], pa.string()),
                "video_id": pa.array([k[1] for k, m in state.items() for _ in m.starts], pa.string()),
                "cell": pa.array([k[2] for k, m in state.items() for _ in m.starts], pa.int64()),
                "s": pa.array([x for m in state.values() for x in m.starts], pa.int64()),
                "e": pa.array([x for m in state.values() for x in m.ends], pa.int64()),
            }
        )


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keyed state over the rows of a task; maps are handed on at STATE_LIMIT."""
    state: dict[tuple, IntervalMap] = {}
    held = 0
    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("src_table", "video_id", "cell", "s", "e")]
        for src, video, cell, s, e in zip(*cols):
            known = state.get((src, video, cell))
            if known is None:
                known = state[src, video, cell] = IntervalMap()
            held += known.add(s, e)
        if held > STATE_LIMIT:
            for t in _emit(state):
                yield from t.to_batches()
            state, held = {}, 0
    for t in _emit(state):
        yield from t.to_batches()


def _fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_fold`` for rows sorted by key: only the key at hand is held."""
    key, current, done = None, IntervalMap(), {}
    held = 0
    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("src_table", "video_id", "cell", "s", "e")]
        for src, video, cell, s, e in zip(*cols):
            if (src, video, cell) != key:
                if key is not None:
                    done[key] = current
                    held += len(current)
                    if held > STATE_LIMIT // 8:
                        for t in _emit(done):
                            yield from t.to_batches()
                        done, held = {}, 0
                key, current = (src, video, cell), IntervalMap()
            current.add(s, e)
    if key is not None:
        done[key] = current
    for t in _emit(done):
        yield from t.to_batches()


def disjoint(rows: DataFrame) -> DataFrame:
    """The disjoint intervals of each (source, video, cell) from ``interval_rows``."""
    keyed = rows.select("src_table", "video_id", F.floor(F.col("s") / CELL_MS).cast("bigint").alias("cell"), "s", "e")
    part = keyed.mapInArrow(_fold, _PART)
    return part.repartition(*[F.col(k) for k in _KEYS]).sortWithinPartitions(*_KEYS).mapInArrow(_fold_sorted, _PART)


def periods_and_gaps(rows: DataFrame, gap_limit_ms: int = GAP_LIMIT_MS) -> DataFrame:
    """``(src_table, video_id, kind, start_ms, end_ms)`` from ``interval_rows``.

    ``kind`` is ``period`` or ``gap``. Intervals that touch belong to one period; a
    gap is shorter than ``gap_limit_ms``. Repeated rows change nothing; an empty
    table gives no rows. Each row appears once.
    """
    cells = cut(disjoint(rows))
    entity = ["src_table", "video_id"]
    per_cell = Window.partitionBy(*_KEYS).orderBy("s")
    # One row per cell: the furthest end in the cells before it.
    reach = cells.groupBy(*_KEYS).agg(F.max("e").alias("far"))
    before = Window.partitionBy(*entity).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = reach.select(*_KEYS, F.max("far").over(before).alias("carry"))
    joined = cells.join(carried, _KEYS)
    prev = joined.withColumn("prev_end", F.greatest("carry", F.max("e").over(per_cell.rowsBetween(Window.unboundedPreceding, -1))))
    heads = prev.where("prev_end is null or s > prev_end")
    # The end of a period is what was reached before the next head, or at the very end.
    in_cell = heads.withColumn("next_end", F.lead("prev_end").over(per_cell))
    first_head = heads.groupBy(*_KEYS).agg(F.min_by("prev_end", "s").alias("first_prev"))
    after = Window.partitionBy(*entity).orderBy("cell").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*entity)
    bounds = reach.join(first_head, _KEYS, "left").select(
        *_KEYS, F.coalesce(F.first("first_prev", ignorenulls=True).over(after), F.max("far").over(whole)).alias("later_end")
    )
    ended = in_cell.join(bounds, _KEYS)
    end = F.coalesce("next_end", "later_end")
    gap = F.when(F.col("prev_end").isNotNull() & (F.col("s") - F.col("prev_end") < gap_limit_ms), F.struct(F.lit("gap").alias("kind"), F.col("prev_end").alias("start_ms"), F.col("s").alias("end_ms")))
    period = F.struct(F.lit("period").alias("kind"), F.col("s").alias("start_ms"), end.alias("end_ms"))
    return ended.select(*entity, F.inline(F.filter(F.array(period, gap), lambda x: x.isNotNull())))
