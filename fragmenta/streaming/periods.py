"""Continuous periods of a stream of intervals, kept in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fragmenta.operators.interval_map import IntervalMap
from fragmenta.operators.periods import CELL_MS

_KEYS = ["src_table", "video_id", "cell"]
_OUT = "src_table string, video_id string, cell bigint, s bigint, e bigint, change int"


def running_cells(rows: DataFrame) -> DataFrame:
    """How each micro-batch changes the disjoint intervals of each (source, video, cell).

    ``rows(src_table, video_id, s, e)`` as ``interval_rows`` gives them, streaming. The
    state of a key is its ordered map of disjoint intervals, at most ``CELL_MS / 2`` of
    them; new ones are inserted by binary search. Out come only the intervals that a
    batch made (``change`` 1) and those they took the place of (-1).
    """
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends = state.get if state.exists else ([], [])
        known = IntervalMap(starts, ends)
        for batch in batches:
            for s, e in zip(batch.s.tolist(), batch.e.tolist()):
                known.add(s, e)
        state.update((known.starts, known.ends))
        before, after = set(zip(starts, ends)), set(zip(known.starts, known.ends))
        changes = [(s, e, 1) for s, e in sorted(after - before)] + [(s, e, -1) for s, e in sorted(before - after)]
        if changes:
            yield pd.DataFrame([(*key, *c) for c in changes], columns=[*_KEYS, "s", "e", "change"])

    keyed = rows.select("src_table", "video_id", F.floor(F.col("s") / CELL_MS).cast("bigint").alias("cell"), "s", "e")
    return keyed.groupBy(*_KEYS).applyInPandasWithState(update, _OUT, "starts array<bigint>, ends array<bigint>", "update", GroupStateTimeout.NoTimeout)


def standing(changes: DataFrame) -> DataFrame:
    """``interval_rows`` that stand after all the changes so far, for ``periods_and_gaps``."""
    left = changes.groupBy(*_KEYS, "s", "e").agg(F.sum("change").alias("n"))
    return left.where("n > 0").select("src_table", "video_id", "s", "e")
