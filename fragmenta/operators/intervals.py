"""Interval arithmetic, interval joins and greedy suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmenta.settings import SETTINGS

#: Cell widths in seconds; an interval's own level is the first that is no narrower than itself.
WIDTHS = (128.0, 2048.0, 65536.0, 1.0e15)


def sound(start: str | Column = "start", end: str | Column = "end") -> Column:
    """Whether both times are numbers and the end comes after the start."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    finite = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < 1e14) & (F.abs(b) < 1e14)
    return finite & (a < b)


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two intervals; 0 if the union is empty."""
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    union = (a1 - a0) + (b1 - b0) - shared
    return F.when(union > 0, F.try_divide(shared, union)).otherwise(0.0)


def covered(seg0: Column, seg1: Column, scene0: Column, scene1: Column) -> Column:
    """The share of a segment that lies in a scene; 0 for a segment without length."""
    shared = F.greatest(F.lit(0.0), F.least(seg1, scene1) - F.greatest(seg0, scene0))
    return F.when(seg1 > seg0, F.try_divide(shared, seg1 - seg0)).otherwise(0.0)


def expand(start: Column, end: Column, source: Column, cap: float = SETTINGS.expand_cap_sec, half: float = SETTINGS.expand_half_sec) -> Column:
    """Struct (start, end) of a fragment brought to a standard length around its middle.

    Fragments of ``train`` sources stay. Those of ``cap`` seconds or more become ``cap``
    long, all others twice ``half``, also the longer ones. A start below 0 becomes 0.
    """
    middle = (start + end) / 2
    reach = F.when(end - start >= cap, F.lit(cap / 2)).otherwise(F.lit(half))
    kept = F.coalesce(source.startswith("train"), F.lit(False))
    return F.struct(F.when(kept, start).otherwise(F.greatest(F.lit(0.0), middle - reach)).alias("start"), F.when(kept, end).otherwise(middle + reach).alias("end"))


def _level(length: Column) -> Column:
    level = F.when(length <= WIDTHS[0], 0)
    for i, width in enumerate(WIDTHS[1:], 1):
        level = level.when(length <= width, i)
    return level.otherwise(len(WIDTHS) - 1)


def _celled(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each cell of its ``level`` that an interval lies in."""
    width = F.element_at(F.array(*[F.lit(w) for w in WIDTHS]), F.col("level") + 1)
    return df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(start) / width).cast("bigint"), F.floor(F.col(end) / width).cast("bigint"))))


def _own(df: DataFrame, start: str, end: str) -> DataFrame:
    return _celled(df.withColumn("level", _level(F.col(end) - F.col(start))), start, end)


def _guests(df: DataFrame, other: DataFrame, key: str, span: tuple[str, str], other_span: tuple[str, str]) -> DataFrame:
    """The rows in cells of wider levels, where the other side has rows of that level.

    The widest level of the other side is a subquery: where it is the narrowest, there
    are no guests and nothing is shuffled for them.
    """
    level = lambda pair: _level(F.col(pair[1]) - F.col(pair[0]))
    widest = other.select(F.max(level(other_span)).alias("widest")).scalar()
    rows = df.withColumn("_own", level(span)).withColumn("_widest", F.coalesce(widest, F.lit(0))).where(F.col("_own") < F.col("_widest"))
    rows = rows.withColumn("level", F.explode(F.sequence(F.col("_own") + 1, F.col("_widest")))).drop("_own", "_widest")
    places = _own(other.select(key, *other_span), *other_span).where("level > 0").select(key, "level", "cell").distinct()
    return _celled(rows, *span).join(places, [key, "level", "cell"], "left_semi")


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """All pairs of one key whose intervals share a point, each pair once.

    Columns of both sides must differ but for ``key``; spans must be sound. An equi-join:
    intervals of one level meet in the cells of that level, of different levels in those
    of the wider one (at most two each), so a key with very many intervals is spread over
    its cells instead of meeting all with all. ``meet`` keeps apart those who meet whom,
    so no two guests ever meet. A pair counts in the cell where the later of the two begins.
    """
    (a0, a1), (b0, b1) = left_span, right_span
    own_a, own_b = _own(left, a0, a1), _own(right, b0, b1)

    def dealt(own: DataFrame, guests: DataFrame, own_meets: str, guest_meets: str) -> DataFrame:
        # Only at wider levels are there guests of the other side to meet.
        meets = F.when(F.col("level") > 0, F.array(F.lit("both"), F.lit(own_meets))).otherwise(F.array(F.lit("both")))
        return own.withColumn("meet", F.explode(meets)).unionByName(guests.withColumn("meet", F.lit(guest_meets)))

    a = dealt(own_a, _guests(left, right, key, left_span, right_span), "left", "right")
    b = dealt(own_b, _guests(right, left, key, right_span, left_span), "right", "left")
    met = a.join(b, [key, "level", "cell", "meet"])
    width = F.element_at(F.array(*[F.lit(w) for w in WIDTHS]), F.col("level") + 1)
    once = F.col("cell") == F.floor(F.greatest(F.col(a0), F.col(b0)) / width).cast("bigint")
    shares = (F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1))
    return met.where(once & shares).drop("level", "cell", "meet")


def suppress(df: DataFrame, groups: list[str], video: str, position: str, threshold: float, start: str = "start", end: str = "end") -> DataFrame:
    """``df`` without the rows that overlap an earlier kept row of the same group and video.

    In the order of ``position`` (ties by start, end) a row stays unless its IoU with a
    row that stayed is above ``threshold``. Suppression never crosses videos, so the
    fold runs per group and video over the few candidates that a query has there.
    """
    cols = [c for c in df.columns if c not in (*groups, video)]
    row = F.struct(F.col(position).alias("_p"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.struct(*cols).alias("_r"))
    ranked = df.groupBy(*groups, video).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    fold = """aggregate(_rows, slice(_rows, 1, 0), (kept, x) -> CASE WHEN exists(kept, k ->
        greatest(0D, least(k._e, x._e) - greatest(k._s, x._s)) > {t} * ((k._e - k._s) + (x._e - x._s) - greatest(0D, least(k._e, x._e) - greatest(k._s, x._s)))
        AND (k._e - k._s) + (x._e - x._s) - greatest(0D, least(k._e, x._e) - greatest(k._s, x._s)) > 0)
      THEN kept ELSE concat(kept, array(x)) END)"""
    kept = ranked.select(*groups, video, F.explode(F.expr(fold.replace("{t}", f"{threshold}D"))).alias("_k"))
    return kept.select(*groups, video, "_k._r.*").select(*df.columns)
