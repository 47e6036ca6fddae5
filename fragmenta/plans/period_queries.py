"""Periods and gaps of the scene, event and question tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmenta.operators.periods import file_stem, interval_rows, periods_and_gaps
from fragmenta.session import own_folder, table
from fragmenta.streaming import periods, ready


def _rows(read) -> DataFrame:
    """The intervals of the three tables, each by ``read(name)``."""
    parts = [
        interval_rows(read("scenes"), "scenes", F.col("video_id")),
        interval_rows(read("events_doc"), "events_doc", F.col("video_id")),
        interval_rows(read("train_qa"), "train_qa", file_stem(F.col("video_file"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Periods and gaps of every video, each table by itself."""
    return periods_and_gaps(_rows(lambda name: table(spark, base, name)))


def stream_periods(spark: SparkSession, base: str) -> DataFrame:
    """The same from streams of the tables: changes in keyed state, then what stands."""
    place = f"{own_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = _rows(lambda name: ready.arrivals(spark, base, name, table(spark, base, name).schema))
    writer = ready.start(periods.running_cells(stream), f"{place}/out", f"{place}/checkpoint", mode="update")
    writer.awaitTermination()
    changes = spark.read.schema("src_table string, video_id string, cell bigint, s bigint, e bigint, change int").parquet(f"{place}/out/batch=*")
    return periods_and_gaps(periods.standing(changes))


def p3_summary(spark: SparkSession, base: str) -> DataFrame:
    """Per table and kind: how many, and how long in all."""
    found = p3_found(spark, base)
    return found.groupBy("src_table", "kind").agg(
        F.count("*").alias("n"), F.countDistinct("video_id").alias("videos"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms")
    )


_FOUND = r"""
WITH raw AS (
  SELECT 'scenes' AS src_table, video_id, start AS a, "end" AS b FROM scenes
  UNION ALL SELECT 'events_doc', video_id, start, "end" FROM events_doc
  UNION ALL SELECT 'train_qa', regexp_replace(regexp_extract(video_file, '([^/\\]*)$', 1), '^(.+)\.[^.]*$', '\1'), start, "end" FROM train_qa
), iv AS (
  SELECT src_table, video_id, CAST(round(a * 1000) AS BIGINT) AS s, CAST(round(b * 1000) AS BIGINT) AS e
  FROM raw WHERE isfinite(a) AND isfinite(b) AND abs(a) < 9e15 AND abs(b) < 9e15 AND trim(video_id) <> ''
), prev AS (
  SELECT *, max(e) OVER (PARTITION BY src_table, video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
  FROM iv WHERE s < e
), numbered AS (
  SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY src_table, video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n
  FROM prev
), period AS (
  SELECT src_table, video_id, n, min(s) AS s, max(e) AS e FROM numbered GROUP BY ALL
), gap AS (
  SELECT src_table, video_id, lag(e) OVER (PARTITION BY src_table, video_id ORDER BY n) AS s, s AS e FROM period
), found AS (
  SELECT src_table, video_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM period
  UNION ALL SELECT src_table, video_id, 'gap', s, e FROM gap WHERE e - s < 21600000
)
"""

QUERIES = {"p3_found": p3_found, "p3_summary": p3_summary, "stream_periods": stream_periods}

ORACLE = {
    "p3_found": _FOUND + "SELECT * FROM found",
    "stream_periods": _FOUND + "SELECT * FROM found",
    "p3_summary": _FOUND + "SELECT src_table, kind, count(*) AS n, count(DISTINCT video_id) AS videos, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms FROM found GROUP BY ALL",
}
