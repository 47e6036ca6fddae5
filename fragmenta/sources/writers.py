"""Writers. A result appears under its name only when it is whole."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession


def _paths(spark: SparkSession, *paths: str):
    made = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return made[0].getFileSystem(spark._jsc.hadoopConfiguration()), *made


def atomic(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Written beside ``path``, then moved there; readers never see a part of it.

    What was there before is moved aside first and deleted last. A run that stops in
    between leaves it as ``path.old``, from where the next call (or ``restored``) takes
    it back.
    """
    fs, final, staged, aside = _paths(df.sparkSession, path, f"{path}.part", f"{path}.old")
    restored(df.sparkSession, path)
    df.write.mode("overwrite").format(kind).options(**options).save(f"{path}.part")
    if fs.exists(final) and not fs.rename(final, aside):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(staged, final):
        raise OSError(f"{path}.part could not be moved")
    fs.delete(aside, True)


def restored(spark: SparkSession, path: str) -> str:
    """``path``, with what a stopped ``atomic`` moved aside back in place."""
    fs, final, aside = _paths(spark, path, f"{path}.old")
    if fs.exists(aside):
        if fs.exists(final):
            fs.delete(aside, True)
        else:
            fs.rename(aside, final)
    return path


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON document a line, UTF-8."""
    atomic(df, path, "json")


def append(df: DataFrame, path: str) -> None:
    """More rows of a table, without rewriting it."""
    df.write.mode("append").parquet(path)


def csv_file(df: DataFrame, path: str) -> None:
    """One CSV file with a header, in the order of the columns: a table of one row per query."""
    atomic(df.coalesce(1), path, "csv", header="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")


def cached(spark: SparkSession, folder: str, inputs: list[DataFrame], settings: object, make) -> DataFrame:
    """The result of ``make()``, kept in ``folder`` under a fingerprint of inputs and settings.

    The files behind the inputs (names, sizes, times) and the settings go into the name,
    so a rebuilt index is never answered from an old cache.
    """
    files = []
    for df in inputs:
        for name in sorted(df.inputFiles()):
            fs, place = _paths(spark, name)
            status = fs.getFileStatus(place)
            files.append((name, status.getLen(), status.getModificationTime()))
    mark = hashlib.sha256(json.dumps([files, repr(settings)]).encode()).hexdigest()[:24]
    path = f"{folder}/{mark}"
    fs, done = _paths(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        atomic(make(), path)
    return spark.read.parquet(path)
