"""Session helpers: table access, the shared checkpoint folder, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``; it is used as it is. Only where that
    is unset and everything runs on this machine (tests, a laptop) a temporary folder is
    made, which goes with the process.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="fragmenta-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        sc.setCheckpointDir(made)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared checkpoint folder.

    Used where a result is read more than once or where recomputing it after the
    loss of an executor would repeat a whole chain of shuffles.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder.

    As ``cut``, for results that are read several times and a few columns at a time.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_folder(spark: SparkSession) -> str:
    """The folder of this application in the shared one; it is removed when the process ends, or by ``forget``."""
    path = f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        _OWN[path] = (place.getFileSystem(spark._jsc.hadoopConfiguration()), place)
        atexit.register(_remove, path)
    return path


def forget(spark: SparkSession) -> None:
    """Removes what ``written`` and the streams left in the shared folder; call it when the results are saved."""
    _remove(own_folder(spark))


_OWN: dict = {}


def _remove(path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM, or the folder, may be gone
        fs, place = _OWN[path]
        fs.delete(place, True)
