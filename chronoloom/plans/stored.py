"""Tables that are derived once and kept in the shared folder, so that later plans scan files instead of deriving again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; a local master may make its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset; a cluster must name a shared folder")
    import tempfile

    folder = tempfile.mkdtemp(prefix="chronoloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/chronoloom-{spark.sparkContext.applicationId}"


def write_out(df: DataFrame, options: dict | None = None) -> DataFrame:
    """``df`` written, with a writer's ``options``, and read again: a plan behind it starts from files that outlive any executor."""
    path = f"{_own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``write_out`` returned, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application has written out. Lazy results that read it must have been used by then."""
    delete(spark, _own_folder(spark))
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        del _KEPT[key]


_KEPT: dict[tuple, object] = {}


def kept(spark: SparkSession, name: tuple, make: Callable[[str], object]) -> object:
    """What ``make`` built in a folder of this application, built once for each name."""
    key = (spark.sparkContext.applicationId, *name)
    if key not in _KEPT:
        _KEPT[key] = make(f"{_own_folder(spark)}/{uuid.uuid4().hex}")
    return _KEPT[key]
