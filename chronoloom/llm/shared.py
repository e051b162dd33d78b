"""Helpers that several training-data operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stored import clean_up, discard, shared_folder
from ..plans.stored import write_out as materialize

__all__ = ["BLANKS", "BLANK_CLASS", "clean_up", "discard", "materialize", "quoted", "shared_folder", "table"]

#: Characters that part words: space and the ASCII controls 9 to 13. ``bytes.split()`` parts on the same six.
BLANKS = " \t\n\x0b\f\r"
#: The same set as a Java regex class body.
BLANK_CLASS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of that name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")
