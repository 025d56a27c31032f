"""Helpers the operators share: words, tables cut off from their lineage, sizes."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Runs of anything but the six ASCII blanks (space and U+0009 to U+000D).
BLANKS = r"[\x20\x09-\x0D]+"


def blank_words(text: Column) -> Column:
    """The words of ``text`` as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the folder ``spark.checkpoint.dir``
    names, and read back.

    All executors share that folder, so a lost executor costs no earlier stage,
    and the rows stay the same however often the result is read.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the folder, by a path that only Spark has to understand."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
