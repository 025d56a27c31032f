"""Readers and writers.

Reads always name their schema, so no pass over the data is spent on inferring
one and a column subset reaches the scan. Writes go to a path the caller gives;
on a cluster that is shared storage.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyward.sources.schemas import KEY_VALUE

# Empty text and NULL are different groups of a report and stay different in a
# file: NULL is a bare empty field, empty text a quoted one. On reading, NULL
# needs a mark of its own, or Spark takes both for NULL.
# Blanks at either end belong to the text, and a quote is doubled, so that a
# backslash stays one.
_CSV_WRITE = {
    "nullValue": "",
    "emptyValue": '""',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "escape": '"',
}
_CSV_READ = {"nullValue": "\0", "emptyValue": "", "escape": '"'}


def _one_line(text: Column) -> Column:
    """Line breaks as ``\\n`` and ``\\r``, and backslashes doubled, so that a record
    is one line and files can be split between tasks."""
    for plain, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _as_it_was(text: Column) -> Column:
    """What ``_one_line`` was given."""

    def broken(part: Column) -> Column:
        part = F.replace(part, F.lit("\\n"), F.lit("\n"))
        return F.replace(part, F.lit("\\r"), F.lit("\r"))

    return F.array_join(F.transform(F.split(text, r"\\\\"), broken), "\\")


def _each_text(df: DataFrame, change) -> DataFrame:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: change(F.col(f"`{c}`")).alias(c) for c in texts})


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    fmt: str = "parquet",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Scan a Parquet, ORC, JSON or headed CSV table, optionally projected.

    Parquet and ORC carry their own schema; text formats need ``schema``.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt in ("csv", "json"):
        raise ValueError(f"a {fmt} table needs an explicit schema")
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    df = reader.format(fmt).load(path)
    return df.select(*columns) if columns else df


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append rows to a Parquet table, e.g. filtered rows to the clean table.

    With ``partition_by=['yearpd']`` a later year range prunes directories. A
    directory cannot tell empty text from NULL, so a text column stays in the
    files and its directories are named by a copy, ``part_<column>``: the text
    behind a ``=``. Rows of a partition meet before they are written, which keeps
    files few; a large partition is still written by several tasks. A second run
    appends the rows a second time; ``append_batch`` does not.
    """
    _write(df, path, partition_by, "append")


def _write(df: DataFrame, path: str, partition_by: Sequence[str], mode: str) -> None:
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    copies = {f"part_{c}": F.concat(F.lit("="), c) for c in partition_by if c in texts}
    if copies:
        df = df.withColumns(copies)
    folders = [f"part_{c}" if c in texts else c for c in partition_by]
    if folders:
        df = df.hint("rebalance", *folders)
    df.write.mode(mode).partitionBy(*folders).parquet(path)


BATCH = "batch"
_BATCH_NAME = re.compile(r"[A-Za-z0-9_.-]+")


def append_batch(
    df: DataFrame, path: str, batch: str, partition_by: Sequence[str] = ()
) -> None:
    """Append rows as a named batch; a batch of that name gives way to them.

    So a job that failed halfway, or ran twice, can run again: afterwards each of
    its rows is there once, and no other batch was touched. A batch is one folder
    of the table, partitioned within as by ``append_table``. Names are ASCII
    letters, digits, dots, hyphens and underscores.
    """
    if not _BATCH_NAME.fullmatch(batch):
        raise ValueError(f"no name of a batch: {batch!r}")
    _write(df, f"{path}/{BATCH}={batch}", partition_by, "overwrite")


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All batches of a table, with ``batch`` as a column to prune by."""
    whole = StructType([*schema.fields, StructField(BATCH, StringType())])
    return read_table(spark, path, whole)


def write_report(df: DataFrame, path: str, index_column: str | None = None) -> None:
    """Write a report as headed CSV part files, with no row-number column."""
    if index_column is not None:
        df = df.drop(index_column)
    df = _each_text(df, _one_line)
    df.write.mode("overwrite").option("header", True).options(**_CSV_WRITE).csv(path)


def read_report(
    spark: SparkSession, path: str, schema: StructType, columns: Sequence[str] | None = None
) -> DataFrame:
    """Read a saved report back; ``columns`` keeps a subset."""
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .options(**_CSV_READ)
        .csv(path)
    )
    df = _each_text(df, _as_it_was)
    return df.select(*columns) if columns else df


def write_key_values(df: DataFrame, path: str) -> None:
    """Write ``key TAB value`` lines without a header."""
    rows = _each_text(df.select("key", "value"), _one_line)
    rows.write.mode("overwrite").options(sep="\t", **_CSV_WRITE).csv(path)


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """Read every part of a ``key TAB value`` result."""
    rows = spark.read.schema(KEY_VALUE).options(sep="\t", **_CSV_READ).csv(path)
    return _each_text(rows, _as_it_was)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw text lines in a single ``value`` column."""
    return spark.read.text(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one named by ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")
