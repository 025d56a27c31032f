"""Row lookups. A limit always comes with an order, so it keeps the same rows.

A search of few rows goes in two steps: the search itself, then the rows of other
tables by the keys it found. The keys are literals of the second step's filters,
so they reach the scans, and no other table is joined or shuffled whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def limited(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first rows in order; a limit of 0 means all rows."""
    return df.orderBy(*order).limit(limit) if limit else df


def find_equal(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == value)


def find_younger(df: DataFrame, column: str, age: int) -> DataFrame:
    """Rows of the open age band below ``age``, e.g. ``<18``."""
    return find_equal(df, column, f"<{age}")


def find_like(
    df: DataFrame, column: str, pattern: str, *order: str, limit: int = 10
) -> DataFrame:
    """Rows whose text matches the pattern anywhere, in any case."""
    return limited(df.filter(F.col(column).rlike(f"(?i){pattern}")), limit, *order)


def find_one(df: DataFrame, column: str, value, *order: str) -> DataFrame:
    """The row with this id, or no row; the first in order if several have it."""
    return limited(find_equal(df, column, value), 1, *(order or df.columns))


def preview(df: DataFrame, *order: str, n: int = 20) -> DataFrame:
    return limited(df, n, *order)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename by projection; a column the table lacks becomes NULL."""
    return df.select(
        *[
            (F.col(source) if source in df.columns else F.lit(None).cast("string")).alias(name)
            for source, name in names.items()
        ]
    )


def restored(records: DataFrame, names: dict[str, str], with_id: bool = False) -> DataFrame:
    """Back to the table's own column names, without the id unless asked for."""
    table = records.select(*[F.col(name).alias(source) for source, name in names.items()])
    return table if with_id else table.drop(next(iter(names)))


@dataclass(frozen=True)
class Fetched:
    """The few rows of a search, as they were when it ran."""

    rows: pa.Table

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows)

    def keys(self, column: str) -> list:
        """The distinct values of a column, without NULL."""
        return sorted(set(self.rows[column].drop_null().to_pylist()))


def fetched(search: DataFrame, most: int) -> Fetched:
    """Run a search that has ``most`` rows at the most; more are an error."""
    rows = search.limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"a search of at most {most} rows found more")
    return Fetched(rows)


def with_keys(df: DataFrame, column: str, keys: list) -> DataFrame:
    """The rows with these keys; the scan sees them. Without keys there are none."""
    if len(keys) == 1:
        return find_equal(df, column, keys[0])
    return df.filter(F.col(column).isin(keys))
