"""Grouped counts and sums, rankings, shares and slices.

Grouping columns hold categories, so a grouped result is small next to its
input; Spark combines on the map side before the one shuffle, which also takes
the weight off a category that holds a large part of the rows.

``weight`` names a column of counts where the input was already grouped once:
the same operators then add the weights up instead of counting rows.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNT = "count"


def tally(weight: str | None = None) -> Column:
    return (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias(COUNT)


def count_by(df: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(tally(weight))


def sum_by(df: DataFrame, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(f"sum({value})"))


def regroup(counts: DataFrame, *keys: str) -> DataFrame:
    """Second-stage grouping of a count report."""
    return count_by(counts, *keys, weight=COUNT)


def settled(counts: DataFrame) -> DataFrame:
    """A grouped report below which no later filter or join may move.

    Catalyst moves a filter on a grouping column down to the raw rows. Where one
    report is used twice, filtered and whole, that makes two scans of the raw
    table out of one; behind this step both uses share the grouped result.
    """
    return counts.select(F.inline(F.array(F.struct(*counts.columns))))


def total(counts: DataFrame, value: str = COUNT) -> Column:
    """The sum of a report as a scalar to use in an expression.

    It is a scalar subquery over the same grouped plan, so Spark reuses the
    shuffle the report has already paid for, and no task sees the whole report.
    """
    return counts.agg(F.sum(value)).scalar()


def ranked(counts: DataFrame, key: str, value: str = COUNT, descending: bool = True) -> DataFrame:
    """Order by value; ties go by key, so that the order is the same every run."""
    by_value = F.col(value).desc() if descending else F.col(value).asc()
    return counts.orderBy(by_value, F.col(key).asc_nulls_first())


def top_n(counts: DataFrame, key: str, n: int, value: str = COUNT) -> DataFrame:
    return ranked(counts, key, value).limit(n)


def keep_members(df: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """Rows whose value occurs in the same column of ``members``."""
    return df.join(members.select(column), column, "left_semi")


def share_of_total(counts: DataFrame, value: str = COUNT, name: str = "share") -> DataFrame:
    return counts.withColumn(name, F.try_divide(F.col(value), total(counts, value)))


def share_within(
    counts: DataFrame, *keys: str, value: str = COUNT, name: str = "share"
) -> DataFrame:
    """Share of each row in the total of its group.

    The group totals are joined on rather than taken over a window: a window
    would bring all rows of a group into one task. NULL keys form a group.
    """
    renamed = {k: f"_total_{k}" for k in keys}
    totals = counts.groupBy(*[F.col(k).alias(renamed[k]) for k in keys]).agg(
        F.sum(value).alias("_total")
    )
    same_group = reduce(
        lambda a, b: a & b, [counts[k].eqNullSafe(totals[renamed[k]]) for k in keys]
    )
    return (
        counts.join(totals, same_group)
        .withColumn(name, F.try_divide(F.col(value), F.col("_total")))
        .drop("_total", *renamed.values())
    )


def slice_of(df: DataFrame, column: str, value, *order: str) -> DataFrame:
    """The rows of one group, without the grouping column, sorted if asked."""
    rows = df.filter(F.col(column) == value).drop(column)
    return rows.orderBy(*order) if order else rows


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).na.drop().distinct()


@contextmanager
def persisted(df: DataFrame):
    """Hold a prepared table in memory and on disk while a batch of reports runs."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()
