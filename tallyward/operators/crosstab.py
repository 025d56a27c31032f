"""Cross-tabulation of two category columns.

The long form has one row per cell that occurs and works for any number of
labels. The wide form has one column for each label it is given and one more for
all others, so that nothing is lost and rows add up; 0 where a cell is absent.
Rows with a NULL label on either side do not count.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from tallyward.operators.counting import COUNT, count_by, share_within, tally


# The column of labels that have none of their own.
REST = "other labels"


def crosstab(df: DataFrame, row: str, column: str, weight: str | None = None) -> DataFrame:
    return count_by(df.na.drop(subset=[row, column]), row, column, weight=weight)


def crosstab_share(df: DataFrame, row: str, column: str, weight: str | None = None) -> DataFrame:
    """Cells with their share of the row; the shares of a row add up to 1."""
    return share_within(crosstab(df, row, column, weight), row)


def crosstab_wide(
    df: DataFrame,
    row: str,
    column: str,
    labels: Sequence[str],
    weight: str | None = None,
) -> DataFrame:
    """One row per ``row`` value, sorted; one column per label, then REST."""
    cells = df.na.drop(subset=[row, column])
    pivoted = _spread(cells, row, column, labels).agg(tally(weight))
    return pivoted.select(row, *[_zero(c) for c in [*labels, REST]]).orderBy(row)


def _spread(df: DataFrame, row: str, column: str, labels: Sequence[str]) -> GroupedData:
    """Groups by ``row``, spread over the labels and REST."""
    listed = F.when(F.col(column).isin(list(labels)), F.col(column)).otherwise(REST)
    return df.withColumn(column, listed).groupBy(row).pivot(column, [*labels, REST])


def crosstab_wide_share(wide: DataFrame, row: str) -> DataFrame:
    """Divide each cell of a wide cross-tab by the sum of its row."""
    cells = [c for c in wide.columns if c != row]
    row_sum = reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in cells])
    return wide.select(row, *[F.try_divide(F.col(f"`{c}`"), row_sum).alias(c) for c in cells])


def unstack(
    report: DataFrame, row: str, column: str, labels: Sequence[str], value: str = COUNT
) -> DataFrame:
    """Spread a long report over columns, REST the last; an absent cell stays NULL."""
    return _spread(report, row, column, labels).agg(F.sum(value)).orderBy(row)


def pivot_mean(
    report: DataFrame, row: str, column: str, labels: Sequence[str], value: str
) -> DataFrame:
    """As ``unstack``, with the mean where a cell, or REST, has several rows."""
    return _spread(report, row, column, labels).agg(F.avg(value)).orderBy(row)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(0)).alias(name)
