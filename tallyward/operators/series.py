"""Trend lines and growth of a series with one row per period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.operators.counting import COUNT


def linear_trend(series: DataFrame, x: str, y: str = COUNT) -> DataFrame:
    """Least-squares line of y on x: adds ``slope``, ``intercept``, ``trend``.

    Pairs with a NULL do not enter the fit; a row with NULL x has NULL trend.
    The fit is one aggregate over the series, used as a scalar.
    """
    fit = series.agg(
        F.struct(
            F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
        ).alias("fit")
    ).scalar()
    slope, intercept = fit["slope"], fit["intercept"]
    return series.select(
        "*",
        slope.alias("slope"),
        intercept.alias("intercept"),
        (intercept + slope * F.col(x)).alias("trend"),
    )


def growth(series: DataFrame, period: str, value: str = COUNT, name: str = "ratio") -> DataFrame:
    """Growth over the period before; the first period has none and is left out.

    The window runs over one row per period (calendar years: at most 9,999),
    never over raw rows. Rows without a period are not part of the series.
    """
    before = F.lag(value).over(Window.orderBy(period))
    return (
        series.filter(F.col(period).isNotNull())
        .select(period, (F.try_divide(F.col(value), before) - 1).alias(name))
        .filter(F.col(name).isNotNull())
    )


def side_by_side(left: DataFrame, right: DataFrame, period: str) -> DataFrame:
    """Two series on a common period column; a period of only one has NULL."""
    return left.join(right, period, "full_outer")
