"""Histograms, density curves and box summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.operators.counting import COUNT, count_by, regroup, total


def histogram(df: DataFrame, value: str, width: int, from_smallest: bool = False) -> DataFrame:
    """``bin`` (its lower end), ``count`` and ``density`` = count / (N * width).

    Bins start at multiples of the width, or at the smallest value.
    """
    values = count_by(df.filter(F.col(value).isNotNull()), value)
    start = values.agg(F.min(value)).scalar() if from_smallest else F.lit(0)
    bins = regroup(
        values.select(
            (F.floor((F.col(value) - start) / width) * width + start).alias("bin"), COUNT
        ),
        "bin",
    )
    return bins.withColumn("density", F.try_divide(F.col(COUNT), total(bins) * width))


def density_curve(df: DataFrame, value: str, points: int = 500) -> DataFrame:
    """Gaussian kernel density at ``points`` places from the smallest value on.

    The bandwidth is stddev_samp * n^(-1/5). Rows are first grouped to distinct
    whole-number values; each of those adds its kernel to every place, and the
    sums per place combine on the map side, so no pair of rows ever meets.
    """
    values = count_by(df.filter(F.col(value).isNotNull()), value)
    v, n = F.col(value).cast("double"), F.col(COUNT)
    # Sums of squares cancel for large values; those from the smallest on do not.
    least = values.agg(F.min(v)).scalar()
    values, over = values.withColumn("least", least), v - F.col("least")
    moments = values.agg(
        F.sum(n).cast("double").alias("n"),
        F.sum(n * over).alias("s1"),
        F.sum(n * over * over).alias("s2"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
    )
    variance = F.try_divide(
        F.col("s2") - F.try_divide(F.col("s1") * F.col("s1"), F.col("n")), F.col("n") - 1
    )
    shape = moments.select(
        F.struct(
            "n", "low", "high", (F.sqrt(variance) * F.pow("n", F.lit(-0.2))).alias("h")
        )
    ).scalar()
    placed = (
        values.withColumn("shape", shape)
        .withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn(
            "x",
            F.col("shape.low")
            + F.col("place") * (F.col("shape.high") - F.col("shape.low")) / points,
        )
        .withColumn("z", F.try_divide(F.col("x") - v, F.col("shape.h")))
    )
    height = F.try_divide(
        F.sum(n * F.exp(F.col("z") * F.col("z") * -0.5)),
        F.first("shape.n") * F.first("shape.h") * math.sqrt(2 * math.pi),
    )
    return placed.groupBy("place", "x").agg(height.alias("density"))


def binned_density_curve(df: DataFrame, value: str, points: int = 500) -> DataFrame:
    """``density_curve`` for a measure with many values, from counts on its grid.

    Each row is shared out between the two places beside it, by nearness, and the
    kernel runs over distances between places: two passes over the rows, each
    combined to at most ``points`` + 1 rows before it moves, and ``points`` squared
    kernels, however many values there are. Against the exact curve a place is off
    by at most (step / bandwidth) squared / 8 of the curve's highest kernel sum,
    1 / (bandwidth * sqrt(2 * pi)); rows without a finite value are left out.
    """
    v = F.col(value).cast("double")
    rows = df.select(v.alias("v")).filter(F.abs(F.col("v")) < float("inf"))
    shape = rows.agg(
        F.count("v").cast("double").alias("n"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.stddev_samp("v").alias("sd"),
    ).select(
        F.struct(
            "n",
            "low",
            ((F.col("high") - F.col("low")) / points).alias("step"),
            (F.col("sd") * F.pow("n", F.lit(-0.2))).alias("h"),
        )
    ).scalar()
    at = F.coalesce(
        F.try_divide(F.col("v") - F.col("shape.low"), F.col("shape.step")), F.lit(0.0)
    )
    # Rounding can put the highest value a hair beyond the last place.
    below = F.least(F.floor("at"), F.lit(points - 1).cast("long"))
    shared = (
        rows.withColumn("shape", shape)
        .withColumn("at", at)
        .withColumn("below", below)
        .withColumn("over", F.col("at") - F.col("below"))
        .groupBy("below")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("over").alias("over"))
    )
    sides = F.array(
        F.struct(F.col("below").alias("bin"), (F.col("rows") - F.col("over")).alias("mass")),
        F.struct((F.col("below") + 1).alias("bin"), F.col("over").alias("mass")),
    )
    bins = shared.select(F.inline(sides)).groupBy("bin").agg(F.sum("mass").alias("mass"))
    placed = bins.withColumn("shape", shape).withColumn(
        "place", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    )
    z = F.try_divide((F.col("place") - F.col("bin")) * F.col("shape.step"), F.col("shape.h"))
    height = F.try_divide(
        F.sum(F.col("mass") * F.exp(z * z * -0.5)),
        F.first("shape.n") * F.first("shape.h") * math.sqrt(2 * math.pi),
    )
    x = F.first("shape.low") + F.col("place") * F.first("shape.step")
    return placed.groupBy("place").agg(x.alias("x"), height.alias("density"))


def box_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Extremes, quartiles, mean and population deviation of a grouped series.

    Exact quartiles are for inputs already grouped to one row per period.
    """
    quartile = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        df.groupBy(*by)
        .agg(
            F.min(value).alias("low"),
            F.max(value).alias("high"),
            F.avg(value).alias("mean"),
            F.stddev_pop(value).alias("sd"),
            quartile.alias("quartile"),
        )
        .select(
            *by, "low", "high", "mean", "sd",
            F.col("quartile")[0].alias("q1"),
            F.col("quartile")[1].alias("median"),
            F.col("quartile")[2].alias("q3"),
        )
    )
