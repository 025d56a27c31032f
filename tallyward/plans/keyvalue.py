"""Key/value aggregations over comma-separated text lines.

Results have the columns ``key`` and ``value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.recode import race_group
from tallyward.operators.counting import settled
from tallyward.sources.lines import census_fault, census_fields, crime_fault, crime_race

# Fixed value: the key of census lines outside every race group.
NO_GROUP = "None"


def population_by_race(lines: DataFrame) -> DataFrame:
    """Population by race group; a group with an unreadable number is left out."""
    race = F.col("race")
    people = census_fields(lines).select(
        F.when(race.isNotNull(), F.coalesce(race_group(race), F.lit(NO_GROUP))).alias("key"),
        F.col("population").try_cast("bigint").alias("people"),
    )
    sums = people.groupBy("key").agg(
        F.sum("people").alias("value"),
        F.count("key").alias("lines"),
        F.count("people").alias("readable"),
    )
    return (
        settled(sums)
        # Lines that are no data have the NULL key, whose count is 0.
        .filter((F.col("lines") > 0) & (F.col("readable") == F.col("lines")))
        .select("key", "value")
    )


def crimes_by_race(lines: DataFrame) -> DataFrame:
    counts = crime_race(lines).groupBy("key").agg(F.count("key").alias("value"))
    return settled(counts).filter(F.col("value") > 0)


def rejected_census_lines(lines: DataFrame) -> DataFrame:
    """``reason, value`` of the census lines that are no data.

    Lines with an unreadable number are rejected here; the report goes further and
    leaves their whole group out.
    """
    return _rejected(lines, census_fault(F.col("value")))


def rejected_crime_lines(lines: DataFrame) -> DataFrame:
    """``reason, value`` of the crime lines that are no data."""
    return _rejected(lines, crime_fault(F.col("value")))


def _rejected(lines: DataFrame, fault: Column) -> DataFrame:
    marked = lines.select(fault.alias("reason"), "value")
    return marked.filter(F.col("reason").isNotNull())


def rejected_counts(rejected: DataFrame) -> DataFrame:
    """Lines by reason; a reason without lines is not listed."""
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))
