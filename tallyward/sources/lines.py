"""Positional fields of comma-separated text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Positions and header names in the two line formats.
CENSUS_RACE_INDEX, CENSUS_RACE_HEADER = 6, "IMPRACE"
CENSUS_POPULATION_INDEX, CENSUS_POPULATION_HEADER = 7, "RESPOP"
CRIME_FIELDS = 14
CRIME_RACE_INDEX, CRIME_RACE_HEADER = 10, "SUSP_RACE"


def field(line: Column, index: int) -> Column:
    """The field at a position counted from 0; the last one if the line is short."""
    return F.substring_index(F.substring_index(line, ",", index + 1), ",", -1)


def field_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(","))) + 1


def census_fields(lines: DataFrame) -> DataFrame:
    """``race, population`` text of census lines.

    Both are NULL on the header line and on a line too short to hold them. Such
    rows stay, since a filter here would work every expression out twice; they
    fall away in the grouping by race.
    """
    line = F.col("value")
    race, population = field(line, CENSUS_RACE_INDEX), field(line, CENSUS_POPULATION_INDEX)
    data = (
        (field_count(line) > CENSUS_POPULATION_INDEX)
        & (race != CENSUS_RACE_HEADER)
        & (population != CENSUS_POPULATION_HEADER)
    )
    return lines.select(
        F.when(data, race).alias("race"), F.when(data, population).alias("population")
    )


def crime_race(lines: DataFrame) -> DataFrame:
    """``key``: the suspect race of each crime line.

    A text field may hold commas of its own, which push the race to the right
    by as many places as the line has fields too many: it keeps its place
    counted from the end. The key is NULL on the header line and on a line that
    ends before the race position; see ``census_fields``.
    """
    line = F.col("value")
    from_end = CRIME_FIELDS - CRIME_RACE_INDEX
    race = F.substring_index(F.substring_index(line, ",", -from_end), ",", 1)
    data = (field_count(line) > CRIME_RACE_INDEX) & (
        field(line, CRIME_RACE_INDEX) != CRIME_RACE_HEADER
    )
    return lines.select(F.when(data, race).alias("key"))


def census_fault(line: Column) -> Column:
    """Why a census line is no data: ``header``, ``short`` or ``unreadable`` (its
    number); NULL for data."""
    race, population = field(line, CENSUS_RACE_INDEX), field(line, CENSUS_POPULATION_INDEX)
    header = (race == CENSUS_RACE_HEADER) | (population == CENSUS_POPULATION_HEADER)
    return (
        F.when(field_count(line) <= CENSUS_POPULATION_INDEX, "short")
        .when(header, "header")
        .when(population.try_cast("bigint").isNull(), "unreadable")
    )


def crime_fault(line: Column) -> Column:
    """Why a crime line is no data: ``header`` or ``short``; NULL for data."""
    return F.when(field_count(line) <= CRIME_RACE_INDEX, "short").when(
        field(line, CRIME_RACE_INDEX) == CRIME_RACE_HEADER, "header"
    )


def join_fields(*columns: str) -> Column:
    """One comma-separated line; NULL becomes an empty field and keeps its place."""
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
