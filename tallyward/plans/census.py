"""Census recode and population reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions import recode
from tallyward.functions.predicates import wanted_census
from tallyward.operators.counting import share_of_total, slice_of, sum_by
from tallyward.operators.lookup import limited

POPULATION = "sum(RESPOP)"


def filter_census(raw: DataFrame, state: str = "new york", limit: int = 0) -> DataFrame:
    """Populated rows of one state; a limit other than 0 keeps the first by id."""
    return limited(raw.filter(wanted_census(state)), limit, *raw.columns)


def recode_census(census: DataFrame) -> DataFrame:
    """Labels in place of the raw codes, for the columns the table has."""
    have = set(census.columns)
    hispanic = recode.census_hispanic(F.col("ORIGIN"))
    labels = {
        "SEX": lambda: recode.census_sex(F.col("SEX")),
        "ORIGIN": lambda: hispanic,
        "IMPRACE": lambda: recode.census_race(F.col("IMPRACE"), hispanic),
        "AGEGRP": lambda: recode.census_age(F.col("AGEGRP")),
    }
    return census.withColumns({name: label() for name, label in labels.items() if name in have})


def clean_census(recoded: DataFrame) -> DataFrame:
    """Race labels folded into broad groups."""
    return recoded.withColumn("IMPRACE", recode.race_group(F.col("IMPRACE")))


def race_by_borough(clean: DataFrame) -> DataFrame:
    """Population of the boroughs by race group."""
    city = clean.filter(F.col("CTYNAME").isin(list(recode.BOROUGHS)))
    return sum_by(city, "RESPOP", "CTYNAME", "IMPRACE").withColumn(
        "CTYNAME", recode.borough_of(F.col("CTYNAME"))
    )


def borough_slice(populations: DataFrame, borough: str) -> DataFrame:
    """Race groups of one borough with their share."""
    one = slice_of(populations, "CTYNAME", borough)
    return share_of_total(one, POPULATION).orderBy("IMPRACE")
