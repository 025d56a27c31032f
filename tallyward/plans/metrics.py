"""Metrics over finished reports. Each is one plan down to the raw tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.numbers import round_half_even
from tallyward.operators.counting import COUNT, share_within
from tallyward.operators.crosstab import pivot_mean
from tallyward.operators.series import growth, side_by_side
from tallyward.plans.census import POPULATION

# The cohorts compared and the level that counts as severe.
FIRST_COHORT, SECOND_COHORT = "Black", "White"
SEVERE = "FELONY"


def crime_growth(trend: DataFrame) -> DataFrame:
    """Year-over-year growth of complaints."""
    return growth(trend.select("yearpd", COUNT), "yearpd")


def armed_ratio(
    armed: DataFrame,
    unarmed: DataFrame,
    first: str = FIRST_COHORT,
    second: str = SECOND_COHORT,
) -> DataFrame:
    """Armed share of one cohort over that of another, and the unarmed twin.

    One conditional aggregate over both reports. A cohort that has no row in a
    report gives NULL.
    """
    both = armed.select("race_name", "armed", COUNT).unionByName(
        unarmed.select("race_name", "armed", COUNT)
    )

    def victims(race, label=None):
        mine = F.col("race_name") == race
        if label:
            mine = mine & (F.col("armed") == label)
        return F.sum(F.when(mine, F.col(COUNT)))

    def ratio(label):
        share = {
            race: F.try_divide(victims(race, label), victims(race)) for race in (first, second)
        }
        return F.try_divide(share[first], share[second])

    return both.agg(
        ratio("armed").alias("armed_ratio"), ratio("unarmed").alias("unarmed_ratio")
    )


def felony_share(severity: DataFrame, level: str = SEVERE) -> DataFrame:
    """Share of severe complaints per year; 0 in a year that has none."""
    severe = F.sum(F.when(F.col("LAW_CAT_CD") == level, F.col(COUNT)).otherwise(0))
    return (
        severity.groupBy("yearpd")
        .agg(
            severe.alias("severe"),
            F.sum(COUNT).alias("total"),
            F.try_divide(severe, F.sum(COUNT)).alias("ratio"),
        )
        .orderBy("yearpd")
    )


def felony_share_variance(shares: DataFrame) -> DataFrame:
    return shares.agg(F.var_samp("ratio").alias("variance"))


def incidence(districts_race: DataFrame, populations: DataFrame) -> DataFrame:
    """Crime share times population share of each race within its district.

    Both shares are rounded before they are multiplied. A race without a
    population row keeps its crime share and has NULL incidence.
    """
    crimes = share_within(districts_race, "BORO_NM", name="ratio_x").withColumn(
        "ratio_x", round_half_even(F.col("ratio_x"))
    )
    people = share_within(populations, "CTYNAME", value=POPULATION, name="ratio_y").select(
        F.col("CTYNAME").alias("BORO_NM"),
        F.col("IMPRACE").alias("SUSP_RACE"),
        round_half_even(F.col("ratio_y")).alias("ratio_y"),
    )
    return (
        crimes.join(people, ["BORO_NM", "SUSP_RACE"], "left")
        .select("BORO_NM", "SUSP_RACE", "ratio_x", "ratio_y")
        .withColumn("incidence", F.col("ratio_x") * F.col("ratio_y"))
    )


def incidence_wide(long: DataFrame, races: Sequence[str]) -> DataFrame:
    """One row per district, one column per race."""
    return pivot_mean(long, "BORO_NM", "SUSP_RACE", races, "incidence")


def growth_compared(deaths: DataFrame, shootings: DataFrame) -> DataFrame:
    """Growth of police deaths beside that of shootings, by year."""
    return side_by_side(
        growth(deaths.select("year", COUNT), "year", name="deaths_ratio"),
        growth(shootings.select("year", COUNT), "year", name="shootings_ratio"),
        "year",
    ).orderBy("year")


def crime_rate(populations: DataFrame, crimes: DataFrame) -> DataFrame:
    """Crimes per hundred people of each race that both results know."""
    return populations.withColumnRenamed("value", "population").join(
        crimes.withColumnRenamed("value", "crimes"), "key"
    ).withColumn("rate", F.try_divide(F.col("crimes"), F.col("population")) * 100)
