"""Police death reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.predicates import between_exclusive, filled, flag_true
from tallyward.operators.counting import count_by, top_n
from tallyward.operators.series import linear_trend

# The years kept lie strictly between these; report sizes.
AFTER_YEAR, BEFORE_YEAR = 2008, 2020
TOP_CAUSES, TOP_STATES = 10, 5


def clean_deaths(
    deaths: DataFrame, after_year: int = AFTER_YEAR, before_year: int = BEFORE_YEAR
) -> DataFrame:
    """Canine flag as 0/1, trimmed state, years of the study only.

    Works on any subset of the columns that holds the year.
    """
    have = set(deaths.columns)
    changed = {}
    if "canine" in have:
        changed["canine"] = flag_true(F.col("canine"))
    if "state" in have:
        changed["state"] = F.trim("state")
    return deaths.filter(
        between_exclusive(F.col("year"), after_year, before_year)
    ).withColumns(changed)


def deaths_trend(clean: DataFrame) -> DataFrame:
    return linear_trend(count_by(clean, "year"), "year").orderBy("year")


def deaths_cause_top(clean: DataFrame, n: int = TOP_CAUSES) -> DataFrame:
    return top_n(count_by(clean.filter(filled("cause_short")), "cause_short"), "cause_short", n)


def deaths_state_top(clean: DataFrame, n: int = TOP_STATES) -> DataFrame:
    return top_n(count_by(clean.filter(filled("state")), "state"), "state", n)
