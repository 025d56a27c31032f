"""Fatal shooting reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions import dates, recode
from tallyward.functions.numbers import whole_number
from tallyward.functions.predicates import filled
from tallyward.operators.counting import (
    COUNT,
    count_by,
    distinct_values,
    ranked,
    share_of_total,
    slice_of,
)
from tallyward.operators.distribution import box_summary, density_curve, histogram
from tallyward.operators.text import word_counts

REPORT_COLUMNS = ["id", "date", "race", "age", "state", "armed", "flee"]

# Bin widths of the two age histograms; the race code of one and
# the race left out of the overall pie.
AGE_BIN, COHORT_AGE_BIN = 5, 10
COHORT, OTHER_RACES = "B", "Others"


def clean_shootings(shootings: DataFrame) -> DataFrame:
    """Report columns with a real date, year, month and race name.

    Works on any subset of the columns, so that a report reads only its own.
    """
    have = set(shootings.columns)
    kept = shootings.select(*[c for c in REPORT_COLUMNS if c in have])
    added = {}
    if "date" in have:
        date = dates.parse_date(F.col("date"), dates.ISO_DATE)
        added |= {
            "date": date,
            "year": dates.year_of(date),
            "month": dates.month_of(date),
            "month_num": dates.month_of(date),
        }
    if "race" in have:
        added["race_name"] = recode.shooting_race(F.col("race"))
    return kept.withColumns(added)


def monthly(clean: DataFrame) -> DataFrame:
    months = clean.select(dates.month_key(F.col("date")).alias("date"))
    return count_by(months, "date").orderBy("date")


def monthly_by_year(months: DataFrame) -> DataFrame:
    """The month series with a column to slice it by year."""
    return months.withColumn("year", dates.year_text(F.col("date")))


def month_slice(months_by_year: DataFrame, year: str) -> DataFrame:
    return slice_of(months_by_year, "year", year, "date")


def yearly(clean: DataFrame) -> DataFrame:
    return count_by(clean, "year").orderBy("year")


def race_months(clean: DataFrame) -> DataFrame:
    counts = count_by(clean, "year", "month_num", "race_name")
    return counts.withColumn(
        "monthly", dates.month_label(F.col("year"), F.col("month_num"))
    )


def race_month_slice(months: DataFrame, race_name: str) -> DataFrame:
    return slice_of(months, "race_name", race_name, "year", "month_num")


def per_state(clean: DataFrame) -> DataFrame:
    """States from fewest to most."""
    return ranked(count_by(clean, "state"), "state", descending=False)


def flee_modes(clean: DataFrame) -> DataFrame:
    return share_of_total(count_by(clean, "flee"))


def armed_counts(clean: DataFrame) -> DataFrame:
    known = clean.na.drop(subset=["armed", "race_name"])
    labelled = known.withColumn("armed", recode.armed_label(F.col("armed")))
    return count_by(labelled, "race_name", "armed")


def armed_slice(counts: DataFrame, label: str) -> DataFrame:
    """Races of the armed or the unarmed victims with their share."""
    return share_of_total(counts.filter(F.col("armed") == label))


def cohort(clean: DataFrame, race: str = COHORT) -> DataFrame:
    return clean.filter(F.col("race") == race)


def race_ages(clean: DataFrame) -> DataFrame:
    return clean.select("race", "age")


def race_counts(clean: DataFrame) -> DataFrame:
    """Victims by race without the rest group, with shares."""
    return share_of_total(
        count_by(clean.filter(F.col("race_name") != OTHER_RACES), "race_name")
    )


def _ages(clean: DataFrame) -> DataFrame:
    return clean.filter(filled("age")).select(whole_number(F.col("age")).alias("age"))


def age_histogram(clean: DataFrame, from_smallest: bool = False) -> DataFrame:
    return histogram(_ages(clean), "age", AGE_BIN, from_smallest).orderBy("bin")


def age_density(clean: DataFrame) -> DataFrame:
    return density_curve(_ages(clean), "age").orderBy("place")


def cohort_age_histogram(clean: DataFrame, race: str = COHORT) -> DataFrame:
    bins = histogram(_ages(cohort(clean, race)), "age", COHORT_AGE_BIN)
    return bins.select("bin", COUNT).orderBy("bin")


def monthly_box(months: DataFrame) -> DataFrame:
    return box_summary(months, COUNT)


def race_box(months: DataFrame) -> DataFrame:
    return box_summary(months.filter(F.col("race_name").isNotNull()), COUNT, ["race_name"])


def weapon_labels(clean: DataFrame) -> DataFrame:
    return distinct_values(clean, "armed")


def weapon_words(clean: DataFrame) -> DataFrame:
    return word_counts(clean, "armed")


def state_measure(report: DataFrame, value: str, state: str = "state") -> DataFrame:
    """A report as (state, number) for a map."""
    return report.select(state, F.col(value).cast("double").alias("z"))
