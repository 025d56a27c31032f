"""Date and time expressions. Bad or missing text gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date patterns of the crime and shooting tables; day hours.
INCIDENT_DATE = "MM/dd/yyyy"
ISO_DATE = "yyyy-MM-dd"
FIRST_DAY_HOUR, LAST_DAY_HOUR = 6, 18


def parse_date(text: Column, pattern: str) -> Column:
    return F.try_to_date(text, pattern)


def year_of(date: Column) -> Column:
    return F.year(date)


def month_of(date: Column) -> Column:
    return F.month(date)


def month_key(date: Column) -> Column:
    """``2015-01``"""
    return F.date_format(date, "yyyy-MM")


def month_label(year: Column, month: Column) -> Column:
    """``2015-1``, unpadded."""
    return F.concat_ws("-", year.cast("string"), month.cast("string"))


def year_text(month: Column) -> Column:
    """The year of a ``yyyy-MM`` key, as text."""
    return F.substring(month, 1, 4)


def night_flag(time: Column) -> Column:
    """0 from 06:00 to 18:59, 1 otherwise, NULL if the hour cannot be read."""
    hour = F.substring(time, 1, 2).try_cast("int")
    middle = (FIRST_DAY_HOUR + LAST_DAY_HOUR) // 2
    # One use of the hour: how far it lies from the middle of the day.
    return (F.abs(hour - middle) > LAST_DAY_HOUR - middle).cast("int")


def year_between(date: Column, first: int, last: int) -> Column:
    """Years ``first``..``last`` as a range on the column itself.

    Parquet and partition pruning see a range on the column, which they would
    not see through ``year(date)``. For date and timestamp columns.
    """
    return (date >= F.make_date(F.lit(first), F.lit(1), F.lit(1))) & (
        date < F.make_date(F.lit(last + 1), F.lit(1), F.lit(1))
    )


def written_year(text: Column) -> Column:
    """The year of a well-formed ``MM/dd/yyyy`` text, which mentions no other; NULL
    for any other text."""
    return F.when(text.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.substring(text, 7, 4).cast("int"))


def mentions_year(text: Column, first: int, last: int) -> Column:
    """True where date text contains any year of the range, wherever it stands."""
    return text.rlike("|".join(str(year) for year in range(first, last + 1)))
