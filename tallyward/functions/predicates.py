"""Row predicates over dirty text columns.

Three kinds of missing value occur and are not interchangeable: empty text, the
word ``false`` and NULL. Each report states which of them it drops.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyward.functions.dates import mentions_year

# The sentinel word for a missing value and the label that stands
# for an empty race or age.
MISSING_WORD = "false"
UNKNOWN = "UNKNOWN"


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def filled(*columns: str) -> Column:
    """Every column holds at least one character (so NULL fails too)."""
    return all_of([F.length(F.col(c)) > 0 for c in columns])


def not_missing_word(column: str) -> Column:
    return F.col(column) != MISSING_WORD


def unknown_if_empty(column: Column) -> Column:
    """Empty text becomes UNKNOWN; NULL stays NULL."""
    return F.when(column == "", UNKNOWN).otherwise(column)


def between_exclusive(column: Column, low: int, high: int) -> Column:
    return (column > low) & (column < high)


def wanted_incident(first_year: int, last_year: int) -> Column:
    """Complaints dated in the year range that name a suspect race.

    Empty or NULL date text contains no year, so it needs no test of its own.
    """
    return mentions_year(F.col("CMPLNT_FR_DT"), first_year, last_year) & names_race()


def wanted_by_year(year: str, first_year: int, last_year: int) -> Column:
    """``wanted_incident`` for rows put by their date's ``written_year``: only the
    folders of those years are read, and that of all texts without one."""
    known = F.col(year).between(first_year, last_year)
    return (known | F.col(year).isNull()) & wanted_incident(first_year, last_year)


def names_race() -> Column:
    """Complaints that name a suspect race."""
    return F.col("SUSP_RACE") != ""


def wanted_census(state: str = "new york") -> Column:
    """Populated rows of one state, whatever the case of its name."""
    return (
        F.lower(F.col("STNAME")).contains(state.lower())
        & (F.col("RESPOP") != 0)
        & F.col("IMPRACE").isNotNull()
    )


def flag_true(column: Column) -> Column:
    """1 for the text TRUE, 0 for anything else and for NULL."""
    return F.when(column == "TRUE", 1).otherwise(0)
