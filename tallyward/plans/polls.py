"""State polls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.recode import winner_flag


def clean_polls(polls: DataFrame) -> DataFrame:
    """Add the winner: 1 republican, 0 democratic or tied."""
    return polls.withColumn(
        "Winner", winner_flag(F.col("RepPercentage"), F.col("DemPercentage"))
    )


def winners(clean: DataFrame) -> DataFrame:
    return clean.select("State_short", "Winner")
