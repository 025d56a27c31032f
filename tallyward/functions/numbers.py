"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Round the double as stored: scale, nearest even, scale back."""
    scale = 10.0**digits
    return F.rint(value * scale) / scale


def whole_number(text: Column) -> Column:
    """Text as int, NULL where it is not a whole number."""
    return text.try_cast("int")
