"""Cleaning expressions on dirty values."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyward.functions import dates, numbers, predicates, recode


@pytest.fixture(scope="module")
def apply(spark):
    def run(expression, values, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        picked = df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()
        return [r.x for r in picked]

    return run


def test_incident_date_and_year(apply):
    values = ["12/31/2019", "13/45/2019", "", None, "2019-12-31"]
    parsed = apply(lambda c: dates.parse_date(c, dates.INCIDENT_DATE), values)
    assert parsed == [datetime.date(2019, 12, 31), None, None, None, None]
    years = apply(lambda c: dates.year_of(dates.parse_date(c, dates.INCIDENT_DATE)), values)
    assert years == [2019, None, None, None, None]


def test_iso_date_month_and_keys(apply):
    date = lambda c: dates.parse_date(c, dates.ISO_DATE)
    values = ["2015-01-09", "2015-13-01", "x", None]
    assert apply(lambda c: dates.month_of(date(c)), values) == [1, None, None, None]
    assert apply(lambda c: dates.month_key(date(c)), values) == ["2015-01", None, None, None]
    label = lambda c: dates.month_label(dates.year_of(date(c)), dates.month_of(date(c)))
    assert apply(label, values[:1]) == ["2015-1"]
    assert apply(dates.year_text, ["2015-01"]) == ["2015"]


def test_night_flag(apply):
    values = ["06:00:00", "05:59:59", "18:59:59", "19:00:00", "00:00:00", "xx:00", None, ""]
    assert apply(dates.night_flag, values) == [0, 1, 0, 1, 1, None, None, None]


def test_years_in_text(apply):
    values = ["01/01/2009", "12/31/2019", "12/31/2008", "", None]
    found = apply(lambda c: dates.mentions_year(c, 2009, 2019), values)
    assert found == [True, True, False, False, None]


def test_year_range_on_dates(spark):
    df = spark.sql("SELECT explode(sequence(date'2008-12-31', date'2020-01-01')) AS d")
    kept = df.filter(dates.year_between(F.col("d"), 2009, 2019))
    low, high = kept.agg(F.min("d"), F.max("d")).first()
    assert (low, high) == (datetime.date(2009, 1, 1), datetime.date(2019, 12, 31))


def test_missing_values_are_three_kinds(apply):
    values = ["", "false", None, "BRONX"]
    assert apply(predicates.unknown_if_empty, values) == ["UNKNOWN", "false", None, "BRONX"]
    assert apply(lambda c: predicates.filled("v"), values) == [False, True, None, True]
    assert apply(lambda c: predicates.not_missing_word("v"), values) == [True, False, None, True]


def test_flags(apply):
    assert apply(predicates.flag_true, ["TRUE", "true", None, "FALSE"]) == [1, 0, 0, 0]
    assert apply(recode.white_label, ["W", "B", None]) == [1, 0, 0]
    assert apply(recode.armed_label, ["unarmed", "", "gun"]) == ["unarmed", "armed", "armed"]
    assert apply(recode.place_label, ["inside", "INSIDE", "front of"]) == [
        "INSIDE", "INSIDE", "OUTSIDE",
    ]


def test_open_year_range(apply):
    kept = apply(lambda c: predicates.between_exclusive(c, 2008, 2020), [2008, 2009, 2019, 2020], "int")
    assert kept == [False, True, True, False]


def test_race_groups(apply):
    labels = [
        "White and Asian",
        "White alone Hispanic",
        "Black or African American alone Hispanic",
        "Black or African American alone",
        "Native Hawaiian and Other Pacific Islander alone",
        "Asian alone Hispanic",
        "American Indian and Alaska Native alone",
        "  White   alone ",
        "Martian",
        "",
        None,
    ]
    assert apply(recode.race_group, labels) == [
        "WHITE", "WHITE HISPANIC", "BLACK HISPANIC", "BLACK", "ASIAN / PACIFIC ISLANDER",
        "ASIAN / PACIFIC ISLANDER", "AMERICAN INDIAN/ALASKAN NATIVE", "WHITE", None, None, None,
    ]


def test_census_codes(spark):
    df = spark.createDataFrame(
        [(1, 1, 1), (31, 2, 18), (32, 2, 0), (5, None, 9)], "race int, origin int, age int"
    )
    hispanic = recode.census_hispanic(F.col("origin"))
    out = df.select(
        recode.census_race(F.col("race"), hispanic).alias("race"),
        hispanic.alias("hispanic"),
        recode.census_age(F.col("age")).alias("age"),
    ).collect()
    assert tuple(out[0]) == ("White alone", False, "0-4")
    assert out[1].race.startswith("White and Black") and out[1].race.endswith("Islander Hispanic")
    assert out[1].age == ">85"
    assert tuple(out[2]) == (None, True, None)
    assert tuple(out[3]) == ("Native Hawaiian and Other Pacific Islander alone", False, "40-44")


def test_every_census_label_has_a_group(spark):
    df = spark.range(1, 32).select(
        recode.race_group(recode.census_race(F.col("id"), F.lit(True))).alias("g")
    )
    assert df.filter(F.col("g").isNull()).count() == 0


def test_counties_and_shooting_races(apply):
    assert apply(recode.borough_of, ["Kings County", "Albany County", None]) == [
        "BROOKLYN", None, None,
    ]
    assert apply(recode.shooting_race, ["W", "O", "X", None]) == ["White", "Others", None, None]


def test_winner(spark):
    df = spark.createDataFrame([(50.0, 40.0), (40.0, 50.0), (45.0, 45.0)], "r double, d double")
    assert [r[0] for r in df.select(recode.winner_flag(F.col("r"), F.col("d"))).collect()] == [
        1, 0, 0,
    ]


def test_rounding_half_even(apply):
    values = [0.575, 0.125, 0.135, 0.5, 1 / 3]
    assert apply(numbers.round_half_even, values, "double") == [0.57, 0.12, 0.14, 0.5, 0.33]


def test_whole_numbers(apply):
    assert apply(numbers.whole_number, ["37", "", "x", "3.5", None]) == [37, None, None, None, None]


def test_sql_literals_survive_quotes(spark):
    for word in ["can't", "a\\b", "it''s"]:
        assert spark.range(1).select(F.expr(recode.sql_literal(word))).first()[0] == word
