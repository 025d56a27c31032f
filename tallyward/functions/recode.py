"""Code-to-label recodes.

The tables are fixed and tiny, so they live in the expression (a literal map)
and cost neither a join nor a broadcast. An unmapped code gives NULL.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Census race codes.
CENSUS_RACES = {
    1: "White alone",
    2: "Black or African American alone",
    3: "American Indian and Alaska Native alone",
    4: "Asian alone",
    5: "Native Hawaiian and Other Pacific Islander alone",
    6: "White and Black or African American",
    7: "White and American Indian and Alaska Native",
    8: "White and Asian",
    9: "White and Native Hawaiian and Other Pacific Islander",
    10: "Black or African American and American Indian and Alaska Native",
    11: "Black or African American and Asian",
    12: "Black or African American and Native Hawaiian and Other Pacific Islander",
    13: "American Indian and Alaska Native and Asian",
    14: "American Indian and Alaska Native and Native Hawaiian and Other Pacific Islander",
    15: "Asian and Native Hawaiian and Other Pacific Islander",
    16: "White and Black or African American and American Indian and Alaska Native",
    17: "White and Black or African American and Asian",
    18: "White and Black or African American and Native Hawaiian and Other Pacific Islander",
    19: "White and American Indian and Alaska Native and Asian",
    20: "White and American Indian and Alaska Native and Native Hawaiian and Other Pacific Islander",
    21: "White and Asian and Native Hawaiian and Other Pacific Islander",
    22: "Black or African American and American Indian and Alaska Native and Asian",
    23: "Black or African American and American Indian and Alaska Native and Native Hawaiian and Other Pacific Islander",
    24: "Black or African American and Asian and Native Hawaiian and Other Pacific Islander",
    25: "American Indian and Alaska Native and Asian and Native Hawaiian and Other Pacific Islander",
    26: "White and Black or African American and American Indian and Alaska Native and Asian",
    27: "White and Black or African American and American Indian and Alaska Native and Native Hawaiian and Other Pacific Islander",
    28: "White and Black or African American and Asian and Native Hawaiian and Other Pacific Islander",
    29: "White and American Indian and Alaska Native and Asian and Native Hawaiian and Other Pacific Islander",
    30: "Black or African American and American Indian and Alaska Native and Asian and Native Hawaiian and Other Pacific Islander",
    31: "White and Black or African American and American Indian and Alaska Native and Asian and Native Hawaiian and Other Pacific Islander",
}

# Census age-band codes.
CENSUS_AGES = {
    1: "0-4",
    2: "5-9",
    3: "10-14",
    4: "15-19",
    5: "20-24",
    6: "25-29",
    7: "30-34",
    8: "35-39",
    9: "40-44",
    10: "45-49",
    11: "50-54",
    12: "55-59",
    13: "60-64",
    14: "65-69",
    15: "70-74",
    16: "75-79",
    17: "80-84",
    18: ">85",
}

# Census sex and Hispanic-origin codes; the suffix that marks
# Hispanic origin in a race label.
CENSUS_MALE, CENSUS_HISPANIC = 1, 2
HISPANIC_SUFFIX = "Hispanic"

# Race groups by the first word of a census label. The last two
# split further on Hispanic origin.
RACE_GROUPS = {
    "American": "AMERICAN INDIAN/ALASKAN NATIVE",
    "Asian": "ASIAN / PACIFIC ISLANDER",
    "Native": "ASIAN / PACIFIC ISLANDER",
    "Black": "BLACK",
    "White": "WHITE",
}
SPLIT_BY_ORIGIN = ["BLACK", "WHITE"]

# New York counties and the boroughs they form.
BOROUGHS = {
    "New York County": "MANHATTAN",
    "Kings County": "BROOKLYN",
    "Queens County": "QUEENS",
    "Bronx County": "BRONX",
    "Richmond County": "STATEN ISLAND",
}

# Race codes of the shootings table.
SHOOTING_RACES = {
    "W": "White",
    "B": "Black",
    "N": "Native American",
    "H": "Hispanic",
    "A": "Asian",
    "O": "Others",
}


def sql_literal(value: str | int) -> str:
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(table: dict, key: Column) -> Column:
    entries = ", ".join(sql_literal(x) for x in chain(*table.items()))
    return F.try_element_at(F.expr(f"map({entries})"), key)


def census_sex(code: Column) -> Column:
    return F.when(code == CENSUS_MALE, "M").otherwise("F")


def census_hispanic(code: Column) -> Column:
    return F.coalesce(code == CENSUS_HISPANIC, F.lit(False))


def census_race(code: Column, hispanic: Column) -> Column:
    """Race label, with the origin suffix where the person is Hispanic."""
    label = lookup(CENSUS_RACES, code)
    return F.when(hispanic, F.concat(label, F.lit(f" {HISPANIC_SUFFIX}"))).otherwise(label)


def census_age(code: Column) -> Column:
    return lookup(CENSUS_AGES, code)


def race_group(label: Column) -> Column:
    """One of the broad race groups; a multi-race label counts by its first word."""
    words = F.split(F.trim(label), r"\s+")
    group = lookup(RACE_GROUPS, F.element_at(words, 1))
    is_hispanic = F.element_at(words, -1) == HISPANIC_SUFFIX
    return F.when(
        group.isin(SPLIT_BY_ORIGIN) & is_hispanic, F.concat(group, F.lit(" HISPANIC"))
    ).otherwise(group)


def borough_of(county: Column) -> Column:
    return lookup(BOROUGHS, county)


def shooting_race(code: Column) -> Column:
    return lookup(SHOOTING_RACES, code)


def armed_label(armed: Column) -> Column:
    """Everything but the word unarmed counts as armed, empty text included."""
    return F.when(armed == "unarmed", "unarmed").otherwise("armed")


def place_label(place: Column) -> Column:
    """INSIDE in any case stays INSIDE, all else is OUTSIDE."""
    return F.when(F.upper(place) == "INSIDE", "INSIDE").otherwise("OUTSIDE")


def winner_flag(republican: Column, democratic: Column) -> Column:
    """1 where the republican share is higher; a tie is 0."""
    return F.when(republican > democratic, 1).otherwise(0)


def white_label(race: Column) -> Column:
    """Class label: 1 for race code W."""
    return F.when(race == "W", 1).otherwise(0)
