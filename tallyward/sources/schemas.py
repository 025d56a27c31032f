"""Table contracts: column names and read schemas.

Raw tables keep text as text; typed columns are added by the cleaning steps in
``tallyward.plans`` with expressions that give NULL on bad input.
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# Column names of the crime complaints table, in file order, with
# the friendly name each has in the renamed record form.
INCIDENT_NAMES = {
    "_id": "id",
    "CMPLNT_FR_DT": "date",
    "CMPLNT_FR_TM": "time",
    "ADDR_PCT_CD": "precinct",
    "KY_CD": "offense_code",
    "OFNS_DESC": "offense_description",
    "CRM_ATPT_CPTD_CD": "crime_outcome",
    "LAW_CAT_CD": "level_offense",
    "BORO_NM": "borough",
    "Latitude": "latitude",
    "Longitude": "longitude",
    "SUSP_AGE_GROUP": "age",
    "SUSP_RACE": "race",
    "SUSP_SEX": "sex",
}

# Severity levels and outcomes of a complaint.
OFFENSE_LEVELS = ["FELONY", "MISDEMEANOR", "VIOLATION"]
CRIME_OUTCOMES = ["ATTEMPTED", "COMPLETED"]


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


_TEXT, _INT, _LONG, _REAL = StringType(), IntegerType(), LongType(), DoubleType()

INCIDENTS = StructType(
    [
        StructField(
            name,
            {
                "ADDR_PCT_CD": _INT,
                "KY_CD": _INT,
                "Latitude": _REAL,
                "Longitude": _REAL,
            }.get(name, _TEXT),
        )
        for name in INCIDENT_NAMES
    ]
)

CENSUS = _struct(
    _id=_TEXT, STNAME=_TEXT, CTYNAME=_TEXT, SEX=_INT, ORIGIN=_INT,
    AGEGRP=_INT, IMPRACE=_INT, RESPOP=_LONG,
)

CENSUS_RECODED = _struct(
    _id=_TEXT, STNAME=_TEXT, CTYNAME=_TEXT, SEX=_TEXT, ORIGIN=BooleanType(),
    AGEGRP=_TEXT, IMPRACE=_TEXT, RESPOP=_LONG,
)

SHOOTINGS = _struct(
    id=_TEXT, date=_TEXT, manner_of_death=_TEXT, armed=_TEXT, age=_TEXT,
    race=_TEXT, gender=_TEXT, city=_TEXT, state=_TEXT,
    signs_of_mental_illness=_TEXT, threat_level=_TEXT, flee=_TEXT,
    body_camera=_TEXT,
)

POLICE_DEATHS = _struct(
    _id=_TEXT, person=_TEXT, dept=_TEXT, cause_short=_TEXT, date=_TEXT,
    year=_INT, canine=_TEXT, state=_TEXT,
)

POLLS = _struct(
    State=_TEXT, State_short=_TEXT, Tornout=_REAL, RepPercentage=_REAL,
    DemPercentage=_REAL, OthersPercentage=_REAL,
)

KEY_VALUE = _struct(key=_TEXT, value=_LONG)
