"""Reports on dirty fixture rows; the batch form must agree with the row form."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tallyward.operators.counting import COUNT, count_by
from tallyward.plans import census, deaths, incidents, metrics, polls, shootings
from tallyward.sources import schemas


@pytest.fixture(scope="module")
def raw(spark):
    """Every combination of a few clean and dirty values, unevenly often."""
    dates_ = ["01/02/2009", "12/31/2019", "13/45/2019", None]
    times = ["06:00:00", "19:00:00", "xx:00", ""]
    levels = ["FELONY", "VIOLATION", ""]
    boroughs = ["BRONX", "QUEENS", "false", "", None]
    offences = ["", "false", "THEFT", "FRAUD", None]
    ages = ["<18", "65+", "1020", "false", ""]
    races = ["BLACK", "WHITE", "", None]
    n = itertools.count()
    data = []
    for d, t, lv, b, o, a, r in itertools.product(
        dates_, times, levels, boroughs, offences, ages, races
    ):
        i = next(n)
        if i % 7 in (0, 3) or (o == "" and i % 2):
            data.append((str(i), d, t, 1, 101, o, "COMPLETED", lv, b, 40.5, -74.0, a, r, "MALE"))
    return spark.createDataFrame(data, schemas.INCIDENTS).cache()


@pytest.fixture(scope="module")
def clean(raw):
    return incidents.clean_incidents(raw)


def districts_wide(table, weight=None):
    return incidents.cross_districts_wide(table, ["THEFT"], weight)


def district_races_wide(table, weight=None):
    return incidents.cross_district_races_wide(table, ["BLACK"], weight)


REPORTS = [
    incidents.crimes_trend,
    incidents.crimes_top,
    incidents.crimes_severity,
    incidents.crimes_severity_by_district,
    incidents.crimes_day_night,
    incidents.crimes_race,
    incidents.crimes_districts_race,
    incidents.crimes_ages,
    incidents.cross_districts,
    incidents.cross_districts_share,
    districts_wide,
    incidents.cross_district_races,
    incidents.cross_district_races_share,
    district_races_wide,
    incidents.cross_age_race,
    incidents.cross_crime_race,
    incidents.cross_crime_race_share,
    incidents.cross_crime_race_wide,
]


@pytest.fixture(scope="module")
def cells(clean):
    return incidents.incident_cells(clean).cache()


def plain(df):
    return sorted(
        (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr
    )


@pytest.mark.parametrize("report", REPORTS, ids=lambda f: f.__name__)
def test_report_from_cells_and_any_partitioning(report, clean, cells):
    from_rows = plain(report(clean))
    assert from_rows
    assert plain(report(cells, weight=COUNT)) == from_rows
    assert plain(report(clean.repartition(7))) == from_rows


def test_cells_by_day_agree_with_rows(raw, clean):
    for report, keys in [
        (incidents.crimes_trend, []),
        (incidents.crimes_severity, ["LAW_CAT_CD"]),
        (incidents.crimes_day_night, ["day_night", "LAW_CAT_CD"]),
        (incidents.crimes_severity_by_district, ["BORO_NM", "LAW_CAT_CD"]),
    ]:
        days = incidents.clean_cells(raw, *keys)
        assert plain(report(days, weight=COUNT)) == plain(report(clean))


def test_counts_add_up(raw, clean):
    assert sum(r["count"] for r in incidents.crimes_trend(clean).collect()) == raw.count()
    dn = incidents.crimes_day_night(clean)
    both = incidents.day_totals(dn).union(incidents.night_totals(dn))
    total = dn.agg(F.sum("count")).first()[0]
    assert both.agg(F.sum("count")).first()[0] == total
    assert total == raw.filter(F.col("CMPLNT_FR_TM").isin("06:00:00", "19:00:00")).count()


def test_bad_dates_form_a_null_year_without_trend(clean):
    rows = incidents.crimes_trend(clean).collect()
    assert [r.yearpd for r in rows] == [None, 2009, 2019]
    assert rows[0].trend is None and rows[1].trend is not None
    growth = metrics.crime_growth(incidents.crimes_trend(clean)).collect()
    assert [r.yearpd for r in growth] == [2019]


def test_which_missing_values_each_report_keeps(clean):
    def values(df, column):
        return {r[column] for r in df.collect()}

    assert values(incidents.crimes_severity(clean), "LAW_CAT_CD") == {"FELONY", "VIOLATION"}
    by_district = incidents.crimes_severity_by_district(clean)
    assert values(by_district, "BORO_NM") == {"BRONX", "QUEENS"}
    assert "" in values(by_district, "LAW_CAT_CD")
    assert "" in values(incidents.crimes_day_night(clean), "LAW_CAT_CD")
    assert values(incidents.crimes_race(clean), "SUSP_RACE") == {"BLACK", "WHITE", "UNKNOWN", None}
    assert values(incidents.cross_districts(clean), "BORO_NM") == {"BRONX", "QUEENS", "false"}
    assert values(incidents.crimes_districts_race(clean), "SUSP_RACE") == {"BLACK", "WHITE"}
    assert "1020" in values(incidents.crimes_ages(clean), "SUSP_AGE_GROUP")
    ages = incidents.cross_age_race(clean, ["<18", "65+"])
    assert ages.columns == ["SUSP_RACE", "65+", "<18"] or ages.columns == ["SUSP_RACE", "<18", "65+"]
    assert values(ages, "SUSP_RACE") == {"BLACK", "WHITE", "UNKNOWN"}


def test_missing_offences_take_ranks(clean):
    """Empty text is the most frequent offence, so of the top two only one is left."""
    assert {r.OFNS_DESC for r in incidents.cross_crime_race(clean, 2).collect()} <= {
        "THEFT", "FRAUD",
    }
    ranking = count_by(clean, "OFNS_DESC").orderBy(F.desc("count"), F.asc_nulls_first("OFNS_DESC"))
    top = [r.OFNS_DESC for r in ranking.limit(2).collect()]
    assert top[0] == ""
    kept = {o for o in top if o not in ("", "false", None)}
    assert {r.OFNS_DESC for r in incidents.cross_crime_race(clean, 2).collect()} == kept


def test_filter_incidents(raw):
    kept = incidents.filter_incidents(raw)
    assert kept.columns == list(schemas.INCIDENT_NAMES)
    # The text 13/45/2019 names a year of the range, though it is no date.
    assert {r.CMPLNT_FR_DT for r in kept.select("CMPLNT_FR_DT").distinct().collect()} == {
        "01/02/2009", "12/31/2019", "13/45/2019",
    }
    assert {r[0] for r in kept.select("SUSP_RACE").distinct().collect()} == {"BLACK", "WHITE"}
    first = incidents.filter_incidents(raw, limit=1).collect()
    assert first == kept.orderBy(*kept.columns).take(1)
    assert incidents.filter_incidents(raw, limit=0).count() == kept.count()


def test_wide_tables_lose_nothing(clean):
    long = {
        r.BORO_NM: r.n
        for r in incidents.cross_districts(clean).groupBy("BORO_NM").agg(F.sum("count").alias("n")).collect()
    }
    for row in districts_wide(clean).collect():
        assert sum(row[1:]) == long[row.BORO_NM]


@pytest.fixture(scope="module")
def victims(spark):
    data = [
        ("1", "2015-01-03", "gun", "37", "B", "NY", "Car"),
        ("2", "2015-01-09", "unarmed", "", "B", "NY", ""),
        ("3", "2015-02-01", "", "20", "W", "CA", None),
        ("4", "2016-02-01", None, "x", "W", "CA", "Foot"),
        ("5", "2016-02-01", "toy weapon", "41", "X", "CA", "Foot"),
        ("6", "2016-03-01", "unarmed", "50", "W", None, "Foot"),
        ("7", "bad", "gun", "50", None, "TX", "Foot"),
        ("8", "2016-03-01", "gun", "50", "O", "TX", "Foot"),
    ]
    df = spark.createDataFrame(
        data, "id string, date string, armed string, age string, race string, state string, flee string"
    )
    return shootings.clean_shootings(df)


def test_shooting_series(victims):
    months = shootings.monthly(victims)
    assert plain(months) == plain(months.sparkSession.sql(
        "SELECT * FROM VALUES ('2015-01', 2L), ('2015-02', 1L), ('2016-02', 2L), ('2016-03', 2L), (NULL, 1L)"
    ))
    by_year = shootings.monthly_by_year(months)
    assert plain(shootings.month_slice(by_year, "2015")) == [("2015-01", 2), ("2015-02", 1)]
    assert plain(shootings.yearly(victims)) == [(2015, 3), (2016, 4), (None, 1)]


def test_shooting_races(victims):
    months = shootings.race_months(victims)
    assert (2015, 1, "Black", 2, "2015-1") in plain(months)
    assert None in {r.race_name for r in months.collect()}
    assert [r[1] for r in plain(shootings.race_month_slice(months, "White"))] == [2, 2, 3]
    boxes = {r.race_name: r for r in shootings.race_box(months).collect()}
    assert set(boxes) == {"Black", "White", "Others"}
    assert boxes["White"]["mean"] == 1.0
    assert {r.race_name for r in shootings.race_counts(victims).collect()} == {"Black", "White"}


def test_armed(victims):
    counts = shootings.armed_counts(victims)
    assert plain(counts) == [
        ("Black", "armed", 1), ("Black", "unarmed", 1), ("Others", "armed", 1),
        ("White", "armed", 1), ("White", "unarmed", 1),
    ]
    armed = shootings.armed_slice(counts, "armed")
    assert {r.race_name: r.share for r in armed.collect()} == {
        "Black": 1 / 3, "White": 1 / 3, "Others": 1 / 3,
    }
    unarmed = shootings.armed_slice(counts, "unarmed")
    assert plain(metrics.armed_ratio(armed, unarmed)) == [(1.0, 1.0)]
    none = counts.filter("armed = 'unarmed' AND race_name <> 'White'")
    assert plain(metrics.armed_ratio(counts.filter("armed = 'armed'"), none)) == [(0.5, None)]


def test_shooting_states_flee_ages(victims):
    assert [r.state for r in shootings.per_state(victims).collect()] == [None, "NY", "TX", "CA"]
    assert {r.flee for r in shootings.flee_modes(victims).collect()} == {"Car", "", None, "Foot"}
    assert plain(shootings.cohort_age_histogram(victims)) == [(30, 1)]
    assert plain(shootings.age_histogram(victims).select("bin", "count")) == [
        (20, 1), (35, 1), (40, 1), (50, 3),
    ]
    assert plain(shootings.weapon_labels(victims)) == [("",), ("gun",), ("toy weapon",), ("unarmed",)]
    assert dict(plain(shootings.weapon_words(victims))) == {
        "gun": 1, "toy": 1, "weapon": 1, "unarmed": 1,
    }
    measure = shootings.state_measure(count_by(shootings.cohort(victims), "state"), "count")
    assert plain(measure) == [("NY", 2.0)]
    assert shootings.race_ages(victims).count() == 8


def test_deaths(spark):
    data = [
        ("1", "GUNFIRE F", "2009-01-01", 2009, "TRUE", " NY"),
        ("2", "", "2010-01-01", 2010, "true", " NY"),
        ("3", "CRASH F", "2019-01-01", 2019, None, " "),
        ("4", "CRASH F", "2008-01-01", 2008, "TRUE", "CA"),
        ("5", "CRASH F", "2020-01-01", 2020, "TRUE", "CA"),
    ]
    df = spark.createDataFrame(
        data, "_id string, cause_short string, date string, year int, canine string, state string"
    )
    clean = deaths.clean_deaths(df)
    assert [(r._id, r.canine, r.state) for r in clean.orderBy("_id").collect()] == [
        ("1", 1, "NY"), ("2", 0, "NY"), ("3", 0, ""),
    ]
    assert plain(deaths.deaths_state_top(clean)) == [("NY", 2)]
    assert plain(deaths.deaths_cause_top(clean, 1)) == [("CRASH F", 1)]
    assert [r.year for r in deaths.deaths_trend(clean).collect()] == [2009, 2010, 2019]


@pytest.fixture(scope="module")
def people(spark):
    data = [
        ("1", "NEW YORK", "Kings County", 1, 1, 1, 1, 10),
        ("2", "New York", "Kings County", 2, 2, 18, 2, 30),
        ("3", "Wyoming", "Kings County", 2, 2, 18, 2, 30),
        ("4", "New York", "Kings County", 2, 2, 18, 2, 0),
        ("5", "New York", "Albany County", 2, 2, 18, 2, 5),
        ("6", "New York", "Kings County", 2, 1, 0, 32, 7),
        ("7", "New York", "Kings County", 2, 1, 3, None, 7),
        ("8", "New York", "Kings County", 2, 1, 3, 6, 3),
    ]
    return census.recode_census(census.filter_census(spark.createDataFrame(data, schemas.CENSUS)))


def test_census(people):
    assert people.schema.names == schemas.CENSUS_RECODED.names
    assert [f.dataType for f in people.schema] == [f.dataType for f in schemas.CENSUS_RECODED]
    assert {r._id for r in people.collect()} == {"1", "2", "5", "6", "8"}
    boroughs = census.race_by_borough(census.clean_census(people))
    assert plain(boroughs) == [
        ("BROOKLYN", "BLACK HISPANIC", 30), ("BROOKLYN", "WHITE", 13), ("BROOKLYN", None, 7),
    ]
    shares = {r.IMPRACE: r.share for r in census.borough_slice(boroughs, "BROOKLYN").collect()}
    assert math.isclose(shares["WHITE"], 13 / 50)


def test_incidence(spark, people):
    boroughs = census.race_by_borough(census.clean_census(people))
    crimes = spark.createDataFrame(
        [("BROOKLYN", "WHITE", 23), ("BROOKLYN", "BLACK", 17), ("BRONX", "WHITE", 1)],
        "BORO_NM string, SUSP_RACE string, count long",
    )
    long = metrics.incidence(crimes, boroughs)
    got = {(r.BORO_NM, r.SUSP_RACE): r for r in long.collect()}
    # 23/40 = 0.575 rounds to 0.57 before it is multiplied.
    assert got[("BROOKLYN", "WHITE")].ratio_x == 0.57
    assert got[("BROOKLYN", "WHITE")].incidence == 0.57 * 0.26
    assert got[("BROOKLYN", "BLACK")].incidence is None
    assert got[("BRONX", "WHITE")].ratio_x == 1.0
    assert plain(metrics.incidence_wide(long, ["BLACK", "WHITE"])) == [
        ("BRONX", None, None, None), ("BROOKLYN", None, round(0.57 * 0.26, 9), None),
    ]


def test_felony_share(spark):
    severity = spark.createDataFrame(
        [(2009, "FELONY", 1), (2009, "VIOLATION", 3), (2010, "VIOLATION", 2), (2011, "FELONY", 5)],
        "yearpd int, LAW_CAT_CD string, count long",
    )
    shares = metrics.felony_share(severity)
    assert [r.ratio for r in shares.collect()] == [0.25, 0.0, 1.0]
    variance = metrics.felony_share_variance(shares).first().variance
    assert math.isclose(variance, 0.2708333333333333)
    wide = incidents.crimes_severity_wide(severity).collect()
    assert (wide[1].FELONY, wide[1].VIOLATION) == (None, 2)


def test_growth_compared(spark):
    a = spark.createDataFrame([(2001, 20), (2000, 10)], "year int, count long")
    b = spark.createDataFrame([(2000, 4), (2001, 2), (2002, 3)], "year int, count long")
    assert plain(metrics.growth_compared(a, b)) == [(2001, 1.0, -0.5), (2002, None, 0.5)]


def test_polls(spark):
    df = spark.createDataFrame([("NY", 36.5, 59.0), ("TX", 52.2, 43.2), ("ZZ", 45.0, 45.0)],
                               "State_short string, RepPercentage double, DemPercentage double")
    assert plain(polls.winners(polls.clean_polls(df))) == [("NY", 0), ("TX", 1), ("ZZ", 0)]
