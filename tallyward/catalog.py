"""Named queries over the test tables: each report bound to its adapter view."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions.predicates import names_race
from tallyward.functions.recode import place_label
from tallyward.operators import lookup
from tallyward.operators.counting import COUNT, count_by
from tallyward.operators.crosstab import REST, crosstab_wide_share
from tallyward.operators.distribution import binned_density_curve
from tallyward.operators.text import word_and_pair_counts, word_counts
from tallyward.plans import census as cen
from tallyward.plans import classifier, keyvalue, metrics
from tallyward.plans import deaths as dth
from tallyward.plans import incidents as inc
from tallyward.plans import polls as pol
from tallyward.plans import shootings as sho
from tallyward.sources import adapters, tables
from tallyward.sources.lines import join_fields
from tallyward.sources.schemas import CENSUS_RECODED, INCIDENT_NAMES

Query = Callable[[SparkSession, str], DataFrame]

# The test data covers 1995-2001, so the study years are set within them.
FIRST_YEAR, LAST_YEAR = 1996, 2000
RACES = [
    "ASIAN / PACIFIC ISLANDER", "BLACK", "BLACK HISPANIC", "WHITE", "WHITE HISPANIC",
]
CENSUS_LINE = ["_id", "STNAME", "CTYNAME", "SEX", "ORIGIN", "AGEGRP", "IMPRACE", "RESPOP"]
CRIME_LINE = [
    "_id", "CMPLNT_FR_DT", "CMPLNT_FR_TM", "ADDR_PCT_CD", "KY_CD", "OFNS_DESC",
    "CRM_ATPT_CPTD_CD", "LAW_CAT_CD", "BORO_NM", "SUSP_AGE_GROUP", "SUSP_RACE",
    "SUSP_SEX", "Latitude", "Longitude",
]

# A complaint of each scale of the test tables: 0.001, 0.01, 0.1; and an id of none.
SOME_IDS = ["0-3-170-3", "0-1-511-66", "0-3-3230-532", "0-0-0-0"]
# Offences with a column of their own in the wide table; the rest share one.
NAMED_OFFENSES = [
    "BLUE ROD", "COLD ROD", "HOT ROD", "LARGE ROD", "NEW ROD", "OLD ROD", "RED ROD", "SMALL ROD",
]
# An id is not unique: these columns make the order of complaints total.
ID_ORDER = ["_id", "SUSP_AGE_GROUP", "LAW_CAT_CD", "CRM_ATPT_CPTD_CD"]

# The raw columns behind ``incidents.CELL_KEYS``.
CELL_COLUMNS = [
    "CMPLNT_FR_DT", "CMPLNT_FR_TM", "LAW_CAT_CD", "BORO_NM", "OFNS_DESC",
    "SUSP_AGE_GROUP", "SUSP_RACE",
]

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _crimes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Cleaned complaints with only the columns of one report."""
    return inc.clean_incidents(adapters.incidents(spark, folder, columns))


def _counted(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Cleaned counts of complaints, for reports on columns that one key holds."""
    return inc.clean_text(adapters.incident_counts(spark, folder, columns))


def _crime_days(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """Counts of complaints by day and the other columns of one report."""
    read = ["CMPLNT_FR_TM" if key == "day_night" else key for key in keys]
    counts = adapters.incident_counts(spark, folder, ["CMPLNT_FR_DT", *read])
    return inc.clean_cells(counts, *keys, weight=COUNT)


def _study_incidents(spark: SparkSession, folder: str, limit: int = 0) -> DataFrame:
    """The filtered complaints, by a year range that prunes the scan of dates."""
    raw = adapters.incidents(spark, folder, years=(FIRST_YEAR, LAST_YEAR))
    return inc.filter_incidents(raw, FIRST_YEAR, LAST_YEAR, dated=True, limit=limit)


def _victims(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return sho.clean_shootings(adapters.shootings(spark, folder, columns))


def _officers(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    raw = adapters.police_deaths(spark, folder, columns, years=(FIRST_YEAR, LAST_YEAR))
    return dth.clean_deaths(raw, FIRST_YEAR - 1, LAST_YEAR + 1)


def _new_york(
    spark: SparkSession, folder: str, columns: Sequence[str] = tuple(CENSUS_LINE)
) -> DataFrame:
    return cen.recode_census(cen.filter_census(adapters.census(spark, folder, columns)))


# -- cleaning and records ----------------------------------------------------


@query
def incident_filter(spark, folder):
    return _study_incidents(spark, folder)


@query
def incident_text_filter(spark, folder):
    """The filter on the date's text, for rows without a real date."""
    return inc.filter_incidents(adapters.incidents(spark, folder), FIRST_YEAR, LAST_YEAR)


@query
def incident_year_filter(spark, folder):
    """The same on a table whose rows were put by year when they were appended."""
    path = tables.scratch_path(spark, "complaints")
    inc.append_incidents(adapters.incidents(spark, folder), path, "first")
    return inc.filter_appended(spark, path, FIRST_YEAR, LAST_YEAR)


@query
def incident_filter_limit(spark, folder):
    return _study_incidents(spark, folder, limit=50)


@query
def record_rename(spark, folder):
    return lookup.renamed(_study_incidents(spark, folder), INCIDENT_NAMES)


@query
def record_restore(spark, folder):
    records = lookup.renamed(_study_incidents(spark, folder), INCIDENT_NAMES)
    return lookup.restored(records, INCIDENT_NAMES)


@query
def incidents_clean(spark, folder):
    clean = _crimes(spark, folder, *INCIDENT_NAMES)
    return clean.withColumn("date", F.col("date").cast("string"))


@query
def incident_cells(spark, folder):
    counts = adapters.incident_counts(spark, folder, CELL_COLUMNS)
    return inc.incident_cells(inc.clean_incidents(counts), COUNT)


@query
def shootings_clean(spark, folder):
    clean = _victims(spark, folder, *sho.REPORT_COLUMNS)
    return clean.withColumn("date", F.col("date").cast("string"))


@query
def deaths_clean(spark, folder):
    return _officers(
        spark, folder, "_id", "person", "dept", "cause_short", "date", "year", "canine", "state"
    )


@query
def census_filter_recode(spark, folder):
    return _new_york(spark, folder)


@query
def census_filter_limit(spark, folder):
    return cen.filter_census(adapters.census(spark, folder), limit=50)


@query
def census_clean(spark, folder):
    return cen.clean_census(_new_york(spark, folder))


# -- complaint counts --------------------------------------------------------


@query
def crimes_trend(spark, folder):
    report = inc.crimes_trend(_crime_days(spark, folder), COUNT)
    return _round(report, 6, "slope", "intercept", "trend")


@query
def crimes_top(spark, folder):
    return inc.crimes_top(_counted(spark, folder, "OFNS_DESC"), weight=COUNT)


def _severity(spark, folder):
    return inc.crimes_severity(_crime_days(spark, folder, "LAW_CAT_CD"), COUNT)


@query
def crimes_severity(spark, folder):
    return _severity(spark, folder)


@query
def crimes_severity_wide(spark, folder):
    return inc.crimes_severity_wide(_severity(spark, folder))


@query
def crimes_severity_by_district(spark, folder):
    return inc.crimes_severity_by_district(
        _crime_days(spark, folder, "BORO_NM", "LAW_CAT_CD"), COUNT
    )


def _day_night(spark, folder):
    return inc.crimes_day_night(_crime_days(spark, folder, "day_night", "LAW_CAT_CD"), COUNT)


@query
def crimes_day_night(spark, folder):
    return _day_night(spark, folder)


@query
def crimes_day_totals(spark, folder):
    return inc.day_totals(_day_night(spark, folder))


@query
def crimes_night_totals(spark, folder):
    return inc.night_totals(_day_night(spark, folder))


@query
def crimes_race(spark, folder):
    return inc.crimes_race(_counted(spark, folder, "SUSP_RACE"), weight=COUNT)


def _districts_race(spark, folder):
    return inc.crimes_districts_race(
        _counted(spark, folder, "BORO_NM", "SUSP_RACE"), weight=COUNT
    )


@query
def crimes_districts_race(spark, folder):
    return _districts_race(spark, folder)


@query
def district_race_slice(spark, folder):
    return inc.district_race_slice(_districts_race(spark, folder), "BRONX")


@query
def crimes_ages(spark, folder):
    return inc.crimes_ages(_counted(spark, folder, "SUSP_AGE_GROUP"), COUNT)


# -- cross-tables ------------------------------------------------------------


@query
def cross_districts(spark, folder):
    return inc.cross_districts(_counted(spark, folder, "BORO_NM", "OFNS_DESC"), COUNT)


@query
def cross_districts_share(spark, folder):
    return inc.cross_districts_share(_counted(spark, folder, "BORO_NM", "OFNS_DESC"), COUNT)


def _districts_wide(spark, folder):
    counts = _counted(spark, folder, "BORO_NM", "OFNS_DESC")
    return inc.cross_districts_wide(counts, NAMED_OFFENSES, COUNT)


@query
def cross_districts_wide(spark, folder):
    return _districts_wide(spark, folder)


@query
def cross_districts_wide_share(spark, folder):
    return crosstab_wide_share(_districts_wide(spark, folder), "BORO_NM")


@query
def district_crimes(spark, folder):
    whole = inc.district_crimes(_crimes(spark, folder, *INCIDENT_NAMES))
    return whole.withColumn("date", F.col("date").cast("string"))


@query
def cross_district_races(spark, folder):
    return inc.cross_district_races(_counted(spark, folder, "BORO_NM", "SUSP_RACE"), COUNT)


@query
def cross_district_races_share(spark, folder):
    return inc.cross_district_races_share(
        _counted(spark, folder, "BORO_NM", "SUSP_RACE"), COUNT
    )


def _district_races_wide(spark, folder):
    counts = _counted(spark, folder, "BORO_NM", "SUSP_RACE")
    return inc.cross_district_races_wide(counts, RACES, COUNT)


@query
def cross_district_races_wide(spark, folder):
    return _district_races_wide(spark, folder)


@query
def cross_district_races_wide_share(spark, folder):
    return crosstab_wide_share(_district_races_wide(spark, folder), "BORO_NM")


def _age_race(spark, folder):
    counts = _counted(spark, folder, "SUSP_AGE_GROUP", "SUSP_RACE")
    return inc.cross_age_race(counts, weight=COUNT)


@query
def cross_age_race(spark, folder):
    return _age_race(spark, folder)


@query
def cross_age_race_share(spark, folder):
    return crosstab_wide_share(_age_race(spark, folder), "SUSP_RACE")


@query
def cross_crime_race(spark, folder):
    return inc.cross_crime_race(_counted(spark, folder, "SUSP_RACE", "OFNS_DESC"), weight=COUNT)


@query
def cross_crime_race_share(spark, folder):
    counts = _counted(spark, folder, "SUSP_RACE", "OFNS_DESC")
    return inc.cross_crime_race_share(counts, weight=COUNT)


def _crime_race_wide(spark, folder):
    counts = _counted(spark, folder, "SUSP_RACE", "OFNS_DESC")
    return inc.cross_crime_race_wide(counts, weight=COUNT)


@query
def cross_crime_race_wide(spark, folder):
    return _crime_race_wide(spark, folder)


@query
def cross_crime_race_wide_share(spark, folder):
    return inc.cross_crime_race_wide_share(_crime_race_wide(spark, folder))


# -- a batch of reports on the filtered table --------------------------------


def _study_cells(spark, folder):
    """Filter, clean and group once."""
    years = (FIRST_YEAR, LAST_YEAR)
    counts = adapters.incident_counts(spark, folder, CELL_COLUMNS, years)
    return inc.incident_cells(inc.clean_incidents(counts.filter(names_race())), COUNT)


@query
def batch_reports(spark, folder):
    """The ten reports of the batch from one pass, as one table."""
    return inc.all_reports(_study_cells(spark, folder))


@query
def batch_reports_written(spark, folder):
    """The same, written once by report; one of them read back by its folder."""
    path = tables.scratch_path(spark, "batch")
    tables.append_table(batch_reports(spark, folder), path, ["report"])
    whole = tables.read_table(spark, path)
    one = whole.filter(F.col("part_report") == "=crimes_severity")
    return one.select("yearpd", "LAW_CAT_CD", COUNT)


@query
def batch_trend(spark, folder):
    report = inc.crimes_trend(_study_cells(spark, folder), COUNT)
    return _round(report, 6, "slope", "intercept", "trend")


@query
def batch_severity(spark, folder):
    return inc.crimes_severity(_study_cells(spark, folder), COUNT)


@query
def batch_day_night(spark, folder):
    return inc.crimes_day_night(_study_cells(spark, folder), COUNT)


@query
def batch_districts_race(spark, folder):
    return inc.crimes_districts_race(_study_cells(spark, folder), weight=COUNT)


@query
def batch_age_race(spark, folder):
    return inc.cross_age_race(_study_cells(spark, folder), weight=COUNT)


@query
def batch_crime_race(spark, folder):
    return inc.cross_crime_race(_study_cells(spark, folder), weight=COUNT)


# -- lookups -----------------------------------------------------------------


def _like(column, pattern):
    def run(spark, folder):
        return _completed(
            spark, folder, [column], 10,
            lambda rows: lookup.find_like(rows, column, pattern, *ID_ORDER, limit=10),
        )

    return run


def _completed(spark, folder, columns, n, search):
    """Search ``n`` study complaints by some columns, and fetch the others of those
    found by their keys."""
    needed = list(dict.fromkeys([*ID_ORDER, "SUSP_RACE", *columns]))
    rows = adapters.keyed_incidents(spark, folder, needed, (FIRST_YEAR, LAST_YEAR))
    found = lookup.fetched(search(rows.filter(names_race())), n)
    return lookup.limited(adapters.complete_incidents(spark, folder, found), n, *ID_ORDER)


_QUERIES["lookup_regex_borough"] = _like("BORO_NM", "bro")
_QUERIES["lookup_regex_race"] = _like("SUSP_RACE", "black")
_QUERIES["lookup_regex_sex"] = _like("SUSP_SEX", "male")
_QUERIES["lookup_regex_age"] = _like("SUSP_AGE_GROUP", "^1")


@query
def lookup_eq_sex(spark, folder):
    rows = adapters.incidents(spark, folder, ["_id", "LAW_CAT_CD", "SUSP_SEX"])
    return lookup.find_equal(rows, "SUSP_SEX", "FEMALE")


@query
def lookup_eq_age(spark, folder):
    rows = adapters.incidents(spark, folder, ["_id", "LAW_CAT_CD", "SUSP_AGE_GROUP"])
    return lookup.find_younger(rows, "SUSP_AGE_GROUP", 18)


@query
def lookup_eq_offence(spark, folder):
    rows = adapters.incidents(spark, folder, ["_id", "KY_CD", "OFNS_DESC"])
    return lookup.find_equal(rows, "KY_CD", 110)


@query
def lookup_id(spark, folder):
    """One complaint for each id, or none."""
    searches = [adapters.incident_by_id(spark, folder, i, *ID_ORDER) for i in SOME_IDS]
    found = lookup.fetched(reduce(DataFrame.unionAll, searches), len(SOME_IDS))
    return adapters.complete_incidents(spark, folder, found)


@query
def incident_preview(spark, folder):
    return _completed(spark, folder, [], 20, lambda rows: lookup.preview(rows, *ID_ORDER))


# -- shootings ---------------------------------------------------------------


def _monthly(spark, folder):
    return sho.monthly(_victims(spark, folder, "date"))


@query
def shoot_monthly(spark, folder):
    return _monthly(spark, folder)


@query
def shoot_month_by_year(spark, folder):
    return sho.monthly_by_year(_monthly(spark, folder))


@query
def shoot_month_slice(spark, folder):
    return sho.month_slice(sho.monthly_by_year(_monthly(spark, folder)), "1998")


@query
def shoot_yearly(spark, folder):
    return sho.yearly(_victims(spark, folder, "date"))


def _race_months(spark, folder):
    return sho.race_months(_victims(spark, folder, "date", "race"))


@query
def shoot_race_month(spark, folder):
    return _race_months(spark, folder)


@query
def shoot_race_month_slice(spark, folder):
    return sho.race_month_slice(_race_months(spark, folder), "Hispanic")


@query
def shoot_state(spark, folder):
    return sho.per_state(_victims(spark, folder, "state"))


@query
def shoot_flee(spark, folder):
    return sho.flee_modes(_victims(spark, folder, "flee"))


def _armed(spark, folder, label):
    return sho.armed_slice(sho.armed_counts(_victims(spark, folder, "armed", "race")), label)


@query
def shoot_armed(spark, folder):
    return _armed(spark, folder, "armed")


@query
def shoot_unarmed(spark, folder):
    return _armed(spark, folder, "unarmed")


@query
def black_state(spark, folder):
    return count_by(sho.cohort(_victims(spark, folder, "race", "state")), "state")


@query
def black_year(spark, folder):
    return count_by(sho.cohort(_victims(spark, folder, "race", "date")), "year")


@query
def race_age_extract(spark, folder):
    return sho.race_ages(_victims(spark, folder, "race", "age"))


@query
def all_year(spark, folder):
    return count_by(_victims(spark, folder, "date"), "year")


@query
def all_state(spark, folder):
    return count_by(_victims(spark, folder, "state"), "state")


@query
def all_race(spark, folder):
    return sho.race_counts(_victims(spark, folder, "race"))


@query
def black_state_measure(spark, folder):
    return sho.state_measure(black_state(spark, folder), COUNT)


@query
def all_state_measure(spark, folder):
    return sho.state_measure(all_state(spark, folder), COUNT)


@query
def age_histogram(spark, folder):
    return _round(sho.age_histogram(_victims(spark, folder, "age")), 9, "density")


@query
def age_histogram_from_smallest(spark, folder):
    report = sho.age_histogram(_victims(spark, folder, "age"), from_smallest=True)
    return _round(report, 9, "density")


@query
def age_density(spark, folder):
    return _round(sho.age_density(_victims(spark, folder, "age")), 6, "x", "density")


@query
def black_age_histogram(spark, folder):
    return sho.cohort_age_histogram(_victims(spark, folder, "race", "age"))


@query
def monthly_box(spark, folder):
    return _round(sho.monthly_box(_monthly(spark, folder)), 6, "mean", "sd", "q1", "median", "q3")


@query
def race_box(spark, folder):
    report = sho.race_box(_race_months(spark, folder))
    return _round(report, 6, "mean", "sd", "q1", "median", "q3")


@query
def weapon_labels(spark, folder):
    return sho.weapon_labels(_victims(spark, folder, "armed"))


@query
def weapon_words(spark, folder):
    return sho.weapon_words(_victims(spark, folder, "armed"))


@query
def part_words(spark, folder):
    return word_counts(adapters.table(spark, folder, "part"), "p_name")


@query
def weapon_pairs(spark, folder):
    return word_and_pair_counts(_victims(spark, folder, "armed"), "armed")


@query
def part_pairs(spark, folder):
    return word_and_pair_counts(adapters.table(spark, folder, "part"), "p_name")


@query
def price_density(spark, folder):
    """The density of a measure with about as many values as rows."""
    orders = adapters.table(spark, folder, "orders")
    curve = binned_density_curve(orders, "o_totalprice").select(
        "place", "x", (F.col("density") * 1_000_000).alias("density")
    )
    return _round(curve, 6, "x", "density")


# -- police deaths, census, polls --------------------------------------------


def _deaths_trend(spark, folder):
    return dth.deaths_trend(_officers(spark, folder, "year"))


@query
def deaths_trend(spark, folder):
    return _round(_deaths_trend(spark, folder), 6, "slope", "intercept", "trend")


@query
def deaths_cause_top(spark, folder):
    return dth.deaths_cause_top(_officers(spark, folder, "year", "cause_short"))


@query
def deaths_state_top(spark, folder):
    return dth.deaths_state_top(_officers(spark, folder, "year", "state"), 10)


def _borough_races(spark, folder):
    columns = ["STNAME", "CTYNAME", "ORIGIN", "IMPRACE", "RESPOP"]
    return cen.race_by_borough(cen.clean_census(_new_york(spark, folder, columns)))


@query
def race_by_borough(spark, folder):
    return _borough_races(spark, folder)


@query
def borough_slice(spark, folder):
    return cen.borough_slice(_borough_races(spark, folder), "QUEENS")


@query
def polls_winner(spark, folder):
    return pol.winners(pol.clean_polls(adapters.polls(spark, folder)))


@query
def polls_measure(spark, folder):
    return sho.state_measure(polls_winner(spark, folder), "Winner", "State_short")


# -- text lines --------------------------------------------------------------


def _line_file(spark, folder, name, rows, columns, short):
    """Lines of a text file: a header, the rows, and those marked ``short`` cut
    off after six fields."""
    line = join_fields(*columns)
    line = F.when(short, F.substring_index(line, ",", 6)).otherwise(line)
    header = spark.range(1).select(F.lit(",".join(columns)).alias("value"))
    path = tables.scratch_path(spark, name)
    rows.select(line.alias("value")).unionAll(header).write.text(path)
    return tables.read_lines(spark, path)


def _census_lines(spark, folder):
    rows = _new_york(spark, folder)
    return _line_file(spark, folder, "census-lines", rows, CENSUS_LINE, F.lit(False))


def _dirty_census_lines(spark, folder):
    """Some lines are short; some of one group's numbers cannot be read."""
    number = F.col("_id").cast("bigint")
    rows = _new_york(spark, folder).withColumn(
        "RESPOP",
        F.when(
            F.col("IMPRACE").startswith("American") & (number % 62 == 2), "unknown"
        ).otherwise(F.col("RESPOP").cast("string")),
    )
    return _line_file(
        spark, folder, "dirty-census-lines", rows, CENSUS_LINE, number % 101 == 0
    )


def _crime_lines(spark, folder, name="crime-lines", short=None):
    # Two-word offences get a comma, so that these lines have a field too many.
    rows = _study_incidents(spark, folder)
    rows = rows.withColumn("OFNS_DESC", F.replace("OFNS_DESC", F.lit(" "), F.lit(", ")))
    return _line_file(spark, folder, name, rows, CRIME_LINE, F.lit(False) if short is None else short)


def _dirty_crime_lines(spark, folder):
    """Some lines are short."""
    return _crime_lines(spark, folder, "dirty-crime-lines", F.col("ADDR_PCT_CD") % 97 == 0)


@query
def mr_population_by_race(spark, folder):
    return keyvalue.population_by_race(_census_lines(spark, folder))


@query
def mr_crimes_by_race(spark, folder):
    return keyvalue.crimes_by_race(_crime_lines(spark, folder))


@query
def mr_crime_rate(spark, folder):
    report = metrics.crime_rate(
        keyvalue.population_by_race(_census_lines(spark, folder)),
        keyvalue.crimes_by_race(_crime_lines(spark, folder)),
    )
    return _round(report, 9, "rate")


@query
def mr_text_files(spark, folder):
    """Population by race from dirty lines, through a tab-separated result."""
    result = tables.scratch_path(spark, "census-result")
    report = keyvalue.population_by_race(_dirty_census_lines(spark, folder))
    tables.write_key_values(report, result)
    return tables.read_key_values(spark, result)


@query
def mr_crime_text(spark, folder):
    """Crimes by race from text lines, through a tab-separated result."""
    result = tables.scratch_path(spark, "crime-result")
    report = keyvalue.crimes_by_race(_dirty_crime_lines(spark, folder))
    tables.write_key_values(report, result)
    return tables.read_key_values(spark, result)


@query
def mr_rejected_lines(spark, folder):
    """How many lines of each file a job leaves out, and why."""
    counts = [
        keyvalue.rejected_counts(rejected).withColumn("file", F.lit(name))
        for name, rejected in (
            ("census", keyvalue.rejected_census_lines(_dirty_census_lines(spark, folder))),
            ("crimes", keyvalue.rejected_crime_lines(_dirty_crime_lines(spark, folder))),
        )
    ]
    return reduce(DataFrame.unionAll, counts)


@query
def locus(spark, folder):
    events = adapters.table(spark, folder, "events").select(
        F.when(F.col("event_type") == "view", "inside")
        .otherwise(F.col("event_type"))
        .alias("place")
    )
    return count_by(events.select(place_label(F.col("place")).alias("locus")), "locus")


# -- metrics -----------------------------------------------------------------


@query
def metric_yoy_crimes(spark, folder):
    report = count_by(_crime_days(spark, folder), "yearpd", weight=COUNT)
    return _round(metrics.crime_growth(report), 12, "ratio")


@query
def metric_armed_ratio(spark, folder):
    counts = sho.armed_counts(_victims(spark, folder, "armed", "race"))
    ratio = metrics.armed_ratio(
        *[counts.filter(F.col("armed") == label) for label in ("armed", "unarmed")]
    )
    return _round(ratio, 12, "armed_ratio", "unarmed_ratio")


@query
def metric_felony_share(spark, folder):
    return _round(metrics.felony_share(_severity(spark, folder)), 12, "ratio")


@query
def metric_felony_share_var(spark, folder):
    shares = metrics.felony_share(_severity(spark, folder))
    return _round(metrics.felony_share_variance(shares), 12, "variance")


def _incidence(spark, folder):
    return metrics.incidence(_districts_race(spark, folder), _borough_races(spark, folder))


@query
def metric_incidence(spark, folder):
    return _round(_incidence(spark, folder), 6, "ratio_x", "ratio_y", "incidence")


@query
def metric_incidence_wide(spark, folder):
    return _round(metrics.incidence_wide(_incidence(spark, folder), RACES), 6, *RACES, REST)


@query
def metric_yoy_deaths_vs_shootings(spark, folder):
    report = metrics.growth_compared(
        count_by(_officers(spark, folder, "year"), "year"),
        sho.yearly(_victims(spark, folder, "date")),
    )
    return _round(report, 12, "deaths_ratio", "shootings_ratio")


@query
def metric_yoy_deaths_vs_black_shootings(spark, folder):
    victims = sho.cohort(_victims(spark, folder, "race", "date"))
    report = metrics.growth_compared(
        count_by(_officers(spark, folder, "year"), "year"), sho.yearly(victims)
    )
    return _round(report, 12, "deaths_ratio", "shootings_ratio")


# -- files and classifier ----------------------------------------------------


@query
def csv_roundtrip(spark, folder):
    """A report with empty-text groups, saved as CSV and read back."""
    report = crimes_severity_by_district(spark, folder)
    path = tables.scratch_path(spark, "report")
    tables.write_report(report, path)
    return tables.read_report(spark, path, report.schema)


@query
def csv_untrimmed(spark, folder):
    """States of police deaths as they come, blanks at either end, through CSV."""
    report = count_by(adapters.police_deaths(spark, folder, ["state"]), "state")
    path = tables.scratch_path(spark, "report")
    tables.write_report(report, path)
    return tables.read_report(spark, path, report.schema)


@query
def table_append_districts(spark, folder):
    """Counts appended to a table partitioned by a text that can be empty."""
    report = crimes_severity_all_districts(spark, folder)
    path = tables.scratch_path(spark, "districts")
    tables.append_table(report, path, ["BORO_NM"])
    return tables.read_table(spark, path, report.schema, columns=report.columns)


def crimes_severity_all_districts(spark, folder):
    """Complaints by district and severity, empty districts included."""
    return count_by(
        _counted(spark, folder, "BORO_NM", "LAW_CAT_CD"), "BORO_NM", "LAW_CAT_CD", weight=COUNT
    )


@query
def table_append(spark, folder):
    """Filtered census rows appended to a table and read back."""
    path = tables.scratch_path(spark, "ny-census")
    tables.append_table(_new_york(spark, folder), path, ["CTYNAME"])
    return tables.read_table(spark, path, CENSUS_RECODED, columns=CENSUS_LINE)


@query
def table_append_again(spark, folder):
    """Two batches of census rows, the first of them appended twice."""
    path = tables.scratch_path(spark, "ny-census")
    rows = _new_york(spark, folder)
    for batch, origin in (("first", 1), ("second", 2), ("first", 1)):
        own = rows.filter((F.col("_id").cast("bigint") % 2 + 1) == origin)
        tables.append_batch(own, path, batch, ["CTYNAME"])
    return tables.read_batches(spark, path, CENSUS_RECODED).select(*CENSUS_LINE)


def _classified(spark, folder):
    return classifier.split_rows(classifier.complete_rows(adapters.shootings(spark, folder)))


def _trained(rows):
    return classifier.train(rows.filter(F.col("split") == "train"))


def _prepared(rows):
    return classifier.features(rows.filter(F.col("split") == "train"))


def _told_apart(spark, folder):
    """Complete rows whose class is told by one category, so that a fitted
    classifier is right about every one."""
    told = F.when(F.col("threat_level") == "attack", 1).otherwise(0)
    return _classified(spark, folder).withColumn("label", told)


@query
def classifier_confusion(spark, folder):
    """Classes against predictions where the classes can be told apart."""
    rows = _told_apart(spark, folder)
    return classifier.confusion(_trained(rows), rows)


@query
def classifier_accuracy(spark, folder):
    """Rows, accuracy and error there."""
    rows = _told_apart(spark, folder)
    return classifier.scores(_trained(rows), rows)


@query
def classifier_rows(spark, folder):
    """The complete rows with their class and split."""
    return _classified(spark, folder).select("id", "race", "label", "split")


@query
def classifier_index(spark, folder):
    """The categories' values in the order of their slots."""
    rows = _classified(spark, folder)
    return classifier.category_index(rows.filter(F.col("split") == "train"))


@query
def classifier_features(spark, folder):
    """The slots each row sets in its feature vector."""
    rows = _classified(spark, folder)
    return classifier.feature_slots(_prepared(rows), rows)


@query
def classifier_split(spark, folder):
    """Rows scored in each split."""
    rows = _classified(spark, folder)
    return classifier.scores(_trained(rows), rows).select("split", "rows")


@query
def race_classifier(spark, folder):
    rows = _classified(spark, folder)
    return classifier.scores(_trained(rows), rows)
