"""Crime complaint reports.

Reports take the cleaned table (``clean_incidents``) or its cells
(``incident_cells``) with ``weight='count'``; both give the same result. Text
filters follow each report: some drop empty text only, some also the word
``false``, some nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallyward.functions import dates
from tallyward.functions.predicates import (
    UNKNOWN,
    filled,
    names_race,
    not_missing_word,
    unknown_if_empty,
    wanted_by_year,
    wanted_incident,
)
from tallyward.operators.counting import (
    COUNT,
    count_by,
    ranked,
    regroup,
    settled,
    share_of_total,
    share_within,
    slice_of,
    top_n,
)
from tallyward.operators.crosstab import (
    REST,
    crosstab,
    crosstab_share,
    crosstab_wide,
    unstack,
)
from tallyward.operators.lookup import limited
from tallyward.operators.series import linear_trend
from tallyward.sources.schemas import INCIDENT_NAMES, INCIDENTS, OFFENSE_LEVELS
from tallyward.sources.tables import append_batch, read_batches

# Districts, age bands and report sizes.
DISTRICTS = ["QUEENS", "BROOKLYN", "BRONX", "STATEN ISLAND", "MANHATTAN"]
AGE_BANDS = ["<18", "18-24", "25-44", "45-64", "65+"]
TOP_OFFENSES, TOP_RACES, TOP_CROSSED_OFFENSES = 20, 8, 5
FIRST_YEAR, LAST_YEAR = 2009, 2019

WRITTEN_YEAR = "written_year"

# The columns by which the reports group.
CELL_KEYS = [
    "yearpd", "day_night", "LAW_CAT_CD", "BORO_NM", "OFNS_DESC",
    "SUSP_AGE_GROUP", "SUSP_RACE",
]


def filter_incidents(
    raw: DataFrame,
    first_year: int = FIRST_YEAR,
    last_year: int = LAST_YEAR,
    dated: bool = False,
    limit: int = 0,
) -> DataFrame:
    """The rows and columns of the raw file that the reports read.

    ``dated`` says that the rows were already chosen by a real date. A limit
    other than 0 keeps the first rows by id and the columns after it.
    """
    wanted = names_race() if dated else wanted_incident(first_year, last_year)
    return limited(raw.filter(wanted).select(*INCIDENT_NAMES), limit, *INCIDENT_NAMES)


def append_incidents(raw: DataFrame, path: str, batch: str) -> None:
    """Append raw complaints as a batch, put by the year their date's text names.

    The year is worked out once, here; ``filter_appended`` then skips the folders of
    other years. An empty or odd date text has no year, and a folder of its own.
    """
    year = dates.written_year(F.col("CMPLNT_FR_DT"))
    append_batch(raw.select(*INCIDENT_NAMES, year.alias(WRITTEN_YEAR)), path, batch, [WRITTEN_YEAR])


def filter_appended(
    spark: SparkSession, path: str, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR
) -> DataFrame:
    """What ``filter_incidents`` keeps of the appended complaints."""
    fields = [INCIDENTS[c] for c in INCIDENT_NAMES]
    schema = StructType([*fields, StructField(WRITTEN_YEAR, IntegerType())])
    rows = read_batches(spark, path, schema)
    return rows.filter(wanted_by_year(WRITTEN_YEAR, first_year, last_year)).select(*INCIDENT_NAMES)


def clean_text(incidents: DataFrame) -> DataFrame:
    """Add the night flag; label empty race and age as unknown."""
    have = set(incidents.columns)
    added = {}
    if "CMPLNT_FR_TM" in have:
        added["day_night"] = dates.night_flag(F.col("CMPLNT_FR_TM"))
    for name in ("SUSP_RACE", "SUSP_AGE_GROUP"):
        if name in have:
            added[name] = unknown_if_empty(F.col(name))
    return incidents.withColumns(added)


def add_dates(incidents: DataFrame) -> DataFrame:
    """Add the real date and its year."""
    if "CMPLNT_FR_DT" not in incidents.columns:
        return incidents
    date = dates.parse_date(F.col("CMPLNT_FR_DT"), dates.INCIDENT_DATE)
    return incidents.withColumns({"date": date, "yearpd": dates.year_of(date)})


def clean_incidents(incidents: DataFrame) -> DataFrame:
    """All cleaning, on any subset of the columns: a report reads only its own."""
    return add_dates(clean_text(incidents))


def clean_cells(incidents: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """Counts by the date text and other cleaned columns, then dated.

    For reports by year: rows combine on the text first, on the map side, and a
    date is parsed once per distinct day instead of once per row. Reports take
    the result with ``weight='count'``.
    """
    return add_dates(count_by(clean_text(incidents), "CMPLNT_FR_DT", *keys, weight=weight))


def incident_cells(clean: DataFrame, weight: str | None = None) -> DataFrame:
    """Counts by all columns the reports group by, for a batch of reports.

    One pass over the table gives a table of cells, and each report is then a
    small regrouping with ``weight='count'``.
    """
    return count_by(clean, *CELL_KEYS, weight=weight)


def crimes_trend(clean: DataFrame, weight: str | None = None) -> DataFrame:
    """Complaints per year with their least-squares line."""
    return linear_trend(count_by(clean, "yearpd", weight=weight), "yearpd").orderBy("yearpd")


def crimes_top(clean: DataFrame, n: int = TOP_OFFENSES, weight: str | None = None) -> DataFrame:
    counts = count_by(clean.filter(filled("OFNS_DESC")), "OFNS_DESC", weight=weight)
    return top_n(counts, "OFNS_DESC", n)


def crimes_severity(clean: DataFrame, weight: str | None = None) -> DataFrame:
    counts = count_by(clean.filter(filled("LAW_CAT_CD")), "yearpd", "LAW_CAT_CD", weight=weight)
    return counts.orderBy("yearpd", "LAW_CAT_CD")


def crimes_severity_wide(severity: DataFrame) -> DataFrame:
    """The severity report with one column per level."""
    return unstack(severity, "yearpd", "LAW_CAT_CD", OFFENSE_LEVELS)


def crimes_severity_by_district(clean: DataFrame, weight: str | None = None) -> DataFrame:
    kept = clean.filter(filled("BORO_NM") & not_missing_word("BORO_NM"))
    return count_by(kept, "yearpd", "BORO_NM", "LAW_CAT_CD", weight=weight)


def crimes_day_night(clean: DataFrame, weight: str | None = None) -> DataFrame:
    """Complaints by year, day or night, and severity.

    Only those whose hour can be read; an empty time has none.
    """
    kept = clean.filter(F.col("day_night").isNotNull())
    return count_by(kept, "yearpd", "day_night", "LAW_CAT_CD", weight=weight)


def day_totals(day_night: DataFrame) -> DataFrame:
    return regroup(day_night.filter(F.col("day_night") == 0), "yearpd").orderBy("yearpd")


def night_totals(day_night: DataFrame) -> DataFrame:
    return regroup(day_night.filter(F.col("day_night") == 1), "yearpd").orderBy("yearpd")


def crimes_race(clean: DataFrame, n: int = TOP_RACES, weight: str | None = None) -> DataFrame:
    return top_n(count_by(clean, "SUSP_RACE", weight=weight), "SUSP_RACE", n)


def crimes_districts_race(
    clean: DataFrame, districts: Sequence[str] = tuple(DISTRICTS), weight: str | None = None
) -> DataFrame:
    kept = clean.filter(
        filled("BORO_NM", "SUSP_RACE")
        & (F.col("SUSP_RACE") != UNKNOWN)
        & F.col("BORO_NM").isin(list(districts))
    )
    return count_by(kept, "BORO_NM", "SUSP_RACE", weight=weight)


def district_race_slice(districts_race: DataFrame, district: str) -> DataFrame:
    """Races of one district with their share."""
    one = slice_of(districts_race, "BORO_NM", district)
    return share_of_total(one).orderBy("SUSP_RACE")


def crimes_ages(clean: DataFrame, weight: str | None = None) -> DataFrame:
    counts = count_by(
        clean.filter(filled("SUSP_AGE_GROUP")), "SUSP_AGE_GROUP", weight=weight
    )
    return ranked(counts, "SUSP_AGE_GROUP")


def _crossable(clean: DataFrame, *columns: str) -> DataFrame:
    return clean.filter(filled(*columns))


def cross_districts(clean: DataFrame, weight: str | None = None) -> DataFrame:
    return crosstab(_crossable(clean, "BORO_NM", "OFNS_DESC"), "BORO_NM", "OFNS_DESC", weight)


def cross_districts_share(clean: DataFrame, weight: str | None = None) -> DataFrame:
    return crosstab_share(
        _crossable(clean, "BORO_NM", "OFNS_DESC"), "BORO_NM", "OFNS_DESC", weight
    )


def cross_districts_wide(
    clean: DataFrame, offenses: Sequence[str], weight: str | None = None
) -> DataFrame:
    """One column for each of the offences, and one for all others."""
    return crosstab_wide(
        _crossable(clean, "BORO_NM", "OFNS_DESC"), "BORO_NM", "OFNS_DESC", offenses, weight
    )


def district_crimes(clean: DataFrame) -> DataFrame:
    """The complaints that enter the district by offence table."""
    return _crossable(clean, "BORO_NM", "OFNS_DESC")


def cross_district_races(clean: DataFrame, weight: str | None = None) -> DataFrame:
    return crosstab(_crossable(clean, "BORO_NM", "SUSP_RACE"), "BORO_NM", "SUSP_RACE", weight)


def cross_district_races_share(clean: DataFrame, weight: str | None = None) -> DataFrame:
    return crosstab_share(
        _crossable(clean, "BORO_NM", "SUSP_RACE"), "BORO_NM", "SUSP_RACE", weight
    )


def cross_district_races_wide(
    clean: DataFrame, races: Sequence[str], weight: str | None = None
) -> DataFrame:
    """One column for each of the races, and one for all others."""
    return crosstab_wide(
        _crossable(clean, "BORO_NM", "SUSP_RACE"), "BORO_NM", "SUSP_RACE", races, weight
    )


def cross_age_race(
    clean: DataFrame, ages: Sequence[str] = tuple(AGE_BANDS), weight: str | None = None
) -> DataFrame:
    """One row per race, one column per age band."""
    kept = clean.filter(
        filled("SUSP_AGE_GROUP")
        & not_missing_word("SUSP_AGE_GROUP")
        & F.col("SUSP_AGE_GROUP").isin(list(ages))
    )
    wide = crosstab_wide(kept, "SUSP_RACE", "SUSP_AGE_GROUP", sorted(ages), weight)
    return wide.drop(REST)  # the report is of these bands alone


def cross_crime_race(
    clean: DataFrame, n: int = TOP_CROSSED_OFFENSES, weight: str | None = None
) -> DataFrame:
    """Race by offence for the most frequent offences, long form.

    Offences are ranked before cleaning, so empty text and the word ``false``
    can take places in the ranking and leave fewer than ``n`` offences. The
    table is read once: both the ranking and the result come from its cells.
    """
    return _crossed(clean, n, weight).select("SUSP_RACE", "OFNS_DESC", COUNT)


def _crossed(clean: DataFrame, n: int, weight: str | None) -> DataFrame:
    """``cross_crime_race`` with the place of each offence in the ranking."""
    cells = settled(count_by(clean, "SUSP_RACE", "OFNS_DESC", weight=weight))
    top = top_n(regroup(cells, "OFNS_DESC"), "OFNS_DESC", n)
    # A window over the n rows of the ranking.
    order = Window.orderBy(F.desc(COUNT), F.col("OFNS_DESC").asc_nulls_first())
    top = top.select("OFNS_DESC", F.row_number().over(order).alias("place"))
    named = cells.filter(filled("SUSP_RACE", "OFNS_DESC") & not_missing_word("OFNS_DESC"))
    return named.join(top, "OFNS_DESC")


def cross_crime_race_share(
    clean: DataFrame, n: int = TOP_CROSSED_OFFENSES, weight: str | None = None
) -> DataFrame:
    return share_within(cross_crime_race(clean, n, weight), "SUSP_RACE")


def cross_crime_race_wide(
    clean: DataFrame, n: int = TOP_CROSSED_OFFENSES, weight: str | None = None
) -> DataFrame:
    """One row per race; ``offense_<place>`` and ``count_<place>`` for each of the
    ``n`` places in the ranking. A race without the offence has NULL and 0."""
    place = F.col("place")
    columns = []
    for k in range(1, n + 1):
        columns.append(F.max(F.when(place == k, F.col("OFNS_DESC"))).alias(f"offense_{k}"))
        columns.append(F.sum(F.when(place == k, F.col(COUNT)).otherwise(0)).alias(f"count_{k}"))
    return _crossed(clean, n, weight).groupBy("SUSP_RACE").agg(*columns)


def cross_crime_race_wide_share(wide: DataFrame, n: int = TOP_CROSSED_OFFENSES) -> DataFrame:
    """The wide table with ``share_<place>`` of the row in place of the counts."""
    total = reduce(lambda a, b: a + b, [F.col(f"count_{k}") for k in range(1, n + 1)])
    columns = []
    for k in range(1, n + 1):
        share = F.try_divide(F.col(f"count_{k}"), total)
        columns += [F.col(f"offense_{k}"), share.alias(f"share_{k}")]
    return wide.select("SUSP_RACE", *columns)


# The columns each report of the batch groups by.
BATCH = {
    "crimes_trend": ("yearpd",),
    "crimes_top": ("OFNS_DESC",),
    "crimes_severity": ("yearpd", "LAW_CAT_CD"),
    "crimes_severity_by_district": ("yearpd", "BORO_NM", "LAW_CAT_CD"),
    "crimes_day_night": ("yearpd", "day_night", "LAW_CAT_CD"),
    "crimes_race": ("SUSP_RACE",),
    "cross_districts": ("BORO_NM", "OFNS_DESC"),
    "crimes_districts_race": ("BORO_NM", "SUSP_RACE"),
    "cross_age_race": ("SUSP_RACE", "SUSP_AGE_GROUP"),
    "cross_crime_race": ("SUSP_RACE", "OFNS_DESC"),
}


def _reported() -> Column:
    """Whether a report lists a group; each states what it leaves out."""
    age, district = F.col("SUSP_AGE_GROUP"), F.col("BORO_NM")
    rules = {
        "crimes_top": filled("OFNS_DESC"),
        "crimes_severity": filled("LAW_CAT_CD"),
        "crimes_severity_by_district": filled("BORO_NM") & not_missing_word("BORO_NM"),
        "crimes_day_night": F.col("day_night").isNotNull(),
        "cross_districts": filled("BORO_NM", "OFNS_DESC"),
        "crimes_districts_race": filled("SUSP_RACE")
        & (F.col("SUSP_RACE") != UNKNOWN)
        & district.isin(DISTRICTS),
        "cross_age_race": filled("SUSP_AGE_GROUP") & age.isin(AGE_BANDS),
        "cross_crime_race": filled("SUSP_RACE", "OFNS_DESC") & not_missing_word("OFNS_DESC"),
    }
    kept = F.lit(True)
    for report, rule in rules.items():
        kept = F.when(F.col("report") == report, F.coalesce(rule, F.lit(False))).otherwise(kept)
    return kept


def all_reports(cells: DataFrame) -> DataFrame:
    """The counts of all reports of the batch from one pass over the cells.

    ``report``, the columns of ``CELL_KEYS`` and ``count``: a report's rows have
    NULL in the columns it does not group by. One grouping by all reports' columns
    takes every cell to each report and combines there before the one shuffle.
    Rankings are cut to their size, and a race by offence table to the most
    frequent offences, on the grouped counts.
    """
    sets = [[F.col(c) for c in columns] for columns in BATCH.values()]
    grouped = cells.groupingSets(sets, *CELL_KEYS).agg(
        F.grouping_id(*CELL_KEYS).alias("_set"), F.sum(COUNT).alias(COUNT)
    )
    name = F.lit(None).cast("string")
    for report, columns in BATCH.items():
        # A bit is set where the column is not grouped by, the first column's highest.
        bits = sum((c not in columns) << i for i, c in enumerate(reversed(CELL_KEYS)))
        name = F.when(F.col("_set") == bits, report).otherwise(name)
    counts = settled(grouped.select(name.alias("report"), *CELL_KEYS, COUNT))
    ranking = {"crimes_top": TOP_OFFENSES, "crimes_race": TOP_RACES}
    kept = counts.filter(_reported())
    plain = kept.filter(~F.col("report").isin([*ranking, "cross_crime_race"]))
    parts = [plain]
    for report, n in ranking.items():
        parts.append(top_n(kept.filter(F.col("report") == report), BATCH[report][0], n))
    # Offences are ranked before any is left out, over races of any kind.
    crossed = counts.filter(F.col("report") == "cross_crime_race")
    top = top_n(regroup(crossed, "OFNS_DESC"), "OFNS_DESC", TOP_CROSSED_OFFENSES)
    crossed = kept.filter(F.col("report") == "cross_crime_race")
    parts.append(crossed.join(top.select("OFNS_DESC"), "OFNS_DESC", "left_semi"))
    return reduce(DataFrame.unionByName, parts)
