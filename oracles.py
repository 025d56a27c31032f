"""The catalogue's queries as SQL for DuckDB, written from the definitions of the
reports, each over whole tables. Keys are those of ``tallyward.catalog``.

Nothing here comes from the library: labels follow from the rules of the census
and word list that the definitions name.
"""

from __future__ import annotations

from itertools import combinations

# Race codes number the choices of one race, two, and so on, in this order.
_SINGLE_RACES = [
    "White", "Black or African American", "American Indian and Alaska Native", "Asian",
    "Native Hawaiian and Other Pacific Islander",
]
CENSUS_RACES = {
    code: " and ".join(races) if len(races) > 1 else f"{races[0]} alone"
    for code, races in enumerate(
        (r for n in range(1, 6) for r in combinations(_SINGLE_RACES, n)), start=1
    )
}
# Bands of five years, the last one open.
CENSUS_AGES = {k: f"{5 * k - 5}-{5 * k - 1}" for k in range(1, 18)} | {18: ">85"}

# The words a word count leaves out.
STOP_WORDS = """
a about above after again against all also am an and any are aren't as at be
because been before being below between both but by can can't cannot com could
couldn't did didn't do does doesn't doing don't down during each else ever few
for from further get had hadn't has hasn't have haven't having he he'd he'll
he's hence her here here's hers herself him himself his how how's however http i
i'd i'll i'm i've if in into is isn't it it's its itself just k let's like me
more most mustn't my myself no nor not of off on once only or other otherwise
ought our ours ourselves out over own r same shall shan't she she'd she'll she's
should shouldn't since so some such than that that's the their theirs them
themselves then there there's therefore these they they'd they'll they're
they've this those through to too under until up very was wasn't we we'd we'll
we're we've were weren't what what's when when's where where's which while who
who's whom why why's with won't would wouldn't www you you'd you'll you're
you've your yours yourself yourselves
""".split()


def _case(column: str, table: dict) -> str:
    arms = " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items())
    return f"CASE {column} {arms} END"


INCIDENTS = """
incidents AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS _id,
    o_orderdate,
    strftime(o_orderdate, '%m/%d/%Y') AS CMPLNT_FR_DT,
    CASE WHEN l_partkey % 50 = 0 THEN ''
      ELSE lpad(CAST(l_partkey % 24 AS VARCHAR), 2, '0') || ':00:00' END AS CMPLNT_FR_TM,
    CAST(l_suppkey AS INTEGER) AS ADDR_PCT_CD,
    CAST(100 + p_size AS INTEGER) AS KY_CD,
    CASE WHEN l_partkey % 41 = 0 THEN '' WHEN l_partkey % 43 = 0 THEN 'false'
      ELSE upper(p_name) END AS OFNS_DESC,
    CASE l_linestatus WHEN 'O' THEN 'ATTEMPTED' WHEN 'F' THEN 'COMPLETED' END
      AS CRM_ATPT_CPTD_CD,
    CASE WHEN l_suppkey % 29 = 0 THEN '' WHEN l_returnflag = 'R' THEN 'FELONY'
      WHEN l_returnflag = 'A' THEN 'MISDEMEANOR' WHEN l_returnflag = 'N' THEN 'VIOLATION'
      END AS LAW_CAT_CD,
    CASE WHEN c_custkey % 31 = 0 THEN '' WHEN c_custkey % 31 = 1 THEN 'false'
      WHEN r_name = 'AFRICA' THEN 'BRONX' WHEN r_name = 'AMERICA' THEN 'BROOKLYN'
      WHEN r_name = 'ASIA' THEN 'MANHATTAN' WHEN r_name = 'EUROPE' THEN 'QUEENS'
      WHEN r_name = 'MIDDLE EAST' THEN 'STATEN ISLAND' END AS BORO_NM,
    40.5e0 + (l_suppkey % 400) / 1000e0 AS Latitude,
    -74.2e0 + (l_suppkey % 500) / 1000e0 AS Longitude,
    CASE WHEN l_quantity < 10 THEN '<18' WHEN l_quantity < 20 THEN '18-24'
      WHEN l_quantity < 30 THEN '25-44' WHEN l_quantity < 40 THEN '45-64'
      WHEN l_quantity < 48 THEN '65+' WHEN l_quantity < 49 THEN ''
      WHEN l_quantity < 50 THEN 'false' ELSE '1020' END AS SUSP_AGE_GROUP,
    CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 37 = 0 THEN NULL
      WHEN c_mktsegment = 'AUTOMOBILE' THEN 'BLACK'
      WHEN c_mktsegment = 'BUILDING' THEN 'WHITE'
      WHEN c_mktsegment = 'FURNITURE' THEN 'WHITE HISPANIC'
      WHEN c_mktsegment = 'HOUSEHOLD' THEN 'BLACK HISPANIC'
      WHEN c_mktsegment = 'MACHINERY' THEN 'ASIAN / PACIFIC ISLANDER' END AS SUSP_RACE,
    CASE WHEN l_linenumber % 3 = 0 THEN 'FEMALE' ELSE 'MALE' END AS SUSP_SEX
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""

# The raw columns, then the cleaned ones, of the complaints.
CLEAN = (
    INCIDENTS
    + """, clean AS (
  SELECT * EXCLUDE (o_orderdate) REPLACE (
      CASE WHEN SUSP_AGE_GROUP = '' THEN 'UNKNOWN' ELSE SUSP_AGE_GROUP END AS SUSP_AGE_GROUP,
      CASE WHEN SUSP_RACE = '' THEN 'UNKNOWN' ELSE SUSP_RACE END AS SUSP_RACE),
    CAST(strftime(o_orderdate, '%Y-%m-%d') AS VARCHAR) AS date,
    CAST(year(o_orderdate) AS INTEGER) AS yearpd,
    CASE WHEN CMPLNT_FR_TM = '' THEN NULL
      WHEN CAST(substr(CMPLNT_FR_TM, 1, 2) AS INTEGER) BETWEEN 6 AND 18 THEN 0
      ELSE 1 END AS day_night
  FROM incidents)"""
)

# The cleaned complaints that the filter keeps, for the batch of reports.
STUDY_CLEAN = CLEAN.replace(
    "FROM incidents)",
    "FROM incidents WHERE year(o_orderdate) BETWEEN 1996 AND 2000 AND SUSP_RACE <> '')",
)

STUDY = (
    INCIDENTS
    + """, study AS (
  SELECT * EXCLUDE (o_orderdate) FROM incidents
  WHERE regexp_matches(CMPLNT_FR_DT, '1996|1997|1998|1999|2000')
    AND CMPLNT_FR_DT <> '' AND SUSP_RACE <> '')"""
)

SHOOTINGS = """
shootings AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
    strftime(o_orderdate, '%Y-%m-%d') AS date,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'gun' WHEN '2-HIGH' THEN 'toy weapon'
      WHEN '3-MEDIUM' THEN 'unarmed' WHEN '5-LOW' THEN '' END AS armed,
    CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE CAST(o_orderkey % 80 + 6 AS VARCHAR) END AS age,
    CASE WHEN c_custkey % 43 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'O'
      WHEN c_mktsegment = 'AUTOMOBILE' THEN 'B' WHEN c_mktsegment = 'BUILDING' THEN 'W'
      WHEN c_mktsegment = 'FURNITURE' THEN 'H' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'A'
      WHEN c_mktsegment = 'MACHINERY' THEN 'N' END AS race,
    'S' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS state,
    CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 11 < 7 THEN 'Not fleeing'
      WHEN o_orderkey % 11 < 9 THEN 'Car' ELSE 'Foot' END AS flee,
    CAST(year(o_orderdate) AS INTEGER) AS year,
    CAST(month(o_orderdate) AS INTEGER) AS month
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey), victims AS (
  SELECT *, month AS month_num, CASE race WHEN 'W' THEN 'White' WHEN 'B' THEN 'Black'
    WHEN 'N' THEN 'Native American' WHEN 'H' THEN 'Hispanic' WHEN 'A' THEN 'Asian'
    WHEN 'O' THEN 'Others' END AS race_name
  FROM shootings), months AS (
  SELECT substr(date, 1, 7) AS date, count(*) AS "count" FROM victims GROUP BY 1),
race_months AS (
  SELECT year, month_num, race_name, count(*) AS "count",
    CAST(year AS VARCHAR) || '-' || CAST(month_num AS VARCHAR) AS monthly
  FROM victims GROUP BY year, month_num, race_name), armed_counts AS (
  SELECT race_name, CASE WHEN armed = 'unarmed' THEN 'unarmed' ELSE 'armed' END AS armed,
    count(*) AS "count"
  FROM victims WHERE armed IS NOT NULL AND race_name IS NOT NULL GROUP BY 1, 2), ages AS (
  SELECT race, CAST(age AS INTEGER) AS age FROM victims WHERE length(age) > 0)"""

DEATHS = """
deaths AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS _id, 'Officer ' || o_orderkey AS person,
    'Dept ' || c_nationkey AS dept,
    CASE WHEN o_orderkey % 13 = 0 THEN ''
      ELSE upper(substr(o_orderpriority, 3)) || ' ' || o_orderstatus END AS cause_short,
    strftime(o_orderdate, '%Y-%m-%d') AS date,
    CAST(year(o_orderdate) AS INTEGER) AS year,
    CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS canine,
    trim(CASE WHEN o_orderkey % 17 = 0 THEN ' '
      ELSE ' S' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END) AS state
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE year(o_orderdate) > 1995 AND year(o_orderdate) < 2001)"""

CENSUS = f"""
raw_census AS (
  SELECT CAST(c_custkey AS VARCHAR) AS _id,
    CASE WHEN c_custkey % 10 = 0 THEN 'Wyoming' ELSE 'New York' END AS STNAME,
    CASE WHEN c_custkey % 7 = 0 THEN 'Albany County' WHEN r_name = 'AFRICA' THEN 'Bronx County'
      WHEN r_name = 'AMERICA' THEN 'Kings County' WHEN r_name = 'ASIA' THEN 'New York County'
      WHEN r_name = 'EUROPE' THEN 'Queens County'
      WHEN r_name = 'MIDDLE EAST' THEN 'Richmond County' END AS CTYNAME,
    CAST(c_custkey % 2 + 1 AS INTEGER) AS SEX,
    CAST(floor(c_custkey / 2) % 2 + 1 AS INTEGER) AS ORIGIN,
    CAST(c_custkey % 18 + 1 AS INTEGER) AS AGEGRP,
    CAST(c_custkey % 31 + 1 AS INTEGER) AS IMPRACE,
    CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE CAST(floor(abs(c_acctbal)) AS BIGINT) END AS RESPOP
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey), census AS (
  SELECT _id, STNAME, CTYNAME, CASE WHEN SEX = 1 THEN 'M' ELSE 'F' END AS SEX,
    ORIGIN = 2 AS ORIGIN, {_case("AGEGRP", CENSUS_AGES)} AS AGEGRP,
    {_case("IMPRACE", CENSUS_RACES)} || CASE WHEN ORIGIN = 2 THEN ' Hispanic' ELSE '' END
      AS IMPRACE, RESPOP
  FROM raw_census WHERE lower(STNAME) LIKE '%new york%' AND RESPOP <> 0
    AND IMPRACE IS NOT NULL), groups AS (
  SELECT * REPLACE (CASE
    WHEN IMPRACE LIKE 'American%' THEN 'AMERICAN INDIAN/ALASKAN NATIVE'
    WHEN IMPRACE LIKE 'Asian%' OR IMPRACE LIKE 'Native%' THEN 'ASIAN / PACIFIC ISLANDER'
    WHEN IMPRACE LIKE 'Black%Hispanic' THEN 'BLACK HISPANIC'
    WHEN IMPRACE LIKE 'Black%' THEN 'BLACK'
    WHEN IMPRACE LIKE 'White%Hispanic' THEN 'WHITE HISPANIC'
    WHEN IMPRACE LIKE 'White%' THEN 'WHITE' END AS IMPRACE)
  FROM census), boroughs AS (
  SELECT CASE CTYNAME WHEN 'New York County' THEN 'MANHATTAN'
      WHEN 'Kings County' THEN 'BROOKLYN' WHEN 'Queens County' THEN 'QUEENS'
      WHEN 'Bronx County' THEN 'BRONX' WHEN 'Richmond County' THEN 'STATEN ISLAND'
      END AS CTYNAME,
    IMPRACE, CAST(sum(RESPOP) AS BIGINT) AS "sum(RESPOP)"
  FROM groups WHERE CTYNAME IN ('New York County', 'Kings County', 'Queens County',
    'Bronx County', 'Richmond County')
  GROUP BY 1, 2)"""

POLLS = """
polls AS (
  SELECT 'S' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS State_short,
    CASE WHEN 30 + n_nationkey * 7 % 40 > 30 + n_nationkey * 11 % 40 THEN 1 ELSE 0 END
      AS Winner
  FROM nation)"""

DISTRICTS_RACE = """, districts_race AS (
  SELECT BORO_NM, SUSP_RACE, count(*) AS "count" FROM clean
  WHERE BORO_NM IN ('QUEENS', 'BROOKLYN', 'BRONX', 'STATEN ISLAND', 'MANHATTAN')
    AND length(SUSP_RACE) > 0 AND SUSP_RACE <> 'UNKNOWN' GROUP BY 1, 2)"""

SEVERITY = """, severity AS (
  SELECT yearpd, LAW_CAT_CD, count(*) AS "count" FROM clean
  WHERE length(LAW_CAT_CD) > 0 GROUP BY 1, 2)"""

DAY_NIGHT = """, dn AS (
  SELECT yearpd, day_night, LAW_CAT_CD, count(*) AS "count" FROM clean
  WHERE day_night IS NOT NULL GROUP BY 1, 2, 3)"""

DISTRICT_OFFENSE = """, cells AS (
  SELECT BORO_NM, OFNS_DESC, count(*) AS "count" FROM clean
  WHERE length(BORO_NM) > 0 AND length(OFNS_DESC) > 0 GROUP BY 1, 2)"""

DISTRICT_RACE = """, cells AS (
  SELECT BORO_NM, SUSP_RACE, count(*) AS "count" FROM clean
  WHERE length(BORO_NM) > 0 AND length(SUSP_RACE) > 0 GROUP BY 1, 2)"""

CRIME_RACE = """, top AS (
  SELECT OFNS_DESC, row_number() OVER (ORDER BY count(*) DESC, OFNS_DESC NULLS FIRST) AS place
  FROM clean GROUP BY 1 QUALIFY place <= 5),
cells AS (
  SELECT SUSP_RACE, OFNS_DESC, count(*) AS "count" FROM clean
  WHERE OFNS_DESC IN (SELECT OFNS_DESC FROM top) AND length(SUSP_RACE) > 0
    AND length(OFNS_DESC) > 0 AND OFNS_DESC <> 'false' GROUP BY 1, 2)"""

AGE_BANDS = ["18-24", "25-44", "45-64", "65+", "<18"]
RACES = ["ASIAN / PACIFIC ISLANDER", "BLACK", "BLACK HISPANIC", "WHITE", "WHITE HISPANIC"]
# Offences with a column of their own.
OFFENSES = [
    f"{size} ROD" for size in ["BLUE", "COLD", "HOT", "LARGE", "NEW", "OLD", "RED", "SMALL"]
]


def _columns(
    column: str, labels, value: str = "count(CASE WHEN {} THEN 1 END)", rest: bool = False
) -> str:
    """A column for each label and, with ``rest``, one for all others."""
    tests = {label: f"{column} = '{label}'" for label in labels}
    if rest:
        listed = ", ".join(f"'{label}'" for label in labels)
        tests["other labels"] = f"{column} IS NULL OR {column} NOT IN ({listed})"
    return ", ".join(f'{value.format(test)} AS "{label}"' for label, test in tests.items())


_PART = "count(CASE WHEN {} THEN 1 END) / CAST(count(*) AS DOUBLE)"


def _ranked(value: str, name: str) -> str:
    """Offences and values by their place in the ranking."""
    return ", ".join(
        f"max(CASE WHEN place = {k} THEN OFNS_DESC END) AS offense_{k}, "
        f"{value.format(k)} AS {name}_{k}"
        for k in range(1, 6)
    )


def _trend(period: str) -> str:
    return f""", fit AS (
  SELECT regr_slope("count", {period}) AS slope, regr_intercept("count", {period}) AS intercept
  FROM yearly)
SELECT {period}, "count", round(slope, 6) AS slope, round(intercept, 6) AS intercept,
  round(intercept + slope * {period}, 6) AS trend
FROM yearly, fit"""


def _growth(period: str, source: str, name: str = "ratio") -> str:
    return f"""SELECT * FROM (
  SELECT {period}, round("count" / CAST(lag("count") OVER (ORDER BY {period}) AS DOUBLE) - 1, 12)
    AS {name} FROM {source}) WHERE {name} IS NOT NULL"""


ID_ORDER = "_id, SUSP_AGE_GROUP, LAW_CAT_CD, CRM_ATPT_CPTD_CD"


def _like(column: str, pattern: str) -> str:
    return (
        f"WITH {STUDY} SELECT * FROM study WHERE regexp_matches({column}, '(?i){pattern}') "
        f"ORDER BY {ID_ORDER} LIMIT 10"
    )


def _armed(label: str) -> str:
    return (
        f'WITH {SHOOTINGS} SELECT race_name, armed, "count", '
        f'"count" / CAST(sum("count") OVER () AS DOUBLE) AS share '
        f"FROM armed_counts WHERE armed = '{label}'"
    )


def _histogram(start: str) -> str:
    return f"""WITH {SHOOTINGS}, bins AS (
  SELECT CAST(floor((age - {start}) / 5) * 5 + {start} AS BIGINT) AS bin, count(*) AS "count"
  FROM ages GROUP BY 1)
SELECT bin, "count", round("count" / (sum("count") OVER () * 5.0e0), 9) AS density FROM bins"""


def _box(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}min("count") AS low, max("count") AS high,
  round(avg("count"), 6) AS mean, round(stddev_pop("count"), 6) AS sd,
  round(quantile_cont("count", 0.25), 6) AS q1, round(quantile_cont("count", 0.5), 6) AS median,
  round(quantile_cont("count", 0.75), 6) AS q3
FROM {source} {f"WHERE {by} IS NOT NULL GROUP BY {by}" if by else ""}"""


def _words(source: str, column: str) -> str:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
    return f"""labels_ AS (SELECT DISTINCT {column} AS label FROM {source}
  WHERE {column} IS NOT NULL), words AS (
  SELECT regexp_replace(w, '''s$', '') AS word FROM (
    SELECT unnest(regexp_extract_all(lower(label), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_'']+')) AS w
    FROM labels_))
SELECT word, count(*) AS "count" FROM words
WHERE NOT regexp_full_match(word, '\\p{{N}}+') AND word NOT IN ({stop}) GROUP BY word"""


def _pairs(source: str, column: str) -> str:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)

    def side(k: str, n: str, share: str) -> str:
        return (
            f"({k}) * ln(greatest({share}, 1e-10))"
            f" + (({n}) - ({k})) * ln(greatest(1 - ({share}), 1e-10))"
        )

    return f"""labels_ AS (SELECT row_number() OVER () AS r, label FROM (
  SELECT DISTINCT {column} AS label FROM {source} WHERE {column} IS NOT NULL)), listed AS (
  SELECT r, list_filter(list_transform(
      regexp_extract_all(lower(label), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_'']+'),
      lambda w: regexp_replace(w, '''s$', '')),
    lambda w: NOT regexp_full_match(w, '\\p{{N}}+')) AS w FROM labels_), placed AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM listed), words AS (
  SELECT word, count(*) AS n FROM placed WHERE word NOT IN ({stop}) GROUP BY 1), forms AS (
  SELECT a.word, coalesce(b.word, a.word) AS standard, a.n FROM words AS a LEFT JOIN words AS b
  ON a.word LIKE '%s' AND NOT a.word LIKE '%ss' AND b.word = left(a.word, length(a.word) - 1)),
singles AS (SELECT standard, sum(n) AS n FROM forms GROUP BY 1), twos AS (
  SELECT a.word || ' ' || b.word AS pair, count(*) AS n FROM placed AS a JOIN placed AS b
  ON a.r = b.r AND b.at = a.at + 1
  WHERE a.word NOT IN ({stop}) AND b.word NOT IN ({stop}) GROUP BY 1), together AS (
  SELECT coalesce(b.pair, a.pair) AS pair, sum(a.n) AS together FROM twos AS a LEFT JOIN twos AS b
  ON a.pair LIKE '%s' AND NOT a.pair LIKE '%ss' AND b.pair = left(a.pair, length(a.pair) - 1)
  GROUP BY 1), counted AS (
  SELECT pair, f1.standard AS first, f2.standard AS second, together, s1.n AS c1, s2.n AS c2,
    (SELECT CAST(sum(n) AS DOUBLE) FROM singles) AS t
  FROM together JOIN forms AS f1 ON f1.word = split_part(pair, ' ', 1)
  JOIN forms AS f2 ON f2.word = split_part(pair, ' ', 2)
  JOIN singles AS s1 ON s1.standard = f1.standard
  JOIN singles AS s2 ON s2.standard = f2.standard), terms AS (
  SELECT * FROM counted WHERE t > c1 AND t > c2 AND 2 * (
    {side("together", "c1", "together / c1")}
    + {side("c2 - together", "t - c1", "(c2 - together) / (t - c1)")}
    - ({side("together", "c1", "c2 / t")}) - ({side("c2 - together", "t - c1", "c2 / t")})) > 30),
changes AS (SELECT pair AS word, together AS n FROM terms UNION ALL
  SELECT first, -together FROM terms UNION ALL SELECT second, -together FROM terms UNION ALL
  SELECT standard, n FROM singles)
SELECT word, CAST(sum(n) AS BIGINT) AS "count" FROM changes GROUP BY 1 HAVING sum(n) > 0"""


def _binned_density(value: str, source: str, scale: int) -> str:
    return f"""WITH shape AS (
  SELECT count(*) AS n, min({value}) AS low, (max({value}) - min({value})) / 500e0 AS step,
    stddev_samp({value}) * pow(count(*), -0.2) AS h FROM {source}), shared AS (
  SELECT least(floor(({value} - low) / step), 499) AS below, count(*) AS r,
    sum(({value} - low) / step - least(floor(({value} - low) / step), 499)) AS over
  FROM {source}, shape GROUP BY 1), bins AS (
  SELECT bin, sum(mass) AS mass FROM (SELECT below AS bin, r - over AS mass FROM shared
    UNION ALL SELECT below + 1, over FROM shared) GROUP BY 1)
SELECT CAST(place AS INTEGER) AS place, round(any_value(low + place * step), 6) AS x,
  round(sum(mass * exp(-0.5 * pow((place - bin) * step / h, 2)))
    / (any_value(n) * any_value(h) * sqrt(2 * pi())) * {scale}, 6) AS density
FROM bins, shape, range(500) AS t(place) GROUP BY place"""


def _growth_compared(cohort: str) -> str:
    return f"""WITH {DEATHS}, {SHOOTINGS},
d AS (SELECT year, count(*) AS "count" FROM deaths GROUP BY year),
s AS (SELECT year, count(*) AS "count" FROM victims {cohort} GROUP BY year),
dg AS ({_growth("year", "d", "deaths_ratio")}), sg AS ({_growth("year", "s", "shootings_ratio")})
SELECT coalesce(dg.year, sg.year) AS year, deaths_ratio, shootings_ratio
FROM dg FULL JOIN sg ON dg.year = sg.year"""


_RECORD = (
    "CMPLNT_FR_DT AS date, CMPLNT_FR_TM AS time, ADDR_PCT_CD AS precinct, "
    "KY_CD AS offense_code, OFNS_DESC AS offense_description, "
    "CRM_ATPT_CPTD_CD AS crime_outcome, LAW_CAT_CD AS level_offense, BORO_NM AS borough, "
    "Latitude AS latitude, Longitude AS longitude, SUSP_AGE_GROUP AS age, "
    "SUSP_RACE AS race, SUSP_SEX AS sex"
)

_POPULATION = """, population AS (
  SELECT coalesce(IMPRACE, 'None') AS key, CAST(sum(RESPOP) AS BIGINT) AS value
  FROM groups GROUP BY 1)"""
_CRIMES = """, crimes AS (
  SELECT SUSP_RACE AS key, count(*) AS value FROM study GROUP BY 1)"""

_INCIDENCE = f"""WITH {CLEAN}{DISTRICTS_RACE}, {CENSUS}, x AS (
  SELECT BORO_NM, SUSP_RACE,
    round_even("count" / CAST(sum("count") OVER (PARTITION BY BORO_NM) AS DOUBLE), 2) AS ratio_x
  FROM districts_race), y AS (
  SELECT CTYNAME, IMPRACE, round_even("sum(RESPOP)"
    / CAST(sum("sum(RESPOP)") OVER (PARTITION BY CTYNAME) AS DOUBLE), 2) AS ratio_y
  FROM boroughs), incidence AS (
  SELECT BORO_NM, SUSP_RACE, ratio_x, ratio_y, ratio_x * ratio_y AS incidence
  FROM x LEFT JOIN y ON BORO_NM = CTYNAME AND SUSP_RACE = IMPRACE)"""

_SHARES = f"""WITH {CLEAN}{SEVERITY}, shares AS (
  SELECT yearpd,
    CAST(sum(CASE WHEN LAW_CAT_CD = 'FELONY' THEN "count" ELSE 0 END) AS BIGINT) AS severe,
    CAST(sum("count") AS BIGINT) AS total FROM severity GROUP BY 1)"""

_SHARE = '"count" / CAST(sum("count") OVER (PARTITION BY {}) AS DOUBLE) AS share'


_CATEGORIES = [
    "armed", "city", "manner_of_death", "flee", "gender", "state", "threat_level", "body_camera",
    "signs_of_mental_illness",
]
CLASSIFIED = f"""
whole AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'gun' WHEN '2-HIGH' THEN 'toy weapon'
      WHEN '3-MEDIUM' THEN 'unarmed' WHEN '5-LOW' THEN '' END AS armed,
    n_name AS city,
    CASE WHEN o_orderstatus = 'F' THEN 'shot and Tasered' ELSE 'shot' END AS manner_of_death,
    CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 11 < 7 THEN 'Not fleeing'
      WHEN o_orderkey % 11 < 9 THEN 'Car' ELSE 'Foot' END AS flee,
    CASE WHEN o_orderkey % 20 = 0 THEN 'F' ELSE 'M' END AS gender,
    'S' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS state,
    CASE WHEN o_totalprice > 250000 THEN 'attack' ELSE 'other' END AS threat_level,
    CASE WHEN o_orderkey % 7 = 0 THEN 'True' ELSE 'False' END AS body_camera,
    CASE WHEN o_orderkey % 9 = 0 THEN 'True' ELSE 'False' END AS signs_of_mental_illness,
    CASE WHEN c_custkey % 43 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'O'
      WHEN c_mktsegment = 'AUTOMOBILE' THEN 'B' WHEN c_mktsegment = 'BUILDING' THEN 'W'
      WHEN c_mktsegment = 'FURNITURE' THEN 'H' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'A'
      WHEN c_mktsegment = 'MACHINERY' THEN 'N' END AS race
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey), classified AS (
  SELECT *, CASE WHEN race = 'W' THEN 1 ELSE 0 END AS label,
    CASE WHEN CAST('0x' || substr(md5('42:' || id), 1, 8) AS BIGINT) % 10000 < 8000
      THEN 'train' ELSE 'test' END AS split
  FROM whole WHERE {" AND ".join(f"length({c}) > 0" for c in [*_CATEGORIES, "race"])}),
numbered AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate(_CATEGORIES))})
  AS t("column", place))"""
INDEXED = f""", long AS ({" UNION ALL ".join(
    f"SELECT id, split, '{c}' AS \"column\", {c} AS value FROM classified" for c in _CATEGORIES)}),
indexed AS (
  SELECT "column", value, CAST(row_number() OVER (
    PARTITION BY "column" ORDER BY count(*) DESC, value) - 1 AS INTEGER) AS index
  FROM long WHERE split = 'train' GROUP BY 1, 2)"""


_BATCH = """, top_offenses AS (
  SELECT OFNS_DESC, count(*) AS "count" FROM clean GROUP BY 1
  ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 5)
SELECT * FROM (SELECT 'crimes_trend' AS report, yearpd, CAST(NULL AS INTEGER) AS day_night,
    CAST(NULL AS VARCHAR) AS LAW_CAT_CD, CAST(NULL AS VARCHAR) AS BORO_NM,
    CAST(NULL AS VARCHAR) AS OFNS_DESC, CAST(NULL AS VARCHAR) AS SUSP_AGE_GROUP,
    CAST(NULL AS VARCHAR) AS SUSP_RACE, count(*) AS "count" FROM clean GROUP BY yearpd)
UNION ALL BY NAME SELECT * FROM (SELECT 'crimes_top' AS report, OFNS_DESC, count(*) AS "count"
  FROM clean WHERE length(OFNS_DESC) > 0 GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)
UNION ALL BY NAME SELECT 'crimes_severity' AS report, yearpd, LAW_CAT_CD, count(*) AS "count"
  FROM clean WHERE length(LAW_CAT_CD) > 0 GROUP BY 2, 3
UNION ALL BY NAME SELECT 'crimes_severity_by_district' AS report, yearpd, BORO_NM, LAW_CAT_CD,
  count(*) AS "count" FROM clean WHERE length(BORO_NM) > 0 AND BORO_NM <> 'false' GROUP BY 2, 3, 4
UNION ALL BY NAME SELECT 'crimes_day_night' AS report, yearpd, day_night, LAW_CAT_CD,
  count(*) AS "count" FROM clean WHERE day_night IS NOT NULL GROUP BY 2, 3, 4
UNION ALL BY NAME SELECT * FROM (SELECT 'crimes_race' AS report, SUSP_RACE, count(*) AS "count"
  FROM clean GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 8)
UNION ALL BY NAME SELECT 'cross_districts' AS report, BORO_NM, OFNS_DESC, count(*) AS "count"
  FROM clean WHERE length(BORO_NM) > 0 AND length(OFNS_DESC) > 0 GROUP BY 2, 3
UNION ALL BY NAME SELECT 'crimes_districts_race' AS report, BORO_NM, SUSP_RACE,
  count(*) AS "count" FROM clean
  WHERE BORO_NM IN ('QUEENS', 'BROOKLYN', 'BRONX', 'STATEN ISLAND', 'MANHATTAN')
    AND SUSP_RACE <> 'UNKNOWN' GROUP BY 2, 3
UNION ALL BY NAME SELECT 'cross_age_race' AS report, SUSP_RACE, SUSP_AGE_GROUP,
  count(*) AS "count" FROM clean
  WHERE SUSP_AGE_GROUP IN ('<18', '18-24', '25-44', '45-64', '65+') GROUP BY 2, 3
UNION ALL BY NAME SELECT 'cross_crime_race' AS report, SUSP_RACE, OFNS_DESC, count(*) AS "count"
  FROM clean WHERE OFNS_DESC IN (SELECT OFNS_DESC FROM top_offenses)
    AND length(OFNS_DESC) > 0 AND OFNS_DESC <> 'false' GROUP BY 2, 3"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "incident_filter": f"WITH {STUDY} SELECT * FROM study",
        "incident_text_filter": f"WITH {STUDY} SELECT * FROM study",
        "incident_year_filter": f"WITH {STUDY} SELECT * FROM study",
        "record_rename": f"WITH {STUDY} SELECT _id AS id, {_RECORD} FROM study",
        "record_restore": f"WITH {STUDY} SELECT * EXCLUDE (_id) FROM study",
        "incidents_clean": f"""WITH {CLEAN}
SELECT * FROM clean""",
        "incident_cells": f"""WITH {CLEAN} SELECT yearpd, day_night, LAW_CAT_CD, BORO_NM,
  OFNS_DESC, SUSP_AGE_GROUP, SUSP_RACE, count(*) AS "count" FROM clean GROUP BY ALL""",
        "shootings_clean": f"""WITH {SHOOTINGS} SELECT id, date, race, age, state, armed, flee,
  year, month, month_num, race_name FROM victims""",
        "deaths_clean": f"WITH {DEATHS} SELECT * FROM deaths",
        "census_filter_recode": f"WITH {CENSUS} SELECT * FROM census",
        "census_clean": f"WITH {CENSUS} SELECT * FROM groups",
        "crimes_trend": f"""WITH {CLEAN}, yearly AS (
  SELECT yearpd, count(*) AS "count" FROM clean GROUP BY 1){_trend("yearpd")}""",
        "crimes_top": f"""WITH {CLEAN} SELECT OFNS_DESC, count(*) AS "count" FROM clean
WHERE length(OFNS_DESC) > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
        "crimes_severity": f"WITH {CLEAN}{SEVERITY} SELECT * FROM severity",
        "crimes_severity_wide": f"""WITH {CLEAN}{SEVERITY} SELECT yearpd, {_columns(
            "LAW_CAT_CD", ["FELONY", "MISDEMEANOR", "VIOLATION"],
            'CAST(sum(CASE WHEN {} THEN "count" END) AS BIGINT)', True)}
FROM severity GROUP BY 1""",
        "crimes_severity_by_district": f"""WITH {CLEAN}
SELECT yearpd, BORO_NM, LAW_CAT_CD, count(*) AS "count" FROM clean
WHERE length(BORO_NM) > 0 AND BORO_NM <> 'false' GROUP BY 1, 2, 3""",
        "crimes_day_night": f"WITH {CLEAN}{DAY_NIGHT} SELECT * FROM dn",
        "crimes_race": f"""WITH {CLEAN} SELECT SUSP_RACE, count(*) AS "count" FROM clean
GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 8""",
        "crimes_districts_race": f"WITH {CLEAN}{DISTRICTS_RACE} SELECT * FROM districts_race",
        "district_race_slice": f"""WITH {CLEAN}{DISTRICTS_RACE} SELECT SUSP_RACE, "count",
  {_SHARE.format("BORO_NM")} FROM districts_race WHERE BORO_NM = 'BRONX'""",
        "crimes_ages": f"""WITH {CLEAN} SELECT SUSP_AGE_GROUP, count(*) AS "count" FROM clean
WHERE length(SUSP_AGE_GROUP) > 0 GROUP BY 1""",
        "cross_districts": f"WITH {CLEAN}{DISTRICT_OFFENSE} SELECT * FROM cells",
        "cross_districts_share": f"""WITH {CLEAN}{DISTRICT_OFFENSE}
SELECT *, {_SHARE.format("BORO_NM")} FROM cells""",
        "cross_districts_wide": f"""WITH {CLEAN}
SELECT BORO_NM, {_columns("OFNS_DESC", OFFENSES, rest=True)}
FROM clean WHERE length(BORO_NM) > 0 AND length(OFNS_DESC) > 0 GROUP BY 1""",
        "cross_districts_wide_share": f"""WITH {CLEAN}
SELECT BORO_NM, {_columns("OFNS_DESC", OFFENSES, _PART, True)}
FROM clean WHERE length(BORO_NM) > 0 AND length(OFNS_DESC) > 0 GROUP BY 1""",
        "district_crimes": f"""WITH {CLEAN} SELECT *
FROM clean WHERE length(BORO_NM) > 0 AND length(OFNS_DESC) > 0""",
        "cross_district_races": f"WITH {CLEAN}{DISTRICT_RACE} SELECT * FROM cells",
        "cross_district_races_share": f"""WITH {CLEAN}{DISTRICT_RACE}
SELECT *, {_SHARE.format("BORO_NM")} FROM cells""",
        "cross_district_races_wide": f"""WITH {CLEAN}
SELECT BORO_NM, {_columns("SUSP_RACE", RACES, rest=True)}
FROM clean WHERE length(BORO_NM) > 0 AND length(SUSP_RACE) > 0 GROUP BY 1""",
        "cross_district_races_wide_share": f"""WITH {CLEAN}
SELECT BORO_NM, {_columns("SUSP_RACE", RACES, _PART, True)}
FROM clean WHERE length(BORO_NM) > 0 AND length(SUSP_RACE) > 0 GROUP BY 1""",
        "cross_age_race": f"""WITH {CLEAN}
SELECT SUSP_RACE, {_columns("SUSP_AGE_GROUP", AGE_BANDS)} FROM clean
WHERE SUSP_AGE_GROUP IN ('<18', '18-24', '25-44', '45-64', '65+') AND SUSP_RACE IS NOT NULL
GROUP BY 1""",
        "cross_age_race_share": f"""WITH {CLEAN} SELECT SUSP_RACE, {_columns(
            "SUSP_AGE_GROUP", AGE_BANDS,
            "count(CASE WHEN {} THEN 1 END) / CAST(count(*) AS DOUBLE)")} FROM clean
WHERE SUSP_AGE_GROUP IN ('<18', '18-24', '25-44', '45-64', '65+') AND SUSP_RACE IS NOT NULL
GROUP BY 1""",
        "cross_crime_race": f"WITH {CLEAN}{CRIME_RACE} SELECT * FROM cells",
        "cross_crime_race_share": f"""WITH {CLEAN}{CRIME_RACE}
SELECT *, {_SHARE.format("SUSP_RACE")} FROM cells""",
        "cross_crime_race_wide": f"""WITH {CLEAN}{CRIME_RACE} SELECT SUSP_RACE, {_ranked(
            'CAST(sum(CASE WHEN place = {} THEN "count" ELSE 0 END) AS BIGINT)', "count")}
FROM cells JOIN top USING (OFNS_DESC) GROUP BY 1""",
        "cross_crime_race_wide_share": f"""WITH {CLEAN}{CRIME_RACE} SELECT SUSP_RACE, {_ranked(
            'sum(CASE WHEN place = {} THEN "count" ELSE 0 END) / CAST(sum("count") AS DOUBLE)',
            "share")}
FROM cells JOIN top USING (OFNS_DESC) GROUP BY 1""",
        "lookup_regex_borough": _like("BORO_NM", "bro"),
        "lookup_regex_race": _like("SUSP_RACE", "black"),
        "lookup_regex_sex": _like("SUSP_SEX", "male"),
        "lookup_regex_age": _like("SUSP_AGE_GROUP", "^1"),
        "lookup_eq_sex": f"""WITH {INCIDENTS} SELECT _id, LAW_CAT_CD, SUSP_SEX FROM incidents
WHERE SUSP_SEX = 'FEMALE'""",
        "lookup_eq_age": f"""WITH {INCIDENTS} SELECT _id, LAW_CAT_CD, SUSP_AGE_GROUP
FROM incidents WHERE SUSP_AGE_GROUP = '<18'""",
        "lookup_eq_offence": f"""WITH {INCIDENTS} SELECT _id, KY_CD, OFNS_DESC FROM incidents
WHERE KY_CD = 110""",
        "lookup_id": f"""WITH {INCIDENTS} SELECT * EXCLUDE (o_orderdate) FROM incidents
WHERE _id IN ('0-3-170-3', '0-1-511-66', '0-3-3230-532', '0-0-0-0')
QUALIFY row_number() OVER (PARTITION BY _id ORDER BY {ID_ORDER}) = 1""",
        "incident_preview": f"WITH {STUDY} SELECT * FROM study ORDER BY {ID_ORDER} LIMIT 20",
        "incident_filter_limit": f"""WITH {STUDY} SELECT * FROM study
ORDER BY _id, SUSP_AGE_GROUP, SUSP_RACE, LAW_CAT_CD, CRM_ATPT_CPTD_CD LIMIT 50""",
        "shoot_monthly": f"WITH {SHOOTINGS} SELECT * FROM months",
        "shoot_month_by_year": f"""WITH {SHOOTINGS}
SELECT *, substr(date, 1, 4) AS year FROM months""",
        "shoot_month_slice": f"""WITH {SHOOTINGS}
SELECT * FROM months WHERE date LIKE '1998-%'""",
        "shoot_yearly": f"""WITH {SHOOTINGS}
SELECT year, count(*) AS "count" FROM victims GROUP BY 1""",
        "shoot_race_month": f"WITH {SHOOTINGS} SELECT * FROM race_months",
        "shoot_race_month_slice": f"""WITH {SHOOTINGS}
SELECT * EXCLUDE (race_name) FROM race_months WHERE race_name = 'Hispanic'""",
        "shoot_state": f"""WITH {SHOOTINGS}
SELECT state, count(*) AS "count" FROM victims GROUP BY 1""",
        "shoot_flee": f"""WITH {SHOOTINGS} SELECT flee, count(*) AS "count",
  count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM victims GROUP BY 1""",
        "shoot_armed": _armed("armed"),
        "shoot_unarmed": _armed("unarmed"),
        "black_state": f"""WITH {SHOOTINGS} SELECT state, count(*) AS "count" FROM victims
WHERE race = 'B' GROUP BY 1""",
        "black_year": f"""WITH {SHOOTINGS} SELECT year, count(*) AS "count" FROM victims
WHERE race = 'B' GROUP BY 1""",
        "race_age_extract": f"WITH {SHOOTINGS} SELECT race, age FROM victims",
        "all_year": f"""WITH {SHOOTINGS}
SELECT year, count(*) AS "count" FROM victims GROUP BY 1""",
        "all_state": f"""WITH {SHOOTINGS}
SELECT state, count(*) AS "count" FROM victims GROUP BY 1""",
        "all_race": f"""WITH {SHOOTINGS} SELECT race_name, count(*) AS "count",
  count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM victims
WHERE race_name <> 'Others' GROUP BY 1""",
        "black_state_measure": f"""WITH {SHOOTINGS}
SELECT state, CAST(count(*) AS DOUBLE) AS z FROM victims WHERE race = 'B' GROUP BY 1""",
        "all_state_measure": f"""WITH {SHOOTINGS}
SELECT state, CAST(count(*) AS DOUBLE) AS z FROM victims GROUP BY 1""",
        "age_histogram": _histogram("0"),
        "age_histogram_from_smallest": _histogram("(SELECT min(age) FROM ages)"),
        "age_density": f"""WITH {SHOOTINGS}, shape AS (
  SELECT count(*) AS n, min(age) AS low, max(age) AS high,
    stddev_samp(age) * pow(count(*), -0.2) AS h FROM ages),
tally AS (SELECT age, count(*) AS c FROM ages GROUP BY age),
grid AS (
  SELECT CAST(place AS INTEGER) AS place, low + place * (high - low) / 500e0 AS x, n, h
  FROM shape, range(500) AS t(place))
SELECT place, round(x, 6) AS x,
  round(sum(c * exp(-0.5 * pow((x - age) / h, 2))) / (any_value(n) * any_value(h)
    * sqrt(2 * pi())), 6) AS density
FROM grid, tally GROUP BY place, x""",
        "black_age_histogram": f"""WITH {SHOOTINGS}
SELECT CAST(floor(age / 10) * 10 AS BIGINT) AS bin, count(*) AS "count" FROM ages
WHERE race = 'B' GROUP BY 1""",
        "monthly_box": f"WITH {SHOOTINGS} {_box('months')}",
        "race_box": f"WITH {SHOOTINGS} {_box('race_months', 'race_name')}",
        "weapon_labels": f"""WITH {SHOOTINGS}
SELECT DISTINCT armed FROM victims WHERE armed IS NOT NULL""",
        "price_density": _binned_density("o_totalprice", "orders", 1_000_000),
        "weapon_pairs": f"WITH {SHOOTINGS}, {_pairs('victims', 'armed')}",
        "part_pairs": f"WITH {_pairs('part', 'p_name')}",
        "weapon_words": f"WITH {SHOOTINGS}, {_words('victims', 'armed')}",
        "part_words": f"WITH {_words('part', 'p_name')}",
        "deaths_trend": f"""WITH {DEATHS}, yearly AS (
  SELECT year, count(*) AS "count" FROM deaths GROUP BY 1){_trend("year")}""",
        "deaths_cause_top": f"""WITH {DEATHS} SELECT cause_short, count(*) AS "count"
FROM deaths WHERE length(cause_short) > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
        "deaths_state_top": f"""WITH {DEATHS} SELECT state, count(*) AS "count"
FROM deaths WHERE length(state) > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
        "race_by_borough": f"WITH {CENSUS} SELECT * FROM boroughs",
        "borough_slice": f"""WITH {CENSUS} SELECT IMPRACE, "sum(RESPOP)",
  "sum(RESPOP)" / CAST(sum("sum(RESPOP)") OVER () AS DOUBLE) AS share
FROM boroughs WHERE CTYNAME = 'QUEENS'""",
        "polls_winner": f"WITH {POLLS} SELECT * FROM polls",
        "polls_measure": f"""WITH {POLLS}
SELECT State_short, CAST(Winner AS DOUBLE) AS z FROM polls""",
        "mr_population_by_race": f"WITH {CENSUS}{_POPULATION} SELECT * FROM population",
        "mr_text_files": f"""WITH {CENSUS}, population AS (
  SELECT coalesce(IMPRACE, 'None') AS key, CAST(sum(RESPOP) AS BIGINT) AS value
  FROM groups WHERE CAST(_id AS BIGINT) % 101 <> 0 GROUP BY 1)
SELECT * FROM population WHERE key <> 'AMERICAN INDIAN/ALASKAN NATIVE'""",
        "mr_crimes_by_race": f"WITH {STUDY}{_CRIMES} SELECT * FROM crimes",
        "mr_crime_text": f"""WITH {STUDY}
SELECT SUSP_RACE AS key, count(*) AS value FROM study WHERE ADDR_PCT_CD % 97 <> 0 GROUP BY 1""",
        "mr_rejected_lines": f"""WITH {STUDY}, {CENSUS}, faults AS (
  SELECT 'census' AS file, 'header' AS reason UNION ALL SELECT 'crimes', 'header'
  UNION ALL SELECT 'crimes', 'short' FROM study WHERE ADDR_PCT_CD % 97 = 0
  UNION ALL SELECT 'census', CASE WHEN CAST(_id AS BIGINT) % 101 = 0 THEN 'short'
    ELSE 'unreadable' END FROM census
  WHERE CAST(_id AS BIGINT) % 101 = 0
    OR (CAST(_id AS BIGINT) % 62 = 2 AND IMPRACE LIKE 'American%'))
SELECT file, reason, count(*) AS lines FROM faults GROUP BY 1, 2""",
        "mr_crime_rate": f"""WITH {STUDY}, {CENSUS}{_POPULATION}{_CRIMES}
SELECT key, population.value AS population, crimes.value AS crimes,
  round(crimes.value / CAST(population.value AS DOUBLE) * 100, 9) AS rate
FROM population JOIN crimes USING (key)""",
        "locus": """SELECT CASE WHEN event_type = 'view' THEN 'INSIDE' ELSE 'OUTSIDE' END AS locus,
  count(*) AS "count" FROM events GROUP BY 1""",
        "metric_yoy_crimes": f"""WITH {CLEAN}, yearly AS (
  SELECT yearpd, count(*) AS "count" FROM clean GROUP BY 1) {_growth("yearpd", "yearly")}""",
        "metric_armed_ratio": f"""WITH {SHOOTINGS}, t AS (
  SELECT race_name, sum(CASE WHEN armed = 'armed' THEN "count" END) AS a,
    sum(CASE WHEN armed = 'unarmed' THEN "count" END) AS u,
    CAST(sum("count") AS DOUBLE) AS n FROM armed_counts GROUP BY 1)
SELECT round((b.a / b.n) / (w.a / w.n), 12) AS armed_ratio,
  round((b.u / b.n) / (w.u / w.n), 12) AS unarmed_ratio
FROM t AS b, t AS w WHERE b.race_name = 'Black' AND w.race_name = 'White'""",
        "metric_felony_share": f"""{_SHARES}
SELECT *, round(severe / CAST(total AS DOUBLE), 12) AS ratio FROM shares""",
        "metric_felony_share_var": f"""{_SHARES}
SELECT round(var_samp(severe / CAST(total AS DOUBLE)), 12) AS variance FROM shares""",
        "metric_incidence": f"""{_INCIDENCE} SELECT BORO_NM, SUSP_RACE,
  round(ratio_x, 6) AS ratio_x, round(ratio_y, 6) AS ratio_y, round(incidence, 6) AS incidence
FROM incidence""",
        "metric_incidence_wide": f"""{_INCIDENCE} SELECT BORO_NM, {_columns(
            "SUSP_RACE", RACES, "round(avg(CASE WHEN {} THEN incidence END), 6)", True)}
FROM incidence GROUP BY 1""",
        "metric_yoy_deaths_vs_shootings": _growth_compared(""),
        "metric_yoy_deaths_vs_black_shootings": _growth_compared("WHERE race = 'B'"),
        "table_append_again": f"WITH {CENSUS} SELECT * FROM census",
        "table_append": f"WITH {CENSUS} SELECT * FROM census",
        "census_filter_limit": f"""WITH {CENSUS} SELECT * FROM raw_census
WHERE lower(STNAME) LIKE '%new york%' AND RESPOP <> 0 AND IMPRACE IS NOT NULL
ORDER BY _id LIMIT 50""",
        "csv_untrimmed": """SELECT CASE WHEN o_orderkey % 17 = 0 THEN ' '
    ELSE ' S' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS state, count(*) AS "count"
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
        "table_append_districts": f"""WITH {CLEAN}
SELECT BORO_NM, LAW_CAT_CD, count(*) AS "count" FROM clean GROUP BY 1, 2""",
        "classifier_rows": f"WITH {CLASSIFIED} SELECT id, race, label, split FROM classified",
        "classifier_index": f"WITH {CLASSIFIED}{INDEXED} SELECT * FROM indexed",
        "classifier_features": f"""WITH {CLASSIFIED}{INDEXED}, first AS (
  SELECT "column", CAST(sum(n + 1) OVER (ORDER BY place) - n - 1 AS INTEGER) AS start, n FROM (
    SELECT "column", count(*) AS n, any_value(place) AS place FROM indexed JOIN numbered USING ("column")
    GROUP BY 1))
SELECT id, CAST(start + coalesce("index", n) AS INTEGER) AS slot
FROM long JOIN first USING ("column") LEFT JOIN indexed USING ("column", value)""",
        "classifier_confusion": f"""WITH {CLASSIFIED}, told AS (
  SELECT split, CASE WHEN threat_level = 'attack' THEN 1 ELSE 0 END AS label FROM classified)
SELECT split, label, label AS prediction, count(*) AS rows FROM told GROUP BY 1, 2""",
        "classifier_accuracy": f"""WITH {CLASSIFIED}
SELECT split, count(*) AS rows, 1e0 AS accuracy, 0e0 AS error FROM classified GROUP BY 1""",
        "classifier_split": f"""WITH {CLASSIFIED}
SELECT split, count(*) AS rows FROM classified GROUP BY 1""",
        "batch_reports": f"WITH {STUDY_CLEAN}{_BATCH}",
        "batch_reports_written": f"WITH {STUDY_CLEAN}{SEVERITY} SELECT * FROM severity",
        "batch_trend": f"""WITH {STUDY_CLEAN}, yearly AS (
  SELECT yearpd, count(*) AS "count" FROM clean GROUP BY 1){_trend("yearpd")}""",
        "batch_severity": f"WITH {STUDY_CLEAN}{SEVERITY} SELECT * FROM severity",
        "batch_day_night": f"WITH {STUDY_CLEAN}{DAY_NIGHT} SELECT * FROM dn",
        "batch_districts_race": f"WITH {STUDY_CLEAN}{DISTRICTS_RACE} SELECT * FROM districts_race",
        "batch_age_race": f"""WITH {STUDY_CLEAN}
SELECT SUSP_RACE, {_columns("SUSP_AGE_GROUP", AGE_BANDS)} FROM clean
WHERE SUSP_AGE_GROUP IN ('<18', '18-24', '25-44', '45-64', '65+') AND SUSP_RACE IS NOT NULL
GROUP BY 1""",
        "batch_crime_race": f"WITH {STUDY_CLEAN}{CRIME_RACE} SELECT * FROM cells",
    }
    for name, flag in (("crimes_day_totals", 0), ("crimes_night_totals", 1)):
        sql[name] = f"""WITH {CLEAN}{DAY_NIGHT}
SELECT yearpd, CAST(sum("count") AS BIGINT) AS "count" FROM dn
WHERE day_night = {flag} GROUP BY 1"""
    sql["csv_roundtrip"] = sql["crimes_severity_by_district"]
    return sql
