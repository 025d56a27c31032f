"""The five domain tables as views over the star-schema test tables.

Each view takes the columns it should hold and joins only the tables these come
from. Every join is a lookup by a unique key (one order, customer, part per
row) and keeps all rows of the left side, so the rows of a view do not depend
on the columns asked for.

No side is marked for broadcast. Spark broadcasts a lookup side when its size
is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides
otherwise; adaptive execution then splits a partition that one hot key fills.
Customer attributes are joined onto orders first, so line items, the largest
table, move only once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions.dates import INCIDENT_DATE, ISO_DATE, year_between
from tallyward.operators.counting import COUNT, count_by, regroup
from tallyward.operators.lookup import Fetched, fetched, find_equal, find_one, with_keys
from tallyward.sources.schemas import (
    CENSUS,
    INCIDENT_NAMES,
    POLICE_DEATHS,
    SHOOTINGS,
)
from tallyward.sources.tables import read_table

# How the columns of each view come from the test tables, as SQL.
# The name of a dictionary says which table its expressions are worked out on.
_CUSTOMER_OF_INCIDENT = {
    "BORO_NM": """CASE WHEN c_custkey % 31 = 0 THEN '' WHEN c_custkey % 31 = 1 THEN 'false'
        WHEN r_name = 'AFRICA' THEN 'BRONX' WHEN r_name = 'AMERICA' THEN 'BROOKLYN'
        WHEN r_name = 'ASIA' THEN 'MANHATTAN' WHEN r_name = 'EUROPE' THEN 'QUEENS'
        WHEN r_name = 'MIDDLE EAST' THEN 'STATEN ISLAND' END""",
    "SUSP_RACE": """CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 37 = 0 THEN NULL
        WHEN c_mktsegment = 'AUTOMOBILE' THEN 'BLACK'
        WHEN c_mktsegment = 'BUILDING' THEN 'WHITE'
        WHEN c_mktsegment = 'FURNITURE' THEN 'WHITE HISPANIC'
        WHEN c_mktsegment = 'HOUSEHOLD' THEN 'BLACK HISPANIC'
        WHEN c_mktsegment = 'MACHINERY' THEN 'ASIAN / PACIFIC ISLANDER' END""",
}
_ORDER_OF_INCIDENT = {"CMPLNT_FR_DT": f"date_format(o_orderdate, '{INCIDENT_DATE}')"}
_PART_OF_INCIDENT = {
    "KY_CD": "100 + p_size",
    "OFNS_DESC": """CASE WHEN p_partkey % 41 = 0 THEN '' WHEN p_partkey % 43 = 0 THEN 'false'
        ELSE upper(p_name) END""",
}
_LINE_OF_INCIDENT = {
    "_id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)",
    "CMPLNT_FR_TM": """CASE WHEN l_partkey % 50 = 0 THEN ''
        ELSE lpad(string(l_partkey % 24), 2, '0') || ':00:00' END""",
    "ADDR_PCT_CD": "int(l_suppkey)",
    "CRM_ATPT_CPTD_CD": """CASE l_linestatus WHEN 'O' THEN 'ATTEMPTED'
        WHEN 'F' THEN 'COMPLETED' END""",
    "LAW_CAT_CD": """CASE WHEN l_suppkey % 29 = 0 THEN '' WHEN l_returnflag = 'R' THEN 'FELONY'
        WHEN l_returnflag = 'A' THEN 'MISDEMEANOR'
        WHEN l_returnflag = 'N' THEN 'VIOLATION' END""",
    "Latitude": "40.5D + (l_suppkey % 400) / 1000D",
    "Longitude": "-74.2D + (l_suppkey % 500) / 1000D",
    "SUSP_AGE_GROUP": """CASE WHEN l_quantity < 10 THEN '<18' WHEN l_quantity < 20 THEN '18-24'
        WHEN l_quantity < 30 THEN '25-44' WHEN l_quantity < 40 THEN '45-64'
        WHEN l_quantity < 48 THEN '65+' WHEN l_quantity < 49 THEN ''
        WHEN l_quantity < 50 THEN 'false' ELSE '1020' END""",
    "SUSP_SEX": "CASE WHEN l_linenumber % 3 = 0 THEN 'FEMALE' ELSE 'MALE' END",
}
_CUSTOMER_OF_CENSUS = {
    "_id": "string(c_custkey)",
    "STNAME": "CASE WHEN c_custkey % 10 = 0 THEN 'Wyoming' ELSE 'New York' END",
    "CTYNAME": """CASE WHEN c_custkey % 7 = 0 THEN 'Albany County'
        WHEN r_name = 'AFRICA' THEN 'Bronx County' WHEN r_name = 'AMERICA' THEN 'Kings County'
        WHEN r_name = 'ASIA' THEN 'New York County' WHEN r_name = 'EUROPE' THEN 'Queens County'
        WHEN r_name = 'MIDDLE EAST' THEN 'Richmond County' END""",
    "SEX": "int(c_custkey % 2 + 1)",
    "ORIGIN": "int(floor(c_custkey / 2) % 2 + 1)",
    "AGEGRP": "int(c_custkey % 18 + 1)",
    "IMPRACE": "int(c_custkey % 31 + 1)",
    "RESPOP": """CASE WHEN c_custkey % 13 = 0 THEN 0L
        ELSE bigint(floor(abs(c_acctbal))) END""",
}
_ORDER_OF_SHOOTING = {
    "id": "string(o_orderkey)",
    "date": f"date_format(o_orderdate, '{ISO_DATE}')",
    "manner_of_death": "CASE WHEN o_orderstatus = 'F' THEN 'shot and Tasered' ELSE 'shot' END",
    "armed": """CASE o_orderpriority WHEN '1-URGENT' THEN 'gun' WHEN '2-HIGH' THEN 'toy weapon'
        WHEN '3-MEDIUM' THEN 'unarmed' WHEN '5-LOW' THEN '' END""",
    "age": "CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE string(o_orderkey % 80 + 6) END",
    "race": """CASE WHEN c_custkey % 43 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'O'
        WHEN c_mktsegment = 'AUTOMOBILE' THEN 'B' WHEN c_mktsegment = 'BUILDING' THEN 'W'
        WHEN c_mktsegment = 'FURNITURE' THEN 'H' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'A'
        WHEN c_mktsegment = 'MACHINERY' THEN 'N' END""",
    "gender": "CASE WHEN o_orderkey % 20 = 0 THEN 'F' ELSE 'M' END",
    "city": "n_name",
    "state": "'S' || lpad(string(n_nationkey), 2, '0')",
    "signs_of_mental_illness": "CASE WHEN o_orderkey % 9 = 0 THEN 'True' ELSE 'False' END",
    "threat_level": "CASE WHEN o_totalprice > 250000 THEN 'attack' ELSE 'other' END",
    "flee": """CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 11 < 7 THEN 'Not fleeing'
        WHEN o_orderkey % 11 < 9 THEN 'Car' ELSE 'Foot' END""",
    "body_camera": "CASE WHEN o_orderkey % 7 = 0 THEN 'True' ELSE 'False' END",
}
_ORDER_OF_DEATH = {
    "_id": "string(o_orderkey)",
    "person": "'Officer ' || o_orderkey",
    "dept": "'Dept ' || c_nationkey",
    "cause_short": """CASE WHEN o_orderkey % 13 = 0 THEN ''
        ELSE upper(substr(o_orderpriority, 3)) || ' ' || o_orderstatus END""",
    "date": f"date_format(o_orderdate, '{ISO_DATE}')",
    "year": "year(o_orderdate)",
    "canine": "CASE WHEN o_orderkey % 50 = 0 THEN 'TRUE' ELSE 'FALSE' END",
    "state": """CASE WHEN o_orderkey % 17 = 0 THEN ' '
        ELSE ' S' || lpad(string(c_nationkey), 2, '0') END""",
}
_NATION_OF_POLL = {
    "State": "n_name",
    "State_short": "'S' || lpad(string(n_nationkey), 2, '0')",
    "RepPercentage": "double(30 + n_nationkey * 7 % 40)",
    "DemPercentage": "double(30 + n_nationkey * 11 % 40)",
}

# Schemas of the test tables. Naming them spares a job per table
# that would only find them out.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet", TABLES[name])


def _select(
    df: DataFrame, made: dict[str, str], columns: Sequence[str], *keys: str
) -> DataFrame:
    """The asked-for columns, made here or already made on a joined table."""
    return df.selectExpr(*keys, *[f"{made.get(c, c)} AS {c}" for c in columns])


def _customer_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the name of their region (25 nations, 5 regions)."""
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
    customer = table(spark, folder, "customer")
    return customer.join(places, customer.c_nationkey == places.n_nationkey, "left")


def _orders(spark: SparkSession, folder: str, years: tuple[int, int] | None) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.filter(year_between(F.col("o_orderdate"), *years)) if years else orders


def _order_lookup(
    spark: SparkSession, folder: str, columns: Sequence[str], years: tuple[int, int] | None
) -> DataFrame:
    """Orders with the asked-for columns of themselves and of their customer."""
    of_order = [c for c in columns if c in _ORDER_OF_INCIDENT]
    of_customer = [c for c in columns if c in _CUSTOMER_OF_INCIDENT]
    orders = _select(
        _orders(spark, folder, years), _ORDER_OF_INCIDENT, of_order, "o_orderkey", "o_custkey"
    )
    if not of_customer:
        return orders
    customer = (
        _customer_regions(spark, folder)
        if "BORO_NM" in of_customer
        else table(spark, folder, "customer")
    )
    customer = _select(customer, _CUSTOMER_OF_INCIDENT, of_customer, "c_custkey")
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "left")


def _with_order(
    spark: SparkSession,
    folder: str,
    lines: DataFrame,
    columns: Sequence[str],
    years: tuple[int, int] | None,
) -> DataFrame:
    orders = _order_lookup(spark, folder, columns, years)
    how = "inner" if years else "left"
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey, how)


def _with_part(
    spark: SparkSession, folder: str, lines: DataFrame, columns: Sequence[str]
) -> DataFrame:
    part = _select(table(spark, folder, "part"), _PART_OF_INCIDENT, columns, "p_partkey")
    return lines.join(part, lines.l_partkey == part.p_partkey, "left")


def _of_order(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in _ORDER_OF_INCIDENT or c in _CUSTOMER_OF_INCIDENT]


def _of_part(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in _PART_OF_INCIDENT]


def _look_up(
    spark: SparkSession,
    folder: str,
    lines: DataFrame,
    columns: Sequence[str],
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """Line items with what they take from elsewhere."""
    if _of_order(columns) or years:
        lines = _with_order(spark, folder, lines, columns, years)
    if _of_part(columns):
        lines = _with_part(spark, folder, lines, _of_part(columns))
    return lines


def incidents(
    spark: SparkSession,
    folder: str,
    columns: Sequence[str] = tuple(INCIDENT_NAMES),
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """One crime complaint per line item; ``years`` prunes the order scan.

    Each column is worked out on the table it comes from, before that table is
    joined: once per customer, part or order rather than once per line item.
    """
    lines = _look_up(spark, folder, table(spark, folder, "lineitem"), columns, years)
    return _select(lines, _LINE_OF_INCIDENT, columns)


def incident_counts(
    spark: SparkSession,
    folder: str,
    columns: Sequence[str],
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """Complaints as rows with a ``count``, for reports that only count them.

    Line items combine on the columns of their own and the keys they are joined
    by, before the first join; after it, orders give way to the columns taken
    from them, and rows combine again before parts are joined. So no join meets a
    hot order or part as more than a handful of rows, and what the second shuffle
    carries does not grow with the orders.
    """
    own = [c for c in columns if c in _LINE_OF_INCIDENT]
    of_order, of_part = _of_order(columns), _of_part(columns)
    order_key = ["l_orderkey"] if of_order or years else []
    part_key = ["l_partkey"] if of_part else []
    lines = _select(
        table(spark, folder, "lineitem"), _LINE_OF_INCIDENT, own, *order_key, *part_key
    )
    counts = count_by(lines, *order_key, *part_key, *own)
    if order_key:
        counts = _with_order(spark, folder, counts, columns, years)
        if part_key:
            counts = regroup(counts, *of_order, *own, *part_key)
    if part_key:
        counts = _with_part(spark, folder, counts, of_part)
    return counts.select(*columns, COUNT)


def keyed_incidents(
    spark: SparkSession, folder: str, columns: Sequence[str], years: tuple[int, int]
) -> DataFrame:
    """Line items as they are, with only the complaint columns that a search
    needs: ``complete_incidents`` adds the others to what it finds."""
    lines = table(spark, folder, "lineitem")
    names = lines.columns
    found = _look_up(spark, folder, lines, columns, years)
    return _select(found, _LINE_OF_INCIDENT, columns, *names)


def complete_incidents(spark: SparkSession, folder: str, lines: Fetched) -> DataFrame:
    """All complaint columns of a few line items.

    Orders, customers and parts are read by the keys of the step before: those of
    the lines, then those of their orders.
    """
    names = table(spark, folder, "lineitem").columns
    by_key = with_keys(table(spark, folder, "orders"), "o_orderkey", lines.keys("l_orderkey"))
    order_columns = _select(
        by_key, _ORDER_OF_INCIDENT, list(_ORDER_OF_INCIDENT), "o_orderkey", "o_custkey"
    )
    orders = fetched(order_columns, len(lines.keys("l_orderkey")))
    customer = with_keys(
        _customer_regions(spark, folder), "c_custkey", orders.keys("o_custkey")
    )
    customer = _select(customer, _CUSTOMER_OF_INCIDENT, list(_CUSTOMER_OF_INCIDENT), "c_custkey")
    part = with_keys(table(spark, folder, "part"), "p_partkey", lines.keys("l_partkey"))
    part = _select(part, _PART_OF_INCIDENT, list(_PART_OF_INCIDENT), "p_partkey")
    few, few_orders = lines.frame(spark).select(*names), orders.frame(spark)
    found = (
        few.join(few_orders, few.l_orderkey == few_orders.o_orderkey, "left")
        .join(customer, few_orders.o_custkey == customer.c_custkey, "left")
        .join(part, few.l_partkey == part.p_partkey, "left")
    )
    return _select(found, _LINE_OF_INCIDENT, tuple(INCIDENT_NAMES))


def incident_by_id(spark: SparkSession, folder: str, own_id: str, *order: str) -> DataFrame:
    """The line item of a complaint's id, or no row; of several the first in
    order. The keys in the id reach the scan; an id of another form finds nothing."""
    lines = table(spark, folder, "lineitem")
    names = lines.columns
    made = _select(lines, _LINE_OF_INCIDENT, ["_id", *[c for c in order if c != "_id"]], *names)
    parts = own_id.split("-")
    if len(parts) != 4 or not all(p.isascii() and p.isdigit() for p in parts):
        return made.select(*names).limit(0)
    for column, key in zip(("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), parts):
        made = find_equal(made, column, int(key))
    return find_one(made, "_id", own_id, *order, *names).select(*names)


def census(
    spark: SparkSession, folder: str, columns: Sequence[str] = tuple(CENSUS.names)
) -> DataFrame:
    """One raw census row per customer."""
    df = (
        _customer_regions(spark, folder)
        if "CTYNAME" in columns
        else table(spark, folder, "customer")
    )
    return _select(df, _CUSTOMER_OF_CENSUS, columns)


def shootings(
    spark: SparkSession, folder: str, columns: Sequence[str] = tuple(SHOOTINGS.names)
) -> DataFrame:
    """One fatal shooting per order."""
    wanted = set(columns)
    df = _orders(spark, folder, None)
    if wanted & {"race", "city", "state"}:
        customer = table(spark, folder, "customer")
        if wanted & {"city", "state"}:
            nation = table(spark, folder, "nation")
            customer = customer.join(
                nation, customer.c_nationkey == nation.n_nationkey, "left"
            )
        df = df.join(customer, df.o_custkey == customer.c_custkey, "left")
    return _select(df, _ORDER_OF_SHOOTING, columns)


def police_deaths(
    spark: SparkSession,
    folder: str,
    columns: Sequence[str] = tuple(POLICE_DEATHS.names),
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """One police death per order; ``years`` prunes the order scan."""
    df = _orders(spark, folder, years)
    if {"dept", "state"} & set(columns):
        customer = table(spark, folder, "customer")
        df = df.join(customer, df.o_custkey == customer.c_custkey, "left")
    return _select(df, _ORDER_OF_DEATH, columns)


def polls(spark: SparkSession, folder: str) -> DataFrame:
    """One state per nation."""
    return _select(table(spark, folder, "nation"), _NATION_OF_POLL, list(_NATION_OF_POLL))
