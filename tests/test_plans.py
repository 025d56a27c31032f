"""Physical plans: what must not occur, what must be pushed down and shared."""

import re

import pytest

from tallyward import catalog
from tallyward.operators.counting import count_by
from tallyward.sources import adapters

DATA = "/root/testdata/sf0.001"
EAGER = {
    name
    for name in catalog.queries()
    if name.startswith(
        ("batch_", "csv_", "table_append", "mr_", "classifier_", "race_classifier", "incident_year")
    )
}


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("+- == Initial Plan ==")[0] if "Subquery" not in plan else plan


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - EAGER))
def test_no_python_and_no_nested_loops(spark, name):
    plan = initial_plan(catalog.queries()[name](spark, DATA))
    for bad in ("EvalPython", "MapInPandas", "CartesianProduct", "NestedLoopJoin", "Scan ExistingRDD"):
        assert bad not in plan


@pytest.mark.parametrize("name", ["crimes_top", "crimes_race", "lookup_regex_sex", "incident_preview"])
def test_top_rows_are_taken_not_sorted_whole(spark, name):
    plan = initial_plan(catalog.queries()[name](spark, DATA))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_scans_read_only_their_columns(spark):
    plan = initial_plan(catalog.crimes_ages(spark, DATA))
    assert re.findall(r"ReadSchema: (\S+)", plan) == ["struct<l_quantity:double>"]
    plan = initial_plan(catalog.crimes_race(spark, DATA))
    assert "nation.parquet" not in plan and "part.parquet" not in plan
    assert "struct<l_orderkey:bigint>" in plan


def test_year_range_reaches_the_scan(spark):
    for name in ("incident_filter", "deaths_cause_top"):
        plan = initial_plan(catalog.queries()[name](spark, DATA))
        assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(o_orderdate", plan)


def test_shares_group_the_table_once(spark):
    plan = final_plan(catalog.cross_districts_share(spark, DATA))
    assert "ReusedExchange" in plan
    assert plan.count("lineitem.parquet") == 1


def test_ranking_and_crosstab_share_one_scan(spark):
    plan = final_plan(catalog.cross_crime_race(spark, DATA))
    assert "ReusedExchange" in plan
    assert plan.count("lineitem.parquet") == 1


def test_counts_combine_before_the_shuffle(spark):
    plan = initial_plan(catalog.crimes_severity_by_district(spark, DATA))
    assert "partial_count" in plan


def test_dates_are_parsed_after_grouping(spark):
    """The first grouping is by the text; the year comes out of its result."""
    plan = re.sub(r"#\d+L?", "", initial_plan(catalog.crimes_trend(spark, DATA)))
    grouped = plan.index("HashAggregate(keys=[CMPLNT_FR_DT], functions=[partial_sum(count)]")
    assert "gettimestamp" not in plan[grouped:]


@pytest.fixture()
def no_broadcast(spark):
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_results_hold_without_broadcast(spark, no_broadcast, request):
    """Tables too large to broadcast: shuffled joins, still no nested loops."""
    for name in (
        "cross_districts_share", "cross_crime_race", "metric_incidence", "crimes_trend",
        "district_race_slice", "mr_crime_rate", "age_density",
    ):
        df = catalog.queries()[name](spark, DATA)
        got = sorted(map(repr, df.collect()))
        plan = initial_plan(df)
        assert "BroadcastHashJoin" not in plan and "NestedLoopJoin" not in plan
        for key in ("spark.sql.autoBroadcastJoinThreshold",):
            spark.conf.set(key, "10MB")
        assert sorted(map(repr, catalog.queries()[name](spark, DATA).collect())) == got
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def test_a_hot_customer_is_split(spark, no_broadcast, tmp_path):
    """Half of all orders belong to one customer; adaptive execution splits them."""
    for name in ("region", "nation", "customer", "part"):
        adapters.table(spark, DATA, name).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.sql(
        "SELECT id AS o_orderkey, CASE WHEN id % 2 = 0 THEN 1L ELSE id % 150 END AS o_custkey, "
        "'F' AS o_orderstatus, 1D AS o_totalprice, timestamp_ntz'1999-01-01 00:00:00' AS o_orderdate, "
        "'1-URGENT' AS o_orderpriority FROM range(0, 40000, 1, 8)"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql(
        "SELECT id % 40000 AS l_orderkey, 7L AS l_partkey, 1L AS l_suppkey, 1 AS l_linenumber, "
        "1D AS l_quantity, 1D AS l_extendedprice, 0D AS l_discount, 0D AS l_tax, 'R' AS l_returnflag, "
        "'F' AS l_linestatus, timestamp_ntz'1999-01-01 00:00:00' AS l_shipdate FROM range(0, 80000, 1, 8)"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = adapters.incidents(spark, str(tmp_path), ["BORO_NM"])
    report = count_by(rows, "BORO_NM")
    counts = {r.BORO_NM: r["count"] for r in report.collect()}
    assert sum(counts.values()) == 80000
    assert "skew=true" in report._jdf.queryExecution().executedPlan().toString()
    counted = adapters.incident_counts(spark, str(tmp_path), ["BORO_NM"])
    report = count_by(counted, "BORO_NM", weight="count")
    assert {r.BORO_NM: r["count"] for r in report.collect()} == counts


def test_lines_combine_on_their_key_before_the_join(spark):
    """The join reuses the shuffle of the grouping: one per side, no more."""
    for key, value in [
        ("spark.sql.autoBroadcastJoinThreshold", "-1"),
        ("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1"),
    ]:
        spark.conf.set(key, value)
    try:
        plan = re.sub(r"#\d+L?", "", initial_plan(catalog.crimes_top(spark, DATA)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    join = plan[plan.index("SortMergeJoin") :]
    assert join.count("Exchange hashpartitioning") == 2
    assert "keys=[l_partkey], functions=[partial_count(1)]" in join


@pytest.mark.parametrize(
    "name",
    ["cross_districts", "cross_crime_race", "crimes_severity", "crimes_day_night", "cross_age_race"],
)
def test_line_items_combine_before_any_join(spark, no_broadcast, name):
    plan = re.sub(r"#\d+L?", "", initial_plan(catalog.queries()[name](spark, DATA)))
    # Nothing but grouped rows is dealt out by an order or a part.
    for exchange in re.finditer(r"Exchange hashpartitioning\(l_(?:order|part)key[^\n]*\n([^\n]*)", plan):
        assert "HashAggregate(keys=" in exchange[1], exchange[0]


def test_lookups_fetch_by_found_keys(spark):
    """Nothing is left of the large tables but the rows with the found keys."""
    for name in ("lookup_regex_sex", "incident_preview", "lookup_id"):
        plan = initial_plan(catalog.queries()[name](spark, DATA))
        assert "lineitem.parquet" not in plan and "orders.parquet" not in plan
        for key in ("c_custkey", "p_partkey"):
            assert re.search(rf"PushedFilters: \[[^]]*(In|EqualTo)\({key},", plan), (name, key)


def test_an_id_reaches_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = initial_plan(adapters.incident_by_id(spark, DATA, "0-3-170-3", "_id"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for key, value in (("l_orderkey", 0), ("l_linenumber", 3), ("l_partkey", 170), ("l_suppkey", 3)):
        assert f"EqualTo({key},{value})" in plan


def test_a_batch_of_reports_is_one_scan(spark):
    plan = final_plan(catalog.batch_reports(spark, DATA))
    assert plan.count("lineitem.parquet") == 1
    assert "Expand" in plan and "ReusedExchange" in plan


def test_years_of_an_appended_table_prune_folders(spark):
    plan = initial_plan(catalog.incident_year_filter(spark, DATA))
    filters = re.search(r"PartitionFilters: \[([^]]*)\]", plan)[1]
    assert "written_year" in filters and ">= 1996" in filters and "<= 2000" in filters
