"""Readers, writers, text lines, and the adapter views."""

import pytest
from pyspark.sql import functions as F

from tallyward import catalog
from tallyward.plans import keyvalue, metrics
from tallyward.sources import adapters, lines, schemas, session, tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture()
def path(spark):
    return lambda name: tables.scratch_path(spark, name)


def test_scratch_is_under_the_shared_folder(spark, path):
    assert path("a").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert path("a") != path("a")


def test_scratch_needs_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    bare = type("Bare", (), {"conf": type("Conf", (), {"get": lambda self, k, d=None: d})()})()
    assert shared
    with pytest.raises(ValueError):
        tables.scratch_path(bare, "a")


HARD = [
    "", " ", "  ", None, " S01", "S02 ", "a\nb", "a\r\nb", "\n", "a\tb", 'say "x"', '"', "\\",
    "\\n", "a\\\nb", "a,b", "'", "é", "false", "=", "a/b:c", "%41",
]


def test_hard_texts_survive_every_file(spark, path, rows):
    df = spark.createDataFrame([(t, i) for i, t in enumerate(HARD)], "k string, count long")
    report, parts = path("report"), path("parts")
    tables.write_report(df, report)
    assert sorted(rows(tables.read_report(spark, report, df.schema)), key=repr) == sorted(
        rows(df), key=repr
    )
    assert tables.read_lines(spark, report).count() == len(HARD) + len(
        {r[0] for r in tables.read_report(spark, report, df.schema).select(F.input_file_name()).collect()}
    )
    pairs = spark.createDataFrame([(t, i) for i, t in enumerate(HARD)], schemas.KEY_VALUE)
    where = path("kv")
    tables.write_key_values(pairs, where)
    assert sorted(rows(tables.read_key_values(spark, where)), key=repr) == sorted(
        rows(pairs), key=repr
    )
    tables.append_table(df, parts, ["k"])
    back = tables.read_table(spark, parts, df.schema, columns=["k", "count"])
    assert sorted(rows(back), key=repr) == sorted(rows(df), key=repr)


def test_partitions_have_few_files(spark, path):
    df = spark.range(0, 4000, 1, 40).selectExpr("id", "string(id % 7) AS k")
    where = path("few")
    tables.append_table(df, where, ["k"])
    files = tables.read_table(spark, where).select(F.input_file_name()).distinct().count()
    assert files <= 2 * 7


def test_report_keeps_empty_and_null_apart(spark, path, rows):
    df = spark.createDataFrame(
        [("a", 1), ("", 2), (None, 3), ('q"uote, comma', 4)], "k string, count long"
    )
    where = path("report")
    tables.write_report(df.withColumn("i", F.lit(0)), where, index_column="i")
    back = tables.read_report(spark, where, df.schema)
    assert sorted(rows(back), key=str) == sorted(rows(df), key=str)
    assert tables.read_report(spark, where, df.schema, ["count"]).columns == ["count"]


def test_key_values(spark, path, rows):
    df = spark.createDataFrame([("BLACK", 5), ("ASIAN / PACIFIC ISLANDER", 7), ("", 1)], schemas.KEY_VALUE)
    where = path("kv")
    tables.write_key_values(df.repartition(3), where)
    assert sorted(rows(tables.read_key_values(spark, where))) == sorted(rows(df))
    text = [r.value for r in tables.read_lines(spark, where).collect()]
    assert "BLACK\t5" in text


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_read_table(spark, path, rows, fmt):
    df = spark.createDataFrame([("NY", 1.5), ("TX", 2.5)], "State string, Tornout double")
    where = path(fmt)
    writer = df.write.option("header", True) if fmt == "csv" else df.write
    writer.format(fmt).save(where)
    back = tables.read_table(spark, where, df.schema, fmt, ["Tornout"])
    assert sorted(rows(back)) == [(1.5,), (2.5,)]
    if fmt in ("csv", "json"):
        with pytest.raises(ValueError):
            tables.read_table(spark, where, fmt=fmt)


def test_append_adds_and_prunes(spark, path):
    df = spark.createDataFrame([(2009, "a"), (2010, "b")], "yearpd int, k string")
    where = path("clean")
    tables.append_table(df, where, ["yearpd"])
    tables.append_table(df, where, ["yearpd"])
    back = tables.read_table(spark, where).filter("yearpd = 2010")
    assert back.count() == 2
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(yearpd" in plan


def census_line(race, population):
    return f"id,New York,Kings County,M,false,0-4,{race},{population}"


def test_population_lines(spark, rows):
    data = [
        "_id,STNAME,CTYNAME,SEX,ORIGIN,AGEGRP,IMPRACE,RESPOP",
        census_line("White alone", 5),
        census_line("White and Asian", 6),
        census_line("Asian alone", 7),
        census_line("Native Hawaiian alone", "n/a"),
        census_line("Martian", 9),
        "too,short,line",
    ]
    df = spark.createDataFrame([(x,) for x in data], "value string")
    # The unreadable number takes its whole group out, also the readable row.
    assert sorted(rows(keyvalue.population_by_race(df))) == [("None", 9), ("WHITE", 11)]


def crime_line(offence, race):
    return f"id,01/01/2009,06:00:00,1,101,{offence},COMPLETED,FELONY,BRONX,<18,{race},MALE,40.5,-74.0"


def test_crime_lines(spark, rows):
    data = [
        ",".join(catalog.CRIME_LINE),
        crime_line("THEFT", "BLACK"),
        crime_line("THEFT, GRAND", "BLACK"),
        crime_line("A, B, C, D", "WHITE"),
        crime_line("THEFT", ""),
        "a,b,c,d,e",
        "",
    ]
    df = spark.createDataFrame([(x,) for x in data], "value string")
    assert sorted(rows(keyvalue.crimes_by_race(df))) == [("", 1), ("BLACK", 2), ("WHITE", 1)]


def test_rate(spark, rows):
    people = spark.createDataFrame([("WHITE", 200), ("BLACK", 0), ("None", 5)], schemas.KEY_VALUE)
    crimes = spark.createDataFrame([("WHITE", 3), ("BLACK", 1), ("X", 5)], schemas.KEY_VALUE)
    assert sorted(rows(metrics.crime_rate(people, crimes))) == [
        ("BLACK", 0, 1, None), ("WHITE", 200, 3, 1.5),
    ]


def test_joined_fields_keep_their_place(spark):
    df = spark.createDataFrame([("a", None, 1)], "x string, y string, z int")
    assert df.select(lines.join_fields("x", "y", "z")).first()[0] == "a,,1"


def test_views_hold_the_contract_columns(spark):
    assert adapters.incidents(spark, DATA).schema.names == schemas.INCIDENTS.names
    for view, schema in [
        (adapters.incidents, schemas.INCIDENTS),
        (adapters.census, schemas.CENSUS),
        (adapters.shootings, schemas.SHOOTINGS),
        (adapters.police_deaths, schemas.POLICE_DEATHS),
    ]:
        df = view(spark, DATA)
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]


def test_rows_of_a_view_do_not_depend_on_its_columns(spark):
    n = adapters.table(spark, DATA, "lineitem").count()
    for columns in (["_id"], ["CMPLNT_FR_DT"], ["BORO_NM"], ["SUSP_RACE", "OFNS_DESC"]):
        assert adapters.incidents(spark, DATA, columns).count() == n


def test_shuffle_partitions_grow_with_the_input():
    assert session.shuffle_partitions(0, 8) == 8
    assert session.shuffle_partitions(1024**4, 8) == 8192
    assert session.shuffle_partitions(100 * 1024**4, 8) == 819_200
    assert int(session.SETTINGS["spark.sql.adaptive.coalescePartitions.initialPartitionNum"]) > 4096


def test_open_session_hands_back_the_running_one(spark):
    opened = session.open_session("again", **{"spark.sql.session.timeZone": "UTC"})
    assert opened.sparkContext is spark.sparkContext
