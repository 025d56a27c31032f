"""Operators on small fixtures, against plain Python."""

import math
import random
import statistics
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyward.operators import counting, crosstab, distribution, lookup, series, text

LABELS = st.sampled_from(["a", "b", "", "false", None])
FEW = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def pairs_frame(spark, pairs):
    return spark.createDataFrame(pairs, "r string, c string")


def test_ties_go_by_key(spark, rows):
    offences = [f"o{i:02d}" for i in range(21)]
    data = [(o,) for o in offences for _ in range(2 if o in ("o19", "o20") else 3)]
    df = spark.createDataFrame(data, "k string")
    top = rows(counting.top_n(counting.count_by(df, "k"), "k", 20))
    assert [k for k, _ in top] == offences[:20]
    assert top[-1] == ("o19", 2)


def test_null_is_a_group_and_ranks_first_among_ties(spark, rows):
    df = spark.createDataFrame([(None,), ("a",), ("b",), ("b",)], "k string")
    assert rows(counting.ranked(counting.count_by(df, "k"), "k")) == [("b", 2), (None, 1), ("a", 1)]


def test_top_n_is_a_prefix(spark, rows):
    df = spark.range(1000).select((F.col("id") % 37).cast("string").alias("k"))
    counts = counting.count_by(df, "k")
    assert rows(counting.top_n(counts, "k", 10)) == rows(counting.ranked(counts, "k"))[:10]


def test_shares(spark, rows):
    df = spark.createDataFrame(
        [("x", "a", 1), ("x", "b", 3), (None, "a", 4), ("y", "a", 0)], "g string, k string, count int"
    )
    whole = {(g, k): s for g, k, _, s in rows(counting.share_of_total(df))}
    assert whole[("x", "b")] == 3 / 8
    within = {(g, k): s for g, k, _, s in rows(counting.share_within(df, "g"))}
    assert within == {("x", "a"): 0.25, ("x", "b"): 0.75, (None, "a"): 1.0, ("y", "a"): None}


def test_slice_members_distinct(spark, rows):
    df = pairs_frame(spark, [("x", "b"), ("x", "a"), ("y", "a"), (None, "z")])
    assert rows(counting.slice_of(df, "r", "x", "c")) == [("a",), ("b",)]
    members = spark.createDataFrame([("a",), (None,)], "c string")
    assert sorted(rows(counting.keep_members(df, "c", members))) == [("a", "x"), ("a", "y")]
    assert sorted(rows(counting.distinct_values(df, "r"))) == [("x",), ("y",)]


def test_persisted_releases(spark):
    df = spark.range(10)
    with counting.persisted(df) as held:
        assert held.count() == 10 and held.storageLevel.useMemory
    assert not df.storageLevel.useMemory


@FEW
@given(st.lists(st.tuples(LABELS, LABELS), min_size=1, max_size=30))
def test_crosstab_forms_agree(spark, pairs):
    df = pairs_frame(spark, pairs).repartition(3)
    wanted = Counter((r, c) for r, c in pairs if r is not None and c is not None)
    long = {(x.r, x.c): x["count"] for x in crosstab.crosstab(df, "r", "c").collect()}
    assert long == wanted
    wide = crosstab.crosstab_wide(df, "r", "c", ["a", "b", "", "false"])
    cells = {
        (x.r, c): x[c] for x in wide.collect() for c in ["a", "b", "", "false"]
    }
    assert {k: v for k, v in cells.items() if v} == wanted
    assert None not in cells.values()
    shares = Counter()
    for x in crosstab.crosstab_share(df, "r", "c").collect():
        shares[x.r] += x.share
    assert all(math.isclose(s, 1) for s in shares.values())


def test_unlisted_labels_share_a_column(spark, rows):
    df = pairs_frame(spark, [("x", "a"), ("x", "b.1"), ("x", "b.1"), ("y", "a"), ("x", "z")])
    wide = crosstab.crosstab_wide(df, "r", "c", ["b.1"])
    assert wide.columns == ["r", "b.1", crosstab.REST]
    assert rows(wide) == [("x", 2, 2), ("y", 0, 1)]
    assert rows(crosstab.crosstab_wide_share(wide, "r")) == [("x", 0.5, 0.5), ("y", 0.0, 1.0)]
    long = crosstab.crosstab(df, "r", "c").groupBy("r").sum("count")
    assert sorted(rows(long)) == [("x", 4), ("y", 1)]


def test_unstack_keeps_gaps(spark, rows):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "y int, k string, count long")
    assert rows(crosstab.unstack(df, "y", "k", ["a", "b"])) == [
        (1, 5, None, None), (2, None, 6, None),
    ]
    assert rows(crosstab.unstack(df, "y", "k", ["a"])) == [(1, 5, None), (2, None, 6)]
    assert rows(crosstab.pivot_mean(df, "y", "k", ["a"], "count")) == [(1, 5.0, None), (2, None, 6.0)]


def test_density_of_large_values(spark):
    df = spark.createDataFrame([(2_000_000_000 + i,) for i in range(9)], "v long")
    curve = distribution.density_curve(df, "v", 10).collect()
    assert all(0 < r.density < 1 for r in curve)


def test_trend_of_a_line(spark):
    df = spark.createDataFrame([(y, 3 * y + 1) for y in range(2000, 2006)] + [(None, 99)], "y int, count long")
    out = {r.y: r for r in series.linear_trend(df, "y").collect()}
    assert math.isclose(out[2003].slope, 3) and math.isclose(out[2003].trend, 6010)
    assert out[None].trend is None


def test_one_period_has_no_trend_and_no_growth(spark):
    df = spark.createDataFrame([(2000, 5)], "y int, count long")
    assert series.linear_trend(df, "y").first().slope is None
    assert series.growth(df, "y").count() == 0


def test_growth_orders_by_period(spark, rows):
    df = spark.createDataFrame([(2002, 30), (2000, 10), (2001, 20), (None, 7)], "y int, count long")
    assert sorted(rows(series.growth(df, "y"))) == [(2001, 1.0), (2002, 0.5)]


def test_side_by_side(spark, rows):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "y int, a double")
    b = spark.createDataFrame([(2, 0.3), (3, 0.4)], "y int, b double")
    out = rows(series.side_by_side(a, b, "y").orderBy("y"))
    assert out == [(1, 0.1, None), (2, 0.2, 0.3), (3, None, 0.4)]


@pytest.fixture(scope="module")
def ages():
    rng = random.Random(7)
    return [rng.randint(6, 85) for _ in range(400)]


def test_histogram(spark, ages):
    df = spark.createDataFrame([(a,) for a in [*ages, None]], "age int")
    out = {r.bin: r for r in distribution.histogram(df, "age", 5).collect()}
    wanted = Counter(a // 5 * 5 for a in ages)
    assert {b: r["count"] for b, r in out.items()} == wanted
    assert math.isclose(sum(r.density for r in out.values()) * 5, 1)
    low = min(ages)
    out = distribution.histogram(df, "age", 5, from_smallest=True).collect()
    assert {r.bin: r["count"] for r in out} == Counter((a - low) // 5 * 5 + low for a in ages)


def test_single_bins(spark, rows):
    df = spark.createDataFrame([(37,)], "age int")
    assert rows(distribution.histogram(df, "age", 5).select("bin"))[0][0] == 35
    assert rows(distribution.histogram(df, "age", 10).select("bin"))[0][0] == 30


def test_density_curve(spark, ages):
    df = spark.createDataFrame([(a,) for a in [*ages, None]], "age int")
    out = {r.place: r for r in distribution.density_curve(df, "age", 50).collect()}
    assert sorted(out) == list(range(50))
    h = statistics.stdev(ages) * len(ages) ** -0.2
    for place, row in out.items():
        x = min(ages) + place * (max(ages) - min(ages)) / 50
        kernel = sum(math.exp(-((x - a) ** 2) / (2 * h * h)) for a in ages)
        assert math.isclose(row.x, x)
        assert math.isclose(row.density, kernel / (len(ages) * h * math.sqrt(2 * math.pi)), rel_tol=1e-9)


def test_density_of_equal_values_is_undefined(spark):
    df = spark.createDataFrame([(30,), (30,)], "age int")
    assert {r.density for r in distribution.density_curve(df, "age", 5).collect()} == {None}


def test_box_summary(spark):
    values = [1, 2, 3, 4, 10]
    df = spark.createDataFrame([("g", v) for v in values], "k string, count long")
    r = distribution.box_summary(df, "count", ["k"]).first()
    assert (r.low, r.q1, r.median, r.q3, r.high) == (1, 2.0, 3.0, 4.0, 10)
    assert r["mean"] == 4.0 and math.isclose(r.sd, statistics.pstdev(values))


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [("1", "MALE", "<18", 101), ("2", "FEMALE", "18-24", 102), ("3", None, "", 101)],
        "_id string, SUSP_SEX string, SUSP_AGE_GROUP string, KY_CD int",
    )


def test_lookups(people, rows):
    ids = lambda df: [r[0] for r in rows(df)]
    assert ids(lookup.find_like(people, "SUSP_SEX", "male", "_id")) == ["1", "2"]
    assert ids(lookup.find_like(people, "SUSP_SEX", "male", "_id", limit=1)) == ["1"]
    assert ids(lookup.find_like(people, "SUSP_SEX", "male", "_id", limit=0)) == ["1", "2"]
    assert ids(lookup.find_equal(people, "KY_CD", 101)) == ["1", "3"]
    assert ids(lookup.find_younger(people, "SUSP_AGE_GROUP", 18)) == ["1"]
    assert ids(lookup.find_one(people, "_id", "2")) == ["2"]
    assert ids(lookup.find_one(people, "_id", "9")) == []
    assert ids(lookup.preview(people, "_id", n=2)) == ["1", "2"]


def test_rename_and_back(people):
    names = {"_id": "id", "SUSP_SEX": "sex", "BORO_NM": "borough"}
    records = lookup.renamed(people, names)
    assert records.columns == ["id", "sex", "borough"]
    assert {r.borough for r in records.collect()} == {None}
    assert lookup.restored(records, names).columns == ["SUSP_SEX", "BORO_NM"]
    assert lookup.restored(records, names, with_id=True).columns == list(names)


def test_word_counts_over_distinct_labels(spark):
    labels = ["toy weapon", "toy weapon", "Toy gun", "gun", "the gun's grip", "9 mm", "90", "", None]
    df = spark.createDataFrame([(x,) for x in labels], "armed string")
    out = {r.word: r["count"] for r in text.word_counts(df, "armed").collect()}
    assert out == {"toy": 2, "weapon": 1, "gun": 3, "grip": 1, "mm": 1}
    kept = {r.word for r in text.word_counts(df, "armed", ["can't", "gun"]).collect()}
    assert kept == {"toy", "weapon", "the", "grip", "mm"}


def test_settled_gives_the_same_rows(spark, rows):
    df = pairs_frame(spark, [("x", "a"), ("x", "a"), (None, "b")])
    counts = counting.count_by(df, "r", "c")
    assert sorted(rows(counting.settled(counts)), key=str) == sorted(rows(counts), key=str)
