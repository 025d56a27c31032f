"""Lookups by found keys, batches, appended tables, pairs, binned curves and rejected lines."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyward import catalog
from tallyward.operators import lookup
from tallyward.operators.distribution import binned_density_curve, density_curve
from tallyward.operators.text import word_and_pair_counts
from tallyward.plans import classifier, incidents, keyvalue
from tallyward.sources import adapters, tables
from tallyward.sources.schemas import INCIDENT_NAMES

DATA = "/root/testdata/sf0.001"


# -- lookups -----------------------------------------------------------------


def test_a_search_has_a_bound(spark):
    rows = spark.range(30).selectExpr("id", "CASE WHEN id % 3 > 0 THEN id % 3 END AS k")
    held = lookup.fetched(rows, 30)
    assert held.keys("k") == [1, 2] and held.frame(spark).count() == 30
    with pytest.raises(ValueError):
        lookup.fetched(rows, 29)
    assert lookup.with_keys(rows, "k", []).count() == 0
    assert lookup.with_keys(rows, "k", [2]).count() == 10
    assert lookup.fetched(rows.where("false"), 5).frame(spark).columns == ["id", "k"]


def test_completed_rows_are_those_of_the_whole_view(spark):
    whole = adapters.incidents(spark, DATA).orderBy(*catalog.ID_ORDER).limit(15)
    lines = adapters.keyed_incidents(spark, DATA, catalog.ID_ORDER, (1990, 2010))
    found = lookup.fetched(lookup.preview(lines, *catalog.ID_ORDER, n=15), 15)
    got = adapters.complete_incidents(spark, DATA, found)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))


def test_one_row_or_none(spark):
    ids = {i: adapters.incident_by_id(spark, DATA, i, "_id").count()
           for i in ("0-3-170-3", "0-0-0-0", "", "x-1-2-3", "0-3-170", "0-3-170-03")}
    assert ids == {"0-3-170-3": 1, "0-0-0-0": 0, "": 0, "x-1-2-3": 0, "0-3-170": 0, "0-3-170-03": 0}
    none = lookup.fetched(adapters.incident_by_id(spark, DATA, "0-0-0-0", "_id"), 1)
    assert adapters.complete_incidents(spark, DATA, none).collect() == []


# -- batch -------------------------------------------------------------------


def test_batch_holds_what_each_report_says(spark):
    cells = catalog._study_cells(spark, DATA)
    batch = incidents.all_reports(cells)
    single = {
        "crimes_top": incidents.crimes_top(cells, weight="count"),
        "crimes_severity": incidents.crimes_severity(cells, "count"),
        "crimes_severity_by_district": incidents.crimes_severity_by_district(cells, "count"),
        "crimes_day_night": incidents.crimes_day_night(cells, "count"),
        "crimes_race": incidents.crimes_race(cells, weight="count"),
        "cross_districts": incidents.cross_districts(cells, "count"),
        "crimes_districts_race": incidents.crimes_districts_race(cells, weight="count"),
        "cross_crime_race": incidents.cross_crime_race(cells, weight="count"),
    }
    rows = batch.collect()
    assert {r.report for r in rows} == set(incidents.BATCH)
    for report, df in single.items():
        keys = incidents.BATCH[report]
        got = [tuple(r[k] for k in (*keys, "count")) for r in rows if r.report == report]
        want = [tuple(r) for r in df.select(*keys, "count").collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want)), report
        unused = set(incidents.CELL_KEYS) - set(keys)
        assert all(r[k] is None for r in rows if r.report == report for k in unused)
    ages = {(r.SUSP_RACE, r.SUSP_AGE_GROUP): r["count"] for r in rows if r.report == "cross_age_race"}
    for r in incidents.cross_age_race(cells, weight="count").collect():
        assert [r[b] for b in incidents.AGE_BANDS] == [
            ages.get((r.SUSP_RACE, b), 0) for b in incidents.AGE_BANDS
        ]


# -- appended tables ---------------------------------------------------------


def test_year_folders_keep_what_the_text_filter_keeps(spark, tmp_path):
    texts = ["01/02/2009", "12/31/2019", "01/02/2008", "01/02/2020", "", None, "2009", "in 2012?",
             "2015-01-01", "01/02/20101", "1/2/2011", " 01/02/2013", "20/20/2014"]
    columns = [f"'{c}' AS {c}" for c in INCIDENT_NAMES if c not in ("CMPLNT_FR_DT", "SUSP_RACE")]
    schema = {f.name: f.dataType.simpleString() for f in incidents.INCIDENTS.fields}
    made = ", ".join(
        f"CAST(NULL AS {schema[c]}) AS {c}" if c not in ("CMPLNT_FR_DT", "SUSP_RACE") else c
        for c in INCIDENT_NAMES
    )
    assert columns
    rows = spark.createDataFrame(
        [(t, r) for t in texts for r in ("BLACK", "", None)], "CMPLNT_FR_DT string, SUSP_RACE string"
    ).selectExpr(*made.split(", "))
    for _ in range(2):
        incidents.append_incidents(rows, str(tmp_path), "one")
    got = incidents.filter_appended(spark, str(tmp_path))
    want = incidents.filter_incidents(rows)
    pick = lambda df: sorted(r.CMPLNT_FR_DT for r in df.collect())
    assert pick(got) == pick(want) and len(pick(want)) == 9
    assert got.columns == list(INCIDENT_NAMES)


def test_a_batch_replaces_itself_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("", 2), (None, 3), ("b", 4)], "k string, v int")
    tables.append_batch(rows, path, "2020-01", ["k"])
    tables.append_batch(rows.where("v = 1"), path, "2020-02", ["k"])
    tables.append_batch(rows, path, "2020-01", ["k"])
    read = lambda: sorted(map(repr, tables.read_batches(spark, path, rows.schema).select("k", "v", "batch").collect()))
    assert len(read()) == 5
    # A rerun with fewer rows leaves no partition of the run before behind.
    tables.append_batch(rows.where("v > 3"), path, "2020-01", ["k"])
    assert read() == ["Row(k='a', v=1, batch='2020-02')", "Row(k='b', v=4, batch='2020-01')"]
    for bad in ("", "a/b", "a=b", "é", "a b"):
        with pytest.raises(ValueError):
            tables.append_batch(rows, path, bad)
    whole = tables.read_batches(spark, path, rows.schema).where("batch = '2020-02'")
    assert "PartitionFilters: [isnotnull(batch" in whole._jdf.queryExecution().executedPlan().toString()


# -- pairs -------------------------------------------------------------------


def _plain_pairs(labels, stop, threshold):
    """One label after the other, without Spark."""
    words, twos = Counter(), Counter()
    for label in set(labels):
        own = label.split()
        words.update(w for w in own if w not in stop)
        twos.update(
            f"{a} {b}" for a, b in zip(own, own[1:]) if a not in stop and b not in stop
        )

    def standard(word, counts):
        plural = word.endswith("s") and not word.endswith("ss") and word[:-1] in counts
        return word[:-1] if plural else word

    form = {w: standard(w, words) for w in words}
    single, pair = Counter(), Counter()
    for w, n in words.items():
        single[form[w]] += n
    for p, n in twos.items():
        pair[standard(p, twos)] += n
    total, out = sum(single.values()), Counter(single)

    def side(k, n, share):
        return k * math.log(max(share, 1e-10)) + (n - k) * math.log(max(1 - share, 1e-10))

    for p, both in pair.items():
        a, b = (form[w] for w in p.split())
        ca, cb = single[a], single[b]
        if total <= ca or total <= cb:
            continue
        score = 2 * (
            side(both, ca, both / ca) + side(cb - both, total - ca, (cb - both) / (total - ca))
            - side(both, ca, cb / total) - side(cb - both, total - ca, cb / total)
        )
        if score > threshold:
            out[a] -= both
            out[b] -= both
            out[p] += both
    return {w: n for w, n in out.items() if n > 0}


def test_pairs_and_plurals(spark):
    labels = [f"toy weapon{'s' * (i % 2)} {'x' * (i % 9 + 2)}" for i in range(40)]
    labels += [f"the {'glass' if i % 2 else 'knives'} and {chr(97 + i % 20) * 3}" for i in range(30)]
    labels += ["toys", "guns", "gun", "pass", "a", "gun guns zzz"]
    df = spark.createDataFrame([(t,) for t in [*labels, *labels, None]], "t string")
    df = df.withColumn("t", F.when(F.col("t") == "guns", "Gun's 12 Guns").otherwise(F.col("t")))
    plain = ["gun guns" if t == "guns" else t for t in labels if t != "a"]
    for threshold in (5.0, 30.0):
        got = {r.word: r["count"] for r in word_and_pair_counts(df, "t", ["the", "and"], threshold).collect()}
        assert got == _plain_pairs(plain, {"the", "and"}, threshold)
    assert got["toy weapon"] > 15 and "weapons" not in got and "glass" in got
    assert word_and_pair_counts(df.where("false"), "t").collect() == []


# -- density -----------------------------------------------------------------


def test_binned_curve_is_near_the_exact_one(spark):
    rows = spark.range(4000).selectExpr(
        "CAST(floor(120 * pow(rand(5), 3) + 40 * rand(6)) AS INT) AS v"
    )
    rows = rows.withColumn("v", F.col("v")).cache()
    exact = {r.place: r for r in density_curve(rows, "v").collect()}
    got = {r.place: r for r in binned_density_curve(rows, "v").collect()}
    sd, low, high = rows.selectExpr("stddev_samp(v)", "min(v)", "max(v)").first()
    h, step = sd * 4000**-0.2, (high - low) / 500
    bound = (step / h) ** 2 / 8 / (h * math.sqrt(2 * math.pi))
    assert len(got) == 500
    assert all(abs(got[p].x - exact[p].x) < 1e-9 for p in exact)
    assert max(abs(got[p].density - exact[p].density) for p in exact) <= bound
    rows.unpersist()


def test_binned_curve_of_odd_columns(spark):
    make = lambda values: spark.createDataFrame([(v,) for v in values], "v double")
    assert binned_density_curve(make([]), "v").collect() == []
    one = binned_density_curve(make([3.0, 3.0, None, float("nan"), float("inf")]), "v").collect()
    assert len(one) == 500 and all(r.x == 3.0 and r.density is None for r in one)
    two = binned_density_curve(make([1.0, 2.0, float("-inf")]), "v", points=10).collect()
    assert sorted(r.place for r in two) == list(range(10)) and all(r.density > 0 for r in two)


# -- rejected lines ----------------------------------------------------------


def test_rejected_lines_by_reason(spark):
    make = lambda lines: spark.createDataFrame([(t,) for t in lines], "value string")
    census = make(["_id,S,C,X,O,A,IMPRACE,RESPOP", "1,a,b,c,d,e,White alone,12", "1,a", "",
                   "2,a,b,c,d,e,White alone,many", "3,a,b,c,d,e,White alone,"])
    found = keyvalue.rejected_census_lines(census)
    assert dict(map(tuple, keyvalue.rejected_counts(found).collect())) == {
        "header": 1, "short": 2, "unreadable": 2,
    }
    crimes = make([",".join(catalog.CRIME_LINE), ",".join("abcdefghijklmn"), "a,b", ",".join("abcdefghijklmno")])
    found = {r.value: r.reason for r in keyvalue.rejected_crime_lines(crimes).collect()}
    assert found == {",".join(catalog.CRIME_LINE): "header", "a,b": "short"}
    assert keyvalue.rejected_counts(keyvalue.rejected_crime_lines(crimes.where("false"))).collect() == []


# -- classifier --------------------------------------------------------------


@pytest.fixture(scope="module")
def people(spark):
    made = {c: "'x'" for c in classifier.CATEGORIES}
    made["city"] = "concat('c', id % 7)"
    made["armed"] = "CASE WHEN id % 5 = 0 THEN 'gun' ELSE 'knife' END"
    columns = ", ".join(f"{e} AS {c}" for c, e in made.items())
    rows = spark.sql(
        f"SELECT string(id) AS id, {columns}, CASE WHEN (id * id) % 11 < 5 THEN 'W' ELSE 'B' END AS race "
        "FROM range(400)"
    )
    return classifier.split_rows(classifier.complete_rows(rows))


def test_fitted_weights_are_optimal(people):
    """At the optimum of the logistic loss its gradient is nought."""
    import numpy as np

    model = classifier.train(people, iterations=500, tolerance=1e-12)
    fitted = model.fitted.models[1]
    data = classifier.prepared(model, people).collect()
    x = np.array([r.features.toArray() for r in data])
    y = np.array([r.label for r in data])
    margin = x @ fitted.coefficients.toArray() + fitted.intercept
    off = 1 / (1 + np.exp(-margin)) - y
    assert np.abs(x.T @ off).max() / len(y) < 1e-4 and abs(off.mean()) < 1e-4
    before = np.abs(x.T @ (y.mean() - y)).max() / len(y)
    assert before > 1e-3


def test_accessors(people):
    model = classifier.train(people)
    data = classifier.prepared(model, people)
    assert data.columns == ["features", "race", "label"] and data.count() == 400
    labels = Counter(r.label for r in classifier.label_column(data).collect())
    assert labels == Counter(r.label for r in people.collect())
    vectors = [r.features for r in classifier.feature_column(data).collect()]
    width = sum(n + 1 for n in model.features.sizes.values())
    assert all(v.size == width and len(v.indices) == 9 and set(v.values) == {1.0} for v in vectors)


def test_confusion_counts_every_row(people):
    model = classifier.train(people.where("split = 'train'"))
    counts = classifier.confusion(model, people).collect()
    assert sum(r.rows for r in counts) == 400
    right = sum(r.rows for r in counts if r.split == "test" and r.label == r.prediction)
    whole = sum(r.rows for r in counts if r.split == "test")
    score = {r.split: r.accuracy for r in classifier.scores(model, people).collect()}["test"]
    assert abs(right / whole - score) < 1e-12


def test_rare_values_share_the_last_slot(people):
    few = classifier.features(people, most=3)
    assert few.sizes["city"] == 3 and few.sizes["armed"] == 2
    all_values = classifier.features(people)
    kept = [r.value for r in all_values.index.where("column = 'city' AND index < 3").orderBy("index").collect()]
    assert [r.value for r in few.index.where("column = 'city'").orderBy("index").collect()] == kept
    rows = few.transform(people).select("city", "city_indexed").distinct().collect()
    assert {r.city: int(r.city_indexed) for r in rows} == {
        f"c{i}": kept.index(f"c{i}") if f"c{i}" in kept else 3 for i in range(7)
    }
