"""The classifier on a separable fixture and on the test tables."""

import pytest
from pyspark.sql import functions as F

from tallyward import catalog
from tallyward.plans import classifier

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def separable(spark):
    columns = {c: "'x'" for c in classifier.CATEGORIES}
    columns["armed"] = "CASE WHEN id % 3 = 0 THEN 'gun' ELSE 'knife' END"
    columns["city"] = "concat('c', id % 5)"
    made = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    return spark.sql(
        f"SELECT string(id) AS id, {made}, CASE WHEN id % 3 = 0 THEN 'W' ELSE 'B' END AS race "
        "FROM range(300)"
    )


def test_separable_rows_are_all_right(separable):
    rows = classifier.split_rows(classifier.complete_rows(separable))
    model = classifier.train(rows.filter("split = 'train'"))
    out = {r.split: r for r in classifier.scores(model, rows).collect()}
    assert out["train"].accuracy == out["test"].accuracy == 1.0
    assert out["train"].error == 0.0
    assert out["train"].rows + out["test"].rows == 300
    test = model.transform(rows.filter("split = 'test'"))
    assert classifier.accuracy(test) == 1.0
    data = classifier.prepared(model, rows)
    assert data.columns == ["features", "race", "label"]
    assert classifier.feature_column(data).columns == ["features"]
    assert classifier.label_column(data).columns == ["label"]


def test_unseen_category_is_scored(separable):
    rows = classifier.complete_rows(separable)
    model = classifier.train(rows)
    strange = rows.limit(1).withColumn("city", F.lit("elsewhere")).withColumn("split", F.lit("test"))
    assert classifier.scores(model, strange).first().rows == 1


def test_split_does_not_depend_on_partitioning(separable):
    def train_ids(df):
        return {r.id for r in classifier.split_rows(df).filter("split = 'train'").collect()}

    ids = train_ids(separable)
    assert train_ids(separable.repartition(13)) == ids
    assert 0.7 < len(ids) / 300 < 0.9


def test_incomplete_rows_are_left_out(separable):
    holes = separable.withColumn(
        "flee", F.expr("CASE id WHEN '1' THEN '' WHEN '2' THEN NULL ELSE flee END")
    )
    assert classifier.complete_rows(holes).count() == 298


def test_query_agrees_with_the_evaluator(spark):
    out = {r.split: r for r in catalog.race_classifier(spark, DATA).collect()}
    assert set(out) == {"train", "test"}
    assert all(0 <= r.accuracy <= 1 and r.rows > 0 for r in out.values())
