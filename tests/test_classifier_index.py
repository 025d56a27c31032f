"""Categories are counted over all training rows, however many are fitted on."""

from tallyward.plans import classifier


def test_index_counts_rows_beyond_the_bound(spark):
    columns = {c: "'x'" for c in classifier.CATEGORIES}
    columns["city"] = "CASE WHEN id % 100 = 7 THEN concat('rare', id) ELSE concat('c', id % 3) END"
    made = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    rows = spark.sql(
        f"SELECT string(id) AS id, {made}, CASE WHEN id % 3 = 0 THEN 'W' ELSE 'B' END AS race "
        "FROM range(600)"
    )
    rows = classifier.complete_rows(rows)
    assert classifier.bounded_rows(rows, most=60).count() < 200
    model = classifier.train(rows, most=60)
    got = [r.value for r in classifier.index_rows(model).where("column = 'city'").collect()]
    counts = {r.city: r["count"] for r in rows.groupBy("city").count().collect()}
    assert got == sorted(counts, key=lambda v: (-counts[v], v))
