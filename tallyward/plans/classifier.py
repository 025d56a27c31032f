"""Two-class classifier of shootings: one-hot categories, one-vs-rest logistic
regression, accuracy on held-out rows.

The index of category values is a table. It is counted, ranked and joined in
Spark, so its size is no matter of the driver's; a column has slots for its most
frequent values, and one more for all others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, OneVsRest, OneVsRestModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions.predicates import filled
from tallyward.functions.recode import white_label
from tallyward.operators.counting import COUNT, count_by
from tallyward.sources.tables import append_table, read_table, scratch_path

# Category columns, training share and solver settings.
CATEGORIES = [
    "armed", "city", "manner_of_death", "flee", "gender", "state",
    "threat_level", "body_camera", "signs_of_mental_illness",
]
TRAIN_SHARE = 0.8
MAX_ITERATIONS, TOLERANCE = 10, 1e-6

# The regression is fitted on about this many rows at most, chosen by a hash of the
# id; categories are counted over all rows.
MOST_TRAINING_ROWS = 1_000_000

# A column's values with a slot of their own at most. Up to 1000, Spark cuts a
# ranking within each task before it is shuffled.
MOST_VALUES = 1000

_BUCKETS = 10_000


def complete_rows(shootings: DataFrame) -> DataFrame:
    """Rows with every category and the race filled in, and their class."""
    return shootings.filter(filled(*CATEGORIES, "race")).withColumn(
        "label", white_label(F.col("race"))
    )


def split_rows(
    rows: DataFrame, key: str = "id", share: float = TRAIN_SHARE, seed: int = 42
) -> DataFrame:
    """Mark each row as train or test in ``split``, by a hash of its id.

    A row falls on the same side in every run and after a lost executor,
    whatever the partitioning, which a random draw per partition does not give.
    The hash is the start of an md5 sum, which other engines have as well.
    """
    bucket = _hashed(key, seed) % _BUCKETS
    return rows.withColumn(
        "split", F.when(bucket < int(share * _BUCKETS), "train").otherwise("test")
    )


def _hashed(key: str, seed: int) -> Column:
    """32 bits of a seeded hash."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint")


def bounded_rows(
    rows: DataFrame, key: str = "id", most: int = MOST_TRAINING_ROWS, seed: int = 43
) -> DataFrame:
    """All rows, or about ``most`` of them by a hash of their id."""
    n = rows.count()
    return rows if n <= most else rows.filter(_hashed(key, seed) < F.lit(2**32 * most // n))


def category_index(rows: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """``column, value, index``: each column's ``most`` frequent values, the most
    frequent first, ties by value. Counted over all rows."""
    each = rows.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in CATEGORIES]))
    )
    order = Window.partitionBy("column").orderBy(F.desc(COUNT), F.col("value"))
    place = F.row_number().over(order)
    ranked = count_by(each, "column", "value").withColumn("place", place)
    return ranked.filter(F.col("place") <= most).select(
        "column", "value", (F.col("place") - 1).alias("index")
    )


@dataclass
class Features:
    """The written index of a training table, and how many values each column has."""

    index: DataFrame
    sizes: dict[str, int]

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``features``, a sparse vector of one slot for each column.

        A value the index does not hold, unseen or too rare, takes the column's
        last slot. Each lookup is a join by the value's text.
        """
        indexed = {c: f"{c}_indexed" for c in CATEGORIES}
        for column, name in indexed.items():
            own = self.index.filter(F.col("column") == column).select(
                F.col("value").alias(f"_{column}"), F.col("index").cast("double").alias(name)
            )
            rows = rows.join(own, F.col(column) == F.col(f"_{column}"), "left").drop(f"_{column}")
        rest = {n: F.coalesce(n, F.lit(float(self.sizes[c]))) for c, n in indexed.items()}
        encoded = [f"{c}_encoded" for c in CATEGORIES]
        encoder = OneHotEncoder(
            inputCols=list(indexed.values()), outputCols=encoded, dropLast=False
        ).fit(self._last_slots(rows, indexed))
        assembler = VectorAssembler(inputCols=encoded, outputCol="features")
        return assembler.transform(encoder.transform(rows.withColumns(rest)))

    def _last_slots(self, rows: DataFrame, indexed: dict[str, str]) -> DataFrame:
        """One row with every column's last slot, from which an encoder learns sizes."""
        last = [F.lit(float(self.sizes[c])).alias(n) for c, n in indexed.items()]
        return rows.sparkSession.range(1).select(*last)


def features(rows: DataFrame, most: int = MOST_VALUES) -> Features:
    """Index the categories of all given (training) rows."""
    spark = rows.sparkSession
    index = category_index(rows, most)
    path = scratch_path(spark, "categories")
    append_table(index, path)
    index = read_table(spark, path, index.schema)
    sizes = dict.fromkeys(CATEGORIES, 0)
    sizes |= {r["column"]: r[COUNT] for r in count_by(index, "column").collect()}
    return Features(index, sizes)


@dataclass
class Classifier:
    features: Features
    fitted: OneVsRestModel

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``features`` and ``prediction``."""
        return self.fitted.transform(self.features.transform(rows))


def train(
    rows: DataFrame,
    most: int = MOST_TRAINING_ROWS,
    iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
) -> Classifier:
    """Index the categories of all given (training) rows, and fit the classifier on
    them or about ``most`` of them."""
    base = LogisticRegression(
        maxIter=iterations, tol=tolerance, featuresCol="features", labelCol="label"
    )
    encoded = features(rows)
    fitted = OneVsRest(classifier=base, parallelism=2).fit(
        encoded.transform(bounded_rows(rows, most=most)).select("features", "label")
    )
    return Classifier(encoded, fitted)


def index_rows(model: Classifier) -> DataFrame:
    """``column, value, index`` of the model's categories."""
    return model.features.index


def feature_slots(encoded: Features, rows: DataFrame, key: str = "id") -> DataFrame:
    """``id, slot`` of the slots each row sets in its feature vector."""
    vectors = encoded.transform(rows)
    slots = F.posexplode(vector_to_array("features")).alias("slot", "value")
    return vectors.select(key, slots).where("value = 1").select(key, "slot")


def prepared(model: Classifier, rows: DataFrame) -> DataFrame:
    """Feature vector, race and class of each row."""
    return model.features.transform(rows).select("features", "race", "label")


def feature_column(data: DataFrame) -> DataFrame:
    return data.select("features")


def label_column(data: DataFrame) -> DataFrame:
    return data.select("label")


def accuracy(predictions: DataFrame) -> float:
    return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(predictions)


def scores(model: Classifier, rows: DataFrame) -> DataFrame:
    """Rows, accuracy and error of each split, in one pass over the rows."""
    hit = (F.col("prediction") == F.col("label")).cast("int")
    return (
        model.transform(rows)
        .groupBy("split")
        .agg(F.count(hit).alias("rows"), F.avg(hit).alias("accuracy"))
        .withColumn("error", 1 - F.col("accuracy"))
    )


def confusion(model: Classifier, rows: DataFrame) -> DataFrame:
    """``split, label, prediction, rows``: how often each class was called each."""
    called = model.transform(rows).withColumn("prediction", F.col("prediction").cast("int"))
    return called.groupBy("split", "label", "prediction").agg(F.count(F.lit(1)).alias("rows"))
