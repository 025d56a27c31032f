"""Whitening of embeddings by singular values of the centred rows.

Entries become whole numbers of 1/256, so sums are exact. The fit list is every
distinct vector once; each task turns its centred rows, a block at a time, into a
triangular factor (QR), and factors are merged a few at a time until one of the
vectors' width is left. The driver makes that one bidiagonal, finds its singular
values by dqds steps and the leading vectors by twisted factorisations
(``singular``). Squared singular values over n are the variances, so no
covariance matrix is ever formed and nothing is squared before the values are
known.

Only distinct vectors are shuffled, combined before they move; what the driver
and every task hold grows with the width of a vector, not with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.shared import settled
from tallyward.llm.singular import largest

_LONG = 2**63 - 1
_ROW = (
    "vec_id {}, component int, n long, deviation long, whitened double, "
    "explained double, identity_error double"
)


def whole_entries(vector: Column) -> Column:
    """Entries as whole numbers of 1/256, rounded down."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 256))


def usable(vector: Column) -> Column:
    """True for a vector whose entries are all finite numbers."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def _stacked(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, shorter ones with noughts at the end."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _totals(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, int] = {}
        for batch in batches:
            width = max(map(len, batch["x"]), default=0)
            table = _stacked(batch["x"], width)
            # Python's whole numbers where a batch's sum could leave 64 bits.
            far = len(table) * (2 * float(np.abs(table.astype(float)).max(initial=0)) + 1)
            own = table.sum(axis=0) if far < _LONG else table.astype(object).sum(axis=0)
            for i, value in enumerate(own):
                sums[i] = sums.get(i, 0) + int(value)
        yield pd.DataFrame({"i": list(sums), "total": [str(v) for v in sums.values()]})

    parts = fit.mapInPandas(add, "i int, total string")
    sums = parts.groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r.i: int(r.total) for r in sums.collect()}
    return fit.count(), [found[i] for i in range(len(found))]


def _triangle(fit: DataFrame, mean: np.ndarray, fan_in: int, block: int) -> np.ndarray:
    """The triangular factor of all centred rows."""
    width = len(mean)

    def factor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, seen = np.zeros((0, width)), False
        for batch in batches:
            for at in range(0, len(batch), block):
                rows = _stacked(batch["x"].iloc[at : at + block], width) - mean
                r, seen = np.linalg.qr(np.vstack([r, rows]), mode="r"), True
        if seen:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "r": [r.tobytes()]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(r).reshape(-1, width) for r in group["r"]]
        r = np.linalg.qr(np.vstack(held), mode="r")
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // fan_in], "r": [r.tobytes()]})

    parts = settled(fit.mapInPandas(factor, "part long, r binary"), "factors")
    last = parts.agg(F.max("part")).first()[0] or 0
    while last > 0:
        whole = F.floor(F.col("part") / fan_in)
        parts = settled(parts.groupBy(whole).applyInPandas(merge, "part long, r binary"), "factors")
        last //= fan_in
    r = np.frombuffer(parts.first().r).reshape(-1, width)
    return np.vstack([r, np.zeros((width - len(r), width))])


class Whitening:
    """Means, directions and variances; directions are rows, scaled to variance 1."""

    def __init__(self, n: int, sums: list[int], r: np.ndarray, count: int):
        self.n, self.sums = n, sums
        squares, vectors = largest(r, count)
        self.variances = squares / n
        trace = float(self.variances.sum())
        # Below rounding of the largest a variance has no direction of its own.
        least = (len(sums) * np.finfo(float).eps) ** 2 * self.variances.max(initial=0)
        own = self.variances[: len(vectors)]
        self.known = (own > least) & (own > 0)
        scale = np.sqrt(np.where(self.known, own, 1.0))
        self.directions = vectors / scale[:, None]
        self.explained = [float(e / trace) if trace > 0 else None for e in own]
        self.mean = np.array([s / n for s in sums])
        self.limit = max((abs(s) for s in sums), default=0)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of n * x - S; None where 64 bits can't hold one."""
        far = self.n * (float(np.abs(x.astype(float)).max(initial=0)) + 1) + self.limit
        if far * far * max(1, len(self.sums)) < _LONG / 2:
            off = self.n * x - np.array(self.sums, dtype=np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]
        return [d if d <= _LONG else None for d in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.directions.T


def _projected(df: DataFrame, model: Whitening) -> DataFrame:
    """``df`` with ``w``, the whitened coordinates of ``x``, and ``deviation``."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("deviation long, w array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = _stacked(rows, len(sent.value.sums))
            yield pd.DataFrame(
                {
                    "deviation": pd.array(sent.value.deviations(x), dtype="Int64"),
                    "w": list(sent.value.whitened(x)),
                }
            )

    return df.withColumn("_of", project("x")).select(*df.columns, "_of.deviation", "_of.w")


def _identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the whitened vectors' covariance minus the identity."""
    known = np.flatnonzero(model.known).tolist()
    if not known:
        return None
    w = _projected(fit, model).select(*[F.col("w")[i].alias(f"w{i}") for i in known])
    pairs = [(i, j) for i in known for j in known if i <= j]
    found = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs))


def whiten(
    embeddings: DataFrame,
    components: int = 4,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    fan_in: int = 16,
    block: int = 4096,
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of
    every row and leading component.

    Rows with a null vector, or one with null or non-finite entries, are left
    out; repeated rows, and rows without an id, stay and count once in the fit
    list if their vectors are equal. A vector shorter than the longest counts as
    0 in the dimensions it lacks. There are as many components as dimensions, if
    those are fewer. A component without variance (equal vectors, fewer vectors
    than components) has a null ``whitened`` and is left out of
    ``identity_error``; without any variance ``explained`` and
    ``identity_error`` are null. A deviation beyond 64 bits is null. Without a
    usable vector, or with vectors without entries, the result is empty. Only
    the id and the vector are read.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("_v"))
    rows = rows.where(usable(F.col("_v"))).select("vec_id", whole_entries(F.col("_v")).alias("x"))
    schema = _ROW.format(rows.schema["vec_id"].dataType.simpleString())
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not longest:
        return spark.createDataFrame([], schema)
    lacking = F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("x"))
    rows = rows.withColumn("x", F.concat("x", lacking))
    fit = settled(rows.select("x").distinct(), "vectors")
    n, sums = _totals(fit)
    r = _triangle(fit, np.array([s / n for s in sums]), fan_in, block)
    model = Whitening(n, sums, r, components)
    error = _identity_error(fit, model)
    shown = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("component"),
                F.when(F.lit(bool(known)), F.col("w")[i]).alias("whitened"),
                F.lit(share).cast("double").alias("explained"),
            )
            for i, (known, share) in enumerate(zip(model.known, model.explained))
        ]
    )
    each = _projected(rows, model).select("vec_id", "deviation", F.inline(shown))
    return each.select(
        "vec_id",
        "component",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
