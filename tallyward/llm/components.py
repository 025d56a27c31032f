"""Connected components by alternating star contraction.

Every round replaces a node's links by links to the smallest node it knows,
first for its larger neighbours, then for the smaller ones. Rounds grow with the
logarithm of the longest path. A node with very many links meets one row of
minima in an ordinary join, whose large side Spark splits; no task gathers a
component, and the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.shared import settled


def _toward_smaller(links: DataFrame) -> DataFrame:
    """Links of every node to its larger neighbours, moved to its smallest."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    larger = links.select(F.col("b").alias("a"), F.col("a").alias("far"))
    return (
        larger.join(least, "a")
        .select(F.col("far").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def _among_smaller(links: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node itself, to the smallest."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").where("b != least").selectExpr("b AS a", "least AS b")
    return moved.unionAll(least.selectExpr("a", "least AS b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in a link; the root is its smallest node.

    ``links`` has the columns ``a`` and ``b`` of one orderable type, in any
    order, repeats and self links allowed. Nodes without a link to another node
    are not listed; an empty table gives an empty one.
    """
    links = (
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a != b")
        .distinct()
    )
    links, before = settled(links, "links"), None
    while True:
        now = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now[0] == 0 or now == before:
            return links.selectExpr("a AS node", "b AS root").unionAll(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
        links = settled(_among_smaller(_toward_smaller(links)), "links")
