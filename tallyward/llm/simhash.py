"""Near duplicates by SimHash and meet-in-the-middle ball hashing.

A fingerprint has a bit for each bit of the 64-bit hash that more than half of
the document's shingles set. Two fingerprints at most ``radius`` bits apart
share a value at most ``radius / 2`` bits from each. So every distinct
fingerprint emits all such values, one shuffle brings equal values together, and
fingerprints that meet are neighbours of the same value, hence of each other.
Linking each to the smallest in its group keeps all connections without a pair
for every two members. Groups are small whatever the data: one value has only
so many neighbours (65 at radius 2). Copies share a fingerprint and are merged
before anything is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.components import connected_components
from tallyward.llm.shared import settled

BITS = 64
_PRINT = "_near_duplicate_print"


def fingerprint_of(text: str | None, shingle_words: int = 3) -> int:
    """The fingerprint of one text as an unsigned number; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    shifted = [words[i:] for i in range(shingle_words)]
    grams = list(map(b" ".join, zip(*shifted))) or [b" ".join(words)]
    seed = 42
    return majority_bits(np.array([xxhash.xxh64_intdigest(g, seed) for g in grams], dtype="<u8"))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that over half of the unsigned 64-bit ``hashes`` set; 0 of none."""
    hashes = np.ascontiguousarray(hashes, dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # long texts: a bounded bit matrix
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: Column, shingle_words: int = 3) -> Column:
    """The 64 bits of ``text``'s fingerprint as a (signed) long."""

    @F.pandas_udf("long")
    def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = np.array([fingerprint_of(t, shingle_words) for t in batch], dtype=np.uint64)
            yield pd.Series(found.view(np.int64))

    return fingerprints(text)


def _masks(most: int) -> list[int]:
    """All 64-bit patterns of at most ``most`` ones, as signed numbers."""
    found = [
        sum(1 << bit for bit in bits)
        for n in range(most + 1)
        for bits in combinations(range(BITS), n)
    ]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def ball_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links ``(a, b)`` that connect distinct fingerprints ``fp`` at
    most ``radius`` (an even number) bits apart.

    Each member of a group is linked to its smallest member; two members of a
    group are always within the radius, so nothing is lost to connectedness.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even: both sides go half of it")
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(radius // 2)])
    variants = prints.select("fp", F.explode(masks).alias("mask")).select(
        F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp"
    )
    group = Window.partitionBy("variant").orderBy("fp")
    return (
        variants.select(F.col("fp").alias("a"), F.first("fp").over(group).alias("b"))
        .where("a != b")
        .distinct()
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    )


def near_duplicates(docs: DataFrame, radius: int = 2, shingle_words: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``docs``.

    Components join documents whose fingerprints are linked directly or through
    others. ``component_id`` is the smallest ``doc_id`` of the component; a null
    ``doc_id`` keeps its row and never is the smallest, so a component of null
    ids alone has a null one. Null, empty and wordless texts have fingerprint 0
    and are linked like any other. Repeated rows give repeated rows. Only
    ``doc_id`` and ``text`` are read.
    """
    rows = docs.select("doc_id", fingerprint(F.col("text"), shingle_words).alias("fp"))
    rows = settled(rows, "fingerprints")
    prints = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = connected_components(ball_links(prints, radius))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(by_print, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 2, shingle_words: int = 3) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    All columns stay. Repeated rows, and rows that share an id and a fingerprint,
    leave one. Of a component whose ids are all null one row stays. An empty
    table gives an empty one.
    """
    found = near_duplicates(docs, radius, shingle_words).distinct()
    one = found.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("kept")
    )
    # A null component_id stands for several components: those keep a row each.
    lone = found.where("component_id IS NULL")
    kept = one.where("component_id IS NOT NULL").select("kept.doc_id", "kept.fp")
    if not lone.isEmpty():
        prints = settled(lone.select("fp").distinct(), "prints")
        roots = connected_components(ball_links(prints, radius))
        kept = kept.unionAll(
            prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
            .groupBy(F.coalesce("root", "fp").alias("fp"))
            .agg(F.lit(None).cast("long").alias("doc_id"))
            .select("doc_id", "fp")
        )
    own = fingerprint(F.col("text"), shingle_words)
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("fp").alias("kept_fp"))
    marked = docs.withColumn(_PRINT, own)
    return (
        marked.join(
            kept,
            F.col("doc_id").eqNullSafe(F.col("kept_id"))
            & (F.col(_PRINT) == F.col("kept_fp")),
            "left_semi",
        )
        .dropDuplicates(["doc_id", _PRINT])
        .drop(_PRINT)
    )
