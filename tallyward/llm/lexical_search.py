"""Ranked lexical search by classes of documents that score alike.

A score depends on a document's counts of the items' terms and on ``m``, its
length beside the average, alone. So each document is reduced to its counts of
terms that occur in an item; documents with equal counts and equal ``m`` are
found by hash and compared in full, and each class is scored once. Of a class,
the ``k`` smallest ids are all that can be among an item's best, so no class is
ever gathered beyond them.

Documents are read once. The items' terms go to every task while there are at
most ``most_terms``; beyond that, the documents' own counts are joined with them.
Items are scored in blocks of a bounded number of terms, each block against all
classes.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.decontaminate import normal_words
from tallyward.llm.shared import settled

# Parts the terms are numbered in; the driver sees one count of each.
_PARTS = 1024
# Scores are summed as doubles while no sum can leave their whole numbers.
_WHOLE = 2**53


def terms_of(text: str | None) -> Counter[str]:
    """A text's terms with their counts."""
    return Counter(w.decode() for w in normal_words(text))


def _counted(text: Column) -> Column:
    """The terms of a text as an array of (term, tf)."""

    @F.pandas_udf("array<struct<term:string,tf:int>>")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"term": t, "tf": n} for t, n in terms_of(text).items()] for text in texts]
        )

    return count(text)


def item_terms(benchmark: DataFrame) -> DataFrame:
    """``item_id, term, q``: how often an item has a term."""
    each = benchmark.select("item_id", F.inline(_counted(F.col("text"))))
    return each.groupBy("item_id", "term").agg(F.sum("tf").cast("long").alias("q"))


def _numbered(terms: DataFrame) -> DataFrame:
    """``term, number`` with numbers from 0 without gaps, whatever the order."""
    parted = terms.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(_PARTS)))
    sizes = dict(parted.groupBy("part").count().collect())
    starts, total = [], 0
    for part in range(_PARTS):
        starts.append(total)
        total += sizes.get(part, 0)
    before = F.element_at(F.array(*map(F.lit, starts)), (F.col("part") + 1).cast("int"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("term"))
    return parted.select("term", (before + place - 1).cast("long").alias("number"))


def _packed(pairs: list[tuple[int, int]]) -> bytes:
    """Term numbers in order, then their counts."""
    table = np.array(sorted(pairs), dtype=np.uint32).reshape(-1, 2)
    return table.T.tobytes()


def _unpacked(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    table = np.frombuffer(vector, dtype=np.uint32).reshape(2, -1)
    return table[0].astype(np.int64), table[1].astype(np.int64)


def _vectors(docs: DataFrame, terms: DataFrame, most_terms: int) -> DataFrame:
    """``doc_id, n, vector``: all terms of each document counted, and the counts of
    those in ``terms``."""
    docs = docs.select("doc_id", "text")
    if terms.count() <= most_terms:
        numbers = {r.term.encode(): r.number for r in terms.toLocalIterator()}
        sent = docs.sparkSession.sparkContext.broadcast(numbers)

        @F.pandas_udf("n long, vector binary")
        def restrict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            number = sent.value.get
            for batch in texts:
                rows = []
                for text in batch:
                    words = normal_words(text)
                    own = [(number(w), c) for w, c in Counter(words).items()]
                    rows.append((len(words), _packed([p for p in own if p[0] is not None])))
                yield pd.DataFrame(rows, columns=["n", "vector"])

        return docs.withColumn("_of", restrict("text")).select("doc_id", "_of.n", "_of.vector")

    rows = docs.select("doc_id", _counted(F.col("text")).alias("own"))
    rows = settled(rows.withColumn("row", F.monotonically_increasing_id()), "counts")
    n = F.aggregate("own", F.lit(0).cast("long"), lambda total, x: total + x["tf"])
    known = rows.select("row", F.inline("own")).join(terms, "term")
    known = known.groupBy("row").agg(F.collect_list(F.struct("number", "tf")).alias("pairs"))

    @F.pandas_udf("binary")
    def pack(batch: pd.Series) -> pd.Series:
        none: list = []  # a document without any of the terms
        return pd.Series(
            [
                _packed([(p["number"], p["tf"]) for p in (none if pairs is None else pairs)])
                for pairs in batch
            ]
        )

    joined = rows.select("row", "doc_id", n.alias("n")).join(known, "row", "left")
    return joined.select("doc_id", "n", pack("pairs").alias("vector"))


def _document_counts(vectors: DataFrame) -> DataFrame:
    """``number, df`` of every term that a document holds."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [_unpacked(v)[0] for v in batch["vector"]]
            if own:
                number, df = np.unique(np.concatenate(own), return_counts=True)
                yield pd.DataFrame({"number": number, "df": df})

    parts = vectors.select("vector").mapInPandas(count, "number long, df long")
    return parts.groupBy("number").agg(F.sum("df").alias("df"))


def classes(vectors: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``m, vector, members`` of each class of documents that score alike.

    ``members`` holds the ``k`` smallest ids of a class, a null id last; ids
    that occur several times are held several times.
    """
    # Decimals, as the product can leave 64 bits before it is divided.
    m = F.expr(
        f"25L + (cast({75 * n_docs} as decimal(27,0)) * cast(n as decimal(10,0)))"
        f" div cast({n_terms} as decimal(27,0))"
    )
    own = vectors.where(F.octet_length("vector") > 0).select("doc_id", m.alias("m"), "vector")
    own = own.withColumn("hash", F.xxhash64("m", "vector"))
    # The hash deals the classes out, the values themselves tell them apart.
    key = ["hash", "m", "vector"]
    order = [F.col("doc_id").asc_nulls_last()]
    first = own.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    first = first.where(F.col("_at") <= k)
    held = F.sort_array(F.collect_list(F.struct("_at", "doc_id")))
    return first.groupBy(*key).agg(held["doc_id"].alias("members")).drop("hash")


class Block:
    """Items and their terms, as sparse rows by term, for one pass over the classes."""

    def __init__(self, rows: list[tuple[object, int, int, int]]):
        """``rows``: item, term number, times in the item, weight of the term."""
        self.items = list(dict.fromkeys(r[0] for r in rows))
        at = {item: i for i, item in enumerate(self.items)}
        table = np.array(
            sorted((number, at[item], q, w) for item, number, q, w in rows), dtype=np.int64
        ).reshape(-1, 4)
        self.terms, self.starts, self.counts = np.unique(
            table[:, 0], return_index=True, return_counts=True
        )
        self.item, self.q = table[:, 1], table[:, 2]
        self.weight = table[self.starts, 3]
        # No term adds more than 1000000 times its weight.
        most = np.bincount(self.item, self.q * table[:, 3].astype(float), len(self.items))
        self.whole = float(most.max(initial=0)) * 1e6 < _WHOLE

    def postings(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms the block has, and which of ``number`` they are."""
        at = np.searchsorted(self.terms, number)
        at[at == len(self.terms)] = 0
        own = np.flatnonzero(self.terms[at] == number)
        return at[own], own

    def scores(
        self, row: np.ndarray, number: np.ndarray, tf: np.ndarray, m: np.ndarray, n_rows: int
    ) -> np.ndarray:
        """Scores of ``n_rows`` classes (rows) for the items (columns), from their
        terms: the row, number, count and ``m`` of each."""
        total = np.zeros(n_rows * len(self.items), dtype=np.int64)
        at, own = self.postings(number)
        row, tf, m = row[own], tf[own], m[own]
        gain = self.weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        counts = self.counts[at]
        each = np.repeat(np.arange(len(at)), counts)
        place = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
        place += self.starts[at][each]
        cell = row[each] * len(self.items) + self.item[place]
        value = gain[each] * self.q[place]
        if self.whole:
            total += np.bincount(cell, value, len(total)).astype(np.int64)
        else:
            np.add.at(total, cell, value)
        return total.reshape(n_rows, len(self.items))


def _ranked(score: int, doc: object) -> tuple:
    return (-score, doc is None, 0 if doc is None else doc)


def best_of(
    batches: Iterator[pd.DataFrame], block: Block, k: int, most_pairs: int
) -> list[list[tuple]]:
    """For each item of the block the ``k`` best documents of some classes."""
    best: list[list[tuple]] = [[] for _ in block.items]
    least = np.ones(len(block.items), dtype=np.int64)  # a score must be above nought
    for batch in batches:
        vectors = [_unpacked(v) for v in batch["vector"]]
        sizes = np.array([len(v[0]) for v in vectors])
        number = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        tf = np.concatenate([v[1] for v in vectors]) if vectors else number
        ends = np.cumsum(sizes)
        # Pairs of a term and an item that each class brings; classes go on together
        # while these, and the cells they are summed in, are at most ``most_pairs``.
        at, own = block.postings(number)
        brought = np.zeros(len(number), dtype=np.int64)
        brought[own] = block.counts[at]
        work = np.concatenate([[0], np.cumsum(brought)])[np.concatenate([[0], ends])]
        first = 0
        while first < len(batch):
            last = int(np.searchsorted(work, work[first] + most_pairs, side="right")) - 1
            last = min(last, first + max(1, most_pairs // len(block.items)), len(batch))
            last = max(last, first + 1)
            span = slice(ends[first] - sizes[first], ends[last - 1])
            row = np.repeat(np.arange(last - first), sizes[first:last])
            m = np.repeat(batch["m"].to_numpy()[first:last], sizes[first:last])
            found = block.scores(row, number[span], tf[span], m, last - first)
            bar = least
            if len(found) > k:
                # Every class has a document, so k better classes are k better documents.
                bar = np.maximum(bar, np.partition(found, -k, axis=0)[-k])
            near: dict[int, list[tuple]] = {}
            for i, j in zip(*np.nonzero(found >= bar)):
                score = int(found[i, j])
                near.setdefault(int(j), []).extend(
                    _ranked(score, doc) for doc in batch["members"].iloc[first + int(i)]
                )
            for j, more in near.items():
                best[j] = heapq.nsmallest(k, best[j] + more)
                if len(best[j]) == k:
                    least[j] = max(1, -best[j][-1][0])
            first = last
    return best


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    k: int = 10,
    most_terms: int = 200_000,
    block_terms: int = 50_000,
    most_pairs: int = 2_000_000,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents.

    Equal scores rank by ascending ``doc_id``, a null id last; every row of
    ``docs`` is a document of its own, so a repeated row can rank repeatedly. All
    rows of one ``item_id`` are one item, their terms taken together; a null id
    is an id like any other. Null and empty texts have no terms: such documents
    are not counted and never found, such items find nothing. Empty tables give
    an empty result. Only ``doc_id``, ``item_id`` and the texts are read.

    ``most_terms`` bounds the terms sent to every task, ``block_terms`` is about
    how many terms of items one pass over the classes scores, and ``most_pairs``
    bounds a task's memory; none of them changes the result.
    """
    spark = docs.sparkSession
    kinds = {"item": benchmark.schema["item_id"].dataType, "doc": docs.schema["doc_id"].dataType}
    asked = settled(item_terms(benchmark), "items")
    terms = settled(_numbered(asked.select("term").distinct()), "terms")
    vectors = settled(_vectors(docs, terms, most_terms), "vectors")
    n_docs, n_terms = vectors.where("n > 0").agg(F.count("n"), F.sum("n")).first()
    out = f"item_id {kinds['item'].simpleString()}, doc_id {kinds['doc'].simpleString()}, score long"
    if not n_docs:
        none = spark.createDataFrame([], out)
        return none.select("item_id", F.lit(1).alias("rank"), "doc_id", "score")
    share = (2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df") + 1)
    weighted = asked.join(terms, "term").join(_document_counts(vectors), "number")
    weighted = settled(
        weighted.select("item_id", "number", "q", F.floor(1000 * F.log(share)).alias("w")),
        "weights",
    )
    found = classes(vectors, n_docs, n_terms, k)
    blocks = max(1, -(-weighted.count() // block_terms))
    if blocks > 1:
        found = settled(found, "classes")

    def scored(rows: list[tuple]) -> DataFrame:
        sent = spark.sparkContext.broadcast(Block(rows))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = best_of(batches, sent.value, k, most_pairs)
            rows = [
                (item, None if missing else doc, -score)
                for item, ranked in zip(sent.value.items, held)
                for score, missing, doc in ranked
            ]
            yield pd.DataFrame(rows, columns=["item_id", "doc_id", "score"], dtype=object)

        return found.select("m", "vector", "members").mapInPandas(best, out)

    whole = spark.createDataFrame([], out)
    for block in range(blocks):
        own = weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = [tuple(r) for r in own.select("item_id", "number", "q", "w").toLocalIterator()]
        if rows:
            whole = whole.unionAll(scored(rows))
    place = F.row_number().over(
        Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    )
    return (
        whole.withColumn("rank", place)
        .where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )
