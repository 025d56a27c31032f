"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources get target sizes, targets become whole numbers of equal-token blocks by
highest quotients, and so do the shares of a source's shards. Within a shard,
documents lie in a seeded order and are cut into blocks; a seeded permutation of
the block numbers says which blocks the quota takes, and how often. A document
gets the words it has in the blocks taken.

The words of every document are counted once. The driver sees totals of sources
and shards only; the number of shards has a bound that does not grow with the
data, and a large source has more of them, so no window holds a source.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.shared import blank_words, settled

WEIGHTS = (5, 2, 1)
_PRIME = 2_147_483_629


def targets(
    sizes: Sequence[int], weights: Sequence[float], total: Fraction, most: int = 2
) -> list[Fraction]:
    """Shares of ``total`` by weight, none above ``most`` times its size.

    What a full source cannot take goes to the others by weight, until none is
    above its bound.
    """
    found: list[Fraction | None] = [None] * len(sizes)
    left, open_ = Fraction(total), list(range(len(sizes)))
    while open_:
        weight = sum(Fraction(weights[i]) for i in open_)
        full = [i for i in open_ if left * Fraction(weights[i]) > most * sizes[i] * weight]
        if not full:
            for i in open_:
                found[i] = left * Fraction(weights[i]) / weight
            break
        for i in full:
            found[i] = Fraction(most * sizes[i])
        left -= sum(found[i] for i in full)
        open_ = [i for i in open_ if found[i] is None]
    return found


def sainte_lague(votes: Sequence[Fraction | int], seats: int) -> list[int]:
    """``seats`` dealt by the highest quotients ``votes / 1, votes / 3, ...``.

    Equal quotients go to the one listed first. The quotient at which the seats
    run out is found by halving, so the work does not grow with the seats.
    """
    votes = [Fraction(v) for v in votes]
    if not seats or not sum(votes):
        return [0] * len(votes)

    def dealt(quotient: Fraction) -> list[int]:  # seats with at least this quotient
        return [int((v / quotient + 1) // 2) for v in votes]

    scale = sum(votes)
    low, high = scale / (4 * seats + 4 * len(votes)), 2 * scale
    for _ in range(200):
        middle = Fraction((low + high) / 2).limit_denominator(1 << 62)
        if middle in (low, high):
            break
        if sum(dealt(middle)) >= seats:
            low = middle
        else:
            high = middle
        if sum(dealt(low)) == seats:
            return dealt(low)
    found = dealt(high)
    best = sorted(range(len(votes)), key=lambda i: (-votes[i] / (2 * found[i] + 1), i))
    for i in best[: seats - sum(found)]:
        found[i] += 1
    return found


def _place(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _shards(sizes: Sequence[int], block: int, most: int, blocks: int = 4096) -> list[int]:
    """Shards of each source: ``blocks`` blocks each, ``most`` in all at most,
    and one for each source besides."""
    each = max(blocks * block, -(-sum(sizes) // most))
    return [max(1, size // each) for size in sizes]


def mix(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``docs``.

    Size is the number of words between ASCII blanks; null text has none.
    Sources in code point order, the null source last, take ``weights`` in turn
    and share ``share`` times all words, each at most ``most`` times its own.
    ``taken`` counts words with repeats, at most ``most`` times the size. Documents
    without words are taken 0 times. Repeated rows are rows of their own and may
    be taken differently;
    reruns agree. An empty table gives an empty one. Only ``doc_id``, ``text``
    and ``source`` are read. ``options`` are those of ``_mixed``.
    """
    return _mixed(docs, **options).drop("place")


def _mixed(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    seed: int = 7,
    most_shards: int = 4096,
    most_block: int = 1024,
) -> DataFrame:
    """The rows of ``mix`` and their ``place`` in the seeded order.

    A block has one millionth of all words, 1 at least and ``most_block`` at most.
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        "source",
        F.size(blank_words(F.col("text"))).cast("long").alias("size"),
        _place(seed).alias("place"),
    )
    rows = settled(rows, "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("words")).collect()
    # Python orders text by code point.
    totals = sorted(totals, key=lambda r: (r.source is None, r.source or ""))
    names, sizes = [r.source for r in totals], [r.words for r in totals]
    weight = [weights[i % len(weights)] for i in range(len(names))]
    goal = targets(sizes, weight, Fraction(share) * sum(sizes), most)
    block = min(most_block, max(1, sum(sizes) >> 20))
    quotas = sainte_lague(goal, round(sum(goal) / block))
    n_shards = _shards(sizes, block, most_shards)

    by_source = spark.createDataFrame(
        [
            (i, name, size, float(target), n)
            for i, (name, size, target, n) in enumerate(zip(names, sizes, goal, n_shards))
        ],
        "source_no int, source_name string, source_size long, target double, n_shards int",
    )
    placed = rows.join(
        F.broadcast(by_source), F.col("source").eqNullSafe(F.col("source_name"))
    ).select(
        "doc_id", "size", "place", "source_no", "source_size", "target",
        F.pmod(F.xxhash64(F.lit(seed + 1), "place"), "n_shards").cast("int").alias("shard"),
    )
    held = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("words")).collect()
    by_shard = []
    for no, (name, target) in enumerate(zip(names, goal)):
        own = sorted((r.shard, r.words) for r in held if r.source_no == no)
        full = target == most * sizes[no]
        deals = sainte_lague([w for _, w in own], quotas[no])
        for (shard, words), quota in zip(own, deals):
            n = -(-words // block)
            quota = most * n if full else min(quota, most * n)
            by_shard.append((no, shard, max(n, 1), quota // max(n, 1), quota % max(n, 1)))
    by_shard = spark.createDataFrame(
        by_shard, "source_no int, shard int, n_blocks long, times long, extra long"
    )

    line = Window.partitionBy("source_no", "shard").orderBy("place", "doc_id", "size")
    line = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = (
        placed.withColumn("end", F.sum("size").over(line))
        .withColumn("start", F.col("end") - F.col("size"))
        .join(F.broadcast(by_shard), ["source_no", "shard"])
    )
    # Multiplying by a prime above the number of blocks permutes their numbers.
    lot = f"pmod(b * {_PRIME} + xxhash64({seed}, source_no, shard) % {_PRIME}, n_blocks)"
    taken = f"""
        times * size + if(size = 0 OR extra = 0, 0L, aggregate(
          sequence(start div {block}, (end - 1) div {block}), 0L,
          (sum, b) -> sum + if({lot} < extra,
            least(end, (b + 1) * {block}) - greatest(start, b * {block}), 0L)))"""
    return laid.select(
        "doc_id", "size", "source_size", "target", F.expr(taken).alias("taken"), "place"
    )


def take(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The documents a mix takes any word of: all columns of ``docs``, and
    ``size``, ``source_size``, ``target`` and ``taken``.

    ``taken`` words are the whole text as often as they hold its size, and its
    first words for the rest. Repeated rows share what is taken of them, rounded
    down.
    """
    rows = _mixed(docs, seed=seed, **options).groupBy("place").agg(
        F.min("size").alias("size"),
        F.min("source_size").alias("source_size"),
        F.min("target").alias("target"),
        F.expr("sum(taken) div count(1)").alias("taken"),
    )
    names = ("size", "source_size", "target", "taken")
    rows = rows.where("taken > 0").withColumnRenamed("place", "_place")
    docs = docs.drop(*(n for n in names if n in docs.columns))
    return docs.join(rows, _place(seed) == F.col("_place")).drop("_place")
