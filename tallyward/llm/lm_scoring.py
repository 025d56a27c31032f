"""Masked pseudo-likelihood by a bidirectional window network in numpy.

Every token is predicted from the tokens on both sides: their embeddings, each
weighted by its place, are summed and pass a softmax over classes and one over
the class's tokens. The sum of the tokens' conditional log-probabilities scores
a document.

Spark counts the words of the whole corpus for the vocabulary, every partition
trains a network on all its tokens from the same start, the networks are
averaged by their tokens, and every text is scored with the average. What moves
are word counts and networks of fixed size, one a partition, averaged in two
steps so that no task meets all of them, and the words outside the vocabulary,
which meet their counts: each has its own part of its bucket's probability. The
most frequent of those words are sent along with the network, a fixed number of
them; the others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.shared import BLANKS, settled

_BATCH = 8192


@dataclass
class Shape:
    """Sizes of a network: ``classes * members`` tokens, the last ``buckets`` of
    them shared by hash among words outside the vocabulary."""

    classes: int = 32
    members: int = 64
    buckets: int = 256
    size: int = 16
    reach: int = 2

    @property
    def tokens(self) -> int:
        return self.classes * self.members

    @property
    def parts(self) -> list[tuple[int, ...]]:
        return [
            (self.tokens + 1, self.size),  # embeddings; the last one, of no token, stays 0
            (2 * self.reach, self.size),  # weights of the places
            (self.classes, self.size),
            (self.classes,),
            (self.classes, self.members, self.size),
            (self.classes, self.members),
        ]


class Network:
    def __init__(self, shape: Shape, values: np.ndarray):
        self.shape, at = shape, 0
        self.values = values.astype(np.float32)
        views = []
        for part in shape.parts:
            n = int(np.prod(part))
            views.append(self.values[at : at + n].reshape(part))
            at += n
        (self.embed, self.place, self.top, self.top_bias, self.low, self.low_bias) = views

    @classmethod
    def start(cls, shape: Shape, counts: np.ndarray, seed: int = 3) -> Network:
        """Small random weights; the biases give the tokens' own frequencies."""
        total = sum(int(np.prod(p)) for p in shape.parts)
        net = cls(shape, np.random.default_rng(seed).normal(0, 0.1, total))
        table = counts.reshape(shape.classes, shape.members) + 1.0
        net.embed[-1] = 0
        net.place[:] = 1
        net.top_bias[:] = np.log(table.sum(axis=1) / table.sum())
        net.low_bias[:] = np.log(table / table.sum(axis=1, keepdims=True))
        return net

    def around(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tokens beside the places ``at``, a column for each neighbour."""
        reach = self.shape.reach
        steps = [*range(-reach, 0), *range(1, reach + 1)]
        return ids[at[:, None] + np.array(steps)]

    def step(self, ids: np.ndarray, at: np.ndarray, rate: float = 0.0) -> np.ndarray:
        """Log-probabilities of the tokens at ``at``; with a rate, one gradient
        step on them as well."""
        near, goal = self.around(ids, at), ids[at]
        group, member = goal // self.shape.members, goal % self.shape.members
        seen = self.embed[near]
        hidden = np.tanh(np.einsum("bpd,pd->bd", seen, self.place))
        logs, top, whole = _choice(self.top @ hidden.T + self.top_bias[:, None], group)
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order], np.arange(self.shape.classes + 1))
        back = np.zeros_like(hidden)
        # A place's update is the mean over a batch of few rows, less for frequent tokens.
        for c in range(self.shape.classes):
            own = order[ends[c] : ends[c + 1]]
            if not len(own):
                continue
            inner, goals = hidden[own], member[own]
            picked, low, total = _choice(self.low[c] @ inner.T + self.low_bias[c][:, None], goals)
            logs[own] += picked
            if rate:
                low /= total
                low[goals, np.arange(len(own))] -= 1
                back[own] = low.T @ self.low[c]
                self.low[c] -= rate * (low @ inner) / _spread(len(own))
                self.low_bias[c] -= rate * low.sum(axis=1) / _spread(len(own))
        if rate:
            top /= whole
            top[group, np.arange(len(at))] -= 1
            back += top.T @ self.top
            self.top -= rate * (top @ hidden) / _spread(len(at))
            self.top_bias -= rate * top.sum(axis=1) / _spread(len(at))
            back *= 1 - hidden**2
            spread = back[:, None, :] * self.place
            self.place -= rate * np.einsum("bd,bpd->pd", back, seen) / _spread(len(at)) ** 2
            flat, size = near.ravel(), len(self.embed)
            often = np.sqrt(np.bincount(flat, minlength=size) + 1.0)
            by_size = np.ascontiguousarray(spread.reshape(-1, self.shape.size).T)
            for d in range(self.shape.size):
                total = np.bincount(flat, by_size[d], size)
                self.embed[:, d] -= rate * total / often
            self.embed[-1] = 0
        return logs


def _spread(n: int) -> float:
    """Gradients of a batch are summed and divided by the root of its rows."""
    return float(np.sqrt(n))


def _choice(x: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probabilities of ``goal``, a choice (row of ``x``) for each column; in place of
    ``x``, numbers in proportion to the probabilities of all choices, and their sums.

    Columns are the places of a batch, so that numpy takes many of them at once.
    """
    x -= x.max(axis=0)
    picked = x[goal, np.arange(x.shape[1])]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    return picked - np.log(total), x, total


def _bucket(word: bytes, buckets: int) -> int:
    """The bucket of a word outside the vocabulary, as ``word_shares`` counts it."""
    h = xxhash.xxh64_intdigest(word, 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


@dataclass
class Vocabulary:
    """Numbers of the words a network knows; for further, listed words their
    bucket's number and the logarithm of their part of it."""

    numbers: dict[bytes, int]
    shape: Shape
    slots: dict[bytes, int] = field(default_factory=dict)
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    shares: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def of(cls, known: list[bytes], listed: list[tuple[bytes, float]], shape: Shape) -> Vocabulary:
        first = shape.tokens - shape.buckets
        words = [*known, *(w for w, _ in listed)]
        tokens = [*range(len(known)), *(first + _bucket(w, shape.buckets) for w, _ in listed)]
        shares = [*([0.0] * len(known)), *(s for _, s in listed)]
        return cls(
            {w: i for i, w in enumerate(known)},
            shape,
            {w: i for i, w in enumerate(words)},
            np.array(tokens, dtype=np.int64),
            np.array(shares, dtype=np.float64),
        )

    def look_up(self, text: str) -> tuple[np.ndarray, float, list[bytes]]:
        """Numbers of the lower-cased words between ASCII blanks, the sum of the
        listed words' logarithms, and the words not listed, repeats included."""
        words = text.encode().lower().split()
        slots = np.fromiter(map(self.slots.get, words, repeat(-1)), np.int64, len(words))
        others = np.flatnonzero(slots < 0).tolist()
        if not others:
            return self.tokens[slots], float(self.shares[slots].sum()), []
        rare = [words[i] for i in others]
        first, buckets = self.shape.tokens - self.shape.buckets, self.shape.buckets
        ids = np.empty(len(words), dtype=np.int64)
        inside = slots >= 0
        ids[inside] = self.tokens[slots[inside]]
        ids[others] = [first + _bucket(w, buckets) for w in rare]
        return ids, float(self.shares[slots[inside]].sum()), rare

    def line_up(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens in a row with gaps between texts, the places of tokens,
        and the tokens of each text."""
        gap = np.full(self.shape.reach, self.shape.tokens, dtype=np.int64)
        ids = np.concatenate([part for row in rows for part in (gap, row)] + [gap])
        return ids, np.flatnonzero(ids < self.shape.tokens), np.array([len(r) for r in rows])


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts, ASCII letters in lower case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = docs.select(F.explode(F.split("text", BLANKS)).alias("word")).where("word != ''")
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy(F.translate("word", upper, lower).alias("word")).agg(
        F.sum("n").alias("n")
    )


def word_shares(counted: DataFrame, known: list[bytes], buckets: int) -> DataFrame:
    """``word, n, log_share`` of every counted word but the ``known``: the
    logarithm of its part of its bucket's occurrences."""
    spark = counted.sparkSession
    names = spark.createDataFrame([(w.decode(),) for w in known], "word string")
    rare = counted.join(names, "word", "left_anti").withColumn(
        "bucket", F.pmod(F.xxhash64("word"), F.lit(buckets))
    )
    totals = rare.groupBy("bucket").agg(F.sum("n").alias("total"))
    return rare.join(F.broadcast(totals), "bucket").select(
        "word", "n", F.log(F.col("n") / F.col("total")).alias("log_share")
    )


def train(
    docs: DataFrame,
    shape: Shape | None = None,
    rate: float = 0.05,
    groups: int = 64,
    counted: DataFrame | None = None,
    listed: int = 200_000,
):
    """``(vocabulary, network)`` from every token of ``docs``.

    The vocabulary has the most frequent words; ties go by the word. The next
    ``listed`` words have their parts of their buckets listed with it. Partitions
    train alone and their networks are averaged by their numbers of tokens.
    """
    shape = shape or Shape()
    counted = count_words(docs) if counted is None else counted
    top = counted.orderBy(F.desc("n"), "word").limit(shape.tokens - shape.buckets).collect()
    total = counted.agg(F.sum("n")).first()[0] or 0
    known = [r.word.encode() for r in top]
    next_ = word_shares(counted, known, shape.buckets).orderBy(F.desc("n"), "word").limit(listed)
    words = Vocabulary.of(
        known, [(r.word.encode(), r.log_share) for r in next_.toLocalIterator()], shape
    )
    counts = np.zeros(shape.tokens)
    counts[: len(top)] = [r.n for r in top]
    counts[-shape.buckets :] = (total - counts.sum()) / shape.buckets
    start = Network.start(shape, counts)
    sent = docs.sparkSession.sparkContext.broadcast((words, start.values))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, values = sent.value
        net, tokens = Network(words.shape, values.copy()), 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                texts = batch["text"].iloc[at : at + 256]
                ids, places, _ = words.line_up([words.look_up(t or "")[0] for t in texts])
                for i in range(0, len(places), _BATCH):
                    net.step(ids, places[i : i + _BATCH], rate)
                tokens += len(places)
        if tokens:
            pieces = np.array_split(net.values.astype(np.float64) * tokens, 16)
            yield pd.DataFrame(
                {"piece": range(16), "tokens": float(tokens), "total": [p.tolist() for p in pieces]}
            )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        first = rows.iloc[0]
        total = np.sum(np.stack(rows["total"].to_list()), axis=0)
        return pd.DataFrame(
            {
                "piece": [first["piece"]],
                "part": [first["part"]],
                "tokens": [rows["tokens"].sum()],
                "total": [total.tolist()],
            }
        )

    kinds = "piece int, tokens double, total array<double>"
    nets = docs.select("text").mapInPandas(learn, kinds)
    nets = nets.withColumn("part", F.spark_partition_id().cast("long"))
    nets = settled(nets.select("piece", "part", "tokens", "total"), "networks")
    kinds = "piece int, part long, tokens double, total array<double>"
    some = nets.groupBy("piece", F.pmod("part", F.lit(groups))).applyInPandas(
        lambda key, rows: add(rows), kinds
    )
    whole = some.groupBy("piece").applyInPandas(add, kinds).orderBy("piece").collect()
    if not whole:
        return words, start
    return words, Network(
        shape, np.concatenate([np.array(r.total) / r.tokens for r in whole])
    )


def score(
    docs: DataFrame, shape: Shape | None = None, rate: float = 0.05, listed: int = 200_000
) -> DataFrame:
    """``doc_id, n_tokens, log_prob, mean_log_prob`` of every row of ``docs``.

    ``log_prob`` is the sum of the natural logarithms of each token's
    probability given its neighbours; a word outside the vocabulary has its
    part, by its count, of its bucket's probability. ``listed`` of these words, the
    most frequent, are sent to all tasks; the others are joined, so the number
    changes what is moved and no score. Null, empty and wordless texts have no
    tokens, the sum 0 and a null mean. Repeated rows get equal scores; an empty
    table gives an empty one. Only ``doc_id`` and ``text`` are read.
    """
    docs = docs.select("doc_id", "text")
    counted = settled(count_words(docs), "counts")
    words, net = train(docs, shape, rate, counted=counted, listed=listed)
    shares = word_shares(counted, list(words.numbers), words.shape.buckets)
    sent = docs.sparkSession.sparkContext.broadcast((words, net.values))

    @F.pandas_udf("n_tokens long, log_prob double, rare array<string>")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, values = sent.value
        net = Network(words.shape, values)
        for batch in texts:
            parts = []
            for at in range(0, len(batch), 256):
                looked = [words.look_up(t or "") for t in batch.iloc[at : at + 256]]
                ids, places, sizes = words.line_up([found for found, _, _ in looked])
                logs = [
                    net.step(ids, places[i : i + _BATCH]) for i in range(0, len(places), _BATCH)
                ]
                sums = np.concatenate([[0.0], np.cumsum(np.concatenate([[], *logs]))])
                ends = np.cumsum(sizes)
                parts.append(
                    pd.DataFrame(
                        {
                            "n_tokens": sizes,
                            "log_prob": sums[ends] - sums[ends - sizes] + [s for _, s, _ in looked],
                            "rare": [[w.decode() for w in rare] for _, _, rare in looked],
                        }
                    )
                )
            none = {"n_tokens": [], "log_prob": [], "rare": []}
            yield pd.concat(parts) if parts else pd.DataFrame(none)

    found = docs.select("doc_id", scored("text").alias("_scored")).select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", "_scored.*"
    )
    found = settled(found, "scored")
    rare = found.select("_row", F.explode("rare").alias("word")).join(shares, "word")
    # Decimals add up to the same in any order.
    rare = rare.groupBy("_row").agg(
        F.sum(F.col("log_share").cast("decimal(28,12)")).cast("double").alias("_shares")
    )
    found = found.drop("rare").join(rare, "_row", "left").withColumn(
        "log_prob", F.col("log_prob") + F.coalesce("_shares", F.lit(0.0))
    )
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return found.select("doc_id", "n_tokens", "log_prob").withColumn("mean_log_prob", mean)
