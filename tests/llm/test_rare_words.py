"""Words outside the vocabulary of the language model."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyward.llm import lm_scoring


def test_words_of_a_bucket_share_its_probability(spark):
    shape = lm_scoring.Shape(classes=2, members=4, buckets=4, size=2, reach=1)
    common = "a a a a a b b b b c c c d d"
    data = [(i, f"{common} often{i % 3}") for i in range(60)] + [(100, f"{common} qzx")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    counted = lm_scoring.count_words(df)
    words, _ = lm_scoring.train(df, shape, counted=counted)
    shares = lm_scoring.word_shares(counted, list(words.numbers), 4)
    # The words of a bucket have its probability together, no more.
    n = {r.word: r.n for r in counted.collect()}
    for r in shares.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(4))).groupBy("bucket").agg(
        F.sum(F.exp("log_share")).alias("whole")
    ).collect():
        assert abs(r.whole - 1) < 1e-9
    for r in shares.collect():
        assert r.word.encode() not in words.numbers
        own = lm_scoring._bucket(r.word.encode(), 4)
        total = sum(k for w, k in n.items() if w.encode() not in words.numbers and lm_scoring._bucket(w.encode(), 4) == own)
        assert abs(r.log_share - math.log(n[r.word] / total)) < 1e-9
    # A word seen once never is likelier than a frequent one of its bucket.
    own = lm_scoring._bucket(b"once", 4)
    twin = next(f"qz{i}" for i in range(99) if lm_scoring._bucket(f"qz{i}".encode(), 4) == own)
    pair = [(i, "once " * 9) for i in range(40)] + [(50, f"{twin} " * 9)]
    shape = lm_scoring.Shape(classes=1, members=4, buckets=4, size=2, reach=1)
    rows = lm_scoring.score(spark.createDataFrame(pair, "doc_id long, text string"), shape)
    by = {r.doc_id: r.mean_log_prob for r in rows.collect()}
    assert by[50] < by[0] - 1


@pytest.mark.parametrize("listed", [0, 3, 200_000])
def test_scores_equal_a_plain_loop(spark, listed):
    """Each token's probability written out, whatever number of words is listed."""
    shape = lm_scoring.Shape(classes=2, members=4, buckets=4, size=3, reach=2)
    texts = ["a b a c d e f", "B a  g\th a", "", "e", None, "x y z a b c d rare words here"]
    texts = [(i, t) for i, t in enumerate(texts)] + [(9, "a b c d " * 30)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    words, net = lm_scoring.train(df, shape, listed=listed)
    assert len(words.slots) <= len(words.numbers) + listed
    counts, totals = {}, {}
    for _, t in texts:
        for w in (t or "").lower().split():
            counts[w] = counts.get(w, 0) + 1
    for w, n in counts.items():
        if w.encode() not in words.numbers:
            b = lm_scoring._bucket(w.encode(), 4)
            totals[b] = totals.get(b, 0) + n

    def log_softmax(values, at):
        top = max(values)
        return values[at] - top - math.log(sum(math.exp(v - top) for v in values))

    def dot(a, b):
        return sum(float(x) * float(y) for x, y in zip(a, b))

    def plain(text):
        own, total = (text or "").lower().split(), 0.0
        ids = [words.numbers.get(w.encode(), 4 + lm_scoring._bucket(w.encode(), 4)) for w in own]
        for i, (w, token) in enumerate(zip(own, ids)):
            hidden = [0.0] * 3
            for p, step in enumerate((-2, -1, 1, 2)):
                if 0 <= i + step < len(ids):
                    for d in range(3):
                        hidden[d] += float(net.embed[ids[i + step], d]) * float(net.place[p, d])
            hidden = [math.tanh(h) for h in hidden]
            c, m = divmod(token, 4)
            total += log_softmax([dot(net.top[k], hidden) + float(net.top_bias[k]) for k in range(2)], c)
            low = [dot(net.low[c, k], hidden) + float(net.low_bias[c, k]) for k in range(4)]
            total += log_softmax(low, m)
            if w.encode() not in words.numbers:
                total += math.log(counts[w] / totals[token - 4])
        return total

    got = {r.doc_id: r for r in lm_scoring.score(df, shape, listed=listed).collect()}
    for i, t in texts:
        assert got[i].n_tokens == len((t or "").split())
        assert got[i].log_prob == pytest.approx(plain(t), rel=1e-4, abs=1e-4)


def test_choices_are_rows_and_places_columns():
    x = np.random.default_rng(2).normal(0, 3, (5, 7)).astype(np.float32)
    goal = np.arange(7) % 5
    whole = np.exp(x.astype(np.float64)).sum(axis=0)
    logs, odds, total = lm_scoring._choice(x.copy(), goal)
    assert logs == pytest.approx(x[goal, np.arange(7)] - np.log(whole), abs=1e-5)
    assert odds / total == pytest.approx(np.exp(x) / whole, abs=1e-6)
