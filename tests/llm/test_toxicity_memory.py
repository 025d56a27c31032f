"""What the toxicity operator holds at a time."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyward.llm import toxicity


def test_long_words_are_compared_in_bounded_parts():
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefgh") for _ in range(24)) for _ in range(2500)]
    marks = toxicity.Landmarks(["abcdefgh", "hgfedcba"])
    tracemalloc.start()
    found = marks.similarity(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.shape == (2500, 2)
    assert peak < 60_000_000


def test_texts_leave_arrow_a_few_at_a_time():
    texts = pa.array(["a", None, "c"] * 100)
    parts = list(toxicity._parts(texts))
    assert max(map(len, parts)) <= 128
    assert sum(parts, []) == ["a", "", "c"] * 100


def test_a_task_takes_words_out_of_texts_in_one_worker(spark):
    df = spark.range(9).select(F.concat(F.lit("some words "), "id").alias("text"))
    words = df.select(toxicity._tokens(F.col("text")).alias("words"))
    words = words.select(F.explode("words").alias("word")).where("length(word) >= 4")
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {r.word for r in words.collect()} == {"some", "words"}


def test_remembered_words_are_bounded():
    marks = toxicity.Landmarks([f"abc{i}defg" for i in range(100, 400)])
    known, kept = {}, []
    for at in range(0, 24000, 1000):
        marks.describe([" ".join(f"abc{i}def" for i in range(at, at + 1000))], known, kept)
        assert len(known) <= 151_000 and len(kept) * 300 <= 4_300_000


def test_sequences_are_looked_up_in_a_list_of_the_landmarks():
    """The list has the landmarks' sequences and no other; without it, and with letters
    of no landmark, similarities are the same, and those of the definition."""
    marks = toxicity.Landmarks(["idiot", "moron", "loser"])
    assert marks.listed.sum() == len(marks.features) and marks.listed[marks.features].all()
    words = ["idiot", "idixxot", "xxx", "i.d.i.o.t", "moros", "zebra", "lo一ser", "tori"]
    found = marks.similarity(words)
    marks.listed = None
    assert (marks.similarity(words) == found).all()
    for i, word in enumerate(words):
        table, own = toxicity.codes([word], -1), []
        for j, mark in enumerate(marks.words):
            keys, weight = marks._sequences(table)
            of, value = marks._sequences(toxicity.codes([mark], -1))
            same = (keys[0][:, None] == of[0]) & (keys[0][:, None] >= 0)
            own.append((weight[0][:, None] * value[0] * same).sum())
            own[j] /= (marks._own(table)[0] * marks._own(toxicity.codes([mark], -1))[0]) ** 0.5
        assert abs(found[i] - [v**marks.power for v in own]).max() < 1e-5
    assert found[0, 0] > 0.999 and not found[2].any()


def test_few_sequences_are_summed_without_a_table_of_all(monkeypatch):
    marks = toxicity.Landmarks(["idiot", "moron", "loser", "disgusting", "worthless"])
    row, at = np.array([0, 0, 2, 2, 2]), np.array([3, 5, 3, 3, 7])
    weight = np.array([0.5, 0.25, 1.0, 2.0, 0.125])
    whole = np.zeros((4, len(marks.features)))
    np.add.at(whole, (row, at), weight)
    monkeypatch.setattr(np, "bincount", None)
    found = marks._summed(row, at, weight, 4)
    assert abs(found - whole @ marks.weights).max() < 1e-6
    assert not marks._summed(row[:0], at[:0], weight[:0], 2).any()
