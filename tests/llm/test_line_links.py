"""Links of lines that share a fingerprint, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tallyward.llm import line_dedup

from . import brute

LEAD = "a b c d e f g h i j"
TURNED = "j i h g f e d c b a"
LONG = [f"w{i}" for i in range(60)]
FAR = [*LONG[30:], *LONG[:30]]


@pytest.mark.parametrize(
    "texts",
    [
        [LEAD, LEAD, LEAD, TURNED, TURNED + " a"],
        [" ".join(x) for x in (LONG, LONG, FAR, FAR[:59], FAR[::-1], [*FAR[::-1], "w0"])],
    ],
)
def test_lines_of_the_same_words_are_linked_beside_the_lead(spark, texts):
    rows = list(enumerate(texts))
    want = brute.line_dedup(rows)
    assert sum(t != "" for _, t in want) < len(set(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(df).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_planted_edits_are_found(spark):
    """A word replaced, left out or put in, in lines of 5 to 40 words; a fifth changed."""
    draw, rows, pairs = random.Random(4), [], 0
    for i in range(400):
        n = draw.randrange(5, 41)
        line = [f"w{draw.randrange(4000)}" for _ in range(n)]
        near = list(line)
        for _ in range(1 if i % 4 else max(1, n // 5)):
            at, kind = draw.randrange(len(near)), draw.randrange(3)
            near[at : at + (kind != 2)] = [] if kind == 1 else [f"x{draw.randrange(4000)}"]
        far = brute.edit_distance(line, near) > int(max(len(line), len(near)) * 0.2 + 1e-9)
        pairs += not far
        rows += [(i, " ".join(line)), (1000 + i, "KEPT" if far else " ".join(near))]
    df = spark.createDataFrame([r for r in rows if r[1] != "KEPT"], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert all(got[i] for i in range(400))
    found = sum(not got[1000 + i] for i in range(400) if 1000 + i in got)
    assert found >= 0.9 * pairs, (found, pairs)


def test_lines_around_a_common_phrase_do_not_pair_up(spark):
    """A phrase in many unlike lines brings them to one key, not into all pairs."""
    phrase = "all of the rest is told below"
    rows = [(i, f"{phrase} {' '.join(f'u{i}v{k}' for k in range(3 + i % 3))}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_dedup.line_prints(df).withColumn("node", F.monotonically_increasing_id())
    assert line_dedup._by_runs(lines.withColumn("n", F.lit(1)), 0.0).count() <= 2 * 3 * 200
    assert sorted(map(tuple, line_dedup.dedup_lines(df).select("doc_id", "text").collect())) == rows
