"""Lines of a large run key, against all pairs."""

from tallyward.llm import line_dedup

from . import brute


def test_partners_beside_the_leads_of_a_key_are_found(spark):
    """Similar lines that share the runs of a phrase of many lines and no other run,
    and are like neither lead of these."""
    phrase = "all of the rest is told below"
    rows = [(i, f"{phrase} a{i} b{i} c{i}") for i in range(30)]
    rows += [(100 + i, f"{phrase} x{i} y{i} c{i}") for i in range(5, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(df).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(brute.line_dedup(rows))
    assert sum(t != "" for _, t in got) == 30


def test_sifting_keeps_what_is_wanted_and_few_others(spark):
    wanted = spark.range(0, 200_000, 4)
    got = {r.id for r in line_dedup._sifted(spark.range(200_000), wanted, "id").collect()}
    assert got >= set(range(0, 200_000, 4))
    # A slot of a million is taken by one wanted value in twenty.
    assert len(got) - 50_000 < 150_000 / 15


def test_lines_that_share_several_keys_and_words_meet_once(spark):
    """As many rows as pairs, whatever number of keys and rare words two lines share."""
    shared = "abcdefgh"
    lines = [(i, shared + chr(0x4E00 + i)) for i in range(12)]
    coded = spark.createDataFrame(lines, "node long, coded string")
    placed = [(key, i, i) for i in range(12) for key in (5, 6, 7)]
    mixed = spark.createDataFrame(placed, "key long, node long, root long")
    pairs = line_dedup._by_rare_words(mixed, coded, 0.5).collect()
    assert len(pairs) == 12 * 11 / 2
    assert {(r.a, r.b) for r in pairs} == {(a, b) for a in range(12) for b in range(a)}
    # Lines of one component, or without a common key, do not meet.
    apart = [(i % 2, i, i // 4) for i in range(12)]
    mixed = spark.createDataFrame(apart, "key long, node long, root long")
    pairs = {(r.a, r.b) for r in line_dedup._by_rare_words(mixed, coded, 0.5).collect()}
    assert pairs == {
        (a, b) for a in range(12) for b in range(a) if a % 2 == b % 2 and a // 4 != b // 4
    }
