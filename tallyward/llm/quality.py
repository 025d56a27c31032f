"""Line-first cleaning: rules for each line, then a verdict on what is left.

A line that breaks a rule is taken out; a document that loses too much of its
text is rejected. All rules are Spark expressions over the one row: nothing is
shuffled and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.shared import blank_words

# Phrases of page furniture and licences, in lower case.
BOILERPLATE = (
    "all rights reserved|licensed under|terms of (use|service)|privacy policy|"
    "cookie policy|accept cookies|enable javascript|copyright (©|\\(c\\)|[0-9])|"
    "click here|sign up|log in|subscribe now|lorem ipsum"
)
# Signs that separate the entries of a menu or a table row.
NAVIGATION = "[|»›>]"
SYMBOLS = "[#*$%&|<>]"
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _count(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that match a pattern of one character."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_fails(
    line: Column,
    symbol_pct: int = 10,
    menu_pct: int = 20,
    distinct_pct: int = 30,
    boilerplate_words: int = 30,
) -> Column:
    """Whether a line with words breaks a rule.

    Punctuation: over ``symbol_pct`` % of its characters are symbols, or no
    letter or digit is in it. Navigation: ``menu_pct`` menu signs or more for
    each hundred words, three at least. Boilerplate: a phrase of BOILERPLATE in
    a line of at most ``boilerplate_words`` words. Repetition: ten words or
    more, under ``distinct_pct`` % of them distinct.
    """
    words = blank_words(line)
    n_words = F.size(words)
    menu = _count(line, NAVIGATION)
    return (
        (100 * _count(line, SYMBOLS) > symbol_pct * F.length(line))
        | ~line.rlike("[\\p{L}\\p{N}]")
        | ((menu >= 3) & (100 * menu >= menu_pct * n_words))
        | ((n_words <= boilerplate_words) & F.lower(line).rlike(BOILERPLATE))
        | ((n_words >= 10) & (100 * F.size(F.array_distinct(words)) < distinct_pct * n_words))
    )


def _judged(rows: DataFrame, keep_pct: int) -> DataFrame:
    """``rows`` with clean_text, n_failed_lines, lost_chars and accepted."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    judged = F.transform(
        "lines",
        lambda line: F.struct(
            line.alias("line"),
            (line.rlike(_HAS_WORD) & line_fails(line)).alias("failed"),
            F.when(line.rlike(_HAS_WORD), F.length(line)).otherwise(0).alias("n"),
        ),
    )

    def chars(which: Column) -> Column:
        return F.aggregate(which, F.lit(0), lambda total, x: total + x["n"]).cast("long")

    failed = F.filter("judged", lambda x: x["failed"])
    passed = F.filter("judged", lambda x: ~x["failed"])
    left = F.col("line_chars") - F.col("lost_chars")
    return (
        rows.withColumn("lines", lines)
        .withColumn("judged", judged)
        .drop("lines")
        .withColumns(
            {
                "clean_text": F.array_join(F.transform(passed, lambda x: x["line"]), "\n"),
                "n_failed_lines": F.size(failed).cast("long"),
                "lost_chars": chars(failed),
                "line_chars": chars(F.col("judged")),
            }
        )
        .withColumn("accepted", (left > 0) & (100 * left >= keep_pct * F.col("line_chars")))
        .drop("judged", "line_chars")
    )


def line_verdicts(docs: DataFrame, keep_pct: int = 50) -> DataFrame:
    """``doc_id, text, clean_text, n_failed_lines, lost_chars, accepted``.

    A document is accepted if its lines that pass hold at least ``keep_pct`` %
    of the characters of all its lines with words, and any word at all. Blank
    lines pass and stay. Null and empty texts have no words: they are not
    accepted, and their clean text is empty. Repeated rows give repeated rows;
    only ``doc_id`` and ``text`` are read.
    """
    return _judged(docs.select("doc_id", "text"), keep_pct)


def clean(docs: DataFrame, keep_pct: int = 50) -> DataFrame:
    """``doc_id`` and ``text`` of accepted documents, failing lines removed."""
    found = line_verdicts(docs, keep_pct).where("accepted")
    return found.select("doc_id", F.col("clean_text").alias("text"))


def base_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, text, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words`` of every row; null text has no words."""
    text = F.coalesce("text", F.lit(""))
    with_words = docs.select("doc_id", "text", blank_words(text).alias("words"))
    with_hashes = with_words.select(
        "*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")
    )
    n_windows = F.size("hashes") - 7
    with_windows = with_hashes.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0), lambda total, w: total + F.length(w))
        .cast("long")
        .alias("word_chars"),
        F.when(
            n_windows > 0,
            F.transform(
                F.sequence(F.lit(1), F.greatest(n_windows, F.lit(1))),
                lambda i: F.xxhash64(F.slice("hashes", i, 8)),
            ),
        ).alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    # Only a text with a repeat sorts its windows, each with its place.
    with_order = with_windows.withColumn(
        "ordered",
        F.when(
            repeats,
            F.sort_array(
                F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            ),
        ),
    ).drop("windows")
    equal = F.filter(
        "ordered",
        lambda x, i: F.coalesce(F.get("ordered", i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get("ordered", i + 1)["h"] == x["h"], F.lit(False)),
    )
    with_places = with_order.withColumn(
        "places", F.sort_array(F.transform(equal, lambda x: x["i"]))
    ).drop("ordered")
    covered = F.aggregate(
        F.transform(
            "places",
            lambda p, i: F.least(F.lit(8), F.coalesce(F.get("places", i + 1) - p, F.lit(8))),
        ),
        F.lit(0),
        lambda total, n: total + n,
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_HAS_WORD))
    return with_places.withColumn("lines", lines).select(
        "doc_id",
        "text",
        "n_words",
        "word_chars",
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def quality(docs: DataFrame, keep_pct: int = 50) -> DataFrame:
    """Counts and verdict of every row of ``docs``.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated
    windows. ``kept``: not ``base_failed`` and accepted by the line rules.
    Null and empty texts have no words and fail. Only ``doc_id`` and ``text``
    are read; repeated rows give repeated rows.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = _judged(base_counts(docs), keep_pct).withColumn("base_failed", failed)
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.col("accepted")).alias("kept"),
        "n_failed_lines",
        "lost_chars",
    )
