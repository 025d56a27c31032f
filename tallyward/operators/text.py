"""Frequencies of words and word pairs of short labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.recode import sql_literal
from tallyward.operators.counting import COUNT, count_by, distinct_values, regroup, settled, total

# English stop words.
STOP_WORDS = """
a about above after again against all also am an and any are aren't as at be
because been before being below between both but by can can't cannot com could
couldn't did didn't do does doesn't doing don't down during each else ever few
for from further get had hadn't has hasn't have haven't having he he'd he'll
he's hence her here here's hers herself him himself his how how's however http
i i'd i'll i'm i've if in into is isn't it it's its itself just k let's like me
more most mustn't my myself no nor not of off on once only or other otherwise
ought our ours ourselves out over own r same shall shan't she she'd she'll
she's should shouldn't since so some such than that that's the their theirs
them themselves then there there's therefore these they they'd they'll they're
they've this those through to too under until up very was wasn't we we'd we'll
we're we've were weren't what what's when when's where where's which while who
who's whom why why's with won't would wouldn't www you you'd you'll you're
you've your yours yourself yourselves
""".split()

# A word is a letter, digit or underscore followed by one or more
# of the same or apostrophes.
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"


def word_counts(
    df: DataFrame, column: str, stop_words: Sequence[str] = tuple(STOP_WORDS)
) -> DataFrame:
    """How often each word occurs over the distinct labels of a column.

    Case does not count, a possessive ending goes, numbers and stop words are
    left out. The stop list is a literal of the filter, not a join side.
    """
    stop_list = ", ".join(sql_literal(w) for w in stop_words)
    words = distinct_values(df, column).select(
        F.explode(F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0))).alias("word")
    )
    stems = words.select(F.regexp_replace("word", "'s$", "").alias("word"))
    kept = stems.filter(
        ~F.col("word").rlike(r"^\p{N}+$") & F.expr(f"word NOT IN ({stop_list})")
    )
    return count_by(kept, "word")


# Pairs scored above this are counted as one term; a share below the
# least is taken for it, so that its logarithm exists.
PAIR_THRESHOLD, LEAST_SHARE = 30.0, 1e-10


def _label_words(df: DataFrame, column: str) -> DataFrame:
    """``words``: those of each distinct label in order, without numbers."""
    found = F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0))
    stems = F.transform(found, lambda w: F.regexp_replace(w, "'s$", ""))
    return distinct_values(df, column).select(
        F.filter(stems, lambda w: ~w.rlike(r"^\p{N}+$")).alias("words")
    )


def _folded(counts: DataFrame, key: str) -> DataFrame:
    """``key, standard, count``: plurals that also occur without their s stand for
    the singular. Each key keeps its own count."""
    singular = F.when(
        F.col(key).endswith("s") & ~F.col(key).endswith("ss"), F.expr(f"left({key}, length({key}) - 1)")
    )
    known = counts.select(F.col(key).alias("_known"))
    joined = counts.withColumn("_singular", singular).join(
        known, F.col("_singular") == F.col("_known"), "left"
    )
    return joined.select(key, F.coalesce("_known", key).alias("standard"), COUNT)


def _log_likelihood(k: Column, n: Column, share: Column) -> Column:
    held = F.greatest(share, F.lit(LEAST_SHARE))
    rest = F.greatest(1 - share, F.lit(LEAST_SHARE))
    return k * F.log(held) + (n - k) * F.log(rest)


def pair_score(pair: Column, first: Column, second: Column, n: Column) -> Column:
    """Likelihood ratio of two words being together against being independent: from
    the counts of the pair and of each word among ``n`` words. A word that makes
    up all of the words is no sign of anything: 0."""
    alone = F.try_divide(second, n)
    after = F.try_divide(pair, first)
    apart = F.try_divide(second - pair, n - first)
    ratio = 2 * (
        _log_likelihood(pair, first, after)
        + _log_likelihood(second - pair, n - first, apart)
        - _log_likelihood(pair, first, alone)
        - _log_likelihood(second - pair, n - first, alone)
    )
    return F.when((n > first) & (n > second), ratio).otherwise(0.0)


def word_and_pair_counts(
    df: DataFrame,
    column: str,
    stop_words: Sequence[str] = tuple(STOP_WORDS),
    threshold: float = PAIR_THRESHOLD,
) -> DataFrame:
    """``word, count`` over the distinct labels of a column, with pairs as terms.

    As ``word_counts``, and plurals are counted with their singular if that occurs.
    Two words next to each other, neither a stop word, are a term of their own
    where ``pair_score`` is above ``threshold``; their count is then taken off both
    words. A term of which nothing is left is not listed. Pairs do not reach from
    one label into another. Every join is by a word between counts of words.
    """
    stop_list = ", ".join(sql_literal(w) for w in stop_words)
    labels = _label_words(df, column)
    words = labels.select(F.explode("words").alias("word")).filter(
        F.expr(f"word NOT IN ({stop_list})")
    )
    pairs = labels.select(
        F.explode(
            F.expr(
                "transform(sequence(1, greatest(size(words) - 1, 1)),"
                " i -> struct(get(words, i - 1) AS a, get(words, i) AS b))"
            )
        ).alias("pair")
    ).select("pair.*")
    pairs = pairs.filter(
        F.expr(f"b IS NOT NULL AND a NOT IN ({stop_list}) AND b NOT IN ({stop_list})")
    )
    forms = settled(_folded(count_by(words, "word"), "word"))
    singles = forms.groupBy("standard").agg(F.sum(COUNT).alias(COUNT))
    own = _folded(count_by(pairs.select(F.concat_ws(" ", "a", "b").alias("pair")), "pair"), "pair")
    together = own.groupBy("standard").agg(F.sum(COUNT).alias("both"))
    together = together.select(
        F.col("standard").alias("pair"), F.split("standard", " ").alias("_parts"), "both"
    )
    for place, side in enumerate(("first", "second")):
        form = forms.select(F.col("word").alias(f"_{side}"), F.col("standard").alias(side))
        counted = singles.select(F.col("standard").alias(side), F.col(COUNT).alias(f"n_{side}"))
        together = together.join(form, F.col("_parts")[place] == F.col(f"_{side}")).join(counted, side)
    score = pair_score(
        F.col("both"), F.col("n_first"), F.col("n_second"), total(singles).cast("double")
    )
    terms = settled(together.filter(score > threshold).select("pair", "first", "second", "both"))
    change = [
        terms.select(F.col("pair").alias("word"), F.col("both").alias(COUNT)),
        terms.select(F.col("first").alias("word"), (-F.col("both")).alias(COUNT)),
        terms.select(F.col("second").alias("word"), (-F.col("both")).alias(COUNT)),
        singles.select(F.col("standard").alias("word"), COUNT),
    ]
    summed = regroup(reduce(DataFrame.unionAll, change), "word")
    return settled(summed).filter(F.col(COUNT) > 0)
