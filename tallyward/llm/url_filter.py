"""URL filters: rules first, boosted trees on lexical features for the rest.

A rule names a host (with its subdomains) and the start of a path; of those that
fit, the longest decides. Every other URL is scored by gradient-boosted trees
that learn from labelled URLs: those given, or else those of the table that a
rule decides. Features are lengths, depth, digit ratios, entropies and parameter
counts of the URL itself, and statistics of its suffixes: how many URLs of the
whole table lie under the host's last one, two and three labels and under the
path's first segment, and which share of the labelled ones was blocked.

Labelled URLs fall into three parts by a hash: the first is for the shares, the
second for the trees, the third for the scale and the threshold, so that no
label meets its own statistics. Only counts by host and by segment are shuffled;
the URLs themselves are joined with them once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from urllib.parse import parse_qsl

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.boosting import Trees, calibrate, fit_trees
from tallyward.llm.shared import settled

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEVELS = (1, 2, 3)
_VOWELS = frozenset("aeiou")


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the filter list.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def longest_rule(rules: tuple[Rule, ...], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, or null. Rules are tried in
    turn, so they are a short list."""
    found = F.lit(None).cast("string")
    # Built from the shortest outwards: the longest is asked first.
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = (host == rule.host) | host.endswith(f".{rule.host}")
        found = F.when(fits & path.startswith(rule.path), F.lit(value(rule))).otherwise(found)
    return found


def _parsed(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``urls`` with host, path, the first segment, the rule and its verdict."""
    urls = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    host, path = F.col("host"), F.col("path")
    return urls.withColumns(
        {
            "segment": F.regexp_extract(path, "^/*([^/]*)", 1),
            "rule": longest_rule(rules, host, path, lambda r: r.name),
            "ruled": longest_rule(rules, host, path, lambda r: r.verdict),
        }
    )


def _entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def _digits(text: str) -> int:
    return sum("0" <= c <= "9" for c in text)


def lexical_features(url: str | None, host: str, path: str) -> list[float]:
    """Features of the URL's own characters; a null URL counts as empty."""
    url = url or ""
    query = url.partition("#")[0].partition("?")[2]
    values = parse_qsl(query, keep_blank_values=True)
    labels = [p for p in host.partition(":")[0].split(".") if p]
    segments = [s for s in path.split("/") if s]
    last = segments[-1] if segments else ""
    name = max(labels, key=len, default="")
    runs = [len(r) for r in re.findall("[0-9]+", path)]
    return [
        len(url), len(host), len(path), len(query), float(url[:6].lower() == "https:"),
        len(labels), len(segments), max(map(len, segments), default=0), len(name),
        _digits(url) / max(1, len(url)), _digits(host) / max(1, len(host)),
        _digits(path) / max(1, len(path)), max(runs, default=0),
        _entropy(host), _entropy(path), _entropy(query), _entropy(name),
        len(values), max((len(v) for _, v in values), default=0),
        url.count("%"), url.count("@"), url.count("#"), host.count("-"), host.count(":"),
        path.count("-") + path.count("_"), float("." in last), float(path.endswith("/")),
        sum(c in _VOWELS for c in name) / max(1, len(name)),
    ]


@dataclass
class Model:
    trees: Trees | None
    threshold: float  # scores from here on are blocked

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.trees is None else self.trees.probability(x)


def fit(
    x: np.ndarray, y: np.ndarray, part: np.ndarray, precision: float, least: int
) -> Model:
    """Trees from the rows of part 1, scale and threshold from those of part 2.

    The threshold is the least score, one half at the lowest, from which on
    ``precision`` of the rows held back are blocked, ``least`` of them at the
    fewest; without one nothing is blocked.
    """
    own, held = part == 1, part == 2
    if min(y[own].sum(), (1 - y)[own].sum(), y[held].sum(), (1 - y)[held].sum()) < 5:
        return Model(None, math.inf)
    trees = fit_trees(x[own], y[own], n_trees=60)
    trees.scale = calibrate(trees.margin(x[held]), y[held])
    score = trees.probability(x[held])
    order = np.argsort(-score, kind="stable")
    ranked, hits = score[order], y[held][order].cumsum()
    # Rows of one score stand or fall together, so only the last of each counts.
    last = np.append(ranked[1:] != ranked[:-1], True)
    right = hits >= precision * np.arange(1, len(hits) + 1)
    good = np.flatnonzero(last & right & (hits >= least) & (ranked >= 0.5))
    return Model(trees, float(ranked[good[-1]]) if len(good) else math.inf)


def _statistics(all_urls: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """``key, n, labelled, blocked``: URLs and labelled URLs of each host or segment."""
    counted = all_urls.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    taught = labelled.where("part = 0").groupBy(key).agg(
        F.count(F.lit(1)).alias("labelled"), F.sum("blocked").alias("blocked")
    )
    none = F.lit(0).cast("long")
    both = counted.select(key, "n", none.alias("labelled"), none.alias("blocked"))
    both = both.unionByName(taught.select(key, none.alias("n"), "labelled", "blocked"))
    return both.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])


def _shown(prior: float) -> list[Column]:
    """The statistics of one suffix as features: size and blocked share, drawn
    toward the share of all where few URLs are labelled."""
    share = (F.col("blocked") + 10 * F.lit(prior)) / (F.col("labelled") + 10)
    return [F.log1p("n"), F.log1p("labelled"), share]


def _suffix_tables(
    all_urls: DataFrame, labelled: DataFrame, prior: float
) -> tuple[DataFrame, DataFrame]:
    """Features of every host, by its suffixes, and of every first segment."""
    hosts = settled(_statistics(all_urls, labelled, "host"), "hosts")
    bare = F.regexp_replace("host", ":[^.]*$", "")
    for level in _LEVELS:
        own = hosts.withColumn("suffix", F.substring_index(bare, ".", -level))
        of = own.groupBy("suffix").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
        of = of.select("suffix", F.array(*_shown(prior)).alias(f"of{level}"))
        hosts = own.join(of, "suffix").drop("suffix")
    hosts = hosts.select("host", F.concat(*[f"of{level}" for level in _LEVELS]).alias("of_host"))
    segments = _statistics(all_urls, labelled, "segment")
    return (
        settled(hosts, "host-features"),
        settled(segments.select("segment", F.array(*_shown(prior)).alias("of_segment")), "segments"),
    )


def _featured(urls: DataFrame, hosts: DataFrame, segments: DataFrame) -> DataFrame:
    """``urls`` with the statistics of their suffixes in ``stats``. Every host and
    segment has a row, and one only."""
    joined = urls.join(hosts, "host", "left").join(segments, "segment", "left")
    return joined.withColumn("stats", F.concat("of_host", "of_segment"))


def judge(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    precision: float = 0.8,
    least: int = 20,
    sample_urls: int = 30_000,
) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, score`` of every row of ``pages``.

    ``rule`` is the longest rule that fits, as host and path, or null; it gives
    the verdict. Otherwise the trees do: ``block`` from a score on at which
    ``precision`` of the labelled URLs held back were blocked, else ``allow``.
    A null URL, or one without ``://``, has an empty host and path, fits no rule
    and is scored like any other. Repeated rows give repeated rows. Without
    labelled URLs of both kinds every score is 0.5 and every such verdict
    ``allow``; an empty table gives an empty one.

    ``labelled`` has the columns ``url`` and ``blocked`` (boolean; rows with a null
    are left out) and takes the place of the URLs that a rule decides. Statistics
    are counted over all rows; the trees learn from at most ``sample_urls``
    distinct labelled URLs, chosen by a hash. Only ``page_id`` and ``url`` are read.
    """
    pages = _parsed(pages.select("page_id", "url"), rules)
    if labelled is None:
        taught = pages.where(F.col("ruled").isNotNull())
        taught = taught.withColumn("blocked", (F.col("ruled") == "block").cast("long"))
    else:
        given = labelled.select("url", F.col("blocked").cast("boolean").cast("long").alias("blocked"))
        taught = _parsed(given.where("url is not null and blocked is not null"), rules)
    taught = taught.select(
        "url", "host", "path", "segment", "blocked",
        F.pmod(F.xxhash64(F.lit(31), "url"), F.lit(3)).alias("part"),
    )
    n, blocked = taught.where("part = 0").agg(F.count("blocked"), F.sum("blocked")).first()
    hosts, segments = _suffix_tables(pages, taught, (blocked or 0) / n if n else 0.5)
    model = _fitted(taught, hosts, segments, precision, least, sample_urls)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(url: pd.Series, host: pd.Series, path: pd.Series, stats: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(_table(zip(url, host, path, stats))))

    scored = _featured(pages, hosts, segments).withColumn(
        "score", score("url", "host", "path", "stats")
    )
    own = F.when(F.col("score") >= F.lit(model.threshold), "block").otherwise("allow")
    return scored.select(
        "page_id", "url", "host", "path", "rule",
        F.coalesce("ruled", own).alias("verdict"), "score",
    )


def _table(rows) -> np.ndarray:
    found = [
        [*lexical_features(url, host, path), *(stats if stats is not None else [0.0] * 12)]
        for url, host, path, stats in rows
    ]
    return np.array(found, dtype=float)


def _fitted(
    taught: DataFrame,
    hosts: DataFrame,
    segments: DataFrame,
    precision: float,
    least: int,
    sample_urls: int,
) -> Model:
    """Trees and a threshold from a bounded sample of distinct labelled URLs."""
    own = taught.where("part > 0")
    share = min(1.0, 2 * sample_urls / max(1, own.count()))
    mark = F.xxhash64(F.lit(32), "url")
    if share < 1:
        own = own.where(F.pmod(mark, F.lit(1_000_000)) < F.lit(round(1_000_000 * share)))
    own = own.groupBy("url", "host", "path", "segment", "part").agg(
        F.max("blocked").alias("blocked")
    )
    own = own.orderBy(mark, "url").limit(sample_urls)
    rows = _featured(own, hosts, segments).orderBy("url").collect()
    x = _table((r.url, r.host, r.path, r.stats) for r in rows)
    y = np.array([r.blocked for r in rows], dtype=float)
    return fit(x, y, np.array([r.part for r in rows]), precision, least)
