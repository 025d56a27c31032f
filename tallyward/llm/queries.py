"""The operators applied to whole tables, with production parameters.

Each query takes ``(spark, sf_dir)`` and gives its operator's result with the
columns its contract asks for; SQL equals it where SQL can express it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import (
    decontaminate,
    lexical_search,
    line_dedup,
    lm_scoring,
    mixing,
    pii,
    quality,
    secret_scan,
    simhash,
    suffix_dedup,
    toxicity,
    url_filter,
    whitening,
)
from tallyward.llm.shared import read


def _hex(number: Column) -> Column:
    """A long as 16 lower-case hexadecimal digits, unsigned."""
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def _listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    shown = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(shown, ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read(spark, sf_dir, "documents"))
    base, spans = F.col("base"), F.col("spans")
    return found.select(
        "doc_id",
        *(_of_kind(base, kind) for kind in pii.KINDS),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])

    def held(live: bool) -> Column:
        own = F.filter(spans, lambda s: s["live"] if live else ~s["live"])
        return F.size(own).cast("long")

    return found.select(
        "doc_id",
        *(_of_kind(base, kind) for kind in secret_scan.BASE_KINDS),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
        held(True).alias("n_live"),
        held(False).alias("n_example"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), radius=2, shingle_words=3)
    return found.select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), length=10
    )
    n_hit = F.aggregate(
        F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
        F.lit(0),
        lambda total, x: total + x,
    ).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = line_dedup.dedup_lines(docs, radius=3, similarity=0.8)
    return found.select(
        "doc_id",
        (F.size(F.split("text", "\n")) + F.col("removed_lines")).cast("long").alias("n_lines"),
        "removed_lines",
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.find_toxic(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=4)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10
    )


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages")).select(
        "page_id", "host", "path", "rule", "verdict", "score"
    )


SEARCH_SQL = r"""
WITH docs AS (
  SELECT doc_id, r, len(w) AS n, w FROM (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents)
  WHERE len(w) > 0
), items AS (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), size AS (
  SELECT count(*) AS nn, sum(n)::HUGEINT AS ll FROM docs
), tfs AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY r, doc_id, n, term
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), size
), gains AS (
  SELECT r, doc_id, term,
         w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n::HUGEINT * nn) // ll))::BIGINT)) AS gain
  FROM tfs JOIN weights USING (term), size
), scored AS (
  SELECT item_id, r, doc_id, sum(gain * q)::BIGINT AS score
  FROM items JOIN gains USING (term) GROUP BY item_id, r, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE score > 0)
WHERE rank <= 10
"""

QUALITY_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM split
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, sum(least(8, coalesce(j - i, 8))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM repeated) GROUP BY r
), lines AS (
  SELECT r, x, len(x) AS n,
         len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS k,
         len(list_distinct(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS d,
         len(regexp_extract_all(x, '[|»›>]')) AS m,
         len(regexp_extract_all(x, '[#*$%&|<>]')) AS s
  FROM (SELECT r, unnest(l) AS x FROM words)
), judged AS (
  SELECT r, n,
    100 * s > 10 * n OR NOT regexp_matches(x, '[\p{L}\p{N}]')
    OR (m >= 3 AND 100 * m >= 20 * k)
    OR (k <= 30 AND regexp_matches(lower(x), 'all rights reserved|licensed under|terms of (use|service)|privacy policy|cookie policy|accept cookies|enable javascript|copyright (©|\(c\)|[0-9])|click here|sign up|log in|subscribe now|lorem ipsum'))
    OR (k >= 10 AND 100 * d < 30 * k) AS failed
  FROM lines
), losses AS (
  SELECT r, count(*) FILTER (WHERE failed) AS n_failed_lines,
         coalesce(sum(n) FILTER (WHERE failed), 0) AS lost, sum(n) AS total
  FROM judged GROUP BY r
), counted AS (
  SELECT doc_id, len(w) AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines,
    coalesce(lost, 0)::BIGINT AS lost_chars, coalesce(total, 0) AS total
  FROM words LEFT JOIN covered c USING (r) LEFT JOIN losses USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND total > lost_chars AND 100 * (total - lost_chars) >= 50 * total AS kept,
  n_failed_lines, lost_chars
FROM counted
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_personal_data": op2_personal_data,
        "op3_simhash": op3_simhash,
        "op4_decontamination": op4_decontamination,
        "op5_secrets": op5_secrets,
        "op6_line_dedup": op6_line_dedup,
        "op7_mixing": op7_mixing,
        "op8_toxicity": op8_toxicity,
        "op9_quality": op9_quality,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_whitening": op11_whitening,
        "op12_lexical_search": op12_lexical_search,
        "op13_url_filter": op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_quality": QUALITY_SQL, "op12_lexical_search": SEARCH_SQL}
