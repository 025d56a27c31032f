"""Secrets, and how many owners hold each.

Formats find the certain spans, which always stay; further formats propose
candidates. The hash of every candidate is counted over the whole corpus: a
value that many owners hold is an example someone copied, one that stays with
its owner and looks random is live. Only live proposals are added.

Texts are scanned once; what is shuffled are hashes and places of candidates.
A value copied into a third of all documents is counted by partial sums, and
its places meet its one count in a join whose large side Spark splits.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.shared import settled

# The certain kinds, then the proposed ones, in the order of spans at one start.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "bearer", "vendor", "jwt", "login", "pem")

_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(
    r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_MARKS = bytes(120 if 48 <= b <= 57 or 97 <= b <= 102 else 32 for b in range(256))
# A word that must be in the lower-cased text, the kind, and its pattern.
_MORE = (
    ("bearer", 3, re.compile(r"(?ai:bearer)\x20+([A-Za-z0-9._~+/=-]{20,})")),
    ("_", 4, re.compile(r"\b((?:gh[pousr]|github_pat|glpat|sk_live|rk_live)[_-][A-Za-z0-9_-]{16,})")),
    ("eyj", 5, re.compile(r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")),
    ("://", 6, re.compile(r"[a-z][a-z0-9+]{1,12}://[^\s/:@]{1,64}:([^\s/:@]{6,128})@")),
    ("private key", 7, re.compile(r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,})")),
)
_PLACEHOLDER = re.compile(r"(?ai:example|sample|changeme|password|your|dummy|test|xxxx|1234)")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, value)`` of the certain spans, by start, then kind."""
    found, lower = [], text.lower()
    if any(k in lower for k in _KEYS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                found.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if len(m[0]) >= 16:
                found.append((m.start(), 1, m.end(), m[0]))
    if b"x" * 32 in text.encode().translate(_HEX_MARKS):
        for m in _HEX.finditer(text):
            if m.end() - m.start() >= 32:
                found.append((m.start(), 2, m.end(), m[0]))
    return sorted(found)


def more_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Proposed spans by further formats. Of overlapping ones the leftmost stays,
    at one start the longest, and of equal ones the later, narrower kind."""
    lower = text.lower()
    found = sorted(
        (m.start(1), -m.end(1), -kind, m[1])
        for word, kind, pattern in _MORE
        if word in lower
        for m in pattern.finditer(text)
    )
    kept, done = [], 0
    for start, end, kind, value in found:
        if start >= done:
            kept.append((start, -kind, -end, value))
            done = -end
    return kept


def looks_live(value: str, kind: int = 0) -> bool:
    """Random-looking: 12 characters or more (6 where a login's place tells what it
    is), 2.5 bits each, of two classes, and no word of a placeholder."""
    if len(value) < (6 if KINDS[kind] == "login" else 12) or _PLACEHOLDER.search(value):
        return False
    n = len(value)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    classes = [any(map(t, value)) for t in (str.islower, str.isupper, str.isdigit)]
    return bits >= 2.5 and sum(classes) >= 2


_FOUND = "array<struct<kind_no:int,start:int,end:int,value_hash:string,random:boolean>>"


def find_secrets(
    docs: DataFrame,
    owner: str = "source",
    repository: str = "doc_id",
    example_owners: int = 3,
    example_repositories: int = 20,
) -> DataFrame:
    """``doc_id, spans`` of every row of ``docs``.

    ``spans`` has ``kind_no, kind, start, end, base, value_hash, n_owners,
    n_repositories, live``, in code points, end exclusive, by start and then
    kind as in KINDS: the certain spans, and live proposals that overlap none.
    A value is live if it looks random and has one owner, or fewer than
    ``example_owners`` owners and ``example_repositories`` repositories. Equal
    texts of one owner are one repository. Null is an owner (repository)
    like any other. Null and empty texts have no spans. Repeated rows give
    repeated rows, and count as one repository. Only the four named columns are
    read.
    """

    @F.pandas_udf(_FOUND)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(
                [
                    [
                        {
                            "kind_no": kind,
                            "start": start,
                            "end": end,
                            "value_hash": hashlib.sha256(value.encode()).hexdigest()[:32],
                            "random": looks_live(value, kind),
                        }
                        for start, kind, end, value in base_spans(t) + more_spans(t)
                    ]
                    for t in (t or "" for t in batch)
                ]
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.col(owner).alias("owner"),
        F.col(repository).alias("repository"),
        F.xxhash64("text").alias("copy"),
        find("text").alias("found"),
    )
    rows = settled(rows, "secrets")
    places = rows.select("row", "owner", "repository", "copy", F.inline("found"))
    own = places.select("value_hash", "owner", "repository", "copy").distinct()
    # Equal texts are one repository, and so are texts of one.
    distinct = [
        own.select("value_hash", "owner", c).distinct().groupBy("value_hash", "owner").agg(
            F.count(F.lit(1)).alias(f"n_{c}")
        )
        for c in ("repository", "copy")
    ]
    by_owner = distinct[0].withColumn("n_copy", F.lit(None).cast("long")).unionByName(
        distinct[1].withColumn("n_repository", F.lit(None).cast("long"))
    )
    held = (
        by_owner.groupBy("value_hash", "owner")
        .agg(F.least(F.max("n_repository"), F.max("n_copy")).alias("n"))
        .groupBy("value_hash")
        .agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))
    )
    base = F.col("kind_no") < len(BASE_KINDS)
    # What has one owner is that owner's, in however many repositories.
    few = (F.col("n_owners") < example_owners) & (F.col("n_repositories") < example_repositories)
    live = F.col("random") & ((F.col("n_owners") == 1) | few)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    judged = (
        places.join(held, "value_hash")
        .withColumn("base", base)
        .withColumn("live", live)
        .where("base OR live")
        .groupBy("row")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "start",
                        "kind_no",
                        "end",
                        F.get(kinds, F.col("kind_no")).alias("kind"),
                        "base",
                        "value_hash",
                        "n_owners",
                        "n_repositories",
                        "live",
                    )
                )
            ).alias("spans")
        )
    )
    alone = F.filter(
        "spans",
        lambda s: s["base"]
        | ~F.exists(
            "spans",
            lambda b: b["base"] & (b["start"] < s["end"]) & (s["start"] < b["end"]),
        ),
    )
    none = F.array().cast(judged.schema["spans"].dataType)
    judged = judged.withColumn("spans", alone)
    return rows.select("row", "doc_id").join(judged, "row", "left").select(
        "doc_id", F.coalesce("spans", none).alias("spans")
    )
