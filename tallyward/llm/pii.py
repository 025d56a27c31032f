"""Personal data: spans by format, and more of them by boosted trees.

Formats find the certain spans, which always stay. Generators of high recall
propose further, overlapping candidates: numbers in groups, addresses written
out or spaced. Trees boosted on format and context features of the candidates
of a bounded sample of documents learn which candidates are personal data: the
certain spans rewritten in loose forms, where they stand, are, and candidates
that touch no certain span are not. The sample's other half calibrates the score
and sets a threshold per kind. A candidate above it that touches no certain or
better span is added.

Each text is read by one task; the model and its thresholds are the only thing
sent to all.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.boosting import Trees, calibrate, fit_trees

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Every span of digits lies in one such stretch; a phone's plus is just before it.
_STRETCH = re.compile(r"[0-9][0-9 ().-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63})*"
)
_SPOKEN_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63})+"
)
_AT = re.compile(r" ?(?:\(at\)|\[at\]|@| at ) ?")
_DOT = re.compile(r" ?(?:\(dot\)|\[dot\]| dot ) ?| \. | \.|\. ")
_LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?[.-] ?[0-9]{1,3}){3}(?![0-9.])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9](?:[ .-]{0,2}[0-9]){12,18}(?![0-9])")
_LOOSE_PHONE = re.compile(r"\(?[0-9](?:[ ().-]{0,3}[0-9]){6,14}(?![0-9])")

# Words that announce a kind, in the order of KINDS.
_HINTS = (
    frozenset("email e-mail mail contact write courriel correo".split()),
    frozenset("ip host server address addr gateway dns".split()),
    frozenset("card visa mastercard amex credit debit karte carte tarjeta".split()),
    frozenset("phone tel telephone call fax mobile cell telefon téléphone teléfono".split()),
)

Span = tuple[int, int, int]  # start, number of the kind, end


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The certain spans, by start, then kind. Linear in the text's length."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    for stretch in _STRETCH.finditer(text):
        start, end = stretch.span()
        if end - start < 7:
            continue
        for m in _IP.finditer(text, start, end):
            if all(map(_small, m[0].split("."))):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, start, end):
            if 14 <= len(m[0]) <= 37 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                found.append((m.start(), 2, m.end()))
        if start and text[start - 1] == "+" and (m := _PHONE.match(text, start - 1, end)):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def candidates(text: str) -> list[Span]:
    """Proposed spans, overlapping and of several kinds, certain ones included."""
    found = set(base_spans(text))
    if "@" in text or "(at)" in text or "[at]" in text:
        found.update((m.start(), 0, m.end()) for m in _LOOSE_EMAIL.finditer(text))
    if " dot " in text:
        found.update((m.start(), 0, m.end()) for m in _SPOKEN_EMAIL.finditer(text))
    for stretch in _STRETCH.finditer(text):
        start, end = stretch.span()
        if end - start < 7:
            continue
        start -= text[start - 1 : start] == "("
        for kind, loose in ((1, _LOOSE_IP), (2, _LOOSE_CARD), (3, _LOOSE_PHONE)):
            found.update((m.start(), kind, m.end()) for m in loose.finditer(text, start, end))
    return sorted(found)


def loosened(text: str, base: list[Span]) -> tuple[str, list[Span]]:
    """``text`` with its certain spans in loose forms, and where those stand.

    A form is chosen by the span's own characters. Of overlapping spans the first
    is rewritten.
    """
    parts, at, size, forms = [], 0, 0, []
    for start, kind, end in base:
        if start < at:
            continue
        new = _loose_form(text[start:end], kind)
        parts += [text[at:start], new]
        size += start - at
        forms.append((size, kind, size + len(new)))
        size, at = size + len(new), end
    return "".join([*parts, text[at:]]), forms


def _loose_form(body: str, kind: int) -> str:
    pick = zlib.crc32(body.encode())
    if kind == 0:
        at, dot = ((" (at) ", " (dot) "), (" [at] ", "."), (" @ ", " . "), (" at ", " dot "))[pick % 4]
        local, _, domain = body.rpartition("@")
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return body.replace(".", (" . ", "-", ". ")[pick % 3])
    digits = _digits(body)
    if kind == 2:
        gap = (".", "  ", " - "[:2])[pick % 3]
        return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    first, rest = digits[: len(digits) - 7], digits[-7:]
    return (
        f"({first}) {rest[:3]}-{rest[3:]}",
        f"{first} {rest[:3]} {rest[3:]}",
        f"{first}-{rest[:3]}-{rest[3:]}",
        f"{first}.{rest[:3]}.{rest[3:]}",
    )[pick % 4]


def examples(text: str) -> list[tuple[float, list[float]]]:
    """Labels and features a text teaches: 1 for the candidates that are certain
    spans in loose form, 0 for those of the text as it is that touch no certain
    span. All others are left out."""
    base = base_spans(text)
    rows = [
        (0.0, features(text, s))
        for s in candidates(text)
        if all(s[2] <= a or b <= s[0] for a, _, b in base)
    ]
    if base:
        new, forms = loosened(text, base)
        proposed = set(candidates(new)) - set(base_spans(new))
        rows += [(1.0, features(new, s)) for s in forms if s in proposed]
    return rows


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    start, kind, end = span
    body, digits = text[start:end], _digits(text[start:end])
    groups = [len(g) for g in re.split(r"[^0-9]+", body) if g] or [0]
    parts = [int(g[:9]) for g in re.split(r"[^0-9]+", body) if g] or [0]
    before = text[max(0, start - 40) : start].lower().split()[-3:]
    before = [w.strip(".,:;()[]=\"'") for w in before]
    counts = Counter(body)
    spread = -sum(n / len(body) * math.log2(n / len(body)) for n in counts.values())
    plain = _DOT.sub(".", _AT.sub("@", body)) if kind == 0 else ""
    domain = plain.rpartition("@")[2]
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        len(body), len(digits), len(groups), max(groups), min(groups),
        counts["."], counts["-"], counts[" "], float("(" in body),
        float(body[:1] == "+" or text[start - 1 : start] == "+"),
        float(13 <= len(digits) <= 19 and _luhn(digits)),
        float(max(parts)), float(len(digits) and int(digits[0])),
        _side(text[start - 1 : start]), _side(text[end : end + 1]),
        *(float(any(w in hints for w in before)) for hints in _HINTS),
        counts["@"], domain.count("."), len(domain.rpartition(".")[2]), spread,
        float(len(groups) == 4 and max(parts) <= 255),
    ]


class Model:
    """Trees and a threshold for each kind; infinite where too little was seen."""

    def __init__(self, trees: Trees | None, thresholds: list[float]):
        self.trees, self.thresholds = trees, thresholds


def fit(
    x: np.ndarray, y: np.ndarray, precision: float = 0.99, least: int = 50
) -> Model:
    """Trees from the even rows; scale and thresholds from the odd ones.

    A kind's threshold is the lowest score from which on ``precision`` of the
    held-back candidates are personal data, ``least`` of them at the fewest.
    """
    none = Model(None, [math.inf] * len(KINDS))
    even = np.arange(len(y)) % 2 == 0
    if min(y[even].sum(), (1 - y)[even].sum(), y[~even].sum(), (1 - y)[~even].sum()) < 5:
        return none
    trees = fit_trees(x[even], y[even])
    trees.scale = calibrate(trees.margin(x[~even]), y[~even])
    score, held, thresholds = trees.probability(x[~even]), x[~even], []
    for kind in range(len(KINDS)):
        own = held[:, kind] == 1
        order = np.argsort(-score[own], kind="stable")
        hits = y[~even][own][order].cumsum()
        good = np.flatnonzero((hits >= precision * np.arange(1, len(hits) + 1)) & (hits >= least))
        ranked = score[own][order]
        # Half is the least score that calls a candidate personal data at all.
        thresholds.append(max(0.5, float(ranked[good[-1]])) if len(good) else math.inf)
    return Model(trees, thresholds)


def select(
    text: str, base: list[Span], proposed: list[Span], scores: np.ndarray, model: Model
) -> list[Span]:
    """``base`` and the best-scored proposals above threshold that touch no span."""
    kept = list(base)
    for i in np.argsort(-scores, kind="stable"):
        start, kind, end = proposed[i]
        if scores[i] >= model.thresholds[kind] and all(
            end <= a or b <= start for a, _, b in kept
        ):
            kept.append(proposed[i])
    return sorted(kept)


def fit_on(docs: DataFrame, sample_docs: int = 50_000, sample_rows: int = 20_000) -> Model:
    """A model from the candidates of about ``sample_docs`` documents, chosen by
    a hash of their id; ``sample_rows`` of their ``examples`` at most."""
    n = docs.count()
    part = docs.where(
        F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000))
        < F.lit(round(1_000_000 * min(1.0, sample_docs / max(n, 1))))
    )

    @F.pandas_udf("array<array<float>>")
    def rows_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[[y, *x] for y, x in examples(t or "")] for t in batch])

    found = part.select("doc_id", F.posexplode(rows_of("text")).alias("at", "row"))
    found = found.orderBy(F.xxhash64(F.lit(12), "doc_id", "at"), "row").limit(sample_rows)
    table = np.array([list(r.row) for r in found.select("row").collect()], dtype=float)
    if not len(table):
        return Model(None, [math.inf] * len(KINDS))
    return fit(table[:, 1:], table[:, 0])


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, text, base, spans`` of every row of ``docs``.

    Spans are ``(kind, start, end)`` in code points, end exclusive, by start and
    then kind as in KINDS; ``spans`` holds ``base`` and what the model adds, the
    same kinds in other forms (``ann (at) site (dot) org``, phones without a plus). Null
    and empty texts have none. Repeated rows give repeated rows; without enough
    labelled candidates nothing is added. Only ``doc_id`` and ``text`` are read.
    """
    docs = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model or fit_on(docs))

    @F.pandas_udf(f"base {_SPANS}, spans {_SPANS}")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def shown(spans: list[Span]) -> list[dict]:
            return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

        for batch in texts:
            texts_ = [t or "" for t in batch]
            base = [base_spans(t) for t in texts_]
            spans = list(base)
            if sent.value.trees is not None:
                sure = [set(b) for b in base]
                more = [[s for s in candidates(t) if s not in b] for t, b in zip(texts_, sure)]
                rows = [features(t, s) for t, own in zip(texts_, more) for s in own]
                if rows:
                    scores = sent.value.trees.probability(np.array(rows, dtype=np.float32))
                    ends = np.cumsum([len(own) for own in more])
                    for i, own in enumerate(more):
                        if own:
                            part = scores[ends[i] - len(own) : ends[i]]
                            spans[i] = select(texts_[i], base[i], own, part, sent.value)
            yield pd.DataFrame(
                {"base": [shown(b) for b in base], "spans": [shown(s) for s in spans]}
            )

    found = docs.withColumn("_found", find("text"))
    return found.select("doc_id", "text", "_found.base", "_found.spans")


def redact(found: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with every span replaced by its kind in brackets.

    Overlapping spans are replaced by the kind of the first of them. A null text
    stays null, an empty one empty; repeated rows give repeated rows.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans):
            at, parts = 0, []
            for s in own if text is not None else ():
                if s["start"] >= at:
                    parts += [text[at : s["start"]], f"[{s['kind']}]"]
                at = max(at, s["end"])
            out.append(None if text is None else "".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    return found.select("doc_id", cut("text", "spans").alias("text"))
