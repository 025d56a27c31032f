"""Toxicity by a string-kernel support vector machine on Nyström landmarks.

Two words are similar by the weighted number of letter sequences they share,
where gaps cost but do not break a sequence: spellings with other endings,
inserted characters, punctuation or blanks stay close to the insult they hide. Landmark
words come from toxic training texts; a text is described by its greatest
similarity to each landmark, mapped by the inverse root of the landmarks' own
kernel matrix, and a linear SVM with a calibrated score is fitted to that.

Learning uses a bounded sample of labelled documents. Scoring reads each text in
one task; words are compared once per task and remembered.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.boosting import calibrate
from tallyward.llm.shared import settled

_EDGES = " \t\n.,;:!?\"'()[]{}<>|*#$%&-_/\\…«»“”’"
# Three or more characters set apart by blanks: "i d i o t" is one word, blanks included.
_APART = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
_MOST_CHARS, _STEP = 24, 12
_TEXTS = 128  # taken out of Arrow and described at a time
_CELLS = 500_000  # of a dense table of words by sequences
_LISTED = 1 << 22  # sequences of letters that are listed by whether a landmark has them
_KNOWN, _KEPT = 150_000, 4_000_000  # words remembered, and numbers of their rows


def words_of(text: str) -> set[str]:
    """Distinct blank-separated words in lower case, and runs of single characters."""
    text = text.lower()
    words = set(text.split())
    words.update(m[0] for m in _APART.finditer(text))
    return words


def pieces(word: str) -> list[str]:
    """A word without punctuation at its ends, in overlapping pieces if long."""
    word = word.strip(_EDGES)
    if len(word) <= _MOST_CHARS:
        return [word] if len(word) >= 3 else []
    return [word[i : i + _MOST_CHARS] for i in range(0, len(word) - _STEP, _STEP)]


@lru_cache(maxsize=64)
def _places(size: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that ``length`` of ``size`` characters can be picked from, a row for each
    way; the first and last places there are, and which of these each row has."""
    picked = np.array(list(combinations(range(size), length)))
    ends, end_of = np.unique(picked[:, [0, -1]], axis=0, return_inverse=True)
    return picked, ends.T, end_of.ravel()


def codes(words: list[str], pad: int) -> np.ndarray:
    """Code points, a row for each word."""
    width = max(map(len, words), default=0)
    text = "".join(word.ljust(width, "\0") for word in words)
    table = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    sizes = np.array([len(word) for word in words], dtype=np.int64)
    return np.where(np.arange(width) < sizes[:, None], table.reshape(len(words), width), pad)


def subsequence_kernel(
    a: np.ndarray, b: np.ndarray, length: int, decay: tuple | float, worth: np.ndarray | float = 1.0
) -> np.ndarray:
    """Row by row, the weighted common subsequences of ``length`` characters.

    Each character spanned, gaps included, costs its ``decay`` (one number, or a
    table for each side); each one matched counts ``worth`` (of ``a``) on both sides.
    """
    n, rows, cols = len(a), a.shape[1], b.shape[1]
    left, right = decay if isinstance(decay, tuple) else (decay, decay)
    left, right = np.broadcast_to(left, a.shape), np.broadcast_to(right, b.shape)
    worth = np.broadcast_to(worth, a.shape)
    match = np.empty((rows, cols, n))
    for i in range(rows):
        match[i] = ((a[:, i : i + 1] == b) * right * (left * worth**2)[:, i : i + 1]).T
    before = np.ones((rows + 1, cols + 1, n))
    for _ in range(length - 1):
        now = np.zeros_like(before)
        for i in range(rows):
            run = np.zeros(n)
            for j in range(cols):
                run = right[:, j] * run + match[i, j] * before[i, j]
                now[i + 1, j + 1] = left[:, i] * now[i, j + 1] + run
        before = now
    return np.einsum("ijn,ijn->n", match, before[:-1, :-1])


@dataclass
class Landmarks:
    """Landmark words and the similarity of other words to them.

    Similarity is a power of the normalised kernel, which sets near spellings
    apart from words with a few letters in common. A spanned letter costs
    ``decay``; a character that is no letter or digit costs the milder ``apart``
    and counts ``aside`` if matched, so that dots or blanks between all letters
    weigh little. ``floors``, learned from clean texts, are taken off the similarities
    to each landmark; what is below counts as 0. A character that a word has n times counts an n-th each time, and
    so does one letter put between all others. Nothing is cut off: the kernel is computed in full for every
    word, from the weights of the subsequences that the landmarks have.
    """

    words: list[str]
    length: int = 3
    decay: float = 0.8
    apart: float = 0.98
    aside: float = 0.2
    power: float = 3.0
    floors: np.ndarray | float = 0.0

    def __post_init__(self) -> None:
        letters = sorted({ord(c) for w in self.words for c in w})
        self.letters = np.array(letters, dtype=np.int32)
        self.features = np.zeros(0, dtype=np.int64)
        parts = [(i, *self._sequences(codes([w], -1))) for i, w in enumerate(self.words)]
        self.features = np.unique(np.concatenate([k.ravel() for _, k, _ in parts] or [[]]))
        self.features = self.features[self.features >= 0].astype(np.int64)
        most = len(letters) ** self.length
        self.listed = None
        if most <= _LISTED:  # one more for -1
            self.listed = np.zeros(most + 1, dtype=bool)
            self.listed[self.features] = True
        self.weights = np.zeros((len(self.features), len(self.words)), dtype=np.float32)
        for i, keys, value in parts:
            at = np.searchsorted(self.features, keys[0])
            np.add.at(self.weights[:, i], at, value[0])
            self.weights[:, i] /= max(float(self._own(codes([self.words[i]], -1))[0]) ** 0.5, 1e-12)

    def _has(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are a landmark's."""
        if self.listed is None:
            return np.isin(keys, self.features)
        return self.listed[keys]

    def _costs(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each character costs if spanned, and counts if matched."""
        kinds, back = np.unique(table, return_inverse=True)
        plain = np.array([chr(c).isalnum() for c in kinds])[back].reshape(table.shape)
        times = sum((table == column[:, None]).astype(np.int32) for column in table.T)
        worth = np.where(plain, 1.0, self.aside) / times
        return np.where(plain, self.decay, self.apart), worth

    def _own(self, table: np.ndarray) -> np.ndarray:
        """The kernel of words of one length with themselves."""
        decay, worth = self._costs(table)
        return subsequence_kernel(table, table, self.length, (decay, decay), worth)

    def _sequences(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All subsequences of words of one length: their keys (-1 with a character
        of no landmark) and weights."""
        decay, worth = self._costs(table)
        picked, ends, end_of = _places(table.shape[1], self.length)
        # A row for each place: what is picked are whole rows.
        spans = np.cumsum(np.log(decay), axis=1)
        starts = (spans - np.log(decay)).T
        weight = np.exp(spans.T[ends[1]] - starts[ends[0]])[end_of]
        at = np.searchsorted(self.letters, table)
        at = np.minimum(at, len(self.letters) - 1)
        # So far below nought that no other two letters make up for it.
        none = -(len(self.letters) ** self.length)
        at = np.where(self.letters[at] == table, at, none).T.copy()
        worth = worth.T.copy()
        key = np.zeros(weight.shape, dtype=np.int64)
        for place in picked.T:
            key *= len(self.letters)
            key += at[place]
            weight *= worth[place]
        return np.maximum(key, -1, out=key).T, weight.T

    def similarity(self, words: list[str]) -> np.ndarray:
        """A row for each word, a column for each landmark."""
        found = np.zeros((len(words), len(self.words)), dtype=np.float32)
        sizes = np.array([len(w) for w in words])
        for size in range(self.length, int(sizes.max(initial=0)) + 1):
            rows = np.flatnonzero(sizes == size)
            step = max(1, _CELLS // max(len(self.features), math.comb(size, self.length)))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                found[part] = self._compared(codes([words[j] for j in part], -1))
        return found

    def _compared(self, table: np.ndarray) -> np.ndarray:
        keys, weight = self._sequences(table)
        row, column = np.nonzero(np.ascontiguousarray(self._has(keys)))
        at = np.searchsorted(self.features, keys[row, column])
        shared = self._summed(row, at, weight[row, column], len(table))
        # A word's own kernel is the sum of squares of its distinct sequences' weights,
        # no less than that of all of them apart: most words need no more than this bound.
        most = np.sqrt(np.einsum("nk,nk->n", weight, weight))[:, None]
        near = np.flatnonzero(
            ((shared / most * (1 + 1e-5)) ** self.power > self.floors).any(axis=1)
        )
        found = np.zeros_like(shared)
        norm = np.sqrt(self._own(table[near]))[:, None]
        found[near] = self.above(np.minimum(shared[near] / norm, 1.0) ** self.power)
        return found

    def _summed(self, row: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """For ``n`` words, the landmarks' weights of the sequences each has, times its own;
        ``row`` rises. Most words have so few that no table of all sequences is made."""
        if len(at) * len(self.words) > n * len(self.features):
            cell = row * len(self.features) + at
            table = np.bincount(cell, weight, n * len(self.features)).reshape(n, -1)
            return table.astype(np.float32) @ self.weights
        shared = np.zeros((n, len(self.words)), dtype=np.float32)
        if len(row):
            each = self.weights[at]
            each *= weight.astype(np.float32)[:, None]
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            shared[row[starts]] = np.add.reduceat(each, starts, axis=0)
        return shared

    def above(self, similar: np.ndarray) -> np.ndarray:
        """Similarities less the floors, from 0 to 1 again."""
        return np.maximum(similar - self.floors, 0) / (1 - np.minimum(self.floors, 0.999))

    def describe(self, texts: list[str], known: dict[str, int], kept: list[np.ndarray]):
        """Greatest similarity to each landmark over the words of each text.

        ``known`` maps words to rows of ``kept``, -1 for words like no landmark; both
        are emptied past ``_KNOWN`` words or ``_KEPT`` numbers and then filled anew.
        """
        if len(known) > _KNOWN or len(kept) * len(self.words) > _KEPT:
            known.clear()
            kept.clear()
        sets = [words_of(t) for t in texts]
        fresh = sorted(set().union(*sets) - known.keys()) if sets else []
        parts = [(w, p) for w in fresh for p in pieces(w)]
        rows = self.similarity([p for _, p in parts])
        known.update(dict.fromkeys(fresh, -1))
        for i in np.flatnonzero(rows.any(axis=1)):
            word = parts[i][0]
            at = known[word]
            if at < 0:
                known[word] = len(kept)
                kept.append(rows[i].copy())
            else:
                kept[at] = np.maximum(kept[at], rows[i])
        out = np.zeros((len(texts), len(self.words)), dtype=np.float32)
        for i, words in enumerate(sets):
            near = [at for at in map(known.__getitem__, words) if at >= 0]
            if near:
                out[i] = np.max([kept[at] for at in near], axis=0)
        return out


def choose_landmarks(
    similar: np.ndarray,
    y: np.ndarray,
    most: int = 64,
    bars: tuple[float, ...] = (0.1, 0.2, 0.4, 0.85),
    clean_cost: float = 4.0,
    rounds: int = 20,
) -> list[int]:
    """Columns of ``similar`` (texts by candidate words) that tell toxic texts.

    Greedy cover: the next word is like a word of the most toxic texts not yet
    covered, less ``clean_cost`` for each clean text, at the best of ``bars``.
    Every toxic text is covered up to ``rounds`` times. A word has to gain more
    than one text, and a fiftieth of the toxic ones: a wrong label is no insult.
    """
    weight = np.where(y > 0, 1.0, -clean_cost)
    covered = np.zeros(len(y))
    hits = np.stack([similar >= bar for bar in bars])
    chosen: list[int] = []
    while len(chosen) < most:
        worth = np.where(y > 0, np.maximum(0, 1 - covered / rounds), weight)
        gain = np.einsum("bnm,n->bm", hits, worth)
        gain[:, chosen] = -np.inf
        bar, word = np.unravel_index(gain.argmax(), gain.shape)
        if gain[bar, word] < max(1.5, 0.02 * y.sum()):
            break
        chosen.append(int(word))
        covered += hits[bar, :, word]
    return chosen


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 3000.0, steps: int = 30) -> np.ndarray:
    """Weights and offset of a linear SVM with squared hinge loss, by Newton
    steps on the rows inside the margin; both classes weigh the same."""
    sign = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        slack = 1 - sign * (z @ w)
        inside = slack > 0
        part, c = z[inside], (cost * weight[inside] / len(y))[:, None]
        step = np.linalg.solve(
            ridge + (c * part).T @ part, ridge @ w - (c * part).T @ (sign * slack)[inside]
        )
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    landmarks: Landmarks | None
    root: np.ndarray | None = None
    weights: np.ndarray | None = None
    scale: tuple[float, float] = (1.0, 0.0)

    def score(self, similar: np.ndarray) -> np.ndarray:
        margin = (similar @ self.root) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * margin + self.scale[1], -40, 40)))


def held_out(doc_id: Column) -> Column:
    """Rows no label of which may be learned; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _tokens(text: Column) -> Column:
    """The sorted distinct pieces of a text's words."""

    @F.arrow_udf("array<string>")
    def tokens(texts: pa.Array) -> pa.Array:
        found = (words_of(t.as_py() or "") for t in texts)
        return pa.array([sorted({p for w in words for p in pieces(w)}) for words in found],
                        pa.list_(pa.string()))

    # Else conditions on the result are pushed below it: a task then has two workers
    # and takes its texts apart twice.
    return tokens.asNondeterministic()(text)


def train(
    docs: DataFrame, labels: DataFrame, sample_each: int = 3000, candidates: int = 150
) -> Model:
    """A model from the labelled rows outside the held-out third.

    Of each class the ``sample_each`` labels with the smallest hash of their id
    are used. Candidates for landmarks are the four most frequent words of toxic
    texts with each of the ``candidates`` beginnings that most tell toxic from clean
    texts, and are in two toxic texts or more. Several labels of a document count as toxic if any is; null labels
    and ids count as none. With one class only the model knows no landmark.
    """
    ids = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    order = F.xxhash64(F.lit(17), "doc_id")
    part = [
        ids.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(sample_each)
        for k in (0, 1)
    ]
    sample = docs.select("doc_id", "text").join(F.broadcast(part[0].unionAll(part[1])), "doc_id")
    sample = settled(sample, "toxicity-sample")

    def counted(rows: DataFrame, column: str) -> DataFrame:
        return rows.groupBy(column).agg(
            F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
        )

    words = sample.select("toxic", _tokens(F.col("text")).alias("words"))
    # A text counts once for each beginning of four to eight letters of its words.
    begun = F.flatten(
        F.transform(
            "words",
            lambda w: F.transform(
                F.sequence(F.lit(4), F.lit(8)), lambda n: F.substring(w, F.lit(1), n)
            ),
        )
    )
    stems = words.select("toxic", F.explode(F.array_distinct(begun)).alias("stem"))
    stems = counted(stems.where("length(stem) >= 4"), "stem").where("bad > 1 AND bad > 4 * good")
    stems = stems.orderBy(F.expr("4 * good - bad"), "stem").limit(candidates).collect()
    seen = counted(words.select("toxic", F.explode("words").alias("word")), "word")
    seen = seen.where("bad > 4 * good").orderBy(F.desc("bad"), "word").limit(50 * candidates)
    of: dict[str, list[str]] = {}
    for r in seen.collect():
        for n in range(4, min(8, len(r.word)) + 1):
            of.setdefault(r.word[:n], []).append(r.word)
    words = sorted({w for r in stems for w in of.get(r.stem, ())[:4]})
    if not words:
        return Model(None)
    marks = Landmarks(words)
    # Written first: sorting would describe the texts once more to find its ranges.
    rows = settled(_described(sample, marks), "toxicity-described")
    rows = rows.orderBy("doc_id", "text").select("similar", "toxic").collect()
    x = np.array([r.similar for r in rows], dtype=np.float64)
    y = np.array([r.toxic for r in rows], dtype=np.float64)
    # What a tenth of the clean texts have, some by wrong labels, is like no insult.
    marks.floors = np.quantile(x[y == 0], 0.9, axis=0) if (y == 0).any() else 0.0
    x = marks.above(x)
    chosen = choose_landmarks(x, y)
    if not chosen:
        return Model(None)
    x, words = x[:, chosen], [words[i] for i in chosen]
    marks = Landmarks(words, floors=np.broadcast_to(marks.floors, len(marks.words))[chosen])
    values, vectors = np.linalg.eigh(marks.similarity(words).astype(np.float64))
    values = np.maximum(values, 1e-2)
    root = vectors @ np.diag(values**-0.5) @ vectors.T
    model = Model(marks, root)
    even = np.arange(len(y)) % 2 == 0
    margins = np.zeros(len(y))
    for fold in (even, ~even):  # calibrated on margins of rows not learned from
        if min(y[fold].sum(), (1 - y)[fold].sum()) == 0:
            return Model(None)
        w = fit_svm(x[fold] @ root, y[fold])
        margins[~fold] = (x[~fold] @ root) @ w[:-1] + w[-1]
    model.scale = calibrate(margins, y)
    model.weights = fit_svm(x @ root, y)
    return model


def _parts(batch: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch, a few at a time: only those become Python strings."""
    for at in range(0, len(batch), _TEXTS):
        yield [t or "" for t in batch.slice(at, _TEXTS).to_pylist()]


def _described(docs: DataFrame, marks: Landmarks) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    @F.arrow_udf("array<float>")
    def similar(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, kept = {}, []
        for batch in texts:
            rows = []
            for part in _parts(batch):
                rows.extend(sent.value.describe(part, known, kept))
            yield pa.array(rows, pa.list_(pa.float32()))

    return docs.withColumn("similar", similar("text"))


def score(text: Column, model: Model, docs: DataFrame) -> Column:
    """The score of a text column of ``docs``, between 0 and 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, kept, model = {}, [], sent.value
        for batch in texts:
            if model.landmarks is None:
                yield pa.array(np.zeros(len(batch)))
                continue
            parts = [
                model.score(model.landmarks.describe(part, known, kept))
                for part in _parts(batch)
            ]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return scored(text)


def find_toxic(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Only texts are scored; ``doc_id`` says whether a label may be learned. Null,
    empty and wordless texts are like no landmark and get the score of a text
    without insults. Without labels of both classes every score is 0. Repeated
    rows give repeated rows; other columns are not read.
    """
    model = train(docs, labels, **options)
    return docs.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        score(F.col("text"), model, docs).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options
) -> DataFrame:
    """``docs`` without the rows scored at ``threshold`` or above."""
    model = train(docs, labels, **options)
    return docs.where(score(F.col("text"), model, docs) < threshold)
