"""Benchmark decontamination with a broadcast set of test n-grams.

Words of the benchmark items get numbers; a window of an item is a row of
numbers, known by a 64-bit hash. The sorted hashes of all windows go to every
task, with the numbers behind them. A document is turned into numbers by the same
table, where other words are 0. Only places with as many known words in a row as
a window has are looked up, and a place that meets a hash is compared with the
window's numbers, so a hit is no chance. Spark moves no document.

The set grows with the benchmark, not with the documents. It takes about 20 bytes
a window, and one entry a distinct word. What is behind one broadcast is bounded
by ``block_bytes`` of text, which has a window for every two bytes at most: a larger
benchmark goes in blocks of items, each scanned in turn, and the hits are put
together per document.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.shared import settled

# A-Z to a-z; every other ASCII byte that is no digit or letter to a blank.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


_FOUND = "_contamination"


@dataclass
class Windows:
    """The distinct windows of one length, by hash: where each stands in the row of
    all item words, and the items that hold it, ``holders[ends[i] : ends[i + 1]]``."""

    seed: int
    hashes: np.ndarray
    first: np.ndarray
    ends: np.ndarray
    holders: np.ndarray


@dataclass
class Grams:
    """Numbers of the items' words, all items' words in a row, item ids as text,
    and windows by length."""

    numbers: dict[bytes, int] = field(default_factory=dict)
    row: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    items: list[str] = field(default_factory=list)
    windows: dict[int, Windows] = field(default_factory=dict)


def _hashes(row: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of the windows of ``size`` numbers that start at ``at``."""
    total = np.full(len(at), np.uint64(seed), dtype=np.uint64)
    for step in range(size):
        total ^= row[at + step].astype(np.uint64)
        total *= np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    same = np.ones(len(at), dtype=bool)
    for step in range(size):
        same &= a[at + step] == b[to + step]
    return same


def _windows(row: np.ndarray, at: np.ndarray, item: np.ndarray, size: int) -> Windows:
    """Windows at ``at`` of the items ``item`` (-1: of none), in one hash order."""
    seed = size
    while True:
        hashes = _hashes(row, at, size, seed)
        order = np.lexsort((item, hashes))
        hashes, sorted_at, holders = hashes[order], at[order], item[order]
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        first = sorted_at[starts]
        lead = np.repeat(first, np.diff(np.append(starts, len(hashes))))
        # Two different windows of one hash: hash anew.
        if _equal(row, sorted_at, row, lead, size).all():
            break
        seed += 1 << 20
    own = np.cumsum(np.concatenate([[True], hashes[1:] != hashes[:-1]])) - 1
    fresh = holders >= 0
    fresh[1:] &= (holders[1:] != holders[:-1]) | (own[1:] != own[:-1])
    counts = np.bincount(own[fresh], minlength=len(starts))
    ends = np.concatenate([[0], np.cumsum(counts)])
    return Windows(seed, hashes[starts], first, ends.astype(np.int32), holders[fresh])


def grams_of(items: Iterable[tuple[object, str | None]], length: int) -> Grams:
    """The windows of ``(item_id, text)`` items; a shorter item is one window.

    An item without an id marks words, but is not counted as an item.
    """
    numbers, ids, row = {}, {}, array("i")
    sizes, owners = array("i"), array("i")
    for item, text in items:
        words = normal_words(text)
        if not words:
            continue
        row.extend(numbers.setdefault(w, len(numbers) + 1) for w in words)
        sizes.append(len(words))
        owners.append(-1 if item is None else ids.setdefault(str(item), len(ids)))
    flat = np.array(row, dtype=np.int32)
    lengths, owned = np.array(sizes, dtype=np.int64), np.array(owners, dtype=np.int32)
    begin = np.cumsum(lengths) - lengths
    grams = Grams(numbers, flat, list(ids))
    for size in np.unique(np.minimum(lengths, length)).tolist():
        part = np.flatnonzero(np.minimum(lengths, length) == size)
        n = lengths[part] - size + 1
        ahead = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = (np.repeat(begin[part], n) + ahead).astype(np.int32)
        grams.windows[size] = _windows(flat, at, np.repeat(owned[part], n), size)
    return grams


def scan(text: str | None, grams: Grams) -> tuple[int, list[int], list[str]]:
    """Words of a text, flat ``[start, end, ...]`` of its hit words, its items."""
    words = normal_words(text)
    if not words or not grams.windows:
        return len(words), [], []
    row = np.fromiter(map(grams.numbers.get, words, repeat(0)), np.int32, len(words))
    unknown = np.concatenate([[0], np.cumsum(row == 0)])
    edges, items = np.zeros(len(row) + 1, dtype=np.int32), set()
    for size, windows in grams.windows.items():
        if len(row) < size:
            continue
        at = np.flatnonzero(unknown[size:] == unknown[:-size])
        if not len(at):
            continue
        hashes = _hashes(row, at, size, windows.seed)
        place = np.minimum(np.searchsorted(windows.hashes, hashes), len(windows.hashes) - 1)
        met = windows.hashes[place] == hashes
        at, place = at[met], place[met]
        same = _equal(row, at, grams.row, windows.first[place], size)
        at, place = at[same], place[same]
        edges[at] += 1
        edges[at + size] -= 1
        for i in np.unique(place):
            items.update(windows.holders[windows.ends[i] : windows.ends[i + 1]].tolist())
    hit = np.concatenate([[0], np.cumsum(edges[:-1]) > 0, [0]]).astype(np.int8)
    names = sorted(grams.items[i] for i in items)
    return len(words), np.flatnonzero(np.diff(hit)).tolist(), names


def _scanned(docs: DataFrame, grams: Grams) -> DataFrame:
    """``docs`` with a struct ``_FOUND``: n_words, spans (of words), items."""
    sent = docs.sparkSession.sparkContext.broadcast(grams)

    @F.pandas_udf("n_words long, spans array<int>, items array<string>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame(
                [scan(t, sent.value) for t in batch], columns=["n_words", "spans", "items"]
            )

    return docs.withColumn(_FOUND, find("text"))


def _joined(blocks: list[list[int]]) -> list[int]:
    """The union of several lists of spans."""
    size = max((s[-1] for s in blocks if s), default=0)
    edges = np.zeros(size + 1, dtype=np.int32)
    for spans in blocks:
        np.add.at(edges, spans[::2], 1)
        np.add.at(edges, spans[1::2], -1)
    hit = np.concatenate([[0], np.cumsum(edges) > 0, [0]]).astype(np.int8)
    return np.flatnonzero(np.diff(hit)).tolist()


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, length: int = 10, block_bytes: int = 32 << 20
) -> DataFrame:
    """``doc_id, text, n_words, spans, items`` of every row of ``docs``.

    ``spans`` lists start and end (exclusive) of the runs of hit words in turn,
    ``items`` the sorted ids, as text, of items with a window in the document.
    Null and wordless texts have no words and no hits, null or wordless items no
    windows; an empty benchmark hits nothing. Repeated rows give repeated rows.
    Only ``doc_id`` and ``text`` of the documents, ``item_id`` and ``text`` of
    the benchmark are read.
    """
    docs = docs.select("doc_id", "text")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks == 1:
        found = _scanned(docs, grams_of(_items(benchmark), length))
        return found.select("doc_id", "text", f"{_FOUND}.*")
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    docs = settled(docs, "documents")
    held = []
    for block in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        found = _scanned(docs, grams_of(_items(part), length))
        held.append(settled(found.select("row", f"{_FOUND}.*"), "hits"))
    parts = held[0]
    for more in held[1:]:
        parts = parts.unionAll(more)

    @F.pandas_udf("array<int>")
    def union(spans: pd.Series) -> pd.Series:
        return pd.Series([_joined([s.tolist() for s in row]) for row in spans])

    whole = parts.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        union(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return docs.join(whole, "row").select("doc_id", "text", "n_words", "spans", "items")


def _items(benchmark: DataFrame) -> Iterator[tuple[object, str | None]]:
    """Rows of a benchmark (or block of one) whose size was checked, one by one."""
    return map(tuple, benchmark.select("item_id", "text").toLocalIterator())


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, length: int = 10, block_bytes: int = 32 << 20
) -> DataFrame:
    """``docs`` without the rows that hold any window of the benchmark.

    Null, empty and wordless texts stay, and so do repeated rows without a hit. An
    empty benchmark drops nothing. Columns beside ``doc_id`` and ``text`` are kept.
    """
    if (benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= block_bytes:
        found = _scanned(docs, grams_of(_items(benchmark), length))
        return found.where(F.size(f"{_FOUND}.spans") == 0).drop(_FOUND)
    dirty = find_contamination(docs, benchmark, length, block_bytes).where(F.size("spans") > 0)
    dirty = dirty.select(F.col("doc_id").alias("_dirty_id"), F.xxhash64("text").alias("_dirty_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_dirty_id")) & (
        F.xxhash64("text") == F.col("_dirty_hash")
    )
    return docs.join(dirty, same, "left_anti")


def cut_spans(text: str | None, spans: list[int]) -> str | None:
    """``text`` without the words of the spans, everything else as it was."""
    if text is None or not len(spans):
        return text
    raw, starts, ends, inside = text.encode(), [], [], False
    folded = raw.translate(_FOLD)
    marks = np.frombuffer(folded, dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks, [0]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    kept, at = [], 0
    for first, last in zip(spans[::2], spans[1::2]):
        kept.append(raw[at : starts[first]])
        at = ends[last - 1]
    return b"".join([*kept, raw[at:]]).decode()


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, length: int = 10, block_bytes: int = 32 << 20
) -> DataFrame:
    """``doc_id`` and ``text`` of all documents, the hit words taken out.

    A null text stays null, an empty one empty; repeated rows give repeated rows.
    """

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_spans(t, s.tolist()) for t, s in zip(text, spans)], dtype=object)

    found = find_contamination(docs, benchmark, length, block_bytes)
    return found.select("doc_id", cut("text", "spans").alias("text"))
