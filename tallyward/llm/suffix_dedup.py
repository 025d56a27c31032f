"""Removal of long byte strings that an earlier document has as well.

Only suffixes whose first ``LENGTH`` bytes can repeat elsewhere are sorted. Of
the hashes of 16 bytes inside such a string the smallest is its anchor, so equal
strings have equal anchors. An anchor that only one document has rules its
strings out. Strings in a row with one anchor travel together as one segment,
segments meet by anchor, and their suffixes are sorted (``suffixes``); equal ones
form classes, and the smallest document of a class is the one that keeps the
string.

A text that a smaller document has as a whole needs no search; such copies are
found by two hashes of the text. Other documents are read in blocks, by a hash of
their id. A block merges equal anchors and segments before anything is shuffled,
so what a third of all documents hold travels once a block. An anchor that more than ``hot_docs``
documents have may come with ever new neighbours: its strings are dealt one by
one, by their own hash. The three passes over the blocks read one shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.shared import partitions, settled
from tallyward.llm.suffixes import sort_suffixes

LENGTH = 50
_GRAM = 16
_LAST = 2**63 - 1
_MOST_IN_RUN = 64


def anchors_of(raw: bytes) -> np.ndarray:
    """The anchor of the string at every place of a text; none if it is short.

    An anchor is the smallest hash of the 16-byte pieces of the string.
    """
    if len(raw) < LENGTH:
        return np.empty(0, dtype=np.int64)
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).astype(np.uint64)
    h = words[:-8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h += words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    span, got = LENGTH - _GRAM + 1, 1
    while 2 * got <= span:
        h = np.minimum(h[:-got], h[got:])
        got *= 2
    if got < span:
        h = np.minimum(h[: got - span], h[span - got :])
    return h.view(np.int64)


def runs_of(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches with one anchor, cut to a bounded length."""
    starts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    sizes = np.diff(np.append(starts, len(anchors)))
    if sizes.max() > _MOST_IN_RUN:
        n = -(-sizes // _MOST_IN_RUN)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(starts, n) + step * _MOST_IN_RUN
        sizes = np.minimum(np.repeat(sizes, n) - step * _MOST_IN_RUN, _MOST_IN_RUN)
    return starts, sizes


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def packed(texts: pd.Series) -> pd.Series:
    """UTF-8 bytes, compressed: they are the most that is shuffled."""
    return pd.Series(list(map(zstandard.compress, (t.encode() for t in texts))), dtype=object)


def _raw(rows: pd.DataFrame) -> list[bytes]:
    return [zstandard.decompress(p) for p in rows["packed"]]


def _texts(rows: pd.DataFrame, copies: pd.DataFrame) -> list[tuple[bytes, list[int]]]:
    """Distinct texts of a block with their documents, in a fixed order.

    ``copies`` names documents, with the hash of their text, whose whole text a
    smaller document has: they are left out.
    """
    gone = set(zip(copies["doc"].tolist(), copies["text_key"].tolist()))
    docs_gone = {doc for doc, _ in gone}
    found: dict[bytes, list[int]] = {}
    for doc, raw in zip(rows["doc"].tolist(), _raw(rows)):
        if doc in docs_gone and (doc, _signed(xxhash.xxh64_intdigest(raw, 42))) in gone:
            continue
        found.setdefault(raw, []).append(doc)
    return sorted(found.items(), key=lambda x: (min(x[1]), x[0]))


def block_anchors(rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
    """``anchor, doc, n`` of a block: for each anchor its smallest document with
    the number of them, and the largest if there are several."""
    anchors, firsts, lasts, counts = [], [], [], []
    for raw, docs in _texts(rows, _copies_in(notes)):
        own = anchors_of(raw)
        if len(own):
            own = np.unique(own[runs_of(own)[0]])
            anchors.append(own)
            firsts.append(np.full(len(own), min(docs)))
            lasts.append(np.full(len(own), max(docs)))
            counts.append(np.full(len(own), len(set(docs))))
    if not anchors:
        return pd.DataFrame({"anchor": [], "doc": [], "n": []}).astype("int64")
    anchor = np.concatenate(anchors)
    order = np.argsort(anchor, kind="stable")
    anchor = anchor[order]
    at = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first = np.minimum.reduceat(np.concatenate(firsts)[order], at)
    last = np.maximum.reduceat(np.concatenate(lasts)[order], at)
    n = np.add.reduceat(np.concatenate(counts)[order], at)
    more = first != last
    return pd.DataFrame(
        {
            "anchor": np.concatenate([anchor[at], anchor[at][more]]),
            "doc": np.concatenate([first, last[more]]),
            "n": np.concatenate([n, np.zeros(more.sum(), dtype=np.int64)]),
        }
    )


def _segments(
    texts: list[tuple[bytes, list[int]]], known: np.ndarray, hot: frozenset[int]
) -> Iterator[tuple[int, list[tuple[int, int, int, int, bytes]]]]:
    """For each text its segments with an anchor of ``known`` (sorted): ``start,
    size, anchor, part, bytes``; ``part`` is 0 but for strings of ``hot`` anchors,
    which are dealt one by one."""
    for number, (raw, _) in enumerate(texts):
        anchors = anchors_of(raw)
        if not len(anchors) or not len(known):
            continue
        starts, sizes = runs_of(anchors)
        own = anchors[starts]
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = np.flatnonzero(known[at] == own)
        found = []
        for start, size, anchor in zip(
            starts[hit].tolist(), sizes[hit].tolist(), own[hit].tolist()
        ):
            if anchor in hot:
                for i in range(start, start + size):
                    piece = raw[i : i + LENGTH]
                    found.append((i, 1, anchor, 1 + zlib.crc32(piece) % 4096, piece))
            else:
                end = start + size + LENGTH - 1
                found.append((start, size, anchor, 0, raw[start:end]))
        if found:
            yield number, found


def segment_id(anchor: int, part: int, piece: bytes) -> int:
    """64 bits that tell a segment from others with its anchor."""
    return _signed(xxhash.xxh64_intdigest(piece, (anchor ^ part) & (1 << 64) - 1))


def block_segments(rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
    """Distinct segments of a block with their smallest and largest document."""
    texts = _texts(rows, _copies_in(notes))
    shared = notes[notes["kind"] == _SHARED]
    known = np.unique(shared["anchor"].to_numpy())
    hot = frozenset(shared["anchor"][shared["part"] > 0].tolist())
    ends: dict[tuple, list[int]] = {}
    for number, found in _segments(texts, known, hot):
        low, high = min(texts[number][1]), max(texts[number][1])
        for _, _, anchor, part, piece in found:
            own = ends.setdefault((anchor, part, piece), [low, high])
            own[0], own[1] = min(own[0], low), max(own[1], high)
    return pd.DataFrame(
        {
            "anchor": pd.Series([k[0] for k in ends], dtype="int64"),
            "part": pd.Series([k[1] for k in ends], dtype="int32"),
            "segment": pd.Series([k[2] for k in ends], dtype=object),
            "first": pd.Series([v[0] for v in ends.values()], dtype="int64"),
            "last": pd.Series([v[1] for v in ends.values()], dtype="int64"),
        }
    )


def owners(rows: pd.DataFrame) -> pd.DataFrame:
    """``doc, anchor, part, id, lows`` of segments whose groups are whole in
    ``rows``: the block's smallest document and, for each string, the smallest of
    all, one value if all are alike. Segments no smaller document shares a string
    with are left out."""
    group = rows.groupby(["anchor", "part"], sort=False).ngroup().to_numpy()
    firsts, pieces = rows["first"].to_numpy(), rows["segment"].tolist()
    # Equal segments of a group are one; their strings are sorted once.
    numbers: dict[tuple[int, bytes], int] = {}
    which = np.array(
        [numbers.setdefault(key, len(numbers)) for key in zip(group.tolist(), pieces)]
    )
    low = np.full(len(numbers), _LAST)
    np.minimum.at(low, which, firsts)
    own = np.fromiter((g for g, _ in numbers), dtype=np.int64, count=len(numbers))
    several = np.flatnonzero(np.bincount(own)[own] > 1)
    lows: list = [[x] for x in low.tolist()]
    if len(several):
        distinct = [p for _, p in numbers]
        texts = [distinct[i] for i in several]
        sizes = np.array([len(t) - LENGTH + 1 for t in texts])
        at = np.cumsum([0, *(len(t) for t in texts)])[:-1]
        row = np.repeat(np.arange(len(texts)), sizes)
        starts = np.repeat(at - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        order, cls = sort_suffixes(
            b"".join(texts) + bytes(8), starts, own[several][row], LENGTH
        )
        least = np.full(cls[-1] + 1, _LAST)
        np.minimum.at(least, cls, low[several][row[order]])
        found = np.empty(len(starts), dtype=np.int64)
        found[order] = least[cls]
        ends = np.cumsum(sizes)
        flat = np.minimum.reduceat(found, ends - sizes) == np.maximum.reduceat(
            found, ends - sizes
        )
        for i, lo, hi, alike in zip(
            several.tolist(), (ends - sizes).tolist(), ends.tolist(), flat.tolist()
        ):
            lows[i] = [int(found[lo])] if alike else found[lo:hi].tolist()
    least = np.array([min(x) for x in lows])
    kept = np.flatnonzero(least[which] < rows["last"].to_numpy())
    return pd.DataFrame(
        {
            "doc": firsts[kept],
            "anchor": rows["anchor"].to_numpy()[kept],
            "part": rows["part"].to_numpy()[kept],
            "id": np.array(
                [
                    segment_id(a, p, pieces[i])
                    for i, a, p in zip(
                        kept.tolist(),
                        rows["anchor"].to_numpy()[kept].tolist(),
                        rows["part"].to_numpy()[kept].tolist(),
                    )
                ],
                dtype=np.int64,
            ),
            "lows": [lows[i] for i in which[kept]],
        }
    )


def whole_groups(batches: Iterator[pd.DataFrame], rows: int = 60_000) -> Iterator[pd.DataFrame]:
    """``owners`` of sorted segments, in portions that end with a group."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        table = pd.concat(held, ignore_index=True)
        last = table[["anchor", "part"]].to_numpy()
        change = np.flatnonzero((last[1:] != last[:-1]).any(axis=1))
        if len(change):
            cut = int(change[-1]) + 1
            yield owners(table.iloc[:cut])
            table = table.iloc[cut:]
        held = [table]
    if sum(map(len, held)):
        yield owners(pd.concat(held, ignore_index=True))


def removed_spans(
    found: list[tuple[int, int, int, int, bytes]], lows: list, doc: int
) -> list[int]:
    """Flat ``[start, end, ...]`` of the bytes whose strings a smaller document has."""
    spans: list[int] = []

    def add(start: int, end: int) -> None:
        if spans and start <= spans[-1]:
            spans[-1] = max(spans[-1], end)
        else:
            spans.extend((start, end))

    for (start, size, *_), own in zip(found, lows):
        if own is None:
            continue
        if len(own) == 1:
            if own[0] < doc:
                add(start, start + size + LENGTH - 1)
        else:
            for i, low in enumerate(own):
                if low < doc:
                    add(start + i, start + i + LENGTH)
    return spans


def block_results(rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
    """``doc, kept, spans`` of every row of a block."""
    copies = _copies_in(notes)
    texts = _texts(rows, copies)
    answers = notes[notes["kind"] == _ANSWER]
    anchors = answers["anchor"].tolist()
    lows = dict(zip(zip(anchors, answers["id"].tolist()), answers["lows"].tolist()))
    known = np.unique(answers["anchor"].to_numpy())
    hot = frozenset(answers["anchor"][answers["part"] > 0].tolist())
    spans_of: dict[tuple[int, bytes], list[int]] = {}
    for number, found in _segments(texts, known, hot):
        raw, docs = texts[number]
        own = [lows.get((a, segment_id(a, part, piece))) for _, _, a, part, piece in found]
        for doc in set(docs):
            spans_of[doc, raw] = removed_spans(found, own, doc)
    whole = {(d, raw) for raw, docs in texts for d in docs}
    out_doc, out_kept, out_spans = [], [], []
    for doc, raw in zip(rows["doc"].tolist(), _raw(rows)):
        spans = spans_of.get((doc, raw), [])
        if (doc, raw) not in whole and len(raw) >= LENGTH:
            spans = [0, len(raw)]  # a copy of a smaller document
        edges = [0, *spans, len(raw)]
        out_doc.append(doc)
        out_kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
        out_spans.append(spans)
    return pd.DataFrame(
        {
            "doc": pd.Series(out_doc, dtype="int64"),
            "kept": pd.Series(out_kept, dtype=object),
            "spans": pd.Series(out_spans, dtype=object),
        }
    )


# What a block is told beside its rows, in one table: copies (doc, text_key),
# shared anchors (anchor; part 1 if hot) and answers (anchor, part, id, lows).
_COPY, _SHARED, _ANSWER = 0, 1, 2
_NOTES = {
    "kind": "int", "doc": "long", "text_key": "long", "anchor": "long", "part": "int",
    "id": "long", "lows": "array<long>",
}


def _notes(rows: DataFrame, kind: int) -> DataFrame:
    have = {"kind": F.lit(kind)} | {c: F.col(c) for c in rows.columns}
    none = {"array<long>": F.array()}
    return rows.select(
        "block",
        *(
            have.get(name, none.get(type_, F.lit(0))).cast(type_).alias(name)
            for name, type_ in _NOTES.items()
        ),
    )


def _copies_in(notes: pd.DataFrame) -> pd.DataFrame:
    return notes[notes["kind"] == _COPY]


def remove_repeats(
    docs: DataFrame, hot_docs: int = 100_000, block_bytes: int = 16 << 20
) -> DataFrame:
    """``doc_id, n_bytes, kept, spans`` of every row of ``docs``.

    A byte goes if a string of 50 bytes that covers it also starts in a document
    with a smaller id. ``kept`` holds the bytes left, ``spans`` start and end
    (exclusive) of the removed runs in turn. A null id counts as larger than any
    other, below 2**63 - 1; rows with one id, null ids included, take nothing
    from each other. Null and empty texts have no bytes. Repeated rows give
    repeated rows. Only ``doc_id`` and ``text`` are read.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(2 * partitions(docs.sparkSession), -(-size // block_bytes))

    def block_of(doc: str) -> Column:
        return F.pmod(F.xxhash64(doc), F.lit(blocks)).cast("int").alias("block")

    texts = docs.select(
        F.coalesce("doc_id", F.lit(_LAST)).alias("doc"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    pack = F.pandas_udf(packed, "binary")
    rows = texts.select("doc", pack("text").alias("packed"), block_of("doc"))

    # A text that a smaller document has as a whole needs no search.
    keyed = texts.select(
        "doc", F.xxhash64("text").alias("text_key"), F.xxhash64(F.lit(7), "text").alias("other")
    )
    firsts = keyed.groupBy("text_key", "other").agg(F.min("doc").alias("first"))
    copies = keyed.join(firsts, ["text_key", "other"]).where("doc > first")
    copies = settled(copies.select(block_of("doc"), "doc", "text_key").distinct(), "copies")
    copies = _notes(copies, _COPY)

    anchors = (
        rows.groupBy("block")
        .cogroup(copies.groupBy("block"))
        .applyInPandas(block_anchors, "anchor long, doc long, n long")
    )
    whole = Window.partitionBy("anchor")
    shared = (
        anchors.withColumn("first", F.min("doc").over(whole))
        .withColumn("last", F.max("doc").over(whole))
        .withColumn("part", (F.sum("n").over(whole) > hot_docs).cast("int"))
        .where("first < last")
        .select(block_of("doc"), "anchor", "part")
    )
    segments = (
        rows.groupBy("block")
        .cogroup(_notes(shared, _SHARED).unionAll(copies).groupBy("block"))
        .applyInPandas(
            block_segments, "anchor long, part int, segment binary, first long, last long"
        )
    )
    answers = (
        segments.repartition("anchor", "part")
        .sortWithinPartitions("anchor", "part")
        .mapInPandas(whole_groups, "doc long, anchor long, part int, id long, lows array<long>")
        .select(block_of("doc"), "anchor", "part", "id", "lows")
    )
    done = (
        rows.groupBy("block")
        .cogroup(_notes(answers, _ANSWER).unionAll(copies).groupBy("block"))
        .applyInPandas(block_results, "doc long, kept binary, spans array<int>")
    )
    gone = F.aggregate(
        F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long")),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return done.select(
        F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"),
        (F.octet_length("kept") + gone).alias("n_bytes"),
        "kept",
        "spans",
    )
