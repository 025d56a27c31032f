"""Plain versions of the operators' contracts, a text at a time."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
LAST = 2**63 - 1


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def roots(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def close_pairs(prints: list[int], radius: int):
    table = np.array(prints, dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(table[i] ^ table[:i]) <= radius):
            yield i, int(j)


def majority(hashes: list[int]) -> int:
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs) -> list[tuple]:
    prints = []
    for _, text in docs:
        words = WORD.findall((text or "").translate(LOW))
        grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
        grams = grams or ([" ".join(words)] if words else [])
        prints.append(majority([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]))
    root = roots(len(docs), close_pairs(prints, 2))
    least: dict = {}
    for (doc, _), r in zip(docs, root):
        if doc is not None:
            least[r] = min(doc, least.get(r, LAST))
    return [(d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(docs, prints, root)]


def contamination(docs, items) -> list[tuple]:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for item, text in items:
        words = word.findall((text or "").translate(LOW))
        size = min(10, len(words))
        for k in range(len(words) - size + 1) if words else ():
            windows[tuple(words[k : k + size])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = word.findall((text or "").translate(LOW)), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if tuple(words[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(words[k : k + size])]
        ids = sorted(str(i) for i in found - {None})
        out.append((doc, len(words), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0


def _digits(m) -> str:
    return re.sub("[^0-9]", "", m[0])


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (
        "ip",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        lambda m: all(int(x) <= 255 for x in m[0].split(".")),
    ),
    (
        "card",
        r"[0-9]([\x20-]?[0-9])+",
        lambda m: 14 <= len(_digits(m)) <= 19 and luhn(_digits(m)),
    ),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(_digits(m)) <= 15),
]
SECRETS = [
    (
        "assign",
        r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[2]) >= 8,
    ),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
]


def spans(docs, kinds) -> list[tuple]:
    """Counts by kind and the digest of the base spans."""
    out = []
    for doc, text in docs:
        found = sorted(
            (m.start(), no, kind, m.end())
            for no, (kind, pattern, good) in enumerate(kinds)
            for m in re.finditer(pattern, text or "")
            if good(m)
        )
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
        out.append((doc, *(sum(f[1] == n for f in found) for n in range(len(kinds))), sha(listed)))
    return out


def repeats(docs, length: int = 50) -> list[tuple]:
    rows = sorted(((LAST if d is None else d), (t or "").encode()) for d, t in docs)
    first: dict[bytes, int] = {}
    for doc, raw in rows:
        for k in range(len(raw) - length + 1):
            first.setdefault(raw[k : k + length], doc)
    out = []
    for doc, raw in rows:
        marks = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < doc:
                marks[k : k + length] = b"\1" * length
        kept = bytes(b for b, m in zip(raw, marks) if not m)
        runs = len(re.findall(rb"\x01+", bytes(marks)))
        doc = None if doc == LAST else doc
        out.append((doc, len(raw), sum(marks), runs, hashlib.sha256(kept).hexdigest()))
    return out


def edit_distance(a, b) -> int:
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def line_dedup(docs, similarity: float = 0.8) -> list[tuple]:
    """Texts without repeated and similar lines, by all pairs of lines; rows with one
    id and text are one document."""
    word, nodes, places = re.compile(r"[^\x00-/:-`{-\x7F]+"), {}, []
    distinct = sorted({(LAST if d is None else d, t or "") for d, t in docs})
    for doc, text in distinct:
        for at, line in enumerate(text.split("\n")):
            words = tuple(word.findall(line.lower()))
            if words:
                places.append((doc, text, at, nodes.setdefault(words, len(nodes))))
    lines, links = list(nodes), []
    bags = [collections.Counter(x) for x in lines]
    order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
    for at, i in enumerate(order):
        a, most = lines[i], int(len(lines[i]) * (1 - similarity) + 1e-9)
        for j in reversed(order[:at]):
            b = lines[j]
            if len(a) - len(b) > most:
                break
            # Fewer words in common than that, and no edits are enough.
            if (bags[i] & bags[j]).total() >= len(a) - most and edit_distance(a, b) <= most:
                links.append((i, j))
    root = roots(len(lines), links)
    owner: dict[int, int] = {}
    seen, gone = set(), collections.defaultdict(set)
    for doc, text, at, node in places:
        first = owner.setdefault(root[node], doc)
        key = (root[node], doc, text)
        if doc > first or key in seen:
            gone[doc, text].add(at)
        seen.add(key)
    out = []
    for doc, text in docs:
        cut = gone[LAST if doc is None else doc, text or ""]
        kept = [x for i, x in enumerate((text or "").split("\n")) if i not in cut]
        out.append((doc, None if text is None else "\n".join(kept)))
    return out
