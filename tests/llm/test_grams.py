"""The set of test windows: chance hashes, many holders, memory."""

import random
import tracemalloc

import numpy as np
import pytest

from tallyward.llm import decontaminate

from . import brute


@pytest.mark.parametrize("seed", range(6))
def test_scan_equals_brute_force(seed):
    """Few words, so that windows repeat within and between items."""
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(rng.randint(1, 30), some(rng.randint(0, 14))) for _ in range(40)]
    items += [(None, some(12)), (3, None), (4, " . ")]
    docs = [(i, some(rng.randint(0, 60)) + rng.choice(["", " d ", "D."]) + some(9)) for i in range(80)]
    grams = decontaminate.grams_of(iter(items), 10)
    got = []
    for doc, text in docs:
        n, spans, names = decontaminate.scan(text, grams)
        hit = sum(spans[1::2]) - sum(spans[::2])
        got.append((doc, n, hit, len(names), brute.sha(",".join(names)), hit > 0))
    assert sorted(got) == sorted(brute.contamination(docs, items))


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    plain, tried = decontaminate._hashes, []

    def crowded(row, at, size, seed):
        tried.append(seed)
        # All windows share a hash until the seed is changed.
        return plain(row, at, size, seed) if seed > size else np.zeros(len(at), dtype=np.uint64)

    monkeypatch.setattr(decontaminate, "_hashes", crowded)
    grams = decontaminate.grams_of([(1, "a b c d"), (2, "b c d e f")], 3)
    assert len(tried) == 2 and len(grams.windows[3].hashes) == 4
    assert decontaminate.scan("x b c d y", grams) == (5, [1, 4], ["1", "2"])
    assert decontaminate.scan("b c a", grams) == (3, [], [])


def test_memory_of_a_set_is_bounded_by_its_text():
    """A text of two million bytes, most of its words repeated."""
    rng = random.Random(1)
    words = [f"word{i}" for i in range(20_000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(1_000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    grams = decontaminate.grams_of(iter(items), 10)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(grams.windows[10].hashes) > 190_000
    assert held < 8 * size and peak < 20 * size
