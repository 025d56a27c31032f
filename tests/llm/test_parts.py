"""The numpy and Spark parts that operators are built from."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyward.llm import boosting, line_dedup, lm_scoring, mixing, simhash, toxicity
from tallyward.llm.components import connected_components
from tallyward.llm.suffixes import BlindTrie, sort_suffixes

from . import brute


@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))]
    links += [(100 + i, 101 + i) for i in range(30)]  # a long path
    links += [(200, 201 + i) for i in range(40)]  # a star
    got = {
        r.node: r.root
        for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    }
    root = brute.roots(300, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@given(st.sets(st.binary(min_size=6, max_size=6), max_size=40))
@settings(max_examples=60, deadline=None)
def test_blind_trie_sorts(texts):
    trie = BlindTrie()
    for text in texts:
        trie.add(text)
        trie.add(text)
    assert trie.in_order() == sorted(texts)


@given(st.text("ab", max_size=200), st.sampled_from([20, 33, 50]))
@settings(max_examples=60, deadline=None)
def test_suffix_order_equals_sorting(text, depth):
    raw = text.encode() + b"c" * depth
    starts = np.arange(len(text))
    group = starts % 2
    order, cls = sort_suffixes(raw + bytes(8), starts, group, depth)
    want = sorted((int(g), raw[s : s + depth]) for g, s in zip(group, starts))
    got = [(int(group[i]), raw[starts[i] : starts[i] + depth]) for i in order]
    assert got == want
    same = [a == b for a, b in zip(want, want[1:])]
    assert [bool(a == b) for a, b in zip(cls, cls[1:])] == same


def test_ball_links_connect_all_within_radius(spark):
    rng = np.random.default_rng(4)
    prints = {int(x) for x in rng.integers(0, 2**63, 20)}
    for x in list(prints):
        for _ in range(6):
            x ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            prints.add(x)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {
        r.node: r.root for r in connected_components(simhash.ball_links(df, 2)).collect()
    }
    pairs = brute.close_pairs([p % (1 << 64) for p in prints], 2)
    root = brute.roots(len(prints), pairs)
    for i, p in enumerate(prints):
        assert got.get(p, p) == prints[root[i]]
    with pytest.raises(ValueError):
        simhash.ball_links(df, 3)


@pytest.mark.parametrize("n", [2, 10**3, 10**6, 10**9, 10**12])
def test_block_masks_cover_every_choice_of_bits(n):
    masks = [m % (1 << 64) for m in line_dedup.block_masks(n)]
    rng = np.random.default_rng(1)
    for _ in range(200):
        flip = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not m & flip for m in masks)
    assert min(m.bit_count() for m in masks) >= np.log2(n)


def _by_quotients(votes, seats):
    found = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * found[i] + 1), -i))
        found[best] += 1
    return found


@given(st.lists(st.integers(0, 300), min_size=1, max_size=8), st.integers(0, 60))
@settings(max_examples=150, deadline=None)
def test_apportionment_equals_highest_quotients(votes, seats):
    got = mixing.sainte_lague(votes, seats)
    if not sum(votes):
        assert got == [0] * len(votes)
        return
    from fractions import Fraction

    assert got == _by_quotients([Fraction(v) for v in votes], seats)


def test_targets_refill():
    got = mixing.targets([100, 1000, 10], [5, 2, 1], 1.5 * 1110)
    assert [float(x) for x in got] == [200.0, 1445.0, 20.0]


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = boosting.fit_trees(x[:1000], y[:1000])
    trees.scale = boosting.calibrate(trees.margin(x[1000:]), y[1000:])
    p = trees.probability(x[1000:])
    assert ((p > 0.5) == y[1000:]).mean() > 0.95
    assert abs(p.mean() - y[1000:].mean()) < 0.02


def test_kernel_counts_subsequences():
    a, b = toxicity.codes(["cat"], -1), toxicity.codes(["cart"], -2)
    # Of length 2: ca (2 letters in both), at (2 and 3), ct (3 and 4).
    want = 0.5**4 + 0.5**5 + 0.5**7
    assert toxicity.subsequence_kernel(a, b, 2, 0.5)[0] == pytest.approx(want)


def test_similarity_bears_inserted_characters():
    marks = toxicity.Landmarks(["worthless"])
    hidden, near, other = marks.similarity(["worth.less", "worthlezs", "thereness"])[:, 0]
    assert marks.similarity(["worthless"])[0, 0] == pytest.approx(1)
    assert hidden > 0.4 and near > 0.1 and other < 0.05


def test_similarity_equals_a_sum_over_subsequences():
    def weights(word, marks):
        found = {}
        for at in itertools.combinations(range(len(word)), 3):
            value = 1.0
            for c in word[at[0] : at[2] + 1]:
                value *= marks.decay if c.isalnum() else marks.apart
            for i in at:
                value *= (1 if word[i].isalnum() else marks.aside) / word.count(word[i])
            key = "".join(word[i] for i in at)
            found[key] = found.get(key, 0) + value
        return found

    landmarks = ["idiot", "scum", "a-hole"]
    marks = toxicity.Landmarks(landmarks, floors=np.array([0.0, 0.01, 0.1]))
    words = ["i.d.i.o.t", "s c u m", "hole", "ünïdiot", "xyz", "scumscum", "idioms-hole-a"]
    got = marks.similarity(words)
    for word, row in zip(words, got):
        for mark, floor, value in zip(landmarks, marks.floors, row):
            a, b = weights(word, marks), weights(mark, marks)
            norm = sum(x * x for x in a.values()) * sum(x * x for x in b.values())
            want = (sum(x * b.get(k, 0) for k, x in a.items()) / norm**0.5) ** marks.power
            assert value == pytest.approx(max(want - floor, 0) / (1 - floor), abs=1e-5)


def test_insertions_between_all_letters():
    marks = toxicity.Landmarks(["idiot"])
    hidden = ["i.d.i.o.t", "i**d**i**o**t", "i d i o t", "ixdxixoxt", "idxxiot", "idixxot"]
    clean = ["radio", "patriot", "edition", "idiom", "audition", "ration", "video", "dioxide"]
    found = marks.similarity(hidden)[:, 0]
    assert found[:3].min() > 0.9 and found[3:].min() > 0.1
    # "idiom" and "dioxide" share most of the letters, in order; others stay far below.
    rest = [w for w in clean if w not in ("idiom", "dioxide")]
    assert marks.similarity(rest)[:, 0].max() < found.min() / 2
    assert {"i d i o t"} <= toxicity.words_of("You i d i o t !!")
    assert not marks.similarity(["it", "id", "", "a\0b", "\0\0\0"]).any()
    assert marks.similarity([]).shape == (0, 1)


def test_network_gradient():
    shape = lm_scoring.Shape(classes=2, members=3, buckets=2, size=4, reach=1)
    rng = np.random.default_rng(0)
    net = lm_scoring.Network.start(shape, np.ones(6))
    ids = np.concatenate([[6], rng.integers(0, 6, 40), [6]])
    at = np.arange(1, 41)
    before = net.step(ids, at).sum()
    for _ in range(60):
        net.step(ids, at, 0.1)
    assert net.step(ids, at).sum() > before + 5
    assert not net.embed[-1].any()


def test_probabilities_of_a_place_add_up():
    shape = lm_scoring.Shape(classes=2, members=3, buckets=2, size=4, reach=1)
    net = lm_scoring.Network.start(shape, np.arange(6.0))
    total = 0
    for token in range(6):
        total += np.exp(net.step(np.array([6, 1, token, 2, 6]), np.array([2]))[0])
    assert total == pytest.approx(1, abs=1e-4)
