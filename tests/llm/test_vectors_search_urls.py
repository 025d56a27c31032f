"""Whitening, lexical search and URL filters against plain versions."""

import collections
import json
import math
import re

import duckdb
import numpy as np
import pytest

import check
from tallyward.llm import lexical_search, queries, singular, url_filter, whitening

DATA = "/root/testdata/sf0.001"


# -- singular values ---------------------------------------------------------


def _matrices():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    return {
        "one": np.array([[3.0]]),
        "random": np.linalg.qr(rng.normal(size=(90, 40)))[1],
        "graded": np.triu(rng.normal(size=(30, 30))) * 10.0 ** -(np.arange(30)[:, None] / 3),
        "equal": np.eye(10),
        "nought": np.zeros((5, 5)),
        "rank 3": np.linalg.qr(rng.normal(size=(40, 3)) @ rng.normal(size=(3, 12)))[1],
        "close": q @ np.diag([5, 5 - 1e-13, 5 - 1e-10, 4, *np.linspace(1, 0.1, 16)]) @ q.T,
        "wilkinson": np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1),
    }


@pytest.mark.parametrize("name", list(_matrices()))
def test_singular_values_and_vectors(name):
    r = _matrices()[name]
    squares, vectors = singular.largest(r, 4)
    want = np.linalg.svd(r, compute_uv=False)
    top = max(want[0] ** 2, 1e-300)
    k = len(vectors)
    assert np.abs(squares - want**2).max() <= 1e-13 * top
    assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-13
    assert np.abs(r.T @ (r @ vectors.T) - vectors.T * squares[:k]).max() <= 1e-13 * top


def test_small_singular_values_keep_their_digits():
    diagonal = 10.0 ** -np.arange(0, 24, 2)
    upper = np.full(11, 1e-3) * diagonal[:-1]
    squares = singular.squared_values(diagonal, upper)
    # The determinant is the product of the diagonal, whatever lies above it.
    assert np.isclose(np.log(squares).sum(), 2 * np.log(diagonal).sum(), rtol=1e-14)


# -- whitening ---------------------------------------------------------------


def _plain_whitening(rows, components=4):
    rows = [
        (i, [math.floor(float(c) * 256) for c in v])
        for i, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    width = max(len(v) for _, v in rows)
    x = np.array([v + [0] * (width - len(v)) for _, v in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for (i, _), own in zip(rows, x):
        deviation = sum((n * int(c) - int(s)) ** 2 for c, s in zip(own, sums))
        for k in range(min(components, width)):
            w = (own - sums / n) @ vectors[:, k] / math.sqrt(values[k])
            out.append((i, k + 1, n, deviation, w, values[k] / values.sum()))
    return out


def _check_whitening(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for component in range(1, 5):
        mine = np.array([r[4] for r in got if r[1] == component])
        theirs = np.array([r[4] for r in want if r[1] == component])
        if len(mine):
            sign = np.sign(mine @ theirs)
            assert np.abs(mine - sign * theirs).max() < 1e-9
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(r[6] < 1e-9 for r in got)


def test_whitening_of_the_table(spark):
    got = queries.op11_whitening(spark, DATA)
    names = "vec_id component n deviation whitened explained identity_error".split()
    assert got.columns == names
    con = duckdb.connect()
    rows = con.execute(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet'").fetchall()
    _check_whitening(got.collect(), _plain_whitening(rows))


def test_whitening_of_dirty_rows(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(size=(60, 6)).round(3).tolist()
    rows = [(i, v) for i, v in enumerate(good)]
    rows += [(100, None), (101, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6)]
    rows += [(103, [float("inf")] + [0.0] * 5), (104, [0.5, -0.5]), (None, good[3])]
    rows += [(7, good[7])] * 30 + [(200, good[0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table = table.selectExpr("*", "1 AS x", "2 AS w", "3 AS n", "'a' AS deviation")
    got = whitening.whiten(table.repartition(5), fan_in=2, block=7).collect()
    _check_whitening(got, _plain_whitening(rows))


def test_whitening_without_variance(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).collect() == []
    assert whitening.whiten(make([(1, None), (2, [])])).collect() == []
    same = whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [tuple(r) for r in same] == [
        (i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)
    ]
    line = whitening.whiten(make([(i, [float(i), 2.0 * i]) for i in range(9)])).collect()
    assert all(r.whitened is None and abs(r.explained) < 1e-12 for r in line if r.component == 2)
    assert all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-9 for r in line if r.component == 1)
    far = whitening.whiten(make([(1, [1e30]), (2, [-1e30]), (3, [0.0])])).collect()
    assert {r.deviation for r in far if r.vec_id != 3} == {None} and len(far) == 3


# -- lexical search ----------------------------------------------------------

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def _plain_search(docs, items, k=10):
    terms = [(d, _TERM.findall((t or "").translate(_LOW))) for d, t in docs]
    terms = [(d, own) for d, own in terms if own]
    n, total = len(terms), sum(len(own) for _, own in terms)
    df = collections.Counter(w for _, own in terms for w in set(own))
    pooled = collections.defaultdict(list)
    for item, text in items:
        pooled[item] += _TERM.findall((text or "").translate(_LOW))
    out = []
    for item, wanted in pooled.items():
        scored = []
        for doc, own in terms:
            tf, m = collections.Counter(own), 25 + (75 * len(own) * n) // total
            score = 0
            for w in wanted:
                if tf[w]:
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                    score += weight * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, missing, doc) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if missing else doc, -score))
    return out


_KEY = lambda r: (r[0] is None, r[0] or 0, r[1])


def _search(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=_KEY)


def test_search_of_the_table(spark):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    got = _search(queries.op12_lexical_search(spark, DATA))
    assert got == sorted(_plain_search(docs, items), key=_KEY)
    sql = con.execute(queries.oracle_sql()["op12_lexical_search"])
    at = [[d[0] for d in sql.description].index(c) for c in ("item_id", "rank", "doc_id", "score")]
    assert got == sorted((tuple(r[i] for i in at) for r in sql.fetchall()), key=_KEY)


@pytest.fixture
def small(spark):
    texts = ["Red fox, red FOX 7", "", None, "!!!", "blue FOX über", "über " * 400 + "fox", "owl"]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(50 - i, "red fox copies") for i in range(30)]
    docs += [(None, "red fox copies"), (21, "red fox copies"), (21, "red fox copies")]
    docs += [(60 + i, f"fox red {i} copies") for i in range(12)]
    items = [(1, "red fox"), (2, "RED red über"), (3, None), (4, "..."), (5, "nowhere"), (None, "owl")]
    items += [(6, "copies"), (6, "blue")]
    made = (
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS m"),
        spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS term"),
    )
    return docs, items, made


@pytest.mark.parametrize(
    "limits", [{}, {"most_terms": 2}, {"block_terms": 2}, {"most_pairs": 3}, {"k": 3}]
)
def test_search_of_dirty_rows(small, limits):
    docs, items, (docs_df, items_df) = small
    got = _search(lexical_search.search(docs_df.repartition(3), items_df, **limits))
    want = sorted(_plain_search(docs, items, limits.get("k", 10)), key=_KEY)
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
    assert got == want


def test_search_of_empty_tables(spark, small):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = small[2][1]
    assert lexical_search.search(none, asked).collect() == []
    assert lexical_search.search(small[2][0], asked.where("false")).collect() == []


def test_scores_beyond_doubles_stay_whole():
    rows = [("a", 0, 10**9, 9000), ("a", 1, 3, 7), ("b", 1, 1, 7)]
    block = lexical_search.Block(rows)
    assert not block.whole
    found = block.scores(np.array([0, 0]), np.array([0, 1]), np.array([5, 2]), np.array([25, 25]), 1)
    gain = [(10**9 * tf) // (1000 * tf + 200) for tf in (5, 2)]
    assert found.tolist() == [[9000 * 10**9 * gain[0] + 21 * gain[1], 7 * gain[1]]]


def test_equal_documents_are_one_class(spark, small):
    docs_df = small[2][0]
    terms = spark.createDataFrame([("red", 0), ("fox", 1)], "term string, number long")
    vectors = lexical_search._vectors(docs_df, terms, 10)
    found = lexical_search.classes(vectors, 50, 600, 4).collect()
    copies = [r.members for r in found if r.members[:2] == [21, 21]]
    assert copies == [[21, 21, 21, 22]]  # the row made first has the id 21 as well


# -- URL filters -------------------------------------------------------------


def _plain_parts(url):
    before, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match("[^/?#]*", rest)[0]
    return host.translate(_LOW), re.match("[^?#]*", rest[len(host) :])[0]


def _plain_rule(host, path):
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block",
             "com/fr/": "allow", "com/de/": "block"}
    fits = []
    for rule in rules:
        of, slash, start = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith(slash + start):
            fits.append(rule)
    return (max(fits, key=len), rules[max(fits, key=len)]) if fits else (None, None)


ODD = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/es/9", "http://a.com/de/?x=1",
    "http://org", "http://org/", "http://notorg.example/", "http://x.org?en/1", "http://com/fr/#a",
    "http://a.org:80/es/", "ftp://u@example.org/en/12#://x", "a://b://c.org/", "http://ÄÖ.org/ß/%20",
    "http://x.example.org/es", "http://example.org/EN/1", "http://a.net/" + "p/" * 5000 + "?" + "k=v&" * 900,
    "http://a.com\n/de/1", "http://a.com/de/\n1?a",
]


def test_hosts_paths_and_rules(spark):
    con = duckdb.connect()
    rows = con.execute(f"SELECT page_id, url FROM '{DATA}/pages.parquet'").fetchall()
    rows += [(1000 + i, u) for i, u in enumerate(ODD)] + [(None, ODD[5]), (1005, ODD[5])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    pages = pages.selectExpr("*", "1 AS host", "2 AS score", "3 AS n", "'x' AS part")
    got = url_filter.judge(pages).collect()
    order = lambda r: json.dumps(r)
    want = [(p, *_plain_parts(u), *_plain_rule(*_plain_parts(u))) for p, u in rows]
    mine = [(r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got]
    assert sorted(mine, key=order) == sorted(want, key=order)
    assert all(r.verdict in ("allow", "block") and 0 <= r.score <= 1 for r in got)


def test_trees_learn_from_labelled_urls(spark):
    rng = np.random.default_rng(9)
    urls, bad = [], []
    for i in range(3000):
        bad.append(bool(rng.random() < 0.4))
        host = f"{'x' * rng.integers(3, 6)}{rng.integers(10)}.net"
        tail = f"/{rng.integers(10**11)}/{i}?a={i}&b=2&c=3" if bad[-1] else f"/news/story-{i}"
        urls.append(f"http://{host}{tail}")
    known, rest = 2000, range(2000, 3000)
    labelled = spark.createDataFrame(
        [*zip(urls[:known], bad[:known]), (None, True), ("http://z.net/", None)],
        "url string, blocked boolean",
    )
    pages = spark.createDataFrame([(i, urls[i]) for i in rest], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, labelled, sample_urls=1000).collect()}
    right = [(got[i].verdict == "block") == bad[i] for i in rest]
    assert len(got) == 1000 and sum(right) >= 980
    assert all(r.rule is None for r in got.values())


def test_one_kind_of_label_blocks_nothing(spark):
    rows = [(i, f"http://a{i}.org/en/{i}") for i in range(40)] + [(99, "http://a.net/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string").where("url not like '%/en/1%'")
    got = url_filter.judge(pages).collect()
    assert {r.verdict for r in got} == {"allow"} and {r.score for r in got} == {0.5}
    assert url_filter.judge(pages.where("false")).collect() == []
