"""Queries over whole test tables against brute force, SQL or held-out labels."""

import collections

import duckdb
import pytest

import check
from tallyward.llm import line_dedup
from tallyward.llm import queries as q

from . import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    read = lambda sql: con.execute(sql).fetchall()
    return (
        read(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'"),
        read(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'"),
    )


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_personal_data(spark, tables):
    got = q.op2_personal_data(spark, DATA)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    assert _rows(got, *names) == sorted(brute.spans(tables[0], brute.PERSONAL))
    assert got.schema["spans"].dataType.simpleString() == "string"


def test_simhash(spark, tables):
    got = q.op3_simhash(spark, DATA)
    assert _rows(got, "doc_id", "fingerprint", "component_id") == sorted(brute.simhash(tables[0]))


def test_decontamination(spark, tables):
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = _rows(q.op4_decontamination(spark, DATA), *names)
    assert got == sorted(brute.contamination(*tables))
    assert any(r[-1] for r in got)


def test_secrets(spark, tables):
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    got = _rows(q.op5_secrets(spark, DATA), *names)
    assert got == sorted(brute.spans(tables[0], brute.SECRETS))


def _cut(docs, texts):
    """Lines taken out, counted by document and line."""
    before = collections.Counter((d, x) for d, t in docs for x in (t or "").split("\n"))
    after = collections.Counter((d, x) for d, t in texts for x in (t or "").split("\n"))
    return before - after


def test_line_dedup(spark, tables):
    """Against all pairs: nothing else goes, and nine tenths of the similar lines do."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = line_dedup.dedup_lines(docs)
    got = _cut(tables[0], [(r.doc_id, r.text) for r in found.collect()])
    want = _cut(tables[0], brute.line_dedup(tables[0]))
    equal = _cut(tables[0], brute.line_dedup(tables[0], similarity=1.0))
    assert not got - want and not equal - got
    assert (want - equal).total() >= 20
    assert (got - equal).total() >= 0.9 * (want - equal).total()
    hashes = {r.doc_id: brute.sha(r.text) for r in found.collect() if r.text is not None}
    query = {r.doc_id: r.kept_sha256 for r in q.op6_line_dedup(spark, DATA).collect()}
    assert {d: query[d] for d in hashes} == hashes


def test_mixing(spark, tables):
    rows = q.op7_mixing(spark, DATA).collect()
    size = {d: len(brute.WORD.findall(t or "")) for d, t in tables[0]}
    assert {r.doc_id: r.size for r in rows} == size
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(size.values()), rel=0.01)
    by: dict = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(sum(t) == pytest.approx(target, rel=0.02, abs=2) for (_, target), t in by.items())
    assert sorted(rows) == sorted(q.op7_mixing(spark, DATA).collect())


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [r for r in q.op8_toxicity(spark, data).collect() if r.held_out]
    rows = [r for r in rows if r.doc_id in labels]
    bad = [r.score for r in rows if labels[r.doc_id]]
    good = [r.score for r in rows if not labels[r.doc_id]]
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    assert wins / (len(bad) * len(good)) > 0.85
    assert sum(g >= 0.7 for g in good) <= 0.03 * len(good)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_quality_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    said = check.compare(spark, con, DATA, "op9", q.op9_quality, q.oracle_sql()["op9_quality"])
    assert said.startswith("ok"), said


def test_suffix_dedup(spark, tables):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = _rows(q.op10_suffix_dedup(spark, DATA), *names)
    assert got == sorted(brute.repeats(tables[0]))


def test_lm_scores(spark, tables):
    rows = {r.doc_id: r for r in q.op1_lm_scoring(spark, DATA).collect()}
    assert rows.keys() == {d for d, _ in tables[0]}
    for doc, text in tables[0]:
        n = len(brute.WORD.findall(text or ""))
        assert rows[doc].n_tokens == n and rows[doc].log_prob <= 0
