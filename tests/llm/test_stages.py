"""The stages of the pipeline on clashing columns, repeated and NULL ids, and empty tables."""

from __future__ import annotations

import time

import pytest

from tabulens.llm import mixing, neardup, secrets, toxicity

CLASHING = (
    "doc_id long, text string, lang string, source string, n_chars long, _rules string, _candidate string, _found_rules string, "
    "_r string, _pass string, _words string, _size string, _id string, _mark string, _kept_id string, _kept_mark string, _row string, _score string"
)
EXTRA = tuple(f"own{i}" for i in range(13))
A = " ".join(f"word{i}" for i in range(60))
B = A + " end"
OTHER = " ".join(f"thing{i}" for i in range(60)) + " password=abcdef1"


@pytest.fixture
def docs(spark):
    texts = [(1, B), (5, A), (5, OTHER), (5, OTHER), (None, A), (None, "nameless " + OTHER[::-1]), (None, "nameless " + OTHER[::-1]), (7, None), (8, ""), (8, "")]
    return spark.createDataFrame([(i, t, "en", "s", None, *EXTRA) for i, t in texts], CLASHING)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality long, toxic long")


def test_one_row_of_each_group_stays(docs):
    found = neardup.deduplicated(docs)
    assert found.columns == docs.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str)
    assert rows == sorted([(1, B), (5, OTHER), (None, "nameless " + OTHER[::-1]), (7, None), (8, ""), (8, "")], key=str)


def test_secrets_go_and_columns_stay(docs):
    found = secrets.redact(docs)
    assert found.columns == docs.columns
    rows = found.collect()
    assert len(rows) == 10 and sum("[SECRET]" in (r["text"] or "") for r in rows) >= 2
    assert all(tuple(r)[5:] == EXTRA for r in rows)


def test_mixed_documents_keep_their_columns(docs):
    found = mixing.mixed_documents(docs)
    assert found.columns == docs.columns
    assert all(tuple(r)[5:] == EXTRA for r in found.collect())


def test_clean_keeps_what_no_label_speaks_against(docs, labels):
    found = toxicity.clean(docs, labels)
    assert found.columns == docs.columns and all(tuple(r)[5:] == EXTRA for r in found.collect())


def test_stages_of_an_empty_table(docs, labels):
    none = docs.where("doc_id > 1000")
    for stage in (neardup.deduplicated, secrets.redact, mixing.mixed_documents, lambda d: toxicity.clean(d, labels)):
        found = stage(none)
        assert found.columns == docs.columns and found.collect() == []


def test_long_runs_of_letters_take_linear_time(spark):
    """A second each or so; in squared time each would take minutes."""
    texts = [(1, "x:// " + "k" * 400_000), (2, "eyJ" * 150_000 + " eyJ"), (3, "m" * 300_000 + "://user:word@")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    started = time.time()
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    assert time.time() - started < 60
    assert found == {1: "", 2: "", 3: "login_url:299968:300013"}
