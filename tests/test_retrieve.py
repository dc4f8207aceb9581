"""Retrieval against brute force, on every path."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.operators import retrieve as R

CATALOG = ["write a poem about rain", "debug the parser", "", "explain Ünïcode text", "write a poem about rain", "sort a list", "x"]
QUERIES = ["write a song about rain", "", "PARSER bug", "zzzz qqqq", "日本語テキスト"]


def grams(text):
    low = text.lower()
    return Counter(low[i : i + 2] for i in range(len(low) - 1))


def brute(k, threshold):
    docs = [grams(t) for t in CATALOG]
    known = set().union(*docs)
    out = {}
    for q, text in enumerate(QUERIES):
        mine = {g: n for g, n in grams(text).items() if g in known}
        norm = math.sqrt(sum(n * n for n in mine.values()))
        scored = []
        for c, doc in enumerate(docs):
            size = math.sqrt(sum(n * n for n in doc.values()))
            sim = sum(n * doc[g] for g, n in mine.items()) / (norm * size) if norm and size else 0.0
            scored.append((-sim, c))
        out[q] = [(c, round(-s, 9)) for s, c in sorted(scored)[:k] if -s >= threshold]
    return {q: v for q, v in out.items() if v}


def frames(spark):
    ask = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string")
    rows = spark.createDataFrame(list(enumerate(CATALOG)), "catalog_id long, text string")
    return ask, rows


@pytest.mark.parametrize("queries", [R.BLOCK_QUERIES, 2])
@pytest.mark.parametrize("k,threshold", [(2, 0.1), (3, 1.0), (2, -1.0)])
def test_bigram_top_k(spark, monkeypatch, k, threshold, queries):
    monkeypatch.setattr(R, "BLOCK_QUERIES", queries)
    ask, rows = frames(spark)
    got = {}
    for r in R.knn_bigram(ask, rows, k, threshold).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.catalog_id, round(r.similarity, 9)))
    assert got == brute(k, threshold)


def test_small_catalog_comes_back_whole(spark):
    ask, rows = frames(spark)
    got = R.knn_bigram(ask, rows, k=7).collect()
    assert len(got) == 35 and {r.similarity for r in got} == {1.0}


def test_parameters_are_checked(spark):
    ask, rows = frames(spark)
    with pytest.raises(ValueError):
        R.knn_bigram(ask, rows, k=0)
    with pytest.raises(ValueError):
        R.knn_bigram(ask, rows, threshold=1.5)


@pytest.mark.parametrize("queries", [R.BLOCK_QUERIES, 1])
def test_word_top_k(spark, monkeypatch, queries):
    monkeypatch.setattr(R, "BLOCK_QUERIES", queries)
    asked = [(0, "write a song about rain"), (1, "nothing shared here"), (2, "  "), (3, None)]
    ask = spark.createDataFrame(asked, "query_id long, text string")
    pool = spark.createDataFrame(list(enumerate(CATALOG)), "pos long, text string")
    got = {}
    for r in R.knn_words(ask, pool, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.catalog_id, r.similarity))
    none = [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert got == {0: [(0, 0.8), (4, 0.8), (5, 0.2)], 1: none, 2: none, 3: none}


def test_vectors(spark):
    ask = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<float>")
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0])], "catalog_id long, vector array<float>")
    got = [(r.catalog_id, round(r.similarity, 6)) for r in R.knn_vectors(ask, rows, 2).orderBy("rank").collect()]
    assert got == [(2, 1.0), (1, 0.707107)]
    pair = spark.range(1).select(R.cosine_vectors(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.0))))
    assert pair.first()[0] == 0.0


def test_requests_without_a_known_bigram(spark):
    ask = spark.createDataFrame([(0, "日本"), (1, "")], "query_id long, text string")
    _, rows = frames(spark)
    assert R.knn_bigram(ask, rows, k=2).count() == 0
    meta = {r.query_id: r for r in R.knn_metadata(ask, rows).collect()}
    assert [(meta[q].highest_similarity, meta[q].met_threshold, meta[q].total_candidates) for q in (0, 1)] == [(0.0, False, 7)] * 2


def test_metadata_of_a_small_catalog(spark):
    ask, rows = frames(spark)
    meta = R.knn_metadata(ask, rows.filter("catalog_id < 3"), k=3).collect()
    assert all(r.highest_similarity == 1.0 and r.met_threshold for r in meta)


def test_query_vectors_must_be_finite(spark):
    rows = spark.createDataFrame([(1, [1.0, 1.0])], "catalog_id long, vector array<double>")
    ask = spark.createDataFrame([(0, [float("nan"), 0.0])], "query_id long, vector array<double>")
    with pytest.raises(ValueError):
        R.knn_vectors(ask, rows)


def test_other_features_and_vocabulary(spark):
    import numpy as np

    def letters(texts):
        found = [(i, ord(c), n) for i, t in enumerate(texts) for c, n in Counter(t or "").items()]
        row, feature, count = zip(*found) if found else ((), (), ())
        return np.array(row, dtype=np.int64), np.array(feature, dtype=np.uint64), np.array(count, dtype=float)

    ask = spark.createDataFrame([(0, "ab")], "query_id long, text string")
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "aab"), (3, "c")], "catalog_id long, text string")
    got = [(r.catalog_id, round(r.similarity, 6)) for r in R.knn_bigram(ask, rows, 2, featurise=letters).orderBy("rank").collect()]
    assert got == [(2, 0.948683), (0, 0.707107)]
    # without "b" in the vocabulary the query is "a" alone
    got = R.knn_bigram(ask, rows.filter("catalog_id <> 1"), 1, vocabulary=rows.filter("catalog_id = 0"), featurise=letters).collect()
    assert [(r.catalog_id, r.similarity) for r in got] == [(0, 1.0)]
