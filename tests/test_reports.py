"""Evaluation reports over repeated runs, held against plain counting."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evalreport as E


def test_frequent_words_match_plain_counting(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("alpha beta gamma delta Epsilon zeta one of éclair".split()) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += ["", None, "a an the", "word", "Same same SAME other other third"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: [tuple(w) for w in r.f or []] for r in df.select("i", E.frequent_words("t", 4).alias("f")).collect()}
    for i, t in enumerate(texts):
        kept = [w for w in (t or "").lower().split() if len(w) > 3]
        counts = Counter(kept)
        assert got[i] == sorted(counts.items(), key=lambda c: (-c[1], kept.index(c[0])))[:4]


def test_top_words_shuffle_nothing(spark):
    df = spark.createDataFrame([(1, "some words here")], "i long, t string")
    assert "Exchange" not in E.top_words(df, ["i"], "t")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [3, 256])
def test_pairs_of_runs_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK_RUNS", block)
    rng = random.Random(6)
    pick = lambda: sorted({rng.choice("abcdef") for _ in range(rng.randint(0, 5))})
    rows = [(case, run, pick(), pick()) for case, runs in ((1, 40), (2, 3), (3, 1)) for run in range(runs)]
    rows += [(1, 5, ["a"], ["b"]), (1, 5, ["a"], ["b"])]  # the same run again is no pair with itself
    sets = spark.createDataFrame(rows, "case_no long, run long, keywords array<string>, long_words array<string>").repartition(4)
    found = E.pair_similarity(sets)
    assert "BroadcastNestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0.0
    for r in found.collect():
        pairs = [(x, y) for x, y in combinations([r_ for r_ in rows if r_[0] == r.case_no], 2) if x[1] != y[1]]
        if not pairs:
            assert r.keyword_overlap is None and r.word_jaccard is None
            continue
        assert r.keyword_overlap == pytest.approx(sum(like(x[2], y[2]) for x, y in pairs) / len(pairs))
        assert r.word_jaccard == pytest.approx(sum(like(x[3], y[3]) for x, y in pairs) / len(pairs))
