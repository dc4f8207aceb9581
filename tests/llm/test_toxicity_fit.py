"""Calibration of the lexicon, and its hits against naive search."""

import random

import numpy as np

from quillspark.llm import toxicity as X


def naive_hits(lexicon, folded):
    """Greatest weight by the place of the space before a word, by looking at every word and phrase."""
    found, at = {}, 0
    words = []
    for word in folded.split(" "):
        words.append((at, word))
        at += len(word) + 1
    for start, word in words:
        weights = [w for t, w in lexicon.terms.items() if word and (word.startswith(t[:-1]) if t.endswith("*") else word == t)]
        if weights and start > 0:
            found[start - 1] = max(weights)
    for phrase in lexicon.exceptions:
        key, place = f" {phrase} ", folded.find(f" {phrase} ")
        while place >= 0:
            found = {p: w for p, w in found.items() if not place <= p < place + len(key) - 1}
            place = folded.find(key, place + 1)
    return found


def test_hits_match_naive_search():
    lexicon = X.Lexicon({"idiot": 5.0, "trash": 4.0, "tra*": 1.0, "trashy*": 6.0, "zlow*": 3.0}, exceptions=("trash can", "big idiot sale"))
    rng = random.Random(3)
    vocabulary = ["idiot", "1d1ot", "trash", "can", "trashy", "trashyness", "zlowing", "xzlow", "big", "sale", "tra", "the", "ТRASH"]
    for _ in range(300):
        folded = X.fold(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25))))
        assert lexicon.hits(folded) == naive_hits(lexicon, folded)


def test_half_lies_where_recall_and_precision_balance():
    sure = np.array([-3.0, -1.0, 0.5, 2.0])
    assert X.balanced(sure, np.array([0.0, 0.0, 1.0, 1.0]), np.array([50.0, 50.0, 3.0, 3.0])) == -0.25
    assert X.balanced(sure, np.array([0.0, 1.0, 0.0, 1.0]), np.array([50.0, 1.0, 60.0, 30.0])) == 1.25


def test_one_sure_hit_in_a_long_text_is_enough(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.choice([20, 200, 2000]))]
        toxic = i % 6 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["grumblor", "vexnit", "Gr0mblik"])
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in X.score(docs, X.learn(docs, labels)).collect()}
    wrong = [i for i, _, toxic in rows if got[i] != toxic]
    assert len(wrong) <= 6


def test_texts_without_hits_stay_clean(spark):
    """Too few labels for any term, most of them toxic; then one term that explains few of the toxic rows."""
    rows = [(i, f"w{i} v{i}", int(i % 4 > 0)) for i in range(60)]
    more = [(100 + i, "zarnok w1" if i % 10 == 0 else f"u{i}", int(i % 4 > 0 or i % 10 == 0)) for i in range(600)]
    for table in (rows, more):
        docs = spark.createDataFrame([r[:2] for r in table] + [(-1, ""), (-2, None)], "doc_id long, text string")
        labels = spark.createDataFrame([(r[0], r[2]) for r in table], "doc_id long, toxic int")
        got = {r["doc_id"]: r["predicted"] for r in X.score(docs, X.learn(docs, labels)).collect()}
        assert all(got[i] == 0 for i, text, _ in [*table, (-1, "", 0), (-2, "", 0)] if "zarnok" not in text)
