"""Decontamination and personal data against plain loops, and on very long, repetitive texts."""

import re
import time

import numpy as np
import pytest

from quillspark.llm import decontaminate as D, pii


def plain_overlaps(docs, items):
    """Every diagonal that holds a seed: its best run, and the longest run of each pair."""
    split = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    best = {}
    for doc_id, text in docs:
        h = split(text)
        for item_id, item in items:
            w = split(item)
            if doc_id is None or item_id is None or len(w) < D.SPAN:
                continue
            hit = lambda p, a: any(
                p + D.SPAN <= len(h) and a + D.SPAN <= len(w) and all(h[p + k] == w[a + k] for k in m) for m in D.MASKS
            )
            for shift in {p - a for p in range(len(h)) for a in range(len(w)) if hit(p, a)}:
                score = begin = equal = top = 0
                run = (0, 0, 0)
                for j in range(max(0, -shift), min(len(w), len(h) - shift)):
                    if score <= 0:
                        score, begin, equal = 0, j, 0
                    same = h[j + shift] == w[j]
                    score, equal = score + (1 if same else -D.MISMATCH), equal + same
                    if score > top:
                        top, run = score, (begin, j + 1, equal)
                if run[2] >= min(D.MIN_MATCHED, -(-len(w) * 6 // 10)):
                    key = (run[2], run[0] - run[1], -run[0] - shift, -run[0])
                    best[doc_id, item_id] = max(best.get((doc_id, item_id), key), key)
    return {(d, i, n, -l, -at, -it) for (d, i), (n, l, at, it) in best.items()}


@pytest.mark.parametrize("piece", [8, 4096])
def test_overlaps_equal_a_double_loop(spark, monkeypatch, piece):
    monkeypatch.setattr(D, "PIECE_WORDS", piece)
    rng = np.random.default_rng(11)
    text = lambda n, letters: " ".join(rng.choice(list(letters), size=n))
    items = [(i, text(n, letters)) for i, (n, letters) in enumerate([(9, "ab"), (14, "abc"), (30, "abcdefgh"), (25, "a"), (12, "xyz")])]
    items += [(2, text(20, "abcdefgh")), (7, None), (8, ""), (None, items[2][1])]
    docs = [(i, text(n, letters)) for i, (n, letters) in enumerate([(60, "ab"), (80, "abc"), (40, "a"), (70, "abcdefgh"), (9, "ab"), (8, "a")])]
    docs += [(20, f"{text(33, 'pq')} {items[2][1]} {text(21, 'pq')}"), (21, None), (22, ""), (None, items[2][1])]
    docs += [(0, f"q q {items[4][1]}"), (20, items[3][1])]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = D.overlaps(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert set(map(tuple, got)) == plain_overlaps(docs, items) and len(got) == len({(r.doc_id, r.item_id) for r in got})
    kept = D.keep_uncontaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    bad = {r.doc_id for r in got}
    assert sorted(map(str, kept)) == sorted(str(r) for r in frame(docs, "doc_id").collect() if r.doc_id not in bad)


def test_periodic_texts_end(spark):
    docs = spark.createDataFrame([(1, "a " * 60_000), (2, "a b " * 30_000), (3, "c " * 60_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a " * 300), (2, "b a " * 150)], "item_id long, text string")
    start = time.time()
    got = {(r.doc_id, r.item_id): (r.n_matched, r.doc_start) for r in D.overlaps(docs, items).collect()}
    assert got == {(1, 1): (300, 0), (2, 2): (300, 1)}
    assert time.time() - start < 120


def test_long_tokens_are_linear(spark):
    texts = [(1, "x" * 1_000_000), (2, "1" * 1_000_000), (3, "x" * 500_000 + "@" + "y" * 500_000 + " a@b.cc a@b.cc"), (4, "+" * 300_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r for r in pii.find(docs, pii.form_weights(docs)).collect()}
    assert time.time() - start < 60
    assert {i: r.n_email for i, r in got.items()} == {1: 0, 2: 0, 3: 2, 4: 0}


def test_every_form_counts(spark):
    """More forms than any table of the most frequent would keep: each still has its own log odds."""
    digits = lambda n: "".join("a1"[int(b)] for b in f"{n:016b}")
    docs = spark.createDataFrame([(n, f"{digits(n)}z") for n in range(1, 3000)] + [(9000, "a@b.cc " * 40)], "doc_id long, text string")
    weights = pii.form_weights(docs)
    shapes = {pii.form(f"{digits(n)}z") for n in range(1, 3000)} | {pii.form("a@b.cc")}
    odds = [weights.get(s, None) for s in shapes]
    assert len(shapes) > 1000 and None not in odds
    assert weights.get(pii.form("a@b.cc"), 0.0) > 3


def test_empty_tables_null_and_repeated_ids(spark):
    schema = "doc_id long, text string, bucket int, h string"
    docs = spark.createDataFrame([(1, "a@b.cc", 1, "x"), (1, None, 2, None), (None, "9.9.9.9", 3, "y")], schema)
    got = pii.find(docs, pii.form_weights(docs)).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip) for r in got) == [("1", 0, 0), ("1", 1, 0), ("None", 0, 1)]
    empty = docs.filter("false")
    assert pii.find(empty, pii.form_weights(empty)).count() == 0
    assert sorted(map(str, pii.redact(docs, pii.form_weights(docs)).collect())) == sorted(
        ["Row(doc_id=1, text='[EMAIL]', bucket=1, h='x')", "Row(doc_id=1, text=None, bucket=2, h=None)", "Row(doc_id=None, text='[IP]', bucket=3, h='y')"]
    )
    items = spark.createDataFrame([(1, "p q r s t u v w x y")], "item_id long, text string")
    assert D.overlaps(docs, items).count() == 0 and D.keep_uncontaminated(docs, items).count() == 3
