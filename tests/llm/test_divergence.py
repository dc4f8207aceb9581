"""Divergence of sources, held against plain counting and against a count vectorizer."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from quillspark.llm import divergence
from tests.oracle_check import compare

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SHAPE = "doc_id long, text string, lang string, source string, term string, rank int"


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def plain(rows, min_docs, most=50):
    groups, docs, langs = {}, defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", TERM.findall(lowered(text))
        groups.setdefault((lang, source), Counter()).update(found)
        langs[lang].update(found)
        docs[lang].update(set(found))
    out = []
    for (lang, source), counts in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def p(held):
            total = sum(held[t] for t in kept)
            return {t: 1 + 10**9 * (held[t] + 5) // (total + 5 * len(kept)) for t in kept}

        mine, whole = p(counts), p(langs[lang])
        pairs = []
        for (other_lang, other), theirs in groups.items():
            if other_lang == lang and other != source:
                q = p(theirs)
                pairs.append((other, sum(abs(mine[t] - q[t]) for t in kept)))
        terms = [(t, mine[t] - whole[t]) for t in kept if counts[t] > 0 and mine[t] > whole[t]]
        for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
            for rank, (item, value) in enumerate(sorted(found, key=lambda r: (-r[1], r[0].encode()))[:limit], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i % 7 or None, t, l, s, "x", 1) for i, (t, l, s) in enumerate(rows)], SHAPE).repartition(4)


def texts():
    words = "alpha Beta gamma ÉCOLE école naïve 日本 x1y gamma's don't über Straße ZETA zeta".split()
    rows = []
    for i in range(240):
        picked = [words[(i * (j + 3) + j * j) % len(words)] for j in range(i % 11)]
        rows.append((" ".join(picked) + ("\x00\x7f." if i % 5 else ""), ["en", "fr", None][i % 3], [f"s{i % 4}", None, "hot", "hot"][i % 4]))
    rows += [(None, "en", "empty"), ("", "en", "empty"), ("123 !?", "de", "digits"), ("solo", "xx", "one"), (None, None, None)]
    return rows + rows[:50]


@pytest.mark.parametrize("min_docs", [1, 3, 12, 10_000])
def test_matches_plain_counting(spark, min_docs):
    rows = texts()
    got = divergence.divergence(frame(spark, rows), min_docs).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, min_docs)


def test_blocks_change_nothing(spark, monkeypatch):
    rows = [(" ".join(f"w{chr(97 + (i * j) % 26)}" for j in range(i % 9)), "en", f"s{i % 23}") for i in range(300)]
    want = plain(rows, 2)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 3)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 4)
    got = divergence.divergence(frame(spark, rows), 2).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_only_the_best_terms_are_given_and_ties_go_by_bytes(spark):
    rows = [(" ".join(chr(0x4E00 + i) for i in range(80)) + " z é", "ja", "a")] * 3 + [("q", "ja", "b")] * 3
    got = divergence.divergence(frame(spark, rows), 2, most_terms=50).filter("part = 'term' and source = 'a'").orderBy("rank").collect()
    assert [r["item"] for r in got] == sorted(["z", "é", *[chr(0x4E00 + i) for i in range(80)]], key=str.encode)[:50]


def test_vocabulary_and_sums_are_those_of_a_count_vectorizer(spark):
    """Per language: a term in as many documents, without a limit on their number, and exact sums per source."""
    docs = frame(spark, texts())
    vectors = divergence.group_vectors(docs)
    mine = {(r["lang"], r["term"]): r["total"] for r in divergence.vocabulary(vectors, 12).collect()}
    sums = {(r["lang"], r["source"], r["term"]): r["count"] for r in vectors.filter("term is not null").collect()}
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.regexp_extract_all(lower, F.lit(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)).alias("tokens"),
    ).cache()
    seen = set()
    for lang in ("en", "fr", ""):
        model = CountVectorizer(inputCol="tokens", outputCol="vector", minDF=12.0, vocabSize=2**31 - 1).fit(tokens.filter(F.col("lang") == lang))
        totals = defaultdict(Counter)
        for r in model.transform(tokens.filter(F.col("lang") == lang)).collect():
            for at, n in zip(r["vector"].indices, r["vector"].values):
                totals[r["source"]][model.vocabulary[at]] += int(n)
        assert {t for l, t in mine if l == lang} == set(model.vocabulary)
        for source, counts in totals.items():
            for term, n in counts.items():
                assert sums[lang, source, term] == n
                seen.add((lang, source, term))
    assert seen == {(l, s, t) for l, s, t in sums if (l, t) in mine and l in ("en", "fr", "")}


def test_no_documents_and_long_texts(spark):
    assert divergence.divergence(frame(spark, []).filter("false")).count() == 0
    long = ("word " * 400_000 + "x" * 900_000, "en", "a")
    got = divergence.divergence(frame(spark, [long, ("word other", "en", "b")]), 1).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(tuple(r) for r in got.collect()) == plain([long, ("word other", "en", "b")], 1)


def test_query_matches_sql(spark, duck):
    ok, note = compare(spark, duck, "op11", divergence.op11, divergence.ORACLE, "/root/testdata/sf0.001")
    assert ok, note
