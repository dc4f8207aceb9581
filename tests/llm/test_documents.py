"""Operators on small hand-made tables, held against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import decontaminate, jaccard, langmix, mixing, packing, pii, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token long, n string"


def docs_of(spark, texts, langs=None, ids=None):
    """Documents with extra columns whose names clash with names the operators use inside."""
    rows = [
        (i if ids is None else ids[i], t, None if langs is None else langs[i], "s", None if t is None else len(t), 7, "x")
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


ODD = [None, "", "   \t\n", "a", "é", "one two", "🙂 🙂", "word " * 5000, "x" * 20000, "same text here", "same text here", " ", "1 2 3"]


def shingles(text, width=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if len(words) >= width else {tuple(words)}


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return [len(s) for s in sets], label


def family(seed, copies, words=60, vocabulary=400):
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(vocabulary)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        text = list(base)
        for place in rng.integers(0, words, size=rng.integers(0, 3)):
            text[place] = f"v{rng.integers(9999)}"
        cut = rng.integers(0, 12)
        out.append(" ".join(text[cut:] if rng.random() < 0.5 else text[: words - cut]))
    return out


def test_jaccard_components_match_brute_force(spark):
    texts = [t for seed in range(5) for t in family(seed, 8)] + ODD + family(9, 40, words=20)
    sizes, labels = brute_components(texts)
    got = by_id(jaccard.similarity_components(docs_of(spark, texts)))
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == labels


def test_jaccard_of_empty_table_and_null_ids(spark):
    assert jaccard.similarity_components(docs_of(spark, ["a"]).filter("false")).count() == 0
    got = jaccard.similarity_components(docs_of(spark, ["a b c d e f"] * 3, ids=[None, 4, 2])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [
        (False, 2, 2), (False, 4, 2), (True, 0, 0)
    ]


@pytest.mark.parametrize("common,linked", [(9, True), (8, False)])
def test_jaccard_at_the_bound(spark, common, linked):
    """9 of 12 shingles is 0.75; 8 of 12 is less."""
    shared = [f"s{i}" for i in range(common + 4)]
    left, right = 12 - common - (12 - common) // 2, (12 - common) // 2
    texts = [" ".join([*(f"l{i}" for i in range(left)), *shared]), " ".join([*shared, *(f"r{i}" for i in range(right))])]
    got = by_id(jaccard.similarity_components(docs_of(spark, texts)))
    assert (got[1]["component_id"] == 0) is linked


def test_decontamination_tolerates_substitutions(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), size=6))
    items = [" ".join(word() for _ in range(30)) for _ in range(4)] + ["too short to count", None]
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    words = items[0].split()
    substituted = list(words)
    for place in (5, 13, 22):
        substituted[place] = "other"
    filler = lambda n: " ".join(word() for _ in range(n))
    texts = [
        f"{filler(40)} {items[0]} {filler(10)}", f"{filler(4)} {' '.join(substituted)}", filler(90), " ".join(words[:8]),
        f"{items[1].upper()}!", f"{filler(3)} {' '.join(words[3:20])} {filler(3)}", *ODD,
    ]
    found = decontaminate.overlaps(docs_of(spark, texts), tests)
    got = {(r["doc_id"], r["item_id"]): r for r in found.collect()}
    assert set(got) == {(0, 0), (1, 0), (4, 1), (5, 0)}
    assert got[0, 0]["n_matched"] == 30 and got[0, 0]["doc_start"] == 40
    assert got[1, 0]["n_matched"] == 27 and got[1, 0]["n_words"] == 30
    assert got[5, 0]["n_matched"] == 17 and got[5, 0]["item_start"] == 3
    kept = decontaminate.keep_uncontaminated(docs_of(spark, texts), tests)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {0, 1, 4, 5}
    assert decontaminate.overlaps(docs_of(spark, texts), tests.filter("false")).count() == 0
    assert decontaminate.overlaps(docs_of(spark, texts).filter("false"), tests).count() == 0
    blocks = decontaminate.overlaps(docs_of(spark, texts), tests, block_words=40)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, found.collect()))


def test_decontamination_runs_no_python(spark):
    tests = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    plan = decontaminate.overlaps(docs_of(spark, ["x"]), tests)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_chunk_dedup_finds_shifted_passages(spark):
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), size=rng.integers(2, 9))) for _ in range(n))
    passage = prose(80)
    texts = [f"{prose(70)} {passage} {prose(40)}", f"é {prose(33)} {passage}", prose(200), passage, *ODD]
    rows = substrings.repeated_spans(docs_of(spark, texts)).collect()
    held = {r["doc_id"] for r in rows}
    assert {0, 1, 3} <= held and 2 not in held
    for r in rows:
        if r["doc_id"] in (0, 1):
            span = texts[r["doc_id"]][r["start"] : r["start"] + r["n_chars"]]
            assert span in passage and len(span) > 0.6 * len(passage) and len(span.encode()) == r["n_bytes"]
            assert r["first_doc"] == 0 and (r["n_first"] == r["n_chunks"]) == (r["doc_id"] == 0)
    assert substrings.repeated_spans(docs_of(spark, texts).filter("false")).count() == 0
    assert substrings.repeated_spans(docs_of(spark, [None, ""])).count() == 0


def test_chunk_dedup_finds_whole_short_passages(spark):
    """Passages of 51 words at many offsets, each in two documents, come out whole in both."""
    rng = np.random.default_rng(11)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopé"), size=rng.integers(2, 9))) for _ in range(n))
    passages = [prose(51) for _ in range(150)]
    texts = [f"{prose(rng.integers(1, 90))} {p} {prose(rng.integers(1, 60))}" for p in passages for _ in range(2)]
    rows = substrings.repeated_spans(docs_of(spark, texts)).collect()
    found = 0
    for r in rows:
        passage = passages[r["doc_id"] // 2]
        span = texts[r["doc_id"]][r["start"] : r["start"] + r["n_chars"]]
        assert len(span.encode()) == r["n_bytes"]
        found += passage in span and len(span) < len(passage) + 12
    assert found >= 298
    long = prose(900)
    both = [f"{prose(9)} {long}", f"{long} {prose(9)}"]
    assert substrings.agreeing(b"abc", b"abd") == 2 and substrings.agreeing(b"", b"x") == 0
    assert all(long in both[r["doc_id"]][r["start"] : r["start"] + r["n_chars"]] for r in substrings.repeated_spans(docs_of(spark, both)).collect())
    assert substrings.extension(("é".encode(), "aé".encode()), ("xé".encode(), "aè".encode()))[2:] == ("é".encode(), b"a")


def test_chunks_cover_texts_and_keep_bounds():
    from quillspark.llm.chunking import GEAR, chunk_ends, gear_hashes

    raw = ("héé wörld " * 500 + "x" * 3000).encode()
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, 0, 700, len(raw)])
    offsets[2] += next(k for k in range(4) if (raw[offsets[2] + k] & 0xC0) != 0x80)
    ends = chunk_ends(data, offsets, 5, 24, 192)
    assert {int(offsets[2]), len(raw)} <= set(ends.tolist())
    assert max(np.diff(np.concatenate([[0], ends]))) <= 192 + 3
    h = 0
    for i, byte in enumerate(raw[:300]):
        h = ((h << 1) + int(GEAR[byte])) & 0xFFFFFFFF
        assert int(gear_hashes(data)[i]) == h


def slow_base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [
        ("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        if all(int(p) <= 255 for p in m.group().split("."))
    ]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [
        ("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15
    ]
    return out


PRIVATE = [
    "mail a.b+c@x-y.co.uk, or a@b and c@d.e@f.gh", "ip 1.2.3.4 5.6.7.8.9 256.1.1.1 001.02.3.255 1.2.3.4.5.6.7.8",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "call +1 (555) 010-9999 or +44 20 7946 0958.", "é é a@b.cc 🙂 9.9.9.9",
    "@@a@b.c@d.e.f +12 + 1 +123456789012345678", "0" * 500 + ".1.2.3 " + "1-" * 300, "a" * 30000 + "@" + "b" * 100,
]


def test_pii_base_spans_match_plain_patterns(spark):
    rng = np.random.default_rng(1)
    texts = [*PRIVATE, *ODD, *("".join(rng.choice(list("12.@+- a9()"), size=120)) for _ in range(300))]
    got = by_id(pii.find(docs_of(spark, texts), {}))
    import hashlib

    for i, text in enumerate(texts):
        want = slow_base(text or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS], text
        assert got[i]["base_sha256"] == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert set(pii.joined(want).split(",")) <= set(got[i]["spans"].split(","))


def test_pii_field_labels_repeats_alike(spark):
    text = "send to 4111 1111 1111 1111 today. later 4111-1111-1111-1111x; card 4111.1111.1111.1111 again, code 12345 stays"
    got = by_id(pii.find(docs_of(spark, [text, "no data", "10.0.0.1 and 10-0-0-1"]), {"0.0.0.0": 2.0}))
    assert got[0]["n_card"] == 2 and got[0]["n_added"] == 1
    added = [s for s in got[0]["spans"].split(",") if s.startswith("card")]
    assert [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in added] == [
        "4111 1111 1111 1111", "4111-1111-1111-1111", "4111.1111.1111.1111"
    ]
    assert got[1]["spans"] == "" and "ip:13:21" in got[2]["spans"]


def test_pii_messages_agree_with_enumeration():
    unary, edges = np.array([1.2, -0.7, -0.4]), [(0, 1, 0.8), (1, 2, 1.1)]
    weight = {}
    for labels in np.ndindex(2, 2, 2):
        value = sum(u * l for u, l in zip(unary, labels)) + sum(s for a, b, s in edges if labels[a] == labels[b])
        weight[labels] = math.exp(value)
    got = pii.infer(unary, edges, np.zeros(3))
    for i in range(3):
        on = sum(w for l, w in weight.items() if l[i])
        assert got[i] == pytest.approx(math.log(on / (sum(weight.values()) - on)), abs=0.05)  # exact on a tree


def test_pii_redaction_keeps_columns(spark):
    texts = ["write a@b.cc now", None, "", "call +1 555 010 9999"]
    source = docs_of(spark, texts)
    got = pii.redact(source, {})
    assert got.columns == source.columns
    rows = by_id(got)
    assert [rows[i]["text"] for i in range(4)] == ["write [EMAIL] now", None, "", "call [PHONE]"]
    assert rows[0]["n_chars"] == len("write [EMAIL] now") and rows[1]["n_chars"] is None


def test_packing_places_every_token_once(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain = Tokenizer.from_file(path)
    texts = [
        *ODD, *PRIVATE, "It's DON'T, they'll!! ÉCOLE école İstanbul ΣΑΣ naïve é \x1c\x1d a\x85b", "<|endoftext|> <|ENDOFTEXT|>x",
        *(" ".join(f"tok{i * j % 977}" for j in range(i * 7)) for i in range(60)),
    ]
    rows = packing.pack(docs_of(spark, texts), path, capacity=512, block_tokens=20000).collect()
    want = {i: plain.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    windows = {}
    for i, ids in want.items():
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        at = 0
        for r in mine:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
            windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert at == len(ids)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(map(len, want.values()))
    assert len(windows) <= 1.15 * total / 512 + 4
    assert packing.pack(docs_of(spark, texts).filter("false"), path).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 300, size=800)
    chosen = packing.difference(sizes, 40)
    loads = np.bincount(chosen, weights=sizes, minlength=40)
    assert loads.sum() == sizes.sum() and loads.max() - loads.min() <= 5
    # the textbook example: 8 7 6 5 4 in two parts leaves a difference of 2
    two = np.bincount(packing.difference(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])
    assert abs(two[0] - two[1]) == 2
    chosen, windows = packing.near_equal_windows(np.array([60, 60, 60]), 100)
    assert windows == 3 and sorted(chosen) == [0, 1, 2]


def test_mixing_base_scores_match_plain_counts(spark):
    texts = ["the cat sat on the mat", "the dog", None, "", "The zebra zzz", "a b c a b a", "é É é", *ODD[7:], *("the cat " * n for n in range(5))]
    docs = docs_of(spark, texts)
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w] + [None]
    counts = Counter(w for i in train for w in tokens(texts[i]))
    n, v = sum(counts.values()), len(counts)
    from pyspark.sql import functions as F

    out = mixing.scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    got = by_id(out)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        mine = tokens(text)
        assert got[i]["n_tokens"] == len(mine) and got[i]["train_tokens"] == n
        assert got[i]["n_known"] == sum(w in counts for w in mine)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in mine), abs=1e-6)
        assert got[i]["score"] < 0
    assert mixing.scores(docs.filter("false"), F.lit(True)).count() == 0
    untrained = by_id(mixing.scores(docs, F.lit(False)))
    assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in untrained.values())


def test_mixing_probabilities_sum_to_one():
    model = mixing.Model(
        np.random.default_rng(0).integers(0, 9, mixing.SLOTS).astype(np.float32),
        np.random.default_rng(1).integers(0, 9, mixing.SLOTS).astype(np.float32),
        np.full((mixing.GATES, mixing.ORDERS + 1), 0.4), np.zeros((mixing.GATES, mixing.CELLS)),
    )
    context = np.uint64(0x616263646500)
    p = 2.0 ** mixing.log2_byte(model, context | np.arange(256, dtype=np.uint64))
    assert p.sum() == pytest.approx(1.0, abs=1e-4)
    names, memo = np.zeros(mixing.MEMO, np.uint64), np.zeros(mixing.MEMO)
    names[0] = 1
    key = context | np.arange(256, dtype=np.uint64)
    for _ in range(2):
        assert np.allclose(2.0 ** mixing._remembered(model, key, names, memo), p)


def test_mixing_learns_what_repeats(spark):
    from pyspark.sql import functions as F

    texts = ["abcabcabcabcabc " * 20] * 10 + ["qzkvxjwpqzkvxjwp" * 20]
    got = by_id(mixing.scores(docs_of(spark, texts), F.col("doc_id") < 9))
    assert got[9]["bits_per_byte"] < 1.0 < got[10]["bits_per_byte"]


@pytest.mark.parametrize("kept", [0, mixing.KEPT])
def test_mixing_counts_are_exact(spark, monkeypatch, kept):
    """Orders 1 to 5 see what plain counting sees, however many contexts there are, held by tasks or joined."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcé"), size=rng.integers(0, 60))) for _ in range(60)]
    raw = [b"\0" * mixing.ORDERS + t.encode() + b"\0" for t in texts]
    keys = [[int.from_bytes(r[i - mixing.ORDERS : i + 1], "big") for i in range(mixing.ORDERS, len(r))] for r in raw]
    counts = Counter(k for i in range(40) for k in keys[i])
    every = sorted({k for ks in keys for k in ks})
    counted = spark.createDataFrame([(k, counts[k], 1) for k in every], "key long, n long, uses long")
    checked = 0
    for r in mixing.families(counted).collect():
        family = np.zeros(len(r["key"]), np.int64)
        after, after_n = np.array(r["after"] or [], np.int64), np.array(r["after_n"] or [], np.int64)
        got = mixing.deeper_counts(np.array(r["key"], np.uint64), np.array(r["n"]), family, after, after_n, np.zeros(len(after), np.int64))
        for at, key in enumerate(r["key"]):
            for order in range(2, mixing.ORDERS + 1):
                for bit in range(8):
                    same = lambda k, left: (k & ((1 << (8 * order + 8)) - 1)) >> left
                    like = [k for k in counts if same(k, 8 - bit) == same(key, 8 - bit)]
                    ones = sum(counts[k] for k in like if k >> (7 - bit) & 1)
                    assert got[order - 2, bit, :, at].tolist() == [sum(counts[k] for k in like) - ones, ones]
            checked += 1
        if checked > 40:
            break
    monkeypatch.setattr(mixing, "KEPT", kept or 1)
    out = by_id(mixing.scores(docs_of(spark, texts).repartition(1), F.col("doc_id") < 40))
    assert len(out) == 60 and all(r["score"] < 0 for r in out.values())
    monkeypatch.undo()
    whole = by_id(mixing.scores(docs_of(spark, texts).repartition(1), F.col("doc_id") < 40))
    assert all(out[i]["score"] == pytest.approx(whole[i]["score"], rel=0.02) for i in out)


def test_languages_are_told_apart(spark):
    words = {"xx": "tion ing the ea st".split(), "yy": "ung keit schen lich ä".split(), "zz": "oux eau êle tre ç".split()}
    rng = np.random.default_rng(2)
    texts, langs = [], []
    for i in range(240):
        lang = ["xx", "yy", "zz"][i % 3]
        texts.append(" ".join("".join(rng.choice(words[lang], size=2)) for _ in range(rng.integers(3, 60))))
        langs.append(lang)
    texts += [None, "", "123 !!", " "] + ["tioning theing east eating " * 40 + "ungkeit schenlich " * 20]
    langs += [None] * 5
    docs = docs_of(spark, texts, langs)
    names, likely = langmix.learn(docs)
    assert names == ["xx", "yy", "zz"]
    got = by_id(langmix.predict(docs, names, likely))
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in held]) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in range(240, 244))
    assert got[244]["lang_pred"] == "xx" and got[244]["n_langs"] == 2 and 0.5 < got[244]["score"] < 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = langmix.learn(docs.filter("false"))
    assert {r["lang_pred"] for r in langmix.predict(docs, *empty).collect()} == {"und"}


def test_trigrams_stay_inside_rows():
    one = lambda t: sorted(langmix.trigrams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tolist())
    data = np.frombuffer(b"abc" + b"" + b"de" + b"x", np.uint8)
    bucket, row = langmix.trigrams(data, np.array([0, 3, 3, 5, 6]))
    for number, text in enumerate([b"abc", b"", b"de", b"x"]):
        assert sorted(bucket[row == number].tolist()) == one(text)
    assert len(one(b"x")) == 1 and one(b"") == []


def test_toxicity_folding_and_exceptions(spark):
    lexicon = toxicity.Lexicon({"idiot": 5.0, "trash": 5.0, "zlow*": 6.0}, slope=1.0, offset=-2.0, power=0.25)
    texts = [
        "you IDIOT", "you 1d10t", "you іdіоt!", "an idiots tale", "put it in the trash can", "trash. can you", "a zlowish thing",
        "unzlowish", None, "", "idi​ot", "plain words " * 50,
    ]
    got = by_id(toxicity.score(docs_of(spark, texts), lexicon))
    assert [got[i]["predicted"] for i in range(len(texts))] == [1, 1, 1, 0, 0, 1, 1, 0, 0, 0, 1, 0]
    short, long_text = lexicon.score("idiot"), lexicon.score("idiot " + "fine words here " * 900)
    assert short > long_text  # length counts
    kept = toxicity.keep_clean(docs_of(spark, texts), lexicon)
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 7, 8, 9, 11} and kept.columns == docs_of(spark, texts).columns


def test_toxicity_is_learned_from_labels(spark):
    rng = np.random.default_rng(8)
    plain = lambda: " ".join("".join(rng.choice(list("aeioulmnrst"), size=5)) for _ in range(40))
    texts, marks = [], []
    for i in range(600):
        bad = i % 7 == 0
        texts.append(f"{plain()} {'grobkl' + 'xyz'[i % 3] + 'en' if bad else ''} {plain()}")
        marks.append(int(bad))
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, m, 1) for i, m in enumerate(marks)] + [(None, 1, 1), (5, None, 0)], "doc_id long, toxic int, quality int")
    lexicon = toxicity.learn(docs, labels)
    got = by_id(toxicity.score(docs, lexicon))
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["predicted"] == marks[i] for i in held)
    bare = toxicity.learn(docs, labels.filter("false"))
    assert set(bare.terms) == set(toxicity.SEED_TERMS) and bare.score("you idiot idiot") > 0.5 > bare.score("")
