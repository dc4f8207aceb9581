"""The n-gram join where rows repeat an id, and under Arrow batches of any size."""

import re

import pytest

from quillspark.llm import jaccard
from quillspark.llm.common import BATCH_ROWS


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {" ".join(words)} - {""}


def plain(rows):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, set()).update(shingles(text))
    label = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            changed |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return sorted(((i, len(sets[i]) if i is not None else len(shingles(t)), label.get(i)) for i, t in rows), key=str)


def text(seed, length, changes=()):
    words = [f"w{(seed * 7919 + k * k * 31 + k) % 997}" for k in range(length)]
    for c in changes:
        words[c % length] = f"x{c}"
    return " ".join(words)


def rows():
    out = [(1, text(1, 60)), (1, text(2, 90)), (2, text(1, 60, [30])), (3, text(2, 90, [40])), (4, text(1, 60) + " " + text(2, 90))]
    out += [(10 + i, text(5, 200, range(i % 4))) for i in range(30)]  # sizes within a group differ
    out += [(60 + i, text(5, 200 + i, [])) for i in range(20)]
    out += [(100 + i, text(50 + i, 40 + i) + " " + text(9, 50)) for i in range(30)]  # one passage in many
    out += [(200, text(7, 30)), (200, text(7, 30)), (201, text(7, 30)), (202, None), (202, ""), (None, text(7, 30)), (203, "a b"), (204, "A  b")]
    return out


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in jaccard.similarity_components(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("batch", [7, 5000])
def test_repeated_ids_are_one_document(spark, batch):
    before = spark.conf.get(BATCH_ROWS)
    try:
        spark.conf.set(BATCH_ROWS, batch)
        assert found(spark, rows()) == plain(rows())
    finally:
        spark.conf.set(BATCH_ROWS, before)


def test_bound_of_mixed_groups_never_exceeds_the_exact_one(spark):
    """For all sizes in two ranges the bound of the ranges is at most that of the pair."""
    pairs = [(a, a + w, b, b + v) for a in range(1, 60, 7) for w in (0, 1, 5, 20) for b in range(1, 80, 9) for v in (0, 2, 11)]
    df = spark.createDataFrame([(*p, s, t) for p in pairs for s in (p[0], (p[0] + p[1]) // 2, p[1]) for t in (p[2], p[3]) if 100 * min(s, t) >= 75 * max(s, t)],
                               "al long, am long, bl long, bm long, s long, t long")
    assert df.filter(f"{jaccard._least_shared(75)} > {jaccard._shared_prefix(75, 's', 't')}").count() == 0


def test_components_of_stars_take_no_round_and_chains_settle(spark):
    from quillspark.llm.components import components
    from quillspark.llm.scratch import Scratch

    def labels(edges):
        with Scratch(spark) as scratch:
            got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
            return got, scratch.count

    assert labels([(2, 1), (1, 3), (5, 9), (1, 3), (4, 4)]) == ({1: 1, 2: 1, 3: 1, 5: 5, 9: 5}, 1)
    chain = [(i * 7 % 31, (i + 1) * 7 % 31) for i in range(30)]
    assert labels(chain + [(40, 41)])[0] == {**{i: 0 for i in range(31)}, 40: 40, 41: 40}
    assert labels([]) == ({}, 1)


def test_shortened_sets_never_rule_out_a_link(monkeypatch):
    """Random sets around the bound, of 16 and of 32 bits and mixed: what the whole sets let through, the shortened ones do."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "BRIEF_TOKENS", 60)
    draw, linked, out = np.random.default_rng(5), 0, 0
    for _ in range(600):
        n = int(draw.integers(1, 90))
        x = draw.integers(0, 1 << 64, n, dtype=np.uint64)
        y = np.concatenate([x[: n - int(draw.integers(0, n // 3 + 1))], draw.integers(0, 1 << 64, int(draw.integers(0, n // 4 + 2)), dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        cell = lambda pack: (pa.scalar([pack(s)], pa.list_(pa.binary())) for s in (x, y))
        truth = 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))
        assert jaccard._reach(*cell(np.ndarray.tobytes), 75) == truth
        brief = jaccard._brief_reach(*cell(jaccard.shortened), 75)
        assert brief or not truth
        linked, out = linked + truth, out + (not brief)
    assert linked > 100 and out > 100
    empty = pa.scalar([jaccard.shortened(np.zeros(0, np.uint64))], pa.list_(pa.binary()))
    assert not jaccard._brief_reach(empty, empty, 75)


def test_sets_are_shipped_whole_only_for_pairs_that_may_link(spark, monkeypatch):
    """Half-equal documents meet in prefixes; only their shortened sets go to another task."""
    whole = []
    reaching = jaccard._reaching
    monkeypatch.setattr(jaccard, "_reaching", lambda pairs, *a, brief: (whole.append((brief, pairs.count())), reaching(pairs, *a, brief=brief))[1])
    data = [(i, text(11, 60) + " " + text(20 + i, 40)) for i in range(12)] + [(50, text(4, 80)), (51, text(4, 80, [79]))]
    assert found(spark, data) == plain(data)
    assert sum(n for brief, n in whole if brief) >= 10 and sum(n for brief, n in whole if not brief) <= 3
