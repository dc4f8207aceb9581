"""Vector codes, held against a plain Lloyd that compares every part with every entry."""

import hashlib

import numpy as np
import pytest

from quillspark.llm import lloyd


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Codes, errors and codebooks by complete scans in Python's own whole numbers."""
    import math

    kept = [(i, [math.floor(scale * float(x)) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))[:entries]
    width = len(first[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    nearest = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        fresh = []
        for p in range(parts):
            held = {}
            for _, v, _ in kept:
                held.setdefault(nearest(p, cut(v, p))[1], []).append(cut(v, p))
            fresh.append([[sum(c) // len(held[j]) for c in zip(*held[j])] if j in held else e for j, e in enumerate(books[p])])
        books = fresh
    out = []
    for i, v, label in kept:
        found = [nearest(p, cut(v, p)) for p in range(parts)]
        out.append((i, label, tuple(j for _, j in found), sum(d for d, _ in found)))
    return out, books


def shown(coded, parts=4):
    return [(r["vec_id"], r["label"], tuple(r[f"c{p}"] for p in range(parts)), sum(r[f"d{p}"] for p in range(parts))) for r in coded.collect()]


def key(row):
    return tuple((x is None, x) for x in row)


def test_codes_match_complete_scans(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).round(2)], int(i % 3) if i % 7 else None) for i in rng.permutation(300)]
    rows += [(400 + i, rows[i][1], 1) for i in range(40)]  # equal vectors: equal codes, ties to the lower index
    rows += [(5, [0.25] * 8, 2), (5, [-0.25] * 8, 2), (None, [0.1] * 8, None)]
    rows += [(900, None, 1), (901, [None] * 8, 1), (902, [float("nan")] * 8, 1), (903, [float("-inf")] + [0.0] * 7, 1)]
    data = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, part int").repartition(5)
    coded, books, dims = lloyd.quantise(data, entries=16)
    want, want_books = plain(rows, entries=16)
    assert dims == 8 and books.tolist() == want_books
    assert sorted(shown(coded), key=key) == sorted(want, key=key)
    assert lloyd.codebooks_text(books, dims) == ",".join(str(c) for part in want_books for e in part for c in e)


def test_only_moved_entries_are_compared():
    rng = np.random.default_rng(3)
    x, entries = rng.integers(-50, 50, (500, 4)), rng.integers(-50, 50, (32, 4))
    none = np.full(500, -1), np.full(500, -1)
    code, dist, compared = lloyd.reassign(x, *none, entries, np.ones(32, dtype=bool))
    assert compared == 500 * 32
    moved = np.zeros(32, dtype=bool)
    moved[[3, 20]] = True
    after = entries.copy()
    after[moved] += 9
    got = lloyd.reassign(x, code, dist, after, moved)
    stay = int((~moved[code]).sum())
    assert got[2] == stay * 2 + (500 - stay) * 32 < compared / 4
    whole = ((x[:, None, :] - after[None]) ** 2).sum(axis=2)
    assert (got[0] == whole.argmin(axis=1)).all() and (got[1] == whole.min(axis=1)).all()


def test_a_moved_entry_takes_ties_only_from_higher_indices():
    x, old = np.array([[0], [0]]), np.array([[9], [2], [-2], [9]])
    after = np.array([[2], [2], [-2], [-2]])
    moved = np.array([True, False, False, True])
    code, dist, _ = lloyd.reassign(x, np.array([1, 2]), np.array([4, 4]), after, moved)
    assert code.tolist() == [0, 0] and dist.tolist() == [4, 4] and len(old) == 4
    code, _, _ = lloyd.reassign(x, np.array([1, 2]), np.array([4, 4]), np.array([[9], [2], [-2], [2]]), moved)
    assert code.tolist() == [1, 2]


def test_large_components_stay_exact_and_too_large_ones_are_named(spark):
    far = float(2**15)  # 2^25 after scaling: sums of squares are no longer exact as doubles
    rows = [(i, [far + i, -far, 0.5, float(i)] * 2, 0) for i in range(30)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want, _ = plain(rows, entries=4)
    assert sorted(shown(lloyd.quantise(data, entries=4)[0])) == sorted(want)
    for where in (0, 29):  # in the first codebook, and met by a task
        odd = spark.createDataFrame([*rows[:where], (where, [1e30] * 8, 0), *rows[where + 1 :]], data.schema)
        with pytest.raises(Exception, match="would not fit a long"):
            lloyd.quantise(odd, entries=4)[0].collect()


def test_little_or_odd_data(spark):
    shape = "vec_id long, embedding array<float>, label string"
    for rows in ([], [(1, None, "a")], [(None, [0.5] * 4, "a")]):
        coded, books, _ = lloyd.quantise(spark.createDataFrame(rows, shape))
        assert coded.count() == len([r for r in rows if r[1] is not None]) and books.size == 0
        assert all(r["c0"] is None for r in coded.collect())
    # fewer rows than entries, a length that four does not divide, a vector of another length, an empty one
    rows = [(1, [0.5] * 6, "a"), (2, [0.25] * 6, None), (3, [0.1] * 5, "b"), (4, [], "b")]
    coded, books, dims = lloyd.quantise(spark.createDataFrame(rows, shape))
    got = {r["vec_id"]: r for r in coded.collect()}
    assert dims == 6 and books.shape == (4, 2, 2) and [got[1][f"c{p}"] for p in range(4)] == [0, 0, 0, 0]
    assert [got[2][f"c{p}"] for p in range(4)] == [1, 1, 1, 0] and got[3]["c0"] is None and got[4]["d3"] is None
    assert lloyd.codebooks_text(books, dims) == "512,512,256,256,512,512,256,256,512,512,256,256"


def test_query_digests(spark, tmp_path):
    rows = [(i, [((i * 37 + j * 11) % 19) / 19 - 0.4 for j in range(8)], i % 4 or None) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = lloyd.op13(spark, str(tmp_path)).collect()
    want, books = plain(rows)
    errors = {}
    for _, label, _, error in want:
        errors[label] = errors.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(c) for part in books for e in part for c in e).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in got} == {digest}
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == sorted(
        (i, "".join(f"{c:02x}" for c in code), error, errors[label]) for i, label, code, error in want
    )
