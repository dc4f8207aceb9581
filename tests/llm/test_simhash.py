"""SimHash components, held against all pairs of plainly computed fingerprints."""

import re

import numpy as np
import pytest
import xxhash

from quillspark.llm import simhash

SHAPE = "doc_id long, text string, fp string, rep int"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(links, names):
    label = {n: n for n in names}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            for n in (a, b):
                if label[n] != least:
                    label[n], changed = least, True
    return label


def plain_components(rows, most=2):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    known = [(i, f) for i, f in prints if i is not None]
    links = [(i, j) for n, (i, f) in enumerate(known) for j, g in known[:n] if (f ^ g).bit_count() <= most]
    label = reached(links, [i for i, _ in known])
    return sorted((((i, f"{f:016x}", label.get(i)) for i, f in prints)), key=str)


def found(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SHAPE).repartition(parts)
    out = simhash.near_duplicates(docs).collect()
    return sorted(((r["doc_id"], f"{r['fp'] & simhash.WHOLE:016x}", r["component_id"]) for r in out), key=str)


def test_components_match_all_pairs(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"Wort{i}" if i % 3 else f"é{i}🙂" for i in range(400)]
    rows = []
    for family in range(12):
        base = list(rng.choice(vocabulary, 400))
        for copy in range(10):
            text = list(base)
            for at in rng.integers(0, 400, copy % 4):
                text[at] = str(rng.choice(vocabulary))
            rows.append((1000 - family * 20 - copy, " ".join(text)))
    rows += [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "ONE"), (10, "two words"), (11, "a b c"), (12, "A  b\tC"), (13, "x y z")]
    rows += [(14, rows[0][1]), (14, rows[15][1]), (None, rows[0][1]), (None, None), (1000, rows[0][1])]
    want = plain_components(rows)
    assert len({c for _, _, c in want}) < len(rows) - 40  # links of both kinds
    assert found(spark, rows) == want


def as_text(spark, prints, monkeypatch):
    """Near duplicates of given fingerprints: a text is its fingerprint in decimal."""
    monkeypatch.setattr(simhash, "_fingerprints", lambda width: _given)
    docs = spark.createDataFrame([(i, str(p), "x", 1) for i, p in enumerate(prints)], SHAPE).repartition(4)
    return {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}


def _given(batches):
    import pyarrow as pa

    for batch in batches:
        values = np.array([int(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])


@pytest.mark.parametrize("crowd", [4096, 40, 3])
def test_crowded_blocks_lose_no_link(spark, monkeypatch, crowd):
    rng = np.random.default_rng(11)
    centre = int(rng.integers(0, 1 << 63))
    prints = {0, centre}
    for _ in range(700):  # one dense family, with equal quarters everywhere, and chains
        bits = rng.integers(0, 64, int(rng.integers(1, 9)))
        prints.add(centre ^ int(np.bitwise_or.reduce(np.left_shift(np.uint64(1), bits.astype(np.uint64)))))
    prints |= {int(x) for x in rng.integers(0, 1 << 63, 200)} | {simhash.WHOLE, simhash.WHOLE ^ 3, 1 << 63}
    prints = list(prints)
    rng.shuffle(prints)
    links = [(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints[:i]) if (a ^ b).bit_count() <= 2]
    monkeypatch.setattr(simhash, "CROWD", crowd)
    assert as_text(spark, prints, monkeypatch) == reached(links, range(len(prints)))


def test_keys_leave_no_pair_out():
    rng = np.random.default_rng(2)
    for fixed in (0, 0xFFFF0000FFFF0000, 0xFFFFFFFFFFFFF00F):
        masks = simhash.key_masks(fixed, 2)
        assert len(masks) == (6 if fixed == 0 else 3)
        free = [b for b in range(64) if not fixed >> b & 1]
        for _ in range(300):
            one = int(rng.integers(0, 1 << 62))
            two = one ^ (1 << int(rng.choice(free))) ^ (1 << int(rng.choice(free)))
            assert any(one & m == two & m for m in masks)


def test_table_discards_pairs_and_no_link():
    rng = np.random.default_rng(9)
    values = rng.integers(0, 1 << 62, 400).astype(np.int64)
    values[200:] = values[:200] ^ (1 << rng.integers(0, 62, 200)) ^ (1 << rng.integers(0, 62, 200))
    near = simhash.pivot_distances(values, rng.integers(0, 1 << 62, 32).astype(np.int64))
    order = np.argsort(near[:, 0], kind="stable")
    values, near = values[order], near[order]
    a, b, (met, survived) = simhash.block_pairs(np.zeros(400, np.int64), near, values, 2)
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if int(values[i] ^ values[j]).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want and len(want) >= 200
    assert met < 400 * 399 / 2 and survived < len(want) + met / 1000


def test_long_texts_and_empty_table(spark):
    long = "lorem ipsum dolor " * 120_000 + "y" * 900_000
    rows = [(1, long), (2, "z" * 2_000_000), (3, long.upper()), (4, "")]
    assert found(spark, rows) == plain_components(rows)
    assert found(spark, []) == []


def test_small_batches_carry_blocks_over(spark):
    rows = [(i, f"same text but for {i % 3} at its end " * 30 + "tail " * (i % 40)) for i in range(200)]
    want = plain_components(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        assert found(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_query_columns(spark):
    got = simhash.op12(spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == plain_components([tuple(r) for r in rows])
