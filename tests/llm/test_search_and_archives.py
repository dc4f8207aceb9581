"""Vector search and archives, held against plain Python."""

import hashlib
import math
import struct

import numpy as np
import pytest
import zstandard

from quillspark.llm import maxscore, warc


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=16) * 0.3], "x") for i in range(400)]
    rows += [(400 + i, rows[i % 3][1], "x") for i in range(30)]  # ties
    rows += [(500, None, "x"), (501, [None] * 16, "x"), (502, [float("nan")] * 16, "x"), (503, [float("inf")] * 16, "x"), (504, [], "x"), (505, [0.5] * 3, "x"), (None, [0.5] * 16, "x")]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").repartition(5)
    got = maxscore.top_k(data, data.filter("vec_id % 50 = 0"), 5).collect()
    usable = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows if i is not None and i < 500}
    for q in range(0, 500, 50):
        if q in usable:
            want = sorted(((-int(usable[q] @ v), i) for i, v in usable.items() if i != q))[:5]
            mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
            assert [(-r["score"], r["vec_id"]) for r in mine] == want and [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
    assert {r["query_id"] for r in got} == {q for q in range(0, 450, 50) if q in usable}


def test_top_k_in_blocks_and_on_little_data(spark, monkeypatch):
    rows = [(i, [float((i * 7 + j) % 11) / 11 - 0.4 for j in range(8)]) for i in range(120)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, maxscore.top_k(data, data.filter("vec_id % 5 = 0"), 3).collect()))
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, maxscore.top_k(data, data.filter("vec_id % 5 = 0"), 3).collect())) == whole
    few = data.filter("vec_id < 3")
    assert maxscore.top_k(few, few.filter("vec_id = 0"), 5).count() == 2
    assert maxscore.top_k(few.filter("false"), few.filter("false"), 5).count() == 0


def test_top_k_of_large_components_is_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=6) * 10.0 ** (i % 7)]) for i in range(200)]
    rows += [(200 + i, [-1e30 if j == i else 0.0 for j in range(6)]) for i in range(3)]  # their scores with others are low or small
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in maxscore.top_k(data.filter("vec_id < 200"), data.filter("vec_id in (0, 6, 13, 50)"), 4).collect())
    usable = {i: [math.floor(256 * x) for x in v] for i, v in rows if i < 200}
    want = []
    for q in (0, 6, 13, 50):
        order = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)[:4]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(order, 1)]
    assert got == sorted(want)
    with pytest.raises(Exception, match="does not fit a long"):
        maxscore.top_k(data.filter("vec_id >= 6"), data.filter("vec_id = 200"), 4).collect()


def test_search_skips_components_and_keeps_ties():
    rng = np.random.default_rng(2)
    data = rng.normal(size=(6000, 32)) * np.linspace(1, 0.01, 32)
    data[3000:3040] = data[7]
    ids = np.arange(6000)
    search = maxscore.Search(ids[:20], data[:20], 5)
    for start in (4000, 0, 2000):  # shards come in any order
        search.add(ids[start : start + 2000], data[start : start + 2000])
    whole = np.floor(256 * data)
    for at in range(20):
        scores = whole @ whole[at]
        want = [(s, i) for s, i in sorted(zip(-scores, ids)) if i != at][:5]
        assert list(zip(-search.best[at][0], search.best[at][1])) == want
    assert search.read < 0.8 * 20 * data.size


def test_repeated_query_ids_search_with_the_least_vector(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, None), (1, [5.0, 1.0]), (1, [5.0, 1.0]), (2, [1.0, 7.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    got = maxscore.top_k(data, data.filter("vec_id = 0"), 2).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 2, 7 * 256 * 256), (2, 1, 256 * 256)]


PAGES = [
    (1, "http://a", "<html>" + "x" * 200), (2, "http://b\r\nInjected: 1", "<html>" + "x" * 200), (3, None, "short"), (4, "http://d", "short"),
    (5, "http://e", None), (6, "http://f", ""), (7, "http://g", "é🙂" * 100_000), (8, "http://h", "a\r\n\r\nb" * 40), (None, "http://n", "no id here"),
]


def pages_of(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(2)


def test_archives_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    written = warc.write_archives(pages_of(spark), folder)
    assert written.groupBy().sum("records").first()[0] == len(PAGES)
    got = {r["page_id"]: r for r in warc.read_archives(spark, folder).collect()}
    for page, url, html in PAGES:
        payload = (html or "").encode()
        assert got[page]["payload_digest"] == hashlib.sha256(payload).hexdigest() and got[page]["payload_bytes"] == len(payload)
        if got[page]["record_type"] == "response":
            assert got[page]["block"] == warc.HTTP_HEADER + payload
    assert (got[2]["record_type"], got[2]["refers_to"]) == ("revisit", 1)
    assert all(got[p]["record_type"] == "response" for p in (1, 3, 4, 5, 6, 7, 8, None))
    assert got[2]["url"] == "http://b Injected: 1" and got[3]["url"] is None


def test_archives_roll_over_and_carry_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 30_000)
    rows = [(i, f"http://x/{i}", f"<html><title>page {i}</title>" + f"<p>text {i * 7 % 13} of the page</p>" * 40) for i in range(200)]
    folder = f"file://{tmp_path}/b"
    pages = pages_of(spark, rows)
    made = warc.mark_revisits(pages, "page_id", "html", "url")
    assert made.count() == 200
    head, dictionary = warc.archive_head([r[2].encode() for r in rows])
    assert struct.unpack_from("<I", head)[0] == warc.SKIPPABLE and dictionary is not None
    assert warc.write_archives(pages, folder).groupBy().sum("records").first()[0] == 200
    assert {r["page_id"] for r in warc.read_archives(spark, folder).collect()} == set(range(200))


def archive(*records, head=None):
    head = warc.archive_head([])[0] if head is None else head
    return head + b"".join(zstandard.ZstdCompressor().compress(r) for r in records)


GOOD = warc.record_bytes(1, "http://a", b"body", hashlib.sha256(b"body").hexdigest(), None, "x")


def test_reader_accepts_plain_dictionaries_and_skippable_frames():
    samples = [f"<html>{i} some page text {i * 3}</html>".encode() * 20 for i in range(50)]
    raw = zstandard.train_dictionary(4096, samples).as_bytes()
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(GOOD)
    data = struct.pack("<II", warc.SKIPPABLE, len(raw)) + raw + frame + struct.pack("<II", 0x184D2A50, 3) + b"abc" + frame
    assert [r["page_id"] for r in warc.read_archive(data)] == [1, 1]
    assert list(warc.read_archive(archive())) == []


@pytest.mark.parametrize(
    "data",
    [
        b"", b"\x28\xb5\x2f\xfd1234", archive(GOOD)[:-3], archive(GOOD.replace(b"WARC/1.1", b"WARC/9.9")),
        archive(GOOD.replace(b"body", b"BODY")), archive(GOOD + b"x"), archive(GOOD.replace(b"WARC-Date", b"WARC-Dota")),
        archive(GOOD.replace(b"Content-Length: ", b"Content-Length: 9")), archive(b"nothing here"),
        struct.pack("<II", warc.SKIPPABLE, 999) + b"x", archive(GOOD.replace(b"WARC-Type: response", b"WARC-Type: metadata")),
    ],
)
def test_reader_refuses_broken_archives(data):
    with pytest.raises((warc.WarcError, zstandard.ZstdError)):
        list(warc.read_archive(data))
