"""JSON documents cut by byte range."""

import json
import random

import pytest

from quillspark.sources import jsondocs as J

BLOCK = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in (BLOCK, "spark.sql.files.openCostInBytes")}
    spark.conf.set(BLOCK, 700)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def records(n, seed):
    rng = random.Random(seed)
    odd = ["}", "]}", '"', "\\", '\\"', "[{", ",", '"examples": [', "é🙂", "\n", "x" * 900, "", "}" * 40]
    value = lambda d: rng.choice([None, 1, rng.choice(odd) * rng.randint(0, 3), [value(d - 1)] if d else 2, {rng.choice(odd): value(d - 1)} if d else True])
    return [{"id": i, "a": value(3), "b": [value(2), {"examples": [1, 2]}]} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("wrap", ["array", "object", "last"])
def test_elements_equal_a_whole_parse(spark, tmp_path, small_blocks, wrap, indent):
    want = {}
    for seed, n in enumerate([0, 1, 60, 200]):
        rows = records(n, seed)
        other = {"meta": {"examples": records(3, 9)}, "more": records(5, 8), "odd}": [1]}
        whole = {"array": rows, "object": {**other, "examples": rows, "tail": [1, {"examples": [3]}]}, "last": {"n": 1, "examples": rows}}[wrap]
        (tmp_path / f"{seed}.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=bool(seed % 2)) + "\n" * (seed % 3), encoding="utf-8")
        want |= {(f"{seed}.json", i): r for i, r in enumerate(rows)}
    rows = J.elements(spark, str(tmp_path), "examples").collect()
    got = {(r.source_path.rsplit("/", 1)[1], r.pos): json.loads(r.value) for r in rows}
    assert len(rows) == len(got) and got == want
    blocks = J.text_pieces(spark, str(tmp_path)).select("source_path", "block").distinct().count()
    assert blocks > 30  # many blocks, elements longer than one among them


@pytest.mark.parametrize("text", ['{"rows": []}', '{"examples": {"a": [1]}}', '[{"a": 1}', '[{"a": 1', '[{"a": "x]', "7", '"[]"'])
def test_wrong_shapes_stop(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="expected an array"):
        J.elements(spark, str(tmp_path / "a.json"), "examples").collect()


@pytest.mark.parametrize("key", [None, "examples"])
def test_written_documents_come_back(spark, tmp_path, key):
    df = spark.range(1000, numPartitions=5).filter("id < 400 or id >= 600").selectExpr("id", "repeat('}', id % 5) AS t")
    J.write_documents(df, str(tmp_path / "d"), key)
    for text in (tmp_path / "d").glob("part-*"):
        json.loads(text.read_text())
    got = [json.loads(r.value) for r in J.elements(spark, str(tmp_path / "d"), key or "examples").collect()]
    assert sorted((r["id"], r["t"]) for r in got) == sorted((r.id, r.t) for r in df.collect())


def test_a_batch_is_never_whole_in_python():
    """Peak of Python objects while a batch of 20 MB is walked."""
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * 10_000), pa.array([0] * 10_000), pa.array(["x" * 2000] * 10_000)], names=["source_path", "block", "value"])
    seen = lambda state, pieces: iter([(*state, sum(len(p) for p in pieces))])
    work = J.per_block(seen, "source_path string, block long, n long", [pa.string(), pa.int64(), pa.int64()])
    tracemalloc.start()
    try:
        (out,) = work(iter([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.to_pylist() == [{"source_path": "f", "block": 0, "n": 2001 * 10_000}]
    assert peak < 4 << 20
