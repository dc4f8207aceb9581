"""Ordered computations against plain Python, with tiny buckets so that every carry is used."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillspark.operators import ordered as O


@pytest.fixture
def rows():
    rng = random.Random(7)
    # key 0 holds half of all rows
    return [(rng.choice([0, 0, 0, 1, 2, 3]), i, rng.randint(0, 9), rng.choice([0.1, 0.25, 0.5, 0.75, rng.random()])) for i in range(400)]


@pytest.fixture
def frame(spark, rows, monkeypatch):
    monkeypatch.setattr(O, "BUCKET_ROWS", 7)
    return spark.createDataFrame(rows, "k long, i long, v long, x double").repartition(5)


def test_position_is_dense_and_ordered(frame, rows):
    got = {r.i: r.pos for r in O.with_position(frame, [F.col("k"), F.col("i")]).collect()}
    want = {i: p for p, (_, i, _, _) in enumerate(sorted(rows, key=lambda r: (r[0], r[1])))}
    assert got == want


@pytest.mark.parametrize("ahead", [True, False])
def test_neighbour_crosses_buckets(frame, rows, ahead):
    placed = O.with_position(frame, [F.col("k"), F.col("i")], "pos", "b")
    got = {r.i: (r.n.v if r.n else None) for r in O.neighbour(placed, ["k"], ["pos"], ["v"], "b", "n", ahead).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for at, row in enumerate(mine):
            to = at + (1 if ahead else -1)
            want[row[1]] = mine[to][2] if 0 <= to < len(mine) else None
    assert got == want


def test_running_total_crosses_buckets(frame, rows):
    placed = O.with_position(frame, [F.col("k"), F.col("i")], "pos", "b")
    got = {r.i: r.s for r in O.running(placed, ["k"], ["pos"], {"s": F.col("v")}, "b").collect()}
    want, sums = {}, {}
    for key, i, v, _ in sorted(rows):
        sums[key] = sums.get(key, 0) + v
        want[i] = sums[key]
    assert got == want


def test_exact_quantiles(frame, rows):
    wanted = {"med": ("median", 0.5), "near": ("nearest", 0.95), "low": ("floor", 0.6)}
    for got in O.exact_quantiles(frame, ["k"], "x", wanted).collect():
        values = sorted(r[3] for r in rows if r[0] == got.k)
        n = len(values)
        assert got.med == pytest.approx(statistics.median(values))
        assert got.near == values[-(-n * 95 // 100) - 1]
        assert got.low == values[int(n * 0.6)]


def test_quantiles_of_one_hot_value(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 5.0).otherwise(F.col("id").cast("double")).alias("x"))
    row = O.exact_quantiles(df, [], "x", {"m": ("median", 0.5), "p": ("nearest", 0.95), "f": ("floor", 0.95)}).first()
    assert (row.m, row.p, row.f) == (5.0, 949.0, 950.0)


WANTED = {"med": ("median", 0.5), "near": ("nearest", 0.95), "low": ("floor", 0.6), "top": ("nearest", 1.0), "least": ("floor", 0.0)}


def plain_quantiles(values):
    values, n = sorted(values), len(values)
    return ((values[(n - 1) // 2] + values[n // 2]) / 2, values[max(0, -(-n * 95 // 100) - 1)], values[min(int(n * 0.6), n - 1)], values[-1], values[0])


@pytest.mark.parametrize("few,bins", [(5, 4), (40, 16), (1, 3)])
def test_quantiles_by_refined_histograms(spark, monkeypatch, few, bins):
    monkeypatch.setattr(O, "FEW_VALUES", few)
    monkeypatch.setattr(O, "HISTOGRAM_BINS", bins)
    rng = random.Random(9)
    held = {
        "spread": [rng.uniform(-1e6, 1e6) for _ in range(300)], "close": [1e300, *[rng.random() * 1e-9 for _ in range(200)], -1e300],
        "signs": [-0.0, 0.0, -1.5, 2.5, 2.5], "one": [7.0], None: [3.0, 1.0, 2.0], "ends": [float("inf"), float("-inf"), 1.0, 2.0, 3.0],
    }
    rows = [(k, v) for k, vs in held.items() for v in vs] + [("one", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    got = {r.k: (r.med, r.near, r.low, r.top, r.least) for r in O.exact_quantiles(df, ["k"], "x", WANTED).collect()}
    assert got == {k: plain_quantiles(vs) for k, vs in held.items()}


def test_quantiles_of_a_million_values_in_four_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        # an odd factor makes a permutation of 0 .. 2^20 - 1
        df = spark.range(1 << 20).select(((F.col("id") * 777_781) % (1 << 20)).alias("x"))
        row = O.exact_quantiles(df, [], "x", WANTED).first()
        assert tuple(row) == plain_quantiles(range(1 << 20))
        plan = O.exact_quantiles(df, [], "x", WANTED)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_values_too_close_for_bins(spark, monkeypatch):
    """Whole numbers that are one and the same double still get their own rank."""
    monkeypatch.setattr(O, "FEW_VALUES", 3)
    values = [(1 << 60) + i for i in range(20)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    assert O.exact_quantiles(df, [], "x", {"near": ("nearest", 0.5), "top": ("floor", 0.95)}).first()[:] == (values[9], values[19])


def test_no_values(spark):
    none = spark.createDataFrame([(None, "a")], "x double, k string")
    assert O.exact_quantiles(none, ["k"], "x", WANTED).count() == 0
    assert [tuple(r) for r in O.exact_quantiles(none, [], "x", WANTED).collect()] == [(None,) * 5]
