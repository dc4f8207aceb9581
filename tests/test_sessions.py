"""Turn state, streaks, cache folding and streams against step-by-step restatements."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import sessions as S
from quillspark.streaming import jobs as J


def walk(messages, limit):
    """The wizard stepped through message by message; the last field tells whether it cleared up."""
    turn, resolved, out = 0, False, []
    for n, (role, told) in enumerate(messages, 1):
        if role == "user" and not resolved:
            turn += 1
            resolved = turn >= limit
        elif role == "assistant" and told is not None:
            resolved = told
        out.append((n, turn, resolved, max(0, limit - turn)))
    return out


@pytest.mark.parametrize("bucket", [3, 1024])
def test_wizard_turns(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "TURN_BUCKET", bucket)
    rng = random.Random(3)
    talks = {
        c: [(rng.choice(["user", "assistant", "system"]), rng.choice([True, False, None])) for _ in range(rng.randint(1, 25))]
        for c in range(40)
    }
    rows = [(c, t * 2, role, told) for c, talk in talks.items() for t, (role, told) in enumerate(talk)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, told boolean")
    got = S.wizard_turns(df, 3, clear=F.col("told")).orderBy("conv_id", "turn").collect()
    want = [(c, *state) for c, talk in talks.items() for state in walk(talk, 3)]
    assert [(r.conv_id, r.turn_number, r.current_turn, r.resolved, r.remaining) for r in got] == want


def test_wizard_without_verdicts(spark):
    df = spark.createDataFrame([(1, t, "user") for t in range(5)], "conv_id long, turn long, role string")
    got = S.wizard_turns(df, 2).orderBy("turn").collect()
    assert [(r.current_turn, r.resolved) for r in got] == [(1, False), (2, True), (2, True), (2, True), (2, True)]


def test_failure_streaks(spark):
    start = dt.datetime(2024, 1, 1)
    flags = [1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 0] + [1] * 6
    rows = [(1, i, start + dt.timedelta(seconds=i), f) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "k long, i long, ts timestamp, f int")
    got = sorted((r.length, r.opened_at) for r in S.failure_streaks(df, "k", "ts", "i", F.col("f") == 1).collect())
    assert got == [(5, start + dt.timedelta(seconds=4)), (6, start + dt.timedelta(seconds=15))]


def test_breaker_opens_again_after_the_cool_down(spark):
    start = dt.datetime(2024, 1, 1)
    at = lambda s: start + dt.timedelta(seconds=s)
    rows = [(1, i, at(100 * i), 1) for i in range(20)] + [(2, i, at(i), int(i != 3)) for i in range(9)] + [(3, 0, at(0), 1)]
    df = spark.createDataFrame(rows, "k long, i long, ts timestamp, f int")
    got = S.failure_openings(df, "k", "ts", "i", F.col("f") == 1).collect()
    assert sorted((r.k, r.opened_at, r.open_until) for r in got) == [
        (1, at(400), at(700)), (1, at(1100), at(1400)), (1, at(1800), at(2100)), (2, at(8), at(308)),
    ]
    assert S.failure_openings(df.filter("false"), "k", "ts", "i", F.col("f") == 1).count() == 0


def test_fold_cache(spark):
    start = dt.datetime(2024, 1, 1)
    log = [("a", "put"), ("a", "get"), ("b", "put"), ("a", "delete"), ("a", "get"), ("a", "put"), ("b", "touch"), ("c", "get")]
    rows = [(k, op, start + dt.timedelta(seconds=i), i, i) for i, (k, op) in enumerate(log)]
    df = spark.createDataFrame(rows, "cache_key string, op string, ts timestamp, event_id long, prompt_id long")
    got = {r.cache_key: (r.hit_count, r.prompt_id) for r in S.fold_cache(df).collect()}
    assert got == {"a": (1, 5), "b": (1, 2)}
    cleared = df.union(spark.createDataFrame([("", "clear", start + dt.timedelta(seconds=99), 99, 99)], df.schema))
    assert S.fold_cache(cleared).count() == 0


def test_streak_processor_restarts_after_cooldown(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    # two failures open it; 400 s later counting starts over
    seconds = [0, 1, 401, 402, 403]
    rows = [(1, i, start + dt.timedelta(seconds=s), True) for i, s in enumerate(seconds)]
    spark.createDataFrame(rows, "k long, i long, ts timestamp, f boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, i long, ts timestamp, f boolean").parquet(str(tmp_path / "in"))
    alarms = J.drain(J.streak_alarms(stream, "k", "ts", "i", F.col("f"), least=2), stateful_python=True)
    assert sorted(r.opened_at for r in alarms.collect()) == [start + dt.timedelta(seconds=1), start + dt.timedelta(seconds=402)]


def test_final_answer_and_newest(spark):
    df = spark.createDataFrame(
        [(1, 0, "assistant", "# a"), (1, 1, "assistant", "# b"), (1, 2, "assistant", "c"), (2, 0, "user", "# d")],
        "conv_id long, turn long, role string, text string",
    )
    assert [tuple(r) for r in S.final_answer(df).collect()] == [(1, "# b")]
    assert S.keep_newest(df, 2, [F.desc("turn")], ["conv_id"]).count() == 3
