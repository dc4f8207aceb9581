"""Streams with state against their batch twins, whatever files and batches the input comes in."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import sessions as S
from quillspark.sources import keyed
from quillspark.streaming import jobs as J

START = dt.datetime(2024, 1, 1)
SHAPE = "k long, i long, ts timestamp, role string, f boolean"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def as_stream(spark, folder, rows, files, shuffled=False):
    """``rows`` as a stream of one file a batch; shuffled, a file may hold rows earlier than the one before it."""
    rows = list(rows)
    if shuffled:
        random.Random(1).shuffle(rows)
    for n in range(files):
        spark.createDataFrame(rows[n::files], SHAPE).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(folder))


def failures():
    rng = random.Random(4)
    rows, n = [], 0
    for k in range(6):
        second = 0
        for _ in range(80):
            second += rng.choice([1, 5, 60, 400, 400])
            rows.append((k, n, at(second + k / 7), None, rng.random() < 0.7))
            n += 1
    # equal times of one key go by the tie
    rows += [(9, 1000 + i, at(50), None, i != 2) for i in range(6)]
    return rows


@pytest.mark.parametrize("files,shuffled", [(1, False), (7, True)])
def test_alarms_are_those_of_the_batch_job(spark, tmp_path, files, shuffled):
    rows = failures()
    want = S.failure_openings(spark.createDataFrame(rows, SHAPE), "k", "ts", "i", F.col("f"), least=3, cooldown=300)
    stream = as_stream(spark, tmp_path / "in", rows, files, shuffled)
    got = J.drain(J.streak_alarms(stream, "k", "ts", "i", F.col("f"), 3, 300, delay="30 days"), stateful_python=True)
    expected = sorted((r.k, r.opened_at, r.open_until) for r in want.collect())
    assert len(expected) > 20 and sorted((r.key, r.opened_at, r.open_until) for r in got.collect()) == expected


def talks():
    rng = random.Random(8)
    rows, n = [], 0
    for k in range(5):
        second = 0
        for _ in range(40):
            second += rng.choice([1, 30, 3600, 24 * 3600, 24 * 3600 + 1, 50 * 3600])
            rows.append((k, n, at(second), rng.choice(["user", "user", "assistant", "system"]), rng.choice([True, False, None])))
            n += 1
    return rows


def walk(rows, limit, idle):
    """Sessions stepped through message by message."""
    turns, ended = [], []
    for k in sorted({r[0] for r in rows}):
        held = None
        for _, i, ts, role, told in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if held and (ts - held[1]).total_seconds() > idle:
                ended.append((k, *held))
                held = None
            start, _, messages, turn, resolved = held or (ts, ts, 0, 0, False)
            if role == "user" and not resolved:
                turn += 1
                resolved = turn >= limit
            elif role == "assistant" and told is not None:
                resolved = told
            held = (start, ts, messages + 1, turn, resolved)
            turns.append((k, i, start, messages + 1, turn, resolved, max(0, limit - turn)))
        ended.append((k, *held))
    return sorted(turns), sorted(ended)


@pytest.mark.parametrize("files,shuffled", [(1, False), (10, True)])
def test_sessions_end_after_a_day(spark, tmp_path, files, shuffled):
    rows = talks()
    turns, ended = walk(rows, 2, 24 * 3600)
    options = dict(key="k", time="ts", tie="i", max_turns=2, clear=F.col("f"), delay="400 days")
    stream = as_stream(spark, tmp_path / "in", rows, files, shuffled)
    got = J.drain(J.session_turns(stream, **options), stateful_python=True).collect()
    assert sorted((r.k, r.i, r.session_start, r.turn_number, r.current_turn, r.resolved, r.remaining) for r in got) == turns
    got = J.drain(J.ended_sessions(stream, **options), stateful_python=True).collect()
    assert sorted((r.k, r.session_start, r.last_activity, r.messages, r.current_turn, r.resolved) for r in got) == ended


def test_timers_release_rows_and_leave_no_state_behind(spark, tmp_path):
    """Before the input has ended: what the watermark has passed is out, and only what it has not is kept."""
    day = 24 * 3600
    rows = [(1, 0, at(0), "user", None), (1, 1, at(60), "user", None), (2, 2, at(2 * day), "user", None), (2, 3, at(2 * day + 5), "assistant", True)]
    stream = as_stream(spark, tmp_path / "in", rows, 4)
    out = J.ended_sessions(stream, "k", "ts", "i", 3, F.col("f"), delay="1 minute")
    checkpoint = str(tmp_path / "state")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, J.ROCKSDB)
    try:
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        sessions = spark.read.parquet(str(tmp_path / "out")).collect()
        assert [(r.k, r.session_start, r.last_activity, r.messages, r.current_turn, r.resolved) for r in sessions] == [(1, at(0), at(60), 2, 2, False)]
        held = lambda variable: {r.key["key"] for r in spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load().collect()}
        assert 1 not in held("state") and held("waiting") <= {2}
    finally:
        spark.conf.set(name, before)


def test_rows_that_arrive_together_wait_as_one_element(spark, tmp_path):
    rows = [(k, 100 * k + n, at(n), "user", None if n % 2 else True) for k in (1, 2) for n in range(30)]
    stream = as_stream(spark, tmp_path / "in", rows, 1)
    out = J.session_turns(stream, "k", "ts", "i", 3, F.col("f"), delay="400 days")
    checkpoint = str(tmp_path / "state")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, J.ROCKSDB)
    try:
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "waiting").load().select("key.key", "list_element.*").collect()
        assert sorted((r["key"], len(r.us), sorted(r.tie)) for r in held) == [(k, 30, [100 * k + n for n in range(30)]) for k in (1, 2)]
    finally:
        spark.conf.set(name, before)


def test_rows_without_key_or_tie_do_no_harm(spark, tmp_path):
    rows = [(None, 0, at(0), "user", True), (None, 1, at(1), "user", True), (3, None, at(2), "user", True), (3, 4, None, "user", True), (4, 5, at(3), "user", None)]
    stream = as_stream(spark, tmp_path / "in", rows, 1)
    got = J.drain(J.streak_alarms(stream, "k", "ts", "i", F.col("f"), 2, 60), stateful_python=True).collect()
    assert [(r.key, r.opened_at) for r in got] == [(None, at(1))]


def metrics_of(spark, rows):
    return spark.createDataFrame(rows, "prompt_id long, at long, v string")


def state(spark, path):
    return {r.prompt_id: (r.at, r.v) for r in keyed.read_keyed(spark, path, metrics_of(spark, []).schema).collect()}


def test_keyed_table_rewrites_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "table")
    put = lambda rows, batch: keyed.upsert(metrics_of(spark, rows), path, batch, ["prompt_id"], ["at"], buckets=16)
    assert state(spark, path) == {}
    put([(k, 1, "a") for k in range(200)] + [(7, 3, "c"), (7, 2, "b"), (None, 1, "n")], 0)
    assert len(state(spark, path)) == 201 and state(spark, path)[7] == (3, "c") and state(spark, path)[None] == (1, "n")
    touched = put([(7, 3, "same time, later batch"), (8, 0, "older"), (8, 5, None)], 1)
    assert 1 <= len(touched) <= 2
    after = state(spark, path)
    assert after[7] == (3, "same time, later batch") and after[8] == (5, None) and len(after) == 201
    files = keyed._folders(spark, path)
    assert sorted(files[1]) == touched and len(files[0]) == 16  # the state before is still there for its readers
    assert put([(9, 9, "x")], 1) == touched and state(spark, path) == after  # a batch that comes twice counts once
    put([], 2)
    assert state(spark, path) == after
    put([(7, 4, "d")], 3)
    assert state(spark, path)[7] == (4, "d") and len(keyed._folders(spark, path)[0]) < 16
    only = keyed.read_keyed(spark, path, metrics_of(spark, []).schema, buckets=touched)
    assert {r.prompt_id for r in only.collect()} < set(state(spark, path))


def test_a_batch_that_fails_half_way_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    keyed.upsert(metrics_of(spark, [(1, 1, "a"), (2, 1, "b")]), path, 0, ["prompt_id"], ["at"])
    before = state(spark, path)
    broken = metrics_of(spark, [(1, 2, "x"), (5, 2, "y")]).withColumn("v", F.when(F.col("prompt_id") == 5, F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no"):
        keyed.upsert(broken.withColumn("v", F.col("v").cast("string")), path, 1, ["prompt_id"], ["at"])
    assert state(spark, path) == before
    keyed.upsert(metrics_of(spark, [(1, 2, "x")]), path, 1, ["prompt_id"], ["at"])
    assert state(spark, path) == {1: (2, "x"), 2: (1, "b")}
