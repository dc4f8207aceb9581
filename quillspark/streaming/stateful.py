"""State per key over rows in event-time order: breaker alarms and conversation sessions.

Rows wait in a list state, those that arrive together as one element, until the watermark has passed them and are then taken in order of time and
tie, so the result does not depend on how files and batches cut or shuffle the input, as long as no row
is later than the delay. Timers release rows, end idle sessions, and clear state that no longer matters.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.session import note_written, shared_folder

SECOND = 1_000_000
END_OF_INPUT = "2200-01-01 00:00:00"
PIECE = 10_000  # rows an element of the waiting list holds at most
COUNT, TIME, FLAG = T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _pieces(columns: list[list]) -> Iterator[tuple[list, ...]]:
    """Columns of equal length as elements of the waiting list."""
    for start in range(0, len(columns[0]), PIECE):
        yield tuple(c[start:start + PIECE] for c in columns)


class InOrder(StatefulProcessor):
    """Rows ``us, tie, *extra`` of a key in order. Times are microseconds.

    A subclass steps through due rows in ``advance`` and gets a last look in ``passed`` whenever the
    watermark moves on; both return output rows.
    """

    extra: dict[str, T.DataType] = {}
    kept: dict[str, T.DataType] = {}
    output: Sequence[str] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = {"us": TIME, "tie": TIME, **self.extra}
        # a list per column: an element costs a call and its conversion, whatever it holds
        self.waiting = handle.getListState("waiting", _struct(**{n: T.ArrayType(t) for n, t in columns.items()}))
        self.state = handle.getValueState("state", _struct(**self.kept))
        self.now = None

    def wake(self, us: int) -> None:
        """A timer for the first watermark that has passed ``us``; ``passed`` sees to what has passed already."""
        at = us // 1000 + 1
        if self.now is None or at > self.now:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.now = None
        least = None
        pieces = []
        for frame in rows:
            beat = frame["beat"].to_numpy(dtype=bool)
            if beat.any():
                frame = frame[~beat]
            if len(frame):
                columns = [[None if v is not v else v for v in frame[n].tolist()] for n in ("us", "tie", *self.extra)]
                pieces.extend(_pieces(columns))
                first = min(columns[0])
                least = first if least is None else min(least, first)
                if len(pieces) >= 10:
                    self.waiting.appendList(pieces)
                    pieces = []
        if pieces:
            self.waiting.appendList(pieces)
        if least is not None:
            self.wake(least)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.now = timerValues.getCurrentWatermarkInMs()
        now = self.now * 1000
        rows = [row for piece in self.waiting.get() for row in zip(*piece)]
        due = sorted((r for r in rows if r[0] <= now), key=lambda r: r[:2])
        if due:
            rest = [r for r in rows if r[0] > now]
            if rest:
                self.waiting.put(list(_pieces([list(c) for c in zip(*rest)])))
                self.wake(min(r[0] for r in rest))
            else:
                self.waiting.clear()
        held = self.state.get()
        held = tuple(held) if held is not None else None
        out, after = self.advance(key[0], held, due) if due else ([], held)
        ended, after = self.passed(key[0], after, now)
        if after != held:
            if after is None:
                self.state.clear()
            else:
                self.state.update(after)
        if out or ended:
            yield pd.DataFrame([*out, *ended], columns=list(self.output))

    def advance(self, key, held: tuple | None, due: list[tuple]) -> tuple[list[tuple], tuple | None]:
        raise NotImplementedError

    def passed(self, key, held: tuple | None, now: int) -> tuple[list[tuple], tuple | None]:
        return [], held

    def close(self) -> None:
        pass


class StreakProcessor(InOrder):
    """Consecutive failures of a key; opens at ``least`` and starts over after the cool-down.

    Failures while it is open do not count, as attempts are refused then. A success, or the end of the
    cool-down, leaves no state behind.
    """

    extra, kept = {"failed": FLAG}, {"count": COUNT, "until": TIME}
    output = ("key", "opened_us", "until_us")

    def __init__(self, least: int, cooldown: int) -> None:
        self.least, self.cooldown = least, cooldown * SECOND

    def advance(self, key, held, due):
        count, until = held or (0, 0)
        out = []
        for us, _, failed in due:
            if until and us >= until:
                count, until = 0, 0
            if not failed:
                count, until = 0, 0
            elif not until:
                count += 1
                if count == self.least:
                    until = us + self.cooldown
                    out.append((key, us, until))
        if until:
            self.wake(until)
        return out, (count, until) if count else None

    def passed(self, key, held, now):
        # later rows come after the cool-down, which starts the count anew
        return [], None if held and held[1] and now >= held[1] else held


class SessionProcessor(InOrder):
    """Turn counter and resolution per session of a key; a pause longer than ``idle`` ends a session.

    ``ended`` chooses the rows: one per message, or one per session when it has ended.
    """

    extra = {"role": T.StringType(), "told": FLAG}
    kept = {"start": TIME, "last": TIME, "messages": COUNT, "turn": COUNT, "resolved": FLAG}

    def __init__(self, max_turns: int, idle: int, ended: bool) -> None:
        self.max_turns, self.idle, self.ended = max_turns, idle * SECOND, ended
        self.output = (
            ("key", "start_us", "last_us", "messages", "current_turn", "resolved") if ended
            else ("key", "us", "tie", "start_us", "turn_number", "current_turn", "resolved", "remaining")
        )

    def advance(self, key, held, due):
        out = []
        for us, tie, role, told in due:
            if held and us - held[1] > self.idle:
                if self.ended:
                    out.append((key, *held))
                held = None
            start, _, messages, turn, resolved = held or (us, us, 0, 0, False)
            messages += 1
            if role == "user" and not resolved:
                turn += 1
                resolved = turn >= self.max_turns
            elif role == "assistant" and told is not None:
                resolved = bool(told)
            held = (start, us, messages, turn, resolved)
            if not self.ended:
                out.append((key, us, tie, start, messages, turn, resolved, max(0, self.max_turns - turn)))
        self.wake(held[1] + self.idle)
        return out, held

    def passed(self, key, held, now):
        # rows still to come are later than now, so they belong to another session
        if held and now >= held[1] + self.idle:
            return ([(key, *held)] if self.ended else []), None
        return [], held


def _in_order(rows: DataFrame, delay: str) -> tuple[DataFrame, tuple[str, T.StructType]]:
    """``rows`` with a watermark on ``ts`` that heartbeats, read from a folder of their own, can move on."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/quillspark/heartbeats-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    note_written(folder)
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    beats = spark.readStream.schema(shape).parquet(folder)
    return rows.unionByName(beats).withWatermark("ts", delay), (folder, shape)


def beat(spark: SparkSession, heartbeats: tuple[str, T.StructType], at: str = END_OF_INPUT) -> None:
    """A heartbeat: tells a stream that everything before ``at`` has arrived."""
    folder, shape = heartbeats
    fixed = {"ts": F.lit(at), "us": F.lit(0), "tie": F.lit(0), "beat": F.lit(True)}
    row = [fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields]
    spark.range(1).select(*row).coalesce(1).write.mode("append").parquet(folder)


def _run(rows: DataFrame, delay: str, processor: InOrder, shape: str, columns: Sequence[Column]) -> DataFrame:
    ordered, heartbeats = _in_order(rows, delay)
    out = ordered.groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=shape, outputMode="Append", timeMode="EventTime"
    ).select(*columns)
    out.heartbeats = heartbeats  # for whoever runs the stream to its end
    return out


def _time(name: str, alias: str) -> Column:
    return F.timestamp_micros(name).alias(alias)


def _slim(rows: DataFrame, key: str, time: str, tie: str, *extra: Column) -> DataFrame:
    at = F.col(time).cast("timestamp")
    return rows.select(
        F.col(key).cast("long").alias("key"), at.alias("ts"), F.unix_micros(at).alias("us"), F.col(tie).cast("long").alias("tie"),
        F.lit(False).alias("beat"), *extra,
    ).filter("ts is not null and tie is not null")


def streak_alarms(
    events: DataFrame, key: str, time: str, tie: str, failed: Column, least: int = 5, cooldown: int = 300, delay: str = "10 minutes"
) -> DataFrame:
    """An alarm whenever a key fails often enough in a row: ``key, opened_at, open_until``.

    It comes once the watermark has passed the failure. Rows later than ``delay`` are dropped, as are rows
    without a time or a tie; a null key is a key, and an unknown outcome is no failure.
    """
    rows = _slim(events, key, time, tie, F.coalesce(failed, F.lit(False)).alias("failed"))
    return _run(
        rows, delay, StreakProcessor(least, cooldown), "key long, opened_us long, until_us long",
        [F.col("key"), _time("opened_us", "opened_at"), _time("until_us", "open_until")],
    )


def _sessions(turns: DataFrame, key: str, time: str, tie: str, max_turns: int, clear: Column | None, idle: int, delay: str, ended: bool) -> DataFrame:
    told = F.lit(None).cast("boolean") if clear is None else F.when(F.col("role") == "assistant", clear)
    rows = _slim(turns, key, time, tie, F.col("role"), told.alias("told"))
    if ended:
        shape = "key long, start_us long, last_us long, messages int, current_turn int, resolved boolean"
        columns = [F.col("key").alias(key), _time("start_us", "session_start"), _time("last_us", "last_activity"), "messages", "current_turn", "resolved"]
    else:
        shape = "key long, us long, tie long, start_us long, turn_number int, current_turn int, resolved boolean, remaining int"
        columns = [
            F.col("key").alias(key), F.col("tie").alias(tie), _time("us", "ts"), _time("start_us", "session_start"),
            "turn_number", "current_turn", "resolved", "remaining",
        ]
    return _run(rows, delay, SessionProcessor(max_turns, idle, ended), shape, columns)


def session_turns(
    turns: DataFrame, key: str = "conv_id", time: str = "ts", tie: str = "turn", max_turns: int = 3,
    clear: Column | None = None, idle: int = 24 * 3600, delay: str = "10 minutes",
) -> DataFrame:
    """Session, turn number and wizard state after every message, as the watermark passes it.

    A pause of more than ``idle`` seconds starts a new session; ``clear`` marks assistant messages that
    settle (true) or reopen (false) it.
    """
    return _sessions(turns, key, time, tie, max_turns, clear, idle, delay, ended=False)


def ended_sessions(
    turns: DataFrame, key: str = "conv_id", time: str = "ts", tie: str = "turn", max_turns: int = 3,
    clear: Column | None = None, idle: int = 24 * 3600, delay: str = "10 minutes",
) -> DataFrame:
    """A session when it has been idle for longer than ``idle`` seconds; its state goes at the same time."""
    return _sessions(turns, key, time, tie, max_turns, clear, idle, delay, ended=True)
