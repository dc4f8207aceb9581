"""Conversations and event logs: turn state, newest rows, final answers, failure streaks, cache state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.operators.ordered import running, with_position
from quillspark.session import materialise

TURN_BUCKET = 1024


def wizard_turns(turns: DataFrame, max_turns: int = 3, clear: Column | None = None, enabled: Column | None = None) -> DataFrame:
    """Turn number and wizard state after every message.

    The counter rises with each user message until the wizard is resolved: at the turn limit, or at
    an assistant message that ``clear`` marks as unambiguous (a later one may reopen it).
    """
    is_user = (F.col("role") == "user").cast("int")
    on = F.lit(True) if enabled is None else enabled
    work = turns.withColumn("_b", F.floor(F.col("turn") / TURN_BUCKET))
    counted = running(
        work, ["conv_id"], ["turn"], {"turn_number": F.lit(1), "user_messages": is_user}, "_b"
    ).drop("_b")
    told = F.lit(None).cast("boolean") if clear is None else F.when(F.col("role") == "assistant", clear)
    if clear is not None:
        return _reopening_turns(counted.withColumn("_told", told), max_turns, on)
    current = F.when(on, F.least(F.col("user_messages"), F.lit(max_turns))).otherwise(0)
    return counted.withColumn("current_turn", current).withColumns(
        {
            "resolved": on & (F.col("current_turn") >= max_turns),
            "remaining": F.greatest(F.lit(0), F.lit(max_turns) - F.col("current_turn")),
        }
    )


def _reopening_turns(counted: DataFrame, max_turns: int, on: Column) -> DataFrame:
    """State when assistant verdicts can resolve or reopen the wizard.

    A user message counts while the last verdict left the wizard open. Beyond the turn limit only
    the first one after such a verdict still does, as the limit closes the wizard again at once.
    """
    c = F.col
    verdict = F.when(c("_told").isNotNull(), F.struct("turn_number", c("_told").alias("told"), "user_messages"))
    work = counted.withColumn("_v", verdict).withColumn("_b", F.floor(c("turn") / TURN_BUCKET))
    last = _carried_max(work, ["conv_id"], ["turn"], "_v", "_b", "_last").withColumns(
        {
            "_clear": F.coalesce(c("_last.told"), F.lit(False)),
            "_since": c("user_messages") - F.coalesce(c("_last.user_messages"), F.lit(0)),
        }
    )
    open_user = on & (c("role") == "user") & ~c("_clear")
    ticking = running(last, ["conv_id"], ["turn"], {"_ticks": open_user.cast("int")}, "_b")
    beyond = (on & (c("role") == "user") & ~c("_clear") & (c("_since") == 1) & (c("_ticks") > max_turns)).cast("int")
    extra = running(ticking, ["conv_id"], ["turn"], {"_extra": beyond}, "_b")
    closed = (
        F.when(c("_told").isNotNull(), c("_told"))
        .when(c("_clear"), True)
        .otherwise((c("_since") >= 1) & (c("current_turn") >= max_turns))
    )
    return extra.withColumn("current_turn", F.least(c("_ticks"), F.lit(max_turns)) + c("_extra")).withColumns(
        {"resolved": on & closed, "remaining": F.greatest(F.lit(0), F.lit(max_turns) - c("current_turn"))}
    ).drop("_v", "_b", "_last", "_clear", "_since", "_ticks", "_extra", "_told")


def _carried_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket: str, name: str) -> DataFrame:
    """Running maximum within a key, carried over buckets."""
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*keys, bucket).agg(F.max(value).alias("_m")).select(
        *keys, bucket, F.max("_m").over(earlier).alias("_carry")
    ).filter("_carry is not null")
    return (
        df.withColumn(name, F.max(value).over(inside))
        .join(tops, [*keys, bucket], "left")
        .withColumn(name, F.greatest(name, "_carry"))
        .drop("_carry")
    )


def final_answer(turns: DataFrame) -> DataFrame:
    """Last assistant message of a session that starts with a heading."""
    return (
        turns.filter((F.col("role") == "assistant") & F.col("text").startswith("#"))
        .groupBy("conv_id")
        .agg(F.max_by("text", "turn").alias("final_prompt"))
    )


def keep_newest(df: DataFrame, size: int, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Newest rows per key, or over all; each task keeps that many before the shuffle."""
    if not keys:
        return df.orderBy(*order).limit(size)
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= size).drop("_rn")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last write per key; rank one is cut map-side, so rewrites of a hot key do not travel."""
    return keep_newest(df, 1, order, keys)


def failure_streaks(
    events: DataFrame, key: str, time: str, tie: str, failed: Column, least: int = 5, cooldown: int = 300
) -> DataFrame:
    """Runs of failures without a success between them that open the breaker, with their first opening.

    Ordered by a range sort over (key, time, tie), so a key with a third of all events is many tasks.
    """
    numbered = _numbered_failures(events, key, time, tie, failed)
    return numbered.groupBy(key, "island").agg(
        F.count("*").alias("length"), F.min("ts").alias("started_at"), F.max("ts").alias("last_at"),
        F.max(F.when(F.col("number") == least, F.col("ts"))).alias("opened_at"),
    ).filter(F.col("length") >= least).withColumn(
        "open_until", F.col("opened_at") + F.make_dt_interval(secs=F.lit(cooldown))
    ).drop("island")


def _numbered_failures(events: DataFrame, key: str, time: str, tie: str, failed: Column) -> DataFrame:
    """Failures with their run (``island``) and their 1-based number in it."""
    slim = events.select(key, F.col(time).alias("ts"), F.col(tie).alias("tie"), failed.cast("int").alias("failed"))
    placed = with_position(slim, [F.col(key), F.col("ts"), F.col("tie")], "pos", "bucket")
    marked = running(placed, [key], ["pos"], {"island": 1 - F.col("failed")}, "bucket")
    return running(marked.filter("failed = 1"), [key, "island"], ["pos"], {"number": F.lit(1)}, "bucket")


def failure_openings(
    events: DataFrame, key: str, time: str, tie: str, failed: Column, least: int = 5, cooldown: int = 300
) -> DataFrame:
    """Every opening of the breaker: ``key, opened_at, open_until``.

    Attempts are refused while it is open, so failures before ``open_until`` do not count and counting
    starts over with the first one after it; a success starts over too. Each failure knows where
    counting would go on if it started there; the starts that really occur are found by doubling those
    jumps, in as many rounds as the logarithm of a run's openings.
    """
    by = [key, "island"]
    numbered = _numbered_failures(events, key, time, tie, failed)
    fails = materialise(numbered.select(*by, (F.col("number") - 1).alias("at"), "ts"))
    opening = fails.filter(F.col("at") >= least - 1).select(
        *by, (F.col("at") - (least - 1)).alias("at"), F.col("ts").alias("opened_at"),
        (F.col("ts") + F.make_dt_interval(secs=F.lit(cooldown))).alias("open_until"),
    )
    # counting goes on at the first failure that is not before the end: as many come before it
    mixed = fails.select(*by, "ts", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("at")).unionByName(
        opening.select(*by, F.col("open_until").alias("ts"), F.lit(0).alias("kind"), "at")
    )
    placed = with_position(mixed, [*map(F.col, by), F.col("ts"), F.col("kind"), F.col("at")], "place", "bucket")
    counted = running(placed, by, ["place"], {"before": F.col("kind")}, "bucket").filter("kind = 0")
    jumps = materialise(counted.select(*by, "at", F.col("before").alias("to")))
    reached = materialise(jumps.filter("at = 0").select(*by, "at"))
    known, size = jumps.select(*by, "at"), -1
    while (grown := reached.count()) != size:
        size = grown
        further = reached.join(jumps, [*by, "at"]).select(*by, F.col("to").alias("at")).join(known, [*by, "at"], "left_semi")
        reached = materialise(reached.union(further).distinct())
        ahead = jumps.select(*by, F.col("at").alias("to"), F.col("to").alias("next"))
        jumps = materialise(jumps.join(ahead, [*by, "to"]).select(*by, "at", F.col("next").alias("to")))
    return reached.join(opening, [*by, "at"]).select(key, "opened_at", "open_until")


def fold_cache(accesses: DataFrame) -> DataFrame:
    """Cache state from an access log with ``cache_key, ts, event_id, op``.

    put creates or replaces (hits kept), get and touch count a hit, delete and clear start over.
    """
    cleared = accesses.filter("op = 'clear'").agg(F.max(F.struct("ts", "event_id")).alias("c")).scalar()
    stamp = F.struct("ts", "event_id")
    live = accesses.filter((F.col("op") != "clear") & (cleared.isNull() | (stamp > cleared)))
    # only keys that were ever deleted need their last deletion looked up
    deleted = live.filter("op = 'delete'").groupBy("cache_key").agg(F.max(stamp).alias("_gone"))
    kept = live.filter("op <> 'delete'").join(deleted, "cache_key", "left").filter(
        F.col("_gone").isNull() | (stamp > F.col("_gone"))
    )
    put = F.col("op") == "put"
    return kept.groupBy("cache_key").agg(
        F.min(F.when(put, F.col("ts"))).alias("created_at"),
        F.max_by("prompt_id", F.when(put, stamp)).alias("prompt_id"),
        F.count_if(F.col("op").isin("get", "touch")).alias("hit_count"),
        F.max("ts").alias("last_accessed"),
    ).filter("created_at is not null")


def cache_statistics(cache: DataFrame) -> DataFrame:
    return cache.agg(
        F.count("*").alias("total_entries"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("total_hits"),
        F.coalesce(F.avg("hit_count"), F.lit(0.0)).alias("avg_hit_count"), F.max("last_accessed").alias("last_accessed"),
    )


def idle_sessions(turns: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Sessions whose last activity is longer ago than the limit."""
    last = turns.groupBy("conv_id").agg(F.max("ts").alias("last_activity"))
    return last.filter(F.col("last_activity") < as_of - F.make_dt_interval(hours=F.lit(hours)))
