"""Queries that run as streams over all available files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.functions import gates as G
from quillspark.session import note_written, shared_folder
from quillspark.plans.common import COHERENCE_SQL, CLARITY_SQL, openings_sql, over_history, over_scored, query, rounded
from quillspark.plans.gates import REPORT_COLUMNS, filler_sql, report_sql
from quillspark.functions import scores as S
from quillspark.sources import views
from quillspark.streaming import jobs as J


@query(
    "stream_scores",
    f"SELECT doc_id AS id, round({CLARITY_SQL}, 6) AS clarity, round({COHERENCE_SQL}, 6) AS coherence FROM (SELECT doc_id, text AS improved_prompt FROM documents)",
)
def stream_scores(spark, folder):
    docs = J.events_stream(spark, folder, "documents").select("doc_id", "text")
    scored = docs.select(F.col("doc_id").alias("id"), S.clarity(F.col("text")).alias("clarity"), S.coherence(F.col("text")).alias("coherence"))
    return rounded(J.drain(scored), "clarity", "coherence")


@query("stream_gates", f"SELECT doc_id, {filler_sql('text')[2]} AS status FROM documents")
def stream_gates(spark, folder):
    docs = J.events_stream(spark, folder, "documents")
    return J.drain(docs.select("doc_id", G.filler_gate(F.col("text")).alias("status")))


@query(
    "stream_impact",
    """SELECT user_id, count(*) FILTER (event_type = 'click') AS copy_count, count(*) FILTER (event_type = 'error') AS regeneration_count,
    count(*) FILTER (event_type = 'view') AS reuse_count FROM events GROUP BY user_id""",
)
def stream_impact(spark, folder):
    totals = J.impact_stream(J.events_stream(spark, folder, "events"))
    return J.drain(totals, "update", ["user_id"]).select("user_id", "copy_count", "regeneration_count", "reuse_count")


@query("stream_hits", "SELECT user_id, count(*) - 1 AS hits FROM events GROUP BY user_id")
def stream_hits(spark, folder):
    return J.drain(J.hit_counts(J.events_stream(spark, folder, "events"), "user_id"), "update", ["user_id"])


@query("stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedup(spark, folder):
    events = J.events_stream(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key")
    )
    # the delay spans the whole table, so one row per key is left
    first = J.drain(J.first_requests(events, "key", "ts", "400 days"))
    return first.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(
    "stream_windows",
    """SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""",
)
def stream_windows(spark, folder):
    events = J.events_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = J.drain(J.rolling(events, "ts", "value", ["event_type"], "1 day", None, "1 hour"), "update", ["window_start", "event_type"])
    return rounded(out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "mean"), "mean")


@query(
    "stream_sliding",
    """SELECT w AS window_start, count(*) AS n, round(avg(value), 6) AS mean FROM (
    SELECT value, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY w""",
)
def stream_sliding(spark, folder):
    events = J.events_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = J.drain(J.rolling(events, "ts", "value", [], "2 days", "1 day", "1 hour"), "update", ["window_start"])
    return rounded(out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "mean"), "mean")


@query(
    "stream_sessions",
    """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS n FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
      SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 12 HOUR)::INT AS fresh FROM events))
    GROUP BY user_id, s""".replace("sum(fresh)", "sum(coalesce(fresh, 1))"),
)
def stream_sessions(spark, folder):
    # complete: sessions still open at the end are part of the answer
    events = J.events_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = J.drain(J.activity_sessions(events, "user_id", "ts", "12 hours"), "complete", ["user_id", "session_start"])
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("user_id", ntz("session_start"), ntz("session_end"), "n")


@query(
    "stream_streaks",
    openings_sql(2, 600) + "SELECT user_id AS key, ts AS opened_at FROM s WHERE opens",
)
def stream_streaks(spark, folder):
    events = J.events_stream(spark, folder, "events")
    alarms = J.streak_alarms(events, "user_id", "ts", "event_id", F.col("event_type") == "error", least=2, cooldown=600)
    return J.drain(alarms, stateful_python=True).select("key", F.col("opened_at").cast("timestamp_ntz").alias("opened_at"))


@query(
    "stream_wizard",
    """SELECT conv_id, turn, turn_number, least(u, 2)::INT AS current_turn, u >= 2 AS resolved, greatest(0, 2 - least(u, 2))::INT AS remaining FROM (
    SELECT conv_id, turn, row_number() OVER w AS turn_number, sum((role = 'user')::INT) OVER w AS u FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""",
)
def stream_wizard(spark, folder):
    at = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, conv_id, turn, 0)")
    turns = J.events_stream(spark, folder, "conversations").withColumn("ts", at)
    return J.drain(J.wizard_stream(turns, 2), stateful_python=True)


SESSION_TURNS_SQL = """
  t AS (SELECT user_id AS conv_id, event_id AS turn, ts, CASE event_type WHEN 'error' THEN 'assistant' WHEN 'signup' THEN 'system' ELSE 'user' END AS role,
    CASE WHEN event_type = 'error' AND event_id % 3 < 2 THEN event_id % 3 = 0 END AS told FROM events),
  g AS (SELECT *, sum((gap IS NULL OR gap > INTERVAL 24 HOUR)::INT) OVER (PARTITION BY conv_id ORDER BY ts, turn) AS s
    FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY conv_id ORDER BY ts, turn) AS gap FROM t)),
  n AS (SELECT *, row_number() OVER w AS k, first_value(ts) OVER w AS session_start FROM g WINDOW w AS (PARTITION BY conv_id, s ORDER BY ts, turn)),
  r(conv_id, s, k, turn, ts, session_start, current_turn, resolved) AS (
    SELECT conv_id, s, k, turn, ts, session_start, (role = 'user')::INT, CASE WHEN role = 'user' THEN 1 >= 3 ELSE coalesce(told, false) END FROM n WHERE k = 1
    UNION ALL SELECT n.conv_id, n.s, n.k, n.turn, n.ts, n.session_start, r.current_turn + (n.role = 'user' AND NOT r.resolved)::INT,
      CASE WHEN n.role = 'user' AND NOT r.resolved THEN r.current_turn + 1 >= 3 WHEN n.role = 'assistant' THEN coalesce(n.told, r.resolved) ELSE r.resolved END
    FROM r JOIN n ON n.conv_id = r.conv_id AND n.s = r.s AND n.k = r.k + 1)"""


def _turns(spark, folder):
    """Events as the messages of one conversation per user."""
    kind, event = F.col("event_type"), F.col("event_id")
    return J.events_stream(spark, folder, "events").select(
        F.col("user_id").alias("conv_id"), event.alias("turn"), "ts",
        F.when(kind == "error", "assistant").when(kind == "signup", "system").otherwise("user").alias("role"),
        F.when(event % 3 < 2, event % 3 == 0).alias("told"),
    )


@query(
    "stream_session_turns",
    f"WITH RECURSIVE {SESSION_TURNS_SQL} SELECT conv_id, turn, session_start, k::INT AS turn_number, current_turn, resolved, greatest(0, 3 - current_turn) AS remaining FROM r",
)
def stream_session_turns(spark, folder):
    """Turn and wizard state per session; a day's pause starts a new one."""
    states = J.drain(J.session_turns(_turns(spark, folder), clear=F.col("told")), stateful_python=True)
    return states.withColumn("session_start", F.col("session_start").cast("timestamp_ntz")).drop("ts")


@query(
    "stream_ended_sessions",
    f"""WITH RECURSIVE {SESSION_TURNS_SQL} SELECT conv_id, session_start, max(ts) AS last_activity, count(*)::INT AS messages,
    arg_max(current_turn, k) AS current_turn, arg_max(resolved, k) AS resolved FROM r GROUP BY conv_id, s, session_start""",
)
def stream_ended_sessions(spark, folder):
    """Sessions as timers end them after a day without a message."""
    ended = J.drain(J.ended_sessions(_turns(spark, folder), clear=F.col("told")), stateful_python=True)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return ended.select("conv_id", ntz("session_start"), ntz("last_activity"), "messages", "current_turn", "resolved")


@query(
    "stream_upserts",
    """SELECT user_id AS prompt_id, event_id, ts AS measured_at, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def stream_upserts(spark, folder):
    """The last write of every prompt, put in over several batches that rewrite each other's rows."""
    root = f"{shared_folder(spark).rstrip('/')}/quillspark/upserts-{uuid.uuid4().hex}"
    note_written(root)
    rows = views.table(spark, folder, "events").select(
        F.col("user_id").alias("prompt_id"), "event_id", F.col("ts").alias("measured_at"), "event_type", "value"
    )
    # every user's events are spread over the files, so that every batch meets keys of the others
    rows.repartition(4, F.col("event_id")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    return J.keep_latest(stream, f"{root}/table", f"{root}/state", ["prompt_id"], ["measured_at", "event_id"], buckets=8)


def _arriving(df):
    """A table that was written as files, as the stream of those files."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/quillspark/arriving-{uuid.uuid4().hex}"
    note_written(path)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


@query(
    "stream_event_scores",
    over_scored(
        """SELECT id, round(quality, 6) AS quality, round(performance, 6) AS performance, round(impact, 6) AS impact, round(cost_usd, 6) AS cost_usd,
        total_tokens, round(overall, 6) AS overall, grade, acceptable FROM v_scored"""
    ),
)
def stream_event_scores(spark, folder):
    """Every score of an event as it arrives, the price of its model included."""
    scored = J.score_stream(_arriving(views.history_with_impact(spark, folder)))
    names = ["quality", "performance", "impact", "cost_usd", "overall"]
    return rounded(J.drain(scored.select("id", *names, "total_tokens", "grade", "acceptable")), *names)


@query("stream_event_gates", over_history("").rstrip() + f", {report_sql(False)} SELECT id, template_id, {', '.join(REPORT_COLUMNS)} FROM v_report")
def stream_event_gates(spark, folder):
    """The whole gate report of an output as it arrives."""
    outputs = _arriving(views.history(spark, folder).select("id", "template_id", "improved_prompt"))
    return J.drain(J.gate_stream(outputs, "improved_prompt", "template_id").select("id", "template_id", *REPORT_COLUMNS))
