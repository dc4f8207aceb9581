"""Queries over scored events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import fixed
from quillspark.functions import scores as S
from quillspark.operators import analyze as A, metrics as M
from quillspark.plans.common import (
    ladder_sql, over_history, over_quality, over_scored, query, rounded,
)
from quillspark.session import materialise
from quillspark.sources import views


def scored(spark, folder):
    return M.score_events(views.history_with_impact(spark, folder))


@query(
    "quality_by_grade",
    over_quality(
        f"""SELECT grade, count(*) AS n, round(avg(quality), 6) AS avg_quality FROM (
        SELECT *, {ladder_sql("quality", fixed.QUALITY_LADDER, "F")} AS grade FROM v_quality) GROUP BY grade"""
    ),
)
def quality_by_grade(spark, folder):
    graded = M.with_quality(views.history(spark, folder)).withColumn("grade", S.quality_grade(F.col("quality")))
    return rounded(graded.groupBy("grade").agg(F.count("*").alias("n"), F.avg("quality").alias("avg_quality")), "avg_quality")


@query(
    "quality_scores",
    over_quality(
        "SELECT id, round(coherence, 6) AS coherence, round(relevance, 6) AS relevance, round(completeness, 6) AS completeness, "
        "round(clarity, 6) AS clarity, guardrails_count, has_structure, round(quality, 6) AS quality FROM v_quality"
    ),
)
def quality_scores(spark, folder):
    names = ["coherence", "relevance", "completeness", "clarity", "quality"]
    df = M.with_quality(views.history(spark, folder))
    return rounded(df.select("id", "guardrails_count", "has_structure", *names), *names)


@query(
    "performance_scores",
    over_scored(
        f"""SELECT id, latency_ms, total_tokens, round(cost_usd, 9) AS cost_usd, round(performance, 6) AS performance,
        {ladder_sql("performance", fixed.EFFORT_LADDER, "F")} AS performance_grade FROM v_scored"""
    ),
)
def performance_scores(spark, folder):
    df = M.with_performance(M.with_defaults(views.history_with_impact(spark, folder)))
    df = df.select(
        "id", "latency_ms", "total_tokens", F.round("cost_usd", 9).alias("cost_usd"), "performance",
        S.performance_grade(F.col("performance")).alias("performance_grade"),
    )
    return rounded(df, "performance")


@query(
    "impact_scores",
    f"""SELECT user_id, round(success_rate, 6) AS success_rate, round(impact, 6) AS impact,
    {ladder_sql("impact", fixed.EFFORT_LADDER, "F")} AS impact_grade FROM (
    SELECT *, least(1e0, c / 3e0) * 0.3e0 + success_rate * 0.3e0 + (coalesce(f, 3) / 5e0) * 0.25e0
      + least(1e0, v / 2e0) * 0.15e0 AS impact FROM (
    SELECT *, CASE WHEN c + r > 0 THEN c::DOUBLE / (c + r) ELSE 0e0 END AS success_rate FROM (
    SELECT user_id, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS r,
      count(*) FILTER (event_type = 'view') AS v, CASE WHEN user_id % 7 <> 0 THEN 1 + user_id % 5 END AS f
    FROM events GROUP BY user_id)))""",
)
def impact_scores(spark, folder):
    df = M.with_impact(views.impact(spark, folder)).select(
        "user_id", "success_rate", "impact", S.impact_grade(F.col("impact")).alias("impact_grade")
    )
    return rounded(df, "success_rate", "impact")


@query(
    "overall_grades",
    over_scored(
        "SELECT id, framework, provider, round(overall, 6) AS overall, grade, acceptable FROM v_scored"
    ),
)
def overall_grades(spark, folder):
    return rounded(scored(spark, folder).select("id", "framework", "provider", "overall", "grade", "acceptable"), "overall")


@query(
    "nested_metrics",
    over_scored(
        "SELECT id AS prompt_id, round(quality, 6) AS composite_score, total_tokens, copy_count, feedback_score::DOUBLE AS feedback_score, "
        "framework, grade, acceptable AS is_acceptable FROM v_scored"
    ),
)
def nested_metrics(spark, folder):
    df = M.nested_metrics(scored(spark, folder))
    return df.select(
        "prompt_id", F.round("quality.composite_score", 6).alias("composite_score"), "performance.total_tokens",
        "impact.copy_count", F.col("impact.feedback_score").cast("double").alias("feedback_score"), "metadata.framework", "grade", "is_acceptable",
    )


@query(
    "cost_by_model",
    over_scored(
        "SELECT provider, model, count(*) AS n, sum(total_tokens)::BIGINT AS total_tokens, round(sum(cost_usd), 6) AS cost_usd "
        "FROM v_scored GROUP BY provider, model"
    ),
)
def cost_by_model(spark, folder):
    df = M.with_performance(M.with_defaults(views.history_with_impact(spark, folder)))
    return rounded(
        df.groupBy("provider", "model").agg(
            F.count("*").alias("n"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost_usd").alias("cost_usd")
        ),
        "cost_usd",
    )


def _registry_sql() -> str:
    rows = []
    for metric, column in (("quality.coherence", "coherence"), ("performance", "performance"), ("impact.success_rate", "success_rate"), ("overall", "overall")):
        low, target, best = fixed.METRIC_LIMITS[metric.split(".")[0]]
        rows.append(
            f"""SELECT id, '{metric}' AS metric, CASE WHEN {column} >= {best}e0 THEN 'A+' WHEN {column} >= {target}e0 THEN 'A'
            WHEN {column} >= {low}e0 THEN 'C' ELSE 'F' END AS grade, {column} >= {low}e0 AS acceptable FROM v_scored"""
        )
    return " UNION ALL ".join(rows)


@query("registry_grades", over_scored(f"SELECT metric, grade, acceptable, count(*) AS n FROM ({_registry_sql()}) GROUP BY ALL"))
def registry_grades(spark, folder):
    pairs = {"quality.coherence": "coherence", "performance": "performance", "impact.success_rate": "success_rate", "overall": "overall"}
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in pairs.items()])
    long = scored(spark, folder).select(F.inline(items))
    return long.groupBy(
        "metric", S.registry_grade(F.col("metric"), F.col("value")).alias("grade"),
        S.registry_acceptable(F.col("metric"), F.col("value")).alias("acceptable"),
    ).agg(F.count("*").alias("n"))


@query(
    "history_stats",
    over_history(
        "SELECT count(*) AS total_count, round(avg(confidence), 6) AS average_confidence, round(avg(latency_ms), 6) AS average_latency_ms FROM v_history"
    ),
)
def history_stats(spark, folder):
    return rounded(A.history_statistics(views.history(spark, folder)), "average_confidence", "average_latency_ms")


@query("history_backends", over_history("SELECT backend, count(*) AS n FROM v_history GROUP BY backend"))
def history_backends(spark, folder):
    return A.count_by(views.history(spark, folder), "backend")


@query(
    "history_quality",
    over_history(
        """SELECT id, round(greatest(0e0, least(1e0, CASE WHEN confidence = 0 THEN 0.5e0 ELSE confidence END
        - least(latency_ms / 10000e0, 0.3e0))), 6) AS history_quality FROM v_history"""
    ),
)
def history_quality(spark, folder):
    df = views.history(spark, folder).select(
        "id", S.history_quality(F.col("confidence"), F.col("latency_ms")).alias("history_quality")
    )
    return rounded(df, "history_quality")


@query(
    "metrics_summary",
    over_scored(
        "SELECT count(*) AS total_prompts, round(avg(quality), 6) AS average_quality, "
        "round(avg(performance), 6) AS average_performance, round(avg(impact), 6) AS average_impact FROM v_scored"
    ),
)
def metrics_summary(spark, folder):
    return rounded(A.metric_averages(scored(spark, folder)), "average_quality", "average_performance", "average_impact")


@query("grade_distribution", over_scored("SELECT grade, count(*) AS n FROM v_scored GROUP BY grade"))
def grade_distribution(spark, folder):
    return A.count_by(scored(spark, folder), "grade")


LONG_SQL = (
    "SELECT id, created_at, provider, unnest(['quality','performance','impact','overall']) AS metric, "
    "unnest([quality, performance, impact, overall]) AS value FROM v_scored"
)


@query(
    "metrics_summarize",
    over_scored(
        f"""SELECT metric, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
        round(coalesce(stddev_samp(value), 0), 6) AS std_dev, round(min(value), 6) AS min_value,
        round(max(value), 6) AS max_value, min(created_at) AS start_at, max(created_at) AS end_at FROM ({LONG_SQL}) GROUP BY metric"""
    ),
)
def metrics_summarize(spark, folder):
    return rounded(A.summarize(scored(spark, folder)), "mean", "median", "std_dev", "min_value", "max_value")


@query(
    "metrics_summarize_by_provider",
    over_scored(
        f"""SELECT provider, metric, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
        round(coalesce(stddev_samp(value), 0), 6) AS std_dev, round(min(value), 6) AS min_value,
        round(max(value), 6) AS max_value, min(created_at) AS start_at, max(created_at) AS end_at FROM ({LONG_SQL}) GROUP BY provider, metric"""
    ),
)
def metrics_summarize_by_provider(spark, folder):
    return rounded(
        A.summarize(scored(spark, folder), ["provider"]), "mean", "median", "std_dev", "min_value", "max_value"
    )


@query(
    "metrics_summarize_range",
    over_scored(
        f"""SELECT metric, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS std_dev,
        round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, min(created_at) AS start_at, max(created_at) AS end_at
        FROM ({LONG_SQL}) WHERE created_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-06' GROUP BY metric"""
    ),
)
def metrics_summarize_range(spark, folder):
    day = lambda text: F.lit(text).cast("timestamp")
    found = A.summarize(scored(spark, folder), since=day("2024-01-02"), until=day("2024-01-06"))
    return rounded(found, "mean", "median", "std_dev", "min_value", "max_value")


SLOPE_SQL = f"""
v_long AS ({LONG_SQL}),
v_newest AS (SELECT * FROM v_long WHERE id IN (SELECT id FROM v_scored ORDER BY created_at DESC, id DESC LIMIT 10)),
v_slope AS (
  SELECT metric, CASE WHEN count(*) < 3 THEN 0e0 ELSE
    (arg_max(value, (created_at, id)) - arg_min(value, (created_at, id))) / (count(*) - 1) END AS change_rate
  FROM v_newest GROUP BY metric)"""
TREND_SQL = "CASE WHEN change_rate > 0.01e0 THEN 'improving' WHEN change_rate < -0.01e0 THEN 'declining' ELSE 'stable' END"


def over_trend(select: str) -> str:
    return over_scored("").rstrip() + f", {SLOPE_SQL} {select}"


@query(
    "trend_summary",
    over_trend(
        f"""SELECT l.metric, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
        round(coalesce(stddev_samp(value), 0), 6) AS std_dev, round(min(value), 6) AS min_value,
        round(max(value), 6) AS max_value, min(created_at) AS start_at, max(created_at) AS end_at, round(any_value(change_rate), 6) AS change_rate, any_value({TREND_SQL}) AS trend
        FROM v_long l JOIN v_slope s ON l.metric = s.metric GROUP BY l.metric"""
    ),
)
def trend_summary(spark, folder):
    return rounded(
        A.trend_summary(scored(spark, folder)),
        "mean", "median", "std_dev", "min_value", "max_value", "change_rate",
    )


def _advice_sql() -> str:
    q = lambda t: "'" + t.replace("'", "''") + "'"
    rule = lambda m, d, low, f: (
        f"CASE WHEN max(CASE WHEN metric='{m}' THEN trend END) = 'declining' THEN {q(d)} "
        f"WHEN max(CASE WHEN metric='{m}' THEN mean END) < {f}e0 THEN {q(low)} END"
    )
    items = [
        rule("quality", fixed.QUALITY_DECLINING, fixed.QUALITY_LOW, 0.7),
        rule("performance", fixed.PERFORMANCE_DECLINING, fixed.PERFORMANCE_LOW, 0.5),
        rule("impact", fixed.IMPACT_DECLINING, fixed.IMPACT_LOW, 0.5),
        f"CASE WHEN max(CASE WHEN metric='overall' THEN trend END) = 'improving' AND max(CASE WHEN metric='overall' THEN change_rate END) > 0.05e0 THEN {q(fixed.STRONG_IMPROVEMENT)} END",
    ]
    return (
        f"SELECT array_to_string(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL), ' | ') AS recommendations FROM ("
        f"SELECT l.metric, avg(value) AS mean, any_value(change_rate) AS change_rate, any_value({TREND_SQL}) AS trend "
        "FROM v_long l JOIN v_slope s ON l.metric = s.metric GROUP BY l.metric)"
    )


@query("trend_recommendations", over_trend(_advice_sql()))
def trend_recommendations(spark, folder):
    events = materialise(scored(spark, folder).select("id", "created_at", *A.METRICS))
    means = A.unpivot_metrics(events).groupBy("metric").agg(F.avg("value").alias("mean"))
    return A.recommendations(means.join(A.endpoint_slopes(events), "metric")).select(
        F.array_join("recommendations", " | ").alias("recommendations")
    )


@query(
    "period_trend",
    over_scored(
        f"""SELECT metric, n AS metrics_count, {TREND_SQL} AS trend, round_even(change_rate, 3) AS change FROM (
        SELECT metric, (SELECT count(*) FROM v_scored WHERE created_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05') AS n,
          (arg_max(value, (created_at, id)) - arg_min(value, (created_at, id))) / (count(*) - 1) AS change_rate
        FROM ({LONG_SQL}) WHERE metric <> 'overall' AND id IN (SELECT id FROM v_scored
          WHERE created_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05' ORDER BY created_at DESC, id DESC LIMIT 10)
        GROUP BY metric)"""
    ),
)
def period_trend(spark, folder):
    return A.period_trend(scored(spark, folder), F.lit("2024-01-05 00:00:00").cast("timestamp"), days=2)


@query(
    "trend_outliers",
    over_scored(
        """SELECT "index", id, round(overall, 6) AS overall, CASE WHEN overall > m THEN 'high' ELSE 'low' END AS direction FROM (
        SELECT id, overall, row_number() OVER (ORDER BY created_at, id) - 1 AS "index", avg(overall) OVER () AS m,
          stddev_samp(overall) OVER () AS s, count(*) OVER () AS n FROM v_scored)
        WHERE n >= 10 AND abs(overall - m) > 2 * s"""
    ),
)
def trend_outliers(spark, folder):
    return rounded(A.outliers(scored(spark, folder)), "overall")


@query(
    "trend_drops",
    over_scored(
        """SELECT "index", id, round(previous, 6) AS previous, round(overall, 6) AS overall, round(previous - overall, 6) AS "drop" FROM (
        SELECT id, overall, row_number() OVER (ORDER BY created_at, id) - 1 AS "index",
          lag(overall) OVER (ORDER BY created_at, id) AS previous, count(*) OVER () AS n FROM v_scored)
        WHERE n >= 10 AND previous - overall > 0.2e0"""
    ),
)
def trend_drops(spark, folder):
    return rounded(A.sudden_drops(scored(spark, folder)), "previous", "overall", "drop")


def _ab_sql() -> str:
    sides = ", ".join(
        f"count(*) FILTER ({cond}) AS {s}_n, avg(quality) FILTER ({cond}) AS {s}_quality, "
        f"avg(performance) FILTER ({cond}) AS {s}_performance, avg(impact) FILTER ({cond}) AS {s}_impact"
        for s, cond in (("a", "model = 'deepseek-chat'"), ("b", "backend = 'few-shot'"))
    )
    names = [f"{s}_{m}" for s in "ab" for m in ("quality", "performance", "impact", "overall")]
    deltas = ", ".join(
        f"round(b_{m} - a_{m}, 6) AS {m}_delta, round((b_{m} - a_{m}) / a_{m} * 100, 6) AS {m}_percent"
        for m in ("quality", "performance", "impact", "overall")
    )
    return f"""SELECT a_n, b_n, {", ".join(f"round({n}, 6) AS {n}" for n in names)}, {deltas},
      CASE WHEN b_overall > a_overall + 0.05e0 THEN 'group_b' WHEN a_overall > b_overall + 0.05e0 THEN 'group_a' ELSE 'inconclusive' END AS winner,
      a_quality > 0 AND a_performance > 0 AND a_impact > 0 AS metrics_valid
    FROM (SELECT *, a_quality * 0.5e0 + a_performance * 0.25e0 + a_impact * 0.25e0 AS a_overall,
      b_quality * 0.5e0 + b_performance * 0.25e0 + b_impact * 0.25e0 AS b_overall FROM (SELECT {sides} FROM v_scored))"""


@query("ab_means", over_scored(_ab_sql()))
def ab_means(spark, folder):
    df = A.ab_means(
        scored(spark, folder), M.group_filter("model:deepseek-chat"), M.group_filter("backend:few-shot")
    )
    return rounded(df, *[n for n, t in df.dtypes if t == "double"])


WELCH_SQL = f"""
v_welch AS (
  SELECT metric, b_n, t_n, b_mean AS baseline_value, t_mean AS current_value, t_mean - b_mean AS delta,
    CASE WHEN b_mean <> 0 THEN (t_mean - b_mean) / b_mean * 100 ELSE 0 END AS delta_percent,
    t_mean - b_mean > 0 AS is_improvement, se > 0 AND abs(t_mean - b_mean) / se > 2 AS is_significant
  FROM (SELECT *, sqrt(b_sd * b_sd / b_n + t_sd * t_sd / t_n) AS se FROM (
    SELECT metric, count(value) FILTER (arm = 'b') AS b_n, count(value) FILTER (arm = 't') AS t_n,
      avg(value) FILTER (arm = 'b') AS b_mean, avg(value) FILTER (arm = 't') AS t_mean,
      stddev_samp(value) FILTER (arm = 'b') AS b_sd, stddev_samp(value) FILTER (arm = 't') AS t_sd
    FROM (SELECT *, CASE WHEN provider = 'anthropic' THEN 'b' ELSE 't' END AS arm FROM ({LONG_SQL})) GROUP BY metric))
  WHERE b_n >= 5 AND t_n >= 5)"""


def over_welch(select: str) -> str:
    return over_scored("").rstrip() + f", {WELCH_SQL} {select}"


def _arm():
    return F.when(F.col("provider") == "anthropic", "baseline").otherwise("treatment")


@query(
    "ab_welch",
    over_welch(
        "SELECT metric, b_n, t_n, round(baseline_value, 6) AS baseline_value, round(current_value, 6) AS current_value, "
        "round(delta, 6) AS delta, round(delta_percent, 6) AS delta_percent, is_improvement, is_significant FROM v_welch"
    ),
)
def ab_welch(spark, folder):
    return rounded(
        A.welch(scored(spark, folder), _arm()), "baseline_value", "current_value", "delta", "delta_percent"
    )


@query(
    "ab_winner",
    over_welch(
        """SELECT score, CASE WHEN score > 0.3 THEN 'treatment' WHEN score < -0.3 THEN 'baseline' ELSE 'inconclusive' END AS winner
        FROM (SELECT round(sum(CASE WHEN is_significant THEN (CASE WHEN is_improvement THEN 1 ELSE -1 END)
          * (CASE metric WHEN 'overall' THEN 1e0 WHEN 'quality' THEN 0.4e0 ELSE 0.3e0 END) ELSE 0e0 END), 6) AS score FROM v_welch)"""
    ),
)
def ab_winner(spark, folder):
    return A.winner(A.welch(scored(spark, folder), _arm()))


def _version_sql() -> str:
    soft = lambda m: f"CASE WHEN d_{m} > 0 THEN d_{m} ELSE d_{m} * 0.5e0 END"
    label = "CASE " + " ".join(f"WHEN score > {least}e0 THEN '{t}'" for least, t in fixed.IMPROVEMENT_LABELS)
    return f"""SELECT version, round(d_quality, 6) AS quality_delta, round(d_performance, 6) AS performance_delta,
      round(d_impact, 6) AS impact_delta, round(score, 6) AS improvement_score, {label} ELSE '{fixed.IMPROVEMENT_WORST}' END AS trend
    FROM (SELECT *, ({soft("quality")}) * 0.4e0 + ({soft("performance")}) * 0.3e0 + ({soft("impact")}) * 0.3e0 AS score FROM (
      SELECT version, q - arg_min(q, version) OVER () AS d_quality, p - arg_min(p, version) OVER () AS d_performance,
        i - arg_min(i, version) OVER () AS d_impact FROM (
        SELECT model AS version, avg(quality) AS q, avg(performance) AS p, avg(impact) AS i FROM v_scored GROUP BY model)))"""


@query("version_delta", over_scored(_version_sql()))
def version_delta(spark, folder):
    df = A.version_improvement(A.versions_against_first(scored(spark, folder), "model"))
    return rounded(df, "quality_delta", "performance_delta", "impact_delta", "improvement_score")
