"""Averages, trends, outliers and comparisons over scored events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark import fixed
from quillspark.operators.ordered import exact_quantiles, neighbour, with_position
from quillspark.session import materialise

METRICS = ["quality", "performance", "impact", "overall"]


def history_statistics(history: DataFrame) -> DataFrame:
    """Row count and means; an empty history gives zeros."""
    return history.agg(
        F.count("*").alias("total_count"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("average_latency_ms"),
    )


def count_by(df: DataFrame, *names: str) -> DataFrame:
    return df.groupBy(*names).agg(F.count("*").alias("n"))


def metric_averages(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("total_prompts"),
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"average_{m}") for m in METRICS[:3]],
    )


def unpivot_metrics(scored: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per event and metric."""
    return scored.unpivot(list(keep), METRICS, "metric", "value")


def summarize(
    scored: DataFrame, keys: Sequence[str] = (), since: Column | None = None, until: Column | None = None
) -> DataFrame:
    """Count, mean, exact median, sample deviation, range and time span of every metric.

    ``since`` and ``until`` bound the time of the events, both included.
    """
    if since is not None:
        scored = scored.filter(F.col("created_at") >= since)
    if until is not None:
        scored = scored.filter(F.col("created_at") <= until)
    # scores come from regular expressions over whole texts; they are computed once, not per pass
    return _summary(materialise(scored.select(*keys, "created_at", *METRICS)), keys)


def _summary(slim: DataFrame, keys: Sequence[str]) -> DataFrame:
    long = unpivot_metrics(slim, [*keys, "created_at"])
    by = [*keys, "metric"]
    moments = long.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std_dev"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.min("created_at").alias("start_at"), F.max("created_at").alias("end_at"),
    )
    return moments.join(exact_quantiles(long, by, "value", {"median": ("median", 0.5)}), by)


def endpoint_slopes(scored: DataFrame, points: int = 10, time: str = "created_at", tie: str = "id") -> DataFrame:
    """Per metric the change per step over the last few events, oldest to newest, and its direction.

    Only the newest ``points`` rows leave the scan; the sort keeps that many per task.
    """
    newest = scored.select(time, tie, *METRICS).orderBy(F.desc(time), F.desc(tie)).limit(points)
    ends = newest.unpivot([time, tie], METRICS, "metric", "value").groupBy("metric").agg(
        F.count("*").alias("_m"),
        F.max_by("value", F.struct(time, tie)).alias("_last"),
        F.min_by("value", F.struct(time, tie)).alias("_first"),
    )
    rate = F.when(F.col("_m") < 3, 0.0).otherwise((F.col("_last") - F.col("_first")) / (F.col("_m") - 1))
    return ends.select("metric", rate.alias("change_rate"), direction(rate).alias("trend"))


def direction(rate: Column) -> Column:
    return F.when(rate > 0.01, "improving").when(rate < -0.01, "declining").otherwise("stable")


def trend_summary(scored: DataFrame) -> DataFrame:
    """Statistics, sample size, time span and direction of every metric."""
    slim = materialise(scored.select("id", "created_at", *METRICS))
    return _summary(slim.drop("id"), ()).join(endpoint_slopes(slim), "metric")


def recommendations(trends: DataFrame) -> DataFrame:
    """Advice from the trend rows of all metrics, as one row."""

    def of(metric: str, column: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col(column)))

    wide = trends.groupBy().agg(
        *[of(m, c).alias(f"{m}_{c}") for m in METRICS for c in ("trend", "mean", "change_rate")]
    )

    def advice(metric: str, declining: str, low: str, floor: float) -> Column:
        return F.when(F.col(f"{metric}_trend") == "declining", declining).when(
            F.col(f"{metric}_mean") < floor, low
        )

    strong = (F.col("overall_trend") == "improving") & (F.col("overall_change_rate") > 0.05)
    return wide.select(
        F.array_compact(
            F.array(
                advice("quality", fixed.QUALITY_DECLINING, fixed.QUALITY_LOW, 0.70),
                advice("performance", fixed.PERFORMANCE_DECLINING, fixed.PERFORMANCE_LOW, 0.50),
                advice("impact", fixed.IMPACT_DECLINING, fixed.IMPACT_LOW, 0.50),
                F.when(strong, fixed.STRONG_IMPROVEMENT),
            )
        ).alias("recommendations")
    )


def period_trend(scored: DataFrame, as_of: Column, days: int = 7, digits: int = 3) -> DataFrame:
    """Direction and slope over the last days; fewer than two events are not enough."""
    if not 1 <= days <= 90:
        raise ValueError("days must be in 1..90")
    inside = F.col("created_at").between(as_of - F.make_dt_interval(F.lit(days)), as_of)
    recent = materialise(scored.filter(inside).select("id", "created_at", *METRICS))
    size = recent.agg(F.count("*").alias("n"))
    enough = size.select("n").scalar() >= 2
    # every metric is present even for an empty period
    metrics = scored.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in METRICS[:3]])).alias("metric"))
    return metrics.join(endpoint_slopes(recent), "metric", "left").select(
        "metric", size.select("n").scalar().alias("metrics_count"),
        F.when(enough, F.col("trend")).otherwise("insufficient_data").alias("trend"),
        F.when(enough, F.bround("change_rate", digits)).alias("change"),
    )


def timeline(scored: DataFrame) -> DataFrame:
    """Overall score with the place of every event in time; ``scored`` is a materialised table."""
    return with_position(scored, [F.col("created_at"), F.col("id")], "pos", "bucket")


def outliers(scored: DataFrame) -> DataFrame:
    """Events over two sample deviations from the mean, if there are ten events or more."""
    scored = materialise(scored.select("id", "created_at", "overall"))
    stats = scored.agg(
        F.avg("overall").alias("mean"), F.stddev_samp("overall").alias("sd"), F.count("*").alias("n")
    )
    mean, sd, n = (stats.select(c).scalar() for c in ("mean", "sd", "n"))
    return (
        timeline(scored)
        .filter((n >= 10) & (F.abs(F.col("overall") - mean) > 2 * sd))
        .select(
            F.col("pos").alias("index"), "id", "overall",
            F.when(F.col("overall") > mean, "high").otherwise("low").alias("direction"),
        )
    )


def sudden_drops(scored: DataFrame, least: float = 0.20) -> DataFrame:
    """Events that score lower than the one before by more than ``least``."""
    scored = materialise(scored.select("id", "created_at", "overall"))
    n = scored.agg(F.count("*").alias("n")).select("n").scalar()
    paired = neighbour(timeline(scored), [], ["pos"], ["overall"], "bucket", "_prev", ahead=False)
    drop = F.col("_prev.overall") - F.col("overall")
    return paired.filter((n >= 10) & (drop > least)).select(
        F.col("pos").alias("index"), "id", F.col("_prev.overall").alias("previous"), "overall", drop.alias("drop")
    )


def ab_means(scored: DataFrame, a: Column, b: Column) -> DataFrame:
    """Two groups, which may share rows, compared in one pass over the table."""
    aggs = []
    for side, member in (("a", a), ("b", b)):
        aggs.append(F.count_if(member).alias(f"{side}_n"))
        aggs += [F.avg(F.when(member, F.col(m))).alias(f"{side}_{m}") for m in METRICS[:3]]
    wide = scored.agg(*aggs)
    c = F.col
    for side in "ab":
        wide = wide.withColumn(
            f"{side}_overall", c(f"{side}_quality") * 0.5 + c(f"{side}_performance") * 0.25 + c(f"{side}_impact") * 0.25
        )
    for m in METRICS:
        wide = wide.withColumn(f"{m}_delta", c(f"b_{m}") - c(f"a_{m}"))
        wide = wide.withColumn(f"{m}_percent", F.try_divide(c(f"{m}_delta"), c(f"a_{m}")) * 100)
    winner = (
        F.when(c("b_overall") > c("a_overall") + 0.05, "group_b")
        .when(c("a_overall") > c("b_overall") + 0.05, "group_a")
        .otherwise("inconclusive")
    )
    valid = (c("a_quality") > 0) & (c("a_performance") > 0) & (c("a_impact") > 0)
    return wide.withColumn("winner", winner).withColumn("metrics_valid", valid)


def welch(scored: DataFrame, arm: Column, least: int = 5) -> DataFrame:
    """Per metric: both means, their difference and whether it is significant.

    ``arm`` is ``baseline`` or ``treatment``; other rows are left out. Arms smaller than ``least``
    give no rows.
    """
    long = unpivot_metrics(scored.withColumn("_arm", arm), ["_arm"])

    def stat(fn, name: str) -> list[Column]:
        return [
            fn(F.when(F.col("_arm") == a, F.col("value"))).alias(f"{p}_{name}")
            for a, p in (("baseline", "b"), ("treatment", "t"))
        ]

    stats = long.groupBy("metric").agg(
        *stat(F.count, "n"), *stat(F.avg, "mean"), *stat(F.stddev_samp, "sd")
    ).filter((F.col("b_n") >= least) & (F.col("t_n") >= least))
    c = F.col
    error = F.sqrt(c("b_sd") * c("b_sd") / c("b_n") + c("t_sd") * c("t_sd") / c("t_n"))
    delta = c("t_mean") - c("b_mean")
    significant = (c("b_n") >= 3) & (c("t_n") >= 3) & (error > 0) & (F.try_divide(F.abs(delta), error) > 2.0)
    return stats.select(
        "metric", "b_n", "t_n",
        c("b_mean").alias("baseline_value"), c("t_mean").alias("current_value"), delta.alias("delta"),
        F.coalesce(F.try_divide(delta, c("b_mean")) * 100, F.lit(0.0)).alias("delta_percent"),
        (delta > 0).alias("is_improvement"), F.coalesce(significant, F.lit(False)).alias("is_significant"),
    )


def winner(comparison: DataFrame) -> DataFrame:
    """Vote of the significant metrics."""
    weight = (
        F.when(F.col("metric") == "overall", 1.0).when(F.col("metric") == "quality", 0.4).otherwise(0.3)
    )
    vote = F.when(F.col("is_significant"), F.when(F.col("is_improvement"), weight).otherwise(-weight)).otherwise(0.0)
    # votes are few decimals; rounding removes what floating addition leaves behind
    total = comparison.agg(F.round(F.sum(vote), 6).alias("score"))
    return total.select(
        "score",
        F.when(F.col("score") > 0.3, "treatment").when(F.col("score") < -0.3, "baseline").otherwise("inconclusive").alias("winner"),
    )


def version_improvement(versions: DataFrame) -> DataFrame:
    """Each version against its baseline; losses count half."""
    c = F.col
    softened = lambda d: F.when(d > 0, d).otherwise(d * 0.5)
    deltas = {m: c(f"current_{m}") - c(f"baseline_{m}") for m in METRICS[:3]}
    score = (
        softened(deltas["quality"]) * 0.40 + softened(deltas["performance"]) * 0.30 + softened(deltas["impact"]) * 0.30
    )
    label = None
    for least, text in fixed.IMPROVEMENT_LABELS:
        label = F.when(score > least, text) if label is None else label.when(score > least, text)
    return versions.select(
        "version", *[d.alias(f"{m}_delta") for m, d in deltas.items()], score.alias("improvement_score"),
        label.otherwise(fixed.IMPROVEMENT_WORST).alias("trend"),
    )


def versions_against_first(scored: DataFrame, version: str) -> DataFrame:
    """Mean scores per version next to those of the first version."""
    means = scored.groupBy(F.col(version).alias("version")).agg(*[F.avg(m).alias(f"current_{m}") for m in METRICS[:3]])
    first = means.agg(
        *[F.min_by(f"current_{m}", "version").alias(f"baseline_{m}") for m in METRICS[:3]]
    )
    return means.select(
        "*", *[first.select(f"baseline_{m}").scalar().alias(f"baseline_{m}") for m in METRICS[:3]]
    )


def calibration(scores: DataFrame, score: str = "score") -> DataFrame:
    """Distribution of constraint scores and the pass threshold it suggests."""
    scores = materialise(scores.select(score))
    basics = scores.agg(
        F.count("*").alias("n"), F.min(score).alias("min_score"), F.max(score).alias("max_score"),
        F.avg(score).alias("mean_score"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std_dev"),
        *[
            F.count_if(F.abs(F.col(score) - k / 3) < 1e-9).alias(f"bucket_{k}_of_3")
            for k in range(4)
        ],
    )
    ranks = exact_quantiles(scores, [], score, {"median_score": ("median", 0.5), "p60": ("floor", 0.6)})
    threshold = (
        F.when(F.col("p60") >= 0.67, 0.67)
        .when(F.col("median_score") >= 0.5, F.bround("median_score", 2))
        .otherwise(0.5)
    )
    cut = ranks.select(threshold.alias("threshold"))
    passed = scores.filter(F.col(score) >= cut.scalar()).agg(F.count("*").alias("k"))
    return basics.select(
        "*",
        *[ranks.select(c).scalar().alias(c) for c in ("median_score", "p60")],
        cut.scalar().alias("threshold"), passed.scalar().alias("pass_count"),
    ).withColumn("pass_rate", F.try_divide("pass_count", "n"))
