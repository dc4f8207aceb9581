"""Scoring of prompt events: one wide row per event, stored metrics in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark import fixed
from quillspark.functions import scores as S
from quillspark.operators.ordered import literal_rows


def with_prices(df: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Adds ``rate_in`` and ``rate_out``: the model's, else the provider's default, else 0."""
    table = literal_rows(df.sparkSession, fixed.PRICES, ["_provider", "_model", "rate_in", "rate_out"])
    if prices is not None:
        table = prices.toDF("_provider", "_model", "rate_in", "rate_out")
    else:
        table = F.broadcast(table)  # fixed, one row per priced model
    default = table.filter(F.col("_model") == "default").select(
        F.col("_provider").alias("_dprovider"), F.col("rate_in").alias("_din"), F.col("rate_out").alias("_dout")
    )
    provider = F.lower("provider")
    return (
        df.join(table, (provider == F.col("_provider")) & (F.col("model") == F.col("_model")), "left")
        .join(default, provider == F.col("_dprovider"), "left")
        .withColumn("rate_in", F.coalesce("rate_in", "_din", F.lit(0.0)))
        .withColumn("rate_out", F.coalesce("rate_out", "_dout", F.lit(0.0)))
        .drop("_provider", "_model", "_dprovider", "_din", "_dout")
    )


def with_defaults(history: DataFrame) -> DataFrame:
    """History rows as the scorer wants them: absent latency, provider and backend filled in."""
    return (
        history.withColumn("latency_ms", F.coalesce("latency_ms", F.lit(0)))
        .withColumn("provider", F.coalesce("provider", "model", F.lit("unknown")))
        .withColumn("model", F.coalesce("model", F.lit("unknown")))
        .withColumn("backend", F.coalesce("backend", F.lit("zero-shot")))
        .withColumn("stored_framework", F.when(F.col("framework").isin(fixed.FRAMEWORKS), F.col("framework")).otherwise("chain-of-thought"))
    )


def with_quality(df: DataFrame) -> DataFrame:
    text = F.col("improved_prompt")
    count = F.coalesce(F.size("guardrails"), F.lit(0))
    return (
        df.withColumn("guardrails_count", count)
        .withColumn("coherence", S.coherence(text))
        .withColumn("relevance", S.relevance(F.col("original_idea"), text))
        .withColumn("completeness", S.completeness(text, F.col("framework"), F.col("guardrails_count")))
        .withColumn("clarity", S.clarity(text))
        .withColumn("has_structure", S.has_required_structure(text))
        .withColumn(
            "quality",
            S.composite_quality(
                F.col("coherence"), F.col("relevance"), F.col("completeness"), F.col("clarity"),
                F.col("guardrails_count"), F.col("has_structure"),
            ),
        )
    )


def with_performance(df: DataFrame) -> DataFrame:
    tokens_in, tokens_out = S.estimate_tokens(F.col("original_idea")), S.estimate_tokens(F.col("improved_prompt"))
    return (
        with_prices(df)
        .withColumn("total_tokens", tokens_in + tokens_out)
        .withColumn("cost_usd", S.cost_usd(tokens_in, tokens_out, F.col("rate_in"), F.col("rate_out")))
        .withColumn("performance", S.performance_score(F.col("latency_ms"), F.col("cost_usd"), F.col("total_tokens")))
        .drop("rate_in", "rate_out")
    )


def with_impact(df: DataFrame) -> DataFrame:
    """Needs ``copy_count``, ``regeneration_count``, ``reuse_count`` and ``feedback_score``."""
    return df.withColumn(
        "success_rate", S.success_rate(F.col("copy_count"), F.col("regeneration_count"))
    ).withColumn(
        "impact",
        S.impact_score(F.col("copy_count"), F.col("success_rate"), F.col("feedback_score"), F.col("reuse_count")),
    )


def no_impact(df: DataFrame) -> DataFrame:
    """Events nobody has reacted to yet."""
    for name in ("copy_count", "regeneration_count", "reuse_count"):
        df = df.withColumn(name, F.lit(0).cast("long"))
    return df.withColumn("feedback_score", F.lit(None).cast("int"))


def with_overall(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("overall", S.overall_score(F.col("quality"), F.col("performance"), F.col("impact")))
        .withColumn("grade", S.overall_grade(F.col("overall")))
        .withColumn("acceptable", S.is_acceptable(F.col("quality"), F.col("performance"), F.col("success_rate")))
    )


def score_events(history: DataFrame) -> DataFrame:
    """All scores of history rows; impact counts are taken from the rows or are zero."""
    ready = with_defaults(history)
    if "copy_count" not in history.columns:
        ready = no_impact(ready)
    return with_overall(with_impact(with_performance(with_quality(ready))))


def nested_metrics(df: DataFrame) -> DataFrame:
    """Scored rows as nested documents: quality, performance, impact and metadata structs."""
    c = F.col
    return df.select(
        c("id").alias("prompt_id"),
        c("original_idea"), c("improved_prompt"),
        c("overall").alias("overall_score"), c("grade"), c("acceptable").alias("is_acceptable"),
        F.struct(
            c("quality").alias("composite_score"), S.quality_grade(c("quality")).alias("grade"),
            c("coherence"), c("relevance"), c("completeness"), c("clarity"), c("guardrails_count"), c("has_structure"),
        ).alias("quality"),
        F.struct(
            c("performance").alias("performance_score"), S.performance_grade(c("performance")).alias("grade"),
            c("latency_ms"), c("total_tokens"), c("cost_usd"), c("provider"), c("model"), c("backend"),
        ).alias("performance"),
        F.struct(
            c("impact").alias("impact_score"), S.impact_grade(c("impact")).alias("grade"), c("success_rate"),
            c("copy_count"), c("regeneration_count"), c("feedback_score"), c("reuse_count"),
        ).alias("impact"),
        F.struct(
            c("created_at").alias("measured_at"), c("stored_framework").alias("framework"),
            c("provider"), c("model"), c("backend"),
        ).alias("metadata"),
    )


def rederive(df: DataFrame) -> DataFrame:
    """Scores of flat rows recomputed from their parts, as after decoding a stored document."""
    scored = df.withColumn(
        "quality",
        S.composite_quality(
            F.col("coherence"), F.col("relevance"), F.col("completeness"), F.col("clarity"),
            F.col("guardrails_count"), F.col("has_structure"),
        ),
    ).withColumn(
        "performance", S.performance_score(F.col("latency_ms"), F.col("cost_usd"), F.col("total_tokens"))
    )
    return with_overall(with_impact(scored))


def group_filter(expression: str) -> Column:
    """``field:value`` as a predicate over a known field."""
    field, colon, value = expression.partition(":")
    if not colon:
        raise ValueError(f"not of the form field:value: {expression!r}")
    if field not in fixed.FILTER_FIELDS:
        raise ValueError(f"unknown field {field!r}, expected one of {fixed.FILTER_FIELDS}")
    return F.col(field) == value
