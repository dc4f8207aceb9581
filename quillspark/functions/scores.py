"""Quality, performance and impact scores of one prompt event, and their grades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from quillspark import fixed
from quillspark.functions.text import (
    WORD_CLASS, all_matches, clamp01, contains_any, matches_any, repeat_subtract, rx,
)


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def cost_usd(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    return (tokens_in / 1000) * rate_in + (tokens_out / 1000) * rate_out


def bonus(condition: Column, amount: float) -> Column:
    return F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))


def coherence(text: Column) -> Column:
    """Headers, paragraphs and lists raise the score; very short or unbroken text lowers it."""
    score = (
        F.lit(0.5)
        + bonus(text.rlike(rx(r"^#+\s*\w+", "m")), 0.15)
        + bonus(F.contains(text, F.lit("\n\n")), 0.10)
        + bonus(text.rlike(rx(fixed.BULLET_LINE, "m")), 0.10)
        + bonus(text.rlike(rx(fixed.STEP_LINE, "m")), 0.10)
        - bonus(F.length(text) < 100, 0.20)
        - bonus((F.length(text) > 500) & ~F.contains(F.substring(text, 1, 200), F.lit("\n")), 0.15)
    )
    return clamp01(score)


def relevance(idea: Column, output: Column) -> Column:
    """Share of the idea's longer words that recur in the output, plus a shared-verb bonus."""
    low_idea, low_out = F.lower(idea), F.lower(output)
    terms = F.array_distinct(all_matches(low_idea, f"[{WORD_CLASS}]{{3,}}"))
    found = F.size(F.filter(terms, lambda t: F.contains(low_out, t)))
    shared_verb = contains_any(low_idea, fixed.SCORE_VERBS) & contains_any(low_out, fixed.SCORE_VERBS)
    return F.when(F.size(terms) == 0, F.lit(0.5)).otherwise(
        F.least(F.lit(1.0), found / F.size(terms) + bonus(shared_verb, 0.10))
    )


def has_role(text: Column) -> Column:
    return matches_any(text, fixed.ROLE_MARKS)


def has_directive(text: Column) -> Column:
    return matches_any(text, fixed.DIRECTIVE_MARKS)


def has_required_structure(text: Column) -> Column:
    return has_role(text) & has_directive(text)


def completeness(text: Column, framework: Column, guardrail_count: Column) -> Column:
    named = (framework != "chain-of-thought") & F.contains(F.lower(text), F.lower(framework))
    score = (
        bonus(has_role(text), 0.25)
        + bonus(has_directive(text), 0.25)
        + bonus(named, 0.15)
        + bonus(matches_any(text, fixed.GUARDRAIL_MARKS), 0.15)
        + bonus(guardrail_count > 0, 0.10)
        + bonus(text.rlike(rx(fixed.BACKGROUND_MARK, "i")), 0.10)
    )
    return F.least(F.lit(1.0), score)


def whole_words(terms: Sequence[str]) -> str:
    """Any of the terms as whole words; group 1 is the term."""
    return rf"(?<![{WORD_CLASS}])(" + "|".join(terms) + rf")(?![{WORD_CLASS}])"


def clarity(text: Column) -> Column:
    """One pass per word list: every distinct vague or unsure term costs a fixed amount."""
    low = F.lower(text)
    vague = F.size(F.array_distinct(all_matches(low, whole_words(fixed.VAGUE_TERMS), 1)))
    unsure = F.size(F.array_distinct(all_matches(low, whole_words(fixed.UNSURE_TERMS), 1)))
    hedges = F.regexp_count(low, F.lit(whole_words(fixed.HEDGES)))
    score = (
        repeat_subtract(repeat_subtract(F.lit(1.0), 0.05, vague), 0.03, unsure)
        - bonus(hedges > 3, 0.10)
        + bonus(text.rlike(rx(fixed.COUNTED_MARK, "i")), 0.05)
        + bonus(text.rlike(rx(fixed.EXAMPLE_MARK, "i")), 0.05)
    )
    return clamp01(score)


def composite_quality(
    coherence_score: Column, relevance_score: Column, completeness_score: Column, clarity_score: Column,
    guardrail_count: Column, structured: Column,
) -> Column:
    weighted = (
        coherence_score * 0.30 + relevance_score * 0.30 + completeness_score * 0.20 + clarity_score * 0.20
    )
    return F.least(
        F.lit(1.0), weighted + F.least(guardrail_count * 0.05, F.lit(0.15)) + bonus(structured, 0.10)
    )


def falling(value: Column, best: float, width: float) -> Column:
    """1 up to ``best``, 0 beyond ``best + width``, a straight line between."""
    return clamp01(F.lit(1.0) - (value - F.lit(best)) / F.lit(width))


def performance_score(latency_ms: Column, cost: Column, tokens: Column) -> Column:
    return (
        falling(latency_ms, 5000.0, 25000.0) * 0.50
        + falling(cost, 0.01, 0.09) * 0.30
        + falling(tokens, 1000.0, 4000.0) * 0.20
    )


def success_rate(copies: Column, regenerations: Column) -> Column:
    return F.coalesce(F.try_divide(copies, copies + regenerations), F.lit(0.0))


def impact_score(copies: Column, rate: Column, feedback: Column, reuses: Column) -> Column:
    """Missing feedback, and a feedback of 0, count as the middle mark."""
    mark = F.when(feedback.isNull() | (feedback == 0), 3).otherwise(feedback)
    return (
        F.least(F.lit(1.0), copies / 3) * 0.30
        + rate * 0.30
        + (mark / 5) * 0.25
        + F.least(F.lit(1.0), reuses / 2) * 0.15
    )


def overall_score(quality: Column, performance: Column, impact: Column) -> Column:
    return quality * 0.50 + performance * 0.25 + impact * 0.25


def ladder(score: Column, steps: Sequence[tuple[float, str]], below: str) -> Column:
    """Grade of the highest step the score reaches."""
    chain = None
    for least, grade in steps:
        chain = F.when(score >= least, grade) if chain is None else chain.when(score >= least, grade)
    return chain.otherwise(below)


def quality_grade(score: Column) -> Column:
    return ladder(score, fixed.QUALITY_LADDER, "F")


def performance_grade(score: Column) -> Column:
    return ladder(score, fixed.EFFORT_LADDER, "F")


impact_grade = performance_grade


def overall_grade(score: Column) -> Column:
    return ladder(score, fixed.OVERALL_LADDER, "D")


def is_acceptable(quality: Column, performance: Column, rate: Column) -> Column:
    return (quality >= 0.60) & (performance >= 0.40) & (rate >= 0.50)


def metric_limit(metric: Column, position: int) -> Column:
    """A limit of the metric's family, the part before the first dot; unknown families use overall."""
    family = F.substring_index(metric, ".", 1)
    chain = None
    for name, limits in fixed.METRIC_LIMITS.items():
        value = F.lit(limits[position])
        chain = F.when(family == name, value) if chain is None else chain.when(family == name, value)
    return chain.otherwise(F.lit(fixed.METRIC_LIMITS["overall"][position]))


def registry_grade(metric: Column, value: Column) -> Column:
    return (
        F.when(value >= metric_limit(metric, 2), "A+")
        .when(value >= metric_limit(metric, 1), "A")
        .when(value >= metric_limit(metric, 0), "C")
        .otherwise("F")
    )


def registry_acceptable(metric: Column, value: Column) -> Column:
    return value >= metric_limit(metric, 0)


def history_quality(confidence: Column, latency_ms: Column) -> Column:
    """Confidence less a capped latency penalty; a confidence of 0 counts as missing."""
    base = F.when(confidence.isNull() | (confidence == 0), 0.5).otherwise(confidence)
    penalty = F.least(F.coalesce(latency_ms, F.lit(0)) / 10000, F.lit(0.3))
    return clamp01(base - penalty)
