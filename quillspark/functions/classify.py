"""Keyword and structure classifiers over prompt text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from quillspark import fixed
from quillspark.functions.scores import whole_words
from quillspark.functions.text import (
    any_of, contains_any, count_present, first_present, is_blank, strip, word_count,
)


def intent(idea: Column, context: Column, code: Column | None = None, error_log: Column | None = None) -> Column:
    """Structure first (code with an error log, stated expectation), then words in fixed priority."""
    none = F.lit("")
    code, error_log = (c if c is not None else none for c in (code, error_log))
    low, low_context = F.lower(idea), F.lower(F.coalesce(context, none))
    structured = (F.coalesce(code, none) != "") & (F.coalesce(error_log, none) != "")
    spaced = F.concat(F.lit(" "), low, F.lit(" "))
    refactor = any_of([F.contains(spaced, F.lit(f" {v} ")) for v in fixed.REFACTOR_VERBS]) | contains_any(
        low, fixed.SLOWNESS_TERMS
    )
    return (
        F.when(structured, "debug")
        .when(contains_any(low_context, fixed.EXPECTATION_TERMS), "refactor")
        .when(contains_any(F.concat_ws(" ", low, low_context), fixed.EXPLAIN_TERMS), "explain")
        .when(refactor, "refactor")
        .when(contains_any(low, fixed.DEBUG_TERMS), "debug")
        .otherwise("generate")
    )


def service_intent(idea: Column, context: Column) -> Column:
    return first_present(F.lower(F.concat_ws(" ", idea, F.coalesce(context, F.lit("")))), fixed.SERVICE_INTENTS, "GENERATE")


def client_analysis(text: Column) -> Column:
    """Intent, size class and confidence as the client guesses them from the bare input."""
    trimmed = strip(text)
    size = word_count(trimmed)
    blank = trimmed == ""
    return F.struct(
        F.when(blank, "explain").otherwise(first_present(F.lower(trimmed), fixed.CLIENT_INTENTS, "explain")).alias("intent"),
        F.when(blank | (size < 10), "SIMPLE").when(size < 20, "MODERATE").otherwise("COMPLEX").alias("complexity"),
        F.when(blank, 0.0).when(size < 5, 0.4).otherwise(0.8).alias("confidence"),
    )


def fold_intent(name: Column) -> Column:
    """Sub-types such as ``debug_runtime`` to their main intent."""
    return (
        F.when(name.startswith("debug"), "debug")
        .when(name.startswith("refactor"), "refactor")
        .when(name == "explain", "explain")
        .otherwise("generate")
    )


def complexity_score(idea: Column, context: Column) -> Column:
    size = F.length(idea) + F.length(context)
    low = F.lower(F.concat_ws(" ", idea, context))
    by_length = F.when(size <= 50, 0.0).when(size <= 150, 0.5).otherwise(1.0)
    terms = F.regexp_count(low, F.lit(whole_words(fixed.COMPLEXITY_TERMS)))
    marks = F.length(low) - F.length(F.translate(low, ".,;", ""))
    given = F.when(is_blank(context), 0.0).otherwise(1.0)
    return (
        by_length * 0.4
        + F.least(terms * 0.5, F.lit(1.0)) * 0.3
        + F.least(marks * 0.1, F.lit(1.0)) * 0.2
        + given * 0.1
    )


def complexity(idea: Column, context: Column) -> Column:
    score = complexity_score(idea, context)
    return (
        F.when(F.length(idea) + F.length(context) > 300, "complex")
        .when(score < 0.25, "simple")
        .when(score < 0.6, "moderate")
        .otherwise("complex")
    )


def sentiment(text: Column) -> Column:
    low = F.lower(text)
    bad, good = count_present(low, fixed.NEGATIVE_WORDS), count_present(low, fixed.POSITIVE_WORDS)
    return F.when(bad > good, "negative").when(good > bad, "positive").otherwise("neutral")


def idea_domain(idea: Column) -> Column:
    return first_present(F.lower(idea), fixed.IDEA_DOMAINS, "other")


def is_meta_prompt(idea: Column) -> Column:
    return contains_any(F.lower(idea), fixed.META_PROMPT_TERMS)


def category(idea: Column) -> Column:
    """Category and confidence of a task; prompts about prompts stay uncategorised."""
    low = F.lower(idea)
    meta = is_meta_prompt(idea)
    labels = first_present(low, [(c, t) for c, _, t in fixed.CATEGORIES], "Uncategorized")
    sure = first_present(low, [(conf, t) for _, conf, t in fixed.CATEGORIES], "low")
    return F.struct(
        meta.alias("is_meta_prompt"),
        F.when(meta, "Uncategorized").otherwise(labels).alias("category"),
        F.when(meta, "low").otherwise(sure).alias("confidence"),
    )


def framework_family(framework: Column) -> Column:
    return first_present(F.lower(framework), fixed.FRAMEWORK_FAMILIES, "Other")


def coarse_intent(idea: Column) -> Column:
    return first_present(
        F.lower(idea), [("explain", ["explain"]), ("create/implement", ["create", "implement"])], "other"
    )


def file_priority(name: Column, rules: Sequence[tuple[Sequence[str], int, str]] = fixed.FILE_RULES) -> Column:
    """Priority and category of a context file by the first rule with a keyword in its name."""
    low = F.lower(name)
    found = F.coalesce(
        *[F.when(contains_any(low, list(words)), F.struct(F.lit(p).alias("priority"), F.lit(c).alias("category"))) for words, p, c in rules],
        F.struct(F.lit(1).alias("priority"), F.lit("general").alias("category")),
    )
    return F.struct(found["priority"].alias("priority"), found["category"].alias("category"))


def error_name(context: Column) -> Column:
    return first_present(F.lower(context), [(n, [n.lower()]) for n in fixed.ERROR_NAMES], "Error")


def error_hint(message: Column, mode: Column) -> Column:
    """Advice for an error text, null where none applies."""
    low = F.lower(message)
    connect = (
        F.when(mode == "nlac", fixed.HINT_CONNECT["nlac"])
        .when(mode == "dspy", fixed.HINT_CONNECT["dspy"])
        .otherwise(fixed.HINT_CONNECT[""])
    )
    return (
        F.when(contains_any(low, ["timed out"]), fixed.HINT_TIMEOUT)
        .when(contains_any(low, ["connect", "econnrefused", "not reachable"]), connect)
        .when(F.contains(low, F.lit("model")) & F.contains(low, F.lit("not found")), fixed.HINT_MODEL)
        .when(contains_any(low, ["schema", "validation"]), fixed.HINT_SCHEMA)
        .when(contains_any(low, ["json", "parse"]), fixed.HINT_PARSE)
        .when(contains_any(low, ["401", "unauthorized", "api key"]), fixed.HINT_KEY)
        .when(contains_any(low, ["429", "rate limit"]), fixed.HINT_RATE)
    )


def worth_retry(message: Column) -> Column:
    """Whether another model may do better than the one that failed."""
    low = F.lower(message)
    about_model = F.contains(low, F.lit("model")) & contains_any(low, ["not found", "ollama error"])
    return about_model | contains_any(low, fixed.RETRY_TERMS)


def age_label(at: Column, as_of: Column) -> Column:
    """How long ago something happened, in words up to a day and as a date beyond."""
    seconds = as_of.cast("timestamp").cast("double") - at.cast("timestamp").cast("double")
    return (
        F.when(seconds < 60, "Just now")
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.date_format(at, "MMM d, hh:mm a"))
    )


def wizard_enabled(mode: Column, confidence: Column, size: Column, goal: Column, max_turns: Column) -> Column:
    unsure = (confidence < 0.7) | (size == "COMPLEX") | (goal == "generate")
    return (
        F.when(mode == "off", False)
        .when(mode == "always", True)
        .when(goal.isNull(), False)
        .when(F.coalesce(max_turns > 1, F.lit(False)), True)
        .otherwise(unsure)
    )


def offer_skip(mode: Column, confidence: Column, size: Column, goal: Column, max_turns: Column) -> Column:
    return (
        (mode == "auto") & F.coalesce(max_turns > 1, F.lit(False)) & goal.isNotNull()
        & (confidence >= 0.7) & (size != "COMPLEX") & (goal != "generate")
    )


def wizard_continues(enabled: Column, resolved: Column, turn: Column, max_turns: Column) -> Column:
    return enabled & ~resolved & (turn < max_turns)


def clarifying_questions(goal: Column, size: Column) -> Column:
    # Fixed values.
    generate = ["What specific components or features do you need?", "What are the key requirements or constraints?"]
    complex_ = ["What is your primary goal or objective?", "Who is the intended audience?"]
    other = ["Can you provide more details about what you need?"]
    as_array = lambda items: F.array(*[F.lit(i) for i in items])
    return (
        F.when(goal == "generate", as_array(generate))
        .when(size == "COMPLEX", as_array(complex_))
        .otherwise(as_array(other))
    )


def route(goal: Column, size: Column) -> Column:
    """Strategy and role for an intent and a complexity."""
    main = fold_intent(goal)
    strategy = role = None
    for (i, c), (s, r) in fixed.ROUTES.items():
        hit = (main == i) & (size == c)
        strategy = F.when(hit, s) if strategy is None else strategy.when(hit, s)
        role = F.when(hit, r) if role is None else role.when(hit, r)
    return F.struct(strategy.alias("strategy"), role.alias("role"))


def route_constraints(size: Column, language: Column | None = None) -> Column:
    limit = None
    for name, n in fixed.ROUTE_LENGTHS.items():
        limit = F.when(size == name, n) if limit is None else limit.when(size == name, n)
    language = F.lit(None).cast("string") if language is None else language
    return F.struct(
        limit.alias("max_tokens"),
        F.when(F.coalesce(language, F.lit("")) != "", F.concat(F.lit("code in "), language)).alias("format"),
        (size != "simple").alias("include_examples"),
        (size == "complex").alias("include_explanation"),
    )
