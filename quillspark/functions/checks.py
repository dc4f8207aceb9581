"""Validation columns: constraint checks, example scores, warning lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from quillspark import fixed
from quillspark.functions.jsonudf import json_valid
from quillspark.functions.scores import bonus
from quillspark.functions.text import (
    clamp01, contains_any, count_present, is_blank, lines, matches_any, present, rx, strip,
)

Constraint = Callable[[Column], Column]


def min_length(chars: int = 50) -> Constraint:
    return lambda text: F.length(strip(text)) >= chars


def action_verbs(verbs: Sequence[str] = tuple(fixed.IFEVAL_VERBS)) -> Constraint:
    return lambda text: contains_any(F.lower(text), verbs)


def looks_like_json(text: Column) -> Column:
    bare = strip(text)
    return bare.rlike(r'^[{\["]') | bare.isin("true", "false", "null")


def json_or_plain() -> Constraint:
    """Valid JSON, or text that does not look like JSON; only look-alikes reach the parser."""

    def check(text: Column) -> Column:
        return ~looks_like_json(text) | json_valid(F.when(looks_like_json(text), text))

    return check


DEFAULT_CONSTRAINTS: dict[str, Constraint] = {
    "min_length": min_length(), "action_verbs": action_verbs(), "json_format": json_or_plain(),
}


def constraint_score(flags: Sequence[Column]) -> Column:
    """Share of the constraints that hold."""
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags]) / len(flags)


def special_ratio(text: Column) -> Column:
    odd = F.length(F.regexp_replace(text, rx(r"""[a-zA-Z0-9\s.,!?;:\-'"()]+"""), ""))
    return F.coalesce(F.try_divide(odd, F.length(text)), F.lit(0.0))


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.translate(text, char, ""))


def has_repeated_word(tokens: Column) -> Column:
    """Some word of over three characters occurs more than three times.

    Sorted, equal words are neighbours, so a word is frequent exactly if it equals the one three on.
    """
    longer = F.filter(tokens, lambda w: F.length(w) > 3)
    ordered = F.sort_array(F.transform(longer, F.lower))
    return F.exists(
        F.zip_with(F.slice(ordered, F.lit(4), F.size(ordered) + 1), ordered, lambda a, b: a == b),
        lambda hit: F.coalesce(hit, F.lit(False)),
    )


def pattern_errors(question: Column, tokens: Column) -> list[tuple[Column, str]]:
    low = F.lower(question)
    named = [
        (F.contains(low, F.lit(f.lower())), f"Question contains framework mention: {f}")
        for f in fixed.NAMED_FRAMEWORKS
    ]
    return [
        (is_blank(question) | question.rlike(rx(r"^\s*[.]+\s*$")), "Question contains empty role or directive"),
        *named,
        (special_ratio(question) > 0.3, "Question has too many special characters"),
        (occurrences(question, "(") != occurrences(question, ")"), "Unbalanced parentheses"),
        (has_repeated_word(tokens), "Question contains repetition"),
    ]


def synthetic_errors(question: Column, metadata: Column, tokens: Column) -> Column:
    """All errors of a synthetic example; ``metadata`` is a struct whose missing fields are null and
    ``tokens`` holds the question's words."""
    required = ["task_type", "domain", "confidence", "source_component_id", "variation"]
    confidence = metadata["confidence"]
    checks = [
        (question.isNull(), "Missing 'question' field"),
        (metadata.isNull(), "Missing 'metadata' field"),
        *[(metadata.isNotNull() & metadata[f].isNull(), f"Missing '{f}' in metadata") for f in required],
        (metadata["task_type"].isNotNull() & ~metadata["task_type"].isin(fixed.TASK_TYPES), "Invalid task_type"),
        ((confidence < 0.0) | (confidence > 1.0), "Confidence must be between 0.0 and 1.0"),
        (F.length(question) < 50, "Question too short"),
        (F.length(question) > 5000, "Question too long"),
        *[(question.isNotNull() & c, m) for c, m in pattern_errors(question, tokens)],
    ]
    return present(checks)


def lexical_score(text: Column, tokens: Column, extra: Column) -> Column:
    """Shared core of both example scores: low diversity is final, else bonuses are added up."""
    low = F.lower(text)
    chars = F.array_distinct(F.split(text, ""))
    score = (
        F.lit(0.5)
        + F.least(F.lit(1.0), F.length(text) / 200) * 0.2
        + F.least(F.lit(0.15), count_present(low, fixed.SCORE_CONTEXT_WORDS) * 0.03)
        + F.least(F.lit(0.1), count_present(low, fixed.SCORE_ACTION_WORDS) * 0.02)
        + extra
    )
    return (
        F.when((F.length(text) > 0) & (F.size(chars) / F.length(text) < 0.05), 0.2)
        .when((F.size(tokens) > 0) & (F.try_divide(F.size(F.array_distinct(tokens)), F.size(tokens)) < 0.2), 0.3)
        .otherwise(clamp01(score))
    )


def synthetic_score(question: Column, metadata: Column, errors: Column, tokens: Column) -> Column:
    extra = (
        F.least(F.lit(0.1), count_present(F.lower(question), fixed.SCORE_LIMIT_WORDS) * 0.02)
        + F.coalesce(metadata["confidence"] * 0.1, F.lit(0.0))
        + bonus(F.coalesce(metadata["task_type"].isin(fixed.TASK_TYPES), F.lit(False)), 0.05)
        - F.size(errors) * 0.2
    )
    return F.when(question.isNull(), 0.0).otherwise(lexical_score(question, tokens, extra))


def import_errors(inputs: Column, outputs: Column, metadata: Column) -> Column:
    return present(
        [
            (inputs.isNull(), "Missing 'inputs' field"),
            (outputs.isNull(), "Missing 'outputs' field"),
            (metadata.isNull(), "Missing 'metadata' field"),
        ]
    )


def import_score(prompt: Column, source: Column, errors: Column, tokens: Column) -> Column:
    extra = bonus(F.coalesce(source == "langchain-hub", F.lit(False)), 0.1) - F.size(errors) * 0.2
    return F.when(F.coalesce(prompt, F.lit("")) == "", 0.0).otherwise(lexical_score(prompt, tokens, extra))


def prompt_warnings(
    template: Column, max_chars: Column, fmt: Column, examples: Column, explanation: Column
) -> Column:
    """Unmet demands of a prompt; the limit named tokens is, as ever, compared with characters."""
    low, wanted = F.lower(template), F.lower(F.coalesce(fmt, F.lit("")))
    bare = strip(template)
    json_ready = contains_any(low, fixed.JSON_WORDS) | json_valid(
        F.when(F.contains(wanted, F.lit("json_only")) & ~contains_any(low, fixed.JSON_WORDS), bare)
    )
    plain = F.contains(wanted, F.lit("no_markdown"))
    fenced = F.contains(template, F.lit("```"))
    return present(
        [
            (
                F.length(template) > max_chars,
                F.concat(
                    F.lit("Template exceeds max_tokens: "), F.length(template).cast("string"), F.lit(" > "),
                    max_chars.cast("string"),
                ),
            ),
            (F.contains(wanted, F.lit("json_only")) & ~F.coalesce(json_ready, F.lit(False)), "Template is not valid JSON"),
            (
                F.contains(wanted, F.lit("markdown")) & ~plain & ~fenced,
                "Template missing markdown formatting (required)",
            ),
            (plain & fenced, "Template contains markdown code blocks (prohibited)"),
            (
                F.coalesce(examples, F.lit(False)) & ~contains_any(low, fixed.EXAMPLE_WORDS),
                "Template missing examples (required by constraint)",
            ),
            (
                F.coalesce(explanation, F.lit(False)) & ~contains_any(low, fixed.EXPLANATION_WORDS),
                "Template missing explanation (required by constraint)",
            ),
            (F.length(bare) < 20, "Template too short (minimum 20 characters)"),
            (~contains_any(low, ["role", "task", "you are"]), "Template missing role or task definition"),
        ]
    )


def fence_code(rows: Column, at: Column) -> Column:
    """Lines as text with a fence from line ``at`` (1-based) to the end."""
    return F.concat_ws(
        "\n",
        F.slice(rows, F.lit(1), F.greatest(at - 1, F.lit(0))), F.array(F.lit("```python")),
        F.slice(rows, F.greatest(at, F.lit(1)), F.size(rows)), F.array(F.lit("```")),
    )


def first_definition(rows: Column) -> Column:
    """1-based line of the first definition, 0 where there is none."""
    return F.array_position(F.transform(rows, lambda s: strip(s).rlike("^(def |function |class )")), True).cast("int")


def trajectory_checks(
    template: Column, max_chars: Column, fmt: Column, examples: Column, explanation: Column
) -> list[tuple[Column, Column, Column]]:
    """(applies, holds, complaint) for every constraint an optimisation step is scored on."""
    low = F.lower(template)
    limit = F.coalesce(max_chars, F.lit(2000))
    yes, fence = F.lit(True), F.contains(template, F.lit("```"))
    wants_code = F.contains(F.lower(fmt), F.lit("code"))
    return [
        (
            yes, F.length(template) <= limit,
            F.concat(
                F.lit("Template too long: "), F.length(template).cast("string"), F.lit(" > "), limit.cast("string")
            ),
        ),
        (
            fmt.isNotNull(), ~F.coalesce(wants_code, F.lit(False)) | fence | F.contains(template, F.lit("def ")),
            F.lit("Missing code examples"),
        ),
        (
            F.coalesce(examples, F.lit(False)), F.contains(low, F.lit("example")) | fence,
            F.lit("Missing examples as required"),
        ),
        (
            F.coalesce(explanation, F.lit(False)), contains_any(low, ["explain", "reasoning", "because"]),
            F.lit("Missing explanation as required"),
        ),
        (yes, F.length(template) > 50, F.lit("Template too short")),
    ]


def trajectory_score(*args: Column) -> Column:
    checks = trajectory_checks(*args)
    total = reduce(lambda a, b: a + b, [a.cast("int") for a, _, _ in checks])
    passed = reduce(lambda a, b: a + b, [(a & h).cast("int") for a, h, _ in checks])
    return passed / total


def trajectory_feedback(*args: Column) -> Column:
    issues = present([(a & ~h, m) for a, h, m in trajectory_checks(*args)])
    return F.when(F.size(issues) == 0, "All constraints passed").otherwise(
        F.concat(F.lit("Issues: "), F.array_join(issues, ", "))
    )


def example_metric(prompt: Column, role: Column, directive: Column, framework: Column, guardrail_count: Column) -> Column:
    """How complete a produced example is, as a ladder from 0 to 1."""
    upper = F.upper(prompt)
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    short = lambda c, n: F.length(F.coalesce(c, F.lit(""))) < n
    return (
        F.when(empty(prompt), 0.0)
        .when(short(role, 20) | short(directive, 30), 0.3)
        .when(~F.lower(F.coalesce(framework, F.lit(""))).isin(fixed.FRAMEWORKS), 0.3)
        .when(F.coalesce(guardrail_count, F.lit(0)) < 2, 0.5)
        .when(count_present(upper, fixed.STRUCTURE_WORDS) < 3, 0.7)
        .otherwise(1.0)
    )


def soft_category(
    output: Column, questions: Column, confidence: Column, banned: Column,
    min_chars: Column, max_questions: Column, min_confidence: Column,
    no_placeholders: Column | None = None, no_chat: Column | None = None,
) -> Column:
    """First soft assertion an output breaks, or ``success``."""
    yes = F.lit(True)
    text = F.coalesce(output, F.lit(""))
    low = F.lower(text)
    return (
        F.when(F.length(strip(text)) < min_chars, "emptyFinalPrompt")
        .when((no_placeholders if no_placeholders is not None else yes) & has_placeholder(text), "unfilledPlaceholders")
        .when((no_chat if no_chat is not None else yes) & is_chatty(text), "chattyOutput")
        .when(F.exists(banned, lambda b: F.contains(low, F.lower(b))), "bannedContent")
        .when(questions > max_questions, "tooManyQuestions")
        .when(confidence < min_confidence, "other")
        .otherwise("success")
    )


def has_placeholder(text: Column) -> Column:
    return text.rlike(fixed.PLACEHOLDER_MARK)


def is_chatty(text: Column) -> Column:
    return contains_any(F.lower(text), fixed.CHATTY_TERMS)


def is_copyable(output: Column, questions: Column) -> Column:
    return (F.length(output) > 50) & (questions <= 3) & ~contains_any(output, ["{{", "["])


def output_issues(text: Column) -> Column:
    return present(
        [
            (has_placeholder(text), "unfilled_placeholders"),
            (is_chatty(text), "chatty_output"),
            (F.length(strip(text)) < 50, "empty_or_too_short"),
        ]
    )


def rewrite_issues(text: Column) -> Column:
    """Signs that an output talks about the prompt instead of being it."""
    bare = strip(text)
    low = F.lower(bare)
    first = F.lower(strip(F.coalesce(F.get(F.filter(F.split(bare, r"\r?\n"), lambda s: strip(s) != ""), F.lit(0)), F.lit(""))))
    snippets = F.filter(F.array(*[F.lit(s) for s in fixed.BANNED_SNIPPETS]), lambda s: F.contains(low, s))
    starts = lambda options: reduce(lambda a, b: a | b, [first.startswith(o) for o in options])
    return present(
        [
            (bare == "", "improved_prompt is empty"),
            (F.size(snippets) > 0, F.concat(F.lit('contains meta content: "'), F.get(snippets, F.lit(0)), F.lit('"'))),
            (starts(fixed.META_STARTS), "starts with meta instructions"),
            (starts(fixed.DESCRIBING_STARTS), "describes creating a prompt instead of being the prompt"),
            (contains_any(bare, ["?", "¿"]), "contains a question"),
        ]
    )


def debt_patterns(text: Column) -> Column:
    return present([(matches_any(text, [p]), label) for label, p in fixed.DEBT_MARKS])


def acronym_sense(text: Column) -> Column:
    """The first listed sense whose phrase occurs, null where none does."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(label)) for label, p in fixed.ACRONYM_SENSES])


def case_gates(output: Column, confidence: Column, case_id: Column, min_chars: Column) -> Column:
    """Four gates of the mode comparison; a heading alone makes an output copyable."""
    shape = ((F.length(output) > 50) & F.contains(output, F.lit("Role:"))) | F.contains(output, F.lit("##"))
    return F.struct(
        F.lit(True).alias("json_valid"),
        (F.coalesce(confidence, F.lit(0.5)) >= 0.7).alias("confidence_ok"),
        (shape & (min_chars.isNull() | (F.length(output) >= min_chars))).alias("copyable"),
        (~case_id.startswith("bad-")).alias("review_rate_ok"),
    )


def arm_gates(
    output: Column, confidence: Column, role: Column, directive: Column, framework: Column,
    min_confidence: Column, min_chars: Column, error: Column | None = None,
) -> Column:
    """Five gates of the arm comparison; a failed call passes only the JSON gate."""
    ran = error.isNull() if error is not None else F.lit(True)
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.struct(
        F.lit(True).alias("json_valid"),
        (ran & (confidence >= min_confidence)).alias("confidence_ok"),
        (ran & (F.length(output) >= min_chars)).alias("min_length_ok"),
        (ran & full(role) & full(directive) & full(framework)).alias("has_structure"),
        (ran & ~contains_any(F.lower(output), fixed.AI_SPEAK)).alias("no_ai_speak"),
    )


def case_assertions(text: Column, min_chars: Column, wanted: Column, unwanted: Column) -> Column:
    return (
        (F.length(text) >= min_chars)
        & F.forall(wanted, lambda k: F.contains(text, k))
        & ~F.exists(unwanted, lambda k: F.contains(text, k))
    )
