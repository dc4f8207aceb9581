"""Role, directive, framework and guardrail extraction from prompt templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark import fixed
from quillspark.functions.scores import bonus
from quillspark.functions.text import (
    all_matches, contains_any, first_match, present, rx, squeeze, strip, word_count, words,
)

NO_ROLE = "AI Assistant"


def pick(array: Column, position: int = 0) -> Column:
    return F.get(array, F.lit(position))


# --- basic -------------------------------------------------------------------------------------

def basic_role(template: Column) -> Column:
    text = strip(template)
    found = [first_match(text, rx(p, "i")) for p in fixed.BASIC_ROLES]
    return F.coalesce(*[squeeze(strip(f)) for f in found], F.lit(NO_ROLE))


def shorten(text: Column, limit: int = 200) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def without_role(paragraph: Column) -> Column:
    return strip(F.regexp_replace(paragraph, rx(r"You are an? [^.]+\.?\s*", "i"), ""))


def basic_directive(template: Column) -> Column:
    """The stated task, else the first paragraph without its role statement."""
    text = strip(template)
    found = [shorten(squeeze(strip(first_match(text, rx(p, "im"))))) for p in fixed.BASIC_DIRECTIVES]
    opening = without_role(strip(pick(F.split(text, "\n\n"))))
    return F.coalesce(*found, F.when(F.length(opening) > 10, shorten(opening)).otherwise(F.lit("")))


def basic_framework(template: Column, tags: Column) -> Column:
    """First family with a keyword in the text or among the tags."""
    low, low_tags = F.lower(template), F.transform(tags, F.lower)
    chain = None
    for name, keywords in fixed.BASIC_FRAMEWORKS:
        hit = contains_any(low, keywords) | F.coalesce(
            F.arrays_overlap(low_tags, F.array(*[F.lit(k) for k in keywords])), F.lit(False)
        )
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("")


def basic_guardrails(template: Column) -> Column:
    text = strip(template)
    found = F.concat(*[all_matches(text, rx(p, "im"), 0) for p in fixed.BASIC_GUARDRAILS])
    return F.array_join(F.filter(F.transform(found, lambda g: squeeze(strip(g))), lambda g: g != ""), ", ")


def basic_idea(template: Column, role: Column, framework: Column, handle: Column) -> Column:
    hint = pick(F.split(F.substring_index(handle, "/", -1), "-"))
    low = F.lower(template)
    parts = present(
        [
            (framework != "", F.concat(F.lit("Create "), F.lower(framework), F.lit(" agent prompt"))),
            ((role != "") & (role != NO_ROLE), F.concat(F.lit("for "), role)),
            ((hint != "") & ~F.contains(F.lower(role), F.lower(hint)), F.concat(F.lit("using "), hint, F.lit(" pattern"))),
        ]
    )
    idea = F.array_join(parts, " ")
    fallback = (
        F.when(F.contains(low, F.lit("agent")), "Create AI agent prompt")
        .when(F.contains(low, F.lit("assistant")), "Create assistant prompt")
        .otherwise(F.concat(F.lit("Create prompt based on "), handle))
    )
    ended = F.when(idea.endswith(".") | idea.endswith("prompt"), idea).otherwise(F.concat(idea, F.lit(" prompt")))
    return F.when(F.size(parts) == 0, fallback).otherwise(ended)


# --- ranked ------------------------------------------------------------------------------------

def ranked_role(template: Column) -> Column:
    """The role with most words among all matches, the first found on ties; else a guess."""
    text, low = strip(template), F.lower(template)
    roles = F.transform(
        F.concat(*[all_matches(text, rx(p, "i"), 1) for p in fixed.RANKED_ROLES]), lambda r: squeeze(strip(r))
    )
    ranked = F.transform(roles, lambda r, i: F.struct(word_count(r).alias("n"), (-i).alias("rank"), r.alias("role")))
    guess = (
        F.when(F.contains(low, F.lit("agent")) & F.contains(low, F.lit("react")), "ReAct Agent")
        .when(F.contains(low, F.lit("agent")) & F.contains(low, F.lit("tool")), "Tool-Using Agent")
        .when(F.contains(low, F.lit("agent")), "AI Agent")
        .when(F.contains(low, F.lit("assistant")), NO_ROLE)
        .when(F.contains(low, F.lit("expert")), "Expert Advisor")
        .otherwise(NO_ROLE)
    )
    return F.coalesce(F.array_max(ranked)["role"], guess)


def framework_signs(template: Column, tags: Column) -> list[tuple[str, Column, list[tuple[float, str]]]]:
    """Per family: its name, an array telling which signs show, and each sign's weight and wording."""
    low, low_tags = F.lower(template), F.transform(tags, F.lower)
    out = []
    for name, (keywords, patterns) in fixed.FRAMEWORK_SIGNS.items():
        plain = lambda p: p.replace(" ", "").replace("-", "").replace("_", "").replace("'", "").replace(":", "").isalnum()
        hits = (
            [F.contains(low, F.lit(k)) for k in keywords]
            + [F.coalesce(F.array_contains(low_tags, k), F.lit(False)) for k in keywords]
            + [F.contains(low, F.lit(p)) if plain(p) else low.rlike(rx(p)) for p in patterns]
        )
        wording = (
            [(0.15, f"keyword: '{k}'") for k in keywords] + [(0.25, f"tag: '{k}'") for k in keywords]
            + [(0.3, f"pattern: '{p[:30]}...'") for p in patterns]
        )
        out.append((name, F.array(*hits), wording))
    return out


def with_detections(df: DataFrame, template: str, tags: str, into: str) -> DataFrame:
    """Framework families with enough signs, surest first: (name, confidence, evidence).

    Signs are looked for once, in a stage of their own; weights are added one at a time.
    """
    signs = framework_signs(F.col(template), F.col(tags))
    staged = df.withColumns({f"_hits{i}": hits for i, (_, hits, _) in enumerate(signs)})
    found = []
    for i, (name, _, wording) in enumerate(signs):
        weights = F.array(*[F.lit(w) for w, _ in wording])
        texts = F.array(*[F.lit(t) for _, t in wording])
        hits = F.col(f"_hits{i}")
        gained = F.zip_with(hits, weights, lambda h, w: F.when(h, w).otherwise(0.0))
        sure = F.least(F.aggregate(gained, F.lit(0.0), lambda acc, w: acc + w), F.lit(1.0))
        words_n = sum(t.startswith("keyword") for _, t in wording)
        tagged = F.array_contains(F.slice(hits, words_n + 1, words_n), True)
        evidence = F.slice(F.filter(F.zip_with(hits, texts, lambda h, t: F.when(h, t)), lambda t: t.isNotNull()), 1, 5)
        found.append((i, F.struct(F.lit(name).alias("name"), sure.alias("confidence"), evidence.alias("evidence"), tagged.alias("tagged"))))
    staged = staged.withColumns({f"_found{i}": item for i, item in found})
    every = F.array(*[F.col(f"_found{i}") for i, _ in found])
    kept = F.filter(every, lambda d: (d["confidence"] >= 0.3) | d["tagged"])
    ordered = F.array_sort(
        kept, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0)
    )
    slim = F.transform(ordered, lambda d: F.struct(d["name"].alias("name"), d["confidence"].alias("confidence"), d["evidence"].alias("evidence")))
    gone = [f"_hits{i}" for i, _ in found] + [f"_found{i}" for i, _ in found]
    return staged.withColumn(into, slim).drop(*gone)


def ranked_directive(template: Column, framework: Column) -> Column:
    """A stated directive of some length, else one implied by the framework, else an opening sentence."""
    text, low = strip(template), F.lower(template)
    stated = []
    for p in fixed.RANKED_DIRECTIVES:
        found = squeeze(strip(first_match(text, rx(p, "im"))))
        stated.append(F.when(F.length(found) > 20, F.substring(found, 1, 300)))
    asks = text.rlike(rx(r"Question:\s*([^\n]+)", "i"))
    implied = (
        F.when((framework == "ReAct") & asks, "Answer questions using ReAct reasoning")
        .when(framework == "ReAct", "Use ReAct reasoning to solve problems")
        .when((framework == "RAG") & F.contains(low, F.lit("answer the question")), "Answer questions using retrieved context")
        .when(framework == "RAG", "Use retrieved context to answer questions")
        .when(framework == "Self-Ask", "Break down complex questions by asking follow-up questions")
        .when(framework == "Decomposition", "Break down complex tasks into smaller sub-problems")
    )
    opening = without_role(pick(F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")))
    sentence = pick(F.filter(F.transform(F.split(opening, "[.!?]"), strip), lambda s: F.length(s) > 10))
    return F.coalesce(*stated, implied, F.when(F.length(opening) > 20, F.substring(sentence, 1, 300)), F.lit(""))


def ranked_guardrails(template: Column) -> Column:
    """Up to three guardrails for every category that has any."""
    text = strip(template)
    parts = []
    for category, signs in fixed.GUARDRAIL_SIGNS.items():
        found = F.concat(*[all_matches(text, rx(p, "im"), g) for p, g in signs])
        kept = F.filter(F.transform(found, lambda g: squeeze(strip(g))), lambda g: F.length(g) > 5)
        parts.append(
            F.when(
                F.size(kept) > 0,
                F.concat(F.lit(f"{category.capitalize()}: "), F.array_join(F.slice(kept, 1, 3), ", ")),
            )
        )
    return F.concat_ws(" | ", *parts)


def extraction_quality(role: Column, directive: Column, confidence: Column, guardrails: Column) -> Column:
    named = (role != "") & (role != NO_ROLE)
    clear = F.when(
        named,
        F.least(
            F.lit(1.0),
            F.lit(0.5) + bonus(word_count(role) >= 2, 0.3) + bonus(contains_any(F.lower(role), fixed.CLEAR_ROLE_WORDS), 0.2),
        ),
    ).otherwise(0.0)
    specific = F.when(
        directive != "",
        F.least(
            F.lit(1.0),
            F.lit(0.3) + bonus(F.length(directive) > 50, 0.3) + bonus(F.length(directive) > 100, 0.2)
            + bonus(contains_any(F.lower(directive), fixed.SPECIFIC_DIRECTIVE_WORDS), 0.2),
        ),
    ).otherwise(0.0)
    measurable = F.when(
        guardrails != "",
        F.least(
            F.lit(1.0),
            F.lit(0.3) + bonus(guardrails.rlike(r"\p{Nd}"), 0.3)
            + bonus(contains_any(F.lower(guardrails), fixed.MEASURABLE_WORDS), 0.2)
            + bonus(F.length(guardrails) - F.length(F.translate(guardrails, "|", "")) >= 2, 0.2),
        ),
    ).otherwise(0.0)
    return F.struct(
        clear.alias("role_clarity"), specific.alias("directive_specificity"),
        confidence.alias("framework_confidence"), measurable.alias("guardrails_measurability"),
        ((clear + specific + confidence + measurable) / 4.0).alias("overall_quality"),
    )


def ranked_idea(template: Column, role: Column, framework: Column, directive: Column, handle: Column) -> Column:
    low = F.lower(template)
    action = (
        F.when(contains_any(low, ["improve", "enhance"]), "Improve")
        .when(F.contains(low, F.lit("generate")), "Generate")
        .when(F.contains(low, F.lit("build")), "Build")
        .otherwise("Create")
    )
    verb = F.lower(action)
    hint = F.translate(F.substring_index(handle, "/", -1), "-_", "  ")
    uses_framework = framework != ""
    uses_role = (role != "") & (role != NO_ROLE)
    uses_directive = F.length(directive) > 20
    uses_hint = (F.length(hint) > 2) & ~F.contains(F.lower(role), hint)
    opening = F.concat(verb, F.lit(" a prompt"))
    parts = present(
        [
            (uses_framework, F.concat(verb, F.lit(" a "), F.lower(framework), F.lit(" prompt"))),
            (~uses_framework & (uses_role | uses_directive), opening),
            (uses_role, F.concat(F.lit("for a "), F.lower(role))),
            (uses_directive, F.concat(F.lit("that "), F.lower(F.array_join(F.slice(words(directive), 1, 5), " ")))),
            (
                uses_hint,
                F.when(uses_framework | uses_role | uses_directive, F.concat(F.lit("using "), hint)).otherwise(
                    F.concat(verb, F.lit(" a "), hint, F.lit(" prompt"))
                ),
            ),
        ]
    )
    idea = F.array_join(parts, " ")
    ended = F.when(idea.rlike("[.?]$"), idea).otherwise(F.concat(idea, F.lit(".")))
    fallback = (
        F.when(F.contains(low, F.lit("question")), F.concat(action, F.lit(" a question-answering prompt")))
        .when(F.contains(low, F.lit("agent")), F.concat(action, F.lit(" an agent prompt")))
        .when(F.contains(low, F.lit("assistant")), F.concat(action, F.lit(" an assistant prompt")))
        .otherwise(F.concat(action, F.lit(" a prompt based on "), handle))
    )
    capitalised = F.concat(F.upper(F.substring(ended, 1, 1)), F.lower(F.substring(ended, 2, 1 << 30)))
    return F.when(F.size(parts) == 0, fallback).otherwise(capitalised)


def template_patterns(template: Column, framework: Column) -> Column:
    """What the template shows: variables, structure, examples, framework habits, conversation."""
    low = F.lower(template)
    variables = F.array_distinct(all_matches(template, rx(r"\{(\w+)\}"), 1))
    return present(
        [
            (F.size(variables) > 0, F.concat(F.lit("Variables: "), F.array_join(variables, ", "))),
            (F.contains(template, F.lit(":")), "Structured output specification"),
            (contains_any(low, ["example", "for instance", "e.g.", "such as"]), "Contains examples"),
            ((framework == "ReAct") & F.contains(low, F.lit("tool")), "Tool-using pattern"),
            ((framework == "ReAct") & F.contains(low, F.lit("thought")), "Thought-action-observation loop"),
            ((framework == "RAG") & F.contains(low, F.lit("context")), "Context-based answering"),
            (contains_any(low, ["question:", "answer:", "thought:"]), "Conversational format"),
        ]
    )


def template_from_messages(messages: Column, repr_text: Column) -> Column:
    """Message templates joined by blank lines, else quoted templates found in an object's text."""
    usable = F.filter(messages, lambda m: m.isNotNull() & (m != "") & ~m.startswith("input_variables="))
    double = all_matches(repr_text, r'template="([^"]*(?:\\.[^"]*)*)"', 1)
    single = all_matches(repr_text, r"template='([^']*(?:\\.[^']*)*)'", 1)
    quoted = F.filter(
        F.when(F.size(double) > 0, double).otherwise(single), lambda m: ~strip(m).isin(fixed.BARE_PLACEHOLDERS)
    )

    def unescape(text: Column) -> Column:
        for raw, plain in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\'", "'"), ("\\\\", "\\")):
            text = F.replace(text, F.lit(raw), F.lit(plain))
        return text

    decoded = F.transform(quoted, unescape)
    return (
        F.when(F.size(usable) > 0, F.array_join(usable, "\n\n"))
        .when(F.size(decoded) > 0, F.array_join(decoded, "\n\n"))
        .otherwise(repr_text)
    )
