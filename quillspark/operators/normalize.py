"""Normalisation of examples, components, prompts and requests to one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark import fixed
from quillspark.functions import extract as X
from quillspark.functions.classify import route, route_constraints
from quillspark.functions.text import any_of, contains_any, dedup_ignore_case, is_blank, lines, squeeze, strip


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def normalize_example(df: DataFrame) -> DataFrame:
    """Nested examples stay; flat ``input``/``output`` rows become nested.

    Needs ``input``, ``output``, ``inputs``, ``outputs`` and a string map ``metadata``.
    """
    c = F.col
    nested = c("inputs").isNotNull() & c("outputs").isNotNull()
    inputs_type, outputs_type = (df.schema[n].dataType for n in ("inputs", "outputs"))

    def filled(type_, values: dict[str, Column]) -> Column:
        return F.struct(
            *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in type_.fields]
        )

    framework = F.coalesce(F.try_element_at(c("metadata"), F.lit("framework")), F.lit("unknown"))
    return df.select(
        *[n for n in df.columns if n not in ("input", "output", "inputs", "outputs")],
        F.when(nested, c("inputs")).otherwise(filled(inputs_type, {"original_idea": text_or_empty("input")})).alias("inputs"),
        F.when(nested, c("outputs")).otherwise(
            filled(outputs_type, {"improved_prompt": text_or_empty("output"), "framework": framework})
        ).alias("outputs"),
    )


def component_idea() -> Column:
    """What a user may have asked for to get this component."""
    c = F.col
    named = ~is_blank(c("framework")) & (c("framework") != "N/A")
    chain = None
    for domain in ("softdev", "data"):
        hit = named & (c("domain") == domain)
        text = fill(F.lit(fixed.COMPONENT_IDEAS[domain]), {"category": text_or_empty("category"), "framework": c("framework")})
        chain = F.when(hit, text) if chain is None else chain.when(hit, text)
    return chain.otherwise(fill(F.lit(fixed.COMPONENT_IDEAS["default"]), {"category": text_or_empty("category")}))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Placeholders in braces replaced by values."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def component_to_example(components: DataFrame, idea: Column | None = None) -> DataFrame:
    """Components as examples; empty sections are left out of the prompt text."""
    rails = F.array_join(F.coalesce("guardrails", F.array().cast("array<string>")), "\n")
    section = lambda title, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), text))
    prompt = F.concat_ws(
        "\n\n",
        section("Role", F.col("role")), section("Directive", F.col("directive")),
        section("Framework", F.col("framework")), section("Guardrails", rails),
    )
    return components.select(
        F.struct((component_idea() if idea is None else idea).alias("original_idea"), F.lit("").alias("context")).alias("inputs"),
        F.struct(
            prompt.alias("improved_prompt"), text_or_empty("role").alias("role"), text_or_empty("directive").alias("directive"),
            text_or_empty("framework").alias("framework"), rails.alias("guardrails"),
        ).alias("outputs"),
        F.struct(
            F.lit("ComponentCatalog").alias("source"), F.coalesce("domain", F.lit("unknown")).alias("domain"),
            F.coalesce("category", F.lit("unknown")).alias("category"), text_or_empty("source_file").alias("source_file"),
        ).alias("metadata"),
    )


def prompt_to_unified(prompts: DataFrame, source: str = "prompts", added_at: str | None = None) -> DataFrame:
    """Dataset prompts in pool form with defaults; ``validator_score`` comes from the score lookup."""
    inputs = F.struct(text_or_empty("context").alias("context"), text_or_empty("original_idea").alias("original_idea"))
    outputs = F.struct(text_or_empty("improved_prompt").alias("improved_prompt"))
    digest = F.sha2(F.to_json(F.struct(inputs.alias("inputs"), outputs.alias("outputs"))), 256)
    or_ = lambda name, default: F.coalesce(F.col(name), F.lit(default)).alias(name)
    metadata = F.struct(
        F.lit(source).alias("source"),
        or_("domain", "unknown"),
        F.coalesce("task_category", "sub_category", F.lit("unknown")).alias("category"),
        or_("framework", "unknown"), or_("complexity", "medium"), or_("quality_score", 0.85),
        F.coalesce("validator_score", F.lit(0.960)).alias("example_validator_score"),
        F.lit(False).alias("deduplicated"), digest.alias("io_hash"), F.lit("unique").alias("duplication_status"),
        F.lit(added_at).cast("string").alias("added_at"),
    )
    keep = [n for n in ("pos", "id") if n in prompts.columns]
    return prompts.select(*keep, inputs.alias("inputs"), outputs.alias("outputs"), metadata.alias("metadata"))


def hub_to_example(hub: DataFrame) -> DataFrame:
    """Prompt templates (handle, name, template, tags) as examples by the basic extraction."""
    t, tags = F.col("template"), F.col("tags")
    parts = hub.withColumns(
        {
            "_role": X.basic_role(t), "_directive": X.basic_directive(t),
            "_framework": X.basic_framework(t, tags), "_rails": X.basic_guardrails(t),
        }
    )
    return parts.select(
        "handle",
        F.struct(
            X.basic_idea(t, F.col("_role"), F.col("_framework"), F.col("handle")).alias("original_idea"),
            F.lit("").alias("context"),
        ).alias("inputs"),
        F.struct(
            t.alias("improved_prompt"), F.col("_role").alias("role"), F.col("_directive").alias("directive"),
            F.col("_framework").alias("framework"), F.col("_rails").alias("guardrails"),
        ).alias("outputs"),
        F.struct(
            F.lit("langchain-hub").alias("source"), F.col("handle").alias("source_handle"),
            F.coalesce("name", "handle").alias("source_name"), tags.alias("tags"),
        ).alias("metadata"),
    )


def metodize(hub: DataFrame) -> DataFrame:
    """Templates as examples by the ranked extraction, with detections, sub-scores and patterns."""
    t = F.col("template")
    found = X.with_detections(hub, "template", "tags", "_found")
    first = F.get(F.col("_found"), F.lit(0))
    parts = found.withColumns(
        {
            "_framework": F.coalesce(first["name"], F.lit("")), "_sure": F.coalesce(first["confidence"], F.lit(0.0)),
            "_role": X.ranked_role(t), "_rails": X.ranked_guardrails(t),
        }
    ).withColumn("_directive", X.ranked_directive(t, F.col("_framework")))
    c = F.col
    return parts.select(
        "handle",
        F.struct(
            X.ranked_idea(t, c("_role"), c("_framework"), c("_directive"), c("handle")).alias("original_idea"),
            F.lit("").alias("context"),
        ).alias("inputs"),
        F.struct(
            t.alias("improved_prompt"), c("_role").alias("role"), c("_directive").alias("directive"),
            c("_framework").alias("framework"), c("_rails").alias("guardrails"),
        ).alias("outputs"),
        F.struct(
            X.extraction_quality(c("_role"), c("_directive"), c("_sure"), c("_rails")).alias("quality_scores"),
            X.template_patterns(t, c("_framework")).alias("detected_patterns"),
            c("handle").alias("source_handle"), c("_found").alias("framework_detections"),
        ).alias("metadata"),
    )


def compare_converters(hub: DataFrame) -> DataFrame:
    """Both extractions side by side."""
    basic = hub_to_example(hub).select("handle", F.col("outputs").alias("basic"))
    ranked = metodize(hub).select("handle", F.col("outputs").alias("ranked"), "metadata.quality_scores")
    return basic.join(ranked, "handle")


def normalize_framework(raw: Column) -> Column:
    """An allowed framework and whether the safe default had to be used."""
    name = F.lower(strip(raw))
    signs = [
        ("decomposition", ["decomp"]), ("chain-of-thought", ["chain", "cot"]), ("tree-of-thoughts", ["tree", "tot"]),
        ("role-playing", ["role"]),
    ]
    chain = F.when(name.isin(fixed.FRAMEWORKS), name)
    for framework, marks in signs:
        chain = chain.when(contains_any(name, marks), framework)
    known = name.isin(fixed.FRAMEWORKS) | any_of([contains_any(name, m) for _, m in signs])
    return F.struct(chain.otherwise("decomposition").alias("framework"), (~known).alias("used_fallback"))


def normalize_guardrails(raw: Column) -> Column:
    return F.filter(F.transform(lines(raw), strip), lambda g: g != "")


def extract_confidence(raw: Column) -> Column:
    return raw.try_cast("double")


def sanitize_output(df: DataFrame) -> DataFrame:
    """Structured model output with absent arrays, confidence and prompt replaced."""
    as_list = lambda name: F.coalesce(
        F.filter(F.col(name), lambda x: x.isNotNull()), F.array().cast("array<string>")
    )
    prompt = F.col("improved_prompt")
    return df.withColumns(
        {
            "clarifying_questions": as_list("clarifying_questions"),
            "assumptions": as_list("assumptions"),
            "confidence": F.coalesce("confidence", F.lit(0.5)),
            "improved_prompt": F.when(F.coalesce(prompt, F.lit("")) == "", "Error: Invalid prompt").otherwise(prompt),
        }
    )


def with_route(df: DataFrame, language: Column | None = None) -> DataFrame:
    chosen = route(F.col("intent"), F.col("complexity"))
    return df.withColumns(
        {
            "strategy": chosen["strategy"], "prompt_role": chosen["role"],
            "constraints": route_constraints(F.col("complexity"), language),
        }
    )


def truncate_at_sentence(text: Column, limit: Column | int, suffix: bool = True) -> Column:
    """Cut at the limit, back to the last full stop or else newline if that lies past 70 % of it."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    cut = F.substring(text, F.lit(1), limit)
    last = lambda char: F.length(cut) - F.length(F.substring_index(cut, char, -1)) - 1
    stop, newline = last("."), last("\n")
    return (
        F.when(stop > limit * 0.7, F.substring(cut, F.lit(1), stop + 1))
        .when(newline > limit * 0.7, F.substring(cut, F.lit(1), newline))
        .otherwise(F.concat(cut, F.lit("..." if suffix else "")))
    )


def strategy_limit(complexity: Column) -> Column:
    # Text limits by complexity.
    return F.when(complexity == "simple", 800).when(complexity == "moderate", 2000).otherwise(5000)


def strip_question_lines(text: Column, questions: Column) -> Column:
    """Lines that ask something leave the text; the first three distinct questions are kept."""
    rows = F.split(text, r"\r?\n")
    asks = lambda s: strip(s).startswith("¿") | F.contains(s, F.lit("?"))
    kept = strip(F.array_join(F.filter(rows, lambda s: ~asks(s)), "\n"))
    moved = F.transform(F.filter(rows, asks), lambda s: squeeze(strip(s)))
    existing = F.coalesce(questions, F.array().cast("array<string>"))
    return F.struct(
        F.when(kept != "", kept).otherwise(strip(text)).alias("improved_prompt"),
        F.slice(dedup_ignore_case(F.concat(existing, moved)), 1, 3).alias("clarifying_questions"),
    )


def expand_examples(components: DataFrame, per_component: int = 3, variation: str | None = None, seed: int = 0) -> DataFrame:
    """Several examples per component; templates are picked by a hash of component, number and seed."""
    c = F.col
    domain = F.when(c("domain").isin(fixed.DOMAINS), c("domain")).otherwise("other")
    clean = lambda name: F.regexp_replace(strip(text_or_empty(name)), r"\.+$", "")
    directive_default = options = None
    for name in fixed.DOMAINS:
        text = F.lit(fixed.DEFAULT_DIRECTIVES[name])
        array = F.array(*[F.lit(t) for t in fixed.EXAMPLE_TEMPLATES[name]])
        hit = domain == name
        directive_default = F.when(hit, text) if directive_default is None else directive_default.when(hit, text)
        options = F.when(hit, array) if options is None else options.when(hit, array)
    numbered = components.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(per_component - 1)))).withColumns(
        {
            "_domain": domain,
            "_role": F.when(clean("role") == "", "assistant").otherwise(clean("role")),
            "_directive": F.when(clean("directive") == "", directive_default).otherwise(clean("directive")),
        }
    )
    digest = F.md5(F.concat_ws("|", "source_file", "_domain", "_role", c("_i").cast("string"), F.lit(str(seed))))
    key = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    chosen = numbered.withColumn("_options", options).withColumn(
        "_template", F.get(c("_options"), F.pmod(key, F.size("_options").cast("long")).cast("int"))
    )
    text = fill(
        vary(c("_template"), variation),
        {"role": c("_role"), "directive": c("_directive"), "domain_lower": F.lower("_domain"), "framework": text_or_empty("framework")},
    )
    text = strip(F.replace(F.replace(text, F.lit(".."), F.lit(".")), F.lit("  "), F.lit(" ")))
    if variation:
        text = F.when(F.length(text) < 50, F.concat(text, F.lit(fixed.PADDING))).otherwise(text)
    text = F.when(text.rlike("[.!?]$"), text).otherwise(F.concat(text, F.lit(".")))
    return chosen.select(
        c("_i").alias("number"), c("_role").alias("role"), c("_directive").alias("directive"), text.alias("example"),
        F.struct(
            F.concat_ws(":", "source_file", "_domain").alias("source_component_id"),
            F.lit(variation or "base").alias("variation"), c("confidence"),
        ).alias("metadata"),
    )


def vary(template: Column, variation: str | None) -> Column:
    sentences = F.filter(F.transform(F.split(template, r"\."), strip), lambda s: s != "")
    if variation == "simplify":
        return F.when(F.contains(template, F.lit(".")), F.concat(F.substring_index(template, ".", 1), F.lit("."))).otherwise(template)
    if variation == "expand":
        chain = None
        for old, new in fixed.EXPANSIONS:
            hit, text = F.contains(template, F.lit(old)), F.replace(template, F.lit(old), F.lit(new))
            chain = F.when(hit, text) if chain is None else chain.when(hit, text)
        return chain.otherwise(F.concat(template, F.lit(fixed.EXPANSION_TAIL)))
    if variation == "add_context":
        return F.concat(template, F.lit(fixed.CONTEXT_TAIL))
    if variation == "restructure":
        swapped = F.concat(F.get(sentences, F.lit(1)), F.lit(". "), F.get(sentences, F.lit(0)), F.lit("."))
        return F.when(F.size(sentences) > 1, swapped).otherwise(template)
    return template


def aggregate_context(items: DataFrame, key: str) -> DataFrame:
    """Context sources of a request as one text, highest priority first, input order on ties.

    The text is one cell, so a request's sources must fit in one; error rows are dropped first.
    """
    block = F.concat(
        F.lit("### CONTEXT SOURCE: "), F.col("source"), F.lit(" (Category: "), F.col("category"), F.lit(")\n"), F.col("content")
    )
    entry = F.struct((-F.col("priority")).alias("rank"), F.col("pos"), block.alias("block"))
    return (
        items.filter(F.col("category") != "error")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(entry)).alias("_all"))
        .select(key, F.array_join(F.col("_all.block"), "\n\n---\n\n").alias("context"))
    )


def chat_messages(turns: DataFrame, session: str = "conv_id", chunk: int = 256) -> DataFrame:
    """Messages in turn order, nested in chunks of bounded size so a long session stays many rows."""
    entry = F.struct(F.col("turn"), F.col("role"), F.col("text").alias("content"))
    return (
        turns.groupBy(session, F.floor(F.col("turn") / chunk).alias("chunk"))
        .agg(F.array_sort(F.collect_list(entry)).alias("_m"))
        .select(session, "chunk", F.transform("_m", lambda m: F.struct(m["role"], m["content"])).alias("messages"))
    )


def nested_value(json: Column, path: str) -> Column:
    """Text of the value at a dotted path of a JSON text.

    Null where a part of the path is missing, where a part before the last is no object, for a JSON null,
    and for text that is no JSON. Objects and lists come as JSON text.
    """
    keys = "".join(f"[{chr(34)}{part}{chr(34)}]" for part in path.split("."))
    return F.try_variant_get(F.try_parse_json(json), f"${keys}", "string")
