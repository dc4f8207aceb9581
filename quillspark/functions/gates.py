"""Format, completeness and anti-filler gates as columns over one output text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from quillspark import fixed
from quillspark.functions.jsonudf import json_facts
from quillspark.functions.text import (
    WORD_CLASS, all_matches, any_of, count_present, contains_any, lines, rx, strip, word_count,
)

V02_GATES = ["A1_filler", "A4_repetition", "J1_empty", "P1_steps", "C1_specific", "E1_code"]


@dataclass(frozen=True)
class Thresholds:
    filler_count: int = 2
    filler_density: float = 0.35
    duplicate_ratio: float = 0.30
    min_lines: int = 6
    empty_leaf_ratio: float = 0.30
    empty_step_ratio: float = 0.30
    step_words: int = 4
    generic_bullet_ratio: float = 0.40
    bullet_words: int = 3
    code_lines: int = 3


def verdict(failed: Column) -> Column:
    return F.when(failed, "FAIL").otherwise("PASS")


def template_type(template: Column) -> Column:
    """Type of a template; an unknown template is handled as JSON without a format demand."""
    chain = None
    for name, spec in fixed.TEMPLATES.items():
        chain = F.when(template == name, spec["type"]) if chain is None else chain.when(template == name, spec["type"])
    return chain.otherwise("json")


def facts_for(text: Column, template: Column) -> Column:
    """JSON facts where a gate needs them; other rows pass null and cost the parser nothing."""
    return json_facts(F.when(template_type(template) == "json", text))


def format_gate(text: Column, template: Column, facts: Column) -> Column:
    low = F.lower(text)
    chain = F.when(template == "json", verdict(~(facts["valid"] & facts["truthy"])))
    for name, spec in fixed.TEMPLATES.items():
        if spec["sections"]:
            missing = any_of([~F.contains(low, F.lit(s.lower())) for s in spec["sections"]])
            chain = chain.when(template == name, verdict(missing))
    return chain.otherwise("PASS")


def completeness_gate(text: Column, template: Column, facts: Column) -> Column:
    kind = template_type(template)
    thin_json = ~facts["valid"] | F.coalesce(facts["key_count"] < 2, F.lit(False))
    return (
        F.when(kind == "json", verdict(thin_json))
        .when(kind == "procedure", verdict(F.regexp_count(text, F.lit(rx(fixed.STEP_LINE, "m"))) < 2))
        .when(kind == "checklist", verdict(F.regexp_count(text, F.lit(rx(fixed.BULLET_LINE, "m"))) < 3))
        .when(kind == "example", verdict(~F.contains(text, F.lit("```"))))
        .otherwise(verdict(F.length(strip(text)) < 100))
    )


def filler_count(text: Column) -> Column:
    return count_present(F.lower(text), fixed.FILLERS)


def content_density(text: Column) -> Column:
    """Share of ASCII letters and digits; 0 for empty text."""
    kept = F.length(F.regexp_replace(F.lower(text), "[^a-z0-9]+", ""))
    return F.coalesce(F.try_divide(kept, F.length(text)), F.lit(0.0))


def filler_gate(text: Column, t: Thresholds = Thresholds()) -> Column:
    count = filler_count(text)
    return verdict((count >= t.filler_count) | ((count == 1) & (content_density(text) < t.filler_density)))


def filler_score(text: Column) -> Column:
    return F.lit(1.0) - filler_count(text) / F.greatest(F.lit(1), word_count(text))


def content_lines(text: Column) -> Column:
    stripped = F.transform(lines(F.lower(text)), strip)
    return F.filter(stripped, lambda s: s != "")


def duplicate_ratio(text: Column) -> Column:
    rows = content_lines(text)
    bare = F.transform(rows, lambda s: F.regexp_replace(s, rx(r"[^\w\s]+"), ""))
    return F.lit(1) - F.size(F.array_distinct(bare)) / F.size(rows)


def repetition_gate(text: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(F.size(content_lines(text)) < t.min_lines, "SKIP").otherwise(
        verdict(duplicate_ratio(text) > t.duplicate_ratio)
    )


def empty_leaf_ratio(facts: Column) -> Column:
    """Empty scalars over all scalars of a JSON text; 1 where it holds none."""
    return F.coalesce(F.try_divide(facts["leaf_empty"], facts["leaf_total"]), F.lit(1.0))


def empty_value_gate(facts: Column, template: Column, t: Thresholds = Thresholds()) -> Column:
    required = fixed.TEMPLATES["json"]["required_keys"]
    unfilled = (facts["kind"] == "object") & any_of(
        [~F.array_contains(facts["filled_keys"], key) for key in required]
    )
    bad = ~facts["valid"] | (empty_leaf_ratio(facts) > t.empty_leaf_ratio) | F.coalesce(unfilled, F.lit(False))
    return F.when(template != "json", "SKIP").otherwise(verdict(bad))


def long_words(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(rf"(?<![{WORD_CLASS}])[a-z]{{4,}}(?![{WORD_CLASS}])"))


def steps(text: Column) -> Column:
    return all_matches(text, rx(fixed.STEP_LINE + "(.+)$", "m"), 1)


def bullets(text: Column) -> Column:
    return all_matches(text, rx(fixed.BULLET_LINE + "(.+)$", "m"), 1)


def empty_step_ratio(text: Column, t: Thresholds = Thresholds()) -> Column:
    weak = F.filter(
        steps(text),
        lambda s: (long_words(s) < t.step_words) | ~contains_any(F.lower(s), fixed.STEP_VERBS),
    )
    return F.try_divide(F.size(weak), F.size(steps(text)))


def step_gate(text: Column, template: Column, t: Thresholds = Thresholds()) -> Column:
    ratio = F.coalesce(empty_step_ratio(text, t), F.lit(1.0))
    return F.when(template_type(template) != "procedure", "SKIP").otherwise(verdict(ratio > t.empty_step_ratio))


def generic_bullet_ratio(text: Column, t: Thresholds = Thresholds()) -> Column:
    weak = F.filter(
        bullets(text),
        lambda b: (long_words(b) < t.bullet_words)
        | ~(F.contains(b, F.lit(":")) | b.rlike(rx(fixed.TECHNICAL_MARK, "i"))),
    )
    return F.try_divide(F.size(weak), F.size(bullets(text)))


def bullet_gate(text: Column, template: Column, t: Thresholds = Thresholds()) -> Column:
    ratio = F.coalesce(generic_bullet_ratio(text, t), F.lit(1.0))
    return F.when(template_type(template) != "checklist", "SKIP").otherwise(verdict(ratio > t.generic_bullet_ratio))


def code_blocks(text: Column) -> Column:
    return all_matches(text, rx(r"```[\w]*\n(.*?)\n```", "s"), 1)


def code_gate(text: Column, template: Column, t: Thresholds = Thresholds()) -> Column:
    def solid(block: Column) -> Column:
        code = F.filter(lines(block), lambda s: (strip(s) != "") & ~strip(s).startswith("#"))
        return (F.size(code) >= t.code_lines) & block.rlike(rx(fixed.CODE_MARK, "i"))

    blocks = code_blocks(text)
    good = (F.size(blocks) > 0) & F.forall(blocks, solid)
    return F.when(template_type(template) != "example", "SKIP").otherwise(verdict(~good))


def v02_gates(text: Column, template: Column, facts: Column, t: Thresholds = Thresholds()) -> dict[str, Column]:
    return {
        "A1_filler": filler_gate(text, t),
        "A4_repetition": repetition_gate(text, t),
        "J1_empty": empty_value_gate(facts, template, t),
        "P1_steps": step_gate(text, template, t),
        "C1_specific": bullet_gate(text, template, t),
        "E1_code": code_gate(text, template, t),
    }


def configured_status(gate: str, status: Column, template: Column) -> Column:
    """Status after the severity table: a gate that only warns turns its FAIL into WARN.

    Every newer gate only warns, but for empty values in the JSON template.
    """
    hard = (template == "json") if gate == "J1_empty" else F.lit(False)
    return F.when((status == "FAIL") & ~hard, "WARN").otherwise(status)


def overall_status(v01_pass: Column, fails: Column, warns: Column) -> Column:
    return F.when(~v01_pass | (fails > 0), "FAIL").when(warns > 0, "WARN").otherwise("PASS")


def summary_line(format_status: Column, completeness_status: Column, statuses: dict[str, Column]) -> Column:
    """The first failing gate in words, else the first warning one."""
    chain = F.when(format_status == "FAIL", fixed.GATE_SUMMARIES["format"]).when(
        completeness_status == "FAIL", fixed.GATE_SUMMARIES["completeness"]
    )
    for level, texts in (("FAIL", fixed.GATE_FAIL_TEXT), ("WARN", fixed.GATE_WARN_TEXT)):
        for gate, status in statuses.items():
            chain = chain.when(status == level, texts.get(gate, gate))
    return chain.otherwise(fixed.GATE_SUMMARIES["valid"])
