"""Gate boundaries on hand-written texts."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import gates as G, jsonudf
from quillspark.operators import gating

LONG_STEP = "Create and validate the input file before running"
CASES = [
    # text, template, gate, status
    ("tbd todo " + "word " * 20, "json", "A1_filler", "FAIL"),
    ("tbd " + "word " * 20, "json", "A1_filler", "PASS"),
    ("tbd !!!!!!!!!!!!!!!!!!!!", "json", "A1_filler", "FAIL"),
    ("a\nb\nc\nd\ne", "json", "A4_repetition", "SKIP"),
    ("a\nb\nc\nd\ne\nf", "json", "A4_repetition", "PASS"),
    ("a\na!\nA\nb\nc\nd", "json", "A4_repetition", "FAIL"),
    ('{"prompt": "p", "role": "r", "context": "c"}', "json", "J1_empty", "PASS"),
    ('{"prompt": "p", "role": "", "context": "c"}', "json", "J1_empty", "FAIL"),
    ('{"prompt": "p", "role": "r", "context": {"a": [null, null, 1]}}', "json", "J1_empty", "FAIL"),
    ('{"prompt": "p", "role": "r", "context": []}', "json", "J1_empty", "FAIL"),
    ("[1, 2]", "json", "J1_empty", "PASS"),
    ("{'a': 1}", "json", "J1_empty", "FAIL"),
    ("text", "example_md", "J1_empty", "SKIP"),
    (f"1. {LONG_STEP}\n2. {LONG_STEP}\n3. {LONG_STEP}\n4. tbd", "procedure_md", "P1_steps", "PASS"),
    (f"1. {LONG_STEP}\n2. tbd", "procedure_md", "P1_steps", "FAIL"),
    ("no steps", "procedure_md", "P1_steps", "FAIL"),
    ("- Check the api: first test case\n- Verify the config: second file\n- x", "checklist_md", "C1_specific", "PASS"),
    ("- Check the api: first test case\n- thing", "checklist_md", "C1_specific", "FAIL"),
    ("```python\ndef f(x):\n    return x\nassert f(1)\n```", "example_md", "E1_code", "PASS"),
    ("```python\ndef f(x):\n    # note\n    return x\n```", "example_md", "E1_code", "FAIL"),
    ("```\none\ntwo\nthree\n```", "example_md", "E1_code", "FAIL"),
    ("no code", "example_md", "E1_code", "FAIL"),
]
HARD = [
    ("{}", "json", "FAIL", "FAIL"), ('{"a": 1}', "json", "PASS", "FAIL"), ('{"a": 1, "b": NaN}', "json", "PASS", "PASS"),
    ('{"a": 1} x', "json", "FAIL", "FAIL"), ("[1]", "json", "PASS", "PASS"), ("## checklist\n- a\n- b\n- c", "checklist_md", "PASS", "PASS"),
    ("## Checklist\n- a\n- b", "checklist_md", "PASS", "FAIL"), ("text", "example_md", "PASS", "FAIL"), ("a ``` b", "example_md", "PASS", "PASS"),
    ("## objetivo\n## PASOS\n## Criterios\n1. a\n 2. b", "procedure_md", "PASS", "PASS"), ("x", "unknown", "PASS", "FAIL"),
]


@pytest.fixture(scope="module")
def report(spark):
    rows = [(i, t, k) for i, (t, k, *_) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id long, text string, template string")
    return {r.id: r for r in gating.gate_report(df, "text", "template", early_exit=False).collect()}


@pytest.mark.parametrize("number", range(len(CASES)))
def test_newer_gates(report, number):
    text, _, gate, status = CASES[number]
    assert report[number][gate] == status, text


def test_hard_gates(spark):
    df = spark.createDataFrame([(i, t, k) for i, (t, k, *_) in enumerate(HARD)], "id long, text string, template string")
    for r in gating.gate_report(df, "text", "template").collect():
        assert (r.gate1_format, r.gate2_completeness) == HARD[r.id][2:], HARD[r.id]


def test_configured_severity_warns(spark):
    text = "## Checklist\n- thing\n- stuff\n- item"
    df = spark.createDataFrame([(1, text, "checklist_md")], "id long, text string, template string")
    plain = gating.gate_report(df, "text", "template").first()
    soft = gating.gate_report(df, "text", "template", severity="configured").first()
    assert (plain.A1_filler, plain.overall_status) == ("FAIL", "FAIL")
    assert (soft.A1_filler, soft.overall_status) == ("WARN", "WARN")
    assert soft.summary == "Posibles placeholders detectados"


def test_leaf_counts_match_recursion():
    def walk(v):
        if isinstance(v, dict):
            return tuple(map(sum, zip((0, 0), *map(walk, v.values()))))
        if isinstance(v, list):
            return tuple(map(sum, zip((0, 0), *map(walk, v))))
        return 1, int(v in ("", None))

    for text in ['{"a": [1, "", {"b": null}], "c": {}}', "[]", '"x"', "null", "0", "[[[]]]"]:
        value = json.loads(text)
        assert jsonudf.leaf_counts(value) == walk(value)


@pytest.mark.parametrize(
    "text,want",
    [("a {\"x\": \"}\"} b", '{"x": "}"}'), ('{"a": "\\"}"} tail', '{"a": "\\"}"}'), ("{ {} ", None), ("none", None), ("} {1}", "{1}")],
)
def test_balanced_object(text, want):
    assert jsonudf.balanced_object(text) == want
