"""Severities and priorities out of tables."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import classify, gates as G
from quillspark.operators import gating, rules

SEVERITIES = "gate string, template string, severity string"


def test_two_changed_severities(spark):
    text = "\n".join(["same line"] * 8 + ["```", "x", "```"])
    docs = spark.createDataFrame([(1, text, "example_md"), (2, text, "other"), (3, None, "example_md")], "id int, text string, template string")
    report = lambda **k: {r["id"]: r for r in gating.gate_report(docs, "text", "template", early_exit=False, **k).collect()}
    plain = report()
    assert (plain[1]["A4_repetition"], plain[1]["E1_code"], plain[2]["A4_repetition"]) == ("FAIL", "FAIL", "FAIL")
    table = spark.createDataFrame([("A4_repetition", "*", "WARN"), ("A4_repetition", "other", "FAIL"), ("E1_code", "example_md", "WARN")], SEVERITIES)
    got = report(severity=table)
    assert (got[1]["A4_repetition"], got[1]["E1_code"], got[2]["A4_repetition"]) == ("WARN", "WARN", "FAIL")
    assert (got[1]["v02_fail_count"], got[1]["v02_warn_count"]) == (plain[1]["v02_fail_count"] - 2, 2)
    assert report(severity=table.filter("false")) == plain


def test_own_gates_count(spark):
    docs = spark.createDataFrame([(1, "long enough " * 20, "other"), (2, "x", "other")], "id int, text string, template string")
    own = {"Z_short": lambda text, template, facts: G.verdict(F.length(text) < 5)}
    table = spark.createDataFrame([("Z_short", "*", "WARN")], SEVERITIES)
    hard = {r["id"]: r for r in gating.gate_report(docs, "text", "template", early_exit=False, own=own).collect()}
    soft = {r["id"]: r for r in gating.gate_report(docs, "text", "template", severity=table, early_exit=False, own=own).collect()}
    assert [hard[i]["Z_short"] for i in (1, 2)] == ["PASS", "FAIL"] and soft[2]["Z_short"] == "WARN"
    assert hard[2]["v02_fail_count"] == soft[2]["v02_fail_count"] + 1 and soft[2]["v02_warn_count"] == 1


def test_wrong_tables_are_refused(spark):
    status, template = F.lit("FAIL"), F.lit("json")
    rows = lambda *r: rules.rule_rows(spark.createDataFrame(list(r), SEVERITIES), "gate", "template", "severity")
    with pytest.raises(ValueError, match="two severities"):
        rules.table_status(rows(("A", "*", "WARN"), ("A", "*", "FAIL")), "A", status, template)
    with pytest.raises(ValueError, match="unknown severity"):
        rules.table_status(rows(("A", "*", "SOFT")), "A", status, template)
    with pytest.raises(ValueError, match="more than"):
        rules.rule_rows(spark.range(rules.MOST_RULES + 1), "id")


def test_file_rules_in_order(spark):
    table = spark.createDataFrame([(2, "agent", 4, "a"), (1, "Rule", 9, "r"), (2, "b", 3, "b")], "place int, keyword string, priority int, category string")
    names = spark.createDataFrame([("AGENT-rule.md",), ("agent-b",), ("b",), ("x",), (None,)], "name string")
    place = lambda *r: [tuple(x["p"]) for x in names.select(classify.file_priority(F.col("name"), *r).alias("p")).collect()]
    assert place(rules.file_rules(table)) == [(9, "r"), (4, "a"), (3, "b"), (1, "general"), (1, "general")]
    assert place(rules.file_rules(table.filter("false"))) == [(1, "general")] * 5
    assert place()[:2] == [(5, "instruction"), (4, "agent")]
