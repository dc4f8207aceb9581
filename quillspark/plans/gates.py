"""Queries over quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import fixed
from quillspark.functions import gates as G
from quillspark.functions.jsonudf import json_facts
from quillspark.operators import gating as O
from quillspark.operators.ordered import literal_rows
from quillspark.plans.common import (
    SPACE, WORD, count_terms, has, over_history, py, q, query, re_any, rounded, strip_sql, words_sql,
)
from quillspark.sources import views

T = G.Thresholds()


def filler_sql(text: str) -> tuple[str, str, str]:
    count = count_terms(f"lower({text})", fixed.FILLERS)
    density = f"CASE WHEN length({text}) = 0 THEN 0e0 ELSE length(regexp_replace(lower({text}), '[^a-z0-9]+', '', 'g'))::DOUBLE / length({text}) END"
    status = f"CASE WHEN {count} >= 2 OR ({count} = 1 AND {density} < 0.35e0) THEN 'FAIL' ELSE 'PASS' END"
    return count, density, status


def lines_sql(text: str) -> str:
    return f"list_filter(list_transform(string_split(lower({text}), chr(10)), lambda s: {strip_sql('s')}), lambda s: s <> '')"


def duplicate_sql(text: str) -> str:
    rows = lines_sql(text)
    odd = q("[^" + WORD[1:-1] + SPACE[1:-1] + "]+")
    return f"(1e0 - len(list_distinct(list_transform({rows}, lambda s: regexp_replace(s, {odd}, '', 'g'))))::DOUBLE / len({rows}))"


def repetition_sql(text: str) -> str:
    return f"CASE WHEN len({lines_sql(text)}) < 6 THEN 'SKIP' WHEN {duplicate_sql(text)} > 0.3e0 THEN 'FAIL' ELSE 'PASS' END"


@query(
    "gate_filler",
    f"""SELECT doc_id, {filler_sql("text")[0]} AS filler_count, round({filler_sql("text")[1]}, 6) AS density, {filler_sql("text")[2]} AS status,
    round(1e0 - {filler_sql("text")[0]}::DOUBLE / greatest(1, len({words_sql("text")})), 6) AS score FROM documents""",
)
def gate_filler(spark, folder):
    t = F.col("text")
    df = views.documents(spark, folder).select(
        "doc_id", G.filler_count(t).alias("filler_count"), G.content_density(t).alias("density"),
        G.filler_gate(t).alias("status"), G.filler_score(t).alias("score"),
    )
    return rounded(df, "density", "score")


@query(
    "gate_repetition",
    f"""SELECT doc_id, len({lines_sql("text")})::INT AS line_count, {repetition_sql("text")} AS status,
    CASE WHEN len({lines_sql("text")}) >= 6 THEN round({duplicate_sql("text")}, 6) END AS duplicate_ratio FROM documents""",
)
def gate_repetition(spark, folder):
    t = F.col("text")
    df = views.documents(spark, folder).select("doc_id", "text", G.content_lines(t).alias("_l"))
    return rounded(
        df.select(
            "doc_id", F.size("_l").alias("line_count"), G.repetition_gate(t).alias("status"),
            F.when(F.size("_l") >= T.min_lines, G.duplicate_ratio(t)).alias("duplicate_ratio"),
        ),
        "duplicate_ratio",
    )


X = "improved_prompt"
TRUTHY = f"(json_valid({X}) AND {strip_sql(X)} NOT IN ('{{}}', '[]', '\"\"', '0', '0.0', '-0', 'false', 'null'))"
FORMAT_SQL = (
    f"CASE WHEN template_id = 'json' THEN CASE WHEN {TRUTHY} THEN 'PASS' ELSE 'FAIL' END "
    + " ".join(
        f"WHEN template_id = '{n}' THEN CASE WHEN "
        + " AND ".join(f"contains(lower({X}), {q(s.lower())})" for s in spec["sections"])
        + " THEN 'PASS' ELSE 'FAIL' END"
        for n, spec in fixed.TEMPLATES.items()
        if spec["sections"]
    )
    + " ELSE 'PASS' END"
)
STEP, BULLET = py(fixed.STEP_LINE), py(fixed.BULLET_LINE)
COMPLETE_SQL = f"""CASE template_id
  WHEN 'json' THEN CASE WHEN NOT json_valid({X}) THEN 'FAIL'
    WHEN json_type({X}) = 'OBJECT' AND len(json_keys({X})) < 2 THEN 'FAIL' ELSE 'PASS' END
  WHEN 'procedure_md' THEN CASE WHEN len(regexp_extract_all({X}, {q("(?m)" + STEP)})) < 2 THEN 'FAIL' ELSE 'PASS' END
  WHEN 'checklist_md' THEN CASE WHEN len(regexp_extract_all({X}, {q("(?m)" + BULLET)})) < 3 THEN 'FAIL' ELSE 'PASS' END
  ELSE CASE WHEN contains({X}, '```') THEN 'PASS' ELSE 'FAIL' END END"""
LONG_WORDS = lambda s: f"len(list_filter(regexp_extract_all(lower({s}), {q(WORD + '+')}), lambda w: regexp_full_match(w, '[a-z]{{4,}}')))"
STEPS = f"regexp_extract_all({X}, {q('(?m)' + STEP + '(.+)$')}, 1)"
BULLETS = f"regexp_extract_all({X}, {q('(?m)' + BULLET + '(.+)$')}, 1)"
STEP_RATIO = f"(len(list_filter({STEPS}, lambda s: {LONG_WORDS('s')} < 4 OR NOT {has('lower(s)', fixed.STEP_VERBS)}))::DOUBLE / len({STEPS}))"
BULLET_RATIO = f"(len(list_filter({BULLETS}, lambda s: {LONG_WORDS('s')} < 3 OR NOT (contains(s, ':') OR {re_any('s', [fixed.TECHNICAL_MARK])})))::DOUBLE / len({BULLETS}))"
BLOCKS = f"regexp_extract_all({X}, {q('(?s)```' + WORD + '*' + chr(92) + 'n(.*?)' + chr(92) + 'n```')}, 1)"
CODE_LINES = f"len(list_filter(string_split(b, chr(10)), lambda s: {strip_sql('s')} <> '' AND NOT starts_with({strip_sql('s')}, '#')))"
GOOD_BLOCKS = f"list_filter({BLOCKS}, lambda b: {CODE_LINES} >= 3 AND {re_any('b', [fixed.CODE_MARK])})"
V02_SQL = {
    "A1_filler": filler_sql(X)[2],
    "A4_repetition": repetition_sql(X),
    # in this view JSON is valid in the last variant alone, and filled for even conversations
    "J1_empty": "CASE WHEN template_id <> 'json' THEN 'SKIP' WHEN variant = 5 AND conv_id % 2 = 0 THEN 'PASS' ELSE 'FAIL' END",
    "P1_steps": f"CASE WHEN template_id <> 'procedure_md' THEN 'SKIP' WHEN len({STEPS}) = 0 OR {STEP_RATIO} > 0.3e0 THEN 'FAIL' ELSE 'PASS' END",
    "C1_specific": f"CASE WHEN template_id <> 'checklist_md' THEN 'SKIP' WHEN len({BULLETS}) = 0 OR {BULLET_RATIO} > 0.4e0 THEN 'FAIL' ELSE 'PASS' END",
    "E1_code": f"CASE WHEN template_id <> 'example_md' THEN 'SKIP' WHEN len({BLOCKS}) > 0 AND len({GOOD_BLOCKS}) = len({BLOCKS}) THEN 'PASS' ELSE 'FAIL' END",
}


def report_sql(configured: bool, early_exit: bool = True, hard_when=None, own=None) -> str:
    cols, gates, own = [], V02_SQL | (own or {}), own or {}
    for gate, sql in gates.items():
        if configured:
            hard = (hard_when or {"J1_empty": "template_id = 'json'"}).get(gate, "false")
            sql = f"CASE WHEN ({sql}) = 'FAIL' AND NOT {hard} THEN 'WARN' ELSE ({sql}) END"
        cols.append(f"CASE WHEN {'v01_pass' if early_exit else 'true'} THEN {sql} ELSE 'SKIP' END AS {gate}")
    count = lambda level: " + ".join(f"({g} = '{level}')::INT" for g in gates)
    summary = (
        f"CASE WHEN gate1_format = 'FAIL' THEN {q(fixed.GATE_SUMMARIES['format'])} WHEN gate2_completeness = 'FAIL' THEN {q(fixed.GATE_SUMMARIES['completeness'])} "
        + " ".join(f"WHEN {g} = 'FAIL' THEN {q(t)}" for g, t in [*fixed.GATE_FAIL_TEXT.items(), *((g, g) for g in own)]) + " "
        + " ".join(f"WHEN {g} = 'WARN' THEN {q(t)}" for g, t in [*fixed.GATE_WARN_TEXT.items(), *((g, g) for g in own)])
        + f" ELSE {q(fixed.GATE_SUMMARIES['valid'])} END"
    )
    return f"""v_report AS (
      SELECT *, v01_pass AND v02_fail_count = 0 AS overall_pass,
        CASE WHEN NOT v01_pass OR v02_fail_count > 0 THEN 'FAIL' WHEN v02_warn_count > 0 THEN 'WARN' ELSE 'PASS' END AS overall_status,
        {summary} AS summary
      FROM (SELECT *, {count("FAIL")} AS v02_fail_count, {count("WARN")} AS v02_warn_count FROM (
        SELECT *, {", ".join(cols)} FROM (
          SELECT *, gate1_format = 'PASS' AND gate2_completeness = 'PASS' AS v01_pass FROM (
            SELECT *, {FORMAT_SQL} AS gate1_format, {COMPLETE_SQL} AS gate2_completeness FROM v_history)))))"""


REPORT_COLUMNS = [
    "gate1_format", "gate2_completeness", *G.V02_GATES, "v01_pass", "v02_fail_count", "v02_warn_count", "overall_pass",
    "overall_status", "summary",
]


def _report(spark, folder, severity="reference", early_exit=True):
    return O.gate_report(views.history(spark, folder), X, "template_id", severity=severity, early_exit=early_exit)


@query("gate_report", over_history("").rstrip() + f", {report_sql(False)} SELECT id, template_id, {', '.join(REPORT_COLUMNS)} FROM v_report")
def gate_report(spark, folder):
    return _report(spark, folder).select("id", "template_id", *REPORT_COLUMNS)


@query(
    "gate_report_configured",
    over_history("").rstrip() + f", {report_sql(True)} SELECT id, template_id, {', '.join(REPORT_COLUMNS)} FROM v_report",
)
def gate_report_configured(spark, folder):
    return _report(spark, folder, "configured").select("id", "template_id", *REPORT_COLUMNS)


# repetition fails in procedures, empty values only warn, and the gate of this query fails everywhere but in JSON
SEVERITY_ROWS = [
    ("A1_filler", "*", "WARN"), ("A4_repetition", "*", "WARN"), ("A4_repetition", "procedure_md", "FAIL"), ("J1_empty", "*", "WARN"),
    ("P1_steps", "*", "WARN"), ("C1_specific", "*", "FAIL"), ("E1_code", "*", "WARN"), ("L1_length", "json", "WARN"),
]
SEVERITY_HARD = {"A4_repetition": "template_id = 'procedure_md'", "C1_specific": "true", "L1_length": "template_id <> 'json'"}
LENGTH_SQL = {"L1_length": f"CASE WHEN length({X}) > 400 THEN 'FAIL' ELSE 'PASS' END"}


@query(
    "gate_report_severity_table",
    over_history("").rstrip()
    + f", {report_sql(True, False, SEVERITY_HARD, LENGTH_SQL)} SELECT id, template_id, {', '.join(REPORT_COLUMNS)}, L1_length FROM v_report",
)
def gate_report_severity_table(spark, folder):
    """Severities out of a table, and a gate of one's own."""
    table = literal_rows(spark, SEVERITY_ROWS, ["gate", "template", "severity"])
    own = {"L1_length": lambda text, template, facts: G.verdict(F.length(text) > 400)}
    report = O.gate_report(views.history(spark, folder), X, "template_id", severity=table, early_exit=False, own=own)
    return report.select("id", "template_id", *REPORT_COLUMNS, "L1_length")


@query(
    "gate_results_long",
    over_history("").rstrip()
    + f", {report_sql(False)} SELECT gate, status, count(*) AS n FROM (SELECT unnest({list(REPORT_COLUMNS[:8])!r}) AS gate, unnest([{', '.join(REPORT_COLUMNS[:8])}]) AS status FROM v_report) GROUP BY ALL",
)
def gate_results_long(spark, folder):
    return O.long_results(_report(spark, folder), "id").groupBy("gate", "status").agg(F.count("*").alias("n"))


RATES_SQL = f"""v_rates AS (SELECT gate, count(*) AS evaluated, count(*) FILTER (status = 'FAIL') AS fail_count,
  count(*) FILTER (status = 'WARN') AS warn_count, count(*) FILTER (status = 'FAIL')::DOUBLE / count(*) AS fail_rate,
  count(*) FILTER (status = 'WARN')::DOUBLE / count(*) AS warn_rate
  FROM (SELECT unnest({G.V02_GATES!r}) AS gate, unnest([{', '.join(G.V02_GATES)}]) AS status FROM v_report) GROUP BY gate)"""


@query(
    "gate_rates",
    over_history("").rstrip()
    + f", {report_sql(True, False)}, {RATES_SQL} SELECT gate, evaluated, fail_count, warn_count, round(fail_rate, 6) AS fail_rate, round(warn_rate, 6) AS warn_rate FROM v_rates",
)
def gate_rates(spark, folder):
    return rounded(O.gate_rates(_report(spark, folder, "configured", False)), "fail_rate", "warn_rate")


@query(
    "gate_totals",
    over_history("").rstrip()
    + f", {report_sql(False)} SELECT count(*) AS total_evaluated, count(*) FILTER (v01_pass) AS v01_pass_count, 0 AS skipped_count, round(count(*) FILTER (v01_pass)::DOUBLE / count(*), 6) AS v01_pass_rate FROM v_report",
)
def gate_totals(spark, folder):
    docs = views.history(spark, folder)
    return rounded(O.evaluation_totals(docs, _report(spark, folder), X), "v01_pass_rate")


def _advice_sql() -> str:
    rows = ", ".join(f"({q(g)}, {q(n)}, {v}::DOUBLE, {q(t)})" for g, (n, v, t) in fixed.GATE_ADVICE.items())
    return f"""SELECT gate, CASE WHEN fail_rate >= 0.5 THEN 'high_fail_rate' ELSE 'high_warn_rate' END AS issue,
      round(CASE WHEN fail_rate >= 0.5 THEN fail_rate ELSE warn_rate END, 6) AS current_rate,
      CASE WHEN fail_rate >= 0.5 THEN coalesce(t, 'Adjust threshold for ' || gate || ' (more_lenient)') ELSE {q(fixed.WARN_ADVICE)} END AS recommendation,
      CASE WHEN fail_rate >= 0.5 THEN n END AS threshold_name, CASE WHEN fail_rate >= 0.5 THEN v END AS threshold_value
    FROM v_rates LEFT JOIN (VALUES {rows}) a(gate, n, v, t) USING (gate) WHERE fail_rate >= 0.5 OR warn_rate >= 0.7"""


# every document read as procedure and checklist by turns, so that both gates have work
DOCS_REPORT = f"""docs AS (SELECT doc_id AS id, doc_id AS conv_id, 0 AS variant, text AS improved_prompt, CASE WHEN doc_id % 2 = 0 THEN 'procedure_md' ELSE 'checklist_md' END AS template_id FROM documents)"""


def docs_report_sql() -> str:
    return f"WITH {DOCS_REPORT}, " + report_sql(False, False).replace("FROM v_history", "FROM docs")


def _docs_report(spark, folder):
    docs = views.documents(spark, folder).select(
        F.col("doc_id").alias("id"), F.col("text").alias(X),
        F.when(F.col("doc_id") % 2 == 0, "procedure_md").otherwise("checklist_md").alias("template_id"),
    )
    return O.gate_report(docs, X, "template_id", early_exit=False)


@query("threshold_advice", docs_report_sql() + f", {RATES_SQL} {_advice_sql()}")
def threshold_advice(spark, folder):
    return rounded(O.threshold_advice(O.gate_rates(_docs_report(spark, folder))), "current_rate")


@query(
    "gate_status",
    docs_report_sql()
    + f", {RATES_SQL} SELECT gate, round(fail_rate, 6) AS fail_rate, round(warn_rate, 6) AS warn_rate, CASE WHEN fail_rate > 0.5 THEN 'NEEDS TUNING' WHEN warn_rate > 0.7 THEN 'HIGH WARN RATE' ELSE 'GOOD' END AS status FROM v_rates WHERE gate IN ({', '.join(q(g) for g in fixed.GATE_ADVICE)})",
)
def gate_status(spark, folder):
    return rounded(O.gate_status(O.gate_rates(_docs_report(spark, folder))), "fail_rate", "warn_rate")


ORDER_JSON = """SELECT o_orderkey, o_custkey % 3 AS a, o_custkey % 4 AS b, o_custkey % 5 AS c FROM orders"""


@query(
    "gate_empty_values",
    f"""SELECT o_orderkey, round(CASE WHEN a = 1 THEN 1e0 / 4 ELSE 0e0 END + CASE WHEN b = 1 THEN 1e0 / 4 ELSE 0e0 END, 6) AS empty_ratio,
    CASE WHEN a = 1 OR c = 1 THEN 'FAIL' ELSE 'PASS' END AS status FROM ({ORDER_JSON})""",
)
def gate_empty_values(spark, folder):
    order = views.table(spark, folder, "orders")
    c = F.col("o_custkey")
    text = F.concat(
        F.lit('{"prompt": "order '), F.col("o_orderkey").cast("string"), F.lit('", "role": '),
        F.when(c % 3 == 1, '""').otherwise('"clerk"'), F.lit(', "context": {"list": ['),
        F.when(c % 4 == 1, "null").otherwise("1"), F.lit('], "deep": {"x": 0}}, "extra": {}'), F.lit("}"),
    )
    # a context that is an empty container has no leaves of its own, yet leaves the key unfilled
    text = F.when(c % 5 == 1, F.concat(
        F.lit('{"prompt": "p", "role": '), F.when(c % 3 == 1, '""').otherwise('"clerk"'), F.lit(', "context": [], "other": ['),
        F.when(c % 4 == 1, "null").otherwise("1"), F.lit(", 2]}"),
    )).otherwise(text)
    facts = order.select("o_orderkey", json_facts(text).alias("f"))
    return rounded(
        facts.select(
            "o_orderkey", G.empty_leaf_ratio(F.col("f")).alias("empty_ratio"),
            G.empty_value_gate(F.col("f"), F.lit("json")).alias("status"),
        ),
        "empty_ratio",
    )


@query(
    "json_facts",
    """SELECT event_id, json_valid(props) AS valid, json_type(props) = 'OBJECT' AS is_object, len(json_keys(props))::INT AS key_count FROM events""",
)
def json_facts_query(spark, folder):
    facts = views.table(spark, folder, "events").select("event_id", json_facts(F.col("props")).alias("f"))
    return facts.select("event_id", "f.valid", (F.col("f.kind") == "object").alias("is_object"), "f.key_count")
