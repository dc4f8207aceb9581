"""Queries over validation, constraint scores and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import fixed
from quillspark.functions import checks as C, classify as K, gates as G
from quillspark.operators import analyze as A, normalize as N, rules, validate as V
from quillspark.operators.ordered import literal_rows
from quillspark.plans.common import (
    SPACE, WORD, count_terms, first_sql, has, lines_literal, over_history, pick_sql, py, q, query, re_any, rounded, strip_sql,
    sum_sql, words_sql,
)
from quillspark.sources import views

LOOKS_JSON = lambda t: f"(regexp_matches({strip_sql(t)}, {q('^[{' + chr(92) + '[' + chr(34) + ']')}) OR {strip_sql(t)} IN ('true', 'false', 'null'))"


def ifeval_sql(table: str, key: str, text: str) -> str:
    return f"""v_ifeval AS (SELECT *, (ok_min_length::INT + ok_action_verbs::INT + ok_json_format::INT)::DOUBLE / 3 AS score FROM (
      SELECT {key}, length({strip_sql(text)}) >= 50 AS ok_min_length, {has(f"lower({text})", fixed.IFEVAL_VERBS)} AS ok_action_verbs,
        NOT {LOOKS_JSON(text)} OR json_valid({text}) AS ok_json_format FROM {table}))"""


@query(
    "ifeval_scores",
    over_history("").rstrip()
    + f", {ifeval_sql('v_history', 'id', 'improved_prompt')} SELECT id, ok_min_length, ok_action_verbs, ok_json_format, round(score, 6) AS score, score >= 0.7e0 AS passed FROM v_ifeval",
)
def ifeval_scores(spark, folder):
    df = V.ifeval(views.history(spark, folder), "improved_prompt")
    return rounded(df.select("id", "ok_min_length", "ok_action_verbs", "ok_json_format", "score", "passed"), "score")


@query(
    "ifeval_calibration",
    f"""WITH {ifeval_sql("documents", "doc_id", "text")}, r AS (SELECT *, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS c FROM v_ifeval),
    s AS (SELECT median(score) AS med, max(score) FILTER (i = floor(c * 0.6e0)) AS p60 FROM r),
    t AS (SELECT *, CASE WHEN p60 >= 0.67e0 THEN 0.67e0 WHEN med >= 0.5e0 THEN round_even(med, 2) ELSE 0.5e0 END AS threshold FROM s)
    SELECT count(*) AS n, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score,
      round(stddev_samp(score), 6) AS std_dev,
      {", ".join(f"count(*) FILTER (abs(score - {k}e0 / 3) < 1e-9) AS bucket_{k}_of_3" for k in range(4))},
      round(any_value(med), 6) AS median_score, round(any_value(p60), 6) AS p60, any_value(threshold) AS threshold,
      count(*) FILTER (score >= threshold) AS pass_count, round(count(*) FILTER (score >= threshold)::DOUBLE / count(*), 6) AS pass_rate
    FROM v_ifeval, t""",
)
def ifeval_calibration(spark, folder):
    scores = V.ifeval(views.documents(spark, folder).select("doc_id", "text"), "text").select("score")
    return rounded(
        A.calibration(scores), "min_score", "max_score", "mean_score", "std_dev", "median_score", "p60", "pass_rate"
    )


# --- example validation --------------------------------------------------------------------------

TASKS = [*fixed.TASK_TYPES, "unknown_task"]
META_SQL = f"{pick_sql('(doc_id % 6)', TASKS)} AS task_type, CASE WHEN doc_id % 11 <> 0 THEN source END AS domain, ((doc_id * 7) % 120)::DOUBLE / 100e0 AS confidence"
SPECIAL = q("[a-zA-Z0-9" + SPACE[1:-1] + r".,!?;:\-'" + '"()]+')
PAREN = lambda c: f"(length(text) - length(replace(text, '{c}', '')))"
SORTED_WORDS = f"list_sort(list_filter({words_sql('lower(text)')}, lambda w: length(w) > 3))"
ERRORS_SQL = " + ".join(
    f"({c})::INT"
    for c in [
        "domain IS NULL", "task_type = 'unknown_task'", "confidence > 1", "length(text) < 50", "length(text) > 5000",
        f"({strip_sql('text')} = '' OR regexp_matches(text, {q('^' + SPACE + '*[.]+' + SPACE + '*$')}))",
        *[f"contains(lower(text), {q(f.lower())})" for f in fixed.NAMED_FRAMEWORKS],
        f"length(regexp_replace(text, {SPECIAL}, '', 'g'))::DOUBLE / length(text) > 0.3e0",
        f"{PAREN('(')} <> {PAREN(')')}",
        "len(list_filter(range(1, greatest(len(ws) - 2, 1)), lambda i: ws[i] = ws[i + 3])) > 0",
    ]
)


def lexical_sql(text: str, tail: str) -> str:
    chars = f"len(list_distinct(regexp_extract_all({text}, '(?s).')))"
    ws = words_sql(text)
    return f"""CASE WHEN length({text}) > 0 AND {chars}::DOUBLE / length({text}) < 0.05e0 THEN 0.2e0
      WHEN len({ws}) > 0 AND len(list_distinct({ws}))::DOUBLE / len({ws}) < 0.2e0 THEN 0.3e0
      ELSE greatest(0e0, least(1e0, 0.5e0 + least(1e0, length({text}) / 200e0) * 0.2e0
        + least(0.15e0, {count_terms(f"lower({text})", fixed.SCORE_CONTEXT_WORDS)} * 0.03e0)
        + least(0.1e0, {count_terms(f"lower({text})", fixed.SCORE_ACTION_WORDS)} * 0.02e0) + {tail})) END"""


SYNTHETIC_SQL = f"""WITH d AS (SELECT doc_id, text, {SORTED_WORDS} AS ws, {META_SQL} FROM documents),
  e AS (SELECT *, {ERRORS_SQL} AS errors FROM d),
  v AS (SELECT *, {lexical_sql("text", f"(least(0.1e0, {count_terms('lower(text)', fixed.SCORE_LIMIT_WORDS)} * 0.02e0) + confidence * 0.1e0 + CASE WHEN task_type <> 'unknown_task' THEN 0.05e0 ELSE 0e0 END - errors * 0.2e0)")} AS score FROM e)"""


def synthetic(spark, folder):
    doc = F.col("doc_id")
    return V.validate_synthetic(
        views.documents(spark, folder).select(
            "doc_id", F.col("text").alias("question"),
            F.struct(
                views.pick(doc % 6, TASKS).alias("task_type"),
                F.when(doc % 11 != 0, F.col("source")).alias("domain"),
                ((doc * 7 % 120) / 100.0).alias("confidence"),
                doc.cast("string").alias("source_component_id"), F.lit("base").alias("variation"),
            ).alias("metadata"),
        )
    )


@query(
    "example_validation",
    f"{SYNTHETIC_SQL} SELECT doc_id, errors AS error_count, round(score, 6) AS score, errors = 0 AND score > 0.5e0 AS is_valid FROM v",
)
def example_validation(spark, folder):
    df = synthetic(spark, folder).select("doc_id", F.size("errors").alias("error_count"), "score", "is_valid")
    return rounded(df, "score")


@query(
    "example_batch_stats",
    f"""{SYNTHETIC_SQL} SELECT count(*) AS total, count(*) FILTER (errors = 0 AND score > 0.5e0) AS valid,
    count(*) FILTER (NOT (errors = 0 AND score > 0.5e0)) AS invalid, round(avg(score), 6) AS avg_score,
    round(min(score), 6) AS min_score, round(max(score), 6) AS max_score FROM v""",
)
def example_batch_stats(spark, folder):
    df = V.batch_statistics(synthetic(spark, folder), F.col("is_valid"))
    return rounded(df, "avg_score", "min_score", "max_score")


@query(
    "dataset_statistics",
    f"""WITH d AS (SELECT {META_SQL} FROM documents), l AS (
      SELECT 'total' AS dimension, 'all' AS value, confidence FROM d UNION ALL SELECT 'task_type', task_type, confidence FROM d
      UNION ALL SELECT 'domain', domain, confidence FROM d)
    SELECT dimension, value, count(*) AS n, round(avg(confidence), 3) AS avg_confidence FROM l GROUP BY dimension, value""",
)
def dataset_statistics(spark, folder):
    return rounded(V.dataset_statistics(synthetic(spark, folder)), "avg_confidence", digits=3)


@query(
    "import_validation",
    f"""WITH v AS (SELECT doc_id, (doc_id % 13 = 0)::INT AS errors, {lexical_sql("text", "(CASE WHEN doc_id % 13 <> 0 AND doc_id % 2 = 0 THEN 0.1e0 ELSE 0e0 END - (doc_id % 13 = 0)::INT * 0.2e0)")} AS score FROM documents)
    SELECT doc_id, round(score, 6) AS score, errors = 0 AND score > 0.5e0 AS is_valid, score >= 0.5e0 AS kept FROM v""",
)
def import_validation(spark, folder):
    doc = F.col("doc_id")
    examples = views.documents(spark, folder).select(
        "doc_id",
        F.struct(F.col("text").alias("original_idea")).alias("inputs"),
        F.struct(F.col("text").alias("improved_prompt")).alias("outputs"),
        F.when(doc % 13 != 0, F.struct(F.when(doc % 2 == 0, "langchain-hub").otherwise("other").alias("source"))).alias("metadata"),
    )
    return rounded(V.validate_import(examples).select("doc_id", "score", "is_valid", "kept"), "score")


# --- prompt objects --------------------------------------------------------------------------------

SIZE_SQL = "CASE (conv_id % 3) WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' ELSE 'complex' END"
CONSTRAINT_SQL = f"""v_prompts AS (SELECT *, CASE complexity WHEN 'simple' THEN 500 WHEN 'moderate' THEN 1000 ELSE 2000 END AS max_tokens,
  CASE WHEN turn % 2 = 1 THEN 'code in python' END AS fmt, complexity <> 'simple' AS ex, complexity = 'complex' AS expl FROM (
  SELECT *, {SIZE_SQL} AS complexity FROM v_history))"""


def prompts(spark, folder, fmt=None):
    size = views.pick(F.col("conv_id") % 3, ["simple", "moderate", "complex"])
    df = views.history(spark, folder).withColumn("complexity", size)
    language = F.when(F.col("turn") % 2 == 1, "python")
    df = df.withColumn("constraints", K.route_constraints(F.col("complexity"), language))
    if fmt is not None:
        df = df.withColumn("constraints", F.col("constraints").withField("format", fmt))
    return df.withColumnRenamed("improved_prompt", "template")


I = "improved_prompt"


@query(
    "constraint_scores",
    over_history("").rstrip()
    + f""", {CONSTRAINT_SQL} SELECT id, round(((length({I}) <= max_tokens)::INT + (fmt IS NOT NULL AND (contains({I}, '```') OR contains({I}, 'def ')))::INT
    + (ex AND (contains(lower({I}), 'example') OR contains({I}, '```')))::INT + (expl AND {has(f"lower({I})", ["explain", "reasoning", "because"])})::INT
    + (length({I}) > 50)::INT)::DOUBLE / (2 + (fmt IS NOT NULL)::INT + ex::INT + expl::INT), 6) AS score FROM v_prompts""",
)
def constraint_scores(spark, folder):
    k = F.col("constraints")
    args = (F.col("template"), k["max_tokens"], k["format"], k["include_examples"], k["include_explanation"])
    return rounded(prompts(spark, folder).select("id", C.trajectory_score(*args).alias("score")), "score")


FORMATS = ["json_only", "markdown", "no_markdown", "plain"]


def _warnings_sql() -> str:
    low = f"lower({I})"
    json_ready = f"({has(low, fixed.JSON_WORDS)} OR json_valid({strip_sql(I)}))"
    items = [
        (f"length({I}) > max_tokens", f"'Template exceeds max_tokens: ' || length({I}) || ' > ' || max_tokens"),
        (f"f = 'json_only' AND NOT {json_ready}", "'Template is not valid JSON'"),
        (f"f = 'markdown' AND NOT contains({I}, '```')", "'Template missing markdown formatting (required)'"),
        (f"f = 'no_markdown' AND contains({I}, '```')", "'Template contains markdown code blocks (prohibited)'"),
        (f"ex AND NOT {has(low, fixed.EXAMPLE_WORDS)}", "'Template missing examples (required by constraint)'"),
        (f"expl AND NOT {has(low, fixed.EXPLANATION_WORDS)}", "'Template missing explanation (required by constraint)'"),
        (f"length({strip_sql(I)}) < 20", "'Template too short (minimum 20 characters)'"),
        (f"NOT {has(low, ['role', 'task', 'you are'])}", "'Template missing role or task definition'"),
    ]
    array = ", ".join(f"CASE WHEN {c} THEN {m} END" for c, m in items)
    return f"array_to_string(list_filter([{array}], lambda x: x IS NOT NULL), ' | ')"


@query(
    "prompt_warnings",
    over_history("").rstrip()
    + f", {CONSTRAINT_SQL} SELECT id, {_warnings_sql()} AS warnings FROM (SELECT *, {pick_sql('(turn % 4)', FORMATS)} AS f FROM v_prompts)",
)
def prompt_warnings(spark, folder):
    df = V.check_prompts(prompts(spark, folder, views.pick(F.col("turn") % 4, FORMATS)))
    return df.select("id", F.array_join("warnings", " | ").alias("warnings"))


def _autocorrected_sql() -> str:
    """Role header, fence taken out or put in, then the warnings once more."""
    rows = "string_split(t, chr(10))"
    at = f"list_position(list_transform({rows}, lambda s: regexp_matches({strip_sql('s')}, '^(def |function |class )')), true)"
    drop = f"f = 'no_markdown' AND contains({I}, '```')"
    fence = f"f = 'markdown' AND NOT contains({I}, '```') AND {has(I, ['def ', 'function '])}"
    header = f"CASE WHEN {has(f'lower({I})', ['role', 'task', 'you are'])} THEN {I} ELSE {lines_literal(fixed.ANSWER_ROLE_HEADER)} || {I} END"
    return over_history("").rstrip() + f""", {CONSTRAINT_SQL},
      a AS (SELECT *, {header} AS t, {drop} AS dropped, {fence} AS fenced FROM (SELECT *, {pick_sql('(turn % 4)', FORMATS)} AS f FROM v_prompts)),
      b AS (SELECT *, CASE WHEN fenced THEN coalesce({at}, 0) ELSE 0 END AS p FROM a),
      c AS (SELECT * REPLACE (CASE WHEN dropped THEN replace(replace(t, '```', ''), '`', '"') WHEN p > 0
        THEN array_to_string({rows}[1:p - 1] || ['```python'] || {rows}[p:] || ['```'], chr(10)) ELSE t END AS improved_prompt) FROM b)
    SELECT id, improved_prompt AS template, w = '' AS passed, w AS warnings FROM (SELECT *, {_warnings_sql()} AS w FROM c)"""


@query("autocorrected_prompts", _autocorrected_sql())
def autocorrected_prompts(spark, folder):
    df = V.autocorrect(prompts(spark, folder, views.pick(F.col("turn") % 4, FORMATS)))
    return df.select("id", "template", "passed", F.array_join("warnings", " | ").alias("warnings"))


@query(
    "history_quarantine",
    over_history(
        """SELECT id, CASE WHEN len(guardrails) = 0 THEN 'empty guardrails' END AS reasons FROM v_history WHERE len(guardrails) = 0"""
    ),
)
def history_quarantine(spark, folder):
    _, bad = V.quarantine(views.history(spark, folder), V.history_reasons())
    return bad.select("id", F.array_join("reasons", " | ").alias("reasons"))


@query(
    "request_rules",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 5 THEN 'idea shorter than 5' END,
      CASE WHEN length(text) > 5000 THEN 'context longer than 5000' END, CASE WHEN doc_id % 3 = 2 THEN 'unknown mode' END], lambda x: x IS NOT NULL), ' | ') AS reasons
    FROM documents WHERE length(text) < 5 OR length(text) > 5000 OR doc_id % 3 = 2""",
)
def request_rules(spark, folder):
    requests = views.documents(spark, folder).select(
        "doc_id", F.col("text").alias("idea"), F.col("text").alias("context"),
        views.pick(F.col("doc_id") % 3, ["legacy", "nlac", "other"]).alias("mode"),
    )
    _, bad = V.quarantine(requests, V.request_reasons())
    return bad.select("doc_id", F.array_join("reasons", " | ").alias("reasons"))


@query(
    "invalid_frameworks",
    """SELECT id, framework AS invalid_value, idea, 'chain-of-thought' AS suggested_fix FROM (
    SELECT doc_id AS id, source AS framework, CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS idea FROM documents)""",
)
def invalid_frameworks(spark, folder):
    df = views.documents(spark, folder).select(
        F.col("doc_id").alias("id"), F.lit(None).cast("timestamp").alias("created_at"), F.col("source").alias("framework"),
        F.col("text").alias("original_idea"),
    )
    return V.invalid_frameworks(df).drop("created_at")


# --- classifiers -----------------------------------------------------------------------------------

LOW, CTX = "lower(original_idea)", "lower(context)"
SPACED = "(' ' || lower(original_idea) || ' ')"
INTENT_SQL = f"""CASE WHEN {has(CTX, fixed.EXPECTATION_TERMS)} THEN 'refactor'
  WHEN {has(f"({LOW} || ' ' || {CTX})", fixed.EXPLAIN_TERMS)} THEN 'explain'
  WHEN {has(SPACED, [f" {v} " for v in fixed.REFACTOR_VERBS])} OR {has(LOW, fixed.SLOWNESS_TERMS)} THEN 'refactor'
  WHEN {has(LOW, fixed.DEBUG_TERMS)} THEN 'debug' ELSE 'generate' END"""
SERVICE_SQL = first_sql("lower(original_idea || ' ' || context)", fixed.SERVICE_INTENTS, "GENERATE")
TERM_LIST = ", ".join(q(t) for t in fixed.COMPLEXITY_TERMS)
BOTH = "lower(original_idea || ' ' || context)"
SCORE_SQL = f"""(CASE WHEN length(original_idea) + length(context) <= 50 THEN 0e0 WHEN length(original_idea) + length(context) <= 150 THEN 0.5e0 ELSE 1e0 END) * 0.4e0
  + least(len(list_filter(regexp_extract_all({BOTH}, {q(WORD + '+')}), lambda w: w IN ({TERM_LIST}))) * 0.5e0, 1e0) * 0.3e0
  + least((length({BOTH}) - length(translate({BOTH}, '.,;', ''))) * 0.1e0, 1e0) * 0.2e0
  + (CASE WHEN {strip_sql("context")} = '' THEN 0e0 ELSE 1e0 END) * 0.1e0"""
COMPLEXITY_SQL = f"CASE WHEN length(original_idea) + length(context) > 300 THEN 'complex' WHEN cscore < 0.25e0 THEN 'simple' WHEN cscore < 0.6e0 THEN 'moderate' ELSE 'complex' END"
BARE = strip_sql("original_idea")
COUNT = f"len({words_sql(BARE)})"
CLASS_SQL = f"""v_class AS (SELECT *, {COMPLEXITY_SQL} AS complexity FROM (SELECT id, original_idea, context, {INTENT_SQL} AS intent, {SERVICE_SQL} AS service_intent,
  CASE WHEN {BARE} = '' THEN 'explain' ELSE {first_sql(f"lower({BARE})", fixed.CLIENT_INTENTS, "explain")} END AS client_intent,
  CASE WHEN {BARE} = '' OR {COUNT} < 10 THEN 'SIMPLE' WHEN {COUNT} < 20 THEN 'MODERATE' ELSE 'COMPLEX' END AS client_size,
  CASE WHEN {BARE} = '' THEN 0e0 WHEN {COUNT} < 5 THEN 0.4e0 ELSE 0.8e0 END AS client_confidence,
  {SCORE_SQL} AS cscore,
  CASE WHEN {count_terms(LOW, fixed.NEGATIVE_WORDS)} > {count_terms(LOW, fixed.POSITIVE_WORDS)} THEN 'negative'
    WHEN {count_terms(LOW, fixed.NEGATIVE_WORDS)} < {count_terms(LOW, fixed.POSITIVE_WORDS)} THEN 'positive' ELSE 'neutral' END AS sentiment,
  {first_sql(LOW, fixed.IDEA_DOMAINS, "other")} AS domain FROM v_history))"""


def classified(spark, folder):
    idea, context = F.col("original_idea"), F.col("context")
    client = K.client_analysis(idea)
    return views.history(spark, folder).select(
        "id", K.intent(idea, context).alias("intent"), K.service_intent(idea, context).alias("service_intent"),
        client["intent"].alias("client_intent"), client["complexity"].alias("client_size"),
        client["confidence"].alias("client_confidence"), K.complexity_score(idea, context).alias("cscore"),
        K.sentiment(idea).alias("sentiment"), K.idea_domain(idea).alias("domain"), K.complexity(idea, context).alias("complexity"),
    )


def over_class(select: str) -> str:
    return over_history("").rstrip() + f", {CLASS_SQL} {select}"


@query(
    "classified_prompts",
    over_class("SELECT * EXCLUDE (original_idea, context, cscore), round(cscore, 6) AS cscore FROM v_class"),
)
def classified_prompts(spark, folder):
    return rounded(classified(spark, folder), "cscore")


@query("intent_mix", over_class("SELECT intent, count(*) AS n FROM v_class GROUP BY intent"))
def intent_mix(spark, folder):
    return A.count_by(views.history(spark, folder).select(K.intent(F.col("original_idea"), F.col("context")).alias("intent")), "intent")


@query(
    "intent_by_complexity",
    over_class("SELECT intent, complexity, count(*) AS n FROM v_class GROUP BY intent, complexity"),
)
def intent_by_complexity(spark, folder):
    return A.count_by(classified(spark, folder), "intent", "complexity")


@query(
    "domain_mix",
    f"SELECT domain, count(*) AS n FROM (SELECT {first_sql('lower(text)', fixed.IDEA_DOMAINS, 'other')} AS domain FROM documents) GROUP BY domain",
)
def domain_mix(spark, folder):
    return A.count_by(views.documents(spark, folder).select(K.idea_domain(F.col("text")).alias("domain")), "domain")


def _route_sql() -> str:
    strategy = "CASE " + " ".join(f"WHEN intent = '{i}' AND complexity = '{c}' THEN '{s}'" for (i, c), (s, _) in fixed.ROUTES.items()) + " END"
    role = "CASE " + " ".join(f"WHEN intent = '{i}' AND complexity = '{c}' THEN '{r}'" for (i, c), (_, r) in fixed.ROUTES.items()) + " END"
    return f"""SELECT id, {strategy} AS strategy, {role} AS prompt_role,
      CASE complexity WHEN 'simple' THEN 500 WHEN 'moderate' THEN 1000 ELSE 2000 END AS max_tokens,
      complexity <> 'simple' AS include_examples, complexity = 'complex' AS include_explanation FROM v_class"""


@query("routed_strategies", over_class(_route_sql()))
def routed_strategies(spark, folder):
    return N.with_route(classified(spark, folder)).select("id", "strategy", "prompt_role", "constraints.max_tokens", "constraints.include_examples", "constraints.include_explanation")


@query(
    "normalized_frameworks",
    f"""SELECT doc_id, coalesce(f, 'decomposition') AS framework, f IS NULL AS used_fallback FROM (
    SELECT doc_id, CASE WHEN contains(t, 'decomp') THEN 'decomposition' WHEN {has("t", ["chain", "cot"])} THEN 'chain-of-thought'
      WHEN {has("t", ["tree", "tot"])} THEN 'tree-of-thoughts' WHEN contains(t, 'role') THEN 'role-playing' END AS f
    FROM (SELECT doc_id, lower({strip_sql("text")}) AS t FROM documents))""",
)
def normalized_frameworks(spark, folder):
    return views.documents(spark, folder).select("doc_id", N.normalize_framework(F.col("text")).alias("f")).select("doc_id", "f.*")


def _errors_sql() -> str:
    low = "lower(text)"
    return f"""SELECT doc_id, {first_sql(low, [(n, [n.lower()]) for n in fixed.ERROR_NAMES], "Error")} AS error_name,
      CASE WHEN contains({low}, 'timed out') THEN {q(fixed.HINT_TIMEOUT)} WHEN {has(low, ["connect", "econnrefused", "not reachable"])} THEN {q(fixed.HINT_CONNECT["nlac"])}
        WHEN contains({low}, 'model') AND contains({low}, 'not found') THEN {q(fixed.HINT_MODEL)} WHEN {has(low, ["schema", "validation"])} THEN {q(fixed.HINT_SCHEMA)}
        WHEN {has(low, ["json", "parse"])} THEN {q(fixed.HINT_PARSE)} WHEN {has(low, ["401", "unauthorized", "api key"])} THEN {q(fixed.HINT_KEY)}
        WHEN {has(low, ["429", "rate limit"])} THEN {q(fixed.HINT_RATE)} END AS hint,
      (contains({low}, 'model') AND {has(low, ["not found", "ollama error"])}) OR {has(low, fixed.RETRY_TERMS)} AS retry FROM documents"""


@query("error_typing", _errors_sql())
def error_typing(spark, folder):
    t = F.col("text")
    return views.documents(spark, folder).select(
        "doc_id", K.error_name(t).alias("error_name"), K.error_hint(t, F.lit("nlac")).alias("hint"), K.worth_retry(t).alias("retry"),
    )


@query(
    "file_priorities",
    f"""SELECT page_id, CASE WHEN {has("lower(url)", ["instructions", "rule"])} THEN 5 WHEN contains(lower(url), 'agent') THEN 4 ELSE 1 END AS priority,
    CASE WHEN {has("lower(url)", ["instructions", "rule"])} THEN 'instruction' WHEN contains(lower(url), 'agent') THEN 'agent' ELSE 'general' END AS category FROM pages""",
)
def file_priorities(spark, folder):
    return views.table(spark, folder, "pages").select("page_id", K.file_priority(F.col("url")).alias("p")).select("page_id", "p.*")


FILE_RULE_ROWS = [(2, "example.org", 4, "organisation"), (1, "Blog", 5, "journal"), (1, "https://m.", 5, "mobile"), (3, "/en/", 2, "english")]


@query(
    "file_priorities_table",
    "SELECT page_id, CASE "
    + " ".join(f"WHEN contains(lower(url), lower('{w}')) THEN {p}" for _, w, p, _ in sorted(FILE_RULE_ROWS)) + " ELSE 1 END AS priority, CASE "
    + " ".join(f"WHEN contains(lower(url), lower('{w}')) THEN '{c}'" for _, w, _, c in sorted(FILE_RULE_ROWS)) + " ELSE 'general' END AS category FROM pages",
)
def file_priorities_table(spark, folder):
    """Priorities by rules out of a table."""
    table = literal_rows(spark, FILE_RULE_ROWS, ["place", "keyword", "priority", "category"])
    placed = K.file_priority(F.col("url"), rules.file_rules(table))
    return views.table(spark, folder, "pages").select("page_id", placed.alias("p")).select("page_id", "p.*")


@query(
    "age_labels",
    """SELECT event_id, CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN floor(s / 60)::INT || 'm ago' WHEN s < 86400 THEN floor(s / 3600)::INT || 'h ago'
      ELSE strftime(ts, '%b %-d, %I:%M %p') END AS label
    FROM (SELECT event_id, ts, epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(ts) AS s FROM events)""",
)
def age_labels(spark, folder):
    return views.table(spark, folder, "events").select(
        "event_id", K.age_label(F.col("ts"), F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("label")
    )


@query(
    "wizard_predicates",
    over_class(
        """SELECT id, client_confidence < 0.7e0 OR client_size = 'COMPLEX' OR client_intent = 'generate' AS enabled,
        client_confidence >= 0.7e0 AND client_size <> 'COMPLEX' AND client_intent <> 'generate' AS offer_skip,
        CASE WHEN client_intent = 'generate' THEN 2 WHEN client_size = 'COMPLEX' THEN 2 ELSE 1 END AS questions FROM v_class"""
    ),
)
def wizard_predicates(spark, folder):
    c = F.col
    df = classified(spark, folder)
    return df.select(
        "id",
        K.wizard_enabled(F.lit("auto"), c("client_confidence"), c("client_size"), c("client_intent"), F.lit(1)).alias("enabled"),
        K.offer_skip(F.lit("auto"), c("client_confidence"), c("client_size"), c("client_intent"), F.lit(3)).alias("offer_skip"),
        F.size(K.clarifying_questions(c("client_intent"), c("client_size"))).alias("questions"),
    )
