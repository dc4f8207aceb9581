"""Queries over evaluation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import fixed
from quillspark.functions import checks as C
from quillspark.operators import evalreport as E
from quillspark.plans.common import WORD, has, over_history, pick_sql, q, query, re_any, rounded, strip_sql, words_sql
from quillspark.sources import views

RUNS_SQL = f"""v_runs AS (SELECT conv_id AS case_no, {pick_sql("(conv_id % 3)", ["good-", "bad-", "ambig-"])} || conv_id AS case_id, turn AS run,
  original_idea AS input, improved_prompt AS output, length(improved_prompt) - length(replace(improved_prompt, '?', '')) AS questions,
  confidence, latency_ms, backend, framework, provider FROM v_history)"""
CATEGORY_SQL = f"""CASE WHEN length({strip_sql("output")}) < 50 THEN 'emptyFinalPrompt'
  WHEN regexp_matches(output, {q(fixed.PLACEHOLDER_MARK)}) THEN 'unfilledPlaceholders' WHEN {has("lower(output)", fixed.CHATTY_TERMS)} THEN 'chattyOutput'
  WHEN questions > 5 THEN 'tooManyQuestions' WHEN confidence < 0.5e0 THEN 'other' ELSE 'success' END"""
JUDGED_SQL = f"""v_judged AS (SELECT *, category = 'success' AND length(output) > 50 AND questions <= 3 AND NOT contains(output, '{{{{') AND NOT contains(output, '[') AS copyable,
  category = 'success' AND questions > 0 AS reviewable,
  CASE WHEN starts_with(case_id, 'good-') THEN 'good' WHEN starts_with(case_id, 'bad-') THEN 'bad' ELSE 'ambiguous' END AS bucket
  FROM (SELECT *, {CATEGORY_SQL} AS category FROM v_runs))"""


def over_runs(select: str) -> str:
    return over_history("").rstrip() + f", {RUNS_SQL}, {JUDGED_SQL} {select}"


def judged(spark, folder):
    return E.judge_runs(views.runs(spark, folder))


@query("judged_runs", over_runs("SELECT case_id, run, bucket, category, copyable, reviewable FROM v_judged"))
def judged_runs(spark, folder):
    return judged(spark, folder).select("case_id", "run", "bucket", "category", "copyable", "reviewable")


def cases(spark, folder):
    """A case per conversation but every eleventh; limits and terms vary by its number, some are left to the default."""
    number = F.col("case_no")
    turns = views.table(spark, folder, "conversations").select(F.col("conv_id").alias("case_no")).distinct()
    prefix = views.pick(number % 3, ["good-", "bad-", "ambig-"])
    return turns.filter(number % 11 != 0).select(
        F.concat(prefix, number.cast("string")).alias("case_id"),
        F.when(number % 4 == 1, 400).when(number % 4 == 2, 80).alias("min_chars"),
        F.when(number % 5 == 0, 0).alias("max_questions"), F.when(number % 2 == 0, 0.2).alias("min_confidence"),
        F.when(number % 7 == 3, F.array(F.lit("LATENCY"), F.lit("writer"))).alias("banned"),
        F.when(number % 3 == 1, F.array(F.lit("#"), F.lit("e"))).alias("wanted"),
    )


CASES_SQL = f"""v_cases AS (SELECT {pick_sql("(conv_id % 3)", ["good-", "bad-", "ambig-"])} || conv_id AS case_id,
  CASE conv_id % 4 WHEN 1 THEN 400 WHEN 2 THEN 80 END AS min_chars, CASE WHEN conv_id % 5 = 0 THEN 0 END AS max_questions,
  CASE WHEN conv_id % 2 = 0 THEN 0.2e0 END AS min_confidence, CASE WHEN conv_id % 7 = 3 THEN ['LATENCY', 'writer'] ELSE []::VARCHAR[] END AS banned,
  CASE WHEN conv_id % 3 = 1 THEN ['#', 'e'] ELSE []::VARCHAR[] END AS wanted, true AS known FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 11 <> 0),
v_met AS (SELECT r.*, coalesce(min_chars, 50) AS lc, coalesce(max_questions, 5) AS lq, coalesce(min_confidence, 0.5e0) AS lf, coalesce(banned, []) AS banned,
  coalesce(wanted, []) AS wanted, coalesce(known, false) AS known_case FROM v_runs r LEFT JOIN v_cases USING (case_id))"""


@query(
    "case_results",
    over_history("").rstrip()
    + f""", {RUNS_SQL}, {CASES_SQL} SELECT case_id, run, known_case, CASE WHEN length({strip_sql("output")}) < lc THEN 'emptyFinalPrompt'
    WHEN regexp_matches(output, {q(fixed.PLACEHOLDER_MARK)}) THEN 'unfilledPlaceholders' WHEN {has("lower(output)", fixed.CHATTY_TERMS)} THEN 'chattyOutput'
    WHEN len(list_filter(banned, lambda b: contains(lower(output), lower(b)))) > 0 THEN 'bannedContent'
    WHEN questions > lq THEN 'tooManyQuestions' WHEN confidence < lf THEN 'other' ELSE 'success' END AS category,
    length(output) >= lc AND len(list_filter(wanted, lambda w: NOT contains(output, w))) = 0 AND len(list_filter(banned, lambda b: contains(output, b))) = 0 AS asserted
    FROM v_met""",
)
def case_results(spark, folder):
    return E.case_results(views.runs(spark, folder), cases(spark, folder)).select("case_id", "run", "known_case", "category", "asserted")


BUCKET_SQL = """SELECT bucket, count(*) AS total, round(avg((category = 'success')::INT), 6) AS valid_rate,
  round(avg(copyable::INT), 6) AS copyable_rate, round(avg(reviewable::INT), 6) AS review_rate
  FROM (SELECT * FROM v_judged UNION ALL SELECT * REPLACE ('all' AS bucket) FROM v_judged) GROUP BY bucket"""


@query("bucket_report", over_runs(BUCKET_SQL))
def bucket_report(spark, folder):
    return rounded(E.bucket_report(judged(spark, folder)), "valid_rate", "copyable_rate", "review_rate")


@query("failure_reasons", over_runs("SELECT category, count(*) AS n FROM v_judged WHERE category <> 'success' GROUP BY category"))
def failure_reasons(spark, folder):
    return E.failure_reasons(judged(spark, folder))


@query(
    "top_failure_reasons",
    over_runs("SELECT category, count(*) AS n FROM v_judged WHERE category <> 'success' GROUP BY category ORDER BY n DESC, category LIMIT 5"),
)
def top_failure_reasons(spark, folder):
    return E.failure_reasons(judged(spark, folder)).orderBy(F.desc("n"), "category").limit(5)


P_SQL = """v_ranked AS (SELECT *, row_number() OVER (ORDER BY latency_ms) AS rn, count(*) OVER () AS n FROM v_runs)"""


@query(
    "latency_percentiles",
    over_runs("SELECT quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95 FROM v_runs"),
)
def latency_percentiles(spark, folder):
    return E.latency_percentiles(views.runs(spark, folder))


@query(
    "floor_percentiles",
    over_history("").rstrip()
    + f""", {RUNS_SQL}, v_ranked AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY latency_ms) - 1 AS rn, count(*) OVER (PARTITION BY provider) AS c FROM v_runs)
    SELECT provider, count(*) AS n, round(avg(latency_ms), 6) AS mean, min(latency_ms) AS min, max(latency_ms) AS max, median(latency_ms) AS median,
    max(latency_ms) FILTER (rn = floor(c * 0.95e0)) AS p95, max(latency_ms) FILTER (rn = floor(c * 0.99e0)) AS p99 FROM v_ranked GROUP BY provider""",
)
def floor_percentiles(spark, folder):
    return rounded(E.floor_percentiles(views.runs(spark, folder), ["provider"]), "mean")


WRAPPER_SQL = """SELECT count(*) FILTER (v % 3 = 0)::DOUBLE / count(*) AS extraction_used_rate, count(*) FILTER (v % 3 = 0 AND run % 3 = 0) AS fence,
  count(*) FILTER (v % 3 = 0 AND run % 3 = 1) AS tag, count(*) FILTER (v % 3 = 0 AND run % 3 = 2) AS scan,
  count(*) FILTER (v % 4 = 1)::DOUBLE / count(*) AS repair_trigger_rate,
  CASE WHEN count(*) FILTER (v % 4 = 1) = 0 THEN 0 ELSE count(*) FILTER (v % 4 = 1 AND v % 8 = 1)::DOUBLE / count(*) FILTER (v % 4 = 1) END AS repair_parse_rate,
  CASE WHEN count(*) FILTER (v % 4 = 1) = 0 THEN 0 ELSE count(*) FILTER (v % 4 = 1 AND category = 'success')::DOUBLE / count(*) FILTER (v % 4 = 1) END AS repair_schema_rate,
  count(*) FILTER (v % 4 = 1)::DOUBLE / count(*) AS attempt2_rate FROM (SELECT *, case_no + run AS v FROM v_judged)"""
WRAPPER_COLS = ["extraction_used_rate", "repair_trigger_rate", "repair_parse_rate", "repair_schema_rate", "attempt2_rate"]


def _wrapped(spark, folder):
    v = F.col("case_no") + F.col("run")
    return judged(spark, folder).withColumns(
        {
            "used_extraction": v % 3 == 0, "extraction_method": views.pick(F.col("run") % 3, ["fence", "tag", "scan"]),
            "used_repair": v % 4 == 1, "attempt": F.when(v % 4 == 1, 2).otherwise(1), "parse_ok": v % 8 == 1,
            "schema_ok": F.col("category") == "success",
        }
    )


@query(
    "wrapper_rates",
    over_runs(f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in WRAPPER_COLS)}) FROM ({WRAPPER_SQL})"),
)
def wrapper_rates(spark, folder):
    return rounded(E.wrapper_rates(_wrapped(spark, folder)), *WRAPPER_COLS)


@query(
    "release_gates",
    over_runs(
        f"""SELECT avg((category = 'success')::INT) >= 0.54 AS valid_ok, avg(copyable::INT) >= 0.54 AS copyable_ok,
        (SELECT quantile_disc(latency_ms, 0.95) FROM v_runs) <= 12000 AS latency_ok,
        (SELECT repair_schema_rate >= 0.5 OR repair_trigger_rate = 0 FROM ({WRAPPER_SQL})) AS repair_ok FROM v_judged"""
    ),
)
def release_gates(spark, folder):
    return E.release_gates(
        E.bucket_report(judged(spark, folder)), E.latency_percentiles(views.runs(spark, folder)),
        E.wrapper_rates(_wrapped(spark, folder)),
    )


# outputs that talk about an acronym, one sense per (case, run), so that senses are there to count
SENSE_TEXT = [p for _, p in fixed.ACRONYM_SENSES]
SENSE_SQL = f"{pick_sql('((case_no * 3 + run * run) % 9)', SENSE_TEXT)}"


@query(
    "ambiguity",
    over_runs(
        f"""SELECT count(*) AS total_cases, round(avg((coalesce(s, 0) > 1)::INT), 6) AS spread, round(avg((coalesce(share, 0) >= 2e0 / 3)::INT), 6) AS dominant_rate,
        round(avg(coalesce(share, 0)), 6) AS stability FROM (SELECT DISTINCT case_no FROM v_runs WHERE case_no % 2 = 0) LEFT JOIN (
        SELECT case_no, count(*) AS s, max(n)::DOUBLE / sum(n) AS share FROM (SELECT case_no, {SENSE_SQL} AS sense, count(*) AS n FROM v_runs WHERE run % 7 <> 5 GROUP BY ALL) GROUP BY case_no) USING (case_no)"""
    ),
)
def ambiguity(spark, folder):
    runs = views.runs(spark, folder)
    sense = views.pick((F.col("case_no") * 3 + F.col("run") * F.col("run")) % 9, SENSE_TEXT)
    told = runs.select(
        "case_id", F.when(F.col("run") % 7 != 5, F.concat(F.lit("The "), sense, F.lit(" process."))).otherwise("none").alias("output")
    )
    tags = F.when(F.col("case_no") % 2 == 0, F.array(F.lit("ambiguity"))).otherwise(F.array().cast("array<string>"))
    return rounded(E.ambiguity(runs.select("case_id", tags.alias("tags")), told), "spread", "dominant_rate", "stability")


TOP_SQL = f"""v_tokens AS (SELECT case_no, run, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM (SELECT case_no, run, {words_sql("lower(output)")} AS ws FROM v_runs)),
  v_top AS (SELECT case_no, run, word, n, row_number() OVER (PARTITION BY case_no, run ORDER BY n DESC, first) AS rank FROM (
    SELECT case_no, run, word, count(*) AS n, min(p) AS first FROM v_tokens WHERE length(word) > 3 GROUP BY ALL) QUALIFY rank <= 10)"""


@query("top_words", over_runs("").rstrip() + f", {TOP_SQL} SELECT case_no, run, word, n, rank FROM v_top")
def top_words(spark, folder):
    return E.top_words(views.runs(spark, folder), ["case_no", "run"], "output").select("case_no", "run", "word", "n", "rank")


FEATURE_SQL = f"""v_features AS (SELECT *,
  list_filter({fixed.KNOWN_VERBS!r}, lambda t: list_contains(ws, t))[1] AS verb, list_filter({fixed.KNOWN_OBJECTS!r}, lambda t: list_contains(ws, t))[1] AS object,
  list_filter({fixed.KNOWN_TECH!r}, lambda t: list_contains(ws, t)) AS tech,
  regexp_matches(output, {q("(?m)^#+[" + r"\t-\r \x{a0}" + "]+[a-zA-Z0-9_]+")}) AS has_sections, contains(output, '?') AS has_questions,
  list_distinct(list_filter(ws, lambda w: length(w) > 3)) AS lw FROM (SELECT *, {words_sql("lower(output)")} AS ws FROM v_runs))"""


@query(
    "keyword_features",
    over_runs("").rstrip()
    + f", {FEATURE_SQL} SELECT case_no, run, verb, object, array_to_string(tech, ',') AS tech, has_sections, has_questions, len(lw)::INT AS long_words, length(output)::INT AS length FROM v_features",
)
def keyword_features(spark, folder):
    return E.keyword_features(views.runs(spark, folder)).select(
        "case_no", "run", "verb", "object", F.array_join("tech", ",").alias("tech"), "has_sections", "has_questions",
        F.size("long_words").alias("long_words"), "length",
    )


JACCARD = lambda a, b: f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0e0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"
VARIABILITY_SQL = f"""{TOP_SQL}, {FEATURE_SQL},
  v_sets AS (SELECT f.case_no, f.run, lw, coalesce(kw, []) AS kw FROM v_features f LEFT JOIN (SELECT case_no, run, list(word) AS kw FROM v_top GROUP BY ALL) t USING (case_no, run)),
  v_pairs AS (SELECT a.case_no, avg({JACCARD("a.kw", "b.kw")}) AS keyword_overlap, avg({JACCARD("a.lw", "b.lw")}) AS word_jaccard
    FROM v_sets a JOIN v_sets b ON a.case_no = b.case_no AND a.run < b.run GROUP BY a.case_no),
  v_lead AS (SELECT case_no, max(n) FILTER (k = 'verb') AS verb, max(n) FILTER (k = 'object') AS object, max(n) FILTER (k = 'tech') AS tech FROM (
    SELECT case_no, k, v, count(*) AS n FROM (SELECT case_no, 'verb' AS k, verb AS v FROM v_features WHERE verb IS NOT NULL
      UNION ALL SELECT case_no, 'object', object FROM v_features WHERE object IS NOT NULL UNION ALL SELECT case_no, 'tech', unnest(tech) FROM v_features) GROUP BY ALL) GROUP BY case_no),
  v_var AS (SELECT case_no, runs, confidence_sd, length_sd, section_consistency, keyword_overlap, word_jaccard,
    coalesce(verb, 0)::DOUBLE / runs AS verb_consistency, coalesce(object, 0)::DOUBLE / runs AS object_consistency, coalesce(tech, 0)::DOUBLE / runs AS tech_consistency,
    CASE WHEN keyword_overlap > 0.7 AND word_jaccard > 0.7 THEN 'low' WHEN keyword_overlap > 0.4 AND word_jaccard > 0.4 THEN 'medium' ELSE 'high' END AS level
    FROM (SELECT case_no, count(*) AS runs, stddev_pop(confidence) AS confidence_sd, stddev_pop(length(output)) AS length_sd, avg(has_sections::INT) AS section_consistency FROM v_features GROUP BY case_no)
    LEFT JOIN v_pairs USING (case_no) LEFT JOIN v_lead USING (case_no))"""
VAR_COLS = [
    "confidence_sd", "length_sd", "section_consistency", "keyword_overlap", "word_jaccard", "verb_consistency",
    "object_consistency", "tech_consistency",
]


@query(
    "pairwise_variability",
    over_runs("").rstrip() + f", {VARIABILITY_SQL} SELECT case_no, runs, level, {', '.join(f'round({c}, 6) AS {c}' for c in VAR_COLS)} FROM v_var",
)
def pairwise_variability(spark, folder):
    return rounded(E.variability(views.runs(spark, folder)), *VAR_COLS)


@query(
    "variability_verdict",
    over_runs("").rstrip()
    + f", {VARIABILITY_SQL} SELECT round(avg(word_jaccard), 6) AS mean_jaccard, CASE WHEN avg(word_jaccard) < 0.6 THEN 'high' WHEN avg(word_jaccard) < 0.8 THEN 'medium' ELSE 'low' END AS verdict FROM v_var",
)
def variability_verdict(spark, folder):
    return rounded(E.variability_verdict(E.variability(views.runs(spark, folder))), "mean_jaccard")


@query(
    "keyword_frequency",
    over_runs("").rstrip()
    + f""", {TOP_SQL} SELECT case_no, word, n, rank, round(n::DOUBLE / runs, 6) AS share FROM (
    SELECT case_no, word, count(*) AS n, row_number() OVER (PARTITION BY case_no ORDER BY count(*) DESC, word) AS rank FROM v_top GROUP BY case_no, word)
    JOIN (SELECT case_no, count(*) AS runs FROM v_runs GROUP BY case_no) USING (case_no) WHERE rank <= 15""",
)
def keyword_frequency(spark, folder):
    return rounded(E.keyword_frequency(views.runs(spark, folder)), "share")


GATE_SQL = {
    "json_valid": "true", "confidence_ok": "confidence >= 0.7e0",
    "copyable": "((length(output) > 50 AND contains(output, 'Role:')) OR contains(output, '##')) AND length(output) >= 50",
    "review_rate_ok": "NOT starts_with(case_id, 'bad-')",
}
MODE_SQL = f"""v_mode AS (SELECT *, least(json_valid, confidence_ok, copyable, review_rate_ok) AS all_gates FROM (
  SELECT backend, count(*) AS total, count(*) AS success, 0 AS failed, {", ".join(f"count(*) FILTER ({c}) AS {g}" for g, c in GATE_SQL.items())},
    avg(latency_ms) AS avg_latency, avg(confidence) AS avg_confidence, count(*) FILTER ({" AND ".join(f"({c})" for c in GATE_SQL.values())}) AS rows_passing_all,
    CASE WHEN count(*) < 20 THEN max(latency_ms) ELSE max(latency_ms) FILTER (rn = floor(c * 0.95e0)) END AS p95_latency
  FROM (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY latency_ms) - 1 AS rn, count(*) OVER (PARTITION BY backend) AS c FROM v_runs) GROUP BY backend))"""


@query(
    "mode_evaluation",
    over_runs("").rstrip() + f", {MODE_SQL} SELECT * REPLACE (round(avg_latency, 6) AS avg_latency, round(avg_confidence, 6) AS avg_confidence) FROM v_mode",
)
def mode_evaluation(spark, folder):
    return rounded(E.mode_evaluation(views.runs(spark, folder)), "avg_latency", "avg_confidence")


def _delta_sql() -> str:
    pick = lambda m, c: f"max({c}) FILTER (backend = '{m}')"
    parts = [
        f"SELECT '{g}' AS gate, {pick('few-shot', g)} - {pick('zero-shot', g)} AS delta, round(({pick('few-shot', g)} - {pick('zero-shot', g)}) * 100e0 / {pick('zero-shot', 'total')}, 6) AS delta_percent FROM v_mode"
        for g in [*E.MODE_GATES, "all_gates"]
    ]
    return " UNION ALL ".join(parts)


@query("mode_delta", over_runs("").rstrip() + f", {MODE_SQL} {_delta_sql()}")
def mode_delta(spark, folder):
    df = E.mode_delta(E.mode_evaluation(views.runs(spark, folder)), "backend", "zero-shot", "few-shot")
    return rounded(df, "delta_percent")


ARM_COLS = ["avg_confidence", "avg_latency_ms", "avg_length", "pass_confidence", "pass_length", "pass_structure"]
ARM_SQL = """v_arm AS (SELECT provider, count(*) AS n, avg(confidence) AS avg_confidence, avg(latency_ms) AS avg_latency_ms, avg(length(improved_prompt)) AS avg_length,
  avg((confidence >= 0.7e0)::INT) AS pass_confidence, avg((length(improved_prompt) >= 50)::INT) AS pass_length, avg((context <> '')::INT) AS pass_structure FROM v_history GROUP BY provider)"""


def _arms(spark, folder):
    return views.history(spark, folder).withColumns(
        {"role": F.col("context"), "directive": F.col("original_idea"), "error": F.lit(None).cast("string")}
    )


@query("arm_report", over_history("").rstrip() + f", {ARM_SQL} SELECT provider, n, {', '.join(f'round({c}, 6) AS {c}' for c in ARM_COLS)} FROM v_arm")
def arm_report(spark, folder):
    return rounded(E.arm_report(_arms(spark, folder), "provider"), *ARM_COLS)


@query(
    "arm_differences",
    over_history("").rstrip()
    + f", {ARM_SQL} SELECT " + ", ".join(f"round(max({c}) FILTER (provider = 'openai') - max({c}) FILTER (provider = 'deepseek'), 6) AS {c}_difference" for c in ARM_COLS[1:2] + ARM_COLS[:1] + ARM_COLS[2:3])
    + " FROM v_arm",
)
def arm_differences(spark, folder):
    df = E.arm_differences(E.arm_report(_arms(spark, folder), "provider"), "provider", "openai", "deepseek")
    return rounded(df, *df.columns)


@query(
    "structure_presence",
    over_runs(
        "SELECT count(*) AS n, round(avg(length(output)), 6) AS avg_length, "
        + ", ".join(f"round(avg(contains(upper(output), '{w}')::INT), 6) AS has_{w.lower()}" for w in fixed.STRUCTURE_WORDS)
        + ", bool_and(" + " AND ".join(f"contains(upper(output), '{w}')" for w in fixed.STRUCTURE_WORDS) + ") AS all_consistent FROM v_runs"
    ),
)
def structure_presence(spark, folder):
    df = E.structure_presence(views.runs(spark, folder))
    return rounded(df, *[n for n, t in df.dtypes if t == "double"])


TRAJECTORY_SQL = "(SELECT user_id AS prompt_id, event_id AS iteration_number, (event_id * 7 % 11)::DOUBLE / 10e0 AS score FROM events)"


def _trajectory(spark, folder):
    return views.table(spark, folder, "events").select(
        F.col("user_id").alias("prompt_id"), F.col("event_id").alias("iteration_number"), (F.col("event_id") * 7 % 11 / 10.0).alias("score")
    )


@query(
    "optimizer_outcome",
    f"""SELECT prompt_id, max(score) AS best_score, arg_min(iteration_number, (-score, iteration_number)) AS best_iteration,
    coalesce(min(iteration_number) FILTER (score >= 1), 3) AS iterations_run, count(*) FILTER (score >= 1) > 0 AS early_stopped FROM {TRAJECTORY_SQL} GROUP BY prompt_id""",
)
def optimizer_outcome(spark, folder):
    return E.optimizer_outcome(_trajectory(spark, folder))


@query(
    "orphan_steps",
    f"SELECT prompt_id, iteration_number FROM {TRAJECTORY_SQL} WHERE prompt_id NOT IN (SELECT conv_id FROM conversations)",
)
def orphan_steps(spark, folder):
    prompts = views.table(spark, folder, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return E.orphan_steps(_trajectory(spark, folder), prompts).select("prompt_id", "iteration_number")


def _issue_sql() -> str:
    low, bare = f"lower({strip_sql('text')})", strip_sql("text")
    first = f"lower({strip_sql('coalesce(list_filter(regexp_split_to_array(' + bare + ', ' + q(chr(92) + 'r?' + chr(92) + 'n') + '), lambda s: ' + strip_sql('s') + ' <> ' + chr(39)*2 + ')[1], ' + chr(39)*2 + ')')})"
    hit = f"list_filter([{', '.join(q(s) for s in fixed.BANNED_SNIPPETS)}], lambda s: contains({low}, s))[1]"
    starts = lambda o: "(" + " OR ".join(f"starts_with({first}, {q(s)})" for s in o) + ")"
    joined = lambda items: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {m} END" for c, m in items) + "], lambda x: x IS NOT NULL), ' | ')"
    output = joined([
        (f"regexp_matches(text, {q(fixed.PLACEHOLDER_MARK)})", "'unfilled_placeholders'"), (has("lower(text)", fixed.CHATTY_TERMS), "'chatty_output'"),
        (f"length({bare}) < 50", "'empty_or_too_short'"),
    ])
    rewrite = joined([
        (f"{bare} = ''", "'improved_prompt is empty'"), (f"{hit} IS NOT NULL", f"'contains meta content: \"' || {hit} || '\"'"),
        (starts(fixed.META_STARTS), "'starts with meta instructions'"), (starts(fixed.DESCRIBING_STARTS), "'describes creating a prompt instead of being the prompt'"),
        (has(bare, ["?", "¿"]), "'contains a question'"),
    ])
    debt = joined([(re_any("text", [p]), f"'{label}'") for label, p in fixed.DEBT_MARKS])
    sense = "CASE " + " ".join(f"WHEN contains(lower(text), '{p}') THEN '{label}'" for label, p in fixed.ACRONYM_SENSES) + " END"
    return f"SELECT doc_id, {output} AS output_issues, {rewrite} AS rewrite_issues, {debt} AS debt, {sense} AS sense FROM documents"


@query("text_issues", _issue_sql())
def text_issues(spark, folder):
    t = F.col("text")
    return views.documents(spark, folder).select(
        "doc_id", F.array_join(C.output_issues(t), " | ").alias("output_issues"),
        F.array_join(C.rewrite_issues(t), " | ").alias("rewrite_issues"), F.array_join(C.debt_patterns(t), " | ").alias("debt"),
        C.acronym_sense(t).alias("sense"),
    )


@query(
    "example_metric",
    over_history(
        f"""SELECT id, CASE WHEN length(context) < 20 OR length(original_idea) < 30 THEN 0.3e0 WHEN len(guardrails) < 2 THEN 0.5e0
        WHEN {" + ".join(f"contains(upper(improved_prompt), '{w}')::INT" for w in fixed.STRUCTURE_WORDS)} < 3 THEN 0.7e0 ELSE 1e0 END AS metric FROM v_history"""
    ),
)
def example_metric(spark, folder):
    c = F.col
    return views.history(spark, folder).select(
        "id", C.example_metric(c("improved_prompt"), c("context"), c("original_idea"), c("framework"), F.size("guardrails")).alias("metric")
    )


@query(
    "case_assertions",
    over_runs("SELECT case_id, run, length(output) >= 100 AND contains(output, 'a') AND NOT contains(output, 'TBD') AS passed FROM v_runs"),
)
def case_assertions(spark, folder):
    return views.runs(spark, folder).select(
        "case_id", "run",
        C.case_assertions(F.col("output"), F.lit(100), F.array(F.lit("a")), F.array(F.lit("TBD"))).alias("passed"),
    )


@query(
    "arm_gates",
    over_history(
        f"""SELECT id, true AS json_valid, confidence >= 0.7e0 AS confidence_ok, length(improved_prompt) >= 50 AS min_length_ok, context <> '' AS has_structure,
        NOT {has("lower(improved_prompt)", fixed.AI_SPEAK)} AS no_ai_speak FROM v_history"""
    ),
)
def arm_gates(spark, folder):
    c = F.col
    gates = C.arm_gates(c("improved_prompt"), c("confidence"), c("role"), c("directive"), c("framework"), F.lit(0.7), F.lit(50), c("error"))
    return _arms(spark, folder).select("id", gates.alias("g")).select("id", "g.*")
