"""Registration of queries, and SQL texts of the shared views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark import fixed
from quillspark.sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles cut to digits both engines agree on whatever the order of addition."""
    for name in names:
        df = df.withColumn(name, F.round(name, digits))
    return df


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(column: str, terms) -> str:
    """Any of the terms is a substring."""
    return "(" + " OR ".join(f"contains({column}, {q(t)})" for t in terms) + ")"


def count_terms(column: str, terms) -> str:
    return "(" + " + ".join(f"contains({column}, {q(t)})::INT" for t in terms) + ")"


def ladder_sql(score: str, steps, below: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {least}e0 THEN {q(g)}" for least, g in steps) + f" ELSE {q(below)} END"


def first_sql(column: str, labelled, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(column, t)} THEN {q(label)}" for label, t in labelled) + f" ELSE {q(default)} END"


SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
STRIP_SET = "".join(
    f"chr({c}) || "
    for c in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287]
) + "chr(12288)"


def strip_sql(column: str) -> str:
    return f"trim({column}, {STRIP_SET})"


def words_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, {q(SPACE + '+')}), lambda w: w <> '')"


def py(pattern: str) -> str:
    """A pattern for RE2 with Unicode spaces, words and digits; for patterns without classes around them."""
    return pattern.replace(r"\s", SPACE).replace(r"\w", WORD).replace(r"\d", r"\p{Nd}")


def re_any(column: str, patterns, flags: str = "(?i)") -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {q(flags + py(p))})" for p in patterns) + ")"


def whole(column: str, term: str) -> str:
    return f"regexp_matches(lower({column}), {q('(^|[^' + WORD[1:-1] + '])' + term + '($|[^' + WORD[1:-1] + '])')})"


def sum_sql(start: str, terms) -> str:
    """``start`` plus signed amounts taken one at a time, as floating point adds them."""
    out = start
    for condition, amount in terms:
        sign = "+" if amount >= 0 else "-"
        out = f"({out} {sign} CASE WHEN {condition} THEN {abs(amount)}e0 ELSE 0e0 END)"
    return out


def pick_sql(index: str, options) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN {q(o)}" for i, o in enumerate(options)) + " END"


def openings_sql(least: int, cooldown: int) -> str:
    """State of a breaker failure by failure: count, end of the opening, and whether it opens here."""
    opens = f"(until IS NULL OR t.ts >= until) AND (CASE WHEN until IS NULL THEN cnt ELSE 0 END) + 1 = {least}"
    return f"""WITH RECURSIVE i AS (SELECT user_id, ts, event_id, event_type, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
      t AS (SELECT user_id, island, ts, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS n FROM i WHERE event_type = 'error'),
      s(user_id, island, n, ts, cnt, until, opens) AS (
        SELECT user_id, island, n, ts, 1, CASE WHEN {least} = 1 THEN ts + INTERVAL {cooldown} SECOND END, {least} = 1 FROM t WHERE n = 1
        UNION ALL SELECT t.user_id, t.island, t.n, t.ts,
          CASE WHEN until IS NOT NULL AND t.ts < until THEN cnt WHEN until IS NULL THEN cnt + 1 ELSE 1 END,
          CASE WHEN until IS NOT NULL AND t.ts < until THEN until WHEN {opens} THEN t.ts + INTERVAL {cooldown} SECOND END, {opens}
        FROM s JOIN t ON t.user_id = s.user_id AND t.island = s.island AND t.n = s.n + 1)"""


def lines_literal(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


HISTORY_SQL = f"""
pairs AS (
  SELECT conv_id, turn, text AS idea, next_text AS reply FROM (
    SELECT conv_id, turn, role, text,
      lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant'),
sys AS (SELECT conv_id, arg_min(text, turn) AS context FROM conversations WHERE role = 'system' GROUP BY conv_id),
v_history AS (
  SELECT p.conv_id, p.turn, p.conv_id * 1048576 + p.turn AS id, idea AS original_idea,
    coalesce(context, '') AS context, (p.conv_id + p.turn) % 6 AS variant,
    CASE (p.conv_id + p.turn) % 6 WHEN 0 THEN reply
      {" ".join(f"WHEN {n} THEN {lines_literal(t)} || reply" for n, t in views.PREFIXES.items())}
      ELSE '{{"prompt":"p' || p.conv_id || CASE WHEN p.conv_id % 2 = 0 THEN '","role":"writer","context":"notes","reply":' ELSE '","role":"","context":null,"reply":' END
        || to_json(reply) || '}}' END AS improved_prompt,
    {pick_sql("((p.conv_id + p.turn) % 6)", views.TEMPLATE_BY_VARIANT)} AS template_id,
    {pick_sql("(p.conv_id % 5)", views.PROVIDERS)} AS provider,
    {pick_sql("(p.conv_id % 5)", views.MODELS)} AS model,
    CASE WHEN p.conv_id % 2 = 0 THEN 'zero-shot' ELSE 'few-shot' END AS backend,
    {pick_sql("((p.conv_id // 5) % 4)", views.FRAMEWORKS)} AS framework,
    [{", ".join(q(g) for g in views.GUARDRAILS)}][1:(p.conv_id % 4)::INT] AS guardrails,
    ((p.conv_id * 37 + p.turn * 11) % 101)::DOUBLE / 100e0 AS confidence,
    ((p.conv_id * 7919 + p.turn * 104729) % 40000)::INT AS latency_ms,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(p.conv_id) + to_minutes(p.turn) AS created_at
  FROM pairs p LEFT JOIN sys USING (conv_id))"""

IMPACT_SQL = """
v_impact AS (
  SELECT user_id AS conv_id, count(*) FILTER (event_type = 'click') AS copy_count,
    count(*) FILTER (event_type = 'error') AS regeneration_count, count(*) FILTER (event_type = 'view') AS reuse_count,
    CASE WHEN user_id % 7 <> 0 THEN (1 + user_id % 5)::INT END AS feedback_score
  FROM events GROUP BY user_id)"""

PRICES_SQL = (
    "prices(pp, pm, rate_in, rate_out) AS (VALUES "
    + ", ".join(f"({q(p)}, {q(m)}, {i:.8f}::DOUBLE, {o:.8f}::DOUBLE)" for p, m, i, o in fixed.PRICES)
    + ")"
)

ROLE_SQL = re_any("improved_prompt", fixed.ROLE_MARKS)
DIRECTIVE_SQL = re_any("improved_prompt", fixed.DIRECTIVE_MARKS)
COHERENCE_SQL = "greatest(0e0, least(1e0, " + sum_sql(
    "0.5e0",
    [
        (f"regexp_matches(improved_prompt, {q('(?m)' + py(chr(94) + '#+' + chr(92) + 's*' + chr(92) + 'w+'))})", 0.15),
        ("contains(improved_prompt, chr(10) || chr(10))", 0.10),
        (f"regexp_matches(improved_prompt, {q('(?m)' + py(fixed.BULLET_LINE))})", 0.10),
        (f"regexp_matches(improved_prompt, {q('(?m)' + py(fixed.STEP_LINE))})", 0.10),
        ("length(improved_prompt) < 100", -0.20),
        ("length(improved_prompt) > 500 AND NOT contains(substring(improved_prompt, 1, 200), chr(10))", -0.15),
    ],
) + "))"
TERMS_SQL = f"list_distinct(regexp_extract_all(lower(original_idea), {q(WORD + '{3,}')}))"
RELEVANCE_SQL = (
    f"CASE WHEN len({TERMS_SQL}) = 0 THEN 0.5e0 ELSE least(1e0, "
    + sum_sql(
        f"len(list_filter({TERMS_SQL}, lambda t: contains(lower(improved_prompt), t)))::DOUBLE / len({TERMS_SQL})",
        [(has("lower(original_idea)", fixed.SCORE_VERBS) + " AND " + has("lower(improved_prompt)", fixed.SCORE_VERBS), 0.10)],
    )
    + ") END"
)
COMPLETENESS_SQL = "least(1e0, " + sum_sql(
    "0e0",
    [
        (ROLE_SQL, 0.25), (DIRECTIVE_SQL, 0.25),
        ("framework <> 'chain-of-thought' AND contains(lower(improved_prompt), lower(framework))", 0.15),
        (re_any("improved_prompt", fixed.GUARDRAIL_MARKS), 0.15), ("len(guardrails) > 0", 0.10),
        (re_any("improved_prompt", [fixed.BACKGROUND_MARK]), 0.10),
    ],
) + ")"
HEDGE_LIST = ", ".join(q(h) for h in fixed.HEDGES)
CLARITY_SQL = "greatest(0e0, least(1e0, " + sum_sql(
    "1e0",
    [(whole("improved_prompt", t), -0.05) for t in fixed.VAGUE_TERMS]
    + [(whole("improved_prompt", t), -0.03) for t in fixed.UNSURE_TERMS]
    + [
        (
            f"len(list_filter(regexp_extract_all(lower(improved_prompt), {q(WORD + '+')}), lambda w: w IN ({HEDGE_LIST}))) > 3",
            -0.10,
        ),
        (re_any("improved_prompt", [fixed.COUNTED_MARK]), 0.05),
        (re_any("improved_prompt", [fixed.EXAMPLE_MARK]), 0.05),
    ],
) + "))"

QUALITY_SQL = f"""
v_quality AS (
  SELECT *, least(1e0, coherence * 0.3e0 + relevance * 0.3e0 + completeness * 0.2e0 + clarity * 0.2e0
      + least(guardrails_count * 0.05e0, 0.15e0) + CASE WHEN has_structure THEN 0.1e0 ELSE 0e0 END) AS quality
  FROM (SELECT *, len(guardrails)::INT AS guardrails_count, {COHERENCE_SQL} AS coherence, {RELEVANCE_SQL} AS relevance,
      {COMPLETENESS_SQL} AS completeness, {CLARITY_SQL} AS clarity, {ROLE_SQL} AND {DIRECTIVE_SQL} AS has_structure
    FROM v_history))"""

SCORED_SQL = f"""
v_priced AS (
  SELECT h.*, coalesce(i.copy_count, 0) AS copy_count, coalesce(i.regeneration_count, 0) AS regeneration_count,
    coalesce(i.reuse_count, 0) AS reuse_count, i.feedback_score,
    length(original_idea) // 4 AS t_in, length(improved_prompt) // 4 AS t_out,
    coalesce(p.rate_in, d.rate_in, 0e0) AS rate_in, coalesce(p.rate_out, d.rate_out, 0e0) AS rate_out
  FROM v_quality h LEFT JOIN v_impact i USING (conv_id)
  LEFT JOIN prices p ON lower(h.provider) = p.pp AND h.model = p.pm
  LEFT JOIN prices d ON lower(h.provider) = d.pp AND d.pm = 'default'),
v_performance AS (
  SELECT *, t_in + t_out AS total_tokens, (t_in / 1000e0) * rate_in + (t_out / 1000e0) * rate_out AS cost_usd,
    CASE WHEN copy_count + regeneration_count > 0 THEN copy_count::DOUBLE / (copy_count + regeneration_count) ELSE 0e0 END
      AS success_rate
  FROM v_priced),
v_parts AS (
  SELECT *,
    greatest(0e0, least(1e0, 1e0 - (latency_ms - 5000e0) / 25000e0)) * 0.5e0
      + greatest(0e0, least(1e0, 1e0 - (cost_usd - 0.01e0) / 0.09e0)) * 0.3e0
      + greatest(0e0, least(1e0, 1e0 - (total_tokens - 1000e0) / 4000e0)) * 0.2e0 AS performance,
    least(1e0, copy_count / 3e0) * 0.3e0 + success_rate * 0.3e0
      + (coalesce(feedback_score, 3) / 5e0) * 0.25e0 + least(1e0, reuse_count / 2e0) * 0.15e0 AS impact
  FROM v_performance),
v_scored AS (
  SELECT *, {ladder_sql("overall", fixed.OVERALL_LADDER, "D")} AS grade,
    quality >= 0.6e0 AND performance >= 0.4e0 AND success_rate >= 0.5e0 AS acceptable
  FROM (SELECT *, quality * 0.5e0 + performance * 0.25e0 + impact * 0.25e0 AS overall FROM v_parts))"""


def over_history(select: str) -> str:
    return f"WITH {HISTORY_SQL} {select}"


def over_quality(select: str) -> str:
    return f"WITH {HISTORY_SQL}, {QUALITY_SQL} {select}"


def over_scored(select: str) -> str:
    return f"WITH {HISTORY_SQL}, {QUALITY_SQL}, {IMPACT_SQL}, {PRICES_SQL}, {SCORED_SQL} {select}"
