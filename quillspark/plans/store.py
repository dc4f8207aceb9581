"""Queries over the history store, conversations, event logs and text repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import fixed
from quillspark.functions import extract as X
from quillspark.operators import gating, normalize as N, recover, sessions as S, store as T
from quillspark.plans.common import SPACE, count_terms, has, openings_sql, over_history, pick_sql, py, q, query, re_any, rounded, strip_sql, words_sql
from quillspark.sources import views


@query(
    "history_page",
    over_history("SELECT id, created_at, provider FROM v_history WHERE provider = 'anthropic' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 10"),
)
def history_page(spark, folder):
    return T.find_recent(views.history(spark, folder), 20, 10, provider="anthropic").select("id", "created_at", "provider")


@query(
    "history_search",
    over_history("SELECT id, created_at FROM v_history WHERE original_idea ILIKE '%the%' OR improved_prompt ILIKE '%the%' ORDER BY created_at DESC, id DESC LIMIT 50"),
)
def history_search(spark, folder):
    return T.search(views.history(spark, folder), "the", 50).select("id", "created_at")


@query(
    "history_range",
    over_history("SELECT id, created_at FROM v_history WHERE created_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-04' ORDER BY created_at DESC, id DESC LIMIT 100"),
)
def history_range(spark, folder):
    day = lambda d: F.lit(f"2024-01-{d} 00:00:00").cast("timestamp")
    return T.by_date_range(views.history(spark, folder), day("02"), day("04"), 100).select("id", "created_at")


@query("group_filter", over_history("SELECT id, model FROM v_history WHERE model = 'deepseek-chat'"))
def group_filter(spark, folder):
    from quillspark.operators.metrics import group_filter as parse

    return views.history(spark, folder).filter(parse("model:deepseek-chat")).select("id", "model")


@query("history_by_id", over_history("SELECT id, framework FROM v_history WHERE id = 3 * 1048576"))
def history_by_id(spark, folder):
    return T.by_key(views.history(spark, folder), "id", 3 << 20).select("id", "framework")


@query("history_retention", over_history("SELECT count(*) FILTER (created_at < TIMESTAMP '2024-01-04') AS deleted FROM v_history"))
def history_retention(spark, folder):
    _, deleted = T.retain(views.history(spark, folder), F.lit("2024-01-14 00:00:00").cast("timestamp"), 10)
    return deleted


@query("distinct_frameworks", over_history("SELECT DISTINCT framework FROM v_history"))
def distinct_frameworks(spark, folder):
    return T.distinct_values(views.history(spark, folder), "framework")


@query(
    "export_examples",
    over_history(
        """SELECT original_idea || CASE WHEN context <> '' THEN chr(10) || chr(10) || 'Context: ' || context ELSE '' END AS input, improved_prompt AS output, framework, confidence
        FROM v_history ORDER BY created_at DESC, id DESC LIMIT 50"""
    ),
)
def export_examples(spark, folder):
    return T.export_examples(views.history(spark, folder), 50).select("input", "output", "metadata.framework", "metadata.confidence")


@query(
    "session_turns",
    """SELECT conv_id, turn, turn_number, least(u, 2) AS current_turn, u >= 2 AS resolved, greatest(0, 2 - least(u, 2)) AS remaining FROM (
    SELECT conv_id, turn, row_number() OVER w AS turn_number, sum((role = 'user')::INT) OVER w AS u FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""",
)
def session_turns(spark, folder):
    df = S.wizard_turns(views.table(spark, folder, "conversations"), max_turns=2)
    return df.select("conv_id", "turn", "turn_number", "current_turn", "resolved", "remaining")


@query(
    "session_turns_reopening",
    """WITH RECURSIVE t AS (SELECT conv_id, turn, role, length(text) % 2 = 0 AS clear, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    s(conv_id, turn, n, cur, res) AS (
      SELECT conv_id, turn, n, (role = 'user')::INT, CASE role WHEN 'assistant' THEN clear ELSE false END FROM t WHERE n = 1
      UNION ALL SELECT t.conv_id, t.turn, t.n, cur + (role = 'user' AND NOT res)::INT,
        CASE WHEN role = 'assistant' THEN clear WHEN role = 'user' AND NOT res THEN cur + 1 >= 2 ELSE res END
      FROM s JOIN t ON t.conv_id = s.conv_id AND t.n = s.n + 1)
    SELECT conv_id, turn, n AS turn_number, cur AS current_turn, res AS resolved, greatest(0, 2 - cur) AS remaining FROM s""",
)
def session_turns_reopening(spark, folder):
    df = S.wizard_turns(views.table(spark, folder, "conversations"), max_turns=2, clear=F.length("text") % 2 == 0)
    return df.select("conv_id", "turn", "turn_number", "current_turn", "resolved", "remaining")


@query(
    "final_answer",
    over_history("SELECT conv_id, arg_max(improved_prompt, turn) AS final_prompt FROM v_history WHERE starts_with(improved_prompt, '#') GROUP BY conv_id"),
)
def final_answer(spark, folder):
    turns = views.history(spark, folder).select("conv_id", "turn", F.lit("assistant").alias("role"), F.col("improved_prompt").alias("text"))
    return S.final_answer(turns)


@query(
    "keep_newest",
    "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20",
)
def keep_newest(spark, folder):
    events = views.table(spark, folder, "events")
    return S.keep_newest(events, 20, [F.desc("ts"), F.desc("event_id")], ["user_id"]).select("user_id", "event_id")


@query(
    "latest_per_key",
    "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
)
def latest_per_key(spark, folder):
    events = views.table(spark, folder, "events")
    return S.latest_per_key(events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query(
    "idle_sessions",
    """SELECT user_id AS conv_id, max(ts) AS last_activity FROM events GROUP BY user_id
    HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""",
)
def idle_sessions(spark, folder):
    turns = views.table(spark, folder, "events").select(F.col("user_id").alias("conv_id"), "ts")
    return S.idle_sessions(turns, turns.agg(F.max("ts").alias("t")).scalar(), hours=24)


@query(
    "failure_streaks",
    """SELECT user_id, count(*) AS length, min(ts) AS started_at, max(ts) AS last_at, max(ts) FILTER (k = 3) AS opened_at, max(ts) FILTER (k = 3) + INTERVAL 300 SECOND AS open_until FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS k FROM (
      SELECT user_id, ts, event_id, event_type, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
    WHERE event_type = 'error') GROUP BY user_id, island HAVING count(*) >= 3""",
)
def failure_streaks(spark, folder):
    events = views.table(spark, folder, "events")
    return S.failure_streaks(events, "user_id", "ts", "event_id", F.col("event_type") == "error", least=3)


@query(
    "failure_openings",
    openings_sql(2, 600) + "SELECT user_id, ts AS opened_at, until AS open_until FROM s WHERE opens",
)
def failure_openings(spark, folder):
    events = views.table(spark, folder, "events")
    return S.failure_openings(events, "user_id", "ts", "event_id", F.col("event_type") == "error", least=2, cooldown=600)


CACHE_SQL = """v_log AS (SELECT sha256(user_id || '|' || event_type) AS cache_key, event_id AS prompt_id, ts, event_id,
    CASE WHEN event_id % 997 = 500 THEN 'delete' WHEN event_id % 5 = 0 THEN 'put' ELSE 'get' END AS op FROM events),
  v_gone AS (SELECT cache_key, max((ts, event_id)) AS gone FROM v_log WHERE op = 'delete' GROUP BY cache_key),
  v_cache AS (SELECT cache_key, min(ts) FILTER (op = 'put') AS created_at, arg_max(prompt_id, (ts, event_id)) FILTER (op = 'put') AS prompt_id,
    count(*) FILTER (op = 'get') AS hit_count, max(ts) AS last_accessed
    FROM v_log LEFT JOIN v_gone USING (cache_key) WHERE op <> 'delete' AND (gone IS NULL OR (ts, event_id) > gone) GROUP BY cache_key
    HAVING count(*) FILTER (op = 'put') > 0)"""


def _cache(spark, folder):
    event = F.col("event_id")
    op = F.when(event % 997 == 500, "delete").when(event % 5 == 0, "put").otherwise("get")
    return S.fold_cache(views.cache_log(spark, folder).withColumn("op", op))


@query("cache_compaction", f"WITH {CACHE_SQL} SELECT * FROM v_cache")
def cache_compaction(spark, folder):
    return _cache(spark, folder)


@query(
    "cache_statistics",
    f"WITH {CACHE_SQL} SELECT count(*) AS total_entries, sum(hit_count)::BIGINT AS total_hits, round(avg(hit_count), 6) AS avg_hit_count, max(last_accessed) AS last_accessed FROM v_cache",
)
def cache_statistics(spark, folder):
    return rounded(S.cache_statistics(_cache(spark, folder)), "avg_hit_count")


@query(
    "chat_messages",
    "SELECT conv_id, turn // 256 AS chunk, count(*) AS messages, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY ALL",
)
def chat_messages(spark, folder):
    df = N.chat_messages(views.table(spark, folder, "conversations"))
    return df.select(
        "conv_id", "chunk", F.size("messages").cast("long").alias("messages"),
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
    )


@query(
    "context_by_request",
    """SELECT request, string_agg('### CONTEXT SOURCE: ' || url || ' (Category: general)' || chr(10) || html, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY p DESC, page_id) AS context
    FROM (SELECT page_id // 5 AS request, page_id, url, html, 1 + page_id % 3 AS p FROM pages) GROUP BY request""",
)
def context_by_request(spark, folder):
    pages = views.table(spark, folder, "pages").select(
        F.floor(F.col("page_id") / 5).alias("request"), F.col("page_id").alias("pos"), F.col("url").alias("source"),
        F.col("html").alias("content"), (F.lit(1) + F.col("page_id") % 3).alias("priority"), F.lit("general").alias("category"),
    )
    return N.aggregate_context(pages, "request")


# --- text repair -------------------------------------------------------------------------------------

CUT = "substring(text, 1, 800)"
RFIND = lambda c: f"(CASE WHEN contains({CUT}, {c}) THEN length({CUT}) - strpos(reverse({CUT}), {c}) ELSE -1 END)"


@query(
    "truncate_text",
    f"""SELECT doc_id, CASE WHEN {RFIND("'.'")} > 560 THEN substring({CUT}, 1, {RFIND("'.'")} + 1) WHEN {RFIND("chr(10)")} > 560 THEN substring({CUT}, 1, {RFIND("chr(10)")})
    ELSE {CUT} || '...' END AS cut FROM documents""",
)
def truncate_text(spark, folder):
    return views.documents(spark, folder).select("doc_id", N.truncate_at_sentence(F.col("text"), 800).alias("cut"))


SPLIT = f"regexp_split_to_array(text, {q(chr(92) + 'r?' + chr(92) + 'n')})"
ASKS = f"(starts_with({strip_sql('s')}, '¿') OR contains(s, '?'))"


@query(
    "question_lines",
    f"""SELECT doc_id, CASE WHEN k <> '' THEN length(k) ELSE length({strip_sql("text")}) END AS kept_length, len(d[1:3])::INT AS question_count FROM (
    SELECT doc_id, text, {strip_sql(f"array_to_string(list_filter({SPLIT}, lambda s: NOT {ASKS}), chr(10))")} AS k,
      list_distinct(list_transform(list_filter({SPLIT}, lambda s: {ASKS}), lambda s: lower(regexp_replace({strip_sql("s")}, {q(SPACE + "+")}, ' ', 'g')))) AS d FROM documents)""",
)
def question_lines(spark, folder):
    cut = N.strip_question_lines(F.col("text"), F.lit(None).cast("array<string>"))
    return views.documents(spark, folder).select("doc_id", cut.alias("c")).select(
        "doc_id", F.length("c.improved_prompt").cast("long").alias("kept_length"), F.size("c.clarifying_questions").alias("question_count")
    )


@query(
    "guardrail_lists",
    f"SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda s: {strip_sql('s')}), lambda s: s <> ''))::INT AS n FROM documents",
)
def guardrail_lists(spark, folder):
    return views.documents(spark, folder).select("doc_id", F.size(N.normalize_guardrails(F.col("text"))).alias("n"))


@query(
    "extract_confidence",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN value END AS confidence FROM events",
)
def extract_confidence(spark, folder):
    event = F.col("event_id")
    raw = F.when(event % 3 == 0, "high").when(event % 3 == 1, F.col("value").cast("string"))
    return views.table(spark, folder, "events").select("event_id", N.extract_confidence(raw).alias("confidence"))


@query(
    "json_recovery",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'fence' WHEN 2 THEN 'tag' ELSE 'scan' END AS method, true AS ok,
    (props->>'$.k')::BIGINT AS k FROM events""",
)
def json_recovery(spark, folder):
    props, event = F.col("props"), F.col("event_id")
    raw = (
        F.when(event % 4 == 0, props)
        .when(event % 4 == 1, F.concat(F.lit("Here it is:\n```json\n"), props, F.lit("\n```\nDone {")))
        .when(event % 4 == 2, F.concat(F.lit("Well <json>"), props, F.lit("</json> }")))
        .otherwise(F.concat(F.lit("so } "), props, F.lit(" {\"rest\": 1}")))
    )
    df = recover.recover_json(views.table(spark, folder, "events").withColumn("raw", raw), "raw")
    return df.select("event_id", F.coalesce("method", F.lit("direct")).alias("method"), "ok", F.get_json_object("json", "$.k").cast("long").alias("k"))


# --- extraction --------------------------------------------------------------------------------------

HUB_SQL = """v_hub AS (SELECT id, 'user/prompt-' || id AS handle, improved_prompt AS template,
  CASE variant WHEN 2 THEN ['Agent', 'tool'] WHEN 3 THEN ['Context'] ELSE []::VARCHAR[] END AS tags FROM v_history)"""


def hub(spark, folder):
    none = F.array().cast("array<string>")
    tags = F.when(F.col("variant") == 2, F.array(F.lit("Agent"), F.lit("tool"))).when(F.col("variant") == 3, F.array(F.lit("Context"))).otherwise(none)
    return views.history(spark, folder).select(
        "id", F.concat(F.lit("user/prompt-"), F.col("id").cast("string")).alias("handle"), F.lit(None).cast("string").alias("name"),
        F.col("improved_prompt").alias("template"), tags.alias("tags"),
    )


def first_regex(text: str, patterns, default: str) -> str:
    parts = [
        f"CASE WHEN regexp_matches({text}, {q('(?i)' + py(p))}) THEN regexp_replace({strip_sql(f'regexp_extract({text}, ' + q('(?i)' + py(p)) + ', 1)')}, {q(SPACE + '+')}, ' ', 'g') END"
        for p in patterns
    ]
    return f"coalesce({', '.join(parts)}, {q(default)})"


# the patterns' own bracket classes hold a plain \n only, so they read the same in both engines
@query(
    "extract_fields",
    over_history("").rstrip()
    + f""", {HUB_SQL} SELECT handle, {first_regex(strip_sql("template"), fixed.BASIC_ROLES, "AI Assistant")} AS role,
    CASE {" ".join(f"WHEN {has('lower(template)', k)} OR len(list_intersect(list_transform(tags, lambda t: lower(t)), {k!r})) > 0 THEN '{n}'" for n, k in fixed.BASIC_FRAMEWORKS)} ELSE '' END AS framework
    FROM v_hub""",
)
def extract_fields(spark, folder):
    df = N.hub_to_example(hub(spark, folder))
    return df.select("handle", "outputs.role", "outputs.framework")


def _detection_sql() -> str:
    rows = []
    for rank, (name, (keywords, patterns)) in enumerate(fixed.FRAMEWORK_SIGNS.items()):
        sure = "0e0"
        for k in keywords:
            sure = f"({sure} + CASE WHEN contains(low, {q(k)}) THEN 0.15e0 ELSE 0e0 END)"
        for k in keywords:
            sure = f"({sure} + CASE WHEN list_contains(lt, {q(k)}) THEN 0.25e0 ELSE 0e0 END)"
        for p in patterns:
            sure = f"({sure} + CASE WHEN regexp_matches(low, {q(py(p))}) THEN 0.3e0 ELSE 0e0 END)"
        tagged = f"len(list_intersect(lt, {keywords!r})) > 0"
        rows.append(f"SELECT handle, {rank} AS r, '{name}' AS name, least({sure}, 1e0) AS confidence, {tagged} AS tagged FROM h")
    return f"h AS (SELECT handle, lower(template) AS low, list_transform(tags, lambda t: lower(t)) AS lt FROM v_hub), d AS ({' UNION ALL '.join(rows)})"


@query(
    "framework_detections",
    over_history("").rstrip()
    + f""", {HUB_SQL}, {_detection_sql()} SELECT handle, (row_number() OVER (PARTITION BY handle ORDER BY confidence DESC, r) - 1)::INT AS rank, name,
    round(confidence, 6) AS confidence FROM d WHERE confidence >= 0.3e0 OR tagged""",
)
def framework_detections(spark, folder):
    # rows leave by the explode: a filter on the array would pull the whole detection into its predicate
    found = X.with_detections(hub(spark, folder), "template", "tags", "d").select("handle", F.posexplode("d").alias("rank", "f"))
    return rounded(found.select("handle", "rank", "f.name", "f.confidence"), "confidence")


@query("metodized_prompts")
def metodized_prompts(spark, folder):
    df = N.metodize(hub(spark, folder))
    return df.select(
        "handle", "inputs.original_idea", "outputs.role", "outputs.directive", "outputs.framework", "outputs.guardrails",
        "metadata.quality_scores.overall_quality", F.array_join("metadata.detected_patterns", " | ").alias("patterns"),
    )


@query("extraction_quality")
def extraction_quality(spark, folder):
    scores = N.metodize(hub(spark, folder)).select("metadata.quality_scores.*")
    return scores.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in scores.columns])


@query("converter_comparison")
def converter_comparison(spark, folder):
    df = N.compare_converters(hub(spark, folder))
    return df.select(
        "handle", F.col("basic.role").alias("basic_role"), F.col("ranked.role").alias("ranked_role"),
        F.col("basic.framework").alias("basic_framework"), F.col("ranked.framework").alias("ranked_framework"), "quality_scores.overall_quality",
    )


def components(spark, folder):
    doc = F.col("doc_id")
    return views.documents(spark, folder).select(
        doc.alias("pos"), F.concat(F.lit("file-"), doc.cast("string")).alias("source_file"),
        views.pick(doc % 5, fixed.DOMAINS).alias("domain"), F.col("lang").alias("category"), F.col("source").alias("role"),
        F.col("text").alias("directive"), F.when(doc % 3 == 0, "N/A").when(doc % 3 == 1, "Chain-of-Thought").otherwise("").alias("framework"),
        F.when(doc % 2 == 0, F.array(F.lit("be brief"), F.lit("be kind"))).alias("guardrails"), (doc % 100 / 100.0).alias("confidence"),
    )


@query(
    "component_examples",
    f"""SELECT doc_id AS pos, CASE WHEN doc_id % 3 = 1 AND doc_id % 5 = 0 THEN 'Crea un prompt para ' || lang || ' usando Chain-of-Thought' ELSE 'Genera prompt de ' || lang END AS original_idea,
    array_to_string(list_filter(['## Role' || chr(10) || source, '## Directive' || chr(10) || text,
      CASE WHEN doc_id % 3 = 0 THEN '## Framework' || chr(10) || 'N/A' WHEN doc_id % 3 = 1 THEN '## Framework' || chr(10) || 'Chain-of-Thought' END,
      CASE WHEN doc_id % 2 = 0 THEN '## Guardrails' || chr(10) || 'be brief' || chr(10) || 'be kind' END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS improved_prompt FROM documents""",
)
def component_examples(spark, folder):
    parts = components(spark, folder)
    df = N.component_to_example(parts)
    return df.select(
        F.substring_index("metadata.source_file", "-", -1).cast("long").alias("pos"), "inputs.original_idea", "outputs.improved_prompt"
    )


def _expanded_sql(per_component: int) -> str:
    """Template by digest, placeholders filled, context appended: the operator's steps in SQL."""
    options = "CASE domain " + " ".join(
        f"WHEN {q(d)} THEN [{', '.join(q(t) for t in fixed.EXAMPLE_TEMPLATES[d])}]" for d in fixed.DOMAINS
    ) + " END"
    defaults = "CASE domain " + " ".join(f"WHEN {q(d)} THEN {q(fixed.DEFAULT_DIRECTIVES[d])}" for d in fixed.DOMAINS) + " END"
    filled = (
        f"replace(replace(replace(replace(template || {q(fixed.CONTEXT_TAIL)}, '{{role}}', role), '{{directive}}', directive), "
        "'{domain_lower}', lower(domain)), '{framework}', framework)"
    )
    return f"""WITH c AS (SELECT doc_id, 'file-' || doc_id AS source_file, {pick_sql("(doc_id % 5)", fixed.DOMAINS)} AS domain,
      regexp_replace({strip_sql("source")}, '\\.+$', '') AS r, regexp_replace({strip_sql("text")}, '\\.+$', '') AS d,
      CASE doc_id % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN 'Chain-of-Thought' ELSE '' END AS framework, doc_id % 100 / 100e0 AS confidence FROM documents),
    n AS (SELECT *, CASE WHEN r = '' THEN 'assistant' ELSE r END AS role, CASE WHEN d = '' THEN {defaults} ELSE d END AS directive, {options} AS options,
      unnest(range(0, {per_component}))::INT AS number FROM c),
    t AS (SELECT *, options[1 + (('0x' || substring(md5(source_file || '|' || domain || '|' || role || '|' || number || '|0'), 1, 8))::BIGINT % len(options))::INT] AS template FROM n),
    e AS (SELECT *, {strip_sql(f"replace(replace({filled}, '..', '.'), '  ', ' ')")} AS x FROM t)
    SELECT source_file || ':' || domain AS source_component_id, number, role, confidence,
      CASE WHEN regexp_matches(y, '[.!?]$') THEN y ELSE y || '.' END AS example
    FROM (SELECT *, CASE WHEN length(x) < 50 THEN x || {q(fixed.PADDING)} ELSE x END AS y FROM e)"""


@query("expanded_examples", _expanded_sql(3))
def expanded_examples(spark, folder):
    df = N.expand_examples(components(spark, folder), 3, "add_context")
    return df.select("metadata.source_component_id", "number", "role", "example", "metadata.confidence")


@query(
    "nested_values",
    """SELECT event_id, CASE WHEN event_id % 7 <> 5 AND event_id % 3 = 0 THEN json_extract_string(props, '$.k') END AS inner_value,
    CASE WHEN event_id % 7 = 5 THEN NULL WHEN event_id % 3 = 1 THEN event_type END AS outer_value FROM events""",
)
def nested_values(spark, folder):
    """A nested value where it is there, under a value that is no object, where its parent is missing, and in broken JSON."""
    event, props = F.col("event_id"), F.col("props")
    wrap = lambda before, value, after: F.concat(F.lit(before), value, F.lit(after))
    record = (
        F.when(event % 7 == 5, wrap('{"outputs": ', props, ""))
        .when(event % 3 == 0, wrap('{"outputs": {"inner": ', props, "}}"))
        .when(event % 3 == 1, wrap('{"outputs": "', F.col("event_type"), '"}'))
        .otherwise(wrap('{"other": ', props, "}"))
    )
    rows = views.table(spark, folder, "events").select("event_id", record.alias("record"))
    return rows.select(
        "event_id", N.nested_value(F.col("record"), "outputs.inner.k").alias("inner_value"),
        F.when(event % 3 == 1, N.nested_value(F.col("record"), "outputs")).alias("outer_value"),
    )
