"""Queries over few-shot pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import fixed
from quillspark.functions import classify as K
from quillspark.functions.text import canonical_json, sha_key, stable_uuid
from quillspark.operators import normalize as N, pool as P, validate as V
from quillspark.plans.common import count_terms, first_sql, has, pick_sql, q, query, rounded
from quillspark.sources import views

POOL_SQL = f"""v_pool AS (SELECT doc_id AS pos, text AS original_idea, '' AS context, text AS improved_prompt,
  {pick_sql("(doc_id % 4)", views.FRAMEWORKS)} AS framework, source AS source_file FROM documents)"""
MERGED_SQL = f"""{POOL_SQL}, v_all AS (
  SELECT 0 AS source_rank, * FROM v_pool WHERE pos % 2 = 0 UNION ALL SELECT 1, * FROM v_pool),
v_merged AS (SELECT * FROM v_all QUALIFY row_number() OVER (
  PARTITION BY sha256(original_idea || '|||' || improved_prompt) ORDER BY source_rank, pos) = 1)"""


def merged(spark, folder):
    return P.dedup_by_io(
        P.union_sources({"pool_a": views.pool(spark, folder, only_even=True), "pool_b": views.pool(spark, folder)})
    )


@query(
    "pool_merge_dedup",
    f"WITH {MERGED_SQL} SELECT source_rank, pos, sha256(original_idea || '|||' || improved_prompt) AS io_hash, 'unique' AS duplication_status FROM v_merged",
)
def pool_merge_dedup(spark, folder):
    return merged(spark, folder).select("source_rank", "pos", "io_hash", "duplication_status")


@query(
    "pool_merge_new",
    f"""WITH {POOL_SQL}, h AS (SELECT pos, sha256(original_idea || '|||' || improved_prompt) AS io_hash FROM v_pool)
    SELECT io_hash, min(pos) AS pos FROM h WHERE io_hash NOT IN (SELECT io_hash FROM h WHERE pos % 2 = 0) GROUP BY io_hash""",
)
def pool_merge_new(spark, folder):
    _, added = P.merge_into(views.pool(spark, folder, only_even=True), views.pool(spark, folder))
    return added.select("io_hash", "pos")


@query(
    "dedup_by_input",
    f"WITH {POOL_SQL} SELECT min(pos) AS pos FROM v_pool GROUP BY original_idea, context",
)
def dedup_by_input(spark, folder):
    return P.dedup_by_input(views.pool(spark, folder)).select("pos")


@query(
    "stamp_dedup",
    f"WITH {POOL_SQL} SELECT true AS deduplicated, '2024-01-01' AS deduplication_date, count(*) AS n FROM (SELECT DISTINCT original_idea FROM v_pool)",
)
def stamp_dedup(spark, folder):
    df = P.stamp_dedup(P.dedup_by_input(views.pool(spark, folder)), F.lit("2024-01-01"))
    return df.groupBy("deduplicated", "deduplication_date").agg(F.count("*").alias("n"))


@query(
    "duplicate_audit",
    f"""WITH {POOL_SQL} SELECT sum(n)::BIGINT AS total_examples, count(*) AS unique_inputs, count(*) FILTER (n > 1) AS duplicate_inputs,
    coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_occurrences,
    round(coalesce(sum(n) FILTER (n > 1), 0) * 100e0 / sum(n), 6) AS duplication_rate
    FROM (SELECT count(*) AS n FROM v_pool GROUP BY original_idea, context)""",
)
def duplicate_audit(spark, folder):
    return rounded(P.duplicate_audit(views.pool(spark, folder), P.input_key()), "duplication_rate")


@query(
    "duplicate_members",
    f"WITH {POOL_SQL} SELECT pos, first_pos FROM (SELECT pos, count(*) OVER w AS n, min(pos) OVER w AS first_pos FROM v_pool WINDOW w AS (PARTITION BY original_idea, context)) WHERE n > 1",
)
def duplicate_members(spark, folder):
    pool = views.pool(spark, folder)
    return P.duplicate_members(pool, P.input_key()).select("pos", "first_pos")


@query(
    "output_consistency",
    f"""WITH {POOL_SQL} SELECT count(*) FILTER (d = 1) AS consistent, count(*) FILTER (d > 1) AS inconsistent FROM (
    SELECT count(*) AS n, count(DISTINCT improved_prompt) AS d FROM v_pool GROUP BY original_idea, context) WHERE n > 1""",
)
def output_consistency(spark, folder):
    return P.output_consistency(views.pool(spark, folder), P.input_key(), F.col("improved_prompt"))


@query(
    "dedup_report",
    f"""WITH {POOL_SQL} SELECT sum(n)::BIGINT AS original, count(*) AS "unique", (sum(n) - count(*))::BIGINT AS removed,
    round((sum(n) - count(*)) * 100e0 / sum(n), 6) AS removal_rate FROM (SELECT count(*) AS n FROM v_pool GROUP BY original_idea, context)""",
)
def dedup_report(spark, folder):
    return rounded(P.dedup_report(views.pool(spark, folder), P.input_key()), "removal_rate")


@query(
    "pool_statistics",
    f"""WITH {POOL_SQL} SELECT 'source_file' AS dimension, source_file AS value, count(*) AS n FROM v_pool GROUP BY source_file
    UNION ALL SELECT 'framework', framework, count(*) FROM v_pool GROUP BY framework""",
)
def pool_statistics(spark, folder):
    return P.statistics(views.pool(spark, folder), ["source_file", "framework"])


@query(
    "top_frameworks",
    f"""WITH {POOL_SQL} SELECT framework AS value, n, round(n * 100e0 / sum(n) OVER (), 6) AS share FROM (
    SELECT framework, count(*) AS n FROM v_pool GROUP BY framework) ORDER BY n DESC, value LIMIT 5""",
)
def top_frameworks(spark, folder):
    counts = P.statistics(views.pool(spark, folder), ["framework"]).select("value", "n")
    return rounded(P.top_values(P.with_share(counts), 5), "share")


IDEA_CATEGORY_SQL = (
    f"CASE WHEN {has('lower(original_idea)', fixed.META_PROMPT_TERMS)} THEN 'Uncategorized' ELSE "
    + first_sql("lower(original_idea)", [(c, t) for c, _, t in fixed.CATEGORIES], "Uncategorized")
    + " END"
)


@query(
    "top_categories",
    f"""WITH {POOL_SQL} SELECT category AS value, count(*) AS n FROM (SELECT {IDEA_CATEGORY_SQL} AS category FROM v_pool)
    GROUP BY category ORDER BY n DESC, value LIMIT 10""",
)
def top_categories(spark, folder):
    named = views.pool(spark, folder).select(K.category(F.col("original_idea"))["category"].alias("category"))
    return P.top_values(P.statistics(named, ["category"]).select("value", "n"), 10)


def _coverage_sql() -> str:
    wanted = ", ".join(f"({q(c)})" for c in fixed.WANTED_CATEGORIES)
    return f"""v_cat AS (SELECT {has("lower(original_idea)", fixed.META_PROMPT_TERMS)} AS meta, {IDEA_CATEGORY_SQL} AS category FROM v_pool),
    v_cover AS (SELECT w.category, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100e0 / (SELECT count(*) FROM v_cat WHERE NOT meta), 6) AS percent,
      CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < 3 THEN 'low' WHEN n < 5 THEN 'medium' ELSE 'good' END AS level
    FROM (VALUES {wanted}) w(category) LEFT JOIN (SELECT category, count(*) AS n FROM v_cat WHERE NOT meta GROUP BY category) USING (category))"""


def _cover(spark, folder):
    return P.coverage(views.pool(spark, folder).select(K.category(F.col("original_idea")).alias("c")))


@query("category_coverage", f"WITH {POOL_SQL}, {_coverage_sql()} SELECT * FROM v_cover")
def category_coverage(spark, folder):
    return rounded(_cover(spark, folder), "percent")


def _gaps_sql() -> str:
    rows = ", ".join(f"({q(k)}, {q(' | '.join(v))})" for k, v in fixed.GAP_SUGGESTIONS.items())
    return f"SELECT category, n, s AS suggestions FROM (VALUES {rows}) g(category, s) JOIN v_cover USING (category) WHERE n < 3"


@query("coverage_gaps", f"WITH {POOL_SQL}, {_coverage_sql()} {_gaps_sql()}")
def coverage_gaps(spark, folder):
    return P.coverage_gaps(_cover(spark, folder)).withColumn("suggestions", F.array_join("suggestions", " | "))


@query(
    "framework_families",
    f"""WITH {POOL_SQL}, f AS (SELECT {first_sql("lower(framework)", fixed.FRAMEWORK_FAMILIES, "Other")} AS family FROM v_pool)
    SELECT family, count(*) AS n, round(count(*) * 100e0 / (SELECT count(*) FROM f), 6) AS share FROM f GROUP BY family""",
)
def framework_families(spark, folder):
    df = views.pool(spark, folder).groupBy(K.framework_family(F.col("framework")).alias("family")).agg(F.count("*").alias("n"))
    return rounded(P.with_share(df), "share")


COMPLEXITY_BY_DOC = ["simple", "moderate", "complex"]


@query(
    "catalog_profile",
    f"""WITH {POOL_SQL}, r AS (SELECT CASE WHEN pos % 4 < 3 THEN {pick_sql("(pos % 4)", COMPLEXITY_BY_DOC)} ELSE 'unknown' END AS complexity,
      {first_sql("lower(original_idea)", [("explain", ["explain"]), ("create/implement", ["create", "implement"])], "other")} AS intent FROM v_marked)
    SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM r UNION ALL SELECT 'intent', intent, count(*) FROM r GROUP BY intent
    UNION ALL SELECT 'complexity', complexity, count(*) FROM r GROUP BY complexity""".replace(
        ", r AS", ", v_marked AS (SELECT pos, CASE pos % 5 WHEN 0 THEN 'Explain: ' WHEN 1 THEN 'implement ' ELSE '' END || original_idea AS original_idea FROM v_pool), r AS"
    ),
)
def catalog_profile(spark, folder):
    """Every fifth idea asks to explain, the next to implement; every fourth has no complexity."""
    pos = F.col("pos")
    mark = F.when(pos % 5 == 0, "Explain: ").when(pos % 5 == 1, "implement ").otherwise("")
    marked = views.pool(spark, folder).withColumns(
        {
            "original_idea": F.concat(mark, F.col("original_idea")),
            "complexity": F.when(pos % 4 < 3, views.pick(pos % 4, COMPLEXITY_BY_DOC)),
        }
    )
    return P.catalog_profile(marked)


@query(
    "skip_rate_guard",
    """SELECT total, valid, total - valid AS skipped, round((total - valid)::DOUBLE / total, 6) AS skip_rate,
    CASE WHEN valid = 0 OR (total - valid)::DOUBLE / total >= 0.2 THEN 'fail' WHEN (total - valid)::DOUBLE / total >= 0.05 THEN 'degraded'
      WHEN valid < total THEN 'warn' ELSE 'ok' END AS status
    FROM (SELECT count(*) AS total, count(*) FILTER (length(text) >= 50) AS valid FROM documents)""",
)
def skip_rate_guard(spark, folder):
    docs = views.documents(spark, folder)
    return rounded(P.skip_rate_guard(docs, F.length("text") >= 50), "skip_rate")


@query(
    "post_merge_checks",
    f"""WITH {MERGED_SQL}, f AS (SELECT count(*) AS size, count(*) FILTER (framework = 'decomposition') AS hits,
      (SELECT max(n) FROM (SELECT count(*) AS n FROM v_merged GROUP BY framework)) AS most,
      arg_min(improved_prompt, (source_rank, pos)) FILTER (framework = 'decomposition') AS prompt FROM v_merged)
    SELECT unnest(['pool_size','framework_present','prompt_structure','no_duplicates','metadata_complete','source_tracking','variables_present','framework_distribution','wrapper_keys']) AS "check",
      unnest([size >= 108, hits > 0, false, true, true, false, contains(prompt, '{{context}}') AND contains(prompt, '{{question}}'), hits > 0 AND most::DOUBLE / size < 0.8, true]) AS passed,
      unnest([size, hits, hits, 0, 0, hits, hits, most, size])::BIGINT AS detail FROM f""",
)
def post_merge_checks(spark, folder):
    pool = merged(spark, folder).withColumns(
        {"role": F.lit(""), "directive": F.lit(""), "guardrails": F.lit("")}
    )
    pool = pool.withColumn("pos", F.col("source_rank") * F.lit(1 << 40) + F.col("pos"))
    return P.post_merge_checks(pool, framework="decomposition")


@query(
    "sequential_split",
    """SELECT doc_id, i AS "index", CASE WHEN i < floor(n * 0.7e0) THEN 'train' WHEN i < floor(n * 0.7e0) + floor(n * 0.15e0) THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)""",
)
def sequential_split(spark, folder):
    docs = views.documents(spark, folder).select("doc_id")
    return P.sequential_split(docs, [F.col("doc_id")])


@query(
    "split_sizes",
    """SELECT split, count(*) AS n, round(avg(l), 6) AS mean_length FROM (
    SELECT CASE WHEN i < floor(n * 0.7e0) THEN 'train' WHEN i < floor(n * 0.7e0) + floor(n * 0.15e0) THEN 'validation' ELSE 'test' END AS split, l
    FROM (SELECT length(text) AS l, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)) GROUP BY split""",
)
def split_sizes(spark, folder):
    docs = views.documents(spark, folder).select("doc_id", F.col("text").alias("question"))
    return rounded(P.split_sizes(P.sequential_split(docs, [F.col("doc_id")]), "question"), "mean_length")


@query(
    "score_lookup",
    """SELECT d.doc_id::VARCHAR AS id, coalesce(l.quality::DOUBLE, 0.96e0) AS validator_score FROM documents d LEFT JOIN
    (SELECT doc_id, arg_max(quality, doc_id) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)""",
)
def score_lookup(spark, folder):
    prompts = views.documents(spark, folder).select(F.col("doc_id").cast("string").alias("id"))
    scores = views.table(spark, folder, "labels").select(
        F.concat(F.lit("label_"), F.col("doc_id").cast("string")).alias("id"), F.col("quality").cast("double").alias("score"),
    )
    return P.score_lookup(prompts, scores)


@query(
    "normalize_example",
    """SELECT doc_id AS pos, text AS original_idea, length(text) AS prompt_length,
    CASE WHEN doc_id % 10 = 0 THEN 'unknown' ELSE 'decomposition' END AS framework FROM documents""",
)
def normalize_example(spark, folder):
    docs = views.documents(spark, folder)
    flat = F.col("doc_id") % 10 == 0
    idea = F.col("text")
    mixed = docs.select(
        F.col("doc_id").alias("pos"),
        F.when(flat, idea).alias("input"), F.when(flat, F.col("text")).alias("output"),
        F.when(~flat, F.struct(idea.alias("original_idea"), F.lit("").alias("context"))).alias("inputs"),
        F.when(
            ~flat, F.struct(F.col("text").alias("improved_prompt"), F.lit("decomposition").alias("framework"))
        ).alias("outputs"),
        F.create_map(F.lit("origin"), F.col("source")).alias("metadata"),
    )
    return N.normalize_example(mixed).select(
        "pos", "inputs.original_idea", F.length("outputs.improved_prompt").alias("prompt_length"), "outputs.framework"
    )


@query(
    "prompt_to_unified",
    f"""WITH {POOL_SQL} SELECT pos, source_file AS category, 'unknown' AS domain, framework, 'medium' AS complexity, 0.85e0 AS quality_score,
    0.96e0 AS example_validator_score FROM v_pool""",
)
def prompt_to_unified(spark, folder):
    df = views.pool(spark, folder).select(
        "pos", F.col("pos").cast("string").alias("id"), "original_idea", "context", "improved_prompt", "framework",
        F.col("source_file").alias("sub_category"),
        *[F.lit(None).cast(t).alias(n) for n, t in (("task_category", "string"), ("domain", "string"), ("complexity", "string"), ("quality_score", "double"), ("validator_score", "double"))],
    )
    return N.prompt_to_unified(df).select("pos", "metadata.*").select(
        "pos", "category", "domain", "framework", "complexity", "quality_score", "example_validator_score"
    )


@query(
    "cache_keys",
    """SELECT doc_id, sha256(text || '||legacy') AS cache_key,
    substring(k, 1, 8) || '-' || substring(k, 9, 4) || '-' || substring(k, 13, 4) || '-' || substring(k, 17, 4) || '-' || substring(k, 21, 12) AS prompt_id
    FROM (SELECT *, sha256(text || '||legacy') AS k FROM documents)""",
)
def cache_keys(spark, folder):
    parts = (F.col("text"), F.lit(""), F.lit("legacy"))
    return views.documents(spark, folder).select(
        "doc_id", sha_key(*parts).alias("cache_key"), stable_uuid(*parts).alias("prompt_id")
    )


@query(
    "canonical_keys",
    "SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}' AS key FROM nation",
)
def canonical_keys(spark, folder):
    return views.table(spark, folder, "nation").select("n_nationkey", canonical_json("n_nationkey", "n_name").alias("key"))


@query(
    "structure_report",
    "SELECT count(*) AS examples, count(*) FILTER (doc_id % 97 = 5) AS invalid, min(doc_id) FILTER (doc_id % 97 = 5) AS first_invalid, "
    "CASE WHEN count(*) FILTER (doc_id % 97 = 5) > 0 THEN 'missing outputs' END AS first_violation FROM documents",
)
def structure_report(spark, folder):
    docs = views.documents(spark, folder).select(
        F.col("doc_id").alias("pos"),
        F.struct(F.col("text").alias("original_idea")).alias("inputs"),
        F.when(F.col("doc_id") % 97 != 5, F.struct(F.col("text").alias("improved_prompt"))).alias("outputs"),
    )
    return V.structure_report(docs)
