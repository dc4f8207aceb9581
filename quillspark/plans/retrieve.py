"""Queries over retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import fixed
from quillspark.functions.classify import route
from quillspark.operators import retrieve as R
from quillspark.plans.common import pick_sql, q, query, rounded, strip_sql, words_sql
from quillspark.sources import views


def requests(spark, folder):
    text = R.query_text(F.col("intent"), F.col("complexity"), F.col("user_input"))
    return R.check_requests(views.requests(spark, folder)).select(
        F.col("item_id").alias("query_id"), text.alias("text"), "intent", "complexity", F.col("user_input").alias("idea"),
    )


def catalog(spark, folder):
    return views.pool(spark, folder).select(F.col("pos").alias("catalog_id"), F.col("original_idea").alias("text"))


REQUEST_SQL = f"""req AS (SELECT item_id AS query_id, {pick_sql("(item_id % 4)", ["generate", "debug", "refactor", "explain"])} || ' ' ||
  {pick_sql("(item_id % 3)", ["simple", "moderate", "complex"])} || CASE WHEN {strip_sql("text")} <> '' THEN ' ' || {strip_sql("text")} ELSE '' END AS t FROM benchmark)"""
GRAMS = lambda key, source: f"""SELECT {key}, g, count(*)::DOUBLE AS w FROM (SELECT {key}, substring(lower(t), unnest(range(1, length(t))), 2) AS g FROM {source}) GROUP BY ALL"""
KNN_SQL = f"""WITH {REQUEST_SQL}, cat AS (SELECT doc_id AS catalog_id, text AS t FROM documents),
  cg AS ({GRAMS("catalog_id", "cat")}), qg AS (SELECT * FROM ({GRAMS("query_id", "req")}) WHERE g IN (SELECT g FROM cg)),
  cn AS (SELECT catalog_id, sum(w * w) AS n FROM cg GROUP BY 1), qn AS (SELECT query_id, sum(w * w) AS n FROM qg GROUP BY 1),
  dots AS (SELECT query_id, catalog_id, sum(q.w * c.w) AS d FROM qg q JOIN cg c USING (g) GROUP BY ALL),
  sims AS (SELECT query_id, catalog_id, d / (sqrt(cn.n) * sqrt(qn.n)) AS similarity FROM dots JOIN cn USING (catalog_id) JOIN qn USING (query_id))"""


@query(
    "knn_bigram",
    f"""{KNN_SQL} SELECT query_id, catalog_id, round(similarity, 6) AS similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, catalog_id) AS rank FROM sims WHERE similarity >= 0.1e0) WHERE rank <= 3""",
)
def knn_bigram(spark, folder):
    return rounded(R.knn_bigram(requests(spark, folder), catalog(spark, folder)), "similarity")


@query(
    "knn_metadata",
    f"""{KNN_SQL} SELECT query_id, round(max(similarity), 6) AS highest_similarity, 0.1e0 AS threshold, (SELECT count(*) FROM cat) AS total_candidates,
    max(similarity) >= 0.1e0 AS met_threshold FROM sims GROUP BY query_id""",
)
def knn_metadata(spark, folder):
    return rounded(R.knn_metadata(requests(spark, folder), catalog(spark, folder)), "highest_similarity")


@query(
    "knn_words",
    f"""WITH r AS (SELECT item_id AS query_id, list_distinct({words_sql("lower(text)")}) AS ws FROM benchmark),
    p AS (SELECT doc_id AS catalog_id, unnest(list_distinct({words_sql("lower(text)")})) AS w FROM documents),
    h AS (SELECT query_id, catalog_id, count(*) AS n FROM (SELECT query_id, unnest(ws) AS w FROM r) JOIN p USING (w) GROUP BY ALL),
    a AS (SELECT query_id, doc_id AS catalog_id, coalesce(n, 0)::DOUBLE / len(ws) AS similarity FROM r CROSS JOIN documents d
      LEFT JOIN h ON h.query_id = r.query_id AND h.catalog_id = d.doc_id)
    SELECT query_id, catalog_id, round(similarity, 6) AS similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, catalog_id) AS rank FROM a) WHERE rank <= 3""".replace("SELECT query_id, doc_id AS catalog_id, coalesce", "SELECT r.query_id, doc_id AS catalog_id, coalesce"),
)
def knn_words(spark, folder):
    asked = views.table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    pool = views.documents(spark, folder).select(F.col("doc_id").alias("pos"), "text")
    return rounded(R.knn_words(asked, pool), "similarity")


@query(
    "knn_embeddings",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS catalog_id, list_cosine_similarity(q.v, c.v) AS similarity FROM e q JOIN e c ON q.label = 0 AND c.label <> 0)
    SELECT query_id, catalog_id, round(similarity, 6) AS similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, catalog_id) AS rank FROM s) WHERE rank <= 3""",
)
def knn_embeddings(spark, folder):
    vectors = views.table(spark, folder, "embeddings")
    asked = vectors.filter("label = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    rest = vectors.filter("label <> 0").select(F.col("vec_id").alias("catalog_id"), F.col("embedding").alias("vector"))
    return rounded(R.knn_vectors(asked, rest), "similarity")


def _prompt_sql() -> str:
    """Role, task and examples put together as the operator does for requests without optional sections."""
    roles = "CASE " + " ".join(f"WHEN intent = {q(i)} AND complexity = {q(c)} THEN {q(r)}" for (i, c), (_, r) in fixed.ROUTES.items()) + " END"
    text = lambda level, ask, answer: (
        f"string_agg('{level} Example ' || rank || chr(10) || '**{ask}:** ' || text || chr(10) || '**{answer}:** ' || text || chr(10), chr(10) ORDER BY rank)"
    )
    lines = lambda value: value.replace("\n", "' || chr(10) || '")
    plain = lines(
        "'# Role\nYou are a ' || role || '.\n\n# Task\n' || idea || CASE WHEN n > 0 THEN "
        "'\n\n# Examples\nHere are some similar examples to guide you:\n\n' || plain_examples ELSE '' END"
    )
    focus = "CASE WHEN regexp_matches(lower(idea), 'optimizar|refactor') THEN 'Optimize the code for better performance and maintainability' ELSE 'Implement the requested functionality' END"
    rich = lines(
        f"'# Role\nYou are a ' || role || '.\n\n# Understanding the Request\nFirst, let me rephrase the request to ensure clarity:\n\n**Original Request:** ' || idea "
        f"|| '\n**Rephrased Understanding:** ' || {focus} || '\n\n# Task\nBased on the above understanding, please:' || CASE WHEN n > 0 THEN "
        "'\n\n## Reference Examples\nThese examples may help guide your approach:\n\n' || rich_examples ELSE '' END || "
        "'\n\n## Requirements\n- Provide a clear, well-structured response\n- Include code examples where applicable\n- Explain your reasoning'"
    )
    return f"""{KNN_SQL}, r AS (SELECT item_id, text AS idea, {pick_sql("(item_id % 4)", fixed.INTENTS)} AS intent, {pick_sql("(item_id % 3)", fixed.COMPLEXITIES)} AS complexity FROM benchmark),
    top AS (SELECT query_id, catalog_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, catalog_id) AS rank FROM sims WHERE similarity >= 0.1e0),
    ex AS (SELECT query_id, count(*) AS n, {text("##", "Input", "Output")} AS plain_examples,
      {text("###", "Request", "Response").replace(" ORDER BY rank)", " ORDER BY rank) FILTER (rank <= 3)")} AS rich_examples
      FROM top JOIN documents ON doc_id = catalog_id JOIN r ON item_id = query_id
      WHERE rank <= CASE WHEN complexity = 'complex' THEN 5 ELSE 3 END GROUP BY query_id)
    SELECT item_id AS query_id, CASE WHEN complexity = 'complex' THEN {rich} ELSE {plain} END AS template, coalesce(n, 0)::INT AS fewshot_count
    FROM (SELECT r.*, {roles} AS role, coalesce(n, 0) AS n, plain_examples, rich_examples FROM r LEFT JOIN ex ON query_id = item_id)"""


@query("fewshot_prompts", _prompt_sql())
def fewshot_prompts(spark, folder):
    asked = requests(spark, folder).withColumn("prompt_role", route(F.col("intent"), F.col("complexity"))["role"])
    examples = views.pool(spark, folder).select(
        F.col("pos").alias("catalog_id"), F.col("original_idea").alias("input_idea"), F.col("context").alias("input_context"),
        F.col("improved_prompt").alias("output"),
    )
    return R.fewshot_prompts(asked, examples_for(asked, catalog(spark, folder)), examples)


def examples_for(asked, known):
    """Five examples for complex requests, three for the rest."""
    large = F.col("complexity") == "complex"
    return R.knn_bigram(asked.filter(large), known, k=5).unionByName(R.knn_bigram(asked.filter(~large), known, k=3))


@query(
    "knn_expected_output",
    f"""{KNN_SQL.replace("dots AS (SELECT query_id, catalog_id, sum(q.w * c.w) AS d FROM qg q JOIN cg c USING (g)", "dots AS (SELECT query_id, catalog_id, sum(q.w * c.w) AS d FROM qg q JOIN cg c USING (g) WHERE catalog_id IN (SELECT doc_id FROM labels WHERE quality = 1)")}
    SELECT query_id, catalog_id, round(similarity, 6) AS similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, catalog_id) AS rank FROM sims WHERE similarity >= 0.1e0) WHERE rank <= 3""",
)
def knn_expected_output(spark, folder):
    """Only rows with an expected output are candidates; bigrams of the whole catalog count."""
    known = catalog(spark, folder)
    good = views.table(spark, folder, "labels").filter("quality = 1").select(F.col("doc_id").alias("catalog_id"))
    found = R.knn_bigram(requests(spark, folder), R.expected_output_examples(known, good), vocabulary=known)
    return rounded(found, "similarity")
