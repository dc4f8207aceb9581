"""Queries that write the tables as documents and stored history, and read them back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark import fixed
from quillspark.operators import store as T
from quillspark.plans.common import over_history, pick_sql, query
from quillspark.session import materialise, note_written, read_folders, shared_folder
from quillspark.sources import jsondocs, readers as R, views, writers as W


def new_folder(spark) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/quillspark/{uuid.uuid4().hex}"
    note_written(path)
    return path


def written(spark, df, key=None) -> str:
    path = new_folder(spark)
    jsondocs.write_documents(df, path, key)
    return path


def text_of(column):
    return F.col(column).cast("string")


@query("source_examples", "SELECT doc_id, text AS original_idea, source AS improved_prompt, lang AS framework FROM documents")
def source_examples(spark, folder):
    """Documents as one pool in arrays, read back."""
    rows = views.documents(spark, folder).select(
        F.struct(F.col("text").alias("original_idea"), F.lit("").alias("context")).alias("inputs"),
        F.struct(F.col("source").alias("improved_prompt"), F.col("lang").alias("framework")).alias("outputs"),
        F.struct(text_of("doc_id").alias("doc_id")).alias("metadata"),
    )
    got = R.read_examples(spark, written(spark, rows))
    return got.select(F.col("metadata")["doc_id"].cast("long").alias("doc_id"), "inputs.original_idea", "outputs.improved_prompt", "outputs.framework")


KNOWN = [*fixed.DOMAINS, "cooking"]


@query(
    "source_components",
    f"""SELECT doc_id, CASE WHEN d = 'cooking' THEN 'other' ELSE d END AS domain, text AS directive, doc_id % 100 / 100e0 AS confidence,
    CASE WHEN doc_id % 2 = 0 THEN 'be brief|be, kind' ELSE 'be brief|be kind|' || lang END AS guardrails
    FROM (SELECT *, {pick_sql(f"(doc_id % {len(KNOWN)})", KNOWN)} AS d FROM documents) WHERE doc_id % 100 / 100e0 >= 0.2""",
)
def source_components(spark, folder):
    """Components below ``components``, guardrails as lists and as texts, unknown domains and unsure ones among them."""
    docs = views.documents(spark, folder).select(
        text_of("doc_id").alias("source_file"), views.pick(F.col("doc_id") % len(KNOWN), KNOWN).alias("domain"),
        F.col("text").alias("directive"), (F.col("doc_id") % 100 / 100.0).alias("confidence"), "lang", "doc_id",
    )
    lists = docs.filter("doc_id % 2 = 0").withColumn("guardrails", F.array(F.lit("be brief"), F.lit("be, kind"))).drop("lang", "doc_id")
    texts = docs.filter("doc_id % 2 = 1").withColumn("guardrails", F.concat(F.lit("be brief, be kind\n"), "lang")).drop("lang", "doc_id")
    paths = [written(spark, part, "components") for part in (lists, texts)]
    got = R.read_components(spark, paths)
    return got.select(
        F.col("source_file").cast("long").alias("doc_id"), "domain", "directive", "confidence", F.array_join("guardrails", "|").alias("guardrails")
    )


@query(
    "source_candidates",
    """SELECT doc_id, text AS original_idea, lang AS framework, CAST(doc_id % 100 / 4e0 AS VARCHAR) AS validation_score, source
    FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0""",
)
def source_candidates(spark, folder):
    """Hub candidates below ``candidates``; those that failed and those never validated do not come back."""
    doc = F.col("doc_id")
    rows = views.documents(spark, folder).select(
        F.struct(
            F.struct(F.col("text").alias("original_idea")).alias("inputs"), F.struct(F.col("lang").alias("framework")).alias("outputs"),
            F.struct(text_of("doc_id").alias("doc_id"), "source", F.lit("old").alias("validation_score")).alias("metadata"),
        ).alias("converted"),
        (doc % 100 / 4.0).alias("validation_score"), F.when(doc % 7 != 0, doc % 3 != 0).alias("validation_passed"),
    )
    got = R.read_validated_candidates(spark, written(spark, rows, "candidates"))
    meta = lambda name: F.col("metadata")[name]
    return got.select(
        meta("doc_id").cast("long").alias("doc_id"), "inputs.original_idea", meta("framework").alias("framework"),
        meta("validation_score").alias("validation_score"), meta("source").alias("source"),
    )


@query(
    "source_ab_results",
    """SELECT arm, doc_id, text AS improved_prompt, doc_id % 100 / 4e0 AS confidence FROM documents
    CROSS JOIN (VALUES ('one'), ('two')) AS a(arm) WHERE arm = 'one' OR doc_id % 4 = 1""",
)
def source_ab_results(spark, folder):
    """Results of two arms, each in documents of its own."""
    rows = views.documents(spark, folder).select(
        text_of("doc_id").alias("test_id"), F.col("text").alias("improved_prompt"), (F.col("doc_id") % 100 / 4.0).alias("confidence")
    )
    paths = [written(spark, rows, "one"), written(spark, rows.filter("test_id % 4 = 1"), "two")]
    got = R.read_ab_results(spark, paths, ["one", "two"])
    return got.select("arm", F.col("test_id").cast("long").alias("doc_id"), "improved_prompt", "confidence")


def stored_history(spark, folder) -> str:
    """History appended in two goes; the second adds to days of the first."""
    path = new_folder(spark)
    history = materialise(views.history(spark, folder))
    for part in (0, 1):
        W.append_history(history.filter(F.col("turn") % 4 == 2 * part + 1), path)
        W.append_history(history.filter(F.col("turn") % 4 == 2 * part), path)
    return path


@query(
    "history_stored_range",
    over_history(
        """SELECT id, created_at, original_idea, array_to_string(guardrails, '|') AS guardrails FROM v_history
        WHERE created_at BETWEEN TIMESTAMP '2024-01-02 05:00:00' AND TIMESTAMP '2024-01-04' ORDER BY created_at DESC, id DESC LIMIT 200"""
    ),
)
def history_stored_range(spark, folder):
    """A range of the stored history; only the day partitions it touches are read."""
    rows = R.decode_history(read_folders(spark, stored_history(spark, folder)))
    at = lambda text: F.lit(text).cast("timestamp")
    found = T.by_date_range(rows, at("2024-01-02 05:00:00"), at("2024-01-04 00:00:00"), 200)
    return found.select("id", "created_at", "original_idea", F.array_join("guardrails", "|").alias("guardrails"))


@query(
    "history_stored_retention",
    over_history("SELECT id, created_at FROM v_history WHERE created_at >= TIMESTAMP '2024-01-03 10:00:00'"),
)
def history_stored_retention(spark, folder):
    """What is left of the stored history after rows older than ten days went."""
    path = stored_history(spark, folder)
    W.retain_history(spark, path, "2024-01-13 10:00:00", 10)
    return read_folders(spark, path).select("id", "created_at")
