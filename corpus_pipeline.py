"""From raw documents to packed training windows, five stages over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, idfilter, jaccard, packing, pii, toxicity
from quillspark.llm.common import for_long_texts, table
from quillspark.session import note_written, shared_folder


@for_long_texts
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the lexicon learned from the labels rejects go."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@for_long_texts
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard of 0.75 or more the document with the smallest id stays."""
    found = jaccard.similarity_components(docs)
    return idfilter.without(docs, found.filter("component_id <> doc_id").select("doc_id").distinct(), "doc_id")


@for_long_texts
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark text go."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


@for_long_texts
def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; lengths follow."""
    return pii.redact(docs, pii.form_weights(docs))


@for_long_texts
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of at most 4096 tokens."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_private),
    ("packing", pack_windows),
]

# Lexicon, field and packing have no SQL form; the stages are held against brute force in the tests.
ORACLE_SQL = None


@for_long_texts
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage keeps is written to the shared folder and read by the next."""
    root = f"{shared_folder(spark).rstrip('/')}/quillspark-llm/pipeline-{uuid.uuid4().hex}"
    note_written(root)
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
