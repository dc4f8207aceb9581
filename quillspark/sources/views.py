"""Prompt-corpus views over the general tables: history, impact, pools, cases, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.operators.ordered import neighbour

TURN_BUCKET = 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with fewer splits than cores dealt out to all cores.

    For text work on a table in one small file; a table of many files keeps its own splits and is
    not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() * 2 <= cores else df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def pick(index, options):
    """One of a few literals by a 0-based index."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


# The decorations put around a reply by variant, so that scores and gates vary.
PREFIXES = {
    1: "# Role\nYou are a writer.\n\n# Task\n",
    2: (
        "## Checklist\n- Check the api: first test case\n- Verify the config: second file\n"
        "- Measure latency: third endpoint\n\n"
    ),
    3: (
        "## Objetivo\nx\n\n## Pasos\n1. Create and validate the input file before running\n2. TBD\n\n"
        "## Criterios\n"
    ),
    4: "```python\ndef f(x):\n    return x\nassert f(1) == 1\n```\n\n",
}
TEMPLATE_BY_VARIANT = ["json", "json", "checklist_md", "procedure_md", "example_md", "json"]
PROVIDERS = ["anthropic", "anthropic", "deepseek", "openai", "ollama"]
MODELS = ["claude-haiku-4-5-20251001", "claude-sonnet-4-5-20250929", "deepseek-chat", "gpt-4o-mini", "local-x"]
FRAMEWORKS = ["chain-of-thought", "tree-of-thoughts", "decomposition", "role-playing"]
GUARDRAILS = ["avoid jargon", "ensure that it runs", "do not guess", "keep it short"]


def turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every user turn whose next turn in its conversation is by the assistant."""
    turns = table(spark, folder, "conversations").withColumn("_b", F.floor(F.col("turn") / TURN_BUCKET))
    paired = neighbour(turns, ["conv_id"], ["turn"], ["role", "text"], "_b", "_next", ahead=True)
    return paired.filter((F.col("role") == "user") & (F.col("_next.role") == "assistant")).select(
        "conv_id", "turn", F.col("text").alias("idea"), F.col("_next.text").alias("reply")
    )


def history(spark: SparkSession, folder: str) -> DataFrame:
    """User turns with the reply as improved prompt, decorated and given history columns."""
    system = (
        table(spark, folder, "conversations")
        .filter(F.col("role") == "system")
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("context"))
    )
    conv, turn = F.col("conv_id"), F.col("turn")
    variant = (conv + turn) % 6
    text = F.when(F.col("variant") == 0, F.col("reply"))
    for number, prefix in PREFIXES.items():
        text = text.when(F.col("variant") == number, F.concat(F.lit(prefix), F.col("reply")))
    text = text.otherwise(
        F.to_json(
            F.struct(
                F.concat(F.lit("p"), conv.cast("string")).alias("prompt"),
                F.when(conv % 2 == 0, "writer").otherwise("").alias("role"),
                F.when(conv % 2 == 0, "notes").alias("context"), F.col("reply"),
            ),
            {"ignoreNullFields": "false"},
        )
    )
    return (
        turn_pairs(spark, folder)
        .join(system, "conv_id", "left")
        .withColumn("variant", variant)
        .select(
            "conv_id", "turn",
            (conv * (1 << 20) + turn).alias("id"),
            F.col("idea").alias("original_idea"),
            F.coalesce("context", F.lit("")).alias("context"),
            "variant",
            text.alias("improved_prompt"),
            pick(F.col("variant"), TEMPLATE_BY_VARIANT).alias("template_id"),
            pick(conv % 5, PROVIDERS).alias("provider"),
            pick(conv % 5, MODELS).alias("model"),
            F.when(conv % 2 == 0, "zero-shot").otherwise("few-shot").alias("backend"),
            pick(F.expr("(conv_id div 5) % 4"), FRAMEWORKS).alias("framework"),
            F.slice(F.array(*[F.lit(g) for g in GUARDRAILS]), F.lit(1), (conv % 4).cast("int")).alias("guardrails"),
            (((conv * 37 + turn * 11) % 101) / 100.0).alias("confidence"),
            ((conv * 7919 + turn * 104729) % 40000).cast("int").alias("latency_ms"),
            F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, conv_id, turn, 0)").alias("created_at"),
        )
    )


def impact(spark: SparkSession, folder: str) -> DataFrame:
    """Reactions per user; counted map-side, so a hot user is one row per task before the shuffle."""
    user = F.col("user_id")
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    return (
        table(spark, folder, "events")
        .groupBy("user_id")
        .agg(
            count("click").alias("copy_count"), count("error").alias("regeneration_count"),
            count("view").alias("reuse_count"),
        )
        .withColumn("feedback_score", F.when(user % 7 != 0, (1 + user % 5).cast("int")))
    )


def history_with_impact(spark: SparkSession, folder: str) -> DataFrame:
    """History with the reactions of its user; turns nobody reacted to have zero counts and no feedback."""
    counts = ["copy_count", "regeneration_count", "reuse_count"]
    reactions = impact(spark, folder).withColumnRenamed("user_id", "conv_id")
    return history(spark, folder).join(reactions, "conv_id", "left").fillna(0, counts)


def pool(spark: SparkSession, folder: str, only_even: bool = False) -> DataFrame:
    """Documents as few-shot examples."""
    docs = documents(spark, folder)
    if only_even:
        docs = docs.filter(F.col("doc_id") % 2 == 0)
    return docs.select(
        F.col("doc_id").alias("pos"),
        F.col("text").alias("original_idea"),
        F.lit("").alias("context"),
        F.col("text").alias("improved_prompt"),
        pick(F.col("doc_id") % 4, FRAMEWORKS).alias("framework"),
        F.col("source").alias("source_file"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items as retrieval requests."""
    return table(spark, folder, "benchmark").select(
        "item_id",
        F.col("text").alias("user_input"),
        pick(F.col("item_id") % 4, ["generate", "debug", "refactor", "explain"]).alias("intent"),
        pick(F.col("item_id") % 3, ["simple", "moderate", "complex"]).alias("complexity"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """History rows as repeated runs of cases, one case per conversation."""
    prefix = pick(F.col("conv_id") % 3, ["good-", "bad-", "ambig-"])
    return history(spark, folder).select(
        F.col("conv_id").alias("case_no"),
        F.concat(prefix, F.col("conv_id").cast("string")).alias("case_id"),
        F.col("turn").alias("run"),
        F.col("original_idea").alias("input"),
        F.col("improved_prompt").alias("output"),
        (F.length("improved_prompt") - F.length(F.translate("improved_prompt", "?", ""))).alias("questions"),
        "confidence", "latency_ms", "backend", "framework", "provider",
    )


def cache_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as cache accesses."""
    return table(spark, folder, "events").select(
        F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256).alias("cache_key"),
        F.col("event_id").alias("prompt_id"), "ts", "event_id",
    )
