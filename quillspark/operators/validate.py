"""Row validation: quarantine with reasons, structural checks, batch statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark import fixed
from quillspark.functions import checks as C
from quillspark.functions.text import contains_any, is_blank, lines, present, words


def history_reasons() -> Column:
    """Every invariant of a history row that is broken."""
    c = F.col
    return present(
        [
            (c("framework").isNull() | ~c("framework").isin(fixed.FRAMEWORKS), "invalid framework"),
            ((c("confidence") < 0.0) | (c("confidence") > 1.0), "confidence outside 0..1"),
            (c("latency_ms") < 0, "negative latency"),
            (is_blank(c("original_idea")), "empty original_idea"),
            (is_blank(c("improved_prompt")), "empty improved_prompt"),
            (F.coalesce(F.size("guardrails"), F.lit(0)) <= 0, "empty guardrails"),
        ]
    )


def quarantine(df: DataFrame, reasons: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with the reasons."""
    marked = df.withColumn("reasons", reasons)
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def request_reasons() -> Column:
    c = F.col
    return present(
        [
            (c("idea").isNull() | (F.length("idea") < 5), "idea shorter than 5"),
            (F.length("context") > 5000, "context longer than 5000"),
            (~F.coalesce(c("mode"), F.lit("legacy")).isin("legacy", "nlac"), "unknown mode"),
        ]
    )


def output_reasons() -> Column:
    c = F.col
    return present(
        [
            (is_blank(c("output")), "empty output"),
            (F.length("output") > 100000, "output longer than 100000"),
            (~F.coalesce(c("template_id"), F.lit("json")).isin(list(fixed.TEMPLATES)), "unknown template"),
        ]
    )


def usable_context_files(files: Column) -> Column:
    return F.filter(files, lambda f: ~is_blank(f))


def structure_violation() -> Column:
    """First missing part of a nested example, null where it is complete."""
    c = F.col
    return (
        F.when(c("inputs").isNull(), "missing inputs")
        .when(c("outputs").isNull(), "missing outputs")
        .when(c("inputs.original_idea").isNull(), "missing original_idea")
        .when(c("outputs.improved_prompt").isNull(), "missing improved_prompt")
    )


def structure_report(examples: DataFrame, index: str = "pos") -> DataFrame:
    """How many examples are incomplete, and the first of them."""
    marked = examples.select(index, structure_violation().alias("v"))
    bad = F.col("v").isNotNull()
    return marked.agg(
        F.count("*").alias("examples"), F.count_if(bad).alias("invalid"),
        F.min(F.when(bad, F.col(index))).alias("first_invalid"),
        F.min_by("v", F.when(bad, F.col(index))).alias("first_violation"),
    )


def invalid_frameworks(history: DataFrame) -> DataFrame:
    idea = F.col("original_idea")
    return history.filter(~F.col("framework").isin(fixed.FRAMEWORKS)).select(
        "id", "created_at", F.col("framework").alias("invalid_value"),
        F.when(F.length(idea) > 50, F.concat(F.substring(idea, 1, 50), F.lit("..."))).otherwise(idea).alias("idea"),
        F.lit("chain-of-thought").alias("suggested_fix"),
    )


def fix_frameworks(history: DataFrame) -> DataFrame:
    """Unknown frameworks replaced; ``changed`` marks the rows touched."""
    bad = ~F.coalesce(F.col("framework").isin(fixed.FRAMEWORKS), F.lit(False))
    return history.withColumn("changed", bad).withColumn(
        "framework", F.when(bad, "chain-of-thought").otherwise(F.col("framework"))
    )


def ifeval(df: DataFrame, text: str, threshold: float = 0.7, constraints: dict | None = None) -> DataFrame:
    """A flag per constraint, the share that hold, and whether that is enough."""
    constraints = constraints or C.DEFAULT_CONSTRAINTS
    flagged = df.withColumns({f"ok_{n}": make(F.col(text)) for n, make in constraints.items()})
    score = C.constraint_score([F.col(f"ok_{n}") for n in constraints])
    return flagged.withColumn("score", score).withColumn("passed", F.col("score") >= threshold)


def validate_synthetic(df: DataFrame) -> DataFrame:
    """Needs ``question`` and the struct ``metadata``."""
    question, metadata = F.col("question"), F.col("metadata")
    tokens = F.col("_tokens")
    checked = df.withColumn("_tokens", words(question)).withColumn("errors", C.synthetic_errors(question, metadata, tokens))
    scored = checked.withColumn("score", C.synthetic_score(question, metadata, F.col("errors"), tokens))
    return scored.withColumn("is_valid", (F.size("errors") == 0) & (F.col("score") > 0.5)).drop("_tokens")


def validate_import(df: DataFrame) -> DataFrame:
    """Needs the structs ``inputs``, ``outputs`` and ``metadata``; kept rows only need the score."""
    c = F.col
    checked = df.withColumn("errors", C.import_errors(c("inputs"), c("outputs"), c("metadata"))).withColumn(
        "_tokens", words(c("outputs.improved_prompt"))
    )
    return (
        checked.withColumn("score", C.import_score(c("outputs.improved_prompt"), c("metadata.source"), c("errors"), c("_tokens")))
        .drop("_tokens")
        .withColumn("is_valid", (F.size("errors") == 0) & (c("score") > 0.5))
        .withColumn("kept", c("score") >= 0.5)
    )


def batch_statistics(validated: DataFrame, accepted: Column) -> DataFrame:
    zero = F.lit(0.0)
    return validated.agg(
        F.count("*").alias("total"), F.count_if(accepted).alias("valid"), F.count_if(~accepted).alias("invalid"),
        F.coalesce(F.avg("score"), zero).alias("avg_score"), F.coalesce(F.min("score"), zero).alias("min_score"),
        F.coalesce(F.max("score"), zero).alias("max_score"),
    )


def check_prompts(df: DataFrame) -> DataFrame:
    """Warnings of prompt objects with a ``constraints`` struct."""
    k = F.col("constraints")
    return df.withColumn(
        "warnings",
        C.prompt_warnings(F.col("template"), k["max_tokens"], k["format"], k["include_examples"], k["include_explanation"]),
    )


def autocorrect(df: DataFrame) -> DataFrame:
    """Repair what can be repaired, then check again: role header, code fence added or taken out.

    The repairs neither undo nor enable one another, so one round reaches the fixed point.
    """
    t = F.col("template")
    wanted = F.lower(F.coalesce(F.col("constraints")["format"], F.lit("")))
    plain, fenced = F.contains(wanted, F.lit("no_markdown")), F.contains(t, F.lit("```"))
    no_role = ~contains_any(F.lower(t), ["role", "task", "you are"])
    unfenced = F.contains(wanted, F.lit("markdown")) & ~plain & ~fenced & contains_any(t, ["def ", "function "])
    staged = (
        df.withColumns({"_drop": plain & fenced, "_fence": unfenced})
        .withColumn("template", F.when(no_role, F.concat(F.lit(fixed.ANSWER_ROLE_HEADER), t)).otherwise(t))
        .withColumn("_rows", F.when(F.col("_fence"), lines(t)))
        .withColumn("_at", C.first_definition(F.col("_rows")))
    )
    repaired = (
        F.when(F.col("_drop"), F.translate(F.replace(t, F.lit("```"), F.lit("")), "`", '"'))
        .when(F.col("_at") > 0, C.fence_code(F.col("_rows"), F.col("_at")))
        .otherwise(t)
    )
    done = staged.withColumn("template", repaired).drop("_drop", "_fence", "_rows", "_at")
    return check_prompts(done).withColumn("passed", F.size("warnings") == 0)


def dataset_statistics(examples: DataFrame) -> DataFrame:
    """Counts by task type and domain plus a total row with the mean confidence."""
    m = F.col("metadata")
    items = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
        F.struct(F.lit("task_type").alias("dimension"), m["task_type"].alias("value")),
        F.struct(F.lit("domain").alias("dimension"), m["domain"].alias("value")),
    )
    return examples.select(m["confidence"].alias("confidence"), F.inline(items)).groupBy("dimension", "value").agg(
        F.count("*").alias("n"), F.bround(F.avg("confidence"), 4).alias("avg_confidence")
    )
