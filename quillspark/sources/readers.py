"""Readers of example pools, components, cases, logs and stored rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quillspark import fixed, schemas
from quillspark.functions.classify import file_priority
from quillspark.functions.text import is_blank
from quillspark.operators.metrics import rederive
from quillspark.operators.ordered import literal_rows
from quillspark.sources import jsondocs


def read_wrapped(spark: SparkSession, path: str | list[str], item: T.StructType, key: str, required: bool = True) -> DataFrame:
    """Records of JSON documents that are an array or an object holding one under ``key``.

    Documents are cut by byte range, so one file of any size is many tasks. A document of another shape and an
    element that cannot be parsed stop the job. ``pos`` counts within a document; ``source_path`` and
    ``pos`` together are a place in all of them.
    """
    found = jsondocs.elements(spark, path, key, required)
    return found.select("source_path", "pos", F.from_json("value", item, {"mode": "FAILFAST"}).alias("_r")).select("source_path", "pos", "_r.*")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return read_wrapped(spark, path, schemas.EXAMPLE, "examples")


def text_list(raw: Column) -> Column:
    """A list given as JSON array, or as text with one item per line or comma."""
    parsed = F.from_json(raw, schemas.STRINGS)
    pieces = F.filter(F.transform(F.split(raw, r"[\n,]"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(raw.startswith("["), parsed).otherwise(pieces)


def read_components(spark: SparkSession, path: str, min_confidence: float = 0.2) -> DataFrame:
    """Components sure enough to use; unknown domains become ``other``."""
    raw = read_wrapped(spark, path, schemas.COMPONENT, "components")
    known = F.col("domain").isin(fixed.DOMAINS)
    return (
        raw.withColumn("domain", F.when(known, F.col("domain")).otherwise("other"))
        .withColumn("guardrails", text_list(F.col("guardrails")))
        .filter(F.col("confidence") >= min_confidence)
    )


def _demand(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows without a required field stop the job."""
    for name in required:
        missing = F.col(name).isNull()
        dtype = df.schema[name].dataType
        df = df.withColumn(
            name, F.when(missing, F.raise_error(F.lit(f"missing required field {name}")).cast(dtype)).otherwise(F.col(name))
        )
    return df


def read_strict_lines(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str]) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line or missing field stops the job."""
    lines = spark.read.text(path).filter(~is_blank(F.col("value")))
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")
    return _demand(parsed, required)


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    return with_case_defaults(read_strict_lines(spark, path, schemas.EVAL_CASE, ["id", "input", "asserts"]))


def with_case_defaults(cases: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    defaults = {
        "minFinalPromptLength": F.lit(50), "maxQuestions": F.lit(5), "minConfidence": F.lit(0.5), "mustNotContain": none,
        "mustNotHavePlaceholders": F.lit(True), "mustNotBeChatty": F.lit(True), "shouldContain": none,
    }
    filled = F.struct(*[F.coalesce(F.col(f"asserts.{n}"), d).alias(n) for n, d in defaults.items()])
    return cases.withColumns(
        {"tags": F.coalesce("tags", none), "ambiguityHints": F.coalesce("ambiguityHints", none), "asserts": filled}
    )


def read_integration_cases(spark: SparkSession, path: str) -> DataFrame:
    none = F.array().cast("array<string>")
    cases = read_strict_lines(spark, path, schemas.INTEGRATION_CASE, ["test_id", "intent", "complexity", "idea"])
    return cases.withColumn("context", F.coalesce("context", F.lit(""))).withColumn(
        "assertions",
        F.struct(
            F.coalesce("assertions.min_length", F.lit(0)).alias("min_length"),
            F.coalesce("assertions.contains_keywords", none).alias("contains_keywords"),
            F.coalesce("assertions.not_contains_keywords", none).alias("not_contains_keywords"),
        ),
    )


def read_lenient_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and the text of those that do not."""
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.text(path).filter(~is_blank(F.col("value"))).select(
        "value", F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("_r")
    )
    return rows.filter("_r._bad is null").select("_r.*").drop("_bad"), rows.filter("_r._bad is not null").select("value")


def read_history_log(spark: SparkSession, path: str) -> DataFrame:
    """Local prompt log, newest first; malformed lines are left out."""
    return read_lenient_lines(spark, path, schemas.LOCAL_HISTORY)[0].orderBy(F.desc("timestamp"), F.desc("id"))


def read_validated_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Hub candidates that passed validation, as pool examples."""
    rows = read_wrapped(spark, path, schemas.HUB_CANDIDATE, "candidates").filter(F.coalesce("validation_passed", F.lit(False)))
    extra = F.create_map(
        F.lit("source_file"), F.lit("langchain-validated.json"),
        F.lit("validation_score"), F.col("validation_score").cast("string"),
        F.lit("framework"), F.col("converted.outputs.framework"),
    )
    base = F.map_filter(
        F.coalesce("converted.metadata", F.create_map().cast("map<string,string>")),
        lambda k, v: ~k.isin("source_file", "validation_score", "framework"),
    )
    return rows.select("pos", "converted.inputs", "converted.outputs", F.map_concat(base, extra).alias("metadata"))


def decode_history(rows: DataFrame) -> DataFrame:
    """Stored rows with guardrails parsed; unreadable ones are replaced by a marker."""
    parsed = F.from_json("guardrails", schemas.STRINGS)
    corrupt = parsed.isNull() & F.col("guardrails").isNotNull()
    marker = F.array(F.lit(fixed.CORRUPT_GUARDRAILS))
    none = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "guardrails": F.when(corrupt, marker).otherwise(F.coalesce(parsed, none)),
            "context": F.coalesce("context", F.lit("")),
        }
    )


def decode_metrics(rows: DataFrame, document: str = "metrics_json") -> tuple[DataFrame, DataFrame]:
    """Stored metric documents as flat rows with scores recomputed, and rows that lack a needed part."""
    parsed = rows.withColumn("_d", F.from_json(document, schemas.METRICS_DOCUMENT))
    good = (
        F.col("_d.metadata.measured_at").isNotNull() & F.col("_d.metadata.framework").isin(fixed.FRAMEWORKS)
        & F.col("_d.quality").isNotNull() & F.col("_d.performance").isNotNull() & F.col("_d.impact").isNotNull()
    )
    ok = F.coalesce(good, F.lit(False))
    keep = [c for c in rows.columns if c not in (document, "provider", "model", "backend", "framework", "measured_at")]
    flat = parsed.filter(ok).select(
        *keep, "_d.quality.*", "_d.performance.latency_ms", "_d.performance.total_tokens", "_d.performance.cost_usd",
        "_d.impact.*", "_d.metadata.*",
    )
    return rederive(flat), parsed.filter(~ok).drop("_d")


def read_context_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per requested file in input order; a file that cannot be read becomes an error row.

    Only the requested files are opened, by tasks; the file system says beforehand which of them are there and
    may be read, and one that goes before it is read counts as not found. No paths give no rows.
    """
    placed = [(i, p, *_state(spark, p)) for i, p in enumerate(paths)]
    asked = literal_rows(spark, placed, ["pos", "source", "path", "trouble", "blank"]) if placed else spark.createDataFrame([], "pos int, source string, path string, trouble string, blank boolean")
    readable = sorted({path for _, _, path, trouble, blank in placed if not trouble and not blank})
    found = (
        spark.read.option("ignoreMissingFiles", "true").format("binaryFile").load([_literal_path(p) for p in readable]).select("path", "content")
        if readable else spark.createDataFrame([], "path string, content binary")
    )
    text = F.when(F.col("blank"), "").otherwise(F.col("content").cast("string"))  # a scan gives no row for a file of no bytes
    trouble = (
        F.when(F.col("trouble") != "", F.col("trouble"))
        .when(text.isNull(), fixed.FILE_TROUBLE["missing"])
        .when(~F.is_valid_utf8(text), fixed.FILE_TROUBLE["encoding"])
    )
    name = file_priority(F.substring_index("source", "/", -1))
    return asked.join(found, "path", "left").withColumn("trouble", trouble).select(
        "pos", "source",
        F.when(F.col("trouble").isNull(), text)
        .otherwise(F.concat(F.lit("ERROR: "), "trouble", F.lit(" - "), "source")).alias("content"),
        F.when(F.col("trouble").isNull(), name["priority"]).otherwise(1).alias("priority"),
        F.when(F.col("trouble").isNull(), name["category"]).otherwise("error").alias("category"),
    )


def _state(spark: SparkSession, path: str) -> tuple[str, str, bool]:
    """A file's qualified path, why it cannot be read ("" if it can), and whether it has no bytes."""
    jvm = spark._jvm.org.apache.hadoop.fs
    try:
        place = jvm.Path(path)
        files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        status = files.getFileStatus(place)
        if status.isDirectory():
            return path, fixed.FILE_TROUBLE["directory"], False
        files.access(place, jvm.permission.FsAction.READ)
        return status.getPath().toString(), "", status.getLen() == 0
    except Py4JJavaError as e:
        kind = e.java_exception.getClass().getSimpleName()
        return path, fixed.FILE_TROUBLE["denied" if kind == "AccessControlException" else "missing"], False


def _literal_path(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def migrate_cases(old: DataFrame) -> DataFrame:
    """Cases with hard expectations as cases with soft assertions; rules depend on the id."""
    none = F.array().cast("array<string>")
    case, e = F.col("id"), "expected."
    must = F.coalesce(F.col(e + "mustContain"), none)
    banned = F.coalesce(F.col(e + "mustNotContain"), none)
    bad, good, unclear = (case.startswith(p) for p in ("bad-", "good-", "ambig-"))
    given = F.col(e + "mustContain").isNotNull()
    ai = ["as an ai", "as a language model", "hard rules", "output rules"]  # fixed values
    listed = lambda items: F.array(*[F.lit(i) for i in items])
    bad_base = F.when(case == "bad-006", listed(["as an ai language model"])).otherwise(banned)
    strict = bad & (F.contains(case, F.lit("004")) | F.contains(case, F.lit("010")))
    asserts = F.struct(
        F.lit(50).alias("minFinalPromptLength"),
        F.when(strict, 2).otherwise(F.col(e + "maxQuestions")).alias("maxQuestions"),
        F.col(e + "minConfidence").alias("minConfidence"),
        F.when(bad, F.concat(bad_base, must)).when(good & given, listed(ai)).when(unclear, listed(ai[:2])).otherwise(banned).alias("mustNotContain"),
        F.lit(True).alias("mustNotHavePlaceholders"), F.lit(True).alias("mustNotBeChatty"),
        F.when(bad | unclear, none).otherwise(must).alias("shouldContain"),
    )
    return old.select("id", "input", asserts.alias("asserts"))


def build_hybrid_cases(components: DataFrame, cases: DataFrame, max_components: int = 50, max_cases: int = 20) -> DataFrame:
    """Fixed ambiguous cases, then cases from the first components, then the first base cases."""
    spark = cases.sparkSession
    none = F.array().cast("array<string>")
    asserts = F.struct(
        F.lit(50).alias("minFinalPromptLength"), F.lit(3).alias("maxQuestions"), F.lit(0.6).alias("minConfidence"),
        none.alias("mustNotContain"), F.lit(True).alias("mustNotHavePlaceholders"), F.lit(True).alias("mustNotBeChatty"),
        none.alias("shouldContain"),
    )
    numbered = lambda prefix, n: F.concat(F.lit(prefix), F.lpad(n.cast("string"), 3, "0"))
    terms = literal_rows(spark, [(i + 1, t, h) for i, (t, h) in enumerate(fixed.AMBIGUOUS_TERMS)], ["n", "term", "hints"])
    unclear = terms.select(
        F.lit(0).alias("part"), F.col("n").cast("long").alias("rank"), numbered("amb-", F.col("n")).alias("id"),
        F.concat(F.lit("Design "), "term", F.lit(" process")).alias("input"), F.array(F.lit("ambiguity")).alias("tags"),
        F.col("hints").alias("ambiguityHints"), asserts.alias("asserts"),
    )
    from pyspark.sql import Window

    # a handful of rows by the limit just before
    first = components.orderBy("pos").limit(max_components).withColumn("n", F.row_number().over(Window.orderBy("pos")))
    directive = F.when(
        F.coalesce("directive", F.lit("")) == "", F.concat(F.lit("Design component "), F.col("n").cast("string"), F.lit(" behavior"))
    ).otherwise(F.col("directive"))
    made = first.select(
        F.lit(1).alias("part"), F.col("n").cast("long").alias("rank"), numbered("comp-", F.col("n")).alias("id"),
        directive.alias("input"), none.alias("tags"), none.alias("ambiguityHints"), asserts.alias("asserts"),
    )
    base = cases.orderBy("pos").limit(max_cases).select(
        F.lit(2).alias("part"), F.col("pos").cast("long").alias("rank"), "id", "input", "tags", "ambiguityHints", "asserts"
    )
    return unclear.unionByName(made).unionByName(base)


def read_ab_results(spark: SparkSession, path: str, arms: Sequence[str]) -> DataFrame:
    """Result records of every arm in one table; an arm that a document lacks has none."""
    found = [read_wrapped(spark, path, schemas.ARM_RESULT, arm, required=False).select(F.lit(arm).alias("arm"), "*") for arm in arms]
    return reduce(DataFrame.unionByName, found).drop("source_path", "pos")
