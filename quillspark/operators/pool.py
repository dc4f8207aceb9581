"""Few-shot pools: union in source order, first-wins deduplication, audits and checks.

"First wins" is an aggregate (the least position per key), not a window: duplicates collapse before
the shuffle, so a text copied into a third of all rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quillspark import fixed
from quillspark.functions.classify import coarse_intent
from quillspark.functions.text import is_blank
from quillspark.operators.ordered import with_position
from quillspark.session import materialise


def io_hash(idea: Column, prompt: Column) -> Column:
    blank = F.lit("")
    return F.sha2(F.concat(F.coalesce(idea, blank), F.lit("|||"), F.coalesce(prompt, blank)), 256)


def union_sources(sources: dict[str, DataFrame], position: str = "pos") -> DataFrame:
    """Sources in the order given, each row tagged with its source and the source's rank."""
    parts = [
        df.withColumn("source_rank", F.lit(rank)).withColumn("source_file", F.lit(name))
        for rank, (name, df) in enumerate(sources.items())
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.withColumn(position, F.col(position).cast("long"))


BROADCAST_BYTES = 32 << 20


def keep_first(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """First row per key in the given total order, whose columns are not null.

    Key digests and order columns are written once; rows that come later than the first of their key are
    found among them. Rows are then left out by their order columns, which are unique. Those of the
    later rows go to the tasks that read the rows, so that no row is shuffled; only if they are more than
    BROADCAST_BYTES are both sides shuffled by the order columns. Rows read from several documents are
    ordered by document first.
    """
    if "source_path" in df.columns and "source_path" not in order:
        order = [*order[:-1], "source_path", order[-1]]
    order = list(order)
    # two independent digests, so that distinct keys do not merge
    slim = materialise(df.select(F.xxhash64(key).alias("_h"), F.md5(key.cast("binary")).alias("_m"), *order))
    # a plain number keeps the aggregate hash-based
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])
    repeated = slim.groupBy("_h", "_m").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    later = materialise(slim.join(repeated, ["_h", "_m"]).filter(place != F.col("_first")).select(*order))
    size = later.agg(F.sum(reduce(lambda a, b: a + b, [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 16 for c in order]))).first()[0]
    return df.join(F.broadcast(later) if (size or 0) <= BROADCAST_BYTES else later, order, "left_anti")


def dedup_by_io(pool: DataFrame, order: Sequence[str] = ("source_rank", "pos")) -> DataFrame:
    """First row per idea and prompt, stamped with its hash."""
    hashed = pool.withColumn("io_hash", io_hash(F.col("original_idea"), F.col("improved_prompt")))
    return keep_first(hashed, F.col("io_hash"), order).withColumn("duplication_status", F.lit("unique"))


def input_key(names: Sequence[str] = ("context", "original_idea")) -> Column:
    """Canonical JSON of the input fields, keys sorted."""
    fields = [F.col(n).alias(n) for n in sorted(names)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def dedup_by_input(pool: DataFrame, order: Sequence[str] = ("pos",), names: Sequence[str] = ("context", "original_idea")) -> DataFrame:
    return keep_first(pool, input_key(names), order)


def stamp_dedup(pool: DataFrame, at: Column) -> DataFrame:
    return pool.withColumn("deduplicated", F.lit(True)).withColumn("deduplication_date", at)


def merge_into(pool: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pool with the batch's new rows appended and deduplicated, and those new rows alone.

    The pool comes first, so a batch's row that is left is one the pool does not have.
    """
    merged = dedup_by_io(union_sources({"pool": pool, "batch": batch}))
    return merged, merged.filter(F.col("source_rank") == 1)


def duplicate_groups(pool: DataFrame, key: Column) -> DataFrame:
    """Size and first position of every key that occurs more than once."""
    return (
        pool.groupBy(F.sha2(key, 256).alias("key"))
        .agg(F.count("*").alias("occurrences"), F.min("pos").alias("first_pos"))
        .filter("occurrences > 1")
    )


def duplicate_members(pool: DataFrame, key: Column) -> DataFrame:
    """One row per member of a duplicate group, with the group's size and first position.

    An index list of unbounded length stays rows.
    """
    return pool.withColumn("key", F.sha2(key, 256)).join(duplicate_groups(pool, key), "key")


def duplicate_audit(pool: DataFrame, key: Column) -> DataFrame:
    sizes = pool.groupBy(F.sha2(key, 256).alias("key")).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_examples"),
        F.count("*").alias("unique_inputs"),
        F.count_if(F.col("n") > 1).alias("duplicate_inputs"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_occurrences"),
    ).withColumn("duplication_rate", F.coalesce(F.try_divide("duplicate_occurrences", "total_examples") * 100, F.lit(0.0)))


def output_consistency(pool: DataFrame, key: Column, output: Column) -> DataFrame:
    """Of the duplicated inputs, how many always have the same output."""
    groups = (
        pool.groupBy(F.sha2(key, 256).alias("key"))
        .agg(F.count("*").alias("n"), F.min(F.sha2(output, 256)).alias("lo"), F.max(F.sha2(output, 256)).alias("hi"))
        .filter("n > 1")
    )
    return groups.agg(
        F.count_if(F.col("lo") == F.col("hi")).alias("consistent"),
        F.count_if(F.col("lo") != F.col("hi")).alias("inconsistent"),
    )


def dedup_report(pool: DataFrame, key: Column) -> DataFrame:
    sizes = pool.groupBy(F.sha2(key, 256).alias("key")).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("original"), F.count("*").alias("unique")).select(
        "original", "unique", (F.col("original") - F.col("unique")).alias("removed"),
        F.coalesce(F.try_divide(F.col("original") - F.col("unique"), F.col("original")) * 100, F.lit(0.0)).alias("removal_rate"),
    )


def statistics(pool: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts for every value of every dimension; missing values are ``unknown``."""
    items = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value"))
            for d in dimensions
        ]
    )
    return pool.select(F.inline(items)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def top_values(counts: DataFrame, size: int, value: str = "value", count: str = "n") -> DataFrame:
    return counts.orderBy(F.desc(count), F.asc(value)).limit(size)


def with_share(counts: DataFrame, count: str = "n") -> DataFrame:
    total = counts.agg(F.sum(count).alias("t")).scalar()
    return counts.withColumn("share", F.try_divide(F.col(count) * 100.0, total))


def catalog_profile(catalog: DataFrame) -> DataFrame:
    """Size of a catalog and its counts by coarse intent and by complexity (``unknown`` where none is given)."""
    rows = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
        F.struct(F.lit("intent").alias("dimension"), coarse_intent(F.col("original_idea")).alias("value")),
        F.struct(F.lit("complexity").alias("dimension"), F.coalesce("complexity", F.lit("unknown")).alias("value")),
    )
    return catalog.select(F.inline(rows)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def skip_rate_guard(df: DataFrame, good: Column, stop: bool = False) -> DataFrame:
    """Share of bad records and what it means: 5 % raises a flag, 20 % or no good record fails."""
    total = df.agg(
        F.count("*").alias("total"), F.count_if(F.coalesce(good, F.lit(False))).alias("valid")
    ).withColumn("skipped", F.col("total") - F.col("valid")).withColumn(
        "skip_rate", F.coalesce(F.try_divide("skipped", "total"), F.lit(0.0))
    )
    failed = (F.col("valid") == 0) | (F.col("skip_rate") >= 0.20)
    verdict = (
        F.when(failed, "fail").when(F.col("skip_rate") >= 0.05, "degraded").when(F.col("skipped") > 0, "warn").otherwise("ok")
    )
    if stop:
        message = F.concat(F.lit("too many bad records: "), F.col("skipped").cast("string"))
        verdict = F.when(failed, F.raise_error(message).cast("string")).otherwise(verdict)
    return total.withColumn("status", verdict)


def post_merge_checks(pool: DataFrame, framework: str = "rag", least: int = 108, declared_total: Column | None = None) -> DataFrame:
    """Named checks over a merged pool as rows, from one pass plus one count per hash and framework."""
    c = F.col
    prompt = F.coalesce(c("improved_prompt"), F.lit(""))
    source = F.lower(F.coalesce(c("source_file"), F.lit("")))
    complete = [~is_blank(c(n)) for n in ("role", "directive", "guardrails", "improved_prompt")]
    # three aggregates follow; they read flags and digests, not texts
    slim = materialise(
        pool.select(
            "pos", "framework", (F.lower(c("framework")) == framework).alias("wanted"),
            (is_blank(c("source_file")) | is_blank(c("io_hash"))).alias("incomplete"),
            (complete[0] & complete[1] & complete[2] & complete[3]).alias("structure"),
            (F.contains(source, F.lit("langchain")) | F.contains(source, F.lit("validated"))).alias("tracked"),
            (F.contains(prompt, F.lit("{context}")) & F.contains(prompt, F.lit("{question}"))).alias("variables"),
            io_hash(c("original_idea"), c("improved_prompt")).alias("digest"),
        )
    )
    facts = slim.agg(
        F.count("*").alias("size"), F.count_if("wanted").alias("hits"), F.count_if("incomplete").alias("incomplete"),
        F.min_by(F.struct("structure", "tracked", "variables"), F.when(c("wanted"), c("pos"))).alias("one"),
    )
    hashes = slim.groupBy("digest").agg(F.count("*").alias("n"))
    repeats = hashes.agg(F.coalesce(F.sum(c("n") - 1), F.lit(0)).alias("repeats")).scalar()
    most = slim.groupBy("framework").agg(F.count("*").alias("n")).agg(F.max("n").alias("most")).scalar()
    facts = facts.withColumn("repeats", repeats).withColumn("most", most)
    declared = declared_total.isNotNull() if declared_total is not None else F.lit(True)
    checks = [
        ("pool_size", c("size") >= least, c("size")),
        ("framework_present", c("hits") > 0, c("hits")),
        ("prompt_structure", c("one.structure"), c("hits")),
        ("no_duplicates", c("repeats") == 0, c("repeats")),
        ("metadata_complete", c("incomplete") == 0, c("incomplete")),
        ("source_tracking", c("one.tracked"), c("hits")),
        ("variables_present", c("one.variables"), c("hits")),
        (
            "framework_distribution",
            (c("hits") > 0) & (F.coalesce(F.try_divide(c("most"), c("size")), F.lit(0.0)) < 0.8), c("most"),
        ),
        ("wrapper_keys", declared, c("size")),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("check"), F.coalesce(p, F.lit(False)).alias("passed"), d.cast("long").alias("detail"))
            for n, p, d in checks
        ]
    )
    return facts.select(F.inline(rows))


def sequential_split(df: DataFrame, order: Sequence[Column], train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """First part for training, next for validation, rest for test, in the given total order."""
    total = df.agg(F.count("*").alias("n")).scalar()
    placed = with_position(df, order, "index")
    # plain floating-point products cut to integers, as the split sizes are defined
    first = F.floor(total * F.lit(train))
    second = F.floor(total * F.lit(validation))
    return placed.withColumn(
        "split",
        F.when(F.col("index") < first, "train").when(F.col("index") < first + second, "validation").otherwise("test"),
    )


def split_sizes(split: DataFrame, text: str) -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("n"), F.avg(F.length(text)).alias("mean_length"))


def score_lookup(prompts: DataFrame, scores: DataFrame, default: float = 0.960) -> DataFrame:
    """Validation score per prompt; the first part of a score's id is not in the prompt's id."""
    keyed = scores.select(
        F.when(F.contains("id", F.lit("_")), F.regexp_replace("id", "^[^_]*_", "")).otherwise("").alias("id"),
        F.col("score").alias("validator_score"),
        *([F.col("pos").alias("_pos")] if "pos" in scores.columns else []),
    )
    if "_pos" in keyed.columns:
        keyed = keyed.groupBy("id").agg(F.max_by("validator_score", "_pos").alias("validator_score"))
    return prompts.join(keyed, "id", "left").withColumn(
        "validator_score", F.coalesce("validator_score", F.lit(default))
    )


def merge_versions(existing: DataFrame, new: DataFrame, deduplicate: bool = False) -> DataFrame:
    """New rows after the existing ones; the earlier format keeps repeats unless told otherwise."""
    whole = union_sources({"existing": existing, "new": new})
    return dedup_by_io(whole) if deduplicate else whole


def coverage(categories: DataFrame) -> DataFrame:
    """Wanted categories with their count, share of real tasks and level; empty ones stay.

    ``categories`` has one row per example with the struct ``c`` from ``classify.category``.
    """
    spark = categories.sparkSession
    counts = categories.filter(~F.col("c.is_meta_prompt")).groupBy(F.col("c.category").alias("category")).agg(F.count("*").alias("n"))
    real = categories.agg(F.count_if(~F.col("c.is_meta_prompt")).alias("r")).scalar()
    wanted = spark.range(1).select(
        F.posexplode(F.array(*[F.lit(w) for w in fixed.WANTED_CATEGORIES])).alias("rank", "category")
    )
    n = F.coalesce("n", F.lit(0))
    return wanted.join(counts, "category", "left").select(
        "category", n.alias("n"), F.coalesce(F.try_divide(n * 100.0, real), F.lit(0.0)).alias("percent"),
        F.when(n == 0, "missing").when(n < 3, "low").when(n < 5, "medium").otherwise("good").alias("level"),
    )


def coverage_gaps(cover: DataFrame) -> DataFrame:
    """Critical categories with fewer than three examples, fewest first, with suggestions."""
    spark = cover.sparkSession
    items = F.array(
        *[
            F.struct(F.lit(k).alias("category"), F.array(*[F.lit(s) for s in v]).alias("suggestions"))
            for k, v in fixed.GAP_SUGGESTIONS.items()
        ]
    )
    critical = spark.range(1).select(F.inline(items))
    return critical.join(cover.select("category", "n"), "category").filter("n < 3").orderBy("n", "category")
