"""Evaluation reports: buckets, failures, percentiles, ambiguity, variability, modes and arms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark import fixed
from quillspark.functions import checks as C
from quillspark.functions.text import count_present, jaccard, rx, words
from quillspark.operators.ordered import exact_quantiles
from quillspark.session import materialise

BLOCK_RUNS = 256


def bucket(case_id: Column) -> Column:
    return F.when(case_id.startswith("good-"), "good").when(case_id.startswith("bad-"), "bad").otherwise("ambiguous")


def judge_runs(runs: DataFrame) -> DataFrame:
    """Soft-assert category, copyable and reviewable flag per run.

    Limits come from the columns min_chars, max_questions, min_confidence and banned if present.
    """
    have = lambda name, default: F.coalesce(F.col(name), default) if name in runs.columns else default
    assumptions = have("assumptions", F.lit(0))
    category = C.soft_category(
        F.col("output"), F.col("questions"), F.col("confidence"),
        have("banned", F.array().cast("array<string>")), have("min_chars", F.lit(50)),
        have("max_questions", F.lit(5)), have("min_confidence", F.lit(0.5)),
    )
    ok = F.col("category") == "success"
    return (
        runs.withColumn("bucket", bucket(F.col("case_id")))
        .withColumn("category", category)
        .withColumns(
            {
                "copyable": ok & C.is_copyable(F.col("output"), F.col("questions")),
                "reviewable": ok & ((F.col("questions") > 0) | (assumptions > 0)),
                "patterns": C.debt_patterns(F.col("input")),
            }
        )
    )


def join_cases(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Runs with the limits and terms of their case.

    ``cases`` has one row per case_id with min_chars, max_questions, min_confidence, banned and wanted,
    each null where the default holds. A run whose case is unknown is kept, with defaults.
    """
    limits = cases.select(
        "case_id", "min_chars", "max_questions", "min_confidence", "banned", "wanted", F.lit(True).alias("known_case")
    )
    none = F.array().cast("array<string>")
    return runs.join(limits, "case_id", "left").withColumns(
        {
            "banned": F.coalesce("banned", none), "wanted": F.coalesce("wanted", none),
            "known_case": F.coalesce("known_case", F.lit(False)),
        }
    )


def case_results(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Judged runs with their own case's limits, and whether every wanted term and no banned one is there."""
    judged = judge_runs(join_cases(runs, cases))
    held = C.case_assertions(F.col("output"), F.coalesce("min_chars", F.lit(50)), F.col("wanted"), F.col("banned"))
    return judged.withColumn("asserted", held)


def bucket_report(judged: DataFrame) -> DataFrame:
    """Totals and rates per bucket and over all, in one pass over the runs."""
    both = judged.withColumn("bucket", F.explode(F.array("bucket", F.lit("all"))))
    share = lambda flag: F.avg(flag.cast("double"))
    return both.groupBy("bucket").agg(
        F.count("*").alias("total"),
        share(F.col("category") == "success").alias("valid_rate"),
        share(F.col("copyable")).alias("copyable_rate"),
        share(F.col("reviewable")).alias("review_rate"),
    )


def failure_reasons(judged: DataFrame) -> DataFrame:
    return judged.filter("category <> 'success'").groupBy("category").agg(F.count("*").alias("n"))


def failures(judged: DataFrame) -> DataFrame:
    return judged.filter("category <> 'success'").select("case_id", "run", "category")


def wrapper_rates(runs: DataFrame) -> DataFrame:
    """Extraction and repair rates; needs used_extraction, extraction_method, used_repair, attempt,
    parse_ok and schema_ok. Rates over nothing are 0."""
    triggered = F.col("used_repair") & (F.col("attempt") == 2)
    counts = runs.agg(
        F.count("*").alias("n"), F.count_if("used_extraction").alias("extracted"),
        *[
            F.count_if(F.col("used_extraction") & (F.coalesce("extraction_method", F.lit("scan")) == m)).alias(m)
            for m in ("fence", "tag", "scan")
        ],
        F.count_if(triggered).alias("repairs"), F.count_if(triggered & F.col("parse_ok")).alias("parsed"),
        F.count_if(triggered & F.col("schema_ok")).alias("schema"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.select(
        rate("extracted", "n").alias("extraction_used_rate"), "fence", "tag", "scan",
        rate("repairs", "n").alias("repair_trigger_rate"), rate("parsed", "repairs").alias("repair_parse_rate"),
        rate("schema", "repairs").alias("repair_schema_rate"), rate("repairs", "n").alias("attempt2_rate"),
    )


def latency_percentiles(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Nearest-rank p50 and p95."""
    return exact_quantiles(runs, keys or [], "latency_ms", {"p50": ("nearest", 0.50), "p95": ("nearest", 0.95)})


def floor_percentiles(runs: DataFrame, keys: list[str] | None = None, value: str = "latency_ms") -> DataFrame:
    """Median, p95 and p99 by floor index, mean and range."""
    keys = keys or []
    ranks = exact_quantiles(
        runs, keys, value, {"median": ("median", 0.5), "p95": ("floor", 0.95), "p99": ("floor", 0.99)}
    )
    basics = runs.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    if keys:
        return basics.join(ranks, keys)
    return basics.select("*", *[ranks.select(c).scalar().alias(c) for c in ("median", "p95", "p99")])


def release_gates(buckets: DataFrame, percentiles: DataFrame, wrapper: DataFrame | None = None) -> DataFrame:
    """The four release conditions over one-row reports."""
    every = buckets.filter("bucket = 'all'")
    valid, copyable = (every.select(c).scalar() for c in ("valid_rate", "copyable_rate"))
    p95 = percentiles.select("p95").scalar()
    if wrapper is None:
        repaired = F.lit(True)
    else:
        repaired = (wrapper.select("repair_schema_rate").scalar() >= 0.5) | (
            wrapper.select("repair_trigger_rate").scalar() == 0
        )
    return buckets.sparkSession.range(1).select(
        (valid >= 0.54).alias("valid_ok"), (copyable >= 0.54).alias("copyable_ok"),
        (p95 <= 12000).alias("latency_ok"), repaired.alias("repair_ok"),
    )


def ambiguity(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """How many senses the outputs of ambiguous cases take, and how stable the leading one is."""
    marked = cases.filter(F.array_contains("tags", "ambiguity")).select("case_id").distinct()
    senses = runs.select("case_id", C.acronym_sense(F.col("output")).alias("sense")).filter("sense is not null")
    counted = senses.groupBy("case_id", "sense").agg(F.count("*").alias("n"))
    per_case = counted.groupBy("case_id").agg(
        F.count("*").alias("senses"), (F.max("n") / F.sum("n")).alias("share")
    )
    share = F.coalesce("share", F.lit(0.0))
    return marked.join(per_case, "case_id", "left").agg(
        F.count("*").alias("total_cases"),
        F.coalesce(F.avg((F.coalesce("senses", F.lit(0)) > 1).cast("double")), F.lit(0.0)).alias("spread"),
        F.coalesce(F.avg((share >= 2 / 3).cast("double")), F.lit(0.0)).alias("dominant_rate"),
        F.coalesce(F.avg(share), F.lit(1.0)).alias("stability"),
    )


def frequent_words(text: str, size: int = 10, longer_than: int = 3) -> Column:
    """Most frequent longer words of a text as ``(word, n)``, first seen first on ties.

    Words are sorted with their places, runs of equal ones counted by where they start: a row stays a row.
    """
    let = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731 - worked out once, however often it is used
    kept = F.filter(F.transform(words(F.lower(text)), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.length(x["w"]) > longer_than)

    def counted(x: Column) -> Column:
        at = lambda i: F.get(x, i)
        fresh = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (at(i)["w"] != at(i - 1)["w"]))
        runs = let(F.when(F.size(x) > 0, fresh).otherwise(F.array().cast("array<int>")), lambda starts: F.transform(
            starts, lambda s, k: F.struct(
                (s - F.coalesce(F.get(starts, k + 1), F.size(x))).alias("less"), at(s)["i"].alias("first"), at(s)["w"].alias("word")
            )
        ))
        return F.transform(F.slice(F.array_sort(runs), 1, size), lambda r: F.struct(r["word"].alias("word"), (-r["less"]).cast("long").alias("n")))

    return let(F.array_sort(kept), counted)


def top_words(docs: DataFrame, keys: list[str], text: str, size: int = 10, longer_than: int = 3) -> DataFrame:
    """Most frequent longer words per document, first seen first on ties."""
    listed = docs.select(*keys, F.posexplode(frequent_words(text, size, longer_than)).alias("_p", "_w"))
    return listed.select(*keys, F.col("_w.word").alias("word"), F.col("_w.n").alias("n"), (F.col("_p") + 1).alias("rank"))


def keyword_features(runs: DataFrame, text: str = "output") -> DataFrame:
    """Known verb, object and technologies, sections, questions and length of a text."""
    tokens = words(F.lower(text))
    first = lambda terms: F.get(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.array_contains(F.col("_w"), t)), F.lit(0))
    return (
        runs.withColumn("_w", tokens)
        .withColumns(
            {
                "verb": first(fixed.KNOWN_VERBS), "object": first(fixed.KNOWN_OBJECTS),
                "tech": F.filter(F.array(*[F.lit(t) for t in fixed.KNOWN_TECH]), lambda t: F.array_contains(F.col("_w"), t)),
                "has_sections": F.col(text).rlike(rx(r"^#+\s+\w+", "m", ascii_words=True)),
                "has_questions": F.contains(F.col(text), F.lit("?")),
                "long_words": F.array_distinct(F.filter("_w", lambda w: F.length(w) > 3)),
                "length": F.length(text),
            }
        )
        .drop("_w")
    )


def pair_similarity(sets: DataFrame, case: str = "case_no", run: str = "run") -> DataFrame:
    """Mean keyword overlap and word Jaccard over all pairs of different runs of a case.

    Runs of a case are cut into blocks of bounded size, which meet by pairs of blocks and never by case
    alone: a pair yields one row of sums, so no pair of runs is ever a row, and a case with very many runs
    is as many tasks as it has pairs of blocks.
    """
    sizes = sets.groupBy(case).agg(F.count("*").alias("_n"))
    numbered = sets.join(sizes.select(case, F.ceil(F.col("_n") / BLOCK_RUNS).alias("_blocks")), case).withColumn(
        "_block", F.pmod(F.xxhash64(run, "keywords", "long_words"), F.col("_blocks"))
    )
    blocks = numbered.groupBy(case, "_blocks", "_block").agg(
        F.collect_list(F.struct(F.col(run).alias("run"), "keywords", "long_words")).alias("_runs")
    )
    # the cells of a triangle of blocks: a block is first in the cells of its row, second in those of its column
    last = F.col("_blocks") - 1
    left = blocks.select(case, F.col("_block").alias("_b1"), F.explode(F.sequence("_block", last)).alias("_b2"), F.col("_runs").alias("_r1"))
    right = blocks.select(case, F.explode(F.sequence(F.lit(0).cast("long"), "_block")).alias("_b1"), F.col("_block").alias("_b2"), F.col("_runs").alias("_r2"))
    pairs = left.join(right, [case, "_b1", "_b2"])
    counts = lambda x, y: (x["run"] < y["run"]) | ((F.col("_b1") < F.col("_b2")) & (x["run"] != y["run"]))

    def total(field: str | None) -> Column:
        value = lambda x, y: jaccard(x[field], y[field]) if field else F.lit(1.0)
        row = lambda x: F.aggregate(
            "_r2", F.lit(0.0), lambda acc, y: acc + F.when(counts(x, y), value(x, y)).otherwise(0.0)
        )
        return F.aggregate("_r1", F.lit(0.0), lambda acc, x: acc + row(x))

    sums = pairs.select(case, total("keywords").alias("_k"), total("long_words").alias("_w"), total(None).alias("_p"))
    return sums.groupBy(case).agg(
        F.try_divide(F.sum("_k"), F.sum("_p")).alias("keyword_overlap"),
        F.try_divide(F.sum("_w"), F.sum("_p")).alias("word_jaccard"),
    )


def variability(runs: DataFrame, case: str = "case_no") -> DataFrame:
    """How much the outputs of repeated runs differ, per case."""
    # five aggregates read the features; the texts are gone through once
    featured = materialise(
        keyword_features(runs).select(
            case, "run", "confidence", "verb", "object", "tech", "has_sections", "long_words", "length",
            F.coalesce(frequent_words("output")["word"], F.array().cast("array<string>")).alias("keywords"),
        )
    )
    sets = featured.select(case, "run", "long_words", "keywords")
    base = featured.groupBy(case).agg(
        F.count("*").alias("runs"), F.stddev_pop("confidence").alias("confidence_sd"),
        F.stddev_pop("length").alias("length_sd"),
        F.avg(F.col("has_sections").cast("double")).alias("section_consistency"),
    )

    def leading(values: DataFrame, name: str) -> DataFrame:
        return values.groupBy(case, "v").agg(F.count("*").alias("n")).groupBy(case).agg(F.max("n").alias(name))

    parts = {
        "verb": leading(featured.select(case, F.col("verb").alias("v")).filter("v is not null"), "_verb"),
        "object": leading(featured.select(case, F.col("object").alias("v")).filter("v is not null"), "_object"),
        "tech": leading(featured.select(case, F.explode("tech").alias("v")), "_tech"),
    }
    out = base.join(pair_similarity(sets, case), case, "left")
    for name, part in parts.items():
        out = out.join(part, case, "left").withColumn(
            f"{name}_consistency", F.coalesce(F.col(f"_{name}"), F.lit(0)) / F.col("runs")
        ).drop(f"_{name}")
    k, w = F.col("keyword_overlap"), F.col("word_jaccard")
    return out.withColumn(
        "level", F.when((k > 0.7) & (w > 0.7), "low").when((k > 0.4) & (w > 0.4), "medium").otherwise("high")
    )


def variability_verdict(report: DataFrame) -> DataFrame:
    mean = F.avg("word_jaccard")
    return report.agg(mean.alias("mean_jaccard")).withColumn(
        "verdict",
        F.when(F.col("mean_jaccard") < 0.6, "high").when(F.col("mean_jaccard") < 0.8, "medium").otherwise("low"),
    )


def keyword_frequency(runs: DataFrame, case: str = "case_no", size: int = 15) -> DataFrame:
    """Keywords most runs of a case share."""
    tops = top_words(runs, [case, "run"], "output")
    totals = runs.groupBy(case).agg(F.count("*").alias("_runs"))
    counted = tops.groupBy(case, "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy(case).orderBy(F.desc("n"), "word")
    ranked = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    return ranked.join(totals, case).select(case, "word", "n", "rank", (F.col("n") / F.col("_runs")).alias("share"))


MODE_GATES = ["json_valid", "confidence_ok", "copyable", "review_rate_ok"]


def mode_evaluation(runs: DataFrame, mode: str = "backend") -> DataFrame:
    """Counts of passed gates, mean and p95 latency per mode; a run without output failed."""
    gated = runs.withColumn(
        "_g", C.case_gates(F.col("output"), F.col("confidence"), F.col("case_id"), F.lit(50))
    ).withColumn("_ok", F.col("output").isNotNull())
    passed = lambda g: F.col("_ok") & F.col(f"_g.{g}")
    every = reduce(lambda a, b: a & b, [passed(g) for g in MODE_GATES])
    stats = gated.groupBy(mode).agg(
        F.count("*").alias("total"), F.count_if("_ok").alias("success"), F.count_if(~F.col("_ok")).alias("failed"),
        *[F.count_if(passed(g)).alias(g) for g in MODE_GATES],
        F.avg(F.when(F.col("_ok"), F.col("latency_ms"))).alias("avg_latency"),
        F.max(F.when(F.col("_ok"), F.col("latency_ms"))).alias("_max"),
        F.avg(F.when(F.col("_ok"), F.coalesce("confidence", F.lit(0.5)))).alias("avg_confidence"),
        F.count_if(every).alias("rows_passing_all"),
    )
    p95 = exact_quantiles(runs.filter("output is not null"), [mode], "latency_ms", {"_p95": ("floor", 0.95)})
    return (
        stats.join(p95, mode, "left")
        .withColumn("p95_latency", F.when(F.col("success") < 20, F.col("_max")).otherwise(F.col("_p95")))
        .withColumn("all_gates", F.least(*MODE_GATES))
        .drop("_max", "_p95")
    )


def mode_delta(evaluation: DataFrame, mode: str, base: str, other: str) -> DataFrame:
    """Gate counts of one mode less those of the base mode."""
    long = evaluation.unpivot([mode, "total"], [*MODE_GATES, "all_gates"], "gate", "n")
    wide = long.groupBy("gate").pivot(mode, [base, other]).agg(F.first("n").alias("n"), F.first("total").alias("total"))
    delta = F.col(f"{other}_n") - F.col(f"{base}_n")
    return wide.select("gate", delta.alias("delta"), F.coalesce(F.try_divide(delta * 100.0, F.col(f"{base}_total")), F.lit(0.0)).alias("delta_percent"))


def arm_report(results: DataFrame, arm: str, successes_only: bool = False) -> DataFrame:
    """Means and pass shares per arm."""
    rows = results.filter(F.col("error").isNull()) if successes_only else results
    full = lambda n: F.coalesce(F.col(n), F.lit("")) != ""
    length = F.length(F.coalesce("improved_prompt", F.lit("")))
    share = lambda cond: F.avg(cond.cast("double"))
    return rows.groupBy(arm).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), F.avg("latency_ms").alias("avg_latency_ms"),
        F.avg(length).alias("avg_length"), share(F.col("confidence") >= 0.7).alias("pass_confidence"),
        share(length >= 50).alias("pass_length"),
        share(full("role") & full("directive") & full("framework")).alias("pass_structure"),
    )


def arm_differences(report: DataFrame, arm: str, first: str, second: str) -> DataFrame:
    pick = lambda a, c: F.max(F.when(F.col(arm) == a, F.col(c)))
    return report.agg(
        *[(pick(first, c) - pick(second, c)).alias(f"{c}_difference") for c in ("avg_latency_ms", "avg_confidence", "avg_length")]
    )


def structure_presence(runs: DataFrame, text: str = "output") -> DataFrame:
    """Share of texts naming each structure word, and whether all name all."""
    upper = F.upper(text)
    flags = {w.lower(): F.contains(upper, F.lit(w)) for w in fixed.STRUCTURE_WORDS}
    return runs.agg(
        F.count("*").alias("n"), F.avg(F.length(text)).alias("avg_length"),
        *[F.avg(flag.cast("double")).alias(f"has_{name}") for name, flag in flags.items()],
        F.bool_and(count_present(upper, fixed.STRUCTURE_WORDS) == 4).alias("all_consistent"),
    )


def optimizer_outcome(trajectory: DataFrame, threshold: float = 1.0, rounds: int = 3) -> DataFrame:
    """Per prompt the best score (first wins), and the round at which it could stop."""
    stop = F.min(F.when(F.col("score") >= threshold, F.col("iteration_number")))
    return trajectory.groupBy("prompt_id").agg(
        stop.alias("_stop"),
        F.max(F.struct("score", (-F.col("iteration_number")).alias("_i"))).alias("_best"),
    ).select(
        "prompt_id", F.col("_best.score").alias("best_score"), (-F.col("_best._i")).alias("best_iteration"),
        F.coalesce("_stop", F.lit(rounds)).alias("iterations_run"), F.col("_stop").isNotNull().alias("early_stopped"),
    )


def orphan_steps(trajectory: DataFrame, prompts: DataFrame) -> DataFrame:
    return trajectory.join(prompts.select(F.col("id").alias("prompt_id")), "prompt_id", "left_anti")
