"""Gate reports per document and gate rates over a dataset."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quillspark import fixed
from quillspark.functions import gates as G
from quillspark.operators.ordered import literal_rows
from quillspark.operators.rules import rule_rows, table_status


def gate_report(
    docs: DataFrame, text: str, template: str, thresholds: G.Thresholds = G.Thresholds(), severity: str | DataFrame = "reference",
    early_exit: bool = True, own: Mapping[str, Callable[[Column, Column, Column], Column]] | None = None,
) -> DataFrame:
    """One wide row per document: two hard gates, then the newer ones where both passed.

    ``severity`` "reference" leaves failures as they are; "configured" turns most into warnings;
    a table of ``gate, template, severity`` (``rules.table_status``) decides for itself. ``own`` gates are functions of text,
    template and JSON facts to a status; they follow the others and count like them.
    """
    rules = rule_rows(severity, "gate", "template", "severity") if isinstance(severity, DataFrame) else None
    t, kind = F.col(text), F.col(template)
    first = docs.withColumn("_facts", G.facts_for(t, kind))
    facts = F.col("_facts")
    first = first.withColumns(
        {"gate1_format": G.format_gate(t, kind, facts), "gate2_completeness": G.completeness_gate(t, kind, facts)}
    )
    passed = (F.col("gate1_format") == "PASS") & (F.col("gate2_completeness") == "PASS")
    run = passed if early_exit else F.lit(True)
    statuses = {}
    added = {gate: build(t, kind, facts) for gate, build in (own or {}).items()}
    for gate, status in {**G.v02_gates(t, kind, facts, thresholds), **added}.items():
        if rules is not None:
            status = table_status(rules, gate, status, kind)
        elif severity == "configured":
            status = G.configured_status(gate, status, kind)
        statuses[gate] = F.when(run, status).otherwise("SKIP")
    second = first.withColumn("v01_pass", passed).withColumns(statuses).drop("_facts")
    count = lambda level: reduce(lambda a, b: a + b, [(F.col(g) == level).cast("int") for g in statuses])
    fails, warns = F.col("v02_fail_count"), F.col("v02_warn_count")
    return (
        second.withColumns({"v02_fail_count": count("FAIL"), "v02_warn_count": count("WARN")})
        .withColumns(
            {
                "overall_pass": F.col("v01_pass") & (fails == 0),
                "overall_status": G.overall_status(F.col("v01_pass"), fails, warns),
                "summary": G.summary_line(
                    F.col("gate1_format"), F.col("gate2_completeness"), {g: F.col(g) for g in statuses}
                ),
            }
        )
    )


def long_results(report: DataFrame, key: str) -> DataFrame:
    """One row per document and gate."""
    return report.unpivot([key], ["gate1_format", "gate2_completeness", *G.V02_GATES], "gate", "status")


def gate_rates(report: DataFrame) -> DataFrame:
    """Failures and warnings per newer gate, as counts and shares of the documents evaluated."""
    items = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("status")) for g in G.V02_GATES])
    return report.select(F.inline(items)).groupBy("gate").agg(
        F.count("*").alias("evaluated"),
        F.count_if(F.col("status") == "FAIL").alias("fail_count"),
        F.count_if(F.col("status") == "WARN").alias("warn_count"),
    ).withColumn("fail_rate", F.try_divide("fail_count", "evaluated")).withColumn(
        "warn_rate", F.try_divide("warn_count", "evaluated")
    )


def evaluation_totals(docs: DataFrame, report: DataFrame, text: str) -> DataFrame:
    """Evaluated and skipped documents and the share passing both hard gates."""
    blank = F.coalesce(F.col(text), F.lit("")) == ""
    skipped = docs.agg(F.count_if(blank).alias("k")).scalar()
    return report.agg(F.count("*").alias("total_evaluated"), F.count_if("v01_pass").alias("v01_pass_count")).withColumn(
        "skipped_count", skipped
    ).withColumn("v01_pass_rate", F.try_divide("v01_pass_count", "total_evaluated"))


def skipped_rows(docs: DataFrame, text: str, index: str) -> DataFrame:
    return docs.filter(F.coalesce(F.col(text), F.lit("")) == "").select(index)


def threshold_advice(rates: DataFrame) -> DataFrame:
    """What to do about gates that fail or warn too often."""
    known = literal_rows(
        rates.sparkSession, [(g, *v) for g, v in fixed.GATE_ADVICE.items()],
        ["gate", "threshold_name", "threshold_value", "relax"],
    )
    high_fail, high_warn = F.col("fail_rate") >= 0.50, F.col("warn_rate") >= 0.70
    generic = F.concat(F.lit("Adjust threshold for "), F.col("gate"), F.lit(" (more_lenient)"))
    return (
        rates.filter(high_fail | high_warn)
        .join(F.broadcast(known), "gate", "left")  # one row per gate
        .select(
            "gate",
            F.when(high_fail, "high_fail_rate").otherwise("high_warn_rate").alias("issue"),
            F.when(high_fail, F.col("fail_rate")).otherwise(F.col("warn_rate")).alias("current_rate"),
            F.when(high_fail, F.coalesce("relax", generic)).otherwise(fixed.WARN_ADVICE).alias("recommendation"),
            F.when(high_fail, F.col("threshold_name")).alias("threshold_name"),
            F.when(high_fail, F.col("threshold_value")).alias("threshold_value"),
        )
    )


def gate_status(rates: DataFrame) -> DataFrame:
    state = (
        F.when(F.col("fail_rate") > 0.5, "NEEDS TUNING").when(F.col("warn_rate") > 0.7, "HIGH WARN RATE").otherwise("GOOD")
    )
    return rates.filter(F.col("gate").isin(list(fixed.GATE_ADVICE))).select("gate", "fail_rate", "warn_rate", state.alias("status"))
