"""History store: lookups, search, ranges, pages and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def find_recent(
    history: DataFrame, limit: int, offset: int = 0, provider: str | None = None, backend: str | None = None
) -> DataFrame:
    """A page of the newest rows, optionally of one provider or backend."""
    for name, value in (("provider", provider), ("backend", backend)):
        if value is not None:
            history = history.filter(F.col(name) == value)
    return history.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def search(history: DataFrame, text: str, limit: int) -> DataFrame:
    """Newest rows whose idea or prompt matches ``%text%`` regardless of case."""
    pattern = f"%{text}%"
    hit = F.col("original_idea").ilike(pattern) | F.col("improved_prompt").ilike(pattern)
    return history.filter(hit).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def by_date_range(df: DataFrame, start: Column, end: Column, limit: int, time: str = "created_at") -> DataFrame:
    """Newest rows of a range; of a table stored by ``day`` only the days of the range are read."""
    if "day" in df.columns:
        df = df.filter(F.col("day").between(F.to_date(start), F.to_date(end)))
    return df.filter(F.col(time).between(start, end)).orderBy(F.desc(time), F.desc("id")).limit(limit)


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def retain(history: DataFrame, as_of: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Rows young enough to keep, and how many are not."""
    cut = as_of - F.make_dt_interval(F.lit(days))
    return history.filter(F.col("created_at") >= cut), history.agg(
        F.count_if(F.col("created_at") < cut).alias("deleted")
    )


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).distinct()


def export_examples(history: DataFrame, limit: int) -> DataFrame:
    """Newest rows as flat examples; everything but idea and prompt goes to metadata."""
    context = F.coalesce("context", F.lit(""))
    idea = F.concat(
        "original_idea", F.when(context != "", F.concat(F.lit("\n\nContext: "), context)).otherwise("")
    )
    rest = [c for c in history.columns if c not in ("original_idea", "context", "improved_prompt", "id")]
    return (
        history.orderBy(F.desc("created_at"), F.desc("id"))
        .limit(limit)
        .select(idea.alias("input"), F.col("improved_prompt").alias("output"), F.struct(*rest).alias("metadata"))
    )
