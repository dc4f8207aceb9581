"""Writers: appended history, upserted metrics, pools and splits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.operators.sessions import latest_per_key
from quillspark.session import delete_folder, materialise, read_folders


def append_history(df: DataFrame, path: str) -> None:
    """Rows appended under their day; guardrails are stored as JSON text.

    Rows are brought together by day, so that files grow with days and bytes and not with tasks times days; a day
    with more than a task's share is dealt to several.
    """
    (
        df.withColumn("guardrails", F.to_json("guardrails"))
        .withColumn("day", F.to_date("created_at"))
        .hint("rebalance", "day")
        .write.mode("append").partitionBy("day").parquet(path)
    )


def upsert_metrics(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch: writing a batch again replaces exactly that batch."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def read_upserted(spark, path: str, key: str = "prompt_id", time: str = "measured_at") -> DataFrame:
    """Last write per key over all batches."""
    return latest_per_key(spark.read.parquet(path), [key], [F.desc("batch"), F.desc(time)]).drop("batch")


def compact(spark, path: str, target: str, key: str = "prompt_id", time: str = "measured_at") -> None:
    """All batches folded into the first batch of a new table."""
    read_upserted(spark, path, key, time).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch=0")


def write_pool(pool: DataFrame, statistics: DataFrame, path: str) -> None:
    """Rows and, beside them, their statistics."""
    pool.write.mode("overwrite").json(f"{path.rstrip('/')}/examples")
    statistics.write.mode("overwrite").json(f"{path.rstrip('/')}/statistics")


def write_split(split: DataFrame, name: str, path: str) -> None:
    split.withColumn("dataset_name", F.lit(name)).write.mode("overwrite").partitionBy("split").json(path)


def retain_days(df: DataFrame, path: str) -> None:
    """Day partitions present in ``df`` replaced by its rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def retain_history(spark: SparkSession, path: str, as_of: str, days: int) -> None:
    """Stored history without rows more than ``days`` older than ``as_of``.

    Whole days go as folders, the day of the cut is written anew, later days are not touched. Running it
    again changes nothing.
    """
    cut = dt.datetime.fromisoformat(as_of) - dt.timedelta(days=days)
    stored = read_folders(spark, path)
    edge = stored.filter((F.col("day") == F.lit(cut.date())) & (F.col("created_at") >= F.lit(cut.isoformat(" ")).cast("timestamp")))
    kept = materialise(edge)
    # only partition values are read: one row per day
    old = [r["day"] for r in stored.select("day").filter(F.col("day") <= F.lit(cut.date())).distinct().collect()]
    some_left = not kept.isEmpty()
    if some_left:
        retain_days(kept, path)
    for day in old:
        if day < cut.date() or not some_left:
            delete_folder(spark, f"{path.rstrip('/')}/day={day}")
