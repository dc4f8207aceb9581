"""A table with one row per key, kept in hash folders; a batch rewrites only the folders its keys fall in.

``<path>/batch=<id>/bucket=<n>/`` holds all rows of bucket n as of that batch. A batch counts once its
``_SUCCESS`` file is there, and a bucket's rows are those of the latest such batch that has the bucket.
So a batch that is written again replaces itself, a batch that fails half way changes nothing, and
readers of the state before it are not disturbed: folders go one batch after they were replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quillspark.operators.sessions import latest_per_key
from quillspark.session import delete_folder

BUCKETS = 64


def _folders(spark: SparkSession, path: str) -> dict[int, dict[int, str]]:
    """Folder of every bucket by committed batch."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    under = lambda where: list(fs.listStatus(where)) if fs.exists(where) else []
    number = lambda entry: int(entry.getPath().getName().split("=")[1])
    out: dict[int, dict[int, str]] = {}
    for batch in under(root):
        if batch.getPath().getName().startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(batch.getPath(), "_SUCCESS")):
            out[number(batch)] = {number(b): b.getPath().toString() for b in under(batch.getPath()) if b.getPath().getName().startswith("bucket=")}
    return out


def _current(folders: dict[int, dict[int, str]], upto: int | None = None) -> dict[int, str]:
    """The folder each bucket is read from, after batch ``upto`` or the last one."""
    out: dict[int, str] = {}
    for batch in sorted(folders):
        if upto is None or batch <= upto:
            out |= folders[batch]
    return out


def _load(spark: SparkSession, schema: T.StructType, paths: Sequence[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_keyed(spark: SparkSession, path: str, schema: T.StructType, buckets: Sequence[int] | None = None) -> DataFrame:
    """The latest row of every key; with ``buckets`` only the keys that fall in these."""
    current = _current(_folders(spark, path))
    return _load(spark, schema, [p for b, p in sorted(current.items()) if buckets is None or b in buckets])


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def upsert(df: DataFrame, path: str, batch_id: int, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> list[int]:
    """Puts the rows of one batch in; returns the buckets it rewrote.

    Of the rows of a key the one with the greatest ``order`` stays, the later batch's if they are equal;
    all its columns replace the old ones. Null keys are a key like any other. Batches come in the order
    of their ids, as a stream's do; one that is already there is not put in again, however often it is
    retried. An empty batch rewrites nothing.
    """
    spark, schema = df.sparkSession, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    folders = _folders(spark, path)
    if any(b >= batch_id for b in folders):
        return sorted(folders.get(batch_id, {}))
    newest = [F.desc(c) for c in order]
    fresh = latest_per_key(df.withColumn("bucket", bucket_of(keys, buckets)), keys, newest).persist()
    touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # of a fixed number
    current = _current(folders)
    old = _load(spark, schema, [current[b] for b in touched if b in current]).withColumn("bucket", bucket_of(keys, buckets))
    both = old.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    merged = latest_per_key(both, keys, [*newest, F.desc("_fresh")]).drop("_fresh")
    # files of a bucket by size, whatever the bucket holds
    merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path.rstrip('/')}/batch={batch_id}")
    fresh.unpersist()
    _forget(spark, path, batch_id)
    return touched


def _forget(spark: SparkSession, path: str, batch_id: int) -> None:
    """Folders that neither the table after this batch nor the one before it reads are deleted."""
    folders = _folders(spark, path)
    read = set(_current(folders).values()) | set(_current(folders, max((b for b in folders if b < batch_id), default=-1)).values())
    for batch, held in folders.items():
        for folder in held.values():
            if folder not in read:
                delete_folder(spark, folder)
        if held and batch < batch_id and not read & set(held.values()):
            delete_folder(spark, f"{path.rstrip('/')}/batch={batch}")
