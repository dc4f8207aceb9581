"""Tables written below the shared folder that are deleted once they are no longer read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import BATCH_BYTES, BATCH_MOST, BATCH_ROWS, BATCH_TEXTS
from quillspark.session import delete_folder, note_written, shared_folder


class Scratch:
    """Cuts lineage by writing tables; ``drop`` removes those given, leaving the context all but the kept ones.

    Inside, Arrow batches hold at most ``batch_rows`` rows and about BATCH_MOST bytes: texts and sets are long.
    """

    def __init__(self, spark: SparkSession, batch_rows: int = BATCH_TEXTS):
        self.spark = spark
        self.batch_rows = batch_rows
        self.root = f"{shared_folder(spark).rstrip('/')}/quillspark-llm/{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = 0

    def __enter__(self) -> "Scratch":
        self.before = {name: self.spark.conf.get(name) for name in (BATCH_ROWS, BATCH_BYTES)}
        if not 0 < int(self.before[BATCH_ROWS]) <= self.batch_rows:
            self.spark.conf.set(BATCH_ROWS, self.batch_rows)
        self.spark.conf.set(BATCH_BYTES, BATCH_MOST)
        return self

    def __exit__(self, *_) -> None:
        for name, value in self.before.items():
            self.spark.conf.set(name, value)
        for path in list(self.paths.values()):
            delete_folder(self.spark, path)

    def write(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """``df``, computed once. A kept table outlives the context: a result that is still to be read."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if keep:
            note_written(path)
        else:
            self.paths[id(out)] = path
            out._scratch = out  # keeps the id from being reused while the table is listed
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.paths.pop(id(df), None)
            if path:
                delete_folder(self.spark, path)
