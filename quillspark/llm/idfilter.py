"""A Bloom filter of fixed size over 64-bit values, put together by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import mix

FILTER_BITS = 1 << 26


def _places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spread = mix(values.astype(np.int64).view(np.uint64))
    bits = np.uint64(FILTER_BITS)
    return (spread % bits).astype(np.int64), ((spread >> np.uint64(32)) % bits).astype(np.int64)


def build_filter(values: DataFrame) -> np.ndarray:
    """Filter over the one long column of ``values``.

    Its size does not grow: an overfull filter lets everything through, which costs time and changes no
    result of those who use it ahead of a join.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(np.concatenate(_places(np.asarray(batch.column(0)))))
            place = bit >> 6
            value = np.uint64(1) << (bit & 63).astype(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(bit) else bit
            value = np.bitwise_or.reduceat(value, starts) if len(bit) else value
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[starts]), pa.array(value.view(np.int64))], names=["place", "bits"]
            )

    rows = values.mapInArrow(words, "place long, bits long").groupBy("place").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, dtype=np.int64)
    out[rows["place"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def without(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is not in the one long column, of that name, of ``ids``; a null is in none.

    Rows that the filter lets stay are not shuffled, only those it holds for listed are joined.
    """
    listed = rows.sparkSession.sparkContext.broadcast(build_filter(ids))

    @F.pandas_udf("boolean")
    def may_be(values: pd.Series) -> pd.Series:
        return pd.Series(passes(listed.value, values.to_numpy()))

    # a null is no id, and would make the numbers of its batch inexact
    hit = may_be(F.coalesce(F.col(column).cast("long"), F.lit(0)))
    kept = rows.filter(F.col(column).isNull() | ~hit)
    return kept.unionByName(rows.filter(F.col(column).isNotNull() & hit).join(ids, column, "left_anti").select(*rows.columns))


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    one, two = _places(values)
    hit = (bits[one >> 3] >> (one & 7).astype(np.uint8)) & (bits[two >> 3] >> (two & 7).astype(np.uint8)) & 1
    return hit.astype(bool)
