"""Exact top-k inner products by MaxScore over shards.

The terms of a query are the vector's components. In a shard each term has a greatest and a least
value, which bound what it can add to a score. Terms are ordered by that range. Those at the end are non-essential: a
vector that takes the least of every essential term cannot reach the query's k-th score with them. The
essential ones are traversed for all vectors, the others probed term block by term block, only for vectors
whose bound still reaches the k-th score. That score rises along a task's shards, so fewer terms become
essential. The tasks' lists are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillspark.llm.common import query, table

QUERY_BLOCK = 4096  # queries that go to the tasks at once
SHARD = 8192  # vectors a task scores at a time
FIRST = 512  # vectors scored whole for a query's first k-th score
SCALE = 256
STEP = 8  # terms probed at a time
EXACT = 2.0**53  # whole sums below this are exact in doubles


def finite_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their vectors, by length; rows that are null or hold a null or a non-finite component are left out."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    lengths = np.diff(offsets)
    for n in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == n))
        yield rows, values[offsets[rows][:, None] + np.arange(n)]


def scaled(values: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``floor(256 x)``, in doubles where inner products with ``other`` stay exact there, else in Python's integers."""
    greatest = lambda m: SCALE * float(np.abs(m).max(initial=0)) + 1
    if greatest(values) * greatest(other) * max(values.shape[-1], 1) < EXACT:
        return np.floor(SCALE * values)
    whole = lambda x: math.floor(x) * SCALE if abs(x) >= EXACT else math.floor(x * SCALE)
    out = np.empty(values.shape, dtype=object)
    out.flat = [whole(x) for x in values.ravel().tolist()]
    return out


class Search:
    """The k best of the shards seen so far for queries of one length.

    ``read`` counts the components that were read, which shows what was skipped.
    """

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k, self.read = query_ids, queries, k, 0
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(query_ids)

    def add(self, ids: np.ndarray, values: np.ndarray) -> None:
        """Takes a shard's rows in."""
        columns = np.ascontiguousarray(scaled(values, self.queries).T)
        queries = scaled(self.queries, values)
        high, low = columns.max(axis=1, initial=-math.inf), columns.min(axis=1, initial=math.inf)
        for at, q in enumerate(queries):
            start = 0
            while start < len(ids):
                end = len(ids) if len(self.best[at][0]) >= self.k else start + FIRST
                part = slice(start, end)
                self._block(at, q, ids[part], columns[:, part], q * high, q * low)
                start = end

    def _block(self, at: int, q: np.ndarray, ids: np.ndarray, columns: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        scores, kept = self.best[at]
        floor = scores[-1] if len(scores) >= self.k else -math.inf
        top, bottom = np.maximum(one, two), np.minimum(one, two)
        order = np.argsort(bottom - top, kind="stable")
        after = np.concatenate([np.cumsum((top - bottom)[order][::-1])[::-1], [0]])  # range of the terms from each place on
        done = int(np.argmax(bottom.sum() + after < floor)) if floor > -math.inf else len(order)
        if floor > -math.inf and not bottom.sum() + after[done] < floor:
            done = len(order)
        live = np.flatnonzero(ids != self.query_ids[at])
        partial = (q[order[:done]] @ columns[order[:done]])[live] if done else np.zeros(len(live), columns.dtype)
        self.read += done * len(ids)
        rest = top[order[done:]].sum()
        while True:
            keep = partial + rest >= floor
            live, partial = live[keep], partial[keep]
            if done >= len(order) or not len(live):
                break
            terms = order[done : done + STEP]
            partial = partial + q[terms] @ columns[terms[:, None], live]
            self.read += len(terms) * len(live)
            rest = rest - top[terms].sum()
            done += len(terms)
        if len(live) > 4 * self.k and partial.dtype != object:
            keep = partial >= np.partition(partial, len(partial) - self.k)[len(partial) - self.k]
            live, partial = live[keep], partial[keep]
        scores, kept = np.concatenate([scores, partial]), np.concatenate([kept, ids[live]])
        first = sorted(range(len(kept)), key=lambda i: (-scores[i], kept[i]))[: self.k]
        self.best[at] = scores[first], kept[first]

    def rows(self) -> pa.RecordBatch:
        found = [(int(q), int(i), int(s)) for q, (scores, ids) in zip(self.query_ids, self.best) for s, i in zip(scores, ids)]
        if any(not -(1 << 63) <= s < 1 << 63 for _, _, s in found):
            raise OverflowError("a score among the k best does not fit a long: components are too large")
        columns = list(zip(*found)) if found else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def top_k(
    data: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of every query with all other rows.

    ``queries`` holds the same two columns. Components become ``floor(256 x)``. Ties go to the smaller
    id. Vectors that are null, or hold null or non-finite components, take no part; nor do rows with a
    null id, and vectors of another length than the query's. Repeated ids are candidates once per row; a repeated
    query id searches with the least of its vectors. Sums are exact whatever the components; where one of a task's k
    best does not fit a long, the job stops with an error that says so. Queries go out in
    blocks of QUERY_BLOCK, each against all rows. Other columns are not read.
    """
    rows = data.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    usable = F.forall("v", lambda x: F.coalesce(F.abs(x) < math.inf, F.lit(False)))
    wanted = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    spark = data.sparkSession
    found = None
    for block in _blocks(wanted.filter(usable).groupBy("id").agg(F.min("v").alias("v"))):
        sent = spark.sparkContext.broadcast(block)
        part = rows.mapInArrow(_scorer(sent, k), "query_id long, vec_id long, score long")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(wanted: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Query ids and vectors by length, at most QUERY_BLOCK at a time."""
    held: list[tuple[int, list[float]]] = []

    def grouped() -> dict[int, tuple[np.ndarray, np.ndarray]]:
        by_length: dict[int, list] = {}
        for row in held:
            by_length.setdefault(len(row[1]), []).append(row)
        return {n: (np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64).reshape(len(rows), n)) for n, rows in by_length.items()}

    for row in wanted.toLocalIterator():
        held.append((row["id"], row["v"]))
        if len(held) == QUERY_BLOCK:
            yield grouped()
            held = []
    if held:
        yield grouped()


def _scorer(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {n: Search(ids, vectors, k) for n, (ids, vectors) in sent.value.items()}
        held: dict[int, list] = {n: [] for n in searches}

        def flush(n: int) -> None:
            ids, values = (np.concatenate(parts) for parts in zip(*held[n]))
            held[n] = []
            for start in range(0, len(ids), SHARD):
                searches[n].add(ids[start : start + SHARD], values[start : start + SHARD])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, values in finite_rows(batch.column(1)):
                n = values.shape[1]
                if n in held:
                    held[n].append((ids[rows], values))
                    if sum(len(part) for part, _ in held[n]) >= SHARD:
                        flush(n)
        for n, search in searches.items():
            if held[n]:
                flush(n)
            yield search.rows()

    return run


@query(
    "op8_maxscore",
    """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """The five highest inner products of every 50th vector with all others."""
    data = table(spark, folder, "embeddings")
    return top_k(data, data.filter("vec_id % 50 = 0"), 5)
