"""Vector codes of a few bytes: product codebooks learned by active-entry Lloyd rounds in whole numbers.

A vector is cut into consecutive parts, each part position has its own codebook. Every vector's row
carries, for each part, the entry it is assigned to and its exact squared distance. A round needs then

* for parts whose entry stayed as it was: only the entries that moved, compared with the stored
  distance (an entry that did not move cannot have come nearer);
* for parts whose entry moved: all entries.

Equal distances go to the lower index in both cases. A round is one pass: tasks read the rows of the
last one, write the new assignments and, beside them, one row of sums per entry, which Spark adds up.
The codebooks (entries x components) are all the driver holds, whatever the number of vectors. Each
round's table lies in the shared folder, so a lost executor costs the tasks it ran and no round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quillspark.llm.common import query, table
from quillspark.llm.scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
EXACT_FLOAT = 1 << 53  # whole numbers below it are exact as doubles


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold finite components only."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd)


def largest_component(width: int) -> int:
    """Components up to this size, in parts of ``width``, have squared distances that fit a long."""
    return int(np.sqrt(float(1 << 62) / max(width, 1)) / 2)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-numbered rows to entries."""
    if not x.size or not entries.size:
        return np.zeros((len(x), len(entries)), dtype=np.int64)
    reach = int(np.abs(x).max()) + int(np.abs(entries).max())
    if x.shape[1] * reach * reach < EXACT_FLOAT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def reassign(
    x: np.ndarray, code: np.ndarray, dist: np.ndarray, entries: np.ndarray, moved: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """New entries and exact distances of one part, and how many comparisons that took.

    ``code`` is -1 where nothing was assigned yet. ``moved`` marks the entries that changed since
    ``dist`` was measured.
    """
    code, dist = code.copy(), dist.copy()
    away = (code < 0) | moved[np.maximum(code, 0)]
    active = np.flatnonzero(moved)
    stay = np.flatnonzero(~away)
    if len(stay) and len(active):
        found = distances(x[stay], entries[active])
        at = found.argmin(axis=1)
        near, index = found[np.arange(len(stay)), at], active[at]
        better = (near < dist[stay]) | ((near == dist[stay]) & (index < code[stay]))
        code[stay[better]], dist[stay[better]] = index[better], near[better]
    go = np.flatnonzero(away)
    if len(go):
        found = distances(x[go], entries)
        code[go] = found.argmin(axis=1)
        dist[go] = found.min(axis=1)
    return code, dist, len(stay) * len(active) + len(go) * len(entries)


def new_entries(entries: np.ndarray, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> np.ndarray:
    """Codebooks of shape (parts, entries, width) with every used entry at the floored mean of its parts."""
    out = entries.copy()
    for (part, entry), (count, total) in sums.items():
        out[part, entry] = [s // count for s in total]
    return out


def codebooks_text(books: np.ndarray, dims: int) -> str:
    """Components in decimal, by part, entry and place; places that only fill up the last part are left out."""
    width = books.shape[2] if books.ndim == 3 else 0
    return ",".join(
        str(int(v)) for p, part in enumerate(books) for entry in part for v in entry[: max(0, min(width, dims - p * width))]
    )


def quantise(
    data: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray, int]:
    """``vec_id, label, c0.., d0..`` of every usable vector, the codebooks, and the vectors' length.

    Components become ``floor(scale * x)``. The codebooks start as the parts of the ``entries`` smallest
    ids (rows that repeat an id in the order of their vectors; rows without an id start none). Vectors that are
    null or hold a null, a NaN or an infinity are left out. Rows with a null id, and rows that repeat one, count
    as vectors of their own; a null label is kept. The length is that of the smallest id's vector:
    vectors of another length are rows with null codes and take no part. A length that parts do not
    divide is filled up with zeros, which adds nothing to a distance. Components so large that a squared
    distance would not fit a long stop with an OverflowError that names the limit. Without a usable
    vector with an id there are no codebooks, and rows without an id have null codes. Only the three named
    columns are read.
    """
    numbers = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = data.filter(usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), numbers.alias("v")
    )
    first = rows.filter("vec_id is not null").orderBy("vec_id", "v").limit(entries).select("v").collect()
    dims = len(first[0]["v"]) if first else 0
    width = -(-dims // parts)
    start = [r["v"] for r in first if len(r["v"]) == dims]
    _within(np.array(start, dtype=np.int64).reshape(len(start), dims), width)
    books = np.ascontiguousarray(_parts(np.array(start, dtype=np.int64).reshape(len(start), dims), parts, width).transpose(1, 0, 2))

    names = [f"c{p}" for p in range(parts)], [f"d{p}" for p in range(parts)]
    shape = T.StructType([
        *rows.schema.fields, *[T.StructField(n, T.IntegerType()) for n in names[0]], *[T.StructField(n, T.LongType()) for n in names[1]],
        T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("size", T.LongType()),
        T.StructField("sums", T.ArrayType(T.LongType())),
    ])
    state = rows.select("vec_id", "label", "v", *[F.lit(None).cast("int").alias(n) for n in names[0]], *[F.lit(None).cast("long").alias(n) for n in names[1]])
    moved = np.ones(books.shape[:2], dtype=bool)
    spark = data.sparkSession
    with Scratch(spark) as scratch:
        written = None
        for turn in range(rounds + 1):
            sent = spark.sparkContext.broadcast((books, moved))
            after = scratch.write(state.mapInArrow(_round(sent, dims, shape, last=turn == rounds), shape), keep=turn == rounds)
            if written is not None:
                scratch.drop(written)
            sent.unpersist()
            written, state = after, after.filter("part is null").select("vec_id", "label", "v", *names[0], *names[1])
            if turn < rounds:
                fresh = new_entries(books, _sums(written, width))
                moved = (fresh != books).any(axis=2)
                books = fresh
    return state.drop("v"), books, dims


def _sums(written: DataFrame, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Size and component sums of every used entry: as many rows as the codebooks have entries."""
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    rows = (
        written.filter("part is not null").groupBy("part", "entry")
        .agg(wide(F.col("size")).alias("size"), F.array(*[wide(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    ).collect()
    return {(r["part"], r["entry"]): (int(r["size"]), [int(s) for s in r["sums"]]) for r in rows}


def _parts(x: np.ndarray, parts: int, width: int) -> np.ndarray:
    """(rows, parts, width), the last part filled up with zeros."""
    out = np.zeros((len(x), parts * width), dtype=np.int64)
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), parts, width)


def _within(x: np.ndarray, width: int) -> None:
    limit = largest_component(width)
    if x.size and (x.max() > limit or x.min() < -limit):
        raise OverflowError(f"a scaled component lies beyond {limit}: squared distances would not fit a long")


def _round(sent, dims: int, shape: T.StructType, last: bool):
    """Assignments under the sent codebooks, and after them the task's sums per used entry."""
    names = shape.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moved = sent.value
        parts, count, width = books.shape
        sums, sizes = np.zeros((parts, count, width), dtype=np.int64), np.zeros((parts, count), dtype=np.int64)
        kind = None
        for batch in batches:
            kind = batch.column(1).type
            n, v = batch.num_rows, batch.column(2)
            fits = np.asarray(v.value_lengths()) == dims if count else np.zeros(n, dtype=bool)
            flat = np.asarray(v.filter(pa.array(fits)).flatten())
            x = flat.reshape(int(fits.sum()), dims)
            _within(x, width)
            x = _parts(x, parts, width)
            codes, dists = [], []
            for p in range(parts):
                code, dist = (np.asarray(batch.column(i + p).fill_null(-1))[fits].astype(np.int64) for i in (3, 3 + parts))
                if count:
                    code, dist, _ = reassign(x[:, p], code, dist, books[p], moved[p])
                if len(code) and not last:
                    np.add.at(sums[p], code, x[:, p])
                    sizes[p] += np.bincount(code, minlength=count)
                codes.append(_spread(code, fits, pa.int32()))
                dists.append(_spread(dist, fits, pa.int64()))
            empty = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), v, *codes, *dists, *empty], names=names)
        p, e = np.nonzero(sizes)
        if len(p):
            n = len(p)
            totals = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(sums[p, e].reshape(-1)))
            none = [pa.nulls(n, pa.int32())] * parts + [pa.nulls(n, pa.int64())] * parts
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.list_(pa.int64())), *none,
                 pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(sizes[p, e]), totals],
                names=names,
            )

    return run


def _spread(values: np.ndarray, fits: np.ndarray, kind: pa.DataType) -> pa.Array:
    out = np.zeros(len(fits), dtype=np.int64)
    out[fits] = values
    return pa.array(out, kind, mask=~fits)


@query(
    "op13_active_lloyd",
    """
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS v FROM e, range(4) t(p)),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, v FROM x
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 256),
"""
    + "".join(
        f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, label, p, v, min(d * 256 + j) AS k FROM (
    SELECT vec_id, label, x.p, x.v, j, list_sum(list_transform(list_zip(x.v, b{r}.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d
    FROM x JOIN b{r} ON x.p = b{r}.p) GROUP BY ALL),
"""
        + (
            f"""
m{r} AS (
  SELECT p, k % 256 AS j, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS c FROM a{r}, range(1, 17) t(i) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (
  SELECT p, j, coalesce(n.v, b{r}.v) AS v FROM b{r} LEFT JOIN (SELECT p, j, list(c ORDER BY i) AS v FROM m{r} GROUP BY p, j) n USING (p, j)),
"""
            if r < 4
            else ""
        )
        for r in range(5)
    )
    + """
f AS (
  SELECT vec_id, label, string_agg(printf('%02x', k % 256), '' ORDER BY p) AS code, sum(k // 256)::BIGINT AS error
  FROM a4 GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM f, h
""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Four-byte codes of all vectors, their errors, and a digest of the codebooks they refer to."""
    coded, books, dims = quantise(table(spark, folder, "embeddings"))
    digest = hashlib.sha256(codebooks_text(books, dims).encode()).hexdigest()
    rows = coded.select(
        "vec_id", "label", F.concat(*[F.lower(F.lpad(F.hex(f"c{p}"), 2, "0")) for p in range(PARTS)]).alias("code"),
        sum((F.col(f"d{p}") for p in range(1, PARTS)), F.col("d0")).alias("error"),
    )
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
