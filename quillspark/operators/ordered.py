"""Ordered computations that never gather one key, or a whole table, in a single task.

Rows are put in buckets of bounded size that follow the order. Work is done inside a bucket, and a
summary with one row per bucket carries state to the next, so a key holding a third of all rows is
spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.session import materialise

BUCKET_ROWS = 65536
HISTOGRAM_BINS = 4096
FEW_VALUES = 65536


def literal_rows(spark, rows: Sequence[Sequence], names: Sequence[str]) -> DataFrame:
    """A small fixed table as literals."""
    structs = [F.struct(*[_literal(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _literal(value) -> Column:
    return F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)


def with_position(df: DataFrame, order: Sequence[Column], name: str = "pos", bucket: str | None = None) -> DataFrame:
    """0-based place of every row in a total order, without a single-task window.

    A range shuffle sorts the table; the offset inside a range is known as soon as the sorted rows
    are written once, and the ranges' sizes (one row per shuffle partition) give the rest.
    """
    tagged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    stored = (
        materialise(tagged)
        .withColumn("_range", F.shiftright("_id", 33))
        .withColumn("_offset", F.col("_id").bitwiseAND((1 << 33) - 1))
    )
    sizes = stored.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per range partition, however large the table is.
    placed = stored.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_offset"))
    if bucket:
        placed = placed.withColumn(bucket, F.floor(F.col(name) / BUCKET_ROWS))
    return placed.drop("_id", "_range", "_offset", "_start")


def neighbour(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], bucket: str,
    name: str, ahead: bool,
) -> DataFrame:
    """Adds the ``columns`` of the next (or previous) row of the same key as a struct ``name``.

    ``bucket`` must rise with the order within a key and bound the rows of a key that share it.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    value = F.struct(*columns)
    local = df.withColumn(name, (F.lead if ahead else F.lag)(value).over(inside))
    edge_order = [F.col(c).asc() if ahead else F.col(c).desc() for c in order]
    edges = (
        df.select(*keys, bucket, *order, value.alias("_edge"))
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*edge_order)))
        .filter("_rn = 1")
    )
    # One row per bucket of a key.
    along = Window.partitionBy(*keys).orderBy(F.col(bucket).asc() if ahead else F.col(bucket).desc())
    carried = (
        edges.withColumn("_to", F.lag(bucket).over(along))
        .filter("_to is not null")
        .select(*keys, F.col("_to").alias(bucket), "_edge")
    )
    return (
        local.join(carried, [*keys, bucket], "left")
        .withColumn(name, F.coalesce(name, "_edge"))
        .drop("_edge")
    )


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], bucket: str
) -> DataFrame:
    """Adds running totals within a key, the present row included."""
    work = df
    for name, value in sums.items():
        work = work.withColumn(f"_in_{name}", value)
    inside = (
        Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = work
    for name in sums:
        local = local.withColumn(name, F.sum(f"_in_{name}").over(inside))
    totals = work.groupBy(*keys, bucket).agg(*[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # Only keys that span buckets have anything to carry.
    carried = totals.select(
        *keys, bucket, F.count("*").over(earlier).alias("_spans"),
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
    ).filter("_spans > 0").drop("_spans")
    joined = local.join(carried, [*keys, bucket], "left")
    for name in sums:
        joined = joined.withColumn(name, F.col(name) + F.coalesce(f"_c_{name}", F.lit(0)))
    return joined.drop(*[f"_in_{n}" for n in sums], *[f"_c_{n}" for n in sums])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, tuple[str, float]]
) -> DataFrame:
    """Exact order statistics per key, however many rows or distinct values a key has.

    ``wanted`` maps an output column to ``("median", .5)``, ``("nearest", p)`` for the value at
    1-based rank ``ceil(n p)``, or ``("floor", p)`` for 0-based index ``floor(n p)``, the last
    value at most. Null values are left out; a null key is a key. Without keys there is one row, of nulls if
    there are no values.

    Equal values are counted once. Every wanted rank then has an interval of values it must lie in,
    at first its key's whole range. While an interval holds many distinct values, one pass counts them in
    HISTOGRAM_BINS bins and the rank goes on with the one bin that contains it. What is left is ordered
    per key and interval, which is never more than FEW_VALUES rows.
    """
    whole = not keys
    present = df.select(*keys, F.col(value).alias("_v")).filter("_v is not null")
    # without keys all rows have the same one
    counts = materialise(present.withColumn("_all", F.lit(0)).groupBy("_all", *keys, "_v").agg(F.count("*").alias("_n")))
    keys = list(keys) or ["_all"]
    sizes = counts.groupBy(*keys).agg(
        F.sum("_n").alias("_total"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_rows")
    ).filter("_total > 0")
    total = F.col("_total")
    ranks = {}
    for name, (kind, p) in wanted.items():
        if kind == "median":
            ranks |= {f"{name} low": F.floor((total - 1) / 2), f"{name} high": F.floor(total / 2)}
        elif kind == "nearest":
            # decimal product, so that e.g. 20 * 0.95 is 19 and not a hair more
            rank = F.ceil(total.cast("decimal(20,0)") * F.lit(str(p)).cast("decimal(6,4)")).cast("long")
            ranks[name] = F.greatest(rank - 1, F.lit(0))
        else:
            ranks[name] = F.least(F.floor(total * F.lit(p)).cast("long"), total - 1)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), r.cast("long").alias("_rank")) for n, r in ranks.items()]))
    targets = sizes.select(*keys, "_lo", "_hi", "_rows", each.alias("_t")).select(*keys, "_lo", "_hi", "_rows", "_t._name", "_t._rank")
    largest = sizes.agg(F.max("_rows")).first()[0] or 0
    while largest > FEW_VALUES:
        targets = materialise(_narrowed(counts, targets, keys))
        before, largest = largest, targets.agg(F.max("_rows")).first()[0]
        if largest >= before:  # values too close together for the bins to tell apart
            break
    upto = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _inside(counts, targets, keys).withColumn("_upto", F.sum("_n").over(upto)).withColumn("_from", F.col("_upto") - F.col("_n"))
    found = _matched(placed, targets, keys, (F.col("_from") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
    at = lambda name: F.max(F.when(F.col("_name") == name, F.col("_v")))
    out = [
        ((at(f"{n} low") + at(f"{n} high")) / 2 if kind == "median" else at(n)).alias(n) for n, (kind, _) in wanted.items()
    ]
    return found.groupBy(*([] if whole else keys)).agg(*out)


def _matched(rows: DataFrame, targets: DataFrame, keys: Sequence[str], also: Column) -> DataFrame:
    """Rows of an interval with the targets in it."""
    renamed = targets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_lo").alias("_tlo"), F.col("_hi").alias("_thi"), "_name", "_rank")
    same = F.col("_lo").eqNullSafe(F.col("_tlo")) & F.col("_hi").eqNullSafe(F.col("_thi")) & also
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(renamed, same).drop(*[f"_k{i}" for i in range(len(keys))], "_tlo", "_thi")


def _inside(counts: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counted values with the intervals they lie in, one row for each."""
    spans = targets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_lo", "_hi").distinct()
    within = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    for i, k in enumerate(keys):
        within = within & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return counts.join(spans, within).drop(*[f"_k{i}" for i in range(len(keys))])


def _narrowed(counts: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every target with the bin of its interval that holds its rank; bins follow the order of values."""
    half = lambda c: F.when(F.isnan(F.col(c).cast("double")), F.lit(8e307)).otherwise(
        F.greatest(F.lit(-8e307), F.least(F.lit(8e307), F.col(c).cast("double") / 2))
    )
    width = half("_hi") - half("_lo")
    place = F.when(width > 0, F.floor((half("_v") - half("_lo")) / width * HISTOGRAM_BINS)).otherwise(0)
    bins = _inside(counts, targets, keys).groupBy(*keys, "_lo", "_hi", place.alias("_bin")).agg(
        F.sum("_n").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.count("*").alias("_rows")
    )
    # as many rows per interval as there are bins
    upto = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = bins.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_from", F.col("_upto") - F.col("_n"))
    found = _matched(placed, targets, keys, (F.col("_from") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
    return found.select(*keys, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), "_rows", "_name", (F.col("_rank") - F.col("_from")).alias("_rank"))
