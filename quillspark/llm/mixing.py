"""Language-model scores by logistic context mixing over bit predictors with exact context counts.

Texts are read as bytes, a byte as eight bits. For each order 1 to 5 a predictor holds how often a zero
and a one followed the last bytes and the bits of the byte so far; its input is the log odds of these
counts. Inputs are combined with weights that a gate selects (the longest context seen and the bit's
place), the weights are learned online, and an adaptive map over gate and probability refines the result.

Counting, weights and map come from the training documents, all of them. Equal contexts are counted
before anything is shuffled, so the online passes run over distinct contexts with their counts, each
occurrence predicted without itself. The counts are a table in the shared folder that grows with the
corpus: a row, a family, holds all contexts that share their last three bytes, and so everything that
orders 3 to 5 count, next to what follows its last two bytes. Only order 1, 2^16 counts, is sent to tasks.
Every distinct context is scored once, in its family, and joined to the places of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.llm.common import mix, query, slices, table, word_hashes
from quillspark.llm.scratch import Scratch

ORDERS = 5
SLOTS = 1 << 16  # of order 1, one for every byte and the bits after it
PRIOR = 0.4
GATES = (ORDERS + 1) * 8
CELLS = 32  # of the adaptive map, over the log odds
REACH = 8.0
ROUNDS = 2
BATCH = 2048  # contexts between two steps of the weights
RATE = 0.15
HEAD = 1 << 18  # most frequent tokens, whose counts every task holds; the others are joined
END_TOKEN = int(mix(np.array([0x454E44], dtype=np.uint64)).view(np.int64)[0])
MEMO = 1 << 20
KEPT = 1 << 20  # contexts used most, whose scores every task holds; the others are joined
CHUNK = 1 << 16  # contexts worked on at a time, whole families
HELD = 1 << 21  # distinct keys a task adds up before it passes them on


@dataclass
class Model:
    zeros: np.ndarray
    ones: np.ndarray
    weights: np.ndarray  # gates x (orders + 1); the last input is constant
    refined: np.ndarray  # gates x cells, log odds


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of every row and a closing zero byte, each with the ORDERS bytes before it, as one number; and row offsets."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(rows), sizes)
    width = ORDERS + 1  # zero bytes before a text, and the closing one
    padded = np.zeros(len(data) + width * rows, dtype=np.uint64)
    padded[np.arange(len(data)) + width * owner + ORDERS] = data
    key = padded.copy()
    for back in range(1, ORDERS + 1):
        key[back:] |= padded[:-back] << np.uint64(8 * back)
    keep = np.ones(len(padded), dtype=bool)
    first = offsets[:-1] + width * np.arange(rows)
    for k in range(ORDERS):
        keep[first + k] = False
    return key[keep], offsets + np.arange(rows + 1)


def slots(key: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Slot of the last byte and the bits so far."""
    return ((key & np.uint64(0xFF00)) | node).astype(np.int64)


def tallies(place: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For every ``place`` (a context and a byte) and bit of the byte, how often 0 and 1 followed: 8 x 2 x places."""
    order = np.argsort(place, kind="stable")
    place, n = place[order], n[order].astype(np.float64)
    out = np.empty((8, 2, len(place)), dtype=np.float32)
    for bit_at in range(8):
        node = place >> np.uint64(8 - bit_at)
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        size = np.diff(np.append(first, len(place)))
        one = np.add.reduceat(n * ((place >> np.uint64(7 - bit_at)) & np.uint64(1)), first)
        out[bit_at, 0, order] = np.repeat(np.add.reduceat(n, first) - one, size)
        out[bit_at, 1, order] = np.repeat(one, size)
    return out


def deeper_counts(key: np.ndarray, n: np.ndarray, family: np.ndarray, after: np.ndarray, after_n: np.ndarray, after_of: np.ndarray):
    """Counts of orders 2 to ORDERS for all contexts of whole families: orders x 8 x 2 x contexts.

    ``after`` are the bytes that followed the last two bytes of a family, ``after_of`` their family.
    """
    out = np.empty((ORDERS - 1, 8, 2, len(key)), dtype=np.float32)
    place = np.concatenate([(family << 8) | (key & np.uint64(0xFF)).astype(np.int64), (after_of << 8) | after]).astype(np.uint64)
    out[0] = tallies(place, np.concatenate([np.zeros(len(key), np.int64), after_n]))[:, :, : len(key)]
    for order in range(3, ORDERS + 1):
        out[order - 2] = tallies(key & np.uint64((1 << (8 * order + 8)) - 1), n)
    return out


def inputs(model: Model, key: np.ndarray, bit_at: int, without: bool, deeper: np.ndarray | None = None):
    """Inputs, gate and bit of one bit of every context; ``without`` leaves out one occurrence of it.

    Without ``deeper`` no context beyond the last byte has been seen.
    """
    byte = key & np.uint64(0xFF)
    bit = ((byte >> np.uint64(7 - bit_at)) & np.uint64(1)).astype(np.float32)
    node = (np.uint64(1) << np.uint64(bit_at)) | (byte >> np.uint64(8 - bit_at))
    x = np.empty((len(key), ORDERS + 1), dtype=np.float32)
    x[:, ORDERS] = 0.3
    longest = np.zeros(len(key), dtype=np.int64)
    for order in range(1, ORDERS + 1):
        if order == 1:
            at = slots(key, node)
            zero, one = model.zeros[at], model.ones[at]
        elif deeper is None:
            zero, one = np.zeros((2, len(key)), dtype=np.float32)
        else:
            zero, one = deeper[order - 2, bit_at]
        if without:
            zero, one = np.maximum(zero - (1 - bit), 0), np.maximum(one - bit, 0)
        x[:, order - 1] = np.log((one + PRIOR) / (zero + PRIOR))
        longest[zero + one > 0.5] = order
    return x, longest * 8 + bit_at, bit


def odds(model: Model, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return np.clip(np.einsum("ij,ij->i", x, model.weights[gate]), -20, 20)


def cells(value: np.ndarray) -> np.ndarray:
    return np.clip(((value + REACH) * (CELLS / (2 * REACH))).astype(np.int64), 0, CELLS - 1)


def logistic(value: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-value))


def log2_byte(model: Model, key: np.ndarray, deeper: np.ndarray | None = None) -> np.ndarray:
    """log2 probability of each context's last byte."""
    total = np.zeros(len(key))
    for bit_at in range(8):
        x, gate, bit = inputs(model, key, bit_at, False, deeper)
        mixed = odds(model, x, gate)
        p = 0.5 * logistic(mixed) + 0.5 * logistic(model.refined[gate, cells(mixed)])
        p = np.clip(p, 1 / 65536, 1 - 1 / 65536)
        total += np.log2(np.where(bit > 0, p, 1 - p))
    return total


def _summed(parts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of a task with their counts, added up while no more than HELD distinct ones are at hand."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for keys in parts:
        held.append(np.unique(keys, return_counts=True))
        size += len(held[-1][0])
        if size >= HELD:
            held = [_merged(held)]
            size = len(held[0][0])
            if size >= HELD // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield _merged(held)


def _context_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = (contexts(data, offsets)[0] for batch in batches for _, _, data, offsets in slices(batch.column(0)))
    for key, n in _summed(parts):
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], (np.add.reduceat(counts, starts) if len(keys) else counts).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]):
    """Whole families of up to CHUNK contexts: key, training count, uses, counts of orders 2 and more."""
    for batch in batches:
        lists = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        flat = {name: np.asarray(v.flatten()) for name, v in lists.items()}
        to = np.concatenate([[0], np.cumsum(np.asarray(lists["key"].value_lengths()))]).astype(np.int64)
        after_to = np.concatenate([[0], np.cumsum(np.asarray(lists["after"].value_lengths().fill_null(0)))]).astype(np.int64)
        start, rows = 0, batch.num_rows
        while start < rows:
            end = max(start + 1, int(np.searchsorted(to, to[start] + CHUNK, side="right")) - 1)
            mine, theirs = slice(to[start], to[end]), slice(after_to[start], after_to[end])
            key, n, family = flat["key"][mine].view(np.uint64), flat["n"][mine], np.arange(end - start)
            yield key, n, flat["uses"][mine], deeper_counts(
                key, n, np.repeat(family, np.diff(to[start : end + 1])), flat["after"][theirs], flat["after_n"][theirs],
                np.repeat(family, np.diff(after_to[start : end + 1])),
            )
            start = end


def _trained(batches: Iterator[pa.RecordBatch]):
    """Chunks of the contexts that training documents hold, in an order that mixes families."""
    for key, n, _, deeper in _chunks(batches):
        order = np.argsort(mix(key))
        order = order[n[order] > 0]
        if len(order):
            yield key[order], n[order], deeper[:, :, :, order]


def _weight_pass(sent):
    """Weights after an online pass over a shard, as sums that average over shards by what they have seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        weights, seen = model.weights.copy(), np.zeros(GATES)
        local = Model(model.zeros, model.ones, weights, model.refined)
        for keys, counts, deeper in _trained(batches):
            counts = counts.astype(np.float32)
            bits = [inputs(model, keys, bit_at, True, deeper) for bit_at in range(8)]
            for start in range(0, len(keys), BATCH):
                n = counts[start : start + BATCH]
                for known in bits:
                    x, gate, bit = (v[start : start + BATCH] for v in known)
                    error = n * (bit - logistic(odds(local, x, gate)))
                    mass = np.bincount(gate, weights=n, minlength=GATES)
                    live = mass > 0
                    for column in range(ORDERS + 1):
                        step = np.bincount(gate, weights=error * x[:, column], minlength=GATES)
                        weights[live, column] += RATE * step[live] / mass[live]
                    seen += mass
        gate, column = np.divmod(np.arange(weights.size), ORDERS + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(gate), pa.array(column), pa.array(weights.reshape(-1) * seen[gate]), pa.array(seen[gate])],
            names=["gate", "input", "moved", "seen"],
        )

    return run


def _map_pass(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        held = np.zeros((2, GATES * CELLS))
        for key, n, deeper in _trained(batches):
            for bit_at in range(8):
                x, gate, bit = inputs(model, key, bit_at, True, deeper)
                at = gate * CELLS + cells(odds(model, x, gate))
                held[1] += np.bincount(at, weights=n * bit, minlength=GATES * CELLS)
                held[0] += np.bincount(at, weights=n * (1 - bit), minlength=GATES * CELLS)
        at = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[0, at]), pa.array(held[1, at])], names=["cell", "zeros", "ones"])

    return run


def _value_pass(sent):
    """Every context with its uses and the log2 probability of its last byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, uses, deeper in _chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(uses), pa.array(log2_byte(sent.value, key, deeper))], names=["key", "uses", "log2"]
            )

    return run


def families(counted: DataFrame) -> DataFrame:
    """Contexts (``key, n, uses``) by their last three bytes, with the counts of what follows the last two.

    A family has at most 2^24 contexts and a pair of bytes 256 families, whatever the corpus.
    """
    following = (
        counted.filter("n > 0").groupBy(F.expr("key & 16777215").alias("next")).agg(F.sum("n").alias("n"))
        .groupBy(F.expr("next >> 8").alias("pair")).agg(F.collect_list(F.struct(F.expr("next & 255").alias("after"), "n")).alias("f"))
        .select("pair", F.col("f.after").alias("after"), F.col("f.n").alias("after_n"))
    )
    return (
        counted.groupBy(F.expr("(key >> 8) & 16777215").alias("family")).agg(F.collect_list(F.struct("key", "n", "uses")).alias("c"))
        .withColumn("pair", F.expr("family & 65535")).join(following, "pair", "left")
        .select(F.col("c.key").alias("key"), F.col("c.n").alias("n"), F.col("c.uses").alias("uses"), "after", "after_n")
    )


def _learned(counted: DataFrame, table: DataFrame) -> Model:
    """The model of counted contexts, of which ``table`` has the families."""
    spark = counted.sparkSession
    model = Model(
        np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32), np.full((GATES, ORDERS + 1), 0.3),
        np.tile((np.arange(CELLS) + 0.5) * (2 * REACH / CELLS) - REACH, (GATES, 1)),
    )
    model.weights[:, ORDERS] = 0.0
    rows = counted.filter("n > 0").groupBy(F.expr("key & 65535").alias("key")).agg(F.sum("n").alias("n")).toArrow()
    key, n = rows["key"].to_numpy().astype(np.uint64), rows["n"].to_numpy()
    if len(key):
        found = tallies(key, n)
        for bit_at in range(8):
            at = slots(key, (np.uint64(1) << np.uint64(bit_at)) | ((key & np.uint64(0xFF)) >> np.uint64(8 - bit_at)))
            model.zeros[at], model.ones[at] = found[bit_at]
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)
        moved = (
            table.mapInArrow(_weight_pass(sent), "gate long, input long, moved double, seen double")
            .groupBy("gate", "input").agg(F.sum("moved").alias("moved"), F.sum("seen").alias("seen")).filter("seen > 0").collect()
        )
        for r in moved:
            model.weights[r["gate"], r["input"]] = r["moved"] / r["seen"]
        sent.unpersist()
    sent = spark.sparkContext.broadcast(model)
    cell_rows = (
        table.mapInArrow(_map_pass(sent), "cell long, zeros double, ones double").groupBy("cell")
        .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).collect()
    )
    flat = model.refined.reshape(-1)
    for r in cell_rows:
        start = flat[r["cell"]]  # a thinly filled cell stays near where it started
        p = (r["ones"] + 4 * float(logistic(np.array(start)))) / (r["ones"] + r["zeros"] + 4)
        flat[r["cell"]] = np.log(p / (1 - p))
    sent.unpersist()
    return model


def context_scores(learned: DataFrame, others: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, uses, log2`` of every distinct context of two text columns, of which only the first is learned from."""
    schema = "key long, n long"
    counted = scratch.write(
        learned.mapInArrow(_context_counts, schema).withColumn("uses", F.col("n"))
        .unionAll(others.mapInArrow(_context_counts, schema).select("key", F.lit(0).cast("long").alias("n"), F.col("n").alias("uses")))
        .groupBy("key").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))
    )
    table = scratch.write(families(counted))
    sent = learned.sparkSession.sparkContext.broadcast(_learned(counted, table))
    values = scratch.write(table.mapInArrow(_value_pass(sent), "key long, uses long, log2 double"))
    scratch.drop(counted, table)
    return values


@dataclass
class Held:
    """Scores of the contexts used most: one a slot, the others of the slot in order of key."""

    names: np.ndarray
    memo: np.ndarray
    keys: np.ndarray
    values: np.ndarray


def most_used(values: DataFrame) -> Held:
    """At most KEPT contexts. Those used more than some bound; which are held changes no result."""
    step = F.floor(F.log2(F.col("uses").cast("double")) * 8)
    sizes = sorted(((r["step"], r["n"]) for r in values.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    bound, total = None, 0
    for at, n in sizes:
        total += n
        if total > KEPT:
            break
        bound = at
    names, memo = np.zeros(2 * KEPT, dtype=np.uint64), np.zeros(2 * KEPT, dtype=np.float64)
    names[0] = 1  # no context is kept in a slot it does not hash to
    if bound is None:
        return Held(names, memo, np.zeros(0, np.uint64), np.zeros(0))
    rows = values.filter(step >= bound).toArrow()
    key, log2 = rows["key"].to_numpy().astype(np.uint64), rows["log2"].to_numpy()
    order = np.argsort(rows["uses"].to_numpy(), kind="stable")  # of those that share a slot the most used stays
    key, log2 = key[order], log2[order]
    at = _slot(key, names)
    names[at], memo[at] = key, log2
    rest = np.flatnonzero(names[at] != key)
    rest = rest[np.argsort(key[rest])]
    return Held(names, memo, key[rest], log2[rest])


def _slot(key: np.ndarray, names: np.ndarray) -> np.ndarray:
    return (mix(key) & np.uint64(len(names) - 1)).astype(np.int64)


def _looked_up(held: Held, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of contexts, 0 for those that are not held, and which those are."""
    at = _slot(key, held.names)
    out = held.memo[at]
    miss = np.flatnonzero(held.names[at] != key)
    out[miss] = 0.0
    if len(miss) and len(held.keys):
        place = np.minimum(np.searchsorted(held.keys, key[miss]), len(held.keys) - 1)
        hit = held.keys[place] == key[miss]
        out[miss[hit]] = held.values[place[hit]]
        miss = miss[~hit]
    return out, miss


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = 0

    def parts() -> Iterator[np.ndarray]:
        nonlocal texts
        for batch in batches:
            texts += batch.num_rows
            for _, _, data, offsets in slices(batch.column(0)):
                yield word_hashes(data, offsets)[0]

    for key, n in _summed(parts()):
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["token", "n"])
    yield pa.RecordBatch.from_arrays([pa.array([END_TOKEN], pa.int64()), pa.array([texts], pa.int64())], names=["token", "n"])


SCORED = (
    "row long, doc_id long, n_tokens long, known long, base double, log2 double, n_bytes long, rare array<long>, times array<long>, "
    "far array<long>, far_times array<long>"
)


def _listed(value: np.ndarray, owner: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
    """Distinct values of every row and how often each occurs in it."""
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    begins = np.flatnonzero(fresh)
    times = np.diff(np.append(begins, len(value)))
    cut = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[begins], minlength=rows))]), pa.int32())
    return pa.ListArray.from_arrays(cut, pa.array(value[begins])), pa.ListArray.from_arrays(cut, pa.array(times))


def _scorer(sent, head):
    """Per row: the parts of both scores that contexts and tokens at hand give, and the other tokens and contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Held = sent.value
        tokens, counts = head.value
        value = np.log10(counts + 1.0)
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start, end, data, offsets in slices(batch.column(1)):
                rows = end - start
                key, bounds = contexts(data, offsets)
                found, miss = _looked_up(held, key)
                log2 = np.add.reduceat(found, bounds[:-1])
                far = _listed(key[miss].view(np.int64), np.searchsorted(bounds, miss, side="right") - 1, rows)
                words, first = word_hashes(data, offsets)
                owner = np.repeat(np.arange(rows), np.diff(first))
                token = np.concatenate([words.view(np.int64), np.full(rows, END_TOKEN)])
                owner = np.concatenate([owner, np.arange(rows)])
                at = np.minimum(np.searchsorted(tokens, token), max(len(tokens) - 1, 0))
                hit = tokens[at] == token if len(tokens) else np.zeros(len(token), bool)
                base = np.bincount(owner[hit], weights=value[at[hit]], minlength=rows).astype(np.float64)
                known = np.bincount(owner[hit], minlength=rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row_id + np.arange(rows)), batch.column(0).slice(start, rows), pa.array(np.diff(first) + 1),
                        pa.array(known), pa.array(base), pa.array(log2), pa.array(np.diff(offsets)),
                        *_listed(token[~hit], owner[~hit], rows), *far,
                    ],
                    names=[f.split()[0] for f in SCORED.split(", ")],
                )
                row_id += rows

    return run


def _remembered(model: Model, key: np.ndarray, names: np.ndarray, memo: np.ndarray) -> np.ndarray:
    """``log2_byte`` of every context, worked out once for those a fixed-size memo holds."""
    at = (mix(key) & np.uint64(MEMO - 1)).astype(np.int64)
    out = memo[at]
    miss = np.flatnonzero(names[at] != key)
    if len(miss):
        fresh, back = np.unique(key[miss], return_inverse=True)
        value = np.concatenate([log2_byte(model, fresh[i : i + (1 << 16)]) for i in range(0, len(fresh), 1 << 16)])
        out[miss] = value[back]
        place = (mix(fresh) & np.uint64(MEMO - 1)).astype(np.int64)
        # of those that share a slot the last stays, name and value alike
        place, last = np.unique(place[::-1], return_index=True)
        names[place], memo[place] = fresh[::-1][last], value[::-1][last]
    return out


def scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte`` of every row.

    ``training`` says which rows are learned from. A null text is empty: one end token, and a score for
    the closing byte alone. Repeated ids give a row each, a null id stays null and trains only if ``training`` holds. Without
    training rows all counts are 0. Only the two columns are read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    learned = docs.filter(training).select(F.col(text_col).alias("text"))
    with Scratch(spark) as scratch:
        vocabulary = scratch.write(learned.mapInArrow(_token_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
        size = vocabulary.filter("n > 0").agg(F.sum("n"), F.count("*")).first()
        total, distinct = size[0] or 0, size[1]
        rows = vocabulary.filter("n > 0").orderBy(F.desc("n"), "token").limit(HEAD).toArrow()
        order = np.argsort(rows["token"].to_numpy())
        head = spark.sparkContext.broadcast((rows["token"].to_numpy()[order], rows["n"].to_numpy()[order].astype(np.float64)))
        others = docs.filter(~F.coalesce(training, F.lit(False))).select(F.col(text_col).alias("text"))
        values = context_scores(learned, others, scratch)
        sent = spark.sparkContext.broadcast(most_used(values))
        scored = scratch.write(base.mapInArrow(_scorer(sent, head), SCORED))
        rare = (
            scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r"))
            .select("row", F.col("r.rare").alias("token"), F.col("r.times").alias("times"))
            .join(vocabulary, "token")
            .groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_base"))
        )
        far = (
            scored.select("row", F.explode(F.arrays_zip("far", "far_times")).alias("r"))
            .select("row", F.col("r.far").alias("key"), F.col("r.far_times").alias("times"))
            .join(values, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("log2")).alias("far_log2"))
        )
        log2 = F.col("log2") + F.coalesce("far_log2", F.lit(0.0))
        floor = float(np.log10(total + distinct + 1.0))
        out = scored.drop("rare", "times", "far", "far_times").join(rare, "row", "left").join(far, "row", "left").select(
            "doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
            (log2 * F.lit(float(np.log10(2.0)))).alias("score"), "n_bytes",
            (-log2 / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
        )
        return scratch.write(out, keep=True)


@query("op5_context_mixing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32 remainder is not 2."""
    docs = table(spark, folder, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = scores(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), *[c for c in out.columns if c != "doc_id"])
