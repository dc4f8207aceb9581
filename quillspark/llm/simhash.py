"""Near-duplicates by SimHash, with tables of distances to pivots ahead of every comparison.

1. A document's fingerprint has a bit where over half of its word shingles' hashes have it. Documents
   with equal fingerprints are one from here on.
2. Pivots are reference fingerprints, taken from the corpus. Every distinct fingerprint gets its row of
   the distance table: its Hamming distances to all pivots. Two fingerprints cannot be nearer than
   their greatest difference in any coordinate of that table.
3. Fingerprints meet in blocks: if at most ``most`` of four quarters differ, two quarters agree, so pairs
   share one of six keys of 32 bits. A block with many members is cut again by the bits that are still
   free, which loses no pair either, until none is large. Inside a block members lie in the order of
   the first coordinate and only neighbours within ``most`` are met; pairs whose coordinates differ by
   more are discarded, and the survivors are verified on the fingerprints.
4. A block passes on one link per member, to the smallest it is connected with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import LOWER, SPACES, query, slices, table, word_bounds
from quillspark.llm.components import components
from quillspark.llm.scratch import Scratch

WIDTH, SEED, MOST = 3, 42, 2
PIVOTS = 32
CROWD = 4096  # members of a block that is not cut any further
FEW_BITS = 12  # free bits with which a block cannot hold more
AT_ONCE = 1 << 16  # shingles hashed at a time
WHOLE = (1 << 64) - 1


def fingerprint(words: bytes, starts: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> int:
    """SimHash of one text; its words, one space apart, lie at ``starts`` and ``ends`` of ``words``."""
    n = len(starts)
    if n == 0:
        return 0
    if n < width:
        return xxhash.xxh64_intdigest(words[starts[0] : ends[-1]], SEED)
    first, last = starts[: n - width + 1], ends[width - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), AT_ONCE):
        places = zip(first[at : at + AT_ONCE].tolist(), last[at : at + AT_ONCE].tolist())
        hashes = np.array([digest(words[a:b], SEED) for a, b in places], dtype=np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first), bitorder="little").tobytes(), "little")


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a slice, lowered and each followed by one space: bytes, starts, ends, first word of each row."""
    starts, ends = word_bounds(data, offsets)
    sizes = ends - starts
    after = np.cumsum(sizes + 1)
    begin = after - sizes - 1
    kept = LOWER[data[~SPACES[data]]]
    out = np.full(int(after[-1]) if len(after) else 0, 0x20, dtype=np.uint8)
    out[np.arange(len(kept)) + np.repeat(np.arange(len(sizes)), sizes)] = kept
    return out.tobytes(), begin, begin + sizes, np.searchsorted(starts, offsets)


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in slices(batch.column(1)):
                words, begin, finish, first = _spaced(data, offsets)
                found = [fingerprint(words, begin[a:b], finish[a:b], width) for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(np.array(found, dtype=np.uint64).view(np.int64))],
                    names=["doc_id", "fp"],
                )

    return run


def fingerprints(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: 64 bits as a long. Null and blank texts have 0, texts under ``width`` words one shingle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(width), "doc_id long, fp long")


def quarters(mask: int, pieces: int) -> list[int]:
    """The bits of ``mask`` in consecutive pieces of nearly equal size, as masks."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in part) for part in (bits[len(bits) * i // pieces : len(bits) * (i + 1) // pieces] for i in range(pieces))]


def key_masks(fixed: int, most: int) -> list[int]:
    """Masks of which two fingerprints that agree in ``fixed`` and differ in at most ``most`` bits agree in one.

    At first two of ``most + 2`` pieces, later one of ``most + 1`` pieces of the bits still free.
    """
    free = quarters(WHOLE & ~fixed, most + 2 if fixed == 0 else most + 1)
    if fixed:
        return [fixed | p for p in free]
    return [a | b for i, a in enumerate(free) for b in free[i + 1 :]]


def pivot_distances(values: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The rows of the distance table: Hamming distances to every pivot."""
    return np.bitwise_count(values.view(np.uint64)[:, None] ^ pivots.view(np.uint64)[None, :]).astype(np.uint8)


def block_pairs(key: np.ndarray, near: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Linked pairs of rows with equal keys, and how many pairs were met and survived the table.

    Rows come sorted by key and by the first column of ``near``, their rows of the distance table.
    """
    first = near[:, 0].astype(np.int16)
    live, step, met, survived = np.arange(len(key)), 0, 0, 0
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        step += 1
        live = live[live + step < len(key)]
        live = live[(key[live] == key[live + step]) & (first[live + step] - first[live] <= most)]
        if not len(live):
            return np.concatenate(left), np.concatenate(right), (met, survived)
        met += len(live)
        kept = live
        for at in range(0, near.shape[1], 8):  # most pairs go with the first coordinates
            gap = np.abs(near[kept, at : at + 8].astype(np.int16) - near[kept + step, at : at + 8])
            kept = kept[gap.max(axis=1) <= most]
        survived += len(kept)
        hit = kept[np.bitwise_count(values[kept].view(np.uint64) ^ values[kept + step].view(np.uint64)) <= most]
        left.append(hit)
        right.append(hit + step)


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row each row is connected with."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, a, least)
        np.minimum.at(fresh, b, least)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def _linker(most: int):
    """Links inside blocks. Rows come sorted by mask, key and first coordinate; a block may span batches."""

    def links(held: pa.Table) -> pa.RecordBatch:
        mask, value, rep = (held[c].to_numpy() for c in ("mask", "key", "rep"))
        block = np.cumsum(np.concatenate([[0], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]))
        lists = held["near"].combine_chunks()
        near = np.asarray(lists.flatten()).reshape(len(lists), -1).astype(np.uint8)
        a, b, _ = block_pairs(block, near, held["fp"].to_numpy(), most)
        label = _stars(len(block), a, b)
        at = np.flatnonzero(label != np.arange(len(block)))
        return pa.RecordBatch.from_arrays([pa.array(rep[label[at]]), pa.array(rep[at])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            held = pa.Table.from_batches([batch])
            held = held if rest is None else pa.concat_tables([rest, held])
            mask, key = held["mask"].to_numpy(), held["key"].to_numpy()
            cut = len(held) - int(((mask == mask[-1]) & (key == key[-1])).sum()) if len(held) else 0
            rest = held.slice(cut)
            if cut:
                yield links(held.slice(0, cut))
        if rest is not None and len(rest):
            yield links(rest)

    return run


def _long(value: int) -> int:
    """Unsigned 64 bits as a long."""
    return value - (1 << 64) if value >> 63 else value


def near_duplicates(
    docs: DataFrame, most: int = MOST, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; fingerprints at ``most`` or fewer differing bits link.

    A component is named by the smallest id that links lead to. Null and blank texts have fingerprint 0
    and link like any other. Rows that repeat an id give a row each and count as one document, which
    links whatever its texts link with. A row with a null id keeps its fingerprint, links nothing, and its
    component is null. Only the two named columns are read. No documents give no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        facts = scratch.write(fingerprints(docs, width, id_col, text_col))
        classes = facts.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
        # the pivots: as many fingerprints as there are coordinates, by a hash of theirs
        pivots = np.array([r["fp"] for r in classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(PIVOTS).collect()], dtype=np.int64)

        def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = pivot_distances(np.asarray(batch.column(0)), pivots).astype(np.int8)
                offsets = pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(near.reshape(-1)))], names=["fp", "rep", "near"]
                )

        known = scratch.write(classes.mapInArrow(distances, "fp long, rep long, near array<byte>"))
        level, found = known.withColumn("mask", F.lit(0).cast("long")), []
        masks = [0]
        while masks:
            # every member of a block of the level before, by the keys that cut it again
            cuts = {m: key_masks(m & WHOLE, most) for m in masks}
            pairs = F.create_map(*[x for m, c in cuts.items() for x in (F.lit(_long(m)), F.array(*[F.lit(_long(k)) for k in c]))])
            dealt = level.select("fp", "rep", "near", F.explode(pairs[F.col("mask")]).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
            crowded = (F.col("n") > CROWD) & (F.bit_count("mask") < 64 - FEW_BITS)
            large = scratch.write(dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(crowded).drop("n"))
            masks = [r["mask"] & WHOLE for r in large.select("mask").distinct().collect()]  # of a fixed set
            small = dealt.join(large, ["mask", "key"], "left_anti") if masks else dealt
            found.append(scratch.write(
                small.repartition("mask", "key").sortWithinPartitions("mask", "key", F.col("near")[0]).mapInArrow(_linker(most), "a long, b long")
            ))
            if masks:
                level = scratch.write(dealt.join(large, ["mask", "key"], "left_semi").drop("key"))
        # an id whose texts have several fingerprints ties these together
        rows = scratch.write(facts.join(known.select("fp", "rep"), "fp", "left").select("doc_id", "fp", "rep"))
        ids = rows.filter("doc_id is not null")
        several = ids.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_z")).filter("a < _z").drop("_z")
        edges = ids.join(several, "doc_id").select("a", F.col("rep").alias("b"))
        for part in found:
            edges = edges.unionByName(part)
        groups = components(edges, scratch)
        return scratch.write(
            rows.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
                "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id")
            ),
            keep=True,
        )


@query("op12_simhash_pivots")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and the components of those at two or fewer differing bits."""
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
