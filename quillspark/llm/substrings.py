"""Substring deduplication over content-defined chunks.

Texts are cut where a gear rolling hash says so, which resists shifts: after an insertion the same cuts
come back. Chunks are deduplicated by digest, the first occurrence in (document, place) order staying.
A repeated chunk whose neighbour is another than in the first occurrence is compared with that beyond its
edge, byte by byte, as far as both agree: cuts need not meet where a passage starts or ends. What is extended,
in both documents, joins to runs; runs of MIN_BYTES or more are reported, so that chance repeats of a few
words are left alone. Neighbours are told apart by 32 bits of their digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillspark.llm.chunking import chunk_ends
from quillspark.llm.common import SPACES, query, slices, table
from quillspark.llm.idfilter import build_filter, passes
from quillspark.llm.scratch import Scratch

BITS, LEAST, MOST = 4, 16, 96
MIN_BYTES = 120
WINDOW = 256  # bytes beyond an edge that are compared at first; edges that agree over all of them get more
CHUNK = "digest long, check long, doc_id long, start long, length long, chars long, chars_before long, prev int, next int"


def _chunks(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    """Chunks of a batch of (doc_id, text), as columns; a digest is 128 bits in two numbers."""
    ids = np.asarray(batch.column(0))
    for first, _, data, offsets in slices(batch.column(1)):
        ends = chunk_ends(data, offsets, BITS, LEAST, MOST)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
        row = np.searchsorted(offsets, starts, side="right") - 1
        raw = data.tobytes()
        digest = np.frombuffer(
            b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), dtype=np.int64
        ).reshape(-1, 2)
        opened = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        name = digest[:, 1].astype(np.int32) | np.int32(1)  # 0: no neighbour
        prev, following = np.zeros((2, len(name)), dtype=np.int32)
        same = np.flatnonzero(row[1:] == row[:-1])
        prev[same + 1], following[same] = name[same], name[same + 1]
        yield {
            "digest": digest[:, 0], "check": digest[:, 1], "doc_id": ids[first:][row], "start": starts - offsets[row],
            "length": ends - starts, "chars": opened[ends] - opened[starts],
            "chars_before": opened[starts] - opened[offsets[row]], "prev": prev, "next": following,
        }


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks by digest with their number and first and last place; equal ones of a slice are one row already."""
    for batch in batches:
        for c in _chunks(batch):
            order = np.lexsort((c["start"], c["doc_id"], c["check"], c["digest"]))
            digest, check = c["digest"][order], c["check"][order]
            head = np.ones(len(order), dtype=bool)
            head[1:] = (digest[1:] != digest[:-1]) | (check[1:] != check[:-1])
            at = np.flatnonzero(head)
            count = np.diff(np.append(at, len(order)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(digest[at]), pa.array(check[at]), pa.array(count), pa.array(c["doc_id"][order][at]),
                    pa.array(c["start"][order][at]), pa.array(c["prev"][order][at]), pa.array(c["next"][order][at]),
                ],
                names=["digest", "check", "n", "doc_id", "start", "prev", "next"],
            )


def _edges(width: int):
    """Per document and its wanted places ``lo, hi``: what is between them as a digest, and up to ``width`` bytes around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py().encode()
                opened = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                at = [(w["lo"], w["hi"], w["l"], w["r"]) for w in batch.column(2)[i].as_py() if w["hi"] <= len(raw)]
                lo, hi = [w[0] for w in at], [w[1] for w in at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * len(at), pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()),
                        pa.array([xxhash.xxh3_64_intdigest(raw[a:b]) >> 1 for a, b, _, _ in at], pa.int64()),
                        pa.array(opened[lo].astype(np.int64) if at else [], pa.int64()),
                        pa.array(opened[hi].astype(np.int64) if at else [], pa.int64()),
                        pa.array([raw[max(0, a - width) : a] if l else b"" for a, _, l, _ in at], pa.binary()),
                        pa.array([raw[b : b + width] if r else b"" for _, b, _, r in at], pa.binary()),
                    ],
                    names=["doc_id", "lo", "hi", "core", "c_lo", "c_hi", "before", "behind"],
                )

    return run


def agreeing(one: bytes, two: bytes) -> int:
    """Length of the common start of two byte strings."""
    n = min(len(one), len(two))
    if one[:n] == two[:n]:
        return n
    return int(np.argmax(np.frombuffer(one, np.uint8, n) != np.frombuffer(two, np.uint8, n)))


def extension(one: tuple[bytes, bytes], two: tuple[bytes, bytes]) -> tuple[int, int, bytes, bytes]:
    """Bytes that agree before and behind a core, and of them those to report: whole characters, no outer white space."""
    left, right = agreeing(one[0][::-1], two[0][::-1]), agreeing(one[1], two[1])
    head, tail = one[0][len(one[0]) - left :], one[1][:right]
    while head and (head[0] & 0xC0 == 0x80 or SPACES[head[0]]):
        head = head[1:]
    tail = tail.decode("utf-8", "ignore").encode()
    while tail and SPACES[tail[-1]]:
        tail = tail[:-1]
    return left, right, head, tail


def _extended(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                extension((a if l else b"", b if r else b""), (c, d))
                for a, b, c, d, l, r in zip(*(batch.column(k).to_pylist() for k in ("before", "behind", "f_before", "f_behind", "l", "r")))
            ]
            chars = lambda part: sum(byte & 0xC0 != 0x80 for byte in part)
            columns = [batch.column(k) for k in ("doc_id", "lo", "hi", "f_doc", "f_lo", "f_hi", "l", "r", "c_lo", "c_hi", "f_c_lo", "f_c_hi")]
            columns += [pa.array([len(f[2]) for f in found], pa.int64()), pa.array([len(f[3]) for f in found], pa.int64())]
            columns += [pa.array([chars(f[2]) for f in found], pa.int64()), pa.array([chars(f[3]) for f in found], pa.int64())]
            columns.append(pa.array([max(f[:2]) >= width for f in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=EXTENDED.replace(" long", "").replace(" boolean", "").split(", "))

    return run


EXTENDED = (
    "doc_id long, lo long, hi long, f_doc long, f_lo long, f_hi long, l boolean, r boolean, c_lo long, c_hi long, f_c_lo long, f_c_hi long, "
    "left long, right long, c_left long, c_right long, more boolean"
)


def _open_edges(held: DataFrame) -> DataFrame:
    """Repeated chunks and their first occurrences where these have other neighbours; ``l``, ``r``: on which side."""
    side = lambda k: ((F.col(k) != F.col(f"first.{k}")) & (F.col(k) != 0) & (F.col(f"first.{k}") != 0))
    return held.select(
        "doc_id", F.col("start").alias("lo"), F.expr("start + length").alias("hi"), F.col("first.doc_id").alias("f_doc"),
        F.col("first.start").alias("f_lo"), F.expr("first.start + length").alias("f_hi"), side("prev").alias("l"), side("next").alias("r"),
    ).filter("(l or r) and (f_doc != doc_id or f_lo != lo)").distinct()


def _widened(base: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, lo, hi, c_lo, c_hi`` of chunks and their first occurrences, as far as both agree, in bytes and code points."""
    theirs, parts, width = ["f_doc", "f_lo", "f_hi"], [], WINDOW
    while True:
        wanted = pairs.select("doc_id", "lo", "hi", "l", "r").unionAll(pairs.select(*theirs, "l", "r"))
        lists = (
            wanted.groupBy("doc_id", "lo", "hi").agg(F.max("l").alias("l"), F.max("r").alias("r"))
            .groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "l", "r")).alias("wanted"))
        )
        edges = scratch.write(
            base.filter("text is not null").join(lists, "doc_id").select("doc_id", "text", "wanted").mapInArrow(
                _edges(width),
                "doc_id long, lo long, hi long, core long, c_lo long, c_hi long, before binary, behind binary",
            )
        )
        first = edges.select(
            F.col("doc_id").alias("f_doc"), F.col("lo").alias("f_lo"), F.col("hi").alias("f_hi"), "core",
            *[F.col(k).alias(f"f_{k}") for k in ("c_lo", "c_hi", "before", "behind")],
        )
        found = scratch.write(
            pairs.join(edges, ["doc_id", "lo", "hi"]).join(first, [*theirs, "core"]).mapInArrow(_extended(width), EXTENDED)
        )
        scratch.drop(edges)
        parts.append(found.filter("not more"))
        open_ones = found.filter("more").select("doc_id", "lo", "hi", *theirs, "l", "r").distinct()
        if open_ones.isEmpty():
            break
        pairs, width = scratch.write(open_ones), width * 8
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    sides = whole.select("doc_id", "lo", "hi", "c_lo", "c_hi", "left", "right", "c_left", "c_right").unionAll(
        whole.select("f_doc", "f_lo", "f_hi", "f_c_lo", "f_c_hi", "left", "right", "c_left", "c_right")
    )
    wide = sides.groupBy("doc_id", "lo", "hi", "c_lo", "c_hi").agg(*[F.max(k).alias(k) for k in ("left", "right", "c_left", "c_right")])
    return wide.select(
        "doc_id", F.expr("lo - left").alias("lo"), F.expr("hi + right").alias("hi"), F.expr("c_lo - c_left").alias("c_lo"),
        F.expr("c_hi + c_right").alias("c_hi"),
    )


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans that occur more than once: one row per run of repeated chunks, extended as far as the first occurrence agrees.

    ``doc_id, start, n_chars`` in code points, ``n_bytes``, ``n_chunks``, ``n_first`` (chunks of the run
    that are the first of their digest and stay), ``first_doc`` (smallest document that holds a chunk of
    the run first) and ``n_copies`` (most occurrences of one chunk). Null and empty texts have no chunks,
    rows with a null id are left out, repeated ids are one document's chunks. Only the two columns are read.
    """
    base = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        first = F.min(F.struct("doc_id", "start", "prev", "next"))
        repeated = scratch.write(
            base.mapInArrow(_digests, "digest long, check long, n long, doc_id long, start long, prev int, next int")
            .groupBy("digest", "check").agg(F.sum("n").alias("copies"), first.alias("first")).filter("copies > 1")
        )
        wanted = docs.sparkSession.sparkContext.broadcast(build_filter(repeated.select("digest")))

        def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c in _chunks(batch):
                    keep = passes(wanted.value, c["digest"])
                    yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in c.values()], names=list(c))

        held = scratch.write(base.mapInArrow(occurrences, CHUNK).join(repeated, ["digest", "check"]).drop("digest", "check", "n"))
        wide = _widened(base, scratch.write(_open_edges(held)), scratch)
        chunks = held.select(
            "doc_id", F.col("start").alias("lo"), F.expr("start + length").alias("hi"), F.col("chars_before").alias("c_lo"),
            F.expr("chars_before + chars").alias("c_hi"), F.lit(1).alias("chunk"),
            F.expr("int(first.doc_id = doc_id and first.start = start)").alias("is_first"), F.col("first.doc_id").alias("first_doc"), "copies",
        )
        none = {"chunk": F.lit(0), "is_first": F.lit(0), "first_doc": F.lit(None).cast("long"), "copies": F.lit(None).cast("long")}
        # a span opens a run when none before it reaches its start
        along = Window.partitionBy("doc_id").orderBy("lo", "hi")
        reach = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
        runs = (
            chunks.unionByName(wide.withColumns(none)).withColumn("_gap", F.when(reach >= F.col("lo"), 0).otherwise(1))
            .withColumn("run", F.sum("_gap").over(along.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("doc_id", "run").agg(
                F.min("c_lo").alias("start"), (F.max("c_hi") - F.min("c_lo")).alias("n_chars"),
                (F.max("hi") - F.min("lo")).alias("n_bytes"), F.sum("chunk").alias("n_chunks"), F.sum("is_first").alias("n_first"),
                F.min("first_doc").alias("first_doc"), F.max("copies").alias("n_copies"),
            )
            .filter(F.col("n_bytes") >= min_bytes).drop("run")
        )
        return scratch.write(runs, keep=True)


@query("op2_chunk_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated passages of all documents."""
    return repeated_spans(table(spark, folder, "documents"))
