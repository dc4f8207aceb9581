"""Large JSON documents, an array or an object holding one, read by byte range: one file is many tasks.

Spark's text reader cuts a file into blocks and gives its text piece by piece, each up to a closing brace, so
a piece never ends between a key and its array. Where a block stands in the document follows from the
blocks before it. Three scans, of which the first two pass on a row per block: quotes and brackets of each
block give whether it starts inside a string and how deep; then the elements it ends and the array it
leaves open are counted; then elements are cut out. Only an element that crosses a block's edge is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillspark.session import materialise

ESCAPED = re.compile(r"\\.", re.DOTALL)
REST = re.compile(r'(?:[^"\\]|\\.)*+("?)', re.DOTALL)
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+("?)|[\[\]{},]', re.DOTALL)
PLACE = ["source_path", "block"]
PLACE_FIELDS = "source_path string, block long"
SLICE_ROWS = 256  # rows of a batch that are Python objects at once
MOST_BLOCKS = 2_000_000  # rows of the block table that is sent to the tasks: 250 TB of blocks of 128 MB


def text_pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Texts up to and without a closing brace, in the order of the file within each block."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of texts in parts of a few rows: as Python objects a whole batch takes several times its bytes."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def per_block(run: Callable[[tuple, Iterator[str]], Iterator[tuple]], schema: str, kinds: list[pa.DataType]):
    """``run(place and state, pieces)`` for the rows of each block; yields its rows in Arrow batches."""
    names = [f.split()[0] for f in schema.split(", ")]

    def rows(batches):
        for batch in slices(batches):
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            at = batch.schema.get_field_index("value")
            values = columns.pop(at)
            for state, value in zip(zip(*columns), values):
                yield state, value + "}"

    def table(out):
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def work(batches):
        out, size = [], 0
        for state, group in groupby(rows(batches), key=lambda r: r[0]):
            for row in run(state, (value for _, value in group)):
                out.append(row)
                size += sum(len(x) for x in row if isinstance(x, str))
                if size > 1 << 20:
                    yield table(out)
                    out, size = [], 0
        if out:
            yield table(out)

    return work


def summary(state: tuple, pieces: Iterator[str]) -> Iterator[tuple]:
    """Quotes of a block and how many levels it opens, for a block that starts outside or inside a string.

    A backslash always takes the next character with it, so the number of quotes is the same for both.
    """
    quotes, levels, root = 0, [0, 0], None
    for piece in pieces:
        if root is None and not piece.isspace():
            root = piece.lstrip("﻿ \t\r\n")[:1] or None
        parts = ESCAPED.sub("", piece).split('"')
        for start in (0, 1):
            text = "".join(parts[(start + quotes) % 2 :: 2])
            levels[start] += text.count("{") + text.count("[") - text.count("}") - text.count("]")
        quotes += len(parts) - 1
    yield (*state, quotes % 2, *levels, root)


class Cutter:
    """Walks a block's pieces and takes the stretches between separators of the wanted array."""

    def __init__(self, key: str, inside: bool, depth: int, root: str, owned: bool | None):
        self.inside, self.depth, self.owned = inside, depth, owned
        self.level = 1 if root == "[" else 2
        self.key = key
        self.named = False  # the last string directly in the document's object is the key

    def walk(self, pieces: Iterator[str], keep: bool) -> Iterator[tuple[str, str]]:
        """``end`` of an element, ``open`` or ``leave`` of an array, and the ``rest`` after the last of them, with texts."""
        parts: list[str] = []
        for piece in pieces:
            begin = at = 0
            if self.inside:
                found = REST.match(piece)
                at, self.inside = found.end(), not found.group(1)
            for token in TOKEN.finditer(piece, at):
                sign = piece[token.start()]
                event = None
                if sign == '"':
                    self.inside = not token.group(1)
                    if self.depth == 1 and not self.inside:
                        self.named = self.is_key(token.group())
                elif sign in "[{":
                    self.depth += 1
                    if self.depth == self.level:
                        event = "open" if sign == "[" and (self.level == 1 or self.named) else "other"
                elif sign == ",":
                    event = "end" if self.depth == self.level else None
                else:
                    event = "leave" if self.depth == self.level else None
                    self.depth -= 1
                if event:
                    if keep and self.owned:
                        parts.append(piece[begin : token.start()])
                    yield event, "".join(parts)
                    parts, begin = [], token.end()
                    if event != "end":
                        self.owned = event == "open"
            if keep and self.owned:
                parts.append(piece[begin:])
        yield "rest", "".join(parts)

    def is_key(self, text: str) -> bool:
        return len(text) <= 6 * len(self.key) + 2 and json.loads(text, strict=False) == self.key


def elements(spark: SparkSession, path: str | list[str], key: str, required: bool = True) -> DataFrame:
    """``source_path, pos, value``: every element's text, ``pos`` rising from 0 with its place in its document.

    A document that is no array and no object with an array ``key``, one that does not end, and one that goes on after
    its end stop the job; of an object, a missing last brace is not noticed. An empty file has no elements. Unless
    ``required``, an object without the key has none either.
    """
    pieces = text_pieces(spark, path)
    sums = pieces.mapInArrow(
        per_block(summary, f"{PLACE_FIELDS}, quotes int, outside long, inside long, root string",
                  [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]),
        f"{PLACE_FIELDS}, quotes int, outside long, inside long, root string",
    )
    # one row per block of a file
    upto = Window.partitionBy("source_path").orderBy("block")
    before, whole = upto.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source_path")
    opened = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    entries = materialise(
        sums.withColumn("in_string", opened)
        .withColumn("levels", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
        .withColumn("depth", F.coalesce(F.sum("levels").over(before), F.lit(0)).cast("int"))
        .withColumn("root", F.first("root", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("odd", F.sum("quotes").over(whole) % 2 == 1)
        # the brace put after the last piece is one too many unless the document ended with it
        .withColumn("over", F.sum("levels").over(whole))
        .select(*PLACE, "in_string", "depth", "root", "odd", "over")
    )
    if entries.count() > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} blocks: raise spark.sql.files.maxPartitionBytes or read fewer files at once")

    def count(state: tuple, texts: Iterator[str]) -> Iterator[tuple]:
        place, (inside, depth, root) = state[:2], state[2:]
        cutter = Cutter(key, inside, depth, root, None)
        carried = own = opens = 0
        owned = None  # not known before the block opens or leaves an array
        for event, _ in cutter.walk(texts, keep=False):
            carried += event in ("end", "leave") and owned is None
            own += event in ("end", "leave") and owned is True
            opens += event == "open"
            owned = cutter.owned if event in ("rest", "end") else event == "open"
        yield (*place, carried, own, owned, opens > 0)

    state = entries.select(*PLACE, "in_string", "depth", "root")
    counted = pieces.join(F.broadcast(state), PLACE).select(*PLACE, "in_string", "depth", "root", "value").mapInArrow(
        per_block(count, f"{PLACE_FIELDS}, carried long, own long, owned boolean, opens boolean", [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]),
        f"{PLACE_FIELDS}, carried long, own long, owned boolean, opens boolean",
    )
    fits = F.max(F.col("opens")).over(whole)
    wrong = (
        (F.col("root").isNotNull() & ~F.coalesce(F.col("root").isin("[", "{"), F.lit(False)))
        | F.col("odd") | ~F.when(F.col("root") == "[", F.col("over") == -1).otherwise(F.col("over").isin(0, -1))
        | (F.lit(required) & F.col("root").isNotNull() & ~F.coalesce(fits, F.lit(False)))
    )
    held = F.coalesce(F.last("owned", ignorenulls=True).over(before), F.lit(False))
    placed = (
        entries.join(counted, PLACE)
        .withColumn("held", held)
        .withColumn("ends", F.when(F.col("held"), F.col("carried")).otherwise(0) + F.col("own"))
        .withColumn("base", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .withColumn("held", F.when(wrong, F.raise_error(F.lit(f"expected an array or an object with '{key}'")).cast("boolean")).otherwise(F.col("held")))
        .select(*PLACE, "in_string", "depth", "root", "held", "base")
    )

    def cut(state: tuple, texts: Iterator[str]) -> Iterator[tuple]:
        path, block, inside, depth, root, held, pos = state
        cutter = Cutter(key, inside, depth, root, held)
        split = held  # what the block starts with began in an earlier one
        owned = held
        for event, text in cutter.walk(texts, keep=True):
            if owned:
                yield path, pos, block, split or event == "rest", text
            if event in ("end", "leave") and owned:
                pos += 1
            split = False
            owned = event == "open" if event in ("open", "leave", "other") else owned

    fields = "source_path string, pos long, block long, split boolean, value string"
    found = pieces.join(F.broadcast(materialise(placed)), PLACE).select(*PLACE, "in_string", "depth", "root", "held", "base", "value").mapInArrow(
        per_block(cut, fields, [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]), fields
    )
    parts = F.array_sort(F.collect_list(F.struct("block", "value")))
    glued = found.filter("split").groupBy("source_path", "pos").agg(
        F.concat_ws("", F.transform(parts, lambda p: p["value"])).alias("value")
    )
    whole_ones = found.filter(~F.col("split")).select("source_path", "pos", "value")
    return whole_ones.unionByName(glued).filter(F.trim(F.translate("value", "\t\r\n", "   ")) != "")


def write_documents(df: DataFrame, path: str, key: str | None = None) -> None:
    """Rows as JSON documents, one per task and without gathering: arrays, or objects that hold one under ``key``."""
    before, after = ("[", "]") if key is None else (f'{{{json.dumps(key)}: [', "]}")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
        for batch in slices(batches):
            rows = batch.column(0).to_pylist()
            yield make([(before if first and not i else ",") + row for i, row in enumerate(rows)])
            first = False
        yield make([before + after if first else after])

    df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(lines, "value string").write.mode("overwrite").text(path)
