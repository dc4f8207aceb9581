"""How far the sources of a language lie apart in their words, exactly, from sparse count vectors.

1. Tasks turn each document into its sparse count vector, the terms numbered inside a slice of texts,
   and add the vectors of equal (language, source) up before anything is shuffled. A sum carries its
   occurrences and its documents per term.
2. The vocabulary of a language is what a count vectorizer fitted on its documents keeps: every term
   in at least ``min_docs`` of them, however many these are. It stays a table: neither the driver nor a
   task holds it whole. Terms outside it leave the sums, which is the same as leaving the vectors.
3. Smoothed shares are whole numbers. Pairs of sources are evaluated in blocks of terms by blocks of
   sources, from the terms that occur; those that occur in neither differ by the same amount each, so
   their number is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillspark.llm.common import LOWER, query, slices, table, word_bounds
from quillspark.llm.scratch import Scratch

MIN_DOCS, SMOOTHING, SCALE, MOST_TERMS = 30, 5, 1_000_000_000, 50
BLOCK_TERMS, BLOCK_SOURCES = 256, 64  # expected size of a block of terms and of sources
OUTSIDE = np.ones(256, dtype=bool)  # bytes of no term: ASCII other than letters
OUTSIDE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def count_vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Sparse vectors of a slice of texts: row, term number and count of every entry, and the terms.

    A term is a run of ASCII letters and non-ASCII characters with A-Z lowered.
    """
    starts, ends = word_bounds(data, offsets, OUTSIDE)
    packed = LOWER[data[~OUTSIDE[data]]]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(packed)).dictionary_encode()
    terms, number = words.dictionary, np.asarray(words.indices).astype(np.int64)
    row = np.searchsorted(offsets, starts, side="right") - 1
    entry, count = np.unique(row * max(len(terms), 1) + number, return_counts=True)
    return entry // max(len(terms), 1), entry % max(len(terms), 1), count, terms


def _group_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of equal (lang, source), and a row without a term for every such group."""
    names = ["lang", "source", "term", "count", "docs"]
    for batch in batches:
        langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
        code = np.asarray(langs.indices).astype(np.int64) * max(len(sources.dictionary), 1) + np.asarray(sources.indices)
        groups, owner = np.unique(code, return_inverse=True)
        lang = langs.dictionary.take(pa.array(groups // max(len(sources.dictionary), 1)))
        source = sources.dictionary.take(pa.array(groups % max(len(sources.dictionary), 1)))
        none = np.zeros(len(groups), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(groups), pa.string()), pa.array(none), pa.array(none)], names=names)
        for start, end, data, offsets in slices(batch.column(2)):
            row, number, count, terms = count_vectors(data, offsets)
            if not len(row):
                continue
            key = owner[start:end][row] * len(terms) + number
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            group = pa.array(key[first] // len(terms))
            yield pa.RecordBatch.from_arrays(
                [lang.take(group), source.take(group), terms.take(pa.array(key[first] % len(terms))),
                 pa.array(np.add.reduceat(count, first)), pa.array(np.diff(np.concatenate([first, [len(key)]])))],
                names=names,
            )


def group_vectors(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, term, count, docs`` summed over all documents; a null term marks that the group occurs."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    rows = named.mapInArrow(_group_sums, "lang string, source string, term string, count long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def vocabulary(vectors: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, total``: the terms in at least ``min_docs`` documents of their language, without a limit."""
    return (
        vectors.filter("term is not null").groupBy("lang", "term")
        .agg(F.sum("docs").alias("_docs"), F.sum("count").alias("total")).filter(F.col("_docs") >= min_docs).drop("_docs")
    )


def share(count: Column, total: Column, size: Column, smoothing: int = SMOOTHING, scale: int = SCALE) -> Column:
    """``1 + floor(scale * (count + smoothing) / (total + smoothing * size))``, 0 without a vocabulary."""
    wide = lambda c: c.cast("decimal(20,0)")
    over, under = F.lit(scale).cast("decimal(10,0)") * wide(count + smoothing), wide(total + smoothing * size)
    return F.when(size > 0, F.lit(1) + F.call_function("div", over, under)).otherwise(F.lit(0)).cast("long")


def divergence(
    docs: DataFrame, min_docs: int = MIN_DOCS, most_terms: int = MOST_TERMS,
    lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) that occurs.

    ``pair`` rows: each other source of the language and the sum of absolute differences of shares over
    the vocabulary (0 when it is empty), all ranks. ``term`` rows: the ``most_terms`` terms that occur in the
    group and whose share exceeds the language's most. Ties go to the smaller item in UTF-8 order. Null
    language, source and text count as empty strings; every row is a document, whatever its id. A group
    whose texts are empty or have no kept term has the smoothed share everywhere, and a language with one
    source has no pairs. Other columns are not read. No documents give no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        vectors = scratch.write(group_vectors(docs, lang_col, source_col, text_col))
        words = scratch.write(vocabulary(vectors, min_docs))
        kept = scratch.write(vectors.filter("term is not null").drop("docs").join(words, ["lang", "term"]))
        sizes = words.groupBy("lang").agg(F.count("*").alias("size"), F.sum("total").alias("lang_total"))
        totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("group_total"))
        number = F.col("size")
        occurring = vectors.filter("term is null").select("lang", "source")
        # one row per group: what its shares need, and the group's block of sources
        groups = scratch.write(
            occurring.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
            .join(occurring.groupBy("lang").agg(F.count("*").alias("among")), "lang")
            .na.fill(0, ["size", "lang_total", "group_total"])
            .select(
                "*", share(F.lit(0), F.col("group_total"), number).alias("base"),
                F.greatest(F.lit(1), F.ceil(number / BLOCK_TERMS)).alias("term_blocks"),
                F.ceil(F.col("among") / BLOCK_SOURCES).alias("chunks"),
            )
            .withColumn("chunk", F.pmod(F.xxhash64("source"), "chunks"))
        )
        shares = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("group_total"), number))
        ranked = lambda: Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

        over = F.col("p") - share(F.col("total"), F.col("lang_total"), number)
        terms = (
            shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value"))
            .filter("value > 0").withColumn("rank", F.row_number().over(ranked())).filter(F.col("rank") <= most_terms)
        )
        # a source takes part in every block of terms, even where it has none
        everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1))
        cells = shares.withColumn("block", F.pmod(F.xxhash64("term"), "term_blocks")).select(*CELL).union(
            groups.withColumn("block", everywhere).withColumn("term", F.lit(None).cast("string")).withColumn("p", F.lit(None).cast("long"))
            .select(*CELL)
        )
        # a cell of the triangle of source blocks gets both its blocks' rows
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
        dealt = cells.withColumn("other", other).withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
        pairs = (
            dealt.groupBy("lang", "block", "low", "high").applyInArrow(_cell, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
            .select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked()))
        )
        return scratch.write(pairs.unionByName(terms), keep=True)


CELL = ["lang", "source", "chunk", "chunks", "size", "base", "block", "term", "p"]


def _cell(rows: pa.Table) -> pa.Table:
    """Differences of the sources of two blocks over one block of terms.

    Shares that are not given are the source's base. Over all terms of the language two sources differ
    by ``size * |base - base'|``, counted with the first block, plus what the given shares change.
    """
    names = ["lang", "source", "item", "value"]
    sources, terms = rows["source"].combine_chunks().dictionary_encode(), rows["term"].combine_chunks().dictionary_encode()
    who = np.asarray(sources.indices)
    _, first = np.unique(who, return_index=True)
    base, chunk = (rows[c].to_numpy()[first] for c in ("base", "chunk"))
    given = np.asarray(rows["term"].is_valid())
    at = np.asarray(terms.indices.fill_null(0))[given]
    matrix = np.repeat(base[:, None], len(terms.dictionary), axis=1)
    matrix[who[given], at] = rows["p"].combine_chunks().fill_null(0).to_numpy()[given]
    whole = int(rows["size"][0].as_py()) if rows["block"][0].as_py() == 0 else 0
    low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
    out: list[pa.Table] = []
    name = sources.dictionary
    for i in range(len(name)):
        mates = np.flatnonzero((chunk == (high if chunk[i] == low else low)) & (np.arange(len(name)) != i))
        apart = np.abs(base[mates] - base[i])
        value = np.abs(matrix[mates] - matrix[i]).sum(axis=1) + (whole - len(terms.dictionary)) * apart
        out.append(pa.table([pa.repeat(rows["lang"][0], len(mates)), pa.repeat(name[i], len(mates)), name.take(pa.array(mates)), pa.array(value)], names=names))
    return pa.concat_tables(out)


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
v AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
s AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER h + 5 * count(*) OVER h) AS p,
    1 + (1000000000::HUGEINT * (ln + 5)) // (sum(ln) OVER h + 5 * count(*) OVER h) AS q
  FROM (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.n AS ln FROM g JOIN v ON g.lang = v.lang
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term)
  WINDOW h AS (PARTITION BY lang, source)),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term WHERE a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 50
"""


@query("op11_source_divergence", ORACLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of every source of a language from the others, and the terms it has most in excess."""
    return divergence(table(spark, folder, "documents"))
