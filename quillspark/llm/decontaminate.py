"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions throughout.

A seed hashes the words a fixed mask picks and ignores those between, so a substituted word spoils only
some seeds. Hashes of test texts and of documents are joined; each hit lies on a diagonal of document
against test text, and the overlap around it is the best run on that diagonal when matches count 1 and
substitutions cost MISMATCH. Long documents are looked at in pieces that overlap by the longest test text, so
that a row never carries more words than a few times that, however many places of it hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.llm.common import query, table

# Places a seed reads; masks share one span.
MASKS = ((0, 1, 3, 4, 7, 8), (0, 2, 3, 5, 6, 8), (0, 1, 4, 5, 6, 8))
SPAN = 9
MISMATCH = 2
MIN_MATCHED = 12  # equal words an overlap needs, or
MIN_SHARE = 0.6  # this share of a test text's words, if that is less
PIECE_WORDS = 4096  # least places of a piece of a document
BLOCK_WORDS = 1_000_000  # words of test texts that are sent to the tasks at once


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def digests(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def seed_at(number: int, words: str, place: Column) -> Column:
    """Hash of the words that a mask reads at a place."""
    return F.xxhash64(F.lit(number), *[F.get(words, place + k) for k in MASKS[number]])


def seeded(
    rows: DataFrame, words: str, place: str, mask: str, first: Column | None = None, last: Column | None = None
) -> DataFrame:
    """A row for each seed from place ``first`` to ``last``: its hash, place and mask; none below SPAN words.

    Places are rows before seeds are hashed, so that hashing is compiled with the scan and the join.
    """
    first = F.lit(0) if first is None else first
    end = F.size(words) - SPAN
    end = end if last is None else F.least(end, last)
    places = F.when(end >= first, F.sequence(first, end)).otherwise(F.array().cast("array<int>"))
    pairs = [part for n in range(len(MASKS)) for part in (F.lit(n), seed_at(n, words, F.col(place)))]
    return rows.select("*", F.explode(places).alias(place)).select("*", F.stack(F.lit(len(MASKS)), *pairs).alias(mask, "seed"))


def by_mask(mask: str, value) -> Column:
    """``value(number)`` of the row's mask."""
    picked = value(0)
    for number in range(1, len(MASKS)):
        picked = F.when(F.col(mask) == number, value(number)).otherwise(picked)
    return picked


def pieces(rows: DataFrame, around: int) -> DataFrame:
    """Documents as pieces ``h`` of word digests with ``around`` words kept on both sides: where ``h`` starts, and its own places.

    Digests are taken after the cut: the step between is not compiled, so one piece at a time goes into the joins.
    """
    step = max(PIECE_WORDS, around)
    begins = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    before = F.least(F.col("begin"), F.lit(around))
    return rows.select("doc_id", "words", F.explode(begins).alias("begin")).select(
        "doc_id", (F.col("begin") - before).alias("start"), before.alias("own"), (before + step - 1).alias("own_end"),
        digests(F.slice("words", F.col("begin") - before + 1, before + step + around)).alias("h"),
    )


def _first_of_run() -> Column:
    """No seed matches one place earlier on the diagonal, nor one of an earlier mask here: a run of hits is verified once."""
    pos = F.col("pos")
    edge = (pos == 0) | (F.col("at") == 0)
    before = by_mask("mask", lambda n: seed_at(n, "h", pos - 1)) == F.col("before")
    here = F.lit(False)
    for number in range(len(MASKS) - 1):
        here = here | ((F.col("mask") > number) & (seed_at(number, "h", pos) == F.col(f"seed_{number}")))
    return (edge | ~before) & ~here


def _best_run() -> Column:
    """The best-scoring stretch of the diagonal ``h_run`` against ``w_run``: its start, end and matches."""
    none = F.lit(0)
    start = F.struct(
        none.alias("score"), none.alias("begin"), none.alias("equal"),
        none.alias("best"), none.alias("from"), none.alias("to"), none.alias("matched"),
    )

    def step(state: Column, j: Column) -> Column:
        hit = F.get("h_run", j) == F.get("w_run", j)
        fresh = state["score"] <= 0
        score = F.when(fresh, 0).otherwise(state["score"]) + F.when(hit, 1).otherwise(-MISMATCH)
        begin = F.when(fresh, j).otherwise(state["begin"])
        equal = F.when(fresh, 0).otherwise(state["equal"]) + hit.cast("int")
        better = score > state["best"]
        return F.struct(
            score.alias("score"), begin.alias("begin"), equal.alias("equal"),
            F.when(better, score).otherwise(state["best"]).alias("best"),
            F.when(better, begin).otherwise(state["from"]).alias("from"),
            F.when(better, j + 1).otherwise(state["to"]).alias("to"),
            F.when(better, equal).otherwise(state["matched"]).alias("matched"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.size("w_run") - 1), start, step)


def overlaps(
    docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", test_id_col: str = "item_id",
    test_text_col: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document and test text that overlap: ``doc_id, item_id, n_matched, n_words, doc_start, item_start``.

    The longest overlap of the pair is given, in words; ties go to the earliest in the document. Null
    and empty texts, and texts of fewer than SPAN words, overlap with nothing. Repeated ids are one
    document. Rows with a null id are left out. Only the named columns are read. Test texts are joined in blocks of
    bounded size, each sent to the tasks and met with all documents; one block is the ordinary case.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words")
    )
    items = tests.filter(F.col(test_id_col).isNotNull()).select(
        F.col(test_id_col).cast("long").alias("item_id"), digests(words_of(F.col(test_text_col))).alias("w")
    ).filter(F.size("w") >= SPAN).distinct()
    words, longest = items.agg(F.sum(F.size("w")), F.max(F.size("w"))).first()
    blocks = max(1, -(-(words or 0) // block_words))
    at_docs = seeded(pieces(rows, longest or SPAN), "h", "pos", "mask", F.col("own"), F.col("own_end"))
    shift = F.col("pos") - F.col("at")
    low, high = F.greatest(F.lit(0), -shift), F.least(F.col("size"), F.size("h") - shift)
    at = F.col("at")
    earlier = [seed_at(n, "w", at).alias(f"seed_{n}") for n in range(len(MASKS) - 1)]
    found = None
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "w"), F.lit(blocks)) == block)
        part = part.withColumn("item", F.xxhash64("item_id", "w"))
        at_items = seeded(part.select("item", "w"), "w", "at", "item_mask").select(
            "seed", "item", "at", F.size("w").alias("size"), by_mask("item_mask", lambda n: seed_at(n, "w", at - 1)).alias("before"), *earlier
        ).distinct()
        hits = (
            at_docs.join(F.broadcast(at_items), "seed").filter(_first_of_run())
            # only the diagonal leaves the compiled join: many hits of one piece may wait in memory behind it
            .select(
                "doc_id", "item", "size", (shift + F.col("start")).alias("shift"), low.alias("low"),
                F.slice("h", low + shift + 1, high - low).alias("h_run"),
            )
            # equal words against the same place of a test text give the same overlap: the earliest stands for all
            .groupBy("doc_id", "item", "size", "low", "h_run").agg(F.min("shift").alias("shift"))
            .join(F.broadcast(part), "item")
            .withColumn("w_run", F.slice("w", F.col("low") + 1, F.size("h_run")))
            .select("doc_id", "item_id", "size", "shift", "low", _best_run().alias("run"))
        )
        found = hits if found is None else found.unionByName(hits)
    item_start = F.col("run.from") + F.col("low")
    begin = item_start + F.col("shift")
    length = F.col("run.to") - F.col("run.from")
    enough = F.col("run.matched") >= F.least(F.lit(MIN_MATCHED), F.ceil(F.col("size") * MIN_SHARE))
    # filtered once they are aggregated: a filter here would go into the join and run the verification twice
    best = found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct(F.when(enough, F.col("run.matched")).alias("n"), (-length).alias("l"), (-begin).alias("d"), (-item_start).alias("i"))).alias("b")
    )
    return best.filter(F.col("b.n").isNotNull()).select(
        "doc_id", "item_id", F.col("b.n").cast("long").alias("n_matched"), (-F.col("b.l")).cast("long").alias("n_words"),
        (-F.col("b.d")).cast("long").alias("doc_start"), (-F.col("b.i")).cast("long").alias("item_start"),
    )


def keep_uncontaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that overlap with no test text, with all their columns; rows with a null id are kept."""
    bad = overlaps(docs, tests, id_col=id_col).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)


@query("op1_spaced_seed")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """All documents that hold passages of the benchmark, substituted words allowed."""
    return overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
