"""Similar-example retrieval: character bigrams, shared words, dense vectors.

Exact top-k needs every query against every catalog row. Queries go out in blocks of bounded size, each
against one scan of the catalog; one block is the ordinary case. Tasks score their rows with matrix
products and pass on at most k rows per query, so what is shuffled grows with queries and tasks, not
with pairs, and no catalog text is shuffled at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark import fixed
from quillspark.functions.text import strip, words

BLOCK_QUERIES = 4096  # queries sent to the tasks at once
BLOCK_CELLS = 4_000_000  # (feature, query) cells of a block: the product is dense
SLICE_CELLS = 2_000_000  # (row, feature) or (row, query) cells a task works on at a time
TOP_SCHEMA = "query_id long, catalog_id long, similarity double"

# (row, feature, count) of a list of texts; features are unsigned 64-bit numbers.
Featuriser = Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def query_text(goal: Column, size: Column, user_input: Column) -> Column:
    """``intent complexity input``; a blank input adds nothing."""
    bare = strip(F.coalesce(user_input, F.lit("")))
    return F.concat_ws(" ", goal, size, F.when(bare != "", bare))


def check_requests(requests: DataFrame) -> DataFrame:
    """Stops at an unknown intent or complexity."""
    bad = ~(F.col("intent").isin(fixed.INTENTS) & F.col("complexity").isin(fixed.COMPLEXITIES))
    message = F.concat(F.lit("invalid intent or complexity: "), F.col("intent"), F.lit(" "), F.col("complexity"))
    return requests.withColumn("intent", F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("intent")))


def bigram_counts(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each character pair of the lower-cased texts occurs."""
    low = [(text or "").lower() for text in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum([len(text) for text in low]) if low else np.zeros(0, np.int64)
    if len(codes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    pairs = codes[:-1] << np.uint64(21) | codes[1:]  # code points have 21 bits
    row = np.repeat(np.arange(len(low)), [len(text) for text in low])[:-1]
    inside = np.arange(1, len(codes)) < ends[np.minimum(row, len(ends) - 1)]
    # rows of a slice fit above the 42 bits of a pair, so one sort of plain numbers counts all texts
    keys = np.sort(row[inside].astype(np.uint64) << np.uint64(42) | pairs[inside])
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    found = keys[at]
    row = (found >> np.uint64(42)).astype(np.int64)
    return row, found & np.uint64((1 << 42) - 1), np.diff(np.append(at, len(keys))).astype(float)


class RunningBest:
    """The k best rows seen so far for every query, ties by catalog id; k numbers per query in all."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.sims = np.full((len(ids), k), -np.inf)
        self.keys = np.full((len(ids), k), np.iinfo(np.int64).max)

    def update(self, sims: np.ndarray, keys: np.ndarray) -> None:
        """Scores of some catalog rows (rows by queries); only queries they can improve are touched."""
        if not len(keys):
            return
        for q in np.nonzero(sims.max(axis=0) >= self.sims[:, -1])[0]:
            worth = np.nonzero(sims[:, q] >= self.sims[q, -1])[0]
            all_sims = np.concatenate([self.sims[q], sims[worth, q]])
            all_keys = np.concatenate([self.keys[q], keys[worth]])
            order = np.lexsort((all_keys, -all_sims))[: self.k]
            self.sims[q], self.keys[q] = all_sims[order], all_keys[order]

    def rows(self, threshold: float = -np.inf) -> pd.DataFrame:
        q, r = np.nonzero((self.sims > -np.inf) & (self.sims >= threshold))
        return pd.DataFrame({"query_id": self.ids[q], "catalog_id": self.keys[q, r], "similarity": self.sims[q, r]})


class Block:
    """Ids of some queries and their weights over the features they have, as one dense matrix."""

    def __init__(self, ids: list[int], parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.ids = np.array(ids, dtype=np.int64)
        self.features = np.unique(np.concatenate([p[0] for p in parts])) if parts else np.zeros(0, np.uint64)
        self.matrix = np.zeros((len(self.features), len(ids)))
        for column, (feature, count) in enumerate(parts):
            self.matrix[np.searchsorted(self.features, feature), column] = count

    def keep(self, features: np.ndarray) -> None:
        """Only these features count, in products and in norms."""
        self.matrix[~np.isin(self.features, features)] = 0.0


def request_blocks(requests: DataFrame, featurise: Featuriser) -> Iterator[Block]:
    """The requests (``query_id``, ``text``) in blocks that hold BLOCK_QUERIES queries and BLOCK_CELLS cells at most."""
    ids: list[int] = []
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    seen: set[int] = set()
    for r in requests.select("query_id", "text").toLocalIterator():
        _, feature, count = featurise([r["text"]])
        grown = seen.union(feature.tolist())
        if ids and (len(ids) >= BLOCK_QUERIES or len(grown) * (len(ids) + 1) > BLOCK_CELLS):
            yield Block(ids, parts)
            ids, parts, grown = [], [], set(feature.tolist())
        ids.append(r["query_id"])
        parts.append((feature, count))
        seen = grown
    if ids:
        yield Block(ids, parts)


def slices(batch: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    rows = max(16, SLICE_CELLS // max(width, 1))
    for start in range(0, len(batch), rows):
        yield batch.iloc[start : start + rows]


def cosines(block: Block, texts: Sequence[str], featurise: Featuriser) -> np.ndarray:
    """Cosine of every text with every query; the text's norm counts all its features."""
    row, feature, count = featurise(texts)
    squares = np.bincount(row, weights=count * count, minlength=len(texts))
    at = np.minimum(np.searchsorted(block.features, feature), max(len(block.features) - 1, 0))
    hit = block.features[at] == feature if len(block.features) else np.zeros(len(feature), bool)
    rows = np.zeros((len(texts), len(block.features)))
    rows[row[hit], at[hit]] = count[hit]
    dots = rows @ block.matrix  # sums of whole numbers, hence exact
    scale = np.sqrt(squares)[:, None] * np.sqrt((block.matrix**2).sum(axis=0))[None, :]
    return np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 1e-10)


def known_features(block: Block, texts: DataFrame, featurise: Featuriser) -> np.ndarray:
    """The block's features that occur anywhere in ``texts``: at most as many rows per task as the block has."""
    shared = texts.sparkSession.sparkContext.broadcast(block.features)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(len(shared.value), dtype=bool)
        for batch in batches:
            for part in slices(batch, 4096):
                if seen.all():
                    break
                seen |= np.isin(shared.value, featurise(part["text"].tolist())[1])
        yield pd.DataFrame({"at": np.flatnonzero(seen)})

    rows = texts.select("text").mapInPandas(find, "at long").distinct().collect()
    return block.features[[r["at"] for r in rows]]


def knn_bigram(
    requests: DataFrame, catalog: DataFrame, k: int = 3, threshold: float = 0.1,
    vocabulary: DataFrame | None = None, featurise: Featuriser = bigram_counts,
) -> DataFrame:
    """Top-k catalog rows (``catalog_id``, ``text``) per request (``query_id``, ``text``) by cosine of bigram counts.

    A catalog of at most k rows is returned whole with similarity 1. ``vocabulary`` is the table
    whose bigrams count; it defaults to the catalog and matters when the catalog is a selection.
    A request without a known bigram is at similarity 0 with every row. ``featurise`` puts other
    counted features in the place of bigrams.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if not -1.0 <= threshold <= 1.0:
        raise ValueError("threshold must be in [-1, 1]")
    catalog = catalog.select("catalog_id", "text")
    small = catalog.limit(k + 1).count()
    if small <= k:
        # a handful of rows by the check just made
        everything = F.broadcast(catalog.groupBy().agg(F.collect_list("catalog_id").alias("_ids")))
        return requests.select("query_id", F.lit(1).alias("_one")).join(
            everything.withColumn("_one", F.lit(1)), "_one"
        ).select("query_id", F.explode("_ids").alias("catalog_id"), F.lit(1.0).alias("similarity")).withColumn(
            "rank", F.row_number().over(Window.partitionBy("query_id").orderBy("catalog_id"))
        )
    base = catalog if vocabulary is None else vocabulary

    def score(block: Block) -> DataFrame:
        block.keep(known_features(block, base, featurise))
        shared = catalog.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = RunningBest(shared.value.ids, k)
            for batch in batches:
                for part in slices(batch, len(shared.value.features) + len(best.ids)):
                    best.update(cosines(shared.value, part["text"].tolist(), featurise), part["catalog_id"].to_numpy())
            yield best.rows(threshold)

        return catalog.mapInPandas(run, TOP_SCHEMA)

    return top_k(united([score(block) for block in request_blocks(requests, featurise)], catalog), k)


def united(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    """All parts as one table, empty without parts."""
    return reduce(DataFrame.unionByName, parts) if parts else like.sparkSession.createDataFrame([], TOP_SCHEMA)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Best k per query, ties by catalog id; the rank limit also applies before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "catalog_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn_metadata(requests: DataFrame, catalog: DataFrame, threshold: float = 0.1, k: int = 3) -> DataFrame:
    """Per request: best similarity, the threshold, candidates and whether any met the threshold.

    ``k`` is the number of examples asked for: a catalog of no more rows counts as similarity 1.
    """
    best = knn_bigram(requests, catalog, k=k, threshold=-1.0).filter("rank = 1").select("query_id", "similarity")
    total = catalog.agg(F.count("*").alias("n")).scalar()
    top = F.coalesce("similarity", F.lit(0.0))
    return requests.select("query_id").join(best, "query_id", "left").select(
        "query_id", top.alias("highest_similarity"), F.lit(threshold).alias("threshold"),
        total.alias("total_candidates"), ((total > 0) & (top >= threshold)).alias("met_threshold"),
    )


def expected_output_examples(catalog: DataFrame, labels: DataFrame) -> DataFrame:
    """The catalog rows that carry an expected output: those ``labels`` (``catalog_id``) names."""
    return catalog.join(labels.select("catalog_id").distinct(), "catalog_id", "left_semi")


def knn_words(requests: DataFrame, pool: DataFrame, k: int = 3) -> DataFrame:
    """Top-k pool rows by shared words over query words; earlier rows win ties and fill up to k.

    A request without words is at similarity 0 with every row. Each task counts in place and keeps,
    per query, only its k best rows before the shuffle.
    """
    asked = requests.select("query_id", F.array_distinct(words(F.lower(F.coalesce("text", F.lit(""))))).alias("words"))
    rows = pool.select("pos", F.array_distinct(words(F.lower(F.coalesce("text", F.lit(""))))).alias("words"))

    def score(ids: list[int], terms: list[list[str]]) -> DataFrame:
        names = pd.Index(sorted({t for some in terms for t in some}))
        matrix = np.zeros((len(names), len(ids)), dtype=np.float32)
        for column, some in enumerate(terms):
            matrix[names.get_indexer(some), column] = 1.0
        shared = pool.sparkSession.sparkContext.broadcast((np.array(ids, dtype=np.int64), names, matrix))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, names, matrix = shared.value
            asked_for = np.maximum(matrix.sum(axis=0, dtype=np.float64), 1.0)
            best = RunningBest(ids, k)
            for batch in batches:
                for part in slices(batch, len(ids) + len(names)):
                    sizes = part["words"].map(len).to_numpy()
                    at = names.get_indexer(np.concatenate(part["words"].tolist())) if sizes.sum() else np.zeros(0, np.int64)
                    owner = np.repeat(np.arange(len(part)), sizes)[at >= 0]
                    held = np.zeros((len(part), len(names)), dtype=np.float32)
                    held[owner, at[at >= 0]] = 1.0
                    best.update((held @ matrix).astype(np.float64) / asked_for, part["pos"].to_numpy())
            yield best.rows()

        return rows.mapInPandas(run, TOP_SCHEMA)

    parts, ids, terms, seen = [], [], [], set()
    for r in asked.toLocalIterator():
        grown = seen.union(r["words"])
        if ids and (len(ids) >= BLOCK_QUERIES or len(grown) * (len(ids) + 1) > BLOCK_CELLS):
            parts.append(score(ids, terms))
            ids, terms, grown = [], [], set(r["words"])
        ids.append(r["query_id"])
        terms.append(r["words"])
        seen = grown
    if ids:
        parts.append(score(ids, terms))
    return top_k(united(parts, pool), k)


def cosine_vectors(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors; 0 where either is all zeros."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 1e-10, dot(a, b) / norm).otherwise(0.0)


def knn_vectors(queries: DataFrame, catalog: DataFrame, k: int = 3) -> DataFrame:
    """Top-k catalog vectors per query vector by cosine; (``query_id``|``catalog_id``, ``vector``).

    Vectors that are not finite stop the job, on either side; a vector of zeros is at similarity 0 with all.
    """

    def score(ids: list[int], vectors: list[list[float]]) -> DataFrame:
        matrix = np.array(vectors, dtype=np.float64).reshape(len(ids), -1)
        if not np.isfinite(matrix).all():
            raise ValueError("query vectors contain NaN or infinite values")
        shared = queries.sparkSession.sparkContext.broadcast((np.array(ids, dtype=np.int64), matrix))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            norms = np.linalg.norm(matrix, axis=1)
            best = RunningBest(ids, k)
            for batch in batches:
                for part in slices(batch, len(ids) + matrix.shape[1]):
                    rows = np.array(part["vector"].tolist(), dtype=np.float64)
                    if not np.isfinite(rows).all():
                        raise ValueError("catalog vectors contain NaN or infinite values")
                    scale = np.linalg.norm(rows, axis=1)[:, None] * norms[None, :]
                    dots = rows @ matrix.T
                    sims = np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 1e-10)
                    best.update(sims, part["catalog_id"].to_numpy())
            yield best.rows()

        return catalog.select("catalog_id", "vector").mapInPandas(run, TOP_SCHEMA)

    parts, ids, vectors = [], [], []
    for r in queries.select("query_id", "vector").toLocalIterator():
        ids.append(r["query_id"])
        vectors.append(r["vector"])
        if len(ids) >= BLOCK_QUERIES or len(ids) * len(r["vector"]) >= BLOCK_CELLS:
            parts.append(score(ids, vectors))
            ids, vectors = [], []
    if ids:
        parts.append(score(ids, vectors))
    return top_k(united(parts, catalog), k)


def fewshot_prompts(requests: DataFrame, found: DataFrame, examples: DataFrame) -> DataFrame:
    """Prompt text per request: role, task, optional sections and its retrieved examples.

    ``requests`` has query_id, idea, context, complexity, prompt_role and the optional columns
    code_snippet, error_log, target_language, target_framework; ``found`` is a top-k result, so the
    examples collected per request are at most k.
    """
    c = F.col
    for name in ("context", "code_snippet", "error_log", "target_language", "target_framework"):
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(""))
        requests = requests.withColumn(name, F.coalesce(name, F.lit("")))
    picked = found.join(examples.select("catalog_id", "input_idea", "input_context", "output"), "catalog_id")
    lists = picked.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "input_idea", "input_context", "output"))).alias("_ex")
    )
    joined = requests.join(lists, "query_id", "left").withColumn(
        "_ex", F.coalesce("_ex", F.array().cast("array<struct<rank:int,input_idea:string,input_context:string,output:string>>"))
    )
    is_complex = c("complexity") == "complex"
    given = strip(c("context")) != ""
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    some = lambda name: c(name) != ""

    def block(level: str, ask: str, answer: str):
        return lambda e: cat(
            f"{level} Example ", e["rank"].cast("string"), f"\n**{ask}:** ", e["input_idea"], "\n",
            F.when(F.coalesce(e["input_context"], F.lit("")) != "", cat("**Context:** ", e["input_context"], "\n")).otherwise(""),
            f"**{answer}:** ", e["output"], "\n",
        )

    simple = F.concat_ws(
        "\n",
        cat("# Role\nYou are a ", c("prompt_role"), ".\n\n# Task\n", c("idea")),
        F.when(given, cat("\n# Context\n", c("context"))),
        F.when(some("code_snippet"), cat("\n# Code\n```\n", c("code_snippet"), "\n```")),
        F.when(some("error_log"), cat("\n# Error\n", c("error_log"))),
        F.when(some("target_language"), cat("\n# Target Language: ", c("target_language"))),
        F.when(
            F.size("_ex") > 0,
            cat("\n# Examples\nHere are some similar examples to guide you:\n\n", F.array_join(F.transform("_ex", block("##", "Input", "Output")), "\n")),
        ),
    )
    focus = (
        F.when(some("error_log"), "debug and fix the error")
        .when(F.lower("idea").rlike("optimizar|refactor"), "optimize the code for better performance and maintainability")
        .otherwise("implement the requested functionality")
    )
    rephrased = F.concat_ws(
        " ", focus, F.when(some("context"), "considering the provided context and requirements"),
        F.when(some("code_snippet"), "for the given code snippet"),
    )
    rephrased = F.concat(F.upper(F.substring(rephrased, 1, 1)), F.substring(rephrased, 2, 1 << 30))
    rich = F.concat_ws(
        "\n",
        cat(
            "# Role\nYou are a ", c("prompt_role"), ".\n\n# Understanding the Request\n"
            "First, let me rephrase the request to ensure clarity:\n\n**Original Request:** ", c("idea"),
            "\n**Rephrased Understanding:** ", rephrased, "\n\n# Task\nBased on the above understanding, please:",
        ),
        F.when(given, cat("\n## Additional Context\n", c("context"))),
        F.when(some("code_snippet"), cat("\n## Code to Work With\n```\n", c("code_snippet"), "\n```")),
        F.when(some("error_log"), cat("\n## Error Information\n", c("error_log"))),
        F.when(some("target_framework"), cat("\n**Framework:** ", c("target_framework"))),
        F.when(
            F.size("_ex") > 0,
            cat(
                "\n## Reference Examples\nThese examples may help guide your approach:\n\n",
                F.array_join(F.transform(F.slice("_ex", 1, 3), block("###", "Request", "Response")), "\n"),
            ),
        ),
        F.lit(
            "\n## Requirements\n- Provide a clear, well-structured response\n- Include code examples where applicable\n"
            "- Explain your reasoning"
        ),
    )
    return joined.select(
        "query_id", F.when(is_complex, rich).otherwise(simple).alias("template"), F.size("_ex").alias("fewshot_count")
    )
