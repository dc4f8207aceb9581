"""Language identification by mixture inference.

Every language has n-gram likelihoods counted over its training documents. A document is a mixture:
expectation-maximisation finds the proportions of the languages from the likelihoods of its n-grams.
The set of languages is chosen by penalised likelihood among the best single one, the leading few, and
all of them; the prediction is the language with the largest proportion in the chosen set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import mix, query, slices, table

BUCKETS = 1 << 16
SMOOTH = 0.05
ROUNDS = 12
FEW = 3  # languages a mixture keeps at most
PENALTY = 2.0  # times log(n) for each further language
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True
# digits, punctuation and control bytes are one kind of gap
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]
PLAIN[65:91] += 32


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of byte trigrams of lowered texts with a gap at either end, and the row of each; gaps alone give none."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(rows), sizes)
    text = PLAIN[data]
    # two-byte Latin capitals lie 32 below their small letters
    lead = np.zeros(len(data), dtype=bool)
    lead[1:] = data[:-1] == 0xC3
    capital = lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    text[capital] += 0x20
    padded = np.full(len(data) + 2 * rows, 32, dtype=np.uint32)
    padded[np.arange(len(data)) + 2 * owner + 1] = text
    if len(padded) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
    row = np.repeat(np.arange(rows), sizes + 2)[1:-1]
    # windows that cross into the next row start with its end gap
    bounds = np.cumsum(sizes + 2)
    inside = np.ones(len(key), dtype=bool)
    inside[np.minimum(bounds[:-1] - 1, len(key) - 1)] = False
    inside[np.minimum(bounds[:-1] - 2, len(key) - 1)] = False
    inside &= (key & 0xFFFF) != 0x2020
    return (mix(key[inside].astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64), row[inside]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held: int = 2):
    """Languages and their log likelihoods (languages x buckets), from all rows whose crc32 remainder is not ``held``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for start, end, data, offsets in slices(batch.column(0)):
                bucket, row = trigrams(data, offsets)
                names = np.array(langs[start:end], dtype=object)
                for lang in set(names):
                    mine = (names == lang)[row]
                    have = tally.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    have += np.bincount(bucket[mine], minlength=BUCKETS)
        for lang, counts in tally.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"]
            )

    rows = (
        docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
        .filter(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus != held)
        .select(F.col(text_col), F.col(lang_col).cast("string")).mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    names = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((len(names), BUCKETS))
    if names:
        which = np.searchsorted(np.array(names), np.array(rows["lang"].to_pylist()))
        counts[which, rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    likely = np.log(counts + SMOOTH) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    return names, likely.astype(np.float32)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def proportions(ratio: np.ndarray, n: np.ndarray, starts: np.ndarray, owner: np.ndarray, allowed: np.ndarray, rounds: int):
    """Mixture proportions of every document over its ``allowed`` languages, and the log likelihood."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    total = _sums(n, starts)[:, None]
    for _ in range(rounds):
        weighted = ratio * share[owner]
        weighted *= (n / np.maximum(weighted.sum(axis=1), 1e-30))[:, None]
        share = _sums(weighted, starts) / total
    return share, _sums(n * np.log(np.maximum((ratio * share[owner]).sum(axis=1), 1e-30)), starts)


def infer(bucket: np.ndarray, row: np.ndarray, likely: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows with n-grams, the language of each, its proportion, and the number of languages chosen."""
    key, n = np.unique(row * BUCKETS + bucket, return_counts=True)
    owner_row, bucket = key // BUCKETS, key % BUCKETS
    starts = np.flatnonzero(np.concatenate([[True], owner_row[1:] != owner_row[:-1]]))
    rows = owner_row[starts]
    owner = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(key))))
    log = likely[:, bucket].T
    log = log - log.max(axis=1, keepdims=True)
    ratio, n = np.exp(log), n.astype(np.float32)
    languages = ratio.shape[1]
    single = _sums(log * n[:, None], starts)
    everyone = np.ones((len(rows), languages), dtype=np.float32)
    full, _ = proportions(ratio, n, starts, owner, everyone, ROUNDS)
    price = PENALTY * np.log(np.maximum(_sums(n, starts), 2))
    best, chosen = single.max(axis=1), single.argmax(axis=1)
    size = np.ones(len(rows), dtype=np.int64)
    share = full
    order = np.argsort(-full, axis=1, kind="stable")
    for k in range(2, min(FEW, languages) + 1):
        allowed = np.zeros_like(everyone)
        np.put_along_axis(allowed, order[:, :k], 1.0, axis=1)
        part, fit = proportions(ratio, n, starts, owner, allowed, ROUNDS // 2)
        better = fit - (k - 1) * price > best
        best = np.where(better, fit - (k - 1) * price, best)
        chosen = np.where(better, part.argmax(axis=1), chosen)
        share = np.where(better[:, None], part, share)
        size[better] = k
    return rows, chosen, np.take_along_axis(share, chosen[:, None], axis=1)[:, 0], size


def predict(docs: DataFrame, names: list[str], likely: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, n_langs`` of every row.

    A null text, one without a letter, and any text when no language was learned, is ``und`` with score
    0. The score is the proportion of the language predicted. Repeated ids give a row each, a null id
    stays null, only the two columns are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(likely)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for start, end, data, offsets in slices(texts):
                rows = end - start
                lang, score, size = np.full(rows, "und", dtype=object), np.zeros(rows), np.zeros(rows, np.int64)
                if names:
                    bucket, row = trigrams(data, offsets)
                    if len(bucket):
                        at, chosen, share, count = infer(bucket, row, sent.value)
                        lang[at], score[at], size[at] = np.array(names, dtype=object)[chosen], np.clip(share, 0, 1), count
                plain = np.concatenate([[0], np.cumsum(LETTERS[data])])
                for i in np.flatnonzero(plain[offsets[1:]] == plain[offsets[:-1]]):
                    if not any(c.isalpha() for c in texts[start + int(i)].as_py() or ""):
                        lang[i], score[i], size[i] = "und", 0.0, 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, rows), pa.array(lang, pa.string()), pa.array(score), pa.array(size)],
                    names=["doc_id", "lang_pred", "score", "n_langs"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        run, "doc_id long, lang_pred string, score double, n_langs long"
    )


@query("op7_language_mixture")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Language of all documents."""
    docs = table(spark, folder, "documents")
    found = predict(docs, *learn(docs))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_langs")
