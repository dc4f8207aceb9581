"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text and normalised by length.

Folding lowers letters, turns look-alike letters of other scripts and digits put for letters into the
letters they stand for, drops invisible characters and turns the rest into spaces. Terms are whole
words or stems that begin a word; weights are log odds learned from labels. A hit inside an exception phrase does
not count. The sum of the hits, divided by a power of the length, and the strongest hit, which no length
dilutes, are calibrated to 0..1.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import query, table

# Look-alike letters, digits and signs put for letters, seed terms, exception phrases.
LOOKALIKES = {
    "a": "аαɑ", "b": "Ьʙ", "c": "сϲ", "d": "ԁ", "e": "еεє", "g": "ɡ", "h": "һ", "i": "іιı", "j": "ј", "k": "кκ",
    "l": "ӏ", "m": "м", "n": "ոη", "o": "оοօσ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս",
    "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ",
}
PUT_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
SEED_TERMS = ("idiot", "stupid", "moron", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown")
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash collection", "class clown", "clown fish", "circus clown",
    "rodeo clown", "pond scum", "soap scum", "sore loser", "idiot proof", "worthless check",
)
SEED_WEIGHT = 3.0
STEM_LENGTHS = range(4, 10)
MOST_TERMS = 50_000  # candidate terms, by number of toxic documents
SAMPLE_LABELS = 100_000  # labelled rows the lexicon and the calibration are fitted on
SURENESS = 3.0


def _folding() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for code in range(128):
        out[code] = chr(code).lower() if chr(code).isalpha() else " "
    for letter, others in LOOKALIKES.items():
        for other in others:
            out[ord(other)] = letter
            upper = other.upper()
            if len(upper) == 1 and not upper.isascii():
                out[ord(upper)] = letter
    out |= {ord(sign): letter for sign, letter in PUT_FOR.items()}
    for offset in range(26):  # full-width letters
        out[0xFF21 + offset] = out[0xFF41 + offset] = chr(97 + offset)
    for code in (*range(0x0300, 0x0370), *range(0x200B, 0x2010), 0x2060, 0xFEFF, 0x00AD):
        out[code] = None
    for code in (*range(0x2010, 0x2070), 0x00A0, 0x3000, *range(0x2000, 0x200B), *range(0x00A1, 0x00C0)):
        if code not in out and not unicodedata.category(chr(code)).startswith("L"):
            out[code] = " "
    return out


FOLDING = _folding()


def fold(text: str) -> str:
    """Folded words between single spaces or more, with a space at either end."""
    return f" {text.lower().translate(FOLDING)} "


@dataclass(frozen=True)
class Lexicon:
    """Weights of whole words (``word``) and stems (``stem*``), and the calibration of their sum and of the greatest."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    power: float = 0.0
    slope: float = 1.0
    offset: float = -3.0
    strong: float = 0.0
    built: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "built"} | {"built": {}}

    def automaton(self):
        """One automaton over terms and exception phrases; None without terms."""
        if "automaton" not in self.built:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                key = f" {term[:-1]}" if term.endswith("*") else f" {term} "
                machine.add_word(key, (len(key), weight))
            for phrase in self.exceptions:
                key = f" {phrase} "
                machine.add_word(key, (len(key), None))
            if len(machine):
                machine.make_automaton()
            self.built["automaton"] = machine if len(machine) else None
        return self.built["automaton"]

    def hits(self, folded: str) -> dict[int, float]:
        """Greatest weight by the place of the space before a word, exception phrases left out."""
        machine = self.automaton()
        found: dict[int, float] = {}
        barred: list[tuple[int, int]] = []
        if machine is not None:
            for end, (length, weight) in machine.iter(folded):
                start = end - length + 1
                if weight is None:
                    barred.append((start, end))
                elif weight > found.get(start, 0.0):
                    found[start] = weight
        for start, end in barred:
            for place in [p for p in found if start <= p < end]:
                del found[place]
        return found

    def features(self, text: str | None) -> tuple[float, float, int]:
        """Sum of the hits' weights, the greatest of them, and number of words."""
        if not text:
            return 0.0, 0.0, 0
        folded = fold(text)
        weights = self.hits(folded).values()
        return sum(weights), max(weights, default=0.0), folded.count(" ")

    def score(self, text: str | None) -> float:
        total, strongest, words = self.features(text)
        sure = self.slope * normalised(total, words, self.power) + self.strong * strongest + self.offset
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, sure))))


def normalised(total, words, power):
    return total / (1.0 + words / 1000.0) ** power


def document_terms(text: str) -> set[str]:
    """Distinct words, and stems that begin a longer word."""
    out = set()
    for word in set(fold(text).split()):
        out.add(word)
        for size in STEM_LENGTHS:
            if size >= len(word):
                break
            out.add(word[:size] + "*")
    return out


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int) -> DataFrame:
    """``text, y`` of at most ``most`` labelled training rows: those first in the order of a hash of the id."""
    key = F.col("doc_id").cast("string")
    rows = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .filter(F.crc32(key.cast("binary")) % modulus != held)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(
        F.broadcast(rows), "doc_id"
    ).select("text", "y")


def _counts(rows: DataFrame, terms_of) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: Counter = Counter()
            for text in batch.column(0).to_pylist():
                tally.update(terms_of(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["term", "n"]
            )

    return rows.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held: int = 0,
    seeds: tuple[str, ...] = SEED_TERMS, exceptions: tuple[str, ...] = EXCEPTIONS, most_labels: int = SAMPLE_LABELS,
) -> Lexicon:
    """A lexicon from the labelled rows whose crc32 remainder is not ``held``.

    Terms must be surer than chance: their weight is log odds less ``SURENESS`` standard errors. Seed
    terms the labels do not speak of keep a fixed weight. Without labels, or where no labelled text has a hit, the
    terms have a fixed calibration. A text without hits scores below a half.
    """
    sample = labelled(docs, labels, label, modulus, held, most_labels)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    terms = dict.fromkeys(seeds, SEED_WEIGHT)
    if toxic and clean:
        found = (
            _counts(sample.filter("y = 1"), document_terms).filter("n >= 3").orderBy(F.desc("n"), "term").limit(MOST_TERMS)
            .collect()
        )
        in_toxic = {r["term"]: r["n"] for r in found}
        known = frozenset(in_toxic)
        in_clean = {
            r["term"]: r["n"]
            for r in _counts(sample.filter("y = 0"), lambda text: document_terms(text) & known).collect()
        }
        terms |= chosen_terms(in_toxic, in_clean, toxic, clean)
    bare = Lexicon(terms, exceptions)
    return _calibrated(bare, sample) if toxic and clean else bare


def chosen_terms(in_toxic: dict[str, int], in_clean: dict[str, int], toxic: int, clean: int) -> dict[str, float]:
    """Terms with the lower bound of their log odds as weight, so that chance finds weigh next to nothing.

    A stem gives way to a longer term that accounts for nearly all of its documents; other longer
    terms stay only if they are clearly stronger than a stem they begin with.
    """
    weights, largest = {}, Counter()
    for term, k in in_toxic.items():
        m = in_clean.get(term, 0)
        odds = math.log((k + 0.5) / (toxic + 1) * (clean + 1) / (m + 0.5))
        error = math.sqrt(1 / (k + 0.5) - 1 / (toxic + 1) + 1 / (m + 0.5) - 1 / (clean + 1))
        if odds - SURENESS * error > 0:
            weights[term] = odds - SURENESS * error
            for stem in stems(term):
                largest[stem] = max(largest[stem], k)
    kept: dict[str, float] = {}
    for term in sorted(weights, key=lambda t: (len(t.rstrip("*")), t)):
        if largest[term] >= 0.9 * in_toxic[term]:
            continue
        shorter = [kept[stem] for stem in stems(term) if stem in kept]
        if not shorter or weights[term] > max(shorter) + 0.3:
            kept[term] = weights[term]
    return kept


def stems(term: str) -> list[str]:
    """Shorter stems a term begins with."""
    bare = term.rstrip("*")
    return [bare[:n] + "*" for n in STEM_LENGTHS if n < len(bare)]


def _calibrated(lexicon: Lexicon, sample: DataFrame) -> Lexicon:
    """Power, weights and offset by regularised logistic regression on counted cells of the features.

    The offset then puts a score of a half where the labelled rows balance recall and precision.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: Counter = Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total, strongest, words = lexicon.features(text)
                tally[(round(8 * math.log2(1 + total)), round(8 * strongest), int(math.log2(words + 1) * 2), y)] += 1
            columns = list(zip(*tally)) if tally else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), pa.array(list(tally.values()), pa.int64())],
                names=["total", "strongest", "words", "y", "n"],
            )

    rows = (
        sample.mapInArrow(cells, "total long, strongest long, words long, y long, n long")
        .groupBy("total", "strongest", "words", "y").agg(F.sum("n").alias("n")).collect()
    )
    total = np.array([2 ** (r["total"] / 8) - 1 for r in rows])
    strongest = np.array([r["strongest"] / 8 for r in rows])
    words = np.array([2 ** (r["words"] / 2) for r in rows])
    y, n = np.array([r["y"] for r in rows], float), np.array([r["n"] for r in rows], float)
    if not strongest.any():
        return lexicon  # nothing to fit
    best = None
    for power in (0.25, 0.5, 1.0):  # some normalisation always
        design = np.stack([normalised(total, words, power), strongest, np.ones_like(total)], axis=1)
        w = np.zeros(3)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            gradient = design.T @ (n * (p - y)) + 1e-2 * w
            curve = (design * (n * p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-2 * np.eye(3)
            w = w - np.clip(np.linalg.solve(curve, gradient), -2, 2)
            w[:2] = np.maximum(w[:2], 1e-3)  # a hit never makes a text cleaner
        p = np.clip(1 / (1 + np.exp(-np.clip(design @ w, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -(n * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()
        if best is None or loss < best[0]:
            best = (loss, power, w, design @ w)
    _, power, w, sure = best
    return Lexicon(lexicon.terms, lexicon.exceptions, power, float(w[0]), float(w[2]) - balanced(sure, y, n, w[2]), float(w[1]))


def balanced(sure: np.ndarray, y: np.ndarray, n: np.ndarray, without: float = -math.inf) -> float:
    """The cut of ``sure`` with the greatest F1 over rows counted ``n`` times, half way to the next value below.

    It lies above ``without``, the value of texts without hits: however many labels are toxic, these stay clean.
    """
    values, at = np.unique(sure, return_inverse=True)
    toxic, all_rows = np.bincount(at, n * y), np.bincount(at, n)
    caught, flagged = np.cumsum(toxic[::-1])[::-1], np.cumsum(all_rows[::-1])[::-1]
    gain = np.where(values > without, 2 * caught / (flagged + toxic.sum()), -1)
    cut = int(gain.argmax())
    below = max(without, values[cut - 1]) if cut else without
    return float(values[cut] if below == -math.inf else (values[cut] + below) / 2)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row.

    Null and empty texts have no hits and so the lowest score. Repeated ids give a row each; a null id
    stays null; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [lexicon.score(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["doc_id", "score", "predicted"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        run, "doc_id long, score double, predicted int"
    )


def keep_clean(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below a half, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([lexicon.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


@query("op9_toxicity_lexicon")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, folder, "documents")
    lexicon = learn(docs, table(spark, folder, "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return score(docs, lexicon).select("doc_id", held.alias("held_out"), "score", "predicted")
