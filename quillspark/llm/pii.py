"""Personal data in whole texts: base patterns, widened by a skip-chain conditional random field.

The base patterns give certain spans. The field labels the document's candidate tokens (tokens holding
digits, ``@`` or a plus sign, and tokens whose form is that of a certain one) as private or ordinary. Neighbouring
candidates share a chain potential; equal or similar tokens share a skip potential however far apart,
and loopy message passing carries the label of a certain occurrence to the others. Unary weights are
log odds counted over all documents: how often tokens of a form are part of certain spans. Every form
counts; forms are hashed into FORM_BUCKETS buckets, so that the table has one size whatever the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import query, table

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the base spans, written without backtracking over digit runs.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TOKEN = re.compile(r"\S++")
TELLING = re.compile(r"[0-9@+]")
STRIP = "\"'()[]{}<>.,;:!?#$%&*"
FORM_BUCKETS = 1 << 16  # size of the unary table
CHAIN, SKIP, ROUNDS, BIAS = 0.2, 3.0, 8, -2.0
NEAR = 3  # candidates at most so many apart are neighbours in the chain
FIELDS = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail spans: each ``@`` takes the whole run of local characters before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        total += value if place % 2 == 0 else (2 * value - 9 if value > 4 else 2 * value)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Certain spans by kind, then start; offsets in code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Tokens that may be private: whitespace-free runs with a digit, ``@`` or plus, bare of punctuation."""
    out = []
    for m in TOKEN.finditer(text):
        raw = m.group()
        if not TELLING.search(raw):
            continue
        bare = raw.strip(STRIP)
        if len(bare) >= 5:
            start = m.start() + raw.index(bare)
            out.append((start, start + len(bare), bare))
    return out


SHAPES = str.maketrans(
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0" * 10 + "A" * 26 + "a" * 26
)


def form(token: str) -> str:
    """Runs of equal character classes with short lengths, e.g. ``0{3}.0{2}``."""
    out, last, count = [], "", 0
    for c in token.translate(SHAPES) + "\0":
        if c == last:
            count += 1
            continue
        if last:
            out.append(last if count == 1 else f"{last}{min(count, 4)}")
        last, count = c, 1
    return "".join(out)


def bucket(shape: str) -> int:
    return xxhash.xxh32_intdigest(shape.encode()) % FORM_BUCKETS


class FormWeights:
    """Log odds of forms by bucket; a bucket no token fell into has none."""

    def __init__(self, by_bucket: np.ndarray):
        self.by_bucket = by_bucket

    def get(self, shape: str, default: float) -> float:
        value = float(self.by_bucket[bucket(shape)])
        return default if math.isnan(value) else value


def similar_key(token: str) -> str:
    """Tokens that differ only in case and separators are similar."""
    return "".join(c for c in token.lower() if c.isalnum() or c == "@")


def covered(tokens: list[tuple[int, int, str]], spans: list[tuple[str, int, int]]) -> list[str | None]:
    """Kind of the certain span holding each token, if any."""
    ordered = sorted((a, b, kind) for kind, a, b in spans)
    out, j = [], 0
    for start, end, _ in tokens:
        while j < len(ordered) and ordered[j][1] <= start:
            j += 1
        hit = j < len(ordered) and ordered[j][0] < end
        out.append(ordered[j][2] if hit else None)
    return out


def infer(unary: np.ndarray, edges: list[tuple[int, int, float]], fixed: np.ndarray) -> np.ndarray:
    """Private-minus-ordinary log odds of every node after loopy sum-product rounds.

    Potentials are symmetric: an edge of strength s gives ``exp(s)`` to equal labels. A fixed node
    keeps its label. Messages are log odds, so one number each.
    """
    if not edges:
        return unary
    a = np.array([e[0] for e in edges] + [e[1] for e in edges])
    b = np.array([e[1] for e in edges] + [e[0] for e in edges])
    strength = np.tanh(np.array([e[2] for e in edges] * 2) / 2)
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros(len(a))
    clamped = np.where(fixed != 0, 20.0 * fixed, unary)
    for _ in range(ROUNDS):
        belief = clamped + np.bincount(b, weights=message, minlength=len(unary))
        cavity = np.clip(belief[a] - message[back], -20, 20)
        fresh = 2 * np.arctanh(np.clip(strength * np.tanh(cavity / 2), -0.999999, 0.999999))
        if np.abs(fresh - message).max() < 1e-6:
            break
        message = 0.5 * message + 0.5 * fresh
    return clamped + np.bincount(b, weights=message, minlength=len(unary))


def added_spans(text: str, spans: list[tuple[str, int, int]], weights: FormWeights | dict[str, float]) -> list[tuple[str, int, int]]:
    """Spans the field adds: candidates outside certain spans that end up private, with the kind they copy."""
    if not spans:
        return []  # without a certain occurrence nothing can be carried on
    tokens = candidates(text)
    held = covered(tokens, spans)
    if not tokens or all(held):
        return []
    fixed = np.array([1.0 if kind else 0.0 for kind in held])
    unary = np.array([weights.get(form(token), BIAS) for _, _, token in tokens])
    edges, kind_of, latest = [], {}, {}
    # certain spans that hold several tokens take part as a whole as well
    for kind, start, end in spans:
        kind_of[similar_key(text[start:end])] = kind
    for i, (_, _, token) in enumerate(tokens):
        key = similar_key(token)
        if key in latest:
            edges.append((latest[key], i, SKIP))
        latest[key] = i
        if held[i]:
            kind_of[key] = held[i]
        elif key in kind_of:
            unary[i] += SKIP
        if i and tokens[i][0] - tokens[i - 1][1] <= NEAR:
            edges.append((i - 1, i, CHAIN))
    odds = infer(unary, edges, fixed)
    return [
        (kind_of[similar_key(token)], start, end)
        for (start, end, token), kind, score in zip(tokens, held, odds)
        if not kind and score > 0 and similar_key(token) in kind_of
    ]


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {kind: n for n, kind in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def form_weights(docs: DataFrame, text_col: str = "text") -> FormWeights:
    """Log odds of each bucket of forms to lie in a certain span, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = candidates(text) if text else []
                if tokens:
                    for (_, _, token), kind in zip(tokens, covered(tokens, base_spans(text))):
                        tally[bucket(form(token))][kind is not None] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(tally), pa.int32()), *(pa.array([t[k] for t in tally.values()], pa.int64()) for k in (0, 1))],
            names=["bucket", "plain", "private"],
        )

    rows = (
        docs.select(text_col).mapInArrow(count, "bucket int, plain long, private long")
        .groupBy("bucket").agg(F.sum("plain").alias("plain"), F.sum("private").alias("private")).collect()
    )
    weights = np.full(FORM_BUCKETS, np.nan, dtype=np.float32)
    for r in rows:
        weights[r["bucket"]] = max(-4.0, min(4.0, math.log((r["private"] + 0.5) / (r["plain"] + 0.5))))
    return FormWeights(weights)


def find(docs: DataFrame, weights: FormWeights | dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, digest and all spans of every row.

    A null or empty text has no spans: zero counts, the digest of the empty string, empty ``spans``.
    Repeated ids give a row each, a null id stays null, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text) if text else []
                added = added_spans(text, spans, weights) if spans else []
                counts = [sum(1 for s in spans if s[0] == kind) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(joined(spans).encode()).hexdigest(), joined(spans + added), len(added)))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=[f.split()[0] for f in FIELDS.split(", ")],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, FIELDS)


def redact(docs: DataFrame, weights: FormWeights | dict[str, float], text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with every span replaced by its kind in brackets; null texts stay null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(names.index(text_col)).to_pylist():
                spans = base_spans(text) if text else []
                if spans:
                    text = replaced(text, spans + added_spans(text, spans, weights))
                texts.append(text)
            columns = list(batch.columns)
            at = names.index(text_col)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if length_col in names:
                at = names.index(length_col)
                kept = batch.column(at).to_pylist()
                columns[at] = pa.array([k if t is None else len(t) for k, t in zip(kept, texts)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Overlapping spans become one mark, that of the first."""
    out, free = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= free:
            out += [text[free:start], f"[{kind.upper()}]"]
        free = max(free, end)
    return "".join([*out, text[free:]])


@query("op3_pii_crf")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of all documents."""
    docs = table(spark, folder, "documents")
    return find(docs, form_weights(docs))
