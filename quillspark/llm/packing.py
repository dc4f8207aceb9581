"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing.

Partial partitions are merged largest difference first, the heaviest windows of one meeting the
lightest of the other. The number of windows rises until none exceeds the capacity. Documents longer
than a window give full windows; their rests are packed like any other.

A task packs what it reads in blocks of bounded size, so nothing is shuffled or gathered, and a task
that runs again gives the same windows.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import buffers, query, table

WINDOW = 4096
END_ID = 2
BLOCK_TOKENS = 1 << 20
BLOCK_TEXTS = 50_000
CACHE_WORDS = 200_000
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")  # letters that stay as they are when composed or lowered
TAIL = b".,;:!?%$#*&)"
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of every item after multiway differencing into ``windows`` parts."""
    items = len(sizes)
    follows, last = np.full(items, -1), np.arange(items)
    heap = [(-int(size), i, np.array([int(size)]), np.array([i])) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = items
    while len(heap) > 1:
        _, _, a, a_heads = heapq.heappop(heap)
        _, _, b, b_heads = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over <= 0:
            sums, heads = np.concatenate([a, b]), np.concatenate([a_heads, b_heads])
        else:  # the lightest windows of a meet the lightest of b, turned round
            left, right = a_heads[len(a) - over :], b_heads[len(b) - over :][::-1]
            follows[last[left]] = right
            last[left] = last[right]
            sums = np.concatenate([a[: len(a) - over], a[len(a) - over :] + b[len(b) - over :][::-1], b[: len(b) - over]])
            heads = np.concatenate([a_heads, b_heads[: len(b) - over]])
        order = np.argsort(-sums, kind="stable")
        sums, heads = sums[order], heads[order]
        if len(sums) == windows:
            sums = sums - sums[-1]
        spread = int(sums[0]) if len(sums) else 0
        heapq.heappush(heap, (-spread, fresh, sums, heads))
        fresh += 1
    out = np.zeros(items, dtype=np.int64)
    if heap:
        for window, head in enumerate(heap[0][3].tolist()):
            while head >= 0:
                out[head] = window
                head = int(follows[head])
    return out


def near_equal_windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows of all items, none above ``capacity``; no item may exceed it."""
    if not len(sizes):
        return np.zeros(0, np.int64), 0
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        chosen = difference(sizes, windows)
        most = int(np.bincount(chosen, weights=sizes, minlength=windows).max())
        if most <= capacity:
            return chosen, windows
        # a window more, or as many as bring the mean down by what is too much
        windows = max(windows + 1, int(windows * (1 + (most - capacity) / capacity / 2)))


class WordIds(dict):
    """Little-endian unsigned 32-bit ids by word: no token spans ASCII white space in these vocabularies.

    Words are worked out when first met and kept in two generations, so memory stays bounded.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # byte-level vocabularies name printable bytes by their own character and the others from 256 on
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = iter(range(256, 512))
        self.chars = [chr(b) if b in printable else chr(next(others)) for b in range(256)]
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        raw = self.old.get(word)
        if raw is None:
            # a letter followed by punctuation ends a token, so a word's tail is looked up on its own
            stem = word.rstrip(TAIL)
            if stem and len(stem) < len(word) and 97 <= stem[-1] <= 122 and b"<|" not in word:
                raw = self[stem] + self[word[len(stem) :]]
            elif LETTERS.fullmatch(word):  # one unit of the vocabulary's merges
                text = word.decode() if word.isascii() else "".join([self.chars[b] for b in word])
                raw = packed([token.id for token in self.tokenizer.model.tokenize(text)])
            else:
                raw = packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        self[word] = raw
        return raw

    def encode(self, text: bytes) -> bytes:
        """Ids of a text. The vocabulary is lower case, so ASCII letters are lowered first."""
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_TOKENIZERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def pack_block(doc_ids: list, ids: list[bytes], first_sequence: int, capacity: int) -> tuple[list[tuple], int]:
    """Rows of one block, and how many windows it fills."""
    pieces = []  # document, start, length
    for doc, raw in enumerate(ids):
        total = len(raw) // 4
        pieces.extend((doc, start, min(capacity, total - start)) for start in range(0, total, capacity))
    full = [p for p in pieces if p[2] == capacity]
    rest = [p for p in pieces if p[2] < capacity]
    chosen, windows = near_equal_windows(np.array([p[2] for p in rest], dtype=np.int64), capacity)
    place = [*zip(full, range(len(full))), *((p, len(full) + int(w)) for p, w in zip(rest, chosen))]
    filled: dict[int, int] = {}
    rows = []
    for (doc, start, length), window in place:
        offset = filled.get(window, 0)
        filled[window] = offset + length
        raw = ids[doc]
        rows.append((
            doc_ids[doc], start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(raw) // 4,
            first_sequence + window, offset,
        ))
    return rows, len(full) + windows


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = WINDOW, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in its window.

    A null or empty text is its end id alone. Repeated ids are packed once per row. A null id is kept
    as null. An empty table gives no rows. Other columns are not read. Windows fill from offset 0
    without gaps; only what is above ``capacity`` is cut.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 40
        names, held, tokens = [], [], 0

        def flush():
            nonlocal sequence, names, held, tokens
            rows, used = pack_block(names, held, sequence, capacity)
            sequence += used
            names, held, tokens = [], [], 0
            columns = list(zip(*rows)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            whole = data.tobytes()
            ids, bounds = batch.column(0).to_pylist(), offsets.tolist()
            for name, start, stop in zip(ids, bounds, bounds[1:]):
                raw = encoder.encode(whole[start:stop])
                names.append(name)
                held.append(raw + end)
                tokens += len(raw) // 4 + 1
                if tokens >= block_tokens or len(names) >= BLOCK_TEXTS:
                    yield flush()
        if names:
            yield flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_kk_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in windows of at most 4096 tokens."""
    return pack(table(spark, folder, "documents"), default_tokenizer())
