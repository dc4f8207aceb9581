"""N-gram Jaccard self-join by a token-group matrix, returned as connected components.

Similar documents form groups; a group stores the union of its members' tokens, and a query document
opens a group only when its overlap with that union can still reach the bound.

1. Documents with equal sets fall into one class; one representative goes on.
2. Representatives that agree in a band of minimum digests are compared with the smallest of their
   bucket. Verified links make the groups, so a family of near copies is one group however large.
3. Every set keeps the tokens of its prefix under one total order (tokens frequent inside a task come
   last): two sets that reach the bound share a prefix token. (token, group) rows are the matrix, put
   together inside a task before they are shuffled. A token held by one group only is finished;
   otherwise the groups holding it open each other, sizes permitting.
4. Opened groups are first compared by their smallest members, which merges most of what belongs
   together. Otherwise the members of the smaller group meet those of the larger one chunk by chunk;
   pairs that share enough prefix tokens are compared, the best of each query first.

Steps 3 and 4 lose no link: any total order of tokens is exact, and a pair is left out only when its
two documents are already connected. No step lists the pairs inside a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillspark.llm.common import mix, query, table
from quillspark.llm.components import components
from quillspark.llm.idfilter import build_filter, passes
from quillspark.llm.scratch import Scratch
from quillspark.llm.shingles import ragged, segments, shingle_sets

BANDS, ROWS_PER_BAND = 6, 2
LOCAL_FREQUENT = 4  # copies inside a task from which a token counts as frequent
MOST_FREQUENT = 100_000  # frequent tokens named in the order; the order needs no more to be exact
CHUNK = 64  # members of a large group that meet a query at once
BRIEF_TOKENS = 4096  # most tokens of a set whose digests are shortened to 16 bits
SEEDS = (np.arange(1, BANDS * ROWS_PER_BAND + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def needed(percent: int, size: np.ndarray) -> np.ndarray:
    """Least overlap of a set of this size with any set that reaches ``percent``."""
    return -(-percent * size // 100)


def similarity_components(
    docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Two documents link when ``100 * |A ∩ B| >= percent * |A ∪ B|``; a component is named by its
    smallest id. Null, empty and blank texts have size 0 and link with nothing; a text shorter than
    ``width`` words is one shingle. Rows that repeat an id give a row each; their texts are one
    document, whose set is the union of theirs. A null id stays null and is its own component. Only the two named columns are read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        return _components(base, percent, width, scratch)


def _components(base: DataFrame, percent: int, width: int, scratch: Scratch) -> DataFrame:
    facts = _facts(base, percent, width, scratch)
    live = facts.filter("n > 0 and doc_id is not null")
    classes = scratch.write(live.groupBy("lo", "hi").agg(F.min("doc_id").alias("rep")))
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()

    # groups: representatives against the smallest of their bucket
    buckets = live.select("doc_id", "bands").join(reps, "doc_id").select("doc_id", F.posexplode("bands").alias("band", "key"))
    hubs = buckets.groupBy("band", "key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("_z")).filter("a < _z")
    near = buckets.join(hubs, ["band", "key"]).filter("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    links = _verified(near, base, percent, width, scratch)
    groups = _grouped(reps, links, scratch)

    # token-group matrix over prefixes; a row is a token of a group's union
    members = live.select("doc_id", "n", "tokens").join(groups, "doc_id")
    unions = (
        members.select("group", "n", "tokens").mapInArrow(_unions, "token long, group long, least long, most long")
        .repartition("token").groupBy("token", "group").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    )
    held = Window.partitionBy("token")
    matrix = scratch.write(
        unions.withColumn("_low", F.min("group").over(held)).withColumn("_high", F.max("group").over(held))
        .filter("_low < _high").drop("_low", "_high")
    )
    left, right = (
        matrix.select("token", F.col("group").alias(g), F.col("least").alias(f"{g}_least"), F.col("most").alias(f"{g}_most"))
        for g in "ab"
    )
    # the overlap of two unions bounds that of any two members
    opened = scratch.write(
        left.join(right, "token")
        .filter(f"a < b and 100 * b_most >= {percent} * a_least and 100 * a_most >= {percent} * b_least")
        .groupBy("a", "b").agg(
            F.count("*").alias("common"), F.min("a_least").alias("al"), F.max("a_most").alias("am"),
            F.min("b_least").alias("bl"), F.max("b_most").alias("bm"),
        )
        .filter(f"common >= if(al = am and bl = bm, {_shared_prefix(percent, 'al', 'bl')}, {_least_shared(percent)})").select("a", "b")
    )
    scratch.drop(matrix)
    # a group is named by its smallest member
    found = _verified(opened, base, percent, width, scratch)
    first, groups = groups, _merged(groups, found, scratch)

    # groups of several members that did not meet by their smallest ones: the smaller group's members
    # query the larger group, whose members lie in chunks of bounded size
    sizes = first.groupBy("group").agg(F.count("*").alias("size"))
    apart = scratch.write(
        _apart(opened, groups)
        .join(sizes.select(F.col("group").alias("a"), F.col("size").alias("sa")), "a")
        .join(sizes.select(F.col("group").alias("b"), F.col("size").alias("sb")), "b").filter("sa > 1 or sb > 1")
        .select(F.expr("if(sa <= sb, a, b)").alias("a"), F.expr("if(sa <= sb, b, a)").alias("b"))
    )
    # sizes come in before members are dealt by document, so that chunks and not groups are dealt out
    wanted = lambda side: apart.select(F.col(side).alias("group")).distinct().join(sizes, "group")
    part = lambda side: live.select("doc_id", "n", "tokens").join(first.join(wanted(side), "group"), "doc_id")
    place = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / CHUNK))
    chunks = part("b").groupBy(F.col("group").alias("b"), place.alias("chunk")).agg(
        F.collect_list(F.struct("doc_id", "n", "tokens")).alias("members")
    )
    queries = part("a").select(F.col("group").alias("a"), F.col("doc_id").alias("x"), "n", "tokens")
    meetings = apart.join(queries, "a").join(chunks, "b").select("a", "b", "x", "n", "tokens", "members")
    candidates = scratch.write(meetings.mapInArrow(_meet(percent), "a long, b long, x long, y long, common long"))
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    best = candidates.groupBy("b", "x").agg(F.max(F.struct("common", "y")).alias("top")).select("x", "top.y").select(*pair).distinct()
    for pairs in (lambda: best, lambda: _apart(candidates, groups).select(*pair).distinct()):
        groups = _merged(groups, _verified(pairs(), base, percent, width, scratch), scratch)

    sets = classes.join(groups.withColumnRenamed("doc_id", "rep"), "rep").select("lo", "hi", F.col("group").alias("component_id"))
    return scratch.write(
        facts.select("doc_id", "n", "lo", "hi").join(sets, ["lo", "hi"], "left").select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
            .alias("component_id"),
        ),
        keep=True,
    )


def _facts(base: DataFrame, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """FACTS of every row; rows that repeat an id all have those of the union of its sets."""
    frequent = _frequent(base, width)
    facts = scratch.write(base.mapInArrow(_describer(percent, width, frequent), FACTS))
    counted = facts.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("copies"))
    repeated = scratch.write(counted.filter("copies > 1"))
    ids = repeated.select("doc_id")
    if ids.isEmpty():
        return facts
    wanted = base.sparkSession.sparkContext.broadcast(build_filter(ids))
    joined = _sets(base, ids, width, wanted).mapInArrow(_set_describer(percent, frequent), FACTS).join(repeated, "doc_id")
    each = joined.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    out = scratch.write(facts.join(ids, "doc_id", "left_anti").unionByName(each))
    wanted.unpersist()
    scratch.drop(facts)
    return out


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows whose ``a`` and ``b``, heads of groups, are still in different ones."""
    return _heads(pairs, groups).drop("_a", "_b")


def _heads(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows whose ``a`` and ``b`` are in different groups, ``_a`` and ``_b``."""
    now = lambda c: groups.select(F.col("doc_id").alias(c), F.col("group").alias(f"_{c}"))
    return pairs.join(now("a"), "a").join(now("b"), "b").filter("_a <> _b")


def _grouped(reps: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    found = components(links, scratch)
    return scratch.write(
        reps.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", F.coalesce("component", "doc_id").alias("group"))
    )


def _merged(groups: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """The groups after further links, of which only those between different groups are walked."""
    heads = scratch.write(_heads(found, groups).select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
    if heads.isEmpty():
        return groups
    joined = components(heads, scratch).select(F.col("node").alias("group"), "component")
    return scratch.write(groups.join(joined, "group", "left").select("doc_id", F.coalesce("component", "group").alias("group")))


FACTS = "doc_id long, n long, lo long, hi long, bands array<long>, tokens array<long>"


def _shared_prefix(percent: int, one: str, two: str) -> str:
    """Least number of tokens two linked sets share inside both prefixes.

    Common tokens outside are all beyond the prefix that ends first, where at most
    ``ceil(percent * size / 100) - 1`` tokens of its set lie.
    """
    overlap = f"ceil({percent} * ({one} + {two}) / {100 + percent}.0)"
    return f"greatest(1, {overlap} - ceil({percent} * greatest({one}, {two}) / 100.0) + 1)"


def _least_shared(percent: int) -> str:
    """The same for any member of sizes ``al`` to ``am`` with any of sizes ``bl`` to ``bm``.

    A smaller set of s tokens and a larger one of t share more than
    ``percent * (s + t) / (100 + percent) - percent * t / 100`` prefix tokens, which grows with s and
    falls with t, so the least s and the greatest t, either way round, bound it for all.
    """
    more = lambda s, t: f"floor({percent} * ({s} + {t}) / {100 + percent}.0 - {percent} * {t} / 100.0) + 1"
    return f"greatest(1, least({more('al', 'bm')}, {more('bl', 'am')}))"


def _describer(percent: int, width: int, frequent: np.ndarray):
    """Size, fingerprint, bands and prefix of every set."""
    rank = np.argsort(frequent)
    known = frequent[rank]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, digest, offsets in shingle_sets(batch.column(1), width):
                yield _described(batch.column(0).slice(start, len(offsets) - 1), digest, offsets, percent, known, rank)

    return describe


def _set_describer(percent: int, frequent: np.ndarray):
    """The same for documents of several rows, whose sets are given."""
    rank = np.argsort(frequent)
    known = frequent[rank]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                digest = union(batch.column(1)[row]).copy()
                yield _described(batch.column(0).slice(row, 1), digest, np.array([0, len(digest)]), percent, known, rank)

    return describe


def _described(ids: pa.Array, digest: np.ndarray, offsets: np.ndarray, percent: int, known: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    sizes = np.diff(offsets)
    lows = segments(digest * np.uint64(0x9FB21C651E98DF25), offsets, np.add, 0)
    highs = segments((digest ^ (digest >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93), offsets, np.bitwise_xor, 0)
    bands = _bands(digest, offsets)
    probe = np.where(sizes > 0, sizes - needed(percent, sizes) + 1, 0)
    tokens = _prefix(digest, offsets, probe, known, rank)
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array(sizes), pa.array(lows.view(np.int64)), pa.array(highs.view(np.int64)),
            _lists(bands.reshape(-1), np.full(len(sizes), BANDS)), _lists(tokens, probe),
        ],
        names=[f.split()[0] for f in FACTS.split(", ")],
    )


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def _bands(digest: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    bands = np.zeros((len(offsets) - 1, BANDS), dtype=np.uint64)
    for band in range(BANDS):
        for k in range(ROWS_PER_BAND):
            seed = SEEDS[band * ROWS_PER_BAND + k]
            scrambled = (digest ^ seed) * seed
            scrambled ^= scrambled >> np.uint64(32)
            least = segments(scrambled * seed, offsets, np.minimum, 0)
            bands[:, band] = (bands[:, band] * np.uint64(31) ^ least) * np.uint64(0x9E3779B97F4A7C15)
    return bands


def _prefix(digest: np.ndarray, offsets: np.ndarray, probe: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first ``probe`` tokens of each set: by digest, but frequent ones last and by frequency."""
    sizes = np.diff(offsets)
    if len(known) and len(digest):
        at = np.minimum(np.searchsorted(known, digest), len(known) - 1)
        place = np.where(known[at] == digest, rank[at], -1)
        full = np.flatnonzero(sizes > 0)
        for row in full[np.add.reduceat(place >= 0, offsets[:-1][full]) > 0].tolist():
            a, b = offsets[row], offsets[row + 1]
            digest[a:b] = digest[a:b][np.argsort(place[a:b], kind="stable")]
    return digest[np.repeat(offsets[:-1], probe) + ragged(probe)]


def _meet(percent: int):
    """Members of a chunk that share as many prefix tokens with the query as a link needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, n, tokens, members in zip(*(batch.column(i) for i in range(6))):
                held = members.values
                ids, sizes = np.asarray(held.field("doc_id")), np.asarray(held.field("n"))
                lists = held.field("tokens")
                owner = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()))
                mine = np.sort(np.asarray(tokens.values))
                theirs = np.asarray(lists.flatten())
                at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                common = np.bincount(owner[mine[at] == theirs], minlength=len(ids))
                own = n.as_py()
                overlap = -(-percent * (sizes + own) // (100 + percent))
                least = np.maximum(1, overlap - -(-percent * np.maximum(sizes, own) // 100) + 1)
                fits = (100 * np.minimum(sizes, own) >= percent * np.maximum(sizes, own)) & (common >= least)
                out.extend((a.as_py(), b.as_py(), x.as_py(), int(y), int(c)) for y, c in zip(ids[fits], common[fits]))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "x", "y", "common"])

    return run


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, group) rows; members of a group that meet in a batch give one row for a token."""
    for batch in batches:
        group, size, tokens = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
        counts = np.asarray(tokens.value_lengths()).astype(np.int64)
        token = np.asarray(tokens.flatten())
        owner = np.repeat(np.arange(len(counts)), counts)
        columns = [token, group[owner], size[owner], size[owner]]
        names, inverse, repeats = np.unique(group, return_inverse=True, return_counts=True)
        shared = (repeats[inverse] > 1)[owner]
        if shared.any():
            frame = pd.DataFrame({n: c[shared] for n, c in zip("tglm", columns)})
            merged = frame.groupby(["t", "g"], sort=False).agg({"l": "min", "m": "max"}).reset_index()
            columns = [np.concatenate([c[~shared], merged[n].to_numpy()]) for n, c in zip("tglm", columns)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "group", "least", "most"])


def _frequent(base: DataFrame, width: int) -> np.ndarray:
    """Tokens that repeat inside tasks, most frequent last; fixes the order, never the result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [digest for _, digest, _ in shingle_sets(batch.column(0), width)]
            token, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64),) * 2
            token, n = token[n >= LOCAL_FREQUENT], n[n >= LOCAL_FREQUENT]
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    rows = (
        base.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toArrow()
    )
    order = np.argsort(rows["n"].to_numpy(), kind="stable")
    return rows["token"].to_numpy()[order].view(np.uint64)


def _verified(pairs: DataFrame, base: DataFrame, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """The pairs whose whole sets reach the bound.

    Sets of shortened digests go first, a quarter of the bytes: they share at least as much as the sets
    themselves, so pairs that miss the bound by them are out. Of the rest the whole sets are compared.
    """
    near = _reaching(scratch.write(pairs), base, percent, width, scratch, brief=True)
    return near if near.isEmpty() else _reaching(near, base, percent, width, scratch, brief=False)


def _reaching(pairs: DataFrame, base: DataFrame, percent: int, width: int, scratch: Scratch, brief: bool) -> DataFrame:
    """The pairs whose sets, shortened or whole, reach the bound. Texts without a pair are passed over where they are read."""
    nodes = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    wanted = base.sparkSession.sparkContext.broadcast(build_filter(nodes))
    # both joins below read the one shuffle of this grouping
    sets = _sets(base, nodes, width, wanted, brief)

    reach = _brief_reach if brief else _reach

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                keep.append(reach(left, right, percent))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))],
                names=["a", "b"],
            )

    left = sets.select(F.col("doc_id").alias("a"), F.col("parts").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("parts").alias("y"))
    found = scratch.write(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))
    wanted.unpersist()
    return found


def union(parts: pa.ListScalar) -> np.ndarray:
    """The sorted union of a document's packed sets, one for each of its rows."""
    sets = [np.frombuffer(p.as_buffer(), np.uint64) for p in parts.values]
    return sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets))


def _reach(left: pa.ListScalar, right: pa.ListScalar, percent: int) -> bool:
    """Whether two documents' packed sets reach the bound."""
    x, y = union(left), union(right)
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def shortened(digest: np.ndarray) -> bytes:
    """The high bits of a sorted set, in order and with repeats: 16 of small sets, 32 of large ones, which the first byte tells."""
    if len(digest) <= BRIEF_TOKENS:
        return b"\2" + (digest >> np.uint64(48)).astype(np.uint16).tobytes()
    return b"\4" + (digest >> np.uint64(32)).astype(np.uint32).tobytes()


def _brief_reach(left: pa.ListScalar, right: pa.ListScalar, percent: int) -> bool:
    """Whether two documents can reach the bound as far as their shortened sets tell: never false of those that do."""
    if len(left.values) > 1 or len(right.values) > 1:
        return True  # rows that repeat an id may share tokens, so the size of their union is not known
    x, y = (np.frombuffer(memoryview(s.values[0].as_buffer())[1:], np.uint16 if s.values[0].as_buffer()[0] == 2 else np.uint32) for s in (left, right))
    if x.dtype != y.dtype:
        x, y = (v if v.dtype == np.uint16 else (v >> np.uint32(16)).astype(np.uint16) for v in (x, y))
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())  # each token of the smaller set that is in the other one counts
    return 100 * common >= percent * (len(x) + len(y) - common)


def _sets(base: DataFrame, nodes: DataFrame, width: int, wanted, brief: bool = False) -> DataFrame:
    """``doc_id, parts`` of the ids in ``nodes``, for which ``wanted`` is a filter: a packed set for each row."""
    packed = base.mapInArrow(_packer(width, wanted, brief), "doc_id long, tokens binary").join(nodes, "doc_id", "left_semi")
    return packed.groupBy("doc_id").agg(F.collect_list("tokens").alias("parts"))


def _packer(width: int, wanted, brief: bool):
    pack_set = shortened if brief else np.ndarray.tobytes

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            keep = batch.column(0).is_valid()
            hit = passes(bits, np.asarray(batch.column(0).fill_null(0)))
            batch = batch.filter(pa.array(hit & np.asarray(keep)))
            for start, digest, offsets in shingle_sets(batch.column(1), width):
                blobs = [pack_set(digest[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(blobs)), pa.array(blobs, pa.binary())], names=["doc_id", "tokens"]
                )

    return pack


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM words)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, label) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.label FROM reach r JOIN both_ways e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT node AS doc_id, min(label) AS component_id FROM reach GROUP BY node) r USING (doc_id)
"""


@query("op6_group_jaccard", ORACLE)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents: five-word shingles, Jaccard of 0.75 or more."""
    return similarity_components(table(spark, folder, "documents"))
