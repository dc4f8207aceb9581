"""Every stage of the pipeline against plain Python: nulls, empty and very long texts, repeats, empty tables, clashing names."""

import random
import zlib

import pytest
import tokenizers

import corpus_pipeline as P
from quillspark.llm import packing, pii, toxicity
from tests.llm.test_jaccard import plain
from tests.llm.test_long_repetitive import plain_overlaps

WORDS = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "le", "mo", "nu") for b in ("ran", "sel", "tim", "vok", "wes", "zar", "pil", "kod")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h string, item long, y int, component_id long, n long"


def document(i, text):
    return (i, text, "en", "web", None if text is None else len(text), 0.5, "h", 3, 1, 7, None)


def made_rows():
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(0, text(30)), (1, text(40)), (1, text(25)), (2, None), (3, ""), (None, text(30))]
    rows = [document(i, text(rng.choice([6, 30, 90, 200]))) for i in range(90)]
    copied = rows[3][1].split()
    rows += [
        document(100, rows[5][1]), document(101, rows[5][1].upper()),  # copies
        document(102, " ".join(copied[:-1] + ["other"]) if len(copied) > 40 else rows[3][1]),
        document(103, f"{text(40)} {items[0][1]} {text(20)}"), document(104, f"{text(10)} {' '.join(items[1][1].split()[:20])}"),
        document(105, f"{text(12)} write to ann@example.org or 10.0.0.7 or +49 30 1234567 soon"),
        document(106, None), document(107, ""), document(108, " \t\n"), document(109, "one"), document(110, "one"),
        document(111, text(30_000)), document(112, "a@b.cc " * 3000), document(7, rows[7][1]), document(8, text(50)),
        document(None, rows[5][1]), document(None, None), document(None, items[0][1]), document(9, None),
    ]
    rows += [document(i, text(rng.choice([6, 12, 20]))) for i in range(300, 700)]
    for i in range(200, 260):  # toxic documents
        rows.append(document(i, f"{text(15)} {rng.choice(['grumblor', 'vexnit'])} {text(15)}"))
    labels = [(i, int(i < 300 and i >= 200)) for i in [*range(0, 90, 2), *range(200, 250), *range(300, 690)]] + [(1, None), (None, 1), (4, 0), (999, 1)]
    return rows, labels, items


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels, items = made_rows()
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, doc_id long").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def held(rows):
    return sorted(map(str, rows))


def test_toxic_documents_go(spark, tables):
    docs = docs_of(spark, tables)
    rows = docs.collect()
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    kept = P.drop_toxic(spark, docs, tables)
    assert kept.schema == docs.schema
    got = kept.collect()
    assert held(got) == held(r for r in rows if lexicon.score(r["text"]) < 0.5)
    ids = {r["doc_id"] for r in got}
    assert not ids & set(range(200, 260)) and {*range(90), *range(300, 700)} <= ids


def test_one_document_of_each_group_stays(spark, tables):
    docs = docs_of(spark, tables)
    rows = docs.collect()
    gone = {i for i, _, component in plain([(r["doc_id"], r["text"]) for r in rows]) if i is not None and component != i}
    kept = P.drop_near_duplicates(spark, docs, tables)
    assert kept.schema == docs.schema and {100, 101, 110} <= gone
    assert held(kept.collect()) == held(r for r in rows if r["doc_id"] not in gone)


def test_contaminated_documents_go(spark, tables):
    docs = docs_of(spark, tables).filter("doc_id is null or doc_id not in (111, 112)")  # the double loop is slow on long texts
    rows = docs.collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    bad = {d for d, *_ in plain_overlaps([(r["doc_id"], r["text"]) for r in rows], items)}
    kept = P.drop_contaminated(spark, docs, tables)
    assert set(kept.columns) == set(docs.columns) and {103, 104} <= bad
    assert held(kept.select(docs.columns).collect()) == held(r for r in rows if r["doc_id"] not in bad)
    long = docs_of(spark, tables).filter("doc_id in (111, 112)")
    assert P.drop_contaminated(spark, long, tables).count() == 2


def test_private_data_is_replaced(spark, tables):
    docs = docs_of(spark, tables)
    weights = pii.form_weights(docs)
    kept = P.redact_private(spark, docs, tables)
    assert kept.schema == docs.schema
    want = []
    for r in docs.collect():
        text = r["text"]
        spans = pii.base_spans(text) if text else []
        if spans:
            text = pii.replaced(text, spans + pii.added_spans(text, spans, weights))
        changed = {"text": text, "n_chars": r["n_chars"] if text is None else len(text)}
        want.append(tuple((r.asDict() | changed).values()))
    assert held(map(tuple, kept.collect())) == held(want)
    shown = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert shown[105].endswith("write to [EMAIL] or [IP] or [PHONE] soon") and "@" not in shown[112]


def test_every_token_is_packed_once(spark, tables):
    docs = docs_of(spark, tables)
    encoder = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    ids = lambda t: [*encoder.encode(t or "", add_special_tokens=False).ids, 2]
    want = sorted(zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids(r["text"]))) for r in docs.filter("doc_id <> 111").collect() if len(ids(r["text"])) <= 4096)
    pieces = P.pack_windows(spark, docs, tables).collect()
    assert sorted(p["ids_crc32"] for p in pieces if p["length"] == p["doc_tokens"] and p["doc_id"] not in (None, 111)) == want
    assert sum(p["length"] for p in pieces) == sum(len(ids(r["text"])) for r in docs.collect())
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for held_there in windows.values():
        at = 0
        for offset, length in sorted(held_there):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_in_a_row_and_as_one(spark, tables):
    docs = docs_of(spark, tables)
    for _, stage in P.STAGES[:-1]:
        after = stage(spark, docs, tables)
        assert set(after.columns) == set(docs.columns)
        docs = after.select(docs.columns)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, SCHEMA)
    kept = {}
    for r in rows:
        kept[r["doc_id"]] = kept.get(r["doc_id"], 0) + 1
    pieces = P.run(spark, tables).collect()
    firsts = {}
    for p in pieces:
        if p["start"] == 0:
            firsts[p["doc_id"]] = firsts.get(p["doc_id"], 0) + 1
    assert firsts == kept and set(range(300, 700)) <= set(kept)
    assert not set(range(200, 260)) & set(firsts) and not {100, 101, 103, 104, 110} & set(firsts)


@pytest.mark.parametrize("missing", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, tables, tmp_path, missing):
    folder = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{tables}/{name}.parquet")
        (rows.filter("false") if name == missing else rows.filter("doc_id is null or doc_id < 100")).write.parquet(f"{folder}/{name}.parquet")
    got = P.run(spark, folder)
    assert (got.count() == 0) == (missing == "documents")
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, docs_of(spark, folder), folder)
        assert (kept.count() == 0) == (missing == "documents")


def test_texts_that_stay_are_not_shuffled_to_drop_a_few(spark):
    """Without a broadcast the join shuffles listed rows only; nulls, repeats and great ids are as in a left anti join."""
    from quillspark.llm import idfilter

    great = (1 << 62) + 1
    rows = [(i, "t" * 50) for i in range(2000)] + [(None, "null"), (None, "null"), (7, "again"), (8, "again"), (great, "a"), (great + 1, "b"), (-3, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = spark.createDataFrame([(7,), (0,), (great,), (99999,)], "doc_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        kept = idfilter.without(docs, ids, "doc_id")
        assert sorted(map(str, kept.collect())) == sorted(map(str, docs.join(ids, "doc_id", "left_anti").select("doc_id", "text").collect()))
        tree = kept._jdf.queryExecution().optimizedPlan().toString()
        assert tree.startswith("Union") and "LeftAnti" in tree
        assert kept.columns == docs.columns and idfilter.without(docs.filter("false"), ids.filter("false"), "doc_id").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_arrow_batches_are_bounded_in_bytes(spark):
    """Rows that hold many long lists, as those of the n-gram join's meetings, come to Python a few at a time."""
    import pyarrow as pa

    from quillspark.llm.common import BATCH_BYTES, BATCH_MOST
    from quillspark.llm.scratch import Scratch

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get(BATCH_BYTES)
    with Scratch(spark) as scratch:
        rows = spark.range(0, 400, 1, 1).selectExpr("array_repeat(id, 10000) as members")  # 80 kB a row
        got = [r.n for r in scratch.write(rows.mapInArrow(count, "n long")).collect()]
    assert sum(got) == 400 and max(got) <= 2 * BATCH_MOST // 80_000
    assert spark.conf.get(BATCH_BYTES) == before
