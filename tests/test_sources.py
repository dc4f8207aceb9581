"""Readers and writers on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.operators import metrics as M
from quillspark.sources import readers as R, writers as W
from quillspark.streaming import jobs as J

EXAMPLE = {"inputs": {"original_idea": "i", "context": ""}, "outputs": {"improved_prompt": "o"}, "metadata": {"k": "v"}}


def put(path, data):
    path.write_text(data if isinstance(data, str) else json.dumps(data), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("shape", [[EXAMPLE, EXAMPLE], {"examples": [EXAMPLE, EXAMPLE]}])
def test_read_examples(spark, tmp_path, shape):
    rows = R.read_examples(spark, put(tmp_path / "a.json", shape)).orderBy("pos").collect()
    assert [r.pos for r in rows] == [0, 1] and rows[0].inputs.original_idea == "i" and rows[0].metadata == {"k": "v"}


def test_other_shapes_stop(spark, tmp_path):
    with pytest.raises(Exception, match="expected an array"):
        R.read_examples(spark, put(tmp_path / "a.json", {"rows": []})).collect()


def test_read_components(spark, tmp_path):
    data = {"components": [
        {"domain": "softdev", "role": "r", "guardrails": ["a", "b"], "confidence": 0.2},
        {"domain": "cooking", "role": "r", "guardrails": "a, b\nc", "confidence": 0.9},
        {"domain": "other", "role": "r", "confidence": 0.1},
    ]}
    rows = R.read_components(spark, put(tmp_path / "c.json", data)).orderBy("pos").collect()
    assert [(r.domain, r.guardrails) for r in rows] == [("softdev", ["a", "b"]), ("other", ["a", "b", "c"])]


def test_read_eval_cases(spark, tmp_path):
    text = '{"id": "good-1", "input": "x", "asserts": {"maxQuestions": 2}}\n\n  \n{"id": "bad-1", "input": "y", "asserts": {}}\n'
    rows = R.read_eval_cases(spark, put(tmp_path / "c.jsonl", text)).orderBy("id").collect()
    assert [(r.id, r.asserts.maxQuestions, r.asserts.minFinalPromptLength, r.tags) for r in rows] == [("bad-1", 5, 50, []), ("good-1", 2, 50, [])]
    with pytest.raises(Exception):
        R.read_eval_cases(spark, put(tmp_path / "d.jsonl", text + "{broken\n")).collect()
    with pytest.raises(Exception, match="missing required field input"):
        R.read_eval_cases(spark, put(tmp_path / "e.jsonl", '{"id": "x", "asserts": {}}\n')).collect()


def test_read_history_log_newest_first(spark, tmp_path):
    text = '{"id": "a", "timestamp": 1, "prompt": "p"}\nnot json\n{"id": "b", "timestamp": 2, "prompt": "q"}\n'
    path = put(tmp_path / "h.jsonl", text)
    assert [r.id for r in R.read_history_log(spark, path).collect()] == ["b", "a"]
    assert [r.value for r in R.read_lenient_lines(spark, path, schemas.LOCAL_HISTORY)[1].collect()] == ["not json"]


def test_read_validated_candidates(spark, tmp_path):
    item = {"handle": "h", "converted": {"inputs": {"original_idea": "i"}, "outputs": {"framework": "RAG"}, "metadata": {"source": "s"}}, "validation_score": 0.75, "validation_passed": True}
    rows = R.read_validated_candidates(spark, put(tmp_path / "v.json", {"candidates": [item, {**item, "validation_passed": False}]})).collect()
    assert len(rows) == 1
    assert rows[0].metadata == {"source": "s", "source_file": "langchain-validated.json", "validation_score": "0.75", "framework": "RAG"}


def test_history_round_trip_and_corruption(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1), ["a"]), (2, dt.datetime(2024, 1, 2), ["b", "c"])]
    df = spark.createDataFrame(rows, "id long, created_at timestamp, guardrails array<string>").withColumn("context", F.lit(None).cast("string"))
    W.append_history(df, str(tmp_path / "h"))
    back = R.decode_history(spark.read.parquet(str(tmp_path / "h"))).orderBy("id").collect()
    assert [(r.guardrails, r.context) for r in back] == [(["a"], ""), (["b", "c"], "")]
    broken = spark.createDataFrame([("{oops", None)], "guardrails string, context string")
    assert R.decode_history(broken).first().guardrails == ["[data corrupted - unavailable]"]


def test_upsert_is_idempotent_and_last_wins(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "prompt_id long, v string").withColumn("measured_at", F.lit(1))
    two = spark.createDataFrame([(2, "c")], "prompt_id long, v string").withColumn("measured_at", F.lit(0))
    path = str(tmp_path / "m")
    for _ in range(2):
        W.upsert_metrics(one, path, 0)
        W.upsert_metrics(two, path, 1)
    assert {r.prompt_id: r.v for r in W.read_upserted(spark, path).collect()} == {1: "a", 2: "c"}
    W.compact(spark, path, str(tmp_path / "n"))
    assert {r.prompt_id: r.v for r in W.read_upserted(spark, str(tmp_path / "n")).collect()} == {1: "a", 2: "c"}


def test_decode_metrics_recomputes(spark):
    good = {
        "quality": {"coherence": 1.0, "relevance": 1.0, "completeness": 1.0, "clarity": 1.0, "guardrails_count": 0, "has_structure": False},
        "performance": {"latency_ms": 5000, "total_tokens": 1000, "cost_usd": 0.01, "provider": "p", "model": "m", "backend": "b"},
        "impact": {"copy_count": 3, "regeneration_count": 0, "feedback_score": None, "reuse_count": 2},
        "metadata": {"measured_at": "2024-01-01T00:00:00Z", "framework": "decomposition", "provider": "p", "model": "m", "backend": "b"},
    }
    bad = {**good, "metadata": {"framework": "nope"}}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad))], "prompt_id long, metrics_json string")
    ok, errors = R.decode_metrics(df)
    row = ok.first()
    assert (row.quality, row.performance) == (1.0, 1.0) and row.impact == pytest.approx(0.9) and row.grade == "A+"
    assert [r.prompt_id for r in errors.collect()] == [2]


def test_context_files(spark, tmp_path):
    a, b = put(tmp_path / "rules.md", "be kind"), put(tmp_path / "agent.md", "be brief")
    gone = str(tmp_path / "none.md")
    rows = R.read_context_files(spark, [b, gone, a]).orderBy("pos").collect()
    assert [(r.content, r.priority, r.category) for r in rows] == [
        ("be brief", 4, "agent"), (f"ERROR: File not found - {gone}", 1, "error"), ("be kind", 5, "instruction")]


def test_context_files_that_cannot_be_read(spark, tmp_path):
    odd, folder, shut, bad = put(tmp_path / "a[1]*{b}.md", "odd name"), tmp_path / "folder", tmp_path / "shut.md", tmp_path / "bad.md"
    put(tmp_path / "a1.md", "not asked for")
    folder.mkdir()
    shut.write_text("secret")
    shut.chmod(0)
    bad.write_bytes(b"\xff\xfe\x00")
    spaced, empty = put(tmp_path / "with space é.md", "spaced"), put(tmp_path / "empty.md", "")
    asked = [odd, str(folder), str(shut), str(bad), spaced, odd, empty]
    rows = R.read_context_files(spark, asked).orderBy("pos").collect()
    assert [(r.pos, r.source) for r in rows] == list(enumerate(asked))
    assert [(r.content.replace(str(tmp_path), ""), r.category) for r in rows] == [
        ("odd name", "general"), ("ERROR: Path is a directory - /folder", "error"), ("ERROR: Permission denied - /shut.md", "error"),
        ("ERROR: Invalid file encoding - /bad.md", "error"), ("spaced", "general"), ("odd name", "general"), ("", "general")]
    assert R.read_context_files(spark, []).count() == 0
    assert [r.category for r in R.read_context_files(spark, [str(tmp_path / "none.md")]).collect()] == ["error"]


def test_migrate_cases(spark):
    def case(i, must=None):
        return {"id": i, "input": "x", "expected": {"maxQuestions": 5, "minConfidence": 0.5, "mustNotContain": ["n"], "mustContain": must}}

    df = spark.createDataFrame([case("bad-004", ["m"]), case("bad-006"), case("good-1", ["m"]), case("good-2"), case("ambig-1", ["m"]), case("x", ["m"])], schemas.OLD_CASE)
    got = {r.id: (r.asserts.maxQuestions, r.asserts.mustNotContain, r.asserts.shouldContain) for r in R.migrate_cases(df).collect()}
    ai = ["as an ai", "as a language model", "hard rules", "output rules"]
    assert got == {
        "bad-004": (2, ["n", "m"], []), "bad-006": (5, ["as an ai language model"], []), "good-1": (5, ai, ["m"]),
        "good-2": (5, ["n"], []), "ambig-1": (5, ai[:2], []), "x": (5, ["n"], ["m"]),
    }


def test_hybrid_cases(spark):
    parts = spark.createDataFrame([(0, "do it"), (1, "")], "pos long, directive string")
    base = R.with_case_defaults(spark.createDataFrame([{"id": f"b{i}", "input": "x", "asserts": {}} for i in range(25)], schemas.EVAL_CASE)).withColumn("pos", F.monotonically_increasing_id())
    rows = R.build_hybrid_cases(parts, base).orderBy("part", "rank").collect()
    assert [r.id for r in rows[:5]] == ["amb-001", "amb-002", "amb-003", "comp-001", "comp-002"]
    assert rows[4].input == "Design component 2 behavior" and len(rows) == 25


def test_ab_results(spark, tmp_path):
    data = {"one": [{"model": "m", "confidence": 0.9}, {"model": "m"}], "two": [{"model": "n"}]}
    df = R.read_ab_results(spark, put(tmp_path / "ab.json", data), ["one", "two"])
    assert sorted((r.arm, r.model) for r in df.collect()) == [("one", "m"), ("one", "m"), ("two", "n")]


def test_pool_and_split_writers(spark, tmp_path):
    df = spark.createDataFrame([("train", 1), ("test", 2)], "split string, id long")
    W.write_split(df, "d", str(tmp_path / "s"))
    assert {r.split: r.dataset_name for r in spark.read.json(str(tmp_path / "s")).collect()} == {"train": "d", "test": "d"}
    W.write_pool(df, df.groupBy("split").count(), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p" / "examples")).count() == 2


def test_ingest_stream_splits_bad_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.jsonl", '{"t0": 1, "ttv_ms": 5}\nbroken\n')
    good, bad = J.ingest_log(spark, str(tmp_path / "in"), schemas.TIME_TO_VALUE)
    assert [r.ttv_ms for r in J.drain(good).collect()] == [5]
    assert [r.value for r in J.drain(bad).collect()] == ["broken"]


def test_prices(spark):
    rows = [("Anthropic", "claude-sonnet-4-5-20250929"), ("anthropic", "other"), ("ollama", "x"), ("nobody", "gpt-4o")]
    got = M.with_prices(spark.createDataFrame(rows, "provider string, model string")).collect()
    assert {(r.provider, r.model): r.rate_in for r in got} == {rows[0]: 0.003, rows[1]: 0.0, rows[2]: 0.0, rows[3]: 0.0}


def test_duplicates_across_documents_are_found(spark, tmp_path):
    from quillspark.operators import pool as P

    row = {"inputs": {"original_idea": "same", "context": ""}, "outputs": {"improved_prompt": "same"}}
    other = {"inputs": {"original_idea": "other", "context": ""}, "outputs": {"improved_prompt": "other"}}
    (tmp_path / "a.json").write_text(json.dumps([row, other]))
    (tmp_path / "b.json").write_text(json.dumps([row]))
    rows = R.read_examples(spark, str(tmp_path)).select("source_path", "pos", "inputs.original_idea", "inputs.context", "outputs.improved_prompt")
    got = [(r.source_path[-6:], r.pos) for r in P.dedup_by_input(rows).collect()]
    assert sorted(got) == [("a.json", 0), ("a.json", 1)]
    assert P.dedup_by_io(rows, ("pos",)).count() == 2


def test_stored_history_reads_and_rewrites_only_days_in_question(spark, tmp_path):
    from quillspark.operators import store as T

    path = str(tmp_path / "h")
    rows = [(n, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * n), ["g"]) for n in range(40)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp, guardrails array<string>")
    W.append_history(df.filter("id % 2 = 0"), path)
    W.append_history(df.filter("id % 2 = 1"), path)
    at = lambda text: F.lit(text).cast("timestamp")
    found = T.by_date_range(spark.read.parquet(path), at("2024-01-03 00:00:00"), at("2024-01-04 00:00:00"), 100)
    assert {r.id for r in found.collect()} == {n for n, t, _ in rows if dt.datetime(2024, 1, 3) <= t <= dt.datetime(2024, 1, 4)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "h").glob("day=*/*.parquet")}
    for _ in range(2):
        W.retain_history(spark, path, "2024-01-14 12:00:00", 10)
        left = spark.read.parquet(path).collect()
        assert {r.id for r in left} == {n for n, t, _ in rows if t >= dt.datetime(2024, 1, 4, 12)}
    later = [f for f in before if f.parent.name > "day=2024-01-04"]
    assert later and all(f.stat().st_mtime_ns == before[f] for f in later)
    assert not list((tmp_path / "h").glob("day=2024-01-0[123]"))
    W.retain_history(spark, path, "2025-01-01 00:00:00", 10)  # nothing is young enough
    assert not list((tmp_path / "h").glob("day=*"))


def test_appended_days_are_few_files(spark, tmp_path):
    from quillspark.sources import writers as W

    at = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(id % 20 as int), 0, 0, 0)")
    history = spark.range(0, 400, 1, 8).select("id", at.alias("created_at"), F.array(F.lit("a")).alias("guardrails"))
    history = history.unionByName(spark.range(400, 404).select("id", F.lit(None).cast("timestamp").alias("created_at"), F.array(F.lit("a")).alias("guardrails")))
    path = str(tmp_path / "history")
    W.append_history(history, path)
    assert len(list((tmp_path / "history").glob("day=*"))) == 21
    assert len(list((tmp_path / "history").glob("day=*/*.parquet"))) == 21  # not one for each task
    W.append_history(history.filter("id < 40"), path)
    assert spark.read.parquet(path).groupBy("id").count().filter("count = if(id < 40, 2, 1)").count() == 404


def test_stored_days_are_listed_by_few_tasks(spark, tmp_path):
    at = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(id as int), 0, 0, 0)")
    days = 10 * spark.sparkContext.defaultParallelism
    path = str(tmp_path / "history")
    W.append_history(spark.range(days).select("id", at.alias("created_at"), F.array(F.lit("a")).alias("guardrails")), path)
    spark.sparkContext.setJobGroup("few", "")
    try:
        W.retain_history(spark, path, "2024-01-14 00:00:00", 10)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    seen = spark.sparkContext.statusTracker()
    stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup("few") for s in seen.getJobInfo(j).stageIds]
    assert 0 < max(s.numTasks for s in stages if s) < days / 2
    assert sorted(r.id for r in spark.read.parquet(path).select("id").collect()) == list(range(3, days))
