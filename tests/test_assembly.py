"""Assembled prompts, generated examples, sanitising and guards."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark import fixed
from quillspark.functions import classify as K, extract as X
from quillspark.operators import normalize as N, pool as P, retrieve as R, store as T
from quillspark.sources import writers as W


def test_fewshot_prompts(spark):
    asked = spark.createDataFrame(
        [(1, "sort it", "ctx", "simple", "Developer", "x = 1", "", "go"), (2, "refactor it", "", "complex", "Architect", "", "boom", "")],
        "query_id long, idea string, context string, complexity string, prompt_role string, code_snippet string, error_log string, target_language string",
    )
    found = spark.createDataFrame([(1, 10, 1), (2, 10, 2), (2, 11, 1)], "query_id long, catalog_id long, rank int")
    examples = spark.createDataFrame([(10, "in", "", "out"), (11, "in2", "c2", "out2")], "catalog_id long, input_idea string, input_context string, output string")
    got = {r.query_id: r for r in R.fewshot_prompts(asked, found, examples).collect()}
    assert got[1].template == "\n".join([
        "# Role\nYou are a Developer.", "", "# Task", "sort it", "", "# Context", "ctx", "", "# Code", "```", "x = 1", "```", "",
        "# Target Language: go", "", "# Examples", "Here are some similar examples to guide you:", "", "## Example 1", "**Input:** in", "**Output:** out", "",
    ])
    assert got[2].template == "\n".join([
        "# Role", "You are a Architect.", "", "# Understanding the Request", "First, let me rephrase the request to ensure clarity:", "",
        "**Original Request:** refactor it", "**Rephrased Understanding:** Debug and fix the error", "", "# Task", "Based on the above understanding, please:",
        "", "## Error Information", "boom", "", "## Reference Examples", "These examples may help guide your approach:", "",
        "### Example 1", "**Request:** in2", "**Context:** c2", "**Response:** out2", "", "### Example 2", "**Request:** in", "**Response:** out", "", "",
        "## Requirements", "- Provide a clear, well-structured response", "- Include code examples where applicable", "- Explain your reasoning",
    ])
    assert (got[1].fewshot_count, got[2].fewshot_count) == (1, 2)


def test_template_from_messages(spark):
    rows = [
        (["You are kind.", "", "Answer {question}", "input_variables=[]"], "ignored"), ([], 'X(template="a\\nb") Y(template="{input}")'),
        (None, "X(template='its')"), ([], "nothing here"),
    ]
    df = spark.createDataFrame(rows, "m array<string>, r string")
    none = F.array().cast("array<string>")
    got = [r[0] for r in df.select(X.template_from_messages(F.coalesce("m", none), F.col("r"))).collect()]
    assert got == ["You are kind.\n\nAnswer {question}", "a\nb", "its", "nothing here"]


def test_sanitize_output(spark):
    df = spark.createDataFrame(
        [(None, ["a", None], None, None), ("  ok", None, [], 0.2)],
        "improved_prompt string, clarifying_questions array<string>, assumptions array<string>, confidence double",
    )
    got = [tuple(r) for r in N.sanitize_output(df).collect()]
    assert got == [("Error: Invalid prompt", ["a"], [], 0.5), ("  ok", [], [], 0.2)]


@pytest.mark.parametrize(
    "variation,template,want",
    [
        ("simplify", "You are a x. Do y.", "You are a x."), ("expand", "You are a x.", "You act as a highly experienced and knowledgeable x."),
        ("expand", "Apply it.", "Apply it." + fixed.EXPANSION_TAIL), ("add_context", "Do it.", "Do it." + fixed.CONTEXT_TAIL),
        ("restructure", "One a. Two b.", "Two b. One a."), ("restructure", "Only one.", "Only one."), (None, "As is", "As is"),
    ],
)
def test_variations(spark, variation, template, want):
    assert spark.range(1).select(N.vary(F.lit(template), variation)).first()[0] == want


def test_expand_examples(spark):
    rows = [("f", "softdev", "coder.", "", "CoT", 0.5), ("g", "weird", " ", "help.", "", 0.9)]
    df = spark.createDataFrame(rows, "source_file string, domain string, role string, directive string, framework string, confidence double")
    got = N.expand_examples(df, 4, seed=1).collect()
    assert len(got) == 8 and {r.role for r in got} == {"coder", "assistant"}
    assert {r.directive for r in got} == {"assist with software development tasks", "help"}
    assert all(r.example[-1] in ".!?" and ".." not in r.example and "{" not in r.example for r in got)
    again = N.expand_examples(df.repartition(3), 4, seed=1).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_hub_ideas(spark):
    df = spark.createDataFrame(
        [("u/react-chat", None, "You are a helpful guide. Think step by step.", ["x"]), ("u/plain", None, "Say hi", [])],
        "handle string, name string, template string, tags array<string>",
    )
    got = {r.handle: r for r in N.hub_to_example(df).collect()}
    assert got["u/react-chat"].inputs.original_idea == "Create chain-of-thought agent prompt for helpful guide using react pattern prompt"
    assert got["u/plain"].inputs.original_idea == "using plain pattern prompt"
    assert got["u/plain"].outputs.role == "AI Assistant"


def test_skip_rate_guard(spark):
    df = spark.range(100)
    state = lambda bad: P.skip_rate_guard(df, F.col("id") >= bad).first().status
    assert [state(b) for b in (0, 1, 5, 19, 20, 100)] == ["ok", "warn", "degraded", "degraded", "fail", "fail"]
    with pytest.raises(Exception, match="too many bad records"):
        P.skip_rate_guard(df, F.col("id") >= 50, stop=True).collect()


def test_routes_and_normalisation(spark):
    df = spark.createDataFrame([("debug_runtime", "complex"), ("refactor", "moderate"), ("other", "simple")], "intent string, complexity string")
    assert [r.strategy for r in N.with_route(df).collect()] == ["complex_debug", "complex_refactor", "simple"]
    names = ["Chain of thought", " ROLE-playing", "ToT", "Decomposition!", "magic"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(N.normalize_framework(F.col("n")).alias("f")).collect()
    assert [(r.f.framework, r.f.used_fallback) for r in got] == [
        ("chain-of-thought", False), ("role-playing", False), ("tree-of-thoughts", False), ("decomposition", False), ("decomposition", True)]


def test_category_of_meta_prompts(spark):
    got = spark.createDataFrame([("Crea un prompt para React",), ("Escribe un test",), ("hola",)], "t string").select(K.category(F.col("t")).alias("c")).collect()
    assert [(r.c.is_meta_prompt, r.c.category, r.c.confidence) for r in got] == [
        (True, "Uncategorized", "low"), (False, "Testing", "medium"), (False, "Uncategorized", "low")]


def test_retention_rewrites_only_its_days(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 2), "2024-01-0%d" % (1 + i % 2)) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp, day string")
    path = str(tmp_path / "h")
    df.write.partitionBy("day").parquet(path)
    W.retain_days(df.filter("day = '2024-01-01' and id < 3"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 5]
    kept, gone = T.retain(df, F.lit("2024-01-03 00:00:00").cast("timestamp"), 1)
    assert (kept.count(), gone.first().deleted) == (3, 3)


def test_bare_scores_lookup(spark):
    prompts = spark.createDataFrame([("auth_001",), ("x",)], "id string")
    scores = spark.createDataFrame([("security_auth_001", 0.5)], "id string, score double")
    assert {r.id: r.validator_score for r in P.score_lookup(prompts, scores).collect()} == {"auth_001": 0.5, "x": 0.96}


def test_nested_values(spark):
    from quillspark.operators.normalize import nested_value

    cases = [
        ('{"a": {"b": {"c": "x"}}}', "x"), ('{"a": {"b": {"c": 5}}}', "5"), ('{"a": {"b": {"c": null}}}', None), ('{"a": {"b": {}}}', None),
        ('{"a": {"b": "c"}}', None), ('{"a": [1, 2]}', None), ("{}", None), ("[]", None), ('"a"', None), ('{"a": ', None), ("", None), (None, None),
        ('{"a": {"b": {"c": {"d": 1}}}}', '{"d":1}'),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i long, t string")
    got = {r.i: r.v for r in df.select("i", nested_value(F.col("t"), "a.b.c").alias("v")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    odd = spark.createDataFrame([('{"a b": {"c-d": 1}}',)], "t string")
    assert odd.select(nested_value(F.col("t"), "a b.c-d")).first()[0] == "1"
