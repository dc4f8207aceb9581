"""Extraction, scores and repair against Python's own regular expressions and arithmetic."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark import fixed
from quillspark.functions import checks as C, classify as K, extract as X, scores as S, text as TX
from quillspark.operators import normalize as N, pool as P, validate as V

TEMPLATES = [
    "You are a senior data analyst. Your task is to help people read charts\nwith care.\n\nDo not guess at numbers. Never share private data! Use at most 3 sentences.",
    "Role: Careful   editor\nGoal: fix the text.\nConstraint: keep it short\n  and sweet\n\nOnly: plain words",
    "Thought: think\nAction: search\nObservation: none\nYou are an agent who can use a tool. Question: why?",
    "Answer the question using the retrieved context {context}. Keep answers to one line.\nCANNOT lie about it",
    "", "   \n\n  ", "Act as a café owner who sells tea, and be kind. Limit yourself to: 5 words.\n",
]


def squeeze(t):
    return re.sub(r"\s+", " ", t.strip())


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEMPLATES)], "i long, t string")


def run(frame, column):
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


def test_basic_guardrails(frame):
    want = []
    for t in TEMPLATES:
        found = [m.group(0) for p in fixed.BASIC_GUARDRAILS for m in re.finditer(p, t.strip(), re.I | re.M)]
        want.append(", ".join(g for g in map(squeeze, found) if g))
    assert run(frame, X.basic_guardrails(F.col("t"))) == want


def test_ranked_guardrails(frame):
    want = []
    for t in TEMPLATES:
        parts = []
        for name, signs in fixed.GUARDRAIL_SIGNS.items():
            found = [squeeze(m.group(g)) for p, g in signs for m in re.finditer(p, t.strip(), re.I | re.M)]
            found = [f for f in found if len(f) > 5]
            if found:
                parts.append(f"{name.capitalize()}: {', '.join(found[:3])}")
        want.append(" | ".join(parts))
    assert run(frame, X.ranked_guardrails(F.col("t"))) == want


def test_stated_directive(frame):
    for pattern in fixed.BASIC_DIRECTIVES + fixed.RANKED_DIRECTIVES:
        want = [(m.group(1) if (m := re.search(pattern, t.strip(), re.I | re.M)) else None) for t in TEMPLATES]
        assert run(frame, TX.first_match(TX.strip(F.col("t")), TX.rx(pattern, "im"))) == want


def test_ranked_role(frame):
    want = []
    for t in TEMPLATES:
        roles = [squeeze(m.group(1)) for p in fixed.RANKED_ROLES for m in re.finditer(p, t.strip(), re.I)]
        guess = "Tool-Using Agent" if "agent" in t.lower() and "tool" in t.lower() else "AI Assistant"
        want.append(max(roles, key=lambda r: len(r.split())) if roles else guess)
    assert run(frame, X.ranked_role(F.col("t"))) == want


def test_detections(frame):
    tags = F.array(F.lit("Agent"))
    got = [r.d for r in X.with_detections(frame.withColumn("tags", tags), "t", "tags", "d").orderBy("i").collect()]
    for t, found in zip(TEMPLATES, got):
        low, want = t.lower(), []
        for name, (keywords, patterns) in fixed.FRAMEWORK_SIGNS.items():
            sure = 0.0
            for k in keywords:
                sure += 0.15 if k in low else 0
            for k in keywords:
                sure += 0.25 if k == "agent" else 0
            for p in patterns:
                sure += 0.3 if re.search(p, low) else 0
            if sure >= 0.3 or "agent" in keywords:
                want.append((name, min(sure, 1.0)))
        want.sort(key=lambda d: -d[1])
        assert [(d.name, pytest.approx(d.confidence)) for d in found] == want


def test_strip_and_words_follow_unicode(spark):
    text = " \t a\xa0b　c \x1c"
    row = spark.createDataFrame([(text,)], "t string").select(TX.strip(F.col("t")), TX.words(F.col("t"))).first()
    assert (row[0], row[1]) == (text.strip(), text.split())


@pytest.mark.parametrize("text", ["", "a", "abc", "ÀbÀ", "a\nb"])
def test_bigrams(spark, text):
    low = text.lower()
    got = spark.createDataFrame([(text,)], "t string").select(TX.bigrams(F.col("t"))).first()[0]
    assert got == [low[i : i + 2] for i in range(len(low) - 1)]


@pytest.mark.parametrize(
    "latency,cost,tokens,want",
    [(5000, 0.01, 1000, 1.0), (30000, 0.10, 5000, 0.0), (17500, 0.01, 1000, 0.75), (0, 0.0, 0, 1.0), (40000, 0.2, 9000, 0.0)],
)
def test_performance_edges(spark, latency, cost, tokens, want):
    got = spark.range(1).select(S.performance_score(F.lit(latency), F.lit(cost), F.lit(tokens))).first()[0]
    assert got == pytest.approx(want)


def test_coherence_lengths(spark):
    texts = ["x" * 99, "x" * 100, "x" * 501, "x" * 250 + "\n" + "x" * 250, "# A\n\n- b\n1. c" + "x" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(S.coherence(F.col("t")))
    assert [round(r[0], 6) for r in df.collect()] == [0.3, 0.5, 0.35, 0.35, 0.95]


@pytest.mark.parametrize("copies,again,feedback,reuse,want", [(0, 0, None, 0, 0.15), (3, 0, 5, 2, 1.0), (1, 1, 0, 0, 0.4)])
def test_impact(spark, copies, again, feedback, reuse, want):
    rate = S.success_rate(F.lit(copies), F.lit(again))
    got = spark.range(1).select(S.impact_score(F.lit(copies), rate, F.lit(feedback).cast("int"), F.lit(reuse))).first()[0]
    assert got == pytest.approx(want)


@pytest.mark.parametrize(
    "idea,context,want",
    [
        ("arregla esto", "but it fails", "refactor"), ("explain the error", "", "explain"), ("optimize this query", "", "refactor"),
        ("it has a bug", "", "debug"), ("haz una app", "", "generate"), ("cómo funciona esto", "", "explain"), ("improved", "", "generate"),
    ],
)
def test_intents(spark, idea, context, want):
    assert spark.range(1).select(K.intent(F.lit(idea), F.lit(context))).first()[0] == want


def test_structured_intent_comes_first(spark):
    got = spark.range(1).select(K.intent(F.lit("explain"), F.lit(""), F.lit("x = 1"), F.lit("NameError"))).first()[0]
    assert got == "debug"


@pytest.mark.parametrize(
    "text,limit,want",
    [("a" * 8 + "." + "b" * 5, 10, "a" * 8 + "."), ("a" * 8 + "\n" + "b" * 5, 10, "a" * 8), ("a" * 20, 10, "a" * 10 + "..."), ("a.bbbbbbbbbbbb", 10, "a.bbbbbbbb...")],
)
def test_truncation(spark, text, limit, want):
    assert spark.range(1).select(N.truncate_at_sentence(F.lit(text), limit)).first()[0] == want


def test_question_lines(spark):
    row = spark.range(1).select(N.strip_question_lines(F.lit("do it\n¿qué\nWhy  so?\nwhy so?\nend"), F.array(F.lit("Old")))).first()[0]
    assert (row.improved_prompt, row.clarifying_questions) == ("do it\nend", ["Old", "¿qué", "Why so?"])


def test_autocorrect(spark):
    shape = "template string, constraints struct<max_tokens:int,format:string,include_examples:boolean,include_explanation:boolean>"
    rows = [
        ("Please write the parser\ndef f():\n  pass", (500, "markdown", False, False)), ("You are here, use `x` ```y``` now", (500, "no_markdown", False, False)),
        ("You are complete and long enough", (500, None, False, False)),
    ]
    got = [(r.template, r.passed) for r in V.autocorrect(spark.createDataFrame(rows, shape)).collect()]
    assert got[0] == (fixed.ANSWER_ROLE_HEADER + "Please write the parser\n```python\ndef f():\n  pass\n```", True)
    assert got[1] == ('You are here, use "x" y now', True)
    assert got[2] == (rows[2][0], True)


def test_dedup_is_stable_and_idempotent(spark):
    rows = [(3, "a", "x"), (1, "a", "x"), (2, "a", "y"), (4, "b", "x"), (5, "b", "x")]
    df = spark.createDataFrame(rows, "pos long, original_idea string, improved_prompt string").withColumn("context", F.lit(""))
    once = P.dedup_by_io(df.withColumn("source_rank", F.lit(0)))
    assert sorted(r.pos for r in once.collect()) == [1, 2, 4]
    again = P.dedup_by_io(once.drop("io_hash", "duplication_status").repartition(3))
    assert sorted(r.pos for r in again.collect()) == [1, 2, 4]
    assert sorted(r.pos for r in P.dedup_by_input(df).collect()) == [1, 4]


def test_repeated_words(spark):
    texts = ["word word word word", "word word word", "the the the the the", "Word wORD word x word"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(C.has_repeated_word(TX.words(F.col("t"))))
    assert [r[0] for r in df.collect()] == [True, False, False, True]


def test_recovery_refuses_what_a_browser_refuses(spark):
    from quillspark.operators.recover import recover_json

    texts = ['{"a": NaN}', '{"a": 1}', 'x {"b": "}"} y', 'x {"c": "\\""', '```json\n{"d": {"e": 2}}\n```']
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, raw string")
    got = {r.id: (r.ok, r.method, r.json) for r in recover_json(rows, "raw").collect()}
    assert got[0][0] is False and got[1] == (True, None, '{"a": 1}')
    assert got[2] == (True, "scan", '{"b": "}"}') and got[3][0] is False and got[4] == (True, "fence", '{"d": {"e": 2}}')


def _exchanged(df):
    """Columns that go through any exchange of the plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return " ".join(part.split("Input", 1)[1].splitlines()[0] for part in plan.split("\n(") if "Exchange" in part.split("\n")[0] and "Input" in part)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_first_wins_shuffles_no_texts(spark, tmp_path, monkeypatch, limit):
    from quillspark.operators import pool as P

    rows = [(i, f"idea {i % 40}", "", f"prompt {i % 30} " * 20) for i in range(400)] + [(500, None, None, None), (501, None, None, None)]
    spark.createDataFrame(rows, "pos long, original_idea string, context string, improved_prompt string").repartition(4).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    monkeypatch.setattr(P, "BROADCAST_BYTES", limit)
    first = P.dedup_by_input(df)
    seen = {}
    for pos, idea, context, _ in rows:
        seen.setdefault((idea, context), pos)
    assert sorted(r.pos for r in first.collect()) == sorted(seen.values())
    assert "improved_prompt" not in _exchanged(first) or limit == 0
    merged, added = P.merge_into(df.filter("pos < 100"), df)
    pairs = {}
    for pos, idea, _, prompt in rows:
        pairs.setdefault((idea or "", prompt or ""), pos)
    assert merged.count() == len(pairs) and sorted(r.pos for r in added.collect()) == sorted(p for p in pairs.values() if p >= 100)
    members = P.duplicate_members(df, P.input_key()).select("pos", "first_pos", "occurrences")
    assert "improved_prompt" not in _exchanged(members)
    assert {r.pos: r.first_pos for r in members.collect()} == {p: seen[(i, c)] for p, i, c, _ in rows}


def test_recovery_is_one_python_step(spark):
    from quillspark.operators.recover import recover_json

    raw = [None, "", '{"a": 1}', "x ```json\n{\"a\": 1}\n``` {}", "```{```<json>{\"b\": 2}</json>", "see {\"c\": {}} {", "{a}", "NaN", "<json>{</json>{"]
    rows = recover_json(spark.createDataFrame(list(enumerate(raw)), "id int, raw string"), "raw")
    want = [
        (None, None, False), (None, None, False), ('{"a": 1}', None, True), ('{"a": 1}', "fence", True), ('{"b": 2}', "tag", True),
        ('{"c": {}}', "scan", True), ("{a}", "scan", False), (None, None, False), (None, None, False),
    ]
    assert [(r.json, r.method, r.ok) for r in rows.orderBy("id").collect()] == want
    # each such node is a Python worker of its own for every task
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
