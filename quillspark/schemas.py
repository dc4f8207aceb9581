"""Explicit schemas of every file the readers accept; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


S, D, I, L, B, TS = (
    T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType(),
)
INPUTS = struct(original_idea=S, context=S)
OUTPUTS = struct(improved_prompt=S, role=S, directive=S, framework=S, guardrails=S, expected_output=S)
EXAMPLE = struct(inputs=INPUTS, outputs=OUTPUTS, input=S, output=S, metadata=T.MapType(S, S))
# guardrails is a list in some files and a text in others; it is read as text and parsed
COMPONENT = struct(
    source_file=S, domain=S, category=S, role=S, directive=S, framework=S, guardrails=S, confidence=D,
)
SYNTHETIC = struct(
    question=S,
    metadata=struct(task_type=S, domain=S, confidence=D, source_component_id=S, variation=S),
)
HUB_CANDIDATE = struct(
    handle=S, name=S, template=S, tags=STRINGS,
    converted=struct(inputs=INPUTS, outputs=OUTPUTS, metadata=T.MapType(S, S)),
    validation_score=D, validation_passed=B,
)
ASSERTS = struct(
    minFinalPromptLength=I, maxQuestions=I, minConfidence=D, mustNotContain=STRINGS, mustNotHavePlaceholders=B,
    mustNotBeChatty=B, shouldContain=STRINGS,
)
EVAL_CASE = struct(id=S, input=S, tags=STRINGS, ambiguityHints=STRINGS, asserts=ASSERTS)
INTEGRATION_CASE = struct(
    test_id=S, intent=S, complexity=S, idea=S, context=S, expected_quality_score=D,
    assertions=struct(min_length=I, contains_keywords=STRINGS, not_contains_keywords=STRINGS),
)
OLD_CASE = struct(
    id=S, input=S, expected=struct(maxQuestions=I, minConfidence=D, mustNotContain=STRINGS, mustContain=STRINGS),
)
HISTORY = struct(
    id=L, created_at=TS, original_idea=S, context=S, improved_prompt=S, role=S, directive=S, framework=S,
    guardrails=S, reasoning=S, confidence=D, backend=S, model=S, provider=S, latency_ms=I,
)
LOCAL_HISTORY = struct(
    id=S, timestamp=L, prompt=S, meta=struct(confidence=D, clarifyingQuestions=STRINGS, assumptions=STRINGS),
    source=S, inputLength=I, preset=S,
)
TIME_TO_VALUE = struct(t0=L, t_copy=L, ttv_ms=L, source=S, output_length=I, error=S)
ARM_RESULT = struct(
    provider=S, model=S, test_id=S, input=S, improved_prompt=S, role=S, directive=S, framework=S, guardrails=STRINGS,
    reasoning=S, confidence=D, latency_ms=D, error=S,
)
METRICS_DOCUMENT = struct(
    quality=struct(coherence=D, relevance=D, completeness=D, clarity=D, guardrails_count=I, has_structure=B),
    performance=struct(latency_ms=I, total_tokens=L, cost_usd=D, provider=S, model=S, backend=S),
    impact=struct(copy_count=L, regeneration_count=L, feedback_score=I, reuse_count=L),
    metadata=struct(measured_at=TS, framework=S, provider=S, model=S, backend=S),
)
