"""The spots where no expression has the wanted JSON behaviour; all run on Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# braces, and strings as wholes; a string that never ends runs to the end of the text
JSON_PIECES = re.compile(r'[{}]|"(?:[^"\\]|\\.)*+(?:"|\\?\Z)', re.S)

FACTS = T.StructType(
    [
        T.StructField("valid", T.BooleanType()),
        T.StructField("truthy", T.BooleanType()),
        T.StructField("kind", T.StringType()),
        T.StructField("key_count", T.IntegerType()),
        T.StructField("leaf_total", T.IntegerType()),
        T.StructField("leaf_empty", T.IntegerType()),
        T.StructField("filled_keys", T.ArrayType(T.StringType())),
    ]
)


def _refuse(name: str) -> None:
    raise ValueError(name)


def parse_or_none(text: str, strict: bool = False) -> tuple[bool, object]:
    """Whether the text is JSON, and its value; gates take NaN and infinities, recovery (``strict``) does not."""
    try:
        return True, json.loads(text, parse_constant=_refuse) if strict else json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def leaf_counts(value: object) -> tuple[int, int]:
    """Scalars below ``value`` and how many of them are empty; walks with a stack, not recursion."""
    total = empty = 0
    stack = [value]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            stack.extend(node.values())
        elif isinstance(node, list):
            stack.extend(node)
        else:
            total += 1
            empty += node is None or node == ""
    return total, empty


def facts_of(text: str | None) -> tuple | None:
    if text is None:
        return None
    valid, value = parse_or_none(text)
    if not valid:
        return (False, False, None, None, None, None, None)
    total, empty = leaf_counts(value)
    is_map = isinstance(value, dict)
    kind = "object" if is_map else "array" if isinstance(value, list) else "scalar"
    filled = [k for k, v in value.items() if v] if is_map else None
    return (True, bool(value), kind, len(value) if is_map else None, total, empty, filled)


@F.pandas_udf(FACTS)
def _json_facts(texts: pd.Series) -> pd.DataFrame:
    rows = [facts_of(t) or (None,) * len(FACTS) for t in texts]
    return pd.DataFrame(rows, columns=FACTS.fieldNames())


def json_facts(text: Column) -> Column:
    """Validity, truthiness, shape and leaf counts of a JSON text; null in, nulls out."""
    return _json_facts(text)


@F.pandas_udf(T.BooleanType())
def _json_valid(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else parse_or_none(t)[0] for t in texts], dtype="object")


def json_valid(text: Column) -> Column:
    return _json_valid(text)


def balanced_object(text: str | None) -> str | None:
    """The text from the first opening brace to its partner, braces in strings not counted."""
    if text is None:
        return None
    start = text.find("{")
    depth = 0
    for piece in JSON_PIECES.finditer(text, start) if start >= 0 else ():
        if piece.group() == "{":
            depth += 1
        elif piece.group() == "}":
            depth -= 1
            if not depth:
                return text[start : piece.end()]
    return None


@F.pandas_udf(T.BooleanType())
def _json_strict(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else parse_or_none(t, strict=True)[0] for t in texts], dtype="object")


def json_strict(text: Column) -> Column:
    """Validity as a browser's parser sees it."""
    return _json_strict(text)


RECOVERED = T.StructType(
    [T.StructField("json", T.StringType()), T.StructField("method", T.StringType()), T.StructField("ok", T.BooleanType())]
)


def recovered(text: str | None, fence: str | None, tag: str | None) -> tuple[str | None, str | None, bool]:
    """JSON of a response, how it was found (none: parsed as it is), and whether it is valid."""
    if text is None:
        return None, None, False
    if parse_or_none(text, strict=True)[0]:
        return text, None, True
    for method, part in (("fence", fence), ("tag", tag), ("scan", text)):
        found = balanced_object(part)
        if found is not None:
            return found, method, parse_or_none(found, strict=True)[0]
    return None, None, False


@F.pandas_udf(RECOVERED)
def _recovered(texts: pd.Series, fences: pd.Series, tags: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([recovered(*row) for row in zip(texts, fences, tags)], columns=RECOVERED.fieldNames())


def recovered_json(text: Column, fence: Column, tag: Column) -> Column:
    """``json, method, ok`` of a response and its fenced and tagged parts; one Python worker takes every step."""
    return _recovered(text, fence, tag)
