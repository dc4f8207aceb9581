"""Recovery of JSON objects from raw model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.jsonudf import json_strict, recovered_json
from quillspark.functions.text import first_match, strip


def recover_json(responses: DataFrame, raw: str, mode: str = "extract") -> DataFrame:
    """Adds ``json``, ``method`` (null: parsed as it is) and ``ok``.

    Fence first, then tag, then the first balanced object; each later step sees only the rows the
    earlier ones left. All steps are one function, so a task has one Python worker.
    """
    text = F.col(raw)
    if mode == "strict":
        return responses.withColumn("_valid", json_strict(text)).withColumns(
            {"json": F.when(F.col("_valid"), text), "method": F.lit(None).cast("string"), "ok": F.col("_valid")}
        ).drop("_valid")
    fence = first_match(text, r"(?s)```(?:json)?\s*(.*?)\s*```")
    tag = first_match(text, r"(?s)<json>(.*?)</json>")
    found = responses.withColumn("_found", recovered_json(text, fence, tag))
    return found.withColumns({name: F.col(f"_found.{name}") for name in ("json", "method", "ok")}).drop("_found")
