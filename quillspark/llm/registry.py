"""Importing the operator modules fills the registry."""

from quillspark.llm.common import ORACLES, QUERIES
from quillspark.llm import (  # noqa: F401
    decontaminate, divergence, jaccard, langmix, lloyd, maxscore, mixing, packing, pii, simhash, substrings, toxicity, warc,
)

__all__ = ["ORACLES", "QUERIES"]
