"""Importing the plan modules fills the registry."""

from quillspark.plans.common import ORACLES, QUERIES
from quillspark.plans import checks, evalreport, gates, metrics, pool, retrieve, sources, store, streams  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
