"""All queries of the library but those of the llm subpackage."""

from tallywright.plans import anomalies, datasets, languages, mathematics, runs, sampling, streams, tasks, texts  # noqa: F401  they register their queries
from tallywright.plans.catalogue import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
