"""All registered queries of the library proper and their SQL."""

from __future__ import annotations

from .plans import annealing, centers, pairs, reductions, tables, text, tools  # noqa: F401  (they register themselves)
from .plans.registry import ORACLE_SQL, QUERIES


def flagship(spark, sf_dir):
    """Distances, one EM step on hard groups, relabelled counts."""
    return QUERIES["q14_counts"](spark, sf_dir)
