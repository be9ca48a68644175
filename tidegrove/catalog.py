"""All queries of the engine's own operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import registry
from .functions import evidence, judging, parsing, reasoning, scoring, text  # noqa: F401
from .operators import algebra, balancing, comparisons, composed, cross, dealing, enumerations, generators, groupstats, held_out, local_changes, made_batches, policy, preparation, resampling, rollouts, sampling, segments, selection, series  # noqa: F401
from .plans import evaluation, extension, inference, reports, split, texts  # noqa: F401
from .sources import files  # noqa: F401
from .streaming import growth  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
