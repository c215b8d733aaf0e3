"""All queries of the library by name, each with the SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import catalogue, completions, frames, measures, model, modelrules, operations, reference, services, structure
from .plans.dialect import Query, statement

FLAGSHIP = "aum_by_region_and_class"


@functools.cache
def everything() -> dict[str, Query]:
    out = {name: statement(*spec) for part in (reference, measures, operations, structure) for name, spec in part.STATEMENTS.items()}
    for part in (frames.QUERIES, completions.QUERIES, catalogue.QUERIES, services.QUERIES, model.SOURCES, model.SINKS, modelrules.TEXTS, modelrules.CHECKS, modelrules.VALIDATOR):
        if both := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(both)}")
        out |= part
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in everything().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.oracle for name, q in everything().items() if q.oracle}
