"""All catalog queries, by the ids of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Catalog
from . import advanced, jobs, relational, streams

PARTS = (relational, advanced, streams, jobs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for part in PARTS:
        for name, (run, _) in part.queries().items():
            found[name] = lambda spark, sf_dir, run=run: run(Catalog(spark, sf_dir))
    return found


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.queries().items() if sql}
