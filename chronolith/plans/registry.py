"""Named queries over the bound tables, each with its check statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronolith.plans.bindings import History

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def uncut(name: str, *cuts: str) -> str:
    """The check statement of a capped query without its cuts."""
    statement = CHECKS[name]
    for cut in cuts:
        if cut not in statement:
            raise ValueError(f"{name} has no {cut}")
        statement = statement.replace(cut, "")
    return statement


def query(name: str, check: str | None = None):
    """Registers a function from the bound tables to a result under ``name``."""

    def register(build: Callable[[History], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(History(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return build

    return register
