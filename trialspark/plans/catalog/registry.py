"""Registry of queries. A query takes the trial domains and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trialspark.plans.order_trial import OrderTrial
from trialspark.plans.order_trial_sql import on_trial

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` selects the same rows from the trial domains."""

    def register(build: Callable[[OrderTrial], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(OrderTrial(spark, folder))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = on_trial(sql)
        return build

    return register
