"""All registered queries of the library proper, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.plans import corpus, events  # noqa: F401  (both register their queries)
from skein.plans.registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.event_observation_trace(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
