"""Joins between requests, results and the rows they came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(requests: DataFrame, results: DataFrame, request_key: str, result_key: str, text: str, carry: Sequence[str]) -> DataFrame:
    """Results of the unique requests on every original request; `same_text` is the agreement check.

    Many requests may share one unique key; the result side has one row per key,
    so AQE can split the hot side and repeat only that row.
    """
    found = results.select(F.col(result_key).alias("__key"), F.col(text).alias("__text"), *carry)
    joined = requests.join(found, F.col(request_key) == F.col("__key"))
    return joined.withColumn("same_text", F.col(text) == F.col("__text")).drop("__key", "__text")


def attach_trajectory_source(trajectories: DataFrame, instances: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Trajectories with their data instance; `contained` says whether the query holds the problem text."""
    sources = instances.select("instance_id", F.col("problem").alias("__problem"), *carry)
    joined = trajectories.join(sources, "instance_id")
    return joined.withColumn("contained", F.col("query_text").contains(F.col("__problem"))).drop("__problem")
