"""Versions of a regulation from its arrivals, and the latest version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running_sum


def first_versions(arrivals: DataFrame, chunk: Column) -> DataFrame:
    """(regulation_id, content_hash, arrived, ordinal): one version per new hash, numbered in arrival order.

    Copies fold in the aggregate before anything is shuffled. ``chunk`` is an expression over ``arrived`` that must
    not decrease along it; ranks are taken chunk by chunk.
    """
    firsts = arrivals.groupBy("regulation_id", "content_hash").agg(F.min("arrived").alias("arrived"))
    return running_sum(firsts, ["regulation_id"], chunk, ["arrived"], "ordinal")


def ingest_versions(arrivals: DataFrame, chunk: Column) -> DataFrame:
    """(regulation_id, arrived, content_hash) with outcome and ordinal of every arrival.

    A hash never seen before makes the next version; the hash of the current version is ``unchanged``; an older
    hash is a ``conflict``. ``current_ordinal`` is the version in force after the arrival.
    """
    made = first_versions(arrivals, chunk).withColumnRenamed("arrived", "first_arrived")
    marked = arrivals.join(made, ["regulation_id", "content_hash"]).withColumn(
        "is_first", F.col("arrived") == F.col("first_arrived")
    )
    counted = running_sum(
        marked, ["regulation_id"], chunk, ["arrived"], "current_ordinal", F.col("is_first").cast("int")
    )
    return counted.withColumn(
        "outcome",
        F.when(F.col("is_first"), "created")
        .when(F.col("ordinal") == F.col("current_ordinal"), "unchanged")
        .otherwise("conflict"),
    )


def latest_versions(version_rows: DataFrame) -> DataFrame:
    """The version with the highest ordinal of each regulation (an aggregate, no sort)."""
    payload = [c for c in version_rows.columns if c not in ("regulation_id", "ordinal")]
    return (
        version_rows.groupBy("regulation_id")
        .agg(F.max(F.struct("ordinal", *payload)).alias("v"))
        .select("regulation_id", "v.*")
    )
