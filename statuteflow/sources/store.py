"""Content-addressed storage of admitted documents: write once, committed by a manifest."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import first_per_key

KEY = ["organization_id", "sha256"]
OBJECT = "organization_id string, sha256 string, safe_name string, object_key string, content binary"
MANIFEST = "folder string, objects long"


def _named(documents: DataFrame) -> DataFrame:
    suffix = F.lower(F.regexp_extract("safe_name", r"(\.[A-Za-z0-9]+)$", 1))
    return documents.where(F.col("sha256").rlike("^[0-9a-f]{64}$")).withColumn("object_key", F.concat("organization_id", F.lit("/"), "sha256", suffix))


def object_keys(documents: DataFrame) -> DataFrame:
    """(organization_id, sha256, safe_name, object_key) with the path ``<org>/<sha256><suffix>``, once per content.

    Of several names for one content the first counts. Rows whose hash is not 64 lower-case hex digits are left out.
    """
    return first_per_key(_named(documents).select(*KEY, "safe_name", "object_key"), KEY, ["safe_name"])


def pending_objects(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Objects not in the store yet."""
    return object_keys(documents).join(stored.select(*KEY), KEY, "left_anti")


def stored_objects(spark: SparkSession, root: str) -> DataFrame:
    """All objects of a store, one for each key; an empty table where nothing was put yet.

    Only folders that the manifest names count: what a put that never ended has left is not read.
    """
    try:
        folders = [f"{root}/{r.folder}" for r in spark.read.schema(MANIFEST).parquet(f"{root}/manifest").collect()]  # a row for each put
    except AnalysisException:
        folders = []
    if not folders:
        return spark.createDataFrame([], OBJECT)
    found = spark.read.schema(OBJECT).parquet(*folders)
    return found if len(folders) == 1 else found.dropDuplicates(KEY)


def put_objects(documents: DataFrame, root: str) -> int:
    """Store what is missing of (organization_id, sha256, safe_name, content); the number of objects written.

    The objects of a put are the files of a folder of their own, which Spark's commit gives once however often a task
    runs; then one row of the manifest, a single file that appears by a rename, makes them visible. Content that is
    stored is not written again, and content moves once, for the rows that are missing. Two puts at a time may both write
    the same content; readers see it once.
    """
    spark = documents.sparkSession
    missing = _named(documents).join(stored_objects(spark, root).select(*KEY), KEY, "left_anti")
    first = missing.groupBy(*KEY).agg(F.min(F.struct("safe_name", "object_key", "content")).alias("o")).select(*KEY, "o.*")
    folder = f"put-{uuid.uuid4().hex}"
    first.write.parquet(f"{root}/{folder}")
    objects = spark.read.schema(OBJECT).parquet(f"{root}/{folder}").count()
    if objects:
        spark.createDataFrame([(folder, objects)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return objects
