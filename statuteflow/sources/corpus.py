"""Corpus manifests, acquisition locks and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import fingerprint_columns
from .records import violations


def _https(column: str) -> Column:
    return F.try_parse_url(F.col(column), F.lit("PROTOCOL")) == "https"


def check_manifest_rows(manifest: DataFrame, host: str, repository: str) -> DataFrame:
    """Violations of single manifest rows; the artifact URL must name one XML file of a pinned snapshot."""
    path = F.try_parse_url(F.col("artifact_url"), F.lit("PATH"))
    parts = F.split(path, "/")
    shape = (
        _https("artifact_url")
        & (F.try_parse_url(F.col("artifact_url"), F.lit("HOST")) == host)
        & (F.size(parts) == 7)
        & (F.concat_ws("/", F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))) == repository)
        & (F.try_element_at(parts, F.lit(4)) == F.col("repository_commit"))
        & (F.try_element_at(parts, F.lit(5)) == "eng")
        & F.try_element_at(parts, F.lit(6)).isin("acts", "regulations")
        & F.try_element_at(parts, F.lit(7)).endswith(".xml")
        & F.try_parse_url(F.col("artifact_url"), F.lit("QUERY")).isNull()
        & F.try_parse_url(F.col("artifact_url"), F.lit("REF")).isNull()
    )
    blank = F.lit(False)
    for name in ("document_id", "title", "regulator", "document_type"):
        blank = blank | (F.trim(name) == "")
    return violations(
        manifest,
        "source_id",
        {
            "unsafe_source_id": ~F.col("source_id").rlike(r"^[a-z0-9][a-z0-9._-]+$"),
            "identity_fields_required": blank,
            "unknown_document_type": ~F.col("document_type").isin("act", "regulation"),
            "rights_not_review_required": F.col("rights_status") != "review_required",
            "commit_not_full": ~F.col("repository_commit").rlike(r"^[0-9a-f]{40}$"),
            "evidence_url_not_https": ~(_https("official_url") & _https("portfolio_basis_url") & _https("rights_basis_url")),
            "artifact_url_shape": ~shape,
        },
    )


def manifest_summary(manifest: DataFrame, expected_documents: int = 25, minimum_regulators: int = 3) -> DataFrame:
    """One row: counts and the failed corpus rules."""
    row = manifest.agg(
        F.count("*").alias("documents"),
        F.count_distinct("source_id").alias("sources"),
        F.count_distinct("document_id").alias("document_ids"),
        F.count_distinct("regulator").alias("regulators"),
        F.count_distinct("repository_commit").alias("commits"),
    )
    failures = F.array(
        F.when(F.col("documents") != expected_documents, "document_count"),
        F.when(F.col("sources") != F.col("documents"), "duplicate_source_id"),
        F.when(F.col("document_ids") != F.col("documents"), "duplicate_document_id"),
        F.when(F.col("regulators") < minimum_regulators, "too_few_regulators"),
        F.when(F.col("commits") != 1, "mixed_snapshots"),
    )
    return row.withColumn("failures", F.filter(failures, lambda x: x.isNotNull()))


def lock_coverage(manifest: DataFrame, lock: DataFrame) -> DataFrame:
    """Violations (check, key, detail) between a manifest and its acquisition lock."""
    m = manifest.select("source_id", F.col("document_id").alias("m_document"), F.lit(True).alias("in_manifest"))
    k = lock.select(
        "source_id", F.col("document_id").alias("k_document"), "artifact_sha256", "artifact_size_bytes",
        F.lit(True).alias("in_lock"),
    )
    both = F.col("in_manifest").isNotNull() & F.col("in_lock").isNotNull()
    joined = m.join(k, "source_id", "full_outer")
    return violations(
        joined,
        "source_id",
        {
            "not_locked": F.col("in_lock").isNull(),
            "not_in_manifest": F.col("in_manifest").isNull(),
            "document_mismatch": both & ~F.col("m_document").eqNullSafe(F.col("k_document")),
            "invalid_sha256": F.col("in_lock").isNotNull()
            & ~F.coalesce(F.col("artifact_sha256").rlike(r"^[0-9a-f]{64}$"), F.lit(False)),
            "invalid_size": F.col("in_lock").isNotNull() & (F.coalesce("artifact_size_bytes", F.lit(0)) <= 0),
        },
    )


def read_artifacts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder with their hash and size; contents never leave the executors."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))
    )


def artifact_receipt(artifacts: DataFrame, name: str = "path") -> DataFrame:
    """One row over (name, sha256, size_bytes): files, bytes and the combined fingerprint."""
    digest = F.sha2(F.concat_ws(":", name, "sha256", F.col("size_bytes").cast("string")), 256)
    return artifacts.withColumn("__d", digest).agg(
        F.sum("size_bytes").cast("bigint").alias("size_bytes"), *fingerprint_columns(F.col("__d"))
    ).withColumnRenamed("rows", "files")
