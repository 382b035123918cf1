"""Section-level change sets and their registers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def detect_changes(sections: DataFrame, version_rows: DataFrame) -> DataFrame:
    """All consecutive version diffs at once.

    ``sections`` (regulation_id, ordinal, section_key, heading, body, page) is joined with itself shifted by one
    version: every section is moved to the version that follows, provided that version exists. The full outer
    join runs on (regulation, ordinal, key), so a large regulation spreads by key. First versions are all added.
    """
    following = version_rows.select("regulation_id", (F.col("ordinal") - 1).alias("ordinal")).where("ordinal >= 1")
    before = sections.join(following, ["regulation_id", "ordinal"], "left_semi").select(
        "regulation_id",
        (F.col("ordinal") + 1).alias("ordinal"),
        "section_key",
        F.struct("heading", "body", "page").alias("old"),
    )
    after = sections.select("regulation_id", "ordinal", "section_key", F.struct("heading", "body", "page").alias("new"))
    same = strip("old.heading").eqNullSafe(strip("new.heading")) & strip("old.body").eqNullSafe(strip("new.body"))
    return (
        before.join(after, ["regulation_id", "ordinal", "section_key"], "full_outer")
        .withColumn(
            "change_type",
            F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~same, "modified"),
        )
        .where("change_type IS NOT NULL")
        .select(
            F.sha2(F.concat_ws(":", "regulation_id", F.col("ordinal").cast("string"), "section_key"), 256).alias("change_id"),
            "regulation_id",
            "ordinal",
            F.when(F.col("ordinal") > 1, F.col("ordinal") - 1).alias("previous_ordinal"),
            "section_key",
            F.coalesce("new.heading", "old.heading").alias("heading"),
            "change_type",
            F.col("old.body").alias("previous_text"),
            F.col("new.body").alias("current_text"),
            F.col("old.page").alias("previous_page"),
            F.col("new.page").alias("current_page"),
        )
    )


def duplicate_section_keys(sections: DataFrame) -> DataFrame:
    return (
        sections.groupBy("regulation_id", "ordinal", "section_key")
        .agg(F.count("*").alias("copies"))
        .where("copies > 1")
    )


def change_register(
    changes: DataFrame,
    regulations: DataFrame,
    version_rows: DataFrame,
    latest_only: bool = True,
    regulation_id: str | None = None,
) -> DataFrame:
    """Changes with the titles and both versions; newest versions first, then by section.

    A version is joined to the one before it first, so that the changes, which hold two texts, meet versions once.
    """
    versions = version_rows.select("regulation_id", "ordinal", "ingested_at", "source_uri")
    previous = versions.select("regulation_id", (F.col("ordinal") + 1).alias("ordinal"), F.col("source_uri").alias("previous_uri"))
    both = versions.withColumnRenamed("source_uri", "current_uri").join(previous, ["regulation_id", "ordinal"], "left")
    if regulation_id is not None:
        changes = changes.where(F.col("regulation_id") == regulation_id)
    if latest_only:
        latest = version_rows.groupBy("regulation_id").agg(F.max("ordinal").alias("ordinal"))
        changes = changes.join(latest, ["regulation_id", "ordinal"], "left_semi")
    return (
        changes.join(regulations.select("regulation_id", "title", "jurisdiction"), "regulation_id")
        .join(both, ["regulation_id", "ordinal"])
    )


def order_register(register: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return register.orderBy(F.desc("ingested_at"), "section_key", "change_id").offset(offset).limit(limit)


def change_detail(register: DataFrame) -> DataFrame:
    """Register rows with both texts and a citation for each side."""
    citation = lambda ordinal, page, uri: F.struct(
        F.col(ordinal).alias("ordinal"), F.col(page).alias("page"), F.col(uri).alias("source_uri")
    )
    return register.select(
        "change_id",
        "regulation_id",
        "section_key",
        "change_type",
        "previous_text",
        "current_text",
        F.when(F.col("previous_ordinal").isNotNull(), citation("previous_ordinal", "previous_page", "previous_uri")).alias(
            "previous_citation"
        ),
        citation("ordinal", "current_page", "current_uri").alias("current_citation"),
    )


def regulation_rollup(regulations: DataFrame, version_rows: DataFrame, changes: DataFrame, sources: DataFrame) -> DataFrame:
    """Per regulation: latest ordinal and time, number of changes and of enabled sources. Each side is aggregated first."""
    latest = version_rows.groupBy("regulation_id").agg(
        F.max("ordinal").alias("latest_ordinal"), F.max("ingested_at").alias("latest_ingested_at")
    )
    changed = changes.groupBy("regulation_id").agg(F.count("*").alias("total_changes"))
    monitored = sources.where("enabled").groupBy("regulation_id").agg(F.count("*").alias("monitored_sources"))
    return (
        regulations.join(latest, "regulation_id", "left")
        .join(changed, "regulation_id", "left")
        .join(monitored, "regulation_id", "left")
        .fillna(0, ["total_changes", "monitored_sources"])
    )


def version_rollup(version_rows: DataFrame, sections: DataFrame, changes: DataFrame) -> DataFrame:
    key = ["regulation_id", "ordinal"]
    held = sections.groupBy(*key).agg(F.count("*").alias("section_count"))
    changed = changes.groupBy(*key).agg(F.count("*").alias("change_count"))
    return version_rows.join(held, key, "left").join(changed, key, "left").fillna(0, ["section_count", "change_count"])


def change_impact(changes: DataFrame, obligations: DataFrame) -> DataFrame:
    """Per change: obligations of the current version's section, and whether the change needs a review."""
    key = ["regulation_id", "ordinal", "section_key"]
    touched = obligations.groupBy(*key).agg(
        F.count("*").alias("obligations"), F.bool_or("requires_review").alias("any_review")
    )
    removed = F.col("change_type") == "removed"
    return changes.join(touched, key, "left").select(
        "change_id",
        *key,
        "change_type",
        F.when(removed, F.lit(0)).otherwise(F.coalesce("obligations", F.lit(0))).cast("bigint").alias("obligations"),
        (removed | F.coalesce("any_review", F.lit(False))).alias("needs_review"),
    )
