"""JSON and JSONL records in and out, with row-level checks instead of silent nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.text import aware_timestamp, strip

SOURCE_REGISTRY = (
    "source_id string, document_id string, regulator string, jurisdiction string, title string, version string, "
    "source_url string, rights_status string, rights_basis string, retrieved_at string, content_sha256 string"
)
SECTION = "document_id string, section_id string, heading string, page int, text string"
CANDIDATE = (
    "clause_id string, " + SOURCE_REGISTRY
    + ", section_id string, heading string, page int, position int, text string, text_sha256 string"
)
ANNOTATION = (
    "clause_id string, annotator_id string, label string, guideline_version string, annotated_at string, notes string"
)
ADJUDICATION = "clause_id string, reviewer_id string, label string, adjudicated_at string, rationale string"
LABELLED_CLAUSE = "clause_id string, document_id string, regulator string, text string, label string"


def read_records(spark: SparkSession, path: str, schema: str, multi_line: bool | None = None) -> DataFrame:
    """Read ``.jsonl`` lines, a JSON array, or ``{"sources": [...]}``; broken rows are kept in ``_corrupt_record``."""
    multi = not path.endswith(".jsonl") if multi_line is None else multi_line
    reader = spark.read.option("multiLine", multi).option("mode", "PERMISSIVE")
    if multi:
        wrapped = reader.schema(f"{schema}, sources array<struct<{_struct_fields(schema)}>>, _corrupt_record string").json(path)
        names = [f.strip().split(" ")[0] for f in schema.split(",")]
        plain = wrapped.where("sources IS NULL").select(*names, "_corrupt_record")
        nested = wrapped.where("sources IS NOT NULL").select(F.explode("sources").alias("r"), "_corrupt_record")
        return plain.unionByName(nested.select("r.*", "_corrupt_record"))
    return reader.schema(f"{schema}, _corrupt_record string").json(path)


def _struct_fields(schema: str) -> str:
    return ", ".join(f.strip().replace(" ", ":", 1) for f in schema.split(","))


def _blank(column: str) -> Column:
    return strip(F.coalesce(F.col(column), F.lit(""))) == ""


def violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """Rows (check, key, detail): one for every rule a row breaks. ``checks`` maps a name to its *failure*."""
    failed = F.filter(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()]),
        lambda x: x.isNotNull(),
    )
    return df.select(F.explode(failed).alias("check"), F.col(key).alias("key"), F.lit("row").alias("detail"))


def duplicates(df: DataFrame, key: str, check: str) -> DataFrame:
    return (
        df.groupBy(F.col(key).alias("key"))
        .count()
        .where("count > 1")
        .select(F.lit(check).alias("check"), "key", F.col("count").cast("string").alias("detail"))
    )


def check_registry(sources: DataFrame) -> DataFrame:
    """Violations of the source-registry contract."""
    approved = F.col("rights_status") == "approved"
    blank = F.lit(False)
    for name in ("source_id", "document_id", "regulator", "jurisdiction", "title", "version"):
        blank = blank | _blank(name)
    checks = {
        "identity_fields_required": blank,
        "source_url_not_https": ~F.col("source_url").startswith("https://"),
        "unknown_rights_status": ~F.col("rights_status").isin("approved", "review_required", "rejected"),
        "approved_without_basis": F.coalesce(approved, F.lit(False)) & _blank("rights_basis"),
        "approved_without_retrieval_time": F.coalesce(approved, F.lit(False)) & ~aware_timestamp("retrieved_at"),
        "approved_without_content_hash": F.coalesce(approved, F.lit(False))
        & ~F.coalesce(F.col("content_sha256").rlike(r"^[0-9a-f]{64}$"), F.lit(False)),
    }
    return violations(sources, "source_id", checks).unionByName(
        duplicates(sources, "document_id", "duplicate_document_id")
    )


def check_annotations(annotations: DataFrame) -> DataFrame:
    return violations(
        annotations,
        "clause_id",
        {
            "identity_required": _blank("clause_id") | _blank("annotator_id"),
            "unknown_label": ~F.col("label").isin(*V.LABELS),
            "time_without_zone": ~aware_timestamp("annotated_at"),
        },
    )


def check_adjudications(adjudications: DataFrame) -> DataFrame:
    return violations(
        adjudications,
        "clause_id",
        {
            "identity_and_rationale_required": _blank("clause_id") | _blank("reviewer_id") | _blank("rationale"),
            "unknown_label": ~F.col("label").isin(*V.LABELS),
            "time_without_zone": ~aware_timestamp("adjudicated_at"),
        },
    ).unionByName(duplicates(adjudications, "clause_id", "duplicate_adjudication"))


def check_labelled_clauses(rows: DataFrame) -> DataFrame:
    return violations(
        rows,
        "clause_id",
        {
            "identity_and_text_required": _blank("clause_id") | _blank("document_id") | _blank("text"),
            "unknown_label": ~F.col("label").isin(*V.LABELS),
        },
    ).unionByName(duplicates(rows, "clause_id", "duplicate_clause_id"))


def assert_empty(found: DataFrame) -> None:
    """Fail closed: raise with a few examples where violations exist."""
    examples = found.take(3)
    if examples:
        raise ValueError("; ".join(f"{r['check']}: {r['key']}" for r in examples))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line with the keys in name order, nulls kept."""
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", "false").json(path)
