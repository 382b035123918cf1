"""Sensitive-content scan over texts: where a credential stands and a fingerprint, never the credential."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.ordered import running_sum

def _placeholder(value: Column) -> Column:
    v = F.lower(F.regexp_replace(F.trim(value), "^[\"']+|[\"']+$", ""))
    return (
        v.isin(*V.PLACEHOLDER_VALUES)
        | (v.startswith("<") & v.endswith(">"))
        | (v.startswith("${") & v.endswith("}"))
        | v.startswith("synthetic_")
        | v.startswith("replace-")
    )


def scan_text(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, category, fingerprint) for every match in the whole text; a match may go over the ends of lines.

    ``line`` is the line, from 1, in which the match begins. Each pattern gives its matches and what stands between them;
    the ends of lines in both are counted in the row, and their running sum over the matches, the only rows that go on,
    is the line. What a text needs is in proportion to its length, and null texts give nothing.
    """
    body = F.col("body")
    ends = lambda part: F.char_length(part) - F.char_length(F.replace(part, F.lit("\n"), F.lit("")))

    def matches(category: str, pattern: str, evidence: Column) -> Column:
        whole = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        between = F.slice(F.split(body, pattern, -1), F.lit(1), F.size(whole))
        zipped = F.arrays_zip(between.alias("between"), whole.alias("whole"), evidence.alias("evidence"))
        found = F.transform(
            zipped,
            lambda z, i: F.struct(
                F.lit(category).alias("category"), i.alias("place"), ends(z["between"]).alias("before"), ends(z["whole"]).alias("inside"), z["evidence"].alias("evidence")
            ),
        )
        return F.when(body.rlike(pattern), found).otherwise(F.array().cast(MATCH))

    assignment = "(?d)" + V.SECRET_ASSIGNMENT  # lines end at \n alone
    group = lambda i: F.regexp_extract_all(body, F.lit(assignment), F.lit(i))
    assigned = F.zip_with(group(1), group(2), lambda name, value: F.when(~_placeholder(value), F.concat(name, F.lit("="), value)))
    kinds = [matches(category, pattern, F.regexp_extract_all(body, F.lit(pattern), F.lit(0))) for category, pattern in V.SECRET_PATTERNS]
    kinds.append(matches("credential_assignment", assignment, assigned))
    rows = texts.select(F.col(key).cast("string").alias("path"), F.col(text).alias("body"), F.monotonically_increasing_id().alias("row"))
    found = rows.select("path", "row", F.explode(F.concat(*kinds)).alias("f")).select("path", "row", "f.*")
    so_far = F.sum(F.col("before") + F.col("inside")).over(Window.partitionBy("row", "category").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    placed = found.withColumn("line", (so_far - F.col("inside") + 1).cast("int")).where(F.col("evidence").isNotNull())
    digest = F.sha2(F.concat_ws("\0", F.lit(V.SCAN_VERSION), "path", "category", "evidence"), 256)
    return placed.select("path", "line", "category", digest.alias("fingerprint"))


MATCH = "array<struct<category:string,place:int,before:int,inside:int,evidence:string>>"


def content_class(files: DataFrame) -> DataFrame:
    """(path, content) with the reason a file cannot be scanned, or null."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    forbidden = (
        name.isin(".env", "id_dsa", "id_ecdsa", "id_ed25519", "id_rsa")
        | (name.startswith(".env.") & (name != ".env.example"))
        | name.rlike(r"\.(key|p12|pfx|jks)$")
    )
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.withColumn(
        "reason",
        F.when(forbidden, "forbidden_artifact")
        .when(F.length("content") > V.SCAN_MAX_BYTES, "unscannable_large_file")
        .when(F.contains(F.col("content"), F.lit(bytearray(b"\0"))), "unscannable_binary_file")
        .when(text.isNull(), "unscannable_non_utf8_file"),
    )


def new_findings(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings beyond those of the baseline, as a multiset: of n equal ones the first m known are dropped.

    The copies of one fingerprint are ranked by chunks of lines, so a credential repeated everywhere stays spread.
    """
    known = baseline.groupBy("fingerprint").agg(F.count("*").alias("known"))
    ranked = running_sum(current, ["fingerprint"], F.floor(F.col("line") / 4096), ["line", "path", "category"], "copy")
    return ranked.join(known, "fingerprint", "left").where(F.col("copy") > F.coalesce("known", F.lit(0))).drop("copy", "known")
