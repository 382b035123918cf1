"""Control catalogue and evidence-linked mapping suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.ordered import running_sum
from ..functions.text import token_set
from .similarity import LOCAL, RARE, with_matches


def version_controls(changes: DataFrame, chunk: Column) -> DataFrame:
    """Immutable control versions: a description, owner and evidence never seen for the control is the next version.

    ``chunk`` is an expression over ``changed_at`` that does not decrease along it.
    """
    key = ["organization_id", "control_key"]
    body = ["description", "owner", "evidence_requirement"]
    hashed = changes.withColumn("content_hash", F.sha2(F.concat_ws("|", *body), 256))
    firsts = hashed.groupBy(*key, "content_hash").agg(F.min(F.struct("changed_at", *body)).alias("f")).select(
        *key, "content_hash", "f.*"
    )
    titles = changes.groupBy(*key).agg(F.min_by("title", "changed_at").alias("title"))
    numbered = running_sum(firsts, key, chunk, ["changed_at"], "ordinal")
    return numbered.join(titles, key).withColumn(
        "control_version_id",
        F.concat(F.col("organization_id"), F.lit("/"), "control_key", F.lit(":v"), F.col("ordinal").cast("string")),
    )


def latest_control_versions(control_versions: DataFrame, inactive: DataFrame | None = None) -> DataFrame:
    """Newest version of each active control."""
    key = ["organization_id", "control_key"]
    payload = [c for c in control_versions.columns if c not in (*key, "ordinal")]
    latest = control_versions.groupBy(*key).agg(F.max(F.struct("ordinal", *payload)).alias("v")).select(*key, "v.*")
    return latest if inactive is None else latest.join(inactive.select(*key), key, "left_anti")


def mapping_id(obligation_id: Column, control_version_id: Column) -> Column:
    return F.sha2(F.concat_ws(":", obligation_id, control_version_id), 256)


def with_candidates(
    obligations: DataFrame, controls: DataFrame, limit: int = V.MAPPING_LIMIT, rare: int = RARE, local: int = LOCAL, unread: Sequence[str] = ()
) -> DataFrame:
    """Add ``candidates``: the best ``limit`` controls of its tenant by token overlap (Jaccard), best first; null for none.

    Every candidate has the mapping's rank, score, status, raw_overlap_count and matched_terms, the control's identity, owner
    and evidence_requirement (where ``controls`` has them). The obligations are written to the shared folder and
    not shuffled: give only the columns that are read afterwards, and name those of evidence and action that are not in
    ``unread``. ``rare`` and ``local`` are bounds of the index (see ``with_matches``).
    """
    tenant = F.col("organization_id").alias("scope")
    sources = obligations.withColumnsRenamed({"organization_id": "scope"}).withColumn("terms", token_set(F.concat_ws(" ", "evidence", "action"))).drop(*unread)
    named = [c for c in ("owner", "evidence_requirement") if c in controls.columns]
    targets = controls.select(
        tenant, F.col("control_version_id").alias("target"), token_set(F.concat_ws(" ", "title", "description", "evidence_requirement")).alias("terms"),
        "control_key", F.col("title").alias("control_title"), *named,
    )
    stopwords = F.array(*[F.lit(w) for w in V.EXPLANATION_STOPWORDS])

    def candidate(m: Column) -> Column:
        raw, shared = m["score"], m["shared"]
        status = F.when((m["gap"] < V.AMBIGUITY_GAP) & (m["position"] < 2), "ambiguous").when(raw >= V.SUGGESTED_MINIMUM, "suggested").otherwise("needs_review")
        return F.struct(
            (m["position"] + 1).alias("rank"), m["target"].alias("control_version_id"), m["control_key"].alias("control_key"),
            m["control_title"].alias("control_title"), F.round(raw, 3).alias("score"), status.alias("status"), F.size(shared).alias("raw_overlap_count"),
            F.sort_array(F.array_except(shared, stopwords)).alias("matched_terms"), *[m[c].alias(c) for c in named],
        )

    found = with_matches(sources, targets, limit, rare, local)
    return found.select(
        *[F.col("scope").alias(c) if c == "organization_id" else F.col(c) for c in obligations.columns if c not in unread], F.transform("matches", candidate).alias("candidates")
    )


def suggest_mappings(
    obligations: DataFrame, controls: DataFrame, limit: int = V.MAPPING_LIMIT, known: DataFrame | None = None, rare: int = RARE, local: int = LOCAL
) -> DataFrame:
    """A row for each of the ``candidates`` of an obligation (see ``with_candidates``), with the mapping's id and method.

    ``known``: mappings that are already stored. An obligation that has one by this method keeps what it has, whatever the
    catalogue says now; only the others are searched. The result has the columns that ``known`` has.
    """
    key = ["organization_id", "obligation_id"]
    if known is not None:
        known = known.where(F.col("mapping_method") == V.MAPPING_METHOD)
        kept = known.join(obligations.select(*key), key, "left_semi")
        obligations = obligations.join(known.select(*key).distinct(), key, "left_anti")
    made = mappings_of(with_candidates(obligations.select(*key, "evidence", "action"), controls, limit, rare, local, ("evidence", "action")))
    if known is None:
        return made
    columns = [c for c in made.columns if c in known.columns]
    return kept.select(*columns).union(made.select(*columns))


def mappings_of(found: DataFrame) -> DataFrame:
    """A row for each candidate of the rows of ``with_candidates``, with the mapping's id and method."""
    key = ["organization_id", "obligation_id"]
    return found.select(*key, F.explode("candidates").alias("c")).select(
        *key, *[F.col(f"c.{c}") for c in ("control_version_id", "control_key", "control_title", "rank", "score", "status", "raw_overlap_count", "matched_terms")],
        mapping_id(F.col("obligation_id"), F.col("c.control_version_id")).alias("mapping_id"),
        F.lit(V.MAPPING_METHOD).alias("mapping_method"),
    )


def mapping_state(candidates: DataFrame) -> DataFrame:
    """unmapped, ambiguous or suggested per obligation, from its ``candidates`` (see ``with_candidates``)."""
    ambiguous = F.exists("candidates", lambda c: c["status"] == "ambiguous")
    return candidates.select(
        "organization_id", "obligation_id", F.coalesce(F.size("candidates"), F.lit(0)).cast("bigint").alias("candidates"),
        F.when(F.col("candidates").isNull(), "unmapped").when(ambiguous, "ambiguous").otherwise("suggested").alias("state"),
    )


def list_mappings(
    mappings: DataFrame, obligations: DataFrame, control_versions: DataFrame, limit: int = 100, offset: int = 0
) -> DataFrame:
    """Mappings whose obligation and control belong to the same tenant, best first."""
    key = ["organization_id", "control_version_id"]
    return (
        mappings.join(obligations.select("organization_id", "obligation_id"), ["organization_id", "obligation_id"], "left_semi")
        .join(control_versions.select(*key), key, "left_semi")
        .orderBy(F.desc("score"), "mapping_id")
        .offset(offset)
        .limit(limit)
    )


def control_catalogue(latest: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return latest.orderBy("control_key", "control_version_id").offset(offset).limit(limit)


def mappings_per_control(mappings: DataFrame) -> DataFrame:
    return mappings.groupBy("control_version_id").agg(F.count("*").alias("mappings"))


def mapping_evaluation(rows: DataFrame, top_k: int = 3) -> DataFrame:
    """Ranking metrics over (expected, candidates, ambiguous, requires_review) rows, in one aggregate."""
    kept = F.slice("candidates", 1, top_k)
    hits = F.size(F.array_intersect(F.array_distinct("expected"), kept))
    first = F.array_min(F.filter(F.transform(kept, lambda k, i: F.when(F.array_contains("expected", k), i + 1)), lambda r: r.isNotNull()))
    mapped = F.size("expected") > 0
    per_row = rows.select(
        mapped.alias("mapped"),
        F.when(mapped, hits / F.size(F.array_distinct("expected"))).alias("recall"),
        F.when(mapped, hits / F.lit(top_k)).alias("precision"),
        F.when(mapped, F.coalesce(1.0 / first, F.lit(0.0))).alias("reciprocal"),
        (F.size(kept) > 0).alias("covered"), "ambiguous", "requires_review",
    )
    share = lambda c: F.avg(F.col(c).cast("double"))
    return per_row.agg(
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("candidate_recall_at_k"),
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("precision_at_k"),
        F.coalesce(F.avg("reciprocal"), F.lit(0.0)).alias("mean_reciprocal_rank"),
        share("covered").alias("coverage_rate"),
        share("ambiguous").alias("ambiguity_rate"),
        F.coalesce(F.avg(F.when(~F.col("mapped"), (~F.col("covered")).cast("double"))), F.lit(1.0)).alias("unmapped_accuracy"),
        share("requires_review").alias("review_workload"),
    )
