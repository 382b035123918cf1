"""Impact proposals behind policy gates, their decisions and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.ordered import fold_sorted
from .settlement import settle_keys

WORKFLOW_OUTCOME = (
    "organization_id string, run_id string, decision string, idempotency_key string, requested_at long, "
    "outcome string, revision int, supersedes int"
)


def impact_proposals(candidates: DataFrame, version_rows: DataFrame) -> DataFrame:
    """One run per obligation: evidence, proposed actions, the six policy gates, score, status and risk.

    ``candidates``: obligations with the candidates of their mappings (see ``controls.with_candidates``).
    """
    # What the gates and actions need of evidence and candidates is settled first: only columns that are read are shuffled.
    prepared = candidates.select(
        *[c for c in candidates.columns if c != "candidates"], (F.coalesce(F.length("evidence"), F.lit(0)) > 0).alias("quoted"),
        (F.coalesce(F.size("candidates"), F.lit(0)) > 0).alias("proposed"),
        F.transform("candidates", lambda c: F.struct(c["control_key"].alias("control_key"), c["owner"].alias("owner"))).alias("controls"),
    )
    rows = prepared.join(version_rows.select("version_id", "source_uri", "content_hash"), "version_id")
    gates = {
        "tenant_scope": F.lit(True),
        "citation_complete": F.col("quoted") & (F.coalesce(F.length("source_uri"), F.lit(0)) > 0),
        "human_approval_required": F.lit(True),
        "automatic_execution_disabled": F.lit(True),
        "confidence_gate": F.col("confidence") >= V.WORKFLOW_CONFIDENCE_GATE,
        "control_candidates_present": F.col("proposed"),
    }
    for name, gate in gates.items():
        rows = rows.withColumn(name, gate)
    passed = sum((F.col(name).cast("int") for name in gates), F.lit(0))
    blocking = F.col("tenant_scope") & F.col("citation_complete") & F.col("confidence_gate") & F.col("control_candidates_present")
    return rows.select(
        "organization_id", "obligation_id",
        F.sha2(F.concat_ws(":", F.lit("impact"), "obligation_id"), 256).alias("run_id"),
        F.struct(
            "version_id", "ordinal", "section_id", "section_key", "page", "source_uri", F.col("evidence").alias("quote"), "content_hash"
        ).alias("evidence"),
        F.concat(F.lit("Assess control impact for "), "section_key", F.lit(": "), "action").alias("summary"),
        F.transform(
            F.coalesce("controls", F.array()),
            lambda c: F.struct(
                F.lit("validate_control_coverage").alias("action"), c["control_key"].alias("control_key"),
                c["owner"].alias("owner"), F.lit(True).alias("requires_human_approval"),
            ),
        ).alias("recommended_actions"),
        *gates,
        F.round(passed / len(gates), 3).alias("evaluation_score"),
        F.when(blocking, "awaiting_approval").otherwise("blocked").alias("status"),
        F.when(F.col("modality").isin("must", "must_not"), "high").otherwise("medium").alias("risk_level"),
    )


def apply_workflow_decisions(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Outcome of every decision request on a run, in order; rules that need only the run are columns.

    An idempotency key belongs to the tenant: one that another run has appended is a conflict (see settle_keys).

    ``requests``: organization_id, run_id, decision, actor_id, idempotency_key, expected_revision, requested_at.
    ``runs``: organization_id, run_id, status, risk_level, created_by.
    """
    joined = requests.join(
        runs.select("organization_id", "run_id", F.col("status").alias("run_status"), "risk_level", "created_by"),
        ["organization_id", "run_id"], "left",
    )
    approves = F.col("decision") == "approved"
    judged = joined.withColumn("expected", F.col("expected_revision").cast("int")).withColumn(
        "initially",
        F.when(~F.col("decision").isin(*V.WORKFLOW_DECISIONS), "unsupported_decision")
        .when(F.col("run_status").isNull(), "run_not_found")
        .when((F.col("run_status") == "blocked") & approves, "blocked_run"),
    ).withColumn("self_approval", (F.col("created_by") == F.col("actor_id")) & (F.col("risk_level") == "high") & approves)
    columns = [
        "organization_id", "run_id", "decision", "idempotency_key", "requested_at", "expected", "initially", "self_approval", "run_status"
    ]

    def step(state, row):
        revision, used, status = state if state is not None else (0, {}, row["run_status"])
        key, decision = row["idempotency_key"], row["decision"]
        made, supersedes = None, None
        # A run that was blocked may have been decided since; the block holds while it stays undecided.
        if row["initially"] in ("unsupported_decision", "run_not_found"):
            outcome = row["initially"]
        elif status == "blocked" and decision == "approved":
            outcome = "blocked_run"
        elif row["self_approval"]:
            outcome = "self_approval"
        elif row["taken"]:
            outcome = "key_conflict"
        elif key in used:
            outcome, made = "replayed", used[key]
        elif int(row["expected"]) != revision:
            outcome = "stale_revision"
        else:
            outcome, made, supersedes = "appended", revision + 1, revision or None
            revision, status = revision + 1, decision
            used[key] = revision
        return (revision, used, status), (
            row["organization_id"], row["run_id"], decision, key, row["requested_at"], outcome, made, supersedes
        )

    return settle_keys(
        judged.select(*columns), "run_id",
        lambda rows: fold_sorted(rows, ["organization_id", "run_id"], ["requested_at", "idempotency_key"], WORKFLOW_OUTCOME, step),
    )


def list_workflows(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Runs with their latest decision and revision."""
    latest = (
        outcomes.where("outcome = 'appended'")
        .groupBy("organization_id", "run_id")
        .agg(F.max(F.struct("revision", "decision", "requested_at")).alias("d"))
        .select("organization_id", "run_id", "d.revision", F.col("d.decision").alias("latest_decision"), "d.requested_at")
    )
    return (
        runs.join(latest, ["organization_id", "run_id"], "left")
        .withColumn("status", F.coalesce("latest_decision", "status"))
        .withColumn("revision", F.coalesce("revision", F.lit(0)))
    )


def proposal_safety(rows: DataFrame) -> DataFrame:
    """Six rates over evaluation rows of booleans."""
    rate = lambda c: F.avg(c.cast("double"))
    return rows.agg(
        rate(F.col("proposal_supported")).alias("groundedness_rate"),
        rate(F.col("citation_complete")).alias("citation_completeness"),
        rate(F.col("tenant_scope")).alias("tenant_isolation_rate"),
        rate(F.col("human_approval_required")).alias("human_approval_enforcement"),
        rate(F.col("automatic_execution_allowed")).alias("unsafe_execution_rate"),
        rate(F.col("policy_block_expected") == F.col("policy_blocked")).alias("policy_block_accuracy"),
    )
