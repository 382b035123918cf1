"""Deterministic sampling, blinded packages, progress, campaigns and rights review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed as V
from ..functions.joins import attach_row
from ..functions.ordered import below_cut, fingerprint_columns, hash_chunk, running_sum, smallest_per_key
from ..functions.text import aware_timestamp, hash_bucket, padded, sampling_stratum, stable_rank, strip
from ..session import stage_table
from ..sources.records import violations

IMMUTABLE = ("document_id", "regulator", "source_url", "section_id", "heading", "page", "text", "text_sha256")


# Up to this limit Spark cuts the rows of a rank before it shuffles them (spark.sql.optimizer.windowGroupLimitThreshold).
RANK_LIMIT = 1_000
# So many hashes of chosen ids are replicated at most, eight bytes each.
FILTER_ROWS = 4_000_000


def sample_pilot(candidates: DataFrame, target: int, seed: str) -> DataFrame:
    """``target`` clauses: an even quota per document, strata taken in turn, the rest filled from the rarest strata.

    The rule is a loop over documents and strata; this is its closed form. Only ids, documents and strata are ranked and
    shuffled; ranks inside (document, stratum) matter up to the quota, ranks inside a stratum up to what is left to fill.
    The other columns are read again for the chosen rows. ``candidates`` is read several times: pass a stored table.
    """
    labelled = candidates.select("clause_id", "document_id", sampling_stratum("text").alias("sampling_stratum"))
    have = dict(labelled.groupBy("sampling_stratum").count().collect())  # seven rows
    documents = candidates.select("document_id").distinct().count()
    if target <= 0 or sum(have.values()) < target:
        raise ValueError("target must be positive and not exceed the number of candidates")
    if target < documents:
        raise ValueError("target cannot cover every document")
    quota = target // documents
    n = len(V.LABELS)
    start = hash_bucket(stable_rank(seed, F.lit("document-strata"), "document_id"), n)
    index = F.array_position(F.array(*[F.lit(x) for x in V.LABELS]), F.col("sampling_stratum")) - 1
    inner = stable_rank(seed, "document_id", "sampling_stratum", "clause_id")
    if quota < RANK_LIMIT:
        place = F.row_number().over(Window.partitionBy("document_id", "sampling_stratum").orderBy(F.unhex(inner)))
        in_stratum = labelled.withColumn("rn", place).where(F.col("rn") <= quota)
    else:
        in_stratum = smallest_per_key(labelled, ["document_id", "sampling_stratum"], inner, quota, "rn")
    turn = Window.partitionBy("document_id").orderBy("rn", F.pmod(index - start + n, F.lit(n)))
    base = in_stratum.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= quota).drop("rn", "turn")
    chosen = stage_table(base, "sample-base")  # at most ``target`` rows
    held = dict(chosen.groupBy("sampling_stratum").count().collect())
    wanted = fill_up({s: c - held.get(s, 0) for s, c in have.items()}, held, target - sum(held.values()))
    if wanted:
        outer = stable_rank(seed, "sampling_stratum", "document_id", "clause_id")
        most = max(c + held.get(s, 0) for s, c in wanted.items())  # so many hold the wanted ones, whatever the base has of them
        near = below_cut(labelled.where(F.col("sampling_stratum").isin(*wanted)), ["sampling_stratum"], outer, most, 3)
        free = stage_table(near.select(*labelled.columns).join(chosen.select("clause_id"), "clause_id", "left_anti"), "sample-rest")
        ranked = running_sum(free, ["sampling_stratum"], hash_chunk(outer), [outer], "rn")
        limit = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])[F.col("sampling_stratum")]
        chosen = stage_table(chosen.unionByName(ranked.where(F.col("rn") <= limit).drop("rn")), "sample-chosen")
    master = stable_rank(seed, F.lit("master"), "clause_id")
    placed = running_sum(chosen.select("clause_id", "sampling_stratum"), [], hash_chunk(master), [master], "sample_position")
    placed = stage_table(placed.withColumn("sample_position", F.col("sample_position").cast("int")), "sample-places")
    rows = candidates
    if target <= FILTER_ROWS:  # rows whose hash is not among the chosen ones stay out of the join
        hashes = placed.select(F.xxhash64("clause_id").alias("__hash")).distinct()
        rows = candidates.withColumn("__hash", F.xxhash64("clause_id")).join(F.broadcast(hashes), "__hash", "left_semi").drop("__hash")
    return rows.join(placed, "clause_id").select(
        *candidates.columns, "sampling_stratum", "sample_position", F.lit(V.SAMPLING_POLICY).alias("sampling_policy_version")
    )


def fill_up(free: dict[str, int], held: dict[str, int], still: int) -> dict[str, int]:
    """How many of the ``free`` rows each stratum gives, if ``still`` are taken one by one from where least are held.

    Equal ones go by name. Strata that give nothing are left out.
    """
    gives = lambda level: {s: min(c, max(0, level - held.get(s, 0))) for s, c in free.items()}
    low, high = 0, max(held.values(), default=0) + still + 1
    while low < high - 1:  # the highest level that can be filled everywhere
        middle = (low + high) // 2
        low, high = (middle, high) if sum(gives(middle).values()) <= still else (low, middle)
    out = gives(low)
    for s in sorted(s for s, c in gives(low + 1).items() if c > out[s])[: still - sum(out.values())]:
        out[s] += 1
    return {s: c for s, c in out.items() if c}


def sampling_report(sample: DataFrame, by: str) -> DataFrame:
    return sample.groupBy(by).agg(F.count("*").alias("clauses"))


def blinded_packages(sample: DataFrame, seed: str, slots=("A", "B")) -> DataFrame:
    """The tasks of each slot in the slot's own order, without labels. ``sample`` is read twice: pass a stored table."""
    doubled = sample.withColumn("slot", F.explode(F.array(*[F.lit(s) for s in slots])))
    order = F.sha2(F.concat_ws(":", F.lit(seed), "slot", "clause_id"), 256)
    placed = running_sum(doubled, ["slot"], hash_chunk(order), [order], "task_position")
    return placed.withColumns(
        {
            "task_position": F.col("task_position").cast("int"),
            "guideline_version": F.lit(V.GUIDELINE_VERSION),
            "label": F.lit(None).cast("string"),
            "annotated_at": F.lit(None).cast("string"),
            "notes": F.lit(""),
        }
    )


def package_order_violations(tasks: DataFrame, sample: DataFrame, seed: str) -> DataFrame:
    """Tasks that do not stand where the slot's hash order puts them."""
    expected = blinded_packages(sample, seed).select("slot", "clause_id", F.col("task_position").alias("expected_position"))
    joined = tasks.select("slot", "clause_id", "task_position").join(expected, ["slot", "clause_id"], "full_outer")
    return joined.where(~F.col("task_position").eqNullSafe(F.col("expected_position")))


def queue_verification(candidates: DataFrame, receipts: DataFrame) -> DataFrame:
    """Compare receipts (status, candidates, candidate_fingerprint) with the queue itself."""
    now = candidates.select(F.sha2(F.concat_ws(":", "clause_id", "text_sha256"), 256).alias("d")).agg(
        *fingerprint_columns(F.col("d"), "actual_fingerprint")
    )
    return attach_row(receipts, now).select(
        "receipt_id",
        F.when(F.col("status") != "candidate_queue_ready", "queue_not_ready")
        .when(F.col("candidates") != F.col("rows"), "count_mismatch")
        .when(F.col("candidate_fingerprint") != F.col("actual_fingerprint"), "fingerprint_mismatch")
        .otherwise("ok").alias("verdict"),
    )


def package_violations(tasks: DataFrame, sample: DataFrame) -> DataFrame:
    """(check, slot, clause_id) of returned tasks against the sample they came from.

    ``tasks``: slot, clause_id, the immutable fields, guideline_version, label, annotated_at, annotator_id.
    """
    fields = [f for f in IMMUTABLE if f in sample.columns and f in tasks.columns]
    slots = F.explode(F.array(F.lit("A"), F.lit("B")))
    source = sample.select("clause_id", *[F.col(f).alias(f"s_{f}") for f in fields], slots.alias("slot"), F.lit(1).alias("s"))
    joined = tasks.withColumn("t", F.lit(1)).join(source, ["slot", "clause_id"], "full_outer")
    both = (F.col("t") == 1) & (F.col("s") == 1)
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~F.col(f).eqNullSafe(F.col(f"s_{f}"))
    untouched = F.col("label").isNull() & F.col("annotated_at").isNull()
    valid = F.coalesce(F.col("label").isin(*V.LABELS), F.lit(False)) & aware_timestamp("annotated_at")
    anonymous = strip(F.coalesce("annotator_id", F.lit(""))) == ""
    yes = lambda c: F.coalesce(c, F.lit(False))
    checks = {
        "missing_task": F.col("t").isNull(),
        "unknown_clause": F.col("s").isNull(),
        "task_modified": yes(both) & changed,
        "guideline_mismatch": yes(both) & ~yes(F.col("guideline_version") == V.GUIDELINE_VERSION),
        "incomplete_annotation": yes(both) & ~untouched & ~valid,
        "annotator_missing": yes(both) & ~untouched & anonymous,
    }
    failed = F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks.items()]), lambda x: x.isNotNull())
    return joined.select(F.explode(failed).alias("check"), "slot", "clause_id")


def pair_votes(tasks: DataFrame) -> DataFrame:
    """One row per clause with the labels of both slots, as an aggregate."""
    at = lambda s, c: F.max(F.when(F.col("slot") == s, F.col(c)))
    extra = [c for c in ("batch_id",) if c in tasks.columns]
    return tasks.groupBy(*extra, "clause_id").agg(
        at("A", "label").alias("label_a"), at("B", "label").alias("label_b"),
        at("A", "annotator_id").alias("annotator_a"), at("B", "annotator_id").alias("annotator_b"),
    )


def progress_report(tasks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Completion and agreement; with ``by`` one row per group and a total (null group)."""
    votes = pair_votes(tasks)
    dual = F.col("label_a").isNotNull() & F.col("label_b").isNotNull()
    grouped = votes.rollup(*by) if by else votes.groupBy()
    return (
        grouped.agg(
            F.count("*").alias("clauses"), F.count("label_a").alias("completed_a"), F.count("label_b").alias("completed_b"),
            F.count_if(dual).alias("dual_annotated"), F.count_if(dual & (F.col("label_a") == F.col("label_b"))).alias("agreements"),
            F.count_if(dual & (F.col("label_a") != F.col("label_b"))).alias("disagreements"),
            F.count_if(F.col("annotator_a") == F.col("annotator_b")).alias("same_annotator"),
        )
        .withColumn("agreement_rate", F.round(F.try_divide("agreements", "dual_annotated"), 4))
        .withColumn(
            "status", F.when(F.col("dual_annotated") == F.col("clauses"), "ready_for_adjudication").otherwise("annotation_in_progress")
        )
    )


def label_counts(tasks: DataFrame) -> DataFrame:
    return tasks.where("label IS NOT NULL").groupBy("slot", "label").agg(F.count("*").alias("n"))


def disagreements(tasks: DataFrame) -> DataFrame:
    return pair_votes(tasks).where("label_a <> label_b").select("clause_id", "label_a", "label_b")


def export_annotations(tasks: DataFrame) -> DataFrame:
    """Two votes per clause in the adjudication layout; rows of clauses that lack a vote make the export raise."""
    complete = tasks.groupBy("clause_id").agg(F.count("label").alias("labels")).where("labels = 2").select("clause_id")
    if tasks.select("clause_id").distinct().count() != complete.count():
        raise ValueError("every task must be complete before the export")
    return tasks.select("clause_id", "annotator_id", "label", "guideline_version", "annotated_at", "notes")


def batch_name(number: Column) -> Column:
    """batch-001 and so on; numbers above 999 are as long as they are."""
    return F.concat(F.lit("batch-"), padded(number, 3))


def campaign_batches(sample: DataFrame, batch_size: int) -> DataFrame:
    """Consecutive batches of the sample."""
    number = F.floor((F.col("sample_position") - 1) / batch_size) + 1
    return sample.withColumn("batch_id", batch_name(number))


def campaign_manifest(batched: DataFrame) -> DataFrame:
    """Per batch: count and fingerprint of its records."""
    digest = F.sha2(F.concat_ws(":", "clause_id", "text_sha256", "sampling_stratum"), 256)
    return batched.groupBy("batch_id").agg(*fingerprint_columns(digest, "sample_fingerprint")).withColumnRenamed("rows", "clauses")


def manifest_violations(batched: DataFrame, manifest: DataFrame, target: int) -> DataFrame:
    """(check, key): batches whose content no longer matches the manifest, gaps in the numbering, a missed target."""
    now = campaign_manifest(batched).select(
        "batch_id", F.col("clauses").alias("now_clauses"), F.col("sample_fingerprint").alias("now_fingerprint"), F.lit(1).alias("n")
    )
    joined = manifest.withColumn("m", F.lit(1)).join(now, "batch_id", "full_outer")
    both = (F.col("m") == 1) & (F.col("n") == 1)
    rows = violations(
        joined,
        "batch_id",
        {
            "batch_missing": F.col("n").isNull(),
            "batch_unknown": F.col("m").isNull(),
            "count_mismatch": F.coalesce(both, F.lit(False)) & (F.col("clauses") != F.col("now_clauses")),
            "fingerprint_mismatch": F.coalesce(both, F.lit(False)) & (F.col("sample_fingerprint") != F.col("now_fingerprint")),
        },
    ).drop("detail")
    whole = manifest.agg(F.sum("clauses").alias("c"), F.count("*").alias("b"), F.max_by("batch_id", F.struct(F.length("batch_id"), "batch_id")).alias("last"))
    gaps = whole.select(
        F.explode(
            F.array(
                F.when(F.col("c") != target, F.lit("target_mismatch")),
                F.when(F.col("last") != batch_name(F.col("b")), F.lit("batch_numbering")),
            )
        ).alias("check")
    ).where("check IS NOT NULL").select("check", F.lit("campaign").alias("key"))
    return rows.unionByName(gaps)


# --- rights ---------------------------------------------------------------------------------------------------

RIGHTS_FIELDS = (
    "document_id", "title", "regulator", "official_url", "portfolio_basis_url", "artifact_url", "artifact_sha256", "artifact_size_bytes",
)


def prepare_rights_review(manifest: DataFrame, lock: DataFrame) -> DataFrame:
    """Pending review rows: one per manifest source with the locked hash and size, every check open."""
    held = lock.select("source_id", "artifact_sha256", "artifact_size_bytes")
    return manifest.join(held, "source_id").select(
        "source_id", *RIGHTS_FIELDS, F.concat("source_id", F.lit(".xml")).alias("artifact_path"),
        F.lit("pending").alias("decision"), F.lit("").alias("reviewer_name"), F.lit("").alias("reviewed_at"),
        F.lit("").alias("rationale"), *[F.lit(False).alias(c) for c in V.RIGHTS_CHECKS],
    )


def rights_review_violations(reviews: DataFrame, manifest: DataFrame, lock: DataFrame) -> DataFrame:
    """(check, key): coverage, changed evidence, and completed reviews that lack something."""
    expected = prepare_rights_review(manifest, lock).select(
        "source_id", *[F.col(f).alias(f"e_{f}") for f in RIGHTS_FIELDS], F.lit(1).alias("e")
    )
    joined = reviews.withColumn("v", F.lit(1)).join(expected, "source_id", "full_outer")
    both = F.coalesce((F.col("v") == 1) & (F.col("e") == 1), F.lit(False))
    changed = F.lit(False)
    for f in RIGHTS_FIELDS:
        changed = changed | ~F.col(f).eqNullSafe(F.col(f"e_{f}"))
    done = both & (F.col("decision") != "pending")
    every = F.lit(True)
    for c in V.RIGHTS_CHECKS:
        every = every & F.col(c)
    return violations(
        joined,
        "source_id",
        {
            "not_reviewed": F.col("v").isNull(),
            "not_in_manifest": F.col("e").isNull(),
            "evidence_changed": both & changed,
            "unknown_decision": both & ~F.col("decision").isin("pending", "approved", "rejected"),
            "reviewer_or_time_missing": done & ((strip("reviewer_name") == "") | ~aware_timestamp("reviewed_at")),
            "rationale_too_short": done & (F.length(strip("rationale")) < 20),
            "checks_incomplete": done & ~every,
            "not_approved": both & (F.col("decision") != "approved"),
        },
    ).drop("detail")


def finalize_rights_review(reviews: DataFrame, manifest: DataFrame, acquired_at: str, rights_basis: str) -> tuple[DataFrame, DataFrame]:
    """(registry rows, approvals) of approved reviews."""
    approved = reviews.where("decision = 'approved'")
    registry = manifest.join(approved.select("source_id", "artifact_sha256"), "source_id").select(
        "source_id", "document_id", "regulator", "title", F.col("repository_commit").alias("version"),
        F.col("official_url").alias("source_url"), F.lit("approved").alias("rights_status"),
        F.lit(rights_basis).alias("rights_basis"), F.lit(acquired_at).alias("retrieved_at"),
        F.col("artifact_sha256").alias("content_sha256"),
    )
    approvals = approved.select(
        "source_id", "document_id", "artifact_path", "artifact_sha256",
        F.col("reviewer_name").alias("rights_reviewer"), F.col("reviewed_at").alias("rights_reviewed_at"),
    )
    return registry, approvals
