"""Append-only review ledger: decisions, supersession, the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.joins import attach_row
from ..functions.ordered import first_per_key, fold_sorted
from ..session import stage_table
from .controls import mapping_id
from .settlement import settle_keys

DECISION_OUTCOME = (
    "organization_id string, obligation_id string, mapping_id string, decision string, idempotency_key string, "
    "requested_at long, outcome string, revision int, supersedes int"
)


def checked_requests(requests: DataFrame, obligations: DataFrame | None = None, mappings: DataFrame | None = None) -> DataFrame:
    """Requests with the verdict of the rules that need no state.

    ``obligations`` and ``mappings`` are what exists in a tenant; where one is not given, all that is asked for exists.
    """
    def known(rows: DataFrame, of: DataFrame | None, key: list[str], flag: str) -> DataFrame:
        if of is None:
            return rows.withColumn(flag, F.lit(True))
        return rows.join(of.select(*key).distinct().withColumn(flag, F.lit(True)), key, "left")

    requests = known(requests, obligations, ["organization_id", "obligation_id"], "has_obligation")
    requests = known(requests, mappings, ["organization_id", "obligation_id", "mapping_id"], "has_mapping")
    return requests.select(
        "organization_id", "obligation_id", "mapping_id", "decision", "idempotency_key", "requested_at",
        F.col("expected_revision").cast("int").alias("expected"),
        F.when(~F.col("decision").isin(*V.REVIEW_DECISIONS), "unsupported_decision")
        .when(F.col("has_obligation").isNull(), "obligation_not_found")
        .when(F.col("mapping_id").isNotNull() & F.col("has_mapping").isNull(), "mapping_not_found")
        .when((F.col("decision") == "confirmed_unmapped") & F.col("mapping_id").isNotNull(), "must_target_obligation")
        .when((F.col("decision") != "confirmed_unmapped") & F.col("mapping_id").isNull(), "mapping_required")
        .alias("invalid"),
    )


def decision_step(state, row):
    """(state', output row) of one request. The state of an obligation: revision per mapping, and the keys used.

    ``taken`` says that another obligation has appended the key before.
    """
    present = lambda v: None if v is None or v != v else v
    revisions, used = state if state is not None else ({}, {})
    key, target, invalid = row["idempotency_key"], present(row["mapping_id"]), present(row["invalid"])
    outcome, revision, supersedes = None, None, None
    if invalid in ("unsupported_decision", "obligation_not_found"):
        outcome = invalid
    elif row["taken"]:
        outcome = "key_conflict"
    elif key in used:
        outcome = "replayed" if used[key][0] == target else "key_conflict"
        revision = used[key][1] if outcome == "replayed" else None
    elif invalid:
        outcome = invalid
    else:
        # A decision about the obligation itself is measured against every decision of that obligation.
        slot = target or ""
        current = revisions.get(slot, 0) if target is not None else max(revisions.values(), default=0)
        if int(row["expected"]) != current:
            outcome = "stale_revision"
        else:
            outcome, revision, supersedes = "appended", current + 1, current or None
            revisions[slot] = current + 1
            used[key] = (target, current + 1)
    return (revisions, used), (
        row["organization_id"], row["obligation_id"], target, row["decision"], key, row["requested_at"], outcome, revision, supersedes
    )


def apply_decisions(requests: DataFrame, obligations: DataFrame | None = None, mappings: DataFrame | None = None) -> DataFrame:
    """Outcome of every decision request, in request order.

    ``requests``: organization_id, obligation_id, mapping_id (null for the obligation itself), decision,
    idempotency_key, expected_revision, requested_at. ``obligations`` and ``mappings``: what exists (see checked_requests).

    The checks that need no state are columns. What is left is optimistic concurrency, where each request depends on
    the revisions before it: the rows are folded in order per obligation, streaming, so no group is held in memory. An
    idempotency key belongs to the tenant: once an obligation has appended with it, others conflict (see settle_keys).
    """
    return settle_keys(
        checked_requests(requests, obligations, mappings), "obligation_id",
        lambda rows: fold_sorted(rows, ["organization_id", "obligation_id"], ["requested_at", "idempotency_key"], DECISION_OUTCOME, decision_step),
    )


def key_conflicts(requests: DataFrame) -> DataFrame:
    """Idempotency keys of a tenant that were sent for more than one obligation or mapping."""
    target = F.concat_ws("|", "obligation_id", F.coalesce("mapping_id", F.lit("")))
    return (
        requests.groupBy("organization_id", "idempotency_key")
        .agg(F.count("*").alias("requests"), F.min(target).alias("low"), F.max(target).alias("high"))
        .where("low <> high")
        .select("organization_id", "idempotency_key", "requests")
    )


def latest_decisions(ledger: DataFrame) -> DataFrame:
    """The decision with the highest revision of each (obligation, mapping); null mappings form their own group."""
    key = ["organization_id", "obligation_id", "mapping_id"]
    payload = [c for c in ledger.columns if c not in (*key, "revision")]
    return ledger.groupBy(*key).agg(F.max(F.struct("revision", *payload)).alias("d")).select(*key, "d.*")


def supersede_decisions(ledger: DataFrame, mappings: DataFrame, control_versions: DataFrame) -> DataFrame:
    """Closing entries for latest decisions about control versions that have a successor."""
    newest = control_versions.groupBy("organization_id", "control_key").agg(F.max("ordinal").alias("newest"))
    replaced = (
        control_versions.join(newest, ["organization_id", "control_key"])
        .where("ordinal < newest")
        .select("organization_id", "control_version_id")
    )
    tied = latest_decisions(ledger).where("mapping_id IS NOT NULL AND decision <> 'superseded'").join(
        mappings.select("organization_id", "mapping_id", "control_version_id"), ["organization_id", "mapping_id"]
    )
    return tied.join(replaced, ["organization_id", "control_version_id"], "left_semi").select(
        "organization_id", "obligation_id", "mapping_id",
        F.lit("superseded").alias("decision"),
        F.lit("system:control-versioning").alias("actor_id"),
        (F.col("revision") + 1).alias("revision"),
        F.col("revision").alias("supersedes"),
        F.concat_ws("-", F.lit("supersede-control"), "control_version_id", "mapping_id").alias("idempotency_key"),
    )


def review_queue(
    obligations: DataFrame, mappings: DataFrame, ledger: DataFrame, regulations: DataFrame
) -> DataFrame:
    """Every obligation with its candidates, their latest decisions and the state that follows from them.

    Candidates per obligation are bounded by the mapping limit, so they are gathered, and so are the latest decisions about
    them: mappings are shuffled once, by obligation, and the states are read from the arrays.
    """
    latest = latest_decisions(ledger).select("organization_id", "obligation_id", "mapping_id", "decision", "revision")
    on_obligation = latest.where("mapping_id IS NULL").select(
        "organization_id", "obligation_id", F.col("decision").alias("own_decision"), F.col("revision").alias("own_revision")
    )
    key = ["organization_id", "obligation_id"]
    decisions = latest.where("mapping_id IS NOT NULL").groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("mapping_id", F.struct("decision", "revision").alias("d")))).alias("decisions")
    )
    gathered = mappings.withColumn("negative", -F.col("score")).groupBy(*key).agg(F.collect_list(F.struct(*CANDIDATE)).alias("gathered"))
    folded = gathered.join(decisions, key, "left").select(*key, _decided("gathered").alias("candidates"))
    # The titles come first: behind the candidates, these would be shuffled by regulation.
    rows = obligations.join(regulations.select("regulation_id", F.col("title").alias("regulation_title")), "regulation_id")
    return _with_state(rows.join(folded, key, "left").join(on_obligation, key, "left"))


CANDIDATE = ("negative", "mapping_id", "control_version_id", "control_key", "control_title", "status")


def _decided(candidates: str | Column) -> Column:
    """Candidates, best first, with the latest decision about each from the map ``decisions`` (mapping_id to decision)."""

    def decided(c: Column) -> Column:
        found = F.try_element_at("decisions", c["mapping_id"])
        return F.struct(*[c[f].alias(f) for f in CANDIDATE], found["decision"].alias("decision"), found["revision"].alias("revision"))

    return F.sort_array(F.transform(candidates, decided))


def _with_state(rows: DataFrame) -> DataFrame:
    """Add candidate_count, review_state and review_revision to rows with ``candidates``, own_decision and own_revision."""
    zero, held = F.lit(0), F.coalesce("candidates", F.array())
    size = lambda keep: F.size(F.filter(held, keep))
    count = lambda s: size(lambda c: F.coalesce(c["decision"] == s, F.lit(False)))
    counted = rows.withColumns({
        "candidate_count": F.size(held).cast("bigint"), "decided": size(lambda c: c["decision"].isNotNull()),
        **{s: count(s) for s in ("accepted", "deferred", "superseded", "rejected")},
        "mapping_revision": F.array_max(F.transform("candidates", lambda c: c["revision"])),
    })
    state = (
        F.when(F.col("own_decision").isNotNull(), F.col("own_decision"))
        .when(F.col("accepted") > 0, "accepted")
        .when(F.col("deferred") > 0, "deferred")
        .when((F.col("decided") > 0) & (F.col("superseded") == F.col("decided")), "superseded")
        .when((F.col("candidate_count") > 0) & (F.col("rejected") == F.col("candidate_count")), "rejected")
        .otherwise("pending")
    )
    return (
        counted.withColumn("review_state", state)
        .withColumn("review_revision", F.greatest(F.coalesce("mapping_revision", zero), F.coalesce("own_revision", zero)))
        .drop("accepted", "deferred", "superseded", "rejected", "decided", "mapping_revision", "own_revision", "own_decision", "decisions")
    )


def candidate_queue(obligations: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ``review_queue`` of obligations that carry their ``candidates`` (see ``controls.with_candidates``).

    Candidates are already in the rows of their obligations, so only the latest decisions are gathered, one row for each
    obligation that has any; they are written, and while they are few Spark sends them along: no obligation is shuffled.
    """
    key = ["organization_id", "obligation_id"]
    latest = latest_decisions(ledger).select(*key, "mapping_id", "decision", "revision")
    own = F.col("mapping_id").isNull()
    decided = latest.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.when(~own, F.struct("mapping_id", F.struct("decision", "revision").alias("d"))))).alias("decisions"),
        F.max(F.when(own, F.col("decision"))).alias("own_decision"), F.max(F.when(own, F.col("revision"))).alias("own_revision"),
    )

    def candidate(c: Column) -> Column:
        fields = {"negative": -c["score"], "mapping_id": mapping_id(F.col("obligation_id"), c["control_version_id"])}
        return F.struct(*[fields.get(f, c[f]).alias(f) for f in CANDIDATE])

    rows = obligations.join(stage_table(decided, "latest-decisions"), key, "left")
    return _with_state(rows.withColumn("candidates", _decided(F.transform("candidates", candidate))))


def filter_queue(
    queue: DataFrame,
    state: str | None = None,
    regulation_id: str | None = None,
    section_key: str | None = None,
    control_version_id: str | None = None,
    text: str | None = None,
    min_confidence: float | None = None,
    max_confidence: float | None = None,
) -> DataFrame:
    """Narrow the queue; plain conditions on the obligation are pushed below the joins by the optimizer."""
    if state:
        queue = queue.where(F.col("review_state") == state)
    if regulation_id:
        queue = queue.where(F.col("regulation_id") == regulation_id)
    if section_key:
        queue = queue.where(F.col("section_key") == section_key)
    if control_version_id:
        queue = queue.where(
            F.exists(F.coalesce("candidates", F.array()), lambda c: c["control_version_id"] == control_version_id)
        )
    if text:
        names = F.transform("candidates", lambda c: c["control_key"])
        titles = F.transform("candidates", lambda c: c["control_title"])
        haystack: Column = F.concat_ws(
            " ", "regulation_id", "regulation_title", "section_key", "heading", "action", "evidence", names, titles
        )
        queue = queue.where(F.lower(haystack).contains(text.casefold().strip()))
    if min_confidence is not None:
        queue = queue.where(F.col("confidence") >= min_confidence)
    if max_confidence is not None:
        queue = queue.where(F.col("confidence") <= max_confidence)
    return queue


def page_queue(queue: DataFrame, sort: str = "confidence_asc", limit: int = 50, after: Row | None = None) -> DataFrame:
    """The next ``limit`` rows behind the row ``after`` (from the beginning without one), with ``total``, the length of the queue.

    A page begins behind the last row of the page before, by the sort columns and then the obligation, so equal
    confidences neither repeat nor miss a row, and a late page costs what the first one does. ``queue`` is read twice:
    give a stored table where it is dear.
    """
    order = {
        "confidence_asc": [F.col("confidence")],
        "confidence_desc": [-F.col("confidence")],
        "section": [F.col("regulation_id"), F.col("section_key")],
    }[sort] + [F.col("obligation_id")]
    place = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    rest = queue
    if after is not None:
        given = {"confidence_asc": ["confidence"], "confidence_desc": ["confidence"], "section": ["regulation_id", "section_key"]}[sort]
        values = [-after[c] if sort == "confidence_desc" else after[c] for c in given] + [after["obligation_id"]]
        rest = queue.where(place > F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(values)]))
    return attach_row(rest.orderBy(*order).limit(limit), queue.agg(F.count("*").alias("total"))).orderBy(*order)


def dedupe_requests(requests: DataFrame) -> DataFrame:
    """First request of each idempotency key."""
    return first_per_key(requests, ["organization_id", "idempotency_key"], ["requested_at"])
