"""Operational rules as batch jobs: queues, sources, metrics, alerts, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed as V
from ..functions.ordered import running_sum
from ..functions.scoring import source_delay


def url_policy(urls: DataFrame, allowed_hosts: DataFrame) -> DataFrame:
    """Add ``reject``: why a source URL may not be fetched (null where it may)."""
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    port = F.regexp_extract(F.coalesce(F.try_parse_url("url", F.lit("AUTHORITY")), F.lit("")), r":(\d+)$", 1)
    known = allowed_hosts.select(F.lower("host").alias("__host")).distinct().withColumn("__ok", F.lit(True))
    return (
        urls.withColumn("__host", F.regexp_replace(host, r"\.+$", ""))
        .join(known, "__host", "left")
        .withColumn(
            "reject",
            F.when(~F.coalesce(F.try_parse_url("url", F.lit("PROTOCOL")) == "https", F.lit(False)), "not_https")
            .when(F.try_parse_url("url", F.lit("USERINFO")).isNotNull(), "credentials")
            .when(~port.isin("", "443"), "port")
            .when(F.col("__ok").isNull(), "host_not_allowed"),
        )
        .drop("__host", "__ok")
    )


def jobs_by_status(jobs: DataFrame, by_tenant: bool = True) -> DataFrame:
    return jobs.groupBy(*(["organization_id"] if by_tenant else []), "status").agg(F.count("*").alias("jobs"))


def queue_health(outbox: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per tenant: pending and exhausted outbox events and dead jobs; both sides are counted before they meet."""
    events = outbox.groupBy("organization_id").agg(
        F.count_if(F.col("published_at").isNull() & F.col("dead_lettered_at").isNull()).alias("pending_outbox"),
        F.count_if(F.col("published_at").isNull() & F.col("dead_lettered_at").isNotNull()).alias("exhausted_outbox"),
    )
    dead = jobs.groupBy("organization_id").agg(F.count_if(F.col("status") == "dead_letter").alias("dead_letter_jobs"))
    return events.join(dead, "organization_id", "full_outer").fillna(0)


def request_metrics(requests: DataFrame) -> DataFrame:
    """Per (method, route, status): requests, latency sum and the cumulative bucket counts, in one aggregate."""
    buckets = [F.count_if(F.col("duration") <= le).alias(f"le_{i}") for i, le in enumerate(V.LATENCY_BUCKETS)]
    return requests.groupBy("method", "route", "status").agg(
        F.count("*").alias("requests"), F.sum("duration").alias("latency_sum"), *buckets
    )


def latency_histogram(metrics: DataFrame) -> DataFrame:
    """Cumulative buckets per (method, route) as rows (le, n)."""
    folded = metrics.groupBy("method", "route").agg(
        *[F.sum(f"le_{i}").alias(f"le_{i}") for i in range(len(V.LATENCY_BUCKETS))]
    )
    rows = F.array(*[F.struct(F.lit(le).alias("le"), F.col(f"le_{i}").alias("n")) for i, le in enumerate(V.LATENCY_BUCKETS)])
    return folded.select("method", "route", F.explode(rows).alias("b")).select("method", "route", "b.*")


def window_facts(requests: DataFrame, minutes: int) -> DataFrame:
    """Per tumbling window: requests, server errors and requests slower than one second."""
    return requests.groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") >= 500).alias("server_errors"),
        F.count_if(F.col("duration") > 1).alias("slow"),
    ).select(F.col("w.start").alias("window_start"), F.lit(minutes).alias("minutes"), "requests", "server_errors", "slow")


def alert_columns(facts: DataFrame) -> DataFrame:
    """Alerts of a window: more than 2 % server errors over five minutes; p95 above one second over ten.

    The 95th percentile (nearest rank) is above a second exactly when fewer than ceil(0.95 n) requests are within
    it, so two counts decide it and no percentile state is kept.
    """
    within = F.col("requests") - F.col("slow")
    return facts.withColumn(
        "error_alert", (F.col("minutes") == 5) & (F.col("server_errors") * 100 > F.col("requests") * 2)
    ).withColumn("latency_alert", (F.col("minutes") == 10) & (within < F.ceil(F.col("requests") * 95 / 100)))


def backlog_alerts(outbox: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """Per tenant: any dead job, and an unpublished event older than five minutes."""
    oldest = outbox.where("published_at IS NULL AND dead_lettered_at IS NULL").groupBy("organization_id").agg(
        F.min("created_at").alias("oldest")
    )
    dead = jobs.groupBy("organization_id").agg(F.bool_or(F.col("status") == "dead_letter").alias("dead_letter_alert"))
    return oldest.join(dead, "organization_id", "full_outer").select(
        "organization_id", F.coalesce("dead_letter_alert", F.lit(False)).alias("dead_letter_alert"),
        F.coalesce(F.col("oldest") < as_of - F.expr("INTERVAL 5 MINUTES"), F.lit(False)).alias("backlog_alert"),
    )


def dedupe_jobs(jobs: DataFrame) -> DataFrame:
    """First job of each (tenant, regulation, content); copies fold before the shuffle."""
    return jobs.groupBy("organization_id", "regulation_id", "content_hash").agg(
        F.min(F.struct("created_at", "job_id")).alias("j"), F.count("*").alias("requests")
    ).select("organization_id", "regulation_id", "content_hash", "j.job_id", "requests")


def due_sources(sources: DataFrame, as_of: Column, limit: int = 100) -> DataFrame:
    """Enabled sources whose time has come, oldest first, with their next lease."""
    return (
        sources.where(F.col("enabled") & (F.col("next_check_at") <= as_of))
        .orderBy("next_check_at", "source_id")
        .limit(limit)
        .withColumn("leased_until", as_of + F.expr("INTERVAL 5 MINUTES"))
    )


def publishable_events(outbox: DataFrame, as_of: Column, limit: int = 100) -> DataFrame:
    """Unpublished live events that are due, oldest first."""
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= as_of)
    return (
        outbox.where(F.col("published_at").isNull() & F.col("dead_lettered_at").isNull() & due)
        .orderBy("created_at", "event_id")
        .limit(limit)
    )


def source_check_fold(checks: DataFrame, chunk: Column) -> DataFrame:
    """Per check: outcome, consecutive failures so far and minutes to the next check.

    ``checks``: source_id, checked_at, check_id, http_status (null for a failed fetch), content_hash, poll_minutes.
    Failures since the last success are counted as islands: the island is the number of successes before, both
    counts run chunk by chunk, so one busy source is spread over its chunks.
    """
    failed = F.col("http_status").isNull()
    order = ["checked_at", "check_id"]
    first_seen = checks.where("content_hash IS NOT NULL AND http_status = 200").groupBy("source_id", "content_hash").agg(
        F.min(F.struct(*order)).alias("first_seen")
    )
    base = running_sum(checks, ["source_id"], chunk, order, "island", F.when(failed, 0).otherwise(1))
    counted = running_sum(base, ["source_id", "island"], chunk, order, "consecutive_failures", failed.cast("int"))
    status = (
        F.when(failed, "failed")
        .when(F.col("http_status") == 304, "unchanged")
        .when(F.struct(*order) == F.col("first_seen"), "change_queued")
        .otherwise("duplicate")
    )
    return counted.join(first_seen, ["source_id", "content_hash"], "left").select(
        "source_id", *order, status.alias("status"), "consecutive_failures",
        F.when(failed, source_delay("poll_minutes", "consecutive_failures")).otherwise(F.col("poll_minutes")).alias("next_check_minutes"),
    )


def rate_limit(requests: DataFrame, limits: dict[str, int] = V.RATE_LIMITS) -> DataFrame:
    """Per minute and (client, organization, scope): how many requests pass and how many are refused."""
    limit = F.when(F.col("scope") == "search", limits["search"]).otherwise(limits["all"])
    return (
        requests.groupBy(F.window("ts", "1 minute").alias("w"), "client_id", "organization_id", "scope")
        .agg(F.count("*").alias("requests"))
        .select(
            F.col("w.start").alias("window_start"), "client_id", "organization_id", "scope", "requests",
            F.least(F.col("requests"), limit).alias("allowed"), F.greatest(F.col("requests") - limit, F.lit(0)).alias("denied"),
        )
    )


def admitted_requests(requests: DataFrame, limits: dict[str, int] = V.RATE_LIMITS) -> DataFrame:
    """The requests that pass: ranks above the limit are dropped before the shuffle."""
    limit = F.when(F.col("scope") == "search", limits["search"]).otherwise(limits["all"])
    order = Window.partitionBy("client_id", "organization_id", "scope", F.date_trunc("minute", "ts")).orderBy("ts", "request_id")
    return (
        requests.withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= max(limits.values()))
        .where(F.col("n") <= limit)
        .drop("n")
    )


def audit_trail(events: DataFrame, entity_type: str | None = None, event_type: str | None = None) -> DataFrame:
    if entity_type:
        events = events.where(F.col("entity_type") == entity_type)
    if event_type:
        events = events.where(F.col("event_type") == event_type)
    return events.orderBy("created_at", "event_id")


def append_audit(events: DataFrame, path: str) -> None:
    events.withColumn("date", F.to_date("created_at")).write.mode("append").partitionBy("date").parquet(path)


def newest_jobs(jobs: DataFrame, limit: int = 100) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(limit)


def dashboard_summary(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Per tenant: completed jobs, failed or dead ones, enabled sources."""
    j = jobs.groupBy("organization_id").agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status").isin("failed", "dead_letter")).alias("failed"),
    )
    s = sources.groupBy("organization_id").agg(F.count_if("enabled").alias("enabled_sources"))
    return j.join(s, "organization_id", "full_outer").fillna(0)
