"""Ingestion jobs as a fold over their events: lease, retry, dead letter, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import fold_sorted

JOB_STATE = "job_id string, at long, event_id long, event string, accepted boolean, status string, attempts int, replays int, not_before long, lease_until long"


def job_transition(state, event: str, at: int, lease: int = 120, max_attempts: int = 5, base: int = 5, cap: int = 300):
    """(state', accepted) after one event; times are seconds. A state is (status, attempts, replays, not_before, lease_until).

    Events: ``claim``, ``complete``, ``fail`` (permanent), ``error`` (transient), ``replay``. A lease keeps others from
    claiming; a worker whose lease has ended still owns the job until someone else claims it.
    """
    status, attempts, replays, not_before, lease_until = state or ("queued", 0, 0, 0, 0)
    if event == "claim":
        live = status == "processing" and lease_until > at
        if status in ("queued", "failed", "processing") and not live and not_before <= at:
            return ("processing", attempts, replays, 0, at + lease), True
    elif event == "complete" and status == "processing":
        return ("completed", attempts, replays, 0, 0), True
    elif event == "fail" and status == "processing":
        return ("failed", attempts, replays, 0, 0), True
    elif event == "error" and status == "processing":
        attempts += 1
        if attempts >= max_attempts:
            return ("dead_letter", attempts, replays, 0, 0), True
        return ("queued", attempts, replays, at + min(cap, base * 2 ** (attempts - 1)), 0), True
    elif event == "replay" and status in ("failed", "dead_letter"):
        return ("queued", 0, replays + 1, 0, 0), True
    return (status, attempts, replays, not_before, lease_until), False


def fold_jobs(events: DataFrame, lease: int = 120, max_attempts: int = 5) -> DataFrame:
    """State of each job after each of its events (job_id, at, event_id, event), streamed in order per job."""

    def step(state, row):
        state, accepted = job_transition(state, row["event"], int(row["at"]), lease, max_attempts)
        return state, (row["job_id"], int(row["at"]), int(row["event_id"]), row["event"], accepted, *state)

    return fold_sorted(events.select("job_id", "at", "event_id", "event"), ["job_id"], ["at", "event_id"], JOB_STATE, step)


def lease_expiries(states: DataFrame, until: int) -> DataFrame:
    """job_id, at: leases of ``fold_jobs`` that ended by ``until`` (seconds) before the job's next accepted event."""
    following = F.lead("at").over(Window.partitionBy("job_id").orderBy("at", "event_id"))
    accepted = states.where("accepted").withColumn("following", following)
    ended = F.col("lease_until") <= F.coalesce("following", F.lit(until))
    return accepted.where((F.col("event") == "claim") & ended).select("job_id", F.col("lease_until").alias("at"))
