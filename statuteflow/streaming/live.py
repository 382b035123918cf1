"""The operational rules on streams. Each has a batch twin in ``operators`` that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed as V
from ..operators.jobs import job_transition
from ..operators.operations import alert_columns
from ..operators.review import DECISION_OUTCOME, checked_requests, decision_step
from ..session import work_folder


def read_events(spark: SparkSession, path: str, schema, pattern: str = "events.parquet") -> DataFrame:
    """A folder of Parquet files as a stream; times without a zone become UTC instants for the watermark."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now into a Parquet table of the shared folder, and read the table."""
    spark = stream.sparkSession
    target, checkpoint = work_folder(spark, name), work_folder(spark, f"{name}-checkpoint")
    run = (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .format("parquet")
        .start(target)
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def alert_windows(requests: DataFrame, minutes: int, delay: str = "10 minutes") -> DataFrame:
    """Window facts with their alerts, emitted once the watermark has passed the window."""
    facts = (
        requests.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(
            F.count("*").alias("requests"),
            F.count_if(F.col("status") >= 500).alias("server_errors"),
            F.count_if(F.col("duration") > 1).alias("slow"),
        )
        .select(F.col("w.start").alias("window_start"), F.lit(minutes).alias("minutes"), "requests", "server_errors", "slow")
    )
    return alert_columns(facts)


def rate_limit_windows(requests: DataFrame, delay: str = "10 minutes", limits: dict[str, int] = V.RATE_LIMITS) -> DataFrame:
    limit = F.when(F.col("scope") == "search", limits["search"]).otherwise(limits["all"])
    return (
        requests.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 minute").alias("w"), "client_id", "organization_id", "scope")
        .agg(F.count("*").alias("requests"))
        .select(
            F.col("w.start").alias("window_start"), "client_id", "organization_id", "scope", "requests",
            F.least(F.col("requests"), limit).alias("allowed"), F.greatest(F.col("requests") - limit, F.lit(0)).alias("denied"),
        )
    )


def first_jobs(jobs: DataFrame, delay: str) -> DataFrame:
    """First job of each (tenant, regulation, content) within the watermark."""
    return jobs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["organization_id", "regulation_id", "content_hash"])


JOB_ROW = "job_id string, at long, event string, accepted boolean, status string, attempts int, replays int"
EXPIRED = "lease_expired"


class JobLeases(StatefulProcessor):
    """Six numbers per job. Timers report leases that end and drop jobs that nothing has happened to for ``keep`` seconds."""

    def __init__(self, lease: int, max_attempts: int, keep: int):
        self.lease, self.max_attempts, self.keep = lease, max_attempts, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int, replays int, not_before long, lease_until long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = sorted(x for batch in rows for x in zip(batch["at"].tolist(), batch["event_id"].tolist(), batch["event"].tolist()))
        stored = tuple(self.job.get()) if self.job.exists() else None
        state, last, out = (stored[:5] if stored else None), (stored[5] if stored else 0), []
        for at, _, event in arrived:
            if state and at - last >= self.keep:
                state = None  # its timer has not come yet
            last = max(last, at)
            if state and state[0] == "processing" and 0 < state[4] <= at:
                state = self._expire(key, state, out)
            state, accepted = job_transition(state, event, at, self.lease, self.max_attempts)
            out.append((key[0], at, event, accepted, *state[:3]))
        self.job.update((*state, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state[0] == "processing" and state[4] > 0:
            self.handle.registerTimer(state[4] * 1000)
        self.handle.registerTimer((last + self.keep) * 1000)
        yield pd.DataFrame(out, columns=["job_id", "at", "event", "accepted", "status", "attempts", "replays"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.job.exists():
            return
        *state, last = self.job.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= (last + self.keep) * 1000:
            self.job.clear()
        elif state[0] == "processing" and 0 < state[4] * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            out: list = []
            self.job.update((*self._expire(key, tuple(state), out), last))
            yield pd.DataFrame(out, columns=["job_id", "at", "event", "accepted", "status", "attempts", "replays"])

    def _expire(self, key, state: tuple, out: list) -> tuple:
        """The lease is reported and forgotten; the job stays with its worker until another one claims it."""
        out.append((key[0], state[4], EXPIRED, True, *state[:3]))
        return (*state[:4], 0)


def job_states(events: DataFrame, lease: int = 120, max_attempts: int = 5, delay: str = "10 minutes", keep_days: int = 365) -> DataFrame:
    """State of each job after each event (job_id, ts, at, event_id, event), and a row for each lease that ends unused.

    Events of one trigger are applied in time order. A lease is reported when an event or the watermark passes its end. The
    state is of a fixed size per job, and goes ``keep_days`` after the job's last event.
    """
    columns = events.select("job_id", "ts", F.col("at").cast("long").alias("at"), F.col("event_id").cast("long").alias("event_id"), "event")
    return _stateful(columns.withWatermark("ts", delay).groupBy("job_id"), JobLeases(lease, max_attempts, keep_days * 86_400), JOB_ROW, "EventTime")


class DecisionLedger(StatefulProcessor):
    """Revisions and used keys of a tenant, as maps of which a request reads a few entries."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revisions = handle.getMapState("revisions", "obligation string, slot string", "revision int")
        self.used = handle.getMapState("used", "idempotency_key string", "obligation string, mapping string, revision int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, out = None, []
        arrived = []
        for batch in rows:
            names = list(batch.columns)
            arrived += batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None)
        for row in sorted((dict(zip(names, r)) for r in arrived), key=lambda r: (r["requested_at"], r["obligation_id"], r["idempotency_key"])):
            out.append(self._decide(row))
        frame = pd.DataFrame(out, columns=[field.split()[0] for field in DECISION_OUTCOME.split(", ")])
        yield frame.astype({"revision": "Int32", "supersedes": "Int32"})

    def _decide(self, row: dict) -> tuple:
        """The step of the batch ledger, over a state that holds what this request can depend on."""
        obligation, slot, key = row["obligation_id"], row["mapping_id"] or "", (row["idempotency_key"],)
        every = (obligation, "*")  # the highest revision of the obligation
        found = self.used.getValue(key) if self.used.containsKey(key) else None
        at = every if row["mapping_id"] is None else (obligation, slot)
        revisions = {slot: self.revisions.getValue(at)[0]} if self.revisions.containsKey(at) else {}
        taken = found is not None and found[0] != obligation
        used = {row["idempotency_key"]: (found[1], found[2])} if found is not None and not taken else {}
        (revisions, _), result = decision_step((revisions, used), row | {"taken": taken})
        if result[6] == "appended":
            highest = self.revisions.getValue(every)[0] if self.revisions.containsKey(every) else 0
            self.revisions.updateValue((obligation, slot), (revisions[slot],))
            self.revisions.updateValue(every, (max(highest, revisions[slot]),))
            self.used.updateValue(key, (obligation, row["mapping_id"], revisions[slot]))
        return result


def decision_outcomes(requests: DataFrame, obligations: DataFrame | None = None, mappings: DataFrame | None = None) -> DataFrame:
    """Outcome of each decision request as it arrives.

    Keys belong to the tenant, so its ledger is one sequence: it is the key of the stream. Its maps grow with the ledger
    in the state store, a request touches four entries of them.
    """
    return _stateful(checked_requests(requests, obligations, mappings).groupBy("organization_id"), DecisionLedger(), DECISION_OUTCOME, "None")


def _stateful(grouped, processor: StatefulProcessor, schema: str, time: str) -> DataFrame:
    grouped.session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return grouped.transformWithStateInPandas(processor, T._parse_datatype_string(schema), "Append", time)
