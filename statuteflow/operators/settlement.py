"""Idempotency keys that belong to a whole tenant, over ledgers that are folded target by target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table

KEY = ["organization_id", "idempotency_key"]


def settle_keys(requests: DataFrame, target: str, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Outcomes of ``fold`` where a key that one target has appended is taken for every other target of the tenant.

    ``requests``: organization_id, ``target``, idempotency_key, requested_at and what ``fold`` reads; ``fold`` also gets
    ``taken``, true for a request whose key another target appended earlier, and returns a row for each request with the
    same four columns and ``outcome``.

    Almost all keys are sent for one target. Targets without a shared key are folded once. The others are folded until no
    owner changes, first as if all keys were free: the earliest append of a key owns it, which takes the key from the
    others, which changes what they append. The earliest wrong outcome of a round is right in the next and stays, as it
    depends on earlier requests only, so the rounds end, and they end with the outcomes of one global order (requested_at,
    then target). The driver sees one row a round.
    """
    requests = stage_table(requests, "requests")
    shared = requests.groupBy(*KEY).agg(F.min(target).alias("low"), F.max(target).alias("high")).where("low <> high").select(*KEY)
    shared = stage_table(shared, "shared-keys")
    if not shared.limit(1).count():
        return fold(requests.withColumn("taken", F.lit(False)))
    own = ["organization_id", target]
    tied = requests.join(shared, KEY, "left_semi").select(*own).distinct()
    alone = fold(requests.join(tied, own, "left_anti").withColumn("taken", F.lit(False)))
    again = stage_table(requests.join(tied, own, "left_semi"), "tied-requests")
    owners, before = None, None
    while True:
        outcomes = stage_table(fold(_taken(again, owners, target)), "tied-outcomes")
        appended = outcomes.where("outcome = 'appended'").join(shared, KEY, "left_semi")
        owners = stage_table(appended.groupBy(*KEY).agg(F.min(F.struct("requested_at", F.col(target).alias("target"))).alias("owner")), "key-owners")
        now = owners.agg(F.count("*"), F.sum(F.xxhash64(*KEY, "owner").cast("decimal(38,0)"))).first()
        if now == before:
            return alone.union(outcomes.select(*alone.columns))
        before = now


def _taken(requests: DataFrame, owners: DataFrame | None, target: str) -> DataFrame:
    if owners is None:
        return requests.withColumn("taken", F.lit(False))
    earlier = F.col("owner") < F.struct(F.col("requested_at"), F.col(target).alias("target"))
    marked = requests.join(owners, KEY, "left")
    return marked.withColumn("taken", F.coalesce((F.col("owner.target") != F.col(target)) & earlier, F.lit(False))).drop("owner")
