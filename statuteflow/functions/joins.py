"""Joins that check the size of the side they replicate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 64


def join_checked(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", max_rows: int = BROADCAST_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Broadcast ``small`` where it is proven to be at most ``max_rows`` long; otherwise a salted shuffle join.

    The salt spreads each key of the big side over ``SALTS`` tasks, so a key with a third of the rows is split.
    Use it where the small side is expected to be small but nothing in its definition says so.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot replicate the right side of a {how} join")
    if rows is None:  # not counted by the caller yet
        rows = small.limit(max_rows + 1).count()
    if rows <= max_rows:
        return big.join(F.broadcast(small), list(on), how)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row result (an aggregate without keys) to every row, as one scalar subquery."""
    packed = row.select(F.struct(*row.columns).alias("__row")).scalar()
    return df.withColumn("__row", packed).select(*df.columns, "__row.*")
