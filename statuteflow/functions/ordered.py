"""Running ranks and sums inside groups that may be very large, and set fingerprints.

A plain window puts a whole group on one task. Here the caller names a *chunk* - an expression that never
decreases along the order (a date, an id range, a hash prefix). Rows are numbered inside (group, chunk), chunk
totals are summed with a light window over chunks, and the offset is joined back, so a group that holds a third
of the table is still spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[Column | str],
    out: str,
    weight: Column | None = None,
) -> DataFrame:
    """Add ``out``: sum of ``weight`` (1 by default) over the rows of the group up to and including this one.

    Keys and chunk travel as one struct, in which nulls are equal to each other: no row is lost for a null.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    base = df.withColumns({"__group": F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], chunk.alias("chunk")), "__weight": weight})
    totals = base.groupBy("__group").agg(F.sum("__weight").alias("__total"))
    before = Window.partitionBy(*[f"__group.k{i}" for i in range(len(keys))]).orderBy("__group.chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__group", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    local = Window.partitionBy("__group").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        base.withColumn("__local", F.sum("__weight").over(local))
        .join(offsets, "__group")
        .withColumn(out, F.col("__local") + F.col("__offset"))
        .drop("__group", "__weight", "__local", "__offset")
    )


def hash_chunk(digest: Column | str, digits: int = 3) -> Column:
    """Chunk for rows ordered by a hex digest: its first digits (4096 even chunks by default)."""
    return F.substring(digest, 1, digits)


def below_cut(df: DataFrame, keys: Sequence[str], digest: Column, n: int, digits: int = 4) -> DataFrame:
    """The rows of each key that can be among the ``n`` with the smallest ``digest`` (hex), with ``__key`` and ``__digest``.

    Digests are even, so a histogram of their first ``digits`` tells where the n-th row of a key is: about n rows and a
    16 ** digits-th of the key are left. The histogram has a row for each key and prefix at most. Nulls in keys are equal.
    """
    marked = df.withColumns({"__key": F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("all")), "__digest": digest})
    marked = marked.withColumn("__prefix", F.substring("__digest", 1, digits))
    histogram = marked.groupBy("__key", "__prefix").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("__key").orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = histogram.withColumn("before", before).where(F.col("before") < n).groupBy("__key").agg(F.max("__prefix").alias("__cut"))
    return marked.join(cuts, "__key").where(F.col("__prefix") <= F.col("__cut")).drop("__prefix", "__cut")


def smallest_per_key(df: DataFrame, keys: Sequence[str], digest: Column, n: int, out: str, digits: int = 4) -> DataFrame:
    """The ``n`` rows of each key with the smallest ``digest`` (hex), and their place from 1 as ``out``.

    Only rows up to a cut are ranked (see below_cut), and the plan is the same for any n.
    """
    place = F.row_number().over(Window.partitionBy("__key").orderBy("__digest"))
    return below_cut(df, keys, digest, n, digits).withColumn(out, place).where(F.col(out) <= n).drop("__key", "__digest")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, as an aggregate: copies are folded before the shuffle."""
    payload = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *payload)).alias("__row")
    return df.groupBy(*keys).agg(first).select(*keys, "__row.*").select(*df.columns)


def set_fingerprint(df: DataFrame, columns: Sequence[str], alias: str = "fingerprint") -> DataFrame:
    """One row: count and a fingerprint of the rows as a multiset.

    Every row is hashed on its own; the hashes are added, so the result does not depend on order or on how the
    rows are spread, and partial sums fold on the map side. Equal sets give equal fingerprints.
    """
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return df.select(digest.alias("__digest")).agg(*fingerprint_columns(F.col("__digest"), alias))


def fingerprint_columns(digest: Column, alias: str = "fingerprint") -> tuple[Column, Column]:
    parts = [
        F.sum(F.conv(F.substring(digest, start, 12), 16, 10).cast("decimal(20,0)")).cast("string")
        for start in (1, 13, 25, 37)
    ]
    count = F.count("*")
    return (
        count.alias("rows"),
        F.sha2(F.concat_ws(":", count.cast("string"), *parts), 256).alias(alias),
    )


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], schema: T.StructType | str, step) -> DataFrame:
    """Sequential fold per key with constant memory.

    For rules where each row depends on the state the previous ones left. Rows are hashed by key and sorted inside
    the partitions; ``step(state, row) -> (state, output tuple)`` then streams over them, so no group is ever
    gathered in memory. ``state`` is None on the first row of a key.
    """
    columns = list(df.columns)
    key_positions = [columns.index(k) for k in keys]
    out_schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = [f.name for f in out_schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False, name=None):
                key = tuple(row[i] for i in key_positions)
                if key != current:
                    current, state = key, None
                state, out = step(state, dict(zip(columns, row)))
                rows.append(out)
            yield pd.DataFrame(rows, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, out_schema)
