"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

The rates w of the documents minimise the entropy sum(size * w * (log(w / prior) - 1)) under one token constraint per
source, sum(size * w) = target. The dual has one multiplier per source and is convex; its Newton steps need the mass and
slope of every source, one distributed aggregate. The solution tilts the prior rates exponentially. Rates become whole
copies by rounding their running sum, largest documents first, so a source misses its target by less than about half a
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage_table
from .registry import query

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0  # weights of the sources in turn; share of all sizes; times a document may be taken
UNIT = 1 << 20  # rates are rounded to this fraction before they are summed, so that sums do not depend on their order
TOLERANCE, MOST_STEPS = 1e-12, 60


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: ``share`` of all sizes by ``weights`` in turn, at most ``most`` times a source's size.

    Sources come by code point, null last. What a full source cannot take is shared again by weight: sources are filled
    in the order of most * size / weight, and the common level is found where the next one would not be full. Windows
    run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_room = Window.orderBy("room", "number")
    filled = totals.select("*", number.alias("number"), weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    filled = filled.withColumn("room", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    filled = filled.withColumn("level", left / F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    first = F.min_by(F.when(F.col("level") <= F.col("room"), F.col("level")), F.when(F.col("level") <= F.col("room"), F.struct("room", "number"))).over(whole)
    return filled.withColumn("level", first).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def tilts(masses: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """source, source_size, target, tilt: Newton iterations on the dual. ``masses``: source, prior, mass (tokens).

    Each iteration is one aggregate over the masses, joined with the multipliers; the driver sees only the largest
    error. Steps are cut to 1, which keeps them on the convex side. A source without tokens or target has tilt null.
    """
    masses = stage_table(masses.where("prior > 0"), "masses")
    # above this tilt every document of the source is at the limit
    tops = masses.groupBy("source").agg((F.log(F.lit(most)) - F.log(F.min("prior"))).alias("top"))
    start = F.when((F.col("target") > 0) & (F.col("source_size") > 0), F.least(F.lit(0.0), F.col("top")))
    now = targets.alias("t").join(tops.alias("m"), F.col("m.source").eqNullSafe(F.col("t.source")), "left").select("t.*", "top", start.alias("tilt"))
    now = stage_table(now, "tilts")
    for _ in range(MOST_STEPS):
        free = F.col("prior") * F.exp("tilt")
        sums = masses.alias("m").join(now.alias("t"), F.col("m.source").eqNullSafe(F.col("t.source"))).groupBy("t.source").agg(
            F.sum(F.col("mass") * F.least(F.lit(most), free)).alias("reached"),
            F.sum(F.when(free <= most * (1 + 1e-9), F.col("mass") * free)).alias("slope"),
        )
        missing = F.col("target") - F.col("reached")
        error = F.abs(F.try_divide(missing, F.col("target")))
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(missing, F.col("slope"))))
        tilt = F.least(F.col("top"), F.col("tilt") + F.when(error > TOLERANCE, F.coalesce(step, F.lit(0.0))).otherwise(0.0))
        moved = now.alias("t").join(sums.alias("s"), F.col("s.source").eqNullSafe(F.col("t.source")), "left").select(
            "t.source", "t.source_size", "t.target", "t.top", tilt.alias("tilt"), error.alias("error"))
        moved = stage_table(moved, "tilts")
        worst = moved.agg(F.max("error")).first()[0]
        now = moved.drop("error")
        if worst is None or worst <= TOLERANCE:
            break
    return now


def _two_digits(size: Column) -> Column:
    """The size rounded down to two digits."""
    text = size.cast("string")
    return F.rpad(F.substring(text, 1, 2), F.length(text), F.lit("0")).cast("long")


def rounded_copies(rated: DataFrame) -> DataFrame:
    """Add ``copies``: differences of the rounded running sum of ``rate`` inside each source, largest sizes first.

    The sum runs in parts (source, size in two digits, hash of the id): within a part, over the parts of a size, over
    the sizes of a source. A source or size that holds a third of all rows is spread over its parts.
    """
    spread = rated.withColumns({
        "units": F.round(F.col("rate") * UNIT).cast("long"),
        "coarse": _two_digits(F.col("size")),
        "part": F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2), 16, 10).cast("int"),
        "source": F.struct("source"),  # a null source joins like any other
    })
    parts = spread.groupBy("source", "coarse", "part").agg(F.sum("units").alias("total"))
    sizes = parts.groupBy("source", "coarse").agg(F.sum("total").alias("total"))
    before = lambda keys, order: F.sum("total").over(Window.partitionBy(*keys).orderBy(*order)) - F.col("total")
    sizes = sizes.select("source", "coarse", before(["source"], [F.desc("coarse")]).alias("before_size"))
    parts = parts.select("source", "coarse", "part", before(["source", "coarse"], ["part"]).alias("before_part"))
    offsets = parts.join(sizes, ["source", "coarse"]).select("source", "coarse", "part", (F.col("before_size") + F.col("before_part")).alias("offset"))
    inside = Window.partitionBy("source", "coarse", "part").orderBy(F.desc("size"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = spread.withColumn("here", F.sum("units").over(inside)).join(offsets, ["source", "coarse", "part"])
    upto = F.col("offset") + F.col("here")
    whole = lambda x: F.floor((x + UNIT // 2) / UNIT)
    return summed.withColumns({"copies": (whole(upto) - whole(upto - F.col("units"))).cast("long"), "source": F.col("source.source")}).drop("units", "coarse", "part", "here", "offset")


def balance_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, prior: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for every row of ``docs``.

    ``docs`` has doc_id, text, source; of the other columns those in ``carry`` come along as the struct ``rest``. Size is the number of words; a null or empty text has
    size 0 and is taken 0 times its 0 words. A null source is a source, the last one; null and repeated ids are rows like
    others (equal rows may be told apart by nothing, so which of them has the larger count does not matter). An empty
    table gives an empty result. ``prior``: rates before balancing, 1 by default; a null prior is 1.
    """
    rate = F.lit(1.0) if prior is None else F.coalesce(prior.cast("double"), F.lit(1.0))
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), rate.alias("prior"), *([F.struct(*carry).alias("rest")] if carry else []))
    rows = stage_table(rows, "sizes")
    masses = rows.groupBy("source", "prior").agg(F.sum("size").cast("double").alias("mass"))
    tilted = tilts(masses, source_targets(rows, weights, share, most), most)
    rated = rows.alias("r").join(tilted.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(
        "r.doc_id", "r.source", "size", "source_size", "target", *(["rest"] if carry else []),
        F.coalesce(F.least(F.lit(most), F.col("prior") * F.exp("tilt")), F.lit(0.0)).alias("rate"),
    )
    return rounded_copies(rated).withColumn("taken", F.col("copies") * F.col("size"))


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS number
  FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][number % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM totals),
filled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, (cap / weight, number)) FROM filled WHERE level <= cap / weight)) AS target
  FROM filled),
rated AS (
  SELECT doc_id, s.source, size, source_size, target,
         CASE WHEN target > 0 THEN round(target / source_size * {UNIT})::BIGINT ELSE 0 END AS units,
         (rpad(substr(size::VARCHAR, 1, 2), len(size::VARCHAR)::INT, '0'))::BIGINT AS coarse,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2))::INT AS part
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
summed AS (
  SELECT *, sum(units) OVER (PARTITION BY source ORDER BY coarse DESC, part, size DESC, doc_id NULLS FIRST
                             ROWS UNBOUNDED PRECEDING) AS upto FROM rated)
SELECT doc_id, source, size, source_size, target,
       (((upto + {UNIT // 2}) // {UNIT} - (upto - units + {UNIT // 2}) // {UNIT}))::BIGINT AS copies,
       (size * ((upto + {UNIT // 2}) // {UNIT} - (upto - units + {UNIT // 2}) // {UNIT}))::BIGINT AS taken
FROM summed"""


@query("op7_mix_sources", MIX_SQL)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with the words that the mix takes of it."""
    mixed = balance_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
