"""Numeric scalar functions: similarity, calibration, temperature, retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .text import _c, let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where either vector has no length."""
    a, b = _c(a), _c(b)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def has_dimension(vector: Column | str, dimensions: int = V.EMBEDDING_DIMENSIONS) -> Column:
    return F.coalesce(F.size(_c(vector)) == dimensions, F.lit(False))


def calibrate(raw: Column | str) -> Column:
    """Value of the first calibration bin whose upper bound is not below the raw score."""
    raw = _c(raw)
    *bins, (_, last) = V.CALIBRATION_BINS
    expr = None
    for upper, value in bins:
        expr = F.when(raw <= upper, value) if expr is None else expr.when(raw <= upper, value)
    return expr.otherwise(last)


def temperature_scale(probabilities: Column | str, temperature: Column | float) -> Column:
    """Map of label to probability after dividing the log scores by the temperature."""
    temperature = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    scaled = F.transform_values(
        _c(probabilities), lambda _, p: F.exp(F.log(F.greatest(p, F.lit(1e-12))) / temperature)
    )
    return let(
        F.struct(scaled.alias("m"), F.aggregate(F.map_values(scaled), F.lit(0.0), lambda s, x: s + x).alias("total")),
        lambda v: F.transform_values(v["m"], lambda _, p: p / v["total"]),
    )


def top_label(probabilities: Column | str) -> Column:
    """Struct (confidence, label) of the most probable label; among equals the first label in name order."""
    entries = F.transform(
        F.map_entries(_c(probabilities)),
        lambda e: F.struct((-e["value"]).alias("negative"), e["key"].alias("label")),
    )
    best = F.array_min(entries)
    return F.struct((-best["negative"]).alias("confidence"), best["label"].alias("label"))


def retry_delay(attempt: Column | str, base: int = 5, cap: int = 300) -> Column:
    """Seconds before the next ingestion attempt (the fixed part; jitter adds at most a quarter)."""
    attempt = _c(attempt)
    return F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)))).cast("bigint")


def outbox_delay(attempt: Column | str) -> Column:
    """Seconds before an outbox event is tried again; null once it is dead."""
    attempt = _c(attempt)
    return F.when(attempt < V.OUTBOX_ATTEMPTS, retry_delay(attempt, base=1, cap=300))


def source_delay(poll_minutes: Column | str, failures: Column | str) -> Column:
    """Minutes before a source is checked again."""
    return F.least(F.lit(1440.0), _c(poll_minutes) * F.pow(F.lit(2.0), _c(failures))).cast("bigint")
