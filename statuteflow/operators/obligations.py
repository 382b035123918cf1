"""Obligations: extraction, scoring, incremental runs, listings and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.scoring import calibrate
from ..functions.text import deadline, let, modality, normalize_ws, obligation_fingerprint, sentences


def _statements(body: Column) -> Column:
    """Array of (evidence, subject, modality, action) of a text.

    Sentences without a modal verb are dropped before the three captures run; the filter cannot lose a match
    because every modal form contains one of its words.
    """

    def captured(sentence: Column) -> Column:
        capture = lambda i: F.regexp_extract_all(sentence, F.lit(V.MODALITY), F.lit(i))
        return F.transform(
            F.arrays_zip(capture(1).alias("subject"), capture(2).alias("verb"), capture(3).alias("action")),
            lambda m: F.struct(
                sentence.alias("evidence"), F.regexp_replace(normalize_ws(m["subject"]), ",+$", "").alias("subject"),
                modality(m["verb"]).alias("modality"), normalize_ws(m["action"]).alias("action"),
            ),
        )

    binding = F.filter(sentences(body), lambda s: s.rlike(r"(?i)must|shall|required\s+to"))
    return F.flatten(F.transform(binding, captured))


def _first_of_each(statements: Column) -> Column:
    """Keep the first statement of each (modality, evidence without case)."""
    key = lambda x: F.concat_ws("|", x["modality"], normalize_ws(F.lower(x["evidence"])))
    return let(
        statements,
        lambda all_: let(
            F.transform(all_, key), lambda keys: F.filter(all_, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
        ),
    )


def extract_obligations(sections: DataFrame, once_per_section: bool = False) -> DataFrame:
    """One row per binding statement: keeps the section's columns but ``body``, adds evidence, subject, modality, action.

    With ``once_per_section`` a statement that a section repeats is kept once. That is settled inside the row.
    """
    keep = [c for c in sections.columns if c != "body"]
    body = F.col("body")
    # The cheap test on the whole text comes first: most sections of a rule book bind nobody.
    found = sections.where(body.rlike(r"(?i)must|shall|required\s+to"))
    rows = _first_of_each(_statements(body)) if once_per_section else _statements(body)
    return found.select(*keep, F.explode(rows).alias("s")).select(*keep, "s.*")


def score_obligations(candidates: DataFrame) -> DataFrame:
    """Add deadline, rule ids, raw and calibrated confidence, routing and fingerprint."""
    s = V.RULE_SCORES
    phrase = F.size(F.split("action", " ")) >= 3
    timed = F.col("deadline_text").isNotNull()
    prohibits = F.col("modality").isin("must_not", "shall_not")
    add = lambda condition, rule: F.when(condition, s[rule]).otherwise(0.0)
    raw = (
        F.lit(s["base"])
        + add(phrase, "action_phrase")
        + add(timed, "temporal_constraint")
        + add(prohibits, "explicit_prohibition")
    )
    rules = F.array(
        F.lit("binding_modality"),
        F.lit("explicit_subject"),
        F.when(phrase, "action_phrase"),
        F.when(timed, "temporal_constraint"),
        F.when(prohibits, "explicit_prohibition"),
    )
    return (
        candidates.withColumn("deadline_text", deadline("action"))
        .withColumn("rule_ids", F.filter(rules, lambda x: x.isNotNull()))
        .withColumn("raw_confidence", F.least(F.round(raw, 3), F.lit(s["cap"])))
        .withColumn("confidence", calibrate("raw_confidence"))
        .withColumn("requires_review", F.col("confidence") < V.REVIEW_THRESHOLD)
        .withColumn("status", F.when(F.col("requires_review"), "needs_review").otherwise("candidate"))
        .withColumn("fingerprint", obligation_fingerprint("section_key", "modality", "evidence"))
    )


def obligations_of(sections: DataFrame) -> DataFrame:
    """Scored obligations, one per (version, fingerprint).

    The fingerprint holds the section key, which is unique in a version, so equal fingerprints can only come from
    one section: repeats are dropped inside the section's row, and nothing is shuffled.
    """
    scored = score_obligations(extract_obligations(sections, once_per_section=True))
    return scored.withColumn("obligation_id", F.sha2(F.concat_ws(":", "version_id", "fingerprint"), 256))


def incremental_extraction(sections: DataFrame, version_rows: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new obligations, new ledger rows) of the versions without a run; runs that find nothing are recorded too."""
    done = ledger.where(F.col("extraction_method") == V.EXTRACTION_METHOD).select("version_id")
    pending = version_rows.select("version_id").distinct().join(done, "version_id", "left_anti")
    found = obligations_of(sections.join(pending, "version_id", "left_semi"))
    counts = found.groupBy("version_id").agg(F.count("*").alias("candidate_count"))
    runs = (
        pending.join(counts, "version_id", "left")
        .fillna(0, ["candidate_count"])
        .withColumn("extraction_method", F.lit(V.EXTRACTION_METHOD))
        .withColumn("calibration_policy_id", F.lit(V.CALIBRATION_POLICY))
    )
    return found, runs


def list_obligations(
    obligations: DataFrame, limit: int = 100, offset: int = 0, regulation_id=None, version_id=None, status=None
) -> DataFrame:
    """Newest versions first, then document order."""
    for name, value in (("regulation_id", regulation_id), ("version_id", version_id), ("status", status)):
        if value is not None:
            obligations = obligations.where(F.col(name) == value)
    return obligations.orderBy(F.desc("ordinal"), "position", "obligation_id").offset(offset).limit(limit)


def register_summary(obligations: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row: total, needing review, and without a control candidate."""
    mapped = mappings.select("obligation_id").distinct().withColumn("mapped", F.lit(True))
    return obligations.join(mapped, "obligation_id", "left").agg(
        F.count("*").alias("total"),
        F.count_if("requires_review").alias("requires_review"),
        F.count_if(F.col("mapped").isNull()).alias("without_candidates"),
    )


def extraction_evaluation(predicted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of predicted against expected keys (both sides distinct)."""
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    e = expected.select(*keys).distinct().withColumn("e", F.lit(1))
    counts = p.join(e, keys, "full_outer").agg(
        F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("true_positive"),
        F.count_if(F.col("e").isNull()).alias("false_positive"),
        F.count_if(F.col("p").isNull()).alias("false_negative"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return (
        counts.withColumn("precision", ratio(F.col("true_positive"), F.col("true_positive") + F.col("false_positive")))
        .withColumn("recall", ratio(F.col("true_positive"), F.col("true_positive") + F.col("false_negative")))
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
