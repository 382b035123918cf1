"""Model-labelled consensus: holdouts, requests, two-vote and two-of-three decisions, comparison with people."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType
from pyspark.sql.window import Window

from ..functions import fixed as V
from ..functions.ordered import hash_chunk, running_sum, smallest_per_key
from ..functions.text import prompt, stable_rank, strip
from ..sources.records import violations
from .metrics import accuracy_report, class_report, macro_report


def holdout_split(records: DataFrame, evaluation_size: int, seed: str) -> DataFrame:
    """Add ``held_out`` (document-wise) and ``evaluation``.

    Documents are taken in hash order until they hold ``evaluation_size`` clauses; the first that many of their
    clauses, in hash order, are the evaluation. Document counts are summed by hash chunk.
    """
    per_document = records.groupBy("document_id").agg(F.count("*").alias("n")).withColumn(
        "rank_hash", stable_rank(seed, F.lit("document"), "document_id")
    )
    summed = running_sum(per_document, [], hash_chunk("rank_hash"), ["rank_hash"], "cumulative", F.col("n"))
    held = summed.where(F.col("cumulative") - F.col("n") < evaluation_size).select("document_id", F.lit(True).alias("held_out"))
    marked = records.join(held, "document_id", "left").fillna(False, ["held_out"])
    first = smallest_per_key(marked.where("held_out"), [], stable_rank(seed, F.lit("eval"), "clause_id"), evaluation_size, "r")
    return marked.join(first.select("clause_id", F.lit(True).alias("evaluation")), "clause_id", "left").fillna(False, ["evaluation"])


def label_requests(records: DataFrame, labelers: dict[str, tuple[str, str]]) -> DataFrame:
    """One request per clause and slot; ``labelers`` maps a slot to (labeler_id, model_id)."""
    slots = F.array(
        *[
            F.struct(
                F.lit(s).alias("slot"), F.lit(labeler).alias("labeler_id"), F.lit(model).alias("model_id"),
                F.lit(V.SLOTS[s][0]).alias("prompt_version"), F.lit(prompt(s)).alias("system_prompt"), F.lit(V.REQUEST_SCHEMA).alias("schema_version"),
                F.array(*[F.lit(x) for x in V.LABELS]).alias("allowed_labels"), F.lit(False).alias("production_ground_truth"),
            )
            for s, (labeler, model) in labelers.items()
        ]
    )
    return records.select("clause_id", "document_id", "regulator", "text", "text_sha256", F.explode(slots).alias("x")).select(
        F.concat(F.lower("x.slot"), F.lit("-"), "clause_id").alias("request_id"), "clause_id", "document_id", "regulator",
        "text", "text_sha256", "x.*",
    )


def request_order(requests: DataFrame, position: str = "sample_position") -> list[Column]:
    """Order of the streams: slot B runs backwards."""
    return [F.col("slot"), F.when(F.col("slot") == "B", -F.col(position)).otherwise(F.col(position))]


_IDENTITY = ("text_sha256", "labeler_id", "model_id", "prompt_version")


def unusable_answer(responses: DataFrame) -> Column:
    """True where ``label_answer_reject`` would refuse the answer; columns need not be written as JSON for that."""
    kinds = {f.name: f.dataType for f in responses.schema}
    if not isinstance(kinds["confidence"], NumericType) or not isinstance(kinds["rationale"], StringType):
        return F.lit(True)
    usable = (
        F.col("label").cast("string").isin(*V.LABELS) & (F.col("confidence") >= 0) & (F.col("confidence") <= 1)
        & (strip("rationale") != "")
    )
    return ~F.coalesce(usable, F.lit(False))


def response_violations(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(check, slot, clause_id): missing, repeated, unknown, mismatched or unusable responses.

    Both sides are numbered by key, where the join needs them: a second response is a repeated one.
    """
    place = F.row_number().over(Window.partitionBy("clause_id", "slot").orderBy("slot"))
    q = requests.select("slot", "clause_id", *[F.col(c).alias(f"q_{c}") for c in _IDENTITY]).withColumn("q", place)
    r = responses.select("slot", "clause_id", *_IDENTITY, unusable_answer(responses).alias("unusable")).withColumn("r", place)
    joined = r.join(q, ["clause_id", "slot"], "full_outer")  # the key with many values first, for the sorts
    both = F.col("q").isNotNull() & F.col("r").isNotNull()
    changed = F.lit(False)
    for c in _IDENTITY:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"q_{c}"))
    checks = {
        "missing_response": F.col("r").isNull(),
        "unknown_request": F.col("q").isNull(),
        "identity_mismatch": both & changed,
        "invalid_answer": both & F.col("unusable"),
        "duplicate_response": (F.col("r") == 2) & (F.coalesce("q", F.lit(1)) == 1),
    }
    failed = F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks.items()]), lambda x: x.isNotNull())
    broken = reduce(or_, [F.coalesce(bad, F.lit(False)) for bad in checks.values()])  # few rows are: only they get a list
    return joined.where(broken).select(F.explode(failed).alias("check"), "slot", "clause_id")


def pending_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests still to be sent: those without a response that carries the same identity."""
    return requests.join(responses.select("slot", "clause_id", *_IDENTITY), ["slot", "clause_id", *_IDENTITY], "left_anti")


def by_clause(responses: DataFrame) -> DataFrame:
    """Label and confidence of slots A and B side by side, as an aggregate per clause."""
    at = lambda s, c: F.max(F.when(F.col("slot") == s, F.col(c)))
    return responses.groupBy("clause_id").agg(
        *[at(s, c).alias(f"{c}_{s.lower()}") for s in ("A", "B") for c in ("label", "confidence")]
    )


def consensus(records: DataFrame, responses: DataFrame, threshold: float = V.SILVER_MINIMUM_CONFIDENCE) -> DataFrame:
    """Accept a clause where both models agree with enough confidence and it is not held out; else say why not."""
    joined = records.join(by_clause(responses), "clause_id")
    agreed = F.col("label_a") == F.col("label_b")
    confident = F.least("confidence_a", "confidence_b") >= threshold
    accepted = agreed & confident & ~F.col("held_out")
    return joined.withColumn("accepted", accepted).withColumn(
        "label", F.when(accepted, F.col("label_a"))
    ).withColumn(
        "reason", F.when(accepted, None).when(F.col("held_out"), "held_out").otherwise("disagreement_or_low_confidence")
    ).withColumn("label_source", F.when(accepted, "ai_consensus_silver"))


def consensus_report(decided: DataFrame) -> DataFrame:
    """One row of counts, with the label distribution in fixed columns."""
    return decided.agg(
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("routed_for_review"),
        F.count_if("held_out").alias("held_out"),
        *[F.count_if(F.col("accepted") & (F.col("label") == x)).alias(f"label_{x}") for x in V.LABELS],
    ).withColumn("training_eligible", F.col("accepted") >= V.SILVER_TRAINING_MINIMUM)


def disputes(decided: DataFrame) -> DataFrame:
    """Clauses for the third model: outside the holdout, labels differ."""
    return decided.where(~F.col("held_out") & (F.col("label_a") != F.col("label_b")))


def adjudication_requests(decided: DataFrame, labelers: dict[str, tuple[str, str]], third: tuple[str, str]) -> DataFrame:
    if third[0] in {v[0] for v in labelers.values()} or third[1] in {v[1] for v in labelers.values()}:
        raise ValueError("the third labeler needs an identity and a model of its own")
    return label_requests(disputes(decided), {"C": third})


def two_of_three(decided: DataFrame, third: DataFrame, threshold: float = V.SILVER_MINIMUM_CONFIDENCE) -> DataFrame:
    """Final verdict per clause outside the holdout. ``third``: clause_id, label_c, confidence_c."""
    open_ = decided.where(~F.col("held_out")).join(third, "clause_id", "left")
    with_a, with_b = F.col("label_c") == F.col("label_a"), F.col("label_c") == F.col("label_b")
    disputed = F.col("label_a") != F.col("label_b")
    support = F.when(with_a, F.col("confidence_a")).when(with_b, F.col("confidence_b"))
    wins = disputed & F.coalesce(F.least(support, F.col("confidence_c")) >= threshold, F.lit(False)) & support.isNotNull()
    return open_.withColumn(
        "final_label", F.when(F.col("accepted"), F.col("label_a")).when(wins, F.col("label_c"))
    ).withColumn(
        "verdict",
        F.when(F.col("accepted"), "ai_consensus_silver")
        .when(wins, "ai_two_of_three_silver")
        .when(~disputed, "low_confidence_agreement")
        .when(F.col("label_c").isNull(), "third_response_missing")
        .when(support.isNotNull(), "third_model_low_confidence")
        .otherwise("three_way_disagreement"),
    ).withColumn("supporting_slot", F.when(wins, F.when(with_a, "A").otherwise("B")))


def human_evaluation(human: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accuracy, macro and weighted F1, class report) of both slots against human labels (clause_id, human_label)."""
    predictions = responses.join(human, "clause_id").select(
        "slot", F.col("human_label").alias("expected"), F.col("label").alias("predicted"), "confidence"
    )
    classes = class_report(predictions, ["slot"])
    return accuracy_report(predictions, 0.0, ["slot"]), macro_report(classes, ["slot"]), classes


def human_agreement(human: DataFrame, responses: DataFrame, threshold: float = V.SILVER_MINIMUM_CONFIDENCE) -> DataFrame:
    """One row: model agreement, its accuracy, and the same for confident agreement (null where there is none)."""
    rows = human.join(by_clause(responses), "clause_id")
    agreed = F.col("label_a") == F.col("label_b")
    high = agreed & (F.least("confidence_a", "confidence_b") >= threshold)
    right = F.col("label_a") == F.col("human_label")
    return rows.agg(
        F.count("*").alias("clauses"), F.count_if(agreed).alias("consensus_count"),
        F.try_divide(F.count_if(agreed), F.count("*")).alias("consensus_coverage"),
        F.try_divide(F.count_if(agreed & right), F.count_if(agreed)).alias("consensus_accuracy"),
        F.count_if(high).alias("high_confidence_count"),
        F.try_divide(F.count_if(high & right), F.count_if(high)).alias("high_confidence_accuracy"),
    )


def error_rows(human: DataFrame, responses: DataFrame, threshold: float = V.SILVER_MINIMUM_CONFIDENCE) -> DataFrame:
    """Text-free rows for review: the models disagree, or one of them differs from the person."""
    rows = human.join(by_clause(responses), "clause_id")
    agreed = F.col("label_a") == F.col("label_b")
    error_a, error_b = F.col("label_a") != F.col("human_label"), F.col("label_b") != F.col("human_label")
    return rows.where(~agreed | error_a | error_b).select(
        "clause_id", "human_label", "label_a", "label_b", agreed.alias("labelers_agree"), error_a.alias("labeler_a_error"),
        error_b.alias("labeler_b_error"),
        (agreed & (F.least("confidence_a", "confidence_b") >= threshold)).alias("high_confidence_consensus"),
    )


def evaluation_progress(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.count("label").alias("completed"), F.count("*").alias("target")).withColumn(
        "status", F.when(F.col("completed") == F.col("target"), "complete").otherwise("in_progress")
    )


def resolve_threshold(artifacts: DataFrame) -> DataFrame:
    """One threshold per experiment from every artifact that records one; ``failure`` says why there is none."""
    value = F.col("minimum_confidence")
    return artifacts.groupBy("experiment_id").agg(
        F.count(value).alias("recorded"), F.min(value).alias("low"), F.max(value).alias("high")
    ).withColumn(
        "failure",
        F.when(F.col("recorded") == 0, "not_recorded")
        .when((F.col("low") < 0) | (F.col("high") > 1), "invalid")
        .when(F.col("low") != F.col("high"), "conflict"),
    ).select("experiment_id", "recorded", F.when(F.col("failure").isNull(), F.col("low")).alias("threshold"), "failure")


def compile_human_adjudication(votes: DataFrame, decisions: DataFrame, adjudicator_id: str) -> tuple[DataFrame, DataFrame]:
    """(final labels, violations). ``votes``: clause_id, text_sha256, label_a, label_b, annotator_a, annotator_b;
    ``decisions``: clause_id, text_sha256, adjudicated_label, adjudication_reason_code."""
    d = decisions.select(
        "clause_id", F.col("text_sha256").alias("d_hash"), "adjudicated_label", "adjudication_reason_code", F.lit(1).alias("d")
    )
    joined = votes.withColumn("v", F.lit(1)).join(d, "clause_id", "full_outer")
    known = F.col("v") == 1
    disputed = known & (F.col("label_a") != F.col("label_b"))
    decided = F.col("d") == 1
    allowed = F.col("adjudicated_label").isin(*V.LABELS) & F.col("adjudication_reason_code").isin(*V.ADJUDICATION_REASONS)
    yes = lambda c: F.coalesce(c, F.lit(False))
    problems = violations(
        joined,
        "clause_id",
        {
            "unknown_clause": F.col("v").isNull(),
            "not_a_disagreement": yes(decided & known) & ~yes(disputed),
            "identity_mismatch": yes(decided & disputed) & ~yes(F.col("d_hash") == F.col("text_sha256")),
            "unresolved": yes(disputed) & ~yes(decided & allowed),
            "adjudicator_not_independent": yes(disputed) & F.lit(adjudicator_id).isin(F.col("annotator_a"), F.col("annotator_b")),
        },
    ).drop("detail")
    final = joined.where(yes(known)).select(
        "clause_id", "text_sha256", "label_a", "label_b",
        F.when(~disputed, F.col("label_a")).when(yes(decided & allowed), F.col("adjudicated_label")).alias("final_label"),
        F.when(~disputed, "human_human_agreement").when(yes(decided & allowed), F.col("adjudication_reason_code")).alias("resolution_reason_code"),
    )
    return final, problems
