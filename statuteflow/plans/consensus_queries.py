"""K: two model votes per clause of the rule book, a third for disputes, and people as the reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.text import prompt
from ..operators import consensus as K
from ..session import stage_table
from . import inputs as I
from . import sql as S
from .dataset_queries import VOTES_SQL, clauses
from .registry import query

SIZE, SEED = 5000, "silver-1"
LABELERS = {"A": ("labeler-a", "model-a"), "B": ("labeler-b", "model-b")}
THIRD = ("labeler-c", "model-c")


def stored(spark, d):
    """The rule book's clauses as a stage table: a query reads them for the holdout and for every model."""
    return stage_table(clauses(spark, d), "clauses")


def records(c):
    """Clauses with their holdout marks."""
    return K.holdout_split(c, SIZE, SEED)


def responses(c):
    """Both models' answers: B differs on every fourth page, confidences follow the position."""
    slot = F.explode(F.array(F.lit("A"), F.lit("B")))
    v = c.select("*", slot.alias("slot"))
    b = F.col("slot") == "B"
    return v.select(
        "clause_id", "slot", "text_sha256",
        F.concat(F.lit("labeler-"), F.lower("slot")).alias("labeler_id"), F.concat(F.lit("model-"), F.lower("slot")).alias("model_id"),
        F.when(b, V.SLOTS["B"][0]).otherwise(V.SLOTS["A"][0]).alias("prompt_version"),
        F.when(b & (F.col("page") % 4 == 0), "permission").otherwise(F.col("stratum")).alias("label"),
        F.round(F.when(b, 0.6 + (F.col("position") % 8) * 0.05).otherwise(0.7 + (F.col("ordinal") % 6) * 0.05), 2).alias("confidence"),
        F.lit("because").alias("rationale"), "position", "page", "ordinal",
    )


def third(c):
    return c.select(
        "clause_id", F.when(F.col("position") % 3 == 0, "permission").when(F.col("position") % 3 == 1, F.col("stratum")).otherwise("definition").alias("label_c"),
        F.round(0.7 + (F.col("position") % 5) * 0.05, 2).alias("confidence_c"), "position",
    ).where("position % 17 <> 0").drop("position")


SILVER_SQL = f"""{VOTES_SQL},
dn AS (SELECT document_id, count(*) AS n, {S.stable_rank(SEED, "'document'", 'document_id')} AS h FROM cl GROUP BY 1),
dc AS (SELECT *, sum(n) OVER (ORDER BY h) AS c FROM dn),
hold AS (SELECT document_id FROM dc WHERE c - n < {SIZE}),
rec0 AS (SELECT *, document_id IN (SELECT document_id FROM hold) AS held_out FROM cl),
ev AS (SELECT clause_id FROM rec0 WHERE held_out ORDER BY {S.stable_rank(SEED, "'eval'", 'clause_id')} LIMIT {SIZE}),
rec AS (SELECT *, clause_id IN (SELECT clause_id FROM ev) AS evaluation FROM rec0),
ab AS (SELECT *, stratum AS label_a, round(0.7::DOUBLE + (ordinal % 6) * 0.05::DOUBLE, 2) AS confidence_a,
  CASE WHEN page % 4 = 0 THEN 'permission' ELSE stratum END AS label_b, round(0.6::DOUBLE + (position % 8) * 0.05::DOUBLE, 2) AS confidence_b FROM rec),
dec AS (SELECT *, label_a = label_b AND least(confidence_a, confidence_b) >= 0.8 AND NOT held_out AS accepted FROM ab),
tri AS (SELECT *, CASE WHEN position % 17 <> 0 THEN CASE position % 3 WHEN 0 THEN 'permission' WHEN 1 THEN stratum ELSE 'definition' END END AS label_c,
  CASE WHEN position % 17 <> 0 THEN round(0.7::DOUBLE + (position % 5) * 0.05::DOUBLE, 2) END AS confidence_c FROM dec WHERE NOT held_out),
sup AS (SELECT *, CASE WHEN label_c = label_a THEN confidence_a WHEN label_c = label_b THEN confidence_b END AS support FROM tri),
fin AS (SELECT *, label_a <> label_b AND support IS NOT NULL AND least(support, confidence_c) >= 0.8 AS wins FROM sup),
hum AS (SELECT clause_id, CASE WHEN position % 10 = 0 THEN 'obligation' ELSE stratum END AS human_label FROM rec WHERE evaluation)"""


@query("k1_holdout_split", f"WITH {SILVER_SQL} SELECT clause_id, held_out, evaluation FROM rec")
def k1(spark, d):
    return records(stored(spark, d)).select("clause_id", "held_out", "evaluation")


@query(
    "k2_label_requests",
    f"""WITH {SILVER_SQL} SELECT lower(slot) || '-' || clause_id AS request_id, slot, 'model-' || lower(slot) AS model_id,
    CASE slot WHEN 'A' THEN '{V.SLOTS['A'][0]}' ELSE '{V.SLOTS['B'][0]}' END AS prompt_version,
    sha256(CASE slot WHEN 'A' THEN {S.lit(prompt('A'))} ELSE {S.lit(prompt('B'))} END) AS prompt_hash FROM cl CROSS JOIN (VALUES ('A'), ('B')) v(slot)""",
)
def k2(spark, d):
    return K.label_requests(clauses(spark, d), LABELERS).select(
        "request_id", "slot", "model_id", "prompt_version", F.sha2("system_prompt", 256).alias("prompt_hash")
    )


@query(
    "b27_request_rendering",
    """SELECT 'a-' || doc_id AS request_id, doc_id::VARCHAR AS clause_id, sha256(text) AS text_sha256, 'labeler-a' AS labeler_id, """
    f"""'{V.SLOTS['A'][0]}' AS prompt_version, {S.lit(prompt('A'))} AS system_prompt, '{V.REQUEST_SCHEMA}' AS schema_version,
    '{','.join(V.LABELS)}' AS allowed_labels, false AS production_ground_truth FROM documents""",
)
def b27(spark, d):
    rows = I.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("clause_id"), F.col("source").alias("document_id"), F.lit("r").alias("regulator"), "text",
        F.sha2("text", 256).alias("text_sha256"),
    )
    return K.label_requests(rows, {"A": LABELERS["A"]}).select(
        "request_id", "clause_id", "text_sha256", "labeler_id", "prompt_version", "system_prompt", "schema_version",
        F.array_join("allowed_labels", ",").alias("allowed_labels"), "production_ground_truth",
    )


@query(
    "k2_request_stream",
    f"""WITH {SILVER_SQL}, r AS (SELECT slot, clause_id, row_number() OVER (PARTITION BY document_id ORDER BY clause_id) AS p FROM cl CROSS JOIN (VALUES ('A'), ('B')) v(slot))
    SELECT lower(slot) || '-' || clause_id AS request_id, slot, CASE WHEN slot = 'B' THEN -(ordinal * 1000 + position) ELSE ordinal * 1000 + position END AS place
    FROM cl CROSS JOIN (VALUES ('A'), ('B')) v(slot)""",
)
def k2_stream(spark, d):
    c = clauses(spark, d)
    place = c.select("clause_id", (F.col("ordinal") * 1000 + F.col("position")).alias("sample_position"))
    stream = K.label_requests(c, LABELERS).join(place, "clause_id")
    slot, order = K.request_order(stream)
    return stream.select("request_id", slot.alias("slot"), order.cast("bigint").alias("place"))


def damaged(c):
    """Answers with some missing, wrong or of another identity."""
    r = responses(c)
    p, a = F.col("position"), F.col("slot") == "A"
    return r.where(~(a & (p % 29 == 0))).withColumns(
        {
            "model_id": F.when(a & (p % 31 == 0), "model-x").otherwise(F.col("model_id")),
            "confidence": F.when(a & (p % 37 == 0), 1.5).otherwise(F.col("confidence")),
        }
    )


@query(
    "k3_pending_requests",
    f"WITH {SILVER_SQL} SELECT 'a-' || clause_id AS request_id FROM cl WHERE position % 29 = 0 OR position % 31 = 0",
)
def k3(spark, d):
    c = clauses(spark, d)
    return K.pending_requests(K.label_requests(c, LABELERS), damaged(c)).select("request_id")


@query(
    "k11_response_violations",
    f"""WITH {SILVER_SQL} SELECT 'missing_response' AS "check", 'A' AS slot, clause_id FROM cl WHERE position % 29 = 0
    UNION ALL SELECT 'identity_mismatch', 'A', clause_id FROM cl WHERE position % 31 = 0 AND position % 29 <> 0
    UNION ALL SELECT 'invalid_answer', 'A', clause_id FROM cl WHERE position % 37 = 0 AND position % 29 <> 0""",
)
def k11(spark, d):
    c = stored(spark, d)
    return K.response_violations(K.label_requests(c, LABELERS), damaged(c))


@query(
    "k4_consensus",
    f"""WITH {SILVER_SQL} SELECT clause_id, accepted, CASE WHEN accepted THEN label_a END AS label,
    CASE WHEN accepted THEN NULL WHEN held_out THEN 'held_out' ELSE 'disagreement_or_low_confidence' END AS reason FROM dec""",
)
def k4(spark, d):
    c = stored(spark, d)
    return K.consensus(records(c), responses(c)).select("clause_id", "accepted", "label", "reason")


@query(
    "k4_consensus_report",
    f"""WITH {SILVER_SQL} SELECT count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS routed_for_review, count(*) FILTER (held_out) AS held_out,
    """ + ", ".join(f"count(*) FILTER (accepted AND label_a = '{x}') AS label_{x}" for x in V.LABELS) + ", count(*) FILTER (accepted) >= 500 AS training_eligible FROM dec",
)
def k4_report(spark, d):
    c = stored(spark, d)
    return K.consensus_report(K.consensus(records(c), responses(c)))


@query("k5_adjudication_requests", f"WITH {SILVER_SQL} SELECT 'c-' || clause_id AS request_id, 'model-c' AS model_id FROM dec WHERE NOT held_out AND label_a <> label_b")
def k5(spark, d):
    c = stored(spark, d)
    decided = K.consensus(records(c), responses(c))
    return K.adjudication_requests(decided, LABELERS, THIRD).select("request_id", "model_id")


@query(
    "k6_two_of_three",
    f"""WITH {SILVER_SQL} SELECT clause_id, CASE WHEN accepted THEN label_a WHEN wins THEN label_c END AS final_label,
    CASE WHEN accepted THEN 'ai_consensus_silver' WHEN wins THEN 'ai_two_of_three_silver' WHEN label_a = label_b THEN 'low_confidence_agreement'
      WHEN label_c IS NULL THEN 'third_response_missing' WHEN support IS NOT NULL THEN 'third_model_low_confidence' ELSE 'three_way_disagreement' END AS verdict,
    CASE WHEN wins THEN CASE WHEN label_c = label_a THEN 'A' ELSE 'B' END END AS supporting_slot FROM fin""",
)
def k6(spark, d):
    c = stored(spark, d)
    return K.two_of_three(K.consensus(records(c), responses(c)), third(c)).select("clause_id", "final_label", "verdict", "supporting_slot")


def human(r):
    return r.where("evaluation").select("clause_id", F.when(F.col("position") % 10 == 0, "obligation").otherwise(F.col("stratum")).alias("human_label"))


_SLOT_REPORT = f"""{SILVER_SQL},
pv AS (SELECT slot, human_label AS expected, CASE slot WHEN 'A' THEN label_a ELSE label_b END AS predicted FROM hum JOIN ab USING (clause_id) CROSS JOIN (VALUES ('A'), ('B')) v(slot)),
pl AS (SELECT slot, label, count(*) FILTER (expected = label AND predicted = label) AS tp, count(*) FILTER (expected = label) AS support, count(*) FILTER (predicted = label) AS pn
  FROM pv CROSS JOIN {S.LABEL_VALUES} GROUP BY ALL),
f AS (SELECT *, CASE WHEN pn = 0 THEN 0 ELSE tp / pn END AS p, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS r FROM pl),
g AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM f)"""


@query(
    "k7_human_evaluation",
    f"""WITH {_SLOT_REPORT}, a AS (SELECT slot, avg((expected = predicted)::INT) AS accuracy, count(*) AS examples FROM pv GROUP BY 1)
    SELECT slot, any_value(examples) AS examples, round(any_value(accuracy), 9) AS accuracy, round(sum(f1) / 7, 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1
    FROM g JOIN a USING (slot) GROUP BY slot""",
)
def k7(spark, d):
    c = stored(spark, d)
    accuracy, macro, _ = K.human_evaluation(human(records(c)), responses(c))
    return accuracy.join(macro, "slot").select("slot", "examples", *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query(
    "k7_human_classes",
    f"WITH {_SLOT_REPORT} SELECT slot, label, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, support FROM g",
)
def k7_classes(spark, d):
    c = stored(spark, d)
    _, _, classes = K.human_evaluation(human(records(c)), responses(c))
    return classes.select("slot", "label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "k7_human_agreement",
    f"""WITH {SILVER_SQL}, x AS (SELECT *, label_a = label_b AS ag, label_a = label_b AND least(confidence_a, confidence_b) >= 0.8 AS hi, label_a = human_label AS ok FROM hum JOIN ab USING (clause_id))
    SELECT count(*) AS clauses, count(*) FILTER (ag) AS consensus_count, round(count(*) FILTER (ag) / count(*), 9) AS consensus_coverage,
      round(count(*) FILTER (ag AND ok) / count(*) FILTER (ag), 9) AS consensus_accuracy, count(*) FILTER (hi) AS high_confidence_count,
      round(count(*) FILTER (hi AND ok) / count(*) FILTER (hi), 9) AS high_confidence_accuracy FROM x""",
)
def k7_agreement(spark, d):
    c = stored(spark, d)
    out = K.human_agreement(human(records(c)), responses(c))
    rates = ("consensus_coverage", "consensus_accuracy", "high_confidence_accuracy")
    return out.select("clauses", "consensus_count", "high_confidence_count", *[F.round(c, 9).alias(c) for c in rates])


@query(
    "k7_error_rows",
    f"""WITH {SILVER_SQL} SELECT clause_id, human_label, label_a, label_b, label_a = label_b AS labelers_agree, label_a <> human_label AS labeler_a_error,
    label_b <> human_label AS labeler_b_error, label_a = label_b AND least(confidence_a, confidence_b) >= 0.8 AS high_confidence_consensus
    FROM hum JOIN ab USING (clause_id) WHERE label_a <> label_b OR label_a <> human_label OR label_b <> human_label""",
)
def k7_errors(spark, d):
    c = stored(spark, d)
    return K.error_rows(human(records(c)), responses(c))


@query(
    "k8_evaluation_progress",
    f"WITH {SILVER_SQL} SELECT count(*) FILTER (position % 11 <> 0) AS completed, count(*) AS target, 'in_progress' AS status FROM rec WHERE evaluation",
)
def k8(spark, d):
    tasks = records(stored(spark, d)).where("evaluation").select(F.when(F.col("position") % 11 != 0, F.col("stratum")).alias("label"))
    return K.evaluation_progress(tasks)


@query(
    "k9_resolve_threshold",
    """WITH a AS (SELECT user_id AS experiment_id, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 = 1 AND event_type = 'error' THEN 0.9
      WHEN user_id % 7 = 2 THEN 1.5 ELSE 0.8 END::DOUBLE AS m FROM events)
    SELECT experiment_id, count(m) AS recorded, coalesce(CASE WHEN min(m) = max(m) AND max(m) <= 1 THEN min(m) END, -1) AS threshold,
      CASE WHEN count(m) = 0 THEN 'not_recorded' WHEN max(m) > 1 THEN 'invalid' WHEN min(m) <> max(m) THEN 'conflict' END AS failure FROM a GROUP BY 1""",
)
def k9(spark, d):
    u = F.col("user_id") % 7
    artifacts = I.table(spark, d, "events").select(
        F.col("user_id").alias("experiment_id"),
        F.when(u == 0, F.lit(None)).when((u == 1) & (F.col("event_type") == "error"), 0.9).when(u == 2, 1.5).otherwise(0.8).alias("minimum_confidence"),
    )
    return K.resolve_threshold(artifacts).withColumn("threshold", F.coalesce("threshold", F.lit(-1.0)))


@query(
    "k10_evidence_receipt",
    f"""WITH {SILVER_SQL}, e AS (SELECT clause_id || '|' || human_label || '|' || label_a || '|' || label_b AS line FROM hum JOIN ab USING (clause_id)
      WHERE label_a <> label_b OR label_a <> human_label OR label_b <> human_label), r AS (SELECT strlen(line) AS n, sha256(line || ':' || sha256(line) || ':' || strlen(line)) AS h FROM e)
    SELECT f.rows AS files, f.fingerprint, sum(n)::BIGINT AS size_bytes FROM r, (SELECT {S.fingerprint('h')} FROM r) f GROUP BY ALL""",
)
def k10(spark, d):
    from ..sources.corpus import artifact_receipt

    c = stored(spark, d)
    rows = stage_table(K.error_rows(human(records(c)), responses(c)), "errors")
    line = F.concat_ws("|", "clause_id", "human_label", "label_a", "label_b")
    lines = rows.select(line.alias("path"), F.sha2(line, 256).alias("sha256"), F.octet_length(line).cast("bigint").alias("size_bytes"))
    return artifact_receipt(lines)
