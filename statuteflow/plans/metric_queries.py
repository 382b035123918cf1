"""I: metrics over predictions written from line items; splits, gates and models over the rule book."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.joins import attach_row
from ..functions.text import sampling_stratum
from ..operators import classification as K
from ..operators import metrics as M
from ..session import stage_table
from . import inputs as I
from . import sql as S
from .inputs import RULE_BOOK_SQL
from .registry import query
from .text_queries import _PROBS, vector_probabilities

_LABELS_SQL = "[" + ", ".join(S.lit(x) for x in V.LABELS) + "]"


def predictions(spark, d):
    li = I.table(spark, d, "lineitem")
    labels = F.array(*[F.lit(x) for x in V.LABELS])
    truth = F.col("l_partkey") % 7
    guess = F.when(F.col("l_returnflag") == "R", (F.col("l_partkey") + F.col("l_linenumber")) % 7).otherwise(truth)
    return li.select(
        F.element_at(labels, (truth + 1).cast("int")).alias("expected"),
        F.element_at(labels, (guess + 1).cast("int")).alias("predicted"),
        F.round((F.col("l_quantity") * 20 - F.col("l_linenumber")) / 1000, 3).alias("confidence"),
        F.concat(F.lit("regulator-"), (F.col("l_suppkey") % 10).cast("string")).alias("regulator"),
        F.date_format("l_shipdate", "yyyy-MM").alias("day"),
        "l_suppkey",
    )


PREDICTIONS_SQL = f"""
preds AS (SELECT {_LABELS_SQL}[l_partkey % 7 + 1] AS expected,
  {_LABELS_SQL}[CASE WHEN l_returnflag = 'R' THEN (l_partkey + l_linenumber) % 7 ELSE l_partkey % 7 END + 1] AS predicted,
  round((l_quantity * 20 - l_linenumber) / 1000, 3) AS confidence, 'regulator-' || (l_suppkey % 10) AS regulator,
  strftime(l_shipdate, '%Y-%m') AS day, l_suppkey FROM lineitem),
per_label AS (SELECT label, count(*) FILTER (expected = label AND predicted = label) AS tp, count(*) FILTER (expected = label) AS support,
  count(*) FILTER (predicted = label) AS predicted FROM {S.LABEL_VALUES} CROSS JOIN preds GROUP BY label),
pr AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall FROM per_label),
report AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""


@query(
    "i5_class_report",
    f"WITH {PREDICTIONS_SQL} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM report",
)
def i5(spark, d):
    return M.class_report(predictions(spark, d)).select(
        "label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


@query(
    "i5_summary",
    f"""WITH {PREDICTIONS_SQL}, m AS (SELECT avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM report)
    SELECT round(any_value(m.macro_f1), 9) AS macro_f1, round(any_value(m.weighted_f1), 9) AS weighted_f1, count(*) AS examples, round(avg((expected = predicted)::INT), 9) AS accuracy,
      round(avg((confidence >= 0.6)::INT), 9) AS coverage,
      round(count(*) FILTER (expected = predicted AND confidence >= 0.6) / count(*) FILTER (confidence >= 0.6), 9) AS covered_accuracy
    FROM preds CROSS JOIN m""",
)
def i5_summary(spark, d):
    p = predictions(spark, d)
    macro = M.macro_report(M.class_report(p)).drop("least_f1")
    out = attach_row(M.accuracy_report(p, 0.6), macro)
    return out.select("examples", *[F.round(c, 9).alias(c) for c in ("macro_f1", "weighted_f1", "accuracy", "coverage", "covered_accuracy")])


@query(
    "i5_confusion_matrix",
    f"WITH {PREDICTIONS_SQL} SELECT label AS expected, " + ", ".join(f"count(*) FILTER (predicted = '{x}') AS {x}" for x in V.LABELS)
    + f" FROM {S.LABEL_VALUES} LEFT JOIN preds ON expected = label GROUP BY label",
)
def i5_matrix(spark, d):
    return M.confusion_matrix(predictions(spark, d))


@query(
    "i6_calibration_error",
    f"""WITH {PREDICTIONS_SQL}, b AS (SELECT """ + " + ".join(f"(confidence >= {i}/10::DOUBLE)::INT" for i in range(1, 10))
    + """ AS bin, expected = predicted AS hit, confidence FROM preds),
    g AS (SELECT bin, count(*) AS n, avg(hit::INT) AS a, avg(confidence) AS c FROM b GROUP BY bin)
    SELECT round(sum(n * abs(a - c)) / sum(n), 9) AS expected_calibration_error FROM g""",
)
def i6(spark, d):
    return M.expected_calibration_error(predictions(spark, d)).select(
        F.round("expected_calibration_error", 9).alias("expected_calibration_error")
    )


@query(
    "i7_abstention_threshold",
    f"""WITH {PREDICTIONS_SQL}, g AS (SELECT confidence, count(*) AS n, count(*) FILTER (expected = predicted) AS h FROM preds GROUP BY 1),
    w AS (SELECT confidence, sum(n) OVER (ORDER BY confidence DESC) AS n, sum(h) OVER (ORDER BY confidence DESC) AS h, sum(n) OVER () AS t FROM g)
    SELECT min(confidence) AS threshold FROM w WHERE h / n >= 0.72 AND n / t >= 0.2""",
)
def i7(spark, d):
    return M.abstention_threshold(predictions(spark, d), 0.72, 0.2)


_OBSERVED = """obs AS (SELECT round((l_quantity * 2 + l_linenumber) / 120, 3) AS score,
  l_quantity * 2 + (l_partkey % 40) > 50 AS label FROM lineitem)"""


def observations(spark, d):
    return I.table(spark, d, "lineitem").select(
        F.round((F.col("l_quantity") * 2 + F.col("l_linenumber")) / 120, 3).alias("score"),
        (F.col("l_quantity") * 2 + F.col("l_partkey") % 40 > 50).alias("label"),
    )


@query(
    "i8_precision_threshold",
    f"""WITH {_OBSERVED}, g AS (SELECT score, count(*) AS n, count(*) FILTER (label) AS h FROM obs GROUP BY 1),
    w AS (SELECT score, sum(n) OVER (ORDER BY score DESC) AS n, sum(h) OVER (ORDER BY score DESC) AS h FROM g)
    SELECT min(score) AS threshold FROM w WHERE h / n >= 0.9""",
)
def i8(spark, d):
    return M.precision_threshold(observations(spark, d), 0.9)


@query(
    "i9_brier_and_ece",
    f"""WITH {_OBSERVED}, g AS (SELECT score, count(*) AS n, avg(label::INT) AS a FROM obs GROUP BY 1)
    SELECT (SELECT round(avg(power(score - label::INT, 2)), 4) FROM obs) AS brier, (SELECT round(sum(n * abs(a - score)) / sum(n), 4) FROM g) AS ece""",
)
def i9(spark, d):
    return M.brier_and_ece(observations(spark, d))


@query(
    "i4_temperature_grid",
    f"""WITH w AS (SELECT vec_id, label % 7 + 1 AS y, [{', '.join(_PROBS)}] AS w FROM embeddings),
    p AS (SELECT vec_id, y, list_transform(w, lambda x: x::DOUBLE / list_sum(w)) AS p FROM w),
    t AS (SELECT unnest(range(0, 101)) AS i), g AS (SELECT i, 0.5::DOUBLE + i * 0.025::DOUBLE AS temperature FROM t),
    s AS (SELECT i, temperature, y, list_transform(p, lambda x: exp(ln(greatest(x, 1e-12)) / temperature)) AS s FROM p CROSS JOIN g)
    SELECT i, round(avg(-ln(s[y] / list_sum(s) + 1e-12)), 9) AS loss FROM s GROUP BY i""",
)
def i4(spark, d):
    labels = F.array(*[F.lit(x) for x in V.LABELS])
    p = vector_probabilities(spark, d).withColumn("label", F.element_at(labels, (F.col("label") % 7 + 1).cast("int")))
    grid = M.temperature_grid(p, [0.5 + i * 0.025 for i in range(101)])
    return grid.select(F.round((F.col("temperature") - 0.5) / 0.025).cast("bigint").alias("i"), F.round("loss", 9).alias("loss"))


@query(
    "i15_monitoring_slices",
    f"""WITH {PREDICTIONS_SQL} SELECT regulator, day, predicted AS label, count(*) AS n, round(sum(confidence), 3) AS confidence_sum,
    min(confidence) AS least_confidence, round(avg((confidence < 0.5)::INT), 9) AS abstention_rate FROM preds GROUP BY ALL""",
)
def i15(spark, d):
    p = predictions(spark, d).withColumn("label", F.col("predicted")).withColumn("abstained", F.col("confidence") < 0.5)
    return M.monitoring_slices(p).select(
        "regulator", "day", "label", "n", F.round(F.col("mean_confidence") * F.col("n"), 3).alias("confidence_sum"), "least_confidence",
        F.round("abstention_rate", 9).alias("abstention_rate"),
    )


# --- labelled clauses -------------------------------------------------------------------------------------------


def labelled_clauses(spark, d):
    return I.rule_book(spark, d).select(
        F.col("section_id").alias("clause_id"), F.col("regulation_id").alias("document_id"),
        F.col("organization_id").alias("regulator"), F.col("body").alias("text"), sampling_stratum("body").alias("label"),
        "position", "page", "section_key", "heading", "ordinal",
    )


LABELLED_SQL = f"""{RULE_BOOK_SQL},
labelled AS (SELECT section_id AS clause_id, regulation_id AS document_id, organization_id AS regulator, body AS text,
  {S.stratum('body')} AS label, position, page, section_key, heading, ordinal FROM rsections)"""


@query(
    "i11_dataset_summary",
    f"WITH {LABELLED_SQL} SELECT count(*) AS examples, count(DISTINCT document_id) AS documents, count(DISTINCT regulator) AS regulators, "
    + ", ".join(f"count(*) FILTER (label = '{x}') AS label_{x}" for x in V.LABELS) + " FROM labelled",
)
def i11(spark, d):
    return K.dataset_summary(labelled_clauses(spark, d))


_SPLIT = S.bucket("sha256('clause-split-v1:' || document_id)", 100)


@query(
    "i12_split_by_document",
    f"""WITH {LABELLED_SQL}, b AS (SELECT *, {_SPLIT} AS bucket FROM labelled)
    SELECT document_id, CASE WHEN bucket < 70 THEN 'train' WHEN bucket < 85 THEN 'validation' ELSE 'test' END AS split, count(*) AS clauses
    FROM b GROUP BY ALL""",
)
def i12(spark, d):
    return K.split_by_document(labelled_clauses(spark, d)).groupBy("document_id", "split").agg(F.count("*").alias("clauses"))


@query(
    "i12_split_checks",
    f"""WITH {LABELLED_SQL}, b AS (SELECT *, CASE WHEN ordinal % 7 = 0 AND position % 50 = 0 THEN 'test' WHEN {_SPLIT} < 70 THEN 'train' ELSE 'validation' END AS split FROM labelled)
    SELECT 'document_leakage' AS "check", document_id AS key FROM b GROUP BY document_id HAVING count(DISTINCT split) > 1""",
)
def i12_checks(spark, d):
    split = K.split_by_document(labelled_clauses(spark, d), validation_percent=29).withColumn(
        "split",
        F.when((F.col("ordinal") % 7 == 0) & (F.col("position") % 50 == 0), "test")
        .when(F.col("split") == "train", "train").otherwise("validation"),
    )
    return K.split_checks(split)


@query(
    "b16_dataset_fingerprint",
    f"""WITH {LABELLED_SQL}, r AS (SELECT sha256(clause_id || '|' || document_id || '|' || regulator || '|' || {S.ws('text')} || '|' || label) AS h FROM labelled)
    SELECT {S.fingerprint('h')} FROM r""",
)
def b16(spark, d):
    return K.dataset_fingerprint(labelled_clauses(spark, d))


def manifests(spark, d):
    """One model per supplier: its metrics are those of its line items' predictions."""
    p = predictions(spark, d)
    hit = F.col("expected") == F.col("predicted")
    rows = p.groupBy("l_suppkey").agg(
        F.count("*").alias("example_count"), F.count_distinct("day").alias("document_count"),
        F.count_distinct("expected").alias("regulator_count"), (F.count_if(hit) / F.count("*")).alias("accuracy"),
        (F.count_if(hit & (F.col("confidence") >= 0.6)) / F.count_if(F.col("confidence") >= 0.6)).alias("covered_accuracy"),
        (F.count_if(F.col("confidence") >= 0.6) / F.count("*")).alias("coverage"),
    )
    labels = F.array(*[F.lit(x) for x in V.LABELS])
    k = F.col("l_suppkey")
    return rows.select(
        F.concat(F.lit("model-"), k.cast("string")).alias("model_id"), F.concat(F.lit("set-"), k.cast("string")).alias("dataset_id"),
        F.sha2(k.cast("string"), 256).alias("dataset_sha256"),
        F.when(k % 3 == 0, F.slice(labels, 1, 6)).otherwise(labels).alias("labels"),
        "example_count", "document_count", "regulator_count", F.col("accuracy").alias("macro_f1"),
        F.map_from_arrays(labels, F.transform(labels, lambda x, i: F.when((k % 4 == 1) & (i == 2), 0.4).otherwise(0.6))).alias("per_class_f1"),
        "covered_accuracy", F.when(k % 5 == 0, 0.2).otherwise(0.05).alias("expected_calibration_error"), "coverage",
    )


_MANIFEST_SQL = f"""{PREDICTIONS_SQL},
mf AS (SELECT l_suppkey AS k, count(*) AS n, count(DISTINCT day) AS docs, count(DISTINCT expected) AS regs, avg((expected = predicted)::INT) AS acc,
  count(*) FILTER (expected = predicted AND confidence >= 0.6) / count(*) FILTER (confidence >= 0.6) AS ca, avg((confidence >= 0.6)::INT) AS cov FROM preds GROUP BY 1),
judged AS (SELECT k, concat_ws(',', CASE WHEN k % 3 = 0 THEN 'incomplete_label_taxonomy' END, CASE WHEN n < 500 THEN 'insufficient_examples' END,
  CASE WHEN docs < 25 THEN 'insufficient_documents' END, CASE WHEN regs < 3 THEN 'insufficient_regulators' END,
  CASE WHEN acc < 0.75 THEN 'macro_f1_below_gate' END, CASE WHEN k % 4 = 1 THEN 'per_class_f1_below_gate' END,
  CASE WHEN ca < 0.85 THEN 'covered_accuracy_below_gate' END, CASE WHEN k % 5 = 0 THEN 'calibration_error_above_gate' END,
  CASE WHEN cov < 0.6 THEN 'coverage_below_gate' END) AS failures FROM mf)"""


@query("i10_promotion_failures", f"WITH {_MANIFEST_SQL} SELECT 'model-' || k AS model_id, failures FROM judged")
def i10(spark, d):
    return K.promotion_failures(manifests(spark, d)).select("model_id", F.array_join("failures", ",").alias("failures"))


def audits(spark, d):
    k = F.col("s_suppkey")
    return I.table(spark, d, "supplier").where("s_acctbal > 0").select(
        F.concat(F.lit("set-"), k.cast("string")).alias("dataset_id"),
        F.when(k % 6 == 0, "blocked").otherwise("ready").alias("status"), F.array().cast("array<string>").alias("failures"),
        F.when(k % 7 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2(k.cast("string"), 256)).alias("dataset_sha256"),
        (k % 2).cast("int").alias("unresolved_count"), F.lit(500).alias("examples"),
    )


@query(
    "i13_dataset_admission",
    """WITH a AS (SELECT s_suppkey AS k, s_acctbal > 0 AS audited FROM supplier)
    SELECT 'no_audit' AS "check", 'set-' || k AS key FROM a WHERE NOT audited
    UNION ALL SELECT 'audit_not_ready', 'set-' || k FROM a WHERE audited AND k % 6 = 0
    UNION ALL SELECT 'hash_mismatch', 'set-' || k FROM a WHERE audited AND k % 7 = 0
    UNION ALL SELECT 'unresolved_annotations', 'set-' || k FROM a WHERE audited AND k % 2 = 1""",
)
def i13(spark, d):
    k = F.col("s_suppkey").cast("string")
    datasets = I.table(spark, d, "supplier").select(F.concat(F.lit("set-"), k).alias("dataset_id"), F.sha2(k, 256).alias("dataset_sha256"))
    return K.dataset_admission(audits(spark, d), datasets)


def artifact_files(spark, d):
    """Documents as files of one artifact per source."""
    return I.table(spark, d, "documents").select(
        F.col("source").alias("artifact_id"), F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256")
    )


@query(
    "i14_artifact_fingerprint",
    f"""WITH r AS (SELECT source AS artifact_id, sha256(doc_id || ':' || sha256(text)) AS h FROM documents),
    g AS (SELECT artifact_id, {S.fingerprint('h')} FROM r GROUP BY artifact_id)
    SELECT artifact_id, rows AS files, fingerprint AS artifact_sha256 FROM g""",
)
def i14(spark, d):
    return K.artifact_fingerprint(artifact_files(spark, d))


@query(
    "i14_verify_receipts",
    """SELECT 'artifact_changed' AS "check", source AS key FROM documents GROUP BY source HAVING bool_or(lang = 'de' AND n_chars > 4000)""",
)
def i14_verify(spark, d):
    files = artifact_files(spark, d)
    receipts = K.artifact_fingerprint(files).select(F.col("artifact_id").alias("model_id"), "artifact_sha256")
    # Long German documents were edited after promotion.
    edited = I.table(spark, d, "documents").select(
        F.col("source").alias("artifact_id"), F.col("doc_id").cast("string").alias("path"),
        F.sha2(F.when((F.col("lang") == "de") & (F.col("n_chars") > 4000), F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"),
    )
    return K.verify_receipts(receipts, edited)


def split_clauses(spark, d):
    """Clauses to learn from and to judge, written once."""
    rows = I.rule_book(spark, d).select(
        F.col("section_id").alias("clause_id"), F.col("regulation_id").alias("document_id"), F.col("body").alias("text"), "page", "ordinal"
    )
    return stage_table(K.split_by_document(rows).where("split <> 'validation'"), "clauses")


def labelled_texts(clauses):
    """The different texts of clauses, their labels and how many clauses have each."""
    return clauses.groupBy("text").agg(F.count("*").alias("copies")).withColumn("label", sampling_stratum("text"))


@query("i1_classify_clauses")
def i1(spark, d):
    clauses = split_clauses(spark, d)
    model = K.train_baseline(labelled_texts(clauses.where("split = 'train'")), iterations=15, copies="copies")
    sections = clauses.where("split = 'test'").select(
        F.concat_ws(":", "document_id", F.col("ordinal").cast("string")).alias("version_id"), F.col("clause_id").alias("section_id"),
        "page", F.col("text").alias("body"),
    )
    ledger = sections.where("page = -1").select("version_id", F.lit("m").alias("model_id"))
    found, runs = K.classify_versions(sections, sections.select("version_id").distinct(), ledger, model, "baseline-v1", 0.5)
    return runs.select("version_id", "clause_count", "abstained_count")


@query("i3_baseline_report")
def i3(spark, d):
    clauses = split_clauses(spark, d)
    model = K.train_baseline(labelled_texts(clauses.where("split = 'train'")), iterations=15, copies="copies")
    scored = K.predict(model, labelled_texts(clauses.where("split = 'test'")))
    report = M.class_report(scored.select(F.col("label").alias("expected"), "predicted", "copies"), copies="copies")
    return report.select("label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "i2_list_classifications",
    f"""WITH {LABELLED_SQL} SELECT clause_id, label, section_key, ordinal FROM labelled WHERE label = 'definition'
    ORDER BY ordinal DESC, position, {S.clause_hash('text')}, clause_id LIMIT 200 OFFSET 50""",
)
def i2(spark, d):
    from ..functions.text import clause_hash

    rows = labelled_clauses(spark, d)
    classified = rows.select(
        F.col("clause_id").alias("section_id"), F.col("clause_id"), "label", clause_hash("text").alias("clause_hash"),
        F.col("label").alias("status"),
    )
    sections = rows.select(F.col("clause_id").alias("section_id"), "section_key", "heading", "ordinal", "position")
    return K.list_classifications(classified, sections, 200, 50, status="definition").select("clause_id", "label", "section_key", "ordinal")
