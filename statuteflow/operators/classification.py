"""Clause classification: training, runs, splits, admission, promotion."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.joins import attach_row
from ..functions.ordered import fingerprint_columns
from ..functions.scoring import temperature_scale, top_label
from ..functions.text import clause_hash, document_bucket, normalize_ws, sentences
from ..session import stage_table
from ..sources.records import violations


def split_by_document(
    rows: DataFrame, seed: str = "clause-split-v1", train_percent: int = 70, validation_percent: int = 15
) -> DataFrame:
    """Add ``split``: a document's hash decides, so all its clauses go to one side."""
    bucket = document_bucket("document_id", seed)
    return rows.withColumn(
        "split",
        F.when(bucket < train_percent, "train").when(bucket < train_percent + validation_percent, "validation").otherwise("test"),
    )


def split_checks(split: DataFrame) -> DataFrame:
    """Violations: empty splits and documents on two sides."""
    sizes = split.agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")])
    empty = sizes.select(
        F.explode(F.array(*[F.when(F.col(s) == 0, F.lit(s)) for s in ("train", "validation", "test")])).alias("key")
    ).where("key IS NOT NULL")
    leaking = split.groupBy("document_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    return empty.select(F.lit("empty_split").alias("check"), "key").unionByName(
        leaking.select(F.lit("document_leakage").alias("check"), F.col("document_id").alias("key"))
    )


def dataset_summary(rows: DataFrame) -> DataFrame:
    """Examples, documents, regulators and label counts."""
    counts = {f"label_{x}": F.count_if(F.col("label") == x) for x in V.LABELS}
    return rows.agg(
        F.count("*").alias("examples"), F.count_distinct("document_id").alias("documents"),
        F.count_distinct("regulator").alias("regulators"), *[c.alias(n) for n, c in counts.items()],
    )


def _canonical_row() -> Column:
    return F.concat_ws("|", F.trim("clause_id"), F.trim("document_id"), F.trim("regulator"), normalize_ws("text"), F.col("label"))


def dataset_fingerprint(rows: DataFrame) -> DataFrame:
    """Fingerprint of a labelled set: a digest per normalized row, combined without regard to order."""
    return rows.select(F.sha2(_canonical_row(), 256).alias("d")).agg(*fingerprint_columns(F.col("d")))


def promotion_failures(manifests: DataFrame) -> DataFrame:
    """Add ``failures``: the promotion gates a model misses. ``per_class_f1`` is a map, ``labels`` an array."""
    p, taxonomy = V.PROMOTION, F.array(*[F.lit(x) for x in sorted(V.LABELS)])
    complete = lambda names: F.sort_array(F.array_distinct(names)) == taxonomy
    gates = {
        "incomplete_label_taxonomy": complete(F.col("labels")),
        "insufficient_examples": F.col("example_count") >= p["examples"],
        "insufficient_documents": F.col("document_count") >= p["documents"],
        "insufficient_regulators": F.col("regulator_count") >= p["regulators"],
        "macro_f1_below_gate": F.col("macro_f1") >= p["macro_f1"],
        "per_class_f1_below_gate": complete(F.map_keys("per_class_f1"))
        & F.forall(F.map_values("per_class_f1"), lambda v: v >= p["per_class_f1"]),
        "covered_accuracy_below_gate": F.col("covered_accuracy") >= p["covered_accuracy"],
        "calibration_error_above_gate": F.col("expected_calibration_error") <= p["expected_calibration_error"],
        "coverage_below_gate": F.col("coverage") >= p["coverage"],
    }
    missed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates.items()])
    return manifests.withColumn("failures", F.filter(missed, lambda x: x.isNotNull()))


def dataset_admission(audits: DataFrame, datasets: DataFrame) -> DataFrame:
    """Violations that keep a dataset out of training. Audits: status, failures, unresolved_count and the hash audited."""
    joined = datasets.select("dataset_id", F.col("dataset_sha256").alias("wanted")).join(
        audits.withColumn("__audited", F.lit(True)), "dataset_id", "left"
    )
    return violations(
        joined,
        "dataset_id",
        {
            "no_audit": F.col("__audited").isNull(),
            "audit_not_ready": F.col("__audited").isNotNull() & ((F.col("status") != "ready") | (F.size("failures") > 0)),
            "hash_mismatch": F.col("__audited").isNotNull() & (F.col("dataset_sha256") != F.col("wanted")),
            "unresolved_annotations": F.col("__audited").isNotNull() & (F.col("unresolved_count") != 0),
        },
    ).drop("detail")


def artifact_fingerprint(files: DataFrame) -> DataFrame:
    """Fingerprint per artifact over its files (artifact_id, path, sha256); the mutable receipt is left out."""
    kept = files.where(~F.col("path").endswith("promotion.json"))
    return kept.groupBy("artifact_id").agg(
        *fingerprint_columns(F.sha2(F.concat_ws(":", "path", "sha256"), 256), "artifact_sha256")
    ).withColumnRenamed("rows", "files")


def promotion_receipts(
    manifests: DataFrame, audits: DataFrame, files: DataFrame, approver: str, approved_at: str, commit: str
) -> DataFrame:
    """Receipts of the models that pass every gate and have a clean audit of their own dataset."""
    clean = audits.where("status = 'ready' AND size(failures) = 0 AND unresolved_count = 0").select(
        "dataset_id", F.col("dataset_sha256").alias("audited_sha256"), F.col("examples").alias("dataset_examples")
    )
    return (
        promotion_failures(manifests)
        .where(F.size("failures") == 0)
        .join(clean, "dataset_id")
        .where("dataset_sha256 = audited_sha256")
        .join(artifact_fingerprint(files), F.col("model_id") == F.col("artifact_id"))
        .select(
            "model_id", "dataset_id", "dataset_sha256", "artifact_sha256", "dataset_examples",
            F.lit(approver).alias("approver"), F.lit(approved_at).alias("approved_at"), F.lit(commit).alias("training_commit"),
        )
    )


def verify_receipts(receipts: DataFrame, files: DataFrame) -> DataFrame:
    """Violations: receipts whose artifact is gone or has changed since."""
    now = artifact_fingerprint(files).select(F.col("artifact_id").alias("model_id"), F.col("artifact_sha256").alias("now"))
    return violations(
        receipts.join(now, "model_id", "left"),
        "model_id",
        {"artifact_missing": F.col("now").isNull(), "artifact_changed": F.col("now").isNotNull() & (F.col("now") != F.col("artifact_sha256"))},
    ).drop("detail")


# --- model ----------------------------------------------------------------------------------------------------


def missing_training_labels(split: DataFrame) -> DataFrame:
    seen = split.where("split = 'train'").select("label").distinct()
    labels = split.sparkSession.createDataFrame([(x,) for x in V.LABELS], "label string")
    return labels.join(seen, "label", "left_anti")


def baseline_terms() -> list:
    """Stages that give a text its ``terms``: words and word pairs."""
    return [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\w\w+", gaps=False, toLowercase=True),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
    ]


def term_weights(texts: DataFrame, vocabulary: int) -> tuple[list[str], list[float]]:
    """(terms, inverse document frequencies) of the most frequent terms of at least two texts, among equals by name.

    ``texts``: terms, copies. A row counts as ``copies`` texts.
    """
    rows = texts.select("copies", "terms", F.posexplode("terms").alias("place", "term"))
    first = F.array_position("terms", F.col("term")) == F.col("place") + 1
    counted = rows.groupBy("term").agg(F.sum("copies").alias("uses"), F.sum(F.when(first, F.col("copies"))).alias("texts"))
    total = texts.agg(F.sum("copies").alias("total"))
    idf = F.log((F.col("total") + 1.0) / (F.col("texts") + 1.0))
    kept = counted.where("texts >= 2").orderBy(F.desc("uses"), "term").limit(vocabulary)
    found = attach_row(kept, total).orderBy(F.desc("uses"), "term").select("term", idf.alias("idf")).collect()
    return [r["term"] for r in found], [r["idf"] for r in found]


def train_baseline(train: DataFrame, iterations: int = 100, vocabulary: int = 1 << 18, copies: str | None = None) -> PipelineModel:
    """Fit TF-IDF over words and word pairs with a logistic regression, with balanced class weights.

    Equal texts of one label are one row that weighs as much as they do; ``copies`` names a column with the times that a
    row counts. The regression divides features by a deviation corrected for the weights' squares, which such a row
    changes by the same factor for all features: the penalty takes it back, so the optimum is that of the single rows.
    """
    times = F.lit(1) if copies is None else F.col(copies)
    folded = stage_table(train.groupBy("label", "text").agg(F.sum(times).cast("bigint").alias("copies")), "texts")
    counts = folded.groupBy("label").agg(F.sum("copies").alias("label_count"))  # at most seven rows
    total = folded.agg(F.sum("copies").alias("total"), F.count_distinct("label").alias("labels"))
    each = F.col("total") / (F.col("labels") * F.col("label_count"))
    weighted = attach_row(folded.join(F.broadcast(counts), "label"), total).select(
        "label", "text", "copies", each.alias("each"), (F.col("copies") * each).alias("class_weight")
    )
    weight, single, several = weighted.agg(
        F.sum("class_weight"), F.sum(F.col("copies") * F.col("each") ** 2), F.sum(F.col("class_weight") ** 2)
    ).first()
    spread = (weight - single / weight) / (weight - several / weight) if weight**2 > several else 1.0

    index = StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep").fit(weighted)
    terms, idf = term_weights(PipelineModel(baseline_terms()).transform(weighted), vocabulary)
    prepare = [
        index, *baseline_terms(), CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="tf"),
        ElementwiseProduct(inputCol="tf", outputCol="tfidf", scalingVec=Vectors.dense(idf)),
        Normalizer(inputCol="tfidf", outputCol="features", p=2.0),
    ]
    # The index names a class of unknown labels, which no row has: fitted as one, rounding makes its first loss infinite.
    known = (F.col("label_index") + 0.0).alias("label_index")
    features = stage_table(PipelineModel(prepare).transform(weighted).select(known, "features", "class_weight"), "features")
    regression = LogisticRegression(
        featuresCol="features", labelCol="label_index", weightCol="class_weight", family="multinomial", maxIter=iterations,
        regParam=1e-3 / spread,
    )
    return PipelineModel([*prepare, regression.fit(features)])


def predict(model: PipelineModel, clauses: DataFrame, temperature: float = 1.0, threshold: float = 0.0) -> DataFrame:
    """Add probabilities, predicted label, confidence and abstention to rows with a ``text``."""
    names = [x for x in model.stages[0].labels]
    ready = clauses if "label" in clauses.columns else clauses.withColumn("label", F.lit(names[0]))
    scored = model.transform(ready)
    values = F.slice(vector_to_array("probability"), 1, len(names))
    raw = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), values)
    out = scored.withColumn("probabilities", temperature_scale(raw, temperature)).withColumn("top", top_label("probabilities"))
    return out.select(
        *clauses.columns, "probabilities", F.col("top.label").alias("predicted"), F.col("top.confidence").alias("confidence"),
        (F.col("top.confidence") < threshold).alias("abstained"),
    )


def classify_versions(
    sections: DataFrame, version_rows: DataFrame, ledger: DataFrame, model: PipelineModel, model_id: str,
    threshold: float, temperature: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """(classifications, new ledger rows) of the versions this model has not seen yet. Equal clauses are judged once."""
    done = ledger.where(F.col("model_id") == model_id).select("version_id")
    pending = version_rows.select("version_id").distinct().join(done, "version_id", "left_anti")
    clauses = sections.join(pending, "version_id", "left_semi").select(
        "version_id", "section_id", "page", F.explode(sentences("body")).alias("text")
    )
    judged = predict(model, clauses.select("text").distinct(), temperature, threshold)
    found = clauses.join(judged, "text").select(
        "version_id", "section_id", "page", "text", clause_hash("text").alias("clause_hash"),
        F.col("predicted").alias("label"), F.round("confidence", 5).alias("confidence"), "abstained",
        F.when(F.col("abstained"), "needs_review").otherwise("classified").alias("status"), "probabilities",
        F.lit(model_id).alias("model_id"),
    )
    counts = found.groupBy("version_id").agg(
        F.count("*").alias("clause_count"), F.count_if("abstained").alias("abstained_count")
    )
    runs = pending.join(counts, "version_id", "left").fillna(0).withColumn("model_id", F.lit(model_id))
    return found, runs


def list_classifications(
    classifications: DataFrame, sections: DataFrame, limit: int = 200, offset: int = 0, version_id=None, model_id=None, status=None
) -> DataFrame:
    for name, value in (("version_id", version_id), ("model_id", model_id), ("status", status)):
        if value is not None:
            classifications = classifications.where(F.col(name) == value)
    place = sections.select("section_id", "section_key", "heading", "ordinal", "position")
    return (
        classifications.join(place, "section_id")
        .orderBy(F.desc("ordinal"), "position", "clause_hash", "section_id")
        .offset(offset)
        .limit(limit)
    )
