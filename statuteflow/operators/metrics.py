"""Classification, calibration and agreement metrics.

Every metric starts from counts per distinct value (label pair, score, bin), so what follows the first aggregate is
small whatever the number of predictions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed as V
from ..functions.joins import attach_row
from ..functions.ordered import running_sum


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def label_table(df: DataFrame) -> DataFrame:
    """The taxonomy as rows (index, label): seven of them, whatever the data."""
    return df.sparkSession.createDataFrame(list(enumerate(V.LABELS)), "index int, label string")


def confusion_counts(predictions: DataFrame, by: Sequence[str] = (), copies: str | None = None) -> DataFrame:
    """Rows of each pair of labels; ``copies`` names a column with the times that a row counts."""
    n = F.count("*") if copies is None else F.sum(copies)
    return predictions.groupBy(*by, "expected", "predicted").agg(n.alias("n"))


def class_report(predictions: DataFrame, by: Sequence[str] = (), copies: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support of all seven labels, also of those that never occur."""
    counts = confusion_counts(predictions, by, copies)
    both = counts.select(
        *by, F.explode(
            F.array(
                F.struct(F.col("expected").alias("label"), F.lit("e").alias("side")),
                F.struct(F.col("predicted").alias("label"), F.lit("p").alias("side")),
            )
        ).alias("x"), "n", (F.col("expected") == F.col("predicted")).alias("hit"),
    ).select(*by, "x.label", "x.side", "n", "hit")
    sums = both.groupBy(*by, "label").agg(
        F.sum(F.when((F.col("side") == "e") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("side") == "e", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("predicted"),
    )
    labels = F.broadcast(label_table(predictions))
    groups = counts.select(*by).distinct() if by else None
    frame = labels if groups is None else groups.select(
        *by, F.explode(F.array(*[F.struct(F.lit(i).alias("index"), F.lit(x).alias("label")) for i, x in enumerate(V.LABELS)])).alias("l")
    ).select(*by, "l.*")
    return (
        frame.join(sums, [*by, "label"], "left")
        .fillna(0, ["tp", "support", "predicted"])
        .withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .select(*by, "label", "precision", "recall", "f1", "support", "predicted")
    )


def macro_report(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro and weighted F1 from a class report."""
    return report.groupBy(*by).agg(
        (F.sum("f1") / len(V.LABELS)).alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.min("f1").alias("least_f1"),
    )


def accuracy_report(predictions: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    hit = F.col("expected") == F.col("predicted")
    covered = F.col("confidence") >= threshold
    return predictions.groupBy(*by).agg(
        F.count("*").alias("examples"),
        (F.count_if(hit) / F.count("*")).alias("accuracy"),
        (F.count_if(covered) / F.count("*")).alias("coverage"),
        ratio(F.count_if(hit & covered), F.count_if(covered)).alias("covered_accuracy"),
    )


def confusion_matrix(predictions: DataFrame, rows: str = "expected", columns: str = "predicted") -> DataFrame:
    """One row per label with a column per label; absent pairs are 0."""
    counts = predictions.groupBy(rows).pivot(columns, list(V.LABELS)).count()
    return (
        F.broadcast(label_table(predictions)).join(counts, F.col("label") == F.col(rows), "left").fillna(0, list(V.LABELS))
        .select(F.col("label").alias(rows), *V.LABELS)
    )


def confidence_bin(confidence: Column, bins: int = 10) -> Column:
    """Index of the half-open bin; the last one is closed. Edges are compared as the doubles i / bins."""
    return sum((F.when(confidence >= i / bins, 1).otherwise(0) for i in range(1, bins)), F.lit(0))


def expected_calibration_error(predictions: DataFrame, bins: int = 10) -> DataFrame:
    hit = (F.col("expected") == F.col("predicted")).cast("double")
    per_bin = predictions.groupBy(confidence_bin(F.col("confidence"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg("confidence").alias("confidence")
    )
    return per_bin.agg(
        (F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("expected_calibration_error")
    )


def _from_above(observations: DataFrame, score: str, hit: Column) -> DataFrame:
    """Per distinct score: rows and hits at or above it. Scores lie in 0..1 and are summed in 1000 chunks."""
    per_score = observations.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    chunk = F.floor((1 - F.col("score")) * 1000)
    order = [F.desc("score")]
    rows = running_sum(per_score, [], chunk, order, "selected", F.col("n"))
    return running_sum(rows, [], chunk, order, "correct", F.col("hits"))


def abstention_threshold(predictions: DataFrame, minimum_covered_accuracy: float, minimum_coverage: float) -> DataFrame:
    """Lowest observed confidence that keeps accuracy and coverage above their minima (null where none does)."""
    above = _from_above(predictions, "confidence", F.col("expected") == F.col("predicted"))
    total = above.agg(F.max("selected").alias("total"))
    ok = (F.col("correct") / F.col("selected") >= minimum_covered_accuracy) & (
        F.col("selected") / F.col("total") >= minimum_coverage
    )
    return attach_row(above, total).agg(F.min(F.when(ok, F.col("score"))).alias("threshold"))


def precision_threshold(observations: DataFrame, minimum_precision: float) -> DataFrame:
    """Lowest observed score whose selection is precise enough. ``observations``: score double, label boolean."""
    above = _from_above(observations, "score", F.col("label"))
    return above.agg(F.min(F.when(F.col("correct") / F.col("selected") >= minimum_precision, F.col("score"))).alias("threshold"))


def brier_and_ece(observations: DataFrame) -> DataFrame:
    """Brier score and calibration error over exact scores, rounded to four digits."""
    per_score = observations.groupBy("score").agg(F.count("*").alias("n"), F.count_if("label").alias("hits"))
    squares = F.col("hits") * F.pow(F.col("score") - 1, 2) + (F.col("n") - F.col("hits")) * F.pow(F.col("score"), 2)
    return per_score.agg(
        F.round(F.sum(squares) / F.sum("n"), 4).alias("brier"),
        F.round(F.sum(F.col("n") * F.abs(F.col("hits") / F.col("n") - F.col("score"))) / F.sum("n"), 4).alias("ece"),
    )


def temperature_grid(predictions: DataFrame, temperatures: Sequence[float]) -> DataFrame:
    """Mean negative log likelihood of every temperature of a fixed grid.

    ``predictions``: label, probabilities map<string,double>. Each row meets every temperature, and the partial
    averages fold on the map side to one row per temperature.
    """
    from ..functions.scoring import temperature_scale

    grid = F.array(*[F.lit(float(t)) for t in temperatures])
    met = predictions.select("label", "probabilities", F.explode(grid).alias("temperature"))
    likelihood = F.try_element_at(temperature_scale("probabilities", F.col("temperature")), F.col("label"))
    return met.groupBy("temperature").agg(F.avg(-F.log(likelihood + 1e-12)).alias("loss"))


def best_temperature(grid: DataFrame) -> DataFrame:
    """The temperature with the least loss; the lower one where two are equal."""
    return grid.agg(F.min(F.struct("loss", "temperature")).alias("b")).select("b.temperature", "b.loss")


def monitoring_slices(predictions: DataFrame) -> DataFrame:
    """Volume, confidence and abstention per regulator, day and label."""
    return predictions.groupBy("regulator", "day", "label").agg(
        F.count("*").alias("n"),
        F.avg("confidence").alias("mean_confidence"),
        F.min("confidence").alias("least_confidence"),
        F.avg(F.col("abstained").cast("double")).alias("abstention_rate"),
    )


def annotator_agreement(votes: DataFrame) -> DataFrame:
    """One row: raw agreement, expected agreement and Cohen's kappa. ``votes``: label_a, label_b."""
    pairs = votes.groupBy("label_a", "label_b").agg(F.count("*").alias("n"))
    sides = pairs.select(
        F.explode(F.array(F.struct(F.col("label_a").alias("label"), F.lit(0).alias("s")), F.struct(F.col("label_b").alias("label"), F.lit(1).alias("s")))).alias("x"),
        "n", (F.col("label_a") == F.col("label_b")).alias("hit"),
    )
    marginals = sides.groupBy("x.label").agg(
        F.sum(F.when(F.col("x.s") == 0, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("x.s") == 1, F.col("n")).otherwise(0)).alias("b"),
        F.sum(F.when((F.col("x.s") == 0) & F.col("hit"), F.col("n")).otherwise(0)).alias("matches"),
    )
    row = marginals.agg(
        F.sum("a").alias("clauses"), F.sum("matches").alias("agreements"),
        F.sum(F.col("a").cast("double") * F.col("b").cast("double")).alias("products"),
    )
    raw = F.col("agreements") / F.col("clauses")
    expected = F.col("products") / (F.col("clauses").cast("double") * F.col("clauses").cast("double"))
    kappa = F.when(expected == 1.0, F.when(raw == 1.0, 1.0).otherwise(0.0)).otherwise((raw - expected) / (1 - expected))
    return row.select("clauses", "agreements", raw.alias("raw_agreement"), expected.alias("expected_agreement"), kappa.alias("cohens_kappa"))


def class_agreement(votes: DataFrame) -> DataFrame:
    """Per label: uses by each side, matches, positive and binary agreement."""
    pairs = votes.groupBy("label_a", "label_b").agg(F.count("*").alias("n"))
    sides = pairs.select(
        F.explode(F.array(F.struct(F.col("label_a").alias("label"), F.lit(0).alias("s")), F.struct(F.col("label_b").alias("label"), F.lit(1).alias("s")))).alias("x"),
        "n", (F.col("label_a") == F.col("label_b")).alias("hit"),
    )
    sums = sides.groupBy(F.col("x.label").alias("label")).agg(
        F.sum(F.when(F.col("x.s") == 0, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("x.s") == 1, F.col("n")).otherwise(0)).alias("b"),
        F.sum(F.when((F.col("x.s") == 0) & F.col("hit"), F.col("n")).otherwise(0)).alias("matches"),
    )
    filled = F.broadcast(label_table(votes)).join(sums, "label", "left").fillna(0, ["a", "b", "matches"])
    total = F.sum("a").over(Window.partitionBy())  # seven rows
    return filled.withColumn("total", total).select(
        "label", F.col("a").alias("annotator_a_count"), F.col("b").alias("annotator_b_count"), "matches",
        F.try_divide(2 * F.col("matches"), F.col("a") + F.col("b")).alias("positive_agreement"),
        ((2 * F.col("matches") + F.col("total") - F.col("a") - F.col("b")) / F.col("total")).alias("binary_agreement"),
    )
