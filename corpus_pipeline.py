"""A corpus pipeline: toxic documents go, then near duplicates, repeated passages and leaked benchmark items; what is left
is mixed by source.

Every stage takes the documents that its predecessor kept. Decisions are by doc_id: rows that share one are one document.
A row without doc_id cannot be named by a decision and stays in the stages that drop documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuteflow.llm.decontamination import contaminated
from statuteflow.llm.jaccard_join import similar_groups
from statuteflow.llm.mixing import balance_sources
from statuteflow.llm.substring_dedup import remove_repeats
from statuteflow.llm.toxicity import score_toxicity
from statuteflow.session import stage_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the labels' model calls toxic; a document goes if any of its rows is called so.

    All labels teach. Null and empty texts are not toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = score_toxicity(docs, docs, labels).where("predicted = 1").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(toxic, "doc_id", "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (five-word shingles, Jaccard of 0.8 or more) the one with the smallest doc_id.

    A document with several rows stays if one of them is the first of its group; of its equal rows one stays. Documents
    without words are no one's duplicates.
    """
    first = similar_groups(docs).where("id = component_id").select(F.col("id").alias("doc_id")).distinct()
    named = docs.select(*COLUMNS).join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*COLUMNS).union(docs.where("doc_id IS NULL").select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 13-word runs that an earlier one has; a document of which nothing is left goes.

    The text and n_chars of the others stay as they are.
    """
    done = remove_repeats(docs, carry=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("rest.text"))
    cut = done.where("n_removed = 0 OR n_removed < n_words").withColumn("text", text)
    chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("rest.n_chars"))
    return cut.select("rest.doc_id", "text", "rest.lang", "rest.source", chars.alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold a passage near a benchmark item."""
    leaks = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their copies and the words taken."""
    mixed = balance_sources(docs, carry=("text", "lang", "n_chars"))
    return mixed.where("copies > 0").select("doc_id", "rest.text", "rest.lang", "source", "rest.n_chars", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]
ORACLE_SQL = None  # the toxicity model is not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
