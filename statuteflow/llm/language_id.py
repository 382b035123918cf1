"""Language identification by one interpolated Kneser-Ney character model per language.

A word's letters are predicted one by one, with an end sign, from the four characters before them. The models are sorted
arrays of 64-bit hashes: n-grams with their discounted probability, contexts with the weight of the shorter context. The
language with the lowest cross-entropy per predicted character wins; a text whose cross-entropy is above what almost all
training texts of its language have is marked as rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_table
from .registry import query
from .words import distinct_words, span_keys, split_words, text_slices

ORDER = 5
BEGIN, END = "\x01", "\x02"
LETTERS = re.compile(r"[^\W\d_]+")
#: At most about so many training documents of a language, chosen by a hash of their id and text, fit its model.
FIT_DOCUMENTS = 5_000
#: A text is rejected when its cross-entropy exceeds this share of its language's training texts.
ACCEPTED = 0.995
#: Evidence saturates at so many predicted characters, as neighbouring characters are not independent.
EVIDENCE = 50.0


def letter_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the padded letter runs of the words; places to predict in them; the word that has each place."""
    runs = [LETTERS.findall(word.decode("utf-8", "replace").lower()) for word in words]
    padded = "".join(f"{BEGIN * (ORDER - 1)}{run}{END}" for found in runs for run in found)
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    places = np.flatnonzero(codes != ord(BEGIN))
    lengths = np.fromiter((sum(len(run) + 1 for run in found) for found in runs), dtype=np.int64, count=len(runs))
    return codes, places, np.repeat(np.arange(len(words)), lengths)


class LanguageModels:
    """Scores of characters under every language."""

    def __init__(self, languages: list[str], tables: list):
        self.languages, self.tables = languages, tables
        self.known = np.zeros(0, dtype=np.uint64)
        self.values = np.zeros((0, len(self.languages)))

    @classmethod
    def fit(cls, grams: pd.DataFrame) -> tuple[list[str], list]:
        """Names and tables. grams: lang, n (order), gram, c: counts of the highest order, numbers of left neighbours below it."""
        languages, tables = sorted(grams["lang"].unique()), []
        for language in languages:
            own = grams[grams["lang"] == language]
            symbols = own["gram"][own["n"] == 1].nunique() + 1  # one more for all unseen
            orders = []
            for n in range(1, ORDER + 1):
                part = own[own["n"] == n]
                count = part["c"].to_numpy(dtype=np.float64)
                ones, twos = (count == 1).sum(), (count == 2).sum()
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                context = part["gram"].str[:-1]
                by = part.assign(h=context).groupby("h")["c"].agg(["sum", "count"])
                share = np.maximum(count - discount, 0) / by["sum"].reindex(context).to_numpy(dtype=np.float64)
                orders.append((*_sorted(cls._keys(part["gram"], n), share), *_sorted(cls._keys(pd.Series(by.index), n - 1), (discount * by["count"] / by["sum"]).to_numpy())))
            tables.append((1.0 / symbols, orders))
        return languages, tables

    @staticmethod
    def _keys(grams: pd.Series, n: int) -> np.ndarray:
        codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        start = np.arange(len(grams)) * n
        return span_keys(codes, start, start + n)

    def log_probabilities(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Natural logarithms, one row for each place and one column for each language."""
        keys = span_keys(codes, places - ORDER + 1, places + 1)
        unique, first, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        at[at == len(self.known)] = 0
        new = self.known[at] != unique if len(self.known) else np.ones(len(unique), dtype=bool)
        if new.any():
            if len(self.known) > 400_000:
                self.known, self.values, new = self.known[:0], self.values[:0], np.ones(len(unique), dtype=bool)
            made = self._compute(codes, places[first[new]])
            keys_now = np.concatenate([self.known, unique[new]])
            order = np.argsort(keys_now, kind="stable")
            self.known, self.values = keys_now[order], np.concatenate([self.values, made])[order]
            at = np.searchsorted(self.known, unique)
        return self.values[at][back]

    def _compute(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = np.empty((len(places), len(self.languages)))
        spans = [(span_keys(codes, places - n + 1, places + 1), span_keys(codes, places - n + 1, places)) for n in range(1, ORDER + 1)]
        for i, (floor, orders) in enumerate(self.tables):
            p = np.full(len(places), floor)
            for (grams, contexts), (g, share, h, rest) in zip(spans, orders):
                p = _find(g, share, grams, 0.0) + _find(h, rest, contexts, 1.0) * p
            out[:, i] = np.log(p)
        return out


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def gather_grams(labelled: DataFrame) -> DataFrame:
    """lang, n, gram, c of every language: counts of the highest order, and below it numbers of different left neighbours.

    ``labelled``: lang, text. Words are counted once per task and language before the n-grams leave it.
    """

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, texts in text_slices(batch.column(1)):
                words = split_words(texts)
                codes, distinct, _ = distinct_words(words)
                points, places, owner = letter_codes(distinct)
                if not len(places):
                    continue
                keys = span_keys(points, places - ORDER + 1, places + 1)
                _, first, gram = np.unique(keys, return_index=True, return_inverse=True)
                starts = places[first] - ORDER + 1
                grams = ["".join(map(chr, points[s : s + ORDER])) for s in starts.tolist()]
                names, lang_of = np.unique([langs[at + i] for i in range(len(texts))], return_inverse=True)
                for k, name in enumerate(names):
                    times = np.bincount(codes[lang_of[words.doc] == k], minlength=len(distinct))
                    counts = np.bincount(gram, weights=times[owner], minlength=len(grams)).astype(np.int64)
                    some = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(some), pa.string()), pa.array([grams[j] for j in some.tolist()], pa.string()), pa.array(counts[some])], ["lang", "gram", "c"])

    level = labelled.select("lang", "text").mapInArrow(run, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    level = stage_table(level.withColumn("n", F.lit(ORDER)), "grams")
    levels = [level]
    for n in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c")).withColumn("n", F.lit(n))
        levels.append(level)
    out = levels[0].select("lang", "n", "gram", "c")
    for level in levels[1:]:
        out = out.union(level.select("lang", "n", "gram", "c"))
    return out


def fit_sample(labelled: DataFrame, most: int = FIT_DOCUMENTS) -> DataFrame:
    """lang, text of at most about ``most`` rows of each language, the same rows on every run."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("have"))
    share = F.lit(float(most)) / F.col("have")
    rows = labelled.join(F.broadcast(counts.orderBy(F.desc("have"), "lang").limit(10_000)), "lang")
    return rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < share * 1_000_003).select("lang", "text")


def _score(docs: DataFrame, models, columns: str) -> DataFrame:
    """docs: text last. Adds best (number of the language), entropy and share (of the evidence) to the first columns."""

    def run(batches):
        own = LanguageModels(*models.value)
        for batch in batches:
            for at, texts in text_slices(batch.column(batch.num_columns - 1)):
                words = split_words(texts)
                codes, distinct, _ = distinct_words(words)
                points, places, owner = letter_codes(distinct)
                logs = own.log_probabilities(points, places) if len(places) else np.zeros((0, len(own.languages)))
                sums = [np.bincount(owner, weights=logs[:, i], minlength=len(distinct)) for i in range(len(own.languages))]
                length = np.bincount(owner, minlength=len(distinct)).astype(float)
                per_doc = lambda x: np.bincount(words.doc, weights=x[codes] if len(codes) else None, minlength=len(texts))
                n = per_doc(length)
                entropy = np.stack([-per_doc(x) / np.maximum(n, 1) for x in sums], axis=1)
                best = entropy.argmin(axis=1)
                low = entropy[np.arange(len(texts)), best]
                share = 1 / np.exp(-np.minimum(n, EVIDENCE)[:, None] * (entropy - low[:, None])).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, len(texts)) for i in range(batch.num_columns - 1)),
                     pa.array(np.where(n > 0, best, -1).astype(np.int32)), pa.array(low), pa.array(np.where(n > 0, share, 0.0))],
                    [*(batch.schema.names[:-1]), "best", "entropy", "share"],
                )

    return docs.mapInArrow(run, f"{columns}, best int, entropy double, share double")


def identify(docs: DataFrame, labelled: DataFrame, most: int = FIT_DOCUMENTS) -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected for every row of ``docs`` (doc_id, text; other columns are not read).

    ``labelled``: doc_id, lang, text to learn from; rows with a null lang or text are left out. A text that is null, empty
    or without a letter is ``und`` with score 0; so is every text if nothing can be learned. Ties go to the first
    language by name. Repeated rows and null ids are rows like others. The models, bounded by the fitted sample, are
    broadcast; scoring is row-local.
    """
    spark = docs.sparkSession
    sample = stage_table(fit_sample(labelled.select("doc_id", "lang", "text").dropna(subset=["lang", "text"]), most), "sample")
    grams = gather_grams(sample).toPandas()
    kind = docs.schema["doc_id"].dataType.simpleString()
    if grams.empty:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    languages, tables = LanguageModels.fit(grams)
    models = spark.sparkContext.broadcast((languages, tables))
    seen = _score(sample.select(F.lit(0).alias("row"), F.col("text").cast("string")), models, "row int")
    limits = dict(seen.where("best >= 0").groupBy("best").agg(F.percentile_approx("entropy", ACCEPTED, 1000).alias("limit")).collect())
    names = F.array(*[F.lit(x) for x in languages])
    limit = F.array(*[F.lit(float(limits.get(i, "inf"))) for i in range(len(languages))])
    scored = _score(docs.select("doc_id", F.col("text").cast("string").alias("text")), models, f"doc_id {kind}")
    found = F.col("best") >= 0
    return scored.select(
        "doc_id",
        F.when(found, F.element_at(names, F.col("best") + 1)).otherwise("und").alias("lang_pred"),
        F.col("share").alias("score"),
        F.when(found, F.col("entropy")).alias("entropy"),
        (~found | (F.col("entropy") > F.element_at(limit, F.greatest(F.col("best"), F.lit(0)) + 1))).alias("rejected"),
    )


@query("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, learned from three folds of four."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    found = identify(docs, docs.where(fold != 2))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
