"""Substring dedup with fixed-block anchors.

Every text is cut into reference blocks that do not overlap, of such a length that each window holds one whole block. The
blocks are indexed by hash and probed with every rolling run of that length of every text. Where a run meets a block of
another place, both places are anchors; hits are extended from them to whole windows, compared by a 64-bit hash, and
windows that overlap join to maximal exact repeats. Of each repeat the text with the smallest id keeps its words.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import chunked, deal, flags, from_planes, gather_flags, part_count, planes
from .registry import query
from .words import Words, runs, split_words

WINDOW = 13
LAST_ID = np.iinfo(np.int64).max  # stands for a null id, which comes after all others


def row_order(table: pa.Table) -> list[int]:
    """The same order of a chunk's rows each time the chunk is read; rows that tie are equal in id and text."""
    ids, texts = table.column("id").to_pylist(), table.column("text").to_pylist()
    return sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or b""))


def in_order(table: pa.Table) -> tuple[list, list, np.ndarray]:
    """Ids, texts and ids as numbers of a chunk, by ``row_order``."""
    table = table.select(["id", "text"]).take(pa.array(row_order(table), pa.int64()))
    ids, texts = table.column("id").to_pylist(), table.column("text").to_pylist()
    return ids, texts, np.array([LAST_ID if i is None else i for i in ids], dtype=np.int64)


def anchor_runs(words: Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes, and whether the run is a reference block, of all runs of ``block`` words."""
    at, keys = runs(words, block)
    first = np.searchsorted(words.doc, np.arange(words.doc[-1] + 1)) if len(words.doc) else words.doc
    return at, keys, (at - first[words.doc[at]]) % block == 0 if len(at) else np.zeros(0, dtype=bool)


def near_anchors(words: Words, window: int, block: int, at: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows that hold a marked anchor."""
    places, keys = runs(words, window)
    sums = np.zeros(len(words.key) + 1, dtype=np.int64)
    sums[at[marked] + 1] = 1
    sums = np.cumsum(sums)
    some = sums[places + window - block + 1] > sums[places] if len(places) else np.zeros(0, dtype=bool)
    return places[some], keys[some]


def covered(n_words: int, places: np.ndarray, window: int) -> np.ndarray:
    """Whether each word is in a window that begins at one of the places."""
    steps = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + window, -1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, n_words, n_removed, kept (bytes: kept words joined by one space), spans (first word, end) for every row.

    ``docs``: doc_id (whole number), text; of the other columns those in ``carry`` come along as the struct ``rest``. A word goes if a window that covers it also begins
    in a row with a smaller doc_id. Rows with the same doc_id do not touch each other; a null doc_id is after all
    others; a null or empty text has no words and an empty result; repeated rows are judged each. Texts of any length
    are read whole; a chunk holds whole texts. All exchanges are of even hash groups: chunks of texts, parts of hashes.
    """
    block = (window + 1) // 2
    rest = (F.struct(*carry).alias("rest"),) if carry else ()
    texts, parts = chunked(docs, others=rest), part_count(docs)

    def ask_anchors(table: pa.Table) -> pa.Table:
        _, raw, _ = in_order(table)
        _, keys, aligned = anchor_runs(split_words(raw), block)
        order, bounds = deal(keys, parts)
        some = np.flatnonzero(np.diff(bounds))
        spans = [order[bounds[p] : bounds[p + 1]] for p in some]
        return pa.table({
            "chunk": pa.array([table.column("chunk")[0].as_py()] * len(some), pa.int64()), "part": pa.array(some.astype(np.int32)),
            "keys": pa.array([keys[s].astype(np.uint32).tobytes() for s in spans], pa.binary()),
            "more": pa.array([np.packbits(aligned[s]).tobytes() for s in spans], pa.binary()),
        })

    def answer_anchors(table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(k, dtype=np.uint32) for k in table.column("keys").to_pylist()]
        aligned = np.concatenate([flags(m, len(k)) for m, k in zip(table.column("more").to_pylist(), asked)])
        _, number, times = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        hit = (times >= 2) & (np.bincount(number, weights=aligned, minlength=len(times)) > 0)
        return _answers(table, hit[number], [len(k) for k in asked])

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        _, raw, numbers = in_order(table)
        words, (places, keys) = _candidates(raw, answers, block, window, parts)
        owners = numbers[words.doc[places]]
        order, bounds = deal(keys, parts)
        some = np.flatnonzero(np.diff(bounds))
        spans = [order[bounds[p] : bounds[p + 1]] for p in some]
        return pa.table({
            "chunk": pa.array([table.column("chunk")[0].as_py()] * len(some), pa.int64()), "part": pa.array(some.astype(np.int32)),
            "keys": pa.array([keys[s].tobytes() for s in spans], pa.binary()), "more": pa.array([planes(owners[s]) for s in spans], pa.binary()),
        })

    def answer_windows(table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(k, dtype=np.uint64) for k in table.column("keys").to_pylist()]
        owner = np.concatenate([from_planes(m) for m in table.column("more").to_pylist()])
        _, number = np.unique(np.concatenate(asked), return_inverse=True)
        least = np.full(number.max() + 1, LAST_ID, dtype=np.int64)
        np.minimum.at(least, number, owner)
        return _answers(table, least[number] < owner, [len(k) for k in asked])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return OUT.empty_table()
        ids, raw, _ = in_order(table)
        along = table.select(["rest"]).take(pa.array(row_order(table), pa.int64())).column("rest") if carry else None
        first = np.array(answers.column("round").to_pylist(), dtype=np.int64) == 1
        words, (places, keys) = _candidates(raw, answers.filter(pa.array(first)), block, window, parts)
        second = answers.filter(pa.array(~first))
        gone = gather_flags(*deal(keys, parts), second.column("part").to_pylist(), second.column("flags").to_pylist())
        mask = covered(len(words.key), places[gone], window)
        n_words = np.bincount(words.doc, minlength=len(ids))
        n_removed = np.bincount(words.doc[mask], minlength=len(ids))
        bounds = np.concatenate([[0], np.cumsum(n_words)])
        kept, spans = [], []
        for i, text in enumerate(raw):
            own = (text or b"").split()
            if n_removed[i]:
                here = mask[bounds[i] : bounds[i + 1]]
                own = compress(own, (~here).tolist())
                turns = np.flatnonzero(np.diff(np.concatenate([[0], here.astype(np.int8), [0]])))
                spans.append(turns.reshape(-1, 2).tolist())
            else:
                spans.append([])
            kept.append(b" ".join(own))
        out = pa.table({"id": pa.array(ids, pa.int64()), "n_words": n_words.astype(np.int64), "n_removed": n_removed.astype(np.int64), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, OUT.field("spans").type)}, schema=OUT)
        return out.append_column("rest", along) if carry else out

    asks, answers = "chunk long, part int, keys binary, more binary", "chunk long, part int, flags binary"
    by_chunk = texts.groupBy("chunk")
    anchors = by_chunk.applyInArrow(ask_anchors, asks).groupBy("part").applyInArrow(answer_anchors, answers)
    windows = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(ask_windows, asks).groupBy("part").applyInArrow(answer_windows, answers)
    told = anchors.withColumn("round", F.lit(1)).union(windows.withColumn("round", F.lit(2)))
    schema = T.StructType.fromDDL("id long, n_words long, n_removed long, kept binary, spans array<array<long>>")
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(cut, T.StructType(schema.fields + ([texts.schema["rest"]] if carry else [])))


OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64())))])


def _answers(table: pa.Table, flag: np.ndarray, lengths: list[int]) -> pa.Table:
    ends = np.cumsum(lengths)
    packed = [np.packbits(flag[e - n : e]).tobytes() for e, n in zip(ends, lengths)]
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "flags": pa.array(packed, pa.binary())})


def _candidates(raw: list[bytes], answers: pa.Table, block: int, window: int, parts: int):
    words = split_words(raw)
    at, keys, _ = anchor_runs(words, block)
    marked = gather_flags(*deal(keys, parts), answers.column("part").to_pylist(), answers.column("flags").to_pylist())
    return words, near_anchors(words, window, block, at, marked)


def dedup_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``remove_repeats`` with doc_id and kept_text."""
    done = remove_repeats(docs, window)
    return done.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.decode("kept", "UTF-8").alias("kept_text"), "spans")


DEDUP_SQL = rf"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS pos FROM words),
windows AS (SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + {WINDOW - 1}), ' ') AS seq FROM places),
gone AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY seq) AS least FROM windows) WHERE least < doc_id),
removed AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {WINDOW})) AS pos FROM gone),
lists AS (SELECT doc_id, list(pos) AS gone FROM removed GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS k
  FROM words d LEFT JOIN lists USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""


@query("op1_substring_dedup", DEDUP_SQL)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that an earlier document has in the same 13-word run."""
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
