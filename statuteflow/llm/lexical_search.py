"""Ranked lexical search by branch and bound in document FP-trees.

Documents keep only the terms that an item asks for, in the order of falling document frequency, so documents with equal
beginnings share a path of a trie. A subtree knows the largest tf of each of its terms and the smallest length measure m of
its documents; both bound the score of everything below it. Each item goes down depth first, the best child first, and
leaves a subtree whose bound is below the item's k-th score so far. The bounds only skip what cannot enter the result, so
the answer is exact.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage_table
from .registry import query
from .words import SPLIT_BYTES, span_keys, text_slices

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
BLOCK_BYTES = 1 << 20  # of items that are asked in one pass over the documents
GROUP = 256  # items whose bounds are computed together
LEAF, TREE_DOCS, TREE_BYTES = 48, 4096, 32 << 20  # documents of a leaf and of a tree; bytes of a tree's maxima


def terms_of(texts: list[bytes]):
    """(index of the text, hash of the term, the lower-cased bytes, start, end) of all terms, some megabytes at a time.

    Texts are one line of bytes with separators between; it is cut where no term is, so a long text needs no more memory.
    """
    begin = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
    raw = b"\n".join(t or b"" for t in texts).translate(_LOWER)
    at = 0
    while at < len(raw):
        end = min(len(raw), at + SPLIT_BYTES)
        while end < len(raw) and _TERM[raw[end]]:
            end += 1
        data = np.frombuffer(raw, dtype=np.uint8)[at:end]
        edge = np.flatnonzero(np.diff(_TERM[data], prepend=False, append=False))
        start, stop = edge[::2], edge[1::2]
        yield np.searchsorted(begin, start + at, side="right") - 1, span_keys(data, start, stop), data, start, stop
        at = end


def restricted(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in the sorted hashes ``vocabulary``), tfs: one row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                count, hits = np.zeros(len(texts), dtype=np.int64), [np.zeros(0, dtype=np.int64)]
                for doc, key, *_ in terms_of(texts):
                    count += np.bincount(doc, minlength=len(texts))
                    place = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
                    there = known[place] == key if len(known) else np.zeros(len(key), dtype=bool)
                    hits.append(doc[there] * len(known) + place[there])
                pairs, tf = np.unique(np.concatenate(hits), return_counts=True)
                bounds = np.searchsorted(pairs // max(len(known), 1), np.arange(len(texts) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (pairs % max(len(known), 1), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(count), *lists], ["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


class Tree:
    """The FP-tree of some documents: their terms are ranks, the most frequent first, in ascending order in each document."""

    def __init__(self, ptr: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, n_terms: int):
        paths = [term[a:b].astype(">u4").tobytes() for a, b in zip(ptr[:-1], ptr[1:])]
        self.order = np.array(sorted(range(len(paths)), key=paths.__getitem__), dtype=np.int64)  # documents along the trie
        sizes = np.diff(ptr)[self.order]
        self.ptr = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(ptr[self.order] - self.ptr[:-1], sizes) + np.arange(self.ptr[-1])
        self.term, self.tf, self.m = term[take], tf[take].astype(np.int64), m[self.order]
        shared = np.zeros(len(paths) + 1, dtype=np.int64)  # length of the path that a document shares with the one before it
        for i in range(1, len(paths)):
            a, b = self.term[self.ptr[i - 1] : self.ptr[i]], self.term[self.ptr[i] : self.ptr[i + 1]]
            k = min(len(a), len(b))
            differ = a[:k] != b[:k]
            shared[i] = differ.argmax() if differ.any() else k
        self.low, self.high, self.children = [0], [len(paths)], [[]]
        todo = [0]
        while todo:
            node = todo.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= LEAF:
                continue
            inner = shared[low + 1 : high]
            cuts = [low, *(low + 1 + np.flatnonzero(inner == inner.min())).tolist(), high]
            first = low
            for end, after in zip(cuts[1:], [*cuts[2:], math.inf]):
                if after - first <= LEAF:
                    continue  # small neighbours below one path are a leaf together
                self.low.append(first), self.high.append(end), self.children.append([])
                self.children[node].append(len(self.low) - 1)
                first = end
            todo += self.children[node]
        self.most = np.zeros((len(self.low), n_terms), dtype=np.int32)
        self.least = np.zeros(len(self.low), dtype=np.int64)
        for node in range(len(self.low) - 1, -1, -1):  # children come after their parent
            if self.children[node]:
                self.most[node] = self.most[self.children[node]].max(axis=0)
                self.least[node] = self.least[self.children[node]].min()
            else:
                own = slice(self.ptr[self.low[node]], self.ptr[self.high[node]])
                np.maximum.at(self.most[node], self.term[own], self.tf[own])
                self.least[node] = self.m[self.low[node] : self.high[node]].min()


def worth(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How much of a term's weight its occurrences give; grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Search:
    """The k best documents of each item among those given so far.

    ``items``: for each item its terms (ranks) and their repeats; ``weight``: of each rank.
    """

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, k: int):
        self.weight, self.k, self.groups = weight, k, []
        self.best: list[list[tuple]] = [[] for _ in items]  # (-score, id is null, id)
        self.least = np.ones(len(items), dtype=np.int64)  # the score that a document needs
        for low in range(0, len(items), GROUP):
            group = items[low : low + GROUP]
            columns = np.unique(np.concatenate([terms for terms, _ in group])) if group else np.zeros(0, dtype=np.int64)
            most = max((int((weight[terms] * times).sum()) for terms, times in group), default=0) * 1_000_000
            asks = np.zeros((len(columns), len(group)), dtype=np.float64 if most < 1 << 53 else np.int64)  # whole numbers, exact
            for j, (terms, times) in enumerate(group):
                asks[np.searchsorted(columns, terms), j] = times
            place = np.full(len(weight), -1, dtype=np.int64)
            place[columns] = np.arange(len(columns))
            self.groups.append((low, columns, asks, place))
        self.visited = 0  # leaves scored

    def ask(self, tree: Tree, ids: list) -> None:
        given = self.weight[tree.term] * worth(tree.tf, np.repeat(tree.m, np.diff(tree.ptr)))
        for low, columns, asks, place in self.groups:
            most = tree.most[:, columns].astype(np.int64)
            bound = (self.weight[columns] * worth(most, tree.least[:, None])).astype(asks.dtype) @ asks
            least = self.least[low : low + asks.shape[1]]  # a view
            stack = [0]
            while stack:
                node = stack.pop()
                alive = np.flatnonzero(bound[node] >= least)
                if not len(alive):
                    continue
                if tree.children[node]:
                    best = bound[tree.children[node]][:, alive].max(axis=1)
                    stack += [tree.children[node][i] for i in np.argsort(best, kind="stable")]
                    continue
                self.visited += 1
                first, last = tree.low[node], tree.high[node]
                own = slice(tree.ptr[first], tree.ptr[last])
                column = place[tree.term[own]]
                row = np.repeat(np.arange(last - first), np.diff(tree.ptr[first : last + 1]))
                vectors = np.zeros((last - first, len(columns)), dtype=asks.dtype)
                vectors[row[column >= 0], column[column >= 0]] = given[own][column >= 0]
                scores = (vectors @ asks[:, alive]).astype(np.int64)
                enter = scores >= least[alive]
                for j in np.flatnonzero(enter.any(axis=0)).tolist():
                    item = low + int(alive[j])
                    found = [(-int(scores[i, j]), ids[tree.order[first + i]] is None, ids[tree.order[first + i]] or 0) for i in np.flatnonzero(enter[:, j])]
                    self.best[item] = sorted(self.best[item] + found)[: self.k]
                    if len(self.best[item]) == self.k:
                        self.least[item] = -self.best[item][-1][0]


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): the ``k`` best documents of each row of ``items``.

    ``docs``: doc_id (a whole number), text; ``items``: item_id, text; other columns are not read. Documents with score 0 are
    not listed; equal scores stand by doc_id, null last. Every row is a document or item of its own, so repeated rows are
    listed each. Null and empty texts have no terms; an empty table on either side gives no rows. Texts of any length are
    read whole. Items are asked in blocks of about ``BLOCK_BYTES``, each with one pass over the documents.

    The restricted vectors are written to the shared folder: counts of the corpus need them all before a score is known.
    Each task then searches trees of its own vectors and sends k rows an item; they are ranked in two steps.
    """
    size = items.select(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    rows = items.select("item_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(1 + size // BLOCK_BYTES)))
    blocks = [_search_block(docs, rows.where(F.col("block") == b).select("item_id", "text"), k) for b in range(1 + size // BLOCK_BYTES)]
    return reduce(DataFrame.union, blocks)


def _search_block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    asked = [(r.item_id, (r.text or "").encode()) for r in items.collect()]  # about BLOCK_BYTES
    found = [(doc, key) for doc, key, *_ in terms_of([text for _, text in asked])]
    owner, keys = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))
    vocabulary = np.unique(keys)
    vectors = stage_table(restricted(docs, vocabulary), "term-vectors")
    n_docs, length = vectors.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for term, count in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the items' terms
        df[term] = count
    falling = np.argsort(-df, kind="stable")
    rank = np.empty(len(df), dtype=np.int64)
    rank[falling] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df[falling].tolist()], dtype=np.int64)
    pairs, times = np.unique(owner * max(len(df), 1) + rank[np.searchsorted(vocabulary, keys)], return_counts=True)
    cuts = np.searchsorted(pairs // max(len(df), 1), np.arange(len(asked) + 1))
    wanted = [(pairs[a:b] % max(len(df), 1), times[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    shared = spark.sparkContext.broadcast((wanted, weight, rank))
    tree_docs = int(min(TREE_DOCS, max(LEAF, TREE_BYTES * LEAF // (8 * max(len(df), 1)))))

    def run(batches):
        wanted, weight, rank = shared.value
        state = Search(wanted, weight, k)
        for batch in batches:
            for low in range(0, batch.num_rows, tree_docs):
                part = batch.slice(low, tree_docs)
                ids, n = part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False)
                ptr = part.column(2).offsets.to_numpy().astype(np.int64)
                term, tf = (part.column(c).values.to_numpy()[ptr[0] : ptr[-1]] for c in (2, 3))
                ptr -= ptr[0]
                doc = np.repeat(np.arange(len(ids)), np.diff(ptr))
                order = np.lexsort((rank[term], doc))
                m = 75 + (25 * n * n_docs) // max(length, 1)  # 64-bit: 25 * n * n_docs
                state.ask(Tree(ptr, rank[term][order], tf[order], m, len(weight)), ids)
        for item, best in enumerate(state.best):
            if best:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(best), pa.int32()), pa.array([None if null else i for _, null, i in best], pa.int64()), pa.array([-s for s, _, _ in best], pa.int64())],
                    ["item", "doc_id", "score"],
                )

    best = vectors.where("size(terms) > 0").mapInArrow(run, "item int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    best = best.withColumn("part", F.spark_partition_id() / 256).withColumn("part", F.col("part").cast("int"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(asked)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # names: a row for each item of the block


TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS_SQL = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM_SQL}')"
SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_TERMS_SQL} AS ts FROM documents),
tf AS MATERIALIZED (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ts) AS t FROM d) GROUP BY rid, t),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS total FROM d),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t, n_docs),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS_SQL}) AS t FROM benchmark) GROUP BY item_id, t),
m AS (SELECT rid, doc_id, 75 + (25 * len(ts) * n_docs) // total AS m FROM d, s WHERE len(ts) > 0),
r AS (SELECT item_id, rid, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (rid) GROUP BY item_id, rid)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM r JOIN m USING (rid) WHERE score > 0 QUALIFY rank <= 20"""


@query("op12_lexical_search", SQL)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
