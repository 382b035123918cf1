"""N-gram Jaccard join with token-combination prefixes.

Two sets of shingles with a Jaccard similarity of at least t share a token among the first n - ceil(t n) + 1 of each, in
any order that all sets follow. Tokens that no other set has come first, as they meet nothing; then rare ones, each of
which is an index key; then frequent ones. Where the first common token is frequent, so are all the others, and two of
them stand among the first n - ceil(t n) + 2: frequent tokens are indexed by pairs. Where an index key brings two sets
together, their bitmaps (of each bit, whether an odd number of tokens has it) are compared: sets that differ in more bits
than a link may differ in tokens are no candidates. What is left is verified exactly.

Before that, texts with equal sets are one, and every set is compared with the most typical set among those with the same
minimal hash. That links most copies to their original, and the index then looks only for links between different
groups: however many sets a group has, a token that only this group uses is no key.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_table
from .components import components
from .exchange import chunked, deal, gather_flags, part_count
from .registry import query
from .substring_dedup import _answers, in_order
from .words import mix, runs, span_keys, split_words

SHINGLE, PERCENT = 5, 80
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
FREQUENT = 100  # a token in more groups than this is frequent
BITMAP = 8  # 64-bit numbers of a set's bitmap
PRUNED = 3  # times that tokens and sets without a possible link are taken out


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, sorted by both; a shorter text is one shingle, a text without words none."""
    words = split_words(texts, lower=True)
    at, keys = runs(words, size)
    doc = words.doc[at]
    n = np.bincount(words.doc, minlength=len(texts))
    ends = np.cumsum(n)
    short = np.flatnonzero((n > 0) & (n < size))
    doc = np.concatenate([doc, short])
    keys = np.concatenate([keys, span_keys(words.key, ends[short] - n[short], ends[short], 0xD1342543DE82EF95)])
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    return doc[new], keys[new]


def gather_sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id, n (size of the set), node (hash of the set), common (tokens that other sets have), lows (minimal hashes), tokens.

    Of equal sets one asks for its tokens. Tokens, common and lows are given only for it, and only where enough tokens
    are common for any link with a different set.
    """
    texts, parts = chunked(docs), part_count(docs)

    def sets_of(table: pa.Table):
        ids, raw, numbers = in_order(table)
        doc, keys = shingle_sets(raw, size)
        n = np.bincount(doc, minlength=len(ids))
        node = np.zeros(len(ids), dtype=np.uint64)
        np.add.at(node, doc, mix(keys))
        return ids, numbers, doc, keys, n, mix(node + n.astype(np.uint64)).view(np.int64)

    def sign(table: pa.Table) -> pa.Table:
        _, numbers, _, _, n, node = sets_of(table)
        some = np.flatnonzero(n)
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()] * len(some), pa.int64()), "node": node[some], "number": numbers[some]})

    def asking(numbers: np.ndarray, n: np.ndarray, node: np.ndarray, heads: pa.Table) -> np.ndarray:
        """Whether each text is the one of its set that asks; of repeated rows the first."""
        wanted = set(zip(heads.column("node").to_pylist(), heads.column("number").to_pylist()))
        out = np.zeros(len(n), dtype=bool)
        for i, key in enumerate(zip(node.tolist(), numbers.tolist())):
            if n[i] and key in wanted:
                out[i] = True
                wanted.discard(key)
        return out

    def ask(table: pa.Table, heads: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "keys": pa.array([], pa.binary())})
        _, numbers, doc, keys, n, node = sets_of(table)
        keys = keys[asking(numbers, n, node, heads)[doc]]
        order, bounds = deal(keys, parts)
        some = np.flatnonzero(np.diff(bounds))
        return pa.table({
            "chunk": pa.array([table.column("chunk")[0].as_py()] * len(some), pa.int64()), "part": pa.array(some.astype(np.int32)),
            "keys": pa.array([keys[order[bounds[p] : bounds[p + 1]]].astype(np.uint32).tobytes() for p in some], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(k, dtype=np.uint32) for k in table.column("keys").to_pylist()]
        _, number, times = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        return _answers(table, times[number] >= 2, [len(k) for k in asked])

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return SETS.empty_table()
        ids, numbers, doc, keys, n, node = sets_of(table)
        is_head = pa.array([part is None for part in told.column("part").to_pylist()], pa.bool_())
        asks = asking(numbers, n, node, told.filter(is_head))
        answers = told.filter(pa.array([not x for x in is_head.to_pylist()], pa.bool_()))
        doc, keys = doc[asks[doc]], keys[asks[doc]]
        shared = gather_flags(*deal(keys, parts), answers.column("part").to_pylist(), answers.column("flags").to_pylist())
        common = np.bincount(doc[shared], minlength=len(ids))
        cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
        lows, tokens = [], []
        for i in range(len(ids)):
            active = asks[i] and common[i] * 100 >= percent * n[i]
            own = keys[cuts[i] : cuts[i + 1]]
            lows.append([int(mix(own ^ np.uint64(seed)).min().view(np.int64)) for seed in SEEDS] if active else None)
            tokens.append(own.view(np.int64) if active else None)
        return pa.table({"id": pa.array(ids, pa.int64()), "n": n.astype(np.int64), "node": node, "common": common.astype(np.int64), "lows": pa.array(lows, pa.list_(pa.int64())), "tokens": pa.array(tokens, pa.list_(pa.int64()))}, schema=SETS)

    by_chunk = texts.groupBy("chunk")
    signed = by_chunk.applyInArrow(sign, "chunk long, node long, number long")
    heads = signed.groupBy("node").agg(F.min(F.struct("number", "chunk")).alias("head")).select("head.chunk", "node", "head.number")
    asks = by_chunk.cogroup(heads.groupBy("chunk")).applyInArrow(ask, "chunk long, part int, keys binary")
    answers = asks.groupBy("part").applyInArrow(answer, "chunk long, part int, flags binary")
    told = answers.select("chunk", "part", "flags", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("number")).union(
        heads.select("chunk", F.lit(None).cast("int"), F.lit(None).cast("binary"), "node", "number"))
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(finish, "id long, n long, node long, common long, lows array<long>, tokens array<long>")


SETS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("common", pa.int64()), ("lows", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. ``sets``: node, n, tokens."""
    one, two = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b")
    same = F.size(F.array_intersect("t_a", "t_b"))
    return both.select("a", "b", same.alias("same"), (F.col("n_a") + F.col("n_b") - same).alias("union")).where(F.col("same") * 100 >= F.col("union") * percent).select("a", "b")


def typical_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links of every set with the most typical one (fewest tokens of its own) of those that share a minimal hash with it."""
    rows = sets.select("node", (1 - F.col("common") / F.col("n")).alias("own"), F.posexplode("lows").alias("turn", "low"))
    centers = rows.groupBy("turn", "low").agg(F.min(F.struct("own", "node"))["node"].alias("b"), F.count("*").alias("many")).where("many > 1")
    pairs = rows.join(centers, ["turn", "low"]).where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    return verified(pairs, sets, percent)


def meeting_tokens(sets: DataFrame, groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, grp, n, own: the tokens of each set that a link with another group could have in common.

    ``groups``: node, grp. A token counts by the groups that have it, and knows the smallest set that does. A set keeps a
    token only if it has enough of them for a link with a set of that size; sets that have too few are out. What is out
    makes further tokens useless, so this is done again, each time over what is left.
    """
    left = sets.join(groups, "node").select("node", "grp", "n", F.explode("tokens").alias("token"))
    for turn in range(PRUNED):
        used = left.groupBy("token", "grp").agg(F.min("n").alias("low")).groupBy("token").agg(F.count("*").alias("in_groups"), F.min("low").alias("low")).where("in_groups > 1")
        own = left.join(used, "token").groupBy("node", "grp", "n").agg(F.collect_list(F.struct("in_groups", "token", "low")).alias("own"))
        own = own.withColumn("own", F.filter("own", lambda x: F.ceil((F.col("n") + x["low"]) * percent / (100 + percent)) <= F.size("own")))
        own = stage_table(own.where(F.size("own") * 100 >= F.col("n") * percent), "meeting")
        left = own.select("node", "grp", "n", F.explode("own.token").alias("token"))
    return own


def prefix_keys(meeting: DataFrame, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """key, node, grp, n, met, most, bits0 ..: index keys of the sets, how many tokens they have in ``meeting`` and can have
    in common in a link by such a key, and the bitmap of these tokens.

    Tokens that are not in ``meeting`` come first in the order of the prefix and use up its places.
    """
    own = F.sort_array(F.transform("own", lambda x: F.struct((x["in_groups"] > frequent).alias("often"), x["token"].alias("token"))))
    met = meeting.select("node", "grp", "n", own.alias("own"), F.size("own").alias("met"), F.size(F.filter("own", lambda x: x["in_groups"] > frequent)).alias("often"), *bitmap())
    places = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("met"))
    first = F.slice("own", 1, F.greatest(places, F.lit(0)).cast("int"))
    wider = F.filter(F.slice("own", 1, F.greatest(places + 1, F.lit(0)).cast("int")), lambda x: x["often"])
    # without a common rare token all common tokens are frequent
    wider = F.when(F.col("often") * 100 >= F.col("n") * percent, wider).otherwise(F.slice(wider, 1, 0))
    single = F.transform(F.filter(first, lambda x: ~x["often"]), lambda x: F.struct(F.xxhash64(x["token"]).alias("key"), F.col("met").alias("most")))
    pairs = F.flatten(F.transform(wider, lambda x, i: F.transform(
        F.slice(wider, i + 2, F.size(wider)), lambda y: F.struct(F.xxhash64(x["token"], y["token"]).alias("key"), F.col("often").alias("most")))))
    of_set = ["node", "grp", "n", "met", *(f"bits{i}" for i in range(BITMAP))]
    return met.select(*of_set, F.explode(F.concat(single, pairs)).alias("k")).select(*of_set, "k.key", "k.most")


def bitmap() -> list[Column]:
    """bits0 ..: of each of 64 * BITMAP bits, whether an odd number of the tokens in ``own`` has it."""
    tokens = "transform(own, x -> x.token)"
    part = "aggregate({}, 0L, (bits, t) -> bits ^ if(pmod(shiftright(t, 6), {}) = {}, shiftleft(1L, cast(t & 63 AS int)), 0L)) AS bits{}"
    return [F.expr(part.format(tokens, BITMAP, i, i)) for i in range(BITMAP)]


def candidates(keys: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: the pairs of sets of different groups that meet at a key and that sizes and bitmaps leave possible.

    A link has ``least`` tokens in common, which both sets have in ``meeting``; at most the others differ, and every bit
    in which the bitmaps differ is a different token.
    """
    of_set = ("node", "grp", "n", "met", "most", *(f"bits{i}" for i in range(BITMAP)))
    one, two = (keys.select("key", *[F.col(c).alias(f"{c}_{x}") for c in of_set]) for x in "ab")
    least = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"bits{i}_a").bitwiseXOR(F.col(f"bits{i}_b"))) for i in range(BITMAP)))
    possible = (F.least("most_a", "most_b") >= least) & (apart <= F.col("met_a") + F.col("met_b") - 2 * least)
    found = one.join(two, "key").where((F.col("node_a") < F.col("node_b")) & (F.col("grp_a") != F.col("grp_b")) & possible)
    return found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def links_between_groups(sets: DataFrame, groups: DataFrame, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """All links between sets of different groups."""
    keys = stage_table(prefix_keys(meeting_tokens(sets, groups, percent), percent, frequent), "keys")
    mixed = keys.groupBy("key").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high").select("key")
    keys = keys.join(mixed, "key")
    return verified(candidates(keys, percent).distinct(), sets, percent)


def similar_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links, its own included) for every row of ``docs``.

    ``docs``: doc_id (whole number), text; other columns are not read. A null or empty text, or one without words, has an
    empty set and links with nothing. Rows with equal sets are linked; repeated rows and repeated ids are nodes of their
    own text; a null id never is the smallest, and a group of null ids has a null component. Sets are compared by 64-bit
    hashes of their shingles. An empty table gives an empty result.
    """
    rows = stage_table(gather_sets(docs, size, percent), "sets")
    sets = rows.where("tokens IS NOT NULL").select("node", "n", "common", "lows", "tokens")
    near = stage_table(typical_links(sets, percent), "near")
    grouped = components(near)
    groups = stage_table(sets.select("node").join(grouped, "node", "left").select("node", F.coalesce("component", "node").alias("grp")), "groups")
    far = stage_table(links_between_groups(sets, groups, percent, frequent), "far")
    merged = components(near.union(far))
    heads = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("head"))
    placed = heads.join(merged, "node", "left").select("node", "head", F.coalesce("component", "node").alias("component"))
    named = placed.join(placed.groupBy("component").agg(F.min("head").alias("low")), "component").select("node", "low")
    found = rows.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    return found.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("id")).alias("component_id"))


JOIN_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * same >= {PERCENT} * (x.n + y.n - same)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON lowest.a = d.doc_id"""


@query("op10_ngram_join", JOIN_SQL)
def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document by similar sets of five-word shingles."""
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
