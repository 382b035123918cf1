"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors go to the clusters of their nearest centroids, each to several, so that shards overlap. A shard builds a graph:
nearest neighbours, thinned by robust pruning, with reversed edges and a way from the medoid to every node. The adjacency
lists of a vector are united over its shards. Every vector is then searched in each of its shards: greedily from the
medoid with a beam, and from each hit outwards while neighbours are in range. An audit compares a sample of queries with
all vectors and widens the search if too many links are missing; if they still are in the last turn, all blocks are compared
with all. Links are verified in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_table
from .components import components
from .registry import query

LEAST = 0.9  # cosine of a link
#: Centroids are fitted on at most about so many vectors, and are at most so many; the audit takes about so many queries.
FIT_VECTORS, CENTROIDS, AUDIT_QUERIES = 20_000, 4_096, 200
SHARD, BLOCK = 1_500, 4_000  # wanted members of a shard; a larger shard is cut into blocks of at most about so many
OVERLAP, BEAM, NEAREST, DEGREE, ALPHA = 2, 12, 8, 24, 1.2
RECALL, WIDENED = 0.97, 2  # wanted recall of the audit; times the search is widened at most
LANES = 256


def unit_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, dim, v: vectors that are not null or zero and hold finite numbers only, divided by their length."""
    v = F.col(vector_column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = rows.select(F.col(id_column).alias("id"), v.alias("v")).where(v.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    top = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))  # so that squares neither overflow nor vanish
    clean = clean.withColumn("top", top).where("top > 0")
    scaled = clean.withColumn("v", F.transform("v", lambda x: x / F.col("top")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return scaled.withColumn("norm", norm).select("id", F.size("v").alias("dim"), F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def fit_centroids(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over a bounded sample."""
    rng = np.random.default_rng(7)
    centers = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)]
    for _ in range(rounds):
        nearest = (vectors @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centers)
    return centers


def build_graph(x: np.ndarray) -> tuple[np.ndarray, int]:
    """(neighbours of each node, -1 where there are fewer; the medoid) of the unit vectors of a block."""
    n = len(x)
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    medoid = int((x @ x.mean(axis=0)).argmax())
    wide = min(n - 1, 2 * DEGREE)
    if wide < 1:
        return np.full((n, 1), -1), medoid
    rng = np.random.default_rng(n)
    near = np.argpartition(-cos, wide - 1, axis=1)[:, :wide]
    near = np.concatenate([near, rng.integers(0, n, (n, 4))], axis=1)  # a few long edges
    rows = np.arange(n)[:, None]
    near = np.take_along_axis(near, np.argsort(-cos[rows, near], axis=1, kind="stable"), axis=1)
    far = np.sqrt(np.maximum(0, 2 - 2 * cos[rows, near]))
    alive = near != rows
    nearest = near[:, :NEAREST]
    edges = [np.stack([np.repeat(np.arange(n), nearest.shape[1]), nearest.reshape(-1)], axis=1)]
    for _ in range(DEGREE):  # robust pruning of all nodes at once
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        chosen = near[np.arange(n), first]
        edges.append(np.stack([np.flatnonzero(some), chosen[some]], axis=1))
        between = np.sqrt(np.maximum(0, 2 - 2 * np.minimum(1, cos[chosen[:, None], near])))
        alive &= ALPHA * between > far
        alive[np.arange(n), first] = False
        alive &= near != chosen[:, None]
    pairs = np.concatenate(edges)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    pairs = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    graph = _padded(n, pairs)
    while True:  # a way from the medoid to every node
        reached = np.zeros(n, dtype=bool)
        step = np.array([medoid])
        while len(step):
            reached[step] = True
            step = np.unique(graph[step])
            step = step[(step >= 0)]
            step = step[~reached[step]]
        if reached.all():
            return graph, medoid
        inside, outside = np.flatnonzero(reached), np.flatnonzero(~reached)
        sims = cos[np.ix_(outside, inside)]
        o, i = np.unravel_index(sims.argmax(), sims.shape)
        pairs = np.concatenate([pairs, [[inside[i], outside[o]], [outside[o], inside[i]]]])
        graph = _padded(n, pairs)


def _padded(n: int, pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    degree = np.bincount(pairs[:, 0], minlength=n)
    out = np.full((n, max(1, degree.max(initial=0))), -1, dtype=np.int64)
    out[pairs[:, 0], np.arange(len(pairs)) - np.repeat(np.cumsum(degree) - degree, degree)] = pairs[:, 1]
    return out


def search_graph(x: np.ndarray, graph: np.ndarray, medoid: int, queries: np.ndarray, beam: int, least: float) -> np.ndarray:
    """Whether each node is a hit of each query: greedy search with a beam, then expansion of all that is in range."""
    q, n = len(queries), len(x)
    seen, hits, done = (np.zeros((q, n), dtype=bool) for _ in range(3))
    lane = np.arange(q)
    sims0 = queries @ x[medoid]
    nodes, sims = np.full((q, beam), -1), np.full((q, beam), -3.0)
    nodes[:, 0], sims[:, 0] = medoid, sims0
    seen[:, medoid], hits[:, medoid] = True, sims0 >= least
    open_ = np.zeros((q, beam), dtype=bool)
    open_[:, 0] = True
    active = lane
    while len(active):
        best = np.where(open_[active], sims[active], -4.0).argmax(axis=1)
        node = nodes[active, best]
        open_[active, best] = False
        done[active, node] = True
        near = graph[node]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        got = np.where(fresh, np.einsum("qd,qrd->qr", queries[active], x[near]), -3.0)
        at, col = np.nonzero(fresh)
        seen[active[at], near[at, col]] = True
        hits[active[at], near[at, col]] = got[at, col] >= least
        all_nodes = np.concatenate([nodes[active], near], axis=1)
        all_sims = np.concatenate([sims[active], got], axis=1)
        all_open = np.concatenate([open_[active], fresh], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        nodes[active], sims[active], open_[active] = (np.take_along_axis(a, top, axis=1) for a in (all_nodes, all_sims, all_open))
        active = active[open_[active].any(axis=1)]
    while True:
        a, node = np.nonzero(hits & ~done)
        if not len(a):
            return hits
        done[a, node] = True
        for part in range(0, len(a), 20_000):
            near = graph[node[part : part + 20_000]]
            pair = np.unique((a[part : part + 20_000, None] * n + near)[near >= 0])
            who, what = pair // n, pair % n
            new = ~seen[who, what]
            who, what = who[new], what[new]
            seen[who, what] = True
            hits[who, what] = np.einsum("pd,pd->p", queries[who], x[what]) >= least


def smallest_labels(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels of nodes after the links (a, b) of one task: the smallest in each component."""
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == labels).all():
            return labels
        labels = new


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64) if len(column) else np.zeros((0, 0))


def sharded(vectors: DataFrame, overlap: int) -> DataFrame:
    """id, dim, v, copies, shards of every vector. Centroids: a bounded sample's, for each dimension."""
    spark, total = vectors.sparkSession, vectors.count()
    sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < min(1.0, FIT_VECTORS / max(1, total)) * 1_000_003).select("dim", "v").toPandas()
    found = {dim: fit_centroids(_matrix(own["v"]), int(min(CENTROIDS, max(1, round(total * len(own) / max(1, len(sample)) * overlap / SHARD))))) for dim, own in sample.groupby("dim")}
    centers = spark.sparkContext.broadcast(found)

    def assign(frames):
        for frame in frames:
            out = []
            for dim, own in frame.groupby("dim"):
                c = centers.value.get(dim)
                if c is None:  # a dimension that the sample has not: one shard
                    chosen = np.zeros((len(own), 1), dtype=int)
                else:
                    chosen = np.argsort(-(_matrix(own["v"]) @ c.T), axis=1, kind="stable")[:, :overlap]
                out.append(own.assign(shards=list(chosen)))
            yield pd.concat(out) if out else frame.assign(shards=[])

    return vectors.select("id", "dim", "v", "copies").mapInPandas(assign, "id long, dim int, v array<double>, copies long, shards array<int>")


def find_links(vectors: DataFrame, overlap: int, beam: int, least: float) -> DataFrame:
    """id, links (number of other vectors found, with their copies), label (edge to the smallest id of a shard's component), from all shards."""
    placed = stage_table(sharded(vectors, overlap), "placed")
    members = placed.select("id", "dim", "v", "copies", "shards", F.explode("shards").alias("shard"))
    sizes = members.groupBy("dim", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = stage_table(members.join(sizes, ["dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "members")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        graph, medoid = build_graph(_matrix(frame["v"]))
        ids = frame["id"].to_numpy()
        return pd.DataFrame({"dim": frame["dim"], "shard": frame["shard"], "block": frame["block"], "id": ids, "medoid": np.arange(len(ids)) == medoid, "near": [ids[row[row >= 0]] for row in graph]})

    built = stage_table(members.groupBy("dim", "shard", "block").applyInPandas(build, "dim int, shard int, block int, id long, medoid boolean, near array<long>"), "built")
    united = built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a vector has few shards
    medoids = built.where("medoid").select("dim", "shard", "block", "id", "medoid")
    nodes = members.join(united, "id").join(medoids, ["dim", "shard", "block", "id"], "left")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(name)
    graph_rows = nodes.select("dim", "shard", "block", every("turn"), "id", "v", "copies", "shards", "near", F.coalesce("medoid", F.lit(False)).alias("medoid"), F.lit(True).alias("is_node"))
    asking = members.select("dim", "shard", every("to"), F.col("block").alias("turn"), "id", "v", "copies", "shards").select(
        "dim", "shard", F.col("to").alias("block"), "turn", "id", "v", "copies", "shards", F.lit(None).cast("array<long>").alias("near"), F.lit(False).alias("medoid"), F.lit(False).alias("is_node"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        node, ask = (frame[frame["is_node"] == kind].sort_values("id", ignore_index=True) for kind in (True, False))
        if node.empty or ask.empty:
            return pd.DataFrame({"id": [], "links": [], "label": []})
        x, ids, shard = _matrix(node["v"]), node["id"].to_numpy(), int(frame["shard"].iloc[0])
        lengths = node["near"].str.len().to_numpy()
        target = np.concatenate(node["near"].to_numpy())
        place = np.minimum(np.searchsorted(ids, target), len(ids) - 1)
        pairs = np.stack([np.repeat(np.arange(len(ids)), lengths), place], axis=1)[ids[place] == target]
        graph, medoid = _padded(len(ids), pairs), int(node["medoid"].to_numpy().argmax())
        queries, own, copies = _matrix(ask["v"]), ask["id"].to_numpy(), node["copies"].to_numpy()
        lists = {kind: np.array(f["shards"].tolist(), dtype=np.int64) for kind, f in ((True, node), (False, ask))}
        labels = np.unique(np.concatenate([ids, own]))
        start = labels.copy()
        found_a, found_b, counts = [], [], np.zeros(len(own), dtype=np.int64)
        for first in range(0, len(own), LANES):
            hits = search_graph(x, graph, medoid, queries[first : first + LANES], beam, least)
            a, b = np.nonzero(hits)
            other = own[first + a] != ids[b]
            a, b = a[other] + first, b[other]
            # a pair that meets in several shards counts in the first of the asking vector's shards that has both
            mine, theirs = lists[False][a], lists[True][b]
            met = (mine[:, :, None] == theirs[:, None, :]).any(axis=2)
            here = mine[np.arange(len(a)), met.argmax(axis=1)] == shard
            counts += np.bincount(a[here], weights=copies[b[here]], minlength=len(own)).astype(np.int64)
            found_a.append(np.searchsorted(start, own[a]))
            found_b.append(np.searchsorted(start, ids[b]))
        labels = smallest_labels(np.concatenate(found_a), np.concatenate(found_b), labels)
        linked = np.unique(np.concatenate(found_a + found_b)) if found_a else np.zeros(0, dtype=int)
        edges = pd.DataFrame({"id": start[linked], "links": 0, "label": labels[linked]})
        return pd.concat([pd.DataFrame({"id": own, "links": counts, "label": own}), edges[edges["id"] != edges["label"]]])

    return graph_rows.unionByName(asking).groupBy("dim", "shard", "block", "turn").applyInPandas(search, "id long, links long, label long")


def exact_links(vectors: DataFrame, least: float) -> DataFrame:
    """What ``find_links`` gives, without a miss: every block of a dimension is compared with every block of it."""
    sizes = vectors.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = vectors.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    nodes = members.select("dim", "block", every.alias("turn"), "id", "v", "copies", F.lit(True).alias("is_node"))
    asking = members.select("dim", every.alias("to"), F.col("block").alias("turn"), "id", "v", "copies").select("dim", F.col("to").alias("block"), "turn", "id", "v", "copies", F.lit(False).alias("is_node"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        node, ask = (frame[frame["is_node"] == kind].sort_values("id", ignore_index=True) for kind in (True, False))
        if node.empty or ask.empty:
            return pd.DataFrame({"id": [], "links": [], "label": []})
        x, ids, copies = _matrix(node["v"]), node["id"].to_numpy(), node["copies"].to_numpy()
        queries, own = _matrix(ask["v"]), ask["id"].to_numpy()
        start = np.unique(np.concatenate([ids, own]))
        labels, counts = start.copy(), np.zeros(len(own), dtype=np.int64)
        for first in range(0, len(own), LANES):
            a, b = np.nonzero((queries[first : first + LANES] @ x.T >= least) & (own[first : first + LANES, None] != ids))
            counts += np.bincount(a + first, weights=copies[b], minlength=len(own)).astype(np.int64)
            # with what earlier parts joined
            ends = [np.append(np.arange(len(start)), np.searchsorted(start, own[a + first])), np.append(np.searchsorted(start, labels), np.searchsorted(start, ids[b]))]
            labels = smallest_labels(*ends, labels)
        edges = pd.DataFrame({"id": start, "links": 0, "label": labels})
        return pd.concat([pd.DataFrame({"id": own, "links": counts, "label": own}), edges[edges["id"] != edges["label"]]])

    return nodes.unionByName(asking).groupBy("dim", "block", "turn").applyInPandas(compare, "id long, links long, label long")


def audit_recall(vectors: DataFrame, links: DataFrame, least: float, queries: int = AUDIT_QUERIES) -> float:
    """Mean share of their links that were found for about ``queries`` vectors; ``links``: id, links. Compared with all vectors.

    Half of the queries are taken among vectors with links, which few vectors may have. Each query with links weighs the
    same, so that the many links of a dense group do not hide what is lost elsewhere.
    """
    total = max(1, links.count())
    some = max(1, links.where("links > 0").count())
    draw = lambda rows, have: rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_003)) < min(1.0, queries / 2 / have) * 1_000_003)
    chosen = draw(links, total).union(draw(links.where("links > 0"), some)).dropDuplicates(["id"])
    asked = vectors.join(F.broadcast(chosen), "id").select("id", "dim", "v", "links").toPandas()
    if asked.empty:
        return 1.0
    sent = vectors.sparkSession.sparkContext.broadcast({dim: (_matrix(own["v"]), own["id"].to_numpy()) for dim, own in asked.groupby("dim")})

    def count(frames):
        there = {dim: np.zeros(len(ids), dtype=np.int64) for dim, (_, ids) in sent.value.items()}
        for frame in frames:
            for dim, own in frame.groupby("dim"):
                if dim in there:
                    x, ids = sent.value[dim]
                    there[dim] += ((x @ _matrix(own["v"]).T >= least) & (ids[:, None] != own["id"].to_numpy())) @ own["copies"].to_numpy()
        for dim, n in there.items():
            yield pd.DataFrame({"id": sent.value[dim][1], "n": n})

    there = dict(vectors.select("id", "dim", "v", "copies").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect())  # the queries
    shares = [found / there[i] for i, found in zip(asked["id"].tolist(), asked["links"].tolist()) if there.get(i)]
    return float(np.mean(shares)) if shares else 1.0


def near_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", least: float = LEAST) -> DataFrame:
    """id, n_links, component_id, kept for every row.

    ``rows``: a whole-number id and an array of numbers; other columns are not read. Vectors that are null, empty or zero
    or hold null or non-finite numbers link with nothing, nor do vectors of different lengths. Equal vectors are searched
    once and count each other as links. Ids are expected to be unique; a null id is left out of all links; an empty table
    gives an empty result. kept is true for the smallest id of a component.
    """
    spark = rows.sparkSession
    vectors = stage_table(unit_vectors(rows.where(F.col(id_column).isNotNull()), id_column, vector_column), "vectors")
    folded = vectors.groupBy("dim", "v").agg(F.min("id").alias("head"), F.count("*").alias("copies"))
    folded = stage_table(folded, "folded")
    heads = folded.select(F.col("head").alias("id"), "dim", "v", "copies")
    overlap, beam = OVERLAP, BEAM
    for _ in range(WIDENED + 1):
        found = stage_table(find_links(heads, overlap, beam, least), "found")
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        if audit_recall(heads, links, least) >= RECALL:
            break
        overlap, beam = overlap + 1, beam * 2
    else:
        found = stage_table(exact_links(heads, least), "found")
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
    return _result(rows.select(F.col(id_column).alias("id")), vectors, folded, found, links)


def _result(ids: DataFrame, vectors: DataFrame, folded: DataFrame, found: DataFrame, links: DataFrame) -> DataFrame:
    grouped = components(found.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b")))
    heads = folded.select("dim", "v", "head", "copies").join(links.withColumnRenamed("id", "head"), "head", "left").join(grouped.withColumnRenamed("node", "head"), "head", "left")
    own = vectors.join(heads, ["dim", "v"]).select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "head").alias("component"))
    done = ids.join(own, "id", "left")
    component = F.coalesce("component", "id")
    return done.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


LINK_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {LEAST}),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id <= coalesce(low, vec_id) AS kept
FROM v LEFT JOIN lowest ON lowest.a = vec_id LEFT JOIN degree ON degree.a = vec_id"""


@query("op4_near_vectors", LINK_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings, whatever their labels."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
