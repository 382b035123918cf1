"""Search projection, readiness, hybrid retrieval and nearest neighbours for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import fixed as V
from ..functions.embeddings import feature_hash
from ..functions.joins import join_checked
from ..functions.text import section_content_hash, token_set, tokens
from ..session import stage_table
from .controls import mapping_id

# A search stays inside a tenant and an embedding model.
SCOPE = ["organization_id", "embedding_model_id"]
# Queries and sections of a scope that meet as one block.
QUERY_BLOCK, SECTION_BLOCK = 512, 1024
# Blocks of queries, and pivots of scopes, that are replicated at most; some hundred KB each.
REPLICATED_BLOCKS, REPLICATED_SCOPES = 128, 64


def index_sections(sections: DataFrame, index: DataFrame, model: str = V.EMBEDDING_MODEL) -> DataFrame:
    """Index rows missing for this model: hash, searchable text and embedding of each section."""
    done = index.where(F.col("embedding_model_id") == model).select("section_id")
    pending = sections.join(done, "section_id", "left_anti").select(
        "organization_id", "regulation_id", "version_id", "section_id",
        section_content_hash("heading", "body").alias("content_hash"),
        F.concat("heading", F.lit("\n"), "body").alias("searchable_text"),
        F.lit(model).alias("embedding_model_id"),
    )
    return pending.withColumn("embedding", feature_hash("searchable_text"))


def index_counts(sections: DataFrame, index: DataFrame, model: str = V.EMBEDDING_MODEL) -> DataFrame:
    """Per version: how many sections would be created and how many exist."""
    done = index.where(F.col("embedding_model_id") == model).select("section_id", F.lit(1).alias("done"))
    return sections.join(done, "section_id", "left").groupBy("version_id").agg(
        F.count_if(F.col("done").isNull()).alias("created"), F.count("done").alias("existing")
    )


def search_readiness(sections: DataFrame, index: DataFrame, model: str = V.EMBEDDING_MODEL) -> DataFrame:
    """Per organization: ready, unavailable, incomplete or inconsistent, with the counts behind it."""
    canonical = sections.select(
        "organization_id", "section_id", F.col("version_id").alias("c_version"), F.col("regulation_id").alias("c_regulation"),
        section_content_hash("heading", "body").alias("c_hash"), F.lit(1).alias("c"),
    )
    indexed = index.where(F.col("embedding_model_id") == model).select(
        "organization_id", "section_id", "version_id", "regulation_id", "content_hash", F.lit(1).alias("i")
    )
    agrees = (
        F.col("i").isNotNull()
        & (F.col("version_id") == F.col("c_version"))
        & (F.col("regulation_id") == F.col("c_regulation"))
        & (F.col("content_hash") == F.col("c_hash"))
    )
    return (
        canonical.join(indexed, ["organization_id", "section_id"], "full_outer")
        .groupBy("organization_id")
        .agg(
            F.count("c").alias("sections"),
            F.count("i").alias("indexed"),
            F.count_if(F.col("c").isNotNull() & ~F.coalesce(agrees, F.lit(False))).alias("mismatched"),
        )
        .withColumn(
            "readiness",
            F.when(F.col("sections") == 0, "unavailable")
            .when(F.col("indexed") != F.col("sections"), "incomplete")
            .when(F.col("mismatched") > 0, "inconsistent")
            .otherwise("ready"),
        )
    )


def scoped(df: DataFrame, model: str = V.EMBEDDING_MODEL) -> DataFrame:
    """The frame with the columns of SCOPE; one that names no model is of the default one."""
    return df if "embedding_model_id" in df.columns else df.withColumn("embedding_model_id", F.lit(model))


def _best(scores: np.ndarray, ids: np.ndarray, limit: int) -> np.ndarray:
    """Positions of the ``limit`` best scores; equal scores go by id."""
    if len(scores) > limit:
        floor = np.partition(scores, len(scores) - limit)[len(scores) - limit]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:limit]]


def _units(column: pa.Array, dimensions: int | None = None) -> np.ndarray:
    """Vectors of length one as a matrix; a missing or empty one is zero, which is near nothing."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    dimensions = int(sizes.max(initial=0)) if dimensions is None else dimensions
    matrix, flat = np.zeros((len(column), dimensions)), pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    full = sizes == dimensions
    if dimensions:
        matrix[full] = flat[np.repeat(full, sizes)].reshape(-1, dimensions)
    norms = np.linalg.norm(matrix, axis=1)[:, None]
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def packed_sections(index: DataFrame, fields: list[str]) -> DataFrame:
    """SCOPE and ``rows``: the rows of a task, some hundreds of a scope in one array. Nothing is shuffled."""
    rows = index.select(*SCOPE, F.struct(*fields).alias("row"))
    kind = T.StructType([*rows.schema.fields[:2], T.StructField("rows", T.ArrayType(rows.schema["row"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for scope in table.select(SCOPE).group_by(SCOPE).aggregate([]).to_pylist():
                if None in scope.values():
                    continue  # belongs to no one
                own = table.filter(pc.and_(*[pc.equal(table[c], v) for c, v in scope.items()]))["row"].combine_chunks()
                for low in range(0, len(own), SECTION_BLOCK):
                    part = own.slice(low, SECTION_BLOCK)
                    packed = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays([part]))
                    yield pa.RecordBatch.from_arrays([*[pa.array([scope[c]]) for c in SCOPE], packed], [*SCOPE, "rows"])

    return rows.mapInArrow(run, kind)


def packed_queries(queries: DataFrame) -> DataFrame:
    """SCOPE, block and ``queries``: about QUERY_BLOCK queries of a scope in one array. Their number is not bounded."""
    counts = queries.groupBy(*SCOPE).agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    return (
        queries.join(counts, SCOPE)
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
        .groupBy(*SCOPE, "block")
        .agg(F.collect_list(F.struct("query_id", "hashes", "embedding")).alias("queries"))
    )


class _Asked:
    """A block of queries, and the best sections that a task has found for them so far."""

    def __init__(self, queries: pa.StructArray, limit: int, lexical_weight: float, vector_weight: float):
        self.ids, self.limit = queries.field("query_id"), limit
        self.weights, self.units = (lexical_weight, vector_weight), _units(queries.field("embedding"))
        hashes = queries.field("hashes")
        self.sizes = np.maximum(pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False), 1)
        token, owner = pc.list_flatten(hashes).to_numpy(zero_copy_only=False), pc.list_parent_indices(hashes).to_numpy(zero_copy_only=False)
        self.vocabulary, place = np.unique(token, return_inverse=True)
        order = np.argsort(place, kind="stable")
        self.owner, self.first = owner[order], np.searchsorted(place[order], np.arange(len(self.vocabulary) + 1))
        self.best: list = [None] * len(self.ids)
        self.floor = np.full(len(self.ids), -np.inf)

    def score(self, rows: pa.StructArray) -> None:
        ids = rows.field("section_id").to_numpy(zero_copy_only=False)
        ids = ids.astype(str) if ids.dtype == object else ids
        vectors = _units(rows.field("embedding"), self.units.shape[1])
        hashes = rows.field("hashes")
        token, row = pc.list_flatten(hashes).to_numpy(zero_copy_only=False), pc.list_parent_indices(hashes).to_numpy(zero_copy_only=False)
        place = np.minimum(np.searchsorted(self.vocabulary, token), max(len(self.vocabulary) - 1, 0))
        met = self.vocabulary[place] == token if len(self.vocabulary) else np.zeros(len(token), dtype=bool)
        place, row = place[met], row[met]
        alive = np.flatnonzero(self._bounds(vectors, np.unique(place)) >= self.floor)
        if not len(alive):
            return
        # a row for each (section, token, query) of the block that meet, added up; columns of queries that are out are not used
        times = self.first[place + 1] - self.first[place]
        at = np.repeat(self.first[place] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        shared = np.bincount(np.repeat(row, times) * len(self.ids) + self.owner[at], minlength=len(ids) * len(self.ids)).reshape(len(ids), -1)
        lexical = shared[:, alive] / self.sizes[alive]
        vector = vectors @ self.units[alive].T
        if self.weights[0]:
            vector = np.maximum(vector, 0.0)
        scores = np.round(self.weights[0] * lexical + self.weights[1] * vector, 9)
        for j in np.flatnonzero((scores >= self.floor[alive]).any(axis=0)).tolist():
            q, pick = int(alive[j]), _best(scores[:, j], ids, self.limit)
            found = scores[pick, j], ids[pick], lexical[pick, j], vector[pick, j]
            if self.best[q] is not None:
                found = tuple(np.concatenate(x) for x in zip(self.best[q], found))
                order = _best(found[0], found[1], self.limit)
                found = tuple(x[order] for x in found)
            self.best[q] = found
            if len(found[0]) == self.limit:
                self.floor[q] = found[0].min()

    def _bounds(self, vectors: np.ndarray, present: np.ndarray) -> np.ndarray:
        """The score that no section of the block exceeds: tokens the block has, and the angle from the block's middle."""
        times = self.first[present + 1] - self.first[present]
        held = np.repeat(self.first[present] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        lexical = np.bincount(self.owner[held], minlength=len(self.ids)) / self.sizes
        real = vectors[np.abs(vectors).sum(axis=1) > 0]
        nearest = np.zeros(len(self.ids))
        if len(real):
            middle = real.mean(axis=0)
            middle /= max(np.linalg.norm(middle), 1e-12)
            nearest = np.cos(np.maximum(_angles(self.units @ middle) - _angles(real @ middle).max(), 0.0))
            if len(real) < len(vectors):
                nearest = np.maximum(nearest, 0.0)
        return self.weights[0] * lexical + self.weights[1] * (np.maximum(nearest, 0.0) if self.weights[0] else nearest) + 2e-9

    def results(self, scope: dict) -> Iterator[pa.RecordBatch]:
        for q, found in enumerate(self.best):
            if found is not None:
                score, ids, lexical, vector = found
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([v] * n) for v in scope.values()], pa.concat_arrays([self.ids.slice(q, 1)] * n), pa.array(ids), pa.array(score), pa.array(lexical), pa.array(vector)],
                    [*scope, "query_id", "section_id", "score", "lexical_score", "vector_score"],
                )


def _search(pairs: DataFrame, like: tuple, limit: int, lexical_weight: float, vector_weight: float) -> DataFrame:
    """Rows with ``rows`` and ``queries`` of a scope, scored as matrix products; ``limit`` rows a query leave a task.

    A task keeps the best of each query block while it goes through its sections, so a block of sections whose bound is
    below a query's worst kept score is not scored for it.
    """
    query_type, section_type = like
    text = T.StringType()
    schema = T.StructType([
        *[T.StructField(c, text) for c in SCOPE], T.StructField("query_id", query_type), T.StructField("section_id", section_type),
        *[T.StructField(n, T.DoubleType()) for n in ("score", "lexical_score", "vector_score")],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[tuple, _Asked] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(c)[i].as_py() for c in (*SCOPE, "block"))
                if key not in asked:
                    if len(asked) >= 64:  # what is found so far leaves, later blocks begin anew
                        for (org, model, _), block in asked.items():
                            yield from block.results(dict(zip(SCOPE, (org, model))))
                        asked.clear()
                    asked[key] = _Asked(batch.column("queries")[i].values, limit, lexical_weight, vector_weight)
                asked[key].score(batch.column("rows")[i].values)
        for (org, model, _), block in asked.items():
            yield from block.results(dict(zip(SCOPE, (org, model))))

    return pairs.select(*SCOPE, "block", "queries", "rows").mapInArrow(run, schema)


def ranked(matches: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy(*SCOPE, "query_id").orderBy(F.desc("score"), "section_id")
    return matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def top_matches(index: DataFrame, queries: DataFrame, limit: int, lexical_weight: float, vector_weight: float) -> DataFrame:
    """SCOPE, query_id, section_id, score, lexical_score, vector_score, rank: the best ``limit`` sections of every query.

    ``index``: organization_id, section_id, searchable_text, embedding; ``queries``: organization_id, query_id, query,
    embedding; both may name an embedding_model_id. A query sees the sections of its own tenant and model only. Sections
    and queries meet as blocks, in one scan of the index whatever the number of queries, so no (section, query) pair is
    ever a row. Scopes are few, so the index is not dealt out by them: up to REPLICATED_BLOCKS blocks of queries are
    replicated, more meet the sections under a salt. Scores are rounded to 9 digits before they
    are ranked, so that equal vectors tie whatever their block. Blank queries are refused and have no rows.
    """
    words = (lambda text: _hashes(token_set(text))) if lexical_weight else (lambda text: F.array().cast("array<bigint>"))
    asked = scoped(queries).where(F.length(F.trim("query")) > 0) if "query" in queries.columns else scoped(queries)
    asked = asked.select(*SCOPE, "query_id", words("query").alias("hashes"), "embedding")
    sections = packed_sections(scoped(index).select(*SCOPE, "section_id", words("searchable_text").alias("hashes"), "embedding"), ["section_id", "hashes", "embedding"])
    pairs = join_checked(sections, stage_table(packed_queries(asked), "query-blocks"), SCOPE, max_rows=REPLICATED_BLOCKS)
    like = queries.schema["query_id"].dataType, index.schema["section_id"].dataType
    return ranked(_search(pairs, like, limit, lexical_weight, vector_weight), limit)


def hybrid_search(index: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Weighted search: half token coverage of the query, half cosine."""
    return top_matches(index, queries, limit, 0.5, 0.5)


def vector_index(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, pivots): vectors of a scope dealt to their nearest pivot, in blocks that are rings around it.

    About the square root of a scope's vectors are pivots, chosen by a hash of their ids. A block has at most SECTION_BLOCK
    vectors of one cell with neighbouring angles from the pivot, the lowest and the highest of which it states. Vectors
    without a length are cell -1. Blocks are written to the shared folder.
    """
    vectors = scoped(index).select(*SCOPE, "section_id", "embedding", F.array().cast("array<bigint>").alias("hashes"), F.xxhash64("section_id").alias("hash"))
    has_length = F.exists(F.coalesce("embedding", F.array().cast("array<float>")), lambda x: x != 0)
    counts = vectors.where(has_length).groupBy(*SCOPE).agg(F.sqrt(F.count("*")).cast("bigint").alias("step"), F.min("hash").alias("first"))
    chosen = vectors.where(has_length).join(counts, SCOPE).where((F.pmod("hash", "step") == 0) | (F.col("hash") == F.col("first")))
    pivots = chosen.groupBy(*SCOPE).agg(F.sort_array(F.collect_list(F.struct("hash", "embedding"))).alias("p")).select(*SCOPE, F.col("p.embedding").alias("pivots"))
    pivots = stage_table(pivots, "vector-pivots")
    fields = ["section_id", "hashes", "embedding"]
    section = T.StructType([vectors.schema[c] for c in fields])
    dealt = T.StructType([*[T.StructField(c, T.StringType()) for c in SCOPE], T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("row", section)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, centres = batch.column("rows")[i].values, batch.column("pivots")[i].values
                n = len(rows)
                centres = _units(centres) if centres is not None else np.zeros((0, 1))
                units = _units(rows.field("embedding"), centres.shape[1])
                cosines = units @ centres.T if len(centres) else np.zeros((n, 1))
                cell = np.where(np.abs(units).sum(axis=1) > 0, cosines.argmax(axis=1), -1).astype(np.int32)
                scope = [pa.array([batch.column(c)[i].as_py()] * n) for c in SCOPE]
                yield pa.RecordBatch.from_arrays([*scope, pa.array(cell), pa.array(_angles(cosines.max(axis=1))), pa.concat_arrays([rows])], [*SCOPE, "cell", "angle", "row"])

    def rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in (*SCOPE, "cell")]))
            angles, low = batch.column("angle").to_numpy(), 0
            while low < len(keys):
                high = low + 1
                while high < len(keys) and keys[high] == keys[low] and high - low < SECTION_BLOCK:
                    high += 1
                rows = pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), pa.concat_arrays([batch.column("row").slice(low, high - low)]))
                values = [*keys[low], angles[low], angles[high - 1], high - low]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([v], t) for v, t in zip(values, (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32()))], rows],
                    [*SCOPE, "cell", "low", "high", "n", "rows"],
                )
                low = high

    assigned = join_checked(packed_sections(vectors, fields), pivots, SCOPE, "left", REPLICATED_SCOPES).select(*SCOPE, "rows", "pivots").mapInArrow(assign, dealt)
    # a cell with very many vectors is dealt to several tasks
    ordered = assigned.repartition(*SCOPE, "cell", F.pmod(F.xxhash64("row.section_id"), F.lit(8))).sortWithinPartitions(*SCOPE, "cell", "angle")
    ring = T.StructType([*dealt.fields[:3], *[T.StructField(c, k) for c, k in (("low", T.DoubleType()), ("high", T.DoubleType()), ("n", T.IntegerType()))], T.StructField("rows", T.ArrayType(section))])
    blocks = ordered.mapInArrow(rings, ring).withColumn("ring", F.concat_ws("/", *SCOPE, "cell", F.monotonically_increasing_id()))
    return stage_table(blocks, "vector-blocks"), pivots


def nearest_neighbours(index: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """SCOPE, query_id, section_id, score, rank, compared: exact cosine neighbours of each query vector in its tenant and model.

    A query first searches the blocks that its angles from the pivots call nearest, until they have ``limit`` vectors. The
    worst of these is a floor: of the other blocks only those are searched that can have something above it, as the angle
    between a query and a vector is at least the difference of their angles from the pivot. ``compared`` is the number of
    vectors that the query was compared with.
    """
    blocks, pivots = vector_index(index)
    asked = stage_table(scoped(queries).select(*SCOPE, "query_id", F.array().cast("array<bigint>").alias("hashes"), "embedding"), "vector-queries")
    like = queries.schema["query_id"].dataType, index.schema["section_id"].dataType
    met = T.StructType([*[T.StructField(c, T.StringType()) for c in SCOPE], T.StructField("query_id", like[0]), T.StructField("angles", T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, centres = batch.column("queries")[i].values, _units(batch.column("pivots")[i].values)
                units = _units(own.field("embedding"), centres.shape[1])
                angles = np.where(np.abs(units).sum(axis=1)[:, None] > 0, _angles(units @ centres.T), np.pi / 2)
                scope = [pa.array([batch.column(c)[i].as_py()] * len(own)) for c in SCOPE]
                yield pa.RecordBatch.from_arrays([*scope, pa.concat_arrays([own.field("query_id")]), pa.array(list(angles), pa.list_(pa.float64()))], [*SCOPE, "query_id", "angles"])

    angles = packed_queries(asked).join(pivots, SCOPE).select(*SCOPE, "queries", "pivots").mapInArrow(measure, met)
    own = F.get("angles", F.col("cell"))
    apart = F.greatest(F.lit(0.0), own - F.col("high"), F.col("low") - own)
    lengthless = ~F.exists(F.coalesce("embedding", F.array().cast("array<float>")), lambda x: x != 0)  # is as near to all: 0
    bounds = stage_table(
        asked.join(blocks.drop("rows"), SCOPE).join(angles, [*SCOPE, "query_id"], "left")
        .select(*SCOPE, "query_id", "ring", "n", F.when(lengthless | (F.col("cell") < 0), 0.0).otherwise(F.cos(apart)).alias("bound")),
        "vector-bounds",
    )
    nearest = Window.partitionBy(*SCOPE, "query_id").orderBy(F.desc("bound"), "ring").rowsBetween(Window.unboundedPreceding, -1)
    staged = bounds.withColumn("first", F.coalesce(F.sum("n").over(nearest), F.lit(0)) < limit)
    found = stage_table(_search_rings(staged.where("first"), asked, blocks, like, limit), "vector-first")
    floor = found.groupBy(*SCOPE, "query_id").agg(F.count("*").alias("held"), F.min("score").alias("floor"))
    can = (F.coalesce("held", F.lit(0)) < limit) | (F.col("bound") >= F.col("floor") - 2e-9)
    searched = staged.join(floor, [*SCOPE, "query_id"], "left").where(F.col("first") | can)
    compared = searched.groupBy(*SCOPE, "query_id").agg(F.sum("n").alias("compared"))
    both = found.union(_search_rings(searched.where(~F.col("first")), asked, blocks, like, limit))
    return ranked(both, limit).drop("lexical_score", "vector_score").join(compared, [*SCOPE, "query_id"])


def _search_rings(wanted: DataFrame, asked: DataFrame, blocks: DataFrame, like: tuple, limit: int) -> DataFrame:
    """The best of the wanted (query, ring) pairs: queries of a ring are packed, QUERY_BLOCK or so at once, and meet it."""
    counts = wanted.groupBy("ring").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts"))
    named = wanted.select(*SCOPE, "query_id", "ring").join(counts, "ring").join(asked, [*SCOPE, "query_id"])
    packed = named.groupBy("ring", F.pmod(F.xxhash64("query_id"), "parts").alias("part")).agg(F.collect_list(F.struct("query_id", "hashes", "embedding")).alias("queries"))
    pairs = packed.join(blocks, "ring").withColumn("block", F.concat_ws("#", "ring", "part"))
    return ranked(_search(pairs, like, limit, 0.0, 1.0), limit).drop("rank")


def lexical_matches(index: DataFrame, queries: DataFrame, depth: int = V.RRF_DEPTH) -> DataFrame:
    """SCOPE, query_id, section_id, rank of the sections that hold *every* token of a query, best tf-idf first.

    Postings of the queries' tokens are made once and written; a token's frequency is that in its tenant and model.
    Candidates come from the rarest token of each query alone, so a frequent word never pairs the whole corpus with the
    query batch; the other tokens are then looked up for those candidates.
    """
    index, one = scoped(index), [*SCOPE, "query_id"]
    wanted = stage_table(scoped(queries).select(*one, F.explode(token_set("query")).alias("token")), "query-tokens")
    size = wanted.groupBy(*one).agg(F.count("*").alias("query_tokens"))
    words = wanted.select(*SCOPE, "token").distinct()
    held = index.select(*SCOPE, "section_id", F.explode(tokens("searchable_text")).alias("token"))
    postings = stage_table(held.join(words, [*SCOPE, "token"], "left_semi").groupBy(*SCOPE, "section_id", "token").agg(F.count("*").alias("tf")), "postings")
    frequency = postings.groupBy(*SCOPE, "token").agg(F.count("*").alias("df"))
    corpus = index.groupBy(*SCOPE).agg(F.count("*").alias("n"))
    weighted = stage_table(wanted.join(frequency, [*SCOPE, "token"], "left").join(corpus, SCOPE), "query-weights")
    rarest = weighted.groupBy(*one).agg(F.min(F.struct("df", "token")).alias("least"), F.count_if(F.col("df").isNull()).alias("absent")).where("absent = 0")
    candidates = postings.join(rarest.select(*one, F.col("least.token").alias("token")), [*SCOPE, "token"]).select(*one, "section_id")
    idf = weighted.select(*one, "token", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
    hits = (
        candidates.join(idf, one)
        .join(postings, [*SCOPE, "section_id", "token"])
        .groupBy(*one, "section_id")
        .agg(F.count("*").alias("held"), F.round(F.sum(F.col("tf") * F.col("idf")), 6).alias("lexical"))
        .join(size, one)
        .where("held = query_tokens")
    )
    order = Window.partitionBy(*one).orderBy(F.desc("lexical"), "section_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth).select(*one, "section_id", "rank")


def reciprocal_rank_fusion(index: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Fuse both rankings of a tenant and model: each arm keeps 50 and gives 1 / (60 + rank)."""
    one = [*SCOPE, "query_id"]
    gain = lambda c: F.coalesce(1.0 / (V.RRF_K + F.col(c)), F.lit(0.0))
    lexical = lexical_matches(index, queries).withColumnRenamed("rank", "l")
    vector = top_matches(index, queries, V.RRF_DEPTH, 0.0, 1.0).select(*one, "section_id", F.col("rank").alias("v"))
    fused = lexical.join(vector, [*one, "section_id"], "full_outer").select(
        *one, "section_id", F.round(gain("l") + gain("v"), 9).alias("score"), gain("l").alias("lexical_score"), gain("v").alias("vector_score"),
    )
    return ranked(fused, limit)


def hydrate(hits: DataFrame, sections: DataFrame, version_rows: DataFrame, max_chars: int = 4000) -> DataFrame:
    """Hits with their section, version lineage and a body cut to ``max_chars`` with a flag."""
    own = "organization_id"  # a hit sees its own tenant's section
    return (
        hits.join(sections, [own, "section_id"])
        .join(version_rows.select("version_id", "source_uri", F.col("content_hash").alias("version_content_hash")), "version_id")
        .withColumn("section_content_hash", section_content_hash("heading", "body"))
        .withColumn("body_truncated", F.length("body") > max_chars)
        .withColumn("body", F.substring("body", 1, max_chars))
    )


def canonical_evidence(
    requests: DataFrame, sections: DataFrame, version_rows: DataFrame, obligations: DataFrame, mappings: DataFrame | None = None
) -> DataFrame:
    """Requested sections whose section hash and version hash both match, with counts and ids of what cites them.

    ``requests``: organization_id, section_id, version_id, version_content_hash, section_hash. A section has a
    bounded number of statements, so ids may be gathered per section. Without ``mappings`` the obligations carry their
    ``candidates`` (see ``controls.with_candidates``), and their ids are hex digits.
    """
    # Requests are narrow: hashes travel as 128 bits, and only the requests that hold are joined to the sections' texts.
    short = lambda c: F.unhex(F.md5(c))
    key = ["organization_id", "section_id", "version_id"]
    held = version_rows.select("version_id", short("content_hash").alias("actual_version"))
    asked = requests.withColumns({"__version": short("version_content_hash"), "__section": short("section_hash")})
    current = asked.join(held, "version_id").where(F.col("actual_version") == F.col("__version")).drop("actual_version", "__version")
    actual = sections.withColumn("__actual", short(section_content_hash("heading", "body")))
    found = current.join(actual, key).where(F.col("__actual") == F.col("__section")).drop("__actual", "__section")
    if mappings is None:
        return _with_citations(found, obligations)
    wanted = obligations.join(found.select("section_id"), "section_id", "left_semi")
    cited = wanted.groupBy("section_id").agg(F.sort_array(F.collect_list("obligation_id")).alias("obligation_ids"))
    mapped = (
        mappings.select("obligation_id", "mapping_id", "status")
        .join(wanted.select("obligation_id", "section_id"), "obligation_id")
        .groupBy("section_id")
        .agg(F.sort_array(F.collect_list(F.struct("mapping_id", "obligation_id", "status"))).alias("control_mappings"))
    )
    return found.join(cited, "section_id", "left").join(mapped, "section_id", "left")


def _with_citations(found: DataFrame, obligations: DataFrame) -> DataFrame:
    """Add obligation_ids and control_mappings from obligations that carry their candidates: one shuffle of them.

    A mapping's id is made of what the row holds anyway, after the shuffle. Nothing is null here but what nothing cites.
    """
    candidate = lambda c: F.struct(c["control_version_id"].alias("control"), c["status"].alias("status"))
    narrow = obligations.select("section_id", F.unhex("obligation_id").alias("id"), F.transform("candidates", candidate).alias("of"))
    cited = narrow.groupBy("section_id").agg(F.collect_list(F.struct("id", F.coalesce("of", F.array()).alias("of"))).alias("__cited"))
    name = lambda o: F.lower(F.hex(o["id"]))
    mapped = F.flatten(F.transform("__cited", lambda o: F.transform(o["of"], lambda c: F.struct(
        mapping_id(name(o), c["control"]).alias("mapping_id"), name(o).alias("obligation_id"), c["status"].alias("status")))))
    mapped = F.sort_array(mapped)
    return (
        found.join(cited, "section_id", "left")
        .withColumn("obligation_ids", F.sort_array(F.transform("__cited", name)))
        .withColumn("control_mappings", F.when(F.size(mapped) > 0, mapped))
        .drop("__cited")
    )
