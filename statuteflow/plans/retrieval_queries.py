"""E: search over documents with their vectors; the benchmark passages are the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.text import section_content_hash
from ..operators import controls as C
from ..operators import obligations as D
from ..operators import retrieval as E
from ..session import stage_table
from . import inputs as I
from . import sql as S
from .registry import query
from .text_queries import label_centroids


def tenant(column):
    """Every other row belongs to the second tenant."""
    return F.concat(F.lit("org-"), (F.col(column) % 2).cast("string")).alias("organization_id")


def both_tenants():
    return F.explode(F.array(F.lit("org-0"), F.lit("org-1"))).alias("organization_id")


def search_index(spark, d):
    vectors = I.table(spark, d, "embeddings").select(F.col("vec_id").alias("section_id"), "embedding")
    return I.table(spark, d, "documents").select(
        tenant("doc_id"), F.col("doc_id").alias("section_id"), F.col("text").alias("searchable_text")
    ).join(vectors, "section_id", "left")


def search_queries(spark, d):
    """Both tenants ask for every item."""
    vectors = I.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return I.table(spark, d, "benchmark").select(
        both_tenants(), F.col("item_id").alias("query_id"), F.col("text").alias("query")
    ).join(vectors, "query_id", "left")


SEARCH_SQL = f"""
orgs AS (SELECT unnest(['org-0', 'org-1']) AS organization_id),
idx AS (SELECT 'org-' || (doc_id % 2) AS organization_id, doc_id AS section_id, text AS searchable_text, embedding::DOUBLE[] AS v FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
qry AS (SELECT organization_id, item_id AS query_id, text AS query, embedding::DOUBLE[] AS v FROM benchmark CROSS JOIN orgs LEFT JOIN embeddings ON item_id = vec_id),
idx_t AS (SELECT *, {S.token_set('searchable_text')} AS t FROM idx), qry_t AS (SELECT *, {S.token_set('query')} AS t FROM qry),
cosines AS (SELECT organization_id, q.query_id, s.section_id, coalesce(list_cosine_similarity(s.v, q.v), 0) AS cos FROM idx s JOIN qry q USING (organization_id))"""


@query(
    "e2_search_readiness",
    f"""WITH {I.RULE_BOOK_SQL},
    i AS (SELECT organization_id, section_id, version_id, sha256(heading || chr(10) || CASE WHEN organization_id = 'org-2' AND template_no = 3 THEN 'x' ELSE body END) AS h
      FROM (SELECT *, position % 6 AS template_no FROM rsections) WHERE NOT (organization_id = 'org-1' AND template_no = 5))
    SELECT s.organization_id, count(*) AS sections, count(i.section_id) AS indexed,
      count(*) FILTER (i.h IS NULL OR i.h <> sha256(s.heading || chr(10) || s.body)) AS mismatched,
      CASE WHEN count(i.section_id) <> count(*) THEN 'incomplete'
        WHEN count(*) FILTER (i.h <> sha256(s.heading || chr(10) || s.body)) > 0 THEN 'inconsistent' ELSE 'ready' END AS readiness
    FROM rsections s LEFT JOIN i USING (organization_id, section_id) GROUP BY 1""",
)
def e2(spark, d):
    sections = I.rule_book(spark, d)
    kind = F.col("position") % 6
    body = F.when((F.col("organization_id") == "org-2") & (kind == 3), "x").otherwise(F.col("body"))
    index = sections.where(~((F.col("organization_id") == "org-1") & (kind == 5))).select(
        "organization_id", "section_id", "version_id", "regulation_id",
        section_content_hash("heading", body).alias("content_hash"), F.lit(V.EMBEDDING_MODEL).alias("embedding_model_id"),
    )
    return E.search_readiness(sections, index)


@query("e1_index_sections", f"""WITH {I.RULE_BOOK_SQL} SELECT section_id, sha256(heading || chr(10) || body) AS content_hash, 384 AS dimensions
    FROM rsections WHERE ordinal > 5""")
def e1(spark, d):
    sections = I.rule_book(spark, d)
    index = sections.where("ordinal <= 5").select("section_id", F.lit(V.EMBEDDING_MODEL).alias("embedding_model_id"))
    return E.index_sections(sections, index).select("section_id", "content_hash", F.size("embedding").alias("dimensions"))


@query(
    "e1_index_counts",
    f"""WITH {I.RULE_BOOK_SQL} SELECT version_id, count(*) FILTER (ordinal > 5) AS created, count(*) FILTER (ordinal <= 5) AS existing
    FROM rsections GROUP BY 1""",
)
def e1_counts(spark, d):
    sections = I.rule_book(spark, d)
    index = sections.where("ordinal <= 5").select("section_id", F.lit(V.EMBEDDING_MODEL).alias("embedding_model_id"))
    return E.index_counts(sections, index)


_HYBRID = f"""{SEARCH_SQL},
pairs AS (SELECT organization_id, q.query_id, s.section_id, len(list_intersect(q.t, s.t))::DOUBLE / len(q.t) AS lexical FROM idx_t s JOIN qry_t q USING (organization_id)),
sc AS (SELECT p.*, greatest(c.cos, 0) AS vector, round(0.5::DOUBLE * lexical + 0.5::DOUBLE * greatest(c.cos, 0), 9) AS score
  FROM pairs p JOIN cosines c USING (organization_id, query_id, section_id)),
hits AS (SELECT *, row_number() OVER (PARTITION BY organization_id, query_id ORDER BY score DESC, section_id) AS rank FROM sc QUALIFY rank <= 10)"""


@query(
    "e3_hybrid_search",
    f"""WITH {_HYBRID} SELECT organization_id, query_id, section_id, rank, round(score, 6) AS score, round(lexical, 6) AS lexical_score, round(vector, 6) AS vector_score
    FROM hits""",
)
def e3(spark, d):
    hits = E.hybrid_search(search_index(spark, d), search_queries(spark, d), 10)
    return hits.select(
        "organization_id", "query_id", "section_id", F.col("rank").cast("bigint").alias("rank"),
        *[F.round(c, 6).alias(c) for c in ("score", "lexical_score", "vector_score")],
    )


_LEXICAL = f"""{SEARCH_SQL},
tf AS (SELECT organization_id, section_id, token, count(*) AS tf
  FROM (SELECT organization_id, section_id, unnest({S.tokens('searchable_text')}) AS token FROM idx) GROUP BY ALL),
df AS (SELECT organization_id, token, count(*) AS df FROM tf GROUP BY ALL),
total AS (SELECT organization_id, count(*) AS total FROM idx GROUP BY ALL),
qt AS (SELECT organization_id, query_id, unnest(t) AS token, len(t) AS n FROM qry_t),
lx AS (SELECT organization_id, query_id, section_id, round(sum(tf * ln(1 + total / df)), 6) AS lexical
  FROM qt JOIN tf USING (organization_id, token) JOIN df USING (organization_id, token) JOIN total USING (organization_id)
  GROUP BY organization_id, query_id, section_id HAVING count(*) = max(n)),
lr AS (SELECT *, row_number() OVER (PARTITION BY organization_id, query_id ORDER BY lexical DESC, section_id) AS l FROM lx QUALIFY l <= 50)"""


@query("e4_lexical_matches", f"WITH {_LEXICAL} SELECT organization_id, query_id, section_id, l AS rank FROM lr")
def e4_lexical(spark, d):
    return E.lexical_matches(search_index(spark, d), search_queries(spark, d)).select(
        "organization_id", "query_id", "section_id", F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "e4_rank_fusion",
    f"""WITH {_LEXICAL},
    vr AS (SELECT organization_id, query_id, section_id,
      row_number() OVER (PARTITION BY organization_id, query_id ORDER BY round(cos, 9) DESC, section_id) AS v FROM cosines QUALIFY v <= 50),
    f AS (SELECT organization_id, query_id, section_id, round(coalesce(1.0::DOUBLE / (60 + l), 0) + coalesce(1.0::DOUBLE / (60 + v), 0), 9) AS score
      FROM lr FULL OUTER JOIN vr USING (organization_id, query_id, section_id))
    SELECT organization_id, query_id, section_id, score, row_number() OVER (PARTITION BY organization_id, query_id ORDER BY score DESC, section_id) AS rank FROM f QUALIFY rank <= 10""",
)
def e4(spark, d):
    return E.reciprocal_rank_fusion(search_index(spark, d), search_queries(spark, d), 10).select(
        "organization_id", "query_id", "section_id", "score", F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "e5_hydrate_hits",
    f"""WITH {_HYBRID} SELECT h.organization_id, h.query_id, h.section_id, d.source AS version_id, 'doc://' || d.source AS source_uri,
      sha256(d.lang || chr(10) || d.text) AS section_content_hash, substr(d.text, 1, 4000) AS body, length(d.text) > 4000 AS body_truncated
    FROM hits h JOIN documents d ON d.doc_id = h.section_id""",
)
def e5(spark, d):
    docs = I.table(spark, d, "documents")
    sections = docs.select(
        tenant("doc_id"), F.col("doc_id").alias("section_id"), F.col("source").alias("version_id"), F.col("lang").alias("heading"), F.col("text").alias("body")
    )
    versions = docs.select(F.col("source").alias("version_id")).distinct().select(
        "version_id", F.concat(F.lit("doc://"), "version_id").alias("source_uri"), F.sha2("version_id", 256).alias("content_hash")
    )
    hits = E.hybrid_search(search_index(spark, d), search_queries(spark, d), 10)
    return E.hydrate(hits, sections, versions).select(
        "organization_id", "query_id", "section_id", "version_id", "source_uri", "section_content_hash", "body", "body_truncated"
    )


def _evidence_sql():
    from .control_queries import MAPPINGS_SQL

    return f"""WITH {MAPPINGS_SQL},
    r AS (SELECT * FROM rsections WHERE position % 4 <> 1 AND position % 6 <> 2),
    o AS (SELECT section_id, count(*) AS n, string_agg(obligation_id, ',' ORDER BY obligation_id) AS ids FROM obligations GROUP BY 1),
    m AS (SELECT o.section_id, count(*) AS n FROM mappings m JOIN obligations o USING (obligation_id) GROUP BY 1)
    SELECT r.section_id, coalesce(o.ids, '') AS obligation_ids, coalesce(m.n, 0) AS control_mappings
    FROM r LEFT JOIN o USING (section_id) LEFT JOIN m USING (section_id)"""


@query("e6_canonical_evidence", _evidence_sql())
def e6(spark, d):
    from .control_queries import latest_controls

    sections = stage_table(I.rule_book(spark, d), "sections")  # requests, versions, obligations and the answer read them
    obligations = D.obligations_of(sections).select("organization_id", "obligation_id", "section_id", "evidence", "action")
    obligations = C.with_candidates(obligations, latest_controls(spark, d), unread=("evidence", "action"))
    versions = I.rule_versions(sections).select("version_id", F.sha2("version_id", 256).alias("content_hash"))
    # Every section is asked for; some requests carry a wrong section hash, some a wrong version hash.
    position = F.col("position")
    requests = sections.select(
        "organization_id", "section_id", "version_id",
        F.when(position % 6 == 2, "0").otherwise(F.sha2("version_id", 256)).alias("version_content_hash"),
        F.when(position % 4 == 1, "0").otherwise(section_content_hash("heading", "body")).alias("section_hash"),
    )
    found = E.canonical_evidence(requests, sections, versions, obligations)
    return found.select(
        "section_id", F.coalesce(F.array_join("obligation_ids", ","), F.lit("")).alias("obligation_ids"),
        F.coalesce(F.size("control_mappings"), F.lit(0)).cast("bigint").alias("control_mappings"),
    )


@query(
    "e7_nearest_neighbours",
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    m AS (SELECT label, i, avg(v) AS mean FROM x GROUP BY ALL), k AS (SELECT label, list(mean ORDER BY i) AS centroid FROM m GROUP BY label),
    orgs AS (SELECT unnest(['org-0', 'org-1']) AS organization_id),
    c AS (SELECT organization_id, k.label AS query_id, e.vec_id AS section_id, round(list_cosine_similarity(e.embedding::DOUBLE[], k.centroid), 9) AS score
      FROM embeddings e CROSS JOIN k CROSS JOIN orgs WHERE organization_id = 'org-' || (e.vec_id % 2))
    SELECT organization_id, query_id, section_id, round(score, 6) AS score, row_number() OVER (PARTITION BY organization_id, query_id ORDER BY score DESC, section_id) AS rank
    FROM c QUALIFY rank <= 20""",
)
def e7(spark, d):
    e = I.table(spark, d, "embeddings")
    queries = label_centroids(e).select(both_tenants(), F.col("label").alias("query_id"), F.col("centroid").alias("embedding"))
    index = e.select(tenant("vec_id"), F.col("vec_id").alias("section_id"), "embedding")
    hits = E.nearest_neighbours(index, queries, 20)
    return hits.select("organization_id", "query_id", "section_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))
