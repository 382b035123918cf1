"""C: versions and section changes over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators.obligations import obligations_of
from ..operators.versioning import latest_versions
from . import inputs as I
from . import sql as S
from .inputs import CORPUS_SQL, OBLIGATIONS_SQL
from .registry import as_text, query, text_sql


@query(
    "c1_ingest_versions",
    f"WITH {CORPUS_SQL} SELECT regulation_id, arrived, content_hash, outcome, ordinal, current_ordinal FROM ingested",
)
def c1(spark, d):
    return I.ingested(spark, d).select("regulation_id", "arrived", "content_hash", "outcome", "ordinal", "current_ordinal")


@query(
    "c2_latest_version",
    f"""WITH {CORPUS_SQL} SELECT regulation_id, ordinal, doc_id, content_hash FROM dversions
    QUALIFY row_number() OVER (PARTITION BY regulation_id ORDER BY ordinal DESC) = 1""",
)
def c2(spark, d):
    return latest_versions(I.document_versions(spark, d)).select("regulation_id", "ordinal", "doc_id", "content_hash")


@query(
    "c3_detect_changes",
    f"""WITH {CORPUS_SQL} SELECT change_id, regulation_id, ordinal, {text_sql('previous_ordinal', 'previous_page', 'current_page')},
    section_key, heading, change_type, previous_text, current_text FROM dchanges""",
)
def c3(spark, d):
    return as_text(I.document_changes(spark, d), "previous_ordinal", "previous_page", "current_page")


@query(
    "c3_change_counts",
    f"WITH {CORPUS_SQL} SELECT regulation_id, change_type, count(*) AS changes FROM dchanges GROUP BY ALL",
)
def c3_counts(spark, d):
    return I.document_changes(spark, d).groupBy("regulation_id", "change_type").agg(F.count("*").alias("changes"))


@query(
    "c4_duplicate_section_keys",
    """SELECT source AS regulation_id, 1::BIGINT AS ordinal, md5(line) AS section_key, count(*) AS copies
    FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
    GROUP BY ALL HAVING count(*) > 1""",
)
def c4(spark, d):
    # All documents of a source read as one version whose keys are the hashes of the lines: repeated lines clash.
    lines = I.table(spark, d, "documents").select(
        F.col("source").alias("regulation_id"), F.lit(1).cast("bigint").alias("ordinal"),
        F.explode(F.split("text", "\n")).alias("line"),
    )
    return C.duplicate_section_keys(lines.select("regulation_id", "ordinal", F.md5("line").alias("section_key")))


REGULATIONS_SQL = """
regulations AS (SELECT DISTINCT source AS regulation_id, 'Regulation ' || source AS title FROM documents),
juris AS (SELECT source AS regulation_id, min(lang) AS jurisdiction FROM documents GROUP BY 1)"""


def regulations(spark, d):
    return I.table(spark, d, "documents").groupBy(F.col("source").alias("regulation_id")).agg(
        F.concat(F.lit("Regulation "), F.first("source")).alias("title"), F.min("lang").alias("jurisdiction")
    )


def register(spark, d, latest_only=True):
    versions = I.document_versions(spark, d)
    found = I.document_changes(spark, d, versions)
    return C.change_register(found, regulations(spark, d), versions, latest_only)


REGISTER_SQL = f"""{CORPUS_SQL}, {REGULATIONS_SQL},
register AS (
  SELECT c.*, r.title, j.jurisdiction, v.ingested_at, v.source_uri AS current_uri, p.source_uri AS previous_uri
  FROM dchanges c JOIN regulations r USING (regulation_id) JOIN juris j USING (regulation_id)
  JOIN dversions v ON v.regulation_id = c.regulation_id AND v.ordinal = c.ordinal
  LEFT JOIN dversions p ON p.regulation_id = c.regulation_id AND p.ordinal = c.previous_ordinal)"""


@query(
    "c5_change_register",
    f"""WITH {REGISTER_SQL} SELECT change_id, regulation_id, title, jurisdiction, section_key, heading, change_type,
    {text_sql('previous_ordinal', 'previous_page', 'current_page')}, ordinal, ingested_at FROM register
    WHERE ordinal = (SELECT max(ordinal) FROM dversions x WHERE x.regulation_id = register.regulation_id)""",
)
def c5(spark, d):
    return as_text(register(spark, d), "previous_ordinal", "previous_page", "current_page").select(
        "change_id", "regulation_id", "title", "jurisdiction", "section_key", "heading", "change_type",
        "previous_ordinal", "ordinal", "previous_page", "current_page", "ingested_at",
    )


@query(
    "c5_change_register_page",
    f"""WITH {REGISTER_SQL} SELECT change_id, regulation_id, section_key, change_type, ingested_at FROM register
    ORDER BY ingested_at DESC, section_key, change_id LIMIT 100 OFFSET 20""",
)
def c5_page(spark, d):
    return C.order_register(register(spark, d, latest_only=False), 100, 20).select(
        "change_id", "regulation_id", "section_key", "change_type", "ingested_at"
    )


@query(
    "c6_change_detail",
    f"""WITH {REGISTER_SQL} SELECT change_id, regulation_id, section_key, change_type, previous_text, current_text,
    previous_ordinal::VARCHAR AS previous_version, CASE WHEN previous_ordinal IS NOT NULL THEN previous_uri END AS previous_uri,
    CASE WHEN previous_ordinal IS NOT NULL THEN previous_page END::VARCHAR AS previous_page,
    ordinal AS current_version, current_uri, current_page::VARCHAR AS current_page FROM register""",
)
def c6(spark, d):
    return C.change_detail(register(spark, d, latest_only=False)).select(
        "change_id", "regulation_id", "section_key", "change_type", "previous_text", "current_text",
        F.col("previous_citation.ordinal").cast("string").alias("previous_version"),
        F.col("previous_citation.source_uri").alias("previous_uri"),
        F.col("previous_citation.page").cast("string").alias("previous_page"),
        F.col("current_citation.ordinal").alias("current_version"),
        F.col("current_citation.source_uri").alias("current_uri"),
        F.col("current_citation.page").cast("string").alias("current_page"),
    )


@query(
    "c7_regulation_rollup",
    f"""WITH {CORPUS_SQL}, {REGULATIONS_SQL}
    SELECT r.regulation_id, r.title, max(v.ordinal) AS latest_ordinal, max(v.ingested_at) AS latest_ingested_at,
      coalesce((SELECT count(*) FROM dchanges c WHERE c.regulation_id = r.regulation_id), 0) AS total_changes,
      coalesce((SELECT count(*) FROM pages p WHERE 'src' || (p.page_id % 40) = r.regulation_id
                AND p.url LIKE 'https:%'), 0) AS monitored_sources
    FROM regulations r LEFT JOIN dversions v ON v.regulation_id = r.regulation_id GROUP BY r.regulation_id, r.title""",
)
def c7(spark, d):
    versions = I.document_versions(spark, d)
    changes = I.document_changes(spark, d, versions)
    sources = I.table(spark, d, "pages").select(
        F.concat(F.lit("src"), (F.col("page_id") % 40).cast("string")).alias("regulation_id"),
        F.col("url").startswith("https:").alias("enabled"),
    )
    return C.regulation_rollup(regulations(spark, d).drop("jurisdiction"), versions, changes, sources)


@query(
    "c8_version_rollup",
    f"""WITH {CORPUS_SQL}, s AS (SELECT regulation_id, ordinal, count(*) n FROM dsections GROUP BY ALL),
    c AS (SELECT regulation_id, ordinal, count(*) n FROM dchanges GROUP BY ALL)
    SELECT v.regulation_id, v.ordinal, v.content_hash, coalesce(s.n, 0) AS section_count,
      coalesce(c.n, 0) AS change_count
    FROM dversions v LEFT JOIN s USING (regulation_id, ordinal) LEFT JOIN c USING (regulation_id, ordinal)""",
)
def c8(spark, d):
    versions = I.document_versions(spark, d)
    sections = I.document_sections(spark, d, versions)
    changes = C.detect_changes(sections, versions.select("regulation_id", "ordinal"))
    return C.version_rollup(versions, sections, changes).select(
        "regulation_id", "ordinal", "content_hash", "section_count", "change_count"
    )


RULE_CHANGES_SQL = f"""
rversions AS (SELECT DISTINCT regulation_id, ordinal FROM rsections),
rprev AS (SELECT s.* REPLACE (s.ordinal + 1 AS ordinal) FROM rsections s
  WHERE EXISTS (SELECT 1 FROM rversions n WHERE n.regulation_id = s.regulation_id AND n.ordinal = s.ordinal + 1)),
rchanges AS (
  SELECT coalesce(o.regulation_id, n.regulation_id) AS regulation_id, coalesce(o.ordinal, n.ordinal) AS ordinal,
    coalesce(o.section_key, n.section_key) AS section_key,
    CASE WHEN o.section_key IS NULL THEN 'added' WHEN n.section_key IS NULL THEN 'removed'
         WHEN o.heading <> n.heading OR {S.strip('o.body')} <> {S.strip('n.body')} THEN 'modified' END AS change_type
  FROM rprev o FULL OUTER JOIN rsections n USING (regulation_id, ordinal, section_key))"""


@query(
    "c9_change_impact",
    f"""WITH {OBLIGATIONS_SQL}, {RULE_CHANGES_SQL},
    o AS (SELECT regulation_id, ordinal, section_key, count(*) AS n, bool_or(requires_review) AS r FROM obligations GROUP BY ALL)
    SELECT sha256(regulation_id || ':' || ordinal || ':' || section_key) AS change_id, regulation_id, ordinal, section_key,
      change_type, CASE WHEN change_type = 'removed' THEN 0 ELSE coalesce(n, 0) END AS obligations,
      change_type = 'removed' OR coalesce(r, false) AS needs_review
    FROM rchanges LEFT JOIN o USING (regulation_id, ordinal, section_key) WHERE change_type IS NOT NULL""",
)
def c9(spark, d):
    sections = I.rule_book(spark, d)
    found = C.detect_changes(sections, I.rule_versions(sections).select("regulation_id", "ordinal"))
    return C.change_impact(found, obligations_of(sections))
