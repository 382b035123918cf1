"""A: documents, sections and stores."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..session import stage_table, work_folder
from ..sources import corpus, documents, records, store
from . import inputs as I
from . import sql as S
from .registry import query

_UPLOAD_NAME = """CASE WHEN page_id % 7 = 0 THEN 'dir' || chr(92) || 'p' || page_id || '.html' WHEN page_id % 7 = 1 THEN 'a/.hidden'
  WHEN page_id % 7 = 2 THEN 'p' || page_id || '.pdf' ELSE 'in/p' || page_id || '.HTM' END"""


def uploads(spark, d):
    k, page = F.col("page_id") % 7, F.col("page_id").cast("string")
    name = (
        F.when(k == 0, F.concat(F.lit("dir\\p"), page, F.lit(".html")))
        .when(k == 1, F.lit("a/.hidden"))
        .when(k == 2, F.concat(F.lit("p"), page, F.lit(".pdf")))
        .otherwise(F.concat(F.lit("in/p"), page, F.lit(".HTM")))
    )
    return I.table(spark, d, "pages").select(
        "page_id",
        F.concat(F.lit("org-"), (F.col("page_id") % 3).cast("string")).alias("organization_id"),
        name.alias("filename"),
        F.when(k == 3, "application/pdf").when(k == 4, "text/html; charset=utf-8").alias("declared_type"),
        F.when(k == 5, F.encode(F.substring("html", 16, 1 << 30), "UTF-8")).otherwise(F.encode("html", "UTF-8")).alias("content"),
    )


_LIMIT = 4000
_ADMIT_SQL = f"""
uploads AS (SELECT page_id, {_UPLOAD_NAME} AS filename, CASE page_id % 7 WHEN 3 THEN 'application/pdf'
    WHEN 4 THEN 'text/html; charset=utf-8' END AS declared_type,
    CASE WHEN page_id % 7 = 5 THEN substr(html, 16) ELSE html END AS content FROM pages),
named AS (SELECT *, regexp_extract(replace(filename, chr(92), '/'), '([^/]*)$', 1) AS safe_name,
    CASE WHEN regexp_matches(lower(ltrim(content)), '^(<!doctype html|<html|<[?]xml)') THEN 'text/html' END AS media_type
  FROM uploads),
judged AS (SELECT *, 'org-' || (page_id % 3) AS organization_id, sha256(content) AS sha256, CASE WHEN safe_name LIKE '.%' THEN 'filename_not_allowed'
    WHEN strlen(content) > {_LIMIT} THEN 'too_large' WHEN media_type IS NULL THEN 'unknown_signature'
    WHEN NOT regexp_matches(lower(safe_name), '[.]html?$') THEN 'extension_mismatch'
    WHEN declared_type = 'application/pdf' THEN 'declared_type_mismatch' END AS reject_reason FROM named)"""


@query(
    "a1_admit_documents",
    f"WITH {_ADMIT_SQL} SELECT page_id, safe_name, media_type, sha256, reject_reason FROM judged",
)
def a1(spark, d):
    return documents.admit_documents(uploads(spark, d), _LIMIT).select(
        "page_id", "safe_name", "media_type", "sha256", "reject_reason"
    )


def _tags_sql(x: str) -> str:
    for tag in ("script", "style", "noscript", "template"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?(?:</{tag}\\s*>|\\z)', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?(?:-->|\\z)|<![^>]*>|<[?][^>]*>', chr(10), 'g')"
    x = f"""regexp_replace({x}, '</?[A-Za-z](?:[^''">]|"[^"]*"|''[^'']*'')*>', chr(10), 'g')"""
    return f"regexp_replace({x}, '</?[A-Za-z][^>]*>', chr(10), 'g')"


# Each '&' starts a piece; its head is a name of the standard's table, with or without semicolon, or a number.
_ENTITIES = ", ".join(f"({S.lit(name)}, {S.lit(text)})" for name, text in sorted(html5.items()))
_WINDOWS = " ".join(f"WHEN {number} THEN {S.lit(text)}" for number, text in documents.WINDOWS.items())
_TEXT_SQL = f"""
tagless AS (SELECT page_id, {_tags_sql('html')} AS x FROM pages),
pieces AS (SELECT page_id, unnest(string_split(x, '&')) AS q, generate_subscripts(string_split(x, '&'), 1) AS i FROM tagless),
heads AS (SELECT *, regexp_extract(q, '^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)', 1) AS code FROM pieces),
ended AS (SELECT *, substr(q, len(code) + 1, 1) = ';' AS closed, regexp_matches(code, '^#[xX]') AS is_hex,
  CASE WHEN code LIKE '#%' THEN ltrim(regexp_replace(code, '^#[xX]?', ''), '0') END AS digits FROM heads),
numbered AS (SELECT *, CASE WHEN digits = '' OR len(digits) > 7 THEN 0 WHEN is_hex THEN ('0x' || digits)::BIGINT ELSE digits::BIGINT END AS number FROM ended),
entities(name, chars) AS (VALUES {_ENTITIES}),
decoded AS (SELECT n.*, CASE WHEN number IS NULL THEN chars ELSE CASE number {_WINDOWS} ELSE
    CASE WHEN number BETWEEN 1 AND 55295 OR number BETWEEN 57344 AND 1114111 THEN chr(number::INT) ELSE chr(65533) END END END AS found
  FROM numbered n LEFT JOIN entities ON name = code || CASE WHEN closed THEN ';' ELSE '' END),
unescaped AS (SELECT page_id, string_agg(CASE WHEN i = 1 THEN q ELSE coalesce(found || substr(q, len(code) + 1 + closed::INT), '&' || q) END, '' ORDER BY i) AS x
  FROM decoded GROUP BY page_id),
html_texts AS (SELECT page_id, array_to_string(list_filter(list_transform(
    string_split(regexp_replace(replace(x, chr(13), chr(10)), '[ \\t]+', ' ', 'g'), chr(10)), lambda l: {S.strip('l')}), lambda l: l <> ''), chr(10)) AS text
  FROM pages LEFT JOIN unescaped USING (page_id))"""


@query("a2_html_to_text", f"WITH {_TEXT_SQL} SELECT page_id, text FROM html_texts")
def a2(spark, d):
    return I.table(spark, d, "pages").select("page_id", documents.html_to_text("html").alias("text"))


def transcript_pages(spark, d):
    """Conversations read as paged documents: a user turn opens with a numbered heading."""
    turn = F.col("turn").cast("int") + 1
    head = F.concat(F.when(F.col("turn") % 3 == 0, F.lit("Section ")).otherwise(""), (F.col("turn") % 4 + 1).cast("string"),
                    F.lit(". Question\n"), F.col("text"))
    return I.table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), turn.alias("page"),
        F.when((F.col("role") == "user") & (F.col("turn") > 0), head).otherwise(F.col("text")).alias("text"),
    )


@query(
    "a3_pages_to_sections",
    f"""WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, CASE WHEN role = 'user' AND turn > 0 THEN
      CASE WHEN turn % 3 = 0 THEN 'Section ' ELSE '' END || (turn % 4 + 1) || '. Question' || chr(10) || text ELSE text END AS text
      FROM conversations),
    l AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM p),
    h AS (SELECT *, regexp_extract({S.strip('line')}, {S.lit(S.V.SECTION_HEADING)}, 1) AS raw_key,
      regexp_extract({S.strip('line')}, {S.lit(S.V.SECTION_HEADING)}, 2) AS raw_title FROM l),
    n AS (SELECT *, sum((raw_key <> '')::INT) OVER (PARTITION BY doc_id ORDER BY page, line_no)::BIGINT AS section_no FROM h),
    g AS (SELECT doc_id, section_no, CASE WHEN section_no = 0 THEN page END AS lead_page, min(page) AS page,
      max(CASE WHEN raw_key <> '' THEN regexp_replace(lower(raw_key), '^section ', '') END) AS opened,
      max(CASE WHEN raw_key <> '' THEN {S.strip('raw_title')} END) AS title,
      {S.strip("string_agg(CASE WHEN raw_key = '' THEN line END, chr(10) ORDER BY page, line_no)")} AS body
      FROM n GROUP BY ALL),
    k AS (SELECT *, coalesce(opened, 'page-' || page) AS base_key FROM g WHERE body <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base_key ORDER BY section_no, lead_page) AS n FROM k)
    SELECT doc_id, CASE WHEN n = 1 THEN base_key ELSE base_key || '-' || n END AS section_key,
      coalesce(title, 'Document text') AS heading, body, page::INT AS page, section_no AS position FROM r""",
)
def a3(spark, d):
    return documents.pages_to_sections(transcript_pages(spark, d))


def statutes(spark, d):
    """Documents written as XML statutes: one section per line, with mixed content and a note to leave out."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.split(F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), "\n")
    section = F.transform(
        lines,
        lambda line, i: F.concat(
            F.lit("<Section><Label>"), (i + 1).cast("string"), F.lit("</Label><Text>"), escape(line),
            F.lit(" <b>end</b></Text><HistoricalNote><Text>old</Text></HistoricalNote></Section>"),
        ),
    )
    xml = F.concat(F.lit("<Statute><Body><Heading level='1'>Part "), F.col("source"), F.lit("</Heading>"),
                   F.array_join(section, ""), F.lit("</Body></Statute>"))
    return I.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.encode(xml, "UTF-8").alias("content")
    )


@query(
    "a4_xml_to_sections",
    f"""WITH l AS (SELECT doc_id, source, unnest(string_split(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
    SELECT doc_id::VARCHAR AS document_id, 'section-' || i AS section_id, 'Part ' || source AS heading,
      {S.ws("line || ' end'")} AS text FROM l""",
)
def a4(spark, d):
    return documents.xml_to_sections(statutes(spark, d)).select("document_id", "section_id", "heading", "text")


@query(
    "a8_object_keys",
    f"""WITH {_ADMIT_SQL},
    stored AS (SELECT DISTINCT organization_id, sha256 FROM judged WHERE declared_type IS NOT NULL AND reject_reason IS NULL)
    SELECT organization_id, sha256, organization_id || '/' || sha256 || lower(regexp_extract(min(safe_name), '([.][A-Za-z0-9]+)$', 1)) AS object_key
    FROM judged WHERE reject_reason IS NULL AND (organization_id, sha256) NOT IN (SELECT (organization_id, sha256) FROM stored)
    GROUP BY organization_id, sha256""",
)
def a8(spark, d):
    admitted = documents.admit_documents(uploads(spark, d), _LIMIT).where("reject_reason IS NULL")
    stored = admitted.where("declared_type IS NOT NULL")
    return store.pending_objects(admitted, stored).select("organization_id", "sha256", "object_key")


@query(
    "a8_put_objects",
    f"""WITH {_ADMIT_SQL} SELECT organization_id, sha256, organization_id || '/' || sha256 || lower(regexp_extract(
        coalesce(min(safe_name) FILTER (declared_type IS NOT NULL), min(safe_name)), '([.][A-Za-z0-9]+)$', 1)) AS object_key, 1::BIGINT AS objects
    FROM judged WHERE reject_reason IS NULL GROUP BY organization_id, sha256""",
)
def a8_put(spark, d):
    """Uploads with a declared type are put first, then all, then all again: every content is one object with its bytes."""
    admitted = stage_table(documents.admit_documents(uploads(spark, d), _LIMIT).where("reject_reason IS NULL"), "admitted")
    root = work_folder(spark, "objects")
    for put in (admitted.where("declared_type IS NOT NULL"), admitted, admitted):
        store.put_objects(put, root)
    found = store.stored_objects(spark, root).where(F.sha2("content", 256) == F.col("sha256"))
    return found.groupBy("organization_id", "sha256", "object_key").agg(F.count("*").alias("objects"))


def manifest(spark, d):
    """Suppliers as manifest rows; every fifth breaks a rule."""
    s, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 5
    commit = F.lit("0" * 39 + "a")
    return I.table(spark, d, "supplier").select(
        F.concat(F.when(k == 1, F.lit("S ")).otherwise("s"), s).alias("source_id"),
        F.concat(F.lit("doc-"), s).alias("document_id"),
        F.col("s_name").alias("title"),
        F.concat(F.lit("regulator-"), F.col("s_nationkey").cast("string")).alias("regulator"),
        F.when(k == 2, "bill").otherwise("act").alias("document_type"),
        F.concat(F.when(k == 3, F.lit("http")).otherwise("https"), F.lit("://laws.example.org/"), s).alias("official_url"),
        F.lit("https://portfolio.example.org/list").alias("portfolio_basis_url"),
        F.concat(F.lit("https://raw.example.org/org/repo/"), commit, F.lit("/eng/acts/"), s, F.when(k == 4, F.lit(".pdf")).otherwise(".xml")).alias("artifact_url"),
        commit.alias("repository_commit"),
        F.lit("review_required").alias("rights_status"),
        F.lit("https://licence.example.org").alias("rights_basis_url"),
    )


@query(
    "a9_manifest_checks",
    """SELECT CASE s_suppkey % 5 WHEN 1 THEN 'unsafe_source_id' WHEN 2 THEN 'unknown_document_type'
      WHEN 3 THEN 'evidence_url_not_https' ELSE 'artifact_url_shape' END AS "check",
      CASE WHEN s_suppkey % 5 = 1 THEN 'S ' ELSE 's' END || s_suppkey AS key, 'row' AS detail
    FROM supplier WHERE s_suppkey % 5 > 0""",
)
def a9(spark, d):
    return corpus.check_manifest_rows(manifest(spark, d), "raw.example.org", "org/repo")


@query(
    "a9_manifest_summary",
    """SELECT count(*) AS documents, count(DISTINCT s_nationkey) AS regulators, 1::BIGINT AS commits,
      CASE WHEN count(*) <> 25 THEN 'document_count' ELSE '' END AS failures FROM supplier""",
)
def a9_summary(spark, d):
    return corpus.manifest_summary(manifest(spark, d)).select(
        "documents", "regulators", "commits", F.array_join("failures", ",").alias("failures")
    )


@query(
    "a10_lock_coverage",
    """WITH m AS (SELECT s_suppkey AS k FROM supplier),
    l AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_shipdate < DATE '1995-01-20')
    SELECT 'not_locked' AS "check", 's' || k AS key, 'row' AS detail FROM m WHERE k NOT IN (SELECT k FROM l)
    UNION ALL SELECT 'document_mismatch', 's' || k, 'row' FROM l WHERE k % 10 = 3
    UNION ALL SELECT 'invalid_sha256', 's' || k, 'row' FROM l WHERE k % 10 = 4
    UNION ALL SELECT 'invalid_size', 's' || k, 'row' FROM l WHERE k % 10 = 5""",
)
def a10(spark, d):
    s = F.col("k").cast("string")
    rows = I.table(spark, d, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_id"),
        F.concat(F.lit("doc-"), F.col("s_suppkey").cast("string")).alias("document_id"),
    )
    shipped = (
        I.table(spark, d, "lineitem").where("l_shipdate < DATE '1995-01-20'").select(F.col("l_suppkey").alias("k")).distinct()
    )
    digit = F.col("k") % 10
    lock = shipped.select(
        F.concat(F.lit("s"), s).alias("source_id"),
        F.when(digit == 3, "doc-x").otherwise(F.concat(F.lit("doc-"), s)).alias("document_id"),
        F.when(digit == 4, "short").otherwise(F.sha2(s, 256)).alias("artifact_sha256"),
        F.when(digit == 5, F.lit(0)).otherwise(F.lit(10)).alias("artifact_size_bytes"),
    )
    return corpus.lock_coverage(rows, lock)


@query(
    "a11_acquisition_receipt",
    f"""WITH r AS (SELECT strlen(text) AS n, sha256(doc_id || ':' || {S.content_hash('text')} || ':' || strlen(text)) AS h FROM documents)
    SELECT sum(n)::BIGINT AS size_bytes, f.rows AS files, f.fingerprint FROM r, (SELECT {S.fingerprint('h')} FROM r) f GROUP BY ALL""",
)
def a11(spark, d):
    files = I.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("path"), content_hash("text").alias("sha256"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
    )
    return corpus.artifact_receipt(files)


# --- JSON records: each query writes a table as JSON lines, reads it back under its schema and checks it ------------


def through_json(df, schema):
    path = work_folder(df.sparkSession, "records")
    records.write_jsonl(df, path)
    return records.read_records(df.sparkSession, path, schema, multi_line=False)


@query(
    "a5_registry_violations",
    """WITH s AS (SELECT s_suppkey AS k, 's-' || s_suppkey AS key FROM supplier)
    SELECT c AS "check", key FROM s JOIN (VALUES (1, 'identity_fields_required'), (2, 'source_url_not_https'), (3, 'unknown_rights_status'),
      (4, 'approved_without_basis'), (5, 'approved_without_retrieval_time'), (6, 'approved_without_content_hash')) v(m, c) ON k % 9 = m
    UNION ALL SELECT 'duplicate_document_id', 'doc-same' WHERE (SELECT count(*) FROM supplier WHERE s_suppkey % 9 = 7) > 1""",
)
def a5_registry(spark, d):
    k = F.col("s_suppkey")
    text = k.cast("string")
    at = lambda m, bad, good: F.when(k % 9 == m, bad).otherwise(good)
    rows = I.table(spark, d, "supplier").select(
        F.concat(F.lit("s-"), text).alias("source_id"), at(7, F.lit("doc-same"), F.concat(F.lit("doc-"), text)).alias("document_id"),
        at(1, F.lit(" "), F.lit("regulator")).alias("regulator"), F.lit("federal").alias("jurisdiction"), F.col("s_name").alias("title"),
        F.lit("v1").alias("version"), F.concat(at(2, F.lit("http"), F.lit("https")), F.lit("://laws.example.org/"), text).alias("source_url"),
        at(3, F.lit("maybe"), F.lit("approved")).alias("rights_status"), at(4, F.lit(""), F.lit("licence")).alias("rights_basis"),
        at(5, F.lit("2026-01-01"), F.lit("2026-01-01T00:00:00Z")).alias("retrieved_at"), at(6, F.lit("x"), F.sha2(text, 256)).alias("content_sha256"),
    )
    return records.check_registry(through_json(rows, records.SOURCE_REGISTRY)).drop("detail")


@query(
    "a5_annotation_violations",
    """SELECT c AS "check", 'c-' || event_id AS key FROM events JOIN (VALUES ('error', 'unknown_label'), ('view', 'time_without_zone'), ('click', 'identity_required')) v(t, c) ON event_type = t""",
)
def a5_annotations(spark, d):
    kind = F.col("event_type")
    rows = I.table(spark, d, "events").select(
        F.concat(F.lit("c-"), F.col("event_id").cast("string")).alias("clause_id"),
        F.when(kind == "click", " ").otherwise("ann").alias("annotator_id"), F.when(kind == "error", "unheard").otherwise("permission").alias("label"),
        F.lit("g").alias("guideline_version"),
        F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(kind == "view", F.lit("")).otherwise("Z")).alias("annotated_at"),
        F.col("props").alias("notes"),
    )
    return records.check_annotations(through_json(rows, records.ANNOTATION)).drop("detail")


@query(
    "a6_labelled_clause_violations",
    """WITH l AS (SELECT doc_id, source, CASE WHEN lang = 'en' THEN 'definition' ELSE lang END AS label, md5(text) AS id FROM documents)
    SELECT 'unknown_label' AS "check", id AS key, 'row' AS detail FROM l WHERE label <> 'definition'
    UNION ALL SELECT 'duplicate_clause_id', id, count(*)::VARCHAR FROM l GROUP BY id HAVING count(*) > 1""",
)
def a6(spark, d):
    rows = I.table(spark, d, "documents").select(
        F.md5("text").alias("clause_id"), F.col("source").alias("document_id"), F.lit("r").alias("regulator"), "text",
        F.when(F.col("lang") == "en", "definition").otherwise(F.col("lang")).alias("label"),
    )
    return records.check_labelled_clauses(through_json(rows, records.LABELLED_CLAUSE))


@query("a7_jsonl_round_trip", "SELECT md5(text) AS clause_id, source AS document_id, sha256(text) AS text_sha256 FROM documents")
def a7(spark, d):
    rows = I.table(spark, d, "documents").select(
        F.md5("text").alias("clause_id"), F.col("source").alias("document_id"), F.lit("r").alias("regulator"), "text", F.lit("definition").alias("label")
    )
    return through_json(rows, records.LABELLED_CLAUSE).select("clause_id", "document_id", F.sha2("text", 256).alias("text_sha256"))
