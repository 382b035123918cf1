"""Inputs that the queries derive from the given tables, as Spark plans and as SQL of the same name.

``corpus``     lines of ``documents``: regulation = source, one arrival per document
``clause``     a multi-tenant rule book written from every line item, its part and its supplier
``controls``   control changes from every part
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, padded
from ..operators.changes import detect_changes
from ..operators.versioning import first_versions, ingest_versions
from ..session import stage_table
from . import sql as S

# Arrivals are numbered by document id; this many ids make one chunk of a running rank.
ID_CHUNK = 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# Below this many bytes per core a table is too small for its files to occupy the cores.
SMALL_PER_CORE = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal a small table out to all cores; a table large enough for its splits to do so is left as it is.

    One Parquet file with one row group is one task, however much work follows. The size is the one the optimizer
    has from the file listing, so no job runs to find it.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if (256 << 10) < size < cores * SMALL_PER_CORE else df


# --- documents as regulations -------------------------------------------------------------------------------


def arrivals(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("source").alias("regulation_id"), F.col("doc_id").alias("arrived"), content_hash("text").alias("content_hash")
    )


def ingested(spark, d) -> DataFrame:
    return ingest_versions(stage_table(arrivals(spark, d), "arrivals"), F.floor(F.col("arrived") / ID_CHUNK))


def document_versions(spark, d) -> DataFrame:
    """regulation_id, ordinal, doc_id, content_hash, version_id, source_uri, ingested_at (epoch seconds).

    The hashes of the texts are written once as a narrow table; the versions made from it are one more, small enough
    for the optimizer to know its size when it is joined with the sections.
    """
    hashed = stage_table(arrivals(spark, d), "arrivals")
    made = first_versions(hashed, F.floor(F.col("arrived") / ID_CHUNK)).select(
        "regulation_id",
        "ordinal",
        F.col("arrived").alias("doc_id"),
        "content_hash",
        F.concat_ws(":v", "regulation_id", F.col("ordinal").cast("string")).alias("version_id"),
        F.concat(F.lit("doc://"), F.col("arrived").cast("string")).alias("source_uri"),
        (F.col("arrived") * 60).alias("ingested_at"),
    )
    return stage_table(made, "versions")


def document_sections(spark, d, versions: DataFrame) -> DataFrame:
    """Every line of every version: the key is the line number, the heading the language of the document."""
    lines = table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("heading"), F.posexplode(F.split("text", "\n")).alias("line", "body")
    )
    return lines.join(versions, "doc_id").select(
        "regulation_id",
        "ordinal",
        "version_id",
        padded("line", 6).alias("section_key"),
        "heading",
        "body",
        (F.floor(F.col("line") / 10) + 1).cast("int").alias("page"),
        F.col("line").alias("position"),
    )


def document_changes(spark, d, versions: DataFrame | None = None) -> DataFrame:
    versions = document_versions(spark, d) if versions is None else versions
    return detect_changes(document_sections(spark, d, versions), versions.select("regulation_id", "ordinal"))


CORPUS_SQL = f"""
arrivals AS (
  SELECT source AS regulation_id, doc_id AS arrived, {S.content_hash('text')} AS content_hash FROM documents),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY regulation_id, content_hash ORDER BY arrived) = 1 AS is_first FROM arrivals),
counted AS (
  SELECT *, sum(is_first::INT) OVER (PARTITION BY regulation_id ORDER BY arrived)::BIGINT AS current_ordinal,
         last_value(CASE WHEN is_first THEN content_hash END IGNORE NULLS) OVER (
           PARTITION BY regulation_id ORDER BY arrived ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_hash
  FROM marked),
ingested AS (
  SELECT *, max(CASE WHEN is_first THEN current_ordinal END) OVER (PARTITION BY regulation_id, content_hash) AS ordinal,
         CASE WHEN is_first THEN 'created' WHEN content_hash = latest_hash THEN 'unchanged' ELSE 'conflict' END AS outcome
  FROM counted),
dversions AS (
  SELECT regulation_id, ordinal, arrived AS doc_id, content_hash, regulation_id || ':v' || ordinal AS version_id,
         'doc://' || arrived AS source_uri, arrived * 60 AS ingested_at
  FROM ingested WHERE outcome = 'created'),
dlines AS (
  SELECT doc_id, lang AS heading, unnest(string_split(text, chr(10))) AS body,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
dsections AS (
  SELECT v.regulation_id, v.ordinal, v.version_id, {S.padded('l.line', 6)} AS section_key, l.heading, l.body,
         (l.line // 10 + 1)::INT AS page, l.line AS position
  FROM dlines l JOIN dversions v USING (doc_id)),
dprev AS (
  SELECT s.regulation_id, s.ordinal + 1 AS ordinal, s.section_key, s.heading, s.body, s.page FROM dsections s
  WHERE EXISTS (SELECT 1 FROM dversions n WHERE n.regulation_id = s.regulation_id AND n.ordinal = s.ordinal + 1)),
dpaired AS (
  SELECT coalesce(o.regulation_id, n.regulation_id) AS regulation_id, coalesce(o.ordinal, n.ordinal) AS ordinal,
         coalesce(o.section_key, n.section_key) AS section_key, coalesce(n.heading, o.heading) AS heading,
         CASE WHEN o.section_key IS NULL THEN 'added' WHEN n.section_key IS NULL THEN 'removed'
              WHEN {S.strip('o.heading')} <> {S.strip('n.heading')} OR {S.strip('o.body')} <> {S.strip('n.body')}
              THEN 'modified' END AS change_type,
         o.body AS previous_text, n.body AS current_text, o.page AS previous_page, n.page AS current_page
  FROM dprev o FULL OUTER JOIN dsections n
    ON o.regulation_id = n.regulation_id AND o.ordinal = n.ordinal AND o.section_key = n.section_key),
dchanges AS (
  SELECT sha256(regulation_id || ':' || ordinal || ':' || section_key) AS change_id, *,
         CASE WHEN ordinal > 1 THEN ordinal - 1 END AS previous_ordinal
  FROM dpaired WHERE change_type IS NOT NULL)"""


# --- line items as a rule book ------------------------------------------------------------------------------


def rule_book(spark, d) -> DataFrame:
    """Sections of a versioned, multi-tenant rule book.

    Each line item states one or two clauses about its part; the order number picks the template. A section is a
    (supplier, year, brand, template); of several line items for one section the one with the least part and
    quantity speaks. That choice is the least of one number, a hash aggregate that folds before the shuffle whatever
    the size of a section; texts are written for the chosen rows only.
    """
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    tenant = (
        table(spark, d, "supplier")
        .join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.concat(F.lit("org-"), F.col("n_regionkey").cast("string")).alias("organization_id"))
    )
    supplier = F.col("l_suppkey").cast("string")
    chosen = (
        li.join(part.select("p_partkey", F.regexp_replace("p_brand", "[^0-9]", "").cast("int").alias("brand")), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            "l_suppkey", (F.year("l_shipdate") - 1994).cast("bigint").alias("ordinal"), "brand",
            (F.col("l_orderkey") % 6).cast("int").alias("template"),
        )
        .agg(F.min(F.col("l_partkey") * 64 + F.col("l_quantity").cast("bigint")).alias("code"))
        .select("*", F.expr("code DIV 64").alias("p_partkey"), (F.col("code") % 64).cast("string").alias("days"))
    )
    name, template = F.col("p_name"), F.col("template")
    text = (
        F.when(template == 0, F.concat(F.lit("Supplier "), supplier, F.lit(" must deliver "), name, F.lit(" within "), F.col("days"), F.lit(" days.")))
        .when(template == 1, F.concat(F.lit("Contractors shall not resell "), name,
                                      F.lit(". Auditors are required to review "), name, F.lit(" quarterly.")))
        .when(template == 2, F.concat(F.lit("Operators may keep "), name, F.lit(" records.")))
        .when(template == 3, F.concat(F.lit("Batch means a lot of "), name, F.lit(".")))
        .when(template == 4, F.concat(F.lit("Operators shall retain "), name, F.lit(" records.")))
        .otherwise(F.concat(F.lit("This part describes "), name, F.lit(".")))
    )
    return (
        chosen.join(part.select("p_partkey", "p_name", "p_type"), "p_partkey")
        .join(tenant, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "organization_id",
            F.concat(F.lit("reg-"), supplier).alias("regulation_id"),
            F.concat(F.lit("reg-"), supplier, F.lit(":v"), F.col("ordinal").cast("string")).alias("version_id"),
            "ordinal",
            F.concat_ws(".", F.col("brand").cast("string"), template.cast("string")).alias("section_key"),
            F.col("p_type").alias("heading"),
            text.alias("body"),
            (F.col("brand") + 1).cast("int").alias("page"),
            (F.col("brand") * 6 + template).cast("int").alias("position"),
        )
        .withColumn("section_id", F.concat_ws("/", "version_id", "section_key"))
    )


RULE_BOOK_SQL = """
statements AS (
  SELECT 'org-' || n_regionkey AS organization_id, 'reg-' || l_suppkey AS regulation_id,
         (year(l_shipdate) - 1994)::BIGINT AS ordinal, regexp_replace(p_brand, '[^0-9]', '', 'g')::INT AS brand,
         (l_orderkey % 6)::INT AS template, p_type AS heading, l_partkey * 64 + l_quantity::BIGINT AS code,
         CASE l_orderkey % 6
           WHEN 0 THEN 'Supplier ' || l_suppkey || ' must deliver ' || p_name || ' within ' || l_quantity::INT || ' days.'
           WHEN 1 THEN 'Contractors shall not resell ' || p_name || '. Auditors are required to review ' || p_name || ' quarterly.'
           WHEN 2 THEN 'Operators may keep ' || p_name || ' records.'
           WHEN 3 THEN 'Batch means a lot of ' || p_name || '.'
           WHEN 4 THEN 'Operators shall retain ' || p_name || ' records.'
           ELSE 'This part describes ' || p_name || '.' END AS body
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey),
ranked_statements AS (
  SELECT *, row_number() OVER (PARTITION BY organization_id, regulation_id, ordinal, brand, template
                               ORDER BY code) AS rn FROM statements),
rsections AS (
  SELECT organization_id, regulation_id, regulation_id || ':v' || ordinal AS version_id, ordinal,
         brand || '.' || template AS section_key, heading, body, (brand + 1)::INT AS page,
         (brand * 6 + template)::INT AS position,
         regulation_id || ':v' || ordinal || '/' || brand || '.' || template AS section_id
  FROM ranked_statements WHERE rn = 1)"""


def rule_versions(sections: DataFrame) -> DataFrame:
    return sections.groupBy("organization_id", "regulation_id", "version_id", "ordinal").agg(
        F.count("*").alias("section_count")
    )


OBLIGATIONS_SQL = f"""{RULE_BOOK_SQL},
rsentences AS (SELECT *, unnest({S.sentences('body')}) AS evidence FROM rsections),
captures AS (
  SELECT *, regexp_extract_all(evidence, {S.lit(S.V.MODALITY)}, 1) AS g1,
         regexp_extract_all(evidence, {S.lit(S.V.MODALITY)}, 2) AS g2,
         regexp_extract_all(evidence, {S.lit(S.V.MODALITY)}, 3) AS g3 FROM rsentences),
candidates AS (
  SELECT organization_id, regulation_id, version_id, ordinal, section_id, section_key, heading, page, position, evidence,
         unnest(g1) AS subject_raw, unnest(g2) AS verb, unnest(g3) AS action_raw FROM captures),
parsed AS (
  SELECT * EXCLUDE (subject_raw, verb, action_raw), regexp_replace({S.ws('subject_raw')}, ',+$', '') AS subject,
         {S.modality('verb')} AS modality, {S.ws('action_raw')} AS action FROM candidates),
timed AS (SELECT *, {S.deadline('action')} AS deadline_text, len(string_split(action, ' ')) >= 3 AS phrase,
                 modality IN ('must_not', 'shall_not') AS prohibits FROM parsed),
scored AS (
  SELECT *, least(round(0.72::DOUBLE + CASE WHEN phrase THEN 0.08::DOUBLE ELSE 0 END
                        + CASE WHEN deadline_text IS NOT NULL THEN 0.10::DOUBLE ELSE 0 END
                        + CASE WHEN prohibits THEN 0.04::DOUBLE ELSE 0 END, 3), 0.98) AS raw_confidence FROM timed),
fingerprinted AS (
  SELECT *, {S.calibrate('raw_confidence')} AS confidence,
         sha256(section_key || '|' || modality || '|' || {S.ws('lower(evidence)')}) AS fingerprint FROM scored),
obligations AS MATERIALIZED (
  SELECT DISTINCT ON (version_id, fingerprint) *, confidence < {S.V.REVIEW_THRESHOLD} AS requires_review,
         sha256(version_id || ':' || fingerprint) AS obligation_id FROM fingerprinted)"""


# --- parts as controls --------------------------------------------------------------------------------------


def control_changes(spark, d) -> DataFrame:
    """Control edits: one per part, in part order; the brand and the tenant name the control."""
    p = table(spark, d, "part")
    return p.select(
        F.concat(F.lit("org-"), (F.col("p_size") % 5).cast("string")).alias("organization_id"),
        F.upper(F.regexp_replace("p_brand", "#", "-")).alias("control_key"),
        F.concat(F.lit("Review of "), F.lower("p_type"), F.lit(" parts")).alias("title"),
        F.concat(F.lit("Operators retain "), "p_name", F.lit(" records")).alias("description"),
        F.concat(F.lit("owner-"), F.lower("p_type")).alias("owner"),
        F.concat(F.lit("Signed log of "), "p_name", F.lit(" within "), F.col("p_size").cast("string"), F.lit(" days")).alias(
            "evidence_requirement"
        ),
        F.col("p_partkey").alias("changed_at"),
    )


CONTROLS_SQL = """
control_changes AS (
  SELECT 'org-' || (p_size % 5) AS organization_id, upper(replace(p_brand, '#', '-')) AS control_key,
         'Review of ' || lower(p_type) || ' parts' AS title, 'Operators retain ' || p_name || ' records' AS description,
         'owner-' || lower(p_type) AS owner,
         'Signed log of ' || p_name || ' within ' || p_size || ' days' AS evidence_requirement,
         p_partkey AS changed_at FROM part),
control_hashed AS (
  SELECT *, sha256(description || '|' || owner || '|' || evidence_requirement) AS content_hash FROM control_changes),
control_first AS (
  SELECT *, row_number() OVER (PARTITION BY organization_id, control_key, content_hash ORDER BY changed_at) AS rn
  FROM control_hashed),
control_versions AS (
  SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY organization_id, control_key ORDER BY changed_at) AS ordinal
  FROM control_first WHERE rn = 1),
control_titles AS (
  SELECT organization_id, control_key, arg_min(title, changed_at) AS title FROM control_changes GROUP BY ALL),
latest_controls AS MATERIALIZED (
  SELECT v.* EXCLUDE (title), t.title, v.organization_id || '/' || v.control_key || ':v' || v.ordinal AS control_version_id
  FROM control_versions v JOIN control_titles t USING (organization_id, control_key)
  QUALIFY row_number() OVER (PARTITION BY organization_id, control_key ORDER BY ordinal DESC) = 1)"""
