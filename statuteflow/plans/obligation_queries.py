"""D: obligations over the rule book written from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as V
from ..operators import obligations as D
from . import inputs as I
from .inputs import OBLIGATIONS_SQL, RULE_BOOK_SQL
from .registry import query


@query(
    "d1_extract_obligations",
    f"""WITH {OBLIGATIONS_SQL} SELECT section_id, evidence, subject, modality, action FROM parsed""",
)
def d1(spark, d):
    return D.extract_obligations(I.rule_book(spark, d)).select("section_id", "evidence", "subject", "modality", "action")


@query(
    "d2_score_obligations",
    f"""WITH {OBLIGATIONS_SQL} SELECT section_id, fingerprint, modality, deadline_text, raw_confidence, confidence,
    requires_review, CASE WHEN requires_review THEN 'needs_review' ELSE 'candidate' END AS status,
    concat_ws(',', 'binding_modality', 'explicit_subject', CASE WHEN phrase THEN 'action_phrase' END,
      CASE WHEN deadline_text IS NOT NULL THEN 'temporal_constraint' END,
      CASE WHEN prohibits THEN 'explicit_prohibition' END) AS rules
    FROM obligations""",
)
def d2(spark, d):
    return D.obligations_of(I.rule_book(spark, d)).select(
        "section_id", "fingerprint", "modality", "deadline_text", "raw_confidence", "confidence", "requires_review",
        "status", F.array_join("rule_ids", ",").alias("rules"),
    )


@query(
    "d3_incremental_extraction",
    f"""WITH {OBLIGATIONS_SQL},
    done AS (SELECT DISTINCT 'reg-' || l_suppkey || ':v' || (year(l_shipdate) - 1994) AS version_id
             FROM lineitem WHERE l_returnflag = 'R' AND l_discount = 0.1 AND l_quantity = 50),
    versions AS (SELECT DISTINCT version_id FROM rsections),
    pending AS (SELECT version_id FROM versions WHERE version_id NOT IN (SELECT version_id FROM done))
    SELECT p.version_id, count(o.obligation_id) AS candidate_count, '{V.EXTRACTION_METHOD}' AS extraction_method
    FROM pending p LEFT JOIN obligations o USING (version_id) GROUP BY p.version_id""",
)
def d3(spark, d):
    sections = I.rule_book(spark, d)
    ledger = (
        I.table(spark, d, "lineitem")
        .where("l_returnflag = 'R' AND l_discount = 0.1 AND l_quantity = 50")
        .select(
            F.concat(F.lit("reg-"), F.col("l_suppkey").cast("string"), F.lit(":v"),
                     (F.year("l_shipdate") - 1994).cast("string")).alias("version_id"),
            F.lit(V.EXTRACTION_METHOD).alias("extraction_method"),
        )
    )
    _, runs = D.incremental_extraction(sections, I.rule_versions(sections), ledger)
    return runs.select("version_id", "candidate_count", "extraction_method")


@query(
    "d4_list_obligations",
    f"""WITH {OBLIGATIONS_SQL} SELECT obligation_id, regulation_id, ordinal, section_key, position, action, confidence
    FROM obligations WHERE requires_review ORDER BY ordinal DESC, position, obligation_id LIMIT 200 OFFSET 100""",
)
def d4(spark, d):
    found = D.obligations_of(I.rule_book(spark, d))
    return D.list_obligations(found, 200, 100, status="needs_review").select(
        "obligation_id", "regulation_id", "ordinal", "section_key", "position", "action", "confidence"
    )


@query(
    "d6_extraction_evaluation",
    f"""WITH {OBLIGATIONS_SQL},
    predicted AS (SELECT DISTINCT section_id, evidence FROM parsed),
    expected AS (SELECT section_id, evidence FROM rsentences WHERE evidence LIKE '%must%' OR evidence LIKE '%may%'
                 OR evidence LIKE '%required%'),
    e AS (SELECT DISTINCT * FROM expected),
    c AS (SELECT count(*) FILTER (p.section_id IS NOT NULL AND e.section_id IS NOT NULL) AS true_positive,
      count(*) FILTER (e.section_id IS NULL) AS false_positive, count(*) FILTER (p.section_id IS NULL) AS false_negative
      FROM predicted p FULL OUTER JOIN e ON p.section_id = e.section_id AND p.evidence = e.evidence),
    r AS (SELECT *, true_positive / (true_positive + false_positive) AS p_, true_positive / (true_positive + false_negative) AS r_ FROM c)
    SELECT true_positive, false_positive, false_negative, round(p_, 9) AS precision, round(r_, 9) AS recall,
      round(2 * p_ * r_ / (p_ + r_), 9) AS f1 FROM r""",
)
def d6(spark, d):
    sections = I.rule_book(spark, d)
    predicted = D.extract_obligations(sections)
    every = sections.select("section_id", F.explode(D.sentences("body")).alias("evidence"))
    expected = every.where(
        F.col("evidence").contains("must") | F.col("evidence").contains("may") | F.col("evidence").contains("required")
    )
    out = D.extraction_evaluation(predicted, expected, ["section_id", "evidence"])
    return out.select(
        "true_positive", "false_positive", "false_negative", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")]
    )


@query(
    "d0_rule_book",
    f"WITH {RULE_BOOK_SQL} SELECT organization_id, section_id, section_key, heading, body, page, position FROM rsections",
)
def d0(spark, d):
    return I.rule_book(spark, d).select(
        "organization_id", "section_id", "section_key", "heading", "body", "page", "position"
    )
