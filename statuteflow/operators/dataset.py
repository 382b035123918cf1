"""Clause candidates, votes, adjudication, duplicates and the dataset audit."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.joins import attach_row
from ..functions.ordered import fingerprint_columns, first_per_key
from ..functions.text import document_bucket, let, sentences, shingles, tokens
from ..session import stage_table
from ..sources.records import violations
from .clusters import smallest_reachable


def build_candidates(sections: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, violations) from sections (document_id, section_id, heading, page, section_order, text).

    Positions count from 1 in the section; of equal texts in one document the first is kept (an aggregate).
    """
    known = registry.select(
        "document_id", "source_id", "regulator", "jurisdiction", F.col("title").alias("source_title"), "version", "source_url", "rights_status",
        "rights_basis", "retrieved_at", "content_sha256",
    )
    problems = violations(
        sections.select("document_id").distinct().join(known.select("document_id", "source_id", "rights_status"), "document_id", "left").distinct(),
        "document_id",
        {
            "document_not_registered": F.col("source_id").isNull(),
            "rights_not_approved": F.col("source_id").isNotNull() & (F.col("rights_status") != "approved"),
        },
    )
    # Clauses are folded without what the registry says of their document: that is joined to the clauses that are kept.
    approved = known.where("rights_status = 'approved'")
    clauses = (
        sections.select("document_id", "section_id", "heading", "page", "section_order", "text")
        .join(approved.select("document_id"), "document_id", "left_semi")
        .select("*", F.posexplode(sentences("text")).alias("p", "clause"))
        .withColumn("position", F.col("p") + 1)
        .withColumn("text_sha256", F.sha2("clause", 256))
        .drop("text", "p")
    )
    first = first_per_key(clauses, ["document_id", "text_sha256"], ["section_order", "position"])
    first = first.join(first_per_key(approved, ["document_id"], [c for c in known.columns if c != "document_id"]), "document_id")
    identity = F.concat_ws(
        ":", "document_id", "section_id", F.coalesce(F.col("page").cast("string"), F.lit("None")), F.col("position").cast("string"), "text_sha256"
    )
    return (
        first.withColumn("clause_id", F.concat(F.lit("clause-"), F.substring(F.sha2(identity, 256), 1, 24)))
        .withColumnRenamed("clause", "text")
        .withColumnRenamed("source_title", "title"),
        problems,
    )


def execution_receipt(candidates: DataFrame, sections: DataFrame, registry: DataFrame) -> DataFrame:
    """One row: coverage both ways, counts and fingerprints of the candidate run."""
    approved = registry.where("rights_status = 'approved'")
    a = approved.select("document_id", "regulator").withColumn("a", F.lit(1))
    s = sections.select("document_id").distinct().withColumn("s", F.lit(1))
    cover = a.join(s, "document_id", "full_outer").agg(
        F.count("a").alias("documents"), F.count_distinct(F.when(F.col("a") == 1, F.col("regulator"))).alias("regulators"),
        F.count_if(F.col("s").isNull()).alias("documents_without_sections"),
        F.count_if(F.col("a").isNull()).alias("sections_without_approval"),
    )
    queue = candidates.select(F.sha2(F.concat_ws(":", "clause_id", "text_sha256"), 256).alias("d")).agg(
        *fingerprint_columns(F.col("d"), "candidate_fingerprint")
    ).withColumnRenamed("rows", "candidates")
    count = sections.agg(F.count("*").alias("sections"))
    return attach_row(attach_row(cover, queue), count).withColumn(
        "status",
        F.when((F.col("documents_without_sections") + F.col("sections_without_approval")) > 0, "coverage_mismatch")
        .when(F.col("candidates") == 0, "no_candidates")
        .otherwise("candidate_queue_ready"),
    )


def verify_artifacts(registry: DataFrame, approvals: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Violations between approved sources, rights approvals and the bytes found (path, sha256)."""
    a = registry.where("rights_status = 'approved'").select(
        "source_id", F.col("document_id").alias("r_document"), "content_sha256", F.lit(1).alias("r")
    )
    p = approvals.select(
        "source_id", F.col("document_id").alias("p_document"), "artifact_path", "artifact_sha256", F.lit(1).alias("p")
    )
    f = artifacts.select(F.col("path").alias("artifact_path"), F.col("sha256").alias("actual"), F.lit(1).alias("f"))
    both = F.col("r").isNotNull() & F.col("p").isNotNull()
    joined = a.join(p, "source_id", "full_outer").join(f, "artifact_path", "left")
    return violations(
        joined,
        "source_id",
        {
            "not_approved_for_rights": F.col("p").isNull(),
            "approval_without_source": F.col("r").isNull(),
            "document_mismatch": both & (F.col("r_document") != F.col("p_document")),
            "artifact_missing": both & F.col("f").isNull(),
            "artifact_hash_mismatch": both & F.col("f").isNotNull()
            & ((F.col("actual") != F.col("artifact_sha256")) | (F.col("actual") != F.col("content_sha256"))),
        },
    ).drop("detail")


def adjudicate(candidates: DataFrame, votes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Resolution of every candidate: label, resolution (agreement, adjudicated, unresolved) and who decided.

    Exactly two votes by two people count. Votes per clause are folded as count, least and greatest, so a clause
    with many copies of a vote is no burden.
    """
    folded = votes.groupBy("clause_id").agg(
        F.count("*").alias("votes"), F.min("annotator_id").alias("first_annotator"), F.max("annotator_id").alias("second_annotator"),
        F.min("label").alias("low"), F.max("label").alias("high"),
    )
    thirds = decisions.groupBy("clause_id").agg(F.min(F.struct("reviewer_id", "label")).alias("d")).select(
        "clause_id", "d.reviewer_id", F.col("d.label").alias("third_label")
    )
    dual = F.coalesce((F.col("votes") == 2) & (F.col("first_annotator") != F.col("second_annotator")), F.lit(False))
    agreed = dual & (F.col("low") == F.col("high"))
    independent = F.col("reviewer_id").isNotNull() & (F.col("reviewer_id") != F.col("first_annotator")) & (
        F.col("reviewer_id") != F.col("second_annotator")
    )
    resolution = F.when(agreed, "agreement").when(dual & independent, "adjudicated").otherwise("unresolved")
    return (
        candidates.join(folded, "clause_id", "left")
        .join(thirds, "clause_id", "left")
        .withColumn("dual", dual)
        .withColumn("resolution", resolution)
        .withColumn(
            "label", F.when(F.col("resolution") == "agreement", F.col("low")).when(F.col("resolution") == "adjudicated", F.col("third_label"))
        )
        .withColumn("adjudicator", F.when(F.col("resolution") == "adjudicated", F.col("reviewer_id")))
        .drop("votes", "low", "high", "third_label", "reviewer_id")
    )


def adjudication_violations(candidates: DataFrame, votes: DataFrame, decisions: DataFrame, guideline: str = V.GUIDELINE_VERSION) -> DataFrame:
    """(check, key): unknown clauses, mixed guidelines, and decisions that are repeated, needless or unused."""
    ids = candidates.select("clause_id")
    row = lambda df, check: df.select(F.lit(check).alias("check"), F.col("clause_id").alias("key"))
    resolved = adjudicate(candidates, votes, decisions).select("clause_id", "dual", "resolution")
    decided = decisions.select("clause_id").distinct()
    mixed = (
        votes.groupBy("clause_id").agg(
            F.count("*").alias("n"), F.min("annotator_id").alias("a"), F.max("annotator_id").alias("b"),
            F.min("guideline_version").alias("low"), F.max("guideline_version").alias("high"),
        ).where((F.col("n") == 2) & (F.col("a") != F.col("b")) & ((F.col("low") != guideline) | (F.col("high") != guideline)))
    )
    used = decided.join(resolved, "clause_id")
    parts = [
        row(votes.select("clause_id").distinct().join(ids, "clause_id", "left_anti"), "vote_for_unknown_clause"),
        row(decided.join(ids, "clause_id", "left_anti"), "decision_for_unknown_clause"),
        row(mixed, "guideline_mismatch"),
        row(decisions.groupBy("clause_id").count().where("count > 1"), "duplicate_decision"),
        row(used.where("resolution = 'agreement'"), "decision_for_agreed_clause"),
        row(used.where("resolution = 'unresolved'"), "unused_decision"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """Lowered texts that occur in more than one document: hash, rows and the span of documents."""
    from ..functions.text import clause_hash

    return (
        rows.groupBy(F.unhex(clause_hash("text")).alias("h"))  # half as long as its digits
        .agg(F.count("*").alias("rows"), F.min("document_id").alias("first_document"), F.max("document_id").alias("last_document"))
        .where("first_document <> last_document")
        .select(F.lower(F.hex("h")).alias("text_hash"), "rows", "first_document", "last_document")
    )


def shingle_sets(rows: DataFrame, least: int = 0) -> DataFrame:
    """Distinct shingle sets: set_id, its shingles and size, and how many clauses and documents carry it.

    Sets are equal by 128 bits of a hash of their shingles; each shingle travels as 64 bits of its own. Sets of fewer than
    ``least`` shingles are left out.
    """
    return _folded_sets(rows, least).select("set_id", _numbers("text").alias("shingles"), "size", "clauses", "clause_id", "first_document", "last_document")


def _numbers(text: str) -> Column:
    return F.transform(F.sort_array(shingles(text)), lambda x: F.xxhash64(x))


def _folded_sets(rows: DataFrame, least: int = 0) -> DataFrame:
    """The rows of ``shingle_sets`` with one of the texts that have the set in place of its shingles.

    A text is a third of its shingles' hashes in a shuffle or a stored table, and they are made from it again.
    """
    keyed = rows.select("clause_id", "document_id", "text", F.sort_array(shingles("text")).alias("s"))
    if least:
        keyed = keyed.where(F.size("s") >= least)
    keyed = keyed.select("clause_id", "document_id", "text", F.unhex(F.md5(F.array_join("s", "|"))).alias("set_id"), F.size("s").alias("size"))
    return keyed.groupBy("set_id").agg(
        F.first("text").alias("text"), F.first("size").alias("size"), F.count("*").alias("clauses"),
        F.min("clause_id").alias("clause_id"), F.min("document_id").alias("first_document"), F.max("document_id").alias("last_document"),
    )


def _stored_sets(rows: DataFrame, threshold: float) -> DataFrame:
    """The sets that can be near a different one, numbered, written once; ``shingles`` is made where it is read.

    Of two different sets one has a shingle that the other has not: the similarity of a set of n is n / (n + 1) at most.
    """
    least = math.ceil(threshold / (1 - threshold) - 1e-6) if threshold < 1 else 0
    numbered = _folded_sets(rows, least).withColumn("set_id", F.monotonically_increasing_id())
    return stage_table(numbered, "shingle-sets").withColumn("shingles", _numbers("text"))


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """shingle, set_id, size, pos: the shingles of each set that a set as similar as ``threshold`` must share one of.

    Shingles are ordered rarest first; two such sets share one of their first ``size - ceil(threshold * size) + 1``. Those
    that one set alone has come first and can pair with nothing: they are counted, the others are gathered by set.
    """
    exploded = sets.select("set_id", "size", F.explode("shingles").alias("shingle"))
    # Counted where they meet: the shingles of the corpus are shuffled once, by three numbers each.
    met = exploded.withColumn("df", F.count("*").over(Window.partitionBy("shingle")).cast("int")).where("df > 1")
    ordered = (
        met.groupBy("set_id", "size")
        .agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("o"))
    )
    keep = (F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).cast("int")
    alone = F.col("size") - F.size("o")
    return ordered.select("set_id", "size", alone.alias("alone"), F.posexplode(F.slice("o", F.lit(1), F.greatest(F.lit(0), keep - alone))).alias("i", "x")).select(
        "set_id", "size", (F.col("alone") + F.col("i")).alias("pos"), F.col("x.shingle").alias("shingle")
    )


def _can_link(threshold: float):
    """Length and position bounds of two index entries (columns a_ and b_), of different sets, of one shingle."""
    low, high = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    need = F.ceil((F.col("a_size") + F.col("b_size")) * threshold / (1 + threshold) - 1e-9)
    reachable = 1 + F.least(F.col("a_size") - F.col("a_pos") - 1, F.col("b_size") - F.col("b_pos") - 1)
    return (low >= high * threshold - 1e-9) & (reachable >= need) & (need <= low - (low == high).cast("int"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a_set_id, b_set_id) with both sets and their similarity, those that reach it in two documents.

    The pairs are written, so that only the sets they name are read for their texts, and Spark knows how many they are.
    """
    pairs = stage_table(pairs, "near-candidates")
    named = pairs.select(F.explode(F.array("a_set_id", "b_set_id")).alias("set_id")).distinct()
    held = stage_table(sets.drop("shingles").join(named, "set_id", "left_semi"), "near-sets").withColumn("shingles", _numbers("text")).drop("text")
    side = lambda p: held.select(*[F.col(c).alias(f"{p}_{c}") for c in held.columns])
    checked = pairs.join(side("a"), "a_set_id").join(side("b"), "b_set_id").withColumn(
        "similarity",
        let(F.size(F.array_intersect("a_shingles", "b_shingles")), lambda n: n / (F.col("a_size") + F.col("b_size") - n)),
    )
    one_document = F.least("a_first_document", "b_first_document") == F.greatest("a_last_document", "b_last_document")
    return checked.where((F.col("similarity") >= threshold) & ~one_document)


def near_duplicates(rows: DataFrame, threshold: float = V.NEAR_DUPLICATE) -> DataFrame:
    """Pairs of different shingle sets with Jaccard of at least ``threshold`` that span two documents.

    Equal sets are folded first: a text copied a million times is one row here, and its copies are reported by
    their count. Exact join over prefixes of rare shingles; length and position bounds are part of the join condition, so
    hopeless candidates are dropped inside the join; what survives is verified on the whole sets. A group of near copies
    is all its pairs here; ``near_duplicate_clusters`` gives it in one row a set.
    """
    sets = _stored_sets(rows, threshold)  # read for frequencies, for prefixes and for both sides of the verification
    prefix = _prefixes(sets, threshold)
    a, b = (prefix.select("shingle", *[F.col(c).alias(f"{p}_{c}") for c in ("set_id", "size", "pos")]) for p in ("a", "b"))
    smaller = (F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a_set_id") < F.col("b_set_id")))
    pairs = a.join(b, (a["shingle"] == b["shingle"]) & smaller & _can_link(threshold)).select("a_set_id", "b_set_id").distinct()
    first = F.col("a_clause_id") < F.col("b_clause_id")
    return _verified(pairs, sets, threshold).select(
        F.least("a_clause_id", "b_clause_id").alias("left_clause"), F.greatest("a_clause_id", "b_clause_id").alias("right_clause"),
        "similarity", F.when(first, F.col("a_clauses")).otherwise(F.col("b_clauses")).alias("left_copies"),
        F.when(first, F.col("b_clauses")).otherwise(F.col("a_clauses")).alias("right_copies"),
    )


CENTRE_ROUNDS = 2


def _links(sets: DataFrame, index: DataFrame, threshold: float) -> Iterator[DataFrame]:
    """Tables of verified links (a, b) that together connect what all links connect.

    At a shingle, all sets meet one centre first, which is linear; near copies of one text are mostly near its centre, so
    they become one cluster. In the next round another set, of another cluster than the first centre's, is the centre. What
    is left are pairs of sets that share a shingle and are in different clusters still: those are compared as pairs.
    """
    entries = lambda df, p, *more: df.select("shingle", *[F.col(c).alias(f"{p}_{c}") for c in ("set_id", "size", "pos", *more)])
    ends = (F.col("a_set_id").alias("a"), F.col("b_set_id").alias("b"))
    marked, centres, links = index.withColumn("label", F.col("set_id")), None, None
    for _ in range(CENTRE_ROUNDS):
        open_ = marked
        if centres is not None:  # those that the centre's cluster does not have
            labels = marked.select("shingle", F.col("set_id").alias("centre"), F.col("label").alias("centre_label"))
            taken = centres.join(labels, ["shingle", "centre"])
            open_ = marked.join(taken, "shingle").where(F.col("label") != F.col("centre_label"))
        chosen = open_.groupBy("shingle").agg(F.min(F.struct("set_id", "size", "pos", "label")).alias("c"))
        chosen = stage_table(chosen.select("shingle", "c.*"), "shingle-centres")
        centres = chosen.select("shingle", F.col("set_id").alias("centre"))
        met = entries(chosen, "a", "label").join(entries(marked, "b", "label"), "shingle").where((F.col("a_label") != F.col("b_label")) & _can_link(threshold))
        found = stage_table(_verified(met.select("a_set_id", "b_set_id").distinct(), sets, threshold).select(*ends), "near-links")
        yield found
        links = found if links is None else links.union(found)
        labels = smallest_reachable(links).withColumnRenamed("node", "set_id")
        marked = stage_table(index.join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id")), "shingle-entries")
    a, b = entries(marked, "a", "label"), entries(marked, "b", "label")
    met = a.join(b, (a["shingle"] == b["shingle"]) & (F.col("a_label") < F.col("b_label")) & _can_link(threshold))
    yield stage_table(_verified(met.select("a_set_id", "b_set_id").distinct(), sets, threshold).select(*ends), "near-links")


def near_duplicate_clusters(rows: DataFrame, threshold: float = V.NEAR_DUPLICATE) -> DataFrame:
    """cluster_id, clause_id, clauses, sets: one row for each shingle set that has a near duplicate in another document.

    ``clause_id`` is the first clause with the set, ``clauses`` their number, ``cluster_id`` the smallest such clause_id that
    links reach, ``sets`` the number of sets in the cluster. As long as the sets, whatever the size of the groups.
    """
    sets = _stored_sets(rows, threshold)
    index = stage_table(_prefixes(sets, threshold), "shingle-prefixes")
    labels = smallest_reachable(reduce(DataFrame.union, _links(sets, index, threshold)))
    named = labels.join(sets.select(F.col("set_id").alias("node"), "clause_id", "clauses"), "node")
    clusters = named.groupBy("label").agg(F.min("clause_id").alias("cluster_id"), F.count("*").alias("sets"))
    return named.join(clusters, "label").select("cluster_id", "clause_id", "clauses", "sets")


def has_near_duplicates(rows: DataFrame, threshold: float = V.NEAR_DUPLICATE) -> bool:
    """Whether two different shingle sets of different documents are near: the search ends with the first link.

    It begins with a sixty-fourth of the shingles; without a link among those, all are searched.
    """
    sets = _stored_sets(rows, threshold)
    index = stage_table(_prefixes(sets, threshold), "shingle-prefixes")
    if not index.limit(1).count():
        return False
    if next(_links(sets, index.where(F.pmod("shingle", F.lit(64)) == 0), threshold)).limit(1).count():
        return True
    return any(found.limit(1).count() for found in _links(sets, index, threshold))


def equal_set_groups(rows: DataFrame) -> DataFrame:
    """Groups of clauses with the same shingle set in two documents or more (similarity 1)."""
    words = rows.select("clause_id", "document_id", "text").where(F.size(tokens("text")) >= 0)
    return shingle_sets(words).where("first_document <> last_document").select(
        F.col("clause_id").alias("first_clause"), "clauses", "size", "first_document", "last_document"
    )


def audit_dataset(resolved: DataFrame, lineage: DataFrame, seed: str = "clause-split-v1") -> DataFrame:
    """One row: counts, split sizes, duplicate counts and the failed rules of a labelled dataset.

    ``resolved`` comes from :func:`adjudicate`; ``lineage`` has clause_id, document_id, regulator, text, text_sha256,
    label, rights_status, content_sha256, source_url, guideline_version.
    """
    rows = resolved.where("resolution <> 'unresolved'").select("clause_id", "document_id", "regulator", "text", "label")
    bucket = document_bucket("document_id", seed)
    facts = rows.agg(
        F.count("*").alias("examples"), F.count_distinct("document_id").alias("documents"),
        F.count_distinct("regulator").alias("regulators"),
        F.least(*[F.count_if(F.col("label") == x) for x in V.LABELS]).alias("least_class"),
        F.count_if(bucket < 70).alias("train"), F.count_if((bucket >= 70) & (bucket < 85)).alias("validation"),
        F.count_if(bucket >= 85).alias("test"),
    )
    votes = resolved.agg(
        F.count_if("dual").alias("dual"), F.count_if(F.col("resolution") == "agreement").alias("agreements"),
        F.count_if(F.col("resolution") == "adjudicated").alias("adjudicated_count"),
        F.count_if(F.col("resolution") == "unresolved").alias("unresolved_count"),
    )
    # Each side says by itself what it can and sends 128 bits of a hash of what must be equal, not the texts.
    said = F.concat_ws("|", *[F.length(c).cast("string") for c in ("document_id", "regulator", "label")], "document_id", "regulator", "label", "text")
    whole = F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in ("document_id", "regulator", "label", "text")]), F.unhex(F.md5(said)))
    lawful = (
        (F.col("rights_status") == "approved") & F.col("content_sha256").rlike(r"^[0-9a-f]{64}$") & (F.col("text_sha256") == F.sha2("text", 256))
        & (F.coalesce("source_url", F.lit("")) != "") & (F.col("guideline_version") == V.GUIDELINE_VERSION)
    )
    l = lineage.select(F.col("clause_id").alias("l_clause_id"), whole.alias("l_said"), lawful.alias("lawful"))
    compared = rows.select("clause_id", whole.alias("said")).join(l, F.col("clause_id") == F.col("l_clause_id"), "full_outer")
    sound = F.col("lawful") & (F.col("said") == F.col("l_said"))
    broken = compared.agg(F.count_if(~F.coalesce(sound, F.lit(False))).alias("broken_lineage"))
    exact = exact_duplicates(rows).agg(F.count("*").alias("exact_duplicate_groups"))
    equal = equal_set_groups(rows).agg(F.count("*").alias("equal_set_groups"))
    one = facts
    for part in (votes, broken, exact, equal):
        one = attach_row(one, part)
    one = one.withColumn("near_duplicates", F.lit(has_near_duplicates(rows)))
    p = V.PROMOTION
    rules = {
        "insufficient_examples": F.col("examples") < p["examples"],
        "insufficient_documents": F.col("documents") < p["documents"],
        "insufficient_regulators": F.col("regulators") < p["regulators"],
        "insufficient_examples_per_class": F.col("least_class") < V.EXAMPLES_PER_CLASS,
        "unresolved_annotations": F.col("unresolved_count") > 0,
        "invalid_lineage": F.col("broken_lineage") > 0,
        "cross_document_exact_duplicates": F.col("exact_duplicate_groups") > 0,
        "cross_document_near_duplicates": F.col("near_duplicates") | (F.col("equal_set_groups") > 0),
        "invalid_document_split": F.least("train", "validation", "test") == 0,
    }
    failures = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return (
        one.withColumn("failures", F.sort_array(failures))
        .withColumn("status", F.when(F.size("failures") == 0, "ready").otherwise("blocked"))
        .withColumn("agreement_rate", F.round(F.coalesce(F.try_divide("agreements", "dual"), F.lit(0.0)), 4))
    )
