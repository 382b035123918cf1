"""Scalar text functions: hashes, tokens, sentences, strata and small parsers.

Everything is a built-in column expression, so it stays inside code generation and is evaluated where the rows are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``: an expression named inside a lambda would run per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(value: Column | str) -> Column:
    """Drop leading and trailing white space of any script."""
    return F.btrim(_c(value), F.lit(V.WS_CHARACTERS))


def padded(number: Column | str, width: int) -> Column:
    """A whole number with leading zeros up to ``width`` digits; a longer one stays whole."""
    digits = _c(number).cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def normalize_ws(value: Column | str) -> Column:
    """Squeeze each run of white space to one blank and strip."""
    return F.trim(F.regexp_replace(_c(value), f"[{V.WS_FAST}]+", " "))


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the text with line endings unified and trailing blanks of every line dropped."""
    lines = F.split(F.replace(_c(text), F.lit("\r\n"), F.lit("\n")), "\n")
    trimmed = F.transform(lines, lambda line: F.rtrim(line, F.lit(V.WS_CHARACTERS)))
    return F.sha2(strip(F.array_join(trimmed, "\n")), 256)


def section_content_hash(heading: Column | str, body: Column | str) -> Column:
    return F.sha2(F.concat(_c(heading), F.lit("\n"), _c(body)), 256)


def clause_hash(text: Column | str) -> Column:
    return F.sha2(normalize_ws(F.lower(_c(text))), 256)


query_hash = clause_hash


def obligation_fingerprint(section_key: Column | str, modality: Column | str, evidence: Column | str) -> Column:
    return F.sha2(
        F.concat_ws("|", _c(section_key), _c(modality), normalize_ws(F.lower(_c(evidence)))), 256
    )


def sentences(text: Column | str) -> Column:
    """Array of sentences: a break follows ``.!?`` and precedes a capital or a digit."""
    parts = F.split(normalize_ws(text), V.SENTENCE_BOUNDARY)
    # F.trim takes two arguments: handed over by itself it would get the position as the characters to trim.
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(V.TOKEN), F.lit(0))


def token_set(text: Column | str) -> Column:
    return F.array_distinct(tokens(text))


def shingles(text: Column | str, size: int = 3) -> Column:
    """Set of word n-grams; a text with fewer words gives one short shingle, one without words the empty one."""
    return let(
        tokens(text),
        lambda words: F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))),
                lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(size)]),
            )
        ),
    )


def stable_rank(seed: str, *values: Column | str) -> Column:
    """Hash that orders rows the same way on every run."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[_c(v) for v in values]), 256)


def hash_bucket(digest: Column, modulus: int) -> Column:
    """First 8 hex digits of a digest as an integer, modulo."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % modulus).cast("int")


def document_bucket(document_id: Column | str, seed: str) -> Column:
    return hash_bucket(F.sha2(F.concat_ws(":", F.lit(seed), _c(document_id)), 256), 100)


def sampling_stratum(text: Column | str) -> Column:
    text = _c(text)
    (name, pattern), *rest = V.STRATA
    expr = F.when(text.rlike(pattern), name)
    for name, pattern in rest:
        expr = expr.when(text.rlike(pattern), name)
    return expr.otherwise("non_obligation")


def aware_timestamp(value: Column | str) -> Column:
    """True for an ISO time with a zone that names a real calendar moment."""
    value = _c(value)
    return F.coalesce(
        value.rlike(V.AWARE_TIMESTAMP) & F.try_to_timestamp(value).isNotNull(), F.lit(False)
    )


def modality(verb: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in V.MODALITIES.items() for x in pair])
    return F.try_element_at(table, normalize_ws(F.lower(_c(verb))))


def deadline(action: Column | str) -> Column:
    """First time limit named in an action, or null."""
    found = normalize_ws(F.regexp_extract(_c(action), V.DEADLINE, 0))
    return F.when(found != "", found)


def truncate_with_flag(body: Column | str, limit: int) -> tuple[Column, Column]:
    body = _c(body)
    return F.substring(body, 1, limit), F.length(body) > limit


def trace_id(traceparent: Column | str) -> Column:
    """Trace id of a W3C traceparent; null where it is malformed or all zero."""
    found = F.regexp_extract(F.lower(_c(traceparent)), V.TRACEPARENT, 1)
    return F.when((found != "") & (found != "0" * 32), found)


def label_answer_reject(answer: Column | str) -> Column:
    """Why a labelling answer is refused; null where it is accepted."""
    answer = _c(answer)
    keys = F.json_object_keys(answer)
    parsed = F.from_json(
        answer, "label STRING, confidence STRING, rationale STRING", {"mode": "PERMISSIVE"}
    )
    confidence = F.get_json_object(answer, "$.confidence").try_cast("double")
    number = answer.rlike(r'"confidence"\s*:\s*-?[0-9]')
    text = answer.rlike(r'"rationale"\s*:\s*"')
    return (
        F.when(keys.isNull(), "not_json")
        .when(F.sort_array(keys) != F.array(F.lit("confidence"), F.lit("label"), F.lit("rationale")), "wrong_fields")
        .when(~F.coalesce(parsed["label"].isin(*V.LABELS), F.lit(False)), "unknown_label")
        .when(~number | confidence.isNull(), "confidence_not_a_number")
        .when((confidence < 0) | (confidence > 1), "confidence_out_of_range")
        .when(~text | (strip(F.coalesce(parsed["rationale"], F.lit(""))) == ""), "blank_rationale")
    )


def prompt(slot: str) -> str:
    """Instruction given to a labelling slot: the same rules for each label, in the slot's own label order."""
    _, order = V.SLOTS[slot]
    rules = "; ".join(f"{label}: {V.LABEL_RULES[label]}" for label in order.split(", "))
    return (
        "Classify the legal function of one regulatory clause. Choose exactly one label and infer no duty "
        f"that the text does not create. Weigh the labels in this order: {order}. "
        f"The labels mean: {rules}. Naming a record, a report or evidence binds no one by itself; judge the clause that is "
        "given, not one that it mentions. Reporting and retention labels win over a general obligation. "
        "Answer in strict JSON with label, confidence from 0 to 1 and a short rationale."
    )
