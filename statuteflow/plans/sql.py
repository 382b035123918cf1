"""SQL twins of the scalar functions, used to build the checking queries."""

from __future__ import annotations

from ..functions import fixed as V


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return lit(pattern)


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def ws(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit('[' + V.WS + ']+')}, ' ', 'g'))"


def padded(x: str, width: int) -> str:
    return f"lpad(({x})::VARCHAR, greatest(len(({x})::VARCHAR), {width})::INT, '0')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(chr(92) + 'A[' + V.WS + ']+|[' + V.WS + ']+' + chr(92) + 'z')}, '', 'g')"


def content_hash(x: str) -> str:
    pattern = lit("[" + V.WS_NOT_NEWLINE + r"]+(\n|\z)")
    inner = f"regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), {pattern}, '\\1', 'g')"
    return f"sha256({strip(inner)})"


def clause_hash(x: str) -> str:
    return f"sha256({ws(f'lower({x})')})"


def sentences(x: str) -> str:
    marked = f"regexp_replace({ws(x)}, '([.!?]) ([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g')"
    # A sentence of one character shares it with both of its breaks, so the marking runs twice.
    marked = f"regexp_replace({marked}, '([.!?]) ([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{V.TOKEN}')"


def token_set(x: str) -> str:
    return f"list_distinct({tokens(x)})"


def shingles(x: str) -> str:
    t = tokens(x)
    return (
        f"list_distinct(list_transform(range(1, greatest(len({t}) - 2, 1) + 1), "
        f"lambda i: array_to_string(list_slice({t}, i, i + 2), ' ')))"
    )


def stable_rank(seed: str, *values: str) -> str:
    return "sha256(" + " || ':' || ".join([lit(seed), *values]) + ")"


def bucket(digest: str, modulus: int) -> str:
    return f"(('0x' || substr({digest}, 1, 8))::BIGINT % {modulus})::INTEGER"


def stratum(x: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({x}, {lit(p)}) THEN '{n}'" for n, p in V.STRATA)
    return f"CASE {cases} ELSE 'non_obligation' END"


def modality(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.MODALITIES.items())
    return f"CASE {ws(f'lower({x})')} {cases} END"


def deadline(x: str) -> str:
    return f"nullif({ws(f'regexp_extract({x}, {lit(V.DEADLINE)}, 0)')}, '')"


def calibrate(x: str) -> str:
    *bins, (_, last) = V.CALIBRATION_BINS
    cases = " ".join(f"WHEN {x} <= {u} THEN {v}" for u, v in bins)
    return f"(CASE {cases} ELSE {last} END)::DOUBLE"


def fingerprint(digest: str) -> str:
    """Select-list of ``rows`` and ``fingerprint`` over a column of hex digests."""
    parts = " || ':' || ".join(
        f"sum(('0x' || substr({digest}, {s}, 12))::BIGINT)::VARCHAR" for s in (1, 13, 25, 37)
    )
    return f"count(*) AS rows, sha256(count(*)::VARCHAR || ':' || {parts}) AS fingerprint"


LABEL_VALUES = "(VALUES " + ", ".join(f"({i}, '{name}')" for i, name in enumerate(V.LABELS)) + ") AS labels_t(idx, label)"
