"""Secret scans by linking the parts of a credential.

Some spans tell a secret by their form (an assigned password, an access identifier, a long hexadecimal number). Others are
weak: a user name, a random-looking word, a key under a vague name, an address. Each weak candidate opens an interval, its
surroundings within its paragraph, and the interval join of candidates with intervals says which complementary parts lie
there. A weak candidate without its complements is not reported.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .words import text_slices

REACH = 200  # code points before and behind a weak candidate that belong to its scope


def either(words: str) -> str:
    """A pattern's letters a-z in either case."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


def assigned(names: str, value: str) -> str:
    return rf"""({either(names)})["']?\x20*[:=]\x20*["']?({value})"""


# The patterns of each kind, the number of characters that the value (or else the whole match) must have.
PATTERNS = {
    "assign": (assigned("password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]+"), 6),
    "access": ("(AKIA[A-Z0-9]+)", 20),
    "hex": ("([0-9a-f]{24,})", 24),
    "ident": (assigned("username|user|login|account|client_?id|key_?id", "[A-Za-z0-9@._+-]+"), 3),
    "phrase": (assigned("passphrase|pass|pwd|credentials?|auth|private_?key|access_?key|secret_?key|account_?key", "[A-Za-z0-9+/_.=-]+"), 6),
    "key": ("([A-Za-z0-9+/_-]{20,})", 20),
    "url": (r"((?:https?|wss?|ftps?|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+)", 12),
    "host": (assigned("hostname|host|server|endpoint", "[A-Za-z0-9._:/-]+"), 4),
}
# What must stand in a text for a kind to be looked for.
HINTS = {
    "assign": (b"passw", b"secret", b"token", b"apikey", b"api_key"), "access": (b"akia",), "ident": (b"user", b"login", b"account", b"client", b"key"),
    "phrase": (b"pass", b"pwd", b"credential", b"auth", b"key"), "url": (b"://",), "host": (b"host", b"server", b"endpoint"),
}
KINDS = tuple(PATTERNS)
SECRETS, IDENTIFIERS, ENDPOINTS = ("assign", "hex", "phrase", "key"), ("access", "ident"), ("url", "host")
#: Of each set, a part must lie in the scope of the weak candidate.
COMPLEMENTS = {
    "ident": (SECRETS,), "phrase": (IDENTIFIERS + ENDPOINTS,), "key": (IDENTIFIERS,), "url": (SECRETS, IDENTIFIERS), "host": (SECRETS, IDENTIFIERS),
}
BLANK_LINE = r"\n[ \t\r]*\n"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FOUND = {kind: (re.compile(pattern.encode()), least) for kind, (pattern, least) in PATTERNS.items()}
_BLANK = re.compile(BLANK_LINE.encode())
_HEX = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
_KEY = np.array([chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_-") for b in range(256)])


def long_runs(data: np.ndarray, of: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of at least ``least`` bytes that ``of`` (256 flags) has."""
    edge = np.flatnonzero(np.diff(of[data], prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def candidates(text: bytes, hexes: list[tuple[int, int]], keys: list[tuple[int, int]]) -> dict[str, np.ndarray]:
    """Bounds (bytes) of all candidates of each kind, in their order; runs of the kinds hex and key are given."""
    folded = text.translate(_FOLD)
    spans: dict[str, list] = {kind: [] for kind in KINDS}
    spans["hex"] = hexes
    for kind, hints in HINTS.items():
        if any(hint in folded for hint in hints):
            pattern, least = _FOUND[kind]
            spans[kind] = [m.span() for m in pattern.finditer(text) if m.end(m.lastindex) - m.start(m.lastindex) >= least]
    mixed = [(a, b) for a, b in keys if all(re.search(sort, text[a:b]) for sort in (b"[0-9]", b"[a-z]", b"[A-Z]"))]
    if mixed:
        others = sorted(x for kind in KINDS for x in spans[kind])
        reach = np.maximum.accumulate([b for _, b in others]) if others else np.zeros(0)
        before = np.searchsorted([a for a, _ in others], [b for _, b in mixed])  # those that begin before a run ends
        spans["key"] = [x for x, n in zip(mixed, before) if not n or reach[n - 1] <= x[0]]
    return {kind: np.array(x, dtype=np.int64).reshape(-1, 2) for kind, x in spans.items()}


def partners(weak: np.ndarray, low: np.ndarray, high: np.ndarray, parts: dict[str, np.ndarray], kinds: tuple[str, ...]) -> list:
    """For each weak candidate the first part (kind, start, end) of one of the kinds inside its interval, or None.

    Parts of a kind do not overlap, so the first that begins inside an interval lies in it or none does.
    """
    out: list = [None] * len(weak)
    for kind in kinds:
        part = parts[kind]
        if len(part):
            at = np.searchsorted(part[:, 0], low)
            there = (at < len(part)) & (part[np.minimum(at, len(part) - 1), 1] <= high)
            for i in np.flatnonzero(there):
                found = (kind, *part[at[i]].tolist())
                if out[i] is None or found[1] < out[i][1]:
                    out[i] = found
    return out


def linked(text: bytes, hexes: list, keys: list, reach: int) -> list[tuple]:
    """(kind, start, end, partners) in code points of what a text reports, by start and kind."""
    parts = candidates(text, hexes, keys)
    if not any(len(x) for x in parts.values()):
        return []
    blank = np.array([m.span() for m in _BLANK.finditer(text)], dtype=np.int64).reshape(-1, 2)
    if not text.isascii():
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
        parts, blank = {kind: points[x] for kind, x in parts.items()}, points[blank]
    out = []
    for order, kind in enumerate(KINDS):
        spans = parts[kind]
        sets = COMPLEMENTS.get(kind, ())
        if sets and len(spans):
            behind = np.searchsorted(blank[:, 0], spans[:, 0])  # blank lines before the candidate
            low = np.maximum(spans[:, 0] - reach, np.concatenate([[0], blank[:, 1]])[behind])
            high = np.minimum(spans[:, 1] + reach, np.concatenate([blank[:, 0], [np.iinfo(np.int64).max]])[behind])
            met = [partners(spans, low, high, parts, kinds) for kinds in sets]
        else:
            met = []
        for i, (start, end) in enumerate(spans.tolist()):
            found = [m[i] for m in met]
            if all(found):
                out.append((start, order, kind, end, [f"{k}:{a}:{b}" for k, a, b in found]))
    return [(kind, start, end, found) for start, _, kind, end, found in sorted(out)]


def link_credentials(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, spans (kind, start, end, value, partners): one row for each row of ``docs`` (doc_id, text; no other is read).

    Starts and ends are code points, ends exclusive; spans stand by start, then kind. ``assign``, ``access`` and ``hex`` are
    always reported, other kinds only with their complements in scope: within ``reach`` code points and no blank line
    between. ``partners`` names the first complement of each needed sort. A random-looking word that overlaps another
    candidate is not one of its own. Null and empty texts have no spans; null ids stay null; repeated rows are answered
    each; an empty table gives no rows. Whole texts of any length are read; the join is a search in sorted bounds of one
    text, so many candidates in a scope make no pairs. Row-local: no shuffle.
    """

    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                data = np.frombuffer(b"\n".join(t or b"" for t in texts), dtype=np.uint8)
                begin = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
                runs = []
                for of, least in ((_HEX, 24), (_KEY, 20)):
                    start, end = long_runs(data, of, least)
                    doc = np.searchsorted(begin, start, side="right") - 1
                    own: dict[int, list] = {}
                    for d, a, b in zip(doc.tolist(), (start - begin[doc]).tolist(), (end - begin[doc]).tolist()):
                        own.setdefault(d, []).append((a, b))
                    runs.append(own)
                rows = []
                for i, text in enumerate(texts):
                    found = linked(text, runs[0].get(i, []), runs[1].get(i, []), reach) if text else []
                    plain = text.decode("utf-8", "replace") if found else ""
                    rows.append([{"kind": k, "start": a, "end": b, "value": plain[a:b], "partners": p} for k, a, b, p in found])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(rows, SPANS)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long, value: string, partners: array<string>>>")


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("partners", pa.list_(pa.string()))]))


def _matches_sql(kind: str) -> str:
    """Places of all matches of a kind: what stands between them and they themselves, added up."""
    pattern, least = PATTERNS[kind]
    p = pattern.replace("'", "''")
    value = 2 if pattern.count("(") - pattern.count("(?") > 1 else 1
    mixed = "AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')" if kind == "key" else ""
    return f"""SELECT rid, '{kind}' AS kind, {KINDS.index(kind)} AS ord, s AS a, s + length(m) AS b FROM (
    SELECT rid, ms[i] AS m, vs[i] AS v, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {value}) AS vs,
      regexp_split_to_array(text, '{p}') AS ps FROM d))) WHERE length(v) >= {least} {mixed}"""


def _linked_sql() -> str:
    has = lambda kinds: f"""EXISTS (SELECT 1 FROM c p WHERE p.rid = c.rid AND p.para = c.para AND p.kind IN ({', '.join(f"'{k}'" for k in kinds)})
      AND p.a >= c.a - {REACH} AND p.b <= c.b + {REACH})"""  # noqa: E731
    weak = " ".join(f"WHEN '{kind}' THEN {' AND '.join(has(kinds) for kinds in sets)}" for kind, sets in COMPLEMENTS.items())
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS MATERIALIZED ({' UNION ALL '.join(_matches_sql(kind) for kind in KINDS)}),
c AS MATERIALIZED (SELECT f.*, len(regexp_extract_all(substr(text, 1, a), '{BLANK_LINE}')) AS para FROM found f JOIN d USING (rid)
  WHERE kind <> 'key' OR NOT EXISTS (SELECT 1 FROM found o WHERE o.rid = f.rid AND o.kind <> 'key' AND o.a < f.b AND o.b > f.a)),
kept AS (SELECT * FROM c WHERE CASE kind {weak} ELSE true END),
t AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) AS spans FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (rid)"""


@query("op11_credential_links", _linked_sql())
def credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole document, with the weak candidates that their surroundings complete."""
    found = link_credentials(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
