"""B: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import scoring as P
from ..functions import text as T
from ..functions.embeddings import feature_hash_embedding
from ..functions.ordered import set_fingerprint
from . import inputs as I
from . import sql as S
from .registry import as_text, query

docs = lambda spark, d: I.table(spark, d, "documents")


@query("b1_content_hash", f"SELECT doc_id, {S.content_hash('text')} AS content_hash FROM documents")
def b1(spark, d):
    return docs(spark, d).select("doc_id", T.content_hash("text").alias("content_hash"))


@query("b2_section_content_hash", "SELECT doc_id, sha256(source || chr(10) || text) AS section_hash FROM documents")
def b2(spark, d):
    return docs(spark, d).select("doc_id", T.section_content_hash("source", "text").alias("section_hash"))


@query("b3_clause_hash", f"SELECT doc_id, {S.clause_hash('text')} AS clause_hash FROM documents")
def b3(spark, d):
    return docs(spark, d).select("doc_id", T.clause_hash("text").alias("clause_hash"))


@query(
    "b4_obligation_fingerprint",
    f"SELECT doc_id, sha256(source || '|' || 'must' || '|' || {S.ws('lower(text)')}) AS fingerprint FROM documents",
)
def b4(spark, d):
    return docs(spark, d).select("doc_id", T.obligation_fingerprint("source", F.lit("must"), "text").alias("fingerprint"))


@query("b5_normalize_ws", f"SELECT doc_id, {S.ws('text')} AS text FROM documents")
def b5(spark, d):
    return docs(spark, d).select("doc_id", T.normalize_ws("text").alias("text"))


@query(
    "b6_split_sentences",
    f"""SELECT doc_id, unnest({S.sentences('text')}) AS sentence,
    generate_subscripts({S.sentences('text')}, 1) AS position FROM documents""",
)
def b6(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.sentences("text")).alias("p", "sentence")).select(
        "doc_id", "sentence", (F.col("p") + 1).cast("bigint").alias("position")
    )


@query(
    "b7_tokens",
    f"""WITH t AS (SELECT doc_id, unnest({S.tokens('text')}) AS token FROM documents)
    SELECT token, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM t GROUP BY token""",
)
def b7(spark, d):
    # Counted per (token, document) first: the second step then only counts rows, with no distinct.
    per_doc = (
        docs(spark, d).select("doc_id", F.explode(T.tokens("text")).alias("token")).groupBy("token", "doc_id")
        .agg(F.count("*").alias("tf"))
    )
    return per_doc.groupBy("token").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("documents"))


@query(
    "b8_shingles",
    f"""WITH w AS (SELECT doc_id, {S.tokens('text')} AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1),
      lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS s FROM w)
    SELECT doc_id, len(s) AS shingles, md5(array_to_string(list_sort(s), '|')) AS digest FROM s""",
)
def b8(spark, d):
    s = docs(spark, d).select("doc_id", T.shingles("text").alias("s"))
    return s.select(
        "doc_id", F.size("s").cast("bigint").alias("shingles"), F.md5(F.array_join(F.sort_array("s"), "|")).alias("digest")
    )


@query("b9_stable_rank", f"SELECT doc_id, {S.stable_rank('seed-1', 'source', 'doc_id::VARCHAR')} AS rank_hash FROM documents")
def b9(spark, d):
    return docs(spark, d).select(
        "doc_id", T.stable_rank("seed-1", "source", F.col("doc_id").cast("string")).alias("rank_hash")
    )


_BUCKET = S.bucket("sha256('clause-split-v1:' || doc_id)", 100)


@query("b10_document_bucket", f"SELECT doc_id, {_BUCKET} AS bucket FROM documents")
def b10(spark, d):
    return docs(spark, d).select("doc_id", T.document_bucket(F.col("doc_id").cast("string"), "clause-split-v1").alias("bucket"))


@query(
    "b11_sampling_stratum",
    f"WITH {I.RULE_BOOK_SQL} SELECT section_id, {S.stratum('body')} AS stratum FROM rsections",
)
def b11(spark, d):
    return I.rule_book(spark, d).select("section_id", T.sampling_stratum("body").alias("stratum"))


@query(
    "b12_aware_timestamp",
    """WITH t AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS naive,
      json_extract_string(props, '$.k')::INT AS k FROM events),
    v AS (SELECT event_id, CASE WHEN k % 4 = 0 THEN naive WHEN k % 4 = 1 THEN naive || 'Z'
      WHEN k % 4 = 2 THEN naive || '+05:30' ELSE substr(naive, 1, 5) || '13' || substr(naive, 8) || 'Z' END AS value,
      k FROM t)
    SELECT event_id, value, k % 4 IN (1, 2) AS aware FROM v""",
)
def b12(spark, d):
    e = I.table(spark, d, "events").select(
        "event_id",
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("naive"),
        (F.get_json_object("props", "$.k").cast("int") % 4).alias("k"),
    )
    value = (
        F.when(F.col("k") == 0, F.col("naive"))
        .when(F.col("k") == 1, F.concat("naive", F.lit("Z")))
        .when(F.col("k") == 2, F.concat("naive", F.lit("+05:30")))
        .otherwise(F.concat(F.substring("naive", 1, 5), F.lit("13"), F.substring("naive", 8, 40), F.lit("Z")))
    )
    return e.select("event_id", value.alias("value")).withColumn("aware", T.aware_timestamp("value"))


@query(
    "b13_cosine",
    """WITH c AS (SELECT label, list_transform(generate_series(1, 64), lambda i: 0.0) AS z FROM embeddings GROUP BY label),
    x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    m AS (SELECT label, i, avg(v) AS mean FROM x GROUP BY ALL),
    k AS (SELECT label, list(mean ORDER BY i) AS centroid FROM m GROUP BY label)
    SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], k.centroid), 6) AS cosine
    FROM embeddings e JOIN k USING (label)""",
)
def b13(spark, d):
    e = I.table(spark, d, "embeddings")
    return e.join(label_centroids(e), "label").select("vec_id", F.round(P.cosine("embedding", "centroid"), 6).alias("cosine"))


def label_centroids(e):
    """Mean vector of each label: 64 averages as one aggregate, folded on the map side."""
    means = [F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64)]
    return e.groupBy("label").agg(F.array(*means).alias("centroid"))


# BLAKE2b (RFC 7693) in SQL: start values, and the words of the message in the order of each round.
_IV = (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1,
       0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)
_SIGMA = ("0123456789abcdef", "ea489fd61c02b753", "b8c052fdae367194", "7931dcbe265a40f8", "905724afe1bc683d",
          "2c6a0b834d75fe19", "c51fed4a0763928b", "db7ec13950f4862a", "6fe9b308c2d714a5", "a2847615fb9e3cd0")
_QUARTERS = (((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15)), ((0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)))


def _blake2b_sql(texts: str) -> str:
    """CTEs up to ``digests``: text, word (the first 8 bytes of its hash, as one number) of the distinct ``text`` of a table."""
    word = lambda i: "('0x' || " + " || ".join(f"substr(part, {16 * i + 15 - 2 * k}, 2)" for k in range(8)) + ")::UBIGINT"
    add = lambda *terms: "((" + " + ".join(f"{t}::UHUGEINT" for t in terms) + ") % 18446744073709551616)::UBIGINT"
    turn = lambda x, n: f"(({x} >> {n}) + ({x} & {(1 << n) - 1}::UBIGINT) * {1 << (64 - n)}::UBIGINT)"
    kept = "text, bytes, size, block, last, " + ", ".join(f"h{i}" for i in range(8)) + ", " + ", ".join(f"m{i}" for i in range(16))
    steps = []

    def step(changed: dict[int, str]) -> None:
        state = ", ".join(f"{changed.get(i, f'v{i}')} AS v{i}" for i in range(16))
        steps.append(f"s{len(steps) + 1} AS (SELECT {kept}, {state} FROM s{len(steps)})")

    for turns in range(12):
        order = [int(x, 16) for x in _SIGMA[turns % 10]]
        for half, quarters in enumerate(_QUARTERS):
            m = [order[8 * half + 2 * q : 8 * half + 2 * q + 2] for q in range(4)]
            for i, (first, second) in enumerate(((32, 24), (16, 63))):
                step({a: add(f"v{a}", f"v{b}", f"m{m[q][i]}") for q, (a, b, _, _) in enumerate(quarters)})
                step({d: turn(f"xor(v{d}, v{a})", first) for a, _, _, d in quarters})
                step({c: add(f"v{c}", f"v{d}") for _, _, c, d in quarters})
                step({b: turn(f"xor(v{b}, v{c})", second) for _, b, c, _ in quarters})
    begin = ", ".join([*[f"h{i} AS v{i}" for i in range(8)], *[f"{x}::UBIGINT AS v{8 + i}" for i, x in enumerate(_IV) if i not in (4, 6)],
                       f"xor({_IV[4]}::UBIGINT, CASE WHEN last THEN size ELSE 128 * (block + 1) END::UBIGINT) AS v12",
                       f"CASE WHEN last THEN xor({_IV[6]}::UBIGINT, {(1 << 64) - 1}::UBIGINT) ELSE {_IV[6]}::UBIGINT END AS v14"])
    return f"""
    hashed AS (SELECT text, rpad(hex(text), (256 * greatest(1, (strlen(text) + 127) // 128))::INT, '0') AS bytes, strlen(text) AS size, 0 AS block,
        {_IV[0] ^ 0x01010008}::UBIGINT AS h0, {', '.join(f'{x}::UBIGINT AS h{i}' for i, x in enumerate(_IV) if i)} FROM (SELECT DISTINCT text FROM {texts})
      UNION ALL (
        WITH b AS (SELECT *, substr(bytes, 256 * block + 1, 256) AS part, 256 * (block + 1) = len(bytes) AS last FROM hashed WHERE 256 * block < len(bytes)),
        w AS (SELECT *, {', '.join(f'{word(i)} AS m{i}' for i in range(16))} FROM b),
        s0 AS (SELECT {kept}, {begin} FROM w), {', '.join(steps)}
        SELECT text, bytes, size, block + 1, {', '.join(f'xor(h{i}, xor(v{i}, v{i + 8}))' for i in range(8))} FROM s{len(steps)})),
    digests AS (SELECT text, h0 AS word FROM hashed WHERE 256 * block = len(bytes))"""


# The counts of a text are signed: where all of them cancel, its vector is zero although it has tokens.
_FIRST_FOUR = "(word & 255) * 16777216 + ((word >> 8) & 255) * 65536 + ((word >> 16) & 255) * 256 + ((word >> 24) & 255)"


@query(
    "b14_feature_hash_embedding",
    f"""WITH RECURSIVE numbered AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, text AS body FROM documents),
    used AS MATERIALIZED (SELECT n, token AS text, count(*) AS times FROM (SELECT n, unnest({S.tokens('body')}) AS token FROM numbered) GROUP BY ALL),
    {_blake2b_sql('used')},
    buckets AS (SELECT n, ({_FIRST_FOUR}) % 384 AS bucket, sum(CASE WHEN (word >> 32) & 1 = 1 THEN times ELSE -times END) AS value
      FROM used JOIN digests USING (text) GROUP BY ALL),
    lengths AS (SELECT n, bool_or(value <> 0) AS nonzero FROM buckets GROUP BY n)
    SELECT doc_id, 384 AS dimensions, CASE WHEN nonzero THEN 1.0::DOUBLE ELSE 0 END AS norm FROM numbered LEFT JOIN lengths USING (n)""",
)
def b14(spark, d):
    out = feature_hash_embedding(docs(spark, d), "doc_id", "text")
    return out.select("doc_id", F.size("embedding").alias("dimensions"), F.round(P.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


@query(
    "b15_set_fingerprint",
    f"""WITH r AS (SELECT sha256('{{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}}') AS h
    FROM documents) SELECT {S.fingerprint('h')} FROM r""",
)
def b15(spark, d):
    return set_fingerprint(docs(spark, d), ["doc_id", "lang", "source"])


@query("b17_vector_dimension", "SELECT vec_id, len(embedding) = 384 AS fits_model, len(embedding) = 64 AS fits_table FROM embeddings")
def b17(spark, d):
    return I.table(spark, d, "embeddings").select(
        "vec_id", P.has_dimension("embedding").alias("fits_model"), P.has_dimension("embedding", 64).alias("fits_table")
    )


_VERBS = ("must", "Shall  NOT", "are required to", "may", "MUST not", "is  required to", "shall")


@query(
    "b18_modality",
    f"""WITH v AS (SELECT event_id, [{', '.join(S.lit(v) for v in _VERBS)}][event_id % 7 + 1] AS verb FROM events)
    SELECT event_id, verb, {S.modality('verb')} AS modality FROM v""",
)
def b18(spark, d):
    verb = F.element_at(F.array(*[F.lit(v) for v in _VERBS]), (F.col("event_id") % 7 + 1).cast("int"))
    return I.table(spark, d, "events").select("event_id", verb.alias("verb")).withColumn("modality", T.modality("verb"))


@query(
    "b19_deadline",
    f"""WITH a AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'file it within ' || user_id || ' business days of it'
      WHEN 'view' THEN 'answer no later than day ' || user_id || ', or sooner' WHEN 'error' THEN 'send it by the ' || user_id || ' of May.'
      WHEN 'signup' THEN 'review it Quarterly and annually' ELSE 'keep it' END AS action FROM events)
    SELECT event_id, action, {S.deadline('action')} AS deadline FROM a""",
)
def b19(spark, d):
    user = F.col("user_id").cast("string")
    action = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("file it within "), user, F.lit(" business days of it")))
        .when(F.col("event_type") == "view", F.concat(F.lit("answer no later than day "), user, F.lit(", or sooner")))
        .when(F.col("event_type") == "error", F.concat(F.lit("send it by the "), user, F.lit(" of May.")))
        .when(F.col("event_type") == "signup", F.lit("review it Quarterly and annually"))
        .otherwise("keep it")
    )
    return I.table(spark, d, "events").select("event_id", action.alias("action")).withColumn("deadline", T.deadline("action"))


@query("b20_calibrate", f"SELECT event_id, round(value / 500, 3) AS raw, {S.calibrate('round(value / 500, 3)')} AS calibrated FROM events")
def b20(spark, d):
    return I.table(spark, d, "events").select("event_id", F.round(F.col("value") / 500, 3).alias("raw")).withColumn(
        "calibrated", P.calibrate("raw")
    )


_PROBS = [f"(((vec_id * {7 + 3 * i} + label * {i + 1}) % 97) + 1)" for i in range(len(V.LABELS))]


@query(
    "b21_temperature_scale",
    f"""WITH r AS (SELECT vec_id, [{', '.join(_PROBS)}] AS w FROM embeddings),
    p AS (SELECT vec_id, list_transform(w, lambda x: x::DOUBLE / list_sum(w)) AS p FROM r),
    s AS (SELECT vec_id, list_transform(p, lambda x: exp(ln(greatest(x, 1e-12)) / 1.7)) AS s FROM p),
    q AS (SELECT vec_id, unnest(list_transform(s, lambda x: x / list_sum(s))) AS q,
          unnest([{', '.join(S.lit(x) for x in V.LABELS)}]) AS label FROM s),
    t AS (SELECT vec_id, label, q, row_number() OVER (PARTITION BY vec_id ORDER BY round(q, 12) DESC, label) AS rn FROM q)
    SELECT vec_id, label, round(q, 6) AS confidence, q < 0.25 AS abstained FROM t WHERE rn = 1""",
)
def b21(spark, d):
    return scored_vectors(spark, d, 1.7).select(
        "vec_id", "top.label", F.round("top.confidence", 6).alias("confidence"),
        (F.col("top.confidence") < 0.25).alias("abstained"),
    )


def vector_probabilities(spark, d):
    """A probability map per vector, made from its id and label."""
    weights = [((F.col("vec_id") * (7 + 3 * i) + F.col("label") * (i + 1)) % 97 + 1).cast("double") for i in range(len(V.LABELS))]
    e = I.table(spark, d, "embeddings").select("vec_id", "label", F.array(*weights).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    return e.select(
        "vec_id", "label",
        F.map_from_arrays(F.array(*[F.lit(x) for x in V.LABELS]), F.transform("w", lambda x: x / total)).alias("probabilities"),
    )


def scored_vectors(spark, d, temperature):
    return vector_probabilities(spark, d).withColumn(
        "scaled", P.temperature_scale("probabilities", temperature)
    ).withColumn("top", P.top_label(F.transform_values("scaled", lambda _, p: F.round(p, 12))))


@query(
    "b22_retry_delay",
    """SELECT event_id, least(300, 5 * power(2, user_id % 12))::BIGINT AS ingestion_seconds,
    (CASE WHEN user_id % 12 + 1 < 10 THEN least(300, power(2, user_id % 12)) END)::BIGINT::VARCHAR AS outbox_seconds,
    least(1440, 15 * power(2, user_id % 12 + 1))::BIGINT AS source_minutes FROM events""",
)
def b22(spark, d):
    attempt = F.col("user_id") % 12 + 1
    return as_text(
        I.table(spark, d, "events").select(
            "event_id",
            P.retry_delay(attempt).alias("ingestion_seconds"),
            P.outbox_delay(attempt).alias("outbox_seconds"),
            P.source_delay(F.lit(15), attempt).alias("source_minutes"),
        ),
        "outbox_seconds",
    )


@query(
    "b23_url_policy",
    """WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
      lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages),
    allowed AS (SELECT host FROM u GROUP BY host HAVING count(*) >= 3)
    SELECT page_id, CASE WHEN scheme <> 'https' THEN 'not_https' WHEN host NOT IN (SELECT host FROM allowed) THEN 'host_not_allowed'
      END AS reject FROM u""",
)
def b23(spark, d):
    from ..operators.operations import url_policy

    pages = I.table(spark, d, "pages").select("page_id", "url")
    hosts = pages.select(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host")).groupBy("host").count().where("count >= 3")
    return url_policy(pages, hosts.select("host")).select("page_id", "reject")


@query("b24_truncate", "SELECT doc_id, substr(text, 1, 400) AS body, length(text) > 400 AS body_truncated FROM documents")
def b24(spark, d):
    body, flag = T.truncate_with_flag("text", 400)
    return docs(spark, d).select("doc_id", body.alias("body"), flag.alias("body_truncated"))


_ANSWER = {
    0: '{"label":"permission","confidence":0.5,"rationale":"ok"}',
    1: '{"label":"permission","confidence":true,"rationale":"ok"}',
    2: '{"label":"unheard","confidence":0.5,"rationale":"ok"}',
    3: '{"label":"permission","confidence":1.5,"rationale":"ok"}',
    4: '{"label":"permission","confidence":0.5,"rationale":"  "}',
    5: '{"label":"permission","confidence":0.5}',
    6: "no json",
    7: '{"label":"definition","confidence":1,"rationale":"r","extra":1}',
}
_REJECTS = {1: "confidence_not_a_number", 2: "unknown_label", 3: "confidence_out_of_range", 4: "blank_rationale",
            5: "wrong_fields", 6: "not_json", 7: "wrong_fields"}


@query(
    "b25_label_answer",
    "SELECT event_id, CASE (event_id + user_id) % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _REJECTS.items())
    + " END AS reject FROM events",
)
def b25(spark, d):
    answer = F.element_at(F.array(*[F.lit(a) for a in _ANSWER.values()]), ((F.col("event_id") + F.col("user_id")) % 8 + 1).cast("int"))
    return I.table(spark, d, "events").select("event_id", answer.alias("a")).select("event_id", T.label_answer_reject("a").alias("reject"))


@query(
    "b26_trace_id",
    f"""WITH t AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '00-' || repeat('0', 32) || '-' || substr(md5(props), 1, 16) || '-01'
      WHEN event_type = 'view' THEN '01-' || md5(event_id::VARCHAR) || '-x'
      ELSE '00-' || upper(md5(event_id::VARCHAR)) || '-' || substr(md5(props), 1, 16) || '-01' END AS header FROM events)
    SELECT event_id, nullif(nullif(regexp_extract(lower(header), {S.lit(V.TRACEPARENT)}, 1), ''), repeat('0', 32)) AS trace_id FROM t""",
)
def b26(spark, d):
    span = F.substring(F.md5("props"), 1, 16)
    event = F.md5(F.col("event_id").cast("string"))
    header = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("00-" + "0" * 32 + "-"), span, F.lit("-01")))
        .when(F.col("event_type") == "view", F.concat(F.lit("01-"), event, F.lit("-x")))
        .otherwise(F.concat(F.lit("00-"), F.upper(event), F.lit("-"), span, F.lit("-01")))
    )
    return I.table(spark, d, "events").select("event_id", T.trace_id(header).alias("trace_id"))
