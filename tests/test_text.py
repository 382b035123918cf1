"""Scalar functions against plain Python."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from statuteflow.functions import fixed as V
from statuteflow.functions import scoring as P
from statuteflow.functions import text as T
from statuteflow.functions.embeddings import feature_hash_embedding

TEXTS = [
    "", " ", "a", "Rule text  \r\nNext\t\n", "Rule text\nNext", "No break here. Next one! 3 more? yes",
    " wide　space line", "x. A. B. C", "Über-große Straße é è", "one two", "one two three four one two three",
]


def one(spark, rows, *columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_normalize_and_hashes(spark):
    got = one(spark, TEXTS, T.normalize_ws("t"), T.content_hash("t"), T.clause_hash("t"))
    for text, (norm, content, clause) in zip(TEXTS, got):
        assert norm == " ".join(text.split())
        lines = "\n".join(line.rstrip() for line in text.replace("\r\n", "\n").split("\n")).strip()
        assert content == hashlib.sha256(lines.encode()).hexdigest()
        assert clause == hashlib.sha256(" ".join(text.lower().split()).encode()).hexdigest()


def test_line_endings_make_no_version(spark):
    (a,), (b,) = one(spark, ["Rule text  \r\n", "Rule text\n"], T.content_hash("t"))
    assert a == b


def test_sentences(spark):
    for text, (got,) in zip(TEXTS, one(spark, TEXTS, T.sentences("t"))):
        parts = re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", " ".join(text.split()))
        assert got == [p for p in parts if p]


def test_sentences_keep_digits_of_their_position(spark):
    text = "Zero. 19.37.233.111! 2 is two? 33 or 3. 4444"
    assert one(spark, [text], T.sentences("t")) == [(["Zero.", "19.37.233.111!", "2 is two?", "33 or 3.", "4444"],)]


def test_tokens_and_shingles(spark):
    for text, (words, grams) in zip(TEXTS, one(spark, TEXTS, T.tokens("t"), T.shingles("t"))):
        expected = re.findall("[a-z0-9]+", text.lower())
        assert words == expected
        assert set(grams) == {" ".join(expected[i : i + 3]) for i in range(max(1, len(expected) - 2))}


@pytest.mark.parametrize(
    "text, stratum",
    [
        ("Licensees must keep each record for a year.", "record_retention_requirement"),
        ("No person shall enter.", "prohibition"),
        ("An operator must notify the agency.", "reporting_requirement"),
        ("The Minister may act.", "permission"),
        ("Vessel includes a raft.", "definition"),
        ("The owner shall act.", "obligation"),
        ("Short title.", "non_obligation"),
    ],
)
def test_strata(spark, text, stratum):
    assert one(spark, [text], T.sampling_stratum("t")) == [(stratum,)]


def test_aware_timestamp(spark):
    cases = {
        "2026-02-01T10:00:00Z": True, "2026-02-01 10:00:00+05:30": True, "2026-02-01T10:00:00": False,
        "2026-13-01T10:00:00Z": False, "2026-02-30T10:00:00Z": False, "yesterday": False, "2026-02-01T10:00:00.123456-0400": True,
    }
    assert [v for (v,) in one(spark, list(cases), T.aware_timestamp("t"))] == list(cases.values())


def test_deadline_and_modality(spark):
    cases = ["file within 30 business days of it", "answer no later than May 1, or so", "send by the end; then", "review annually", "wait"]
    assert [v for (v,) in one(spark, cases, T.deadline("t"))] == [
        "within 30 business days", "no later than May 1", "by the end", "annually", None
    ]
    assert [v for (v,) in one(spark, ["Must  NOT", "are required to", "may"], T.modality("t"))] == ["must_not", "required_to", None]


def test_label_answer(spark):
    good = '{"label":"permission","confidence":0.5,"rationale":"r"}'
    cases = [good, good.replace("0.5", "true"), good.replace("0.5", "2"), good.replace("permission", "x"), "[]", good[:-1] + ',"z":1}']
    assert [v for (v,) in one(spark, cases, T.label_answer_reject("t"))] == [
        None, "confidence_not_a_number", "confidence_out_of_range", "unknown_label", "not_json", "wrong_fields"
    ]


def test_calibration_bins(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.819, 0.82, 0.869, 0.87, 1.0)], "x double")
    assert [r[0] for r in rows.select(P.calibrate("x")).collect()] == [0.727, 0.727, 0.8, 0.8, 0.875, 0.875]


def test_temperature(spark):
    probs = {"a": 0.7, "b": 0.2, "c": 0.1}
    df = spark.createDataFrame([(probs,)], "p map<string,double>")
    got = df.select(P.temperature_scale("p", 2.0)).first()[0]
    scaled = {k: math.exp(math.log(v) / 2) for k, v in probs.items()}
    for k in probs:
        assert got[k] == pytest.approx(scaled[k] / sum(scaled.values()))


def test_delays(spark):
    rows = spark.createDataFrame([(i,) for i in range(1, 20)], "n int")
    got = rows.select(P.retry_delay("n"), P.outbox_delay("n")).collect()
    assert [r[0] for r in got] == [min(300, 5 * 2 ** (n - 1)) for n in range(1, 20)]
    assert [r[1] for r in got] == [min(300, 2 ** (n - 1)) if n < 10 else None for n in range(1, 20)]


def test_feature_hash_embedding(spark):
    texts = ["report incident within 24 hours report", "", "records"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["embedding"] for r in feature_hash_embedding(df, "i", "t").collect()}
    for i, text in enumerate(texts):
        vector = [0.0] * V.EMBEDDING_DIMENSIONS
        for token in re.findall("[a-z0-9]+", text.lower()):
            digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
            vector[int.from_bytes(digest[:4], "big") % V.EMBEDDING_DIMENSIONS] += 1.0 if digest[4] & 1 else -1.0
        norm = math.sqrt(sum(x * x for x in vector)) or 1.0
        assert got[i] == pytest.approx([x / norm for x in vector], abs=1e-6)


def test_unescape_and_html(spark):
    from statuteflow.sources.documents import html_to_text

    page = "<html><script>var a='<p>x</p>'</script><p>4.2 A&amp;B &#233;&#x20AC; &unknown; <b>bold</b></p><!-- no --></html>"
    assert one(spark, [page], html_to_text("t")) == [("4.2 A&B é€ &unknown;\nbold",)]


def test_html_sql_states_the_same_rule(spark):
    import duckdb

    from statuteflow.plans import load
    from statuteflow.sources.documents import html_to_text

    pages = ["a&amp&amp;amp;&ampx &notit; &notin; &copy", "&#38;&#x26&#0;&#00150;&#129;&#xD800;&#1114112;&#99999999999;", "one\rtwo&#13;three&#10 four &;&", "", None,
             "<p>a &lt;b&gt c&quot</p>\n&nbsp;x&nbsp; <!-- &amp -->"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(pages)))
    want = [(text,) for _, text in con.execute(load().CHECKS["a2_html_to_text"] + " ORDER BY page_id").df().astype(object).where(lambda f: f.notna(), None).values.tolist()]
    assert one(spark, pages, html_to_text("t")) == want
    assert want[0] == ("a&&amp;&ampx &notit; ∉ ©",)


def test_embedding_sql_knows_counts_that_cancel(spark):
    import duckdb

    from statuteflow.plans import load

    texts = ["w4 w69", "w4 w69 w69", "w4 w4 w69 w69 " + "x" * 300, "", "...", "a", "a a"]  # w4 and w69: one bucket, two signs
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = [norm for _, _, norm in sorted(con.execute(load().CHECKS["b14_feature_hash_embedding"]).df().values.tolist())]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = feature_hash_embedding(df, "i", "t").orderBy("i").select(F.round(P.dot(F.col("embedding"), F.col("embedding")), 4))
    assert [r[0] for r in out.collect()] == want == [0, 1, 1, 0, 0, 1, 1]
