"""L, M: operational rules over orders and events, and the content scan over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as V
from ..operators import jobs as J
from ..operators import operations as O
from ..operators import scanning as N
from ..streaming import live
from . import inputs as I
from . import sql as S
from .registry import query

AS_OF = "2001-01-01 00:00:00"


def tenant(column):
    return F.concat(F.lit("org-"), (F.col(column) % 5).cast("string"))


def jobs(spark, d):
    """Orders as ingestion jobs: F completed, O queued, P dead, the urgent ones failed."""
    return I.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), tenant("o_custkey").alias("organization_id"), F.col("o_custkey").alias("regulation_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "failed").when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "queued").otherwise("dead_letter").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.substring(F.md5(F.col("o_totalprice").cast("int").cast("string")), 1, 2).alias("content_hash"),
    )


JOBS_SQL = """jobs AS (SELECT o_orderkey AS job_id, 'org-' || (o_custkey % 5) AS organization_id, o_custkey AS regulation_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'dead_letter' END AS status,
  o_orderdate AS created_at, substr(md5(trunc(o_totalprice)::INT::VARCHAR), 1, 2) AS content_hash FROM orders)"""


def outbox(spark, d):
    at = F.col("o_orderdate").cast("timestamp")
    return I.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("event_id"), tenant("o_custkey").alias("organization_id"), at.alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", at).alias("published_at"),
        F.when(F.col("o_orderpriority") == "1-URGENT", at).alias("dead_lettered_at"),
        F.when(F.col("o_orderpriority") == "2-HIGH", at + F.expr("INTERVAL 300 DAYS")).alias("next_attempt_at"),
    )


OUTBOX_SQL = """outbox AS (SELECT o_orderkey AS event_id, 'org-' || (o_custkey % 5) AS organization_id, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS published_at, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END AS dead_lettered_at,
  CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderdate + INTERVAL 300 DAY END AS next_attempt_at FROM orders)"""


def sources(spark, d):
    return I.table(spark, d, "customer").select(
        F.col("c_custkey").alias("source_id"), tenant("c_custkey").alias("organization_id"), (F.col("c_acctbal") > 0).alias("enabled"),
        (F.lit("2000-06-01 00:00:00").cast("timestamp") + F.make_interval(days=(F.col("c_custkey") * 7 % 400).cast("int"))).alias("next_check_at"),
    )


SOURCES_SQL = """sources AS (SELECT c_custkey AS source_id, 'org-' || (c_custkey % 5) AS organization_id, c_acctbal > 0 AS enabled,
  TIMESTAMP '2000-06-01' + to_days((c_custkey * 7 % 400)::INT) AS next_check_at FROM customer)"""


@query("l1_jobs_by_status", f"WITH {JOBS_SQL} SELECT organization_id, status, count(*) AS jobs FROM jobs GROUP BY ALL")
def l1(spark, d):
    return O.jobs_by_status(jobs(spark, d))


@query(
    "l2_queue_health",
    f"""WITH {JOBS_SQL}, {OUTBOX_SQL}, o AS (SELECT organization_id, count(*) FILTER (published_at IS NULL AND dead_lettered_at IS NULL) AS pending_outbox,
      count(*) FILTER (published_at IS NULL AND dead_lettered_at IS NOT NULL) AS exhausted_outbox FROM outbox GROUP BY 1)
    SELECT o.*, (SELECT count(*) FROM jobs j WHERE j.organization_id = o.organization_id AND status = 'dead_letter') AS dead_letter_jobs FROM o""",
)
def l2(spark, d):
    return O.queue_health(outbox(spark, d), jobs(spark, d))


def requests(spark, d):
    return as_requests(I.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


def as_requests(events):
    """Events as HTTP requests: an error is a 500, the value is the latency in hundredths of a second."""
    return events.select(
        F.col("event_id").alias("request_id"), "ts", F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/"), F.col("event_type")).alias("route"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.col("value") / 100).alias("duration"), F.concat(F.lit("client-"), (F.col("user_id") % 3).cast("string")).alias("client_id"),
        F.concat(F.lit("org-"), (F.col("user_id") % 2).cast("string")).alias("organization_id"),
        F.when(F.col("event_type") == "view", "search").otherwise("read").alias("scope"),
    )


REQUESTS_SQL = """requests AS (SELECT event_id AS request_id, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
  '/' || event_type AS route, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value / 100 AS duration,
  'client-' || (user_id % 3) AS client_id, 'org-' || (user_id % 2) AS organization_id, CASE WHEN event_type = 'view' THEN 'search' ELSE 'read' END AS scope FROM events)"""


@query(
    "l3_request_metrics",
    f"WITH {REQUESTS_SQL} SELECT method, route, status, count(*) AS requests, round(sum(duration), 4) AS latency_sum FROM requests GROUP BY ALL",
)
def l3(spark, d):
    return O.request_metrics(requests(spark, d)).select("method", "route", "status", "requests", F.round("latency_sum", 4).alias("latency_sum"))


@query(
    "l3_latency_histogram",
    f"""WITH {REQUESTS_SQL} SELECT method, route, le, count(*) FILTER (duration <= le) AS n FROM requests
    CROSS JOIN (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in V.LATENCY_BUCKETS)}]) AS le) GROUP BY ALL""",
)
def l3_histogram(spark, d):
    return O.latency_histogram(O.request_metrics(requests(spark, d)))


def _alert_sql(minutes, extra=""):
    return f"""SELECT epoch(time_bucket(INTERVAL {minutes} MINUTE, ts))::BIGINT AS window_start, {minutes} AS minutes, count(*) AS requests,
      count(*) FILTER (status >= 500) AS server_errors, count(*) FILTER (duration > 1) AS slow,
      {minutes} = 5 AND count(*) FILTER (status >= 500) * 100 > count(*) * 2 AS error_alert,
      {minutes} = 10 AND quantile_disc(duration, 0.95) > 1 AS latency_alert FROM requests GROUP BY 1 {extra}"""


def _seconds(df):
    return df.withColumn("window_start", F.unix_timestamp("window_start"))


@query("l4_alert_windows", f"WITH {REQUESTS_SQL} {_alert_sql(5)} UNION ALL {_alert_sql(10)}")
def l4(spark, d):
    r = requests(spark, d)
    return _seconds(O.alert_columns(O.window_facts(r, 5).unionByName(O.window_facts(r, 10))))


@query(
    "l4_backlog_alerts",
    f"""WITH {JOBS_SQL}, {OUTBOX_SQL}, d AS (SELECT organization_id, bool_or(status = 'dead_letter') AS dead_letter_alert FROM jobs GROUP BY 1),
    b AS (SELECT organization_id, min(created_at) < TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTE AS a FROM outbox WHERE published_at IS NULL AND dead_lettered_at IS NULL GROUP BY 1)
    SELECT organization_id, dead_letter_alert, coalesce(a, false) AS backlog_alert FROM d LEFT JOIN b USING (organization_id)""",
)
def l4_backlog(spark, d):
    return O.backlog_alerts(outbox(spark, d), jobs(spark, d), F.lit(AS_OF).cast("timestamp"))


def event_stream(spark, d):
    return live.read_events(spark, d, I.table(spark, d, "events").schema)


_CLOSED = "HAVING max(ts) IS NOT NULL AND time_bucket(INTERVAL {m} MINUTE, min(ts)) + INTERVAL {m} MINUTE <= (SELECT max(ts) FROM requests) - INTERVAL 10 MINUTE"


@query("l4_alert_stream", f"WITH {REQUESTS_SQL} {_alert_sql(10, _CLOSED.format(m=10))}")
def l4_stream(spark, d):
    return _seconds(live.drain(live.alert_windows(as_requests(event_stream(spark, d)), 10), "alerts"))


JOB_EVENTS = {"click": "claim", "view": "complete", "error": "error", "signup": "fail", "purchase": "replay"}


def job_events(events):
    """A user is a job; what they do are the job's events; seconds since the epoch."""
    name = F.create_map(*[F.lit(x) for pair in JOB_EVENTS.items() for x in pair])
    return events.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"), "ts", F.unix_timestamp("ts").alias("at"), "event_id",
        F.try_element_at(name, F.col("event_type")).alias("event"),
    )


# Leases last a day here, so that jobs get on between the sparse events of one user.
LEASE = 86_400
_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in JOB_EVENTS.items())
JOB_SQL = f"""
je AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS sec, event_id, CASE event_type {_CASE} END AS event,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)), event_id) AS n FROM events),
fold AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS sec, NULL::VARCHAR AS event, NULL::BOOLEAN AS accepted, 'queued' AS status, 0 AS attempts, 0 AS replays, 0::BIGINT AS nb, 0::BIGINT AS lu FROM je
  UNION ALL
  SELECT user_id, n, sec, event, ok, CASE WHEN NOT ok THEN status WHEN event = 'claim' THEN 'processing' WHEN event = 'complete' THEN 'completed' WHEN event = 'fail' THEN 'failed'
      WHEN event = 'error' THEN CASE WHEN attempts + 1 >= 5 THEN 'dead_letter' ELSE 'queued' END ELSE 'queued' END,
    CASE WHEN ok AND event = 'error' THEN attempts + 1 WHEN ok AND event = 'replay' THEN 0 ELSE attempts END,
    CASE WHEN ok AND event = 'replay' THEN replays + 1 ELSE replays END,
    CASE WHEN NOT ok THEN nb WHEN event = 'error' AND attempts + 1 < 5 THEN sec + least(300, 5 * power(2, attempts)::BIGINT) ELSE 0 END,
    CASE WHEN NOT ok THEN lu WHEN event = 'claim' THEN sec + {LEASE} ELSE 0 END
  FROM (SELECT j.*, f.status, f.attempts, f.replays, f.nb, f.lu, CASE j.event
      WHEN 'claim' THEN f.status IN ('queued', 'failed', 'processing') AND NOT (f.status = 'processing' AND f.lu > j.sec) AND f.nb <= j.sec
      WHEN 'replay' THEN f.status IN ('failed', 'dead_letter') ELSE f.status = 'processing' END AS ok
    FROM fold f JOIN je j ON j.user_id = f.user_id AND j.n = f.n + 1))"""


@query(
    "l5_job_states",
    f"WITH RECURSIVE {JOB_SQL} SELECT 'job-' || user_id AS job_id, sec AS seconds, event, accepted, status, attempts, replays FROM fold WHERE n > 0",
)
def l5(spark, d):
    events = I.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.fold_jobs(job_events(events), lease=LEASE).drop("not_before", "lease_until", "event_id").withColumnRenamed("at", "seconds")


def job_stream(spark, d):
    return live.drain(live.job_states(job_events(event_stream(spark, d)), lease=LEASE), "jobs")


@query(
    "l5_job_stream",
    f"WITH RECURSIVE {JOB_SQL} SELECT 'job-' || user_id AS job_id, sec AS at, event, accepted, status, attempts, replays FROM fold WHERE n > 0",
)
def l5_stream(spark, d):
    return job_stream(spark, d).where(F.col("event") != live.EXPIRED)


EXPIRY_SQL = f"""WITH RECURSIVE {JOB_SQL},
    f AS (SELECT user_id, event, lu, lead(sec) OVER (PARTITION BY user_id ORDER BY n) AS following FROM fold WHERE n > 0 AND accepted)
    SELECT 'job-' || user_id AS job_id, lu AS at FROM f, (SELECT epoch(max(ts)) - 600 AS mark FROM events)
    WHERE event = 'claim' AND lu <= coalesce(following, mark)"""


@query("l5_lease_expiries", EXPIRY_SQL)
def l5_expiries(spark, d):
    events = I.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    mark = events.agg(F.floor(F.unix_micros(F.max("ts")) / 1_000_000 - 600)).first()[0]
    return J.lease_expiries(J.fold_jobs(job_events(events), lease=LEASE), mark)


@query("l5_lease_stream", EXPIRY_SQL)
def l5_lease_stream(spark, d):
    return job_stream(spark, d).where(F.col("event") == live.EXPIRED).select("job_id", "at")


@query(
    "l6_dedupe_jobs",
    f"""WITH {JOBS_SQL} SELECT organization_id, regulation_id, content_hash, arg_min(job_id, (created_at, job_id)) AS job_id, count(*) AS requests FROM jobs GROUP BY ALL""",
)
def l6(spark, d):
    return O.dedupe_jobs(jobs(spark, d))


@query("l6_dedupe_stream", """SELECT user_id::VARCHAR AS organization_id, event_type AS regulation_id, json_extract_string(props, '$.k') AS content_hash FROM events GROUP BY ALL""")
def l6_stream(spark, d):
    jobs_ = event_stream(spark, d).select(
        "ts", F.col("user_id").cast("string").alias("organization_id"), F.col("event_type").alias("regulation_id"),
        F.get_json_object("props", "$.k").alias("content_hash"),
    )
    return live.drain(live.first_jobs(jobs_, "60 days"), "first-jobs").drop("ts")


@query(
    "l7_due_sources",
    f"WITH {SOURCES_SQL} SELECT source_id FROM sources WHERE enabled AND next_check_at <= TIMESTAMP '{AS_OF}' ORDER BY next_check_at, source_id LIMIT 100",
)
def l7(spark, d):
    return O.due_sources(sources(spark, d), F.lit(AS_OF).cast("timestamp")).select("source_id")


def checks(spark, d):
    """Events as fetches of sources: an error fails, a view is unchanged, the payload is the content."""
    k = F.get_json_object("props", "$.k")
    return I.table(spark, d, "events").select(
        F.col("user_id").alias("source_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("checked_at"), F.col("event_id").alias("check_id"),
        F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("event_type") == "view", 304).otherwise(200).alias("http_status"),
        F.when(F.col("event_type").isin("error", "view"), F.lit(None)).otherwise(k).alias("content_hash"), F.lit(60).alias("poll_minutes"),
    )


@query(
    "l8_source_checks",
    """WITH c AS (SELECT user_id AS source_id, epoch(date_trunc('second', ts))::BIGINT AS checked_at, event_id AS check_id, event_type, json_extract_string(props, '$.k') AS k FROM events),
    i AS (SELECT *, event_type = 'error' AS failed, sum((event_type <> 'error')::INT) OVER (PARTITION BY source_id ORDER BY checked_at, check_id) AS island,
      CASE WHEN event_type NOT IN ('error', 'view') THEN row_number() OVER (PARTITION BY source_id, event_type NOT IN ('error', 'view'), k ORDER BY checked_at, check_id) END AS seen FROM c),
    f AS (SELECT *, sum(failed::INT) OVER (PARTITION BY source_id, island ORDER BY checked_at, check_id)::BIGINT AS consecutive_failures FROM i)
    SELECT source_id, checked_at, check_id, CASE WHEN failed THEN 'failed' WHEN event_type = 'view' THEN 'unchanged' WHEN seen = 1 THEN 'change_queued' ELSE 'duplicate' END AS status,
      consecutive_failures, CASE WHEN failed THEN least(1440, 60 * power(2, consecutive_failures))::BIGINT ELSE 60 END AS next_check_minutes FROM f""",
)
def l8(spark, d):
    return O.source_check_fold(checks(spark, d), F.floor(F.col("checked_at") / 86_400))


@query(
    "l9_publishable_events",
    f"""WITH {OUTBOX_SQL} SELECT event_id FROM outbox WHERE published_at IS NULL AND dead_lettered_at IS NULL
    AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '{AS_OF}') ORDER BY created_at, event_id LIMIT 100""",
)
def l9(spark, d):
    return O.publishable_events(outbox(spark, d), F.lit(AS_OF).cast("timestamp")).select("event_id")


LIMITS = {"all": 2, "search": 1}
_RATE = """SELECT window_start, client_id, organization_id, scope, requests,
  least(requests, CASE WHEN scope = 'search' THEN 1 ELSE 2 END)::BIGINT AS allowed, greatest(requests - CASE WHEN scope = 'search' THEN 1 ELSE 2 END, 0)::BIGINT AS denied
  FROM (SELECT epoch(time_bucket(INTERVAL 1 MINUTE, ts))::BIGINT AS window_start, client_id, organization_id, scope, count(*) AS requests FROM requests GROUP BY ALL)"""


@query("l10_rate_limit", f"WITH {REQUESTS_SQL} {_RATE}")
def l10(spark, d):
    return _seconds(O.rate_limit(requests(spark, d), LIMITS))


@query(
    "l10_admitted_requests",
    f"""WITH {REQUESTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY client_id, organization_id, scope, date_trunc('minute', ts) ORDER BY ts, request_id) AS n FROM requests)
    SELECT request_id FROM n WHERE n <= CASE WHEN scope = 'search' THEN 1 ELSE 2 END""",
)
def l10_admitted(spark, d):
    return O.admitted_requests(requests(spark, d), LIMITS).select("request_id")


@query(
    "l10_rate_limit_stream",
    f"WITH {REQUESTS_SQL}, r AS ({_RATE}) SELECT * FROM r WHERE window_start + 60 <= (SELECT epoch(max(ts)) - 600 FROM requests)",
)
def l10_stream(spark, d):
    return _seconds(live.drain(live.rate_limit_windows(as_requests(event_stream(spark, d)), limits=LIMITS), "rate-limit"))


@query("l11_audit_trail", "SELECT event_id, user_id AS entity_id, event_type FROM events WHERE event_type = 'signup'")
def l11(spark, d):
    trail = I.table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("entity_id"), "event_type", F.lit("user").alias("entity_type"), F.col("ts").alias("created_at")
    )
    return O.audit_trail(trail, "user", "signup").select("event_id", "entity_id", "event_type")


@query("l12_newest_jobs", f"WITH {JOBS_SQL} SELECT job_id, status FROM jobs ORDER BY created_at DESC, job_id LIMIT 100")
def l12(spark, d):
    return O.newest_jobs(jobs(spark, d)).select("job_id", "status")


@query(
    "l13_dashboard_summary",
    f"""WITH {JOBS_SQL}, {SOURCES_SQL}, s AS (SELECT organization_id, count(*) FILTER (enabled) AS enabled_sources FROM sources GROUP BY 1)
    SELECT j.organization_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status IN ('failed', 'dead_letter')) AS failed, any_value(enabled_sources) AS enabled_sources
    FROM jobs j JOIN s USING (organization_id) GROUP BY 1""",
)
def l13(spark, d):
    return O.dashboard_summary(jobs(spark, d), sources(spark, d))


# --- M ----------------------------------------------------------------------------------------------------------

def _scan_sql(name: str, pattern: str, evidence: str, kept: str = "true") -> str:
    """All matches of a pattern in whole texts; their lines from what stands before them."""
    p = S.lit(pattern)
    lines = lambda x: f"coalesce(list_sum(list_transform({x}, lambda t: length(t) - length(replace(t, chr(10), '')))), 0)"
    return f"""SELECT doc_id::VARCHAR AS path, (1 + {lines('ps[1:i]')} + {lines('ms[1:i - 1]')})::INT AS line, '{name}' AS category, {evidence} AS evidence
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS ms, regexp_split_to_array(text, {p}) AS ps,
      regexp_extract_all(text, {p}, {1 if name == 'credential_assignment' else 0}) AS n, regexp_extract_all(text, {p}, {2 if name == 'credential_assignment' else 0}) AS v FROM planted)) WHERE {kept}"""


_FOUND = " UNION ALL ".join(_scan_sql(name, pattern, "ms[i]") for name, pattern in V.SECRET_PATTERNS)
SCAN_SQL = f"""planted AS (SELECT doc_id, CASE lang WHEN 'de' THEN 'ghp_' || substr(sha256(text), 1, 36) WHEN 'fr' THEN 'Authorization: Bearer ' || chr(10) || chr(10) || substr(sha256(text), 1, 30)
    WHEN 'es' THEN 'key AKIA' || upper(substr(sha256(text), 1, 16)) || ' end' ELSE 'export API_TOKEN="' || CASE WHEN doc_id % 2 = 0 THEN 'changeme' ELSE substr(sha256(text), 1, 20) END || '"' END
    || chr(10) || replace(text, 'token = "', chr(10) || chr(10) || 'SERVICE_TOKEN =' || chr(10) || '  "') AS text FROM documents),
found AS ({_FOUND} UNION ALL {_scan_sql('credential_assignment', V.SECRET_ASSIGNMENT, "n[i] || '=' || v[i]", f"lower(v[i]) NOT IN {S.in_list(V.PLACEHOLDER_VALUES)}")}),
scan AS (SELECT path, line, category, sha256('{V.SCAN_VERSION}' || chr(0) || path || chr(0) || category || chr(0) || evidence) AS fingerprint FROM found)"""


def planted(spark, d):
    """Documents with a made-up credential in front; the tokens they quote move to a line of their own, their values to the next."""
    digest = F.sha2("text", 256)
    value = F.when(F.col("doc_id") % 2 == 0, "changeme").otherwise(F.substring(digest, 1, 20))
    first = (
        F.when(F.col("lang") == "de", F.concat(F.lit("ghp_"), F.substring(digest, 1, 36)))
        .when(F.col("lang") == "fr", F.concat(F.lit("Authorization: Bearer \n\n"), F.substring(digest, 1, 30)))
        .when(F.col("lang") == "es", F.concat(F.lit("key AKIA"), F.upper(F.substring(digest, 1, 16)), F.lit(" end")))
        .otherwise(F.concat(F.lit('export API_TOKEN="'), value, F.lit('"')))
    )
    moved = F.replace("text", F.lit('token = "'), F.lit('\n\nSERVICE_TOKEN =\n  "'))
    return I.table(spark, d, "documents").select("doc_id", F.concat(first, F.lit("\n"), moved).alias("text"))


def scan(spark, d):
    return N.scan_text(planted(spark, d), "doc_id", "text")


@query("m1_scan_text", f"WITH {SCAN_SQL} SELECT path, line, category, fingerprint FROM scan")
def m1(spark, d):
    return scan(spark, d)


@query(
    "m2_content_class",
    """WITH f AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a/.env' WHEN 1 THEN 'b/server.key' WHEN 2 THEN '.env.example' ELSE 'p.html' END AS path FROM pages)
    SELECT page_id, path, CASE page_id % 5 WHEN 0 THEN 'forbidden_artifact' WHEN 1 THEN 'forbidden_artifact' WHEN 3 THEN 'unscannable_binary_file' WHEN 4 THEN 'unscannable_non_utf8_file' END AS reason FROM f""",
)
def m2(spark, d):
    k = F.col("page_id") % 5
    html = F.encode("html", "UTF-8")
    files = I.table(spark, d, "pages").select(
        "page_id", F.when(k == 0, "a/.env").when(k == 1, "b/server.key").when(k == 2, ".env.example").otherwise("p.html").alias("path"),
        F.when(k == 3, F.concat(html, F.lit(bytearray(b"\0")))).when(k == 4, F.concat(html, F.lit(bytearray(b"\xff\xfe")))).otherwise(html).alias("content"),
    )
    return N.content_class(files).select("page_id", "path", "reason")


@query(
    "m3_new_findings",
    f"""WITH {SCAN_SQL}, known AS (SELECT fingerprint, count(*) AS k FROM scan WHERE category = 'github_token' AND line % 2 = 1 GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY line, path, category) AS n FROM scan)
    SELECT path, line, category, fingerprint FROM r LEFT JOIN known USING (fingerprint) WHERE n > coalesce(k, 0)""",
)
def m3(spark, d):
    found = scan(spark, d)
    return N.new_findings(found, found.where("category = 'github_token' AND line % 2 = 1"))
