"""Queries over sessions, as finished tables and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import sessions
from codequarry.plans.registry import Inputs, query
from codequarry.session import scratch_path
from codequarry.streaming import sessions as live


def _events(t: Inputs, df=None):
    """Events with a curation status for each type."""
    df = t.events if df is None else df
    status = (
        F.when(F.col("event_type") == "signup", "initialized").when(F.col("event_type") == "view", "sites_found")
        .when(F.col("event_type") == "click", "urls_extracted").when(F.col("event_type") == "purchase", "approved").otherwise("error")
    )
    return df.select(F.col("user_id").alias("session_id"), "event_id", "ts", F.col("event_type").alias("type"), status.alias("status"), "value")


def _stream(t: Inputs, table: str, files_per_batch: int | None = None):
    frame = getattr(t, table)
    return live.read_events(t.spark, f"{t.folder}/{table}.parquet*", frame.schema, files_per_batch)


STATUS = "CASE event_type WHEN 'signup' THEN 'initialized' WHEN 'view' THEN 'sites_found' WHEN 'click' THEN 'urls_extracted' WHEN 'purchase' THEN 'approved' ELSE 'error' END"


def _step_sql(status: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sessions.NEXT_STEP.items())
    return f"CASE {status} {cases} ELSE 'none' END"


@query("flattened_messages", "SELECT doc_id AS session_id, CAST(spot - 1 AS BIGINT) AS place, content FROM (SELECT doc_id, unnest(ls) AS content, generate_subscripts(ls, 1) AS spot FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))")
def flattened_messages(t: Inputs):
    message = lambda x: F.struct(F.lit("user").alias("type"), x.alias("content"))
    stored = t.documents.select(F.col("doc_id").alias("id"), F.transform(F.split("text", "\n"), message).alias("messages"))
    return sessions.flatten_messages(stored).select("session_id", F.col("place").cast("bigint"), "content")


ROLLUP = """SELECT m.session_id, CASE WHEN u.content IS NULL THEN 'New Chat' WHEN length(u.content) > 50 THEN substr(u.content, 1, 50) || '...' ELSE u.content END AS title,
                   last_message_at, messages, user_messages
            FROM (SELECT session_id, max(turn) AS last_message_at, count(*) AS messages, count(*) FILTER (type = 'user') AS user_messages FROM {b_messages} GROUP BY session_id) m
            LEFT JOIN (SELECT session_id, arg_min(content, turn) AS content FROM {b_messages} WHERE type = 'user' GROUP BY session_id) u ON u.session_id = m.session_id"""


@query("session_rollup", ROLLUP)
def session_rollup(t: Inputs):
    return sessions.session_rollup(t.b_messages, ["turn"])


@query("live_session_rollup", ROLLUP)
def live_session_rollup(t: Inputs):
    kind = F.when(F.col("role").isin("system", "user"), F.col("role")).otherwise("assistant")
    messages = _stream(t, "conversations").select(F.col("conv_id").alias("session_id"), "turn", kind.alias("type"), F.col("text").alias("content"))
    return live.session_rollup(messages, ["turn"])


@query(
    "attached_sources",
    """WITH f AS (SELECT o_custkey AS session_id, o_orderpriority AS source, min(o_orderkey) AS first FROM orders GROUP BY ALL)
       SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY first, source) AS place, source FROM f""",
)
def attached_sources(t: Inputs):
    events = t.orders.select(F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("source"), "o_orderkey")
    return sessions.attached_sources(events, ["o_orderkey"])


UPSERTED = """SELECT c_custkey AS session_id, c_name AS title FROM customer
              UNION ALL SELECT DISTINCT user_id + 100, 'New Chat' FROM events WHERE user_id + 100 NOT IN (SELECT c_custkey FROM customer)"""


@query("upserted_sessions", UPSERTED)
def upserted_sessions(t: Inputs):
    events = t.events.select((F.col("user_id") + 100).alias("session_id"))
    return sessions.upsert_sessions(events, t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("title")))


@query("live_upserted_sessions", UPSERTED)
def live_upserted_sessions(t: Inputs):
    events = _stream(t, "events").select((F.col("user_id") + 100).alias("session_id"))
    return live.upsert_sessions(events, t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("title")))


LOG = "SELECT user_id AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events"


@query("session_log", LOG)
def session_log(t: Inputs):
    return sessions.session_log(_events(t), ["ts", "event_id"]).select("session_id", "event_id", "seq")


@query("live_session_log", LOG)
def live_session_log(t: Inputs):
    events = _events(t, _stream(t, "events")).select("session_id", "event_id", "ts")
    return live.session_log(events, ["ts", "event_id"]).select("session_id", "event_id", "seq")


@query("log_tail", f"SELECT l.* FROM ({LOG}) l JOIN customer ON c_custkey = session_id WHERE seq > c_nationkey * 2")
def log_tail(t: Inputs):
    cursors = t.customer.select(F.col("c_custkey").alias("session_id"), (F.col("c_nationkey") * 2).alias("cursor"))
    return sessions.tail(sessions.session_log(_events(t), ["ts", "event_id"]), cursors).select("session_id", "event_id", "seq")


STATUS_SQL = f"""SELECT session_id, status, {_step_sql('status')} AS resume_step
    FROM (SELECT user_id AS session_id, {STATUS} AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"""


@query("curation_status", STATUS_SQL)
def curation_status(t: Inputs):
    return sessions.curation_status(_events(t), ["ts", "event_id"])


@query("live_curation_status", STATUS_SQL)
def live_curation_status(t: Inputs):
    return live.curation_status(_events(t, _stream(t, "events")), ["ts", "event_id"])


RANKS = " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(sessions.STATUS_ORDER))
MOVES = f"""WITH m AS (SELECT user_id AS session_id, event_id, {STATUS} AS status, lag({STATUS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    r AS (SELECT *, CASE status {RANKS} ELSE 0 END AS b, CASE before {RANKS} ELSE 0 END AS a FROM m)
    SELECT session_id, event_id, status, coalesce(before, '-') AS before, CASE WHEN before IS NULL THEN b = 1 ELSE a > 0 AND b > 0 AND b - a IN (0, 1) END AS legal FROM r"""


def _moves(df):
    return df.select("session_id", "event_id", "status", F.coalesce("before", F.lit("-")).alias("before"), "legal")


@query("status_moves", MOVES)
def status_moves(t: Inputs):
    return _moves(sessions.status_moves(_events(t), ["ts", "event_id"]))


@query("live_status_moves", MOVES)
def live_status_moves(t: Inputs):
    return _moves(live.status_moves(_events(t, _stream(t, "events")), ["ts", "event_id"]))


def _attempt_events(df):
    """Start and end of attempts: views never end, errors end in error, an end comes twenty seconds per unit of value later."""
    moment = F.unix_micros(F.col("ts").cast("timestamp"))
    finished = F.when(F.col("type") != "view", F.when(F.col("type") == "error", "error").otherwise("end"))
    marks = F.array(
        F.struct(F.lit("start").alias("kind"), moment.alias("us")),
        F.struct(finished.alias("kind"), (moment + F.floor(F.col("value") * 20 * 1000000)).alias("us")))
    rows = df.select(F.col("event_id").alias("attempt_id"), F.inline(marks)).where(F.col("kind").isNotNull())
    return rows.select("attempt_id", "kind", F.timestamp_micros("us").alias("ts"))


ATTEMPTS = """SELECT event_id AS attempt_id, CASE WHEN event_type = 'view' OR value * 20 > 480 THEN 'timeout' WHEN event_type = 'error' THEN 'error' ELSE 'completed' END AS status,
                     round(CASE WHEN event_type = 'view' OR value * 20 > 480 THEN 480.0 ELSE value * 20 END, 3) AS duration_seconds FROM events"""


@query("attempt_timeouts", ATTEMPTS)
def attempt_timeouts(t: Inputs):
    later = F.timestamp_micros(F.lit(4102444800000000))
    found = sessions.attempt_timeouts(_attempt_events(_events(t)), now=later)
    return found.withColumn("duration_seconds", F.round("duration_seconds", 3))


@query(
    "live_attempts",
    """WITH e AS (SELECT event_id, event_type, value, epoch_us(ts) AS us FROM events),
       clock AS (SELECT max(CASE WHEN event_type = 'view' THEN us ELSE us + CAST(floor(value * 20 * 1000000) AS BIGINT) END) AS t FROM e)
       SELECT event_id AS attempt_id, CASE WHEN event_type = 'view' OR value * 20 > 480 THEN 'timeout' WHEN event_type = 'error' THEN 'error' ELSE 'completed' END AS status,
              round(CASE WHEN event_type = 'view' OR value * 20 > 480 THEN 480.0 ELSE value * 20 END, 3) AS duration_seconds
       FROM e, clock WHERE event_type <> 'view' OR us + 480000000 <= clock.t""",
)
def live_attempts(t: Inputs):
    found = live.attempt_timeouts(_attempt_events(_events(t, _stream(t, "events"))))
    return found.withColumn("duration_seconds", F.round("duration_seconds", 3))


COUNTS = "SELECT user_id AS session_id, event_type AS type, count(*) AS events FROM events GROUP BY ALL"


@query("event_counts", COUNTS)
def event_counts(t: Inputs):
    return sessions.event_counts(_events(t))


@query("live_event_counts", COUNTS)
def live_event_counts(t: Inputs):
    return live.event_counts(_events(t, _stream(t, "events")))


@query("ingested_events", "SELECT event_id, user_id, event_type, value FROM events")
def ingested_events(t: Inputs):
    root = scratch_path(t.spark, "ingest")
    live.ingest_events(_stream(t, "events").select("event_id", "user_id", "event_type", "value"), f"{root}/table", f"{root}/checkpoint")
    return t.spark.read.parquet(f"{root}/table")
