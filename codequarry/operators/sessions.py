"""Chat and curation sessions over finished tables; the streaming forms are in ``codequarry.streaming``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.functions.ranking import first_per_key, positions

NEW_TITLE = "New Chat"

# Curation statuses in order, and the step that continues each.
STATUS_ORDER = ["initialized", "sites_found", "urls_extracted", "approved", "completed"]
NEXT_STEP = {
    "initialized": "search", "sites_found": "extract", "urls_extracted": "approve", "approved": "crawl", "completed": "done",
}
ATTEMPT_LIMIT = "8 minutes"


def flatten_messages(sessions: DataFrame) -> DataFrame:
    """Message rows with their place in the session."""
    return sessions.select(F.col("id").alias("session_id"), F.posexplode("messages").alias("place", "m")).select("session_id", "place", "m.*")


def rollup_columns(order: list[str]) -> list[Column]:
    """Aggregates of a session: first user message, last message, counts."""
    is_user = F.col("type") == "user"
    return [
        F.min(F.when(is_user, F.struct(*order, "content"))).alias("first_user"), F.max(F.struct(*order)).alias("last"),
        F.count(F.lit(1)).alias("messages"), F.count_if(is_user).alias("user_messages"),
    ]


def titled(rolled: DataFrame, order: list[str]) -> DataFrame:
    """Session rows from rolled-up columns: the first user message, shortened, is the title."""
    content = F.col("first_user")["content"]
    title = F.when(F.col("first_user").isNull(), NEW_TITLE).otherwise(text.shorten(content, 50))
    return rolled.select("session_id", title.alias("title"), F.col("last")[order[0]].alias("last_message_at"), "messages", "user_messages")


def session_rollup(messages: DataFrame, order: list[str]) -> DataFrame:
    """Title, time of the last message and message counts per session; partly aggregated before the shuffle."""
    return titled(messages.groupBy("session_id").agg(*rollup_columns(order)), order)


def attached_sources(events: DataFrame, order: list[str]) -> DataFrame:
    """Distinct sources of each session, numbered by when they were first attached."""
    first = first_per_key(events.select("session_id", "source", *order), ["session_id", "source"], order)
    return positions(first, ["session_id"], [*order, "source"], "place").select("session_id", "place", "source")


def upsert_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """The sessions and a new, untitled one for every event of an unknown session."""
    unknown = events.select("session_id").distinct().join(sessions.select("session_id"), "session_id", "left_anti")
    return sessions.select("session_id", "title").union(unknown.select("session_id", F.lit(NEW_TITLE).alias("title")))


def session_log(events: DataFrame, order: list[str]) -> DataFrame:
    """Events with their 0-based number within the session."""
    return positions(events, ["session_id"], order, "seq").withColumn("seq", F.col("seq") - 1)


def tail(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events after the last index each reader has seen; ``cursors(session_id, cursor)``."""
    return log.join(cursors.select("session_id", "cursor"), "session_id").where(F.col("seq") > F.col("cursor")).drop("cursor")


def next_step(status: Column) -> Column:
    step = F.lit("none")
    for name, following in NEXT_STEP.items():
        step = F.when(status == name, following).otherwise(step)
    return step


def curation_status(events: DataFrame, order: list[str]) -> DataFrame:
    """Latest status per session and the step to resume with."""
    latest = first_per_key(events.select("session_id", "status", *order), ["session_id"], order, last=True)
    return latest.select("session_id", "status", next_step(F.col("status")).alias("resume_step"))


def is_legal(before: Column, after: Column) -> Column:
    """Start at the first status; then stay or go one on."""
    rank = lambda s: F.array_position(F.array(*[F.lit(x) for x in STATUS_ORDER]), s)
    step = rank(after) - rank(before)
    return (rank(after) > 0) & F.when(before.isNull(), rank(after) == 1).otherwise((rank(before) > 0) & step.isin(0, 1))


def status_moves(events: DataFrame, order: list[str]) -> DataFrame:
    """Every event with the status before it and whether the move is legal.

    The event before is joined by position, so a session with very many events
    is not one window.
    """
    placed = positions(events.select("session_id", "status", *order), ["session_id"], order, "seq")
    before = placed.select("session_id", (F.col("seq") + 1).alias("seq"), F.col("status").alias("before"))
    joined = placed.join(before, ["session_id", "seq"], "left")
    return joined.withColumn("legal", is_legal(F.col("before"), F.col("status")))


def attempt_timeouts(events: DataFrame, limit: str = ATTEMPT_LIMIT, now: Column | None = None) -> DataFrame:
    """Outcome of attempts from their start and end events.

    ``events(attempt_id, kind, ts)`` with kinds start, end, error.  An attempt
    that ends after ``limit``, or has not ended ``limit`` after its start by
    ``now`` (the latest event when absent), is a timeout.
    """
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("ts")))
    seen = events.groupBy("attempt_id").agg(at("start").alias("start"), at("end").alias("end"), at("error").alias("error"))
    clock = now if now is not None else events.agg(F.max("ts")).scalar()
    due = F.col("start") + F.expr(f"INTERVAL {limit}")
    stopped = F.least("end", "error")
    status = (
        F.when(stopped.isNull() & (clock < due), "running").when(stopped.isNull() | (stopped > due), "timeout")
        .when(F.col("error") == stopped, "error").otherwise("completed")
    )
    finished = F.when(status == "timeout", due).otherwise(stopped)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    spent = (micros(finished) - micros(F.col("start"))) / 1e6
    return seen.where(F.col("start").isNotNull()).select("attempt_id", status.alias("status"), spent.alias("duration_seconds"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("events"))
