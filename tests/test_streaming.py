"""Streams over several micro-batches against their finished-table forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codequarry.operators import sessions
from codequarry.sources.tables import KeyedTable, upsert
from codequarry.streaming import sessions as live

START = dt.datetime(2024, 1, 1)
SCHEMA = "session_id bigint, event_id bigint, ts timestamp, type string, status string, content string"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Events in five files by time, a third of them in one session."""
    rng = random.Random(9)
    kinds = ["user", "assistant", "system"]
    rows = []
    for i in range(600):
        session = 0 if rng.random() < 0.34 else rng.randrange(1, 25)
        status = rng.choice(sessions.STATUS_ORDER + ["error"])
        rows.append((session, i, START + dt.timedelta(seconds=i * 7), rng.choice(kinds), status, f"text {i} " * rng.randrange(1, 12)))
    folder = str(tmp_path_factory.mktemp("events"))
    for part in range(5):
        block = spark.createDataFrame(rows[part * 120:(part + 1) * 120], SCHEMA)
        block.coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder):
    return live.read_events(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)


ORDER = ["ts", "event_id"]


def test_session_log(spark, events, rows):
    want = sessions.session_log(spark.read.parquet(events), ORDER)
    got = live.session_log(stream(spark, events), ORDER)
    assert rows(got, "session_id", "event_id", "seq") == rows(want, "session_id", "event_id", "seq")


def test_tail(spark, events, rows):
    log = sessions.session_log(spark.read.parquet(events), ORDER)
    cursors = spark.createDataFrame([(0, 100), (1, -1)], "session_id bigint, cursor bigint")
    got = rows(sessions.tail(log, cursors), "session_id", "seq")
    assert got == sorted([tuple(r) for r in log.select("session_id", "seq").collect() if (r[0] == 0 and r[1] > 100) or r[0] == 1], key=repr)


def test_status(spark, events, rows):
    want = sessions.curation_status(spark.read.parquet(events), ORDER)
    assert rows(live.curation_status(stream(spark, events), ORDER)) == rows(want)


def test_moves(spark, events, rows):
    columns = ["session_id", "event_id", "status", "before", "legal"]
    want = sessions.status_moves(spark.read.parquet(events), ORDER)
    got = live.status_moves(stream(spark, events), ORDER)
    assert rows(got, *columns) == rows(want, *columns)


def test_legal_moves(spark):
    cases = [(None, "initialized", True), (None, "approved", False), ("initialized", "sites_found", True), ("initialized", "initialized", True),
             ("sites_found", "approved", False), ("approved", "sites_found", False), ("error", "completed", False), ("initialized", "error", False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select(sessions.is_legal(F.col("a"), F.col("b")), "want").collect())


def test_rollup(spark, events, rows):
    want = sessions.session_rollup(spark.read.parquet(events), ORDER)
    got = live.session_rollup(stream(spark, events), ORDER)
    assert rows(got) == rows(want)
    assert all(len(r["title"]) <= 53 for r in got.collect())


def test_rollup_without_user_message(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "hello"), (2, 1, "system", "s"), (2, 2, "user", "u" * 51), (2, 3, "user", "later")],
                               "session_id int, turn int, type string, content string")
    got = {r["session_id"]: r for r in sessions.session_rollup(df, ["turn"]).collect()}
    assert got[1]["title"] == "New Chat" and got[2]["title"] == "u" * 50 + "..." and got[2]["last_message_at"] == 3


def test_counts(spark, events, rows):
    want = sessions.event_counts(spark.read.parquet(events))
    assert rows(live.event_counts(stream(spark, events))) == rows(want)


def test_upserted_sessions(spark, events, rows):
    start = spark.createDataFrame([(0, "Mine"), (99, "Other")], "session_id bigint, title string")
    want = sessions.upsert_sessions(spark.read.parquet(events), start)
    assert rows(live.upsert_sessions(stream(spark, events), start)) == rows(want)


def test_ingest_goes_on_where_it_stopped(spark, events, tmp_path):
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for _ in range(2):  # the second run finds nothing new
        live.ingest_events(stream(spark, events), table, checkpoint)
    assert spark.read.parquet(table).count() == 600


def test_log_restart_does_not_number_twice(spark, events, tmp_path, rows):
    first = live.session_log(stream(spark, events), ORDER, root=str(tmp_path))
    again = live.session_log(stream(spark, events), ORDER, root=str(tmp_path))
    assert rows(first, "session_id", "event_id", "seq") == rows(again, "session_id", "event_id", "seq")


def attempt_events(spark):
    at = lambda seconds: START + dt.timedelta(seconds=seconds)
    return [
        (1, "start", at(0)), (1, "end", at(77)), (2, "start", at(0)), (2, "error", at(30)), (3, "start", at(10)), (4, "start", at(20)),
        (4, "end", at(520)), (5, "start", at(3000)), (6, "end", at(3000)),
    ]


def test_attempts(spark, rows):
    df = spark.createDataFrame(attempt_events(spark), "attempt_id bigint, kind string, ts timestamp")
    got = dict((r[0], (r[1], r[2])) for r in sessions.attempt_timeouts(df).collect())
    assert got == {1: ("completed", 77.0), 2: ("error", 30.0), 3: ("timeout", 480.0), 4: ("timeout", 480.0), 5: ("running", None)}


def test_live_attempts_over_batches(spark, tmp_path, rows):
    folder = str(tmp_path / "attempts")
    for block in (attempt_events(spark)[:6], attempt_events(spark)[6:]):
        spark.createDataFrame(block, "attempt_id bigint, kind string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
    source = live.read_events(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    got = rows(live.attempt_timeouts(source), "attempt_id", "status")
    assert got == [(1, "completed"), (2, "error"), (3, "timeout"), (4, "timeout")]


def test_attempts_and_what_is_set_aside(spark, tmp_path, rows):
    """Batches end with a restart; ends without a start, late starts and events after the outcome are kept apart."""
    folder, root = str(tmp_path / "attempts"), str(tmp_path / "state")
    at = lambda seconds: START + dt.timedelta(seconds=seconds)
    blocks = [
        [(1, "start", at(0)), (2, "end", at(5)), (3, "start", at(10)), (9, None, at(10)), (9, "start", None)],
        [(1, "end", at(100)), (4, "start", at(300)), (5, "end", at(290)), (3, "error", at(60)), (3, "end", at(60))],
        [(1, "end", at(120)), (5, "start", at(280)), (6, "start", at(600))],  # the clock passes the end of 2
        [(2, "start", at(1)), (4, "end", at(800)), (7, "start", at(900)), (8, "start", at(20))],  # 4 is timed out by now
    ]
    for block in blocks:
        spark.createDataFrame(block, "attempt_id bigint, kind string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
        source = live.read_events(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
        live.attempt_timeouts(source, root=root)
    outcomes = live.of_kind(spark, root, live._attempt_schema("bigint"), "outcome")
    assert rows(outcomes, "attempt_id", "status", "duration_seconds") == [
        (1, "completed", 100.0), (3, "error", 50.0), (4, "timeout", 480.0), (5, "completed", 10.0), (8, "timeout", 480.0)]
    assert rows(live.attempts_aside(spark, root), "attempt_id", "reason", "event") == [
        (1, "after the outcome", "end"), (2, "after the outcome", "start"), (2, "no start", "end"), (9, "unreadable", "start"), (9, "unreadable", None)]


def test_attempts_of_one_bucket(spark, tmp_path, rows):
    """All attempts in one list: woken for the earliest, judged and forgotten one by one, also after restarts."""
    folder, root = str(tmp_path / "attempts"), str(tmp_path / "state")
    at = lambda seconds: START + dt.timedelta(seconds=seconds)
    blocks = [
        [(1, "start", at(0)), (2, "end", at(5)), (3, "start", at(10)), (None, "start", at(10)), (4, "start", at(400))],
        [(1, "end", at(100)), (None, "error", at(60)), (5, "start", at(600))],  # 2 has no start, 3 is timed out
        [(3, "end", at(90)), (4, "end", at(500)), (5, "end", at(700))],
        [(6, "start", at(200_000))], [(1, "start", at(200_000)), (1, "end", at(200_001))],  # 1 has been forgotten, then comes again
    ]
    for block in blocks:
        spark.createDataFrame(block, "attempt_id bigint, kind string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
        live.attempt_timeouts(live.read_events(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1), root=root, buckets=1)
    outcomes = live.of_kind(spark, root, live._attempt_schema("bigint"), "outcome")
    assert rows(outcomes, "attempt_id", "status", "duration_seconds") == [
        (1, "completed", 1.0), (1, "completed", 100.0), (3, "timeout", 480.0), (4, "completed", 100.0), (5, "completed", 100.0), (None, "error", 50.0)]
    assert rows(live.attempts_aside(spark, root), "attempt_id", "reason", "event") == [(2, "no start", "end"), (3, "after the outcome", "end")]


def disordered(spark, folder, blocks):
    schema = "session_id bigint, event_id bigint, ts timestamp, status string"
    for block in blocks:
        rows = [(s, i, START + dt.timedelta(seconds=t), status) for s, i, t, status in block]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        yield live.read_events(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)


def test_log_and_moves_go_on_after_a_restart(spark, tmp_path, rows):
    folder, log, moves = (str(tmp_path / name) for name in ("events", "log", "moves"))
    rng = random.Random(4)
    blocks = [[(rng.randrange(4), part * 50 + i, part * 100 + rng.randrange(100), rng.choice(sessions.STATUS_ORDER)) for i in range(50)] for part in range(3)]
    for source in disordered(spark, folder, blocks):
        live.session_log(source, ORDER, root=log)
        live.status_moves(source, ORDER, root=moves)
    all_events = spark.read.parquet(folder)
    got = live.session_log(source, ORDER, root=log)
    assert rows(got, "session_id", "event_id", "seq") == rows(sessions.session_log(all_events, ORDER), "session_id", "event_id", "seq")
    columns = ["session_id", "event_id", "status", "before", "legal"]
    got = live.status_moves(source, ORDER, root=moves)
    assert rows(got, *columns) == rows(sessions.status_moves(all_events, ORDER), *columns)
    illegal = live.of_kind(spark, moves, got.schema, "illegal")
    assert rows(illegal, "event_id") == rows(got.where("NOT legal"), "event_id")


def test_late_events_are_set_aside_or_waited_for(spark, tmp_path, rows):
    blocks = [[(1, 1, 10, "a"), (1, 2, 50, "a"), (2, 3, 20, "a")], [(1, 4, 30, "a"), (2, 5, 25, "a"), (1, 6, 60, "a")], [(3, 7, 500, "a")]]
    for lateness, want, late in ((0, {1: 0, 2: 1, 6: 2, 3: 0, 5: 1, 7: 0}, {4}), (100, {1: 0, 4: 1, 2: 2, 6: 3, 3: 0, 5: 1}, set())):
        folder, root = str(tmp_path / f"events{lateness}"), str(tmp_path / f"log{lateness}")
        for source in disordered(spark, folder, blocks):
            got = live.session_log(source, ORDER, root=root, lateness=lateness)
        assert {r["event_id"]: r["seq"] for r in got.collect()} == want
        assert {r["event_id"] for r in live.of_kind(spark, root, got.schema, "late").collect()} == late


def test_keyed_table_leaves_other_buckets_alone(spark, tmp_path, rows):
    def files():
        return {str(f): f.stat().st_mtime_ns for f in (tmp_path / "table").rglob("*.parquet")}

    start = spark.createDataFrame([(i, f"t{i}", i) for i in range(500)], "id bigint, title string, n bigint")
    table = KeyedTable(spark, str(tmp_path / "table"), start.schema, ["id"], buckets=16)
    assert not table.exists() and table.read().count() == 0
    table.create(start)
    before = files()
    assert len({f.split("key_bucket=")[1].split("/")[0] for f in before}) == 16
    batch = spark.createDataFrame([(7, None, None, 2), (7, "old", 1, 1), (1000, "new", None, 1)], "id bigint, title string, n bigint, at int")
    table.upsert(batch, ["at"], keep_if_null=["title"])
    want = sorted([(i, f"t{i}", None if i == 7 else i) for i in range(500)] + [(1000, "new", None)], key=repr)
    assert rows(table.read()) == want
    touched = {r[0] for r in table._bucketed(batch).select("key_bucket").collect()}
    after = files()
    kept = {f: t for f, t in before.items() if int(f.split("key_bucket=")[1].split("/")[0]) not in touched}
    assert 1 <= len(touched) <= 2 and len(kept) >= 14 and kept.items() <= after.items()
    table.upsert(batch, ["at"], keep_if_null=["title"])  # again: the same rows
    assert rows(table.read()) == want
    now = files()
    table.upsert(start.where("id < 9").withColumn("title", F.lit("x")), insert_only=True)
    assert files() == now
    pure = upsert(start, batch, ["id"], ["at"], ["title"])
    assert rows(table.read()) == rows(pure)


def test_attached_sources(spark, rows):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (2, "z", 1)], "session_id int, source string, n int")
    assert rows(sessions.attached_sources(df, ["n"])) == [(1, 1, "b"), (1, 2, "a"), (2, 1, "z")]
