"""Session operators as streams, their state in Spark's state store.

Aggregates use Spark's own aggregation state; their updates are upserted into a keyed table.  Operators
that need an order within a session, or a clock, are stateful processors with event-time timers.

The clock of a processor is the watermark.  It stands at the latest event time seen (less ``lateness``), and yet Spark
drops no row for being late: rows are filed a century ahead, and the watermark runs that much behind.  So the processors
themselves see late rows, and set them aside as a second output instead of losing them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from codequarry.operators import sessions
from codequarry.session import scratch_path
from codequarry.sources.tables import KeyedTable

CENTURY = 36_525 * 86_400  # seconds
BUCKETS = 4_096  # of attempts, each kept as one list
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int | None = None, format: str = "parquet") -> DataFrame:
    """Files of events as a stream, a bounded number per batch when asked."""
    reader = spark.readStream.schema(schema).format(format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def ingest_events(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append whatever files have arrived since the last run to a parquet table."""
    _run(stream.writeStream.format("parquet").option("path", path), checkpoint)


def _run(writer, checkpoint: str) -> None:
    """Run a stream over what is there now; state is kept on disk, not in the executors' heaps."""
    conf = SparkSession.active().conf
    name, provider = STATE_STORE
    before = conf.get(name, None)
    conf.set(name, provider)
    try:
        running = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
    running.awaitTermination()


# ---- aggregates --------------------------------------------------------------------------------


def _updated(stream: DataFrame, keys: list[str], root: str) -> DataFrame:
    """The latest row of each key of an aggregate, upserted batch by batch; a batch that is run again changes nothing."""
    table = KeyedTable(stream.sparkSession, f"{root}/table", stream.schema, keys)
    _run(stream.writeStream.outputMode("update").foreachBatch(lambda df, _: table.upsert(df)), f"{root}/checkpoint")
    return table.read()


def event_counts(stream: DataFrame, root: str | None = None) -> DataFrame:
    """Live counts per session and type."""
    spark = stream.sparkSession
    counted = stream.groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("events"))
    return _updated(counted, ["session_id", "type"], root or scratch_path(spark, "counts"))


def session_rollup(messages: DataFrame, order: list[str], root: str | None = None) -> DataFrame:
    """Title, last message and counts per session."""
    rolled = messages.groupBy("session_id").agg(*sessions.rollup_columns(order))
    found = _updated(rolled, ["session_id"], root or scratch_path(messages.sparkSession, "rollup"))
    return sessions.titled(found, order)


def curation_status(events: DataFrame, order: list[str], root: str | None = None) -> DataFrame:
    """Latest status per session and the step to resume with."""
    newest = events.groupBy("session_id").agg(F.max(F.struct(*order, "status")).alias("newest"))
    found = _updated(newest, ["session_id"], root or scratch_path(events.sparkSession, "status"))
    latest = found.select("session_id", "newest.status")
    return latest.withColumn("resume_step", sessions.next_step(F.col("status")))


def upsert_sessions(events: DataFrame, start: DataFrame, root: str | None = None) -> DataFrame:
    """Sessions after a stream of events: unknown ones are created, known ones keep their title.

    The table is in hash buckets; a batch rewrites those in which a session is new.  ``start`` is written when there
    is no table yet.
    """
    spark = events.sparkSession
    root = root or scratch_path(spark, "sessions")
    start = start.select("session_id", "title")
    table = KeyedTable(spark, f"{root}/table", start.schema, ["session_id"])
    if not table.exists():
        table.create(start)

    def write(df: DataFrame, _: int) -> None:
        table.upsert(df.select("session_id", F.lit(sessions.NEW_TITLE).alias("title")).distinct(), insert_only=True)

    _run(events.select("session_id").writeStream.foreachBatch(write), f"{root}/checkpoint")
    return table.read()


# ---- order within a session --------------------------------------------------------------------


def _plain(events: DataFrame) -> DataFrame:
    """Time columns as numbers or text, which pass through Python as they are."""
    told = {"timestamp": lambda c: F.unix_micros(c), "timestamp_ntz": lambda c: F.col(c).cast("string")}
    return events.select(*(told[kind](c).alias(c) if kind in told else F.col(c) for c, kind in events.dtypes))


def _timed(rows: DataFrame, like: dict[str, str]) -> DataFrame:
    """The time columns as they were."""
    back = {"timestamp": lambda c: F.timestamp_micros(c), "timestamp_ntz": lambda c: F.col(c).cast("timestamp_ntz")}
    return rows.select(*(back[like[c]](c).alias(c) if like.get(c) in back else F.col(c) for c in rows.columns))


def _clocked(rows: DataFrame, time: Column, lateness: int) -> DataFrame:
    """Rows with their time in microseconds as ``clock_us`` and a watermark at the latest time less ``lateness`` seconds."""
    ahead = F.coalesce(time, F.timestamp_seconds(F.lit(0))) + F.expr(f"INTERVAL '{CENTURY}' SECOND")
    return rows.withColumn("clock_us", F.unix_micros(time)).withColumn("filed_at", ahead).withWatermark("filed_at", f"{CENTURY + lateness} seconds")


class InOrder(StatefulProcessor):
    """Keeps a session's rows until the clock has passed them, then hands them on in order.

    A row that comes when a later one of its session has been handed on is set aside as late.  What is kept of a session
    is its rows between the clock and the latest event, the last row handed on and what ``follow`` makes of it.
    """

    def __init__(self, rows: StructType, order: list[str], known: str, output: list[str]):
        self.rows, self.known_type, self.output = rows, known, output
        self.order = [rows.names.index(c) for c in order]
        self.time = rows.names.index("clock_us")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.last = handle.getValueState("last", self.rows)
        self.known = handle.getValueState("known", self.known_type)
        self.told = Row(*self.output)

    def follow(self, known: tuple | None, row: tuple) -> tuple[tuple, object]:
        """What is known after a row, and what the row is told; nothing is known before the first."""
        raise NotImplementedError

    def _place(self, row: tuple) -> list:
        """NULLs come first; times as text sort like times."""
        return [(row[c] is not None, row[c]) for c in self.order]

    def _millis(self, row: tuple) -> int:
        return (row[self.time] or 0) // 1000

    def _released(self, rows: list[tuple], clock: int) -> Iterator[Row]:
        """Hand on the rows that the clock has passed, keep the others."""
        due = sorted((r for r in rows if self._millis(r) <= clock), key=self._place)
        left = [r for r in rows if self._millis(r) > clock]
        if due:
            known = self.known.get()
            for row in due:
                known, told = self.follow(known, row)
                yield self.told(*row, told, False)
            self.known.update(known)
            self.last.update(due[-1])
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(min(map(self._millis, left)))
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, clock = self.last.get(), timerValues.getCurrentWatermarkInMs()
        kept = []
        for row in map(tuple, rows):
            if last is not None and self._place(row) < self._place(last):
                yield self.told(*row, None, True)
            else:
                kept.append(row)
        if any(self._millis(r) <= clock for r in kept):
            yield from self._released([*self.waiting.get(), *kept], clock)
        elif kept:
            self.waiting.appendList(kept)
            self.handle.registerTimer(min(map(self._millis, kept)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rows, clock = list(self.waiting.get()), timerValues.getCurrentWatermarkInMs()
        if any(self._millis(r) <= clock for r in rows):
            yield from self._released(rows, clock)

    def close(self) -> None:
        pass


class Numbered(InOrder):
    """Rows with their 0-based number within the session."""

    def follow(self, known, row):
        seq = known[0] if known else 0
        return (seq + 1,), seq


class Preceded(InOrder):
    """Rows with the status of the row before them."""

    def follow(self, known, row):
        return (row[self.rows.names.index("status")],), known[0] if known else None


def _in_order(events: DataFrame, order: list[str], processor: type[InOrder], known: str, told: str, lateness: int) -> DataFrame:
    """Events with what the processor tells of them (``told``: name and type), and whether they are late."""
    plain = _plain(events)
    told_by = {"timestamp": F.timestamp_micros, "timestamp_ntz": lambda c: F.col(c).cast("timestamp")}
    filed = _clocked(plain, told_by[dict(events.dtypes)[order[0]]](order[0]), lateness)
    schema = filed.schema
    output = StructType([*schema.fields, *StructType.fromDDL(f"{told}, late boolean").fields])
    found = filed.groupBy("session_id").transformWithState(processor(schema, order, known, output.names), output, "Append", "EventTime")
    return _timed(found.drop("clock_us", "filed_at"), dict(events.dtypes))


def _kinds(rows: DataFrame, root: str) -> None:
    """Append the rows to a table with a folder for each ``kind`` of row; it holds each batch once, also after a restart."""
    writer = rows.writeStream.format("parquet").partitionBy("kind").option("path", f"{root}/rows")
    _run(writer, f"{root}/checkpoint")


def of_kind(spark: SparkSession, root: str, schema: StructType, *kinds: str) -> DataFrame:
    """The rows of some kinds that a stream with its files below ``root`` has written."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("kind", StringType())])).parquet(f"{root}/rows")
    return rows.where(F.col("kind").isin(*kinds)).drop("kind")


def session_log(events: DataFrame, order: list[str], root: str | None = None, lateness: int = 0) -> DataFrame:
    """Events with their 0-based number within the session, given once the clock has passed them.

    ``order`` begins with the event time.  Events that come after a later one of their session was numbered are of the
    kind ``late`` below ``root``, without a number; ``lateness`` (seconds) is how long the numbering waits for them.  A session's
    events between two clocks are sorted in one task, so the size of a micro-batch bounds its memory.
    """
    root = root or scratch_path(events.sparkSession, "log")
    rows = _in_order(events, order, Numbered, "next bigint", "seq bigint", lateness)
    _kinds(rows.withColumn("kind", F.when(F.col("late"), "late").otherwise("numbered")).drop("late"), root)
    return of_kind(events.sparkSession, root, rows.drop("late").schema, "numbered")


def status_moves(events: DataFrame, order: list[str], root: str | None = None, lateness: int = 0) -> DataFrame:
    """Every status event with the one before it and whether the move is legal.

    Below ``root`` the kinds are ``legal``, ``illegal`` and ``late``; late events, see ``session_log``, move nothing.
    """
    root = root or scratch_path(events.sparkSession, "moves")
    listed = events.select("session_id", "status", *order)
    rows = _in_order(listed, order, Preceded, "status string", "before string", lateness)
    rows = rows.withColumn("legal", F.when(~F.col("late"), sessions.is_legal(F.col("before"), F.col("status"))))
    kind = F.when(F.col("late"), "late").when(~F.col("legal"), "illegal").otherwise("legal")
    _kinds(rows.withColumn("kind", kind).drop("late"), root)
    return of_kind(events.sparkSession, root, rows.drop("late").schema, "legal", "illegal")


# ---- attempts ----------------------------------------------------------------------------------


class Attempts(StatefulProcessor):
    """The outcomes of a bucket of attempts, each from its first start and first end, or from the clock.

    An end waits for its start as long as an attempt may last, then it is set aside.  What comes after the outcome is
    set aside too; an attempt is remembered for ``keep`` microseconds after it.  A bucket is read and written as one list and
    woken for the earliest of its attempts: each call of the state store costs much more than an attempt in the list.
    """

    def __init__(self, limit: int, keep: int, id_type: str, output: list[str]):
        self.limit, self.keep, self.id_type, self.output = limit, keep, id_type, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("attempts", f"attempt_id {self.id_type}, start bigint, stop bigint, failed boolean, forget bigint")
        self.told = Row(*self.output)

    def _wakes(self, attempt: tuple) -> int:
        """The moment at which the clock tells something about an attempt."""
        start, stop, _, forget = attempt
        return forget if forget is not None else (start if start is not None else stop) + self.limit

    def _keep(self, held: dict) -> None:
        if held:
            self.state.put([(name, *attempt) for name, attempt in held.items()])
            self.handle.registerTimer(-(-min(map(self._wakes, held.values())) // 1000))
        else:
            self.state.clear()

    def _judged(self, name, start: int | None, stop: int | None, failed: bool, clock: int) -> tuple[Row | None, tuple]:
        """What is told of an attempt, if anything, and what is kept of it."""
        due = None if start is None else start + self.limit
        if start is not None and stop is not None:
            status = "timeout" if stop > due else "error" if failed else "completed"
            told = self._outcome(name, status, self.limit if stop > due else stop - start)
        elif start is not None and due <= clock:
            told = self._outcome(name, "timeout", self.limit)
        elif stop is not None and start is None and stop + self.limit <= clock:
            told = self._aside(name, "no start", "error" if failed else "end", stop)
        else:
            return None, (start, stop, failed, None)
        return told, (start, stop, failed, max(clock, start or stop) + self.keep)

    def _outcome(self, name, status: str, spent: int) -> Row:
        return self.told(name, status, spent / 1e6, None, None, "outcome")

    def _aside(self, name, reason: str, kind: str | None, moment: int | None) -> Row:
        return self.told(name, reason, None, kind, moment, "aside")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, news = {name: attempt for name, *attempt in self.state.get()}, set()
        for row in rows:
            name, kind, moment = row["attempt_id"], row["kind"], row["clock_us"]
            start, stop, failed, forget = held.get(name, (None, None, False, None))
            if forget is not None or moment is None or kind not in ("start", "end", "error"):
                yield self._aside(name, "unreadable" if forget is None else "after the outcome", kind, moment)
                continue
            if kind == "start":
                start = moment if start is None else min(start, moment)
            elif stop is None or (moment, kind != "error") < (stop, not failed):
                stop, failed = moment, kind == "error"
            held[name] = (start, stop, failed, None)
            news.add(name)
        clock = timerValues.getCurrentWatermarkInMs() * 1000
        for name in news:
            told, held[name] = self._judged(name, *held[name][:3], clock)
            if told is not None:
                yield told
        if news:
            self._keep(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, clock = {name: attempt for name, *attempt in self.state.get()}, timerValues.getCurrentWatermarkInMs() * 1000
        due = [name for name, attempt in held.items() if self._wakes(attempt) <= clock]
        for name in due:
            if held[name][3] is not None:
                del held[name]
                continue
            told, held[name] = self._judged(name, *held[name][:3], clock)
            if told is not None:
                yield told
        if due:
            self._keep(held)

    def close(self) -> None:
        pass


def attempt_timeouts(
    events: DataFrame, limit_seconds: int = 480, root: str | None = None, lateness: int = 0, keep_seconds: int = 86_400, buckets: int = BUCKETS
) -> DataFrame:
    """(attempt_id, status, duration_seconds) of attempts as their events arrive; ``events(attempt_id, kind, ts)``.

    An attempt is a timeout when it ends after its limit, or when the clock passes the limit without an end.  Ends without
    a start, starts and ends after the outcome, and events without a time or of another kind are of the kind ``aside``
    below ``root``, see ``attempts_aside``.  A batch rewrites the state of the ``buckets`` (by hash) that its attempts are in; their
    number stays the same for one ``root``.
    """
    spark = events.sparkSession
    root = root or scratch_path(spark, "attempts")
    filed = _clocked(events.select("attempt_id", "kind", "ts"), F.col("ts").cast("timestamp"), lateness).drop("ts")
    output = _attempt_schema(dict(events.dtypes)["attempt_id"])
    sided = StructType([*output.fields, StructField("side", StringType())])
    processor = Attempts(limit_seconds * 1_000_000, keep_seconds * 1_000_000, dict(events.dtypes)["attempt_id"], sided.names)
    dealt = filed.withColumn("bucket", F.pmod(F.xxhash64("attempt_id"), F.lit(buckets)))
    found = dealt.groupBy("bucket").transformWithState(processor, sided, "Append", "EventTime")
    _kinds(found.withColumnRenamed("side", "kind"), root)
    return of_kind(spark, root, output, "outcome").select("attempt_id", "status", "duration_seconds")


def attempts_aside(spark: SparkSession, root: str, kind: str = "bigint") -> DataFrame:
    """(attempt_id, reason, event, ts) of the events that told nothing; ``kind`` is the type of attempt_id."""
    rows = of_kind(spark, root, _attempt_schema(kind), "aside")
    return rows.select("attempt_id", F.col("status").alias("reason"), "event", F.timestamp_micros("at_us").alias("ts"))


def _attempt_schema(kind: str) -> StructType:
    return StructType.fromDDL(f"attempt_id {kind}, status string, duration_seconds double, event string, at_us bigint")
