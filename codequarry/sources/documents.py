"""JSON documents in and out: analyses, session stores, curation states.

Analyses and session stores written by others hold everything in one nested
object, which is read by byte ranges; curation states, one document a session,
are read with ``multiLine``.  Written here they are sharded JSON lines, so
neither side ever holds one document per data set.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry import schemas
from codequarry.functions.ranking import positions
from codequarry.sources.ranges import RANGE_BYTES, json_records

MESSAGES_PER_ROW = 1000


def read_analysis(spark: SparkSession, path: str, sharded: bool = False, kind: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Entity rows of an analysis, all kinds in one table; of a document with ``kind`` only those are parsed."""
    if sharded:
        nodes = spark.read.schema(schemas.NODE).json(f"{path}/nodes")
    else:
        mentions = rf'"node_type"\s*:\s*"{re.escape(kind)}"' if kind else None
        nodes = json_records(spark, path, "nodes", schemas.NODE, mentions=mentions, range_bytes=range_bytes).select("record.*")
    return nodes.where(F.col("node_type") == kind) if kind else nodes


def read_analysis_metadata(spark: SparkSession, path: str, sharded: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    if sharded:
        return spark.read.schema(schemas.METADATA).json(f"{path}/analysis_metadata")
    return json_records(spark, path, "analysis_metadata", schemas.METADATA, single=True, range_bytes=range_bytes).select("record.*")


def write_analysis_document(metadata: DataFrame, nodes: DataFrame, path: str) -> None:
    """An analysis as the one document that others read.  One file has one writer; it streams and sorts on disk."""
    text = lambda df, part, head, tail: df.select(F.lit(part).alias("part"), F.concat(F.lit(head), F.to_json(F.struct("*")), F.lit(tail)).alias("value"))
    end = metadata.limit(1).select(F.lit(2).alias("part"), F.lit("]}").alias("value"))
    parts = text(metadata.limit(1), 0, '{"analysis_metadata": ', ', "nodes": [').union(text(nodes, 1, "", "")).union(end)
    # one ordered window: the header, the nodes, the end
    follows = (F.col("part") == 1) & (F.lag("part").over(Window.orderBy("part")) == 1)
    comma = parts.withColumn("comma", F.when(follows, ",").otherwise(""))
    comma.select(F.concat("comma", "value").alias("value")).write.mode("overwrite").text(path)


def split_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Functions, classes and imports."""
    of = lambda kind: nodes.where(F.col("node_type") == kind)
    return of("function"), of("class"), of("import")


def write_analysis(metadata: DataFrame, nodes: DataFrame, path: str) -> None:
    metadata.write.mode("overwrite").json(f"{path}/analysis_metadata")
    nodes.write.mode("overwrite").json(f"{path}/nodes")


def read_sessions(spark: SparkSession, path: str, sharded: bool = False) -> tuple[DataFrame, DataFrame]:
    """Session rows and message rows (with their place in the session)."""
    if sharded:
        sessions = spark.read.schema(schemas.SESSION_ROW).json(f"{path}/sessions")
        blocks = spark.read.schema(schemas.MESSAGE_BLOCK).json(f"{path}/messages")
        placed = blocks.select("session_id", "block", F.posexplode("messages").alias("at", "m"))
        place = F.col("block") * MESSAGES_PER_ROW + F.col("at")
        return sessions, placed.select("session_id", place.alias("place"), "m.id", "m.type", "m.content", "m.timestamp")
    stored = json_records(spark, path, "sessions", schemas.SESSION).select("record.*")
    messages = stored.select(F.col("id").alias("session_id"), F.posexplode("messages").alias("place", "m"))
    return stored.drop("messages"), messages.select(
        "session_id", F.col("place").cast("bigint"), "m.id", "m.type", "m.content", "m.timestamp"
    )


def write_sessions(sessions: DataFrame, messages: DataFrame, order: list[str], path: str) -> None:
    """Sessions, and their messages in blocks of bounded size, so no session is gathered whole."""
    placed = positions(messages, ["session_id"], order, "__place")
    block = F.floor((F.col("__place") - 1) / MESSAGES_PER_ROW)
    message = F.struct("__place", "id", "type", "content", "timestamp")
    blocks = placed.groupBy("session_id", block.alias("block")).agg(F.sort_array(F.collect_list(message)).alias("m"))
    bare = F.transform("m", lambda m: F.struct(*[m[c].alias(c) for c in ("id", "type", "content", "timestamp")]))
    sessions.write.mode("overwrite").json(f"{path}/sessions")
    blocks.select("session_id", "block", bare.alias("messages")).write.mode("overwrite").json(f"{path}/messages")


def read_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Sites, URLs, attempts, crawl results and status rows of stored curation states."""
    state = spark.read.schema(schemas.CURATION_STATE).option("multiLine", True).json(path)
    part = lambda column: state.select("session_id", F.posexplode(column).alias("place", "r")).select("session_id", "place", "r.*")
    return {
        "sites": part("search_sites"), "urls": part("extracted_urls"), "approved": part("approved_urls"),
        "attempts": part("extraction_attempts"), "crawled": part("crawled_content.results"),
        "states": state.select("session_id", "status", "created_at", "last_updated"),
    }


def write_state(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def read_state_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.schema(schemas.STATE_TABLES[n]).json(f"{path}/{n}") for n in names}
