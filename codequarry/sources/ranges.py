"""Records of huge JSON documents, read by many tasks.

A document is cut into byte ranges that need not end where a record does.  What a range does to the
state of a parser - inside a string or not, which objects and arrays are open - is a small summary, and
summaries compose.  Three passes over the bytes: quotes of each range, brackets each range closes and
leaves open, and the records that begin in a range (read on to their end, wherever that is).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.session import materialize

RANGE_BYTES = 32 << 20
BLOCK_BYTES = 4 << 20
TASKS = 10_000  # ranges beyond this number share tasks

BACKSLASH, QUOTE, OBJECT, ARRAY = 92, 34, 123, 91
_STEP = np.zeros(256, np.int64)
_STEP[[OBJECT, ARRAY]] = 1
_STEP[[OBJECT + 2, ARRAY + 2]] = -1


def _open(path: str):
    """A file, named by its URI, in which any task can seek."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(unquote("/" + path[5:].lstrip("/")))
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(unquote(inner))


def _after_backslashes(file, at: int) -> bool:
    """Whether an odd run of backslashes ends just before ``at``."""
    run = 0
    while at > 0:
        block = file.read_at(min(at, 4096), max(0, at - 4096))
        bare = block.rstrip(b"\\")
        run += len(block) - len(bare)
        if bare:
            break
        at -= len(block)
    return bool(run % 2)


def _key_before(file, at: int) -> str:
    """The key of the value that begins at ``at``; empty for an element of an array and the document itself."""
    tail, start = b"", at
    while start > 0:
        step = min(start, 4096)
        start -= step
        tail = file.read_at(step, start) + tail
        value = tail.rstrip()
        if value and not value.endswith(b":"):
            return ""
        quoted = value[:-1].rstrip()
        end = len(quoted) - 1
        opening = quoted.rfind(b'"', 0, max(end, 0))
        while opening > 0 and (opening - len(quoted[:opening].rstrip(b"\\"))) % 2:
            opening = quoted.rfind(b'"', 0, opening)
        if opening > 0:  # at 0 a backslash may stand before what was read
            return quoted[opening + 1:end].decode()
    return ""


def _blocks(file, start: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(offset, bytes, places of quotes that open or close strings, places of brackets) block by block."""
    odd = _after_backslashes(file, start)
    for at in range(start, size, BLOCK_BYTES):
        data = np.frombuffer(file.read_at(min(BLOCK_BYTES, size - at), at), np.uint8)
        if not len(data):
            return
        place = np.arange(len(data))
        plain = data != BACKSLASH
        last = np.maximum.accumulate(np.where(plain, place, -1))
        # backslashes that end at each place; the run of the block before counts as well
        run = place - last + np.where(last < 0, int(odd), 0)
        escaped = np.r_[odd, run[:-1] % 2 == 1]
        odd = bool(run[-1] % 2)
        yield at, data, np.flatnonzero((data == QUOTE) & ~escaped), np.flatnonzero(_STEP[data] != 0)


def _quotes(file, start: int, end: int) -> int:
    return sum(len(quotes) for _, _, quotes, _ in _blocks(file, start, end)) % 2


def _brackets(file, start: int, end: int, inside: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(offset, bytes, places of brackets outside strings, their steps in depth) block by block."""
    for at, data, quotes, brackets in _blocks(file, start, end):
        outside = (np.searchsorted(quotes, brackets) + inside) % 2 == 0
        inside = bool((len(quotes) + inside) % 2)
        brackets = brackets[outside]
        yield at, data, brackets, _STEP[data[brackets]]


def _summary(file, start: int, end: int, inside: bool) -> tuple[int, list[str]]:
    """How many open brackets of earlier ranges close here, and the brackets left open, with their keys."""
    closed, left = 0, []
    for at, data, places, steps in _brackets(file, start, end, inside):
        if not len(places):
            continue
        depth = np.cumsum(steps)
        lowest = min(0, int(depth.min()))
        later = np.minimum.accumulate(depth[::-1])[::-1]  # the least depth from here on
        still = np.flatnonzero((steps == 1) & (later >= depth))
        closed += max(0, -lowest - len(left))
        left = left[:max(0, len(left) + lowest)] + [at + int(p) for p in places[still]]
    byte = lambda p: file.read_at(1, p).decode()
    return closed, [byte(p) + _key_before(file, p) for p in left]


def _records(file, start: int, end: int, size: int, inside: bool, stack: list[str], target: list[str], key: str) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the objects directly in ``target`` that begin in the range; with ``key`` only the one of that key."""
    stack, level, begun, held = list(stack), len(target), None, []
    depth = len(stack)
    for at, data, places, steps in _brackets(file, start, size, inside):
        after = depth + np.cumsum(steps)
        depth = int(after[-1]) if len(after) else depth
        raw, taken = data.tobytes(), 0
        # brackets that open or close something at most as deep as a record
        for i in np.flatnonzero(np.where(steps == 1, after <= level + 1, after <= level)):
            p, step, now = int(places[i]), steps[i], int(after[i])
            if begun is not None and step < 0 and now == level:
                yield begun, b"".join(held) + raw[taken:p + 1]
                begun, held = None, []
            if begun is None and at + p >= end:
                return
            if step < 0:
                del stack[now:]
            elif now <= level:
                stack.append(chr(data[p]) + _key_before(file, at + p))
            elif data[p] == OBJECT and stack[:level] == target and (not key or _key_before(file, at + p) == key):
                begun, taken = at + p, p
        if begun is not None:
            held.append(raw[taken:])
        elif at + len(data) >= end:
            return


def _states(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """Ranges (path, size, start, end) of all documents, with the parser's state (inside, stack) at their start."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size")).where("size > 0")
    number = F.floor((F.col("size") - 1) / range_bytes).cast("bigint")
    cut = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), number)).alias("n"))
    cut = materialize(cut.select("path", "size", (F.col("n") * range_bytes).alias("start"), F.least("size", (F.col("n") + 1) * range_bytes).alias("end")), "ranges")
    tasks = max(1, min(cut.count(), TASKS))
    shape = "path string, size bigint, start bigint, end bigint"

    def quotes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for _, r in batch.iterrows():
                with _open(r["path"]) as file:
                    found.append(_quotes(file, r["start"], r["end"]))
            yield batch.assign(quotes=found)

    counted = materialize(cut.repartition(tasks).mapInPandas(quotes, f"{shape}, quotes int"), "quotes")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = counted.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier) % 2, F.lit(0)) == 1).drop("quotes")

    def brackets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for _, r in batch.iterrows():
                with _open(r["path"]) as file:
                    found.append(_summary(file, r["start"], r["end"], r["inside"]))
            batch["closed"] = [c for c, _ in found]
            batch["left"] = pd.Series([o for _, o in found], index=batch.index, dtype=object)
            yield batch

    shape += ", inside boolean"
    summed = materialize(known.repartition(tasks).mapInPandas(brackets, f"{shape}, closed int, left array<string>"), "brackets")

    def compose(ranges: pd.DataFrame) -> pd.DataFrame:
        stack, stacks = [], []
        ranges = ranges.sort_values("start")
        for closed, left in zip(ranges["closed"], ranges["left"]):
            stacks.append(list(stack))
            stack = stack[:max(0, len(stack) - closed)] + list(left)
        ranges["stack"] = pd.Series(stacks, index=ranges.index, dtype=object)
        return ranges.drop(columns=["closed", "left"])

    composed = summed.groupBy("path").applyInPandas(compose, f"{shape}, stack array<string>")  # a few words for each range
    return materialize(composed, "states").repartition(tasks)


def json_records(spark: SparkSession, path: str, within: str, schema: str, single: bool = False, mentions: str | None = None,
                 range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Objects of the array at the dotted keys ``within`` of each document in ``path``: (path, offset, record).

    ``single`` reads the one object at ``within`` instead.  An empty ``within`` is a document that is an
    array.  Records whose bytes do not match the pattern ``mentions`` are dropped before they are parsed.
    Elements that are no objects are left out, and so is a record that the document breaks off.  A task
    holds one block and one record; ``offset`` orders a document's records.
    """
    keys = within.split(".") if within else []
    around = ["{"] + ["{" + k for k in keys[:-1]] if keys else []
    target = around if single else around + ["[" + (keys[-1] if keys else "")]
    key = keys[-1] if single else ""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = re.compile(mentions.encode()) if mentions else None
        for batch in batches:
            for _, r in batch.iterrows():
                with _open(r["path"]) as file:
                    held, chars = [], 0
                    for offset, raw in _records(file, r["start"], r["end"], r["size"], r["inside"], list(r["stack"]), target, key):
                        if wanted is None or wanted.search(raw):
                            held.append((r["path"], offset, raw.decode("utf-8", "replace")))
                            chars += len(raw)
                        if chars > BLOCK_BYTES:
                            yield pd.DataFrame(held, columns=["path", "offset", "json"])
                            held, chars = [], 0
                if held:
                    yield pd.DataFrame(held, columns=["path", "offset", "json"])

    texts = _states(spark, path, range_bytes).mapInPandas(read, "path string, offset bigint, json string")
    return texts.select("path", "offset", F.from_json("json", schema).alias("record"))
