"""How quality filters interact: what each removes in every order, from sorted posting lists.

For each part (value of ``lang``) and filter the ids of the failing rows are kept as sorted lists, cut
at ranges of 65,536 ids.  What a filter removes after others is the difference between its list and
theirs, and what is gone after a step is the union of the lists so far; both are galloping merges within a range, whose
sizes are summed over the ranges.  So a part with any share of all rows is spread over its ranges.

Rows: a NULL text is empty (it fails A alone, besides E), a NULL ``lang`` is the part ''.  Repeated rows count as
documents of their own.  A NULL doc_id is neither smaller nor larger than any, so it never fails E, and has
no label; a doc_id with several labels is good or toxic if one of them says so.  An empty table has no parts and
gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import string
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import slices, texts
from codequarry.session import materialize, spread

FILTERS = "ABCDE"
RANGE_BITS = 16  # ids of a range
CAPITALS, SIGNS = string.ascii_uppercase.encode(), b"#$%&*|"


def failures(text: str) -> tuple[int, bytes]:
    """Which of the filters A to D a text fails, as bits from A up, and the SHA-256 of its bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    few = len(words) < 100
    repetitive = 100 * len(set(words)) < 80 * len(words)
    shouted = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 10 * len(text)
    marked = len(raw) != len(raw.translate(None, SIGNS))
    return few | repetitive << 1 | shouted << 2 | marked << 3, hashlib.sha256(raw).digest()


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, part, fails, good, toxic) of every document; ``fails`` has a bit for each filter, from A up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                found = [failures(t) for t in texts(piece)]
                bits, digests = pa.array([b for b, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), bits, digests], ["doc_id", "part", "fails", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), "text")
    rows = rows.mapInArrow(run, f"doc_id {kind}, part string, fails int, digest binary")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "judged")
    least, most = F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    # written, so that both sides of the joins below are plain shuffles, whose hot keys are split at run time
    copied = materialize(rows.where("doc_id IS NOT NULL").groupBy("digest").agg(least, most).where("most > least").select("digest", "least"), "copied")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of"))
    marks = marks.agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    marks = materialize(marks, "marks")
    rows = rows.join(copied, "digest", "left").join(marks, F.col("doc_id") == F.col("of"), "left")
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int") * 16
    never = F.lit(False)
    return rows.select("row", "part", (F.col("fails") + again).alias("fails"), F.coalesce("good", never).alias("good"), F.coalesce("toxic", never).alias("toxic"))


def postings(rows: DataFrame) -> DataFrame:
    """(part, ids, n, A to E, good, toxic): of each range of ids the sorted failing ids by filter and those so labelled."""
    bit = {name: F.col("fails").bitwiseAND(1 << i) != 0 for i, name in enumerate(FILTERS)} | {"good": F.col("good"), "toxic": F.col("toxic")}
    lists = [F.sort_array(F.collect_list(F.when(here, F.col("row")))).alias(name) for name, here in bit.items()]
    return rows.groupBy("part", F.shiftright("row", RANGE_BITS).alias("ids")).agg(F.count(F.lit(1)).alias("n"), *lists)


# ---- merges of sorted lists --------------------------------------------------------------------


def _gallop(ids: list[int], at: int, value: int) -> int:
    """The first position from ``at`` on whose id is not below ``value``: steps that double, then bisection."""
    step, end = 1, len(ids)
    while at + step < end and ids[at + step] < value:
        at += step
        step *= 2
    return bisect_left(ids, value, at, min(at + step + 1, end))


def union(lists: list[list[int]]) -> list[int]:
    """The ids in any of the sorted lists, sorted: the list with the least id gives all it has below the next list's."""
    heap = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapq.heapify(heap)
    out: list[int] = []
    while len(heap) > 1:
        _, k, at = heap[0]
        ids, ahead = lists[k], min(h[0] for h in heap[1:3])
        end = _gallop(ids, at, ahead)
        out += ids[at:end]
        end += end == at  # an id that the next list gives too
        if end < len(ids):
            heapq.heapreplace(heap, (ids[end], k, end))
        else:
            heapq.heappop(heap)
    for _, k, at in heap:
        out += lists[k][at:]
    return out


def difference(ids: list[int], others: list[int]) -> list[int]:
    """The ids that ``others`` lacks; both are sorted."""
    out: list[int] = []
    at, there = 0, 0
    while at < len(ids):
        there = _gallop(others, there, ids[at])
        if there == len(others):
            return out + ids[at:]
        if others[there] == ids[at]:
            at += 1
        else:
            end = _gallop(ids, at, others[there])
            out += ids[at:end]
            at = end
    return out


def _shared(ids: list[int], others: list[int]) -> list[int]:
    return difference(ids, difference(ids, others))


def merged(lists: list[list[int]], good: list[int], toxic: list[int]) -> np.ndarray:
    """[filter, set before it]: how many ids it removes, of them good and toxic ones, and how many are gone after it."""
    sets = 1 << len(lists)
    gone = [len(union([ids for g, ids in enumerate(lists) if before >> g & 1])) for before in range(sets)]
    out = np.zeros((len(lists), sets, 4), np.int64)
    for f, ids in enumerate(lists):
        left = {0: (ids, _shared(ids, good), _shared(ids, toxic))}
        for before in range(sets):
            if before >> f & 1:
                continue
            if before:
                last = before.bit_length() - 1
                left[before] = tuple(difference(some, lists[last]) for some in left[before ^ 1 << last])
            out[f, before] = [*map(len, left[before]), gone[before | 1 << f]]
    return out


def sizes(lists: DataFrame) -> DataFrame:
    """(part, filter, before, removed, good, toxic, gone): summed over the ranges; ``before`` is a set of filters as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = 1 << len(FILTERS)
        f, before = np.divmod(np.arange(len(FILTERS) * sets), sets)
        apart = (before >> f & 1) == 0
        for batch in batches:
            found: dict[str, np.ndarray] = {}
            for i in range(batch.num_rows):
                part, *ids = (batch.column(c)[i].as_py() for c in ("part", *FILTERS, "good", "toxic"))
                found[part] = found.get(part, 0) + merged(ids[:-2], *ids[-2:])
            if found:
                counts = np.concatenate([c.reshape(-1, 4)[apart] for c in found.values()])
                keys = [np.repeat(list(found), apart.sum()), np.tile(f[apart], len(found)), np.tile(before[apart], len(found))]
                arrays = [pa.array(keys[0], pa.string()), *(pa.array(k, pa.int32()) for k in keys[1:]), *(pa.array(c) for c in counts.T)]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "filter", "before", "removed", "good", "toxic", "gone"])

    kinds = "part string, filter int, before int, removed bigint, good bigint, toxic bigint, gone bigint"
    counted = lists.select("part", *FILTERS, "good", "toxic").mapInArrow(run, kinds)
    return counted.groupBy("part", "filter", "before").agg(*(F.sum(c).alias(c) for c in ("removed", "good", "toxic", "gone")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step of that order; see the columns' names below."""
    lists = materialize(postings(judged(docs, labels)), "postings")
    total = lists.groupBy("part").agg(F.sum("n").alias("n"))
    n, everything = len(FILTERS), (1 << len(FILTERS)) - 1
    # of all orders, in how many a set of so many filters comes first and the filter next
    ahead = F.bit_count("before")
    orders_with = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), ahead + 1)
    alone = F.col("before") == F.expr(f"{everything} - shiftleft(1, filter)")
    of_filter = Window.partitionBy("part", "filter")
    found = sizes(spread(lists)).select(
        "*",
        F.max(F.when(F.col("before") == 0, F.col("removed"))).over(of_filter).alias("failing"),
        F.max(F.when(alone, F.col("removed"))).over(of_filter).alias("unique_fails"),
        F.sum(F.col("removed") * orders_with).over(of_filter).alias("shapley"),
    )
    steps = []
    for order in itertools.permutations(range(n)):
        for step, f in enumerate(order):
            steps.append(("".join(FILTERS[g] for g in order), step + 1, f, sum(1 << g for g in order[:step])))
    table = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    return found.join(F.broadcast(table), ["filter", "before"]).join(total, "part").select(
        "part", "filter_order", "step", (F.col("n") - F.col("gone")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )
