"""Exact top-k by inner product with a uniform threshold in three phases.

Components of a vector become whole numbers floor(256 c), and an inner product is the sum of its parts over slices of the
components.  A node holds one slice of a block of vectors and, for a block of queries, the parts of their products:
score lists that are never written whole.

1. Each list gives its best entries, its mean and its least part.  The candidates found are scored exactly, and the k-th
   best score of a query is a sure lower bound of what it looks for.
2. Parts are counted from the mean of their list.  A vector whose parts all stay below bound / slices cannot reach the
   bound, so this cutoff is sent to the lists, and each gives all entries that reach it.  With missing parts set to the least or
   to the cutoff, every entry has a lower and an upper bound, and those below the k-th lower one go.
3. The entries left fetch the parts they miss, and the best k are taken.

Equal vectors are one entry with its first k + 1 rows, so copies do not multiply entries.  Vectors go to blocks by hash; a
task meets one block of queries with one of vectors.

Rows: a vector that is NULL or holds NULL or non-finite components takes no part, nor does one whose
squared length in whole numbers is 2^60 or more, since sums of its scores need not fit a long.  Only vectors of one length
have an inner product; empty ones score 0 with each other.  A row without vec_id is a candidate, last among ties, and
no query.  Rows that share a vec_id are rows of their own; a query leaves itself out once.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.session import materialize

SCALE = 256
SLICES = 2  # lists that a score is the sum of
FIRST = 6  # times as many entries of each list as are wanted go into the bound
LARGEST = 2.0**60  # squared length of a vector
VECTORS, QUERIES = 8_192, 512  # of a block
HELD = 1 << 21  # parts of products held by a task at a time
EXACT = 2.0**53

NODE = ["size", "slice", "block", "query_block"]


def _scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    fine = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2.0**31 / SCALE))
    square = F.aggregate("c", F.lit(0.0), lambda total, v: total + F.pow(F.floor(v * SCALE).cast("double"), F.lit(2.0)))
    return rows.where(F.coalesce(fine & (square < LARGEST), F.lit(False))).select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE)).alias("x"))


def _asks(every: int) -> Column:
    return F.coalesce(F.col("vec_id") % every == 0, F.lit(False))


def _entries(rows: DataFrame, every: int, k: int) -> DataFrame:
    """(entry, size, x, ids, asked) of the distinct vectors: their first rows, and whether a query is among all."""
    of_vector = Window.partitionBy("x").orderBy(F.col("vec_id").asc_nulls_last())  # cut to k + 1 before the shuffle too
    first = rows.withColumn("nth", F.row_number().over(of_vector)).where(F.col("nth") <= k + 1)
    place = F.struct("nth", F.col("vec_id"))
    entries = first.groupBy("x").agg(F.transform(F.array_sort(F.collect_list(place)), lambda p: p["vec_id"]).alias("ids"))
    asked = rows.where(_asks(every)).select("x").distinct().withColumn("asked", F.lit(True))
    entries = entries.join(asked, "x", "left").select(F.size("x").alias("size"), "x", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))
    return materialize(entries.withColumn("entry", F.monotonically_increasing_id()), "entries")


def _dealt(entries: DataFrame, slices: int) -> tuple[DataFrame, DataFrame]:
    """Slices of the vectors and of the queries, each on the nodes that meet them: (size, slice, block, query_block, entry, part)."""
    total, asked = entries.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    blocks, query_blocks = (-(-max(rows, 1) // most) for rows, most in ((total, VECTORS), (asked, QUERIES)))
    number = F.xxhash64(F.lit(3), "entry")
    # slice s holds the components from s * size / slices on
    cut = [F.floor(F.col("size") * s / slices).cast("int") for s in range(slices + 1)]
    parts = F.array(*(F.struct(F.lit(s).alias("slice"), F.slice("x", cut[s] + 1, cut[s + 1] - cut[s]).alias("part")) for s in range(slices)))
    placed = entries.select("size", "asked", "entry", F.explode(parts).alias("at")).select("size", "asked", "entry", "at.slice", "at.part")

    def met(rows: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        rows = rows.withColumn(own, F.pmod(number, F.lit(own_blocks)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)))).select(*NODE, "entry", "part")

    return met(placed, "block", blocks, "query_block", query_blocks), met(placed.where("asked"), "query_block", query_blocks, "block", blocks)


def _rows(table: pa.Table) -> np.ndarray:
    """The parts of a node's rows as a matrix."""
    column = table["part"].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _products(queries: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, whole-number products) of a few queries at a time with all vectors."""
    largest = [float(np.abs(m).max(initial=0)) for m in (queries, vectors)]
    kind = np.float64 if largest[0] * largest[1] * queries.shape[1] < EXACT else np.int64
    right = vectors.astype(kind).T
    step = max(1, HELD // max(1, len(vectors)))
    for start in range(0, len(queries), step):
        yield start, (queries[start : start + step].astype(kind) @ right).astype(np.int64)


def _best_entries(k: int):
    """Phase 1 on a node: of each query the best ``k`` entries, the least and the mean part."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        asked, entry = queries["entry"].to_numpy(), vectors["entry"].to_numpy()
        out = [[], [], [], [], []]
        if len(asked) and len(entry):
            many = min(k, len(entry))
            for start, parts in _products(_rows(queries), _rows(vectors)):
                top = np.argpartition(-parts, many - 1, axis=1)[:, :many]
                of = asked[start : start + len(parts)]
                listed = (parts.min(axis=1), parts.mean(axis=1).astype(np.int64))
                found = (np.repeat(of, many), entry[top].reshape(-1), np.take_along_axis(parts, top, 1).reshape(-1), *(np.repeat(v, many) for v in listed))
                for column, values in zip(out, found, strict=True):
                    column.append(values)
        where = queries if len(asked) else vectors
        return _told(where, ["query", "entry", "part", "least", "mean"], out)

    return run


def _entries_above(slices: int):
    """Phase 2 on a node: the entries that reach the cutoff of their query."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        asked, entry, cutoff = queries["entry"].to_numpy(), vectors["entry"].to_numpy(), queries["cutoff"].to_numpy()
        out = [[], [], []]
        if len(asked) and len(entry):
            for start, parts in _products(_rows(queries), _rows(vectors)):
                q, v = np.nonzero(parts >= cutoff[start : start + len(parts), None])
                for column, values in zip(out, (asked[start + q], entry[v], parts[q, v]), strict=True):
                    column.append(values)
        return _told(queries if len(asked) else vectors, ["query", "entry", "part"], out)

    return run


def _told(where: pa.Table, names: list[str], columns: list[list[np.ndarray]]) -> pa.Table:
    arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in columns]
    number = where["slice"][0].as_py() if where.num_rows else 0
    return pa.table([pa.array(np.full(len(arrays[0]), number, np.int32)), *arrays], ["slice", *names])


def _meet(queries: DataFrame, vectors: DataFrame, run, names: list[str]) -> DataFrame:
    kind = ", ".join(["slice int", *(f"{n} bigint" for n in names)])
    return queries.groupBy(*NODE).cogroup(vectors.groupBy(*NODE)).applyInArrow(run, kind)


def _inner(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("bigint"), lambda total, p: total + p)


def _scored(pairs: DataFrame, sliced: DataFrame) -> DataFrame:
    """``pairs`` (query, entry, slice) with their part, from the stored slices."""
    left = sliced.where("asked").select(F.col("entry").alias("query"), "slice", F.col("part").alias("__a"))
    right = sliced.select("entry", "slice", F.col("part").alias("__b"))
    return pairs.join(left, ["query", "slice"]).join(right, ["entry", "slice"]).withColumn("part", _inner("__a", "__b")).drop("__a", "__b")


def top_rows(vectors: DataFrame, k: int = 5, every: int = 50, slices: int = SLICES) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose vec_id ``every`` divides the ``k`` best other rows.

    Higher scores come first, of equal ones the smaller vec_id.
    """
    rows = materialize(_scaled(vectors), "scaled")
    entries = _entries(rows, every, k)
    held, asked = (materialize(side, "slices") for side in _dealt(entries, slices))
    sliced = held.where("query_block = 0").join(entries.select("entry", "asked"), "entry")
    wanted = k + 1  # a query may find itself

    # phase 1: the best of each list, and what the k-th best of them scores in full
    best = _meet(asked, held, _best_entries(FIRST * wanted), ["query", "entry", "part", "least", "mean"])
    best = materialize(best, "best")
    lists = best.groupBy("query", "slice").agg(F.min("least").alias("least"), F.floor(F.avg("mean")).alias("mean"))
    lists = materialize(lists, "lists")
    of_list = Window.partitionBy("query", "slice").orderBy(F.desc("part"), "entry")
    first = best.withColumn("nth", F.row_number().over(of_list)).where(F.col("nth") <= FIRST * wanted).select("query", "entry").distinct()
    every_slice = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    whole = _scored(first.select("*", every_slice), sliced).groupBy("query", "entry").agg(F.sum("part").alias("score"))
    of_query = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    # a query with fewer entries than it wants has no bound and takes all
    bound = whole.withColumn("nth", F.row_number().over(of_query)).where(F.col("nth") == wanted).select("query", F.col("score").alias("bound"))
    means = lists.groupBy("query").agg(F.sum("mean").alias("means"))
    limits = lists.join(means, "query").join(bound, "query", "left").withColumn("over", F.col("bound") - F.col("means"))
    # the least whole number that is no smaller than mean + over / slices
    share = F.expr(f"over div {slices} + IF(over % {slices} > 0, 1, 0)")
    limits = limits.select("query", "slice", "least", F.coalesce(F.col("mean") + share, F.col("least")).alias("cutoff"), "bound")
    limits = materialize(limits, "limits")

    # phase 2: all entries that reach the cutoff in some list, with bounds of their scores
    armed = asked.join(limits.select(F.col("query").alias("entry"), "slice", "cutoff"), ["entry", "slice"]).select(*NODE, "entry", "part", "cutoff")
    found = materialize(_meet(armed, held, _entries_above(slices), ["query", "entry", "part"]), "reached")
    whole_range = limits.groupBy("query").agg(F.sum("least").alias("lowest"), F.sum(F.col("cutoff") - 1).alias("highest"), F.first("bound").alias("bound"))
    known = found.join(limits.select("query", "slice", "least", "cutoff"), ["query", "slice"]).groupBy("query", "entry").agg(
        F.sum("part").alias("known"), F.sum(F.col("part") - F.col("least")).alias("over_least"), F.sum(F.col("part") - F.col("cutoff") + 1).alias("over_cutoff"),
        F.collect_set("slice").alias("seen"),
    )
    known = known.join(whole_range, "query").withColumns({"low": F.col("lowest") + F.col("over_least"), "high": F.col("highest") + F.col("over_cutoff")})
    by_low = Window.partitionBy("query").orderBy(F.desc("low"), "entry")
    surer = known.withColumn("nth", F.row_number().over(by_low)).where(F.col("nth") == wanted).select("query", F.col("low").alias("surer"))
    left = known.join(surer, "query", "left").where("high >= coalesce(greatest(surer, bound), high)").select("query", "entry", "known", "seen")
    left = materialize(left, "candidates")

    # phase 3: the parts that are missing
    missing = F.array_except(F.sequence(F.lit(0), F.lit(slices - 1)), F.col("seen"))
    fetched = _scored(left.select("query", "entry", F.explode(missing).alias("slice")), sliced)
    full = left.select("query", "entry", F.col("known").alias("part")).unionByName(fetched.select("query", "entry", "part"))
    full = full.groupBy("query", "entry").agg(F.sum("part").alias("score"))
    full = full.join(entries.select("entry", "ids"), "entry").withColumn("first", F.element_at("ids", 1))
    ranked = full.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("first").asc_nulls_last())))
    ranked = ranked.where(F.col("nth") <= wanted).select("query", "score", F.posexplode("ids").alias("place", "vec_id"), (F.col("entry") == F.col("query")).alias("itself"))
    # the k + 1 best rows of each distinct query; a query row then leaves itself out
    of_row = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "place")
    ranked = materialize(ranked.withColumn("nth", F.row_number().over(of_row)).where(F.col("nth") <= wanted), "ranked")
    return _answers(rows.where(_asks(every)), entries, ranked, k)


def _answers(asking: DataFrame, entries: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Of each row that asks the best rows of its vector, but for itself."""
    asking = asking.withColumnRenamed("vec_id", "query_id").join(entries.where("asked").select("x", F.col("entry").alias("query")), "x")
    answers = F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score", "itself"))).alias("answers")  # k + 1 rows
    joined = asking.select("query_id", "query").join(ranked.groupBy("query").agg(answers), "query")
    own = F.transform(F.filter("answers", lambda a: a["itself"] & a["vec_id"].eqNullSafe(F.col("query_id"))), lambda a: a["nth"])
    joined = joined.withColumn("own", F.array_min(own))
    others = F.slice(F.filter("answers", lambda a: ~a["nth"].eqNullSafe(F.col("own"))), 1, k)
    told = joined.select("query_id", F.posexplode(others).alias("place", "of"))
    return told.select("query_id", (F.col("place") + 1).alias("rank"), "of.vec_id", "of.score")
