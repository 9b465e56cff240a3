"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is taken target / source size times on average: the whole part of
that for certain, one more time with the fraction as probability.  The fractions are rounded by
the pivotal method: two documents trade probability, their expected words staying the same, until
one of them is certain.  What is left of each task's documents goes on to the next level of a
reduction tree, so a source's words miss its target by less than one document's size.

Rows: NULL and empty texts have size 0 and are taken 0 words.  NULL sources are one source, the
last.  Of rows that agree in doc_id, source and size those that are due for certain are taken, and the fraction of one row
is rounded; which of them are taken once more goes by their texts.  Sources without words have target 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.ranking import positions
from codequarry.llm.common import WORD, own_name
from codequarry.session import materialize

MOST = 3  # times a document may be taken
FAN = 4096  # documents, or what is left of as many groups, that one task rounds together
WEIGHTS = (1, 2, 3)
NEAR_ONE = 1e-9


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) of each source of (source, size) rows.

    Sources by code point, NULL last, weigh ``weights`` in turn and share all words; a target
    stops at ``most`` times its source's size and the excess goes to the others by weight.  The
    sources still open are those with the largest weights per word, so what is open is found from
    running sums in the order of size / weight, without repeating.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    spare = total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = spare / F.sum("weight").over(after)  # words a unit of weight, if all before are full
    at = weighed.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") > most * F.col("source_size"))
    rate = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(Window.partitionBy())["level"]
    share = F.coalesce(rate * F.col("weight"), F.lit(0.0))
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(share)
    return at.select("source", "source_size", target.alias("target"))


def _round(prob: np.ndarray, size: np.ndarray, dice: np.random.Generator) -> np.ndarray:
    """Pivotal rounding in the given order; at most one fraction is left."""
    out = prob.copy()
    draws = dice.random(len(prob))
    held = -1
    for i in range(len(out)):
        if out[i] <= NEAR_ONE or out[i] >= 1 - NEAR_ONE:
            out[i] = round(out[i])
            continue
        if held < 0:
            held = i
            continue
        p, q, a, b = out[held], out[i], size[held], size[i]
        # words that may move from the held one to this one, and the other way
        there, back = min(p * a, (1 - q) * b), min((1 - p) * a, q * b)
        moved = there if draws[i] * (there + back) < back else -back
        p, q = p - moved / a, q + moved / b
        done_p = p <= NEAR_ONE or p >= 1 - NEAR_ONE
        done_q = q <= NEAR_ONE or q >= 1 - NEAR_ONE
        out[held], out[i] = (round(p) if done_p else p), (round(q) if done_q else q)
        held = held if not done_p else i if not done_q else -1
    return out


def copies(units: DataFrame, fan: int = FAN, seed: int = 1) -> DataFrame:
    """``units`` (key, group, wants, mass and more) without the key and with ``extra`` 0 or 1, in
    expectation ``wants``.

    Units of a group are dealt into nodes of about ``fan`` by a hash of their key, each node leaves
    at most one fraction, and ``fan`` nodes' fractions make a node of the next level.  A node's units
    go from the largest to the smallest, so that what is left is small; that order depends on ``mass``
    and ``key`` alone, so neither partitions nor reruns change the outcome.
    """
    columns = [c for c in units.columns if c != "key"]
    hashed = F.xxhash64(F.lit(seed), "key")
    number = units.groupBy("group").agg(F.count(F.lit(1)).alias("many")).withColumnRenamed("group", "of")
    nodes = F.greatest(F.lit(1), F.ceil(F.col("many") / fan)).cast("bigint")
    joined = units.join(number, F.col("group").eqNullSafe(F.col("of")))
    state = joined.select(*columns, hashed.alias("turn"), F.pmod(hashed, nodes).alias("node"), F.col("wants").alias("prob"))
    # depth: levels until the largest group has one node
    most = number.agg(F.max("many")).first()[0] or 0
    levels, left = 1, -(-most // fan)
    while left > 1:
        levels, left = levels + 1, -(-left // fan)
    schema = state.schema

    def run(level: int):
        def solve(table: pa.Table) -> pa.Table:
            mass, prob = table["mass"].to_numpy(), table["prob"].to_numpy()
            turn = table["turn"].to_numpy()
            order = np.lexsort((prob, turn, -mass))
            dice = np.random.default_rng([seed, level, int(turn.min()) & (2**63 - 1), len(turn)])
            out = np.empty(len(prob))
            out[order] = _round(prob[order], mass[order], dice)
            return table.set_column(table.column_names.index("prob"), "prob", pa.array(out))

        return solve

    done = None
    for level in range(levels):
        by = F.floor(F.col("node") / fan**level).cast("bigint")
        solved = materialize(state.groupBy("group", by.alias("__node")).applyInArrow(run(level), schema), "rounded")
        certain = F.col("prob").isin(0.0, 1.0)
        settled = solved if level + 1 == levels else solved.where(certain)
        done = settled if done is None else done.unionByName(settled)
        state = solved.where(~certain)
    # the one fraction that may be left of a group is drawn
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "turn"), F.lit(1 << 30)) / float(1 << 30)
    extra = F.when(F.col("prob").isin(0.0, 1.0), F.col("prob").cast("int")).otherwise((draw < F.col("prob")).cast("int"))
    return done.select(*columns, extra.alias("extra"))


def mix(docs: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, rows): how often the mix takes a document, at most ``most``.

    ``rows`` is how many rows that agree in doc_id, source and size are taken so; they have two lines where some of them
    are taken once more than others.
    """
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    units = materialize(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    wanted = targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")), most, weights)
    wanted = wanted.withColumnRenamed("source", "of")
    joined = units.join(F.broadcast(wanted) if _few(wanted) else wanted, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    whole = F.least(F.floor(ratio + NEAR_ONE), F.lit(most)).cast("int")
    joined = joined.withColumn("whole", whole).withColumn("due", F.greatest(F.lit(0.0), ratio - F.col("whole")) * F.col("rows"))
    # of the rows that are due once more the whole number is certain, and a fraction of one row is left
    joined = joined.withColumn("certain", F.least(F.floor(F.col("due") + NEAR_ONE), F.col("rows")))
    joined = joined.withColumns({
        "group": F.col("source"), "key": F.struct("doc_id", "size"), "mass": F.col("size").cast("double"),
        "wants": F.greatest(F.lit(0.0), F.col("due") - F.col("certain")),
    })
    open_ = (F.col("mass") > 0) & (F.col("wants") > 0)
    names = ["doc_id", "source", "size", "source_size", "target"]
    rounded = copies(joined.where(open_), seed=seed).select(*names, "whole", "rows", (F.col("certain") + F.col("extra")).alias("more"))
    plain = joined.where(~open_).select(
        *names, F.when(F.col("mass") > 0, F.col("whole")).otherwise(F.least(F.lit(1), F.col("whole"))).alias("whole"), "rows",
        F.when(F.col("mass") > 0, F.col("certain")).otherwise(0).alias("more"),
    )
    settled = rounded.unionByName(plain)
    taken = F.array(
        F.struct((F.col("whole") + 1).alias("times"), F.col("more").cast("bigint").alias("rows")),
        F.struct(F.col("whole").alias("times"), (F.col("rows") - F.col("more")).cast("bigint").alias("rows")),
    )
    told = settled.select(*names, F.explode(F.filter(taken, lambda t: t["rows"] > 0)).alias("taken"))
    return told.select(*names, "taken.times", "taken.rows")


def _few(wanted: DataFrame, most: int = 10_000) -> bool:
    """Whether there are so few sources that their targets may be broadcast."""
    return wanted.limit(most + 1).count() <= most


def mixed(docs: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns."""
    found = mix(docs, most, weights, seed)
    own = {name: own_name() for name in ("doc_id", "source", "size", "least", "more", "words", "row", "nth", "place", "times")}
    times = found.groupBy("doc_id", "source", "size").agg(
        F.min("times").alias(own["least"]), F.max(F.struct("times", F.when(F.col("times") > 0, F.col("rows")).alias("rows"))).alias(own["more"]),
        F.count(F.lit(1)).alias(own["row"]),
    )
    times = times.withColumnsRenamed({name: own[name] for name in ("doc_id", "source", "size")})
    # written, so that both sides of the join are plain shuffles, whose hot keys are split at run time
    times = materialize(times.where(F.col(own["more"])["times"] > 0), "times")
    same = F.col("doc_id").eqNullSafe(F.col(own["doc_id"])) & F.col("source").eqNullSafe(F.col(own["source"])) & (F.col(own["words"]) == F.col(own["size"]))
    # there is a line for each document, so this side is not one to broadcast either
    joined = docs.withColumn(own["words"], size_of(F.col("text"))).join(times.hint("merge"), same)

    def again(rows: DataFrame, count: Column) -> DataFrame:
        return rows.withColumn(own["times"], F.explode(F.array_repeat(F.lit(1), count.cast("int")))).select(*docs.columns)

    if times.where(F.col(own["row"]) > 1).isEmpty():
        return again(joined, F.col(own["least"]))
    # of the rows that agree the first by their texts are taken once more
    joined = materialize(joined.withColumn(own["nth"], F.monotonically_increasing_id()), "taken")
    alike = F.col(own["row"]) == 1
    numbered = positions(joined.where(~alike), [own["doc_id"], own["source"], own["size"]], [F.xxhash64("text"), F.col("text"), F.col(own["nth"])], own["place"])
    once_more = (F.col(own["place"]) <= F.col(own["more"])["rows"]).cast("int")
    return again(joined.where(alike), F.col(own["least"])).unionByName(again(numbered, F.col(own["least"]) + once_more))
