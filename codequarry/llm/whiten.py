"""Whitening of vectors on their leading components, found by slicing the spectrum of their covariance.

Components of a vector become whole numbers x = floor(64 c) + 1000000.  Sums are exact: the vectors are
centred by their rounded mean before they are multiplied, products are summed as whole numbers, and what rounding the mean
left is taken off as whole numbers too.  The covariance, one matrix whatever the number of rows, goes to the driver.
There, counts of negative pivots in LDLt factors of the shifted matrix (Bunch-Kaufman pivots)
halve intervals until each holds one of the leading eigenvalues, Rayleigh quotient iteration runs to its fixed point from inside the interval, and
two more counts certify that the eigenvalue found is the one of that number.

Rows: a vector that is NULL, empty, or holds NULL or non-finite components is left out, and so is one with
a component beyond 2^53 / 64 in size, whose whole numbers would not be exact, and one whose length is not the
commonest (of equally common ones the longest), which has no covariance with the others.  Repeated rows stay, but count
once in the fit.  Components are numbered as far as the covariance has a rank: directions in which all vectors
agree cannot be whitened and are left out, so a single distinct vector gives no rows.  Of equal eigenvalues any orthonormal basis is
taken.  ``deviation`` is NULL where it does not fit a long.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.session import materialize

SCALE, OFFSET = 64, 1_000_000
LARGEST = 2.0**53 / SCALE  # size of a component
EXACT = 2**53  # whole numbers up to here are exact in double precision
BLOCK = 4096  # vectors multiplied at a time


# ---- whole numbers -----------------------------------------------------------------------------


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    c = F.col("embedding").cast("array<double>")
    fine = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST)) & (F.size("c") > 0)
    x = F.transform("c", lambda v: F.floor(v * SCALE) + OFFSET).alias("x")
    return vectors.select("vec_id", c.alias("c")).where(F.coalesce(fine, F.lit(False))).select("vec_id", x)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _products(y: np.ndarray) -> np.ndarray:
    """Exact sums of the products of every two columns of whole numbers, as Python's integers where need be."""
    largest = int(np.abs(y).max(initial=0))
    if largest * largest * len(y) < EXACT:
        exact = y.astype(np.float64)
        return (exact.T @ exact).astype(np.int64)
    exact = y.astype(object)
    return exact.T @ exact


def _summed(rows: DataFrame, what: str) -> np.ndarray:
    """The sum over ``rows`` (at, part decimal) by ``at``; ``at`` counts from 0 and ``what`` names it in errors."""
    total = rows.groupBy("at").agg(F.sum("part").alias("total")).orderBy("at").collect()
    if [r["at"] for r in total] != list(range(len(total))):
        raise ValueError(f"{what}: a sum is missing")
    return np.array([r["total"] for r in total], object)


@dataclass
class Fit:
    """Exact sums of the distinct vectors: how many, the shift taken off, sums after the shift, and their covariance."""

    n: int
    shift: np.ndarray  # whole numbers, the rounded means
    sums: np.ndarray  # of x - shift, Python integers
    covariance: np.ndarray  # doubles


def fit(distinct: DataFrame, size: int) -> Fit | None:
    """The sums of ``distinct`` vectors x of one length; None if there are none."""
    n = distinct.count()
    if not n:
        return None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, object)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                small = int(np.abs(x).max()) * len(x) < 2**63
                total = total + (x if small else x.astype(object)).sum(axis=0).astype(object)
        yield from _parts(total)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), object)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                total = total + _products(_matrix(batch.column("x").slice(start, BLOCK)) - shift)
        yield from _parts(total[np.triu_indices(size)])

    kind = "at int, part decimal(38,0)"
    whole = _summed(distinct.mapInArrow(sums, kind), "means")
    shift = np.array([(2 * int(s) + n) // (2 * n) for s in whole], np.int64)
    rest = np.array([int(s) - n * int(a) for s, a in zip(whole, shift, strict=True)], object)
    above = _summed(distinct.mapInArrow(products, kind), "products")
    covariance = np.zeros((size, size))
    for (i, j), product in zip(np.transpose(np.triu_indices(size)), above, strict=True):
        # one rounding, from whole numbers
        covariance[i, j] = covariance[j, i] = (n * int(product) - rest[i] * rest[j]) / (n * n)
    return Fit(n, shift, rest, covariance)


def _parts(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), parts], ["at", "part"])


# ---- the spectrum ------------------------------------------------------------------------------


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``.

    By Sylvester's law they are the positive pivots of the LDLt factors of the shifted matrix; pivots
    are single or two by two, chosen as Bunch and Kaufman do.
    """
    a = matrix - shift * np.eye(len(matrix))
    tiny = np.finfo(float).tiny
    bound = (1 + math.sqrt(17)) / 8
    count = 0
    while len(a):
        corner, column = abs(a[0, 0]), np.abs(a[1:, 0])
        most = column.max(initial=0.0)
        pair = None
        if most > 0 and corner < bound * most:
            r = 1 + int(column.argmax())
            row = np.abs(a[r])
            row[r] = 0
            if corner * row.max() >= bound * most * most:
                pass
            elif abs(a[r, r]) >= bound * row.max():
                order = np.r_[r, np.delete(np.arange(len(a)), r)]
                a = a[np.ix_(order, order)]
            else:
                pair = r
        if pair is None:
            pivot = a[0, 0]
            if pivot == 0:  # an eigenvalue at the shift itself does not exceed it
                pivot = -tiny
            count += pivot > 0
            factor = a[1:, 0]
            a = a[1:, 1:] - np.outer(factor / pivot, factor) if most else a[1:, 1:]
        else:
            order = np.r_[0, pair, np.delete(np.arange(1, len(a)), pair - 1)]
            a = a[np.ix_(order, order)]
            count += 1  # such a pair has one eigenvalue of each sign
            factor = a[2:, :2]
            a = a[2:, 2:] - factor @ np.linalg.solve(a[:2, :2], factor.T)
        a = (a + a.T) / 2
    return count


def _isolated(matrix: np.ndarray, most: int, floor: float) -> list[tuple[float, float, int, int]]:
    """Intervals (low, high, eigenvalues above high, eigenvalues above low), from the top, that hold one eigenvalue
    each or are as narrow as double precision can tell apart; they hold the ``most`` leading ones above ``floor``."""
    radius = np.abs(matrix).sum(axis=1).max()
    top = float(radius * (1 + 1e-9))
    narrow = 4 * np.finfo(float).eps * radius * len(matrix)
    found, todo = [], [(floor, top, 0, above(matrix, floor))]
    while todo:
        low, high, before, upto = todo.pop()
        if upto == before or before >= most:
            continue
        middle = (low + high) / 2
        # an interval around one eigenvalue is halved until it is narrow beside its distance from zero
        if high - low <= narrow or upto - before == 1 and high - low <= 1e-3 * high:
            found.append((low, high, before, upto))
            continue
        at = min(max(above(matrix, middle), before), upto)
        todo.append((low, middle, at, upto))
        todo.append((middle, high, before, at))
    return found


def _without(vector: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in others:
            vector = vector - (other @ vector) * other
    return vector / np.linalg.norm(vector)


def _quotients(matrix: np.ndarray, low: float, high: float, known: list[np.ndarray], dice: np.random.Generator) -> tuple[float, np.ndarray]:
    """An eigenvalue and its unit vector by Rayleigh quotient iteration, begun from the middle of an interval.

    Two steps of inverse iteration turn the start towards the interval; then the quotient is the shift.
    """
    eye, v = np.eye(len(matrix)), _without(dice.standard_normal(len(matrix)), known)
    shift, least, best = (low + high) / 2, math.inf, (0.0, v)
    for step in range(40):
        try:
            v = _without(np.linalg.solve(matrix - shift * eye, v), known)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            shift = np.nextafter(shift, math.inf)
            continue
        value = float(v @ matrix @ v)
        error = float(np.linalg.norm(matrix @ v - value * v))
        if step >= 2 and error >= least:
            break
        if error < least and low <= value <= high:
            least, best = error, (value, v)
        if step >= 1:
            shift = value if low <= value <= high else (low + high) / 2
    return best


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of a covariance, falling, with unit vectors as columns; those of rank zero are left out."""
    size = len(matrix)
    scale = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    if not size or not scale > 0:
        return np.zeros(0), np.zeros((size, 0))
    eps = np.finfo(float).eps
    floor = scale * eps * size
    dice, values, vectors = np.random.default_rng(3), [], []
    for low, high, before, upto in _isolated(matrix, most, floor):
        cluster: list[tuple[float, np.ndarray]] = []
        for _ in range(before, min(upto, most)):
            slack = 8 * eps * scale * size
            for attempt in range(20):
                value, v = _quotients(matrix, low - slack, high + slack, [*vectors, *(u for _, u in cluster)], dice)
                error = float(np.linalg.norm(matrix @ v - value * v))
                # no more eigenvalues lie above the interval found than were counted, and this one does lie in it
                near = max(error, slack)
                if error <= 64 * slack and above(matrix, value + near) <= upto - 1 and above(matrix, value - near) > before:
                    break
            else:
                raise ArithmeticError(f"eigenvalue {before + 1} was not isolated")
            cluster.append((value, v))
        for value, v in sorted(cluster, key=lambda c: -c[0]):
            values.append(value)
            vectors.append(v)
    return np.array(values), np.array(vectors).T.reshape(size, len(values))


# ---- rows --------------------------------------------------------------------------------------


def _project(x: np.ndarray, model: Fit, axes: np.ndarray) -> np.ndarray:
    """x less its mean, on the whitening axes."""
    mean = np.array([float(s) for s in model.sums]) / model.n
    return ((x - model.shift).astype(np.float64) - mean) @ axes


def whitened(vectors: DataFrame, most: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and component."""
    rows = materialize(scaled(vectors), "scaled")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    result = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], result)
    size = lengths["size"]
    rows = rows.where(F.size("x") == size)
    distinct = materialize(rows.select("x").distinct(), "distinct")
    model = fit(distinct, size)
    values, axes = leading(model.covariance, most)
    explained = values / np.trace(model.covariance)
    axes = axes / np.sqrt(values)
    k = len(values)
    if not k:
        return rows.sparkSession.createDataFrame([], result)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                w = _project(_matrix(batch.column("x").slice(start, BLOCK)), model, axes)
                total += np.concatenate([w.T @ w, w.sum(axis=0, keepdims=True)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], ["at", "part"])

    total = _summed(distinct.mapInArrow(moments, "at int, part double"), "moments").astype(float).reshape(k + 1, k) / model.n
    off = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x = _matrix(part.column("x"))
                w = _project(x, model, axes)
                m = part.num_rows
                arrays = [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)), pa.array(_deviations(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(w.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, off)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, result)


def _deviations(x: np.ndarray, model: Fit) -> list[int | None]:
    """The squared distance of n * x from the sums, as whole numbers."""
    y = x - model.shift
    largest = int(np.abs(y).max(initial=0)) + 1
    if (2 * model.n * largest) ** 2 * x.shape[1] < 2**63:
        part = model.n * y - model.sums.astype(np.int64)
        return (part * part).sum(axis=1).tolist()
    part = model.n * y.astype(object) - model.sums
    return [d if d < 2**63 else None for d in (part * part).sum(axis=1).tolist()]
