"""What several of these operators need: bounded Arrow slices, words, and links."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a document, as Java's patterns write them.
WORD = r"[^\x20\x09-\x0D]+"

SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` of about ``most`` bytes of ``column``, at least a row each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // most
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a column, NULL as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def own_name() -> str:
    """A column name that no table of others has."""
    return f"own_{uuid.uuid4().hex}"


def remainder(column: str, divisor: int) -> Column:
    """crc32 of an id's decimal text modulo ``divisor``; NULL ids give -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % divisor, F.lit(-1))


def kept_in_worker(kind: str, key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a Python worker and kept from task to task.

    Functions travel to executors by value, with globals of their own in every task, so what is kept
    hangs on a module that lives as long as the worker.  Of each kind the last key is kept.
    """
    home = sys.modules.setdefault("codequarry_worker", types.ModuleType("codequarry_worker"))
    if getattr(home, kind, (None, None))[0] != key:
        setattr(home, kind, (key, make()))
    return getattr(home, kind)[1]


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, trained: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents that may be learned from.

    ``trained`` says which label rows may be used.  The rows are the first by a hash of their
    id, so a rerun takes the same ones; the bound makes the broadcast of their ids safe.
    """
    usable = labels.where(trained & F.col(target).isin(0, 1) & F.col("doc_id").isNotNull())
    first = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    ids = usable.select("doc_id", F.col(target).cast("int").alias("label")).orderBy(first, "doc_id", "label").limit(rows)
    wanted = docs.select("doc_id", "text")
    return wanted.join(F.broadcast(ids), "doc_id")


def roots(size: int, left: np.ndarray, right: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest position joined to each of ``size`` positions by links, continuing from ``root``."""
    root = np.arange(size) if root is None else root
    while True:
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            return root
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
