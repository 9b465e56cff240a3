"""SimHash near-duplicates: fingerprints of word shingles and a binary trie self-join.

Rows: NULL and empty texts have no words and the fingerprint zero.  Rows that repeat count as
documents of their own with the same fingerprint.  A NULL doc_id takes part, but names a
component only where no other id does (the component is then NULL).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import own_name, roots, slices, texts
from codequarry.llm.components import connected_components
from codequarry.session import materialize

BITS = 64
PIECE = 1 << 16  # shingles whose bits are counted at a time
LEAF = 64  # node pairs of at most so many fingerprint pairs are compared directly
FRONTIER = 1 << 17  # node pairs expanded at a time
HELD = 1 << 20  # fingerprints of whole shards held by a task at a time


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the shingles of ``words`` words, repeats included."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    count, ones = max(1, len(parts) - words + 1), np.zeros(BITS, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, count, PIECE):
        stop = min(count, start + PIECE)
        hashes = np.array([digest(join(parts[i : i + words]), seed) for i in range(start, stop)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prints = np.array([fingerprint(t, words, seed) for t in texts(part)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- linking ---------------------------------------------------------------------------------


def _widths(bits: int, blocks: int) -> list[int]:
    return [bits // blocks + (i < bits % blocks) for i in range(blocks)]


def _blocks(value: Column, bits: int, blocks: int) -> list[tuple[Column, Column, int]]:
    """(block's bits, the other bits, how many others) for each of ``blocks`` runs of bits."""
    out, low = [], 0
    for width in _widths(bits, blocks):
        taken = F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1))
        below = value.bitwiseAND(F.lit((1 << low) - 1)) if low else F.lit(0).cast("bigint")
        above = F.shiftleft(F.shiftrightunsigned(value, low + width), low) if low + width < BITS else F.lit(0).cast("bigint")
        out.append((taken, above.bitwiseOR(below), bits - width))
        low += width
    return out


def shards(prints: DataFrame, budget: int = 4, most: int = 1 << 18) -> DataFrame:
    """(shard, fp): two fingerprints that differ in ``budget`` bits or fewer share a shard.

    Of budget + 1 runs of bits one agrees, so each run's value names a subtree in which the
    trie of the other bits is searched.  Subtrees of more than ``most`` fingerprints are dealt
    out once more by the runs of their other bits; there are at most (budget + 1) * 2^13 of
    them, which bounds the broadcast.
    """
    runs = _blocks(F.col("fp"), BITS, budget + 1)
    keyed = [F.struct(F.lit(i).alias("block"), taken.alias("key"), rest.alias("rest")) for i, (taken, rest, _) in enumerate(runs)]
    first = prints.select("fp", F.explode(F.array(*keyed)).alias("at")).select("fp", "at.*")
    large = first.groupBy("block", "key").count().where(F.col("count") > most).select("block", "key", F.lit(True).alias("large"))
    dealt = first.join(F.broadcast(large), ["block", "key"], "left")
    again = F.lit(None)
    for i, (_, _, left) in enumerate(runs):
        inner = [F.struct(F.lit(j).alias("run"), taken.alias("value")) for j, (taken, _, _) in enumerate(_blocks(F.col("rest"), left, budget + 1))]
        again = F.when(F.col("block") == i, F.array(*inner)).otherwise(again)
    whole = F.array(F.struct(F.lit(-1).alias("run"), F.lit(0).cast("bigint").alias("value")))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("large"), again).otherwise(whole)))
    return dealt.select(F.struct("block", "key", "part.run", "part.value").alias("shard"), "fp")


def _leaf_links(fps: np.ndarray, pairs: tuple[np.ndarray, ...], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the linked fingerprints below node pairs (a, a's end, b, b's end)."""
    a, a_end, b, b_end = pairs
    wide = b_end - b
    size = (a_end - a) * wide
    pair = np.repeat(np.arange(len(a)), size)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    left, right = a[pair] + nth // wide[pair], b[pair] + nth % wide[pair]
    keep = left < right
    left, right = left[keep], right[keep]
    near = np.bitwise_count(fps[left] ^ fps[right]) <= budget
    return left[near], right[near]


def trie_components(fps: np.ndarray, shard: np.ndarray, budget: int) -> np.ndarray:
    """Root position of each fingerprint, joined within shards by links of ``budget`` bits or fewer.

    ``fps`` is sorted within shards, so a trie node is a range of positions.  Pairs of nodes go
    down together, a bit a step, with the bits in which they differ so far; a pair beyond the
    budget is left, and so is one whose fingerprints are all joined already.  The budget grows
    from one, so that dense groups are joined by their closest pairs first.
    """
    n = len(fps)
    root = np.arange(n)
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], n]
    several = ends - cuts > 1
    cuts, ends = cuts[several], ends[several]
    # ones[d][i]: set bits at depth d before position i
    ones = [None] * BITS
    changes = None  # how often the root changes before each position
    for allowed in range(1, budget + 1):
        zero = np.zeros(len(cuts), np.int64)
        todo = [(0, cuts, ends, cuts, ends, zero)]
        while todo:
            depth, a, a_end, b, b_end, apart = todo.pop()
            if len(a) > FRONTIER:
                half = len(a) // 2
                todo.append((depth, a[half:], a_end[half:], b[half:], b_end[half:], apart[half:]))
                todo.append((depth, a[:half], a_end[:half], b[:half], b_end[:half], apart[:half]))
                continue
            if changes is None:
                changes = np.r_[0, np.cumsum(root[1:] != root[:-1])]
            joined = (changes[a_end - 1] == changes[a]) & (changes[b_end - 1] == changes[b]) & (root[a] == root[b])
            small = (a_end - a) * (b_end - b) <= LEAF
            leaf = small & ~joined
            if leaf.any():
                left, right = _leaf_links(fps, (a[leaf], a_end[leaf], b[leaf], b_end[leaf]), allowed)
                if len(left):
                    root, changes = roots(n, left, right, root), None
            on = ~joined & ~small
            if depth == BITS or not on.any():
                continue
            a, a_end, b, b_end, apart = a[on], a_end[on], b[on], b_end[on], apart[on]
            if ones[depth] is None:
                ones[depth] = np.r_[0, np.cumsum((fps >> np.uint64(BITS - 1 - depth)) & np.uint64(1)).astype(np.int64)]
            bit = ones[depth]
            a_cut, b_cut = a_end - (bit[a_end] - bit[a]), b_end - (bit[b_end] - bit[b])
            same = a == b
            children = [
                (a, a_cut, b, b_cut, apart, None), (a_cut, a_end, b_cut, b_end, apart, None),
                (a, a_cut, b_cut, b_end, apart + 1, None), (a_cut, a_end, b, b_cut, apart + 1, same),
            ]
            kept = []
            for x, x_end, y, y_end, d, mirrored in children:
                keep = (x < x_end) & (y < y_end) & (d <= allowed)
                if mirrored is not None:
                    keep &= ~mirrored
                kept.append([v[keep] for v in (x, x_end, y, y_end, d)])
            merged = [np.concatenate(v) for v in zip(*kept, strict=True)]
            if len(merged[0]):
                todo.append((depth + 1, *merged))
    return root


def trie_links(prints: DataFrame, budget: int = 4) -> DataFrame:
    """(src, dst) between distinct fingerprints ``fp``: every pair within ``budget`` bits is joined
    by these links, of which each shard gives at most one per fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(shard: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            fps = fps.view(np.uint64)
            order = np.lexsort((fps, shard))
            fps, shard = fps[order], shard[order]
            root = trie_components(fps, shard, budget)
            moved = np.flatnonzero(root != np.arange(len(fps)))
            signed = fps.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[root[moved]])], ["src", "dst"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows, carried = 0, 0
        for batch in batches:
            at = batch.column(0).flatten()
            # rows come sorted by shard, so equal neighbours are one shard; number them in order
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in at]
            held.append((np.stack(columns), batch.column(1).to_numpy().astype(np.int64)))
            rows += batch.num_rows
            if rows - carried >= HELD:
                keys, fps = np.concatenate([k for k, _ in held], axis=1), np.concatenate([f for _, f in held])
                number = np.r_[0, np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))]
                last = int(np.searchsorted(number, number[-1]))
                if last:
                    yield solve(number[:last], fps[:last])
                held, rows = [(keys[:, last:], fps[last:])], len(fps) - last
                carried = rows
        if rows:
            keys, fps = np.concatenate([k for k, _ in held], axis=1), np.concatenate([f for _, f in held])
            yield solve(np.r_[0, np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))], fps)

    dealt = shards(prints, budget)
    ordered = dealt.repartition("shard").sortWithinPartitions("shard")
    return ordered.mapInArrow(run, "src bigint, dst bigint")


def _placed(nodes: DataFrame, budget: int) -> DataFrame:
    """The rows of ``nodes``, one per fingerprint ``fp``, with the fingerprint that names their component."""
    found = connected_components(trie_links(nodes.select("fp"), budget)).withColumnRenamed("component", "__component")
    joined = nodes.join(found, nodes["fp"] == found["id"], "left")
    return materialize(joined.select(*nodes.columns, F.coalesce("__component", "fp").alias("component")), "placed")


def near_duplicates(docs: DataFrame, words: int = 4, budget: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row: rows whose fingerprints differ in ``budget`` bits
    or fewer are linked, and component_id is the smallest doc_id reachable."""
    prints = materialize(fingerprints(docs, words, seed), "fingerprints")
    placed = _placed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), budget)
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = placed.join(named, "component").select(F.col("fp").alias("of"), "component_id")
    return prints.join(classes, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, words: int = 4, budget: int = 4, seed: int = 42) -> DataFrame:
    """The documents (with a column ``source``) without near-duplicates: of each component one row.

    It is the first by doc_id (NULL last), source, text hash and a number given to the row, whatever
    ids its component shares with others.
    """
    row = own_name()
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    rows = materialize(rows, "numbered")
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "source", F.xxhash64("text").alias("hash"), F.col(row).alias("row")).alias("doc_id"), "text")
    prints = materialize(fingerprints(named, words, seed), "fingerprints")
    placed = _placed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), budget)
    kept = placed.groupBy("component").agg(F.min("least").alias("first")).select(F.col("first.row").alias("kept"))
    kept = kept.withColumnRenamed("kept", kept_row := own_name())
    return rows.join(kept, F.col(row) == F.col(kept_row), "left_semi").drop(row)
