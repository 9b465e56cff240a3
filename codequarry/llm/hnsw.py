"""Near-duplicate vectors: hierarchical navigable small-world graphs per shard.

Vectors are compared within a label.  Equal vectors are one node with a multiplicity; the nodes of
a label are dealt into shards by a hash, each shard has a graph, built once, and every node searches every
shard of its label.  A search keeps a beam; the beam is widened for queries whose beam ends
within the threshold, and for all queries until an audit, brute force over a sample of them, finds
the wanted share of links.  The sample grows until it has seen enough links that are not to the query itself.
Queries whose beam still ends within the threshold after widening lie in a dense group: their links are
counted and joined by products with blocks of the shard, and never listed.  Links are verified in double precision.

Rows: vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows with a
NULL label or vec_id, link with nothing; they are their own component.  Rows that share a vec_id are
the same node for components, and each counts as a link of the other if both have the same vector.
"""

from __future__ import annotations

import io
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import roots
from codequarry.llm.components import connected_components
from codequarry.session import materialize

SHARD = 8192  # nodes of a graph
DEGREE = 12  # links of a new node; twice as many on the lowest level
BEAM = 48  # while building, and at first while searching
BATCH = 128  # nodes inserted, or queries answered, at a time
DENSE = 192  # widest beam of a query; nodes with more links than that are counted by products
AUDIT, AUDIT_MOST = 64, 2048  # queries compared with brute force, at first and at most
SEEN = 64  # links that an audit looks for
RECALL = 0.995
PRODUCTS = 1 << 20  # products held at a time


class Graph:
    """A graph over unit vectors, built by inserting batches."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.v = vectors.astype(np.float32)
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(DEGREE)).astype(np.int64), 8)
        self.links = [np.full((n, 2 * DEGREE if at == 0 else DEGREE), -1, np.int32) for at in range(int(self.level.max(initial=0)) + 1)]
        self.entry = -1
        for start in range(0, n, BATCH):
            self._insert(np.arange(start, min(n, start + BATCH)))

    def stored(self) -> bytes:
        """The graph without its vectors."""
        out = io.BytesIO()
        np.savez(out, level=self.level, entry=self.entry, **{f"links{at}": links for at, links in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def read(cls, vectors: np.ndarray, stored: bytes) -> Graph:
        """The graph ``stored`` over the vectors that it was built from, in the same order."""
        graph, held = cls.__new__(cls), np.load(io.BytesIO(stored))
        graph.v, graph.level, graph.entry = vectors.astype(np.float32), held["level"], int(held["entry"])
        graph.links = [held[f"links{at}"] for at in range(len(held.files) - 2)]
        return graph

    # -- search ----------------------------------------------------------------------------------

    def _beams(self, q: np.ndarray, entry: np.ndarray, beam: int, at: int, low: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` nodes found for each query on a level, best first (-1 where none).

        ``entry`` (queries x k) holds the nodes to start from.  All queries go on together: in a step
        each opens the best unopened nodes of its beam.
        """
        rows, n = len(q), len(self.v)
        seen = np.zeros((rows, n), bool)
        ids = np.full((rows, beam), -1, np.int64)
        sims = np.full((rows, beam), -2.0, np.float32)
        opened = np.zeros((rows, beam), bool)
        r, node = np.repeat(np.arange(rows), entry.shape[1]), entry.reshape(-1)
        ok = node >= 0
        r, node = r[ok], node[ok]
        wide = max(2, beam // 16)
        while True:
            # new nodes of each query, once
            key = np.unique(r * n + node)
            r, node = key // n, key % n
            fresh = ~seen[r, node]
            r, node = r[fresh], node[fresh]
            if len(r):
                seen[r, node] = True
                sim = np.einsum("ij,ij->i", q[r], self.v[node])
                count = np.bincount(r, minlength=rows)
                width = int(count.max())
                place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
                more_ids, more_sims = np.full((rows, width), -1, np.int64), np.full((rows, width), -2.0, np.float32)
                more_ids[r, place], more_sims[r, place] = node, sim
                all_ids, all_sims = np.concatenate([ids, more_ids], 1), np.concatenate([sims, more_sims], 1)
                all_open = np.concatenate([opened, np.zeros((rows, width), bool)], 1)
                order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
                ids, sims, opened = (np.take_along_axis(x, order, 1) for x in (all_ids, all_sims, all_open))
            closed = opened | (ids < 0)
            rank = np.cumsum(~closed, axis=1)
            pick = ~closed & (rank <= wide)
            if not pick.any():
                return ids, sims
            opened |= pick
            r, at_beam = np.nonzero(pick)
            near = self.links[at][ids[r, at_beam]]
            r, node = np.repeat(r, near.shape[1]), near.reshape(-1).astype(np.int64)
            ok = node >= 0
            r, node = r[ok], node[ok]

    def _descend(self, q: np.ndarray, down_to: int) -> np.ndarray:
        """For each query the best node of the levels above ``down_to``, as a column."""
        entry = np.full((len(q), 1), self.entry, np.int64)
        for at in range(int(self.level[self.entry]), down_to, -1):
            entry = self._beams(q, entry, 4, at)[0][:, :1]
        return entry

    def near(self, q: np.ndarray, least: float, beam: int) -> tuple[list[np.ndarray], np.ndarray]:
        """For each query the nodes found with a similarity of ``least`` or more, and whether there are too many to list.

        A beam that ends within ``least`` may have cut nodes off, so it is widened, up to ``DENSE``.
        """
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        dense = np.zeros(len(q), bool)
        todo, n = np.arange(len(q)), len(self.v)
        while len(todo):
            beam = min(beam, n)
            again = []
            step = max(1, min(BATCH, (1 << 22) // max(n, beam * 4)))
            for start in range(0, len(todo), step):
                some = todo[start : start + step]
                ids, sims = self._beams(q[some], self._descend(q[some], 0), beam, 0)
                inside = (sims >= least) & (ids >= 0)
                for k, row in enumerate(some):
                    found[row] = ids[k][inside[k]]
                if beam < n:
                    again.append(some[inside[:, -1]])
            todo = np.concatenate(again) if again else np.zeros(0, np.int64)
            if beam >= DENSE:
                dense[todo] = True
                break
            beam = min(beam * 4, DENSE)
        return found, dense

    # -- building --------------------------------------------------------------------------------

    def _choose(self, base: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each row's candidates, best first: one is taken if it is nearer to the row's
        vector than to those taken; places left over go to the best of the rest."""
        rows = len(base)
        taken = np.full((rows, most), -1, np.int64)
        count = np.zeros(rows, np.int64)
        chosen = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            live = (ids[:, c] >= 0) & (count < most)
            if not live.any():
                break
            others = np.einsum("rd,rkd->rk", self.v[ids[:, c]], self.v[taken])
            others[taken < 0] = -2.0
            take = live & (others.max(axis=1) < sims[:, c])
            taken[take, count[take]] = ids[take, c]
            chosen[take, c] = True
            count += take
        for c in range(ids.shape[1]):
            take = (ids[:, c] >= 0) & (count < most) & ~chosen[:, c]
            if take.any():
                taken[take, count[take]] = ids[take, c]
                count += take
        return taken

    def _insert(self, new: np.ndarray) -> None:
        top = int(self.level[self.entry]) if self.entry >= 0 else -1
        q = self.v[new]
        inside = q @ q.T  # among the batch by brute force, so that its own nodes are linked too
        for at in range(int(self.level[new].max()), -1, -1):
            here = np.flatnonzero(self.level[new] >= at)
            ids = np.full((len(here), 0), -1, np.int64)
            sims = np.zeros((len(here), 0), np.float32)
            if at <= top:
                ids, sims = self._beams(q[here], self._descend(q[here], at), BEAM, at)
            peers = np.where(here[None, :] < here[:, None], new[here][None, :], -1)
            peer_sims = np.where(peers >= 0, inside[np.ix_(here, here)], -2.0).astype(np.float32)
            ids, sims = np.concatenate([ids, peers], 1), np.concatenate([sims, peer_sims], 1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :BEAM]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            taken = self._choose(new[here], ids, sims, DEGREE)
            self.links[at][new[here], :DEGREE] = taken
            self._answer(at, np.repeat(new[here], DEGREE), taken.reshape(-1))
        best = new[np.argmax(self.level[new])]
        if self.entry < 0 or self.level[best] > self.level[self.entry]:
            self.entry = int(best)

    def _answer(self, at: int, source: np.ndarray, target: np.ndarray) -> None:
        """Add the links back, from each target to the new nodes, and thin out full nodes."""
        ok = target >= 0
        source, target = source[ok], target[ok]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        links, room = self.links[at], self.links[at].shape[1]
        place = np.arange(len(target)) - np.repeat(first, count)
        cand = np.full((len(nodes), room + int(count.max())), -1, np.int64)
        cand[:, :room] = links[nodes]
        cand[np.repeat(np.arange(len(nodes)), count), room + place] = source
        sims = np.einsum("rd,rkd->rk", self.v[nodes], self.v[cand])
        sims[cand < 0] = -2.0
        order = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        full = (cand >= 0).sum(axis=1) > room
        links[nodes[~full]] = cand[~full, :room]
        if full.any():
            links[nodes[full]] = self._choose(nodes[full], cand[full], sims[full], room)


def _links(graph: Graph, q: np.ndarray, least: float, seed: int, itself: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
    """For each query its nodes, and whether they are too many to list; the beam is widened until an audit finds enough.

    ``itself`` says that every query is a node, which the audit does not count.
    """
    unit32 = q.astype(np.float32)
    soft = least - 1e-5  # single precision may fall short; links are verified afterwards
    order, size = np.random.default_rng(seed).permutation(len(q)), AUDIT
    while True:
        audited = order[:size]
        exact = np.concatenate([(unit32[part] @ graph.v.T >= soft).sum(axis=1) for part in np.array_split(audited, -(-len(audited) // BATCH))]) - itself
        if exact.sum() >= SEEN or size >= min(len(q), AUDIT_MOST):
            break
        size *= 4
    beam, n = BEAM, len(graph.v)
    while True:
        found, dense = graph.near(unit32[audited], soft, beam)
        hit = sum(int(e) if d else max(0, len(f) - itself) for e, f, d in zip(exact, found, dense, strict=True))
        if beam >= n or hit >= RECALL * exact.sum():
            break
        beam *= 2
    return graph.near(unit32, soft, beam)


class Side(NamedTuple):
    """The unit vectors of a shard, how many rows each stands for, and their graph."""

    unit: np.ndarray
    rows: np.ndarray
    graph: Graph


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _counted(left: Side, right: Side | None, least: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes of two shards, or of one, the number of rows linked to each and the least position joined to it."""
    alone = right is None
    right = left if alone else right
    n, m = len(left.unit), len(right.unit)
    from_right = 0 if alone else n  # position of the right side's first node
    size = n if alone else n + m
    links, root = np.zeros(size, np.int64), np.arange(size)
    if not n or not m:
        return links, root
    there, dense = _links(right.graph, left.unit, least, seed, alone)
    back, dense_right = ([], dense) if alone else _links(left.graph, right.unit, least, seed, False)

    # links between nodes of few links, found from either side
    x = np.concatenate([np.repeat(np.arange(n), [len(h) for h in there]), *back]).astype(np.int64)
    y = np.concatenate([*there, np.repeat(np.arange(len(back)), [len(h) for h in back])]).astype(np.int64)
    if alone:
        x, y = np.minimum(x, y), np.maximum(x, y)
        x, y = x[x < y], y[x < y]
    few = ~dense[x] & ~dense_right[y]
    key = np.unique(x[few] * m + y[few])
    x, y = key // m, key % m
    near = [np.einsum("ij,ij->i", left.unit[x[s : s + 65536]], right.unit[y[s : s + 65536]]) >= least for s in range(0, len(x), 65536)]
    near = np.concatenate(near) if near else np.zeros(0, bool)
    x, y = x[near], y[near]
    np.add.at(links, x, right.rows[y])
    np.add.at(links, from_right + y, left.rows[x])
    root = roots(size, x, from_right + y, root)

    # nodes of many links against all of the other side
    sides = [(left, right, 0, from_right, dense, dense_right)]
    if not alone:
        sides.append((right, left, from_right, 0, dense_right, dense))
    for one, other, first, other_first, many, other_many in sides:
        queries, rest = np.flatnonzero(many), np.flatnonzero(~other_many)
        step = max(1, PRODUCTS // len(other.unit))
        for start in range(0, len(queries), step):
            some = queries[start : start + step]
            near = one.unit[some] @ other.unit.T >= least
            if alone:
                near[np.arange(len(some)), some] = False
            links[first + some] += near @ other.rows
            links[other_first + rest] += one.rows[some] @ near[:, rest]
            at, to = np.nonzero(near)
            root = roots(size, first + some[at], other_first + to, root)
    return links, root


def near_vectors(vectors: DataFrame, least: float = 0.98, shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of vectors (vec_id, embedding, label).

    n_links is the number of other rows linked directly, component_id the smallest vec_id reachable.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & nonzero, F.lit(False))
    # equal vectors are told by their label and 128 bits of hashes
    name = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), F.reverse("embedding")).alias("h2")]
    named = materialize(rows.where(usable).select("vec_id", "label", *name, "embedding"), "vectors")
    nodes = named.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("rows"), F.first("embedding").alias("embedding"))
    nodes = materialize(nodes, "nodes")
    sizes = nodes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards")).withColumnRenamed("label", "of")
    dealt = nodes.join(sizes, F.col("label") == F.col("of")).withColumn("own", F.pmod(F.xxhash64(F.lit(5), "h1"), F.col("shards")).cast("int"))
    # written, so that what follows is dealt by shard and by pair of shards, not by label
    dealt = materialize(dealt.select("label", "shards", "own", "h1", "h2", "node", "rows", "embedding"), "dealt")
    kind = vectors.schema["label"].dataType.simpleString()

    def lengths_of(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Rows and vectors by length, in one order everywhere; vectors of different lengths have no cosine."""
        if not table.num_rows:
            return {}
        flat = table["embedding"].combine_chunks()
        lengths = flat.value_lengths().to_numpy()
        order = np.lexsort([*(table[c].to_numpy() for c in ("h2", "h1", "node")), lengths])
        found = {}
        for size in np.unique(lengths):
            at = order[lengths[order] == size]
            found[int(size)] = at, _unit(flat.take(pa.array(at)).flatten().to_numpy().reshape(-1, size))
        return found

    def build(table: pa.Table) -> pa.Table:
        built = {size: Graph(unit).stored() for size, (_, unit) in lengths_of(table).items()}
        first = table.select(["label", "own"]).slice(0, 1).take(pa.array(np.zeros(len(built), np.int64)))
        return first.append_column("size", pa.array(list(built), pa.int32())).append_column("graph", pa.array(list(built.values()), pa.binary()))

    graphs = dealt.groupBy("label", "own").applyInArrow(build, f"label {kind}, own int, size int, graph binary")
    graphs = materialize(graphs, "graphs")

    # a pair of shards is one task, in which either searches the other's graph
    def paired(rows: DataFrame) -> DataFrame:
        every = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        return every.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("shards", "other")

    def search(table: pa.Table, built: pa.Table) -> pa.Table:
        first, second = table["a"][0].as_py(), table["b"][0].as_py()
        graph = {(g["own"], g["size"]): g["graph"] for g in built.select(["own", "size", "graph"]).to_pylist()}
        own = table["own"].to_numpy()
        sides = {}
        for shard in {first, second}:
            here = np.flatnonzero(own == shard)
            for size, (at, unit) in lengths_of(table.take(pa.array(here))).items():
                rows = here[at]
                sides[shard, size] = rows, Side(unit, table["rows"].to_numpy()[rows], Graph.read(unit, graph[shard, size]))
        node, parts = table["node"].to_numpy(), []
        for size in sorted({size for _, size in sides}):
            held = [sides[shard, size] for shard in sorted({first, second}) if (shard, size) in sides]
            if first != second and len(held) < 2:
                continue
            rows = np.concatenate([at for at, _ in held])
            links, root = _counted(held[0][1], held[1][1] if len(held) > 1 else None, least, 11)
            told = np.flatnonzero(links > 0)  # those without links have nothing to tell
            some = table.select(["label", "h1", "h2", "node"]).take(pa.array(rows[told]))
            parts.append(some.append_column("links", pa.array(links[told])).append_column("root", pa.array(node[rows[root[told]]])))
        empty = table.select(["label", "h1", "h2", "node"]).slice(0, 0).append_column("links", pa.array([], pa.int64()))
        return pa.concat_tables([empty.append_column("root", pa.array([], pa.int64())), *parts])

    shards = dealt.select("label", "own", "shards").distinct()
    pairs = paired(dealt).groupBy("label", "a", "b")
    stored = paired(graphs.join(shards, ["label", "own"])).groupBy("label", "a", "b")
    told = pairs.cogroup(stored).applyInArrow(search, f"label {kind}, h1 bigint, h2 bigint, node bigint, links bigint, root bigint")
    told = materialize(told, "links")
    many = told.groupBy("label", "h1", "h2").agg(F.sum("links").alias("links"))
    found = connected_components(told.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    placed = nodes.select("label", "h1", "h2", "node", "rows").join(many, ["label", "h1", "h2"], "left").join(found, F.col("node") == F.col("id"), "left")
    placed = placed.select(
        "label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    linked = named.select("vec_id", "label", "h1", "h2").join(placed, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    lone = rows.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id"))
    return linked.unionByName(lone)
