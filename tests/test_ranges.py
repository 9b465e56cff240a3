"""Huge JSON documents by byte ranges, against a parser of whole documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from codequarry.sources import documents, ranges


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at:at + n]


WORDS = ["nodes", 'a"b', "\\", "\\\\", '\\"', "{", "}]", "[nodes", "é漢🙂", "", " : ", '": [{', "x" * 40, "\n"]


def value(rng, depth):
    kind = rng.randrange(6 if depth else 3)
    if kind < 3:
        return [rng.choice(WORDS), rng.random(), None][kind]
    if kind < 5:
        return {rng.choice(WORDS): value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [value(rng, depth - 1) for _ in range(rng.randrange(4))]


def by_ranges(text, target, key, size):
    file, total = Bytes(text), len(text)
    inside, stack, found = 0, [], []
    for start in range(0, total, size):
        end = min(total, start + size)
        found += [(o, json.loads(raw)) for o, raw in ranges._records(file, start, end, total, bool(inside), stack, target, key)]
        closed, left = ranges._summary(file, start, end, bool(inside))
        stack = stack[:max(0, len(stack) - closed)] + left
        inside = (inside + ranges._quotes(file, start, end)) % 2
    assert not inside and not stack
    assert [o for o, _ in found] == sorted({o for o, _ in found})
    return [r for _, r in found]


@pytest.mark.parametrize("block", [3, 16, 1 << 20])
def test_records_of_any_cut(monkeypatch, block):
    monkeypatch.setattr(ranges, "BLOCK_BYTES", block)
    rng = random.Random(block)
    for trial in range(4):
        nodes = [value(rng, 3) for _ in range(rng.randrange(6))] + [{"nodes": [{"deep": 1}]}]
        document = {"before": value(rng, 3), "meta": {"total": 1, "nodes": [{"not": "these"}]}, "nodes": nodes,
                    "outer": {"inner": [{"n": 1}, 5, {"n": "}"}]}, "after": value(rng, 2)}
        text = json.dumps(document, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode()
        records = [n for n in nodes if isinstance(n, dict)]
        for size in (1, 7, 50, 10_000):
            assert by_ranges(text, ["{", "[nodes"], "", size) == records
            assert by_ranges(text, ["{"], "meta", size) == [document["meta"]]
            assert by_ranges(text, ["{", "{outer", "[inner"], "", size) == [{"n": 1}, {"n": "}"}]
        bare = json.dumps(nodes).encode()
        assert by_ranges(bare, ["["], "", 9) == records


def test_documents_by_ranges(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    (tmp_path / "in put").mkdir()
    for name in ("one", "tw o", "three"):
        nodes = [{"id": f"{name}{i}", "node_type": rng.choice(["function", "class"]), "name": rng.choice(WORDS), "complexity": i,
                  "content": rng.choice(WORDS) * rng.randrange(200)} for i in range(rng.randrange(20, 30))]
        (tmp_path / "in put" / f"{name}.json").write_text(json.dumps({"analysis_metadata": {"total_nodes": len(nodes)}, "nodes": nodes}))
        want |= {n["id"]: n for n in nodes}
    (tmp_path / "in put" / "empty.json").write_text("")
    path = str(tmp_path / "in put")
    for size in (700, 1 << 25):
        got = documents.read_analysis(spark, path, range_bytes=size)
        assert {r["id"]: (r["node_type"], r["name"], r["complexity"], r["content"]) for r in got.collect()} == {
            i: (n["node_type"], n["name"], n["complexity"], n["content"]) for i, n in want.items()}
        assert got.count() == len(want)
        only = documents.read_analysis(spark, path, kind="class", range_bytes=size)
        assert {r["id"] for r in only.collect()} == {i for i, n in want.items() if n["node_type"] == "class"}
        assert documents.read_analysis_metadata(spark, path, range_bytes=size).agg(F.sum("total_nodes")).first()[0] == len(want)


def test_document_written_and_read(spark, tmp_path):
    nodes = spark.range(300).selectExpr("cast(id as string) id", "'function' node_type", "concat('f\"', id) name")
    for rows in (nodes, nodes.limit(1), nodes.limit(0)):
        path = str(tmp_path / f"out{rows.count()}")
        documents.write_analysis_document(rows.selectExpr("count(*) total_nodes"), rows, path)
        whole = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
        assert len(whole["nodes"]) == whole["analysis_metadata"]["total_nodes"] == rows.count()
        got = documents.read_analysis(spark, path, range_bytes=500).select("id", "node_type", "name")
        assert sorted(got.collect()) == sorted(rows.collect())
