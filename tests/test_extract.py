import random

from pyspark.sql import functions as F

from codequarry.operators import extract, graph

SAMPLE = '''
def hello_world(name: str) -> str:
    """A simple greeting function"""
    return f"Hello, {name}!"

class TestClass:
    """A test class"""
    def __init__(self, value):
        self.value = value

    async def process(self):
        return self.value * 2

import os
from typing import Dict, List
'''


def table(spark, *contents):
    return spark.createDataFrame([(f"f{i}.py", c) for i, c in enumerate(contents)], "path string, content string")


def test_sample(spark, rows):
    files = table(spark, SAMPLE)
    functions = {r["name"]: r for r in extract.extract_functions(files).collect()}
    assert set(functions) == {"hello_world", "__init__", "process"}
    hello = functions["hello_world"]
    assert (hello["line_start"], hello["line_end"], hello["column_start"]) == (2, 4, 1)
    assert hello["docstring"] == "A simple greeting function" and hello["parameters"] == ["name"]
    assert not hello["is_async"] and not hello["is_method"] and hello["qualified_name"] == "f0.hello_world"
    assert functions["process"]["is_async"] and functions["process"]["is_method"]
    assert (functions["process"]["line_start"], functions["process"]["line_end"], functions["process"]["column_start"]) == (11, 12, 5)
    (cls,) = extract.extract_classes(files).collect()
    assert (cls["name"], cls["methods"], cls["base_classes"], cls["docstring"]) == ("TestClass", ["__init__", "process"], [], "A test class")
    assert (cls["line_start"], cls["line_end"]) == (6, 12)
    found = rows(extract.extract_imports(files), "module", "imports", "import_type", "line_start")
    assert found == [("os", ["os"], "import", 14), ("typing", ["Dict", "List"], "from_import", 15)]


def test_strict_heads_leave_out_annotated(spark, rows):
    assert rows(extract.extract_functions(table(spark, SAMPLE), annotated=False), "name") == [("__init__",), ("process",)]


def test_import_continuation_lines(spark, rows):
    files = table(spark, "from a.b import (x,\n    y as z,\n)\nimport c as d, e\nfrom . import q\n")
    got = rows(extract.extract_imports(files), "module", "imports", "line_start", "line_end")
    assert (("a.b", ["x", "y as z"], 1, 3) in got) and (("c as d", ["c as d", "e"], 4, 4) in got)


def test_parameters(spark):
    df = spark.createDataFrame([("self, a: int = 3, *args, b=2, **kw, c",), ("",)], "s string")
    got = [tuple(r) for r in df.select(extract.parameter_names(F.col("s")), extract.parameter_names(F.col("s"), bare_only=True)).collect()]
    assert got == [(["self", "a", "*args", "b", "**kw", "c"], ["self", "c"]), ([], [])]


def test_docstring_forms(spark):
    bodies = [
        "def a():\n    x = 1\n    'late'\n    return x",
        "def b():\n    if x:\n        'deeper is none'\n    return 1",
        'def c():\n    r"""two\n    lines"""\n',
        "def d(): pass",
        "def e():\n    '''" + "y" * 300 + "'''",
    ]
    df = spark.createDataFrame([(i, b.split("\n")) for i, b in enumerate(bodies)], "i int, b array<string>")
    got = [r[1] for r in sorted(df.select("i", extract.docstring(F.col("b"))).collect())]
    assert got == ["late", None, "two\n    lines", None, "y" * 200]


def test_block_extent_with_nested_and_blank_lines(spark, rows):
    code = "class A:\n\n    def f(self):\n        if 1:\n            pass\n\n    def g(self): pass\n\n\nx = 1\ndef h():\n\treturn 1"
    got = rows(extract.block_extents(table(spark, code)), "head", "line_start", "line_end")
    assert got == sorted([("class A:", 1, 7), ("def f(self):", 3, 5), ("def g(self): pass", 7, 7), ("def h():", 11, 12)], key=repr)


def test_extraction_has_no_shuffle(spark):
    plan = extract.extract_functions(table(spark, SAMPLE))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_file_dim_first_node_wins(spark, rows):
    nodes = spark.createDataFrame(
        [("p/q.py", "https://github.com/o/r.git", "https://github.com/o/r/blob/dev/p/q.py#L1", 1),
         ("p/q.py", "https://github.com/o/r.git", "https://github.com/o/r/blob/old/p/q.py#L9", 2), ("s", None, None, 3)],
        "file_path string, repo_url string, github_url string, n int")
    got = rows(extract.file_dim(nodes, ["n"]))
    assert got == sorted([
        ("p/q.py", "q.py", "py", "p", "https://github.com/o/r.git", "https://github.com/o/r/blob/dev/p/q.py"), ("s", "s", "", "", "", "")], key=repr)


def test_embedding_text(spark):
    df = spark.createDataFrame(
        [("function", "f", "parse", None, ["a", "b"], "doc", ["x"], "z" * 600, "/r/.git/src/m.py")],
        "node_type string, name string, purpose string, domain string, technologies array<string>, docstring string, "
        "parameters array<string>, content string, file_path string")
    got = df.select(extract.embedding_text(df)).first()[0]
    assert got == "function f | purpose: parse | technologies: a, b | doc | parameters: x | " + "z" * 600 + " | file: src/m.py"


def test_batches(spark):
    df = spark.createDataFrame([(i, "t" * 9000) for i in range(250)], "id int, text string")
    got = extract.assign_batches(df, ["id"]).select("id", "batch", "part", "start", F.length("text").alias("n")).collect()
    assert sorted((r["id"], r["part"], r["start"], r["n"]) for r in got) == sorted((i, *p) for i in range(250) for p in ((0, 0, 8000), (1, 8000, 1000)))
    assert all(r["batch"] == (2 * r["id"] + r["part"]) // 100 for r in got)


def test_parts_make_up_the_text(spark):
    rng = random.Random(6)
    texts = ["", "a", "\n" * 50, "x" * 95, "é\n" * 40, None] + ["".join(rng.choice("ab \n😀é") for _ in range(rng.randrange(200))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    parts = {}
    for r in extract.assign_batches(df, ["id"], most=30).collect():
        parts.setdefault(r["id"], []).append((r["part"], r["start"], r["text"]))
    for i, text in enumerate(texts):
        held = sorted(parts[i])
        assert "".join(p[2] for p in held) == (text or "") and all(len(p[2]) <= 30 for p in held)
        assert [p[1] for p in held] == [sum(len(q[2]) for q in held[:n]) for n in range(len(held))]
        for (_, _, part), (_, _, following) in zip(held, held[1:]):
            assert part.endswith("\n") or "\n" not in part and len(part) == 30


def test_vectors_of_parts(spark):
    df = spark.createDataFrame([(1, 3, [1.0, 0.0]), (1, 1, [0.0, 4.0]), (2, 5, [2.0, 2.0])], "id int, n int, embedding array<double>")
    assert {r["id"]: r["embedding"] for r in extract.join_parts(df, ["id"], "n").collect()} == {1: [0.75, 1.0], 2: [2.0, 2.0]}


def test_entities_hold_whole_texts(spark, rows):
    note, steps = "n" * 300 + " end of note", "".join(f"        step_{i} = {i}\n" for i in range(60))
    code = f'class A:\n    """{note}"""\n    def f(self):\n        """{note}"""\n{steps}        return late_term\n'
    functions, classes = extract.extract_functions(table(spark, code)), extract.extract_classes(table(spark, code))
    for found in (functions, classes):
        (row,) = found.collect()
        assert row["docstring"] == note and row["content"].rstrip().endswith("return late_term")
    assert rows(graph.contains_lookup(functions, "none such", "late_term"), "name") == [("f",)]


def spans_by_stack(indents):
    ends, openers, open_lines, last = [0] * len(indents), [0] * len(indents), [], 0
    for i, indent in enumerate(indents):
        if indent < 0:
            continue
        while open_lines and indents[open_lines[-1]] >= indent:
            ends[open_lines.pop()] = last
        openers[i] = open_lines[-1] + 1 if open_lines else 0
        open_lines.append(i)
        last = i + 1
    for i in open_lines:
        ends[i] = last
    return ends, openers


def test_block_spans_like_a_stack(spark):
    rng = random.Random(8)
    files = [[rng.choice([-1, 0, 1, 2, 2, 4, 4, 8, 40]) for _ in range(rng.randrange(60))] for _ in range(200)]
    files += [[], [-1, -1], [3], list(range(300)), list(range(300, 0, -1)), [0] + [4] * 5000 + [0], [5, 3, 5, 3, 0, 3, 5]]
    df = spark.createDataFrame(list(enumerate(files)), "n int, indents array<int>").repartition(3)
    for r in df.select("indents", extract.block_spans("indents").alias("s")).collect():
        assert (r["s"]["ends"], r["s"]["openers"]) == spans_by_stack(r["indents"])


def test_source_rows_are_dealt_by_their_number(spark, tmp_path):
    """One small file of many narrow rows makes as many tasks as its texts need."""
    from codequarry.session import dealt

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert dealt(table, 20).rdd.getNumPartitions() == 50
    assert sorted(r[0] for r in dealt(table, 20).collect()) == list(range(1000))
    assert dealt(table.repartition(60), 20).rdd.getNumPartitions() == 60


def test_columns_of_heads_alone_need_no_blocks(spark, rows):
    """Heads of wanted columns are the same rows, found without the Python step that looks for block ends."""
    text = "class A(B):\n    def f(self, x):\n        return g(x)\n\n\nasync def h(): pass\nclass C:"
    files = spark.createDataFrame([(1, "a/b.py", text), (2, "c.py", None), (3, "d.py", "def k(y)  :\n")], "idx int, path string, content string")
    for found in (extract.extract_functions, extract.extract_classes):
        whole = found(files)
        head = [c for c in whole.columns if c in extract.HEAD_COLUMNS]
        few = found(files, columns=head)
        assert few.columns == head and rows(few) == rows(whole, *head)
        assert "ArrowEvalPython" in whole.select(*head)._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in few._jdf.queryExecution().executedPlan().toString()
        assert rows(found(files, columns=[*head, "content"])) == rows(whole, *head, "content")


def test_code_metrics_look_for_blocks_of_functions_only(spark, tmp_path):
    import __spark_entry__ as entry

    orders = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    spark.createDataFrame([(1, 2, "O", 3.5, "1-URGENT")], orders).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(2,)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    metrics = entry.queries()["source_code_metrics"](spark, str(tmp_path))
    assert [tuple(r)[0::3] for r in metrics.collect()] == [(5, 1)]
    assert metrics._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
