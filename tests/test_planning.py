import random

from pyspark.sql import functions as F

from codequarry.operators import planning


def test_parse_index(spark, rows):
    df = spark.createDataFrame([("3",), ("3 # x",), (" 2 ",), ("x",), ("-1",), ("5",), (None,), ("1.0",), ("",)], "e string")
    ok, rejects = planning.parse_index(df, "e", F.lit(5))
    assert rows(ok, "e", "index") == sorted([("3", 3), ("3 # x", 3), (" 2 ", 2)], key=repr)
    assert dict(rows(rejects, "e", "reason")) == {"x": "not an index", "-1": "out of range", "5": "out of range", None: "not an index",
                                                 "1.0": "not an index", "": "not an index"}


def test_concepts(spark, rows):
    df = spark.createDataFrame([("a", "d", ["2 # x", "0", "2"]), ("b", None, ["0"]), ("c", "d", ["9"]), ("d", "d", None)],
                               "name string, description string, file_indices array<string>")
    ok, rejects = planning.validate_concepts(df, F.lit(3))
    assert rows(ok, "name", "files") == [("a", [0, 2])]
    assert rows(rejects, "name", "reason") == [("b", "missing keys"), ("c", "invalid file index"), ("d", "missing keys")]


def test_relations_and_coverage(spark, rows):
    concepts = spark.createDataFrame([(1, i, f"c{i}") for i in range(3)], "project_id int, idx long, name string")
    rel = spark.createDataFrame([(1, "0 # a", "1", "uses"), (1, "0", "7", "bad"), (1, "x", "1", "bad"), (1, "0", "1", None)],
                                "project_id int, `from` string, `to` string, label string")
    ok, rejects = planning.validate_relations(rel, concepts)
    assert rows(ok) == [(1, 0, 1, "uses")]
    assert sorted(r[0] for r in rows(rejects, "reason")) == ["invalid index", "invalid index", "missing keys"]
    assert rows(planning.uncovered_concepts(concepts, ok), "idx") == [(2,)]


def test_order_of_permutations(spark):
    rng = random.Random(2)
    orders, known, want = [], [], {}
    for p in range(30):
        n = rng.randrange(1, 8)
        listed = rng.sample(range(n), n)
        want[p] = True
        if p % 3 == 1:
            listed[0] = n + 5
            want[p] = False
        if p % 3 == 2:
            listed.append(listed[0])
            want[p] = False
        orders += [(p, i) for i in listed]
        known += [(p, i) for i in range(n)]
    bad = planning.validate_order(spark.createDataFrame(orders, "project_id int, idx int"), spark.createDataFrame(known, "project_id int, idx int"))
    failed = {r["project_id"] for r in bad.collect()}
    assert failed == {p for p, ok in want.items() if not ok}


def test_chapters(spark, rows):
    concepts = spark.createDataFrame([(1, 0, "Main Loop"), (1, 1, "I/O Über")], "project_id int, idx int, name string")
    order = spark.createDataFrame([(1, 1, 1), (1, 2, 0)], "project_id int, pos int, idx int")
    got = rows(planning.chapter_plan(order, concepts), "pos", "listing", "previous", "next")
    assert got == [(1, "1. [I/O Über](01_i_o_über.md)", None, "02_main_loop.md"), (2, "2. [Main Loop](02_main_loop.md)", "01_i_o_über.md", None)]


def test_index_lines(spark):
    projects = spark.createDataFrame([(1, "P", "sum", "http://r")], "project_id int, name string, summary string, repo_url string")
    concepts = spark.createDataFrame([(1, 0, 'Say "hi"'), (1, 1, "B")], "project_id int, idx int, name string")
    rel = spark.createDataFrame([(1, 0, 0, 1, 'a "quoted"\nlabel that is rather long indeed')], "project_id int, rel_no int, src int, dst int, label string")
    order = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "project_id int, pos int, idx int")
    plan = planning.chapter_plan(order, concepts)
    content = spark.createDataFrame([(1, 1)], "project_id int, pos int")
    lines = planning.index_lines(projects, plan, planning.diagram_lines(concepts, rel), content).orderBy("part", "place").collect()
    assert [r["line"] for r in lines] == [
        "# Tutorial: P", "", "sum", "", "**Source Repository:** [http://r](http://r)", "", "```mermaid", "flowchart TD", '    A0["Say hi"]', '    A1["B"]',
        '    A0 -- "a quoted label that is rath..." --> A1', "```", "", "## Chapters", "", "1. [Say \"hi\"](01_say__hi_.md)"]


def test_cache(spark, rows):
    prompts = spark.createDataFrame([(1, "g", "a"), (2, "g", "b"), (3, "g", "b"), (4, "h", "a")], "id int, provider string, prompt string")
    cache = spark.createDataFrame([("g:a", "known")], "key string, response string")
    hits, todo = planning.cache_split(prompts, cache)
    assert rows(hits, "id", "response") == [(1, "known")] and rows(todo, "provider", "prompt") == [("g", "b"), ("h", "a")]
    answers = todo.select("provider", "prompt", F.lit("new").alias("response"))
    assert rows(planning.cache_insert(cache, answers)) == [("g:a", "known"), ("g:b", "new"), ("h:a", "new")]


def test_headings(spark):
    cases = [("# Chapter 2: Old\nx", "# Chapter 2: Old\nx"), ("\n# Other\nx\n", "# Chapter 2: N\nx"), ("x\ny", "# Chapter 2: N\n\nx\ny"), ("#", "# Chapter 2: N")]
    df = spark.createDataFrame(cases, "given string, want string")
    got = df.select(planning.repair_heading(F.lit(2), F.lit("N"), F.col("given")), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_budget(spark, rows):
    df = spark.createDataFrame([("", ), ("a" * 60,), ("a" * 61 * 6,)], "t string")
    ok, over = planning.estimate_tokens(df, "t", 60)
    assert sorted(r[0] for r in rows(ok, "tokens")) == [0, 10] and rows(over, "tokens") == [(61,)]


def test_labels(spark):
    df = spark.createDataFrame([("https://h/o/repo.git", "/x"), ("https://h/o/digit.git/", "/x"), ("", "/a/b/"), (None, "b")], "u string, d string")
    assert [r[0] for r in df.select(planning.project_label(F.col("u"), F.col("d"))).collect()] == ["repo", "digit", "b", "b"]
