"""Edge builders on a small hand-written graph and against brute force on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from codequarry.operators import edges, graph
from codequarry.session import materialize

# id, name, qualified_name, file_path, line_start: a name in two files, a namesake pair in one file, a nested one
FUNCTIONS = [
    ("a1", "load", "pkg.a.load", "pkg/a.py", 1),
    ("a2", "save", "pkg.a.save", "pkg/a.py", 10),
    ("a3", "load", "pkg.a.load", "pkg/a.py", 20),
    ("b1", "load", "pkg.b.load", "pkg/b.py", 1),
    ("b2", "main", "pkg.b.main", "pkg/b.py", 5),
    ("c1", "solo", "c.solo", "c.py", 1),
    ("c2", "only", "c.only", "c.py", 9),
]
CALLED = [
    ("a1", "load"), ("a2", "load"), ("b1", "load"), ("b2", "save"), ("b2", "load"), ("c1", "solo"), ("c1", "load"), ("c2", "solo"), ("c2", "nothing"),
]


def functions(spark):
    rows = [(*f, "function", f"doc {f[0]}", f"url {f[0]}") for f in FUNCTIONS]
    return spark.createDataFrame(rows, "id string, name string, qualified_name string, file_path string, line_start int, node_type string, docstring string, github_url string")


def called(spark):
    return spark.createDataFrame(CALLED, "caller_id string, called_name string")


def no_edges(spark, schema):
    return spark.createDataFrame([], schema)


def test_calls_first_and_last_wins(spark, rows):
    got = rows(edges.calls(functions(spark), called(spark)), "src", "dst", "called_name", "resolution_type")
    assert got == sorted([
        ("a1", "a3", "load", "qualified"),   # duplicate qualified name: the last loaded
        ("a2", "a3", "load", "qualified"),
        ("b1", "a1", "load", "name_based"),  # qualified hit is itself: falls to the first by name
        ("b2", "b1", "load", "qualified"),
        ("b2", "a2", "save", "name_based"),
        ("c1", "a1", "load", "name_based"),
        ("c2", "c1", "solo", "qualified"),
    ], key=repr)


def test_inherits_cycle_and_self(spark, rows):
    classes = spark.createDataFrame(
        [(1, "A", "m.A", "m.py", 1), (2, "B", "m.B", "m.py", 5), (3, "A", "n.A", "n.py", 1)],
        "id int, name string, qualified_name string, file_path string, line_start int")
    bases = spark.createDataFrame([(1, "B"), (2, "A"), (3, "A"), (3, "Gone")], "class_id int, base string")
    assert rows(edges.inherits(classes, bases), "src", "dst", "resolution_type") == [
        (1, 2, "qualified"), (2, 1, "qualified"), (3, 1, "name_based")]


def belongs_brute(methods, classes):
    out = []
    for m, f, line in methods:
        held = [(hi - lo, lo, i) for i, cf, lo, hi in classes if cf == f and lo <= line <= hi]
        if held:
            out.append((m, min(held)[2]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_belongs_to_like_brute_force(spark, rows, seed):
    rng = random.Random(seed)
    classes = []
    for i in range(400):
        lo = rng.randrange(0, 3000)
        classes.append((i, "hot" if i % 3 else f"f{i % 5}", lo, lo + rng.choice([0, 1, 2, 7, 8, 63, 64, 500, 2500, -1])))
    methods = [(i, rng.choice(["hot", "f0", "f3", "none"]), rng.randrange(0, 6000)) for i in range(1500)]
    m = spark.createDataFrame(methods, "id int, file_id string, line int")
    c = spark.createDataFrame(classes, "id int, file_id string, lo int, hi int")
    assert rows(edges.belongs_to(m, c, ["lo", "id"]), "src", "dst") == belongs_brute(methods, classes)


def test_belongs_to_nested_class(spark, rows):
    m = spark.createDataFrame([("x", "f", 12), ("y", "f", 3), ("z", "f", 99)], "id string, file_id string, line int")
    c = spark.createDataFrame([("out", "f", 1, 30), ("in", "f", 10, 15)], "id string, file_id string, lo int, hi int")
    assert rows(edges.belongs_to(m, c, ["lo", "id"]), "src", "dst") == [("x", "in"), ("y", "out")]


@pytest.mark.parametrize("seed", [3, 4])
def test_import_targets_like_brute_force(spark, rows, seed):
    rng = random.Random(seed)
    part = lambda: rng.choice(["a", "ab", "b", "pkg", "x1"])
    modules = [".".join(part() for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    imports = [(rng.choice(modules), rng.choice("fgh")) for _ in range(150)] + [(None, "f")]
    entities = [(i, rng.choice("fgh"), rng.choice(["function", "class"]), "/".join(part() for _ in range(rng.randrange(1, 4))) + ".py") for i in range(120)]
    i = spark.createDataFrame(imports, "module string, item string")
    e = spark.createDataFrame(entities, "id int, name string, node_type string, file_path string")
    want = {(m, item, n, t) for m, item in imports if m for n, name, t, p in entities
            if name == item and (m.replace(".", "/") in p or p.endswith(m + ".py"))}
    assert rows(edges.import_targets(i, e), "module", "item", "id", "node_type") == sorted(want, key=repr)


def test_module_targets_like_brute_force(spark, rows):
    rng = random.Random(5)
    modules = ["os", "pkg.mod", "mod", "pkg", "mo"]
    entities = [(i, rng.choice(["mod", "os", "other"]), "function", rng.choice(["pkg/mod.py", "mod.py", "os.py", "a/os.pyx", "pkg/other.py"])) for i in range(40)]
    i = spark.createDataFrame([(m,) for m in modules], "module string")
    e = spark.createDataFrame(entities, "id int, name string, node_type string, file_path string")
    want = {(m, n) for m in modules for n, name, _, p in entities
            if p.endswith(".py") and name == p.split("/")[-1].split(".")[0] and m.replace(".", "/") in p}
    assert rows(edges.module_targets(i, e), "module", "id") == sorted(want, key=repr)


def scoped_brute(fs, called_rows, membership, imports, targets):
    """Single call edges as the rules state them."""
    by_id = {f[0]: f for f in fs}
    home = dict(membership)
    out = set()
    for caller, name in called_rows:
        path = by_id[caller][3]
        local = {f[0] for f in fs if f[3] == path and f[1] == name and f[0] != caller}
        mods = {m for p, m, item in imports if p == path and item == name}
        imported = {t for m, item, t in targets if m in mods and item == name}
        method = {f[0] for f in fs if f[1] == name and f[0] != caller and home.get(caller) and home.get(f[0]) == home[caller]}
        near = local | imported | method
        far = set() if near else {f[0] for f in fs if f[1] == name and f[0] != caller}
        for kind, found in (("CALLS_LOCAL", local), ("CALLS_IMPORTED", imported), ("CALLS_METHOD", method), ("CALLS_GLOBAL", far)):
            out |= {(caller, kind, t, name) for t in found}
    return sorted(out, key=repr)


@pytest.fixture
def scoped(spark):
    """Random functions, calls, classes and imports, with sites and members built from them."""
    rng = random.Random(7)
    fs = [(f"f{i}", rng.choice("pqrs"), f"q{i}", f"d{rng.randrange(4)}/m{rng.randrange(3)}.py", i) for i in range(60)]
    called_rows = sorted({(rng.choice(fs)[0], rng.choice("pqrstu")) for _ in range(150)})
    membership = [(f[0], f"{f[3]}#{i % 2}") for i, f in enumerate(fs) if i % 3]
    imports = [(rng.choice(fs)[3], f"d{rng.randrange(4)}" + rng.choice(["", ".m1"]), rng.choice("pqrs")) for _ in range(25)]
    targets = sorted({(m, item, f[0]) for _, m, item in imports for f in fs if f[1] == item and m.replace(".", "/") in f[3]})
    f_df = spark.createDataFrame(fs, "id string, name string, qualified_name string, file_path string, line_start int").withColumn("github_url", F.lit("u"))
    c_df = spark.createDataFrame(called_rows, "caller_id string, called_name string")
    m_df = spark.createDataFrame(membership, "function_id string, class_id string")
    i_df = spark.createDataFrame(imports, "file_path string, module string, item string")
    t_df = spark.createDataFrame([(*t, "function") for t in targets], "module string, item string, id string, node_type string")
    members = edges.call_members(f_df, m_df, i_df, t_df)
    sites = edges.call_sites(f_df, c_df, m_df, i_df, members)
    return fs, called_rows, scoped_brute(fs, called_rows, membership, imports, targets), members, sites, f_df


def test_scoped_calls_like_brute_force(scoped, rows):
    _, _, want, members, sites, _ = scoped
    got = edges.expand_calls(sites, members).distinct()
    assert {k for _, k, _, _ in want} == {"CALLS_LOCAL", "CALLS_IMPORTED", "CALLS_METHOD", "CALLS_GLOBAL"}
    assert rows(got, "src", "type", "dst", "called_name") == want


def test_site_counts_are_edge_counts(scoped):
    _, _, want, _, sites, _ = scoped
    assert sum(r["n_targets"] for r in sites.collect()) == len(want)
    stats = dict(graph.call_stats(sites).collect())
    assert stats == {k: sum(1 for w in want if w[1] == k) for k in stats}


def test_callers_of(scoped, rows):
    _, _, want, _, sites, f_df = scoped
    got = {}
    for r in graph.callers_of(sites, f_df, "p").collect():
        got[(r["caller_id"], r["type"])] = r["n_targets"]
    expected = {}
    for src, kind, _, name in want:
        if name == "p":
            expected[(src, kind)] = expected.get((src, kind), 0) + 1
    assert got == expected


def test_find_usages(spark, scoped, rows):
    fs, _, want, members, sites, f_df = scoped
    classes = spark.createDataFrame([("k1", "p", "k.py", 1, "u"), ("k2", "Kid", "k.py", 9, "u"), ("k3", "Lone", "l.py", 1, "u")],
                                    "id string, name string, file_path string, line_start int, github_url string")
    inherits = spark.createDataFrame([("k2", "k1")], "src string, dst string")
    resolved = spark.createDataFrame([("i1", "class", "k2"), ("i1", "class", "k1")], "src string, node_type string, dst string")
    imports = spark.createDataFrame([("i1", "i.py", 3, "u")], "id string, file_path string, line_start int, github_url string")
    asked = spark.createDataFrame([("p",), ("Kid",), ("Lone",)], "name string")
    got = rows(graph.find_usages(asked, f_df, classes, sites, members, inherits, resolved, imports), "name", "usage_file", "usage_line", "usage_type")
    by_id = {f[0]: f for f in fs}
    expected = {("p", by_id[s][3], by_id[s][4], "function_call") for s, _, _, name in want if name == "p"}
    reached = {d for _, _, d, name in want if name == "p"}
    if any(f[1] == "p" and f[0] not in reached for f in fs):
        expected.add(("p", None, None, None))
    expected |= {("p", "k.py", 9, "inheritance"), ("Kid", "i.py", 3, "import"), ("Lone", None, None, None)}
    assert got == sorted(expected, key=repr)


def test_go_to_definition_tiers(spark, rows):
    fs = functions(spark)
    files = fs.select(F.col("file_path").alias("path")).distinct()
    membership = spark.createDataFrame([("b2", "K"), ("c1", "K")], "function_id string, class_id string")
    imports = spark.createDataFrame([("c.py", "pkg.b", "load")], "file_path string, module string, item string")
    targets = spark.createDataFrame([("pkg.b", "load", "b1")], "module string, item string, id string")
    requests = spark.createDataFrame([
        (1, "pkg/a.py", "save", "load"), (2, "c.py", "solo", "load"), (3, "pkg/b.py", "main", "solo"), (4, "pkg/b.py", None, "solo"),
        (5, "gone.py", "x", "load"), (6, "c.py", "solo", "missing")],
        "request_id int, caller_file string, caller_function string, function_name string")
    got = rows(graph.go_to_definition(requests, fs, files, membership, imports, targets), "request_id", "github_link", "resolution_type")
    assert got == [(1, "url a1", "local"), (2, "url b1", "imported"), (3, "url c1", "method"), (4, "url c1", "global")]


def test_definitions_are_shown_by_number(spark, rows):
    """Scopes carry numbers of definitions, not what is shown of them; equal rows, repeated ids and NULLs stay apart."""
    fs = spark.createDataFrame([
        ("x", "f", "b.py", 2, "u2", "second"), ("x", "f", "b.py", 2, "u1", None), ("x", "f", "b.py", 2, "u1", None), ("y", "f", "a.py", None, None, "first"),
        ("z", "g", "c.py", 1, "u3", "own")], "id string, name string, file_path string, line_start int, github_url string, docstring string")
    files = fs.select(F.col("file_path").alias("path")).distinct()
    membership = spark.createDataFrame([("x", "K"), ("z", "K")], "function_id string, class_id string")
    imports = spark.createDataFrame([("a.py", "m", "g"), ("a.py", "m", "g")], "file_path string, module string, item string")
    targets = spark.createDataFrame([("m", "g", "z")], "module string, item string, id string")
    requests = spark.createDataFrame([
        (1, "b.py", None, "f"), (2, "c.py", "g", "f"), (2, "c.py", "g", "f"), (3, "c.py", None, "f"), (4, "a.py", "f", "g"), (None, "b.py", "f", "g")],
        "request_id int, caller_file string, caller_function string, function_name string")
    found = graph.go_to_definition(requests, fs, files, membership, imports, targets)
    assert rows(found, "request_id", "file_path", "line_number", "github_link", "documentation", "resolution_type") == sorted([
        (1, "b.py", 2, "u1", None, "local"), (2, "b.py", 2, "u1", None, "method"), (2, "b.py", 2, "u1", None, "method"),
        (3, "a.py", None, None, "first", "global"), (4, "c.py", 1, "u3", "own", "imported"), (None, "c.py", 1, "u3", "own", "method")], key=repr)
    assert "struct(" not in _plan(found)


def test_class_hierarchy_trails_in_a_cycle(spark, rows):
    classes = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id int, name string")
    inherits = spark.createDataFrame([(1, 2), (2, 1), (3, 2)], "src int, dst int")
    got = rows(graph.class_hierarchy(inherits, classes, "A"), "path")
    # every edge at most once per path
    assert got == sorted([([2, 1],), ([3, 2, 1],), ([1, 2, 1],)], key=repr)
    with pytest.raises(ValueError):
        graph.class_hierarchy(inherits, classes, "A", max_depth=1)
    assert len(rows(graph.class_hierarchy(inherits, classes, "A", max_depth=2), "path")) == 3
    assert rows(graph.class_hierarchy(inherits, classes, "none"), "path") == []


def test_class_hierarchy_equals_a_walk(spark, rows):
    """Diamonds, a repeated edge, a self edge, cycles and NULL ends, against a walk edge by edge."""
    rng = random.Random(4)
    for trial in range(3):
        pairs = [(rng.randrange(9), rng.randrange(9)) for _ in range(12)] + [(1, 0), (2, 0), (3, 1), (3, 2), (3, 2)]
        want, open_ = [], [([0], [])]
        while open_:
            path, used = open_.pop()
            for edge in set(pairs) - set(used):
                if edge[1] == path[0]:
                    open_.append(([edge[0], *path], [*used, edge]))
                    want.append((edge[0], 0, len(path), [edge[0], *path]))
        inherits = spark.createDataFrame(pairs + [(None, 0), (5, None)], "src int, dst int")
        classes = spark.createDataFrame([(i, "R" if i == 0 else "x") for i in range(9)] + [(None, "R")], "id int, name string")
        assert rows(graph.class_hierarchy(inherits, classes, "R")) == sorted(want, key=repr)


def test_class_hierarchy_of_a_long_chain(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    inherits = spark.range(1, 501).selectExpr("id AS src", "id - 1 AS dst")
    got = graph.class_hierarchy(inherits, spark.createDataFrame([(0, "A")], "id bigint, name string"), "A")
    assert got.agg(F.count("*"), F.max("depth"), F.max(F.size("path")), F.min(F.element_at("path", 1) - F.col("child"))).first() == (500, 500, 501, 0)
    assert written.count("runs") <= 10  # one join per doubling, not per level


def test_group_links_and_partners(spark, rows):
    df = spark.createDataFrame([(1, "f", "x"), (2, "f", "x"), (3, "c", "x"), (4, "f", "y"), (5, "f", None), (6, "f", "")], "id int, node_type string, purpose string")
    links = edges.group_links(df, "purpose")
    assert rows(links, "id", "partners") == [(1, 2), (2, 2), (3, 2)]
    assert rows(edges.partners_of(spark.createDataFrame([(2,), (4,)], "id int"), links), "src", "dst") == [(2, 1), (2, 3)]


def test_discover_needs_whole_name(spark, rows):
    df = spark.createDataFrame([(1, "do_insert", "p/neo.py", "x"), (2, "insertion", "q.py", "x"), (3, "Insert", "q.py", None), (4, "other", "p/neo.py", "x")],
                               "id int, name string, file_path string, content string")
    calls = spark.createDataFrame([(2, "session_run")], "caller_id int, called_name string")
    assert rows(graph.discover(df, calls, [], "[Ii]nsert", ["neo"], [], ["session"]), "id") == []
    assert rows(graph.discover(df, calls, ["insert"], "x", ["neo"], [], ["session"]), "id") == [(1,), (2,)]


def test_metrics_without_classes_is_zero(spark):
    f = spark.createDataFrame([("a", 3, "p", None), ("b", 4, "p", None)], "name string, complexity int, purpose string, domain string")
    row = graph.code_metrics(f, f.limit(0), f.limit(0)).first().asDict()
    assert row == {"total_functions": 2, "avg_complexity": 3.5, "max_complexity": 4, "purposes": 1, "domains": 0, "total_classes": 0, "total_files": 0}


def test_load_stats_counts_distinct(spark, rows):
    nodes = spark.createDataFrame([("F", "1", True), ("F", "1", True), ("F", "2", False), ("F", None, False)], "label string, id string, has_embedding boolean")
    links = spark.createDataFrame([("1", "T", "2"), ("1", "T", "2"), ("2", "T", None)], "src string, type string, dst string")
    assert rows(edges.load_stats(nodes, links)) == [("edge", "T", 2, 0, 1), ("node", "F", 2, 1, 1)]


@pytest.mark.parametrize("grams", [1, 3, 5])
def test_contained_like_brute_force(spark, rows, grams):
    rng = random.Random(grams)
    word = lambda n: "".join(rng.choice("abé/") for _ in range(rng.randrange(n)))
    pieces = [(rng.randrange(3), word(9)) for _ in range(120)] + [(0, ""), (1, None), (None, "a"), (9, "a")]
    paths = [(rng.randrange(3), word(14)) for _ in range(150)] + [(0, None), (None, "ab"), (8, "ab")]
    got = edges.contained(spark.createDataFrame(pieces, "scope int, piece string"), spark.createDataFrame(paths, "scope int, path string"), grams)
    want = {(s, piece, path) for s, piece in pieces for z, path in paths if s is not None and s == z and piece is not None and path is not None and piece in path}
    assert rows(got, "scope", "piece", "path") == sorted(want, key=repr)


def test_contained_meets_few_that_do_not_contain(spark, monkeypatch):
    """Paths that share their folders: what is verified is a small multiple of what is found."""
    paths = [(0, f"src/main/python/company/service{i % 50}/module{i}.py") for i in range(3000)]
    pieces = [(0, f"company/service{i % 50}/module{i}") for i in range(0, 3000, 7)] + [(0, f"company/service{i}/none") for i in range(50)]
    pieces, paths = spark.createDataFrame(pieces, "scope int, piece string"), spark.createDataFrame(paths, "scope int, path string")
    found = edges.contained(pieces, paths).count()
    monkeypatch.setattr(edges.F, "contains", lambda path, piece: F.lit(True))
    assert found > 400 and edges.contained(pieces, paths).count() < 20 * found


def test_large_hubs_are_cut_into_blocks(spark, rows):
    """A name that 300 functions have and 200 call, in blocks of 7."""
    sites = [(f"c{i}", "run", "global", "", 300, "CALLS_GLOBAL", 4) for i in range(200)] + [("c1", "one", "global", "", 1, "CALLS_GLOBAL", 4)]
    members = [(f"f{i}", "global", "", "run") for i in range(299)] + [("c3", "global", "", "run"), ("f0", "global", "", "one"), ("f1", "local", "p", "run")]
    s = spark.createDataFrame(sites, "caller_id string, called_name string, scope string, owner string, n_targets long, type string, priority long")
    m = spark.createDataFrame(members, "function_id string, scope string, owner string, name string")
    want = [(c[0], "CALLS_GLOBAL", f[0], c[1]) for c in sites for f in members if f[1] == "global" and f[3] == c[1] and f[0] != c[0]]
    for block in (7, 4096):
        assert rows(edges.expand_calls(s, m, block), "src", "type", "dst", "called_name") == sorted(want, key=repr)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_growing_tables_are_not_broadcast(spark, scoped):
    """What the optimizer takes for small by its files must not go through the driver whole."""
    _, _, _, _, sites, f_df = scoped
    assert "BroadcastHashJoin" not in _plan(graph.callers_of(materialize(sites), f_df.limit(5), "p"))
    fs = functions(spark).limit(5)
    files = fs.select(F.col("file_path").alias("path")).distinct()
    membership = spark.createDataFrame([("b2", "K")], "function_id string, class_id string")
    imports = spark.createDataFrame([("c.py", "pkg.b", "load")], "file_path string, module string, item string")
    targets = spark.createDataFrame([("pkg.b", "load", "b1")], "module string, item string, id string")
    requests = spark.createDataFrame([(1, "c.py", "solo", "load")], "request_id int, caller_file string, caller_function string, function_name string")
    assert "BroadcastHashJoin" not in _plan(graph.go_to_definition(requests, fs, files, membership, imports, targets))


def test_memberships_are_not_broadcast(spark):
    import __spark_entry__ as entry

    assert "BroadcastHashJoin" not in _plan(entry.queries()["source_memberships"](spark, "/root/testdata/sf0.001"))


def test_a_function_listed_twice_has_its_sites_once(spark, rows):
    """Near calls of one listing rule out far ones of another; equal sites are one."""
    fs = spark.createDataFrame(
        [("a", "x", "one.py"), ("a", "x", "two.py"), ("a", "x", "one.py"), ("b", "y", "one.py"), ("c", "y", "three.py")],
        "id string, name string, file_path string")
    called_rows = spark.createDataFrame([("a", "y"), ("a", "y"), ("a", None)], "caller_id string, called_name string")
    membership = spark.createDataFrame([("a", "K"), ("c", "K"), ("a", None)], "function_id string, class_id string")
    imports = no_edges(spark, "file_path string, module string, item string")
    targets = no_edges(spark, "module string, item string, id string, node_type string")
    members = edges.call_members(fs, membership, imports, targets)
    got = rows(edges.call_sites(fs, called_rows, membership, imports, members), "caller_id", "scope", "owner", "n_targets")
    assert got == [("a", "local", "one.py", 1), ("a", "method", "K", 1)]


def test_sites_are_not_gathered_by_call(spark):
    """Sites of callers listed once are not shuffled again by caller and name."""
    fs = spark.createDataFrame([("a", "x", "one.py"), ("b", "y", "one.py"), ("c", "z", "two.py")], "id string, name string, file_path string")
    called_rows = spark.createDataFrame([("a", "y"), ("a", "z"), ("b", "y")], "caller_id string, called_name string")
    membership = spark.createDataFrame([("a", "K"), ("b", "K")], "function_id string, class_id string")
    imports = no_edges(spark, "file_path string, module string, item string")
    members = edges.call_members(fs, membership, imports, no_edges(spark, "module string, item string, id string, node_type string"))
    sites = edges.call_sites(fs, called_rows, membership, imports, members)
    assert "Aggregate" not in _plan(sites)
    assert sorted(tuple(r)[:5] for r in sites.collect()) == [
        ("a", "y", "local", "one.py", 1), ("a", "y", "method", "K", 1), ("a", "z", "global", "", 1)]


def test_edges_are_written_in_small_shares(spark, monkeypatch):
    """Queries of many short rows bound the compressed bytes of a task, and leave the session's setting as it was."""
    import __spark_entry__ as entry
    from codequarry import session

    seen, before = {}, spark.conf.get(session.ADVISORY)
    path = session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda s, label: seen.setdefault(label, path(s, label)))
    sizes, bounded = [], session.task_bytes
    monkeypatch.setattr(session, "task_bytes", lambda s, size: sizes.append(size) or bounded(s, size))
    for name, label in [("call_edges", "call-edges"), ("import_edges", "b_imports"), ("analysis_kinds", "b_imports"), ("edge_patterns", "patterns")]:
        seen.clear(), sizes.clear()
        entry.queries()[name](spark, "/root/testdata/sf0.001")
        assert label in seen and sizes and set(sizes) == {session.TASK_BYTES}
    assert spark.conf.get(session.ADVISORY) == before
    with pytest.raises(ValueError), session.task_bytes(spark, "1m"):
        assert spark.conf.get(session.ADVISORY) == "1m"
        raise ValueError
    assert spark.conf.get(session.ADVISORY) == before


def test_imported_members_meet_without_their_owners(spark, rows):
    functions = spark.createDataFrame([("f1", "src/a.py", "go"), ("f2", "src/b.py", "go")], "id string, file_path string, name string")
    imports = spark.createDataFrame(
        [("x.py", "a", "go"), ("x.py", "b", "go"), ("y.py", "a|b", "go"), ("z.py", "b", "go"), ("w.py", "b", "go"), ("v.py", None, "go")],
        "file_path string, module string, item string")
    # f1 is meant by two modules of one file, and by one whose name reads like them
    targets = spark.createDataFrame(
        [("a", "go", "f1", "function"), ("b", "go", "f1", "function"), ("b", "go", "f2", "function"), ("a|b", "go", "f1", "function"), ("a", "go", "k", "class")],
        "module string, item string, id string, node_type string")
    members = edges.call_members(functions, no_edges(spark, "function_id string, class_id string"), imports, targets)
    assert rows(members.where("scope = 'imported'"), "function_id", "owner", "name") == [
        ("f1", "a|b", "go"), ("f1", "b", "go"), ("f2", "a|b", "go"), ("f2", "b", "go")]
    plan = members._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [plan[i + 1] for i, line in enumerate(plan) if "Generate explode(modules" in line]
    assert below and not any("owner" in line for line in below)
