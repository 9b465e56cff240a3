"""Queries that resolve edges and ask the code graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import edges, extract, graph, search
from codequarry.plans import catalogue
from codequarry.plans.queries.extraction import CODE, _complexity_sql
from codequarry.plans.registry import Inputs, query
from codequarry.session import TASK_BYTES, materialize, scratch_path, shuffled

# ---------------------------------------------------------------- inputs


def _imports(t: Inputs):
    rows = t.once("b_imports")
    return rows.withColumn("import_id", F.concat_ws("|", "file_path", "module", "item"))


def _groups(t: Inputs):
    """Import groups, written out once for a query."""
    if "groups" not in t.written:
        t.written["groups"] = materialize(edges.import_groups(t.once("b_imports")), "groups", TASK_BYTES)
    return t.written["groups"]


def _members(t: Inputs, targets=None):
    """Hub members, written out: the call sites and their readers both use them."""
    imports = t.once("b_imports")
    targets = edges.import_targets(imports, t.b_functions) if targets is None else targets
    return materialize(edges.call_members(t.b_functions, t.b_membership, imports, targets, _groups(t)), "members", TASK_BYTES)


def _sites(t: Inputs, members=None):
    members = members if members is not None else _members(t)
    return edges.call_sites(t.b_functions, t.b_calls, t.b_membership, t.once("b_imports"), members, _groups(t))


def _inherits(t: Inputs):
    return edges.inherits(t.b_classes, t.b_classes.select(F.col("id").alias("class_id"), "base"))


# SQL twins build every single edge by plain joins.
CALL_EDGES = """
    f AS {b_functions}, c AS {b_calls}, m AS {b_membership}, i AS {b_imports},
    imported AS (SELECT DISTINCT i.file_path, i.item, f.id FROM i JOIN f ON f.name = i.item
                 AND (contains(f.file_path, replace(i.module, '.', '/')) OR ends_with(f.file_path, i.module || '.py'))),
    grp AS (SELECT file_path, item, string_agg(DISTINCT module, '|' ORDER BY module) AS owner FROM i GROUP BY file_path, item),
    near AS (
      SELECT c.caller_id, c.called_name, 'local' AS scope, a.file_path AS owner, b.id AS dst
      FROM c JOIN f a ON a.id = c.caller_id JOIN f b ON b.file_path = a.file_path AND b.name = c.called_name AND b.id <> a.id
      UNION ALL
      SELECT c.caller_id, c.called_name, 'imported', g.owner, x.id
      FROM c JOIN f a ON a.id = c.caller_id JOIN imported x ON x.file_path = a.file_path AND x.item = c.called_name
      JOIN grp g ON g.file_path = a.file_path AND g.item = c.called_name
      UNION ALL
      SELECT c.caller_id, c.called_name, 'method', ma.class_id, b.id
      FROM c JOIN m ma ON ma.function_id = c.caller_id JOIN m mb ON mb.class_id = ma.class_id
      JOIN f b ON b.id = mb.function_id AND b.name = c.called_name AND b.id <> c.caller_id),
    far AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.caller_id = c.caller_id AND n.called_name = c.called_name)),
    call_edges AS (
      SELECT * FROM near
      UNION ALL SELECT far.caller_id, far.called_name, 'global', '', b.id FROM far JOIN f b ON b.name = far.called_name AND b.id <> far.caller_id)
"""
TYPES = "CASE scope WHEN 'local' THEN 'CALLS_LOCAL' WHEN 'imported' THEN 'CALLS_IMPORTED' WHEN 'method' THEN 'CALLS_METHOD' ELSE 'CALLS_GLOBAL' END"
PRIORITIES = "CASE scope WHEN 'local' THEN 1 WHEN 'imported' THEN 2 WHEN 'method' THEN 3 ELSE 4 END"


def _resolve_sql(entities: str, refs: str, kind: str) -> str:
    """Two-step resolution by windows over the whole dimension."""
    return f"""
      e AS {entities}, r AS {refs},
      q AS (SELECT qualified_name AS k, arg_max(id, (file_path, line_start, id)) AS qid FROM e GROUP BY qualified_name),
      o AS (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY file_path, line_start, id) AS n FROM e),
      hit AS (SELECT r.src, r.ref, q.qid FROM r LEFT JOIN q ON q.k = replace(replace(r.file_path, '/', '.'), '.py', '') || '.' || r.ref AND q.qid <> r.src),
      named AS (SELECT h.src, h.ref, o.id, row_number() OVER (PARTITION BY h.src, h.ref ORDER BY o.n) AS n
                FROM hit h JOIN o ON o.name = h.ref AND o.id <> h.src AND o.n <= 2 WHERE h.qid IS NULL),
      res AS (SELECT src, ref, qid AS dst, 'qualified' AS how FROM hit WHERE qid IS NOT NULL
              UNION SELECT src, ref, id, 'name_based' FROM named WHERE n = 1)"""


# ---------------------------------------------------------------- edges


@query(
    "defined_in_edges",
    """SELECT f.id AS src, 'DEFINED_IN' AS type, f.file_path AS dst FROM {b_functions} f
       JOIN (SELECT DISTINCT file_path FROM {b_imports}) p ON p.file_path = f.file_path""",
)
def defined_in_edges(t: Inputs):
    return edges.defined_in(t.b_functions, t.b_imports.select(F.col("file_path").alias("path")).distinct())


@query(
    "defines_edges",
    """SELECT f.file_path AS src, 'DEFINES' AS type, f.id AS dst FROM {b_functions} f
       JOIN (SELECT DISTINCT file_path FROM {b_imports}) p ON p.file_path = f.file_path""",
)
def defines_edges(t: Inputs):
    return edges.defines(t.b_imports.select(F.col("file_path").alias("path")).distinct(), t.b_functions)


PARAMETERS = "string_split(docstring, ' ')"


@query(
    "parameter_edges",
    f"""SELECT id AS src, 'HAS_PARAMETER' AS type, id || '_param_' || (position - 1) AS dst, name, CAST(position - 1 AS BIGINT) AS position
        FROM (SELECT id, unnest({PARAMETERS}) AS name, generate_subscripts({PARAMETERS}, 1) AS position FROM {{b_functions}})""",
)
def parameter_edges(t: Inputs):
    return edges.has_parameter(t.b_functions.withColumn("parameters", F.split("docstring", " ")))


@query(
    "import_edges",
    """WITH i AS (SELECT file_path, module, file_path || '|' || module || '|' || item AS id FROM {b_imports}),
            p AS (SELECT DISTINCT file_path FROM {b_functions})
       SELECT i.file_path AS src, 'IMPORTS' AS type, id AS dst FROM i JOIN p ON p.file_path = i.file_path
       UNION ALL SELECT id, 'FROM_MODULE', module FROM i""",
)
def import_edges(t: Inputs):
    files = t.b_functions.select(F.col("file_path").alias("path")).distinct()
    return edges.import_edges(_imports(t).withColumnRenamed("import_id", "id"), files)


@query("modules", "SELECT DISTINCT module FROM {b_imports}")
def modules(t: Inputs):
    return edges.modules(t.b_imports)


@query(
    "call_edges",
    "WITH " + _resolve_sql(
        "{b_functions}",
        "(SELECT c.caller_id AS src, f.file_path, c.called_name AS ref FROM {b_calls} c JOIN {b_functions} f ON f.id = c.caller_id)", "CALLS",
    ) + " SELECT src, 'CALLS' AS type, dst, ref AS called_name, how AS resolution_type FROM res",
)
def call_edges(t: Inputs):
    return materialize(edges.calls(t.b_functions, t.b_calls), "call-edges", TASK_BYTES)


@query(
    "inheritance_edges",
    "WITH " + _resolve_sql("{b_typed_classes}", "(SELECT id AS src, file_path, base AS ref FROM {b_typed_classes})", "INHERITS")
    + " SELECT src, 'INHERITS' AS type, dst, how AS resolution_type FROM res",
)
def inheritance_edges(t: Inputs):
    classes = t.b_typed_classes
    return edges.inherits(classes, classes.select(F.col("id").alias("class_id"), "base"))


@query(
    "membership_edges",
    """SELECT src, 'BELONGS_TO' AS type, dst FROM (
         SELECT m.id AS src, r.id AS dst, row_number() OVER (PARTITION BY m.id ORDER BY r.hi - r.lo, r.id) AS n
         FROM {b_methods} m JOIN {b_ranges} r ON r.file_id = m.file_id AND m.line BETWEEN r.lo AND r.hi) WHERE n = 1""",
)
def membership_edges(t: Inputs):
    return edges.belongs_to(t.b_methods, t.b_ranges, ["id"])


@query(
    "import_targets",
    """SELECT DISTINCT i.module, i.item, f.id, f.node_type FROM (SELECT DISTINCT module, item FROM {b_imports}) i JOIN {b_functions} f
       ON f.name = i.item AND (contains(f.file_path, replace(i.module, '.', '/')) OR ends_with(f.file_path, i.module || '.py'))""",
)
def import_targets(t: Inputs):
    return edges.import_targets(t.b_imports, t.b_functions)


@query(
    "resolved_import_edges",
    """SELECT DISTINCT i.file_path || '|' || i.module || '|' || i.item AS src, 'RESOLVES_TO' AS type, f.id AS dst FROM {b_imports} i JOIN {b_functions} f
       ON f.name = i.item AND (contains(f.file_path, replace(i.module, '.', '/')) OR ends_with(f.file_path, i.module || '.py'))""",
)
def resolved_import_edges(t: Inputs):
    rows = _imports(t)
    return edges.resolves_from_import(rows, edges.import_targets(rows, t.b_functions))


@query(
    "module_targets",
    """SELECT DISTINCT i.module, f.id, f.node_type FROM (SELECT DISTINCT module FROM {b_module_imports}) i JOIN {b_mains} f
       ON contains(f.file_path, replace(i.module, '.', '/')) AND f.name = regexp_extract(f.file_path, '([^/.]*)[^/]*$', 1) AND ends_with(f.file_path, '.py')""",
)
def module_targets(t: Inputs):
    return edges.module_targets(t.b_module_imports, t.b_mains)


@query(
    "scoped_call_sites",
    f"""WITH {CALL_EDGES} SELECT caller_id, called_name, scope, owner, count(*) AS n_targets, {TYPES} AS type, CAST({PRIORITIES} AS BIGINT) AS priority
        FROM call_edges GROUP BY caller_id, called_name, scope, owner""",
)
def scoped_call_sites(t: Inputs):
    return _sites(t)


@query(
    "call_hub_members",
    """WITH f AS {b_functions}, i AS {b_imports}, grp AS (SELECT file_path, item, string_agg(DISTINCT module, '|' ORDER BY module) AS owner FROM i GROUP BY file_path, item)
       SELECT id AS function_id, 'local' AS scope, file_path AS owner, name FROM f
       UNION ALL SELECT id, 'global', '', name FROM f
       UNION ALL SELECT f.id, 'method', m.class_id, f.name FROM f JOIN {b_membership} m ON m.function_id = f.id
       UNION ALL SELECT DISTINCT f.id, 'imported', grp.owner, f.name FROM i JOIN grp ON grp.file_path = i.file_path AND grp.item = i.item
         JOIN f ON f.name = i.item AND (contains(f.file_path, replace(i.module, '.', '/')) OR ends_with(f.file_path, i.module || '.py'))""",
)
def call_hub_members(t: Inputs):
    return _members(t)


@query(
    "scoped_call_edges",
    f"""WITH {CALL_EDGES} SELECT caller_id AS src, {TYPES} AS type, dst, called_name, scope AS resolution_type, CAST({PRIORITIES} AS BIGINT) AS priority
        FROM call_edges""",
)
def scoped_call_edges(t: Inputs):
    members = _members(t)
    return edges.expand_calls(materialize(_sites(t, members), "sites"), members)


def _group_sql(view: str, key: str) -> str:
    return f"""SELECT a.id, a.node_type, CAST(a.{key} AS VARCHAR) AS "group", b.n - 1 AS partners FROM {view} a
               JOIN (SELECT {key}, count(*) AS n FROM {view} GROUP BY {key}) b ON b.{key} = a.{key} WHERE b.n > 1"""


@query("similar_purpose_links", _group_sql("{b_functions}", "purpose"))
def similar_purpose_links(t: Inputs):
    return edges.similar_purpose(t.b_functions)


ENTITIES_SQL = """(SELECT id, node_type, name, file_path, domain FROM {b_functions} UNION ALL
                   SELECT id, node_type, name, file_path, 'Brand#' || (id % 30) AS domain FROM {b_classes})"""


def _entities(t: Inputs):
    functions = t.b_functions.select("id", "node_type", "name", "file_path", "domain")
    return functions.union(t.b_classes.selectExpr("id", "node_type", "name", "file_path", "concat('Brand#', id % 30) AS domain"))


@query("same_domain_links", _group_sql(ENTITIES_SQL, "domain"))
def same_domain_links(t: Inputs):
    return edges.same_domain(_entities(t))


@query("same_module_links", _group_sql(ENTITIES_SQL, "file_path"))
def same_module_links(t: Inputs):
    return edges.same_module(_entities(t))


@query(
    "technology_edges",
    """SELECT DISTINCT n.id AS src, 'USES_TECHNOLOGY' AS type, n.tech AS dst FROM (SELECT id, unnest(string_split(name, ' ')) AS tech FROM {b_functions}) n
       JOIN (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS module FROM part) m ON m.module = n.tech""",
)
def technology_edges(t: Inputs):
    nodes = t.b_functions.withColumn("technologies", F.split("name", " "))
    return edges.uses_technology(nodes, t.part.select(F.explode(F.split("p_name", " ")).alias("module")))


REPOSITORY = "SELECT o_orderkey AS run, concat('https://github.com/acme/r', o_custkey % 100) AS url, o_orderpriority AS branch, o_orderkey % 1000 AS total_nodes FROM orders"


@query("repositories", f"SELECT url, arg_max(run, run) AS run, arg_max(branch, run) AS branch, arg_max(total_nodes, run) AS total_nodes FROM ({REPOSITORY}) GROUP BY url")
def repositories(t: Inputs):
    return edges.repository_rows(t.sql(REPOSITORY), ["run"])


@query(
    "load_statistics",
    """SELECT 'node' AS part, 'Function' AS kind, count(*) AS n, count(e.vec_id) AS embedded, CAST(0 AS BIGINT) AS errors
       FROM {b_functions} f LEFT JOIN embeddings e ON e.vec_id = f.id
       UNION ALL SELECT 'node', 'Class', count(*), 0, 0 FROM {b_classes}
       UNION ALL SELECT 'edge', 'DEFINED_IN', count(*), 0, 0 FROM {b_functions}
       UNION ALL SELECT 'edge', 'IMPORTS', count(*), 0, 0 FROM {b_imports}
       UNION ALL SELECT 'edge', 'FROM_MODULE', count(*), 0, 0 FROM {b_imports}""",
)
def load_statistics(t: Inputs):
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.lit(True).alias("__e"))
    functions = t.b_functions.select("id").join(vectors, "id", "left").select(F.lit("Function").alias("label"), "id", F.col("__e").isNotNull().alias("has_embedding"))
    classes = t.b_classes.select(F.lit("Class").alias("label"), "id", F.lit(False).alias("has_embedding"))
    files = t.b_functions.select(F.col("file_path").alias("path")).distinct()
    own_files = edges.defined_in(t.b_functions, files)
    imports = edges.import_edges(_imports(t).withColumnRenamed("import_id", "id"), files)
    every = own_files.select(F.col("src").cast("string"), "type", "dst").union(imports)
    return edges.load_stats(functions.union(classes), every)


# ---------------------------------------------------------------- graph questions


@query("complex_functions", "SELECT name, complexity, file_path, github_url, id FROM {b_functions} ORDER BY complexity DESC, id LIMIT 10")
def complex_functions(t: Inputs):
    return graph.complex_functions(t.b_functions)


@query(
    "callers_of_function",
    f"""WITH {CALL_EDGES} SELECT caller_id, f.name AS caller_name, f.file_path, f.github_url, {TYPES} AS type, count(*) AS n_targets
        FROM call_edges e JOIN f ON f.id = e.caller_id WHERE called_name = 'small ring' GROUP BY ALL""",
)
def callers_of_function(t: Inputs):
    return graph.callers_of(_sites(t), t.b_functions, "small ring")


@query(
    "discovered_functions",
    """SELECT id, name, file_path FROM {b_functions} f
       WHERE (lower(name) LIKE '%ring%' OR regexp_full_match(name, '.*[Ww]idget'))
         AND (file_path LIKE '%Brand#1%' OR content LIKE '%econ%' OR EXISTS (SELECT 1 FROM {b_calls} c WHERE c.caller_id = f.id AND c.called_name LIKE '%anvil%'))""",
)
def discovered_functions(t: Inputs):
    found = graph.discover(t.b_functions, t.b_calls, ["ring"], ".*[Ww]idget", ["Brand#1"], ["econ"], ["anvil"])
    return found.select("id", "name", "file_path")


@query(
    "definitions",
    """WITH f AS {b_functions}, m AS {b_membership}, i AS {b_imports},
       imported AS (SELECT DISTINCT i.file_path, i.item, f.id FROM i JOIN f ON f.name = i.item
                    AND (contains(f.file_path, replace(i.module, '.', '/')) OR ends_with(f.file_path, i.module || '.py'))),
       req AS (SELECT c.caller_id || ':' || c.called_name AS request_id, a.file_path AS caller_file, a.name AS caller_function, c.called_name
               FROM {b_calls} c JOIN f a ON a.id = c.caller_id),
       home AS (SELECT DISTINCT f.file_path, f.name, m.class_id FROM f JOIN m ON m.function_id = f.id),
       cand AS (
         SELECT request_id, 1 AS tier, b.id FROM req JOIN f b ON b.file_path = caller_file AND b.name = called_name
         UNION ALL SELECT request_id, 2, x.id FROM req JOIN imported x ON x.file_path = caller_file AND x.item = called_name
         UNION ALL SELECT request_id, 3, b.id FROM req JOIN home h ON h.file_path = caller_file AND h.name = caller_function
                   JOIN m ON m.class_id = h.class_id JOIN f b ON b.id = m.function_id AND b.name = called_name
         UNION ALL SELECT request_id, 4, b.id FROM req JOIN (SELECT name, arg_min(id, (file_path, line_start, id)) AS id FROM f GROUP BY name) b ON b.name = called_name),
       best AS (SELECT request_id, tier, cand.id, row_number() OVER (PARTITION BY request_id ORDER BY tier, file_path, line_start, cand.id) AS n FROM cand JOIN f ON f.id = cand.id)
       SELECT request_id, f.name AS function_name, f.file_path, f.line_start AS line_number, f.github_url AS github_link, f.docstring AS documentation,
              CASE tier WHEN 1 THEN 'local' WHEN 2 THEN 'imported' WHEN 3 THEN 'method' ELSE 'global' END AS resolution_type
       FROM best JOIN f ON f.id = best.id WHERE n = 1""",
)
def definitions(t: Inputs):
    functions = t.b_functions
    caller = functions.select(F.col("id").alias("caller_id"), F.col("file_path").alias("caller_file"), F.col("name").alias("caller_function"))
    requests = t.b_calls.join(shuffled(caller), "caller_id").select(
        F.concat_ws(":", "caller_id", "called_name").alias("request_id"), "caller_file", "caller_function", F.col("called_name").alias("function_name"))
    files = functions.select(F.col("file_path").alias("path")).distinct()
    imports = t.once("b_imports")
    return graph.go_to_definition(requests, functions, files, t.b_membership, imports, edges.import_targets(imports, functions))


@query(
    "usages",
    f"""WITH {CALL_EDGES}, k AS {{b_classes}},
        kid AS (SELECT a.id AS child, b.id FROM k a JOIN k b ON b.name = a.base AND b.id <> a.id),
        res AS (SELECT DISTINCT i.file_path, f.id FROM i JOIN f ON f.name = i.item
                AND (contains(f.file_path, replace(i.module, '.', '/')) OR ends_with(f.file_path, i.module || '.py'))),
        calls AS (SELECT f.name, a.file_path AS usage_file, a.line_start AS usage_line, 'function_call' AS usage_type, a.github_url AS github_link, f.id
                  FROM call_edges e JOIN f ON f.id = e.dst JOIN f a ON a.id = e.caller_id),
        kids AS (SELECT k.name, a.file_path AS usage_file, a.line_start AS usage_line, 'inheritance' AS usage_type, a.github_url AS github_link, k.id
                 FROM kid JOIN k ON k.id = kid.id JOIN k a ON a.id = kid.child),
        left_f AS (SELECT f.name, f.id FROM f WHERE f.id NOT IN (SELECT dst FROM call_edges)),
        left_c AS (SELECT k.name, k.id FROM k WHERE k.id NOT IN (SELECT id FROM kid)),
        imps AS (SELECT l.name, r.file_path AS usage_file, CASE WHEN r.id IS NOT NULL THEN 0 END AS usage_line,
                        CASE WHEN r.id IS NOT NULL THEN 'import' END AS usage_type, CASE WHEN r.id IS NOT NULL THEN '' END AS github_link
                 FROM left_f l LEFT JOIN res r ON r.id = l.id
                 UNION ALL SELECT name, NULL, NULL, NULL, NULL FROM left_c),
        u AS (SELECT name, usage_file, usage_line, usage_type, github_link FROM calls
              UNION SELECT name, usage_file, usage_line, usage_type, github_link FROM kids UNION SELECT * FROM imps)
        SELECT name, coalesce(usage_file, '-') AS usage_file, coalesce(usage_line, -1) AS usage_line, coalesce(usage_type, '-') AS usage_type,
               coalesce(github_link, '-') AS github_link FROM u""",
)
def usages(t: Inputs):
    functions, classes = t.b_functions, t.b_classes
    imports = _imports(t)
    targets = materialize(edges.import_targets(imports, functions), "targets")
    members = _members(t, targets)
    sites = materialize(_sites(t, members), "sites")
    resolved = imports.join(targets, ["module", "item"]).select(
        F.col("import_id").alias("src"), "node_type", F.col("id").alias("dst"))
    requests = functions.select("name").union(classes.select("name"))
    rows = imports.select(F.col("import_id").alias("id"), "file_path", F.lit(0).cast("bigint").alias("line_start"), F.lit("").alias("github_url"))
    found = graph.find_usages(requests, functions, classes, sites, members, _inherits(t), resolved, rows)
    return found.select(
        "name", F.coalesce("usage_file", F.lit("-")).alias("usage_file"), F.coalesce("usage_line", F.lit(-1)).alias("usage_line"),
        F.coalesce("usage_type", F.lit("-")).alias("usage_type"), F.coalesce("github_link", F.lit("-")).alias("github_link"))


@query(
    "class_hierarchy",
    """WITH RECURSIVE k AS {b_classes}, e AS (SELECT a.id AS child, b.id AS parent FROM k a JOIN k b ON b.name = a.base AND b.id <> a.id),
       walk AS (SELECT child, parent AS root, [child, parent] AS path FROM e JOIN k ON k.id = e.parent AND k.name = 'C1'
                UNION ALL SELECT e.child, w.root, [e.child] || w.path FROM walk w JOIN e ON e.parent = w.child)
       SELECT child, root, CAST(len(path) - 1 AS BIGINT) AS depth, array_to_string(path, '>') AS path FROM walk""",
)
def class_hierarchy(t: Inputs):
    found = graph.class_hierarchy(_inherits(t), t.b_classes, "C1")
    return found.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query("functions_by_domain", "SELECT id, name, purpose, domain FROM {b_functions} WHERE domain = 'Brand#3' AND purpose = 'ECONOMY'")
def functions_by_domain(t: Inputs):
    return graph.by_domain_purpose(t.b_functions, domain="Brand#3", purpose="ECONOMY").select("id", "name", "purpose", "domain")


@query(
    "multi_field_search",
    """SELECT id, name, domain FROM {b_functions} WHERE purpose LIKE '%ring%' OR domain LIKE '%ring%' OR name LIKE '%ring%' OR docstring LIKE '%ring%'
       ORDER BY name, id LIMIT 20""",
)
def multi_field_search(t: Inputs):
    return graph.multi_field_search(t.b_functions, "ring").select("id", "name", "domain")


@query(
    "code_metrics",
    """SELECT count(*) AS total_functions, round(avg(complexity), 2) AS avg_complexity, max(complexity) AS max_complexity,
              count(DISTINCT purpose) AS purposes, count(DISTINCT domain) AS domains,
              (SELECT count(*) FROM {b_classes}) AS total_classes, (SELECT count(DISTINCT file_path) FROM {b_functions}) AS total_files
       FROM {b_functions}""",
)
def code_metrics(t: Inputs):
    return graph.code_metrics(t.b_functions, t.b_classes, t.b_functions.select("file_path").distinct())


@query(
    "distinct_purposes",
    "SELECT DISTINCT 'purpose' AS field, purpose AS value FROM {b_functions} UNION ALL SELECT DISTINCT 'domain', domain FROM {b_functions}",
)
def distinct_purposes(t: Inputs):
    return graph.distinct_values(t.b_functions)


@query("resolved_call_statistics", f"WITH {CALL_EDGES} SELECT {TYPES} AS type, count(*) AS edges FROM call_edges GROUP BY scope")
def resolved_call_statistics(t: Inputs):
    return graph.call_stats(_sites(t))


@query("entity_lookup", f"SELECT id, node_type, file_path FROM {ENTITIES_SQL} WHERE name = 'C7' OR name = 'red widget'")
def entity_lookup(t: Inputs):
    entities = _entities(t)
    return graph.lookup_entity(entities, "C7").union(graph.lookup_entity(entities, "red widget")).select("id", "node_type", "file_path")


@query(
    "indexed_lookup",
    """SELECT 'code' AS part, id, name AS said FROM {b_functions} WHERE contains(name, 'anvil') OR contains(content, 'promo')
       UNION ALL SELECT 'field', id, name FROM {b_functions} WHERE contains(purpose, 'CONO') OR contains(domain, 'CONO') OR contains(name, 'CONO') OR contains(docstring, 'CONO')
       UNION ALL SELECT 'text', doc_id, source FROM documents WHERE contains(text, 'password') OR contains(text, 'AKIA')""",
)
def indexed_lookup(t: Inputs):
    """Contains-searches through posting lists: code, described fields, whole documents."""
    root, functions, docs = scratch_path(t.spark, "index"), t.spread_out("b_functions", "part"), t.documents
    search.write_index(functions, ["name", "content", "purpose", "domain", "docstring"], f"{root}/code")
    search.write_index(docs, ["text"], f"{root}/text", "doc_id")
    code, texts = search.read_index(t.spark, f"{root}/code", "bigint"), search.read_index(t.spark, f"{root}/text", "bigint")
    shown = lambda rows, part, id, said: rows.select(F.lit(part).alias("part"), F.col(id).cast("bigint").alias("id"), F.col(said).alias("said"))
    described = {f: ["CONO"] for f in graph.SEARCHED if f in functions.columns}
    found = [
        shown(graph.contains_lookup(functions, "anvil", "promo", code), "code", "id", "name"),
        shown(search.holding(functions, described, code), "field", "id", "name"),
        shown(search.holding(docs, {"text": ["password", "AKIA"]}, texts, "doc_id"), "text", "doc_id", "source"),
    ]
    return found[0].union(found[1]).union(found[2])


@query("contains_lookup", "SELECT id, name, substr(content, 1, 300) AS content FROM {b_functions} WHERE contains(name, 'anvil') OR contains(content, 'promo')")
def contains_lookup(t: Inputs):
    return graph.contains_lookup(t.b_functions, "anvil", "promo").select("id", "name", "content")


@query(
    "functions_with_parameters",
    f"SELECT id, name, file_path, array_to_string({PARAMETERS}, ',') AS parameters FROM {{b_functions}}",
)
def functions_with_parameters(t: Inputs):
    functions = t.b_functions.withColumn("parameters", F.split("docstring", " "))
    listed = graph.with_parameters(functions, edges.has_parameter(functions))
    return listed.withColumn("parameters", F.array_join("parameters", ","))


GRAPH_SQL = """
    f AS {b_functions}, k AS {b_classes}, i AS (SELECT *, file_path || '|' || module || '|' || item AS id FROM {b_imports}),
    nodes AS (SELECT 'f' || id AS id, 'Function' AS label FROM f UNION ALL SELECT 'k' || id, 'Class' FROM k
              UNION ALL SELECT 'p' || file_path, 'File' FROM (SELECT DISTINCT file_path FROM f)
              UNION ALL SELECT 'i' || id, 'Import' FROM i UNION ALL SELECT 'm' || module, 'Module' FROM (SELECT DISTINCT module FROM i)),
    links AS (SELECT 'f' || id AS src, 'DEFINED_IN' AS type, 'p' || file_path AS dst FROM f
              UNION ALL SELECT 'p' || i.file_path, 'IMPORTS', 'i' || i.id FROM i
              UNION ALL SELECT 'i' || id, 'FROM_MODULE', 'm' || module FROM i
              UNION ALL SELECT 'k' || a.id, 'INHERITS', 'k' || b.id FROM k a JOIN k b ON b.name = a.base AND b.id <> a.id)
"""


def _graph(t: Inputs):
    """Nodes and edges with keys that are unique across labels."""
    functions, classes = t.b_functions, t.b_classes
    imports = _imports(t).withColumnRenamed("import_id", "id")
    paths = functions.select(F.col("file_path").alias("path")).distinct()
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    node = lambda d, label, p, c: d.select(key(p, c).alias("id"), F.lit(label).alias("label"))
    nodes = (
        node(functions, "Function", "f", "id").union(node(classes, "Class", "k", "id")).union(node(paths, "File", "p", "path"))
        .union(node(imports, "Import", "i", "id")).union(node(edges.modules(imports), "Module", "m", "module"))
    )
    link = lambda d, p, q: d.select(key(p, "src").alias("src"), "type", key(q, "dst").alias("dst"))
    imported = edges.import_edges(imports, paths)
    links = (
        link(edges.defined_in(functions, paths), "f", "p").union(link(imported.where("type = 'IMPORTS'"), "p", "i"))
        .union(link(imported.where("type = 'FROM_MODULE'"), "i", "m")).union(link(_inherits(t), "k", "k"))
    )
    return nodes, links


def _patterns(t: Inputs):
    nodes, links = _graph(t)
    return materialize(graph.edge_patterns(links, nodes), "patterns", TASK_BYTES)


@query(
    "edge_patterns",
    f"""WITH {GRAPH_SQL} SELECT a.label AS from_label, type, b.label AS to_label, count(*) AS edges FROM links
        JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY ALL""",
)
def edge_patterns(t: Inputs):
    return _patterns(t).orderBy(F.desc("edges"), "from_label", "type", "to_label")


PROFILE_SQL = """
    SELECT 'Function' AS label, property, CASE WHEN property IN ('id', 'line_start') THEN 'bigint' WHEN property = 'complexity' THEN 'int' ELSE 'string' END AS types,
           present = total AS mandatory
    FROM (SELECT unnest(['id', 'name', 'complexity', 'purpose', 'docstring', 'line_start']) AS property,
                 unnest([count(id), count(name), count(complexity), count(purpose), count(docstring), count(line_start)]) AS present, count(*) AS total
          FROM {b_functions})
    UNION ALL
    SELECT 'Url', property, CASE WHEN property = 'page_id' THEN 'bigint' WHEN property = 'priority' THEN 'bigint' ELSE 'string' END, present = total
    FROM (SELECT unnest(['page_id', 'url', 'priority', 'relevance']) AS property, unnest([count(page_id), count(url), count(priority), count(relevance)]) AS present,
                 count(*) AS total FROM {b_urls}) WHERE present > 0"""


def _profiles(t: Inputs):
    return graph.node_profile({
        "Function": t.b_functions.select("id", "name", "complexity", "purpose", "docstring", "line_start"),
        "Url": t.b_urls.select("page_id", "url", "priority", "relevance"),
    })


@query("node_profile", PROFILE_SQL)
def node_profile(t: Inputs):
    return _profiles(t)


@query(
    "edge_profile",
    f"""WITH {CALL_EDGES}, x AS (SELECT {TYPES} AS type, called_name, scope AS resolution_type FROM call_edges)
        SELECT type, unnest(['called_name', 'resolution_type', 'priority']) AS property, unnest(['string', 'string', 'bigint']) AS types, true AS mandatory
        FROM (SELECT DISTINCT type FROM x)""",
)
def edge_profile(t: Inputs):
    # all edges of a site have its properties
    return graph.edge_profile(_sites(t).select("type", "called_name", F.col("scope").alias("resolution_type"), "priority"))


NODES_SQL = """(SELECT 'Function' AS label, id, name, file_path, qualified_name, content FROM {b_functions}
                UNION ALL SELECT 'Class', id, name, file_path, qualified_name, github_url FROM {b_classes})"""


def _named_nodes(t: Inputs):
    functions = t.b_functions.select(F.lit("Function").alias("label"), "id", "name", "file_path", "qualified_name", "content")
    return functions.union(t.b_classes.select(F.lit("Class").alias("label"), "id", "name", "file_path", "qualified_name", "github_url"))


@query("sample_entities", f"SELECT label, name, file_path, qualified_name, substr(content, 1, 200) AS content_preview, id FROM {NODES_SQL} ORDER BY name, label, id LIMIT 50")
def sample_entities(t: Inputs):
    return graph.sample_entities(_named_nodes(t))


@query(
    "path_vocabulary",
    f"""WITH s AS (SELECT file_path FROM {NODES_SQL} ORDER BY name, label, id LIMIT 30)
        SELECT word FROM (SELECT unnest(string_split(file_path, '/')) AS word FROM s UNION SELECT 'py' FROM s) GROUP BY word ORDER BY word LIMIT 20""",
)
def path_vocabulary(t: Inputs):
    return graph.path_vocabulary(graph.sample_entities(_named_nodes(t)))


@query(
    "schema_digest",
    f"""WITH {GRAPH_SQL}, prof AS ({PROFILE_SQL}),
        r AS (SELECT label, property, CASE WHEN property IN ('name', 'file_path', 'line_start', 'line_end', 'github_url', 'qualified_name', 'content', 'node_type') THEN 0 ELSE 1 END AS later FROM prof),
        n AS (SELECT *, row_number() OVER (PARTITION BY label, later ORDER BY property) AS rn FROM r),
        pat AS (SELECT a.label AS fl, type, b.label AS tl, count(*) AS c FROM links JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY ALL ORDER BY c DESC, fl, type, tl LIMIT 10),
        smp AS (SELECT * FROM {NODES_SQL} ORDER BY name, label, id LIMIT 5)
        SELECT 'nodes' AS section, '- **' || label || '**: ' || string_agg(property, ', ' ORDER BY later, property) AS line FROM n WHERE later = 0 OR rn <= 4 GROUP BY label
        UNION ALL SELECT 'patterns', '- (' || fl || ')-[:' || type || ']->(' || tl || ') [' || c || ']' FROM pat
        UNION ALL SELECT 'samples', '- **' || name || '** (' || label || ') in ' || file_path FROM smp""",
)
def schema_digest(t: Inputs):
    return graph.schema_digest(_profiles(t), _patterns(t), graph.sample_entities(_named_nodes(t)))


# ---------------------------------------------------------------- from source text to answers

SOURCE_CALLS = CODE + r""",
    called AS (SELECT DISTINCT idx, path, ln, name, c FROM (SELECT idx, path, ln, name, unnest(regexp_extract_all(body, '(\w+)\s*\(', 1)) AS c FROM funcs) WHERE c <> name),
    cls AS (SELECT idx, ln AS lo, stop AS hi FROM spans WHERE head LIKE 'class %'),
    home AS (SELECT f.idx, f.ln, f.name, c.lo AS class_ln FROM funcs f JOIN cls c ON c.idx = f.idx AND f.ln BETWEEN c.lo AND c.hi WHERE contains(f.params, 'self')),
    imp AS (SELECT idx, regexp_extract(content, 'from (n\d+) import', 1) AS module, regexp_extract(content, 'import (load_\d+),', 1) AS item FROM {b_source}),
    n_mod AS (SELECT m.module, f.name, count(*) AS n FROM (SELECT DISTINCT module FROM imp) m JOIN funcs f ON contains(f.path, m.module) GROUP BY ALL),
    n_all AS (SELECT name, count(*) AS n FROM funcs GROUP BY name),
    near AS (
      SELECT k.idx, k.ln, k.c, 'CALLS_LOCAL' AS type, count(*) AS n FROM called k JOIN funcs f ON f.idx = k.idx AND f.name = k.c GROUP BY k.idx, k.ln, k.c
      UNION ALL SELECT k.idx, k.ln, k.c, 'CALLS_IMPORTED', m.n FROM called k JOIN imp i ON i.idx = k.idx AND i.item = k.c JOIN n_mod m ON m.module = i.module AND m.name = k.c
      UNION ALL SELECT k.idx, k.ln, k.c, 'CALLS_METHOD', count(*) FROM called k JOIN home h ON h.idx = k.idx AND h.ln = k.ln JOIN home b ON b.idx = k.idx AND b.class_ln = h.class_ln AND b.name = k.c GROUP BY k.idx, k.ln, k.c),
    far AS (SELECT k.idx, k.ln, k.c, 'CALLS_GLOBAL' AS type, a.n FROM called k JOIN n_all a ON a.name = k.c
            WHERE NOT EXISTS (SELECT 1 FROM near x WHERE x.idx = k.idx AND x.ln = k.ln AND x.c = k.c))
"""


@query("source_call_statistics", f"WITH {SOURCE_CALLS} SELECT type, CAST(sum(n) AS BIGINT) AS edges FROM (SELECT * FROM near UNION ALL SELECT * FROM far) GROUP BY type")
def source_call_statistics(t: Inputs):
    g = catalogue.build_code_graph(t.b_source.select("path", "content"))
    return catalogue.run(g, "resolved_call_statistics")


@query(
    "source_code_metrics",
    f"""WITH {CODE} SELECT count(*) AS total_functions, round(avg({_complexity_sql('body')}), 2) AS avg_complexity, CAST(max({_complexity_sql('body')}) AS BIGINT) AS max_complexity,
        (SELECT count(*) FROM spans WHERE head LIKE 'class %') AS total_classes, (SELECT count(*) FROM {{b_source}}) AS total_files FROM funcs""",
)
def source_code_metrics(t: Inputs):
    files = t.b_source.select("path", "content")
    entities = extract.extract_functions(files).withColumn("purpose", F.lit(None).cast("string")).withColumn("domain", F.lit(None).cast("string"))
    # classes are counted by their heads, whose blocks are not looked for
    metrics = graph.code_metrics(entities, extract.extract_classes(files, columns=["id"]), files)
    return metrics.select("total_functions", "avg_complexity", F.col("max_complexity").cast("bigint"), "total_classes", "total_files")


@query(
    "source_memberships",
    f"""WITH {SOURCE_CALLS} SELECT idx, name, CAST(ln AS BIGINT) AS line_start, CAST(class_ln AS BIGINT) AS class_line FROM home""",
)
def source_memberships(t: Inputs):
    files = t.b_source.select("idx", "path", "content")
    # written out once each: the texts are not read again for every join
    functions = materialize(
        extract.extract_functions(files).where("is_method").select("idx", "id", "name", F.col("file_path").alias("file_id"), "line_start"), "functions")
    classes = materialize(
        extract.extract_classes(files).select("id", F.col("file_path").alias("file_id"), F.col("line_start").alias("lo"), F.col("line_end").alias("hi")), "classes")
    held = edges.belongs_to(functions.withColumnRenamed("line_start", "line"), classes, ["lo", "id"])
    named = functions.join(shuffled(held.select(F.col("src").alias("id"), F.col("dst").alias("class_id"))), "id")
    line = classes.select(F.col("id").alias("class_id"), F.col("lo").cast("bigint").alias("class_line"))
    return named.join(shuffled(line), "class_id").select("idx", "name", F.col("line_start").cast("bigint"), "class_line")
