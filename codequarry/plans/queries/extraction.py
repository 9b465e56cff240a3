"""Queries over files and the entities in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import paths, text
from codequarry.operators import extract
from codequarry.plans.registry import Inputs, query

# SQL texts shared by several twins below.
SPLIT_LINES = r"""
    SELECT idx, path, CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts)-1] ELSE parts END AS parts
    FROM (SELECT idx, path, regexp_split_to_array(content, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS parts FROM {b_files})
"""
LINES = f"""
    SELECT idx, path, unnest(parts) AS line, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line_no FROM ({SPLIT_LINES})
"""
NUMBERED = f"""
    SELECT idx, path,
           coalesce(string_agg(CASE WHEN line_no < 10000 THEN lpad(CAST(line_no AS VARCHAR), 4, ' ') ELSE CAST(line_no AS VARCHAR) END
                    || ': ' || line, chr(10) ORDER BY line_no), '') AS numbered
    FROM ({LINES}) GROUP BY idx, path
"""


def _complexity_sql(column: str) -> str:
    terms = []
    for keyword in text.DECISION_KEYWORDS:
        for lead in ("' '", "chr(10)"):
            part = f"({lead} || '{keyword} ')"
            terms.append(f"(length({column}) - length(replace({column}, {part}, ''))) // length({part})")
    return "(1 + " + " + ".join(terms) + ")"


W = r"[\p{L}\p{N}_]"


@query(
    "complex_texts",
    f"SELECT idx, path, CAST({_complexity_sql('content')} AS BIGINT) AS complexity FROM {{b_files}} "
    "ORDER BY complexity DESC, idx LIMIT 10",
)
def complex_texts(t: Inputs):
    scored = t.b_files.select("idx", "path", text.complexity(F.col("content")).cast("bigint").alias("complexity"))
    return scored.orderBy(F.desc("complexity"), "idx").limit(10)


@query("text_complexity", f"SELECT idx, CAST({_complexity_sql('content')} AS BIGINT) AS complexity FROM {{b_files}}")
def text_complexity(t: Inputs):
    return t.b_files.select("idx", text.complexity(F.col("content")).cast("bigint").alias("complexity"))


@query("line_explosion", f"SELECT idx, line_no, line FROM ({LINES})")
def line_explosion(t: Inputs):
    return extract.lines(t.b_files.select("idx", "content")).select("idx", F.col("line_no").cast("bigint"), "line")


@query("numbered_text", f"SELECT idx, md5(numbered) AS digest, CAST(length(numbered) AS BIGINT) AS chars FROM ({NUMBERED})")
def numbered_text(t: Inputs):
    numbered = text.number_lines(F.col("content"))
    return t.b_files.select("idx", F.md5(numbered).alias("digest"), F.length(numbered).cast("bigint").alias("chars"))


@query(
    "content_for_labelled_files",
    f"""SELECT n.idx, n.idx || ' # ' || n.path AS label, md5(n.numbered) AS digest FROM ({NUMBERED}) n
        WHERE n.idx IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def content_for_labelled_files(t: Inputs):
    wanted = t.labels.where("quality = 1").select(F.col("doc_id").alias("idx"))
    found = extract.content_for(t.b_files, wanted)
    return found.select("idx", "label", F.md5("numbered").alias("digest"))


@query(
    "called_names",
    rf"""WITH found AS (
           SELECT idx, unnest(names) AS name, generate_subscripts(names, 1) AS spot
           FROM (SELECT idx, regexp_extract_all(content, '({W}+)\s*\(', 1) AS names FROM {{b_source}})),
         firsts AS (SELECT idx, name, min(spot) AS spot FROM found WHERE name <> 'inner' GROUP BY idx, name),
         ranked AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY spot) AS r FROM firsts)
         SELECT s.idx, coalesce(string_agg(name, ',' ORDER BY spot), '') AS calls
         FROM {{b_source}} s LEFT JOIN ranked ON ranked.idx = s.idx GROUP BY s.idx""",
)
def called_names(t: Inputs):
    calls = text.called_names(F.col("content"), F.lit("inner"))
    return t.b_source.select("idx", F.array_join(calls, ",").alias("calls"))


# Code lines with indents, heads, and the extent of each block up to its last non-blank line.
CODE = r"""
    code AS (SELECT idx, path, line, ln, CASE WHEN trim(line) = '' THEN NULL ELSE length(line) - length(ltrim(line)) END AS ind
             FROM (SELECT idx, path, unnest(string_split(content, chr(10))) AS line,
                          generate_subscripts(string_split(content, chr(10)), 1) AS ln FROM {b_source})),
    heads AS (SELECT *, trim(line) AS head FROM code WHERE regexp_matches(trim(line), '^(async\s+)?def\s+\w+\s*\(.*\).*:|^class\s+\w+.*:')),
    ends AS (SELECT h.idx, h.ln, coalesce(min(n.ln), 1000000) AS stop FROM heads h
             LEFT JOIN code n ON n.idx = h.idx AND n.ln > h.ln AND n.ind <= h.ind GROUP BY h.idx, h.ln),
    lasts AS (SELECT e.idx, e.ln, max(c.ln) AS stop FROM ends e
              JOIN code c ON c.idx = e.idx AND c.ln >= e.ln AND c.ln < e.stop AND c.ind IS NOT NULL GROUP BY e.idx, e.ln),
    spans AS (SELECT h.idx, h.path, h.ln, h.ind, h.head, s.stop,
                     ltrim(string_agg(c.line, chr(10) ORDER BY c.ln)) AS body, arg_max(c.line, c.ln) AS last_line
              FROM heads h JOIN lasts s ON s.idx = h.idx AND s.ln = h.ln
              JOIN code c ON c.idx = h.idx AND c.ln >= h.ln AND c.ln <= s.stop
              GROUP BY h.idx, h.path, h.ln, h.ind, h.head, s.stop),
    funcs AS (SELECT *, regexp_extract(head, '^(async\s+)?def\s+(\w+)\s*\((.*?)\)', 2) AS name,
                     regexp_extract(head, '^(async\s+)?def\s+(\w+)\s*\((.*?)\)', 3) AS params FROM spans WHERE head NOT LIKE 'class %')
"""
PARAMETERS_SQL = r"""array_to_string(list_transform(list_filter(list_transform(string_split(params, ','),
    lambda p: trim(split_part(trim(p), ':', 1))), lambda p: p <> ''), lambda p: trim(split_part(p, '=', 1))), ',')"""


@query(
    "function_rows",
    f"""WITH {CODE}
        SELECT idx, substr(md5(path || ':' || name || ':' || ln), 1, 16) AS id, name, CAST(ln AS BIGINT) AS line_start,
               CAST(stop AS BIGINT) AS line_end, CAST(ind + 1 AS BIGINT) AS column_start,
               CAST(length(last_line) + 1 AS BIGINT) AS column_end, {PARAMETERS_SQL} AS parameters,
               starts_with(head, 'async') AS is_async, contains(params, 'self') AS is_method,
               CAST({_complexity_sql('body')} AS BIGINT) AS complexity, md5(body) AS content
        FROM funcs""",
)
def function_rows(t: Inputs):
    rows = extract.extract_functions(t.b_source)
    return rows.select(
        "idx", "id", "name", *[F.col(c).cast("bigint") for c in ("line_start", "line_end", "column_start", "column_end")],
        F.array_join("parameters", ",").alias("parameters"), "is_async", "is_method",
        F.col("complexity").cast("bigint"), F.md5("content").alias("content"),
    )


@query(
    "strict_function_rows",
    f"""WITH {CODE} SELECT idx, name, CAST(ln AS BIGINT) AS line_start FROM funcs
        WHERE regexp_matches(head, '^(async\\s+)?def\\s+(\\w+)\\s*\\((.*?)\\):')""",
)
def strict_function_rows(t: Inputs):
    rows = extract.extract_functions(t.b_source, annotated=False)
    return rows.select("idx", "name", F.col("line_start").cast("bigint"))


@query(
    "function_calls",
    rf"""WITH {CODE},
        found AS (SELECT idx, ln, name, unnest(names) AS called, generate_subscripts(names, 1) AS spot
                  FROM (SELECT idx, ln, name, regexp_extract_all(body, '(\w+)\s*\(', 1) AS names FROM funcs)),
        firsts AS (SELECT idx, ln, name, called, min(spot) AS spot FROM found WHERE called <> name GROUP BY idx, ln, name, called),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY idx, ln ORDER BY spot) AS r FROM firsts)
        SELECT idx, name, called, CAST(r - 1 AS BIGINT) AS position FROM ranked""",
)
def function_calls(t: Inputs):
    rows = extract.extract_functions(t.b_source)
    called = rows.select("idx", "name", F.posexplode("calls").alias("position", "called"))
    return called.withColumn("position", F.col("position").cast("bigint"))


@query(
    "docstrings",
    f"""WITH {CODE}
        SELECT idx, regexp_extract(head, '(def|class)\\s+(\\w+)', 2) AS name,
               CASE WHEN head LIKE 'class Order%' THEN regexp_extract(body, '"([^"]*)"', 1)
                    WHEN head LIKE 'async def price_%' THEN regexp_extract(body, '''''''(.*?)''''''', 1, 's') END AS docstring
        FROM spans""",
)
def docstrings(t: Inputs):
    both = [f(t.b_source).select("idx", "name", "docstring") for f in (extract.extract_functions, extract.extract_classes)]
    return both[0].union(both[1])


@query(
    "class_rows",
    rf"""WITH {CODE}
        SELECT c.idx, regexp_extract(c.head, '^class\s+(\w+)', 1) AS name, CAST(c.ln AS BIGINT) AS line_start,
               CAST(c.stop AS BIGINT) AS line_end,
               array_to_string(list_transform(string_split(regexp_extract(c.head, '\(([^)]*)\)', 1), ','), lambda b: trim(b)), ',') AS base_classes,
               string_agg(f.name, ',' ORDER BY f.ln) AS methods
        FROM spans c JOIN funcs f ON f.idx = c.idx AND f.ln > c.ln AND f.ln <= c.stop AND f.ind = c.ind + 4
        WHERE c.head LIKE 'class %' GROUP BY ALL""",
)
def class_rows(t: Inputs):
    rows = extract.extract_classes(t.b_source)
    return rows.select(
        "idx", "name", F.col("line_start").cast("bigint"), F.col("line_end").cast("bigint"),
        F.array_join("base_classes", ",").alias("base_classes"), F.array_join("methods", ",").alias("methods"),
    )


@query(
    "bare_names",
    rf"""WITH {CODE},
        f AS (SELECT idx, name, array_to_string(list_filter(list_transform(string_split(params, ','), lambda p: trim(p)),
                     lambda p: regexp_full_match(p, '\w+')), ',') AS names FROM funcs),
        c AS (SELECT idx, regexp_extract(head, '^class\s+(\w+)', 1) AS name,
                     array_to_string(list_filter(list_transform(string_split(regexp_extract(head, '\(([^)]*)\)', 1), ','), lambda b: trim(b)),
                     lambda p: regexp_full_match(p, '\w+')), ',') AS names FROM spans WHERE head LIKE 'class %')
        SELECT * FROM f UNION ALL SELECT * FROM c""",
)
def bare_names(t: Inputs):
    heads = extract.block_extents(t.b_source.select("path", "content", "idx").withColumn("path", F.col("idx").cast("string")))
    function = F.regexp_extract("head", extract.FUNCTION_HEAD, 2)
    is_class = F.startswith("head", F.lit("class "))
    params = extract.parameter_names(F.regexp_extract("head", extract.FUNCTION_HEAD, 3), bare_only=True)
    bases = extract.base_names(F.regexp_extract("head", extract.CLASS_HEAD, 2), bare_only=True)
    return heads.select(
        F.col("path").cast("bigint").alias("idx"),
        F.when(is_class, F.regexp_extract("head", extract.CLASS_HEAD, 1)).otherwise(function).alias("name"),
        F.array_join(F.when(is_class, bases).otherwise(params), ",").alias("names"),
    )


@query(
    "import_rows",
    rf"""WITH {CODE},
        imps AS (SELECT *, trim(line) AS stmt FROM code WHERE regexp_matches(trim(line), '^(from|import) ')),
        parsed AS (SELECT *, CASE WHEN stmt LIKE 'from %' THEN regexp_extract(stmt, '^from\s+([\w.]+)\s+import\s+(.+)', 2)
                                  ELSE substr(stmt, 8) END AS listed FROM imps)
        SELECT idx, substr(md5(path || ':import_' || ln || ':' || ln), 1, 16) AS id, CAST(ln AS BIGINT) AS line_start,
               CASE WHEN stmt LIKE 'from %' THEN regexp_extract(stmt, '^from\s+([\w.]+)\s', 1) ELSE trim(split_part(listed, ',', 1)) END AS module,
               array_to_string(list_transform(string_split(listed, ','), lambda b: trim(b)), ',') AS imports,
               CASE WHEN stmt LIKE 'from %' THEN 'from_import' ELSE 'import' END AS import_type
        FROM parsed""",
)
def import_rows(t: Inputs):
    rows = extract.extract_imports(t.b_source)
    return rows.select(
        "idx", "id", F.col("line_start").cast("bigint"), "module", F.array_join("imports", ",").alias("imports"), "import_type"
    )


@query(
    "block_extents",
    f"""WITH {CODE} SELECT path, head, CAST(ln AS BIGINT) AS line_start, CAST(stop AS BIGINT) AS line_end,
        CAST(ind + 1 AS BIGINT) AS column_start, CAST(length(last_line) + 1 AS BIGINT) AS column_end FROM spans""",
)
def block_extents(t: Inputs):
    found = extract.block_extents(t.b_source)
    numbers = [F.col(c).cast("bigint") for c in ("line_start", "line_end", "column_start", "column_end")]
    return found.select("path", "head", *numbers)


@query(
    "entity_names",
    r"""SELECT id, substr(md5(file_path || ':' || name || ':' || line_start), 1, 16) AS entity_id,
               replace(replace(replace(file_path, '/', '.'), '\', '.'), '.py', '') || '.' || name AS dotted
        FROM {b_functions}""",
)
def entity_names(t: Inputs):
    path, name = F.col("file_path"), F.col("name")
    return t.b_functions.select(
        "id", paths.entity_id(path, name, F.col("line_start")).alias("entity_id"), paths.qualified_name(path, name).alias("dotted")
    )


@query(
    "source_links",
    """SELECT idx, CASE WHEN repo_id = 'O' THEN 'https://github.com/acme/shop' || '/blob/main/' || path || '#L1C1-L' || (1 + size % 9) || 'C7'
                        ELSE '' END AS link
       FROM (SELECT idx, repo_id, path, idx AS size FROM {b_source})""",
)
def source_links(t: Inputs):
    repo = F.when(F.col("repo_id") == "O", "https://github.com/acme/shop.git").when(F.col("repo_id") == "F", "git@github.com:acme/shop")
    last = 1 + F.col("idx") % 9
    link = paths.source_url(repo, F.lit("main"), F.col("path"), F.lit(1), last, F.lit(1), F.lit(7))
    return t.b_source.select("idx", link.alias("link"))


@query(
    "file_dimension",
    r"""WITH f AS (SELECT file_path, arg_min(github_url, id) AS url FROM {b_functions} GROUP BY file_path)
       SELECT file_path AS path, regexp_extract(file_path, '[^/]*$') AS name, 'py' AS extension,
              regexp_replace(file_path, '/[^/]*$', '') AS directory, regexp_extract(url, '^(.*)/blob/', 1) || '.git' AS repo_url,
              regexp_extract(url, '^(.*)/blob/', 1) || '/blob/' || regexp_extract(url, '/blob/([^/]+)', 1) || '/' || file_path AS github_url
       FROM f""",
)
def file_dimension(t: Inputs):
    repo = F.concat(F.regexp_extract("github_url", "^(.*)/blob/", 1), F.lit(".git"))
    return extract.file_dim(t.b_functions.withColumn("repo_url", repo), ["id"])


@query(
    "extraction_statistics",
    f"""WITH {CODE}, kinds AS (
          SELECT path, CASE WHEN head LIKE 'class %' THEN 'class' ELSE 'function' END AS kind FROM spans
          UNION ALL SELECT path, 'import' FROM code WHERE regexp_matches(trim(line), '^(from|import) '))
        SELECT count(DISTINCT path) AS files, count(*) AS nodes, count(*) FILTER (kind = 'function') AS functions,
               count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'import') AS imports, CAST(0 AS BIGINT) AS errors
        FROM kinds""",
)
def extraction_statistics(t: Inputs):
    cols = ["file_path", "node_type", "name"]
    parts = [f(t.b_source, columns=cols) for f in (extract.extract_functions, extract.extract_classes)]
    return extract.extraction_stats(parts[0].union(parts[1]).union(extract.extract_imports(t.b_source).select(*cols)))


EMBED_SQL = """
    SELECT id, concat_ws(' | ', node_type || ' ' || name, 'purpose: ' || purpose, 'domain: ' || domain, docstring,
                         content, 'file: ' || regexp_extract(file_path, '[^/]*/[^/]*$')) AS text
    FROM {b_functions}"""


@query("embedding_texts", EMBED_SQL)
def embedding_texts(t: Inputs):
    nodes = t.b_functions
    return nodes.select("id", extract.embedding_text(nodes).alias("text"))


@query("embedding_batches", f"SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 100 AS BIGINT) AS batch, text FROM ({EMBED_SQL})")
def embedding_batches(t: Inputs):
    nodes = t.spread_out("b_functions", "part")
    return extract.assign_batches(nodes.select("id", extract.embedding_text(nodes).alias("text")), ["id"]).select("id", "batch", "text")


# Long texts as several requests: documents in parts of at most 1,000 characters.
PARTS_SQL = r"""(SELECT doc_id, part, text, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY part) - length(text) AS start FROM (
    SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS part FROM (
      SELECT doc_id, regexp_extract_all(text, '(?s).{1,1000}\z|.{0,999}\n|.{1,1000}') AS ps FROM documents)))"""


@query(
    "embedding_requests",
    f"""SELECT doc_id, CAST(part AS BIGINT) AS part, CAST(start AS BIGINT) AS start, md5(text) AS text,
               CAST((row_number() OVER (ORDER BY doc_id, part) - 1) // 100 AS BIGINT) AS batch FROM {PARTS_SQL}""",
)
def embedding_requests(t: Inputs):
    found = extract.assign_batches(t.documents.select("doc_id", "text"), ["doc_id"], most=1000)
    return found.select("doc_id", "part", "start", F.md5("text").alias("text"), "batch")


@query(
    "vectors_of_parts",
    """WITH p AS (SELECT vec_id // 3 AS id, 1 + vec_id % 5 AS size, embedding FROM embeddings),
       c AS (SELECT id, size, unnest(embedding) AS c, generate_subscripts(embedding, 1) AS k FROM p)
       SELECT id, CAST(k - 1 AS BIGINT) AS k, round(sum(size * CAST(c AS DOUBLE)) / sum(size), 6) + 0.0 AS c FROM c GROUP BY id, k""",
)
def vectors_of_parts(t: Inputs):
    parts = t.embeddings.select(F.floor(F.col("vec_id") / 3).alias("id"), (1 + F.col("vec_id") % 5).alias("size"), "embedding")
    joined = extract.join_parts(parts, ["id"], "size").select("id", F.posexplode("embedding").alias("k", "c"))
    return joined.select("id", F.col("k").cast("bigint"), (F.round("c", 6) + 0.0).alias("c"))


@query(
    "embedding_coverage",
    """SELECT count(*) AS nodes, count(e.embedding) AS embedded FROM {b_functions} f LEFT JOIN embeddings e ON e.vec_id = f.id""",
)
def embedding_coverage(t: Inputs):
    joined = t.b_functions.join(t.embeddings, F.col("id") == F.col("vec_id"), "left")
    return extract.embedding_coverage(joined)
