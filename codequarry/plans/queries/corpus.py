"""Queries that validate concept graphs and lay out chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.functions.ranking import positions
from codequarry.operators import planning
from codequarry.plans.queries.extraction import NUMBERED
from codequarry.plans.registry import Inputs, query


@query(
    "corpus_sections",
    f"""WITH s AS (SELECT f.repo_id, f.idx, f.path, '--- File Index ' || f.idx || ': ' || f.path || ' ---' || chr(10) || n.numbered || chr(10) || chr(10) AS section
                   FROM {{b_files}} f JOIN ({NUMBERED}) n ON n.idx = f.idx)
        SELECT repo_id, idx, md5(section) AS digest, CAST(greatest(1, length(section) // 6) AS BIGINT) AS tokens,
               CASE WHEN greatest(1, length(section) // 6) <= 500 THEN 'ok' ELSE 'over budget' END AS verdict FROM s""",
)
def corpus_sections(t: Inputs):
    ok, over = planning.corpus_context(t.b_files, budget=500)
    shown = lambda d, v: d.select("repo_id", "idx", F.md5("section").alias("digest"), F.col("tokens").cast("bigint"), F.lit(v).alias("verdict"))
    return shown(ok, "ok").union(shown(over, "over budget"))


@query("file_listing", "SELECT repo_id, idx, '- ' || idx || ' # ' || path AS line FROM {b_files}")
def file_listing(t: Inputs):
    return planning.file_listing(t.b_files)


ENTRY = """CASE o_orderpriority WHEN '1-URGENT' THEN concat(o_custkey, ' # path') WHEN '2-HIGH' THEN concat(' ', o_custkey) WHEN '3-MEDIUM' THEN concat('x', o_custkey)
           WHEN '5-LOW' THEN concat('-', o_custkey, '#') ELSE concat('', o_custkey) END"""


@query(
    "parsed_indices",
    f"""WITH e AS (SELECT o_orderkey AS id, {ENTRY} AS entry FROM orders), p AS (SELECT *, TRY_CAST(trim(split_part(entry, '#', 1)) AS BIGINT) AS i FROM e)
        SELECT id, coalesce(i, -1) AS "index", CASE WHEN i IS NULL THEN 'not an index' WHEN i < 0 OR i >= 100 THEN 'out of range' ELSE 'ok' END AS reason FROM p""",
)
def parsed_indices(t: Inputs):
    entries = t.orders.select(F.col("o_orderkey").alias("id"), F.expr(ENTRY).alias("entry"))
    ok, rejects = planning.parse_index(entries, "entry", F.lit(100))
    shown = lambda d, r: d.select("id", F.coalesce("index", F.lit(-1)).alias("index"), r.alias("reason"))
    return shown(ok, F.lit("ok")).union(shown(rejects, F.col("reason")))


@query(
    "validated_concepts",
    """WITH c AS (SELECT idx, CASE WHEN description = 'Status P' THEN NULL ELSE name END AS name, [CAST((idx * 7) % 60 AS VARCHAR) || ' # a', CAST(idx % 55 AS VARCHAR), CAST((idx * 7) % 60 AS VARCHAR)] AS entries FROM {b_concepts}),
       p AS (SELECT idx, name, list_transform(entries, lambda e: CAST(trim(split_part(e, '#', 1)) AS BIGINT)) AS ids FROM c)
       SELECT idx, CASE WHEN name IS NULL THEN 'missing keys' WHEN list_max(ids) >= 55 THEN 'invalid file index' ELSE 'ok' END AS verdict,
              CASE WHEN name IS NOT NULL AND list_max(ids) < 55 THEN array_to_string(list_sort(list_distinct(ids)), ',') ELSE '' END AS files FROM p""",
)
def validated_concepts(t: Inputs):
    head = ((F.col("idx") * 7) % 60).cast("string")
    concepts = t.b_concepts.select(
        "idx", F.when(F.col("description") != "Status P", F.col("name")).alias("name"), "description",
        F.array(F.concat(head, F.lit(" # a")), (F.col("idx") % 55).cast("string"), head).alias("file_indices"))
    ok, rejects = planning.validate_concepts(concepts, F.lit(55))
    good = ok.select("idx", F.lit("ok").alias("verdict"), F.array_join(F.col("files").cast("array<string>"), ",").alias("files"))
    return good.union(rejects.select("idx", F.col("reason"), F.lit("").alias("files")))


# An order relates to the next order number, which only sometimes is of the same customer; low priority ones to themselves.
RELATIONS = """SELECT project_id, idx AS rel_no, CAST(idx AS VARCHAR(20)) AS "from",
                      concat(CASE WHEN name LIKE '5-LOW%' THEN idx WHEN name LIKE '2-HIGH%' THEN idx + 1 ELSE idx + project_id END, ' # x') AS "to",
                      CASE WHEN name LIKE '4-%' THEN NULL ELSE concat('calls "', name, '"', chr(10), 'with ', description) END AS label
               FROM {b_concepts}"""
RELATIONS_SQL = f"""r AS ({RELATIONS}), k AS {{b_concepts}},
    p AS (SELECT *, CAST(trim(split_part("from", '#', 1)) AS BIGINT) AS src, CAST(trim(split_part("to", '#', 1)) AS BIGINT) AS dst FROM r),
    v AS (SELECT p.*, CASE WHEN label IS NULL THEN 'missing keys' WHEN a.idx IS NULL OR b.idx IS NULL THEN 'invalid index' ELSE 'ok' END AS verdict
          FROM p LEFT JOIN k a ON a.project_id = p.project_id AND a.idx = p.src LEFT JOIN k b ON b.project_id = p.project_id AND b.idx = p.dst)"""


def _relations(t: Inputs):
    b = t.b_concepts
    name = F.col("name")
    target = F.when(F.startswith(name, F.lit("5-LOW")), F.col("idx")).when(F.startswith(name, F.lit("2-HIGH")), F.col("idx") + 1).otherwise(F.col("idx") + F.col("project_id"))
    label = F.concat(F.lit('calls "'), name, F.lit('"\nwith '), "description")
    return b.select(
        "project_id", F.col("idx").alias("rel_no"), F.col("idx").cast("string").alias("from"), F.concat(target.cast("string"), F.lit(" # x")).alias("to"),
        F.when(~F.startswith(name, F.lit("4-")), label).alias("label"))


@query("validated_relations", f"WITH {RELATIONS_SQL} SELECT project_id, src, dst, verdict FROM v")
def validated_relations(t: Inputs):
    ok, rejects = planning.validate_relations(_relations(t), t.b_concepts)
    good = ok.select("project_id", "src", "dst", F.lit("ok").alias("verdict"))
    return good.union(rejects.select("project_id", "src", "dst", "reason"))


@query(
    "uncovered_concepts",
    f"""WITH {RELATIONS_SQL} SELECT project_id, idx FROM k WHERE NOT EXISTS (SELECT 1 FROM v WHERE verdict = 'ok' AND v.project_id = k.project_id AND (v.src = k.idx OR v.dst = k.idx))""",
)
def uncovered_concepts(t: Inputs):
    ok, _ = planning.validate_relations(_relations(t), t.b_concepts)
    return planning.uncovered_concepts(t.b_concepts, ok).select("project_id", "idx")


ORDER_ROWS = """SELECT project_id, CASE WHEN description = 'Status P' THEN -1 - idx ELSE idx END AS idx FROM {b_concepts}
                UNION ALL SELECT project_id, idx FROM {b_concepts} WHERE name LIKE '5-LOW%'"""


@query(
    "order_violations",
    f"""WITH o AS ({ORDER_ROWS}), k AS {{b_concepts}}
        SELECT project_id, idx, 'repeated' AS violation FROM o GROUP BY project_id, idx HAVING count(*) > 1
        UNION ALL SELECT DISTINCT o.project_id, o.idx, 'unknown' FROM o WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.project_id = o.project_id AND k.idx = o.idx)
        UNION ALL SELECT k.project_id, k.idx, 'missing' FROM k WHERE NOT EXISTS (SELECT 1 FROM o WHERE k.project_id = o.project_id AND k.idx = o.idx)""",
)
def order_violations(t: Inputs):
    return planning.validate_order(t.sql(ORDER_ROWS), t.b_concepts)


SLUG = r"lower(regexp_replace(name, '[^\p{L}\p{N}]', '_', 'g'))"
PLAN_SQL = f"""o AS (SELECT o_custkey AS project_id, o_orderkey AS idx, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders),
    f AS (SELECT o.project_id, o.pos, o.idx, k.name, (CASE WHEN pos < 10 THEN '0' || pos ELSE '' || pos END) || '_' || {SLUG} || '.md' AS filename
          FROM o JOIN {{b_concepts}} k ON k.project_id = o.project_id AND k.idx = o.idx),
    plan AS (SELECT *, pos || '. [' || name || '](' || filename || ')' AS listing, lag(filename) OVER w AS previous, lead(filename) OVER w AS next FROM f
             WINDOW w AS (PARTITION BY project_id ORDER BY pos))"""


def _plan(t: Inputs):
    dated = t.orders.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("idx"), "o_orderdate")
    return planning.chapter_plan(positions(dated, ["project_id"], ["o_orderdate", "idx"], "pos").drop("o_orderdate"), t.b_concepts)


@query("chapter_plan", f"WITH {PLAN_SQL} SELECT project_id, pos, idx, filename, listing, coalesce(previous, '-') AS previous, coalesce(next, '-') AS next FROM plan")
def chapter_plan(t: Inputs):
    none = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return _plan(t).select("project_id", "pos", "idx", "filename", "listing", none("previous"), none("next"))


DIAGRAM_SQL = f"""{RELATIONS_SQL}, lab AS (SELECT *, replace(replace(label, '"', ''), chr(10), ' ') AS l FROM v WHERE verdict = 'ok'),
    diagram AS (SELECT project_id, 0 AS part, idx AS place, '    A' || idx || '["' || replace(name, '"', '') || '"]' AS line FROM k
                UNION ALL SELECT project_id, 1, src, '    A' || src || ' -- "' || CASE WHEN length(l) > 30 THEN substr(l, 1, 27) || '...' ELSE l END || '" --> A' || dst FROM lab)"""


def _diagram(t: Inputs):
    ok, _ = planning.validate_relations(_relations(t), t.b_concepts)
    return planning.diagram_lines(t.b_concepts, ok.withColumn("rel_no", F.col("src")))


@query("diagram_lines", f"WITH {DIAGRAM_SQL} SELECT project_id, CAST(part AS BIGINT) AS part, place, line FROM diagram")
def diagram_lines(t: Inputs):
    return _diagram(t).withColumn("part", F.col("part").cast("bigint"))


@query(
    "index_pages",
    f"""WITH {DIAGRAM_SQL}, {PLAN_SQL},
        pr AS (SELECT c_custkey AS project_id, c_name AS name, c_mktsegment AS summary, 'https://git.example/' || c_custkey AS url FROM customer)
        SELECT project_id, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS place, '# Tutorial: ' || name AS line FROM pr
        UNION ALL SELECT project_id, 0, 2, summary FROM pr
        UNION ALL SELECT project_id, 0, 4, '**Source Repository:** [' || url || '](' || url || ')' FROM pr
        UNION ALL SELECT project_id, 0, 6, '```mermaid' FROM pr
        UNION ALL SELECT project_id, 0, 7, 'flowchart TD' FROM pr
        UNION ALL SELECT project_id, 0, unnest([1, 3, 5]), '' FROM pr
        UNION ALL SELECT project_id, 3, 0, '```' FROM pr
        UNION ALL SELECT project_id, 3, 2, '## Chapters' FROM pr
        UNION ALL SELECT project_id, 3, unnest([1, 3]), '' FROM pr
        UNION ALL SELECT project_id, part + 1, place, line FROM diagram
        UNION ALL SELECT project_id, 4, pos, listing FROM plan WHERE pos <= 5 OR idx IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def index_pages(t: Inputs):
    projects = t.customer.selectExpr("c_custkey AS project_id", "c_name AS name", "c_mktsegment AS summary", "concat('https://git.example/', c_custkey) AS repo_url")
    plan = _plan(t)
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("idx")).distinct().withColumn("returned", F.lit(True))
    written = plan.join(returned, "idx", "left").where(F.col("returned") | (F.col("pos") <= 5))
    lines = planning.index_lines(projects, plan, _diagram(t), written)
    return lines.withColumn("part", F.col("part").cast("bigint"))


@query(
    "token_estimates",
    """SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 6) END AS BIGINT) AS tokens,
              CASE WHEN length(text) // 6 <= 1000 THEN 'ok' ELSE 'over budget' END AS verdict FROM documents""",
)
def token_estimates(t: Inputs):
    ok, over = planning.estimate_tokens(t.documents.select("doc_id", "text"), "text", 1000)
    shown = lambda d, v: d.select("doc_id", F.col("tokens").cast("bigint"), F.lit(v).alias("verdict"))
    return shown(ok, "ok").union(shown(over, "over budget"))


PROMPTS = "SELECT call_id, stage AS provider, concat(prompt, ' ', host) AS prompt FROM {b_model_calls}"
CACHE = "SELECT DISTINCT concat(stage, ':', prompt, ' ', host) AS key, concat('answer to ', prompt) AS response FROM {b_model_calls} WHERE duration > 100"


@query(
    "cache_hits",
    f"""WITH p AS ({PROMPTS}), c AS ({CACHE}) SELECT CAST(call_id AS BIGINT) AS call_id, 'hit' AS verdict, response FROM p JOIN c ON c.key = provider || ':' || prompt
        UNION ALL SELECT count(*), 'todo', provider || ':' || prompt FROM p WHERE provider || ':' || prompt NOT IN (SELECT key FROM c) GROUP BY provider, prompt HAVING count(*) > 0""",
)
def cache_hits(t: Inputs):
    prompts = t.sql(PROMPTS)
    hits, todo = planning.cache_split(prompts, t.sql(CACHE))
    asked = prompts.groupBy("provider", "prompt").agg(F.count(F.lit(1)).alias("call_id"))
    counted = todo.drop("call_id").join(asked, ["provider", "prompt"])
    return hits.select("call_id", F.lit("hit").alias("verdict"), "response").union(
        counted.select("call_id", F.lit("todo").alias("verdict"), planning.cache_key(F.col("provider"), F.col("prompt"))))


@query(
    "cache_after_insert",
    f"""WITH c AS ({CACHE}) SELECT key, response FROM c WHERE key NOT LIKE 'click:%'
        UNION ALL SELECT DISTINCT stage || ':' || prompt || ' ' || host, 'new' FROM {{b_model_calls}} WHERE stage = 'click'""",
)
def cache_after_insert(t: Inputs):
    answers = t.sql("SELECT DISTINCT stage AS provider, concat(prompt, ' ', host) AS prompt, 'new' AS response FROM {b_model_calls} WHERE stage = 'click'")
    return planning.cache_insert(t.sql(CACHE), answers)


CHAPTERS = """SELECT conv_id, turn, concat('Topic ', conv_id) AS name,
                     CASE role WHEN 'user' THEN concat(chr(10), '# Wrong heading', chr(10), text) WHEN 'assistant' THEN text ELSE concat('# Chapter ', turn, ': x', chr(10), text) END AS content FROM conversations"""


@query(
    "repaired_headings",
    f"""WITH c AS ({CHAPTERS}), b AS (SELECT *, regexp_replace(content, '^{text.SPACE}+|{text.SPACE}+$', '', 'g') AS body FROM c)
        SELECT conv_id, turn, CASE WHEN starts_with(body, '# Chapter ' || turn) THEN content
          WHEN starts_with(body, '#') THEN '# Chapter ' || turn || ': ' || name || coalesce(substr(body, nullif(strpos(body, chr(10)), 0)), '')
          ELSE '# Chapter ' || turn || ': ' || name || chr(10) || chr(10) || content END AS content FROM b""",
)
def repaired_headings(t: Inputs):
    return t.sql(CHAPTERS).select("conv_id", "turn", planning.repair_heading(F.col("turn"), F.col("name"), F.col("content")).alias("content"))


@query(
    "project_labels",
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'shop-' || o_custkey || '.gitter' WHEN o_orderstatus = 'F' THEN 'digit' ELSE 'folder' || o_custkey END AS label FROM orders""",
)
def project_labels(t: Inputs):
    url = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("https://git.example/a/shop-"), "o_custkey", F.lit(".gitter"))).when(
        F.col("o_orderstatus") == "F", F.lit("https://git.example/a/digit.git"))
    folder = F.concat(F.lit("/home/me/folder"), "o_custkey", F.lit("/"))
    return t.orders.select(F.col("o_orderkey").alias("id"), planning.project_label(url, folder).alias("label"))
