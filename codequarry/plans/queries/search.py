"""Queries for vector retrieval and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import retrieval
from codequarry.plans.registry import Inputs, query
from codequarry.session import materialize

# Query vectors: the mean vector of every label, rounded so both engines start from equal numbers.
MEANS_SQL = """(SELECT label, list(m ORDER BY spot) AS embedding FROM (
      SELECT label, spot, round(avg(x), 6) AS m FROM (
        SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS spot FROM embeddings) GROUP BY label, spot) GROUP BY label)"""


def _means(t: Inputs, by: str = "label"):
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("spot", "x"))
    means = parts.groupBy("label", "spot").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    # as many entries as the vectors have dimensions
    return means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("spot", "m"))), lambda p: p["m"]).alias("embedding"))


# Two strategies per query: its own label's mean, and the next label's with less weight.
STRATEGIES_SQL = f"""(SELECT CAST(label AS BIGINT) AS query_id, 0 AS strategy_no, 'semantic' AS type, 20 AS k, 1 AS priority, embedding FROM {MEANS_SQL}
     UNION ALL SELECT CAST((label + 9) % 10 AS BIGINT), 1, 'technical', 15, 2, embedding FROM {MEANS_SQL})"""
SCORES_SQL = f"""
    s AS {STRATEGIES_SQL},
    scored AS (SELECT s.query_id, s.strategy_no, s.type, s.k, s.priority, v.id, v.name, v.node_type,
                      (1 + list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), s.embedding)) / 2 AS score
               FROM s, {{b_vectors}} v),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, strategy_no ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= k AND score >= 0.4)
"""


def _strategies(t: Inputs):
    means = _means(t)
    own = means.select(F.col("label").cast("bigint").alias("query_id"), F.lit(0).alias("strategy_no"), F.lit("semantic").alias("type"),
                       F.lit(20).alias("k"), F.lit(1).alias("priority"), "embedding")
    near = means.select(((F.col("label") + 9) % 10).cast("bigint").alias("query_id"), F.lit(1).alias("strategy_no"), F.lit("technical").alias("type"),
                        F.lit(15).alias("k"), F.lit(2).alias("priority"), "embedding")
    return own.union(near)


def _hits(t: Inputs):
    asked = _strategies(t).withColumn("key", F.col("query_id") * 10 + F.col("strategy_no"))
    found = retrieval.vector_topk_batch(t.b_vectors, asked.select(F.col("key").alias("query_id"), "embedding", "k"), 20)
    named = found.withColumnRenamed("query_id", "key").join(asked.drop("embedding", "k"), "key").drop("key")
    return named.join(t.b_vectors.select("id", "name", "node_type"), "id")


@query(
    "nearest_vectors",
    f"""WITH q AS (SELECT embedding FROM {MEANS_SQL} WHERE label = 3)
        SELECT id, name, round(score, 6) AS score FROM (
          SELECT id, name, (1 + list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), q.embedding)) / 2 AS score FROM {{b_vectors}} v, q ORDER BY score DESC, id LIMIT 20)
        WHERE score >= 0.6""",
)
def nearest_vectors(t: Inputs):
    center = _means(t).where("label = 3").select("embedding").scalar()
    found = retrieval.vector_topk(t.b_vectors, center, 20, threshold=0.6)
    return found.select("id", "name", F.round("score", 6).alias("score"))


@query("strategy_hits", f"WITH {SCORES_SQL} SELECT query_id, type, id, round(score, 6) AS score, rank FROM hits")
def strategy_hits(t: Inputs):
    return _hits(t).select("query_id", "type", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "candidate_vectors",
    """SELECT id, 'class' AS wanted FROM {b_vectors} WHERE node_type = 'Class' UNION ALL SELECT id, 'mixed' FROM {b_vectors} WHERE node_type = 'Function'
       UNION ALL SELECT id, 'both' FROM {b_vectors}""",
)
def candidate_vectors(t: Inputs):
    v = t.b_vectors
    parts = [
        retrieval.candidate_set(v, ["Class"]).select("id", F.lit("class").alias("wanted")),
        retrieval.candidate_set(v, ["Function", "Class"]).select("id", F.lit("mixed").alias("wanted")),
        retrieval.candidate_set(v, ["Function", "Class"], both=True).select("id", F.lit("both").alias("wanted")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


PLAN_SQL = """(
    SELECT query_id, text, 0 AS rule, 'semantic' AS type, text || ' implementation functionality code' AS search_text, 'Function,Class' AS node_types, 20 AS max_results, 1 AS priority FROM {b_questions}
    UNION ALL SELECT query_id, text, 1, 'technical', 'command line argument parser main function script', 'Function', 15, 2 FROM {b_questions}
      WHERE text LIKE '%cli%' OR text LIKE '%command%' OR text LIKE '%argument%' OR text LIKE '%parse%'
    UNION ALL SELECT query_id, text, 2, 'technical', 'authentication login security user verification', 'Function,Class', 15, 2 FROM {b_questions}
      WHERE text LIKE '%auth%' OR text LIKE '%login%' OR text LIKE '%security%' OR text LIKE '%credential%')"""


@query(
    "planned_strategies",
    f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rule) - 1 AS BIGINT) AS strategy_no, type, search_text, node_types,
               CAST(max_results AS BIGINT) AS max_results, CAST(priority AS BIGINT) AS priority FROM {PLAN_SQL}""",
)
def planned_strategies(t: Inputs):
    planned = retrieval.plan_strategies(t.b_questions)
    return planned.select("query_id", F.col("strategy_no").cast("bigint"), "type", "search_text", F.array_join("node_types", ",").alias("node_types"),
                          F.col("max_results").cast("bigint"), F.col("priority").cast("bigint"))


FUSED_SQL = """fused AS (SELECT * FROM (SELECT *, score / priority AS weighted, row_number() OVER (PARTITION BY query_id, id ORDER BY score / priority DESC, strategy_no) AS n
                         FROM hits) WHERE n = 1)"""


@query("fused_hits", f"WITH {SCORES_SQL}, {FUSED_SQL} SELECT query_id, id, type, round(score, 6) AS score, round(weighted, 6) AS weighted FROM fused")
def fused_hits(t: Inputs):
    return retrieval.fuse(_hits(t)).select("query_id", "id", "type", F.round("score", 6).alias("score"), F.round("weighted", 6).alias("weighted"))


@query(
    "strategy_breakdown",
    f"""WITH {SCORES_SQL}, u AS (SELECT query_id, count(*) AS total, count(DISTINCT id) AS unique_entities FROM hits GROUP BY query_id)
        SELECT h.query_id, type, count(*) AS hits, any_value(total) AS total, any_value(unique_entities) AS unique_entities
        FROM hits h JOIN u ON u.query_id = h.query_id GROUP BY h.query_id, type""",
)
def strategy_breakdown(t: Inputs):
    return retrieval.strategy_breakdown(materialize(_hits(t), "hits"))


@query(
    "context_lines",
    f"""WITH {SCORES_SQL} SELECT query_id, CAST(strategy_no AS BIGINT) AS strategy_no, rank AS place,
        printf('- %s (%s) in %s [score: %.2f, strategy: %s]', name, node_type, 'f' || id || '.py', score, type) AS line FROM hits WHERE rank <= 3""",
)
def context_lines(t: Inputs):
    hits = _hits(t).withColumn("file_path", F.concat(F.lit("f"), "id", F.lit(".py")))
    return retrieval.context_summary(hits).withColumn("strategy_no", F.col("strategy_no").cast("bigint"))


@query(
    "flat_hits",
    f"""WITH {SCORES_SQL}, flat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, strategy_no ORDER BY score DESC, id) AS place FROM scored) WHERE place <= 10 AND score >= 0.6)
        SELECT query_id, CAST(strategy_no AS BIGINT) AS strategy_no, id, round(score, 6) AS score FROM flat""",
)
def flat_hits(t: Inputs):
    found = retrieval.retrieve_flat(t.b_vectors, _strategies(t), 10)
    return found.select("query_id", F.col("strategy_no").cast("bigint"), "id", F.round("score", 6).alias("score"))


def _family_sql(column: str) -> str:
    cases = []
    for family, words in retrieval.KEYWORD_FAMILIES.items():
        said = " OR ".join(f"contains(lower({column}), '{w}')" for w in words)
        cases.append(f"CASE WHEN {said} THEN '{family}' END")
    return f"concat_ws(',', {', '.join(cases)})"


@query("keyword_families", f"SELECT doc_id, {_family_sql('text')} AS families FROM documents")
def keyword_families(t: Inputs):
    return t.documents.select("doc_id", F.array_join(retrieval.tag_families(F.col("text")), ",").alias("families"))


@query(
    "result_previews",
    """SELECT source, place, place || '. ' || concat_ws(' | ', 'doc_id: ' || doc_id, 'lang: ' || CASE WHEN lang <> 'en' THEN lang END,
              'content: ' || CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END, 'tags: ' || source || ', ' || lang) AS line
       FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) WHERE place <= 10""",
)
def result_previews(t: Inputs):
    rows = t.documents.select("source", "doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"), F.col("text").alias("content"),
                              F.array("source", "lang").alias("tags"))
    return retrieval.preview(rows, ["source"], ["doc_id"], ["doc_id", "lang", "content", "tags"])


# The labels' queries return results only for labels with a function above a score of 0.7.
RESULTS_SQL = "results AS (SELECT query_id, id FROM hits WHERE strategy_no = 0 AND node_type = 'Function' AND score > 0.7)"


def _results(hits):
    return hits.where("strategy_no = 0 AND node_type = 'Function' AND score > 0.7").select("query_id", "id")


@query(
    "empty_result_notes",
    f"""WITH {SCORES_SQL}, {RESULTS_SQL}, q AS (SELECT DISTINCT query_id, query_id <> 9 AS is_valid FROM s),
        e AS (SELECT * FROM q WHERE query_id NOT IN (SELECT query_id FROM results)),
        u AS (SELECT query_id, count(DISTINCT id) AS n FROM hits GROUP BY query_id), b AS (SELECT query_id, type, count(*) AS n FROM hits GROUP BY query_id, type)
        SELECT e.query_id, 'invalid query' AS verdict, 'Found ' || coalesce(u.n, 0) || ' related entities during search' AS note FROM e LEFT JOIN u ON u.query_id = e.query_id WHERE NOT is_valid
        UNION ALL
        SELECT e.query_id, 'no matches', CASE WHEN b.type IS NULL THEN '- No related entities found' ELSE '- **' || b.type || '**: ' || b.n || ' related entities' END
        FROM e LEFT JOIN b ON b.query_id = e.query_id WHERE is_valid""",
)
def empty_result_notes(t: Inputs):
    hits = materialize(_hits(t), "hits")
    asked = _strategies(t).select("query_id", (F.col("query_id") != 9).alias("is_valid")).distinct()
    return retrieval.diagnose_empty(asked, _results(hits), hits)


@query(
    "run_records",
    f"""WITH {SCORES_SQL}, {RESULTS_SQL}, p AS (SELECT query_id, count(*) AS n FROM {PLAN_SQL} GROUP BY query_id),
        h AS (SELECT query_id, count(*) AS n, count(DISTINCT id) AS d FROM hits GROUP BY query_id), r AS (SELECT query_id, count(*) AS n FROM results GROUP BY query_id)
        SELECT q.query_id, 'Find entities related to: ' || q.text AS intent, coalesce(p.n, 0) AS strategies, coalesce(h.n, 0) AS total_results,
               coalesce(h.d, 0) AS unique_entities, coalesce(r.n, 0) AS results, q.value AS elapsed
        FROM {{b_questions}} q LEFT JOIN p ON p.query_id = q.query_id LEFT JOIN h ON h.query_id = q.query_id LEFT JOIN r ON r.query_id = q.query_id""",
)
def run_records(t: Inputs):
    hits = materialize(_hits(t), "hits")
    questions = t.b_questions.withColumnRenamed("value", "elapsed")
    return retrieval.run_record(questions, retrieval.plan_strategies(t.b_questions), hits, _results(hits))


@query(
    "similar_functions",
    """WITH v AS {b_vectors}, q AS (SELECT * FROM v WHERE name = 'v7')
       SELECT id, name, round(score, 6) AS score FROM (
         SELECT v.id, v.name, (1 + list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / 2 AS score, q.id AS self
         FROM v, q ORDER BY score DESC, v.id LIMIT 5) WHERE id <> self""",
)
def similar_functions(t: Inputs):
    return retrieval.similar_functions(t.b_vectors, "v7").select("id", "name", F.round("score", 6).alias("score"))
