"""The queries of this subpackage, opN_<name>, and their SQL twins where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import audit, decontaminate, hnsw, lines, mixing, quality, secrets, simhash, threshold, tokens, toxicity, warc, whiten
from codequarry.llm.common import remainder

TOKENIZER = "word_bpe_49k.json"
GOOD, TOXIC = 0.3, 0.7  # scores from which a document counts as good, or as toxic


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.reports(_table(spark, folder, "documents"))
    strong = F.filter("spans", lambda s: s["kind"] < len(secrets.STRONG))

    def count(number: int, kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("bigint").alias(f"n_{kind}")

    counts = [count(number, kind) for number, kind in enumerate(secrets.KINDS)]
    digest = F.sha2(secrets.listed(strong), 256).alias("base_sha256")
    return found.select("doc_id", *counts[:3], digest, secrets.listed(F.col("spans")).alias("spans"), *counts[3:])


def op2_tokens(spark: SparkSession, folder: str) -> DataFrame:
    store = tokens.store(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))
    return tokens.read(spark, store, ids=False).withColumnRenamed("crc32", "ids_crc32")


def op3_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = hnsw.near_vectors(_table(spark, folder, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = quality.fit(docs, labels, remainder("doc_id", 5) != 0)
    found = quality.scored(docs, model)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(_table(spark, folder, "documents"))
    found = found.select("*", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("row"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op7_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.decisions(_table(spark, folder, "documents"))
    dropped = F.array_join(F.transform("dropped", lambda n: n.cast("string")), ",").alias("dropped")
    return found.select("doc_id", "n_lines", "n_kept", dropped)


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.spans(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = toxicity.fit(docs, labels, ~remainder("doc_id", 3).isin(1, -1))
    found = toxicity.scored(docs, model)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = warc.write_archive(_table(spark, folder, "pages"))
    return warc.read_records(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_topk(spark: SparkSession, folder: str) -> DataFrame:
    return threshold.top_rows(_table(spark, folder, "embeddings"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten.whitened(_table(spark, folder, "embeddings"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (
        op1_secrets, op2_tokens, op3_near_vectors, op4_quality, op5_simhash, op6_mixing, op7_fuzzy_lines, op8_decontamination, op9_toxicity,
        op10_warc, op11_topk, op12_whitening, op13_filter_audit, pipeline,
    )
}

ORACLES = {
    "op11_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op13_filter_audit": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents
        ), w AS (
            SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d
        ), l AS (
            SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
        ), f AS (
            SELECT part, CAST(len(words) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INTEGER)
                + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INTEGER)
                + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(w.doc_id > least, false) AS INTEGER) AS fails,
                coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
            FROM w LEFT JOIN l USING (doc_id)
        ), n AS (
            SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
        ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit), orders AS (
            SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letters AS a, letters AS b, letters AS c, letters AS d, letters AS e
            WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
        ), steps AS (
            SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
            FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
        ), counted AS (
            SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0) AS BIGINT) AS kept,
                CAST(coalesce(sum(n) FILTER (fails & bit > 0 AND fails & before = 0), 0) AS BIGINT) AS removed,
                CAST(coalesce(sum(n) FILTER (fails & bit > 0 AND fails & before > 0), 0) AS BIGINT) AS redundant,
                CAST(coalesce(sum(n) FILTER (fails = bit), 0) AS BIGINT) AS unique_fails,
                CAST(coalesce(sum(good) FILTER (fails & bit > 0 AND fails & before = 0), 0) AS BIGINT) AS good_lost,
                CAST(coalesce(sum(toxic) FILTER (fails & bit > 0 AND fails & before = 0), 0) AS BIGINT) AS toxic_lost
            FROM n, steps GROUP BY part, filter_order, step, bit
        )
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM counted""",
}
