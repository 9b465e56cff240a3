"""Queries over files, documents and written tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.ranking import positions
from codequarry.plans.registry import Inputs, query
from codequarry.session import scratch_path
from codequarry.sources import documents, files, tables


@query(
    "scanned_tree",
    """SELECT 'source=' || source || '/lang=' || lang AS folder, CAST(sum(length(replace(text, chr(13), ' ')) + 1) AS BIGINT) AS chars
       FROM documents GROUP BY source, lang""",
)
def scanned_tree(t: Inputs):
    root = scratch_path(t.spark, "tree")
    flat = t.documents.select("source", "lang", F.translate("text", "\r", " ").alias("value"))
    flat.write.partitionBy("source", "lang").option("maxRecordsPerFile", 50).text(root)
    found = files.scan_files(t.spark, root, "*.txt")
    return found.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.sum(F.length("content")).alias("chars"))


@query(
    "files_matching_globs",
    """SELECT path, 'local' AS mode FROM {b_listing}
       WHERE (path LIKE '%.py' OR path LIKE '/opt/%' OR regexp_matches(path, '/f[0-9][^/]*5\\.yml$'))
         AND NOT (path LIKE '%site-packages/%' OR regexp_matches(path, '/src[^1]/'))
       UNION ALL
       SELECT path, 'remote' AS mode FROM {b_listing}
       WHERE regexp_matches(path, '/f[^/]*\\.(js|json)$') AND NOT path LIKE '/usr/%'""".replace("\\\\", "\\"),
)
def files_matching_globs(t: Inputs):
    listing = t.b_listing.select("path")
    local = files.glob_filter(listing, ["*.py", "/opt/*", "*/f[0-9]*5.yml"], ["*site-packages/*", "*/src[!1]/*"])
    remote = files.glob_filter(listing, ["f*.js", "f*.json"], ["/usr/*"], mode="remote")
    return local.withColumn("mode", F.lit("local")).union(remote.withColumn("mode", F.lit("remote")))


@query(
    "pruned_folders",
    """SELECT path FROM {b_listing} WHERE NOT regexp_matches(path, '/(site-packages|lib)/') AND NOT path LIKE '/etc/nginx/%'
       AND NOT regexp_matches(path, '/src1[0-9]/')""",
)
def pruned_folders(t: Inputs):
    return files.prune_dirs(t.b_listing.select("path"), ["site-packages", "lib"], ["etc/nginx", "src1[0-9]"])


@query("files_within_size", "SELECT path, size FROM {b_files} WHERE size <= 2000")
def files_within_size(t: Inputs):
    kept, _ = files.size_filter(t.b_files.select("path", "size"), 2000)
    return kept


@query(
    "size_accounting",
    """SELECT repo_id, count(*) FILTER (size <= 2000) AS downloaded, count(*) FILTER (size > 2000) AS skipped,
              CAST(coalesce(sum(size) FILTER (size > 2000), 0) AS BIGINT) AS skipped_bytes FROM {b_files} GROUP BY repo_id""",
)
def size_accounting(t: Inputs):
    _, stats = files.size_filter(t.b_files.select("repo_id", "size"), 2000, by=["repo_id"])
    return stats


@query("analysis_document", "SELECT CAST(id AS VARCHAR) AS id, name, file_path, CAST(complexity AS BIGINT) AS complexity FROM {b_functions}")
def analysis_document(t: Inputs):
    path = scratch_path(t.spark, "analysis")
    nodes = t.b_functions.select(
        F.col("id").cast("string"), "node_type", "name", "qualified_name",
        F.struct("file_path", F.col("line_start").cast("int")).alias("location"), "complexity", "docstring", "github_url",
    )
    meta = nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if(F.col("node_type") == "function").alias("functions"))
    documents.write_analysis(meta, nodes, path)
    functions, _, _ = documents.split_nodes(documents.read_analysis(t.spark, path, sharded=True))
    return functions.select("id", "name", "location.file_path", F.col("complexity").cast("bigint"))


@query(
    "analysis_in_one_document",
    """SELECT 'function' AS kind, CAST(id AS VARCHAR) AS id, name, CAST(complexity AS VARCHAR) AS detail, docstring FROM {b_functions}
       UNION ALL SELECT 'metadata', NULL, NULL, CAST((SELECT count(*) FROM {b_functions}) + (SELECT count(*) FROM {b_classes}) AS VARCHAR), NULL""",
)
def analysis_in_one_document(t: Inputs):
    """Functions and metadata out of one JSON document that many tasks read by byte ranges."""
    path = scratch_path(t.spark, "document")
    functions = t.b_functions.select(F.col("id").cast("string"), "node_type", "name", "complexity", "docstring")
    nodes = functions.unionByName(t.b_classes.select(F.col("id").cast("string"), "node_type", "name"), True)
    documents.write_analysis_document(nodes.agg(F.count(F.lit(1)).alias("total_nodes")), nodes, path)
    found = documents.read_analysis(t.spark, path, kind="function", range_bytes=1 << 20)
    meta = documents.read_analysis_metadata(t.spark, path, range_bytes=1 << 20)
    return found.select(F.lit("function").alias("kind"), "id", "name", F.col("complexity").cast("string").alias("detail"), "docstring").union(
        meta.select(F.lit("metadata"), F.lit(None), F.lit(None), F.col("total_nodes").cast("string"), F.lit(None)))


@query(
    "session_store",
    """SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS BIGINT) AS place,
              type, content FROM {b_messages}""",
)
def session_store(t: Inputs):
    path = scratch_path(t.spark, "sessions")
    messages = t.b_messages.select(
        F.col("session_id").cast("string"), "turn", F.concat_ws("-", "session_id", "turn").alias("id"), "type", "content",
        F.lit(None).cast("string").alias("timestamp"),
    )
    sessions = messages.select(F.col("session_id").alias("id")).distinct()
    documents.write_sessions(sessions, messages, ["turn"], path)
    _, stored = documents.read_sessions(t.spark, path, sharded=True)
    return stored.select("session_id", "place", "type", "content")


@query(
    "curation_state_store",
    """SELECT status, count(*) AS attempts, CAST(sum(urls_extracted) AS BIGINT) AS urls, round(max(duration_seconds), 6) AS longest
       FROM {b_attempts} GROUP BY status""",
)
def curation_state_store(t: Inputs):
    path = scratch_path(t.spark, "state")
    attempts = t.b_attempts.select(
        F.col("site_id").cast("string").alias("session_id"), F.lit(0).alias("place"), F.lit("site").alias("site_title"),
        "start_time", "duration_seconds", "status", F.col("urls_extracted").cast("int"),
    )
    documents.write_state({"attempts": attempts}, path)
    stored = documents.read_state_tables(t.spark, path, ["attempts"])["attempts"]
    return stored.groupBy("status").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("urls_extracted").alias("urls"), F.round(F.max("duration_seconds"), 6).alias("longest")
    )


@query(
    "analysis_kinds",
    """SELECT 'function' AS kind, CAST(id AS VARCHAR) AS id, name, file_path, CAST(complexity AS VARCHAR) AS detail FROM {b_functions}
       UNION ALL SELECT 'class', CAST(id AS VARCHAR), name, file_path, base FROM {b_classes}
       UNION ALL SELECT 'import', file_path || '|' || module || '|' || item, module, file_path, item FROM {b_imports}""",
)
def analysis_kinds(t: Inputs):
    """All kinds of nodes written as one analysis and read back apart."""
    path = scratch_path(t.spark, "analysis")
    at = F.struct("file_path").alias("location")
    functions = t.b_functions.select(F.col("id").cast("string"), "node_type", "name", at, "complexity")
    classes = t.b_classes.select(F.col("id").cast("string"), "node_type", "name", at, F.array("base").alias("base_classes"))
    imports = t.once("b_imports").select(
        F.concat_ws("|", "file_path", "module", "item").alias("id"), F.lit("import").alias("node_type"), F.col("module").alias("name"), at,
        "module", F.array("item").alias("imports"),
    )
    nodes = functions.unionByName(classes, True).unionByName(imports, True)
    documents.write_analysis(nodes.agg(F.count(F.lit(1)).alias("total_nodes")), nodes, path)
    f, c, i = documents.split_nodes(documents.read_analysis(t.spark, path, sharded=True))
    shown = lambda rows, detail: rows.select(F.col("node_type").alias("kind"), "id", "name", "location.file_path", detail.alias("detail"))
    return shown(f, F.col("complexity").cast("string")).union(shown(c, F.array_join("base_classes", ","))).union(shown(i, F.array_join("imports", ",")))


@query(
    "stored_sessions",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS title, 'c' || c_nationkey AS created_at, c_mktsegment AS last_message_at,
              coalesce(array_to_string(list_sort(s.sources), ','), '') AS attached_sources
       FROM customer LEFT JOIN (SELECT o_custkey, list(DISTINCT o_orderpriority) AS sources FROM orders GROUP BY o_custkey) s ON o_custkey = c_custkey""",
)
def stored_sessions(t: Inputs):
    """Session rows with title, stamps and attached sources, written and read back."""
    path = scratch_path(t.spark, "sessions")
    sources = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("attached_sources"))
    rows = t.customer.join(sources, "c_custkey", "left").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.concat(F.lit("c"), "c_nationkey").alias("created_at"),
        F.col("c_mktsegment").alias("last_message_at"), F.coalesce("attached_sources", F.array().cast("array<string>")).alias("attached_sources"),
    )
    messages = t.b_messages.select(
        F.col("session_id").cast("string"), "turn", F.col("turn").cast("string").alias("id"), "type", "content", F.lit(None).cast("string").alias("timestamp"))
    documents.write_sessions(rows, messages, ["turn"], path)
    stored, _ = documents.read_sessions(t.spark, path, sharded=True)
    return stored.withColumn("attached_sources", F.array_join("attached_sources", ","))


@query(
    "curation_state_tables",
    """SELECT 'sites' AS part, CAST(site_id AS VARCHAR) AS session_id, title AS a, url AS b FROM {b_sites}
       UNION ALL SELECT 'urls', CAST(session_id AS VARCHAR), url, coalesce(CAST(priority AS VARCHAR), '-') FROM {b_urls}
       UNION ALL SELECT 'approved', CAST(session_id AS VARCHAR), url, coalesce(relevance, '-') FROM {b_urls} WHERE priority = 1
       UNION ALL SELECT 'crawled', CAST(page_id % 5 AS VARCHAR), url, CAST(length(html) AS VARCHAR) FROM pages
       UNION ALL SELECT 'states', CAST(user_id AS VARCHAR), event_type, CAST(max(event_id) AS VARCHAR) FROM events GROUP BY user_id, event_type""",
)
def curation_state_tables(t: Inputs):
    """The other tables of a curation state, written and read back."""
    path = scratch_path(t.spark, "state")
    place = F.lit(0).alias("place")
    urls = t.b_urls.select(F.col("session_id").cast("string"), place, "url", "title", "source", F.col("priority").cast("int"), "relevance")
    moment = F.timestamp_seconds(F.max("event_id")).cast("timestamp_ntz")
    documents.write_state({
        "sites": t.b_sites.select(F.col("site_id").cast("string").alias("session_id"), place, "title", "url"), "urls": urls,
        "approved": urls.where("priority = 1"),
        "crawled": t.pages.select((F.col("page_id") % 5).cast("string").alias("session_id"), place, "url", F.lit(True).alias("success"), F.length("html").alias("word_count")),
        "states": t.events.groupBy(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("status")).agg(moment.alias("last_updated")),
    }, path)
    got = documents.read_state_tables(t.spark, path, ["sites", "urls", "approved", "crawled", "states"])
    shown = {
        "sites": ("title", F.col("url")), "urls": ("url", F.coalesce(F.col("priority").cast("string"), F.lit("-"))),
        "approved": ("url", F.coalesce("relevance", F.lit("-"))), "crawled": ("url", F.col("word_count").cast("string")),
        "states": ("status", F.unix_seconds(F.col("last_updated").cast("timestamp")).cast("string")),
    }
    parts = [got[n].select(F.lit(n).alias("part"), "session_id", F.col(a).alias("a"), b.alias("b")) for n, (a, b) in shown.items()]
    return reduce(DataFrame.union, parts)


@query(
    "upserted_nodes",
    """WITH last AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey),
       b AS (SELECT o.o_custkey AS id, o.o_orderstatus AS name, CASE WHEN o.o_orderstatus = 'P' THEN NULL ELSE o.o_orderpriority END AS embedding,
                    CASE WHEN o.o_orderstatus = 'F' THEN NULL ELSE o.o_totalprice END AS score
             FROM orders o JOIN last ON last.k = o.o_orderkey)
       SELECT coalesce(b.id, c_custkey) AS id, CASE WHEN b.id IS NULL THEN c_name ELSE b.name END AS name,
              coalesce(b.embedding, c_mktsegment) AS embedding, CASE WHEN b.id IS NULL THEN c_acctbal ELSE b.score END AS score
       FROM customer FULL JOIN b ON b.id = c_custkey""",
)
def upserted_nodes(t: Inputs):
    target = t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS embedding", "c_acctbal AS score")
    batch = t.orders.selectExpr(
        "o_custkey AS id", "o_orderkey", "o_orderstatus AS name",
        "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS embedding",
        "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS score",
    )
    return tables.upsert(target, batch, ["id"], ["o_orderkey"], keep_if_null=["embedding"])


@query("overwritten_table", "SELECT s_suppkey, s_name FROM supplier")
def overwritten_table(t: Inputs):
    path = scratch_path(t.spark, "overwritten")
    tables.overwrite(t.customer.selectExpr("c_custkey AS s_suppkey", "c_name AS s_name"), path)
    return tables.overwrite(t.supplier.select("s_suppkey", "s_name"), path)


@query(
    "markdown_table",
    """SELECT CAST(row_number() OVER (ORDER BY page_id) + 1 AS BIGINT) AS line_no,
              '| ' || page_id || ' | ' || url || ' | ' || coalesce(CAST(priority AS VARCHAR), 'None') || ' | ' || coalesce(relevance, 'None') || ' |' AS line
       FROM {b_urls}
       UNION ALL SELECT 0, '| ID | URL | Priority | Relevance |' UNION ALL SELECT 1, '| --- | --- | --- | --- |'""",
)
def markdown_table(t: Inputs):
    rows = t.b_urls.selectExpr("page_id AS ID", "url AS URL", "priority AS Priority", "relevance AS Relevance")
    return tables.to_markdown(positions(rows, [], ["ID"], "place"), "place")
