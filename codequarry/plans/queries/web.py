"""Queries for links, pages, approvals and raw answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import paths, text
from codequarry.operators import curation
from codequarry.plans.registry import Inputs, query

SPACE = text.SPACE


def _unescape_sql(x: str) -> str:
    for name, char in (("copy", 169), ("middot", 183), ("quot", 34), ("amp", 38)):
        x = f"regexp_replace({x}, '&{name};?', chr({char}), 'g')"
    return x


def _squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


STRIPPED = "regexp_replace(html, '<[^>]*>', '', 'g')"


@query("cleaned_markup", f"SELECT page_id, {_squeeze_sql(_unescape_sql(STRIPPED))} AS cleaned FROM pages")
def cleaned_markup(t: Inputs):
    return t.pages.select("page_id", text.clean_markup(F.col("html")).alias("cleaned"))


@query("complete_hits", "SELECT page_id, url, relevance FROM {b_urls} WHERE url <> '' AND relevance IS NOT NULL")
def complete_hits(t: Inputs):
    return curation.require_fields(t.b_urls, ["url", "relevance"]).select("page_id", "url", "relevance")


@query(
    "pooled_hits",
    """SELECT session_id, source, page_id, place FROM (SELECT *, row_number() OVER (PARTITION BY session_id, relevance ORDER BY pos) AS place FROM {b_urls}) WHERE place <= 5""",
)
def pooled_hits(t: Inputs):
    return curation.pool_hits(t.b_urls, ["session_id", "relevance"], ["pos"]).select("session_id", "source", "page_id", "place")


@query(
    "shortlisted_sites",
    "SELECT session_id, page_id, place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(relevance, ''), pos) AS place FROM {b_urls}) WHERE place <= 5",
)
def shortlisted_sites(t: Inputs):
    hits = t.b_urls.withColumn("relevance", F.coalesce("relevance", F.lit("")))
    return curation.shortlist(hits, ["session_id"], ["relevance", "pos"]).select("session_id", "page_id", "place")


SITE_TYPE = """CASE WHEN contains(s, 'docs') OR contains(s, 'documentation') OR contains(s, 'api') OR contains(s, 'reference') THEN 'documentation'
                    WHEN contains(s, 'tutorial') OR contains(s, 'guide') OR contains(s, 'learn') THEN 'tutorial' ELSE 'resource' END"""


@query("site_types", f"SELECT site_id, {SITE_TYPE} AS type FROM (SELECT site_id, lower(url || ' ' || title) AS s FROM {{b_sites}})")
def site_types(t: Inputs):
    return t.b_sites.select("site_id", curation.site_type(F.col("url"), F.col("title")).alias("type"))


def _title_sql(x: str) -> str:
    words = f"regexp_extract_all(lower({x}), '\\p{{L}}+|[^\\p{{L}}]+')"
    return f"array_to_string(list_transform({words}, lambda w: upper(w[1]) || w[2:]), '')"


@query(
    "titles_from_urls",
    f"""SELECT link_no, {_title_sql("translate(regexp_extract(rtrim(link, '/'), '[^/]*$'), '-_', '  ')")} AS title FROM {{b_links}}""",
)
def titles_from_urls(t: Inputs):
    return t.b_links.select("link_no", paths.title_from_url(F.col("link")).alias("title"))


@query(
    "page_links",
    r"""SELECT page_id, CAST(spot - 1 AS BIGINT) AS place, CASE WHEN href LIKE 'http%' THEN href ELSE regexp_extract(url, '^[a-z]+://[^/?#]*') || href END AS link
        FROM (SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS spot
              FROM (SELECT page_id, url, regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<nav\b[^>]*>(.*?)</nav>', 1), chr(10)), '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1) AS hrefs FROM pages))""",
)
def page_links(t: Inputs):
    return curation.page_links(t.pages)


@query(
    "capped_links",
    "SELECT site_id, link_no, place FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY link_no) AS place FROM {b_links}) WHERE place <= 5",
)
def capped_links(t: Inputs):
    return curation.cap_per_source(t.b_links, ["site_id"], ["link_no"], 5).select("site_id", "link_no", "place")


@query(
    "routed_attempts",
    f"""WITH s AS (SELECT *, {SITE_TYPE.replace('contains(s,', "contains(lower(url || ' ' || title),")} AS kind FROM {{b_sites}}),
        l AS (SELECT * FROM {{b_links}})
        SELECT s.site_id, l.link AS url, {_title_sql("translate(regexp_extract(rtrim(l.link, '/'), '[^/]*$'), '-_', '  ')")} AS title, s.title AS source,
               'documentation' AS type, CAST(1 AS BIGINT) AS priority, 'browser-use-success' AS extraction_method
        FROM s JOIN l ON l.site_id = s.site_id WHERE kind = 'documentation' AND status = 'completed'
        UNION ALL SELECT site_id, url, title, title, 'main_page', 2, status || '-fallback' FROM s WHERE kind = 'documentation' AND status IN ('timeout', 'error')
        UNION ALL SELECT site_id, url, title, title, kind, 2, 'direct-url' FROM s WHERE kind <> 'documentation'""",
)
def routed_attempts(t: Inputs):
    sites = t.b_sites
    return curation.route_attempts(sites.drop("status"), sites.select("site_id", "status"), t.b_links)


RANKED = """(SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(priority, 3), CASE WHEN coalesce(relevance, '') = 'High' THEN 0 ELSE 1 END, pos) AS rank FROM {b_urls})"""


@query("ranked_urls", f"SELECT session_id, page_id, rank FROM {RANKED}")
def ranked_urls(t: Inputs):
    return curation.rank_urls(t.b_urls, ["session_id"], "pos").select("session_id", "page_id", "rank")


@query("fallback_ranks", "SELECT page_id, 'Medium' AS relevance, CAST(least(3, pos // 10 + 1) AS BIGINT) AS priority FROM {b_urls}")
def fallback_ranks(t: Inputs):
    return curation.fallback_rank(t.b_urls, "pos").select("page_id", "relevance", "priority")


APPROVAL = """(SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS id,
                      CASE WHEN length(title) > 60 THEN substr(title, 1, 60) || '...' ELSE title END AS title, url, source,
                      coalesce(relevance, 'Medium') AS relevance, 'unknown' AS method, page_id FROM {b_urls})"""


def _approval(t: Inputs):
    urls = t.b_urls.withColumn("type", F.lit("documentation")).withColumn("extraction_method", F.lit(None).cast("string"))
    return curation.approval_table(urls, ["session_id"], "pos")


@query("approval_table", f"SELECT session_id, id, title, url, source, relevance, method FROM {APPROVAL}")
def approval_table(t: Inputs):
    return _approval(t).select("session_id", "id", "title", "url", "source", "relevance", "method")


@query(
    "approved_urls",
    f"""WITH a AS {APPROVAL}, k AS (SELECT DISTINCT n_regionkey AS session_id, CAST(n_nationkey AS BIGINT) AS id FROM nation)
        SELECT 'approved' AS verdict, a.session_id, a.id FROM a JOIN k ON k.session_id = a.session_id AND k.id = a.id
        UNION ALL SELECT 'kept', a.session_id, a.id FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.session_id = a.session_id AND k.id = a.id)
        UNION ALL SELECT 'unknown', k.session_id, k.id FROM k WHERE NOT EXISTS (SELECT 1 FROM a WHERE k.session_id = a.session_id AND k.id = a.id)""",
)
def approved_urls(t: Inputs):
    table = _approval(t)
    keys = ["session_id", "id"]
    listed = t.nation.select(F.col("n_regionkey").cast("bigint").alias("session_id"), F.col("n_nationkey").cast("bigint").alias("id"))
    yes, unknown = curation.approve(table, keys, include=listed)
    rest, _ = curation.approve(table, keys, exclude=listed)
    verdict = lambda d, v: d.select(F.lit(v).alias("verdict"), *keys)
    return verdict(yes, "approved").union(verdict(rest, "kept")).union(verdict(unknown, "unknown"))


def _drop_sql(x: str) -> str:
    for tag in ("head", *curation.DROPPED_TAGS):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?(?:</{tag}\\s*>|\\z)', ' ', 'g')"
    return f"regexp_replace({x}, '(?s)<!--.*?(?:-->|\\z)', ' ', 'g')"


PAGE_TEXT = f"""(SELECT page_id, coalesce(string_agg(block, chr(10) ORDER BY spot), '') AS words FROM (
    SELECT page_id, spot, {_squeeze_sql("raw")} AS block FROM (
      SELECT page_id, unnest(bs) AS raw, generate_subscripts(bs, 1) AS spot FROM (
        SELECT page_id, string_split({_unescape_sql("regexp_replace(regexp_replace(" + _drop_sql("html") + ", '" + curation.BLOCK_TAGS + "', chr(1), 'g'), '<[^>]*>', '', 'g')")}, chr(1)) AS bs FROM pages)))
    WHERE len(string_split(block, ' ')) >= 10 GROUP BY page_id)"""


@query("page_texts", f"SELECT p.page_id, coalesce(w.words, '') AS body FROM pages p LEFT JOIN {PAGE_TEXT} w ON w.page_id = p.page_id")
def page_texts(t: Inputs):
    return t.pages.select("page_id", curation.page_text(F.col("html")).alias("body"))


@query(
    "crawl_summaries",
    f"""WITH c AS (SELECT u.session_id, w.words IS NOT NULL AS success, CASE WHEN w.words IS NULL THEN 0 ELSE len(string_split({_squeeze_sql("w.words")}, ' ')) END AS n
                   FROM {{b_urls}} u LEFT JOIN {PAGE_TEXT} w ON w.page_id = u.page_id)
        SELECT session_id, count(*) AS total_urls, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
               CAST(sum(n) AS BIGINT) AS total_words, CAST(sum(n) // greatest(1, count(*) FILTER (success)) AS BIGINT) AS avg_words_per_page FROM c GROUP BY session_id""",
)
def crawl_summaries(t: Inputs):
    asked = t.b_urls.select("session_id", "page_id")
    body = t.pages.select("page_id", curation.page_text(F.col("html")).alias("body"))
    results = asked.join(body, "page_id").select("session_id", (F.col("body") != "").alias("success"), text.word_count(F.col("body")).alias("word_count"))
    return curation.crawl_summary(asked, results, ["session_id"])


@query(
    "output_names",
    r"""SELECT page_id, substr(rtrim(regexp_replace(title, '[^\p{L}\p{N} _-]', '', 'g')), 1, 50) || '_' || (CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % 10000) || '.md' AS name FROM {b_urls}""",
)
def output_names(t: Inputs):
    return t.b_urls.select("page_id", paths.safe_file_name(F.col("title"), F.col("url")).alias("name"))


@query(
    "attempt_outcomes",
    """SELECT site_id, status, count(*) AS attempts, CAST(sum(urls_extracted) AS BIGINT) AS urls, round(sum(duration_seconds), 2) AS seconds, max(duration_seconds) AS longest
       FROM {b_attempts} GROUP BY site_id, status""",
)
def attempt_outcomes(t: Inputs):
    return curation.attempt_rollup(t.b_attempts, ["site_id"])


@query(
    "parsed_responses",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'direct' WHEN 'view' THEN 'fenced_json' WHEN 'signup' THEN 'fenced' WHEN 'purchase' THEN 'braces' ELSE 'error' END AS method,
              CASE WHEN event_type = 'error' THEN '-' ELSE props ->> '$.k' END AS k FROM events""",
)
def parsed_responses(t: Inputs):
    parsed = curation.parse_responses(t.b_responses, schema="k STRING")
    return parsed.select("event_id", "method", F.coalesce("parsed.k", F.lit("-")).alias("k"))


@query(
    "sectioned_bullets",
    r"""WITH l AS (SELECT report_id, unnest(string_split(response, chr(10))) AS raw, generate_subscripts(string_split(response, chr(10)), 1) - 1 AS line_no FROM {b_reports}),
        m AS (SELECT report_id, line_no, trim(raw) AS line,
                     CASE WHEN regexp_matches(lower(raw), 'finding|discovered|identified') THEN 'key_findings' WHEN regexp_matches(lower(raw), 'recommend|suggest|should') THEN 'recommendations'
                          WHEN regexp_matches(lower(raw), 'insight|pattern|architecture') THEN 'insights' END AS opened FROM l WHERE trim(raw) <> ''),
        p AS (SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM m)
        SELECT report_id, CAST(line_no AS BIGINT) AS line_no, section, regexp_replace(line, '^[-\x{2022}*\d.]\s*', '') AS item FROM p
        WHERE section IS NOT NULL AND regexp_matches(line, '^([-\x{2022}*]|[123]\.)')""",
)
def sectioned_bullets(t: Inputs):
    return curation.sectioned_bullets(t.b_reports, "report_id")
