"""From search hits to ranked links, approved pages, texts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import paths, text
from codequarry.functions.ranking import positions, top_n

# Terms that classify a site, first match wins.
SITE_TERMS = [
    ("documentation", ["docs", "documentation", "api", "reference"]),
    ("tutorial", ["tutorial", "guide", "learn"]),
]
LINKS_PER_SOURCE = 50  # what a cautious crawl takes of a site
DROPPED_TAGS = ["script", "style", "nav", "header", "footer"]
BLOCK_TAGS = r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|article|section|main|table|tr|td|th|blockquote|pre|body|html|br)\b[^>]*>"


def require_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which every named field is filled."""
    kept = df
    for c in columns:
        kept = kept.where(F.coalesce(F.col(c), F.lit("")) != "")
    return kept


def pool_hits(hits: DataFrame, by: list[str], order: list[str], per_query: int = 5) -> DataFrame:
    """The first hits of every query together; the same page found twice stays twice."""
    return top_n(hits, by, order, per_query, "place")


def shortlist(hits: DataFrame, by: list[str], order: list[str], candidates: int = 15, n: int = 5) -> DataFrame:
    """The first ``n`` of the first ``candidates`` pooled hits per session."""
    return top_n(hits, by, order, candidates, "place").where(F.col("place") <= n)


def site_type(url: Column, title: Column) -> Column:
    said = F.lower(F.concat(url, F.lit(" "), title))
    kind = F.lit("resource")
    for name, terms in reversed(SITE_TERMS):
        kind = F.when(text.contains_any(said, terms), name).otherwise(kind)
    return kind


def page_links(pages: DataFrame, scope: str | None = "nav") -> DataFrame:
    """Absolute http links of a page in order; ``scope`` names the element they must stand in."""
    area = F.col("html")
    if scope:
        inside = F.regexp_extract_all(area, F.lit(rf"(?is)<{scope}\b[^>]*>(.*?)(?:</{scope}\s*>|\z)"), F.lit(1))
        area = F.array_join(inside, "\n")
    found = F.regexp_extract_all(area, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    links = pages.select("page_id", "url", F.posexplode(found).alias("place", "href"))
    resolved = links.withColumn("link", paths.absolute_link(F.col("url"), F.trim("href")))
    return resolved.where(F.startswith("link", F.lit("http"))).select("page_id", F.col("place").cast("bigint"), "link")


def cap_per_source(links: DataFrame, by: list[str], order: list[str], n: int | None = None) -> DataFrame:
    """The first ``n`` links of every source in order, all without ``n``."""
    return top_n(links, by, order, n, "place")


def route_attempts(sites: DataFrame, attempts: DataFrame, links: DataFrame, cap: int | None = None) -> DataFrame:
    """Link rows out of extraction attempts, the first ``cap`` of a site if given.

    Documentation sites give their links when completed, their main page after
    a timeout or error, nothing when completed without links; other sites give
    their address.  ``sites(site_id, title, url)``, ``attempts(site_id, status)``,
    ``links(site_id, link_no, link)``.
    """
    typed = sites.withColumn("site_type", site_type(F.col("url"), F.col("title")))
    docs = typed.where(F.col("site_type") == "documentation").join(attempts.select("site_id", "status"), "site_id")
    row = lambda url, title, kind, priority, method: [
        F.col("site_id"), url.alias("url"), title.alias("title"), F.col("title").alias("source"), kind.alias("type"),
        F.lit(priority).cast("bigint").alias("priority"), method.alias("extraction_method"),
    ]
    capped = links if cap is None else cap_per_source(links, ["site_id"], ["link_no"], cap)
    done = docs.where(F.col("status") == "completed").join(capped, "site_id").select(
        *row(F.col("link"), paths.title_from_url(F.col("link")), F.lit("documentation"), 1, F.lit("browser-use-success")))
    failed = docs.where(F.col("status").isin("timeout", "error")).select(
        *row(F.col("url"), F.col("title"), F.lit("main_page"), 2, F.concat("status", F.lit("-fallback"))))
    direct = typed.where(F.col("site_type") != "documentation").select(
        *row(F.col("url"), F.col("title"), F.col("site_type"), 2, F.lit("direct-url")))
    return done.union(failed).union(direct)


def rank_urls(urls: DataFrame, by: list[str], place: str) -> DataFrame:
    """Rank by priority (3 when missing), high relevance first, then input order."""
    keyed = urls.withColumn("__priority", F.coalesce("priority", F.lit(3))).withColumn(
        "__lower", F.when(F.coalesce("relevance", F.lit("")) == "High", 0).otherwise(1))
    return positions(keyed, by, ["__priority", "__lower", place], "rank").drop("__priority", "__lower")


def fallback_rank(urls: DataFrame, place: str) -> DataFrame:
    """Without a ranking: medium relevance, priority falling every ten links down to 3; ``place`` from 0."""
    return urls.withColumn("relevance", F.lit("Medium")).withColumn(
        "priority", F.least(F.lit(3), F.floor(F.col(place) / 10) + 1).cast("bigint"))


def approval_table(urls: DataFrame, by: list[str], place: str) -> DataFrame:
    """The table a reviewer sees: 1-based ids in order, shortened titles, defaults filled."""
    numbered = positions(urls, by, [place], "id")
    return numbered.select(
        *by, "id", text.shorten(F.col("title"), 60).alias("title"), "url", "source", "type", "priority",
        F.coalesce("relevance", F.lit("Medium")).alias("relevance"),
        F.coalesce("extraction_method", F.lit("unknown")).alias("method"),
    )


def approve(table: DataFrame, keys: list[str], include: DataFrame | None = None, exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Approved rows by include list, exclude list or all; and listed keys that name no row."""
    listed = include if include is not None else exclude
    if listed is None:
        return table, table.select(*keys).limit(0)
    how = "left_semi" if include is not None else "left_anti"
    rejects = listed.select(*keys).distinct().join(table.select(*keys), keys, "left_anti")
    return table.join(listed.select(*keys).distinct(), keys, how), rejects


def page_text(html: Column, drop_tags: list[str] = DROPPED_TAGS, min_words: int = 10) -> Column:
    """Readable text of a page: its blocks of at least ``min_words`` words, one per line."""
    dropped = "|".join(["head", *drop_tags])
    bare = F.regexp_replace(html, rf"(?is)<({dropped})\b.*?(?:</\1\s*>|\z)", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?(?:-->|\z)", " ")
    # one Arrow call per page instead of one per block
    blocks = text.unescape_all(F.transform(F.split(bare, BLOCK_TAGS), text.strip_tags))
    kept = F.filter(F.transform(blocks, text.squeeze), lambda b: text.word_count(b) >= min_words)
    return F.array_join(kept, "\n")


def crawl_summary(approved: DataFrame, results: DataFrame, by: list[str]) -> DataFrame:
    """Totals per session: pages asked for, crawled, failed, words, mean words of the successful."""
    asked = approved.groupBy(*by).agg(F.count(F.lit(1)).alias("total_urls"))
    got = results.groupBy(*by).agg(
        F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("word_count"))), F.lit(0)).cast("bigint").alias("total_words"),
    )
    joined = asked.join(got, by, "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("successful", "failed", "total_words")]
    mean = F.floor(F.coalesce("total_words", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("successful", F.lit(0))))
    return joined.select(*by, "total_urls", *zero, mean.alias("avg_words_per_page"))


def attempt_rollup(attempts: DataFrame, by: list[str] = []) -> DataFrame:
    """Attempts, links and durations per outcome."""
    return attempts.groupBy(*by, "status").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("urls_extracted").alias("urls"),
        F.round(F.sum("duration_seconds"), 2).alias("seconds"), F.max("duration_seconds").alias("longest"),
    )


def without_trailing_commas(candidate: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(candidate, r",\s*\}", "}"), r",\s*\]", "]"))


def _valid(candidate: Column) -> Column:
    """The candidate if it is JSON, else NULL."""
    return F.when(F.try_parse_json(candidate).isNotNull(), candidate)


def parse_responses(raw: DataFrame, column: str = "response", schema: str | None = None) -> DataFrame:
    """Structured answers out of raw model answers.

    Tried in order: the whole text when it is in braces (``error`` if that is
    no JSON), a fenced JSON block, any fenced block, a brace pair - the last
    three repaired of trailing commas.  Adds ``method`` (``text`` when nothing
    parses) and ``parsed``: the JSON text, or a struct when a schema is given.
    """
    whole = text.squeeze_ends(F.col(column))
    braced = F.startswith(whole, F.lit("{")) & F.endswith(whole, F.lit("}"))

    def first(pattern: str) -> Column:
        found = F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1))
        return F.get(F.array_compact(F.transform(found, lambda c: _valid(without_trailing_commas(c)))), F.lit(0))

    tries = [
        F.when(braced, F.struct(F.when(_valid(whole).isNotNull(), "direct").otherwise("error").alias("method"), _valid(whole).alias("parsed"))),
        *[F.struct(F.lit(name).alias("method"), first(pattern).alias("parsed")) for name, pattern in (
            ("fenced_json", r"(?s)```json\s*(.*?)\s*```"), ("fenced", r"(?s)```\s*(.*?)\s*```"), ("braces", r"(?s)(\{.*?\})"))],
    ]
    settled = F.filter(F.array(*tries), lambda t: t["parsed"].isNotNull() | (t["method"] == "error"))
    tried = raw.withColumn("__tried", F.get(settled, F.lit(0)))
    method, parsed = F.coalesce("__tried.method", F.lit("text")), F.col("__tried.parsed")
    if schema is not None:
        parsed = F.from_json(parsed, schema)
    return tried.withColumn("method", method).withColumn("parsed", parsed).drop("__tried")


# Words that open a section, the first family found in a line wins.
SECTION_TERMS = [
    ("key_findings", ["finding", "discovered", "identified"]),
    ("recommendations", ["recommend", "suggest", "should"]),
    ("insights", ["insight", "pattern", "architecture"]),
]
BULLET = r"^(?:[-\x{2022}*]|[123]\.)"


def sectioned_bullets(raw: DataFrame, key: str, column: str = "response") -> DataFrame:
    """List items of free text under the section last opened above them.

    The window spans the lines of one text.
    """
    lines = raw.select(key, F.posexplode(F.split(column, "\n")).alias("line_no", "line")).withColumn("line", text.squeeze_ends(F.col("line")))
    opened = F.lit(None)
    for section, terms in reversed(SECTION_TERMS):
        opened = F.when(text.contains_any(F.lower("line"), terms), section).otherwise(opened)
    upto = Window.partitionBy(key).orderBy("line_no")
    placed = lines.where(F.col("line") != "").withColumn("section", F.last_value(opened, ignoreNulls=True).over(upto))
    items = placed.where(F.col("section").isNotNull() & F.col("line").rlike(BULLET))
    return items.select(key, F.col("line_no").cast("bigint"), "section", F.regexp_replace("line", r"^[-\x{2022}*\d.]\s*", "").alias("item"))
