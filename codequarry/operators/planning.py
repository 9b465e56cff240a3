"""Concept graphs and chapters of many projects: validation, order, and document lines.

Documents come out as numbered lines or sections, not as one string per
project, so a large project is never assembled in one task.  Checks return what
passed and, on the side, what did not and why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import paths, text


def corpus_context(files: DataFrame, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Numbered texts under their index headers, one section per file; files over ``budget`` tokens are rejected."""
    header = F.format_string("--- File Index %d: %s ---\n", "idx", "path")
    section = F.concat(header, text.number_lines(F.col("content")), F.lit("\n\n"))
    sections = files.select("repo_id", "idx", "path", section.alias("section"))
    if budget is None:
        return sections, sections.limit(0)
    return estimate_tokens(sections, "section", budget)


def file_listing(files: DataFrame) -> DataFrame:
    """``- idx # path`` per file."""
    return files.select("repo_id", "idx", F.format_string("- %d # %s", "idx", "path").alias("line"))


def index_of(entry: Column) -> Column:
    """The number in ``3``, ``' 3'`` or ``'3 # path'``; NULL when there is none."""
    head = F.trim(F.split_part(entry.cast("string"), F.lit("#"), F.lit(1)))
    return F.when(head.rlike(r"^[+-]?[0-9]+$"), head.try_cast("bigint"))


def parse_index(df: DataFrame, column: str, n: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with a valid ``index`` in 0..n-1, and the others with the reason."""
    parsed = df.withColumn("index", index_of(F.col(column)))
    reason = (
        F.when(F.col("index").isNull(), "not an index").when((F.col("index") < 0) | (F.col("index") >= n), "out of range")
    )
    marked = parsed.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def validate_concepts(concepts: DataFrame, n_files: Column) -> tuple[DataFrame, DataFrame]:
    """Concepts with all fields and valid file indices (distinct, sorted), and the rejected with the reason."""
    indices = F.transform("file_indices", index_of)
    bad = F.exists(indices, lambda i: i.isNull() | (i < 0) | (i >= n_files))
    reason = (
        F.when(F.col("name").isNull() | F.col("description").isNull() | F.col("file_indices").isNull(), "missing keys")
        .when(bad, "invalid file index")
    )
    marked = concepts.withColumn("reason", reason).withColumn("files", F.array_sort(F.array_distinct(indices)))
    ok = marked.where(F.col("reason").isNull()).drop("reason", "file_indices")
    return ok, marked.where(F.col("reason").isNotNull()).drop("files")


def validate_relations(relations: DataFrame, concepts: DataFrame, by: str = "project_id") -> tuple[DataFrame, DataFrame]:
    """Relations whose ends are concepts of the project, and the rejected with the reason.

    ``relations(project_id, from, to, label)`` with ends as indices or
    ``'index # name'``; ``concepts(project_id, idx)``.
    """
    known = concepts.select(by, "idx")
    parsed = relations.withColumn("src", index_of(F.col("from"))).withColumn("dst", index_of(F.col("to")))
    flagged = (
        parsed.join(known.select(by, F.col("idx").alias("src"), F.lit(True).alias("__src")), [by, "src"], "left")
        .join(known.select(by, F.col("idx").alias("dst"), F.lit(True).alias("__dst")), [by, "dst"], "left")
    )
    reason = (
        F.when(F.col("from").isNull() | F.col("to").isNull() | F.col("label").isNull(), "missing keys")
        .when(F.col("__src").isNull() | F.col("__dst").isNull(), "invalid index")
    )
    marked = flagged.withColumn("reason", reason).drop("__src", "__dst")
    columns = [by, "src", "dst", "label"]
    return marked.where(F.col("reason").isNull()).select(*columns), marked.where(F.col("reason").isNotNull())


def uncovered_concepts(concepts: DataFrame, relations: DataFrame, by: str = "project_id") -> DataFrame:
    """Concepts that no relation touches."""
    ends = relations.select(by, F.explode(F.array("src", "dst")).alias("idx")).distinct()
    return concepts.join(ends, [by, "idx"], "left_anti")


def validate_order(order: DataFrame, concepts: DataFrame, by: str = "project_id") -> DataFrame:
    """What keeps an order from being a permutation of its project's concepts: repeated, unknown, missing."""
    known = concepts.select(by, "idx")
    listed = order.groupBy(by, "idx").agg(F.count(F.lit(1)).alias("n"))
    repeated = listed.where("n > 1").select(by, "idx", F.lit("repeated").alias("violation"))
    unknown = listed.join(known, [by, "idx"], "left_anti").select(by, "idx", F.lit("unknown").alias("violation"))
    missing = known.join(listed, [by, "idx"], "left_anti").select(by, "idx", F.lit("missing").alias("violation"))
    return repeated.union(unknown).union(missing)


def file_name(place: Column, name: Column) -> Column:
    digits = place.cast("string")
    return F.concat(F.lpad(digits, F.greatest(F.lit(2), F.length(digits)), F.lit("0")), F.lit("_"), paths.slug(name), F.lit(".md"))


def chapter_plan(order: DataFrame, concepts: DataFrame, by: str = "project_id") -> DataFrame:
    """Numbered chapters with file name, listing line, and the chapters before and after.

    ``order(project_id, pos, idx)`` with pos from 1; neighbours are joined on
    the position, so a long order is not one window.
    """
    named = order.join(concepts.select(by, "idx", "name"), [by, "idx"])
    chapter = named.select(by, "pos", "idx", "name", file_name(F.col("pos"), F.col("name")).alias("filename"))
    beside = lambda step, label: chapter.select(by, (F.col("pos") + step).alias("pos"), F.col("filename").alias(label))
    line = F.concat(F.col("pos").cast("string"), F.lit(". ["), "name", F.lit("]("), "filename", F.lit(")"))
    return (
        chapter.withColumn("listing", line).join(beside(1, "previous"), [by, "pos"], "left").join(beside(-1, "next"), [by, "pos"], "left")
    )


def diagram_lines(concepts: DataFrame, relations: DataFrame, by: str = "project_id") -> DataFrame:
    """Flowchart lines: concepts by index, then relations by ``rel_no``."""
    no_quotes = lambda c: F.replace(c, F.lit('"'), F.lit(""))
    node = F.format_string('    A%d["%s"]', "idx", no_quotes(F.col("name")))
    label = F.replace(no_quotes(F.col("label")), F.lit("\n"), F.lit(" "))
    label = text.shorten(label, 30, 27)
    edge = F.format_string('    A%d -- "%s" --> A%d', "src", label, "dst")
    nodes = concepts.select(by, F.lit(0).alias("part"), F.col("idx").cast("bigint").alias("place"), node.alias("line"))
    return nodes.union(relations.select(by, F.lit(1).alias("part"), F.col("rel_no").cast("bigint").alias("place"), edge.alias("line")))


def index_lines(projects: DataFrame, plan: DataFrame, diagram: DataFrame, content: DataFrame, by: str = "project_id") -> DataFrame:
    """Lines of each project's index page, ordered by (part, place).

    ``projects(project_id, name, summary, repo_url)``; chapters without content
    are left out.
    """
    blank = F.lit("")
    source = F.concat(F.lit("**Source Repository:** ["), "repo_url", F.lit("]("), "repo_url", F.lit(")"))
    parts = {
        0: [F.concat(F.lit("# Tutorial: "), "name"), blank, F.col("summary"), blank, source, blank, F.lit("```mermaid"), F.lit("flowchart TD")],
        3: [F.lit("```"), blank, F.lit("## Chapters"), blank],
    }
    rows = [
        F.struct(F.lit(part).alias("part"), F.lit(place).cast("bigint").alias("place"), line.alias("line"))
        for part, lines in parts.items() for place, line in enumerate(lines)
    ]
    heads = projects.select(by, F.inline(F.array(*rows)))
    body = diagram.select(by, (F.col("part") + 1).alias("part"), "place", "line")
    written = plan.join(content.select(by, "pos"), [by, "pos"], "left_semi")
    chapters = written.select(by, F.lit(4).alias("part"), F.col("pos").cast("bigint").alias("place"), F.col("listing").alias("line"))
    return heads.union(body).union(chapters)


def estimate_tokens(df: DataFrame, column: str, budget: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their token estimate: within the budget, and over it."""
    counted = df.withColumn("tokens", text.estimate_tokens(F.col(column)))
    return counted.where(F.col("tokens") <= budget), counted.where(F.col("tokens") > budget)


def cache_key(provider: Column, prompt: Column) -> Column:
    return F.concat(provider, F.lit(":"), prompt)


def cache_split(prompts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answered prompts with their cached response, and the distinct ones still to ask.

    Prompts join the cache on a digest of the key, not on the whole text.
    """
    keyed = prompts.withColumn("key", F.md5(cache_key(F.col("provider"), F.col("prompt"))))
    stored = cache.select(F.md5("key").alias("key"), "response")
    hits = keyed.join(stored, "key")
    todo = keyed.join(stored.select("key"), "key", "left_anti").dropDuplicates(["key"])
    return hits, todo


def cache_insert(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with new answers added; a repeated key takes the new answer."""
    fresh = answers.select(cache_key(F.col("provider"), F.col("prompt")).alias("key"), "response")
    return cache.join(fresh.select("key"), "key", "left_anti").select("key", "response").union(fresh)


def repair_heading(number: Column, name: Column, content: Column) -> Column:
    """The chapter text with ``# Chapter n: name`` as its first line.

    A text starting with ``# Chapter n`` stays; another heading is replaced; without one it is put in front.
    """
    wanted = F.concat(F.lit("# Chapter "), number.cast("string"), F.lit(": "), name)
    body = text.squeeze_ends(content)
    first = F.substring_index(body, "\n", 1)
    rest = F.substr(body, F.length(first) + 1)
    return (
        F.when(F.startswith(body, F.concat(F.lit("# Chapter "), number.cast("string"))), content)
        .when(F.startswith(F.ltrim(first), F.lit("#")), F.concat(wanted, rest))
        .otherwise(F.concat(wanted, F.lit("\n\n"), content))
    )


def project_label(url: Column, folder: Column) -> Column:
    """Last part of the repository address without ``.git``, else of the folder."""
    from_url = F.regexp_extract(F.regexp_replace(F.rtrim(url, F.lit("/")), r"\.git$", ""), r"([^/]+)$", 1)
    from_folder = F.regexp_extract(F.rtrim(folder, F.lit("/")), r"([^/]+)$", 1)
    return F.when(F.coalesce(url, F.lit("")) != "", from_url).otherwise(from_folder)
