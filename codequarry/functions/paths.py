"""Expressions over file paths, links and names."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.text import title_case


def glob_regex(patterns: list[str]) -> str:
    """One anchored alternation for shell globs; '*' also crosses '/'."""
    return "^(?:" + "|".join(fnmatch.translate(p) for p in sorted(patterns)) + ")$"


def matches_glob(path: Column, patterns: list[str]) -> Column:
    return path.rlike(glob_regex(patterns)) if patterns else F.lit(False)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Everything before the last '/', '' when there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    """Text after the last '.' of the path, '' when there is none."""
    return F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1)).otherwise("")


def suffix(path: Column) -> Column:
    """Lower-case suffix of the file name with its dot; '' for none or a leading dot only."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    """File name up to its first '.'."""
    return F.substring_index(base_name(path), ".", 1)


def entity_id(path: Column, name: Column, line: Column, repo: Column | None = None) -> Column:
    """First 16 hex digits of the MD5 of ``path:name:line``, of ``repo:path:name:line`` where a repository is given."""
    within = [] if repo is None else [repo.cast("string")]
    return F.substring(F.md5(F.concat_ws(":", *within, path, name, line.cast("string"))), 1, 16)


def module_path(path: Column) -> Column:
    """Dotted form of a path; every '.py' goes, wherever it stands."""
    dotted = F.replace(F.replace(path, F.lit("/"), F.lit(".")), F.lit("\\"), F.lit("."))
    return F.replace(dotted, F.lit(".py"), F.lit(""))


def qualified_name(path: Column, name: Column) -> Column:
    return F.concat(module_path(path), F.lit("."), name)


def repo_root(repo: Column) -> Column:
    return F.regexp_replace(repo, r"\.git$", "")


def source_url(repo: Column, branch: Column, path: Column, l1: Column, l2: Column, c1: Column, c2: Column) -> Column:
    """Link to a line and column range; '' unless an http address on the supported host."""
    text = lambda c: c.cast("string")
    link = F.concat(
        repo_root(repo), F.lit("/blob/"), branch, F.lit("/"), path,
        F.lit("#L"), text(l1), F.lit("C"), text(c1), F.lit("-L"), text(l2), F.lit("C"), text(c2),
    )
    usable = F.startswith(repo, F.lit("http")) & F.contains(repo, F.lit("github.com"))
    return F.when(F.coalesce(usable, F.lit(False)), link).otherwise("")


def file_url(repo: Column, branch: Column, path: Column) -> Column:
    return F.when(F.coalesce(repo, F.lit("")) == "", "").otherwise(
        F.concat(repo_root(repo), F.lit("/blob/"), branch, F.lit("/"), path)
    )


def url_branch(url: Column) -> Column:
    """Branch named after '/blob/', 'main' when there is none."""
    found = F.regexp_extract(url, r"/blob/([^/]+)", 1)
    return F.when(F.coalesce(found, F.lit("")) == "", "main").otherwise(found)


def title_from_url(url: Column) -> Column:
    """Last path segment, '-' and '_' as blanks, in title case."""
    last = F.substring_index(F.trim(url, F.lit("/")), "/", -1)
    return title_case(F.translate(last, "-_", "  "))


def _without_dots(path: Column) -> Column:
    """A rooted path with its '.' and '..' segments resolved; the root has no parent."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda stack, part: F.when(part == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(1))))
        .when(part == ".", stack).otherwise(F.concat(stack, F.array(part))),
    )
    return F.concat(F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))


def absolute_link(base: Column, href: Column) -> Column:
    """``href`` seen from page ``base``: full, protocol-relative, rooted, relative, only a query or only a fragment."""
    protocol = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"(?s)#.*$", "")
    file = F.regexp_replace(base, r"(?s)[?#].*$", "")
    folder = F.regexp_extract(file, r"^[^:]+://[^/]*(/.*/|/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    named = F.regexp_replace(href, r"(?s)[?#].*$", "")
    rooted = F.when(F.startswith(named, F.lit("/")), named).otherwise(F.concat(folder, named))
    path = F.when(rooted.rlike(r"/\.\.?(/|$)"), _without_dots(rooted)).otherwise(rooted)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(protocol, F.lit(":"), href))
        .when((href == "") | F.startswith(href, F.lit("#")), F.concat(page, href))
        .when(F.startswith(href, F.lit("?")), F.concat(file, href))
        .otherwise(F.concat(origin, path, F.regexp_extract(href, r"(?s)[?#].*$", 0)))
    )


def stable_bucket(text: Column, buckets: int) -> Column:
    """A number below ``buckets`` that is the same in every run."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets


def safe_file_name(title: Column, url: Column) -> Column:
    """Letters, digits, blank, '-' and '_' of the title, at most 50, plus a stable number."""
    kept = F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "")
    return F.concat(F.substring(F.rtrim(kept), 1, 50), F.lit("_"), stable_bucket(url, 10000).cast("string"), F.lit(".md"))


def slug(name: Column) -> Column:
    """Every character that is no letter or number as '_', lower-case."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", "_"))
