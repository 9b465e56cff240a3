"""Source trees as tables of files, and the rules that select from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import paths

# Folders never descended into, and the default size limits in bytes.
PRUNED_NAMES = ["__pycache__", "node_modules", ".git"]
MAX_BYTES = 100_000
# Default selection of source files.
DEFAULT_INCLUDE = [
    "*.py", "*.js", "*.jsx", "*.ts", "*.tsx", "*.go", "*.java", "*.pyi", "*.pyx", "*.c", "*.cc", "*.cpp", "*.h", "*.md", "*.rst",
    "*Dockerfile", "*Makefile", "*.yaml", "*.yml",
]
DEFAULT_EXCLUDE = [
    "assets/*", "data/*", "images/*", "public/*", "static/*", "temp/*", "*docs/*", "*venv/*", "*.venv/*", "*test*", "*tests/*",
    "*examples/*", "v1/*", "*dist/*", "*build/*", "*experimental/*", "*deprecated/*", "*misc/*", "*legacy/*", ".git/*", ".github/*",
    ".next/*", ".vscode/*", "*obj/*", "*bin/*", "*node_modules/*", "*.log",
]
MAX_BYTES_REMOTE = 1_000_000


def scan_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below ``root``: relative path, text and size; files that are not UTF-8 are left out.

    Path and size come from the listing alone, so a filter on them runs before
    any content is read.
    """
    return _scanned(spark, root, pattern).where(F.col("content").isNotNull())


def unreadable_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path, size and reason of the files that ``scan_files`` leaves out."""
    rejected = _scanned(spark, root, pattern).where(F.col("content").isNull())
    return rejected.select("path", "size", F.lit("not UTF-8").alias("reason"))


def _scanned(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    )
    prefix = root.rstrip("/") + "/"
    start = F.locate(prefix, F.col("path")) + len(prefix)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return raw.select(
        F.substr("path", start).alias("path"), F.regexp_replace(text, "^\\x{feff}", "").alias("content"), F.col("length").alias("size")
    )


def glob_filter(df: DataFrame, include: list[str], exclude: list[str], mode: str = "local", path: str = "path") -> DataFrame:
    """Keep included and drop excluded files.

    ``local`` matches includes on the relative path, ``remote`` on the file
    name; excludes always match the path.  No includes means all files.
    """
    column = F.col(path)
    subject = paths.base_name(column) if mode == "remote" else column
    kept = df.where(paths.matches_glob(subject, include)) if include else df
    return kept.where(~paths.matches_glob(column, exclude)) if exclude else kept


def prune_dirs(df: DataFrame, names: list[str] = PRUNED_NAMES, patterns: list[str] = [], path: str = "path") -> DataFrame:
    """Drop files below hidden or named folders, or folders matching a pattern by path or by name."""
    folders = F.filter(F.split(paths.directory(F.col(path)), "/"), lambda d: d != "")
    hidden = F.exists(folders, lambda d: F.startswith(d, F.lit(".")) | d.isin(names))
    kept = df.where(~hidden)
    if patterns:
        matched = F.exists(
            F.transform(folders, lambda d, i: F.struct(d.alias("name"), F.array_join(F.slice(folders, F.lit(1), i + 1), "/").alias("dir"))),
            lambda d: paths.matches_glob(d["name"], patterns) | paths.matches_glob(d["dir"], patterns),
        )
        kept = kept.where(~matched)
    return kept


def size_filter(df: DataFrame, max_bytes: int = MAX_BYTES, by: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """Files up to ``max_bytes``, and how many were kept and skipped."""
    fits = F.col("size") <= max_bytes
    stats = df.groupBy(*by).agg(
        F.count_if(fits).alias("downloaded"), F.count_if(~fits).alias("skipped"),
        F.coalesce(F.sum(F.when(~fits, F.col("size"))), F.lit(0)).alias("skipped_bytes"),
    )
    return df.where(fits), stats
