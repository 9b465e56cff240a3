"""Entities out of source text.

Every operator here is row-local: one file row in, its entity rows out, with no
shuffle.  Lines, indents and bodies are array expressions; only the nesting of
indents runs in an Arrow batch function over integer arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.functions import paths, text
from codequarry.functions.ranking import first_per_key, positions

BLANKS = " \t\r\x0b\x0c"

NAME = text.WORD + "+"
FUNCTION_HEAD = rf"^(async\s+)?def\s+({NAME})\s*\((.*?)\)\s*(?:->[^:]+)?:"
STRICT_FUNCTION_HEAD = rf"^(async\s+)?def\s+({NAME})\s*\((.*?)\):"
CLASS_HEAD = rf"^class\s+({NAME})(?:\(([^)]*)\))?:"
IMPORT_HEAD = r"^(?:from|import) "
IMPORT_START = f"^[{BLANKS}]*(?:from|import) "
FROM_IMPORT = r"^from\s+([\p{L}\p{N}_.]+)\s+import\s+(.+)"
STRING_START = f"^[{BLANKS}]*[rRuUbBfF]{{0,2}}[\"']"
STRING_BODY = (
    r"(?s)^[rRuUbBfF]{0,2}("
    r'"""(.*?)"""'
    r"|'''(.*?)'''"
    r'|"([^"\n]*)"'
    r"|'([^'\n]*)')"
)


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(BLANKS))


INTS = T.ArrayType(T.IntegerType())


def _next_smaller(values: np.ndarray) -> np.ndarray:
    """For each position the next one with a smaller value, or the size; all at once.

    A pointer jumps to where the position it points at points.  What lies under such jumps has falling values, so there are
    about as many rounds as a block is nested deep.
    """
    size = len(values)
    ahead = np.arange(1, size + 1)
    below = np.append(values, values.min(initial=0) - 1)  # the end is smaller than all
    going = np.flatnonzero(below[ahead] >= values)
    while len(going):
        ahead[going] = ahead[ahead[going]]
        going = going[below[ahead[going]] >= values[going]]
    return ahead


@F.arrow_udf(T.StructType().add("ends", INTS).add("openers", INTS))
def block_spans(indents: pa.Array) -> pa.Array:
    """Last line of the block each line starts, and the line that opens its surrounding block.

    A block ends at the last non-blank line before the next one that is not
    indented deeper.  Blank lines carry indent -1 and get 0.
    """
    offsets = indents.offsets.to_numpy().astype(np.int64)
    values = indents.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
    offsets = offsets - offsets[0]
    file = np.repeat(np.arange(len(indents)), np.diff(offsets))
    at = np.flatnonzero(values >= 0)
    # the non-blank lines of all files, each file closed by a border that is indented less than any line
    line = at - offsets[file[at]] + 1
    borders = np.searchsorted(file[at], np.arange(len(indents)), side="right")
    indent, number = np.insert(values[at], borders, -1), np.insert(line, borders, 0)
    real = number > 0
    smaller = _next_smaller(indent)
    same = np.full(len(indent), len(indent))
    order = np.argsort(indent, kind="stable")
    equal = indent[order[1:]] == indent[order[:-1]]
    same[order[:-1][equal]] = order[1:][equal]
    after = np.minimum(smaller, same)[real]
    opener = len(indent) - 1 - _next_smaller(indent[::-1])[::-1][real]
    ends, openers = np.zeros(len(values), np.int32), np.zeros(len(values), np.int32)
    ends[at] = number[after - 1]
    openers[at] = np.where(opener >= 0, number[opener], 0)
    lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)) for flat in (ends, openers)]
    return pa.StructArray.from_arrays(lists, ["ends", "openers"])


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per line, numbered from 1."""
    keep = [c for c in files.columns if c != content]
    exploded = files.select(*keep, F.posexplode(text.split_lines(F.col(content))).alias("line_no", "line"))
    return exploded.withColumn("line_no", F.col("line_no") + 1)


def content_for(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Numbered text of the files whose ``idx`` is wanted, labelled ``'idx # path'``."""
    picked = files.join(wanted.select("idx"), "idx", "left_semi")
    label = F.concat(F.col("idx").cast("string"), F.lit(" # "), F.col("path"))
    return picked.select("idx", label.alias("label"), text.number_lines(F.col("content")).alias("numbered"))


def parameter_names(signature: Column, bare_only: bool = False) -> Column:
    """Names from a parameter list; ``bare_only`` keeps undecorated identifiers."""
    parts = F.split(signature, ",")
    if bare_only:
        return F.filter(F.transform(parts, strip), lambda p: p.rlike(f"^{NAME}$"))
    plain = F.transform(parts, lambda p: strip(F.split_part(strip(p), F.lit(":"), F.lit(1))))
    named = F.filter(plain, lambda p: p != "")
    return F.transform(named, lambda p: strip(F.split_part(p, F.lit("="), F.lit(1))))


def base_names(bases: Column, bare_only: bool = False) -> Column:
    names = F.filter(F.transform(F.split(bases, ","), strip), lambda b: b != "")
    return F.filter(names, lambda b: b.rlike(f"^{NAME}$")) if bare_only else names


def _left(line: Column) -> Column:
    """The line from its first non-blank character; cheaper than ``strip`` where the right end does not matter."""
    return F.ltrim(line, F.lit(BLANKS))


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(_left(line))


def _block(body_lines: Column) -> Column:
    """The lines of a block at or below its own indent, without the head: struct of lines and indent."""
    inner = F.slice(body_lines, F.lit(2), F.greatest(F.size(body_lines) - 1, F.lit(0)))
    first = lambda rest: F.get(F.filter(rest, lambda x: _left(x) != ""), F.lit(0))
    return text.let(inner, lambda rest: F.struct(rest.alias("lines"), text.let(first(rest), _indent).alias("indent")))


def docstring(body_lines: Column, most: int | None = 200) -> Column:
    """First statement at block level that is a string: quotes off, at most ``most`` characters (None: all)."""

    def read(block: Column) -> Column:
        starts = F.transform(block["lines"], lambda x: x.rlike(STRING_START) & (_indent(x) == block["indent"]))
        return text.let(F.array_position(starts, True).cast("int"), lambda first: F.when(first > 0, literal(block, first)))

    def literal(block: Column, first: Column) -> Column:
        rest = F.array_join(F.slice(block["lines"], F.greatest(first, F.lit(1)), F.greatest(F.size(block["lines"]) - first + 1, F.lit(0))), "\n")
        return F.regexp_extract(F.ltrim(rest, F.lit(BLANKS)), STRING_BODY, 1)

    def unquoted(found: Column) -> Column:
        bare = F.trim(found, F.lit("'\""))
        return F.when(found != "", bare if most is None else F.substring(bare, 1, most))

    return text.let(text.let(_block(body_lines), read), unquoted)


def _outline(files: DataFrame, spans: bool = True) -> DataFrame:
    """Adds lines, the same without their indents, the indents (-1 for blank) and, if asked, block spans."""
    split = files.withColumn("lines", F.split("content", "\n"))
    cut = split.withColumn("lefts", F.transform("lines", _left))
    indent = lambda x, left: F.when(left == "", -1).otherwise(F.length(x) - F.length(left))
    marked = cut.withColumn("indents", F.zip_with("lines", "lefts", indent))
    return marked.withColumn("spans", block_spans("indents")) if spans else marked


FUNCTION_STARTS = ["def", "async"]
CLASS_STARTS = ["class"]
# Columns read off a head alone; all others take its block.
HEAD_COLUMNS = {
    "repo_id", "idx", "id", "node_type", "name", "qualified_name", "file_path", "line_start", "column_start", "language",
    "parameters", "is_async", "is_method", "base_classes",
}


def _heads(files: DataFrame, pattern: str, starts: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per line whose stripped text matches, with extent and body lines.

    Lines not beginning with one of ``starts`` are passed over before the
    regular expression runs; only heads are described and given their body.
    Spark prunes no columns within a generator, so where the ``columns`` wanted
    are all in ``HEAD_COLUMNS``, blocks are not looked for and NULL.
    """
    blocks = columns is None or not HEAD_COLUMNS.issuperset(columns)
    outline = _outline(files, blocks)

    def is_head(line: Column) -> Column:
        begins = F.lit(False)
        for start in starts:
            begins = begins | F.startswith(line, F.lit(start))
        return begins & line.rlike(pattern)

    numbers = F.transform("lefts", lambda x, i: F.when(is_head(x), i + 1))

    def described(n: Column) -> Column:
        at = lambda array: F.element_at(F.col(array), n)
        end = at("spans.ends") if blocks else F.lit(None).cast("int")
        opener = at("spans.openers") if blocks else F.lit(None).cast("int")
        body = F.slice(F.col("lines"), n, end - n + 1) if blocks else F.lit(None).cast("array<string>")
        return F.struct(
            n.alias("line_start"), end.alias("line_end"), at("indents").alias("indent"), opener.alias("opener"),
            strip(at("lines")).alias("head"), body.alias("body"),
        )

    keep = [c for c in files.columns if c not in ("content", "size")]
    return outline.select(*keep, F.inline(F.transform(F.array_compact(numbers), described)))


def _repo(per_repo: bool) -> Column | None:
    """What tells ids of equal places in several repositories apart."""
    return F.col("repo_id") if per_repo else None


def _entity(heads: DataFrame, name: Column, node_type: str) -> DataFrame:
    """Identity and extent columns shared by all entity kinds."""
    node = F.ltrim(F.array_join("body", "\n"), F.lit(BLANKS))
    return (
        heads.withColumn("node_type", F.lit(node_type))
        .withColumn("name", name)
        .withColumn("file_path", F.col("path"))
        .withColumn("column_start", F.col("indent") + 1)
        .withColumn("column_end", F.length(F.element_at("body", -1)) + 1)
        .withColumn("text", node)
        .withColumn("language", F.lit("python"))
    )


def extract_functions(files: DataFrame, annotated: bool = True, per_repo: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Function rows; ``annotated=False`` leaves out heads with a return annotation, ``per_repo`` makes ``repo_id`` part of the ids.

    Only ``columns``, if given; blocks are then looked for where one of them needs them.
    """
    pattern = FUNCTION_HEAD if annotated else STRICT_FUNCTION_HEAD
    heads = _heads(files, pattern, FUNCTION_STARTS, columns)
    group = lambda i: F.regexp_extract("head", pattern, i)
    named = _entity(heads, group(2), "function").withColumn("parameters", parameter_names(group(3)))
    rows = named.select(
        *[c for c in files.columns if c in ("repo_id", "idx")],
        paths.entity_id(F.col("path"), F.col("name"), F.col("line_start"), _repo(per_repo)).alias("id"),
        "node_type", "name",
        paths.qualified_name(F.col("path"), F.col("name")).alias("qualified_name"),
        "file_path", "line_start", "line_end", "column_start", "column_end", "opener", "language",
        F.col("text").alias("content"),
        "parameters",
        text.called_names(F.col("text"), F.col("name")).alias("calls"),
        text.complexity(F.col("text")).alias("complexity"),
        F.startswith("head", F.lit("async")).alias("is_async"),
        F.array_contains("parameters", "self").alias("is_method"),
        docstring(F.col("body"), None).alias("docstring"),
    )
    return rows if columns is None else rows.select(*columns)


def extract_classes(files: DataFrame, per_repo: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Class rows with base names and the names of the methods directly inside; only ``columns``, if given."""
    heads = _heads(files, CLASS_HEAD, CLASS_STARTS, columns)
    named = _entity(heads, F.regexp_extract("head", CLASS_HEAD, 1), "class")
    bases = F.regexp_extract("head", CLASS_HEAD, 2)
    rows = named.select(
        *[c for c in files.columns if c in ("repo_id", "idx")],
        paths.entity_id(F.col("path"), F.col("name"), F.col("line_start"), _repo(per_repo)).alias("id"),
        "node_type", "name",
        paths.qualified_name(F.col("path"), F.col("name")).alias("qualified_name"),
        "file_path", "line_start", "line_end", "column_start", "column_end", "language",
        F.col("text").alias("content"),
        base_names(bases).alias("base_classes"),
        class_members(F.col("body")).alias("methods"),
        docstring(F.col("body"), None).alias("docstring"),
    )
    return rows if columns is None else rows.select(*columns)


def class_members(body_lines: Column) -> Column:
    """Names of the functions at the block's own indent, in order."""

    def read(block: Column) -> Column:
        begins = lambda x: F.startswith(x, F.lit("def")) | F.startswith(x, F.lit("async"))
        defs = F.filter(block["lines"], lambda x: begins(_left(x)) & (_indent(x) == block["indent"]) & strip(x).rlike(FUNCTION_HEAD))
        return F.transform(defs, lambda x: F.regexp_extract(strip(x), FUNCTION_HEAD, 2))

    return text.let(_block(body_lines), read)


def import_type(statement: Column) -> Column:
    return (
        F.when(statement.rlike(FROM_IMPORT), "from_import")
        .when(F.startswith(statement, F.lit("import ")), "import")
        .otherwise("unknown")
    )


def import_items(statement: Column) -> Column:
    """Imported items, aliases kept as written; empty for an unknown form."""
    listed = (
        F.when(statement.rlike(FROM_IMPORT), F.regexp_extract(statement, FROM_IMPORT, 2))
        .when(F.startswith(statement, F.lit("import ")), F.substr(statement, F.lit(8)))
    )
    return F.coalesce(F.transform(F.split(listed, ","), strip), F.array().cast("array<string>"))


def import_module(statement: Column) -> Column:
    return (
        F.when(statement.rlike(FROM_IMPORT), F.regexp_extract(statement, FROM_IMPORT, 1))
        .when(F.startswith(statement, F.lit("import ")), F.element_at(import_items(statement), 1))
        .otherwise("unknown")
    )


def extract_imports(files: DataFrame, per_repo: bool = False) -> DataFrame:
    """Import rows; a parenthesised list is read to its closing line."""
    listed = files.withColumn("lines", F.split("content", "\n"))
    closing = F.transform("lines", lambda x: F.contains(x, F.lit(")")))
    described = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_start"), x.alias("line")))
    heads = F.filter(described, lambda h: h["line"].rlike(IMPORT_START) & strip(h["line"]).rlike(IMPORT_HEAD))
    rest = F.size("lines") + 1

    def statement(h):
        is_open = F.contains(h["line"], F.lit("(")) & ~F.contains(h["line"], F.lit(")"))
        span = F.array_position(F.slice(F.col("closing"), h["line_start"], rest - h["line_start"]), True).cast("int")
        span = F.when(is_open & (span > 0), span).otherwise(1)
        joined = F.array_join(F.transform(F.slice(F.col("lines"), h["line_start"], span), strip), " ")
        clean = F.regexp_replace(F.translate(joined, "()\\", ""), r",?\s*$", "")
        return F.struct(
            h["line_start"].alias("line_start"), (h["line_start"] + span - 1).alias("line_end"),
            (F.length(h["line"]) - F.length(F.ltrim(h["line"], F.lit(BLANKS))) + 1).alias("column_start"),
            F.when(is_open, clean).otherwise(strip(h["line"])).alias("content"),
        )

    keep = [c for c in files.columns if c not in ("content", "size")]
    rows = listed.withColumn("closing", closing).select(*keep, F.inline(F.transform(heads, statement)))
    line_name = F.concat(F.lit("import_"), F.col("line_start").cast("string"))
    return rows.select(
        *[c for c in files.columns if c in ("repo_id", "idx")],
        paths.entity_id(F.col("path"), line_name, F.col("line_start"), _repo(per_repo)).alias("id"),
        F.lit("import").alias("node_type"),
        import_module(F.col("content")).alias("name"),
        F.col("path").alias("file_path"), "line_start", "line_end", "column_start",
        F.lit("python").alias("language"), "content",
        import_module(F.col("content")).alias("module"),
        import_items(F.col("content")).alias("imports"),
        import_type(F.col("content")).alias("import_type"),
    )


def block_extents(files: DataFrame) -> DataFrame:
    """Extent of every function and class block."""
    heads = _heads(files, f"{FUNCTION_HEAD}|{CLASS_HEAD}", FUNCTION_STARTS + CLASS_STARTS)
    return heads.select(
        "path", "head", "line_start", "line_end", (F.col("indent") + 1).alias("column_start"),
        (F.length(F.element_at("body", -1)) + 1).alias("column_end"),
    )


def file_dim(nodes: DataFrame, order: list[str]) -> DataFrame:
    """One row per file path, described by its first node in ``order``."""
    first = first_per_key(
        nodes.where(F.coalesce(F.col("file_path"), F.lit("")) != "").select("file_path", "repo_url", "github_url", *order),
        ["file_path"], order,
    )
    path = F.col("file_path")
    return first.select(
        path.alias("path"), paths.base_name(path).alias("name"), paths.extension(path).alias("extension"),
        paths.directory(path).alias("directory"), F.coalesce("repo_url", F.lit("")).alias("repo_url"),
        paths.file_url(F.col("repo_url"), paths.url_branch(F.col("github_url")), path).alias("github_url"),
    )


def extraction_stats(nodes: DataFrame) -> DataFrame:
    """Files, nodes and entity counts, plus rows without a name, in one pass."""
    of = lambda kind: F.count_if(F.col("node_type") == kind)
    return nodes.agg(
        F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("nodes"),
        of("function").alias("functions"), of("class").alias("classes"), of("import").alias("imports"),
        F.count_if(F.coalesce(F.col("name"), F.lit("")) == "").alias("errors"),
    )


def embedding_text(nodes: DataFrame) -> Column:
    """The text a node is embedded by; absent parts are left out."""
    has = set(nodes.columns)
    blank = F.lit("")

    def labelled(label, column, is_list=False):
        if column not in has:
            return F.lit(None).cast("string")
        value = F.array_join(column, ", ") if is_list else F.col(column)
        return F.when(F.coalesce(value, blank) != "", F.concat(F.lit(label), value))

    segments = F.filter(F.split(F.translate("file_path", "\\", "/"), "/"), lambda p: (p != "") & ~F.startswith(p, F.lit(".")))
    kept = F.least(F.size(segments), F.lit(2))
    near = F.array_join(F.slice(segments, F.greatest(F.size(segments) - kept + 1, F.lit(1)), kept), "/")
    return F.concat_ws(
        " | ",
        F.concat(F.coalesce("node_type", blank), F.lit(" "), F.coalesce("name", blank)),
        labelled("purpose: ", "purpose"), labelled("domain: ", "domain"),
        labelled("technologies: ", "technologies", True), labelled("operations: ", "operations", True),
        labelled("", "docstring"), labelled("parameters: ", "parameters", True),
        F.when(F.coalesce("content", blank) != "", F.col("content")),
        F.when(F.coalesce("file_path", blank) != "", F.concat(F.lit("file: "), near)),
    )


def split_text(text: Column, most: int) -> Column:
    """The text in parts of at most ``most`` characters that concatenate to it.

    A part ends after the last line end that it can hold; a longer line is cut.  Empty texts are one empty part.
    """
    parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{most}}}\z|.{{0,{most - 1}}}\n|.{{1,{most}}}"), F.lit(0))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(parts)


def assign_batches(df: DataFrame, order: list[str], size: int = 100, by: list[str] = [], most: int = 8000) -> DataFrame:
    """Request batches of ``size`` texts in ``order``; texts of more than ``most`` characters are several requests.

    Adds ``part`` (from 0), ``start`` (of the part in the text, in characters) and ``batch``.
    """
    parts = df.withColumn("__parts", split_text(F.coalesce("text", F.lit("")), most))
    before = F.transform("__parts", lambda _, i: F.aggregate(F.slice("__parts", F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p)))
    parts = parts.withColumn("__parts", F.arrays_zip(before.alias("start"), F.col("__parts").alias("text")))
    rows = parts.select(*[c for c in df.columns if c != "text"], F.posexplode("__parts").alias("part", "__p"))
    rows = rows.withColumns({"part": F.col("part").cast("bigint"), "start": F.col("__p.start").cast("bigint"), "text": F.col("__p.text")}).drop("__p")
    numbered = positions(rows, by, [*order, "part"], "__position")
    return numbered.withColumn("batch", F.floor((F.col("__position") - 1) / size)).drop("__position")


def join_parts(parts: DataFrame, by: list[str], size: str, embedding: str = "embedding") -> DataFrame:
    """One vector per key: the mean of its parts' vectors, weighted by ``size``; summed before the shuffle, component by component."""
    rows = parts.select(*by, F.col(size).alias("__size"), F.posexplode(embedding).alias("__k", "__c"))
    weighed = rows.groupBy(*by, "__k").agg((F.sum(F.col("__c").cast("double") * F.col("__size")) / F.sum("__size")).alias("__c"))
    components = F.sort_array(F.collect_list(F.struct("__k", "__c")))
    return weighed.groupBy(*by).agg(F.transform(components, lambda x: x["__c"]).alias(embedding))


def embedding_coverage(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("nodes"), F.count(column).alias("embedded"))
