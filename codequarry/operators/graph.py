"""Questions asked of the code graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.functions.ranking import positions, top_n
from codequarry.operators import search
from codequarry.operators.edges import repo_of
from codequarry.session import materialize, shuffled


def complex_functions(functions: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` functions of highest complexity."""
    known = functions.where(F.col("complexity").isNotNull())
    return known.select("name", "complexity", "file_path", "github_url", "id").orderBy(F.desc("complexity"), "id").limit(n)


def callers_of(sites: DataFrame, functions: DataFrame, name: str) -> DataFrame:
    """Callers of every function called ``name``, with the number of call edges each stands for."""
    at = sites.where(F.col("called_name") == name)
    caller = functions.select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"), "file_path", "github_url")
    return at.join(shuffled(caller), "caller_id").select("caller_id", "caller_name", "file_path", "github_url", "type", "n_targets")


def discover(functions: DataFrame, called: DataFrame, name_terms: list[str], name_regex: str,
             path_terms: list[str] = [], content_terms: list[str] = [], call_terms: list[str] = []) -> DataFrame:
    """Functions whose name matches, in a context given by path, content or called names.

    The regular expression must match the whole name.
    """
    by_name = text.contains_any(F.lower("name"), name_terms) | F.col("name").rlike(f"^(?:{name_regex})$")
    named = functions.where(by_name)
    calling = called.where(text.contains_any(F.col("called_name"), call_terms)).select(F.col("caller_id").alias("id")).distinct()
    flagged = named.join(calling.withColumn("__calls", F.lit(True)), "id", "left")
    context = text.contains_any(F.col("file_path"), path_terms) | text.contains_any(F.col("content"), content_terms)
    return flagged.where(context | F.col("__calls").isNotNull()).drop("__calls").orderBy("name", "id")


CARD = ["file_path", "line_start", "id", "name", "github_url", "docstring"]


def _best(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The first candidate per key by path, line and id, as the number ``best`` of its card."""
    return candidates.groupBy(*by).agg(F.min("at").alias("best"))


def go_to_definition(requests: DataFrame, functions: DataFrame, files: DataFrame, membership: DataFrame, imports: DataFrame, targets: DataFrame) -> DataFrame:
    """One definition per request, searched in the file, its imports, the caller's class, anywhere.

    ``requests(request_id[, repo_id], caller_file, caller_function, function_name)``;
    the caller's file must exist; with ``repo_id`` in all tables nothing beyond the caller's repository is found.  Each scope offers one best function per key,
    so a request meets at most one row per scope (and class of the caller).  Definitions are numbered in the order in which
    they are preferred, and all scopes know them by their number: what is shown of one is joined to the request at the end.
    """
    repo = repo_of(requests, functions, files, imports, targets)
    asked = requests.join(shuffled(files.select(*repo, F.col("path").alias("caller_file"))), [*repo, "caller_file"], "left_semi")
    cards = materialize(positions(functions.select(*repo, *CARD).distinct(), [], [*CARD, *repo], "at"), "cards")
    card = cards.select(*repo, "id", "name", "file_path", "at")
    local = _best(card.withColumn("caller_file", F.col("file_path")), [*repo, "caller_file", "name"])
    # the best target per module, then per file importing from it
    meant = _best(targets.select("module", "item", "id").join(shuffled(card), "id").where(F.col("name") == F.col("item")), [*repo, "module", "item"])
    through = imports.select(*repo, F.col("file_path").alias("caller_file"), "module", "item").join(shuffled(meant), [*repo, "module", "item"])
    through = through.groupBy(*repo, "caller_file", F.col("item").alias("name")).agg(F.min("best").alias("best"))
    held = shuffled(membership.select(F.col("function_id").alias("id"), "class_id"))
    methods = _best(card.join(held, "id"), ["class_id", "name"])
    anywhere = _best(card, [*repo, "name"])

    here, triple = [*repo, "caller_file", "name"], [*repo, "caller_file", "caller_function", "name"]
    near = (
        asked.withColumnRenamed("function_name", "name").join(shuffled(local.withColumnRenamed("best", "b1")), here, "left")
        .join(shuffled(through.withColumnRenamed("best", "b2")), here, "left")
    )
    # requests that these answer go no further, so only the rest keep what is searched with
    at = F.coalesce("b1", "b2").alias("at")
    kind = F.when(F.col("b1").isNotNull(), "local").when(F.col("b2").isNotNull(), "imported").alias("resolution_type")
    near = materialize(near.select("request_id", at, kind, *[F.when(F.coalesce("b1", "b2").isNull(), F.col(c)).alias(c) for c in triple]), "near")
    wanted = near.where("at IS NULL").select("request_id", *triple)
    homes = card.join(held, "id").select(
        *repo, F.col("file_path").alias("caller_file"), F.col("name").alias("caller_function"), "class_id"
    ).distinct()
    # each distinct (file, caller name, called name) meets the caller's classes once
    reachable = (
        wanted.select(*triple).distinct().join(shuffled(homes), [*repo, "caller_file", "caller_function"])
        .join(shuffled(methods), ["class_id", "name"]).groupBy(*triple).agg(F.min("best").alias("best"))
    )
    far = (
        wanted.join(shuffled(reachable.withColumnRenamed("best", "b3")), triple, "left")
        .join(shuffled(anywhere.withColumnRenamed("best", "b4")), [*repo, "name"], "left")
    )
    kind = F.when(F.col("b3").isNotNull(), "method").otherwise("global")
    far = far.select("request_id", F.coalesce("b3", "b4").alias("at"), kind.alias("resolution_type"))
    found = near.select(far.columns).union(far).where("at IS NOT NULL")
    return found.join(shuffled(cards.select("at", *CARD)), "at").select(
        "request_id", F.col("name").alias("function_name"), "file_path", F.col("line_start").alias("line_number"),
        F.col("github_url").alias("github_link"), F.col("docstring").alias("documentation"), "resolution_type",
    )


def find_usages(requests: DataFrame, functions: DataFrame, classes: DataFrame, sites: DataFrame, members: DataFrame,
                inherits: DataFrame, resolved: DataFrame, imports: DataFrame) -> DataFrame:
    """Usages of every definition with a requested ``name``.

    Per definition: its callers, else the classes inheriting from it, else the
    imports resolving to it; a definition without any gives one empty usage per
    name.  Whether a definition has a caller is read off its hubs: the lowest
    and highest caller of a hub suffice to see that one is not itself.
    """
    asked = requests.select("name").distinct()
    defs_f = functions.join(asked, "name", "left_semi").select("id", "name")
    defs_c = classes.join(asked, "name", "left_semi").select("id", "name")

    hub = ["scope", "owner", "name"]
    wanted_sites = sites.withColumnRenamed("called_name", "name").join(asked, "name", "left_semi")
    reach = wanted_sites.groupBy(*hub).agg(F.min("caller_id").alias("low"), F.max("caller_id").alias("high"))
    held = members.join(asked, "name", "left_semi").join(reach, hub)
    other = (F.col("scope") == "imported") | (F.col("low") != F.col("function_id")) | (F.col("high") != F.col("function_id"))
    called = held.where(other).select(F.col("function_id").alias("id")).distinct()

    callers = wanted_sites.select("caller_id", "name").distinct().join(functions.select(F.col("id").alias("caller_id"), *_spot()), "caller_id")
    call_rows = callers.select("name", "usage_file", "usage_line", F.lit("function_call").alias("usage_type"), "github_link")

    children = inherits.select(F.col("src").alias("child"), F.col("dst").alias("id")).join(defs_c, "id")
    child_rows = children.join(classes.select(F.col("id").alias("child"), *_spot()), "child").select(
        "name", "usage_file", "usage_line", F.lit("inheritance").alias("usage_type"), "github_link")

    used_f = defs_f.join(called, "id", "left_anti")
    used_c = defs_c.join(inherits.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    open_defs = used_f.select(F.lit("function").alias("node_type"), "id", "name").union(
        used_c.select(F.lit("class").alias("node_type"), "id", "name"))
    brought = resolved.select(F.col("src").alias("import_id"), "node_type", F.col("dst").alias("id"))
    by_import = open_defs.join(brought, ["node_type", "id"], "left")
    import_rows = by_import.join(imports.select(F.col("id").alias("import_id"), *_spot()), "import_id", "left").select(
        "name", "usage_file", "usage_line", F.when(F.col("import_id").isNotNull(), "import").alias("usage_type"), "github_link")
    return call_rows.union(child_rows).union(import_rows).distinct()


def _spot() -> list[Column]:
    return [F.col("file_path").alias("usage_file"), F.col("line_start").alias("usage_line"), F.col("github_url").alias("github_link")]


def class_hierarchy(inherits: DataFrame, classes: DataFrame, name: str, max_depth: int | None = None) -> DataFrame:
    """All inheritance paths that end at the classes called ``name``, no edge twice in a path.

    A given ``max_depth`` that paths go beyond is an error; paths are never cut silently.

    Paths double: ``found`` holds the paths to a root of fewer than 2^i edges, ``runs`` all paths of
    exactly 2^i edges, and a longer path is a run on top of a found one.  So the number of joins is the
    logarithm of the depth; both are written out each time, so an executor loss costs a re-read.
    """
    pair = F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string"))
    edges = inherits.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    # a run names its classes from the lowest to the one before ``top``
    runs = materialize(edges.select(
        F.col("src").alias("low"), F.col("dst").alias("top"), F.array("src").alias("steps"), F.array(pair).alias("used")), "runs")
    roots = classes.where(F.col("name") == name).select(F.col("id").alias("root")).where("root IS NOT NULL").distinct()
    found = materialize(roots.select(
        F.col("root").alias("child"), "root", F.array("root").alias("path"), F.array().cast("array<string>").alias("used")), "hierarchy")
    every = [found]
    while True:
        paths = reduce(DataFrame.union, every)
        met = runs.join(paths.withColumnRenamed("used", "__used"), F.col("top") == F.col("child"))
        longer = materialize(met.where(~F.arrays_overlap("used", "__used")).select(
            F.col("low").alias("child"), "root", F.concat("steps", "path").alias("path"), F.concat("used", "__used").alias("used")), "hierarchy")
        if longer.isEmpty():
            break
        every.append(longer)
        if max_depth is not None and not longer.where(F.size("used") > max_depth).isEmpty():
            raise ValueError(f"paths below {name!r} go beyond a depth of {max_depth}")
        upper = runs.select(F.col("low").alias("__low"), F.col("top").alias("__top"), F.col("steps").alias("__steps"), F.col("used").alias("__used"))
        runs = materialize(runs.join(upper, F.col("top") == F.col("__low")).where(~F.arrays_overlap("used", "__used")).select(
            "low", F.col("__top").alias("top"), F.concat("steps", "__steps").alias("steps"), F.concat("used", "__used").alias("used")), "runs")
    return paths.where(F.size("used") > 0).select("child", "root", F.size("used").cast("bigint").alias("depth"), "path")


def by_domain_purpose(functions: DataFrame, domain: str | None = None, purpose: str | None = None, technology: str | None = None) -> DataFrame:
    """Functions by any of domain, purpose and technology; absent ones are not tested."""
    kept = functions
    if domain is not None:
        kept = kept.where(F.col("domain") == domain)
    if purpose is not None:
        kept = kept.where(F.col("purpose") == purpose)
    if technology is not None:
        kept = kept.where(F.array_contains("technologies", technology))
    return kept.orderBy(F.asc_nulls_last("domain"), F.asc_nulls_last("purpose"), F.asc_nulls_last("name"), "id")


SEARCHED = ("purpose", "domain", "name", "docstring", "technologies")


def multi_field_search(functions: DataFrame, term: str, n: int = 20, index: DataFrame | None = None) -> DataFrame:
    """First ``n`` functions by name that mention the term in any described field; through an index of them if given."""
    said = {field: [term] for field in SEARCHED if field in functions.columns}
    return search.holding(functions, said, index).orderBy("name", "id").limit(n)


def code_metrics(functions: DataFrame, classes: DataFrame, files: DataFrame) -> DataFrame:
    """One row of counts, complexity figures and the distinct purposes and domains.

    Three one-row aggregates side by side; classes or files may be absent.
    """
    f = functions.agg(
        F.count(F.lit(1)).alias("total_functions"), F.round(F.avg("complexity"), 2).alias("avg_complexity"),
        F.max("complexity").alias("max_complexity"), F.count_distinct("purpose").alias("purposes"),
        F.count_distinct("domain").alias("domains"),
    )
    return f.select(
        "*", classes.agg(F.count(F.lit(1))).scalar().alias("total_classes"), files.agg(F.count(F.lit(1))).scalar().alias("total_files")
    )


def distinct_values(functions: DataFrame, columns: list[str] = ["purpose", "domain"]) -> DataFrame:
    """The distinct purposes and domains as rows."""
    pairs = functions.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])))
    return pairs.where(F.col("value").isNotNull()).distinct()


def call_stats(sites: DataFrame) -> DataFrame:
    """Number of resolved call edges per type; a site stands for its ``n_targets`` edges."""
    return sites.groupBy("type").agg(F.sum("n_targets").alias("edges")).orderBy(F.desc("edges"), "type")


def lookup_entity(entities: DataFrame, name: str) -> DataFrame:
    return entities.where(F.col("name") == name)


def contains_lookup(entities: DataFrame, name_term: str, content_term: str, index: DataFrame | None = None) -> DataFrame:
    """Entities whose name or content holds a term, with 300 characters of content; through an index of both if given."""
    found = search.holding(entities, {"name": [name_term], "content": [content_term]}, index)
    return found.withColumn("content", F.substring("content", 1, 300))


def with_parameters(functions: DataFrame, parameters: DataFrame, name: str | None = None) -> DataFrame:
    """Functions with their parameter names in order (a signature's worth per function)."""
    kept = functions if name is None else functions.where(F.col("name") == name)
    held = parameters.select(F.col("src").alias("id"), F.struct("position", F.col("name").alias("parameter")).alias("p"))
    listed = kept.select("id", "name", "file_path").join(held, "id").groupBy("id", "name", "file_path").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return listed.select("id", "name", "file_path", F.transform("ps", lambda p: p["parameter"]).alias("parameters"))


def edge_patterns(edges: DataFrame, nodes: DataFrame, n: int = 50, with_count: bool = True) -> DataFrame:
    """(label, edge type, label) triples, the most frequent first."""
    label = nodes.select("id", "label")
    joined = (
        edges.join(label.select(F.col("id").alias("src"), F.col("label").alias("from_label")), "src")
        .join(label.select(F.col("id").alias("dst"), F.col("label").alias("to_label")), "dst")
    )
    triple = ["from_label", "type", "to_label"]
    if not with_count:
        return joined.select(*triple).distinct().orderBy(*triple).limit(n)
    return joined.groupBy(*triple).agg(F.count(F.lit(1)).alias("edges")).orderBy(F.desc("edges"), *triple).limit(n)


def _profile(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Property rows: name, type, whether every row has it; one scan."""
    kinds = dict(df.dtypes)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c in columns])
    rows = F.array(*[
        F.struct(F.lit(c).alias("property"), F.lit(kinds[c]).alias("types"), F.col(c).alias("present")) for c in columns
    ])
    named = counts.select(*by, "__rows", F.inline(rows)).where("present > 0")
    return named.select(*by, "property", "types", (F.col("present") == F.col("__rows")).alias("mandatory"))


def node_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Per label: the properties found, their types, and whether all nodes have them."""
    parts = [
        _profile(df.withColumn("label", F.lit(label)), ["label"], df.columns) for label, df in tables.items()
    ]
    return reduce(DataFrame.union, parts)


def edge_profile(edges: DataFrame) -> DataFrame:
    """Per edge type: the properties found beyond source, target and type."""
    return _profile(edges, ["type"], [c for c in edges.columns if c not in ("src", "dst", "type")])


def sample_entities(nodes: DataFrame, n: int = 50) -> DataFrame:
    """First ``n`` named nodes by name with 200 characters of content."""
    named = nodes.where(F.col("name").isNotNull()).withColumn("content", F.substring("content", 1, 200))
    return named.select("label", "name", "file_path", "qualified_name", F.col("content").alias("content_preview"), "id").orderBy("name", "label", "id").limit(n)


def path_vocabulary(samples: DataFrame, n: int = 20) -> DataFrame:
    """Distinct extensions and path parts of the first 30 samples, the first ``n`` in order."""
    first = samples.orderBy("name", "label", "id").limit(30)
    parts = F.filter(F.split("file_path", "/"), lambda p: p != "")
    last = F.element_at(F.split("file_path", "/"), -1)
    ending = F.when(F.contains(last, F.lit(".")), F.array(F.substring_index(last, ".", -1))).otherwise(F.array().cast("array<string>"))
    return first.select(F.explode(F.concat(parts, ending)).alias("word")).distinct().orderBy("word").limit(n)


# Properties listed first in a schema digest.
PRIORITY_PROPERTIES = ["name", "file_path", "line_start", "line_end", "github_url", "qualified_name", "content", "node_type"]


def schema_digest(profile: DataFrame, patterns: DataFrame, samples: DataFrame) -> DataFrame:
    """Lines describing the graph: properties per label, ten patterns, five samples.

    Priority properties come first and all of them, then four others; the
    inputs are the small tables of the functions above.
    """
    first = F.col("property").isin(PRIORITY_PROPERTIES)
    ranked = top_n(profile.withColumn("__later", F.when(first, 0).otherwise(1)), ["label", "__later"], ["property"], len(PRIORITY_PROPERTIES), "r")
    kept = ranked.where((F.col("__later") == 0) | (F.col("r") <= 4))
    listed = kept.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("__later", "property"))).alias("ps"))
    names = F.array_join(F.transform("ps", lambda p: p["property"]), ", ")
    nodes = listed.select(F.lit("nodes").alias("section"), F.format_string("- **%s**: %s", "label", names).alias("line"))
    ten = patterns.orderBy(F.desc("edges"), "from_label", "type", "to_label").limit(10)
    shapes = ten.select(F.lit("patterns").alias("section"), F.format_string("- (%s)-[:%s]->(%s) [%d]", "from_label", "type", "to_label", "edges").alias("line"))
    five = samples.orderBy("name", "label", "id").limit(5)
    shown = five.select(F.lit("samples").alias("section"), F.format_string("- **%s** (%s) in %s", "name", "label", "file_path").alias("line"))
    return nodes.union(shapes).union(shown)
