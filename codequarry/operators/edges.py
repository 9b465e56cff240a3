"""Edges of the code graph, resolved with equality joins only.

Lookups that need "the first" or "the last" entity of a name reduce the
dimension to one row per key before the join.  Relations that are complete
within a group (same name, same purpose, same file) are kept in two halves that
meet in a hub - who reaches the hub, who belongs to it - so their size is
linear; ``expand`` multiplies them out where single edges are wanted.

Tables that hold several repositories say so in a column ``repo_id`` (never
NULL) on every input; names, paths and modules then meet within one only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import paths
from codequarry.functions.ranking import first_per_key, top_n
from codequarry.session import TASK_BYTES, materialize, shuffled

LOAD_ORDER = ["file_path", "line_start", "id"]
GRAMS = 5  # characters by which a piece of a path is looked up
HUB_BLOCK = 4096  # callers, or members, of a hub that meet in one task

# Call scopes with their edge types and priorities.
CALL_SCOPES = {
    "local": ("CALLS_LOCAL", 1),
    "imported": ("CALLS_IMPORTED", 2),
    "method": ("CALLS_METHOD", 3),
    "global": ("CALLS_GLOBAL", 4),
}


def _edge(kind: str, src: str, dst: str) -> list[Column]:
    return [F.col(src).alias("src"), F.lit(kind).alias("type"), F.col(dst).alias("dst")]


def repo_of(*tables: DataFrame) -> list[str]:
    """The repository column, if the tables have one; all of them or none."""
    have = {"repo_id" in t.columns for t in tables}
    if len(have) > 1:
        raise ValueError("repo_id is missing from some of the tables")
    return ["repo_id"] if have == {True} else []


def within(repo: list[str], value: Column | str) -> Column:
    """A text that is a key in its repository, as a key among all."""
    value = F.col(value) if isinstance(value, str) else value
    return F.concat(F.col("repo_id").cast("string"), F.lit(":"), value) if repo else value


def _known(files: DataFrame, repo: list[str]) -> DataFrame:
    return files.select(*repo, F.col("path").alias("file_path"))


def _file_edge(kind: str, rows: DataFrame, repo: list[str], src: str, dst: str) -> DataFrame:
    """Edges between files and entities; a file is named by repository and path."""
    key = lambda c: within(repo, c) if c == "file_path" else F.col(c)
    return rows.select(key(src).alias("src"), F.lit(kind).alias("type"), key(dst).alias("dst"))


def defined_in(entities: DataFrame, files: DataFrame) -> DataFrame:
    """Function or class -> file."""
    repo = repo_of(entities, files)
    return _file_edge("DEFINED_IN", entities.join(_known(files, repo), [*repo, "file_path"]), repo, "id", "file_path")


def defines(files: DataFrame, entities: DataFrame) -> DataFrame:
    """File -> function or class."""
    repo = repo_of(files, entities)
    return _file_edge("DEFINES", _known(files, repo).join(entities, [*repo, "file_path"]), repo, "file_path", "id")


def has_parameter(functions: DataFrame) -> DataFrame:
    """Function -> parameter, with its name and 0-based position."""
    rows = functions.select("id", F.posexplode("parameters").alias("position", "name"))
    target = F.concat(F.col("id").cast("string"), F.lit("_param_"), F.col("position").cast("string"))
    return rows.withColumn("parameter_id", target).select(
        *_edge("HAS_PARAMETER", "id", "parameter_id"), "name", F.col("position").cast("bigint")
    )


def modules(imports: DataFrame) -> DataFrame:
    return imports.where(F.col("module").isNotNull()).select("module").distinct()


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """File -> import, and import -> module."""
    repo = repo_of(imports, files)
    owned = imports.withColumn("id", F.col("id").cast("string")).join(_known(files, repo), [*repo, "file_path"])
    named = imports.where(F.col("module").isNotNull()).withColumn("id", F.col("id").cast("string"))
    return _file_edge("IMPORTS", owned, repo, "file_path", "id").union(named.select(*_edge("FROM_MODULE", "id", "module")))


def _resolve(refs: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    """Edges from ``refs(src[, repo_id], file_path, ref)`` to entities.

    The entity qualified as ``module.ref`` wins (the last loaded of several),
    unless it is the source itself; else the first loaded entity named ``ref``
    that is not the source.  The two first per name suffice for that.
    """
    repo = repo_of(refs, entities)
    listed = entities.select(*repo, "id", "name", "qualified_name", *[c for c in LOAD_ORDER if c != "id"])
    qualified = first_per_key(
        listed.where(F.col("qualified_name").isNotNull()).select(*repo, "qualified_name", *LOAD_ORDER), [*repo, "qualified_name"], LOAD_ORDER, last=True
    ).select(*repo, F.col("qualified_name").alias("__key"), F.col("id").alias("__qualified"))
    two = top_n(listed.where(F.col("name").isNotNull()).select(*repo, "name", *LOAD_ORDER), [*repo, "name"], LOAD_ORDER, 2, "__rank")
    named = two.groupBy(*repo, F.col("name").alias("ref")).agg(
        F.max(F.when(F.col("__rank") == 1, F.col("id"))).alias("__first"),
        F.max(F.when(F.col("__rank") == 2, F.col("id"))).alias("__second"),
    )
    keyed = refs.withColumn("__key", F.concat(paths.module_path(F.col("file_path")), F.lit("."), F.col("ref")))
    joined = keyed.join(qualified, [*repo, "__key"], "left").join(named, [*repo, "ref"], "left")
    exact = F.when(F.col("__qualified") != F.col("src"), F.col("__qualified"))
    by_name = F.when(F.col("__first") != F.col("src"), F.col("__first")).otherwise(F.col("__second"))
    return (
        joined.select(
            "src", F.lit(kind).alias("type"), F.coalesce(exact, by_name).alias("dst"), F.col("ref").alias("called_name"),
            F.when(exact.isNotNull(), "qualified").otherwise("name_based").alias("resolution_type"),
        )
        .where(F.col("dst").isNotNull())
        .distinct()
    )


def calls(functions: DataFrame, called: DataFrame) -> DataFrame:
    """CALLS edges; ``called(caller_id, called_name)``."""
    repo = repo_of(functions)
    refs = called.select("caller_id", "called_name").join(functions.select(*repo, F.col("id").alias("caller_id"), "file_path"), "caller_id").select(
        *repo, F.col("caller_id").alias("src"), "file_path", F.col("called_name").alias("ref")
    )
    return _resolve(refs, functions, "CALLS")


def inherits(classes: DataFrame, bases: DataFrame) -> DataFrame:
    """INHERITS edges; ``bases(class_id, base)``."""
    repo = repo_of(classes)
    refs = bases.select("class_id", "base").join(classes.select(*repo, F.col("id").alias("class_id"), "file_path"), "class_id").select(
        *repo, F.col("class_id").alias("src"), "file_path", F.col("base").alias("ref")
    )
    return _resolve(refs, classes, "INHERITS").drop("called_name")


def belongs_to(methods: DataFrame, classes: DataFrame, order: list[str]) -> DataFrame:
    """Method -> smallest class of its file whose lines ``lo..hi`` hold the method's ``line``.

    Every class range is cut into aligned blocks of 2^k lines (two per k at
    most) and only the smallest class per block is kept; a method looks up the
    one block per k that holds its line.  So no method meets all classes of its
    file, however large the file is.  Ties go to the first class in ``order``.
    """
    width = F.col("hi") - F.col("lo") + 1
    levels = F.floor(F.log2(width.cast("double"))).cast("int")
    cut = classes.where(width > 0).withColumn("k", F.explode(F.sequence(F.lit(0), levels)))
    size = F.expr("shiftleft(1L, k)")
    left = F.floor((F.col("lo") + size - 1) / size)
    right = F.floor((F.col("hi") + 1) / size) - 1
    ends = F.array(F.when(left % 2 == 1, left), F.when(right % 2 == 0, right))
    blocks = cut.where(left <= right).withColumn("block", F.explode(F.array_distinct(F.array_compact(ends))))
    best = blocks.groupBy("file_id", "k", "block").agg(
        F.min(F.struct((F.col("hi") - F.col("lo")).alias("size"), *order, F.col("id").alias("class_id"))).alias("best")
    )
    deepest = classes.agg(F.coalesce(F.max(levels), F.lit(0)).alias("k")).scalar()
    spread = methods.select(F.col("id").alias("src"), "file_id", "line", F.explode(F.sequence(F.lit(0), deepest)).alias("k"))
    at = spread.withColumn("block", F.floor(F.col("line") / F.expr("shiftleft(1L, k)")))
    found = at.join(shuffled(best), ["file_id", "k", "block"]).groupBy("src").agg(F.min("best").alias("best"))
    return found.select("src", F.lit("BELONGS_TO").alias("type"), F.col("best.class_id").alias("dst"))


def _substrings(path: Column, lengths: Column) -> Column:
    """All distinct substrings of ``path`` that have one of the given lengths."""
    per_length = F.transform(
        F.filter(lengths, lambda n: n <= F.length(path)),
        lambda n: F.transform(F.sequence(F.lit(1), F.length(path) - n + 1), lambda i: F.substr(path, i, n)),
    )
    return F.array_distinct(F.flatten(per_length))


def contained(pieces: DataFrame, paths_: DataFrame, grams: int = GRAMS) -> DataFrame:
    """(scope, piece, path) where ``path`` contains ``piece`` within a scope; ``pieces(scope, piece)``, ``paths_(scope, path)``.

    A piece is filed under its rarest run of ``grams`` characters among the paths of its scope, shorter ones under the whole piece; a
    path looks up its own runs, and what meets is verified.  A piece with a run that no path has meets none.  ``pieces`` is
    read several times.
    """
    pieces = pieces.where(F.col("piece").isNotNull()).distinct()
    sized = F.least(F.length("piece"), F.lit(grams))
    # lengths of the runs that are looked up, ``grams`` + 1 of them at most
    lengths = F.array(*(F.lit(r[0]) for r in pieces.select(sized).distinct().collect())).cast("array<int>")
    offered = paths_.distinct().join(pieces.select("scope").distinct(), "scope", "left_semi")
    offered = offered.select("scope", "path", F.explode(_substrings(F.col("path"), lengths)).alias("run"))
    counts = offered.groupBy("scope", "run").agg(F.count(F.lit(1)).alias("many"))
    filed = pieces.withColumn("run", F.explode(_substrings(F.col("piece"), F.array(sized))))
    rarest = F.min(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "run")).alias("rarest")
    keyed = filed.join(counts, ["scope", "run"], "left").groupBy("scope", "piece").agg(rarest).where("rarest.many > 0")
    met = offered.join(keyed.select("scope", "piece", F.col("rarest.run").alias("run")), ["scope", "run"])
    return met.where(F.contains("path", F.col("piece"))).select("scope", "piece", "path")


def import_targets(imports: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities meant by ``from module import item``, once per (module, item).

    A target is named like the item, and its path contains the module as a
    path or ends with ``module.py``.
    """
    repo = repo_of(imports, entities)
    scope = lambda name: (F.struct(*repo, F.col(name).alias("name")) if repo else F.col(name)).alias("scope")
    wanted = materialize(imports.where(F.col("module").isNotNull()).select(*repo, "module", "item").distinct(), "wanted")
    pattern, ending = F.replace("module", F.lit("."), F.lit("/")), F.concat("module", F.lit(".py"))
    keyed = wanted.select("module", scope("item"), F.inline(F.array(
        F.struct(F.lit(False).alias("last"), pattern.alias("piece")), F.struct(F.lit(True).alias("last"), ending.alias("piece")))))
    named = entities.select("id", scope("name"), "node_type", F.col("file_path").alias("path"))
    met = contained(keyed.select("scope", "piece"), named.select("scope", "path"))
    found = keyed.join(met, ["scope", "piece"]).where(~F.col("last") | F.endswith("path", F.col("piece"))).select("scope", "module", "path").distinct()
    item = [F.col("scope.repo_id"), F.col("scope.name").alias("item")] if repo else [F.col("scope").alias("item")]
    return found.join(shuffled(named), ["scope", "path"]).select(*item[:-1], "module", item[-1], "id", "node_type").distinct()


def resolves_from_import(imports: DataFrame, targets: DataFrame) -> DataFrame:
    """Import -> entity edges from the targets of (module, item)."""
    return imports.join(targets, [*repo_of(imports, targets), "module", "item"]).select(
        F.col("import_id").alias("src"), F.lit("RESOLVES_TO").alias("type"), F.col("id").alias("dst")
    ).distinct()


def module_targets(imports: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities meant by ``import module``: named like their ``.py`` file, path containing the module."""
    repo = repo_of(imports, entities)
    anywhere, path = (F.col("repo_id") if repo else F.lit(0)).alias("scope"), F.col("file_path").alias("path")
    wanted = materialize(imports.where(F.col("module").isNotNull()).select(*repo, "module").distinct(), "wanted")
    wanted = wanted.withColumn("piece", F.replace("module", F.lit("."), F.lit("/")))
    mains = entities.where(F.endswith("file_path", F.lit(".py")) & (F.col("name") == paths.stem(F.col("file_path"))))
    met = contained(wanted.select(anywhere, "piece"), mains.select(anywhere, path))
    found = wanted.withColumn("scope", anywhere).join(met, ["scope", "piece"]).join(mains.select(anywhere, "id", "node_type", path), ["scope", "path"])
    return found.select(*repo, "module", "id", "node_type").distinct()


def import_groups(imports: DataFrame) -> DataFrame:
    """Per file and imported item: the modules it comes from, and ``owner``, one key for that set.

    Files importing an item from the same modules share the owner, so what the
    item can mean is kept once for all of them.
    """
    repo = repo_of(imports)
    grouped = imports.where(F.col("module").isNotNull()).groupBy(*repo, "file_path", "item").agg(F.array_sort(F.collect_set("module")).alias("modules"))
    return grouped.withColumn("owner", within(repo, F.array_join("modules", "|")))


def call_members(functions: DataFrame, membership: DataFrame, imports: DataFrame, targets: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Which function can be meant in which hub.

    A hub is (scope, owner, name): a name in a file, in a class, imported from
    a set of modules, or anywhere.  ``imports(file_path, module, item)`` and
    ``targets(module, item, id, node_type)``; ``groups`` are the import groups, if they have been written.
    """
    repo = repo_of(functions, imports, targets)
    named = functions.select(*repo, F.col("id").alias("function_id"), "file_path", "name")
    scoped = named.select("function_id", F.inline(F.array(
        F.struct(F.lit("local").alias("scope"), within(repo, "file_path").alias("owner"), F.col("name").alias("name")),
        F.struct(F.lit("global").alias("scope"), within(repo, F.lit("")).alias("owner"), F.col("name").alias("name")),
    )))
    methods = named.join(shuffled(membership), "function_id").select("function_id", F.lit("method").alias("scope"), F.col("class_id").alias("owner"), "name")
    groups = import_groups(imports) if groups is None else groups
    # the owners, which are long, stay with their hubs; modules and functions meet by the hub's number, written so that it is fixed
    modules = F.array_distinct(F.flatten(F.collect_set("modules"))).alias("modules")
    hubs = groups.groupBy(*repo, "owner", "item").agg(modules).withColumn("hub", F.monotonically_increasing_id())
    hubs = materialize(hubs, "import-hubs", TASK_BYTES)
    meant = targets.where("node_type = 'function'").select(*repo, "module", "item", F.col("id").alias("function_id"))
    found = hubs.select(*repo, "hub", "item", F.explode("modules").alias("module")).join(shuffled(meant), [*repo, "module", "item"])
    found = found.select("hub", "function_id").repartition("hub").distinct()
    brought = found.join(shuffled(hubs.select("hub", "owner", "item")), "hub").select("function_id", F.lit("imported").alias("scope"), "owner", F.col("item").alias("name"))
    return scoped.union(methods).union(brought)


def call_sites(functions: DataFrame, called: DataFrame, membership: DataFrame, imports: DataFrame, members: DataFrame,
               groups: DataFrame | None = None) -> DataFrame:
    """Per caller, called name and scope: the hub reached and how many functions it can mean.

    Local, imported and method scopes may all apply to one call; the global
    scope only when none of them does.  A function does not mean itself,
    except through an import.  A call looks up the sizes of its hubs as one row; only the classes of its caller make further rows.
    """
    repo = repo_of(functions, imports)
    here = within(repo, "file_path").alias("__here")
    classes = membership.groupBy(F.col("function_id").alias("caller_id")).agg(F.collect_set("class_id").alias("__classes"))
    caller = functions.select(*repo, F.col("id").alias("caller_id"), here, F.col("name").alias("__own"))
    named = called.where(F.coalesce(F.col("called_name"), F.lit("")) != "").select("caller_id", "called_name").distinct()
    sizes = members.groupBy("scope", "owner", F.col("name").alias("called_name")).agg(F.count(F.lit(1)).alias("size"))
    sizes = materialize(sizes, "hub-sizes", TASK_BYTES)

    def of(scope: str, owner: str, size: str) -> DataFrame:
        return sizes.where(F.col("scope") == scope).select(F.col("owner").alias(owner), "called_name", F.col("size").alias(size))

    groups = import_groups(imports) if groups is None else groups
    brought = groups.select(*repo, here, F.col("item").alias("called_name"), F.col("owner").alias("modules"))
    brought = brought.join(shuffled(of("imported", "modules", "n_imported")), ["modules", "called_name"])
    itself = F.when(F.col("__own") == F.col("called_name"), 1).otherwise(0)
    # read for the hubs of the file and for those of the classes
    placed = named.join(shuffled(caller.join(shuffled(classes), "caller_id", "left")), "caller_id").withColumn("__itself", itself).drop("__own")
    placed = materialize(placed, "placed-calls", TASK_BYTES)

    there = placed.drop("__classes").withColumn("__all", within(repo, F.lit(""))).join(shuffled(of("local", "__here", "n_local")), ["__here", "called_name"], "left").join(
        shuffled(brought), [*repo, "__here", "called_name"], "left").join(of("global", "__all", "n_global"), ["__all", "called_name"], "left")
    less = lambda n: F.col(n) - F.col("__itself")
    there = materialize(there.select("caller_id", "called_name", "__here", "__all", "modules", less("n_local").alias("n_local"), "n_imported", less("n_global").alias("n_global")),
                        "placed-hubs", TASK_BYTES)

    def option(scope: str, owner: str, n: str) -> Column:
        return F.when(F.col(n) > 0, F.struct(F.lit(scope).alias("scope"), F.col(owner).alias("owner"), F.col(n).alias("n_targets")))

    site = ["caller_id", "called_name"]
    near = there.select(*site, F.inline(F.array_compact(F.array(option("local", "__here", "n_local"), option("imported", "modules", "n_imported")))))
    held = placed.select(*site, "__itself", F.explode("__classes").alias("owner")).join(shuffled(of("method", "owner", "n_method")), ["owner", "called_name"])
    held = held.select(*site, F.lit("method").alias("scope"), "owner", less("n_method").alias("n_targets")).where("n_targets > 0")
    held = materialize(held, "method-sites", TASK_BYTES)
    lone = ~(F.coalesce(F.col("n_local") > 0, F.lit(False)) | F.coalesce(F.col("n_imported") > 0, F.lit(False)))
    far = there.where(lone & (F.col("n_global") > 0)).select(*site, F.lit("global").alias("scope"), F.col("__all").alias("owner"), F.col("n_global").alias("n_targets"))
    # of ids that several rows have, calls come together by their caller and name
    once = caller.groupBy("caller_id").agg(F.count(F.lit(1)).alias("many")).where("many > 1").isEmpty()
    nearer = held if once else held.union(near)
    chosen = near.union(held).union(far.join(shuffled(nearer.select(*site)), site, "left_anti"))
    return (chosen if once else chosen.distinct()).select(
        "caller_id", "called_name", "scope", "owner", "n_targets",
        _by_scope(0).alias("type"), _by_scope(1).cast("bigint").alias("priority"),
    )


def _by_scope(field: int) -> Column:
    value = F.lit(None)
    for scope, row in CALL_SCOPES.items():
        value = F.when(F.col("scope") == scope, row[field]).otherwise(value)
    return value


def expand_calls(sites: DataFrame, members: DataFrame, block: int = HUB_BLOCK) -> DataFrame:
    """Single call edges of ``sites``: one row per caller and possible function.

    A hub with more than ``block`` callers or members is cut into blocks on both sides, and block meets block, so a name
    that everyone calls is many join keys of ``block`` callers and members each.
    """
    hub = ["scope", "owner", "called_name"]
    meant = members.select("scope", "owner", F.col("name").alias("called_name"), F.col("function_id").alias("dst"))

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.xxhash64(*hub).alias("__hub")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    # counted by hash, which is shorter than the names: hubs of one hash are cut alike, and meet by name below
    # written, so that the joins below have plain shuffles on both sides, whose hot keys are split at run time
    large = blocks(sites, "rows").join(blocks(meant, "columns"), "__hub").where("rows > 1 OR columns > 1")
    large = materialize(large, "large-hubs")

    def dealt(rows: DataFrame, own: str, key: str, other: str) -> DataFrame:
        rows = rows.withColumn("__hub", F.xxhash64(*hub)).join(large, "__hub", "left").drop("__hub").fillna(1, ["rows", "columns"])
        rows = rows.withColumn(f"{own}_block", F.pmod(F.xxhash64(F.lit(11), key), F.col(own)))
        return rows.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - F.lit(1).cast("bigint")))).drop("rows", "columns")

    joined = dealt(sites, "rows", "caller_id", "columns").join(dealt(meant, "columns", "dst", "rows"), [*hub, "rows_block", "columns_block"])
    return joined.where((F.col("scope") == "imported") | (F.col("dst") != F.col("caller_id"))).select(
        F.col("caller_id").alias("src"), "type", "dst", "called_name", F.col("scope").alias("resolution_type"), "priority"
    )


def group_links(entities: DataFrame, key: str) -> DataFrame:
    """Membership in groups of equal ``key`` with the number of partners.

    All pairs of a group would be quadratic; the pair (a, b) is an edge exactly
    when both link to one group, and each node has ``partners`` such edges.
    Used for similar purpose, same domain and same module.
    """
    filled = entities.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").select("id", "node_type", key)
    sizes = filled.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("partners"))
    return filled.join(sizes, key).where("partners > 0").select("id", "node_type", F.col(key).alias("group"), "partners")


def similar_purpose(functions: DataFrame) -> DataFrame:
    return group_links(functions, "purpose")


def same_domain(entities: DataFrame) -> DataFrame:
    return group_links(entities, "domain")


def same_module(entities: DataFrame) -> DataFrame:
    return group_links(entities.withColumn("file_path", within(repo_of(entities), "file_path")), "file_path")


def partners_of(requests: DataFrame, links: DataFrame) -> DataFrame:
    """All partners of the requested nodes (``id``)."""
    asked = requests.select("id").distinct().join(links.select("id", "group"), "id").withColumnRenamed("id", "src")
    return asked.join(links.select(F.col("id").alias("dst"), "group"), "group").where("src <> dst").select("src", "dst", "group")


def uses_technology(entities: DataFrame, module_names: DataFrame) -> DataFrame:
    """Node -> module named by one of its technologies."""
    named = entities.select("id", F.explode("technologies").alias("module")).distinct()
    return named.join(module_names.select("module").distinct(), "module").select(*_edge("USES_TECHNOLOGY", "id", "module"))


def repository_rows(metadata: DataFrame, order: list[str]) -> DataFrame:
    """One row per repository URL, the last written."""
    return first_per_key(metadata, ["url"], order, last=True)


def load_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct nodes, edges, embedded nodes and rows without a key, by label or edge type."""
    by_label = nodes.groupBy(F.col("label").alias("kind")).agg(
        F.count_distinct("id").alias("n"), F.count_distinct(F.when(F.col("has_embedding"), F.col("id"))).alias("embedded"),
        F.count_if(F.col("id").isNull()).alias("errors"),
    )
    by_type = edges.distinct().groupBy(F.col("type").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("embedded"),
        F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("errors"),
    )
    return by_label.select(F.lit("node").alias("part"), "*").union(by_type.select(F.lit("edge").alias("part"), "*"))
