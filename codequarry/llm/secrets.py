"""Secret scan with linking of multipart credentials, in DataFrame operations only.

Kinds, in the order in which spans at one place are listed:

- ``assign``, ``access``, ``hex``: strong by themselves and always reported;
- ``identifier``, ``secret``, ``endpoint``: weak parts, reported only when the parts that complete
  them start within ``SCOPE`` code points of them in the same text: an identifier needs a secret, a
  secret an identifier, an endpoint both.  Strong parts complete weak ones: ``access`` counts as an
  identifier, ``assign`` and ``hex`` as secrets.  A weak part that overlaps a strong one is not
  reported apart.

Offsets are code points, ends exclusive.  NULL texts are empty.  Each row is scanned by itself, so
repeated rows repeat in the result, and a NULL doc_id is returned as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.session import materialize

SCOPE = 200


def any_case(word: str) -> str:
    """A pattern of ``word`` with ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _assigned(names: str, value: str) -> str:
    return rf"""({any_case(names)})["']?\x20*[:=]\x20*["']?({value})"""


# kind: (pattern, group whose length counts, least length)
STRONG = {
    "assign": (_assigned("password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]+"), 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),
}
WEAK = {
    "identifier": (_assigned("access_?key_?id|client_?id|account_?id|user_?name|user|login", "[A-Za-z0-9+/_.=@-]+"), 2, 4),
    "secret": ("[A-Za-z0-9+/]{24,}", 0, 24),
    "endpoint": (r"""(?:[Hh][Tt][Tt][Pp][Ss]?|[Ff][Tt][Pp]|postgresql|postgres|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+""", 0, 10),
}
KINDS = [*STRONG, *WEAK]
ROLES = {"identifier": ("access", "identifier"), "secret": ("assign", "hex", "secret")}


def _mixed(text: Column) -> Column:
    """Whether a run has letters of both cases and digits, as generated keys do."""
    return text.rlike("[0-9]") & text.rlike("[a-z]") & text.rlike("[A-Z]")


def _pieces(kind: str, text: Column) -> Column:
    """Array of (gap, size, kept) of the leftmost non-overlapping matches of a kind.

    ``gap`` is the length of what lies between a match and the one before.
    """
    pattern, group, least = (STRONG | WEAK)[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)

    def piece(zipped: Column) -> Column:
        kept = F.length(zipped["measured"]) >= least
        kept = kept & _mixed(zipped["measured"]) if kind == "secret" else kept
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), F.length(zipped["gap"]).alias("gap"), F.length(zipped["hit"]).alias("size"), kept.alias("kept")
        )

    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), measured.alias("measured"))
    empty = F.array().cast("array<struct<kind:int,gap:int,size:int,kept:boolean>>")
    return F.when(text.rlike(pattern), F.transform(zipped, piece)).otherwise(empty)


def parts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end) of all strong and weak matches; kind is NULL in the one row of
    a text without any.

    Places are running sums of the lengths of gaps and matches, per text and kind.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    found = rows.select("row", "doc_id", F.concat(*[_pieces(k, F.col("text")) for k in KINDS]).alias("found"))
    each = found.select("row", "doc_id", F.posexplode_outer("found").alias("pos", "at"))
    each = each.select("row", "doc_id", "pos", "at.*")
    upto = Window.partitionBy("row", "kind").orderBy("pos")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    kept = placed.where(F.col("kept") | F.col("kind").isNull())
    # a text whose matches are all too short still has its row
    marks = rows.select("row", "doc_id", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"))
    return kept.where("kind IS NOT NULL").select("row", "doc_id", "kind", (F.col("end") - F.col("size")).alias("start"), "end").unionByName(marks)


def spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, doc_id, kind, start, end) of the reported spans, and a row with NULL kind for each text.

    The interval join: starts fall into bins of ``scope`` code points, so parts that lie within
    ``scope`` of each other are in the same or in neighbouring bins.  Each bin is reduced to its first
    and last start of either role before it meets the weak parts, so pairs are never listed.
    """
    found = materialize(parts(docs), "parts")
    number = {k: n for n, k in enumerate(KINDS)}
    weak = F.col("kind") >= len(STRONG)
    bins = found.where("kind IS NOT NULL").withColumn("bin", F.floor(F.col("start") / scope))
    ends = []
    for role, kinds in ROLES.items():
        start = F.when(F.col("kind").isin(*[number[k] for k in kinds]), F.col("start"))
        ends += [F.min(start).alias(f"{role}_min"), F.max(start).alias(f"{role}_max")]
    reduced = bins.groupBy("row", "bin").agg(*ends)
    shifted = reduced.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("to", F.col("bin") + F.col("step"))
    near = shifted.groupBy(F.col("row").alias("of"), "to").agg(
        *[F.max(F.when(F.col("step") == 0, F.col(f"{r}_min"))).alias(f"{r}_here") for r in ROLES],
        *[F.max(F.when(F.col("step") == 1, F.col(f"{r}_max"))).alias(f"{r}_before") for r in ROLES],
        *[F.min(F.when(F.col("step") == -1, F.col(f"{r}_min"))).alias(f"{r}_after") for r in ROLES],
    )
    joined = bins.where(weak).join(near, (F.col("row") == F.col("of")) & (F.col("bin") == F.col("to")))

    def has(role: str) -> Column:
        here, before, after = (F.col(f"{role}_{x}") for x in ("here", "before", "after"))
        return here.isNotNull() | F.coalesce(before >= F.col("start") - scope, F.lit(False)) | F.coalesce(after <= F.col("start") + scope, F.lit(False))

    needed = (
        F.when(F.col("kind") == number["identifier"], has("secret")).when(F.col("kind") == number["secret"], has("identifier"))
        .otherwise(has("identifier") & has("secret"))
    )
    linked = joined.where(needed).select("row", "doc_id", "kind", "start", "end")
    both = bins.where(~weak).select("row", "doc_id", "kind", "start", "end").unionByName(linked)
    order = Window.partitionBy("row").orderBy("start", "kind")
    strong = F.col("kind") < len(STRONG)
    reached = F.max(F.when(strong, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.min(F.when(strong, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    apart = both.withColumn("reached", reached).withColumn("coming", coming)
    free = F.coalesce(F.col("reached") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("coming") >= F.col("end"), F.lit(True))
    reported = apart.where(strong | free).select("row", "doc_id", "kind", "start", "end")
    return reported.unionByName(found.where("kind IS NULL"))


def reports(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``: spans as an array of (start, kind, end), in order."""
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    grouped = spans(docs, scope).groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    return grouped.select("doc_id", "spans")


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
