"""Connected components of a link table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.session import materialize


def _smallest(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with the smallest partner of u."""
    least = pairs.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    return pairs.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (src, dst): the smallest id reachable.

    Alternates the large-star and the small-star step until nothing changes.  Each round is
    written to the shared folder, so a lost executor repeats a round at most.  Links with a
    NULL end are ignored; links to oneself give a component of one.
    """
    ids = links.where("src IS NOT NULL AND dst IS NOT NULL")
    edges = materialize(
        ids.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links"
    )
    alone = edges.where("u = v")
    stars, seen = edges.where("u <> v"), None
    while True:
        both = stars.union(stars.select(F.col("v"), F.col("u")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        near = _smallest(large)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        stars = materialize(small.distinct(), "stars")
        sums = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(sums) == seen:
            break
        seen = tuple(sums)
    members = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    centres = stars.select(F.col("v").alias("id"), F.col("v").alias("component"))
    single = alone.select(F.col("u").alias("id")).join(members.select("id").union(centres.select("id")), "id", "left_anti")
    return members.union(centres.distinct()).union(single.select("id", F.col("id").alias("component")))
