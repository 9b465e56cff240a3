"""Ranks and firsts per key that stay distributed when one key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.session import materialize


def _cols(items) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in items]


def first_per_key(df: DataFrame, by: list[str], order: list[Column | str], last: bool = False) -> DataFrame:
    """The row of each key that comes first (or last) in ``order``; NULLs order first.

    A plain aggregate: map tasks reduce each key to one row before the shuffle.
    """
    rest = [c for c in df.columns if c not in by]
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*rest), F.struct(*_cols(order))).alias("row")
    picked = df.groupBy(*by).agg(row)
    return picked.select(*by, *[F.col("row")[c].alias(c) for c in rest]).select(*df.columns)


def top_n(df: DataFrame, by: list[str], order: list[Column | str], n: int | None, name: str = "rank") -> DataFrame:
    """First ``n`` rows of each key with their rank; all rows where ``n`` is None.

    The rank filter lets Spark cut every key to ``n`` rows in each map task
    before the shuffle, so a hot key sends at most ``n`` rows per task.  Spark
    does so up to a threshold; larger ``n`` use ``positions``.
    """
    order = _cols(order)
    if n is None:
        return positions(df, by, order, name)
    if not by:
        df = df.orderBy(*order).limit(n)
    elif n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return positions(df, by, order, name).where(F.col(name) <= n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, rank.cast("bigint")).where(F.col(name) <= n)


def positions(df: DataFrame, by: list[str], order: list[Column | str], name: str = "position") -> DataFrame:
    """Exact 1-based position of every row within its key, without a task per key.

    Rows are range-partitioned on (key, order), so a hot key spreads over many
    partitions; each partition numbers its own rows and adds the row counts of
    the key's earlier partitions.  The partitioning is written out first: a
    recomputed range partitioning could cut elsewhere.  ``order`` must be unique
    within a key.
    """
    order = _cols(order)
    spread = [F.col(c) for c in by] + order
    ranged = df.repartitionByRange(*spread).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    local = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order))
    sizes = ranged.groupBy("__part", *by).agg(F.count(F.lit(1)).alias("__size"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    keys = ["__part", *by]
    offsets = sizes.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
    same = [F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in keys]
    numbered = ranged.withColumn("__local", local).join(offsets, same)
    return numbered.select(*df.columns, (F.col("__local") + F.col("__before")).cast("bigint").alias(name))
