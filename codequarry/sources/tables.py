"""Keyed and whole-table writes, and tables as Markdown lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from codequarry.functions.ranking import first_per_key
from codequarry.session import materialize


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str], keep_if_null: list[str] = []) -> DataFrame:
    """The target after writing ``batch`` into it.

    One row per key, the last batch row in ``order`` wins (without an order the
    batch has one); a written NULL overwrites, except in the ``keep_if_null`` columns.
    """
    latest = first_per_key(batch, keys, order, last=True) if order else batch
    values = [c for c in target.columns if c not in keys]
    new = latest.select(*keys, F.struct(*values).alias("__new"))
    old = target.select(*keys, F.struct(*values).alias("__old"))
    merged = old.join(new, keys, "full_outer")

    def value(column):
        fresh, kept = F.col("__new")[column], F.col("__old")[column]
        if column in keep_if_null:
            return F.coalesce(fresh, kept).alias(column)
        return F.when(F.col("__new").isNotNull(), fresh).otherwise(kept).alias(column)

    return merged.select(*keys, *[value(c) for c in values]).select(*target.columns)


class KeyedTable:
    """A table of one row per key in hash buckets, of which a write replaces only those whose rows change.

    Buckets are folders of ``path``.  A write reads and rewrites the buckets of its keys and leaves the files of all others
    as they are; run again it changes nothing.  A DataFrame that was read before a write may miss its files.
    """

    BUCKET = "key_bucket"

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    def exists(self) -> bool:
        try:
            self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(self.BUCKET, IntegerType())])
        if not self.exists():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def _write(self, df: DataFrame) -> None:
        # partitions of one bucket each; one that is large is split at run time
        dealt = self._bucketed(df.select(*self.schema.names)).hint("rebalance", self.BUCKET)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.BUCKET).parquet(self.path)

    def create(self, df: DataFrame) -> None:
        """The first rows, one per key."""
        self._write(df)

    def read(self) -> DataFrame:
        return self._stored().drop(self.BUCKET)

    def upsert(self, batch: DataFrame, order: list[str] = [], keep_if_null: list[str] = [], insert_only: bool = False) -> None:
        """Write ``batch`` into the table, see ``upsert``; with ``insert_only`` known keys keep their rows.

        Without ``order`` the batch has one row per key.
        """
        if not self.exists():
            return self._write(first_per_key(batch, self.keys, order, last=True) if order else batch)
        batch = materialize(self._bucketed(batch), "upsert")
        if insert_only:
            known = self._stored().where(F.col(self.BUCKET).isin(self._buckets_of(batch))).select(*self.keys)
            batch = materialize(batch.join(known, self.keys, "left_anti").select(*batch.columns), "inserted")
        touched = self._buckets_of(batch)
        if not touched:
            return
        stored = self._stored().where(F.col(self.BUCKET).isin(touched)).drop(self.BUCKET)
        self._write(upsert(stored, batch.drop(self.BUCKET), self.keys, order, keep_if_null))

    def _buckets_of(self, batch: DataFrame) -> list[int]:
        return [r[0] for r in batch.select(self.BUCKET).distinct().collect()]  # no more than there are buckets


def overwrite(df: DataFrame, path: str, partition_by: list[str] = []) -> DataFrame:
    """Replace everything at ``path`` and read it back."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def to_markdown(df: DataFrame, place: str) -> DataFrame:
    """Lines of a Markdown table with their line numbers; ``place`` numbers the rows from 1.

    The first two lines are the header and its rule; an empty table is one
    sentence.  Cells are written as they are.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c != place]
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns]
    body = df.select(
        (F.col(place) + 1).cast("bigint").alias("line_no"),
        F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"),
    )
    header = "| " + " | ".join(columns) + " |"
    rule = "|" + "|".join([" --- "] * len(columns)) + "|"
    any_row = F.lit(1)
    # one row when the table has rows, so no count over the data is needed
    present = df.limit(1).agg((F.count(any_row) > 0).alias("filled"))
    lines = F.when(
        F.col("filled"),
        F.array(F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit(header).alias("line")),
                F.struct(F.lit(1).cast("bigint").alias("line_no"), F.lit(rule).alias("line"))),
    ).otherwise(F.array(F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit("No data available.").alias("line"))))
    return present.select(F.inline(lines)).union(body)


def write_markdown(lines: DataFrame, path: str) -> None:
    """Lines in order as text files, part by part."""
    lines.orderBy("line_no").select("line").write.mode("overwrite").text(path)
