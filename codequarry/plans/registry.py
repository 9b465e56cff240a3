"""Registered queries: a DataFrame job over the given tables and, where SQL can
say it, the same result as one SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codequarry.plans.bindings import BINDINGS
from codequarry.session import TASK_BYTES, dealt, materialize, shuffled, spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Tables of long texts: costly per row, so a single small file is spread over the cores.
TEXT_TABLES = ("documents", "pages")

# Views that make long texts of narrow rows, with the tables whose rows are dealt out first.
MADE_LONG = {"b_source": ("orders",)}

# Views that join tables growing with the input, with those that are not to be sent through the driver.
JOINED = {"b_calls": ("part",), "b_imports": ("part",)}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The tables below one folder, and the views bound to them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.written: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(table) if name in TEXT_TABLES else table
        if name in BINDINGS:
            if name in MADE_LONG:
                return self.spread_out(name, *MADE_LONG[name])
            return self.sql(BINDINGS[name], **{table: shuffled(getattr(self, table)) for table in JOINED.get(name, ())})
        raise AttributeError(name)

    def spread_out(self, name: str, *tables: str) -> DataFrame:
        """A view in front of costly row functions, the rows of its tables dealt out first."""
        return self.sql(BINDINGS[name], **{table: dealt(getattr(self, table)) for table in tables})

    def once(self, name: str) -> DataFrame:
        """A view that several joins of a query read, written out at the first of them."""
        if name not in self.written:
            self.written[name] = materialize(getattr(self, name), name, TASK_BYTES)
        return self.written[name]

    def sql(self, text: str, **given: DataFrame) -> DataFrame:
        """Run SQL in which ``{name}`` stands for a bound view; a table may be given in another form."""
        text = expand(text)
        frames = {t: given[t] if t in given else getattr(self, t) for t in TABLES if re.search(rf"\b{t}\b", text)}
        literal = text.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b", r"\1 {\2}", literal), **frames)


def expand(text: str) -> str:
    """Replace ``{b_x}`` by the binding's SQL in parentheses, repeatedly."""
    while True:
        done = re.sub(r"\{(b_\w+)\}", lambda m: "(" + BINDINGS[m.group(1)].strip() + ")", text)
        if done == text:
            return done
        text = done


def query(name: str, sql: str | None = None):
    """Register a function of ``Inputs`` under ``name`` with its SQL twin."""

    def add(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = expand(sql).strip()
        return fn

    return add
