"""Names, Spark plans and DuckDB SQL of the inventory's queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessel.sources.tables import TABLES, table, zoned

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder as attributes: t.orders."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return zoned(table(self.spark, self.sf_dir, name))

    def sql(self, text: str, **more) -> DataFrame:
        """Spark SQL in which {orders} stands for a table and {0}-like names for what is given."""
        named = {n: getattr(self, n) for n in re.findall(r"\{(\w+)\}", text) if n not in more}
        return self.spark.sql(text, **named, **more)

    def values(self, rows: str, schema: str) -> DataFrame:
        """Literal rows: the text between VALUES and AS."""
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS v({schema})")


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a plan (a function of Tables), with its oracle's SQL where SQL can say it."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def sql_query(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """A query whose Spark form is SQL; {orders} stands for a table. Without an oracle of its own the same text serves."""
    query(name, oracle or re.sub(r"\{(\w+)\}", r"\1", spark_sql))(lambda t: t.sql(spark_sql))
