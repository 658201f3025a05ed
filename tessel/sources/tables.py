"""Tables on Parquet: reading, views, columnar writing, partitions, versions merged on read, and the catalog's views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zoned(df: DataFrame) -> DataFrame:
    """Timestamps without zone taken as UTC instants (streams and microsecond functions need instants)."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def scan(parent: DataFrame, *children: DataFrame) -> DataFrame:
    """A table with its inheriting children: the parent's columns of all."""
    for child in children:
        parent = parent.unionByName(child.select(*parent.columns))
    return parent


def write_columnar(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """LZ4 Parquet; sorting inside files makes the row groups' minima and maxima narrow, so scans can skip them."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.mode(mode).option("compression", "lz4_raw")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def merged_scan(runs: list[DataFrame], key: list[str], at: Column, commit: str = "commit_ts", deleted: str = "deleted") -> DataFrame:
    """Several runs of versions, the newest visible one of each key."""
    from tessel.operators.versions import as_of

    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run)
    return as_of(every, key, at, commit, deleted)


def route(df: DataFrame, column: str, lists: dict[str, list] | None = None, ranges: dict[str, tuple] | None = None, default: str | None = None) -> DataFrame:
    """A column `partition` with the child that each row belongs to; rows of no child are an error without a default."""
    x = F.col(column)
    out = F.lit(default) if default else F.raise_error(F.concat(F.lit("no partition of relation found for row: "), F.coalesce(x.cast("string"), F.lit("null"))))
    for name, values in (lists or {}).items():
        out = F.when(x.isin(values), F.lit(name)).otherwise(out)
    for name, (lo, hi) in (ranges or {}).items():
        out = F.when((x >= F.lit(lo)) & (x < F.lit(hi)), F.lit(name)).otherwise(out)
    return df.withColumn("partition", out)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=header)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


_NAMES = {"bigint": "bigint", "int": "integer", "smallint": "smallint", "string": "text", "double": "double precision", "float": "real", "boolean": "boolean", "binary": "bytea", "timestamp": "timestamp with time zone", "date": "date"}


def type_name(spark_type: str) -> str:
    """The SQL name of a Spark type, as pg_typeof and format_type show it."""
    if spark_type.startswith("decimal"):
        return "numeric" + spark_type[len("decimal") :]
    if spark_type.startswith("array<"):
        return type_name(spark_type[6:-1]) + "[]"
    return _NAMES.get(spark_type, spark_type)


def columns_view(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """information_schema.columns of the given tables."""
    rows = [(name, f.name, i + 1, "YES" if f.nullable else "NO", type_name(f.dataType.simpleString())) for name, df in tables.items() for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")


def tables_view(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    return spark.createDataFrame([("public", n, "BASE TABLE") for n in tables], "table_schema string, table_name string, table_type string")


def index_views(spark: SparkSession, indexes: dict[str, tuple[str, list[str], bool]]) -> DataFrame:
    """pg_indexes from (name -> table, columns, unique); indexes are layout hints here."""
    rows = [("public", t, n, f"CREATE {'UNIQUE ' if u else ''}INDEX {n} ON public.{t} USING btree ({', '.join(c)})") for n, (t, c, u) in indexes.items()]
    return spark.createDataFrame(rows, "schemaname string, tablename string, indexname string, indexdef string")
