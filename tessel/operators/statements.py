"""Statements that change rows, as rewrites from the old rows to the new ones; the caller overwrites or appends the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(target: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    missing = {c: (defaults or {}).get(c, F.lit(None)).cast(t) for c, t in target.dtypes if c not in rows.columns}
    return target.unionByName(rows.withColumns(missing).select(*target.columns))


def insert_on_conflict_nothing(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is there already, or came before among the new rows, are left out."""
    return target.unionByName(rows.dropDuplicates(key).join(target.select(*key), key, "left_anti").select(*target.columns))


def insert_on_conflict_update(target: DataFrame, rows: DataFrame, key: list[str], assign: dict[str, Column]) -> DataFrame:
    """assign may use the old row's columns and the new row's as excluded_<column>. Two new rows with one key are an error."""
    new = rows.select(*key, F.struct(*target.columns).alias("__new"), F.count("*").over(_by(key)).alias("__n"))
    new = new.withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.lit("ON CONFLICT DO UPDATE command cannot affect row a second time"))).otherwise(F.col("__n")))
    old = target.withColumn("__old", F.lit(True))
    x = old.join(new, key, "full").withColumns({f"excluded_{c}": F.col(f"__new.{c}") for c in target.columns})
    hit = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    out = [F.when(F.col("__old").isNull(), F.col(f"__new.{c}")).when(hit & F.col("__n").isNotNull(), assign.get(c, F.col(c))).otherwise(F.col(c)).alias(c) for c in target.columns]
    return x.select(*out)


def _by(key: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*key)


def update(target: DataFrame, where: Column, assign: dict[str, Column]) -> DataFrame:
    """Every assignment sees the old row; only rows where the condition is true change."""
    hit = F.coalesce(where, F.lit(False))
    return target.select(*(F.when(hit, assign[c].cast(t)).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c, t in target.dtypes))


def update_from(target: DataFrame, source: DataFrame, key: list[str], assign: dict[str, Column]) -> DataFrame:
    """UPDATE .. FROM: source rows by key, its columns named source_<column>. Of several rows with one key the smallest is taken
    (any one is allowed, and this one is the same each time)."""
    rest = [c for c in source.columns if c not in key]
    one = source.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__one")) if rest else source.select(*key).distinct()
    one = one.select(*key, F.lit(True).alias("__hit"), *(F.col(f"__one.{c}").alias(f"source_{c}") for c in rest))
    x = target.join(one, key, "left")
    return x.select(*(F.when(F.col("__hit"), assign[c].cast(t)).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c, t in target.dtypes))


def delete(target: DataFrame, where: Column) -> DataFrame:
    return target.where(~F.coalesce(where, F.lit(False)))


def delete_using(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    return target.join(source.select(*key).distinct(), key, "left_anti")


def truncate(target: DataFrame) -> DataFrame:
    return target.limit(0)


def merge(target: DataFrame, source: DataFrame, key: list[str], matched: dict[str, Column] | None, insert_new: bool = True) -> DataFrame:
    """MERGE with one matched and one not matched clause; matched None deletes. Two source rows for one row of the target are an error."""
    twice = F.when(F.count("*").over(_by(key)) > 1, F.raise_error(F.lit("MERGE command cannot affect row a second time")).cast("boolean")).otherwise(F.lit(True))
    met = source.join(target.select(*key).distinct(), key, "left_semi").withColumn("__once", twice).where("__once").drop("__once")
    new = source.join(target.select(*key), key, "left_anti")
    kept = delete_using(target, met, key) if matched is None else update_from(target, met, key, matched)
    return kept.unionByName(new.select(*target.columns)) if insert_new else kept


def violations(df: DataFrame, not_null: list[str] = (), unique: list[list[str]] = (), checks: dict[str, Column] | None = None, references: tuple[str, DataFrame, str] | None = None) -> DataFrame:
    """(constraint, rows): how many rows break each constraint; a check that is unknown holds."""
    parts = [df.where(F.col(c).isNull()).agg(F.lit(f"{c} not null").alias("constraint"), F.count("*").alias("rows")) for c in not_null]
    for key in unique:
        seen = df.dropna(subset=key).groupBy(*key).count().where("count > 1")
        parts.append(seen.agg(F.lit(f"unique {', '.join(key)}").alias("constraint"), F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("rows")))
    parts += [df.where(~F.coalesce(c, F.lit(True))).agg(F.lit(f"check {n}").alias("constraint"), F.count("*").alias("rows")) for n, c in (checks or {}).items()]
    if references:
        column, parent, parent_column = references
        lost = df.dropna(subset=[column]).join(parent.select(F.col(parent_column).alias("__p")).distinct(), F.col(column) == F.col("__p"), "left_anti")
        parts.append(lost.agg(F.lit(f"{column} references").alias("constraint"), F.count("*").alias("rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def enforce(df: DataFrame, not_null: list[str] = (), checks: dict[str, Column] | None = None, unique: list[list[str]] = ()) -> DataFrame:
    """The rows, if all of them keep the constraints; else the first that is found to break one is an error with PostgreSQL's message."""
    broken = [(F.col(c).isNull(), f'null value in column "{c}" violates not-null constraint') for c in not_null]
    broken += [(~F.coalesce(c, F.lit(True)), f'new row violates check constraint "{n}"') for n, c in (checks or {}).items()]
    broken += [((F.count("*").over(_by(key)) > 1) & F.concat(*(F.col(k).cast("string") for k in key)).isNotNull(), f"duplicate key value violates unique constraint on ({', '.join(key)})") for key in unique]
    if not broken:
        return df
    ok = F.lit(True)
    for test, message in broken:
        ok = F.when(test, F.raise_error(F.lit(message)).cast("boolean")).otherwise(ok)
    return df.withColumn("__ok", ok).where("__ok").drop("__ok")


def delete_referenced(parent: DataFrame, child: DataFrame, gone: Column, key: str, foreign: str, action: str = "NO ACTION") -> tuple[DataFrame, DataFrame]:
    """DELETE of parent rows under a foreign key with ON DELETE CASCADE, SET NULL, or NO ACTION / RESTRICT (an error if a child is left)."""
    hit = parent.where(F.coalesce(gone, F.lit(False))).select(F.col(key).alias("__gone")).distinct()
    left, met = delete(parent, gone), F.col(foreign) == F.col("__gone")
    if action == "CASCADE":
        return left, child.join(hit, met, "left_anti")
    marked = child.join(hit, met, "left")
    if action == "SET NULL":
        return left, marked.withColumn(foreign, F.when(F.col("__gone").isNull(), F.col(foreign))).select(*child.columns)
    error = F.when(F.col("__gone").isNotNull(), F.raise_error(F.lit("update or delete violates foreign key constraint")).cast("boolean")).otherwise(F.lit(True))
    return left, marked.withColumn("__ok", error).where("__ok").select(*child.columns)


def exclude(df: DataFrame, key: list[str], low: str, high: str) -> DataFrame:
    """EXCLUDE (key WITH =, range WITH &&): rows whose half-open range overlaps an earlier one's of their key. Empty: it holds."""
    from pyspark.sql import Window

    before = Window.partitionBy(*key).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    return df.where(F.col(low) < F.col(high)).withColumn("__end", F.max(high).over(before)).where(F.col("__end") > F.col(low)).drop("__end")


def alter(df: DataFrame, add: dict[str, Column] | None = None, drop: list[str] = (), rename: dict[str, str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """ALTER TABLE: columns retyped (casts that fail are errors), dropped, renamed, and added with their defaults at the end."""
    lost = [c for c in (*drop, *(rename or {}), *(types or {})) if c not in df.columns]
    if lost:
        raise ValueError(f'column "{lost[0]}" does not exist')
    taken = [c for c in (add or {}) if c in df.columns and c not in drop]
    if taken:
        raise ValueError(f'column "{taken[0]}" of relation already exists')
    kept = [F.col(c).cast((types or {})[c]).alias((rename or {}).get(c, c)) if c in (types or {}) else F.col(c).alias((rename or {}).get(c, c)) for c in df.columns if c not in drop]
    return df.select(*kept, *(x.alias(c) for c, x in (add or {}).items()))


class MaterializedView:
    """A stored SELECT's rows; refresh() stores them anew in a folder of their own and then points to it."""

    def __init__(self, plan, write):
        self.plan, self.write = plan, write
        self.rows = write(plan())

    def refresh(self) -> DataFrame:
        self.rows = self.write(self.plan())
        return self.rows


class Sequences:
    """nextval, currval, setval and lastval: counters of the driver's session."""

    def __init__(self):
        self.state: dict[str, tuple[int, bool]] = {}
        self.last: str | None = None

    def create(self, name: str, start: int = 1) -> None:
        self.state[name] = (start, False)

    def nextval(self, name: str) -> int:
        value, called = self.state[name]
        value = value + 1 if called else value
        self.state[name], self.last = (value, True), name
        return value

    def currval(self, name: str) -> int:
        value, called = self.state[name]
        if not called:
            raise ValueError(f'currval of sequence "{name}" is not yet defined in this session')
        return value

    def setval(self, name: str, value: int, called: bool = True) -> int:
        self.state[name] = (value, called)
        return value

    def lastval(self) -> int:
        if self.last is None:
            raise ValueError("lastval is not yet defined in this session")
        return self.state[self.last][0]

    def read(self, spark, name: str) -> DataFrame:
        """SELECT last_value, is_called FROM the sequence."""
        return spark.createDataFrame([self.state[name]], "last_value bigint, is_called boolean")
