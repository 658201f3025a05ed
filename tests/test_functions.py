"""Edges of the recipes: nulls, empty values, bounds, errors."""

import pytest
from pyspark.sql import functions as F

from tessel.functions import collections as C
from tessel.functions import datetimes as D
from tessel.functions import numbers as N
from tessel.functions import strings as S
from tessel.functions import textsearch as TS
from tessel.operators import relational as R
from tessel.operators import statements as ST
from tessel.operators import versions as V


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_substr_before_the_start(spark):
    x = F.lit("abcdef")
    assert one(spark, S.substr(x, 0, 2), S.substr(x, -1, 3), S.substr(x, 2), S.substr(x, 1, 0), S.substr(x, 9, 2), S.substr(x, 1, -1)) == ("a", "a", "bcdef", "", "", None)


def test_split_and_format(spark):
    x = F.lit("a,b,c")
    assert one(spark, S.split_part(x, ",", -2), S.split_part(x, ",", 7), S.split_part(x, "", 1)) == ("b", "", "a,b,c")
    with pytest.raises(ValueError):
        S.split_part(x, ",", 0)
    assert one(spark, S.format("%I %L %s|%5s|%-3s|%%", F.lit("My col"), F.lit(None), F.lit(None), F.lit("ab"), F.lit("x")))[0] == '"My col" NULL |   ab|x  |%'
    with pytest.raises(ValueError):
        S.format("%s %s", x)
    assert one(spark, S.string_to_array(x, None), S.string_to_array(F.lit(""), ","), S.string_to_array(x, "")) == (["a", ",", "b", ",", "c"], [], ["a,b,c"])


def test_numbers(spark):
    assert one(spark, N.divide(F.lit(-7), F.lit(2)), N.remainder(F.lit(-7), F.lit(2)), N.to_integer(F.lit("2.5")), N.to_integer(F.lit("-2.5")), N.float_to_integer(F.lit(2.5))) == (-3, -1, 3, -3, 2)


def test_date_trunc(spark):
    t = F.lit("2000-12-31 10:11:12").cast("timestamp")
    assert [str(x) for x in one(spark, D.date_trunc("decade", t), D.date_trunc("century", t), D.date_trunc("millennium", t))] == ["2000-01-01 00:00:00", "1901-01-01 00:00:00", "1001-01-01 00:00:00"]
    with pytest.raises(ValueError):
        D.date_trunc("fortnight", t)


def test_arrays_and_ranges(spark):
    a = F.array(F.lit(5), F.lit(None), F.lit(7))
    assert one(spark, C.subscript(a, 0), C.subscript(a, 3), C.subscript(a, 4), C.array_position(a, 9)) == (None, 7, None, None)
    with pytest.raises(ValueError):
        C.series(F.lit(1), F.lit(2), 0)
    assert one(spark, C.series(F.lit(3), F.lit(1)), C.subscripts(a, True)) == ([], [3, 2, 1])


def test_text_search_grammar():
    assert TS.to_tsquery("a & (b | !c)").numnode() == 6
    assert TS.to_tsquery("the", "english").node is None
    assert TS.websearch_to_tsquery('"x y" or -z').node[0] == "or"
    with pytest.raises(ValueError):
        TS.to_tsquery("(a & b")


def test_recursive_union_ends_on_a_cycle(spark):
    seed = spark.createDataFrame([(1,), (1,)], "x int")
    assert sorted(r.x for r in R.recursive_union(seed, lambda d: d.selectExpr("x % 4 + 1 AS x")).collect()) == [1, 2, 3, 4]
    with pytest.raises(RuntimeError):
        R.recursive_union(seed, lambda d: d.selectExpr("x + 1 AS x"), rounds=3)


def test_aggregates_on_nothing(spark):
    none = spark.createDataFrame([], "k int, x string")
    assert none.agg(R.array_agg(F.col("x"), F.col("k")).alias("a"), R.string_agg(F.col("x"), ",").alias("s")).first() == (None, None)


def test_upsert_refuses_two_new_rows_for_one_key(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    with pytest.raises(Exception, match="second time"):
        ST.insert_on_conflict_update(old, new, ["k"], {"v": F.col("excluded_v")}).collect()
    assert ST.insert_on_conflict_nothing(old, new, ["k"]).count() == 1


def test_deleted_versions_stay_deleted(spark):
    rows = spark.createDataFrame([(1, "a", 1, False), (1, None, 2, True), (2, "b", 1, False)], "k int, v string, commit_ts long, deleted boolean")
    assert [r.k for r in V.as_of(rows, ["k"], F.lit(2)).collect()] == [2]
    assert sorted(r.k for r in V.as_of(V.flashback(rows, ["k"], F.lit(1).cast("long"), F.lit(9).cast("long")), ["k"], F.lit(9)).collect()) == [1, 2]


def test_columnar_round_trip(spark, tmp_path):
    from tessel.sources import tables as TB

    df = spark.range(1000).selectExpr("id", "id % 3 AS p", "cast(id as string) AS s")
    TB.write_columnar(df, str(tmp_path / "x"), partition_by=["p"], sort_by=["id"])
    assert spark.read.parquet(str(tmp_path / "x")).where("p = 1 AND id < 100").count() == 33
    df.write.option("header", True).csv(str(tmp_path / "c"))
    df.write.json(str(tmp_path / "j"))
    df.write.orc(str(tmp_path / "o"))
    assert TB.read_csv(spark, str(tmp_path / "c"), "id long, p long, s string").count() == TB.read_json(spark, str(tmp_path / "j"), "id long").count() == TB.read_orc(spark, str(tmp_path / "o")).count() == 1000
    with pytest.raises(Exception, match="no partition"):
        TB.route(df, "p", lists={"a": [0, 1]}).collect()


def test_merge_with_two_source_rows_for_one_target_is_an_error(spark):
    from tessel.operators import statements as ST

    target = spark.createDataFrame([(1, 1), (2, 2)], "k int, v int")
    assign = {"v": F.col("source_v")}
    with pytest.raises(Exception, match="second time"):
        ST.merge(target, spark.createDataFrame([(1, 5), (1, 6)], "k int, v int"), ["k"], assign).collect()
    new = spark.createDataFrame([(1, 5), (3, 6), (3, 7)], "k int, v int")
    assert sorted(map(tuple, ST.merge(target, new, ["k"], assign).collect())) == [(1, 5), (2, 2), (3, 6), (3, 7)]


def test_jsonb_keeps_digits(spark):
    from tessel.functions import jsonb as J

    v = spark.createDataFrame([("[12345678901234567890.123, 1e2, 1.50, -0.0]", '{"a": 100}')], "a string, b string")
    assert v.select(J.jsonb_concat("a", "b")).first()[0] == '[12345678901234567890.123, 100, 1.50, 0.0, {"a": 100}]'
    assert v.select(J.jsonb_contains("a", F.lit("[100.0]"))).first()[0]


def test_constraints_raise(spark):
    rows = spark.createDataFrame([(1, 1), (2, None), (2, 5)], "k int, v int")
    for message, kwargs in (("not-null", {"not_null": ["v"]}), ("check", {"checks": {"c": F.col("v") > 3}}), ("duplicate key", {"unique": [["k"]]})):
        with pytest.raises(Exception, match=message):
            ST.enforce(rows, **kwargs).collect()
    assert ST.enforce(rows.where("k = 1"), ["v"], {"c": F.col("v") > 0}, [["k"]]).count() == 1
    with pytest.raises(Exception, match="foreign key"):
        ST.delete_referenced(rows, rows.withColumnRenamed("k", "r"), F.col("k") == 1, "k", "r")[1].collect()
    with pytest.raises(ValueError, match="does not exist"):
        ST.alter(rows, drop=["x"])
