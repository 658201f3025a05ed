"""Work that must grow no faster than the tables."""

import re

import compare

from tessel import plans


def made(spark, df) -> int:
    """The most rows that a step makes while df, not collected before, is collected."""
    df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    run = store.executionsList().last().executionId()
    values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
    metrics = [m for i in range(nodes.size()) for m in (nodes.apply(i).metrics().apply(j) for j in range(nodes.apply(i).metrics().size()))]
    found = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
    return max(int(re.sub(r"\D", "", x.get())) for x in found if x.isDefined())


def test_row_values_are_sought_without_the_subquerys_product(spark, tmp_path):
    n, sf = 600, str(tmp_path)
    key = "CAST(nullif(id % 550, 7) AS BIGINT)"  # null keys, and keys that occur twice with different values
    spark.range(n).selectExpr(f"{key} AS p_partkey", "CAST(nullif(id DIV 500, 2) AS INT) AS p_size").write.parquet(f"{sf}/part.parquet")
    spark.range(n).selectExpr(f"{key} AS s_suppkey", "CAST(if(id % 9 = 0, NULL, id DIV 550) AS INT) AS s_nationkey").write.parquet(f"{sf}/supplier.parquet")
    lines = spark.range(n).selectExpr("id AS l_orderkey", "CAST(1 AS INT) AS l_linenumber", "nullif(id, 11) AS l_partkey", "nullif(id * 7 % 560, 21) AS l_suppkey")
    lines.union(lines).write.parquet(f"{sf}/lineitem.parquet")
    assert made(spark, plans.QUERIES["predicate_row_value_in"](spark, sf)) <= 4 * n
    df = plans.QUERIES["predicate_row_value_in"](spark, sf)
    assert not compare.differences(df, compare.connect(sf), plans.ORACLE_SQL["predicate_row_value_in"])
    assert 0 < df.count() < 2 * n


def test_a_sketch_is_of_the_table_not_of_each_value(spark, tmp_path, capsys):
    sf = str(tmp_path)
    spark.range(30_000).selectExpr("nullif(id % 9001, 5) AS o_custkey").write.parquet(f"{sf}/orders.parquet")
    df = plans.QUERIES["approx_distinct"](spark, sf)
    capsys.readouterr()
    df.explain()
    steps = [x for x in capsys.readouterr().out.splitlines() if "approx_count_distinct" in x and "Aggregate" in x]
    assert steps and all("keys=[]" in x for x in steps)
    assert df.columns == ["close"] and [tuple(r) for r in df.collect()] == [(True,)]
