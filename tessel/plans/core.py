"""Scans, projections, predicates, joins, subqueries, aggregates, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import collections as C
from tessel.functions import numbers as N
from tessel.functions import strings as S
from tessel.operators import relational as R
from tessel.sources import tables as TB

from .registry import query, sql_query

# ---------------------------------------------------------------- scans, sources

sql_query("scan_one_row", "SELECT 1 AS one, 'x' AS x")


@query("scan_sequential", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")


@query("scan_narrowed_range", "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
def _(t):
    return t.orders.where("o_orderkey >= 100 AND o_orderkey < 900").select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("scan_point_get", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 7")
def _(t):
    return t.customer.where("c_custkey = 7").select("c_custkey", "c_name", "c_mktsegment")


@query("scan_index_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_name IN (SELECT c_name FROM customer WHERE c_custkey IN (3, 5))")
def _(t):
    return t.customer.join(t.customer.where("c_custkey IN (3, 5)").select("c_name"), "c_name", "left_semi").select("c_custkey", "c_name")


sql_query("scan_values", "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (NULL, 'c')) AS v(column1, column2)")


@query("scan_inherited", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def _(t):
    parent = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    child = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(1).alias("more"))
    return TB.scan(parent, child)


@query("scan_columnar_fragment", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-17 00:00:00'")
def _(t):
    return t.lineitem.where("l_shipdate < TIMESTAMP '1995-06-17 00:00:00'").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("scan_columnar_rows_limit", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 ORDER BY l_orderkey, l_linenumber LIMIT 20")
def _(t):
    return t.lineitem.where("l_quantity > 45").select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber").limit(20)


_VERSIONS = "SELECT o_orderkey AS k, o_custkey AS v, CAST(1 AS BIGINT) AS commit_ts, false AS deleted FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1, 2, false FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, NULL, 3, true FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, o_custkey + 9, 9, false FROM orders"


def versions(t):
    o = t.orders
    first = o.selectExpr("o_orderkey AS k", "o_custkey AS v", "CAST(1 AS BIGINT) AS commit_ts", "false AS deleted")
    second = o.where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS k", "o_custkey + 1 AS v", "CAST(2 AS BIGINT) AS commit_ts", "false AS deleted")
    third = o.where("o_orderkey % 5 = 0").selectExpr("o_orderkey AS k", "CAST(NULL AS BIGINT) AS v", "CAST(3 AS BIGINT) AS commit_ts", "true AS deleted")
    fourth = o.selectExpr("o_orderkey AS k", "o_custkey + 9 AS v", "CAST(9 AS BIGINT) AS commit_ts", "false AS deleted")
    return [first, second, third, fourth]


@query("scan_columnar_merged", f"WITH x AS ({_VERSIONS}), y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY commit_ts DESC) AS rn FROM x WHERE commit_ts <= 3) SELECT k, v FROM y WHERE rn = 1 AND NOT deleted")
def _(t):
    return TB.merged_scan(versions(t), ["k"], F.lit(3))


@query("catalog_columns", "SELECT 'region' AS table_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal_position, CASE data_type WHEN 'INTEGER' THEN 'integer' ELSE 'text' END AS data_type FROM (VALUES ('r_regionkey', 1, 'INTEGER'), ('r_name', 2, 'VARCHAR')) AS v(column_name, ordinal_position, data_type)")
def _(t):
    return TB.columns_view(t.spark, {"region": t.region}).select("table_name", "column_name", "ordinal_position", "data_type")


@query("catalog_tables", "SELECT 'public' AS table_schema, n AS table_name, 'BASE TABLE' AS table_type FROM (VALUES ('nation'), ('region')) AS v(n)")
def _(t):
    return TB.tables_view(t.spark, {"nation": t.nation, "region": t.region})


@query("partition_routing", "SELECT CASE WHEN o_orderstatus IN ('F') THEN 'p_f' WHEN o_orderstatus IN ('O') THEN 'p_o' ELSE 'p_rest' END AS partition, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return TB.route(t.orders, "o_orderstatus", lists={"p_f": ["F"], "p_o": ["O"]}, default="p_rest").groupBy("partition").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- projections and predicates

_N = "(VALUES (1, 1, NULL, true), (2, NULL, 'x', NULL), (3, 3, 'y', false), (4, NULL, NULL, NULL)) AS n(id, a, t, f)"
sql_query("project_expressions", "SELECT o_orderkey AS k, o_custkey * 2 + 1 AS twice, upper(o_orderstatus) AS s, -o_custkey AS negative FROM {orders}")


@query("project_srf_lockstep", "SELECT g, a, b FROM (SELECT * FROM (VALUES (1, [1, 2, 3], ['x']), (2, [4], ['p', 'q']), (3, [], []::VARCHAR[])) AS v(g, x, y)) AS q, LATERAL (SELECT unnest(range(1, greatest(len(x), len(y)) + 1)) AS i) AS s, LATERAL (SELECT CAST(x[i] AS INTEGER) AS a, y[i] AS b) AS z")
def _(t):
    v = t.values("(1, array(1, 2, 3), array('x')), (2, array(4), array('p', 'q')), (3, cast(array() as array<int>), cast(array() as array<string>))", "g, x, y")
    return R.lockstep(v, a=F.col("x"), b=F.col("y")).select("g", "a", "b")


sql_query("predicate_three_valued", f"SELECT id, a > 2 AS gt, NOT f AS no, f AND a > 2 AS conj, f OR a > 2 AS disj FROM {_N}")
sql_query("predicate_filter_unknown", f"SELECT id FROM {_N} WHERE NOT (a > 2)")
sql_query("predicate_is_null", f"SELECT id, a IS NULL AS no_a, t IS NOT NULL AS has_t FROM {_N}")
sql_query("predicate_is_distinct_from", f"SELECT x.id AS i, y.id AS j FROM {_N} CROSS JOIN (VALUES (1, 1), (2, NULL)) AS y(id, a) WHERE x.a IS NOT DISTINCT FROM y.a".replace("AS n(", "AS x("))
sql_query("predicate_between", "SELECT o_orderkey FROM {orders} WHERE o_custkey BETWEEN 10 AND 60 AND o_custkey NOT BETWEEN 20 AND 30")
sql_query("predicate_in_list", f"SELECT id, a IN (1, 2) AS x, a IN (1, NULL) AS y, a NOT IN (3, NULL) AS z FROM {_N}")
sql_query("predicate_like", "SELECT p_partkey, p_name LIKE '%a_e%' AS l, p_type NOT LIKE 'S%' AS nl, p_name ILIKE '%A_E%' AS i FROM {part}")


@query("predicate_like_escape", r"SELECT s, s LIKE '%#_b%' ESCAPE '#' AS l FROM (VALUES ('a_b'), ('axb'), (NULL)) AS v(s)")
def _(t):
    return t.values("('a_b'), ('axb'), (NULL)", "s").select("s", S.like_escape(F.col("s"), "%#_b%", "#").alias("l"))


@query("predicate_regex", "SELECT doc_id, regexp_matches(text, '(?s)the.*of') AS m, regexp_matches(text, '(?is)IDIOT') AS i, NOT regexp_matches(text, '(?s)^The') AS nm FROM documents")
def _(t):
    x = F.col("text")
    return t.documents.select("doc_id", S.matches(x, "the.*of").alias("m"), S.matches(x, "IDIOT", True).alias("i"), (~S.matches(x, "^The")).alias("nm"))


@query("predicate_any_all_array", "SELECT id, CASE WHEN a IS NULL THEN NULL WHEN a = 1 THEN true ELSE NULL END AS eq_any, a <> 1 AND a <> 2 AS ne_all FROM (VALUES (1, 1), (2, NULL), (3, 3)) AS n(id, a)")
def _(t):
    v = t.values("(1, 1), (2, NULL), (3, 3)", "id, a")
    return v.select("id", C.any_of(F.array(F.lit(1), F.lit(None).cast("int")), lambda x: x == F.col("a")).alias("eq_any"), C.all_of(F.array(F.lit(1), F.lit(2)), lambda x: x != F.col("a")).alias("ne_all"))


sql_query("expression_case", f"SELECT id, CASE WHEN a > 2 THEN 'big' WHEN a IS NULL THEN 'none' ELSE 'small' END AS searched, CASE a WHEN 1 THEN 'one' WHEN 3 THEN 'three' END AS simple FROM {_N}")
sql_query("expression_coalesce", f"SELECT id, coalesce(t, CAST(a AS VARCHAR(9)), 'z') AS c FROM {_N}")


@query("expression_cast", "SELECT x, CAST(round(CAST(x AS DECIMAL(20, 4)), 0) AS BIGINT) AS from_numeric, CAST(x AS VARCHAR) AS as_text FROM (VALUES ('2.5'), ('-2.5'), ('3.49')) AS v(x)")
def _(t):
    v = t.values("('2.5'), ('-2.5'), ('3.49')", "x")
    return v.select("x", N.to_integer(F.col("x")).alias("from_numeric"), F.col("x").cast("string").alias("as_text"))


@query("expression_subscript", "SELECT vec_id, embedding[1] AS first, embedding[100000] AS beyond, CAST(NULL AS FLOAT) AS by_null FROM embeddings")
def _(t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", C.subscript(e, 1).alias("first"), C.subscript(e, 100000).alias("beyond"), C.subscript(e, F.lit(None).cast("int")).alias("by_null"))


@query("expression_parameters", "SELECT count(*) AS n FROM orders WHERE o_custkey = 42 OR o_orderstatus = 'P'")
def _(t):
    return t.spark.sql("SELECT count(*) AS n FROM {o} WHERE o_custkey = :k OR o_orderstatus = :s", args={"k": 42, "s": "P"}, o=t.orders)



@query("predicate_row_value_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size = s_nationkey)")
def _(t):
    part, supplier = t.part.select("p_partkey", "p_size"), t.supplier.select("s_suppkey", "s_nationkey")
    return R.in_joined(t.lineitem, ("l_partkey", "l_suppkey"), part, supplier, ("p_size", "s_nationkey")).select("l_orderkey", "l_linenumber")


sql_query("expression_collate", "SELECT n_name FROM {nation} WHERE n_name COLLATE UTF8_BINARY < 'G'", "SELECT n_name FROM nation WHERE n_name < 'G'")

# ---------------------------------------------------------------- joins

sql_query("join_inner", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_acctbal > 0")
sql_query("join_left", "SELECT c_custkey, count(o_orderkey) AS orders FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
sql_query("join_right", "SELECT c_custkey, count(o_orderkey) AS n FROM {orders} RIGHT JOIN {customer} ON o_custkey = c_custkey GROUP BY c_custkey")
sql_query("join_full", "SELECT n_name, s_suppkey FROM {nation} FULL JOIN (SELECT * FROM {supplier} WHERE s_acctbal > 5000) AS s ON n_nationkey = s_nationkey AND n_regionkey < 3")
sql_query("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
sql_query("join_comma_list", "SELECT n_name, r_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey")


@query("join_using", "SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id)")
def _(t):
    return t.documents.join(t.labels, ["doc_id"]).select("doc_id", "lang", "toxic")


sql_query("join_natural", "SELECT doc_id, quality, source FROM {documents} NATURAL JOIN {labels}")
sql_query("join_theta", "SELECT a.r_name AS a, b.r_name AS b FROM {region} AS a JOIN {region} AS b ON a.r_regionkey < b.r_regionkey")
sql_query("join_self", "SELECT a.c_custkey AS x, b.c_custkey AS y FROM {customer} AS a JOIN {customer} AS b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey <= 200")
sql_query("join_self_whole", "SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM {orders} AS a JOIN {orders} AS b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey")
sql_query("join_n_way", "SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
sql_query("join_null_keys", "SELECT x.i AS i, y.j AS j FROM (VALUES (1, 5), (2, NULL)) AS x(i, k) LEFT JOIN (VALUES (7, 5), (8, NULL)) AS y(j, k) ON x.k = y.k")
sql_query("join_lateral_unnest", "SELECT v.id AS id, u.x AS x FROM (VALUES (1, array(1, 2)), (2, cast(array() as array<int>)), (3, NULL)) AS v(id, a) LATERAL VIEW explode(a) u AS x", "SELECT id, unnest(a) AS x FROM (VALUES (1, [1, 2]), (2, []), (3, NULL)) AS v(id, a)")
sql_query("join_lateral_outer", "SELECT v.id AS id, u.x AS x FROM (VALUES (1, array(1, 2)), (2, cast(array() as array<int>)), (3, NULL)) AS v(id, a) LATERAL VIEW OUTER explode(a) u AS x", "SELECT v.id, u.x FROM (VALUES (1, [1, 2]), (2, []), (3, NULL)) AS v(id, a) LEFT JOIN LATERAL (SELECT unnest(v.a) AS x) AS u ON true")
sql_query("join_lateral_subquery", "SELECT r_name, x.n AS n FROM {region}, LATERAL (SELECT count(*) AS n FROM {nation} WHERE n_regionkey = r_regionkey) AS x")


@query("join_as_of", "SELECT o_orderkey, e.event_id FROM (SELECT o_orderkey, o_custkey AS user_id, TIMESTAMP '2024-01-10 00:00:00' + INTERVAL 1 HOUR * (o_orderkey % 300) AS at FROM orders) AS o ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY user_id, ts) AS e ON o.user_id = e.user_id AND e.ts <= o.at")
def _(t):
    o = t.orders.selectExpr("o_orderkey", "o_custkey AS user_id", "TIMESTAMP '2024-01-10 00:00:00' + make_interval(0, 0, 0, 0, cast(o_orderkey % 300 as int), 0, 0) AS at")
    e = t.events.groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return R.as_of_join(o, e, "user_id", "at", "ts", ["event_id"]).select("o_orderkey", "event_id")


@query("join_range", "SELECT p_partkey, b.id AS bucket FROM part JOIN (SELECT i AS id, CAST(i * 7 AS DOUBLE) AS lo, CAST(i * 7 + 10 AS DOUBLE) AS hi FROM range(0, 8) AS x(i)) AS b ON p_size >= lo AND p_size < hi")
def _(t):
    b = t.spark.range(8).selectExpr("id", "CAST(id * 7 AS DOUBLE) AS lo", "CAST(id * 7 + 10 AS DOUBLE) AS hi")
    return R.range_join(t.part.select("p_partkey", "p_size"), b, "p_size", "lo", "hi", 10.0).selectExpr("p_partkey", "id AS bucket")


# ---------------------------------------------------------------- subqueries

sql_query("subquery_exists", "SELECT c_custkey FROM {customer} AS c WHERE EXISTS (SELECT 1 FROM {orders} AS o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
sql_query("subquery_not_exists", "SELECT c_custkey FROM {customer} AS c WHERE NOT EXISTS (SELECT 1 FROM {orders} AS o WHERE o.o_custkey = c.c_custkey)")
sql_query("subquery_in", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 49)")
sql_query("subquery_not_in_nulls", "SELECT x FROM (VALUES (1), (2), (NULL)) AS v(x) WHERE x NOT IN (SELECT y FROM (VALUES (2), (NULL)) AS w(y))")
sql_query("subquery_not_in_empty", "SELECT x FROM (VALUES (1), (NULL)) AS v(x) WHERE x NOT IN (SELECT r_regionkey FROM {region} WHERE r_regionkey > 99)")


@query("subquery_any_all", "SELECT x, x > ANY (SELECT y FROM (VALUES (2), (5), (NULL)) AS w(y)) AS some, x > ALL (SELECT y FROM (VALUES (2), (5), (NULL)) AS w(y)) AS every FROM (VALUES (1), (3), (9), (NULL)) AS v(x)")
def _(t):
    some, every = R.any_quantifier(F.col("x"), ">", t.values("(2), (5), (NULL)", "y"))
    return t.values("(1), (3), (9), (NULL)", "x").crossJoin(F.broadcast(R.subquery_stats(t.values("(2), (5), (NULL)", "y"), "y"))).select("x", some.alias("some"), every.alias("every"))


@query("subquery_equals_any", "SELECT x, x = ANY (SELECT y FROM (VALUES (2), (5), (NULL)) AS w(y)) AS some, x <> ALL (SELECT y FROM (VALUES (2), (5), (NULL)) AS w(y)) AS none, x = ANY (SELECT n_regionkey FROM nation WHERE n_nationkey > 99) AS empty, x <> ALL (SELECT n_regionkey FROM nation) AS lost FROM (VALUES (1), (5), (9), (NULL)) AS v(x)")
def _(t):
    x, y = t.values("(1), (5), (9), (NULL)", "x"), t.values("(2), (5), (NULL)", "y")
    x = R.equals_any(R.equals_any(x, "x", y, "y", "some"), "x", t.nation.where("n_nationkey > 99"), "n_regionkey", "empty")
    return R.equals_any(x, "x", t.nation, "n_regionkey", "found").select("x", "some", (~F.col("some")).alias("none"), "empty", (~F.col("found")).alias("lost"))


@query("subquery_equals_all", "SELECT x, x = ALL (SELECT y FROM (VALUES (5), (5)) AS w(y)) AS every, x <> ANY (SELECT y FROM (VALUES (5), (NULL)) AS w(y)) AS other FROM (VALUES (1), (5), (NULL)) AS v(x)")
def _(t):
    x, one, two = t.values("(1), (5), (NULL)", "x"), R.subquery_stats(t.values("(5), (5)", "y"), "y"), R.subquery_stats(t.values("(5), (NULL)", "y"), "y")
    every = x.crossJoin(F.broadcast(one)).select("x", R.any_quantifier(F.col("x"), "=", one)[1].alias("every"))
    return every.crossJoin(F.broadcast(two)).select("x", "every", R.any_quantifier(F.col("x"), "<>", two)[0].alias("other"))


sql_query("subquery_scalar", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})")
sql_query("subquery_scalar_empty", "SELECT r_name, (SELECT n_name FROM {nation} WHERE n_nationkey = -1) AS missing FROM {region}")
sql_query("subquery_correlated", "SELECT c_custkey, (SELECT count(*) FROM {orders} AS o WHERE o.o_custkey = c.c_custkey) AS n FROM {customer} AS c")
sql_query("subquery_correlated_inequality", "SELECT a.r_name AS name, (SELECT count(*) FROM {region} AS b WHERE b.r_regionkey < a.r_regionkey) AS before FROM {region} AS a")


@query("subquery_array", "SELECT r.r_name, coalesce(list(n.n_nationkey ORDER BY n.n_nationkey) FILTER (n.n_nationkey IS NOT NULL), []) AS keys FROM region AS r LEFT JOIN nation AS n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
def _(t):
    inner = t.nation.selectExpr("n_regionkey AS r_regionkey", "n_nationkey")
    return R.array_subquery(t.region, inner, "r_regionkey", "n_nationkey", "keys").select("r_name", "keys")


sql_query("cte_plain", "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT o_custkey, n FROM per WHERE n >= 2")
sql_query("cte_recursive_union_all", "WITH RECURSIVE r(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM r WHERE n < 20) SELECT n, f FROM r")


@query("cte_recursive_union", "WITH RECURSIVE r(a, b) AS (SELECT DISTINCT c_nationkey, c_nationkey FROM customer UNION SELECT a, (b * 7 + 3) % 25 FROM r) SELECT a, b FROM r")
def _(t):
    seed = t.customer.selectExpr("c_nationkey AS a", "c_nationkey AS b")
    return R.recursive_union(seed, lambda r: r.selectExpr("a", "(b * 7 + 3) % 25 AS b"))


# ---------------------------------------------------------------- aggregates

sql_query("aggregate_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_shipdate) AS first, max(l_shipdate) AS last FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
sql_query("aggregate_many_groups", "SELECT l_partkey, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM {lineitem} GROUP BY l_partkey")
sql_query("aggregate_ungrouped_empty", "SELECT count(*) AS n, count(r_name) AS c, min(r_name) AS m FROM {region} WHERE r_regionkey < 0")
sql_query("aggregate_grouped_empty", "SELECT r_name, count(*) AS n FROM {region} WHERE r_regionkey < 0 GROUP BY r_name")
sql_query("aggregate_group_position", "SELECT o_orderstatus AS s, CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM {orders} GROUP BY 1, 2")
sql_query("aggregate_group_null", "SELECT g, count(*) AS n, count(x) AS c FROM (VALUES (1, 2), (NULL, 3), (NULL, NULL)) AS v(g, x) GROUP BY g")
sql_query("aggregate_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
sql_query("aggregate_having_ungrouped", "SELECT count(*) AS n FROM {orders} HAVING count(*) > 5")


@query("aggregate_sum_wide", "SELECT CAST(sum(CAST(x AS HUGEINT)) AS VARCHAR) AS s FROM (VALUES (9223372036854775807), (9223372036854775807), (5)) AS v(x)")
def _(t):
    return t.values("(9223372036854775807), (9223372036854775807), (5)", "x").agg(N.wide_sum(F.col("x")).cast("string").alias("s"))


@query("aggregate_avg_exact", "SELECT o_orderstatus, round(CAST(sum(o_custkey) AS DOUBLE) / count(o_custkey), 6) AS a FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderstatus").agg(F.round(N.exact_avg(F.col("o_custkey")).cast("double"), 6).alias("a"))


sql_query("aggregate_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM {orders} GROUP BY o_orderstatus")


@query("aggregate_array_agg", "SELECT g, list(x ORDER BY k NULLS LAST) AS xs FROM (VALUES (1, 3, 'c'), (1, 1, NULL), (1, 2, 'b'), (2, 1, NULL)) AS v(g, k, x) GROUP BY g")
def _(t):
    v = t.values("(1, 3, 'c'), (1, 1, NULL), (1, 2, 'b'), (2, 1, NULL)", "g, k, x")
    return v.groupBy("g").agg(R.array_agg(F.col("x"), F.col("k")).alias("xs"))


@query("aggregate_order_keys", "SELECT string_agg(x, ',' ORDER BY k NULLS LAST, x) AS up, string_agg(x, ',' ORDER BY k DESC NULLS FIRST, x) AS down, string_agg(x, ',' ORDER BY k DESC NULLS LAST, x) AS last, list(x ORDER BY k NULLS FIRST, x DESC) AS xs FROM (VALUES (1, 'a'), (NULL, 'b'), (0, 'c'), (1, 'd')) AS v(k, x)")
def _(t):
    v, k, x = t.values("(1, 'a'), (NULL, 'b'), (0, 'c'), (1, 'd')", "k, x"), F.col("k"), F.col("x")
    return v.agg(R.string_agg(x, ",", k).alias("up"), R.string_agg(x, ",", R.Key(k, True)).alias("down"), R.string_agg(x, ",", R.Key(k, True, False)).alias("last"), R.array_agg(x, R.Key(k, nulls_first=True), R.Key(x, True)).alias("xs"))


@query("aggregate_string_agg", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def _(t):
    return t.conversations.groupBy("conv_id").agg(R.string_agg(F.col("role"), ">", F.col("turn")).alias("roles"), F.sum(F.char_length("text")).alias("chars"))


@query("aggregate_two_level", "SELECT l_returnflag, count(*) AS n, round(sum(l_tax) / count(*), 8) AS mean FROM lineitem GROUP BY 1")
def _(t):
    part = t.lineitem.groupBy("l_returnflag", F.pmod("l_orderkey", F.lit(16)).alias("salt")).agg(F.count("*").alias("c"), F.sum("l_tax").alias("s"))
    return part.groupBy("l_returnflag").agg(F.sum("c").alias("n"), F.round(F.sum("s") / F.sum("c"), 8).alias("mean"))


# ---------------------------------------------------------------- order, limit, distinct, sets

sql_query("sort_nulls", "SELECT x, y FROM (VALUES (1, 'b'), (NULL, 'a'), (3, NULL), (2, 'c')) AS v(x, y) ORDER BY x DESC NULLS FIRST, y ASC NULLS LAST")
sql_query("sort_alias_position", "SELECT c_custkey, c_acctbal * -1 AS minus FROM {customer} ORDER BY 2, c_custkey LIMIT 25")
sql_query("sort_alias_position_whole", "SELECT c_custkey, c_acctbal * -1 AS minus FROM {customer} ORDER BY 2, c_custkey")
sql_query("sort_alias_whole", "SELECT c_custkey, c_acctbal * -1 AS minus FROM {customer} ORDER BY minus DESC, c_custkey")
sql_query("limit_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 10 OFFSET 35")
sql_query("top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
sql_query("select_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM {customer}")
_A, _B = "(VALUES (1), (2), (2), (3), (NULL)) AS a(x)", "(VALUES (2), (3), (3), (4), (NULL)) AS b(x)"
for _name, _op in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    sql_query(f"set_{_name}", f"SELECT x FROM {_A} {_op} SELECT x FROM {_B}")
sql_query("set_precedence", f"SELECT x FROM {_A} UNION SELECT x FROM {_B} INTERSECT SELECT x FROM (VALUES (4), (1)) AS c(x)")
sql_query("set_order_limit", "(SELECT n_nationkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}) ORDER BY k DESC LIMIT 7")
