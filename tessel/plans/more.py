"""History queries, statements that change rows, extensions (windows, grouping sets, filters, approximations) and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessel.operators import relational as R
from tessel.operators import statements as ST
from tessel.operators import versions as V
from tessel.sources.tables import table
from tessel.streaming import events as EV

from .core import _VERSIONS, versions
from .registry import query, sql_query

# ---------------------------------------------------------------- time machine


def _all(t):
    out, *rest = versions(t)
    for x in rest:
        out = out.unionByName(x)
    return out


def _state(at: int) -> str:
    return f"SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY commit_ts DESC) AS rn FROM ({_VERSIONS}) AS x WHERE commit_ts <= {at}) AS y WHERE rn = 1 AND NOT deleted"


@query("history_as_of", _state(2))
def _(t):
    return V.as_of(_all(t), ["k"], F.lit(2))


@query("history_diff", f"WITH a AS ({_state(1)}), b AS ({_state(3)}) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'inserted' WHEN b.k IS NULL THEN 'deleted' ELSE 'updated' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v")
def _(t):
    x = _all(t)
    return V.diff(V.as_of(x, ["k"], F.lit(1)), V.as_of(x, ["k"], F.lit(3)), ["k"])


@query("history_flashback", _state(2))
def _(t):
    back = V.flashback(_all(t), ["k"], F.lit(2).cast("bigint"), F.lit(20).cast("bigint"))
    return V.as_of(back, ["k"], F.lit(20))


@query("history_vacuum", f"WITH x AS ({_VERSIONS}), m AS (SELECT k, max(commit_ts) AS m FROM x WHERE commit_ts <= 3 GROUP BY k) SELECT count(*) AS n FROM x LEFT JOIN m ON x.k = m.k WHERE m IS NULL OR commit_ts > m OR (commit_ts = m AND NOT deleted)")
def _(t):
    return V.vacuum(_all(t), ["k"], F.lit(3)).agg(F.count("*").alias("n"))


@query("history_checkpoints", "SELECT name, t AS commit_ts FROM (VALUES ('a', TIMESTAMP '2024-01-01 00:00:00'), ('c', TIMESTAMP '2024-03-01 00:00:00')) AS v(name, t)")
def _(t):
    import datetime

    c = V.Checkpoints(t.spark)
    for name, month in (("a", 1), ("b", 2), ("c", 3)):
        c.create(name, datetime.datetime(2024, month, 1))
    c.drop("b")
    return c.list()


# ---------------------------------------------------------------- statements

_NAT = "SELECT n_nationkey AS k, n_name AS v, CAST(n_regionkey AS BIGINT) AS n FROM nation"


def _nat(t):
    return t.nation.selectExpr("n_nationkey AS k", "n_name AS v", "CAST(n_regionkey AS BIGINT) AS n")


def _new(t):
    return t.values("(3, 'three', 30L), (99, 'new', 1L)", "k, v, n")


@query("statement_insert_default", f"{_NAT} UNION ALL SELECT 100, 'x', 7")
def _(t):
    return ST.insert(_nat(t), t.values("(100, 'x')", "k, v"), {"n": F.lit(7)})


@query("statement_insert_conflict_nothing", f"{_NAT} UNION ALL SELECT 99, 'new', 1")
def _(t):
    return ST.insert_on_conflict_nothing(_nat(t), _new(t), ["k"])


@query("statement_upsert", f"SELECT k, CASE WHEN k = 3 THEN 'three' ELSE v END AS v, CASE WHEN k = 3 THEN n + 30 ELSE n END AS n FROM ({_NAT}) AS x UNION ALL SELECT 99, 'new', 1")
def _(t):
    return ST.insert_on_conflict_update(_nat(t), _new(t), ["k"], {"v": F.col("excluded_v"), "n": F.col("n") + F.col("excluded_n")})


@query("statement_update", f"SELECT k, CASE WHEN n = 1 THEN lower(v) ELSE v END AS v, CASE WHEN n = 1 THEN n + k ELSE n END AS n FROM ({_NAT}) AS x")
def _(t):
    return ST.update(_nat(t), F.col("n") == 1, {"v": F.lower("v"), "n": F.col("n") + F.col("k")})


@query("statement_update_from", "SELECT n_nationkey AS k, r_name AS v, CAST(n_regionkey AS BIGINT) AS n FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return ST.update_from(_nat(t), t.region.selectExpr("CAST(r_regionkey AS BIGINT) AS n", "r_name AS name"), ["n"], {"v": F.col("source_name")}).select("k", "v", "n")


@query("statement_delete", f"SELECT k, v, n FROM ({_NAT}) AS x WHERE NOT (n = 2 AND k > 10)")
def _(t):
    return ST.delete(_nat(t), (F.col("n") == 2) & (F.col("k") > 10))


@query("statement_delete_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return ST.delete_using(t.customer.select("c_custkey"), t.orders.selectExpr("o_custkey AS c_custkey"), ["c_custkey"])


query("statement_truncate", "SELECT r_regionkey FROM region WHERE false")(lambda t: ST.truncate(t.region.select("r_regionkey")))


@query("statement_merge", f"SELECT k, CASE WHEN k = 3 THEN 'three' ELSE v END AS v, n FROM ({_NAT}) AS x UNION ALL SELECT 99, 'new', 1")
def _(t):
    return ST.merge(_nat(t), _new(t), ["k"], {"v": F.col("source_v")}).select("k", "v", "n")


@query("statement_constraints", "SELECT * FROM (VALUES ('c_name not null', CAST(0 AS BIGINT)), ('unique c_nationkey', (SELECT count(*) FROM customer)), ('check rich', (SELECT count(*) FROM customer WHERE NOT c_acctbal > 0)), ('c_nationkey references', CAST(0 AS BIGINT))) AS v(\"constraint\", \"rows\")")
def _(t):
    return ST.violations(t.customer, ["c_name"], [["c_nationkey"]], {"rich": F.col("c_acctbal") > 0}, ("c_nationkey", t.nation, "n_nationkey"))


@query("statement_sequence", "SELECT CAST(11 AS BIGINT) AS a, CAST(12 AS BIGINT) AS b, CAST(50 AS BIGINT) AS c, CAST(50 AS BIGINT) AS last_value, true AS is_called")
def _(t):
    s = ST.Sequences()
    s.create("q", 11)
    a, b = s.nextval("q"), s.nextval("q")
    s.setval("q", 50, False)
    c = s.nextval("q")
    assert s.currval("q") == s.lastval() == c
    return s.read(t.spark, "q").select(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"), F.lit(c).cast("bigint").alias("c"), "last_value", "is_called")


@query("statement_create_function", "SELECT n_name, n_regionkey * 10 + 1 AS y FROM nation")
def _(t):
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ten_and_one(x INT) RETURNS INT RETURN x * 10 + 1")
    return t.sql("SELECT n_name, ten_and_one(n_regionkey) AS y FROM {nation}")


@query("statement_view", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def _(t):
    t.orders.where("o_totalprice > 1000").createOrReplaceTempView("tessel_large_orders")
    return t.spark.sql("SELECT o_orderstatus, count(*) AS n FROM tessel_large_orders GROUP BY 1")


@query("kv_range_scan", "SELECT event_id, user_id FROM events WHERE event_id >= 50 AND event_id < 90 ORDER BY event_id DESC LIMIT 25")
def _(t):
    return t.events.where("event_id >= 50 AND event_id < 90").select("event_id", "user_id").orderBy(F.desc("event_id")).limit(25)


# ---------------------------------------------------------------- extensions

_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
sql_query("window_ranking", f"SELECT o_orderkey, row_number() OVER ({_W}) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, ntile(3) OVER ({_W}) AS nt FROM {{orders}}", f"SELECT o_orderkey, CAST(row_number() OVER ({_W}) AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS dr, CAST(ntile(3) OVER ({_W}) AS INTEGER) AS nt FROM orders")
sql_query("window_analytic", f"SELECT o_orderkey, lag(o_orderkey) OVER ({_W}) AS lg, lead(o_orderkey, 2) OVER ({_W}) AS ld, first_value(o_orderkey) OVER ({_W}) AS fv, count(*) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3 FROM {{orders}}")
sql_query("window_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM {part}")
sql_query("aggregate_rollup", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM {customer} GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
sql_query("aggregate_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql_query("aggregate_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql_query("aggregate_filter", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS n FROM {orders} GROUP BY o_custkey")
sql_query("aggregate_statistics", "SELECT p_brand, round(stddev_samp(p_retailprice), 6) AS sd, bool_and(p_size > 0) AS every, bool_or(p_size > 49) AS some FROM {part} GROUP BY p_brand")


@query("select_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def _(t):
    x = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return R.distinct_on(x, ["o_custkey"], [-F.unix_micros("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("approx_distinct")
def _(t):
    # beside a distinct count in one aggregation, each customer would have a sketch of 13 KB of its own
    sketch, exact = t.orders.agg(F.approx_count_distinct("o_custkey", 0.01).alias("a")), t.orders.agg(F.count_distinct("o_custkey").alias("e"))
    return sketch.crossJoin(exact).select((F.abs(F.col("a") / F.col("e") - 1) < 0.05).alias("close"))


@query("pivot", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1")
def _(t):
    out = t.orders.groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count()
    return out.select("o_orderstatus", *(F.coalesce(f"`{a}`", F.lit(0)).alias(b) for a, b in (("1-URGENT", "urgent"), ("5-LOW", "low"))))


def _stream(t):
    schema = table(t.spark, t.sf_dir, "events").schema
    return EV.read_events(t.spark, f"{t.sf_dir}/events.parquet*", schema), f"{R.shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"


@query("streaming_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    events, folder = _stream(t)
    out = EV.run_once(EV.windowed_counts(events), folder)
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("streaming_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, s")
def _(t):
    events, folder = _stream(t)
    out = EV.run_once(EV.sessions(events), folder)
    return out.select("user_id", F.col("w.start").alias("start"), "n")


@query("streaming_deduplicate", "SELECT DISTINCT event_id, user_id FROM events")
def _(t):
    events, folder = _stream(t)
    return EV.run_once(EV.distinct(events, ["event_id", "user_id"]), folder, "append")


@query("streaming_learner", "SELECT event_id AS k, user_id AS v FROM events WHERE event_type <> 'click'")
def _(t):
    from tessel.sources.tables import merged_scan

    events, folder = _stream(t)
    changes = events.selectExpr("event_id AS k", "user_id AS v", "CAST(1 AS BIGINT) AS commit_ts", "event_type = 'click' AS deleted")
    EV.apply_changes(changes, f"{folder}/runs", f"{folder}/checkpoint").awaitTermination()
    return merged_scan([t.spark.read.parquet(f"{folder}/runs").drop("run")], ["k"], F.lit(1))


# ---------------------------------------------------------------- session, plans and metadata


@query("explain_plan")
def _(t):
    plan = t.orders.where("o_orderkey < 5").select("o_orderkey")._jdf.queryExecution().explainString(t.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return t.spark.createDataFrame([("PushedFilters" in plan,)], "pushed boolean")


@query("cursor_fetch", "SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 2 OFFSET 1")
def _(t):
    rows = t.region.orderBy("r_regionkey").toLocalIterator()
    next(rows)  # MOVE 1, then FETCH 2
    return t.spark.createDataFrame([next(rows), next(rows)], t.region.schema)


@query("catalog_indexes", "SELECT 'public' AS schemaname, 'orders' AS tablename, 'orders_pkey' AS indexname, 'CREATE UNIQUE INDEX orders_pkey ON public.orders USING btree (o_orderkey)' AS indexdef")
def _(t):
    from tessel.sources.tables import index_views

    return index_views(t.spark, {"orders_pkey": ("orders", ["o_orderkey"], True)})


@query("to_regclass", "SELECT true AS there, false AS missing")
def _(t):
    t.region.createOrReplaceTempView("tessel_region")
    return t.spark.createDataFrame([(t.spark.catalog.tableExists("tessel_region"), t.spark.catalog.tableExists("tessel_no_such_table"))], "there boolean, missing boolean")


@query("session_settings", "SELECT 'UTC' AS zone")
def _(t):
    return t.spark.range(1).select(F.lit(t.spark.conf.get("spark.sql.session.timeZone")).alias("zone"))


@query("statement_insert_select_returning", "SELECT o_orderkey * 10 AS id, o_orderstatus AS s FROM orders WHERE o_orderkey < 200")
def _(t):
    rows = t.orders.where("o_orderkey < 200").selectExpr("o_orderkey * 10 AS id", "o_orderstatus AS s")
    return R.written(rows)  # RETURNING gives the rows as written


@query("statement_insert_select_returning_whole", "SELECT o_orderkey * 10 AS id, o_orderstatus AS s FROM orders")
def _(t):
    return R.written(t.orders.selectExpr("o_orderkey * 10 AS id", "o_orderstatus AS s"))


@query("statement_create_table_as", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def _(t):
    return R.written(t.customer.where("c_acctbal > 0").groupBy("c_mktsegment").agg(F.count("*").alias("n")))


@query("statement_prepared", "SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 8")
def _(t):
    prepared = "SELECT n_name FROM {n} WHERE n_regionkey = ? AND n_nationkey > ?"
    return t.spark.sql(prepared, args=[2, 8], n=t.nation)


@query("kv_compare_and_swap", "SELECT k, CASE WHEN k = 1 THEN 'new' ELSE v END AS v FROM (SELECT r_regionkey AS k, r_name AS v FROM region) AS x")
def _(t):
    kv = t.region.selectExpr("r_regionkey AS k", "r_name AS v")
    seen = kv.where("k = 1").first().v
    hit = ST.update(kv, (F.col("k") == 1) & (F.col("v") == seen), {"v": F.lit("new")})
    return ST.update(hit, (F.col("k") == 2) & (F.col("v") == "not this"), {"v": F.lit("never")})


@query("aggregate_string_agg_bytes", "SELECT r_regionkey % 2 AS g, string_agg(lower(hex(encode(r_name))), '2c' ORDER BY r_regionkey) AS b FROM region GROUP BY 1")
def _(t):
    x = t.region.select((F.col("r_regionkey") % 2).alias("g"), "r_regionkey", F.lower(F.hex(F.encode("r_name", "UTF-8"))).alias("h"))
    return x.groupBy("g").agg(R.string_agg(F.col("h"), "2c", F.col("r_regionkey")).alias("b"))


@query("aggregate_functional_dependency", "SELECT c_custkey, c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def _(t):
    joined = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.first("c_name").alias("c_name"), F.count("o_orderkey").alias("n")).select("c_custkey", "c_name", "n")


@query("approx_quantile")
def _(t):
    exact = t.lineitem.agg(F.percentile("l_quantity", 0.5).alias("e"), F.percentile_approx("l_quantity", 0.5, 1000).alias("a"))
    return exact.select((F.abs(F.col("e") - F.col("a")) <= 1).alias("close"))


@query("aggregate_median_mode", "SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(F.median("p_retailprice").alias("m"))


sql_query("unpivot", "SELECT c_custkey, k, v FROM {customer} LATERAL VIEW stack(2, 'nation', cast(c_nationkey as string), 'segment', c_mktsegment) s AS k, v", "SELECT c_custkey, 'nation' AS k, CAST(c_nationkey AS VARCHAR) AS v FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer")


# ---------------------------------------------------------------- definitions, keys, catalog

sql_query("join_using_chain", "SELECT c_custkey, n_name, r_name FROM (SELECT c_custkey, c_nationkey AS k FROM {customer}) AS c JOIN (SELECT n_nationkey AS k, n_name, n_regionkey AS g FROM {nation}) AS n USING (k) JOIN (SELECT r_regionkey AS g, r_name FROM {region}) AS r USING (g)")
sql_query("scan_column_aliases", "SELECT a, b FROM {region} AS x(a, b) WHERE a > 1")


@query("statement_alter_table", "SELECT r_regionkey::BIGINT AS k, 'none' AS note, CAST(7 AS INTEGER) AS n FROM region")
def _(t):
    return ST.alter(t.region, add={"note": F.lit("none"), "n": F.lit(7)}, drop=["r_name"], rename={"r_regionkey": "k"}, types={"r_regionkey": "bigint"})


@query("statement_matview_refresh", "SELECT 'old' AS at, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'new', o_orderstatus, 2 * count(*) FROM orders GROUP BY 2")
def _(t):
    rows = [t.orders]
    view = ST.MaterializedView(lambda: rows[0].groupBy(F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n")), R.written)
    old = view.rows
    rows[0] = rows[0].unionByName(rows[0])
    return old.select(F.lit("old").alias("at"), "s", "n").unionByName(view.refresh().select(F.lit("new").alias("at"), "s", "n"))


@query("statement_delete_cascade", "SELECT (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS customers, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) AS orders, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) AS nulls")
def _(t):
    gone = F.col("c_acctbal") < 0
    left, orders = ST.delete_referenced(t.customer, t.orders, gone, "c_custkey", "o_custkey", "CASCADE")
    _, blank = ST.delete_referenced(t.customer, t.orders, gone, "c_custkey", "o_custkey", "SET NULL")
    return left.agg(F.count("*").alias("customers")).crossJoin(orders.agg(F.count("*").alias("orders"))).crossJoin(blank.where("o_custkey IS NULL").agg(F.count("*").alias("nulls")))


@query("statement_enforced", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return ST.enforce(rows, ["o_orderkey", "o_custkey"], {"positive": F.col("o_totalprice") >= 0}, [["o_orderkey"]])


@query("statement_exclude", "SELECT id FROM (VALUES (2), (4)) AS v(id)")
def _(t):
    v = t.values("(1, 'a', 1, 5), (2, 'a', 4, 6), (3, 'a', 6, 9), (4, 'a', 2, 3), (5, 'b', 1, 9), (6, 'b', 9, 9)", "id, k, lo, hi")
    return ST.exclude(v, ["k"], "lo", "hi").select("id")


def _catalog(t):
    from tessel.sources.catalog import Catalog, Constraint

    keys = [Constraint("region_pkey", "region", "p", ("r_regionkey",)), Constraint("nation_fk", "nation", "f", ("n_regionkey",), target="region", target_columns=("r_regionkey",), on_delete="CASCADE"), Constraint("nation_ck", "nation", "c", check="n_nationkey >= 0")]
    return Catalog({"region": t.region, "nation": t.nation}, {"names": "SELECT r_name FROM region"}, {"nation_name": ("nation", ["n_name"], True)}, keys, {("region", None): "five rows", ("region", "r_name"): "its name"}, {"region_seq": ("region", "r_regionkey")})


@query("catalog_relations", "SELECT * FROM (VALUES ('nation', 'r', 3), ('region', 'r', 2), ('names', 'v', 0), ('nation_name', 'i', 0), ('region_seq', 'S', 0)) AS v(name, kind, columns)")
def _(t):
    c = _catalog(t)
    own = c.relation(t.spark, "pg_class").join(c.relation(t.spark, "pg_namespace").withColumnRenamed("oid", "relnamespace"), "relnamespace")
    return own.selectExpr("relname AS name", "relkind AS kind", "relnatts AS columns")


@query("catalog_attributes", "SELECT * FROM (VALUES ('nation', 'n_name', 'text', 2), ('nation', 'n_nationkey', 'integer', 1), ('nation', 'n_regionkey', 'integer', 3), ('region', 'r_name', 'text', 2), ('region', 'r_regionkey', 'integer', 1)) AS v(rel, att, kind, num)")
def _(t):
    c = _catalog(t)
    x = c.relation(t.spark, "pg_attribute").join(c.relation(t.spark, "pg_type").withColumnRenamed("oid", "atttypid"), "atttypid").join(c.relation(t.spark, "pg_class").withColumnRenamed("oid", "attrelid"), "attrelid")
    return x.selectExpr("relname AS rel", "attname AS att", "typname AS kind", "attnum AS num")


@query("catalog_definitions", "SELECT * FROM (VALUES ('region_pkey', 'PRIMARY KEY (r_regionkey)'), ('nation_fk', 'FOREIGN KEY (n_regionkey) REFERENCES region(r_regionkey) ON DELETE CASCADE'), ('nation_ck', 'CHECK ((n_nationkey >= 0))'), ('names', ' SELECT r_name FROM region;'), ('nation_name', 'CREATE UNIQUE INDEX nation_name ON public.nation USING btree (n_name)'), ('serial', 'public.region_seq'), ('column', 'its name'), ('table', 'five rows')) AS v(name, def)")
def _(t):
    c = _catalog(t)
    rows = [(n, c.get_constraintdef(n)) for n in ("region_pkey", "nation_fk", "nation_ck")]
    rows += [("names", c.get_viewdef("names")), ("nation_name", c.get_indexdef("nation_name")), ("serial", c.get_serial_sequence("region", "r_regionkey")), ("column", c.col_description("region", 2)), ("table", c.obj_description("region"))]
    return t.spark.createDataFrame(rows, "name string, def string")


@query("catalog_casts", "SELECT 'region' AS class, 'public' AS space, true AS missing, 'numeric(10,2)' AS num, 'character varying(5)' AS chars, 'timestamp(3) with time zone' AS ts, 'UTF8' AS enc")
def _(t):
    c = _catalog(t)
    values = {"class": c.regclass_name(c.regclass("public.region")), "space": c.regnamespace_name(c.regnamespace("public")), "missing": c.to_regclass("nowhere") is None and c.to_regnamespace("nowhere") is None, "num": c.format_type(1700, (10 << 16) + 2 + 4), "chars": c.format_type(1043, 9), "ts": c.format_type(1184, 3), "enc": c.encoding_to_char(6)}
    return t.spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


@query("catalog_constraints", "SELECT * FROM (VALUES ('region_pkey', 'region', 'PRIMARY KEY', 'r_regionkey'), ('nation_fk', 'nation', 'FOREIGN KEY', 'n_regionkey'), ('nation_ck', 'nation', 'CHECK', NULL)) AS v(name, tab, kind, col)")
def _(t):
    c = _catalog(t)
    a, b = c.relation(t.spark, "information_schema.table_constraints"), c.relation(t.spark, "information_schema.key_column_usage").drop("table_name", "ordinal_position")
    return a.join(b, "constraint_name", "left").selectExpr("constraint_name AS name", "table_name AS tab", "constraint_type AS kind", "column_name AS col")
