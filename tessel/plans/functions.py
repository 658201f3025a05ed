"""Scalar and set-returning functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import collections as C
from tessel.functions import datetimes as D
from tessel.functions import numbers as N
from tessel.functions import strings as S
from tessel.functions import textsearch as TS

from .registry import query, sql_query

# ---------------------------------------------------------------- strings

sql_query("string_case_reverse", "SELECT doc_id, lower(source) AS l, upper(lang) AS u, reverse(source) AS r FROM {documents}")


@query("string_lengths", "SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, bit_length(text) AS bits, ascii(text) AS first FROM documents")
def _(t):
    x = F.col("text")
    return t.documents.select("doc_id", F.char_length(x).cast("bigint").alias("chars"), F.octet_length(x).cast("bigint").alias("bytes"), F.bit_length(x).cast("bigint").alias("bits"), S.ascii(F.substring(x, 1, 1)).alias("first"))


_T = "(VALUES ('a', NULL, 'c'), (NULL, NULL, NULL), ('x', 'y', 'z')) AS v(a, b, c)"


@query("string_concat", f"SELECT concat(a, b, c) AS loose, a || b || c AS strict FROM {_T}")
def _(t):
    v = t.values("('a', NULL, 'c'), (NULL, NULL, NULL), ('x', 'y', 'z')", "a, b, c")
    return v.select(S.concat(F.col("a"), F.col("b"), F.col("c")).alias("loose"), S.concat_strict(F.col("a"), F.col("b"), F.col("c")).alias("strict"))


@query("string_format", "SELECT r_name, '[' || r_name || '] ' || '''' || r_name || ''' ' || lpad(r_name, 12, ' ') || '%' AS f FROM region")
def _(t):
    n = F.col("r_name")
    return t.region.select("r_name", S.format("[%s] %L %1$12s%%", n, n).alias("f"))


@query("string_split_part", "SELECT p_partkey, split_part(p_type, ' ', 1) AS a, split_part(p_type, ' ', -1) AS z, split_part(p_type, ' ', 9) AS none FROM part")
def _(t):
    x = F.col("p_type")
    return t.part.select("p_partkey", S.split_part(x, " ", 1).alias("a"), S.split_part(x, " ", -1).alias("z"), S.split_part(x, " ", 9).alias("none"))


@query("string_to_array", "SELECT s, CASE WHEN s = '' THEN []::VARCHAR[] ELSE [CASE WHEN x = 'NA' THEN NULL ELSE x END FOR x IN string_split(s, '.')] END AS parts FROM (VALUES ('a.b.NA'), (''), ('x'), (NULL)) AS v(s)")
def _(t):
    return t.values("('a.b.NA'), (''), ('x'), (NULL)", "s").select("s", S.string_to_array(F.col("s"), ".", "NA").alias("parts"))


@query("string_strpos", "SELECT p_partkey, strpos(p_name, 'e') AS e, strpos(p_name, '') AS empty, strpos(p_name, 'zzzz') AS none FROM part")
def _(t):
    x = F.col("p_name")
    return t.part.select("p_partkey", S.strpos(x, "e").cast("bigint").alias("e"), S.strpos(x, "").cast("bigint").alias("empty"), S.strpos(x, "zzzz").cast("bigint").alias("none"))


@query("string_trim", "SELECT s, trim(s, 'xy') AS b, ltrim(s, 'xy') AS l, rtrim(s, 'xy') AS r FROM (VALUES ('xyxabcyx'), ('  a '), (NULL)) AS v(s)")
def _(t):
    x = F.col("s")
    return t.values("('xyxabcyx'), ('  a '), (NULL)", "s").select("s", S.btrim(x, "xy").alias("b"), S.ltrim(x, "xy").alias("l"), S.rtrim(x, "xy").alias("r"))


@query("string_substr", "SELECT n_name, substring(n_name, 1, 2) AS clamped, '' AS before, substring(n_name, 3, 2) AS middle, substring(n_name, 1) AS whole FROM nation")
def _(t):
    x = F.col("n_name")
    return t.nation.select("n_name", S.substr(x, 0, 3).alias("clamped"), S.substr(x, -5, 3).alias("before"), S.substr(x, 3, 2).alias("middle"), S.substr(x, -2).alias("whole"))


@query("string_replace", "SELECT p_partkey, replace(p_name, 'an', 'AN') AS r, p_name AS same FROM part")
def _(t):
    x = F.col("p_name")
    return t.part.select("p_partkey", S.replace(x, "an", "AN").alias("r"), S.replace(x, "", "q").alias("same"))


@query("string_convert_to", "SELECT r_name, lower(hex(encode(r_name))) AS bytes FROM region")
def _(t):
    return t.region.select("r_name", F.lower(F.hex(S.convert_to(F.col("r_name"), "UTF8"))).alias("bytes"))


# ---------------------------------------------------------------- numbers

_NUM = "(7, 2), (-7, 2), (7, -2), (0, 5), (NULL, 1)"


@query("math_integers", f"SELECT a, b, CAST(trunc(a / CAST(b AS DOUBLE)) AS BIGINT) AS quotient, CAST(a % b AS BIGINT) AS rest, CAST(abs(a) AS BIGINT) AS size FROM (VALUES {_NUM}) AS v(a, b)")
def _(t):
    a, b = F.col("a"), F.col("b")
    return t.values(_NUM, "a, b").select("a", "b", N.divide(a, b).cast("bigint").alias("quotient"), N.remainder(a, b).cast("bigint").alias("rest"), F.abs(a).cast("bigint").alias("size"))


@query("math_power_bits", "SELECT n_nationkey AS n, CAST(n_nationkey AS DOUBLE) ^ 2 AS p, n_nationkey & 6 AS conj, n_nationkey | 9 AS disj, xor(n_nationkey, 5) AS x, n_nationkey << 2 AS l, n_nationkey >> 1 AS r FROM nation")
def _(t):
    n = F.col("n_nationkey")
    return t.nation.select(n.alias("n"), N.power(n, F.lit(2)).alias("p"), n.bitwiseAND(6).alias("conj"), n.bitwiseOR(9).alias("disj"), N.bit_xor(n, F.lit(5)).alias("x"), N.shift_left(n, 2).alias("l"), N.shift_right(n, 1).alias("r"))


sql_query("math_greatest_least", "SELECT id, greatest(a, b, 2) AS g, least(a, b, 2) AS l, nullif(a, b) AS n FROM (VALUES (1, 1, NULL), (2, 5, 5), (3, NULL, NULL)) AS v(id, a, b)")
sql_query("math_arithmetic", "SELECT o_orderkey, o_custkey + 1 AS plus, o_custkey - 1 AS minus, o_custkey * 3 AS times FROM {orders}")
query("math_random")(lambda t: t.region.select("r_regionkey", F.rand(5).between(0, 1).alias("inside")))

# ---------------------------------------------------------------- dates and times

sql_query("date_trunc_units", "SELECT o_orderkey, " + ", ".join(f"date_trunc('{u}', o_orderdate) AS {u}" for u in ("hour", "day", "week", "month", "quarter", "year")) + " FROM {orders}", "SELECT o_orderkey, " + ", ".join(f"CAST(date_trunc('{u}', o_orderdate) AS TIMESTAMP) AS {u}" for u in ("hour", "day", "week", "month", "quarter", "year")) + " FROM orders")


@query("date_trunc_long", "SELECT DISTINCT CAST(make_date(CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER), 1, 1) AS TIMESTAMP) AS decade, CAST(make_date(CAST(floor((year(o_orderdate) - 1) / 100) * 100 + 1 AS INTEGER), 1, 1) AS TIMESTAMP) AS century, CAST(make_date(CAST(floor((year(o_orderdate) - 1) / 1000) * 1000 + 1 AS INTEGER), 1, 1) AS TIMESTAMP) AS millennium FROM orders")
def _(t):
    x = F.col("o_orderdate")
    return t.orders.select(*(D.date_trunc(u, x).alias(u) for u in ("decade", "century", "millennium"))).distinct()


@query("date_arithmetic", "SELECT o_orderkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(o_orderdate AS DATE) + 10 AS later, CAST(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01 00:00:00') AS DOUBLE) / 1e6 AS seconds, o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY AS plus FROM orders")
def _(t):
    x = F.col("o_orderdate")
    d = x.cast("date")
    return t.orders.select("o_orderkey", D.days_between(d, F.lit("1995-01-01").cast("date")).cast("bigint").alias("days"), D.add_days(d, 10).alias("later"), D.seconds_between(x, F.lit("1995-01-01").cast("timestamp")).alias("seconds"), D.add_interval(x, 1, 2).alias("plus"))


@query("date_now_is_stable", "SELECT r_name, true AS same FROM region")
def _(t):
    return t.region.select("r_name", ((F.current_timestamp() == F.now()) & (F.current_date() == F.to_date(F.now()))).alias("same"))


@query("time_of_day", "SELECT event_id, (epoch_us(ts) - epoch_us(CAST(date_trunc('day', ts) AS TIMESTAMP))) AS us FROM events")
def _(t):
    return t.events.select("event_id", D.time_of_day(F.col("ts")).alias("us"))


# ---------------------------------------------------------------- arrays and set-returning functions

_ARR = "(1, array(5, 7, 5)), (2, cast(array() as array<int>)), (3, NULL)"
_DARR = "(VALUES (1, [5, 7, 5]), (2, []), (3, NULL)) AS v(id, a)"


@query("array_functions", f"SELECT id, CAST(CASE WHEN len(a) > 0 AND list_position(a, 7) > 0 THEN list_position(a, 7) END AS BIGINT) AS position, CAST(CASE WHEN len(a) > 0 THEN 1 END AS INTEGER) AS lower, CAST(nullif(len(a), 0) AS INTEGER) AS upper, CAST(nullif(len(a), 0) AS INTEGER) AS length, CAST(len(a) AS INTEGER) AS cardinality FROM {_DARR}")
def _(t):
    a = F.col("a")
    return t.values(_ARR, "id, a").select("id", C.array_position(a, 7).alias("position"), C.array_lower(a).alias("lower"), C.array_upper(a).alias("upper"), C.array_length(a).alias("length"), F.cardinality(a).alias("cardinality"))


@query("array_concat", "SELECT vec_id, list_concat(embedding[1:2], embedding[1:1]) AS c FROM embeddings")
def _(t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.concat(F.slice(e, 1, 2), F.slice(e, 1, 1)).alias("c"))


@query("srf_generate_series", "SELECT n_nationkey, x FROM nation, LATERAL (SELECT unnest(range(n_nationkey, 6, 2)) AS x) AS s")
def _(t):
    return t.nation.select("n_nationkey", F.explode(C.series(F.col("n_nationkey"), F.lit(5), 2)).alias("x")).select("n_nationkey", F.col("x").cast("bigint").alias("x"))


@query("srf_generate_series_down", "SELECT unnest(range(5, -1, -2)) AS x")
def _(t):
    return t.spark.range(1).select(F.explode(C.series(F.lit(5), F.lit(0), -2)).alias("x")).select(F.col("x").cast("bigint").alias("x"))


@query("srf_generate_subscripts", f"SELECT id, unnest(range(1, len(a) + 1)) AS i FROM {_DARR}")
def _(t):
    return t.values(_ARR, "id, a").select("id", F.explode(C.subscripts(F.col("a"))).alias("i")).select("id", F.col("i").cast("bigint").alias("i"))


@query("srf_unnest", f"SELECT id, unnest(a) AS x FROM {_DARR}")
def _(t):
    return t.values(_ARR, "id, a").select("id", F.explode("a").alias("x"))


# ---------------------------------------------------------------- JSON, hstore


@query("json_fetch", "SELECT event_id, props ->> '$.k' AS k, json_extract_string(props, '$.none') AS none FROM events")
def _(t):
    return t.events.select("event_id", C.json_get_text(F.col("props"), "k").alias("k"), C.json_get_text(F.col("props"), "none").alias("none"))


@query("json_fetch_json", """SELECT id, j AS v FROM (VALUES (1, '"x"'), (2, '5'), (3, '[1,2]')) AS v(id, j)""")
def _(t):
    return t.values("""(1, '{"a":"x"}'), (2, '{"a":5}'), (3, '{"a":[1,2]}')""", "id, j").select("id", C.json_get(F.col("j"), "a").alias("v"))


@query("json_contains", "SELECT * FROM (VALUES (1, true), (2, false), (3, false)) AS v(id, has)")
def _(t):
    v = t.values("""(1, '{"a":"x","b":"y"}'), (2, '{"a":"z"}'), (3, '{}')""", "id, j")
    return v.select("id", C.json_contains_pairs(F.col("j"), F.lit('{"a":"x"}')).alias("has"))


@query("json_merge", """SELECT '{"a":"2","b":"1","c":"3"}' AS j""")
def _(t):
    return t.spark.range(1).select(C.json_merge_flat(F.lit('{"b":"1","a":"1"}'), F.lit('{"c":"3","a":"2"}')).alias("j"))


_DOCS = """(1, '{"a":{"b":[1,2,{"c":null}]},"d":"x"}', '{"a":{"b":[{"c":null},1]}}'), (2, '[1,"y"]', '"y"'), (3, '{"a":true}', '{"a":1}'), (4, 'null', '[]'), (5, NULL, '1')"""


@query("jsonb_documents", """SELECT * FROM (VALUES (1, true, 1, '{"a": {"b": [{"c": null}, 1]}, "d": "x"}'), (2, true, 1, '[1, "y", "y"]'), (3, false, 1, '{"a": 1}'), (4, false, 1, '[null]'), (5, NULL, NULL, NULL)) AS v(id, has, cmp, joined)""")
def _(t):
    from tessel.functions import jsonb as J

    v = t.values(_DOCS, "id, a, b")
    return v.select("id", J.jsonb_contains("a", "b").alias("has"), J.jsonb_compare("a", "b").alias("cmp"), J.jsonb_concat("a", "b").alias("joined"))


_H = "map('a', '1', 'b', cast(null as string))"


@query("hstore_functions", "SELECT '1' AS a, CAST(NULL AS VARCHAR) AS c, true AS has_b, true AS contains, ['a', 'b'] AS keys, ['1', NULL] AS vals, '9' AS merged")
def _(t):
    h = F.expr(_H)
    return t.spark.range(1).select(C.hstore_get(h, "a").alias("a"), C.hstore_get(h, "c").alias("c"), C.hstore_has(h, "b").alias("has_b"), C.hstore_contains(h, F.expr("map('b', cast(null as string))")).alias("contains"), C.akeys(h).alias("keys"), C.avals(h).alias("vals"), C.hstore_get(C.hstore_concat(h, F.expr("map('a', '9')")), "a").alias("merged"))


@query("hstore_construct", "SELECT r_name, r_name || '=' || r_regionkey AS pair FROM region")
def _(t):
    h = F.map_from_arrays(F.array("r_name"), F.array(F.col("r_regionkey").cast("string")))
    return t.region.select("r_name", F.concat(C.akeys(h)[0], F.lit("="), C.avals(h)[0]).alias("pair"))


# ---------------------------------------------------------------- ranges


@query("range_functions", "SELECT o_orderkey, d >= DATE '1995-01-01' AND d < DATE '1996-01-01' AS has, d < DATE '1996-01-01' AND d + 30 > DATE '1995-01-01' AS overlap, false AS empty, true AS inc, false AS inc_hi, true AS inf FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) AS o")
def _(t):
    d = F.col("o_orderdate").cast("date")
    year = C.date_range(F.lit("1995-01-01").cast("date"), F.lit("1995-12-31").cast("date"), "[]")
    own = C.date_range(d, F.date_add(d, 30))
    open_end = C.make_range(d, F.lit(None).cast("date"))
    return t.orders.select("o_orderkey", C.range_has(year, d).alias("has"), C.range_overlaps(own, year).alias("overlap"), C.range_empty(own).alias("empty"), own["lo_inc"].alias("inc"), own["hi_inc"].alias("inc_hi"), C.upper_inf(open_end).alias("inf"))


@query("range_edges", "SELECT * FROM (VALUES (1, false, true), (2, true, false), (3, true, true)) AS v(id, touches, empty)")
def _(t):
    def r(a, b, k):
        return C.make_range(F.lit(a), F.lit(b), k)

    rows = [(1, r(1, 3, "[)"), r(3, 5, "[]"), r(2, 2, "[)")), (2, r(1, 3, "[]"), r(3, 5, "[]"), r(2, 2, "[]")), (3, r(1, 9, "()"), r(3, 5, "[]"), r(4, 2, "[]"))]
    out = [t.spark.range(1).select(F.lit(i).alias("id"), C.range_overlaps(a, b).alias("touches"), C.range_empty(c).alias("empty")) for i, a, b, c in rows]
    return out[0].unionByName(out[1]).unionByName(out[2])


# ---------------------------------------------------------------- text search, ltree, geometry


@query("text_search_match", "SELECT doc_id, list_contains(w, 'the') AND NOT list_contains(w, 'idiot') AS m FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') AS w FROM documents) AS x")
def _(t):
    q = TS.to_tsquery("the & !idiot")
    return t.documents.select("doc_id", q.matches_text(F.col("text")).alias("m"))


@query("text_search_forms", "SELECT * FROM (VALUES (1, true, true, true, 3, true), (2, true, false, true, 3, true), (3, false, false, false, 3, true)) AS v(id, plain, phrase, web, nodes, english)")
def _(t):
    v = t.values("(1, 'quick brown fox'), (2, 'brown and quick'), (3, 'lazy dogs')", "id, s").select("id", TS.to_tsvector(F.col("s")).alias("v"), TS.to_tsvector(F.col("s"), "english").alias("e"))
    v1, e = F.col("v"), F.col("e")
    english = TS.to_tsquery("dog | quick", "english")
    return v.select("id", TS.plainto_tsquery("quick brown").matches(v1).alias("plain"), TS.phraseto_tsquery("quick brown").matches(v1).alias("phrase"), TS.websearch_to_tsquery("quick -lazy").matches(v1).alias("web"), F.lit(TS.plainto_tsquery("quick brown").numnode()).alias("nodes"), english.matches(e).alias("english"))


@query("text_search_rank", "SELECT id, CASE n WHEN 0 THEN 0 WHEN 1 THEN round(0.1 / 1.64493406685, 6) ELSE round(0.125 / 1.64493406685, 6) END AS one, CASE WHEN d IS NULL THEN 0 ELSE round(sqrt(0.01 / (1.005 + 0.05 * exp(d / 1.5 - 2))), 6) END AS both_, CASE n WHEN 0 THEN 0 WHEN 1 THEN round(1 / 1.64493406685, 6) ELSE round(1.25 / 1.64493406685, 6) END AS heavy FROM (VALUES (1, 2, NULL), (2, 1, 3), (3, 1, 1), (4, 0, NULL)) AS v(id, n, d)")
def _(t):
    """One word by its occurrences, two words by their distance, and the first again with weight A."""
    v = t.values("(1, 'a Cat and a cat'), (2, 'fat cats and fat rats'), (3, 'rats, cats'), (4, 'dogs')", "id, s").select("id", TS.to_tsvector(F.col("s"), "english").alias("v"))
    cat, both = TS.to_tsquery("cats", "english"), TS.to_tsquery("cats & rats", "english")
    ranks = {"one": TS.ts_rank(F.col("v"), cat), "both_": TS.ts_rank(F.col("v"), both), "heavy": TS.ts_rank(TS.setweight(F.col("v"), "A"), cat, True)}
    return v.select("id", *(F.round(x, 6).alias(n) for n, x in ranks.items()))


@query("text_search_stems", "SELECT * FROM (VALUES ('consistency', 'consist'), ('generously', 'generous'), ('hoping', 'hope'), ('hopping', 'hop'), ('relational', 'relat'), ('skies', 'sky'), ('knightly', 'knight'), ('flies', 'fli')) AS v(word, stem)")
def _(t):
    """Words and stems from the stemmer's published vocabulary."""
    v = t.values("('consistency'), ('generously'), ('hoping'), ('hopping'), ('relational'), ('skies'), ('knightly'), ('flies')", "word")
    return v.select("word", F.map_keys(TS.to_tsvector(F.col("word"), "english"))[0].alias("stem"))


@query("text_search_rank_headline", "SELECT CAST(0.075991 AS DOUBLE) AS rank, 'a <b>Fox</b> and a <b>fox</b>' AS head, ['a', 'and', 'fox'] AS lexemes")
def _(t):
    s = F.lit("a Fox and a fox")
    v = TS.to_tsvector(s)
    return t.spark.range(1).select(F.round(TS.ts_rank(v, ["fox"]), 6).alias("rank"), TS.ts_headline(s, ["fox"]).alias("head"), TS.strip(v).alias("lexemes"))


@query("ltree_functions", "SELECT s, CASE WHEN s = '' THEN 0 ELSE len(string_split(s, '.')) END AS n, regexp_full_match(s, '([A-Za-z0-9_-]+([.][A-Za-z0-9_-]+)*)?') AS ok, s = 'a' OR starts_with(s, 'a.') AS under FROM (VALUES ('a.b.c'), (''), ('a..b'), ('ab.c')) AS v(s)")
def _(t):
    s = F.col("s")
    return t.values("('a.b.c'), (''), ('a..b'), ('ab.c')", "s").select("s", C.nlevel(s).cast("bigint").alias("n"), C.is_ltree(s).alias("ok"), C.ltree_is_ancestor(F.lit("a"), s).alias("under"))


@query("geometry_predicates", "SELECT id, inside, overlap FROM (VALUES (1, true, true), (2, false, false)) AS v(id, inside, overlap)")
def _(t):
    poly = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))))
    other = F.array(F.struct((F.col("px") - 1).alias("x"), F.col("py").alias("y")), F.struct((F.col("px") + 1).alias("x"), (F.col("py") + 1).alias("y")))
    v = t.values("(1, 1.0D, 2.0D), (2, 9.0D, 2.0D)", "id, px, py")
    return v.select("id", C.polygon_has_point(poly, F.col("px"), F.col("py")).alias("inside"), C.polygons_overlap(poly, other).alias("overlap"))


# ---------------------------------------------------------------- zones, intervals, identifiers


@query("date_trunc_zone", "SELECT event_id, date_trunc('day', timezone('America/New_York', CAST(ts AS TIMESTAMPTZ))) AS local_day, timezone('America/New_York', date_trunc('day', timezone('America/New_York', CAST(ts AS TIMESTAMPTZ)))) AT TIME ZONE 'UTC' AS day_start FROM events")
def _(t):
    ts = F.col("ts")
    return t.events.select("event_id", D.date_trunc("day", D.at_time_zone(ts, "America/New_York")).alias("local_day"), D.trunc_in_zone("day", ts, "America/New_York").alias("day_start"))


@query("interval_arithmetic", "SELECT o_orderkey, o_orderdate + INTERVAL 2 MONTH + INTERVAL 6 DAY + INTERVAL 90 MINUTE AS later FROM orders")
def _(t):
    step = D.interval_times(D.interval(1, 3, 45 * 60_000_000), 2)
    return t.orders.select("o_orderkey", D.add(F.col("o_orderdate"), step).alias("later"))


@query("interval_forms", "SELECT * FROM (VALUES (1, '1 year 2 mons 3 days 04:05:06', '1 year'), (2, '-00:00:01.5', '00:00:00'), (3, '1 mon', '00:00:00'), (4, '00:00:00', '00:00:00'), (5, '30:00:00', '00:00:00')) AS v(id, shown, year)")
def _(t):
    v = t.values("(1, 14, 3, 14706000000), (2, 0, 0, -1500000), (3, 1, 0, 0), (4, 0, 0, 0), (5, 0, 0, 108000000000)", "id, m, d, us").select("id", D.interval(F.col("m"), F.col("d"), F.col("us")).alias("i"))
    return v.select("id", D.interval_text(F.col("i")).alias("shown"), D.interval_text(D.interval_trunc("year", F.col("i"))).alias("year"))


@query("aggregate_interval_sum", "SELECT o_orderstatus, CAST(sum(o_custkey % 12) AS INTEGER) AS months, CAST(sum(o_custkey % 30) AS INTEGER) AS days FROM orders GROUP BY 1")
def _(t):
    x = t.orders.groupBy("o_orderstatus").agg(D.interval_sum(D.interval((F.col("o_custkey") % 12), (F.col("o_custkey") % 30))).alias("i"))
    return x.select("o_orderstatus", F.col("i.months").alias("months"), F.col("i.days").alias("days"))


@query("uuid_named", "SELECT r_name, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', CAST(instr('0123456789abcdef', substr(h, 17, 1)) - 1 AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS v3 FROM (SELECT r_name, md5(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(r_name)) AS h FROM region) AS x")
def _(t):
    from tessel.functions import uuids as U

    return t.region.select("r_name", U.uuid_generate_v3(U.uuid_ns("dns"), F.col("r_name")).alias("v3"))


@query("uuid_versions", "SELECT r_regionkey, true AS v1, true AS v4, '00000000-0000-0000-0000-000000000000' AS nil FROM region")
def _(t):
    from tessel.functions import uuids as U

    shape = "^[0-9a-f]{8}-[0-9a-f]{4}-%s[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return t.region.select("r_regionkey", U.uuid_generate_v1mc().rlike(shape % "1").alias("v1"), U.uuid_generate_v4().rlike(shape % "4").alias("v4"), U.uuid_nil().alias("nil"))


# ---------------------------------------------------------------- output forms


@query("text_of_floats", "SELECT * FROM (VALUES (1, '1'), (2, '0.5'), (3, '1e+15'), (4, '123456789012345'), (5, '1e-05'), (6, '0.0001'), (7, '-2.5e+20'), (8, 'NaN'), (9, 'Infinity'), (10, '-Infinity'), (11, '0'), (12, '12345678.25'), (13, NULL)) AS v(id, s)")
def _(t):
    v = t.values("(1, 1D), (2, 0.5D), (3, 1e15D), (4, 123456789012345D), (5, 1e-5D), (6, 1e-4D), (7, -2.5e20D), (8, double('NaN')), (9, double('Infinity')), (10, double('-Infinity')), (11, 0D), (12, 12345678.25D), (13, NULL)", "id, x")
    return v.select("id", S.to_text(F.col("x"), "double precision").alias("s"))


@query("text_of_columns", "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS ts, regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), '\\.?0+$', '') AS price, '\\x' || lower(hex(encode(o_orderstatus))) AS bytes, CASE WHEN o_orderstatus = 'F' THEN 'tx' ELSE 'fx' END AS flag FROM orders")
def _(t):
    flag = S.concat(F.col("o_orderstatus") == "F", F.lit("x"))
    return t.orders.select("o_orderkey", S.to_text(F.col("o_orderdate"), "timestamp").alias("ts"), S.to_text(F.col("o_totalprice"), "double precision").alias("price"), S.to_text(F.encode("o_orderstatus", "UTF-8"), "bytea").alias("bytes"), flag.alias("flag"))


@query("regex_posix", "SELECT * FROM (VALUES ('ab', true, true, true, false), ('ab' || chr(10), false, true, true, false), ('a]b1', false, true, true, true), ('', false, false, false, false)) AS v(s, ends, alpha, word, bracket)")
def _(t):
    s = F.col("s")
    v = t.values("('ab'), (concat('ab', char(10))), ('a]b1'), ('')", "s")
    return v.select("s", S.matches(s, "b$").alias("ends"), S.matches(s, "^[[:alpha:]]").alias("alpha"), S.matches(s, r"\mA", True).alias("word"), S.matches(s, "[]x][^[:digit:]]").alias("bracket"))


# ---------------------------------------------------------------- identifiers and session

query("uuid_random")(lambda t: t.region.select("r_regionkey", F.uuid().rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4").alias("v4")))
sql_query("uuid_constants", "SELECT '00000000-0000-0000-0000-000000000000' AS nil, '6ba7b810-9dad-11d1-80b4-00c04fd430c8' AS dns, '6ba7b811-9dad-11d1-80b4-00c04fd430c8' AS url, '6ba7b812-9dad-11d1-80b4-00c04fd430c8' AS oid, '6ba7b814-9dad-11d1-80b4-00c04fd430c8' AS x500")
query("session_functions")(lambda t: t.spark.sql("SELECT current_schema() IS NOT NULL AS schema, current_database() IS NOT NULL AS database, current_user() IS NOT NULL AS user"))


@query("type_names", "SELECT 'bigint' AS a, 'text' AS b, 'numeric(10,2)' AS c, 'double precision[]' AS d")
def _(t):
    from tessel.sources.tables import type_name

    return t.spark.range(1).select(*(F.lit(type_name(x)).alias(n) for n, x in (("a", "bigint"), ("b", "string"), ("c", "decimal(10,2)"), ("d", "array<double>"))))
