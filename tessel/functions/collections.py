"""Arrays, key-value maps (hstore), ranges, JSON documents, label paths (ltree) and plane geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- arrays (lower bound 1, one dimension)


def array_position(a: Column, v) -> Column:
    return F.nullif(F.array_position(a, v), F.lit(0).cast("bigint"))


def array_lower(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.lit(1))


def array_upper(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.size(a))


array_length = array_upper


def subscript(a: Column, i) -> Column:
    """Null out of range, for a null index and for an index below 1."""
    i = i if isinstance(i, Column) else F.lit(i)
    return F.when(i >= 1, F.get(a, i - 1))


def any_of(a: Column, test) -> Column:
    """x op ANY (array), three-valued: unknown if nothing is true and something is unknown."""
    return F.exists(a, test)


def all_of(a: Column, test) -> Column:
    return F.forall(a, test)


def series(start: Column, stop: Column, step: int = 1) -> Column:
    """generate_series of integers as an array: empty when it would run the wrong way, null arguments give none."""
    if step == 0:
        raise ValueError("step size cannot equal zero")
    right = start <= stop if step > 0 else start >= stop
    return F.when(right, F.sequence(start, F.when(right, stop), F.lit(step))).otherwise(F.array().cast("array<bigint>"))


def subscripts(a: Column, reverse: bool = False) -> Column:
    up = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a)))
    return F.reverse(up) if reverse else up


# ---------------------------------------------------------------- hstore as map<string, string>


def hstore_get(h: Column, k: str) -> Column:
    return F.try_element_at(h, F.lit(k))


def hstore_has(h: Column, k: str) -> Column:
    return F.map_contains_key(h, k)


def hstore_contains(a: Column, b: Column) -> Column:
    """a @> b: every pair of b is in a; equal nulls count."""
    return F.forall(F.map_entries(b), lambda e: F.map_contains_key(a, e["key"]) & F.try_element_at(a, e["key"]).eqNullSafe(e["value"]))


def hstore_concat(a: Column, b: Column) -> Column:
    """The right one wins, whatever the session's policy for equal keys."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def akeys(h: Column) -> Column:
    return F.array_sort(F.map_keys(h))


def avals(h: Column) -> Column:
    """Values in the order of their keys."""
    return F.transform(F.array_sort(F.map_keys(h)), lambda k: F.try_element_at(h, k))


# ---------------------------------------------------------------- ranges as struct<lo, hi, lo_inc, hi_inc>; a null bound is infinite


def make_range(lo: Column, hi: Column, bounds: str = "[)") -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"), (F.lit(bounds[0] == "[") & lo.isNotNull()).alias("lo_inc"), (F.lit(bounds[1] == "]") & hi.isNotNull()).alias("hi_inc"))


def date_range(lo: Column, hi: Column, bounds: str = "[)") -> Column:
    """Days are counted, so every date range is brought to the form [)."""
    lo = lo if bounds[0] == "[" else F.date_add(lo, 1)
    return make_range(lo, F.date_add(hi, 1) if bounds[1] == "]" else hi)


def range_empty(r: Column) -> Column:
    both = r["lo"].isNotNull() & r["hi"].isNotNull()
    return F.coalesce(both & ((r["lo"] > r["hi"]) | ((r["lo"] == r["hi"]) & ~(r["lo_inc"] & r["hi_inc"]))), F.lit(False))


def range_has(r: Column, x: Column) -> Column:
    low = r["lo"].isNull() | (r["lo"] < x) | (r["lo_inc"] & (r["lo"] == x))
    high = r["hi"].isNull() | (x < r["hi"]) | (r["hi_inc"] & (r["hi"] == x))
    return low & high & ~range_empty(r)


def range_overlaps(a: Column, b: Column) -> Column:
    def before(x: Column, y: Column) -> Column:  # x ends before y starts
        known = x["hi"].isNotNull() & y["lo"].isNotNull()
        return F.coalesce(known & ((x["hi"] < y["lo"]) | ((x["hi"] == y["lo"]) & ~(x["hi_inc"] & y["lo_inc"]))), F.lit(False))

    return ~range_empty(a) & ~range_empty(b) & ~before(a, b) & ~before(b, a)


def lower_inf(r: Column) -> Column:
    return r["lo"].isNull() & ~range_empty(r)


def upper_inf(r: Column) -> Column:
    return r["hi"].isNull() & ~range_empty(r)


# ---------------------------------------------------------------- JSON text


def json_get_text(doc: Column, key: str) -> Column:
    """doc ->> key."""
    return F.get_json_object(doc, f"$['{key}']")


def json_get(doc: Column, key: str) -> Column:
    """doc -> key, as JSON text: strings keep their quotes."""
    return F.to_json(F.variant_get(F.parse_json(doc), f"$['{key}']", "variant"))


def json_contains_pairs(a: Column, b: Column) -> Column:
    """a @> b for flat objects of scalars."""
    left, right = (F.from_json(x, "map<string,string>") for x in (a, b))
    return hstore_contains(left, right)


def json_merge_flat(a: Column, b: Column) -> Column:
    """a || b for flat objects of strings, keys in order."""
    both = hstore_concat(*(F.from_json(x, "map<string,string>") for x in (a, b)))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both))))


# ---------------------------------------------------------------- label paths


def nlevel(p: Column) -> Column:
    return F.when(p == "", F.lit(0)).otherwise(F.size(F.split(p, "[.]")))


def is_ltree(p: Column) -> Column:
    return p.rlike(r"^([A-Za-z0-9_\-]+(\.[A-Za-z0-9_\-]+)*)?$")


def ltree_is_ancestor(a: Column, b: Column) -> Column:
    """a @> b."""
    return (a == "") | (a == b) | F.startswith(b, F.concat(a, F.lit(".")))


# ---------------------------------------------------------------- plane geometry: points are struct<x, y>, polygons arrays of them


EPSILON = 1e-6


def box_of(poly: Column) -> Column:
    xs, ys = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def boxes_overlap(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def _edges(poly: Column) -> Column:
    return F.arrays_zip(poly.alias("a"), F.concat(F.slice(poly, 2, F.size(poly)), F.slice(poly, 1, 1)).alias("b"))


def polygon_has_point(poly: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over the edges; points on an edge count as inside on lower and left edges."""
    crossed = F.filter(_edges(poly), lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"]))
    return F.size(crossed) % 2 == 1


def _distance(p: Column, e: Column) -> Column:
    """Of a point from an edge."""
    a, dx, dy = e["a"], e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    along = ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), along)), F.lit(0.0))  # an edge of no length is a point
    return F.hypot(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)


def _in_ring(poly: Column, p: Column) -> Column:
    """Inside or within EPSILON of an edge."""
    return F.exists(_edges(poly), lambda e: _distance(p, e) <= EPSILON) | polygon_has_point(poly, p["x"], p["y"])


def _edges_cross(p: Column, q: Column) -> Column:
    """Whether an edge of p and one of q cross; touching is not crossing."""

    def side(e: Column, c: Column) -> Column:
        return F.signum((e["b"]["x"] - e["a"]["x"]) * (c["y"] - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (c["x"] - e["a"]["x"]))

    def cross(e: Column, f: Column) -> Column:
        apart = (_distance(f["a"], e) > EPSILON) & (_distance(f["b"], e) > EPSILON) & (_distance(e["a"], f) > EPSILON) & (_distance(e["b"], f) > EPSILON)
        return apart & (side(e, f["a"]) * side(e, f["b"]) < 0) & (side(f, e["a"]) * side(f, e["b"]) < 0)

    return F.exists(_edges(p), lambda e: F.exists(_edges(q), lambda f: cross(e, f)))


def polygons_overlap(p: Column, q: Column) -> Column:
    """p && q: a vertex of one in the other, or crossing edges; touching counts."""
    return F.exists(p, lambda v: _in_ring(q, v)) | F.exists(q, lambda v: _in_ring(p, v)) | _edges_cross(p, q)


def polygon_contains(outer: Column, inner: Column) -> Column:
    """outer @> inner: all vertices inside and no crossing edges, as an edge can leave a concave polygon between two vertices."""
    return F.forall(inner, lambda v: _in_ring(outer, v)) & ~_edges_cross(outer, inner)


def same_point(a: Column, b: Column) -> Column:
    """a ~= b, by coordinate within EPSILON; NaN is the same as anything."""
    near = lambda d: F.isnan(d) | (F.abs(d) <= EPSILON)
    return near(a["x"] - b["x"]) & near(a["y"] - b["y"])


def same_points(p: Column, q: Column) -> Column:
    """p ~= q of segments, boxes and paths: the same points in order."""
    return (F.size(p) == F.size(q)) & F.forall(F.arrays_zip(p.alias("a"), q.alias("b")), lambda e: same_point(e["a"], e["b"]))


def same_polygon(p: Column, q: Column) -> Column:
    """p ~= q of polygons: q's ring may start anywhere and run either way."""
    turned = lambda r, k: F.concat(F.slice(r, k + 1, F.size(r)), F.slice(r, F.lit(1), k))
    starts = F.sequence(F.lit(0), F.greatest(F.size(q) - 1, F.lit(0)))
    return F.exists(starts, lambda k: same_points(p, turned(q, k)) | same_points(p, turned(F.reverse(q), k)))


def is_closed(path: Column) -> Column:
    return path["closed"]


def is_open(path: Column) -> Column:
    return ~path["closed"]
