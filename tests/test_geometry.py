"""Polygons, paths and weights."""

import pytest
from pyspark.sql import functions as F

from tessel.functions import collections as C
from tessel.functions import textsearch as TS


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def poly(*points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


SQUARE = ((0, 0), (4, 0), (4, 4), (0, 4))


def test_polygons_overlap(spark):
    corner, far = poly((0, 0), (4, 0), (0, 4)), poly((4, 4), (4, 3), (3, 4))
    cross = poly((-1, 1), (5, 1), (5, 2), (-1, 2))  # no vertex in the square
    touching = [poly((4, 0), (8, 0), (8, 4), (4, 4)), poly((4, 4), (6, 4), (6, 6))]
    assert one(spark, C.boxes_overlap(C.box_of(corner), C.box_of(far)), C.polygons_overlap(corner, far), C.polygons_overlap(far, corner)) == (True, False, False)
    assert one(spark, *(C.polygons_overlap(poly(*SQUARE), x) for x in (cross, *touching, poly((1, 1), (2, 1), (1, 2)), poly((9, 9), (10, 9), (9, 10))))) == (True, True, True, True, False)


def test_polygon_contains(spark):
    u = poly((0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6))
    bridge = poly((1, 4), (5, 4), (5, 5), (1, 5))  # all vertices in the arms, edges across the gap
    assert one(spark, C.polygon_contains(u, bridge), C.polygon_contains(u, poly((0, 0), (6, 0), (3, 1))), C.polygon_contains(poly((0, 0), (6, 0), (3, 1)), u), C.polygon_contains(u, u)) == (False, True, False, True)


def test_same_and_open(spark):
    turned, back, shuffled = SQUARE[2:] + SQUARE[:2], SQUARE[::-1], (SQUARE[0], SQUARE[2], SQUARE[1], SQUARE[3])
    assert one(spark, *(C.same_polygon(poly(*SQUARE), poly(*x)) for x in (turned, back, shuffled, SQUARE[:3]))) == (True, True, False, False)
    assert one(spark, C.same_points(poly(*SQUARE), poly(*SQUARE)), C.same_points(poly(*SQUARE), poly(*turned)), C.same_polygon(poly((1, 1)), poly((1, 1.0000001)))) == (True, False, True)
    path = F.struct(poly(*SQUARE).alias("points"), F.lit(False).alias("closed"))
    assert one(spark, C.is_open(path), C.is_closed(path)) == (True, False)


def test_setweight(spark):
    v = TS.to_tsvector(F.lit("fat cat fat"))
    weighted, plain = one(spark, TS.setweight(v, "a"), TS.positions(TS.setweight(v, "B")))
    assert {k: [tuple(p) for p in ps] for k, ps in weighted.items()} == {"cat": [(2, "A")], "fat": [(1, "A"), (3, "A")]} and plain == {"cat": [2], "fat": [1, 3]}
    with pytest.raises(ValueError):
        TS.setweight(v, "e")
