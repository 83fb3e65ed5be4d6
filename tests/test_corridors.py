"""Ways through buildings and along routes: known worlds."""

import math

import pytest
from pyspark.sql import functions as F

from footreach.operators import corridors, geometry

POINTS = "array<struct<x:double,y:double>>"


def box(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def rings(spark, *rows):
    return spark.createDataFrame([(p, r, pts) for p, r, pts in rows], f"poly long, ring int, points {POINTS}")


def nodes(spark, *points):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points, 1)], "nid long, x double, y double")


def ways(df):
    return sorted((r.kind, *sorted([(round(r.x1, 6), round(r.y1, 6)), (round(r.x2, 6), round(r.y2, 6))]), round(r.w, 6)) for r in df.collect())


def seconds(m, speed):
    return round(m / speed * 60, 6)


def test_a_mall_links_its_nodes_and_joins_entrances_in_the_order_of_the_outline(spark):
    at = nodes(spark, (50, -10), (110, 30), (50, 70), (50, -21))  # the last one is 21 m off
    found = ways(corridors.through_buildings(rings(spark, (1, 0, box(0, 0, 100, 60))), at))
    south, east, north = (50.0, 0.0), (100.0, 30.0), (50.0, 60.0)
    links = [("link", (50.0, -10.0), south, seconds(10, 70)), ("link", east, (110.0, 30.0), seconds(10, 70)), ("link", north, (50.0, 70.0), seconds(10, 70))]
    inner = [("corridor", south, east, seconds(math.hypot(50, 30), 77)), ("corridor", north, east, seconds(math.hypot(50, 30), 77)), ("corridor", south, north, seconds(60, 77))]
    assert found == sorted(links + inner)


def test_a_way_that_leaves_the_building_goes_over_the_centroid(spark):
    # an L: from the end of one arm to the end of the other the straight way runs outside
    ell = [(0.0, 0.0), (100.0, 0.0), (100.0, 20.0), (20.0, 20.0), (20.0, 100.0), (0.0, 100.0)]
    found = ways(corridors.through_buildings(rings(spark, (1, 0, ell)), nodes(spark, (105, 15), (15, 105))))
    c = (round((2000 * 50 + 1600 * 10) / 3600, 6), round((2000 * 10 + 1600 * 60) / 3600, 6))
    assert [w[:3] for w in found if w[0] == "corridor"] == sorted([("corridor", *sorted([(100.0, 15.0), c])), ("corridor", *sorted([(15.0, 100.0), c]))])


def test_a_courtyard_is_no_way(spark):
    yard = rings(spark, (1, 0, box(0, 0, 100, 100)), (1, 1, box(40, 40, 60, 60)))
    sides = corridors.ring_sides(yard)
    chords = spark.createDataFrame([(1, 1, 0.0, 50.0, 100.0, 50.0), (2, 1, 0.0, 30.0, 100.0, 30.0), (3, 1, 0.0, 40.0, 100.0, 40.0), (4, 1, 0.0, 0.0, 100.0, 0.0), (5, 1, 0.0, 0.0, 100.0, 100.0)], "c long, poly long, x1 double, y1 double, x2 double, y2 double")
    # along a border of the yard or of the building is inside
    assert sorted(r.c for r in corridors.held_inside(chords, sides, "c").collect()) == [2, 3, 4]
    assert [tuple(r) for r in corridors.centroids(sides).collect()] == [(1, pytest.approx(50), pytest.approx(50))]


def test_links_do_not_pass_walls_and_entrances_stay(spark):
    wall = geometry.ring_edges(spark.createDataFrame([(9, box(40, -8, 60, -5))], f"poly long, points {POINTS}"), "poly")
    found = ways(corridors.through_buildings(rings(spark, (1, 0, box(0, 0, 100, 60))), nodes(spark, (50, -10), (50, 70)), wall))
    assert [w[0] for w in found] == ["corridor", "link"]
    assert found[0][1:3] == ((50.0, 0.0), (50.0, 60.0))


def test_one_entrance_nothing_inside_and_nodes_within(spark):
    hall = rings(spark, (1, 0, box(0, 0, 200, 200)))
    assert [w[0] for w in ways(corridors.through_buildings(hall, nodes(spark, (100, -5))))] == ["link"]
    # a node deep inside has its entrance however far
    assert ways(corridors.through_buildings(hall, nodes(spark, (100, 60))))[0][1:3] == ((100.0, 0.0), (100.0, 60.0))
    assert ways(corridors.through_buildings(hall.where("false"), nodes(spark, (1, 1)))) == []


def route(spark, *rows):
    return spark.createDataFrame([(r, d, k, float(x), float(y)) for r, d, pts in rows for k, (x, y) in enumerate(pts)], "request_id long, direction string, k int, x double, y double")


def test_routes_are_cut_where_the_time_ends(spark):
    routes = route(spark, (1, "E", [(0, 0), (300, 0), (300, 300)]), (1, "N", [(0, 0), (0, 400), (0, 900)]), (1, "W", [(0, 0), (0, 0), (-100, 0)]))
    layers = spark.createDataFrame([(1, 5)], "request_id long, minutes int")
    got = sorted((r.x2, r.y2) for r in corridors.cut_routes(routes, layers).collect())
    assert got == [(-100.0, 0.0), (0.0, 400.0), (300.0, 0.0), (300.0, 100.0)]


def test_corridor_layers_grow_and_stay_in_reach(spark):
    turns = [(k, math.radians(45 * k)) for k in range(8)]
    routes = route(spark, *((1, str(k), [(100 * n * math.cos(a), 100 * n * math.sin(a)) for n in range(13)]) for k, a in turns))
    layers = spark.createDataFrame([(1, m) for m in (5, 10, 15)], "request_id long, minutes int")
    centres = spark.createDataFrame([(1, 0.0, 0.0)], "request_id long, x double, y double")
    cells = corridors.corridor_cells(routes, layers, centres).collect()
    area = {m: 100 * sum(c.minutes == m for c in cells) for m in (5, 10, 15)}
    assert 0 < area[5] < area[10] < area[15]
    # eight arms of 100 m width that meet within 50 / tan 22.5 degrees, and half discs at their ends
    meet = 50 / math.tan(math.radians(22.5))
    fine = corridors.corridor_cells(routes, layers.where("minutes = 15"), centres, 2.0).count() * 4
    assert fine == pytest.approx(8 * ((1200 - meet) * 100 + math.pi * 2500 / 2 + meet * 50), rel=0.01)
    assert max(math.hypot((c.ix + 0.5) * 10, (c.iy + 0.5) * 10) for c in cells) <= 1250


def test_fewer_than_three_directions_give_no_ground(spark):
    routes = route(spark, (1, "E", [(0, 0), (300, 0)]), (1, "N", [(0, 0), (0, 300)]), (1, "W", [(0, 0)]))
    layers, centres = spark.createDataFrame([(1, 5)], "request_id long, minutes int"), spark.createDataFrame([(1, 0.0, 0.0)], "request_id long, x double, y double")
    assert corridors.corridor_cells(routes, layers, centres).count() == 0
    assert corridors.corridor_cells(routes.unionByName(route(spark, (1, "S", [(0, 0), (0, -300)]))), layers, centres).where(F.col("minutes") == 5).count() > 0


def test_cells_are_counted_where_they_are_made(spark):
    """No cell is shuffled or made a row, also where a layer's ways lie far apart; the numbers are those of corridor_cells()."""
    routes = route(spark, *((r, str(d), [(r * 7 + 90 * k * math.cos(d), -50 * r + (90 + r) * k * math.sin(d)) for k in range(9)]) for r in range(6) for d in range(2 + r % 3)), (9, "N", [(0, 0), (0, 3)]), (9, "S", [(0, 0), (0, 0), (0, -3)]), (9, "E", [(1e7, 1e7), (1e7, 1e7 + 77)]))
    layers = routes.select("request_id").distinct().join(spark.createDataFrame([(5,), (10,)], "minutes int"))
    centres = layers.select("request_id", F.col("request_id").cast("double").alias("x"), F.lit(3.0).alias("y")).distinct()
    want = {(r.request_id, r.minutes): r["count"] for r in corridors.corridor_cells(routes, layers, centres).groupBy("request_id", "minutes").count().collect()}
    counts = corridors.corridor_counts(routes, layers, centres)
    assert {(r.request_id, r.minutes): r.cells for r in counts.collect()} == want and len(want) == 10
    assert "Generate explode(sequence" not in counts._jdf.queryExecution().executedPlan().toString()
