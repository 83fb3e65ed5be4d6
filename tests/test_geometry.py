"""Streets, polygons and clipping: known worlds and brute force."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from footreach.operators import geometry, graph, streets

few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
POINTS = "array<struct<x:double,y:double>>"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def polygons(spark, *rings):
    return geometry.ring_edges(spark.createDataFrame([(k, r) for k, r in enumerate(rings)], f"poly long, points {POINTS}"), "poly")


def pieces(spark, roads):
    rows = [(k, n, float(x), float(y)) for k, (line, _) in enumerate(roads) for n, (x, y) in enumerate(line)]
    props = spark.createDataFrame([(k, p.get("highway"), p.get("bridge"), p.get("tunnel")) for k, (_, p) in enumerate(roads)], "line long, highway string, bridge string, tunnel string")
    own = streets.noded(spark.createDataFrame(rows, "line long, k int, x double, y double"))
    return own.join(props.select("line", "highway", streets.street_kind(F.col("highway"), F.col("bridge"), F.col("tunnel")).alias("kind")), "line")


RIVER, HOUSE = box(-600.0, -30.0, 600.0, 30.0), box(40.0, 40.0, 100.0, 90.0)
ROADS = [
    ([(0, 35), (0, 300)], {"highway": "residential"}), ([(0, -35), (0, 35)], {"highway": "residential", "bridge": "yes"}), ([(0, -300), (0, -35)], {"highway": "residential"}),
    ([(-200, 100), (200, 100)], {"highway": "residential"}), ([(-200, -100), (200, -100)], {"highway": "residential"}), ([(-120, -35), (-120, -300)], {"highway": "residential"}),
]


def costs(spark, edges, start, cutoff=900.0):
    at = {(round(r.x, 3), round(r.y, 3)): r.nid for r in streets.edge_nodes(edges).collect()}
    sources = spark.createDataFrame([(1, at[start])], "request_id long, nid long")
    by_id = {v: k for k, v in at.items()}
    return {by_id[r.nid]: r.cost_s for r in graph.costs_within(sources, edges, cutoff, streets.edge_nodes(edges)).collect()}


def test_the_bridge_is_the_only_way_over_the_river(spark):
    edges = streets.street_edges(streets.walkable(pieces(spark, ROADS), polygons(spark, HOUSE), polygons(spark, RIVER)))
    rows = edges.collect()
    assert [r.kind for r in rows if min(r.y1, r.y2) < 30 and max(r.y1, r.y2) > -30] == ["bridge"]
    reached = costs(spark, edges, (0.0, 300.0))
    assert reached[(0.0, -100.0)] == pytest.approx(400 / 70 * 60) and reached[(-120.0, -100.0)] == pytest.approx(520 / 70 * 60)
    # a crossing is one node of both lines
    node = streets.node_id(F.lit(0.0), F.lit(100.0))
    assert edges.where((F.col("u") == node) | (F.col("v") == node)).count() == 4


@pytest.mark.parametrize(("props", "crosses"), [({"highway": "footway", "tunnel": "yes"}, True), ({"highway": "footway"}, False), ({"highway": "residential", "tunnel": "yes"}, False)])
def test_only_walkers_tunnels_pass_under_the_river(spark, props, crosses):
    roads = [([(-200, 100), (200, 100)], {"highway": "residential"}), ([(-200, -100), (200, -100)], {"highway": "residential"}), ([(50, 100), (50, -100)], props)]
    edges = streets.street_edges(streets.walkable(pieces(spark, roads), None, polygons(spark, RIVER)))
    reached = costs(spark, edges, (-200.0, 100.0))
    assert ((200.0, -100.0) in reached) == crosses and (200.0, 100.0) in reached


def test_rail_cuts_roads_but_not_tunnels(spark):
    roads = [([(-200, 150), (80, 150)], {"highway": "residential"}), ([(120, 150), (300, 150)], {"highway": "residential"}), ([(80, 250), (120, 250)], {"highway": "residential"}), ([(80, 150), (120, 150)], {"highway": "footway", "tunnel": "yes"}), ([(100, 260), (100, 290)], {"highway": "path"}), ([(100, 300), (130, 300)], {"highway": "path"})]
    rail = spark.createDataFrame([(100.0, -300.0, 100.0, 300.0)], "cx1 double, cy1 double, cx2 double, cy2 double")
    edges = streets.street_edges(streets.walkable(pieces(spark, roads), None, None, rail))
    assert (300.0, 150.0) in costs(spark, edges, (80.0, 150.0))
    # the road across and the path along the rails are gone, the path that only touches them is not
    assert sorted((round(r.x1, 3), round(r.y1, 3)) for r in edges.collect()) == [(-200.0, 150.0), (80.0, 150.0), (100.0, 300.0), (120.0, 150.0)]


def test_junctions_shared_ends_and_rings(spark):
    roads = [([(0, 0), (100, 0)], {}), ([(50, 0), (50, 80)], {}), ([(100, 0), (100, 60)], {}), ([(20, -30), (20, 30), (80, 30), (80, -30)], {}), ([(200, 0), (260, 0), (260, 60), (200, 0)], {})]
    got = sorted((r.line, r.n, (round(r.x1, 3), round(r.y1, 3)), (round(r.x2, 3), round(r.y2, 3))) for r in pieces(spark, roads).collect())
    assert [(a, b) for line, _, a, b in got if line == 0] == [((0, 0), (20, 0)), ((20, 0), (50, 0)), ((50, 0), (80, 0)), ((80, 0), (100, 0))]
    assert [(a, b) for line, _, a, b in got if line == 1] == [((50, 0), (50, 30)), ((50, 30), (50, 80))]
    assert [(a, b) for line, _, a, b in got if line == 2] == [((100, 0), (100, 60))]
    assert len([1 for line, *_ in got if line == 3]) == 6
    assert [(a, b) for line, _, a, b in got if line == 4] == [((200, 0), (260, 0)), ((260, 0), (260, 60))]


@few
@given(st.integers(0, 10**6))
def test_noding_by_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = {k: [(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(rng.randrange(2, 5))] for k in range(25)}
    got = {}
    for r in streets.noded(spark.createDataFrame([(k, n, x, y) for k, line in lines.items() for n, (x, y) in enumerate(line)], "line long, k int, x double, y double"), 150.0).collect():
        got.setdefault(r.line, []).append((r.n, r.x1, r.y1, r.x2, r.y2))
    for k, line in lines.items():
        want = [(float(n), x, y) for n, (x, y) in enumerate(line)]
        for n, ((ax, ay), (bx, by)) in enumerate(zip(line, line[1:])):
            for j, other in lines.items():
                for (cx, cy), (dx, dy) in zip(other, other[1:]) if j != k else ():
                    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
                    t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
                    if 0 <= t <= 1 and 0 <= u <= 1:
                        want.append((n + t, ax + t * (bx - ax), ay + t * (by - ay)))
        own = sorted(got[k])
        path = [(own[0][1], own[0][2]), *((r[3], r[4]) for r in own)]
        assert len(path) == len(want) and all(math.dist(a, b[1:]) < 1e-6 for a, b in zip(path, sorted(want)))


def star(rng, cx, cy, n=9):
    return [(cx + rng.uniform(20, 120) * math.cos(2 * math.pi * k / n), cy + rng.uniform(20, 120) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def inside(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


@few
@given(st.integers(0, 10**6))
def test_points_in_polygons_with_holes(spark, seed):
    rng = random.Random(seed)
    outer = [star(rng, rng.uniform(0, 400), rng.uniform(0, 400)) for _ in range(6)]
    holes = [[(cx := sum(x for x, _ in r) / len(r)) - 8, (cy := sum(y for _, y in r) / len(r)) - 8, cx + 8, cy + 8] for r in outer]
    rings = [(k, r) for k, r in enumerate(outer)] + [(k, box(*h)) for k, h in enumerate(holes)]
    edges = geometry.ring_edges(spark.createDataFrame(rings, f"poly long, points {POINTS}"), "poly")
    points = [(i, rng.uniform(-100, 500), rng.uniform(-100, 500)) for i in range(300)]
    got = {(r.pid, r.poly) for r in geometry.covered(spark.createDataFrame(points, "pid long, x double, y double"), edges, "pid", 70.0).collect()}
    assert got == {(i, k) for i, x, y in points for k in range(6) if inside(outer[k], x, y) != inside(box(*holes[k]), x, y)}


def test_borders_and_corners_are_covered(spark):
    edges = polygons(spark, box(0.0, 0.0, 100.0, 100.0))
    points = [(1, 0.0, 50.0), (2, 100.0, 100.0), (3, 50.0, 0.0), (4, 50.0, 50.0), (5, 100.001, 50.0), (6, 0.0, 0.0), (7, 0.0, 100.5)]
    assert {r.pid for r in geometry.covered(spark.createDataFrame(points, "pid long, x double, y double"), edges, "pid", 30.0).collect()} == {1, 2, 3, 4, 6}
    segs = [(1, -10.0, 50.0, 0.0, 50.0), (2, 10.0, 10.0, 20.0, 20.0), (3, -10.0, 0.0, -1.0, 0.0), (4, -10.0, 50.0, 200.0, 60.0), (5, 0.0, -10.0, 0.0, 110.0), (6, 101.0, 0.0, 101.0, 90.0)]
    assert {r.sid for r in geometry.met(spark.createDataFrame(segs, "sid long, x1 double, y1 double, x2 double, y2 double"), edges, "sid", 30.0).collect()} == {1, 2, 4, 5}


@few
@given(st.integers(0, 10**6))
def test_clipped_tiles_add_up(spark, seed):
    rng = random.Random(seed)
    rings = [(k, star(rng, rng.uniform(0, 300), rng.uniform(0, 300))) for k in range(8)]
    tiles = spark.createDataFrame([(i, j, i * 90.0 - 200, j * 90.0 - 200, i * 90.0 - 110, j * 90.0 - 110) for i in range(9) for j in range(9)], "i int, j int, x0 double, y0 double, x1 double, y1 double")
    rows = spark.createDataFrame(rings, f"poly long, points {POINTS}").crossJoin(tiles)
    cut = rows.select("poly", geometry.ring_area(F.col("points")).alias("whole"), geometry.ring_area(geometry.clipped(*map(F.col, ("points", "x0", "y0", "x1", "y1")))).alias("part"), geometry.clipped(*map(F.col, ("points", "x0", "y0", "x1", "y1"))).alias("ring"), "x0", "x1")
    sums = {}
    for r in cut.collect():
        assert all(r.x0 - 1e-9 <= p.x <= r.x1 + 1e-9 for p in r.ring)
        sums.setdefault(r.poly, [r.whole, 0.0])[1] += r.part
    assert all(a == pytest.approx(b) for a, b in sums.values()) and len(sums) == 8


def test_cells_around_a_line(spark):
    rows = spark.createDataFrame([(1, 3.0, 4.0, 90.0, 40.0), (2, 5.0, 5.0, 5.0, 5.0)], "e long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.e, r.ix, r.iy) for r in geometry.cells_around(rows, "e", 30.0, 10.0).collect()}

    def away(px, py, ax, ay, bx, by):
        d = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / d)) if d else 0
        return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))

    assert got == {(r.e, i, j) for r in rows.collect() for i in range(-9, 20) for j in range(-9, 20) if away(i * 10 + 5, j * 10 + 5, r.x1, r.y1, r.x2, r.y2) <= 30}


def test_snapping_moves_to_the_grid_first(spark):
    nodes = spark.createDataFrame([(1, 12.5, 12.5), (2, 37.5, 12.5), (3, 12.5, 40.0), (4, 112.5, 41.0)], "nid long, x double, y double")
    points = spark.createDataFrame([(1, 24.9, 1.0), (2, 25.1, 1.0), (3, 12.0, 26.0), (4, 100.0, 5.0), (5, 300.0, 300.0)], "rid long, x double, y double")
    assert {r.rid: (r.nid, r.d) for r in streets.snapped(points, nodes, "rid").collect()} == {1: (1, 0.0), 2: (2, 0.0), 3: (3, 2.5), 4: (4, 28.5)}


@few
@given(st.integers(0, 10**6))
def test_hulls(spark, seed):
    rng = random.Random(seed)
    groups = {k: [(float(rng.randrange(-9, 10)), float(rng.randrange(-9, 10))) for _ in range(rng.randrange(1, 60))] for k in range(6)}
    rows = [(k, x, y) for k, own in groups.items() for x, y in own]
    rng.shuffle(rows)
    cross = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    for r in geometry.convex_hulls(spark.createDataFrame(rows, "k long, x double, y double").repartition(5), "k").collect():
        corners, points = [(c.x, c.y) for c in r.corners], set(groups[r.k])
        assert set(corners) <= points and len(set(corners)) == len(corners)
        for a, b, c in zip(corners, corners[1:] + corners[:1], corners[2:] + corners[:2]) if len(corners) > 2 else ():
            assert cross(a, b, c) > 0 and all(cross(a, b, p) >= 0 for p in points)
        if len(corners) < 3:
            assert len(points) < 3 or all(cross(corners[0], corners[-1], p) == 0 for p in points)


@few
@given(st.integers(0, 10**6))
def test_simplified_lines(spark, seed):
    rng = random.Random(seed)
    lines = {k: [(float(rng.randrange(0, 400)), float(rng.randrange(0, 400))) for _ in range(rng.randrange(2, 40))] for k in range(5)}
    lines[9] = [(0.0, 0.0), (50.0, 0.0), (0.0, 0.0)]

    def away(p, a, b):
        d = math.dist(a, b) ** 2
        t = max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / d)) if d else 0
        return math.hypot(p[0] - a[0] - t * (b[0] - a[0]), p[1] - a[1] - t * (b[1] - a[1]))

    def keep(line, lo, hi):
        own = [(away(line[k], line[lo], line[hi]), -k) for k in range(lo + 1, hi)]
        if not own or max(own)[0] <= 60:
            return {lo, hi}
        m = -max(own)[1]
        return keep(line, lo, m) | keep(line, m, hi)

    rows = spark.createDataFrame([(k, n, x, y) for k, own in lines.items() for n, (x, y) in enumerate(own)], "line long, k long, x double, y double")
    got = {}
    for r in streets.simplified(rows, 60.0).collect():
        got.setdefault(r.line, set()).add(r.k)
    for k, own in lines.items():
        assert all(min(away(own[n], own[a], own[b]) for a, b in zip(sorted(got[k]), sorted(got[k])[1:]) if a <= n <= b) <= 60 + 1e-9 for n in range(len(own)))
        assert got[k] == keep(own, 0, len(own) - 1)
