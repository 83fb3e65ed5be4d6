"""Walks that are answered in the task of their tile, against the joins that shuffled every piece, cost and cell: each test failed before
its change."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from footreach import config as C
from footreach.operators import coverage as V
from footreach.operators import geometry as Y
from footreach.operators import graph as G
from footreach.operators import poi as P
from footreach.operators import spatial as S
from footreach.operators import streets as W
from footreach.operators import walks as K
from footreach.plans import joins, ranking, shapes

SF = "/root/testdata/sf0.001"
POINTS = "array<struct<x: double, y: double>>"


@pytest.fixture(scope="module")
def world(spark):
    """Lines, rings, rails and requests over six tiles, on both sides of zero; holes, steps, bridges, tunnels, shared ends, a line that
    comes back to itself, requests at one node and far from all."""
    rng = np.random.default_rng(4)
    lines, ends = [], []
    for i in range(2500):
        first = ends[-1] if i % 3 == 2 else rng.uniform((-7000, -2500), (7000, 3500))
        way = np.cumsum(np.vstack([first, rng.uniform(-170, 170, (2 + i % 3, 2))]), axis=0)
        ends.append(way[-1])
        way = np.vstack([way, way[:1]]) if i % 17 == 0 else way
        kind = "bridge" if i % 13 == 0 else "tunnel" if i % 11 == 0 else "road"
        lines.append((i, [tuple(map(float, p)) for p in way], kind, "steps" if i % 7 == 0 else "residential"))
    rings = []
    for i, (x, y) in enumerate(rng.uniform((-7000, -2500), (7000, 3500), (400, 2))):
        star = lambda r, n: [(float(x + r * (1 + k % 2) * np.cos(2 * np.pi * k / n)), float(y + r * np.sin(2 * np.pi * k / n))) for k in range(n)]  # noqa: E731,B023
        rings += [(i, ("wall", "water", "green")[i % 3], 0, star(60.0, 8))] + ([(i, ("wall", "water", "green")[i % 3], 1, star(25.0, 4))] if i % 2 else [])
    rails = [(1000.0, -2500.0, 1300.0, 3500.0), (-7000.0, 10.0, 7000.0, 60.0)]
    near = [p for i, (_, way, *_) in enumerate(lines) for p in way[1:2] if i % 5 == 0]
    asked = [(i, x + float(rng.uniform(-15, 15)), y + float(rng.uniform(-15, 15))) for i, (x, y) in enumerate(near)] + [(9000, near[0][0], near[0][1]), (9001, near[0][0] + 0.1, near[0][1]), (9002, 90000.0, 1.0)]
    return (
        spark.createDataFrame(lines, f"line long, points {POINTS}, kind string, highway string"), spark.createDataFrame(rings, f"poly long, use string, ring int, points {POINTS}"),
        spark.createDataFrame(rails, "cx1 double, cy1 double, cx2 double, cy2 double"), spark.createDataFrame(asked, "request_id long, x double, y double"),
    )


@pytest.fixture(scope="module")
def joined(spark, world):
    """Edges, starts and costs by joins."""
    lines, rings, rails, asked = world
    vertices = lines.select("line", F.posexplode("points").alias("k", "p")).select("line", "k", "p.x", "p.y")
    outlines = Y.ring_edges(rings, "poly", "use", "ring")
    pieces = W.noded(vertices).join(lines.select("line", "kind", "highway"), "line")
    edges = G.written(W.street_edges(W.walkable(pieces, outlines.where("use = 'wall'"), outlines.where("use = 'water'"), rails)))
    nodes = W.edge_nodes(edges)
    starts = G.written(W.snapped(asked, nodes, "request_id"))
    costs = G.written(G.costs_within(starts.select(F.col("nid").alias("request_id"), "nid").distinct(), edges, 300, nodes).withColumnRenamed("request_id", "start"))
    return edges, nodes, outlines.where("use <> 'green'"), starts, costs


def by_batches(spark, make):
    for room in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", room)
        yield dict(map(tuple, make().collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ground_is_made_in_the_task_of_its_tile(spark, world, joined):
    edges, _, solid, starts, costs = joined
    cells = shapes.reached_cells(costs, shapes.ground_cells(edges, solid)).groupBy("start").count()
    want = dict(map(tuple, starts.join(cells, starts.nid == cells.start).select("request_id", "count").collect()))
    for got in by_batches(spark, lambda: K.ground(*world, 300, 30.0, 15.0)):
        assert got == want and 300 < len(want) < world[3].count()
    plan = shapes.iso_ground(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning") == 1
    none = [df.limit(0) for df in world]
    assert K.ground(*none[:3], world[3], 300, 30.0, 15.0).count() == K.ground(*world[:3], none[3], 300, 30.0, 15.0).count() == 0


def test_hulls_are_made_in_the_task_of_their_tile(spark, world, joined):
    edges, nodes, _, starts, costs = joined
    ends = edges.select(F.explode(F.array("u", "v")).alias("nid"), F.array("u", "v").alias("ends"))
    near = costs.join(ends, "nid").select("start", F.explode("ends").alias("nid")).distinct().join(nodes, "nid")
    areas = Y.convex_hulls(near.select("start", "x", "y"), "start").select("start", Y.ring_area(F.col("corners")).alias("area"))
    want = dict(map(tuple, starts.join(areas, starts.nid == areas.start).select("request_id", "area").collect()))
    for got in by_batches(spark, lambda: K.hulls(*world, 300)):
        assert got == pytest.approx(want, abs=1e-6) and 300 < len(want) < world[3].count()
    plan = shapes.fast_hull(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning") == 1


@pytest.fixture(scope="module")
def places(spark):
    """Clean places with traits, of which clinics, merges, closed ones and ties are frequent, faces, and measured minutes."""
    rng = np.random.default_rng(6)
    rows = []
    for i, (x, y) in enumerate(rng.uniform((-7500, -3000), (7500, 4000), (6000, 2))):
        category = ("convenience", "leisure", "mall", "education", "health", "public", "transport")[i % 7]
        clinic = f"c{i % 3}" if category == "health" and i % 2 else None
        merge = i - i % 70 if category in ("public", "transport") else i
        rows.append((i, i, category, ("metro", "bus", None)[i % 3] if category == "transport" else None, merge, int(rng.integers(0, 3)), int(i % 4 == 0), clinic, 700 + i % 7, float(x), float(y)))
    faces = [(k, float(x), float(y), float(x + 150 + 10 * k), float(y + 90)) for k, (x, y) in enumerate(rng.uniform((-7000, -2500), (7000, 3500), (60, 2)))]
    inside = [(i, k) for i, *_, x, y in rows for k, x0, y0, x1, y1 in faces if max(x0 - x, x - x1, 0) ** 2 + max(y0 - y, y - y1, 0) ** 2 <= 3600]
    frame = spark.createDataFrame(rows, "id long, seq long, category string, transport_kind string, merge long, lead int, closed int, clinic string, cat_total int, x double, y double")
    return frame, spark.createDataFrame(faces, "box long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(list(dict(inside).items()), "id long, face long")


def by_joins(spark, places, asked, costs, nodes, measured):
    """The scores' rows by joins of costs, places, faces and measured minutes."""
    own, faces, inside = places
    pairs = S.radius_join(asked, own.withColumnsRenamed({"x": "x2", "y": "y2"}), 1200.0)
    legs = joins.near_boxes(nodes, faces, 265.0).select(F.col("box").alias("face"), "nid", F.greatest(F.col("d") - 15, F.lit(0.0)).alias("leg"))
    walk = P.calibrated(P.walk_minutes(pairs, costs, nodes, faces=inside, face_nodes=legs), measured)
    return {(r.request_id, r.category): r for r in V.coverage(asked, P.selected(walk), V.category_rows(spark)).collect()}


def numbered(places):
    own, _, inside = places
    first = own.groupBy("clinic").agg(F.min("id").alias("first"))
    number = F.array_position(F.array(*map(F.lit, C.CATEGORIES)), F.col("category")) - 1
    return own.join(first, "clinic", "left").drop("clinic").withColumnRenamed("first", "clinic").withColumn("cat_no", number).join(inside, "id", "left")


def same(spark, want, counted, cells):
    """The same coverage for batches of all sizes, and the given cells."""
    for room in ("40", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", room)
        rows = counted.withColumn("category", F.element_at(F.array(*map(F.lit, C.CATEGORIES)), F.col("cat_no") + 1))
        got = {(r.request_id, r.category): r for r in V.verdicts(rows, "cells").collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            for c in ("cnt", "within_count", "total", "passed", "in_time", "mode"):
                assert r[c] == want[k][c], (k, c)
            assert r.nearest_minutes == pytest.approx(want[k].nearest_minutes, abs=1e-9)
            assert r.cells == cells.get(r.request_id, 0)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_street_circles_are_closed_in_the_task_of_their_tile(spark, world, joined, places):
    edges, nodes, solid, starts, costs = joined
    middle = lambda c: ((F.floor(F.col(c) / 25.0) + 0.5) * 25.0).alias(f"tile_{c}")
    asked = world[3].select("*", (4 + F.col("request_id") % 3).cast("int").alias("minutes"), middle("x"), middle("y"))
    measured = asked.crossJoin(places[0].select("id")).where("(request_id * 31 + id * 17) % 200 = 0").select("request_id", "id", (1.0 + F.col("id") % 9).alias("measured_min"))
    own = asked.join(starts.select("request_id", F.col("nid").alias("start")), "request_id")
    want = by_joins(spark, places, own, costs, nodes, measured)
    ground = shapes.reached_cells(costs, shapes.ground_cells(edges, solid)).groupBy("start").count()
    cells = dict(map(tuple, starts.join(ground, starts.nid == ground.start).select("request_id", "count").collect()))
    counted = K.street_circles(*world[:3], numbered(places), places[1], measured.join(asked.select("request_id", "tile_x", "tile_y"), "request_id"), asked, 300, 1200.0, 30.0, 15.0)
    same(spark, want, counted, cells)
    assert sum(r.cnt for r in want.values()) > 500
    # places, requests and minutes meet in joins, but neither pieces, costs, cells nor pairs of requests and places do
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "nid" not in plan and "cost_s" not in plan


def test_circles_are_closed_in_the_task_of_their_tile(spark, world, joined, places):
    """Over a graph of edges, with ids above 2^53 and a request at a node without an edge."""
    edges, nodes, _, starts, costs = joined
    at = lambda k, n: nodes.select(F.col("nid").alias(k), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    graph = edges.select("u", "v", "w").join(at("u", 1), "u").join(at("v", 2), "v")
    begin = starts.select("request_id", "nid").join(nodes.withColumnsRenamed({"x": "tile_x", "y": "tile_y"}), "nid").join(world[3], "request_id")
    alone = spark.createDataFrame([(9500, 5, 3.0, 4.0, 3.5, 4.5)], "request_id long, nid long, tile_x double, tile_y double, x double, y double")
    asked = G.written(begin.unionByName(alone).withColumn("minutes", (4 + F.col("request_id") % 3).cast("int")))
    assert asked.agg(F.max(F.abs("nid"))).first()[0] > 1 << 53
    measured = asked.crossJoin(places[0].select("id")).where("(request_id * 31 + id * 17) % 200 = 0").select("request_id", "id", (1.0 + F.col("id") % 9).alias("measured_min"))
    lone = spark.createDataFrame([(5, 5, 0.0)], "start long, nid long, cost_s double")
    spots = nodes.unionByName(spark.createDataFrame([(5, 3.0, 4.0)], "nid long, x double, y double"))
    whole = costs.select("start", "nid", "cost_s").unionByName(lone)
    want = by_joins(spark, places, asked.withColumnRenamed("nid", "start"), whole, spots, measured)
    cells = dict(map(tuple, asked.join(whole.groupBy("start").count(), F.col("start") == F.col("nid")).select("request_id", "count").collect()))
    counted = K.edge_circles(graph, numbered(places), places[1], measured.join(asked.select("request_id", "tile_x", "tile_y"), "request_id"), asked, 300, 1200.0)
    same(spark, want, counted, cells)
    plan = ranking.life_circle(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "cost_s" not in plan
