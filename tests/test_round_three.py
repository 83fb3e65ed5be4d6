"""Findings of the third round: each test failed before its change."""

import numpy as np
from pyspark.sql import functions as F

from footreach.functions import text
from footreach.operators import blind as B
from footreach.operators import geometry as Y
from footreach.operators import graph as G
from footreach.operators import outline as O
from footreach.operators import spatial as S
from footreach.plans import joins, shapes


def test_lines_keep_their_first_characters(spark):
    """The line's number is no trim characters: digits at its ends stay."""
    rows = spark.createDataFrame([("0a0\n 1b1 \n\n22",)], "t string")
    assert rows.select(text.text_lines(F.col("t")).alias("l")).first().l == ["0a0", "1b1", "22"]


def test_parity_alone_gives_a_border_to_one_side(spark):
    square = lambda poly, x: [(poly, float(a), float(b), float(c), float(d)) for a, b, c, d in ((x, 0, x + 10, 0), (x + 10, 0, x + 10, 10), (x + 10, 10, x, 10), (x, 10, x, 0))]
    edges = spark.createDataFrame(square(1, 0) + square(2, 10), "poly int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 10.0, 5.0), (2, 5.0, 5.0), (3, 20.0, 5.0)], "id int, x double, y double")
    found = lambda border: sorted(tuple(r) for r in Y.covered(points, edges, "id", border=border).collect())
    assert found(True) == [(1, 1), (1, 2), (2, 1), (3, 2)]
    assert found(False) == [(1, 2), (2, 1)]


def test_cells_of_a_radius_join_are_not_sent_to_all_tasks(spark):
    points = lambda *c: spark.range(50).select(F.col("id").alias(c[0]), (F.col("id") * 7 % 50).cast("double").alias(c[1]), (F.col("id") * 3 % 50).cast("double").alias(c[2]))
    pairs = S.radius_join(points("a", "x", "y"), points("b", "x2", "y2"), 10.0)
    assert pairs.count() == sum((7 * a % 50 - 7 * b % 50) ** 2 + (3 * a % 50 - 3 * b % 50) ** 2 <= 100 for a in range(50) for b in range(50))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_bounded_groups_are_closed_without_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = sorted({(int(g), int(x), int(y)) for g, x, y in zip(rng.integers(0, 40, 2500), rng.integers(-9, 9, 2500), rng.integers(-9, 9, 2500), strict=True)})
    cells = spark.createDataFrame(rows, "grp long, ix long, iy long").repartition(5)
    own = O.ring_stats(O.rings(cells)).groupBy("grp").agg(F.sum("area").alias("cells"), F.count_if(F.col("area") > 0).alias("parts"), F.count_if(F.col("area") < 0).alias("holes"), F.sum("length").alias("sides"))
    parts = B.parts(cells).groupBy("grp", "part").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max("n").alias("largest"))
    want = sorted(tuple(r) for r in own.join(parts, "grp").select("grp", "cells", "parts", "holes", "sides", "largest").collect())
    monkeypatch.setattr(G, "written", None)  # rounds are written
    monkeypatch.setattr(G, "components", None)
    assert sorted(tuple(r) for r in O.shapes_within(cells).collect()) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(tuple(r) for r in O.shapes_within(cells).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges_at_what_is_found_are_counted_in_its_tile(spark):
    """Requests travel with their search: several at one node, one without arcs, and sums of edges that equal the join's."""
    rng = np.random.default_rng(5)
    at = rng.uniform(0, 900, (60, 2))
    near = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 58, (150, 2)) if a != b})
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "nid long, x double, y double")
    edges = spark.createDataFrame([(a, b, float(np.hypot(*(at[a] - at[b])) * rng.uniform(0.5, 1))) for a, b in near], "u long, v long, w double")
    sources = spark.createDataFrame([(i, n, i / 2) for i, n in enumerate([3, 3, 3, 11, 25, 59, 40])], "request_id long, nid long, far double")
    for room in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", room)
        found = G.found_in_tiles(sources, G.both_ways(edges), nodes, 400.0, 150.0, ("far",), True)
        rows = found.collect()
        assert {(r.request_id, r.nid): round(r.cost_s, 6) for r in rows} == {(r.request_id, r.nid): round(r.cost_s, 6) for r in G.costs_within(sources, edges, 400.0).collect()}
        assert all(r.far == r.request_id / 2 and (r.nx, r.ny) == tuple(at[r.nid]) for r in rows)
        want = dict(G.reachable_edges(found.select("request_id", "nid", "cost_s"), edges).groupBy("request_id").count().collect())
        assert {r.request_id: r.n for r in found.groupBy("request_id").agg(F.sum("edges").alias("n")).collect() if r.n} == want
        assert dict(G.least_found(found).collect()) == {r.request_id: r.nid for r in sources.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_requests_settle_where_they_are_read_and_rings_are_dealt_out(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sf = "/root/testdata/sf0.001"
    assert "hashpartitioning" not in plan(joins.pick_region(spark, sf))
    assert "REPARTITION_BY_NUM" in plan(shapes.tile_clip(spark, sf))


def test_cells_of_discs_are_made_where_it_is_known_that_they_are_blind(spark):
    """The same cells as the anti join's, for requests at borders of tiles, without places and without a place of their own; no cell is
    shuffled."""
    rng = np.random.default_rng(8)
    at = np.round(rng.uniform(-7000, 7000, (60, 2)), 1)
    asked = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(90, 0.0, 0.0), (91, 2001.0, -2001.0), (92, 50000.0, 0.0), (93, None, 1.0), (5, 3.0, 3.0)], "request_id long, x double, y double").repartition(4)
    places = spark.createDataFrame([("abc"[int(g)], float(x), float(y)) for g, x, y in zip(rng.integers(0, 3, 150), *np.round(rng.uniform(-8000, 8000, (2, 150)), 1), strict=True)] + [("a", 2000.0, 0.0), ("b", 0.0, -2000.0), ("x", 0.0, 0.0)], "grp string, x2 double, y2 double")
    own = B.blind_discs(asked, places, ["a", "b"])
    assert own.schema.simpleString() == "struct<request_id:bigint,grp:string,ix:int,iy:int>"
    want = sorted(map(tuple, B.blind_cells(B.disc_cells(asked), places, ["a", "b"]).collect()))
    for room in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", room)
        assert sorted(map(tuple, own.collect())) == want and 10_000 < len(want) < 2 * 317 * 65
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = joins.blind(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning") == 1


def test_open_vertices_carry_their_ends(spark, monkeypatch):
    """Tracks of several rounds, equally far vertices among them; a round reads no vertex that isn't open."""
    from footreach.operators import streets as W

    rng = np.random.default_rng(2)
    tracks = {i: [(float(x), float(y)) for x, y in rng.integers(0, 9, (int(n), 2))] for i, n in enumerate(rng.integers(1, 30, 25))}
    tracks[50] = [(0.0, 0.0), (1.0, 5.0), (2.0, 5.0), (3.0, 0.0)]

    def keep(p, lo, hi):
        (ax, ay), (bx, by) = p[lo], p[hi]

        def away(q):
            size = (bx - ax) ** 2 + (by - ay) ** 2
            t = ((q[0] - ax) * (bx - ax) + (q[1] - ay) * (by - ay)) / size if size else 0.0
            return np.hypot(q[0] - ax, q[1] - ay) if t <= 0 else np.hypot(q[0] - bx, q[1] - by) if t >= 1 else abs((bx - ax) * (q[1] - ay) - (by - ay) * (q[0] - ax)) / np.sqrt(size)

        far = [away(p[k]) for k in range(lo + 1, hi)]
        if not far or max(far) <= 2.5:
            return {lo, hi}
        m = lo + 1 + next(i for i, d in enumerate(far) if d >= max(far) - 1e-12)
        return keep(p, lo, m) | keep(p, m, hi)

    seen = []
    monkeypatch.setattr(W, "written", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange")) or G.written(df))
    rows = spark.createDataFrame([(i, k, *q) for i, p in tracks.items() for k, q in enumerate(p)], "line long, k long, x double, y double")
    got = sorted((r.line, r.k) for r in W.simplified(G.written(rows), 2.5).collect())
    assert got == sorted((i, k) for i, p in tracks.items() for k in keep(p, 0, len(p) - 1))
    assert len(seen) > 6 and max(seen) <= 2


def test_ways_through_buildings_are_not_sent_to_all_tasks(spark):
    from footreach.plans import corridors

    plan = corridors.mall_corridors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_requests_of_reports_are_not_sent_to_all_tasks(spark):
    from footreach.plans import ingest, ranking

    for query in (ingest.case_report, ranking.diagnosis):
        assert "BroadcastHashJoin" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
