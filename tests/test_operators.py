"""Operators against brute force, and cases worth keeping."""

import heapq
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from footreach import config as C
from footreach.functions import geo, text
from footreach.operators import blind, coverage, graph, outline, poi, spatial
from footreach.plans import joins
from footreach.sources import geojson
from footreach.streaming import clicks

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def points(rng, n, size=2000.0):
    return [(i, rng.uniform(-size, size), rng.uniform(-size, size)) for i in range(n)]


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


# scalar functions


def test_coordinates(spark):
    rows = spark.createDataFrame([(116.4578, 39.8846), (139.69, 35.68), (-5.6, 42.6), (73.66, 3.86)], "lng double, lat double")
    back = geo.gcj_to_wgs(geo.wgs_to_gcj(rows, "lng", "lat", "glng", "glat"), "glng", "glat", "blng", "blat")
    for r in back.collect():
        assert abs(r.lng - r.blng) < 1e-6 and abs(r.lat - r.blat) < 1e-6
        assert (r.glng != r.lng) == (r.lng == 116.4578)
    r = one(spark, geo.geohash5(F.lit(-5.6), F.lit(42.6)), geo.geohash5(F.lit(116.4578), F.lit(39.8846)), geo.geohash5(F.lit(180.0), F.lit(90.0)))
    assert (r.c0, r.c1, r.c2) == ("ezs42", "wx4ff", "zzzzz")
    assert one(spark, geo.in_polygon(F.lit(116.1), F.lit(40.07), C.RING), geo.in_polygon(F.lit(116.0), F.lit(40.0), C.RING)) == (True, False)


@pytest.mark.parametrize(("minutes", "layers"), [(5, [3, 5]), (10, [5, 10]), (15, [5, 10, 15]), (20, [5, 10, 15, 20]), (30, [10, 15, 20, 30])])
def test_layers(spark, minutes, layers):
    assert one(spark, geo.layer_minutes(F.lit(minutes))).c0 == layers


@pytest.mark.parametrize(("minutes", "radius"), [(5, 1500), (10, 1500), (15, 2000), (20, 2000), (30, 2000)])
def test_recall(spark, minutes, radius):
    assert one(spark, geo.recall_radius(F.lit(minutes))).c0 == radius


def test_directions(spark):
    got = [one(spark, geo.direction8(F.lit(math.cos(math.radians(a))), F.lit(math.sin(math.radians(a))))).c0 for a in range(0, 360, 45)]
    assert got == ["E", "NE", "N", "NW", "W", "SW", "S", "SE"]


@pytest.mark.parametrize(
    ("name", "base"),
    [("九龙山地铁站", "九龙山"), ("珠江帝景(公交站)", "珠江帝景"), ("马连洼（地铁）", "马连洼"), ("地铁马连洼站（地铁）", "马连洼"), ("地铁上地软件园站(西行)", "上地软件园"), ("站", "站"), ("地铁站", "地铁站"), (None, ""), ("", "")],
)
def test_stations(spark, name, base):
    assert one(spark, text.station_base(F.lit(name).cast("string"))).c0 == base


@pytest.mark.parametrize(
    ("category", "name", "group"),
    [("convenience", "红星菜市场", "market"), ("mall", "幸福超市", "market"), ("health", "社区卫生服务站", "pharmacy"), ("education", "第一小学", "school"), ("education", "第一中学", None), ("health", "敬老院", None), ("public", "超市", None), ("mall", None, None)],
)
def test_groups(spark, category, name, group):
    assert one(spark, text.blind_group(F.lit(category), F.lit(name).cast("string"))).c0 == group


def test_noise(spark):
    noise = lambda c, n, t=None: one(spark, text.is_noise(F.lit(c), F.lit(n), F.lit(t).cast("string"))).c0
    assert noise("public", "东方广场-东办公楼E3座") and noise("public", "健身房") and not noise("public", "健身园") and noise("public", "中粮广场", "房地产;写字楼")
    assert noise("transport", "潘家园地铁站-C1东南口") and not noise("transport", "潘家园地铁站") and not noise("mall", "购物中心")


def test_paths(spark):
    got = one(spark, text.parse_path(F.lit("1,2;1,2;x,3;3;4,5;1,2;;")), text.parse_path(F.lit("")))
    assert [(p.lng, p.lat) for p in got.c0] == [(1, 2), (4, 5), (1, 2)] and got.c1 == []


def test_proximity(spark):
    got = [one(spark, geo.proximity_score(F.lit(n).cast("double"), F.lit(15))).c0 for n in (None, 0, 5, 15, 30, 100)]
    assert got == [None, 100, 100, 60, 15, 15]


# joins


@few
@given(st.integers(0, 10**6), st.floats(50, 900))
def test_radius_join(spark, seed, radius):
    rng = random.Random(seed)
    a, b = points(rng, 40), points(rng, 60)
    left, right = spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(b, "id2 long, x2 double, y2 double")
    got = {(r.id, r.id2) for r in spatial.radius_join(left, right, radius).collect()}
    assert got == {(i, j) for i, x, y in a for j, u, v in b if math.hypot(x - u, y - v) <= radius}


@few
@given(st.integers(0, 10**6))
def test_nearest_unbounded(spark, seed):
    rng = random.Random(seed)
    a, b = points(rng, 30, 5000.0), points(rng, 8)
    left, right = spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(b, "id2 long, x2 double, y2 double")
    got = {r.id: r.id2 for r in spatial.nearest_unbounded(left, right, "id", ["id2"], [F.col("d"), F.col("id2")], 500.0).collect()}
    assert got == {i: min(b, key=lambda p: math.hypot(x - p[1], y - p[2]))[0] for i, x, y in a}


@few
@given(st.integers(0, 10**6))
def test_nearest_however_far(spark, seed):
    rng = random.Random(seed)
    a = points(rng, 20, 3000.0) + [(100 + i, rng.choice([-1, 1]) * rng.uniform(20_000, 200_000), rng.uniform(-200_000, 200_000)) for i in range(10)]
    b = points(rng, 60, 1500.0) + [(900, 90_000.0, 90_000.0)]
    left, right = spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(b, "id2 long, x2 double, y2 double")
    got = {r.id: r.id2 for r in spatial.nearest_unbounded(left, right, "id", ["id2"], [F.col("d"), F.col("id2")], 100.0).collect()}
    assert got == {i: min(b, key=lambda p: math.hypot(x - p[1], y - p[2]))[0] for i, x, y in a}


def test_nearest_probes(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 100_000.0, 0.0), (3, None, 0.0)], "id long, x double, y double")
    right = spark.createDataFrame([(1, 3290.0, 3290.0), (2, 3350.0, 0.0), (3, 3350.0, 0.0)], "id2 long, x2 double, y2 double")
    near = lambda r: spatial.nearest_unbounded(left, r, "id", ["id2", "d"], [F.col("d"), F.col("id2")], 100.0).collect()
    assert {r.id: (r.id2, r.d) for r in near(right)} == {1: (2, 3350.0), 2: (2, 96_650.0)}
    assert near(right.where("false")) == []
    assert {r.id: r.id2 for r in near(right.where("id2 = 3"))} == {1: 3, 2: 3}


@few
@given(st.integers(0, 10**6))
def test_boxes(spark, seed):
    rng = random.Random(seed)
    a = points(rng, 80)
    boxes = [(k, x, y, x + rng.uniform(0, 900), y + rng.uniform(0, 900)) for k, x, y in points(rng, 10)]
    pts, bxs = spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(boxes, "box long, x0 double, y0 double, x1 double, y1 double")
    inside = {(i, k) for i, x, y in a for k, x0, y0, x1, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1}
    assert {(r.id, r.box) for r in spatial.bbox_join(pts, bxs, 250.0).collect()} == inside
    assert {r.id for r in spatial.bbox_join(pts, bxs, 250.0, "left_anti").collect()} == {i for i, _, _ in a} - {i for i, _ in inside}


def test_plans_have_no_cross_products(spark):
    left, right = spark.range(100).selectExpr("id", "id * 1.0D as x", "id * 2.0D as y"), spark.range(100).selectExpr("id as id2", "id * 1.0D as x2", "id * 2.0D as y2")
    plan = spatial.radius_join(left, right, 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


# graph


def lattice(rng, n=7, blocked=0.2):
    edges = [(i * n + j, (i + 1) * n + j, float(rng.randrange(1, 9))) for i in range(n - 1) for j in range(n)] + [(i * n + j, i * n + j + 1, float(rng.randrange(1, 9))) for i in range(n) for j in range(n - 1)]
    return [e for e in edges if rng.random() > blocked]


def dijkstra(edges, start, cutoff):
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    best, queue = {start: 0.0}, [(0.0, start)]
    while queue:
        c, k = heapq.heappop(queue)
        for m, w in near.get(k, ()):
            if c + w <= cutoff and c + w < best.get(m, math.inf):
                best[m] = c + w
                heapq.heappush(queue, (c + w, m))
    return best


@pytest.mark.parametrize("by_tiles", [True, False])
def test_costs(spark, by_tiles):
    edges = lattice(random.Random(5))
    sources = [(1, 0), (2, 24), (3, 48), (4, 999), (5, 24)]
    nodes = spark.createDataFrame([*((k, k // 7 * 10.0, k % 7 * 10.0) for k in range(49)), (999, 5000.0, -70.0)], "nid long, x double, y double")
    rows = graph.costs_within(spark.createDataFrame(sources, "request_id long, nid long"), spark.createDataFrame([*edges, (3, 3, 1.0), *edges[:3]], "u long, v long, w double"), 15.0, nodes if by_tiles else None).collect()
    got = {}
    for r in rows:
        got.setdefault(r.request_id, {})[r.nid] = r.cost_s
    assert got == {k: dijkstra(edges, s, 15.0) for k, s in sources}


@pytest.mark.parametrize("tile", [None, 37.0, 400.0])
def test_costs_over_many_tiles(spark, tile):
    rng = random.Random(11)
    at = [((1 << 60) + k, rng.uniform(-900, 900), rng.uniform(-900, 900)) for k in range(500)]  # ids that no float holds
    edges = [(i, j, math.hypot(x - u, y - v) / rng.uniform(1.0, 1.5)) for i, x, y in at for j, u, v in at if i < j and math.hypot(x - u, y - v) < 90]
    sources = [(k, (1 << 60) + rng.randrange(500)) for k in range(40)]
    arcs = graph.both_ways(spark.createDataFrame(edges, "u long, v long, w double"))
    got = {}
    for r in graph.costs_by_tiles(spark.createDataFrame(sources, "request_id long, nid long"), arcs, spark.createDataFrame(at, "nid long, x double, y double"), 180.0, tile).collect():
        got.setdefault(r.request_id, {})[r.nid] = r.cost_s
    assert got == {k: dijkstra(edges, s, 180.0) for k, s in sources}


def test_searches_in_bounded_tables():
    import numpy as np

    edges = lattice(random.Random(5))
    arcs = tuple(np.array(c) for c in zip(*(e for u, v, w in edges for e in ((u, v, w), (v, u, w)))))
    for cells in (1, 100, 10**6):
        got = {}
        for start, node, cost in graph.local_costs(np.array([0, 24, 48, 999]), arcs, 15.0, cells):
            for a, b, c in zip(start.tolist(), node.tolist(), cost.tolist()):
                got.setdefault(a, {})[b] = c
        assert got == {s: dijkstra(edges, s, 15.0) for s in (0, 24, 48, 999)}


def test_layers_are_nested(spark):
    edges = lattice(random.Random(6), blocked=0.1)
    costs = dijkstra(edges, 24, 20.0)
    near = {n for n, c in costs.items() if c <= 10}
    assert near <= set(costs) and 24 in near


def test_reachable_edges_need_one_end(spark):
    costs = spark.createDataFrame([(1, 0, 0.0), (1, 1, 5.0)], "request_id long, nid long, cost_s double")
    edges = spark.createDataFrame([(0, 1, 5.0), (1, 2, 9.0), (2, 3, 1.0)], "u long, v long, w double")
    assert {(r.u, r.v, r.low) for r in graph.reachable_edges(costs, edges).collect()} == {(0, 1, 0.0), (1, 2, 5.0)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (200, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 105: 100, 103: 100}


def test_chains(spark):
    edges = [(0, 1, 1, "road"), (1, 2, 2, "road"), (2, 3, 3, "bridge"), (3, 4, 4, "bridge"), (4, 5, 5, "road"), (4, 6, 6, "road"), (10, 11, 1, "road"), (11, 12, 1, "road"), (12, 10, 1, "road")]
    got = {(r.u, r.v, r.w, r.kind, r.parts) for r in graph.chains(spark.createDataFrame(edges, "u long, v long, w long, kind string")).collect()}
    assert got == {(0, 2, 3, "road", 2), (2, 4, 7, "bridge", 2), (4, 5, 5, "road", 1), (4, 6, 6, "road", 1), (10, 10, 3, "road", 3)}


def test_injection_shortens_and_repeats_change_nothing(spark):
    edges = spark.createDataFrame([(0, 1, 300.0), (1, 2, 300.0)], "u long, v long, w double")
    path = spark.createDataFrame([(7, 1, 0.0, 0.0, 0), (7, 2, 0.1, 0.0, 0), (7, 3, 140.0, 0.0, 2)], "path_id long, seq long, x double, y double, nid long")
    both = path.unionByName(path.withColumn("path_id", F.lit(8).cast("long")))
    assert sorted(r.w for r in graph.injected(edges, path).collect()) == sorted(r.w for r in graph.injected(edges, both).collect())
    costs = graph.costs_within(spark.createDataFrame([(1, 0)], "request_id long, nid long"), graph.injected(edges, path), 500.0).collect()
    assert {r.nid: r.cost_s for r in costs}[2] == pytest.approx(139.9 / 70 * 60)


# places


def test_greedy(spark):
    rng = random.Random(8)
    rows = [(i, f"n{i % 3}", i, rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(120)]
    kept = []
    for r in rows:
        if all(k[1] != r[1] or math.hypot(k[3] - r[3], k[4] - r[4]) >= 40 for k in kept):
            kept.append(r)
    out = poi.greedy_apart(spark.createDataFrame(rows, "rid long, base string, seq long, x double, y double"), ["base"], ["seq"], 40.0)
    assert sorted(r.rid for r in out.collect()) == [k[0] for k in kept]


def test_greedy_over_a_long_chain(spark):
    rows = [(i, "n", i, 10.0 * i, 0.0) for i in range(90)]
    frame = spark.createDataFrame(rows, "rid long, base string, seq long, x double, y double")
    assert sorted(r.rid for r in poi.greedy_apart(frame, ["base"], ["seq"], 15.0).collect()) == list(range(0, 90, 2))
    with pytest.raises(RuntimeError):
        poi.greedy_apart(frame, ["base"], ["seq"], 15.0, rounds=3)


@few
@given(st.integers(0, 10**6))
def test_contained_names(spark, seed):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(2, 12))) + rng.choice(["", "#00", "shop"])
    left, right = [(i, name()) for i in range(40)], [(i, name()) for i in range(60)]
    got = {(r.a, r.b) for r in joins.contained(spark.createDataFrame(left, "a long, norm string"), spark.createDataFrame(right, "b long, norm2 string")).collect()}
    assert got == {(i, j) for i, n in left for j, m in right if min(len(n), len(m)) >= 4 and (n in m or m in n)}


@few
@given(st.integers(0, 10**6))
def test_outlines(spark, seed):
    rng = random.Random(seed)
    groups = {g: {(rng.randrange(-6, 6), rng.randrange(-6, 6)) for _ in range(rng.randrange(1, 90))} for g in range(3)}
    cells = spark.createDataFrame([(g, x, y) for g, own in groups.items() for x, y in own], "grp long, ix int, iy int")
    found = outline.rings(cells)
    stats = outline.ring_stats(found).collect()
    for g, own in groups.items():
        areas = [r.area for r in stats if r.grp == g]
        assert sum(areas) == len(own) and sum(r.length for r in stats if r.grp == g) == sum((x + a, y + b) not in own for x, y in own for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        seen, parts = set(), 0
        for cell in own:
            parts += cell not in seen
            todo = [cell]
            while todo:
                x, y = todo.pop()
                if (x, y) in own and (x, y) not in seen:
                    seen.add((x, y))
                    todo += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
        assert sum(a > 0 for a in areas) == parts
    for r in outline.polygons(found).collect():
        path = [(c.x, c.y) for c in r.corners]
        turns = list(zip(path, path[1:] + path[:1]))
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in turns) / 2
        assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in turns) and [s.area for s in stats if s.grp == r.grp and s.ring == r.ring] == [area]


SELECT = "request_id long, minutes int, id long, seq long, name string, category string, edu_kind string, transport_kind string, cat_total int, raw_min double, x double, y double"


def test_selection_orders(spark):
    rows = [
        (1, 15, 1, 1, "光明小学", "education", "school", None, 9, 3.0), (1, 15, 2, 2, "花朵幼儿园", "education", "kindergarten", None, 9, 9.0), (1, 15, 3, 3, "第一中学", "education", "school", None, 9, 1.0), (1, 15, 4, 4, "远小学", "education", "school", None, 9, 15.5),
        (1, 15, 5, 5, "劲松(公交站)", "transport", None, "bus", 9, 1.0), (1, 15, 6, 6, "劲松站(东行)", "transport", None, "bus", 9, 2.0), (1, 15, 7, 7, "九龙山地铁站", "transport", None, "metro", 9, 12.0),
        (1, 15, 8, 8, "图书馆", "public", None, None, 9, 1.0), (1, 15, 9, 9, "百旺公园-西区", "public", None, None, 9, 8.0), (1, 15, 10, 10, "百旺公园·西区", "public", None, None, 9, 7.0),
        (1, 15, 11, 11, "便利店(已关闭)", "convenience", None, None, 9, 1.0), (1, 15, 12, 12, "便利店", "convenience", None, None, 9, 1.0),
    ]
    got = {}
    for r in poi.selected(poi.ranked_traits(spark.createDataFrame([(*r, 0.0, 0.0) for r in rows], SELECT)).withColumns({"x2": F.col("x"), "y2": F.col("y")})).orderBy("category", "rank").collect():
        got.setdefault(r.category, []).append(r.id)
    assert got == {"convenience": [12, 11], "education": [2, 1, 3], "public": [10, 8], "transport": [7, 5]}


def test_cap_and_total(spark):
    rows = [(1, 15, i, i, f"店{i}", "leisure", None, None, 50, float(i % 15)) for i in range(1, 31)]
    out = poi.selected(poi.ranked_traits(spark.createDataFrame([(*r, 0.0, 0.0) for r in rows], SELECT)).withColumns({"x2": F.col("x"), "y2": F.col("y")})).collect()
    assert len(out) == 20 and {r.within_total for r in out} == {30}


def cover(spark, chosen):
    cats = coverage.category_rows(spark)
    asked = spark.createDataFrame([(1, 15)], "request_id long, minutes int")
    return coverage.coverage(asked, spark.createDataFrame(chosen, "request_id long, category string, transport_kind string, raw_min double, within_total int, cat_total int"), cats)


def test_coverage_has_all_categories_and_score_is_bounded(spark):
    empty = cover(spark, [])
    assert empty.count() == 7 and empty.where("passed or cnt > 0 or nearest_minutes is not null").count() == 0
    assert coverage.score(empty).first().score == 0.0
    full = [(1, c, "metro" if c == "transport" else None, 0.0, 3, 3) for c in C.CATEGORIES]
    area = spark.createDataFrame([(1, 1.0)], "request_id long, area_ratio double")
    assert coverage.score(cover(spark, full), area).first().score == 100.0
    bus = [(1, c, "bus" if c == "transport" else None, 0.0, 3, 3) for c in C.CATEGORIES]
    assert coverage.score(cover(spark, bus), area).first().score == pytest.approx(94.0)


def test_shops_need_three(spark):
    r = cover(spark, [(1, "convenience", None, 2.0, 2, 9)]).where("category = 'convenience'").first()
    assert not r.passed and r.nearest_minutes == 2.0


def test_worst_sector_words(spark):
    none = [(1, d, 1.0, []) for d in C.DIRECTIONS]
    rows = none + [(2, d, 0.3 if d in ("SE", "W") else 0.9, ["水域", "rail"] if d == "SE" else []) for d in C.DIRECTIONS]
    got = {r.request_id: (r.worst, r.worst_text) for r in coverage.worst_sector(spark.createDataFrame(rows, "request_id long, direction string, gap_ratio double, labels array<string>")).collect()}
    assert got[1] == ("N", "各方向可达性均衡，无明显缺口。") and got[2] == ("SE", "东南被水域+rail切断，需绕桥（达成率 30%）。")


# blind spots


def test_blind_corridor(spark):
    asked = spark.createDataFrame([(1, 0.0, 0.0)], "request_id long, x double, y double")
    schools = [("school", float(x), float(y)) for y in (-1001, 1001) for x in range(-2000, 2001, 50)]
    places = spark.createDataFrame([*schools, ("market", 0.0, 0.0), ("pharmacy", 0.0, 0.0)], "grp string, x2 double, y2 double")
    grid = blind.disc_cells(asked)
    assert grid.count() == C.BLIND_DISC_CELLS == 317
    rows = blind.blind_cells(grid, places, ["market", "pharmacy", "school"])
    stats = blind.region_stats(blind.regions(rows)).collect()
    assert [(r.grp, r.cells, r.corridor) for r in stats] == [("school", 21, True)]
    share = blind.summary(rows, asked).first()
    assert share.market_share == 0 and share.school_share == pytest.approx(21 / 317, abs=1e-6)


def test_blind_without_any_place(spark):
    asked = spark.createDataFrame([(1, 0.0, 0.0)], "request_id long, x double, y double")
    none = spark.createDataFrame([], "grp string, x2 double, y2 double")
    assert blind.blind_cells(blind.disc_cells(asked), none, ["market"]).count() == 317


# sources and streams


def test_geojson_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("LineString", [(1.123456789, 2.0), (3.0, 4.5)], {"highway": "steps", "name": "甲"})], "type string, points array<struct<x:double,y:double>>, properties map<string,string>")
    geojson.write_features(rows, f"{tmp_path}/lines")
    texts = spark.read.text(f"{tmp_path}/lines").select(F.concat(F.lit('{"features": ['), "value", F.lit(', {"geometry": null, "properties": {}}]}')).alias("value"))
    r = geojson.features(texts).withColumn("p", geojson.line_points(F.col("coordinates"))).first()
    assert r.type == "LineString" and r.properties["highway"] == "steps" and [(p.x, p.y) for p in r.p] == [(1.1234568, 2.0), (3.0, 4.5)]


def test_stream_sessions_equal_batch_sessions(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = clicks.sessions(clicks.timed(clicks.click_stream(spark, f"{tmp_path}/in", events.schema), "1000 days"))
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r.user_id, r.start, r.clicks, r.total)
    assert sorted(map(key, spark.table("sessions").collect())) == sorted(map(key, clicks.sessions(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()))


def test_stream_without_repeats(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.union(events).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = clicks.once_each(clicks.timed(clicks.click_stream(spark, f"{tmp_path}/in", events.schema), "1000 days"))
    query = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("once").count() == events.count() == clicks.once_each(events.union(events)).count()


def test_stream_of_requests_is_answered_by_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    query = clicks.answer(clicks.click_stream(spark, f"{tmp_path}/in", events.schema), lambda b: b.groupBy("event_type").count(), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("count")).first()[0] == events.count()


def test_token_bucket(spark):
    got = one(spark, clicks.tokens_left(F.array(*map(F.lit, [0.0, 0.0, 0.0, 0.5, 10.0])), 2.0, 2.0)).c0
    assert got == 4


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["request_id", "score", "all_passed", "anchors_passed"] and out.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
