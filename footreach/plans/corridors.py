"""Queries over ways that no street line gives: through buildings, and along routes."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from footreach import config as C
from footreach.operators import corridors as K
from footreach.operators import graph as G
from footreach.operators import streets as W
from footreach.operators.spatial import shuffled
from footreach.plans import shapes
from footreach.plans.registry import query
from footreach.sources import derived as D
from footreach.sources.derived import with_sql

# The green polygons stand for buildings that may be entered.
_ODD = "(e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1"
_ID = "floor({x} * 1000 + 0.5)::BIGINT * 4294967296 + floor({y} * 1000 + 0.5)::BIGINT"
_LINK = shapes.touch_sql(("p.x1", "p.y1"), ("p.x2", "p.y2"), ("e.x1", "e.y1"), ("e.x2", "e.y2"))
MALL_SQL = shapes.STREET_SQL + (
    ", nd AS (SELECT nid, min(x) AS x, min(y) AS y FROM (SELECT u AS nid, x1 AS x, y1 AS y FROM edge UNION ALL SELECT v, x2, y2 FROM edge) GROUP BY 1), "
    "sd AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS m FROM (SELECT a.poly, a.ring, a.n, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM corner a JOIN corner b ON a.poly = b.poly AND a.ring = b.ring AND b.n = (a.n + 1) % a.size WHERE a.use = 'green')), "
    "sm AS (SELECT *, sum(m) OVER (PARTITION BY poly, ring ORDER BY n ROWS UNBOUNDED PRECEDING) - m AS so_far FROM sd), bx AS (SELECT poly, min(x1) - 20 AS x0, min(y1) - 20 AS y0, max(x1) + 20 AS x9, max(y1) + 20 AS y9 FROM sd GROUP BY 1), "
    "pj AS (SELECT *, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM nd JOIN bx ON x BETWEEN x0 AND x9 AND y BETWEEN y0 AND y9 JOIN sm USING (poly)), "
    "qj AS (SELECT *, x1 + t * (x2 - x1) AS ex, y1 + t * (y2 - y1) AS ey, so_far + t * m AS mileage FROM pj), dj AS (SELECT *, sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey)) AS d FROM qj), "
    "inn AS (SELECT nid, poly FROM (SELECT p.nid, e.poly FROM nd p JOIN sd e ON " + _ODD + " GROUP BY ALL HAVING count(*) % 2 = 1)), "
    "door AS (SELECT poly, nid, x, y, ex, ey, mileage FROM (SELECT *, row_number() OVER (PARTITION BY poly, nid ORDER BY ring, d, mileage) AS r, min(d) OVER (PARTITION BY poly, nid) AS nearest FROM dj) LEFT JOIN (SELECT *, true AS inside FROM inn) USING (nid, poly) WHERE r = 1 AND (nearest <= 20 OR inside)), "
    f"lk AS (SELECT poly, nid AS u, {_ID.format(x='ex', y='ey')} AS v, x AS x1, y AS y1, ex AS x2, ey AS y2 FROM door), "
    f"shut AS (SELECT DISTINCT p.poly, p.u FROM lk p JOIN outline e ON {_LINK} WHERE e.use <> 'green' UNION SELECT poly, u FROM (SELECT p.poly, p.u, e.poly AS o FROM (SELECT *, x1 AS x, y1 AS y FROM lk) p JOIN outline e ON {_ODD} WHERE e.use <> 'green' GROUP BY ALL HAVING count(*) % 2 = 1)), "
    "free_link AS (SELECT * FROM lk WHERE NOT EXISTS (SELECT 1 FROM shut s WHERE s.poly = lk.poly AND s.u = lk.u)), "
    f"en AS (SELECT * FROM (SELECT poly, {_ID.format(x='ex', y='ey')} AS eid, ex, ey, mileage, row_number() OVER (PARTITION BY poly, {_ID.format(x='ex', y='ey')} ORDER BY mileage, ex, ey) AS r FROM door) WHERE r = 1), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY poly ORDER BY mileage, eid) AS k, count(*) OVER (PARTITION BY poly) AS n FROM en), "
    "ch AS (SELECT a.poly, a.k, a.eid AS u, b.eid AS v, a.ex AS x1, a.ey AS y1, b.ex AS x2, b.ey AS y2 FROM rk a JOIN rk b ON a.poly = b.poly AND b.k = a.k % a.n + 1 WHERE a.n > 2 OR a.n = 2 AND a.k = 1), "
    "ct AS (SELECT poly, k, t FROM (SELECT c.poly, c.k, ((e.x1 - c.x1) * (e.y2 - e.y1) - (e.y1 - c.y1) * (e.x2 - e.x1)) / nullif((c.x2 - c.x1) * (e.y2 - e.y1) - (c.y2 - c.y1) * (e.x2 - e.x1), 0) AS t, ((e.x1 - c.x1) * (c.y2 - c.y1) - (e.y1 - c.y1) * (c.x2 - c.x1)) / nullif((c.x2 - c.x1) * (e.y2 - e.y1) - (c.y2 - c.y1) * (e.x2 - e.x1), 0) AS w FROM ch c JOIN sd e USING (poly)) "
    "WHERE t BETWEEN 0 AND 1 AND w BETWEEN -1e-9 AND 1 + 1e-9 UNION SELECT poly, k, unnest([0, 1]::DOUBLE[]) FROM ch), "
    "mid AS (SELECT poly, k, i, x1 + (t + nx) / 2 * (x2 - x1) AS x, y1 + (t + nx) / 2 * (y2 - y1) AS y FROM (SELECT *, lead(t) OVER (PARTITION BY poly, k ORDER BY t) AS nx, row_number() OVER (PARTITION BY poly, k ORDER BY t) AS i FROM ct) JOIN ch USING (poly, k) WHERE nx IS NOT NULL), "
    # a middle is inside by parity, or on a side
    "ok AS (SELECT p.poly, p.k, p.i, sum(CASE WHEN " + _ODD + " THEN 1 ELSE 0 END) % 2 = 1 OR bool_or(abs((e.x2 - e.x1) * (p.y - e.y1) - (e.y2 - e.y1) * (p.x - e.x1)) <= 1e-9 * greatest(abs(e.x2 - e.x1), abs(e.y2 - e.y1)) AND p.x BETWEEN least(e.x1, e.x2) - 1e-9 AND greatest(e.x1, e.x2) + 1e-9 AND p.y BETWEEN least(e.y1, e.y2) - 1e-9 AND greatest(e.y1, e.y2) + 1e-9) AS good FROM mid p JOIN sd e ON e.poly = p.poly GROUP BY 1, 2, 3), "
    "held AS (SELECT poly, k, bool_and(good) AS straight FROM ok GROUP BY 1, 2), "
    "rc AS (SELECT poly, ring, sum(x1 * y2 - x2 * y1) AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / 3 AS sx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / 3 AS sy FROM sd GROUP BY 1, 2), "
    "ce AS (SELECT poly, sx / a AS cx, sy / a AS cy FROM (SELECT poly, sum(z * a) AS a, sum(z * sx) AS sx, sum(z * sy) AS sy FROM (SELECT *, sign(a) * CASE ring WHEN 0 THEN 1 ELSE -1 END AS z FROM rc) GROUP BY 1)), "
    f"ov AS (SELECT *, {_ID.format(x='cx', y='cy')} AS c FROM ch JOIN held USING (poly, k) JOIN ce USING (poly) WHERE NOT straight), "
    "ways AS (SELECT u, v, x1, y1, x2, y2 FROM ch JOIN held USING (poly, k) WHERE straight UNION ALL SELECT u, c, x1, y1, cx, cy FROM ov UNION ALL SELECT c, v, cx, cy, x2, y2 FROM ov), "
    "one_way AS (SELECT u, v, min(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) AS m FROM ways GROUP BY 1, 2), "
    f"mall AS (SELECT u, v, 'link' AS kind, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS m, {C.WALK_SPEED}::DOUBLE AS speed FROM free_link UNION ALL SELECT u, v, 'corridor', m, {C.WALK_SPEED}::DOUBLE * {C.MALL_FACTOR}::DOUBLE FROM one_way)"
)


@query(with_sql("vertex line_tag corner outline", MALL_SQL + " SELECT u, v, kind, round(m / speed * 60, 3) AS seconds FROM mall WHERE u <> v AND m > 0"))
def mall_corridors(spark, sf_dir):
    """Links from street nodes to the entrances of buildings, and the faster ways inside between neighbouring entrances."""
    nodes = W.edge_nodes(G.written(shapes.street_graph_edges(spark, sf_dir)))
    halls = shapes.rings(spark, sf_dir).where("use = 'green'").select("poly", "ring", "points")
    ways = K.through_buildings(halls, G.written(nodes), shapes.outlines(spark, sf_dir, "wall"), shapes.outlines(spark, sf_dir, "water"))
    return ways.select("u", "v", "kind", F.round("w", 3).alias("seconds"))


LAYERS = (5, 10, 15)
# A customer's orders are the points of routes in eight directions, each about 400 m farther out.
EAST = [1.0, 0.7071067811865476, 0.0, -0.7071067811865476, -1.0, -0.7071067811865476, 0.0, 0.7071067811865476]
_ROUTE = (
    f"SELECT o_custkey AS request_id, direction, k::BIGINT AS k, {EAST}::DOUBLE[][direction + 1] * 400 * k + o_orderkey * 7919 % 161 - 80 AS x, {EAST}::DOUBLE[][(direction + 6) % 8 + 1] * 400 * k + o_orderkey * 104729 % 161 - 80 AS y "
    "FROM (SELECT *, o_orderkey % 8 AS direction, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 8 ORDER BY o_orderkey) AS k FROM orders) UNION ALL SELECT DISTINCT o_custkey, o_orderkey % 8, 0, 0, 0 FROM orders"
).replace(f"{EAST}::DOUBLE[][", f"({EAST}::DOUBLE[])[")
_AXIS = "unnest(range(floor((least({a}1, {a}2) - r) / 10)::BIGINT, floor((greatest({a}1, {a}2) + r) / 10)::BIGINT + 1))"
ROUTE_SQL = (
    f"WITH route AS ({_ROUTE}), st AS (SELECT * FROM (SELECT request_id, direction, k, lag(x) OVER w AS x1, lag(y) OVER w AS y1, x AS x2, y AS y2 FROM route WINDOW w AS (PARTITION BY request_id, direction ORDER BY k)) WHERE x1 IS NOT NULL), "
    "sm AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS m FROM st), sb AS (SELECT *, sum(m) OVER (PARTITION BY request_id, direction ORDER BY k ROWS UNBOUNDED PRECEDING) - m AS past FROM sm), "
    "many AS (SELECT request_id FROM route GROUP BY 1 HAVING count(DISTINCT direction) >= 3), lay AS (SELECT request_id, unnest([5, 10, 15]) AS minutes FROM many), "
    "cut AS (SELECT request_id, minutes, x1, y1, x1 + (x2 - x1) * share AS x2, y1 + (y2 - y1) * share AS y2, 50 AS r FROM (SELECT *, least(1, (minutes * 80.0::DOUBLE - past) / m) AS share FROM sb JOIN lay USING (request_id) WHERE past < minutes * 80.0::DOUBLE AND m > 0)), "
    "shape AS (SELECT * FROM cut UNION ALL SELECT DISTINCT request_id, minutes, 0, 0, 0, 0, 100 FROM cut), "
    f"ix AS (SELECT *, {_AXIS.format(a='x')} AS ix FROM shape), ixy AS (SELECT *, {_AXIS.format(a='y')} AS iy, (ix + 0.5::DOUBLE) * 10 AS px, x2 - x1 AS dx, y2 - y1 AS dy FROM ix), "
    "al AS (SELECT *, (iy + 0.5::DOUBLE) * 10 AS py, greatest(0, least(1, coalesce(((px - x1) * dx + ((iy + 0.5::DOUBLE) * 10 - y1) * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t FROM ixy), "
    "cell AS (SELECT DISTINCT request_id, minutes, ix, iy FROM al WHERE (px - x1 - t * dx) * (px - x1 - t * dx) + (py - y1 - t * dy) * (py - y1 - t * dy) <= r * r) "
)


def routes(spark, sf_dir):
    """(request_id, direction, k, x, y) in metres from the request's place; point 0 is the place itself."""
    key = F.col("o_orderkey")
    order = Window.partitionBy("o_custkey", "direction").orderBy("o_orderkey")
    rows = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("o_custkey"), "o_orderkey", (key % 8).alias("direction")).withColumn("k", F.row_number().over(order).cast("long"))
    cosine = lambda d: F.element_at(F.array(*map(F.lit, EAST)), (d + 1).cast("int"))
    x = cosine(F.col("direction")) * 400 * F.col("k") + key * 7919 % 161 - 80
    y = cosine((F.col("direction") + 6) % 8) * 400 * F.col("k") + key * 104729 % 161 - 80
    steps = rows.select(F.col("o_custkey").alias("request_id"), "direction", "k", x.alias("x"), y.alias("y"))
    return steps.unionByName(steps.select("request_id", "direction").distinct().select("request_id", "direction", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))


@query(ROUTE_SQL + f"SELECT request_id, minutes, count(*) * 100::DOUBLE AS area_m2, round(least(1, count(*) * 100::DOUBLE / (pi() * pow(minutes * {C.CIRCLE_SPEED}::DOUBLE, 2))), 6) AS area_ratio FROM cell GROUP BY 1, 2")
def corridor_ground(spark, sf_dir):
    """Where there is no street network: the ground along routes in up to eight directions that is reached in 5, 10 and 15
    minutes, and its share of the circle. Requests with fewer than three directions have no row."""
    ways = shuffled(G.written(routes(spark, sf_dir)))
    asked = ways.select("request_id").distinct()
    layers = asked.select("request_id", F.explode(F.array(*map(F.lit, LAYERS))).alias("minutes"))
    cells = K.corridor_counts(ways, layers, asked.select("request_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    area = cells.select("request_id", F.col("minutes").cast("int").alias("minutes"), (F.col("cells") * 100.0).alias("area_m2"))
    circle = math.pi * F.pow(F.col("minutes") * C.CIRCLE_SPEED, F.lit(2.0))
    return area.select("request_id", "minutes", "area_m2", F.round(F.least(F.lit(1.0), F.col("area_m2") / circle), 6).alias("area_ratio"))
