"""Ways that no street line gives: through buildings that may be entered, and along the routes of a routing service."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footreach import config as C
from footreach.operators.geometry import cells_around, covered, met
from footreach.operators.graph import by_group
from footreach.operators.spatial import bbox_join, shuffled
from footreach.operators.streets import node_id

#: Slack of a crossing's place on a segment, as a share of its length.
EPS = 1e-9


def ring_sides(rings: DataFrame) -> DataFrame:
    """(poly, ring, n, x1, y1, x2, y2, before) of rings (poly, ring, points): sides in order, with the mileage at which each
    begins. Closed rings have no side from the last point to the first."""
    size = F.size("points")
    pair = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.get("points", i).alias("a"), F.get("points", (i + 1) % size).alias("b")))
    rows = rings.where(size > 1).select("poly", "ring", F.posexplode(pair).alias("n", "e"))
    rows = rows.select("poly", "ring", "n", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")).where("x1 <> x2 or y1 <> y2")
    so_far = Window.partitionBy("poly", "ring").orderBy("n")
    return rows.withColumn("before", F.sum(span_m()).over(so_far) - span_m())


def span_m() -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return F.sqrt(dx * dx + dy * dy)


def entrances(sides: DataFrame, nodes: DataFrame, radius: float = C.CORRIDOR_LINK_M) -> DataFrame:
    """(poly, nid, x, y, ex, ey, mileage): nodes in or at most `radius` from a polygon, and the place on its outer ring that is
    nearest to each, the first along the ring of equally near ones."""
    boxes = sides.groupBy("poly").agg((F.min("x1") - radius).alias("x0"), (F.min("y1") - radius).alias("y0"), (F.max("x1") + radius).alias("x1"), (F.max("y1") + radius).alias("y1"))
    pairs = bbox_join(nodes.select("nid", "x", "y"), shuffled(boxes), 200.0).select("poly", "nid", "x", "y")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / (dx * dx + dy * dy)))
    at = pairs.join(shuffled(sides), "poly").withColumn("t", t).withColumns({"ex": F.col("x1") + F.col("t") * dx, "ey": F.col("y1") + F.col("t") * dy, "mileage": F.col("before") + F.col("t") * span_m()})
    gx, gy = F.col("x") - F.col("ex"), F.col("y") - F.col("ey")
    outer = F.when(F.col("ring") == 0, F.struct(F.sqrt(gx * gx + gy * gy).alias("d"), "mileage", "ex", "ey"))
    best = at.groupBy("poly", "nid", "x", "y").agg(F.min(F.sqrt(gx * gx + gy * gy)).alias("d"), F.min(outer).alias("e"))
    inside = covered(nodes, sides, "nid").select("poly", "nid", F.lit(True).alias("inside"))
    near = best.join(shuffled(inside), ["poly", "nid"], "left").where((F.col("d") <= radius) | F.col("inside"))
    return near.select("poly", "nid", "x", "y", "e.ex", "e.ey", "e.mileage")


def centroids(sides: DataFrame) -> DataFrame:
    """(poly, cx, cy) of polygons, holes taken off whatever way their rings run."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    third = lambda c: F.sum((F.col(f"{c}1") + F.col(f"{c}2")) * cross) / 3
    rings = sides.groupBy("poly", "ring").agg(F.sum(cross).alias("a"), third("x").alias("sx"), third("y").alias("sy"))
    sign = F.signum("a") * F.when(F.col("ring") == 0, 1).otherwise(-1)
    whole = rings.groupBy("poly").agg(F.sum(sign * F.col("a")).alias("a"), F.sum(sign * F.col("sx")).alias("sx"), F.sum(sign * F.col("sy")).alias("sy"))
    return whole.where("a <> 0").select("poly", (F.col("sx") / F.col("a")).alias("cx"), (F.col("sy") / F.col("a")).alias("cy"))


def held_inside(chords: DataFrame, sides: DataFrame, key: str) -> DataFrame:
    """(key): the chords (key, poly, x1, y1, x2, y2) that their own polygon covers from end to end, borders included.

    A chord is cut where it meets a side, and it is inside if the middle of each part is."""
    own = chords.select(key, "poly", *(F.col(c).alias(f"c_{c}") for c in ("x1", "y1", "x2", "y2")))
    rx, ry, sx, sy = F.col("c_x2") - F.col("c_x1"), F.col("c_y2") - F.col("c_y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    qx, qy = F.col("x1") - F.col("c_x1"), F.col("y1") - F.col("c_y1")
    den = F.nullif(rx * sy - ry * sx, F.lit(0.0))
    t, u = (qx * sy - qy * sx) / den, (qx * ry - qy * rx) / den
    inner = t.between(0.0, 1.0) & u.between(-EPS, 1 + EPS)
    cut = own.join(shuffled(sides.select("poly", "x1", "y1", "x2", "y2")), "poly").groupBy(key, "poly", "c_x1", "c_y1", "c_x2", "c_y2").agg(F.collect_set(F.when(inner, t)).alias("ts"))
    cut = cut.withColumn("ts", F.array_sort(F.array_union("ts", F.array(F.lit(0.0), F.lit(1.0)))))
    middle = F.transform(F.sequence(F.lit(0), F.size("ts") - 2), lambda i: (F.get("ts", i) + F.get("ts", i + 1)) / 2)
    parts = cut.select(key, "poly", F.posexplode(middle).alias("i", "m"), "c_x1", "c_y1", "c_x2", "c_y2")
    parts = parts.select(F.struct(key, "poly", "i").alias("part"), (F.col("c_x1") + F.col("m") * rx).alias("x"), (F.col("c_y1") + F.col("m") * ry).alias("y"))
    inside = covered(parts, sides, "part").where("part.poly = poly").select("part", F.lit(1).alias("inside"))
    whole = parts.select("part").join(shuffled(inside), "part", "left").groupBy(f"part.{key}").agg(F.min(F.coalesce("inside", F.lit(0))).alias("all_in"))
    return whole.where("all_in = 1").select(key)


def through_buildings(rings: DataFrame, nodes: DataFrame, walls: DataFrame | None = None, water: DataFrame | None = None) -> DataFrame:
    """Edges (u, v, w, length_m, kind, x1, y1, x2, y2), in seconds, through buildings with rings (poly, ring, points) that may be
    entered, ring 0 being the outer one.

    Each node at a building gets a `link` to its entrance, unless a wall or water is in the way. Neighbouring entrances, in
    the order of the outline, are joined by a faster `corridor`: straight where the building covers the way, else over
    its centroid. Entrances equal to the millimetre are one. A building with one entrance has links only."""
    sides = ring_sides(rings)
    found = entrances(sides, nodes)
    links = found.select("poly", "nid", node_id(F.col("ex"), F.col("ey")).alias("v"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("ex").alias("x2"), F.col("ey").alias("y2"), F.struct("poly", "nid").alias("link"))
    links = reduce(lambda df, bad: df.join(shuffled(met(links, bad, "link")), "link", "left_anti"), [b for b in (walls, water) if b is not None], links)
    links = edges_of(links.withColumn("u", F.col("nid")), "link", C.WALK_SPEED)

    doors = found.groupBy("poly", node_id(F.col("ex"), F.col("ey")).alias("eid")).agg(F.min(F.struct("mileage", "ex", "ey")).alias("e")).select("poly", "eid", "e.*")
    around = Window.partitionBy("poly").orderBy("mileage", "eid")
    door = F.struct("eid", "ex", "ey")
    doors = doors.select("poly", door.alias("a"), F.coalesce(F.lead(door).over(around), F.first(door).over(around)).alias("b"), F.row_number().over(around).alias("k"), F.count("*").over(Window.partitionBy("poly")).alias("n"))
    # two entrances have one way between them
    chords = doors.where("n > 2 or n = 2 and k = 1").select(F.struct("poly", "k").alias("chord"), "poly", F.col("a.eid").alias("u"), F.col("b.eid").alias("v"), F.col("a.ex").alias("x1"), F.col("a.ey").alias("y1"), F.col("b.ex").alias("x2"), F.col("b.ey").alias("y2"))
    straight = held_inside(chords, sides, "chord")
    direct = chords.join(shuffled(straight), "chord", "left_semi")
    rest = chords.join(shuffled(straight), "chord", "left_anti").join(shuffled(centroids(sides)), "poly").withColumn("c", node_id(F.col("cx"), F.col("cy")))
    half = lambda u, x1, y1, v, x2, y2: rest.select(F.col(u).alias("u"), F.col(v).alias("v"), F.col(x1).alias("x1"), F.col(y1).alias("y1"), F.col(x2).alias("x2"), F.col(y2).alias("y2"))
    over = half("u", "x1", "y1", "c", "cx", "cy").unionByName(half("c", "cx", "cy", "v", "x2", "y2"))
    corridors = direct.select("u", "v", "x1", "y1", "x2", "y2").unionByName(over)
    # a half that two chords share is one edge
    return links.unionByName(edges_of(corridors.dropDuplicates(["u", "v"]), "corridor", C.WALK_SPEED * C.MALL_FACTOR))


def edges_of(ways: DataFrame, kind: str, speed: float) -> DataFrame:
    out = ways.select("u", "v", (span_m() / speed * 60).alias("w"), span_m().alias("length_m"), F.lit(kind).alias("kind"), "x1", "y1", "x2", "y2")
    return out.where("u <> v and length_m > 0")


def cut_routes(routes: DataFrame, layers: DataFrame, speed: float = C.CIRCLE_SPEED) -> DataFrame:
    """(request_id, minutes, x1, y1, x2, y2): the steps of routes (request_id, direction, k, x, y) that can be walked within each of
    a request's layers (request_id, minutes); the last step is cut where the time ends."""
    order = Window.partitionBy("request_id", "direction").orderBy("k")
    steps = routes.select("request_id", "direction", "k", F.lag("x").over(order).alias("x1"), F.lag("y").over(order).alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    steps = steps.withColumn("m", F.coalesce(span_m(), F.lit(0.0))).withColumn("before", F.sum("m").over(order) - F.col("m")).where("x1 is not null and m > 0")
    far = F.col("minutes") * F.lit(float(speed))
    share = F.least(F.lit(1.0), (far - F.col("before")) / F.col("m"))
    walked = steps.join(layers, "request_id").where(F.col("before") < far)
    return walked.select("request_id", "minutes", "x1", "y1", (F.col("x1") + (F.col("x2") - F.col("x1")) * share).alias("x2"), (F.col("y1") + (F.col("y2") - F.col("y1")) * share).alias("y2"))


def ground_ways(routes: DataFrame, layers: DataFrame, centres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut steps and hubs (layer, x1, y1, x2, y2), layer being request_id and minutes, which the ground along routes is made of in each layer. A hub lies around
    the request's centre (request_id, x, y).

    Requests with routes in fewer than three directions have no rows, as have layers without any step; a route needs two points."""
    usable = routes.groupBy("request_id", "direction").agg(F.count("*").alias("n")).where("n > 1").groupBy("request_id").agg(F.count("*").alias("n")).where(F.col("n") >= C.CORRIDOR_LEAST_DIRECTIONS)
    ways = cut_routes(routes.join(usable.select("request_id"), "request_id", "left_semi"), layers).select(F.struct("request_id", "minutes").alias("layer"), "x1", "y1", "x2", "y2")
    at = centres.select("request_id", F.col("x").alias("x1"), F.col("y").alias("y1"))
    hubs = ways.select("layer").distinct().join(at, F.col("layer.request_id") == F.col("request_id"))
    return ways, hubs.select("layer", "x1", "y1", F.col("x1").alias("x2"), F.col("y1").alias("y2"))


def corridor_cells(routes: DataFrame, layers: DataFrame, centres: DataFrame, cell: float = 10.0) -> DataFrame:
    """(request_id, minutes, ix, iy): the ground that routes stand for where there is no street network, as cells whose centres lie
    within the half-width of a cut route or within the hub around the request's centre (request_id, x, y).

    The cells' total area is off by at most half a cell's diagonal times the outline's length. Who only needs their number
    takes corridor_counts(), which sends no cell."""
    ways, hubs = ground_ways(routes, layers, centres)
    cells = cells_around(ways, "layer", C.CORRIDOR_HALF_M, cell).unionByName(cells_around(hubs, "layer", C.CORRIDOR_HUB_M, cell))
    return cells.distinct().select("layer.request_id", "layer.minutes", "ix", "iy")


def corridor_counts(routes: DataFrame, layers: DataFrame, centres: DataFrame, cell: float = 10.0) -> DataFrame:
    """(request_id, minutes, cells): how many cells corridor_cells() has for each layer. Steps are dealt out by layer, a few for each, and
    their cells, a thousand times as many, are made and counted inside the task: a walk's length bounds those of a layer."""
    of = lambda df, r: df.select(F.col("layer.request_id").cast("long").alias("request_id"), F.col("layer.minutes").cast("long").alias("minutes"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")), F.lit(float(r)).alias("r"))
    ways, hubs = ground_ways(routes, layers, centres)
    rows = of(ways, C.CORRIDOR_HALF_M).unionByName(of(hubs, C.CORRIDOR_HUB_M))

    def count(request: np.ndarray, minutes: np.ndarray, *way: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, (request[1:] != request[:-1]) | (minutes[1:] != minutes[:-1])])
        columns = (request[first], minutes[first], layer_sizes(first, *way, cell))
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["request_id", "minutes", "cells"])

    return by_group(rows, ["request_id", "minutes"], count, "request_id long, minutes long, cells long")


def layer_sizes(first: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, r: np.ndarray, cell: float, room: int = 1 << 16) -> np.ndarray:
    """The number of cells around the ways of each layer, which begin at `first`; about `room` cells are looked at at once."""
    low = lambda a, b: np.floor((np.minimum(a, b) - r) / cell).astype(np.int64)
    high = lambda a, b: np.floor((np.maximum(a, b) + r) / cell).astype(np.int64)
    ix, iy = low(x1, x2), low(y1, y2)
    wide, tall = high(x1, x2) - ix + 1, high(y1, y2) - iy + 1
    # the box of each layer, and its place in a map of all layers that are looked at together
    west, south = (np.minimum.reduceat(c, first) for c in (ix, iy))
    across, up = (np.maximum.reduceat(c, first) - least for c, least in ((ix + wide, west), (iy + tall, south)))
    layer = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x1))))
    looked = np.append(0, np.cumsum(wide * tall))
    work = np.append(0, np.cumsum(across * up)) + looked[np.append(first, len(x1))]
    sizes = np.zeros(len(first), np.int64)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(work, work[a] + room, side="right")) - 1)
        area = np.append(0, np.cumsum(across[a:b] * up[a:b]))
        mapped = area[-1] <= 256 * room
        marks = np.zeros(area[-1] if mapped else 0, bool)
        some: list[np.ndarray] = []
        i, end = first[a], first[b] if b < len(first) else len(x1)
        while i < end:
            j = min(end, max(i + 1, int(np.searchsorted(looked, looked[i] + room, side="right")) - 1))
            many = wide[i:j] * tall[i:j]
            way = np.repeat(np.arange(i, j), many)
            nth = np.arange(len(way)) - np.repeat(np.cumsum(many) - many, many)
            cx, cy = ix[way] + nth // tall[way], iy[way] + nth % tall[way]
            px, py, ax, ay, dx, dy = (cx + 0.5) * cell, (cy + 0.5) * cell, x1[way], y1[way], (x2 - x1)[way], (y2 - y1)[way]
            square = dx * dx + dy * dy
            t = np.clip(np.divide((px - ax) * dx + (py - ay) * dy, square, out=np.zeros(len(way)), where=square != 0), 0.0, 1.0)
            gx, gy = px - ax - t * dx, py - ay - t * dy
            near = gx * gx + gy * gy <= (r * r)[way]
            own = layer[way[near]]
            at = area[own - a] + (cx[near] - west[own]) * up[own] + cy[near] - south[own]
            if mapped:
                marks[at] = True
            else:  # a layer whose ways lie far apart
                some.append(np.unique(at))
            i = j
        held = np.flatnonzero(marks) if mapped else np.unique(np.concatenate(some))
        sizes[a:b] = np.diff(np.searchsorted(held, area))
        a = b
    return sizes
