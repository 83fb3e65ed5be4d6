"""Polygons as tables of edges: containment, contact with segments, clipping to boxes, and cells around lines.

A polygon is rows (poly, x1, y1, x2, y2), one for each edge of its rings; holes are rings like others. Containment is
even-odd parity, worked out by an aggregate over edges in bands of y, so neither a polygon nor its edges have to be in one
row. Coordinates are planar metres."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footreach.operators.spatial import bbox_join, shuffled

#: How far off a border may be through rounding, in metres.
TOUCH = 1e-9


def ring_edges(rings: DataFrame, *keys: str) -> DataFrame:
    """(keys, x1, y1, x2, y2) of rings (keys, points): an array of structs x, y, closed or not."""
    at = F.transform(F.sequence(F.lit(0), F.size("points") - 1), lambda i: F.struct(F.get("points", i).alias("a"), F.get("points", (i + 1) % F.size("points")).alias("b")))
    rows = rings.select(*keys, F.explode(at).alias("e")).select(*keys, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    return rows.where("x1 <> x2 or y1 <> y2")


def side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Twice the area of the triangle a, b, p: above zero left of a-b."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def touches(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Whether segments a-b and c-d have a point in common; ends count."""
    sign = lambda *p: F.signum(side(*p))
    over = lambda a, b, c, d: (F.greatest(a, b) >= F.least(c, d)) & (F.greatest(c, d) >= F.least(a, b))
    apart = (sign(ax, ay, bx, by, cx, cy) * sign(ax, ay, bx, by, dx, dy) <= 0) & (sign(cx, cy, dx, dy, ax, ay) * sign(cx, cy, dx, dy, bx, by) <= 0)
    return apart & over(ax, bx, cx, dx) & over(ay, by, cy, dy)


def span(a: Column, b: Column, size: float) -> Column:
    """Numbers of the cells from one coordinate to the other, as rows."""
    return F.explode(F.sequence(F.floor(F.least(a, b) / size).cast("long"), F.floor(F.greatest(a, b) / size).cast("long")))


def covered(points: DataFrame, edges: DataFrame, key: str, size: float = 200.0, border: bool = True) -> DataFrame:
    """(key, poly): the points (key, x, y) that polygons cover, borders included, or by parity alone: then of two polygons that
    share a side just one covers a point on it.

    A point meets a polygon if its bounding box, spread over cells, holds it, and then only the edges in its band of y."""
    boxes = edges.groupBy("poly").agg(F.min(F.least("x1", "x2")).alias("x0"), F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("x1", "x2")).alias("x1"), F.max(F.greatest("y1", "y2")).alias("y1"))
    pairs = bbox_join(points.select(key, "x", "y"), shuffled(boxes), size).select(key, "x", "y", "poly", F.floor(F.col("y") / size).cast("long").alias("band"))
    banded = edges.select("poly", "x1", "y1", "x2", "y2").withColumn("band", span(F.col("y1"), F.col("y2"), size))
    x, y, x1, y1, x2, y2 = map(F.col, ("x", "y", "x1", "y1", "x2", "y2"))
    crossed = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    near = lambda v, a, b: (v >= F.least(a, b) - TOUCH) & (v <= F.greatest(a, b) + TOUCH)
    on = (F.abs(side(x1, y1, x2, y2, x, y)) <= TOUCH * F.greatest(F.abs(x2 - x1), F.abs(y2 - y1))) & near(x, x1, x2) & near(y, y1, y2)
    marked = pairs.join(shuffled(banded), ["poly", "band"]).select(key, "poly", crossed.cast("int").alias("crossed"), (on if border else F.lit(False)).cast("int").alias("border"))
    return marked.groupBy(key, "poly").agg((F.sum("crossed") % 2 + F.max("border")).alias("n")).where("n > 0").select(key, "poly")


def met(segments: DataFrame, edges: DataFrame, key: str, size: float = 200.0) -> DataFrame:
    """(key): the segments (key, x1, y1, x2, y2) that have a point in common with a polygon, inside or on its border."""
    own = segments.select(key, *(F.col(c).alias(f"s{c}") for c in ("x1", "y1", "x2", "y2")))
    cut = own.withColumn("cx", span(F.col("sx1"), F.col("sx2"), size)).withColumn("cy", span(F.col("sy1"), F.col("sy2"), size))
    other = edges.select("x1", "y1", "x2", "y2").withColumn("cx", span(F.col("x1"), F.col("x2"), size)).withColumn("cy", span(F.col("y1"), F.col("y2"), size))
    hit = cut.join(shuffled(other), ["cx", "cy"]).where(touches(*map(F.col, ("sx1", "sy1", "sx2", "sy2", "x1", "y1", "x2", "y2")))).select(key)
    # one that meets no border lies inside with both ends, or outside
    start = covered(own.select(key, F.col("sx1").alias("x"), F.col("sy1").alias("y")), edges, key, size).select(key)
    return hit.unionByName(start).distinct()


def clipped(points: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A ring's points (array of structs x, y) cut to a box: one half-plane after the other, each a fold over the points.

    The result of a ring that is not convex may run along the box's sides and back; its area is right nevertheless."""

    def half(ring: Column, axis: str, bound: Column, above: bool) -> Column:
        def fold(kept: Column, i: Column) -> Column:
            a, b = F.get(ring, (i + F.size(ring) - 1) % F.size(ring)), F.get(ring, i)
            inside = lambda p: (p[axis] >= bound) if above else (p[axis] <= bound)
            t = (bound - a[axis]) / (b[axis] - a[axis])
            other = "y" if axis == "x" else "x"
            across = a[other] + (b[other] - a[other]) * t
            cut = F.struct((bound if axis == "x" else across).cast("double").alias("x"), (bound if axis == "y" else across).cast("double").alias("y"))
            return F.when(inside(b), F.when(inside(a), F.concat(kept, F.array(b))).otherwise(F.concat(kept, F.array(cut, b)))).otherwise(F.when(inside(a), F.concat(kept, F.array(cut))).otherwise(kept))

        none = F.array().cast("array<struct<x:double,y:double>>")
        return F.when(F.size(ring) > 0, F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), none, fold)).otherwise(none)

    # each step under a name of its own: else the next one would work it out again for every point
    step = lambda ring, *how: F.transform(F.array(ring), lambda r: half(r, *how))[0]
    return step(step(step(step(points, "x", x0, True), "x", x1, False), "y", y0, True), "y", y1, False)


def ring_area(points: Column) -> Column:
    """The signed area of a ring: above zero anticlockwise."""
    n = F.size(points)
    twice = lambda acc, i: acc + F.get(points, i)["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * F.get(points, i)["y"]
    return F.when(n > 2, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), twice) / 2).otherwise(0.0)


def cells_around(segments: DataFrame, key: str, radius: float, cell: float) -> DataFrame:
    """(key, ix, iy): the cells whose centres lie at most `radius` from the segment (key, x1, y1, x2, y2)."""
    axis = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - radius) / cell).cast("long"), F.floor((F.greatest(a, b) + radius) / cell).cast("long")))
    rows = segments.select(key, "x1", "y1", "x2", "y2").withColumn("ix", axis("x1", "x2")).withColumn("iy", axis("y1", "y2"))
    px, py = (F.col("ix") + 0.5) * cell, (F.col("iy") + 0.5) * cell
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = ((px - F.col("x1")) * dx + (py - F.col("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    gone = lambda p, a, d: p - F.col(a) - t * d
    return rows.where(gone(px, "x1", dx) * gone(px, "x1", dx) + gone(py, "y1", dy) * gone(py, "y1", dy) <= radius * radius).select(key, "ix", "iy")


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The corners of the convex hull, anticlockwise from the leftmost, lowest one; points on its sides are none."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    chains = []
    for order in (points, points[::-1]):
        chain: list[tuple[float, float]] = []
        for p in order:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    return chains


def convex_hulls(points: DataFrame, key: str) -> DataFrame:
    """(key, corners) of points (key long, x, y). Batches send the corners of their own hulls only, and whoever closes a key
    keeps no more than its hull so far, so no key is ever held whole. Points without extent have one or two corners."""

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[float, float]]]]:
        by: dict[int, list[tuple[float, float]]] = {}
        for k, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by.setdefault(k, []).append((x, y))
        yield from by.items()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *p) for k, own in runs(batch) for p in hull(own)]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.float64()), strict=True)], names=[key, "x", "y"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(k: int, own: list[tuple[float, float]]) -> pa.RecordBatch:
            corners = pa.array([[{"x": x, "y": y} for x, y in own]], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), corners], names=[key, "corners"])

        last: tuple[int, list[tuple[float, float]]] | None = None
        for batch in batches:
            for k, own in runs(batch):
                if last and last[0] != k:
                    yield out(*last)
                    last = None
                last = (k, hull(own + (last[1] if last else [])))
        if last:
            yield out(*last)

    some = points.select(F.col(key).cast("long").alias(key), "x", "y").mapInArrow(partial, f"{key} long, x double, y double")
    return some.repartition(key).sortWithinPartitions(key).mapInArrow(whole, f"{key} long, corners array<struct<x:double,y:double>>")
