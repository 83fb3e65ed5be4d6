"""Spatial joins over planar metres. Each turns its distance or containment predicate into an equality on grid
cells, so that Spark plans a hash or sort-merge join, and then filters exactly. The left side is repeated over the
cells around it; it should be the smaller one. Skewed cells are left to adaptive execution, which may split them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(df: DataFrame, x: str, y: str, size: float, reach: int = 0) -> DataFrame:
    """df with (cx, cy), its cell; with a reach, once for each cell at most so far away."""
    cx, cy = (F.floor(F.col(c) / size).cast("long") for c in (x, y))
    if not reach:
        return df.withColumns({"cx": cx, "cy": cy})
    around = lambda c: F.explode(F.sequence(c - reach, c + reach))
    return df.withColumn("cx", around(cx)).withColumn("cy", around(cy))


def squared(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by number of rows. A row here becomes many: by its size alone, a few tasks would get all of them,
    whichever side is broadcast. Rows are dealt once more before the join for it, which is little beside its pairs."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides. Spark sends a side to all tasks if its files are small, and doesn't count that
    files are packed and that rows are repeated over cells: such a side can be a hundred times as large in memory."""
    return df.hint("merge")


def radius_join(left: DataFrame, right: DataFrame, radius: float, a: tuple[str, str] = ("x", "y"), b: tuple[str, str] = ("x2", "y2")) -> DataFrame:
    """Pairs at most `radius` apart, with column d. Column names must differ between the sides."""
    # cells of half the radius: 25 of them hold less around the circle than 9 of its full size
    pairs = cells(spread(left), *a, radius / 2, 2).join(shuffled(cells(spread(right), *b, radius / 2)), ["cx", "cy"]).drop("cx", "cy")
    return pairs.withColumn("d", F.sqrt(squared(*map(F.col, (*a, *b))))).where(F.col("d") <= radius)


def nearest(pairs: DataFrame, key: str, order: list[Column], values: list[str]) -> DataFrame:
    """The first of each key's pairs in the given order, by an aggregate (no sort of the groups)."""
    first = F.min_by(F.struct(*values), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))))
    return pairs.groupBy(key).agg(first.alias("__v")).select(key, *(F.col(f"__v.{v}").alias(v) for v in values))


def nearest_unbounded(left: DataFrame, right: DataFrame, key: str, values: list[str], order: list[Column], size: float) -> DataFrame:
    """The nearest right row of every left row, however far. Rows with one within `size` are settled by a join of
    neighbouring cells. The others go down a tree of cells, from one that holds everything to cells of that size: at
    each level a row keeps the cells that may hold its nearest, which are those that begin no farther than the end of
    another one. Few cells are kept for each row, wherever it stands. Without right rows there are no rows."""
    from footreach.operators.graph import written

    d = F.sqrt(squared(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")))
    pairs = cells(left, "x", "y", size, 1).join(shuffled(cells(right, "x2", "y2", size)), ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= size)
    found = written(nearest(pairs, key, order, values))
    rest = written(left.join(shuffled(found.select(key)), key, "left_anti"))
    ends = right.agg(F.min("x2"), F.min("y2"), F.greatest(F.max("x2") - F.min("x2"), F.max("y2") - F.min("y2"))).first()
    if ends[0] is None or not rest.head(1):
        return found
    levels = max(0, math.ceil(math.log2(ends[2] / size))) if ends[2] > 0 else 0
    leaves = right.withColumns({"qx": F.floor((F.col("x2") - ends[0]) / size).cast("long"), "qy": F.floor((F.col("y2") - ends[1]) / size).cast("long")})
    boxes = written(leaves.groupBy("qx", "qy").agg(F.min("x2").alias("x0"), F.max("x2").alias("x1"), F.min("y2").alias("y0"), F.max("y2").alias("y1")))
    open_ = rest.select(key, "x", "y", F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("py"))
    for level in range(levels, -1, -1):
        down = lambda c, by: F.shiftright(c, by)
        own = boxes.groupBy(down("qx", level).alias("kx"), down("qy", level).alias("ky")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
        own = own.withColumns({"px": down("kx", 1) if level < levels else F.lit(0).cast("long"), "py": down("ky", 1) if level < levels else F.lit(0).cast("long")})
        low = box_distance(*map(F.col, ("x", "y", "x0", "y0", "x1", "y1")))
        far = lambda c: F.greatest(F.abs(F.col(c) - F.col(f"{c}0")), F.abs(F.col(c) - F.col(f"{c}1")))
        near = open_.join(own, ["px", "py"]).select(key, "x", "y", "kx", "ky", low.alias("low"), F.sqrt(far("x") * far("x") + far("y") * far("y")).alias("high"))
        near = written(near)
        least = near.groupBy(key).agg(F.min("high").alias("least"))
        # a little more, as the bounds are rounded
        open_ = written(near.join(shuffled(least), key).where(F.col("low") <= F.col("least") * (1 + 1e-9)).select(key, "x", "y", F.col("kx").alias("px"), F.col("ky").alias("py")))
    last = open_.join(shuffled(leaves), (F.col("px") == F.col("qx")) & (F.col("py") == F.col("qy"))).withColumn("d", d)
    return found.unionByName(nearest(last, key, order, values))


def bbox_join(points: DataFrame, boxes: DataFrame, size: float, how: str = "inner") -> DataFrame:
    """Points (x, y) in boxes (x0, y0, x1, y1), borders included. A box goes to all cells that it covers."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size).cast("long"), F.floor(F.col(hi) / size).cast("long")))
    spread = boxes.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    own = cells(points, "x", "y", size)
    inside = (own.cx == spread.cx) & (own.cy == spread.cy) & own.x.between(spread.x0, spread.x1) & own.y.between(spread.y0, spread.y1)
    out = own.join(spread, inside, how)
    if how in ("left_semi", "left_anti"):
        return out.drop("cx", "cy")
    return out.drop(own.cx, own.cy, spread.cx, spread.cy)


def segment_hits_box(x1: Column, y1: Column, x2: Column, y2: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Whether an axis-parallel segment touches a box."""
    return (F.greatest(x1, x2) >= bx0) & (F.least(x1, x2) <= bx1) & (F.greatest(y1, y2) >= by0) & (F.least(y1, y2) <= by1)


def segments_cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Whether segments a-b and c-d cross inside both: end points that only touch do not count."""
    side = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    one, two = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy)
    three, four = side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
    return (one * two < 0) & (three * four < 0)


def box_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point to a box; zero inside."""
    zero = F.lit(0.0)
    dx, dy = F.greatest(x0 - x, zero, x - x1), F.greatest(y0 - y, zero, y - y1)
    return F.sqrt(dx * dx + dy * dy)


def covering_tiles(boxes: DataFrame, x0: str, y0: str, x1: str, y1: str, origin: tuple[float, float], size: tuple[float, float], pad: float) -> DataFrame:
    """boxes with (row, col) of every tile whose padded extent they touch."""
    at = lambda c, k, shift: F.floor((F.col(c) + shift - origin[k]) / size[k]).cast("int")
    return boxes.withColumn("col", F.explode(F.sequence(at(x0, 0, -pad), at(x1, 0, pad)))).withColumn("row", F.explode(F.sequence(at(y0, 1, -pad), at(y1, 1, pad))))
