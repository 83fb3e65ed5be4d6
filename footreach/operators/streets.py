"""The walk graph from street lines: crossings become nodes, pieces that walls, water or rail are in the way of go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footreach import config as C
from footreach.operators.geometry import met, side, span
from footreach.operators.graph import written
from footreach.operators.spatial import segments_cross, shuffled

#: Events closer than this to a line's end are the end.
END_M = 1e-6


def node_id(x: Column, y: Column) -> Column:
    """A node's id from its place to the millimetre, without a dictionary of nodes: both keys in one long."""
    key = lambda c: F.floor(c * 1000 + 0.5).cast("long")
    return key(x) * F.lit(1 << 32).cast("long") + key(y)


def segments_of(vertices: DataFrame) -> DataFrame:
    """(line, k, x1, y1, x2, y2) of vertices (line, k, x, y), k counting from 0: by a join on the next number, as a line may be long."""
    after = vertices.select("line", (F.col("k") - 1).alias("k"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return vertices.select("line", "k", F.col("x").alias("x1"), F.col("y").alias("y1")).join(shuffled(after), ["line", "k"])


def crossing_points(segments: DataFrame, size: float = 250.0, eps: float = 1e-9) -> DataFrame:
    """(line, k, t, x, y): where each segment meets one of another line in a single point, ends included; t from 0 to 1.

    Segments meet in the cells that their boxes share; each pair counts in one of these only, the first. Parallel ones
    meet in no point or in ends, which are vertices anyway. Both lines get the very same point."""
    own = segments.withColumn("cx", span(F.col("x1"), F.col("x2"), size)).withColumn("cy", span(F.col("y1"), F.col("y2"), size))
    other = own.select("cx", "cy", *(F.col(c).alias(f"o_{c}") for c in ("line", "k", "x1", "y1", "x2", "y2")))
    low = lambda c, p: F.floor(F.least(f"{p}{c}1", f"{p}{c}2") / size)
    first = lambda cell, c: F.col(cell) == F.greatest(low(c, ""), low(c, "o_"))
    rx, ry, sx, sy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("o_x2") - F.col("o_x1"), F.col("o_y2") - F.col("o_y1")
    qx, qy = F.col("o_x1") - F.col("x1"), F.col("o_y1") - F.col("y1")
    den = rx * sy - ry * sx
    pairs = own.join(shuffled(other), ["cx", "cy"]).where((F.col("line") < F.col("o_line")) & first("cx", "x") & first("cy", "y") & (den != 0))
    pairs = pairs.withColumns({"t": (qx * sy - qy * sx) / den, "o_t": (qx * ry - qy * rx) / den}).where(F.col("t").between(-eps, 1 + eps) & F.col("o_t").between(-eps, 1 + eps))
    pairs = pairs.withColumns({"x": F.col("x1") + F.col("t") * rx, "y": F.col("y1") + F.col("t") * ry})
    both = F.array(F.struct(F.col("line"), F.col("k"), F.col("t"), F.sqrt(rx * rx + ry * ry).alias("m")), F.struct(F.col("o_line").alias("line"), F.col("o_k").alias("k"), F.col("o_t").alias("t"), F.sqrt(sx * sx + sy * sy).alias("m")))
    return pairs.select("x", "y", F.explode(both).alias("e")).select("e.*", "x", "y")


def noded(vertices: DataFrame, size: float = 250.0) -> DataFrame:
    """(line, n, x1, y1, x2, y2): lines cut at all their crossings with other lines. Of points of a line that are equal to the
    millimetre the first stays, so a line that comes back to itself is left open there."""
    segments = segments_of(vertices)
    ends = vertices.groupBy("line").agg(F.max("k").alias("last"))
    cuts = crossing_points(segments, size).join(shuffled(ends), "line")
    # not those at a line's own ends
    cuts = cuts.where(((F.col("k") > 0) | (F.col("t") * F.col("m") > END_M)) & ((F.col("k") < F.col("last") - 1) | ((1 - F.col("t")) * F.col("m") > END_M)))
    points = vertices.select("line", F.col("k").cast("double").alias("at"), "x", "y").unionByName(cuts.select("line", (F.col("k") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("t")))).alias("at"), "x", "y"))
    once = points.groupBy("line", node_id(F.col("x"), F.col("y")).alias("node")).agg(F.min("at").alias("at"), F.min_by("x", F.struct("at", "x", "y")).alias("x"), F.min_by("y", F.struct("at", "x", "y")).alias("y"))
    order = Window.partitionBy("line").orderBy("at", "node")
    rows = once.select("line", (F.row_number().over(order) - 1).alias("n"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(order).alias("x2"), F.lead("y").over(order).alias("y2"))
    return rows.where("x2 is not null")


def street_kind(highway: Column, bridge: Column, tunnel: Column) -> Column:
    """road, bridge or tunnel: a tunnel is one for walkers only."""
    return F.when(F.coalesce(bridge.isin(*C.TRUTHY), F.lit(False)), "bridge").when(F.coalesce(tunnel.isin(*C.TRUTHY) & highway.isin(*C.TUNNEL_HIGHWAYS), F.lit(False)), "tunnel").otherwise("road")


def walkable(pieces: DataFrame, walls: DataFrame | None = None, water: DataFrame | None = None, rails: DataFrame | None = None, size: float = 200.0) -> DataFrame:
    """pieces (line, n, x1, y1, x2, y2, kind) without those that touch a wall and, but for bridges and tunnels, water, or that
    cross a rail line or run along it. walls, water: edges of polygons; rails: (cx1, cy1, cx2, cy2)."""
    key = F.struct("line", "n").alias("piece")
    # each kind of obstacle reads all pieces: cut lines once, not for each
    own = written(pieces).select("*", key)
    gone = []
    open_ = own.where("kind = 'road'")
    if walls is not None:
        gone.append(met(own, walls, "piece", size))
    if water is not None:
        gone.append(met(open_, water, "piece", size))
    if rails is not None:
        cells = lambda df, p: df.withColumn("cx", span(F.col(f"{p}x1"), F.col(f"{p}x2"), size)).withColumn("cy", span(F.col(f"{p}y1"), F.col(f"{p}y2"), size))
        lines = rails.select(*(F.col(f"c{c}").alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")))
        ends = [F.col(c) for c in ("x1", "y1", "x2", "y2", "r_x1", "r_y1", "r_x2", "r_y2")]
        gone.append(cells(open_, "").join(cells(lines, "r_"), ["cx", "cy"]).where(segments_cross(*ends) | along(*ends)).select("piece").distinct())
    for bad in gone:
        own = own.join(shuffled(bad), "piece", "left_anti")
    return own.drop("piece")


def along(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Whether two segments of one line overlap in more than a point."""
    rx, ry = bx - ax, by - ay
    level = (rx * (cy - ay) - ry * (cx - ax) == 0) & (rx * (dy - ay) - ry * (dx - ax) == 0)
    at = lambda px, py: (px - ax) * rx + (py - ay) * ry
    length = rx * rx + ry * ry
    return level & (F.least(length, F.greatest(at(cx, cy), at(dx, dy))) > F.greatest(F.lit(0.0), F.least(at(cx, cy), at(dx, dy))))


def street_edges(pieces: DataFrame) -> DataFrame:
    """(u, v, w, length_m, kind, x1, y1, x2, y2) in seconds of pieces with highway and kind: steps are slower."""
    metres = F.sqrt(F.pow(F.col("x2") - F.col("x1"), F.lit(2.0)) + F.pow(F.col("y2") - F.col("y1"), F.lit(2.0)))
    speed = F.when(F.col("highway") == "steps", C.STEPS_SPEED).otherwise(C.WALK_SPEED)
    out = pieces.select(node_id(F.col("x1"), F.col("y1")).alias("u"), node_id(F.col("x2"), F.col("y2")).alias("v"), (metres / speed * 60).alias("w"), metres.alias("length_m"), "kind", "x1", "y1", "x2", "y2")
    return out.where("u <> v and length_m > 0")


def edge_nodes(edges: DataFrame) -> DataFrame:
    """(nid, x, y) of the ends of edges; of points equal to the millimetre the smallest."""
    ends = F.explode(F.array(*(F.struct(F.col(n).alias("nid"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for n, k in (("u", 1), ("v", 2)))))
    return edges.select(ends.alias("e")).select("e.*").groupBy("nid").agg(F.min("x").alias("x"), F.min("y").alias("y"))


def snapped(points: DataFrame, nodes: DataFrame, key: str, radius: float = C.SNAP_MAX_M, grid: float = C.SNAP_GRID_M) -> DataFrame:
    """(key, nid, d): points moved to the middle of their grid cell, then to the nearest node within the radius, of equally
    near ones that with the larger id. Points of one cell share their node."""
    from footreach.operators.spatial import nearest, radius_join

    middle = lambda c: (F.floor(F.col(c) / grid) + 0.5) * grid
    moved = points.select(key, middle("x").alias("x"), middle("y").alias("y"))
    cells = moved.select("x", "y", F.struct("x", "y").alias("cell")).dropDuplicates(["x", "y"])
    pairs = radius_join(cells, nodes.select("nid", F.col("x").alias("x2"), F.col("y").alias("y2")), radius)
    best = nearest(pairs, "cell", [F.col("d"), -F.col("nid")], ["nid", "d"])
    return moved.join(shuffled(best.select("cell.x", "cell.y", "nid", "d")), ["x", "y"]).select(key, "nid", "d")


def simplified(vertices: DataFrame, tolerance: float, rounds: int = 10_000) -> DataFrame:
    """The vertices (line, k, x, y), k from 0, that a line keeps so that none of the others is farther than the tolerance from
    the kept segment over it: both ends, and again and again the farthest one in between.

    A round looks for the farthest vertex of every open stretch at once and splits the stretch there, as rows, so neither
    a line nor its depth has to fit a task; of equally far ones the first. Stretches that are close enough are done. Open
    vertices carry the places of their stretch's ends, so a round shuffles what is still open and no other vertices."""
    at = F.struct("x", "y")
    ends = vertices.groupBy("line").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.min_by(at, "k").alias("a"), F.max_by(at, "k").alias("b"))
    own = ("line", "k", "x", "y", "lo", "hi", "x_lo", "y_lo", "x_hi", "y_hi")
    ends = written(ends.select("line", "lo", "hi", F.col("a.x").alias("x_lo"), F.col("a.y").alias("y_lo"), F.col("b.x").alias("x_hi"), F.col("b.y").alias("y_hi")))
    open_ = written(vertices.join(shuffled(ends), "line").where("k > lo and k < hi").select(*own))
    kept = [ends.select("line", F.explode(F.array("lo", "hi")).alias("k")).distinct()]
    a, b, p = (F.col("x_lo"), F.col("y_lo")), (F.col("x_hi"), F.col("y_hi")), (F.col("x"), F.col("y"))
    length = (b[0] - a[0]) * (b[0] - a[0]) + (b[1] - a[1]) * (b[1] - a[1])
    along = ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / F.nullif(length, F.lit(0.0))
    to = lambda q: F.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]))
    away = F.when(along.isNull() | (along <= 0), to(a)).when(along >= 1, to(b)).otherwise(F.abs(side(*a, *b, *p)) / F.sqrt(length))
    for _ in range(rounds):
        # what is near needn't travel
        far = open_.withColumn("away", away).where(F.col("away") > tolerance)
        best = far.groupBy("line", "lo", "hi").agg(F.max_by(F.struct("k", "x", "y"), F.struct("away", -F.col("k"))).alias("m"))
        split = written(best.select("line", "lo", "hi", F.col("m.k").alias("m"), F.col("m.x").alias("x_m"), F.col("m.y").alias("y_m")))
        if split.isEmpty():
            rest = kept[0]
            for more in kept[1:]:
                rest = rest.unionByName(more)
            return vertices.join(shuffled(rest), ["line", "k"], "left_semi")
        kept.append(split.select("line", F.col("m").alias("k")))
        half = open_.join(shuffled(split), ["line", "lo", "hi"]).where("k <> m")
        low, high = (lambda p: F.when(F.col("k") < F.col("m"), F.col(f"{p}lo")).otherwise(F.col(f"{p}m")).alias(f"{p}lo")), (lambda p: F.when(F.col("k") < F.col("m"), F.col(f"{p}m")).otherwise(F.col(f"{p}hi")).alias(f"{p}hi"))
        open_ = written(half.select("line", "k", "x", "y", *(end(p) for end in (low, high) for p in ("", "x_", "y_"))).select(*own))
    raise RuntimeError(f"lines are split deeper than {rounds} times")
