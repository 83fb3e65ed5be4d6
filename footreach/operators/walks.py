"""Walks answered in the task of their tile: streets are cut, searched and measured where their requests are.

A tile gets what its requests can meet and nothing comes back but answers, so neither pieces of streets, nor costs, nor cells
are ever shuffled or written. Rows of all kinds travel in one shuffle as (tx, ty, what, key, a): numbers in an array."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footreach import config as C
from footreach.operators.geometry import TOUCH, hull
from footreach.operators.graph import local_found

#: Kinds of rows, in the order in which a task reads them.
LINE, RING, RAIL, EDGE, PLACE, FACE, MEASURED, ASKED = range(8)
ROAD, BRIDGE, TUNNEL = range(3)
WALL, WATER = range(2)
#: Events closer than this to a line's end are the end.
END_M, EPS = 1e-6, 1e-9
NO = np.zeros(0, np.int64)

Rows = tuple[np.ndarray, np.ndarray, np.ndarray]  # keys, numbers in each row, numbers


def numbers(*columns: Column | str) -> Column:
    return F.array(*(F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in columns))


def halves(name: str) -> list[Column]:
    """A long as two numbers: one double holds none above 2^53."""
    c = F.col(name).cast("long")
    return [F.shiftright(c, 32), c.bitwiseAND(F.lit((1 << 32) - 1))]


def longs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.int64) * (1 << 32) + low.astype(np.int64)


def to_tiles(rows: DataFrame, what: int, key: str, values: Column, box: tuple[Column, Column, Column, Column], size: float, margin: float = 0.0) -> DataFrame:
    """Rows for in_tiles(): each goes to all tiles that its box, widened by the margin, meets."""
    axis = lambda lo, hi: F.explode(F.sequence(F.floor((lo - margin) / size).cast("long"), F.floor((hi + margin) / size).cast("long")))
    own = rows.select(F.lit(what).alias("what"), F.col(key).cast("long").alias("key"), values.alias("a"), *(c.alias(f"b{i}") for i, c in enumerate(box)))
    return own.withColumn("tx", axis(F.col("b0"), F.col("b2"))).withColumn("ty", axis(F.col("b1"), F.col("b3"))).select("tx", "ty", "what", "key", "a")


def in_tiles(tables: list[DataFrame], prepare: Callable[[dict[int, Rows]], object], answer: Callable[[object, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """answer(prepare(rows by kind), keys, numbers as a table) for the requests of each tile, of which a batch is held at once. Tiles
    without requests are not prepared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            tx, ty, what, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tx", "ty", "what", "key"))
            asked = what == ASKED
            cuts = [0, *(np.flatnonzero((tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1]) | (asked[1:] != asked[:-1])) + 1).tolist(), len(tx)]
            for a, b in itertools.pairwise(cuts):
                if (own := (tx[a], ty[a])) != tile:
                    tile, parts, ready = own, [], None
                lists = batch.column("a").slice(a, b - a)
                sizes, values = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
                if not asked[a]:
                    parts.append((what[a:b], key[a:b], sizes, values))
                    continue
                if ready is None:
                    kinds, keys, many, flat = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (NO, NO, NO, NO.astype(float))
                    ready = (prepare({k: (keys[kinds == k], many[kinds == k], flat[np.repeat(kinds == k, many)]) for k in range(ASKED)}),)
                yield from answer(ready[0], key[a:b], values.reshape(b - a, -1))

    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more)
    # a search takes far longer than its rows are long: tiles are spread by number
    dealt = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "tx", "ty").sortWithinPartitions("tx", "ty", "what", "key")
    return dealt.mapInArrow(run, schema)


def runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number): the whole numbers from lo to hi of each row."""
    n = np.maximum(hi - lo + 1, 0)
    row = np.repeat(np.arange(len(lo)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def meeting(a: np.ndarray, b: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): the pairs of boxes, columns of (x0, y0, x1, y1), that have a point in common. Boxes meet in the cells that they share;
    each pair counts in the first of these only."""

    def cells(box: np.ndarray) -> tuple[np.ndarray, ...]:
        low, high = np.floor(box[:2] / size).astype(np.int64), np.floor(box[2:] / size).astype(np.int64)
        i, cx = runs(low[0], high[0])
        k, cy = runs(low[1][i], high[1][i])
        return low, i[k], cx[k], cy

    (low, i, cx, cy), (o_low, j, ox, oy) = cells(a), cells(b)
    if not len(i) or not len(j):
        return NO, NO
    least = min(cy.min(), oy.min())
    wide = max(cy.max(), oy.max()) - least + 1
    own, other = cx * wide + (cy - least), ox * wide + (oy - least)
    order = np.argsort(other, kind="stable")
    first, last = (np.searchsorted(other[order], own, side=s) for s in ("left", "right"))
    row, at = runs(first, last - 1)
    p, q = i[row], j[order[at]]
    once = (cx[row] == np.maximum(low[0][p], o_low[0][q])) & (cy[row] == np.maximum(low[1][p], o_low[1][q]))
    p, q = p[once], q[once]
    over = (a[2][p] >= b[0][q]) & (b[2][q] >= a[0][p]) & (a[3][p] >= b[1][q]) & (b[3][q] >= a[1][p])
    return p[over], q[over]


def boxes(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, wider: float = 0.0) -> np.ndarray:
    return np.stack([np.minimum(x1, x2) - wider, np.minimum(y1, y2) - wider, np.maximum(x1, x2) + wider, np.maximum(y1, y2) + wider])


def unpacked(rows: Rows, heads: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(heads as a table, points in each row, row of each point, x, y) of rows that hold some numbers and then points."""
    _, many, flat = rows
    at = (np.cumsum(many) - many)[:, None] + np.arange(heads)
    rest = np.ones(len(flat), bool)
    rest[at] = False
    xy, n = flat[rest].reshape(-1, 2), (many - heads) // 2
    return flat[at], n, np.repeat(np.arange(len(n)), n), xy[:, 0], xy[:, 1]


def node_id(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As in streets: a node's id from its place to the millimetre."""
    key = lambda c: np.floor(c * 1000 + 0.5).astype(np.int64)
    return key(x) * (1 << 32) + key(y)


class Rings(NamedTuple):
    """Rings with their sides in order; a polygon's holes are rings like others."""

    box: np.ndarray
    poly: np.ndarray
    first: np.ndarray
    many: np.ndarray
    side: np.ndarray  # x1, y1, x2, y2 of all sides


def rings_of(rows: Rows, use: tuple[int, ...]) -> Rings:
    head, n, row, x, y = unpacked(rows, 1)
    last = np.cumsum(n)
    after = np.arange(1, len(x) + 1)
    after[last[n > 0] - 1] = (last - n)[n > 0]
    kept = np.isin(head[:, 0], use)
    some = kept[row] & ((x != x[after]) | (y != y[after]))
    side = np.stack([x, y, x[after], y[after]])[:, some]
    many = np.bincount(row[some], minlength=len(n))
    kept &= many > 0
    first, many, poly = (np.cumsum(many) - many)[kept], many[kept], np.unique(rows[0][kept], return_inverse=True)[1]
    if not len(poly):
        return Rings(np.zeros((4, 0)), NO, NO, NO, side)
    box = np.stack([how.reduceat(how(side[a], side[a + 2]), first) for how, a in ((np.minimum, 0), (np.minimum, 1), (np.maximum, 0), (np.maximum, 1))])
    return Rings(box, poly, first, many, side)


def covered(x: np.ndarray, y: np.ndarray, rings: Rings, border: bool = False, size: float = 200.0) -> np.ndarray:
    """Whether polygons cover the points, by parity; on the border too, if asked for."""
    out = np.zeros(len(x), bool)
    p, r = meeting(np.stack([x, y, x, y]), rings.box + np.array([[-1.0], [-1.0], [1.0], [1.0]]) * TOUCH, size)
    if not len(p):
        return out
    i, e = runs(rings.first[r], rings.first[r] + rings.many[r] - 1)
    p, poly = p[i], rings.poly[r[i]]
    (x1, y1, x2, y2), px, py = rings.side[:, e], x[p], y[p]
    with np.errstate(divide="ignore", invalid="ignore"):
        crossed = ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
    pair, at = np.unique(p * (rings.poly.max() + 1) + poly, return_inverse=True)
    inside = np.bincount(at, crossed) % 2 > 0
    if border:
        near = lambda v, a, b: (v >= np.minimum(a, b) - TOUCH) & (v <= np.maximum(a, b) + TOUCH)
        on = (np.abs(side(x1, y1, x2, y2, px, py)) <= TOUCH * np.maximum(np.abs(x2 - x1), np.abs(y2 - y1))) & near(px, x1, x2) & near(py, y1, y2)
        inside |= np.bincount(at, on) > 0
    out[pair[inside] // (rings.poly.max() + 1)] = True
    return out


def side(ax, ay, bx, by, px, py):
    """Twice the area of the triangle a, b, p: above zero left of a-b."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def met(pieces: np.ndarray, rings: Rings, size: float = 200.0) -> np.ndarray:
    """Whether pieces (columns of x1, y1, x2, y2) have a point in common with a polygon, inside or on its border."""
    out = covered(pieces[0], pieces[1], rings, True, size)
    p, e = meeting(boxes(*pieces), boxes(*rings.side), size)
    a, b, c, d = (pieces[:2, p], pieces[2:, p], rings.side[:2, e], rings.side[2:, e])
    sign = lambda *at: np.sign(side(*(v for q in at for v in q)))
    out[p[(sign(a, b, c) * sign(a, b, d) <= 0) & (sign(c, d, a) * sign(c, d, b) <= 0)]] = True
    return out


def crossed(pieces: np.ndarray, rails: np.ndarray, size: float = 200.0) -> np.ndarray:
    """Whether pieces cross a rail inside both or run along one."""
    out = np.zeros(pieces.shape[1], bool)
    p, e = meeting(boxes(*pieces), boxes(*rails), size)
    a, b, c, d = (pieces[:2, p], pieces[2:, p], rails[:2, e], rails[2:, e])
    s = lambda *at: side(*(v for q in at for v in q))
    cross = (np.sign(s(a, b, c)) * np.sign(s(a, b, d)) < 0) & (np.sign(s(c, d, a)) * np.sign(s(c, d, b)) < 0)
    r = b - a
    at = lambda q: (q - a)[0] * r[0] + (q - a)[1] * r[1]
    length = r[0] * r[0] + r[1] * r[1]
    along = (s(a, b, c) == 0) & (s(a, b, d) == 0) & (np.minimum(length, np.maximum(at(c), at(d))) > np.maximum(0.0, np.minimum(at(c), at(d))))
    out[p[cross | along]] = True
    return out


def noded(line: np.ndarray, k: np.ndarray, x: np.ndarray, y: np.ndarray, size: float = 250.0) -> tuple[np.ndarray, np.ndarray]:
    """(line, pieces as columns of x1, y1, x2, y2): streets.noded() for vertices in the order of line and k."""
    i = np.flatnonzero(line[1:] == line[:-1])
    own, seg = line[i], np.stack([x[i], y[i], x[i + 1], y[i + 1]])
    # a little wider, as the place of a crossing is rounded
    a, b = meeting(boxes(*seg, wider=1e-3), boxes(*seg, wider=1e-3), size)
    some = own[a] < own[b]
    a, b = a[some], b[some]
    (rx, ry), (sx, sy), (qx, qy) = seg[2:, a] - seg[:2, a], seg[2:, b] - seg[:2, b], seg[:2, b] - seg[:2, a]
    den = rx * sy - ry * sx
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (qx * sy - qy * sx) / den, (qx * ry - qy * rx) / den
    hit = (den != 0) & (t >= -EPS) & (t <= 1 + EPS) & (u >= -EPS) & (u <= 1 + EPS)
    a, b, t, u, rx, ry, sx, sy = (c[hit] for c in (a, b, t, u, rx, ry, sx, sy))
    cx, cy = seg[0, a] + t * rx, seg[1, a] + t * ry
    e, t, m = np.concatenate([a, b]), np.concatenate([t, u]), np.concatenate([np.sqrt(rx * rx + ry * ry), np.sqrt(sx * sx + sy * sy)])
    last = np.zeros(int(line.max()) + 1 if len(line) else 0, np.int64)
    np.maximum.at(last, line, k)
    # not those at a line's own ends
    inner = ((k[i[e]] > 0) | (t * m > END_M)) & ((k[i[e]] < last[own[e]] - 1) | ((1 - t) * m > END_M))
    e, t, cx, cy = e[inner], t[inner], np.tile(cx, 2)[inner], np.tile(cy, 2)[inner]
    line, at, x, y = np.concatenate([line, own[e]]), np.concatenate([k.astype(float), k[i[e]] + np.clip(t, 0.0, 1.0)]), np.concatenate([x, cx]), np.concatenate([y, cy])
    node = node_id(x, y)
    order = np.lexsort((y, x, at, node, line))
    first = order[np.r_[True, (line[order][1:] != line[order][:-1]) | (node[order][1:] != node[order][:-1])]] if len(order) else order
    order = first[np.lexsort((node[first], at[first], line[first]))]
    line, x, y = line[order], x[order], y[order]
    i = np.flatnonzero(line[1:] == line[:-1])
    return line[i], np.stack([x[i], y[i], x[i + 1], y[i + 1]])


class Streets(NamedTuple):
    """A tile's walk graph: edges with their ends, as ids (u, v) and as rows of nodes (a, b), and the nodes' places."""

    u: np.ndarray
    v: np.ndarray
    w: np.ndarray
    place: np.ndarray
    a: np.ndarray
    b: np.ndarray
    nodes: np.ndarray
    x: np.ndarray
    y: np.ndarray
    solid: Rings

    def arcs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate([self.u, self.v]), np.concatenate([self.v, self.u]), np.tile(self.w, 2)

    def at(self, nid: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.nodes, nid)


def streets_of(tables: dict[int, Rows]) -> Streets:
    """The walk graph of lines, walls, water and rails, by the rules of streets.walkable() and streets.street_edges()."""
    head, n, line, x, y = unpacked(tables[LINE], 2)
    k = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    own, pieces = noded(line, k, x, y)
    kind, speed = head[own].T
    road = kind == ROAD
    gone = met(pieces, rings_of(tables[RING], (WALL,)))
    gone[road] |= met(pieces[:, road], rings_of(tables[RING], (WATER,)))
    gone[road] |= crossed(pieces[:, road], tables[RAIL][2].reshape(-1, 4).T)
    x1, y1, x2, y2 = pieces
    metres = np.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
    u, v = node_id(x1, y1), node_id(x2, y2)
    free = ~gone & (u != v) & (metres > 0)
    u, v, pieces = u[free], v[free], pieces[:, free]
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    nx, ny = (np.full(len(nodes), np.inf) for _ in "xy")
    for c, i in ((nx, 0), (ny, 1)):
        np.minimum.at(c, at, np.concatenate([pieces[i], pieces[i + 2]]))
    return Streets(u, v, metres[free] / speed[free] * 60, pieces, at[: len(u)], at[len(u) :], nodes, nx, ny, rings_of(tables[RING], (WALL, WATER)))


def grouped(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, values): different values of each row, those of row r from first[r] to first[r + 1]."""
    wide = int(value.max()) + 1 if len(value) else 1
    pair = np.unique(row.astype(np.int64) * wide + value)
    return np.searchsorted(pair // wide, np.arange(rows + 1)), pair % wide


def different(start: np.ndarray, node: np.ndarray, own: tuple[np.ndarray, np.ndarray], room: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, value): the different values of the nodes of each start, for some starts at a time. Rows are in the order of starts."""
    first, values = own
    wide = int(values.max()) + 1 if len(values) else 1
    n = np.cumsum(first[node + 1] - first[node])
    begin = np.flatnonzero(np.r_[True, start[1:] != start[:-1]]) if len(start) else NO
    ends = np.r_[begin[1:], len(start)]
    a = 0
    while a < len(begin):
        done = n[begin[a] - 1] if begin[a] else 0
        b = max(a + 1, int(np.searchsorted(n[ends - 1], done + room, side="right")))
        some = slice(begin[a], ends[b - 1])
        i, at = runs(first[node[some]], first[node[some] + 1] - 1)
        pair = np.unique(start[some][i] * wide + values[at])
        yield pair // wide, pair % wide
        a = b


def snapped(x: np.ndarray, y: np.ndarray, g: Streets) -> np.ndarray:
    """The row of the nearest node of each middle of a cell, of equally near ones that with the larger id; -1 without one in reach."""
    out = np.full(len(x), -1)
    i, j = meeting(boxes(x, y, x, y, wider=C.SNAP_MAX_M + 1e-3), np.stack([g.x, g.y, g.x, g.y]), C.SNAP_MAX_M)
    d = np.sqrt((x[i] - g.x[j]) * (x[i] - g.x[j]) + (y[i] - g.y[j]) * (y[i] - g.y[j]))
    i, j, d = (c[d <= C.SNAP_MAX_M] for c in (i, j, d))
    order = np.lexsort((-j, d, i))  # nodes are in the order of their ids
    first = order[np.r_[True, i[order][1:] != i[order][:-1]]] if len(order) else order
    out[i[first]] = j[first]
    return out


def street_tiles(lines: DataFrame, obstacles: DataFrame, rails: DataFrame, asked: DataFrame, cutoff: float, beside: float = 0.0) -> tuple[list[DataFrame], float]:
    """Rows for in_tiles() whose graph is whole for all that its requests reach within the cutoff and `beside` it, and the width of a tile.

    lines: (line, points, kind, highway); obstacles: rings (poly, use, points) of walls and water; rails: (cx1, cy1, cx2, cy2); asked:
    (request_id, x, y). A line goes whole to all tiles that it may be walked in or may cut such a line in, so one line should be one
    street: the longest one's extent widens all margins. Points are arrays of structs x, y."""
    axis = lambda a: F.transform("points", lambda p: p[a])
    box = (F.array_min(axis("x")), F.array_min(axis("y")), F.array_max(axis("x")), F.array_max(axis("y")))
    flat = F.flatten(F.transform("points", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))
    longest = lines.agg(F.max(F.sqrt((box[2] - box[0]) * (box[2] - box[0]) + (box[3] - box[1]) * (box[3] - box[1])))).first()[0] or 0.0
    margin = C.SNAP_MAX_M + cutoff / 60 * max(C.WALK_SPEED, C.STEPS_SPEED) * (1 + 1e-9) + longest + beside + 1.0
    size = 6 * margin  # a line then goes to fewer than two tiles
    kind = F.when(F.col("kind") == "road", ROAD).when(F.col("kind") == "bridge", BRIDGE).otherwise(TUNNEL)
    speed = F.when(F.col("highway") == "steps", C.STEPS_SPEED).otherwise(C.WALK_SPEED)
    use = F.when(F.col("use") == "wall", WALL).otherwise(WATER)
    track = tuple(f(f"c{c}1", f"c{c}2") for f in (F.least, F.greatest) for c in "xy")
    middle = [(F.floor(F.col(c) / C.SNAP_GRID_M) + 0.5) * C.SNAP_GRID_M for c in "xy"]
    return [
        to_tiles(lines, LINE, "line", F.concat(numbers(kind, speed), flat), box, size, margin),
        to_tiles(obstacles.where(F.col("use").isin("wall", "water")), RING, "poly", F.concat(numbers(use), flat), box, size, margin),
        to_tiles(rails.withColumn("__key", F.lit(0)), RAIL, "__key", numbers("cx1", "cy1", "cx2", "cy2"), track, size, margin),
        to_tiles(asked, ASKED, "request_id", numbers(*middle, *(c for c in ("x", "y", "minutes") if c in asked.columns)), (*middle, *middle), size),
    ], size


def to_requests(key: np.ndarray, node: np.ndarray, start: np.ndarray, values: np.ndarray, name: str) -> pa.RecordBatch:
    """(request_id, name): what was found for starts, for each request that snapped to one."""
    order = np.argsort(start)
    i = np.minimum(np.searchsorted(start[order], node), max(0, len(start) - 1))
    known = start[order][i] == node if len(start) else np.zeros(len(node), bool)
    return pa.RecordBatch.from_arrays([pa.array(key[known]), pa.array(values[order][i[known]] if len(start) else values)], names=["request_id", name])


def searched(g: Streets, node: np.ndarray, cutoff: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, node, cost) as rows of nodes, in the order of starts, from the nodes that requests snapped to."""
    starts = np.unique(node[node >= 0])
    if len(starts):
        for start, found, cost, _ in local_found(g.nodes[starts], g.arcs(), cutoff):
            yield g.at(start), g.at(found), cost


def ground_of(g: Streets, radius: float, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """The cells within the radius of each node's edges whose centres no obstacle covers, numbered, as in grouped()."""
    x1, y1, x2, y2 = g.place
    span = lambda a, b: runs(np.floor((np.minimum(a, b) - radius) / cell).astype(np.int64), np.floor((np.maximum(a, b) + radius) / cell).astype(np.int64))
    e, ix = span(x1, x2)
    k, iy = span(y1[e], y2[e])
    e, ix = e[k], ix[k]
    px, py, dx, dy = (ix + 0.5) * cell, (iy + 0.5) * cell, x2[e] - x1[e], y2[e] - y1[e]
    t = np.clip(((px - x1[e]) * dx + (py - y1[e]) * dy) / (dx * dx + dy * dy), 0.0, 1.0)
    gx, gy = px - x1[e] - t * dx, py - y1[e] - t * dy
    near = gx * gx + gy * gy <= radius * radius
    e, ix, iy = e[near], ix[near], iy[near]
    least, wide = (iy.min(), iy.max() - iy.min() + 1) if len(iy) else (0, 1)
    cells, at = np.unique(ix * wide + (iy - least), return_inverse=True)
    free = ~covered((cells // wide + 0.5) * cell, (cells % wide + least + 0.5) * cell, g.solid)
    e, at = e[free[at]], at[free[at]]
    return grouped(np.concatenate([g.a[e], g.b[e]]), np.tile(at, 2), len(g.nodes))


def ground(lines: DataFrame, obstacles: DataFrame, rails: DataFrame, asked: DataFrame, cutoff: float, radius: float, cell: float) -> DataFrame:
    """(request_id, cells): how many cells lie within the radius of edges with an end that a request reaches. Requests that snap
    to no street, or have no cell, have no row."""

    def prepare(tables: dict[int, Rows]) -> tuple:
        g = streets_of(tables)
        return g, ground_of(g, radius, cell)

    def answer(ready: tuple, key: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        g, own = ready
        node = snapped(values[:, 0], values[:, 1], g)
        for start, found, _ in searched(g, node, cutoff):
            for at, _ in different(start, found, own):
                yield to_requests(key, node, *np.unique(at, return_counts=True), "cells")

    tables, _ = street_tiles(lines, obstacles, rails, asked, cutoff, radius + cell)
    return in_tiles(tables, prepare, answer, "request_id long, cells long")


def hulls(lines: DataFrame, obstacles: DataFrame, rails: DataFrame, asked: DataFrame, cutoff: float) -> DataFrame:
    """(request_id, area_m2): the area of the convex hull of all edges with an end that a request reaches."""

    def prepare(tables: dict[int, Rows]) -> tuple:
        g = streets_of(tables)
        return g, grouped(np.concatenate([g.a, g.a, g.b, g.b]), np.concatenate([g.a, g.b, g.a, g.b]), len(g.nodes))

    def area(points: list[tuple[float, float]]) -> float:
        corners, twice = hull(points), 0.0
        for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
            twice = twice + x1 * y2 - x2 * y1
        return twice / 2 if len(corners) > 2 else 0.0

    def answer(ready: tuple, key: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        g, own = ready
        node = snapped(values[:, 0], values[:, 1], g)
        for start, found, _ in searched(g, node, cutoff):
            for at, end in different(start, found, own):
                cuts = np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), len(at)]
                areas = [area(list(zip(g.x[end[a:b]].tolist(), g.y[end[a:b]].tolist(), strict=True))) for a, b in itertools.pairwise(cuts)]
                yield to_requests(key, node, at[cuts[:-1]], np.array(areas), "area_m2")

    tables, _ = street_tiles(lines, obstacles, rails, asked, cutoff)
    return in_tiles(tables, prepare, answer, "request_id long, area_m2 double")


class Places(NamedTuple):
    """A tile's places with what their order depends on, as in poi.ranked_traits(). Categories count from 0 in their fixed order; clinic
    and face are -1 where there is none."""

    id: np.ndarray
    x: np.ndarray
    y: np.ndarray
    category: np.ndarray
    seq: np.ndarray
    merge: np.ndarray
    lead: np.ndarray
    closed: np.ndarray
    clinic: np.ndarray
    metro: np.ndarray
    total: np.ndarray
    face: np.ndarray


class Access(NamedTuple):
    """How places are reached from nodes: of node n the rows from first[n] to first[n + 1], each a place, or a face, and its leg."""

    first: np.ndarray
    to: np.ndarray
    leg: np.ndarray


class Around(NamedTuple):
    """What a tile's requests may reach: places, their nodes and those of faces, and measured minutes (request, row of place, minutes)."""

    places: Places
    near: Access
    faces: Access
    many: int
    measured: tuple[np.ndarray, np.ndarray, np.ndarray]


def access(node: np.ndarray, to: np.ndarray, leg: np.ndarray, nodes: int) -> Access:
    order = np.argsort(node, kind="stable")
    return Access(np.searchsorted(node[order], np.arange(nodes + 1)), to[order], leg[order])


def around_of(tables: dict[int, Rows], g: Streets, radius: float = C.EDGE_ACCESS_M) -> Around:
    keys, _, flat = tables[PLACE]
    x, y, category, lead, closed, metro, total, *ids = flat.reshape(-1, 15).T
    seq, merge, clinic, face = map(longs, ids[::2], ids[1::2])
    boxes_at, _, sides = tables[FACE]
    box, whole = sides.reshape(-1, 4).T, np.stack([g.x, g.y, g.x, g.y])
    order = np.argsort(boxes_at)
    f = np.searchsorted(boxes_at[order], face)
    known = (f < len(boxes_at)) & (face >= 0)
    known[known] = boxes_at[order][f[known]] == face[known]
    of_face = np.full(len(face), -1)
    of_face[known] = order[f[known]]
    places = Places(keys, x, y, *(c.astype(np.int64) for c in (category, seq, merge, lead, closed, clinic, metro, total)), of_face)
    p, n = meeting(boxes(x, y, x, y, wider=radius + 1e-3), whole, radius)
    d = np.sqrt((x[p] - g.x[n]) * (x[p] - g.x[n]) + (y[p] - g.y[n]) * (y[p] - g.y[n]))
    near = d <= radius
    wide = C.AREA_LEG_M + C.GAP_MERGE_M
    b, m = meeting(boxes(*box, wider=wide + 1e-3), whole, radius)
    dx, dy = (np.maximum(np.maximum(box[i][b] - c[m], 0.0), c[m] - box[i + 2][b]) for i, c in ((0, g.x), (1, g.y)))
    gap = np.sqrt(dx * dx + dy * dy)
    beside = gap <= wide
    request, _, pair = tables[MEASURED]
    high, low, minutes = pair.reshape(-1, 3).T
    pid = longs(high, low)
    at = np.argsort(keys)
    i = np.minimum(np.searchsorted(keys[at], pid), max(0, len(keys) - 1))
    here = keys[at][i] == pid if len(keys) else np.zeros(len(pid), bool)
    request, row, minutes = request[here], at[i[here]] if len(keys) else NO, minutes[here]
    order = np.lexsort((minutes, row, request))
    least = order[np.r_[True, (request[order][1:] != request[order][:-1]) | (row[order][1:] != row[order][:-1])]] if len(order) else order
    return Around(places, access(n[near], p[near], d[near], len(g.nodes)), access(m[beside], b[beside], np.maximum(gap[beside] - C.GAP_MERGE_M, 0.0), len(g.nodes)), len(boxes_at), (request[least], row[least], minutes[least]))


def least_minutes(start: np.ndarray, node: np.ndarray, cost: np.ndarray, own: Access, n: int, many: int, snapped: bool | None = None, room: int = 1 << 21) -> np.ndarray:
    """The least of a node's minutes and the leg on, for each of n starts and of many places; only legs that do or don't snap, if told."""
    best = np.full(n * many, np.inf)
    sizes = np.cumsum(own.first[node + 1] - own.first[node])
    a = 0
    while a < len(node):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + room, side="right")))
        i, at = runs(own.first[node[a:b]], own.first[node[a:b] + 1] - 1)
        if snapped is not None:
            some = (own.leg[at] <= C.SNAP_MAX_M) == snapped
            i, at = i[some], at[some]
        np.minimum.at(best, start[a:b][i] * many + own.to[at], cost[a:b][i] / 60 + own.leg[at] / C.WALK_SPEED)
        a = b
    return best.reshape(n, many)


def shown(request: np.ndarray, place: np.ndarray, raw: np.ndarray, p: Places, n: int, cap: int = C.CAP_PER_CATEGORY) -> tuple[np.ndarray, ...]:
    """For each of n requests and category what coverage() counts of poi.selected(): places, places before the cut, the total of the category,
    and the least minutes of all, of metro and of bus stops. Rows are places within the minutes."""
    travel, public = (C.CATEGORIES.index(c) for c in ("transport", "public"))
    some = np.isin(p.category, (travel, public))
    same = np.where(p.clinic >= 0, -1, np.where(some, p.merge, p.id))
    order = np.lexsort((p.seq[place], p.closed[place], raw, same[place], p.clinic[place], p.category[place], request))
    request, place, raw = request[order], place[order], raw[order]
    differ = lambda *columns: np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.r_[True, differ(request, p.category[place], p.clinic[place], same[place])] if len(place) else np.zeros(0, bool)
    stays = first | ~some[place] | (p.clinic[place] >= 0)
    begin = np.flatnonzero(first)
    for a, b in zip(begin, np.r_[begin[1:], len(place)], strict=True) if (p.clinic[place] >= 0).any() else ():
        if b - a > 1 and p.clinic[place[a]] >= 0:
            kept: list[tuple[float, float]] = []
            for i in range(a, b):
                x, y = p.x[place[i]], p.y[place[i]]
                stays[i] = all((x - u) * (x - u) + (y - v) * (y - v) > C.HEALTH_MERGE_M * C.HEALTH_MERGE_M for u, v in kept)
                if stays[i]:
                    kept.append((x, y))
    request, place, raw = request[stays], place[stays], raw[stays]
    schools = np.where(p.category == C.CATEGORIES.index("education"), p.closed, 0)
    order = np.lexsort((p.seq[place], p.closed[place], raw, schools[place], p.lead[place], p.category[place], request))
    place, raw = place[order], raw[order]
    at = request[order] * len(C.CATEGORIES) + p.category[place]
    slots = n * len(C.CATEGORIES)
    total = np.bincount(at, minlength=slots)
    rank = np.arange(len(at)) - (np.cumsum(total) - total)[at]
    at, place, raw = at[rank < cap], place[rank < cap], raw[rank < cap]
    whole = np.zeros(slots, np.int64)
    np.maximum.at(whole, at, p.total[place])
    least = []
    for own in (np.ones(len(at), bool), (p.category[place] == travel) & (p.metro[place] > 0), (p.category[place] == travel) & (p.metro[place] == 0)):
        least.append(np.full(slots, np.inf))
        np.minimum.at(least[-1], at[own], raw[own])
    return np.minimum(total, cap), total, whole, *least


CIRCLE = "request_id long, minutes int, cat_no int, cnt int, within_count int, total int, any_min double, metro_min double, bus_min double, cells long"


def circle_rows(g: Streets, around: Around, key: np.ndarray, node: np.ndarray, x: np.ndarray, y: np.ndarray, minutes: np.ndarray, cutoff: float, reach: float, cells: tuple[np.ndarray, np.ndarray] | None, room: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows of CIRCLE, one for each category of each request that has a node; cells of the ground, or nodes, count as area."""
    p, many = around.places, len(around.places.id)
    order = np.argsort(node, kind="stable")
    order = order[node[order] >= 0]
    for start, found, cost in searched(g, node, cutoff):
        own, at = np.unique(start, return_inverse=True)
        area = np.bincount(at, minlength=len(own))
        if cells is not None:
            area = np.zeros(len(own), np.int64)
            for some, _ in different(at, found, cells):
                area += np.bincount(some, minlength=len(own))
        # requests of some starts at a time, as tables are of starts by places and rows of requests by places
        asked = order[np.searchsorted(node[order], own[0]) : np.searchsorted(node[order], own[-1], side="right")]
        begin = np.searchsorted(at, np.arange(len(own) + 1))
        step = max(1, room // max(1, many))
        for a in range(0, len(own), step):
            b = min(len(own), a + step)
            rows = slice(begin[a], begin[b])
            near, far = (least_minutes(at[rows] - a, found[rows], cost[rows], around.near, b - a, many, s) for s in (True, False))
            face = least_minutes(at[rows] - a, found[rows], cost[rows], around.faces, b - a, around.many)
            late = far
            if around.many:
                inside = p.face >= 0
                late[:, inside] = np.minimum(far[:, inside], face[:, p.face[inside]])
            raw = np.minimum(near, late)
            i, to = np.nonzero(np.isfinite(raw))
            ends = np.searchsorted(i, np.arange(b - a + 1))
            mine = asked[np.searchsorted(node[asked], own[a]) : np.searchsorted(node[asked], own[b - 1], side="right")]
            most = max(1, room // max(1, int(np.diff(ends).max(initial=0))))
            for c in range(0, len(mine), most):
                r = mine[c : c + most]
                s = np.searchsorted(own, node[r]) - a
                q, row = runs(ends[s], ends[s + 1] - 1)
                place, took = to[row], raw[i[row], to[row]]
                # measured minutes, but not where an edge was reached
                k, line = runs(*(np.searchsorted(around.measured[0], key[r], side=e) - (e == "right") for e in ("left", "right")))
                other = around.measured[1][line]
                use = ~(late[s[k], other] < near[s[k], other])
                k, other, line = k[use], other[use], line[use]
                keep = ~np.isin(q * many + place, k * many + other)
                q, place, took = np.r_[q[keep], k], np.r_[place[keep], other], np.r_[took[keep], around.measured[2][line]]
                dx, dy = x[r[q]] - p.x[place], y[r[q]] - p.y[place]
                within = (np.sqrt(dx * dx + dy * dy) <= reach) & (took <= minutes[r[q]])
                cnt, total, whole, *least = shown(q[within], place[within], took[within], p, len(r))
                times = len(C.CATEGORIES)
                columns = [pa.array(np.repeat(key[r], times)), *(pa.array(v.astype(np.int32)) for v in (np.repeat(minutes[r], times), np.tile(np.arange(times), len(r)), cnt, total, whole))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, mask=np.isinf(v)) for v in least), pa.array(np.repeat(area[s + a], times))], names=[f.split()[0] for f in CIRCLE.split(", ")])


def place_tiles(places: DataFrame, faces: DataFrame, measured: DataFrame, size: float, reach: float, margin: float) -> list[DataFrame]:
    """Rows for around_of(): places that lie within reach of a tile and faces that its graph meets. places: (id, x, y, cat_no, face) and traits, of which
    clinic is a number; faces: (box, x0, y0, x1, y1); measured: (request_id, id, measured_min, tile_x, tile_y), the place by which the request has its tile."""
    at, own = (F.col("x"), F.col("y"), F.col("x"), F.col("y")), (F.col("tile_x"), F.col("tile_y"), F.col("tile_x"), F.col("tile_y"))
    ids = places.withColumns({c: F.coalesce(F.col(c), F.lit(-1)) for c in ("clinic", "face")})
    metro = (F.coalesce("transport_kind", F.lit("bus")) == "metro").cast("int")
    return [
        to_tiles(ids, PLACE, "id", numbers("x", "y", "cat_no", "lead", "closed", metro, "cat_total", *(h for c in ("seq", "merge", "clinic", "face") for h in halves(c))), at, size, reach),
        to_tiles(faces, FACE, "box", numbers("x0", "y0", "x1", "y1"), tuple(map(F.col, ("x0", "y0", "x1", "y1"))), size, margin + C.AREA_LEG_M + C.GAP_MERGE_M + 1.0),
        to_tiles(measured, MEASURED, "request_id", numbers(*halves("id"), "measured_min"), own, size),
    ]


def edge_circles(edges: DataFrame, places: DataFrame, faces: DataFrame, measured: DataFrame, asked: DataFrame, cutoff: float, reach: float, slack: float = 100.0) -> DataFrame:
    """Rows of CIRCLE over a graph of edges (u, v, w, x1, y1, x2, y2), whose area is the nodes that are reached. asked: (request_id, nid, tile_x, tile_y,
    x, y, minutes), of which tile is the place of the node nid, no farther than the slack from the request."""
    metres = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))
    margin = cutoff * (edges.agg(F.max(F.when(metres > 0, metres / F.col("w")))).first()[0] or 0.0) * (1 + 1e-9) + 1.0
    if not np.isfinite(margin):
        raise ValueError("an edge that takes no time has two ends: what it reaches has no bound")
    size = 4 * margin
    at = (F.col("tile_x"), F.col("tile_y"), F.col("tile_x"), F.col("tile_y"))
    # a node at which a request begins may have no edge
    loops = asked.select(F.col("nid").alias("u"), F.col("nid").alias("v"), F.lit(0.0).alias("w"), *(F.col(f"tile_{c}").alias(f"{c}{k}") for k in (1, 2) for c in "xy")).distinct()
    whole = edges.select("u", "v", F.col("w").cast("double").alias("w"), "x1", "y1", "x2", "y2").unionByName(loops)
    box = tuple(f(f"{c}1", f"{c}2") for f in (F.least, F.greatest) for c in "xy")

    def prepare(tables: dict[int, Rows]) -> tuple:
        high, low, w, *place = tables[EDGE][2].reshape(-1, 7).T
        u, v, place = tables[EDGE][0], longs(high, low), np.stack(place)
        nodes, first, at = np.unique(np.concatenate([u, v]), return_index=True, return_inverse=True)
        x, y = (np.concatenate([place[i], place[i + 2]])[first] for i in (0, 1))
        none = np.zeros((4, 0))
        g = Streets(u, v, w, place, at[: len(u)], at[len(u) :], nodes, x, y, Rings(none, NO, NO, NO, none))
        return g, around_of(tables, g)

    def answer(ready: tuple, key: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        high, low, x, y, minutes = values.T
        yield from circle_rows(*ready, key, ready[0].at(longs(high, low)), x, y, minutes, cutoff, reach, None)

    tables = [to_tiles(whole, EDGE, "u", numbers(*halves("v"), "w", "x1", "y1", "x2", "y2"), box, size, margin), *place_tiles(places, faces, measured, size, reach + slack, margin)]
    return in_tiles([*tables, to_tiles(asked, ASKED, "request_id", numbers(*halves("nid"), "x", "y", "minutes"), at, size)], prepare, answer, CIRCLE)


def street_circles(lines: DataFrame, obstacles: DataFrame, rails: DataFrame, places: DataFrame, faces: DataFrame, measured: DataFrame, asked: DataFrame, cutoff: float, reach: float, radius: float, cell: float) -> DataFrame:
    """Rows of CIRCLE over streets, whose area is the ground within the radius, for requests (request_id, x, y, minutes) that snap to one. The tile of
    measured minutes is that of the middle of the request's cell."""

    def prepare(tables: dict[int, Rows]) -> tuple:
        g = streets_of(tables)
        return g, around_of(tables, g), ground_of(g, radius, cell)

    def answer(ready: tuple, key: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        g, around, cells = ready
        mx, my, x, y, minutes = values.T
        yield from circle_rows(g, around, key, snapped(mx, my, g), x, y, minutes, cutoff, reach, cells)

    tables, size = street_tiles(lines, obstacles, rails, asked, cutoff, radius + cell)
    return in_tiles([*tables, *place_tiles(places, faces, measured, size, reach + C.SNAP_GRID_M, size)], prepare, answer, CIRCLE)
