"""Blind spots: grid cells without a facility of a category within a kilometre, and their regions."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footreach import config as C
from footreach.operators import graph, outline
from footreach.operators.spatial import cells, shuffled, squared


def disc_cells(requests: DataFrame, radius: int = C.BLIND_RADIUS_M, cell: int = C.BLIND_CELL_M) -> DataFrame:
    """requests with (ix, iy, px, py): the cells whose centres lie within the radius."""
    n = radius // cell
    axis = F.sequence(F.lit(-n), F.lit(n))
    grid = requests.withColumn("ix", F.explode(axis)).withColumn("iy", F.explode(axis)).where(F.col("ix") * F.col("ix") + F.col("iy") * F.col("iy") <= n * n)
    return grid.withColumns({"px": F.col("x") + F.col("ix") * cell, "py": F.col("y") + F.col("iy") * cell})


def blind_cells(grid: DataFrame, places: DataFrame, groups: list[str], radius: float = C.BLIND_RADIUS_M) -> DataFrame:
    """(request_id, grp, ix, iy) of cells without a place (grp, x2, y2) of the group within the radius: an anti join on
    kilometre squares."""
    asked = grid.withColumn("grp", F.explode(F.array(*map(F.lit, groups)))).select("request_id", "grp", "ix", "iy", "px", "py")
    around = cells(places.withColumnRenamed("grp", "grp2"), "x2", "y2", radius, 1).withColumnsRenamed({"cx": "cx2", "cy": "cy2"})
    own = cells(asked, "px", "py", radius)
    near = (F.col("grp") == F.col("grp2")) & (F.col("cx") == F.col("cx2")) & (F.col("cy") == F.col("cy2")) & (squared(F.col("px"), F.col("py"), F.col("x2"), F.col("y2")) <= radius * radius)
    return own.join(around, near, "left_anti").select("request_id", "grp", "ix", "iy")


def blind_discs(requests: DataFrame, places: DataFrame, groups: list[str], radius: int = C.BLIND_RADIUS_M, disc: int = C.BLIND_RADIUS_M, cell: int = C.BLIND_CELL_M) -> DataFrame:
    """blind_cells() of the cells of discs around requests (request_id, x, y), as disc_cells() gives them.

    Requests go to their tile, and places (grp, x2, y2) to it and the tiles around it; a tile is as wide as what is farthest
    from a request and may still cover one of its cells. So neither cells nor their groups are rows before it is known that
    they are blind. A task holds a tile's places and a batch of requests."""
    reach, n = disc + radius + 1.0, disc // cell  # a little more, as sums are rounded
    ix, iy = (c.ravel() for c in np.meshgrid(np.arange(-n, n + 1), np.arange(-n, n + 1), indexing="ij"))
    ix, iy = ix[(inside := ix * ix + iy * iy <= n * n)], iy[inside]
    many, kind = len(groups), requests.schema["request_id"].dataType

    def cover(ids: pa.Array, x: np.ndarray, y: np.ndarray, g: np.ndarray, px: np.ndarray, py: np.ndarray) -> pa.RecordBatch:
        """Blind cells of some requests; places are in the order of their groups."""
        covered = np.zeros((len(x) * many, len(ix)), bool)
        dx, dy = x[:, None] - px, y[:, None] - py
        own, place = np.nonzero(dx * dx + dy * dy <= reach * reach)
        key = own * many + g[place]
        for j in range(0, len(key), 4096):
            k, m, p = key[j : j + 4096], own[j : j + 4096], place[j : j + 4096]
            dx, dy = x[m][:, None] + ix * cell - px[p][:, None], y[m][:, None] + iy * cell - py[p][:, None]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            covered[k[first]] |= np.logical_or.reduceat(dx * dx + dy * dy <= radius * radius, first, axis=0)
        at, c = np.nonzero(~covered)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at // many)), pa.array(groups).take(pa.array(at % many)), pa.array(ix[c].astype(np.int32)), pa.array(iy[c].astype(np.int32))], names=["request_id", "grp", "ix", "iy"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by tile, places first, then requests, whose g is above all groups."""
        tile, parts, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cx, cy, g, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cx", "cy", "g", "x", "y"))
            asked = g == many
            cuts = [0, *(np.flatnonzero((cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1]) | (asked[1:] != asked[:-1])) + 1).tolist(), len(g)]
            for a, b in itertools.pairwise(cuts):
                if (own := (cx[a], cy[a])) != tile:
                    tile, parts, ready = own, [], None
                if not asked[a]:
                    parts.append((g[a:b], x[a:b], y[a:b]))
                    continue
                ready = ready or tuple(np.concatenate(c) for c in zip((g[:0], x[:0], y[:0]), *parts, strict=True))
                room = max(1, min(512, (1 << 20) // max(1, len(ready[0]))))
                for i in range(a, b, room):
                    some = slice(i, min(b, i + room))
                    yield cover(batch.column("request_id").slice(i, some.stop - i), x[some], y[some], *ready)

    tile_of = lambda c: F.coalesce(F.floor(F.col(c) / reach).cast("long"), F.lit(0).cast("long")).alias(f"c{c}")
    known = places.where(F.col("grp").isin(*groups)).withColumn("g", (F.array_position(F.array(*map(F.lit, groups)), F.col("grp")) - 1).cast("int"))
    rows = cells(known, "x2", "y2", reach, 1).select("cx", "cy", "g", F.col("x2").alias("x"), F.col("y2").alias("y"), F.lit(None).cast(kind).alias("request_id")).unionByName(
        requests.select(tile_of("x"), tile_of("y"), F.lit(many).alias("g"), "x", "y", "request_id")
    )
    dealt = rows.repartition(4 * requests.sparkSession.sparkContext.defaultParallelism, "cx", "cy").sortWithinPartitions("cx", "cy", "g")
    return dealt.mapInArrow(find, f"request_id {kind.simpleString()}, grp string, ix int, iy int")


def cell_id() -> F.Column:
    """One long for a cell of a request and group, in the order of ix and iy."""
    grp = F.array_position(F.array(F.lit("market"), F.lit("pharmacy"), F.lit("school")), F.col("grp"))
    return ((F.col("request_id") * 4 + grp) * 4096 + (F.col("ix") + 512)) * 4096 + F.col("iy") + 512


def region_stats_within(blind: DataFrame) -> DataFrame:
    """Cells and spans of each region of cells that hang together by their sides; a region much longer than wide is a corridor.

    A request's disc bounds its cells, so a task closes whole requests in numpy. region is the smallest cell."""

    def measure(cell: np.ndarray, grp: np.ndarray, ix: np.ndarray, iy: np.ndarray) -> pa.RecordBatch:
        order, (east, north, _) = outline.neighbours(grp, ix, iy)
        cell, ix, iy = cell[order], ix[order], iy[order]
        root = graph.least_of_part(len(cell), [(np.flatnonzero(x >= 0), x[x >= 0]) for x in (east, north)])
        first, at = np.unique(root, return_inverse=True)
        low = lambda c: reduce_at(np.minimum, c, at, len(first))
        high = lambda c: reduce_at(np.maximum, c, at, len(first))
        columns = (cell[first], np.bincount(at, minlength=len(first)), high(ix) - low(ix) + 1, high(iy) - low(iy) + 1)
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["region", "cells", "span_x", "span_y"])

    ids = blind.select(cell_id().alias("cell"), F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"))
    rows = ids.select(F.shiftright("cell", 24).alias("grp"), "cell", "ix", "iy")
    sums = graph.by_group(rows, ["grp"], lambda grp, cell, ix, iy: measure(cell, grp, ix, iy), "region long, cells long, span_x long, span_y long")
    own = F.shiftright("region", 24)
    name = F.element_at(F.array(F.lit("market"), F.lit("pharmacy"), F.lit("school")), (own % 4).cast("int"))
    named = sums.select(F.shiftright(own, 2).alias("request_id"), name.alias("grp"), "region", "cells", F.col("span_x").cast("int").alias("span_x"), F.col("span_y").cast("int").alias("span_y"))
    aspect = F.greatest("span_x", "span_y") / F.least("span_x", "span_y")
    return named.withColumns({"aspect": F.round(aspect, 6), "corridor": aspect > C.CORRIDOR_ASPECT})


def reduce_at(how: np.ufunc, values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, values.max() if how is np.minimum else values.min())
    how.at(out, at, values)
    return out


def regions(blind: DataFrame) -> DataFrame:
    """blind with region, the smallest cell of the cells that hang together by their sides."""
    own = blind.withColumn("cell", cell_id())
    right = own.select("cell", (F.col("cell") + 4096).alias("next"))
    up = own.select("cell", (F.col("cell") + 1).alias("next"))
    pairs = right.unionByName(up)
    links = pairs.join(own.select(F.col("cell").alias("next")), "next").select(F.col("cell").alias("u"), F.col("next").alias("v"))
    roots = graph.components(links)
    return own.join(roots, own.cell == roots.node, "left").select("request_id", "grp", "ix", "iy", F.coalesce("root", "cell").alias("region"))


def parts(cells: DataFrame) -> DataFrame:
    """(grp, ix, iy) with part, which names the cells of a group that hang together by their sides."""
    own = cells.withColumn("node", F.xxhash64("grp", "ix", "iy"))
    beside = own.select("grp", F.explode(F.array(F.struct((F.col("ix") + 1).alias("ix"), "iy"), F.struct("ix", (F.col("iy") + 1).alias("iy")))).alias("c"), F.col("node").alias("v")).select("grp", "c.*", "v")
    links = own.join(beside, ["grp", "ix", "iy"]).select(F.col("node").alias("u"), "v")
    return own.join(graph.components(links), "node", "left").select("grp", "ix", "iy", F.coalesce("root", "node").alias("part"))


def region_stats(named: DataFrame) -> DataFrame:
    """Cells and spans of each region; a region much longer than wide is a corridor."""
    sums = named.groupBy("request_id", "grp", "region").agg(F.count("*").alias("cells"), (F.max("ix") - F.min("ix") + 1).alias("span_x"), (F.max("iy") - F.min("iy") + 1).alias("span_y"))
    aspect = F.greatest("span_x", "span_y") / F.least("span_x", "span_y")
    return sums.withColumns({"aspect": F.round(aspect, 6), "corridor": aspect > C.CORRIDOR_ASPECT})


def summary(blind: DataFrame, requests: DataFrame, total: int = C.BLIND_DISC_CELLS) -> DataFrame:
    """The share of each request's cells that are blind, by group; a group without any has none."""
    counts = blind.groupBy("request_id").agg(*(F.count_if(F.col("grp") == g).alias(g) for g in ("market", "pharmacy", "school")))
    share = lambda g: F.round(F.coalesce(F.col(g), F.lit(0)) / total, 6).alias(f"{g}_share")
    return requests.select("request_id").join(shuffled(counts), "request_id", "left").select("request_id", *map(share, ("market", "pharmacy", "school")))
