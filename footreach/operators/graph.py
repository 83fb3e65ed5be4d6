"""The walk graph: costs within a limit, layers, reachable edges, components, injected paths."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footreach.operators.spatial import shuffled


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/footreach-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df from a table in the shared folder: cuts lineage and outlives lost executors."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame) -> DataFrame:
    """An undirected edge list as arcs (u, v, w): the smallest weight of parallel edges, loops left out."""
    arcs = edges.select("u", "v", "w").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    return arcs.where("u <> v").groupBy("u", "v").agg(F.min("w").alias("w"))


def local_found(starts: np.ndarray, arcs: tuple[np.ndarray, np.ndarray, np.ndarray], cutoff: float, cells: int = 1 << 22) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, node, cost, edges) of all nodes within the cutoff of each start, by arcs (u, v, w), for some starts at a time. edges
    are those that count at the node: all whose other end is not reached, and those to a reached end that is larger.

    All starts relax together: a round takes every pair of start and node whose cost has just improved along its arcs, until
    none improves. `cells` bounds the table of starts by nodes. A start without arcs reaches itself."""
    u, v, w = arcs
    nodes = np.unique(np.concatenate([u, v, starts]))
    order = np.argsort(u, kind="stable")
    first = np.searchsorted(u[order], np.append(nodes, nodes[-1] + 1) if len(nodes) else nodes)
    to, weight = np.searchsorted(nodes, v[order]), w[order].astype(np.float64)
    size = len(nodes)
    for some in np.array_split(starts, max(1, -(-len(starts) * size // cells))):
        best = np.full(len(some) * size, np.inf)
        front = np.arange(len(some)) * size + np.searchsorted(nodes, some)
        best[front] = 0.0
        while len(front):
            at = front % size
            many = first[at + 1] - first[at]
            i = np.repeat(np.arange(len(front)), many)
            arc = np.arange(len(i)) + np.repeat(first[at] - (np.cumsum(many) - many), many)
            key, cost = (front - at)[i] + to[arc], best[front][i] + weight[arc]
            better = (cost <= cutoff) & (cost < best[key])
            key, cost = key[better], cost[better]
            np.minimum.at(best, key, cost)
            front = np.unique(key)
        found = np.flatnonzero(np.isfinite(best))
        at = found % size
        many = first[at + 1] - first[at]
        i = np.repeat(np.arange(len(found)), many)
        end = to[np.arange(len(i)) + np.repeat(first[at] - (np.cumsum(many) - many), many)]
        counts = np.isinf(best[(found - at)[i] + end]) | (end > at[i])
        yield some[found // size], nodes[at], best[found], np.bincount(i, counts, len(found)).astype(np.int64)


def local_costs(starts: np.ndarray, arcs: tuple[np.ndarray, np.ndarray, np.ndarray], cutoff: float, cells: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, node, cost) of local_found()."""
    for start, node, cost, _ in local_found(starts, arcs, cutoff, cells):
        yield start, node, cost


def costs_by_tiles(sources: DataFrame, arcs: DataFrame, nodes: DataFrame, cutoff: float, tile_m: float | None = None) -> DataFrame:
    """(request_id, nid, cost_s) by searches inside tiles. No task sees more of the graph than a tile and its margin."""
    return found_in_tiles(sources, arcs, nodes, cutoff, tile_m).select("request_id", "nid", "cost_s")


def found_in_tiles(sources: DataFrame, arcs: DataFrame, nodes: DataFrame, cutoff: float, tile_m: float | None = None, carry: tuple[str, ...] = (), edges: bool = False) -> DataFrame:
    """(request_id, nid, cost_s, edges, nx, ny) and columns of doubles that sources carry along, by searches inside tiles.

    What a search can reach lies no farther, straight, than the cutoff times the graph's largest speed. Each tile gets the
    arcs inside it and that far around it, so a source's search in its own tile is whole. If edges are asked for, the margin is
    wider by the longest arc, and their sum over a source's rows is the number of arcs, taken once for both ways, with an end
    that is reached. A tile is twice the margin wide unless told, which sends an arc to about four tiles; tiles without sources
    get nothing. Sources at one node share a search and go to its tile, so what is found needs no join to come back to them, and
    an aggregate by source is nearly done before it shuffles. nodes: (nid, x, y) in metres, of all ends of arcs and all sources."""
    place = lambda k: nodes.select(F.col("nid").alias(k), F.col("x").alias(f"x_{k}"), F.col("y").alias(f"y_{k}"))
    placed = arcs.join(shuffled(place("u")), "u").join(shuffled(place("v")), "v")
    metres = F.sqrt(F.pow(F.col("x_u") - F.col("x_v"), F.lit(2.0)) + F.pow(F.col("y_u") - F.col("y_v"), F.lit(2.0)))
    speed, longest = placed.agg(F.max(F.when(metres > 0, metres / F.col("w").cast("double"))), F.max(metres)).first()
    margin = cutoff * (speed or 0.0) * (1 + 1e-9) + 1.0 + (longest or 0.0) * edges  # a little more, as sums are rounded
    if not np.isfinite(margin):
        raise ValueError("an arc that takes no time has two ends: what it reaches has no bound")
    size = tile_m or 2 * margin
    tile = lambda c: F.floor(F.col(c) / size)
    starts = sources.select("request_id", "nid", *carry).join(shuffled(nodes.select("nid", F.col("x").alias("nx"), F.col("y").alias("ny"))), "nid").withColumns({"tx": tile("nx"), "ty": tile("ny")})
    # tiles whose margin holds both ends
    span = lambda c: F.explode(F.sequence(F.floor((F.greatest(f"{c}_u", f"{c}_v") - margin) / size), F.floor((F.least(f"{c}_u", f"{c}_v") + margin) / size)))
    inside = lambda c: F.greatest(f"{c}_u", f"{c}_v") - F.least(f"{c}_u", f"{c}_v") <= 2 * margin
    around = placed.where(inside("x") & inside("y")).withColumn("tx", span("x")).withColumn("ty", span("y"))
    around = around.join(shuffled(starts.select("tx", "ty").distinct()), ["tx", "ty"], "left_semi")
    more = ("nx", "ny", *carry)
    none = lambda kind, *names: (F.lit(None).cast(kind).alias(n) for n in names)
    kind = sources.schema["request_id"].dataType
    rows = around.select("tx", "ty", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w"), *none(kind, "request_id"), F.col("x_u").alias("nx"), F.col("y_u").alias("ny"), *none("double", *carry)).unionByName(
        starts.select("tx", "ty", F.col("nid").cast("long").alias("u"), *none("long", "v"), *none("double", "w"), "request_id", *(F.col(c).cast("double").alias(c) for c in more))
    )

    def answers(asked: pa.RecordBatch, arcs: tuple[np.ndarray, ...], where: tuple[np.ndarray, ...], room: int = 1 << 19) -> Iterator[pa.RecordBatch]:
        """What sources of one tile reach, whose rows are in the order of their nodes."""
        u = asked.column("u").to_numpy()
        for start, *found in local_found(np.unique(u), arcs, cutoff):
            own, first, many = np.unique(start, return_index=True, return_counts=True)
            low, high = np.searchsorted(u, own[0]), np.searchsorted(u, own[-1], side="right")
            k = np.searchsorted(own, u[low:high])
            ends = np.append(0, np.cumsum(many[k]))
            a = 0
            while a < high - low:
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + room, side="right")) - 1)
                n = many[k[a:b]]
                row = np.repeat(np.arange(a, b), n)
                at = np.arange(len(row)) + np.repeat(first[k[a:b]] - (np.cumsum(n) - n), n)
                source = pa.array(low + row)
                nid, cost, count = (c[at] for c in found)
                p = np.minimum(np.searchsorted(where[0], nid), max(0, len(where[0]) - 1))
                known = where[0][p] == nid if len(where[0]) else np.zeros(len(nid), bool)
                # a start without arcs has its own place
                place = [np.where(known, c[p] if len(c) else 0.0, asked.column(n).take(source).to_numpy()) for c, n in zip(where[1:], ("nx", "ny"), strict=True)]
                yield pa.RecordBatch.from_arrays([asked.column("request_id").take(source), *map(pa.array, (nid, cost, count, *place)), *(asked.column(c).take(source) for c in carry)], names=["request_id", "nid", "cost_s", "edges", *more])
                a = b

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by tile, arcs first, then sources (v null), of which a batch is held at once."""
        tile, parts, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            tx, ty, ends = (c.to_numpy(zero_copy_only=False) for c in (batch.column("tx"), batch.column("ty"), batch.column("v").is_null()))
            cuts = [0, *(np.flatnonzero((tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1]) | (ends[1:] != ends[:-1])) + 1).tolist(), len(tx)]
            for a, b in itertools.pairwise(cuts):
                if (own := (tx[a], ty[a])) != tile:
                    tile, ready = own, None
                    parts.clear()
                if not ends[a]:
                    parts.append(batch.slice(a, b - a))
                    continue
                if ready is None:
                    table = pa.Table.from_batches(parts, batch.schema)
                    u, v, w, x, y = (table.column(c).to_numpy() for c in ("u", "v", "w", "nx", "ny"))
                    names, first = np.unique(u, return_index=True)
                    ready = (u, v, w), (names, x[first], y[first])
                yield from answers(batch.slice(a, b - a), *ready)

    # a search takes far longer than its rows are long: tiles are spread by number
    dealt = rows.repartition(4 * sources.sparkSession.sparkContext.defaultParallelism, "tx", "ty").sortWithinPartitions("tx", "ty", F.col("v").asc_nulls_last(), "u")
    return dealt.mapInArrow(search, f"request_id {kind.simpleString()}, nid long, cost_s double, edges long, " + ", ".join(f"{c} double" for c in more))


def least_found(found: DataFrame) -> DataFrame:
    """(request_id, nid): the node of the least cost of each source, the smallest of equal ones. Batches keep one row for each source, and
    only those are shuffled and sorted."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, nid, cost = (c.to_numpy() for c in batch.columns)
            order = np.lexsort((nid, cost, own))
            first = order[np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])] if len(own) else order
            yield batch.take(pa.array(first))

    some = found.select(F.col("request_id").cast("long").alias("request_id"), "nid", F.col("cost_s").cast("double").alias("cost_s")).mapInArrow(least, "request_id long, nid long, cost_s double")
    return some.groupBy("request_id").agg(F.min_by("nid", F.struct("cost_s", "nid")).alias("nid"))


def costs_by_frontier(sources: DataFrame, arcs: DataFrame, cutoff: float, rounds: int = 10_000) -> DataFrame:
    """Rounds of relaxation as joins, for graphs of any size. A round settles what improved in the one before."""
    done = written(sources.select("request_id", "nid", F.lit(0.0).alias("cost_s")))
    front = done
    for _ in range(rounds):
        step = front.join(arcs.withColumnRenamed("u", "nid"), "nid").select("request_id", F.col("v").alias("nid"), (F.col("cost_s") + F.col("w")).alias("cost_s"))
        step = step.where(F.col("cost_s") <= cutoff).groupBy("request_id", "nid").agg(F.min("cost_s").alias("new"))
        better = step.join(done, ["request_id", "nid"], "left").where(F.col("cost_s").isNull() | (F.col("new") < F.col("cost_s")))
        front = written(better.select("request_id", "nid", F.col("new").alias("cost_s")))
        if not front.head(1):
            return done
        done = written(done.unionByName(front).groupBy("request_id", "nid").agg(F.min("cost_s").alias("cost_s")))
    raise RuntimeError(f"costs have not settled in {rounds} rounds")


def costs_within(sources: DataFrame, edges: DataFrame, cutoff: float, nodes: DataFrame | None = None) -> DataFrame:
    """(request_id, nid, cost_s) of all nodes within the cutoff of each source (request_id, nid); a node that has no
    row cannot be reached. With the nodes' places the graph is searched tile by tile, else in rounds of joins."""
    arcs = both_ways(edges)
    return costs_by_frontier(sources, written(arcs), cutoff) if nodes is None else costs_by_tiles(sources, arcs, nodes, cutoff)


def reachable_edges(costs: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, u, v, low) of edges with at least one end that is reached; low is the smaller cost."""
    ends = edges.select("u", "v", F.explode(F.array("u", "v")).alias("nid"))
    return ends.join(shuffled(costs), "nid").groupBy("request_id", "u", "v").agg(F.min("cost_s").alias("low"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) by alternating star steps; root is the smallest node that can be reached."""
    own = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(own)
    for _ in range(rounds):
        arcs = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = arcs.where("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(shuffled(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = written(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = mark(own)
        if now == before:
            stars = own.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        before = now
    raise RuntimeError(f"components have not settled in {rounds} rounds")


def by_group(rows: DataFrame, keys: list[str], each: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """each(*columns as arrays) over whole groups of rows, many at once: a task reads its rows by key and holds a batch and the
    group that it is in. For groups of a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []

        def join() -> list[np.ndarray]:
            return [np.concatenate(c) for c in zip(*rest, strict=True)]

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            own = columns[: len(keys)]
            last = int(np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in own]))[-1]) + 1 if any((k != k[-1]).any() for k in own) else 0
            if last:
                rest.append([c[:last] for c in columns])
                yield each(*join())
                rest.clear()
            elif rest and any(k[0] != r[-1] for k, r in zip(own, rest[-1], strict=False)):
                yield each(*join())
                rest.clear()
            rest.append([c[last:] for c in columns])
        if rest:
            yield each(*join())

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def least_of_part(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the least row that links lead to: rounds that take the smaller root along all links and halve paths."""
    a, b = (np.concatenate(c) for c in zip(*links, strict=True))
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
    return root


def chains(edges: DataFrame) -> DataFrame:
    """Edges after contraction: nodes of two edges of one kind are taken out, and a chain of them is one edge with the
    summed weight. A closed chain without another node keeps its smallest one."""
    ends = edges.select("u", "v", "w", "kind", F.explode(F.array("u", "v")).alias("nid"))
    inner = ends.groupBy("nid").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("kinds")).where("n = 2 and kinds = 1").select("nid")
    keyed = written(edges.withColumn("eid", F.xxhash64("u", "v", "w", "kind")))
    halves = keyed.select("eid", F.explode(F.array("u", "v")).alias("nid"))
    links = halves.join(inner, "nid").groupBy("nid").agg(F.min("eid").alias("u"), F.max("eid").alias("v")).select("u", "v")
    groups = components(links)
    named = keyed.join(groups, keyed.eid == groups.node, "left").withColumn("chain", F.coalesce("root", "eid"))
    outer = named.select("chain", "w", "kind", F.explode(F.array("u", "v")).alias("nid")).join(inner.withColumn("inside", F.lit(True)), "nid", "left")
    tips = outer.where("inside is null").groupBy("chain").agg(F.min("nid").alias("a"), F.max("nid").alias("b"))
    closed = outer.groupBy("chain").agg(F.min("nid").alias("least"))
    sums = named.groupBy("chain").agg(F.sum("w").alias("w"), F.count("*").alias("parts"), F.first("kind").alias("kind"))
    whole = sums.join(closed, "chain").join(tips, "chain", "left")
    return whole.select(F.coalesce("a", "least").alias("u"), F.coalesce("b", "least").alias("v"), "w", "kind", "parts")


def injected(edges: DataFrame, paths: DataFrame, factor: float = 1.0, speed: float = 70.0) -> DataFrame:
    """edges with those of paths (path_id, seq, x, y, nid): one for each step between different nodes, in seconds by the
    steps' metres. Parallel new edges become one, so that a second injection of the same path changes nothing."""
    from pyspark.sql import Window

    order = Window.partitionBy("path_id").orderBy("seq")
    steps = paths.select("*", F.lag("nid").over(order).alias("from"), F.sqrt(F.pow(F.col("x") - F.lag("x").over(order), F.lit(2.0)) + F.pow(F.col("y") - F.lag("y").over(order), F.lit(2.0))).alias("metres"))
    new = steps.where((F.col("from") != F.col("nid")) & (F.col("metres") >= 0.5)).select(F.least("from", "nid").alias("u"), F.greatest("from", "nid").alias("v"), (F.col("metres") / speed * 60 * factor).alias("w"))
    once = new.groupBy("u", "v").agg(F.min("w").alias("w"))
    return edges.select("u", "v", F.col("w").cast("double").alias("w"), F.lit("street").alias("source")).unionByName(once.withColumn("source", F.lit("path")))


