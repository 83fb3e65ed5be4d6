"""Places: cleaning, walking minutes, merging of duplicates, ranking and caps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footreach import config as C
from footreach.functions import text as T
from footreach.operators.graph import written
from footreach.operators.spatial import cells, radius_join, shuffled, spread, squared


def cleaned(pois: DataFrame) -> DataFrame:
    """Known categories without noise, one row for each uid of a category (the first in seq), with cat_total and the traits
    of ranked_traits(), as a written table, since it is read again for each use. A place without uid goes if one of its category and name that was kept before is within 30 m."""
    known = pois.where(F.col("category").isin(*C.CATEGORIES) & ~T.is_noise(F.col("category"), F.col("name"), F.col("tag")))
    key = F.coalesce(F.concat(F.lit("u:"), "uid"), F.concat(F.lit("s:"), F.col("seq").cast("string")))
    first = Window.partitionBy("category", "__key").orderBy("seq")
    # small beside the pairs, and read by each side of the joins below
    once = written(known.withColumn("__key", key).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__key"))
    own = once.select(F.col("id").alias("rid"), "category", "name", "seq", "x", "y", F.col("uid").isNotNull().alias("firm"))
    kept = greedy_apart(own, ["category", "name"], ["seq"], C.UID_MERGE_M, firm="firm").select(F.col("rid").alias("id"))
    once = written(once.join(shuffled(kept), "id", "left_semi"))
    totals = once.groupBy("category").agg(F.count("*").cast("int").alias("cat_total"))
    return written(ranked_traits(once.join(totals, "category")))


def greedy_apart(rows: DataFrame, keys: list[str], order: list[str], radius: float, rounds: int = 100_000, firm: str | None = None) -> DataFrame:
    """Of the rows (rid, x, y) of a group, in order, those that are not within the radius of one that was kept before; rows
    that are firm stay whatever is near.

    A pair that is near makes the later row depend on the earlier one. A row without such an earlier row stays; what
    is near a row that stays goes; and so on in rounds over the pairs still open, as joins, so that no group has to be
    held by one task. The number of rounds is that of the longest chain; beyond `rounds` an error is raised."""
    other = rows.select(*keys, *(F.col(c).alias(f"{c}2") for c in ("rid", *order, "x", "y")))
    before = F.struct(*(F.col(f"{c}2") for c in (*order, "rid"))) < F.struct(*(F.col(c) for c in (*order, "rid")))
    same = [*keys, "cx", "cy"]
    loose = rows if firm is None else rows.where(~F.col(firm))
    pairs = cells(loose, "x", "y", radius, 1).join(shuffled(cells(other, "x2", "y2", radius)), same).where(before & (F.sqrt(squared(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))) < radius))
    near = written(pairs.select("rid", "rid2"))
    gone: list[DataFrame] = []
    for _ in range(rounds):
        if not near.head(1):
            break
        # an earlier row that depends on none any more stays, and what is near it goes
        free = near.join(shuffled(near.select(F.col("rid").alias("rid2")).distinct()), "rid2", "left_anti")
        new = written(free.select("rid").distinct())
        gone.append(new)
        if len(gone) == 32:
            gone = [written(reduce(DataFrame.unionByName, gone))]
        near = written(near.join(shuffled(new), "rid", "left_anti").join(shuffled(new.withColumnRenamed("rid", "rid2")), "rid2", "left_anti"))
    else:
        raise RuntimeError(f"a chain of near rows is longer than {rounds}")
    return rows.join(shuffled(reduce(DataFrame.unionByName, gone)), "rid", "left_anti") if gone else rows


def apart_in_order(rows: DataFrame, keys: list[str], order: list[str], radius: float, x: str = "x2", y: str = "y2") -> DataFrame:
    """Like greedy_apart(), for groups that lie within one walk: a task reads each group in order and remembers only what it
    keeps, of which as much as a walk's area has room for, radius apart. The radius itself counts as near."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, []
        for batch in batches:
            stays = []
            for own, px, py in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column(x).to_pylist(), batch.column(y).to_pylist(), strict=True):
                if own != group:
                    group, kept = own, []
                stays.append(all((px - a) ** 2 + (py - b) ** 2 > radius * radius for a, b in kept))
                if stays[-1]:
                    kept.append((px, py))
            yield batch.filter(pa.array(stays, pa.bool_()))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(keep, rows.schema)


def walk_minutes(pairs: DataFrame, costs: DataFrame, nodes: DataFrame, radius: float = C.EDGE_ACCESS_M, estimate_speed: float = C.WALK_SPEED, faces: DataFrame | None = None, face_nodes: DataFrame | None = None) -> DataFrame:
    """pairs (start, id, x2, y2, d, ...) with raw_min, estimated, edge_arrival and shown_min.

    raw_min is the least of a node's cost and the straight rest of the way, over nodes within the radius of the place and,
    for a place in a green face, within the radius of that face; it is null where no such node can be reached, and then
    only shown_min has a figure, by the straight way. edge_arrival tells places that are reached at a face's edge or by a
    last leg above the snapping distance. costs: (start, nid, cost_s); faces: (id, face); face_nodes: (face, nid, leg).
    Requests that begin at one node share their minutes, so they are worked out once for each start and place or face."""
    places = pairs.select("id", "x2", "y2").distinct()
    near = radius_join(places, nodes.select("nid", F.col("x").alias("nx"), F.col("y").alias("ny")), radius, ("x2", "y2"), ("nx", "ny")).select("id", "nid", F.col("d").alias("leg"))
    total = F.col("cost_s") / 60 + F.col("leg") / estimate_speed
    snapped = F.col("leg") <= C.SNAP_MAX_M
    by_node = spread(near, "nid").join(shuffled(spread(costs, "nid")), "nid").groupBy("start", "id").agg(F.min(F.when(snapped, total)).alias("near_min"), F.min(F.when(~snapped, total)).alias("far_min"))
    # read several times by what follows, and small beside the pairs it is made from
    out = pairs.join(shuffled(written(by_node)), ["start", "id"], "left")
    if faces is None:
        out = out.withColumn("face_min", F.lit(None).cast("double"))
    else:
        by_face = face_nodes.join(shuffled(costs), "nid").groupBy("start", "face").agg(F.min(total).alias("face_min"))
        out = out.join(faces.select("id", "face"), "id", "left").join(shuffled(by_face), ["start", "face"], "left").drop("face")
    raw = F.least("near_min", "far_min", "face_min")
    late = F.least("far_min", "face_min")
    return out.withColumns({
        "raw_min": raw, "estimated": raw.isNull(), "edge_arrival": F.coalesce(late < F.col("near_min"), late.isNotNull()), "shown_min": F.coalesce(raw, F.col("d") / estimate_speed),
    }).drop("near_min", "far_min", "face_min")


def calibrated(views: DataFrame, measured: DataFrame) -> DataFrame:
    """views with measured minutes (request_id, id, measured_min) in place of their own, but not where an edge was reached:
    who measures walks on to the place inside."""
    use = F.col("measured_min").isNotNull() & ~F.col("edge_arrival")
    fixed = views.join(shuffled(measured.select("request_id", "id", "measured_min")), ["request_id", "id"], "left")
    take = lambda c, other: F.when(use, other).otherwise(F.col(c))
    return fixed.withColumns({"raw_min": take("raw_min", F.col("measured_min")), "shown_min": take("shown_min", F.col("measured_min")), "estimated": take("estimated", F.lit(False))}).drop("measured_min")


def merge_key(category: Column, name: Column, kind: Column, rid: Column) -> Column:
    """What places of a request count as one: stations by base name and kind, public places by base name, others not."""
    return (
        F.when(category == "transport", F.concat_ws("|", T.station_base(name), F.coalesce(kind, F.lit("bus"))))
        .when(category == "public", T.park_base(name))
        .otherwise(rid.cast("string"))
    )


MERGED = ("transport", "public")


def ranked_traits(places: DataFrame) -> DataFrame:
    """places with what their order depends on besides minutes, worked out once for each place: merge (the smallest id
    that counts as the same), lead (stage, kind or core) and closed."""
    closed = F.col("name").contains(T.CLOSED).cast("int")
    lead = (
        F.when(F.col("category") == "education", T.edu_stage(F.col("edu_kind"), F.col("name")))
        .when(F.col("category") == "transport", (F.coalesce("transport_kind", F.lit("bus")) != "metro").cast("int"))
        .when(F.col("category") == "public", (~F.col("name").rlike(T.PUBLIC_CORE)).cast("int"))
        .otherwise(F.lit(0))
    )
    own = places.withColumns({"lead": lead, "closed": closed, "__key": merge_key(F.col("category"), F.col("name"), F.col("transport_kind"), F.col("id"))})
    same = own.where(F.col("category").isin(*MERGED)).groupBy("category", "__key").agg(F.min("id").alias("merge"))
    return crowded(own.join(shuffled(same), ["category", "__key"], "left").withColumn("merge", F.coalesce("merge", "id")).drop("__key"))


def crowded(places: DataFrame, radius: float = C.HEALTH_MERGE_M) -> DataFrame:
    """places with clinic: the base name of a health place that has another one of that base name within the radius, else
    null. Only those can be one clinic's departments."""
    own = places.where("category = 'health'").select("id", "x", "y", T.clinic_base(F.col("name")).alias("base"))
    other = own.select("base", F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = (F.col("id") != F.col("id2")) & (squared(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")) <= radius * radius)
    some = cells(own, "x", "y", radius, 1).join(shuffled(cells(other, "x2", "y2", radius)), ["base", "cx", "cy"]).where(near).select("id", F.col("base").alias("clinic")).distinct()
    return places.join(shuffled(some), "id", "left")


def selected(views: DataFrame, cap: int = C.CAP_PER_CATEGORY) -> DataFrame:
    """Places within the minutes, merged, ranked by category and cut at the cap; within_total counts before the cut.

    views: request_id, minutes, category, id, seq, raw_min, x2, y2 and the traits; raw_min null is not within. Stations and
    public places of one merge key count once, and so do a clinic's departments within 200 m of one that is kept: always
    the first by minutes, open ones before closed ones. The pairs are worked out and shuffled once. Schools are in stages and then open ones first; metro stops and
    core public places lead; minutes come before closed for all but schools."""
    some, clinic = F.col("category").isin(*MERGED), F.col("clinic")
    order = ["raw_min", "closed", "seq"]
    # a request's rows lie within one walk; they are dealt once, and every window below stays inside a request
    within = views.where(F.col("raw_min") <= F.col("minutes")).withColumn("__same", F.when(clinic.isNull(), F.when(some, F.col("merge")).otherwise(F.col("id")))).repartition("request_id")
    same = Window.partitionBy("request_id", "category", "clinic", "__same").orderBy(*order)
    group = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    departments = F.collect_list(F.when(clinic.isNotNull(), F.struct("id", "x2", "y2")))
    rows = within.withColumns({"__n": F.row_number().over(same), "__own": departments.over(group)})
    # departments are read in order once for each clinic, at its first row
    rows = rows.withColumn("__kept", F.when((F.col("__n") == 1) & clinic.isNotNull(), apart(F.col("__own"), C.HEALTH_MERGE_M))).drop("__own").withColumn("__kept", F.first("__kept").over(group))
    stays = F.when(clinic.isNotNull(), F.array_contains("__kept", F.col("id"))).otherwise(~some | (F.col("__n") == 1))
    merged = rows.where(stays).drop("__same", "__n", "__kept")
    schools = F.when(F.col("category") == "education", F.col("closed")).otherwise(0)
    shown = Window.partitionBy("request_id", "category").orderBy("lead", schools, *order)
    total = F.count("*").over(shown.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("int")
    return merged.withColumns({"rank": F.row_number().over(shown), "within_total": total}).where(F.col("rank") <= cap)


def apart(places: Column, radius: float) -> Column:
    """The ids of the places (array of structs id, x2, y2, in order) that are farther than the radius from all kept before."""
    near = lambda a, b: squared(a["x2"], a["y2"], b["x2"], b["y2"]) <= radius * radius
    keep = lambda kept, p: F.when(F.exists(kept, lambda k: near(k, p)), kept).otherwise(F.concat(kept, F.array(p)))
    # an empty array of the places' own type
    return F.transform(F.aggregate(places, F.slice(places, 1, 0), keep), lambda k: k["id"])


def nearest_in_category(pairs: DataFrame, n: int = 20) -> DataFrame:
    """The n nearest places of each request and category by straight line, with their rank."""
    order = Window.partitionBy("request_id", "category").orderBy("d", "seq")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
