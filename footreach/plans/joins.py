"""Queries over spatial and text joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footreach import config as C
from footreach.functions import geo, text
from footreach.operators import spatial as S
from footreach.plans.registry import query
from footreach.plans.scalar import GROUP_SQL, WS, r6
from footreach.sources import derived as D
from footreach.sources.derived import with_sql

DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def as2(df: DataFrame, **more: str) -> DataFrame:
    """df with its place as (x2, y2) and other columns under the given names."""
    return df.select(*(F.col(c).alias(n) for n, c in more.items()), F.col("x").alias("x2"), F.col("y").alias("y2"))


@query(with_sql("request poi", f" SELECT request_id, p.id, round({DIST}, 3) AS d FROM request a JOIN poi b ON {DIST} <= 500 JOIN (SELECT id FROM poi) p ON p.id = b.id"))
def radius_join(spark, sf_dir):
    pairs = S.radius_join(D.request(spark, sf_dir).select("request_id", "x", "y"), as2(D.poi(spark, sf_dir), id="id"), 500.0)
    return pairs.select("request_id", "id", F.round("d", 3).alias("d"))


@query(with_sql("request lattice_node", f" SELECT request_id, nid, round(d, 3) AS d FROM (SELECT request_id, nid, {DIST} AS d, row_number() OVER (PARTITION BY request_id ORDER BY {DIST}, nid) AS k FROM request a JOIN lattice_node b ON {DIST} <= 90) WHERE k = 1"))
def snap(spark, sf_dir):
    """The nearest node within 90 m of each request; the smaller id of equally near ones."""
    pairs = S.radius_join(D.request(spark, sf_dir).select("request_id", "x", "y"), as2(D.lattice_nodes(spark, sf_dir), nid="nid"), 90.0)
    return S.nearest(pairs, "request_id", [F.col("d"), F.col("nid")], ["nid", "d"]).select("request_id", "nid", F.round("d", 3).alias("d"))


@query(with_sql("request hub", f" SELECT request_id, arg_min(b.id, [{DIST}, b.id]) AS id, round(min({DIST}), 3) AS d FROM request a, hub b GROUP BY request_id"))
def nearest_any(spark, sf_dir):
    """The nearest hub, however far."""
    own = D.request(spark, sf_dir).select("request_id", "x", "y")
    found = S.nearest_unbounded(own, as2(D.hub(spark, sf_dir), id="id"), "request_id", ["id", "d"], [F.col("d"), F.col("id")], 800.0)
    return found.select("request_id", "id", F.round("d", 3).alias("d"))


@query(with_sql("request community", f" SELECT request_id, id, round(d, 3) AS d FROM (SELECT request_id, b.id, {DIST} AS d, row_number() OVER (PARTITION BY request_id ORDER BY {DIST}, b.id) AS k FROM request a JOIN community b ON {DIST} < 500 AND a.request_id <> b.id) WHERE k = 1"))
def nearest_within(spark, sf_dir):
    """The nearest other community within 500 m."""
    pairs = S.radius_join(D.request(spark, sf_dir).select("request_id", "x", "y"), as2(D.community(spark, sf_dir), id="id"), C.COMMUNITY_RADIUS_M).where("d < 500 and id <> request_id")
    return S.nearest(pairs, "request_id", [F.col("d"), F.col("id")], ["id", "d"]).select("request_id", "id", F.round("d", 3).alias("d"))


@query(with_sql("request community", f" SELECT request_id, b.id, CAST(round({DIST}) AS BIGINT) AS metres, CAST(row_number() OVER (PARTITION BY request_id ORDER BY {DIST}, b.id) AS INTEGER) AS place FROM request a JOIN community b ON {DIST} <= greatest(100, least(5000, request_id % 900))"))
def nearby(spark, sf_dir):
    """All communities within each request's own radius (clamped), nearest first."""
    radius = F.greatest(F.lit(100), F.least(F.lit(5000), F.col("request_id") % 900))
    pairs = S.radius_join(D.request(spark, sf_dir).select("request_id", "x", "y"), as2(D.community(spark, sf_dir), id="id"), 900.0).where(F.col("d") <= radius)
    return pairs.select("request_id", "id", F.round("d").cast("long").alias("metres"), F.row_number().over(Window.partitionBy("request_id").orderBy("d", "id")).alias("place"))


BOXES_SQL = "SELECT n_nationkey AS box, (n_nationkey * 977 % 6000) * CAST({kx!r} AS DOUBLE) AS x0, (n_nationkey * 1543 % 4300) * CAST({ky!r} AS DOUBLE) AS y0, n_nationkey AS k FROM nation".format(kx=D.KX, ky=D.KY)
BOXES_SQL = f"SELECT *, x0 + (200 + 20 * k) * CAST({D.KX!r} AS DOUBLE) AS x1, y0 + (100 + 25 * k) * CAST({D.KY!r} AS DOUBLE) AS y1 FROM ({BOXES_SQL})"


def boxes(spark, sf_dir) -> DataFrame:
    """Faces: a box for each nation."""
    k = F.col("n_nationkey")
    out = D.table(spark, sf_dir, "nation").select(k.alias("box"), ((k * 977 % 6000) * D.KX).alias("x0"), ((k * 1543 % 4300) * D.KY).alias("y0"), k.alias("k"))
    return out.withColumns({"x1": F.col("x0") + (200 + 20 * F.col("k")) * D.KX, "y1": F.col("y0") + (100 + 25 * F.col("k")) * D.KY})


@query(with_sql("poi", f", box AS ({BOXES_SQL}) SELECT id FROM poi WHERE EXISTS (SELECT 1 FROM box WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)"))
def bbox_semi_join(spark, sf_dir):
    return S.bbox_join(D.poi(spark, sf_dir).select("id", "x", "y"), boxes(spark, sf_dir), 400.0, "left_semi").select("id")


@query(with_sql("poi", f", box AS ({BOXES_SQL}) SELECT id, box FROM (SELECT id, box, row_number() OVER (PARTITION BY id ORDER BY box) AS n FROM poi JOIN box ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) WHERE n = 1"))
def pip_join(spark, sf_dir):
    """The first face that holds each point, borders included."""
    pairs = S.bbox_join(D.poi(spark, sf_dir).select("id", "x", "y"), boxes(spark, sf_dir), 400.0)
    return pairs.groupBy("id").agg(F.min("box").alias("box"))


@query(with_sql("request poi", f" SELECT request_id, id, round(b.x - a.x, 3) AS dx, round(b.y - a.y, 3) AS dy FROM request a JOIN poi b ON abs(a.x - b.x) <= 300 AND abs(a.y - b.y) <= 300"))
def clip_bbox(spark, sf_dir):
    """The places in a square window around each request, moved so that the request is the origin."""
    pairs = S.cells(D.request(spark, sf_dir).select("request_id", "x", "y"), "x", "y", 300.0, 1).join(S.shuffled(S.cells(as2(D.poi(spark, sf_dir), id="id"), "x2", "y2", 300.0)), ["cx", "cy"])
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    return pairs.where((F.abs(dx) <= 300) & (F.abs(dy) <= 300)).select("request_id", "id", F.round(dx, 3).alias("dx"), F.round(dy, 3).alias("dy"))


# Segments of the lattice against walls, water and rail.

SEG_SQL = ", seg AS (SELECT u, v, kind, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM lattice_edge JOIN lattice_node a ON a.nid = u JOIN lattice_node b ON b.nid = v)"
HITS = "greatest(x1, x2) >= bx0 AND least(x1, x2) <= bx1 AND greatest(y1, y2) >= by0 AND least(y1, y2) <= by1"


def segments(spark, sf_dir) -> DataFrame:
    nodes = D.lattice_nodes(spark, sf_dir)
    end = lambda n, k: nodes.select(F.col("nid").alias(n), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    return D.lattice_edges(spark, sf_dir).select("u", "v", "kind").join(S.shuffled(end("u", 1)), "u").join(S.shuffled(end("v", 2)), "v")


def without_hits(segs: DataFrame, walls: DataFrame, size: float) -> DataFrame:
    """Segments that touch no box: the boxes go to all their cells, the segments to all of theirs, then an anti join."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long")))
    spread = walls.select(*(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1"))).withColumn("cx", span(F.col("bx0"), F.col("bx1"))).withColumn("cy", span(F.col("by0"), F.col("by1")))
    own = segs.withColumn("cx", span(F.least("x1", "x2"), F.greatest("x1", "x2"))).withColumn("cy", span(F.least("y1", "y2"), F.greatest("y1", "y2")))
    hit = own.join(spread, ["cx", "cy"]).where(S.segment_hits_box(*map(F.col, ("x1", "y1", "x2", "y2", "bx0", "by0", "bx1", "by1")))).select("u", "v").distinct()
    return segs.join(hit, ["u", "v"], "left_anti")


@query(with_sql("lattice_node lattice_edge", f"{SEG_SQL}, box AS (SELECT x0 AS bx0, y0 AS by0, x1 AS bx1, y1 AS by1 FROM ({BOXES_SQL})) SELECT u, v FROM seg WHERE NOT EXISTS (SELECT 1 FROM box WHERE {HITS})"))
def anti_walls(spark, sf_dir):
    """Streets that touch no wall; bridges are no exception."""
    return without_hits(segments(spark, sf_dir), boxes(spark, sf_dir), 400.0).select("u", "v")


@query(with_sql("lattice_node lattice_edge", f"{SEG_SQL}, box AS (SELECT x0 AS bx0, y0 AS by0, x1 AS bx1, y1 AS by1 FROM ({BOXES_SQL}) WHERE box % 2 = 0) SELECT u, v FROM seg WHERE kind = 'bridge' OR NOT EXISTS (SELECT 1 FROM box WHERE {HITS})"))
def anti_water(spark, sf_dir):
    """Streets that touch no water, and bridges."""
    segs, water = segments(spark, sf_dir), boxes(spark, sf_dir).where("box % 2 = 0")
    return without_hits(segs.where("kind <> 'bridge'"), water, 400.0).unionByName(segs.where("kind = 'bridge'")).select("u", "v")


RAIL_SQL = f", rail AS (SELECT r_regionkey AS rail, (r_regionkey * 1300 + 120) * CAST({D.KX!r} AS DOUBLE) AS cx1, 0.0::DOUBLE AS cy1, (r_regionkey * 1300 + 330) * CAST({D.KX!r} AS DOUBLE) AS cx2, 5000 * CAST({D.KY!r} AS DOUBLE) AS cy2 FROM region)"


def side_sql(a, b, c) -> str:
    return f"sign(({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"


A_, B_, C_, D_ = ("x1", "y1"), ("x2", "y2"), ("cx1", "cy1"), ("cx2", "cy2")
CROSS = f"{side_sql(A_, B_, C_)} * {side_sql(A_, B_, D_)} < 0 AND {side_sql(C_, D_, A_)} * {side_sql(C_, D_, B_)} < 0"


def rails(spark, sf_dir) -> DataFrame:
    k = F.col("r_regionkey")
    return D.table(spark, sf_dir, "region").select(k.alias("rail"), ((k * 1300 + 120) * D.KX).alias("cx1"), F.lit(0.0).alias("cy1"), ((k * 1300 + 330) * D.KX).alias("cx2"), F.lit(5000 * D.KY).alias("cy2"))


def crossings(segs: DataFrame, lines: DataFrame, size: float = 500.0) -> DataFrame:
    """Pairs of segments and lines that cross, by the cells of their boxes; each pair once for each shared cell."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / size).cast("long"), F.floor(F.greatest(a, b) / size).cast("long")))
    own = segs.withColumn("cx", span("x1", "x2")).withColumn("cy", span("y1", "y2"))
    other = lines.withColumn("cx", span("cx1", "cx2")).withColumn("cy", span("cy1", "cy2"))
    return own.join(other, ["cx", "cy"]).where(S.segments_cross(*map(F.col, ("x1", "y1", "x2", "y2", "cx1", "cy1", "cx2", "cy2"))))


@query(with_sql("lattice_node lattice_edge", f"{SEG_SQL}{RAIL_SQL} SELECT u, v FROM seg WHERE kind = 'bridge' OR NOT EXISTS (SELECT 1 FROM rail WHERE {CROSS})"))
def anti_barrier(spark, sf_dir):
    """Streets that do not cross a rail line; touching it with an end is allowed, and so are bridges."""
    segs = segments(spark, sf_dir)
    hit = crossings(segs, rails(spark, sf_dir)).where("kind <> 'bridge'").select("u", "v").distinct()
    return segs.join(hit, ["u", "v"], "left_anti").select("u", "v")


@query(
    with_sql("lattice_node lattice_edge", f"{SEG_SQL}{RAIL_SQL}, hit AS (SELECT u, v, rail, (({C_[0]} - x1) * (cy2 - cy1) - (cy1 - y1) * (cx2 - cx1)) / ((x2 - x1) * (cy2 - cy1) - (y2 - y1) * (cx2 - cx1)) AS t FROM seg, rail WHERE {CROSS}) "
    "SELECT u, v, count(*) AS parts, round(max(t), 6) AS last FROM (SELECT u, v, t FROM hit UNION ALL SELECT u, v, 0.0 FROM seg) GROUP BY u, v")
)
def noding(spark, sf_dir):
    """Crossing points put into the streets, by mileage: the number of parts of each street and its last cut."""
    segs = segments(spark, sf_dir)
    num = (F.col("cx1") - F.col("x1")) * (F.col("cy2") - F.col("cy1")) - (F.col("cy1") - F.col("y1")) * (F.col("cx2") - F.col("cx1"))
    den = (F.col("x2") - F.col("x1")) * (F.col("cy2") - F.col("cy1")) - (F.col("y2") - F.col("y1")) * (F.col("cx2") - F.col("cx1"))
    cuts = crossings(segs, rails(spark, sf_dir)).select("u", "v", "rail", (num / den).alias("t")).dropDuplicates(["u", "v", "rail"])
    marks = cuts.select("u", "v", "t").unionByName(segs.select("u", "v", F.lit(0.0).alias("t")))
    return marks.groupBy("u", "v").agg(F.count("*").alias("parts"), r6(F.max("t")).alias("last"))


BOXD = "sqrt(pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2))"


def near_boxes(points: DataFrame, faces: DataFrame, radius: float) -> DataFrame:
    """Pairs of points and faces at most `radius` apart, with d."""
    wide = faces.select("box", *(F.col(c).alias(f"{c}_") for c in ("x0", "y0", "x1", "y1")), (F.col("x0") - radius).alias("x0"), (F.col("y0") - radius).alias("y0"), (F.col("x1") + radius).alias("x1"), (F.col("y1") + radius).alias("y1"))
    pairs = S.bbox_join(points, wide, 400.0)
    return pairs.withColumn("d", S.box_distance(*map(F.col, ("x", "y", "x0_", "y0_", "x1_", "y1_")))).where(F.col("d") <= radius)


@query(with_sql("lattice_node", f", box AS ({BOXES_SQL}) SELECT nid, box, round({BOXD}, 3) AS d FROM lattice_node, box WHERE {BOXD} <= 250"))
def dwithin_poly(spark, sf_dir):
    return near_boxes(D.lattice_nodes(spark, sf_dir).select("nid", "x", "y"), boxes(spark, sf_dir), C.AREA_LEG_M).select("nid", "box", F.round("d", 3).alias("d"))


@query(with_sql("lattice_node", f", box AS ({BOXES_SQL}) SELECT box, count(*) AS nodes, min(nid) AS first FROM lattice_node, box WHERE {BOXD} <= 30 GROUP BY box"))
def near_nodes(spark, sf_dir):
    """The nodes within 30 m of each building."""
    return near_boxes(D.lattice_nodes(spark, sf_dir).select("nid", "x", "y"), boxes(spark, sf_dir), 30.0).groupBy("box").agg(F.count("*").alias("nodes"), F.min("nid").alias("first"))


@query(with_sql("poi", f", box AS ({BOXES_SQL}) SELECT id, arg_max(box, [(x1 - x0) * (y1 - y0), -box]) AS box FROM poi, box WHERE category = 'public' AND {BOXD} <= 60 GROUP BY id"))
def attach_face(spark, sf_dir):
    """The largest green face within 60 m of each public place."""
    pairs = near_boxes(D.poi(spark, sf_dir).where("category = 'public'").select("id", "x", "y"), boxes(spark, sf_dir), C.AREA_ATTACH_M)
    area = (F.col("x1_") - F.col("x0_")) * (F.col("y1_") - F.col("y0_"))
    return pairs.groupBy("id").agg(F.max_by("box", F.struct(area.alias("a"), (-F.col("box")).alias("b"))).alias("box"))


@query(with_sql("poi", " SELECT id, CASE WHEN id % 2 = 0 AND m IS NOT NULL THEN m ELSE id % 37 END AS minutes, id % 2 = 0 AND m IS NOT NULL AS measured FROM poi LEFT JOIN (SELECT l_partkey, CAST(min(l_quantity) AS BIGINT) AS m FROM lineitem WHERE l_quantity > 5 GROUP BY 1) ON l_partkey = id"))
def calibrate(spark, sf_dir):
    """Measured minutes take the place of computed ones, but not where only a face's edge was reached."""
    measured = D.table(spark, sf_dir, "lineitem").where("l_quantity > 5").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_quantity").cast("long").alias("m"))
    own = D.poi(spark, sf_dir).select("id").join(measured, "id", "left")
    use = (F.col("id") % 2 == 0) & F.col("m").isNotNull()
    return own.select("id", F.when(use, F.col("m")).otherwise(F.col("id") % 37).alias("minutes"), use.alias("measured"))


PLACES_SQL = f"SELECT id, x, y, {GROUP_SQL} AS grp FROM poi_spread"
GRID_SQL = ", grid AS (SELECT request_id, ix, iy, x + ix * 100 AS px, y + iy * 100 AS py FROM request_spread, range(-10, 11) a(ix), range(-10, 11) b(iy) WHERE ix * ix + iy * iy <= 100)"
# kilometre squares keep the anti join from comparing every cell with every place
BLIND_SQL = (
    f"{GRID_SQL}, places AS ({PLACES_SQL}), around AS (SELECT grp, x, y, floor(x / 1000) + a AS kx, floor(y / 1000) + b AS ky FROM places, range(-1, 2) r(a), range(-1, 2) t(b)), "
    "asked AS (SELECT *, floor(px / 1000) AS kx, floor(py / 1000) AS ky FROM grid, (VALUES ('market'), ('pharmacy'), ('school')) g(grp)), "
    "blind AS (SELECT request_id, grp, ix, iy FROM asked q WHERE NOT EXISTS (SELECT 1 FROM around p WHERE p.grp = q.grp AND p.kx = q.kx AND p.ky = q.ky AND (px - p.x) * (px - p.x) + (py - p.y) * (py - p.y) <= 1000000))"
)


def blind_requests(spark, sf_dir) -> DataFrame:
    return D.request(spark, sf_dir, spread=True).select("request_id", "x", "y")


def blind(spark, sf_dir) -> DataFrame:
    from footreach.operators import blind as B

    places = D.poi(spark, sf_dir, spread=True).select(text.blind_group(F.col("category"), F.col("name")).alias("grp"), F.col("x").alias("x2"), F.col("y").alias("y2")).where("grp is not null")
    return B.blind_discs(blind_requests(spark, sf_dir), places, ["market", "pharmacy", "school"])


@query(with_sql("request_spread poi_spread", BLIND_SQL + " SELECT request_id, grp, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy FROM blind"))
def blind_cells(spark, sf_dir):
    return blind(spark, sf_dir)


@query(with_sql("request_spread poi_spread", BLIND_SQL + ", n AS (SELECT request_id, grp, count(*) AS n FROM blind GROUP BY 1, 2) SELECT request_id, " + ", ".join(f"round(coalesce(max(n) FILTER (grp = '{g}'), 0) / {C.BLIND_DISC_CELLS}::DOUBLE, 6) AS {g}_share" for g in ("market", "pharmacy", "school")) + " FROM request_spread LEFT JOIN n USING (request_id) GROUP BY request_id"))
def blind_summary(spark, sf_dir):
    from footreach.operators import blind as B

    return B.summary(blind(spark, sf_dir), blind_requests(spark, sf_dir))


# Names.

LOOK_SQL = (
    f", ask AS (SELECT s_suppkey AS ask, CASE WHEN s_suppkey % 3 = 0 THEN 'Customer#' || lpad((s_suppkey * 7 % 2000)::VARCHAR, 9, '0') WHEN s_suppkey % 3 = 1 THEN 'omer#' || lpad((s_suppkey * 11 % 2000)::VARCHAR, 9, '0') ELSE '# ' END AS name FROM supplier), "
    f"c AS (SELECT id, translate(regexp_replace(lower(name), '{WS}', '', 'g'), '{text.DROPPED}', '') AS norm FROM community), q AS (SELECT ask, translate(regexp_replace(lower(name), '{WS}', '', 'g'), '{text.DROPPED}', '') AS norm FROM ask), "
    "m AS (SELECT ask, id, CASE WHEN q.norm = c.norm THEN 1 ELSE 2 END AS tier FROM q JOIN c ON q.norm = c.norm OR (length(q.norm) >= 4 AND length(c.norm) >= 4 AND (contains(q.norm, c.norm) OR contains(c.norm, q.norm))))"
)


def asked_names(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    number = lambda f: F.lpad((k * f % 2000).cast("string"), 9, "0")
    name = F.when(k % 3 == 0, F.concat(F.lit("Customer#"), number(7))).when(k % 3 == 1, F.concat(F.lit("omer#"), number(11))).otherwise("# ")
    return D.table(spark, sf_dir, "supplier").select(k.alias("ask"), text.name_norm(name).alias("norm"))


def contained(left: DataFrame, right: DataFrame, least: int = 4) -> DataFrame:
    """Pairs of names one of which holds the other, both of at least `least` characters. All grams of that length of the
    shorter name are in the longer one, so the names are joined by the shorter name's gram that the fewest names on the
    other side hold: what all names have in common, such as a brand, is no key."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) - least + 1), lambda i: F.substring(F.col(c), i, F.lit(least))))
    a, b = (df.where(F.char_length(c) >= least).withColumn("row", F.struct(*df.columns)) for df, c in ((left, "norm"), (right, "norm2")))

    def held_by(short: DataFrame, c: str, long: DataFrame, c2: str) -> DataFrame:
        theirs = long.select("row", F.col(c2).alias("long"), F.explode(grams(c2)).alias("g"))
        counts = theirs.groupBy("g").agg(F.count("*").alias("n"))
        # names that occur many times look for their gram once
        mine = short.select(F.col(c).alias("short")).distinct().select("short", F.explode(grams("short")).alias("g")).join(counts, "g", "left")
        best = mine.groupBy("short").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("m")).where("m.n > 0").select("short", "m.g")
        keyed = short.select(F.col("row").alias("own"), F.col(c).alias("short")).join(best, "short")
        return keyed.join(theirs, "g").where(F.col("long").contains(F.col("short"))).select("own", F.col("row").alias("other"))

    one = held_by(a, "norm", b, "norm2").select("own.*", "other.*")
    two = held_by(b, "norm2", a, "norm").select("other.*", "own.*")
    return one.unionByName(two).distinct()


@query(with_sql("community", LOOK_SQL + " SELECT ask, CAST(count(*) AS BIGINT) AS hits, min(id) AS first FROM m GROUP BY ask"))
def contain_join(spark, sf_dir):
    found = contained(asked_names(spark, sf_dir), D.community(spark, sf_dir).select("id", text.name_norm(F.col("name")).alias("norm2")))
    return found.groupBy("ask").agg(F.count("*").alias("hits"), F.min("id").alias("first"))


@query(with_sql("community", LOOK_SQL + " SELECT ask.ask, arg_min(id, [tier, id]) AS id, CAST(min(tier) AS INTEGER) AS tier FROM ask LEFT JOIN m ON m.ask = ask.ask GROUP BY ask.ask"))
def name_lookup(spark, sf_dir):
    """A community by its name, else by the first that holds it or is held by it; null for none."""
    own, names = asked_names(spark, sf_dir), D.community(spark, sf_dir).select("id", text.name_norm(F.col("name")).alias("norm2"))
    same = own.join(names, own.norm == names.norm2).select("ask", "id", F.lit(1).alias("tier"))
    found = same.unionByName(contained(own, names).select("ask", "id", F.lit(2).alias("tier")))
    return own.select("ask").join(found.groupBy("ask").agg(F.min(F.struct("tier", "id")).alias("m")), "ask", "left").select("ask", "m.id", "m.tier")


@query(
    with_sql("community request", LOOK_SQL + f", n AS (SELECT ask, min(id) AS id FROM m WHERE tier = 1 GROUP BY ask), r AS (SELECT request_id AS ask, x, y FROM request SEMI JOIN ask ON ask.ask = request_id), "
    f"c2 AS (SELECT ask, arg_min(b.id, [{DIST}, b.id]) AS id FROM r a JOIN community b ON {DIST} < 150 GROUP BY ask) SELECT r.ask, coalesce(n.id, c2.id) AS id, CASE WHEN n.id IS NOT NULL THEN 'name' WHEN c2.id IS NOT NULL THEN 'coord' ELSE 'none' END AS matched_by FROM r LEFT JOIN n USING (ask) LEFT JOIN c2 USING (ask)")
)
def locate(spark, sf_dir):
    """By name, else by place, else not at all."""
    names = D.community(spark, sf_dir).select("id", text.name_norm(F.col("name")).alias("norm2"))
    own = asked_names(spark, sf_dir)
    by_name = own.join(names, own.norm == names.norm2).groupBy("ask").agg(F.min("id").alias("by_name"))
    where = D.request(spark, sf_dir).withColumnRenamed("request_id", "ask").join(own.select("ask"), "ask", "left_semi").select("ask", "x", "y")
    pairs = S.radius_join(where, as2(D.community(spark, sf_dir), id="id"), 150.0).where("d < 150")
    by_place = S.nearest(pairs, "ask", [F.col("d"), F.col("id")], ["id"]).withColumnRenamed("id", "by_place")
    out = where.select("ask").join(by_name, "ask", "left").join(by_place, "ask", "left")
    return out.select("ask", F.coalesce("by_name", "by_place").alias("id"), F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_place").isNotNull(), "coord").otherwise("none").alias("matched_by"))


HOT_SQL = ", hot AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'key_school' ELSE 'sanjia' END AS tag, translate(lower('Brand#' || (s_suppkey % 5 + 1) || (s_suppkey % 4 + 1) || CASE WHEN s_suppkey % 2 = 0 THEN '小' ELSE '' END), '#', '#') AS norm FROM supplier)"


def hot_names_table(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.lit("Brand#"), (k % 5 + 1).cast("string"), (k % 4 + 1).cast("string"), F.when(k % 2 == 0, "小").otherwise(""))
    return D.table(spark, sf_dir, "supplier").select(F.when(k % 2 == 0, "key_school").otherwise("sanjia").alias("tag"), text.name_norm(name).alias("norm2")).distinct()


@query(
    with_sql("poi", HOT_SQL + ", p AS (SELECT id, category, transport_kind, translate(regexp_replace(lower(name), '\\s', '', 'g'), '" + text.DROPPED + "', '') AS norm FROM poi) SELECT id, tag FROM (SELECT DISTINCT id, tag FROM p JOIN hot ON (contains(p.norm, hot.norm) OR contains(hot.norm, p.norm)) AND category = CASE tag WHEN 'key_school' THEN 'education' ELSE 'health' END "
    "UNION ALL SELECT id, 'metro' FROM p WHERE category = 'transport' AND transport_kind = 'metro')")
)
def hot_tags(spark, sf_dir):
    """Key schools, top hospitals and metro stops, by names that hold one another."""
    own = D.poi(spark, sf_dir).select("id", "category", "transport_kind", text.name_norm(F.col("name")).alias("norm"))
    found = contained(own.where("category in ('education', 'health')").select("id", "category", "norm"), hot_names_table(spark, sf_dir), 3)
    fits = F.col("category") == F.when(F.col("tag") == "key_school", "education").otherwise("health")
    tagged = found.where(fits).select("id", "tag").distinct()
    return tagged.unionByName(own.where("category = 'transport' and transport_kind = 'metro'").select("id", F.lit("metro").alias("tag")))


SAMPLES = [(1, 116.4478, 39.8846), (2, 116.4278, 39.8646), (3, 116.4678, 39.8946), (4, 116.4378, 39.8996)]
HAV = f"2 * {C.EARTH_RADIUS_M!r}::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng) / 2), 2))))"


@query(with_sql("request", ", s(sample, lng2, lat2) AS (VALUES " + ", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE)" for k, x, y in SAMPLES) + f") SELECT request_id, arg_min(sample, {HAV}) AS sample, round(min({HAV}), 3) AS d, min({HAV}) <= 150 AS usable FROM request, s GROUP BY request_id"))
def nearest_sample(spark, sf_dir):
    """The nearest of a short fixed list of samples, and whether its stored result may be used."""
    options = F.array(*(F.struct(geo.haversine(F.col("lng"), F.col("lat"), F.lit(x), F.lit(y)).alias("d"), F.lit(k).alias("sample")) for k, x, y in SAMPLES))
    return D.request(spark, sf_dir).select("request_id", F.array_min(options).alias("m")).select("request_id", "m.sample", F.round("m.d", 3).alias("d"), (F.col("m.d") <= C.SNAPSHOT_RADIUS_M).alias("usable"))


@query(
    with_sql("request", f", box AS ({BOXES_SQL}), t AS (SELECT request_id, x, y, min(box) FILTER (box % 3 = 0) AS tile, min(box) FILTER (box % 3 = 1) AS patch, min(box) FILTER (box % 3 = 2) AS lite FROM request LEFT JOIN box ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1, 2, 3), "
    "n AS (SELECT request_id, arg_min(box, [pow((x0 + x1) / 2 - x, 2) + pow((y0 + y1) / 2 - y, 2), box]) AS near FROM request, box WHERE box % 3 = 1 GROUP BY 1) SELECT request_id, coalesce(tile, patch, lite, near) AS region, coalesce(tile, patch, lite) IS NULL AS degraded FROM t JOIN n USING (request_id)")
)
def pick_region(spark, sf_dir):
    """The base map of a request: a tile, a patch, the coarse one, or the nearest patch, which counts as degraded."""
    own = D.request(spark, sf_dir).select("request_id", "x", "y")
    # the base maps are few (a region each): one row with all of them, so a request is settled where it is read
    maps = boxes(spark, sf_dir).agg(F.collect_list(F.struct("box", "x0", "y0", "x1", "y1")).alias("maps"))
    x, y = F.col("x"), F.col("y")
    holds = lambda k: lambda m: (m["box"] % 3 == k) & x.between(m["x0"], m["x1"]) & y.between(m["y0"], m["y1"])
    first = F.coalesce(*(F.array_min(F.transform(F.filter("maps", holds(k)), lambda m: m["box"])) for k in range(3)))
    d2 = lambda m: F.pow((m["x0"] + m["x1"]) / 2 - x, F.lit(2.0)) + F.pow((m["y0"] + m["y1"]) / 2 - y, F.lit(2.0))
    near = F.array_min(F.transform(F.filter("maps", lambda m: m["box"] % 3 == 1), lambda m: F.struct(d2(m).alias("d"), m["box"].alias("box"))))
    out = own.crossJoin(F.broadcast(maps)).select("request_id", first.alias("first"), near.alias("m"))
    return out.where("m is not null").select("request_id", F.coalesce("first", F.col("m.box")).alias("region"), F.col("first").isNull().alias("degraded"))


@query(
    with_sql("request", f"{RAIL_SQL}, s AS (SELECT rail, cx1 + (cx2 - cx1) * k / 56.0 AS px, cy1 + (cy2 - cy1) * k / 56.0 AS py FROM rail, range(57) r(k)), dirs(k, name, a) AS (VALUES " + ", ".join(f"({k}, '{n}', {a}::DOUBLE)" for k, (n, a) in enumerate(C.DIRECTION_ANGLES.items())) + "), "
    "p AS (SELECT request_id, rail, px - x AS dx, py - y AS dy FROM request, s WHERE (px - x) * (px - x) + (py - y) * (py - y) <= 1440000), q AS (SELECT request_id, rail, dx, dy, arg_min(name, [abs((((degrees(atan2(dy, dx)) - a + 540.0::DOUBLE) % 360) + 360) % 360 - 180), k]) AS direction FROM p, dirs GROUP BY 1, 2, 3, 4) "
    "SELECT request_id, direction, array_to_string(list_sort(list(DISTINCT 'rail' || rail)), '+') AS labels FROM q GROUP BY 1, 2")
)
def barrier_labels(spark, sf_dir):
    """Names of the barriers in each compass direction within 1,200 m, from points every 100 m along them."""
    step = F.explode(F.sequence(F.lit(0), F.lit(56)))
    points = rails(spark, sf_dir).withColumn("k", step).select("rail", (F.col("cx1") + (F.col("cx2") - F.col("cx1")) * F.col("k") / 56.0).alias("x2"), (F.col("cy1") + (F.col("cy2") - F.col("cy1")) * F.col("k") / 56.0).alias("y2"))
    pairs = S.radius_join(D.request(spark, sf_dir).select("request_id", "x", "y"), points, 1200.0)
    named = pairs.select("request_id", F.concat(F.lit("rail"), F.col("rail").cast("string")).alias("label"), geo.direction8(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")).alias("direction"))
    return named.groupBy("request_id", "direction").agg(F.array_join(F.array_sort(F.collect_set("label")), "+").alias("labels"))


@query(with_sql("poi community", f", w AS (SELECT b.id, count(*) AS places, round(min({DIST}), 3) AS nearest FROM poi a JOIN community b ON {DIST} <= 250 GROUP BY b.id) SELECT * FROM w"))
def place_density(spark, sf_dir):
    """How many places lie around each community, and how near the nearest is."""
    pairs = S.radius_join(D.community(spark, sf_dir).select("id", "x", "y"), as2(D.poi(spark, sf_dir)), 250.0)
    return pairs.groupBy("id").agg(F.count("*").alias("places"), F.round(F.min("d"), 3).alias("nearest"))
