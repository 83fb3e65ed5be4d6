"""Queries over single rows: geodesy, names, tags."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footreach import config as C
from footreach.functions import geo, text
from footreach.plans.registry import query
from footreach.sources import derived as D
from footreach.sources.derived import with_sql

PI = repr(math.pi)


def r6(c):
    return F.round(c, 6)


def gcj_sql(inner: str, lng: str, lat: str, out: str) -> str:
    """A query that adds {out}_lng and {out}_lat to the rows of `inner`."""
    x, y, rad = f"({lng} - 105.0::DOUBLE)", f"({lat} - 35.0::DOUBLE)", f"({lat} / 180.0::DOUBLE * {PI}::DOUBLE)"

    def waves(v: str, *terms: tuple[float, float]) -> str:
        return "(" + " + ".join(f"sin({v} * {PI}::DOUBLE / {d!r}::DOUBLE) * {a!r}::DOUBLE" for a, d in terms) + ") * 2 / 3"

    both = waves(x, (20.0, 1 / 6), (20.0, 0.5))
    dlat = f"-100 + 2 * {x} + 3 * {y} + 0.2::DOUBLE * {y} * {y} + 0.1::DOUBLE * {x} * {y} + 0.2::DOUBLE * sqrt(abs({x})) + {both} + {waves(y, (20.0, 1.0), (40.0, 3.0))} + {waves(y, (160.0, 12.0), (320.0, 30.0))}"
    dlng = f"300 + {x} + 2 * {y} + 0.1::DOUBLE * {x} * {x} + 0.1::DOUBLE * {x} * {y} + 0.1::DOUBLE * sqrt(abs({x})) + {both} + {waves(x, (20.0, 1.0), (40.0, 3.0))} + {waves(x, (150.0, 12.0), (300.0, 30.0))}"
    m = f"(1 - {geo.GCJ_EE!r}::DOUBLE * pow(sin({rad}), 2))"
    out_of = f"NOT ({lng} > 73.66 AND {lng} < 135.05 AND {lat} > 3.86 AND {lat} < 53.55)"
    return (
        f"SELECT *, CASE WHEN {out_of} THEN {lng} ELSE {lng} + ({dlng}) * 180 / ({geo.GCJ_A!r}::DOUBLE / sqrt({m}) * cos({rad}) * {PI}::DOUBLE) END AS {out}_lng, "
        f"CASE WHEN {out_of} THEN {lat} ELSE {lat} + ({dlat}) * 180 / (({geo.GCJ_A!r}::DOUBLE * (1 - {geo.GCJ_EE!r}::DOUBLE)) / ({m} * sqrt({m})) * {PI}::DOUBLE) END AS {out}_lat FROM ({inner})"
    )


#: Points of several countries beside the derived ones.
ABROAD = [(-1, 139.69, 35.68), (-2, -5.6, 42.6), (-3, 2.35, 48.85), (-4, 121.47, 31.23), (-5, 113.26, 23.13), (-6, 104.06, 30.67), (-7, 114.05, 22.54), (-8, 120.15, 30.28), (-9, 135.0, 18.0), (-10, 73.0, 54.0)]
ABROAD_SQL = "(VALUES " + ", ".join(f"({i}::BIGINT, {x}::DOUBLE, {y}::DOUBLE)" for i, x, y in ABROAD) + ") t(id, lng, lat)"
POINTS_SQL = with_sql("poi_wide", f", pts AS (SELECT id, lng, lat FROM poi_wide UNION ALL SELECT id, lng, lat FROM {ABROAD_SQL})")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.poi(spark, sf_dir, wide=True).select("id", "lng", "lat").unionByName(spark.createDataFrame(ABROAD, "id long, lng double, lat double"))


@query(POINTS_SQL + f"SELECT id, round(2 * {C.EARTH_RADIUS_M!r}::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(lat - 39.9::DOUBLE) / 2), 2) + cos(radians(39.9::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lng - 116.4::DOUBLE) / 2), 2)))), 3) AS metres FROM pts")
def haversine(spark, sf_dir):
    return points(spark, sf_dir).select("id", F.round(geo.haversine(F.lit(116.4), F.lit(39.9), F.col("lng"), F.col("lat")), 3).alias("metres"))


@query(POINTS_SQL + f"SELECT id, round(gcj_lng, 6) AS glng, round(gcj_lat, 6) AS glat FROM ({gcj_sql('SELECT * FROM pts', 'lng', 'lat', 'gcj')})")
def wgs_to_gcj(spark, sf_dir):
    return geo.wgs_to_gcj(points(spark, sf_dir), "lng", "lat", "glng", "glat").select("id", r6("glng").alias("glng"), r6("glat").alias("glat"))


def back_sql(inner: str, lng: str, lat: str) -> str:
    """The inverse of the shift in three rounds; w3_lng and w3_lat."""
    out = f"SELECT *, {lng} AS w0_lng, {lat} AS w0_lat FROM ({inner})"
    for k in range(3):
        out = f"SELECT *, w{k}_lng + {lng} - g{k}_lng AS w{k + 1}_lng, w{k}_lat + {lat} - g{k}_lat AS w{k + 1}_lat FROM ({gcj_sql(out, f'w{k}_lng', f'w{k}_lat', f'g{k}')})"
    return out


@query(POINTS_SQL + f"SELECT id, round(w3_lng, 6) AS wlng, round(w3_lat, 6) AS wlat FROM ({back_sql('SELECT * FROM pts', 'lng', 'lat')})")
def gcj_to_wgs(spark, sf_dir):
    return geo.gcj_to_wgs(points(spark, sf_dir), "lng", "lat", "wlng", "wlat").select("id", r6("wlng").alias("wlng"), r6("wlat").alias("wlat"))


def bd_sql(lng: str, lat: str) -> tuple[str, str]:
    z = f"(sqrt({lng} * {lng} + {lat} * {lat}) + 0.00002::DOUBLE * sin({lat} * {geo.BD_PI!r}::DOUBLE))"
    t = f"(atan2({lat}, {lng}) + 0.000003::DOUBLE * cos({lng} * {geo.BD_PI!r}::DOUBLE))"
    return f"({z} * cos({t}) + 0.0065::DOUBLE)", f"({z} * sin({t}) + 0.006::DOUBLE)"


def unbd_sql(lng: str, lat: str) -> tuple[str, str]:
    x, y = f"({lng} - 0.0065::DOUBLE)", f"({lat} - 0.006::DOUBLE)"
    z = f"(sqrt({x} * {x} + {y} * {y}) - 0.00002::DOUBLE * sin({y} * {geo.BD_PI!r}::DOUBLE))"
    t = f"(atan2({y}, {x}) - 0.000003::DOUBLE * cos({x} * {geo.BD_PI!r}::DOUBLE))"
    return f"({z} * cos({t}))", f"({z} * sin({t}))"


@query(POINTS_SQL + f", b AS (SELECT id, {bd_sql('lng', 'lat')[0]} AS blng, {bd_sql('lng', 'lat')[1]} AS blat FROM pts) SELECT id, round(blng, 6) AS blng, round(blat, 6) AS blat, round({unbd_sql('blng', 'blat')[0]}, 6) AS glng, round({unbd_sql('blng', 'blat')[1]}, 6) AS glat FROM b")
def gcj_bd(spark, sf_dir):
    blng, blat = geo.gcj_to_bd(F.col("lng"), F.col("lat"))
    out = points(spark, sf_dir).withColumns({"blng": blng, "blat": blat})
    glng, glat = geo.bd_to_gcj(F.col("blng"), F.col("blat"))
    return out.select("id", r6("blng").alias("blng"), r6("blat").alias("blat"), r6(glng).alias("glng"), r6(glat).alias("glat"))


@query(POINTS_SQL + f", g AS ({gcj_sql('SELECT * FROM pts', 'lng', 'lat', 'g')}) SELECT id, round({bd_sql('g_lng', 'g_lat')[0]}, 6) AS blng, round({bd_sql('g_lng', 'g_lat')[1]}, 6) AS blat FROM g")
def wgs_to_bd(spark, sf_dir):
    out = geo.wgs_to_gcj(points(spark, sf_dir), "lng", "lat", "glng", "glat")
    blng, blat = geo.gcj_to_bd(F.col("glng"), F.col("glat"))
    return out.select("id", r6(blng).alias("blng"), r6(blat).alias("blat"))


@query(
    POINTS_SQL + f", k AS (SELECT *, CASE id % 3 WHEN 0 THEN 'WGS84' WHEN 1 THEN ' gcj02 ' ELSE NULL END AS kind FROM pts WHERE id > 0), u AS (SELECT *, {unbd_sql('lng', 'lat')[0]} AS ulng, {unbd_sql('lng', 'lat')[1]} AS ulat FROM k), "
    "s AS (SELECT id, kind, lng, lat, CASE WHEN kind IS NULL THEN ulng ELSE lng END AS slng, CASE WHEN kind IS NULL THEN ulat ELSE lat END AS slat FROM u) "
    f"SELECT id, round(CASE WHEN kind = 'WGS84' THEN lng ELSE w3_lng END, 6) AS wlng, round(CASE WHEN kind = 'WGS84' THEN lat ELSE w3_lat END, 6) AS wlat FROM ({back_sql('SELECT * FROM s', 'slng', 'slat')})"
)
def to_wgs84(spark, sf_dir):
    """Any of the three systems to one; without a name it is the map's own, and an unknown name is an error."""
    kind = F.when(F.col("id") % 3 == 0, "WGS84").when(F.col("id") % 3 == 1, " gcj02 ")
    own = points(spark, sf_dir).where("id > 0").withColumn("kind", F.lower(F.trim(F.coalesce(kind, F.lit("bd09ll")))))
    known = F.when(F.col("kind").isin("wgs84", "gcj02", "bd09ll"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown coordinate type "), "kind")))
    glng, glat = geo.bd_to_gcj(F.col("lng"), F.col("lat"))
    own = own.withColumn("kind", known).withColumns({"slng": F.when(F.col("kind") == "bd09ll", glng).otherwise(F.col("lng")), "slat": F.when(F.col("kind") == "bd09ll", glat).otherwise(F.col("lat"))})
    out = geo.gcj_to_wgs(own, "slng", "slat", "w1", "w2")
    same = F.col("kind") == "wgs84"
    return out.select("id", r6(F.when(same, F.col("lng")).otherwise(F.col("w1"))).alias("wlng"), r6(F.when(same, F.col("lat")).otherwise(F.col("w2"))).alias("wlat"))


COS0 = repr(C.M_PER_DEG * math.cos(math.radians(39.9)))


@query(POINTS_SQL + f", p AS (SELECT id, (lng - 116.4::DOUBLE) * {COS0}::DOUBLE AS x, (lat - 39.9::DOUBLE) * {C.M_PER_DEG!r}::DOUBLE AS y FROM pts) SELECT id, round(x, 3) AS x, round(y, 3) AS y, round(x / {COS0}::DOUBLE + 116.4::DOUBLE, 6) AS lng, round(y / {C.M_PER_DEG!r}::DOUBLE + 39.9::DOUBLE, 6) AS lat FROM p")
def local_xy(spark, sf_dir):
    x, y = geo.local_xy(F.col("lng"), F.col("lat"), 116.4, 39.9)
    out = points(spark, sf_dir).select("id", x.alias("x"), y.alias("y"))
    lng, lat = geo.local_lnglat(F.col("x"), F.col("y"), 116.4, 39.9)
    return out.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), r6(lng).alias("lng"), r6(lat).alias("lat"))


@query(
    POINTS_SQL + ", l AS (SELECT id, CAST(least(8191, greatest(0, floor((lng + 180) / 360 * 8192))) AS BIGINT) AS x, CAST(least(4095, greatest(0, floor((lat + 90) / 180 * 4096))) AS BIGINT) AS y FROM pts), "
    "b AS (SELECT id, list_transform(range(25), lambda k: CASE WHEN k % 2 = 0 THEN (x >> (12 - k // 2)::INTEGER) & 1 ELSE (y >> (11 - k // 2)::INTEGER) & 1 END) AS bits FROM l) "
    "SELECT id, array_to_string(list_transform(range(5), lambda c: substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(bits[5 * c + 1] * 16 + bits[5 * c + 2] * 8 + bits[5 * c + 3] * 4 + bits[5 * c + 4] * 2 + bits[5 * c + 5] + 1 AS INTEGER), 1)), '') AS code FROM b"
)
def geohash5(spark, sf_dir):
    return points(spark, sf_dir).select("id", geo.geohash5(F.col("lng"), F.col("lat")).alias("code"))


TILE_SQL = ", t AS (SELECT id, CAST(trunc((lat - 39.64::DOUBLE) / 0.036::DOUBLE) AS INTEGER) AS r, CAST(trunc((lng - 115.96::DOUBLE) / 0.047::DOUBLE) AS INTEGER) AS c FROM pts WHERE id > 0)"


@query(POINTS_SQL + TILE_SQL + " SELECT id, r AS tile_row, c AS tile_col, 'b6r_r' || lpad(r::VARCHAR, 2, '0') || 'c' || lpad(c::VARCHAR, 2, '0') AS tile, r AS parsed_row, c AS parsed_col FROM t")
def tile_index(spark, sf_dir):
    row, col = geo.tile_of(F.col("lng"), F.col("lat"))
    out = points(spark, sf_dir).where("id > 0").select("id", row.alias("tile_row"), col.alias("tile_col"))
    out = out.withColumn("tile", geo.tile_name(F.col("tile_row"), F.col("tile_col")))
    r, c = geo.parse_tile(F.col("tile"))
    return out.withColumns({"parsed_row": r, "parsed_col": c})


RING_SQL = ", e(x1, y1, x2, y2) AS (VALUES " + ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(C.RING, C.RING[1:] + C.RING[:1], strict=True)) + ")"


@query(
    POINTS_SQL + RING_SQL + " SELECT id, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1 "
    "OR count(*) FILTER ((lng - x1) * (y2 - y1) - (lat - y1) * (x2 - x1) = 0 AND lng BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) > 0 AS inside FROM pts, e GROUP BY id"
)
def in_ring(spark, sf_dir):
    return points(spark, sf_dir).select("id", geo.in_polygon(F.col("lng"), F.col("lat"), C.RING).alias("inside"))


@query(
    POINTS_SQL + ", box(k, city, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"({k}, '{n}', {b[0]}, {b[1]}, {b[2]}, {b[3]})" for k, (n, b) in enumerate(C.CITY_BOXES.items())) + ") "
    "SELECT id, min_by(city, k) AS city, any_value(lng < 73 OR lng > 135 OR lat < 18 OR lat > 54) AS overseas FROM pts LEFT JOIN box ON lng BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY id"
)
def city_box(spark, sf_dir):
    return points(spark, sf_dir).select("id", geo.city_of(F.col("lng"), F.col("lat")).alias("city"), geo.overseas(F.col("lng"), F.col("lat")).alias("overseas"))


@query("SELECT p_partkey AS id, CASE WHEN m <= 5 THEN '3,5' ELSE array_to_string(list_concat(list_filter([5, 10, 15, 20], lambda x: x < m)[-3:], [m]), ',') END AS layers, greatest(1500, least(2000, m * 135)) AS recall FROM (SELECT p_partkey, p_partkey % 30 + 1 AS m FROM part)")
def layer_minutes(spark, sf_dir):
    m = (F.col("p_partkey") % 30 + 1).cast("int")
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(geo.layer_minutes(m).cast("array<string>"), ",").alias("layers"), geo.recall_radius(m).cast("long").alias("recall"))


DIR_SQL = "SELECT id, min_by(name, (abs((((degrees(atan2(dy, dx)) - a + 540.0::DOUBLE) % 360) + 360) % 360 - 180), k)) AS direction"
DIRS_SQL = ", dirs(k, name, a) AS (VALUES " + ", ".join(f"({k}, '{n}', {a}::DOUBLE)" for k, (n, a) in enumerate(C.DIRECTION_ANGLES.items())) + ")"


@query(with_sql("poi", DIRS_SQL + " SELECT id, min_by(dirs.name, [abs((((degrees(atan2(yi - 2500, xi - 3350)) - a + 540.0::DOUBLE) % 360) + 360) % 360 - 180), k]) AS direction FROM poi, dirs GROUP BY id"))
def direction8(spark, sf_dir):
    return D.poi(spark, sf_dir).select("id", geo.direction8(F.col("xi") - 3350, F.col("yi") - 2500).alias("direction"))


@query(
    with_sql("request", DIRS_SQL + f", pts AS (SELECT request_id, name, k, x + 1200 * cos(radians(a - 22.5 + s * 45.0 / 16)) AS px, y + 1200 * sin(radians(a - 22.5 + s * 45.0 / 16)) AS py, x, y, s FROM request, dirs, range(17) r(s)), "
    "nxt AS (SELECT *, lead(px) OVER w AS qx, lead(py) OVER w AS qy FROM pts WINDOW w AS (PARTITION BY request_id, name ORDER BY s)) "
    "SELECT request_id, name AS direction, round(sum(abs((px - x) * (qy - y) - (qx - x) * (py - y)) / 2), 3) AS area FROM nxt WHERE qx IS NOT NULL GROUP BY 1, 2")
)
def sector_wedge(spark, sf_dir):
    """Areas of the eight wedges of a circle, each a centre and 17 points of the arc."""
    dirs = F.explode(F.array(*(F.struct(F.lit(n).alias("direction"), F.lit(a).alias("a")) for n, a in C.DIRECTION_ANGLES.items())))
    arc = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda s: F.struct((F.lit(1200.0) * F.cos(F.radians(F.col("a") - 22.5 + s * 45.0 / 16))).alias("x"), (F.lit(1200.0) * F.sin(F.radians(F.col("a") - 22.5 + s * 45.0 / 16))).alias("y")))
    area = F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.lit(0.0), lambda t, s: t + F.abs(F.get("arc", s - 1)["x"] * F.get("arc", s)["y"] - F.get("arc", s)["x"] * F.get("arc", s - 1)["y"]) / 2)
    return D.request(spark, sf_dir).select("request_id", dirs.alias("d")).select("request_id", "d.*").withColumn("arc", arc).select("request_id", "direction", F.round(area, 3).alias("area"))


WAYS = ["footway", "steps", "path", "residential", "motorway", "trunk", "service", "unknown", ""]
FLAGS = ["yes", "no", "", "viaduct", "1"]


def tagged(spark, sf_dir, **columns):
    """part rows with tag columns picked from lists by a divisor of the key."""
    k = F.col("p_partkey")
    pick = lambda values, div: F.element_at(F.array(*map(F.lit, values)), (F.floor(k / div) % len(values) + 1).cast("int"))
    return D.table(spark, sf_dir, "part").select(k.alias("id"), *(pick(v, d).alias(c) for c, (v, d) in columns.items()))


def tagged_sql(**columns) -> str:
    return "WITH t AS (SELECT p_partkey AS id, " + ", ".join(f"{D._list(v)}[(p_partkey // {d}) % {len(v)} + 1] AS {c}" for c, (v, d) in columns.items()) + " FROM part) "


def in_sql(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


EDGE = {"highway": (WAYS, 1), "bridge": (FLAGS, 9), "tunnel": (FLAGS, 45)}
KIND_SQL = f"CASE WHEN bridge IN {in_sql(C.TRUTHY)} THEN 'bridge' WHEN tunnel IN {in_sql(C.TRUTHY)} AND highway IN {in_sql(C.TUNNEL_HIGHWAYS)} THEN 'tunnel' ELSE 'road' END"


@query(tagged_sql(**EDGE) + f"SELECT id, {KIND_SQL} AS kind FROM t")
def edge_kind(spark, sf_dir):
    return tagged(spark, sf_dir, **EDGE).select("id", text.edge_kind(*map(F.col, EDGE)).alias("kind"))


@query(tagged_sql(**EDGE) + "SELECT id, round((id % 500 + 1) / (CASE WHEN highway = 'steps' THEN 44 ELSE 70 END::DOUBLE) * 60, 6) AS seconds FROM t")
def edge_weight(spark, sf_dir):
    speed = F.when(F.col("highway") == "steps", C.STEPS_SPEED).otherwise(C.WALK_SPEED)
    return tagged(spark, sf_dir, **EDGE).select("id", r6((F.col("id") % 500 + 1) / speed * 60).alias("seconds"))


@query(with_sql("poi", " SELECT id, CAST(round(x * 1000) AS BIGINT) AS kx, CAST(round(y * 1000) AS BIGINT) AS ky FROM poi"))
def node_key(spark, sf_dir):
    """Nodes merge at whole millimetres, kept as integers."""
    return D.poi(spark, sf_dir).select("id", F.round(F.col("x") * 1000).cast("long").alias("kx"), F.round(F.col("y") * 1000).cast("long").alias("ky"))


@query(
    "WITH pts AS (SELECT o_custkey, o_orderkey, (o_orderkey * 7919 % 6700)::DOUBLE AS x, (o_orderkey * 104729 % 5000)::DOUBLE AS y, lag((o_orderkey * 7919 % 6700)::DOUBLE) OVER w AS px, lag((o_orderkey * 104729 % 5000)::DOUBLE) OVER w AS py "
    "FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_custkey, count(*) AS points, round(coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0), 3) AS length FROM pts GROUP BY 1"
)
def polyline_len(spark, sf_dir):
    """The length of each customer's path through its orders' points."""
    return paths(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").alias("points"), F.round(F.coalesce(F.sum("step"), F.lit(0.0)), 3).alias("length"))


def paths(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x, y = (c.cast("double") for c in D.units(F.col("o_orderkey")))
    rows = D.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", x.alias("x"), y.alias("y"))
    rows = rows.withColumns({"px": F.lag("x").over(order), "py": F.lag("y").over(order)})
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    return rows.withColumn("step", F.sqrt(dx * dx + dy * dy))


@query(with_sql("request_varied", " SELECT request_id, CAST(round(lng * 100000) AS BIGINT)::VARCHAR || '_' || CAST(round(lat * 100000) AS BIGINT)::VARCHAR || '_' || minutes::VARCHAR || '_graph' AS key FROM request_varied"))
def cache_key(spark, sf_dir):
    return D.request(spark, sf_dir, varied=True).select("request_id", geo.cache_key(F.col("lng"), F.col("lat"), F.col("minutes"), F.lit("graph")).alias("key"))


@query(POINTS_SQL + " SELECT id, round(sqrt(pow((lng - 116.4::DOUBLE) * 111320 * cos((lat + 39.9::DOUBLE) / 2 * pi() / 180), 2) + pow((lat - 39.9::DOUBLE) * 110540, 2)), 3) AS metres FROM pts WHERE id > 0")
def planar_distance(spark, sf_dir):
    return points(spark, sf_dir).where("id > 0").select("id", F.round(geo.planar_distance(F.col("lng"), F.col("lat"), F.lit(116.4), F.lit(39.9)), 3).alias("metres"))


@query("SELECT p_partkey AS id, CASE WHEN r <= 400 THEN 17 WHEN r <= 620 THEN 16.5 WHEN r <= 900 THEN 16 WHEN r <= 1300 THEN 15.5 WHEN r <= 1800 THEN 15 ELSE 14.5 END::DOUBLE AS zoom FROM (SELECT p_partkey, (p_partkey % 30 + 1) * 72 AS r FROM part)")
def zoom_step(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), geo.zoom_step((F.col("p_partkey") % 30 + 1).cast("int")).alias("zoom"))


@query(
    "WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey % 41) / 2::DOUBLE END AS n, p_partkey % 26 + 5 AS m FROM part), r AS (SELECT id, n, n / greatest(1, m) AS r FROM t) "
    "SELECT id, CASE WHEN n IS NOT NULL THEN greatest(15, CAST(floor(CASE WHEN r <= 1.0::DOUBLE / 3 THEN 100 WHEN r <= 1 THEN 100 - 60 * (r - 1.0::DOUBLE / 3) ELSE 60 - 60 * (r - 1) END + 0.5) AS INTEGER)) END AS score FROM r"
)
def proximity_score(spark, sf_dir):
    k = F.col("p_partkey")
    return D.table(spark, sf_dir, "part").select(k.alias("id"), geo.proximity_score(F.when(k % 9 != 0, (k % 41) / 2), (k % 26 + 5).cast("int")).alias("score"))


# Names. A list of spellings joins the derived ones.

SPELLINGS = [
    "九龙山地铁站", "珠江帝景(公交站)", "马连洼（地铁）", "地铁马连洼站（地铁）", "地铁上地软件园站(西行)", "上地软件园站（东行）", "站", "地铁站", "地铁", "  西二旗 站 ", "百旺公园-西区", "百旺公园·北区", "百旺 公园　三期", "孙河社区卫生服务中心-驾驶人体检室", "某某医院—发热门诊", "- 全部", "劲松（一期）", "【A】b·C、d", "健身园", "健身房", "东方广场-东办公楼E3座", "红星小学(已关闭)", "", "八里庄_一区",
]
SPELL_SQL = with_sql("poi", ", names AS (SELECT id, name, category, edu_kind, tag FROM poi UNION ALL SELECT -row_number() OVER (), n, 'public', NULL, NULL FROM (SELECT unnest(" + D._list(SPELLINGS) + ") AS n))")
WS = "[\\s\\x{3000}\\x{00A0}]"


def names(spark, sf_dir):
    own = spark.createDataFrame([(-k - 1, n, "public", None, None) for k, n in enumerate(SPELLINGS)], "id long, name string, category string, edu_kind string, tag string")
    return D.poi(spark, sf_dir).select("id", "name", "category", "edu_kind", "tag").unionByName(own)


@query(SPELL_SQL + f" SELECT id, translate(regexp_replace(lower(name), '{WS}', '', 'g'), '{text.DROPPED}', '') AS norm FROM names")
def name_norm(spark, sf_dir):
    return names(spark, sf_dir).select("id", text.name_norm(F.col("name")).alias("norm"))


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


@query(
    SPELL_SQL + f", a AS (SELECT id, {trim_sql('name')} AS whole FROM names), b AS (SELECT *, {trim_sql('regexp_replace(' + trim_sql(f"regexp_replace(whole, '{text.SIDE_SUFFIX}', '')") + f", '{text.STATION_SUFFIX}', '')")} AS bare FROM a), "
    f"c AS (SELECT *, {trim_sql("CASE WHEN starts_with(bare, '地铁') AND length(bare) > 2 THEN substr(bare, 3) ELSE bare END")} AS s FROM b), d AS (SELECT *, {trim_sql("regexp_replace(s, '站$', '')")} AS short FROM c) "
    "SELECT id, CASE WHEN bare = '' OR short = '' THEN whole ELSE short END AS base FROM d"
)
def station_base(spark, sf_dir):
    return names(spark, sf_dir).select("id", text.station_base(F.col("name")).alias("base"))


@query(SPELL_SQL + f" SELECT id, regexp_replace({trim_sql('name')}, '[-－—–·•\\s\\x{{3000}}]+', '', 'g') AS base FROM names")
def park_base(spark, sf_dir):
    return names(spark, sf_dir).select("id", text.park_base(F.col("name")).alias("base"))


@query(SPELL_SQL + f" SELECT id, {trim_sql("regexp_replace(" + trim_sql('name') + ", '[-－—–].*$', '')")} AS base FROM names")
def clinic_base(spark, sf_dir):
    return names(spark, sf_dir).select("id", text.clinic_base(F.col("name")).alias("base"))


@query(SPELL_SQL + " SELECT id, CASE WHEN edu_kind = 'kindergarten' THEN 0 WHEN contains(name, '小学') THEN 1 ELSE 2 END AS stage FROM names")
def edu_stage(spark, sf_dir):
    return names(spark, sf_dir).select("id", text.edu_stage(F.col("edu_kind"), F.col("name")).alias("stage"))


# the look-ahead is written out for an engine without one
PUBLIC_SQL = text.PUBLIC_NOISE.replace("健身(?!园)", "健身")


@query(
    SPELL_SQL + f" SELECT id, (category = 'public' AND (regexp_matches(replace(name, '健身园', '##'), '{PUBLIC_SQL}') OR regexp_matches(coalesce(tag, ''), '{text.PUBLIC_NOISE_TAG}'))) "
    f"OR (category = 'transport' AND regexp_matches(name, '{text.TRANSPORT_NOISE}')) AS noise FROM names"
)
def noise_filter(spark, sf_dir):
    return names(spark, sf_dir).select("id", text.is_noise(F.col("category"), F.col("name"), F.col("tag")).alias("noise"))


GROUP_SQL = f"CASE WHEN category IN ('convenience', 'mall') AND regexp_matches(name, '{text.MARKET}') THEN 'market' WHEN category = 'health' AND regexp_matches(name, '{text.PHARMACY}') THEN 'pharmacy' WHEN category = 'education' AND contains(name, '小学') THEN 'school' END"


@query(SPELL_SQL + f" SELECT id, {GROUP_SQL} AS grp FROM names")
def blind_group(spark, sf_dir):
    return names(spark, sf_dir).select("id", text.blind_group(F.col("category"), F.col("name")).alias("grp"))


BUILDING = {
    "building": (["apartments", "office", "retail", "yes", ""], 1), "leisure": (["", "", "park", "pitch", "track"], 5), "highway": (["", "", "", "footway"], 25), "shop": (["", "", "mall", "supermarket", "bakery"], 100),
    "amenity": (["", "", "", "marketplace"], 7), "name": (["", "Big MALL", "幸福超市", "写字楼", "家园"], 11), "pois": (["", "cafe", "Shopping point", ""], 13), "ground_floor_retail": (["", "yes", "no", "1"], 3),
}


@query(
    tagged_sql(**BUILDING) + f"SELECT id, CASE WHEN leisure IN {in_sql(C.OPEN_LEISURE)} OR highway IN {in_sql(C.OPEN_HIGHWAY)} THEN 'open' WHEN shop IN ('mall', 'supermarket', 'department_store') OR building = 'retail' OR amenity = 'marketplace' "
    f"OR regexp_matches(lower(name || ' ' || pois), '{'|'.join(C.ENTERABLE_WORDS)}') THEN 'enterable' WHEN building = 'office' AND ground_floor_retail IN ('yes', 'true', '1') THEN 'podium' ELSE 'blocked' END AS category FROM t"
)
def enterability(spark, sf_dir):
    return tagged(spark, sf_dir, **BUILDING).select("id", text.enterability({c: F.col(c) for c in BUILDING}).alias("category"))


WAY = {"highway": (WAYS, 1), "railway": (["", "", "", "rail", "tram"], 9), "tunnel": (["", "", "yes"], 45), "foot": (["", "", "no", "yes"], 2), "access": (["", "private", "", "yes"], 5)}


@query(
    tagged_sql(**WAY) + f"SELECT id, CASE WHEN railway = 'rail' THEN CASE WHEN tunnel NOT IN ('yes', 'true', '1') THEN 'barrier' END WHEN highway IN ('motorway', 'trunk') THEN 'barrier' "
    f"WHEN highway IN {in_sql(C.WALKABLE)} AND foot NOT IN ('no', 'private') AND access NOT IN ('no', 'private') THEN 'road' END AS layer FROM t"
)
def way_classify(spark, sf_dir):
    return tagged(spark, sf_dir, **WAY).select("id", text.way_class({c: F.col(c) for c in WAY}).alias("layer"))


AREA = {"building": (["", "no", "yes", "office"], 1), "natural": (["", "water", "wood", "sand"], 4), "waterway": (["", "riverbank"], 16), "leisure": (["", "park", "pitch", "track"], 3), "landuse": (["", "residential", "forest", "farm"], 7)}


@query(
    tagged_sql(**AREA) + f"SELECT id, CASE WHEN building NOT IN ('', 'no') THEN 'building' WHEN \"natural\" = 'water' OR waterway = 'riverbank' THEN 'water' WHEN leisure IN {in_sql(C.GREEN_LEISURE)} OR \"natural\" IN {in_sql(C.GREEN_NATURAL)} OR landuse = 'forest' THEN 'green' "
    "WHEN landuse = 'residential' THEN 'residential' END AS layer FROM t".replace("natural AS", '"natural" AS')
)
def area_classify(spark, sf_dir):
    return tagged(spark, sf_dir, **AREA).select("id", text.area_class({c: F.col(c) for c in AREA}).alias("layer"))


@query(
    "WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, (o_orderkey % 4)::VARCHAR || '.5,' || (o_orderkey % 3)::VARCHAR AS pair FROM orders), p AS (SELECT *, lag(pair) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM o) "
    "SELECT o_custkey, count(*) FILTER (before IS NULL OR before <> pair) AS points FROM p GROUP BY 1"
)
def parse_path(spark, sf_dir):
    """Paths as texts, with broken pairs in between; points equal to the one before count once."""
    pair = F.concat((F.col("o_orderkey") % 4).cast("string"), F.lit(".5,"), (F.col("o_orderkey") % 3).cast("string"))
    rows = D.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", pair.alias("pair")))).alias("own"))
    path = F.array_join(F.transform("own", lambda x: x["pair"]), ";x,1;;2;")
    return rows.select("o_custkey", F.size(text.parse_path(path)).cast("long").alias("points"))


LINES = ["sector:NW way is cut", "sector:西北 路被切断", "sector:XX stays", "no sector here", "sector:E", "sector:东南   gap"]


@query(
    "WITH t AS (SELECT p_partkey AS id, " + D._list(LINES) + "[p_partkey % 6 + 1] AS line FROM part), u AS (SELECT *, regexp_extract(line, '^sector:([A-Z]{1,2}|[东南西北]{1,2})', 1) AS raw FROM t), "
    "v AS (SELECT *, CASE WHEN raw IN ('N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW') THEN raw ELSE map {'北': 'N', '东北': 'NE', '东': 'E', '东南': 'SE', '南': 'S', '西南': 'SW', '西': 'W', '西北': 'NW'}[raw] END AS sector FROM u) "
    "SELECT id, sector, CASE WHEN sector IS NULL THEN line ELSE regexp_replace(line, '^sector:([A-Z]{1,2}|[东南西北]{1,2})\\s*', '') END AS body FROM v"
)
def parse_sector(spark, sf_dir):
    line = F.element_at(F.array(*map(F.lit, LINES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    sector, body = text.parse_sector(F.col("line"))
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), line.alias("line")).select("id", sector.alias("sector"), body.alias("body"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[:6], chr(10)) AS lines FROM documents")
def llm_lines(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.text_lines(F.col("text")), "\n").alias("lines"))


PLACES = {"er": 1, "the": 2, "on": 3}


@query("SELECT page_id, CASE WHEN contains(url, 'casino') THEN 'casino' WHEN contains(url, 'blog') THEN 'blog' WHEN contains(url, 'org') THEN 'org' END AS place FROM pages")
def keyword_geocode(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", text.keyword_in(F.col("url"), ["casino", "blog", "org"]).alias("place"))
