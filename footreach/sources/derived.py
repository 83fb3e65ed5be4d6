"""Domain tables derived from the star-schema tables by integer arithmetic, so that any engine gets the same ones.

The unit is 1e-5 degree. Points lie in a town of about 5.7 by 5.6 km times `town_side`, which grows with the square root
of the number of places, so that towns of all sizes are equally dense; `wide` spreads them over ten times the side, whatever their number,
and `spread` over three times the town's side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footreach import config as C
from footreach.functions import text as T

LNG0, LAT0 = 116.42, 39.86
#: Metres a unit, east and north.
KX = C.M_PER_DEG * math.cos(math.radians(39.885)) / 1e5
KY = C.M_PER_DEG / 1e5
SUFFIXES = {
    "convenience": ["便利店", "菜市场", "理发店", "农贸市场"], "leisure": ["电影院", "体育馆", "健身中心", "剧院"], "mall": ["购物中心", "超市", "家居", "商场"],
    "education": ["幼儿园", "小学", "中学", "大学"], "health": ["医院", "诊所-急诊", "药店", "医院-门诊"], "public": ["公园", "公园-西区", "图书馆", "停车场"],
    "transport": ["地铁站", "(公交站)", "站(东行)", "地铁站-A口"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Places of a town of side 1.
PLACES = 2000
#: Between the ids of nodes of neighbouring columns.
STEP = 100_000


def town_side(spark: SparkSession, sf_dir: str) -> int:
    return max(1, math.ceil(math.sqrt(table(spark, sf_dir, "part").count() / PLACES)))


def units(key: Column, scale: int = 1) -> tuple[Column, Column]:
    return (key * 7919) % (6700 * scale), (key * 104729) % (5000 * scale)


def located(df: DataFrame, key: str, spark: SparkSession, sf_dir: str, wide: bool = False, spread: bool = False) -> DataFrame:
    """df with xi, yi (units), lng, lat (degrees), x, y (metres)."""
    lng0, lat0 = (116.05, 39.68) if wide else (LNG0, LAT0)
    xi, yi = units(F.col(key).cast("long"), 10 if wide else town_side(spark, sf_dir) * (3 if spread else 1))
    out = df.withColumns({"xi": xi, "yi": yi})
    return out.withColumns({"lng": lng0 + F.col("xi") / 1e5, "lat": lat0 + F.col("yi") / 1e5, "x": F.col("xi") * KX, "y": F.col("yi") * KY})


def poi(spark: SparkSession, sf_dir: str, wide: bool = False, spread: bool = False) -> DataFrame:
    """Places: part keys with a category, a name and, for some kinds, a subtype. Some stand where another of their category
    does, without a uid, and some are closed."""
    k = F.col("p_partkey")
    category = F.element_at(F.array(*map(F.lit, C.CATEGORIES)), (k % 7 + 1).cast("int"))
    suffix = F.element_at(F.array(*(F.array(*map(F.lit, SUFFIXES[c])) for c in C.CATEGORIES)), (k % 7 + 1).cast("int"))
    name = F.concat("p_brand", F.element_at(suffix, (F.floor(k / 7) % 4 + 1).cast("int")), F.when(k % 17 == 5, T.CLOSED).otherwise(""))
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 5 != 0, F.concat(F.lit("u"), (k % 1777).cast("string"))).alias("uid"), k.alias("seq"), category.alias("category"), name.alias("name"),
        F.when(k % 7 == 3, F.when(F.floor(k / 7) % 4 == 0, "kindergarten").otherwise("school")).alias("edu_kind"), F.when(k % 7 == 6, F.when(k % 3 == 0, "metro").otherwise("bus")).alias("transport_kind"),
        F.when(k % 11 == 0, "购物;商铺").when(k % 13 == 0, "旅游景点;公园").alias("tag"), F.when((k % 35 == 0) & (k > 28), k - 28).otherwise(k).alias("spot"),
    )
    return located(rows, "spot", spark, sf_dir, wide, spread).drop("spot")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes that a routing service has measured for some requests and places: a customer's orders of a part."""
    return measured_once(spark, sf_dir).groupBy("request_id", "id").agg(F.min("measured_min").alias("measured_min"))


def measured_once(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """Each time that minutes were measured, of which measured() is the least; only those of requests (request_id, ...) and with their columns, if asked."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("request_id"))
    orders = orders if asked is None else orders.join(asked.hint("merge"), "request_id")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("id"), (1 + F.col("l_quantity") % 20).alias("measured_min"))
    return lines.join(orders.hint("merge"), "l_orderkey").drop("l_orderkey")


def community(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("district"), F.col("c_acctbal").alias("sale_avg"))
    return located(rows, "id", spark, sf_dir, wide)


def request(spark: SparkSession, sf_dir: str, wide: bool = False, varied: bool = False, spread: bool = False) -> DataFrame:
    """Every customer asks what can be reached on foot in 15 minutes, or in 5 to 30 if varied."""
    k = F.col("c_custkey")
    minutes = (5 + k % 26).cast("int") if varied else F.lit(15)
    rows = table(spark, sf_dir, "customer").select(k.alias("request_id"), minutes.alias("minutes"))
    return located(rows, "request_id", spark, sf_dir, wide, spread)


def hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return located(table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.when(k % 3 == 0, "metro").otherwise("bus").alias("kind")), "id", spark, sf_dir)


def click(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), "user_id", spark, sf_dir)


def lattice_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """67 by 50 nodes times the town's side, one for each cell of 100 units; nid = STEP i + j."""
    side = town_side(spark, sf_dir)
    grid = spark.range(67 * 50 * side * side).select((F.col("id") % (67 * side)).alias("i"), F.floor(F.col("id") / (67 * side)).alias("j"))
    return grid.select((F.col("i") * STEP + F.col("j")).alias("nid"), "i", "j", ((F.col("i") * 100 + 50) * KX).alias("x"), ((F.col("j") * 100 + 50) * KY).alias("y"))


def lattice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets between neighbours, in whole seconds. A river above every row 24 of 50 is crossed by a bridge in every 20th column."""
    side = town_side(spark, sf_dir)
    nodes = lattice_nodes(spark, sf_dir)
    i, j = F.col("i"), F.col("j")
    east = nodes.where(i < 67 * side - 1).select(F.col("nid").alias("u"), (F.col("nid") + STEP).alias("v"), (60 + (31 * i + 17 * j) % 40).cast("int").alias("w"), F.lit("road").alias("kind"))
    bridge = (j % 50 == 24) & (i % 20 == 10)
    north = nodes.where((j < 50 * side - 1) & ((j % 50 != 24) | bridge)).select(F.col("nid").alias("u"), (F.col("nid") + 1).alias("v"), (60 + (13 * i + 29 * j) % 40).cast("int").alias("w"), F.when(bridge, "bridge").otherwise("road").alias("kind"))
    return east.unionByName(north)


def node_place(nid: Column) -> tuple[Column, Column]:
    """x, y of a lattice node."""
    return (F.floor(nid / STEP) * 100 + 50) * KX, (nid % STEP * 100 + 50) * KY


def node_of(xi: Column, yi: Column) -> Column:
    """The lattice node of a point of the town."""
    return F.floor(xi / 100) * STEP + F.floor(yi / 100)


# The same tables as common table expressions, for the oracle queries.

def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _located_sql(inner: str, key: str, wide: bool = False, spread: bool = False) -> str:
    mx, my, lng0, lat0 = (67000, 50000, 116.05, 39.68) if wide else (6700, 5000, LNG0, LAT0)
    mx, my = (mx, my) if wide else (f"(SELECT {m * (3 if spread else 1)} * s FROM town)" for m in (mx, my))
    return (
        f"SELECT *, CAST({lng0} AS DOUBLE) + xi / CAST(100000 AS DOUBLE) AS lng, CAST({lat0} AS DOUBLE) + yi / CAST(100000 AS DOUBLE) AS lat, xi * CAST({KX!r} AS DOUBLE) AS x, yi * CAST({KY!r} AS DOUBLE) AS y "
        f"FROM (SELECT *, CAST({key} AS BIGINT) * 7919 % {mx} AS xi, CAST({key} AS BIGINT) * 104729 % {my} AS yi FROM ({inner}))"
    )


_POI = (
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN 'u' || (p_partkey % 1777) END AS uid, p_partkey AS seq, "
    f"{_list(C.CATEGORIES)}[p_partkey % 7 + 1] AS category, p_brand || (CASE p_partkey % 7 {' '.join(f'WHEN {i} THEN {_list(SUFFIXES[c])}' for i, c in enumerate(C.CATEGORIES))} END)[(p_partkey // 7) % 4 + 1] || CASE WHEN p_partkey % 17 = 5 THEN '已关闭' ELSE '' END AS name, "
    "CASE WHEN p_partkey % 7 = 3 THEN CASE WHEN (p_partkey // 7) % 4 = 0 THEN 'kindergarten' ELSE 'school' END END AS edu_kind, "
    "CASE WHEN p_partkey % 7 = 6 THEN CASE WHEN p_partkey % 3 = 0 THEN 'metro' ELSE 'bus' END END AS transport_kind, "
    "CASE WHEN p_partkey % 11 = 0 THEN '购物;商铺' WHEN p_partkey % 13 = 0 THEN '旅游景点;公园' END AS tag, CASE WHEN p_partkey % 35 = 0 AND p_partkey > 28 THEN p_partkey - 28 ELSE p_partkey END AS spot FROM part"
)
_MEASURED = "SELECT o_custkey AS request_id, l_partkey AS id, min(1 + l_quantity % 20)::DOUBLE AS measured_min FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2"
_COMMUNITY = "SELECT c_custkey AS id, c_name AS name, c_nationkey AS district, c_acctbal AS sale_avg FROM customer"
_REQUEST = "SELECT c_custkey AS request_id, {m} AS minutes FROM customer"
_TOWN = f"SELECT CAST(greatest(1, ceil(sqrt(count(*) / {PLACES}.0))) AS BIGINT) AS s FROM part"
_GRID = "(SELECT unnest(range({a})) AS i FROM town) a, (SELECT unnest(range({b})) AS j FROM town) b"
_NODES = f"SELECT i * {STEP} + j AS nid, i, j, (i * 100 + 50) * CAST({KX!r} AS DOUBLE) AS x, (j * 100 + 50) * CAST({KY!r} AS DOUBLE) AS y FROM {_GRID.format(a='67 * s', b='50 * s')}"
_EDGES = (
    f"SELECT i * {STEP} + j AS u, (i + 1) * {STEP} + j AS v, CAST(60 + (31 * i + 17 * j) % 40 AS INTEGER) AS w, 'road' AS kind FROM {_GRID.format(a='67 * s - 1', b='50 * s')} UNION ALL "
    f"SELECT i * {STEP} + j, i * {STEP} + j + 1, CAST(60 + (13 * i + 29 * j) % 40 AS INTEGER), CASE WHEN j % 50 = 24 THEN 'bridge' ELSE 'road' END FROM {_GRID.format(a='67 * s', b='50 * s - 1')} WHERE j % 50 <> 24 OR i % 20 = 10"
)

SQL = {
    "town": _TOWN, "poi": _located_sql(_POI, "spot"), "poi_wide": _located_sql(_POI, "spot", True), "poi_spread": _located_sql(_POI, "spot", spread=True), "measured": _MEASURED, "request_spread": _located_sql(_REQUEST.format(m="15"), "request_id", spread=True), "community": _located_sql(_COMMUNITY, "id"), "community_wide": _located_sql(_COMMUNITY, "id", True),
    "request": _located_sql(_REQUEST.format(m="15"), "request_id"), "request_wide": _located_sql(_REQUEST.format(m="15"), "request_id", True),
    "request_varied": _located_sql(_REQUEST.format(m="CAST(5 + c_custkey % 26 AS INTEGER)"), "request_id"), "lattice_node": _NODES, "lattice_edge": _EDGES,
    "hub": _located_sql("SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'metro' ELSE 'bus' END AS kind FROM supplier", "id"),
    "click": _located_sql("SELECT event_id, ts, user_id, event_type, value FROM events", "user_id"),
}


def with_sql(names: str, rest: str) -> str:
    """A query over derived tables: their common table expressions, then `rest`, which may begin with more of them."""
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in ["town", *names.split()])
    more = rest.strip()
    return f"WITH RECURSIVE {head}" + (f", {more[1:]}" if more.startswith(",") else f" {more}")
