"""Queries that prepare tables, and reports over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from footreach import config as C
from footreach.functions import text
from footreach.operators import spatial as S
from footreach.operators.spatial import shuffled
from footreach.plans import joins, ranking
from footreach.plans.registry import query
from footreach.plans.scalar import WS, r6
from footreach.sources import derived as D
from footreach.sources import geojson
from footreach.sources.derived import with_sql
from footreach.streaming import clicks


@query("SELECT o_custkey AS region, count(*) AS features, round(min((o_orderkey * 7919 % 6700)::DOUBLE), 6) AS x0, round(max((o_orderkey * 104729 % 5000)::DOUBLE), 6) AS y1, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1")
def scan_features(spark, sf_dir):
    """Each customer's orders as a GeoJSON text, read back into features; one without geometry is left out."""
    x, y = (c.cast("double") for c in D.units(F.col("o_orderkey")))
    point = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.array(F.array(x, y), F.array(x, y)).alias("coordinates")).alias("geometry"), F.struct(F.col("o_orderpriority").alias("class")).alias("properties")))
    rows = D.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("region")).agg(F.concat(F.lit('{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": null, "properties": {}},'), F.concat_ws(",", F.collect_list(point)), F.lit("]}")).alias("value"))
    found = geojson.features(rows).withColumn("points", geojson.line_points(F.col("coordinates")))
    x0, _, _, y1 = geojson.bounds(F.col("points"))
    return found.groupBy("region").agg(F.count("*").alias("features"), r6(F.min(x0)).alias("x0"), r6(F.max(y1)).alias("y1"), F.count_if(F.col("properties")["class"] == "1-URGENT").alias("urgent"))


@query(with_sql("community", " SELECT district AS region, round(min(lng), 6) AS min_lng, round(min(lat), 6) AS min_lat, round(max(lng), 6) AS max_lng, round(max(lat), 6) AS max_lat, count(*) AS features FROM community GROUP BY 1"))
def region_bbox(spark, sf_dir):
    ends = [r6(f(c)).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lng", "lat")]
    return D.community(spark, sf_dir).groupBy(F.col("district").alias("region")).agg(*ends, F.count("*").alias("features"))


FOOT_SQL = f", b AS (SELECT id, x, y, (id % 40 + 5) * (id % 23 + 5)::DOUBLE AS area FROM poi), box AS ({joins.BOXES_SQL}), f AS (SELECT box, any_value((x1 - x0) * (y1 - y0)) AS face, coalesce(sum(area), 0) AS built FROM box LEFT JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY box)"


@query(with_sql("poi", FOOT_SQL + " SELECT box, round(built / face, 6) AS ratio, face < 150000 OR built / face >= 0.01 AS dropped FROM f"))
def footprint_ratio(spark, sf_dir):
    """Residential faces and how much of them buildings cover: small or well built ones are dropped."""
    area = (F.col("id") % 40 + 5) * (F.col("id") % 23 + 5).cast("double")
    faces = joins.boxes(spark, sf_dir)
    inside = S.bbox_join(D.poi(spark, sf_dir).select("x", "y", area.alias("area")), faces, 400.0).groupBy("box").agg(F.sum("area").alias("built"))
    face = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    out = faces.select("box", face.alias("face")).join(inside, "box", "left").withColumn("ratio", F.coalesce("built", F.lit(0.0)) / F.col("face"))
    return out.select("box", r6("ratio").alias("ratio"), ((F.col("face") < 150_000) | (F.col("ratio") >= 0.01)).alias("dropped"))


PAD = C.TILE_PAD_M / C.TILE_M_PER_DEG


@query(
    with_sql("poi_wide", f", f AS (SELECT id, lng AS x0, lat AS y0, lng + (id % 50) / 1000.0::DOUBLE AS x1, lat + (id % 30) / 1000.0::DOUBLE AS y1 FROM poi_wide), t AS (SELECT r, c, {C.TILE_LNG0} + c * {C.TILE_LNG}::DOUBLE AS tx0, {C.TILE_LAT0} + r * {C.TILE_LAT}::DOUBLE AS ty0 FROM range(-2, 24) a(r), range(-2, 24) b(c)), "
    f"i AS (SELECT id, CAST(floor((x0 - {PAD!r}::DOUBLE - {C.TILE_LNG0}::DOUBLE) / {C.TILE_LNG}::DOUBLE) AS INTEGER) AS c0, CAST(floor((x1 + {PAD!r}::DOUBLE - {C.TILE_LNG0}::DOUBLE) / {C.TILE_LNG}::DOUBLE) AS INTEGER) AS c1, CAST(floor((y0 - {PAD!r}::DOUBLE - {C.TILE_LAT0}::DOUBLE) / {C.TILE_LAT}::DOUBLE) AS INTEGER) AS r0, CAST(floor((y1 + {PAD!r}::DOUBLE - {C.TILE_LAT0}::DOUBLE) / {C.TILE_LAT}::DOUBLE) AS INTEGER) AS r1 FROM f) "
    "SELECT CAST(r AS INTEGER) AS tile_row, CAST(c AS INTEGER) AS tile_col, count(*) AS features FROM i JOIN t ON r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 GROUP BY 1, 2")
)
def tile_assign(spark, sf_dir):
    """How many features each padded tile gets; one on a border goes to several."""
    k = F.col("id")
    boxes = D.poi(spark, sf_dir, wide=True).select("id", F.col("lng").alias("x0"), F.col("lat").alias("y0"), (F.col("lng") + (k % 50) / 1000.0).alias("x1"), (F.col("lat") + (k % 30) / 1000.0).alias("y1"))
    tiles = S.covering_tiles(boxes, "x0", "y0", "x1", "y1", (C.TILE_LNG0, C.TILE_LAT0), (C.TILE_LNG, C.TILE_LAT), PAD)
    return tiles.groupBy(F.col("row").alias("tile_row"), F.col("col").alias("tile_col")).agg(F.count("*").alias("features"))


@query("WITH g AS (SELECT i, j, (i * 97 + j * 389 + i * j * 31) % 1000 AS u FROM range(60) a(i), range(60) b(j)) SELECT i, j, CASE WHEN j BETWEEN 28 AND 30 THEN CASE WHEN i IN (10, 30, 50) THEN 'bridge' ELSE 'water' END WHEN i % 6 = 0 OR j % 6 = 0 THEN 'road' WHEN u < 40 THEN 'mall' WHEN u < 90 THEN 'office' WHEN u < 150 THEN 'park' WHEN u < 600 THEN 'apartments' ELSE 'open' END AS kind FROM g")
def synth_grid(spark, sf_dir):
    """A made town on a grid of cells: a river with bridges, streets, and buildings drawn from a mixed key."""
    i, j = F.col("i"), F.col("j")
    g = spark.range(3600).select(F.floor(F.col("id") / 60).alias("i"), (F.col("id") % 60).alias("j")).withColumn("u", (i * 97 + j * 389 + i * j * 31) % 1000)
    u = F.col("u")
    kind = F.when(j.between(28, 30), F.when(i.isin(10, 30, 50), "bridge").otherwise("water")).when((i % 6 == 0) | (j % 6 == 0), "road").when(u < 40, "mall").when(u < 90, "office").when(u < 150, "park").when(u < 600, "apartments").otherwise("open")
    return g.select("i", "j", kind.alias("kind"))


TRY = "(request_id * 7919 + t * 104729 + c * 15485863) % 100003"


@query(
    with_sql("request", f", a AS (SELECT request_id, c, t, xi + ({TRY}) % 2401 - 1200 AS px, yi + ({TRY} * 7) % 2401 - 1200 AS py, xi, yi FROM request, range(3) b(c), range(30) d(t)), ok AS (SELECT *, row_number() OVER (PARTITION BY request_id, c ORDER BY t) AS n FROM a WHERE (px - xi) * (px - xi) + (py - yi) * (py - yi) <= 1440000 AND px BETWEEN 0 AND (SELECT 6700 * s - 1 FROM town) AND py BETWEEN 0 AND (SELECT 5000 * s - 1 FROM town)) "
    "SELECT request_id, CAST(c AS INTEGER) AS c, CAST(n AS INTEGER) AS n, px, py FROM ok WHERE n <= 2 + (request_id + c) % 3")
)
def synth_poi(spark, sf_dir):
    """Made places: tries at mixed offsets, those outside the circle or the town rejected, the first wanted ones kept."""
    tries = D.request(spark, sf_dir).select("request_id", "xi", "yi").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(29))))
    m = (F.col("request_id") * 7919 + F.col("t") * 104729 + F.col("c") * 15485863) % 100003
    rows = tries.withColumns({"px": F.col("xi") + m % 2401 - 1200, "py": F.col("yi") + (m * 7) % 2401 - 1200})
    dx, dy, side = F.col("px") - F.col("xi"), F.col("py") - F.col("yi"), D.town_side(spark, sf_dir)
    ok = rows.where((dx * dx + dy * dy <= 1_440_000) & F.col("px").between(0, 6700 * side - 1) & F.col("py").between(0, 5000 * side - 1))
    n = F.row_number().over(Window.partitionBy("request_id", "c").orderBy("t"))
    return ok.withColumn("n", n).where(F.col("n") <= 2 + (F.col("request_id") + F.col("c")) % 3).select("request_id", "c", "n", "px", "py")


@query(with_sql("lattice_node", " SELECT a.nid AS a, b.nid AS b FROM lattice_node a JOIN lattice_node b ON b.i = a.i + 1 AND b.j = a.j UNION ALL SELECT a.nid, b.nid FROM lattice_node a JOIN lattice_node b ON b.i = a.i AND b.j = a.j + 1"))
def grid_neighbor_pairs(spark, sf_dir):
    """Each node with its right and upper neighbour, the pairs that are sent to a router."""
    n = D.lattice_nodes(spark, sf_dir).select("nid")
    steps = n.select(F.col("nid").alias("a"), F.explode(F.array(F.col("nid") + D.STEP, F.col("nid") + 1)).alias("b"))
    return steps.join(n.select(F.col("nid").alias("b")), "b", "left_semi").select("a", "b")


HOT_LIST = ", h AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'key_middle_school' WHEN 1 THEN 'key_primary' WHEN 2 THEN 'sanjia_hospital' ELSE 'other' END AS type, 'No ' || (s_suppkey % 37) AS name, ['（' || (s_suppkey % 11) || '）', 'Alias ' || (s_suppkey % 13)] AS aliases FROM supplier)"


def hot_list(spark, sf_dir):
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("key_middle_school", "key_primary", "sanjia_hospital", "other"))), (k % 4 + 1).cast("int"))
    aliases = F.array(F.concat(F.lit("（"), (k % 11).cast("string"), F.lit("）")), F.concat(F.lit("Alias "), (k % 13).cast("string")))
    return D.table(spark, sf_dir, "supplier").select(k.alias("k"), kind.alias("type"), F.concat(F.lit("No "), (k % 37).cast("string")).alias("name"), aliases.alias("aliases"))


def norm_sql(x: str) -> str:
    return f"translate(regexp_replace(lower({x}), '{WS}', '', 'g'), '{text.DROPPED}', '')"


@query("WITH x AS (SELECT 1)" + HOT_LIST + f", n AS (SELECT CASE WHEN type = 'sanjia_hospital' THEN 'sanjia' ELSE 'key_school' END AS tag, {norm_sql('unnest(list_concat([name], aliases))')} AS norm FROM h WHERE type <> 'other') SELECT DISTINCT tag, norm FROM n WHERE length(norm) >= 3")
def hot_index(spark, sf_dir):
    """Known facilities' names and aliases by tag, normalised, the short ones left out."""
    tag = F.create_map(*(x for k, v in C.HOT_TAGS.items() for x in (F.lit(k), F.lit(v))))
    rows = hot_list(spark, sf_dir).where(F.col("type").isin(*C.HOT_TAGS)).select(tag[F.col("type")].alias("tag"), F.explode(F.concat(F.array("name"), "aliases")).alias("name"))
    return rows.select("tag", text.name_norm(F.col("name")).alias("norm")).where(F.char_length("norm") >= 3).distinct()


@query("WITH x AS (SELECT 1)" + HOT_LIST + f" SELECT type, {norm_sql('name')} AS norm, arg_min(name, k) AS name, array_to_string(list_sort(list_distinct(flatten(list(aliases)))), ',') AS aliases FROM h WHERE type <> 'other' GROUP BY 1, 2")
def alias_merge(spark, sf_dir):
    """Entries of one type and name become one: the first name, and all aliases in order."""
    rows = hot_list(spark, sf_dir).where(F.col("type").isin(*C.HOT_TAGS)).withColumn("norm", text.name_norm(F.col("name")))
    return rows.groupBy("type", "norm").agg(F.min_by("name", "k").alias("name"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))), ",").alias("aliases"))


RENT = "CASE WHEN c_acctbal > {0} OR c_custkey % {1} = 0 THEN {{'min': CASE WHEN c_acctbal > {0} THEN c_acctbal END, 'max': CASE WHEN c_custkey % {1} = 0 THEN c_custkey::DOUBLE END}} END"


@query(f"SELECT c_custkey AS id, c_name AS name, {{'l1': {RENT.format(5000, 7)}, 'l2': {RENT.format(8000, 11)}}} AS rent FROM customer")
def community_struct(spark, sf_dir):
    """A flat row as a nested one: a rent class is null if both its ends are."""

    def rent(limit: int, div: int):
        low = F.when(F.col("c_acctbal") > limit, F.col("c_acctbal"))
        high = F.when(F.col("c_custkey") % div == 0, F.col("c_custkey").cast("double"))
        return F.when(low.isNotNull() | high.isNotNull(), F.struct(low.alias("min"), high.alias("max")))

    return D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.struct(rent(5000, 7).alias("l1"), rent(8000, 11).alias("l2")).alias("rent"))


@query("WITH n AS (SELECT o_custkey AS id, arg_max(o_totalprice, [epoch_us(o_orderdate), o_orderkey]) AS score, max(o_orderdate) AS scored_at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey AS id, round(coalesce(score, c_acctbal), 6) AS score, scored_at FROM customer LEFT JOIN n ON id = c_custkey")
def score_merge(spark, sf_dir):
    """New scores put over old ones: the latest of each community, where there is one."""
    new = D.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("new"), F.max("o_orderdate").alias("scored_at"))
    old = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("old"))
    return old.join(new, "id", "left").select("id", r6(F.coalesce("new", "old")).alias("score"), "scored_at")


@query(with_sql("lattice_node lattice_edge", joins.SEG_SQL + " SELECT kind, count(*) AS features, round(sum(sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))) / 1000, 3) AS km FROM seg GROUP BY kind"))
def layer_stats(spark, sf_dir):
    metres = F.sqrt(F.pow(F.col("x1") - F.col("x2"), F.lit(2.0)) + F.pow(F.col("y1") - F.col("y2"), F.lit(2.0)))
    return joins.segments(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("features"), F.round(F.sum(metres) / 1000, 3).alias("km"))


@query("WITH n AS (SELECT s_nationkey AS grp, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r FROM supplier) SELECT grp, CAST(r // 10 AS INTEGER) AS batch, count(*) AS origins, min(k) AS first FROM n GROUP BY 1, 2")
def matrix_batches(spark, sf_dir):
    """Origins in batches of at most ten, group by group."""
    own = D.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("k"))
    n = F.row_number().over(Window.partitionBy("grp").orderBy("k")) - 1
    return own.withColumn("batch", F.floor(n / 10).cast("int")).groupBy("grp", "batch").agg(F.count("*").alias("origins"), F.min("k").alias("first"))


@query(with_sql("poi", " SELECT category, coalesce(transport_kind, edu_kind, '') AS kind, count(*) AS n FROM poi GROUP BY 1, 2"))
def type_counts(spark, sf_dir):
    return D.poi(spark, sf_dir).groupBy("category", F.coalesce("transport_kind", "edu_kind", F.lit("")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    with_sql("request poi", ranking.VIEW_SQL + ", " + ranking.select_sql("v") + ranking.COVER_SQL + ranking.SCORE_SQL + f", s AS (SELECT request_id, round(({ranking.POINTS}) * 100, 1) AS score FROM sums) SELECT c_nationkey AS nation, count(*) AS cases, round(avg(score), 3) AS mean, max(score) AS best, min(score) AS worst FROM s JOIN customer ON c_custkey = request_id GROUP BY 1")
)
def case_report(spark, sf_dir):
    """Scores by nation of the asking customer."""
    own = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("nation"))
    scores = ranking.life_score(spark, sf_dir).join(shuffled(own), "request_id")
    return scores.groupBy("nation").agg(F.count("*").alias("cases"), F.round(F.avg("score"), 3).alias("mean"), F.max("score").alias("best"), F.min("score").alias("worst"))


@query("WITH c AS (SELECT r_name AS region, n_name AS nation, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) SELECT region, nation, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM c GROUP BY ROLLUP (region, nation)")
def rollup_report(spark, sf_dir):
    """An extension: centres by region and nation, with subtotals."""
    nation, region = D.table(spark, sf_dir, "nation"), D.table(spark, sf_dir, "region")
    rows = D.table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("n"), r6(F.avg("c_acctbal")).alias("mean"))


@query(
    "WITH e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e) "
    'SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS clicks, round(sum(value), 6) AS total FROM s GROUP BY user_id, k'
)
def click_sessions(spark, sf_dir):
    """Sessions of clicks; the streaming form is in footreach.streaming."""
    return clicks.sessions(D.table(spark, sf_dir, "events"))


@query(
    "WITH RECURSIVE e AS (SELECT user_id, floor(epoch(ts) / 600) AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts) / 600)) AS k FROM events), b(user_id, k, tokens, last, passed) AS (SELECT user_id, k, 1.0::DOUBLE, t::DOUBLE, 1::BIGINT FROM e WHERE k = 1 "
    "UNION ALL SELECT e.user_id, e.k, CASE WHEN least(2.0, tokens + (t - last) * 0.25) >= 1 THEN least(2.0, tokens + (t - last) * 0.25) - 1 ELSE least(2.0, tokens + (t - last) * 0.25) END, t::DOUBLE, passed + CASE WHEN least(2.0, tokens + (t - last) * 0.25) >= 1 THEN 1 ELSE 0 END FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1) SELECT user_id, max(passed) AS passed, max(k) AS calls FROM b GROUP BY 1"
)
def token_bucket(spark, sf_dir):
    """How many of each user's calls a token bucket lets through (ten-minute ticks, a quarter token each)."""
    tick = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 / 600).cast("double")
    # calls of a tick are counted before a user's ticks meet in one row
    ticks = D.table(spark, sf_dir, "events").groupBy("user_id", tick.alias("t")).agg(F.count("*").alias("n"))
    own = ticks.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("ticks"), F.sum("n").alias("calls"))
    return own.select("user_id", clicks.tokens_left_by_tick(F.col("ticks"), 0.25, 2.0).alias("passed"), "calls")
