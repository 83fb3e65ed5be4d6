"""Queries for what stands around the engine: which requests are answered, from what, and with which facilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from footreach import config as C
from footreach.functions import sql, text
from footreach.operators import graph as G
from footreach.operators import spatial as S
from footreach.plans import graphs, joins
from footreach.plans.registry import query
from footreach.plans.scalar import GROUP_SQL, r6
from footreach.sources import derived as D
from footreach.sources.derived import with_sql

KINDS = ["rail", "motorway", "trunk", "subway"]


@query(f"SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN map {{'highway': {D._list(KINDS)}[p_partkey % 4 + 1]}} ELSE map {{'railway': {D._list(KINDS)}[p_partkey % 4 + 1]}} END['railway'] AS kind FROM part WHERE p_partkey % 3 <> 0")
def barrier_relevant(spark, sf_dir):
    """Barriers that can block a way: those with a highway key never do."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % 4 + 1).cast("int"))
    rows = D.table(spark, sf_dir, "part").select(k.alias("id"), F.create_map(F.when(k % 3 == 0, "highway").otherwise("railway"), kind).alias("props"))
    return rows.where(~F.map_contains_key("props", "highway")).select("id", F.col("props")["railway"].alias("kind"))


GREEN_NAMES = ["朝阳公园", "南园", "足球场", "绿地", "森林公园"]
GREEN_SQL = f", face AS (SELECT *, {D._list(GREEN_NAMES)}[box % 5 + 1] AS name, CASE WHEN box % 7 = 0 THEN 'pitch' ELSE 'park' END AS leisure FROM ({joins.BOXES_SQL}))"


@query(with_sql("request", GREEN_SQL + f" SELECT request_id, box, name, round({joins.BOXD}, 3) AS d FROM request, face WHERE leisure <> 'pitch' AND (x1 - x0) * (y1 - y0) >= 400 AND (regexp_matches(name, '{text.PUBLIC_CORE}') OR ends_with(name, '园')) AND {joins.BOXD} <= 800"))
def green_backfill(spark, sf_dir):
    """Named parks within 800 m of a request, from its point to their faces, which stand in for places that are missing."""
    name = F.element_at(F.array(*map(F.lit, GREEN_NAMES)), (F.col("box") % 5 + 1).cast("int"))
    faces = joins.boxes(spark, sf_dir).withColumns({"name": name, "leisure": F.when(F.col("box") % 7 == 0, "pitch").otherwise("park")})
    named = F.col("name").rlike(text.PUBLIC_CORE) | F.endswith("name", F.lit("园"))
    fits = faces.where((F.col("leisure") != "pitch") & ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= 400) & named)
    near = joins.near_boxes(D.request(spark, sf_dir).select("request_id", "x", "y"), fits, 800.0)
    return near.join(fits.select("box", "name"), "box").select("request_id", "box", "name", F.round("d", 3).alias("d"))


ASKED_SQL = "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN ['market'] ELSE ['school', 'market'] END"


@query(f"WITH q AS (SELECT c_custkey AS request_id, {ASKED_SQL} AS f FROM customer) SELECT request_id, g AS grp FROM q, (VALUES ('market'), ('pharmacy'), ('school')) t(g) WHERE f IS NULL OR list_contains(f, g)")
def blind_filter(spark, sf_dir):
    """The groups whose blind spots a request asks for: all without a filter, none with an empty one, else those named."""
    k = F.col("c_custkey")
    none, one, two = F.lit(None).cast("array<string>"), F.array(F.lit("market")), F.array(F.lit("school"), F.lit("market"))
    asked = D.table(spark, sf_dir, "customer").select(k.alias("request_id"), F.when(k % 4 == 0, none).when(k % 4 == 1, F.array().cast("array<string>")).when(k % 4 == 2, one).otherwise(two).alias("f"))
    every = asked.withColumn("grp", F.explode(F.array(*map(F.lit, ("market", "pharmacy", "school")))))
    return every.where(F.col("f").isNull() | F.array_contains("f", F.col("grp"))).select("request_id", "grp")


BODY_SQL = "SELECT c_custkey AS request_id, CAST(c_custkey % 37 AS INTEGER) AS minutes, 60.0::DOUBLE + c_custkey % 90 AS lng, 10.0::DOUBLE + c_custkey % 50 AS lat, ['fast', 'full', 'slow', NULL][c_custkey % 4 + 1] AS phase FROM customer"


@query(f"WITH q AS ({BODY_SQL}) SELECT request_id, array_to_string(list_filter([CASE WHEN minutes NOT BETWEEN 5 AND 30 THEN 'minutes' END, CASE WHEN phase IS NULL OR phase NOT IN ('fast', 'full') THEN 'phase' END, CASE WHEN lng < 73 OR lng > 135 OR lat < 18 OR lat > 54 THEN 'overseas' END], lambda x: x IS NOT NULL), ',') AS errors FROM q")
def request_check(spark, sf_dir):
    """What is wrong with each request: those with errors are set aside with all of them named, the others have none."""
    k = F.col("c_custkey")
    phase = F.element_at(F.array(F.lit("fast"), F.lit("full"), F.lit("slow"), F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    body = D.table(spark, sf_dir, "customer").select(k.alias("request_id"), (k % 37).cast("int").alias("minutes"), (60.0 + k % 90).alias("lng"), (10.0 + k % 50).alias("lat"), phase.alias("phase"))
    errors = request_errors(F.col("minutes"), F.col("phase"), F.col("lng"), F.col("lat"))
    return body.select("request_id", F.array_join(errors, ",").alias("errors"))


def request_errors(minutes, phase, lng, lat):
    from footreach.functions import geo

    ok = lambda x: F.coalesce(x, F.lit(False))
    every = F.array(F.when(~ok(minutes.between(5, 30)), "minutes"), F.when(~ok(phase.isin("fast", "full")), "phase"), F.when(ok(geo.overseas(lng, lat)), "overseas"))
    return F.filter(every, lambda x: x.isNotNull())


SHOT_SQL = ", shot(sample, minutes) AS (SELECT sample, m FROM (VALUES (1), (2), (3), (4)) s(sample), (VALUES (5), (10), (15), (20)) t(m) WHERE m = 15 OR (sample + m) % 3 = 0)"


@query(
    with_sql("request_varied", ", s(sample, lng2, lat2) AS (VALUES " + ", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE)" for k, x, y in joins.SAMPLES) + f"){SHOT_SQL}, n AS (SELECT request_id, minutes, arg_min(sample, {joins.HAV}) AS sample, min({joins.HAV}) AS d FROM request_varied, s GROUP BY 1, 2) "
    "SELECT n.request_id, n.sample, coalesce(e.minutes, 15) AS served, e.minutes IS NULL AS rewritten FROM n LEFT JOIN shot e ON e.sample = n.sample AND e.minutes = n.minutes WHERE d <= 1500")
)
def snapshot_choice(spark, sf_dir):
    """The stored result that answers a request near a sample: that of its minutes, else the one of 15, with a note. The
    distance is wider than in service, so that there are some."""
    from footreach.functions import geo

    options = F.array(*(F.struct(geo.haversine(F.col("lng"), F.col("lat"), F.lit(x), F.lit(y)).alias("d"), F.lit(k).alias("sample")) for k, x, y in joins.SAMPLES))
    near = D.request(spark, sf_dir, varied=True).select("request_id", "minutes", F.array_min(options).alias("m")).where("m.d <= 1500").select("request_id", "minutes", "m.sample")
    shots = spark.createDataFrame([(k, m) for k, _, _ in joins.SAMPLES for m in (5, 10, 15, 20) if m == 15 or (k + m) % 3 == 0], "sample int, served int")
    exact = (near["sample"] == shots["sample"]) & (near["minutes"] == shots["served"])
    return near.join(shots, exact, "left").select("request_id", near["sample"], F.coalesce("served", F.lit(15)).alias("served"), F.col("served").isNull().alias("rewritten"))


@query(
    with_sql("request lattice_node lattice_edge", f", near AS (SELECT request_id, nid, d FROM (SELECT request_id, nid, {joins.DIST} AS d, row_number() OVER (PARTITION BY request_id ORDER BY {joins.DIST}, nid) AS k FROM request a JOIN lattice_node b ON {joins.DIST} <= 90) WHERE k = 1), "
    f"n AS (SELECT near.*, count(*) AS streets, min(w) AS least FROM near JOIN (SELECT u, w FROM lattice_edge UNION ALL SELECT v, w FROM lattice_edge) e ON e.u = nid GROUP BY ALL) SELECT request_id, nid, round(d / {C.WALK_SPEED}::DOUBLE * 60, 6) AS detour_s, streets, least FROM n")
)
def start_node(spark, sf_dir):
    """Where a walk begins: the nearest node within 90 m, the seconds to it, which the costs from there leave out, and its
    streets. Requests without a node have no row."""
    pairs = S.radius_join(D.request(spark, sf_dir).select("request_id", "x", "y"), joins.as2(D.lattice_nodes(spark, sf_dir), nid="nid"), 90.0)
    near = S.nearest(pairs, "request_id", [F.col("d"), F.col("nid")], ["nid", "d"])
    ends = D.lattice_edges(spark, sf_dir).select("w", F.explode(F.array("u", "v")).alias("nid")).groupBy("nid").agg(F.count("*").alias("streets"), F.min("w").alias("least"))
    return near.join(S.shuffled(ends), "nid").select("request_id", "nid", r6(F.col("d") / C.WALK_SPEED * 60).alias("detour_s"), "streets", "least")


@query(with_sql("request lattice_edge", graphs.COST_SQL + " SELECT request_id, arg_min(nid, [cost_s, nid]) AS nid FROM cost GROUP BY 1"))
def least_cost_node(spark, sf_dir):
    """The node of the least cost, the first of equal ones: the one that the search began at."""
    return G.least_found(graphs.costs(spark, sf_dir))


@query(with_sql("poi", f", n AS (SELECT id, category, name, lng, lat FROM poi) SELECT id, {GROUP_SQL} AS grp, lng < 73 OR lng > 135 OR lat < 18 OR lat > 54 AS abroad FROM n"))
def sql_functions(spark, sf_dir):
    """The registered SQL functions, called from SQL."""
    sql.register(spark)
    return spark.sql("SELECT id, blind_group(category, name) AS grp, overseas(lng, lat) AS abroad FROM {places}", places=D.poi(spark, sf_dir))
