"""Queries with state on a stream, and over geometries of any nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footreach.functions import geo
from footreach.operators.graph import shared_path
from footreach.plans.registry import query
from footreach.plans.scalar import bd_sql, gcj_sql, r6
from footreach.sources import derived as D
from footreach.sources import geojson
from footreach.sources.derived import with_sql
from footreach.streaming import clicks

A_TOKEN_AN_HOUR = 1 / 3600
CALLS_SQL = "e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


def streamed(spark, sf_dir, respond) -> DataFrame:
    """What `respond` makes of the clicks as a stream, when all that is there has been read."""
    schema = D.table(spark, sf_dir, "events").schema
    calls = clicks.timed(clicks.click_stream(spark, f"{sf_dir}/event[s].parquet", schema))  # a pattern, as the table may be one file or a folder
    out = shared_path(spark)
    run = respond(calls).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query(
    f"WITH RECURSIVE {CALLS_SQL}, b(user_id, k, event_id, tokens, since, free, wait) AS (SELECT user_id, k, event_id, 0::DOUBLE, t, t, 0::DOUBLE FROM e WHERE k = 1 UNION ALL "
    f"SELECT user_id, k, event_id, CASE WHEN lv >= 1 THEN lv - 1 ELSE 0 END, now, now + w, now - t + w FROM (SELECT *, CASE WHEN lv >= 1 THEN 0 ELSE (1 - lv) / {A_TOKEN_AN_HOUR!r}::DOUBLE END AS w FROM (SELECT e.*, greatest(e.t, b.free) AS now, "
    f"least(1.0::DOUBLE, b.tokens + (greatest(e.t, b.free) - b.since) * {A_TOKEN_AN_HOUR!r}::DOUBLE) AS lv FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1))) SELECT user_id, event_id, round(wait, 3) AS wait_s FROM b"
)
def stream_waits(spark, sf_dir):
    """How long each click waits for its user's next token, one an hour: a stream with a bucket for each user as its state."""
    return streamed(spark, sf_dir, lambda c: clicks.waits(c, A_TOKEN_AN_HOUR)).select("user_id", "event_id", F.round("wait_s", 3).alias("wait_s"))


@query(
    f"WITH RECURSIVE {CALLS_SQL}, b(user_id, k, event_id, made, hit) AS (SELECT user_id, k, event_id, t, false FROM e WHERE k = 1 UNION ALL "
    "SELECT e.user_id, e.k, e.event_id, CASE WHEN e.t - b.made <= 86400 THEN b.made ELSE e.t END, e.t - b.made <= 86400 FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1) SELECT user_id, event_id, hit FROM b"
)
def stream_cache(spark, sf_dir):
    """Which clicks find an answer of the last day for their user: a stream with the cache as its state."""
    return streamed(spark, sf_dir, clicks.cache_hits).select("user_id", "event_id", "hit")


SHIFTS = ((0, 0), (70, 20), (50, 90), (-30, 60))  # from a community to the other points of its geometry, in units
_POINTS = (
    f"SELECT id, j, round(lng + {[a for a, _ in SHIFTS]}[j + 1] / 100000::DOUBLE, 6) AS plng, round(lat + {[b for _, b in SHIFTS]}[j + 1] / 100000::DOUBLE, 6) AS plat FROM community, range(4) t(j)"
)
_TEXTS = [
    ('"Point", "coordinates": ', "{0}"), ('"LineString", "coordinates": ', "[{0}, {1}]"), ('"Polygon", "coordinates": ', "[[{0}, {1}, {2}, {0}]]"), ('"MultiPolygon", "coordinates": ', "[[[{0}, {1}, {2}, {0}]], [[{3}, {2}, {1}, {3}]]]"),
    ('"GeometryCollection", "geometries": ', '[{{"type": "Point", "coordinates": {0}}}, {{"type": "GeometryCollection", "geometries": [{{"type": "MultiLineString", "coordinates": [[{1}, {2}], []]}}]}}]'), ('"LineString", "coordinates": ', "[]"),
]


def _pieces(template: str) -> list[str | int]:
    """A text with places in braces as its pieces: strings, and numbers of points."""
    import string

    return [x for literal, field, _, _ in string.Formatter().parse(template) for x in ([literal] if literal else []) + ([int(field)] if field else [])]


def _text_sql(head: str, template: str) -> str:
    return " || ".join(["'{\"type\": " + head + "'", *(f"s[{x + 1}]" if isinstance(x, int) else f"'{x}'" for x in _pieces(template)), "'}'"])


@query(
    with_sql("community", f", pt AS ({_POINTS}), g AS ({gcj_sql('SELECT * FROM pt', 'plng', 'plat', 'g')}), s AS (SELECT id, list('[' || round({bd_sql('g_lng', 'g_lat')[0]}, 6)::VARCHAR || ',' || round({bd_sql('g_lng', 'g_lat')[1]}, 6)::VARCHAR || ']' ORDER BY j) AS s FROM g GROUP BY id) "
    "SELECT id, CASE id % 6 " + " ".join(f"WHEN {i} THEN {_text_sql(*t)}" for i, t in enumerate(_TEXTS)) + " END AS geometry FROM s")
)
def geometry_to_bd(spark, sf_dir):
    """Geometries of all nestings, as GeoJSON texts, moved to the map's coordinates."""
    at = lambda a, b: F.concat(F.lit("["), F.round(F.col("lng") + a / 100_000, 6).cast("string"), F.lit(", "), F.round(F.col("lat") + b / 100_000, 6).cast("string"), F.lit("]"))
    text = lambda head, template: F.concat(F.lit('{"type": ' + head), *(at(*SHIFTS[x]) if isinstance(x, int) else F.lit(x) for x in _pieces(template)), F.lit("}"))
    geometry = F.coalesce(*(F.when(F.col("id") % 6 == i, text(*t)) for i, t in enumerate(_TEXTS)))

    def shift(df: DataFrame) -> DataFrame:
        lng, lat = geo.gcj_to_bd(F.col("glng"), F.col("glat"))
        return geo.wgs_to_gcj(df, "lng", "lat", "glng", "glat").withColumns({"lng": r6(lng), "lat": r6(lat)}).drop("glng", "glat")

    return geojson.transformed(D.community(spark, sf_dir).select("id", geometry.alias("geometry")), "geometry", shift)
