"""Geodetic and geometric column expressions. All stay in the JVM; none needs a UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footreach import config as C

# The coordinate systems' series. Fixed values of the public definitions.
GCJ_A, GCJ_EE = 6378245.0, 0.00669342162296594323
BD_PI = math.pi * 3000.0 / 180.0
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0))
    return 2 * C.EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def out_of_china(lng: Column, lat: Column) -> Column:
    return ~((lng > 73.66) & (lng < 135.05) & (lat > 3.86) & (lat < 53.55))


def overseas(lng: Column, lat: Column) -> Column:
    return (lng < 73.0) | (lng > 135.0) | (lat < 18.0) | (lat > 54.0)


def _waves(x: Column, *terms: tuple[float, float]) -> Column:
    """Two thirds of a sum of amplitudes times sines of x times pi over a divisor."""
    total = None
    for amplitude, divisor in terms:
        one = F.sin(x / divisor * math.pi) * amplitude
        total = one if total is None else total + one
    return total * (2.0 / 3.0)


def wgs_to_gcj(df: DataFrame, lng: str, lat: str, out_lng: str, out_lat: str) -> DataFrame:
    """Adds the shifted pair. The parts are columns of their own, so that the plan does not repeat them."""
    x, y = F.col("__x"), F.col("__y")
    root = F.sqrt(F.abs(x))
    common = _waves(x, (20.0, 1 / 6), (20.0, 1 / 2))
    dlat = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * root + common + _waves(y, (20.0, 1.0), (40.0, 3.0)) + _waves(y, (160.0, 12.0), (320.0, 30.0))
    dlng = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * root + common + _waves(x, (20.0, 1.0), (40.0, 3.0)) + _waves(x, (150.0, 12.0), (300.0, 30.0))
    rad = F.col(lat) / 180.0 * math.pi
    out = df.withColumns({"__x": F.col(lng) - 105.0, "__y": F.col(lat) - 35.0}).withColumns({"__dlat": dlat, "__dlng": dlng, "__m": 1.0 - GCJ_EE * F.sin(rad) * F.sin(rad)})
    abroad = out_of_china(F.col(lng), F.col(lat))
    moved_lat = F.col(lat) + F.col("__dlat") * 180.0 / ((GCJ_A * (1.0 - GCJ_EE)) / (F.col("__m") * F.sqrt("__m")) * math.pi)
    moved_lng = F.col(lng) + F.col("__dlng") * 180.0 / (GCJ_A / F.sqrt("__m") * F.cos(rad) * math.pi)
    return out.withColumns({out_lng: F.when(abroad, F.col(lng)).otherwise(moved_lng), out_lat: F.when(abroad, F.col(lat)).otherwise(moved_lat)}).drop("__x", "__y", "__dlat", "__dlng", "__m")


def gcj_to_wgs(df: DataFrame, lng: str, lat: str, out_lng: str, out_lat: str, rounds: int = 3) -> DataFrame:
    """The inverse, by fixed-point rounds."""
    out = df.withColumns({"__wlng": F.col(lng), "__wlat": F.col(lat)})
    for _ in range(rounds):
        out = wgs_to_gcj(out, "__wlng", "__wlat", "__glng", "__glat")
        out = out.withColumns({"__wlng": F.col("__wlng") + F.col(lng) - F.col("__glng"), "__wlat": F.col("__wlat") + F.col(lat) - F.col("__glat")})
    abroad = out_of_china(F.col(lng), F.col(lat))
    return out.withColumns({out_lng: F.when(abroad, F.col(lng)).otherwise(F.col("__wlng")), out_lat: F.when(abroad, F.col(lat)).otherwise(F.col("__wlat"))}).drop("__wlng", "__wlat", "__glng", "__glat")


def gcj_to_bd(lng: Column, lat: Column) -> tuple[Column, Column]:
    z = F.sqrt(lng * lng + lat * lat) + 0.00002 * F.sin(lat * BD_PI)
    theta = F.atan2(lat, lng) + 0.000003 * F.cos(lng * BD_PI)
    return z * F.cos(theta) + 0.0065, z * F.sin(theta) + 0.006


def bd_to_gcj(lng: Column, lat: Column) -> tuple[Column, Column]:
    x, y = lng - 0.0065, lat - 0.006
    z = F.sqrt(x * x + y * y) - 0.00002 * F.sin(y * BD_PI)
    theta = F.atan2(y, x) - 0.000003 * F.cos(x * BD_PI)
    return z * F.cos(theta), z * F.sin(theta)


def local_xy(lng: Column, lat: Column, lng0: float, lat0: float) -> tuple[Column, Column]:
    """Metres east and north of a centre."""
    return (lng - lng0) * (C.M_PER_DEG * math.cos(math.radians(lat0))), (lat - lat0) * C.M_PER_DEG


def local_lnglat(x: Column, y: Column, lng0: float, lat0: float) -> tuple[Column, Column]:
    return x / (C.M_PER_DEG * math.cos(math.radians(lat0))) + lng0, y / C.M_PER_DEG + lat0


def planar_distance(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """The map's own metres, with the mean latitude's cosine."""
    dx = (lng1 - lng2) * 111320.0 * F.cos((lat1 + lat2) / 2 * (math.pi / 180))
    dy = (lat1 - lat2) * 110540.0
    return F.sqrt(dx * dx + dy * dy)


def _lattice(value: Column, low: float, span: float, bits: int) -> Column:
    at = F.floor((value - low) / span * float(1 << bits)).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(at, F.lit((1 << bits) - 1).cast("long")))


def geohash5(lng: Column, lat: Column) -> Column:
    """Five characters: 13 bits of longitude and 12 of latitude, interleaved, longitude first."""
    x, y = _lattice(lng, -180.0, 360.0, 13), _lattice(lat, -90.0, 180.0, 12)
    chars = []
    for k in range(5):
        code = F.lit(0).cast("long")
        for bit in range(5 * k, 5 * k + 5):
            source, at = (x, 12 - bit // 2) if bit % 2 == 0 else (y, 11 - bit // 2)
            code = code * 2 + F.shiftright(source, at).bitwiseAND(F.lit(1).cast("long"))
        chars.append(F.substr(F.lit(GEOHASH), (code + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def tile_of(lng: Column, lat: Column) -> tuple[Column, Column]:
    """(row, col) of the tile lattice; fractions are cut toward zero."""
    return ((lat - C.TILE_LAT0) / C.TILE_LAT).cast("int"), ((lng - C.TILE_LNG0) / C.TILE_LNG).cast("int")


def tile_name(row: Column, col: Column) -> Column:
    pad = lambda x: F.when(x.between(0, 9), F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.concat(F.lit(f"{C.TILE_PREFIX}_r"), pad(row), F.lit("c"), pad(col))


def parse_tile(name: Column) -> tuple[Column, Column]:
    pattern = f"^{C.TILE_PREFIX}_r(-?[0-9]+)c(-?[0-9]+)$"
    return tuple(F.regexp_extract(name, pattern, k).try_cast("int") for k in (1, 2))


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point is in a polygon of constant corners or on its edge."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        side = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        on_edge = on_edge | ((side == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            at = (x2 - x1) * (y - y1) / (y2 - y1) + x1
            crossings = crossings + F.when(((y >= min(y1, y2)) & (y < max(y1, y2))) & (x < at), 1).otherwise(0)
    return on_edge | (crossings % 2 == 1)


def city_of(lng: Column, lat: Column) -> Column:
    """The first city whose box holds the point, borders included."""
    found = F.lit(None).cast("string")
    for city, (x0, y0, x1, y1) in reversed(C.CITY_BOXES.items()):
        found = F.when(lng.between(x0, x1) & lat.between(y0, y1), city).otherwise(found)
    return found


def layer_minutes(minutes: Column) -> Column:
    """The time layers of a request: three lower steps at most, and its own minutes."""
    lower = F.filter(F.array(*map(F.lit, (5, 10, 15, 20))), lambda m: m < minutes)
    return F.when(minutes <= 5, F.array(F.lit(3), F.lit(5))).otherwise(F.concat(F.when(F.size(lower) > 3, F.slice(lower, F.size(lower) - 2, 3)).otherwise(lower), F.array(minutes)))


def direction8(dx: Column, dy: Column) -> Column:
    """The compass direction of a vector; halfway, the one that comes first in the fixed order."""
    angle = F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))
    away = lambda a: F.abs(F.pmod(angle - a + 180.0, F.lit(360.0)) - 180.0)
    options = F.array(*(F.struct(away(a).alias("away"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, a) in enumerate(C.DIRECTION_ANGLES.items())))
    return F.array_min(options)["name"]


def recall_radius(minutes: Column) -> Column:
    return F.greatest(F.lit(1500.0), F.least(F.lit(2000.0), minutes * 135.0))


def cache_key(lng: Column, lat: Column, minutes: Column, engine: Column) -> Column:
    return F.concat_ws("_", *(F.round(c * 1e5).cast("long").cast("string") for c in (lng, lat)), minutes.cast("string"), engine)


def zoom_step(minutes: Column, speed: float = 72.0) -> Column:
    r = minutes * speed
    zoom = F.lit(14.5)
    for limit, value in ((1800, 15.0), (1300, 15.5), (900, 16.0), (620, 16.5), (400, 17.0)):
        zoom = F.when(r <= limit, F.lit(value)).otherwise(zoom)
    return zoom


def proximity_score(nearest: Column, minutes: Column) -> Column:
    """0 to 100 by how near the nearest facility of a category is; null without one."""
    r = nearest / F.greatest(F.lit(1.0), minutes.cast("double"))
    value = F.when(r <= 1 / 3, 100.0).when(r <= 1, 100 - 60 * (r - 1 / 3)).otherwise(60 - 60 * (r - 1))
    return F.when(nearest.isNotNull(), F.greatest(F.lit(15), F.floor(value + 0.5).cast("int")))
