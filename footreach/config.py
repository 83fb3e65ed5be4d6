"""Constants that define what the operators compute, in one place."""

import math

# Speeds in metres a minute, radii and sizes in metres, weights of the score.
EARTH_RADIUS_M = 6371008.8
M_PER_DEG = math.pi / 180 * EARTH_RADIUS_M
WALK_SPEED, STEPS_SPEED, CORRIDOR_SPEED, MALL_FACTOR = 70.0, 44.0, 60.0, 1.1
CIRCLE_SPEED = 80.0
SNAP_GRID_M, SNAP_MAX_M = 25.0, 30.0
CORRIDOR_LINK_M, CORRIDOR_HALF_M, CORRIDOR_HUB_M, CORRIDOR_LEAST_DIRECTIONS = 20.0, 50.0, 100.0, 3
EDGE_ACCESS_M, AREA_ATTACH_M, AREA_LEG_M, GAP_MERGE_M = 250.0, 60.0, 250.0, 15.0
CAP_PER_CATEGORY = 20
HEALTH_MERGE_M, UID_MERGE_M = 200.0, 30.0
BLIND_RADIUS_M, BLIND_CELL_M, CORRIDOR_ASPECT = 1000, 100, 3.0
BLIND_DISC_CELLS = sum(x * x + y * y <= 100 for x in range(-10, 11) for y in range(-10, 11))
COMMUNITY_RADIUS_M = 500.0
SNAPSHOT_RADIUS_M = 150.0
WEIGHTS = {"categories": 0.40, "anchors": 0.20, "anchor_minutes": 0.15, "transport": 0.15, "area": 0.10}
BUS_FACTOR = 0.6
CATEGORIES = ("convenience", "leisure", "mall", "education", "health", "public", "transport")
ANCHORS = ("convenience", "health", "education")
DIRECTIONS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
#: Degrees counter-clockwise from east; the order settles ties.
DIRECTION_ANGLES = {"E": 0.0, "NE": 45.0, "N": 90.0, "NW": 135.0, "W": 180.0, "SW": 225.0, "S": 270.0, "SE": 315.0}
TILE_PREFIX, TILE_LNG, TILE_LAT, TILE_LNG0, TILE_LAT0, TILE_PAD_M, TILE_M_PER_DEG = "b6r", 0.047, 0.036, 115.96, 39.64, 2200.0, 111320.0

#: Bounding boxes of cities: min and max longitude and latitude, in the order in which they are tried. Fixed values.
CITY_BOXES = {
    "北京": (115.4, 39.4, 117.6, 41.1),
    "上海": (120.8, 30.7, 122.2, 31.9),
    "杭州": (118.3, 29.2, 120.8, 30.7),
    "成都": (103.5, 30.0, 105.0, 31.4),
    "广州": (112.9, 22.6, 113.95, 23.9),
    "深圳": (113.75, 22.35, 114.65, 22.9),
}

#: The coarse ring-road polygon. Fixed values.
RING = [
    (116.100, 40.070), (116.200, 40.140), (116.330, 40.180), (116.460, 40.170), (116.580, 40.120), (116.660, 40.060), (116.710, 39.980), (116.720, 39.900), (116.700, 39.800),
    (116.660, 39.720), (116.550, 39.690), (116.420, 39.680), (116.300, 39.700), (116.190, 39.740), (116.120, 39.810), (116.060, 39.900), (116.050, 39.990), (116.070, 40.040),
]

# Street and area tags. Fixed values.
WALKABLE = (
    "primary secondary tertiary unclassified residential living_street pedestrian footway path steps cycleway track service corridor road bridleway "
    "primary_link secondary_link tertiary_link unclassified_link residential_link trunk_link"
).split()
BARRIER_HIGHWAYS = ["motorway", "trunk"]
TUNNEL_HIGHWAYS = ["footway", "path", "steps"]
TRUTHY = ["yes", "true", "1", "viaduct", "bridge"]
GREEN_LEISURE = ["park", "garden", "playground", "common", "pitch"]
GREEN_NATURAL = ["wood", "scrub"]
OPEN_LEISURE = ["park", "garden", "playground", "pitch", "common"]
OPEN_HIGHWAY = ["pedestrian", "footway", "path", "steps", "living_street"]
ENTERABLE_WORDS = ["商场", "购物中心", "超市", "菜市场", "shopping", "mall"]
HOT_TAGS = {"key_middle_school": "key_school", "key_primary": "key_school", "sanjia_hospital": "sanjia"}
