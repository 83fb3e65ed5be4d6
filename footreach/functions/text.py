"""Name and tag rules as string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from footreach import config as C

#: Characters that names are compared without. Fixed values.
DROPPED = "（）()[]【】「」『』·、,，。.-—_"

# Patterns of names and provider classes. Fixed values.
PUBLIC_CORE = "公园|花园|绿地|景区|湿地|滨河|河滨|健身园|广场"
PUBLIC_NOISE = (
    "办事处|管委会|政务|行政审批|社区服务(中心|站)|党群服务(中心|站)|街道活动中心|(购物|百货|商城|SOHO|写字楼|贸易|国际)广场"
    "|经贸|办公楼|写字楼|配楼|附楼|裙楼|[A-Z]\\d{0,2}座|[东南西北中]座|购物中心|超市|百货|商场"
    "|停车场|眼镜城|古玩|旧货|批发市场|建材城|健身(?!园)|俱乐部|私教|搏击|瑜伽"
)
PUBLIC_NOISE_TAG = "^(房地产|购物|公司企业|金融|交通设施|汽车服务|美食|餐饮|酒店|生活服务)"
TRANSPORT_NOISE = "出入口|出站口|停车场|[A-Z]\\d{0,2}[东南西北]口|地铁站.|酒店|饭店|宾馆"
MARKET, PHARMACY, SCHOOL = "菜场|菜市场|农贸市场|生鲜|超市", "药店|药房|医院|诊所|社区卫生服务", "小学"
SIDE_SUFFIX = "[(（](?:东行|西行|南行|北行|上行|下行)[)）]$"
STATION_SUFFIX = "[(（]?(?:地铁站|公交站|地铁|公交)[)）]?$"
CLOSED = "已关闭"


def strip(name: Column) -> Column:
    return F.regexp_replace(name, "(?U)^\\s+|\\s+$", "")


def name_norm(name: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "(?U)\\s", ""), DROPPED, "")


def station_base(name: Column) -> Column:
    """A station's name without direction, kind of station and brand; the whole name if nothing is left."""
    whole = strip(F.coalesce(name, F.lit("")))
    bare = strip(F.regexp_replace(strip(F.regexp_replace(whole, SIDE_SUFFIX, "")), STATION_SUFFIX, ""))
    short = strip(F.regexp_replace(bare, "^地铁(?=.)", ""))
    short = strip(F.regexp_replace(short, "站$", ""))
    return F.when((bare == "") | (short == ""), whole).otherwise(short)


def park_base(name: Column) -> Column:
    return F.regexp_replace(strip(F.coalesce(name, F.lit(""))), "(?U)[-－—–·•\\s]+", "")


def clinic_base(name: Column) -> Column:
    return strip(F.regexp_replace(strip(F.coalesce(name, F.lit(""))), "[-－—–].*$", ""))


def edu_stage(edu_kind: Column, name: Column) -> Column:
    return F.when(F.coalesce(edu_kind, F.lit("")) == "kindergarten", 0).when(F.coalesce(name, F.lit("")).contains("小学"), 1).otherwise(2)


def is_noise(category: Column, name: Column, tag: Column) -> Column:
    """Whether a place of a public or transport query is none."""
    own, tag = F.coalesce(name, F.lit("")), F.coalesce(tag, F.lit(""))
    public = (category == "public") & (own.rlike(PUBLIC_NOISE) | tag.rlike(PUBLIC_NOISE_TAG))
    return public | ((category == "transport") & own.rlike(TRANSPORT_NOISE))


def blind_group(category: Column, name: Column) -> Column:
    own = F.coalesce(name, F.lit(""))
    return (
        F.when(category.isin("convenience", "mall") & own.rlike(MARKET), "market")
        .when((category == "health") & own.rlike(PHARMACY), "pharmacy")
        .when((category == "education") & own.rlike(SCHOOL), "school")
    )


def enterability(props: dict[str, Column]) -> Column:
    """open, enterable, podium or blocked from a building's tags; absent tags are null."""
    get = lambda k: F.coalesce(props.get(k, F.lit(None).cast("string")), F.lit(""))
    words = F.lower(F.concat_ws(" ", get("name"), get("pois")))
    named = F.lit(False)
    for word in C.ENTERABLE_WORDS:
        named = named | words.contains(word)
    retail = get("ground_floor_retail").isin("yes", "true", "1")
    return (
        F.when(get("leisure").isin(C.OPEN_LEISURE) | get("highway").isin(C.OPEN_HIGHWAY), "open")
        .when(get("shop").isin("mall", "supermarket", "department_store") | (get("building") == "retail") | (get("amenity") == "marketplace") | named, "enterable")
        .when((get("building") == "office") & retail, "podium")
        .otherwise("blocked")
    )


def way_class(tags: dict[str, Column]) -> Column:
    """barrier, road or null (not kept) for a way."""
    get = lambda k: F.coalesce(tags[k], F.lit(""))
    tunnel = get("tunnel").isin("yes", "true", "1")
    closed = get("foot").isin("no", "private") | get("access").isin("no", "private")
    return (
        F.when(get("railway") == "rail", F.when(~tunnel, "barrier"))
        .when(get("highway").isin(C.BARRIER_HIGHWAYS), "barrier")
        .when(get("highway").isin(C.WALKABLE) & ~closed, "road")
    )


def area_class(tags: dict[str, Column]) -> Column:
    """building, water, green or residential, in this order, or null."""
    get = lambda k: F.coalesce(tags[k], F.lit(""))
    return (
        F.when(~get("building").isin("", "no"), "building")
        .when((get("natural") == "water") | (get("waterway") == "riverbank"), "water")
        .when(get("leisure").isin(C.GREEN_LEISURE) | get("natural").isin(C.GREEN_NATURAL) | (get("landuse") == "forest"), "green")
        .when(get("landuse") == "residential", "residential")
    )


def edge_kind(highway: Column, bridge: Column, tunnel: Column) -> Column:
    get = lambda c: F.coalesce(c, F.lit(""))
    return F.when(get(bridge).isin(C.TRUTHY), "bridge").when(get(tunnel).isin(C.TRUTHY) & get(highway).isin(C.TUNNEL_HIGHWAYS), "tunnel").otherwise("road")


def parse_path(path: Column) -> Column:
    """`lng,lat;lng,lat` as an array of points: pairs that are not numbers go, and points equal to the one before."""
    def point(pair: Column) -> Column:
        parts = F.split(pair, ",")
        return F.struct(F.get(parts, 0).try_cast("double").alias("lng"), F.get(parts, 1).try_cast("double").alias("lat"))

    points = F.filter(F.transform(F.split(path, ";"), point), lambda p: p["lng"].isNotNull() & p["lat"].isNotNull())
    start = F.array().cast("array<struct<lng:double,lat:double>>")
    return F.aggregate(points, start, lambda a, p: F.when((F.size(a) > 0) & (F.element_at(a, -1) == p), a).otherwise(F.concat(a, F.array(p))))


def parse_sector(text: Column) -> tuple[Column, Column]:
    """(direction, rest) of a line that may begin with `sector:XX `, in English or Chinese letters."""
    chinese = {"北": "N", "东北": "NE", "东": "E", "东南": "SE", "南": "S", "西南": "SW", "西": "W", "西北": "NW"}
    raw = F.regexp_extract(text, "^sector:([A-Z]{1,2}|[东南西北]{1,2})", 1)
    sector = F.when(raw.isin(list(C.DIRECTIONS)), raw)
    for k, v in chinese.items():
        sector = F.when(raw == k, v).otherwise(sector)
    return sector, F.when(sector.isNotNull(), F.regexp_replace(text, "^sector:(?:[A-Z]{1,2}|[东南西北]{1,2})\\s*", "")).otherwise(text)


def text_lines(text: Column, most: int = 6) -> Column:
    """The first lines of a generated text, trimmed, blank ones left out."""
    return F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, most)


def keyword_in(text: Column, words: list[str]) -> Column:
    """The first of the words that the text holds, or null."""
    found = F.lit(None).cast("string")
    for word in reversed(words):
        found = F.when(text.contains(word), word).otherwise(found)
    return found
