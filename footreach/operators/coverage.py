"""Coverage by category, the score, and the report's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footreach import config as C
from footreach.operators.spatial import shuffled

#: Names of the categories in reports. Fixed values.
CATEGORY_NAMES = {"convenience": "便利生活", "leisure": "娱乐休闲", "mall": "商超购物", "education": "学习教育", "health": "医疗养老", "public": "公共空间", "transport": "交通出行"}
DIRECTION_NAMES = {"N": "北", "NE": "东北", "E": "东", "SE": "东南", "S": "南", "SW": "西南", "W": "西", "NW": "西北"}


def category_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c) for k, c in enumerate(C.CATEGORIES)], "cat_no int, category string")


def passed(nearest: Column, minutes: Column) -> Column:
    return F.coalesce(nearest <= minutes, F.lit(False))


def coverage(requests: DataFrame, chosen: DataFrame, categories: DataFrame) -> DataFrame:
    """A row for each request and each of the seven categories, also those without a place.

    passed is the category's verdict: the nearest place in time, for everyday shops three of them, for transport a metro or
    a bus stop in time. nearest_minutes of transport is the metro's, if there is one. in_time is what the score counts: the
    nearest place alone."""
    kind = F.coalesce("transport_kind", F.lit("bus"))
    stop = lambda k: F.min(F.when((F.col("category") == "transport") & (kind == k), F.col("raw_min"))).alias(f"{k}_min")
    own = chosen.groupBy("request_id", "category").agg(
        F.count("*").cast("int").alias("cnt"), F.max("within_total").alias("within_count"), F.max("cat_total").alias("total"), F.min("raw_min").alias("any_min"), stop("metro"), stop("bus")
    )
    every = requests.select("request_id", "minutes").crossJoin(F.broadcast(categories))  # seven rows, fixed
    return verdicts(every.join(shuffled(own), ["request_id", "category"], "left"))


def verdicts(own: DataFrame, *more: str) -> DataFrame:
    """coverage() of rows that have been counted: request_id, minutes, category, cat_no, cnt, within_count, total, any_min, metro_min, bus_min; with
    more columns as they are."""
    travel = F.col("category") == "transport"
    rows = own.withColumn("nearest_minutes", F.when(travel, F.coalesce("metro_min", "bus_min")).otherwise(F.col("any_min")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    within = lambda c: passed(F.col(c), F.col("minutes"))
    in_time = within("nearest_minutes")
    ok = F.when(travel, within("metro_min") | within("bus_min")).when(F.col("category") == "convenience", in_time & (F.coalesce("within_count", F.lit(0)) >= 3)).otherwise(in_time)
    mode = F.when(travel, F.when(within("metro_min"), "metro").when(within("bus_min"), "bus"))
    return rows.select("request_id", "minutes", "category", "cat_no", zero("cnt"), zero("within_count"), zero("total"), "nearest_minutes", ok.alias("passed"), in_time.alias("in_time"), mode.alias("mode"), *more)


def score(cover: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """(request_id, score): 0 to 100 with one decimal. areas: (request_id, area_ratio), 0 where there is none; cover may have that column itself.

    Categories and anchors count by their nearest place alone: one shop in time is enough here."""
    minutes = F.col("minutes").cast("double")
    anchor = F.col("category").isin(*C.ANCHORS)
    near = F.when(anchor, F.coalesce("nearest_minutes", minutes))
    kind = F.when(F.col("mode") == "metro", 1.0).when(F.col("mode") == "bus", C.BUS_FACTOR).otherwise(0.0)
    sums = cover.groupBy("request_id").agg(
        F.first("minutes").cast("double").alias("m"), F.sum(F.col("in_time").cast("int")).alias("all_passed"), F.sum(F.when(anchor, F.col("in_time").cast("int"))).alias("anchors_passed"), F.avg(near).alias("near"), F.max(kind).alias("transport"),
        (F.first("area_ratio") if "area_ratio" in cover.columns else F.lit(0.0)).alias("area_ratio"),
    )
    sums = sums if areas is None else sums.drop("area_ratio").join(shuffled(areas), "request_id", "left").withColumn("area_ratio", F.coalesce("area_ratio", F.lit(0.0)))
    w = C.WEIGHTS
    total = (
        w["categories"] * F.col("all_passed") / 7 + w["anchors"] * F.col("anchors_passed") / 3 + w["anchor_minutes"] * (1 - F.least(F.lit(1.0), F.col("near") / F.col("m")))
        + w["transport"] * F.col("transport") + w["area"] * F.least(F.lit(1.0), F.col("area_ratio"))
    )
    return sums.select("request_id", F.round(total * 100, 1).alias("score"), "all_passed", "anchors_passed")


def percent(x: Column) -> Column:
    return F.concat(F.round(x * 100, 0).cast("long").cast("string"), F.lit("%"))


def diagnosis(cover: DataFrame, facts: DataFrame) -> DataFrame:
    """(request_id, lines): three to six lines. facts: request_id, minutes, iso_area, circle_area, worst, worst_text,
    enclaves, blind (three shares), degraded, method_only."""
    gap = F.when(F.col("nearest_minutes").isNull(), F.concat(F.col("label"), F.lit("缺口：检索半径内没有找到"), F.col("label"), F.lit("设施。"))).when(
        ~F.col("passed"), F.concat(F.lit("最近的"), F.col("label"), F.lit("步行约 "), F.round("nearest_minutes", 0).cast("long").cast("string"), F.lit(" 分钟，超过 "), F.col("minutes").cast("string"), F.lit(" 分钟目标。"))
    )
    label = F.create_map(*(x for k, v in CATEGORY_NAMES.items() for x in (F.lit(k), F.lit(v))))
    place = F.array_position(F.array(*map(F.lit, C.ANCHORS)), F.col("category"))
    gaps = cover.where(F.col("category").isin(*C.ANCHORS)).withColumn("label", label[F.col("category")]).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), gap.alias("line")))).alias("own"))
    ratio = F.coalesce(F.col("iso_area") / F.nullif(F.col("circle_area"), F.lit(0.0)), F.lit(0.0))
    lines = F.concat(
        F.transform("own", lambda x: x["line"]),
        F.array(
            F.concat(F.col("minutes").cast("string"), F.lit(" 分钟约束等时圈面积约 "), F.format_string("%.2f", F.col("iso_area") / 1e6), F.lit(" km²，为直线对照圆的 "), percent(ratio), F.lit("。")),
            F.when(F.col("worst_text") != "", F.concat(F.lit("sector:"), "worst", F.lit(" "), "worst_text")),
            F.when(F.col("enclaves") > 0, F.concat(F.lit("等时圈边缘有 "), F.col("enclaves").cast("string"), F.lit(" 块飞地，需经桥梁或天桥绕行到达。"))),
            F.concat(F.lit("1km 网格盲区占比：便利生活 "), percent(F.col("blind")[0]), F.lit("、医疗养老 "), percent(F.col("blind")[1]), F.lit("、学习教育 "), percent(F.col("blind")[2]), F.lit("。")),
            F.when(F.col("degraded"), F.lit("当前位置没有预置底图，已借用最近区域底图近似计算，与百度步行结果可能有偏差。")),
            F.when(F.col("method_only"), F.lit("该城市未做设施词表校准，结果仅用于方法验证。")),
        ),
    )
    pad = F.array_repeat(F.lit("该区域数据有限，建议结合实地走访确认。"), 3)
    joined = facts.join(shuffled(gaps), "request_id").withColumn("lines", F.filter(lines, lambda x: x.isNotNull()))
    return joined.select("request_id", F.slice(F.when(F.size("lines") >= 3, F.col("lines")).otherwise(F.slice(F.concat("lines", pad), 1, 3)), 1, 6).alias("lines"))


def worst_sector(sectors: DataFrame) -> DataFrame:
    """(request_id, worst, text) from (request_id, direction, gap_ratio, labels): the least ratio, first in compass order."""
    place = F.array_position(F.array(*map(F.lit, C.DIRECTIONS)), F.col("direction"))
    own = sectors.groupBy("request_id").agg(F.min_by(F.struct("direction", "gap_ratio", "labels"), F.struct("gap_ratio", place.alias("k"))).alias("w")).select("request_id", "w.*")
    name = F.create_map(*(x for k, v in DIRECTION_NAMES.items() for x in (F.lit(k), F.lit(v))))[F.col("direction")]
    water = F.exists("labels", lambda x: x.contains("水") | x.contains("河"))
    text = (
        F.when(F.col("gap_ratio") >= 0.95, F.lit("各方向可达性均衡，无明显缺口。"))
        .when(F.size("labels") == 0, F.concat(name, F.lit("方向等时圈缺口最大（达成率 "), percent(F.col("gap_ratio")), F.lit("），建议实地核查阻隔。")))
        .otherwise(F.concat(name, F.lit("被"), F.array_join("labels", "+"), F.lit("切断"), F.when(water, "，需绕桥").otherwise(""), F.lit("（达成率 "), percent(F.col("gap_ratio")), F.lit("）。")))
    )
    return own.select("request_id", F.col("direction").alias("worst"), text.alias("worst_text"))
