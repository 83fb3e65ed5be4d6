"""Selection, walking minutes, coverage and score on small cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from footreach import config as C
from footreach.operators import coverage, poi

VIEW = "request_id long, minutes int, id string, seq long, name string, category string, edu_kind string, transport_kind string, cat_total int, raw_min double, x double, y double"


def chosen(spark, category, rows, minutes=15, cap=20):
    """(ids in order, totals) of rows (id, minutes, name, kind, x, y)."""
    made = [(1, minutes, i, k, name, category, kind if category == "education" else None, kind if category == "transport" else None, 99, m, x, y) for k, (i, m, name, kind, x, y) in enumerate(rows)]
    places = spark.createDataFrame(made, VIEW)
    traits = poi.ranked_traits(places).withColumns({"x2": F.col("x"), "y2": F.col("y")})
    out = poi.selected(traits, cap).orderBy("rank").collect()
    return [r.id for r in out], {r.within_total for r in out}


def test_stations_merge_and_metro_leads(spark):
    rows = [
        ("zj2", 4.7, "珠江帝景", "bus"), ("zj1", 3.9, "珠江帝景", "bus"), ("jls", 8.2, "九龙山地铁站", "metro"), ("jls2", 9.3, "九龙山", "metro"),
        ("mlw1", 5.5, "马连洼（地铁）", "metro"), ("mlw2", 6.4, "地铁马连洼站（地铁）", "metro"), ("b1", 6.7, "九龙山路口西", "bus"),
    ]
    assert chosen(spark, "transport", [(*r, 0.0, 0.0) for r in rows]) == (["mlw1", "jls", "zj1", "b1"], {4})


def test_a_closed_stop_is_not_put_behind_slower_ones(spark):
    rows = [("far", 9.0, "甲站", "bus", 0.0, 0.0), ("shut", 1.0, "乙站已关闭", "bus", 0.0, 0.0), ("open", 1.0, "丙站", "bus", 0.0, 0.0)]
    assert chosen(spark, "transport", rows)[0] == ["open", "shut", "far"]
    schools = [("shut", 1.0, "甲小学已关闭", "school", 0.0, 0.0), ("far", 9.0, "乙小学", "school", 0.0, 0.0)]
    assert chosen(spark, "education", schools)[0] == ["far", "shut"]


def test_departments_of_a_clinic_count_once(spark):
    rows = [
        ("h-main", 8.0, "孙河社区卫生服务中心", None, 0.0, 0.0), ("h-drive", 8.0, "孙河社区卫生服务中心-驾驶人体检室", None, 0.0, 0.0), ("h-rabies", 9.3, "孙河社区卫生服务中心-狂犬疫苗接种门诊", None, 0.0, 0.0),
        ("h-fever", 9.4, "孙河社区卫生服务中心－发热门诊", None, 0.0, 0.0), ("h-branch", 10.9, "孙河社区卫生服务中心-第七社区卫生服务站", None, 0.0, 778.0), ("h-clinic", 2.3, "传语兰中医诊所", None, 0.0, 0.0),
    ]
    assert chosen(spark, "health", rows) == (["h-clinic", "h-main", "h-branch"], {3})


def test_a_chain_of_departments_is_settled_in_order(spark):
    # each is within 200 m of the next: what is near a dropped one stays
    rows = [(f"d{k}", 1.0 + k, f"医院-{k}科", None, 150.0 * k, 0.0) for k in range(6)]
    assert chosen(spark, "health", rows) == (["d0", "d2", "d4"], {3})


def test_park_entrances_count_once(spark):
    rows = [
        ("p-4", 4.2, "百旺公园"), ("p-5", 4.9, "百旺公园"), ("p-8", 8.1, "百旺公园"), ("p-9", 8.1, "百旺公园"), ("p-3rd", 0.4, "百旺公园三期"),
        ("p-west1", 11.6, "百旺公园-西区"), ("p-west2", 11.6, "百旺公园西区"), ("p-herb", 8.8, "药用植物园"),
    ]
    assert chosen(spark, "public", [(*r, None, 0.0, 0.0) for r in rows]) == (["p-3rd", "p-4", "p-west1", "p-herb"], {4})


def test_stages_of_schools_and_the_cap(spark):
    rows = [*((f"k{i}", 1.0 + i / 10, f"花园{i}幼儿园", "kindergarten", 0.0, 0.0) for i in range(15)), *((f"p{i}", 2.0 + i / 10, f"第{i}小学", "school", 0.0, 0.0) for i in range(10)), *((f"m{i}", 0.5, f"第{i}中学", "school", 0.0, 0.0) for i in range(3))]
    ids, total = chosen(spark, "education", rows)
    assert ids == [*(f"k{i}" for i in range(15)), *(f"p{i}" for i in range(5))] and total == {28}


def test_places_that_cannot_be_reached_are_outside(spark):
    rows = [("far", 15.5, "店", None, 0.0, 0.0), ("none", None, "店", None, 0.0, 0.0), ("edge", 15.0, "店", None, 0.0, 0.0)]
    assert chosen(spark, "mall", rows) == (["edge"], {1})


PAIRS = "request_id long, start long, minutes int, id long, x2 double, y2 double, d double"


def test_a_face_is_reached_at_its_edge(spark):
    """One node at the origin, a park from (100, 100) to (600, 600) with its label in the middle."""
    pairs = spark.createDataFrame([(1, 0, 15, 7, 350.0, 350.0, math.hypot(350, 350))], PAIRS)
    costs = spark.createDataFrame([(0, 0, 0.0)], "start long, nid long, cost_s double")
    nodes = spark.createDataFrame([(0, 0.0, 0.0)], "nid long, x double, y double")
    plain = poi.walk_minutes(pairs, costs, nodes).first()
    assert plain.raw_min is None and plain.estimated and not plain.edge_arrival and plain.shown_min > 5
    faces = spark.createDataFrame([(7, 1)], "id long, face long")
    legs = spark.createDataFrame([(1, 0, math.hypot(100, 100) - C.GAP_MERGE_M)], "face long, nid long, leg double")
    r = poi.walk_minutes(pairs, costs, nodes, faces=faces, face_nodes=legs).first()
    assert not r.estimated and r.edge_arrival and r.raw_min == pytest.approx((math.hypot(100, 100) - 15) / 70) and r.raw_min < plain.shown_min


def test_the_last_leg_decides_on_edge_arrival(spark):
    pairs = spark.createDataFrame([(1, 0, 15, k, x, 0.0, x) for k, x in ((1, 20.0), (2, 31.0), (3, 251.0))], PAIRS)
    costs = spark.createDataFrame([(0, 0, 60.0), (5, 0, 1.0)], "start long, nid long, cost_s double")
    nodes = spark.createDataFrame([(0, 0.0, 0.0)], "nid long, x double, y double")
    got = {r.id: (r.raw_min and round(r.raw_min, 6), r.estimated, r.edge_arrival) for r in poi.walk_minutes(pairs, costs, nodes).collect()}
    assert got == {1: (round(1 + 20 / 70, 6), False, False), 2: (round(1 + 31 / 70, 6), False, True), 3: (None, True, False)}


def test_measured_minutes_replace_computed_ones_but_not_edge_arrivals(spark):
    views = spark.createDataFrame([(1, 1, None, 7.0, True, False), (1, 2, 3.0, 3.0, False, True), (1, 3, 4.0, 4.0, False, False)], "request_id long, id long, raw_min double, shown_min double, estimated boolean, edge_arrival boolean")
    measured = spark.createDataFrame([(1, 1, 9.0), (1, 2, 9.0), (2, 3, 9.0)], "request_id long, id long, measured_min double")
    got = {r.id: (r.raw_min, r.shown_min, r.estimated) for r in poi.calibrated(views, measured).collect()}
    assert got == {1: (9.0, 9.0, False), 2: (3.0, 3.0, False), 3: (4.0, 4.0, False)}


def test_cleaning(spark):
    rows = [
        ("a", "u1", 1, "甲店", "mall", 0.0, 0.0), ("b", "u1", 2, "甲店", "mall", 500.0, 0.0), ("c", None, 3, "甲店", "mall", 29.0, 0.0), ("d", None, 4, "甲店", "mall", 31.0, 0.0), ("e", None, 5, "甲店", "mall", 60.0, 0.0),
        ("f", "u2", 6, "甲店", "mall", 1.0, 0.0), ("g", None, 7, "乙店", "mall", 1.0, 0.0), ("h", None, 8, "甲店", "leisure", 1.0, 0.0), ("i", None, 9, "乙店", "mall", 1.0, 0.0),
    ]
    places = spark.createDataFrame(rows, "id string, uid string, seq long, name string, category string, x double, y double").withColumns({c: F.lit(None).cast("string") for c in ("edu_kind", "transport_kind", "tag")})
    out = poi.cleaned(places).collect()
    # c is near a; d is 31 m from a and near only c, which went; e is near d; i is near g
    assert sorted(r.id for r in out) == ["a", "d", "f", "g", "h"] and {r.category: r.cat_total for r in out} == {"mall": 4, "leisure": 1}


def cover(spark, rows, minutes=15):
    asked = spark.createDataFrame([(1, minutes)], "request_id long, minutes int")
    return coverage.coverage(asked, spark.createDataFrame(rows, "request_id long, category string, transport_kind string, raw_min double, within_total int, cat_total int"), coverage.category_rows(spark))


@pytest.mark.parametrize(("metro", "bus", "want"), [(4.0, 22.0, (4.0, True, "metro")), (None, 14.0, (14.0, True, "bus")), (28.0, 35.0, (28.0, False, None)), (28.0, 3.0, (28.0, True, "bus"))])
def test_one_stop_in_time_is_enough(spark, metro, bus, want):
    rows = [(1, "transport", k, m, 2, 2) for k, m in (("metro", metro), ("bus", bus)) if m is not None]
    r = cover(spark, rows).where("category = 'transport'").first()
    assert (r.nearest_minutes, r.passed, r.mode) == want


def test_one_shop_is_enough_for_the_score_but_not_for_the_category(spark):
    one = [(1, "convenience", None, 2.0, 1, 9), (1, "health", None, 5.0, 1, 1), (1, "mall", None, 20.0, 1, 1), (1, "leisure", None, 3.0, 1, 1)]
    own = cover(spark, one)
    r = own.where("category = 'convenience'").first()
    assert not r.passed and r.in_time
    got = coverage.score(own).first()
    assert (got.all_passed, got.anchors_passed) == (3, 2)
    want = 0.4 * 3 / 7 + 0.2 * 2 / 3 + 0.15 * (1 - (2 + 5 + 15) / 3 / 15)
    assert got.score == pytest.approx(round(100 * want, 1))
