"""Steps that were worked out again for each of their readers: each test failed before its change."""

from footreach.operators import poi as P
from footreach.operators import streets as W
from footreach.plans import shapes
from footreach.sources import derived as D

SF = "/root/testdata/sf0.001"
VIEW = "request_id long, minutes int, category string, id long, seq long, raw_min double, x2 double, y2 double, transport_kind string, merge long, lead int, closed int, clinic string, cat_total int"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_read_once_when_they_are_selected(spark, tmp_path):
    at = lambda i, x: (1, 15, "health", i, i, i / 10, x, 0.0, None, i, 0, 0, "a", 9)
    rows = [at(1, 0.0), at(2, 150.0), at(3, 300.0), at(4, 350.0), at(5, 200.0), (1, 15, "public", 6, 6, 2.0, 0.0, 0.0, None, 6, 0, 0, None, 9), (1, 15, "public", 7, 7, 1.0, 0.0, 0.0, None, 6, 0, 0, None, 9), (1, 15, "mall", 8, 8, 16.0, 0.0, 0.0, None, 8, 0, 0, None, 9)]
    spark.createDataFrame(rows, VIEW).write.parquet(f"{tmp_path}/views")
    out = P.selected(spark.read.parquet(f"{tmp_path}/views"))
    assert plan(out).count("Relation") == 1
    # 2 and 5 lie near 1, which is kept, and 4 near 3, which only 2 is near to; the radius itself is near
    assert sorted((r.category, r.id, r["rank"], r.within_total) for r in out.collect()) == [("health", 1, 1, 2), ("health", 3, 2, 2), ("public", 7, 1, 1)]


def test_lines_are_cut_once_for_all_obstacles(spark, tmp_path):
    shapes.pieces(spark, SF).limit(50).write.parquet(f"{tmp_path}/pieces")
    pieces = spark.read.parquet(f"{tmp_path}/pieces")
    out = W.walkable(pieces, shapes.outlines(spark, SF, "wall"), shapes.outlines(spark, SF, "water"))
    assert not any(str(tmp_path) in f for f in out.inputFiles())


def test_requests_are_snapped_once(spark):
    starts, _ = shapes.street_costs_by_start(spark, SF, shapes.street_graph_edges(spark, SF).limit(200))
    assert "Join" not in plan(starts)


def test_places_are_told_apart_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(P, "greedy_apart", lambda rows, *_, **__: seen.append(plan(rows)) or rows)
    P.cleaned(D.poi(spark, SF))
    assert "Window" not in seen[0]
