"""State on streams against plain loops, and geometries of any nesting."""

import json

from pyspark.sql import functions as F

from footreach.sources import geojson
from footreach.streaming import clicks

CALLS = "event_id long, user_id long, ts timestamp"


def run(spark, tmp_path, batches, respond):
    """One micro-batch for each list of (event_id, user_id, second)."""
    query = None
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, user_id long, s double").select("event_id", "user_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        calls = clicks.timed(clicks.click_stream(spark, f"{tmp_path}/in", df.schema), "1 second")
        query = respond(calls).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
    return {r.event_id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}


def test_a_bucket_lasts_over_batches(spark, tmp_path):
    # two tokens, two a second: three calls at once leave the third waiting half a second
    first = [(1, 7, 100.0), (2, 7, 100.0), (3, 7, 100.0), (4, 8, 100.0)]
    second = [(5, 7, 100.25), (6, 8, 100.25), (7, 7, 1000.0)]
    got = {k: round(r.wait_s, 6) for k, r in run(spark, tmp_path, [first, second], lambda c: clicks.waits(c, 2.0)).items()}
    # the fifth comes while the third sleeps and goes when that one does
    assert got == {1: 0.0, 2: 0.0, 3: 0.5, 4: 0.0, 5: 0.25, 6: 0.0, 7: 0.0}


def test_a_cached_answer_lasts_its_time_and_hits_do_not_prolong_it(spark, tmp_path):
    first = [(1, 7, 1000.0), (2, 7, 1050.0), (3, 8, 1060.0)]
    second = [(4, 7, 1100.0), (5, 7, 1100.5), (6, 7, 1200.0), (7, 8, 1161.0), (8, 9, 6000.0)]
    third = [(9, 7, 6000.0), (10, 9, 6050.0)]
    got = {k: r.hit for k, r in run(spark, tmp_path, [first, second, third], lambda c: clicks.cache_hits(c, 100.0)).items()}
    assert {k for k, hit in got.items() if hit} == {2, 4, 6, 10} and len(got) == 10


def test_positions_of_all_depths_move_and_all_else_stays(spark):
    texts = [
        '{"type": "Point", "coordinates": [1, 2]}', '{"type": "Point", "coordinates": [1.5, -2e1, 7]}', '{"type": "LineString", "coordinates": []}', '{"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]],[[0.2,0.2],[0.3,0.2],[0.2,0.3],[0.2,0.2]]]}',
        '{"type": "GeometryCollection", "bbox": [0, 0, 5, 5], "geometries": [{"type": "MultiPoint", "coordinates": [[1, 1], [2, 2]]}, {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [3, 3]}]}]}', None, "", "no geometry",
    ]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "lng long, g string, __k string")
    out = {r.lng: r for r in geojson.transformed(rows, "g", lambda df: df.withColumns({"lng": F.col("lng") + 10, "lat": F.col("lat") * 2})).collect()}
    assert all(r["__k"] == "x" for r in out.values()) and [out[k].g for k in (2, 5, 6, 7)] == [texts[2], None, "", "no geometry"]
    assert json.loads(out[0].g)["coordinates"] == [11, 4] and json.loads(out[1].g)["coordinates"] == [11.5, -40]
    assert json.loads(out[3].g)["coordinates"][1] == [[10.2, 0.4], [10.3, 0.4], [10.2, 0.6], [10.2, 0.4]]
    nest = json.loads(out[4].g)
    assert nest["bbox"] == [0, 0, 5, 5] and nest["geometries"][0]["coordinates"] == [[11, 2], [12, 4]] and nest["geometries"][1]["geometries"][0]["coordinates"] == [13, 6]
