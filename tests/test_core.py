import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wayfare.functions import clock, geo, similarity, text
from wayfare.functions.similarity import soft_jaccard
from wayfare.operators import board, facets, plans, snapshot, spatial
from wayfare.operators.graph import connected_components
from wayfare.sources import readers, sinks
from wayfare.streaming import jobs

SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_geo(spark):
    a, b = (F.lit(12.97), F.lit(77.59)), F.lit(45.0)
    there = geo.destination(*a, b, F.lit(1000.0))
    d, h = one(spark, geo.haversine(*a, there["lat"], there["lon"]), geo.bearing(*a, there["lat"], there["lon"]))
    assert abs(d - 1000) < 1e-6 and abs(h - 45) < 1e-6
    assert one(spark, geo.angular_difference(F.lit(350.0), F.lit(10.0)), geo.compass(F.lit(359.0)), geo.compass(F.lit(22.5), geo.COMPASS_16)) == (20.0, "N", "NNE")
    path = F.array(*[F.struct(F.lit(12.9).alias("lat"), F.lit(77.5 + i / 1000).alias("lon")) for i in range(3)])
    mid = geo.point_at(path, F.element_at(geo.path_lengths(path), -1) / 2)
    on = geo.onto_path(F.lit(12.9001), F.lit(77.5015), path)
    lon, seg, off = one(spark, mid["lon"], on["segment"], on["offset_m"])
    assert abs(lon - 77.501) < 1e-9 and seg == 1 and abs(off - 11.1) < 0.2


def test_text(spark):
    assert one(spark, text.undoubled(F.lit("BBLLIINNKK")), text.undoubled(F.lit("AAB")), text.normal_name(F.lit("The M.G. Road × Brigade Jn"))) == ("BLINK", "AAB", "brigade")
    got = [one(spark, text.headings(F.lit(x)))[0] for x in ("80;200;320", "360", "-75", "90-180", "400", "NNE; s")]
    assert got == [[80, 200, 320], [0], [], [], [], [22.5, 180]]
    assert one(spark, text.has_contact(F.lit("call +91 98450-12345")), text.has_contact(F.lit("a@b.co")), text.has_contact(F.lit("5 pm"))) == (True, True, False)
    assert one(spark, text.clean_tag(F.lit(" a\x07 b ")), text.clean_tag(F.lit(" ")), text.clean_tag(F.lit("x" * 300)))[0:2] == ("a b", None)
    assert one(spark, text.clean_words(F.lit("e\u0301\r\n\n\n\nx "), 10))[0] == "\u00e9\n\nx"
    assert one(spark, text.written_out(F.lit("Hebbal ORR Jn")))[0] == "hebbala outer ring road"
    assert soft_jaccard(["silk", "board"], ["silkk", "board"]) == 1.0 and soft_jaccard([], ["a"]) == 0


def test_clock(spark):
    t = F.lit("2024-01-07 20:00:00").cast("timestamp")  # Monday 01:30 there
    assert one(spark, clock.weekday(t), clock.minute_of_day(t), clock.minutes(F.lit("24:00")), clock.second_of_week(t)) == (0, 90, 1440, 5400)
    cur = lambda d, p: clock.currency(F.lit(d).cast("string"), F.lit(p).cast("string"), F.lit("2026-09-06").cast("date"))["status"]
    assert one(spark, cur("2026-05", None), cur("2025-12-01", None), cur("2010", None), cur(None, None), cur(None, "2026-09-01T00:00"), cur("2027", None)) == ("current", "aging", "stale", "undated", "current", "current")
    assert one(spark, clock.pdf_date(F.lit("D:20100317115245+05'30'")).cast("string"), clock.pdf_date(F.lit("D:20101399"))) == ("2010-03-17", None)


def test_priors(spark):
    u = plans.uniform_delay(F.lit(120.0), F.lit(40.0))
    mean, stop, p50 = one(spark, u["mean"], u["p_stop"], u["p50"])
    assert (round(mean, 3), round(stop, 4), p50) == (26.667, 0.6667, 20.0)
    v = plans.vehicle_phases(F.array(*map(F.lit, [110, 100, 15])), F.lit(225), F.lit(None).cast("int"), F.lit("timed"))
    m = plans.mixture(F.lit(225.0), v)
    g, mean = one(spark, v, m["mean"])
    assert g == [110, 100] and abs(mean - (110 * 115**2 / 450 + 100 * 125**2 / 450) / 210) < 1e-9


def test_components_do_not_depend_on_order(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 60), (7, 7), (None, 3)]
    want = {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 100: 50}
    for e in (edges, edges[::-1], [(b, a) for a, b in edges]):
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
        assert {k: v for k, v in got.items() if k in want} == want


def test_radius_join_has_no_nested_loop(spark):
    pts = spark.range(200).select("id", (12.8 + (F.col("id") * 37 % 100) / 1000.0).alias("lat"), (77.4 + (F.col("id") * 91 % 100) / 1000.0).alias("lon"))
    got = spatial.radius_join(pts, pts, 700.0, 13.0, "id", "id")
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    brute = pts.alias("a").crossJoin(pts.alias("b")).filter(geo.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= 700).count()
    assert got.count() == brute


def test_snapshot(spark):
    d = "id long, v int, tags map<string,string>"
    a, b = spark.createDataFrame([(1, "x", None)], "id int, p string, q string"), spark.createDataFrame([(1, None, "x")], "id int, p string, q string")
    assert [r["change"] for r in snapshot.diff(a, b, "id", ["p", "q"]).collect()] == ["updated"] and [r["change"] for r in snapshot.diff(a, a, "id", ["p", "q"]).collect()] == ["unchanged"]
    old = spark.createDataFrame([(1, 1, {"a": "b"}), (2, 1, {}), (3, 1, {})], d).withColumn("t", snapshot.canonical(F.col("tags")))
    new = spark.createDataFrame([(1, 1, {"a": "b"}), (2, 2, {}), (4, 1, {})], d).withColumn("t", snapshot.canonical(F.col("tags")))
    assert {tuple(r) for r in snapshot.diff(old, new, "id", ["v", "t"]).collect()} == {(1, "unchanged"), (2, "updated"), (3, "removed"), (4, "inserted")}
    assert snapshot.guard(2818, 2800) is None and snapshot.guard(None, 5) is None and snapshot.guard(2818, 1200) == "1618 records would go"
    rows = [("node", 10, 12.9, 77.6, "t"), ("node", 11, None, 77.6, "t"), ("node", 12, 28.6, 77.2, "t"), ("way", 13, 12.9, 77.6, "t"), ("node", -1, 12.9, 77.6, "t"), ("node", 14, 12.9, 77.6, None)]
    df = spark.createDataFrame(rows, "k string, i long, y double, x double, t string")
    why = [r[0] for r in df.select(snapshot.reject_reason(*map(F.col, "kiyxt"))).collect()]
    assert why == [None, "missing coordinate", "outside", "type way", "bad id", "missing timestamp"]
    tags = F.create_map(*map(F.lit, ["operator", "BTP", "name", "Gate\x07 1", "phone", "1", "contact:email", "x", "ref", ""]))
    assert one(spark, snapshot.clean_tags(tags))[0] == {"name": "Gate 1", "operator": "BTP"}


def test_board(spark):
    b = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(1, 101)], "seq long, kind string")
    assert [r["seq"] for r in board.page(b, 3, 11, "a").collect()] == [9, 7, 5]
    assert {r["more"] for r in board.page(b, 60).collect()} == {True} and {r["more"] for r in board.page(b, 60, 20).collect()} == {False}
    assert one(spark, *[board.page_limit(F.lit(x)) for x in ("999", "x", "0", "7")]) == (60, 30, 30, 7)
    posts = spark.createDataFrame([(i, "c", f"2024-01-01 00:{i:02d}:00") for i in range(50)], "id long, client string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    ok = [r["ok"] for r in board.admission(posts, "id", per_hour=5, per_day=60).orderBy("id").collect()]
    assert ok == board.admitted([i * 60000 for i in range(50)], 5, 60) and sum(ok) == 5


def test_facets(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p")], "a string, b string")
    got = {(r["facet"], r["option"]): r["n"] for r in facets.leave_one_out_counts(df, {"a": ["x", "y", "z"], "b": ["p", "q"]}, {"a": "x", "b": "all"}).collect()}
    assert got == {("a", "x"): 2, ("a", "y"): 1, ("a", "z"): 0, ("b", "p"): 1, ("b", "q"): 1}


def test_sources(spark, tmp_path):
    doc = {"osm3s": {"timestamp_osm_base": "2026-09-05T00:00:00Z"}, "elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"a": "b"}}, {"type": "way", "id": 5, "geometry": [{"lat": 1, "lon": 2}], "tags": {"n": "first"}}]}
    (tmp_path / "tile1.json").write_text(json.dumps(doc))
    doc["elements"][1]["tags"]["n"] = "last"
    (tmp_path / "tile2.json").write_text(json.dumps(doc))
    e = readers.extract(spark, [f"file://{tmp_path}/tile1.json", f"file://{tmp_path}/tile2.json"])
    assert readers.nodes(e).count() == 2 and [r["tags"]["n"] for r in readers.ways(e).collect()] == ["last"]
    assert readers.checked_extract(spark, f"file://{tmp_path}/tile1.json").count() == 2
    (tmp_path / "bad.json").write_text(json.dumps(doc | {"remark": "timed out"}))
    with pytest.raises(ValueError):
        readers.checked_extract(spark, f"file://{tmp_path}/bad.json")
    (tmp_path / "l.csv").write_text('﻿OSM_ID,Latitude,lon,name,osm_url\r\nnode/77,12.9,77.6,"x, ""y""",u\r\n\r\nabc,12.9,77.6,z,\r\n9,,77.6,z,\r\n', newline="")
    rows, bad = readers.signal_list(spark, f"file://{tmp_path}/l.csv")
    assert [(r["id"], r["name"], r["extra"]) for r in rows.collect()] == [(77, 'x, "y"', {"osm_url": "u"})] and bad.count() == 2
    (tmp_path / "n.csv").write_text("osm_id,name\n1,a\n")
    with pytest.raises(ValueError):
        readers.signal_list(spark, f"file://{tmp_path}/n.csv")
    (tmp_path / "p.txt").write_text("head\n=== page 1===\nOne.\n=== page 12===\nTwelve.\n=== page x")
    assert {(r["page"], r["body"].strip()) for r in readers.page_texts(spark, f"file://{tmp_path}/p.txt").collect()} == {(1, "One."), (12, "Twelve.")}
    frame = b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x01\x11\x00\xff\xda\x00\x02zz\xff\xd9"
    assert readers.jpeg_facts(frame) == (32, 16, len(frame)) and readers.jpeg_facts(frame[:-1]) is None
    old = spark.createDataFrame([("a", 0, 1), ("b", 1, 1)], "id string, ord int, v int")
    new = spark.createDataFrame([("c", 0, 2), ("a", 1, 2)], "id string, ord int, v int")
    assert [(r["id"], r["v"]) for r in sinks.upsert_registry(old, new).orderBy("ord").collect()] == [("a", 2), ("b", 1), ("c", 2)]
    f = sinks.point_features(spark.createDataFrame([(1, 2.0, 3.0, None)], "id int, lat double, lon double, n string"), ["id", "n"]).first()[0]
    assert json.loads(f)["properties"] == {"id": 1, "n": None}


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    src = f"file://{tmp_path}/in"
    events.repartition(1).sortWithinPartitions("ts").write.parquet(src)
    stream = jobs.event_stream(spark, src, events.schema)

    def run(df, mode, name):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    got = {tuple(r) for r in run(jobs.window_counts(stream), "complete", "w").select(F.col("start").cast("string"), "event_type", "n").collect()}
    want = {tuple(r) for r in events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("string"), "event_type").count().collect()}
    assert got == want
    ok = {tuple(r) for r in run(jobs.admission_stream(stream, "event_id", "user_id", 2, 3), "append", "adm").collect()}
    assert ok == {tuple(r) for r in board.admission(events, "event_id", "user_id", "ts", 2, 3).collect()}
    jobs.upsert_snapshots(stream.withColumnRenamed("user_id", "id"), f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out/v=0").count() == events.select("user_id").distinct().count()
    shutil.rmtree(tmp_path / "ck")


def test_junctions(spark):
    from wayfare.operators import junctions

    nodes = spark.createDataFrame([(1, 12.9, 77.6), (2, 12.9002, 77.6), (3, 12.95, 77.6)], "id long, lat double, lon double")
    line = lambda pts: [{"lat": y, "lon": x} for y, x in pts]
    ways = spark.createDataFrame(
        [(10, line([(12.898, 77.6), (12.9, 77.6), (12.9002, 77.6), (12.902, 77.6)]), {"name": "A", "highway": "primary"}), (11, line([(12.9, 77.598), (12.9, 77.6)]), {"name": "B", "oneway": "yes"}), (12, line([(12.9, 77.6), (12.9, 77.602)]), {"highway": "footway"})],
        "id long, geometry array<struct<lat:double,lon:double>>, tags map<string,string>",
    )
    a = junctions.approaches(nodes, ways)
    got = sorted((r["node"], r["way"], round(r["bearing"])) for r in a.collect())
    assert got == [(1, 10, 0), (1, 10, 180), (1, 11, 90), (2, 10, 0), (2, 10, 180)]
    e = junctions.links(nodes, junctions.at_nodes(nodes, ways), 13.0)
    assert [tuple(r) for r in e.collect()] == [(1, 2)]
    merged = junctions.merge_approaches(a.withColumn("junction", F.lit("j")))
    assert [(r["k"], r["name"], round(r["bearing"]), r["compass"], r["nodes"]) for r in merged.orderBy("k").collect()] == [(1, "A", 0, "N", [1, 2]), (2, "B", 90, "E", [1]), (3, "A", 180, "S", [1, 2])]
    back = ways.filter("id = 11").withColumn("tags", F.create_map(F.lit("ref"), F.lit("NH 4"), F.lit("oneway"), F.lit("reverse")))
    assert junctions.approaches(nodes, back).count() == 0 and junctions.vertices(back).first()["name"] == "NH 4"
    listed = spark.createDataFrame([(1, 0, 12.9, 77.6), (2, 1, 12.901, 77.6), (8, 2, 12.9501, 77.6), (9, 3, 12.8, 77.5), (10, 4, 12.8003, 77.5), (11, 5, 12.8007, 77.5)], "id long, ord long, lat double, lon double")
    out = {r["id"]: (r["outcome"], r["to"]) for r in junctions.reconcile(listed, nodes.withColumnRenamed("id", "junction"), nodes, 13.0).collect()}
    # 10 joins the light added before it, and so 11, which is near 10 alone, is added
    assert out == {1: ("present", "1"), 2: ("moved", "2"), 8: ("attached", "3"), 9: ("added", "9"), 10: ("attached", "9"), 11: ("added", "11")}
    n = lambda *xs: [F.lit(float(x)) for x in xs]
    got = [one(spark, junctions.confidence(*n(*case)))[0] for case in ((1, 0, 2, 3), (5, 70, 0, 0), (4, 30, 1, 1), (7, 10, 2, 2))]
    assert [(round(g["score"], 6), g["review"]) for g in got] == [(1.0, False), (0.0, True), (0.75, False), (0.6, True)]


def plain_starts(g, low=30, high=240, delta=4.0):
    """The plain grid search, in tenths of a second throughout."""
    t0 = min(g)
    x = [v - t0 for v in g]

    def cost(o, c):
        r = [min((v - o) % c, c - (v - o) % c) for v in x]
        return sum(v * v if v <= 10 * delta else 10 * delta * (2 * v - 10 * delta) for v in r) / 200, sum(v <= 10 * delta for v in r)

    coarse = [min((cost(10 * o, 10 * c)[0], o) for o in range(c)) + (c,) for c in range(low, high + 1)]
    least = min(coarse)[0]
    best = max((c, k, o) for k, o, c in coarse if k <= least * 1.1 + 1e-9)
    found = (best[1], 10 * best[0], 10 * best[2])
    for c in range(10 * best[0] - 10, 10 * best[0] + 11):
        for o in range(10 * best[2] - 10, 10 * best[2] + 11):
            k = cost(o % c, c)[0]
            if k < found[0]:
                found = (k, c, o % c)
    return found[1] / 10, (found[2] + t0) % found[1] / 10, found[0], cost(found[2], found[1])[1] / len(g)


def test_green_starts_and_cycles(spark):
    import numpy as np

    from wayfare.operators import models

    rng = np.random.default_rng(3)
    groups = {1: np.sort(17 + 120 * rng.integers(0, 200, 40) + rng.normal(0, 1, 40)), 2: rng.uniform(0, 5000, 30), 3: rng.uniform(0, 9, 5)}
    rows = [(g, float(round(t, 1)), f"j{i % 9}") for g, ts in groups.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "g long, t double, j string")
    got = {r["g"]: r for r in models.start_fits(df, "g", "t").collect()}
    assert set(got) == {1, 2}
    for g in got:
        want = plain_starts([round(t * 10) for h, t, _ in rows if h == g])
        assert abs(got[g]["cycle"] - want[0]) < 1e-9 and abs(got[g]["cost"] - want[2]) < 1e-6 and abs(got[g]["inliers"] - want[3]) < 1e-9
    assert abs(got[1]["cycle"] - 120) < 1 and got[1]["inliers"] > 0.7
    sure = {r["g"]: r for r in models.bootstrap(df, "g", "t", "j", rounds=12).collect()}
    assert sure[1]["cycle_low"] <= sure[1]["cycle_mid"] <= sure[1]["cycle_high"] and abs(sure[1]["cycle_mid"] - 120) < 1 and 3 not in sure
    t = np.sort(rng.uniform(0, 20000, 500))
    y = ((t - 17) % 90 < 40).astype(float)
    obs = spark.createDataFrame([(7, float(a), float(b), f"k{i % 60}") for i, (a, b) in enumerate(zip(t, y, strict=True))], "g long, t double, y double, j string")
    c = models.cycles(obs, "g", "t", "y", "j", low=80, high=100).first()
    assert abs(c["cycle"] - 90) < 1 and c["improvement"] > 0.2
    x = np.column_stack([np.ones(200), rng.normal(size=200)])
    w = rng.integers(1, 4, 200).astype(float)
    hits = (rng.random(200) < 0.4).astype(float)
    beta = models.fit_logistic(x, hits, w)
    p = 1 / (1 + np.exp(-x @ beta))
    assert np.abs(x.T @ (w * (hits - p)) - np.array([0, models.RIDGE]) * beta).max() < 1e-4


def test_prediction_levels(spark):
    import datetime

    from wayfare.operators import predict

    now = datetime.datetime(2024, 1, 31)
    start = datetime.datetime(2024, 1, 29, 2, 0)  # Monday, half past seven there
    rows = []
    for i in range(40):  # resumes at 10 s into each cycle of 90 s that starts with the window at seven
        at = datetime.datetime(2024, 1, 29, 1, 30) + datetime.timedelta(seconds=90 * (i + 5) + 10 + (i % 3 - 1))
        rows.append((1, at, 20.0, True, 0.9, at))
    rows += [(2, start + datetime.timedelta(seconds=20 * i), float(i), i % 2 == 0, 0.8, None) for i in range(70)]
    e = spark.createDataFrame(rows, "junction int, ts timestamp_ntz, delay double, stopped boolean, quality double, resumed timestamp_ntz")
    w = spark.createDataFrame([(j, 0, "all_days", 0, "07:00", "12:00", "timed", [40, 35, 15], 90, 2, "printed") for j in (1, 3)], "junction int, plan_ord int, day_type string, win_ord int, start string, end string, mode string, phases array<int>, cycle_s int, ped int, cycle_source string")
    linked = spark.createDataFrame([(1, "fixed", "current", False), (3, "vehicle_actuated", "stale", True)], "junction int, control string, standing string, conflict boolean")
    q = spark.createDataFrame([(j, j, datetime.datetime(2024, 1, 30, 2, 0), 0 if j == 1 else None) for j in (1, 2, 3, 4)], "qid long, junction int, t timestamp_ntz, phase int")
    got = {r["qid"]: r for r in predict.predict(q, e, w, linked, F.lit(now).cast("timestamp_ntz"), sigma=5.0).collect()}
    assert [got[i]["level"] for i in (1, 2, 3, 4)] == ["A", "C", "P", "E"]
    # 07:30:00 is 1,800 s after the window began: place 80 - offset 10 before the green at 90
    assert abs(got[1]["offset"] - 10) <= 1 and 5 < got[1]["mean"] < 16 and 0.8 < got[1]["p_stop"] <= 1 and got[1]["confidence"] > 0.7
    assert got[3]["confidence"] == pytest.approx(0.3 * 0.6 * 0.7) and got[3]["mean"] == pytest.approx((40 * 50**2 / 180 + 35 * 55**2 / 180) / 75)
    assert got[4]["mean"] is None and got[4]["confidence"] == 0 and got[2]["confidence"] <= 0.6 and got[2]["plan"] is None


def test_layout(spark):
    from wayfare.operators import layout

    words = [(1, t, x, x + 20.0, y, 9.0) for t, x, y in (("SILK", 10.0, 50.0), ("BOARD", 40.0, 51.0), ("JUNCTION,", 80.0, 50.5), ("MADIWALA", 140.0, 50.0), ("POLICE", 200.0, 50.0), ("STATION", 240.0, 50.0), ("-", 280.0, 50.0), ("FIXED", 290.0, 50.0))]
    words += [(1, t, x, x + 20.0, y, 9.0) for t, x, y in (("OTHER", 10.0, 700.0), (",", 40.0, 700.0), ("HAL", 50.0, 700.0), ("POLICE", 90.0, 700.0), ("STATION", 120.0, 700.0))] + [(1, "a", 5.0, 9.0, 300.0, 6.0), (1, "b", 5.0, 9.0, 400.0, 6.0)]
    df = spark.createDataFrame(words, "doc int, text string, x0 double, x1 double, top double, size double")
    h = {r["k"]: r["header"] for r in layout.headers(df).collect()}
    assert (h[1]["name"], h[1]["station"], h[1]["control"], h[1]["hint"]) == ("SILK BOARD", "MADIWALA", "FIXED", "fixed") and h[2]["control"] == "UNSPECIFIED" and h[2]["hint"] == "unknown"
    assert {(r["text"], r["panel"]) for r in layout.panels(df).filter("text IN ('a', 'b')").collect()} == {("a", 1), ("b", 2)}
    cols = spark.createDataFrame([(1, i, 100.0 + 50 * i) for i in range(3)], "panel int, phase int, x double")
    label = spark.createDataFrame([(1, "EXCLUSIVE", 185.0, 215.0), (1, "other", 0.0, 1.0)], "panel int, text string, x0 double, x1 double")
    assert [tuple(r) for r in layout.pedestrian_phase(label, cols).collect()] == [(1, 2)]
    letters = layout.bands(spark.createDataFrame([(1, "A", 10.0), (1, "B", 30.0)], "panel int, letter string, top double"), 60.0)
    assert {r["letter"]: r["until"] for r in letters.collect()} == {"A": 28.0, "B": 52.0}
    moves = spark.createDataFrame([(1, "L", 95.0, 105.0, 11.0, 7.0), (1, "S", 148.0, 152.0, 33.0, 7.0), (1, "S", 40.0, 44.0, 11.0, 7.0), (1, "R", 98.0, 102.0, 12.0, 4.0)], "panel int, text string, x0 double, x1 double, top double, size double")
    assert {tuple(r) for r in layout.movements(moves, cols, letters).collect()} == {(1, "A", 0, "L"), (1, "B", 1, "S")}


def test_matches_against_brute_force(spark):
    from wayfare.operators import match

    rng = random.Random(9)
    word = ["silk", "board", "hebbal", "yemalur", "yamalur", "koramangala", "agara", "hosur", "market"]
    name = lambda n: " ".join(rng.sample(word, n))
    panels = [(i, name(rng.randrange(1, 4)), [name(2) for _ in range(rng.randrange(0, 3))]) for i in range(25)]
    index = [(100 + i, i, name(rng.randrange(1, 4)), [name(2) for _ in range(rng.randrange(0, 3))], 12.9 + i * 0.0005, 77.6) for i in range(30)]
    places = [(f"{n} junction, Bengaluru", 12.9 + i * 0.001, 77.6, ["Agara circle", "Hosur clinic", "nothing"][i % 3], ["shop=a", "shop=b", "place=c"][i % 3]) for i, (_, n, _) in enumerate(panels) if i % 2]
    p = spark.createDataFrame(panels, "panel long, name string, roads array<string>")
    x = spark.createDataFrame(index, "id long, ord long, name string, roads array<string>, lat double, lon double")
    g = spark.createDataFrame([(q, *rest) for q, *rest in dict((r[0], r) for r in places[::-1]).values()], "query string, lat double, lon double, label string, osm string")
    got = {}
    for r in match.match(p, x, g, 13.0).collect():
        got.setdefault(r["panel"], {})[r["rank"]] = r
    toks = {w: [r[0] for r in spark.createDataFrame([(w,)], "s string").select(text.tokens(F.col("s"))).collect()][0] for w in {n for _, n, rs in panels for n in (n, *rs)} | {n for _, _, n, rs, *_ in index for n in (n, *rs)}}
    round3 = lambda v: int(v * 1000 + 0.5 + 1e-9) / 1000
    for i, n, roads in panels:
        words = []
        for j, o, m, rs, lat, lon in index:
            all_ = sorted({t for w in (m, *rs) for t in toks[w]})
            a = soft_jaccard(toks[n], all_)
            b = sum(max([soft_jaccard(toks[r], toks[s]) for s in rs] + [0.0]) for r in roads) / len(roads) if roads else 0.0
            if max(a, 0.85 * b + 0.15 * a) > 0:
                words.append((-round3(max(a, 0.85 * b + 0.15 * a)), o, j))
        best = {j: -s for s, _, j in sorted(words)[: match.BY_NAME]}
        for rank, r in got.get(i, {}).items():
            if r["metres"] is None:
                assert abs(r["combined"] - best[r["id"]]) < 2e-3
        if i % 2 == 0 and words:
            assert abs(got[i][1]["score"] - -sorted(words)[0][0]) < 2e-3
    assert any(r["metres"] is not None for v in got.values() for r in v.values())
    names = match.match_names(p.select(F.col("name").alias("mention")).distinct(), x)
    for r in names.filter("rank = 1").collect():
        want = max(max(soft_jaccard(toks[r["mention"]], toks[m]), 0.85 * soft_jaccard(toks[r["mention"]], sorted({t for w in (m, *rs) for t in toks[w]}))) for _, _, m, rs, *_ in index)
        assert abs(r["score"] - want) < 2e-3


def test_documents_and_sinks(spark, tmp_path):
    at = f"file://{tmp_path}"
    (tmp_path / "pkg.json").write_text(json.dumps({"result": {"resources": [{"id": "0" * 8 + "-0000-0000-0000-" + "0" * 12, "name": "a"}]}}))
    (tmp_path / "bad.json").write_text(json.dumps({"result": {"resources": [{"id": "../x", "name": "a"}]}}))
    assert readers.package(spark, f"{at}/pkg.json").first()["name"] == "a"
    with pytest.raises(Exception, match="not a resource id"):
        readers.package(spark, f"{at}/bad.json").collect()
    (tmp_path / "dec.json").write_text(json.dumps({"plans": {"k1": {"decision": "accepted", "intersection_id": "gw-1", "by": "r", "at": "2024"}}}))
    assert [tuple(r) for r in readers.decisions(spark, f"{at}/dec.json").collect()] == [("k1", "accepted", "gw-1", "r", "2024")] and readers.decisions(spark, f"{at}/none.json").count() == 0
    (tmp_path / "d.json").write_text(json.dumps({"meta": {"schema": "surveillance.v1"}, "records": [{"id": 1}, {"id": 2}]}))
    meta, records = readers.dataset(spark, f"{at}/d.json", "records", "id long")
    assert json.loads(meta.first()["meta"])["schema"] == "surveillance.v1" and [r["id"] for r in records.orderBy("ord").collect()] == [1, 2]
    (tmp_path / "cache.json").write_text(json.dumps({"q1": {"provider": "p", "lat": 1.0, "lon": 2.0, "label": "L", "osm": "o"}, "q2": None}))
    assert {(r["query"], r["lat"]) for r in readers.place_cache(spark, f"{at}/cache.json").collect()} == {("q1", 1.0), ("q2", None)}
    sinks.write_document(spark.createDataFrame([("x", 1)], "name string, n int"), spark.createDataFrame([(2, "b"), (1, "a")], "ord int, v string"), f"{at}/doc", "ord")
    lines = [line for f in sorted((tmp_path / "doc").glob("part-*")) for line in f.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"name": "x", "n": 1}, {"v": "a"}, {"v": "b"}]
    blocks = spark.createDataFrame([("s", "k2", 2, "n2"), ("s", "k1", 1, "n1")], "source string, key string, ord int, name string")
    windows = spark.createDataFrame([("k1", 1, "07:00", "raw")], "key string, ord int, start string, raw string")
    nested = sinks.nested_plans(blocks, windows).first()
    assert [(b["key"], [w.asDict() for w in b["windows"]]) for b in nested["junctions"]] == [("k1", [{"start": "07:00"}]), ("k2", [])]
    sinks.write_photos(spark.createDataFrame([("ab1", 1, "old"), ("ab1", 2, "new"), ("cd2", 1, "x")], "id string, ord int, body string"), f"{at}/photos")
    assert {(r["id"], r["body"], r["shard"]) for r in spark.read.parquet(f"{at}/photos").collect()} == {("ab1", "new", "ab"), ("cd2", "x", "cd")}
    rows = spark.createDataFrame([("gw-" + "a" * 12, " ", 1.0, 2.0), ("bad", "n", 1.0, 2.0)], "id string, canonical_name string, lat double, lon double")
    assert [r["name"] for r in sinks.page_junctions(rows).collect()] == ["Junction"]
    urls = sinks.sitemap(spark.createDataFrame([(0, "gw-1", "2024-01-02")], "ord long, id string, made string").withColumn("made", F.to_date("made")), "https://x", ("/", "/a")).orderBy("ord").collect()
    assert [r["url"] for r in urls][-1] == "<url><loc>https://x/signal/gw-1</loc><lastmod>2024-01-02</lastmod></url>" and len(urls) == 3
    d = sinks.dataset_records(spark.createDataFrame([("n", "d", "ODbL 1.0", "t", "u"), ("m", "d", "other", "t", "u")], "name string, description string, license string, generated_at string, url string"))
    assert {json.loads(r["record"]).get("license") for r in d.collect()} == {None, "https://opendatacommons.org/licenses/odbl/1-0/"}


def test_review_and_mentions(spark):
    from wayfare.functions import similarity
    from wayfare.operators import review

    w = lambda mode="timed", ok=True, flags=(), c=120: {"mode": mode, "consistent": ok, "flags": list(flags), "cycle_s": c}
    day = lambda *ws, t="weekday_default", o=True: {"day_type": t, "windows_ordered": o, "windows": list(ws)}
    rows = [
        (1, "FIXED", 4, "strong", [day(w(), w("blinking"))], [], 5), (2, "FIXED", 4, "strong", [day(w())], ["duplicate"], 1), (3, "ATCS", 1, "moderate", [], [], 1),
        (4, "VAC", 2, "strong", [day(w(flags=["incomplete_row"]), w(ok=False))], [], 1),
    ]
    schema = "id int, control_label string, phase_count int, tier string, day_plans array<struct<day_type:string,windows_ordered:boolean,windows:array<struct<mode:string,consistent:boolean,flags:array<string>,cycle_s:int>>>>, quality_flags array<string>, importance int"
    got = {r["id"]: r for r in review.prevalidate(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i]["review"] for i in (1, 2, 3, 4)] == ["pre_validated", "pending_review", "pending_review", "pending_review"]
    assert abs(got[1]["score"] - 1) < 1e-9 and got[2]["blocking"] == ["duplicate"] and abs(got[3]["score"] - 0.15) < 1e-9
    assert abs(got[4]["score"] - 0.6) < 1e-9 and abs(got[1]["priority"] - 1) < 1e-9
    pages = spark.createDataFrame([("s", 1, "Silk Board Junction should get a signal. Two Way Silk Board junction signal again. Two Way junction signal. Signal delay at Hebbal Circle was observed. Agara Cross has none."), ("s", 2, "Agara Junction has none."), ("s", 3, "Signal at X Hosur Intersection.")], "source string, page int, body string")
    got = text.numbered_mentions(text.place_mentions(pages))
    assert sorted((r["id"], r["mention"], r["claim"]) for r in got.collect()) == [("s:p1:1", "Silk Board junction", "qualitative_recommendation"), ("s:p1:2", "Hebbal circle", "observation"), ("s:p3:3", "Hosur intersection", "mention")]
    v = lambda x: F.lit(x).cast("double")
    assert one(spark, similarity.match_tier(v(0.8), v(0.5)), similarity.match_tier(v(0.8), v(0.7)), similarity.match_tier(v(0.1), v(None))) == ("strong", "moderate", "none")
    assert one(spark, similarity.junction_tier(v(0.8), v(0.1), v(0.5), v(50), v(0.9), v(0.2)), similarity.junction_tier(v(0.1), v(0.1), v(0.1), v(None), v(0.35), v(0.2))) == ("strong", "weak")


def test_best_matches_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))
    base = [word() for _ in range(40)] + ["yemalur", "yamalur", "koramangala", "horamangala", "ab", "a", "日本橋駅前通り", "月本橋駅前通り"]

    def bent(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w[:i] + rng.choice("abcd") + w[i + 1 :], w[:i] + w[i + 1 :] or w, w[:i] + "d" + w[i:]])

    names = lambda n: [(i, [bent(rng.choice(base)) for _ in range(rng.randrange(0, 4))]) for i in range(n)]
    left, right = [*names(60), (900, ["yemalur"]), (901, ["koramangala"])], [*names(60), (900, ["yamalur"]), (901, ["horamangala"]), (902, ["yamalur"])]
    make = lambda rows, c: spark.createDataFrame(rows, f"{c} long, tokens array<string>")
    got = sorted(map(tuple, similarity.best_matches(make(left, "l"), make(right, "r"), 5).collect()))
    want = []
    for i, a in left:
        scored = sorted((-similarity.soft_jaccard(a, b), j) for j, b in right)
        want += [(i, j, -s, n + 1) for n, (s, j) in enumerate([x for x in scored if x[0] < 0][:5])]
    assert got == sorted(want)
    assert (900, 900) in {r[:2] for r in got} and (901, 901) in {r[:2] for r in got}


def test_sync_runs(spark, tmp_path):
    d = "type string, id long, lat double, lon double, version int, timestamp string, tags map<string,string>, ord int"
    row = lambda i, o, name, kind="node": (kind, i, 12.9, 77.6, None, "2024", {"name": name, "phone": "1"}, o)
    at = [f"file://{tmp_path}/snap", f"file://{tmp_path}/log"]
    first = snapshot.sync(spark.createDataFrame([row(1, 0, "a"), row(2, 1, "b"), row(3, 2, "c"), row(3, 3, "d"), row(4, 4, "x", "way")], d), *at, "2024-01-01")
    assert (first["inserted"], first["malformed"], first["duplicates"], first["refused"]) == (3, 1, 1, None)
    second = snapshot.sync(spark.createDataFrame([row(1, 0, "a"), row(2, 1, "z"), row(5, 2, "e")], d), *at, "2024-01-02")
    assert [second[k] for k in ("inserted", "updated", "unchanged", "removed")] == [1, 1, 1, 1]
    third = snapshot.sync(spark.createDataFrame([row(1, 0, "a")], d), *at, "2024-01-03")
    assert third["refused"] == "2 records would go" and snapshot.versions(spark, at[0]) == ["2024-01-01", "2024-01-02"]
    assert {r["id"]: r["tags"] for r in spark.read.parquet(f"{at[0]}/at=2024-01-02").collect()}[2] == {"name": "z"}
    assert spark.read.json(at[1]).count() == 3
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    assert one(spark, *[snapshot.due(F.lit(t).cast("timestamp"), now) for t in ("2024-01-02 00:00:00", "2024-01-02 00:00:01", None)]) == (True, False, True)


def test_small_parts(spark):
    from wayfare.functions import formats
    from wayfare.operators import cameras

    domains = {"a": ["x", "y"], "b": ["p"]}
    assert facets.valid_selection({"a": "x", "b": "no", "c": "z"}, domains) == {"a": "x", "b": "all"} and facets.active_count({"a": "x", "b": "all"}) == 1
    df = spark.createDataFrame([("x",), ("x",), ("q",)], "a string")
    assert {r["option"]: r["n"] for r in facets.histogram(df, "a", ["x", "y"]).collect()} == {"x": 2, "y": 0}
    assert formats.quality_ladder() == [0.82, 0.74, 0.66, 0.58, 0.5] and formats.quality_ladder(0.8, 0.5, 0.2) == [0.8, 0.6, 0.5]
    board_rows = spark.createDataFrame([("u1", 1), ("u2", 2)], "id string, v int")
    assert board.item(board_rows, "u2").first()["v"] == 2 and board.item(board_rows, "x").count() == 0
    assert [r["id"] for r in board.without(board_rows, board_rows.filter("v = 1")).collect()] == ["u2"]
    r = lambda v, t: F.struct(F.lit(v).alias("v"), F.lit("t").alias("t"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.create_map(*map(F.lit, t)).alias("tags"))
    assert one(spark, cameras.same(r(1, ["a", "1", "b", "2"]), r(1, ["b", "2", "a", "1"])), cameras.same(r(1, ["a", "1"]), r(2, ["a", "1"]))) == (True, False)
    assert facets.parsed_selection('{"a": "y"}', domains) == {"a": "y", "b": "all"} and facets.parsed_selection("[1", domains) == facets.parsed_selection(None, domains) == {"a": "all", "b": "all"}
    assert one(spark, formats.snapshot_value(F.lit(2818), F.lit("2026-09-09T00:00"), F.lit(31)), formats.dataset_value(F.lit(579), F.lit(None).cast("string"))) == ("2,818 records · osm 2026-09-09 · stale", "579 junctions · osm —")
    nested = spark.sql("SELECT 's' AS source, array(named_struct('key', 'k', 'day_plans', array(named_struct('day_type', 'sunday', 'windows', array(named_struct('start', '07:00'), named_struct('start', '09:00')))))) AS junctions")
    from wayfare.operators import links

    assert [tuple(r) for r in links.flattened(nested).orderBy("win_ord").collect()] == [("s", 0, "k", 0, "sunday", 0, "07:00"), ("s", 0, "k", 0, "sunday", 1, "09:00")]
    assert one(spark, links.junction_place(F.lit(12.9), F.lit(77.6), F.lit("gw-1"), F.lit("J"))["junction"]["distanceM"])[0] == 0
    ts = F.lit("2024-01-01 10:00:30").cast("timestamp_ntz")
    posts = spark.createDataFrame([(1, "c", False), (2, "c", True), (3, "d", False), (4, "e", False)], "id long, client string, bad boolean").withColumn("ts", ts)
    before = spark.range(20).select(F.lit("d").alias("client"), F.lit("2024-01-01 09:30:00").cast("timestamp_ntz").alias("ts"))
    assert [tuple(r) for r in board.submit(spark.createDataFrame([(4,)], "id long"), posts, before).collect()] == [(1, 1704103200000)]
    meta = spark.createDataFrame([("surveillance.v0",)], "schema string")
    with pytest.raises(ValueError):
        cameras.checked_snapshot(meta, board_rows)
    assert json.loads(cameras.features(spark.createDataFrame([(7, 1.0, 2.0)], "id long, lat double, lon double")).first()["feature"])["properties"] == {"id": "7"}
    s = cameras.dataset(spark.createDataFrame([(3, 1)], "total long, named long"), F.lit("2024"), F.lit("b")).first()
    assert s["schema"] == cameras.SCHEMA and json.loads(s["summary"]) == {"total": 3, "named": 1}
    line = F.array(*[F.struct(F.lit(12.9).alias("lat"), F.lit(77.5 + i / 1000).alias("lon")) for i in range(3)])
    assert abs(one(spark, geo.bearing_along(line, F.lit(100.0)))[0] - 90) < 0.01
    assert [tuple(p) for p in one(spark, geo.decoded(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")))[0]] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
