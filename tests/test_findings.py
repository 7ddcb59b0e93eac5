"""Small cases of what went wrong over larger tables or odd values."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from wayfare.plans import catalogue


def events(spark, path, rows):
    """A folder with an events table of (event_id, ts, user_id, event_type, value)."""
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.write.parquet(f"{path}/events.parquet")
    return str(path)


def test_allowances_take_event_ids_beyond_a_million_seconds(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    folder = events(spark, tmp_path, [(150_001 + i, at, 1, "view", 1.0) for i in range(3)])
    got = catalogue.QUERIES["allowances"](spark, folder).collect()
    assert sorted((r["id"], r["wait"]) for r in got) == [(150_001, None), (150_002, None), (150_003, None)]


def test_angular_difference_is_one_number_both_ways(spark):
    from wayfare.functions import geo

    pairs = [(i / 10, (i + 200) / 10) for i in range(0, 3400, 7)] + [((i + 200) / 10, i / 10) for i in range(0, 3400, 7)]
    got = spark.createDataFrame(pairs, "a double, b double").select("a", "b", geo.angular_difference(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r["d"] == min(abs(r["a"] - r["b"]), 360 - abs(r["a"] - r["b"])) for r in got)


def test_moments_go_to_the_nearest_millisecond(spark, tmp_path):
    late = datetime.datetime(2024, 1, 2, 3, 4, 59, 999600)
    folder = events(spark, tmp_path, [(1, late, 1, "view", 1.0), (2, late - datetime.timedelta(microseconds=200), 1, "view", 1.0)])
    filed = {r["event_id"]: r["filed"] for r in catalogue.QUERIES["clock_labels"](spark, folder).collect()}
    assert filed == {1: 1704164700000, 2: 1704164640000}
    assert '"filedAt":1704164700000' in {r["id"]: r["body"] for r in catalogue.QUERIES["public_posts"](spark, folder).collect()}[1]


def test_a_minute_ends_at_the_nearest_millisecond(spark, tmp_path):
    at = datetime.datetime(2024, 1, 2, 3, 4, 0, 600)  # counted as 1 ms, so the third is 59,999 ms behind it
    rows = [(1, at, 1, "view", 1.0), (2, at, 2, "view", 1.0), (3, datetime.datetime(2024, 1, 2, 3, 5, 0, 400), 3, "view", 1.0)]
    got = catalogue.QUERIES["admission_of_all"](spark, events(spark, tmp_path, rows)).collect()
    assert {r["seq"]: r["wait"] for r in got} == {1: None, 2: None, 3: 60}


def test_half_a_place_of_a_size_goes_to_the_even_digit(spark, tmp_path):
    rows = [(1, 1, "F", 81920.0, datetime.datetime(1995, 1, 1), "1-URGENT"), (2, 1, "F", 114688.0, datetime.datetime(1995, 1, 1), "1-URGENT"), (3, 1, "F", 81920.5, datetime.datetime(1995, 1, 1), "1-URGENT")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"]: r["size"] for r in catalogue.QUERIES["value_labels"](spark, str(tmp_path)).collect()}
    assert got == {1: "1.2 MB", 2: "1.8 MB", 3: "1.3 MB"}  # 1.25, 1.75 and a little over 1.25


def test_rows_of_one_height_are_read_in_one_order(spark):
    from wayfare.operators import layout

    rows = [(p, 5.0, s, e, "timed", True, 0) for p in range(40) for s, e in (("06:00", "07:00"), ("04:00", "05:00"), ("05:00", "06:00"))]
    df = spark.createDataFrame(rows, "panel long, top double, start string, end string, mode string, consistent boolean, unassigned int")
    got = layout.ordered(layout.day_groups(df.repartition(3))).collect()
    assert sorted((r["panel"], r["day"], r["windows"], r["windows_ordered"]) for r in got) == [(p, 0, 3, True) for p in range(40)]


def test_claims_that_differ_in_their_note_alone_are_ranked_by_it(spark):
    from wayfare.operators import links

    now = datetime.datetime(2024, 1, 31)
    rows = [(j, "feed", a, now) for j in range(40) for a in (None, "N", "E")]
    live = links.live_claims(spark.createDataFrame(rows, "junction long, source string, approach string, observed timestamp_ntz"), F.lit(now))
    got = links.claims(live).select("note", "rank").distinct().collect()
    assert sorted((r["rank"], r["note"]) for r in got) == [(1, "Approach E"), (2, "Approach N"), (3, "Junction-wide state")]


def spots(spark, n, seed, spread=0.02):
    import random

    r = random.Random(seed)
    rows = [(i, 13.0 + round(r.gauss(0, spread), 4), 77.6 + round(r.gauss(0, spread), 4)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, lat double, lon double")


def test_nearest_in_widening_circles_is_the_nearest(spark):
    from wayfare.operators import spatial

    a, b = spots(spark, 300, 1), spots(spark, 400, 2, 0.004).union(spots(spark, 60, 3))
    b = b.select((F.col("id") + F.monotonically_increasing_id() % 1000 * 1000).alias("id"), "lat", "lon")
    pairs = spatial.radius_join(a, b, 2000.0, 13.0, "id", "id").groupBy("l").agg(F.min(F.struct("metres", "r")).alias("m"))
    want = {(r.l, r.m.r, r.m.metres) for r in pairs.collect()}
    assert want and {tuple(r) for r in spatial.nearest_within(a, b, 2000.0, 13.0, "id", "id", crowd=1).collect()} == want


def test_components_by_cells_are_those_of_all_pairs(spark):
    from wayfare.operators import spatial
    from wayfare.operators.graph import connected_components

    for metres, n, seed in ((300.0, 150, 4), (600.0, 200, 5)):
        pts = spots(spark, n, seed, 0.05)
        want = {tuple(r) for r in connected_components(spatial.epsilon_edges(pts, metres, 13.0, "id")).collect()}
        got = {tuple(r) for r in spatial.epsilon_components(pts, metres, 13.0, "id").collect()}
        linked = {node for node, _ in want}
        assert {g for g in got if g[0] in linked} == want and all(a == b for a, b in got if a not in linked) and len(got) == n


def test_points_at_one_place_are_picked_alike(spark):
    from wayfare.operators import spatial

    points = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(9)], "p long, x double, y double")
    marks = spark.createDataFrame([(5, 2, 1.0, 0.0), (6, 1, 1.0, 0.0), (7, 0, 9.0, 0.0)], "m long, ord int, x double, y double")
    got = {tuple(r) for r in spatial.picked(points, marks, 2.0).collect()}
    assert got == {(i, 6, abs(i % 3 - 1.0)) for i in range(9)}


def test_panels_of_one_name_and_roads_are_matched_once_and_all_listed(spark, monkeypatch):
    from wayfare.operators import match

    asked = []
    plain = match.by_words
    monkeypatch.setattr(match, "by_words", lambda panels, index: (asked.append(panels.count()), plain(panels, index))[1])
    panels = spark.createDataFrame([(i, "Silk Board" if i % 2 else None, ["Hosur Road"]) for i in range(1, 7)], "panel long, name string, roads array<string>")
    index = spark.createDataFrame([(1, 1, "Silk Board", ["Hosur Road"], 12.9, 77.6)], "id long, ord long, name string, roads array<string>, lat double, lon double")
    places = spark.createDataFrame([], "query string, lat double, lon double, label string, osm string")
    got = match.match(panels, index, places, 13.0).collect()
    assert asked == [2] and sorted(r["panel"] for r in got) == [1, 2, 3, 4, 5, 6] and {r["id"] for r in got} == {1}


def test_lines_of_a_page_bear_their_mean(spark):
    import random

    from wayfare.operators import layout

    draw = random.Random(5)
    tops = {doc: sorted(draw.randint(0, 800) / 2 for _ in range(n)) for doc, n in ((1, 300), (2, 1), (3, 40))}
    words = [(doc, str(i), float(i), i + 1.0, top, 7.0) for doc, each in tops.items() for i, top in enumerate(each)]
    want = {}
    for doc, each in tops.items():
        held, mean = [], 0.0
        for i, top in enumerate(each):
            if held and abs(mean - top) <= 3.5:
                mean = (mean * len(held[-1]) + top) / (len(held[-1]) + 1)
                held[-1].append((i, top))
            else:
                mean = top
                held.append([(i, top)])
        want |= {(doc, str(i)): (line, sum(t for _, t in ws) / len(ws)) for line, ws in enumerate(held) for i, _ in ws}
    got = layout.lines(spark.createDataFrame(words, "doc int, text string, x0 double, x1 double, top double, size double").repartition(3)).collect()
    assert {(r["doc"], r["text"]): (r["line"], r["ltop"]) for r in got} == want


def test_numbers_are_placed_without_sorting_pairs(spark):
    from wayfare.operators import layout

    numbers = spark.createDataFrame([(1, 0, 14.0, 30), (1, 0, 14.0, 30), (1, 0, 14.0, 31), (1, 0, 56.0, 40), (1, 0, 56.0, 40), (1, 1, 149.0, 90), (1, 1, 300.0, 7), (1, 1, 300.0, 7), (2, 0, 15.0, 5)], "panel int, row int, x double, value long")
    columns = spark.createDataFrame([(1, 0, 15.0), (1, 1, 55.0)], "panel int, phase int, x double")
    cycles = spark.createDataFrame([(1, 150.0)], "panel int, cycle_x double")
    placed = layout.placed_numbers(numbers, columns, cycles)
    want = {(1, 0, 14.0, 30, "phase", 0), (1, 0, 14.0, 31, "none", None), (1, 0, 56.0, 40, "phase", 1), (1, 1, 149.0, 90, "cycle", None), (1, 1, 300.0, 7, "none", None), (2, 0, 15.0, 5, "none", None)}
    got = [tuple(r) for r in placed.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SortAggregate" not in plan  # no pairs of numbers and columns are sorted


def test_samples_of_one_second_meet_a_query_once(spark, monkeypatch):
    import math

    from wayfare.operators import stats

    asked, plain = [], stats.write_table
    monkeypatch.setattr(stats, "write_table", lambda df, label, *a, **k: (label == "kernel-pairs" and asked.append(df.count()), plain(df, label, *a, **k))[1])
    at, now = datetime.datetime(2024, 1, 29, 6), datetime.datetime(2024, 1, 31)
    rows = [(1, at + datetime.timedelta(seconds=i % 5 * 600, microseconds=i), float(i % 3), i % 4 == 0, 0.5 + i % 10 / 20) for i in range(600)]
    samples = spark.createDataFrame(rows, "junction int, ts timestamp_ntz, delay double, stopped boolean, quality double")
    queries = spark.createDataFrame([(7, 1, at)], "qid long, junction int, t timestamp_ntz")
    (got,) = stats.kernel_estimates(samples, queries, F.lit(now).cast("timestamp_ntz")).collect()
    each = []
    for _, ts, delay, stopped, quality in rows:
        apart = math.floor((ts - at).total_seconds())
        each.append((math.exp(-(apart**2) / (2 * 900.0**2)) * math.exp(-(apart**2) / (2 * 259200.0**2)) * math.exp(-(now - ts).total_seconds() / 3888000.0) * quality, delay, stopped))
    total = sum(w for w, _, _ in each)
    assert asked == [15] and got["n"] == 600
    assert abs(got["mean_delay"] - sum(w * d for w, d, _ in each) / total) < 1e-9 and abs(got["p_stop"] - sum(w for w, _, s in each if s) / total) < 1e-9
    assert abs(got["n_eff"] - total**2 / sum(w * w for w, _, _ in each)) < 1e-6 and (got["p10"], got["p50"], got["p90"]) == (0.0, 1.0, 2.0)


def test_windows_of_one_moment_leave_out_other_days(spark):
    from wayfare.operators import plans

    rows = [(k, o, day, 0, "07:00", "12:00", "timed", 60, [30, 30], None) for k in (1, 2) for o, day in enumerate(("weekday_default", "sunday", "saturday"))]
    windows = spark.createDataFrame(rows, "key int, plan_ord int, day_type string, win_ord int, start string, end string, mode string, cycle_s int, phases array<int>, ped int").filter("key = 1 OR plan_ord = 0")
    at = F.expr("TIMESTAMP '2024-01-07 04:30:00Z'")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "key int").withColumn("ts", at)
    got, want = (sorted(map(tuple, plans.active_windows(keys, windows, "key", at=a).collect())) for a in (at, None))
    assert got == want and [r[2:5] for r in got] == [("sunday", False, "timed"), ("weekday_default", True, "timed"), ("none", False, "none")]


def test_words_of_a_page_are_dealt_once_and_read_where_they_lie(spark, monkeypatch, capsys):
    from wayfare.operators import layout, pages

    kept, write = [], pages.write_table
    monkeypatch.setattr(pages, "write_table", lambda df, label: kept.append(label) or write(df, label))
    got = catalogue.QUERIES["page_plans"](spark, "/root/testdata/sf0.001")
    assert kept == ["page-panels"]
    got.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") <= 4 and "landmark" not in plan  # rows and what a panel says of itself, by panel
    words = [(1, t, x, x + 9.0, y, s) for t, x, y, s in [("A,", 1.0, 5.0, 9.0), ("B", 30.0, 5.0, 9.0), ("POLICE", 60.0, 5.0, 9.0), ("STATION", 99.0, 5.0, 9.0), ("ROAD", 70.0, 50.0, 7.0), ("11", 150.0, 50.0, 7.0), ("1", 150.0, 53.0, 7.0), ("EEXXCCLLUUSSIIVVEE", 148.0, 60.0, 5.0), ("7:00", 70.0, 80.0, 7.0), ("9:00", 99.0, 81.0, 7.0), ("8", 40.0, 80.0, 7.0), ("44(50)", 150.0, 82.0, 7.0), ("BBLLIINNKK", 10.0, 84.0, 7.0)]]
    words.append((1, "2", 200.0, 209.0, 50.0, 7.0))
    df = spark.createDataFrame(words, "doc int, text string, x0 double, x1 double, top double, size double")
    (row,) = pages.read_pages(layout.gathered(df).repartition(2)).collect()
    (window,) = row["day_plans"][0]["windows"]
    assert (row["phase_count"], row["pedestrian_phase"], row["approach_landmarks"], row["header"]["name"]) == (2, 0, None, "A")
    assert (window["start"], window["end"], window["mode"], window["phases"], window["alternates"], window["labels"], window["raw"]) == ("07:00", "09:00", "blinking", [44, None], [50, None], ["BLINK"], "BLINK 8 7:00 9:00 44(50)")
