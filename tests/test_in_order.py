"""Decisions in order by rounds: lights kept apart, lists one after another, clusters nested by zoom."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfare.operators import junctions, spatial
from wayfare.plans.spatial_q import nested_clusters, places
from wayfare.sources import readers

STEP = 40 / 111_320  # degrees of latitude in 40 m


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize(("shuffled", "few"), [(True, 0), (False, 8), (False, 20_000)])
def test_a_dense_lattice_equals_a_loop(spark, shuffled, few):
    rng = random.Random(1)
    points = [(12.9 + y * STEP, 77.6 + x * STEP) for y in range(7) for x in range(7)] + [(12.9, 77.6)] * 40  # a heap at one place
    order = list(range(len(points)))
    if shuffled:
        rng.shuffle(order)
    rows = [(o, *p) for o, p in zip(order, points, strict=True)]
    kept = []
    for o, *p in sorted(rows):
        if all(metres(p, q) > 60 for _, q in kept):
            kept.append((o, p))
    got = spatial.lights_apart(spark.createDataFrame(rows, "ord long, lat double, lon double").repartition(3), 60.0, 12.9, few=few)
    assert {r["ord"] for r in got.collect()} == {o for o, _ in kept}
    assert spatial.lights_apart(spark.createDataFrame([], "ord long, lat double, lon double"), 60.0, 12.9).count() == 0


def test_lists_one_after_another_equal_a_loop(spark, tmp_path):
    rng = random.Random(4)
    spot = lambda: (12.9 + rng.randrange(9) * STEP * 0.7, 77.6 + rng.randrange(9) * STEP * 0.7)
    known = {i: spot() for i in range(1, 6)}
    built = {f"j{i}": spot() for i in range(2)}
    files = {}
    for k, name in enumerate(("b_2024-02-01.csv", "a_2024-01-31.csv")):
        files[name] = [(i, *(known[i] if i in known and rng.random() < 0.5 else spot())) for i in rng.sample(range(1, 40), 22)]
        rows = [f"{i},{y},{x},N{i},signal,,,src{(i + k) % 2}" for i, y, x in files[name]]
        (tmp_path / name).write_text("osm_id,lat,lon,name,traffic_signals,direction,crossing,source\n" + "\n".join([*rows, "oops,1,2,,,,,"]) + "\n")
    want, places_ = {}, dict(built)
    for name in sorted(files):
        for i, y, x in files[name]:
            if i in known:
                want[name, i] = ("moved" if metres((y, x), known[i]) > 5 else "present", str(i))
                continue
            d, to = min(((metres((y, x), p), n) for n, p in places_.items()), key=lambda z: z[0], default=(1e9, None))
            want[name, i] = ("attached", to) if d <= 60 else ("added", str(i))
            if d > 60:
                places_[str(i)] = (y, x)
    found = readers.lists(spark, [str(tmp_path / n) for n in files])
    nodes = spark.createDataFrame([(i, *p) for i, p in known.items()], "id long, lat double, lon double")
    sites = spark.createDataFrame([(n, *p) for n, p in built.items()], "junction string, lat double, lon double")
    listed, out = junctions.reconcile_lists([(n, rows) for n, rows, _ in found], sites, nodes, 12.9)
    assert {(r["file"], r["id"]): (r["outcome"], r["to"]) for r in out.collect()} == want
    tags = nodes.select("id", F.create_map(F.lit("name"), F.concat(F.lit("N"), F.col("id").cast("string")), F.lit("traffic_signals"), F.lit("signal")).alias("tags"))
    for r in junctions.list_reports(listed, out, nodes, tags).collect():
        mine = {i: o for (n, i), (o, _) in want.items() if n == r["file"]}
        tally = lambda *k: sum(o in k for o in mine.values())
        assert (r["rows"], r["present"], r["moved"], r["attached"], r["added"], r["tag_differences"]) == (22, tally("present", "moved"), tally("moved"), tally("attached"), tally("added"), 0)
        assert r["not_in_file"] == len(set(known) - set(mine)) and str(r["as_of"]) == r["file"][2:12] and r["provider"] in ("src0", "src1")
    assert {r["to"] for r in junctions.seeded(out).collect()} == {t for o, t in want.values() if o == "attached"}


def pooled(points, low, high, pixels=44):
    """Clusters of every zoom by one pass in order: (zoom, id) to (n, x, y)."""
    turn = lambda lat: math.sin(math.radians(lat))
    nodes = sorted((o, lon / 360 + 0.5, 0.5 - 0.25 * math.log((1 + turn(lat)) / (1 - turn(lat))) / math.pi, 1) for o, lat, lon in points)
    out = {}
    for zoom in range(high, low - 1, -1):
        reach, taken, now = pixels / (512 * 2.0**zoom), set(), []
        for o, x, y, _ in nodes:
            if o in taken:
                continue
            mine = [m for m in nodes if m[0] not in taken and math.sqrt((m[1] - x) ** 2 + (m[2] - y) ** 2) <= reach]
            taken |= {m[0] for m in mine}
            n = sum(m[3] for m in mine)
            now.append((o, x, y, mine[0][3]) if len(mine) == 1 else (o, sum(m[1] * m[3] for m in mine) / n, sum(m[2] * m[3] for m in mine) / n, n))
            out[zoom, o] = (n, round(now[-1][1], 9), round(now[-1][2], 9))
        nodes = now
    return out


def test_nested_clusters_equal_one_pass(spark):
    rng = random.Random(6)
    points = [(i, 12.9 + rng.gauss(0, 0.01), 77.6 + rng.gauss(0, 0.01)) for i in range(120)]
    got = spatial.nested_clusters(spark.createDataFrame(points, "ord long, lat double, lon double"), 10, 14, few=40).collect()
    want = pooled(points, 10, 14)
    assert {(r["zoom"], r["id"]): r["n"] for r in got} == {k: v[0] for k, v in want.items()}
    for r in got:
        assert abs(r["lon"] / 360 + 0.5 - want[r["zoom"], r["id"]][1]) < 1e-8
    ids = {(r["zoom"], r["id"]) for r in got}
    assert all((r["zoom"] - 1, r["up"]) in ids for r in got if r["zoom"] > 10) and all(r["up"] is None for r in got if r["zoom"] == 10)


def test_nested_clusters_of_the_given_customers(spark):
    sf = "/root/testdata/sf0.001"
    points = [tuple(r) for r in places(spark, sf, "customer", "c_custkey").select("c_custkey", "lat", "lon").collect()]
    assert {(r["zoom"], r["id"]): r["n"] for r in nested_clusters(spark, sf).collect()} == {k: v[0] for k, v in pooled(points, 8, 14).items()}


def test_names_in_the_order_of_readers(spark):
    want = ["a", "A", "a b", "a-b", "ab", "äb", "b", "e", "é", "Z"]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(reversed(want))], "name string, ord int")
    got = junctions.browse(rows, "name", "ord", 4, 3).orderBy("place").collect()
    assert [(r["name"], r["place"]) for r in got] == [(n, i + 1) for i, n in enumerate(want)][3:7]
    assert junctions.browse(rows.limit(0), "name", "ord", 4).count() == 0
