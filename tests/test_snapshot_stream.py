"""Snapshots over a stream: stopped and started, from new checkpoints, refused and early ones, versions and buckets."""

import random

from wayfare.sources import store
from wayfare.streaming import jobs

SHAPE = "type string, id long, lat double, lon double, version int, timestamp string, tags map<string,string>, ord int, at timestamp"


def element(i, o, at, name="n", kind="node", lat=12.9):
    return (kind, i, lat, 77.6, None, "2024", {"name": name, "phone": "1"}, o, at)


def batches():
    import datetime

    day = lambda d, h=0: datetime.datetime(2024, 1, d, h, tzinfo=datetime.UTC)
    first = [element(i, i, day(1)) for i in range(1, 41)] + [element(5, 99, day(1), "later"), element(7, 100, day(1), kind="way"), element(8, 101, day(1), lat=0.0)]
    second = [element(i, i, day(2), "z" if i == 3 else "later" if i == 5 else "n") for i in range(1, 41) if i not in (10, 11)] + [element(60, 0, day(2))]
    early = [element(i, i, day(2, 9), "early") for i in range(1, 41)]
    small = [element(1, 1, day(4))]
    last = [element(i, i, day(5), "n") for i in range(1, 45)]
    return [first, second, early, small, last]


def started(spark, tmp_path, ck, **kw):
    source = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.sync_stream(source, str(tmp_path / "out"), str(tmp_path / "log"), str(tmp_path / ck), buckets=8, **kw).awaitTermination()


def names(spark, tmp_path):
    return {r["id"]: r["tags"].get("name") for r in jobs.synced(spark, str(tmp_path / "out")).collect()}


def test_stream_of_snapshots(spark, tmp_path):
    every, target = batches(), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(every[0])
    started(spark, tmp_path, "ck")
    want = {i: "later" if i == 5 else "n" for i in range(1, 41)}
    assert names(spark, tmp_path) == want
    for rows in every[1:4]:
        put(rows)
        started(spark, tmp_path, "ck")  # stopped and started again
    want = {i: "z" if i == 3 else "later" if i == 5 else "n" for i in range(1, 41) if i not in (10, 11)} | {60: "n"}
    assert names(spark, tmp_path) == want
    (now,) = store.manifests(spark, target)
    changed = {r["b"] for r in spark.createDataFrame([(3,), (10,), (11,), (60,)], "id long").select(store.bucket("id", 8).alias("b")).collect()}
    assert now.version == 1 and {b for b, v in now.held.items() if v == 1} <= changed and any(v == 0 for v in now.held.values())
    log = {(r["at"][:13], r["ok"]): r.asDict() for r in spark.read.json(f"{tmp_path}/log").collect()}
    assert [log["2024-01-01 00", True][k] for k in ("inserted", "malformed", "duplicates")] == [40, 2, 1]
    assert [log["2024-01-02 00", True][k] for k in ("inserted", "updated", "unchanged", "removed")] == [1, 1, 37, 2]
    assert log["2024-01-02 09", False]["error"] == "too early" and log["2024-01-04 00", False]["error"] == "38 records would go"
    # a new checkpoint reads the folder anew: what is older than the table or too small is passed over, and nothing is lost
    put(every[4])
    started(spark, tmp_path, "other")
    assert names(spark, tmp_path) == {i: "n" for i in range(1, 45)}
    started(spark, tmp_path, "other", force=True)
    assert len(store.manifests(spark, target, 99)) <= 3


def test_a_batch_that_runs_again_commits_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 3), (2, "b", 3)], "id long, w string, bucket int")
    target = str(tmp_path / "t")
    first = store.commit(rows, target, [3], {3: 2}, None, "ck#0", None, 4)
    assert store.manifests(spark, target) == [first]
    rows.write.parquet(f"{target}/v=1/bucket=3")  # a run that stopped before its manifest
    assert store.manifests(spark, target) == [first] and store.current(spark, target, "id long, w string", first).count() == 2
    for k in range(1, 6):
        first = store.commit(rows, target, [3], {3: 2}, first, f"ck#{k}", None, 4)
    store.prune(spark, target, 2)
    assert [m.version for m in store.manifests(spark, target, 9)] == [5, 4] and store._list(spark, target) == ["_manifest", "v=4", "v=5"]
    assert store.current(spark, target, "id long, w string", first).count() == 2


def test_upserts_over_checkpoints(spark, tmp_path):
    rng = random.Random(3)
    want, target = {}, str(tmp_path / "out")
    for k in range(4):
        rows = [(rng.randrange(30), f"v{k}-{j}", 10 * k + j) for j in range(9)]
        want |= {i: w for i, w, _ in rows}
        spark.createDataFrame(rows, "id long, w string, ts int").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        stream = spark.readStream.schema("id long, w string, ts int").parquet(str(tmp_path / f"in{k}"))
        jobs.upsert_snapshots(stream, target, str(tmp_path / f"ck{k}"), buckets=4).awaitTermination()  # every time a new checkpoint
        (now,) = store.manifests(spark, target)
        got = store.current(spark, target, "id long, w string, ts int", now).collect()
        assert {r["id"]: r["w"] for r in got} == want and len(got) == now.rows == len(want)
