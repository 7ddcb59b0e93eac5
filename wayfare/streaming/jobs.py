"""Streaming twins: the same counts and limits over a stream, with bounded state."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import clock
from wayfare.operators.board import CLIENT_DAY, CLIENT_HOUR, DAY_MS, Limits, admission_of_all
from wayfare.scratch import write_table


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet as a stream; plain times become instants, which watermarks need."""
    got = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return got.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 day", kind: str = "event_type") -> DataFrame:
    """Counts and sums per window and kind; what comes later than `late` is dropped."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    got = events.withWatermark("ts", late).groupBy(span, kind).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return got.select(F.col("window.start").alias("start"), kind, "n", "value")


def kind_counts(events: DataFrame, kind: str = "event_type", signed: str | None = None) -> DataFrame:
    """Running counts per kind; with a column of +1 and -1, removals count down."""
    n = F.sum(signed) if signed else F.count("*")
    return events.groupBy(kind).agg(n.alias("n"))


def fresh(events: DataFrame, seconds: int = 30, observed: str = "observed_at") -> DataFrame:
    """Only what was observed no longer ago than `seconds`."""
    return events.filter(F.current_timestamp() - F.col(observed) <= F.expr(f"INTERVAL {seconds} SECONDS"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day", key: str = "user_id") -> DataFrame:
    got = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return got.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _admit(per_hour: int, per_day: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the day is over: nothing that hangs on a client stays
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ms", "id"])
        passed = list(state.get[0]) if state.exists else []
        out = []
        for ms, i in zip(rows["ms"], rows["id"], strict=True):
            ok = sum(p > ms - 3_600_000 for p in passed) < per_hour and len(passed) < per_day
            out.append((i, ok))
            if ok:
                passed.append(int(ms))
        state.update((passed,))
        state.setTimeoutTimestamp(max(int(rows["ms"].max()) + 2 * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "ok"])

    return run


def admission_stream(posts: DataFrame, post_id: str, client: str = "client", per_hour: int = CLIENT_HOUR, per_day: int = CLIENT_DAY) -> DataFrame:
    """(id, ok): posting limits with feedback, state per client and UTC day, at most per_day times each.

    A day's state goes once the watermark is two days past its last post.
    """
    rows = posts.withWatermark("ts", "1 day").select("ts", F.col(client).alias("c"), F.date_format("ts", "yyyy-MM-dd").alias("d"), clock.millis(F.col("ts")).alias("ms"), F.col(post_id).alias("id"))
    return rows.groupBy("c", "d").applyInPandasWithState(_admit(per_hour, per_day), "id long, ok boolean", "passed array<long>", "append", "EventTimeTimeout")


def submissions(posts: DataFrame, target: str, checkpoint: str, limits: Limits = Limits(), id_: str = "id"):
    """Every micro-batch of posts (id, client, ts, ...) judged under all four limits, counting what earlier batches let pass.

    A batch is judged in order of time and writes its verdicts (id, client, t, wait) to a folder of its own, so that a
    batch which runs again rewrites them; the 24 hours before its first post are read back from the others. Batches
    must come in order of time, as a log does. Start a new checkpoint with a new target.
    """

    def judge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.agg(F.min(clock.millis(F.col("ts"))).alias("t")).first().t
        if first is None:
            return
        names = {f.name: f.dataType.simpleString() for f in batch.schema}
        shape = f"id {names[id_]}, client {names['client']}, t bigint, wait int, batch bigint"
        os_path = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = os_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(os_path)
        before = spark.read.schema(shape).parquet(target).filter((F.col("batch") < number) & F.col("wait").isNull() & (F.col("t") > first - DAY_MS)) if there else None
        judged = admission_of_all(batch, id_, limits=limits, before=before)
        judged.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return posts.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _sizes(changes: DataFrame) -> tuple[dict[int, int], list[int], dict[str, int]]:
    """(rows of each bucket afterwards, buckets that change, counts by change) of (bucket, change); one row a bucket and change."""
    sizes, touched, counts = {}, set(), dict.fromkeys(("inserted", "updated", "unchanged", "removed"), 0)
    for r in changes.groupBy("bucket", "change").agg(F.count("*").alias("n")).collect():
        counts[r.change] += r.n
        if r.change != "unchanged":
            touched.add(r.bucket)
        if r.change != "removed":
            sizes[r.bucket] = sizes.get(r.bucket, 0) + r.n
    return sizes, sorted(touched), counts


def upsert_snapshots(stream: DataFrame, target: str, checkpoint: str, key: str = "id", buckets: int = 64, keep: int = 3):
    """Each micro-batch replaces the table's rows of its keys, in the buckets that hold them; the latest `ts` of a batch wins.

    The table is a `store`: a batch that runs again commits once, a new checkpoint goes on with the table it finds, and versions that
    the last `keep` manifests do not need are dropped.
    """
    from wayfare.operators.snapshot import last_wins, upsert
    from wayfare.sources import store

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)

    def merge(batch: DataFrame, number: int) -> None:
        spark, token = batch.sparkSession, f"{checkpoint}#{number}"
        now = next(iter(store.manifests(spark, target)), None)
        if now and now.token == token:
            return
        n = now.buckets if now else buckets
        new = write_table(last_wins(batch, key, "ts").withColumn("bucket", store.bucket(key, n)), "batch")
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        if not touched:
            return
        old = store.current(spark, target, shape, now, touched)
        rows = write_table(upsert(old.select(new.columns), new, key), "merged")
        sizes = {r.bucket: r.n for r in rows.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        rest = store.current(spark, target, shape, now).filter(~F.col("bucket").isin(touched)).groupBy("bucket").agg(F.count("*").alias("n")) if now else None
        sizes |= {r.bucket: r.n for r in rest.collect()} if rest is not None else {}
        store.commit(rows, target, touched, sizes, now, token, None, n)
        store.prune(spark, target, keep)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


RECORD = "id bigint, lat double, lon double, v int, t string, tags map<string,string>, text string"


def sync_stream(elements: DataFrame, target: str, log: str, checkpoint: str, least: float = 0.5, hours: int = 24, force: bool = False, buckets: int = 64, keep: int = 3):
    """A stream of whole snapshots, one a micro-batch: checked, cleaned, compared with the table and committed, as `snapshot.sync` does for one.

    elements: type, id, lat, lon, version, timestamp, tags, ord, at (when the snapshot was taken). A snapshot taken less than `hours`
    after the last commit is passed over, one that would lose too many records refused; either is logged, like what was
    committed, in a folder of the log that the batch owns. Only buckets in which a record changes are written. The counts of bad and repeated
    elements are observed while the batch is cleaned.
    """
    from pyspark.sql import Observation, Row

    from wayfare.operators import snapshot
    from wayfare.sources import store

    def run(batch: DataFrame, number: int) -> None:
        spark, token = batch.sparkSession, f"{checkpoint}#{number}"
        now = next(iter(store.manifests(spark, target)), None)
        if now and now.token == token:
            return
        n, seen = now.buckets if now else buckets, Observation()
        why = snapshot.reject_reason(*(F.col(c) for c in ("type", "id", "lat", "lon", "timestamp")))
        marked = batch.withColumn("_why", why).observe(seen, F.count("*").alias("n"), F.count_if(F.col("_why").isNotNull()).alias("malformed"), F.max("at").cast("string").alias("at"))
        new = write_table(snapshot.cleaned(marked).withColumn("bucket", store.bucket("id", n)), "batch")
        facts, kept = seen.get, new.count()
        if not facts["n"]:
            return
        run = {"token": token, "at": facts["at"], "malformed": facts["malformed"], "duplicates": facts["n"] - facts["malformed"] - kept}
        early = now and not force and not spark.range(1).select(snapshot.due(F.lit(now.at), F.lit(facts["at"]), hours)).first()[0]
        refused = None if force else snapshot.guard(now.rows if now else None, kept, least)
        if early or refused:
            run |= {"ok": False, "error": "too early" if early else refused}
        else:
            old = store.current(spark, target, RECORD, now)
            changes = snapshot.diff(old, new, "id", ["v", "t", "lat", "lon", "text"]).withColumn("bucket", store.bucket("id", n))
            sizes, touched, counts = _sizes(changes)
            store.commit(new, target, touched, sizes, now, token, facts["at"], n)
            store.prune(spark, target, keep)
            run |= {"ok": True, **counts}
        spark.createDataFrame([Row(**run)]).coalesce(1).write.mode("overwrite").json(f"{log}/checkpoint={hash_of(checkpoint)}/batch={number}")

    return elements.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hash_of(text: str) -> int:
    """A number that names a text, the same on every run."""
    return zlib.crc32(text.encode())


def synced(spark: SparkSession, target: str) -> DataFrame:
    """The records of the last snapshot committed under target."""
    from wayfare.sources import store

    return store.current(spark, target, RECORD, next(iter(store.manifests(spark, target)), None)).drop("bucket")
