"""A table of keyed rows in versions: hash buckets, of which a commit writes only those it touches.

Under the target lie `v=N/bucket=B` (rows) and `_manifest/v=N` (one row: which version holds each bucket, and what made it). The
manifest is written last, so a run that stops half-way leaves the table as it was, and its folder is written over by the
next. A commit bears a token; what committed once under a token is not committed again. Buckets are few and fixed
with the first commit.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Manifest(NamedTuple):
    version: int
    token: str
    at: str | None
    buckets: int
    held: dict[int, int]  # bucket to the version that holds it
    rows: int


def _list(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store; none where it does not exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def manifests(spark: SparkSession, target: str, last: int = 1) -> list[Manifest]:
    """The newest complete manifests, newest first."""
    out = []
    for name in sorted(_list(spark, f"{target}/_manifest"), reverse=True):
        where = f"{target}/_manifest/{name}"
        if "_SUCCESS" not in _list(spark, where):
            continue
        said = json.loads(spark.read.text(where).first()[0])
        out.append(Manifest(said["version"], said["token"], said["at"], said["buckets"], {int(b): v for b, v in said["held"].items()}, said["rows"]))
        if len(out) == last:
            break
    return out


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def current(spark: SparkSession, target: str, schema: str, now: Manifest | None, only: list[int] | None = None) -> DataFrame:
    """The table's rows with their `bucket`, of some buckets or all."""
    shape = f"{schema}, bucket int"
    paths = [f"{target}/v={v}/bucket={b}" for b, v in sorted((now.held if now else {}).items()) if only is None or b in only]
    if not paths:
        return spark.createDataFrame([], shape)
    # each path names its bucket, which Spark reads only below a base path
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/bucket=(\d+)/", 1).cast("int")
    return spark.read.schema(schema).parquet(*paths).withColumn("bucket", number)


def commit(rows: DataFrame, target: str, touched: list[int], sizes: dict[int, int], before: Manifest | None, token: str, at: str | None, buckets: int) -> Manifest:
    """Write the touched buckets of rows (with `bucket`) as a new version. sizes: rows of each bucket after it."""
    spark, version = rows.sparkSession, before.version + 1 if before else 0
    if touched:
        rows.filter(F.col("bucket").isin(touched)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={version}")
    held = {b: v for b, v in (before.held if before else {}).items() if b not in touched} | {b: version for b in touched if sizes.get(b)}
    now = Manifest(version, token, at, buckets, held, sum(sizes.values()))
    spark.createDataFrame([(json.dumps(now._asdict()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/_manifest/v={version:09d}")
    return now


def prune(spark: SparkSession, target: str, keep: int) -> None:
    """Drop manifests but the last `keep`, and versions that none of those needs."""
    last = manifests(spark, target, keep)
    if not last:
        return
    needed = {v for m in last for v in m.held.values()} | {last[0].version}
    for name in _list(spark, f"{target}/_manifest"):
        if int(name[2:]) < last[-1].version:
            _drop(spark, f"{target}/_manifest/{name}")
    for name in _list(spark, target):
        if name.startswith("v=") and int(name[2:]) < last[0].version and int(name[2:]) not in needed:
            _drop(spark, f"{target}/{name}")
