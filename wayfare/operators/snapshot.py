"""Snapshots of keyed records: cleaning, difference, guard and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Closed bounds of the records kept, as (south, north, west, east).
BOUNDS = (12.6, 13.4, 77.2, 78.0)
PRIVATE = r"(?i)^(?:phone|mobile|fax|email|contact:.*)$"


def reject_reason(kind: Column, id_: Column, lat: Column, lon: Column, stamp: Column) -> Column:
    """The first fault of an element, or null; the order is fixed."""
    s, n, w, e = BOUNDS
    return (
        F.when(kind.isNull(), "not an object").when(kind != "node", F.concat(F.lit("type "), kind)).when(id_.isNull() | (id_ <= 0), "bad id")
        .when(lat.isNull() | lon.isNull(), "missing coordinate").when(~lat.between(s, n) | ~lon.between(w, e), "outside").when(stamp.isNull() | (stamp == ""), "missing timestamp")
    )


def clean_tags(tags: Column) -> Column:
    """Sorted, cleaned, without private keys and empty values."""
    from wayfare.functions.text import clean_tag

    pairs = F.transform(F.map_entries(tags), lambda x: F.struct(clean_tag(x["key"], 64).alias("key"), clean_tag(x["value"]).alias("value")))
    kept = F.filter(pairs, lambda x: x["key"].isNotNull() & x["value"].isNotNull() & ~x["key"].rlike(PRIVATE))
    return F.map_from_entries(F.array_sort(kept))


def canonical(tags: Column) -> Column:
    """Text by which maps compare, whatever their order."""
    return F.to_json(F.array_sort(F.map_entries(tags)))


def last_wins(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per key, that of the greatest ordinal."""
    w = Window.partitionBy(key).orderBy(F.desc(ordinal))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def diff(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """(key, change): inserted, updated, removed or unchanged, by one full outer join.

    Columns are compared one by one, a null with a null; compare maps by their canonical text.
    """
    a = old.select(F.col(key).alias("_a"), F.struct(*compare).alias("_x"))
    b = new.select(F.col(key).alias("_b"), F.struct(*compare).alias("_y"))
    same = F.col("_x").eqNullSafe(F.col("_y"))
    change = F.when(F.col("_a").isNull(), "inserted").when(F.col("_b").isNull(), "removed").when(same, "unchanged").otherwise("updated")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), change.alias("change"))


def sync_counts(changes: DataFrame) -> DataFrame:
    """One row: records by change, for the run log."""
    kinds = ("inserted", "updated", "unchanged", "removed")
    return changes.agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])


def due(last: Column, now: Column, hours: int = 24) -> Column:
    """Whether the last snapshot is old enough for another; without one it is."""
    return F.coalesce(last.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(hours)) <= now.cast("timestamp"), F.lit(True))


def guard(old: int | None, new: int, least: float = 0.5) -> str | None:
    """Why a snapshot must not replace the last one, or None."""
    return f"{old - new} records would go" if old and new < old * least else None


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def cleaned(marked: DataFrame) -> DataFrame:
    """Records (id, lat, lon, v, t, tags, text) of elements marked with `_why` they are rejected; of one id the last counts."""
    none = F.create_map().cast("map<string,string>")
    sound = marked.filter("_why IS NULL").select("id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.coalesce("version", F.lit(1)).alias("v"), F.col("timestamp").alias("t"), clean_tags(F.coalesce("tags", none)).alias("tags"), "ord")
    return last_wins(sound, "id", "ord").drop("ord").withColumn("text", canonical(F.col("tags")))


def sync(elements: DataFrame, target: str, log: str, now: str, least: float = 0.5) -> dict:
    """One run: elements (type, id, lat, lon, version, timestamp, tags, ord) checked, cleaned and compared with the last
    snapshot under `target`, then written beside it; the run's counts go to the log, refusals too.

    A snapshot is a folder named by its time, so a run that stops half-way leaves the last one as it was.
    """
    from pyspark.sql import Row

    spark = elements.sparkSession
    why = reject_reason(F.col("type"), F.col("id"), F.col("lat"), F.col("lon"), F.col("timestamp"))
    marked = elements.withColumn("_why", why)
    new = cleaned(marked)
    seen = marked.agg(F.count_if(F.col("_why").isNotNull()).alias("malformed"), F.count("*").alias("n"), F.count_distinct(F.when(F.col("_why").isNull(), F.col("id"))).alias("kept")).first()
    old = versions(spark, target)
    last = spark.read.parquet(f"{target}/at={old[-1]}") if old else None
    run = {"at": now, "malformed": seen["malformed"], "duplicates": seen["n"] - seen["malformed"] - seen["kept"], "refused": guard(last.count() if last is not None else None, seen["kept"], least)}
    if not run["refused"]:
        run |= sync_counts(diff(last if last is not None else new.limit(0), new, "id", ["v", "t", "lat", "lon", "text"])).first().asDict()
        new.write.mode("overwrite").parquet(f"{target}/at={now}")
    kept = {k: str(v) if isinstance(v, str) else v for k, v in run.items() if v is not None}
    spark.createDataFrame([Row(**kept)]).write.mode("append").json(log)
    return run


def versions(spark, target: str) -> list[str]:
    """Names of the snapshots under `target`, oldest first; listed by Spark, so any store works."""
    from pyspark.errors import AnalysisException

    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(target)
        names = files.select(F.regexp_extract("path", "/at=([^/]+)/", 1).alias("at")).distinct()
        return sorted(r["at"] for r in names.collect())
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
