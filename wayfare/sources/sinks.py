"""Sinks: JSON datasets, features, append-only logs and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULLS = {"ignoreNullFields": "false"}


def point_features(df: DataFrame, properties: list[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One GeoJSON feature per row, as text; nulls are kept."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")), NULLS).alias("feature"))


def polygon_feature(ring: Column, properties: Column) -> Column:
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), NULLS)


def write_records(df: DataFrame, path: str) -> None:
    """One record a line, nulls kept."""
    df.select(F.to_json(F.struct(*df.columns), NULLS).alias("value")).write.text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upsert_registry(old: DataFrame, new: DataFrame, key: str = "id", ordinal: str = "ord") -> DataFrame:
    """new's rows in their old places; those without one at the end, in their own order."""
    last = old.agg(F.coalesce(F.max(ordinal), F.lit(-1)).alias("_last"))
    placed = new.drop(ordinal).join(old.select(key, F.col(ordinal).alias("_o")), key, "left")
    fresh = new.select(key, F.col(ordinal).alias("_n"))
    placed = placed.join(fresh, key).crossJoin(F.broadcast(last))  # one row
    placed = placed.withColumn(ordinal, F.coalesce("_o", F.col("_last") + 1 + F.col("_n"))).drop("_o", "_n", "_last")
    return old.join(new.select(key), key, "left_anti").unionByName(placed)


def write_document(meta: DataFrame, records: DataFrame, path: str, ordinal: str) -> None:
    """One line of meta, then one record a line in their order: a dataset in a folder of text parts.

    Meta stands in the first part; the records follow by ranges of their ordinal.
    """
    head = meta.select(F.lit(0).alias("_part"), F.lit(None).cast("long").alias("_ord"), F.to_json(F.struct(*meta.columns), NULLS).alias("value"))
    body = records.select(F.lit(1).alias("_part"), F.col(ordinal).cast("long").alias("_ord"), F.to_json(F.struct(*[c for c in records.columns if c != ordinal]), NULLS).alias("value"))
    head.union(body).orderBy("_part", "_ord").select("value").write.text(path)


def nested_plans(blocks: DataFrame, windows: DataFrame, drop: tuple[str, ...] = ("raw", "labels", "unassigned")) -> DataFrame:
    """(source, junctions): blocks nested under their source, windows under their block, raw readings left out.

    blocks: source, key, ord, ...; windows: key, ord, ...
    """
    keep = [c for c in windows.columns if c not in (*drop, "key", "ord")]
    own = windows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", *keep))), lambda w: F.struct(*[w[c].alias(c) for c in keep])).alias("windows"))
    fields = [c for c in blocks.columns if c not in ("source", "ord")]
    rows = blocks.join(own, "key", "left").withColumn("windows", F.coalesce("windows", F.slice(F.array(F.struct(*[F.lit(None).cast(windows.schema[c].dataType).alias(c) for c in keep])), 1, 0)))
    listed = F.array_sort(F.collect_list(F.struct("ord", *fields, "windows")))
    return rows.groupBy("source").agg(F.transform(listed, lambda b: F.struct(*[b[c].alias(c) for c in [*fields, "windows"]])).alias("junctions"))


def sitemap(junctions: DataFrame, origin: str, pages: tuple[str, ...] = ("/",)) -> DataFrame:
    """(ord, url) entries: the fixed pages, then the junctions' own with the day they were made."""
    spark = junctions.sparkSession
    fixed = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "ord long, path string").select("ord", F.concat(F.lit("<url><loc>"), F.lit(origin), F.col("path"), F.lit("</loc></url>")).alias("url"))
    own = junctions.select((F.lit(len(pages)).cast("long") + F.col("ord")).alias("ord"), F.concat(F.lit(f"<url><loc>{origin}/signal/"), F.col("id"), F.lit("</loc><lastmod>"), F.date_format("made", "yyyy-MM-dd"), F.lit("</lastmod></url>")).alias("url"))
    return fixed.union(own)


def page_junctions(rows: DataFrame) -> DataFrame:
    """(id, name, lat, lon) for pages; rows with a malformed id are passed over, a blank name is Junction."""
    sound = rows.filter(F.coalesce(F.col("id").rlike("^gw-[0-9a-f]{12}$"), F.lit(False)))
    return sound.select("id", F.coalesce(F.nullif(F.trim("canonical_name"), F.lit("")), F.lit("Junction")).alias("name"), "lat", "lon")


def dataset_records(meta: DataFrame) -> DataFrame:
    """(name, record): a schema.org Dataset of each dataset's meta; the licence only if it names ODbL.

    meta: name, description, license, generated_at, url.
    """
    licence = F.when(F.contains(F.upper("license"), F.lit("ODBL")), "https://opendatacommons.org/licenses/odbl/1-0/")
    record = F.struct(F.lit("Dataset").alias("@type"), "name", "description", licence.alias("license"), F.col("generated_at").alias("dateModified"), "url")
    return meta.select("name", F.to_json(record).alias("record"))


def photo_shard(id_: Column) -> Column:
    """One of 256 folders, by the first two hex digits of an id."""
    return F.lower(F.substring(id_, 1, 2))


def write_photos(photos: DataFrame, path: str) -> None:
    """The last photo of each id, in its shard's folder. photos: id, ord, ..."""
    from wayfare.operators.snapshot import last_wins

    last_wins(photos, "id", "ord").withColumn("shard", photo_shard(F.col("id"))).write.mode("overwrite").partitionBy("shard").parquet(path)
