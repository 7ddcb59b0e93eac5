"""Sources with explicit schemas: map extracts, lists, page texts, pictures, datasets."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTRACT = (
    "osm3s struct<timestamp_osm_base:string>, remark string, elements array<struct<type:string, id:bigint, lat:double, lon:double, version:int, "
    "timestamp:string, tags:map<string,string>, geometry:array<struct<lat:double,lon:double>>, nodes:array<bigint>>>"
)
#: Column names a signal list may use.
ALIASES = {
    "id": ["osm_id", "id", "node_id", "@id", "osmid"], "lat": ["latitude", "lat", "y", "@lat"], "lon": ["longitude", "lon", "lng", "long", "x", "@lon"],
    "name": ["name"], "signals": ["traffic_signals", "signal_type"], "direction": ["direction", "traffic_signals:direction"], "crossing": ["crossing"], "source": ["source"],
}


def extract(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Elements of extract documents, with file, ordinal in it, and the base time."""
    raw = spark.read.schema(EXTRACT).option("multiLine", True).json(paths).withColumn("file", F.col("_metadata.file_name"))
    each = raw.select("file", F.coalesce("osm3s.timestamp_osm_base", F.lit("unknown")).alias("base"), F.posexplode("elements").alias("ord", "e"))
    return each.select("file", "base", "ord", "e.*")


def checked_extract(spark: SparkSession, path: str) -> DataFrame:
    """An extract that is whole, or an error before anything is written: no remark, a base time, some elements."""
    raw = spark.read.schema(EXTRACT).option("multiLine", True).json(path)
    bad = raw.filter((F.coalesce(F.trim("remark"), F.lit("")) != "") | F.col("osm3s.timestamp_osm_base").try_cast("timestamp").isNull() | (F.coalesce(F.size("elements"), F.lit(0)) <= 0))
    if not bad.isEmpty() or raw.isEmpty():
        raise ValueError("the extract is partial, undated or empty")
    return extract(spark, path)


def nodes(elements: DataFrame) -> DataFrame:
    return elements.filter("type = 'node'").select("id", "lat", "lon", "version", "timestamp", F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"), "ord")


def ways(elements: DataFrame) -> DataFrame:
    """Ways of several tiles: of one id the last tile's stands, in the first one's place."""
    order = F.struct("file", "ord")
    got = elements.filter("type = 'way'").groupBy("id").agg(F.max_by(F.struct("geometry", "tags"), order).alias("w"), F.min(order).alias("first"))
    return got.select("id", "w.geometry", "w.tags", "first")


def signal_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a list with any of the known column names; unknown ones go to `extra`.

    The header alone is resolved on the driver.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8").csv(path)
    names = {c.strip().lstrip("﻿").lower(): c for c in raw.columns}
    found = {k: next((names[a] for a in al if a in names), None) for k, al in ALIASES.items()}
    if missing := [k for k in ("id", "lat", "lon") if not found[k]]:
        raise ValueError(f"no column for {', '.join(missing)}")
    cell = lambda k: F.nullif(F.trim(F.col(f"`{found[k]}`")), F.lit("")) if found[k] else F.lit(None).cast("string")
    rest = [c for n, c in names.items() if c not in found.values()]
    extra = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(f"`{c}`"))]), lambda k, v: v.isNotNull() & (v != "")) if rest else F.create_map().cast("map<string,string>")
    rows = raw.filter(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in raw.columns]).isNotNull())
    rows = rows.select(F.regexp_replace(cell("id"), "^node/", "").try_cast("bigint").alias("id"), *[cell(k).try_cast("double").alias(k) for k in ("lat", "lon")], *[cell(k).alias(k) for k in ("name", "signals", "direction", "crossing", "source")], extra.alias("extra"))
    ok = F.coalesce((F.col("id") > 0) & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, page, body) of texts divided by lines === page N===."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), "value")
    part = whole.select("source", F.explode(F.split("value", r"\n=== page ")).alias("p"))
    return part.filter(F.col("p").rlike(r"^\d+===")).select("source", F.regexp_extract("p", r"^(\d+)===", 1).cast("int").alias("page"), F.regexp_replace("p", r"^\d+===\n?", "").alias("body"))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON at path, or no rows where it is absent; any other fault is raised."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


#: Fixed values of the picture format: markers that stand alone, those that open a frame, and those that carry what is no picture.
ALONE, FRAMES, ASIDE = {0x01, *range(0xD0, 0xD8)}, set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}, {*range(0xE0, 0xF0), 0xFE}
SCAN, END, EDGE_MAX = 0xDA, 0xD9, 2000
#: A marker amid coded data: fill bytes and a byte that neither stuffs, restarts nor fills.
_AMID = re.compile(rb"\xff+(?=[^\x00\x01\xd0-\xd7\xff])")


def _segments(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(marker, payload with its length, coded data behind it) of each segment up to the end; ends early at what is malformed."""
    at = 2
    while data[at : at + 1] == b"\xff":
        at += len(data) - at - len(data[at:].lstrip(b"\xff"))  # fill bytes
        if at >= len(data):
            return
        mark, at = data[at], at + 1
        if mark == END:
            yield mark, b"", data[at:]
            return
        size = int.from_bytes(data[at : at + 2], "big") if at + 2 <= len(data) else 0
        if mark in ALONE or mark in (0x00, 0xD8) or size < 2 or at + size > len(data):
            return
        payload, at, coded = data[at : at + size], at + size, b""
        if mark == SCAN:
            found = _AMID.search(data, at)
            if not found:
                return
            coded, at = data[at : found.start()], found.start()
        yield mark, payload, coded


def stripped_jpeg(data: bytes | None) -> tuple[int, int, bytes] | None:
    """(width, height, bytes) of an acceptable picture, without the segments of applications and comments, or None.

    Acceptable: frames of one size, EDGE_MAX at most on either side and of 1 or 3 components, before any scan; at least one scan;
    nothing malformed, and nothing behind the end.
    """
    if not data or data[:2] != b"\xff\xd8":
        return None
    kept, size, scans = [b"\xff\xd8"], None, 0
    for mark, payload, coded in _segments(data):
        if mark == END:
            return (*size, b"".join([*kept, b"\xff\xd9"])) if scans and not coded else None
        if mark in FRAMES:
            if len(payload) < 8 or payload[7] not in (1, 3):
                return None
            seen = (int.from_bytes(payload[5:7], "big"), int.from_bytes(payload[3:5], "big"))
            if not 1 <= min(seen) <= max(seen) <= EDGE_MAX or size not in (None, seen):
                return None
            size = seen
        if mark == SCAN:
            if size is None:
                return None
            scans += 1
        if mark not in ASIDE:
            kept += [bytes((0xFF, mark)), payload, coded]
    return None


def jpeg_facts(content: bytes | None) -> tuple[int, int, int] | None:
    """(width, height, bytes) of an acceptable picture once stripped, or None."""
    found = stripped_jpeg(content)
    return found and (found[0], found[1], len(found[2]))


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, bytes, picture): picture without what applications and comments added; nulls where a file is no acceptable one."""
    import pandas as pd

    def run(batches):
        for b in batches:
            found = [stripped_jpeg(c) for c in b["content"]]
            sizes = {k: pd.array([f and f[i] for f in found], "Int32") for i, k in enumerate(("width", "height"))}
            yield pd.DataFrame({"path": b["path"], **sizes, "bytes": pd.array([f and len(f[2]) for f in found], "Int32"), "picture": [f and f[2] for f in found]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, width int, height int, bytes int, picture binary")


def lists(spark: SparkSession, paths: list[str]) -> list[tuple[str, DataFrame, DataFrame]]:
    """(file, rows, rejects) of several signal lists in the order of their names; each has its own header."""
    named = sorted(paths, key=lambda p: p.rsplit("/", 1)[-1])
    return [(p.rsplit("/", 1)[-1], *signal_list(spark, p)) for p in named if p.lower().endswith(".csv")]


UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def package(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, name, url, created) of a portal package's resources; an id that is no UUID fails the read."""
    raw = spark.read.schema("result struct<resources: array<struct<id: string, name: string, url: string, created: string>>>").option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("result.resources").alias("ord", "r")).select("ord", "r.*")
    sound = F.when(F.coalesce(F.col("id").rlike(UUID), F.lit(False)), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("not a resource id: "), F.coalesce("id", F.lit("null")))))
    return rows.withColumn("id", sound)


def dataset(spark: SparkSession, path: str, records: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(meta, records) of a versioned JSON document; meta as its JSON text. schema: that of one record."""
    raw = spark.read.schema(f"meta string, {records} array<struct<{schema}>>").option("multiLine", True).json(path)
    return raw.select("meta"), raw.select(F.posexplode(records).alias("ord", "r")).select("ord", "r.*")


DECISIONS = "plans map<string, struct<decision: string, intersection_id: string, by: string, at: string>>, controlType map<string, struct<control_type: string>>, clusters map<string, struct<decision: string>>"


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """(key, decision, to, by, at) of reviewers; an absent or unreadable file is no decision at all."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.schema(DECISIONS).option("multiLine", True).json(path)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], DECISIONS)
    return raw.filter("plans IS NOT NULL").select(F.explode("plans").alias("key", "d")).select("key", "d.decision", F.col("d.intersection_id").alias("to"), "d.by", "d.at")


def place_cache(spark: SparkSession, path: str) -> DataFrame:
    """(query, lat, lon, label, osm) that a geocoder answered before; negative answers have null coordinates."""
    raw = spark.read.text(path, wholetext=True)
    cells = F.from_json("value", "map<string, struct<provider: string, lat: double, lon: double, label: string, osm: string>>")
    return raw.select(F.explode(cells).alias("query", "a")).select("query", "a.lat", "a.lon", "a.label", "a.osm")


def save_places(places: DataFrame, path: str) -> None:
    """The cache as one row of JSON for each query."""
    places.select(F.to_json(F.struct("query", "lat", "lon", "label", "osm"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
