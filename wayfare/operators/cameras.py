"""Mapped cameras: tags to columns, summary, features and dataset meta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import text
from wayfare.operators.snapshot import canonical

#: The facets, each with the values readers may choose.
FACETS = {
    "kind": ["camera", "alpr", "guard", "viewpoint", "other", "none"],
    "category": ["public", "outdoor", "indoor", "private", "traffic", "other", "none"],
    "zone": ["traffic", "area", "town", "street", "building", "other", "none"],
    "camera_type": ["fixed", "dome", "panning", "other", "none"],
}
ALPR = {"anpr": "alpr"}
SCHEMA = "surveillance.v1"


def _facet(raw: Column, name: str) -> Column:
    known = [v for v in FACETS[name] if v not in ("other", "none")]
    return text.facet(raw, known, ALPR if name == "kind" else None)


def normal(records: DataFrame) -> DataFrame:
    """records (id, lat, lon, v, t, tags) as cameras: facets, texts, headings and the cleaned tags themselves."""
    tag = lambda k: text.clean_tag(F.try_element_at("tags", F.lit(k)))
    kind, category, zone, camera = tag("surveillance:type"), tag("surveillance"), tag("surveillance:zone"), tag("camera:type")
    heading = F.coalesce(tag("camera:direction"), tag("direction"))
    return records.select(
        "id", "lat", "lon", F.col("v").alias("version"), F.col("t").alias("updated_at"), _facet(kind, "kind").alias("kind"), _facet(category, "category").alias("category"), _facet(zone, "zone").alias("zone"),
        _facet(camera, "camera_type").alias("camera_type"), category.alias("surveillance"), kind.alias("surveillance_type"), zone.alias("zone_raw"), camera.alias("camera_type_raw"), tag("camera:mount").alias("mount"),
        tag("operator").alias("operator"), tag("name").alias("name"), tag("ref").alias("ref"), tag("description").alias("description"), F.coalesce(tag("survey:date"), tag("check_date")).alias("survey_date"),
        text.headings(heading).alias("directions"), heading.alias("direction_raw"), "tags",
    )


def summary(cameras: DataFrame) -> DataFrame:
    """One row: counts by facet, zero where none, what is mapped, and the oldest and newest change (as texts)."""
    counts = [F.count_if(F.col(f) == v).alias(f"{f}_{v}") for f, values in FACETS.items() for v in values]
    return cameras.agg(
        F.count("*").alias("total"), *counts, F.count_if(F.coalesce(F.col("operator"), F.lit("")) != "").alias("operator_mapped"), F.count_if(F.size("directions") > 0).alias("direction_mapped"),
        F.count_if(F.coalesce(F.col("name"), F.lit("")) != "").alias("named"), F.min("updated_at").alias("oldest"), F.max("updated_at").alias("newest"),
    )


def shown(cameras: DataFrame, chosen: dict[str, str]) -> DataFrame:
    """One row over the cameras that meet a choice of facets: how many, and what is mapped of them."""
    rows = cameras
    for facet, value in chosen.items():
        rows = rows.filter(F.col(facet) == value)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("operator").isNotNull()).alias("operator_mapped"), F.count_if(F.size("directions") > 0).alias("direction_mapped"))


def features(cameras: DataFrame) -> DataFrame:
    """One GeoJSON point per camera; the id is text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return cameras.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.col("id").cast("string").alias("id")).alias("properties"))).alias("feature"))


def dataset(summary_row: DataFrame, synced_at: Column, base: Column) -> DataFrame:
    """One row: the snapshot's meta with its schema, licence and the summary as JSON."""
    counts = F.to_json(F.struct(*summary_row.columns), {"ignoreNullFields": "false"})
    return summary_row.select(F.lit(SCHEMA).alias("schema"), synced_at.alias("synced_at"), base.alias("osm_base"), F.lit("ODbL 1.0").alias("license"), counts.alias("summary"))


def registry_rows(summary_row: DataFrame, synced_at: Column, base: Column) -> DataFrame:
    """Two rows of the source registry: the map's records, and the snapshot made of them."""
    row = lambda i, id_, kind, note: F.struct(F.lit(i).alias("ord"), F.lit(id_).alias("id"), F.lit(kind).alias("kind"), F.col("total").alias("records"), note.alias("note"))
    mapped = F.format_string("%d of %d with an operator, %d with a heading", "operator_mapped", "total", "direction_mapped")
    return summary_row.select(F.inline(F.array(row(0, "osm-surveillance", "map", F.concat(F.lit("base "), base)), row(1, "surveillance-snapshot", "snapshot", mapped))), synced_at.alias("retrieved_at"))


def checked_snapshot(meta: DataFrame, records: DataFrame) -> DataFrame:
    """records, once their meta names the schema this library knows; otherwise the read fails."""
    found = [r["schema"] for r in meta.select("schema").limit(2).collect()]
    if found != [SCHEMA]:
        raise ValueError(f"schema {found} is not {SCHEMA}")
    return records


def same(a: Column, b: Column) -> Column:
    """Whether two structs (v, t, lat, lon, tags) are one record; tags in any order."""
    of = lambda r: F.struct(r["v"], r["t"], r["lat"], r["lon"], canonical(r["tags"]))
    return of(a).eqNullSafe(of(b))
