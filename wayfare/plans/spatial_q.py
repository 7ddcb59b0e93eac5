"""Spatial queries: suppliers and customers stand at places made from their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.functions import geo
from wayfare.operators import spatial
from wayfare.session import table
from wayfare.sources import sinks


def places(spark, sf_dir, name, key):
    k = F.col(key)
    return table(spark, sf_dir, name).select(
        key, (12.78 + (k * 7919 % 4001) / F.lit(10000.0)).alias("lat"), (77.38 + (k * 104729 % 4401) / F.lit(10000.0)).alias("lon")
    )


def _place_sql(name: str, key: str) -> str:
    return f"(SELECT {key}, 12.78::DOUBLE + ({key} * 7919 % 4001) / 10000.0::DOUBLE AS lat, 77.38::DOUBLE + ({key} * 104729 % 4401) / 10000.0::DOUBLE AS lon FROM {name})"


_HAV = "2::DOUBLE * 6371008.8::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))))"
_AB = _HAV.format(a="a", b="b")


def radius_join(spark, sf_dir):
    """Suppliers and customers within 500 m."""
    got = spatial.radius_join(places(spark, sf_dir, "supplier", "s_suppkey"), places(spark, sf_dir, "customer", "c_custkey"), 500.0, 13.0, "s_suppkey", "c_custkey")
    return got.select(F.col("l").alias("s_suppkey"), F.col("r").alias("c_custkey"), F.round("metres", 3).alias("metres"))


def nearest_join(spark, sf_dir):
    """Each customer's nearest supplier within 1,500 m."""
    got = spatial.nearest_within(places(spark, sf_dir, "customer", "c_custkey"), places(spark, sf_dir, "supplier", "s_suppkey"), 1500.0, 13.0, "c_custkey", "s_suppkey")
    return got.select(F.col("l").alias("c_custkey"), F.col("r").alias("s_suppkey"))


def knn(spark, sf_dir):
    return spatial.k_nearest(places(spark, sf_dir, "customer", "c_custkey"), 12.97, 77.59, 10, "c_custkey").select("c_custkey", F.round("metres", 3).alias("metres"))


def density_grid(spark, sf_dir):
    got = spatial.density(places(spark, sf_dir, "customer", "c_custkey"), 500.0, 12.7, 77.3, 12.97)
    return got.select("row", "col", "n")


def zoom_clusters(spark, sf_dir):
    got = spatial.zoom_clusters(places(spark, sf_dir, "customer", "c_custkey"), 10)
    return got.select("cx", "cy", "n", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def nested_clusters(spark, sf_dir):
    """Customers pooled in order at every zoom from 14 to 8."""
    got = spatial.nested_clusters(places(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("c_custkey", "ord"), 8)
    return got.select("zoom", "id", "n", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "up")


def eps_components(spark, sf_dir):
    """Suppliers linked within 3,000 m, closed over links."""
    pts = places(spark, sf_dir, "supplier", "s_suppkey")
    comp = spatial.epsilon_components(pts, 3000.0, 13.0, "s_suppkey")
    return pts.join(comp, F.col("s_suppkey") == F.col("node"), "left").select("s_suppkey", F.coalesce("component", "s_suppkey").alias("component"))


def clusters(spark, sf_dir):
    """Clusters of suppliers: content id, centroid, size."""
    pts = places(spark, sf_dir, "supplier", "s_suppkey")
    comp = spatial.epsilon_components(pts, 3000.0, 13.0, "s_suppkey")
    got = spatial.cluster_members(pts, comp, "s_suppkey")
    return got.select("id", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("spread_m", 2).alias("spread_m"))


def bearings(spark, sf_dir):
    """Heading and compass word from each customer to the centre."""
    p = places(spark, sf_dir, "customer", "c_custkey")
    b = geo.bearing(F.col("lat"), F.col("lon"), F.lit(12.97), F.lit(77.59))
    return p.select("c_custkey", F.round(b, 6).alias("heading"), geo.compass(b).alias("compass8"), geo.compass(b, geo.COMPASS_16).alias("compass16"), F.round(geo.angular_difference(b, F.lit(350.0)), 6).alias("off_north"))


def place_at(spark, sf_dir):
    """The supplier's site nearest each customer within 300 m."""
    got = spatial.nearest_within(places(spark, sf_dir, "customer", "c_custkey"), places(spark, sf_dir, "supplier", "s_suppkey"), 300.0, 13.0, "c_custkey", "s_suppkey")
    return got.select(F.col("l").alias("c_custkey"), F.col("r").alias("s_suppkey"), F.round("metres", 3).alias("metres"))


def picked(spark, sf_dir):
    """The mark hit by each order's point on a screen, within 12 pixels."""
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    points = table(spark, sf_dir, "orders").select(k.alias("p"), (k * 37 % 1000).cast("double").alias("x"), (k * 91 % 800).cast("double").alias("y"))
    marks = table(spark, sf_dir, "supplier").select(s.alias("m"), s.alias("ord"), (s * 53 % 1000).cast("double").alias("x"), (s * 29 % 800).cast("double").alias("y"))
    return spatial.picked(points, marks, 12.0).select("p", "m", F.round("distance", 6).alias("distance"))


def geometry(spark, sf_dir):
    """Each customer on a local plane, and the far corner of a camera's cone there."""
    p = places(spark, sf_dir, "customer", "c_custkey")
    on = geo.project(F.col("lat"), F.col("lon"), 12.97, 77.59)
    cone = geo.wedge(F.col("lat"), F.col("lon"), (F.col("c_custkey") % 360).cast("double"))
    tip, far = F.get(cone, F.lit(0)), F.get(cone, F.lit(1))
    return p.select("c_custkey", F.round(on["x"], 4).alias("x"), F.round(on["y"], 4).alias("y"), F.size(cone).alias("corners"), F.round(F.get(tip, F.lit(0)), 7).alias("tip"), F.round(F.get(far, F.lit(0)), 7).alias("far_lon"), F.round(F.get(far, F.lit(1)), 7).alias("far_lat"))


def site_features(spark, sf_dir):
    """Suppliers' sites as GeoJSON points with a style by their number."""
    p = places(spark, sf_dir, "supplier", "s_suppkey")
    s = F.col("s_suppkey")
    styled = p.select("lat", "lon", s.alias("id"), F.when(s % 2 == 0, "red").otherwise("dim").alias("color"), F.when(s % 3 == 0, s % 7).alias("value"), F.lit(3.5).alias("radius"), F.lit("").alias("label"))
    return sinks.point_features(styled, ["id", "color", "value", "radius", "label"])


_COMP = f"""pts AS {_place_sql('supplier', 's_suppkey')},
e AS (SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM pts a, pts b WHERE a.s_suppkey <> b.s_suppkey AND {_AB} <= 3000),
reach AS (SELECT s_suppkey AS x, s_suppkey AS y FROM pts UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
comp AS (SELECT x AS s_suppkey, min(y) AS component FROM reach GROUP BY x)"""
_C8 = "list_extract(['N','NE','E','SE','S','SW','W','NW'], (floor(heading / 45 + 0.5)::INT % 8) + 1)"
_C16 = "list_extract(['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'], (floor(heading / 22.5 + 0.5)::INT % 16) + 1)"

QUERIES = {"radius_join": radius_join, "nearest_join": nearest_join, "knn": knn, "density_grid": density_grid, "zoom_clusters": zoom_clusters, "nested_clusters": nested_clusters, "eps_components": eps_components, "clusters": clusters, "bearings": bearings, "place_at": place_at, "picked": picked, "geometry": geometry, "site_features": site_features}
ORACLES = {
    "radius_join": f"SELECT a.s_suppkey, b.c_custkey, round({_AB}, 3) AS metres FROM {_place_sql('supplier', 's_suppkey')} a, {_place_sql('customer', 'c_custkey')} b WHERE {_AB} <= 500",
    "nearest_join": f"SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey FROM (SELECT b.c_custkey, a.s_suppkey, {_AB} AS d FROM {_place_sql('supplier', 's_suppkey')} a, {_place_sql('customer', 'c_custkey')} b) WHERE d <= 1500 GROUP BY c_custkey",
    "knn": f"SELECT a.c_custkey, round({_AB}, 3) AS metres FROM {_place_sql('customer', 'c_custkey')} a, (SELECT 12.97::DOUBLE AS lat, 77.59::DOUBLE AS lon) b ORDER BY {_AB}, c_custkey LIMIT 10",
    "density_grid": f"SELECT floor((lat - 12.7::DOUBLE) / (500 / 111320.0::DOUBLE))::BIGINT AS row, floor((lon - 77.3::DOUBLE) / (500 / (111320.0::DOUBLE * cos(radians(12.97::DOUBLE)))))::BIGINT AS col, count(*) AS n FROM {_place_sql('customer', 'c_custkey')} GROUP BY ALL",
    "zoom_clusters": f"SELECT floor(lon / (360.0::DOUBLE / 1024 * 44 / 512))::BIGINT AS cx, floor(lat / (360.0::DOUBLE / 1024 * 44 / 512))::BIGINT AS cy, count(*) AS n, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM {_place_sql('customer', 'c_custkey')} GROUP BY ALL",
    "eps_components": f"WITH RECURSIVE {_COMP} SELECT * FROM comp",
    "clusters": f"""WITH RECURSIVE {_COMP}, m AS (SELECT component, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS ids FROM comp JOIN pts USING (s_suppkey) GROUP BY component)
SELECT 'gw-' || substr(sha1(b.ids), 1, 12) AS id, b.n, round(b.lat, 6) AS lat, round(b.lon, 6) AS lon, round(max({_AB}), 2) AS spread_m FROM m b JOIN comp USING (component) JOIN pts a USING (s_suppkey) GROUP BY b.ids, b.n, b.lat, b.lon""",
    "bearings": f"""SELECT c_custkey, round(heading, 6) AS heading, {_C8} AS compass8, {_C16} AS compass16, round(least((heading - 350 + 360) % 360, 360 - (heading - 350 + 360) % 360), 6) AS off_north
FROM (SELECT c_custkey, (degrees(atan2(sin(radians(77.59::DOUBLE - lon)) * cos(radians(12.97::DOUBLE)), cos(radians(lat)) * sin(radians(12.97::DOUBLE)) - sin(radians(lat)) * cos(radians(12.97::DOUBLE)) * cos(radians(77.59::DOUBLE - lon)))) + 360) % 360 AS heading FROM {_place_sql('customer', 'c_custkey')})""",
    "place_at": f"SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey, round(min(d), 3) AS metres FROM (SELECT b.c_custkey, a.s_suppkey, {_AB} AS d FROM {_place_sql('supplier', 's_suppkey')} a, {_place_sql('customer', 'c_custkey')} b) WHERE d <= 300 GROUP BY c_custkey",
    "picked": """SELECT p, arg_min(m, (d, m)) AS m, round(min(d), 6) AS distance FROM (SELECT o_orderkey AS p, s_suppkey AS m, sqrt(pow(o_orderkey * 37 % 1000 - s_suppkey * 53 % 1000, 2) + pow(o_orderkey * 91 % 800 - s_suppkey * 29 % 800, 2)) AS d FROM orders, supplier) WHERE d <= 12 GROUP BY p""",
    "geometry": f"""WITH p AS (SELECT *, radians((c_custkey % 360) - 30.0::DOUBLE) AS t, 40 / 6371008.8::DOUBLE AS r, radians(lat) AS a FROM {_place_sql('customer', 'c_custkey')}), q AS (SELECT *, asin(sin(a) * cos(r) + cos(a) * sin(r) * cos(t)) AS b FROM p)
SELECT c_custkey, round((lon - 77.59::DOUBLE) * pi() / 180 * 6371008.8::DOUBLE * cos(radians(12.97::DOUBLE)), 4) + 0.0::DOUBLE AS x, round((lat - 12.97::DOUBLE) * pi() / 180 * 6371008.8::DOUBLE, 4) + 0.0::DOUBLE AS y, 9 AS corners, round(lon, 7) AS tip, round(lon + degrees(atan2(sin(t) * sin(r) * cos(a), cos(r) - sin(a) * sin(b))), 7) AS far_lon, round(degrees(b), 7) AS far_lat FROM q""",
    "site_features": f"""SELECT '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || lon || ',' || lat || ']}},"properties":{{"id":' || s_suppkey || ',"color":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'red' ELSE 'dim' END || '","value":' || CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 7)::VARCHAR ELSE 'null' END || ',"radius":3.5,"label":""}}}}' AS feature FROM {_place_sql('supplier', 's_suppkey')}""",
}
