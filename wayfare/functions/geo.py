"""Geodesy as column expressions: degrees in, metres or degrees out."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius and metres in a degree of latitude.
EARTH_M, DEGREE_M = 6371008.8, 111320.0
COMPASS_8 = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
COMPASS_16 = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(d) * F.cos(b)
    north = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0))


def angular_difference(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % F.lit(360.0)  # of one size both ways, so that a limit holds for both alike
    return F.least(d, F.lit(360.0) - d)


def destination(lat: Column, lon: Column, heading: Column, metres: Column) -> Column:
    """struct(lat, lon) after going so far on a great circle."""
    r, t, a = metres / EARTH_M, F.radians(heading), F.radians(lat)
    to = F.asin(F.sin(a) * F.cos(r) + F.cos(a) * F.sin(r) * F.cos(t))
    turn = F.atan2(F.sin(t) * F.sin(r) * F.cos(a), F.cos(r) - F.sin(a) * F.sin(to))
    return F.struct(F.degrees(to).alias("lat"), (lon + F.degrees(turn)).alias("lon"))


def project(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """struct(x, y): metres east and north of an origin, on a local plane."""
    k = math.pi / 180 * EARTH_M
    return F.struct(((lon - lon0) * k * math.cos(math.radians(lat0))).alias("x"), ((lat - lat0) * k).alias("y"))


def compass(deg: Column, points: list[str] = COMPASS_8) -> Column:
    step = 360.0 / len(points)
    at = F.pmod(F.floor(F.pmod(deg, F.lit(360.0)) / step + 0.5), F.lit(len(points))).cast("int")
    return F.get(F.array(*map(F.lit, points)), at)


def path_lengths(points: Column) -> Column:
    """Distances along an array of struct(lat, lon), from 0 at its first point."""

    def step(acc: Column, i: Column) -> Column:
        p, q = F.get(points, i - 1), F.get(points, i)
        return F.concat(acc, F.array(F.element_at(acc, -1) + haversine(p["lat"], p["lon"], q["lat"], q["lon"])))

    rest = F.when(F.size(points) > 1, F.sequence(F.lit(1), F.size(points) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rest, F.array(F.lit(0.0)), step)


def point_at(points: Column, metres: Column) -> Column:
    """struct(lat, lon) so far along a path, straight between its points; ends are clamped."""
    along = path_lengths(points)
    s = F.least(F.greatest(metres, F.lit(0.0)), F.element_at(along, -1))
    i = F.greatest(F.lit(0), F.least(F.size(F.filter(along, lambda d: d <= s)) - 1, F.size(points) - 2))
    p, q, a, b = F.get(points, i), F.coalesce(F.get(points, i + 1), F.get(points, i)), F.get(along, i), F.coalesce(F.get(along, i + 1), F.get(along, i))
    f = F.when(b > a, (s - a) / (b - a)).otherwise(F.lit(0.0))
    return F.struct((p["lat"] + f * (q["lat"] - p["lat"])).alias("lat"), (p["lon"] + f * (q["lon"] - p["lon"])).alias("lon"))


def bearing_along(points: Column, metres: Column, window: float = 40.0) -> Column:
    """The bearing of a path at a place along it, from `window` metres before to five beyond."""
    a = point_at(points, F.greatest(F.lit(0.0), metres - window))
    b = point_at(points, F.least(F.element_at(path_lengths(points), -1), metres + 5))
    return bearing(a["lat"], a["lon"], b["lat"], b["lon"])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often it stands in it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def path_length(points: Column) -> Column:
    """Length of an array of struct(lat, lon)."""
    legs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, q: haversine(p["lat"], p["lon"], q["lat"], q["lon"]))
    return F.aggregate(legs, F.lit(0.0), lambda a, m: a + m)


def decoded(line: Column, precision: int = 5) -> Column:
    """array(struct(lat, lon)) of an encoded polyline: five bits a character, least first, differences zigzag-coded."""
    scale, zero, longs = float(10**precision), F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def step(acc: Column, c: Column) -> Column:
        value = acc["value"] + c.bitwiseAND(F.lit(31)).cast("long") * F.pow(F.lit(2.0), acc["shift"]).cast("long")
        more = c >= 32
        half = F.shiftright(value, 1)
        signed = F.when(value % 2 == 1, -half - 1).otherwise(half)
        return F.struct(F.when(more, value).otherwise(0).cast("long").alias("value"), F.when(more, acc["shift"] + 5).otherwise(0).alias("shift"), F.when(more, acc["out"]).otherwise(F.concat(acc["out"], F.array(signed))).alias("out"))

    def add(acc: Column, p: Column) -> Column:
        y, x = acc["y"] + p["y"], acc["x"] + p["x"]
        return F.struct(y.alias("y"), x.alias("x"), F.concat(acc["out"], F.array(F.struct((y / scale).alias("lat"), (x / scale).alias("lon")))).alias("out"))

    codes = F.transform(F.filter(F.split(line, ""), lambda c: c != ""), lambda c: F.ascii(c) - 63)
    deltas = F.aggregate(codes, F.struct(zero.alias("value"), F.lit(0).alias("shift"), longs.alias("out")), step, lambda acc: acc["out"])
    pairs = lambda d: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size(d) / 2).cast("int") - 1)), lambda i: F.struct(F.get(d, i * 2).alias("y"), F.get(d, i * 2 + 1).alias("x")))
    whole = F.filter(bound(deltas, pairs), lambda p: p["x"].isNotNull())
    start = F.struct(zero.alias("y"), zero.alias("x"), F.array().cast("array<struct<lat:double,lon:double>>").alias("out"))
    return F.aggregate(whole, start, add, lambda acc: acc["out"])


def onto_path(lat: Column, lon: Column, points: Column) -> Column:
    """struct(offset_m, along_m, segment): the nearest place on a path, first on ties."""
    k = math.pi / 180 * EARTH_M
    along = path_lengths(points)

    def on(i: Column) -> Column:
        p, q = F.get(points, i), F.get(points, i + 1)
        c = F.cos(F.radians(p["lat"]))
        dx, dy = (q["lon"] - p["lon"]) * k * c, (q["lat"] - p["lat"]) * k
        x, y = (lon - p["lon"]) * k * c, (lat - p["lat"]) * k
        sq = dx * dx + dy * dy
        f = F.when(sq > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x * dx + y * dy) / sq))).otherwise(F.lit(0.0))
        off = F.sqrt(F.pow(x - f * dx, 2) + F.pow(y - f * dy, 2))
        return F.struct(off.alias("offset_m"), i.alias("segment"), (F.get(along, i) + f * F.sqrt(sq)).alias("along_m"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(points) - 2), on))


def ring(lat: Column, lon: Column, metres: Column, sides: int = 48) -> Column:
    """A closed polygon around a point, as [lon, lat] pairs."""

    def at(i: Column) -> Column:
        to = destination(lat, lon, i * (360.0 / sides), metres)
        return F.array(to["lon"], to["lat"])

    return F.transform(F.sequence(F.lit(0), F.lit(sides)), at)


def wedge(lat: Column, lon: Column, heading: Column, metres: float = 40.0, spread: float = 60.0, steps: int = 6) -> Column:
    """A closed cone that opens along a heading, as [lon, lat] pairs: tip, arc, tip."""
    tip = F.array(lon, lat)

    def at(i: Column) -> Column:
        to = destination(lat, lon, heading - spread / 2 + i * (spread / steps), F.lit(metres))
        return F.array(to["lon"], to["lat"])

    return F.concat(F.array(tip), F.transform(F.sequence(F.lit(0), F.lit(steps)), at), F.array(tip))


def cell_degrees(metres: float, lat: float) -> tuple[float, float]:
    """(latitude, longitude) degrees of a square cell; never narrower than metres within 5 degrees of lat."""
    return metres / DEGREE_M * 1.001, metres / (DEGREE_M * math.cos(math.radians(min(89.0, abs(lat) + 5)))) * 1.001
