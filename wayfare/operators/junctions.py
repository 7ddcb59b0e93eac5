"""From nodes and ways to junctions: approaches, clusters, confidence, and an outside list checked against them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions import geo
from wayfare.operators.spatial import lights_apart, nearest_within, radius_join
from wayfare.scratch import write_table

#: Ways without vehicles, rank of road kinds, and distances in metres and degrees.
ON_FOOT = ["footway", "path", "cycleway", "steps", "pedestrian"]
RANKS = {"motorway": 5, "trunk": 5, "primary": 4, "secondary": 3, "tertiary": 2}
NEAR_M, SHARED_WAY_M, SHARED_ROAD_M, SAME_BEARING, STUB_M, UPSTREAM_M = 35.0, 90.0, 60.0, 20.0, 8.0, 150.0
#: Tags of a member node that a junction keeps, and the score of a light known from a list alone.
KEPT_TAG = r"^(?:traffic_signals.*|crossing|button_operated|name|junction)$"
LISTED_SCORE = {"base": 0.7, "node_count": 0.1, "spread": 0.1, "road_context": -0.15, "approaches": -0.3}


def vertices(ways: DataFrame) -> DataFrame:
    """(way, idx, lat, lon, name, highway, oneway, maxspeed, lanes, turn_lanes, n) of ways for vehicles; a way without name goes by its ref."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    rows = ways.filter(~F.coalesce(tag("highway"), F.lit("")).isin(*ON_FOOT))
    turn = F.coalesce(tag("junction") == "roundabout", F.lit(False))
    oneway = F.when(F.coalesce(tag("oneway").isin("yes", "true", "1"), F.lit(False)) | turn, 1).when(tag("oneway").isin("-1", "reverse"), -1).otherwise(0)
    cols = [F.coalesce(tag("name"), tag("ref")).alias("name"), tag("highway").alias("highway"), oneway.alias("oneway"), tag("maxspeed").alias("maxspeed"), tag("lanes").alias("lanes"), tag("turn:lanes").alias("turn_lanes")]
    rows = rows.select(F.col("id").alias("way"), *cols, F.size("geometry").alias("n"), "geometry")
    return rows.select("*", F.posexplode("geometry").alias("idx", "p")).select(*rows.columns, "idx", "p.lat", "p.lon")


def at_nodes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Vertices at the place of a node, by an equi-join on coordinates to seven places."""
    key = lambda c: F.round(F.col(c) * 1e7).cast("long")
    n = nodes.select(F.col("id").alias("node"), key("lat").alias("ky"), key("lon").alias("kx"))
    return vertices(ways).withColumn("ky", key("lat")).withColumn("kx", key("lon")).join(n, ["ky", "kx"]).drop("ky", "kx")


def approaches(nodes: DataFrame, ways: DataFrame, metres: float = 60.0) -> DataFrame:
    """Traffic that comes to a node along a way from each allowed side, with its bearing to a tenth of a degree.

    The bearing is that of the place `metres` up the way, or its end; where that place is
    nearer than STUB_M the stub is left out. upstream: the way's points up to UPSTREAM_M
    before the node, farthest first. ord: the place among a node's approaches.
    """
    rows = at_nodes(nodes, ways).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    # from lower indices one travels forward, from higher ones backward
    rows = rows.filter(((F.col("side") == -1) & (F.col("oneway") >= 0)) | ((F.col("side") == 1) & (F.col("oneway") <= 0)))
    back = F.when(F.col("side") == -1, F.reverse(F.slice("geometry", F.lit(1), F.col("idx") + 1))).otherwise(F.slice("geometry", F.col("idx") + 1, F.col("n")))
    rows = rows.withColumn("back", back).filter(F.size("back") > 1).withColumn("along", geo.path_lengths(F.col("back")))
    rows = rows.withColumn("start", geo.point_at(F.col("back"), F.lit(metres)))
    rows = rows.filter(geo.haversine(F.col("start.lat"), F.col("start.lon"), F.col("lat"), F.col("lon")) >= STUB_M)
    walked = F.filter(F.arrays_zip(F.col("back").alias("p"), F.col("along").alias("d")), lambda x: x["d"] <= UPSTREAM_M)
    cut = F.when(F.element_at("along", -1) > UPSTREAM_M, F.array(geo.point_at(F.col("back"), F.lit(UPSTREAM_M)))).otherwise(F.slice("back", 1, 0))
    upstream = F.reverse(F.concat(F.transform(walked, lambda x: F.struct(x["p"]["lat"].alias("lat"), x["p"]["lon"].alias("lon"))), cut))
    bearing = F.floor(geo.bearing(F.col("start.lat"), F.col("start.lon"), F.col("lat"), F.col("lon")) * 10 + 0.5) / 10
    return rows.select(
        "node", "way", "name", "highway", bearing.alias("bearing"), F.element_at("along", -1).alias("length"), (F.col("oneway") != 0).alias("oneway"), "maxspeed", "lanes", "turn_lanes",
        upstream.alias("upstream"), F.struct("way", "idx", "side").alias("ord"),
    )


def links(nodes: DataFrame, touching: DataFrame, lat: float) -> DataFrame:
    """(a, b) of nodes of one junction: near, or further and on one way or one named road."""
    of = touching.groupBy("node").agg(F.collect_set("way").alias("ways"), F.array_compact(F.collect_set("name")).alias("roads"))
    pairs = radius_join(nodes, nodes, SHARED_WAY_M, lat, "id", "id").filter("l < r")
    both = pairs.join(of.toDF("l", "w1", "r1"), "l", "left").join(of.toDF("r", "w2", "r2"), "r", "left")
    shared = lambda x, y: F.coalesce(F.arrays_overlap(x, y), F.lit(False))
    ok = (F.col("metres") <= NEAR_M) | shared("w1", "w2") | ((F.col("metres") <= SHARED_ROAD_M) & shared("r1", "r2"))
    return both.filter(ok).select(F.col("l").alias("a"), F.col("r").alias("b"))


def merge_approaches(rows: DataFrame) -> DataFrame:
    """(junction, k, name, bearing, nodes, ways, ...): approaches of one road and heading taken together.

    Each joins the first earlier one of its name within SAME_BEARING of that one's own bearing, which
    never moves; so the order of node and way counts, and each junction is one ordered fold over
    its few approaches. Of the ways upstream the one of most points stays. k: by bearing, from 1.
    """
    fields = [c for c in ("highway", "turn_lanes") if c in rows.columns]
    one = F.struct(F.col("node"), F.col("way"), F.coalesce("name", F.lit("")).alias("name"), "bearing", F.size("upstream").alias("points"), *fields)
    order = F.struct("node", "ord", one.alias("a"))
    listed = rows.groupBy("junction").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["a"]).alias("as"))
    start = F.transform(F.filter("as", lambda a: F.lit(False)), _alone)

    def step(done, a):
        near = lambda o: (o["name"] == a["name"]) & (geo.angular_difference(o["bearing"], a["bearing"]) <= SAME_BEARING)
        hit = F.array_position(F.transform(done, near), True)
        joined = F.transform(done, lambda o, i: F.when(i == hit - 1, _joined(o, a)).otherwise(o))
        return F.when(hit > 0, joined).otherwise(F.concat(done, F.array(_alone(a))))

    merged = listed.select("junction", F.posexplode(F.array_sort(F.aggregate("as", start, step))).alias("k", "m"))
    return merged.select("junction", (F.col("k") + 1).alias("k"), F.nullif("m.name", F.lit("")).alias("name"), "m.bearing", geo.compass(F.col("m.bearing")).alias("compass"), F.array_sort("m.nodes").alias("nodes"), F.array_sort("m.ways").alias("ways"), "m.points")


def _alone(a: Column) -> Column:
    return F.struct(a["bearing"].alias("bearing"), a["name"].alias("name"), F.array(a["node"]).alias("nodes"), F.array(a["way"]).alias("ways"), a["points"].alias("points"))


def _joined(o: Column, a: Column) -> Column:
    return F.struct(o["bearing"].alias("bearing"), o["name"].alias("name"), F.array_union(o["nodes"], F.array(a["node"])).alias("nodes"), F.array_union(o["ways"], F.array(a["way"])).alias("ways"), F.greatest(o["points"], a["points"]).alias("points"))


def confidence(nodes: Column, spread: Column, roads: Column, approaches_: Column) -> Column:
    """struct(score, review, components): a sum in fixed order, held to 0..1.

    Reviewed where the sum is under 0.6, before rounding, or there are over six nodes.
    """
    parts = [
        F.lit(0.7), F.when(nodes == 1, 0.1).when(nodes <= 4, 0.05).otherwise(-0.1 * (nodes - 4)), F.when(spread <= 25, 0.1).when(spread <= 60, 0.0).otherwise(-0.2),
        F.when(roads >= 2, 0.1).when(roads == 1, 0.0).otherwise(-0.15), F.when(approaches_ == 0, -0.3).otherwise(0.0),
    ]
    total = parts[0] + parts[1] + parts[2] + parts[3] + parts[4]
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
    return F.struct(held.alias("score"), ((held < 0.6) | (nodes > 6)).alias("review"), F.struct(*[p.alias(k) for p, k in zip(parts, LISTED_SCORE, strict=True)]).alias("components"))


def records(members: DataFrame, merged: DataFrame) -> DataFrame:
    """One row per junction: place, spread, names, type, control tags and confidence.

    members: junction, node, ord, lat, lon, tags, n_approaches. merged: junction, k, name.
    """
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    has = lambda c: F.coalesce(c != "", F.lit(False))
    rows = merged.groupBy("junction").agg(F.count("*").alias("approaches"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("k", "name")))), lambda x: x["name"])).alias("road_names"))
    m = members.join(rows, "junction", "left")
    few = F.coalesce(F.size("road_names"), F.lit(0)) <= 1
    # one road at most, a few approaches, and a sign of a crossing
    at_crossing = has(tag("crossing")) | ((tag("highway") == "traffic_signals") & (F.col("n_approaches") <= 2) & few & (has(tag("button_operated")) | has(tag("crossing"))))
    pressed = (tag("crossing") == "traffic_signals") | (tag("button_operated") == "yes")
    no = F.lit(False)
    got = m.groupBy("junction").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("nodes"), F.array_sort(F.collect_list("node")).alias("node_ids"), F.min_by(tag("name"), F.when(has(tag("name")), F.col("ord"))).alias("named"),
        F.min(F.coalesce(at_crossing, no)).alias("crossing_only"), F.max(F.coalesce(pressed, no)).alias("pressed"), F.coalesce(F.max("approaches"), F.lit(0)).alias("approaches"),
        F.coalesce(F.first("road_names"), F.array().cast("array<string>")).alias("road_names"),
    )
    centre = got.select("junction", F.col("lat").alias("_y"), F.col("lon").alias("_x"))
    spread = members.join(centre, "junction").groupBy("junction").agg(F.max(geo.haversine(F.col("_y"), F.col("_x"), F.col("lat"), F.col("lon"))).alias("spread"))
    got = got.join(spread, "junction")
    roads = F.size("road_names")
    kind = (
        F.when((F.col("pressed") & (roads <= 1)) | F.col("crossing_only"), "pedestrian_crossing").when((roads >= 2) | (F.col("approaches") >= 3), "junction")
        .when(F.col("approaches") >= 1, "midblock_or_single_road").otherwise("unresolved")
    )
    first, second = F.get("road_names", F.lit(0)), F.get("road_names", F.lit(1))
    name = F.coalesce("named", F.when(roads >= 2, F.concat(first, F.lit(" × "), second)).when(roads == 1, F.concat(first, F.lit(" signal"))), F.lit("Unnamed signal"))
    c = confidence(F.col("nodes"), F.col("spread"), roads, F.col("approaches"))
    id_ = F.concat(F.lit("gw-"), F.substring(F.sha1(F.array_join(F.transform("node_ids", lambda x: x.cast("string")), ",").cast("binary")), 1, 12))
    return got.select("junction", id_.alias("id"), name.alias("canonical_name"), "lat", "lon", kind.alias("kind"), "node_ids", "nodes", "spread", c["score"].alias("confidence"), c["review"].alias("review"), "road_names", "approaches")


def kept_tags(members: DataFrame) -> DataFrame:
    """(junction, tags): the control tags of a junction's nodes; of one key the last member's stands."""
    pairs = members.select("junction", "ord", F.explode("tags").alias("k", "v")).filter(F.col("k").rlike(KEPT_TAG))
    last = pairs.groupBy("junction", "k").agg(F.max_by("v", "ord").alias("v"))
    return last.groupBy("junction").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("tags"))


def build_counts(rows: DataFrame) -> DataFrame:
    """One row: junctions by type, approaches, those to be reviewed."""
    kinds = ("junction", "pedestrian_crossing", "midblock_or_single_road", "unresolved")
    return rows.agg(F.count("*").alias("junctions"), F.sum("approaches").alias("approaches"), F.count_if("review").alias("review_needed"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def importance(kinds: Column) -> Column:
    """The highest rank among an array of road kinds, links counted as their road."""
    table = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    return F.coalesce(F.array_max(F.transform(kinds, lambda k: F.coalesce(F.try_element_at(table, F.regexp_replace(k, "_link$", "")), F.lit(1)))), F.lit(1))


def listed_tags(name: Column, signals: Column, direction: Column, crossing: Column) -> Column:
    """Tags of a listed light; blanks are left out."""
    pairs = [("highway", F.lit("traffic_signals")), ("name", name), ("traffic_signals", signals), ("traffic_signals:direction", direction), ("crossing", crossing)]
    return F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), lambda k, v: F.coalesce(v != "", F.lit(False)))


def tags_differ(name: Column, signals: Column, direction: Column, crossing: Column, tags: Column) -> Column:
    """Whether a list's words for a light are not the extract's; a blank is no word."""
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    blank = lambda c: F.coalesce(c, F.lit(""))
    facing = F.coalesce(tag("traffic_signals:direction"), tag("direction"), F.lit(""))
    return (blank(tag("name")) != blank(name)) | (blank(tag("traffic_signals")) != blank(signals)) | (facing != blank(direction)) | (blank(tag("crossing")) != blank(crossing))


def reconcile(listed: DataFrame, junctions: DataFrame, known: DataFrame, lat: float, attach_m: float = 60.0, moved_m: float = 5.0) -> DataFrame:
    """(id, ord, outcome, to, metres): how each listed light stands to what is known.

    present or moved by id; else attached to the nearest junction, or to the nearest light added
    before it in the list's order; else added. What is added are the lights away from junctions that
    a pass in order keeps apart (`lights_apart`, in rounds over cells); all the rest is joins with those,
    of which few stand near any place. listed: id, ord (unique), lat, lon.
    """
    by_id = listed.alias("s").join(known.alias("k"), F.col("s.id") == F.col("k.id"), "left")
    d = geo.haversine(F.col("s.lat"), F.col("s.lon"), F.col("k.lat"), F.col("k.lon"))
    seen = by_id.select("s.id", "s.ord", "s.lat", "s.lon", F.when(F.col("k.id").isNull(), None).when(d > moved_m, "moved").otherwise("present").alias("outcome"), F.col("k.id").cast("string").alias("to"), d.alias("metres"))
    new = write_table(seen.filter("outcome IS NULL").select("ord", "id", "lat", "lon"), "new-lights")
    near = nearest_within(new, junctions, attach_m, lat, "ord", "junction").select(F.col("l").alias("ord"), F.col("r").cast("string").alias("known"), F.col("metres").alias("known_m"))
    near = write_table(near, "near-lights")
    added = write_table(lights_apart(new.join(near, "ord", "left_anti"), attach_m, lat).join(new, "ord"), "added-lights")
    rest = new.join(added.select("ord"), "ord", "left_anti")
    pairs = radius_join(rest, added, attach_m, lat, "ord", "ord").filter("r < l")
    best = pairs.groupBy(F.col("l").alias("ord")).agg(F.min(F.struct("metres", "r")).alias("b")).select("ord", "b.metres", F.col("b.r").alias("added_ord"))
    best = best.join(added.select(F.col("ord").alias("added_ord"), F.col("id").cast("string").alias("added")), "added_ord")
    closer = F.coalesce(F.col("metres") < F.coalesce("known_m", F.lit(float("inf"))), F.lit(False))
    attached = rest.join(near, "ord", "left").join(best, "ord", "left").select("id", "ord", F.lit("attached").alias("outcome"), F.when(closer, F.col("added")).otherwise(F.col("known")).alias("to"), F.when(closer, F.col("metres")).otherwise(F.col("known_m")).alias("metres"))
    new_ones = added.select("id", "ord", F.lit("added").alias("outcome"), F.col("id").cast("string").alias("to"), F.lit(None).cast("double").alias("metres"))
    return seen.filter("outcome IS NOT NULL").select("id", "ord", "outcome", "to", "metres").unionByName(attached).unionByName(new_ones)


def reconcile_lists(lists: list[tuple[str, DataFrame]], junctions: DataFrame, known: DataFrame, lat: float, attach_m: float = 60.0, moved_m: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(listed, outcomes) of several lists one after another, with `file`: a light added by one list is there for the next.

    lists: (file, rows) in order, rows with id, lat, lon and what else they bear alike (readers.lists gives both). A row's
    ord is its list's number and its place in it.
    """
    rows = [r.withColumn("file", F.lit(name)).withColumn("ord", F.lit(k << 48) + F.monotonically_increasing_id()) for k, (name, r) in enumerate(lists)]
    listed = write_table(reduce(DataFrame.unionByName, rows), "listed")
    return listed, reconcile(listed, junctions, known, lat, attach_m, moved_m).join(listed.select("ord", "file"), "ord")


def list_reports(listed: DataFrame, outcomes: DataFrame, known: DataFrame, tags: DataFrame) -> DataFrame:
    """report() of each list, by file. tags: id, tags of what is known."""
    per = Window.partitionBy("file")
    box = listed.groupBy("file").agg(F.count("*").alias("rows"), *[F.round(f(c), 7).alias(n) for n, f, c in (("south", F.min, "lat"), ("north", F.max, "lat"), ("west", F.min, "lon"), ("east", F.max, "lon"))])
    n = lambda *k: F.count_if(F.col("outcome").isin(*k))
    counts = outcomes.groupBy("file").agg(n("present", "moved").alias("present"), n("moved").alias("moved"), n("attached").alias("attached"), n("added").alias("added"))
    differ = listed.join(tags, "id").groupBy("file").agg(F.count_if(tags_differ(*(F.col(c) for c in ("name", "signals", "direction", "crossing")), F.col("tags"))).alias("tag_differences"))
    met = listed.select("file", "id").distinct().join(known.select("id"), "id").groupBy("file").agg(F.count("*").alias("met"))
    said = listed.filter(F.coalesce(F.col("source") != "", F.lit(False))).groupBy("file", "source").agg(F.count("*").alias("k"), F.min("ord").alias("first"))
    said = said.withColumn("_n", F.row_number().over(per.orderBy(F.desc("k"), "first"))).filter("_n = 1").select("file", F.col("source").alias("provider"))
    total = known.select("id").distinct().agg(F.count("*").alias("total"))  # one row
    out = box
    for side in (counts, differ, met, said):
        out = out.join(side, "file", "left")
    from wayfare.functions.formats import date_in_name

    out = out.crossJoin(F.broadcast(total)).withColumn("not_in_file", F.col("total") - F.coalesce("met", F.lit(0))).withColumn("as_of", date_in_name(F.col("file")))
    zero = ["present", "moved", "attached", "added", "tag_differences"]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero} | {"provider": F.coalesce("provider", F.lit(""))}).drop("total", "met")


def listed_junctions(added: DataFrame) -> DataFrame:
    """Junctions made of added lights alone: known by place only, always to be reviewed.

    added: id, name, lat, lon, tags, file.
    """
    score = 0.0
    for v in LISTED_SCORE.values():
        score += v
    id_ = F.concat(F.lit("gw-"), F.substring(F.sha1(F.col("id").cast("string").cast("binary")), 1, 12))
    return added.select(
        id_.alias("id"), F.coalesce(F.nullif("name", F.lit("")), F.lit("Unnamed signal")).alias("canonical_name"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.lit("unresolved").alias("kind"),
        F.array("id").alias("node_ids"), F.lit(round(max(0.0, min(1.0, score)), 2)).alias("confidence"), F.lit(True).alias("review"), "tags", F.col("file").alias("seed_source"),
    )


def seeded(outcomes: DataFrame) -> DataFrame:
    """(to, seed_ids): the listed lights attached to each junction, sorted."""
    return outcomes.filter("outcome = 'attached'").groupBy("to").agg(F.array_sort(F.collect_set("id")).alias("seed_ids"))


def browse(rows: DataFrame, name: str, ordinal: str, size: int, after: int = 0) -> DataFrame:
    """`size` rows with their `place` (from 1) in the order in which readers look names up, behind the first `after`; ties by ordinal.

    The order is that of the root collation: case and accents count only where letters are equal. A bounded sort.
    """
    key = [F.collate(F.col(name), "UNICODE"), F.col(ordinal)]
    top = rows.orderBy(*key).limit(after + size)  # so the window below holds a page and what is before it
    return top.withColumn("place", F.row_number().over(Window.orderBy(*key))).filter(F.col("place") > after)


def most_common(rows: DataFrame, value: str, ordinal: str) -> DataFrame:
    """One row: the value met most often, the first met on ties; blanks do not count."""
    counts = rows.filter(F.coalesce(F.col(value) != "", F.lit(False))).groupBy(value).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    return counts.agg(F.coalesce(F.max_by(value, F.struct("n", -F.col("first"))), F.lit("")).alias(value))


def report(listed: DataFrame, outcomes: DataFrame, known: DataFrame, differing: DataFrame, file: str) -> DataFrame:
    """One row: how a list compares. differing: one row with tag_differences."""
    box = listed.agg(F.count("*").alias("rows"), *[F.round(f(c), 7).alias(n) for n, f, c in (("south", F.min, "lat"), ("north", F.max, "lat"), ("west", F.min, "lon"), ("east", F.max, "lon"))])
    n = lambda *k: F.count_if(F.col("outcome").isin(*k))
    counts = outcomes.agg(n("present", "moved").alias("present"), n("moved").alias("moved"), n("attached").alias("attached"), n("added").alias("added"))
    missing = known.join(listed.select("id"), "id", "left_anti").agg(F.count("*").alias("not_in_file"))
    out = box
    for one in (counts, missing, most_common(listed, "source", "ord").withColumnRenamed("source", "provider"), differing):
        out = out.crossJoin(F.broadcast(one))  # one row each
    from wayfare.functions.formats import date_in_name

    return out.withColumn("file", F.lit(file)).withColumn("as_of", date_in_name(F.lit(file)))
