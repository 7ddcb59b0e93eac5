"""Junctions built, lists reconciled and tables read from words, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions import geo, text
from wayfare.operators import junctions, layout, match, pages
from wayfare.plans.spatial_q import _HAV, _place_sql, places
from wayfare.session import table


def _members(spark, sf_dir):
    """Customers as signal nodes, six to a junction at most."""
    k = F.col("c_custkey")
    tags = F.map_filter(
        F.create_map(
            F.lit("highway"), F.lit("traffic_signals"), F.lit("name"), F.when(k % 11 == 0, F.col("c_name")), F.lit("crossing"), F.when(k % 13 == 0, "traffic_signals").when(k % 17 == 0, "zebra"),
            F.lit("button_operated"), F.when(k % 23 == 0, "yes"), F.lit("traffic_signals:direction"), F.when(k % 2 == 0, F.lower("c_mktsegment")), F.lit("note"), F.lit("x"),
        ),
        lambda a, b: b.isNotNull(),
    )
    lat, lon = 12.9 + F.floor(k / 6) * 0.01 + (k % 6) * 0.00015, 77.6 + (k % 3) * 0.0002
    return table(spark, sf_dir, "customer").select(F.floor(k / 6).alias("junction"), k.alias("node"), k.alias("ord"), lat.alias("lat"), lon.alias("lon"), tags.alias("tags"), (k % 4).alias("n_approaches"))


def _merged(spark, sf_dir):
    """Suppliers and parts as approaches: up to four a junction."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0").select(F.floor(p / 5).alias("junction"), (p % 5).cast("int").alias("k"), F.when(p % 3 != 0, F.col("p_type")).alias("name"))


def junction_records(spark, sf_dir):
    """Names, type, place and confidence of each junction."""
    got = junctions.records(_members(spark, sf_dir), _merged(spark, sf_dir))
    return got.select("junction", "id", "canonical_name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "kind", F.array_join(F.transform("node_ids", lambda x: x.cast("string")), ",").alias("node_ids"), F.round("spread", 3).alias("spread"), F.round("confidence", 6).alias("confidence"), "review", F.array_join("road_names", "|").alias("roads"), "approaches")


def junction_counts(spark, sf_dir):
    return junctions.build_counts(junctions.records(_members(spark, sf_dir), _merged(spark, sf_dir)))


def junction_tags(spark, sf_dir):
    """The control tags a junction keeps of its nodes, the last node's first."""
    got = junctions.kept_tags(_members(spark, sf_dir))
    return got.select("junction", F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("tags"))


def merged_approaches(spark, sf_dir):
    """Orders as approaches of their customer's junction, those of one road and heading taken together."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    upstream = F.transform(F.sequence(F.lit(1), (k % 5 + 2).cast("int")), lambda i: F.struct(i.cast("double").alias("lat"), i.cast("double").alias("lon")))
    rows = o.select(F.col("o_custkey").alias("junction"), F.floor(k / 3).alias("node"), (k % 4).alias("way"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("name"), (F.floor(F.col("o_totalprice") * 10 % F.lit(3600.0)) / 10).alias("bearing"), upstream.alias("upstream"), F.struct(k.alias("o")).alias("ord"))
    got = junctions.merge_approaches(rows)
    return got.select("junction", "k", "name", "bearing", "compass", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"), F.array_join(F.transform("ways", lambda x: x.cast("string")), ",").alias("ways"), F.col("points").cast("long").alias("points"))


def _listed(spark, sf_dir):
    """Customers as a list of lights: some known by id, some moved, some near a supplier, some near one another."""
    k = F.col("c_custkey")
    at = places(spark, sf_dir, "customer", "c_custkey")
    d = F.when(k % 5 == 0, 0.0).when(k % 5 == 1, 0.0002).otherwise(0.0)
    # every third light stands beside the one three places on
    near = F.when(k % 9 == 3, 12.78 + ((k - 3) * 7919 % 4001) / F.lit(10000.0) + 0.0003).otherwise(F.col("lat"))
    near_lon = F.when(k % 9 == 3, 77.38 + ((k - 3) * 104729 % 4401) / F.lit(10000.0)).otherwise(F.col("lon"))
    return at.select(k.alias("id"), k.alias("ord"), (near + d).alias("lat"), near_lon.alias("lon"), F.when(k % 3 == 0, "A list").when(k % 3 == 1, "").otherwise("B list").alias("source"))


def _known(spark, sf_dir):
    return places(spark, sf_dir, "customer", "c_custkey").filter("c_custkey % 5 < 2").withColumnRenamed("c_custkey", "id")


def _sites(spark, sf_dir):
    return places(spark, sf_dir, "supplier", "s_suppkey").withColumnRenamed("s_suppkey", "junction")


def reconciled(spark, sf_dir):
    """How each listed light stands to what is known, in the list's order."""
    got = junctions.reconcile(_listed(spark, sf_dir), _sites(spark, sf_dir), _known(spark, sf_dir), 13.0)
    return got.select("id", "outcome", "to", F.round("metres", 3).alias("metres"))


def reconcile_report(spark, sf_dir):
    listed, known = _listed(spark, sf_dir), _known(spark, sf_dir)
    out = junctions.reconcile(listed, _sites(spark, sf_dir), known, 13.0)
    k = F.col("c_custkey")
    tags = F.create_map(F.lit("name"), F.when(k % 2 == 0, F.col("c_name")).otherwise(""), F.lit("direction"), F.lit("forward"))
    c = table(spark, sf_dir, "customer").filter("c_custkey % 5 < 2")
    differing = c.agg(F.count_if(junctions.tags_differ(F.when(k % 4 == 0, F.col("c_name")), F.lit(""), F.when(k % 3 != 0, "forward"), F.lit(None).cast("string"), tags)).alias("tag_differences"))
    # lights known but not listed: none here, so a tenth of the list is left out
    got = junctions.report(listed.filter("id % 10 <> 6"), out, known, differing, "lights_2024-01-31.csv")
    return got.select("rows", "present", "moved", "attached", "added", "not_in_file", "provider", "tag_differences", "file", "as_of", "south", "north", "west", "east")


def listed_only(spark, sf_dir):
    """Junctions made of listed lights alone, and the lights attached to others."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    tags = junctions.listed_tags(F.when(k % 2 == 0, F.col("c_name")).otherwise(""), F.lit("signal"), F.when(k % 3 == 0, "both"), F.lit(None).cast("string"))
    rows = junctions.listed_junctions(places(spark, sf_dir, "customer", "c_custkey").join(c.select("c_custkey", F.when(k % 2 == 0, F.col("c_name")).otherwise("").alias("name"), tags.alias("tags")), "c_custkey").select(k.alias("id"), "name", "lat", "lon", "tags", F.lit("f.csv").alias("file")))
    return rows.select("id", "canonical_name", "lat", "lon", "confidence", F.array_join(F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("tags"))


def browse_order(spark, sf_dir):
    """The second hundred of parts by name, in mixed case, with accents and signs, as readers look them up."""
    k = F.col("p_partkey")
    plain = F.when(k % 5 == 0, F.translate("p_name", "eao", "éàö")).when(k % 7 == 0, F.translate("p_name", " ", "-")).otherwise(F.col("p_name"))
    name = F.when(k % 3 == 0, F.upper(plain)).when(k % 3 == 1, F.initcap(plain)).otherwise(plain)
    return junctions.browse(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")), "name", "p_partkey", 100, 100)


def polylines(spark, sf_dir):
    """Each order's encoded line of three points: decoded, its length and its bearing along."""
    k = F.col("o_orderkey")
    # differences under 16 units are one character each
    step = lambda n, j: F.char((((k * n) % 15) * 2 + j + 63).cast("int"))
    line = F.concat(F.lit("_p~iF~ps|U"), step(3, 0), step(5, 1), step(7, 0), step(11, 0))
    # a line is decoded once, and its points stand behind a Generate
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.inline(F.array(F.struct(geo.decoded(line).alias("p")))))
    last = F.element_at("p", -1)
    return o.select("o_orderkey", F.size("p").alias("points"), F.round(last["lat"], 5).alias("lat"), F.round(last["lon"], 5).alias("lon"), F.round(geo.path_length(F.col("p")), 3).alias("metres"))


def _rows(spark, sf_dir):
    """Line items as rows of their order's timing table."""
    h = (F.col("l_quantity") % 20).cast("int")
    start, end = F.format_string("%02d:00", h), F.format_string("%02d:30", h + F.col("l_linenumber") % 4)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("panel"), (F.col("l_extendedprice") + F.col("l_linenumber") / 8).alias("top"), start.alias("start"), end.alias("end"), F.when(F.col("l_returnflag") == "R", "blinking").otherwise("timed").alias("mode"),
        (F.col("l_tax") < 0.05).alias("consistent"), F.when(F.col("l_discount") > 0.08, 1).otherwise(0).alias("unassigned"),
    )


def day_plans(spark, sf_dir):
    """Rows of each table parted into days where the clock goes back, and whether each day is in order."""
    rows = layout.day_groups(_rows(spark, sf_dir))
    got = layout.ordered(rows)
    label = F.when(F.col("panel") % 7 == 0, "SATURDAY & SUNDAY").when(F.col("panel") % 7 == 1, "Sunday weekday").when(F.col("panel") % 7 == 2, "sunday").when(F.col("panel") % 7 == 3, "HOLIDAY").when(F.col("panel") % 7 == 4, "Saturday")
    return got.select("panel", "day", "windows", "windows_ordered", layout.day_type(label, F.col("day")).alias("day_type"))


def parse_confidence(spark, sf_dir):
    rows = layout.day_groups(_rows(spark, sf_dir))
    rows = rows.withColumn("day_type", layout.day_type(F.when(F.col("panel") % 3 == 0, "SUNDAY"), F.col("day")))
    k = F.col("o_orderkey")
    about = table(spark, sf_dir, "orders").select(k.alias("panel"), (k % 4 != 0).alias("clean_label"), (k % 4).alias("phase_count"), F.when(k % 5 != 0, "A ROAD X B ROAD").alias("descriptor"))
    return layout.parse_confidence(rows, about, 9)


def row_bands(spark, sf_dir):
    letters = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("panel"), (F.col("l_linenumber") * 9 + F.col("l_quantity") % 5).alias("top"))
    return layout.bands(letters, 200.0)


def phase_labels(spark, sf_dir):
    """Which letters move in each phase of each order's table."""
    k = F.col("l_linenumber")
    li = table(spark, sf_dir, "lineitem")
    move = F.get(F.array(*map(F.lit, "USLR")), (F.col("l_partkey") % 4).cast("int"))
    matrix = li.select(F.col("l_orderkey").alias("panel"), F.get(F.array(*map(F.lit, "ABCD")), k % 4).alias("letter"), (k % 4).alias("ord"), (F.col("l_suppkey") % 3).alias("phase"), move.alias("movement"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("panel"), F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("phase"))
    return layout.phase_labels(matrix, o.withColumn("pedestrian", F.col("phase") == F.col("panel") % 5))


def matrix_confidence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return layout.matrix_confidence(li.select(F.col("l_orderkey").alias("panel"), F.col("l_linenumber").alias("letter"), F.when(F.col("l_quantity") > 5, "FROM X").alias("landmark"), (F.col("l_partkey") % 3).alias("moves")))


def headers_and_roads(spark, sf_dir):
    """Header lines and road descriptors of parts read into their parts."""
    p = F.col("p_partkey")
    control = F.get(F.array(*map(F.lit, ["FIXED", "vac", "SEMI VAC", "ATCS", "SYNC", "", "ODD ONE"])), (p % 7).cast("int"))
    line = F.concat(F.initcap("p_name"), F.when(p % 2 == 0, "  Junction").otherwise(" JUCTION"), F.when(p % 9 == 0, " ").otherwise(", "), F.col("p_type"), F.lit(" POLICE  STATION - "), control)
    h = layout.header(line)
    roads = text.roads_of(F.concat(F.col("p_name"), F.lit(" ROAD X "), F.col("p_brand"), F.when(p % 2 == 0, " JN").otherwise("")))
    return table(spark, sf_dir, "part").select("p_partkey", h["name"].alias("name"), h["station"].alias("station"), h["control"].alias("control"), h["hint"].alias("hint"), F.array_join(roads, "|").alias("roads"), text.name_key(F.col("p_name"), F.col("p_type")).alias("name_key"))


def word_lines(spark, sf_dir):
    """Line items as words of their order's page, gathered into lines by a moving mean."""
    li = table(spark, sf_dir, "lineitem")
    words = li.select(F.col("l_orderkey").alias("doc"), F.concat_ws("/", "l_linenumber", "l_partkey").alias("text"), F.col("l_partkey").cast("double").alias("x0"), (F.col("l_partkey") + 5.0).alias("x1"), (F.col("l_quantity") % 16).alias("top"), F.lit(9.0).alias("size"))
    return layout.lines(words, 3.5).select("doc", "text", "line")


def timing_table(spark, sf_dir):
    """Line items as numbers of their order's timing table: placed under columns and read by row."""
    li = table(spark, sf_dir, "lineitem")
    numbers = li.select(F.col("l_orderkey").alias("panel"), (F.col("l_linenumber") % 2).alias("row"), ((F.col("l_partkey") % 5) * 40 + F.col("l_suppkey") % 30).cast("double").alias("x"), (F.col("l_quantity") * 5).cast("long").alias("value"))
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    columns = o.select(k.alias("panel"), F.explode(F.sequence(F.lit(0), (k % 2 + 1).cast("int"))).alias("phase")).withColumn("x", F.col("phase") * 40.0 + 15)
    cycles = o.select(k.alias("panel"), F.when(k % 3 != 0, 150.0).alias("cycle_x"))
    rows = o.select(k.alias("panel"), F.explode(F.array(F.lit(0), F.lit(1))).alias("row"), (k % 11 == 0).alias("blinking"))
    got = layout.timing_rows(layout.placed_numbers(numbers, columns, cycles), rows, columns)
    return got.withColumn("phases", F.array_join(F.transform("phases", lambda x: F.coalesce(x.cast("string"), F.lit("?"))), ",")).withColumn("flags", F.array_join("flags", ","))


def _pages(spark, sf_dir):
    """(doc, ws, said): every order as a page of one timing panel, odd ones of two, with a row for each of its line items.

    Headings stand a little off, lack or bear phase digits and a CYCLE column; rows bear alternates, stray numbers, a cycle
    that is right, nearly right, wrong or absent, or blink.
    """
    k = F.col("o_orderkey")
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("items"))
    # keys are few bytes and their pages many: they are dealt to all cores before they grow
    o = table(spark, sf_dir, "orders").select(k.alias("doc")).repartition(8 * spark.sparkContext.defaultParallelism, "doc").join(items, "doc", "left")
    doc, empty = F.col("doc"), F.array().cast("array<struct<top:double,x0:double,x1:double,text:string,size:double>>")

    def word(t, x, top, size=7.0, half=10.0):
        at = (F.lit(x - half), F.lit(x + half)) if isinstance(x, float) else (x - half, x + half)
        return F.struct(top.cast("double").alias("top"), at[0].cast("double").alias("x0"), at[1].cast("double").alias("x1"), t.alias("text"), F.lit(size).alias("size"))

    def panel(h: int):
        """The words of one panel's frame and of the row of a line item, and its whole texts."""
        kk, y, high = doc * 2 + h, h * 900.0, F.lit(1700.0 if h else 40.0)
        n = (F.lit(2) + kk % 3).cast("int")
        at = lambda top: F.lit(y + top)
        control = F.get(F.array(*map(F.lit, ("FIXED", "VAC", "ATCS"))), (kk % 3).cast("int"))
        name, station = F.concat(F.lit("P"), kk.cast("string")), F.concat(F.lit("S"), (kk % 10).cast("string"))
        head = [word(t, 50.0 + 60 * i, high, 9.0) for i, t in enumerate((name, F.lit("MARKET,"), station, F.lit("POLICE"), F.lit("STATION"), F.lit("-"), control))]
        heading = [word(F.lit("ROAD"), 70.0, at(100)), word(F.lit("FROM"), 110.0, at(100))]
        cycled = F.when(kk % 5 != 0, F.array(word(F.lit("CYCLE"), 461.0, at(90))))
        upright = F.when(kk % 3 == 0, F.array(word(F.lit("EXCLUSIVE"), 200.0 + 50.0 * (n - 1), at(120), 5.0))).when(kk % 3 == 1, F.array(*[word(F.lit(x), 199.5, at(108 + 5 * i), 5.0, 1.5) for i, x in enumerate("EXCLUSI")]))
        digits = F.when(kk % 7 != 0, F.slice(F.array(*[word(F.lit(str(i)), 150.0 + 50.0 * i, at(104 if i == 2 else 100), half=2.0) for i in range(1, 5)]), 1, n))
        frame = F.concat(F.array(*head, *heading), F.coalesce(cycled, empty), F.coalesce(upright, empty), F.coalesce(digits, empty))

        def row(x, j):
            r = j + 1
            top, kind, hour = y + 150 + 14 * r, x["l_suppkey"] % 6, 6 + 2 * (j % 4)
            value = lambda i: F.lit(10) + (x["l_partkey"] * (i + 3)) % 60
            clock = lambda h: F.concat(h.cast("string"), F.lit(":00"))
            own = [value(i) for i in range(4)]
            total = sum((F.when(n > i, own[i]).otherwise(0) for i in range(2, 4)), own[0] + own[1])
            alternate = F.when(x["l_quantity"] % 4 == 0, F.concat(F.lit("("), (own[0] + 5).cast("string"), F.lit(")"))).otherwise("")
            said = [F.concat(own[0].cast("string"), alternate), *(v.cast("string") for v in own[1:])]
            numbers = [F.when((n > i) & ~((kind == 3) & (n == i + 1)), word(said[i], 200.0 + 50.0 * i, top + i % 2, half=2.0)) for i in range(4)]
            cycle = F.when((kind != 4) & (kk % 5 != 0), word((total + F.when(kind == 1, 2).when(kind == 2, 7).otherwise(0)).cast("string"), 461.0, top))
            more = [word(clock(hour), 140.0, top), word(clock(hour + 2), 170.0, top), cycle, F.when(kind == 5, word(F.lit("BLINKING"), 95.0, top, half=15.0)), F.when(x["l_quantity"] % 7 == 0, word(F.lit("99"), 420.0, top, half=2.0)), F.when((kk % 4 == 0) & (r == 5), word(F.lit("(sunday)"), 95.0, top + 7))]
            return F.array(*more, *numbers)

        whole = F.concat_ws(" ", name, F.lit("MARKET,"), station, F.lit("POLICE STATION -"), control)
        labels = [F.when(kk % 3 != 2, F.struct(at(80).alias("top"), F.lit(130.0).alias("x"), F.lit("P ROAD X S ROAD").alias("text"))), F.when(kk % 2 == 0, F.struct(high.alias("top"), F.lit(40.0).alias("x"), whole.alias("text")))]
        return frame, F.when(F.col("j").isNotNull(), row(F.col("x"), F.col("j"))).otherwise(empty), labels

    (frame, row, told), (other, below, more) = panel(0), panel(1)
    odd = doc % 2 == 1
    both = lambda a, b: F.concat(a, F.when(odd, b).otherwise(empty))
    said = F.array(*told, *[F.when(odd, x) for x in more])
    # each long array of words stands beside one that is compacted: then it is not made in one huge method, which would not be compiled
    each = o.select("doc", "items", said.alias("said")).select("doc", "said", F.posexplode_outer("items").alias("j", "x")).select("doc", both(row, below).alias("row"), F.array_compact("said").alias("said"))
    whole = each.groupBy("doc").agg(F.flatten(F.collect_list("row")).alias("rows"), F.first("said").alias("said"))
    return whole.select("doc", F.concat(both(frame, other), F.array_compact("rows")).alias("ws"), "said")


def page_plans(spark, sf_dir):
    """Orders as pages of words, read to timing plans: a row for each window of each day of each panel."""
    got = pages.read_pages(_pages(spark, sf_dir), height=2000.0, digits=9)
    each = got.select("doc", F.col("k").alias("panel"), "header.name", "header.hint", "parse_confidence", F.inline("day_plans"))
    each = each.select("doc", "panel", "name", "hint", F.col("parse_confidence").alias("confidence"), F.col("day").cast("int").alias("day"), "day_type", "windows_ordered", F.posexplode("windows").alias("i", "w"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("?"))), ",")
    w = F.col("w")
    return each.select(
        "doc", "panel", "name", "hint", "confidence", "day", "day_type", "windows_ordered", "i", w["start"].alias("start"), w["end"].alias("until"), w["mode"].alias("mode"), listed(w["phases"]).alias("phases"), listed(w["alternates"]).alias("alternates"),
        w["cycle_s"].alias("cycle_s"), w["cycle_source"].alias("cycle_source"), w["consistent"].alias("consistent"), w["pedestrian_phase_s"].alias("walk_s"), F.array_join(w["labels"], ",").alias("labels"), listed(w["unassigned"]).alias("unassigned"), F.array_join(w["flags"], ",").alias("flags"),
    )


def _index(spark, sf_dir):
    """Parts of one name and brand as junctions, their type and brand as roads."""
    p = table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("id"), F.min("p_type").alias("t"))
    k = F.col("id")
    return p.select("id", k.alias("ord"), F.concat_ws(" ", "p_name", F.translate("p_brand", "#", " ")).alias("name"), F.array(F.concat(F.col("t"), F.lit(" road")), F.col("p_brand")).alias("roads"), (12.9 + (k % 500) * 0.0004).alias("lat"), (77.5 + (k % 700) * 0.0003).alias("lon"))


def junction_matches(spark, sf_dir):
    """Parts as panels, matched to junctions by words and, for some, by a place found before."""
    p = F.col("p_partkey")
    t = table(spark, sf_dir, "part")
    panels = t.select(p.alias("panel"), F.concat_ws(" ", "p_name", F.when(p % 3 == 0, F.translate("p_brand", "#", " "))).alias("name"), F.when(p % 2 == 0, F.array(F.col("p_type"))).otherwise(F.array().cast("array<string>")).alias("roads"))
    asked = panels.filter("panel % 4 = 0").select(F.concat(F.col("name"), F.lit(" junction, Bengaluru")).alias("query"), "panel").groupBy("query").agg(F.min("panel").alias("k"))
    k = F.col("k")
    places = asked.select("query", (12.9 + (k % 500) * 0.0004 + 0.0001).alias("lat"), (77.5 + (k % 700) * 0.0003).alias("lon"), F.when(k % 3 == 0, "Silk circle").otherwise("A clinic").alias("label"), F.when(k % 3 == 1, "shop=x").otherwise("place=y").alias("osm"))
    return match.match(panels, _index(spark, sf_dir), places, 13.0)


def name_matches(spark, sf_dir):
    """Names and types of parts as mentions, matched to junctions by name alone."""
    m = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("junction")).alias("mention")).distinct()
    return match.match_names(m, _index(spark, sf_dir))


_MEM = """mem AS (SELECT c_custkey // 6 AS junction, c_custkey AS node, 12.9::DOUBLE + (c_custkey // 6) * 0.01::DOUBLE + (c_custkey % 6) * 0.00015::DOUBLE AS lat, 77.6::DOUBLE + (c_custkey % 3) * 0.0002::DOUBLE AS lon, CASE WHEN c_custkey % 11 = 0 THEN c_name END AS nm, CASE WHEN c_custkey % 13 = 0 THEN 'traffic_signals' WHEN c_custkey % 17 = 0 THEN 'zebra' END AS cr, c_custkey % 23 = 0 AS btn, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) END AS dir FROM customer),
ap AS (SELECT p_partkey // 5 AS junction, p_partkey % 5 AS k, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS name FROM part WHERE p_partkey % 5 <> 0),
rd AS (SELECT junction, list(name ORDER BY k) AS names FROM (SELECT junction, name, min(k) AS k FROM ap WHERE name IS NOT NULL GROUP BY ALL) GROUP BY junction),
ja AS (SELECT junction, count(*) AS n FROM ap GROUP BY junction),
cen AS (SELECT junction, avg(lat) AS lat, avg(lon) AS lon, count(*) AS nodes, string_agg(node::VARCHAR, ',' ORDER BY node) AS ids, arg_min(nm, node) FILTER (nm IS NOT NULL) AS named, bool_and(cr IS NOT NULL) AS xonly, bool_or(coalesce(cr = 'traffic_signals', FALSE) OR btn) AS pressed FROM mem GROUP BY junction),
spr AS (SELECT junction, max(""" + _HAV.format(a="cen", b="mem") + """) AS spread FROM mem JOIN cen USING (junction) GROUP BY junction),
jr AS (SELECT c.*, spread, coalesce(n, 0) AS ap, coalesce(names, []) AS roads, CASE WHEN nodes = 1 THEN 0.1::DOUBLE WHEN nodes <= 4 THEN 0.05::DOUBLE ELSE -0.1::DOUBLE * (nodes - 4) END AS f1, CASE WHEN spread <= 25 THEN 0.1::DOUBLE WHEN spread <= 60 THEN 0.0::DOUBLE ELSE -0.2::DOUBLE END AS f2,
  CASE WHEN coalesce(len(names), 0) >= 2 THEN 0.1::DOUBLE WHEN len(names) = 1 THEN 0.0::DOUBLE ELSE -0.15::DOUBLE END AS f3, CASE WHEN n IS NULL THEN -0.3::DOUBLE ELSE 0.0::DOUBLE END AS f4 FROM cen c JOIN spr USING (junction) LEFT JOIN ja USING (junction) LEFT JOIN rd USING (junction)),
js AS (SELECT *, least(1, greatest(0, 0.7::DOUBLE + f1 + f2 + f3 + f4)) AS conf, CASE WHEN (pressed AND len(roads) <= 1) OR xonly THEN 'pedestrian_crossing' WHEN len(roads) >= 2 OR ap >= 3 THEN 'junction' WHEN ap >= 1 THEN 'midblock_or_single_road' ELSE 'unresolved' END AS kind FROM jr)"""
_LIST = f"""pl AS (SELECT * FROM {_place_sql("customer", "c_custkey")}), si AS (SELECT s_suppkey AS junction, lat, lon FROM {_place_sql("supplier", "s_suppkey")}),
ls AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 3 THEN 12.78::DOUBLE + ((c_custkey - 3) * 7919 % 4001) / 10000.0::DOUBLE + 0.0003::DOUBLE ELSE lat END + CASE WHEN c_custkey % 5 = 1 THEN 0.0002::DOUBLE ELSE 0 END AS lat, CASE WHEN c_custkey % 9 = 3 THEN 77.38::DOUBLE + ((c_custkey - 3) * 104729 % 4401) / 10000.0::DOUBLE ELSE lon END AS lon FROM pl),
kn AS (SELECT a.id, {_HAV.format(a="a", b="b")} AS m FROM ls a JOIN pl b ON a.id = b.c_custkey WHERE a.id % 5 < 2),
ns AS (SELECT a.id, min({_HAV.format(a="a", b="b")}) AS m, arg_min(b.junction, ({_HAV.format(a="a", b="b")}, b.junction)) AS j FROM ls a, si b WHERE a.id % 5 >= 2 GROUP BY a.id),
sq AS (SELECT ls.id, lat, lon, m, j, row_number() OVER (ORDER BY ls.id) AS r FROM ls JOIN ns ON ns.id = ls.id),
f AS (SELECT 0::BIGINT AS r, 0::BIGINT AS id, '' AS outcome, NULL::VARCHAR AS tto, NULL::DOUBLE AS m, []::STRUCT(id BIGINT, lat DOUBLE, lon DOUBLE)[] AS added
  UNION ALL SELECT r, id, CASE WHEN am < m AND am <= 60 THEN 'attached' WHEN m <= 60 THEN 'attached' ELSE 'added' END, CASE WHEN am < m AND am <= 60 THEN ai::VARCHAR WHEN m <= 60 THEN j::VARCHAR ELSE id::VARCHAR END, CASE WHEN am < m AND am <= 60 THEN am WHEN m <= 60 THEN m END,
    CASE WHEN (am < m AND am <= 60) OR m <= 60 THEN added ELSE list_append(added, {{'id': id, 'lat': lat, 'lon': lon}}) END
  FROM (SELECT *, best.m AS am, best.id AS ai FROM (SELECT sq.r, sq.id, sq.lat, sq.lon, sq.m, sq.j, f.added, coalesce(list_min(list_transform(f.added, lambda o: {{'m': 2::DOUBLE * 6371008.8::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin((radians(o.lat) - radians(sq.lat)) / 2), 2) + cos(radians(sq.lat)) * cos(radians(o.lat)) * pow(sin((radians(o.lon) - radians(sq.lon)) / 2), 2)))), 'id': o.id}})), {{'m': 1e18::DOUBLE, 'id': NULL::BIGINT}}) AS best FROM f JOIN sq ON sq.r = f.r + 1))),
oc AS (SELECT id, CASE WHEN m > 5 THEN 'moved' ELSE 'present' END AS outcome, id::VARCHAR AS tto, m FROM kn UNION ALL SELECT id, outcome, tto, m FROM f WHERE r > 0)"""
_DAYS = """rw AS (SELECT l_orderkey AS panel, l_extendedprice + l_linenumber / 8.0::DOUBLE AS top, printf('%02d:00', trunc(l_quantity % 20)::INT) AS st, printf('%02d:30', trunc(l_quantity % 20)::INT + l_linenumber % 4) AS en, l_returnflag <> 'R' AS timed, l_tax < 0.05 AS cons, l_discount > 0.08 AS un FROM lineitem),
dg AS (SELECT *, sum(b) OVER (PARTITION BY panel ORDER BY top)::INT AS day FROM (SELECT *, coalesce(st < lag(en) OVER w AND st <= lag(st) OVER w, FALSE)::INT AS b FROM rw WINDOW w AS (PARTITION BY panel ORDER BY top)))"""

QUERIES = {f.__name__: f for f in (junction_records, junction_counts, junction_tags, merged_approaches, reconciled, reconcile_report, listed_only, browse_order, polylines, day_plans, parse_confidence, row_bands, phase_labels, matrix_confidence, headers_and_roads, word_lines, timing_table, page_plans, junction_matches, name_matches)}
ORACLES = {
    "junction_records": f"""WITH {_MEM} SELECT junction, 'gw-' || left(sha1(ids), 12) AS id, coalesce(named, CASE WHEN len(roads) >= 2 THEN roads[1] || ' × ' || roads[2] WHEN len(roads) = 1 THEN roads[1] || ' signal' END, 'Unnamed signal') AS canonical_name, round(lat, 6) AS lat, round(lon, 6) AS lon, kind, ids AS node_ids, round(spread, 3) AS spread, round(conf, 6) AS confidence, conf < 0.6 OR nodes > 6 AS review, array_to_string(roads, '|') AS roads, ap AS approaches FROM js""",
    "junction_counts": f"WITH {_MEM} SELECT count(*) AS junctions, sum(ap)::BIGINT AS approaches, count(*) FILTER (conf < 0.6 OR nodes > 6) AS review_needed, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("junction", "pedestrian_crossing", "midblock_or_single_road", "unresolved")) + " FROM js",
    "junction_tags": f"""WITH {_MEM}, t AS (SELECT junction, node, unnest([{{'k': 'name', 'v': nm}}, {{'k': 'crossing', 'v': cr}}, {{'k': 'button_operated', 'v': CASE WHEN btn THEN 'yes' END}}, {{'k': 'traffic_signals:direction', 'v': dir}}]) AS e FROM mem),
l AS (SELECT junction, e.k AS k, arg_max(e.v, node) AS v FROM t WHERE e.v IS NOT NULL GROUP BY ALL) SELECT junction, string_agg(k || '=' || v, ';' ORDER BY k) AS tags FROM l GROUP BY junction""",
    "merged_approaches": """WITH RECURSIVE a AS (SELECT o_custkey AS j, o_orderkey // 3 AS node, o_orderkey % 4 AS way, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus ELSE '' END AS name, floor(o_totalprice * 10 % 3600) / 10 AS b, o_orderkey % 5 + 2 AS pts, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey // 3, o_orderkey) AS r FROM orders),
f AS (SELECT j, r, [{'b': b, 'name': name, 'nodes': [node], 'ways': [way], 'pts': pts}] AS d FROM a WHERE r = 1
 UNION ALL SELECT j, r, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(d, {'b': b, 'name': name, 'nodes': [node], 'ways': [way], 'pts': pts}) ELSE list_transform(d, lambda o, i: CASE WHEN i = hit THEN {'b': o.b, 'name': o.name, 'nodes': list_distinct(list_append(o.nodes, node)), 'ways': list_distinct(list_append(o.ways, way)), 'pts': greatest(o.pts, pts)} ELSE o END) END
 FROM (SELECT a.*, f.d, list_position(list_transform(f.d, lambda o: o.name = a.name AND least(abs(o.b - a.b), 360 - abs(o.b - a.b)) <= 20), TRUE) AS hit FROM f JOIN a ON a.j = f.j AND a.r = f.r + 1)),
l AS (SELECT j, arg_max(d, r) AS d FROM f GROUP BY j), u AS (SELECT j, unnest(d) AS m FROM l)
SELECT j AS junction, row_number() OVER (PARTITION BY j ORDER BY m.b, m.name, m.nodes, m.ways)::INT AS k, nullif(m.name, '') AS name, m.b AS bearing, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][(floor(m.b / 45 + 0.5)::INT % 8) + 1] AS compass, array_to_string(list_sort(m.nodes), ',') AS nodes, array_to_string(list_sort(m.ways), ',') AS ways, m.pts AS points FROM u""",
    "reconciled": f"WITH RECURSIVE {_LIST} SELECT id, outcome, tto AS \"to\", round(m, 3) AS metres FROM oc",
    "reconcile_report": f"""WITH RECURSIVE {_LIST}, kk AS (SELECT * FROM ls WHERE id % 10 <> 6) SELECT (SELECT count(*) FROM kk) AS rows, count(*) FILTER (outcome IN ('present', 'moved')) AS present, count(*) FILTER (outcome = 'moved') AS moved, count(*) FILTER (outcome = 'attached') AS attached, count(*) FILTER (outcome = 'added') AS added,
(SELECT count(*) FROM customer WHERE c_custkey % 5 < 2 AND c_custkey % 10 = 6) AS not_in_file, (SELECT s FROM (SELECT CASE WHEN id % 3 = 0 THEN 'A list' ELSE 'B list' END AS s, count(*) AS n, min(id) AS i FROM kk WHERE id % 3 <> 1 GROUP BY 1) ORDER BY n DESC, i LIMIT 1) AS provider,
(SELECT count(*) FROM customer WHERE c_custkey % 5 < 2 AND (CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END <> CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE '' END OR c_custkey % 3 = 0)) AS tag_differences, 'lights_2024-01-31.csv' AS file, '2024-01-31' AS as_of,
(SELECT round(min(lat), 7) FROM kk) AS south, (SELECT round(max(lat), 7) FROM kk) AS north, (SELECT round(min(lon), 7) FROM kk) AS west, (SELECT round(max(lon), 7) FROM kk) AS east FROM oc""",
    "listed_only": f"""SELECT 'gw-' || left(sha1(c_custkey::VARCHAR), 12) AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Unnamed signal' END AS canonical_name, round(lat, 7) AS lat, round(lon, 7) AS lon, 0.45::DOUBLE AS confidence, concat_ws(';', 'highway=traffic_signals', CASE WHEN c_custkey % 2 = 0 THEN 'name=' || c_name END, CASE WHEN c_custkey % 3 = 0 THEN 'traffic_signals:direction=both' END, 'traffic_signals=signal') AS tags FROM {_place_sql("customer", "c_custkey")} JOIN customer USING (c_custkey)""",
    "browse_order": """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN translate(p_name, 'eao', 'éàö') WHEN p_partkey % 7 = 0 THEN translate(p_name, ' ', '-') ELSE p_name END AS t FROM part),
m AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(t) WHEN 1 THEN array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE t END AS name FROM n)
SELECT p_partkey, name, place::INT AS place FROM (SELECT *, row_number() OVER (ORDER BY name COLLATE en, p_partkey) AS place FROM m) WHERE place BETWEEN 101 AND 200""",
    "polylines": """WITH k AS (SELECT o_orderkey, (o_orderkey * 3) % 15 AS a, -((o_orderkey * 5) % 15) - 1 AS b, (o_orderkey * 7) % 15 AS c, (o_orderkey * 11) % 15 AS d FROM orders),
p AS (SELECT o_orderkey, [38.5::DOUBLE, (3850000 + a) / 100000.0::DOUBLE, (3850000 + a + c) / 100000.0::DOUBLE] AS y, [-120.2::DOUBLE, (-12020000 + b) / 100000.0::DOUBLE, (-12020000 + b + d) / 100000.0::DOUBLE] AS x FROM k)
SELECT o_orderkey, 3 AS points, round(y[3], 5) AS lat, round(x[3], 5) AS lon, round(list_sum(list_transform([1, 2], lambda i: 2::DOUBLE * 6371008.8::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin((radians(y[i + 1]) - radians(y[i])) / 2), 2) + cos(radians(y[i])) * cos(radians(y[i + 1])) * pow(sin((radians(x[i + 1]) - radians(x[i])) / 2), 2)))))), 3) AS metres FROM p""",
    "day_plans": f"""WITH {_DAYS}, o AS (SELECT panel, day, coalesce(en <= lead(st) OVER (PARTITION BY panel, day ORDER BY top), TRUE) AS ok FROM dg)
SELECT panel, day, count(*) AS windows, bool_and(ok) AS windows_ordered, CASE panel % 7 WHEN 0 THEN 'all_days' WHEN 1 THEN 'all_days' WHEN 2 THEN 'sunday' WHEN 3 THEN 'holiday' WHEN 4 THEN 'saturday' ELSE CASE WHEN day = 0 THEN 'weekday_default' ELSE 'unlabelled_group' END END AS day_type FROM o GROUP BY panel, day""",
    "parse_confidence": f"""WITH {_DAYS}, s AS (SELECT panel, count(*) AS n, count(*) FILTER (timed) AS t, count(*) FILTER (timed AND cons) AS c, count(*) FILTER (NOT un) AS u, bool_and(panel % 3 = 0 OR day = 0) AS l FROM dg GROUP BY panel)
SELECT o_orderkey AS panel, round(0.0::DOUBLE + 0.15::DOUBLE * CASE WHEN o_orderkey % 4 <> 0 THEN 1 ELSE 0.6::DOUBLE END + 0.2::DOUBLE * (o_orderkey % 4 >= 2)::INT + 0.15::DOUBLE * coalesce((t > 0)::INT, 0) + 0.25::DOUBLE * coalesce(c / nullif(t, 0)::DOUBLE, 0) + 0.1::DOUBLE * coalesce(u / n::DOUBLE, 0) + 0.1::DOUBLE * coalesce(l::INT, 0) + 0.05::DOUBLE * (o_orderkey % 5 <> 0)::INT, 9) AS confidence FROM orders LEFT JOIN s ON panel = o_orderkey""",
    "row_bands": "SELECT l_orderkey AS panel, l_linenumber * 9 + l_quantity % 5 AS top, least(coalesce(lead(l_linenumber * 9 + l_quantity % 5) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 9 + l_quantity % 5), 200) - 2, l_linenumber * 9 + l_quantity % 5 + 22) AS until FROM lineitem",
    "phase_labels": """WITH m AS (SELECT DISTINCT l_orderkey AS panel, ['A', 'B', 'C', 'D'][l_linenumber % 4 + 1] AS letter, l_linenumber % 4 AS ord, l_suppkey % 3 AS phase, ['U', 'S', 'L', 'R'][l_partkey % 4 + 1] AS mv FROM lineitem),
g AS (SELECT panel, phase, ord, letter || '·' || string_agg(mv, '' ORDER BY list_position(['L', 'S', 'R', 'U'], mv)) AS part FROM m GROUP BY panel, phase, ord, letter), h AS (SELECT panel, phase, string_agg(part, ' + ' ORDER BY ord) AS parts FROM g GROUP BY ALL)
SELECT o_orderkey AS panel, p.phase, nullif(concat_ws(' + ', parts, CASE WHEN p.phase = o_orderkey % 5 THEN 'pedestrian (EXCLUSIVE)' END), '') AS label FROM orders, range(0, 4) p(phase) LEFT JOIN h ON h.panel = o_orderkey AND h.phase = p.phase""",
    "matrix_confidence": "SELECT panel, CASE WHEN n < 2 THEN 0.3::DOUBLE ELSE least(1, round(0.5::DOUBLE * m / n + 0.3::DOUBLE * CASE WHEN nm THEN 1 ELSE 0.5::DOUBLE END + 0.2::DOUBLE, 2)) END AS confidence FROM (SELECT l_orderkey AS panel, count(*) AS n, count(*) FILTER (l_partkey % 3 > 0) AS m, bool_and(l_quantity > 5) AS nm FROM lineitem GROUP BY 1)",
    "headers_and_roads": f"""SELECT p_partkey, CASE WHEN ok THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS name, CASE WHEN ok THEN p_type END AS station, CASE WHEN ok THEN ['FIXED', 'VAC', 'SEMI VAC', 'ATCS', 'SYNC', 'UNSPECIFIED', 'ODD ONE'][p_partkey % 7 + 1] END AS control, CASE WHEN ok THEN ['fixed', 'vehicle_actuated', 'vehicle_actuated', 'adaptive', 'fixed_coordinated', 'unknown', 'odd one'][p_partkey % 7 + 1] END AS hint,
p_name || ' ROAD|' || p_brand AS roads, {"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), '\\s+'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP) + ") AND len(t) > 1), ' ')"}""".replace("{c}", "p_name") + " || '|' || " + ("array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(p_type), '[^a-z0-9 ]', ' ', 'g'), '\\s+'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP) + ") AND len(t) > 1), ' ')") + " AS name_key FROM (SELECT *, p_partkey % 9 <> 0 AS ok FROM part)",
    "word_lines": """WITH RECURSIVE w AS (SELECT l_orderkey AS doc, l_linenumber || '/' || l_partkey AS text, l_quantity % 16 AS top, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity % 16, l_partkey, l_linenumber || '/' || l_partkey) AS r FROM lineitem),
f AS (SELECT doc, text, r, 0 AS line, top AS mean, 1 AS n FROM w WHERE r = 1 UNION ALL SELECT w.doc, w.text, w.r, CASE WHEN abs(f.mean - w.top) <= 3.5 THEN f.line ELSE f.line + 1 END, CASE WHEN abs(f.mean - w.top) <= 3.5 THEN (f.mean * f.n + w.top) / (f.n + 1) ELSE w.top END, CASE WHEN abs(f.mean - w.top) <= 3.5 THEN f.n + 1 ELSE 1 END FROM f JOIN w ON w.doc = f.doc AND w.r = f.r + 1)
SELECT doc, text, line FROM f""",
    # what the page was made of says what must be read from it
    "page_plans": """WITH o AS (SELECT o_orderkey AS doc, h, o_orderkey * 2 + h AS kk, 2 + (o_orderkey * 2 + h) % 3 AS n FROM orders, range(0, 2) t(h) WHERE h <= o_orderkey % 2),
li AS (SELECT l_orderkey AS doc, l_partkey AS pk, l_suppkey % 6 AS kind, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem),
a AS (SELECT *, kk % 7 = 0 AS bare, list_transform(range(0, n), lambda i: 10 + (pk * (i + 3)) % 60) AS v FROM li JOIN o USING (doc)),
b AS (SELECT *, CASE WHEN kind <> 4 AND kk % 5 <> 0 THEN list_sum(v)::BIGINT + CASE kind WHEN 1 THEN 2 WHEN 2 THEN 7 ELSE 0 END END AS cy, CASE WHEN kind = 3 THEN v[:n - 1] ELSE v END AS shown FROM a),
c AS (SELECT *, list_concat(shown, CASE WHEN q % 7 = 0 THEN [99] ELSE [] END, CASE WHEN cy IS NOT NULL THEN [cy] ELSE [] END) AS nums FROM b),
d AS (SELECT *, len(nums) >= 3 AND nums[-1] >= 30 AND abs(list_sum(nums) - 2 * nums[-1]) <= 3 AS sums FROM c),
e AS (SELECT *, CASE WHEN NOT bare THEN CASE WHEN kind = 3 THEN list_append(shown, NULL) ELSE shown END WHEN sums THEN nums[:len(nums) - 1] WHEN len(nums) >= 2 THEN nums ELSE [] END AS raw, CASE WHEN bare AND sums THEN nums[-1] ELSE cy END AS st FROM d),
f AS (SELECT *, len(raw) AS m, len(list_filter(raw, lambda x: x IS NOT NULL)) AS p, coalesce(list_sum(raw), 0)::BIGINT AS tot FROM e),
g AS (SELECT *, CASE WHEN kind = 5 THEN 'blinking' WHEN p = 0 THEN 'unknown' ELSE 'timed' END AS mode, st - tot AS mis FROM f),
x AS (SELECT *, coalesce(mode = 'timed' AND p = m - 1 AND mis BETWEEN 3 AND 200, FALSE) AS one, mode = 'timed' AND st IS NOT NULL AND p = m AS full_, mode = 'timed' AND st IS NULL AND p = m AND p >= 2 AS su FROM g),
y AS (SELECT *, CASE WHEN one THEN list_transform(raw, lambda z: coalesce(z, mis)) ELSE raw END AS ph, CASE WHEN su THEN tot ELSE st END AS cyc, CASE WHEN full_ THEN abs(mis) <= 3 WHEN one OR su THEN TRUE END AS cons, (NOT bare AND q % 7 = 0) AS stray, (r - 1) // 4 AS day FROM x),
s AS (SELECT kk, count(*) AS n_rows, count(*) FILTER (mode = 'timed') AS t, count(*) FILTER (mode = 'timed' AND cons) AS ok, count(*) FILTER (NOT stray) AS u, max(day) AS days FROM y GROUP BY kk)
SELECT doc, (h + 1)::INT AS panel, 'P' || kk || ' MARKET' AS name, ['fixed', 'vehicle_actuated', 'adaptive'][kk % 3 + 1] AS hint,
round(0.0::DOUBLE + 0.15::DOUBLE * CASE WHEN kk % 2 = 0 THEN 1 ELSE 0.6::DOUBLE END + 0.2::DOUBLE * (NOT bare)::INT + 0.15::DOUBLE * (t > 0)::INT + 0.25::DOUBLE * coalesce(ok / nullif(t, 0)::DOUBLE, 0) + 0.1::DOUBLE * (u / n_rows::DOUBLE) + 0.1::DOUBLE * (days = 0 OR days = 1 AND kk % 4 = 0)::INT + 0.05::DOUBLE * (kk % 3 <> 2)::INT, 9) AS confidence,
day::INT AS day, CASE WHEN day = 0 THEN 'weekday_default' WHEN day = 1 AND kk % 4 = 0 THEN 'sunday' ELSE 'unlabelled_group' END AS day_type, TRUE AS windows_ordered, ((r - 1) % 4)::INT AS i,
printf('%02d:00', 6 + 2 * ((r - 1) % 4)) AS start, printf('%02d:00', 8 + 2 * ((r - 1) % 4)) AS until, mode, array_to_string(list_transform(ph, lambda z: coalesce(z::VARCHAR, '?')), ',') AS phases,
array_to_string(list_transform(ph, lambda z, i: CASE WHEN NOT bare AND i = 1 AND q % 4 = 0 THEN (v[1] + 5)::VARCHAR ELSE '?' END), ',') AS alternates, cyc AS cycle_s,
CASE WHEN full_ OR one THEN 'stated_in_row' WHEN su THEN 'sum_of_phases' END AS cycle_source, cons AS consistent, CASE WHEN mode = 'timed' AND NOT bare THEN CASE kk % 3 WHEN 0 THEN ph[n] WHEN 1 THEN ph[1] END END AS walk_s,
CASE WHEN kind = 5 THEN 'BLINKING' ELSE '' END AS labels, CASE WHEN stray THEN '99' ELSE '' END AS unassigned,
concat_ws(',', CASE WHEN full_ AND abs(mis) > 3 THEN printf('cycle_mismatch_%+ds', mis) END, CASE WHEN one THEN 'one_phase_inferred_from_cycle' END, CASE WHEN mode = 'timed' AND NOT (full_ OR one OR su) THEN 'incomplete_row' END, CASE WHEN mode = 'timed' AND cyc NOT BETWEEN 30 AND 400 THEN 'cycle_out_of_range' END, CASE WHEN mode = 'timed' AND len(list_filter(ph, lambda z: z > 200)) > 0 THEN 'phase_over_200s' END, CASE WHEN stray THEN 'unassigned_numbers' END) AS flags
FROM y JOIN s USING (kk)""",
    "timing_table": """WITH nb AS (SELECT DISTINCT l_orderkey AS panel, l_linenumber % 2 AS row, (l_partkey % 5 * 40 + l_suppkey % 30)::DOUBLE AS nx, trunc(l_quantity * 5)::BIGINT AS value FROM lineitem),
cl AS (SELECT o_orderkey AS panel, p AS phase, p * 40.0::DOUBLE + 15 AS x FROM orders, range(0, 3) r(p) WHERE p <= o_orderkey % 2 + 1),
nr AS (SELECT nb.*, min({'d': abs(x - nx), 'p': phase}) AS m, CASE WHEN nb.panel % 3 <> 0 THEN abs(150 - nx) END AS c FROM nb JOIN cl USING (panel) GROUP BY ALL),
pk AS (SELECT *, CASE WHEN coalesce(c <= 22 AND c < m.d, FALSE) THEN 'cycle' WHEN m.d <= 22 THEN 'phase' ELSE 'none' END AS k FROM nr),
pl AS (SELECT *, CASE WHEN k = 'phase' AND row_number() OVER (PARTITION BY panel, row, k, m.p ORDER BY nx, value) > 1 THEN 'none' ELSE k END AS place FROM pk),
sm AS (SELECT panel, row, max(value) FILTER (place = 'phase' AND m.p = 0) AS p0, max(value) FILTER (place = 'phase' AND m.p = 1) AS p1, max(value) FILTER (place = 'phase' AND m.p = 2) AS p2, arg_max(value, (nx, value)) FILTER (place = 'cycle') AS cy, count(*) FILTER (place = 'none') AS un FROM pl GROUP BY ALL),
r0 AS (SELECT o_orderkey AS panel, w AS row, o_orderkey % 11 = 0 AS blink, o_orderkey % 2 + 2 AS n, CASE WHEN o_orderkey % 2 = 1 THEN [p0, p1, p2] ELSE [p0, p1] END AS raw, cy, coalesce(un, 0) AS un FROM (SELECT * FROM orders, range(0, 2) t(w)) LEFT JOIN sm ON sm.panel = o_orderkey AND sm.row = w),
r1 AS (SELECT *, len(list_filter(raw, lambda x: x IS NOT NULL)) AS p, coalesce(list_sum(raw), 0)::BIGINT AS tot FROM r0),
r2 AS (SELECT *, CASE WHEN blink THEN 'blinking' WHEN p = 0 THEN 'unknown' ELSE 'timed' END AS mode, cy - tot AS mis FROM r1),
r3 AS (SELECT *, mode = 'timed' AS t, coalesce(mode = 'timed' AND p = n - 1 AND mis BETWEEN 3 AND 200, FALSE) AS one, mode = 'timed' AND cy IS NOT NULL AND p = n AS st, mode = 'timed' AND cy IS NULL AND p = n AND p >= 2 AS su FROM r2),
r4 AS (SELECT *, CASE WHEN one THEN list_transform(raw, lambda x: coalesce(x, mis)) ELSE raw END AS ph, CASE WHEN su THEN tot ELSE cy END AS cyc FROM r3)
SELECT panel, row::INT AS row, mode, array_to_string(list_transform(ph, lambda x: coalesce(x::VARCHAR, '?')), ',') AS phases, cyc AS cycle_s, CASE WHEN st OR one THEN 'stated_in_row' WHEN su THEN 'sum_of_phases' END AS cycle_source, CASE WHEN st THEN abs(mis) <= 3 WHEN one OR su THEN TRUE END AS consistent, un AS unassigned,
concat_ws(',', CASE WHEN st AND abs(mis) > 3 THEN printf('cycle_mismatch_%+ds', mis) END, CASE WHEN one THEN 'one_phase_inferred_from_cycle' END, CASE WHEN t AND NOT (st OR one OR su) THEN 'incomplete_row' END, CASE WHEN t AND cyc NOT BETWEEN 30 AND 400 THEN 'cycle_out_of_range' END, CASE WHEN t AND len(list_filter(ph, lambda x: x > 200)) > 0 THEN 'phase_over_200s' END, CASE WHEN un > 0 THEN 'unassigned_numbers' END) AS flags FROM r4""",
}
