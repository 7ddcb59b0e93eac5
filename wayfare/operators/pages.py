"""Pages of positioned words read into timing plans: from words to panels, phases, rows and days.

words: doc, text, x0, x1, top, size; labels: doc, top, x, text, the whole texts of a page. What a page holds is bounded, so
its words are gathered once and read where they lie, as arrays of lines; only rows, some of their numbers and what the panel
says of itself are dealt anew, by panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions import text
from wayfare.operators import layout
from wayfare.scratch import write_table

#: What a time, a number (with its alternate), a road descriptor and a landmark label look like.
TIME, NUMBER = r"^\d{1,2}:\d{2}$", r"^(\d{1,3})(?:\((\d{1,3})\))?$"
DESCRIPTOR, LANDMARK = r"\b[A-Z][A-Z. ]+ X [A-Z]", r"^(?:FROM|TWDS)\s+\S"
#: Fixed distances: headings of one line, words of one row, a number left of its times, the table below a heading without rows.
HEADING, ROW, LEFT, TABLE = 6.0, 4.5, 1.0, 130.0


def _centre(word: Column) -> Column:
    return (word["x0"] + word["x1"]) / 2


# a text is matched only where a cheap look at it leaves the match open
def _digit(word: Column, pattern: str) -> Column:
    return (F.length(word["text"]) <= 3) & word["text"].rlike(pattern)


def _is_time(word: Column) -> Column:
    return F.contains(word["text"], F.lit(":")) & word["text"].rlike(TIME)


def _names_day(word: Column) -> Column:
    return (F.length(word["text"]) >= 6) & word["text"].rlike(layout.DAYS)


def _line(span: Column) -> Column:
    return F.slice("ws", span["at"], span["n"])


def _lines(spans: Column) -> Column:
    """The words of some lines that follow each other."""
    first, last = F.get(spans, F.lit(0)), F.try_element_at(spans, F.lit(-1))
    return F.when(F.size(spans) > 0, F.slice("ws", first["at"], last["at"] + last["n"] - first["at"]))


def columns(panels: DataFrame) -> DataFrame:
    """panels (ws, spans: their lines as of `layout.line_spans`) with htop, road, phases and cycle_x.

    htop, road (x0, x1 of ROAD or null): of the first line with ROAD or FROM and a digit; phases: array<struct(phase, x)> in the order
    of the digits; cycle_x: the last CYCLE. Digits may stand on a neighbouring line; of equal ones the leftmost counts.
    """
    said = lambda span: F.slice("_texts", span["at"], span["n"])
    is_road = lambda span: F.arrays_overlap(said(span), F.array(F.lit("ROAD"), F.lit("FROM")))
    got = layout.once(panels, _texts=F.col("ws.text"))
    heading = F.get(F.filter("spans", lambda span: is_road(span) & F.exists(_line(span), lambda w: _digit(w, "^[0-9]$"))), F.lit(0))
    # the last CYCLE of a panel, and the first of its line
    cycle = F.try_element_at(F.filter("spans", lambda span: F.array_contains(said(span), "CYCLE")), F.lit(-1))
    got = layout.once(got, _h=heading, _c=F.when(F.array_contains("_texts", "CYCLE"), cycle)).drop("_texts")
    near = F.filter("spans", lambda span: F.abs(span["ltop"] - F.col("_h.ltop")) <= HEADING)
    digits = F.transform(layout.held(near, lambda spans: F.filter(_lines(spans), lambda w: _digit(w, "^[1-9]$"))), lambda w: F.struct(w["text"].cast("int").alias("digit"), w["x0"].alias("x0"), _centre(w).alias("x")))
    got = layout.once(got, _d=F.sort_array(digits))
    first = F.filter("_d", lambda z, i: (i == 0) | (F.get("_d", i - 1)["digit"] != z["digit"]))
    phases = F.coalesce(F.transform(first, lambda z, i: F.struct(i.alias("phase"), z["x"].alias("x"))), F.array().cast("array<struct<phase:int,x:double>>"))
    road = F.array_min(F.transform(F.filter(_line(F.col("_h")), lambda w: w["text"] == "ROAD"), lambda w: F.struct(w["top"].alias("top"), w["x0"].alias("x0"), w["x1"].alias("x1"))))
    mark = F.get(F.filter(_line(F.col("_c")), lambda w: w["text"] == "CYCLE"), F.lit(0))
    return layout.once(got, htop=F.col("_h.ltop"), road=road, phases=phases, cycle_x=_centre(mark)).drop("_h", "_c", "_d")


def row_lines(panels: DataFrame) -> DataFrame:
    """panels (ws, spans) with rows, array<struct(row, top, start, end, t_x1, at, n)>: lines with two times, and where the words of
    lines within ROW of each stand in ws."""
    timed = F.filter(F.transform("spans", lambda span, i: F.struct(i.alias("row"), span["ltop"].alias("top"), span["at"].alias("at"), span["n"].alias("n"))), lambda r: F.size(F.filter(_line(r), _is_time)) >= 2)
    times = lambda r: F.sort_array(F.transform(F.filter(_line(r), _is_time), lambda w: F.struct(w["x0"].alias("x0"), w["top"].alias("top"), w["text"].alias("text"), w["x1"].alias("x1"))))
    near = lambda r: F.filter("spans", lambda span: F.abs(span["ltop"] - r["top"]) <= ROW)
    got = layout.once(panels, _timed=timed)
    got = layout.once(got, _rows=F.transform("_timed", lambda r: F.struct(r["row"].alias("row"), r["top"].alias("top"), times(r).alias("t"), near(r).alias("near")))).drop("_timed")
    at = lambda r, i: F.get(r["t"], F.lit(i))
    padded = lambda r, i: F.lpad(at(r, i)["text"], 5, "0")
    first, last = (lambda r: F.get(r["near"], F.lit(0))), (lambda r: F.try_element_at(r["near"], F.lit(-1)))
    every = F.transform("_rows", lambda r: F.struct(
        r["row"].alias("row"), r["top"].alias("top"), padded(r, 0).alias("start"), padded(r, 1).alias("end"), F.greatest(at(r, 0)["x1"], at(r, 1)["x1"]).alias("t_x1"),
        first(r)["at"].alias("at"), (last(r)["at"] + last(r)["n"] - first(r)["at"]).alias("n"),
    ))
    return layout.once(got, rows=every).drop("_rows")


def rows(panels: DataFrame) -> DataFrame:
    """Timing rows of panels (panel, ws, phases, cycle_x, walk, rows as of `row_lines`): panel, walk, row, top, start, end, mode, phases,
    alternates, cycle_s, cycle_source, consistent, labels, unassigned, flags, raw.

    A number goes to the nearer of the CYCLE column and the nearest phase column, within reach. Without phase columns numbers are
    read in order: phases and then their sum, or phases alone.
    """
    each = panels.select("panel", "walk", F.col("phases.x").alias("columns"), "cycle_x", "ws", F.inline("rows"))
    each = each.select("panel", "walk", "columns", "cycle_x", "row", "top", "start", "end", "t_x1", F.slice("ws", F.col("at"), F.col("n")).alias("_near"))
    each = layout.once(each, near=F.sort_array(F.transform("_near", lambda w: F.struct(w["x0"].alias("x0"), w["top"].alias("top"), w["x1"].alias("x1"), w["text"].alias("text"))))).drop("_near")
    about = ("panel", "walk", "row", "top", "start", "end")
    number = lambda w: w["text"].rlike(NUMBER)
    part = lambda w, i: F.nullif(F.regexp_extract(w["text"], NUMBER, i), F.lit("")).cast("long")
    counted = F.transform(F.filter("near", lambda w: (w["x0"] >= F.col("t_x1") - LEFT) & number(w)), lambda w: F.struct(part(w, 1).alias("value"), part(w, 2).alias("alternate"), _centre(w).alias("x")))
    tokens = F.sort_array(F.array_distinct(F.transform(F.filter("near", lambda w: ~_is_time(w) & ~number(w)), lambda w: F.upper(w["text"]))))
    got = layout.once(each, numbers=counted, tokens=tokens, words=F.array_join(F.col("near.text"), " ")).drop("near", "t_x1")
    off = lambda z: F.abs(F.col("cycle_x") - z["x"])
    apart = lambda z: F.transform("columns", lambda x: F.abs(x - z["x"]))
    got = layout.once(got, apart=F.transform("numbers", lambda z: F.struct(off(z).alias("off"), apart(z).alias("each"))))
    d = lambda a: F.array_min(a["each"])
    by_cycle = lambda a: F.coalesce((a["off"] <= layout.COLUMN_REACH) & ((a["off"] < d(a)) | d(a).isNull()), F.lit(False))
    nearest = lambda a: (F.array_position(a["each"], d(a)) - 1).cast("int")
    got = layout.once(
        got, places=F.transform("apart", lambda a: F.when(by_cycle(a), -1).when(d(a) <= layout.COLUMN_REACH, nearest(a))), values=F.col("numbers.value"), others=F.col("numbers.alternate"), n_columns=F.size("columns"),
        labels=F.filter("tokens", lambda t: ~t.isin("TIMINGS", "DATA")), blinking=F.exists("tokens", lambda t: F.contains(t, F.lit("BLINK"))),
    ).select(*about, "words", "places", "values", "others", "n_columns", "labels", "blinking")
    first = lambda i: (F.array_position("places", i) - 1).cast("int")
    by_column = lambda of: F.transform(F.sequence(F.lit(0), F.col("n_columns") - 1), lambda i: F.get(of, first(i)))
    values, n = F.col("values"), F.size("values")
    total = F.try_element_at(values, F.lit(-1))
    summed = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x) - total
    none = F.array().cast("array<bigint>")
    bare = F.col("n_columns") == 0
    as_sum = bare & (n >= 3) & (total >= layout.CYCLE_BOUNDS[0]) & (F.abs(summed - total) <= layout.SLACK)
    stated = F.get(values, F.size("places") - F.nullif(F.array_position(F.reverse("places"), -1), F.lit(0)).cast("int"))
    spare = F.filter("values", lambda z, i: F.get("places", i).isNull() | ((F.get("places", i) >= 0) & (first(F.get("places", i)) < i)))
    got = layout.once(got, as_sum=as_sum)
    in_order = F.when(F.col("as_sum"), F.slice(values, 1, F.greatest(n - 1, F.lit(0)))).when(n >= 2, values).otherwise(none)
    got = layout.once(
        got, raw=F.when(bare, in_order).otherwise(by_column("values")), alternates=F.when(bare, F.transform(in_order, lambda x: F.lit(None).cast("long"))).otherwise(by_column("others")),
        stated=F.when(F.col("as_sum"), total).otherwise(stated), spare=F.when(bare, none).otherwise(spare),
    ).select(*about, "blinking", "labels", "words", "raw", "alternates", "stated", "spare")
    read = layout.read_rows(got.withColumn("n", F.size("raw")).withColumn("unassigned", F.size("spare")))
    return read.select("panel", "walk", "row", "top", "start", "end", "mode", "phases", "alternates", "cycle_s", "cycle_source", "consistent", "labels", F.col("spare").alias("unassigned"), "flags", F.col("words").alias("raw"))


def walkers(panels: DataFrame) -> DataFrame:
    """panels (ws, htop, phases, first_row) with walk, the pedestrians' phase: beside an EXCLUSIVE label or, on panels without one,
    under letters stacked between heading and rows."""
    between = lambda w: (w["top"] > F.col("htop")) & (w["top"] < F.coalesce("first_row", F.col("htop") + TABLE))
    some = F.contains(F.upper(F.array_join(F.col("ws.text"), " ")), F.lit("EXCLUSIVE"))
    said = F.when(some, F.filter("ws", lambda w: (F.length(w["text"]) >= 9) & F.upper(w["text"]).startswith("EXCLUSIVE")))
    got = layout.once(panels, _said=F.coalesce(said, F.slice("ws", 1, 0)))
    stacked = (F.size("_said") == 0) & (F.size("phases") > 0) & (F.array_min(F.col("ws.size")) <= layout.TINY)
    got = layout.once(got, _tiny=F.coalesce(F.when(stacked, F.filter("ws", lambda w: layout.is_tiny(w) & between(w))), F.slice("ws", 1, 0)))
    walk = F.when(F.size("_said") > 0, layout.beside_label(F.col("_said"), F.col("phases"))).otherwise(layout.under_upright(F.col("_tiny"), F.col("phases")))
    return layout.once(got, walk=walk).drop("_said", "_tiny")


def _panels(pages: DataFrame, height: float) -> DataFrame:
    """pages (doc, ws, said, heads) parted into panels half-way between two headers, or at mid-page where there are more: panel (doc, k),
    header, clean_label, descriptor, approach_landmarks, dated (texts that name days), ws, what `columns` and `row_lines` read, first_row
    and walk (the pedestrians' phase)."""
    first = F.get("heads", F.lit(0))
    n = first["n"]
    mid = (first["top"] + F.get("heads", F.lit(1))["top"]) / 2
    cut = F.when(n == 1, height).when(n == 2, mid).otherwise(height / 2)
    page = layout.once(pages, _cut=F.greatest(F.coalesce(cut, F.lit(0.0)), F.lit(0.0))).select("doc", "ws", "said", "_cut", F.inline("heads"))
    upper = F.col("k") == 1
    page = layout.once(page, _from=F.when(upper, 0.0).otherwise(F.col("_cut")), _to=F.when(upper, F.least("_cut", F.lit(height))).otherwise(height))
    own = lambda x: (x["top"] >= F.col("_from")) & (x["top"] < F.col("_to"))
    got = page.select(F.struct("doc", "k").alias("panel"), "header", "clean_label", F.filter("ws", own).alias("ws"), F.filter("said", own).alias("said"))
    got = row_lines(columns(got.withColumn("spans", layout.line_spans(F.col("ws"))))).drop("spans")
    got = walkers(layout.once(got, first_row=F.get("rows", F.lit(0))["top"]))
    dated = lambda words, ok: F.transform(F.filter(words, ok), lambda x: F.struct(x["top"].alias("top"), x["text"].alias("text")))
    none = F.array().cast("array<struct<top:double,text:string>>")
    descriptor = F.array_min(F.filter("said", lambda x: x["text"].rlike(DESCRIPTOR) & ~F.contains(x["text"], F.lit("POLICE"))))["text"]
    landmarks = F.transform(F.filter("said", lambda x: x["text"].rlike(LANDMARK)), lambda x: F.trim(F.regexp_replace(x["text"], r"^(?:FROM|TWDS)\s*", "")))
    return got.select(
        "panel", "header", "clean_label", descriptor.alias("descriptor"), F.when(F.size("said") > 0, F.sort_array(F.array_distinct(landmarks))).alias("approach_landmarks"),
        F.concat(F.when(F.array_join(F.col("ws.text"), " ").rlike(layout.DAYS), dated(F.col("ws"), _names_day)).otherwise(none), dated(F.col("said"), lambda x: _names_day(x) & ~x["text"].rlike(r"\d{2}:\d{2}"))).alias("dated"),
        "ws", "htop", "road", "phases", "cycle_x", "rows", "first_row", "walk",
    )


def approaches(panels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, moves) of the movement matrix: panel, letter, top, ord, landmark; and panel, letter, ord, phase, movement.

    panels: panel, ws, road, phases, htop, first_row. The words between heading and rows are read.
    """
    some = panels.filter("road IS NOT NULL AND size(phases) > 0")
    table = F.filter("ws", lambda w: (w["top"] > F.col("htop") + 4) & (w["top"] < F.coalesce(F.col("first_row") - 4, F.col("htop") + TABLE)))
    bound = some.select("panel", F.col("road.x1").alias("road_x1"), ((F.col("road.x0") + F.col("road.x1")) / 2).alias("road_x"), F.array_min(F.col("phases.x")).alias("first_x"), F.coalesce(F.col("first_row") - 4, F.col("htop") + TABLE).alias("y1"), table.alias("table"))
    region = bound.select("panel", "road_x1", "road_x", "first_x", "y1", F.inline("table"))
    phases = some.select("panel", F.inline("phases"))
    letters = region.filter(F.col("text").rlike("^[A-H]$") & (F.col("size") >= 6.0) & (F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("road_x")) <= 20)).select("panel", F.col("text").alias("letter"), "top", "y1", (F.col("road_x1") - 2).alias("left"), (F.col("first_x") - layout.BAND).alias("right"))
    letters = layout.bands(letters, F.col("y1")).withColumn("ord", F.row_number().over(Window.partitionBy("panel").orderBy("top")))
    named = letters.join(layout.landmarks(region, letters), ["panel", "letter", "top"]).select("panel", "letter", "top", "ord", "landmark")
    moves = layout.movements(region, phases, letters.withColumn("letter", F.struct("letter", "ord"))).select("panel", "letter.letter", "letter.ord", "phase", "movement")
    return named, moves


def read_panels(words: DataFrame, labels: DataFrame, height: float = 792.0, digits: int = 3) -> DataFrame:
    """The panels of pages given as words and labels, as `read_pages` has them."""
    return read_pages(layout.gathered(words, labels), height, digits)


def read_pages(pages: DataFrame, height: float = 792.0, digits: int = 3) -> DataFrame:
    """One row a panel: doc, k, header, descriptor, approach_landmarks, phase_count, pedestrian_phase, phase_labels,
    approach_rows, matrix_confidence, day_plans (day_type, windows, windows_ordered), row_count, parse_confidence.

    pages: doc, ws: array<struct(top, x0, x1, text, size)>, said: array<struct(top, x, text)>, a row a page. Pages without a header
    give no rows. Words printed twice over are read once. The movement matrix is read where its columns are asked for.
    """
    doubled = F.exists(F.col("ws.text"), text.is_doubled)
    plain = F.transform("ws", lambda w: F.struct(w["top"].alias("top"), w["x0"].alias("x0"), w["x1"].alias("x1"), text.undoubled(w["text"]).alias("text"), w["size"].alias("size")))
    heads = layout.page_headers(pages.select("doc", F.sort_array(F.when(doubled, plain).otherwise(F.col("ws"))).alias("ws"), "said"))
    panels = write_table(_panels(heads.filter("size(heads) > 0"), height), "page-panels")

    # days
    rowed = layout.day_groups(rows(panels))
    window = F.struct("top", "start", "end", "mode", "phases", "alternates", "cycle_s", "cycle_source", "consistent", F.when(F.col("mode") == "timed", F.get("phases", F.col("walk"))).alias("pedestrian_phase_s"), "labels", "flags", "unassigned", "raw")
    by_day = rowed.groupBy("panel", "day").agg(
        F.sort_array(F.collect_list(window)).alias("windows"), (F.min("top") - 8).alias("lo"), (F.max("top") + 8).alias("hi"), F.array_join(F.flatten(F.collect_list("labels")), " ").alias("inline"), *layout.row_counts(F.size("unassigned"))
    )
    plans = by_day.groupBy("panel").agg(F.sort_array(F.collect_list(F.struct("day", "windows", "lo", "hi", "inline"))).alias("days"), *[F.sum(c).alias(c) for c in "ntcu"])
    about = panels.select("panel", "header", "clean_label", "descriptor", "approach_landmarks", F.size("phases").alias("phase_count"), F.col("walk").alias("pedestrian_phase"), "dated")
    told = about.join(plans, "panel", "left")
    near = lambda d: F.array_join(F.transform(F.filter("dated", lambda x: x["top"].between(d["lo"], d["hi"])), lambda x: x["text"]), " ")
    told = layout.once(told, _said=F.transform("days", lambda d: F.concat_ws(" ", d["inline"], near(d))))
    day_plan = lambda d, i: F.struct(d["day"].alias("day"), layout.day_type(F.get("_said", i), d["day"]).alias("day_type"), F.transform(d["windows"], lambda x: x.dropFields("top")).alias("windows"), layout.in_order(d["windows"]).alias("windows_ordered"))
    told = layout.once(told, day_plans=F.transform("days", day_plan))
    told = told.withColumn("l", F.forall("day_plans", lambda d: d["day_type"] != "unlabelled_group")).withColumn("parse_confidence", layout.confidence(digits)).withColumn("row_count", F.coalesce("n", F.lit(0)))

    # the movement matrix
    named, moves = approaches(panels)
    marks = panels.select("panel", "walk", F.inline("phases")).select("panel", "phase", F.coalesce(F.col("phase") == F.col("walk"), F.lit(False)).alias("pedestrian"))
    labelled = layout.phase_labels(moves, marks).groupBy("panel").agg(F.transform(F.sort_array(F.collect_list(F.struct("phase", "label"))), lambda x: x["label"]).alias("phase_labels"))
    ways = moves.groupBy("panel", "letter", "ord", "phase").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.instr(F.lit("LSRU"), F.col("movement")), "movement"))), lambda x: x["movement"]).alias("moves"))
    ways = ways.groupBy("panel", "letter", "ord").agg(F.sort_array(F.collect_list(F.struct("phase", "moves"))).alias("movements"))
    matrix = named.join(ways, ["panel", "letter", "ord"], "left").withColumn("movements", F.coalesce("movements", F.array().cast("array<struct<phase:int,moves:array<string>>>")))
    trust = layout.matrix_confidence(matrix.select("panel", "letter", "landmark", F.size("movements").alias("moves"))).withColumnRenamed("confidence", "matrix_confidence")
    listed = matrix.groupBy("panel").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "letter", "landmark", "movements"))), lambda x: x.dropFields("ord")).alias("approach_rows"))
    out = told
    for side in (labelled, listed, trust):
        out = out.join(side, "panel", "left")
    return out.select(
        "panel.doc", "panel.k", "header", "clean_label", "descriptor", "approach_landmarks", "phase_count", "pedestrian_phase", "phase_labels", "approach_rows",
        F.coalesce("matrix_confidence", F.lit(0.0)).alias("matrix_confidence"), "day_plans", "row_count", "parse_confidence",
    )
