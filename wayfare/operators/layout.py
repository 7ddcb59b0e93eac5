"""Tables read from positioned words: headers, lines, row bands, day groups, labels and how sure the reading is.

words: doc, text, x0, x1, top, size. rows: panel, top, start, end, mode, consistent, unassigned.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed patterns and values: a header, what its control word means, and words that name a day.
HEADER = r"(?i)^(.+?)\s*,\s*(.+?)\s*POLICE\s*STATION\s*-?\s*([A-Z ./]*)$"
CONTROL = {"FIXED": "fixed", "VAC": "vehicle_actuated", "VA": "vehicle_actuated", "ATCS": "adaptive", "SEMI VAC": "vehicle_actuated", "SYNC": "fixed_coordinated"}
DAYS = r"(?i)SUNDAY|SATURDAY|WEEKDAY|HOLIDAY"
WEIGHTS = {"header_parsed": 0.15, "phase_columns_detected": 0.2, "timed_rows_present": 0.15, "rows_consistent": 0.25, "rows_without_unassigned_numbers": 0.1, "day_groups_labelled": 0.1, "road_descriptor_found": 0.05}
BAND, TINY = 22.0, 5.6


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def header(text: Column) -> Column:
    """struct(name, station, control, hint) of a header line, or null."""
    strip = lambda c: F.regexp_replace(c, r"^[ ,-]+|[ ,-]+$", "")
    table = F.create_map(*[F.lit(x) for kv in CONTROL.items() for x in kv])

    def said(name: Column, station: Column, control: Column) -> Column:
        hint = F.coalesce(F.try_element_at(table, control), F.when(control == "UNSPECIFIED", "unknown").otherwise(F.lower(control)))
        return F.struct(strip(F.regexp_replace(strip(name), r"(?i)\s*(?:JUNCTION|JUCTION)\s*$", "")).alias("name"), F.trim(station).alias("station"), control.alias("control"), hint.alias("hint"))

    def read(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, HEADER, i)
        control = held(F.upper(F.trim(part(3))), lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("UNSPECIFIED")))
        return F.when(t.rlike(HEADER), held(control, lambda c: said(part(1), part(2), c)))

    return held(F.trim(F.regexp_replace(text, r"\s+", " ")), read)


def _line_spans(tolerance: float):
    """array<struct(ltop, at, n)> of arrays over the tops of a page's words in order: each line's mean, where it begins (from 1) and its words."""

    def fold(tops: pa.Array) -> pa.Array:
        flat, lengths = tops.flatten().to_numpy(zero_copy_only=False).tolist(), tops.value_lengths().to_pylist()
        means, starts, sizes, ends, done = [], [], [], [0], 0
        for size in lengths:
            first, mean, n, total = 1, 0.0, 0, 0.0
            for top in flat[done : done + size]:
                if n and abs(mean - top) <= tolerance:
                    mean, n, total = (mean * n + top) / (n + 1), n + 1, total + top
                    continue
                if n:
                    means.append(total / n)
                    starts.append(first)
                    sizes.append(n)
                first, mean, n, total = first + n, top, 1, top
            if n:
                means.append(total / n)
                starts.append(first)
                sizes.append(n)
            done += size
            ends.append(len(means))
        parts = [pa.array(means, pa.float64(), from_pandas=True), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["ltop", "at", "n"]))

    return F.arrow_udf(fold, "array<struct<ltop:double,at:int,n:int>>")


def line_spans(ws: Column, tolerance: float = 3.5) -> Column:
    """array<struct(ltop, at, n)>: the lines of a page's words, which come in order of their tops; one ordered fold.

    From the top, a word joins the line before it when it stands within the tolerance of that line's mean (ltop), which moves
    with each word. A line is `slice(ws, at, n)`.
    """
    return _line_spans(tolerance)(ws["top"].cast("array<double>"))


def once(rows: DataFrame, /, **columns: Column) -> DataFrame:
    """rows with columns that are worked out once a row, however often and wherever they are used."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def lines(words: DataFrame, tolerance: float = 3.5) -> DataFrame:
    """words with `line` (from 0 at the top of a page) and `ltop`, its mean, as `line_spans` has them."""
    page = words.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("top", "x0", "x1", "text", "size"))).alias("ws"))
    each = page.withColumn("ls", line_spans(F.col("ws"), tolerance)).select("doc", "ws", F.posexplode("ls").alias("line", "l"))
    return each.select("doc", "line", F.col("l.ltop").alias("ltop"), F.inline(F.slice("ws", F.col("l.at"), F.col("l.n")))).select("doc", "top", "x0", "x1", "text", "size", "line", "ltop")


def _texts(ws: Column, spans: Column) -> Column:
    """array<struct(top, text)>: the words of each line from left to right."""

    def said(line: Column) -> Column:
        return F.transform(F.sort_array(F.transform(F.slice(ws, line["at"], line["n"]), lambda w: F.struct(w["x0"], w["text"].alias("text")))), lambda w: w["text"])

    return F.transform(spans, lambda line: F.struct(line["ltop"].alias("top"), F.array_join(said(line), " ").alias("text")))


def page_headers(pages: DataFrame, least_size: float = 8.5, reach: float = 14.0) -> DataFrame:
    """pages (doc, ws in order of tops, said: the whole texts of a page) with `heads`, array<struct(k, top, header, n, clean_label)>.

    Heads are large lines that read as a header, from the top; of more than two the first and the last. The first whole text that
    names a police station within reach of the line is read in its place.
    """
    big = once(pages, _big=F.filter("ws", lambda w: w["size"] >= least_size))
    big = once(big.withColumn("_spans", line_spans(F.col("_big"), 4.0)), _clean=F.filter("said", lambda x: x["text"].rlike(r"(?i)POLICE\s*STATION")))
    got = once(big, _lines=F.filter(_texts(F.col("_big"), F.col("_spans")), lambda t: t["text"].rlike("(?i)POLICE|STATION|JUNCTION")))
    near = lambda t: F.array_min(F.transform(F.filter("_clean", lambda x: F.abs(x["top"] - t["top"]) < reach), lambda x: F.struct(x["top"], x["x"], x["text"].alias("text"))))["text"]
    got = once(got, _named=F.transform("_lines", lambda t: F.struct(t["top"].alias("top"), t["text"].alias("text"), near(t).alias("clean"))))
    got = once(got, _found=F.filter(F.transform("_named", lambda t: F.struct(t["top"].alias("top"), header(F.coalesce(t["clean"], t["text"])).alias("header"), t["clean"].isNotNull().alias("clean_label"))), lambda t: t["header"].isNotNull()))
    n = F.size("_found")
    kept = F.filter(F.transform("_found", lambda t, i: F.struct((F.when(i == 0, 1).otherwise(2)).alias("k"), t["top"].alias("top"), t["header"].alias("header"), n.alias("n"), t["clean_label"].alias("clean_label"))), lambda t, i: (i == 0) | (i == n - 1))
    return once(got, heads=kept).drop("_big", "_spans", "_clean", "_lines", "_named", "_found")


def gathered(words: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc, ws, said): the words of each page and its whole texts."""
    page = words.groupBy("doc").agg(F.collect_list(F.struct("top", "x0", "x1", "text", "size")).alias("ws"))
    none = F.array().cast("array<struct<top:double,x:double,text:string>>")
    if labels is None:
        return page.withColumn("said", none)
    whole = labels.groupBy("doc").agg(F.collect_list(F.struct("top", "x", "text")).alias("said"))
    return page.join(whole, "doc", "left").withColumn("said", F.coalesce("said", none))


def headers(words: DataFrame, least_size: float = 8.5, labels: DataFrame | None = None, reach: float = 14.0) -> DataFrame:
    """(doc, k, top, header, n, clean_label) of each page's headers, as `page_headers` has them; labels: doc, top, x, text."""
    pages = gathered(words.filter(F.col("size") >= least_size), labels).withColumn("ws", F.sort_array("ws"))
    return page_headers(pages, least_size, reach).select("doc", F.inline("heads")).select("doc", "k", "top", "header", "n", "clean_label")


def panels(words: DataFrame, height: float = 792.0, found: DataFrame | None = None) -> DataFrame:
    """words (or labels) with `panel` (1 or 2): split half-way between two headers, or at mid-page where there are more."""
    found = headers(words) if found is None else found
    cut = found.groupBy("doc").agg(F.max("n").alias("n"), F.avg("top").alias("mid"))
    at = F.when(F.col("n") == 1, height).when(F.col("n") == 2, F.col("mid")).otherwise(height / 2)
    placed = words.join(cut, "doc").withColumn("panel", F.when(F.col("top") < at, 1).otherwise(2))
    return placed.filter((F.col("top") >= 0) & (F.col("top") < height)).drop("n", "mid")


def bands(letters: DataFrame, end: Column | float, gap: float = 2.0) -> DataFrame:
    """letters (panel, top) with `until`: where the band of each row letter ends, before the next, BAND at most."""
    after = F.lead("top").over(Window.partitionBy("panel").orderBy("top"))
    last = end if isinstance(end, Column) else F.lit(float(end))
    return letters.withColumn("until", F.least(F.coalesce(after, last) - gap, F.col("top") + BAND))


def day_groups(rows: DataFrame) -> DataFrame:
    """rows with `day` (from 0): another day's plan begins where the clock goes back."""
    order = Window.partitionBy("panel").orderBy("top")
    each = order.orderBy("top", "start", "end")  # rows of one height always come in one order
    back = (F.col("start") < F.lag("end").over(each)) & (F.col("start") <= F.lag("start").over(each))
    return rows.withColumn("_new", F.coalesce(back, F.lit(False)).cast("int")).withColumn("day", F.sum("_new").over(order).cast("int")).drop("_new")


def day_type(label: Column, day: Column) -> Column:
    """What days a group's label names; the first group without one serves weekdays."""
    up = F.upper(F.coalesce(label, F.lit("")))
    has = lambda w: F.contains(up, F.lit(w))
    return (
        F.when(has("SUNDAY") & (has("WEEKDAY") | has("&")), "all_days").when(has("SUNDAY") & has("SATURDAY"), "weekend").when(has("SUNDAY"), "sunday").when(has("SATURDAY"), "saturday")
        .when(has("HOLIDAY"), "holiday").when(day == 0, "weekday_default").otherwise("unlabelled_group")
    )


def ordered(rows: DataFrame) -> DataFrame:
    """(panel, day, windows, windows_ordered): whether each window of a day ends before the next begins."""
    after = F.lead("start").over(Window.partitionBy("panel", "day").orderBy("top", "start", "end"))
    each = rows.withColumn("_ok", F.coalesce(F.col("end") <= after, F.lit(True)))
    return each.groupBy("panel", "day").agg(F.count("*").alias("windows"), F.min("_ok").alias("windows_ordered"))


def in_order(windows: Column) -> Column:
    """Whether each of a day's windows, in their order, ends before the next begins; `ordered` over one array."""
    late = F.transform(windows, lambda w, i: w["end"] > F.get(windows, i + 1)["start"])
    return ~F.exists(late, lambda x: F.coalesce(x, F.lit(False)))


def phase_labels(matrix: DataFrame, phases: DataFrame) -> DataFrame:
    """(panel, phase, label): the letters that move in each phase, and whether it is the pedestrians'.

    matrix: panel, letter, ord, phase, movement; phases: panel, phase, pedestrian.
    """
    moves = matrix.select("panel", "letter", "ord", "phase", "movement").distinct().groupBy("panel", "phase", "letter", "ord").agg(F.sort_array(F.collect_set(F.struct(F.instr(F.lit("LSRU"), F.col("movement")).alias("i"), "movement"))).alias("ms"))
    parts = moves.select("panel", "phase", "ord", F.concat(F.col("letter"), F.lit("·"), F.array_join(F.transform("ms", lambda m: m["movement"]), "")).alias("part"))
    joined = parts.groupBy("panel", "phase").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]).alias("parts"))
    all_ = phases.join(joined, ["panel", "phase"], "left")
    own = F.coalesce("parts", F.array().cast("array<string>"))
    full = F.concat(own, F.when(F.col("pedestrian"), F.array(F.lit("pedestrian (EXCLUSIVE)"))).otherwise(F.array().cast("array<string>")))
    return all_.select("panel", "phase", F.nullif(F.array_join(full, " + "), F.lit("")).alias("label"))


def matrix_confidence(letters: DataFrame) -> DataFrame:
    """(panel, confidence) of a movement matrix; letters: panel, letter, landmark, moves (how many phases it moves in)."""
    got = letters.groupBy("panel").agg(F.count("*").alias("n"), F.count_if(F.col("moves") > 0).alias("m"), F.min(F.coalesce(F.col("landmark") != "", F.lit(False))).alias("named"))
    full = F.round(0.5 * F.col("m") / F.col("n") + 0.3 * F.when(F.col("named"), 1.0).otherwise(0.5) + 0.2, 2)
    return got.select("panel", F.when(F.col("n") < 2, 0.3).otherwise(F.least(F.lit(1.0), full)).alias("confidence"))


def confidence(digits: int = 3) -> Column:
    """How much of a panel could be read without doubt, of its row counts (n, t timed, c consistent, u without stray numbers, l all
    days labelled) and of clean_label, phase_count and descriptor."""
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    part = {
        "header_parsed": F.when(F.coalesce("clean_label", F.lit(True)), 1.0).otherwise(0.6), "phase_columns_detected": (F.col("phase_count") >= 2).cast("double"), "timed_rows_present": F.coalesce((F.col("t") > 0).cast("double"), F.lit(0.0)),
        "rows_consistent": share(F.col("c"), F.col("t")), "rows_without_unassigned_numbers": share(F.col("u"), F.col("n")), "day_groups_labelled": F.coalesce(F.col("l").cast("double"), F.lit(0.0)),
        "road_descriptor_found": F.coalesce((F.col("descriptor") != "").cast("double"), F.lit(0.0)),
    }
    total = F.lit(0.0)
    for k, w in WEIGHTS.items():
        total = total + w * part[k]
    return F.round(total, digits)


def row_counts(unassigned: Column) -> list[Column]:
    """n, t, c and u of `confidence` over rows with mode and consistent."""
    timed = F.col("mode") == "timed"
    return [F.count("*").alias("n"), F.count_if(timed).alias("t"), F.count_if(timed & F.coalesce("consistent", F.lit(False))).alias("c"), F.count_if(F.coalesce(unassigned, F.lit(0)) == 0).alias("u")]


def parse_confidence(rows: DataFrame, about: DataFrame, digits: int = 3) -> DataFrame:
    """(panel, confidence): how much of a panel could be read without doubt.

    rows: panel, mode, consistent, unassigned, day_type; about: panel, clean_label, phase_count, descriptor.
    """
    sums = rows.groupBy("panel").agg(*row_counts(F.col("unassigned")), F.min(F.col("day_type") != "unlabelled_group").alias("l"))
    return about.join(sums, "panel", "left").select("panel", confidence(digits).alias("confidence"))


def beside_label(labels: Column, columns: Column, near: float = 40.0) -> Column:
    """The phase column beside an EXCLUSIVE label (array<struct(x0, x1, ...)>): the nearest centre, or the last column left of it."""
    nearest = lambda at: F.array_min(F.transform(columns, lambda c: F.struct(F.abs(c["x"] - at["x"]).alias("d"), c["phase"].alias("phase"))))
    left = lambda at: F.array_max(F.transform(F.filter(columns, lambda c: c["x"] < at["x0"]), lambda c: c["phase"]))
    place = lambda at: held(nearest(at), lambda m: F.when(m["d"] <= near, m["phase"]).otherwise(left(at)))
    a, b = F.array_min(labels["x0"]), F.array_max(labels["x1"])
    return F.when(F.size(labels) > 0, held(F.struct(a.alias("x0"), ((a + b) / 2).alias("x")), place))


def is_tiny(word: Column) -> Column:
    """Letters as small as those of a label set upright."""
    return (word["size"] <= TINY) & word["text"].rlike(r"^\p{L}{1,2}$")


def under_upright(tiny: Column, columns: Column, least: int = 6, span: float = 25.0, reach: float = 15.0) -> Column:
    """The phase column of a label set upright: small letters (array<struct(x0, top, ...)>) stacked at one x. Of several stacks the
    one of most letters counts, then the leftmost."""
    bin_ = lambda w: F.bround(w["x0"] / 6)
    stacks = F.transform(F.array_distinct(F.transform(tiny, bin_)), lambda b: F.struct(b.alias("bin"), F.filter(tiny, lambda w: bin_(w).eqNullSafe(b)).alias("ws")))
    tall = F.filter(stacks, lambda s: (F.size(s["ws"]) >= least) & (F.array_max(s["ws"]["top"]) - F.array_min(s["ws"]["top"]) >= span))
    at = lambda s: F.aggregate(s["ws"]["x0"].cast("array<double>"), F.lit(0.0), lambda t, x: t + x) / F.size(s["ws"])
    placed = F.transform(tall, lambda s: F.struct(F.size(s["ws"]).alias("n"), s["bin"].alias("bin"), at(s).alias("sx")))
    near = F.transform(placed, lambda s: F.struct(s["n"].alias("n"), (-s["bin"]).alias("bin"), F.array_min(F.transform(columns, lambda c: F.struct(F.abs(c["x"] - s["sx"]).alias("d"), c["phase"].alias("phase")))).alias("m")))
    best = F.array_max(F.transform(F.filter(near, lambda s: s["m"]["d"] <= reach), lambda s: F.struct(s["n"], s["bin"], s["m"]["phase"].alias("phase"))))
    return best["phase"]


def _across(columns: DataFrame) -> DataFrame:
    return columns.groupBy("panel").agg(F.collect_list(F.struct("phase", "x")).alias("columns"))


def pedestrian_phase(words: DataFrame, columns: DataFrame, near: float = 40.0) -> DataFrame:
    """(panel, phase) of panels with an EXCLUSIVE label, as `beside_label` has it; words: panel, text, x0, x1; columns: panel, phase, x."""
    label = words.filter(F.upper("text").startswith("EXCLUSIVE")).groupBy("panel").agg(F.collect_list(F.struct("x0", "x1")).alias("labels"))
    got = once(label.join(_across(columns), "panel"), phase=beside_label(F.col("labels"), F.col("columns"), near))
    return got.select("panel", "phase").filter("phase IS NOT NULL")


def rotated_pedestrian_phase(words: DataFrame, columns: DataFrame, least: int = 6, span: float = 25.0, reach: float = 15.0) -> DataFrame:
    """(panel, phase) of panels with a label set upright, as `under_upright` has it.

    words: panel, text, x0, top, size, between the heading and the first row; columns: panel, phase, x.
    """
    tiny = words.filter(is_tiny(F.struct("size", "text"))).groupBy("panel").agg(F.collect_list(F.struct("x0", "top")).alias("tiny"))
    got = once(tiny.join(_across(columns), "panel"), phase=under_upright(F.col("tiny"), F.col("columns"), least, span, reach))
    return got.select("panel", "phase").filter("phase IS NOT NULL")


def landmarks(words: DataFrame, letters: DataFrame) -> DataFrame:
    """(panel, letter, top, landmark): the small words of a row's band between the road and the first phase column.

    words: panel, text, x0, top, size; letters: panel, letter, top, until, left, right (where landmarks may begin).
    """
    w = words.filter((F.col("size") < 7.0) & ~F.col("text").rlike("^[A-H]$")).select("panel", "text", "x0", F.col("top").alias("wtop"))
    band = letters.join(w, "panel", "left").withColumn("_in", F.col("wtop").between(F.col("top") - 6, F.col("until")) & (F.col("wtop") < F.col("until")) & (F.col("x0") >= F.col("left")) & (F.col("x0") < F.col("right")))
    got = band.groupBy("panel", "letter", "top").agg(F.sort_array(F.collect_list(F.when(F.col("_in"), F.struct(F.bround(F.col("wtop") / 6).alias("b"), "x0", "text")))).alias("ws"))
    return got.select("panel", "letter", "top", F.nullif(F.trim(F.array_join(F.transform("ws", lambda x: x["text"]), " ")), F.lit("")).alias("landmark"))


def movements(words: DataFrame, columns: DataFrame, letters: DataFrame, reach: float = 26.0) -> DataFrame:
    """(panel, letter, phase, movement): movement letters under the nearest phase column, in the band of their row.

    letters: panel, letter, top, until (bands).
    """
    w = words.filter(F.col("text").isin("L", "S", "R", "U") & (F.col("size") >= 6.0)).select("panel", "text", "top", ((F.col("x0") + F.col("x1")) / 2).alias("xc"))
    first = columns.groupBy("panel").agg(F.min("x").alias("x_first"))
    w = w.join(first, "panel").filter(F.col("xc") >= F.col("x_first") - reach).withColumn("id", F.struct("top", "xc", "text"))
    near = w.join(columns, "panel").groupBy("panel", "id", "top", "text").agg(F.min(F.struct(F.abs(F.col("x") - F.col("xc")).alias("d"), "phase")).alias("m")).filter(F.col("m.d") <= reach)
    row = letters.select("panel", "letter", F.col("top").alias("from"), "until")
    return near.join(row, "panel").filter((F.col("top") >= F.col("from") - 5) & (F.col("top") < F.col("until"))).select("panel", "letter", F.col("m.phase").alias("phase"), F.col("text").alias("movement")).distinct()


#: How far a number may stand from its column, what a cycle may be, and what a phase may be inferred to be.
COLUMN_REACH, CYCLE_BOUNDS, INFERRED, PHASE_MAX, SLACK = 22.0, (30, 400), (3, 200), 200, 3


def placed_numbers(numbers: DataFrame, columns: DataFrame, cycles: DataFrame) -> DataFrame:
    """numbers with `place`: cycle, phase or none, and the `phase` column they stand under.

    numbers: panel, row, x, value; columns: panel, phase, x; cycles: panel, cycle_x. A number belongs to the nearer
    of the cycle and the nearest phase column, within COLUMN_REACH; of two under one phase the left one does.

    All rows are dealt by panel before anything is gathered: a task that reads a table holds none of it, and what any other holds
    follows its share of the panels.
    """
    across = columns.filter("x IS NOT NULL").repartition("panel").groupBy("panel").agg(F.collect_list(F.struct("x", "phase")).alias("columns"))
    n = numbers.select("panel", "row", F.col("x").alias("nx"), "value").repartition("panel").join(across, "panel", "left")
    near = F.array_min(F.transform("columns", lambda c: F.struct(F.abs(c["x"] - F.col("nx")).alias("d"), c["phase"].alias("phase"))))
    near = n.select("panel", "row", "nx", "value", F.inline(F.array(F.struct(near.alias("m"))))).join(cycles, "panel", "left").withColumn("c", F.abs(F.col("cycle_x") - F.col("nx")))
    by_cycle = F.coalesce((F.col("c") <= COLUMN_REACH) & ((F.col("c") < F.col("m.d")) | F.col("m.d").isNull()), F.lit(False))
    by_phase = ~by_cycle & F.coalesce(F.col("m.d") <= COLUMN_REACH, F.lit(False))
    got = near.select("panel", "row", "nx", "value", F.when(by_phase, F.col("m.phase")).alias("phase"), F.when(by_cycle, "cycle").when(by_phase, "phase").otherwise("none").alias("place"))
    # a number read twice stands beside itself in this order, under one phase or none
    each = Window.partitionBy("panel", "row", "phase").orderBy("nx", "value")
    again = F.lag(F.lit(1)).over(each).isNotNull() & F.lag("nx").over(each).eqNullSafe(F.col("nx")) & F.lag("value").over(each).eqNullSafe(F.col("value"))
    got = got.select("*", (F.row_number().over(each) == 1).alias("_first"), again.alias("_again")).filter("NOT _again")
    taken = F.when((F.col("place") == "phase") & ~F.col("_first"), "none").otherwise(F.col("place"))
    return got.select("panel", "row", "nx", "value", taken.alias("place"), F.when(taken == "phase", F.col("phase")).alias("phase"))


def timing_rows(placed: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """rows (panel, row, blinking) read: mode, phases, cycle_s, cycle_source, consistent, unassigned, flags.

    A row with one phase missing gets it from the cycle, one without a cycle the sum of its phases. Panels without
    phase columns are not read.
    """
    n = columns.repartition("panel").groupBy("panel").agg(F.count("*").cast("int").alias("n"))
    sums = placed.groupBy("panel", "row").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("place") == "phase", F.struct("phase", "value")))).alias("of"), F.max_by("value", F.when(F.col("place") == "cycle", F.struct("nx", "value"))).alias("stated"),
        F.count_if(F.col("place") == "none").alias("unassigned"),
    )
    got = rows.join(n, "panel").join(sums, ["panel", "row"], "left").withColumn("unassigned", F.coalesce("unassigned", F.lit(0)))
    got = got.withColumn("raw", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.try_element_at("of", i.cast(placed.schema["phase"].dataType))))
    return read_rows(got).select("panel", "row", "mode", "phases", "cycle_s", "cycle_source", "consistent", "unassigned", "flags")


def read_rows(got: DataFrame) -> DataFrame:
    """Rows with mode, phases, cycle_s, cycle_source, consistent and flags.

    got: n (phases a row has), raw (phases as read, null where none was), stated (cycle), unassigned (how many numbers), blinking.
    """
    got = got.withColumn("known", F.array_compact("raw")).withColumn("p", F.size("known")).withColumn("total", F.aggregate("known", F.lit(0).cast("long"), lambda a, x: a + x))
    got = got.withColumn("mode", F.when(F.col("blinking"), "blinking").when(F.col("p") == 0, "unknown").otherwise("timed"))
    timed, full, cycle = F.col("mode") == "timed", F.col("p") == F.col("n"), F.col("stated")
    missing = cycle - F.col("total")
    one = timed & cycle.isNotNull() & (F.col("p") == F.col("n") - 1) & missing.between(*INFERRED)
    stated = timed & cycle.isNotNull() & full
    summed = timed & cycle.isNull() & full & (F.col("p") >= 2)
    got = got.withColumn("phases", F.when(one, F.transform("raw", lambda x: F.coalesce(x, missing))).otherwise(F.col("raw")))
    got = got.withColumn("cycle_s", F.when(summed, F.col("total")).otherwise(cycle)).withColumn("cycle_source", F.when(stated | one, "stated_in_row").when(summed, "sum_of_phases"))
    sound = F.when(stated, F.abs(missing) <= SLACK).when(one | summed, True)
    got = got.withColumn("consistent", sound)
    flags = [
        F.when(stated & ~F.col("consistent"), F.format_string("cycle_mismatch_%+ds", missing)), F.when(one, "one_phase_inferred_from_cycle"), F.when(timed & ~(stated | one | summed), "incomplete_row"),
        F.when(timed & ~F.col("cycle_s").between(*CYCLE_BOUNDS), "cycle_out_of_range"), F.when(timed & F.exists("phases", lambda x: x > PHASE_MAX), "phase_over_200s"), F.when(F.col("unassigned") > 0, "unassigned_numbers"),
    ]
    return got.withColumn("flags", F.array_compact(F.array(*flags)))
