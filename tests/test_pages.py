"""Pages of words read into timing plans: a page of two panels, upright labels and panels without headings."""

from wayfare.operators import layout, pages

WORDS = "doc int, text string, x0 double, x1 double, top double, size double"
LABELS = "doc int, top double, x double, text string"
COLUMNS = [267.0, 319.0, 371.0, 420.0]
MOVES = {0: {0: "LS", 2: "L"}, 1: {1: "LSR"}, 2: {2: "LSR"}, 3: {0: "LS", 1: "L"}}


def panel(doc, at, header, roads, rows, marks, walk, header_top=None, digits=True):
    """(words, labels) of one panel whose table begins at `at`."""
    items = [(172.0, header_top or at, 10.0, header), (130.0, at + 50, 5.9, roads), (457.0, at + 44, 7.4, "CYCLE"), (461.0, at + 53, 7.4, "TIME"), (160.0, at + 69, 7.4, "ROAD"), (190.0, at + 69, 7.4, "FROM")]
    n, heading = len(rows[0][2]), at + 69
    items += [(COLUMNS[k], heading + 4 * (k == 1), 7.4, str(k + 1)) for k in range(n)] if digits else []
    items.append((COLUMNS[walk] - 6, heading + 30, 5.0, "EXCLUSIVE"))
    for i, mark in enumerate(marks):
        top = heading + 21 + i * 21
        items += [(167.0, top, 7.4, "ABCD"[i]), (190.0, top + 0.5, 5.9, mark)]
        for c, ways in MOVES[i].items():
            items += [(COLUMNS[c] - 3 + m * 18 - 9 * (len(ways) - 1), top, 7.4, w) for m, w in enumerate(ways) if c < n]
    first = heading + 21 + len(marks) * 21 + 6
    for i, (start, end, phases, cycle, label) in enumerate(rows):
        top = first + 14 * i
        items += [(122.0, top, 7.4, label)] * bool(label) + [(159.0, top, 7.4, start), (204.0, top, 7.4, end), (461.0, top, 7.4, str(cycle))]
        items += [(COLUMNS[k] - 2, top + k % 2, 7.4, str(p)) for k, p in enumerate(phases)]
    words, labels = [], []
    for x, top, size, said in items:
        labels.append((doc, top, x, said))
        for w in said.split():
            words.append((doc, w, x, x + 0.55 * size * len(w), top, size))
            x += 0.55 * size * (len(w) + 0.5)
    return words, labels


def read(spark, *panels):
    words, labels = ([x for p in panels for x in p[i]] for i in (0, 1))
    got = pages.read_panels(spark.createDataFrame(words, WORDS).repartition(3), spark.createDataFrame(labels, LABELS))
    return {(r["doc"], r["k"]): r for r in got.collect()}


def test_two_panels_of_a_page(spark):
    top = panel(1, 55.0, "ADUGODI JUNCTION, ADUGODI POLICE STATION - VAC", "HOSUR LASKAR RD X NEW MICO RD", [("7:00", "08:00", [40, 20, 30, 10], 100, ""), ("08:00", "11:00", [90, 35, 55, 10], 190, "TIMINGS"), ("11:00", "16:30", [65, 25, 35, 10], 135, "weekdays"), ("16:30", "21:00", [90, 35, 55, 10], 190, ""), ("21:00", "23:00", [40, 20, 30, 8], 98, "")], ["UCO BANK", "KORAMANGALA", "MICO BANDE", "ANEPALYA"], 3)
    low = panel(1, 480.0, "AISHWARYA JUNCTION, ADUGODI POLICE STATION - FIXED", "HOSUR RD X SERVICE RD", [("07:00", "11:00", [60, 40, 10], 110, ""), ("11:00", "16:00", [50, 30, 10], 91, ""), ("16:00", "22:00", [60, 40, 10], 110, ""), ("22:00", "23:00", [0, 0, 0], 0, "BBLLIINNKKIINNGG")], ["JAKKASANDRA", "KRUPANIDHI", "SERVICE ROAD"], 2, header_top=760.0)
    bare = ([(2, "nothing", 1.0, 9.0, 50.0, 9.0)], [(2, 50.0, 1.0, "nothing")])
    got = read(spark, top, low, bare)
    assert set(got) == {(1, 1), (1, 2)}
    a, b = got[1, 1], got[1, 2]
    assert (a["header"]["name"], a["header"]["station"], a["header"]["hint"], b["header"]["name"], b["header"]["hint"]) == ("ADUGODI", "ADUGODI", "vehicle_actuated", "AISHWARYA", "fixed")
    assert a["clean_label"] and a["phase_count"] == 4 and a["descriptor"] == "HOSUR LASKAR RD X NEW MICO RD" and a["pedestrian_phase"] == 3 and b["pedestrian_phase"] == 2
    (day,) = a["day_plans"]
    windows = day["windows"]
    assert day["day_type"] == "weekday_default" and day["windows_ordered"] and a["row_count"] == len(windows) == 5
    assert (windows[0]["start"], windows[0]["end"], windows[0]["phases"], windows[0]["cycle_s"], windows[0]["cycle_source"]) == ("07:00", "08:00", [40, 20, 30, 10], 100, "stated_in_row")
    assert all(w["consistent"] for w in windows) and windows[1]["cycle_s"] == 190 and windows[1]["labels"] == [] and windows[2]["labels"] == ["WEEKDAYS"]
    assert [w["pedestrian_phase_s"] for w in windows] == [10, 10, 10, 10, 8]
    assert [r["letter"] for r in a["approach_rows"]] == ["A", "B", "C", "D"] and a["approach_rows"][0]["landmark"] == "UCO BANK"
    ways = [{m["phase"]: m["moves"] for m in r["movements"]} for r in a["approach_rows"]]
    assert ways[0] == {0: ["L", "S"], 2: ["L"]} and ways[1] == {1: ["L", "S", "R"]}
    assert a["phase_labels"] == ["A·LS + D·LS", "B·LSR + D·L", "A·L + C·LSR", "pedestrian (EXCLUSIVE)"] and a["matrix_confidence"] == 1.0
    shut = b["day_plans"][0]["windows"]
    assert shut[-1]["mode"] == "blinking" and shut[-1]["labels"] == ["BLINKING"] and shut[1]["cycle_s"] == 91 and shut[1]["consistent"] and shut[0]["consistent"]
    assert 0.8 <= b["parse_confidence"] <= 1.0


def test_rows_without_headings_alternates_and_stray_numbers(spark):
    rows = [("07:00", "08:00", [40, 20, 30], 90, ""), ("08:00", "09:00", [40, 20, 30], 77, ""), ("06:00", "07:00", ["75(80)", 20, 30], 125, "(sunday)")]
    plain = panel(1, 55.0, "A, B POLICE STATION", "X Y", rows, [], 0, digits=False)
    cut = panel(2, 55.0, "C, D POLICE STATION - SYNC", "A ROAD X B ROAD", rows, [], 0)
    stray = ([(2, "55", 300.0 + 140, 300.0 + 144, cut[0][-1][4], 7.4)], [])
    got = read(spark, plain, cut, stray)
    free = [w for d in got[1, 1]["day_plans"] for w in d["windows"]]
    assert got[1, 1]["phase_count"] == 0 and got[1, 1]["pedestrian_phase"] is None and got[1, 1]["approach_rows"] is None
    assert [(w["phases"], w["cycle_s"], w["flags"]) for w in free] == [([40, 20, 30], 90, []), ([40, 20, 30, 77], 77, ["cycle_mismatch_-90s"]), ([75, 20, 30], 125, [])]
    days = got[2, 1]["day_plans"]
    assert [d["day_type"] for d in days] == ["weekday_default", "sunday"]
    last = days[1]["windows"][0]
    assert last["alternates"] == [80, None, None] and last["phases"] == [75, 20, 30] and last["unassigned"] == [55] and "unassigned_numbers" in last["flags"]


def test_upright_labels_and_landmarks(spark):
    stack = [(1, c, 265.0, 268.0, 100.0 + 5 * i, 5.0) for i, c in enumerate("EXCLUS")] + [(1, c, 330.0, 333.0, 100.0 + 5 * i, 5.0) for i, c in enumerate("EXCLUSIV")]
    words = spark.createDataFrame(stack, WORDS).withColumnRenamed("doc", "panel")
    columns = spark.createDataFrame([(1, 0, 270.0), (1, 1, 360.0)], "panel int, phase int, x double")
    assert [tuple(r) for r in layout.rotated_pedestrian_phase(words, columns).collect()] == [(1, 0)]  # the taller stack stands too far off
    short = words.filter("top < 122")
    assert layout.rotated_pedestrian_phase(short, columns).count() == 0
    letters = spark.createDataFrame([(1, "A", 10.0, 28.0, 60.0, 90.0), (1, "B", 30.0, 52.0, 60.0, 90.0)], "panel int, letter string, top double, until double, left double, right double")
    marks = [(1, "BANK", 75.0, 80.0, 11.0, 5.9), (1, "UCO", 62.0, 70.0, 11.0, 5.9), (1, "L", 80.0, 84.0, 11.0, 5.9), (1, "B", 80.0, 84.0, 11.0, 5.9), (1, "far", 95.0, 99.0, 11.0, 5.9), (1, "big", 70.0, 74.0, 33.0, 8.0)]
    got = layout.landmarks(spark.createDataFrame(marks, WORDS).withColumnRenamed("doc", "panel"), letters).collect()
    assert {r["letter"]: r["landmark"] for r in got} == {"A": "UCO BANK L", "B": None}


def test_empty_pages(spark):
    assert pages.read_panels(spark.createDataFrame([], WORDS), spark.createDataFrame([], LABELS)).count() == 0
