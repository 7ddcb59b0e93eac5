"""Claims as documents: windows, the one that holds, dates of block and source, verification, and the three kinds in order."""

import functools

from pyspark.sql import functions as F

from wayfare.operators import claims

LINK = "junction string, key string, ord int, source string, name string, hint string, tier string, flags array<string>, pre_validated boolean, link string, score double, verified_by string, verified_at string"
BLOCK = "key string, label string, document_date string, published_at string, retrieved_at string, phase_count int, phase_labels array<string>, parse_confidence double"
SOURCE = "source string, source_name string, publisher string, portal string, url string, license string, document_date string, published_at string, retrieved_at string"
WINDOW = "key string, plan_ord int, day_type string, win_ord int, start string, end string, mode string, cycle_s int, phases array<int>, ped int, ped_s int, consistent boolean"
STATE = "junction string, feed_junction string, source string, license string, approach string, state string, countdown_s int, observed timestamp, received timestamp"
EVIDENCE = "id string, source string, mention string, claim_type string, page int, quote string, best string, tier string, similarity double"
SUNDAY = "TIMESTAMP '2024-01-07 04:30:00Z'"  # ten in the morning, local
NIGHT = "TIMESTAMP '2024-01-08 21:30:00Z'"


@functools.cache
def made(spark, at=SUNDAY):
    links = spark.createDataFrame([
        ("j1", "a#1", 1, "s1", "A", "fixed", "strong", ["duplicate"], True, "verified", 1.0, "rev", "2024-01-01"),
        ("j1", "a#2", 2, "s1", "A", None, "moderate", None, True, "candidate", 0.7, None, None),
        ("j1", "a#3", 3, "gone", "A", None, "weak", [], False, "candidate", 0.4, None, None),
    ], LINK)
    blocks = spark.createDataFrame([("a#1", "A Circle", "2023-06", None, None, 3, ["A", None], 0.9), ("a#2", "B", None, None, None, 2, None, None)], BLOCK)
    sources = spark.createDataFrame([("s1", claims.LONG_NAME + "East", "P", "portal", "u", "CC", "2020-01-01", "2023-12-30T10:00", "2024-01-02")], SOURCE)
    windows = spark.createDataFrame([
        ("a#1", 0, "weekday_default", 1, "12:00", "22:00", "timed", 120, [60, 50, 10], 2, 10, True), ("a#1", 0, "weekday_default", 0, "06:00", "12:00", "timed", 100, [50, 40, 10], 2, 10, None),
        ("a#1", 1, "saturday", 0, "06:00", "22:00", "blinking", None, [], None, None, None),
    ], WINDOW)
    states = spark.sql("SELECT 'j1', 'f9', 'feed', 'L', 'N', 'green', 12, TIMESTAMP '2024-01-07 04:29:50Z', TIMESTAMP '2024-01-07 04:29:52Z' UNION ALL SELECT 'j2', 'f8', 'feed', 'L', NULL, 'red', NULL, TIMESTAMP '2024-01-07 04:28:00Z', TIMESTAMP '2024-01-07 04:28:00Z'").toDF(*[c.split()[0] for c in STATE.split(", ")])
    evidence = spark.createDataFrame([("e1", "s1", "A junction", "planning_mention", 4, "so it says", "j1", "moderate", 0.8), ("e2", "s1", "x", "m", 1, "q", "j1", "weak", 0.9), ("e3", "s1", "x", "m", 1, "q", None, "strong", 0.9)], EVIDENCE)
    day = F.lit("2024-01-07").cast("date")
    got = claims.documents(claims.published(links, blocks, sources, windows, F.expr(at), day), claims.historical(evidence, sources, day), claims.live(states, F.expr(SUNDAY)))
    return {(r.junction, r["id"]): r for r in got.collect()}, got


def test_claims_in_full(spark):
    got, df = made(spark)
    assert [c for c in df.columns if c not in ("junction", "rank")] == list(claims.FIELDS)
    assert [k[1] for k, r in sorted(got.items(), key=lambda x: x[1]["rank"]) if k[0] == "j1"] == ["live:feed:f9", "a#1", "a#2", "a#3", "e1"]
    a = got["j1", "a#1"]
    assert [(w.day_type, w.start, w.mode, w.cycle_s, w.pedestrian_phase_s) for w in a.windows] == [("weekday_default", "06:00", "timed", 100, 10), ("weekday_default", "12:00", "timed", 120, 10), ("saturday", "06:00", "blinking", None, None)]
    assert a.applicable_window == a.windows[0] and a.applicable_note.startswith("Weekday plan assumed")
    assert a.source.name == "BTP timing sheet — East" and (a.document_date, a.published_at, a.retrieved_at) == ("2023-06", "2023-12-30T10:00", "2024-01-02")
    assert (a.currency.status, a.currency.effective_date, a.currency.effective_date_source, a.currency.age_days) == ("aging", "2023-06", "document", 220)
    assert a.currency.label == "Aging — dated Jun 2023, 7 mo old; may not reflect the current programme"
    assert (a.verification.status, a.verification.by, a.verification.at, a.match.tier, a.match.score) == ("verified", "rev", "2024-01-01", "reviewer-linked", None)
    assert a.summary == "3 windows · C 100–120 s · 3 phase columns · pedestrian stage 10 s" and a.phase_labels == ["A", None] and a.affects_recommendations
    b = got["j1", "a#2"]
    assert b.windows == [] and b.applicable_window is None and b.applicable_note == "No readable plan for this day type" and b.summary == "0 windows · 2 phase columns"
    assert b.currency.effective_date == "2020-01-01" and (b.match.tier, b.match.score, b.quality_flags) == ("moderate", 0.7, []) and b.verification.status == "pre_validated"
    c = got["j1", "a#3"]
    assert c.source.id == "gone" and c.source.name is None and c.currency.status == "undated" and c.summary == "0 windows"


def test_live_and_historical(spark):
    got, _ = made(spark)
    one, old, e = got["j1", "live:feed:f9"], got["j2", "live:feed:f8"], got["j1", "e1"]
    assert one.currency.label == "Live — observed 10 s ago" and one.retrieved_at == "2024-01-07T04:29:52.000Z" and one.summary == "green · 12 s" and one.live.freshness_s == 2.0 and one.match is None
    assert old.currency.status == "stale" and old.currency.label.endswith("120 s ago (> 30 s); not shown as current") and old.quality_flags == ["stale_live_sample"] and old.summary == "red" and not old.affects_recommendations
    assert e.windows is None and e.summary == "planning mention · page 4" and e.quote == "so it says" and e.currency.status == "historical" and e.quality_flags == ["possible_mention"] and e.match.score == 0.8


def test_outside_windows(spark):
    got, _ = made(spark, NIGHT)
    assert got["j1", "a#1"].applicable_window is None and got["j1", "a#1"].applicable_note.startswith("Outside every")
