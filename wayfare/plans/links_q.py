"""Links, coverage and claims: orders as plan blocks, customers as junctions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.functions import clock, formats
from wayfare.operators import claims as claim_rows
from wayfare.operators import junctions, links, plans, stats
from wayfare.session import table

_k, _c = (lambda: F.col("o_orderkey")), (lambda: F.col("o_custkey"))
_AS_OF = "1998-06-01"


def blocks(spark, sf_dir):
    tiers = F.array(*map(F.lit, ["strong", "moderate", "weak", "none"]))
    hints = F.array(*map(F.lit, ["fixed", "vehicle_actuated", "fixed_coordinated", "adaptive", "unknown"]))
    flags = F.filter(F.array(F.when(_k() % 6 == 0, "dup"), F.when(_k() % 10 == 0, "old")), lambda x: x.isNotNull())
    return table(spark, sf_dir, "orders").select(
        _k().alias("key"), _k().alias("ord"), F.concat(F.lit("s"), _c() % 50).alias("source"), F.col("o_orderpriority").alias("name"), F.get(tiers, (_k() % 4).cast("int")).alias("tier"),
        F.when(_k() % 7 != 0, _c() % 211).alias("best"), ((_k() % 100) / 100).alias("combined"), F.when(_k() % 3 == 0, (_c() + 1) % 211).alias("proposed"), (_k() % 4 == 0).alias("passed"),
        F.get(hints, (_k() % 5).cast("int")).alias("hint"), flags.alias("flags"),
    )


def decisions(spark, sf_dir):
    word = F.when(_k() % 11 == 0, "accepted").when(_k() % 11 == 1, "rejected").when(_k() % 11 == 2, "deactivated")
    return table(spark, sf_dir, "orders").select(_k().alias("key"), word.alias("decision"), F.when(_k() % 22 < 11, _c() % 211).alias("to"), F.when(_k() % 2 == 0, "r1").alias("by"), F.col("o_orderdate").cast("date").alias("at")).filter("decision IS NOT NULL")


def _stood(spark, sf_dir):
    return links.with_status(blocks(spark, sf_dir), decisions(spark, sf_dir))


def plan_links(spark, sf_dir):
    got = links.all_links(_stood(spark, sf_dir))
    return got.select("junction", "key", "link", "pre_validated", "score", "verified_by", F.date_format("verified_at", "yyyy-MM-dd").alias("verified_at"), F.array_join("flags", ",").alias("flags"), "rank")


def _conflicts(spark, sf_dir):
    k = table(spark, sf_dir, "orders").select((_c() % 211).alias("target"), (_k() % 3).alias("sig"), (_k() % 11 == 0).alias("v"))
    return k.groupBy("target").agg((F.count_distinct(F.when(F.col("v"), F.col("sig"))) > 1).alias("among_verified"))


def plan_inputs(spark, sf_dir):
    """The accepted block that serves each junction: fixed timing before actuated, first in order."""
    got = links.plan_inputs(_stood(spark, sf_dir), _conflicts(spark, sf_dir))
    return got.select("junction", "key", "source", "hint", "verified_by", "links", "conflicting")


def plan_status_counts(spark, sf_dir):
    return links.status_counts(_stood(spark, sf_dir))


def _covered(spark, sf_dir):
    c = F.col("c_custkey")
    j = table(spark, sf_dir, "customer")
    rows = j.select(c.alias("junction"), F.when(c % 6 == 0, "signals").otherwise("unknown").alias("control_type"), F.when(F.col("c_nationkey") % 5 == 0, "unresolved").otherwise("junction").alias("kind"), (F.col("c_nationkey") % 4).cast("long").alias("approaches"))
    stood = _stood(spark, sf_dir)
    live = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7).alias("junction"))
    word = j.filter(c % 17 == 0).select(c.alias("junction"), F.when(c % 2 == 0, "fixed").otherwise("unknown").alias("control_type"))
    gone = j.filter(c % 19 == 0).select(c.alias("junction"), F.lit("rejected").alias("decision"))
    return links.covered(rows, links.verified_links(stood), links.candidate_links(stood), live, word, gone)


def coverage(spark, sf_dir):
    return _covered(spark, sf_dir).select("junction", "category", "is_verified", "is_live", "control")


def coverage_summary(spark, sf_dir):
    return links.coverage_summary(_covered(spark, sf_dir))


def unknown_summary(spark, sf_dir):
    """The same junctions before any plan is loaded."""
    return links.unknown_summary(table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 4).alias("approaches")))


def control_split(spark, sf_dir):
    rows = _covered(spark, sf_dir)
    return links.control_split(rows, plan_inputs(spark, sf_dir).select("junction", "hint"))


def map_layers(spark, sf_dir):
    """Each junction's colours by layer, from its category, delay, chance of a stop and confidence."""
    rows = _covered(spark, sf_dir)
    mean, p, c = (F.col("junction") % 90).cast("double"), (F.col("junction") % 10) / 10, (F.col("junction") % 7) / 6
    level = F.when(F.col("category") == "unknown", "E").otherwise("P")
    strong = F.col("category").isin(links.WITH_TIMING)
    radius = F.when(strong, 4.5).when(F.col("category") == "control_type_known", 3.5).otherwise(3.0)
    return rows.select("junction", radius.alias("radius"), formats.delay_colour(mean, level).alias("delay"), formats.stop_colour(p).alias("stop"), formats.confidence_colour(c).alias("confidence"), (strong & (F.col("junction") % 3 == 0)).alias("shown"))


def _windows(spark, sf_dir):
    """Line items as windows of their order's block."""
    kinds = F.array(*map(F.lit, ["weekday_default", "saturday", "sunday", "weekend"]))
    mode = F.when(F.col("l_returnflag") == "R", "blinking").otherwise("timed")
    cycle = F.when(F.col("l_linenumber") % 4 != 3, 60 + F.col("l_quantity").cast("int"))
    ped = F.when(F.col("l_tax") > 0.04, (F.col("l_quantity") % 9).cast("int") + 5)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.get(kinds, F.col("l_linenumber") % 4).alias("day_type"), mode.alias("mode"), cycle.alias("cycle_s"), ped.alias("ped_s"))


def plan_summaries(spark, sf_dir):
    phases = table(spark, sf_dir, "orders").select(_k().alias("key"), F.when(_k() % 3 != 0, _k() % 5).alias("phases"))
    return links.plan_summary(_windows(spark, sf_dir), phases)


def window_texts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    mode = F.when(F.col("l_returnflag") == "R", "blinking").when(F.col("l_returnflag") == "A", "timed").otherwise("unknown")
    phases = F.array(q, F.when(q % 5 != 0, q + 7), F.lit(0))
    start, end = F.format_string("%02d:00", F.col("l_linenumber") + 5), F.format_string("%02d:30", F.col("l_linenumber") + 9)
    text = links.window_text(start, end, mode, phases, F.when(q % 7 != 0, q * 2 + 7))
    return li.select("l_orderkey", "l_linenumber", text.alias("text"), plans.assigned_green(phases, q % 3, F.lit(40)).alias("assigned"))


def _evidence(spark, sf_dir):
    p = F.col("p_partkey")
    tiers = F.array(*map(F.lit, ["strong", "moderate", "weak"]))
    return table(spark, sf_dir, "part").select(p.alias("id"), F.when(p % 5 != 0, p % 211).alias("best"), F.get(tiers, (p % 3).cast("int")).alias("tier"), (F.col("p_size") / 50.0).alias("similarity"))


def _claims(spark, sf_dir):
    stood = _stood(spark, sf_dir)
    rows = links.verified_links(stood).unionByName(links.candidate_links(stood))
    o = table(spark, sf_dir, "orders")
    modes = F.array(*map(F.lit, ["timed", "none", "outside_windows", "blinking"]))
    active = o.select(_k().alias("key"), F.get(modes, (_k() % 4).cast("int")).alias("mode"), (_k() % 8 == 0).alias("assumed"))
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    dates = o.select(_k().alias("key"), F.when(_k() % 3 == 0, F.substring(iso, 1, 7)).when(_k() % 3 == 1, iso).alias("document"), F.when(_k() % 6 == 2, iso).alias("portal"))
    s = F.col("s_suppkey")
    now = F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    states = table(spark, sf_dir, "supplier").select((s % 211).alias("junction"), F.concat(F.lit("feed"), s % 3).alias("source"), F.when(s % 2 == 0, "N").alias("approach"), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00' - make_dt_interval(0, 0, 0, CAST(s_suppkey % 60 AS DECIMAL(12, 6)))").alias("observed"))
    return links.claims(links.published_claims(rows, active, dates, F.lit(_AS_OF).cast("date")), links.historical_claims(_evidence(spark, sf_dir)), links.live_claims(states, now))


def claims(spark, sf_dir):
    """Every claim about each junction, live before published before historical."""
    got = _claims(spark, sf_dir)
    return got.select("junction", "id", "kind", "status", "label", "tier", F.round("score", 6).alias("score"), "currency", "note", F.array_join("flags", ",").alias("flags"), "affects", "rank")


def _plan_windows(spark, sf_dir):
    """Line items as windows of their order's block, four hours and a half each, dealt to four kinds of day."""
    kinds = F.array(*map(F.lit, ["weekday_default", "saturday", "sunday", "weekend"]))
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    plan, mode = ((F.col("l_orderkey") + n) % 4).cast("int"), F.when(F.col("l_returnflag") == "R", "blinking").otherwise("timed")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), plan.alias("plan_ord"), F.get(kinds, plan).alias("day_type"), n.alias("win_ord"), F.format_string("%02d:00", 2 * n + 2).alias("start"), F.format_string("%02d:30", 2 * n + 6).alias("end"),
        mode.alias("mode"), (60 + q).alias("cycle_s"), F.array(q, F.lit(10)).alias("phases"), F.lit(None).cast("int").alias("ped"), F.when(F.col("l_tax") > 0.04, q % 9 + 5).alias("ped_s"), (q % 2 == 0).alias("consistent"),
    )


def claim_documents(spark, sf_dir):
    """Claims of links and mentions in full, judged on a Sunday at ten in the morning."""
    stood = _stood(spark, sf_dir)
    rows = links.verified_links(stood).unionByName(links.candidate_links(stood))
    o, none = table(spark, sf_dir, "orders"), F.lit(None).cast("string")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    blocks = o.select(_k().alias("key"), F.col("o_orderpriority").alias("label"), F.when(_k() % 3 == 0, F.substring(iso, 1, 7)).alias("document_date"), F.when(_k() % 5 == 0, iso).alias("published_at"), none.alias("retrieved_at"), F.when(_k() % 3 != 0, (_k() % 5).cast("int")).alias("phase_count"), F.array(F.lit("A"), none).alias("phase_labels"), ((_k() % 10) / 10).alias("parse_confidence"))
    first = F.date_format(F.min("o_orderdate"), "yyyy-MM-dd")
    source = F.concat(F.lit("s"), _c() % 50)
    sources = o.groupBy(source.alias("source")).agg(first.alias("published_at"), F.min(_c() % 50).alias("n"))
    name = F.concat(F.lit(claim_rows.LONG_NAME), "source")
    sources = sources.select("source", name.alias("source_name"), F.lit("P").alias("publisher"), none.alias("portal"), none.alias("url"), F.lit("CC").alias("license"), none.alias("document_date"), F.when(F.col("n") % 2 == 0, F.col("published_at")).alias("published_at"), F.lit("2024-01-02").alias("retrieved_at"))
    p = F.col("id")
    said = _evidence(spark, sf_dir).select("*", F.concat(F.lit("s"), p % 50).alias("source"), F.concat(F.lit("m"), p).alias("mention"), F.lit("planning_mention").alias("claim_type"), (p % 9).cast("int").alias("page"), F.concat(F.lit("q"), p).alias("quote"))
    day = F.lit(_AS_OF).cast("date")
    got = claim_rows.documents(claim_rows.published(rows, blocks, sources, _plan_windows(spark, sf_dir), F.expr("TIMESTAMP '2024-01-07 04:30:00Z'"), day), claim_rows.historical(said, sources, day))
    w, c = F.col("applicable_window"), F.col("currency")
    return got.select(
        "junction", "id", "kind", F.col("source.name").alias("source"), F.size("windows").alias("windows"), F.concat_ws(" ", w["start"], w["end"], w["mode"], w["cycle_s"].cast("string"), w["pedestrian_phase_s"].cast("string")).alias("applicable"), F.col("applicable_note").alias("note"),
        "document_date", "published_at", "retrieved_at", c["status"].alias("currency"), c["effective_date"].alias("effective"), c["age_days"].alias("age"), F.col("verification.by").alias("reviewer"), F.col("verification.status").alias("verified"), F.col("match.tier").alias("tier"),
        F.round("match.score", 6).alias("score"), F.array_join("quality_flags", ",").alias("flags"), F.col("affects_recommendations").alias("affects"), "summary", F.col("control_type_hint").alias("hint"), "page", "quote", F.col("parse_confidence").alias("confidence"), "rank",
    )


def mention_counts(spark, sf_dir):
    return links.mention_counts(_evidence(spark, sf_dir))


def stale_sources(spark, sf_dir):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = table(spark, sf_dir, "orders").select(_k().alias("source"), F.when(_k() % 4 == 0, iso).alias("document"), F.when(_k() % 4 == 1, iso).alias("portal"))
    return links.stale_sources(o, F.lit(_AS_OF).cast("date"))


def weak_matches(spark, sf_dir):
    """Blocks whose match must not be linked unseen, by source."""
    return blocks(spark, sf_dir).filter(links.weak_match(F.col("tier"))).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("best").isNull()).alias("unmatched"))


def ranking_prior(spark, sf_dir):
    """The middle of the priors of all accepted blocks' windows, by hint."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    w = li.select(F.col("l_orderkey").alias("key"), F.lit(0).alias("plan_ord"), F.col("l_linenumber").alias("win_ord"), F.lit("timed").alias("mode"), F.array(q, q + 20, F.lit(10)).alias("phases"), (2 * q + 30).alias("cycle_s"), F.lit(None).cast("int").alias("ped"))
    c = F.col("cycle_s").cast("double")
    greens = plans.vehicle_phases(F.col("phases"), F.col("cycle_s"), F.col("ped"), F.col("mode"))
    own = w.join(links.verified_links(_stood(spark, sf_dir)).select("key", "hint"), "key").withColumn("greens", greens).filter("greens IS NOT NULL")
    m = plans.mixture(c, F.col("greens"))
    each = own.select("hint", m["mean"].alias("mean"), m["p_stop"].alias("p_stop"))
    got = stats.upper_medians(each, "hint", ["mean", "p_stop"])
    return got.select("hint", F.round("mean", 9).alias("mean"), F.round("p_stop", 9).alias("p_stop"))


def timing_signatures(spark, sf_dir):
    """The canonical timings of each order's table, as a digest."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    w = li.select(F.col("l_orderkey").alias("junction"), F.lit("all_days").alias("day_type"), F.format_string("%02d:00", F.col("l_linenumber")).alias("start"), F.lit("24:00").alias("end"), F.when(F.col("l_returnflag") == "R", "blinking").otherwise("timed").alias("mode"), F.array(q, F.lit(10)).alias("phases"), (q + 10).alias("cycle_s"))
    return plans.signatures(w).select("junction", F.md5("sig").alias("sig"))


def ingest_status(spark, sf_dir):
    """The stricter rule of currency, and the rank of each order's roads."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    doc = F.when(_k() % 3 == 0, iso).when(_k() % 3 == 1, F.substring(iso, 1, 7))
    kinds = F.array(*map(F.lit, ["motorway", "trunk_link", "primary", "secondary_link", "tertiary", "residential"]))
    own = F.slice(kinds, (_k() % 6 + 1).cast("int"), (_c() % 3).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", clock.ingest_currency(doc, F.when(_k() % 4 != 2, F.concat(iso, F.lit("T10:00"))), F.lit(_AS_OF).cast("date")).alias("status"), junctions.importance(own).cast("int").alias("importance"))


def ingest_tallies(spark, sf_dir):
    """Blocks by tier, hint and year, and their flags."""
    b = blocks(spark, sf_dir).join(table(spark, sf_dir, "orders").select(_k().alias("key"), F.year("o_orderdate").alias("year")), "key")
    return links.tallies(b, ["tier", "hint", "year"], ["flags"])


_STOOD = f"""WITH blk AS (SELECT o_orderkey AS key, 's' || (o_custkey % 50) AS source, ['strong', 'moderate', 'weak', 'none'][o_orderkey % 4 + 1] AS tier, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 211 END AS best, (o_orderkey % 100) / 100.0::DOUBLE AS combined,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey + 1) % 211 END AS proposed, o_orderkey % 4 = 0 AS passed, ['fixed', 'vehicle_actuated', 'fixed_coordinated', 'adaptive', 'unknown'][o_orderkey % 5 + 1] AS hint,
  CASE WHEN o_orderkey % 11 = 0 THEN 'accepted' WHEN o_orderkey % 11 = 1 THEN 'rejected' WHEN o_orderkey % 11 = 2 THEN 'deactivated' END AS decision, CASE WHEN o_orderkey % 22 < 11 THEN o_custkey % 211 END AS tto, CASE WHEN o_orderkey % 2 = 0 THEN 'r1' END AS rb, o_orderdate::DATE AS ra,
  concat_ws(',', CASE WHEN o_orderkey % 6 = 0 THEN 'dup' END, CASE WHEN o_orderkey % 10 = 0 THEN 'old' END) AS flags FROM orders),
st AS (SELECT *, CASE WHEN decision = 'accepted' THEN 'verified' ELSE coalesce(decision, 'candidate') END AS status, CASE WHEN decision = 'accepted' THEN tto WHEN decision IS NOT NULL THEN coalesce(tto, proposed) ELSE coalesce(proposed, best) END AS target FROM blk),
ver AS (SELECT target AS junction, *, 'verified' AS link, 1.0::DOUBLE AS score FROM st WHERE status = 'verified' AND target IS NOT NULL),
cand AS (SELECT best AS junction, *, CASE WHEN status = 'deactivated' THEN 'deactivated' ELSE 'candidate' END AS link, combined AS score FROM st WHERE status NOT IN ('verified', 'rejected') AND best IS NOT NULL AND combined >= {links.LEAST_SCORE}::DOUBLE),
lk AS (SELECT * FROM ver UNION ALL SELECT * FROM cand)"""
_INPUT = """, conf AS (SELECT o_custkey % 211 AS junction, count(DISTINCT o_orderkey % 3) FILTER (o_orderkey % 11 = 0) > 1 AS c FROM orders GROUP BY 1),
inp AS (SELECT junction, arg_min({'key': key, 'source': source, 'hint': hint, 'by': rb}, (CASE WHEN hint IN ('fixed', 'fixed_coordinated') THEN 0 WHEN hint = 'vehicle_actuated' THEN 1 ELSE 2 END, key)) AS b, count(*) AS links FROM ver GROUP BY junction)"""
_COVER = """, cov AS (SELECT c.c_custkey AS junction, c.c_nationkey % 4 AS approaches, c.c_custkey IN (SELECT junction FROM ver) AS is_verified, c.c_custkey IN (SELECT junction FROM cand) AS is_cand, c.c_custkey IN (SELECT s_suppkey * 7 FROM supplier) AS is_live,
  CASE WHEN c.c_custkey % 17 = 0 THEN CASE WHEN c.c_custkey % 2 = 0 THEN 'fixed' ELSE 'unknown' END END AS word, CASE WHEN c.c_custkey % 6 = 0 THEN 'signals' ELSE 'unknown' END AS own, c.c_custkey % 19 = 0 OR c.c_nationkey % 5 = 0 AS unclear FROM customer c),
cat AS (SELECT *, CASE WHEN is_live THEN 'live_timing' WHEN is_verified THEN 'verified_published' WHEN is_cand THEN 'published_awaiting_review' WHEN coalesce(nullif(word, 'unknown'), own) <> 'unknown' THEN 'control_type_known' WHEN unclear THEN 'unknown' ELSE 'location_only' END AS category, coalesce(word, own) AS control FROM cov)"""
_AGE = "greatest(0, date_diff('day', {d}, DATE '" + _AS_OF + "'))"
_STATUS = "CASE WHEN {a} IS NULL THEN 'undated' WHEN {a} <= 180 THEN 'current' WHEN {a} <= 365 THEN 'aging' ELSE 'stale' END"

QUERIES = {f.__name__: f for f in (plan_links, plan_inputs, plan_status_counts, coverage, coverage_summary, unknown_summary, control_split, map_layers, plan_summaries, window_texts, claims, claim_documents, mention_counts, stale_sources, weak_matches, ranking_prior, timing_signatures, ingest_status, ingest_tallies)}
ORACLES = {
    "plan_links": _STOOD + """ SELECT junction, key, link, passed AS pre_validated, score, CASE WHEN link = 'verified' THEN rb END AS verified_by, CASE WHEN link = 'verified' THEN strftime(ra, '%Y-%m-%d') END AS verified_at, flags,
row_number() OVER (PARTITION BY junction ORDER BY link = 'verified' DESC, passed DESC, score DESC, key)::INT AS rank FROM lk""",
    "plan_inputs": _STOOD + _INPUT + " SELECT junction, b.key AS key, b.source AS source, b.hint AS hint, b.by AS verified_by, links, coalesce(conf.c, FALSE) AS conflicting FROM inp LEFT JOIN conf USING (junction)",
    "plan_status_counts": _STOOD + """ SELECT count(*) AS total, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'deactivated') AS deactivated, count(*) FILTER (status = 'candidate') AS candidates,
count(*) FILTER (status = 'candidate' AND passed) AS pre_validated, count(DISTINCT target) FILTER (status = 'verified') AS intersections FROM st""",
    "coverage": _STOOD + _COVER + " SELECT junction, category, is_verified, is_live, control FROM cat",
    "coverage_summary": _STOOD + _COVER + " SELECT count(*) AS mapped, " + ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in links.CATEGORIES) + ", count(*) FILTER (category IN ('live_timing', 'verified_published', 'published_awaiting_review')) AS with_timing_data, count(*) FILTER (is_verified) AS verified, count(*) FILTER (is_live) AS live, sum(approaches)::BIGINT AS approaches FROM cat",
    "unknown_summary": "SELECT count(*) AS mapped, count(*) AS unknown, " + ", ".join(f"0::BIGINT AS {c}" for c in links.CATEGORIES if c != "unknown") + ", sum(c_nationkey % 4)::BIGINT AS approaches FROM customer",
    "control_split": _STOOD + _INPUT + _COVER + """, h AS (SELECT coalesce(inp.b.hint, control) AS h FROM cat LEFT JOIN inp USING (junction)) SELECT count(*) FILTER (h IN ('fixed', 'fixed_coordinated')) AS fixed, count(*) FILTER (h IN ('vehicle_actuated', 'time_of_day', 'actuated')) AS actuated,
count(*) FILTER (h = 'adaptive') AS adaptive, count(*) FILTER (h NOT IN ('fixed', 'fixed_coordinated', 'vehicle_actuated', 'time_of_day', 'actuated', 'adaptive')) AS unknown FROM h""",
    "map_layers": _STOOD + _COVER + f""" SELECT junction, (CASE WHEN strong THEN 4.5 WHEN category = 'control_type_known' THEN 3.5 ELSE 3 END)::DOUBLE AS radius, CASE WHEN category = 'unknown' THEN '{formats.DIM}' WHEN junction % 90 < 25 THEN '{formats.ORANGE}' WHEN junction % 90 < 60 THEN '{formats.EMBER}' ELSE '{formats.RED}' END AS delay,
CASE WHEN junction % 10 < 3.5 THEN '{formats.ORANGE}' WHEN junction % 10 < 6.5 THEN '{formats.EMBER}' ELSE '{formats.RED}' END AS stop, CASE WHEN junction % 7 >= 5 THEN '{formats.ORANGE}' WHEN junction % 7 = 4 THEN '{formats.EMBER}' ELSE '{formats.RED}' END AS confidence, strong AND junction % 3 = 0 AS shown
FROM (SELECT *, category IN ('live_timing', 'verified_published', 'published_awaiting_review') AS strong FROM cat)""",
    "plan_summaries": """WITH w AS (SELECT l_orderkey AS key, l_linenumber % 4 IN (2, 3) AS sun, CASE WHEN l_returnflag <> 'R' AND l_linenumber % 4 <> 3 THEN 60 + trunc(l_quantity)::INT END AS c, CASE WHEN l_returnflag <> 'R' AND l_linenumber % 4 <> 3 AND l_tax > 0.04 THEN trunc(l_quantity % 9)::INT + 5 END AS p FROM lineitem),
g AS (SELECT key, count(*) AS n, min(c) AS c0, max(c) AS c1, min(p) AS p0, max(p) AS p1, bool_or(sun) AS sun FROM w GROUP BY key)
SELECT key, concat_ws(' · ', n || CASE WHEN n = 1 THEN ' window' ELSE ' windows' END, CASE WHEN c0 IS NOT NULL THEN 'C ' || CASE WHEN c0 = c1 THEN c0::VARCHAR ELSE c0 || '–' || c1 END || ' s' END, CASE WHEN key % 3 <> 0 AND key % 5 > 0 AND key IN (SELECT o_orderkey FROM orders) THEN (key % 5) || ' phase columns' END,
CASE WHEN p0 IS NOT NULL THEN 'pedestrian stage ' || CASE WHEN p0 = p1 THEN p0::VARCHAR ELSE p0 || '–' || p1 END || ' s' END, CASE WHEN sun THEN 'separate Sunday plan' END) AS summary FROM g""",
    "window_texts": """WITH w AS (SELECT *, trunc(l_quantity)::INT AS q, format('{:02d}:00–{:02d}:30', l_linenumber + 5, l_linenumber + 9) AS span FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN span || ' blinking (no control)' WHEN l_returnflag = 'A' AND q % 7 <> 0 THEN span || ' phases [' || q || ', ' || CASE WHEN q % 5 <> 0 THEN (q + 7)::VARCHAR ELSE '?' END || ', 0] · C ' || (q * 2 + 7) || ' s' ELSE span || ' unreadable' END AS text,
CASE q % 3 WHEN 0 THEN CASE WHEN q > 0 AND q < 40 THEN q END WHEN 1 THEN CASE WHEN q % 5 <> 0 AND q + 7 < 40 THEN q + 7 END END AS assigned FROM w""",
    "claims": _STOOD + f""", o AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN date_trunc('month', o_orderdate)::DATE WHEN o_orderkey % 3 = 1 OR o_orderkey % 6 = 2 THEN o_orderdate::DATE END AS d FROM orders),
pub AS (SELECT junction, lk.key::VARCHAR AS id, 'published' AS kind, CASE WHEN link IN ('verified', 'deactivated') THEN link WHEN passed THEN 'pre_validated' ELSE 'awaiting_review' END AS status,
  CASE WHEN link = 'verified' THEN 'Accepted review link' || coalesce(' · ' || rb, '') WHEN link = 'deactivated' THEN 'Deactivated by reviewer — kept on file' WHEN passed THEN 'Passes rule set v1 — awaiting reviewer confirmation' ELSE 'Awaiting review' END AS label,
  CASE WHEN link = 'verified' THEN 'reviewer-linked' ELSE tier END AS tier, CASE WHEN link <> 'verified' THEN score END AS score, CASE WHEN d IS NULL THEN 'undated' WHEN {_AGE.format(d="d")} <= 180 THEN 'current' WHEN {_AGE.format(d="d")} <= 365 THEN 'aging' ELSE 'stale' END AS currency,
  CASE lk.key % 4 WHEN 1 THEN 'No readable plan for this day type' WHEN 2 THEN 'Outside every published window (signals commonly flash overnight)' ELSE CASE WHEN lk.key % 8 = 0 THEN 'Weekday plan assumed — no Sunday plan published' END END AS note, flags, link = 'verified' AS affects FROM lk JOIN o USING (key)),
his AS (SELECT p_partkey % 211, p_partkey::VARCHAR, 'historical', 'not_applicable', 'Historical mention — matched by name, not a timing claim', CASE p_partkey % 3 WHEN 0 THEN 'strong' ELSE 'moderate' END, p_size / 50.0::DOUBLE, 'historical', 'No timing values — the document mentions the junction without a cycle or phase table', CASE p_partkey % 3 WHEN 1 THEN 'possible_mention' ELSE '' END, FALSE FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 < 2),
liv AS (SELECT s_suppkey % 211, 'live:feed' || (s_suppkey % 3) || ':' || (s_suppkey % 211), 'live', CASE WHEN s_suppkey % 60 <= 30 THEN 'verified' ELSE 'not_applicable' END, CASE WHEN s_suppkey % 60 <= 30 THEN 'Authorised live feed — current state' ELSE 'Live sample too old to show as current' END, NULL, NULL,
  CASE WHEN s_suppkey % 60 <= 30 THEN 'live' ELSE 'stale' END, CASE WHEN s_suppkey % 2 = 0 THEN 'Approach N' ELSE 'Junction-wide state' END, CASE WHEN s_suppkey % 60 <= 30 THEN '' ELSE 'stale_live_sample' END, s_suppkey % 60 <= 30 FROM supplier),
al AS (SELECT * FROM pub UNION ALL SELECT * FROM his UNION ALL SELECT * FROM liv)
SELECT junction, id, kind, status, label, tier, round(score, 6) AS score, currency, note, flags, affects, row_number() OVER (PARTITION BY junction ORDER BY list_position(['live', 'published', 'historical'], kind), list_position(['verified', 'pre_validated', 'awaiting_review', 'deactivated', 'not_applicable', 'rejected'], status), coalesce(score, 0) DESC, id)::INT AS rank FROM al""",
    "claim_documents": _STOOD + f""", o AS (SELECT o_orderkey AS key, o_orderdate::DATE AS d, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m') END AS doc, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS pub FROM orders),
src AS (SELECT 's' || (o_custkey % 50) AS source, CASE WHEN min(o_custkey % 50) % 2 = 0 THEN strftime(min(o_orderdate), '%Y-%m-%d') END AS spub FROM orders GROUP BY 1),
w AS (SELECT l_orderkey AS key, (l_orderkey + l_linenumber) % 4 AS p, l_linenumber AS o, 2 * l_linenumber + 2 AS h, CASE WHEN l_returnflag = 'R' THEN 'blinking' ELSE 'timed' END AS mode, 60 + trunc(l_quantity)::INT AS c, CASE WHEN l_tax > 0.04 THEN trunc(l_quantity)::INT % 9 + 5 END AS ped FROM lineitem),
ch AS (SELECT key, min(CASE p WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 0 THEN 10 END) AS x FROM w GROUP BY key),
hit AS (SELECT key, arg_min({{'t': printf('%02d:00', h::INT) || ' ' || printf('%02d:30', (h + 4)::INT) || ' ' || mode || ' ' || c || coalesce(' ' || ped, '')}}, (o, mode, c, coalesce(ped, -1))).t AS t FROM w JOIN ch USING (key) WHERE p = x % 10 AND h * 60 <= 600 AND 600 < h * 60 + 270 GROUP BY key),
sm AS (SELECT key, count(*) AS n, min(c) FILTER (mode = 'timed') AS c0, max(c) FILTER (mode = 'timed') AS c1, min(ped) FILTER (mode = 'timed') AS p0, max(ped) FILTER (mode = 'timed') AS p1, bool_or(p IN (2, 3)) AS sun FROM w GROUP BY key),
pub AS (SELECT junction, lk.key::VARCHAR AS id, 'published' AS kind, 'BTP timing sheet — ' || lk.source AS source, coalesce(n, 0)::INT AS windows, coalesce(t, '') AS applicable,
  CASE WHEN x IS NULL THEN 'No readable plan for this day type' WHEN t IS NULL THEN 'Outside every published window (signals commonly flash overnight)' WHEN x = 10 THEN 'Weekday plan assumed — no Sunday plan published' END AS note, doc AS document_date, coalesce(pub, spub) AS published_at, link, lk.passed,
  CASE WHEN link = 'verified' THEN rb END AS reviewer, CASE WHEN link IN ('verified', 'deactivated') THEN link WHEN passed THEN 'pre_validated' ELSE 'awaiting_review' END AS verified, CASE WHEN link = 'verified' THEN 'reviewer-linked' ELSE tier END AS tier, CASE WHEN link <> 'verified' THEN score END AS score, flags, link = 'verified' AS affects,
  concat_ws(' · ', coalesce(n, 0) || CASE WHEN n = 1 THEN ' window' ELSE ' windows' END, CASE WHEN c0 IS NOT NULL THEN 'C ' || CASE WHEN c0 = c1 THEN c0::VARCHAR ELSE c0 || '–' || c1 END || ' s' END, CASE WHEN lk.key % 3 <> 0 AND lk.key % 5 > 0 THEN (lk.key % 5) || ' phase columns' END,
    CASE WHEN p0 IS NOT NULL THEN 'pedestrian stage ' || CASE WHEN p0 = p1 THEN p0::VARCHAR ELSE p0 || '–' || p1 END || ' s' END, CASE WHEN sun THEN 'separate Sunday plan' END) AS summary, hint, NULL::INT AS page, NULL AS quote, (lk.key % 10) / 10 AS confidence
  FROM lk JOIN o USING (key) LEFT JOIN src ON src.source = lk.source LEFT JOIN ch USING (key) LEFT JOIN hit USING (key) LEFT JOIN sm USING (key)),
his AS (SELECT p_partkey % 211, p_partkey::VARCHAR, 'historical', CASE WHEN src.source IS NOT NULL THEN '{claim_rows.LONG_NAME}' || src.source END, NULL, '', 'No timing values — the document mentions the junction without a cycle or phase table', NULL, spub, 'h', FALSE, NULL, 'not_applicable', CASE p_partkey % 3 WHEN 0 THEN 'strong' ELSE 'moderate' END, p_size / 50.0::DOUBLE,
  CASE p_partkey % 3 WHEN 1 THEN 'possible_mention' ELSE '' END, FALSE, 'planning mention · page ' || (p_partkey % 9), NULL, (p_partkey % 9)::INT, 'q' || p_partkey, NULL FROM part LEFT JOIN src ON src.source = 's' || (p_partkey % 50) WHERE p_partkey % 5 <> 0 AND p_partkey % 3 < 2),
al AS (SELECT *, coalesce(document_date, published_at) AS effective FROM (SELECT * FROM pub UNION ALL SELECT * FROM his)),
dt AS (SELECT *, {_AGE.format(d="(CASE WHEN len(effective) = 7 THEN effective || '-01' ELSE effective END)::DATE")}::INT AS a FROM al)
SELECT junction, id, kind, source, windows, applicable, note, document_date, published_at, CASE WHEN source IS NOT NULL THEN '2024-01-02' END AS retrieved_at, CASE WHEN kind = 'historical' THEN 'historical' ELSE {_STATUS.format(a="age")} END AS currency, effective, age, reviewer, verified, tier, round(score, 6) AS score, flags, affects, summary, hint, page, quote, confidence,
row_number() OVER (PARTITION BY junction ORDER BY list_position(['live', 'published', 'historical'], kind), list_position(['verified', 'pre_validated', 'awaiting_review', 'deactivated', 'not_applicable', 'rejected'], verified), coalesce(score, 0) DESC, id)::INT AS rank FROM (SELECT *, CASE WHEN effective IS NOT NULL THEN a END AS age FROM dt)""",
    "mention_counts": "SELECT p_partkey % 211 AS junction, count(*) AS mentions FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 < 2 GROUP BY 1",
    "stale_sources": f"SELECT * FROM (SELECT o_orderkey AS source, CASE WHEN o_orderkey % 4 > 1 THEN 'undated' WHEN {_AGE.format(d='o_orderdate::DATE')} > 365 THEN 'stale' END AS status FROM orders) WHERE status IS NOT NULL",
    "weak_matches": _STOOD + " SELECT source, count(*) AS n, count(*) FILTER (best IS NULL) AS unmatched FROM blk WHERE tier IN ('weak', 'none') GROUP BY source",
    "ranking_prior": _STOOD + """, w AS (SELECT hint, trunc(l_quantity)::INT AS q, 2 * trunc(l_quantity)::INT + 30 AS c FROM lineitem JOIN ver ON ver.key = l_orderkey),
g AS (SELECT hint, c::DOUBLE AS c, list_filter([CASE WHEN q = 10 AND FALSE THEN NULL ELSE q END, q + 20, 10], lambda x: TRUE) AS ph, q FROM w),
p AS (SELECT hint, c, list_filter(list_transform([1, 2, 3], lambda i: {'p': ph[i], 'i': i}), lambda x: x.p > 0) AS pos FROM g),
k AS (SELECT hint, c, list_filter(pos, lambda x: x.p < c AND NOT (len(pos) >= 3 AND list_min(pos).p <= 15 AND list_min(pos).p <= 0.12 * c AND x.i = list_min(pos).i)) AS v FROM p),
m AS (SELECT hint, list_sum(list_transform(v, lambda x: x.p * pow(c - x.p, 2) / (2 * c))) / list_sum(list_transform(v, lambda x: x.p)) AS mean, list_sum(list_transform(v, lambda x: x.p * (c - x.p) / c)) / list_sum(list_transform(v, lambda x: x.p)) AS stop FROM k WHERE len(v) > 0)
SELECT hint, round(list_sort(list(mean))[count(*) // 2 + 1], 9) AS mean, round(list_sort(list(stop))[count(*) // 2 + 1], 9) AS p_stop FROM m GROUP BY hint""",
    "timing_signatures": """SELECT l_orderkey AS junction, md5(string_agg('{"day_type":"all_days","start":"' || printf('%02d:00', l_linenumber) || '","end":"24:00","phases":"[' || trunc(l_quantity)::INT || ',10]","cycle_s":' || (trunc(l_quantity)::INT + 10) || '}', '|' ORDER BY '{"day_type":"all_days","start":"' || printf('%02d:00', l_linenumber) || '","end":"24:00","phases":"[' || trunc(l_quantity)::INT || ',10]","cycle_s":' || (trunc(l_quantity)::INT + 10) || '}')) AS sig FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1""",
    "ingest_status": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 OR (o_orderkey % 3 = 2 AND o_orderkey % 4 = 2) THEN 'undated' WHEN date_diff('day', o_orderdate::DATE, DATE '{_AS_OF}') <= 180 THEN 'current' WHEN date_diff('day', o_orderdate::DATE, DATE '{_AS_OF}') <= 365 THEN 'aging' ELSE 'stale' END AS status,
coalesce(list_max(list_slice([5, 5, 4, 3, 2, 1], o_orderkey % 6 + 1, o_orderkey % 6 + o_custkey % 3)), 1)::INT AS importance FROM orders""",
    "ingest_tallies": _STOOD + """, a AS (SELECT 'tier' AS what, tier AS value FROM blk UNION ALL SELECT 'hint', hint FROM blk UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR FROM orders UNION ALL SELECT 'flags', unnest(string_split(flags, ',')) FROM blk WHERE flags <> '') SELECT what, value, count(*) AS n FROM a GROUP BY ALL""",
}
