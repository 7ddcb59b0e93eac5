"""Plan blocks, reviewers' decisions and junctions: links, coverage, claims.

blocks: key, ord, source, name, tier, best, combined (best match and its score), proposed,
passed, hint (control type), flags. decisions: key, decision, to, by, at. Only an accepted
decision makes a block count; a rule set proposes and never accepts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions import clock, formats

#: Categories of coverage in order of priority, and those with timing data.
CATEGORIES = ["live_timing", "verified_published", "published_awaiting_review", "control_type_known", "location_only", "unknown"]
WITH_TIMING = CATEGORIES[:3]
#: Order of claims by kind, then by verification.
KIND_ORDER = ["live", "published", "historical"]
VERIFIED_ORDER = ["verified", "pre_validated", "awaiting_review", "deactivated", "not_applicable", "rejected"]
LEAST_SCORE = 0.3


def with_status(blocks: DataFrame, decisions: DataFrame) -> DataFrame:
    """blocks with status, target, by, at and pre_validated."""
    d = decisions.select("key", "decision", "to", "by", "at")
    both = blocks.join(d, "key", "left")
    status = F.when(F.col("decision") == "accepted", "verified").otherwise(F.coalesce("decision", F.lit("candidate")))
    target = (
        F.when(F.col("decision") == "accepted", F.col("to")).when(F.col("decision").isNotNull(), F.coalesce("to", "proposed"))
        .otherwise(F.coalesce("proposed", "best"))
    )
    return both.withColumn("status", status).withColumn("target", target).withColumn("pre_validated", F.coalesce("passed", F.lit(False))).drop("decision", "to")


def _link(rows: DataFrame, to: str, status: Column, score: Column) -> DataFrame:
    verified = status == "verified"
    return rows.select(
        F.col(to).alias("junction"), "key", "ord", "source", "name", "hint", "tier", "flags", "pre_validated", status.alias("link"), score.cast("double").alias("score"),
        F.when(verified, F.col("by")).alias("verified_by"), F.when(verified, F.col("at")).alias("verified_at"),
    )


def verified_links(stood: DataFrame) -> DataFrame:
    """(junction, key, ...) of accepted blocks."""
    return _link(stood.filter("status = 'verified' AND target IS NOT NULL"), "target", F.lit("verified"), F.lit(1.0))


def candidate_links(stood: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(junction, key, ...) of plausible blocks that await review: shown, never used."""
    rows = stood.filter("status NOT IN ('verified', 'rejected') AND best IS NOT NULL").filter(F.col("combined") >= least)
    return _link(rows, "best", F.when(F.col("status") == "deactivated", "deactivated").otherwise("candidate"), F.col("combined"))


def all_links(stood: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Both kinds with their rank at their junction: accepted first, then those that passed the rules, then by score.

    An accepted block that was also matched to another junction is no candidate there.
    """
    rows = verified_links(stood).unionByName(candidate_links(stood, least))
    order = Window.partitionBy("junction").orderBy(F.desc(F.col("link") == "verified"), F.desc("pre_validated"), F.desc("score"), "ord")
    return rows.withColumn("rank", F.row_number().over(order))


def preference(hint: Column) -> Column:
    """Fixed timing before actuated before all else."""
    return F.when(hint.isin("fixed", "fixed_coordinated"), 0).when(hint == "vehicle_actuated", 1).otherwise(2)


def plan_inputs(stood: DataFrame, conflicting: DataFrame) -> DataFrame:
    """The accepted block that serves each junction, and whether accepted documents disagree there.

    conflicting: (target, among_verified).
    """
    rows = verified_links(stood)
    best = rows.groupBy("junction").agg(F.min_by(F.struct("key", "source", "hint", "verified_by", "verified_at"), F.struct(preference(F.col("hint")), "ord")).alias("b"), F.count("*").alias("links"))
    c = conflicting.select(F.col("target").alias("junction"), "among_verified")
    return best.join(c, "junction", "left").select("junction", "b.*", "links", F.coalesce("among_verified", F.lit(False)).alias("conflicting"))


def status_counts(stood: DataFrame) -> DataFrame:
    """One row: blocks by standing."""
    n = lambda c: F.count_if(c)
    s = F.col("status")
    open_ = ~s.isin("verified", "rejected", "deactivated")
    return stood.agg(
        F.count("*").alias("total"), n(s == "verified").alias("verified"), n(s == "rejected").alias("rejected"), n(s == "deactivated").alias("deactivated"),
        n(open_).alias("candidates"), n(open_ & F.col("pre_validated")).alias("pre_validated"), F.count_distinct(F.when(s == "verified", F.col("target"))).alias("intersections"),
    )


def weak_match(tier: Column) -> Column:
    return tier.isin("weak", "none")


def stale_sources(sources: DataFrame, as_of: Column) -> DataFrame:
    """(source, status) of documents that are stale or undated; sources: source, document, portal."""
    c = clock.currency(F.col("document"), F.col("portal"), as_of)
    return sources.select("source", c["status"].alias("status")).filter("status IN ('stale', 'undated')")


def covered(junctions: DataFrame, verified: DataFrame, candidates: DataFrame, live: DataFrame, control: DataFrame, clusters: DataFrame) -> DataFrame:
    """junctions with category and the flags behind it.

    junctions: junction, control_type, kind; live: junction; control: junction, control_type
    (a reviewer's word); clusters: junction, decision. Every side has a row per junction at
    most after it is made distinct, so each join is a plain equi-join.
    """
    mark = lambda df, name: df.select("junction").distinct().withColumn(name, F.lit(True))
    out = junctions.join(mark(verified, "is_verified"), "junction", "left").join(mark(candidates, "is_candidate"), "junction", "left").join(mark(live, "is_live"), "junction", "left")
    word = control.groupBy("junction").agg(F.min("control_type").alias("word"))
    gone = clusters.filter("decision = 'rejected'").select("junction").distinct().withColumn("gone", F.lit(True))
    out = out.join(word, "junction", "left").join(gone, "junction", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    known = F.coalesce(F.nullif("word", F.lit("unknown")), F.col("control_type")) != "unknown"
    unclear = yes("gone") | (F.col("kind") == "unresolved")
    category = (
        F.when(yes("is_live"), "live_timing").when(yes("is_verified"), "verified_published").when(yes("is_candidate"), "published_awaiting_review")
        .when(known, "control_type_known").when(unclear, "unknown").otherwise("location_only")
    )
    return out.select(*junctions.columns, category.alias("category"), yes("is_verified").alias("is_verified"), yes("is_live").alias("is_live"), F.coalesce("word", "control_type").alias("control"))


def coverage_summary(rows: DataFrame, approaches: str = "approaches") -> DataFrame:
    """One row: each category's count, zero where none, and the sums readers are shown."""
    by = [F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]
    return rows.agg(
        F.count("*").alias("mapped"), *by, F.count_if(F.col("category").isin(WITH_TIMING)).alias("with_timing_data"), F.count_if("is_verified").alias("verified"),
        F.count_if("is_live").alias("live"), F.coalesce(F.sum(approaches), F.lit(0)).alias("approaches"),
    )


def unknown_summary(rows: DataFrame, approaches: str = "approaches") -> DataFrame:
    """The summary before anything is loaded: all unknown, not untimed."""
    zero = [F.lit(0).cast("long").alias(c) for c in CATEGORIES if c != "unknown"]
    return rows.agg(F.count("*").alias("mapped"), F.count("*").alias("unknown"), *zero, F.coalesce(F.sum(approaches), F.lit(0)).alias("approaches"))


def control_split(rows: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row: junctions by control, an accepted document's word before a reviewer's before the map's."""
    hint = F.coalesce("hint", "control")
    got = rows.join(inputs.select("junction", "hint"), "junction", "left").withColumn("hint", hint)
    kind = F.when(F.col("hint").isin("fixed", "fixed_coordinated"), "fixed").when(F.col("hint").isin("vehicle_actuated", "time_of_day", "actuated"), "actuated").when(F.col("hint") == "adaptive", "adaptive").otherwise("unknown")
    return got.agg(*[F.count_if(kind == k).alias(k) for k in ("fixed", "actuated", "adaptive", "unknown")])


def plan_summary(windows: DataFrame, phase_count: DataFrame) -> DataFrame:
    """(key, summary): windows, cycles, phases, pedestrian stage and Sunday plan of each block in words.

    windows: key, day_type, mode, cycle_s, ped_s; phase_count: key, phases.
    """
    timed = (F.col("mode") == "timed") & F.col("cycle_s").isNotNull()
    c, p = F.when(timed, F.col("cycle_s")), F.when(timed, F.col("ped_s"))
    got = windows.groupBy("key").agg(F.count("*").alias("n"), F.min(c).alias("c0"), F.max(c).alias("c1"), F.min(p).alias("p0"), F.max(p).alias("p1"), F.max(F.col("day_type").isin("sunday", "weekend")).alias("sunday"))
    got = got.join(phase_count, "key", "left")
    span = lambda a, b: F.when(F.col(a) == F.col(b), F.col(a).cast("string")).otherwise(F.concat_ws("–", F.col(a).cast("string"), F.col(b).cast("string")))
    parts = [
        F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " window").otherwise(" windows")),
        F.when(F.col("c0").isNotNull(), F.concat(F.lit("C "), span("c0", "c1"), F.lit(" s"))),
        F.when(F.col("phases") > 0, F.concat(F.col("phases").cast("string"), F.lit(" phase columns"))),
        F.when(F.col("p0").isNotNull(), F.concat(F.lit("pedestrian stage "), span("p0", "p1"), F.lit(" s"))),
        F.when(F.col("sunday"), "separate Sunday plan"),
    ]
    return got.select("key", F.concat_ws(" · ", *parts).alias("summary"))


def window_text(start: Column, end: Column, mode: Column, phases: Column, cycle: Column) -> Column:
    """A window in words: its phases and cycle, or that it blinks or cannot be read."""
    span = F.concat(start, F.lit("–"), end)
    cells = F.array_join(F.transform(phases, lambda p: F.coalesce(p.cast("string"), F.lit("?"))), ", ")
    timed = F.concat(span, F.lit(" phases ["), cells, F.lit("] · C "), cycle.cast("string"), F.lit(" s"))
    return F.when(mode == "blinking", F.concat(span, F.lit(" blinking (no control)"))).when((mode == "timed") & cycle.isNotNull(), timed).otherwise(F.concat(span, F.lit(" unreadable")))


def verification(link: Column, pre_validated: Column, by: Column) -> Column:
    """struct(status, label) of a link."""
    said = F.concat(F.lit("Accepted review link"), F.coalesce(F.concat(F.lit(" · "), by), F.lit("")))
    status = F.when(link.isin("verified", "rejected", "deactivated"), link).otherwise(F.when(pre_validated, "pre_validated").otherwise("awaiting_review"))
    label = (
        F.when(link == "verified", said).when(link == "rejected", "Rejected by reviewer — not this junction").when(link == "deactivated", "Deactivated by reviewer — kept on file")
        .when(pre_validated, "Passes rule set v1 — awaiting reviewer confirmation").otherwise("Awaiting review")
    )
    return F.struct(status.alias("status"), label.alias("label"))


_CLAIM = ["junction", "id", "kind", "status", "label", "tier", "score", "currency", "note", "flags", "affects"]


def published_claims(rows: DataFrame, active: DataFrame, dates: DataFrame, as_of: Column) -> DataFrame:
    """Claims of links; active: key, mode, assumed; dates: key, document, portal."""
    v = verification(F.col("link"), F.col("pre_validated"), F.col("verified_by"))
    note = (
        F.when(F.col("mode") == "none", "No readable plan for this day type").when(F.col("mode") == "outside_windows", "Outside every published window (signals commonly flash overnight)")
        .when(F.col("assumed"), "Weekday plan assumed — no Sunday plan published")
    )
    verified = F.col("link") == "verified"
    got = rows.join(active.select("key", "mode", "assumed"), "key", "left").join(dates, "key", "left").withColumn("v", v)
    return got.select(
        "junction", F.col("key").cast("string").alias("id"), F.lit("published").alias("kind"), "v.status", "v.label", F.when(verified, "reviewer-linked").otherwise(F.col("tier")).alias("tier"),
        F.when(~verified, F.col("score")).alias("score"), clock.currency(F.col("document"), F.col("portal"), as_of)["status"].alias("currency"), note.alias("note"), "flags", verified.alias("affects"),
    )


def historical_claims(evidence: DataFrame) -> DataFrame:
    """Mentions matched well enough: evidence only, never a timing. evidence: id, best, tier, similarity."""
    got = evidence.filter("best IS NOT NULL AND tier IN ('strong', 'moderate')")
    return got.select(
        F.col("best").alias("junction"), F.col("id").cast("string").alias("id"), F.lit("historical").alias("kind"), F.lit("not_applicable").alias("status"),
        F.lit("Historical mention — matched by name, not a timing claim").alias("label"), "tier", F.col("similarity").cast("double").alias("score"), F.lit("historical").alias("currency"),
        F.lit("No timing values — the document mentions the junction without a cycle or phase table").alias("note"),
        F.when(F.col("tier") == "moderate", F.array(F.lit("possible_mention"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.lit(False).alias("affects"),
    )


def live_claims(states: DataFrame, now: Column) -> DataFrame:
    """Claims of feed samples; states: junction, source, approach, observed (timestamp)."""
    age = clock.epoch(now) - clock.epoch(F.col("observed"))
    fresh = age <= 30
    return states.select(
        "junction", F.concat_ws(":", F.lit("live"), "source", "junction").alias("id"), F.lit("live").alias("kind"), F.when(fresh, "verified").otherwise("not_applicable").alias("status"),
        F.when(fresh, "Authorised live feed — current state").otherwise("Live sample too old to show as current").alias("label"), F.lit(None).cast("string").alias("tier"), F.lit(None).cast("double").alias("score"),
        formats.live_currency(age).alias("currency"), F.coalesce(F.concat(F.lit("Approach "), F.col("approach")), F.lit("Junction-wide state")).alias("note"),
        F.when(fresh, F.array().cast("array<string>")).otherwise(F.array(F.lit("stale_live_sample"))).alias("flags"), fresh.alias("affects"),
    )


def claims(*parts: DataFrame) -> DataFrame:
    """All claims with their rank at their junction: by kind, verification, then score; ties by id, then note."""
    rows = parts[0].select(_CLAIM)
    for p in parts[1:]:
        rows = rows.unionByName(p.select(_CLAIM))
    at = lambda table, c: F.array_position(F.array(*map(F.lit, table)), F.col(c))
    order = Window.partitionBy("junction").orderBy(at(KIND_ORDER, "kind"), at(VERIFIED_ORDER, "status"), F.desc(F.coalesce("score", F.lit(0.0))), "id", "note")
    return rows.withColumn("rank", F.row_number().over(order))


def mention_counts(evidence: DataFrame) -> DataFrame:
    return historical_claims(evidence).groupBy("junction").agg(F.count("*").alias("mentions"))


def flattened(sources: DataFrame) -> DataFrame:
    """One row for each window of nested plan documents, with its places in them.

    sources: source, junctions array<struct<key, day_plans: array<struct<day_type, windows: array<struct<...>>>>>>.
    """
    blocks = sources.select("source", F.posexplode("junctions").alias("block", "j"))
    plans = blocks.select("source", "block", F.col("j.key").alias("key"), F.posexplode("j.day_plans").alias("plan_ord", "d"))
    return plans.select("source", "block", "key", "plan_ord", F.col("d.day_type").alias("day_type"), F.posexplode("d.windows").alias("win_ord", "w")).select("source", "block", "key", "plan_ord", "day_type", "win_ord", "w.*")


def tallies(rows: DataFrame, columns: list[str], lists: list[str] = ()) -> DataFrame:
    """(what, value, n): counts of each value of some columns, and of each element of some arrays, in one scan."""
    each = [F.array(F.struct(F.lit(c).alias("what"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value"))) for c in columns]

    def elements(c: str) -> Column:
        return F.transform(F.col(c), lambda x: F.struct(F.lit(c).alias("what"), x.cast("string").alias("value")))

    each += map(elements, lists)
    return rows.select(F.inline(F.concat(*each))).groupBy("what", "value").agg(F.count("*").alias("n"))


def junction_place(lat: Column, lon: Column, id_: Column, name: Column) -> Column:
    """The place of a post about a junction itself."""
    return F.struct(lon.alias("lng"), lat.alias("lat"), F.lit("junction").alias("source"), F.lit(None).cast("long").alias("accuracyM"), F.struct(id_.alias("id"), name.alias("name"), F.lit(0).alias("distanceM")).alias("junction"))
