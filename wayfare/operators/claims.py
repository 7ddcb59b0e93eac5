"""Timing claims as documents: what a source states about a junction, with its windows and where it comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions import clock, formats
from wayfare.operators import links, plans

#: The rule of currency, and the beginning of source names with what is shown instead.
RULE = "currency-v1"
LONG_NAME, SHORT_NAME = "Bengaluru City Traffic Police, Signal Timings Data - ", "BTP timing sheet — "
FRESH_S = 30

_WINDOW = "struct<day_type:string,start:string,end:string,mode:string,cycle_s:int,phases:array<int>,pedestrian_phase_s:int,consistent:boolean>"
_LIVE = "struct<junction_id:string,intersection_id:string,approach:string,state:string,countdown_s:int,observed_at:bigint,received_at:bigint,freshness_s:double,source:string,license:string>"
#: Every field of a claim beside its junction, in order, with its type.
FIELDS = {
    "id": "string", "kind": "string", "source": "struct<id:string,name:string,publisher:string,portal:string,url:string,license:string>", "junction_label": "string",
    "windows": f"array<{_WINDOW}>", "applicable_window": _WINDOW, "applicable_note": "string", "document_date": "string", "published_at": "string", "retrieved_at": "string",
    "currency": "struct<status:string,effective_date:string,effective_date_source:string,age_days:int,label:string,rule:string>",
    "verification": "struct<status:string,by:string,at:string,label:string>", "match": "struct<tier:string,score:double>", "quality_flags": "array<string>", "affects_recommendations": "boolean",
    "summary": "string", "control_type_hint": "string", "page": "int", "quote": "string", "phase_labels": "array<string>", "parse_confidence": "double", "live": _LIVE,
}


def _iso(ts: Column) -> Column:
    """An instant in the world's clock, to the millisecond."""
    plain = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=clock.epoch(ts))
    return F.date_format(plain, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _claim(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """The fields given and the others null; structs are made up by place."""
    return rows.select("junction", *[fields.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in FIELDS.items()])


def _source(id_, name, publisher, portal, url, licence) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip((id_, name, publisher, portal, url, licence), ("id", "name", "publisher", "portal", "url", "license"), strict=True)])


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is worked out once a row, however often it is used."""
    return rows.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def with_currency(rows: DataFrame, document: Column, portal: Column, as_of: Column, historical: bool = False) -> DataFrame:
    """rows with _currency, struct(status, effective_date, effective_date_source, age_days, label, rule) of a dated document."""
    got = _once(_once(rows, "_d", clock.partial_date(document)), "_p", clock.partial_date(portal))
    got = _once(got, "_c", clock.dated_currency(F.col("_d"), F.col("_p"), as_of, F.lit(True) if historical else None))
    c = F.col("_c")
    got = _once(got, "_dated", F.when(c["source"] == "document", document).when(c["source"] == "portal", F.substring(portal, 1, 10)))
    dated = F.col("_dated")
    label = formats.currency_label(c["status"], dated, c["source"], c["age_days"])
    full = F.struct(c["status"].alias("status"), dated.alias("effective_date"), c["source"].alias("effective_date_source"), c["age_days"].alias("age_days"), label.alias("label"), F.lit(RULE).alias("rule"))
    return _once(got, "_currency", full)


def window_lists(windows: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    """(key, windows, applicable, mode, assumed) of every key: its windows in the document's order and the one that holds at a moment.

    windows: as in `plans`, with key, ped_s and consistent beside. One block's windows make one row, as in its document.
    """
    shown = F.struct(
        "day_type", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "mode", F.col("cycle_s").cast("int").alias("cycle_s"), F.col("phases").cast("array<int>").alias("phases"),
        F.col("ped_s").cast("int").alias("pedestrian_phase_s"), "consistent",
    )
    lists = windows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("plan_ord", "win_ord", shown.alias("w")))).alias("_all"))
    held = plans.active_windows(keys.select("key").distinct().withColumn("ts", at), windows, "key", at=at).select("key", "plan_ord", "win_ord", F.col("mode").alias("_mode"), "assumed")
    got = held.join(lists, "key", "left")
    one = F.get(F.filter("_all", lambda x: (x["plan_ord"] == F.col("plan_ord")) & (x["win_ord"] == F.col("win_ord"))), F.lit(0))
    every = F.coalesce(F.transform("_all", lambda x: x["w"]), F.array().cast(f"array<{_WINDOW}>"))
    return got.select("key", every.alias("windows"), one["w"].alias("applicable"), F.col("_mode").alias("mode"), "assumed")


def published(rows: DataFrame, blocks: DataFrame, sources: DataFrame, windows: DataFrame, at: Column, as_of: Column) -> DataFrame:
    """Claims of links (`links.verified_links`, `links.candidate_links`) judged at a moment; as_of is the day their age is counted to.

    blocks: key, label, document_date, published_at, retrieved_at, phase_count, phase_labels, parse_confidence. sources: source,
    source_name, publisher, portal, url, license, document_date, published_at, retrieved_at; a block's own dates go before its
    source's. A link whose block or source is not there has nulls in its place. Flat windows cannot show a day plan without windows.
    """
    own = blocks.select("key", "label", *[F.col(c).alias(f"b_{c}") for c in ("document_date", "published_at", "retrieved_at")], "phase_labels", "parse_confidence")
    of = sources.select("source", *[F.col(c).alias(f"s_{c}") for c in ("source_name", "publisher", "portal", "url", "license", "document_date", "published_at", "retrieved_at")])
    counts = blocks.select("key", F.col("phase_count").alias("phases"))
    windows = windows.join(rows.select("key").distinct(), "key", "left_semi")  # blocks without a claim are not read on
    got = rows.join(window_lists(windows, rows, at), "key").join(own, "key", "left").join(of, "source", "left")
    got = got.join(links.plan_summary(windows, counts), "key", "left").join(counts, "key", "left")
    date = lambda c: F.coalesce(f"b_{c}", f"s_{c}")
    got = with_currency(got, date("document_date"), date("published_at"), as_of)
    note = (
        F.when(F.col("mode") == "none", "No readable plan for this day type").when(F.col("mode") == "outside_windows", "Outside every published window (signals commonly flash overnight)")
        .when(F.col("assumed"), "Weekday plan assumed — no Sunday plan published")
    )
    verified = F.col("link") == "verified"
    v = links.verification(F.col("link"), F.col("pre_validated"), F.col("verified_by"))
    bare = F.concat_ws(" · ", F.lit("0 windows"), F.when(F.col("phases") > 0, F.concat(F.col("phases").cast("string"), F.lit(" phase columns"))))
    return _claim(got, {
        "id": F.col("key"), "kind": F.lit("published"), "source": _source(F.col("source"), F.replace(F.col("s_source_name"), F.lit(LONG_NAME), F.lit(SHORT_NAME)), *(F.col(f"s_{c}") for c in ("publisher", "portal", "url", "license"))),
        "junction_label": F.col("label"), "windows": F.col("windows"), "applicable_window": F.col("applicable"), "applicable_note": note,
        "document_date": date("document_date"), "published_at": date("published_at"), "retrieved_at": date("retrieved_at"), "currency": F.col("_currency"),
        "verification": F.struct(v["status"], F.col("verified_by"), F.col("verified_at").cast("string"), v["label"]),
        "match": F.struct(F.when(verified, "reviewer-linked").otherwise(F.col("tier")), F.when(~verified, F.col("score"))), "quality_flags": F.coalesce("flags", F.array().cast("array<string>")),
        "affects_recommendations": verified, "summary": F.coalesce("summary", bare), "control_type_hint": F.col("hint"), "phase_labels": F.col("phase_labels"), "parse_confidence": F.col("parse_confidence"),
    })


def historical(evidence: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Claims of mentions matched well enough; evidence: id, source, mention, claim_type, page, quote, best, tier, similarity."""
    e = evidence.filter("best IS NOT NULL AND tier IN ('strong', 'moderate')").withColumn("junction", F.col("best"))
    got = e.join(sources.select("source", "source_name", "publisher", "portal", "url", "license", "document_date", "published_at", "retrieved_at"), "source", "left")
    got = with_currency(got, F.col("document_date"), F.col("published_at"), as_of, True)
    return _claim(got, {
        "id": F.col("id"), "kind": F.lit("historical"), "source": _source(*map(F.col, ("source", "source_name", "publisher", "portal", "url", "license"))), "junction_label": F.col("mention"),
        "applicable_note": F.lit("No timing values — the document mentions the junction without a cycle or phase table"),
        **{c: F.col(c) for c in ("document_date", "published_at", "retrieved_at", "page", "quote")}, "currency": F.col("_currency"),
        "verification": F.struct(F.lit("not_applicable"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("Historical mention — matched by name, not a timing claim")),
        "match": F.struct(F.col("tier"), F.col("similarity")), "quality_flags": F.when(F.col("tier") == "moderate", F.array(F.lit("possible_mention"))).otherwise(F.array().cast("array<string>")),
        "affects_recommendations": F.lit(False), "summary": F.concat(F.replace(F.col("claim_type"), F.lit("_"), F.lit(" ")), F.lit(" · page "), F.col("page").cast("string")),
    })


def live(states: DataFrame, now: Column) -> DataFrame:
    """Claims of feed samples; states: junction, feed_junction, source, license, approach, state, countdown_s, observed, received (timestamps)."""
    seconds = F.greatest(F.lit(0.0), clock.epoch(now) - clock.epoch(F.col("observed")))
    fresh = clock.epoch(now) - clock.epoch(F.col("observed")) <= FRESH_S
    whole = F.floor(seconds + 0.5).cast("string")
    told = F.when(fresh, F.concat(F.lit("Live — observed "), whole, F.lit(" s ago"))).otherwise(F.concat(F.lit("Stale live sample — observed "), whole, F.lit(f" s ago (> {FRESH_S} s); not shown as current")))
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    late = clock.epoch(F.col("received")) - clock.epoch(F.col("observed"))
    sample = F.struct("feed_junction", F.col("junction").cast("string"), "approach", "state", "countdown_s", ms("observed"), ms("received"), late, "source", "license")
    return _claim(states, {
        "id": F.concat_ws(":", F.lit("live"), "source", "feed_junction"), "kind": F.lit("live"), "source": _source(F.col("source"), F.col("source"), F.col("source"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("license")),
        "junction_label": F.col("feed_junction"), "applicable_note": F.coalesce(F.concat(F.lit("Approach "), F.col("approach")), F.lit("Junction-wide state")), "retrieved_at": _iso(F.col("received")),
        "currency": F.struct(F.when(fresh, "live").otherwise("stale"), _iso(F.col("observed")), F.lit("document"), F.lit(0), told, F.lit(RULE)),
        "verification": F.struct(F.when(fresh, "verified").otherwise("not_applicable"), F.col("source"), ms("observed").cast("string"), F.when(fresh, "Authorised live feed — current state").otherwise("Live sample too old to show as current")),
        "quality_flags": F.when(fresh, F.array().cast("array<string>")).otherwise(F.array(F.lit("stale_live_sample"))), "affects_recommendations": fresh,
        "summary": F.concat(F.col("state"), F.coalesce(F.concat(F.lit(" · "), F.col("countdown_s").cast("string"), F.lit(" s")), F.lit(""))), "live": sample,
    })


def documents(*parts: DataFrame) -> DataFrame:
    """All claims with their rank at their junction: by kind, verification, then score; ties by id."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    at = lambda table, c: F.array_position(F.array(*map(F.lit, table)), F.col(c))
    order = Window.partitionBy("junction").orderBy(at(links.KIND_ORDER, "kind"), at(links.VERIFIED_ORDER, "verification.status"), F.desc(F.coalesce("match.score", F.lit(0.0))), "id")
    return rows.withColumn("rank", F.row_number().over(order))
