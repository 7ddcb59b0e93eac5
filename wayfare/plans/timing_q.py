"""Timing queries: events as encounters at junctions, with a few plan windows each."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.functions import clock
from wayfare.operators import models, plans, predict, stats
from wayfare.session import table
from wayfare.streaming import residuals

#: junction kind (junction % 3), plan_ord, day_type, win_ord, start, end, mode, phases, cycle, ped
PLANS = [
    (0, 0, "weekday_default", 0, "07:00", "08:00", "timed", [75, 70, 10], 155, None),
    (0, 0, "weekday_default", 1, "08:00", "11:30", "timed", [110, 100, 15], 225, 2),
    (0, 0, "weekday_default", 2, "11:30", "16:00", "blinking", [], None, None),
    (0, 0, "weekday_default", 3, "16:00", "24:00", "timed", [60, 0, 40, 20], 120, None),
    (0, 1, "sunday", 0, "07:00", "23:00", "timed", [70, 55, 15], 140, 2),
    (1, 0, "all_days", 0, "00:00", "12:00", "timed", [40, 20, 30, 10], 100, None),
    (1, 0, "all_days", 1, "12:00", "22:00", "timed", [50, 20, 30, 10], 110, None),
    (2, 0, "weekday_default", 0, "06:00", "22:30", "timed", [45, 45], 90, None),
    (2, 1, "saturday", 0, "09:00", "18:00", "timed", [30, 30], 60, None),
]
_LIT = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def windows(spark, junctions: int = 7):
    """The plans' windows; a junction's kind is its number modulo 3, and 3 and more beyond the sevenths have none."""
    rows = ", ".join("(" + ", ".join(_LIT(v) if not isinstance(v, list) else "array(" + ", ".join(map(str, v)) + ")" if v else "cast(array() as array<int>)" for v in r) + ")" for r in PLANS)
    t = spark.sql(f"SELECT * FROM VALUES {rows} AS t(kind3, plan_ord, day_type, win_ord, start, end, mode, phases, cycle_s, ped)")
    return t.withColumn("junction", F.explode(F.expr(f"filter(sequence(0, {junctions - 1}), j -> j % 3 = kind3)"))).drop("kind3")


def encounters(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("journey"), (F.col("user_id") % 7).cast("int").alias("junction"), F.col("value").alias("delay"),
        F.col("event_type").isin("error", "click").alias("stopped"), (F.lit(0.5) + (k % 50) / F.lit(100.0)).alias("quality"),
    )


_ENC = """enc AS (SELECT event_id, ts, user_id AS journey, (user_id % 7)::INT AS junction, value AS delay, event_type IN ('error', 'click') AS stopped,
  0.5::DOUBLE + ((props->>'$.k')::INT % 50) / 100.0::DOUBLE AS quality,
  ((floor(epoch(ts))::BIGINT + 19800) % 86400) AS sod, ((floor(epoch(ts))::BIGINT + 19800) // 86400 + 3) % 7 AS dow FROM events)"""
_WIN = "win AS (SELECT *, (split_part(st, ':', 1)::INT * 60 + split_part(st, ':', 2)::INT) AS s, (split_part(en, ':', 1)::INT * 60 + split_part(en, ':', 2)::INT) AS e FROM (SELECT unnest(list_filter(range(0, 7), lambda j: j % 3 = kind3)) AS junction, * FROM (VALUES {rows}) AS t(kind3, plan_ord, day_type, win_ord, st, en, mode, phases, cycle_s, ped)))".format(
    rows=", ".join("(" + ", ".join(_LIT(v) if not isinstance(v, list) else f"{v}::INT[]" for v in r) + ")" for r in PLANS)
)
_SERVE = """serve AS (SELECT * FROM (VALUES ('sun', 'sunday', 0), ('sun', 'weekend', 0), ('sun', 'all_days', 0), ('sun', 'holiday', 0), ('sun', 'weekday_default', 1), ('sat', 'saturday', 0), ('sat', 'weekend', 0), ('sat', 'all_days', 0), ('sat', 'weekday_default', 1), ('week', 'weekday_default', 0), ('week', 'all_days', 0)) AS v(kind, day_type, rk))"""
_ACTIVE = f"""WITH {_ENC}, {_WIN}, {_SERVE},
day AS (SELECT junction, kind, arg_min({{'p': plan_ord, 'd': day_type, 'r': rk}}, (rk, plan_ord)) AS c FROM win JOIN serve USING (day_type) GROUP BY junction, kind),
ask AS (SELECT *, CASE dow WHEN 6 THEN 'sun' WHEN 5 THEN 'sat' ELSE 'week' END AS kind FROM enc),
act AS (SELECT ask.*, coalesce(day.c.d, 'none') AS day_type, coalesce(day.c.r = 1 AND kind = 'sun', FALSE) AS assumed,
  CASE WHEN day.c IS NULL THEN 'none' ELSE coalesce(win.mode, 'outside_windows') END AS mode, win.win_ord, win.cycle_s, win.phases, win.ped
  FROM ask LEFT JOIN day USING (junction, kind) LEFT JOIN win ON win.junction = ask.junction AND win.plan_ord = day.c.p AND sod // 60 >= win.s AND sod // 60 < win.e)"""


def interval_join(spark, sf_dir):
    got = plans.active_windows(encounters(spark, sf_dir), windows(spark))
    return got.select("event_id", "day_type", "assumed", "mode", "win_ord", "cycle_s")


def plan_prior(spark, sf_dir):
    """Delay prior of each encounter's window: greens of vehicle phases, weighted by the green."""
    w = windows(spark)
    got = plans.active_windows(encounters(spark, sf_dir), w).filter("mode = 'timed'")
    got = got.join(plans.window_priors(w), ["junction", "plan_ord", "win_ord"])
    six = [F.round(c, 6).alias(c) for c in ("mean", "p_stop", "low", "high")]
    return got.select("event_id", F.size("greens").alias("n_phases"), *six, "p10", "p25", "p50", "p75", "p90")


def hourly_summary(spark, sf_dir):
    got = stats.hourly(encounters(spark, sf_dir))
    return got.select("day_type", "hour", "n", "p10", "p50", "p90", F.round("p_stop", 9).alias("p_stop"))


def weighted_quantile(spark, sf_dir):
    qs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    return stats.weighted_quantiles(encounters(spark, sf_dir), ["junction"], "delay", "quality", qs)


def kernel_estimate(spark, sf_dir):
    """Each junction at four times of one Tuesday."""
    e = encounters(spark, sf_dir)
    at = F.explode(F.array(*[F.expr(f"TIMESTAMP_NTZ '2024-01-30 {h:02d}:30:00'") for h in (2, 6, 12, 18)]))
    q = e.select("junction").distinct().withColumn("t", at).withColumn("qid", F.col("junction") * 100 + F.hour("t"))
    got = stats.kernel_estimates(e, q, F.expr(_NOW))
    return got.select("qid", "n", *[F.round(c, 6).alias(c) for c in ("mean_delay", "p_stop", "n_eff", "mean_stop")], "p10", "p50", "p90")


def scores(spark, sf_dir):
    """Brier, log loss, pinball and calibration error of a stop forecast by hour."""
    e = encounters(spark, sf_dir)
    p = e.withColumn("hour", F.floor(clock.second_of_day(F.col("ts")) / 3600)).withColumn("y", F.col("stopped").cast("double"))
    p = p.withColumn("p", (F.col("hour") + 1) / F.lit(26.0))
    one = p.agg(stats.brier(F.col("p"), F.col("y")).alias("brier"), stats.log_loss(F.col("p"), F.col("y")).alias("logloss"), F.avg(stats.pinball(F.col("delay"), F.lit(50.0), 0.9)).alias("pinball"), F.avg(F.abs(F.col("delay") - 50)).alias("mae"))
    both = one.crossJoin(stats.calibration_error(p, "p", "y"))  # one row each
    return both.select(*[F.round(c, 9).alias(c) for c in ("brier", "logloss", "pinball", "mae", "ece")])


def recent_residual(spark, sf_dir):
    """Decayed mean of what delays differ from 50 s, over the last six hours of the table."""
    e = encounters(spark, sf_dir).withColumn("residual", F.col("delay") - 50)
    last = e.agg(F.max("ts").alias("now"))
    got = stats.recent_residuals(e.crossJoin(F.broadcast(last)), ["junction"], F.col("now"), 7200.0)
    return got.select("junction", F.round("adjustment", 9).alias("adjustment"), "recent_n")


def daily_residuals(spark, sf_dir):
    """For each user and midnight, the decayed mean of what delays of the 36 hours before differ from 20 s, by slices of an hour."""
    rows = encounters(spark, sf_dir).select("journey", "ts", (F.col("delay") - 20).alias("residual"), "quality")
    slices = residuals.residual_slices(rows, ["journey"], 43200.0, 3600, 0.01)
    first = F.ceil(clock.epoch(F.col("until")) / clock.DAY_S)
    at = F.explode(F.sequence(first, first + 1)).alias("day")
    got = residuals.residuals_at(slices.select("*", at).withColumn("at", F.timestamp_seconds(F.col("day") * clock.DAY_S)), ["journey", "day"], F.col("at"), 43200.0)
    return got.select("journey", "day", F.round("adjustment", 8).alias("adjustment"), "recent_n")


def offset_fit(spark, sf_dir):
    """The offset of a cycle of 12 s that fits most of each junction's events within 4 s."""
    e = encounters(spark, sf_dir).withColumn("g", F.pmod(clock.epoch(F.col("ts")), F.lit(86400.0)))
    got = stats.offset_fit(e, ["junction"], "g", 12.0, inlying=0.66)
    return got.select("junction", "offset", "n", F.round("cost", 4).alias("cost"), F.round("inliers", 6).alias("inliers"))


def autocorrelation(spark, sf_dir):
    """The strongest lags of stops, in hour bins of each junction."""
    e = encounters(spark, sf_dir).withColumn("h", F.floor(clock.epoch(F.col("ts")) / 3600)).withColumn("y", F.col("stopped").cast("double"))
    return stats.autocorrelation(e, ["junction"], "h", "y", 2, 48).select("junction", "lag", F.round("r", 9).alias("r"))


def green_start_fits(spark, sf_dir):
    """Cycle and offset of stops of each of fifty groups of journeys, as seconds of the day."""
    e = encounters(spark, sf_dir).filter("stopped").withColumn("t", F.pmod(clock.epoch(F.col("ts")), F.lit(86400.0)))
    got = models.start_fits(e.withColumn("group", F.col("journey") % 50), "group", "t")
    return got.select("group", F.round("cycle", 1).alias("cycle"), F.round("offset", 1).alias("offset"), F.round("cost", 4).alias("cost"), F.round("inliers", 6).alias("inliers"))


def cycle_scan(spark, sf_dir):
    """Periodic stop model of each junction against a constant."""
    e = encounters(spark, sf_dir).withColumn("t", F.pmod(clock.epoch(F.col("ts")), F.lit(86400.0))).withColumn("y", F.col("stopped").cast("double"))
    return models.cycles(e, "junction", "t", "y", "journey")


def cycle_bootstrap(spark, sf_dir):
    """How sure the cycle of stops is at each junction, with its journeys drawn anew twelve times."""
    e = encounters(spark, sf_dir).filter("stopped").withColumn("t", F.pmod(clock.epoch(F.col("ts")), F.lit(86400.0)))
    return models.bootstrap(e, "junction", "t", "journey", rounds=12)


def prior_levels(spark, sf_dir):
    """Level and confidence of each encounter's prior, by plan and kind of junction."""
    got = plans.active_windows(encounters(spark, sf_dir), windows(spark))
    control = F.when(F.col("junction") % 3 == 0, "fixed").when(F.col("junction") % 3 == 1, "fixed_coordinated").otherwise("vehicle_actuated")
    source = F.when(F.col("win_ord") == 1, "sum_of_phases").otherwise("printed")
    c = predict.prior_confidence(control, source, F.col("assumed"), F.col("junction") % 2 == 0, F.lit("aging"), F.col("junction") == 5)
    greens = plans.vehicle_phases(F.col("phases"), F.col("cycle_s"), F.col("ped"), F.col("mode"))
    lev = predict.level(F.col("journey"), F.col("junction") < 6)
    return got.select("event_id", lev.alias("level"), F.round(F.when(greens.isNotNull(), c), 9).alias("confidence"))


def passages(spark, sf_dir):
    """Encounters at some hundred junctions, a few of them busy; those that stopped resume by the delay."""
    k = F.get_json_object("props", "$.k").cast("int") % 50
    u = F.col("user_id")
    junction = F.when(k < 4, 100 + F.col("event_id") % 60).when(u % 3 == 0, u % 7).otherwise(10 + u % 40).cast("int")
    stopped = F.col("event_type").isin("error", "click")
    resumed = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 100).cast("long") * 10_000)
    return table(spark, sf_dir, "events").select(
        junction.alias("junction"), "ts", F.col("value").alias("delay"), stopped.alias("stopped"), (F.lit(0.5) + k / F.lit(100.0)).alias("quality"), F.when(stopped, resumed).alias("resumed")
    )


def predictions(spark, sf_dir):
    """The prediction that stands for each junction at four times of one day."""
    e = passages(spark, sf_dir)
    w = windows(spark, 160).withColumn("cycle_source", F.when(F.col("win_ord") == 1, "sum_of_phases").otherwise("printed"))
    ids = spark.range(160).select(F.col("id").cast("int").alias("junction"))
    j = F.col("junction")
    linked = ids.filter("junction % 4 <> 3").select("junction", F.when(j % 5 < 3, "fixed").otherwise("vehicle_actuated").alias("control"), F.when(j % 2 == 0, "aging").otherwise("current").alias("standing"), (j % 7 == 5).alias("conflict"))
    at = F.explode(F.array(*[F.expr(f"TIMESTAMP_NTZ '2024-01-30 {h:02d}:30:00'") for h in (2, 6, 12, 18)]))
    q = ids.withColumn("t", at).withColumn("qid", (j * 100 + F.hour("t")).cast("long")).withColumn("phase", F.when(j % 2 == 0, 0))
    got = predict.predict(q, e, w, linked, F.expr(_NOW))
    six = [F.round(c, 6).alias(c) for c in ("mean", "p50", "p10", "p25", "p75", "p90", "p_stop", "long_mean", "confidence")]
    return got.select("qid", "level", "n", *six, "cycle_s", "recent_n", F.round("data_age_s", 3).alias("data_age_s"), "mode")


def phase_clock(spark, sf_dir):
    """Each encounter's place in a fixed cycle of two greens, its chances and its wait."""
    e = encounters(spark, sf_dir)
    cycle, offset = F.lit(90.0), (F.col("junction") * 7).cast("double")
    greens = F.array(F.struct(F.lit(0.0).alias("a"), F.lit(25.0).alias("b")), F.struct(F.lit(50.0).alias("a"), F.lit(62.5).alias("b")))
    s = predict.phase_position(F.floor(clock.epoch(F.col("ts")) % 86400).cast("double"), offset, cycle)
    green = predict.is_green(s, greens)
    e = e.withColumn("s", s).withColumn("green", green)
    # a place to the second has one chance, whatever the encounter
    places = e.select("s").distinct().withColumn("p_green", predict.p_green(F.col("s"), 6.0, F.lit(0.0), greens, cycle))
    waits = predict.phase_waits(e.select("s").distinct().withColumn("cycle", cycle).withColumn("green", F.lit(25.0)), ["s"], 9.0)
    got = e.join(places, "s").join(waits, "s")
    six = [F.round(c, 6).alias(c) for c in ("p_green", "mean", "p_stop")]
    return got.select("event_id", "s", "green", predict.p_no_stop(F.col("green")).alias("p_no_stop"), predict.expected_wait(F.col("s"), greens, cycle).alias("wait"), *six, "p10", "p90")


def random_numbers(spark, sf_dir):
    """The seeded generator, its normal numbers and the hold-out by name, for each event."""
    e = table(spark, sf_dir, "events")
    seed, place = F.col("event_id") * 977 + 12345, F.col("user_id") + 1
    name = F.concat(F.lit("j-"), F.col("user_id"), F.lit("ä"))
    return e.select("event_id", stats.uniform32(seed, place).alias("u"), F.round(stats.normal32(seed, place), 9).alias("z"), F.round(stats.normal_cdf((F.col("value") - 50) / 20), 12).alias("cdf"), stats.name_hash(name).alias("hash"), stats.held_out(name).alias("held"))


def sample_statistics(spark, sf_dir):
    """Median, deviation, upper median and clipped mean of each user's values."""
    e = table(spark, sf_dir, "events").groupBy("user_id")
    v = F.col("value")
    return e.agg(F.round(stats.median(v), 9).alias("median"), F.round(stats.deviation(v), 9).alias("sd"), F.round(stats.upper_median(v), 9).alias("upper"), F.round(F.avg(stats.clip(v, 10, 60)), 9).alias("clipped"))


def clock_features(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    c = clock.cyclic(F.col("ts"))
    return e.select("event_id", clock.weekday(F.col("ts")).alias("dow"), clock.minute_of_day(F.col("ts")).alias("minute"), clock.second_of_week(F.col("ts")).alias("sow"), F.round(c["sin_day"], 9).alias("sin_day"), F.round(c["cos_week"], 9).alias("cos_week"), c["weekend"].alias("weekend"))


def document_currency(spark, sf_dir):
    """Orders as dated documents, some dated to the month or year, some not at all."""
    k = F.col("o_orderkey")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    doc = F.when(k % 5 == 0, None).when(k % 5 == 1, F.substring(iso, 1, 4)).when(k % 5 == 2, F.substring(iso, 1, 7)).otherwise(iso)
    portal = F.when(k % 10 == 5, F.concat(iso, F.lit("T00:00:00Z")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("doc"), portal.alias("portal"))
    as_of = F.lit("1996-07-01").cast("date")
    c = clock.currency(F.col("doc"), F.col("portal"), as_of)
    return o.select("o_orderkey", c["status"].alias("status"), c["source"].alias("source"), c["age_days"].cast("long").alias("age_days"))


_HOUR = f"""WITH {_ENC}, h AS (SELECT unnest(['all', CASE WHEN dow >= 5 THEN 'weekend' ELSE 'weekday' END]) AS day_type, (sod // 3600)::INT AS hour, delay, stopped, quality FROM enc),
c AS (SELECT day_type, hour, delay, sum(sum(quality)) OVER (PARTITION BY day_type, hour ORDER BY delay) / sum(sum(quality)) OVER (PARTITION BY day_type, hour) AS c FROM h GROUP BY day_type, hour, delay),
q AS (SELECT day_type, hour, coalesce(min(delay) FILTER (c >= 0.1), max(delay)) AS p10, coalesce(min(delay) FILTER (c >= 0.5), max(delay)) AS p50, coalesce(min(delay) FILTER (c >= 0.9), max(delay)) AS p90 FROM c GROUP BY ALL),
b AS (SELECT day_type, hour, count(*) AS n, sum(stopped::INT * quality) / sum(quality) AS p_stop FROM h GROUP BY ALL)
SELECT w.day_type, g.hour::INT AS hour, coalesce(n, 0) AS n, CASE WHEN n >= 5 THEN p10 END AS p10, CASE WHEN n >= 5 THEN p50 END AS p50, CASE WHEN n >= 5 THEN p90 END AS p90, CASE WHEN n >= 5 THEN round(p_stop, 9) END AS p_stop
FROM range(0, 24) g(hour) CROSS JOIN (VALUES ('all'), ('weekday'), ('weekend')) w(day_type) LEFT JOIN b ON b.day_type = w.day_type AND b.hour = g.hour LEFT JOIN q ON q.day_type = w.day_type AND q.hour = g.hour"""
_KERNEL = f"""WITH {_ENC}, q AS (SELECT DISTINCT junction, t, junction * 100 + hour(t) AS qid FROM enc, (VALUES (TIMESTAMP '2024-01-30 02:30:00'), (TIMESTAMP '2024-01-30 06:30:00'), (TIMESTAMP '2024-01-30 12:30:00'), (TIMESTAMP '2024-01-30 18:30:00')) v(t)),
d AS (SELECT qid, delay, stopped, quality, abs(sod - (epoch(t)::BIGINT + 19800) % 86400) AS dd, abs(dow * 86400 + sod - (((epoch(t)::BIGINT + 19800) // 86400 + 3) % 7 * 86400 + (epoch(t)::BIGINT + 19800) % 86400)) AS dw, greatest(0, epoch({_NOW}) - epoch(ts)) AS age FROM enc JOIN q USING (junction)),
w AS (SELECT qid, delay, stopped, quality, exp(-pow(least(dd, 86400 - dd), 2) / (2 * 900.0::DOUBLE * 900)) * exp(-pow(least(dw, 604800 - dw), 2) / (2 * 259200.0::DOUBLE * 259200)) * exp(-age / 3888000.0::DOUBLE) * quality AS w FROM d),
b AS (SELECT qid, count(*) AS n, sum(delay * w) / sum(w) AS mean_delay, sum(stopped::INT * w) / sum(w) AS p_stop, pow(sum(w), 2) / sum(w * w) AS n_eff, sum(delay * quality) FILTER (stopped) / sum(quality) FILTER (stopped) AS mean_stop FROM w GROUP BY qid),
c AS (SELECT qid, delay, sum(sum(w)) OVER (PARTITION BY qid ORDER BY delay) / sum(sum(w)) OVER (PARTITION BY qid) AS c FROM w GROUP BY qid, delay)
SELECT qid, n, round(mean_delay, 6) AS mean_delay, round(p_stop, 6) AS p_stop, round(n_eff, 6) AS n_eff, round(mean_stop, 6) AS mean_stop, min(delay) FILTER (c >= 0.1) AS p10, min(delay) FILTER (c >= 0.5) AS p50, min(delay) FILTER (c >= 0.9) AS p90
FROM b JOIN c USING (qid) WHERE n_eff >= 8 GROUP BY ALL"""

def _kernel_sql(name, asked, h_day, tau, least):
    """(qid, m, s, ne, p10 to p90) of the kernel over `enc`; asked: qid, junction, t, least effective number."""
    return f"""{name}d AS (SELECT q.qid, q.least, e.delay, e.stopped, e.quality, abs(e.sod - q.sod) AS dd, abs(e.sow - q.sow) AS dw, greatest(0, epoch({_NOW}) - epoch(e.ts)) AS age FROM {asked} q JOIN enc e USING (junction)),
{name}w AS (SELECT qid, least, delay, stopped, exp(-pow(least(dd, 86400 - dd), 2) / (2 * {h_day}::DOUBLE * {h_day})) * exp(-pow(least(dw, 604800 - dw), 2) / (2 * 259200.0::DOUBLE * 259200)) * exp(-age / {tau}::DOUBLE) * quality AS w FROM {name}d),
{name}b AS (SELECT qid, sum(delay * w) / sum(w) AS m, sum(stopped::INT * w) / sum(w) AS s, pow(sum(w), 2) / sum(w * w) AS ne FROM {name}w GROUP BY qid, least HAVING pow(sum(w), 2) / sum(w * w) >= least),
{name}c AS (SELECT qid, delay, sum(sum(w)) OVER (PARTITION BY qid ORDER BY delay) / sum(sum(w)) OVER (PARTITION BY qid) AS c FROM {name}w GROUP BY qid, delay),
{name} AS (SELECT qid, m, s, ne, """ + ", ".join(f"min(delay) FILTER (c >= {x / 100}) AS p{x}" for x in (10, 25, 50, 75, 90)) + f" FROM {name}b JOIN {name}c USING (qid) GROUP BY ALL)"


_SOD = "(floor(epoch({t}))::BIGINT + 19800) % 86400"
_SOW = "(((floor(epoch({t}))::BIGINT + 19800) // 86400 + 3) % 7) * 86400 + (floor(epoch({t}))::BIGINT + 19800) % 86400"
# no offset of these events fits seven tenths of them, so level A does not occur here
_PREDICT = f"""WITH enc AS (SELECT *, {_SOD.format(t="ts")} AS sod, {_SOW.format(t="ts")} AS sow FROM (SELECT CASE WHEN k < 4 THEN 100 + event_id % 60 WHEN user_id % 3 = 0 THEN user_id % 7 ELSE 10 + user_id % 40 END::INT AS junction, ts, value AS delay, event_type IN ('error', 'click') AS stopped, 0.5::DOUBLE + k / 100.0::DOUBLE AS quality FROM (SELECT *, (props->>'$.k')::INT % 50 AS k FROM events))),
{_WIN.replace("range(0, 7)", "range(0, 160)")}, {_SERVE},
day AS (SELECT junction, kind, arg_min({{'p': plan_ord, 'd': day_type, 'r': rk}}, (rk, plan_ord)) AS c FROM win JOIN serve USING (day_type) WHERE junction % 4 <> 3 GROUP BY junction, kind),
cnt AS (SELECT junction, count(*) AS n, max(ts) AS last FROM enc GROUP BY junction),
q0 AS (SELECT j::INT AS junction, t, (j * 100 + hour(t))::BIGINT AS qid, CASE WHEN j % 2 = 0 THEN 0 END AS phase, j % 4 <> 3 AS ver FROM range(0, 160) r(j), (VALUES (TIMESTAMP '2024-01-30 02:30:00'), (TIMESTAMP '2024-01-30 06:30:00'), (TIMESTAMP '2024-01-30 12:30:00'), (TIMESTAMP '2024-01-30 18:30:00')) v(t)),
q AS (SELECT q0.*, coalesce(n, 0) AS n, last, {_SOD.format(t="t")} AS sod, {_SOW.format(t="t")} AS sow, CASE WHEN coalesce(n, 0) < 60 THEN 4 ELSE 8 END AS least FROM q0 LEFT JOIN cnt USING (junction)),
act AS (SELECT q.*, CASE WHEN day.c IS NULL THEN 'none' ELSE coalesce(win.mode, 'outside_windows') END AS mode, coalesce(day.c.r = 1 AND sow // 86400 = 6, FALSE) AS assumed, win.win_ord, win.cycle_s, win.phases, win.ped,
  list_filter(list_transform(range(1, len(win.phases) + 1), lambda i: {{'p': win.phases[i], 'i': i - 1}}), lambda x: x.p > 0) AS pos
  FROM q LEFT JOIN day ON day.junction = q.junction AND day.kind = CASE sow // 86400 WHEN 6 THEN 'sun' WHEN 5 THEN 'sat' ELSE 'week' END
  LEFT JOIN win ON win.junction = q.junction AND win.plan_ord = day.c.p AND sod // 60 >= win.s AND sod // 60 < win.e),
g AS (SELECT *, CASE WHEN mode = 'timed' AND cycle_s > 0 THEN list_transform(list_filter(pos, lambda x: x.i <> coalesce(ped, CASE WHEN len(pos) >= 3 AND list_min(pos).p <= 15 AND list_min(pos).p <= 0.12 * cycle_s THEN list_min(pos).i END, -1) AND x.p < cycle_s), lambda x: x.p) END AS greens,
  CASE WHEN mode = 'timed' AND phases[phase + 1] > 0 AND phases[phase + 1] < cycle_s THEN phases[phase + 1] END AS assigned FROM act),
o AS (SELECT *, CASE WHEN assigned IS NOT NULL THEN [assigned] ELSE greens END AS ps, cycle_s::DOUBLE AS c FROM g),
pr AS (SELECT *, CASE WHEN greens IS NOT NULL THEN list_sum(list_transform(ps, lambda p: p * pow(c - p, 2) / (2 * c))) / list_sum(ps) END AS pm, CASE WHEN greens IS NOT NULL THEN list_sum(list_transform(ps, lambda p: p * (c - p) / c)) / list_sum(ps) END AS pst,
  CASE WHEN greens IS NOT NULL THEN list_transform(range(0, floor((c - list_min(ps)) / 0.5)::BIGINT + 1), lambda i: {{'d': i * 0.5::DOUBLE, 's': list_sum(list_transform(ps, lambda p: p * least(1.0::DOUBLE, p / c + i * 0.5::DOUBLE / c))) / list_sum(ps)}}) END AS grid FROM o),
pts AS (SELECT * FROM q WHERE n >= 10),
rec AS (SELECT e.*, row_number() OVER () AS qid, CASE WHEN n < 60 THEN 4 ELSE 8 END AS least FROM enc e JOIN cnt USING (junction) WHERE n >= 10 AND epoch({_NOW}) - epoch(ts) < 5400),
{_kernel_sql("k", "pts", 900.0, 3888000.0, "least")},
{_kernel_sql("w", "pts", 3600.0, 31536000.0, "least")},
{_kernel_sql("b", "rec", 900.0, 3888000.0, "least")},
rs AS (SELECT junction, delay - b.m AS r, exp(-(epoch({_NOW}) - epoch(ts)) / 1800.0::DOUBLE) * quality AS w FROM rec JOIN b USING (qid)),
ri AS (SELECT *, row_number() OVER (PARTITION BY junction ORDER BY abs(r)) - 1 AS i, count(*) OVER (PARTITION BY junction) AS n FROM rs),
rp AS (SELECT *, max(abs(r)) FILTER (i = least(n - 1, floor(0.99 * n))) OVER (PARTITION BY junction) AS p FROM ri),
live AS (SELECT junction, count(*) AS rn, CASE WHEN count(*) < 3 THEN 0 ELSE 0.5 * sum(w * greatest(-p, least(p, r))) / sum(w) END AS adj FROM rp GROUP BY junction),
f AS (SELECT pr.*, k.m AS km, k.s AS ks, k.ne, k.p10 AS k10, k.p25 AS k25, k.p50 AS k50, k.p75 AS k75, k.p90 AS k90, w.m AS wm, rn, adj,
  CASE WHEN n >= 10 AND k.m IS NOT NULL THEN CASE WHEN n >= 300 THEN 'B' WHEN n >= 60 THEN 'C' ELSE 'D' END WHEN ver THEN 'P' ELSE 'E' END AS level,
  CASE WHEN junction % 5 < 3 THEN 0.45::DOUBLE ELSE 0.3::DOUBLE END * CASE WHEN win_ord = 1 THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN assumed THEN 0.8::DOUBLE ELSE 1 END AS base
  FROM pr LEFT JOIN k USING (qid) LEFT JOIN w USING (qid) LEFT JOIN live USING (junction))
SELECT qid, level, n, CASE WHEN level IN ('B', 'C', 'D') THEN round(greatest(0, km + coalesce(adj, 0)), 6) WHEN level = 'P' THEN round(pm, 6) END AS mean,
""" + ", ".join(f"round(CASE WHEN level IN ('B', 'C', 'D') THEN k{x} WHEN level = 'P' AND greens IS NOT NULL THEN coalesce(list_min(list_filter(grid, lambda z: z.s >= {x / 100}::DOUBLE)).d, c - list_min(ps)) END, 6) AS p{x}" for x in (10, 25, 50, 75, 90)) + """,
round(CASE WHEN level IN ('B', 'C', 'D') THEN ks WHEN level = 'P' THEN pst END, 6) AS p_stop, round(CASE WHEN level IN ('B', 'C', 'D') THEN coalesce(wm, km) WHEN level = 'P' THEN pm END, 6) AS long_mean,
round(CASE WHEN level IN ('B', 'C', 'D') THEN least(CASE level WHEN 'B' THEN 0.85::DOUBLE WHEN 'C' THEN 0.6::DOUBLE ELSE 0.35::DOUBLE END, 1 - exp(-ne / 40)) WHEN level = 'P' AND pm IS NOT NULL THEN CASE WHEN assigned IS NOT NULL THEN least(0.6::DOUBLE, base + 0.1::DOUBLE) ELSE base END * CASE WHEN junction % 2 = 0 THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN junction % 7 = 5 THEN 0.7::DOUBLE ELSE 1 END ELSE 0 END, 6) AS confidence,
CASE WHEN ver AND greens IS NOT NULL THEN cycle_s END AS cycle_s, CASE WHEN level IN ('B', 'C', 'D') THEN coalesce(rn, 0) ELSE 0 END AS recent_n, CASE WHEN level IN ('B', 'C', 'D') THEN round(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last), 3) END AS data_age_s, mode FROM f"""

QUERIES = {f.__name__: f for f in (interval_join, plan_prior, hourly_summary, weighted_quantile, kernel_estimate, scores, recent_residual, daily_residuals, offset_fit, autocorrelation, green_start_fits, cycle_scan, cycle_bootstrap, prior_levels, predictions, phase_clock, random_numbers, sample_statistics, clock_features, document_currency)}
ORACLES = {
    "interval_join": _ACTIVE + " SELECT event_id, day_type, assumed, mode, win_ord, cycle_s FROM act",
    "predictions": _PREDICT,
    "prior_levels": _ACTIVE + """, g AS (SELECT *, list_filter(list_transform(range(1, len(phases) + 1), lambda i: {'p': phases[i], 'i': i - 1}), lambda x: x.p > 0) AS pos FROM act),
v AS (SELECT *, mode = 'timed' AND cycle_s > 0 AND len(list_filter(pos, lambda x: x.i <> coalesce(ped, CASE WHEN len(pos) >= 3 AND list_min(pos).p <= 15 AND list_min(pos).p <= 0.12 * cycle_s THEN list_min(pos).i END, -1) AND x.p < cycle_s)) > 0 AS ok FROM g),
b AS (SELECT *, CASE WHEN junction % 3 = 0 THEN 0.45::DOUBLE ELSE 0.3::DOUBLE END * CASE WHEN win_ord = 1 THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN assumed THEN 0.8::DOUBLE ELSE 1 END AS b FROM v)
SELECT event_id, CASE WHEN journey >= 300 AND junction < 6 THEN 'A' WHEN journey >= 300 THEN 'B' WHEN journey >= 60 THEN 'C' WHEN journey >= 10 THEN 'D' WHEN junction < 6 THEN 'P' ELSE 'E' END AS level,
CASE WHEN ok THEN round(CASE WHEN junction % 2 = 0 THEN least(0.6::DOUBLE, b + 0.1::DOUBLE) ELSE b END * 0.85::DOUBLE * CASE WHEN junction = 5 THEN 0.7::DOUBLE ELSE 1 END, 9) END AS confidence FROM b""",
    "plan_prior": _ACTIVE + """, g0 AS (SELECT event_id, cycle_s::DOUBLE AS c, phases, ped, list_filter(list_transform(range(1, len(phases) + 1), lambda i: {'p': phases[i], 'i': i - 1}), lambda x: x.p > 0) AS pos FROM act WHERE mode = 'timed' AND cycle_s > 0),
g1 AS (SELECT *, list_min(pos) AS m FROM g0), g2 AS (SELECT *, coalesce(ped, CASE WHEN len(pos) >= 3 AND m.p <= 15 AND m.p <= 0.12 * c THEN m.i END, -1) AS skip FROM g1),
g AS (SELECT event_id, c, unnest(list_filter(pos, lambda x: x.i <> skip AND x.p < c)) AS x FROM g2),
a AS (SELECT event_id, c, count(*) AS n_phases, sum(x.p * pow(c - x.p, 2) / (2 * c)) / sum(x.p) AS mean, sum(x.p * (c - x.p) / c) / sum(x.p) AS p_stop, min(pow(c - x.p, 2) / (2 * c)) AS low, max(pow(c - x.p, 2) / (2 * c)) AS high, list(x.p) AS ps, sum(x.p) AS tot FROM g GROUP BY event_id, c),
d AS (SELECT *, list_transform(range(0, floor((c - list_min(ps)) / 0.5)::BIGINT + 1), lambda i: {'d': i * 0.5::DOUBLE, 's': list_sum(list_transform(ps, lambda p: p * least(1.0::DOUBLE, p / c + i * 0.5::DOUBLE / c))) / tot}) AS grid FROM a)
SELECT event_id, n_phases::INT AS n_phases, round(mean, 6) AS mean, round(p_stop, 6) AS p_stop, round(low, 6) AS low, round(high, 6) AS high, """
    + ", ".join(f"coalesce(list_min(list_filter(grid, lambda z: z.s >= {q / 100}::DOUBLE)).d, c - list_min(ps)) AS p{q}" for q in (10, 25, 50, 75, 90)) + " FROM d",
    "hourly_summary": _HOUR,
    "weighted_quantile": f"""WITH {_ENC}, c AS (SELECT junction, delay, sum(sum(quality)) OVER (PARTITION BY junction ORDER BY delay) / sum(sum(quality)) OVER (PARTITION BY junction) AS c FROM enc GROUP BY junction, delay)
SELECT junction, min(delay) FILTER (c >= 0.1) AS p10, min(delay) FILTER (c >= 0.5) AS p50, min(delay) FILTER (c >= 0.9) AS p90 FROM c GROUP BY junction""",
    "kernel_estimate": _KERNEL,
    "scores": f"""WITH {_ENC}, p AS (SELECT delay, stopped::INT::DOUBLE AS y, (sod // 3600 + 1) / 26.0::DOUBLE AS p FROM enc),
e AS (SELECT least(9, floor(p * 10)) AS b, count(*) AS n, avg(p) AS p, avg(y) AS y FROM p GROUP BY 1)
SELECT round(avg(pow(p - y, 2)), 9) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS logloss, round(avg(CASE WHEN delay >= 50 THEN 0.9::DOUBLE * (delay - 50) ELSE (50 - delay) * (1 - 0.9::DOUBLE) END), 9) AS pinball, round(avg(abs(delay - 50)), 9) AS mae, (SELECT round(sum(n * abs(p - y)) / sum(n), 9) FROM e) AS ece FROM p""",
    "recent_residual": f"""WITH {_ENC}, a AS (SELECT junction, delay - 50 AS r, quality, epoch((SELECT max(ts) FROM enc)) - epoch(ts) AS age FROM enc),
w AS (SELECT junction, r, exp(-age / 7200.0::DOUBLE) * quality AS w, row_number() OVER (PARTITION BY junction ORDER BY abs(r)) - 1 AS i, count(*) OVER (PARTITION BY junction) AS n FROM a WHERE age < 21600),
p AS (SELECT *, max(abs(r)) FILTER (i = least(n - 1, floor(0.99 * n))) OVER (PARTITION BY junction) AS p FROM w)
SELECT junction, round(CASE WHEN count(*) < 3 THEN 0 ELSE 0.5 * sum(w * greatest(-p, least(p, r))) / sum(w) END, 9) AS adjustment, count(*) AS recent_n FROM p GROUP BY junction""",
    "daily_residuals": f"""WITH {_ENC}, a AS (SELECT journey, delay - 20 AS r, quality, epoch(ts) AS t, unnest([ceil(epoch(ts) / 86400), ceil(epoch(ts) / 86400) + 1])::BIGINT AS day FROM enc),
w AS (SELECT journey, day, r, exp((t - day * 86400) / 43200.0::DOUBLE) * quality AS w, row_number() OVER (PARTITION BY journey, day ORDER BY abs(r)) - 1 AS i, count(*) OVER (PARTITION BY journey, day) AS n FROM a WHERE day * 86400 - t < 129600),
p AS (SELECT *, max(abs(r)) FILTER (i = least(n - 1, floor(0.99 * n))) OVER (PARTITION BY journey, day) AS p FROM w)
SELECT journey, day, round(CASE WHEN count(*) < 3 THEN 0 ELSE 0.5 * sum(w * greatest(-p, least(p, r))) / sum(w) END, 8) AS adjustment, count(*) AS recent_n FROM p GROUP BY journey, day""",
    "offset_fit": f"""WITH {_ENC}, g AS (SELECT junction, (epoch(ts) % 86400) AS g FROM enc), o AS (SELECT i * 0.5::DOUBLE AS o FROM range(0, 24) t(i)),
r AS (SELECT junction, o, least((g - o + 12) % 12, 12 - (g - o + 12) % 12) AS r FROM g, o),
c AS (SELECT junction, o, sum(CASE WHEN r <= 4 THEN 0.5::DOUBLE * r * r ELSE 4 * (r - 2) END) AS cost, count(*) AS n, avg((r <= 4)::INT) AS inl FROM r GROUP BY ALL)
SELECT junction, arg_min(o, (cost, o)) AS "offset", arg_min(n, (cost, o)) AS n, round(min(cost), 4) AS cost, round(arg_min(inl, (cost, o)), 6) AS inliers FROM c WHERE n >= 12 GROUP BY junction HAVING arg_min(inl, (cost, o)) >= 0.66""",
    "green_start_fits": f"""WITH {_ENC}, e AS (SELECT journey % 50 AS g, floor((epoch_us(ts) % 86400000000) / 1e6::DOUBLE * 10 + 0.5)::BIGINT AS t FROM enc WHERE stopped),
f AS (SELECT g, min(t) AS t0, count(*) AS n FROM e GROUP BY g HAVING count(*) >= 12), x AS (SELECT g, t - t0 AS t, t0, n FROM e JOIN f USING (g)),
c AS (SELECT g, c, o, sum(CASE WHEN r <= 40 THEN r * r ELSE 40 * (2 * r - 40) END) AS cost FROM (SELECT g, c, o, least((t - o * 10 + c * 10) % (c * 10), c * 10 - (t - o * 10 + c * 10) % (c * 10)) AS r
  FROM (SELECT x.g, t % (c * 10) AS t, c, o FROM x, range(30, 241) c(c), range(0, 240) o(o) WHERE o < c)) GROUP BY ALL),
b AS (SELECT g, c, min(cost) AS cost, arg_min(o, (cost, o)) AS o FROM c GROUP BY g, c),
w AS (SELECT g, max(c) AS c FROM (SELECT g, c, cost, min(cost) OVER (PARTITION BY g) AS m FROM b) WHERE cost <= m * 1.1::DOUBLE + 1e-9 GROUP BY g),
k AS (SELECT g, c, o, cost FROM w JOIN b USING (g, c)),
y AS (SELECT x.g, t0, n, k.c AS c0, k.o, ct, ((k.o * 10 + dp) % ct + ct) % ct AS p, t FROM x JOIN k USING (g), LATERAL (SELECT unnest(range(k.c * 10 - 10, k.c * 10 + 11)) AS ct) u, range(-10, 11) v(dp)),
z AS (SELECT g, t0, n, c0, o, ct, p, least((t - p) % ct + CASE WHEN (t - p) % ct < 0 THEN ct ELSE 0 END, ct - ((t - p) % ct + CASE WHEN (t - p) % ct < 0 THEN ct ELSE 0 END)) AS r FROM y),
s AS (SELECT g, t0, n, c0, o, ct, p, sum(CASE WHEN r <= 40 THEN r * r ELSE 40 * (2 * r - 40) END) AS cost, count(*) FILTER (r <= 40) AS inside FROM z GROUP BY ALL),
h AS (SELECT g, any_value(t0) AS t0, any_value(n) AS n, arg_min({{'c': ct, 'p': p, 'cost': cost, 'i': inside}}, (cost, (NOT (ct = c0 * 10 AND p = (o * 10) % ct))::INT, ct, p)) AS b FROM s GROUP BY g)
SELECT g AS "group", round(b.c / 10.0::DOUBLE, 1) AS cycle, round(((b.p + t0) % b.c) / 10.0::DOUBLE, 1) AS "offset", round(b.cost / 200.0::DOUBLE, 4) AS cost, round(b.i / n::DOUBLE, 6) AS inliers FROM h""",
    "phase_clock": f"""WITH {_ENC}, e AS (SELECT event_id, ((floor(epoch(ts))::BIGINT % 86400 - junction * 7) % 90 + 90) % 90 AS s FROM enc), p AS (SELECT DISTINCT s FROM e),
cdf AS (SELECT i, sg, CASE WHEN z > 0 THEN 1 - p ELSE p END AS c FROM (SELECT i, sg, z, 0.3989423::DOUBLE * exp(-z * z / 2) * t * (0.3193815::DOUBLE + t * (-0.3565638::DOUBLE + t * (1.781478::DOUBLE + t * (-1.821256::DOUBLE + t * 1.330274::DOUBLE)))) AS p
  FROM (SELECT i, sg, (i * 0.5::DOUBLE - 4 * sg) / sg AS z, 1 / (1 + 0.2316419::DOUBLE * abs((i * 0.5::DOUBLE - 4 * sg) / sg)) AS t FROM (SELECT unnest(range(0, (16 * sg)::BIGINT + 1)) AS i, sg FROM (VALUES (6.0::DOUBLE), (9.0::DOUBLE)) v(sg))))),
m AS (SELECT i, sg, c - lag(c) OVER (PARTITION BY sg ORDER BY i) AS m FROM cdf), q AS (SELECT s, sg, m, (s + i * 0.5::DOUBLE - 0.25::DOUBLE - 4 * sg + 900) % 90 AS a FROM p, m WHERE i > 0),
pg AS (SELECT s, sum(CASE WHEN a < 25 OR (a >= 50 AND a < 62.5) THEN m ELSE 0 END) AS p_green FROM q WHERE sg = 6 GROUP BY s),
w AS (SELECT s, w, sum(m) AS m FROM (SELECT s, m, CASE WHEN a < 25 THEN 0 ELSE 90 - a END AS w FROM q WHERE sg = 9) GROUP BY s, w), c AS (SELECT *, sum(m) OVER (PARTITION BY s ORDER BY w) AS c FROM w),
ww AS (SELECT s, sum(m * w) AS mean, sum(m) FILTER (w > 0) AS p_stop, coalesce(min(w) FILTER (c >= 0.1), max(w)) AS p10, coalesce(min(w) FILTER (c >= 0.9), max(w)) AS p90 FROM c GROUP BY s)
SELECT event_id, s::DOUBLE AS s, g AS green, CASE WHEN g THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS p_no_stop, CASE WHEN g THEN 0.0::DOUBLE ELSE least((90 - s) % 90, (50 - s + 90) % 90)::DOUBLE END AS wait, round(p_green, 6) AS p_green, round(mean, 6) AS mean, round(p_stop, 6) AS p_stop, p10, p90
FROM (SELECT *, s < 25 OR (s >= 50 AND s < 62.5) AS g FROM e) JOIN pg USING (s) JOIN ww USING (s)""",
    "random_numbers": """WITH s AS (SELECT event_id, value, name, n, user_id, (event_id * 977 + 12345 + (user_id + n)::HUGEINT * 1831565813) % 4294967296 AS a FROM (SELECT event_id, value, user_id, 'j-' || user_id || 'ä' AS name, unnest([1, 2]) AS n FROM events)),
t AS (SELECT *, (xor(a::BIGINT, (a // 32768)::BIGINT)::HUGEINT * (a::BIGINT | 1)) % 4294967296 AS t FROM s),
v AS (SELECT *, xor(t::BIGINT, ((t + (xor(t::BIGINT, (t // 128)::BIGINT)::HUGEINT * (t::BIGINT | 61)) % 4294967296) % 4294967296)::BIGINT) AS v FROM t),
u AS (SELECT *, xor(v, v // 16384) / 4294967296.0::DOUBLE AS u FROM v),
p AS (SELECT event_id, any_value(value) AS value, any_value(name) AS name, max(u) FILTER (n = 1) AS u, max(u) FILTER (n = 2) AS u2 FROM u GROUP BY event_id),
h AS (SELECT *, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(name, ''), lambda c: ord(c)::HUGEINT)), lambda x, y: xor(x::BIGINT, y::BIGINT)::HUGEINT * 16777619 % 4294967296)::BIGINT AS hash, (value - 50) / 20 AS z, 1 / (1 + 0.2316419::DOUBLE * abs((value - 50) / 20)) AS t FROM p),
c AS (SELECT *, 0.3989423::DOUBLE * exp(-z * z / 2) * t * (0.3193815::DOUBLE + t * (-0.3565638::DOUBLE + t * (1.781478::DOUBLE + t * (-1.821256::DOUBLE + t * 1.330274::DOUBLE)))) AS p FROM h)
SELECT event_id, u, round(sqrt(-2 * ln(u)) * cos(2 * pi() * u2), 9) AS z, round(CASE WHEN z > 0 THEN 1 - p ELSE p END, 12) AS cdf, hash, hash % 1000 < 300 AS held FROM c""",
    "sample_statistics": "SELECT user_id, round(median(value), 9) AS median, round(coalesce(stddev_samp(value), 0), 9) AS sd, round(list_sort(list(value))[count(*) // 2 + 1], 9) AS upper, round(avg(greatest(10, least(60, value))), 9) AS clipped FROM events GROUP BY user_id",
    "autocorrelation": f"""WITH {_ENC}, b AS (SELECT junction, floor(epoch(ts) / 3600)::BIGINT AS s, avg(stopped::INT::DOUBLE) AS x FROM enc GROUP BY ALL), m AS (SELECT junction, s, x - avg(x) OVER (PARTITION BY junction) AS x FROM b),
r AS (SELECT a.junction, c.s - a.s AS lag, count(*) AS n, sum(a.x * c.x) / sum(a.x * a.x) AS r FROM m a JOIN m c ON a.junction = c.junction AND c.s - a.s BETWEEN 2 AND 48 GROUP BY ALL HAVING count(*) > 20)
SELECT junction, lag::INT AS lag, round(r, 9) AS r FROM (SELECT *, row_number() OVER (PARTITION BY junction ORDER BY r DESC, lag) AS k FROM r) WHERE k <= 5""",
    "clock_features": """SELECT event_id, dow::INT AS dow, (sod // 60)::INT AS minute, dow * 86400 + sod AS sow, round(sin(sod * 6.283185307179586::DOUBLE / 86400), 9) AS sin_day, round(cos((dow * 86400 + sod) * 6.283185307179586::DOUBLE / 604800), 9) AS cos_week, dow >= 5 AS weekend
FROM (SELECT event_id, (floor(epoch(ts))::BIGINT + 19800) % 86400 AS sod, ((floor(epoch(ts))::BIGINT + 19800) // 86400 + 3) % 7 AS dow FROM events)""",
    "document_currency": """SELECT o_orderkey, CASE WHEN age IS NULL THEN 'undated' WHEN age <= 180 THEN 'current' WHEN age <= 365 THEN 'aging' ELSE 'stale' END AS status, source, age AS age_days
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN 'document' WHEN o_orderkey % 10 = 5 THEN 'portal' END AS source,
  greatest(0, date_diff('day', CASE WHEN o_orderkey % 5 = 1 THEN date_trunc('year', o_orderdate) WHEN o_orderkey % 5 = 2 THEN date_trunc('month', o_orderdate) WHEN o_orderkey % 5 > 2 OR o_orderkey % 10 = 5 THEN o_orderdate END::DATE, DATE '1996-07-01')) + CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 0 END AS age FROM orders)""",
}
