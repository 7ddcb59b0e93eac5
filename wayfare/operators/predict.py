"""Which prediction stands for a junction and a time, and its figures.

In order of strength: A, a fixed cycle whose offset is calibrated from green starts; B, C and
D, a kernel mean over observed delays, by how many there are; P, the published plan's prior;
E, nothing. Every model is a table keyed by query; the choice is one expression over their joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import clock
from wayfare.operators import plans, stats
from wayfare.scratch import write_table

#: Factors on confidence by a document's standing; most confidence by level.
STANDING = {"live": 1.0, "current": 1.0, "aging": 0.85, "stale": 0.6, "undated": 0.5, "historical": 0.0, "superseded": 0.4}
CAPS = {"B": 0.85, "C": 0.6, "D": 0.35}
#: Days for which green starts count, and the spread of arrivals in seconds.
GREEN_DAYS, SIGMA = 45, 45.0
STEP = 0.5


def level(n: Column, verified: Column) -> Column:
    """By the number of encounters; with a verified plan the strongest is A, and none at all is P."""
    return F.when(n >= 300, F.when(verified, "A").otherwise("B")).when(n >= 60, "C").when(n >= 10, "D").otherwise(F.when(verified, "P").otherwise("E"))


def prior_confidence(control: Column, cycle_source: Column, assumed: Column, assigned: Column, standing: Column, conflict: Column) -> Column:
    """Confidence in a plan's prior, lowered for each thing that is not known."""
    table = F.create_map(*[F.lit(x) for kv in STANDING.items() for x in kv])
    yes = lambda c: F.coalesce(c, F.lit(False))
    base = F.when(yes(control == "fixed"), 0.45).otherwise(0.3)
    base = base * F.when(yes(cycle_source == "sum_of_phases"), 0.85).otherwise(1.0) * F.when(yes(assumed), 0.8).otherwise(1.0)
    base = F.when(yes(assigned), F.least(F.lit(0.6), base + 0.1)).otherwise(base)
    return base * F.when(standing.isNull(), 1.0).otherwise(F.try_element_at(table, standing)) * F.when(yes(conflict), 0.7).otherwise(1.0)


def phase_position(t: Column, offset: Column, cycle: Column) -> Column:
    return F.pmod(t - offset, cycle)


def is_green(s: Column, greens: Column) -> Column:
    """Whether a place in the cycle lies in any of the green spans (array of structs a, b), the ends left out."""
    return F.exists(greens, lambda g: (s >= g["a"]) & (s < g["b"]))


def p_no_stop(green: Column, p_green: float = 0.9, p_red: float = 0.1) -> Column:
    return F.when(green, p_green).otherwise(p_red)


def expected_wait(s: Column, greens: Column, cycle: Column) -> Column:
    """Seconds to the next green from a place in the cycle; 0 in green, or without any."""
    ahead = F.array_min(F.transform(greens, lambda g: F.pmod(g["a"] - s, cycle)))
    return F.when(is_green(s, greens), 0.0).otherwise(F.coalesce(ahead, F.lit(0.0)))


def p_green(mu: Column, sigma: float, offset: Column, greens: Column, cycle: Column) -> Column:
    """Chance of green when arrival is spread normally: half-second steps over four sigma either side."""
    here = is_green(phase_position(mu, offset, cycle), greens).cast("double")
    if sigma < STEP:
        return here
    steps = F.sequence(F.lit(1), F.lit(int(8 * sigma / STEP)))
    mass = lambda i: stats.normal_cdf((i * STEP - 4 * sigma) / sigma) - stats.normal_cdf(((i - 1) * STEP - 4 * sigma) / sigma)
    at = lambda i: phase_position(mu + (i * STEP - STEP / 2 - 4 * sigma), offset, cycle)
    return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.when(is_green(at(i), greens), mass(i)).otherwise(0.0))


def phase_waits(asked: DataFrame, by: list[str], sigma: float = SIGMA) -> DataFrame:
    """(by..., mean, p_stop, p10, p90) of waits when arrival is spread normally.

    asked: by, s (place in the cycle at the mean arrival), cycle, green (seconds of green
    from 0). Every ask is a few hundred half-second steps; those of one (cycle, green, s)
    are worked out once.
    """
    cases = asked.select("cycle", "green", "s").distinct()
    n = int(8 * sigma / STEP) if sigma >= STEP else 0
    here = F.when(F.col("s") < F.col("green"), 0.0).otherwise(F.col("cycle") - F.col("s"))
    if not n:
        stop = (F.col("s") >= F.col("green")).cast("double")
        out = cases.select("cycle", "green", "s", here.alias("mean"), stop.alias("p_stop"), here.alias("p10"), here.alias("p90"))
    else:
        i = F.col("i")
        grid = cases.sparkSession.range(1, n + 1).select(F.col("id").alias("i"))
        mass = stats.normal_cdf((i * STEP - 4 * sigma) / sigma) - stats.normal_cdf(((i - 1) * STEP - 4 * sigma) / sigma)
        grid = grid.select("i", mass.alias("m"))
        each = cases.join(F.broadcast(grid))  # a fixed number of steps
        at = F.pmod(F.col("s") + (i * STEP - STEP / 2 - 4 * sigma), F.col("cycle"))
        each = each.withColumn("w", F.when(at < F.col("green"), 0.0).otherwise(F.col("cycle") - at))
        waits = each.groupBy("cycle", "green", "s", "w").agg(F.sum("m").alias("m"))
        from pyspark.sql.window import Window

        run = F.sum("m").over(Window.partitionBy("cycle", "green", "s").orderBy("w").rowsBetween(Window.unboundedPreceding, 0))
        waits = waits.withColumn("c", run)
        first = lambda q: F.coalesce(F.min(F.when(F.col("c") >= q, F.col("w"))), F.max("w"))
        stop = F.sum(F.when(F.col("w") > 0, F.col("m")).otherwise(0.0))
        out = waits.groupBy("cycle", "green", "s").agg(F.sum(F.col("m") * F.col("w")).alias("mean"), stop.alias("p_stop"), first(0.1).alias("p10"), first(0.9).alias("p90"))
    return asked.join(out, ["cycle", "green", "s"]).select(*by, "mean", "p_stop", "p10", "p90")


def since_window_start(ts: Column, start: Column) -> Column:
    """Seconds on the local clock since the window began, today or yesterday, with their fraction."""
    second = F.pmod(clock.epoch(ts) + clock.OFFSET_S, F.lit(86400.0))
    return F.pmod(second - clock.minutes(start) * 60, F.lit(86400.0))


def synchronised(active: DataFrame, encounters: DataFrame, windows: DataFrame, now: Column, sigma: float = SIGMA) -> DataFrame:
    """(qid, ...) of level A: queries whose window's offset is calibrated.

    active: queries with their window (active_windows), assigned (a green) and greens.
    encounters: junction, ts, resumed. Green starts of the same junction, window and day type
    within GREEN_DAYS are fitted on the clock that starts with the window.
    """
    can = active.filter(F.col("greens").isNotNull() & F.col("assigned").isNotNull() & (F.lit(sigma) <= F.col("cycle_s") / 2))
    starts = windows.select("junction", "plan_ord", "win_ord", "start").distinct()
    key = ["junction", "plan_ord", "win_ord"]
    wanted = can.select(*key, F.col("cycle_s").cast("double").alias("cycle")).distinct()
    recent = encounters.filter(F.col("resumed").isNotNull() & (clock.epoch(now) - clock.epoch(F.col("ts")) < GREEN_DAYS * 86400))
    own = plans.active_windows(recent.select("junction", "ts", "resumed"), windows).join(wanted, key).join(starts, key)
    fits = stats.offset_fit(own.withColumn("g", since_window_start(F.col("resumed"), F.col("start"))), [*key, "cycle"], "g", F.col("cycle"))
    asked = can.join(fits, key).join(starts, key)
    s = phase_position(since_window_start(F.col("t"), F.col("start")), F.col("offset"), F.col("cycle"))
    asked = asked.withColumn("s", s).withColumn("green", F.col("assigned").cast("double"))
    waits = phase_waits(asked.select("qid", "s", "cycle", "green"), ["qid"], sigma)
    sure = F.least(F.lit(0.85), (0.5 + 0.35 * F.col("inliers")) * F.exp(-2 * F.pow(F.lit(sigma) / F.col("cycle"), 2)))
    return asked.select("qid", "offset", "inliers", sure.alias("confidence")).join(waits, "qid")


def predict(queries: DataFrame, encounters: DataFrame, windows: DataFrame, linked: DataFrame, now: Column, sigma: float = SIGMA) -> DataFrame:
    """One row per query: level and its figures.

    queries: qid, junction, t, phase (assigned column or null). encounters: junction, ts, delay,
    stopped, quality, resumed. linked: junction, control, standing, conflict (one verified
    plan each). windows as in plans, with cycle_source. Where queries and encounters both bear congestion
    (0 to 1, or null), encounters under like traffic weigh more, in the estimate and in the baseline of recent residuals.
    """
    traffic = ["congestion"] if "congestion" in queries.columns and "congestion" in encounters.columns else []
    counts = encounters.groupBy("junction").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    verified = linked.withColumn("verified", F.lit(True))
    asked = queries.join(counts, "junction", "left").join(verified, "junction", "left")
    asked = asked.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("verified", F.coalesce("verified", F.lit(False)))
    held = plans.active_windows(asked, windows.join(linked.select("junction"), "junction", "left_semi"), ts="t")
    source = windows.select("junction", "plan_ord", "win_ord", "cycle_source").distinct()
    held = held.join(source, ["junction", "plan_ord", "win_ord"], "left")
    held = held.withColumn("assigned", F.when(F.col("mode") == "timed", plans.assigned_green(F.col("phases"), F.col("phase"), F.col("cycle_s"))))
    held = held.withColumn("greens", plans.vehicle_phases(F.col("phases"), F.col("cycle_s"), F.col("ped"), F.col("mode")))

    # the prior: worked out once for each (window, assigned green)
    c = F.col("cycle_s").cast("double")
    cases = held.filter("greens IS NOT NULL").select("cycle_s", "greens", "assigned").distinct()
    over = F.when(F.col("assigned").isNotNull(), F.array("assigned")).otherwise(F.col("greens"))
    m = plans.mixture(c, over)
    prior = cases.select("cycle_s", "greens", "assigned", m["mean"].alias("pr_mean"), m["p_stop"].alias("pr_stop"), *[plans.mixture_quantile(c, over, q / 100).alias(f"pr_p{q}") for q in (10, 25, 50, 75, 90)])
    held = held.join(prior.withColumnRenamed("assigned", "_as"), (held["cycle_s"] == prior["cycle_s"]) & (held["greens"] == prior["greens"]) & F.col("assigned").eqNullSafe(F.col("_as")), "left").drop(prior["cycle_s"], prior["greens"]).drop("_as")
    # the queries with their windows and priors stand once for all the models that read them
    held = write_table(held, "predict-windows")

    sync = synchronised(held.filter("n >= 12"), encounters, windows, now, sigma).select("qid", *[F.col(x).alias(f"sy_{x}") for x in ("mean", "p_stop", "p10", "p90", "confidence", "offset")])
    samples = encounters.select("junction", "ts", "delay", "stopped", "quality", *traffic)
    by_level = F.when(F.col("_n") < 60, 4.0).otherwise(8.0)
    points = held.filter("n >= 10").select("qid", "junction", "t", F.col("n").alias("_n"), *traffic)
    near = stats.kernel_estimates(samples, points, now, by_level).select("qid", *[F.col(x).alias(f"k_{x}") for x in ("mean_delay", "p10", "p25", "p50", "p75", "p90", "p_stop", "n_eff")])
    wide = stats.kernel_estimates(samples, points, now, by_level, (50,), h_day=3600.0, tau=365 * 86400.0).select("qid", F.col("mean_delay").alias("w_mean"), F.col("p50").alias("w_p50"))

    # residuals of the last hour and a half against the kernel mean at their own time, under the traffic asked for
    recent = encounters.drop("congestion").join(counts.filter("n >= 10").select("junction", F.col("n").alias("_n")), "junction")
    recent = recent.filter(clock.epoch(now) - clock.epoch(F.col("ts")) < 5400)
    recent = recent.join(points.select("junction", *traffic).distinct(), "junction").withColumn("qid", F.xxhash64("junction", clock.second_of_week(F.col("ts")), *traffic))
    # the estimate hangs on the second alone: one is asked for all rows of a second
    asks = recent.groupBy("qid", "junction", *traffic).agg(F.min("ts").alias("t"), F.min("_n").alias("_n"))
    base = stats.kernel_estimates(samples, asks, now, by_level, ()).select("qid", "mean_delay")
    rows = recent.join(base, "qid", "left").withColumn("residual", F.col("delay") - F.col("mean_delay"))
    live = stats.recent_residuals(rows.select("junction", "ts", "residual", "quality", *traffic), ["junction", *traffic], now)
    live = live.withColumnsRenamed({c: f"_{c}" for c in ("junction", *traffic)})

    sync, near, wide, live = (write_table(x, "predict-model") for x in (sync, near, wide, live))
    out = held.join(sync, "qid", "left").join(near, "qid", "left").join(wide, "qid", "left").join(live, reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), traffic, F.col("junction") == F.col("_junction")), "left")
    lev = level(F.col("n"), F.col("verified"))
    kernel = lev.isin("A", "B", "C", "D") & F.col("k_mean_delay").isNotNull()
    strong = F.when(lev == "A", "B").otherwise(lev)
    chosen = F.when(F.col("sy_mean").isNotNull(), "A").when(kernel, strong).when(F.col("verified"), "P").otherwise("E")
    out = out.withColumn("level", chosen)
    of = lambda a, k, p: F.when(F.col("level") == "A", a).when(F.col("level").isin("B", "C", "D"), k).when(F.col("level") == "P", p)
    none = F.lit(None).cast("double")
    cap = F.create_map(*[F.lit(x) for kv in CAPS.items() for x in kv])
    sure = prior_confidence(F.col("control"), F.col("cycle_source"), F.col("assumed"), F.col("assigned").isNotNull(), F.col("standing"), F.col("conflict"))
    k_sure = F.least(F.try_element_at(cap, F.col("level")), 1 - F.exp(-F.col("k_n_eff") / 40))
    mean = F.greatest(F.lit(0.0), F.col("k_mean_delay") + F.coalesce("adjustment", F.lit(0.0)))
    return out.select(
        "qid", "junction", "level", "n", of(F.col("sy_mean"), mean, F.col("pr_mean")).alias("mean"), of(none, F.col("k_p50"), F.col("pr_p50")).alias("p50"),
        of(F.col("sy_p10"), F.col("k_p10"), F.col("pr_p10")).alias("p10"), of(none, F.col("k_p25"), F.col("pr_p25")).alias("p25"), of(none, F.col("k_p75"), F.col("pr_p75")).alias("p75"),
        of(F.col("sy_p90"), F.col("k_p90"), F.col("pr_p90")).alias("p90"), of(F.col("sy_p_stop"), F.col("k_p_stop"), F.col("pr_stop")).alias("p_stop"),
        of(F.col("pr_mean"), F.coalesce("w_mean", "k_mean_delay"), F.col("pr_mean")).alias("long_mean"),
        F.coalesce(of(F.col("sy_confidence"), k_sure, F.when(F.col("pr_mean").isNotNull(), sure)), F.lit(0.0)).alias("confidence"),
        F.when(F.col("level").isin("A", "P") | F.col("verified"), F.when(F.col("greens").isNotNull(), F.col("cycle_s"))).alias("cycle_s"), F.col("sy_offset").alias("offset"),
        F.coalesce(F.when(F.col("level").isin("B", "C", "D"), F.col("recent_n")), F.lit(0)).alias("recent_n"),
        F.when(F.col("level").isin("B", "C", "D"), F.greatest(F.lit(0.0), clock.epoch(now) - clock.epoch(F.col("last")))).alias("data_age_s"),
        "mode", F.when(F.col("verified"), F.struct("day_type", "assumed", "plan_ord", "win_ord", "control", "cycle_source", "standing", "conflict", "assigned")).alias("plan"),
    )
