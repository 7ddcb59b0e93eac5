"""Timing plans: which window holds at a time, its prior, and its standing among documents.

A windows table has one row per window: junction, plan_ord, day_type, win_ord, start,
end (HH:MM), mode, phases (array<int>), cycle_s, ped (index or null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions import clock

#: The day types that serve a weekday, a Saturday, a Sunday; then those that stand in.
_SERVES = {"sun": ["sunday", "weekend", "all_days", "holiday"], "sat": ["saturday", "weekend", "all_days"], "week": ["weekday_default", "all_days"]}


def active_windows(events: DataFrame, windows: DataFrame, key: str = "junction", ts: str = "ts", at: Column | None = None) -> DataFrame:
    """events with day_type, assumed, mode, plan_ord, win_ord, cycle_s, phases and ped of the window that holds.

    mode is "none" without a plan for the day and "outside_windows" without a window for
    the minute. The day's plan is chosen once for each (junction, kind of day), a small
    table; the interval join is then an equi-join on junction and kind of day.
    at: the one moment of all events, where they share it: plans of other days are then left out before anything is joined.
    """
    kind_of = lambda c: F.when(clock.weekday(c) == 6, "sun").when(clock.weekday(c) == 5, "sat").otherwise("week")
    kinds = F.explode(F.array(*map(F.lit, _SERVES))) if at is None else kind_of(at)
    plan = windows.select(key, "plan_ord", "day_type").distinct().withColumn("kind", kinds)
    own = F.lit(False)
    for kind, types in _SERVES.items():
        own = F.when(F.col("kind") == kind, F.col("day_type").isin(types)).otherwise(own)
    stands_in = (F.col("kind") != "week") & (F.col("day_type") == "weekday_default")
    plan = plan.withColumn("rank", F.when(own, 0).when(stands_in, 1)).filter("rank IS NOT NULL")
    best = plan.groupBy(key, "kind").agg(F.min(F.struct("rank", "plan_ord", "day_type")).alias("p"))
    chosen = best.select(key, "kind", "p.plan_ord", "p.day_type", ((F.col("p.rank") == 1) & (F.col("kind") == "sun")).alias("assumed"))
    spans = windows.select(
        key, "plan_ord", "win_ord", "mode", "cycle_s", "phases", "ped", clock.minutes(F.col("start")).alias("_s"), clock.minutes(F.col("end")).alias("_e")
    )
    day = spans.join(chosen, [key, "plan_ord"]).groupBy(key, "kind", "day_type", "assumed").agg(
        F.sort_array(F.collect_list(F.struct("win_ord", "plan_ord", "_s", "_e", "mode", "cycle_s", "phases", "ped"))).alias("_w")
    )
    asked = events.withColumn("kind", kind_of(F.col(ts))).withColumn("_m", clock.minute_of_day(F.col(ts)))
    hit = F.get(F.filter("_w", lambda w: (F.col("_m") >= w["_s"]) & (F.col("_m") < w["_e"])), F.lit(0))
    out = asked.join(day, [key, "kind"], "left").withColumn("_hit", hit)
    mode = F.when(F.col("_w").isNull(), "none").when(F.col("_hit").isNull(), "outside_windows").otherwise(F.col("_hit.mode"))
    return out.select(
        *events.columns, F.coalesce("day_type", F.lit("none")).alias("day_type"), F.coalesce("assumed", F.lit(False)).alias("assumed"), mode.alias("mode"), "_hit.plan_ord", "_hit.win_ord", "_hit.cycle_s", "_hit.phases", "_hit.ped"
    )


def vehicle_phases(phases: Column, cycle: Column, ped: Column, mode: Column) -> Column:
    """Greens a vehicle can have: the pedestrian phase, zeros and whole cycles out; null if unusable."""
    cells = F.transform(phases, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    positive = F.filter(cells, lambda x: x["p"] > 0)
    least = F.array_min(positive)
    guess = F.when((F.size(positive) >= 3) & (least["p"] <= 15) & (least["p"] <= 0.12 * cycle), least["i"])
    skip = F.coalesce(ped, guess, F.lit(-1))
    kept = F.transform(F.filter(cells, lambda x: (x["i"] != skip) & (x["p"] > 0) & (x["p"] < cycle)), lambda x: x["p"])
    ok = (mode == "timed") & (cycle > 0) & ~F.exists(phases, lambda p: p.isNull()) & (F.size(kept) > 0)
    return F.when(ok, kept)


def uniform_delay(cycle: Column, green: Column) -> Column:
    """struct(mean, p_stop, p50) for arrivals spread evenly over a cycle."""
    g = F.least(cycle, F.greatest(F.lit(0), green))
    r = F.greatest(F.lit(0), cycle - g)
    ok = cycle > 0
    part = lambda c: F.when(ok, c).otherwise(F.lit(0.0))
    return F.struct(part(r * r / (2.0 * cycle)).alias("mean"), part(r / cycle).alias("p_stop"), part(F.greatest(F.lit(0.0), 0.5 * cycle - g)).alias("p50"))


def assigned_green(phases: Column, at: Column, cycle: Column) -> Column:
    """The green of a phase column a reviewer has assigned; null where it cannot be one."""
    g = F.get(phases, at)
    return F.when((g > 0) & (g < cycle), g)


def mixture(cycle: Column, greens: Column) -> Column:
    """struct(mean, p_stop, low, high): delays of several greens, weighted by the green."""
    total = F.aggregate(greens, F.lit(0.0), lambda a, g: a + g)

    def weighted(f) -> Column:
        return F.aggregate(greens, F.lit(0.0), lambda a, g: a + g * f(g)) / total

    mean = lambda g: F.pow(cycle - g, 2) / (2.0 * cycle)
    each = F.transform(greens, mean)
    return F.struct(weighted(mean).alias("mean"), weighted(lambda g: (cycle - g) / cycle).alias("p_stop"), F.array_min(each).alias("low"), F.array_max(each).alias("high"))


def mixture_quantile(cycle: Column, greens: Column, q: float, step: float = 0.5) -> Column:
    """First delay on a grid at which the weighted distribution of delays reaches q, the longest red at most."""
    total = F.aggregate(greens, F.lit(0.0), lambda a, g: a + g)

    def below(d: Column) -> Column:
        return F.aggregate(greens, F.lit(0.0), lambda a, g: a + g * F.least(F.lit(1.0), g / cycle + d / cycle)) / total

    most = cycle - F.array_min(greens)
    grid = F.transform(F.sequence(F.lit(0), F.floor(most / step).cast("int")), lambda i: i * step)
    return F.coalesce(F.array_min(F.filter(grid, lambda d: below(d) >= q)), most)


def window_priors(windows: DataFrame, key: str = "junction") -> DataFrame:
    """windows that can carry a prior, with greens and mean, p_stop, low, high, p10 to p90.

    Windows are few beside events: their priors are worked out once and joined.
    """
    c = F.col("cycle_s").cast("double")
    rows = windows.withColumn("greens", vehicle_phases(F.col("phases"), F.col("cycle_s"), F.col("ped"), F.col("mode"))).filter("greens IS NOT NULL")
    m = mixture(c, F.col("greens"))
    qs = [mixture_quantile(c, F.col("greens"), q / 100).alias(f"p{q}") for q in (10, 25, 50, 75, 90)]
    return rows.select(key, "plan_ord", "win_ord", "greens", m["mean"].alias("mean"), m["p_stop"].alias("p_stop"), m["low"].alias("low"), m["high"].alias("high"), *qs)


def signatures(windows: DataFrame, key: str = "junction") -> DataFrame:
    """(key, sig): canonical text of the timed windows; blocks without any have none."""
    row = F.to_json(F.struct("day_type", "start", "end", F.to_json("phases", {"ignoreNullFields": "false"}).alias("phases"), "cycle_s"), {"ignoreNullFields": "false"})
    return windows.filter("mode = 'timed'").groupBy(key).agg(F.concat_ws("|", F.array_sort(F.collect_list(row))).alias("sig"))


def duplicates(blocks: DataFrame, name_key: str = "name_key", key: str = "key", sig: str = "sig") -> DataFrame:
    """(key, canonical) of blocks that repeat an earlier one of the same name and timings."""
    first = blocks.filter(F.col(sig).isNotNull() & (F.col(sig) != "")).groupBy(name_key, sig).agg(F.min(key).alias("canonical"))
    return blocks.join(first, [name_key, sig]).filter(F.col(key) != F.col("canonical")).select(key, "canonical")


def conflicts(blocks: DataFrame, both_names: bool = False) -> DataFrame:
    """Targets whose blocks disagree: (target, blocks, signatures, among_verified), blocks and signatures counted.

    blocks: key, name, name_key, sig, target, verified, rejected. The stricter rule of the
    ingest (both_names) also asks for two names.
    """
    dup = duplicates(blocks).select("key")
    live = blocks.join(dup, "key", "left_anti").filter("NOT rejected AND sig IS NOT NULL AND sig <> '' AND target IS NOT NULL")
    # one row for each of a target's blocks' distinct traits, then counts: no list of blocks is gathered
    each = live.groupBy("target", "sig").agg(F.count("*").alias("n"), F.max("verified").alias("v"))
    got = each.groupBy("target").agg(F.sum("n").alias("blocks"), F.count("*").alias("signatures"), (F.count_if("v") > 1).alias("among_verified")).filter("signatures >= 2")
    if not both_names:
        return got
    names = live.select("target", "name").distinct().groupBy("target").agg(F.count("name").alias("names"))
    return got.join(names.filter("names >= 2").select("target"), "target")


def superseded(blocks: DataFrame) -> DataFrame:
    """(key, newer): the newest later block of the same target with other timings.

    Per target only the newest block of each signature can count, so what is joined is
    small: two newest dates suffice, and a window picks them without a self-join.
    """
    live = blocks.filter("NOT rejected AND target IS NOT NULL")
    day = F.unix_date("dated")
    newest = live.groupBy("target", "sig").agg(F.max(F.struct(day.alias("t"), (-F.col("ord")).alias("o"), F.col("key").alias("k"))).alias("x")).select("target", "sig", "x.*")
    ranked = newest.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("t"), F.desc("o")))).filter("r <= 2")
    two = ranked.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("r", "sig", "k", "t"))).alias("two"))
    mine = blocks.filter("target IS NOT NULL").join(two, "target")
    other = F.get(F.filter("two", lambda x: ~x["sig"].eqNullSafe(F.col("sig"))), F.lit(0))
    return mine.withColumn("o", other).filter(F.col("o.t") > day).select("key", F.col("o.k").alias("newer"))
