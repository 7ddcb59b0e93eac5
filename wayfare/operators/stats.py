"""Weighted statistics and scores, grouped; all partial aggregation or one window a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions import clock
from wayfare.scratch import write_table


def weighted_mean(v: Column, w: Column) -> Column:
    return F.sum(v * w) / F.nullif(F.sum(w), F.lit(0.0))


def effective_n(w: Column) -> Column:
    return F.coalesce(F.pow(F.sum(w), 2) / F.nullif(F.sum(w * w), F.lit(0.0)), F.lit(0.0))


#: Equal parts into which a range of values is cut, and how many rows of a range are ordered without another cut.
RANGES, FEW = 512, 100_000


def weighted_quantiles(df: DataFrame, by: list[str], value: str, weight: str, qs: dict[str, float], few: int = FEW, written: bool = False) -> DataFrame:
    """(by..., names of qs): the first value whose share of weight up to it reaches q.

    A group's values are cut into equal parts, and those in which a quantile falls are cut again from their own
    least to their own greatest value, until each holds few rows or one value; only these are ordered. A value far from
    the others costs a round, not a task that holds the group.
    written: df is a table that may be read over and over.
    """
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    keys = by or ["_all"]
    own = [F.col(c) for c in by] or [F.lit(0).alias("_all")]
    rows = df.filter(v.isNotNull() & w.isNotNull()).select(*own, v.alias("_v"), w.alias("_w"))
    rows = rows if written else write_table(rows, "weighted")
    open_ = rows.groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.sum("_w").alias("_t"), F.count("*").alias("_n")).filter("_t > 0")
    open_ = write_table(open_.select(*keys, "_a", "_b", F.lit(0.0).alias("_before"), "_t", "_n"), "ranges")
    inside = (F.col("_v") >= F.col("_a")) & (F.col("_v") <= F.col("_b"))
    most = lambda: open_.filter("_b > _a").agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    largest, seen = most(), None
    while largest > few and largest != seen:
        part = F.least(F.lit(RANGES - 1), F.floor((F.col("_v") - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0)) * RANGES))
        placed = rows.join(open_, keys).filter(inside).withColumn("_p", F.coalesce(part, F.lit(0)).cast("int"))
        sums = placed.groupBy(*keys, "_a", "_p").agg(F.sum("_w").alias("_s"), F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("_before").alias("_base"), F.first("_t").alias("_t"))
        order = Window.partitionBy(*keys, "_a").orderBy("_p")
        upto = F.coalesce(F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        sums = sums.withColumn("_before", F.col("_base") + upto).withColumn("_last", F.max("_hi").over(Window.partitionBy(*keys)) == F.col("_hi"))
        slack = F.col("_t") * 1e-9  # sums in another order differ by less
        keep = F.col("_last")
        for q in qs.values():
            keep = keep | ((F.col("_before") - slack < q * F.col("_t")) & (F.col("_before") + F.col("_s") + slack >= q * F.col("_t")))
        open_ = write_table(sums.filter(keep).select(*keys, F.col("_lo").alias("_a"), F.col("_hi").alias("_b"), "_before", "_t", "_n"), "ranges")
        seen, largest = largest, most()
    near = rows.join(open_, keys).filter(inside).groupBy(*keys, "_a", "_v").agg(F.sum("_w").alias("_w"), F.first("_before").alias("_before"), F.first("_t").alias("_t"))
    run = F.sum("_w").over(Window.partitionBy(*keys, "_a").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("_c", (F.col("_before") + run) / F.col("_t"))
    return near.groupBy(*keys).agg(*[F.coalesce(F.min(F.when(F.col("_c") >= q, F.col("_v"))), F.max("_v")).alias(n) for n, q in qs.items()]).select(*by, *qs)


def median(c: Column) -> Column:
    """The middle value, or the mean of the two middle ones."""
    return F.median(c)


def deviation(c: Column) -> Column:
    """Of a sample; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def upper_median(c: Column) -> Column:
    """The value at place n / 2, rounded down, from zero; 0 without any. For few values a group."""
    found = F.array_sort(F.collect_list(c))
    return F.coalesce(F.get(found, F.floor(F.size(found) / 2).cast("int")), F.lit(0.0))


def upper_medians(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, values...): of each value the one at place n / 2, rounded down, from zero, among the key's rows.

    Rows are counted by value before they are moved, so a window holds a key's different values, not its rows.
    """
    out = None
    for v in values:
        counts = rows.groupBy(key, v).agg(F.count("*").alias("n"))
        own = Window.partitionBy(key)
        counts = counts.withColumn("upto", F.sum("n").over(own.orderBy(v))).withColumn("all", F.sum("n").over(own))
        one = counts.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(key).agg(F.min(v).alias(v))
        out = one if out is None else out.join(one, key)
    return out


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(as_col(low), F.least(as_col(high), x))


def normal_cdf(z: Column) -> Column:
    """The polynomial form of 1964, good to 1e-7; fixed values are its published coefficients."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    d = 0.3989423 * F.exp(-z * z / 2)
    p = d * t * (0.3193815 + t * (-0.3565638 + t * (1.781478 + t * (-1.821256 + t * 1.330274))))
    return F.when(z > 0, 1 - p).otherwise(p)


def _low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _times32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, without overflow."""
    high = (F.shiftrightunsigned(a, 16) * b).bitwiseAND(F.lit(0xFFFF))
    return _low32(F.shiftleft(high, 16) + a.bitwiseAND(F.lit(0xFFFF)) * b)


def uniform32(seed: Column, place: Column) -> Column:
    """The number at `place` (from 1) of the 32-bit generator that starts at seed, in [0, 1).

    Fixed values: the generator's increment and shifts. Its state is a plain counter, so any
    place is reached at once.
    """
    a = _low32(seed.cast("long") + _times32(place.cast("long"), F.lit(0x6D2B79F5)))
    mix = lambda x, n: x.bitwiseXOR(F.shiftrightunsigned(x, n))
    t = _times32(mix(a, 15), a.bitwiseOR(F.lit(1)))
    t = _low32(t.bitwiseXOR(_low32(t + _times32(mix(t, 7), t.bitwiseOR(F.lit(61))))))
    return mix(t, 14) / F.lit(4294967296.0)


def normal32(seed: Column, place: Column) -> Column:
    """A standard normal number from two places of the generator."""
    a, b = uniform32(seed, place), uniform32(seed, place + 1)
    return F.sqrt(-2 * F.ln(F.when(a > 0, a).otherwise(F.lit(2.0**-32)))) * F.cos(2 * F.pi() * b)


def name_hash(s: Column) -> Column:
    """32-bit FNV-1a over the characters; fixed values are its published offset and prime."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: _times32(h.bitwiseXOR(F.ascii(c).cast("long")), F.lit(16777619).cast("long")))


def held_out(journey: Column, share: float = 0.3) -> Column:
    """Whether a journey is kept for testing: by its name alone."""
    return F.pmod(name_hash(journey.cast("string")), F.lit(1000)) < int(share * 1000)


def kernel_weight(t: Column, s: Column, now: Column, quality: Column, h_day: float = 900.0, h_week: float = 259200.0, tau: float = 3888000.0, congestion: tuple[Column, Column] | None = None, h_congestion: float = 0.25) -> Column:
    """Weight of a sample at s for a query at t: near in the day, in the week, and recent.

    congestion: that asked for and that of the sample, 0 to 1; where either is null it plays no part.
    """
    age = F.greatest(F.lit(0.0), clock.epoch(now) - clock.epoch(s))
    return kernel_nearness(t, clock.second_of_week(s), h_day, h_week, congestion, h_congestion) * F.exp(-age / tau) * quality


def kernel_nearness(t: Column, second: Column, h_day: float = 900.0, h_week: float = 259200.0, congestion: tuple[Column, Column] | None = None, h_congestion: float = 0.25) -> Column:
    """The part of a sample's weight that hangs on the query: its second of the week, and congestion."""
    day = clock.circular_distance(clock.second_of_day(t), F.pmod(second, F.lit(clock.DAY_S)), float(clock.DAY_S))
    week = clock.circular_distance(clock.second_of_week(t), second, float(clock.WEEK_S))
    w = F.exp(-(day * day) / (2 * h_day * h_day)) * F.exp(-(week * week) / (2 * h_week * h_week))
    if congestion is None:
        return w
    apart = clip(congestion[0], 0, 1) - clip(congestion[1], 0, 1)
    known = congestion[0].isNotNull() & congestion[1].isNotNull()
    return w * F.when(known, F.exp(-(apart * apart) / (2 * h_congestion * h_congestion))).otherwise(1.0)


def kernel_estimates(samples: DataFrame, queries: DataFrame, now: Column, least_n: float | Column = 8.0, quantiles: tuple[int, ...] = (10, 25, 50, 75, 90), h_day: float = 900.0, h_week: float = 259200.0, tau: float = 3888000.0, h_congestion: float = 0.25) -> DataFrame:
    """One row per query (qid, t) of the same junction with enough effective samples.

    samples: junction, ts, delay, stopped, quality, and congestion if they have it; queries
    may have congestion too. A query sees of a sample's time only its second of the week, so samples are summed by it
    (and by delay, where quantiles are asked for) before they meet queries: a query meets no second of a junction twice.
    """
    covered = "congestion" in samples.columns and "congestion" in queries.columns
    asked = queries.withColumnRenamed("congestion", "_congestion")
    pair = (F.col("_congestion"), F.col("congestion")) if covered else None
    own = F.exp(-F.greatest(F.lit(0.0), clock.epoch(now) - clock.epoch(F.col("ts"))) / tau) * F.col("quality")
    each = samples.select("junction", clock.second_of_week(F.col("ts")).alias("_second"), *(["congestion"] if covered else []), F.col("delay").cast("double").alias("delay"), "stopped", "quality", own.alias("_own"))
    keys = ["junction", "_second", *(["congestion"] if covered else []), *(["delay"] if quantiles else [])]
    kept = F.when(F.col("stopped"), F.col("quality"))
    pooled = each.groupBy(*keys).agg(
        F.sum("_own").alias("_w"), F.sum(F.col("_own") * F.col("_own")).alias("_w2"), F.sum(F.col("_own") * F.col("delay")).alias("_wd"), F.sum(F.col("_own") * F.col("stopped").cast("double")).alias("_ws"),
        F.count("*").alias("_rows"), F.sum(kept).alias("_q"), F.sum(kept * F.col("delay")).alias("_qd"),
    )
    near = kernel_nearness(F.col("t"), F.col("_second"), h_day, h_week, pair, h_congestion)
    least = least_n if isinstance(least_n, Column) else F.lit(float(least_n))
    pairs = pooled.join(asked, "junction").select("qid", *(["delay"] if quantiles else []), near.alias("_f"), "_w", "_w2", "_wd", "_ws", "_rows", "_q", "_qd", least.alias("_least"))
    pairs = pairs.withColumn("w", F.col("_f") * F.col("_w"))
    if quantiles:  # the narrow pairs stand once for the sums and the quantiles
        pairs = write_table(pairs, "kernel-pairs")
    f, share = F.col("_f"), lambda a, b: F.sum(a) / F.nullif(F.sum(b), F.lit(0.0))
    base = pairs.groupBy("qid").agg(
        share(f * F.col("_wd"), F.col("w")).alias("mean_delay"), share(f * F.col("_ws"), F.col("w")).alias("p_stop"),
        F.coalesce(F.pow(F.sum("w"), 2) / F.nullif(F.sum(f * f * F.col("_w2")), F.lit(0.0)), F.lit(0.0)).alias("n_eff"), F.sum("_rows").alias("n"), F.max("_least").alias("_least"),
        share(F.col("_qd"), F.col("_q")).alias("mean_stop"),
    ).filter(F.col("n_eff") >= F.col("_least")).drop("_least")
    if not quantiles:
        return base
    qs = weighted_quantiles(pairs, ["qid"], "delay", "w", {f"p{q}": q / 100 for q in quantiles}, written=True)
    return base.join(qs, "qid")


def hourly(samples: DataFrame, least: int = 5) -> DataFrame:
    """(day_type, hour, n, p10, p50, p90, p_stop): 72 rows, for all days, weekdays and weekends; figures only from `least` samples on."""
    weekend = clock.weekday(F.col("ts")) >= 5
    kind = F.explode(F.array(F.lit("all"), F.when(weekend, "weekend").otherwise("weekday")))
    rows = samples.withColumn("hour", F.floor(clock.second_of_day(F.col("ts")) / 3600).cast("int")).withColumn("day_type", kind)
    base = rows.groupBy("day_type", "hour").agg(F.count("*").alias("n"), weighted_mean(F.col("stopped").cast("double"), F.col("quality")).alias("p_stop"))
    qs = weighted_quantiles(rows, ["day_type", "hour"], "delay", "quality", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    kinds = F.explode(F.array(F.lit("all"), F.lit("weekday"), F.lit("weekend")))
    frame = samples.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).withColumn("day_type", kinds)
    enough = lambda c: F.when(F.col("n") >= least, F.col(c)).alias(c)
    return frame.join(base, ["day_type", "hour"], "left").join(qs, ["day_type", "hour"], "left").select("day_type", "hour", F.coalesce("n", F.lit(0)).alias("n"), enough("p10"), enough("p50"), enough("p90"), enough("p_stop"))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def log_loss(p: Column, y: Column) -> Column:
    c = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.avg(-(y * F.ln(c) + (1 - y) * F.ln(1 - c)))


def pinball(y: Column, q: Column, tau: float) -> Column:
    return F.when(y >= q, (y - q) * tau).otherwise((q - y) * (1 - tau))


def huber(r: Column, delta: float) -> Column:
    a = F.abs(r)
    return F.when(a <= delta, 0.5 * r * r).otherwise(delta * (a - 0.5 * delta))


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """One row: sum over equal bins of their share times |mean p - mean y|; the last bin is closed."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins))
    got = df.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(y).alias("y"))
    return got.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def recent_residuals(rows: DataFrame, by: list[str], now: Column, tau: float = 1800.0, share: float = 0.5) -> DataFrame:
    """(by..., adjustment, recent_n) of residuals younger than three tau.

    rows: ts, residual (null where there is no baseline), quality. Residuals are held to the
    99th percentile of their sizes (the value at place 0.99 n, rounded down); fewer than three give 0.
    """
    age = clock.epoch(now) - clock.epoch(F.col("ts"))
    recent = rows.filter(F.col("residual").isNotNull() & (age < 3 * tau)).select(*by, "residual", (F.exp(-age / tau) * F.col("quality")).alias("w"))
    place = Window.partitionBy(*by).orderBy(F.abs("residual"))
    ranked = recent.withColumn("_i", F.row_number().over(place) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    bound = F.max(F.when(F.col("_i") == F.least(F.col("_n") - 1, F.floor(0.99 * F.col("_n"))), F.abs("residual"))).over(Window.partitionBy(*by))
    held = ranked.withColumn("_p", bound).withColumn("_r", clip(F.col("residual"), -F.col("_p"), F.col("_p")))
    mean = F.coalesce(F.sum(F.col("w") * F.col("_r")) / F.nullif(F.sum("w"), F.lit(0.0)), F.lit(0.0))
    return held.groupBy(*by).agg(F.when(F.count("*") >= 3, share * mean).otherwise(0.0).alias("adjustment"), F.count("*").alias("recent_n"))


def autocorrelation(df: DataFrame, by: list[str], second: str, y: str, low: int = 30, high: int = 240, top: int = 5, least: int = 50, longest: int = 200_000) -> DataFrame:
    """(by..., lag, r): the strongest lags of a 0/1 series in one-second bins, empty bins skipped.

    Groups of fewer than `least` rows, or over more than `longest` seconds, have none. An
    equi-join of bins with bins shifted by each lag; only filled bins are joined.
    """
    span = df.groupBy(*by).agg(F.count("*").alias("_n"), F.min(second).alias("_t0"), F.max(second).alias("_t1"))
    span = span.filter((F.col("_n") >= least) & (F.ceil(F.col("_t1") - F.col("_t0")) + 1 <= longest)).select(*by, "_t0")
    bins = df.join(span, by).groupBy(*by, F.floor(F.col(second) - F.col("_t0")).cast("long").alias("s")).agg(F.avg(y).alias("x"))
    mean = bins.groupBy(*by).agg(F.avg("x").alias("m"))
    x = bins.join(mean, by).withColumn("x", F.col("x") - F.col("m")).drop("m")
    ahead = x.select(*by, F.col("x").alias("x2"), F.explode(F.sequence(F.lit(low), F.lit(high))).alias("lag"), "s").withColumn("s", F.col("s") - F.col("lag"))
    r = x.join(ahead, [*by, "s"]).groupBy(*by, "lag").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x2")).alias("a"), F.sum(F.col("x") * F.col("x")).alias("b"))
    r = r.filter("n > 20 AND b > 0").select(*by, "lag", (F.col("a") / F.col("b")).alias("r"))
    return r.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("r"), "lag"))).filter(F.col("k") <= top).drop("k")


def offset_fit(df: DataFrame, by: list[str], g: str, cycle: Column | float, delta: float = 4.0, step: float = 0.5, least: int = 12, inlying: float = 0.7) -> DataFrame:
    """(by..., offset, cost, n, inliers): the offset on a grid with the least Huber cost of circular residuals.

    cycle: one number, or a column that is equal within a group. Equal positions in the cycle
    are pooled first. Groups of too few rows, or with a smaller share of inliers, have no fit.
    """
    c = cycle if isinstance(cycle, Column) else F.lit(float(cycle))
    pooled = df.select(*by, c.cast("double").alias("_c"), F.pmod(F.col(g).cast("double"), c.cast("double")).alias("_g")).groupBy(*by, "_c", "_g").agg(F.count("*").alias("_n"))
    grid = F.explode(F.sequence(F.lit(0), F.ceil(F.col("_c") / step).cast("int") - 1))
    each = pooled.withColumn("_i", grid).withColumn("offset", F.col("_i") * step)
    d = F.pmod(F.col("_g") - F.col("offset"), F.col("_c"))
    res = F.least(d, F.col("_c") - d)
    cost = each.groupBy(*by, "offset").agg(F.sum(F.col("_n") * huber(res, delta)).alias("cost"), F.sum("_n").alias("n"), (F.sum(F.when(res <= delta, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("inliers"))
    best = cost.filter(F.col("n") >= least).groupBy(*by).agg(F.min(F.struct("cost", "offset", "n", "inliers")).alias("b"))
    return best.filter(F.col("b.inliers") >= inlying).select(*by, "b.offset", "b.cost", "b.n", "b.inliers")
