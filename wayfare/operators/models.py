"""Fits per group over histograms: periodic logistic models and cycles of green starts.

Events are pooled into bins of the cycle by Spark, so what a fit's task holds is bounded by
the number of bins, whatever the number of events; each (group, cycle) is its own fit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators import stats

#: Search bounds in seconds, the Huber bound, and the penalty of the periodic fits.
LOW, HIGH, DELTA, RIDGE = 30, 240, 4.0, 1e-2
#: A tenth of a second is the finest step of the fits, and of the bins.
TENTH = 10


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the intercept (column 0) is free of the penalty.

    y may be a share of successes and w the number of trials.
    """
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-12), x.T @ (w * (y - p)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _design(t: np.ndarray, cycle: float, k: int) -> np.ndarray:
    phase = 2 * np.pi * t / cycle
    return np.column_stack([np.ones(len(t)), *[f(i * phase) for i in range(1, k + 1) for f in (np.cos, np.sin)]])


def _losses(df: DataFrame, k: int) -> DataFrame:
    """(g, c, loss) of each (g, c): rows c, bin (tenths), held, n, hits; held-out log loss of the fit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf["c"].iloc[0] / TENTH
        x, n, hits, held = _design(pdf["bin"].to_numpy() / TENTH, c, k), pdf["n"].to_numpy(float), pdf["hits"].to_numpy(float), pdf["held"].to_numpy(bool)
        beta = fit_logistic(x[~held], hits[~held] / n[~held], n[~held])
        p = np.clip(1 / (1 + np.exp(-np.clip(x[held] @ beta, -30, 30))), 1e-6, 1 - 1e-6)
        loss = -(hits[held] * np.log(p) + (n[held] - hits[held]) * np.log(1 - p)).sum() / n[held].sum()
        return pd.DataFrame([(pdf["g"].iloc[0], pdf["c"].iloc[0], loss)], columns=["g", "c", "loss"])

    return df.groupBy("g", "c").applyInPandas(run, "g long, c int, loss double")


def cycles(df: DataFrame, group: str, t: str, y: str, journey: str, k: int = 2, low: int = LOW, high: int = HIGH, least: int = 60, least_held: int = 10) -> DataFrame:
    """(group, cycle, loss, improvement): the cycle whose periodic model loses least on held-out journeys.

    Whole seconds first, then tenths beside the best; improvement is on a constant. Times are
    taken in tenths of a second. Three tenths of the journeys are held out by name.
    """
    rows = df.select(F.col(group).cast("long").alias("g"), F.floor(F.col(t) * TENTH).cast("long").alias("t"), F.col(y).cast("double").alias("y"), stats.held_out(F.col(journey)).alias("held"))
    pooled = rows.groupBy("g", "t", "held").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    held = lambda c: F.sum(F.when(F.col("held"), F.col(c)).otherwise(0))
    total = pooled.groupBy("g").agg(F.sum("n").alias("n"), held("n").alias("nh"), F.sum("hits").alias("h"), held("hits").alias("hh"))
    total = total.filter((F.col("n") >= least) & (F.col("nh") >= least_held) & (F.col("n") > F.col("nh")))
    p = stats.clip((F.col("h") - F.col("hh")) / (F.col("n") - F.col("nh")), 1e-6, 1 - 1e-6)
    null = total.select("g", (-(F.col("hh") * F.ln(p) + (F.col("nh") - F.col("hh")) * F.ln(1 - p)) / F.col("nh")).alias("null"))
    usable = pooled.join(null.select("g"), "g")

    def losses(at: DataFrame) -> DataFrame:
        binned = at.withColumn("bin", F.pmod("t", F.col("c"))).groupBy("g", "c", "bin", "held").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
        return _losses(binned, k)

    best = lambda x: x.groupBy("g").agg(F.min(F.struct("loss", "c")).alias("b")).select("g", "b.*")
    whole = F.explode(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda c: (c * TENTH).cast("int")))
    coarse = best(losses(usable.withColumn("c", whole)))
    beside = F.explode(F.sequence(F.col("c0") - TENTH, F.col("c0") + TENTH)).alias("c")
    fine = losses(usable.join(coarse.select("g", F.col("c").alias("c0")), "g").select("g", "t", "held", "n", "hits", beside))
    got = best(coarse.select("g", "c", "loss").unionByName(fine)).join(null, "g")
    better = F.when(F.col("null") > 0, (F.col("null") - F.col("loss")) / F.col("null")).otherwise(0.0)
    return got.select(F.col("g").alias(group), (F.col("c") / TENTH).alias("cycle"), "loss", better.alias("improvement"))


def _cost(tenths: np.ndarray, delta: float) -> np.ndarray:
    """Huber cost of residuals in tenths of a second, in units of 1/200: whole numbers."""
    d = int(delta * TENTH)
    return np.where(tenths <= d, tenths * tenths, d * (2 * tenths - d))


def _coarse(hist: pd.DataFrame, delta: float, low: int, high: int) -> pd.DataFrame:
    """(g, c, o, cost) of the longest cycle within a tenth of the least cost; hist: c, bin, n."""
    found = []
    for c, own in hist.groupby("c"):
        c10, bins = int(c) * TENTH, own["bin"].to_numpy()
        n = np.bincount(bins, own["n"].to_numpy(), minlength=c10)
        d = np.arange(c10)
        kernel = _cost(np.minimum(d, c10 - d), delta)
        # cost of offset o: the histogram against the kernel moved by o
        filled = np.flatnonzero(n)
        costs = np.array([n[filled] @ kernel[(filled - o) % c10] for o in range(0, c10, TENTH)])
        found.append((int(c), int(costs.argmin()), float(costs.min())))
    least = min(x[2] for x in found)
    c, o, cost = max(x for x in found if x[2] <= least + max(0.1 * least, 1e-9 * 200))
    return pd.DataFrame([(hist["g"].iloc[0], c, o, cost)], columns=["g", "c", "o", "cost"])


def start_fits(df: DataFrame, group: str, t: str, low: int | str = LOW, high: int | str = HIGH, delta: float = DELTA, least: int = 12) -> DataFrame:
    """(group, cycle, offset, cost, inliers) of green starts, times taken in tenths of a second.

    A grid of whole seconds over cycle and offset, the longest cycle within a tenth of the
    least Huber cost, then tenths beside it. low, high: numbers, or columns equal within a group.
    """
    number = lambda x: F.col(x) if isinstance(x, str) else F.lit(x)
    rows = df.select(F.col(group).cast("long").alias("g"), F.floor(F.col(t) * TENTH + 0.5).cast("long").alias("t"), number(low).cast("int").alias("lo"), number(high).cast("int").alias("hi"))
    pooled = rows.groupBy("g", "t", "lo", "hi").agg(F.count("*").alias("n"))
    first = pooled.groupBy("g").agg(F.min("t").alias("t0"), F.sum("n").alias("all")).filter(F.col("all") >= least)
    from_first = pooled.join(first, "g").withColumn("t", F.col("t") - F.col("t0"))
    each = from_first.withColumn("c", F.explode(F.sequence("lo", "hi")))
    hist = each.groupBy("g", "c", F.pmod("t", F.col("c") * TENTH).alias("bin")).agg(F.sum("n").alias("n"))
    # at most 240 bins of a second times ten for each cycle, whatever the number of events
    coarse = hist.groupBy("g").applyInPandas(lambda pdf: _coarse(pdf, delta, LOW, HIGH), "g long, c int, o int, cost double")
    beside = lambda c: F.sequence((F.col(c) * TENTH - TENTH).cast("int"), (F.col(c) * TENTH + TENTH).cast("int"))
    fine = from_first.join(coarse.withColumnRenamed("c", "c0"), "g").withColumn("c", F.explode(beside("c0")))
    fine = fine.groupBy("g", "c0", "o", "cost", "t0", "all", "c", F.pmod("t", F.col("c")).alias("bin")).agg(F.sum("n").alias("n"))
    fine = fine.withColumn("p", F.explode(beside("o"))).withColumn("p", F.pmod("p", F.col("c")))
    d = F.pmod(F.col("bin") - F.col("p"), F.col("c"))
    r = F.least(d, F.col("c") - d)
    bound = int(delta * TENTH)
    unit = F.when(r <= bound, r * r).otherwise(bound * (2 * r - bound))
    scored = fine.groupBy("g", "c0", "o", "cost", "t0", "all", "c", "p").agg(F.sum(F.col("n") * unit).cast("double").alias("fine"), F.sum(F.when(r <= bound, F.col("n")).otherwise(0)).alias("inside"))
    # the coarse fit stands unless a finer one costs less
    whole = (F.col("c") == F.col("c0") * TENTH) & (F.col("p") == F.pmod(F.col("o") * TENTH, F.col("c")))
    best = scored.groupBy("g", "t0", "all").agg(F.min(F.struct(F.col("fine").alias("cost"), (~whole).alias("moved"), "c", "p", "inside")).alias("b"))
    return best.select(
        F.col("g").alias(group), (F.col("b.c") / TENTH).alias("cycle"), (F.pmod(F.col("b.p") + F.col("t0"), F.col("b.c")) / TENTH).alias("offset"),
        (F.col("b.cost") / 200).alias("cost"), (F.col("b.inside") / F.col("all")).alias("inliers"),
    )


def bootstrap(df: DataFrame, group: str, t: str, journey: str, rounds: int = 40, seed: int = 1) -> DataFrame:
    """(group, cycle_low, cycle_mid, cycle_high, offset, half_width): journeys drawn anew.

    Each replicate draws as many journeys as the group has, by a seeded number for each
    draw; it is fitted like any group, beside the whole group's cycle. Groups of fewer than
    five journeys, or with fewer than ten fits, have none.
    """
    base = start_fits(df, group, t).select(F.col(group).alias("g"), F.col("cycle").alias("c0"), F.col("offset").alias("o0"))
    rows = df.select(F.col(group).cast("long").alias("g"), F.col(t).cast("double").alias("t"), F.col(journey).cast("string").alias("j"))
    names = rows.select("g", "j").distinct()
    # numbering a group's journeys takes one narrow row for each
    from pyspark.sql.window import Window

    names = names.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("j")) - 1)
    many = names.groupBy("g").agg(F.count("*").alias("m")).filter("m >= 5").join(base, "g")
    draw = many.select("g", "m", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("b"), "c0").select("g", "m", "b", "c0", F.explode(F.sequence(F.lit(1), "m")).alias("k"))
    draw = draw.withColumn("i", F.floor(stats.uniform32(F.lit(seed) + F.col("g") * rounds + F.col("b"), F.col("k")) * F.col("m")).cast("int"))
    taken = draw.join(names, ["g", "i"]).join(rows, ["g", "j"])
    low, high = F.greatest(F.lit(LOW), F.floor(F.col("c0") - 5).cast("int")), F.least(F.lit(HIGH), F.ceil(F.col("c0") + 5).cast("int"))
    fits = start_fits(taken.select((F.col("g") * rounds + F.col("b") - 1).alias("gb"), "t", low.alias("lo"), high.alias("hi")), "gb", "t", "lo", "hi")
    fits = fits.withColumn("g", F.floor(F.col("gb") / rounds)).join(base, "g")
    d = F.pmod(F.col("offset") - F.col("o0"), F.col("c0"))
    apart = F.least(d, F.col("c0") - d)
    got = fits.groupBy("g", "o0").agg(F.array_sort(F.collect_list("cycle")).alias("c"), F.array_sort(F.collect_list(apart)).alias("w")).filter(F.size("c") >= 10)
    at = lambda a, q: F.get(a, F.least(F.size(a) - 1, F.floor(F.size(a) * q).cast("int")))
    return got.select(F.col("g").alias(group), at("c", 0.025).alias("cycle_low"), at("c", 0.5).alias("cycle_mid"), at("c", 0.975).alias("cycle_high"), F.col("o0").alias("offset"), at("w", 0.95).alias("half_width"))
