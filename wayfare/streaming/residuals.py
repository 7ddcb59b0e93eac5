"""Recent residuals over a stream: sums by slice of time and size of residual, folded at a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions import clock

#: The look-back is this many decay times.
SPANS = 3


def residual_slices(rows: DataFrame, by: list[str], tau: float = 1800.0, slice_s: int = 60, grid: float = 0.1, late: str = "10 minutes") -> DataFrame:
    """(by..., until, bin, n, w, wr, top) of rows: ts, residual, quality; a batch or a stream, the latter emitted once its slice is over.

    A slice is the `slice_s` seconds up to and with `until`. Residuals of one bin lie within a grid's width. w sums quality decayed as of
    until, wr that times the residual, top is the largest size. Rows without a residual or a time are left out; what comes later
    than `late` is dropped, as watermarks do. Spark combines a slice's rows before it shuffles them, so a key that holds a third of all
    rows costs as many state rows as it has bins, and the state holds only slices that are still open.
    """
    # a row on a boundary belongs to the slice that ends there: windows close on the left
    at = F.col("ts").cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")
    r, q = F.col("residual").cast("double"), F.col("quality").cast("double")
    cut = rows.filter(r.isNotNull() & F.col("ts").isNotNull()).select(*by, at.alias("_at"), clock.epoch(F.col("ts")).alias("_t"), r.alias("_r"), q.alias("_q"))
    if cut.isStreaming:
        cut = cut.withWatermark("_at", late)
    slice_ = F.window("_at", f"{slice_s} seconds")
    end = (F.floor((F.col("_t") * 1e6 - 1) / (slice_s * 1e6)) + 1) * slice_s
    w = F.exp((F.col("_t") - end) / tau) * F.col("_q")
    got = cut.withColumns({"_w": w, "_b": F.round(F.col("_r") / grid).cast("long")}).groupBy(slice_, *by, "_b").agg(
        F.count("*").alias("n"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_r")).alias("wr"), F.max(F.abs("_r")).alias("top"))
    return got.select(*by, F.col("window.end").alias("until"), F.col("_b").alias("bin"), "n", "w", "wr", "top")


def residuals_at(slices: DataFrame, by: list[str], now: Column, tau: float = 1800.0, share: float = 0.5) -> DataFrame:
    """(by..., adjustment, recent_n) at a moment, from the slices that end after now less three tau and not after now.

    Equals `stats.recent_residuals` over the rows up to now where now and the look-back fall on ends of slices and a bin holds one
    value. Otherwise the 99th percentile is the largest size in its bin, so an adjustment is off by at most share times the
    grid, and the look-back is cut at the end of a slice. A key's bins, not its rows, pass through a window.
    """
    age = clock.epoch(now) - clock.epoch(F.col("until"))
    near = slices.filter((age >= 0) & (age < SPANS * tau)).withColumn("_f", F.exp(-age / tau))
    sums = lambda c: F.sum(F.col("_f") * F.col(c)).alias(c)
    bins = near.groupBy(*by, F.abs("bin").alias("_b"), (F.col("bin") < 0).alias("_neg")).agg(F.sum("n").alias("n"), sums("w"), sums("wr"), F.max("top").alias("top"))
    plus = F.when(F.col("_neg"), -F.col("w")).otherwise(F.col("w"))
    sizes = bins.groupBy(*by, "_b").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("wr").alias("wr"), F.sum(plus).alias("ws"), F.max("top").alias("top"))
    all_ = Window.partitionBy(*by)
    run = sizes.withColumns({"_upto": F.sum("n").over(all_.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("n").over(all_)})
    # the value at place 0.99 n, rounded down, counted from 0
    place = F.least(F.col("_n") - 1, F.floor(0.99 * F.col("_n")))
    held = run.withColumn("_p", F.min(F.when(F.col("_upto") > place, F.struct("_b", "top"))).over(all_))
    wr = F.when(F.col("_b") > F.col("_p._b"), F.col("ws") * F.col("_p.top")).otherwise(F.col("wr"))
    mean = F.coalesce(F.sum(wr) / F.nullif(F.sum("w"), F.lit(0.0)), F.lit(0.0))
    return held.groupBy(*by).agg(F.when(F.sum("n") >= 3, share * mean).otherwise(0.0).alias("adjustment"), F.sum("n").alias("recent_n"))


def _day(ts: Column) -> Column:
    """Days since 1970, whatever the session's zone."""
    return F.floor(clock.epoch(ts) / clock.DAY_S)


def residual_stream(rows: DataFrame, target: str, checkpoint: str, by: list[str], tau: float = 1800.0, slice_s: int = 60, grid: float = 0.1, late: str = "10 minutes"):
    """Closed slices of a stream, appended by the day of their end under target; what a batch writes again replaces what it wrote.

    Read them with `slices_since` and fold them with `residuals_at` at the stream's watermark or any earlier moment.
    """
    slices = residual_slices(rows, by, tau, slice_s, grid, late)

    def keep(batch: DataFrame, number: int) -> None:
        days = batch.withColumn("day", _day(F.col("until")))
        days.write.partitionBy("day").mode("overwrite").parquet(f"{target}/batch={number}")

    return slices.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def slices_since(spark, target: str, shape: str, now: Column, tau: float = 1800.0) -> DataFrame:
    """The slices under target that a fold at `now` can need; folders of other days are not opened. shape: columns of `by` as DDL."""
    schema = f"{shape}, until timestamp, bin bigint, n bigint, w double, wr double, top double, batch bigint, day bigint"
    first = F.floor((clock.epoch(now) - SPANS * tau) / clock.DAY_S)
    return spark.read.schema(schema).parquet(target).filter(F.col("day").between(first, _day(now))).drop("batch", "day")
