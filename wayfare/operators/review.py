"""Rule set that orders plan blocks for review. Passing it never accepts a link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control labels the rules can use.
USABLE = ["FIXED", "VAC", "VA", "SYNC"]


def criteria(blocks: DataFrame) -> dict[str, Column]:
    """Named tests over control_label, phase_count, tier and day_plans
    (array of struct(day_type, windows_ordered, windows: array of struct(mode, consistent, flags, cycle_s)))."""
    plans = F.col("day_plans")
    timed = F.filter(F.flatten(F.transform(plans, lambda d: d["windows"])), lambda w: w["mode"] == "timed")
    fault = lambda f: F.startswith(f, F.lit("incomplete")) | F.startswith(f, F.lit("cycle_mismatch")) | (f == "cycle_out_of_range")
    sound = lambda w: F.coalesce(w["consistent"], F.lit(False))
    complete = F.filter(timed, lambda w: sound(w) & ~F.exists(w["flags"], fault) & F.coalesce(w["cycle_s"].between(40, 300), F.lit(False)))
    return {
        "control_label_usable": F.coalesce(F.col("control_label").isin(*USABLE), F.lit(False)),
        "has_complete_consistent_row": F.size(complete) > 0,
        "all_timed_rows_consistent": (F.size(timed) > 0) & F.forall(timed, sound),
        "windows_ordered": (F.size(plans) > 0) & F.forall(plans, lambda d: d["windows_ordered"]),
        "phase_columns_detected": F.col("phase_count") >= 2,
        "match_strong": F.col("tier") == "strong",
        "match_at_least_moderate": F.col("tier").isin("strong", "moderate"),
        "no_unlabelled_groups": F.forall(plans, lambda d: d["day_type"] != "unlabelled_group"),
    }


def prevalidate(blocks: DataFrame, flags: str = "quality_flags", importance: str = "importance") -> DataFrame:
    """blocks with score, passed, blocking, review status and priority."""
    tests = criteria(blocks)
    rows = blocks.withColumns({f"_{k}": F.coalesce(v, F.lit(False)) for k, v in tests.items()})
    c = {k: F.col(f"_{k}") for k in tests}
    points = lambda ok, n: F.when(ok, n).otherwise(0.0)
    score = (
        F.when(c["match_strong"], 0.35).when(c["match_at_least_moderate"], 0.15).otherwise(0.0) + points(c["has_complete_consistent_row"], 0.25) + points(c["all_timed_rows_consistent"], 0.15)
        + points(c["windows_ordered"], 0.10) + points(c["control_label_usable"], 0.10) + points(c["phase_columns_detected"] & c["no_unlabelled_groups"], 0.05)
    )
    passed = c["match_strong"] & c["has_complete_consistent_row"] & c["windows_ordered"] & c["control_label_usable"] & c["phase_columns_detected"] & c["no_unlabelled_groups"]
    by_quality = F.filter(flags, lambda f: f.isin("duplicate", "conflicting_timings", "conflicting_target"))
    failed = F.array_compact(F.array(*[F.when(~v, F.lit(k)) for k, v in c.items()]))
    out = rows.withColumn("score", score).withColumn("passed", passed).withColumn("blocking", F.concat(failed, by_quality))
    out = out.withColumn("review", F.when(F.col("passed") & (F.size(by_quality) == 0), "pre_validated").otherwise("pending_review"))
    priority = 0.6 * F.col("score") + 0.25 * F.col(importance) / 5 + points(c["has_complete_consistent_row"], 0.15)
    return out.withColumn("priority", priority).drop(*[f"_{k}" for k in tests])
