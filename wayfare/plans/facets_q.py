"""Facet queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators import facets
from wayfare.session import table

DOMAINS = {
    "kind": ["click", "error", "purchase", "signup", "view"],
    "band": ["low", "mid", "high"],
    "part": ["night", "morning", "afternoon", "evening"],
}


def faceted_events(events: DataFrame) -> DataFrame:
    hour = F.hour("ts")
    return events.select(
        "event_id", "user_id", "ts", "value",
        F.col("event_type").alias("kind"),
        F.when(F.col("value") < 20, "low").when(F.col("value") < 60, "mid").otherwise("high").alias("band"),
        F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening").alias("part"),
    )


def facet_counts(spark, sf_dir):
    return facets.leave_one_out_counts(
        faceted_events(table(spark, sf_dir, "events")), DOMAINS, {"kind": "click", "band": "mid"}
    )


_FACETED = """faceted AS (
  SELECT event_id, user_id, ts, value, event_type AS kind,
         CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'high' END AS band,
         CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS part
  FROM events)"""


def _loo_sql() -> str:
    parts = []
    where = {"kind": "kind = 'click'", "band": "band = 'mid'"}
    for facet, options in DOMAINS.items():
        rest = " AND ".join(w for k, w in where.items() if k != facet) or "TRUE"
        for o in options:
            parts.append(f"SELECT '{facet}' AS facet, '{o}' AS option, count(*) AS n FROM faceted WHERE {rest} AND {facet} = '{o}'")
    return f"WITH {_FACETED} " + " UNION ALL ".join(parts)


QUERIES = {"facet_counts": facet_counts}
ORACLES = {"facet_counts": _loo_sql()}
