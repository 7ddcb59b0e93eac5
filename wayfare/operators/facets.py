"""Facet filters and counts over one wide scan.

A facet is a named string column. A selection maps facet names to one wanted
value, with "all" (or absence) meaning no restriction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "all"


def matches(selection: dict[str, str], skip: str | None = None) -> Column:
    """True where a row meets every facet of the selection but `skip`."""
    tests = [F.col(k) == v for k, v in selection.items() if v != ALL and k != skip]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def valid_selection(selection: dict[str, str], domains: dict[str, list[str]]) -> dict[str, str]:
    """Unknown facets go; unknown values become "all"."""
    return {k: (selection.get(k) if selection.get(k) in d else ALL) for k, d in domains.items()}


def active_count(selection: dict[str, str]) -> int:
    return sum(v != ALL for v in selection.values())


def leave_one_out_counts(
    df: DataFrame, domains: dict[str, list[str]], selection: dict[str, str]
) -> DataFrame:
    """(facet, option, n): rows with that option that meet all OTHER facets' filters.

    One scan and one partial aggregation over fixed conditional counts, however
    many options there are; options nothing matches keep a zero.
    """
    counts = []
    for facet, options in domains.items():
        others = matches(selection, skip=facet)
        for option in options:
            counts.append((facet, option, F.count_if(others & (F.col(facet) == option))))
    row = df.agg(F.array(*[F.struct(F.lit(f).alias("facet"), F.lit(o).alias("option"), c.alias("n")) for f, o, c in counts]).alias("c"))
    return row.select(F.inline("c"))


def histogram(df: DataFrame, facet: str, options: list[str]) -> DataFrame:
    """Zero-filled counts of one facet."""
    row = df.agg(F.array(*[F.struct(F.lit(o).alias("option"), F.count_if(F.col(facet) == o).alias("n")) for o in options]).alias("c"))
    return row.select(F.inline("c"))


def parsed_selection(text: str | None, domains: dict[str, list[str]]) -> dict[str, str]:
    """A selection from its JSON; anything that cannot be read restricts nothing."""
    import json

    try:
        found = json.loads(text or "")
    except ValueError:
        found = {}
    return valid_selection(found if isinstance(found, dict) else {}, domains)
