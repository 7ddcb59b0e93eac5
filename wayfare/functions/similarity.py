"""Soft token similarity: tokens match when they are nearly spelt alike."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALIKE = 0.84


@lru_cache(1 << 17)
def _ratio(t: str, u: str) -> float:
    """How alike two tokens are spelt. Tokens repeat from set to set, so a task keeps what it has worked out."""
    return 1.0 if t == u else difflib.SequenceMatcher(None, t, u).ratio()


def soft_jaccard(a: list[str], b: list[str]) -> float:
    """Each token of a, in order, takes the best free token of b; ties go to the first."""
    if not len(a) or not len(b):
        return 0.0
    free, matched = list(b), 0
    for t in sorted(a):
        best = max(sorted(free), key=lambda u: _ratio(t, u), default=None)
        if best is not None and _ratio(t, best) >= ALIKE:
            matched += 1
            free.remove(best)
    return matched / (len(a) + len(b) - matched)


@F.pandas_udf(T.DoubleType())
def token_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else soft_jaccard(list(x), list(y)) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x, y) >= ALIKE for x, y in zip(a, b, strict=True)], dtype=bool)


def alike_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """(t, u): every token of left(t) with the tokens of right(u) nearly spelt alike; both distinct.

    Exact: of M letters matched in n single stretches, at least M - 1 others lie between, so
    a ratio of ALIKE without two letters in a row means M = 1 and equal tokens. Unequal ones
    hence share two letters in a row, and their lengths lie within the ratio.
    """
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) - 1), lambda i: F.substring(c, i, 2)))
    grams = lambda df, c: df.filter(F.char_length(c) > 1).select(c, F.explode(pairs(F.col(c))).alias("g"))
    m, n = F.char_length("t"), F.char_length("u")
    near = grams(left, "t").join(grams(right, "u"), "g").filter((F.col("t") != F.col("u")) & (2 * F.least(m, n) >= ALIKE * (m + n) - 1e-6))
    near = near.select("t", "u").distinct().filter(_alike("t", "u"))
    return near.union(left.join(right, F.col("t") == F.col("u")).select("t", "u"))


def scored_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """(ts, us, score): distinct token sets of left(tokens) and right(tokens) whose similarity is above 0.

    Candidates are all that can score above 0: sets that hold tokens nearly alike.
    """
    token = lambda df, name: df.select(F.col("tokens").alias(f"{name}s")).distinct().select(f"{name}s", F.explode(F.array_distinct(f"{name}s")).alias(name))
    a, b = token(left, "t"), token(right, "u")
    alike = alike_tokens(a.select("t").distinct(), b.select("u").distinct())
    sets = a.join(alike, "t").join(b, "u").select("ts", "us").distinct()
    return sets.withColumn("score", token_similarity("ts", "us")).filter("score > 0")


def best_matches(left: DataFrame, right: DataFrame, k: int = 3) -> DataFrame:
    """(l, r, score, rank): left(l, tokens) against right(r, tokens), the k best.

    Only distinct token sets are compared, and each distinct set of left is ranked once.
    """
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("ts").orderBy(F.desc("score"), "r"))
    best = scored_sets(left, right).join(right.withColumnRenamed("tokens", "us"), "us").withColumn("rank", rank).filter(F.col("rank") <= k)
    return left.withColumnRenamed("tokens", "ts").join(best, "ts").select("l", "r", "score", "rank")


def match_tier(best, second):
    """Tier of a match by name alone: the best score, and its lead on the second."""
    lead = best - F.coalesce(second, F.lit(0.0))
    return F.when((best >= 0.75) & (lead >= 0.2), "strong").when(best >= 0.5, "moderate").when(best >= 0.3, "weak").otherwise("none")


def combined_score(score, distance_m):
    """A candidate's score with its distance to a trusted place, up to 300 m, as further evidence."""
    near = F.greatest(F.lit(0.0), 1 - distance_m / 300)
    return F.when(distance_m.isNull(), score).when(score > 0, F.least(F.lit(1.0), score + 0.5 * near)).otherwise(0.45 * near)


def junction_tier(name, road, score, distance_m, combined, second):
    """Tier of the best candidate by name and road similarity, place and lead."""
    strong_name = (road >= 0.6) | (name >= 0.75)
    within = lambda m: F.coalesce(distance_m <= m, F.lit(False))
    lead = combined - F.coalesce(second, F.lit(0.0))
    strong = (strong_name & within(90)) | ((road >= 0.8) & (lead >= 0.15)) | (within(40) & (name >= 0.5) & (lead >= 0.2))
    moderate = strong_name | (within(90) & (score >= 0.25)) | (combined >= 0.6)
    return F.when(combined.isNull(), "none").when(strong, "strong").when(moderate, "moderate").when(combined >= 0.3, "weak").otherwise("none")
