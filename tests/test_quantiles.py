"""Weighted quantiles against one ordered pass, with values far from the others, and medians by counts."""

import random

import pytest

from wayfare.operators import stats

QS = {"p10": 0.1, "p50": 0.5, "p99": 0.99}


def plain(pairs, q):
    total, upto = sum(w for _, w in pairs), 0.0
    for v, w in sorted(pairs):
        upto += w
        if upto / total >= q - 1e-12:
            return v
    return max(v for v, _ in pairs)


@pytest.mark.parametrize("few", [3, 40, 100_000])
def test_far_values_cost_rounds_only(spark, few):
    rng = random.Random(few)
    rows = [("a", rng.random() * 10, rng.random()) for _ in range(600)] + [("a", 1e9, 0.5), ("a", -1e15, 0.1)]
    rows += [("b", 2.0**k, 1.0) for k in range(40)] + [("c", 7.0, 1.0)] * 50 + [("d", 1.0, 0.0), (None, 3.0, 1.0), ("e", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(3)
    got = {r["g"]: r for r in stats.weighted_quantiles(df, ["g"], "v", "w", QS, few=few).collect()}
    for g in "abc":
        mine = [(v, w) for k, v, w in rows if k == g]
        assert [got[g][n] for n in QS] == [plain(mine, q) for q in QS.values()]
    assert "d" not in got and "e" not in got
    one = stats.weighted_quantiles(df.filter("g = 'a'"), [], "v", "w", QS, few=few).first()
    assert [one[n] for n in QS] == [got["a"][n] for n in QS]


def test_medians_by_counts(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.randrange(5)), rng.random()) for g in "xyz" for _ in range(rng.randrange(1, 30))]
    got = {r["g"]: (r["a"], r["b"]) for r in stats.upper_medians(spark.createDataFrame(rows, "g string, a double, b double"), "g", ["a", "b"]).collect()}
    middle = lambda vs: sorted(vs)[len(vs) // 2]
    assert got == {g: tuple(middle([r[i] for r in rows if r[0] == g]) for i in (1, 2)) for g in "xyz"}
