"""Predictions under the traffic asked for, against sums over every encounter."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from wayfare.operators import predict

WEEK = 604_800.0


def circular(a, b, length):
    d = abs(a - b) % length
    return min(d, length - d)


def estimate(samples, t, now, x):
    """(mean, effective n) of the kernel at t; samples: (seconds, delay, quality, congestion)."""
    total = squares = mean = 0.0
    for s, delay, quality, c in samples:
        w = math.exp(-(circular(t % 86400, s % 86400, 86400.0) ** 2) / (2 * 900.0**2)) * math.exp(-(circular(t % WEEK, s % WEEK, WEEK) ** 2) / (2 * 259200.0**2)) * math.exp(-max(0.0, now - s) / 3888000.0) * quality
        if x is not None and c is not None:
            w *= math.exp(-((min(1, max(0, x)) - min(1, max(0, c))) ** 2) / (2 * 0.25**2))
        total, squares, mean = total + w, squares + w * w, mean + w * delay
    return (mean / total, total * total / squares) if total else (None, 0.0)


def test_encounters_under_like_traffic_weigh_more(spark):
    rng = random.Random(5)
    now = datetime.datetime(2024, 1, 30, 8, 0)
    zero = datetime.datetime(1970, 1, 1)
    rows, plain = [], []
    for k in range(90):
        at = now - datetime.timedelta(days=rng.randrange(0, 14), minutes=rng.randrange(0, 60)) if k >= 6 else now - datetime.timedelta(minutes=7 * k + 1)
        c = rng.choice([None, 0.1, 0.5, 0.9, 1.4])
        delay = 20.0 + 40 * (c or 0.3) + rng.random()
        rows.append((1, at, delay, delay > 40, 1.0 - 0.3 * rng.random(), None, c))
        plain.append(((at - zero).total_seconds(), delay, rows[-1][4], c))
    e = spark.createDataFrame(rows, "junction int, ts timestamp_ntz, delay double, stopped boolean, quality double, resumed timestamp_ntz, congestion double")
    windows = spark.createDataFrame([], "junction int, plan_ord int, win_ord int, day_type string, start string, end string, mode string, phases array<int>, cycle_s int, ped int, cycle_source string")
    linked = spark.createDataFrame([], "junction int, control string, standing string, conflict boolean")
    asked = [(1, 0.9), (2, 0.1), (3, None), (4, -3.0)]
    q = spark.createDataFrame([(i, 1, now, None, x) for i, x in asked], "qid long, junction int, t timestamp_ntz, phase int, congestion double")
    got = {r["qid"]: r for r in predict.predict(q, e, windows, linked, F.lit(now).cast("timestamp_ntz")).collect()}
    end = (now - zero).total_seconds()
    for i, x in asked:
        mean, n = estimate(plain, end, end, x)
        recent = []
        for s, delay, quality, _ in plain:
            if end - s < 5400:
                base, m = estimate(plain, s, end, x)
                if m >= 8:
                    recent.append((delay - base, math.exp(-(end - s) / 1800) * quality))
        sizes = sorted(abs(r) for r, _ in recent)
        most = sizes[min(len(sizes) - 1, int(0.99 * len(sizes)))] if sizes else 0
        move = 0.5 * sum(w * max(-most, min(most, r)) for r, w in recent) / sum(w for _, w in recent) if len(recent) >= 3 else 0
        assert n >= 8 and got[i]["level"] == "C" and got[i]["recent_n"] == len(recent)
        assert got[i]["mean"] == pytest.approx(max(0, mean + move), rel=1e-9)
    assert got[1]["mean"] > got[3]["mean"] > got[2]["mean"] and got[2]["mean"] != got[4]["mean"]
