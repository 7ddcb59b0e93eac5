"""Residuals over a stream, stopped and started, against the batch form at the last watermark."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from wayfare.operators import stats
from wayfare.streaming import residuals

SHAPE = "ts timestamp, junction long, residual double, quality double"
START = datetime.datetime(2024, 1, 31, 22, 0, tzinfo=datetime.UTC)
TAU = 1800.0


def made(n, seed, digits):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        r = rng.choice([None, round(rng.gauss(0, 9), digits), round(rng.gauss(0, 9), digits), round(rng.choice([-1, 1]) * rng.uniform(300, 900), digits) if i % 90 == 0 else 1.5])
        rows.append((START + datetime.timedelta(seconds=10 * i * 1200 / n), 0 if rng.random() < 0.5 else rng.randrange(1, 5), r, rng.random()))
    rows += [(START + datetime.timedelta(seconds=60 * k), 9, float(k), 1.0) for k in range(200)]  # on the ends of slices
    return sorted(rows, key=lambda r: r[0])


def answers(df):
    return {r.junction: (r.adjustment, r.recent_n) for r in df.collect()}


@pytest.mark.parametrize(("digits", "off"), [(1, 1e-9), (6, 0.05)])
def test_slices_fold_to_the_batch_form(spark, digits, off):
    df = spark.createDataFrame(made(3000, 4, digits), SHAPE)
    slices = residuals.residual_slices(df, ["junction"], TAU)
    for minutes in (30, 91, 150, 199):
        now = F.lit(START + datetime.timedelta(minutes=minutes))
        want = answers(stats.recent_residuals(df.filter(F.col("ts") <= now), ["junction"], now, TAU))
        got = answers(residuals.residuals_at(slices, ["junction"], now, TAU))
        assert got.keys() == want.keys()
        for k, (a, n) in want.items():
            assert got[k][1] == n and got[k][0] == pytest.approx(a, abs=off)


def test_stream_equals_batch_at_its_watermark(spark, tmp_path):
    rows = made(2000, 8, 1)
    cuts = [rows[: len(rows) // 3], rows[len(rows) // 3 : len(rows) // 2], rows[len(rows) // 2 :]]
    folder = str(tmp_path / "in")
    for part in cuts:  # stopped and started again after each
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(folder)
        residuals.residual_stream(source, str(tmp_path / "out"), str(tmp_path / "ck"), ["junction"], TAU, late="10 minutes").awaitTermination()
    # the last watermark: ten minutes before the last row, cut to a whole slice
    last = rows[-1][0] - datetime.timedelta(minutes=10, microseconds=1)
    now = F.lit(last.replace(second=0, microsecond=0))
    df = spark.createDataFrame(rows, SHAPE)
    want = answers(stats.recent_residuals(df.filter(F.col("ts") <= now), ["junction"], now, TAU))
    slices = residuals.slices_since(spark, str(tmp_path / "out"), "junction long", now, TAU)
    got = answers(residuals.residuals_at(slices, ["junction"], now, TAU))
    assert len(want) == 6 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_few_none_and_empty(spark):
    t = START + datetime.timedelta(seconds=30)
    df = spark.createDataFrame([(t, 1, 5.0, 1.0), (t, 1, None, 1.0), (None, 1, 2.0, 1.0), (t, 2, 1.0, 0.0), (t, 2, 1.0, 0.0), (t, 2, 1.0, 0.0)], SHAPE)
    now = F.lit(START + datetime.timedelta(minutes=1))
    assert answers(residuals.residuals_at(residuals.residual_slices(df, ["junction"]), ["junction"], now)) == {1: (0.0, 1), 2: (0.0, 3)}
    assert answers(residuals.residuals_at(residuals.residual_slices(df.limit(0), ["junction"]), ["junction"], now)) == {}
