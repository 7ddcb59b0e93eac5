"""Vector codes against a plain version in Python integers."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from wayfare.llm import vector_codes as V

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("rows", T.StringType())])


def plain(rows, entries=256):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], l) for i, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda v: [v[len(v) // 4 * p : len(v) // 4 * (p + 1)] for p in range(4)]
    books = [[cut(v)[p] for _, v, _ in sorted(kept, key=lambda r: (r[0], r[1]))[:entries]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda x, book: min((far(x, e), i) for i, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            of = collections.defaultdict(list)
            for _, v, _ in kept:
                of[pick(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [[sum(c) // len(of[i]) for c in zip(*of[i], strict=True)] if of[i] else e for i, e in enumerate(books[p])]
    said = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], collections.Counter()
    for i, v, label in kept:
        found = [pick(x, b) for x, b in zip(cut(v), books, strict=True)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        by[label] += out[-1][2]
    return collections.Counter((i, c, e, by[label], said) for i, c, e, label in out)


def made(n, seed, width=8):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centre)], rng.choice([1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("entries", [3, 40])
def test_codes_equal_the_plain_version(spark, entries):
    rows = made(400, entries)
    rows += [(7, rows[3][1], 1)] * 150 + [(None, rows[5][1], 2)]  # a third are one vector, with a repeated id
    rows += [(900, None, 1), (901, [None] * 8, 1), (902, [float("nan")] * 8, None), (903, [float("inf"), *[0.0] * 7], 2), (904, [], 1), (905, [1.0], 1)]
    df = spark.createDataFrame([(*r, "c", "x") for r in rows], SCHEMA).repartition(5)
    got = V.compress(df, entries=entries, block=32)
    want = plain([((r[0] if r[0] is not None else 10**6), *r[1:]) for r in rows if not r[1] or len(r[1]) != 1], entries)
    assert collections.Counter((r.vec_id if r.vec_id is not None else 10**6, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == want


def test_large_values_lengths_and_no_rows(spark):
    rows = [(i, [1e30 * (-1) ** i, 3.0 * i, 0.0, -1e9 * i, 5.0], 1) for i in range(9)]  # five components: zeros follow
    got = V.compress(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA), entries=4).collect()
    assert len(got) == 9 and all(r.error >= 0 and len(r.code) == 8 for r in got)
    assert V.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert V.compress(spark.createDataFrame([(1, None, 1, "", "")], SCHEMA)).count() == 0


def test_curve_takes_one_step_at_a_time():
    for dims, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims), -1).reshape(-1, dims)
        path = cells[np.argsort([bytes(r) for r in V.hilbert(cells, bits)])]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shortlist_keeps_every_nearest_entry():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x, books = rng.integers(-9, 9, (20, 4)), rng.integers(-40, 40, (30, 4))
        some = V.shortlist(x.min(0), x.max(0), books)
        best, far = V.nearest(x, books, 40)
        assert set(best) <= set(some) and (far == ((x[:, None] - books[None]) ** 2).sum(2).min(1)).all()
