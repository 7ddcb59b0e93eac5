"""The quality pass against a plain loop over groups of blocks, also with a name that a third of the blocks bear."""

import itertools
import random

from pyspark.sql import functions as F

from wayfare.operators import quality

SHAPE = "key string, name_key string, sig string, tier string, target long, currency string, _sig int"


def plain(rows):
    """key -> (duplicate_of, opponents, flags)"""
    first, dup, foes, flags = {}, {}, {r[0]: set() for r in rows}, {r[0]: set() for r in rows}
    timed = [r for r in sorted(rows) if r[2]]
    for r in timed:
        if first.setdefault((r[1] or "", r[2]), r[0]) != r[0]:
            dup[r[0]] = first[r[1] or "", r[2]]
            flags[r[0]].add("duplicate")
    for a, b in itertools.permutations(timed, 2):
        if (a[1] or "") == (b[1] or "") and a[2] != b[2]:
            foes[a[0]].add(b[0])
            flags[a[0]].add("conflicting_timings")
    live = [r for r in timed if r[0] not in dup and r[4] is not None and r[3] in ("strong", "moderate")]
    for place in {r[4] for r in live}:
        own = [r for r in live if r[4] == place]
        if len({r[1] or "" for r in own}) < 2 or len({r[2] for r in own}) < 2:
            continue
        for a, b in itertools.permutations(own, 2):
            if a[2] != b[2]:
                foes[a[0]].add(b[0])
                flags[a[0]].add("conflicting_target")
    for r in rows:
        flags[r[0]] |= ({"weak_match"} if r[3] in ("weak", "none") else set()) | ({f"{r[5]}_document"} if r[5] in ("stale", "undated") else set())
    return {r[0]: (dup.get(r[0]), len(foes[r[0]]), sorted(flags[r[0]])) for r in rows}, foes


def made(n, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice([None, "", *"abcdefgh"]) if rng.random() > 0.35 else "hot"
    return [(f"k{i:04d}", name(), rng.choice([None, "", *"uvwxyz"]), rng.choice(["strong", "moderate", "weak", "none", None]), rng.choice([None, *range(9)]), rng.choice([None, "stale", "undated", "current"]), i) for i in range(n)]


def test_flags_equal_plain_loop(spark):
    for n, seed in ((240, 1), (40, 2), (1, 3)):
        rows = made(n, seed)
        df = spark.createDataFrame(rows, SHAPE).withColumnRenamed("_sig", "conflicts")
        got = {r.key: (r.duplicate_of, r.conflicts, r.quality_flags) for r in quality.block_flags(df).collect()}
        assert got == plain(rows)[0]


def test_members_say_who_conflicts(spark):
    rows = made(160, 5)
    members = quality.conflict_members(spark.createDataFrame(rows, SHAPE)).collect()
    foes = {r[0]: set() for r in rows}
    for a, b in itertools.permutations(members, 2):
        if (a.kind, a.place) == (b.kind, b.place) and a.sig != b.sig:
            foes[a.key].add(b.key)
    assert foes == plain(rows)[1]


def test_empty_and_names(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert quality.block_flags(empty).count() == 0 and quality.conflict_members(empty).count() == 0
    got = spark.createDataFrame([("MG Rd. Jn", None), ("mg road jn", "")], "n string, s string").select(quality.name_key(F.col("n"), F.col("s")).alias("k")).collect()
    assert got[0].k == got[1].k and got[0].k.endswith("|")
