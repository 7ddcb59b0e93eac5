"""Sharding by a minimax contiguous partition.

Atomic groups (equal texts) stand in the order of a 64-bit hash of their text, and
are cut into contiguous shards so that the largest shard is as small as it can be:
the smallest feasible capacity is found by binary search, each capacity checked
greedily, and the cuts of that capacity are taken.

The order is never sorted and no list of groups is gathered. The driver holds the
byte sums of at most RUNS hash ranges. Known sums bound where each greedy cut can
fall, and so the capacity from both sides; only ranges in which a cut may fall are
divided further, the heaviest first, until the capacity is exact. That takes one narrow
aggregation a round and level: at most OPEN ranges are divided at once, each into RUNS / OPEN
parts or more, so every round goes deeper. A text heavier than a shard is soon a range of
its own, and then bounds the capacity exactly.

Defined cases. Null text: no bytes, grouped with the empty text. Size is bytes plus
one, so no group is empty. Rows with equal text stay together whatever their ids.
Texts that differ but share the 64-bit hash count as one group, which keeps the
guarantee. With fewer groups than shards, some shards are empty. An empty table
gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.llm.common import free_name
from wayfare.scratch import write_table

#: Most hash ranges whose sums the driver holds from one round.
RUNS = 8192
#: Most ranges divided in one round.
OPEN = 256


class _Run(NamedTuple):
    """A hash range: the hashes that share their leading `level` bits."""

    first: int  # least hash in it
    size: int
    single: bool  # one group only
    level: int
    prefix: int


class _Runs:
    """Consecutive hash ranges, and what their sums tell of the greedy cuts."""

    def __init__(self, runs: list[_Run]):
        self.runs = runs
        self.ends = [0]
        for run in runs:
            self.ends.append(self.ends[-1] + run.size)
        self.total = self.ends[-1]

    def at_most(self, x: int) -> int:
        """The largest known boundary up to x."""
        return self.ends[bisect_right(self.ends, x) - 1]

    def upper(self, x: int) -> int:
        """No boundary up to x lies beyond this."""
        i = bisect_right(self.ends, x) - 1
        if i >= len(self.runs):
            return self.total
        return self.ends[i] if self.runs[i].single else min(x, self.total)

    def cuts(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Bounds (lowest, highest) of each greedy cut."""
        low = high = 0
        out = []
        for _ in range(shards):
            low, high = self.at_most(low + capacity), self.upper(high + capacity)
            out.append((low, high))
        return out

    def bracket(self, shards: int) -> tuple[int, int]:
        """The largest capacity known to fail, the smallest known to do."""

        def smallest(ok) -> int:
            a, b = -1, self.total
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (a, mid) if ok(mid) else (mid, b)
            return b

        may = smallest(lambda c: self.cuts(c, shards)[-1][1] >= self.total)
        sure = smallest(lambda c: self.cuts(c, shards)[-1][0] >= self.total)
        return may - 1, sure

    def open_runs(self, shards: int) -> set[int]:
        """Divisible ranges in which a cut of the best capacity may fall."""
        fails, does = self.bracket(shards)
        found = set()
        for (low, _), (_, high) in zip(self.cuts(fails + 1, shards), self.cuts(does, shards), strict=True):
            i = max(0, bisect_right(self.ends, low) - 1)
            while i < len(self.runs) and self.ends[i] < high:
                if not self.runs[i].single:
                    found.add(i)
                i += 1
        return found


def _divide(sizes: DataFrame, level: int, prefixes: list[int], bits: int) -> list[_Run]:
    """The runs, `bits` levels deeper, within the given ones; all of them if level is 0."""
    deeper = min(64, level + bits)
    inside = sizes.filter(F.shiftright("h", 64 - level).isin(prefixes)) if level else sizes
    got = (
        inside.groupBy(F.shiftright("h", 64 - deeper).alias("prefix"))
        .agg(F.sum("size").alias("size"), F.min("h").alias("a"), F.max("h").alias("b"))
        .collect()
    )
    return [_Run(r["a"], r["size"], r["a"] == r["b"], deeper, r["prefix"]) for r in got]


def shard_bounds(sizes: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity, and the first hash of each shard after the first.

    sizes: columns h (long) and size (long).
    """
    known = _Runs(sorted(_divide(sizes, 0, [], RUNS.bit_length() - 1)))
    while known.total and (todo := known.open_runs(shards)):
        todo = set(sorted(todo, key=lambda i: -known.runs[i].size)[:OPEN])
        bits = (RUNS // len(todo)).bit_length() - 1
        finer = [r for i, r in enumerate(known.runs) if i not in todo]
        for level in {known.runs[i].level for i in todo}:
            finer += _divide(sizes, level, [known.runs[i].prefix for i in todo if known.runs[i].level == level], bits)
        known = _Runs(sorted(finer))
    if not known.total:
        return 0, []
    capacity = known.bracket(shards)[1]
    first = []
    for low, _ in known.cuts(capacity, shards)[:-1]:
        i = bisect_right(known.ends, low) - 1
        first.append(known.runs[i].first if i < len(known.runs) else None)
    return capacity, first


def shard(
    docs: DataFrame, shards: int = 16, rows_per_bucket: int = 20_000, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, size, text_crc32, h, shard, slot): one row per row of docs.

    Slots are gapless within a shard. They count first by bucket (a hash of the
    row's id, so copies spread), then within the bucket, so no task sorts a shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = write_table(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.xxhash64(body).alias("h"),
        ),
        "shard-sizes",
    )
    _, first = shard_bounds(rows.select("h", "size"), shards)
    at = F.lit(0)
    for x in first:
        if x is not None:
            at = at + F.when(F.col("h") >= F.lit(x), 1).otherwise(0)
    buckets = max(1, -(-rows.count() // rows_per_bucket))
    placed = rows.withColumn("shard", at.cast("int")).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(buckets))
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "h")
    return (
        placed.withColumn("place", F.row_number().over(within) - 1)
        .join(starts, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "h", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))
    )


def with_shards(docs: DataFrame, shards: int = 16, text: str = "text") -> DataFrame:
    """docs with a column `shard` (renamed with underscores if docs has one).

    Needs no join: the cuts are at most shards - 1 constants.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    sizes = write_table(
        docs.select(F.xxhash64(body).alias("h"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size")), "shard-sizes"
    )
    _, first = shard_bounds(sizes, shards)
    at = F.lit(0)
    for x in first:
        if x is not None:
            at = at + F.when(F.xxhash64(body) >= F.lit(x), 1).otherwise(0)
    return docs.withColumn(free_name(docs, "shard"), at.cast("int"))
