"""Best-fit packing by exact complements.

Documents become ids and are cut into pieces no longer than a sequence. The pieces are then known
by length alone: the plan is made from the number of pieces of each length, which is no more rows
than a sequence has places, whatever the corpus. The longest length left opens a sequence; the
gap is looked up in indexes of the lengths, of sums of two and of sums of three, and a combination
that fills it to the last place is consumed as often as the counts allow. Where none does, the
longest piece that fits goes in and the rest of the gap is looked up again, so that what no
combination fills is best-fit. Every step of the plan uses some length up, so it has at most as
many patterns as there are lengths. Pieces then find their place from their rank among the pieces
of their length; nothing but counts passes through the driver.

Ids are those of the tokenizer file by its own library; they are found by merging the file's ranks
with another library that does so in a quarter of the time, and tests hold the two equal.

Defined cases. Null text is an empty document: one id, the end mark. Strings of special tokens in
a text are ordinary text. A document longer than a sequence, however long, is cut into whole
sequences from its end, so that its first piece may be shorter. Repeated rows
are packed each; ties among pieces of a length are settled by where they were read. An empty
table gives no rows. Other columns, whatever their names, play no part; doc_id may be of any type.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wayfare.scratch import write_table


def ranks(path: str) -> dict[bytes, int]:
    """Bytes to ids of a byte-level tokenizer file, whose merges run in the order of ids.

    The file shows a byte as its own sign where that prints, else as the signs from 256 on.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(prints)))}
    added = {t["content"] for t in model["added_tokens"]}
    return {bytes(byte[c] for c in token): n for token, n in model["model"]["vocab"].items() if token not in added}


def coder(ranks: dict[bytes, int], pattern: str):
    """From a text to an array of its ids, which are those of the tokenizer file."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy


def _pieces(vocabulary, pattern: str, end: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, met = coder(vocabulary.value, pattern), TaskContext.get().partitionId(), [0] * (room + 1)
        kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "rank": pa.int64()}
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), end).astype("<u4")
                head = len(ids) % room or room
                for piece, s in enumerate([0, *range(head, len(ids), room)]):
                    n = room if s else head
                    rows.append(row)
                    out.append((piece, s, n, zlib.crc32(ids[s : s + n]), met[n]))
                    met[n] += 1
            if rows:
                columns = [batch.column("doc_id").take(pa.array(rows)), pa.array([task] * len(rows), pa.int32())]
                columns += [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "task", *kinds])

    return run


def pieces(docs: DataFrame, path: str, pattern: str, end: int = 0, room: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, task, piece, start, length, ids_crc32, rank): rank counts pieces of a length in a task.

    path: a byte-level tokenizer file, which the driver reads; the tasks get its ranks, a few megabytes.
    pattern: how its texts are split into words.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(ranks(path))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("task", T.IntegerType()), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "rank"))])
    return write_table(rows.mapInArrow(_pieces(vocabulary, pattern, end, room), kind), "pieces")


class Complements:
    """Lengths still available, indexed by single, pair and triple sums.

    An index holds for each sum the combination found last; what has been used up since is
    looked for anew, from the longest member down, and never further up.
    """

    def __init__(self, count: list[int]):
        self.count = count
        self.lengths = [n for n in range(len(count) - 1, 0, -1) if count[n]]
        self.pairs: dict[int, int] = {}
        self.triples: dict[int, int] = {}

    def holds(self, lengths: list[int], used: dict[int, int] | None = None) -> bool:
        """Whether the lengths are there, beside those used."""
        return all(self.count[n] >= lengths.count(n) + (used.get(n, 0) if used else 0) for n in lengths)

    def pair(self, total: int) -> list[int]:
        at = self.pairs.get(total, total - 1)
        while 2 * at >= total and not (self.count[at] and self.holds([at, total - at])):
            at -= 1
        self.pairs[total] = at
        return [at, total - at] if 2 * at >= total else []

    def triple(self, total: int) -> list[int]:
        at = self.triples.get(total, total - 2)
        while 3 * at >= total:
            self.triples[total] = at
            if self.count[at]:
                rest = self.pair(total - at)
                if rest and self.holds([at, *rest]):
                    return [at, *rest]
            at -= 1
        self.triples[total] = at
        return []

    def filling(self, gap: int, used: dict[int, int]) -> list[int]:
        """Lengths that fill the gap exactly beside those used, or none."""
        for found in ([gap] if self.count[gap] else [], self.pair(gap), self.triple(gap)):
            if found and self.holds(found, used):
                return found
        return []


def plan(count: list[int], room: int) -> list[tuple[int, dict[int, int]]]:
    """(times, pieces of each length) patterns that use count[n] pieces of every length n; few sequences in sum."""
    left = Complements(list(count))
    made, longest = [], room
    while True:
        while longest and not left.count[longest]:
            longest -= 1
        if not longest:
            return made
        used, gap, fits = {longest: 1}, room - longest, longest
        while gap:
            found = left.filling(gap, used)
            if not found:  # best fit: the longest piece that goes in
                fits = min(fits, gap)
                while fits and left.count[fits] <= used.get(fits, 0):
                    fits -= 1
                found = [fits] if fits else []
            if not found:
                break
            for n in found:
                used[n] = used.get(n, 0) + 1
                gap -= n
        times = min(left.count[n] // k for n, k in used.items())
        for n, k in used.items():
            left.count[n] -= k * times
        made.append((times, used))


def slots(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, rank from, sequence from, places of the length in a sequence, offset), in order of length and rank."""
    rows, sequence, rank = [], 0, {}
    for times, used in patterns:
        offset = 0
        for n, k in used.items():
            rows.append((n, rank.get(n, 0), sequence, k, offset))
            rank[n] = rank.get(n, 0) + k * times
            offset += k * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(table: np.ndarray, room: int):
    first, stop = (np.searchsorted(table[:, 0], np.arange(room + 1), side) for side in ("left", "right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(n), np.int64)
            for x in np.unique(n):
                mine = n == x
                at[mine] = first[x] + np.searchsorted(table[first[x] : stop[x], 1], rank[mine], "right") - 1
            past = rank - table[at, 1]
            keep = [c for c in batch.schema.names if c != "rank"]
            columns = [*(batch.column(c) for c in keep), pa.array(table[at, 2] + past // table[at, 3]), pa.array(table[at, 4] + past % table[at, 3] * n)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "sequence_id", "offset"])

    return run


def pack(cut: DataFrame, room: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows with (task, length, rank); ranks run from 0 in each task and length."""
    counts = write_table(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    count = [0] * (room + 1)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        count[r.length] = r.n
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(base, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("task", "before")
    kind = T.StructType([*(f for f in ranked.schema if f.name != "rank"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_placed(slots(plan(count, room)), room), kind)
