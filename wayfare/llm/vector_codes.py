"""Vector codes: product quantisation in whole numbers over Hilbert-sorted flat blocks.

Components become integers, floor(scale * x), and vectors are cut into consecutive parts, each
with its codebook. Rows are laid out once along a Hilbert curve, in flat blocks that hold the
integers, their box (smallest and largest of each component) and their sums. In every round the
distances from a block's box to the entries give its shortlist: an entry goes when even the
nearest corner of the box is farther than another entry's farthest corner. A block with one entry
left adds its sums unread; the others are assigned by an exact product of integers over the
shortlist. Where values are small that product runs in doubles, which hold it exactly.

Only the codebooks (parts x entries integers rows) and their sums pass through the driver.

Defined cases. Rows whose vector is null, empty or holds null or non-finite components are left
out, and so are those with another length than the first kept vector. Where the length is no
multiple of the parts, zeros follow. Integers stop at a bound of 2 ** 29 / sqrt(components of a
part), which keeps every distance within a long. The first codebook takes vectors by vec_id (nulls
last), repeated ids by vector; fewer rows give fewer entries. Repeated rows are coded each. Null
labels stand together. An empty table gives no rows. Other columns, whatever their names, play no
part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.scratch import write_table

#: Rows of a block.
BLOCK = 1024
#: Components that the curve runs through (those that vary most), and bits of each.
CURVE, BITS = 32, 3


def whole(x: np.ndarray, scale: float, parts: int) -> np.ndarray:
    """floor(scale * x) within the bound, as rows of a multiple of `parts` components."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))
    bound = math.isqrt(2**60 // max(1, x.shape[1] // parts)) // 2
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -bound, bound).astype(np.int64)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Rows of small integers to their places on a Hilbert curve, as rows of bytes in order."""
    at = [c.astype(np.uint32) for c in cells.T]
    for q in range(bits - 1, 0, -1):  # turn each cube of side 2 ** q as the curve enters it
        low = np.uint32((1 << q) - 1)
        for i, c in enumerate(at):
            high = (c >> np.uint32(q)) & np.uint32(1) == 1
            flip = np.where(high, low, (at[0] ^ c) & low)
            at[0] = at[0] ^ flip
            if i:
                at[i] = np.where(high, c, c ^ flip)
    for i in range(1, len(at)):
        at[i] = at[i] ^ at[i - 1]
    turn = np.zeros(len(cells), np.uint32)
    for q in range(bits - 1, 0, -1):
        turn ^= np.where((at[-1] >> np.uint32(q)) & np.uint32(1) == 1, np.uint32((1 << q) - 1), np.uint32(0))
    at = [c ^ turn for c in at]
    return np.packbits(np.stack([(c >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1) for c in at], 1).astype(bool), axis=1)


def nearest(x: np.ndarray, entries: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest entry (ties to the lower index) and the squared distance, exactly."""
    kind = np.float64 if 8 * x.shape[1] * (largest + 1) ** 2 < 2**53 else np.int64
    far = (entries * entries).sum(1).astype(kind) - 2 * (x.astype(kind) @ entries.T.astype(kind))
    best = far.argmin(1)
    return best, far[np.arange(len(x)), best].astype(np.int64) + (x * x).sum(1)


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Indexes of the entries that may be nearest to some row of the box."""
    inside = np.maximum(np.maximum(low - entries, entries - high), 0)
    across = np.maximum(entries - low, high - entries)
    return np.flatnonzero((inside * inside).sum(1) <= (across * across).sum(1).min())


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _keys(first: np.ndarray, scale: float, parts: int):
    """Adds each row's place on the curve; the grid is that of the first codebook's vectors."""
    low, high = first.min(0), first.max(0)
    on = np.sort(np.argsort(low - high, kind="stable")[:CURVE])
    span = (high - low)[on] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = whole(_matrix(batch.column("vector")), scale, parts)[:, on]
                cells = np.clip(((x - low[on]) << BITS) // span, 0, (1 << BITS) - 1)
                place = pa.array([r.tobytes() for r in hilbert(cells, BITS)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, place], [*batch.schema.names, "place"])

    return run


def _blocks(scale: float, parts: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(_matrix(batch.column("vector")), scale, parts)
            cut = np.append(np.arange(0, len(x), size), len(x)).astype(np.int32)
            each = [x[a:b] for a, b in zip(cut, cut[1:], strict=False)]
            lists = [pa.ListArray.from_arrays(pa.array(cut), batch.column(c)) for c in ("vec_id", "label")]
            flat = [[b.tobytes() for b in each], [np.stack([b.min(0), b.max(0)]).tobytes() for b in each], [b.sum(0).tobytes() for b in each]]
            yield pa.RecordBatch.from_arrays([*lists, *(pa.array(c, pa.binary()) for c in flat)], ["ids", "labels", "rows", "box", "sums"])

    return run


def _read(batch: pa.RecordBatch, books: np.ndarray):
    """(rows, box, sums) of each block, by part."""
    parts, _, width = books.shape
    for rows, box, sums in zip(*(batch.column(c) for c in ("rows", "box", "sums")), strict=True):
        x = np.frombuffer(rows.as_py(), np.int64).reshape(-1, parts, width)
        low, high = np.frombuffer(box.as_py(), np.int64).reshape(2, parts, width)
        yield x, low, high, np.frombuffer(sums.as_py(), np.int64).reshape(parts, width)


def _round(books: np.ndarray):
    """Number of rows and sums of each entry over the blocks of a task."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for x, low, high, sums in _read(batch, books):
                for p in range(parts):
                    some = shortlist(low[p], high[p], books[p])
                    if len(some) == 1:
                        n[p, some[0]] += len(x)
                        total[p, some[0]] += sums[p]
                        continue
                    mine = np.ascontiguousarray(x[:, p])
                    best, _ = nearest(mine, books[p][some], max(np.abs(low[p]).max(), np.abs(high[p]).max(), np.abs(books[p]).max()))
                    order = np.argsort(best, kind="stable")
                    met, at, count = np.unique(best[order], return_index=True, return_counts=True)
                    n[p, some[met]] += count
                    total[p, some[met]] += np.add.reduceat(mine[order], at, axis=0)
        p, e = np.nonzero(n)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])

    return run


def _coded(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = [], []
            for x, low, high, _ in _read(batch, books):
                found, far = np.empty((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
                for p in range(len(books)):
                    some = shortlist(low[p], high[p], books[p])
                    best, apart = nearest(np.ascontiguousarray(x[:, p]), books[p][some], max(np.abs(low[p]).max(), np.abs(high[p]).max(), np.abs(books[p]).max()))
                    found[:, p] = some[best]
                    far += apart
                digits, step = found.tobytes().hex(), 2 * len(books)
                code += [digits[i : i + step] for i in range(0, len(digits), step)]
                error.append(far)
            if code:
                lists = [batch.column(c).flatten() for c in ("ids", "labels")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(code), pa.array(np.concatenate(error))], ["vec_id", "label", "code", "error"])

    return run


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, block: int = BLOCK,
) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256), one row per kept vector.

    code: two hexadecimal digits per part; error: squared distance to the entries, over all parts;
    label_error: that of all rows of the label; codebooks_sha256: of the final entries' integers,
    by part, entry and position, joined by commas. entries: at most 256.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~bad)
    kinds = {f.name: f.dataType for f in rows.schema}
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    head = rows.orderBy(*order).limit(entries).collect()
    width = len(head[0].vector) if head else parts
    if any(len(r.vector) != width for r in head):
        head = rows.filter(F.size("vector") == width).orderBy(*order).limit(entries).collect()
    coded = T.StructType([T.StructField("vec_id", kinds["vec_id"]), T.StructField("label", kinds["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not head:
        return spark.createDataFrame([], coded.add("label_error", T.LongType()).add("codebooks_sha256", T.StringType()))
    first = whole(np.array([r.vector for r in head]), scale, parts)
    books = first.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()

    keyed = T.StructType([*rows.schema.fields, T.StructField("place", T.BinaryType())])
    placed = rows.filter(F.size("vector") == width).mapInArrow(_keys(first, scale, parts), keyed)
    # equal vectors are spread by id, and equal rows by their number in the scan
    placed = placed.withColumn("number", F.monotonically_increasing_id()).repartitionByRange("place", "vec_id", "number").sortWithinPartitions("place")
    flat = T.StructType([T.StructField("ids", T.ArrayType(kinds["vec_id"])), T.StructField("labels", T.ArrayType(kinds["label"])), *(T.StructField(c, T.BinaryType()) for c in ("rows", "box", "sums"))])
    blocks = write_table(placed.drop("number").mapInArrow(_blocks(scale, parts, block), flat), "vector-blocks")

    for _ in range(rounds):
        each = blocks.select("rows", "box", "sums").mapInArrow(_round(books), "part int, entry int, n long, total array<long>")
        sums = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(books.shape[2])]
        books = books.copy()
        for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
            books[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(books.shape[2])]
    final = write_table(blocks.mapInArrow(_coded(books), coded), "vector-codes")
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    label_sums = final.groupBy(F.col("label").alias("_of")).agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"))
    said = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return final.join(label_sums, F.col("label").eqNullSafe(F.col("_of"))).select("vec_id", "label", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))
