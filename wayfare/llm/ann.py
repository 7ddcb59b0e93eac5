"""Approximate nearest neighbours by additive quantisation.

A vector's direction is coded as a sum of one full-dimensional codeword from each of
several codebooks, found by beam search over the residuals; its norm is stored beside.
A query's inner products with all codewords make a lookup table, by which every coded
vector is scored (the stored norm times the sum of its entries); the best of each block
of the index, and any level with them, are then scored exactly on the original vectors, and the exact best kept.

Codebooks are trained on at most `sample` vectors (lowest hashes of vec_id), which is the
documented bound; every vector is coded. The index is dealt into parts of about PART bytes
of vectors (smaller ones while there are fewer parts than tasks at once), and each query goes to every part: a task holds one part and takes the queries
as they come, QUERIES at a time, so nothing but the codebooks is sent to all tasks and
neither the driver nor a task holds all queries. Each part keeps its k best for each query.

Defined cases. Null vectors, vectors of another dimension than most of the sample has,
zero vectors and vectors with null or non-finite components take no part, as query or
candidate. Rows with null vec_id are left out; vec_id must be whole numbers (it is cast to
long). Rows that share a vec_id are candidates each, but never for a query of that id; of
query rows that share one, the least vector is the query, so a query_id has one list. Ties
go to the smaller vec_id. With fewer candidates than k, all are returned. Other columns,
whatever their names, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.scratch import write_table

BOOKS, WORDS, BEAM = 8, 256, 8
#: Bytes of a part of the index, rows of a block (from which `rerank` are scored exactly), queries at once.
PART, BLOCK, QUERIES = 32 << 20, 4096, 256


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col(vec_id).isNotNull() & (F.size(e) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda x: x != 0)
    return vectors.filter(e.isNotNull()).filter(ok).select(F.col(vec_id).cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1) - 2 * x @ words.T).argmin(1)


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """(books, words, dim): residual k-means, one book upon another."""
    rng = np.random.default_rng(seed)
    rest = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
    out = []
    for _ in range(books):
        book = rest[rng.choice(len(rest), min(words, len(rest)), replace=False)].copy()
        for _ in range(rounds):
            own = _nearest(rest, book)
            count = np.bincount(own, minlength=len(book)).astype(np.float32)
            total = np.zeros_like(book)
            np.add.at(total, own, rest)
            book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
        rest = rest - book[_nearest(rest, book)]
        out.append(np.concatenate([book, np.zeros((words - len(book), book.shape[1]), np.float32)]))
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """(n, books) codes of directions x, by beam search over residuals."""
    n, d = x.shape
    rest, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8)
    for book in books:
        # distance of each beam's residual to each word; the residual's own norm decides between beams
        cost = (rest**2).sum(2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(1)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        b, w = best // len(book), best % len(book)
        rest = np.take_along_axis(rest, b[:, :, None], 1) - book[w]
        codes = np.concatenate([np.take_along_axis(codes, b[:, :, None], 1), w[:, :, None].astype(np.uint8)], 2)
    last = (rest**2).sum(2).argmin(1)
    return codes[np.arange(n), last]


def _encoder(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("embedding"))
                norm = np.linalg.norm(x, axis=1)
                codes = encode(x / norm[:, None], books.value)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array(norm), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "embedding", "norm", "codes"])

    return run


def build_index(vectors: DataFrame, sample: int = 20_000, **kw) -> tuple[DataFrame, np.ndarray | None]:
    """Every usable vector with its norm and codes, and the codebooks."""
    rows = usable(vectors, **kw)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(drawn):
        return rows.withColumn("norm", F.lit(0.0)).withColumn("codes", F.lit(b"")), None
    lengths = np.diff(drawn.offsets.to_numpy())
    dim = int(np.bincount(lengths).argmax())
    books = train(_matrix(drawn.filter(pa.array(lengths == dim))))
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    rows = rows.filter(F.size("embedding") == dim)
    return write_table(rows.mapInArrow(_encoder(shared), "vec_id long, embedding array<double>, norm double, codes binary"), "ann-index"), books


def _reduced(vid: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows of a block without those that cannot be among any query's k best.

    Of equal vectors the smaller ids come first. A query passes over the rows of its own id,
    so of rows equal in both k are enough, and then 2k of a vector.
    """
    same = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{x.shape[1] * x.itemsize}")[:, 0], return_inverse=True)[1]
    if len(vid) <= k or np.bincount(same).max() <= k:
        return np.arange(len(vid))

    def place(new: np.ndarray) -> np.ndarray:
        """The number of each row within its run; new: where runs begin."""
        at = np.arange(len(new))
        return at - np.maximum.accumulate(np.where(new, at, 0))

    o = np.lexsort((vid, same))
    s, v = same[o], vid[o]
    o = o[place(np.r_[True, (s[1:] != s[:-1]) | (v[1:] != v[:-1])]) < k]
    s = same[o]
    return np.sort(o[place(np.r_[True, s[1:] != s[:-1]]) < 2 * k])


def _searcher(shared, k: int, rerank: int):
    """(query_id, vec_id, score) from rows sorted by part, the index rows of each before the queries."""

    def nearest(blocks, best, books, qid, q) -> None:
        tables = np.ascontiguousarray(books @ q.T.astype(np.float32))  # (books, words, queries)
        for vid, x, norm, codes in blocks:
            top = min(len(vid), rerank)
            approx = tables[0][codes[:, 0]]
            for m in range(1, len(tables)):
                approx += tables[m][codes[:, m]]
            approx *= norm[:, None]
            approx[vid[:, None] == qid[None, :]] = -np.inf
            # the best `top` and all that are level with the last of them
            last = -np.partition(-approx, top - 1, axis=0)[top - 1]
            near = ((approx >= last) & (approx > -np.inf)).T
            for j in range(len(qid)):
                i = np.flatnonzero(near[j])
                exact = (x[i] * q[j]).sum(1)
                s, v = np.concatenate([best[j][0], exact]), np.concatenate([best[j][1], vid[i]])
                o = np.lexsort((v, -s))[:k]
                best[j] = s[o], v[o]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, blocks = None, [], []

        def answer(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, rows.num_rows, QUERIES):
                some = rows.slice(at, QUERIES)
                qid, q = some.column("vec_id").to_numpy(), _matrix(some.column("embedding"))
                best = [(np.zeros(0), np.zeros(0, np.int64))] * len(qid)
                nearest(blocks, best, shared.value, qid, q)
                n = [len(s) for s, _ in best]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, n)), pa.array(np.concatenate([v for _, v in best])), pa.array(np.concatenate([s for s, _ in best]))], ["query_id", "vec_id", "score"])

        def indexed(rows: pa.Table) -> None:
            for at in range(0, rows.num_rows, BLOCK):
                some = rows.slice(at, BLOCK)
                vid, x = some["vec_id"].to_numpy(), _matrix(some["embedding"].combine_chunks())
                norm = some["norm"].to_numpy().astype(np.float32)
                codes = np.frombuffer(b"".join(some["codes"].to_pylist()), np.uint8).reshape(len(vid), -1)
                keep = _reduced(vid, x, k)
                blocks.append((vid[keep], x[keep], norm[keep], codes[keep]))

        for batch in batches:
            parts, query = batch.column("part").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | (query[1:] != query[:-1])]) if len(parts) else []
            for a, b in zip(edge, np.r_[edge[1:], len(parts)], strict=True) if len(parts) else ():
                some = batch.slice(a, b - a)
                if parts[a] != part:
                    part, held, blocks = parts[a], [], []
                if not query[a]:
                    held.append(some)
                    continue
                if held:
                    indexed(pa.Table.from_batches(held))
                    held = []
                if blocks:
                    yield from answer(some)

    return run


def search(index: DataFrame, books: np.ndarray | None, queries: DataFrame, k: int = 20, rerank: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score). queries: rows of the index (vec_id, embedding).

    rerank: exact scores taken in each block of 4,096, a sixteenth of it, and of all rows
    level with the last of these. Of equal vectors only those count that can be among the
    k best, the smallest ids. Queries are repeated once for each part of the index, which is
    what scoring every coded vector for every query asks for; a part's task streams them.
    """
    spark = index.sparkSession
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(books)
    n, tasks = index.count(), 2 * spark.sparkContext.defaultParallelism
    full = max(BLOCK, PART // (8 * books.shape[2]) // BLOCK * BLOCK)
    # a copy of the queries goes to each part: whole parts at scale, down to two blocks while tasks would stand idle
    parts = max(1, -(-n // full), min(tasks, -(-n // (2 * BLOCK))))
    # by row, so that rows of one id or one vector are spread like any others
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    rows = index.select(part.alias("part"), F.lit(False).alias("query"), "vec_id", "embedding", "norm", "codes")
    asked = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    each = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("query"), "vec_id", "embedding", F.lit(None).cast("double").alias("norm"), F.lit(None).cast("binary").alias("codes"))
    dealt = rows.union(each).repartition(parts, "part").sortWithinPartitions("part", "query")
    found = dealt.mapInArrow(_searcher(shared, k, rerank), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
