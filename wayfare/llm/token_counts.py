"""Token counts by a separator scan over flat, unindexed token files.

A token file is one stream of ids, documents divided by an end-of-document id alone,
kept as numbered blocks of fixed size that take no heed of documents. The scan finds
the end-of-document ids of each block by one vectorised comparison. A prefix scan over
block summaries (ids, separators, where the last separator lies) then tells each block
how many documents and ids precede it and how much of an unfinished document it takes
over, so that counts are stitched across blocks of any number.

Defined cases. An empty block adds nothing. A document may span many blocks or be
empty. Ids after the last separator of a file belong to an unfinished document, which
has a count and ended = false. Null text is written as an empty document. Texts of any
length are written whole; repeated rows are written and counted each. doc_id must be whole
numbers (it is cast to long). Other columns, whatever their names, play no part. An empty
table gives no file and no count.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.scratch import write_table

#: Ids in a block (two bytes each).
BLOCK = 1 << 18
#: Fixed value: the first id that the 50,256-entry byte vocabularies leave free.
END = 50256


def vocabulary(name: str = "byte_bpe_50k.tiktoken"):
    """Path of an installed public vocabulary, and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _writer(vocabulary, pattern: str, end: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        part, number, ordinal = TaskContext.get().partitionId(), 0, 0
        held, size = [], 0
        names = ["kind", "file", "number", "doc_id", "ids"]

        def blocks(flat: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            cut = [flat[i : i + block].tobytes() for i in range(0, len(flat), block)]
            number += len(cut)
            n = len(cut)
            return pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.array(range(number - n, number), pa.int64()), pa.nulls(n, pa.int64()), pa.array(cut, pa.binary())], names)

        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.array(range(ordinal, ordinal + n), pa.int64()), ids, pa.nulls(n, pa.binary())], names)
            ordinal += n
            for text in batch.column("text"):
                held.append(np.array([*coder.encode_ordinary(text.as_py() or ""), end], np.uint16))
                size += len(held[-1])
                if size >= 4 * block:
                    flat = np.concatenate(held)
                    whole = len(flat) // block * block
                    yield blocks(flat[:whole])
                    held, size = [flat[whole:]], len(flat) - whole
        if size:
            yield blocks(np.concatenate(held))

    return run


def write_token_files(docs: DataFrame, path: str, pattern: str, end: int = END, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(blocks: file, number, ids) and (order: file, number, doc_id): one file per input partition.

    The order of documents is what a trainer's manifest keeps; the blocks hold no index.
    path: the vocabulary, which the driver reads; the tasks get its bytes, under a megabyte.
    """
    with open(path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = rows.mapInArrow(_writer(ranks, pattern, end, block), "kind int, file long, number long, doc_id long, ids binary")
    made = write_table(made, "token-files", partition_by=["kind"])
    return made.filter("kind = 1").select("file", "number", "ids"), made.filter("kind = 0").select("file", "number", "doc_id")


def _ranges(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, number, path in zip(*(batch.column(c).to_pylist() for c in ("file", "number", "path")), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as source:
                    ids = source.read_at(block_bytes, number * block_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([ids], pa.binary())], ["file", "number", "ids"])

    return run


def read_token_files(spark: SparkSession, path: str, block_bytes: int = 2 * BLOCK) -> DataFrame:
    """(file, number, ids): blocks of flat binary files of any size; file is a hash of the path.

    Spark only lists the files; each task then reads the byte ranges dealt to it, so no file is
    ever held whole. The store must be one that Arrow's file systems open too.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    last = F.greatest(F.lit(0), F.floor((F.col("length") - 1) / block_bytes)).cast("long")
    uri = F.regexp_replace("path", "^file:/(?!/)", "file:///")
    each = listed.select(F.xxhash64("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("number"), uri.alias("path"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    return each.repartition(tasks, "file", "number").mapInArrow(_ranges(block_bytes), "file long, number long, ids binary")


def _scan(end: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, size = [], []
            for ids in batch.column("ids"):
                flat = np.frombuffer(ids.as_py() or b"", dtype)
                size.append(len(flat))
                ends.append(np.flatnonzero(flat == end))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("number"), pa.array(size, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["file", "number", "size", "ends"])

    return run


def count_tokens(blocks: DataFrame, end: int = END, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, n_tokens, ended): the documents of each file in order."""
    found = write_table(blocks.mapInArrow(_scan(end, dtype), "file long, number long, size long, ends array<long>"), "separators")
    # one narrow row per block is all the prefix scan sorts
    before = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("file", "number", "size", F.size("ends").cast("long").alias("n"), F.array_max("ends").alias("last"))
    base = summary.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    base = base.withColumn("ordinal", F.coalesce(F.sum("n").over(before), F.lit(0)))
    base = base.withColumn("open", F.coalesce(F.max(F.col("start") + F.col("last")).over(before), F.lit(-1)))
    stitched = found.select("file", "number", "ends").join(base.select("file", "number", "start", "ordinal", "open"), ["file", "number"])
    at = F.posexplode("ends").alias("i", "end")
    each = stitched.select("file", "start", "ordinal", "open", "ends", at)
    previous = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("start") + F.get("ends", F.col("i") - 1))
    done = each.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), (F.col("start") + F.col("end") - previous - 1).alias("n_tokens"), F.lit(True).alias("ended"))
    tail = base.groupBy("file").agg(F.sum("size").alias("total"), F.sum("n").alias("ordinal"), F.coalesce(F.max(F.col("start") + F.col("last")), F.lit(-1)).alias("open"))
    tail = tail.filter(F.col("total") - 1 > F.col("open"))
    return done.union(tail.select("file", "ordinal", F.col("total") - 1 - F.col("open"), F.lit(False)))
