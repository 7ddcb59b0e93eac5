"""Mixing sources to target weights (native): Poisson replication.

Each source gets the repetition rate that brings its bytes to its target share. A
document's copies are a Poisson draw with that mean, found by inverting the
distribution at a uniform number that hangs on its id and the seed alone; the copies
are exploded and put in a global random order.

Rates above BLOCK are drawn as sums of equal draws of at most BLOCK, which is the
same law and never underflows.

Defined cases. A null source is a source of its own. A source without a target
weight gets none and is left out; a weighted source that is absent gives its share
to the rest. Weights must be above zero or are ignored. Null texts count no bytes;
a weighted source with no bytes at all keeps rate 1 and takes no share of the others. Rows with equal ids in one source draw
the same number. Texts of any length pass whole. Other columns pass through, whatever
their names: where docs has a column `_replica`, `_order` or `_copies`, the new one gets
underscores more. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import free_name
from wayfare.scratch import write_table

#: Largest mean drawn at once, and the counts that its inversion looks at: the
#: chance of more is below 1e-13 at this mean, less than one step of the uniform.
BLOCK, COUNTS = 8, 48


def uniform(*parts: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def smoothed_weights(docs: DataFrame, power: float, source: str = "source", text: str = "text") -> DataFrame:
    """(source, weight): each source's bytes to a power, as temperature sampling has it.

    A source without bytes has weight 1, by which it is kept; it takes no share.
    """
    sizes = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("bytes"))
    weight = F.when(F.col("bytes") > 0, F.pow(F.col("bytes").cast("double"), F.lit(power))).otherwise(F.lit(1.0))
    return sizes.select("source", weight.alias("weight"))


def rates(docs: DataFrame, weights: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, rate): mean copies of a document, so that bytes in total stay the same."""
    sizes = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0)).alias("bytes"))
    wanted = weights.filter(F.col("weight") > 0).groupBy("source").agg(F.sum("weight").alias("weight"))
    both = sizes.join(wanted, sizes["source"].eqNullSafe(wanted["source"])).drop(wanted["source"])
    total = both.filter("bytes > 0").agg(F.sum("bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    rate = F.col("weight") / F.col("all_weight") * F.col("all_bytes") / F.col("bytes")
    # one row beside the few rows of `both`
    return both.crossJoin(F.broadcast(total)).select("source", F.when(F.col("bytes") > 0, rate).otherwise(F.lit(1.0)).alias("rate"))


def _distribution(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. COUNTS - 1, by the usual recurrence."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(COUNTS - 1)), start, step, lambda acc: acc["cdf"])


def copies(docs: DataFrame, weights: DataFrame, seed: int, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a last column `_copies`, the number drawn for each row."""
    # written, so that the planner knows how few rows these are before it deals out docs
    table = write_table(rates(docs, weights, source, text), "mix-rates")
    of, cdf, blocks, name = (free_name(docs, x) for x in ("_s", "_cdf", "_blocks", "_copies"))
    n = F.greatest(F.lit(1), F.ceil(F.col("rate") / BLOCK)).cast("int")
    table = table.select(F.col("source").alias(of), n.alias(blocks), _distribution(F.col("rate") / n).alias(cdf))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col(blocks)),
        F.lit(0),
        lambda acc, b: acc + F.size(F.filter(cdf, lambda c: c <= uniform(F.lit(seed), F.col(f"`{doc_id}`"), b))),
    )
    joined = docs.join(table, F.col(f"`{source}`").eqNullSafe(F.col(of)))
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], drawn.alias(name))


def mix(docs: DataFrame, weights: DataFrame, seed: int = 0, shuffle: bool = True, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Replicated docs with `_replica` (from 0) and `_order`, in random global order.

    `_order` is a 52-bit hash of id, replica and seed. The rows are dealt to
    partitions by range of it and sorted within them, so that reading part after
    part reads the whole mix in random order.
    """
    drawn = copies(docs, weights, seed, source, doc_id, text)
    n, replica, order = drawn.columns[-1], free_name(docs, "_replica"), free_name(docs, "_order")
    out = drawn.filter(F.col(n) > 0).withColumn(replica, F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(n)
    key = F.concat_ws(":", F.lit("order"), F.lit(seed), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")), F.col(replica))
    out = out.withColumn(order, F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long"))
    if shuffle:
        out = out.orderBy(order, F.col(f"`{doc_id}`"))
    return out
