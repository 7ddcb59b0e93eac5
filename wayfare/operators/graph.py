"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.scratch import write_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(out.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge.

    Large-star and small-star rounds: each is two shuffles of the edge table, the
    edges never grow in number, and rounds follow the logarithm of the size of the
    largest component. Each round is written, so a lost executor costs that round
    at most. Null ends and loops carry no link.
    """

    few = 2 * edges.sparkSession.sparkContext.defaultParallelism  # two narrow tasks a core are enough

    def tidy(df: DataFrame) -> DataFrame:
        return write_table(df.filter(F.col("u") != F.col("v")).distinct().coalesce(few), "components")

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).filter(F.col("node").isNotNull()).distinct()
    now = tidy(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))
    seen = mark(now)
    for _ in range(max_rounds):
        now = tidy(_small_star(_large_star(now)))
        if (new := mark(now)) == seen:
            break
        seen = new
    else:
        raise RuntimeError("components did not settle")
    root = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
