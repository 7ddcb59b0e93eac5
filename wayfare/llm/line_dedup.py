"""Line dedup (native): drop lines that many documents share.

Lines are exploded, normalised and hashed; documents are counted per hash; hashes
in enough documents are dropped everywhere but in the largest doc_id that holds
them; what stays is put together again by position.

Defined cases. Null text: one empty line. Texts of any length are cut whole. Rows that
share a doc_id count as one document and each is cut on its own; rows without doc_id
count together as one document that ranks below all others. Repeated rows give repeated
results. Other columns, whatever their names, pass through; where docs has a column
`_lines`, the new one gets underscores more. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import BLANKS, ascii_lower, digest, free_name
from wayfare.scratch import write_table

#: Least documents of a hot key, and most keys that count as hot.
HOT_DOCS, HOT_KEYS = 10_000, 50_000


def _keys(text: Column, min_chars: int) -> Column:
    """A 16-byte key for each line, null for lines that are too short to count."""

    def key(line: Column) -> Column:
        bare = F.trim(line, F.lit(BLANKS))
        return F.when(F.char_length(bare) >= min_chars, digest(bare))

    return F.transform(F.split(ascii_lower(text), "\n", -1), key)


def dedup_lines(
    docs: DataFrame, min_docs: int = 3, min_chars: int = 20, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """docs with `text` cut, plus n_lines and n_dropped (structs named _lines).

    The text is shuffled once, to meet its own few dropped keys; all that is counted is
    (key, doc_id). Keys of more documents than a HOT_KEYS-th of all counted pairs are at
    most HOT_KEYS by arithmetic: these are broadcast, and their pairs are spread by
    document, so no key's pairs meet in one task.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # rows without an id are told apart by their text
    row = F.when(F.col(f"`{doc_id}`").isNull(), digest(body))
    pairs = docs.select(
        F.col(f"`{doc_id}`").alias("d"), row.alias("r"), F.explode(F.array_distinct(F.array_compact(_keys(body, min_chars)))).alias("k")
    )
    common = (
        pairs.groupBy("k")
        .agg(
            (F.count_distinct("d") + F.max(F.when(F.col("d").isNull(), 1).otherwise(0))).alias("n"),
            F.max("d").alias("keeper"),
        )
        .filter(F.col("n") >= min_docs)
    )
    common = write_table(common, "common-lines")
    counted = common.agg(F.sum("n")).first()[0] or 0
    least = max(HOT_DOCS, counted // HOT_KEYS)
    hot = common.filter(F.col("n") > least).select("k", F.struct("keeper").alias("hot"))
    rest = common.filter(F.col("n") <= least).select(F.col("k").alias("j"), F.struct("keeper").alias("rest"))
    met = pairs.join(F.broadcast(hot), "k", "left")
    # a hot pair's key here is its document's: it meets no key of `rest` and is spread
    spread = F.unhex(F.sha1(F.concat_ws(":", F.coalesce(F.col("d").cast("string"), F.hex("r")), F.hex("k"))))
    met = met.withColumn("j", F.when(F.col("hot").isNull(), F.col("k")).otherwise(spread)).join(rest, "j", "left")
    of = F.coalesce("hot", "rest")
    drops = (
        met.filter(of.isNotNull() & ~F.col("d").eqNullSafe(of["keeper"]))
        .groupBy("d", "r")
        .agg(F.collect_set("k").alias("keys"))
    )
    drop, gone, at, cut_, name = (free_name(docs, x) for x in ("_drop", "_d", "_r", "_cut", "_lines"))
    drops = drops.select(F.col("d").alias(gone), F.col("r").alias(at), F.col("keys").alias(drop))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(gone)) & row.eqNullSafe(F.col(at))
    hit = docs.join(drops, same, "left")
    lines = F.split(body, "\n", -1)
    marked = F.arrays_zip(lines.alias("line"), _keys(body, min_chars).alias("key"))
    kept = F.transform(
        F.filter(marked, lambda x: ~F.coalesce(F.array_contains(F.col(drop), x["key"]), F.lit(False))),
        lambda x: x["line"],
    )
    n = F.size(lines).cast("long")
    whole = F.struct(body.alias("text"), n.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    less = F.struct(F.concat_ws("\n", kept).alias("text"), n.alias("n_lines"), (n - F.size(kept)).alias("n_dropped"))
    out = hit.withColumn(cut_, F.when(F.col(drop).isNotNull(), less).otherwise(whole))
    return out.select(
        *[F.col(f"`{cut_}`.text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.struct(f"`{cut_}`.n_lines", f"`{cut_}`.n_dropped").alias(name),
    )
