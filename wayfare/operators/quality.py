"""The quality pass of the ingest: duplicates, two kinds of conflict, weak matches and old documents, as flags of a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import text
from wayfare.scratch import write_table

#: Tiers whose proposed junction counts, and those that make a match weak.
MATCHED, WEAK = ("strong", "moderate"), ("weak", "none")


def name_key(name: Column, station: Column) -> Column:
    """Normalised name and police station; nulls count as empty."""
    part = lambda c: F.coalesce(text.written_out(c), F.lit(""))
    return F.concat_ws("|", part(name), part(station))


def _classes(blocks: DataFrame) -> DataFrame:
    """(name_key, sig, n, c: key, tier and target of the first block) of blocks with timings, one row for all that agree."""
    rows = blocks.select(F.coalesce("name_key", F.lit("")).alias("name_key"), "sig", F.struct("key", "tier", "target").alias("c")).filter("sig <> ''")
    return write_table(rows.groupBy("name_key", "sig").agg(F.count("*").alias("n"), F.min("c").alias("c")), "classes")


def _disputed(classes: DataFrame) -> DataFrame:
    """(name_key, sig, target, apart, shared): classes whose proposed junction is also proposed under another name, with other timings.

    apart: classes of the junction with other timings; shared: those of them that bear the same name. A repeated block
    proposes nothing, so a class stands for its first block alone.
    """
    live = classes.filter(F.col("c.target").isNotNull() & F.col("c.tier").isin(*MATCHED)).select("name_key", "sig", F.col("c.target").alias("target"))
    by_name = live.groupBy("target", "name_key").agg(F.count("*").alias("named"))
    by_sig = live.groupBy("target", "sig").agg(F.count("*").alias("alike"))
    names = by_name.groupBy("target").agg(F.count("*").alias("names"), F.sum("named").alias("all"))
    sigs = by_sig.groupBy("target").agg(F.count("*").alias("sigs"))
    open_ = names.join(sigs, "target").filter("names >= 2 AND sigs >= 2").select("target", "all")
    return live.join(open_, "target").join(by_name, ["target", "name_key"]).join(by_sig, ["target", "sig"]).select("name_key", "sig", "target", (F.col("all") - F.col("alike")).alias("apart"), (F.col("named") - 1).alias("shared"))


def block_flags(blocks: DataFrame) -> DataFrame:
    """blocks with duplicate_of, conflicts and quality_flags (sorted), which replace columns of these names.

    blocks: key (unique), name_key, sig (null or empty: no timings), tier, target (null: none proposed), currency. A block is a
    duplicate of the least key with its name and timings; conflicting_timings when its name has other timings too;
    conflicting_target when the junction it proposes by a strong or moderate match is proposed under another name and with other
    timings, duplicates left out; weak_match; stale_document or undated_document by its currency. conflicts is how many
    other blocks it disagrees with, each counted once; `conflict_members` says which. Agreeing blocks are
    counted before anything is joined, and no list of a group's blocks is made: the blocks themselves are joined once.
    """
    blocks = blocks.drop("duplicate_of", "conflicts", "quality_flags")
    classes = _classes(blocks)
    of_name = classes.groupBy("name_key").agg(F.sum("n").alias("_all"))
    facts = classes.join(of_name, "name_key").join(_disputed(classes), ["name_key", "sig"], "left")
    facts = facts.select(F.col("name_key").alias("_name"), F.col("sig").alias("_sig"), F.col("c.key").alias("_first"), (F.col("_all") - F.col("n")).alias("_others"), "apart", "shared")
    row = F.col("_row")
    got = blocks.select(F.struct(*blocks.columns).alias("_row")).join(facts, (F.coalesce(row["name_key"], F.lit("")) == F.col("_name")) & (row["sig"] == F.col("_sig")), "left")
    first = row["key"] == F.col("_first")
    disputed = first & F.col("apart").isNotNull()
    others = F.coalesce("_others", F.lit(0))
    marks = {
        "conflicting_target": disputed, "conflicting_timings": others > 0, "duplicate": ~first, "stale_document": row["currency"] == "stale",
        "undated_document": row["currency"] == "undated", "weak_match": row["tier"].isin(*WEAK),
    }
    return got.select(
        "_row.*", F.when(~first, F.col("_first")).alias("duplicate_of"), (others + F.when(disputed, F.col("apart") - F.col("shared")).otherwise(0)).alias("conflicts"),
        F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in marks.items()])).alias("quality_flags"),
    )


def conflict_members(blocks: DataFrame) -> DataFrame:
    """(kind, place, sig, key): the blocks of every name and junction that disagree; two of one kind and place conflict when sig differs.

    kind is 'name' or 'target', place the name_key or the junction as text. Lists of a block's opponents would grow with
    the square of a group; these rows say the same once.
    """
    classes = _classes(blocks)
    many = classes.groupBy("name_key").agg(F.count("*").alias("m")).filter("m >= 2").select("name_key")
    rows = blocks.select(F.coalesce("name_key", F.lit("")).alias("name_key"), "sig", "key").filter("sig <> ''")
    named = rows.join(many, "name_key").select(F.lit("name").alias("kind"), F.col("name_key").alias("place"), "sig", "key")
    placed = _disputed(classes).join(classes, ["name_key", "sig"]).select(F.lit("target").alias("kind"), F.col("target").cast("string").alias("place"), "sig", F.col("c.key").alias("key"))
    return named.unionByName(placed)
