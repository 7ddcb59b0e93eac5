"""Benchmark decontamination (native): prefix-filtered set join on item windows.

A window is WINDOW consecutive words of an item. For exact containment one prefix
token is necessary and enough: the window's rarest shingle, where rarity is the
shingle's count in the whole corpus. Documents' shingles are joined with those
prefix tokens; the token's offset in its window gives the only possible start
(positional bound), the window's length bounds it at both ends (length bound), and
the words at that place are compared with the window's (exact verification).

Tokens are hashed on fully lower-cased words, which can only add candidates: the
comparison itself lower-cases A-Z alone.

Defined cases. Null text has no words, and such a document or item matches nothing.
Items without item_id are left out; rows with equal item_id are one item. Rows with
equal doc_id are judged by their own text each; ids may be of any type. Texts of any
length are judged whole. Repeated rows repeat their result.
Columns of either table other than those named play no part. Empty tables give an
empty result or one without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.llm.common import ascii_lower, digest
from wayfare.scratch import write_table

#: Fixed by the contract: what does not stand in a word.
NON_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 13, 2
#: Broadcast the windows only up to this many (about 250 bytes each).
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    """Words in their own case; an array that may be empty, never null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NON_WORD, -1), "")


def lowered(ws: Column) -> Column:
    return F.transform(ws, ascii_lower)


def _token(ws: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.lower(F.get(ws, at + i)) for i in range(size)])


def windows(items: DataFrame, window: int, shingle: int, item_id: str, text: str) -> DataFrame:
    """(item_id, w, width, tokens): tokens are (offset, size, t) of each shingle in w."""
    ws = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), lowered(words(F.col(text))).alias("ws"))
    ws = ws.filter(F.size("ws") > 0)
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0))))
    cut = ws.select("item_id", start.alias("s"), "ws").select("item_id", F.slice("ws", F.col("s") + 1, window).alias("w")).distinct()
    cut = cut.withColumn("width", F.size("w"))
    short = [F.when(F.col("width") == k, F.array(F.struct(F.lit(0).alias("offset"), F.lit(k).alias("size"), _token(F.col("w"), F.lit(0), k).alias("t")))) for k in range(1, shingle)]
    full = F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("width") - shingle, F.lit(0))),
        lambda i: F.struct(i.alias("offset"), F.lit(shingle).alias("size"), _token(F.col("w"), i, shingle).alias("t")),
    )
    return cut.withColumn("tokens", F.coalesce(*short, full))


def _positions(docs: DataFrame, size: int, *keep: str) -> DataFrame:
    """One row per shingle of `size` words: (keep..., pos, t)."""
    at = docs.select(*keep, "ws", F.posexplode("ws").alias("pos", "_w"))
    return at.filter(F.col("pos") + size <= F.size("ws")).withColumn("t", _token(F.col("ws"), F.col("pos"), size)).drop("_w")


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, item_id: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """(d, h, item_id, start, width): every occurrence of an item's window.

    d, h: the document's id and text digest. The corpus is read twice, for the
    tokens' counts and for the join; nothing of it is shuffled but the matches.
    """
    cut = write_table(windows(items, window, shingle, item_id, item_text), "bench-windows")
    few = cut.count() <= BROADCAST_WINDOWS
    hint = F.broadcast if few else (lambda df: df)
    each = cut.select("item_id", "w", "width", F.inline("tokens"))
    sizes = [r["size"] for r in each.select("size").distinct().collect()]  # 1 .. shingle
    if not sizes:
        none = F.lit(None).cast(items.schema[item_id].dataType).alias("item_id")
        return docs.select("d", "h", none, F.lit(0).alias("start"), F.lit(0).alias("width")).filter(F.lit(False))
    tokenised = docs.select("d", "h", words(F.col(text)).alias("ws"))
    counts = None
    for size in sizes:
        wanted = each.filter(F.col("size") == size).select("t").distinct()
        here = _positions(tokenised, size).select("t").join(hint(wanted), "t").groupBy("t").agg(F.count("*").alias("n")).withColumn("size", F.lit(size))
        counts = here if counts is None else counts.unionByName(here)
    rarest = Window.partitionBy("item_id", "w").orderBy(F.coalesce("n", F.lit(0)), "t", "offset")
    prefix = each.join(counts, ["t", "size"], "left").withColumn("r", F.row_number().over(rarest)).filter(F.col("r") == 1)
    # a window none of whose rarest shingle occurs at all occurs nowhere
    prefix = write_table(prefix.filter(F.col("n").isNotNull()).select("t", "size", "offset", "width", "w", F.array_join("w", " ").alias("line"), "item_id"), "bench-prefix")
    found = None
    for size in sizes:
        own = prefix.filter(F.col("size") == size).drop("size").withColumnRenamed("width", "wide")
        start = F.col("pos") - F.col("offset")
        inside = (start >= 0) & (start + F.col("wide") <= F.col("n_words"))
        if few:
            rows = _positions(tokenised, size, "d", "h").withColumn("n_words", F.size("ws")).join(F.broadcast(own), "t").filter(inside)
            # no lambda here: one would take the join out of generated code, and every
            # position's row would then carry a copy of its document's words
            hits = rows.filter(ascii_lower(F.array_join(F.slice("ws", start + 1, F.col("wide")), " ")) == F.col("line"))
            hits = hits.select("d", "h", "item_id", start.alias("start"), F.col("wide").alias("width"))
        else:  # candidates travel without text and meet it again, one row per document
            rows = _positions(tokenised.withColumn("n_words", F.size("ws")), size, "d", "h", "n_words").drop("ws").join(own, "t").filter(inside)
            cands = rows.groupBy("d", "h").agg(F.collect_set(F.struct("item_id", start.alias("start"), F.col("wide").alias("width"), "w")).alias("c"))
            text_of = tokenised.dropDuplicates(["d", "h"]).withColumnRenamed("d", "d2").withColumnRenamed("h", "h2")
            met = cands.join(text_of, F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")))
            ok = F.filter("c", lambda x: lowered(F.slice(F.col("ws"), x["start"] + 1, x["width"])) == x["w"])
            hits = met.select("d", "h", F.explode(ok).alias("x")).select("d", "h", "x.item_id", "x.start", "x.width")
        found = hits if found is None else found.unionByName(hits)
    return found


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, h, n_words, n_hit, items, contaminated).

    n_hit counts words inside any occurrence; contaminated if n_hit > 0 and
    share * n_hit >= n_words.
    """
    keyed = docs.select(F.col(doc_id).alias("d"), digest(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias(text))
    hits = find_windows(keyed, items, window, SHINGLE, item_id, text, item_text)
    one = hits.groupBy("d", "h").agg(
        F.array_sort(F.collect_set(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("width")).alias("e")))).alias("spans"),
        F.collect_set("item_id").alias("items"),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "spans",
        start,
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["e"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["end"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    one = one.select(F.col("d").alias("d2"), F.col("h").alias("h2"), covered.alias("n_hit"), "items")
    sized = keyed.select("d", "h", F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    both = sized.join(one, sized["d"].eqNullSafe(one["d2"]) & (sized["h"] == one["h2"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return both.select(
        F.col("d").alias("doc_id"),
        "h",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast(one.schema["items"].dataType)).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """docs without the rows that `judge` calls contaminated; all columns stay."""
    doc_id, text = kw.get("doc_id", "doc_id"), kw.get("text", "text")
    bad = judge(docs, items, **kw).filter("contaminated").select(F.col("doc_id").alias("_bad_d"), F.col("h").alias("_bad_h")).distinct()
    same = F.col(doc_id).eqNullSafe(F.col("_bad_d")) & (digest(F.coalesce(F.col(text), F.lit(""))) == F.col("_bad_h"))
    return docs.join(bad, same, "left_anti")
