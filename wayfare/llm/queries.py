"""The thin queries over the given tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import ann, decontam, jaccard_join, licenses, line_dedup, mixing, packing, pu_quality, secrets, sharding, token_counts, turn_repair, vector_codes
from wayfare.scratch import write_table
from wayfare.session import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated"
    )


def learnable(labels: DataFrame) -> DataFrame:
    """Label rows outside the held-out fifth."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = pu_quality.fit(docs, learnable(table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return pu_quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings, each judged by a forest that learns from planted ones."""
    docs = table(spark, sf_dir, "documents")
    known = write_table(secrets.dictionary(docs), "dictionary")
    scored = secrets.scored(secrets.findings(docs, known=known), secrets.fit(secrets.planted(docs, known=known).filter("label IS NOT NULL")))
    return scored.select("doc_id", "start", "end", "rule", F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= 0.5).alias("is_secret"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources at the 0.7th power of their bytes; replicas in global random order."""
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.smoothed_weights(docs, 0.7), seed=20)
    return mixed.select("doc_id", "source", F.octet_length("text").alias("n_bytes"), F.md5("text").alias("text_md5"), F.col("_replica").cast("long").alias("replica"), F.col("_order").alias("mix_order"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, books = ann.build_index(table(spark, sf_dir, "embeddings"))
    return ann.search(index, books, index.filter(F.col("vec_id") % 20 == 0), k=20)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.recognise(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("_ids").cast("long").alias("n_sentences"), F.array_join("_ids", ",").alias("sentence_ids"), F.array_join("_licenses", ",").alias("licenses")
    )


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.join_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as flat token files, then counted from the files."""
    blocks, order = token_counts.write_token_files(table(spark, sf_dir, "documents"), *token_counts.vocabulary())
    counted = token_counts.count_tokens(blocks).withColumnRenamed("ordinal", "number")
    return order.join(counted, ["file", "number"]).select("doc_id", "n_tokens")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults by crc32 of conv_id:turn, modulo 20: dropped, emptied, unended, repeated or given to the user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(kind == 4, "user").otherwise(said("role"))
    times = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    return turns.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, _ = turn_repair.repair(damaged(turns))
    every = turns.select(F.col("conv_id").alias("_id")).distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    audit, said = F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return every.join(report, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(F.col("_id").alias("conv_id"), *zero, audit, said)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = token_counts.vocabulary("byte_bpe_50k.json")
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), path, pattern))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_secrets": op3_secrets,
    "op4_mix_sources": op4_mix_sources,
    "op5_line_dedup": op5_line_dedup,
    "op6_nearest": op6_nearest,
    "op7_licenses": op7_licenses,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_shard": op9_shard,
    "op10_token_counts": op10_token_counts,
    "op11_turn_repair": op11_turn_repair,
    "op12_vector_codes": op12_vector_codes,
    "op13_pack": op13_pack,
}

_OP1 = r"""
WITH dw AS (SELECT rowid AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS width, array_to_string(w[s + 1 : s + 13], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM bw WHERE len(w) > 0)),
occ AS (SELECT r, s, width, array_to_string(w[s + 1 : s + width], ' ') AS k
       FROM (SELECT r, w, width, unnest(range(0, len(w) - width + 1)) AS s FROM dw, (SELECT DISTINCT width FROM win) WHERE len(w) >= width)),
hit AS (SELECT occ.r, occ.s, occ.width, win.item_id FROM occ JOIN win USING (k, width)),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + width)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hit) GROUP BY r)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(cover.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AND 20 * coalesce(cover.n, 0) >= coalesce(len(w), 0) AS contaminated
FROM dw LEFT JOIN cover USING (r) LEFT JOIN its USING (r)"""

_OP4 = """
WITH src AS (SELECT source, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes FROM documents GROUP BY source),
w AS (SELECT source, bytes, CASE WHEN bytes > 0 THEN pow(bytes::DOUBLE, 0.7::DOUBLE) ELSE 0 END AS weight FROM src),
rate AS (SELECT source, CASE WHEN bytes > 0 THEN weight / (SELECT sum(weight) FROM w) * (SELECT sum(bytes) FROM w) / bytes ELSE 1 END AS rate FROM w),
blocks AS (SELECT source, greatest(1, ceil(rate / 8))::INT AS m, rate / greatest(1, ceil(rate / 8)) AS lam FROM rate),
cdf AS (SELECT source, m, list_sum(list_transform(range(0, k + 1), lambda i: exp(-lam + i * ln(lam) - lgamma(i + 1)))) AS c
        FROM (SELECT source, m, lam, unnest(range(0, 48)) AS k FROM blocks)),
u AS (SELECT r, doc_id, d.source, text, ('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, 'null') || ':' || b), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM (SELECT row_number() OVER () AS r, * FROM documents) d JOIN blocks ON d.source IS NOT DISTINCT FROM blocks.source, unnest(range(1, m + 1)) AS t(b)),
n AS (SELECT r, any_value(doc_id) AS doc_id, any_value(u.source) AS source, any_value(text) AS text, count(*) FILTER (c <= u) AS n
      FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source GROUP BY r)
SELECT doc_id, source, strlen(text)::INT AS n_bytes, md5(text) AS text_md5, k::BIGINT AS replica,
       ('0x' || substr(md5('order:20:' || coalesce(doc_id::VARCHAR, 'null') || ':' || k), 1, 13))::BIGINT AS mix_order
FROM n, unnest(range(0, n.n)) AS t(k)"""

_OP5 = r"""
WITH ln AS (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS p
            FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)),
kk AS (SELECT r, doc_id, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM ln),
common AS (SELECT k, max(doc_id) AS keeper FROM kk WHERE length(k) >= 20 GROUP BY k
           HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT kk.r, kk.doc_id, p, line, common.k IS NOT NULL AND kk.doc_id IS DISTINCT FROM keeper AS gone FROM kk LEFT JOIN common ON kk.k = common.k)
GROUP BY r"""



def _op7_sql() -> str:
    """Sentences and rules as tables; a rule is met when its identifiers follow one another."""
    q = lambda v: "'" + v.replace("'", "''") + "'"
    low = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    normal = "trim(regexp_replace(" + low + r", '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'), ' ')"
    known = ", ".join(f"({q(s)}, {q(n)})" for n, s in licenses.SENTENCES.items())
    rules = "[" + ", ".join(f"{{'l': {q(n)}, 'p': {q('.*,'.join(',' + x for x in o).replace(',.*', '.*') + ',')}}}" for n, o in licenses.RULES) + "]"
    word = r"a-z0-9\x{80}-\x{10FFFF}"
    cut = low.format(c="translate(coalesce(text, ''), '|', '_')")
    for pattern, mark in [
        (r"([.!?;:])[ \t\x0B\f\r]+", r"\1|"), (rf"(?m)^[^{word}\n]*(?:dnl|rem|c)([ \t\r\n]|$)", r"\1"), (rf"[^{word}|\n]+", " "),
        (r" ?\|[ |]*", "|"), (r"[ |]?\n[ |]?", "\n"), (r"\n{2,}", "#"),
    ]:
        cut = f"regexp_replace({cut}, {q(pattern)}, {q(mark)}, 'g')"
    longest = max(len(x.split()) for x in licenses.SENTENCES.values()) + 8
    return rf"""
WITH k AS (SELECT {normal.format(c="s")} AS key, min(id) AS id FROM (VALUES {known}) v(s, id) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
g AS (SELECT r, unnest(g) AS g, unnest(range(0, len(g))) AS j FROM (SELECT r, string_split(trim(replace({cut}, chr(10), '|'), ' '), '#') AS g FROM d)),
p AS (SELECT r, j, string_split(g, '|') AS p FROM g),
s AS (SELECT r, j, p, i FROM (SELECT r, j, p, unnest(range(1, len(p) + 1)) AS i FROM p) WHERE split_part(p[i], ' ', 1) IN (SELECT split_part(key, ' ', 1) FROM k)),
c AS (SELECT r, j, i, n, array_to_string(p[i : i + n - 1], ' ') AS key FROM (SELECT r, j, p, i, unnest(range(1, least({longest}, len(p) - i + 1) + 1)) AS n FROM s)),
m AS (SELECT r, string_agg(id, ',' ORDER BY j, i, n) AS ids, count(*) AS n FROM c JOIN k USING (key) GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids,
       array_to_string(list_transform(list_filter(list_transform({rules}, lambda z, i: {{'i': i, 'l': z.l, 'ok': regexp_matches(',' || coalesce(replace(ids, ',', ',,'), '') || ',', z.p)}}), lambda z: z.ok AND z.i = list_position(list_transform({rules}, lambda y: y.l || regexp_matches(',' || coalesce(replace(ids, ',', ',,'), '') || ',', y.p)), z.l || TRUE)), lambda z: z.l), ',') AS licenses
FROM d LEFT JOIN m USING (r)"""


ORACLES = {"op7_licenses": _op7_sql(), "op1_decontaminate": _OP1, "op4_mix_sources": _OP4, "op5_line_dedup": _OP5}
