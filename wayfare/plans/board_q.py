"""Board, search, snapshot, text and document-quality queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions import clock, similarity, text
from wayfare.operators import board, plans, quality, snapshot
from wayfare.session import table

KINDS = ["click", "error", "purchase", "signup"]


def _board(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), "user_id", "value", "ts")


def keyset_page(spark, sf_dir):
    """The second page of a kind: what comes before the cursor, newest first."""
    return board.page(_board(spark, sf_dir), 30, 900, "click").select("seq", "kind", "value", "more")


def board_counts(spark, sf_dir):
    return board.kind_counts(_board(spark, sf_dir), KINDS)


def board_answer(spark, sf_dir):
    """What a reader of the second page of a kind gets, as JSON."""
    got = board.answer(_board(spark, sf_dir).select("seq", "kind", "value"), KINDS, 30, 900, "click")
    return got.select(F.to_json("items").alias("items"), "next", "total", F.to_json("byKind").alias("by_kind"))


def rolling_counts(spark, sf_dir):
    return board.load(_board(spark, sf_dir), "user_id").select("seq", "in_hour", "in_day")


def admission(spark, sf_dir):
    """At most two posts an hour and three a day for each user; refused posts do not count."""
    return board.admission(_board(spark, sf_dir), "seq", "user_id", "ts", 2, 3)


def admission_of_all(spark, sf_dir):
    """At most two posts a minute of all users, two an hour and three a day of each: what passes, and how long the others wait."""
    judged = board.admission_of_all(_board(spark, sf_dir), "seq", "user_id", "ts", board.Limits(2, 3, 2, 10_000))
    return judged.select(F.col("id").alias("seq"), "wait")


def validation(spark, sf_dir):
    """Turns of conversations as submissions: the first reason to refuse each."""
    t = table(spark, sf_dir, "conversations")
    lon, lat = 77.3 + (F.col("conv_id") % 60) / F.lit(100.0), 12.7 + (F.col("turn") % 50) / F.lit(100.0)
    why = board.refusal(F.col("role"), ["user", "assistant"], F.col("text"), F.col("conv_id") % 11 != 0, lon, lat, F.when(F.col("conv_id") % 13 == 0, "x"))
    return t.select("conv_id", "turn", F.coalesce(why, F.lit("ok")).alias("verdict"))


def search_ranked(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    roads = F.array("p_brand", "p_type")
    r = p.withColumn("rank", text.search_rank(F.col("p_name"), roads, F.lit("Gear")).cast("int")).filter("rank IS NOT NULL")
    total = r.agg(F.count("*").alias("total"))  # one row
    best = r.orderBy("rank", "p_name", "p_partkey").limit(8)
    return best.crossJoin(F.broadcast(total)).select("p_partkey", "p_name", "rank", "total")


def snapshot_diff(spark, sf_dir):
    """Two states of orders: some gone, some new, some of another price."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = o.filter("o_orderkey % 10 <> 1")
    new = o.filter("o_orderkey % 10 <> 2").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return snapshot.diff(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


def latest_wins(spark, sf_dir):
    """Each user's last event."""
    return snapshot.last_wins(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


def contact_filter(spark, sf_dir):
    t = table(spark, sf_dir, "documents")
    c = text.has_contact(F.col("text"))
    return t.select("doc_id", c.alias("has_contact"))


def clean_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.concat(F.lit(" The "), F.col("p_name"), F.lit(" × "), F.col("p_type"), F.lit(" Rd.Junction"))
    return p.select("p_partkey", text.normal_name(raw).alias("name"), F.array_join(text.tokens(raw), ",").alias("tokens"), text.clean_tag(F.concat(F.lit("\t"), raw, F.lit("\n")), 20).alias("tag"))


def fuzzy_match(spark, sf_dir):
    """Every part, by name and type, against the types and brands, matched by soft token similarity."""
    p = table(spark, sf_dir, "part")
    left = p.select(F.col("p_partkey").alias("l"), text.tokens(F.concat_ws(" ", "p_type", "p_name")).alias("tokens"))
    right = p.select(F.concat_ws(" ", "p_type", "p_brand").alias("r")).distinct().select("r", text.tokens(F.col("r")).alias("tokens"))
    return similarity.best_matches(left, right).select("l", "r", F.round("score", 9).alias("score"), "rank")


def mentions(spark, sf_dir):
    """Sentences of documents by what they claim."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("sentence"))
    # the patterns run once a sentence, before the shuffle
    s = s.select("doc_id", text.claim_kind(F.col("sentence")).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))
    count = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k)
    return s.groupBy("doc_id").agg(F.sum("n").alias("n"), *map(count, ("qualitative_recommendation", "observation", "mention")))


def _blocks(spark, sf_dir):
    """Orders as documents on customers; their signature is a coarse one of the lines."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("name"), F.concat_ws("|", "o_orderpriority", F.col("o_custkey") % 97).alias("name_key"), (F.col("o_custkey") % 211).alias("target"), F.to_date("o_orderdate").alias("dated"), F.col("o_orderkey").alias("ord"), (F.col("o_orderstatus") == "F").alias("verified"), (F.col("o_orderkey") % 9 == 0).alias("rejected"))
    sig = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.concat(F.count("*"), F.lit("/"), F.sum((F.col("l_linestatus") == "O").cast("int"))).alias("sig"))
    return o.join(sig, "key", "left")


def duplicates(spark, sf_dir):
    return plans.duplicates(_blocks(spark, sf_dir))


def conflicts(spark, sf_dir):
    c = plans.conflicts(_blocks(spark, sf_dir))
    return c.select("target", F.col("blocks").alias("n"), "signatures", "among_verified")


def superseded(spark, sf_dir):
    return plans.superseded(_blocks(spark, sf_dir)).select("key")


def _ingested(spark, sf_dir):
    """Orders as blocks named by priority and customer, three customers to a junction."""
    tiers, k, c = F.array(*map(F.lit, ["strong", "moderate", "weak", "none"])), F.col("o_orderkey"), F.col("o_custkey")
    own = table(spark, sf_dir, "orders").select(k.alias("key"), F.concat_ws("|", "o_orderpriority", c).alias("name_key"), F.get(tiers, (k % 4).cast("int")).alias("tier"), F.when(k % 7 != 0, F.floor(c / 3)).alias("target"))
    dated = _blocks(spark, sf_dir).select("key", "sig", F.when(F.col("key") % 5 != 0, F.date_format("dated", "yyyy-MM-dd")).alias("dated"))
    return own.join(dated, "key").withColumn("currency", clock.ingest_currency(F.col("dated"), F.lit(None).cast("string"), F.lit("1998-06-01").cast("date")))


def block_flags(spark, sf_dir):
    """What the ingest marks in each block, the block it repeats and how many it disagrees with."""
    got = quality.block_flags(_ingested(spark, sf_dir))
    return got.select("key", "duplicate_of", "conflicts", F.array_join("quality_flags", ",").alias("flags"))


def conflict_members(spark, sf_dir):
    """The blocks of every name and junction that disagree, by their timings."""
    return quality.conflict_members(_ingested(spark, sf_dir))


def gaps(spark, sf_dir):
    """Runs of each user's events no more than six hours apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("new", F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > 21600_000_000).cast("int"), F.lit(1)))
    return e.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "run").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


_BLK = """blk AS (SELECT o_orderkey AS key, o_orderpriority AS name, o_orderpriority || '|' || (o_custkey % 97) AS name_key, o_custkey % 211 AS target, o_orderdate::DATE AS dated, o_orderstatus = 'F' AS verified, o_orderkey % 9 = 0 AS rejected, sig
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) || '/' || sum((l_linestatus = 'O')::INT) AS sig FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
dup AS (SELECT key, canonical FROM (SELECT key, min(key) OVER (PARTITION BY name_key, sig) AS canonical FROM blk WHERE sig IS NOT NULL) WHERE key <> canonical)"""
_ING = """b AS (SELECT o_orderkey AS key, o_orderpriority || '|' || o_custkey AS name_key, ['strong', 'moderate', 'weak', 'none'][o_orderkey % 4 + 1] AS tier, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey // 3 END AS target, sig, CASE WHEN o_orderkey % 5 <> 0 THEN date_diff('day', o_orderdate::DATE, DATE '1998-06-01') END AS age
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) || '/' || sum((l_linestatus = 'O')::INT) AS sig FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
dup AS (SELECT key, f FROM (SELECT key, min(key) OVER (PARTITION BY name_key, sig) AS f FROM b WHERE sig IS NOT NULL) WHERE key <> f),
live AS (SELECT * FROM b WHERE sig IS NOT NULL AND target IS NOT NULL AND tier IN ('strong', 'moderate') AND key NOT IN (SELECT key FROM dup)),
tgt AS (SELECT target FROM live GROUP BY target HAVING count(DISTINCT name_key) >= 2 AND count(DISTINCT sig) >= 2)"""
_STOP = ", ".join(f"'{w}'" for w in text.STOP)

QUERIES = {f.__name__: f for f in (keyset_page, board_counts, board_answer, rolling_counts, admission, admission_of_all, validation, search_ranked, snapshot_diff, latest_wins, contact_filter, clean_names, fuzzy_match, mentions, duplicates, conflicts, block_flags, conflict_members, superseded, gaps)}
ORACLES = {
    "keyset_page": "SELECT event_id AS seq, event_type AS kind, value, (SELECT count(*) FROM events WHERE event_type = 'click' AND event_id < 900) > 30 AS more FROM events WHERE event_type = 'click' AND event_id < 900 ORDER BY event_id DESC LIMIT 30",
    "board_counts": "SELECT " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + ", count(*) AS total, max(event_id) AS newest FROM events",
    "board_answer": """WITH p AS (SELECT * FROM events WHERE event_type = 'click' AND event_id < 900 ORDER BY event_id DESC LIMIT 30)
SELECT '[' || string_agg('{"seq":' || event_id || ',"kind":"click","value":' || value || '}', ',' ORDER BY event_id DESC) || ']' AS items, CASE WHEN (SELECT count(*) FROM events WHERE event_type = 'click' AND event_id < 900) > 30 THEN min(event_id) END AS next, (SELECT count(*) FROM events) AS total,
(SELECT '{' || """ + " || ',' || ".join(f"'\"{k}\":' || count(*) FILTER (event_type = '{k}')" for k in KINDS) + """ || '}' FROM events) AS by_kind FROM p""",
    "rolling_counts": """SELECT event_id AS seq, count(*) OVER (PARTITION BY user_id, ts::DATE ORDER BY epoch_ms(ts) RANGE BETWEEN 3599999 PRECEDING AND 1 PRECEDING) AS in_hour,
count(*) OVER (PARTITION BY user_id, ts::DATE ORDER BY epoch_ms(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS in_day FROM events""",
    "admission": """WITH RECURSIVE n AS (SELECT event_id, user_id, ts::DATE AS d, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY epoch_ms(ts), event_id) AS r FROM events),
f AS (SELECT user_id, d, 1::BIGINT AS r, event_id, TRUE AS ok, [t] AS passed FROM n WHERE r = 1
  UNION ALL SELECT n.user_id, n.d, n.r, n.event_id, o, CASE WHEN o THEN list_append(passed, n.t) ELSE passed END
  FROM (SELECT n.*, f.passed, len(list_filter(f.passed, lambda p: p > n.t - 3600000)) < 2 AND len(f.passed) < 3 AS o FROM f JOIN n ON n.user_id = f.user_id AND n.d = f.d AND n.r = f.r + 1) n)
SELECT event_id AS seq, ok FROM f""",
    "admission_of_all": """WITH RECURSIVE n AS (SELECT event_id, user_id AS c, epoch_ms(ts) AS t, row_number() OVER (ORDER BY epoch_ms(ts), event_id) AS r FROM events),
f AS (SELECT r, event_id, NULL::INT AS wait, [{'t': t, 'c': c}] AS passed FROM n WHERE r = 1
  UNION ALL SELECT r, event_id, wait, CASE WHEN wait IS NULL THEN list_append(live, {'t': t, 'c': c}) ELSE live END FROM (SELECT *, CASE WHEN len(list_filter(live, lambda p: p.t > t - 60000)) >= 2 THEN 60 WHEN len(live) >= 10000 THEN 3600
    WHEN len(list_filter(own, lambda p: p.t > t - 3600000)) >= 2 THEN 3600 WHEN len(own) >= 3 THEN 21600 END AS wait FROM (SELECT n.*, list_filter(f.passed, lambda p: p.t > n.t - 86400000) AS live, list_filter(f.passed, lambda p: p.c = n.c AND p.t // 86400000 = n.t // 86400000) AS own FROM f JOIN n ON n.r = f.r + 1)))
SELECT event_id AS seq, wait FROM f""",
    "validation": r"""SELECT conv_id, turn, CASE WHEN conv_id % 13 = 0 THEN 'honeypot' WHEN role NOT IN ('user', 'assistant') THEN 'kind' WHEN conv_id % 11 = 0 THEN 'photo' WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 2000 THEN 'length'
WHEN regexp_matches(text, '(?:\+?[0-9][\s\-.()]*){10,}') OR regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}') THEN 'contact'
WHEN NOT (77.3::DOUBLE + (conv_id % 60) / 100.0::DOUBLE BETWEEN 77.38::DOUBLE AND 77.82::DOUBLE AND 12.7::DOUBLE + (turn % 50) / 100.0::DOUBLE BETWEEN 12.78::DOUBLE AND 13.18::DOUBLE) THEN 'place' ELSE 'ok' END AS verdict FROM conversations""",
    "search_ranked": """SELECT p_partkey, p_name, rank::INT AS rank, count(*) OVER () AS total FROM (SELECT *, CASE WHEN lower(p_name) = 'gear' THEN 0 WHEN starts_with(lower(p_name), 'gear') THEN 1 WHEN contains(lower(p_name), 'gear') THEN 2 WHEN contains(lower(p_brand), 'gear') OR contains(lower(p_type), 'gear') THEN 3 END AS rank FROM part) WHERE rank IS NOT NULL ORDER BY rank, p_name, p_partkey LIMIT 8""",
    "snapshot_diff": """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'inserted' WHEN o_orderkey % 10 = 2 THEN 'removed' WHEN o_orderkey % 7 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM orders""",
    "latest_wins": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "contact_filter": r"SELECT doc_id, regexp_matches(text, '(?:\+?[0-9][\s\-.()]*){10,}') OR regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}') AS has_contact FROM documents",
    "duplicates": f"WITH {_BLK} SELECT * FROM dup",
    "conflicts": f"WITH {_BLK} SELECT target, count(*) AS n, count(DISTINCT sig) AS signatures, count(DISTINCT sig) FILTER (verified) > 1 AS among_verified FROM blk WHERE key NOT IN (SELECT key FROM dup) AND NOT rejected AND sig IS NOT NULL GROUP BY target HAVING count(DISTINCT sig) >= 2",
    "block_flags": f"""WITH {_ING}, pairs AS (SELECT a.key, o.key AS other, 1 AS k FROM b a JOIN b o ON a.name_key = o.name_key AND a.sig <> o.sig UNION ALL SELECT a.key, o.key, 2 FROM live a JOIN live o ON a.target = o.target AND a.sig <> o.sig WHERE a.target IN (SELECT target FROM tgt)),
cf AS (SELECT key, count(DISTINCT other) AS conflicts, min(k) = 1 AS timings, max(k) = 2 AS place FROM pairs GROUP BY key)
SELECT b.key, f AS duplicate_of, coalesce(conflicts, 0) AS conflicts, concat_ws(',', CASE WHEN place THEN 'conflicting_target' END, CASE WHEN timings THEN 'conflicting_timings' END, CASE WHEN f IS NOT NULL THEN 'duplicate' END, CASE WHEN age > 365 THEN 'stale_document' END, CASE WHEN age IS NULL THEN 'undated_document' END, CASE WHEN tier IN ('weak', 'none') THEN 'weak_match' END) AS flags
FROM b LEFT JOIN dup ON dup.key = b.key LEFT JOIN cf ON cf.key = b.key""",
    "conflict_members": f"""WITH {_ING}, nm AS (SELECT name_key FROM b WHERE sig IS NOT NULL GROUP BY 1 HAVING count(DISTINCT sig) >= 2) SELECT 'name' AS kind, name_key AS place, sig, key FROM b JOIN nm USING (name_key) WHERE sig IS NOT NULL UNION ALL SELECT 'target', target::VARCHAR, sig, key FROM live JOIN tgt USING (target)""",
    "superseded": f"WITH {_BLK} SELECT key FROM blk m WHERE EXISTS (SELECT 1 FROM blk o WHERE o.target = m.target AND NOT o.rejected AND o.dated > m.dated AND o.sig IS DISTINCT FROM m.sig)",
    "clean_names": f"""SELECT p_partkey, array_to_string(list_filter(w, lambda t: t NOT IN ({_STOP}) AND len(t) > 1), ' ') AS name, array_to_string(list_sort(list_distinct(list_filter(w, lambda t: t NOT IN ({_STOP}) AND len(t) > 1))), ',') AS tokens,
CASE WHEN len(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) > 20 THEN left(trim(regexp_replace(raw, '\\s+', ' ', 'g')), 19) || '…' ELSE trim(regexp_replace(raw, '\\s+', ' ', 'g')) END AS tag
FROM (SELECT p_partkey, raw, regexp_split_to_array(trim(regexp_replace(replace(lower(raw), '×', ' x '), '[^a-z0-9 ]', ' ', 'g')), '\\s+') AS w FROM (SELECT p_partkey, ' The ' || p_name || ' × ' || p_type || ' Rd.Junction' AS raw FROM part))""",
    "gaps": """SELECT user_id, run, count(*) AS n, round(sum(value), 4) AS value FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 21600000000)::INT, 1) AS new FROM events)) GROUP BY ALL""",
}
