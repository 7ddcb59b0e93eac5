"""Names, cleaning and matching as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say nothing about which place is meant.
STOP = ["junction", "jn", "junc", "road", "rd", "circle", "cross", "the", "and", "of", "signal", "x", "ft", "feet", "main", "mn", "jct"]
#: Spellings replaced in this order, then whole words written out.
SPELLING = [
    ("marathalli", "marathahalli"), ("yemlur", "yemalur"), ("yamalur", "yemalur"), ("byappanahalli", "baiyappanahalli"), ("nagara", "nagar"),
    ("palmgroove", "palm grove"), ("shooley", "shoolay"), ("koramangala", "koramangala"), ("bannergatta", "bannerghatta"), ("bannerghata", "bannerghatta"),
    ("hosur rd", "hosur road"), ("tumkur", "tumakuru"), ("mysore", "mysuru"), ("hebbal", "hebbala"),
]
WORDS = {"rd": "road", "orr": "outer ring road", "mn": "main", "ft": "feet", "80ft": "80 feet", "100ft": "100 feet", "jn": "", "junction": "", "twds": "", "from": "", "kr": ""}
#: Fixed patterns: control and direction characters, phone numbers, mail addresses.
CONTROL = r"[\x00-\x1F\x7F-\x9F\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2066}-\x{2069}]"
PHONE = r"(?:\+?[0-9][\s\-.()]*){10,}"
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"


def normal_name(s: Column) -> Column:
    """Lower case, plain, without stop words and single characters."""
    plain = F.regexp_replace(F.replace(F.lower(s), F.lit("×"), F.lit(" x ")), "[^a-z0-9 ]", " ")
    return F.array_join(F.filter(F.split(plain, r"\s+"), lambda t: ~t.isin(*STOP) & (F.length(t) > 1)), " ")


def written_out(s: Column) -> Column:
    """The ingest's normal form: spellings, then words written out one by one."""
    c = F.replace(F.lower(s), F.lit("×"), F.lit(" x "))
    for a, b in SPELLING:
        c = F.replace(c, F.lit(a), F.lit(b))
    table = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
    toks = F.split(F.trim(F.regexp_replace(c, "[^a-z0-9 ]", " ")), r"\s+")
    return F.trim(F.regexp_replace(F.array_join(F.transform(toks, lambda t: F.coalesce(F.try_element_at(table, t), t)), " "), r"\s+", " "))


def tokens(s: Column) -> Column:
    """Distinct telling words of the written-out form, sorted."""
    stop = [*STOP, "&"]
    return F.array_sort(F.array_distinct(F.filter(F.split(written_out(s), " "), lambda t: ~t.isin(*stop) & (F.length(t) > 1))))


def clean_tag(s: Column, longest: int = 256) -> Column:
    """Control characters out, blanks collapsed, capped with an ellipsis; empty becomes null."""
    t = F.trim(F.regexp_replace(F.regexp_replace(s, CONTROL, ""), r"\s+", " "))
    return F.nullif(F.when(F.char_length(t) > longest, F.concat(F.substring(t, 1, longest - 1), F.lit("…"))).otherwise(t), F.lit(""))


def composed(s: Column) -> Column:
    """Unicode's composed form (NFC). Spark has no function for it; only texts with characters
    from U+0300 on, below which nothing can change, go through Python, in Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.coalesce(nfc(F.when(s.rlike(r"[^\x00-\x{2FF}]"), s)), s)


def clean_words(s: Column, longest: int) -> Column:
    """Composed, control characters out but line breaks kept, at most one blank line together, trimmed, capped."""
    t = F.regexp_replace(composed(F.coalesce(s, F.lit(""))), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{200B}-\x{200F}\x{2028}\x{2029}\x{FEFF}]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"\n{3,}", "\n\n")
    return F.substring(F.regexp_replace(t, r"^\s+|\s+$", ""), 1, longest)


def has_contact(s: Column) -> Column:
    return F.coalesce(s.rlike(PHONE) | s.rlike(MAIL), F.lit(False))


def is_doubled(s: Column) -> Column:
    """Whether each letter of a text is printed twice."""
    return (F.length(s) >= 4) & (F.length(s) % 2 == 0) & s.rlike(r"^(?:(.)\1)+$")


def undoubled(s: Column) -> Column:
    """BBLLIINNKK becomes BLINK; other texts stay."""
    return F.when(is_doubled(s), F.regexp_replace(s, r"(.)\1", "$1")).otherwise(s)


def sentences(body: Column) -> Column:
    """Parts that end before a capital or a bullet."""
    flat = F.trim(F.regexp_replace(body, r"\s+", " "))
    return F.filter(F.split(flat, r"(?<=[.!?])\s+(?=[A-Z➢✓•])|(?=[➢✓•])"), lambda x: F.trim(x) != "")


#: Fixed patterns: what makes a sentence a recommendation, and what an observation.
RECOMMENDS = r"(?i)recommend|need to be|needs to be|should|optimi[sz]|propos|suggest"
OBSERVES = r"(?i)kmph|km/h|speed|delay|queue|congestion|observed|survey"
#: Words before a name that are no part of it, openings dropped once each in this order,
#: names that say nothing, and kinds of place that follow a name.
LEADS = ["junction", "signal", "circle", "the", "two", "one", "way", "from", "towards", "near", "at"]
OPENINGS = ["Two Way ", "One Way ", "Delay- Towards ", "From ", "Towards ", "Near "]
GENERIC = [
    "signalized", "junction", "traffic", "pedestrian", "critical", "key", "major", "the", "manual", "stage", "ft", "d", "c", "pelican", "two way", "one way", "from", "delay- towards",
    "two way cmp", "two way junction", "one way junction", "junction road", "two way road", "mile",
]
PLACE = r"((?:[A-Z][\w.'&-]*\s){0,4}[A-Z][\w.'&-]*)\s+(Junction|junction|Circle|circle|Cross|cross|Signal|signal|intersection|Intersection)"
#: Fixed patterns: statements about the city's signals, and their kinds.
STATEMENTS = [
    (r"There are 360 Traffic signals in total", "signal_count"), (r"352 traffic signals installed", "signal_count"), (r"Out of 352 traffic signals, 11 have been removed", "signal_count"),
    (r"More than 270 Signals are connected", "connectivity"), (r"time-of-day control function", "control_regime"), (r"programmed to work from 7am to 12pm", "operating_hours"),
    (r"blinking mode and show amber blinking", "operating_hours"), (r"No vehicle detector is used", "control_regime"), (r"signal timing is continuously reviewed", "control_regime"),
    (r"area traffic control system for the signal system may be completed", "control_regime"), (r"Most of the signals are operated manually by police", "control_regime"),
]


def claim_kind(s: Column) -> Column:
    """Recommendation before observation before mere mention."""
    return F.when(s.rlike(RECOMMENDS), "qualitative_recommendation").when(s.rlike(OBSERVES), "observation").otherwise("mention")


def clean_place(raw: Column) -> Column:
    """A name without openings, stray single letters and leading words; null when generic or under three characters."""
    name = F.regexp_replace(F.regexp_replace(raw, r"\s+", " "), "^[ \u2013-]+|[ \u2013-]+$", "")
    for opening in OPENINGS:
        name = F.when(F.startswith(name, F.lit(opening)), F.substring(name, len(opening) + 1, 1 << 30)).otherwise(name)
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    plain = F.transform(words, lambda w: ~(F.lower(w).isin(*LEADS) | (F.length(w) == 1)))
    first = F.array_position(plain, True).cast("int")
    name = F.when(first > 0, F.array_join(F.slice(words, first, F.size(words)), " "))
    return F.when((F.length(name) >= 3) & ~F.lower(name).isin(*GENERIC), name)


def place_mentions(pages: DataFrame) -> DataFrame:
    """(source, page, name, kind, claim, pos) of places named in sentences about signals, the first of each name and kind on a page."""
    told = pages.filter(F.col("body").rlike("(?i)signal"))
    sent = told.select("source", "page", F.posexplode(sentences(F.col("body"))).alias("pos", "sentence")).filter(F.col("sentence").rlike("(?i)signal"))
    found = F.posexplode(F.arrays_zip(F.regexp_extract_all("sentence", F.lit(PLACE), 1).alias("raw"), F.regexp_extract_all("sentence", F.lit(PLACE), 2).alias("kind"))).alias("at", "m")
    rows = sent.select("source", "page", "pos", claim_kind(F.col("sentence")).alias("claim"), found)
    rows = rows.select("source", "page", "pos", "at", "claim", clean_place(F.col("m.raw")).alias("name"), F.lower("m.kind").alias("kind")).filter("name IS NOT NULL")
    first = rows.groupBy("source", "page", F.lower("name").alias("low"), "kind").agg(F.min(F.struct("pos", "at", "name", "claim")).alias("f"))
    return first.select("source", "page", "f.name", "kind", "f.claim", "f.pos", "f.at")


def numbered_mentions(mentions: DataFrame) -> DataFrame:
    """mentions with an id of source, page and the number of the mention in its source's order."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("source").orderBy("page", "pos", "at"))
    return mentions.withColumn("id", F.concat(F.col("source"), F.lit(":p"), F.col("page"), F.lit(":"), n)).withColumn("mention", F.concat_ws(" ", "name", "kind"))


def city_statements(pages: DataFrame) -> DataFrame:
    """(source, page, kind, ord) of known statements; one row for each statement that a page makes."""
    flat = F.regexp_replace("body", r"\s+", " ")
    table = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("kind"), flat.rlike("(?i)" + pattern).alias("ok")) for i, (pattern, kind) in enumerate(STATEMENTS)])
    return pages.select("source", "page", F.inline(F.filter(table, lambda x: x["ok"]))).select("source", "page", "kind", "ord")


def search_rank(name: Column, roads: Column, asked: Column) -> Column:
    """0 exact, 1 prefix, 2 within, 3 within a road's name; null otherwise or under two characters."""
    n, q = F.lower(name), F.lower(F.trim(asked))
    rank = F.when(n == q, 0).when(F.startswith(n, q), 1).when(F.contains(n, q), 2).when(F.exists(roads, lambda r: F.contains(F.lower(r), q)), 3)
    return F.when(F.length(q) >= 2, rank)


#: Compass words in degrees.
HEADINGS = {
    "n": 0.0, "north": 0.0, "nne": 22.5, "ne": 45.0, "northeast": 45.0, "north-east": 45.0, "ene": 67.5, "e": 90.0, "east": 90.0, "ese": 112.5,
    "se": 135.0, "southeast": 135.0, "south-east": 135.0, "sse": 157.5, "s": 180.0, "south": 180.0, "ssw": 202.5, "sw": 225.0, "southwest": 225.0,
    "south-west": 225.0, "wsw": 247.5, "w": 270.0, "west": 270.0, "wnw": 292.5, "nw": 315.0, "northwest": 315.0, "north-west": 315.0, "nnw": 337.5,
}


def headings(raw: Column) -> Column:
    """Degrees of a ;-list; one bad part empties the list."""
    table = F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv])
    parts = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ";"), lambda p: F.lower(F.trim(p))), lambda p: p != "")

    def degrees(p: Column) -> Column:
        number = F.when(p.rlike(r"^\d+(?:\.\d+)?$"), p.try_cast("double"))
        return F.coalesce(F.when(number <= 360, F.pmod(number, F.lit(360.0))), F.when(number.isNull(), F.try_element_at(table, p)))

    got = F.transform(parts, degrees)
    return F.when(F.exists(got, lambda d: d.isNull()), F.array().cast("array<double>")).otherwise(got)


def facet(raw: Column, known: list[str], renamed: dict[str, str] | None = None) -> Column:
    """One of the known values, "other", or "none" where nothing is mapped."""
    low = F.lower(raw)
    for a, b in (renamed or {}).items():
        low = F.when(low == a, b).otherwise(low)
    return F.when(raw.isNull(), "none").when(low.isin(*known), low).otherwise("other")


def roads_of(descriptor: Column) -> Column:
    """Road names of a descriptor such as A ROAD X B ROAD JN.; a capital X divides them."""
    plain = F.regexp_replace(F.coalesce(descriptor, F.lit("")), r"(?i)\bJN\b|\bJUNCTION\b", "")
    parts = F.filter(F.split(plain, r"\s+X\s+"), lambda r: F.trim(r) != "")
    return F.transform(parts, lambda r: F.regexp_replace(r, r"^[ .-]+|[ .-]+$", ""))


def name_key(name: Column, station: Column) -> Column:
    """Plain name and police station: what a document's duplicates share."""
    return F.concat(normal_name(name), F.lit("|"), normal_name(F.coalesce(station, F.lit(""))))
