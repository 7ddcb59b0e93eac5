"""Values as people read them: places, sizes, ages, dates, links and labels, as column expressions.

Numbers are rounded half up; a missing number reads as a dash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare.functions import clock

NONE = "—"
#: Short months, and the steps of labels and colours (least value, label).
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sept", "Oct", "Nov", "Dec"]
PREDICTABLE = [(90, "Very high"), (75, "High"), (55, "Moderate"), (35, "Low")]
CONFIDENT = [(0.75, "High"), (0.45, "Moderate"), (0.2, "Low")]
DENSITY = [(21, "#FF8A2B"), (11, "#C0651C"), (6, "#A0561F"), (3, "#8A4A18")]
LEAST_DENSITY = "#5E3614"
ORANGE, EMBER, RED, DIM = "#FF8A2B", "#C0651C", "#F0535A", "#8A4A18"


def half_up(x: Column) -> Column:
    """The nearest whole number, halves upwards."""
    return F.floor(x + 0.5).cast("long")


def steps(x: Column, table: list[tuple[float, str]], below: str) -> Column:
    """The label of the first step that x reaches; `below` for less, and for null."""
    out = None
    for least, label in table:
        out = F.when(x >= least, label) if out is None else out.when(x >= least, label)
    return out.otherwise(below)


def coordinate(lat: Column, lon: Column) -> Column:
    """Latitude first, five places; null where one is missing."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.5f, %.5f", lat, lon))


def map_link(lat: Column, lon: Column) -> Column:
    at = F.format_string("%.5f", lat), F.format_string("%.5f", lon)
    return F.format_string("https://www.openstreetmap.org/?mlat=%s&mlon=%s#map=18/%s/%s", *at, *at)


def node_link(node: Column) -> Column:
    return F.concat(F.lit("https://www.openstreetmap.org/node/"), node.cast("string"))


def edit_link(node: Column) -> Column:
    return F.concat(F.lit("https://www.openstreetmap.org/edit?node="), node.cast("string"))


def size(n: Column, even: bool = False) -> Column:
    """Bytes as MB with one place, or whole KB, one at least. even: halves of the last place of MB go to the even digit."""
    kb = F.greatest(F.lit(1).cast("long"), half_up(n / 1024.0))
    mb = F.bround(n / 1048576.0, 1) if even else n / 1048576.0
    return F.when(n >= 1048576, F.format_string("%.1f MB", mb)).otherwise(F.format_string("%d KB", kb))


def age_days(days: Column) -> Column:
    """Days under 45, months under a year, then years, with one place under ten."""
    y = days / 365.25
    return (
        F.when(days < 45, F.format_string("%d d", days)).when(days < 365, F.format_string("%d mo", half_up(days / 30.4)))
        .when(y < 10, F.format_string("%.1f y", y)).otherwise(F.format_string("%d y", half_up(y)))
    )


def duration(seconds: Column) -> Column:
    m = half_up(seconds / 60.0)
    long = F.format_string("%d h %d min", F.floor(m / 60), m % 60)
    return F.when(seconds.isNull() | F.isnan(seconds), NONE).when(m < 60, F.format_string("%d min", m)).otherwise(long)


def signed_seconds(s: Column) -> Column:
    a = F.abs(s)
    body = F.when(a >= 60, F.format_string("%dm %ds", F.floor(a / 60), half_up(a % 60))).otherwise(F.format_string("%d s", half_up(a)))
    return F.when(s.isNull() | F.isnan(s), NONE).otherwise(F.concat(F.when(s < 0, "−").when(s > 0, "+").otherwise(""), body))


def ago(seconds: Column) -> Column:
    """How long ago; what lies ahead is just now."""
    s = F.greatest(F.lit(0.0), seconds)
    return (
        F.when(seconds.isNull(), NONE).when(s < 90, "just now").when(s < 3600, F.format_string("%d min ago", half_up(s / 60)))
        .when(s < 86400, F.format_string("%d h ago", half_up(s / 3600))).otherwise(F.format_string("%d d ago", half_up(s / 86400)))
    )


def _month(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))


def day(d: Column) -> Column:
    """A date such as 11 Sept 2026."""
    return F.format_string("%d %s %d", F.dayofmonth(d), _month(d), F.year(d))


def _local(ts: Column) -> Column:
    """Seconds since 1970 on the local clock."""
    return F.floor(clock.epoch(ts)) + clock.OFFSET_S


def local_date(ts: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(_local(ts) / 86400).cast("int"))


def local_time(ts: Column) -> Column:
    """A time such as 2:05 pm on the local clock."""
    m = clock.minute_of_day(ts)
    h = F.floor(m / 60)
    return F.format_string("%d:%02d %s", F.pmod(h + 11, F.lit(12)) + 1, m % 60, F.when(h < 12, "am").otherwise("pm"))


def local_stamp(ts: Column) -> Column:
    return F.concat_ws(", ", day(local_date(ts)), local_time(ts))


def board_stamp(ts: Column, now: Column) -> Column:
    """As local_stamp, without the year inside the current one (years of the world's clock)."""
    d = local_date(ts)
    short = F.format_string("%d %s", F.dayofmonth(d), _month(d))
    year = lambda x: F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(clock.epoch(x) / 86400).cast("int")))
    return F.concat_ws(", ", F.when(year(ts) == year(now), short).otherwise(day(d)), local_time(ts))


def partial_day(iso: Column) -> Column:
    """A partial date with what it holds: year, month and year, or day; other texts as they are."""
    d = clock.partial_date(iso)
    month = F.format_string("%s %d", _month(d), F.year(d))
    return F.when(d.isNull(), iso).when(F.length(iso) <= 4, F.year(d).cast("string")).when(F.length(iso) <= 7, month).otherwise(day(d))


def currency_label(status: Column, dated: Column, source: Column, days: Column) -> Column:
    """What a document's currency says to a reader."""
    opening = F.when(status == "historical", "Historical — planning/survey document ").when(status == "current", "Recent snapshot — ").when(status == "aging", "Aging — ").otherwise("Stale — ")
    closing = F.when(status == "historical", "evidence only, never a current timing").when(status == "current", "not confirmed against the live programme").otherwise("may not reflect the current programme")
    by_portal = F.when(source == "portal", " (portal date; document undated)").otherwise("")
    told = F.concat(opening, F.lit("dated "), partial_day(dated), by_portal, F.lit(", "), age_days(days), F.lit(" old; "), closing)
    return (
        F.when(status == "undated", "Undated — neither the document nor the portal carries a date; cannot be treated as current")
        .when((status == "historical") & dated.isNull(), "Historical document without a recoverable date — evidence only, never a current timing").otherwise(told)
    )


def currency_tone(status: Column) -> Column:
    return F.when(status.isin("current", "live"), "orange").when(status == "historical", "grey").when(status == "superseded", "red").otherwise("ember")


def live_currency(seconds: Column, fresh: float = 30.0) -> Column:
    return F.when(F.greatest(F.lit(0.0), seconds) <= fresh, "live").otherwise("stale")


def snapshot_value(count: Column, base: Column, days: Column, after: int = 30) -> Column:
    """Records of a snapshot and its base day, marked once it is older than `after` days."""
    value = F.concat(F.format_number(count, 0), F.lit(" records · osm "), F.coalesce(F.substring(base, 1, 10), F.lit(NONE)))
    return F.concat(value, F.when(days > after, " · stale").otherwise(""))


def dataset_value(count: Column, base: Column) -> Column:
    return F.concat(F.coalesce(count.cast("string"), F.lit(NONE)), F.lit(" junctions · osm "), F.coalesce(base, F.lit(NONE)))


def predictability(mae: Column, scale: Column, stability: Column, coverage: Column, calibration: Column) -> Column:
    """0 to 100 from held-out error and three shares."""
    held = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    score = 100 * F.exp(-mae / F.greatest(F.lit(1.0), scale)) * F.pow(held(stability), 0.4) * F.pow(held(coverage), 0.3) * F.pow(held(calibration), 0.3)
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def predictability_label(score: Column) -> Column:
    return steps(score, PREDICTABLE, "Insufficient")


def confidence_label(c: Column) -> Column:
    return steps(c, CONFIDENT, "Insufficient")


def density_colour(n: Column) -> Column:
    return steps(n, DENSITY, LEAST_DENSITY)


def delay_colour(mean: Column, level: Column) -> Column:
    return F.when(mean.isNull() | (level == "E"), DIM).when(mean < 25, ORANGE).when(mean < 60, EMBER).otherwise(RED)


def stop_colour(p: Column) -> Column:
    return F.when(p.isNull(), DIM).when(p < 0.35, ORANGE).when(p < 0.65, EMBER).otherwise(RED)


def confidence_colour(c: Column) -> Column:
    return F.when(c >= 0.8, ORANGE).when(c >= 0.6, EMBER).otherwise(RED)


def safe_link(url: Column) -> Column:
    """The trimmed link if it is http or https with a host, else null."""
    t = F.regexp_replace(url, r"^\s+|\s+$", "")
    return F.when(t.rlike(r"(?i)^https?://[^/\s?#]+"), t)


def client_hash(direct: Column, forwarded: Column) -> Column:
    """SHA-256 of a caller's address, the first of the forwarded ones where none is direct; null without any."""
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    ip = F.coalesce(F.nullif(F.trim(direct), F.lit("")), F.nullif(first, F.lit("")))
    return F.when(ip.isNotNull(), F.sha2(ip, 256))


def daily_key(salt: Column, client: Column) -> Column:
    """A caller's key of one day: joined with the day's salt and hashed."""
    return F.sha2(F.concat(salt, F.lit(":"), client), 256)


def date_in_name(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def quality_ladder(start: float = 0.82, least: float = 0.5, step: float = 0.08) -> list[float]:
    """Descending steps from start; the last is always the least."""
    n = int((start - least + 1e-9) / step) + 1
    out = [round(start - i * step, 2) for i in range(n)]
    return out if out[-1] == least else [*out, least]


def fit_scale(width: Column, height: Column, longest: int) -> Column:
    """The factor that brings the longer side to `longest`; never above one."""
    return F.least(F.lit(1.0), longest / F.greatest(width, height).cast("double"))


def cluster_radius(n: Column) -> Column:
    return F.when(n < 10, 12).when(n < 50, 16).when(n < 200, 21).otherwise(27)


def on_weekday(now: Column, weekday: int, minute: int) -> Column:
    """Epoch seconds of a minute of the local day that is `weekday` (Monday 0), today or within six days."""
    midnight = _local(now) - clock.second_of_day(now)
    ahead = F.pmod(F.lit(weekday) - clock.weekday(now), F.lit(7))
    return (midnight + ahead * 86400 + minute * 60 - clock.OFFSET_S).cast("long")
