"""Field rules of feeds and entries: persons, dates, languages, media types, times to live."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_not_blank, ws_trim

MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9._%-]+\.[A-Za-z]{2,4}"
XML_TYPES, HTML_TYPES = ("xml", "xhtml", "application/xhtml+xml"), ("html", "xhtml", "text/html", "application/xhtml+xml")
AUDIO = r"(?i)^audio/|\.(?:mp3|m4a|m4p|wav|ogg|wma)$"
VIDEO = r"(?i)^video/|^image/mov$|\.(?:mov|mp4|avi|wmv|asf)$"
SPANS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31557600}


def author(raw: Column) -> Column:
    """name, email and raw of ``name (mail)``, ``mail (name)``, a bare mail or a name."""
    t = ws_trim(raw)
    inside, outside = ws_trim(F.regexp_extract(t, r"\(([^)]*)\)", 1)), ws_trim(F.regexp_extract(t, r"^([^(]*)", 1))
    mail = F.nullif(F.regexp_extract(t, f"({MAIL})", 1), F.lit(""))
    name = F.when(~t.contains("@"), t).when(inside.rlike(f"^{MAIL}$"), outside).when(outside.rlike(f"^{MAIL}$") & (inside != ""), inside).when(t.rlike(f"^{MAIL}$"), F.lit(None).cast("string")).otherwise(ws_trim(F.regexp_replace(t, f"[(<]?{MAIL}[)>]?", "")))
    return F.struct(F.nullif(name, F.lit("")).alias("name"), mail.alias("email"), t.alias("raw"))


def language(*candidates: Column) -> Column:
    parts = F.split(F.lower(F.replace(F.coalesce(first_not_blank(*candidates), F.lit("en-us")), F.lit("_"), F.lit("-"))), "-")
    return F.when(F.size(parts) == 1, parts[0]).otherwise(F.concat(parts[0], F.lit("-"), F.upper(F.element_at(parts, -1))))


def duration(c: Column) -> Column:
    """H:M:S, M:S or S in seconds."""
    return F.aggregate(F.split(ws_trim(c), ":"), F.lit(0).cast("long"), lambda a, x: a * 60 + F.coalesce(F.expr("0") + x.try_cast("long"), F.lit(0)))


def time_to_live(period: Column, frequency: Column, ttl: Column, span: Column, default: int = 3600, most: int = 259200, schedule: Column | None = None) -> Column:
    """Seconds: syndication period times frequency, else ttl times span (minutes), else the schedule's sum, else the default; capped."""
    unit = F.when(period == "daily", 86400).when(period == "weekly", 604800).when(period == "monthly", 2592000).when(period == "yearly", 31557600).otherwise(3600)
    stem = F.regexp_replace(F.lower(span), "s$", "")
    scale = F.lit(60)
    for name, seconds in SPANS.items():
        scale = F.when(stem == name, seconds).otherwise(scale)
    chosen = F.coalesce(F.when(frequency > 0, unit * frequency), F.when(ttl > 0, ttl * scale), *([] if schedule is None else [F.when(schedule > 0, schedule)]), F.lit(default))
    return F.least(chosen, F.lit(most)).cast("long")


def is_html(c: Column) -> Column:
    return c.isin(*HTML_TYPES)


def is_xml(c: Column) -> Column:
    return c.isin(*XML_TYPES) | c.endswith("xml")


def is_audio(mime: Column, href: Column) -> Column:
    return F.coalesce(mime.rlike(AUDIO), F.lit(False)) | F.coalesce(href.rlike(AUDIO), F.lit(False))


def is_video(mime: Column, href: Column) -> Column:
    return F.coalesce(mime.rlike(VIDEO), F.lit(False)) | F.coalesce(href.rlike(VIDEO), F.lit(False))


_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:[.,]\d+)?"
_ZONE = r"([+-]\d{2}:?\d{2}|[+-]\d{2}|\p{L}{1,5})?"
_HALF = r"\s*(?:([AaPp])\.?[Mm]\.?)?"
#: Forms of dates and the places of year, month, day, hour, minute, second, zone and half of the day in them.
DATES = [
    (r"^(\d{4}|\d{2})-?(\d{3})$", "$1|1|$2||||||"),
    (rf"^(?:\p{{L}}+\.?,?\s+)?(\d{{1,2}})[\s-]+(\p{{L}}{{3,}})\.?,?[\s-]+(\d{{4}}|\d{{2}})(?:[T\s,]+{_CLOCK})?\s*{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|"),
    (rf"^(\d{{4}})-?(\d{{2}}|\p{{L}}{{3,}}-)-?(\d{{1,2}})(?:[T\s]+(\d{{1,2}}):?(\d{{2}})(?::?(\d{{2}}))?(?:[.,]\d+)?\s*{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|"),
    (rf"^(?:\p{{L}}+\.?,?\s+)?(\p{{L}}{{3,}})\.?\s+(\d{{1,2}})\s+{_CLOCK}\s+(?:{_ZONE}\s+)?(\d{{4}})$", "$7|$1|$2|$3|$4|$5|$6|"),
    (rf"^(?:\p{{L}}+,?\s+)?(\p{{L}}{{3,}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:[\s,]+{_CLOCK}{_HALF})?\s*{_ZONE}$", "$3|$1|$2|$4|$5|$6|$8|$7"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})(?:[\s,]+{_CLOCK}{_HALF})?\s*{_ZONE}$", "$3|$1|$2|$4|$5|$6|$8|$7"),
    (rf"^(\d{{4}})-?([Ww]\d{{2}})(?:-?(\d))?(?:[T\s]+{_CLOCK}\s*{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|"),
    (r"^(\d{4})-(\d{2})$", "$1|$2|1|||||"),
    (r"^-?(\d{2})-(\d{2})-(\d{2})$", "$1|$2|$3|||||"),
    (r"^(\d{2})(\d{2})(\d{2})$", "$1|$2|$3|||||"),
    (r"^-(\d{2})-?(\d{2})$", "$1|$2|1|||||"),
    (r"^(\d{4})$", "$1|1|1|||||"),
]
#: How the names of months begin, also Greek and Hungarian ones; fixed values.
MONTHS = ["jan|ιαν", "feb|φεβ", "mar|már|μάρ", "apr|ápr|απρ", "may|máj|μάι|μάϊ|μαϊ", "jun|jún|ιούν", "jul|júl|ιούλ", "aug|αύγ", "sep|sze|σεπ", "oct|okt|οκτ", "nov|νοέ", "dec|δεκ"]
#: Zones by name in seconds east of Greenwich; a name that isn't here makes no date.  Fixed values.
_ZONE_HOURS = {
    "NST": -3.5, "NDT": -2.5, "AST": -4, "ADT": -3, "AKST": -9, "AKDT": -8, "HST": -10, "HDT": -9, "WET": 0, "WEST": 1, "EET": 2, "EEST": 3, "IST": 5.5, "PKT": 5, "AEST": 10, "AEDT": 11, "ACST": 9.5, "ACDT": 10.5, "AWST": 8, "NZST": 12, "NZDT": 13,
    "KST": 9, "HKT": 8, "SGT": 8, "PHT": 8, "WIB": 7, "ICT": 7, "BRT": -3, "ART": -3, "CLT": -4, "SAST": 2, "EAT": 3, "WAT": 1, "CAT": 2, "MSD": 4, "TRT": 3, "MEZ": 1, "MESZ": 2,
}
ZONES = {k: int(v * 3600) for k, v in _ZONE_HOURS.items()} | {"EST": -18000, "EDT": -14400, "CST": -21600, "CDT": -18000, "MST": -25200, "MDT": -21600, "PST": -28800, "PDT": -25200, "CET": 3600, "CEST": 7200, "BST": 3600, "MSK": 10800, "JST": 32400}


def _lookup(values: dict[str, int]) -> Column:
    """A constant map of names to numbers, as text."""
    return F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in values.items())), F.lit(","), F.lit(":"))


def parse_date(c: Column) -> Column:
    """The time of a date in RFC 822, ISO 8601, asctime or American form and near them; null where none fits.

    Weeks are those of ISO 8601; their day is Monday where none is given.  Years of two digits lie from 1969 to 2068, a month's missing days run into the next month, hours
    above 24, minutes above 59 and seconds above 60 are no date.  A form is tried only where none before it fitted.
    """
    once = lambda v, use: F.get(F.transform(F.array(v), use), F.lit(0))

    def parts(t: Column) -> Column:
        found = F.when(t.isNull(), F.lit(None).cast("string"))
        for form, places in DATES:
            found = found.when(t.rlike(form), F.regexp_replace(t, form, places))
        return F.split(found, r"\|", -1)

    def number(digits: Column) -> Column:
        """0 where there are none; a failing cast would cost more than all the rest."""
        return F.when(digits != "", digits.cast("int")).otherwise(0)

    def stamp(p: Column) -> Column:
        y, name = p[0].cast("int"), F.lower(p[1])
        year = F.when(F.char_length(p[0]) > 2, y).when(y < 69, y + 2000).otherwise(y + 1900)
        named = F.element_at(_lookup({n: k for k, names in enumerate(MONTHS, 1) for n in names.split("|")}), F.substring(name, 1, 3))
        month = F.when(F.ascii(name).between(48, 57), name.cast("int")).otherwise(named.cast("int"))
        day, hour, minute, second, half = number(p[2]), number(p[3]), number(p[4]), number(p[5]), F.lower(p[7])
        hour = F.when((half == "p") & (hour < 12), hour + 12).when((half == "a") & (hour == 12), 0).otherwise(hour)
        zone = F.upper(p[6])
        signed = F.when(zone.startswith("-"), -1).otherwise(1) * (number(F.substring(zone, 2, 2)) * 3600 + number(F.regexp_extract(zone, r"^...:?(\d{2})", 1)) * 60)
        east = F.element_at(_lookup({"Z": 0, "GMT": 0, "UT": 0, "UTC": 0} | ZONES), zone).cast("int")
        # None and one letter say nothing (RFC 2822); a name that isn't known makes no date.
        offset = F.when(F.ascii(zone).isin(43, 45), signed).otherwise(F.coalesce(east, F.when(F.char_length(zone) < 2, 0)))
        week = F.when(name.rlike(r"^w\d"), number(F.substring(name, 2, 2)))
        fourth = F.make_date(F.when(week.between(1, F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))) & (day <= 7) & (hour <= 24) & (minute <= 59) & (second <= 60), year), F.lit(1), F.lit(4))  # always in week 1
        by_week = F.unix_date(fourth).cast("long") - F.weekday(fourth) + (week - 1) * 7 + F.greatest(day, F.lit(1)) - 1
        fine = month.between(1, 12) & (day >= 1) & (day <= F.when(F.size(p) > 8, 366).otherwise(31)) & (hour <= 24) & (minute <= 59) & (second <= 60)
        days = F.unix_date(F.make_date(F.when(fine, year), F.when(fine, month), F.lit(1))).cast("long") + day - 1
        return F.timestamp_seconds(F.coalesce(by_week, days) * 86400 + hour * 3600 + minute * 60 + second - offset)

    return once(once(ws_trim(c), parts), lambda p: F.when(p.isNotNull(), stamp(p)))


def feed_type(root: Column, ns: Column) -> Column:
    r = F.lower(root)
    return F.when(r == "feed", "atom").when(r.isin("rdf", "rdf:rdf", "rss"), "rss").when(r == "channel", F.when(ns == "http://purl.org/net/rss1.1#", "rss").otherwise("cdf"))


def feed_version(kind: Column, ns: Column, version: Column) -> Column:
    by_ns = F.when(ns == "http://www.w3.org/2005/Atom", 1.0).when(ns == "http://purl.org/atom/ns#", 0.3).when(ns == "http://my.netscape.com/rdf/simple/0.9/", 0.9).when(ns == "http://purl.org/rss/1.0/", 1.0).when(ns == "http://purl.org/net/rss1.1#", 1.1)
    number = F.regexp_extract(F.coalesce(version, F.lit("")), r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    value = F.when(kind == "cdf", 0.4).otherwise(F.coalesce(by_ns, number))
    return F.nullif(F.when((kind == "rss") & value.isin(2.1, 2.01), 2.0).otherwise(value), F.lit(0.0))


def encoding(content_type: Column, declaration: Column) -> Column:
    from_http = F.nullif(F.regexp_extract(content_type, r"(?i)charset=\s*\"?([\w-]+)", 1), F.lit(""))
    from_xml = F.nullif(F.regexp_extract(declaration, r"^\s*<\?xml[^>]*encoding=\"([^\"]+)\"", 1), F.lit(""))
    return F.lower(F.coalesce(from_http, from_xml, F.lit("utf-8")))


def not_empty(c: Column) -> Column:
    """The list, computed once, or null where it is empty."""
    return F.get(F.filter(F.array(c), lambda x: F.size(x) > 0), F.lit(0))


def tags(*candidates: Column) -> Column:
    """Lower-cased distinct tags of the first list that isn't empty."""
    lists = [not_empty(c) for c in candidates]
    return F.array_distinct(F.filter(F.transform(F.coalesce(*lists, F.array().cast("array<string>")), lambda x: F.lower(ws_trim(x))), lambda x: x != ""))


def keywords(c: Column) -> Column:
    """Keywords between commas, else between blanks."""
    by_comma = F.split(c, r"\s*,\s*")
    return F.when(F.size(by_comma) > 1, by_comma).otherwise(F.split(ws_trim(c), r"\s+"))


def link_score(kind: Column, rel: Column, href: Column, feed_href: Column | None = None, sole: Column | None = None) -> Column:
    """The score of a link; with ``feed_href`` as for a feed, else as for an entry."""
    rule = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0)
    s = rule(is_xml(kind), 1) + F.when(F.coalesce(is_html(kind), F.lit(False)), 2).when(F.coalesce(kind, F.lit("")) != "", -1).otherwise(0) + rule(rel == "alternate", 1) + rule(rel == "self", -1)
    if feed_href is not None:
        s = s + rule(href == feed_href, -2) + rule(kind.contains("image") | kind.contains("video"), -2) + rule(rel == "enclosure", -2) + rule((rel == "self") & (href.contains("xml") | href.contains("atom") | href.contains("feed")), -1)
    elif sole is not None:
        s = s + rule(sole & kind.rlike("^(?:video|audio)"), 1)
    return s


def best_link(links: Column, feed_href: Column | None = None) -> Column:
    """The href with the largest score of 0 or more; the earliest among equals."""
    sole = F.size(links) == 1
    scored = F.transform(links, lambda x, i: F.struct(link_score(x["type"], x["rel"], x["href"], feed_href, sole if feed_href is None else None).alias("s"), (-i).alias("i"), x["href"].alias("href")))
    return F.array_max(F.filter(scored, lambda x: x["s"] >= 0))["href"]
