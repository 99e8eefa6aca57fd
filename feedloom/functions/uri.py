"""Addresses: clean-up, resolution, tag and urn names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ws_trim

#: RFC 4122's namespace for URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def is_uri(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(False))


def normalize_url(c: Column) -> Column:
    """Schemes of feed readers become http, a bare host gets one, scripts become #."""
    return _once(ws_trim(c), _normalized)


def _normalized(t: Column) -> Column:
    u = F.regexp_replace(t, r"(?is)^.*javascript:.*$", "#")
    u = F.regexp_replace(u, r"^(?i)(?:(?:feed|rss|mms|htp|http):/*)+(?=https:)", "")
    u = F.regexp_replace(u, r"^(?i)(?:(?:feed|rss|mms|htp|http):/*)+", "http://")
    u = F.regexp_replace(u, r"^(?i)https:/*", "https://")
    return _once(F.regexp_replace(u, r"^//+", "http://"), lambda v: _once(_with_scheme(v), _ended))


def _with_scheme(u: Column) -> Column:
    file = F.regexp_replace(F.replace(F.regexp_replace(u, r"^(?i)file:/*", ""), F.lit("\\"), F.lit("/")), r"^/*([A-Za-z])\|", "$1:")
    local = u.rlike(r"^(?i)(?:file:|[a-z]:[\\/]|/)")
    bare = ~is_uri(u) & u.contains(".") & ~u.rlike("^[#?]")
    return F.when(local, F.concat(F.lit("file:///"), F.regexp_replace(file, "^/+", ""))).when(bare, F.concat(F.lit("http://"), u)).otherwise(F.regexp_replace(u, r"^https?://([#?])", "$1"))


def _ended(u: Column) -> Column:
    """With a path after a host, without blanks; null for a scheme alone."""
    return F.when(u.rlike("^https?://[^/?#]+$"), F.concat(u, F.lit("/"))).when(~u.isin("http://", "https://"), F.replace(u, F.lit(" "), F.lit("%20")))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value planned once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_HEAD = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


def without_dots(url: Column) -> Column:
    """An address without the segments ``.`` and ``..`` of its path, after RFC 3986; addresses without any pass untouched."""

    def rebuilt(u: Column) -> Column:
        whole = _HEAD + r"([^?#]*)(.*)$"
        segments = F.split(F.substr(F.regexp_extract(u, whole, 2), F.lit(2)), "/", -1)
        ends = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        step = lambda kept, x: F.when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.array_append(kept, x))
        path = F.array_join(F.concat(F.aggregate(segments, F.array().cast("array<string>"), step), ends), "/")
        return F.concat(F.regexp_extract(u, whole, 1), F.lit("/"), path, F.regexp_extract(u, whole, 3))

    return _once(url, lambda u: F.when(u.rlike(_HEAD + r"[^?#]*/\.\.?(?:[/?#]|$)"), rebuilt(u)).otherwise(u))


def normalize_http(c: Column) -> Column:
    """Scheme and host of an http address in lower case, no default port, no dot segments."""
    parts = r"^([A-Za-z]+)://([^/?#]*)([^?#]*)(.*)$"

    def rebuilt(u: Column) -> Column:
        scheme, authority = F.lower(F.regexp_extract(u, parts, 1)), F.regexp_extract(u, parts, 2)
        user = F.regexp_extract(authority, "^(.*@)", 1)
        named = F.lower(F.substring(authority, F.char_length(user) + 1, F.char_length(authority)))
        bare = F.when(scheme == "https", F.regexp_replace(named, ":(?:443)?$", "")).otherwise(F.regexp_replace(named, ":(?:80)?$", ""))
        return without_dots(F.concat(scheme, F.lit("://"), user, bare, F.regexp_extract(u, parts, 3), F.regexp_extract(u, parts, 4)))

    return F.when(c.rlike("^(?i:https?)://[^/?#]"), rebuilt(c)).otherwise(c)


def canonical_url(c: Column) -> Column:
    """``normalize_url``, ``ascii_host`` and ``normalize_http``: one spelling of an address, in ASCII."""
    return _once(ascii_path(ascii_host(normalize_url(c))), normalize_http)


def ascii_path(url: Column) -> Column:
    """Characters outside ASCII as their UTF-8 bytes in percent notation."""
    encoded = lambda u: F.array_join(F.transform(F.regexp_extract_all(u, F.lit("(?s)."), F.lit(0)), lambda x: F.when(F.octet_length(x) > 1, F.url_encode(x)).otherwise(x)), "")
    return _once(url, lambda u: F.when(F.octet_length(u) > F.char_length(u), encoded(u)).otherwise(u))


def ascii_host(url: Column) -> Column:
    """The address with an international host name in its ASCII form (RFC 3492), in lower case."""
    whole = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?)([^/?#:]+)(.*)$"
    coded = lambda x: F.when(F.octet_length(x) > F.char_length(x), F.concat(F.lit("xn--"), punycode(x))).otherwise(x)
    named = lambda u: F.array_join(F.transform(F.split(F.lower(F.regexp_extract(u, whole, 2)), "[.\u3002\uff0e\uff61]", -1), coded), ".")
    return _once(url, lambda u: F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^\x00-\x7f/?#]"), F.concat(F.regexp_extract(u, whole, 1), named(u), F.regexp_extract(u, whole, 3))).otherwise(u))


#: The parameters of RFC 3492 for host names; fixed values.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_N = 36, 1, 26, 38, 700, 72, 128


def punycode(label: Column) -> Column:
    """RFC 3492's form of a label that holds characters outside ASCII.

    Those characters are taken by code point and place; each adds the number of insertion states that were skipped
    since the one before, written as an integer of variable length.
    """
    number = lambda v: F.lit(v).cast("long")
    div = lambda a, b: F.floor(a / b).cast("long")
    chars = F.regexp_extract_all(label, F.lit("(?s)."), F.lit(0))
    codes = F.transform(chars, lambda x: F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("long"))

    def digits(delta: Column, bias: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            t = F.least(F.greatest(k * BASE - bias, number(T_MIN)), number(T_MAX))
            last = s["q"] < t
            digit = F.when(last, s["q"]).otherwise(t + F.pmod(s["q"] - t, BASE - t))
            char = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), (digit + 1).cast("int"), F.lit(1))
            return F.when(s["q"] < 0, s).otherwise(F.struct(F.when(last, -1).otherwise(div(s["q"] - t, BASE - t)).cast("long").alias("q"), F.concat(s["out"], char).alias("out")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.struct(delta.alias("q"), F.lit("").alias("out")), step)["out"]

    def adapted(delta: Column, points: Column, first: Column) -> Column:
        start = _once(F.when(first, div(delta, number(DAMP))).otherwise(div(delta, number(2))), lambda d: d + div(d, points))
        limit = (BASE - T_MIN) * T_MAX // 2
        step = lambda s, _: F.when(s["d"] > limit, F.struct(div(s["d"], number(BASE - T_MIN)).alias("d"), (s["k"] + BASE).alias("k"))).otherwise(s)
        end = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.struct(start.alias("d"), number(0).alias("k")), step)
        return _once(end, lambda s: s["k"] + div((BASE - T_MIN + 1) * s["d"], s["d"] + SKEW))

    def encoded(codes: Column) -> Column:
        plain = F.filter(codes, lambda c: c < FIRST_N)
        others = F.array_sort(F.filter(F.transform(codes, lambda c, i: F.struct(c.alias("c"), i.cast("long").alias("at"))), lambda x: x["c"] >= FIRST_N))
        below = lambda m, lo, hi: F.size(F.filter(F.transform(codes, lambda c, i: (c < m) & (i > lo) & (i < hi)), lambda x: x)).cast("long")
        n = F.size(codes)

        def step(s: Column, x: Column) -> Column:
            first = s["c"] < 0
            afresh = (x["c"] - F.when(first, number(FIRST_N)).otherwise(s["c"] + 1)) * (s["h"] + 1) + below(x["c"], number(-1), x["at"])
            delta = F.when(first, afresh).when(x["c"] == s["c"], below(x["c"], s["at"], x["at"])).otherwise(below(s["c"], s["at"], n) + 1 + afresh)
            return _once(delta, lambda d: F.struct(x["c"].alias("c"), x["at"].alias("at"), (s["h"] + 1).alias("h"), adapted(d, s["h"] + 1, first).alias("bias"), F.concat(s["out"], digits(d, s["bias"])).alias("out")))

        letters = F.array_join(F.transform(plain, lambda c: F.char(c)), "")
        start = F.struct(number(-1).alias("c"), number(-1).alias("at"), F.size(plain).cast("long").alias("h"), number(FIRST_BIAS).alias("bias"), F.when(F.size(plain) > 0, F.concat(letters, F.lit("-"))).otherwise("").alias("out"))
        return F.aggregate(others, start, step)["out"]

    return _once(codes, encoded)


def host(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def resolve(base: Column, ref: Column) -> Column:
    """Absolute, host-relative, root-relative and document-relative references, without dot segments."""
    return _once(F.named_struct(F.lit("base"), base, F.lit("ref"), ref), lambda x: _resolved(x["base"], x["ref"]))


def _resolved(base: Column, ref: Column) -> Column:
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+$"), F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, r"[^/]*$", ""))
    return (
        F.when(ref.isNull() | base.isNull() | base.startswith("file:") | is_uri(ref), ref)
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), ref)).when(ref.startswith("?"), F.concat(bare, ref))
        .otherwise(without_dots(F.when(ref.startswith("//"), F.concat(scheme, ref)).when(ref.startswith("/"), F.concat(origin, ref)).otherwise(F.concat(folder, ref))))
    )


def tag_uri(url: Column, day: Column) -> Column:
    path = F.replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?]*)", 1), F.lit("#"), F.lit("/"))
    return F.concat(F.lit("tag:"), host(url), F.lit(","), day, F.lit(":"), path)


def urn_uuid(url: Column) -> Column:
    """Version 5 UUID of a URL."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(url, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def favicon(link: Column) -> Column:
    return F.when(link.startswith("http://"), F.concat(F.lit("http://"), host(link), F.lit("/favicon.ico")))
