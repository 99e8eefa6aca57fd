"""Text functions as column expressions: entities, tags, indentation, blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = " \t\r\n"


def ws_trim(c: Column) -> Column:
    """Strip all ASCII white space, not only blanks."""
    return F.btrim(c, F.lit(WS))


def blank_to_null(c: Column) -> Column:
    """The engine's null: an empty or white-space string counts as missing."""
    return F.when(ws_trim(c) != "", c)


def first_not_blank(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(ws_trim(c), F.lit("")) for c in cs])


def _chain(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_entities(c: Column) -> Column:
    return _chain(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")])


def unescape_named(c: Column) -> Column:
    """The five XML entities, the ampersand first, also written as a number."""
    return _chain(c, [("&#38;", "&amp;"), ("&#x26;", "&amp;"), ("&amp;", "&"), ("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&apos;", "'")])


def unescape_entities(c: Column) -> Column:
    """Named entities of XML and decimal or hexadecimal character references."""
    c = _chain(c, [("&#38;", "&amp;"), ("&#x26;", "&amp;")])
    parts, refs = F.split(c, "&#(?:[0-9]{1,7}|x[0-9a-f]{1,6});", -1), F.regexp_extract_all(c, F.lit("&#(?:[0-9]{1,7}|x[0-9a-f]{1,6});"), F.lit(0))

    def decode(r: Column) -> Column:
        code = F.when(r.startswith("&#x"), F.conv(F.regexp_extract(r, "x([0-9a-f]+)", 1), 16, 10)).otherwise(F.regexp_extract(r, "([0-9]+)", 1)).cast("int")
        return F.when((code < 1114112) & (code > 0) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(r)

    joined = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(decode(F.get(refs, i)), F.lit("")))), "")
    return _chain(joined, [("&amp;", "&"), ("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&apos;", "'")])


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "</?[^>]+>", "")


def plain_text(c: Column) -> Column:
    """Without tags, entities and references decoded, curly quotes that were escaped twice as plain ones."""
    t = strip_tags(c)
    bare = F.when(t.contains("&#"), unescape_entities(t)).otherwise(unescape_named(t))
    return _chain(bare, [("&#8216;", "'"), ("&#8217;", "'"), ("&#8220;", '"'), ("&#8221;", '"')])


def indent(c: Column, spaces: int = 2) -> Column:
    """Every line set in, also an empty one; only a line feed ends a line."""
    pad = " " * spaces
    return F.concat(F.lit(pad), F.replace(c, F.lit("\n"), F.lit("\n" + pad)), F.lit("\n"))


def unindent(c: Column, spaces: int = 2) -> Column:
    return F.regexp_replace(c, f"(?md)^ {{1,{spaces}}}", "")


def strip_wrapper(c: Column) -> Column:
    """Unwrap one div around everything."""
    t = ws_trim(c)
    inner = F.regexp_extract(t, r"(?s)^<div[^>]*>(.*)</div>$", 1)
    return F.when((inner != "") & ~inner.contains("<div") & ~inner.contains("</div>"), ws_trim(inner)).otherwise(t)


def text_construct(kind: Column, mode: Column, raw: Column) -> Column:
    """A text construct as HTML: base64, xhtml, html or escaped, and plain text."""
    decoded = F.decode(F.try_to_binary(raw, F.lit("base64")), "UTF-8")
    html = F.when(mode == "base64", decoded).when(kind.isin("xhtml", "application/xhtml+xml"), raw).when((mode == "escaped") | kind.isin("html", "text/html"), unescape_named(raw)).when(kind.isin("text", "text/plain") | kind.isNull(), escape_entities(unescape_named(raw))).otherwise(raw)
    return blank_to_null(F.replace(html, F.lit("\t"), F.lit("  ")))
