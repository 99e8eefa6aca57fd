"""Enclosures of entries: RSS, Atom, video and media elements, and media groups.

All are arrays of one struct, built from the node array of a document.  A
member of a media group takes what it lacks from its group; the group counts as
one enclosure, its default (else first) member, with the addresses of all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.uri import normalize_url
from feedloom.operators.enclosures import itunes_path

from .shred import attribute, children, let


def _whole(c: Column) -> Column:
    return F.nullif(c.try_cast("double").cast("long"), F.lit(0))


def _flag(c: Column) -> Column:
    return F.lower(c).isin("true", "yes")


def _shared(nodes: Column, parent: Column) -> dict[str, Column]:
    """What a media element may hold, and its group in its place."""

    def first(name: str, make) -> Column:
        return F.get(F.transform(children(nodes, parent, name), make), F.lit(0))

    def sized(c: Column) -> Column:
        return F.struct(F.coalesce(attribute(c, "url"), F.nullif(c["text"], F.lit(""))).alias("url"), _whole(attribute(c, "height")).alias("height"), _whole(attribute(c, "width")).alias("width"))

    found = F.transform(children(nodes, parent, "media:category"), lambda c: F.struct(F.coalesce(attribute(c, "term"), F.nullif(c["text"], F.lit(""))).alias("term"), attribute(c, "scheme").alias("scheme"), attribute(c, "label").alias("label")))
    credits = F.transform(children(nodes, parent, "media:credit"), lambda c: F.struct(c["text"].alias("name"), F.lower(attribute(c, "role")).alias("role")))
    return {
        "thumbnail": first("media:thumbnail", sized),
        "player": first("media:player", sized),
        "hash": first("media:hash", lambda c: F.struct(c["text"].alias("value"), F.coalesce(attribute(c, "algo"), F.lit("md5")).alias("type"))),
        "categories": let(found, lambda c: F.when(F.size(c) > 0, c)),
        "credits": let(credits, lambda c: F.when(F.size(c) > 0, c)),
        "text": first("media:text", lambda c: F.nullif(c["text"], F.lit(""))),
        "explicit": first("media:adult", lambda c: _flag(c["text"])),
    }


def _enclosure(nodes: Column, e: Column, href: Column, kind: Column, size: Column, group: Column | None = None, media: bool = False) -> Column:
    own = _shared(nodes, e["id"])
    up = _shared(nodes, group["id"]) if group is not None else {}
    word = F.lower(attribute(e, "expression"))
    number = lambda name: (_whole(attribute(e, name)) if media else F.lit(None).cast("long")).alias(name)
    return F.struct(
        href.alias("href"), F.lower(kind).alias("type"), _whole(size).alias("file_size"),
        number("duration"), number("height"), number("width"), number("bitrate"), number("framerate"),
        F.coalesce(_flag(attribute(e, "isdefault")), F.lit(False)).alias("is_default"),
        F.when(word.isin("sample", "nonstop"), word).otherwise("full").alias("expression"),
        *[F.coalesce(own[k], up[k]).alias(k) if up else own[k].alias(k) for k in own],
        F.array(href).alias("versions"),
    )


def _media(nodes: Column, e: Column, group: Column | None = None) -> Column:
    return _enclosure(nodes, e, attribute(e, "url"), attribute(e, "type"), attribute(e, "filesize"), group, media=True)


def rss_enclosures(nodes: Column, item: Column) -> Column:
    return F.transform(children(nodes, item, "enclosure"), lambda e: _enclosure(nodes, e, attribute(e, "url", "href"), attribute(e, "type"), attribute(e, "length")))


def atom_enclosures(nodes: Column, item: Column) -> Column:
    found = F.filter(children(nodes, item, "link"), lambda e: F.lower(attribute(e, "rel")) == "enclosure")
    return F.transform(found, lambda e: _enclosure(nodes, e, attribute(e, "href"), attribute(e, "type"), attribute(e, "length")))


def video_enclosures(nodes: Column, item: Column) -> Column:
    def kind(href: Column) -> Column:
        return F.when(F.lower(href).endswith(".wmv"), "video/x-ms-wmv")

    return F.transform(children(nodes, item, "video"), lambda e: _enclosure(nodes, e, F.coalesce(attribute(e, "url", "href"), e["text"]), F.coalesce(attribute(e, "type"), kind(F.coalesce(attribute(e, "url", "href"), e["text"]))), attribute(e, "length")))


def media_enclosures(nodes: Column, item: Column) -> Column:
    return F.transform(children(nodes, item, "media:content"), lambda e: _media(nodes, e))


def group_enclosures(nodes: Column, item: Column) -> Column:
    """One enclosure a group: its default member, with the addresses of all members."""

    def best(members: Column) -> Column:
        chosen = F.coalesce(F.get(F.filter(members, lambda m: m["is_default"]), F.lit(0)), F.get(members, F.lit(0)))
        return chosen.withField("versions", F.transform(members, lambda x: x["href"]))

    members = F.transform(children(nodes, item, "media:group"), lambda g: F.transform(children(nodes, g["id"], "media:content"), lambda e: _media(nodes, e, g)))
    return F.transform(F.filter(members, lambda m: F.size(m) > 0), best)


def _merged(rows: Column) -> Column:
    """One enclosure an address; of each field the last value given wins."""
    same = lambda named, hrefs: F.transform(hrefs, lambda h: F.reverse(F.filter(named, lambda e: e["href"] == h)))

    def last(group: Column, name: str) -> Column:
        return F.get(F.filter(F.transform(group, lambda e: e[name]), lambda x: x.isNotNull()), F.lit(0)).alias(name)

    def one(group: Column) -> Column:
        word = F.get(F.filter(F.transform(group, lambda e: e["expression"]), lambda x: x != "full"), F.lit(0))
        return F.struct(
            *[last(group, c) for c in ("href", *NUMBERS)], F.exists(group, lambda e: e["is_default"]).alias("is_default"), F.coalesce(word, F.lit("full")).alias("expression"), *[last(group, c) for c in (*SHARED, "versions")],
        )

    def by_address(named: Column) -> Column:
        """Only where an address stands twice is there anything to merge."""
        hrefs = F.array_distinct(F.transform(named, lambda e: e["href"]))
        return F.when(F.size(hrefs) == F.size(named), named).otherwise(F.transform(same(named, hrefs), one))

    return let(F.filter(rows, lambda e: e["href"].isNotNull()), by_address)


NUMBERS = ("type", "file_size", "duration", "height", "width", "bitrate", "framerate")
SHARED = ("thumbnail", "player", "hash", "categories", "credits", "text", "explicit")


ITUNES = "http://www.apple.com/itunes/store/"


def itunes_categories(nodes: Column, item: Column) -> Column:
    """The paths of an entry's podcast categories, as categories of its enclosures."""

    def path(c: Column) -> Column:
        below = F.get(children(nodes, c["id"], "itunes:category"), F.lit(0))
        return F.struct(itunes_path(attribute(c, "text"), attribute(below, "text")).alias("term"), F.lit(ITUNES).alias("scheme"), F.lit("iTunes Music Store Categories").alias("label"))

    return F.transform(children(nodes, item, "itunes:category"), path)


def enclosures(nodes: Column, item: Column, explicit: Column | None = None, summary: Column | None = None, podcast: Column | None = None) -> Column:
    """All enclosures of an entry, merged by address, groups folded to one each.

    What the entry says holds for its enclosures: ``explicit``, its ``podcast``
    categories, its ``summary`` where one has no text.
    """
    plain = F.concat(rss_enclosures(nodes, item), atom_enclosures(nodes, item), video_enclosures(nodes, item), media_enclosures(nodes, item))

    def joined(groups: Column) -> Column:
        alone = F.filter(let(plain, _merged), lambda e: ~F.exists(groups, lambda g: F.array_contains(g["versions"], e["href"])))
        return F.concat(alone, groups)

    def clean(e: Column) -> Column:
        own = {"href": let(e["href"], normalize_url), "versions": F.transform(e["versions"], normalize_url)}
        if explicit is not None:
            own["explicit"] = F.coalesce(e["explicit"], F.lit(False)) | explicit
        if podcast is not None:
            own["categories"] = F.when(F.size(podcast) > 0, F.array_distinct(F.concat(F.coalesce(e["categories"], F.slice(podcast, 1, 0)), podcast))).otherwise(e["categories"])
        if summary is not None:
            own["text"] = F.coalesce(e["text"], summary)
        return F.struct(*[own.get(c, e[c]).alias(c) for c in ("href", *NUMBERS, "is_default", "expression", *SHARED, "versions")])

    return F.transform(let(group_enclosures(nodes, item), joined), clean)
