"""Feeds and entries from shredded documents, and documents from feeds and entries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.config import DEFAULTS, Settings
from feedloom.functions import fields
from feedloom.functions.text import escape_entities, unescape_entities
from feedloom.functions import uri
from feedloom.functions.uri import favicon, is_uri, normalize_url, resolve

from feedloom.operators.enclosures import with_size
from feedloom.operators.order import places
from feedloom.operators.relate import estimate_in_documents

from . import media
from .source import Folder, register
from .tables import range_partitions
from .shred import CHARS_HELD, PREFIXES, all_children, attribute, children, construct_html, decode_bytes, decoded, first_node, first_text, let, plain_html, shredded

# Ordered names of the elements that hold a column; the first that isn't blank wins.
FEED_TITLE = ("title", "dc:title", "channeltitle")
ITEM_TITLE = ("title", "dc:title", "headline")
SUBTITLE = ("subtitle", "tagline", "description", "summary", "abstract", "content:encoded", "encoded", "content", "xhtml:body", "body", "xhtml:div", "div", "payload", "channeldescription", "blurb", "info")
CONTENT = ("content", "datacontent", "xhtml:body", "body", "xhtml:div", "div", "payload", "content:encoded", "fullitem", "encoded", "description", "tagline", "subtitle", "summary", "abstract", "blurb", "info")
SUMMARY = ("summary", "abstract", "blurb", "description", "tagline", "subtitle", "xhtml:body", "body", "xhtml:div", "div", "payload", "fullitem", "content:encoded", "encoded", "content", "info", "datacontent")
TIME = ("updated", "modified", "time", "lastbuilddate", "issued", "published", "dc:date", "pubdate", "date")
UPDATED = ("updated", "modified", "lastbuilddate")
PUBLISHED_FEED = ("published", "dc:date", "pubdate", "issued")
PUBLISHED_ITEM = ("issued", "published", "dc:date", "pubdate", "date")
AUTHOR = ("author", "managingeditor", "dc:author", "dc:creator")
RIGHTS = ("copyright", "copyrights", "dc:rights", "rights")
ENTRIES = ("entry", "item", "story")


def named(**fields_: Column) -> Column:
    """A struct of these fields; its names also hold inside nested lambdas."""
    return F.named_struct(*[c for name, value in fields_.items() for c in (F.lit(name), value)])


LINKS = ("link", "channellink", "a", "url", "href")


def links(nodes: Column, parent: Column, base: Column, rel: Column | None = None, settings: Settings = DEFAULTS) -> Column:
    """Links of a feed or an entry; ``rel`` stands where a link names none, a title equal to the address is none."""
    default = F.lit(None).cast("string") if rel is None else rel
    normal = normalize_url if settings.url_normalization_enabled else (lambda u: u)

    def link(n: Column) -> Column:
        href = let(resolve(F.coalesce(n["base"], base), F.coalesce(attribute(n, "href", "url"), F.nullif(n["text"], F.lit("")))), normal)
        return named(href=href, rel=F.coalesce(F.lower(attribute(n, "rel")), default), type=F.lower(attribute(n, "type")), hreflang=F.lower(attribute(n, "hreflang")), title=attribute(n, "title"), length=attribute(n, "length").try_cast("long"))

    return F.filter(F.transform(all_children(nodes, parent, *LINKS), link), lambda x: F.coalesce(x["href"], F.lit("")) != "")


def person(nodes: Column, parent: Column, names: tuple[str, ...], other: Column | None = None) -> Column:
    """The person of the first of these elements; ``other`` names one where neither name nor mail is given."""
    known = lambda name: F.nullif(F.regexp_replace(name, r"(?i)^\(author unknown\)$", ""), F.lit(""))
    rest = [] if other is None else [other]

    def of(node: Column) -> Column:
        parsed = fields.author(F.nullif(node["text"], F.lit("")))
        return let(
            parsed,
            lambda p: named(
                name=known(F.coalesce(first_text(nodes, node["id"], "name"), attribute(node, "name"), p["name"], *[F.when(p["email"].isNull(), o) for o in rest])),
                email=F.coalesce(first_text(nodes, node["id"], "email"), attribute(node, "email"), p["email"]),
                href=F.coalesce(first_text(nodes, node["id"], "url", "uri"), attribute(node, "url", "uri", "href")),
                raw=F.coalesce(p["raw"], *rest),
            ),
        )

    return let(F.get(children(nodes, parent, *names), F.lit(0)), of)


def categories(nodes: Column, parent: Column) -> Column:
    found = children(nodes, parent, "category", "dc:subject")
    return F.transform(found, lambda n: F.struct(F.coalesce(attribute(n, "term"), F.nullif(n["text"], F.lit(""))).alias("term"), attribute(n, "scheme", "domain").alias("scheme"), attribute(n, "label").alias("label")))


def html(nodes: Column, parent: Column, names: tuple[str, ...], atom: Column, base: Column) -> Column:
    """The first text construct of these names: addresses resolved, sanitised, tabs as two blanks."""
    return construct_html(first_node(nodes, parent, *names), atom, base)


def plain(nodes: Column, name: str, *parents: Column) -> Column:
    """Text of an element of an extension at the first parent that has it, sanitised."""
    return plain_html(F.coalesce(*[first_text(nodes, p, name) for p in parents]))


def images(nodes: Column, parent: Column, base: Column, linked: Column) -> Column:
    """Image elements, then links to images."""
    number = lambda n, name: let(F.regexp_extract(first_text(nodes, n["id"], name), r"^(\d+)", 1).try_cast("int"), lambda x: F.when(x > 0, x)).alias(name)
    found = F.filter(nodes, lambda n: (n["parent"] == parent) & n["name"].isin("image", "logo", "imageurl") & ~n["prefix"].isin("itunes", "media"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    shown = F.transform(
        found,
        lambda n: F.struct(
            first_text(nodes, n["id"], "title").alias("title"), first_text(nodes, n["id"], "description").alias("description"),
            let(resolve(F.coalesce(n["base"], base), F.coalesce(first_text(nodes, n["id"], "url"), attribute(n, "rdf:resource", "href", "url"), F.nullif(n["text"], F.lit("")))), normalize_url).alias("href"),
            first_text(nodes, n["id"], "link").alias("link"), number(n, "width"), number(n, "height"), F.lower(F.coalesce(first_text(nodes, n["id"], "style"), attribute(n, "style"))).alias("style"),
        ),
    )
    more = F.transform(F.filter(linked, lambda x: x["type"].startswith("image")), lambda x: F.struct(x["title"].alias("title"), none("string", "description"), x["href"].alias("href"), none("string", "link"), none("int", "width"), none("int", "height"), none("string", "style")))
    return F.filter(F.concat(shown, more), lambda i: F.coalesce(i["href"], F.lit("")) != "")


def licenses(linked: Column) -> Column:
    return F.transform(F.filter(linked, lambda x: x["rel"] == "license"), lambda x: x["href"])


def channels(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Shredded documents with the node that holds the feed's own elements."""
    rows = shredded(docs, xml)
    channel = F.coalesce(F.get(F.filter("nodes", lambda n: (n["depth"] <= 1) & n["name"].isin("channel", "feedinfo", "news")), F.lit(0)), F.get("nodes", F.lit(0)))
    return rows.withColumn("channel", channel)


def _chosen(built: dict, columns: list[str] | None) -> list[Column]:
    """The named columns, all where none are named; others aren't even planned."""
    names = list(built) if columns is None else columns
    if unknown := [c for c in names if c not in built]:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    return [built[c]().alias(c) for c in names]


def encoding_of(docs: DataFrame, xml: str) -> Column:
    """The encoding that a document's answer (``http_headers``, where there are any) or its declaration names, else UTF-8."""
    said = F.element_at("http_headers", "content-type") if "http_headers" in docs.columns else F.lit(None).cast("string")
    return fields.encoding(said, F.regexp_extract(F.col(xml), r"^[^<]*<\?xml[^>]*\?>", 0))


def base_of(nodes: Column, channel: Column) -> Column:
    """A feed's base address: the channel's own, else the root's; that of a redirecting host gives way to the link."""
    named = F.get(children(nodes, channel["id"], "base"), F.lit(0))
    return F.coalesce(attribute(channel, "base"), attribute(named, "href"), F.nullif(named["text"], F.lit("")), channel["base"], F.get(nodes, F.lit(0))["base"])


def _itunes_author(nodes: Column, parent: Column) -> Column:
    return let(first_text(nodes, parent, "itunes:author"), unescape_entities)


def _or_feed(own: str, feed: str) -> Column:
    """The entry's person where it has a name, mail or address, else its feed's."""
    return F.when(F.coalesce(F.col(f"{own}.name"), F.col(f"{own}.email"), F.col(f"{own}.href")).isNotNull(), F.col(own)).otherwise(F.col(feed))


def _explicit(nodes: Column, parent: Column) -> Column:
    return F.coalesce(first_text(nodes, parent, "media:adult", "itunes:explicit").isin("true", "yes"), F.lit(False))


def feeds(docs: DataFrame, xml: str = "xml", key: str = "feed_key", columns: list[str] | None = None, settings: Settings = DEFAULTS, as_of: Column | None = None) -> DataFrame:
    """One typed row per document, with these columns or all.

    With ``as_of`` a feed without a time gets that one (where the settings estimate times).

    ``title``, ``subtitle`` and ``rights`` hold plain text; the columns that
    end in ``_html`` hold the whole construct as sanitised HTML.
    """
    rows = channels(docs, xml)
    n, ch, channel = F.col("nodes"), F.col("channel.id"), F.col("channel")
    kind = fields.feed_type(F.col("root"), F.col("root_ns"))
    known = F.col("href").cast("string") if "href" in docs.columns else F.lit(None).cast("string")
    rows = rows.withColumns({"feed_type": kind, "base_uri": F.coalesce(base_of(n, channel), known), "known_href": known})
    kind, base = F.col("feed_type"), F.col("base_uri")
    atom = F.coalesce(kind == "atom", F.lit(False))
    rows = rows.withColumn("links", links(n, ch, base, F.when(atom, F.lit("alternate")), settings))
    about = normalize_url(attribute(channel, "href", "rdf:about", "about"))
    by_id = let(first_text(n, ch, "id", "guid"), lambda g: F.when(g.startswith("http"), g))
    rows = rows.withColumn("link", F.coalesce(fields.best_link(F.col("links"), F.coalesce(F.col("known_href"), F.lit(""))), about, by_id))
    root = F.get(n, F.lit(0))
    child_ns = F.get(F.filter(n, lambda x: (x["name"] == "channel") & (x["ns"] != "")), F.lit(0))["ns"]
    ns = F.coalesce(F.when(F.col("root_ns").endswith("22-rdf-syntax-ns#"), child_ns).otherwise(F.col("root_ns")), F.lit(""))

    def href() -> Column:
        link = F.col("link")
        own = F.get(F.filter("links", lambda x: (x["rel"] == "self") & (~x["href"].eqNullSafe(link) | x["href"].rlike("xml|atom|feed"))), F.lit(0))["href"]
        named = [*[attribute(F.get(children(n, ch, "admin:feed", "feed"), F.lit(0)), a) for a in ("rdf:resource", "resource")], attribute(channel, "rdf:about", "about"), first_text(n, ch, "newlocation")]
        rest = normalize_url(F.coalesce(*[F.when(c.rlike("^(?i:https?|feed):"), c) for c in named]))
        kept = F.when(F.col("known_href").rlike("^https?:"), F.col("known_href"))
        return F.coalesce(kept, own, let(rest, lambda u: F.when(~u.eqNullSafe(link), u)))

    def icon() -> Column:
        found = F.filter(n, lambda x: (x["parent"] == ch) & (((x["name"] == "link") & (F.lower(attribute(x, "rel")).isin("icon", "shortcut icon") | (attribute(x, "type") == "image/x-icon"))) | (x["name"] == "icon") | ((x["name"] == "logo") & (F.lower(attribute(x, "style")) == "icon"))))
        ref = let(F.get(found, F.lit(0)), lambda first: F.coalesce(attribute(first, "href"), F.nullif(first["text"], F.lit(""))))
        return let(resolve(F.coalesce(channel["base"], base), ref), lambda u: F.when(is_uri(u), u))

    def cloud() -> Column:
        of = lambda c: F.struct(attribute(c, "domain").alias("domain"), attribute(c, "path").alias("path"), F.nullif(attribute(c, "port").try_cast("int"), F.lit(0)).alias("port"), attribute(c, "protocol").alias("protocol"), attribute(c, "registerprocedure").alias("register_procedure"))
        return let(F.get(children(n, ch, "cloud"), F.lit(0)), of)

    def text_input() -> Column:
        return let(F.get(children(n, ch, "textinput"), F.lit(0)), lambda t: F.struct(*[first_text(n, t["id"], c).alias(c) for c in ("title", "description", "link", "name")]))

    def image() -> Column:
        of = lambda i: F.struct(first_text(n, i["id"], "title").alias("title"), F.coalesce(first_text(n, i["id"], "url"), attribute(i, "rdf:resource", "href"), F.nullif(i["text"], F.lit(""))).alias("href"), first_text(n, i["id"], "link").alias("link"))
        return let(F.get(children(n, ch, "image", "logo"), F.lit(0)), of)

    def schedule() -> Column:
        """The sum of a schedule's interval, in seconds."""
        every = let(F.get(children(n, ch, "schedule"), F.lit(0)), lambda x: F.get(children(n, x["id"], "intervaltime"), F.lit(0)))
        return let(every, lambda x: reduce(Column.__add__, [F.coalesce(attribute(x, a).try_cast("long"), F.lit(0)) * k for a, k in (("day", 86400), ("hour", 3600), ("min", 60), ("sec", 1))]))

    def ttl() -> Column:
        period, often = first_text(n, ch, "syn:updateperiod", "updateperiod"), first_text(n, ch, "syn:updatefrequency", "updatefrequency").try_cast("int")
        return fields.time_to_live(period, often, first_text(n, ch, "ttl").try_cast("int"), attribute(F.get(children(n, ch, "ttl"), F.lit(0)), "span"), settings.default_ttl, settings.max_ttl or 2**40, schedule())

    if columns is None or {"href", "favicon"} & set(columns):
        rows = rows.withColumn("own_href", href())
    now = [] if as_of is None or not settings.timestamp_estimation_enabled else [as_of]
    built = {
        key: lambda: F.col(key), "well_formed": lambda: F.col("well_formed"), "feed_type": lambda: kind, "encoding": lambda: encoding_of(docs, xml),
        "feed_version": lambda: fields.feed_version(kind, ns, attribute(root, "version")),
        "id": lambda: first_text(n, ch, "id", "guid"), "href": lambda: F.col("own_href"), "title": lambda: first_text(n, ch, *FEED_TITLE), "subtitle": lambda: first_text(n, ch, *SUBTITLE),
        "title_html": lambda: html(n, ch, FEED_TITLE, atom, base), "subtitle_html": lambda: html(n, ch, SUBTITLE, atom, base),
        "link": lambda: F.col("link"), "links": lambda: F.col("links"), "base_uri": lambda: F.when(base.contains("feedburner"), F.coalesce(F.col("link"), base)).otherwise(base), "icon": icon,
        "favicon": lambda: F.coalesce(favicon(F.col("link")), F.when(F.col("link").isNotNull(), favicon(F.col("own_href")))),
        "author": lambda: person(n, ch, AUTHOR, first_text(n, ch, "itunes:author")), "publisher": lambda: person(n, ch, ("webmaster", "dc:publisher")), "itunes_author": lambda: _itunes_author(n, ch),
        "itunes_summary": lambda: plain(n, "itunes:summary", ch, root["id"]), "itunes_subtitle": lambda: plain(n, "itunes:subtitle", ch, root["id"]), "media_text": lambda: plain(n, "media:text", ch, root["id"]),
        "time": lambda: F.coalesce(let(first_text(n, ch, *TIME), fields.parse_date), *now), "updated": lambda: let(first_text(n, ch, *UPDATED), fields.parse_date), "published": lambda: let(first_text(n, ch, *PUBLISHED_FEED), fields.parse_date),
        "categories": lambda: categories(n, ch), "rights": lambda: first_text(n, ch, *RIGHTS), "rights_html": lambda: html(n, ch, RIGHTS, atom, base),
        "licenses": lambda: licenses(F.col("links")), "license": lambda: F.get(licenses(F.col("links")), F.lit(0)),
        "generator": lambda: first_text(n, ch, "generator"), "docs": lambda: resolve(base, first_text(n, ch, "docs")),
        "language": lambda: fields.language(first_text(n, ch, "language"), first_text(n, ch, "dc:language"), attribute(channel, "xml:lang"), attribute(root, "xml:lang")),
        "time_to_live": ttl, "explicit": lambda: _explicit(n, ch),
        "image": image, "images": lambda: images(n, ch, base, F.col("links")), "cloud": cloud, "text_input": text_input,
    }
    return rows.select(*_chosen(built, columns))


def entries(docs: DataFrame, xml: str = "xml", key: str = "feed_key", columns: list[str] | None = None, settings: Settings = DEFAULTS, as_of: Column | None = None) -> DataFrame:
    """One typed row per entry with its place in the document, with these columns or all.

    An entry carries its own nodes only, so the work is in proportion to a
    document's nodes, and of its feed what it inherits: author and publisher where
    it has none, the base address, the explicit flag, type and version.  Columns that
    end in ``_html`` hold the whole construct as sanitised HTML, the others plain text.
    With ``as_of`` missing times are estimated from the neighbours (where the settings say so).
    A blank title is none; ``title_text`` is that element's text, which may be empty.
    """
    rows = channels(docs, xml)
    n, ch, channel = F.col("nodes"), F.col("channel.id"), F.col("channel")

    def at(parent: Column, *names: str) -> Column:
        return children(n, parent, *names)

    inside = lambda parent: let(at(parent, "items"), lambda held: F.when(F.size(held) > 0, F.filter(n, lambda x: (x["name"] == "item") & F.exists(held, lambda i: i["id"] == x["parent"]))))
    root = F.lit(0)
    sources = [at(ch, "entry"), at(root, "item"), inside(root), at(root, "entry", "story"), at(ch, "item"), inside(ch), at(ch, "story")]
    found = F.coalesce(*map(fields.not_empty, sources))
    own = F.transform(found, lambda x: F.struct(x.alias("item"), F.slice(n, x["id"] + 1, x["last"] - x["id"] + 1).alias("nodes")))
    kind = fields.feed_type(F.col("root"), F.col("root_ns"))
    inherited = {
        "f_base": lambda: F.coalesce(base_of(n, channel), F.col("href") if "href" in docs.columns else F.lit(None).cast("string")),
        "f_author": lambda: person(n, ch, AUTHOR, first_text(n, ch, "itunes:author")), "f_publisher": lambda: person(n, ch, ("webmaster", "dc:publisher")), "f_itunes_author": lambda: _itunes_author(n, ch), "f_explicit": lambda: _explicit(n, ch),
        "f_encoding": lambda: encoding_of(docs, xml),
        "f_version": lambda: fields.feed_version(kind, F.coalesce(F.col("root_ns"), F.lit("")), attribute(F.get(n, F.lit(0)), "version")),
    }
    uses = {"author": "f_author", "publisher": "f_publisher", "itunes_author": "f_itunes_author", "explicit": "f_explicit", "enclosures": "f_explicit", "feed_version": "f_version", "encoding": "f_encoding"}
    needed = ["f_base", *sorted({uses[c] for c in (columns or uses) if c in uses})]
    items = rows.select(key, kind.alias("feed_type"), *[inherited[c]().alias(c) for c in needed], F.posexplode(own).alias("doc_pos", "x")).select(key, "feed_type", *needed, "doc_pos", "x.item", "x.nodes")
    i, item, atom = F.col("item.id"), F.col("item"), F.coalesce(F.col("feed_type") == "atom", F.lit(False))
    base = F.coalesce("item.base", "f_base")
    first_enclosure = normalize_url(F.coalesce(attribute(F.get(children(n, i, "enclosure"), F.lit(0)), "url", "href"), attribute(F.get(children(n, i, "media:content"), F.lit(0)), "url")))
    given = links(n, i, base, settings=settings)
    alone = F.filter(F.array(named(href=first_enclosure, **{c: F.lit(None).cast("string") for c in ("rel", "type", "hreflang", "title")}, length=F.lit(None).cast("long"))), lambda x: x["href"].isNotNull())
    items = items.withColumn("links", let(given, lambda g: F.when(F.size(g) > 0, g).otherwise(alone)))
    duration = lambda: let(first_text(n, i, "itunes:duration"), lambda d: F.when(d.isNotNull(), fields.duration(d)))
    wanted = set(columns or uses) | set(columns or ())
    staged = {"author": {"e_author": lambda: person(n, i, (*AUTHOR, "creator"), first_text(n, i, "itunes:author"))}, "publisher": {"e_publisher": lambda: person(n, i, ("dc:publisher", "webmaster"))}}
    staged["enclosures"] = {"e_categories": lambda: media.itunes_categories(n, i), "e_explicit": lambda: _explicit(n, i) | F.col("f_explicit"), "e_summary": lambda: first_text(n, i, "itunes:summary"), "e_duration": duration}
    items = items.withColumns({name: make() for c, made in staged.items() if c in wanted for name, make in made.items()})
    if "enclosures" in wanted:
        items = items.withColumn("e_enclosures", media.enclosures(n, i, F.col("e_explicit"), F.col("e_summary"), F.col("e_categories")))
    guid = lambda: first_text(n, i, "gr:original-id", "original-id", "id", "guid")

    def link() -> Column:
        about = normalize_url(attribute(item, "href", "rdf:about", "about"))
        return F.coalesce(fields.best_link(F.col("links")), about, let(guid(), lambda g: F.when(g.startswith("http"), g)), comments())

    def comments() -> Column:
        return resolve(base, first_text(n, i, "comments"))

    def title() -> Column:
        t = first_text(n, i, *ITEM_TITLE)
        return F.btrim(F.regexp_replace(t, r"\[\d*\]\s*$", "")) if settings.strip_comment_count else t

    def itunes_image() -> Column:
        other = F.filter(children(n, i, "itunes:link"), lambda x: attribute(x, "rel") == "image")
        return normalize_url(F.coalesce(attribute(F.get(children(n, i, "itunes:image"), F.lit(0)), "href"), attribute(F.get(other, F.lit(0)), "href")))

    def source() -> Column:
        return let(F.get(children(n, i, "source"), F.lit(0)), lambda s: F.struct(attribute(s, "url").alias("href"), F.nullif(s["text"], F.lit("")).alias("title")))

    def author() -> Column:
        return _or_feed("e_author", "f_author")

    def publisher() -> Column:
        return _or_feed("e_publisher", "f_publisher")

    def time() -> Column:
        """Its date, else that of a title that is one."""
        stated = first_text(n, i, *TIME, "lastupdated")
        by_title = fields.parse_date(F.when(stated.isNull() & title().rlike(r"\d"), title())) if settings.timestamp_estimation_enabled else F.lit(None).cast("timestamp")
        return F.coalesce(fields.parse_date(stated), by_title)

    def enclosures() -> Column:
        """A sole enclosure without a duration has the entry's."""
        es = F.col("e_enclosures")
        return F.when(F.size(es) == 1, F.transform(es, lambda e: e.withField("duration", F.coalesce(e["duration"], F.col("e_duration"))))).otherwise(es)

    def tags() -> Column:
        words = lambda nodes: F.filter(F.transform(nodes, lambda x: x["text"]), lambda t: t != "")
        below = lambda lis, name: F.filter(lis, lambda x: F.exists(n, lambda a: (a["name"] == name) & (a["id"] < x["id"]) & (x["id"] <= a["last"])))
        resource = lambda lis: F.filter(F.transform(below(lis, "topics"), lambda x: F.regexp_extract(attribute(x, "resource", "rdf:resource"), r"/tags?/(\w+)$", 1)), lambda t: t != "")
        listed = let(F.filter(n, lambda x: (x["name"] == "li") & (x["depth"] == item["depth"] + 3)), lambda lis: F.when(F.size(lis) > 0, F.coalesce(fields.not_empty(words(below(lis, "subject"))), resource(lis))))
        named = F.filter(F.transform(children(n, i, "category"), lambda x: F.coalesce(F.nullif(x["text"], F.lit("")), attribute(x, "term"))), lambda t: t.isNotNull())
        return fields.tags(listed, named, words(children(n, i, "dc:subject")), fields.keywords(first_text(n, i, "itunes:keywords")))

    extra = ("media:text", "itunes:summary", "itunes:subtitle")
    built = {
        key: lambda: F.col(key), "doc_pos": lambda: F.col("doc_pos"), "id": guid, "title": title, "title_text": lambda: F.get(children(n, i, *ITEM_TITLE), F.lit(0))["text"],
        "content": lambda: first_text(n, i, *CONTENT, *extra), "summary": lambda: first_text(n, i, *SUMMARY, *extra),
        "title_html": lambda: html(n, i, ITEM_TITLE, atom, base), "content_html": lambda: html(n, i, (*CONTENT, *extra), atom, base), "summary_html": lambda: html(n, i, (*SUMMARY, *extra), atom, base),
        "links": lambda: F.col("links"), "link": link, "comments": comments, "base_uri": lambda: base, "feed_type": lambda: F.col("feed_type"), "feed_version": lambda: F.col("f_version"), "encoding": lambda: F.col("f_encoding"),
        "author": author, "publisher": publisher, "itunes_author": lambda: F.coalesce(_itunes_author(n, i), "f_itunes_author"),
        "itunes_summary": lambda: plain(n, "itunes:summary", i), "itunes_subtitle": lambda: plain(n, "itunes:subtitle", i), "media_text": lambda: plain(n, "media:text", i),
        "categories": lambda: categories(n, i),
        "time": time, "updated": lambda: let(first_text(n, i, *UPDATED, "lastupdated"), fields.parse_date), "published": lambda: let(first_text(n, i, *PUBLISHED_ITEM), fields.parse_date),
        "images": lambda: images(n, i, base, F.col("links")), "itunes_image_link": itunes_image, "media_thumbnail_link": lambda: normalize_url(attribute(F.get(children(n, i, "media:thumbnail"), F.lit(0)), "url")),
        "rights": lambda: first_text(n, i, *RIGHTS), "rights_html": lambda: html(n, i, RIGHTS, atom, base), "licenses": lambda: licenses(F.col("links")), "license": lambda: F.get(licenses(F.col("links")), F.lit(0)), "source": source,
        "enclosures": enclosures,
        "itunes_duration": duration, "tags": tags, "explicit": lambda: _explicit(n, i) | F.col("f_explicit"),
    }
    out = items.select(*_chosen(built, columns))
    if as_of is not None and settings.timestamp_estimation_enabled and {key, "doc_pos", "time"} <= set(out.columns):
        out = estimate_in_documents(out, as_of, key)
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of any encoding: feed_key (path), xml."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.regexp_extract(F.decode("content", "ISO-8859-1"), r"^[^>]*>", 0)  # an XML declaration, however long
    return raw.select(F.col("path").alias("feed_key"), decode_bytes("content", fields.encoding(F.lit(None).cast("string"), head)).alias("xml"))


def esc(c: Column) -> Column:
    """Text as markup; a carriage return by its number, as parsers read a bare one as a line feed."""
    return F.replace(escape_entities(c), F.lit("\r"), F.lit("&#13;"))


def _tag(name: str, c: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"<{name}>"), esc(c), F.lit(f"</{name}>")), F.lit(""))


def _stamp(c: Column, rfc: bool) -> Column:
    return F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss 'GMT'") if rfc else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


NAMESPACES = "".join(f' xmlns:{p}="{PREFIXES[p]}"' for p in ("content", "dc", "itunes", "media"))


def _empty(tag: str, **attributes: Column) -> Column:
    """An element without content; null where any attribute is."""
    return F.coalesce(F.concat(F.lit(f"<{tag}"), *[F.concat(F.lit(f' {k.replace("__", ":")}="'), esc(v), F.lit('"')) for k, v in attributes.items()], F.lit("/>")), F.lit(""))


def _repeat(values: Column, make) -> Column:
    return F.coalesce(F.array_join(F.transform(values, make), ""), F.lit(""))


def _cdata(name: str, c: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"<{name}><![CDATA["), F.replace(F.replace(c, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("\r"), F.lit("]]>&#13;<![CDATA[")), F.lit(f"]]></{name}>")), F.lit(""))


def _enclosure_xml(e: Column, atom: bool, versions: bool = False) -> Column:
    """An enclosure; RSS needs its size: where it has none, its first version with one stands for it, else a note."""
    if versions and not atom:
        of = lambda x: named(href=x["href"], type=x["type"], file_size=x["file_size"])
        return let(with_size(F.concat(F.array(of(e)), F.coalesce(F.transform(e["versions"], of), F.array().cast("array<struct<href:string,type:string,file_size:bigint>>")))), lambda x: _enclosure_xml(x, False))
    kind, size = F.coalesce(F.concat(F.lit(' type="'), esc(e["type"]), F.lit('"')), F.lit("")), F.concat(F.lit(' length="'), e["file_size"].cast("string"), F.lit('"'))
    if atom:
        return F.when(e["href"].isNotNull(), F.concat(F.lit('<link rel="enclosure" href="'), esc(e["href"]), F.lit('"'), kind, F.coalesce(size, F.lit("")), F.lit("/>")))
    whole = F.concat(F.lit('<enclosure url="'), esc(e["href"]), F.lit('"'), kind, size, F.lit("/>"))
    return F.when(e["href"].isNotNull(), F.coalesce(F.when(e["file_size"] > 0, whole), F.lit("<!-- an enclosure without a size is left out -->")))


def _best_image(images_: Column) -> Column:
    """The first image with a link, else the first."""
    return F.coalesce(F.get(F.filter(images_, lambda x: x["link"].isNotNull()), F.lit(0)), F.get(images_, F.lit(0)))


@dataclass
class Written:
    """A feed in parts: its entries' markup (key, doc_pos, item, place, t), and of its own the columns before and after the entries' places and at the end."""

    items: DataFrame
    heads: DataFrame
    front: Column
    rest: Column
    back: Column


def written(
    heads: DataFrame, items: DataFrame, kind: str = "rss", version: float | None = None, key: str = "feed_key", denied: Column | None = None, denied_entries: Column | None = None,
    settings: Settings = DEFAULTS, feed_hook: Column | None = None, entry_hook: Column | None = None,
) -> Written:
    """The parts of which ``write_xml``, ``write_items`` and ``save_feeds`` make documents; ``heads`` may have ``newest``, its entries' last time."""
    version = version or {"rss": 2.0, "atom": 1.0}.get(kind)
    if kind not in ("rss", "atom") or (kind == "atom" and version != 1.0):
        raise ValueError(f"{kind} {version} can't be written")
    if denied is not None:
        heads = heads.withColumn("title", F.when(denied, F.raise_error(F.lit("this feed may not be redistributed"))).otherwise(F.col("title")))
    if denied_entries is not None:
        items = items.withColumn("title", F.when(denied_entries, F.raise_error(F.lit("this entry may not be redistributed"))).otherwise(F.col("title")))
    old, atom = kind == "rss" and version in (0.9, 1.0, 1.1), kind == "atom"
    nothing = F.lit("")

    def given(df: DataFrame, name: str, make, otherwise: Column = nothing) -> Column:
        return make(F.col(name)) if name in df.columns else otherwise

    def stamped(df: DataFrame, tag: str, *names: str) -> Column:
        times = [F.col(c) for c in names if c in df.columns]
        return _tag(tag, _stamp(F.coalesce(*times), rfc=not atom and not old)) if times else nothing

    def person_xml(p: Column) -> Column:
        name = F.coalesce(p["name"], F.lit("n/a"))
        return F.concat(F.lit("<author>"), _tag("name", name), _tag("email", p["email"]), _tag("uri", p["href"]), F.lit("</author>"))

    both = "summary" in items.columns
    told = F.coalesce("summary", "content") if both else F.col("content")
    link_item, subject = (_empty("link", rel=F.lit("alternate"), href=F.col("link")) if atom else _tag("link", F.col("link"))), ("dc:subject" if old else "category")
    tags = given(items, "tags", lambda c: _repeat(c, (lambda t: _empty("category", term=t)) if atom else (lambda t: _tag(subject, t))))
    podcast = F.exists("enclosures", lambda e: fields.is_audio(e["type"], e["href"])) if "enclosures" in items.columns else F.lit(False)
    spoken = given(items, "tags", lambda c: F.when(podcast & (F.size(c) > 0), _tag("itunes:keywords", F.array_join(c, ", "))).otherwise(""))
    parcel = items.schema["enclosures"].dataType.elementType if "enclosures" in items.columns else StructType()
    versions = "versions" in parcel.names and isinstance(parcel["versions"].dataType.elementType, StructType)
    parcels = given(items, "enclosures", lambda c: _repeat(c, lambda e: _enclosure_xml(e, atom, versions)))
    if atom:
        content = F.coalesce(F.concat(F.lit('<content type="html">'), esc(F.col("content")), F.lit("</content>")), nothing)
        summary = given(items, "summary", lambda c: F.coalesce(F.concat(F.lit('<summary type="html">'), esc(c), F.lit("</summary>")), nothing))
        body = [_tag("id", F.col("id")), _tag("title", F.col("title")), given(items, "author", person_xml), link_item, content, summary, stamped(items, "updated", "updated", "time"), stamped(items, "published", "published"), given(items, "rights", lambda c: _tag("rights", c)), tags, parcels]
        front, back, open_item, close_item = '<feed xmlns="http://www.w3.org/2005/Atom"', "</feed>", F.lit("<entry>"), F.lit("</entry>")
    else:
        writer = given(items, "author", lambda p: F.concat(_tag("dc:creator", p["name"]), nothing if old else _tag("author", F.concat(p["email"], F.lit(" ("), p["name"], F.lit(")")))))
        guid = F.when(F.col("id").rlike("^https?:"), _tag("guid", F.col("id"))).otherwise(F.replace(_tag("guid", F.col("id")), F.lit("<guid>"), F.lit('<guid isPermaLink="false">')))
        whole = _cdata("content:encoded", F.col("content")) if both else nothing
        body = [_tag("title", F.col("title")), link_item, _tag("guid", F.col("id")) if old else guid, writer, _tag("description", told), whole, stamped(items, "dc:date" if old else "pubDate", *(("time",) if old else ("published", "time"))), given(items, "rights", lambda c: _tag("dc:rights", c)), given(items, "comments", lambda c: nothing if old else _tag("comments", c)), tags, spoken, nothing if old else parcels]
        about = F.coalesce(F.col("link"), F.col("id"), nothing)
        open_item, close_item = F.concat(F.lit('<item rdf:about="'), esc(about), F.lit('">')) if old else F.lit("<item>"), F.lit("</item>")
        rdf = f' xmlns:rdf="{PREFIXES["rdf"]}" xmlns:syn="{PREFIXES["syn"]}" xmlns:admin="{PREFIXES["admin"]}"' if old else ""
        front, back = (f'<rdf:RDF xmlns="http://purl.org/rss/1.0/"{rdf}{NAMESPACES}><channel', "</rdf:RDF>") if old else (f'<rss version="2.0"{NAMESPACES}><channel>', "</channel></rss>")
    item = F.concat(open_item, *body, F.coalesce(entry_hook, nothing) if entry_hook is not None else nothing, close_item)
    place = _empty("rdf:li", rdf__resource=F.coalesce(F.col("link"), F.col("id"), nothing)) if old else nothing
    written = items.select(key, "doc_pos", item.alias("item"), place.alias("place"), F.col("time").alias("t"))
    hook = F.coalesce(feed_hook, nothing) if feed_hook is not None else nothing
    image = given(heads, "images", lambda c: let(_best_image(c), lambda b: F.when(b["href"].isNotNull(), F.concat(F.lit('<image rdf:about="') if old else F.lit("<image"), esc(b["href"]) if old else nothing, F.lit('">') if old else F.lit(">"), _tag("title", F.coalesce(b["title"], F.col("title"))), _tag("url", b["href"]), _tag("link", F.coalesce(b["link"], F.col("link"))), F.lit("</image>"))).otherwise("")))
    rest: list[Column] = []
    maker = _tag("generator", F.lit(settings.generator_href or settings.generator_name))
    if atom:
        lang = given(heads, "language", lambda c: F.coalesce(F.concat(F.lit(' xml:lang="'), esc(c), F.lit('"')), nothing))
        name = F.coalesce(F.col("id"), uri.urn_uuid(F.col("link"))) if "id" in heads.columns else uri.urn_uuid(F.col("link"))
        times = [F.col(c) for c in ("updated", "time") if c in heads.columns]
        head = [lang, F.lit(">"), _tag("id", name), _tag("title", F.col("title")), given(heads, "author", person_xml, F.lit("<author><name>n/a</name></author>")), given(heads, "href", lambda c: _empty("link", rel=F.lit("self"), type=F.lit("application/atom+xml"), href=c)), F.coalesce(F.concat(F.lit('<link href="'), esc(F.col("link")), F.lit('"/>')), nothing), _tag("subtitle", F.col("subtitle")), _tag("updated", _stamp(F.coalesce(*times, F.col("newest")), rfc=False)), given(heads, "rights", lambda c: _tag("rights", c)), maker, hook]
    elif old:
        pace = given(heads, "time_to_live", lambda c: F.concat(F.lit("<syn:updatePeriod>hourly</syn:updatePeriod>"), _tag("syn:updateFrequency", F.greatest(F.floor(c / 3600), F.lit(1)).cast("string"))))
        about = F.coalesce(F.concat(F.lit(' rdf:about="'), esc(F.col("link")), F.lit('">')), F.lit(">"))
        picture = given(heads, "images", lambda c: _empty("image", rdf__resource=_best_image(c)["href"]))
        head = [about, _tag("title", F.col("title")), _tag("link", F.col("link")), picture, _tag("description", F.col("subtitle")), given(heads, "language", lambda c: _tag("dc:language", c)), given(heads, "rights", lambda c: _tag("dc:rights", c)), pace, F.lit("<items><rdf:Seq>")]
        rest = [F.lit("</rdf:Seq></items>"), _empty("admin:generatorAgent", rdf__resource=F.lit(settings.generator_href).cast("string")), hook, F.lit("</channel>"), image]
    else:
        ttl = given(heads, "time_to_live", lambda c: _tag("ttl", F.floor(c / 60).cast("string")))
        head = [_tag("title", F.col("title")), _tag("link", F.col("link")), _tag("description", F.col("subtitle")), given(heads, "author", lambda p: _tag("managingEditor", p["email"])), given(heads, "publisher", lambda p: _tag("webMaster", p["email"])), stamped(heads, "pubDate", "published"), stamped(heads, "lastBuildDate", "updated"), given(heads, "rights", lambda c: _tag("copyright", c)), given(heads, "language", lambda c: _tag("language", c)), ttl, maker, image, hook]
    return Written(written, heads, F.concat(F.lit(front), *head), F.concat(*rest) if rest else nothing, F.lit(back))


def write_xml(heads: DataFrame, items: DataFrame, kind: str = "rss", version: float | None = None, key: str = "feed_key", **more) -> DataFrame:
    """Feeds (key, title, link, subtitle) and their entries (doc_pos, id, title, link, content, time) as documents, one string a feed.

    Formats: rss 1.0, rss 2.0, atom 1.0.  ``denied`` feeds and ``denied_entries`` may not be redistributed and raise.
    Of the columns of ``feeds`` and ``entries`` these are written where they are given: of feeds id, href, author,
    publisher, language, rights, time_to_live, updated, published, images; of entries author, summary, updated, published, rights,
    comments, tags, enclosures.  ``feed_hook`` and ``entry_hook`` are columns of markup that end a feed's own part and each entry.
    """
    parts = written(heads, items, kind, version, key, **more)
    x = F.struct("doc_pos", "item", "place")
    rows = parts.items.groupBy(key).agg(F.array_sort(F.collect_list(x)).alias("xs"), F.max("t").alias("newest"))
    rows = rows.select(key, "newest", F.array_join(F.transform("xs", lambda y: y["item"]), "").alias("items"), F.array_join(F.transform("xs", lambda y: y["place"]), "").alias("places"))
    out = parts.heads.join(rows.hint("merge"), key, "left")  # whole documents are never broadcast
    nothing = F.lit("")
    return out.select(key, F.concat(parts.front, F.coalesce("places", nothing), parts.rest, F.coalesce("items", nothing), parts.back).alias("xml"))


def write_items(items: DataFrame, kind: str = "rss", version: float | None = None, key: str = "feed_key", **more) -> DataFrame:
    """Entries as markup by themselves: key, doc_pos, xml."""
    none = items.sparkSession.createDataFrame([], "title string, link string, subtitle string")
    return written(none, items, kind, version, key, **more).items.select(key, "doc_pos", F.col("item").alias("xml"))


ATOM = "http://www.w3.org/2005/Atom"
FILES = pa.schema({"file": pa.string(), "xml": pa.string()})


def save_feeds(
    heads: DataFrame, items: DataFrame, path: str, kind: str = "rss", version: float | None = None, key: str = "feed_key", page: int | None = None, mode: str = "append", feed_hook: Column | None = None, **more,
) -> None:
    """Feeds as files of a folder, as ``write_xml`` writes them, with entries streamed in order: no feed is ever one row.

    With ``page`` a feed is cut into documents of that many entries, which name each other (RFC 5005: ``next``,
    ``previous``) and are written by different tasks; without it one task writes a feed, entry by entry.
    ``read_saved`` reads them back.
    """
    register(heads.sparkSession)
    entry = items.join(heads.select(key), key, "left_semi")
    if page:
        entry = places(entry, key, [F.col("doc_pos")], "__place").withColumn("__page", F.floor((F.col("__place") - 1) / page)).drop("__place")
    else:
        entry = entry.withColumn("__page", F.lit(0).cast("long"))
    about = entry.groupBy(key, "__page").agg(F.max("time").alias("newest"))
    last = about.groupBy(key).agg(F.max("__page").alias("__last"))
    tops = heads.join(about.join(last, key), key, "left").withColumns({"__page": F.coalesce("__page", F.lit(0).cast("long")), "__last": F.coalesce("__last", F.lit(0).cast("long"))})
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    numbered = lambda n: F.concat(name, F.lit("-"), F.lpad((n + 1).cast("string"), 6, "0"))
    hook = F.coalesce(feed_hook, F.lit("")) if feed_hook is not None else F.lit("")
    if page and version not in (0.9, 1.0, 1.1):
        tag = "link" if kind == "atom" else "atom:link"
        space = {} if kind == "atom" else {"xmlns__atom": F.lit(ATOM)}
        to = lambda rel, n: _empty(tag, **space, rel=F.lit(rel), href=F.concat(numbered(n), F.lit(".xml")))
        hook = F.concat(hook, F.when(F.col("__page") > 0, to("previous", F.col("__page") - 1)).otherwise(""), F.when(F.col("__page") < F.col("__last"), to("next", F.col("__page") + 1)).otherwise(""))
    parts = written(tops, entry.withColumn("feed_page", F.struct(F.col(key).alias("k"), F.col("__page").alias("p"))), kind, version, "feed_page", feed_hook=hook, **more)
    name_of = lambda k, p: F.concat(F.coalesce(k.cast("string"), F.lit("")), F.concat(F.lit("-"), F.lpad((p + 1).cast("string"), 6, "0")) if page else F.lit(""))
    settings = more.get("settings", DEFAULTS)
    declared = F.lit(f'<?xml version="1.0" encoding="{settings.output_encoding}"?>' if settings.output_encoding.lower() not in ("utf-8", "utf8") else "")
    own = F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.lit(None).cast("long").alias("doc_pos"), c.alias("text")) for n, c in ((0, F.concat(declared, parts.front)), (2, parts.rest), (4, parts.back))]))
    pieces = parts.heads.select(name_of(F.col(key), F.col("__page")).alias("name"), own.alias("x")).select("name", "x.*")
    theirs = F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.col("doc_pos").cast("long").alias("doc_pos"), F.col(c).alias("text")) for n, c in ((1, "place"), (3, "item"))]))
    pieces = pieces.unionByName(parts.items.select(name_of(F.col("feed_page.k"), F.col("feed_page.p")).alias("name"), theirs.alias("x")).select("name", "x.*")).filter("text <> ''")
    ordered = pieces.repartition(range_partitions(items), "name").sortWithinPartitions("name", "section", "doc_pos")
    ordered.select("name", "text").write.format("feed").option("encoding", settings.output_encoding).mode(mode).save(path)


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """The documents that ``save_feeds`` wrote: feed_key, page (from 1; null without pages), xml.

    The driver lists the folders of the tasks that wrote them; a task lists and reads the files of one.
    """
    found = Folder(path).names()
    folders = [f for f in found if f.startswith("part-")]
    if not folders and "_SUCCESS" not in found:
        raise FileNotFoundError(f"no saved feeds in {path}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = Folder(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                names, texts, held = [], [], 0
                for name in root.names(folders[k]):
                    names.append(name)
                    texts.append(decoded(root.read(folders[k], name), None))
                    held += len(texts[-1])
                    if held >= CHARS_HELD:
                        yield pa.RecordBatch.from_pydict({"file": names, "xml": texts}, FILES)
                        names, texts, held = [], [], 0
                yield pa.RecordBatch.from_pydict({"file": names, "xml": texts}, FILES)

    files = spark.range(0, len(folders), 1, max(1, len(folders))).mapInArrow(read, "file string, xml string")
    number = F.regexp_extract("name", r"-(\d{6,})$", 1)
    files = files.select(F.url_decode(F.regexp_extract("file", r"^(.+)\.xml$", 1)).alias("name"), "xml")
    return files.select(F.regexp_replace("name", r"-\d{6,}$", "").alias("feed_key"), F.when(number != "", number).cast("int").alias("page"), "xml")


def drop_saved(spark: SparkSession, path: str) -> None:
    """Delete saved feeds, each task those of one folder; they can't be read afterwards."""
    folders = [f for f in Folder(path).names() if f.startswith("part-")]

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = Folder(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                root.drop(folders[k])
            yield batch

    spark.range(0, len(folders), 1, max(1, len(folders))).mapInArrow(drop, "id long").foreach(lambda row: None)
    root = Folder(path)
    root.fs.delete_dir(root.root)


def autodiscover(page: Column) -> Column:
    """The address of the first feed that a page names: Atom, then RSS, then RDF."""
    tags = F.regexp_extract_all(page, F.lit("(?is)<link\\b[^>]*>"), F.lit(0))

    def of(mime: str) -> Column:
        hits = F.filter(tags, lambda t: t.rlike(rf"(?i)type\s*=\s*[\"']?{mime}") & t.rlike(r"(?i)rel\s*=\s*[\"']?alternate"))
        return F.nullif(F.regexp_extract(F.get(hits, F.lit(0)), r"(?i)href\s*=\s*[\"']([^\"']*)", 1), F.lit(""))

    return F.coalesce(*[of(m) for m in (r"application/atom\+xml", r"application/rss\+xml", r"application/rdf\+xml")])


