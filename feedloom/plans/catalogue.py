"""Registered queries of the engine and the SQL they are held against."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.config import DEFAULTS
from feedloom.functions import fields, sql, text, uri, xpath
from feedloom.operators import enclosures, relate
from feedloom.sources import feeds as xml_feeds
from feedloom.sources import media, shred
from feedloom.sources.tables import range_partitions, table
from feedloom.streaming import streams

QUERIES, SQL = {}, {}
AS_OF = "2024-06-01 00:00:00"
DOC_ENTRIES = """(SELECT source AS feed_key, doc_id AS guid, substr(text, 1, 40) AS title, text AS content, lang, doc_id AS doc_pos,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1704067200 + doc_id * 60 END AS t FROM documents)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def doc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries of the feed that is their source; every seventh lacks its time."""
    d = table(spark, sf_dir, "documents")
    time = F.when(F.col("doc_id") % 7 != 0, F.timestamp_seconds(1704067200 + F.col("doc_id") * 60))
    return d.select(F.col("source").alias("feed_key"), F.col("doc_id").alias("guid"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"), "lang", F.col("doc_id").alias("doc_pos"), time.alias("time"))


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def digest(c):
    return F.md5(F.encode(c, "UTF-8"))


# --- text -------------------------------------------------------------------------------------------


@query("SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, regexp_replace(html, '</?[^>]+>', '', 'g') AS t FROM pages)")
def q_html_strip_tags(spark, sf_dir):
    t = text.strip_tags(F.col("html"))
    return pages(spark, sf_dir).select("page_id", F.length(t).alias("n"), digest(t).alias("digest"))


ESCAPE = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
UNESCAPE = "replace(replace(replace(replace(replace(replace(replace({0}, '&#38;', '&amp;'), '&#x26;', '&amp;'), '&amp;', '&'), '&quot;', '\"'), '&gt;', '>'), '&lt;', '<'), '&apos;', '''')"


@query(f"SELECT page_id, md5({ESCAPE.format('html')}) AS digest FROM pages")
def q_html_escape(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", digest(text.escape_entities(F.col("html"))).alias("digest"))


@query(f"SELECT page_id, md5({UNESCAPE.format('html')}) AS digest FROM pages")
def q_html_unescape_named(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", digest(text.unescape_named(F.col("html"))).alias("digest"))


PLAIN = "regexp_replace(html, '</?[^>]+>', '', 'g')"


@query(f"SELECT page_id, md5(replace(replace(replace(replace({UNESCAPE.format(PLAIN)}, '&#8216;', ''''), '&#8217;', ''''), '&#8220;', '\"'), '&#8221;', '\"')) AS digest FROM pages")
def q_html_plain_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", digest(text.plain_text(F.col("html"))).alias("digest"))


@query("SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: '  ' || x), chr(10)) || chr(10)) AS digest FROM documents")
def q_indent(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", digest(text.indent(F.col("text"))).alias("digest"))


KIND = "(CASE page_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'html' WHEN 2 THEN 'xhtml' WHEN 3 THEN NULL ELSE 'application/x' END)"


@query(f"""SELECT page_id, md5(replace(CASE WHEN k = 'xhtml' THEN html WHEN k = 'html' THEN {UNESCAPE.format('html')} WHEN k = 'text' OR k IS NULL THEN {ESCAPE.format(UNESCAPE.format('html'))} ELSE html END, chr(9), '  ')) AS digest
FROM (SELECT page_id, html, {KIND} AS k FROM pages) WHERE trim(html) <> ''""")
def q_text_construct(spark, sf_dir):
    p = pages(spark, sf_dir).withColumn("k", F.expr(KIND))
    t = text.text_construct(F.col("k"), F.lit("xml"), F.col("html"))
    return p.select("page_id", digest(t).alias("digest")).filter("digest IS NOT NULL")


# --- addresses --------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') AS url_is_uri, FALSE AS bare_is_uri FROM pages")
def q_is_uri(spark, sf_dir):
    bare = F.regexp_replace("url", "^[a-z]+:", "")
    return pages(spark, sf_dir).select("page_id", uri.is_uri(F.col("url")).alias("url_is_uri"), uri.is_uri(bare).alias("bare_is_uri"))


@query("SELECT page_id, k, CASE WHEN regexp_matches(u, '^https?://[^/?#]+$') THEN u || '/' ELSE u END AS url FROM (SELECT page_id, k, 'http://' || regexp_replace(url, '^https?://', '') AS u FROM pages, unnest(['feed:', 'rss:', 'htp:', '//', '']) AS x(k))")
def q_url_scheme_fix(spark, sf_dir):
    bare = F.regexp_replace("url", "^https?://", "")
    rows = pages(spark, sf_dir).select("page_id", bare.alias("bare"), F.explode(F.array(*map(F.lit, ["feed:", "rss:", "htp:", "//", ""]))).alias("k"))
    mark = F.when(F.col("k").isin("//", ""), F.col("k")).otherwise(F.concat("k", F.lit("//")))
    return rows.select("page_id", "k", uri.normalize_url(F.concat(mark, "bare")).alias("url"))


@query("""SELECT page_id, 'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab89ab89ab89ab', 1 + ('0x' || h[17:17])::INT, 1) || h[18:20] || '-' || h[21:32] AS urn
FROM (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)""")
def q_urn_uuid(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", uri.urn_uuid(F.col("url")).alias("urn"))


HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"


@query(f"SELECT page_id, 'tag:' || {HOST} || ',2024-02-03:' || replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?]*)', 1), '#', '/') AS tag FROM pages")
def q_tag_uri(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", uri.tag_uri(F.col("url"), F.lit("2024-02-03")).alias("tag"))


@query(f"SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN 'http://' || {HOST} || '/favicon.ico' END AS favicon FROM pages")
def q_favicon(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", uri.favicon(F.col("url")).alias("favicon"))


def page_links(spark, sf_dir):
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return pages(spark, sf_dir).select("page_id", "url", F.posexplode(hrefs).alias("pos", "href"))


LINKS = """(SELECT page_id, url, unnest(range(len(h))) AS pos, unnest(h) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages))"""


@query(f"SELECT page_id, pos::INT AS pos, href FROM {LINKS}")
def q_page_links(spark, sf_dir):
    return page_links(spark, sf_dir).select("page_id", "pos", "href")


@query(f"""SELECT page_id, pos::INT AS pos, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || href
ELSE regexp_replace(CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '://[^/]+$') THEN url || '/' ELSE regexp_replace(url, '[?#].*$', '') END, '[^/]*$', '') || href END AS href FROM {LINKS}""")
def q_page_links_resolved(spark, sf_dir):
    return page_links(spark, sf_dir).select("page_id", "pos", uri.resolve(F.col("url"), F.col("href")).alias("href"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/a.xml' WHEN 1 THEN '/r.xml' WHEN 2 THEN '/d.rdf' END AS feed FROM pages""")
def q_autodiscover(spark, sf_dir):
    link = lambda mime, href: f'<link rel="alternate" type="application/{mime}" href="{href}">'
    r, k = link("rss+xml", "/r.xml"), F.col("page_id") % 4
    head = F.when(k == 0, r + link("atom+xml", "/a.xml")).when(k == 1, link("rdf+xml", "/d.rdf") + r).when(k == 2, link("rdf+xml", "/d.rdf")).otherwise('<link rel="stylesheet" type="application/rss+xml" href="/x">')
    return pages(spark, sf_dir).select("page_id", xml_feeds.autodiscover(F.concat(head, "html")).alias("feed"))


# --- fields -----------------------------------------------------------------------------------------

MIMES = "['text/html', 'xhtml', 'application/xhtml+xml', 'application/atom+xml', 'xml', 'text/plain', 'audio/mpeg', 'video/mp4', 'image/png', '']"
MIME_LIST = [x.strip()[1:-1] for x in MIMES[1:-1].split(",")]


def event_entries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mime = F.element_at(F.array(*map(F.lit, MIME_LIST)), (F.col("event_id") % len(MIME_LIST) + 1).cast("int"))
    return e.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), mime.alias("mime"))


EVENTS = f"(SELECT event_id, user_id, event_type, value, ts, ({MIMES})[event_id % 10 + 1] AS mime FROM events)"


@query(f"SELECT event_id, mime IN ('html','xhtml','text/html','application/xhtml+xml') AS html, mime IN ('xml','xhtml','application/xhtml+xml') OR ends_with(mime, 'xml') AS xml FROM {EVENTS}")
def q_mime_class(spark, sf_dir):
    m = F.col("mime")
    return event_entries(spark, sf_dir).select("event_id", fields.is_html(m).alias("html"), fields.is_xml(m).alias("xml"))


@query(f"SELECT user_id, bool_or(starts_with(mime, 'audio/')) AS podcast, bool_or(starts_with(mime, 'video/')) AS vidlog, count(*) AS entries FROM {EVENTS} GROUP BY user_id")
def q_media_kind(spark, sf_dir):
    none = F.lit(None).cast("string")
    return event_entries(spark, sf_dir).groupBy("user_id").agg(F.bool_or(fields.is_audio(F.col("mime"), none)).alias("podcast"), F.bool_or(fields.is_video(F.col("mime"), none)).alias("vidlog"), F.count("*").alias("entries"))


RELS = "(CASE event_id % 3 WHEN 0 THEN 'alternate' WHEN 1 THEN 'self' ELSE 'enclosure' END)"
BASE_SCORE = "(CASE WHEN mime IN ('xml','xhtml','application/xhtml+xml') OR ends_with(mime, 'xml') THEN 1 ELSE 0 END + CASE WHEN mime IN ('html','xhtml','text/html','application/xhtml+xml') THEN 2 WHEN mime <> '' THEN -1 ELSE 0 END + CASE rel WHEN 'alternate' THEN 1 WHEN 'self' THEN -1 ELSE 0 END)"


def _links(spark, sf_dir):
    """Events of a user as the links of a feed, in order of their number."""
    e = event_entries(spark, sf_dir).withColumn("rel", F.expr(RELS))
    e = e.withColumns({"href": F.concat(F.lit("http://h/"), "event_type", F.lit("/"), "event_id"), "key": F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 500))})
    return e.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "mime", "rel", "href"))), lambda x: F.struct(x["mime"].alias("type"), x["rel"].alias("rel"), x["href"].alias("href"))).alias("links"))


LINK_ROWS = f"(SELECT *, {RELS} AS rel, 'http://h/' || event_type || '/' || event_id AS href, user_id || '-' || (event_id // 500) AS key FROM {EVENTS})"


@query(f"""SELECT key, first(href ORDER BY s DESC, event_id) FILTER (s >= 0) AS link FROM (SELECT *, {BASE_SCORE} + CASE WHEN contains(mime, 'image') OR contains(mime, 'video') THEN -2 ELSE 0 END + CASE WHEN rel = 'enclosure' THEN -2 ELSE 0 END
+ CASE WHEN rel = 'self' AND (contains(href, 'xml') OR contains(href, 'atom') OR contains(href, 'feed')) THEN -1 ELSE 0 END AS s FROM {LINK_ROWS}) GROUP BY key""")
def q_link_score(spark, sf_dir):
    return _links(spark, sf_dir).select("key", fields.best_link(F.col("links"), F.lit("")).alias("link"))


@query(f"SELECT key, first(href ORDER BY s DESC, event_id) FILTER (s >= 0) AS link FROM (SELECT *, {BASE_SCORE} + CASE WHEN count(*) OVER (PARTITION BY key) = 1 AND regexp_matches(mime, '^(video|audio)') THEN 1 ELSE 0 END AS s FROM {LINK_ROWS}) GROUP BY key")
def q_item_link_score(spark, sf_dir):
    return _links(spark, sf_dir).select("key", fields.best_link(F.col("links")).alias("link"))


@query("SELECT c_custkey, c_custkey % 4 AS form, CASE c_custkey % 4 WHEN 2 THEN NULL ELSE c_name END AS name, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE 'c' || c_custkey || '@example.com' END AS email FROM customer")
def q_author_parse(spark, sf_dir):
    mail, name, k = F.concat(F.lit("c"), "c_custkey", F.lit("@example.com")), F.col("c_name"), F.col("c_custkey") % 4
    raw = F.when(k == 0, F.concat(name, F.lit(" ("), mail, F.lit(")"))).when(k == 1, F.concat(mail, F.lit(" ("), name, F.lit(")"))).when(k == 2, mail).otherwise(name)
    a = fields.author(raw)
    return table(spark, sf_dir, "customer").select("c_custkey", k.alias("form"), a["name"].alias("name"), a["email"].alias("email"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9._%-]+\\.[A-Za-z]{2,4}'), ' ') AS mails FROM documents")
def q_author_emails_in_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(f"({fields.MAIL})"), F.lit(1)), " ").alias("mails"))


@query("SELECT doc_id, lang || '-' || upper(substr(source, 1, 2)) AS language FROM documents")
def q_language_norm(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", fields.language(F.lit(" "), F.concat_ws("_", F.upper("lang"), F.lit("x"), F.substring("source", 1, 2))).alias("language"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey * 3600 + l_linenumber * 60 + l_quantity::BIGINT AS hms, l_linenumber * 60 + l_quantity::BIGINT AS ms, l_quantity::BIGINT AS s FROM lineitem")
def q_duration(spark, sf_dir):
    s = F.col("l_quantity").cast("long").cast("string")
    m = F.concat_ws(":", F.col("l_linenumber").cast("string"), s)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fields.duration(F.concat_ws(":", F.col("l_suppkey").cast("string"), m)).alias("hms"), fields.duration(m).alias("ms"), fields.duration(s).alias("s"))


TTL = "CASE WHEN event_id % 5 = 0 THEN (CASE event_type WHEN 'view' THEN 86400 WHEN 'click' THEN 604800 ELSE 3600 END) * (event_id % 3 + 1) WHEN event_id % 5 < 3 THEN (event_id % 90 + 1) * (CASE WHEN event_id % 2 = 0 THEN 60 ELSE 3600 END) ELSE 3600 END"


def ttl_rows(spark, sf_dir):
    e, i = event_entries(spark, sf_dir), F.col("event_id")
    period = F.when(F.col("event_type") == "view", "daily").when(F.col("event_type") == "click", "weekly").otherwise("hourly")
    frequency, ttl = F.when(i % 5 == 0, i % 3 + 1), F.when(i % 5 < 3, i % 90 + 1)
    return e.withColumn("time_to_live", fields.time_to_live(period, frequency, ttl, F.when(i % 2 == 0, F.lit(None).cast("string")).otherwise("hours")))


@query(f"SELECT event_id, least({TTL}, 259200)::BIGINT AS time_to_live FROM events")
def q_ttl(spark, sf_dir):
    return ttl_rows(spark, sf_dir).select("event_id", "time_to_live")


@query(f"SELECT event_id, CASE WHEN event_type = 'error' THEN TRUE ELSE epoch(TIMESTAMP '2024-01-02 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT > greatest(least({TTL}, 259200), 1800) END AS expired FROM events")
def q_expired(spark, sf_dir):
    rows = ttl_rows(spark, sf_dir).withColumn("last_retrieved", F.when(F.col("event_type") != "error", F.col("ts")))
    return relate.expired(rows, F.lit("2024-01-02 00:00:00").cast("timestamp")).select("event_id", "expired")


VERSIONS = [("rss", "", "2.0"), ("rss", "", "2.01"), ("rss", "", "2.1"), ("rss", "", "0.91"), ("rss", "", "2.0/XSS-strict"), ("rss", "", None), ("rdf:RDF", "http://purl.org/rss/1.0/", None), ("feed", "http://www.w3.org/2005/Atom", None), ("feed", "http://purl.org/atom/ns#", "0.3"), ("CHANNEL", "", None), ("Channel", "http://purl.org/net/rss1.1#", None), ("html", "", "0.0")]
WANT = [("rss", 2.0), ("rss", 2.0), ("rss", 2.0), ("rss", 0.91), ("rss", 2.0), ("rss", None), ("rss", 1.0), ("atom", 1.0), ("atom", 0.3), ("cdf", 0.4), ("rss", 1.1), (None, None)]
VALUES = ", ".join(f"({i}, {t!r}, {v})" if t and v else f"({i}, {repr(t) if t else 'NULL'}, {v or 'NULL'})" for i, (t, v) in enumerate(WANT))


@query(f"SELECT event_id, k.t AS feed_type, k.v::DOUBLE AS feed_version FROM events JOIN (VALUES {VALUES}) AS k(i, t, v) ON event_id % {len(WANT)} = k.i")
def q_type_version_detect(spark, sf_dir):
    pick = F.element_at(F.array(*[F.struct(F.lit(a).alias("root"), F.lit(b).alias("ns"), F.lit(c).cast("string").alias("v")) for a, b, c in VERSIONS]), (F.col("event_id") % len(VERSIONS) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", pick.alias("x"))
    kind = fields.feed_type(F.col("x.root"), F.col("x.ns"))
    return rows.select("event_id", kind.alias("feed_type"), fields.feed_version(kind, F.col("x.ns"), F.col("x.v")).alias("feed_version"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'iso-8859-' || (page_id % 9 + 1) WHEN 1 THEN 'koi8-r' ELSE 'utf-8' END AS encoding FROM pages")
def q_encoding_header(spark, sf_dir):
    k = F.col("page_id") % 3
    header = F.when(k == 0, F.concat(F.lit("text/xml; charset=ISO-8859-"), F.col("page_id") % 9 + 1)).otherwise("text/xml")
    xml = F.concat(F.when(k == 2, F.lit("<?xml version='1.0'?>")).otherwise('<?xml version="1.0" encoding="KOI8-R"?>'), F.col("html"))
    return pages(spark, sf_dir).select("page_id", fields.encoding(header, xml).alias("encoding"))


@query("SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS rfc, epoch(date_trunc('second', ts))::BIGINT AS iso, epoch(date_trunc('day', ts))::BIGINT AS day, NULL::BIGINT AS bad FROM events")
def q_date_parse(spark, sf_dir):
    e = event_entries(spark, sf_dir)
    of = lambda c: F.unix_timestamp(fields.parse_date(c))
    ts = F.col("ts")
    return e.select("event_id", of(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).alias("rfc"), of(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"), of(F.date_format(ts, "dd MMM yyyy")).alias("day"), of(F.concat(F.lit("soon "), F.col("event_id"))).alias("bad"))


@query("SELECT event_id, list_distinct([lower(trim(event_type)), 'feed', lower(trim(event_type)), 'x' || (user_id % 5)]).list_sort().array_to_string(',') AS tags FROM events")
def q_tags_norm(spark, sf_dir):
    raw = F.array(F.concat(F.lit(" "), F.upper("event_type")), F.lit("Feed "), F.col("event_type"), F.lit(" "), F.concat(F.lit("X"), F.col("user_id") % 5))
    t = fields.tags(F.array().cast("array<string>"), raw)
    return event_entries(spark, sf_dir).select("event_id", F.array_join(F.array_sort(t), ",").alias("tags"))


@query("""SELECT doc_id, list_sort(list_distinct(a || b)).array_to_string(',') AS both, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))).array_to_string(',') AS less, coalesce(nullif(trim(lang), ''), source) AS first
FROM (SELECT doc_id, lang, source, list_distinct([lang, source, 'k' || (doc_id % 3)]) AS a, ['k0', lang] AS b FROM documents)""")
def q_array_ops(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a, b = F.array_distinct(F.array("lang", "source", F.concat(F.lit("k"), F.col("doc_id") % 3))), F.array(F.lit("k0"), F.col("lang"))
    return d.select("doc_id", F.array_join(F.array_sort(F.array_union(a, b)), ",").alias("both"), F.array_join(F.array_sort(F.array_except(a, b)), ",").alias("less"), text.first_not_blank(F.lit(" \n"), F.col("lang"), F.col("source")).alias("first"))


# --- relations --------------------------------------------------------------------------------------


@query(f"SELECT guid, row_number() OVER (PARTITION BY feed_key ORDER BY coalesce(t, 0) DESC, doc_pos)::INT AS rank FROM {DOC_ENTRIES}")
def q_entries_sorted_time(spark, sf_dir):
    return relate.ranked(doc_entries(spark, sf_dir).select("feed_key", "guid", "time", "doc_pos")).select("guid", "rank")


@query(f"SELECT guid, row_number() OVER (PARTITION BY feed_key ORDER BY title, doc_pos)::INT AS rank FROM {DOC_ENTRIES}")
def q_entries_sorted_prop(spark, sf_dir):
    return relate.ranked(doc_entries(spark, sf_dir).select("feed_key", "guid", "title", "doc_pos"), "title").select("guid", "rank")


@query(f"SELECT guid, row_number() OVER (PARTITION BY feed_key ORDER BY doc_pos)::INT AS rank FROM {DOC_ENTRIES}")
def q_entries_doc_order(spark, sf_dir):
    return relate.ranked(doc_entries(spark, sf_dir).select("feed_key", "guid", "doc_pos"), None).select("guid", "rank")


@query(f"""SELECT guid, coalesce(t, lead(t) OVER w + 1, lag(t) OVER w - 1, epoch(TIMESTAMP '{AS_OF}')::BIGINT)::BIGINT AS t FROM {DOC_ENTRIES} WINDOW w AS (PARTITION BY feed_key ORDER BY doc_pos)""")
def q_time_estimate(spark, sf_dir):
    rows = relate.estimate_times(doc_entries(spark, sf_dir).select("feed_key", "guid", "doc_pos", "time"), F.lit(AS_OF).cast("timestamp"))
    return rows.select("guid", F.unix_timestamp("time").alias("t"))


@query("SELECT d.doc_id, coalesce(l.toxic, 0) = 1 OR contains(d.source, '1') AS explicit FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_inherit_explicit(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("feed_key"), F.col("source").contains("1").alias("explicit"))
    flags = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("feed_key"), (F.col("toxic") == 1).alias("explicit"))
    return relate.inherit_flag(own, flags, "explicit").select(F.col("feed_key").alias("doc_id"), "explicit")


@query("SELECT event_id, event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 3 = 0")
def q_append_entries(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return relate.append_entries(e.filter("event_id % 2 = 0"), e.filter("event_id % 3 = 0").select("event_type", "event_id"))


@query("SELECT s_suppkey, title, row_number() OVER (ORDER BY coalesce(title, ''), s_suppkey) AS rank FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS title FROM supplier)")
def q_feeds_by_title(spark, sf_dir):
    title = F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name"))
    return relate.title_ranks(table(spark, sf_dir, "supplier").select("s_suppkey", title.alias("title")), "s_suppkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'own' ELSE c_name END AS author FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def q_inherit_author(spark, sf_dir):
    own = F.when(F.col("o_orderkey") % 3 == 0, "own")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("feed_key"), "o_orderkey", own.alias("author"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feed_key"), F.col("c_name").alias("author"))
    return relate.inherit(o, c, ["author"]).select("o_orderkey", "author")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def q_orphans(spark, sf_dir):
    return relate.orphans(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT source AS feed_key, count(DISTINCT lang) AS parents FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def q_multi_parent_check(spark, sf_dir):
    e = table(spark, sf_dir, "documents").select(F.col("source").alias("feed_key"), "lang")
    return relate.many_parents(e, e.distinct())


@query("SELECT o_orderkey, c_name || ': ' || o_orderpriority AS title FROM orders JOIN customer ON o_custkey = c_custkey")
def q_merge_planet(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("feed_key"), "o_orderkey", F.col("o_orderpriority").alias("title"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feed_key"), F.col("c_name").alias("title"))
    return relate.merge_feeds(o, c).select("o_orderkey", "title")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def q_dedup_guid(spark, sf_dir):
    return relate.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [-F.col("event_id")])


CACHE = """SELECT href, max(t) AS t FROM (SELECT 'http://h/' || (user_id % 50) AS href, event_id AS t FROM events WHERE event_id % 2 = 0
UNION ALL SELECT CASE WHEN event_id % 10 = 1 THEN 'file:/h/' ELSE 'http://h/' END || (user_id % 80), event_id FROM events WHERE event_id % 2 = 1 AND event_id % 10 NOT IN (1, 3, 5)) GROUP BY href"""


@query(CACHE)
def q_cache_upsert(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    row = lambda href, data: (href.alias("href"), F.lit("t").alias("title"), data.alias("feed_data"), F.timestamp_seconds(i).alias("last_retrieved"))
    cached = relate.latest(e.filter(i % 2 == 0).select(*row(F.concat(F.lit("http://h/"), F.col("user_id") % 50), F.lit("<rss/>"))), ["href"], [-F.unix_timestamp("last_retrieved")])
    data = F.when(i % 10 == 3, " \n").when(i % 10 == 5, "<html><p>").otherwise("<rss/>")
    fresh = e.filter(i % 2 == 1).select(*row(F.concat(F.when(i % 10 == 1, "file:/h/").otherwise("http://h/"), F.col("user_id") % 80), data))
    return relate.upsert(cached, fresh).select("href", F.unix_timestamp("last_retrieved").alias("t"))


@query("SELECT conv_id, first(text ORDER BY turn) AS opening, last(role ORDER BY turn) AS last_role, count(*) AS turns FROM conversations GROUP BY conv_id")
def q_thread_first_last(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("opening"), F.max_by("role", "turn").alias("last_role"), F.count("*").alias("turns"))


# --- enclosures -------------------------------------------------------------------------------------


@query("""SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber, coalesce(b.mime, a.mime) AS mime
FROM (SELECT l_orderkey, l_linenumber, 'audio/' || l_shipmode AS mime FROM (SELECT *, 'x' AS l_shipmode FROM lineitem) WHERE l_linenumber < 4) a
FULL JOIN (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN NULL ELSE 'video/' || l_returnflag END AS mime FROM lineitem WHERE l_linenumber > 2) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def q_enclosure_merge(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a = li.filter("l_linenumber < 4").select("l_orderkey", "l_linenumber", F.lit("audio/x").alias("mime"))
    b = li.filter("l_linenumber > 2").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.concat(F.lit("video/"), "l_returnflag")).alias("mime"))
    return enclosures.merge_by_url(a, b, ["l_orderkey", "l_linenumber"])


@query("""SELECT l_orderkey, first('u' || l_linenumber ORDER BY l_returnflag <> 'R', l_linenumber) AS url, array_to_string(list('u' || l_linenumber ORDER BY l_linenumber), ' ') AS versions FROM lineitem GROUP BY l_orderkey""")
def q_media_group_default(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.concat(F.lit("u"), "l_linenumber").alias("url"), F.lit("audio/mpeg").alias("type"), F.col("l_quantity").cast("long").alias("file_size"), (F.col("l_returnflag") == "R").alias("is_default"))
    return enclosures.group_defaults(rows, ["l_orderkey"]).select("l_orderkey", "url", F.array_join("versions", " ").alias("versions"))


@query("SELECT p_partkey, 'Podcasts/' || p_type || CASE WHEN p_partkey % 2 = 0 THEN '/' || p_brand ELSE '' END AS path FROM part")
def q_itunes_categories(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", enclosures.itunes_path(F.col("p_type"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))).alias("path"))


@query("SELECT event_id, nullif(event_id % 4, 0) AS file_size, CASE event_id % 3 WHEN 0 THEN 'sample' WHEN 1 THEN 'nonstop' ELSE 'full' END AS expression FROM events")
def q_enclosure_clean(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, ["sample", "nonstop", "odd"])), (F.col("event_id") % 3 + 1).cast("int"))
    return enclosures.clean(table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).alias("file_size"), word.alias("expression")))


@query("SELECT l_orderkey, coalesce(first('u' || l_linenumber ORDER BY l_linenumber) FILTER (l_quantity > 25), first('u' || l_linenumber ORDER BY l_linenumber)) AS url FROM lineitem GROUP BY l_orderkey")
def q_writer_alternate(spark, sf_dir):
    size = F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(0)
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("u"), "l_linenumber").alias("url"), size.alias("file_size")))).alias("all"))
    return rows.select("l_orderkey", enclosures.with_size(F.col("all"))["url"].alias("url"))


@query("SELECT o_orderkey, count(*) FILTER (l_returnflag = 'R') AS licenses, first(l_linenumber ORDER BY l_linenumber) FILTER (l_returnflag = 'R') AS license FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def q_license_links(spark, sf_dir):
    link = F.struct("l_linenumber", F.when(F.col("l_returnflag") == "R", "license").otherwise("self").alias("rel"), F.col("l_linenumber").alias("href"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(link)).alias("links"))
    found = xml_feeds.licenses(F.col("links"))
    return rows.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.size(found).cast("long").alias("licenses"), F.get(found, F.lit(0)).alias("license"))


# --- documents: write, parse back -------------------------------------------------------------------

PAGED = "source || '-' || (doc_id // 64)"


def feed_docs(spark, sf_dir, kind, version=None, denied=None):
    """Documents as feeds of up to 64 entries, written and ready to parse; without the denied ones, which the writer would refuse."""
    e = doc_entries(spark, sf_dir).withColumn("feed_key", F.concat_ws("-", "feed_key", F.floor(F.col("guid") / 64)))
    e = e if denied is None else e.filter(~denied)
    heads = e.select("feed_key").distinct().select("feed_key", F.concat(F.lit("Feed "), "feed_key").alias("title"), F.lit("http://h.example.org/").alias("link"), F.lit("a < b & c").alias("subtitle"))
    items = e.select("feed_key", "doc_pos", F.col("guid").cast("string").alias("id"), "title", F.concat(F.lit("http://h.example.org/d/"), "guid").alias("link"), "content", "time")
    return xml_feeds.write_xml(heads, items, kind, version, denied=denied, denied_entries=denied)


TRIP = f"""SELECT {PAGED} AS feed_key, doc_id::VARCHAR AS id, trim(substr(text, 1, 40), ' ' || chr(9) || chr(10) || chr(13)) AS title, 'http://h.example.org/d/' || doc_id AS link, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1704067200 + doc_id * 60 END::BIGINT AS t FROM documents"""


def trip(spark, sf_dir, kind, version=None):
    """Titles as they were written, also empty ones; times only where one was written."""
    names = ["feed_key", "id", "title", "title_text", "link", "time"]
    rows = xml_feeds.entries(feed_docs(spark, sf_dir, kind, version), columns=names, settings=DEFAULTS.with_options(timestamp_estimation_enabled=False))
    return rows.select("feed_key", "id", F.coalesce("title", "title_text").alias("title"), "link", F.unix_timestamp("time").alias("t"))


@query(TRIP)
def q_roundtrip_rss2(spark, sf_dir):
    return trip(spark, sf_dir, "rss")


@query(TRIP)
def q_roundtrip_rss1(spark, sf_dir):
    return trip(spark, sf_dir, "rss", 1.0)


@query(TRIP)
def q_roundtrip_atom(spark, sf_dir):
    return trip(spark, sf_dir, "atom")


@query(f"SELECT DISTINCT {PAGED} AS feed_key, TRUE AS well_formed, 'atom' AS feed_type, 1.0::DOUBLE AS feed_version, 'Feed ' || {PAGED} AS title, 'http://h.example.org/' AS link, 'a < b & c' AS subtitle, 'en-US' AS language, 3600::BIGINT AS time_to_live FROM documents")
def q_feeds_parsed(spark, sf_dir):
    return xml_feeds.feeds(feed_docs(spark, sf_dir, "atom"), columns=["feed_key", "well_formed", "feed_type", "feed_version", "title", "link", "subtitle", "language", "time_to_live"])


@query(f"""SELECT feed_key, count(*) AS entries, first(title ORDER BY doc_id) AS first_title, last(id ORDER BY doc_id) AS last_id, count(*) FILTER (t IS NOT NULL) AS dated
FROM (SELECT {PAGED} AS feed_key, doc_id, doc_id::VARCHAR AS id, trim(substr(text, 1, 40), ' ' || chr(9) || chr(10) || chr(13)) AS title, CASE WHEN doc_id % 7 <> 0 THEN 1 END AS t FROM documents) GROUP BY feed_key""")
def q_xpath(spark, sf_dir):
    """Paths over documents: counts, positions and predicates."""
    rows = shred.shredded(feed_docs(spark, sf_dir, "rss"))
    of = lambda p: xpath.find(F.col("nodes"), p)
    return rows.select("feed_key", of("count(//item)").cast("long").alias("entries"), of("/rss/channel/ITEM[1]/title").alias("first_title"), of("channel/item[last()]/guid").alias("last_id"), of("count(channel/item[pubDate])").cast("long").alias("dated"))


@query("""SELECT p_partkey, 'http://m.example.org/' || CASE WHEN p_size % 2 = 0 THEN 'b' ELSE 'a' END || p_partkey AS href, CASE WHEN p_size % 2 = 0 THEN 'audio/ogg' ELSE 'audio/mpeg' END AS type, p_size::BIGINT AS file_size, p_brand AS credit,
'http://m.example.org/p' || p_partkey AS player, 2 AS versions, 1 AS enclosures FROM part""")
def q_media_groups(spark, sf_dir):
    """Media groups folded to their default member, which takes the group's player and credits."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    at = F.concat(F.lit('url="http://m.example.org/{}'), key, F.lit('" '))
    url = lambda letter: F.replace(at, F.lit("{}"), F.lit(letter))
    size = F.concat(F.lit('fileSize="'), F.col("p_size"), F.lit('" '))
    xml = F.concat(
        F.lit('<rss xmlns:media="http://search.yahoo.com/mrss/"><channel><item><enclosure '), url("a"), F.lit('type="audio/x"/><media:group><media:credit role="Author">'), F.col("p_brand"), F.lit("</media:credit><media:player "), url("p"), F.lit("/><media:content "),
        url("a"), size, F.lit('type="audio/mpeg"/><media:content '), url("b"), size, F.when(F.col("p_size") % 2 == 0, F.lit('isDefault="true" ')).otherwise(""), F.lit('type="audio/ogg"/></media:group></item></channel></rss>'),
    )
    rows = shred.shredded(p.select("p_partkey", xml.alias("xml")))
    item = F.get(xpath.find_ids(F.col("nodes"), "channel/item"), F.lit(0))
    e = rows.select("p_partkey", media.enclosures(F.col("nodes"), item).alias("all")).withColumn("e", F.get("all", F.lit(0)))
    return e.select("p_partkey", "e.href", "e.type", "e.file_size", F.get("e.credits", F.lit(0))["name"].alias("credit"), "e.player.url", F.size("e.versions").alias("versions"), F.size("all").alias("enclosures")).withColumnRenamed("url", "player")


@query("SELECT source AS feed_key, count(*) AS entries FROM documents WHERE source NOT LIKE '%1' GROUP BY source")
def q_write_guard(spark, sf_dir):
    """The allowed sources written under the guard, their entries counted in the documents."""
    source = F.regexp_replace("feed_key", "-[0-9]+$", "")
    rows = shred.shredded(feed_docs(spark, sf_dir, "rss", denied=source.endswith("1")))
    return rows.groupBy(source.alias("feed_key")).agg(F.sum(xpath.find(F.col("nodes"), "count(//item)")).cast("long").alias("entries"))


@query("SELECT c_custkey AS feed_key, TRUE AS well_formed, c_name || ' & ' || c_custkey || '!' AS title, 'by ' || c_name || ' & ' || c_custkey AS author FROM customer")
def q_internal_entities(spark, sf_dir):
    """Feeds that abbreviate by entities of their own document type, which also names an external one."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    head = F.concat(F.lit('<?xml version="1.0"?><!DOCTYPE rss PUBLIC "-//x//y" "http://h.example.org/x.dtd" [<!-- it\'s ours --><!ENTITY co "'), F.col("c_name"), F.lit(' &#38;amp; '), k, F.lit('"><!ENTITY far SYSTEM "file:///etc/hosts"><!ENTITY by "by &co;">]>'))
    xml = F.concat(head, F.lit('<rss version="2.0"><channel><title>&co;!</title><managingEditor>&by;</managingEditor></channel></rss>'))
    f = xml_feeds.feeds(c.select(F.col("c_custkey").alias("feed_key"), xml.alias("xml")), columns=["feed_key", "well_formed", "title", "author"])
    return f.select("feed_key", "well_formed", "title", F.col("author.name").alias("author"))


@query()
def q_shred_pages(spark, sf_dir):
    """Web pages through the reader of tag soup: nodes and links of each."""
    rows = shred.shredded(pages(spark, sf_dir).select("page_id", "html"), "html")
    return rows.select("page_id", "well_formed", "root", F.size("nodes").alias("n_nodes"), F.size(F.filter("nodes", lambda n: n["name"] == "a")).alias("n_links"))


@query()
def q_sanitize_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", shred.sanitize(F.col("html"), F.col("url")).alias("html"))


TERMS = ("http://www.itunes.com/dtds/podcast-1.0.dtd", "http://search.yahoo.com/mrss/", "http://purl.org/dc/elements/1.1/")


def customer_feeds(spark, sf_dir):
    """Orders as entries of their customer's feed, written by hand in RSS 2.0 with extensions; every third entry says all itself."""
    o = table(spark, sf_dir, "orders").filter("o_custkey IS NOT NULL").select(F.col("o_custkey").alias("feed_key"), "o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("at"))
    k = F.col("o_orderkey").cast("string")
    put = lambda mark, *cs: F.concat(F.lit(f"<{mark}>"), *cs, F.lit(f"</{mark.split()[0]}>"))
    when = F.date_format(F.timestamp_seconds("at"), "EEE MMM dd HH:mm:ss yyyy")
    own = F.concat(put("author", F.lit("o"), k, F.lit("@example.com (Writer "), k, F.lit(")")), put("media:adult", F.lit("true")), put("dc:subject", F.lit(" A"), k), put("pubDate", when))
    item = F.concat(
        F.lit("<item><media:title>not this</media:title><itunes:author>not this</itunes:author>"), put("title", F.lit("Order "), k, F.lit("[7]")), put("link", F.lit("../x/./o"), k), F.lit('<enclosure url="http://m.example.org/'), k, F.lit('.mp3" length="9"/>'),
        put("itunes:duration", F.lit("1:0"), F.col("o_orderkey") % 10), put("comments", F.lit("?c="), k), F.when(F.col("o_orderkey") % 3 == 0, own).otherwise(put("itunes:keywords", F.lit("b "), k)), F.lit("</item>"),
    )
    rows = o.groupBy("feed_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))), lambda x: x["item"]), "").alias("items"))
    head = F.concat(F.lit('<rss version="2.0" xmlns:itunes="%s" xmlns:media="%s" xmlns:dc="%s" xml:base="http://h.example.org/a/b/"><channel>' % TERMS), put("title", F.lit("C"), F.col("feed_key").cast("string")), put("managingEditor", F.lit("c"), F.col("feed_key").cast("string"), F.lit("@example.com")))
    more = F.concat(F.lit("<webMaster>w@example.com (W)</webMaster>"), F.when(F.col("feed_key") % 2 == 0, F.lit("<itunes:explicit>yes</itunes:explicit>")).otherwise(""), F.lit('<schedule><intervaltime hour="2" min="'), F.col("feed_key") % 60, F.lit('"/></schedule>'), F.lit("<docs>../d</docs><dc:language>DE_at</dc:language><copyright>R</copyright>"))
    return rows.select("feed_key", F.concat(head, more, "items", F.lit("</channel></rss>")).alias("xml"))


OWN = "o_orderkey % 3 = 0"


def order_items(spark, sf_dir, key):
    """Orders as entries of a feed by a key."""
    at = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        key.alias("feed_key"), F.col("o_orderkey").alias("doc_pos"), F.concat(F.lit("urn:o:"), at).alias("id"), F.concat(F.lit("a < b & "), at).alias("title"), F.concat(F.lit("http://h.example.org/o/"), at).alias("link"), F.col("o_orderstatus").alias("content"), F.col("o_orderdate").cast("timestamp").alias("time"),
    )


@query("""SELECT 1 + (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS page, (row_number() OVER (ORDER BY o_orderkey) - 1) % 500 AS doc_pos, 'urn:o:' || o_orderkey AS id, 'a < b & ' || o_orderkey AS title, 'Planet' AS feed_title,
(row_number() OVER (ORDER BY o_orderkey) - 1) // 500 < (SELECT (count(*) - 1) // 500 FROM orders) AS has_next FROM orders""")
def q_save_pages(spark, sf_dir):
    """All orders as one feed, written by many tasks in pages of 500 entries that name each other, and read back."""
    from feedloom.sources.tables import shared_path

    heads = spark.range(1).select(F.lit("planet/1").alias("feed_key"), F.lit("Planet").alias("title"), F.lit("http://h.example.org/").alias("link"), F.lit("all").alias("subtitle"))
    path = shared_path(spark, "planet")
    xml_feeds.save_feeds(heads, order_items(spark, sf_dir, F.lit("planet/1")), path, page=500)
    docs = xml_feeds.read_saved(spark, path)
    e = xml_feeds.entries(docs, key="page", columns=["page", "doc_pos", "id", "title"])
    f = xml_feeds.feeds(docs, key="page", columns=["page", "title", "links"]).withColumn("has_next", F.exists("links", lambda x: x["rel"].eqNullSafe("next") & x["href"].endswith(".xml")))
    both = e.join(f.select("page", F.col("title").alias("feed_title"), "has_next").hint("merge"), "page")  # files that tasks list look small to the planner
    return both.select(F.col("page").cast("long").alias("page"), F.col("doc_pos").cast("long").alias("doc_pos"), "id", "title", "feed_title", "has_next")


@query("""SELECT feed_key, kind, count(*) AS entries, min(o_orderkey) AS first, sum(o_orderkey * n)::BIGINT AS placed FROM (
  SELECT o_custkey::VARCHAR AS feed_key, kind, o_orderkey, row_number() OVER (PARTITION BY o_custkey, kind ORDER BY o_orderkey) - 1 AS n FROM orders, unnest(['rss1', 'rss2', 'atom']) AS k(kind)) GROUP BY ALL""")
def q_save_feeds(spark, sf_dir):
    """Customers' feeds as files in three formats, streamed in order and read back; a format's files go when they are read."""
    from feedloom.sources.tables import kept, shared_path

    items = order_items(spark, sf_dir, F.col("o_custkey"))
    heads = items.select("feed_key").distinct().select("feed_key", F.concat(F.lit("C"), F.col("feed_key").cast("string")).alias("title"), F.lit("http://h.example.org/").alias("link"), F.lit("s").alias("subtitle"))
    out, k = None, F.regexp_extract("id", r"\d+$", 0).cast("long")
    for name, kind, version in (("rss1", "rss", 1.0), ("rss2", "rss", None), ("atom", "atom", None)):
        path = shared_path(spark, f"saved-{name}")
        xml_feeds.save_feeds(heads, items, path, kind, version)
        rows = xml_feeds.entries(xml_feeds.read_saved(spark, path), columns=["feed_key", "doc_pos", "id"])
        told = rows.groupBy("feed_key").agg(F.count("*").alias("entries"), F.min(k).alias("first"), F.sum(k * F.col("doc_pos")).alias("placed"))
        told = kept(told.select("feed_key", F.lit(name).alias("kind"), "entries", "first", "placed"), f"told-{name}")
        xml_feeds.drop_saved(spark, path)
        out = told if out is None else out.unionByName(told)
    return out


@query("""SELECT o_orderkey, '<item><title>a &lt; b &amp; ' || o_orderkey || '</title><link>http://h.example.org/o/' || o_orderkey || '</link><guid isPermaLink="false">urn:o:' || o_orderkey || '</guid><description>' || o_orderstatus || '</description><pubDate>'
|| strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate></item>' AS xml FROM orders""")
def q_write_items(spark, sf_dir):
    """Entries as markup by themselves."""
    rows = xml_feeds.write_items(order_items(spark, sf_dir, F.col("o_custkey")))
    return rows.select(F.col("doc_pos").alias("o_orderkey"), "xml")


@query(f"""SELECT o_orderkey, 'Order ' || o_orderkey AS title, 'http://h.example.org/a/x/o' || o_orderkey AS link, 'http://h.example.org/a/b/?c=' || o_orderkey AS comments, CASE WHEN {OWN} THEN 'Writer ' || o_orderkey ELSE 'not this' END AS author,
CASE WHEN {OWN} THEN 'o' || o_orderkey || '@example.com' END AS mail, 'w@example.com' AS publisher, ({OWN}) OR o_custkey % 2 = 0 AS explicit, CASE WHEN {OWN} THEN 'a' || o_orderkey ELSE 'b,' || o_orderkey END AS tags,
CASE WHEN {OWN} THEN floor(epoch(o_orderdate))::BIGINT END AS t, 'http://m.example.org/' || o_orderkey || '.mp3' AS href, 9::BIGINT AS file_size, (60 + o_orderkey % 10)::BIGINT AS duration, 'http://h.example.org/a/b/' AS base_uri, 'rss' AS feed_type, 2.0::DOUBLE AS feed_version FROM orders""")
def q_entries_full(spark, sf_dir):
    """Entries with all that they say themselves and inherit."""
    names = ["title", "link", "comments", "author", "publisher", "explicit", "tags", "time", "enclosures", "base_uri", "feed_type", "feed_version"]
    e = xml_feeds.entries(customer_feeds(spark, sf_dir), columns=names, settings=DEFAULTS.with_options(strip_comment_count=True))
    one = F.get("enclosures", F.lit(0))
    return e.select(
        F.regexp_extract("title", r"\d+", 0).cast("long").alias("o_orderkey"), "title", "link", "comments", "author.name", "author.email", F.col("publisher.email").alias("publisher"), "explicit", F.array_join("tags", ",").alias("tags"), F.unix_timestamp("time").alias("t"),
        one["href"].alias("href"), one["file_size"].alias("file_size"), one["duration"].alias("duration"), "base_uri", "feed_type", "feed_version",
    ).withColumnsRenamed({"name": "author", "email": "mail"})


@query("SELECT o_custkey AS feed_key, 'C' || o_custkey AS title, 'c' || o_custkey || '@example.com' AS mail, 'W' AS publisher, o_custkey % 2 = 0 AS explicit, (7200 + 60 * (o_custkey % 60))::BIGINT AS time_to_live, 'http://h.example.org/a/d' AS docs, 'de-AT' AS language, 'R' AS rights, 'http://h.example.org/a/b/' AS base_uri FROM orders GROUP BY o_custkey")
def q_feeds_full(spark, sf_dir):
    """Feeds with persons, schedule, addresses and language."""
    f = xml_feeds.feeds(customer_feeds(spark, sf_dir), columns=["feed_key", "title", "author", "publisher", "explicit", "time_to_live", "docs", "language", "rights", "base_uri"])
    return f.select("feed_key", "title", F.col("author.email").alias("mail"), F.col("publisher.name").alias("publisher"), "explicit", "time_to_live", "docs", "language", "rights", "base_uri")


@query(f"SELECT o_orderkey, coalesce(t, lead(t) OVER w + 1, lag(t) OVER w - 1, epoch(TIMESTAMP '{AS_OF}')::BIGINT)::BIGINT AS t FROM (SELECT o_orderkey, o_custkey, CASE WHEN {OWN} THEN floor(epoch(o_orderdate))::BIGINT END AS t FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def q_entries_estimated(spark, sf_dir):
    """Missing times estimated from the neighbours in the document."""
    e = xml_feeds.entries(customer_feeds(spark, sf_dir), columns=["feed_key", "doc_pos", "title", "time"], as_of=F.lit(AS_OF).cast("timestamp"))
    return e.select(F.regexp_extract("title", r"\d+", 0).cast("long").alias("o_orderkey"), F.unix_timestamp("time").alias("t"))


def whole_feeds(spark, sf_dir, kind, version=None):
    """Every customer's feed with all that the formats hold, written and parsed again."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_custkey IS NOT NULL")
    who = lambda name, mail: F.struct(name.alias("name"), mail.alias("email"), F.lit(None).cast("string").alias("href"))
    key = F.col("c_custkey").cast("string")
    image = F.struct(F.lit("I").alias("title"), F.concat(F.lit("http://h.example.org/i"), key).alias("href"), F.lit(None).cast("string").alias("link"))
    heads = c.select(
        F.col("c_custkey").alias("feed_key"), F.concat(F.lit("Feed <"), key, F.lit(">")).alias("title"), F.concat(F.lit("http://h.example.org/"), key).alias("link"), F.lit("s & t").alias("subtitle"), F.lit("de-AT").alias("language"), F.lit("(c)").alias("rights"),
        who(F.col("c_name"), F.lit("c@example.com")).alias("author"), F.lit(7200).alias("time_to_live"), F.timestamp_seconds(F.lit(1700000000)).alias("updated"), F.array(image).alias("images"),
    )
    at = F.col("o_orderkey").cast("string")
    parcel = F.struct(F.concat(F.lit("http://m.example.org/"), at).alias("href"), F.lit("audio/mpeg").alias("type"), F.lit(9).cast("long").alias("file_size"))
    items = o.select(
        F.col("o_custkey").alias("feed_key"), F.col("o_orderkey").alias("doc_pos"), F.concat(F.lit("urn:o:"), at).alias("id"), F.concat(F.lit("a < b & "), at).alias("title"), F.concat(F.lit("http://h.example.org/o/"), at).alias("link"), F.concat(F.lit("<p>]]>"), at, F.lit("</p>")).alias("content"),
        F.lit("short").alias("summary"), F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("time"), who(F.lit("W"), F.lit("w@example.com")).alias("author"), F.array(F.lit("x"), F.concat(F.lit("t"), at)).alias("tags"), F.array(parcel).alias("enclosures"), F.lit("r").alias("rights"),
    )
    return xml_feeds.write_xml(heads.join(items.select("feed_key").distinct(), "feed_key", "left_semi"), items, kind, version, entry_hook=F.concat(F.lit("<extra>"), F.col("doc_pos").cast("string"), F.lit("</extra>")))


def whole_trip(spark, sf_dir, kind, version=None):
    e = xml_feeds.entries(whole_feeds(spark, sf_dir, kind, version), columns=["feed_key", "id", "title", "link", "content", "summary", "time", "author", "tags", "enclosures", "rights"])
    return e.select(
        "feed_key", "id", "title", "link", F.regexp_replace("content", "\\]\\]>", "").alias("content"), "summary", F.unix_timestamp("time").alias("t"), F.col("author.name").alias("author"), F.array_join("tags", ",").alias("tags"), F.get("enclosures", F.lit(0))["href"].alias("href"), F.get("enclosures", F.lit(0))["file_size"].alias("file_size"), "rights",
    )


WHOLE = """SELECT o_custkey AS feed_key, 'urn:o:' || o_orderkey AS id, 'a < b & ' || o_orderkey AS title, 'http://h.example.org/o/' || o_orderkey AS link, '<p>' || o_orderkey || '</p>' AS content, 'short' AS summary, floor(epoch(o_orderdate))::BIGINT AS t,
'W' AS author, 'x,t' || o_orderkey AS tags, {} AS href, {} AS file_size, 'r' AS rights FROM orders JOIN customer ON o_custkey = c_custkey"""


@query(WHOLE.format("'http://m.example.org/' || o_orderkey", "9::BIGINT"))
def q_whole_rss2(spark, sf_dir):
    return whole_trip(spark, sf_dir, "rss")


@query(WHOLE.format("NULL::VARCHAR", "NULL::BIGINT"))
def q_whole_rss1(spark, sf_dir):
    return whole_trip(spark, sf_dir, "rss", 1.0)


@query(WHOLE.format("'http://m.example.org/' || o_orderkey", "9::BIGINT"))
def q_whole_atom(spark, sf_dir):
    return whole_trip(spark, sf_dir, "atom")


@query("""SELECT kind, c_custkey AS feed_key, TRUE AS well_formed, 'Feed <' || c_custkey || '>' AS title, 'http://h.example.org/' || c_custkey AS link, 's & t' AS subtitle, 'de-AT' AS language, '(c)' AS rights
FROM customer SEMI JOIN orders ON o_custkey = c_custkey, unnest(['rss1', 'rss2', 'atom']) AS k(kind)""")
def q_whole_heads(spark, sf_dir):
    names = ["feed_key", "well_formed", "title", "link", "subtitle", "language", "rights"]
    read = lambda name, *how: xml_feeds.feeds(whole_feeds(spark, sf_dir, *how), columns=names).select(F.lit(name).alias("kind"), *names)
    return read("rss1", "rss", 1.0).unionByName(read("rss2", "rss")).unionByName(read("atom", "atom"))


DIALECTS = [
    "EEE, dd MMM yy HH:mm:ss 'GMT'", "EEE, dd MMMM yyyy HH:mm:ss '+0000'", "EEE MMM dd HH:mm:ss 'UTC' yyyy", "EEE MMM dd HH:mm:ss yyyy", "MMMM d, yyyy hh:mm:ss a", "M/d/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'", "yyyyMMdd'T'HHmmss'Z'", "dd-MMM-yyyy HH:mm:ss",
]


@query(f"SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, floor(epoch(ts))::BIGINT + 18000 AS zoned, floor(epoch(date_trunc('minute', ts)))::BIGINT AS minutes, epoch(date_trunc('day', ts))::BIGINT AS ordinal, epoch(date_trunc('month', ts))::BIGINT AS month, event_id % {len(DIALECTS)} AS form FROM events")
def q_dates_dialects(spark, sf_dir):
    e, ts, form = event_entries(spark, sf_dir), F.col("ts"), F.col("event_id") % len(DIALECTS)
    text = F.date_format(ts, DIALECTS[0])
    for k, pattern in enumerate(DIALECTS[1:], 1):
        text = F.when(form == k, F.date_format(ts, pattern)).otherwise(text)
    of = lambda c: F.unix_timestamp(fields.parse_date(c))
    return e.select(
        "event_id", of(text).alias("seconds"), of(F.date_format(ts, "dd MMM yyyy HH:mm:ss 'EST'")).alias("zoned"), of(F.date_format(ts, "yyyy-MM-dd'T'HH:mm'Z'")).alias("minutes"), of(F.date_format(ts, "yyyy-DDD")).alias("ordinal"), of(F.date_format(ts, "yyyy-MM")).alias("month"), form.alias("form"),
    )


@query("SELECT event_id, floor(epoch(ts))::BIGINT + 32400 AS far, NULL::BIGINT AS unknown, epoch(date_trunc('day', ts))::BIGINT AS week_day, epoch(date_trunc('week', ts))::BIGINT AS week FROM events")
def q_dates_zones_weeks(spark, sf_dir):
    """Zones by name, also ones that nobody knows, and weeks."""
    e, ts = event_entries(spark, sf_dir), F.col("ts")
    of = lambda c: F.unix_timestamp(fields.parse_date(c))
    clock = F.date_format(ts, "dd MMM yyyy HH:mm:ss")
    number = F.lpad(F.weekofyear(ts).cast("string"), 2, "0")
    year = F.year(F.date_add(F.date_trunc("week", ts).cast("date"), 3)).cast("string")  # a week is of its Thursday's year
    day = F.concat(year, F.lit("-W"), number, F.lit("-"), (F.weekday(ts) + 1).cast("string"))
    return e.select("event_id", of(F.concat(clock, F.lit(" AKST"))).alias("far"), of(F.concat(clock, F.lit(" QQT"))).alias("unknown"), of(day).alias("week_day"), of(F.concat(year, F.lit("W"), number)).alias("week"))


@query("SELECT c_custkey, 'T' || c_custkey AS title, 'http://h.example.org/' || c_custkey AS link, 1.1::DOUBLE AS feed_version FROM customer")
def q_rss11(spark, sf_dir):
    """RSS 1.1: entries inside ``items``, with a prefix bound to its namespace."""
    k = F.col("c_custkey").cast("string")
    item = F.concat(F.lit("<r:items><r:item><r:title>T"), k, F.lit("</r:title><r:link>http://h.example.org/"), k, F.lit("</r:link></r:item></r:items>"))
    xml = F.concat(F.lit('<r:Channel xmlns:r="http://purl.org/net/rss1.1#"><r:title>F</r:title>'), item, F.lit("</r:Channel>"))
    e = xml_feeds.entries(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feed_key"), xml.alias("xml")), columns=["feed_key", "title", "link", "feed_version"])
    return e.select(F.col("feed_key").alias("c_custkey"), "title", "link", "feed_version")


@query("SELECT page_id, pos::INT AS pos, 'http://h.example.org/' || CASE pos % 4 WHEN 0 THEN 'a/d' WHEN 1 THEN 'a/b/d' WHEN 2 THEN 'd?x=../y' ELSE 'a/b/c/' END || page_id AS href FROM pages, range(4) AS r(pos)")
def q_resolve_dots(spark, sf_dir):
    k = F.col("page_id").cast("string")
    refs = F.array(F.concat(F.lit("../d"), k), F.concat(F.lit("./x/../d"), k), F.concat(F.lit("../../../d?x=../y"), k), F.concat(F.lit("c/./e/../"), k))
    rows = pages(spark, sf_dir).select("page_id", F.posexplode(refs).alias("pos", "ref"))
    return rows.select("page_id", "pos", uri.resolve(F.lit("http://h.example.org/a/b/page.html"), F.col("ref")).alias("href"))


@query("SELECT page_id, 'http://h.example.org/' || repeat('s/', 120 - 100 + page_id % 3) || 'z' AS href FROM pages")
def q_resolve_many_dots(spark, sf_dir):
    """A hundred parent segments after a hundred and twenty folders."""
    n = (F.col("page_id") % 3).cast("int")
    ref = F.concat(F.repeat(F.lit("s/"), n + 120), F.repeat(F.lit("../"), F.lit(100)), F.lit("./z"))
    return pages(spark, sf_dir).select("page_id", uri.resolve(F.lit("http://h.example.org/page.html"), ref).alias("href"))


SCHEMES = ["FEED://", "Feed:https://", "https:/", "feed:", "RSS:http:///", "http:feed://", "HTP:/", "mms://", "http://http://", ""]


@query(f"SELECT page_id, k, CASE WHEN contains(lower(k), 'https') THEN 'https://' ELSE 'http://' END || regexp_extract(url, '://([^/?#]*)', 1) || '/' || page_id AS url FROM pages, unnest({SCHEMES}) AS x(k)")
def q_url_schemes(spark, sf_dir):
    """Every spelling of a feed reader's scheme, in any case and with any number of slashes; https stays."""
    rows = pages(spark, sf_dir).select("page_id", F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("/"), F.col("page_id").cast("string")).alias("rest"), F.explode(F.array(*map(F.lit, SCHEMES))).alias("k"))
    return rows.select("page_id", "k", uri.normalize_url(F.concat("k", "rest")).alias("url"))


#: International names and their ASCII form, from the registries' own examples; fixed values.
IDN = {"bücher": "xn--bcher-kva", "München": "xn--mnchen-3ya", "詹姆斯": "xn--8ws00zhy3a", "παράδειγμα": "xn--hxajbheg2az3al", "пример": "xn--e1afmkfd", "例え": "xn--r8jz45g", "plain": "plain"}


@query(f"SELECT page_id, 'http://' || ({list(IDN.values())})[1 + page_id % {len(IDN)}] || '.example.org/' || page_id || '/%E8%A9%B9' AS url FROM pages")
def q_url_idn(spark, sf_dir):
    """International host names and paths in ASCII."""
    name = F.element_at(F.array(*map(F.lit, IDN)), (F.col("page_id") % len(IDN) + 1).cast("int"))
    return pages(spark, sf_dir).select("page_id", uri.canonical_url(F.concat(name, F.lit(".example.org/"), F.col("page_id").cast("string"), F.lit("/詹"))).alias("url"))


@query("SELECT page_id, 'http://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || '/x?Q=' || page_id AS url FROM pages")
def q_url_canonical(spark, sf_dir):
    """Case, default ports and dot segments."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return pages(spark, sf_dir).select("page_id", uri.canonical_url(F.concat(F.lit("HTTP://"), F.upper(host), F.lit(":80/a/../x?Q="), F.col("page_id").cast("string"))).alias("url"))


@query("""SELECT doc_id, '<p>' || doc_id || '<a>x</a><a href="http://h.example.org/q">y</a><img src="http://h.example.org/i.png"> end</p>' AS html FROM documents""")
def q_sanitize_scripts(spark, sf_dir):
    """Scripts in elements, attributes and addresses go; the rest stays."""
    k = F.col("doc_id").cast("string")
    bad = '<a href="java&#9;script:alert(1)" onclick="x()">x</a><script>alert("<p>")</script><svg><a xlink:href="javascript:x">s</a></svg><a href="/q" style="x">y</a><img src="i.png" formaction="javascript:x"><iframe src="z">w</iframe> end</p>'
    return table(spark, sf_dir, "documents").select("doc_id", shred.sanitize(F.concat(F.lit("<p>"), k, F.lit(bad)), F.lit("http://h.example.org/p")).alias("html"))


@query("""SELECT 'http://h.example.org/' || o_custkey AS href, o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'New ' ELSE 'Order ' END || o_orderkey || '[7]' AS title FROM orders WHERE o_custkey % 7 <> 1""")
def q_parsed_cache(spark, sf_dir):
    """Customers' feeds cached, then one in five changed and parsed again, and one in seven forgotten."""
    from feedloom.sources.parsed import ParsedCache
    from feedloom.sources.tables import shared_path

    href = F.concat(F.lit("http://h.example.org/"), F.col("feed_key").cast("string"))
    docs = customer_feeds(spark, sf_dir).select("feed_key", href.alias("href"), "xml")
    cache = ParsedCache(spark, shared_path(spark, "parsed"), ["doc_pos", "title"], buckets=16)
    cache.update(docs)
    cache.update(docs.withColumn("xml", F.when(F.col("feed_key") % 5 == 0, F.replace("xml", F.lit("<title>Order "), F.lit("<title>New "))).otherwise(F.col("xml"))))
    cache.forget(docs.filter("feed_key % 7 = 1").select("href"))
    return cache.entries().select("href", F.regexp_extract("title", r"\d+", 0).cast("long").alias("o_orderkey"), "title")


@query("""SELECT c_custkey, ' c' || c_custkey || ' ' AS comment, 'n="' || c_custkey || '"' AS instruction, 'urn:' || c_custkey AS space, 'x' || c_custkey || 'z' AS value, 3::BIGINT AS nodes FROM customer""")
def q_xpath_kinds(spark, sf_dir):
    """Comments, instructions and namespaces by path, and texts between elements in their order."""
    k = F.col("c_custkey").cast("string")
    xml = F.concat(F.lit('<?style n="'), k, F.lit('"?><!-- c'), k, F.lit(' --><a xmlns:p="urn:'), k, F.lit('"><b>x<c>'), k, F.lit("</c>z</b></a>"))
    rows = shred.shredded(table(spark, sf_dir, "customer").select("c_custkey", xml.alias("xml")))
    of = lambda p: xpath.find(F.col("nodes"), p)
    return rows.select("c_custkey", of("//comment()").alias("comment"), of("/processing-instruction('style')").alias("instruction"), of("b/c/namespace::p").alias("space"), of("b").alias("value"), of("count(//*)").cast("long").alias("nodes"))


SPACES = 'xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:media="http://search.yahoo.com/mrss/" xmlns:dc="http://purl.org/dc/elements/1.1/"'


def filled(template, **values):
    """A template with columns in place of ``{name}``."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else values[p] for i, p in enumerate(parts) if p])


FEED_ALL = (
    f'<rss version="2.0" {SPACES} xml:base="http://h.example.org/a/"><channel><id>urn:c:{{k}}</id><title>F{{k}}</title><link>http://h.example.org/{{k}}</link><link rel="SELF" type="Application/RSS+XML" href="feed{{k}}.xml" hreflang="DE"/>'
    '<link rel="shortcut icon" href="/i{k}.ico"/><itunes:author>A &amp;amp; {k}</itunes:author><itunes:summary>&lt;b&gt;S{k}&lt;/b&gt;&lt;script&gt;x&lt;/script&gt;</itunes:summary><itunes:subtitle>sub {k}</itunes:subtitle><media:text>mt {k}</media:text>'
    "<pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><lastBuildDate>{built}</lastBuildDate><category domain=\"d\">cat {k}</category><category>plain</category>"
    "<image><title>I</title><url>/img{k}.png</url><link>l{k}</link><width>10</width><height>0</height></image><logo>logo.png</logo>"
    '<cloud domain="d.example.org" port="0" path="/p{k}" registerProcedure="r" protocol="soap"/><textInput><title>t</title><description>d</description><name>q{k}</name><link>/find</link></textInput></channel></rss>'
)


@query("""SELECT c_custkey AS feed_key, 'urn:c:' || c_custkey AS id, 'http://h.example.org/a/feed' || c_custkey || '.xml' AS href, 'http://h.example.org/' || c_custkey AS link, 3 AS n_links, 'self|application/rss+xml|de' AS self_link, 'http://h.example.org/i' || c_custkey || '.ico' AS icon,
'A & ' || c_custkey AS itunes_author, '<b>S' || c_custkey || '</b>' AS itunes_summary, 'sub ' || c_custkey AS itunes_subtitle, 'mt ' || c_custkey AS media_text, 1700000000 + c_custkey AS time, 1700000000 + c_custkey AS updated, 1704164645::BIGINT AS published,
'cat ' || c_custkey || '|d;plain|' AS categories, 'http://h.example.org/img' || c_custkey || '.png|l' || c_custkey || '|10||;http://h.example.org/a/logo.png||||' AS images, 'd.example.org/p' || c_custkey || '||r' AS cloud, 't|d|q' || c_custkey || '|/find' AS text_input FROM customer""")
def q_feed_columns(spark, sf_dir):
    """Every column that a feed itself says."""
    c = table(spark, sf_dir, "customer")
    built = F.date_format(F.timestamp_seconds(F.col("c_custkey") + 1700000000), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    docs = c.select(F.col("c_custkey").alias("feed_key"), filled(FEED_ALL, k=F.col("c_custkey").cast("string"), built=built).alias("xml"))
    f = xml_feeds.feeds(docs, columns=["feed_key", "id", "href", "link", "links", "icon", "itunes_author", "itunes_summary", "itunes_subtitle", "media_text", "time", "updated", "published", "categories", "images", "cloud", "text_input"])
    say = lambda *cs: F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in cs])
    own = F.get(F.filter("links", lambda x: x["rel"] == "self"), F.lit(0))
    return f.select(
        "feed_key", "id", "href", "link", F.size("links").alias("n_links"), say(own["rel"], own["type"], own["hreflang"]).alias("self_link"), "icon", "itunes_author", "itunes_summary", "itunes_subtitle", "media_text",
        *[F.unix_timestamp(t).alias(t) for t in ("time", "updated", "published")], F.array_join(F.transform("categories", lambda x: say(x["term"], x["scheme"])), ";").alias("categories"),
        F.array_join(F.transform("images", lambda x: say(x["href"], x["link"], x["width"], x["height"], x["style"])), ";").alias("images"), F.concat("cloud.domain", "cloud.path", F.lit("|"), F.coalesce(F.col("cloud.port").cast("string"), F.lit("")), F.lit("|"), "cloud.register_procedure").alias("cloud"),
        say(*[F.col(f"text_input.{x}") for x in ("title", "description", "name", "link")]).alias("text_input"),
    )


ENTRY_ALL = (
    f'<rss version="2.0" {SPACES} xml:base="http://h.example.org/a/"><channel><item><title>2024-01-0{{d}} 10:20:30</title><itunes:summary>S {{k}}</itunes:summary><itunes:subtitle>sub {{k}}</itunes:subtitle><media:text>mt {{k}}</media:text>'
    '<category domain="d">cat {k}</category><image><url>/img{k}.png</url></image><itunes:image href="http://h.example.org/art{k}"/><media:thumbnail url="http://h.example.org/th{k}"/><source url="http://o.example.org/{k}">Other {k}</source>'
    '<itunes:explicit>yes</itunes:explicit><enclosure url="http://m.example.org/{k}.mp3" length="5" type="audio/x"/><link rel="enclosure" href="http://m.example.org/{k}.mp3" length="9" type="audio/mpeg"/><video>http://m.example.org/{k}.wmv</video></item>'
    '<item><enclosure url="http://m.example.org/only{k}.mp3" length="5" type="audio/mpeg"/></item></channel></rss>'
)


@query("""SELECT c_custkey AS feed_key, 0 AS doc_pos, 'S ' || c_custkey AS itunes_summary, 'sub ' || c_custkey AS itunes_subtitle, 'mt ' || c_custkey AS media_text, 'cat ' || c_custkey || '|d' AS categories, 'http://h.example.org/img' || c_custkey || '.png' AS images,
'http://h.example.org/art' || c_custkey AS itunes_image_link, 'http://h.example.org/th' || c_custkey AS media_thumbnail_link, 'http://o.example.org/' || c_custkey || '|Other ' || c_custkey AS source, 1704104430 + 86400 * (c_custkey % 9) AS time,
'http://m.example.org/' || c_custkey || '.mp3|audio/mpeg|9|true;http://m.example.org/' || c_custkey || '.wmv|video/x-ms-wmv||true' AS enclosures, 'http://m.example.org/' || c_custkey || '.mp3' AS links FROM customer
UNION ALL SELECT c_custkey, 1, NULL, NULL, NULL, '', '', NULL, NULL, NULL, NULL, 'http://m.example.org/only' || c_custkey || '.mp3|audio/mpeg|5|false', 'http://m.example.org/only' || c_custkey || '.mp3' FROM customer""")
def q_entry_columns(spark, sf_dir):
    """Columns of podcasts and media, enclosures of three kinds merged, a title that is a date, and a link from an enclosure."""
    c = table(spark, sf_dir, "customer")
    docs = c.select(F.col("c_custkey").alias("feed_key"), filled(ENTRY_ALL, k=F.col("c_custkey").cast("string"), d=(F.col("c_custkey") % 9 + 1).cast("string")).alias("xml"))
    e = xml_feeds.entries(docs, columns=["feed_key", "doc_pos", "itunes_summary", "itunes_subtitle", "media_text", "categories", "images", "itunes_image_link", "media_thumbnail_link", "source", "time", "enclosures", "links"])
    say = lambda *cs: F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in cs])
    many = lambda name, *fs: F.array_join(F.transform(name, lambda x: say(*[x[f] for f in fs])), ";").alias(name)
    return e.select(
        "feed_key", "doc_pos", "itunes_summary", "itunes_subtitle", "media_text", many("categories", "term", "scheme"), many("images", "href"), "itunes_image_link", "media_thumbnail_link", F.when(F.col("source.href").isNotNull(), say(F.col("source.href"), F.col("source.title"))).alias("source"),
        F.unix_timestamp("time").alias("time"), many("enclosures", "href", "type", "file_size", "explicit"), many("links", "href"),
    )


@query("""SELECT c_custkey, 'two' AS first_text, 2 AS n_first, 3 AS n_all, 'k' || c_custkey AS by_space, 'x|' || c_custkey AS united, 'c,b,a' AS reversed FROM customer""")
def q_xpath_chains(spark, sf_dir):
    """Ordered paths: the first value that isn't blank nor refused, the first that gives elements, all of them; namespaces given by the caller."""
    xml = filled('<r xmlns:p="urn:own"><a> </a><b>one</b><b>two</b><i n="x"/><i n="{k}"/><p:s>k{k}</p:s><l>a</l><l>b</l><l>c</l></r>', k=F.col("c_custkey").cast("string"))
    rows = shred.shredded(table(spark, sf_dir, "customer").select("c_custkey", xml.alias("xml")))
    n = F.col("nodes")
    return rows.select(
        "c_custkey", xpath.try_paths(n, ["a", "none", "b"], reject=lambda x: x == "one").alias("first_text"), F.size(xpath.try_paths_all(n, ["none", "b", "l"])).alias("n_first"), F.size(xpath.combine_paths_all(n, ["b", "a", "b"])).alias("n_all"),
        xpath.find(n, "q:s", namespaces={"q": "urn:own"}).alias("by_space"), F.array_join(xpath.find_all(n, "i[1]/@n | i[2]/@n"), "|").alias("united"), F.array_join(F.reverse(xpath.find_all(n, "l")), ",").alias("reversed"),
    )


CONTENTS = [
    ('<content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml">Hi <b>{k}</b></div></content>', "'Hi <b>' || c_custkey || '</b>'"),
    ('<content type="xhtml"><x:div xmlns:x="http://www.w3.org/1999/xhtml">a<x:i>{k}</x:i></x:div></content>', "'a<i>' || c_custkey || '</i>'"),
    ('<content type="html">&lt;p&gt;{k}&lt;script&gt;x&lt;/script&gt;&lt;/p&gt;</content>', "'<p>' || c_custkey || '</p>'"),
    ('<content type="html" mode="base64">{b64}</content>', "'<i>' || c_custkey || '</i>'"),
    ('<content type="text">a &lt; {k}</content>', "'a &lt; ' || c_custkey"),
    ('<content type="html">&lt;a href="../z{k}"&gt;l&lt;/a&gt;</content>', "'<a href=\"http://h.example.org/z' || c_custkey || '\">l</a>'"),
]


@query("SELECT c_custkey AS feed_key, CASE c_custkey % 6 " + " ".join(f"WHEN {k} THEN {sql_}" for k, (_, sql_) in enumerate(CONTENTS)) + " END AS html FROM customer")
def q_text_kinds(spark, sf_dir):
    """Text constructs of Atom: XHTML with and without prefix, escaped, base64 and plain, unwrapped, resolved and sanitised."""
    key = F.col("c_custkey").cast("string")
    body = F.lit(None).cast("string")
    for k, (xml, _) in enumerate(CONTENTS):
        body = F.when(F.col("c_custkey") % 6 == k, filled(xml, k=key, b64=F.base64(F.encode(F.concat(F.lit("<i>"), key, F.lit("</i>")), "UTF-8")))).otherwise(body)
    doc = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xml:base="http://h.example.org/a/"><entry>'), body, F.lit("</entry></feed>"))
    e = xml_feeds.entries(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feed_key"), doc.alias("xml")), columns=["feed_key", "content_html"])
    return e.select("feed_key", F.col("content_html").alias("html"))


@query("""SELECT c_custkey AS feed_key, 'http://h.example.org/i' || c_custkey AS image, 'l' AS image_link, 'x, t' || c_custkey AS keywords FROM customer""")
def q_write_podcasts(spark, sf_dir):
    """The writer's choice of an image, one with a link, and the keywords of a podcast's entries."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    image = lambda href, link: F.struct(F.lit("I").alias("title"), href.alias("href"), link.alias("link"))
    none = F.lit(None).cast("string")
    heads = c.select(F.col("c_custkey").alias("feed_key"), F.lit("T").alias("title"), F.lit("http://h.example.org/").alias("link"), F.lit("s").alias("subtitle"), F.array(image(F.lit("http://h.example.org/no"), none), image(F.concat(F.lit("http://h.example.org/i"), k), F.lit("l"))).alias("images"))
    parcel = F.struct(F.concat(F.lit("http://m.example.org/"), k).alias("href"), F.lit("audio/mpeg").alias("type"), F.lit(9).cast("long").alias("file_size"))
    items = c.select(F.col("c_custkey").alias("feed_key"), F.lit(0).alias("doc_pos"), k.alias("id"), k.alias("title"), F.lit("http://h.example.org/").alias("link"), F.lit("c").alias("content"), F.timestamp_seconds(F.lit(0)).alias("time"), F.array(F.lit("x"), F.concat(F.lit("t"), k)).alias("tags"), F.array(parcel).alias("enclosures"))
    rows = shred.shredded(xml_feeds.write_xml(heads, items))
    of = lambda p: xpath.find(F.col("nodes"), p)
    return rows.select("feed_key", of("channel/image/url").alias("image"), of("channel/image/link").alias("image_link"), of("channel/item/itunes:keywords").alias("keywords"))


@query("SELECT page_id, k, title || ' ü' AS title FROM (SELECT page_id, coalesce(regexp_extract(html, '<title>([A-Za-z0-9 ]+)', 1), '') AS title FROM pages), unnest(['iso-8859-1', 'utf-8', 'utf-16', 'windows-1252', 'none']) AS x(k) WHERE title <> ''")
def q_decoded_bytes(spark, sf_dir):
    """Documents as bytes in five encodings, decoded by the name that their declaration gives, or as UTF-8."""
    p = pages(spark, sf_dir).select("page_id", F.regexp_extract("html", "<title>([A-Za-z0-9 ]+)", 1).alias("t")).filter("t <> ''")
    rows = p.select("page_id", "t", F.explode(F.array(*map(F.lit, ["iso-8859-1", "utf-8", "utf-16", "windows-1252", "none"]))).alias("k"))
    text_ = F.concat(F.lit("<rss><channel><title>"), "t", F.lit(" ü</title></channel></rss>"))
    data = F.when(F.col("k").isin("iso-8859-1", "windows-1252"), F.encode(text_, "ISO-8859-1")).when(F.col("k") == "utf-16", F.encode(text_, "UTF-16")).otherwise(F.encode(text_, "UTF-8"))
    named_ = F.when(F.col("k") != "none", F.col("k"))
    docs = rows.select(F.struct("page_id", "k").alias("feed_key"), shred.decode_bytes(data, named_).alias("xml"))
    f = xml_feeds.feeds(docs, columns=["feed_key", "title"])
    return f.select("feed_key.page_id", "feed_key.k", "title")


# --- SQL --------------------------------------------------------------------------------------------


@query("""SELECT o_custkey AS feed_key, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS doc_pos, 'Order ' || o_orderkey || '[7]' AS title, '../x/./o' || o_orderkey AS link, 'http://h.example.org/a/x/o' || o_orderkey AS whole,
CASE WHEN o_orderkey % 3 = 0 THEN floor(epoch(o_orderdate))::BIGINT END AS t, CASE WHEN o_orderkey % 3 = 0 THEN 'A' || o_orderkey END AS dc_subject FROM orders WHERE o_custkey IS NOT NULL""")
def q_sql_entries(spark, sf_dir):
    """Entries by a lateral join with a table function and functions by name, in SQL alone."""
    sql.register(spark)
    docs = customer_feeds(spark, sf_dir)
    docs.repartition(range_partitions(docs, 16 << 20)).createOrReplaceTempView("feed_documents")  # a lateral join stays in the tasks of its documents
    return spark.sql("""
        SELECT d.feed_key, e.doc_pos, e.title, best_link(e.links) AS link, resolve_url('http://h.example.org/a/b/', best_link(e.links)) AS whole, unix_timestamp(parse_date(e.stated)) AS t, e.dc_subject
        FROM feed_documents d, LATERAL feed_entries(d.xml, 'title, links, stated, dc:subject') e""")


@query(f"SELECT page_id, 'http://' || {HOST} || '/' AS url, {HOST} AS host, md5({PLAIN}) AS digest, trim(regexp_extract(html, '<title>([^<]*)', 1), ' ' || chr(9) || chr(10) || chr(13)) AS title FROM pages")
def q_sql_functions(spark, sf_dir):
    sql.register(spark)
    pages(spark, sf_dir).createOrReplaceTempView("web_pages")
    return spark.sql("""
        SELECT page_id, canonical_url(concat('FEED:', url_host(url))) AS url, url_host(url) AS host, md5(strip_tags(html)) AS digest, trim_space(regexp_extract(html, '<title>([^<]*)', 1)) AS title FROM web_pages""")


# --- streams ----------------------------------------------------------------------------------------


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def q_stream_dedup(spark, sf_dir):
    s = streams.read_events(spark, f"{sf_dir}/events.parquet")
    return streams.drain(streams.new_entries(s, ["user_id", "event_type"], "3650 days").select("user_id", "event_type"))


@query("SELECT event_type, floor(epoch(ts) / 3600)::BIGINT * 3600 AS hour, count(*) AS posts FROM events GROUP BY ALL")
def q_stream_windows(spark, sf_dir):
    s = streams.read_events(spark, f"{sf_dir}/events.parquet")
    return streams.drain(streams.posts_per_window(s, "event_type"), "complete").select("event_type", F.unix_timestamp(F.col("window.start")).alias("hour"), "posts")


POLLS = "(SELECT user_id, event_id, ts, (event_id % 4) * 3600 AS ttl, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"
#: Of the polls of each user in order those that come when the one taken before has expired.
TAKEN = f"""WITH RECURSIVE p AS {POLLS}, walk AS (
  SELECT user_id, event_id, ts, ttl, n, TRUE AS due, ts + to_seconds(greatest(ttl, 1800)) AS until FROM p WHERE n = 1
  UNION ALL
  SELECT p.user_id, p.event_id, p.ts, p.ttl, p.n, p.ts > w.until, CASE WHEN p.ts > w.until THEN p.ts + to_seconds(greatest(p.ttl, 1800)) ELSE w.until END FROM walk w JOIN p ON p.user_id = w.user_id AND p.n = w.n + 1)"""


def polls(spark, sf_dir):
    """Events as polls of their user's feed."""
    s = streams.read_events(spark, f"{sf_dir}/events.parquet")
    return s.select("user_id", "event_id", F.col("time").alias("last_retrieved"), ((F.col("event_id") % 4) * 3600).alias("time_to_live"))


@query(TAKEN + " SELECT user_id, event_id FROM walk WHERE due")
def q_stream_ttl(spark, sf_dir):
    """Polls that were due, by state with timers."""
    return streams.drain(streams.within_ttl(polls(spark, sf_dir), key="user_id")).select("user_id", "event_id")


@query(TAKEN + """ SELECT user_id, floor(epoch(ts))::BIGINT AS retrieved, floor(epoch(until))::BIGINT AS expired FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY n) AS next FROM walk WHERE due)
WHERE next IS NOT NULL OR until < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q_stream_expiries(spark, sf_dir):
    """When the polls taken expired: at the next one that was due, or by their timer."""
    out = streams.drain(streams.expiries(polls(spark, sf_dir), key="user_id"))
    return out.select("user_id", F.unix_timestamp("retrieved").alias("retrieved"), F.unix_timestamp("expired").alias("expired"))


@query("""SELECT user_id, count(*) AS posts, floor(epoch(min(ts)))::BIGINT AS first, floor(epoch(max(ts)))::BIGINT AS last FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, (ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + to_hours(1 + user_id % 3)) IS NOT FALSE AS gap, gap::INT AS fresh FROM events)) GROUP BY user_id, session""")
def q_stream_sessions(spark, sf_dir):
    """Sessions of each user with a gap of one to three hours, by user."""
    s = streams.read_events(spark, f"{sf_dir}/events.parquet")
    gap = F.concat((F.col("user_id") % 3 + 1).cast("string"), F.lit(" hours"))
    out = streams.drain(streams.sessions(s, "user_id", gap), "complete")
    return out.select("user_id", "posts", F.unix_timestamp("first").alias("first"), F.unix_timestamp("last").alias("last"))


#: Which of four deliveries brings an event: the quarter of its month, but one in fifty comes with the last.
DELIVERY = "CASE WHEN event_id % 50 = 0 THEN 3 ELSE least(3, floor((day(ts) - 1) / 8))::INT END"


@query(f"""SELECT event_id, coalesce(ts < (SELECT max(ts) FROM events o WHERE {DELIVERY.replace('event_id', 'o.event_id').replace('(ts)', '(o.ts)')} < e.d) - INTERVAL 2 HOURS, ts IS NULL) AS late
FROM (SELECT event_id, ts, {DELIVERY} AS d FROM events) e""")
def q_stream_late(spark, sf_dir):
    """Events delivered in four batches, those that come too late apart."""
    from feedloom.sources.tables import shared_path

    e = table(spark, sf_dir, "events").withColumn("time", F.col("ts").cast("timestamp"))
    dealt = F.when(F.col("event_id") % 50 == 0, 3).otherwise(F.least(F.lit(3), F.floor((F.day("ts") - 1) / 8))).cast("int")
    folder, on_time, late = (shared_path(spark, t) for t in ("deliveries", "on-time", "late"))
    for k in range(4):
        e.filter(dealt == k).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    streams.split_late(stream, on_time, late, shared_path(spark, "progress"), available_now=True).awaitTermination()
    read = lambda path, flag: spark.read.parquet(path).select("event_id", F.lit(flag).alias("late"))
    return read(on_time, False).unionByName(read(late, True))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planet feed: written as RSS, parsed back, times estimated, newest first."""
    rows = xml_feeds.entries(feed_docs(spark, sf_dir, "rss"), columns=["feed_key", "doc_pos", "id", "title", "link", "time"])
    return relate.ranked(relate.estimate_times(rows, F.lit(AS_OF).cast("timestamp")))


