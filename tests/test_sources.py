"""Paths, media, HTTP reading with conditions and redirects, the cache, settings."""

import os
import shutil
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from feedloom.config import DEFAULTS
from feedloom.functions import fields, uri, xpath
from feedloom.plans import catalogue
from feedloom.sources import fetch, shred, source
from feedloom.sources.feeds import entries, feeds, read_saved, save_feeds, write_xml
from feedloom.sources.shred import shredded
from feedloom.streaming import streams

DOC = (
    '<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>T</title><Item id="a"><title>one</title><n>3</n><dc:creator>me</dc:creator></Item>'
    '<item id="b"><title>two</title><n>4</n></item><item ID="c"><title>three</title><n>5</n></item></channel></rss>'
)
PATHS = {
    "channel/item/title": ["one", "two", "three"],
    "//title": ["T", "one", "two", "three"],
    "/rss/channel/item[2]/title": ["two"],
    "//item[@id='b']/n": ["4"],
    "//item[n>3]/title": ["two", "three"],
    "//item/@id": ["a", "b", "c"],
    "count(//item)": ["3"],
    "//item[last()]/title": ["three"],
    "//item[position()<3]/@id": ["a", "b"],
    "//dc:creator": ["me"],
    "//title[.='two']/following::n": ["4", "5"],
    "//item[@id='c']/preceding-sibling::item[1]/title": ["two"],
    "sum(//n) div 3": ["4"],
    "concat(//item[1]/title,'-',local-name(/rss/channel))": ["one-channel"],
    "//item[contains(title,'o') and not(@id='a')]/title": ["two"],
    "//item[title='one' or n=5]/@id": ["a", "c"],
    "substring-after('a:b',':')": ["b"],
    "//n/ancestor::channel/title": ["T"],
    "(//title)[2]": ["one"],
    "-2 + 3 * 2": ["4"],
    "//none": [],
}


def test_paths(spark):
    docs = shredded(spark.createDataFrame([(1, DOC), (2, "nothing"), (3, None)], "k int, xml string"))
    n = F.col("nodes")
    row = docs.filter("k = 1").select(*[xpath.find_all(n, p).alias(f"c{i}") for i, p in enumerate(PATHS)]).first()
    assert dict(zip(PATHS, row, strict=True)) == PATHS
    got = docs.orderBy("k").select(xpath.try_paths(n, ["//none", "//title"]), xpath.combine_paths_all(n, ["//item", "//none", "//item"]), xpath.find(n, "//title")).collect()
    assert got[0][0] == "T" and len(got[0][1]) == 3
    assert got[1][2] is None and got[2][2] is None
    for bad in ("//item[", "sideways::x", "fly(1)", "//a]", "a b"):
        with pytest.raises(ValueError):
            xpath.find(n, bad)


def test_media(spark):
    xml = (
        '<rss xmlns:media="http://search.yahoo.com/mrss/"><channel><item><enclosure url="http://h/a.mp3" length="7" type="audio/mpeg"/>'
        '<media:content url="http://h/a.mp3" duration="12" expression="SAMPLE"/><media:content url="http://h/b.mp4" medium="video" fileSize="0"><media:adult>true</media:adult></media:content></item><item/></channel></rss>'
    )
    rows = entries(spark.createDataFrame([("f", xml)], "feed_key string, xml string")).orderBy("doc_pos").select("enclosures").collect()
    a, b = rows[0][0]
    assert (a["href"], a["file_size"], a["duration"], a["expression"], a["type"]) == ("http://h/a.mp3", 7, 12, "sample", "audio/mpeg")
    assert (b["href"], b["file_size"], b["explicit"]) == ("http://h/b.mp4", None, True)
    assert rows[1][0] == []


FEED = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:media="http://search.yahoo.com/mrss/" xml:base="http://h.example.org/b/">
<title>1 &lt; 2</title><subtitle type="html">a &lt;b&gt;c&lt;/b&gt;</subtitle><link href="/"/><link rel="self" href="http://h.example.org/feed.xml"/><link rel="license" href="http://l.example.org/by"/>
<link rel="logo" type="image/png" href="/logo.png"/><icon>/i.ico</icon><logo>/big.png</logo><itunes:summary>S</itunes:summary><itunes:author>A &amp;amp; B</itunes:author>
<entry><id>x</id><title type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml">an <em>x</em></div></title><content type="html"><![CDATA[<p><a href="c">d</a><script>e</script></p>]]></content>
<media:thumbnail url="http://h.example.org/t.png"/><itunes:image href="http://h.example.org/u.png"/></entry>
<entry><id>y</id><content type="text/html" mode="base64">PGI+aGk8L2I+</content><source url="http://o.example.org/">O</source></entry><entry/></feed>"""
CHANNEL = """<rss version="2.0"><channel><title>T</title><link>http://h.example.org/</link><cloud domain="d" port="80" path="/p" registerProcedure="r" protocol="soap"/><textInput><title>t</title><name>q</name></textInput>
<image><url>http://h.example.org/i.png</url><width>12</width><height>0</height><style>BIG</style></image></channel></rss>"""


def test_columns(spark):
    docs = spark.createDataFrame([("a", FEED), ("b", CHANNEL), ("c", None), ("d", "junk")], "feed_key string, xml string")
    f = {r["feed_key"]: r for r in feeds(docs).collect()}
    a, b = f["a"], f["b"]
    assert (a["title"], a["title_html"], a["subtitle_html"]) == ("1 < 2", "1 &lt; 2", "a <b>c</b>")
    assert (a["href"], a["link"], a["license"], a["icon"], a["favicon"]) == ("http://h.example.org/feed.xml", "http://h.example.org/", "http://l.example.org/by", "http://h.example.org/i.ico", "http://h.example.org/favicon.ico")
    assert (a["itunes_summary"], a["itunes_author"]) == ("S", "A & B")
    assert [i["href"] for i in a["images"]] == ["http://h.example.org/big.png", "http://h.example.org/logo.png"]
    assert b["cloud"].asDict() == {"domain": "d", "path": "/p", "port": 80, "protocol": "soap", "register_procedure": "r"}
    assert (b["text_input"]["title"], b["text_input"]["name"]) == ("t", "q")
    assert (b["images"][0]["width"], b["images"][0]["height"], b["images"][0]["style"]) == (12, None, "big")
    assert f["c"]["title"] is None and f["d"]["title_html"] is None
    x, y, z = entries(docs).orderBy("doc_pos").collect()
    assert x["title_html"] == "an <em>x</em>" and x["content_html"] == '<p><a href="http://h.example.org/b/c">d</a></p>'
    assert (x["media_thumbnail_link"], x["itunes_image_link"]) == ("http://h.example.org/t.png", "http://h.example.org/u.png")
    assert y["content_html"] == "<b>hi</b>" and (y["source"]["href"], y["source"]["title"]) == ("http://o.example.org/", "O")
    assert z["content_html"] is None and z["images"] == [] and z["licenses"] == []
    assert entries(docs, columns=["id"]).columns == ["id"]
    with pytest.raises(ValueError):
        entries(docs, columns=["colour"])


class Site(BaseHTTPRequestHandler):
    hits: list = []

    def do_GET(self):
        type(self).hits.append((self.path, self.headers.get("If-None-Match")))
        if self.path == "/feed" and self.headers.get("If-None-Match") == "v1":
            return self.answer(304)
        if self.path == "/feed":
            return self.answer(200, DOC, ("ETag", "v1"))
        if self.path == "/page":
            return self.answer(200, '<html><head><link rel="alternate" type="application/rss+xml" href="/feed"></head></html>')
        if self.path == "/old":
            return self.answer(200, f"<redirect><newLocation>http://{self.headers['Host']}/feed</newLocation></redirect>")
        moves = {"/moved": (301, "/feed"), "/for-now": (302, "/moved"), "/circle": (302, "/circle"), "/file": (302, "file:///etc/hostname")}
        if self.path in moves:
            return self.answer(moves[self.path][0], "", ("Location", moves[self.path][1]))
        return self.answer(404, "gone")

    def answer(self, status, text="", *headers):
        body = text.encode()
        self.send_response(status)
        for k, v in (*headers, ("Content-Length", str(len(body)))):
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(spark, site):
    paths = ["/feed", "/moved", "/for-now", "/circle", "/file", "/none"]
    urls = spark.createDataFrame([(site + p,) for p in paths] + [(None,), ("gopher://x/",)], "href string")
    got = {r["href"].removeprefix(site): r for r in fetch.fetch(urls).collect()}
    assert got["/feed"]["status"] == 200 and got["/feed"]["headers"]["etag"] == "v1"
    assert got["/moved"]["final_href"] == site + "/feed"
    assert got["/for-now"]["final_href"] == site + "/for-now" and got["/for-now"]["status"] == 200
    assert "circle" in got["/circle"]["error"] and "scheme" in got["/file"]["error"] and "scheme" in got["gopher://x/"]["error"]
    assert got["/none"]["status"] == 404 and len(got) == 7


def test_open_and_cache(spark, site, tmp_path):
    cache = fetch.FeedCache(spark, str(tmp_path / "cache"))
    assert not cache.connected()
    urls = spark.createDataFrame([(site + p,) for p in ("/feed", "/page", "/old", "/none")], "href string")
    at = lambda t: F.timestamp_seconds(F.lit(t))
    cache.save(fetch.open_feeds(urls, cache.read(), at(1_000_000)))
    assert {r["href"].removeprefix(site) for r in cache.read().collect()} == {"/feed", "/page", "/old"}
    assert all(r["feed_data"] == DOC for r in cache.read().collect())
    Site.hits.clear()
    fetch.open_feeds(urls.limit(1), cache.read(), at(1_000_100)).collect()
    assert Site.hits == []  # fresh: nobody is asked
    later = fetch.open_feeds(urls.filter(F.col("href").endswith("/feed")), cache.read(), at(1_100_000)).collect()
    assert Site.hits == [("/feed", "v1")] and later[0]["feed_data"] == DOC and later[0]["last_retrieved"].timestamp() == 1_100_000
    cache.expire(site + "/feed")
    assert cache.find_by(href=site + "/feed").first()["last_retrieved"].timestamp() == 0
    with pytest.raises(ValueError):
        cache.find_by(colour="red")


def test_feed_format(spark, site, tmp_path):
    source.register(spark)
    urls = f"{site}/feed {site}/moved {site}/none gopher://x/"
    rows = {r.href.removeprefix(site): r for r in spark.read.format("feed").option("urls", urls).option("http_timeout", "5").load().collect()}
    assert rows["/feed"].feed_data == DOC and rows["/moved"].final_href == site + "/feed" and rows["/none"].status == 404 and "scheme" in rows["gopher://x/"].error
    with pytest.raises(Exception, match="addresses"):
        spark.read.format("feed").load().collect()
    out = str(tmp_path / "polled")
    polls = spark.readStream.format("feed").option("urls", f"{site}/feed").load().select("href", "status")
    query = polls.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    while len(query.recentProgress) < 3:
        time.sleep(0.2)
    query.stop()
    assert spark.read.parquet(out).count() >= 2


def test_ttl_state_and_upsert(spark, tmp_path):
    at = [0, 600, 1801, 3000, 3700, 9000, 9001, 30000]
    rows = spark.createDataFrame([("a", t, 3600) for t in at] + [("b", 5, None)], "href string, t long, time_to_live long")
    rows = rows.select("href", F.timestamp_seconds("t").alias("last_retrieved"), "time_to_live", F.lit("T").alias("title"), F.lit("l").alias("link"), F.lit("<rss/>").alias("feed_data"), F.lit("xml").alias("feed_data_type"), F.lit(None).cast("map<string,string>").alias("http_headers"))
    rows.coalesce(1).write.parquet(str(tmp_path / "polls"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "polls"))
    kept = streams.drain(streams.within_ttl(stream)).orderBy("href", "last_retrieved").collect()
    want, last = [], None
    for t in at:
        if last is None or t - last > 3600:
            want.append(("a", t))
            last = t
    assert [(r.href, int(r.last_retrieved.timestamp())) for r in kept] == [*want, ("b", 5)]
    cache = fetch.FeedCache(spark, str(tmp_path / "cache"))
    streams.upsert_into(stream.filter("href = 'a'"), cache, str(tmp_path / "k"), available_now=True).awaitTermination()
    saved = cache.read().collect()
    assert [(r.href, int(r.last_retrieved.timestamp())) for r in saved] == [("a", 30000)]


def test_deep_nesting_and_scripts():
    import time as clock

    began = clock.process_time()
    out = shred.shred_one("<rss><channel>" + "<div>" * 90_000 + "x")
    assert len(out["nodes"]) == 90_002 and sum(len(n["inner"] or "") for n in out["nodes"]) < 2_000_000 and clock.process_time() - began < 4
    for bad in ('<a href="java&#9;script:alert(1)">x</a>', '<input formaction="javascript:1">', '<a xlink:href="javascript:x">z</a>', "<svg><a>q</a></svg>", "<math>u</math>", "<script>alert(1)", "<p onclick=a>y</p>", '<img src="data:x">'):
        cleaner = shred.Cleaner("http://h.example.org/")
        cleaner.feed(bad)
        cleaner.close()
        assert not any(w in "".join(cleaner.out) for w in ("script", "svg", "math", "onclick", "data:")), bad


def test_settings():
    assert DEFAULTS.with_options(max_ttl=5).max_ttl == 5
    with pytest.raises(ValueError):
        DEFAULTS.with_options(colour="red")


def test_writing_refuses_denied_feeds_and_entries(spark):
    heads = spark.createDataFrame([("a", "A", None, None)], "feed_key string, title string, link string, subtitle string")
    items = spark.createDataFrame([("a", i, str(i), f"t{i}", None, None, None) for i in range(2)], "feed_key string, doc_pos int, id string, title string, link string, content string, time timestamp")
    for kind, version in (("rss", 2.0), ("rss", 1.0), ("atom", 1.0)):
        write = lambda **guards: write_xml(heads, items, kind, version, **guards).collect()  # noqa: B023, E731
        assert write(denied=F.col("feed_key") == "b", denied_entries=F.col("id") == "9")[0].xml.count("<title>") == 3
        for guards in ({"denied": F.col("feed_key") == "a"}, {"denied_entries": F.col("id") == "1"}):
            with pytest.raises(Exception, match="may not be redistributed"):
                write(**guards)


def test_guarded_query_writes_feeds(spark, monkeypatch):
    calls = []
    real = catalogue.xml_feeds.write_xml
    monkeypatch.setattr(catalogue.xml_feeds, "write_xml", lambda *a, **k: calls.append(k) or real(*a, **k))
    rows = catalogue.q_write_guard(spark, "/root/testdata/sf0.001").collect()
    assert rows and not any(r.feed_key.endswith("1") for r in rows)
    assert len(calls) == 1 and calls[0]["denied"] is not None and calls[0]["denied_entries"] is not None


def test_pages_are_known_by_their_first_element_or_content_type(spark):
    link = '<link rel="alternate" type="application/atom+xml" href="/feed">'
    atom = f'<feed xmlns="http://www.w3.org/2005/Atom"><!-- <html> -->{link}</feed>'
    cases = [
        (f"<html><head>{link}</head></html>", None, True),
        (f"<!DOCTYPE html>\n<!-- {'long ' * 2000} -->\n<html><head>{link}</head></html>", None, True),
        (" \n" * 5000 + f"<HTML><head>{link}</head></HTML>", None, True),
        (f"<!doctype html><title>x</title>{link}<p>y", None, True),
        (f"words first <b>x</b>{link}", "text/html; charset=utf-8", True),
        (f"<section>{link}</section>", "application/xhtml+xml", True),
        (f"<section>{link}</section>", None, False),
        (atom, None, False),
        (f"<?xml version='1.0'?><!-- <html> -->\n{atom}", "text/html", False),
    ]
    rows = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(cases)], "i int, t string, c string")
    got = rows.select("i", fetch.next_address(F.col("t"), F.lit("http://h.example.org/a"), F.col("c")).alias("to")).orderBy("i").collect()
    assert [r.to for r in got] == ["http://h.example.org/feed" if page else None for *_, page in cases]


def test_internal_entities():
    """Entities of the document's own type are expanded, in soup too; external and endless ones never are."""
    of = lambda d: (d["well_formed"], [n["text"] for n in d["nodes"]], [n["attrs"] for n in d["nodes"]])
    dtd = '<!DOCTYPE rss PUBLIC "x" "http://h/x.dtd" [<!-- it\'s --><!ENTITY co "AC<i>ME</i>"><!ENTITY far SYSTEM "file:///etc/hosts"><!ENTITY two "&co;!">]>'
    assert of(shred.shred_one(dtd + "<rss><t a='1'>&two; x</t></rss>")) == (True, ["", "AC! x", "ME"], [{}, {"a": "1"}, {}])
    assert of(shred.shred_one(dtd + "<rss><t>&two;&nbsp;x<![CDATA[&co;]]></rss>")) == (False, ["", "AC!\xa0x&co;", "ME"], [{}, {}, {}])
    assert of(shred.shred_one(dtd + "<rss><t>&far;</t></rss>"))[:2] == (False, ["", "&far;"])
    laughs = "<!DOCTYPE r [<!ENTITY a0 'lol'>" + "".join(f"<!ENTITY a{i} '{f'&a{i - 1};' * 10}'>" for i in range(1, 10)) + "]><r>&a9;</r>"
    assert of(shred.shred_one(laughs))[:2] == (False, ["&a9;"])
    assert of(shred.shred_one("<!DOCTYPE r [<!ENTITY a '&b;'><!ENTITY b '&a;'>]><r>&a;</r>"))[:2] == (False, ["&a;"])


def test_addresses(spark):
    """Schemes in any spelling, Windows paths, scripts, punycode against Python's codec, RFC 3986's examples."""
    given = {
        "FEED://x.org/f": "http://x.org/f", "https:/x.org/a": "https://x.org/a", "feed:https://x.org/f": "https://x.org/f", "Http:Feed://x.org": "http://x.org/", "slashdot.org": "http://slashdot.org/", "x JavaScript:y": "#", "https://": None, "": "", "http://#a": "#a",
        "c:\\windows\\My Documents 100%20\\foo.txt": "file:///c:/windows/My%20Documents%20100%20/foo.txt", "file:///c|/windows/a": "file:///c:/windows/a", "http://www.詹姆斯.com/詹.html": "http://www.xn--8ws00zhy3a.com/%E8%A9%B9.html",
    }
    rows = spark.createDataFrame([(k,) for k in given], "u string").select("u", uri.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in rows.collect()} == given
    labels = ["bücher", "ü", "a-ü-ß", "日本語ドメイン名", "äöüäöü", "😀x", "hello-それぞれの場所", "ليهمابتكلموشعربي؟", "pročprostěnemluvíčesky", "é" * 60]
    coded = spark.createDataFrame([(x,) for x in labels], "u string").select("u", uri.punycode(F.col("u")).alias("p")).collect()
    assert all(r.p == r.u.encode("punycode").decode() for r in coded)
    from urllib.parse import urljoin

    refs = ["g", "./g", "g/", "/g", "?y", "g?y", "g#s", "./", "..", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "g/./h", "g/../h", "g?y/../x", "a/" * 50 + "../" * 49 + "z"]
    got = spark.createDataFrame([(x,) for x in refs], "u string").select("u", uri.resolve(F.lit("http://a/b/c/d?q"), F.col("u")).alias("r")).collect()
    assert {r.u: r.r for r in got} == {x: urljoin("http://a/b/c/d?q", x) for x in refs}


# --- the format "feed" --------------------------------------------------------------------------------


class Counting(BaseHTTPRequestHandler):
    """A feed whose title is the number of requests so far."""

    hits = []
    lock = threading.Lock()

    def do_GET(self):
        with self.lock:
            self.hits.append(self.path)
            body = f"<rss><channel><title>{len(self.hits)}</title></channel></rss>".encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def counting():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Counting)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Counting.hits.clear()
    yield f"127.0.0.1:{server.server_port}"
    server.shutdown()


def poll_once(spark, urls, log, out, progress, **options):
    reader = spark.readStream.format("feed").option("urls", urls).option("log", log)
    for k, v in options.items():
        reader = reader.option(k, v)
    rows = reader.load().select("href", "feed_data", "last_retrieved")

    def write(df, batch):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def test_polls_replay_after_a_crash(spark, counting, tmp_path):
    """A batch that was planned but not committed gives the same answers when it runs again, and nobody is asked."""
    source.register(spark)
    log, out, progress = (str(tmp_path / n) for n in ("log", "out", "progress"))
    urls = f"http://{counting}/a http://{counting}/b http://localhost:{counting.split(':')[1]}/c"
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(out).collect())
    poll_once(spark, urls, log, out, progress)
    poll_once(spark, urls, log, out, progress)
    first, asked = read(), len(Counting.hits)
    assert len(first) == 6 and asked == 6 and len({r[1] for r in first}) == 6
    last = max(int(n) for n in os.listdir(f"{progress}/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{progress}/commits/{name}")  # as if the driver had died before the commit
    shutil.rmtree(f"{out}/batch={last}")
    poll_once(spark, urls, log, out, progress, interval=3600)
    assert read() == first and len(Counting.hits) == asked
    poll_once(spark, urls, log, out, progress)  # a new run goes on with the next poll
    assert len(read()) == 9 and len(Counting.hits) == 9


def test_requests_a_host_are_limited(spark, counting, tmp_path):
    source.register(spark)
    urls = " ".join(f"http://{counting}/{k}" for k in range(5))
    for _ in range(3):
        poll_once(spark, urls, str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "progress"), per_host=2, keep=1)
    assert sorted(Counting.hits) == ["/0", "/0", "/1", "/2", "/3", "/4"]
    assert len([n for n in os.listdir(tmp_path / "log") if n.startswith("poll-")]) <= 2  # committed polls go


def test_filters_choose_whom_to_ask(spark, counting):
    source.register(spark)
    other = f"localhost:{counting.split(':')[1]}"
    urls = f"http://{counting}/a http://{counting}/b http://{other}/c"
    answers = lambda: spark.read.format("feed").option("urls", urls).load()

    def asked(condition):
        Counting.hits.clear()
        rows = answers().filter(condition).collect()
        return len(rows), sorted(Counting.hits)

    assert asked(F.col("host") == other) == (1, ["/c"])
    assert asked(F.col("href").isin(f"http://{counting}/b", "http://nowhere/x")) == (1, ["/b"])
    assert asked(F.col("href").startswith(f"http://{counting}/")) == (2, ["/a", "/b"])
    assert asked(F.col("last_retrieved") < F.lit("2020-01-01").cast("timestamp")) == (0, [])
    assert asked((F.col("host") == other) & (F.col("status") == 404)) == (0, ["/c"])
    assert asked(F.col("status") == 200) == (3, ["/a", "/b", "/c"])


def test_pieces_become_files(spark, tmp_path):
    """Texts of one name in order, whatever its characters; overwriting replaces all; scattered rows raise and leave nothing."""
    source.register(spark)
    out = str(tmp_path / "files")
    rows = spark.createDataFrame([(f"a/b {k}", f"{j};") for k in range(7) for j in range(30)], "name string, text string").withColumn("j", F.regexp_extract("text", r"\d+", 0).cast("int"))
    sorted_rows = rows.repartition(3, "name").sortWithinPartitions("name", "j")
    sorted_rows.write.format("feed").mode("append").save(out)
    read = lambda: {r.path.rpartition("/")[2]: bytes(r.content).decode() for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out).collect() if "part-" in r.path}
    assert read() == {f"a%2Fb%20{k}.xml": "".join(f"{j};" for j in range(30)) for k in range(7)}
    sorted_rows.filter("name = 'a/b 3'").write.format("feed").mode("overwrite").save(out)
    assert set(read()) == {"a%2Fb%203.xml"}
    with pytest.raises(Exception, match="stand together"):
        rows.coalesce(1).sortWithinPartitions("j").write.format("feed").mode("append").save(out)
    assert set(read()) == {"a%2Fb%203.xml"} and os.listdir(f"{out}/_drafts") == []
    with pytest.raises(Exception, match="name and text"):
        rows.select("name").write.format("feed").mode("append").save(out)


NOTED = """<?xml version="1.0"?><?xml-stylesheet href="s.css"?><!-- above --><a xmlns="urn:d" xmlns:p="urn:p"><!-- one --><b k="1">x<c k="1">y</c>z<d/>!</b><?php echo 1?><!-- two --><p:e xmlns:p="urn:q" k="2"><f> in <g>deep</g> out </f></p:e></a>"""
KINDS = {
    "//comment()": [" above ", " one ", " two "],
    "/comment()": [" above "],
    "/a/comment()": [" one ", " two "],
    "b/comment()": [],
    "processing-instruction()": ["echo 1"],
    "processing-instruction('php')": ["echo 1"],
    "processing-instruction('other')": [],
    "/processing-instruction('xml-stylesheet')": ['href="s.css"'],
    "namespace::p": ["urn:p"],
    "p:e/namespace::p": ["urn:q"],
    "p:e/f/namespace::p": ["urn:q"],
    "count(b/namespace::*)": ["3"],
    "namespace::none": [],
    "namespace::xml": ["http://www.w3.org/XML/1998/namespace"],
    "string(b)": ["xyz!"],
    "string(p:e)": ["in deep out"],
    "string(.)": ["xyz! in deep out"],
    "b/@k | b/c/@k | p:e/@k": ["1", "1", "2"],
    "b/@k | b/@k": ["1"],
    "b[comment()]": [],
    "count(//*[processing-instruction()])": ["1"],
    "b/c[.='y'] | b": ["xyz!", "y"],
}


def test_node_kinds(spark):
    """Comments, instructions and namespaces; texts in the document's order; unions keep equal values of different nodes."""
    rows = shredded(spark.createDataFrame([(NOTED,)], "xml string"))
    got = rows.select(*[xpath.find_all(F.col("nodes"), p).alias(f"p{k}") for k, p in enumerate(KINDS)]).first()
    assert dict(zip(KINDS, got)) == KINDS
    soup = shred.shred_one("<a><!-- c --><b>x<?do it now?></a>")
    assert [n["notes"] for n in soup["nodes"]] == [[("comment", None, " c ")], [("instruction", "do", "it now")]] and not soup["well_formed"]
    for wrong in ("ancestor::comment()", "comment('x')", "text('x')"):
        with pytest.raises(ValueError):
            xpath.find_all(F.col("nodes"), wrong)


def test_planet(spark, site):
    """Several addresses of one feed count once; titles get the feed's in front; the newest comes first."""
    at = F.timestamp_seconds(F.lit(1_000_000))
    cached = fetch.FeedCache(spark, "/nowhere").read()
    urls = spark.createDataFrame([(site + p,) for p in ("/feed", "/moved", "/page", "/old", "/none")], "href string")
    planet = fetch.open_planet(urls, cached, at).orderBy("rank").collect()
    assert [r.title for r in planet] == ["T: one", "T: two", "T: three"] and [r["rank"] for r in planet] == [1, 2, 3] and planet[0].feed_key == site + "/feed"
    by_title = fetch.open_planet(urls, cached, at, DEFAULTS.with_options(entry_sorting_property="title")).orderBy("rank").collect()
    assert [r.title for r in by_title] == ["T: one", "T: three", "T: two"]
    assert fetch.open_planet(urls.limit(0), cached, at).count() == 0
    opened = fetch.live(fetch.open_feeds(urls.limit(1), cached, at), at)
    assert [r.live for r in opened.collect()] == [True]
    assert [r.live for r in fetch.live(opened.drop("live"), F.timestamp_seconds(F.lit(2_000_000))).collect()] == [False]


def test_redirects_are_decided(spark, site):
    urls = spark.createDataFrame([(site + p,) for p in ("/moved", "/for-now")], "href string")
    of = lambda rows: {r.href.removeprefix(site): (r.status, r.final_href.removeprefix(site)) for r in rows.collect()}
    assert of(fetch.fetch(urls, DEFAULTS.with_options(follow_redirects="none"))) == {"/moved": (301, "/moved"), "/for-now": (302, "/for-now")}
    assert of(fetch.fetch(urls, DEFAULTS.with_options(follow_redirects="permanent"))) == {"/moved": (200, "/feed"), "/for-now": (302, "/for-now")}
    assert of(fetch.fetch(urls, follow=lambda here, there, status: not there.endswith("/feed"))) == {"/moved": (301, "/moved"), "/for-now": (301, "/for-now")}


def test_rejected_values(spark):
    rows = shredded(spark.createDataFrame([(DOC,)], "xml string"))
    got = rows.select(xpath.try_paths(F.col("nodes"), ["//item/title", "//n"], reject=lambda x: x.contains("o")), xpath.try_paths(F.col("nodes"), ["//item/title"], reject=lambda x: x != "x"))
    assert tuple(got.first()) == ("three", None)


def test_zones_and_weeks(spark):
    given = {
        "Tue, 02 Jan 2024 03:04:05 AKST": "2024-01-02T12:04:05", "02 Jan 2024 03:04:05 IST": "2024-01-01T21:34:05", "02 Jan 2024 03:04:05 XYZ": None, "02 Jan 2024 03:04:05 A": "2024-01-02T03:04:05", "02 Jan 2024 03:04:05 NST": "2024-01-02T06:34:05",
        "2024-W01": "2024-01-01T00:00:00", "2024-W01-3": "2024-01-03T00:00:00", "2021W537": None, "2020W537": "2021-01-03T00:00:00", "2015-W53-5T10:20:30Z": "2016-01-01T10:20:30", "2024-W54": None, "2024-W00": None, "2024-W01-8": None,
    }
    rows = spark.createDataFrame([(k,) for k in given], "t string").select("t", F.date_format(fields.parse_date(F.col("t")), "yyyy-MM-dd'T'HH:mm:ss").alias("d"))
    assert {r.t: r.d for r in rows.collect()} == given


def test_encodings(spark, tmp_path):
    """Feeds are saved in the encoding of the settings, declare it, and are read back; what it lacks becomes a reference."""
    heads = spark.createDataFrame([("k", "Grüße 詹", "http://h/", "s")], "feed_key string, title string, link string, subtitle string")
    items = spark.createDataFrame([("k", 0, "i", "é", "http://h/1", "c")], "feed_key string, doc_pos long, id string, title string, link string, content string").withColumn("time", F.timestamp_seconds(F.lit(0)))
    path = str(tmp_path / "latin")
    save_feeds(heads, items, path, settings=DEFAULTS.with_options(output_encoding="iso-8859-1"))
    raw = bytes(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path + "/part-*").first().content)
    assert raw.startswith(b'<?xml version="1.0" encoding="iso-8859-1"?>') and "Grüße &#35449;".encode("latin-1") in raw
    docs = read_saved(spark, path)
    assert feeds(docs, columns=["title", "encoding"]).first().asDict() == {"title": "Grüße 詹", "encoding": "iso-8859-1"}
    assert entries(docs, columns=["title", "encoding"]).first().asDict() == {"title": "é", "encoding": "iso-8859-1"}
