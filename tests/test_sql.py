"""SQL names of the column functions, and the table function of entries."""

import pytest
from pyspark.sql import functions as F

from feedloom.functions import sql
from feedloom.sources.feeds import entries

TEXTS = [
    None, "", " \t", "feed:HTTPS://München.de/a/../b", "A <b>bold</b> &amp; &#8217;quoted&#x27; 'x' \\d $1", "Tue, 02 Jan 2024 03:04:05 GMT", "joe@example.com (Joe)", "1:02:03", "de_at", "a, b ,c", "<div> x </div>", "../x/./y", "C:\\x\\y z",
    "line\n  two", "`quoted` = 'it''s' -> (x)",
]


def test_sql_names_equal_the_columns(spark):
    names = sql.register(spark)
    assert set(names) == {*sql.FUNCTIONS, "feed_entries"}
    df = spark.createDataFrame([(k, a, TEXTS[(k * 7 + 3) % len(TEXTS)]) for k, a in enumerate(TEXTS)], "k int, a string, b string")
    df.createOrReplaceTempView("texts")
    for name, (make, kinds) in sql.FUNCTIONS.items():
        if "STRING" != kinds[0]:
            continue
        given = ["a", "b", "'html'"][: len(kinds)]
        got = spark.sql(f"SELECT k, {name}({', '.join(given)}) AS r FROM texts").collect()
        want = df.select("k", make(*[F.expr(g) for g in given]).alias("r")).collect()
        assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(map(tuple, want), key=lambda r: r[0]), name


DOCS = {
    "rss": '<rss><channel><title>F</title><item><title>one</title><link>http://h/1</link><dc:creator xmlns:dc="http://purl.org/dc/elements/1.1/">me</dc:creator><guid>g1</guid></item><item><headline>two</headline><pubDate>x</pubDate></item></channel></rss>',
    "atom": '<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><id>i</id><title>three</title><link rel="alternate" type="text/html" href="http://h/3"/><link rel="self" href="http://h/s"/><content>c</content></entry></feed>',
    "rss11": '<r:Channel xmlns:r="http://purl.org/net/rss1.1#"><r:items><r:item><r:title>four</r:title></r:item></r:items></r:Channel>',
    "rdf": '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel><title>F</title></channel><item><title>five</title></item><item><title>six</title></item></rdf:RDF>',
    "soup": "<rss><channel><item><title>seven<item><title>eight</channel>",
    "none": None,
    "text": "no markup",
}


def test_table_function(spark):
    """The table function finds the entries and texts that ``entries`` finds; its columns are those asked for."""
    sql.register(spark)
    docs = spark.createDataFrame(list(DOCS.items()), "feed_key string, xml string")
    docs.createOrReplaceTempView("docs")
    got = spark.sql("SELECT d.feed_key, e.* FROM docs d, LATERAL feed_entries(d.xml, 'id, title, content, links, dc:creator') e")
    assert got.columns == ["feed_key", "doc_pos", "id", "title", "content", "links", "dc_creator"]
    key = lambda r: (r[0], r[1])
    rows = sorted(got.collect(), key=key)
    want = sorted(entries(docs, columns=["feed_key", "doc_pos", "id", "title", "content"]).collect(), key=key)
    assert [tuple(r)[:5] for r in rows] == [tuple(r) for r in want] and len(rows) >= 7
    by = {(r.feed_key, r.doc_pos): r for r in rows}
    assert by["rss", 0].dc_creator == "me" and by["rss", 1].title == "two"
    assert [tuple(x) for x in by["atom", 0].links] == [("http://h/3", "alternate", "text/html"), ("http://h/s", "self", None)]
    assert spark.sql("SELECT best_link(e.links) AS l FROM docs d, LATERAL feed_entries(d.xml, 'links') e WHERE d.feed_key = 'atom'").first().l == "http://h/3"
    for wrong in ("''", "d.feed_key"):
        with pytest.raises(Exception, match="name the columns"):
            spark.sql(f"SELECT * FROM docs d, LATERAL feed_entries(d.xml, {wrong}) e").collect()
