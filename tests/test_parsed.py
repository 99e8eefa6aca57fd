"""The cache of parsed feeds, and the one that the settings name."""

import pytest
from pyspark.sql import functions as F

from feedloom.config import DEFAULTS
from feedloom.sources.feeds import entries
from feedloom.sources.parsed import ParsedCache, open_cache


def feed(*titles):
    return "<rss><channel>" + "".join(f"<item><title>{t}</title></item>" for t in titles) + "</channel></rss>"


def test_only_changed_documents_are_parsed(spark, tmp_path):
    cache = ParsedCache(spark, str(tmp_path / "parsed"), ["doc_pos", "title"], buckets=8)
    docs = {f"http://h/{k}": feed(f"a{k}", f"b{k}") for k in range(30)}
    df = lambda d: spark.createDataFrame(list(d.items()), "href string, xml string")
    read = lambda href=None: sorted(tuple(r) for r in cache.entries(href).collect())

    def whole(d):
        rows = entries(df(d).withColumnRenamed("href", "feed_key"), columns=["feed_key", "doc_pos", "title"])
        return sorted(tuple(r) for r in rows.collect())

    assert read() == [] and cache.documents().count() == 0
    first = cache.update(df(docs))
    assert (first.documents, first.parsed) == (30, 30) and first.buckets <= 8 and read() == whole(docs)
    again = cache.update(df(docs))
    assert (again.documents, again.parsed, again.buckets) == (30, 0, 0)
    docs["http://h/3"], docs["http://h/new"], docs["http://h/4"] = feed("changed"), feed("new"), None
    some = {k: docs[k] for k in ("http://h/3", "http://h/new", "http://h/4", "http://h/5")}
    second = cache.update(df(some))
    assert (second.documents, second.parsed) == (4, 3) and second.buckets <= 3
    assert read() == whole(docs) and read("http://h/3") == [("http://h/3", 0, "changed")] and read("http://h/4") == [] == read("http://none/")
    assert cache.update(df(some)).parsed == 0  # also one without entries is remembered
    cache.forget(spark.createDataFrame([("http://h/3",), ("http://none/",)], "href string"))
    del docs["http://h/3"]
    assert read() == whole(docs) and cache.documents().count() == 30
    odd = spark.createDataFrame([(None, feed("x")), ("http://h/5", feed("b")), ("http://h/5", feed("c"))], "href string, xml string")
    assert cache.update(odd).documents == 1 and read("http://h/5") == [("http://h/5", 0, "c")]
    assert sorted(p.name for p in (tmp_path / "parsed" / "manifests").iterdir() if p.is_dir()) == ["3", "4"]


def test_an_update_that_another_overtook_raises(spark, tmp_path):
    cache = ParsedCache(spark, str(tmp_path / "parsed"), ["title"], buckets=2)
    one = spark.createDataFrame([("http://h/1", feed("a"))], "href string, xml string")
    cache.update(one)
    number, folders = cache._folders()
    cache.update(one.withColumn("xml", F.lit(feed("b"))))
    with pytest.raises(RuntimeError, match="repeat"):
        cache._replace(number, folders, [0], spark.createDataFrame([], cache._schema()), one.select("href"))
    assert [r.title for r in cache.entries().collect()] == ["b"]


def test_the_settings_name_a_cache(spark, tmp_path):
    named = DEFAULTS.with_options(feed_cache=str(tmp_path / "answers"))
    row = ("http://h/", "T", "l", "<rss/>", "xml", None, None, 60)
    cache = open_cache(spark, named)
    cache.save(spark.createDataFrame([row], cache.read().schema))
    assert open_cache(spark, named).find_by(href="http://h/").first().title == "T"
    assert open_cache(spark, DEFAULTS.with_options(feed_cache="answers")).path.endswith("/answers")
    with pytest.raises(ValueError):
        open_cache(spark)
