"""What large tables need: bounded batches, documents dealt out and never broadcast, files listed by tasks."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.sources import feeds, shred


def test_batches_are_bounded():
    """One batch of many documents is handed on in pieces."""
    doc = "<rss><channel>" + "<item><title>x</title></item>" * 20 + "</channel></rss>"
    out = list(shred._shredded(iter([pa.array([doc, None] * 2000)])))
    sizes = [sum(len(r["nodes"] or ()) for r in a.to_pylist()) for a in out]
    assert sum(map(len, out)) == 4000 and sum(sizes) == 2000 * 42 and max(sizes) < shred.NODES_HELD + 42


def test_long_documents_are_held_by_themselves():
    long = "<rss><channel><title>" + "x" * shred.CHARS_HELD + "</title></channel></rss>"
    assert [len(a) for a in shred._shredded(iter([pa.array([long, long, "<a/>"])]))] == [1, 1, 1]


def test_documents_are_dealt_out(spark):
    """A table of one small file is parsed by all tasks."""
    docs = spark.range(1000).coalesce(1).select(F.col("id").alias("feed_key"), F.lit("<rss><channel><title>x</title></channel></rss>").alias("xml"))
    rows = feeds.feeds(docs, columns=["feed_key", "title"]).withColumn("p", F.spark_partition_id())
    assert rows.filter("title = 'x'").agg(F.count("*"), F.countDistinct("p")).first()[:] == (1000, 4)


@pytest.mark.parametrize("kind", ["rss", "atom"])
def test_documents_are_not_broadcast(spark, kind):
    """The entries' markup is joined by key, however small it is."""
    heads = spark.createDataFrame([(1, "T", "http://h/", "s")], "feed_key long, title string, link string, subtitle string")
    items = heads.select("feed_key", F.lit(0).alias("doc_pos"), F.lit("i").alias("id"), "title", "link", F.lit("c").alias("content"), F.timestamp_seconds(F.lit(0)).alias("time"))
    out = feeds.write_xml(heads, items, kind)
    assert out.count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    out.collect()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_children_by_index(spark):
    """A child is found by its own name, its prefix, and the known prefix of its namespace."""
    xml = '<rss xmlns:d="http://purl.org/dc/elements/1.1/" xmlns:z="urn:z"><channel><d:title> </d:title><title/><d:title>a</d:title><z:title>b</z:title><title>c</title><link>1</link><url>2</url><link>3</link></channel></rss>'
    rows = shred.shredded(spark.createDataFrame([(xml,), ("no document",)], "xml string"))
    n, ch = F.col("nodes"), F.lit(1)
    got = rows.select(
        *[shred.first_text(n, ch, *names) for names in (("title",), ("dc:title",), ("d:title",), ("z:title",), ("q:title",), ("q:title", "Title"))], F.size(shred.children(n, ch, "none", "title")),
        F.concat_ws(",", F.transform(shred.all_children(n, ch, "url", "link", "none"), lambda x: x["text"])), shred.first_node(n, ch, "dc:title")["pos"], shred.children(n, ch, "none").isNull(),
    ).collect()
    assert sorted(map(tuple, got), key=str) == [("c", "a", "a", "b", None, "c", 2, "1,2,3", 3, False), (None,) * 6 + got[1][6:7] + ("", None, True)]


def test_saved_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """the driver lists folders, not files."""
    heads = spark.range(50).select(F.col("id").alias("feed_key"), F.lit("T").alias("title"), F.lit("http://h/").alias("link"), F.lit("s").alias("subtitle"))
    items = heads.select("feed_key", F.lit(0).alias("doc_pos"), F.lit("i").alias("id"), "title", "link", F.lit("ü").alias("content"), F.timestamp_seconds(F.lit(0)).alias("time"))
    feeds.save_feeds(heads, items, str(tmp_path / "f"))
    asked = []
    names = feeds.Folder.names
    monkeypatch.setattr(feeds.Folder, "names", lambda self, *below: asked.append(below) or names(self, *below))
    rows = feeds.read_saved(spark, str(tmp_path / "f"))
    assert asked == [()] and not rows.inputFiles()
    assert sorted(int(r["feed_key"]) for r in rows.filter(F.col("xml").contains("ü")).collect()) == list(range(50))
    with pytest.raises(FileNotFoundError):
        feeds.read_saved(spark, str(tmp_path / "none"))


def test_sql_entries_are_dealt_out(spark):
    """the documents of the lateral join are parsed by all tasks, however small their shuffle was."""
    from feedloom.plans import catalogue

    rows = catalogue.q_sql_entries(spark, "/root/testdata/sf0.001").withColumn("p", F.spark_partition_id())
    assert rows.agg(F.countDistinct("p")).first()[0] == 4


def test_saved_pages_are_not_broadcast(spark):
    """entries read back from files meet their pages by key; the planner knows nothing of the files' size."""
    from feedloom.plans import catalogue

    rows = catalogue.q_save_pages(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_nodes_are_made_in_one_pass():
    """An element's row is whole when it ends, and no cycles are looked for while rows are made."""
    import gc

    nodes = shred.strict("<a>x<b k='1'>y</b>z</a>").nodes
    assert [(n["text"], n["last"], n["mixed"]) for n in nodes] == [("xz", 1, [(0, "x"), (1, "z")]), ("y", 1, None)] and nodes[0]["kids"] == {"b": [[1], 1, 1]}
    runs = []
    gc.callbacks.append(lambda phase, info: runs.append(phase))
    try:
        list(shred._shredded(iter([pa.array(["<rss>" + "<item><title>x</title></item>" * 4000 + "</rss>"])])))
    finally:
        gc.callbacks.pop()
    assert not runs and gc.isenabled()


def test_candidates_are_computed_once():
    """A list is named once, not once to look whether it is empty and once to take it."""
    from feedloom.functions import fields

    assert str(fields.tags(F.col("first_list"), F.col("second_list"))).count("first_list") == 1


def test_saved_feeds_go_when_they_are_read(spark, monkeypatch):
    """the three formats never lie on the disk at once, and none stays."""
    from feedloom.plans import catalogue
    from feedloom.sources import tables

    paths, save = [], feeds.save_feeds
    here = lambda: [p for p in paths if feeds.Folder(p).names()]

    def saved(heads, items, path, *more):
        assert not here()
        save(heads, items, path, *more)
        paths.append(path)
        assert here() == [path]

    monkeypatch.setattr(catalogue.xml_feeds, "save_feeds", saved)
    rows = catalogue.q_save_feeds(spark, "/root/testdata/sf0.001")
    assert len(paths) == 3 and not here() and rows.count() > 0
