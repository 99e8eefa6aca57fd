"""Queries over odd texts against their SQL: empty, blank, other line ends, control characters, titles that read as dates."""

import duckdb
import pytest

from feedloom.plans import catalogue

TEXTS = [
    None, "", " ", "\n", "\n\nq", "z\n", "a\r\nb\rc", "\xa0x ", "\x85y\x85", "c\x01d", "e\x0bf\x0c", "\x1ck\x1f", "￾g", "﻿bom", "\U0001f600" * 50, "é" * 39 + " x",
    "<b>&amp;&#13; ]]></b>", "tab\tx\t", "x [12]", "  lead", "7", "2021-03-04", "12 May 2020 10:00:00 GMT",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(7 * i + k, t, "en", f"src{k}") for i, t in enumerate(TEXTS) for k in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["q_indent", "q_roundtrip_rss2", "q_roundtrip_rss1", "q_roundtrip_atom"])
def test_odd_texts(spark, odd, name):
    """F5-F8."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet/*.parquet')")
    want = con.sql(catalogue.SQL[name])
    got = catalogue.QUERIES[name](spark, odd).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_unindent_ends_lines_at_line_feeds(spark):
    from pyspark.sql import functions as F

    from feedloom.functions import text

    rows = spark.createDataFrame([("  a\n\n   b\r  c\n",)], "t string").select(text.unindent(F.col("t")), text.unindent(text.indent(F.col("t")))).first()
    assert rows[:] == ("a\n\n b\r  c\n", "  a\n\n   b\r  c\n\n")
