"""The engine's functions by name in SQL, and entries of feeds as a table function.

``register`` defines every column function as a temporary SQL function with the
same expression, so SQL runs the same built-in functions on the JVM, and the
table function ``feed_entries(xml, columns)``, whose result has the columns that
are asked for; join it with ``LATERAL``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import fields, text, uri

LINKS = "ARRAY<STRUCT<href: STRING, rel: STRING, type: STRING>>"
#: SQL name: function, kinds of its parameters.
FUNCTIONS: dict[str, tuple[Callable[..., Column], tuple[str, ...]]] = {
    "trim_space": (text.ws_trim, ("STRING",)),
    "blank_to_null": (text.blank_to_null, ("STRING",)),
    "escape_entities": (text.escape_entities, ("STRING",)),
    "unescape_entities": (text.unescape_entities, ("STRING",)),
    "unescape_named": (text.unescape_named, ("STRING",)),
    "strip_tags": (text.strip_tags, ("STRING",)),
    "plain_text": (text.plain_text, ("STRING",)),
    "indent_lines": (text.indent, ("STRING",)),
    "unindent_lines": (text.unindent, ("STRING",)),
    "strip_wrapper": (text.strip_wrapper, ("STRING",)),
    "text_construct": (text.text_construct, ("STRING", "STRING", "STRING")),
    "is_uri": (uri.is_uri, ("STRING",)),
    "normalize_url": (uri.normalize_url, ("STRING",)),
    "canonical_url": (uri.canonical_url, ("STRING",)),
    "resolve_url": (uri.resolve, ("STRING", "STRING")),
    "url_host": (uri.host, ("STRING",)),
    "ascii_host": (uri.ascii_host, ("STRING",)),
    "tag_uri": (uri.tag_uri, ("STRING", "STRING")),
    "urn_uuid": (uri.urn_uuid, ("STRING",)),
    "favicon": (uri.favicon, ("STRING",)),
    "parse_author": (fields.author, ("STRING",)),
    "parse_date": (fields.parse_date, ("STRING",)),
    "parse_duration": (fields.duration, ("STRING",)),
    "language_code": (fields.language, ("STRING",)),
    "feed_keywords": (fields.keywords, ("STRING",)),
    "best_link": (fields.best_link, (LINKS,)),
}
#: Operators that the text of a column writes as functions.
_operator = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`])(and|or|not|[<>=!+*/%&|^~-]+)(?=\()", re.S)


def expression_text(column: Column) -> str:
    """A column's expression as SQL text."""
    return _operator.sub(lambda m: f"`{m[1]}`" if m[1] else m[0], column._jc.node().sql())


def register(spark: SparkSession) -> list[str]:
    """Define the functions and ``feed_entries`` in this session; their names."""
    for name, (make, kinds) in FUNCTIONS.items():
        given = [f"a{k}" for k in range(len(kinds))]
        parameters = ", ".join(f"{a} {kind}" for a, kind in zip(given, kinds, strict=True))
        column = make(*map(F.col, given))
        kind = spark.createDataFrame([], parameters).select(column.alias("r")).schema["r"].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {expression_text(column)}")
    spark.udtf.register("feed_entries", F.udtf(FeedEntries))
    return [*FUNCTIONS, "feed_entries"]


@dataclass
class Asked(AnalyzeResult):
    """The columns asked for and the elements that hold them."""

    chains: tuple[tuple[str, tuple[str, ...]], ...] = ()


class FeedEntries:
    """Entries of a document: ``doc_pos`` and the columns named in the second argument, between commas.

    Known are id, title, content, summary, stated (the date as it is written), rights, comments and links; any other name is
    that of an element, as ``dc:creator``, and gives a column without the colon.  Texts are those of the first of a column's
    elements that has one.  A null or unreadable document has no entries.
    """

    def __init__(self, analyzed: Asked):
        self.chains = analyzed.chains

    @staticmethod
    def analyze(xml: AnalyzeArgument, columns: AnalyzeArgument) -> Asked:
        from feedloom.sources import feeds

        known = {
            "id": ("gr:original-id", "original-id", "id", "guid"), "title": feeds.ITEM_TITLE, "content": feeds.CONTENT, "summary": feeds.SUMMARY, "stated": (*feeds.TIME, "lastupdated"), "rights": feeds.RIGHTS, "comments": ("comments",), "links": feeds.LINKS,
        }
        if not isinstance(columns.value, str) or not columns.value.strip():
            raise ValueError("name the columns, between commas, as a constant")
        names = [n.strip().lower() for n in columns.value.split(",")]
        link = StructType([StructField(n, StringType()) for n in ("href", "rel", "type")])
        out = [StructField("doc_pos", IntegerType())]
        out += [StructField(n.replace(":", "_"), ArrayType(link) if n == "links" else StringType()) for n in names]
        return Asked(StructType(out), chains=tuple((n, known.get(n, (n,))) for n in names))

    def eval(self, xml: str, columns: str) -> Iterator[tuple]:
        from feedloom.sources.shred import below, entry_nodes, shred_one

        document = shred_one(xml)
        if document is None:
            return
        nodes = document["nodes"]
        children: dict[int, list[dict]] = {}
        for n in nodes:
            children.setdefault(n["parent"], []).append(n)
        for pos, entry in enumerate(entry_nodes(nodes, children)):
            row = [pos]
            for column, chain in self.chains:
                found = [n for name in chain for n in below(children, entry, name)]
                if column == "links":
                    get = lambda n, *keys: next((v for k in keys if (v := (n["attrs"].get(k) or "").strip())), None)
                    row.append([(get(n, "href", "url") or n["text"] or None, (get(n, "rel") or "").lower() or None, (get(n, "type") or "").lower() or None) for n in sorted(found, key=lambda n: n["id"])])
                else:
                    row.append(next((n["text"] for n in found if n["text"]), None))
            yield tuple(row)
