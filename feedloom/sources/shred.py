"""XML documents to arrays of nodes: one pass in Python, columns afterwards.

``shred`` parses with expat and, where that fails, with a tag-balancing reader
of tag soup.  Of a document type only its internal entities stay, expanded within a
bound; nothing is ever fetched.  A node
has its number, parent, last descendant, place among siblings, local and prefixed name (lower
case), namespace, attributes, direct text, whether any of it was CDATA, markup
of its children (of text constructs that aren't part of another), and xml:base,
joined with those above it.  Where texts and elements alternate, ``mixed`` has the
texts as they stand, each after the number of the last element that began before it;
``notes`` are its comments and processing instructions (the root also has those above
it), ``spaces`` the namespaces in scope where it declares any.  ``kids`` has its children by the names that
``children`` asks for: their numbers, and the first of them with text, and with text or markup, so that a child
is looked up and not searched for.  Work is in proportion to the document.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
import html
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from operator import itemgetter
from urllib.parse import urljoin
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import WS

from .tables import range_partitions

NODE = "struct<id:int,parent:int,last:int,pos:int,depth:int,name:string,prefix:string,ns:string,attrs:map<string,string>,text:string,cdata:boolean,inner:string,base:string,mixed:array<struct<after:int,text:string>>,notes:array<struct<kind:string,target:string,text:string>>,spaces:map<string,string>,kids:map<string,struct<ids:array<int>,said:int,marked:int>>>"
SHREDDED = f"struct<well_formed:boolean,root:string,root_ns:string,nodes:array<{NODE}>>"
_texts = pa.map_(pa.string(), pa.string())
#: ``SHREDDED`` in Arrow.
ROW = pa.struct({"well_formed": pa.bool_(), "root": pa.string(), "root_ns": pa.string(), "nodes": pa.list_(pa.struct({
    "id": pa.int32(), "parent": pa.int32(), "last": pa.int32(), "pos": pa.int32(), "depth": pa.int32(), "name": pa.string(), "prefix": pa.string(), "ns": pa.string(), "attrs": _texts, "text": pa.string(), "cdata": pa.bool_(), "inner": pa.string(), "base": pa.string(),
    "mixed": pa.list_(pa.struct({"after": pa.int32(), "text": pa.string()})), "notes": pa.list_(pa.struct({"kind": pa.string(), "target": pa.string(), "text": pa.string()})), "spaces": _texts,
    "kids": pa.map_(pa.string(), pa.struct({"ids": pa.list_(pa.int32()), "said": pa.int32(), "marked": pa.int32()})),
}))})
#: Elements whose markup is kept.
CONSTRUCTS = set("title subtitle tagline description summary abstract content encoded body div payload datacontent fullitem info rights copyright blurb headline".split())
_subset = re.compile(r"""<!DOCTYPE\s+([\w:.-]+)[^>\[]*+(?:\[((?:<!--.*?-->|"[^"]*+"|'[^']*+'|[^\]"'])*+)\]\s*)?>""", re.S | re.I)
_doctype = re.compile(r"<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>", re.S | re.I)
_entity = re.compile(r"""<!ENTITY\s+([\w:.-]+)\s+("[^"]*"|'[^']*')\s*>""")
_own_reference = re.compile(r"<!\[CDATA\[.*?\]\]>|<!--.*?-->|&([A-Za-z_][\w:.-]*);", re.S)
#: How much longer than itself, and than this many characters, a document may become by its own entities.
EXPANSION, SPARE = 4, 1 << 20
_void = {"br", "hr", "img", "meta", "input", "area", "base", "col", "embed", "param"}


XHTML = "http://www.w3.org/1999/xhtml"
#: Namespaces of feeds themselves, whose names are meant without a prefix; fixed values.
FEED_NS = ("http://www.w3.org/2005/Atom", "http://purl.org/atom/ns#", "http://purl.org/rss/1.0/", "http://purl.org/net/rss1.1#", "http://my.netscape.com/rdf/simple/0.9/", "http://backend.userland.com/rss2")
#: Prefixes by which extensions are asked for; fixed values.
PREFIXES = {
    "dc": "http://purl.org/dc/elements/1.1/", "content": "http://purl.org/rss/1.0/modules/content/", "itunes": "http://www.itunes.com/dtds/podcast-1.0.dtd", "media": "http://search.yahoo.com/mrss/", "syn": "http://purl.org/rss/1.0/modules/syndication/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "taxo": "http://purl.org/rss/1.0/modules/taxonomy/", "admin": "http://webns.net/mvcb/", "gr": "http://www.google.com/schemas/reader/atom/", "svg": "http://www.w3.org/2000/svg", "math": "http://www.w3.org/1998/Math/MathML", "xlink": "http://www.w3.org/1999/xlink",
}
_prefix_of = {ns: p for p, ns in PREFIXES.items()}


def shown_name(name: str, ns: str) -> str:
    """An element's name in markup: bare for XHTML, with a known prefix or one made of its namespace for others."""
    prefix, _, local = name.rpartition(":")
    if ns == XHTML or not prefix and (not ns or ns in FEED_NS):
        return local
    if not ns:
        return name
    return f"{_prefix_of.get(ns) or 'unknown' + hashlib.sha1(ns.encode()).hexdigest()[:5]}:{local}"


class Open:
    """An open element: its row, the namespaces in scope, its names as written and in markup, its children so far, and its texts with the last node before each."""

    __slots__ = ("row", "scope", "raw", "shown", "count", "parts", "places")

    def __init__(self, row: dict, scope: dict[str, str], raw: str):
        self.row, self.scope, self.raw, self.shown, self.count, self.parts, self.places = row, scope, raw, None, 0, [], []


@lru_cache(4096)
def _names(name: str) -> tuple[str, str]:
    """Prefix and local name in lower case."""
    prefix, _, local = name.rpartition(":")
    return prefix.lower(), local.lower()


@lru_cache(4096)
def _asked(local: str, prefix: str, ns: str) -> tuple[str, ...]:
    """The names by which ``children`` asks for an element."""
    known = _prefix_of.get(ns)
    keys = [local] if not prefix or ns in FEED_NS else []
    if prefix:
        keys.append(f"{prefix}:{local}")
    if known and known != prefix:
        keys.append(f"{known}:{local}")
    return tuple(keys)


class Builder:
    """Makes rows of nodes from start, end and text events; closes what is left open."""

    def __init__(self):
        self.nodes: list[dict] = []
        self.stack: list[Open] = []
        self.tops = 0
        self.markup, self.holder = [], None  # the open construct that is part of no other
        self.above: list[tuple] | None = None

    def start(self, name: str, attrs: dict[str, str], namespaces: dict[str, str]) -> None:
        prefix, local = _names(name)
        if self.stack:
            parent = self.stack[-1]
            at, above, scope = parent.row["id"], parent.row["base"], parent.scope
            pos = parent.count = parent.count + 1
        else:
            at, above, scope = -1, None, {}
            pos = self.tops = self.tops + 1
        own = attrs.get("xml:base")
        base = urljoin(above, own) if above and own else own or above
        if namespaces:
            scope = {**scope, **namespaces}
        row = {
            "id": len(self.nodes), "parent": at, "last": 0, "pos": pos, "depth": len(self.stack), "name": local, "prefix": prefix, "ns": scope.get(prefix, ""), "attrs": {k.lower(): v for k, v in attrs.items()} if attrs else attrs, "text": "", "cdata": False,
            "inner": None, "base": base, "mixed": None, "notes": None if self.nodes else self.above, "spaces": scope if namespaces else None, "kids": None,
        }
        self.nodes.append(row)
        now = Open(row, scope, name)
        if self.holder is not None:
            now.shown = shown_name(name, row["ns"])
            self.markup.append(f"<{now.shown}{''.join(f' {k}={quoteattr(v)}' for k, v in attrs.items() if not k.startswith('xmlns'))}>")
        elif local in CONSTRUCTS:
            self.holder = row
        self.stack.append(now)

    def end(self) -> None:
        if self.stack:
            now = self.stack.pop()
            if now.row is self.holder:
                self.close_holder()
            elif self.holder is not None:
                self.markup.append(f"</{now.shown}>")
            self.finish(now)

    def finish(self, now: Open) -> None:
        """Fill the row of an element that ended, and put it under each of its names at its parent: [numbers, first with text, first with text or markup]."""
        row = now.row
        row["last"] = len(self.nodes) - 1
        text = row["text"] = "".join(now.parts).strip(WS)
        if text and row["last"] > row["id"]:
            row["mixed"] = self.mixed(now)
        if self.stack:
            up, number, inner = self.stack[-1].row, row["id"], row["inner"]
            marked = text if inner is None else inner
            kids = up["kids"]
            if kids is None:
                kids = up["kids"] = {}
            for key in _asked(row["name"], row["prefix"], row["ns"]):
                kid = kids.get(key)
                if kid is None:
                    kids[key] = [[number], number if text else None, number if marked else None]
                    continue
                kid[0].append(number)
                if text and kid[1] is None:
                    kid[1] = number
                if marked and kid[2] is None:
                    kid[2] = number

    def close_holder(self) -> None:
        self.holder["inner"] = "".join(self.markup).strip(WS)
        self.markup, self.holder = [], None

    def text(self, data: str, cdata: bool = False) -> None:
        if self.stack:
            now = self.stack[-1]
            now.parts.append(data)
            now.places.append(len(self.nodes) - 1)
            if cdata:
                now.row["cdata"] = True
            if self.holder is not None:
                self.markup.append(escape(data))

    def note(self, kind: str, target: str | None, text: str) -> None:
        """A comment or a processing instruction of the open element, or above the root."""
        if self.stack:
            row = self.stack[-1].row
            row["notes"] = [*(row["notes"] or ()), (kind, target, text)]
        elif not self.nodes:
            self.above = [*(self.above or ()), (f"above {kind}", target, text)]

    def rows(self) -> list[dict]:
        if self.holder is not None:
            self.close_holder()
        while self.stack:
            self.finish(self.stack.pop())
        return self.nodes

    @staticmethod
    def mixed(now: Open) -> list[tuple[int, str]]:
        """The texts of an element that also has children, joined where no element begins between them."""
        out: list[tuple[int, str]] = []
        for after, text in zip(now.places, now.parts):
            if out and out[-1][0] == after:
                out[-1] = (after, out[-1][1] + text)
            else:
                out.append((after, text))
        return out


def namespaces_of(attrs: dict[str, str]) -> dict[str, str]:
    if not any(k.startswith("xmlns") for k in attrs):
        return {}
    return {k[6:].lower(): v for k, v in attrs.items() if k.startswith("xmlns:")} | ({"": attrs["xmlns"]} if "xmlns" in attrs else {})


def internal_entities(text: str) -> tuple[str, str, dict[str, str]]:
    """The document without its type, that type's name, and the entities that it declares itself."""
    m = _subset.search(text)
    if not m:
        return _doctype.sub("", text), "", {}
    found: dict[str, str] = {}
    for name, value in _entity.findall(re.sub(r"<!--.*?-->", "", m[2] or "", flags=re.S)):
        found.setdefault(name, value[1:-1])  # the first declaration holds
    return text[: m.start()] + text[m.end() :], m[1], found


def expanded(text: str, entities: dict[str, str]) -> str:
    """``text`` with its own entities replaced; unchanged where that would pass the bound or never end."""
    bound, out = EXPANSION * len(text) + SPARE, text
    for _ in range(len(entities) + 1):
        parts, at, size = [], 0, len(out)
        for m in _own_reference.finditer(out):
            if m[1] in entities:
                parts += [out[at : m.start()], entities[m[1]]]
                at, size = m.end(), size + len(entities[m[1]])
                if size > bound:
                    return text
        if not parts:
            return out
        out = "".join([*parts, out[at:]])
    return text


def strict(text: str, kind: str = "", entities: dict[str, str] | None = None) -> Builder:
    """Well-formed XML; ``entities`` of the document type ``kind`` are expanded within the bound, or raise like other faults."""
    out, parser, inside = Builder(), expat.ParserCreate(), [False]
    if entities:
        declared = "".join(f'<!ENTITY {n} "{v}">' if '"' not in v else f"<!ENTITY {n} '{v}'>" for n, v in entities.items())
        text = f"<!DOCTYPE {kind} [{declared}]>{text}"
        left = [EXPANSION * len(text) + SPARE]
    parser.buffer_text = True
    parser.StartElementHandler = lambda name, attrs: out.start(name, attrs, namespaces_of(attrs) if attrs else attrs)
    parser.EndElementHandler = lambda name: out.end()


    def read(data: str) -> None:
        if entities:
            left[0] -= len(data)
            if left[0] < 0:
                raise expat.ExpatError("entities expand beyond the bound")
        out.text(data, inside[0])

    parser.CharacterDataHandler = read
    parser.StartCdataSectionHandler = lambda: inside.__setitem__(0, True)
    parser.CommentHandler = lambda data: out.note("comment", None, data)
    parser.ProcessingInstructionHandler = lambda target, data: out.note("instruction", target, data)
    parser.EndCdataSectionHandler = lambda: inside.__setitem__(0, False)
    parser.Parse(text.encode("utf-8", "replace"), True)
    return out


class Soup(HTMLParser):
    """Reads what expat refuses."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open = Builder(), {}  # how many elements of a name are open

    def handle_starttag(self, tag, attrs):
        pairs = {k: v or "" for k, v in attrs}
        self.out.start(tag, pairs, namespaces_of(pairs))
        if tag in _void:
            self.out.end()
        else:
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _void:
            self.close_one()

    def close_one(self) -> str:
        name = self.out.stack[-1].raw
        self.open[name] -= 1
        self.out.end()
        return name

    def handle_endtag(self, tag):
        if self.open.get(tag):
            while self.close_one() != tag:
                pass

    def handle_data(self, data):
        self.out.text(data)

    def handle_comment(self, data):
        self.out.note("comment", None, data)

    def handle_pi(self, data):
        target, _, rest = data.rstrip("?").partition(" ")
        self.out.note("instruction", target, rest.strip())

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.out.text(data[6:], True)


def shred_one(text: str | None) -> dict | None:
    if text is None or "<" not in text:
        return None
    text, kind, entities = internal_entities(text)
    text = re.sub(r"^[^<]*<\?xml[^>]*\?>", "", text, count=1).lstrip("﻿ \t\r\n")
    fine = True
    try:
        built = strict(text, kind, entities)
    except expat.ExpatError:
        fine = False
        soup = Soup()
        text = expanded(text, entities) if entities else text
        soup.feed(re.sub(r"<(/?[\w:.-]*)$", r"<\1>", text.rstrip()))
        soup.close()
        built = soup.out
    rows = built.rows()
    if not rows:
        return None
    return {"well_formed": fine, "root": (rows[0]["prefix"] + ":" if rows[0]["prefix"] else "") + rows[0]["name"], "root_ns": rows[0]["ns"], "nodes": rows}


#: About how many nodes, and characters of documents, a worker holds at once; a longer document is held by itself.
NODES_HELD, CHARS_HELD = 10_000, 4 << 20


def _shredded(xml: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Documents as Arrow rows of ``SHREDDED``, handed on in small batches however many documents come in one."""
    for batch in xml:
        at = 0
        while at < len(batch):
            made, at = _held(batch, at)
            yield made


def _held(batch: pa.Array, at: int) -> tuple[pa.Array, int]:
    """The documents from a place on that are held at once, and the place after them; rows hold no cycles, so none are looked for meanwhile."""
    rows, nodes, chars = [], 0, 0
    collects = gc.isenabled()
    gc.disable()
    try:
        while at < len(batch) and nodes < NODES_HELD and chars < CHARS_HELD and len(rows) < NODES_HELD:
            text = batch[at].as_py()
            row = shred_one(text)
            rows.append(row)
            nodes, chars, at = nodes + (len(row["nodes"]) if row else 0), chars + len(text or ""), at + 1
        return _arrow(rows), at
    finally:
        if collects:
            gc.enable()


_columns = itemgetter(*[f.name for f in ROW.field("nodes").type.value_type])


def _maps(dicts: list[dict | None]) -> tuple[pa.Array, list, list]:
    """Where each map's keys begin, the keys, and their values."""
    offsets, keys, values = [], [], []
    for d in dicts:
        offsets.append(None if d is None else len(keys))
        if d:
            keys += d
            values += d.values()
    return pa.array([*offsets, len(keys)], pa.int32()), keys, values


def _arrow(rows: list[dict | None]) -> pa.Array:
    """Column by column."""
    fields_of = ROW.field("nodes").type.value_type
    nodes = [n for row in rows if row for n in row["nodes"]]
    offsets, at = [], 0
    for row in rows:
        offsets.append(at if row else None)
        at += len(row["nodes"]) if row else 0

    def texts(dicts) -> pa.Array:
        begins, keys, values = _maps(dicts)
        return pa.MapArray.from_arrays(begins, pa.array(keys, pa.string()), pa.array(values, pa.string()))

    def kids(dicts) -> pa.Array:
        begins, keys, values = _maps(dicts)
        kind = fields_of.field("kids").type.item_type
        starts, ids = [0], []
        for v in values:
            ids += v[0]
            starts.append(len(ids))
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
        items = pa.StructArray.from_arrays([lists.cast(kind.field("ids").type), *[pa.array([v[k] for v in values], pa.int32()) for k in (1, 2)]], fields=list(kind))
        return pa.MapArray.from_arrays(begins, pa.array(keys, pa.string()), items)

    made = {
        "attrs": texts, "spaces": texts, "kids": kids, "mixed": lambda c: pa.array([v and [{"after": a, "text": t} for a, t in v] for v in c], fields_of.field("mixed").type),
        "notes": lambda c: pa.array([v and [{"kind": k, "target": t, "text": x} for k, t, x in v] for v in c], fields_of.field("notes").type),
    }
    values = zip(*map(_columns, nodes)) if nodes else [()] * len(fields_of)
    columns = [made[f.name](c) if f.name in made else pa.array(c, f.type) for f, c in zip(fields_of, values, strict=True)]
    lists = pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), pa.StructArray.from_arrays(columns, fields=list(fields_of)), type=ROW.field("nodes").type)
    own = [pa.array([row[f.name] if row else None for row in rows], f.type) for f in ROW if f.name != "nodes"]
    return pa.StructArray.from_arrays([*own, lists], fields=list(ROW))


def _decoded(data: bytes, encoding: str | None) -> str:
    """By any of Python's codecs; what fails is read as UTF-8 and then as Latin-1."""
    guess = "cp037" if data[:4] == b"\x4c\x6f\xa7\x94" else encoding or "utf-8"
    for name in (guess, "utf-8"):
        try:
            return codecs.decode(data, {"ebcdic-cp-us": "cp037"}.get(name.lower(), name))
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("latin-1")


_charset = re.compile(r"charset=\s*\"?([\w-]+)", re.I)
_declared = re.compile(rb"\s*<\?xml[^>]*encoding=[\"']([^\"']+)[\"']")


def decoded(data: bytes, content_type: str | None) -> str:
    """The text of an answer: the header's encoding, else the declaration's."""
    m = _charset.search(content_type or "")
    d = _declared.match(data)
    return _decoded(data, m[1] if m else d[1].decode("ascii", "replace") if d else None)


def _decode_bytes(data: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else _decoded(bytes(b), e) for b, e in zip(data, encoding, strict=True)])


# What a sanitised document may hold; fixed values.
ELEMENTS = set(
    "a abbr acronym address area article aside b bdi bdo big blockquote br caption center cite code col colgroup dd del details dfn dir div dl dt em fieldset figcaption figure font footer h1 h2 h3 h4 h5 h6 header hr i img ins kbd label legend li map mark menu nav ol p pre q rp rt ruby s samp section small span strike strong sub summary sup table tbody td tfoot th thead time tr tt u ul var wbr".split()
)
ATTRIBUTES = set(
    "abbr accept-charset align alt axis border cellpadding cellspacing char charoff charset cite class clear cols colspan color compact coords datetime dir face frame headers height href hreflang hspace id ismap label lang longdesc name noshade nowrap rel rev rows rowspan rules scope shape size span src start summary tabindex target title type usemap valign value vspace width xml:lang".split()
)
SCHEMES = set("http https ftp ftps mailto feed news nntp irc ircs tel sip sips sms webcal xmpp urn tag ed2k gopher afs rtsp rsync telnet aim callto svn git".split())
#: Elements that go with all they hold.
WHOLE = set("script style iframe object applet noscript noembed noframes template textarea select option button svg math audio video canvas title head xml".split())
#: Attributes that hold an address, by element.
ADDRESSES = {("a", "href"), ("area", "href"), ("blockquote", "cite"), ("del", "cite"), ("img", "longdesc"), ("img", "src"), ("img", "usemap"), ("ins", "cite"), ("q", "cite")}
_hidden = re.compile(r"[\x00-\x20\x7f-\xa0\u200b-\u200f\u2028-\u202f\u2060\ufeff]+")
_scheme = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")


def safe_address(v: str) -> bool:
    """Whether an address has an allowed scheme or none, however it is written."""
    bare = _hidden.sub("", html.unescape(html.unescape(v)))
    m = _scheme.match(bare)
    return m[1].lower() in SCHEMES if m else ":" not in bare.split("/")[0].split("?")[0].split("#")[0]


class Cleaner(HTMLParser):
    """Keeps the elements, attributes and schemes of the lists and resolves addresses."""

    def __init__(self, base: str | None, keep: bool = False):
        super().__init__(convert_charrefs=False)
        self.base, self.keep, self.out, self.skip = base, keep, [], []

    def handle_starttag(self, tag, attrs):
        if not self.keep and tag in WHOLE:
            self.skip.append(tag)
        if not self.skip and (self.keep or tag in ELEMENTS):
            self.out.append(f"<{tag}{''.join(self.attr(tag, k, v or '') for k, v in attrs)}>")

    def attr(self, tag: str, k: str, v: str) -> str:
        if not self.keep and k not in ATTRIBUTES:
            return ""
        if (tag, k) in ADDRESSES or k in ("href", "src", "cite", "longdesc", "usemap"):
            if not self.keep and not safe_address(v):
                return ""
            try:
                v = urljoin(self.base, v) if self.base else v
            except ValueError:  # no address at all
                pass
        return f" {k}={quoteattr(v)}"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
        elif tag not in _void and (self.keep or tag in ELEMENTS):
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data.replace("<", "&lt;") if not self.keep else data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def _sanitize(markup: pd.Series, base: pd.Series) -> pd.Series:
    def one(m, b):
        if m is None:
            return None
        c = Cleaner(b)
        c.feed(m)
        c.close()
        return "".join(c.out)

    return pd.Series([one(m, b) for m, b in zip(markup, base, strict=True)])


_reference = re.compile(r"&#(?:([0-9]{1,7})|x([0-9a-f]{1,6}));")


def unescape(text: str) -> str:
    """As ``functions.text.unescape_entities``."""

    def decode(m: re.Match) -> str:
        code = int(m[1]) if m[1] else int(m[2], 16)
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    text = _reference.sub(decode, text.replace("&#38;", "&amp;").replace("&#x26;", "&amp;"))
    for entity, sign in (("&amp;", "&"), ("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&apos;", "'")):
        text = text.replace(entity, sign)
    return text


def construct(text: str | None, cdata: bool | None, inner: str | None, ns: str | None, attrs, atom: bool) -> str:
    """A text construct as HTML, by its CDATA, type, mode and encoding; Atom's default type is text."""
    attrs, inner = dict(attrs or {}), inner if inner is not None else text or ""
    marks = {(attrs.get(k) or "").strip().lower() for k in ("mode", "encoding")} | {(attrs.get("type") or "").strip().lower() or ("text" if atom else "")}
    if cdata:
        out = text or ""
    elif "base64" in marks:
        try:
            out = base64.b64decode(text or "").decode("utf-8", "replace")
        except ValueError:
            out = ""
    elif marks & {"xhtml", "xml", "application/xhtml+xml"} or ns == XHTML:
        out = inner
    else:
        out = unescape(inner)
    if marks & {"text", "text/plain"}:
        out = escape(out, {'"': "&quot;", "'": "&apos;"})
    return out


_wrapped = re.compile(r"<div\b[^>]*>((?:(?!</?div\b).)*)</div>", re.S | re.I)


def unwrapped(markup: str) -> str:
    """Without a div around everything."""
    m = _wrapped.fullmatch(markup)
    return m[1].strip() if m else markup


def _clean(markup: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([unwrapped((m or "").replace("\t", "  ").strip()) or None for m in _sanitize(markup, base)], dtype=object)


def _construct_html(node: pd.DataFrame, atom: pd.Series, base: pd.Series) -> pd.Series:
    rows = zip(node["text"], node["cdata"], node["inner"], node["ns"], node["attrs"], atom, strict=True)
    markup = pd.Series([None if r[0] is None and r[2] is None else construct(*r) for r in rows], dtype=object)
    return _clean(markup, pd.Series([a or b for a, b in zip(node["base"], base, strict=True)], dtype=object))


def _plain_html(text: pd.Series) -> pd.Series:
    return _clean(pd.Series([None if t is None else unescape(t) for t in text], dtype=object), pd.Series([None] * len(text), dtype=object))


def _on(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shred(xml: Column | str) -> Column:
    return F.arrow_udf(_shredded, SHREDDED)(_on(xml))


def decode_bytes(data: Column | str, encoding: Column) -> Column:
    return F.pandas_udf(_decode_bytes, "string")(_on(data), encoding)


def sanitize(markup: Column | str, base: Column) -> Column:
    return F.pandas_udf(_sanitize, "string")(_on(markup), base)


def construct_html(node: Column, atom: Column, base: Column) -> Column:
    """A node's text construct as sanitised HTML with tabs as two blanks; null where nothing is left."""
    return F.pandas_udf(_construct_html, "string")(node, atom, base)


def plain_html(c: Column) -> Column:
    """Escaped HTML, unescaped and sanitised."""
    return F.pandas_udf(_plain_html, "string")(c)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def below(children: dict[int, list[dict]], parent: dict, name: str) -> list[dict]:
    """``children`` for rows in Python: those of this name."""
    prefix, _, local = name.lower().rpartition(":")
    known = PREFIXES.get(prefix)
    same = (lambda n: n["prefix"] == "" or n["ns"] in FEED_NS) if not prefix else (lambda n: n["prefix"] == prefix or (known is not None and n["ns"] == known))
    return [n for n in children.get(parent["id"], ()) if n["name"] == local and same(n)]


def entry_nodes(nodes: list[dict], children: dict[int, list[dict]]) -> list[dict]:
    """The nodes of a document's entries, at the first of their possible places."""
    root = nodes[0]
    channel = next((n for n in nodes if n["depth"] <= 1 and n["name"] in ("channel", "feedinfo", "news")), root)
    listed = lambda top: [n for items in below(children, top, "items") for n in children.get(items["id"], ()) if n["name"] == "item"]
    first = lambda top, *names: next((hit for name in names if (hit := below(children, top, name))), [])
    places = (first(channel, "entry"), first(root, "item"), listed(root), first(root, "entry", "story"), first(channel, "item"), listed(channel), first(channel, "story"))
    return next((found for found in places if found), [])


def node_at(nodes: Column, number: Column) -> Column:
    """The node of a number in a document's nodes, or in those of one of its elements."""
    return F.get(nodes, number - F.get(nodes, F.lit(0))["id"])


def _kid(nodes: Column, parent: Column, name: str) -> Column:
    """What the parent's ``kids`` hold under a name, null where it has none."""
    return F.element_at(node_at(nodes, parent)["kids"], name.lower())


def children(nodes: Column, parent: Column, *names: str) -> Column:
    """Children of a node by the first name that any has; ``prefix:name`` asks for an extension, ``name`` for the feed's own."""
    none = F.when(nodes.isNotNull(), F.array().cast("array<int>"))
    return F.transform(F.coalesce(*[_kid(nodes, parent, name)["ids"] for name in names], none), lambda k: node_at(nodes, k))


def all_children(nodes: Column, parent: Column, *names: str) -> Column:
    """Children of any of these names, in the document's order."""
    none = F.when(nodes.isNotNull(), F.array().cast("array<int>"))
    ids = F.concat(*[F.coalesce(_kid(nodes, parent, name)["ids"], none) for name in names])
    return F.transform(F.sort_array(F.array_distinct(ids)), lambda k: node_at(nodes, k))


def first_text(nodes: Column, parent: Column, *names: str) -> Column:
    """The first non-blank direct text of the first name that has one."""
    return node_at(nodes, F.coalesce(*[_kid(nodes, parent, name)["said"] for name in names]))["text"]


def first_node(nodes: Column, parent: Column, *names: str) -> Column:
    """The first node with any text or markup, of the first name that has one."""
    return node_at(nodes, F.coalesce(*[_kid(nodes, parent, name)["marked"] for name in names]))


def attribute(node: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.btrim(F.element_at(node["attrs"], n)), F.lit("")) for n in names])


def shredded(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Adds the columns of ``shred``; one Python pass per document.

    Documents are dealt out before, as a table that is small for a scan makes long work here.
    """
    dealt = docs.repartition(range_partitions(docs, 16 << 20))
    return dealt.withColumn("x", shred(F.col(xml))).select(*docs.columns, "x.*")
