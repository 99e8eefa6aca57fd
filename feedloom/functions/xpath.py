"""XPath over shredded documents, compiled to column expressions.

A node knows its own number and that of its last descendant, so each axis is a
comparison of numbers and no tree is walked: the descendants of m are the nodes
with m.id < n.id <= m.last.  A node-set is an array of numbers in document
order.  Names compare without case and, unless they carry a prefix, without
namespace; values compare with case.

``find`` compiles a path on the driver and raises ValueError where the path
isn't understood.  Documents that couldn't be read (null nodes) give null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_lexer = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|('[^']*'|\"[^\"]*\")|(::|//|\.\.|!=|<=|>=|[/.@\[\]()|,=<>+*-])|([A-Za-z_][\w.-]*(?::(?!:)(?:[A-Za-z_][\w.-]*|\*))?))")
_node_tests = ("text", "node", "comment", "processing-instruction")


@dataclass
class Value:
    """A compiled value; ``kind`` is nodes, strings, string, number or bool."""

    kind: str
    col: Column


def _axes() -> dict[str, Callable[[Column, Column], Column]]:
    """Whether n lies on the axis of m."""
    return {
        "child": lambda n, m: n["parent"] == m["id"],
        "self": lambda n, m: n["id"] == m["id"],
        "parent": lambda n, m: n["id"] == m["parent"],
        "descendant": lambda n, m: (n["id"] > m["id"]) & (n["id"] <= m["last"]),
        "descendant-or-self": lambda n, m: (n["id"] >= m["id"]) & (n["id"] <= m["last"]),
        "ancestor": lambda n, m: (n["id"] < m["id"]) & (n["last"] >= m["id"]),
        "ancestor-or-self": lambda n, m: (n["id"] <= m["id"]) & (n["last"] >= m["id"]),
        "following": lambda n, m: n["id"] > m["last"],
        "preceding": lambda n, m: n["last"] < m["id"],
        "following-sibling": lambda n, m: (n["parent"] == m["parent"]) & (n["id"] > m["id"]),
        "preceding-sibling": lambda n, m: (n["parent"] == m["parent"]) & (n["id"] < m["id"]),
    }


_REVERSE = ("ancestor", "ancestor-or-self", "preceding", "preceding-sibling")
_NONE = "array<int>"


class Compiler:
    """Recursive descent over one path; ``nodes`` is the array of the document's nodes."""

    def __init__(self, nodes: Column, path: str, start: Column | None, namespaces: dict[str, str] | None):
        self.nodes, self.namespaces, self.start = nodes, namespaces or {}, start
        self.tokens, at = [], 0
        while at < len(path.rstrip()):
            m = _lexer.match(path, at)
            if not m:
                raise ValueError(f"{path!r} isn't a path: {path[at:]!r}")
            self.tokens.append(m.group(m.lastindex))
            at = m.end()
        self.i = 0

    # -- tokens

    def peek(self, k: int = 0) -> str | None:
        return self.tokens[self.i + k] if self.i + k < len(self.tokens) else None

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if t is None or (want is not None and t != want):
            raise ValueError(f"expected {want or 'more'}, found {t}")
        self.i += 1
        return t

    def took(self, *wanted: str) -> str | None:
        return self.take() if self.peek() in wanted else None

    # -- conversions

    def node(self, number: Column) -> Column:
        return F.get(self.nodes, number)

    def string_value(self, number: Column) -> Column:
        """The texts of an element and those below it, in the document's order."""
        m = self.node(number)
        piece = lambda n, after, text: F.struct(after.alias("after"), (-n["depth"]).alias("deepest"), text.alias("text"))
        texts = lambda n: F.coalesce(F.transform(n["mixed"], lambda t: piece(n, t["after"], t["text"])), F.array(piece(n, n["id"], n["text"])))
        inside = F.flatten(F.transform(F.filter(self.nodes, lambda n: (n["id"] >= number) & (n["id"] <= m["last"])), texts))
        below = F.btrim(F.array_join(F.transform(F.array_sort(inside), lambda t: t["text"]), ""), F.lit(" \t\r\n"))
        return F.when(m["last"] == number, m["text"]).otherwise(below)

    def strings(self, v: Value) -> Column:
        if v.kind == "nodes":
            return F.transform(v.col, self.string_value)
        return v.col if v.kind == "strings" else F.array(self.string(v))

    def string(self, v: Value) -> Column:
        if v.kind in ("nodes", "strings"):
            return F.coalesce(F.get(self.strings(v), F.lit(0)), F.lit(""))
        if v.kind == "number":
            whole = v.col.cast("long")
            return F.when(v.col == whole, whole.cast("string")).otherwise(v.col.cast("string"))
        return v.col.cast("string")

    def number(self, v: Value) -> Column:
        return v.col if v.kind == "number" else v.col.cast("double") if v.kind == "bool" else F.btrim(self.string(v)).try_cast("double")

    def boolean(self, v: Value) -> Column:
        if v.kind in ("nodes", "strings"):
            return F.size(v.col) > 0
        if v.kind == "number":
            return F.coalesce(v.col != 0, F.lit(False))
        return v.col if v.kind == "bool" else v.col != ""

    # -- expressions; ``ctx`` is the context node's number, ``pos`` and ``size`` its place

    def expression(self, ctx, pos, size) -> Value:
        left = self.both(ctx, pos, size)
        while self.took("or"):
            left = Value("bool", self.boolean(left) | self.boolean(self.both(ctx, pos, size)))
        return left

    def both(self, *at) -> Value:
        left = self.comparison(*at)
        while self.took("and"):
            left = Value("bool", self.boolean(left) & self.boolean(self.comparison(*at)))
        return left

    def comparison(self, *at) -> Value:
        left = self.sum(*at)
        while op := self.took("=", "!=", "<", "<=", ">", ">="):
            left = self.compare(op, left, self.sum(*at))
        return left

    def compare(self, op: str, a: Value, b: Value) -> Value:
        test = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
        many = [v.kind in ("nodes", "strings") for v in (a, b)]
        if "bool" in (a.kind, b.kind):
            return Value("bool", test(self.boolean(a), self.boolean(b)))
        numeric = "number" in (a.kind, b.kind) or op not in ("=", "!=")
        as_type = (lambda c: F.btrim(c).try_cast("double")) if numeric else (lambda c: c)
        if not any(many):
            x, y = (self.number(a), self.number(b)) if numeric else (self.string(a), self.string(b))
            return Value("bool", F.coalesce(test(x, y), F.lit(False)))
        # A set fulfils a comparison if one of its members does.
        left, right = self.strings(a), self.strings(b)
        return Value("bool", F.exists(left, lambda x: F.exists(right, lambda y: F.coalesce(test(as_type(x), as_type(y)), F.lit(False)))))

    def sum(self, *at) -> Value:
        left = self.product(*at)
        while op := self.took("+", "-"):
            x, y = self.number(left), self.number(self.product(*at))
            left = Value("number", x + y if op == "+" else x - y)
        return left

    def product(self, *at) -> Value:
        left = self.unary(*at)
        while op := self.took("*", "div", "mod"):
            x, y = self.number(left), self.number(self.unary(*at))
            left = Value("number", x * y if op == "*" else F.try_divide(x, y) if op == "div" else F.try_mod(x, y))
        return left

    def unary(self, *at) -> Value:
        if self.took("-"):
            return Value("number", -self.number(self.unary(*at)))
        """A union; attributes and texts have no numbers, so those of two paths stay apart unless the paths read the same."""
        start = self.i
        left, seen = self.path(*at), []
        seen.append(self.tokens[start : self.i])
        while self.took("|"):
            start = self.i
            right = self.path(*at)
            if left.kind != right.kind or left.kind not in ("nodes", "strings"):
                raise ValueError("only sets of one kind can be united")
            if left.kind == "nodes":
                left = Value("nodes", F.array_sort(F.array_union(left.col, right.col)))
            elif self.tokens[start : self.i] not in seen:
                left = Value("strings", F.concat(left.col, right.col))
            seen.append(self.tokens[start : self.i])
        return left

    # -- paths

    def path(self, ctx, pos, size) -> Value:
        t = self.peek()
        if t is None:
            raise ValueError("the path ends too early")
        if t[0] in "'\"":
            return Value("string", F.lit(self.take()[1:-1]))
        if t[0].isdigit() or (t[0] == "." and len(t) > 1 and t != ".."):
            return Value("number", F.lit(float(self.take())))
        if t == "(":
            self.take()
            inner = self.expression(ctx, pos, size)
            self.take(")")
            return self.steps(self.filtered(inner)) if self.peek() in ("/", "//", "[") else inner
        if self.peek(1) == "(" and t not in _node_tests:
            return self.function(ctx, pos, size)
        if t in ("/", "//"):
            # the document's node stands above the root element, numbered -1
            if t == "/" and (self.peek(1) is None or self.peek(1) in ")]|,"):
                self.take()
                return Value("nodes", F.array(F.lit(0)))
            return self.steps(Value("nodes", F.array(F.lit(-1))))
        return self.steps(Value("nodes", F.array(ctx)), first=True)

    def steps(self, v: Value, first: bool = False) -> Value:
        while first or self.peek() in ("/", "//"):
            deep = False if first else self.take() == "//"
            first = False
            if v.kind != "nodes":
                raise ValueError("nothing follows an attribute or a text")
            v = self.step(v, deep)
        return v

    def step(self, v: Value, deep: bool) -> Value:
        if deep:
            v = Value("nodes", self.walk(v.col, "descendant-or-self", lambda n: F.lit(True), keep_top=True))
        if self.took("."):
            return v
        if self.took(".."):
            return self.filtered(Value("nodes", self.walk(v.col, "parent", lambda n: F.lit(True))))
        if self.took("@") or (self.peek() == "attribute" and self.peek(1) == "::" and self.took("attribute") and self.take("::")):
            return self.attribute(v, self.take())
        axis = "child"
        if self.peek(1) == "::":
            axis = self.take()
            self.take("::")
            if axis == "namespace":
                return self.namespace(v, self.take())
            if axis not in _axes():
                raise ValueError(f"the axis {axis} isn't supported")
        name = self.take()
        if name in _node_tests and self.took("("):
            target = self.take() if self.peek() != ")" else None
            self.take(")")
            if name in ("comment", "processing-instruction"):
                if axis != "child" or (target and name == "comment"):
                    raise ValueError(f"{name}() stands on the child axis, a target only in processing-instruction()")
                return self.noted(v, "comment" if name == "comment" else "instruction", target and target.strip("'\""))
            if target:
                raise ValueError(f"{name}() takes nothing")
            if name == "text":
                return Value("strings", F.filter(F.transform(v.col, lambda c: self.node(c)["text"]), lambda x: x != ""))
            return self.filtered_walk(v, axis, lambda n: F.lit(True))
        return self.filtered_walk(v, axis, self.name_test(name))

    def noted(self, v: Value, kind: str, target: str | None) -> Value:
        """Comments or instructions below these nodes; those above the root belong to the document's node."""
        same = lambda x, k: (x["kind"] == k) & (F.lit(True) if target is None else x["target"] == target)
        of = lambda c: F.when(c == -1, F.filter(self.node(F.lit(0))["notes"], lambda x: same(x, f"above {kind}"))).otherwise(F.filter(self.node(c)["notes"], lambda x: same(x, kind)))
        found = F.filter(F.transform(v.col, of), lambda xs: xs.isNotNull())
        return Value("strings", F.transform(F.flatten(found), lambda x: x["text"]))

    def namespace(self, v: Value, name: str) -> Value:
        """The addresses of the namespaces in scope, ``*`` or by prefix; that of ``xml`` always is."""

        def of(c: Column) -> Column:
            m = self.node(c)
            declared = F.filter(self.nodes, lambda n: (n["id"] <= m["id"]) & (n["last"] >= m["id"]) & n["spaces"].isNotNull())
            scope = F.try_element_at(declared, F.lit(-1))["spaces"]
            here = F.filter(F.map_values(scope), lambda u: u != "") if name == "*" else F.filter(F.array(F.element_at(scope, name.lower())), lambda u: u != "")
            own = F.array(F.lit("http://www.w3.org/XML/1998/namespace")) if name in ("*", "xml") else F.array().cast("array<string>")
            return F.concat(own, F.coalesce(here, F.array().cast("array<string>")))

        return Value("strings", F.flatten(F.transform(F.filter(v.col, lambda c: c >= 0), of)))

    def name_test(self, name: str) -> Callable[[Column], Column]:
        prefix, _, local = name.lower().rpartition(":")
        same = (lambda n: F.lit(True)) if local == "*" else (lambda n: n["name"] == local)
        if not prefix:
            return same
        uri = self.namespaces.get(prefix)
        return lambda n: same(n) & ((n["prefix"] == prefix) if uri is None else ((n["ns"] == uri) | ((n["ns"] == "") & (n["prefix"] == prefix))))

    def attribute(self, v: Value, name: str) -> Value:
        maps = F.transform(v.col, lambda c: self.node(c)["attrs"])
        if name == "*":
            return Value("strings", F.flatten(F.transform(F.filter(maps, lambda m: m.isNotNull()), F.map_values)))
        return Value("strings", F.filter(F.transform(maps, lambda m: F.element_at(m, name.lower())), lambda x: x.isNotNull()))

    def on_axis(self, ctx: Column, axis: str, test) -> Column:
        """Numbers on the axis of one context node, in the axis' order."""
        lies = _axes()[axis]
        m = self.node(ctx)
        if axis in ("child", "descendant", "descendant-or-self"):
            top = (lambda n: n["parent"] == -1) if axis == "child" else (lambda n: F.lit(True))
            hit = lambda n: F.when(ctx == -1, top(n)).otherwise(lies(n, m))
        else:
            hit = lambda n: F.when(ctx == -1, F.lit(False)).otherwise(lies(n, m))
        found = F.transform(F.filter(self.nodes, lambda n: hit(n) & test(n)), lambda n: n["id"])
        return F.reverse(found) if axis in _REVERSE else found

    def walk(self, ctx: Column, axis: str, test, keep_top: bool = False) -> Column:
        found = F.flatten(F.transform(ctx, lambda c: self.on_axis(c, axis, test)))
        if keep_top:
            found = F.concat(F.filter(ctx, lambda c: c == -1), found)
        return F.array_sort(F.array_distinct(found))

    def filtered_walk(self, v: Value, axis: str, test) -> Value:
        if self.peek() != "[":
            return Value("nodes", self.walk(v.col, axis, test))
        # Places count from each context node, so predicates apply before the sets are joined.
        start = self.i

        def one(c: Column) -> Column:
            self.i = start
            return self.filtered(Value("nodes", self.on_axis(c, axis, test))).col

        return Value("nodes", F.array_sort(F.array_distinct(F.flatten(F.transform(v.col, one)))))

    def filtered(self, v: Value) -> Value:
        while self.peek() == "[":
            if v.kind != "nodes":
                raise ValueError("predicates apply to elements")
            self.take()
            v = Value("nodes", F.filter(v.col, self.predicate(self.i, F.size(v.col))))
            self.take("]")
        return v

    def predicate(self, start: int, size: Column) -> Callable[[Column, Column], Column]:
        def holds(c: Column, k: Column) -> Column:
            self.i = start
            x = self.expression(c, (k + 1).cast("double"), size.cast("double"))
            return (x.col == k + 1) if x.kind == "number" else self.boolean(x)

        return holds

    def function(self, ctx, pos, size) -> Value:
        name, args = self.take(), []
        self.take("(")
        while self.peek() != ")":
            args.append(self.expression(ctx, pos, size))
            self.took(",")
        self.take(")")
        here = Value("nodes", F.array(ctx))
        s = lambda k: self.string(args[k] if len(args) > k else here)
        n = lambda k: self.number(args[k])
        local = lambda: F.coalesce(self.node(F.get((args[0] if args else here).col, F.lit(0)))["name"], F.lit(""))

        def full() -> Column:
            m = self.node(F.get((args[0] if args else here).col, F.lit(0)))
            return F.coalesce(F.when(m["prefix"] != "", F.concat_ws(":", m["prefix"], m["name"])).otherwise(m["name"]), F.lit(""))

        rules: dict[str, Callable[[], Value]] = {
            "position": lambda: Value("number", pos),
            "last": lambda: Value("number", size),
            "count": lambda: Value("number", F.size(args[0].col).cast("double")),
            "sum": lambda: Value("number", F.aggregate(self.strings(args[0]), F.lit(0.0), lambda a, x: a + F.btrim(x).try_cast("double"))),
            "name": lambda: Value("string", full()),
            "local-name": lambda: Value("string", local()),
            "string": lambda: Value("string", s(0)),
            "number": lambda: Value("number", self.number(args[0] if args else here)),
            "boolean": lambda: Value("bool", self.boolean(args[0])),
            "not": lambda: Value("bool", ~self.boolean(args[0])),
            "true": lambda: Value("bool", F.lit(True)),
            "false": lambda: Value("bool", F.lit(False)),
            "contains": lambda: Value("bool", s(0).contains(s(1))),
            "starts-with": lambda: Value("bool", F.startswith(s(0), s(1))),
            "concat": lambda: Value("string", F.concat(*[self.string(a) for a in args])),
            "string-length": lambda: Value("number", F.length(s(0)).cast("double")),
            "normalize-space": lambda: Value("string", F.btrim(F.regexp_replace(s(0), r"\s+", " "))),
            "substring": lambda: Value("string", F.substring(s(0), n(1).cast("int"), n(2).cast("int")) if len(args) > 2 else F.substring(s(0), n(1).cast("int"), F.length(s(0)))),
            "substring-before": lambda: Value("string", _before(s(0), s(1))),
            "substring-after": lambda: Value("string", _after(s(0), s(1))),
            "floor": lambda: Value("number", F.floor(n(0)).cast("double")),
            "ceiling": lambda: Value("number", F.ceil(n(0)).cast("double")),
            "round": lambda: Value("number", F.floor(n(0) + 0.5).cast("double")),
        }
        if name not in rules:
            raise ValueError(f"the function {name} isn't supported")
        out = rules[name]()
        return self.steps(self.filtered(out)) if out.kind == "nodes" and self.peek() in ("[", "/", "//") else out


def _before(text: Column, part: Column) -> Column:
    at = F.instr(text, part)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise("")


def _after(text: Column, part: Column) -> Column:
    at = F.instr(text, part)
    return F.when(at > 0, F.substring(text, at + F.length(part), F.length(text))).otherwise("")


def _compile(nodes: Column, path: str, start: Column | None, namespaces: dict[str, str] | None) -> tuple[Compiler, Value]:
    c = Compiler(nodes, path, start, namespaces)
    v = c.expression(F.lit(0) if start is None else start, F.lit(1.0), F.lit(1.0))
    if c.peek() is not None:
        raise ValueError(f"{path!r}: {c.peek()!r} is left over")
    return c, v


def find_all(nodes: Column, path: str, start: Column | None = None, namespaces: dict[str, str] | None = None) -> Column:
    """All values of a path as strings: elements' texts, attributes, or one scalar.

    Relative paths start at ``start`` (a node's number), or else at the root element.
    """
    c, v = _compile(nodes, path, start, namespaces)
    return F.when(nodes.isNotNull(), c.strings(v))


def find(nodes: Column, path: str, start: Column | None = None, namespaces: dict[str, str] | None = None) -> Column:
    """The first value of a path, null where there is none."""
    return F.get(find_all(nodes, path, start, namespaces), F.lit(0))


def find_ids(nodes: Column, path: str, start: Column | None = None, namespaces: dict[str, str] | None = None) -> Column:
    """The numbers of the elements of a path, in document order."""
    _, v = _compile(nodes, path, start, namespaces)
    if v.kind != "nodes":
        raise ValueError(f"{path!r} doesn't give elements")
    return F.when(nodes.isNotNull(), v.col)


def _not_blank(c: Column) -> Column:
    return F.filter(F.transform(c, lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")


def try_paths(nodes: Column, paths: list[str], start: Column | None = None, namespaces: dict[str, str] | None = None, reject: Callable[[Column], Column] | None = None) -> Column:
    """The first value that isn't blank, and that ``reject`` doesn't refuse, trying the paths in order."""
    found = lambda p: _not_blank(find_all(nodes, p, start, namespaces))
    fit = found if reject is None else (lambda p: F.filter(found(p), lambda x: ~F.coalesce(reject(x), F.lit(False))))
    return F.coalesce(*[F.get(fit(p), F.lit(0)) for p in paths])


def try_paths_all(nodes: Column, paths: list[str], start: Column | None = None, namespaces: dict[str, str] | None = None) -> Column:
    """All elements of the first path that gives any."""
    ids = [find_ids(nodes, p, start, namespaces) for p in paths]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in ids], F.array().cast(_NONE))


def combine_paths_all(nodes: Column, paths: list[str], start: Column | None = None, namespaces: dict[str, str] | None = None) -> Column:
    """The elements of all paths, each once, in the paths' order."""
    return F.array_distinct(F.concat(*[find_ids(nodes, p, start, namespaces) for p in paths]))
