"""XPath 1.0 location paths over ``_dom`` nodes: all usual axes, predicates, unions and core functions."""

from __future__ import annotations

import re
from functools import lru_cache

from ._dom import Node

_TOKEN = re.compile(r"\s*(?:(//|::|\.\.|<=|>=|!=|[/@.\[\]()|,=<>+*-])|(\d+(?:\.\d+)?|\.\d+)|(\"[^\"]*\"|'[^']*')|([A-Za-z_\u0080-￿][\w\-.]*(?::(?!:)(?:[A-Za-z_][\w\-.]*|\*))?))")
AXES = ("ancestor", "ancestor-or-self", "attribute", "child", "descendant", "descendant-or-self", "following", "following-sibling", "parent", "preceding", "preceding-sibling", "self")


#: Operators whose expressions, of names and texts, are node-sets or truths.
_NO_NUMBER = frozenset(("/", "//", "..", ".", "@", "=", "!=", "[", "]", "::", "|"))


class XPathError(ValueError):
    pass


def tokens(path: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(path.rstrip()):
        m = _TOKEN.match(path, at)
        if not m:
            raise XPathError(path)
        for kind, value in zip(("op", "num", "str", "name"), m.groups(), strict=True):
            if value is not None:
                out.append((kind, value))
        at = m.end()
    return out


def _below(n: Node) -> list[Node]:
    return list(n.walk())[1:]


def _up(n: Node) -> list[Node]:
    out = []
    while (n := n.parent) is not None:
        out.append(n)
    return out


def _siblings(n: Node, step: int) -> list[Node]:
    if n.parent is None or n.kind == "attribute":
        return []
    k = next(i for i, c in enumerate(n.parent.children) if c is n)
    return n.parent.children[k + 1 :] if step > 0 else n.parent.children[:k][::-1]


def _attributes(n: Node) -> list[Node]:
    out = []
    for k, v in n.attrs.items():
        if k != "xmlns" and not k.startswith("xmlns:"):
            a = Node("attribute", k, None, n.line, v)
            a.parent, a.order = n, n.order + (len(out) + 1) / 65536
            out.append(a)
    return out


_WALKS = {
    "child": lambda n: n.children, "descendant": _below, "descendant-or-self": lambda n: list(n.walk()), "self": lambda n: [n], "attribute": _attributes,
    "parent": lambda n: [n.parent] if n.parent is not None else [], "ancestor": _up, "ancestor-or-self": lambda n: [n, *_up(n)],
    "following-sibling": lambda n: _siblings(n, 1), "preceding-sibling": lambda n: _siblings(n, -1),
    "following": lambda n: [d for a in [n, *_up(n)] for s in _siblings(a, 1) for d in s.walk()],
    "preceding": lambda n: [d for a in [n, *_up(n)] for s in _siblings(a, -1) for d in reversed(list(s.walk()))],
}


def text_of(v) -> str:
    if isinstance(v, list):
        return v[0].string() if v else ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return "NaN" if v != v else str(int(v)) if v == int(v) else repr(v)
    return v


def number_of(v) -> float:
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, float):
        return v
    try:
        return float(text_of(v).strip())
    except ValueError:
        return float("nan")


def truth_of(v) -> bool:
    return v == v and v != 0 if isinstance(v, float) else bool(v)


def _compare(op: str, a, b) -> bool:
    if isinstance(a, list) and not isinstance(b, bool):
        return any(_compare(op, n.string(), b) for n in a)
    if isinstance(b, list) and not isinstance(a, bool):
        return any(_compare(op, a, n.string()) for n in b)
    if op in ("=", "!="):
        if isinstance(a, bool) or isinstance(b, bool):
            same = truth_of(a) == truth_of(b)
        elif isinstance(a, float) or isinstance(b, float):
            same = number_of(a) == number_of(b)
        else:
            same = text_of(a) == text_of(b)
        return same == (op == "=")
    x, y = number_of(a), number_of(b)
    return x < y if op == "<" else x > y if op == ">" else x <= y if op == "<=" else x >= y


def _substring(s: str, start: float, length: float = float("inf")) -> str:
    first = round(start)
    return "".join(c for k, c in enumerate(s, 1) if first <= k < first + length)


_CALLS = {
    "count": lambda c, v: float(len(v)), "contains": lambda c, a, b: text_of(b) in text_of(a), "starts-with": lambda c, a, b: text_of(a).startswith(text_of(b)),
    "not": lambda c, v: not truth_of(v), "string": lambda c, v=None: text_of([c[0]] if v is None else v), "number": lambda c, v=None: number_of([c[0]] if v is None else v),
    "boolean": lambda c, v: truth_of(v), "true": lambda c: True, "false": lambda c: False, "position": lambda c: float(c[1]), "last": lambda c: float(c[2]),
    "name": lambda c, v=None: (c[0] if v is None else v[0] if v else Node("text", "", None, 0)).name, "local-name": lambda c, v=None: (lambda n: n.name if n.namespaces().get(n.name.partition(":")[0]) is None and ":" in n.name else n.local)(c[0] if v is None else v[0] if v else Node("text", "", None, 0)),
    "namespace-uri": lambda c, v=None: (lambda n: n.namespaces().get(n.name.rpartition(":")[0], ""))(c[0] if v is None else v[0] if v else Node("text", "", None, 0)),
    "string-length": lambda c, v=None: float(len(text_of([c[0]] if v is None else v))), "normalize-space": lambda c, v=None: " ".join(text_of([c[0]] if v is None else v).split()),
    "concat": lambda c, *v: "".join(map(text_of, v)), "substring": lambda c, s, *v: _substring(text_of(s), *map(number_of, v)),
    "substring-before": lambda c, a, b: text_of(a).partition(text_of(b))[0] if text_of(b) in text_of(a) else "", "substring-after": lambda c, a, b: text_of(a).partition(text_of(b))[2],
    "translate": lambda c, s, a, b: text_of(s).translate({ord(x): text_of(b)[k] if k < len(text_of(b)) else None for k, x in reversed(list(enumerate(text_of(a))))}),
    "sum": lambda c, v: sum((number_of(n.string()) for n in v), 0.0), "floor": lambda c, v: float(number_of(v) // 1), "ceiling": lambda c, v: -float(-number_of(v) // 1), "round": lambda c, v: float((number_of(v) + 0.5) // 1),
}


class Compiled:
    """An expression; contexts are (node, position, size, namespaces)."""

    def __init__(self, path: str):
        self.t, self.k = tokens(path), 0
        self.run = self._binary(0)
        if self.k != len(self.t):
            raise XPathError(path)

    def _peek(self, *values: str) -> bool:
        return self.k < len(self.t) and self.t[self.k][0] in ("op", "name") and self.t[self.k][1] in values

    def _take(self, value: str | None = None) -> str:
        if self.k >= len(self.t) or value is not None and self.t[self.k][1] != value:
            raise XPathError(value or "end")
        self.k += 1
        return self.t[self.k - 1][1]

    _LEVELS = (("or",), ("and",), ("=", "!="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "div", "mod"))

    def _binary(self, level: int):
        if level == len(self._LEVELS):
            return self._unary()
        left = self._binary(level + 1)
        while self._peek(*self._LEVELS[level]):
            op = self._take()
            left = self._joined(op, left, self._binary(level + 1))
        return left

    @staticmethod
    def _joined(op: str, a, b):
        if op == "or":
            return lambda c: truth_of(a(c)) or truth_of(b(c))
        if op == "and":
            return lambda c: truth_of(a(c)) and truth_of(b(c))
        if op in ("+", "-", "*", "div", "mod"):
            do = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "div": lambda x, y: x / y if y else float("nan"), "mod": lambda x, y: x - y * int(x / y) if y else float("nan")}[op]
            return lambda c: do(number_of(a(c)), number_of(b(c)))
        return lambda c: _compare(op, a(c), b(c))

    def _unary(self):
        if self._peek("-"):
            self._take()
            inner = self._unary()
            return lambda c: -number_of(inner(c))
        parts = [self._path()]
        while self._peek("|"):
            self._take()
            parts.append(self._path())
        return parts[0] if len(parts) == 1 else lambda c: _ordered([n for p in parts for n in p(c)])

    def _path(self):
        kind, value = self.t[self.k] if self.k < len(self.t) else ("", "")
        after = self.t[self.k + 1][1] if self.k + 1 < len(self.t) else ""
        if kind == "num":
            self.k += 1
            return lambda c, v=float(value): v
        if kind == "str":
            self.k += 1
            return lambda c, v=value[1:-1]: v
        if value == "(" and kind == "op":
            self._take()
            base = self._binary(0)
            self._take(")")
        elif kind == "name" and after == "(" and value not in ("text", "node", "comment", "processing-instruction"):
            base = self._call()
        else:
            return self._steps(None)
        while self._peek("["):
            base = self._filtered(base, self._predicate())
        return self._steps(base) if self._peek("/", "//") else base

    def _call(self):
        name, args = self._take(), []
        self._take("(")
        while not self._peek(")"):
            args.append(self._binary(0))
            if self._peek(","):
                self._take()
        self._take(")")
        if name not in _CALLS:
            raise XPathError(name)
        return lambda c: _CALLS[name](c, *(a(c) for a in args))

    def _predicate(self):
        self._take("[")
        inner = self._binary(0)
        self._take("]")
        return inner

    @staticmethod
    def _kept(nodes: list[Node], test, names: dict) -> list[Node]:
        out = []
        for k, n in enumerate(nodes, 1):
            v = test((n, k, len(nodes), names))
            if v == k if isinstance(v, float) else truth_of(v):
                out.append(n)
        return out

    def _filtered(self, base, test):
        return lambda c: self._kept(base(c), test, c[3])

    def _steps(self, base):
        steps, absolute = [], False
        if self._peek("/", "//"):
            absolute = base is None
            below = self._take() == "//"
            if not below and absolute and (self.k >= len(self.t) or self.t[self.k][1] in ("|", "]", ")", ",", "=")):
                return lambda c: [([*_up(c[0])] or [c[0]])[-1]]
            steps += self._stepped(below)
        else:
            steps += self._stepped(False)
        while self._peek("/", "//"):
            steps += self._stepped(self._take() == "//")

        def run(c):
            if base is not None:
                now = base(c)
            else:
                now = [([*_up(c[0])] or [c[0]])[-1]] if absolute else [c[0]]
            for axis, test, predicates in steps:
                found = []
                for n in now:
                    some = [x for x in _WALKS[axis](n) if test(x, c[3])]
                    for p in predicates:
                        some = self._kept(some, p, c[3])
                    found.extend(some)
                now = _ordered(found)
            return now

        return run

    def _stepped(self, below: bool) -> list:
        """A step; after "//" one over all descendants, or over the children of each where its predicates may ask for positions."""
        begun = self.k
        axis, test, predicates = self._step()
        if below and axis == "child":
            asked = self.t[begun : self.k]
            if not predicates or all(k == "str" or k == "name" and v not in ("div", "mod") or k == "op" and v in _NO_NUMBER for k, v in asked):
                return [("descendant", test, predicates)]
        return [("descendant-or-self", lambda n, ns: True, []), (axis, test, predicates)] if below else [(axis, test, predicates)]

    def _step(self):
        if self._peek("."):
            self._take()
            return "self", lambda n, ns: True, []
        if self._peek(".."):
            self._take()
            return "parent", lambda n, ns: True, []
        axis = "child"
        if self._peek("@"):
            self._take()
            axis = "attribute"
        elif self.k + 1 < len(self.t) and self.t[self.k + 1][1] == "::":
            axis = self._take()
            self._take("::")
            if axis not in AXES:
                raise XPathError(axis)
        kind = "attribute" if axis == "attribute" else "element"
        name = self._take()
        if name in ("text", "node", "comment", "processing-instruction") and self._peek("("):
            self._take("(")
            if not self._peek(")"):
                self._take()
            self._take(")")
            kinds = {"text": ("text", "cdata"), "comment": ("comment",), "processing-instruction": ("pi",)}.get(name)
            test = lambda n, ns: kinds is None or n.kind in kinds
        elif name == "*":
            test = lambda n, ns: n.kind == kind
        else:
            if not re.match(r"[^\W\d]", name):
                raise XPathError(name)
            test = lambda n, ns: n.kind == kind and _same(n, name, ns)
        predicates = []
        while self._peek("["):
            predicates.append(self._predicate())
        return axis, test, predicates


def _same(node: Node, wanted: str, names: dict) -> bool:
    """A name test: prefixes compare by what they stand for; an unprefixed test means no namespace, also no default one."""
    prefix, _, local = wanted.rpartition(":")
    if not prefix and node.name != wanted:
        return False
    own = node.name.rpartition(":")[0]
    scope = node.namespaces() if own or "xmlns" in str(names.get("", "")) or not prefix else {}
    uri = scope.get(own) if own or node.kind == "element" else None
    if prefix:
        return names.get(prefix) is not None and uri == names[prefix] and local in ("*", node.local)
    return node.name == wanted and not own and (node.kind == "attribute" or not scope.get(""))


def _ordered(nodes: list[Node]) -> list[Node]:
    if len(nodes) < 2:
        return nodes
    return sorted({(n.order, n.name if n.kind == "attribute" else ""): n for n in nodes}.values(), key=lambda n: n.order)


@lru_cache(maxsize=512)
def compiled(path: str) -> Compiled | None:
    try:
        return Compiled(path)
    except (XPathError, RecursionError):
        return None


def select(root: Node | None, path: str | None, names: dict | None = None) -> list[Node]:
    """The selected nodes; none where the document, the path or its result is no node-set."""
    expression = compiled(path) if path else None
    if root is None or expression is None:
        return []
    top = next((c for c in root.children if c.kind == "element"), root)
    known = {k: v for k, v in top.namespaces().items() if k} | (names or {})
    try:
        found = expression.run((root, 1, 1, known))
    except (XPathError, TypeError, AttributeError, RecursionError):
        return []
    return found if isinstance(found, list) else []
