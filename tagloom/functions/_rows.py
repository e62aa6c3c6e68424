"""What the registered functions compute for one document; see ``tagloom.functions`` for the Spark side."""

from __future__ import annotations

import json
import re
from functools import lru_cache

from ._dom import Node, escape, parse_html, parse_xml, serialize
from ._xpath import select

#: Well-known namespace prefixes (fixed values).
NAMESPACES = {
    "xml": "http://www.w3.org/XML/1998/namespace",
    "xmlns": "http://www.w3.org/2000/xmlns/",
    "xsi": "http://www.w3.org/2001/XMLSchema-instance",
    "xsd": "http://www.w3.org/2001/XMLSchema",
    "xs": "http://www.w3.org/2001/XMLSchema",
    "xhtml": "http://www.w3.org/1999/xhtml",
    "svg": "http://www.w3.org/2000/svg",
    "xlink": "http://www.w3.org/1999/xlink",
    "mathml": "http://www.w3.org/1998/Math/MathML",
    "atom": "http://www.w3.org/2005/Atom",
    "rss": "http://purl.org/rss/1.0/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "gml": "http://www.opengis.net/gml",
    "gml32": "http://www.opengis.net/gml/3.2",
    "kml": "http://www.opengis.net/kml/2.2",
    "gpx": "http://www.topografix.com/GPX/1/1",
    "georss": "http://www.georss.org/georss",
    "soap": "http://schemas.xmlsoap.org/soap/envelope/",
    "soap12": "http://www.w3.org/2003/05/soap-envelope",
    "wsdl": "http://schemas.xmlsoap.org/wsdl/",
    "office": "urn:oasis:names:tc:opendocument:xmlns:office:1.0",
    "odt": "urn:oasis:names:tc:opendocument:xmlns:text:1.0",
    "ods": "urn:oasis:names:tc:opendocument:xmlns:spreadsheet:1.0",
    "xslt": "http://www.w3.org/1999/XSL/Transform",
    "exsl": "http://exslt.org/common",
}
DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>\n'
_NAME = re.compile(r"[A-Za-z_][\w.\-]*(?::[A-Za-z_][\w.\-]*)?")
PREFIX = r"([A-Za-z_][A-Za-z0-9_.-]*):(?!:)[A-Za-z_*]"
AXES = frozenset("ancestor ancestor-or-self attribute child descendant descendant-or-self following following-sibling namespace parent preceding preceding-sibling self".split())


@lru_cache(maxsize=8)
def _xml(text: str | None) -> Node | None:
    return parse_xml(text)


@lru_cache(maxsize=8)
def _html(text: str | None) -> Node | None:
    return parse_html(text)


def valid(text: str | None) -> bool | None:
    return None if text is None else _xml(text) is not None


def _used_prefixes(text: str) -> set[str]:
    return set(re.findall(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]", re.sub(r"<!--.*?-->|\"[^\"]*\"|'[^']*'", "", text, flags=re.S))) - {"xmlns", "xml"}


def detect_prefixes(path: str | None) -> list[str] | None:
    return None if path is None else sorted(set(re.findall(PREFIX, re.sub(r"\"[^\"]*\"|'[^']*'", "", path))) - AXES)


def _root(text: str | None, path: str | None, mode) -> tuple[Node | None, dict]:
    """The document and the prefixes that ``mode`` (strict, ignore, auto, or a map) makes known."""
    if text is None:
        return None, {}
    if isinstance(mode, str) and mode.lower() not in ("strict", "ignore", "auto"):
        raise ValueError(f"namespaces must be 'strict', 'ignore', 'auto' or a map, not {mode!r}")
    if mode is None or isinstance(mode, str) and mode.lower() != "auto":
        return _xml(text), {}
    if isinstance(mode, str):
        names = {p: NAMESPACES.get(p.lower(), f"urn:mock:{p}") for p in _used_prefixes(text) | set(detect_prefixes(path or ""))}
    else:
        names = dict(mode)
    lacking = {p: u for p, u in names.items() if p and f"xmlns:{p}=" not in text}
    root = _xml(add_namespace_declarations(text, lacking) if lacking else text)
    top = root and next((c for c in root.children if c.kind == "element"), None)
    declared = top.namespaces() if top else {}
    return root, names | {p: u for p, u in declared.items() if p and not (isinstance(mode, dict) and p in names)}


def extract_text(text, path, mode=None) -> list[str]:
    return [n.string() for n in select(*_with(text, path, mode))]


def _with(text, path, mode):
    root, names = _root(text, path, mode)
    return root, path, names


def extract_elements(text, path, mode=None) -> list[str]:
    return [serialize(n).strip() for n in select(*_with(text, path, mode))]


def extract_all_text(text):
    root = _xml(text)
    return None if text is None else "" if root is None else root.string()


def _path_of(n: Node) -> str:
    parts = []
    while n.kind == "element":
        parts.append(n.name)
        n = n.parent
    return "/" + "/".join(reversed(parts))


def extract_attributes(text, path, mode=None) -> list[dict]:
    return [
        {"element_name": n.local, "element_path": _path_of(n), "attribute_name": k.rpartition(":")[2], "attribute_value": v, "line_number": n.line}
        for n in select(*_with(text, path, mode))
        if n.kind == "element"
        for k, v in sorted(n.attrs.items())
        if v and k != "xmlns" and not k.startswith("xmlns:")
    ]


def _of_kind(text, kind):
    root = _xml(text)
    return None if text is None else [{"content": n.text, "line_number": n.line} for n in root.walk() if n.kind == kind] if root else []


def stats(text):
    if text is None:
        return None
    root = _xml(text)
    out = dict.fromkeys(("element_count", "attribute_count", "max_depth", "size_bytes", "namespace_count"), 0)
    if root is None:
        return out
    stack, uris = [(root, 0)], set()
    while stack:
        n, depth = stack.pop()
        out["max_depth"] = max(out["max_depth"], depth)
        if n.kind == "element":
            out["element_count"] += 1
            out["attribute_count"] += sum(not k.startswith("xmlns") for k in n.attrs)
            uris |= {k for k in n.attrs if k == "xmlns" or k.startswith("xmlns:")}
        stack.extend((c, depth + 1) for c in n.children)
    return out | {"size_bytes": len(text.encode()), "namespace_count": len(uris)}


def namespaces(text):
    root = _xml(text)
    if text is None:
        return None
    found: dict[str, str] = {}
    for n in root.walk() if root else ():
        for k, v in n.attrs.items():
            if k == "xmlns" or k.startswith("xmlns:"):
                found.setdefault(k[6:], v)
    return found


def find_undefined_prefixes(text, path):
    if text is None or path is None:
        return None
    root = _xml(text)
    top = root and next((c for c in root.children if c.kind == "element"), None)
    return [p for p in detect_prefixes(path) if p != "xml" and p not in (top.namespaces() if top else {})]


def add_namespace_declarations(text, names):
    if text is None or not names:
        return text
    m = re.search(r"<(?![?!/])[^\s/>]+(?:\s+[^\s=>]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*", text)
    if not m:
        return text
    more = "".join(f' xmlns:{p}="{escape(u, True)}"' if p else f' xmlns="{escape(u, True)}"' for p, u in sorted(dict(names).items()) if f"xmlns:{p}=" not in m[0])
    return text[: m.end()] + more + text[m.end() :]


def pretty_print(text):
    root = _xml(text)
    return text if root is None else DECLARATION + "".join(serialize(c, "  ") + "\n" for c in root.children)


def minify(text, strip_blank=False):
    root = _xml(text)
    if root is None:
        return text
    if strip_blank:
        root = parse_xml(text)
        for n in list(root.walk()):
            if any(c.kind == "element" for c in n.children):
                n.children = [c for c in n.children if c.kind != "text" or c.text.strip()]
    return DECLARATION + "".join(serialize(c) for c in root.children)


_compact = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def to_json(text, force_list=(), attr_prefix="@", text_key="#text", namespaces="strip", xmlns_key="", empty_elements="object"):
    if text is None:
        return None
    root = _xml(text)
    if root is None:
        return "{}"
    force = set(force_list)

    def name(n: str, node: Node) -> str:
        prefix, _, local = n.rpartition(":")
        if namespaces == "keep":
            return n
        uri = node.namespaces().get(prefix) if namespaces == "expand" else None
        return f"{uri}:{local}" if uri else local

    def value(n: Node, top: bool = False):
        out = {attr_prefix + name(k, n) if ":" in k else attr_prefix + k: v for k, v in n.attrs.items() if k != "xmlns" and not k.startswith("xmlns:")}
        if top and xmlns_key and (declared := {k[6:]: v for k, v in n.attrs.items() if k == "xmlns" or k.startswith("xmlns:")}):
            out[xmlns_key] = declared
        if own := "".join(c.text for c in n.children if c.kind in ("text", "cdata")).strip():
            out[text_key] = own
        groups: dict[str, list] = {}
        for c in n.elements():
            groups.setdefault(name(c.name, c), []).append(value(c))
        for k in sorted(groups):
            out[k] = groups[k] if len(groups[k]) > 1 or k in force else groups[k][0]
        return out or {"object": {}, "null": None, "string": ""}[empty_elements]

    top = next(c for c in root.children if c.kind == "element")
    return _compact({name(top.name, top): value(top, True)})


def _element(name: str, v) -> str:
    if isinstance(v, dict):
        attrs = "".join(f' {k[1:]}="{escape(_plain(x), True)}"' for k, x in sorted(v.items()) if k.startswith("@"))
        inner = "".join(escape(_plain(x)) if k == "#text" else _element(k, x) for k, x in sorted(v.items()) if not k.startswith("@"))
        return f"<{name}{attrs}>{inner}</{name}>" if inner else f"<{name}{attrs}/>"
    if isinstance(v, list):
        return f"<{name}_list>" + "".join(_element(name, x) for x in v) + f"</{name}_list>"
    return f"<{name}/>" if v is None or v == "" else f"<{name}>{escape(_plain(v))}</{name}>"


def _plain(v) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else v if isinstance(v, str) else json.dumps(v)


def from_json(text):
    if text is None:
        return None
    try:
        v = json.loads(text) if text.strip() else {}
    except ValueError:
        v = {}
    if v == {}:
        return DECLARATION + "<root></root>"
    if isinstance(v, dict) and len(v) == 1 and isinstance(next(iter(v.values())), dict):
        return DECLARATION + _element(*next(iter(v.items())))
    return DECLARATION + _element("root", v)


def clean_html(text):
    if text is None:
        return None
    if text == "":
        return "<html></html>"
    root = parse_html(text)
    for n in root.walk():
        up = n.parent
        while n.kind == "text" and up is not None and up.name not in ("pre", "textarea", "script", "style"):
            up = up.parent
        if n.kind == "text" and up is None:
            n.text = re.sub(r"[ \t\r\n\f]+", " ", n.text)
    return "".join(serialize(c) for c in root.children)


def html_text(text, path=None):
    if path is not None:
        return [n.string() for n in select(_html(text), path)]
    return None if text is None else _html(text).string()


def links(text):
    return None if text is None else [{"text": n.string(), "href": n.attrs["href"], "title": n.attrs.get("title") or None, "line_number": n.line} for n in _html(text).walk() if n.name == "a" and "href" in n.attrs]


def _whole(v) -> int:
    m = re.match(r"\s*[+-]?\d+", v or "")
    return int(m[0]) if m else 0


def images(text):
    if text is None:
        return None
    return [{"alt": n.attrs.get("alt", ""), "src": n.attrs.get("src", ""), "title": n.attrs.get("title") or None, "width": _whole(n.attrs.get("width")), "height": _whole(n.attrs.get("height")), "line_number": n.line} for n in _html(text).walk() if n.name == "img"]


def tables(text) -> list[dict]:
    """Each table with a header or a row: its line, headers and rows of cell texts."""
    out = []
    for t in (n for n in _html(text or "").walk() if n.name == "table"):
        below = list(t.walk())
        rows = [n for n in below if n.name == "tr"]
        of = lambda n, names: [x for x in n.walk() if x.name in names]
        head = [x for h in below if h.name == "thead" for x in of(h, ("th",))]
        first = [x for r in rows if r is next((s for s in r.parent.children if s.name == "tr"), None) for x in of(r, ("th",))]
        headers = [x.string() for x in sorted({x.order: x for x in head + first}.values(), key=lambda x: x.order)]
        data = [r for r in rows if not headers or not any(c.name == "th" for c in r.children) or _inside(r, "tbody", t)]
        cells = [c for c in ([x.string() for x in of(r, ("td",))] for r in data) if c]
        if headers or cells:
            out.append({"line": t.line, "headers": headers, "rows": cells})
    return out


def _inside(n: Node, name: str, top: Node) -> bool:
    while n is not None and n is not top:
        if n.name == name:
            return True
        n = n.parent
    return False


def table_rows(text):
    if text is None:
        return None
    out = []
    for k, t in enumerate(tables(text)):
        head = [("header", 0, t["headers"])] if t["headers"] else []
        for kind, r, cells in [*head, *(("data", i, c) for i, c in enumerate(t["rows"], 1))]:
            out.extend({"table_index": k, "row_type": kind, "row_index": r, "column_index": c, "cell_value": v, "line_number": t["line"], "num_columns": len(t["headers"]), "num_rows": len(t["rows"])} for c, v in enumerate(cells))
    return out


def tables_json(text):
    if text is None:
        return None
    return [
        {"table_index": k, "line_number": t["line"], "num_columns": len(t["headers"]), "num_rows": len(t["rows"]), "headers": t["headers"], "table_data": t["rows"],
         "table_json": json.dumps([dict(zip(t["headers"] or [f"column{c}" for c in range(len(r))], r, strict=False)) for r in t["rows"]], ensure_ascii=False), "json_structure": json.dumps({"headers": t["headers"], "rows": len(t["rows"])}, ensure_ascii=False)}
        for k, t in enumerate(tables(text))
    ]


def unescape(text):
    return None if text is None else next((n.string() for n in parse_html(f"<html><body>{text}</body></html>").walk() if n.name == "body"), "")


#: HTML tags and the inline types of document blocks (fixed values).
INLINE = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic", "code": "code", "del": "strikethrough", "s": "strikethrough", "strike": "strikethrough", "sup": "superscript", "sub": "subscript", "u": "underline", "a": "link", "span": "span", "br": "linebreak", "img": "image"}
_TAG = {"bold": "strong", "strong": "strong", "italic": "em", "em": "em", "emphasis": "em", "code": "code", "strikethrough": "del", "superscript": "sup", "subscript": "sub", "underline": "u", "span": "span", "link": "a"}


def _block(kind, type_, content, level, attrs=None, encoding="text"):
    return {"kind": kind, "element_type": type_, "content": content or None, "level": level, "encoding": encoding, "attributes": list((attrs or {}).items()), "element_order": 0}


def _inlines(node: Node, level: int) -> list[dict]:
    out = []
    for c in node.children:
        if c.kind in ("text", "cdata"):
            if c.text:
                out.append(_block("inline", "text", c.text, level))
        elif c.kind == "element":
            kind = INLINE.get(c.name)
            keep = {"link": ("href", "title"), "image": ("src", "alt", "title"), "span": ("id", "class")}.get(kind, ())
            attrs = {k: c.attrs[k] for k in keep if c.attrs.get(k)}
            if kind is None:
                out += _inlines(c, level)
            elif c.elements():
                out += [_block("inline", kind, None, level, attrs), *_inlines(c, level + 1)]
            else:
                out.append(_block("inline", kind, c.string(), level, attrs))
    return out


def to_blocks(text) -> list[dict]:
    """Blocks of an HTML document in order; front matter scripts come first."""
    if text is None:
        return []
    nodes, out = list(_html(text).walk()), []
    for n in nodes:
        if n.name == "script" and "frontmatter" in n.attrs.get("type", ""):
            out.append(_block("block", "metadata", n.string().strip(), 1, encoding="yaml"))
    for n in nodes:
        if n.kind != "element" or not _inside(n.parent, "body", n if n.name == "body" else None):
            continue
        if re.fullmatch("h[1-6]|p", n.name):
            attrs = {"heading_level": n.name[1]} | ({"id": n.attrs["id"]} if n.attrs.get("id") else {}) if n.name != "p" else {}
            rich = bool(n.elements())
            out.append(_block("block", "paragraph" if n.name == "p" else "heading", None if rich else n.string(), 1, attrs))
            out += _inlines(n, 2) if rich else []
        elif n.name == "pre":
            code = next((c for c in n.walk() if c.name == "code"), n)
            language = re.search(r"(?:language|lang)-([\w+#-]+)", code.attrs.get("class", ""))
            out.append(_block("block", "code", n.string(), 1, {"language": language[1]} if language else {}))
        elif n.name == "blockquote":
            level, up = 1, n.parent
            while up is not None:
                level, up = level + (up.name == "blockquote"), up.parent
            out.append(_block("block", "blockquote", n.string().strip(), level))
        elif n.name in ("ul", "ol"):
            out.append(_block("block", "list", json.dumps([c.string().strip() for c in n.elements() if c.name == "li"], ensure_ascii=False), 1, {"ordered": str(n.name == "ol").lower()}, "json"))
        elif n.name == "table":
            t = next(iter(tables(serialize(n))), {"headers": [], "rows": []})
            out.append(_block("block", "table", json.dumps({"headers": t["headers"], "rows": t["rows"]}, ensure_ascii=False), 1, encoding="json"))
        elif n.name == "hr":
            out.append(_block("block", "hr", None, 1))
        elif n.name == "figure" or n.name == "img" and not _inside(n.parent, "figure", None) and n.parent.name not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "a"):
            image = next((c for c in n.walk() if c.name == "img"), None)
            if image is not None:
                caption = next((c.string() for c in n.walk() if c.name == "figcaption"), None)
                out.append(_block("block", "image", None, 1, {k: v for k, v in {"src": image.attrs.get("src"), "alt": image.attrs.get("alt"), "title": caption or image.attrs.get("title")}.items() if v}))
    for k, b in enumerate(out):
        b["element_order"] = k
    return out


def _render_inline(blocks: list[dict], at: int) -> tuple[str, int]:
    b = blocks[at]
    inner, k = escape(b["content"] or ""), at + 1
    while k < len(blocks) and blocks[k]["kind"] == "inline" and (blocks[k]["level"] or 0) > (b["level"] or 0):
        more, k = _render_inline(blocks, k)
        inner += more
    a = dict(b["attributes"] or ())
    keep = "".join(f' {x}="{escape(a[x], True)}"' for x in ("href", "src", "alt", "title", "id", "class") if a.get(x))
    kind = b["element_type"]
    if kind == "linebreak":
        return "<br/>", k
    if kind == "image":
        return f"<img{keep}/>", k
    tag = _TAG.get(kind)
    return (f"<{tag}{keep}>{inner}</{tag}>" if tag else inner), k


def _json(text, default):
    try:
        v = json.loads(text or "")
        return v if isinstance(v, type(default)) else default
    except ValueError:
        return default


def _pandoc_cell(blocks) -> str:
    tags = {"Strong": "strong", "Emph": "em", "Strikeout": "del", "Superscript": "sup", "Subscript": "sub"}

    def inline(x) -> str:
        if not isinstance(x, dict):
            return ""
        kind, c = x.get("t"), x.get("c")
        if kind == "Str":
            return escape(str(c))
        if kind in ("Space", "SoftBreak"):
            return " "
        if kind == "LineBreak":
            return "<br/>"
        if kind in tags and isinstance(c, list):
            return f"<{tags[kind]}>{''.join(map(inline, c))}</{tags[kind]}>"
        if kind == "Code" and isinstance(c, list):
            return f"<code>{escape(str(c[-1]))}</code>"
        if kind == "Link" and isinstance(c, list) and len(c) == 3:
            return f'<a href="{escape(str(c[2][0]), True)}">{"".join(map(inline, c[1]))}</a>'
        return ""

    return "".join("".join(map(inline, b.get("c") or [])) for b in blocks or [] if isinstance(b, dict) and b.get("t") in ("Plain", "Para"))


def _render_table(content: str) -> str:
    v = _json(content, [])
    if len(v) == 5:  # [caption, alignments, widths, headers, rows]
        align = [{"AlignLeft": "left", "AlignRight": "right", "AlignCenter": "center"}.get((a or {}).get("t") if isinstance(a, dict) else a) for a in v[1] or []]
        styled = lambda k: f' style="text-align: {align[k]};"' if k < len(align) and align[k] else ""
        head, rows, cell = v[3] or [], v[4] or [], _pandoc_cell
    else:
        d = _json(content, {})
        styled, head, rows, cell = (lambda k: ""), d.get("headers") or [], d.get("rows") or [], lambda x: escape(_plain(x))
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}{styled(k)}>{cell(c)}</{tag}>" for k, c in enumerate(cells or [])) + "</tr>"
    top = f"<thead>{line('th', head)}</thead>" if any(map(cell, head)) else ""
    return f"<table>{top}<tbody>{''.join(line('td', r) for r in rows)}</tbody></table>"


def from_blocks(blocks) -> str:
    out, k = "", 0
    blocks = blocks or []
    while k < len(blocks):
        b, start = blocks[k], k
        a, content, kind = dict(b["attributes"] or ()), b["content"] or "", b["element_type"]
        k += 1
        if b["kind"] == "inline":
            more, k = _render_inline(blocks, start)
            out += more
        elif kind in ("heading", "paragraph"):
            inner = escape(content)
            while k < len(blocks) and blocks[k]["kind"] == "inline":
                more, k = _render_inline(blocks, k)
                inner += more
            level = a.get("heading_level", "1")
            tag = "p" if kind == "paragraph" else f"h{min(6, max(1, int(level) if level.lstrip('-').isdigit() else 1))}"
            out += f"<{tag}" + (f' id="{escape(a["id"], True)}"' if a.get("id") and tag != "p" else "") + f">{inner}</{tag}>"
        elif kind == "code":
            out += "<pre><code" + (f' class="language-{escape(a["language"], True)}"' if a.get("language") else "") + f">{escape(content)}</code></pre>"
        elif kind == "blockquote":
            n = max(1, b["level"] or 1)
            out += "<blockquote>" * n + escape(content) + "</blockquote>" * n
        elif kind == "list":
            tag = "ol" if a.get("ordered") == "true" else "ul"
            out += f"<{tag}>" + "".join(f"<li>{escape(_plain(x))}</li>" for x in _json(content, [])) + f"</{tag}>"
        elif kind == "table":
            out += _render_table(content)
        elif kind == "hr":
            out += "<hr/>"
        elif kind == "image":
            image = "<img" + "".join(f' {x}="{escape(a[x], True)}"' for x in ("src", "alt", "title") if a.get(x)) + "/>"
            out += image
        elif kind == "raw":
            out += content
        elif kind == "metadata":
            out += f'<script type="application/vnd.frontmatter+yaml">{content}</script>'
        else:
            out += f"<p>{escape(content)}</p>"
    return out
