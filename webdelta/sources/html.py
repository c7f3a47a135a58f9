"""HTML to rows: a tree builder on the standard library's tokenizer, content selection, and one row per kept node.

The tree builder knows void elements, raw text, implied end tags (p, li, tr, td, dd, option), and drops end tags without a
start. It has no adoption agency: misnested inline elements close with their parent. Nodes are flat: `pre` is the place in
document order, `end` the last place inside the node, so descendants are a range.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdelta.functions.text import BOILERPLATE, URL_ATTRS

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
STRIPPED = {"script", "style", "noscript", "template", "svg", "iframe"}
BONUS, PENALTY = {"article", "main", "section"}, {"nav", "aside", "footer", "header", "form"}
#: A start tag closes an open element of these kinds, up to the fence.
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "text")

    def __init__(self, tag, attrs=None, parent=None, text=None):
        self.tag, self.attrs, self.parent, self.text, self.children = tag, attrs or {}, parent, text, []

    def walk(self):
        """This node and all below, in document order."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.children))

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.at = self.root

    def _close(self, kinds: set[str], fence: set[str]) -> None:
        n, found = self.at, None
        while n is not self.root and n.tag not in fence:
            if n.tag in kinds:
                found = n
            n = n.parent
        if found is not None:
            self.at = found.parent

    def handle_starttag(self, tag, attrs):
        if tag in _IMPLIED:
            self._close(*_IMPLIED[tag])
        if tag in _BLOCKS:
            self._close({"p"}, {"table", "td", "th", "button"})
        node = Node(tag, {}, self.at)
        for k, v in attrs:
            node.attrs.setdefault(k, v or "")
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.root and n.tag != tag:
            if n.tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                return
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(Node(None, parent=self.at, text=data))


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def is_boilerplate(n: Node) -> bool:
    return any(w in c.lower() for c in n.classes() for w in BOILERPLATE)


_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:[~|^$*]?=(?:\"[^\"]*\"|'[^']*'|[^\]]*))?\])*)$")
_PIECE = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:([~|^$*]?)=(\"[^\"]*\"|'[^']*'|[^\]]*))?\]")


def selector(css: str):
    """A matcher of nodes: types, .class, #id, [attr=value], descendant and child combinators, commas. ValueError if it isn't one."""
    ways = []
    for way in css.split(","):
        parts, deep = [], " "
        for token in re.findall(r">|[^\s>]+", way.strip()):
            if token == ">":
                deep = ">"
                continue
            m = _SIMPLE.match(token)
            if not m or not token:
                raise ValueError(f"bad selector: {css}")
            parts.append((deep, m[1] if m[1] != "*" else None, [(p[1], p[2]) if p[1] else (p[3], p[4], p[5].strip("\"'") if p[5] else None) for p in _PIECE.finditer(m[2])]))
            deep = " "
        if not parts or deep == ">":
            raise ValueError(f"bad selector: {css}")
        ways.append(parts)

    def one(n: Node, part) -> bool:
        _, tag, tests = part
        if n.tag is None or n.tag.startswith("#") or (tag and n.tag != tag.lower()):
            return False
        for t in tests:
            if t[0] == ".":
                ok = t[1] in n.classes()
            elif t[0] == "#":
                ok = n.attrs.get("id") == t[1]
            else:
                name, op, value = t
                have = n.attrs.get(name)
                ok = have is not None and (value is None or {"": have == value, "~": value in have.split(), "|": have == value or have.startswith(value + "-"), "^": have.startswith(value), "$": have.endswith(value), "*": value in have}[op])
            if not ok:
                return False
        return True

    def fits(n: Node, parts) -> bool:
        if not one(n, parts[-1]):
            return False
        if len(parts) == 1:
            return True
        up = n.parent
        while up is not None:
            if fits(up, parts[:-1]):
                return True
            if parts[-1][0] == ">":
                return False
            up = up.parent
        return False

    return lambda n: any(fits(n, parts) for parts in ways)


def _lengths(root: Node) -> dict[int, tuple[int, int, int, int]]:
    """For each element (by id()) its visible characters, those in links, commas and p descendants.

    Stripped and boilerplate parts count for none of the first three; p counts everywhere.
    """
    out: dict[int, tuple[int, int, int, int]] = {}
    order = list(root.walk())
    hidden = {id(n): n.tag is not None and (n.tag in STRIPPED or is_boilerplate(n)) for n in order}
    for n in reversed(order):
        if n.tag is None:
            s = " ".join(n.text.split())
            out[id(n)] = (len(s), 0, s.count(","), 0)
            continue
        text = links = commas = paras = 0
        for c in n.children:
            t, l, k, p = out[id(c)]
            paras += p + (c.tag == "p")
            if not hidden[id(c)]:
                text, commas = text + t, commas + k
                links += t if c.tag == "a" else l
        out[id(n)] = (text, links, commas, paras)
    return out


def readability(body: Node) -> Node:
    """The element of the highest score; the earliest of equals."""
    sizes = _lengths(body)
    best, chosen, todo = None, body, [body]
    while todo:
        n = todo.pop()
        todo.extend(c for c in reversed(n.children) if c.tag is not None)
        if n.tag in STRIPPED or is_boilerplate(n):
            continue
        text, links, commas, paras = sizes[id(n)]
        if n.tag == "a":
            links = text
        if not text:
            score = float("-inf")
        else:
            density = links / text
            score = text * (1 - density) + 3 * commas + 3 * paras + 60 * (n.tag in BONUS) - 60 * (n.tag in PENALTY) - (text * 0.5 if density > 0.5 else 0)
        if best is None or score > best:
            best, chosen = score, n
    return chosen


def selected(root: Node, strategy: str, root_selector: str | None) -> list[Node]:
    body = next((n for n in root.walk() if n.tag == "body"), root)
    if strategy == "selector":
        if not root_selector:
            raise ValueError("the selector strategy needs a root selector")
        fits = selector(root_selector)
        return [n for n in root.walk() if n.tag is not None and fits(n)]
    return [readability(body)] if strategy == "readability" else [body]


def rows_of(html: str, strategy: str = "readability", root_selector: str | None = None) -> tuple[str | None, list[dict]]:
    """Title, and the kept nodes in document order. A kept <base href> that is absolute resolves the URLs of all kept nodes."""
    root = tree(html)
    title = next((" ".join("".join(c.text or "" for c in n.children).split()) for n in root.walk() if n.tag == "title"), "") or None
    out: list[dict] = []

    def add(n: Node, depth: int, parent: int, code: bool, trs: list) -> None:
        # Iterative, so deep nesting cannot exhaust the stack.
        todo = [(n, depth, parent, code, trs, False)]
        open_: list[int] = []
        while todo:
            n, depth, parent, code, trs, closing = todo.pop()
            if closing:
                out[open_.pop()]["end"] = len(out) - 1
                continue
            if n.tag is not None and (n.tag in STRIPPED or is_boilerplate(n)):
                continue
            pre = len(out)
            text = n.text
            if text is not None and not text.isascii():
                text = unicodedata.normalize("NFC", text)
            out.append({"pre": pre, "end": pre, "parent": parent, "depth": depth, "tag": n.tag, "attrs": sorted(n.attrs.items()), "text": text, "in_code": code, "rows": list(trs)})
            if n.tag is None:
                continue
            open_.append(pre)
            todo.append((n, depth, parent, code, trs, True))
            code = code or n.tag in ("pre", "code")
            for c in reversed(n.children):
                # A cell is a direct td or th of a row; what is inside belongs to (row, cell).
                inside = trs + [{"row": pre, "cell": None}] if n.tag == "tr" else trs
                if n.tag in ("td", "th") and trs and trs[-1]["row"] == parent and trs[-1]["cell"] is None:
                    inside = trs[:-1] + [{"row": parent, "cell": pre}]
                todo.append((c, depth + 1, pre, code, inside, False))

    for n in selected(root, strategy, root_selector):
        add(n, 0, -1, False, [])
    if base := next((h for n in out if n["tag"] == "base" and (h := (dict(n["attrs"]).get("href") or "").strip())), None):
        for n in out if ABSOLUTE.match(base) else ():
            n["attrs"] = [(k, resolved(base, v) if k in URL_ATTRS else v) for k, v in n["attrs"]]
    return title, out


def resolved(base: str, url: str | None) -> str | None:
    """A relative URL against the page's <base>; absolute and empty ones, and what is no URL, as they are."""
    bare = (url or "").strip()
    if not bare or ABSOLUTE.match(bare):
        return url
    try:
        return urljoin(base, bare)
    except ValueError:
        return url


NODES = "array<struct<pre:int,end:int,parent:int,depth:int,tag:string,attrs:map<string,string>,text:string,in_code:boolean,rows:array<struct<row:int,cell:int>>>>"


def extracted(observations: DataFrame) -> DataFrame:
    """observations (tid, rev, url, obs, html; strategy and root_selector if given) with title and nodes.

    One Arrow pass over the pages: the tree, the selection and NFC are the only steps here that Spark's expressions lack.
    """
    x = observations
    for c in ("strategy", "root_selector"):
        if c not in x.columns:
            x = x.withColumn(c, F.lit(None).cast("string"))
    carried = [c for c in x.columns if c not in ("html", "strategy", "root_selector", "title", "nodes")]
    fields = [f"`{c}` {x.schema[c].dataType.simpleString()}" for c in carried]

    def run(batches):
        row = pa.struct([("row", pa.int32()), ("cell", pa.int32())])
        node = pa.struct([("pre", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("in_code", pa.bool_()), ("rows", pa.list_(row))])
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                b = whole.slice(a, 64)
                found = [rows_of(h or "", s or "readability", r) for h, s, r in zip(*(b.column(c).to_pylist() for c in ("html", "strategy", "root_selector")))]
                columns = [b.column(c) for c in carried] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(node)), pa.array([len((h or "").encode()) for h in b.column("html").to_pylist()], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*carried, "title", "nodes", "bytes_raw"])

    return x.mapInArrow(run, ", ".join([*fields, "title string", f"nodes {NODES}", "bytes_raw long"]))


def nodes(pages: DataFrame) -> DataFrame:
    """extracted() as rows of nodes."""
    return pages.select(*[c for c in pages.columns if c != "nodes"], F.inline("nodes"))
