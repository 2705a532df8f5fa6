"""A small HTML tree on the standard parser, and a raw scanner for links and assets.

The builder supplies html, head and body, closes p, li and table parts where their rules say, keeps
script and style raw, and reopens formatting elements in the next paragraph. Misnested tables are not
foster-parented; that is the known difference to a browser's tree.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("title meta link base script style noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SCOPES = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
}


#: Depth of open elements.
MOST_DEPTH = 512


class Node:
    """An element, or a text if ``tag`` is empty."""

    __slots__ = ("tag", "attrs", "parent", "kids", "data")

    def __init__(self, tag: str, attrs: dict | None = None, parent: "Node | None" = None, data: str = ""):
        self.tag, self.attrs, self.parent, self.kids, self.data = tag, attrs or {}, parent, [], data

    def walk(self):
        """Elements in document order, this one first."""
        stack = [self]
        while stack:
            n = stack.pop()
            if n.tag:
                yield n
                stack.extend(reversed(n.kids))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if n.tag:
                stack.extend(reversed(n.kids))
            else:
                out.append(n.data)
        return "".join(out)

    def inside(self, *tags: str) -> bool:
        p = self.parent
        while p is not None:
            if p.tag in tags:
                return True
            p = p.parent
        return False


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.doc = Node("#document")
        self.html: Node | None = None
        self.head: Node | None = None
        self.body: Node | None = None
        self.open: list[Node] = []
        self.pending: list[tuple[str, dict]] = []
        self.over = 0

    def _add(self, tag: str, attrs: dict) -> Node:
        parent = self.open[-1] if self.open else self.doc
        n = Node(tag, attrs, parent)
        parent.kids.append(n)
        return n

    def _need_html(self, attrs: dict | None = None):
        if self.html is None:
            self.html = self._add("html", attrs or {})
            self.open.append(self.html)
        elif attrs:
            for k, v in attrs.items():
                self.html.attrs.setdefault(k, v)

    def _need_head(self, attrs: dict | None = None):
        self._need_html()
        if self.head is None:
            self.head = self._add("head", attrs or {})
            self.open.append(self.head)

    def _need_body(self, attrs: dict | None = None):
        if self.body is not None:
            for k, v in (attrs or {}).items():
                self.body.attrs.setdefault(k, v)
            return
        self._need_head()
        while self.open and self.open[-1] is not self.html:
            self.open.pop()
        self.body = self._add("body", attrs or {})
        self.open.append(self.body)

    def handle_starttag(self, tag, attrs):
        a: dict[str, str] = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "html":
            return self._need_html(a)
        if tag == "head":
            return self._need_head(a) if self.body is None else None
        if tag == "body":
            return self._need_body(a)
        if self.body is None:
            if tag in HEAD_ONLY and (self.head is None or self.head in self.open):
                self._need_head()
            else:
                self._need_body()
        if tag in CLOSES_P:
            self._close_p()
        if tag in SCOPES:
            self._close_within(*SCOPES[tag])
        if tag[0] == "h" and tag[1:].isdigit() and self.open and self.open[-1].tag[0] == "h" and self.open[-1].tag[1:].isdigit():
            self.open.pop()
        if tag == "a":
            self._close_within(("a",), ("body", "table", "td", "li"))
        if tag not in CLOSES_P and tag not in SCOPES:
            self._reopen()
        n = self._add(tag, a)
        if tag not in VOID:
            if len(self.open) < MOST_DEPTH:
                self.open.append(n)
            else:
                self.over += 1  # deeper elements become siblings, as in browsers

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _close_p(self):
        for k in range(len(self.open) - 1, -1, -1):
            t = self.open[k].tag
            if t == "p":
                self.pending = [(x.tag, x.attrs) for x in self.open[k + 1 :] if x.tag in FORMATTING]
                del self.open[k:]
                return
            if t not in FORMATTING and t != "span":
                return

    def _close_within(self, tags, stop):
        for k in range(len(self.open) - 1, 0, -1):
            t = self.open[k].tag
            if t in tags:
                del self.open[k:]
                if not any(x.tag in tags for x in self.open[k - 1 :]):
                    return
                return self._close_within(tags, stop)
            if t in stop or t in ("body", "html", "table"):
                return

    def _reopen(self):
        if self.pending:
            again, self.pending = self.pending, []
            for tag, attrs in again:
                n = self._add(tag, dict(attrs))
                self.open.append(n)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.head is not None and self.body is None:
                while self.open and self.open[-1] is not self.html:
                    self.open.pop()
            return
        if self.over and tag not in VOID:
            self.over -= 1
            return
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.handle_starttag("p", [])
            self.open.pop()
            return
        self.pending = [x for x in self.pending if x[0] != tag]
        for k in range(len(self.open) - 1, -1, -1):
            n = self.open[k]
            if n.tag == tag and n not in (self.html, self.body):
                if tag in CLOSES_P:
                    self.pending += [(x.tag, x.attrs) for x in self.open[k + 1 :] if x.tag in FORMATTING]
                del self.open[k:]
                return
            if n is self.body or n is self.head and tag not in HEAD_ONLY:
                return

    def handle_data(self, data):
        if not self.open or self.open[-1].tag not in ("script", "style", "title", "textarea", "noscript"):
            if self.body is None:
                if not data.strip():
                    return
                self._need_body()
            if data.strip():
                self._reopen()
        parent = self.open[-1] if self.open else self.doc
        parent.kids.append(Node("", None, parent, data))


def parse(body: str) -> Node:
    """The document tree; html, head and body are always there."""
    b = _Builder()
    try:
        b.feed(body)
        b.close()
    except (AssertionError, RecursionError):
        pass
    b._need_body()
    return b.doc


_TAG = re.compile(r"<(a|img|link|script)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
_RAW = re.compile(r"<!--.*?-->|(<(script|style|textarea|title)\b[^>]*>).*?</\2\s*>", re.I | re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?")
_SKIP = ("mailto:", "javascript:", "data:", "tel:", "ftp:")


def resolve(base: str, ref: str) -> str | None:
    """An http(s) URL without fragment, or None for other schemes and unreadable ones."""
    from html import unescape

    ref = unescape(ref).strip()
    if not ref or ref.lower().startswith(_SKIP):
        return None
    try:
        u = urldefrag(urljoin(base, ref))[0]
        return u if urlsplit(u).scheme in ("http", "https") else None
    except ValueError:
        return None


def links_and_assets(body: str, base: str) -> tuple[list[str], list[str]]:
    """Targets of a[href], and of img[src], link[href] and script[src], in order, with repeats.

    Start tags alone are read; comments and the insides of raw-text elements are skipped.
    """
    links: list[str] = []
    assets: list[str] = []
    for m in _TAG.finditer(_RAW.sub(lambda r: r.group(1) or "", body)):
        tag = m.group(1).lower()
        want = "href" if tag in ("a", "link") else "src"
        for a in _ATTR.finditer(m.group(2)):
            if a.group(1).lower() == want:
                u = resolve(base, (a.group(2) or "").strip("\"'"))
                if u is not None:
                    (links if tag == "a" else assets).append(u)
                break
    return links, assets
