"""Main body of a page by minimum cut.

Every block of the DOM with visible text is a node, whether blocks stand on lines of their own or not.
A linear classifier over its element, shape and words gives the capacities of its terminal edges.
Smoothness edges tie neighbours, blocks of one container, the blocks below a heading to that heading,
and the blocks within a wall (``nav``, ``aside``, ``footer``, ``form``) to the wall. The minimum cut
separates main content (source side) from boilerplate (sink side): a reader's comment reads like the
article, and only its edges to the heading above it tell it apart.

The classifier knows no phrases. It is fitted to the pages at hand by ``fit``, on a bounded sample:
texts that stand on many pages of a site are its template, texts that stand on one are content, the
rest has no label; the labels of the cut are then learned once more. Without a sample, the prior
weights hold, which know elements and shapes only.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import map_arrow

# --- capacities ---------------------------------------------------------------------------------

#: Largest terminal capacity of a node.
MOST = 3.0
W_LINE_BREAK = 6.0  # lines of one block element
W_SAME = 0.8  # neighbours in one container
W_LINE = 0.2  # neighbouring lines of plain text
W_ACROSS = 0.1  # neighbours in different containers
W_DOM = 0.35  # a node and its container
W_LIST = 1.5  # an entry and its list
W_HEADING = 3.4  # a node below a heading, if the heading is boilerplate
W_WALL = 3.4  # a node in a wall
WALLS = frozenset(["nav", "aside", "footer", "form"])

# --- classifier ---------------------------------------------------------------------------------

#: Prior weights by element, positive for main content.
TAG = {"h1": 2.0, "h2": 1.5, "h3": 0.3, "h4": 0.3, "p": 1.0, "li": 0.7, "td": 1.5, "tr": 1.5, "blockquote": 2.0, "pre": 3.0, "code": 1.5, "figcaption": 2.0,
       "span": -1.5, "a": -1.5, "b": -0.7, "button": -2.0, "label": -1.5, "option": -2.0, "div": 0.0, "": 0.7}
PRIOR_LINKED, PRIOR_SENTENCE, PRIOR_CELLS = -2.0, 0.8, -4.0
#: Buckets of the words' weights.
BUCKETS = 1 << 15
#: Bounds of the sample: sites, pages of a site, characters of a page's body that is taken whole or not at all.
SITES, SITE_PAGES, SAMPLE_CHARS = 64, 24, 50_000
#: A text on this share of a site's sampled pages is template, given so many pages.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.1, 5
#: A line of plain text heads those below it if it has at most so many words, a capacity below LEAD, and content of a capacity of LEAD_AFTER above it.
LEAD_WORDS, LEAD, LEAD_AFTER = 8, -1.0, 6.0
LEAD_LINES = 10
ITERATIONS, ROUNDS, RIDGE = 40, 2, 0.02

_TOKEN = re.compile(r"<!--|<!(?:doctype|\[cdata\[)[^<>]*>|<\?xml[^<>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.I)
_STARTS = re.compile(r"\s{0,3}<(?:!--|!doctype\s+html|html|head|body|div|nav|header|article|main|section|p|table|ul|h[1-6])\b", re.I)
_DOCUMENT = re.compile(r"^<(?:!doctype\s+html|html|body)\b[^<>]*>", re.I | re.M)
_CLOSES = re.compile(r"</(?:html|head|body|div|article|main|section|p|table|ul|h[1-6]|a|span)\s*>", re.I)
#: Where a line that holds several blocks is cut: before these tags, and after those that the group names.
_BLOCK_EDGE = re.compile(r"<(?:(?:p|h[1-6]|li|dd|dt|div|nav|aside|footer|header|main|article|section|form|blockquote|figcaption|pre|table|tr|ul|ol|dl|button|noscript|script|style|title|head|body)\b|/(?:(?:nav|aside|footer|header|main|article|section|form|ul|ol|table|body|html)\b|(script|style|title|noscript)>))", re.I)
_HIDDEN = frozenset(["script", "style", "noscript", "head", "title", "template", "svg", "textarea", "select", "iframe", "object"])
_BLOCKS = frozenset(["div", "nav", "aside", "footer", "header", "main", "article", "section", "td", "th", "tr", "ul", "ol", "dl", "table", "tbody", "form", "blockquote", "figure", "body", "html"])
_LISTS = frozenset(["ul", "ol", "dl", "table", "tbody", "tr", "blockquote", "figure"])
_HEADINGS = frozenset(["h2", "h3", "h4", "h5", "h6"])
_HOLDERS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "tr", "dd", "dt", "blockquote", "pre", "code", "figcaption", "caption", "span", "a", "b", "strong", "button", "label", "option", "div"])
_INLINE = frozenset(["span", "a", "b", "strong", "button", "label", "code"])
_VOID_BREAK = frozenset(["br", "hr"])
#: Tags that make events, and tags that part words.
_EVENTS = _BLOCKS | {"p", "pre", "li"}
_PARTING = _EVENTS | _VOID_BREAK
#: The commonest lines, which need no tokens: one element with text, and a list entry with one link.
_SIMPLE = re.compile(r"\s*<(p|li|span|h[1-6]|b)>([^<>]*)</\1>\s*$")
_LINKED = re.compile(r"\s*<li><a(?: [^<>]*)?>([^<>]*)</a></li>\s*$")
_LI = (("open", "li"), ("close", "li"))
#: Lines that need no tokens either, with their events, share of links and holder: a paragraph that goes on below, one that began above, and links on their own.
_ATTRIBUTES = r"(?:\s[^<>\"']*(?:\"[^\"<>]*\"[^<>\"']*)*)?"
_PLAIN = (
    (re.compile(r"\s*<p>([^<>]*)$"), (("open", "p"),), 0.0, "p"),
    (re.compile(r"([^<>]*)</p>\s*$"), (("close", "p"),), 0.0, ""),
    (re.compile(rf"\s*<a{_ATTRIBUTES}>([^<>]*)</a>\s*$"), (), 1.0, "a"),
    (re.compile(rf"\s*<div><a{_ATTRIBUTES}>([^<>]*)</a></div>\s*$"), (("open", "div"), ("close", "div")), 1.0, "div"),
)
_CELLS = re.compile(r" \| | [›»>→] ")
_WORD = re.compile(r"[^\W\d_]+")
#: ASCII letters as lower-case letters, all else as blanks.
_LETTERS = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalpha() else 32 for c in range(256))
_DIGIT = re.compile(r"\d")
_NOSCRIPT = re.compile(r"<noscript\b[^<>]*>([^<]*)</noscript", re.I)
_COUNT = re.compile(r"^\d+ ")
_ENDS = frozenset(".!?…:;")
_CLOSERS = "\"'”’»)]"


def _tidy(text: str) -> str:
    """Every run of white space as one blank."""
    if text.isprintable() and "  " not in text:  # the only white space is single blanks
        return text.strip(" ")
    return " ".join(text.split())


def _shape(text: str, n_words: int) -> tuple:
    """What of a text's form the classifier sees: length, end, cells."""
    last = text.rstrip(_CLOSERS)[-1:]
    size = 0 if n_words <= 1 else 1 if n_words <= 3 else 2 if n_words <= 6 else 3 if n_words <= 12 else 4 if n_words <= 25 else 5
    cells = len(_CELLS.findall(text)) if "|" in text or "›" in text or "»" in text or ">" in text or "→" in text else 0
    return size, last in _ENDS and last != "", min(2, cells)


class Model:
    """Weights of the line classifier, one per form and one per word bucket."""

    def __init__(self, form: dict | None = None, word=None):
        self.form, self.word = form or {}, word
        self._form: dict = {}
        self._bucket: dict = {}
        self._seen: dict = {}

    def __getstate__(self):
        return {"form": self.form, "word": self.word}

    def __setstate__(self, s):
        self.__init__(s["form"], s["word"])

    def form_score(self, key: tuple) -> float:
        got = self._form.get(key)
        if got is None:
            got = self._form[key] = sum(self.form.get(f, 0.0) + prior(f) for f in form_features(key))
        return got

    def score(self, key: tuple, ws: list[str]) -> float:
        """Log-odds of main content."""
        u = self.form_score(key)
        if self.word is not None and ws:
            try:
                total = sum(map(self._bucket.__getitem__, ws))
            except KeyError:
                if len(self._bucket) > 300_000:
                    self._bucket.clear()
                for w in ws:
                    if w not in self._bucket:
                        self._bucket[w] = float(self.word[bucket(w)])
                total = sum(map(self._bucket.__getitem__, ws))
            u += total / len(ws) ** 0.5
        return u


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def form_features(key: tuple) -> list[tuple]:
    marked, holder, linked, (size, ends, cells), indent = key
    return [("bias", marked), ("holder", holder), ("size", marked, size), ("ends", marked, ends), ("end size", size, ends), ("linked", linked, holder), ("linked", linked), ("cells", cells), ("indent", indent)]


def prior(f: tuple) -> float:
    """Weight of a form feature before any page was seen."""
    if f[0] == "holder":
        return TAG.get(f[1], 0.0)
    if f == ("linked", True):
        return PRIOR_LINKED
    if f[0] == "ends" and f[2]:
        return PRIOR_SENTENCE
    if f == ("cells", 2):
        return PRIOR_CELLS
    if f == ("indent", 2):
        return TAG["pre"]
    return 0.0


class Node:
    """A block with visible text."""

    __slots__ = ("line", "text", "raw", "ws", "key", "block", "holder", "region", "head", "wall", "heading", "box")

    def __init__(self, line, text, raw, ws, key, block, holder, region, head, wall, heading, box=False):
        self.line, self.text, self.raw, self.ws, self.key, self.block, self.holder = line, text, raw, ws, key, block, holder
        self.region, self.head, self.wall, self.heading, self.box = region, head, wall, heading, box


def min_cut(u: list[float], edges: list[tuple[int, int, float, float]]) -> list[bool]:
    """Labels of least cost.

    ``u[i]`` is what labelling ``i`` False costs beyond True. An edge ``(i, j, w, v)`` costs ``w`` if ``i`` is
    True and ``j`` False, and ``v`` the other way round. Nodes whose terminal capacity outweighs all their
    open edges keep their side in every minimum cut and are settled first; maximum flow decides the rest.
    Of equal cuts the larger True side is taken.
    """
    n = len(u)
    u = list(u)
    near: list[list[tuple[int, float, float]]] = [[] for _ in range(n)]
    up, down = [0.0] * n, [0.0] * n  # what a node True, or False, may still cost by its edges
    for i, j, w, v in edges:
        near[i].append((j, w, v))
        near[j].append((i, v, w))
        up[i] += w
        down[i] += v
        up[j] += v
        down[j] += w
    side: list[bool | None] = [None] * n
    todo = [i for i in range(n) if u[i] >= up[i] or -u[i] >= down[i]]
    while todo:
        i = todo.pop()
        if side[i] is not None:
            continue
        yes = u[i] >= up[i] - 1e-9
        side[i] = yes
        for j, w, v in near[i]:
            if side[j] is None:
                u[j] += w if yes else -v
                up[j] -= v
                down[j] -= w
                if u[j] >= up[j] - 1e-9 or -u[j] >= down[j] - 1e-9:
                    todo.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        _max_flow(rest, u, near, side)
    return side  # type: ignore[return-value]


def _max_flow(rest: list[int], u: list[float], near: list[list[tuple[int, float, float]]], side: list[bool | None]) -> None:
    """Shortest augmenting paths over the unsettled nodes; nodes that still reach the sink get False."""
    cap: dict[int, dict[int, float]] = {i: {} for i in rest}
    for i in rest:
        for j, w, _ in near[i]:
            if side[j] is None:
                cap[i][j] = cap[i].get(j, 0.0) + w
                cap[j].setdefault(i, 0.0)
    src = {i: u[i] for i in rest if u[i] > 0}
    snk = {i: -u[i] for i in rest if u[i] < 0}
    while True:
        came: dict[int, int] = {i: -1 for i, c in src.items() if c > 1e-12}
        queue, end = deque(came), -1
        while queue:
            i = queue.popleft()
            if snk.get(i, 0.0) > 1e-12:
                end = i
                break
            for j, c in cap[i].items():
                if c > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if end < 0:
            break
        path, low = [end], snk[end]
        while came[path[-1]] >= 0:
            low = min(low, cap[came[path[-1]]][path[-1]])
            path.append(came[path[-1]])
        low = min(low, src[path[-1]])
        snk[end] -= low
        src[path[-1]] -= low
        for a, b in zip(path[1:], path):
            cap[a][b] -= low
            cap[b][a] = cap[b].get(a, 0.0) + low
    reach = {i for i, c in snk.items() if c > 1e-12}
    queue = deque(reach)
    while queue:
        i = queue.popleft()
        for j in cap[i]:
            if j not in reach and cap[j].get(i, 0.0) > 1e-12:
                reach.add(j)
                queue.append(j)
    for i in rest:
        side[i] = i not in reach


def _holder(open_tags: list[str], before: str | None) -> str:
    """The element that holds a text: the innermost block, else an inline element that holds all text so far."""
    for t in reversed(open_tags):
        if t not in _INLINE:
            return t
    now = open_tags[-1] if open_tags else ""
    return now if before is None or before == now else ""


_PARSED: dict[str, tuple] = {}
_LINES: dict[str, list[tuple]] = {}


def _seen(text: str) -> tuple[list[str], tuple]:
    ws = text.encode().translate(_LETTERS).decode().split() if text.isascii() else _WORD.findall(text.lower())
    return ws, _shape(text, len(ws))


def _parse_line(line: str) -> tuple:
    """``(events, text, link share, holder, words, shape, paragraph)`` of a piece of a line that starts in plain flow.

    events: the tags in order, as needed to follow containers. paragraph: what they come to if they are of
    paragraphs and list entries alone, 1 if one is left open, -1 if closed, 0 for neither; else None.
    """
    got = _PARSED.get(line)
    if got is None:
        got = _parsed(line)
        if len(line) <= 600:  # boilerplate repeats, long lines don't
            if len(_PARSED) > 60_000:
                _PARSED.clear()
            _PARSED[line] = got
    return got


def _parsed(line: str) -> tuple:
    share, events, holder = 0.0, (), ""
    if "<" not in line:
        text = _tidy(html.unescape(line) if "&" in line else line)
    elif (m := _SIMPLE.match(line)) is not None:
        tag, raw = m.group(1), m.group(2)
        text = _tidy(html.unescape(raw) if "&" in raw else raw)
        events = (("open", tag), ("close", tag)) if tag in ("p", "li") else ()
        holder = tag if text else ""
    elif (m := _LINKED.match(line)) is not None:
        raw = m.group(1)
        text = _tidy(html.unescape(raw) if "&" in raw else raw)
        events, share, holder = _LI, 1.0 if text else 0.0, "li" if text else ""
    else:
        for form, events, share, holder in _PLAIN:
            m = form.match(line)
            if m is not None:
                raw = m.group(1)
                text = _tidy(html.unescape(raw) if "&" in raw else raw)
                if not text:
                    share, holder = 0.0, ""
                break
        else:
            events, text, share, holder = _tokens(line)
    paragraph: int | None = 0
    for what, tag in events:
        if tag == "p":
            paragraph = 1 if what == "open" else -1
        elif tag != "li":
            paragraph = None
            break
    ws, shape = _seen(text) if text else ([], None)
    return events, text, share, holder, ws, shape, paragraph


def _tokens(line: str) -> tuple:
    events, parts, at, links, in_a, hidden, holder, first_holder = [], [], 0, 0, 0, "", [], None
    n = len(line)
    for m in _TOKEN.finditer(line):
        if m.start() < at:
            continue
        piece = line[at : m.start()]
        if piece and not hidden:
            parts.append(piece)
            if piece.strip():
                if in_a:
                    links += len(piece)
                if first_holder is None or first_holder in _INLINE:
                    first_holder = _holder(holder, first_holder)
        at = m.end()
        close, tag, attributes = m.groups()
        if tag is None:  # comment or declaration
            if not m.group().startswith("<!--"):
                continue
            end = line.find("-->", m.end())
            if end < 0:
                events.append(("comment", ""))
                at = n
                break
            at = end + 3
            continue
        tag = tag.lower()
        if hidden:
            if close and tag == hidden:
                hidden = ""
                events.append(("close", tag))
            continue
        if tag in _HIDDEN:
            if not close and not attributes.endswith("/"):
                hidden = tag
                events.append(("hide", tag))
            elif close:
                events.append(("close", tag))
            continue
        if tag == "a":
            in_a = 0 if close else 1
        if tag in _PARTING or tag[0] == "h" and len(tag) == 2:
            parts.append(" ")
        if tag in _EVENTS:
            events.append(("close" if close else "open", tag))
        if tag in _HOLDERS:
            if not close:
                holder.append(tag)
            elif tag in holder:
                while holder and holder.pop() != tag:
                    pass
    rest = line[at:]
    if rest and not hidden:
        parts.append(rest)
        if rest.strip() and (first_holder is None or first_holder in _INLINE):
            first_holder = _holder(holder, first_holder)
    raw = "".join(parts)
    text = _tidy(html.unescape(raw) if "&" in raw else raw)
    return tuple(events), text, min(1.0, links / max(1, len(text))), (first_holder or "") if text else ""


def is_html(body: str) -> bool:
    """Markup, not text that shows some: a block tag starts the body or ``<html>``/``<body>`` starts a line."""
    if _STARTS.match(body):
        return bool(_CLOSES.search(body)) or bool(_DOCUMENT.search(body))
    return bool(_DOCUMENT.search(body)) and bool(_CLOSES.search(body))


def _pieces(line: str) -> list[str]:
    """A line, cut before each of its blocks if it holds several, and before the ends of its containers."""
    if line.count("<") <= 2:
        return [line]
    at, got = 0, []
    for m in _BLOCK_EDGE.finditer(line):
        cut = m.end() if m.lastindex else m.start()
        if cut > at:
            got.append(line[at:cut])
            at = cut
    if at < len(line):
        got.append(line[at:])
    return got


def _parse_pieces(line: str) -> list[tuple]:
    """Each piece of a line, followed by what ``_parse_line`` gives."""
    got = _LINES.get(line)
    if got is None:
        pieces = _pieces(line)
        got = [(line, *_parsed(line))] if len(pieces) == 1 else [(p, *_parse_line(p)) for p in pieces]
        if len(line) <= 600:
            if len(_LINES) > 60_000:
                _LINES.clear()
            _LINES[line] = got
    return got


class _Box:
    """An open container: its number, the heading that holds in it, the wall around it."""

    __slots__ = ("tag", "no", "head", "wall", "listed")

    def __init__(self, tag, no, head, wall, listed):
        self.tag, self.no, self.head, self.wall, self.listed = tag, no, head, wall, listed


def _html_nodes(lines: list[str]) -> list[Node]:
    """Nodes of a marked-up page."""
    nodes: list[Node] = []
    stack = [_Box("root", 0, -1, -1, False)]
    count: dict[str, int] = {}
    n_blocks, hidden, p_id, pre, piece_no = 1, "", 0, 0, 0
    for no, whole in enumerate(lines, 1):
        if hidden:
            end = "-->" if hidden == "comment" else f"</{hidden}"
            at = whole.lower().find(end)
            if at < 0:
                continue
            gt = at + 2 if hidden == "comment" else whole.find(">", at)
            hidden = ""
            whole = whole[gt + 1 :] if gt >= 0 else ""
        for line, events, text, share, holder, ws, shape, paragraph in _parse_pieces(whole) if not pre or "</pre" in whole else ((whole, *_parse_line(whole)),):
            piece_no += 1
            if hidden:
                end = "-->" if hidden == "comment" else f"</{hidden}"
                at = line.lower().find(end)
                if at < 0:
                    continue
                gt = at + 2 if hidden == "comment" else line.find(">", at)
                hidden = ""
                line = line[gt + 1 :] if gt >= 0 else ""
                events, text, share, holder, ws, shape, paragraph = _parse_line(line)
            was_p, was_pre = p_id, pre
            if paragraph is not None and not pre:  # most lines: no container is opened or closed
                if paragraph:
                    p_id = piece_no if paragraph > 0 else 0
                if not text:
                    continue
                box, block = stack[-1], was_p or p_id
                if not holder:
                    if block:
                        holder = "p"
                elif holder in ("a", "li"):
                    if holder == "a" and any(e[1] == "li" for e in events):
                        holder = "li"
                    if holder == "li" and share > 0.8 and not box.listed:
                        holder = "a"
                elif holder in ("th", "tr"):
                    holder = "td"
                heading = holder in _HEADINGS
                nodes.append(Node(no, text, line, ws, (True, holder, share > 0.6, shape, 0), block, holder, box.no, -1 if heading else box.head, box.wall, heading, box.listed))
                if heading:
                    box.head = len(nodes) - 1
                continue
            for what, tag in events:
                if what == "open":
                    if tag == "p":
                        p_id = piece_no
                    elif tag == "pre":
                        pre = was_pre = piece_no
                    elif tag != "li":
                        top = stack[-1]
                        kept = top.head if text or tag in _LISTS else -1  # a container of its own starts anew
                        if kept < 0 and not text:
                            top.head = -1
                        stack.append(_Box(tag, n_blocks, kept, n_blocks if tag in WALLS else top.wall, tag in _LISTS or top.listed and tag not in ("div", "section")))
                        count[tag] = count.get(tag, 0) + 1
                        n_blocks += 1
                        p_id = 0
                elif what == "close":
                    if tag == "p":
                        p_id = 0
                    elif tag == "pre":
                        pre = 0
                    elif tag != "li" and count.get(tag):
                        while True:
                            out = stack.pop().tag
                            count[out] -= 1
                            if out == tag:
                                break
                        p_id = 0
                elif what == "hide":
                    hidden = tag
                elif what == "comment":
                    hidden = "comment"
            if hidden and hidden != "comment":
                last = [e for e in events if e[1] == hidden]
                if last and last[-1][0] == "close":  # closed again in the same line
                    hidden = ""
            if not text:
                continue
            box = stack[-1]
            if was_pre or pre:
                holder, block = "pre", was_pre or pre
            else:
                block = was_p or p_id
                if not holder:
                    inner = box.tag
                    if block:
                        holder = "p"
                    elif inner in ("td", "th", "blockquote", "div") and any(e == ("open", inner) for e in events):
                        holder = inner
                if holder == "a" and any(e[1] == "li" for e in events):
                    holder = "li"
                if holder == "a" and events and events[0] == ("open", "div"):
                    holder = "div"
                if holder == "li" and share > 0.8 and not box.listed:
                    holder = "a"
                if holder in ("th", "tr"):
                    holder = "td"
            key = (True, holder, share > 0.6, shape, 0)
            heading = holder in _HEADINGS
            nodes.append(Node(no, text, line, ws, key, block, holder, box.no, -1 if heading else box.head, box.wall, heading, box.listed))
            if heading:
                box.head = len(nodes) - 1
    return nodes


def _text_nodes(lines: list[str]) -> list[Node]:
    """Nodes of a page of plain text; blank lines part its containers."""
    nodes: list[Node] = []
    region = 0
    for no, line in enumerate(lines, 1):
        got = _PARSED.get("\0" + line)
        if got is None:
            text = _tidy(line)
            got = (text, *(_seen(text) if text else ([], None)))
            if len(line) <= 600:
                if len(_PARSED) > 60_000:
                    _PARSED.clear()
                _PARSED["\0" + line] = got
        text, ws, shape = got
        if not text:
            region += 1
            continue
        indent = 2 if line[:4] == "    " or line[:1] == "\t" else 1 if line[:2] in ("* ", "• ", "- ") else 0
        nodes.append(Node(no, text, line, ws, (False, "", False, shape, indent), 0, "pre" if indent == 2 else "", region, -1, -1, False))
    return nodes


def page_nodes(body: str) -> tuple[bool, list[Node]]:
    lines = body.split("\n")
    if "\r" in body:
        lines = [x.rstrip("\r") for x in lines]
    marked = is_html(body)
    return marked, _html_nodes(lines) if marked else _text_nodes(lines)


def capacities(nodes: list[Node], model: Model) -> list[float]:
    seen, out = model._seen, []
    for x in nodes:
        at = (x.text, x.key)
        u = seen.get(at)
        if u is None:
            u = max(-MOST, min(MOST, model.score(x.key, x.ws)))
            if len(x.text) <= 160:  # boilerplate repeats, long texts don't
                if len(seen) > 60_000:
                    seen.clear()
                seen[at] = u
        out.append(u)
    return out


def _text_heads(nodes: list[Node], u: list[float]) -> list[int]:
    """For each line of a plain page, the line that heads it, or -1.

    A short line of boilerplate below content heads the few lines between it and the next boilerplate
    in its block, or the end of the page.
    """
    out = [-1] * len(nodes)
    content, lead = 0.0, -1
    for i, x in enumerate(nodes):
        if lead >= 0 and x.region != nodes[lead].region:
            lead = -1
        if u[i] < LEAD:
            if 0 <= lead and i - lead <= LEAD_LINES + 1:
                out[lead + 1 : i] = [lead] * (i - lead - 1)
            lead = i if content >= LEAD_AFTER and len(x.ws) <= LEAD_WORDS and not x.key[4] and not x.key[3][2] else -1
        content += max(0.0, u[i])
    if 0 <= lead and len(nodes) - lead <= LEAD_LINES + 1:
        out[lead + 1 :] = [lead] * (len(nodes) - lead - 1)
    return out


def cut_nodes(marked: bool, nodes: list[Node], model: Model) -> list[bool]:
    """Which nodes are main content: the minimum cut of the page's graph.

    A node whose capacity outweighs all that its edges may cost keeps its side in every minimum cut. These
    are told from their edges' sums, and only the others, with what the decided ones pull at them, make
    up the graph that is cut.
    """
    u = capacities(nodes, model)
    n = len(nodes)
    heads = [x.head for x in nodes] if marked else _text_heads(nodes, u)
    below: dict[int, int] = {}
    for h in heads:
        if h >= 0:
            below[h] = below.get(h, 0) + 1
    regions = [x.region for x in nodes]
    members = Counter(regions) if marked else {}
    near = W_SAME if marked else W_LINE
    # weight of the edge to the node before
    link = [0.0, *(W_LINE_BREAK if x.block and x.block == p.block else near if r == q else W_ACROSS for p, x, q, r in zip(nodes, nodes[1:], regions, regions[1:])), 0.0]
    side: list[bool | None] = [None] * n
    for i, x in enumerate(nodes):
        k, c = below.get(i, 0), u[i]
        if k:
            c = u[i] = c * (1 + k)  # a heading speaks for all that stands below it
        down = link[i] + link[i + 1]
        if marked and members[regions[i]] > 1:
            down += W_DOM + W_LIST if x.box else W_DOM
        if c >= 0 and c >= down + (W_HEADING if heads[i] >= 0 else 0.0) + (W_WALL if x.wall >= 0 else 0.0):
            side[i] = True
        elif -c >= down + W_HEADING * k:
            side[i] = False
    open_ = [i for i in range(n) if side[i] is None]
    if open_:
        _cut_open(marked, nodes, u, heads, members, link, side, open_)
    return side  # type: ignore[return-value]


def _cut_open(marked: bool, nodes: list[Node], u: list[float], heads: list[int], members: dict[int, int], link: list[float], side: list[bool | None], open_: list[int]) -> None:
    """Cut the graph of the undecided nodes and their hubs; ``side`` takes the result."""
    at = {i: k for k, i in enumerate(open_)}
    cap = [u[i] for i in open_]
    edges: list[tuple[int, int, float, float]] = []

    def tie(i: int, j: int, w: float, v: float) -> None:
        """An edge between nodes, of which one is decided, perhaps."""
        a, b = at.get(i), at.get(j)
        if a is not None and b is not None:
            edges.append((a, b, w, v))
        elif a is not None:
            cap[a] += v if side[j] else -w
        elif b is not None:
            cap[b] += w if side[i] else -v

    done = -1
    for i in open_:
        if i and i - 1 != done:
            tie(i - 1, i, link[i], link[i])
        elif i:
            edges.append((at[i - 1], at[i], link[i], link[i]))
        if i + 1 < len(nodes) and side[i + 1] is not None:
            tie(i, i + 1, link[i + 1], link[i + 1])
        done = i
    for i, h in enumerate(heads):
        if h >= 0 and (i in at or h in at):
            tie(i, h, W_HEADING, 0.0)
    if marked:
        regions = {nodes[i].region for i in open_ if members[nodes[i].region] > 1}
        walls = {nodes[i].wall for i in open_ if nodes[i].wall >= 0}
        hub: dict[tuple, int] = {}
        for i, x in enumerate(nodes if regions or walls else ()):
            if x.region in regions:
                h = hub.get((0, x.region))
                if h is None:
                    h = hub[0, x.region] = len(cap)
                    cap.append(0.0)
                w = W_DOM + W_LIST if x.box else W_DOM
                if i in at:
                    edges.append((at[i], h, w, w))
                else:
                    cap[h] += w if side[i] else -w
            if x.wall in walls:
                h = hub.get((1, x.wall))
                if h is None:
                    h = hub[1, x.wall] = len(cap)
                    cap.append(-MOST)
                cap[h] -= MOST
                if i in at:
                    edges.append((at[i], h, W_WALL, 0.0))
                elif side[i]:
                    cap[h] += W_WALL
    for i, keep in zip(open_, min_cut(cap, edges)):
        side[i] = keep


#: The classifier before any page was seen.
UNFITTED = Model()


def label_nodes(body: str | None, model: Model = UNFITTED) -> list[Node]:
    """The nodes of the main body, in order. Null, empty and blank bodies have none."""
    if not body or body.isspace():
        return []
    marked, nodes = page_nodes(body)
    if not nodes:
        return []
    return [x for x, keep in zip(nodes, cut_nodes(marked, nodes, model)) if keep]


def label_lines(body: str | None, model: Model = UNFITTED) -> list[tuple[int, str, str]]:
    """``(line number, visible text, holder)`` of the blocks of the main body, in order.

    ``holder`` names the element around the text, ``pre`` for code.
    """
    return [(x.line, x.text, x.holder) for x in label_nodes(body, model)]


def main_text(body: str | None, model: Model = UNFITTED) -> str:
    """Visible text of the main body, a block a line."""
    return "\n".join(x.text for x in label_nodes(body, model))


def main_words(body: str | None, model: Model = UNFITTED) -> list[str]:
    """The words of ``main_text``; the classifier's words of a block are these, unless it holds a digit."""
    from auditloom.llm import text as T

    out: list[str] = []
    for x in label_nodes(body, model):
        out += T.words(x.text) if _DIGIT.search(x.text) else x.ws
    return out


# --- fitting ------------------------------------------------------------------------------------


def learn(pages: list[tuple[str, str, str]]) -> Model:
    """The classifier of ``(site, url, body)`` pages, labelled by what recurs on each site.

    Repeated bodies of a site count once. Sites of fewer than TEMPLATE_PAGES pages give no labels; without
    any label the prior holds.
    """
    import numpy as np

    sites: dict[str, dict] = {}
    for site, url, body in pages:
        if body and not body.isspace():
            sites.setdefault(site or "", {})[body] = url
    parsed, labels = [], []
    for bodies in sites.values():
        got = [page_nodes(b) for b in bodies]
        on: dict[str, set] = {}
        for k, (_, nodes) in enumerate(got):
            for x in nodes:
                on.setdefault(_COUNT.sub("0 ", x.text), set()).add(k)
        known = len(got) >= TEMPLATE_PAGES
        for k, (marked, nodes) in enumerate(got):
            parsed.append((marked, nodes))
            row = []
            for x in nodes:
                n = len(on[_COUNT.sub("0 ", x.text)])
                row.append(None if x.holder == "pre" else 0.0 if known and n >= max(3, TEMPLATE_SHARE * len(got)) or x.wall >= 0 else 1.0 if known and n == 1 and not x.key[2] and x.key[3][2] < 2 and x.head < 0 else None)
            labels.append(row)
    if not any(y is not None for row in labels for y in row):
        return Model()
    flat = [x for _, nodes in parsed for x in nodes]
    n_pages = len(flat)
    for bodies in sites.values():  # what stands for a page without scripts is no content
        for b in bodies:
            for t in _NOSCRIPT.findall(b) if "oscript" in b or "OSCRIPT" in b else ():
                text = _tidy(html.unescape(t))
                if text:
                    ws, shape = _seen(text)
                    flat.append(Node(0, text, "", ws, (True, "p", False, shape, 0), 0, "p", 0, -1, -1, False))
    names: dict = {}
    ids: dict = {}
    fi, fp, wi, wp, wv = [], [], [], [], []
    for i, x in enumerate(flat):
        for f in form_features(x.key):
            fi.append(names.setdefault(f, len(names)))
            fp.append(i)
        v = 1.0 / max(1, len(x.ws)) ** 0.5
        for w in x.ws:
            b = ids.get(w)
            if b is None:
                b = ids[w] = bucket(w)
            wi.append(b)
            wp.append(i)
            wv.append(v)
    fi, fp, wi, wp, wv = (np.array(a) for a in (fi, fp, wi, wp, wv))
    start = np.array([prior(f) for f in names])
    fixed = [0.0] * (len(flat) - n_pages)
    y = np.array([np.nan if v is None else v for row in labels for v in row] + fixed)
    model = Model()
    for k in range(ROUNDS):
        form, word = _logistic(y, len(flat), fi, fp, start, wi, wp, wv)
        model = Model({f: float(form[n] - start[n]) for f, n in names.items()}, word.astype(np.float32))
        if k + 1 < ROUNDS:
            y = np.array([1.0 if v else 0.0 for marked, nodes in parsed for v in cut_nodes(marked, nodes, model)] + fixed)
    return model


def _logistic(y, n, fi, fp, start, wi, wp, wv):
    """Ridge logistic regression around the prior, classes of equal weight, by scaled gradient steps."""
    import numpy as np

    known = ~np.isnan(y)
    yy = np.where(known, y, 0.0)
    one, zero = (known & (yy == 1)).sum(), (known & (yy == 0)).sum()
    weight = np.where(known, np.where(yy == 1, 0.5 / max(1, one), 0.5 / max(1, zero)), 0.0) * (one + zero)
    form, word = start.copy(), np.zeros(BUCKETS)
    gf2, gw2 = np.full(len(form), 1e-8), np.full(BUCKETS, 1e-8)
    for k in range(ITERATIONS):
        u = np.bincount(fp, form[fi], n) + np.bincount(wp, word[wi] * wv, n)
        g = weight * (1 / (1 + np.exp(-np.clip(u, -30, 30))) - yy)
        gf = np.bincount(fi, g[fp], len(form)) + RIDGE * (form - start)
        gw = np.bincount(wi, g[wp] * wv, BUCKETS) + RIDGE * word
        gf2 += gf * gf
        gw2 += gw * gw
        form -= 0.5 * gf / np.sqrt(gf2)
        word -= 0.5 * gw / np.sqrt(gw2)
    return form, word


def fit(pages: DataFrame) -> Model:
    """The classifier for these pages, learned on the driver from a bounded sample.

    Of the SITES sites first in hash order with TEMPLATE_PAGES pages or more, about SITE_PAGES pages each are
    taken in hash order of their URL, at most ``SITES * SITE_PAGES`` in all, each of up to SAMPLE_CHARS
    characters. Frames without ``site`` and ``url`` give the prior.
    """
    if not {"site", "url", "body"} <= set(pages.columns):
        return UNFITTED
    known = pages.where("body IS NOT NULL AND site IS NOT NULL")
    n = known.groupBy("site").agg(F.count("*").alias("n")).where(F.col("n") >= TEMPLATE_PAGES)
    chosen = {r["site"]: r["n"] for r in n.orderBy(F.xxhash64("site"), "site").limit(SITES).collect()}
    if not chosen:
        return UNFITTED
    every = F.create_map(*[F.lit(x) for s, k in chosen.items() for x in (s, max(1, k // SITE_PAGES))])
    at = F.xxhash64("url", "seq") if "seq" in pages.columns else F.xxhash64("url")
    rows = (
        known.where(F.col("site").isin(list(chosen)) & (F.length("body") <= SAMPLE_CHARS)).withColumn("at", at)
        .where(F.pmod("at", F.element_at(every, F.col("site"))) == 0)
        .select("at", "site", "url", "body").orderBy("at", "url").limit(SITES * SITE_PAGES).collect()
    )
    return learn([(r["site"], r["url"], r["body"]) for r in rows])


def unswept(fn):
    """``fn`` over Arrow batches without sweeps for reference cycles: blocks make none, and a sweep would visit all kept lines."""

    def run(batches: Iterator) -> Iterator:
        import gc

        was = gc.isenabled()
        gc.disable()
        try:
            yield from fn(batches)
        finally:
            if was:
                gc.enable()

    return run


def _numbered(model: Model):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            seq, no = [], []
            for s, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                last = 0
                for x in label_nodes(body, model):
                    if x.line != last:
                        seq.append(s)
                        no.append(x.line)
                        last = x.line
            yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(no, pa.int32())], names=["seq", "line_no"])

    return run


def main_lines(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``(seq, line_no)`` of the lines that carry text of the main body, lines counted from 1.

    The classifier is fitted to the pages unless one is given. Repeated rows are labelled each for itself;
    null and blank bodies yield nothing; other columns are ignored.
    """
    model = fit(pages) if model is None else model
    return map_arrow(pages.select("seq", "body"), unswept(_numbered(model)), "seq long, line_no int")
