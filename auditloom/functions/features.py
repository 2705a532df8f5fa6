"""One parse per page: the feature struct ``d`` that all document checks read.

Null for pages that are no HTML. Non-null pages carry scalar facts and small arrays of element facts,
so the checks themselves are plain column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.session import map_arrow

FEATURES = (
    "struct<title:string,meta:map<string,string>,prop:map<string,string>,h1:int,headings:array<int>,canonical:int,has_lang:boolean,"
    "scripts:array<struct<src:string,in_head:boolean,deferred:boolean,integrity:boolean,type:string,text:string>>,styles:array<string>,"
    "css:array<struct<href:string,in_head:boolean,media:string,integrity:boolean>>,hints:boolean,n_elements:int,"
    "unlabelled:int,anchors:array<struct<href:string,text:string,named:boolean>>,silent_buttons:int,headless_tables:int,bare_figures:int,"
    "tabindex:array<struct<tag:string,value:int>>,landmark:boolean,hidden_focus:array<string>,clickable:array<string>,silent_videos:int,no_autocomplete:array<string>,"
    "imgs:array<struct<src:string,has_src:boolean,alt:string,in_link:boolean,in_header:boolean,loading:string,sized:boolean,responsive:boolean,role:string>>,"
    "hreflang:array<struct<lang:string,href:string>>,jsonld:array<struct<ok:boolean,error:string>>,"
    "findings:array<struct<code:string,severity:string,message:string,path:string>>,microdata:string,"
    "text:string,n_words:int,n_p:int,has_article:boolean,levels:array<int>>"
)
_INT = re.compile(r"^[+-]?\d+$")
_SPACES = re.compile(r"[\s   -   　]+")
#: Roles and types that the checks name.
LANDMARKS = frozenset(["main", "navigation", "banner", "contentinfo"])
UNLABELLED_TYPES = frozenset(["hidden", "submit", "button", "reset", "image"])
AUTOCOMPLETE_TYPES = frozenset(["email", "tel", "name", "username", "password", "address", "postal-code", "cc-number"])
OPERABLE = frozenset(["button", "a", "input", "select", "textarea"])


def visible_text(doc) -> str:
    """Text without scripts and styles, its white space collapsed."""
    out, stack = [], [doc]
    while stack:
        n = stack.pop()
        if not n.tag:
            out.append(n.data)
        elif n.tag not in ("script", "style"):
            stack.extend(reversed(n.kids))
    return _SPACES.sub(" ", " ".join(out)).strip()


def _int(s: str | None) -> int | None:
    s = (s or "").strip()
    return int(s) if _INT.match(s) and abs(int(s)) < 2**31 else None


def read_json(text: str):
    """``(value, None)`` or ``(None, what is wrong)``; stricter than ``json.loads`` on constants."""

    def no(name):
        raise ValueError(f"invalid constant {name}")

    try:
        return json.loads(text, parse_constant=no), None
    except (ValueError, RecursionError) as e:
        return None, str(e).split("\n")[0] or "invalid JSON"


def extract(body: str, registry) -> dict:
    from auditloom.functions import dom
    from auditloom.schema.validate import page_findings

    doc = dom.parse(body)
    nodes = [n for n in doc.walk() if n.tag != "#document"]
    by: dict[str, list] = {}
    for n in nodes:
        by.setdefault(n.tag, []).append(n)
    meta: dict[str, str] = {}
    prop: dict[str, str] = {}
    for n in by.get("meta", []):
        for key, into in (("name", meta), ("property", prop)):
            if key in n.attrs:
                into.setdefault(n.attrs[key].lower(), n.attrs.get("content", ""))
    rels = [(n, n.attrs.get("rel", "")) for n in by.get("link", [])]
    label_for = {n.attrs["for"] for n in by.get("label", []) if n.attrs.get("for")}

    def unlabelled(n) -> bool:
        a = n.attrs
        if a.get("type", "").lower() in UNLABELLED_TYPES or a.get("aria-label", "").strip() or a.get("aria-labelledby", "").strip():
            return False
        return not (a.get("id") and a["id"] in label_for) and not n.inside("label")

    def named(n) -> bool:
        return bool(n.attrs.get("aria-label", "").strip())

    figures = 0
    for f in by.get("figure", []):
        inner = list(f.walk())
        if not any(x.tag == "figcaption" for x in inner):
            figures += sum(x.tag == "img" and not x.attrs.get("alt", "").strip() for x in inner)
    headings = [int(n.tag[1]) for n in nodes if len(n.tag) == 2 and n.tag[0] == "h" and n.tag[1] in "123456"]
    blocks = [n.text() for n in by.get("script", []) if n.attrs.get("type", "").strip().lower() == "application/ld+json"]
    parsed = [read_json(b) for b in blocks]
    micro = next((k for n in nodes for k in ("itemscope", "itemprop", "itemtype") if k in n.attrs), None)
    text = visible_text(doc)
    return {
        "title": by["title"][0].text() if "title" in by else None,
        "meta": list(meta.items()),
        "prop": list(prop.items()),
        "h1": len(by.get("h1", [])),
        "headings": headings,
        "canonical": sum(r.lower() == "canonical" for _, r in rels),
        "has_lang": any("lang" in n.attrs for n in by.get("html", [])),
        "scripts": [
            {"src": n.attrs.get("src"), "in_head": n.inside("head"), "deferred": "async" in n.attrs or "defer" in n.attrs, "integrity": "integrity" in n.attrs,
             "type": n.attrs.get("type", ""), "text": "" if "src" in n.attrs else n.text()}
            for n in by.get("script", [])
        ],
        "styles": [n.text() for n in by.get("style", [])],
        "css": [
            {"href": n.attrs.get("href", ""), "in_head": n.inside("head"), "media": n.attrs.get("media"), "integrity": "integrity" in n.attrs}
            for n, r in rels if r.lower() == "stylesheet"
        ],
        "hints": any(r.lower() in ("preconnect", "dns-prefetch") and n.inside("head") for n, r in rels),
        "n_elements": len(nodes),
        "unlabelled": sum(map(unlabelled, by.get("input", []))),
        "anchors": [
            {"href": n.attrs.get("href"), "text": n.text().strip(), "named": named(n) or any(x.tag == "img" and x.attrs.get("alt", "").strip() for x in n.walk())}
            for n in by.get("a", [])
        ],
        "silent_buttons": sum(not named(n) and not n.text().strip() for n in by.get("button", [])),
        "headless_tables": sum(not any(x.tag == "th" for x in n.walk()) for n in by.get("table", [])),
        "bare_figures": figures,
        "tabindex": [{"tag": n.tag, "value": v} for n in nodes if (v := _int(n.attrs.get("tabindex"))) is not None],
        "landmark": any(n.attrs.get("role", "").strip().lower() in LANDMARKS for n in nodes)
        or "main" in by or "nav" in by or any(not n.inside("article") for t in ("header", "footer") for n in by.get(t, [])),
        "hidden_focus": [n.tag for n in nodes if n.attrs.get("aria-hidden", "").strip().lower() == "true" and (v := _int(n.attrs.get("tabindex"))) is not None and v >= 0],
        "clickable": [n.tag for n in nodes if "onclick" in n.attrs and n.tag not in OPERABLE and "tabindex" not in n.attrs and "role" not in n.attrs],
        "silent_videos": sum(not any(x.tag == "track" and x.attrs.get("kind", "").strip().lower() in ("captions", "subtitles") for x in n.walk()) for n in by.get("video", [])),
        "no_autocomplete": [t for n in by.get("input", []) if (t := n.attrs.get("type", "").strip().lower()) in AUTOCOMPLETE_TYPES and "autocomplete" not in n.attrs],
        "imgs": [
            {"src": n.attrs.get("src", ""), "has_src": "src" in n.attrs, "alt": n.attrs.get("alt"), "in_link": n.inside("a"), "in_header": n.inside("header"), "loading": n.attrs.get("loading", "").lower(),
             "sized": "width" in n.attrs or "height" in n.attrs, "responsive": "srcset" in n.attrs or "sizes" in n.attrs, "role": n.attrs.get("role", "").lower()}
            for n in by.get("img", [])
        ],
        "hreflang": [{"lang": n.attrs["hreflang"], "href": n.attrs["href"]} for n, r in rels if r.lower() == "alternate" and n.attrs.get("hreflang") and "href" in n.attrs],
        "jsonld": [{"ok": e is None, "error": e} for _, e in parsed],
        "findings": [{"code": c, "severity": s, "message": m, "path": p} for c, s, m, p in page_findings([v for v, e in parsed if e is None], registry)],
        "microdata": micro,
        "text": text,
        "n_words": len(text.split(" ")) if text else 0,
        "n_p": len(by.get("p", [])),
        "has_article": "article" in by,
        "levels": headings,
    }


def with_features(pages: DataFrame, registry_path: str | None = None) -> DataFrame:
    """All columns and ``d``. Pages that are no HTML, or have no body, have a null or an empty document."""
    kind = T._parse_datatype_string(FEATURES)
    out = T.StructType([*pages.schema.fields, T.StructField("d", kind, True)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        from auditloom.schema.registry import load_registry

        registry = load_registry(registry_path)
        arrow = to_arrow_type(kind)
        for b in batches:
            got = [
                extract(body or "", registry) if ct and "text/html" in ct.lower() else None
                for ct, body in zip(b.column("content_type").to_pylist(), b.column("body").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, arrow)], names=[*b.schema.names, "d"])

    return map_arrow(pages, run, out)


def text_of(column):
    """Visible text of an HTML column, for operators that need nothing else."""

    @F.pandas_udf(T.StringType())
    def run(s):
        from auditloom.functions import dom

        return s.map(lambda x: visible_text(dom.parse(x)) if x else "")

    return run(column)
