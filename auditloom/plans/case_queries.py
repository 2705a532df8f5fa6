"""Queries over small pages built here, for checks that the data tables can't show, each with its expected rows as SQL.

A case is a page and the checks it is about; of the issues found on it, those of these checks must be
exactly the expected ones.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.checks import accessibility, media, performance, security, seo
from auditloom.functions.features import with_features
from auditloom.model import LIGHTHOUSE, LINK_PROBE, PAGES, TLS_PROBE
from auditloom.plans import audit as A
from auditloom.site import duplicates, links

SITE = "https://site.example"
_PAGE = {
    "seq": 0, "site": "site.example", "url": SITE, "status_code": 200, "content_type": "text/html; charset=utf-8", "redirect_chain": [], "body": "", "headers": {}, "links": [], "assets": [], "depth": 1,
    "fetched_at": datetime.datetime(2025, 3, 1, 12), "fetch_duration_ns": 1, "in_sitemap": False,
}


def case_pages(spark: SparkSession, cases: list) -> DataFrame:
    """Pages of ``(name, facts or body, ...)``; the URL is the site's and the name unless the facts say otherwise."""
    rows = []
    for k, (name, facts, *_) in enumerate(cases):
        p = {**_PAGE, "seq": k, "url": f"{SITE}/{name}", **(facts if isinstance(facts, dict) else {"body": facts})}
        rows.append(tuple(p[c.split()[0]] for c in PAGES.split(", ")))
    return spark.createDataFrame(rows, PAGES)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"


def values_sql(rows: list[tuple], names: list[str]) -> str:
    """The rows as SQL; no rows give an empty result of text columns."""
    if not rows:
        return "SELECT " + ", ".join(f"'' AS {n}" for n in names) + " WHERE false"
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(names)})"


ISSUE_NAMES = ["url", "check_name", "severity", "message", "detail"]


def _issue_query(cases: list, check, about: str = ""):
    def query(spark: SparkSession, d: str) -> DataFrame:
        asked = [(f"{SITE}/{c[0]}" if isinstance(c[1], str) or "url" not in c[1] else c[1]["url"], name) for c in cases for name in c[2]]
        found = A.page_issues(with_features(case_pages(spark, cases)), {"x": check})
        names = spark.createDataFrame(asked, "url string, check_name string").distinct()
        return found.join(names, ["url", "check_name"], "left_semi").select(*ISSUE_NAMES)

    return query


def _issue_sql(cases: list) -> str:
    rows = []
    for name, facts, _, expected in cases:
        url = facts["url"] if isinstance(facts, dict) and "url" in facts else f"{SITE}/{name}"
        rows += [(url, c, s, m, detail[0] if detail else "") for c, s, m, *detail in expected]
    return values_sql(rows, ISSUE_NAMES)


# --- search-engine checks ---------------------------------------------------------------------

_OG = ["seo/missing-og-title", "seo/missing-og-description", "seo/missing-og-image"]
_D = "seo/missing-meta-description", "seo/meta-description-length"
SEO = [
    ("no-description", "<p>x", _D, [("seo/missing-meta-description", "warning", "page is missing a meta description")]),
    ("blank-description", "<meta name=description content=''>", _D, [("seo/missing-meta-description", "warning", "page is missing a meta description")]),
    ("short-description", "<meta name=Description content='too short'>", _D, [("seo/meta-description-length", "info", "meta description length is 9 characters, expected 70-155")]),
    ("long-description", f"<meta name=description content='{'é' * 80}'>", _D, [("seo/meta-description-length", "info", "meta description length is 160 characters, expected 70-155")]),
    ("good-description", f"<meta name=description content='{'d' * 155}'>", _D, []),
    ("no-h1", "<h2>x</h2>", ["seo/missing-h1", "seo/multiple-h1"], [("seo/missing-h1", "warning", "page is missing an <h1> tag")]),
    ("one-h1", "<h1>x</h1>", ["seo/missing-h1", "seo/multiple-h1"], []),
    ("three-h1", "<h1>x</h1><h1>y</h1><div><h1>z</h1></div>", ["seo/missing-h1", "seo/multiple-h1"], [("seo/multiple-h1", "warning", "page has 3 <h1> tags, expected 1")]),
    ("no-canonical", "<link rel=icon href=/x>", ["seo/missing-canonical", "seo/multiple-canonical"], [("seo/missing-canonical", "warning", "page is missing a canonical link")]),
    ("one-canonical", "<link rel=canonical href=/x>", ["seo/missing-canonical", "seo/multiple-canonical", "seo/meta-robots-conflict"], []),
    ("two-canonical", "<link rel=canonical href=/x><link rel=Canonical href=/y>", ["seo/missing-canonical", "seo/multiple-canonical"], [("seo/multiple-canonical", "warning", "page has 2 canonical links, expected at most 1")]),
    ("no-lang", "<html><p>x", ["seo/missing-lang"], [("seo/missing-lang", "warning", "page is missing a lang attribute on the <html> tag")]),
    ("lang", "<html lang=en><p>x", ["seo/missing-lang"], []),
    ("no-og", "<p>x", _OG, [(c, "info", f"page is missing an og:{c.rsplit('-', 1)[1]} meta tag") for c in _OG]),
    ("og-by-name", "<meta name='og:title' content=t>", ["seo/missing-og-title"], [("seo/missing-og-title", "info", "page is missing an og:title meta tag")]),
    ("og", "<meta property='og:title' content=t><meta property='og:description' content=d><meta property='og:image' content=i>", _OG, []),
    ("robots-conflict", "<meta name=robots content='NOINDEX, follow'><link rel=canonical href=/x>", ["seo/meta-robots-conflict"], [("seo/meta-robots-conflict", "warning", "page has both noindex robots directive and a canonical link")]),
    ("noindex-alone", "<meta name=robots content=noindex>", ["seo/meta-robots-conflict"], []),
    ("no-twitter", "<p>x", ["seo/missing-twitter-card"], [("seo/missing-twitter-card", "info", "page is missing a twitter:card meta tag")]),
    ("twitter", "<meta name='twitter:card' content=summary>", ["seo/missing-twitter-card"], []),
    ("twitter-property", "<meta property='twitter:card' content=summary>", ["seo/missing-twitter-card"], []),
    ("no-viewport", "<p>x", ["seo/missing-viewport"], [("seo/missing-viewport", "critical", "page is missing a viewport meta tag")]),
    ("viewport", "<meta name=viewport content='width=device-width'>", ["seo/missing-viewport"], []),
    ("no-html", {"body": "<p>x", "content_type": "text/plain"}, ["seo/missing-viewport", "seo/missing-h1", "seo/missing-title"], []),
    ("title-of-multiple-bytes", f"<title>{'é' * 40}</title>", ["seo/title-length"], [("seo/title-length", "warning", "title length is 80 characters, expected 30-60")]),
]

# --- performance ------------------------------------------------------------------------------

_GZIP = {"content-encoding": ["gzip"]}
_P = "performance/"
PERFORMANCE = [
    ("large", {"body": "x" * 102_401}, [_P + "large-html"], [(_P + "large-html", "warning", "HTML size is 102401 bytes (100 KB), maximum recommended is 102400 bytes")]),
    ("not-large", {"body": "x" * 102_400}, [_P + "large-html"], []),
    ("plain", {"body": "x"}, [_P + "no-compression"], [(_P + "no-compression", "warning", "HTML response is not compressed (missing gzip or br Content-Encoding)")]),
    ("gzip", {"body": "x", "headers": _GZIP}, [_P + "no-compression"], []),
    ("brotli", {"body": "x", "headers": {"content-encoding": ["br"]}}, [_P + "no-compression"], []),
    ("script", "<head><script src=/a.js></script><script src=/b.js async></script><script src=/c.js defer></script><script>x()</script></head><body><script src=/d.js></script>", [_P + "render-blocking-script"],
     [(_P + "render-blocking-script", "warning", "render-blocking script in <head>: /a.js")]),
    ("styles", "<head>" + "".join(f"<link rel=stylesheet href=/{k}.css>" for k in "abcd") + "</head>", [_P + "excessive-css"], [(_P + "excessive-css", "info", "page has 4 stylesheets in <head>, maximum recommended is 3")]),
    ("three-styles", "<head>" + "".join(f"<link rel=stylesheet href=/{k}.css>" for k in "abc") + "</head>", [_P + "excessive-css"], []),
    ("media", "<head><link rel=stylesheet href=/a.css media=print><link rel=stylesheet href=/b.css media=ALL><link rel=stylesheet href=/c.css></head><body><link rel=stylesheet href=/d.css>", [_P + "render-blocking-css"],
     [(_P + "render-blocking-css", "warning", "render-blocking stylesheet in <head>: /b.css"), (_P + "render-blocking-css", "warning", "render-blocking stylesheet in <head>: /c.css")]),
    ("no-hints", "<head></head>", [_P + "missing-resource-hints"], [(_P + "missing-resource-hints", "info", 'page has no <link rel="preconnect"> or <link rel="dns-prefetch"> resource hints')]),
    ("hints", "<head><link rel=dns-prefetch href=//x.example></head>", [_P + "missing-resource-hints"], []),
    ("font", "<style>@font-face{font-family:a}</style>", [_P + "font-loading"], [(_P + "font-loading", "info", "inline @font-face declaration missing font-display property")]),
    ("font-block", "<style>@font-face{font-display: block; src:url(a)}</style>", [_P + "font-loading"], [(_P + "font-loading", "info", "inline @font-face uses font-display: block which delays text rendering")]),
    ("font-swap", "<style>@font-face{font-display:swap}</style>", [_P + "font-loading", _P + "excessive-webfonts"], []),
    ("fonts", "<style>" + "@font-face{font-display:swap}" * 5 + "</style>", [_P + "excessive-webfonts"], [(_P + "excessive-webfonts", "warning", "page has 5 @font-face declarations in inline styles, maximum recommended is 4")]),
    ("origins", "".join(f"<script src=https://h{k}.example/a.js></script>" for k in range(6)) + f"<script src={SITE}/own.js></script>", [_P + "excessive-third-party"],
     [(_P + "excessive-third-party", "warning", "page loads scripts from 6 external origins, maximum recommended is 5")]),
    ("five-origins", "".join(f"<script src=https://h{k}.example/a.js></script>" for k in range(5)), [_P + "excessive-third-party"], []),
    ("nodes", "<html><head></head><body>" + "<i></i>" * 1498 + "</body></html>", [_P + "excessive-dom-size"], [(_P + "excessive-dom-size", "warning", "DOM has 1501 element nodes, maximum recommended is 1500")]),
    ("fewer-nodes", "<html><head></head><body>" + "<i></i>" * 1497 + "</body></html>", [_P + "excessive-dom-size"], []),
    ("inline", "<script>" + "x" * 30_000 + "</script><style>" + "y" * 21_201 + "</style>", [_P + "inline-bloat"], [(_P + "inline-bloat", "info", "total inline <script> and <style> content is 51201 bytes (50 KB), maximum recommended is 51200 bytes")]),
    ("less-inline", "<script>" + "x" * 51_200 + "</script>", [_P + "inline-bloat"], []),
    ("no-cache", "x", [_P + "missing-cache-headers"], [(_P + "missing-cache-headers", "warning", "response has no Cache-Control header")]),
    ("cache", {"body": "x", "headers": {"cache-control": ["max-age=60"]}}, [_P + "missing-cache-headers"], []),
    ("loose", "<script>var  a;\n\n\n    b()</script>", [_P + "unminified-resources"], [(_P + "unminified-resources", "info", "inline <script> appears to contain unminified code")]),
    ("commented", "<script>/* a long comment */b()</script>", [_P + "unminified-resources"], [(_P + "unminified-resources", "info", "inline <script> appears to contain unminified code")]),
    ("tight", "<script>var a;b()</script>", [_P + "unminified-resources"], []),
    ("http1", "x", [_P + "no-http2"], [(_P + "no-http2", "info", "no Alt-Svc header indicating HTTP/2 or HTTP/3 support detected")]),
    ("http3", {"body": "x", "headers": {"alt-svc": ['h3=":443"']}}, [_P + "no-http2"], []),
]

# --- accessibility ----------------------------------------------------------------------------

_A = "accessibility/"
_LABEL = (_A + "missing-form-label", "warning", "input element is missing an associated label")
_SKIP = (_A + "missing-skip-nav", "info", "page is missing a skip navigation link")
ACCESSIBILITY = [
    ("input", "<input type=text><input type=hidden><input type=submit><input type=image>", [_LABEL[0]], [_LABEL]),
    ("labelled", "<label for=a>A</label><input id=a><label>B<input></label><input aria-label=c><input aria-labelledby=d>", [_LABEL[0]], []),
    ("two-inputs", "<label for=a>A</label><input id=b><input aria-label=' '>", [_LABEL[0]], [_LABEL, _LABEL]),
    ("empty-link", "<a href=/x></a><a href=/y>y</a><a href=/z aria-label=z></a><a href=/i><img alt=i src=/i></a><a href=/j><img alt='' src=/j></a>", [_A + "empty-link"], [(_A + "empty-link", "warning", "anchor element has no accessible text")] * 2),
    ("skip-nav", "<a href='#main'>skip</a><a href=/x>x</a>", [_SKIP[0]], []),
    ("skip-nav-too-late", "<a href=/1>1</a><a href=/2>2</a><a href=/3>3</a><a href='#main'>skip</a>", [_SKIP[0]], [_SKIP]),
    ("hash-only", "<a href='#'>top</a>", [_SKIP[0]], [_SKIP]),
    ("headings", "<h1>a</h1><h3>b</h3><h2>c</h2><h5>d</h5>", [_A + "heading-hierarchy"], [(_A + "heading-hierarchy", "warning", "heading level skips from h1 to h3"), (_A + "heading-hierarchy", "warning", "heading level skips from h2 to h5")]),
    ("good-headings", "<h1>a</h1><h2>b</h2><h3>c</h3><h1>d</h1>", [_A + "heading-hierarchy"], []),
    ("button", "<button></button><button>ok</button><button aria-label=x></button>", [_A + "missing-button-text"], [(_A + "missing-button-text", "warning", "button element has no accessible text")]),
    ("table", "<table><tr><td>1</td></tr></table><table><tr><th>h</th></tr></table>", [_A + "missing-table-header"], [(_A + "missing-table-header", "info", "table element is missing header cells (<th>)")]),
    ("figure", "<figure><img src=/a></figure><figure><img src=/b alt=b></figure><figure><img src=/c><figcaption>c</figcaption></figure>", [_A + "missing-img-alt-in-figure"],
     [(_A + "missing-img-alt-in-figure", "warning", "image inside <figure> has no alt text and no <figcaption>")]),
    ("tabindex", "<div tabindex=3>x</div><div tabindex=0>y</div><p tabindex=-1>z</p><p tabindex=x>q</p>", [_A + "positive-tabindex"], [(_A + "positive-tabindex", "warning", "element <div> has tabindex=3 which disrupts natural tab order")]),
    ("no-landmark", "<div>x</div><article><header>h</header></article>", [_A + "missing-landmarks"], [(_A + "missing-landmarks", "warning", "page has no ARIA landmark regions")]),
    ("landmark", "<div role=main>x</div>", [_A + "missing-landmarks"], []),
    ("nav", "<nav>x</nav>", [_A + "missing-landmarks"], []),
    ("aria", "<button aria-hidden=true tabindex=1>x</button><div aria-hidden=true tabindex=-1>y</div>", [_A + "invalid-aria"], [(_A + "invalid-aria", "warning", "element <button> has aria-hidden=true with positive tabindex")]),
    ("onclick", "<div onclick=f()>x</div><div onclick=f() role=button>y</div><span onclick=f() tabindex=0>z</span><button onclick=f()>b</button>", [_A + "onclick-without-keyboard"],
     [(_A + "onclick-without-keyboard", "warning", "non-interactive <div> has onclick but no tabindex or role")]),
    ("video", "<video src=/a></video><video><track kind=captions></video><video><track kind=chapters></video>", [_A + "missing-video-captions"],
     [(_A + "missing-video-captions", "warning", "video element is missing captions or subtitles track")] * 2),
    ("autocomplete", "<input type=email><input type=tel autocomplete=tel><input type=text><input type=password>", [_A + "missing-autocomplete"],
     [(_A + "missing-autocomplete", "info", 'input type="email" is missing autocomplete attribute'), (_A + "missing-autocomplete", "info", 'input type="password" is missing autocomplete attribute')]),
]

# --- images, links, languages, text ------------------------------------------------------------

_I = "images/"
_IMG = "alt=a width=1 height=1 srcset=x loading=lazy"
IMAGES = [
    ("alt", f"<img src=/a.webp><img src=/b.webp alt=''><img src=/c.webp {_IMG}>", [_I + "missing-alt"], [(_I + "missing-alt", "warning", "image is missing alt attribute: /a.webp")]),
    ("link-alt", "<a href=/x><img src=/a.webp alt=''></a><img src=/b.webp alt=''><a href=/y><img src=/c.webp alt=c></a>", [_I + "empty-alt-in-link"], [(_I + "empty-alt-in-link", "warning", "image inside link has empty alt attribute: /a.webp")]),
    ("legacy", "<img src=/a.JPG?v=1><img src=/b.webp><img src='/c.gif#x'><img src=/jpg>", [_I + "legacy-format"],
     [(_I + "legacy-format", "info", "image uses legacy format (jpg), consider WebP or AVIF: /a.JPG?v=1"), (_I + "legacy-format", "info", "image uses legacy format (gif), consider WebP or AVIF: /c.gif#x")]),
    ("lazy", "<img src=/1><img src=/2><img src=/3><img src=/4><img src=/5 loading=Lazy><header><img src=/6></header>", [_I + "missing-lazy-loading"], [(_I + "missing-lazy-loading", "info", 'image is missing loading="lazy" attribute: /4')]),
    ("size", "<img src=/a><img src=/b width=1><img src=/c height=1>", [_I + "missing-dimensions"], [(_I + "missing-dimensions", "warning", "image is missing width and height attributes: /a")]),
    ("responsive", "<img src=https://x.example/a><img src=/b><img src=https://x.example/c srcset=x><img src=https://x.example/d sizes=x><img src=https://x.example/e alt='' role=presentation>", [_I + "missing-responsive"],
     [(_I + "missing-responsive", "info", "image is missing srcset and sizes attributes: https://x.example/a")]),
]
LINKS = [
    ("many", "<a href=/x>a</a>" * 101, ["links/excessive-links"], [("links/excessive-links", "info", "page has 101 links, which exceeds the recommended maximum of 100")]),
    ("not-many", "<a href=/x>a</a>" * 100 + "<a>b</a>", ["links/excessive-links"], []),
    ("generic", "<a href=/x> Click Here </a><a href=/y>More</a><a href=/z>more of it</a>", ["links/generic-anchor-text"],
     [("links/generic-anchor-text", "info", 'link has generic anchor text "click here"'), ("links/generic-anchor-text", "info", 'link has generic anchor text "more"')]),
]
_ALT = "<link rel=alternate hreflang={} href=/x>"
HREFLANG = [
    (f"lang-{k}", _ALT.format(v), ["hreflang/invalid-language-code"], [] if ok else [("hreflang/invalid-language-code", "warning", f'hreflang value "{v}" is not a valid BCP 47 language tag')])
    for k, (v, ok) in enumerate([("en", True), ("haw", True), ("en-US", True), ("zh-Hans-CN", True), ("x-default", True), ("EN", False), ("English", False), ("e", False), ("en-", False), ("123", False), ("en_US", False), ("en-USAAA", False)])
] + [
    ("no-default", _ALT.format("en"), ["hreflang/missing-x-default"], [("hreflang/missing-x-default", "info", "page has hreflang annotations but no x-default")]),
    ("default", _ALT.format("en") + _ALT.format("x-default"), ["hreflang/missing-x-default"], []),
    ("no-hreflang", "<p>x", ["hreflang/missing-x-default"], []),
]
_C = "content/"
CONTENT = [
    ("ratio", "<html><body><div class='" + "x" * 480 + "'>0123456789</div></body></html>", [_C + "low-text-ratio"], [(_C + "low-text-ratio", "info", "text-to-HTML ratio is 1.9%, minimum recommended is 10%")]),
    ("text", "<p>" + "word " * 30, [_C + "low-text-ratio", _C + "no-paragraphs"], []),
    ("no-p", "<div>x</div>", [_C + "no-paragraphs"], [(_C + "no-paragraphs", "info", "page contains no <p> tags")]),
    ("blog/short", "<p>three short words</p><script>not words at all</script>", [_C + "word-count-low"], [(_C + "word-count-low", "info", "article page has 3 words, minimum recommended is 300")]),
    ("article", "<article><p>two words</p></article>", [_C + "word-count-low"], [(_C + "word-count-low", "info", "article page has 2 words, minimum recommended is 300")]),
    ("post/long", "<p>" + "word " * 300, [_C + "word-count-low"], []),
    ("page", "<p>x", [_C + "word-count-low"], []),
    ("skip", "<h2>a</h2><h4>b</h4>", [_C + "heading-hierarchy-skip"], [(_C + "heading-hierarchy-skip", "warning", "heading level skips from h2 to h4")]),
    ("empty", "", [_C + "no-paragraphs", _C + "low-text-ratio"], []),
]
_SRI = "security/missing-sri"
SRI = [
    ("own", f"<script src=/a.js></script><script src={SITE}/b.js></script><link rel=stylesheet href=/c.css>", [_SRI], []),
    ("other", "<script src=https://cdn.example/a.js></script><script src=https://cdn.example/b.js integrity=sha384-x></script><link rel=stylesheet href=//cdn.example/c.css>", [_SRI],
     [(_SRI, "info", 'external script "https://cdn.example/a.js" is missing integrity attribute'), (_SRI, "info", 'external stylesheet "//cdn.example/c.css" is missing integrity attribute')]),
]

# --- structured data --------------------------------------------------------------------------


def _ld(*blocks) -> str:
    return "".join(f"<script type='application/ld+json'>{b if isinstance(b, str) else json.dumps(b)}</script>" for b in blocks)


def _org(**more) -> dict:
    return {"@context": "https://schema.org", "@type": "Organization", "name": "n", **more}


_S = "structured-data/"
_OFF = (_S + "not-google-eligible", "info", "Organization is not eligible for Google Rich Results", "@type")
_EVENT = {"@context": "https://schema.org", "@type": "Event", "name": "n", "startDate": "2025-01-02", "location": "x", "endDate": "2025-01-03", "description": "d", "image": "/i"}
STRUCTURED = [
    ("none", "<p>x", [_S + "missing-json-ld"], [(_S + "missing-json-ld", "info", "page has no JSON-LD structured data")]),
    ("some", _ld(_org()), [_S + "missing-json-ld", _S + "malformed-json-ld", _S + "missing-type", _S + "unknown-type", _S + "not-google-eligible"], [_OFF]),
    ("no-context", _ld({"@type": "Organization"}), [_S + "missing-context", _S + "wrong-context"], [(_S + "missing-context", "info", "JSON-LD block has no @context", "@context")]),
    ("slash-context", _ld(_org(**{"@context": "http://schema.org/"})), [_S + "missing-context", _S + "wrong-context"], []),
    ("other-context", _ld(_org(**{"@context": "https://other.example"})), [_S + "wrong-context"], [(_S + "wrong-context", "warning", "@context does not point to schema.org: https://other.example", "@context")]),
    ("vocab-context", _ld(_org(**{"@context": {"@vocab": "https://other.example/"}})), [_S + "wrong-context"], [(_S + "wrong-context", "warning", "@context @vocab does not point to schema.org: https://other.example/", "@context.@vocab")]),
    ("array-context", _ld(_org(**{"@context": ["https://other.example"]}), _org(**{"@context": ["https://other.example", "https://schema.org"]})), [_S + "wrong-context"],
     [(_S + "wrong-context", "warning", "@context array does not contain a schema.org reference", "@context")]),
    ("no-type", _ld({"@context": "https://schema.org", "name": "n"}), [_S + "missing-type"], [(_S + "missing-type", "warning", "JSON-LD block has no @type field", "@type")]),
    ("odd-type", _ld(_org(**{"@type": ["Organization", "Gadget"]})), [_S + "unknown-type"], [(_S + "unknown-type", "info", 'JSON-LD @type "Gadget" is not a commonly recognised Schema.org type', "@type")]),
    ("required", _ld({"@context": "https://schema.org", "@type": "Event", "name": "n"}), [_S + "missing-required-field"],
     [(_S + "missing-required-field", "warning", f'Event is missing required field "{f}"', f) for f in ("startDate", "location")]),
    ("graph", _ld({"@context": "https://schema.org", "@graph": [{"@type": "Dataset", "name": "n"}, {"name": "x"}]}), [_S + "missing-required-field", _S + "missing-type"],
     [(_S + "missing-required-field", "warning", 'Dataset is missing required field "description"', "description"), (_S + "missing-type", "warning", "JSON-LD block has no @type field", "@type")]),
    ("dates", _ld({**_EVENT, "startDate": "soon", "endDate": 5}), [_S + "invalid-date-format"],
     [(_S + "invalid-date-format", "warning", 'JSON-LD field "startDate" has invalid date value "soon"; expected ISO 8601 format (YYYY-MM-DD)', "startDate"),
      (_S + "invalid-date-format", "warning", 'JSON-LD field "endDate" has a non-string value; expected ISO 8601 date', "endDate")]),
    ("date-times", _ld({**_EVENT, "startDate": "2025-02-28T10:00:00Z", "endDate": "2025-02-30"}), [_S + "invalid-date-format"],
     [(_S + "invalid-date-format", "warning", 'JSON-LD field "endDate" has invalid date value "2025-02-30"; expected ISO 8601 format (YYYY-MM-DD)', "endDate")]),
    ("addresses", _ld(_org(url="site.example", logo={"@type": "ImageObject", "url": "/l"}, sameAs=["https://a.example", "ftp://b.example"])), [_S + "invalid-url-field"],
     [(_S + "invalid-url-field", "warning", 'JSON-LD field "url" has invalid URL value "site.example"; expected http://, https://, or /', "url"),
      (_S + "invalid-url-field", "warning", 'JSON-LD field "sameAs" has invalid URL value "ftp://b.example"; expected http://, https://, or /', "sameAs")]),
    ("number-address", _ld(_org(url=7)), [_S + "invalid-url-field"], [(_S + "invalid-url-field", "warning", 'JSON-LD field "url" has a non-string/non-array value; expected a URL', "url")]),
    ("enumeration", _ld({**_EVENT, "eventStatus": "Maybe"}, {"@context": "https://schema.org", "@type": "Offer", "availability": "InStock"}), [_S + "invalid-enum-value"],
     [(_S + "invalid-enum-value", "warning", 'JSON-LD field "eventStatus" has value "Maybe"; expected one of: EventScheduled, EventCancelled, EventMovedOnline, EventPostponed, EventRescheduled', "eventStatus")]),
    ("nested", _ld({**_EVENT, "location": {"@type": "Person", "url": "x"}}), [_S + "invalid-nested-type", _S + "invalid-url-field"],
     [(_S + "invalid-nested-type", "warning", 'JSON-LD field "location" has nested @type "Person"; expected one of: Place, VirtualLocation', "location.@type"),
      (_S + "invalid-url-field", "warning", 'JSON-LD field "url" has invalid URL value "x"; expected http://, https://, or /', "location.url")]),
    ("rich", _ld({"@context": "https://schema.org", "@type": "Course", "name": "n"}), [_S + "google-missing-required", _S + "google-missing-recommended", _S + "not-google-eligible"],
     [(_S + "google-missing-required", "warning", "Google Rich Results: Course is missing required fields: description, provider", "@type"),
      (_S + "google-missing-recommended", "info", "Google Rich Results: Course is missing recommended fields: aggregateRating, offers", "@type")]),
    ("complete", _ld(_EVENT), [_S + "google-missing-required", _S + "google-missing-recommended", _S + "missing-required-field"], []),
    ("twice", _ld(_org(), {**_org(), "name": "m"}), [_S + "duplicate-type"], [(_S + "duplicate-type", "info", 'multiple JSON-LD blocks declare @type "Organization" (2 occurrences)')]),
    ("breadcrumbs", _ld({"@context": "https://schema.org", "@type": "BreadcrumbList", "itemListElement": [{"@type": "ListItem", "position": 1}, {"@type": "ListItem", "position": 3}, {"@type": "ListItem", "position": 9}]}), [_S + "breadcrumb-positions"],
     [(_S + "breadcrumb-positions", "warning", "BreadcrumbList item at index 1 has position 3; expected 2")]),
    ("search", _ld({"@context": "https://schema.org", "@type": "WebSite", "potentialAction": {"@type": "SearchAction", "target": {"@type": "EntryPoint", "urlTemplate": "/s?q=x"}}}), [_S + "search-action-template"],
     [(_S + "search-action-template", "warning", "WebSite SearchAction target is missing {search_term_string} template variable")]),
    ("good-search", _ld({"@context": "https://schema.org", "@type": "WebSite", "potentialAction": {"@type": "SearchAction", "target": "/s?q={search_term_string}"}}), [_S + "search-action-template"], []),
    ("microdata", "<div itemscope itemtype=x>y</div>", [_S + "microdata-detected"], [(_S + "microdata-detected", "info", 'HTML contains microdata attribute "itemscope"; consider migrating to JSON-LD for better tooling support')]),
]

GROUPS = {
    "seo": (SEO, seo.checks), "performance": (PERFORMANCE, performance.checks), "accessibility": (ACCESSIBILITY, accessibility.checks), "images": (IMAGES, media.images), "links": (LINKS, media.links),
    "hreflang": (HREFLANG, media.hreflang), "content": (CONTENT, media.content), "sri": (SRI, security.checks), "structured_data": (STRUCTURED, media.structured_data),
}
QUERIES = {f"cases_{name}": _issue_query(cases, check) for name, (cases, check) in GROUPS.items()}
SQL = {f"cases_{name}": _issue_sql(cases) for name, (cases, _) in GROUPS.items()}
