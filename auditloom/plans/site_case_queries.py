"""Queries over small probe tables built here: site-wide checks, probes, sources, reports and settings, each with its expected rows as SQL."""

from __future__ import annotations

import datetime
import gzip
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.features import with_features
from auditloom.model import ISSUE, LINK_PROBE, TLS_PROBE
from auditloom.plans.case_queries import ISSUE_NAMES, SITE, case_pages, values_sql
from auditloom.session import scratch
from auditloom.site import classify, duplicates, graph, links, redirects
from auditloom.sources import crawl, robots


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- sites ------------------------------------------------------------------------------------

_E = "https://e.example"
_LANGS = [  # seq, url, language links
    (1, f"{_E}/en", [("en", f"{_E}/en"), ("fr", f"{_E}/fr/")]),
    (2, f"{_E}/fr", [("fr", f"{_E}/fr/"), ("en", f"{_E}/en/")]),
    (3, f"{_E}/de", [("en", f"{_E}/en")]),
    (4, f"{_E}/es", [("es", f"{_E}/es"), ("it", f"{_E}/it"), ("xx", f"{_E}/unknown")]),
    (5, f"{_E}/it", [("it", f"{_E}/it"), ("es", f"{_E}/es")]),
    (6, f"{_E}/it", [("it", f"{_E}/it")]),  # fetched again: the last one counts
    (7, f"{_E}/none", []),
]


def cases_hreflang_site(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, [(s, u, [tuple(x) for x in h]) for s, u, h in _LANGS], "seq long, url string, hreflang array<struct<lang:string,href:string>>")
    return links.hreflang_site(df).select(*ISSUE_NAMES)


_BACK = "page has hreflang pointing to {}, but that page does not link back"
_HREFLANG_ROWS = [
    (f"{_E}/de", "hreflang/missing-return-link", "warning", _BACK.format(f"{_E}/en"), ""),
    (f"{_E}/de", "hreflang/self-reference-missing", "info", "page has hreflang annotations but does not include itself", ""),
    (f"{_E}/es", "hreflang/missing-return-link", "warning", _BACK.format(f"{_E}/it"), ""),
]

_NOINDEX = [
    ("listed", {"body": "<meta name=robots content='NoIndex,follow'>", "in_sitemap": True}), ("unlisted", {"body": "<meta name=robots content=noindex>"}),
    ("indexed", {"body": "<meta name=robots content=index>", "in_sitemap": True}), ("plain", {"body": "noindex", "in_sitemap": True, "content_type": "text/plain"}),
]


def cases_noindex_in_sitemap(spark: SparkSession, d: str) -> DataFrame:
    return links.noindex_in_sitemap(with_features(case_pages(spark, _NOINDEX))).select(*ISSUE_NAMES)


_OUT = "https://out.example"
_LINKERS = [
    ("a", {"links": [f"{_OUT}/gone", f"{_OUT}/moved", f"{SITE}/own", f"{_OUT}/gone"], "assets": [f"{_OUT}/late.js"]}), ("b", {"links": [f"{_OUT}/gone", f"{_OUT}/fine", f"{_OUT}/err"]}),
    ("c", {"links": [f"{_OUT}/moved"], "assets": None}), ("d", {"links": None, "assets": [f"{_OUT}/plain30x"]}),
]
_PROBES = [
    (f"{_OUT}/gone", 404, "", 0, False, ""), (f"{_OUT}/moved", 301, f"{_OUT}/new", 0, False, ""), (f"{_OUT}/late.js", 0, "", 0, True, "timeout"), (f"{_OUT}/fine", 200, "", 0, False, ""),
    (f"{_OUT}/err", 0, None, None, None, "no such host"), (f"{_OUT}/plain30x", 304, "", 0, False, ""),
]


def cases_external_links(spark: SparkSession, d: str) -> DataFrame:
    pages = case_pages(spark, _LINKERS)
    return links.external_issues(links.external_targets(pages), _rows(spark, _PROBES, LINK_PROBE)).select(*ISSUE_NAMES)


_FROM = "linked from: "
_EXTERNAL_ROWS = [
    (f"{_OUT}/gone", "external-links/broken", "warning", "external link returned HTTP 404", f"{_FROM}{SITE}/a, {SITE}/b"),
    (f"{_OUT}/moved", "external-links/redirect", "info", "external link redirects (HTTP 301)", f"redirects to: {_OUT}/new; {_FROM}{SITE}/a, {SITE}/c"),
    (f"{_OUT}/late.js", "external-links/timeout", "info", "external link timed out", f"{_FROM}{SITE}/a"),
    (f"{_OUT}/err", "external-links/broken", "warning", "external link returned error: no such host", f"{_FROM}{SITE}/b"),
]

_PICTURES = [("one", f"<img src={_OUT}/gone.png><img src={_OUT}/big.png><img src={_OUT}/fine.png><img src=/own.png><img src={_OUT}/edge.png>"), ("two", f"<img src={_OUT}/gone.png>")]
_PICTURE_PROBES = [(f"{_OUT}/gone.png", 404, "", 600_000, False, ""), (f"{_OUT}/big.png", 200, "", 512_001, False, ""), (f"{_OUT}/fine.png", 200, "", 10, False, ""), (f"{_OUT}/edge.png", 200, "", 512_000, False, "")]


def cases_image_probes(spark: SparkSession, d: str) -> DataFrame:
    return links.image_probe_issues(with_features(case_pages(spark, _PICTURES)), _rows(spark, _PICTURE_PROBES, LINK_PROBE)).select(*ISSUE_NAMES)


_IMAGE_ROWS = [
    (f"{SITE}/one", "images/broken-src", "critical", f"image returned HTTP 404: {_OUT}/gone.png", ""), (f"{SITE}/two", "images/broken-src", "critical", f"image returned HTTP 404: {_OUT}/gone.png", ""),
    (f"{SITE}/one", "images/large-image", "warning", f"image is 512001 bytes (500 KB): {_OUT}/big.png", ""),
]

_NOW = datetime.datetime(2025, 3, 1)
_HOSTS = [  # host, version, days left, issuer, subject, ids, names
    ("good", 0x0304, 400, "ca", "good", (b"a", b"b"), ["good.example"]), ("old", 0x0301, 400, "ca", "old", (b"a", b"b"), ["OLD.example"]), ("odd", 0x0299, 400, "ca", "odd", (b"a", b"b"), ["odd.example"]),
    ("expired", 0x0303, -2, "ca", "x", (b"a", b"b"), ["expired.example"]), ("soon", 0x0303, 10, "ca", "x", (b"a", b"b"), ["*.example"]), ("edge", 0x0303, 30, "ca", "x", (b"a", b"b"), ["edge.example"]),
    ("self", 0x0303, 400, "me", "me", (b"a", b"a"), ["self.example"]), ("root", 0x0303, 400, "me", "me", (b"a", b"b"), ["root.example"]), ("wrong", 0x0303, 400, "ca", "x", (b"a", b"b"), ["a.example", "*.b.example"]),
]


def cases_tls(spark: SparkSession, d: str) -> DataFrame:
    pages = case_pages(spark, [(h[0], {"url": f"https://{h[0]}.example/p"}) for h in _HOSTS] + [("http", {"url": "http://expired.example/q"}), ("unfetched", {"url": "https://expired.example/r", "status_code": 0})])
    probes = [(f"{n}.example", v, _NOW + datetime.timedelta(days=left), i, s, *ids, names) for n, v, left, i, s, ids, names in _HOSTS]
    return links.tls_issues(pages, _rows(spark, probes, TLS_PROBE), F.lit(_NOW)).select(*ISSUE_NAMES)


_TLS_ROWS = [
    ("https://old.example/p", "tls/weak-protocol", "warning", "server negotiated TLS 1.0, minimum recommended is TLS 1.2", ""),
    ("https://odd.example/p", "tls/weak-protocol", "warning", "server negotiated unknown (0x0299), minimum recommended is TLS 1.2", ""),
    ("https://expired.example/p", "tls/certificate-expired", "critical", "certificate expired on 2025-02-27", ""),
    ("https://soon.example/p", "tls/certificate-expiring-soon", "warning", "certificate expires in 10 days (2025-03-11)", ""),
    ("https://self.example/p", "tls/self-signed", "warning", "certificate is self-signed", ""),
    ("https://wrong.example/p", "tls/hostname-mismatch", "critical", 'certificate does not match hostname "wrong.example": it is valid for a.example, *.b.example', ""),
]

_WORDS = " ".join(f"w{i}" for i in range(200))
_COPIES = [("1", _WORDS), ("2", _WORDS + " "), ("3", _WORDS), ("4", _WORDS), ("5", "few words"), ("6", {"body": None})]


def cases_duplicates(spark: SparkSession, d: str) -> DataFrame:
    c = duplicates.body_classes(case_pages(spark, _COPIES).withColumn("text", F.trim(F.coalesce("body", F.lit("")))), url="url")
    return links.union_issues(duplicates.exact_issues(c, all_pairs=True), duplicates.near_issues(c, all_pairs=True), duplicates.thin_issues(c)).select(*ISSUE_NAMES)


_COPY = "page is an exact duplicate of "
_COPY_ROWS = [
    (f"{SITE}/1", "content/exact-duplicate", "warning", f"{_COPY}{SITE}/3", ""), (f"{SITE}/1", "content/exact-duplicate", "warning", f"{_COPY}{SITE}/4", ""), (f"{SITE}/3", "content/exact-duplicate", "warning", f"{_COPY}{SITE}/4", ""),
    *[(f"{SITE}/{a}", "content/near-duplicate", "info", f"page is near-duplicate of {SITE}/{b} (similarity: 100%)", "") for a, b in ((1, 2), (2, 3), (2, 4))],
    (f"{SITE}/5", "content/thin-content", "info", "page has only 2 words of text content", ""), (f"{SITE}/6", "content/thin-content", "info", "page has only 0 words of text content", ""),
]

_TECH = [
    ("first", {"body": "<meta name=\"generator\" content=\"WordPress 6\"><div data-v-1></div>", "assets": ["https://x.example/_NEXT/a.js", "/css/Bootstrap.min.css"], "headers": {"server": ["Cloudflare"]}}),
    ("second", {"body": "gatsby- googletagmanager.com", "headers": {"x-vercel-id": ["1"], "server": ["netlify"]}}),
]


def cases_technologies(spark: SparkSession, d: str) -> DataFrame:
    return classify.technologies(case_pages(spark, _TECH))


_TECH_ROWS = [
    ("Cloudflare", "cdn", "header server contains cloudflare"), ("Netlify", "cdn", "header server contains netlify"), ("Vercel", "cdn", "header x-vercel-id present"), ("Next.js", "cms", "asset URL contains /_next/"),
    ("WordPress", "cms", 'body contains <meta name="generator" content="WordPress'), ("Bootstrap", "framework", "asset URL contains bootstrap"), ("Vue", "framework", "body contains data-v-"),
]

_GRAPH = [("", {"url": SITE, "links": [f"{SITE}/a", f"{SITE}/b", f"{SITE}/a", SITE]}), ("a", {"links": [f"{SITE}/b", "https://else.example/"]}), ("b", {"links": None})]


def cases_graph_export(spark: SparkSession, d: str) -> DataFrame:
    n, e = graph.graph(case_pages(spark, _GRAPH))
    dot = [("dot", k, line) for k, line in enumerate(graph.export_dot(n, e).rstrip("\n").split("\n"))]
    js = json.loads(graph.export_json(n, e))
    rows = [("json node", k, x["url"]) for k, x in enumerate(js["nodes"])] + [("json edge", k, f"{x['from']} {x['to']}") for k, x in enumerate(js["edges"])]
    return _rows(spark, dot + rows, "part string, n int, line string")


_GRAPH_ROWS = [("dot", k, x) for k, x in enumerate([
    "digraph linkgraph {", "  rankdir=LR;", f'  "{SITE}" [label="site.example"];', f'  "{SITE}/a" [label="/a"];', f'  "{SITE}/b" [label="/b"];',
    f'  "{SITE}" -> "{SITE}/a";', f'  "{SITE}" -> "{SITE}/a";', f'  "{SITE}" -> "{SITE}/b";', f'  "{SITE}/a" -> "{SITE}/b";', "}",
])] + [("json node", k, x) for k, x in enumerate([SITE, f"{SITE}/a", f"{SITE}/b"])] + [("json edge", k, x) for k, x in enumerate([f"{SITE} {SITE}/a", f"{SITE} {SITE}/a", f"{SITE} {SITE}/b", f"{SITE}/a {SITE}/b"])]


# --- sources ----------------------------------------------------------------------------------


def _sources() -> list[tuple[str, str, str]]:
    from auditloom.functions import dom
    from auditloom.report.writers import safe_cell, safe_markdown, score_percent
    from auditloom.schema.validate import is_date, is_url

    out: list[tuple[str, str, str]] = []

    def say(what, fn, *items):
        for x in items:
            try:
                v = fn(x)
            except ValueError as e:
                v = f"error {type(e).__name__}"
            out.append((what, str(x), json.dumps(v, ensure_ascii=False)))

    say("normalise", crawl.normalise_url, "x.example", "http://x.example", "ftp://x.example")
    say("safe", crawl.is_safe_url, "http://127.0.0.1/", "http://10.1.2.3/", "http://192.168.0.1/", "http://169.254.169.254/", "http://[::1]/", "http://8.8.8.8/", "http:///x")
    say("resolve", lambda r: dom.resolve("https://x.example/a/b?c", r), "d", "/d#e", "?q", "//y.example/z", "#top", "mailto:a@b", "JavaScript:x", "tel:1", "data:x", "")
    say("links", lambda b: dom.links_and_assets(b, "https://x.example/"), "<a href=/1>x</a><A HREF='2#f'>y</a><a>z</a><img src=/i><link href=/l><script src=/s></script>", "<!-- <a href=/no> --><script>'<a href=/no>'</script><a href=/yes>")
    say("sitemap", lambda x: crawl.parse_sitemap(x.encode()), "<urlset><url><loc> https://x.example/1 </loc></url><url><loc>https://x.example/2</loc></url></urlset>", "<sitemapindex><sitemap><loc>https://x.example/s.xml</loc></sitemap></sitemapindex>", "not xml")
    say("packed sitemap", lambda x: crawl.parse_sitemap(gzip.compress(x.encode())), "<urlset><url><loc>https://x.example/1</loc></url></urlset>")
    files = {"/s.xml": "<sitemapindex><sitemap><loc>https://x.example/t.xml</loc></sitemap><sitemap><loc>https://y.example/no.xml</loc></sitemap></sitemapindex>", "/t.xml": "<urlset><url><loc>https://x.example/1</loc></url><url><loc>https://y.example/2</loc></url></urlset>"}
    say("nested sitemap", lambda u: crawl.sitemap_urls(u, lambda x: files.get(x.removeprefix("https://x.example"), "").encode()), "https://x.example/s.xml")
    say("gunzip", lambda t: crawl.gunzip(gzip.compress(t.encode()), 5).decode(), "hello world")
    say("robots", lambda t: robots.parse_robots(t, "auditloom/1.0"), "User-agent: *\nDisallow: /a*b$\nAllow: /a # yes\nUser-agent: other\nDisallow: /", "User-agent: AuditLoom\nUser-agent: x\nDisallow: /own\nUser-agent: *\nDisallow: /all", "Disallow: /no-group")
    say("robots files", lambda u: crawl.robots_files([u], lambda x: {"status_code": 200 if "ok" in x else 404, "body": x}), "https://ok.example/x", "gone.example")
    api = {"lighthouseResult": {"categories": {"performance": {"score": 0.5}, "seo": {"score": 1}, "accessibility": {"score": None}}}}
    say("lighthouse", lambda m: crawl.lighthouse_runner(m)(json.dumps(api), "u"), "psi", "browserless", "other")
    say("date", is_date, "2025-02-28", "2025-02-30", "2025-02-28T10:00", "25-1-1")
    say("address", is_url, "/x", "https://x", "x.example")
    say("cell", safe_cell, "=1+1", "@x", "-1", "plain")
    say("markdown", safe_markdown, "a|b_c", "[x](y)\nz")
    say("percent", lambda s: score_percent(float(s)), "0.42", "1", "87.9")
    return out


_SOURCE_ROWS = [
    ("normalise", "x.example", '"https://x.example"'), ("normalise", "http://x.example", '"http://x.example"'), ("normalise", "ftp://x.example", '"ftp://x.example"'),
    *[("safe", f"http://{h}/", "false") for h in ("127.0.0.1", "10.1.2.3", "192.168.0.1", "169.254.169.254", "[::1]")], ("safe", "http://8.8.8.8/", "true"), ("safe", "http:///x", "false"),
    ("resolve", "d", '"https://x.example/a/d"'), ("resolve", "/d#e", '"https://x.example/d"'), ("resolve", "?q", '"https://x.example/a/b?q"'), ("resolve", "//y.example/z", '"https://y.example/z"'), ("resolve", "#top", '"https://x.example/a/b?c"'),
    *[("resolve", x, "null") for x in ("mailto:a@b", "JavaScript:x", "tel:1", "data:x", "")],
    ("links", "<a href=/1>x</a><A HREF='2#f'>y</a><a>z</a><img src=/i><link href=/l><script src=/s></script>", '[["https://x.example/1", "https://x.example/2"], ["https://x.example/i", "https://x.example/l", "https://x.example/s"]]'),
    ("links", "<!-- <a href=/no> --><script>'<a href=/no>'</script><a href=/yes>", '[["https://x.example/yes"], []]'),
    ("sitemap", "<urlset><url><loc> https://x.example/1 </loc></url><url><loc>https://x.example/2</loc></url></urlset>", '[["https://x.example/1", "https://x.example/2"], []]'),
    ("sitemap", "<sitemapindex><sitemap><loc>https://x.example/s.xml</loc></sitemap></sitemapindex>", '[[], ["https://x.example/s.xml"]]'), ("sitemap", "not xml", "[[], []]"),
    ("packed sitemap", "<urlset><url><loc>https://x.example/1</loc></url></urlset>", '[["https://x.example/1"], []]'), ("nested sitemap", "https://x.example/s.xml", '["https://x.example/1"]'), ("gunzip", "hello world", '"hello"'),
    ("robots", "User-agent: *\nDisallow: /a*b$\nAllow: /a # yes\nUser-agent: other\nDisallow: /", '[["/a*b$", false, "^/a.*b$"], ["/a", true, "^/a"]]'),
    ("robots", "User-agent: AuditLoom\nUser-agent: x\nDisallow: /own\nUser-agent: *\nDisallow: /all", '[["/own", false, "^/own"]]'), ("robots", "Disallow: /no-group", "[]"),
    ("robots files", "https://ok.example/x", '[["ok.example", "https://ok.example/robots.txt"]]'), ("robots files", "gone.example", '[["gone.example", ""]]'),
    *[("lighthouse", m, json.dumps({"url": "u", "performance_score": 50.0, "accessibility_score": 0.0, "best_practices_score": 0.0, "seo_score": 100.0, "source": m})) for m in ("psi", "browserless")], ("lighthouse", "other", '"error ValueError"'),
    ("date", "2025-02-28", "true"), ("date", "2025-02-30", "false"), ("date", "2025-02-28T10:00", "true"), ("date", "25-1-1", "false"), ("address", "/x", "true"), ("address", "https://x", "true"), ("address", "x.example", "false"),
    ("cell", "=1+1", '"\\t=1+1"'), ("cell", "@x", '"\\t@x"'), ("cell", "-1", '"\\t-1"'), ("cell", "plain", '"plain"'), ("markdown", "a|b_c", '"a\\\\|b\\\\_c"'), ("markdown", "[x](y)\nz", '"\\\\[x\\\\](y) z"'),
    ("percent", "0.42", "42"), ("percent", "1", "100"), ("percent", "87.9", "87"),
]


def cases_sources(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, _sources(), "what string, given string, result string")


def cases_url_file(spark: SparkSession, d: str) -> DataFrame:
    """A URL file written to the shared folder and read back."""
    at = scratch(spark)
    _rows(spark, [("# list\r\nhttps://x.example/1\n\n  https://x.example/2  \n#no\nx.example/3\n",)], "value string").coalesce(1).write.text(at)
    return crawl.read_url_file(spark, at)


def cases_frontier(spark: SparkSession, d: str) -> DataFrame:
    """What a frontier takes: unseen, of the host, allowed paths, first places first, up to the cap; saved and loaded again."""
    seen = _rows(spark, [(SITE, 0, 0), (f"{SITE}/seen", 1, 1)], "url string, depth int, seq long")
    asked = ["/b/1", "/seen", "/b/2", "/b/1", "/a/3", "/b/skip", "/b/c/4", "/b/5", "/b/6"]
    found = _rows(spark, [(SITE + p, 2, k) for k, p in enumerate(asked)] + [("https://else.example/b/7", 2, 0), (f"{SITE}/b/deep", 9, 0)], "url string, depth int, seq long")
    new = crawl.add_to_frontier(seen, found, SITE, 5, 3, ["/b/*"], ["/b/skip"])
    at = scratch(spark)
    crawl.save_frontier(seen.unionByName(new), new, at, SITE)
    return crawl.load_frontier(spark, at).select("url", "depth", "seq", "state")


_FRONTIER_ROWS = [(SITE, 0, 0, "seen"), (f"{SITE}/seen", 1, 1, "seen"), (f"{SITE}/b/1", 2, 0, "queued"), (f"{SITE}/b/2", 2, 2, "queued"), (f"{SITE}/b/5", 2, 7, "queued")]

_FILES = {  # path: status, headers, body
    "/": (200, {"Content-Type": "text/html; charset=utf-8"}, b"<a href=/one>1</a><a href=/private>2</a><img src=/i.png>"), "/one": (302, {"Location": "/two"}, b""), "/two": (301, {"Location": "/three"}, b""),
    "/three": (200, {"Content-Type": "text/plain"}, b"at the end"), "/packed": (200, {"Content-Type": "text/plain", "Content-Encoding": "gzip"}, gzip.compress(b"unpacked")), "/loop": (302, {"Location": "/loop"}, b""),
    "/gone": (410, {"Content-Type": "text/html"}, b"gone"), "/robots.txt": (200, {"Content-Type": "text/plain"}, b"User-agent: *\nDisallow: /private"), "/private": (200, {"Content-Type": "text/html"}, b"secret"), "/nohead": (200, {}, b"x"),
}


def _served():
    """A server of the files above on this machine, and its address."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, headers, body = _FILES.get(self.path, (404, {}, b""))
            if self.command == "HEAD" and self.path == "/nohead":
                status, body = 405, b""
            self.send_response(status)
            for k, v in {**headers, "Content-Length": str(len(body))}.items():
                self.send_header(k, v)
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        do_HEAD = do_GET

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_address[1]}"


def cases_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Fetches, redirects, packed bodies, robots and link probes against a server of this process."""
    server, at = _served()
    rows = []
    try:
        for path in ("/", "/one", "/packed", "/loop", "/gone", "/missing"):
            try:
                p = crawl.fetch_page(at + path, allow_private=True)
                rows.append(("fetch", path, p["status_code"], p["content_type"], ",".join(x.removeprefix(at) for x in p["redirect_chain"]), p["body"]))
            except ValueError:
                rows.append(("fetch", path, 0, "", "", "refused"))
        try:
            crawl.fetch_page(at + "/")
        except ValueError:
            rows.append(("guard", "/", 0, "", "", "refused"))
        for path in ("/gone", "/one", "/nohead", "/three"):
            p = crawl.probe_link(at + path, allow_private=True)
            rows.append(("probe", path, p["status_code"], "", p["location"], p["err"]))
        for host, text in crawl.robots_files([at], lambda u: crawl.fetch_page(u, allow_private=True)):
            rules = robots.parse_robots(text, "auditloom/1.0")
            rows += [("robots", p, 0, "", "", "allow" if allow else "disallow") for p, allow, _ in rules]
    finally:
        server.shutdown()
    return _rows(spark, rows, "what string, path string, status int, content_type string, chain string, body string")


_FETCH_ROWS = [
    ("fetch", "/", 200, "text/html", "", "<a href=/one>1</a><a href=/private>2</a><img src=/i.png>"), ("fetch", "/one", 200, "text/plain", "/two,/three", "at the end"), ("fetch", "/packed", 200, "text/plain", "", "unpacked"),
    ("fetch", "/loop", 0, "", "", "refused"), ("fetch", "/gone", 410, "text/html", "", "gone"), ("fetch", "/missing", 404, "", "", ""), ("guard", "/", 0, "", "", "refused"),
    ("probe", "/gone", 410, "", "", ""), ("probe", "/one", 302, "", "/two", ""), ("probe", "/nohead", 200, "", "", ""), ("probe", "/three", 200, "", "", ""), ("robots", "/private", 0, "", "", "disallow"),
]

# --- reports and settings ---------------------------------------------------------------------

_FOUND = [  # check, severity, message, url, detail
    ("seo/missing-h1", "warning", "no <h1> & more", f"{SITE}/a", ""), ("health/5xx", "critical", "page returned HTTP 500", f"{SITE}/b", "x|y"), ("seo/url-issues", "info", '=HYPERLINK("x")', f"{SITE}/a", "say \"so\""),
]


def cases_reports(spark: SparkSession, d: str) -> DataFrame:
    """Every report of a few issues, parsed back: ``(format, part, value)``."""
    import csv
    import io
    import re
    from xml.etree import ElementTree

    from auditloom.report.writers import Result, WRITERS, prometheus
    from auditloom.site.summary import exit_code

    issues = _rows(spark, _FOUND, ISSUE)
    score = {"url": f"{SITE}/a", "performance_score": 41.0, "accessibility_score": 90.0, "best_practices_score": 0.5, "seo_score": 100.0}
    result = Result(SITE, issues, 2, "2025-03-01T00:00:00Z", 1_500_000_000, [score])
    text = {k: "".join(w(result)) for k, w in WRITERS.items() if k != "pdf"}
    out: list[tuple[str, str, str]] = []
    add = lambda f, p, v: out.append((f, p, str(v)))
    js = json.loads(text["json"])
    add("json", "seed", js["seed_url"])
    for k, i in enumerate(js["issues"]):
        add("json", f"issue {k}", f"{i['severity']} {i['check_name']} {i['url']} {i['message']} {i.get('detail', '-')}")
    add("json", "summary", json.dumps([js["summary"]["total_issues"], js["summary"]["by_severity"], js["summary"]["by_category"], js["summary"]["top_urls"]], sort_keys=True))
    add("json", "lighthouse", js["lighthouse"][0]["performance_score"])
    for k, line in enumerate(text["jsonl"].splitlines()):
        i = json.loads(line)
        add("jsonl", f"line {k}", i["check_name"] if "check_name" in i else f"{i['type']} {i['issues']} {i['critical']} {i['warning']} {i['info']} {i['duration']}")
    for k, cells in enumerate(csv.reader(io.StringIO(text["csv"]))):
        add("csv", f"line {k}", "|".join(cells))
    for k, line in enumerate(x for x in text["markdown"].splitlines() if x[:2] in ("- ", "##", "| ")):
        add("markdown", f"line {k:02d}", line)
    sarif = json.loads(text["sarif"])
    for k, i in enumerate(sarif["runs"][0]["results"]):
        add("sarif", f"result {k}", f"{i['level']} {i['ruleId']} {i['message']['text']} {i['locations'][0]['physicalLocation']['artifactLocation']['uri']}")
    add("sarif", "rules", ",".join(r["id"] + "=" + r["defaultConfiguration"]["level"] for r in sarif["runs"][0]["tool"]["driver"]["rules"]))
    junit = ElementTree.fromstring(text["junit"])
    add("junit", "suites", f"{junit.get('tests')} {junit.get('failures')} {junit.get('time')}")
    for s in junit:
        for c in s:
            add("junit", f"{s.get('name')} {c.get('name')}", f"{c.get('classname')} {c[0].get('type')} {c[0].get('message')} {c[0].text or '-'}")
    add("html", "rows", len(re.findall(r"<tr class=", text["html"])))
    add("html", "escaped", "no &lt;h1&gt; &amp; more" in text["html"] and "<h1> & more" not in text["html"])
    add("html", "scores", ",".join(re.findall(r"<td>(\d+)</td>", text["html"])))
    for k, line in enumerate(x.strip() for x in text["terminal"].splitlines() if "[" in x):
        add("terminal", f"line {k}", line)
    for line in prometheus(result).splitlines():
        if line[0] != "#":
            add("prometheus", line.rsplit(" ", 1)[0].removeprefix("auditloom_"), line.rsplit(" ", 1)[1])
    for t in ("critical", "warning", "info", "any", "none", ""):
        add("exit", t, exit_code(issues.where("severity <> 'critical'"), t))
    return _rows(spark, out, "format string, part string, value string")


_O = [_FOUND[1], _FOUND[0], _FOUND[2]]  # report order
_REPORT_ROWS = [
    ("json", "seed", SITE), *[("json", f"issue {k}", f"{s} {c} {u} {m} {t or '-'}") for k, (c, s, m, u, t) in enumerate(_O)],
    ("json", "summary", json.dumps([3, {"critical": 1, "warning": 1, "info": 1}, {"health": 1, "seo": 2}, [{"url": f"{SITE}/a", "count": 2}, {"url": f"{SITE}/b", "count": 1}]], sort_keys=True)), ("json", "lighthouse", "41.0"),
    *[("jsonl", f"line {k}", x[0]) for k, x in enumerate(_O)], ("jsonl", "line 3", "summary 3 1 1 1 1.5s"),
    ("csv", "line 0", "url|severity|check|message|detail"), ("csv", "line 1", f"{SITE}/b|critical|health/5xx|page returned HTTP 500|x|y"), ("csv", "line 2", f"{SITE}/a|warning|seo/missing-h1|no <h1> & more|"),
    ("csv", "line 3", f"{SITE}/a|info|seo/url-issues|\t=HYPERLINK(\"x\")|say \"so\""),
    *[("markdown", f"line {k:02d}", x) for k, x in enumerate([
        "## Summary", "| Severity | Count |", "| -------- | ----- |", "| Critical | 1 |", "| Warning | 1 |", "| Info | 1 |", "## Critical Issues", f"- [health/5xx] {SITE}/b: page returned HTTP 500",
        "## Warning Issues", f"- [seo/missing-h1] {SITE}/a: no \\<h1\\> & more", "## Info Issues", f'- [seo/url-issues] {SITE}/a: =HYPERLINK("x")', "## Lighthouse Scores",
        "| URL | Performance | Accessibility | Best Practices | SEO |", "| --- | ----------- | ------------- | -------------- | --- |", f"| {SITE}/a | 41 | 90 | 0 | 100 |",
    ])],
    ("sarif", "result 0", f"error health/5xx page returned HTTP 500: x|y {SITE}/b"), ("sarif", "result 1", f"warning seo/missing-h1 no <h1> & more {SITE}/a"), ("sarif", "result 2", f'note seo/url-issues =HYPERLINK("x"): say "so" {SITE}/a'),
    ("sarif", "rules", "health/5xx=error,seo/missing-h1=warning,seo/url-issues=note"), ("junit", "suites", "3 3 1.500"), ("junit", "health health/5xx", f"{SITE}/b critical page returned HTTP 500 x|y"),
    ("junit", "seo seo/missing-h1", f"{SITE}/a warning no <h1> & more -"), ("junit", "seo seo/url-issues", f'{SITE}/a info =HYPERLINK("x") say "so"'), ("html", "rows", "3"), ("html", "escaped", "True"), ("html", "scores", "41,90,50,100"),
    *[("terminal", f"line {k}", f"[{c}] {u}: {m}") for k, (c, s, m, u, t) in enumerate(_O)],
    *[("prometheus", f'issues_total{{severity="{s}"}}', "1") for s in ("critical", "warning", "info")], ("prometheus", "pages_crawled", "2"), ("prometheus", "crawl_duration_seconds", "1.5"), ("prometheus", "health_score", "86"),
    ("prometheus", 'issues_by_category{category="health"}', "1"), ("prometheus", 'issues_by_category{category="seo"}', "2"),
    ("exit", "critical", "0"), ("exit", "warning", "1"), ("exit", "info", "1"), ("exit", "any", "1"), ("exit", "none", "0"), ("exit", "", "0"),
]


def cases_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings from a file, the environment and flags, and what is refused."""
    import tempfile

    from auditloom.config import Config, dump, load_config, seconds

    rows: list[tuple[str, str]] = []
    with tempfile.NamedTemporaryFile("w", suffix=".yml") as f:
        f.write("crawl:\n  max_depth: 3\n  timeout: 1m30s\n  exclude: ['/x/*']\noutput:\n  formats: [json, csv]\nlighthouse:\n  enabled: true\n")
        f.flush()
        c = load_config(f.name, env={"AUDITLOOM_MAX_PAGES": "7", "AUDITLOOM_MAX_DEPTH": "4", "AUDITLOOM_RESPECT_ROBOTS": "false"}, max_depth=None, fail_on="critical")
    rows += [(n, str(getattr(c, n))) for n in ("max_depth", "max_pages", "request_timeout", "exclude", "output", "lighthouse", "respect_robots", "fail_on", "concurrency")]
    rows.append(("formats", ",".join(c.formats())))
    rows.append(("dumped", next(x for x in dump(c).splitlines() if x.startswith("max_pages")).replace(" ", "")))
    for name, bad in (("max_depth", 0), ("rate_limit", 0), ("request_timeout", 0.0), ("fail_on", "x"), ("log_level", "x"), ("output", "xml"), ("include", ["["])):
        try:
            Config(**{name: bad}).validate()
            rows.append((f"bad {name}", "taken"))
        except ValueError:
            rows.append((f"bad {name}", "refused"))
    rows += [(f"seconds {t}", str(seconds(t))) for t in ("10", "500ms", "1m30s")]
    return _rows(spark, rows, "name string, value string")


_SETTING_ROWS = [
    ("max_depth", "4"), ("max_pages", "7"), ("request_timeout", "90.0"), ("exclude", "['/x/*']"), ("output", "json,csv"), ("lighthouse", "True"), ("respect_robots", "False"), ("fail_on", "critical"), ("concurrency", "10"),
    ("formats", "json,csv"), ("dumped", "max_pages7"), *[(f"bad {n}", "refused") for n in ("max_depth", "rate_limit", "request_timeout", "fail_on", "log_level", "output", "include")],
    ("seconds 10", "10.0"), ("seconds 500ms", "0.5"), ("seconds 1m30s", "90.0"),
]

QUERIES = {f.__name__: f for f in (
    cases_hreflang_site, cases_noindex_in_sitemap, cases_external_links, cases_image_probes, cases_tls, cases_duplicates, cases_technologies, cases_graph_export, cases_sources, cases_url_file, cases_frontier, cases_fetch,
    cases_reports, cases_settings,
)}
SQL = {
    "cases_hreflang_site": values_sql(_HREFLANG_ROWS, ISSUE_NAMES),
    "cases_noindex_in_sitemap": values_sql([(f"{SITE}/listed", "seo/noindex-in-sitemap", "critical", "page has noindex but is included in the sitemap", "")], ISSUE_NAMES),
    "cases_external_links": values_sql(_EXTERNAL_ROWS, ISSUE_NAMES),
    "cases_image_probes": values_sql(_IMAGE_ROWS, ISSUE_NAMES),
    "cases_tls": values_sql(_TLS_ROWS, ISSUE_NAMES),
    "cases_duplicates": values_sql(_COPY_ROWS, ISSUE_NAMES),
    "cases_technologies": values_sql(_TECH_ROWS, ["name", "category", "evidence"]),
    "cases_graph_export": values_sql(_GRAPH_ROWS, ["part", "n", "line"]),
    "cases_sources": values_sql(_SOURCE_ROWS, ["what", "given", "result"]),
    "cases_url_file": values_sql([("https://x.example/1",), ("https://x.example/2",), ("x.example/3",)], ["url"]),
    "cases_frontier": values_sql(_FRONTIER_ROWS, ["url", "depth", "seq", "state"]),
    "cases_fetch": values_sql(_FETCH_ROWS, ["what", "path", "status", "content_type", "chain", "body"]),
    "cases_reports": values_sql(_REPORT_ROWS, ["format", "part", "value"]),
    "cases_settings": values_sql(_SETTING_ROWS, ["name", "value"]),
}
