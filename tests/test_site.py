"""Site-wide analyses, rules, sources, reports and settings."""

from __future__ import annotations

import csv
import json
import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from auditloom.config import load_config, seconds
from auditloom.functions.columns import glob_regex
from auditloom.model import ISSUE, LINK_PROBE, TLS_PROBE
from auditloom.operators.baseline import baseline_diff, load_baseline, save_baseline
from auditloom.report.writers import Result, prometheus, write_issues, write_reports
from auditloom.rules.cel import Rule, RuleError, compile_condition, rule_checks
from auditloom.site import classify, duplicates, graph, links, redirects, summary
from auditloom.sources import crawl, robots
from tests.helpers import NOW, names, pages

U = "https://example.com"


def test_link_checks(spark):
    p = pages(
        spark, {"url": U + "/", "links": [U + "/broken", U + "/broken", U + "/a"]}, {"url": U + "/broken", "status_code": 404, "depth": 1}, {"url": U + "/a", "depth": 1, "links": None},
        {"url": U + "/orphan", "depth": 1}, {"url": U + "/self", "depth": 5, "links": [U + "/self"]},
    )
    b = links.broken_internal(p).collect()
    assert [(r.url, r.message) for r in b] == [(U + "/broken", f"broken internal link (HTTP 404), linked from {U}/")] * 2
    assert [r.url for r in links.orphan_pages(p).collect()] == [U + "/orphan"]
    assert links.deep_pages(p).first().message == "page is at depth 5, maximum recommended is 4"
    t = spark.createDataFrame([(2, "b", " T "), (1, "a", "T"), (3, "c", ""), (4, "d", None)], "seq long, url string, title string")
    r = links.duplicate_titles(t).collect()
    assert [(x.url, x.message) for x in r] == [("a", 'title "T" is shared by 2 pages')]


def test_hreflang_site(spark):
    def e(*hrefs):
        return [("en", h) for h in hrefs]

    rows = [(U + "/en", e(U + "/fr/", U + "/en")), (U + "/fr", e(U + "/en/")), (U + "/de", e(U + "/en", U + "/de"))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, url string, hreflang array<struct<lang:string,href:string>>")
    got = {(r.check_name.split("/")[1], r.url) for r in links.hreflang_site(df).collect()}
    assert got == {("missing-return-link", U + "/de"), ("self-reference-missing", U + "/fr")}


def test_external_and_probes(spark):
    p = pages(spark, {"url": U + "/1", "links": ["https://o.org/a", U + "/x"], "assets": ["https://o.org/b"]}, {"url": U + "/2", "links": ["https://o.org/a", "https://o.org/a"]})
    t = links.external_targets(p)
    assert {r.url: r.sources for r in t.collect()} == {"https://o.org/a": [U + "/1", U + "/2"], "https://o.org/b": [U + "/1"]}
    probe = spark.createDataFrame([("https://o.org/a", 301, "https://z", 0, False, ""), ("https://o.org/b", 500, "", 0, True, "x")], LINK_PROBE)
    got = {r.check_name: r.detail for r in links.external_issues(t, probe).collect()}
    assert got == {"external-links/redirect": f"redirects to: https://z; linked from: {U}/1, {U}/2", "external-links/timeout": f"linked from: {U}/1"}


def test_all_near_pairs_against_each_with_each(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", 3)
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) - (1 << 63) for _ in range(4)]
    rows = []
    for i in range(60):
        b = base[i % 4]
        for k in rnd.sample(range(63), rnd.choice([0, 0, 1, 2, 4])):
            b ^= 1 << k
        rows.append((i, f"u{i}", f"sha{rnd.randrange(40)}" if i % 5 else "one", b, 9))
    bits = lambda x: (x & (1 << 64) - 1).bit_count()
    want = {(a[0], b[0], bits(a[3] ^ b[3])) for a in rows for b in rows if a[0] < b[0] and a[2] != b[2] and bits(a[3] ^ b[3]) <= duplicates.HAMMING}
    df = spark.createDataFrame(rows, "seq long, url string, sha string, sim long, n_words int")
    got = [(r.seq_a, r.seq_b, r.distance) for r in duplicates.all_near_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want) > 100 and duplicates.near_issues(df, all_pairs=True).count() == len(want)


def test_targets_of_very_many_sources_have_more_rows(spark, monkeypatch):
    monkeypatch.setattr(links, "SOURCES", 4)
    monkeypatch.setattr(links._blocks, "__defaults__", (4,))
    p = pages(spark, *[{"url": f"{U}/{i:02d}", "links": ["https://o.org/a"], "redirect_chain": ["https://old.org"] if i == 0 else []} for i in range(30)], {"url": f"{U}/z", "links": ["https://old.org"]})
    rows = links.external_targets(p).where("url = 'https://o.org/a'").collect()
    assert len(rows) > 4 and sorted(x for r in rows for x in r.sources) == [f"{U}/{i:02d}" for i in range(30)] and all(r.sources == sorted(r.sources) for r in rows)


def test_crawl_obeys_robots(spark):
    p = pages(spark, {"url": U, "links": [U + "/open", U + "/shut", U + "/shut/but"]}, {"url": U + "/open", "links": [U + "/shut/2"]}, {"url": U + "/shut", "links": [U + "/behind"]}, {"url": U + "/shut/but"}, {"url": U + "/shut/2"}, {"url": U + "/behind"})
    files = spark.createDataFrame([("example.com", "User-agent: auditloom\nDisallow: /shut\nAllow: /shut/but\n")], "host string, text string")
    got = {r.url for r in crawl.crawl(spark, U, crawl.table_fetcher(p), robots=files).collect()}
    assert got == {U, U + "/open", U + "/shut/but"}
    assert crawl.crawl(spark, U, crawl.table_fetcher(p), robots=files.limit(0)).count() == 6
    assert crawl.crawl(spark, U, crawl.table_fetcher(p), robots=files, agent="other/2").count() == 6
    assert {r.url for r in crawl.crawl(spark, U, crawl.table_fetcher(p), robots=files, max_pages=3).collect()} == {U, U + "/open"}  # what is disallowed counts towards the cap


def test_tls(spark):
    import datetime

    p = pages(spark, {"url": "https://a.org/"}, {"url": "https://b.org/"}, {"url": "http://a.org/"})
    d = datetime.timedelta(days=1)
    probe = spark.createDataFrame([("a.org", 0x0301, NOW - d, "i", "s", None, None, ["*.org"]), ("b.org", 0x0303, NOW + 10 * d, "s", "s", b"1", b"1", ["B.org"])], TLS_PROBE)
    got = {(r.check_name, r.url): r.message for r in links.tls_issues(p, probe, F.lit(NOW)).collect()}
    assert got[("tls/weak-protocol", "https://a.org/")] == "server negotiated TLS 1.0, minimum recommended is TLS 1.2"
    assert got[("tls/certificate-expiring-soon", "https://b.org/")] == "certificate expires in 10 days (2025-03-11)"
    assert {k[0] for k in got if k[1] == "https://a.org/"} == {"tls/weak-protocol", "tls/certificate-expired"}
    assert ("tls/self-signed", "https://b.org/") in got and len(got) == 4


def test_pagerank_against_dense(spark):
    rnd = random.Random(2)
    n = 12
    out = {i: [rnd.randrange(n) for _ in range(rnd.randrange(4))] for i in range(n)}
    p = pages(spark, *[{"url": f"{U}/{i}", "links": [f"{U}/{j}" for j in js] + ["https://other.org/"]} for i, js in out.items()])
    nodes, edges = graph.graph(p)
    got = {r.url: r["rank"] for r in graph.pagerank(nodes, edges).collect()}
    links_ = {i: [j for j in js if j != i] for i, js in out.items()}
    r = [1 / n] * n
    for _ in range(20):
        new = [0.15 / n] * n
        lost = sum(r[i] for i in range(n) if not links_[i])
        for i in range(n):
            for j in links_[i]:
                new[j] += 0.85 * r[i] / len(links_[i])
        r = [x + 0.85 * lost / n for x in new]
    assert abs(sum(got.values()) - 1) < 1e-9 and all(abs(got[f"{U}/{i}"] - r[i]) < 1e-12 for i in range(n))
    low = links.as_issues  # noqa: F841
    assert graph.low_rank_issues(spark.createDataFrame([(u, x) for u, x in got.items()], "url string, rank double")).count() >= 1
    dot = graph.export_dot(nodes, edges)
    assert dot.startswith("digraph linkgraph {") and json.loads(graph.export_json(nodes, edges))["nodes"][0].keys() == {"url"}
    assert graph.pagerank(nodes.limit(0), edges.limit(0)).count() == 0


def test_simhash_and_duplicates(spark):
    def slow(text):
        votes = [0] * 64
        for w in text.split():
            h = 0xCBF29CE484222325
            for b in w.encode():
                h = ((h ^ b) * 0x100000001B3) % 2**64
            for k in range(64):
                votes[k] += 1 if h >> k & 1 else -1
        return sum(1 << k for k in range(64) if votes[k] > 0)

    rnd = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = ["", "", " ".join(base), " ".join(base), " ".join(base + ["zz"]), " ".join(base[:-1] + ["yy"])] + [" ".join(rnd.choices(base, k=120)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, t, f"u{i}") for i, t in enumerate(texts)], "seq long, body string, text string, url string")
    c = duplicates.body_classes(df)
    sims = {r.seq: r.sim % 2**64 for r in c.collect()}
    assert sims == {i: slow(t) for i, t in enumerate(texts)}
    reps = {}  # bodies of one hash are chained, the first stands for them
    for i in range(len(texts)):
        reps.setdefault(sims[i], i)
    want = {(a, b) for a in reps.values() for b in reps.values() if a < b and 0 < (sims[a] ^ sims[b]).bit_count() <= 3}
    got = {(r.seq_a, r.seq_b) for r in duplicates.near_pairs(c).where("distance > 0").collect()}
    assert got == want
    names_ = names(duplicates.duplicate_issues(c))
    assert names_.count("content/exact-duplicate") == 2 and names_.count("content/thin-content") == 2
    assert duplicates.exact_issues(c, all_pairs=True).count() == 2


def test_redirects(spark):
    p = pages(spark, {"url": U + "/new", "redirect_chain": [U + "/old", U + "/mid", U + "/new"]}, {"url": U + "/old", "redirect_chain": [U + "/start"]}, {"url": U + "/x", "links": [U + "/old", U + "/old"]})
    got = sorted((r.check_name.split("/")[1], r.url) for r in redirects.redirect_issues(p).collect())
    assert got == [("internal-redirect", U + "/x"), ("long-chain", U + "/old"), ("redirect-to-redirect", U + "/start")]
    rows = redirects.redirect_csv(p).collect()
    assert [r["from"] for r in rows] == [U + "/old", U + "/start"] and rows[0].linked_by == U + "/x"


def test_budget_and_classes(spark):
    p = pages(spark, {"url": U + "/?a", "depth": 4, "links": ["x"] * 2}, {"url": U + "/b", "in_sitemap": True, "links": None})
    got = {r.check_name.split("/")[1]: r.message for r in summary.crawl_budget_issues(p).collect()}
    assert got == {
        "deep-pages": "1 of 2 pages (50%) are at depth > 3", "parameter-urls": "1 URLs contain query parameters that could waste crawl budget",
        "low-internal-links": "average internal links per page is 1.0, recommended minimum is 3", "large-sitemap-gap": "1 of 2 crawled pages (50%) are not in the sitemap",
    }
    cases = {
        ("/", 0, ""): ("homepage", 0.9), ("/API/x", 1, ""): ("api", 0.9), ("/contact", 1, ""): ("contact", 0.8), ("/about?x", 1, ""): ("about", 0.8), ("/cookie", 1, ""): ("legal", 0.8),
        ("/blog/x", 1, ""): ("blog", 0.7), ("/z", 1, "<ARTICLE>"): ("blog", 0.3), ("/z2", 1, '"@type": "Product"<article'): ("product", 0.5), ("/tag/x", 1, ""): ("category", 0.7), ("/q#/blog/", 1, ""): ("other", 0.0),
    }
    c = classify.classify(pages(spark, *[{"url": U + u, "depth": d, "body": b} for u, d, b in cases])).orderBy("seq").collect()
    assert [(r["class"], r.score) for r in c] == list(cases.values())


def test_technologies(spark):
    p = pages(spark, {"body": "x __next_data__ GTAG(", "assets": ["https://x/Bootstrap.css"]}, {"body": "/wp-content/", "headers": {"cf-ray": ["1"], "server": ["Vercel"]}})
    assert [(r.category, r.name, r.evidence) for r in classify.technologies(p).collect()] == [
        ("analytics", "Google Analytics", "body contains gtag("), ("cdn", "Cloudflare", "header cf-ray present"), ("cdn", "Vercel", "header server contains vercel"),
        ("cms", "Next.js", "body contains __NEXT_DATA__"), ("framework", "Bootstrap", "asset URL contains bootstrap"),
    ]


def issues(spark, *rows):
    return spark.createDataFrame([(c, s, m, u, d) for c, s, m, u, d in rows], ISSUE)


def test_scores_filters_exit(spark):
    i = issues(spark, *[("tls/x", "critical", "m", "u", "")] * 3, ("hreflang/a", "warning", "m", "u", ""), ("own/a", "info", "m", "v", ""), ("seo/a", "odd", "m", "v", ""))
    s = {r.category: r.score for r in summary.health_scores(i).collect()}
    assert s["overall"] == 66 and s["security"] == 70 and s["seo"] == 97 and s["content"] == 100 and len(s) == 10
    assert {r.severity: r.n for r in summary.by_severity(i.where("severity = 'info'")).collect()} == {"critical": 0, "warning": 0, "info": 1}
    assert summary.filter_issues(i, [" CRITICAL"], ["TLS"]).count() == 3 and summary.filter_issues(i).count() == 6
    assert [(r.url, r.n) for r in summary.top_urls(i, 1).collect()] == [("u", 4)]
    assert {r.key: r.n for r in summary.group_issues(i, "url").collect()} == {"u": 4, "v": 2} and summary.group_issues(i, "?").count() == 4
    assert [summary.exit_code(i, x) for x in ("critical", "any", "unknown", "")] == [1, 1, 0, 0] and summary.exit_code(i.limit(0), "any") == 0


def test_baseline_multiset(spark, tmp_path):
    a = issues(spark, *[("c", "info", m, "u", "") for m in "123"], ("d", "info", "m", "u", "")).withColumn("seq", F.monotonically_increasing_id())
    b = issues(spark, ("c", "info", "0", "u", ""), *[("e", "info", "m", "u", "")] * 2).withColumn("seq", F.monotonically_increasing_id())
    got = sorted((r.status, r.check_name, r.message) for r in baseline_diff(a, b).collect())
    assert got == [("existing", "c", "1"), ("new", "c", "2"), ("new", "c", "3"), ("new", "d", "m"), ("resolved", "e", "m"), ("resolved", "e", "m")]
    save_baseline(a, str(tmp_path / "b"), "seed")
    assert load_baseline(spark, str(tmp_path / "b")).count() == 4
    assert baseline_diff(a, b.limit(0)).where("status <> 'new'").count() == 0


@pytest.mark.parametrize(
    "cond, want",
    [
        ("page.status_code == 200", True), ("'x-a' in page.headers", True), ("page.headers['x-a'] == 'v'", True), ("page.headers['none'] == 'v'", False), ("page.headers['none'] == 'v' || true", True),
        ("size(page.body) > 3 && page.body.contains('é')", True), ("size('é') == 1", True), ("page.links.exists(l, l.endsWith('b'))", True), ("page.links.all(l, l.startsWith('a'))", False),
        ("page.links.exists_one(l, l == 'a')", True), ("page.links.filter(l, l == 'a').size() == 1", True), ("page.links.map(l, l + 'x')[1] == 'bx'", True), ("page.depth / 0 == 1", False), ("7 / 2 == 3 && -7 / 2 == -3 && 7 % 3 == 1", True),
        ("page.in_sitemap ? false : page.url.matches('^https')", True), ("page.fetch_duration_ms >= 1", True), ("'A-b'.lowerAscii() == 'a-b' && ' x '.trim() == 'x'", True), ("'a,b'.split(',')[1] == 'b'", True),
        ("'abc'.substring(1, 2) == 'b' && 'abc'.indexOf('c') == 2 && 'abc'.charAt(0) == 'a' && 'aa'.replace('a', 'b') == 'bb'", True), ("has(page.headers.nope)", False), ("page.links[5] == 'a'", False), ("!(page.depth in [1, 2])", True), ("'yes'", False),
    ],
)
def test_rule_conditions(spark, cond, want):
    p = pages(spark, {"headers": {"x-a": ["v", "w"]}, "links": ["a", "b"], "body": "caféx"})
    assert p.select(compile_condition(cond).alias("x")).first().x is want


def test_rules(spark):
    p = pages(spark, {"url": U + "/x"}, {"url": "https://example.com"})
    rs = [Rule("r", "warning", "true", "m", "https://*"), Rule("q", "loud", "page.depth == 0", "n")]
    got = {(r.check_name, r.severity, r.url) for r in p.select(F.explode(rule_checks(rs)).alias("i")).select("i.*").collect()}
    assert got == {("r", "warning", "https://example.com"), ("q", "", U + "/x"), ("q", "", "https://example.com")}
    for bad in ("page.status_code ==", "nope == 1", "page.depth == 'x'", "size(1)"):
        with pytest.raises(RuleError, match="rule 'b'"):
            rule_checks([Rule("b", "info", bad)])
    with pytest.raises(RuleError):
        rule_checks([Rule("b", "info", "true", match="[")])
    assert glob_regex("/a*/?x") == "^/a[^/]*/[^/]x$" and glob_regex("[a-") is None


def test_robots(spark):
    text = "User-agent: a\nUser-agent: auditloom\nDisallow: /private\nAllow: /private/ok\nDisallow: /*.pdf$ # c\nDisallow:\n\nUser-agent: *\nDisallow: /\n"
    rules = robots.robots_rules(spark.createDataFrame([("e.org", text), ("f.org", "User-agent: *\nDisallow: /x\nAllow: /x\n"), ("g.org", "")], "host string, text string"), "auditloom/1.0")
    urls = {"https://e.org/": True, "https://e.org/private/x": False, "https://e.org/private/ok": True, "https://e.org/a.pdf": False, "https://e.org/a.pdf?q": True, "https://f.org/x": True, "https://g.org/q": True, "https://none.org/": True}
    got = {r.url: r.allowed for r in robots.decide(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert got == urls


def test_frontier_crawl_cache(spark, tmp_path):
    p = pages(spark, {"url": U, "links": [U + "/a", U + "/b", U + "/a", "https://o.org/"]}, {"url": U + "/a", "links": [U + "/c"]}, {"url": U + "/b", "links": []}, {"url": U + "/c", "links": []})
    got = crawl.crawl(spark, U, crawl.table_fetcher(p), sitemap=[U + "/b"], max_depth=2, checkpoint=str(tmp_path / "f"))
    assert {(r.url, r.depth, r.in_sitemap) for r in got.collect()} == {(U, 0, False), (U + "/a", 1, False), (U + "/b", 1, True), (U + "/c", 2, False)}
    assert crawl.load_frontier(spark, str(tmp_path / "f")).count() == 4 and crawl.load_frontier(spark, str(tmp_path / "none")) is None
    snap = spark.createDataFrame([(U, 0, 0, "seen", U), (U + "/a", 1, 1, "queued", U), (U + "/b", 1, 2, "seen", U)], "url string, depth int, seq long, state string, seed string")
    snap.write.parquet(str(tmp_path / "g"))
    assert {r.url for r in crawl.crawl(spark, U, crawl.table_fetcher(p), resume=str(tmp_path / "g")).collect()} == {U + "/a", U + "/c"}
    assert crawl.crawl_sites(spark, [U, "example.com"], crawl.table_fetcher(p), parallel=2).count() == 4
    crawl.save_cache(crawl.cache_rows(p), str(tmp_path / "c"))
    assert crawl.load_cache(spark, str(tmp_path / "c")).count() == 4 and crawl.load_cache(spark, str(tmp_path / "no")).count() == 0
    assert crawl.crawl(spark, U, crawl.table_fetcher(p), max_pages=2).count() == 2
    assert crawl.crawl(spark, U, crawl.table_fetcher(p), exclude=["/a"]).count() == 2
    old = crawl.cache_rows(p)
    new = pages(spark, {"url": U, "body": "changed"}, {"url": U + "/b"}, {"url": U + "/new"})
    assert sorted(r.url for r in crawl.changed_pages(new, old).collect()) == [U, U + "/new"]


def test_fetch_and_probe_a_local_server(spark):
    import gzip
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path in ("/old", "/loop"):
                self.send_response(301)
                self.send_header("Location", "/new" if self.path == "/old" else "/loop")
                self.end_headers()
                return
            body = gzip.compress(b"<a href=/x>x</a>")
            self.send_response(200 if self.path == "/new" else 404)
            for k, v in (("Content-Type", "text/html; charset=utf-8"), ("Content-Encoding", "gzip"), ("Content-Length", str(len(body)))):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def do_HEAD(self):
            self.send_response(405)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        p = crawl.fetch_page(at + "/old", allow_private=True)
        assert (p["url"], p["redirect_chain"], p["content_type"], p["body"]) == (at + "/new", [at + "/new"], "text/html", "<a href=/x>x</a>")
        for bad in ("/loop",):
            with pytest.raises(ValueError):
                crawl.fetch_page(at + bad, allow_private=True)
        with pytest.raises(ValueError):
            crawl.fetch_page(at + "/new")
        got = {r.url: r.status_code for r in crawl.probe_links(spark.createDataFrame([(at + "/none",), (at + "/old",)], "url string"), 100, allow_private=True).collect()}
        assert got == {at + "/none": 404, at + "/old": 301}
        assert crawl.probe_link(at + "/new")["err"] == "address not allowed"
        tasks = spark.createDataFrame([(at + "/old", 0, 5), (at + "/loop", 1, 6)], "url string, depth int, seq long")
        got = crawl.http_fetcher(100, allow_private=True)(tasks).collect()
        assert [(r.url, r.seq, r.status_code, r.links, r.headers["content-encoding"]) for r in got] == [(at + "/new", 5, 200, [at + "/x"], ["gzip"])]
    finally:
        server.shutdown()


def test_sitemaps_and_files(spark, tmp_path):
    import gzip

    a = b"<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc> https://e.org/1 </loc></url><url><loc>https://o.org/2</loc></url></urlset>"
    files = {"https://e.org/s.xml": b"<sitemapindex><sitemap><loc>https://e.org/a.xml.gz</loc></sitemap><sitemap><loc>https://o.org/b.xml</loc></sitemap></sitemapindex>", "https://e.org/a.xml.gz": gzip.compress(a)}
    assert crawl.sitemap_urls("https://e.org/s.xml", files.get) == ["https://e.org/1"]
    assert crawl.parse_sitemap(b"<bad") == ([], [])
    (tmp_path / "s.xml").write_bytes(a)
    assert crawl.sitemap_table(spark, str(tmp_path / "s.xml")).count() == 2
    (tmp_path / "u.txt").write_text("# c\nhttps://b\n\nhttps://a\n")
    assert [r.url for r in crawl.read_url_file(spark, str(tmp_path / "u.txt")).collect()] == ["https://b", "https://a"]
    assert crawl.normalise_url("e.org") == "https://e.org" and not crawl.is_safe_url("http://127.0.0.1/")
    got = crawl.lighthouse_from_api('{"lighthouseResult":{"categories":{"performance":{"score":0.5},"seo":{"score":null}}}}', "u", "psi")
    assert got["performance_score"] == 50 and got["seo_score"] == 0


def test_reports(spark, tmp_path):
    i = issues(spark, ("seo/a", "warning", "=cmd", "https://x/<b>", "d\ne"), ("tls/b", "critical", 'say "x" & y', "u", ""), ("seo/a", "odd", "m", "v", ""))
    r = Result("https://x", i, 2, "2025", 1_500_000_000, [{"url": "u", "performance_score": 55.0}])
    out = str(tmp_path / "r")
    write_reports(r, ["json", "jsonl", "csv", "markdown", "html", "sarif", "junit", "terminal"], out)
    j = json.load(open(out + ".json"))
    assert j["summary"]["by_severity"] == {"critical": 1, "warning": 1, "info": 0, "odd": 1} and [x["check_name"] for x in j["issues"]] == ["tls/b", "seo/a", "seo/a"] and "detail" not in j["issues"][0]
    lines = [json.loads(x) for x in open(out + ".jsonl")]
    assert lines[-1]["type"] == "summary" and lines[-1]["issues"] == 3
    rows = list(csv.reader(open(out + ".csv")))
    assert rows[0] == ["url", "severity", "check", "message", "detail"] and rows[2][3] == "\t=cmd" and rows[2][4] == "d\ne"
    s = json.load(open(out + ".sarif"))["runs"][0]
    assert [x["level"] for x in s["results"]] == ["error", "warning", "none"] and len(s["tool"]["driver"]["rules"]) == 2 and s["results"][1]["message"]["text"] == "=cmd: d\ne"
    x = ElementTree.parse(out + ".junit").getroot()
    assert x.get("tests") == "3" and [t.get("name") for t in x] == ["tls", "seo"] and x.get("time") == "1.500"
    assert "&lt;b&gt;" in open(out + ".html").read() and "## Critical Issues" in open(out + ".markdown").read() and "CRITICAL" in open(out + ".terminal").read()
    assert 'issues_total{severity="critical"} 1' in prometheus(r) and "auditloom_health_score 87" in prometheus(r)
    write_issues(i, out + "-csv")
    assert spark.read.option("header", True).csv(out + "-csv").count() >= 3
    with pytest.raises(ValueError):
        write_reports(r, ["xls"])
    with pytest.raises(NotImplementedError):
        write_reports(r, ["pdf"], out)


def test_config(tmp_path):
    f = tmp_path / "auditloom.yml"
    f.write_text("crawl:\n  max_depth: 7\n  timeout: 1m30s\n  exclude: ['/a/*']\noutput:\n  formats: [json, csv]\n")
    c = load_config(str(f), env={"AUDITLOOM_MAX_DEPTH": "8", "AUDITLOOM_RESPECT_ROBOTS": "false"}, max_pages=3)
    assert (c.max_depth, c.request_timeout, c.exclude, c.formats(), c.respect_robots, c.max_pages) == (8, 90.0, ["/a/*"], ["json", "csv"], False, 3)
    for bad in ({"max_depth": 0}, {"output": "xls"}, {"fail_on": "x"}, {"include": ["["]}):
        with pytest.raises(ValueError):
            load_config(str(f), env={}, **bad)
    assert seconds("500ms") == 0.5


def test_stream_and_cli(spark, tmp_path):
    from auditloom.cli import run_audit
    from auditloom.streaming.stream import audit_into, page_changes, page_stream

    pages(spark, {"url": U, "body": "<title>x</title>"}, {"url": U, "body": "y", "seq": 2}, {"url": U + "/b"}).write.parquet(str(tmp_path / "in" / "pages.parquet"))
    q = audit_into(page_stream(spark, str(tmp_path / "in"), name="pages.parquet"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("check_name = 'seo/title-length'").count() == 1
    c = page_changes(page_stream(spark, str(tmp_path / "in"), name="pages.parquet")).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start()
    c.awaitTermination()
    assert sorted(r.change for r in spark.table("changes").collect()) == ["changed", "first", "first"]
    cfg = load_config(env={}, output="json", output_file=str(tmp_path / "a.json"), fail_on="critical", save_baseline=str(tmp_path / "base"))
    p = spark.read.parquet(str(tmp_path / "in" / "pages.parquet"))
    assert run_audit(spark, p, cfg, U) == 1 and json.load(open(tmp_path / "a.json"))["summary"]["total_issues"] > 0
    again = load_config(env={}, output="json", output_file=str(tmp_path / "b.json"), fail_on="any", compare_baseline=str(tmp_path / "base"))
    assert run_audit(spark, p, again, U) == 0


def test_crawl_of_any_depth(spark):
    chain = [U] + [f"{U}/{i}" for i in range(8)]
    p = pages(spark, *[{"url": u, "links": [U + "/gone", v]} for u, v in zip(chain, chain[1:] + [U])])
    got = crawl.crawl(spark, U, crawl.table_fetcher(p), max_pages=None, max_depth=None)
    assert {(r.url, r.depth) for r in got.collect()} == {(u, i) for i, u in enumerate(chain)}
    assert crawl.crawl(spark, U, crawl.table_fetcher(p)).count() == 6  # depth 5
    level = spark.createDataFrame([(3, 7, ["c", "d"]), (3, 2**62, ["e"]), (3, 0, ["a", "b"]), (3, 9, None)], "depth int, seq long, links array<string>")
    assert [(r.url, r.depth, r.seq) for r in crawl._linked(level).orderBy("seq").collect()] == [(u, 4, i) for i, u in enumerate("abcde")]


@pytest.mark.parametrize("form", ["json", "markdown", "html"])
def test_lighthouse_command_reports_every_row(spark, tmp_path, monkeypatch, form):
    from auditloom import cli
    from auditloom.model import LIGHTHOUSE

    rows = [(f"https://e.org/p{i:04d}/", 95.0, 95.0, 95.0, 95.0, None, "psi") for i in range(1203)]
    spark.createDataFrame(rows, LIGHTHOUSE).write.parquet(str(tmp_path / "scores"))
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    out = tmp_path / "report"
    assert cli.main(["lighthouse", str(tmp_path / "scores"), "--output", form, "--output-file", str(out)]) == 0
    text = out.read_text()
    places = [text.find(r[0]) for r in rows]
    assert min(places) >= 0 and places == sorted(places) and (form != "json" or len(json.loads(text)["lighthouse"]) == 1203)


def test_log_lines():
    import io

    from auditloom.logs import log, set_up

    out = io.StringIO()
    set_up("warn", "json", out)
    log.info("not shown")
    log.warning("shown %d", 3)
    line = json.loads(out.getvalue())
    assert (line["level"], line["message"]) == ("warning", "shown 3") and line["time"].endswith("Z")
    out = io.StringIO()
    set_up("debug", "pretty", out).debug("plain")
    assert out.getvalue().rstrip().endswith("DEBUG   plain")
