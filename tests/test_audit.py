"""Per-page checks: one positive and one negative case each, by names and messages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from auditloom.checks import accessibility, health, media, performance, security, seo
from auditloom.functions import dom
from auditloom.functions.features import with_features
from auditloom.plans.audit import PAGE_CHECKS, Registry, page_issues
from tests.helpers import names, pages

GOOD_HEAD = (
    "<title>A title of a good length for a page</title><meta name=description content='" + "d" * 100 + "'><link rel=canonical href='https://example.com'>"
    "<meta property='og:title' content=t><meta property='og:description' content=t><meta property='og:image' content=t><meta name='twitter:card' content=s><meta name=viewport content=w>"
)


def run(spark, check, *facts):
    return page_issues(with_features(pages(spark, *facts)), {"x": check})


def test_seo_good_and_bad(spark):
    good = f"<html lang=en><head>{GOOD_HEAD}</head><body><h1>One</h1></body></html>"
    assert names(run(spark, seo.checks, {"body": good})) == []
    bad = names(run(spark, seo.checks, {"body": "<p>x"}))
    assert bad == sorted(
        ["seo/missing-title", "seo/missing-meta-description", "seo/missing-h1", "seo/missing-canonical", "seo/missing-lang", "seo/missing-og-title", "seo/missing-og-description", "seo/missing-og-image", "seo/missing-twitter-card", "seo/missing-viewport"]
    )
    assert names(run(spark, seo.checks, {"body": "<p>x", "content_type": "text/plain"}, {"content_type": None, "body": None})) == []


def test_title_bytes_and_conflicts(spark):
    r = run(spark, seo.checks, {"body": "<title>" + "é" * 20 + "</title>"}).where("check_name = 'seo/title-length'").collect()
    assert r == []  # 40 bytes
    r = run(spark, seo.checks, {"body": "<title>short</title>"}).where("check_name = 'seo/title-length'").first()
    assert r.message == "title length is 5 characters, expected 30-60"
    n = names(run(spark, seo.checks, {"body": "<meta name=ROBOTS content=NoIndex><link rel=CANONICAL href=a><link rel=canonical href=b><h1>a</h1><h1>b</h1>"}))
    assert {"seo/meta-robots-conflict", "seo/multiple-canonical", "seo/multiple-h1"} <= set(n)
    u = run(spark, seo.checks, {"url": "https://example.com/A_b/" + "x" * 100}).where("check_name = 'seo/url-issues'").first()
    assert u.message == "URL has issues: length is 124 characters (>100), path contains underscores, path contains uppercase letters"


@pytest.mark.parametrize(
    "fact, name, message",
    [
        ({"status_code": 404}, "health/4xx", "page returned HTTP 404"),
        ({"status_code": 503}, "health/5xx", "page returned HTTP 503"),
        ({"redirect_chain": ["a", "b", "c"]}, "health/redirect-chain", "redirect chain has 3 hops, maximum is 2"),
        ({"redirect_chain": ["https://example.com"]}, "health/redirect-loop", "page URL appears in its own redirect chain"),
        ({"fetch_duration_ns": 3_000_400_000}, "health/slow-ttfb", "time to first byte is 3s, maximum is 2s"),
        ({"fetch_duration_ns": 62_512_000_000}, "health/slow-ttfb", "time to first byte is 1m2.512s, maximum is 2s"),
        ({"assets": ["http://x/a", "https://x/b"]}, "health/mixed-content", "HTTPS page loads 1 HTTP assets"),
        ({"headers": {"server": ["nginx/1.18.0"]}}, "health/server-version-leak", "Server header reveals version: nginx/1.18.0"),
        ({"redirect_chain": ["http://x"], "status_code": 302}, "health/https-redirect-not-permanent", "HTTP to HTTPS redirect uses non-permanent status 302; prefer 301 or 308"),
        ({"content_type": "text/html"}, "health/missing-charset", "Content-Type header is missing charset: text/html"),
    ],
)
def test_health(spark, fact, name, message):
    got = run(spark, health.checks, fact).where(F.col("check_name") == name).collect()
    assert [r.message for r in got] == [message]
    assert names(run(spark, health.checks, {})) == []


def test_performance(spark):
    clean = {"headers": {"content-encoding": ["gzip"], "cache-control": ["max-age=1"], "alt-svc": ['h3=":443"']}, "body": "<head><link rel=preconnect href=x></head>"}
    assert names(run(spark, performance.checks, clean)) == []
    body = (
        "<head><script src=a.js></script><script src=b.js defer></script><link rel=stylesheet href=1><link rel=stylesheet href=2 media=print><link rel=stylesheet href=3 media=all><link rel=stylesheet href=4>"
        + "".join(f"<script async src='https://h{i}.org/x.js'></script>" for i in range(6))
        + "<style>@font-face{font-family:x}</style><style>@font-face{font-display: block;}@font-face{}@font-face{}@font-face{}</style></head><script>var a   = 1;</script>" + "<i></i>" * 1500 + "<!--" + "x" * 102_400 + "-->"
    )
    got = run(spark, performance.checks, {"body": body})
    assert names(got) == sorted(
        ["performance/large-html", "performance/no-compression", "performance/render-blocking-script", "performance/excessive-css", *["performance/render-blocking-css"] * 3, "performance/missing-resource-hints",
         *["performance/font-loading"] * 2, "performance/excessive-third-party", "performance/excessive-dom-size", "performance/missing-cache-headers", "performance/excessive-webfonts",
         "performance/unminified-resources", "performance/no-http2"]
    )
    assert "scripts from 6 external origins" in got.where("check_name like '%third%'").first().message


def test_security(spark):
    ok = {"strict-transport-security": ["max-age=31536000"], "content-security-policy": ["default-src 'self'"], "x-content-type-options": ["NoSniff"], "x-frame-options": ["deny"], "referrer-policy": ["no-referrer"], "permissions-policy": ["x"]}
    assert names(run(spark, security.checks, {"headers": ok, "body": "<script src=/a.js></script>"})) == []
    assert len(names(run(spark, security.checks, {}))) == 6
    assert names(run(spark, security.checks, {"status_code": 404})) == []
    bad = {**ok, "strict-transport-security": ["max-age=10; x"], "content-security-policy": ["'unsafe-inline' 'unsafe-eval'"], "referrer-policy": ["unsafe-url"], "set-cookie": ["a=1; Secure", "b; HttpOnly; secure; SameSite=Lax"], "access-control-allow-origin": [" * "]}
    got = {r.check_name: r.message for r in run(spark, security.checks, {"headers": bad, "body": "<script src=//cdn.org/a.js></script><script src=https://c.org/b integrity=x></script><link rel=stylesheet href=https://c.org/c>"}).collect()}
    assert got["security/weak-hsts"] == "HSTS max-age is 10 seconds, recommended minimum is 31536000 (1 year)"
    assert got["security/csp-unsafe"] == "Content-Security-Policy contains 'unsafe-inline' and 'unsafe-eval'"
    assert got["security/insecure-cookies"] == 'cookie "a" is missing HttpOnly, SameSite flag(s)'
    assert got["security/insecure-referrer-policy"] == 'Referrer-Policy "unsafe-url" leaks the full URL on cross-origin requests'
    assert {"security/cors-wildcard", "security/missing-sri"} <= set(got)


A11Y_BAD = (
    "<a href=/x></a><input type=email><h1>a</h1><h3>b</h3><button></button><table><tr><td>x</table><figure><img src=a></figure><p tabindex=3></p>"
    "<div aria-hidden=true tabindex=0></div><div onclick=x></div><video></video>"
)


def test_accessibility(spark):
    got = names(run(spark, accessibility.checks, {"body": A11Y_BAD}))
    assert got == sorted(
        "accessibility/" + x
        for x in ("missing-form-label", "empty-link", "missing-skip-nav", "heading-hierarchy", "missing-button-text", "missing-table-header", "missing-img-alt-in-figure", "positive-tabindex", "missing-landmarks",
                  "invalid-aria", "onclick-without-keyboard", "missing-video-captions", "missing-autocomplete")
    )
    good = (
        "<main><a href=#m>skip</a><a href=/i><img alt=x></a><label for=e>E</label><input id=e type=email autocomplete=email><label><input></label><input type=hidden><h1>a</h1><h2>b</h2><button aria-label=x></button>"
        "<table><tr><th>x</table><figure><img src=a><figcaption>c</figcaption></figure><button tabindex=0 onclick=x>y</button><div role=button onclick=x></div><video><track kind=captions></video></main>"
    )
    assert names(run(spark, accessibility.checks, {"body": good})) == []


def test_images_links_languages_content(spark):
    img = "<header><img src=h alt=x width=1></header><img src=a><a href=x><img src=b alt='' width=1></a><img src='http://x/c.JPG?q=1' alt=x width=1><img src=d alt=x width=1 loading=lazy>"
    got = names(run(spark, media.images, {"body": img}))
    assert got == sorted(["images/missing-alt", "images/empty-alt-in-link", "images/legacy-format", "images/missing-lazy-loading", "images/missing-dimensions", "images/missing-responsive"])
    got = run(spark, media.links, {"body": "<a href=x>Click Here</a><a href=y>fine</a>" + "<a href=z>t</a>" * 99})
    assert names(got) == ["links/excessive-links", "links/generic-anchor-text"]
    tags = {"en": 1, "haw": 1, "en-US": 1, "zh-Hans-CN": 1, "x-default": 1, "EN": 0, "English": 0, "e": 0, "en-": 0, "123": 0, "en_US": 0, "en-USAAA": 0}
    body = "".join(f"<link rel=alternate hreflang='{t}' href=/>" for t in tags)
    assert len(names(run(spark, media.hreflang, {"body": body}))) == sum(not v for v in tags.values())
    assert names(run(spark, media.hreflang, {"body": "<link rel=alternate hreflang=en href=/>"})) == ["hreflang/missing-x-default"]
    got = names(run(spark, media.content, {"url": "https://example.com/blog/x", "body": "<h1>a</h1><h4>b</h4><!--" + "x" * 500 + "-->"}))
    assert got == ["content/heading-hierarchy-skip", "content/low-text-ratio", "content/no-paragraphs", "content/word-count-low"]


def sd(spark, *blocks: str) -> dict[str, str]:
    body = "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)
    return {r.check_name.split("/")[1]: r.message for r in run(spark, media.structured_data, {"body": body}).collect()}


def test_structured_data(spark):
    assert set(sd(spark)) == {"missing-json-ld"}
    assert set(sd(spark, "{bad")) == {"malformed-json-ld"} and set(sd(spark, "")) == {"malformed-json-ld"} and set(sd(spark, '{"a": NaN}')) == {"malformed-json-ld"}
    assert set(sd(spark, "null")) == {"missing-context", "missing-type"}
    assert sd(spark, "3") == {}
    art = '{"@context":"https://schema.org/","@type":"Article","headline":"h","datePublished":"2024-02-30","author":{"@type":"Place","name":"x"},"image":["ftp://x"],"url":3}'
    got = sd(spark, art)
    assert got["invalid-date-format"].startswith('JSON-LD field "datePublished" has invalid date value "2024-02-30"')
    assert got["invalid-nested-type"] == 'JSON-LD field "author" has nested @type "Place"; expected one of: Person, Organization'
    assert got["invalid-url-field"] and got["google-missing-recommended"] == "Google Rich Results: Article is missing recommended fields: dateModified, mainEntityOfPage"
    got = sd(spark, '{"@context":{"@vocab":"http://x"},"@graph":[{"@type":"Event","name":"n"},{"@type":["Nope","Person"]}]}')
    assert {"wrong-context", "missing-required-field", "unknown-type"} <= set(got)
    got = sd(spark, '{"@context":"http://schema.org","@type":"WebSite","potentialAction":{"@type":"SearchAction","target":{"urlTemplate":"https://x/?q={q}"}}}', '[{"@context":"http://schema.org","@type":"WebSite"}]')
    assert {"search-action-template", "duplicate-type", "not-google-eligible"} <= set(got)
    got = sd(spark, '{"@context":"http://schema.org","@type":"BreadcrumbList","itemListElement":[{"position":1},{"position":3}]}')
    assert got["breadcrumb-positions"] == "BreadcrumbList item at index 1 has position 3; expected 2"
    assert "invalid-enum-value" in sd(spark, '{"@context":"http://schema.org","@type":"Offer","availability":"Maybe"}')


def test_registry_inherits_properties_only():
    from auditloom.schema.registry import load_registry

    r = load_registry()
    assert "datePublished" in r["BlogPosting"].properties and "url" in r["WebSite"].properties
    assert r["Recipe"].required == ["name", "image", "recipeIngredient"] and "validFrom" in r["AggregateOffer"].properties
    assert load_registry("/nowhere.json") == r


def test_dom_tree():
    d = dom.parse("<title>t</title><p><b>one<p>two<li>a<li>b<script>var t='</p>'</script>")
    tags = [n.tag for n in d.walk()]
    assert tags[:4] == ["#document", "html", "head", "title"] and tags.count("p") == 2 and tags.count("b") == 2 and tags.count("li") == 2
    assert dom.parse("").kids[0].tag == "html"
    assert sum(n.tag == "div" for n in dom.parse("<div>" * 30_000 + "x" + "</div>" * 30_000 + "<p>y").walk()) == 30_000
    links, assets = dom.links_and_assets("<a href='/x#f'>1</a><a href=mailto:a@b>2</a><img src=i.png><link href=c.css><script src=//h/s.js></script><!-- <a href=/no> --><script>'<a href=/no2>'</script>", "https://e.org/d/")
    assert links == ["https://e.org/x"] and assets == ["https://e.org/d/i.png", "https://e.org/d/c.css", "https://h/s.js"]


def test_lighthouse_scores(spark):
    from auditloom.model import LIGHTHOUSE
    from auditloom.site import summary

    df = spark.createDataFrame([("a", 49.5, 95.0, 0.0, 89.0, None, "psi"), ("b", 50.0, 80.0, 0.0, 95.0, None, "psi"), ("c", 95.0, 95.0, 0.0, 95.0, None, "psi")], LIGHTHOUSE)
    got = {(r.check_name, r.severity, r.url): r.message for r in page_issues(df, {"l": media.lighthouse}).collect()}
    assert got[("lighthouse/performance", "critical", "a")] == "performance score 50 is below 50" and ("lighthouse/performance", "warning", "b") in got and len(got) == 4
    assert [r.url for r in summary.slowest(df).collect()] == ["a", "b", "c"]
    s = summary.speed_summary(df).first()
    assert s.n == 3 and abs(s.pass_rate - 100 / 3) < 1e-9
    assert names(summary.speed_issues(df)) == ["lighthouse/low-pass-rate"]
    assert names(summary.speed_issues(df.limit(0))) == []


def test_whole_registry_runs(spark):
    p = pages(spark, {"body": "<title>x</title>"}, {"url": "https://example.com/b", "depth": 2, "content_type": None, "body": None, "headers": None, "links": None, "assets": None, "redirect_chain": None})
    r = Registry().with_analysis()
    r.register_page("own", lambda: __import__("auditloom.checks", fromlist=["none"]).none())
    got = names(r.run(p))
    assert "links/orphan-page" in got and "security/missing-security-txt" in got and len(PAGE_CHECKS) == 9
    assert names(r.run(p.limit(0))) == ["security/missing-security-txt"]
