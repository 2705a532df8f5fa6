"""The audit: all checks over a crawl, as one DataFrame of issues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.checks import accessibility, health, media, performance, security, seo
from auditloom.functions.features import with_features
from auditloom.model import ISSUE_COLS
from auditloom.session import materialise
from auditloom.site import classify, duplicates, graph, links, redirects, summary

#: Per-page checks by name, in report order.
PAGE_CHECKS: dict[str, Callable[[], Column]] = {
    "seo": seo.checks,
    "health": health.checks,
    "images": media.images,
    "links": media.links,
    "performance": performance.checks,
    "structured-data": media.structured_data,
    "security": security.checks,
    "accessibility": accessibility.checks,
    "hreflang": media.hreflang,
}
#: Checks that the command line doesn't run by default.
EXTRA_PAGE_CHECKS: dict[str, Callable[[], Column]] = {"content": media.content}


def page_issues(featured: DataFrame, checks: dict[str, Callable[[], Column]] | None = None, rules: Column | None = None) -> DataFrame:
    """Issues of single pages: every check's array in one projection, exploded once, without a shuffle."""
    parts = [f() for f in (PAGE_CHECKS if checks is None else checks).values()]
    if rules is not None:
        parts.append(rules)
    return featured.select(F.explode(F.concat(*parts)).alias("i")).select("i.*")


class Registry:
    """Checks by name; own ones are added as functions of a column or of the crawl."""

    def __init__(self):
        self.page: dict[str, Callable[[], Column]] = dict(PAGE_CHECKS)
        self.site: dict[str, Callable[[DataFrame], DataFrame]] = {
            "seo": lambda p: links.union_issues(links.noindex_in_sitemap(p), links.duplicate_titles(p.select("seq", "url", F.col("d.title").alias("title")))),
            "links": lambda p: links.union_issues(links.broken_internal(p), links.orphan_pages(p), links.deep_pages(p)),
            "security": links.missing_security_txt,
            "hreflang": lambda p: links.hreflang_site(p.where("d IS NOT NULL").select("seq", "url", F.col("d.hreflang").alias("hreflang"))),
        }

    def register_page(self, name: str, check: Callable[[], Column]) -> None:
        self.page[name] = check

    def register_site(self, name: str, check: Callable[[DataFrame], DataFrame]) -> None:
        self.site[name] = check

    def with_analysis(self) -> "Registry":
        """Also duplicates, link graph, redirects, crawl budget and content checks."""
        self.page.update(EXTRA_PAGE_CHECKS)
        self.site["duplicates"] = lambda p: duplicates.duplicate_issues(duplicates.body_classes(p.where("d IS NOT NULL").select("seq", "url", "body", F.col("d.text").alias("text"))))
        self.site["graph"] = _graph_issues
        self.site["redirects"] = redirects.redirect_issues
        self.site["crawl-budget"] = summary.crawl_budget_issues
        return self

    def run(self, pages: DataFrame, rules: Column | None = None, registry_path: str | None = None, link_probe: DataFrame | None = None, tls_probe: DataFrame | None = None) -> DataFrame:
        """All issues, unordered. Pages are parsed once; the parse is kept for the site-wide checks.

        Probes of external links, images and certificates are tables; without them those checks don't run.
        """
        p = materialise(with_features(pages, registry_path))
        out = [page_issues(p, self.page, rules)]
        out += [f(p).select(*ISSUE_COLS) for f in self.site.values()]
        if link_probe is not None:
            out += [links.external_issues(links.external_targets(p), link_probe), links.image_probe_issues(p.where("d IS NOT NULL"), link_probe)]
        if tls_probe is not None:
            out.append(links.tls_issues(p, tls_probe))
        return links.union_issues(*out)


def _graph_issues(p: DataFrame) -> DataFrame:
    nodes, edges = graph.graph(p)
    e = materialise(edges)
    return links.union_issues(graph.low_rank_issues(graph.pagerank(nodes, e)), graph.high_outgoing_issues(e))


def audit(pages: DataFrame, analysis: bool = False, **options) -> DataFrame:
    r = Registry()
    return (r.with_analysis() if analysis else r).run(pages, **options)


def technologies(pages: DataFrame) -> DataFrame:
    return classify.technologies(pages)
