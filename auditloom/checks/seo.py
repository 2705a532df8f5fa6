"""Search-engine checks of a page's head, headings and address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.checks import guarded, when
from auditloom.functions.columns import is_html, path
from auditloom.model import CRITICAL, INFO, WARNING, issue

TITLE, DESCRIPTION, URL_MAX = (30, 60), (70, 155), 100


def meta(name: str) -> Column:
    """Content of the first meta element of that name, '' if absent."""
    return F.coalesce(F.try_element_at(F.col("d.meta"), F.lit(name)), F.lit(""))


def prop(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("d.prop"), F.lit(name)), F.lit(""))


def url_reasons(url: Column) -> Column:
    p = path(url)
    return F.array_join(
        F.array_compact(
            F.array(
                F.when(F.octet_length(url) > URL_MAX, F.format_string("length is %d characters (>100)", F.octet_length(url))),
                F.when(F.contains(p, F.lit("_")), F.lit("path contains underscores")),
                F.when(p != F.lower(p), F.lit("path contains uppercase letters")),
            )
        ),
        ", ",
    )


def checks() -> Column:
    title, desc = F.col("d.title"), meta("description")
    n, k = F.octet_length(title), F.octet_length(desc)
    h1, canon = F.col("d.h1"), F.col("d.canonical")
    robots = F.lower(meta("robots"))
    reasons = url_reasons(F.col("url"))
    return guarded(
        is_html(),
        [
            when(title.isNull(), issue("seo/missing-title", CRITICAL, "page is missing a <title> tag")),
            when(title.isNotNull() & ((n < TITLE[0]) | (n > TITLE[1])), issue("seo/title-length", WARNING, F.format_string("title length is %d characters, expected 30-60", n))),
            when(desc == "", issue("seo/missing-meta-description", WARNING, "page is missing a meta description")),
            when((desc != "") & ((k < DESCRIPTION[0]) | (k > DESCRIPTION[1])), issue("seo/meta-description-length", INFO, F.format_string("meta description length is %d characters, expected 70-155", k))),
            when(h1 == 0, issue("seo/missing-h1", WARNING, "page is missing an <h1> tag")),
            when(h1 > 1, issue("seo/multiple-h1", WARNING, F.format_string("page has %d <h1> tags, expected 1", h1))),
            when(canon == 0, issue("seo/missing-canonical", WARNING, "page is missing a canonical link")),
            when(canon > 1, issue("seo/multiple-canonical", WARNING, F.format_string("page has %d canonical links, expected at most 1", canon))),
            when(~F.col("d.has_lang"), issue("seo/missing-lang", WARNING, "page is missing a lang attribute on the <html> tag")),
            *[when(prop(f"og:{x}") == "", issue(f"seo/missing-og-{x}", INFO, f"page is missing an og:{x} meta tag")) for x in ("title", "description", "image")],
            when(F.contains(robots, F.lit("noindex")) & (canon > 0), issue("seo/meta-robots-conflict", WARNING, "page has both noindex robots directive and a canonical link")),
            when((meta("twitter:card") == "") & (prop("twitter:card") == ""), issue("seo/missing-twitter-card", INFO, "page is missing a twitter:card meta tag")),
            when(meta("viewport") == "", issue("seo/missing-viewport", CRITICAL, "page is missing a viewport meta tag")),
            when(reasons != "", issue("seo/url-issues", INFO, F.concat(F.lit("URL has issues: "), reasons))),
        ],
    )
