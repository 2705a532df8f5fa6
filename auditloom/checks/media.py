"""Checks of images, link texts, language links, structured data and text content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.checks import each, guarded, when
from auditloom.checks.accessibility import heading_skips
from auditloom.functions.columns import is_html, one_decimal, quoted
from auditloom.model import CRITICAL, INFO, WARNING, issue

LEGACY = ("jpg", "jpeg", "gif", "bmp", "tiff")
GENERIC = ("click here", "read more", "learn more", "here", "more", "link", "this")
LANG = r"^[a-z]{2,3}(-[a-zA-Z]{2,4})*$|^x-default$"
MAX_LINKS, LAZY_FROM, LEAST_RATIO, LEAST_ARTICLE_WORDS = 100, 3, 0.10, 300


def _say(text: str, x: Column) -> Column:
    return F.concat(F.lit(text), x)


def images() -> Column:
    imgs = F.col("d.imgs")
    ext = lambda s: F.lower(F.regexp_extract(F.regexp_replace(s, r"[?#].*$", ""), r"\.([A-Za-z]+)$", 1))
    late = F.slice(imgs, LAZY_FROM + 1, F.greatest(F.size(imgs), F.lit(1)))
    return guarded(
        is_html(),
        [
            each(F.filter(imgs, lambda i: i["alt"].isNull()), lambda i: issue("images/missing-alt", WARNING, _say("image is missing alt attribute: ", i["src"]))),
            each(F.filter(imgs, lambda i: F.coalesce(i["alt"] == "", F.lit(False)) & i["in_link"]), lambda i: issue("images/empty-alt-in-link", WARNING, _say("image inside link has empty alt attribute: ", i["src"]))),
            each(
                F.filter(imgs, lambda i: ext(i["src"]).isin(*LEGACY)),
                lambda i: issue("images/legacy-format", INFO, F.concat(F.lit("image uses legacy format ("), ext(i["src"]), F.lit("), consider WebP or AVIF: "), i["src"])),
            ),
            each(F.filter(late, lambda i: ~i["in_header"] & (i["loading"] != "lazy")), lambda i: issue("images/missing-lazy-loading", INFO, _say('image is missing loading="lazy" attribute: ', i["src"]))),
            each(F.filter(imgs, lambda i: ~i["sized"]), lambda i: issue("images/missing-dimensions", WARNING, _say("image is missing width and height attributes: ", i["src"]))),
            each(
                F.filter(imgs, lambda i: F.startswith(i["src"], F.lit("http")) & ~(F.coalesce(i["alt"] == "", F.lit(False)) & (i["role"] == "presentation")) & ~i["responsive"]),
                lambda i: issue("images/missing-responsive", INFO, _say("image is missing srcset and sizes attributes: ", i["src"])),
            ),
        ],
    )


def links() -> Column:
    targets = F.filter("d.anchors", lambda a: a["href"].isNotNull())
    said = F.filter(F.transform("d.anchors", lambda a: F.lower(a["text"])), lambda t: t.isin(*GENERIC))
    return guarded(
        is_html(),
        [
            when(F.size(targets) > MAX_LINKS, issue("links/excessive-links", INFO, F.format_string("page has %d links, which exceeds the recommended maximum of 100", F.size(targets)))),
            each(said, lambda t: issue("links/generic-anchor-text", INFO, F.concat(F.lit("link has generic anchor text "), quoted(t)))),
        ],
    )


def hreflang() -> Column:
    h = F.col("d.hreflang")
    return guarded(
        is_html(),
        [
            each(F.filter(h, lambda e: ~F.rlike(e["lang"], F.lit(LANG))), lambda e: issue("hreflang/invalid-language-code", WARNING, F.concat(F.lit("hreflang value "), quoted(e["lang"]), F.lit(" is not a valid BCP 47 language tag")))),
            when((F.size(h) > 0) & ~F.exists(h, lambda e: e["lang"] == "x-default"), issue("hreflang/missing-x-default", INFO, "page has hreflang annotations but no x-default")),
        ],
    )


def structured_data() -> Column:
    bad = F.filter("d.jsonld", lambda b: ~b["ok"])
    micro = F.col("d.microdata")
    found = F.transform(
        "d.findings",
        lambda f: F.struct(
            F.concat(F.lit("structured-data/"), f["code"]).alias("check_name"), f["severity"].alias("severity"), f["message"].alias("message"), F.col("url").alias("url"), f["path"].alias("detail")
        ),
    )
    return guarded(
        is_html(),
        [
            when(F.size("d.jsonld") == 0, issue("structured-data/missing-json-ld", INFO, "page has no JSON-LD structured data")),
            each(bad, lambda b: issue("structured-data/malformed-json-ld", WARNING, F.concat(F.lit("JSON-LD block contains invalid JSON: "), b["error"]))),
            found,
            when(micro.isNotNull(), issue("structured-data/microdata-detected", INFO, F.concat(F.lit("HTML contains microdata attribute "), quoted(micro), F.lit("; consider migrating to JSON-LD for better tooling support")))),
        ],
    )


def content() -> Column:
    ratio = F.octet_length("d.text") / F.octet_length("body")
    article = F.contains("url", F.lit("/blog/")) | F.contains("url", F.lit("/post/")) | F.col("d.has_article")
    words = F.col("d.n_words")
    return guarded(
        is_html() & (F.octet_length("body") > 0),
        [
            when(ratio < LEAST_RATIO, issue("content/low-text-ratio", INFO, F.concat(F.lit("text-to-HTML ratio is "), one_decimal(ratio * 100), F.lit("%, minimum recommended is 10%")))),
            when(F.col("d.n_p") == 0, issue("content/no-paragraphs", INFO, "page contains no <p> tags")),
            when(article & (words < LEAST_ARTICLE_WORDS), issue("content/word-count-low", INFO, F.format_string("article page has %d words, minimum recommended is 300", words))),
            each(heading_skips(F.col("d.levels")), lambda p: issue("content/heading-hierarchy-skip", WARNING, F.format_string("heading level skips from h%d to h%d", p["a"], p["b"]))),
        ],
    )


def lighthouse() -> Column:
    """Issues of one row of scores."""
    from auditloom.functions.columns import rounded

    say = lambda what, c, t: F.concat(F.lit(f"{what} score "), rounded(F.col(c)), F.lit(f" is below {t}"))
    perf = F.col("performance_score")
    return F.concat(
        when(perf < 50, issue("lighthouse/performance", CRITICAL, say("performance", "performance_score", 50))),
        when((perf >= 50) & (perf < 90), issue("lighthouse/performance", WARNING, say("performance", "performance_score", 90))),
        when(F.col("accessibility_score") < 90, issue("lighthouse/accessibility", WARNING, say("accessibility", "accessibility_score", 90))),
        when(F.col("seo_score") < 90, issue("lighthouse/seo", WARNING, say("seo", "seo_score", 90))),
    )
