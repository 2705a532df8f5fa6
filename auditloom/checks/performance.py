"""Checks of size, blocking resources, fonts and caching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.checks import each, guarded, when
from auditloom.functions.columns import authority, header, is_html, rounded
from auditloom.model import INFO, WARNING, issue

MAX_HTML, MAX_CSS, MAX_ORIGINS, MAX_ELEMENTS, MAX_INLINE, MAX_FONTS = 102_400, 3, 5, 1500, 51_200, 4
_WS = r"[\t\n\f\r ]"


def _font(style: Column) -> Column:
    """The finding of one style block, or null."""
    low = F.lower(style)
    value = F.trim(F.split_part(F.regexp_extract(low, r"font-display:(?s)(.*)", 1), F.lit(";"), F.lit(1)))
    text = F.when(~F.contains(low, F.lit("font-display")), F.lit("inline @font-face declaration missing font-display property")).when(
        F.contains(low, F.lit("font-display:")) & (value == "block"), F.lit("inline @font-face uses font-display: block which delays text rendering")
    )
    return F.when(F.contains(style, F.lit("@font-face")), text)


def checks() -> Column:
    size = F.octet_length("body")
    enc, alt = header("content-encoding"), header("alt-svc")
    scripts, css = F.col("d.scripts"), F.col("d.css")
    blocking = F.filter(scripts, lambda s: s["in_head"] & (F.coalesce(s["src"], F.lit("")) != "") & ~s["deferred"])
    head_css = F.filter(css, lambda c: c["in_head"])
    blocking_css = F.filter(head_css, lambda c: c["media"].isNull() | (F.trim(c["media"]) == "") | (F.lower(F.trim(c["media"])) == "all"))
    fonts = F.filter(F.transform("d.styles", _font), lambda x: x.isNotNull())
    origins = F.array_distinct(
        F.filter(F.transform(scripts, lambda s: F.lower(authority(F.coalesce(s["src"], F.lit(""))))), lambda h: (h != "") & (h != F.lower(authority(F.col("url")))))
    )
    add = lambda acc, x: acc + x
    inline = F.aggregate(F.transform(scripts, lambda s: F.octet_length(s["text"])), F.lit(0), add) + F.aggregate(F.transform("d.styles", F.octet_length), F.lit(0), add)
    faces = F.aggregate(F.transform("d.styles", lambda s: F.regexp_count(s, F.lit("@font-face"))), F.lit(0), add)
    loose = F.exists(scripts, lambda s: (F.trim(s["text"]) != "") & (F.rlike(s["text"], F.lit(r"/\*[\s\S]{4,}?\*/")) | F.rlike(s["text"], F.lit(_WS + "{3,}"))))
    kb = lambda n: rounded(n / 1024)
    return guarded(
        is_html(),
        [
            when(size > MAX_HTML, issue("performance/large-html", WARNING, F.concat(F.lit("HTML size is "), size.cast("string"), F.lit(" bytes ("), kb(size), F.lit(" KB), maximum recommended is 102400 bytes")))),
            when(~F.contains(enc, F.lit("gzip")) & ~F.contains(enc, F.lit("br")), issue("performance/no-compression", WARNING, "HTML response is not compressed (missing gzip or br Content-Encoding)")),
            each(blocking, lambda s: issue("performance/render-blocking-script", WARNING, F.concat(F.lit("render-blocking script in <head>: "), s["src"]))),
            when(F.size(head_css) > MAX_CSS, issue("performance/excessive-css", INFO, F.format_string("page has %d stylesheets in <head>, maximum recommended is 3", F.size(head_css)))),
            each(blocking_css, lambda c: issue("performance/render-blocking-css", WARNING, F.concat(F.lit("render-blocking stylesheet in <head>: "), c["href"]))),
            when(~F.col("d.hints"), issue("performance/missing-resource-hints", INFO, 'page has no <link rel="preconnect"> or <link rel="dns-prefetch"> resource hints')),
            each(fonts, lambda t: issue("performance/font-loading", INFO, t)),
            when(F.size(origins) > MAX_ORIGINS, issue("performance/excessive-third-party", WARNING, F.format_string("page loads scripts from %d external origins, maximum recommended is 5", F.size(origins)))),
            when(F.col("d.n_elements") > MAX_ELEMENTS, issue("performance/excessive-dom-size", WARNING, F.format_string("DOM has %d element nodes, maximum recommended is 1500", F.col("d.n_elements")))),
            when(inline > MAX_INLINE, issue("performance/inline-bloat", INFO, F.concat(F.lit("total inline <script> and <style> content is "), inline.cast("string"), F.lit(" bytes ("), kb(inline), F.lit(" KB), maximum recommended is 51200 bytes")))),
            when(header("cache-control") == "", issue("performance/missing-cache-headers", WARNING, "response has no Cache-Control header")),
            when(faces > MAX_FONTS, issue("performance/excessive-webfonts", WARNING, F.format_string("page has %d @font-face declarations in inline styles, maximum recommended is 4", faces))),
            when(loose, issue("performance/unminified-resources", INFO, "inline <script> appears to contain unminified code")),
            when(~F.contains(alt, F.lit("h2")) & ~F.contains(alt, F.lit("h3")), issue("performance/no-http2", INFO, "no Alt-Svc header indicating HTTP/2 or HTTP/3 support detected")),
        ],
    )
