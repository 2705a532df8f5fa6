"""Checks of labels, names, headings, focus and landmarks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.checks import each, guarded, repeated, when
from auditloom.functions.columns import is_html, quoted
from auditloom.model import INFO, WARNING, issue


def heading_skips(levels: Column) -> Column:
    """``(from, to)`` of neighbours whose level rises by more than one."""
    pairs = F.zip_with(F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))), F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.filter(F.when(F.size(levels) > 1, pairs), lambda p: p["b"] > p["a"] + 1)


def _tag(text: str, after: str):
    return lambda t: F.concat(F.lit(text + " <"), t, F.lit("> " + after))


def checks() -> Column:
    first = F.slice("d.anchors", 1, 3)
    empty = F.filter("d.anchors", lambda a: ~a["named"] & (a["text"] == ""))
    return guarded(
        is_html(),
        [
            repeated(F.col("d.unlabelled"), issue("accessibility/missing-form-label", WARNING, "input element is missing an associated label")),
            each(empty, lambda a: issue("accessibility/empty-link", WARNING, "anchor element has no accessible text")),
            when(~F.exists(first, lambda a: F.coalesce(F.startswith(a["href"], F.lit("#")) & (F.length(a["href"]) > 1), F.lit(False))), issue("accessibility/missing-skip-nav", INFO, "page is missing a skip navigation link")),
            each(heading_skips(F.col("d.headings")), lambda p: issue("accessibility/heading-hierarchy", WARNING, F.format_string("heading level skips from h%d to h%d", p["a"], p["b"]))),
            repeated(F.col("d.silent_buttons"), issue("accessibility/missing-button-text", WARNING, "button element has no accessible text")),
            repeated(F.col("d.headless_tables"), issue("accessibility/missing-table-header", INFO, "table element is missing header cells (<th>)")),
            repeated(F.col("d.bare_figures"), issue("accessibility/missing-img-alt-in-figure", WARNING, "image inside <figure> has no alt text and no <figcaption>")),
            each(
                F.filter("d.tabindex", lambda t: t["value"] > 0),
                lambda t: issue("accessibility/positive-tabindex", WARNING, F.format_string("element <%s> has tabindex=%d which disrupts natural tab order", t["tag"], t["value"])),
            ),
            when(~F.col("d.landmark"), issue("accessibility/missing-landmarks", WARNING, "page has no ARIA landmark regions")),
            each(F.col("d.hidden_focus"), lambda t: issue("accessibility/invalid-aria", WARNING, _tag("element", "has aria-hidden=true with positive tabindex")(t))),
            each(F.col("d.clickable"), lambda t: issue("accessibility/onclick-without-keyboard", WARNING, _tag("non-interactive", "has onclick but no tabindex or role")(t))),
            repeated(F.col("d.silent_videos"), issue("accessibility/missing-video-captions", WARNING, "video element is missing captions or subtitles track")),
            each(F.col("d.no_autocomplete"), lambda t: issue("accessibility/missing-autocomplete", INFO, F.concat(F.lit("input type="), quoted(t), F.lit(" is missing autocomplete attribute")))),
        ],
    )
