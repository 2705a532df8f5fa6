"""Page classes by address and body, and technologies by their traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import path

#: Fixed values, in order of precedence: class, score, where to look, and any of these.
RULES = [
    ("homepage", 0.9, "root", []),
    ("api", 0.9, "path", ["/api/"]),
    ("api", 0.8, "type", ["application/json"]),
    ("contact", 0.8, "path", ["/contact"]),
    ("about", 0.8, "path", ["/about"]),
    ("legal", 0.8, "path", ["/privacy", "/terms", "/legal", "/cookie"]),
    ("blog", 0.7, "path", ["/blog/", "/post/", "/article/"]),
    ("blog", 0.3, "body", ["<article"]),
    ("product", 0.7, "path", ["/product/", "/shop/", "/item/"]),
    ("product", 0.5, "body", ['"@type":"product"', '"@type": "product"', 'itemtype="http://schema.org/product"', 'itemtype="https://schema.org/product"']),
    ("category", 0.7, "path", ["/category/", "/tag/", "/collection/"]),
]


def _any(c: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return F.coalesce(out, F.lit(False))


def page_class() -> Column:
    """``struct(class, score)``: the best rule, the earlier of equal ones; ``other`` with 0 if none holds."""
    p = F.lower(path(F.col("url")))
    look = {"path": p, "type": F.lower("content_type"), "body": F.lower("body")}
    out = None
    for cls, score, where, needles in sorted(RULES, key=lambda r: -r[1]):
        cond = (F.col("depth") == 0) & p.isin("", "/") if where == "root" else _any(look[where], needles)
        value = F.struct(F.lit(cls).alias("class"), F.lit(score).alias("score"))
        out = F.when(F.coalesce(cond, F.lit(False)), value) if out is None else out.when(F.coalesce(cond, F.lit(False)), value)
    return out.otherwise(F.struct(F.lit("other").alias("class"), F.lit(0.0).alias("score")))


def classify(pages: DataFrame) -> DataFrame:
    return pages.select("seq", "url", page_class().alias("c")).select("seq", "url", "c.class", "c.score")


#: Category, technology, traces in the body, in asset addresses, and in headers (an empty text: presence).
SIGNATURES = [
    ("cms", "WordPress", ['<meta name="generator" content="WordPress', "/wp-content/"], ["/wp-content/"], []),
    ("cms", "Ghost", ['<meta name="generator" content="Ghost', "ghost-"], [], []),
    ("cms", "Hugo", ['<meta name="generator" content="Hugo'], [], []),
    ("cms", "Next.js", ["__NEXT_DATA__"], ["/_next/"], []),
    ("cms", "Gatsby", ["gatsby-"], ["/static/"], []),
    ("cms", "Astro", ['<meta name="generator" content="Astro'], [], []),
    ("cms", "Nuxt", ["__NUXT__"], ["/_nuxt/"], []),
    ("analytics", "Google Analytics", ["google-analytics.com", "gtag(", "ga("], [], []),
    ("analytics", "Google Tag Manager", ["googletagmanager.com"], [], []),
    ("analytics", "Plausible", ["plausible.io"], [], []),
    ("analytics", "Fathom", ["usefathom.com"], [], []),
    ("cdn", "Cloudflare", [], [], [("cf-ray", ""), ("server", "cloudflare")]),
    ("cdn", "Vercel", [], [], [("x-vercel-id", ""), ("server", "vercel")]),
    ("cdn", "Netlify", [], [], [("x-nf-request-id", ""), ("server", "netlify")]),
    ("cdn", "AWS CloudFront", [], [], [("x-amz-cf-id", "")]),
    ("cdn", "Fastly", [], [], [("x-served-by", "cache-")]),
    ("framework", "React", ["data-reactroot", "__REACT"], [], []),
    ("framework", "Vue", ["data-v-"], [], []),
    ("framework", "Tailwind CSS", [], ["tailwindcss"], []),
    ("framework", "Bootstrap", [], ["bootstrap"], []),
]


def _holds(needle: str):
    return lambda c: F.contains(F.lower(c), F.lit(needle.lower()))


def _trace(pairs: list[tuple[Column, str]]) -> Column:
    """The evidence of the first condition that holds, or null."""
    out = F.lit(None).cast("string")
    for cond, text in reversed(pairs):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(text)).otherwise(out)
    return out


def technologies(pages: DataFrame) -> DataFrame:
    """``(name, category, evidence)``: by body and assets of the first page, else by headers of the first page that has them.

    The signatures are folded into column expressions and the pages into one aggregate of a fixed
    number of values; there is no row per page and signature.
    """
    body = F.lower(F.coalesce("body", F.lit("")))
    assets = F.coalesce("assets", F.array().cast("array<string>"))
    aggs = []
    for i, (_, _, in_body, in_assets, in_headers) in enumerate(SIGNATURES):
        first = _trace(
            [(F.contains(body, F.lit(x.lower())), f"body contains {x}") for x in in_body]
            + [(F.exists(assets, _holds(x)), f"asset URL contains {x}") for x in in_assets]
        )
        heads = []
        for h, want in in_headers:
            values = F.try_element_at(F.col("headers"), F.lit(h))
            if want:
                heads.append((F.exists(values, _holds(want)), f"header {h} contains {want}"))
            else:
                heads.append((F.size(values) > 0, f"header {h} present"))
        aggs += [F.min_by(F.struct(first.alias("e")), "seq").alias(f"f{i}"), F.min_by(_trace(heads), F.when(_trace(heads).isNotNull(), F.col("seq"))).alias(f"h{i}")]
    g = pages.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.coalesce(F.col(f"f{i}.e"), F.col(f"h{i}")).alias("evidence")) for i, (c, n, *_) in enumerate(SIGNATURES)])
    return g.select(F.explode(rows).alias("t")).select("t.*").where("evidence IS NOT NULL").orderBy("category", "name")
