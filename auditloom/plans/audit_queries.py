"""Queries over the audit operators, over whole tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.checks import health, media, security, seo
from auditloom.functions.columns import authority, host
from auditloom.functions.features import with_features
from auditloom.model import ISSUE_COLS
from auditloom.operators.baseline import baseline_diff
from auditloom.operators import nested as N
from auditloom.plans import audit as A
from auditloom.plans import data_queries as D
from auditloom.rules.cel import Rule, rule_checks
from auditloom.session import map_arrow, scratch, table
from auditloom.site import classify, duplicates, graph, links, redirects, summary
from auditloom.sources import crawl, robots

RULES = [
    Rule("custom/missing-csp", "warning", "page.status_code == 200 && !('content-security-policy' in page.headers)", "no policy"),
    Rule("custom/secure-only", "info", "page.depth > 2 || page.in_sitemap == false", "deep or unlisted", "https://*/*"),
    Rule("custom/few-links", "info", "size(page.links) < 3 && page.content_type.startsWith('text/')", "few links"),
    Rule("custom/fragment-links", "critical", "page.links.exists(l, l.contains('#') && l.startsWith('http'))", "links with fragments"),
    Rule("custom/slow", "oops", "page.fetch_duration_ms > 1000 && size(page.body) >= 1000", "slow and large"),
]
ROBOTS = "User-agent: *\nDisallow: /*?id=\nAllow: /*?id=1\nDisallow: /info/\n\nUser-agent: other\nDisallow: /\n"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def _explode(df: DataFrame, col) -> DataFrame:
    return df.select(F.explode(col).alias("i")).select("i.*")


def seo_url_issues(spark, d):
    r = seo.url_reasons(F.col("url"))
    return _pages(spark, d).where(r != "").select("seq", "url", F.concat(F.lit("URL has issues: "), r).alias("message"))


def seo_issues(spark, d):
    return A.page_issues(with_features(_pages(spark, d)), {"seo": seo.checks}).groupBy("check_name", "severity").agg(F.count("*").alias("n"))


def title_issues(spark, d):
    f = A.page_issues(with_features(_pages(spark, d).select("url", "content_type", "body")), {"seo": seo.checks})
    return f.where(F.col("check_name").isin("seo/missing-title", "seo/title-length")).select("check_name", "message", "url")


def duplicate_titles(spark, d):
    p = with_features(_pages(spark, d).select("seq", "url", "content_type", "body"))
    return links.duplicate_titles(p.select("seq", "url", F.col("d.title").alias("title"))).select("message", "url")


def health_issues(spark, d):
    return _explode(_pages(spark, d).drop("body"), health.checks()).select("check_name", "severity", "url")


def security_header_issues(spark, d):
    p = _pages(spark, d).withColumn("d", F.lit(None).cast("struct<scripts:array<struct<src:string,integrity:boolean>>,css:array<struct<href:string,integrity:boolean>>>"))
    return _explode(p, security.checks()).where("check_name <> 'security/missing-sri'").select("check_name", "message", "url")


def all_page_issues(spark, d):
    return A.page_issues(with_features(_pages(spark, d)), {**A.PAGE_CHECKS, **A.EXTRA_PAGE_CHECKS}).groupBy("check_name", "severity").agg(F.count("*").alias("n"))


def full_audit(spark, d):
    return A.audit(_pages(spark, d), analysis=True).groupBy("check_name", "severity").agg(F.count("*").alias("n"))


def structured_data_issues(spark, d):
    return A.page_issues(with_features(_pages(spark, d)), {"structured-data": media.structured_data}).groupBy("check_name").agg(F.count("*").alias("n"))


def broken_internal(spark, d):
    return links.broken_internal(_pages(spark, d)).select("message", "url")


def orphan_pages(spark, d):
    return links.orphan_pages(_pages(spark, d)).select("url")


def deep_pages(spark, d):
    return links.deep_pages(_pages(spark, d)).select("message", "url")


def security_txt(spark, d):
    return links.missing_security_txt(_pages(spark, d)).select("check_name", "url")


def external_pairs(spark, d):
    return links.external_pairs(_pages(spark, d)).select("url", "src")


def external_targets(spark, d):
    return links.external_pairs(_pages(spark, d)).groupBy("url").agg(F.count("*").alias("n_sources"))


def crawl_budget(spark, d):
    return summary.crawl_budget_issues(_pages(spark, d)).select("check_name", "message")


def link_graph_edges(spark, d):
    return graph.graph(_pages(spark, d))[1]


def pagerank(spark, d):
    n, e = graph.graph(_pages(spark, d))
    return graph.pagerank(n, e).select("url", F.round("rank", 9).alias("rank"))


def low_pagerank(spark, d):
    n, e = graph.graph(_pages(spark, d))
    return graph.low_rank_issues(graph.pagerank(n, e)).select("check_name", "url")


def high_outgoing(spark, d):
    return graph.high_outgoing_issues(graph.graph(_pages(spark, d))[1], most=20).select("message", "url")


def graph_size(spark, d):
    return graph.graph_size(*graph.graph(_pages(spark, d)))


def redirect_map(spark, d):
    return redirects.redirect_map(_pages(spark, d)).select("from", "to", F.array_join("chain", " -> ").alias("chain"), F.col("hops").cast("long").alias("hops"))


def redirect_issues(spark, d):
    return redirects.redirect_issues(_pages(spark, d)).select("check_name", "message", "url")


def classify_pages(spark, d):
    return classify.classify(_pages(spark, d)).select("seq", "class", "score")


def tech_detect(spark, d):
    return classify.technologies(_pages(spark, d))


def _documents(spark, d):
    t = table(spark, d, "documents")
    return duplicates.body_classes(t.select("doc_id", "text"), key="doc_id", body="text", text="text", url="text").drop("url")


def exact_duplicate_classes(spark, d):
    c = _documents(spark, d)
    g = c.groupBy("sha").agg(F.min("seq").alias("class_rep"), F.count("*").alias("copies"))
    return c.join(g, "sha").select(F.col("seq").alias("doc_id"), "class_rep", "copies")


def near_duplicate_pairs(spark, d):
    return duplicates.near_pairs(_documents(spark, d)).select("seq_a", "seq_b", "distance")


def thin_content(spark, d):
    return _documents(spark, d).where(F.col("n_words") < duplicates.THIN).select(F.col("seq").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"))


def _issues(spark, d):
    return table(spark, d, "baseline_issues").select("seq", "baseline_id", "site", *ISSUE_COLS)


def issue_summary(spark, d):
    return summary.by_severity(_issues(spark, d))


def issue_categories(spark, d):
    return summary.by_category(_issues(spark, d))


def health_score(spark, d):
    i = _issues(spark, d)
    one = i.groupBy("baseline_id").agg(F.greatest(F.lit(0), F.lit(100) - F.sum(F.when(F.col("severity") == "critical", 10).when(F.col("severity") == "warning", 3).when(F.col("severity") == "info", 1).otherwise(0))).alias("score"))
    return one.select("baseline_id", F.col("score").cast("long").alias("score"))


def category_scores(spark, d):
    return summary.health_scores(_issues(spark, d)).select("category", F.col("score").cast("long").alias("score"))


def top_urls(spark, d):
    return summary.top_urls(_issues(spark, d))


def filtered_issues(spark, d):
    return summary.filter_issues(_issues(spark, d), ["critical", " Warning"], ["SEO", "links "]).select("check_name", "severity", "url", "message")


def grouped_issues(spark, d):
    return summary.group_issues(_issues(spark, d), "category").select("key", "n")


def first_last_diff(spark, d):
    """Issues of each seed's last snapshot against its first, as multisets."""
    b = table(spark, d, "baselines")
    ends = b.groupBy("seed_url").agg(F.min_by("baseline_id", F.struct("created_at", "baseline_id")).alias("a"), F.max_by("baseline_id", F.struct("created_at", "baseline_id")).alias("z")).where("a <> z")
    i = _issues(spark, d)
    old = i.join(ends.select(F.col("a").alias("baseline_id")), "baseline_id", "left_semi")
    new = i.join(ends.select(F.col("z").alias("baseline_id")), "baseline_id", "left_semi")
    return baseline_diff(new, old).groupBy("status", "check_name", "url").agg(F.count("*").alias("n"))


def cel_rules(spark, d):
    return _explode(_pages(spark, d), rule_checks(RULES)).select("check_name", "severity", "url")


def robots_decision(spark, d):
    p = _pages(spark, d)
    files = p.select(host(F.col("url")).alias("host")).distinct().withColumn("text", F.lit(ROBOTS))
    return robots.decide(p, robots.robots_rules(files, "auditloom/1.0"))


def _seed(p: DataFrame) -> str:
    """The page with the most links, the first of equals."""
    return p.where("url IS NOT NULL").orderBy(F.coalesce(F.size("links"), F.lit(0)).desc(), "seq").select("url").first()[0]


def frontier_level(spark, d):
    """What a crawl from the page with the most links would ask next: unseen links of its host, first place first."""
    p = _pages(spark, d)
    found = p.select(F.posexplode("links").alias("k", "url"), F.col("seq").alias("s"), (F.col("depth") + 1).alias("depth")).select("url", "depth", (F.col("s") * 100_000 + F.col("k")).alias("seq"))
    seen = p.select("url", "depth", F.col("seq")).where("url IS NOT NULL").dropDuplicates(["url"])
    seed = _seed(p)
    return crawl.add_to_frontier(seen, found, seed, 10_000_000, 99).select("url", F.col("depth").cast("long").alias("depth"))


def offline_crawl(spark, d):
    """A breadth-first crawl over the stored pages from the page with the most links, to the default depth and as the robots rules allow."""
    p = _pages(spark, d).where("url IS NOT NULL")
    p = p.join(p.groupBy("url").agg(F.min("seq").alias("seq")), ["url", "seq"], "left_semi")
    seed = _seed(p)
    files = p.select(F.lower(authority(F.col("url"))).alias("host")).distinct().withColumn("text", F.lit(ROBOTS))
    return crawl.crawl(spark, seed, crawl.table_fetcher(p), max_pages=None, robots=files).select("url", "depth")


def body_links(spark, d):
    """Links and assets read from the bodies' start tags, counted per page."""
    src = _pages(spark, d).where(F.coalesce(F.contains("content_type", F.lit("text/html")), F.lit(False))).select("seq", "url", "body")

    def each(batches):
        import pyarrow as pa

        from auditloom.functions.dom import links_and_assets

        for b in batches:
            got = [links_and_assets(x or "", u or "") for x, u in zip(b.column("body").to_pylist(), b.column("url").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("seq"), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([len(g[1]) for g in got], pa.int64())], names=["seq", "n_links", "n_assets"])

    return map_arrow(src, each, "seq long, n_links long, n_assets long")


def _scores(spark, d):
    return N.flat_table(N.flatten(table(spark, d, "crawl_results")), "lighthouse")


def speed_summary(spark, d):
    s = summary.speed_summary(_scores(spark, d))
    return s.select("n", *[F.round(c, 6).alias(c) for c in s.columns[1:]])


def slowest_pages(spark, d):
    return summary.slowest(_scores(spark, d))


def speed_issues(spark, d):
    s = _scores(spark, d)
    return links.union_issues(_explode(s, media.lighthouse()), summary.speed_issues(s)).groupBy("check_name", "severity").agg(F.count("*").alias("n"))


#: Checks that the regular markup of the stored bodies lets SQL decide.
DOM_CHECKS = [
    "seo/missing-meta-description", "seo/meta-description-length", "seo/missing-h1", "seo/multiple-h1", "seo/missing-canonical", "seo/multiple-canonical", "seo/missing-lang", "seo/missing-og-title", "seo/missing-og-description",
    "seo/missing-og-image", "seo/missing-twitter-card", "seo/missing-viewport", "performance/large-html", "performance/no-compression", "performance/render-blocking-script", "performance/excessive-css",
    "performance/render-blocking-css", "performance/missing-resource-hints", "performance/missing-cache-headers", "performance/no-http2", "security/missing-sri", "accessibility/missing-skip-nav",
    "accessibility/heading-hierarchy", "accessibility/missing-table-header", "accessibility/missing-landmarks", "images/legacy-format", "images/missing-lazy-loading", "images/missing-dimensions", "images/missing-responsive",
    "links/generic-anchor-text", "links/excessive-links", "structured-data/missing-json-ld", "content/no-paragraphs", "content/heading-hierarchy-skip",
]


def dom_issues(spark, d):
    """Every issue of these checks, row by row."""
    f = A.page_issues(with_features(_pages(spark, d)), {**A.PAGE_CHECKS, **A.EXTRA_PAGE_CHECKS})
    return f.where(F.col("check_name").isin(*DOM_CHECKS)).select("check_name", "severity", "message", "url")


def lighthouse_issues(spark, d):
    return _explode(_scores(spark, d), media.lighthouse()).select("check_name", "severity", "message", "url")


def noindex_listed(spark, d):
    return links.noindex_in_sitemap(with_features(_pages(spark, d).select("url", "content_type", "body", "in_sitemap"))).select("check_name", "url")


def target_sources(spark, d):
    """External targets with the pages that name them, as the report shows them."""
    return links.external_targets(_pages(spark, d)).select("url", "block", F.array_join("sources", " ").alias("sources"))


def redirect_rows(spark, d):
    return redirects.redirect_csv(_pages(spark, d)).select("from", "to", "chain", F.col("hops").cast("long").alias("hops"), "linked_by")


def _sink(kind):
    def run(spark, d):
        """All issues written by Spark in this form and read back."""
        from auditloom.report.writers import write_issues

        at = scratch(spark)
        write_issues(_issues(spark, d), at, kind)
        r = spark.read.schema(", ".join(f"{c} string" for c in ISSUE_COLS))
        back = r.option("header", True).option("escape", '"').csv(at) if kind == "csv" else r.json(at) if kind == "jsonl" else r.parquet(at)
        return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ISSUE_COLS])

    run.__name__ = f"sink_{kind}"
    return run


def stored_cache(spark, d):
    """The crawl cache of all pages, saved and loaded again."""
    at = scratch(spark)
    crawl.save_cache(crawl.cache_rows(_pages(spark, d)), at)
    return crawl.load_cache(spark, at)


def stored_baseline(spark, d):
    """All issues saved as a baseline, loaded again, and compared with themselves: everything exists already."""
    from auditloom.operators.baseline import load_baseline, save_baseline

    at = scratch(spark)
    save_baseline(_issues(spark, d), at, "https://site.example")
    return baseline_diff(_issues(spark, d), load_baseline(spark, at)).groupBy("status", "check_name").agg(F.count("*").alias("n"))


def changed_since_cache(spark, d):
    """Of pages fetched again, those whose content differs from the first fetch."""
    p = _pages(spark, d).where("url IS NOT NULL")
    first = p.groupBy("url").agg(F.min("seq").alias("seq"))
    old = p.join(first, ["url", "seq"], "left_semi")
    new = p.join(first, ["url", "seq"], "left_anti")
    return crawl.changed_pages(new, crawl.cache_rows(old)).select("seq", "url")


def stream_page_issues(spark, d):
    """Header checks over the pages as a file stream, written batch by batch and read back."""
    from auditloom.streaming.stream import page_stream

    at = scratch(spark)
    found = _explode(page_stream(spark, d, name="pages.parquet"), health.checks())
    q = found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{at}/out").groupBy("check_name").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    seo_url_issues, seo_issues, title_issues, duplicate_titles, health_issues, security_header_issues, all_page_issues, full_audit, structured_data_issues, broken_internal,
    orphan_pages, deep_pages, security_txt, external_pairs, external_targets, crawl_budget, link_graph_edges, pagerank, low_pagerank, high_outgoing, graph_size, redirect_map,
    redirect_issues, classify_pages, tech_detect, exact_duplicate_classes, near_duplicate_pairs, thin_content, issue_summary, issue_categories, health_score, category_scores,
    top_urls, filtered_issues, grouped_issues, first_last_diff, cel_rules, robots_decision, frontier_level, offline_crawl, body_links, speed_summary, slowest_pages, speed_issues,
    changed_since_cache, stream_page_issues, dom_issues, lighthouse_issues, noindex_listed, target_sources, redirect_rows, _sink("csv"), _sink("jsonl"), _sink("parquet"), stored_cache, stored_baseline,
)}

_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
_HOST = r"lower(regexp_replace(regexp_extract({}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), ':\d*$', ''))"
_AUTH = r"lower(regexp_extract({}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1))"
_H = "coalesce(headers['{}'][1], '')"
_TITLES = """titles AS (SELECT seq, url, CASE WHEN body LIKE '%<title>%' THEN replace(replace(replace(replace(replace(regexp_extract(body, '<title>([^<]*)</title>', 1),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') END AS title
    FROM pages WHERE content_type LIKE '%text/html%')"""
_REASONS = f"""array_to_string(list_filter([
    CASE WHEN strlen(url) > 100 THEN 'length is ' || strlen(url) || ' characters (>100)' END,
    CASE WHEN contains({_PATH}, '_') THEN 'path contains underscores' END,
    CASE WHEN {_PATH} <> lower({_PATH}) THEN 'path contains uppercase letters' END], lambda x: x IS NOT NULL), ', ')"""
_EDGES = f"""nodes AS (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL),
raw AS (SELECT url AS src, unnest(links) AS dst FROM pages),
edges AS (SELECT src, dst, count(*) AS n FROM raw WHERE src <> dst AND {_AUTH.format('src')} = {_AUTH.format('dst')} AND dst IN (SELECT url FROM nodes) GROUP BY ALL)"""


def _pagerank_sql(last: str) -> str:
    parts = [f"WITH {_EDGES}, total AS (SELECT count(*) AS c FROM nodes), outs AS (SELECT src, sum(n) AS o FROM edges GROUP BY src), r0 AS (SELECT url, 1.0::DOUBLE / c AS rank FROM nodes, total)"]
    for k in range(graph.ITERATIONS):
        parts.append(
            f"r{k + 1} AS MATERIALIZED (SELECT nodes.url, 0.15::DOUBLE / c + 0.85::DOUBLE * (coalesce(g, 0) + lost / c) AS rank FROM nodes CROSS JOIN total "
            f"CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE url NOT IN (SELECT src FROM outs)) "
            f"LEFT JOIN (SELECT dst, sum(rank * n / o) AS g FROM edges JOIN r{k} ON r{k}.url = edges.src JOIN outs ON outs.src = edges.src GROUP BY dst) x ON x.dst = nodes.url)"
        )
    return ", ".join(parts) + " " + last.replace("RANKS", f"r{graph.ITERATIONS}")


_ENDS = """WITH ends AS (SELECT seed_url, arg_min(baseline_id, (created_at, baseline_id)) AS a, arg_max(baseline_id, (created_at, baseline_id)) AS z FROM baselines GROUP BY 1),
o AS (SELECT check_name, url, count(*) AS n FROM baseline_issues WHERE baseline_id IN (SELECT a FROM ends WHERE a <> z) GROUP BY ALL),
c AS (SELECT check_name, url, count(*) AS n FROM baseline_issues WHERE baseline_id IN (SELECT z FROM ends WHERE a <> z) GROUP BY ALL),
j AS (SELECT coalesce(c.check_name, o.check_name) AS check_name, coalesce(c.url, o.url) AS url, coalesce(c.n, 0) AS n, coalesce(o.n, 0) AS m FROM c FULL JOIN o ON c.check_name = o.check_name AND c.url = o.url)"""


def _crawl_sql(depth: int) -> str:
    """Levels of a breadth-first crawl one by one; what the robots rules disallow is seen but not fetched."""
    target = r"regexp_extract(t.url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)', 1)"
    parts = ["""WITH s AS (SELECT arg_min(url, (-coalesce(len(links), 0), seq)) AS seed FROM pages WHERE url IS NOT NULL),
        p AS (SELECT url, arg_min(coalesce(links, []), seq) AS links FROM pages WHERE url IS NOT NULL GROUP BY url),
        l AS MATERIALIZED (SELECT url AS src, unnest(links) AS url FROM p), t0 AS (SELECT seed AS url FROM s)"""]
    for k in range(depth + 1):
        parts.append(rf"g{k} AS MATERIALIZED (SELECT p.url FROM t{k} AS t JOIN p ON p.url = t.url WHERE regexp_matches({target}, '^/.*\?id=1') OR NOT (regexp_matches({target}, '^/.*\?id=') OR starts_with({target}, '/info/')))")
        seen = " UNION ALL ".join(f"SELECT url FROM t{i}" for i in range(k + 1))
        parts.append(f"t{k + 1} AS MATERIALIZED (SELECT DISTINCT l.url FROM g{k} JOIN l ON l.src = g{k}.url, s WHERE {_AUTH.format('l.url')} = {_AUTH.format('s.seed')} AND l.url NOT IN ({seen}))")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT url, {k}::INTEGER AS depth FROM g{k}" for k in range(depth + 1))


_CHAIN = "coalesce(redirect_chain, [])"
_W = "WHEN lower(severity) = '{}' THEN {}"
SQL = {
    "seo_url_issues": f"SELECT seq, url, 'URL has issues: ' || {_REASONS} AS message FROM pages WHERE {_REASONS} <> ''",
    "title_issues": f"""WITH {_TITLES} SELECT 'seo/missing-title' AS check_name, 'page is missing a <title> tag' AS message, url FROM titles WHERE title IS NULL
        UNION ALL SELECT 'seo/title-length', 'title length is ' || strlen(title) || ' characters, expected 30-60', url FROM titles WHERE strlen(title) < 30 OR strlen(title) > 60""",
    "duplicate_titles": f"""WITH {_TITLES} SELECT 'title "' || replace(replace(trim(title), chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '" is shared by ' || count(*) || ' pages' AS message, arg_min(url, seq) AS url
        FROM titles WHERE trim(title) <> '' GROUP BY trim(title) HAVING count(*) > 1""",
    "health_issues": f"""
        SELECT 'health/4xx' AS check_name, 'critical' AS severity, url FROM pages WHERE status_code BETWEEN 400 AND 499
        UNION ALL SELECT 'health/5xx', 'critical', url FROM pages WHERE status_code BETWEEN 500 AND 599
        UNION ALL SELECT 'health/redirect-chain', 'warning', url FROM pages WHERE len({_CHAIN}) > 2
        UNION ALL SELECT 'health/redirect-loop', 'critical', url FROM pages WHERE list_contains({_CHAIN}, url)
        UNION ALL SELECT 'health/slow-ttfb', 'warning', url FROM pages WHERE fetch_duration_ns > 2000000000
        UNION ALL SELECT 'health/mixed-content', 'warning', url FROM pages WHERE url LIKE 'https://%' AND len(list_filter(coalesce(assets, []), lambda a: a LIKE 'http://%')) > 0
        UNION ALL SELECT 'health/server-version-leak', 'info', url FROM pages WHERE regexp_matches({_H.format('server')}, '\\d+\\.\\d+')
        UNION ALL SELECT 'health/https-redirect-not-permanent', 'warning', url FROM pages WHERE url LIKE 'https://%' AND redirect_chain[1] LIKE 'http://%' AND status_code IN (302, 307)
        UNION ALL SELECT 'health/missing-charset', 'warning', url FROM pages WHERE lower(content_type) LIKE '%text/html%' AND lower(content_type) NOT LIKE '%charset%'""",
    "security_header_issues": f"""
        WITH p AS (SELECT *, {_H.format('strict-transport-security')} AS sts, {_H.format('content-security-policy')} AS csp, {_H.format('x-content-type-options')} AS xcto,
            {_H.format('x-frame-options')} AS xfo, {_H.format('referrer-policy')} AS rp, {_H.format('permissions-policy')} AS pp, {_H.format('access-control-allow-origin')} AS ac FROM pages WHERE status_code = 200),
        k AS (SELECT url, unnest(headers['set-cookie']) AS raw FROM pages WHERE status_code = 200),
        m AS (SELECT url, raw, array_to_string(list_filter([CASE WHEN NOT contains(lower(raw), 'httponly') THEN 'HttpOnly' END, CASE WHEN NOT contains(lower(raw), 'secure') THEN 'Secure' END,
            CASE WHEN NOT contains(lower(raw), 'samesite') THEN 'SameSite' END], lambda x: x IS NOT NULL), ', ') AS gone FROM k)
        SELECT 'security/missing-strict-transport-security' AS check_name, 'HTTPS page is missing the Strict-Transport-Security header' AS message, url FROM p WHERE url LIKE 'https://%' AND sts = ''
        UNION ALL SELECT 'security/weak-hsts', 'HSTS max-age is ' || regexp_extract(lower(sts), 'max-age=(\\d+)', 1) || ' seconds, recommended minimum is 31536000 (1 year)', url FROM p
            WHERE url LIKE 'https://%' AND regexp_matches(lower(sts), 'max-age=\\d+') AND CAST(regexp_extract(lower(sts), 'max-age=(\\d+)', 1) AS BIGINT) < 31536000
        UNION ALL SELECT 'security/missing-content-security-policy', 'page is missing the Content-Security-Policy header', url FROM p WHERE csp = ''
        UNION ALL SELECT 'security/csp-unsafe', 'Content-Security-Policy contains ' || array_to_string(list_filter([CASE WHEN contains(csp, '''unsafe-inline''') THEN '''unsafe-inline''' END,
            CASE WHEN contains(csp, '''unsafe-eval''') THEN '''unsafe-eval''' END], lambda x: x IS NOT NULL), ' and '), url FROM p WHERE contains(csp, '''unsafe-inline''') OR contains(csp, '''unsafe-eval''')
        UNION ALL SELECT 'security/missing-x-content-type-options', 'page is missing X-Content-Type-Options: nosniff', url FROM p WHERE lower(xcto) <> 'nosniff'
        UNION ALL SELECT 'security/missing-x-frame-options', 'page is missing X-Frame-Options (expected DENY or SAMEORIGIN)', url FROM p WHERE upper(xfo) NOT IN ('DENY', 'SAMEORIGIN')
        UNION ALL SELECT 'security/missing-referrer-policy', 'page is missing the Referrer-Policy header', url FROM p WHERE rp = ''
        UNION ALL SELECT 'security/insecure-referrer-policy', 'Referrer-Policy "' || lower(trim(rp)) || '" leaks the full URL on cross-origin requests', url FROM p WHERE lower(trim(rp)) IN ('unsafe-url', 'no-referrer-when-downgrade')
        UNION ALL SELECT 'security/missing-permissions-policy', 'page is missing the Permissions-Policy header', url FROM p WHERE pp = ''
        UNION ALL SELECT 'security/insecure-cookies', 'cookie "' || trim(split_part(raw, '=', 1)) || '" is missing ' || gone || ' flag(s)', url FROM m WHERE gone <> ''
        UNION ALL SELECT 'security/cors-wildcard', 'Access-Control-Allow-Origin is set to wildcard (*)', url FROM p WHERE trim(ac) = '*'""",
    "broken_internal": """SELECT 'broken internal link (HTTP ' || p.status_code || '), linked from ' || l.src AS message, p.url FROM (SELECT url AS src, unnest(links) AS dst FROM pages) l
        JOIN pages p ON p.url = l.dst WHERE p.status_code BETWEEN 400 AND 599""",
    "orphan_pages": "SELECT url FROM pages WHERE depth <> 0 AND url NOT IN (SELECT dst FROM (SELECT unnest(links) AS dst FROM pages) WHERE dst IS NOT NULL)",
    "deep_pages": "SELECT 'page is at depth ' || depth || ', maximum recommended is 4' AS message, url FROM pages WHERE depth > 4",
    "security_txt": "SELECT 'security/missing-security-txt' AS check_name, coalesce(arg_min(url, seq), '') AS url FROM pages HAVING NOT coalesce(bool_or(suffix(url, '/.well-known/security.txt')), false)",
    "external_pairs": f"""WITH e AS (SELECT url AS src, unnest(list_concat(coalesce(links, []), coalesce(assets, []))) AS url FROM pages)
        SELECT DISTINCT e.url, src FROM e WHERE {_HOST.format('e.url')} <> '' AND {_HOST.format('e.url')} <> (SELECT {_HOST.format('arg_min(url, seq)')} FROM pages)""",
    "external_targets": f"""WITH e AS (SELECT url AS src, unnest(list_concat(coalesce(links, []), coalesce(assets, []))) AS url FROM pages)
        SELECT e.url, count(DISTINCT src) AS n_sources FROM e WHERE {_HOST.format('e.url')} <> '' AND {_HOST.format('e.url')} <> (SELECT {_HOST.format('arg_min(url, seq)')} FROM pages) GROUP BY e.url""",
    "crawl_budget": """WITH g AS (SELECT count(*) AS n, count(*) FILTER (depth > 3) AS deep, count(*) FILTER (contains(url, '?')) AS params, avg(coalesce(len(links), 0)) AS links,
            count(*) FILTER (NOT coalesce(in_sitemap, false)) AS gap FROM pages)
        SELECT 'crawl-budget/deep-pages' AS check_name, deep || ' of ' || n || ' pages (' || printf('%.0f', deep * 100.0 / n) || '%) are at depth > 3' AS message FROM g WHERE deep > 0.1 * n
        UNION ALL SELECT 'crawl-budget/parameter-urls', params || ' URLs contain query parameters that could waste crawl budget' FROM g WHERE params > 0
        UNION ALL SELECT 'crawl-budget/low-internal-links', 'average internal links per page is ' || printf('%.1f', links) || ', recommended minimum is 3' FROM g WHERE links < 3
        UNION ALL SELECT 'crawl-budget/large-sitemap-gap', gap || ' of ' || n || ' crawled pages (' || printf('%.0f', gap * 100.0 / n) || '%) are not in the sitemap' FROM g WHERE gap > 0.2 * n""",
    "link_graph_edges": f"WITH {_EDGES} SELECT src, dst, n FROM edges",
    "graph_size": f"WITH {_EDGES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM edges) AS edges",
    "high_outgoing": f"WITH {_EDGES} SELECT 'page has ' || CAST(sum(n) AS BIGINT) || ' outgoing internal links, maximum recommended is 20' AS message, src AS url FROM edges GROUP BY src HAVING sum(n) > 20",
    "pagerank": _pagerank_sql("SELECT url, round(rank, 9) AS rank FROM RANKS"),
    "redirect_map": "SELECT redirect_chain[1] AS \"from\", url AS \"to\", array_to_string(list_append(redirect_chain, url), ' -> ') AS chain, len(redirect_chain) AS hops FROM pages WHERE len(redirect_chain) > 0",
    "redirect_issues": """WITH r AS (SELECT redirect_chain[1] AS f, url AS t, array_to_string(list_append(redirect_chain, url), ' -> ') AS chain, len(redirect_chain) AS hops FROM pages WHERE len(redirect_chain) > 0),
        l AS (SELECT DISTINCT url AS src, unnest(links) AS f FROM pages)
        SELECT 'redirects/long-chain' AS check_name, 'redirect chain has ' || hops || ' hops (' || chain || ')' AS message, f AS url FROM r WHERE hops > 2
        UNION ALL SELECT 'redirects/internal-redirect', 'links to ' || r.f || ' which redirects to ' || t || ' (update link to final URL)', src FROM l JOIN r ON l.f = r.f
        UNION ALL SELECT 'redirects/redirect-to-redirect', 'redirects to ' || t || ' which is itself a redirect', f FROM r WHERE t IN (SELECT f FROM r)""",
    "classify_pages": f"""WITH p AS (SELECT *, lower({_PATH}) AS pth, lower(coalesce(body, '')) AS b FROM pages)
        SELECT seq, c.class AS class, c.score AS score FROM (SELECT seq, CASE
            WHEN depth = 0 AND pth IN ('', '/') THEN {{'class': 'homepage', 'score': 0.9::DOUBLE}}
            WHEN contains(pth, '/api/') THEN {{'class': 'api', 'score': 0.9::DOUBLE}}
            WHEN contains(lower(content_type), 'application/json') THEN {{'class': 'api', 'score': 0.8::DOUBLE}}
            WHEN contains(pth, '/contact') THEN {{'class': 'contact', 'score': 0.8::DOUBLE}}
            WHEN contains(pth, '/about') THEN {{'class': 'about', 'score': 0.8::DOUBLE}}
            WHEN contains(pth, '/privacy') OR contains(pth, '/terms') OR contains(pth, '/legal') OR contains(pth, '/cookie') THEN {{'class': 'legal', 'score': 0.8::DOUBLE}}
            WHEN contains(pth, '/blog/') OR contains(pth, '/post/') OR contains(pth, '/article/') THEN {{'class': 'blog', 'score': 0.7::DOUBLE}}
            WHEN contains(pth, '/product/') OR contains(pth, '/shop/') OR contains(pth, '/item/') THEN {{'class': 'product', 'score': 0.7::DOUBLE}}
            WHEN contains(pth, '/category/') OR contains(pth, '/tag/') OR contains(pth, '/collection/') THEN {{'class': 'category', 'score': 0.7::DOUBLE}}
            WHEN contains(b, '"@type":"product"') OR contains(b, '"@type": "product"') OR contains(b, 'itemtype="http://schema.org/product"') OR contains(b, 'itemtype="https://schema.org/product"') THEN {{'class': 'product', 'score': 0.5::DOUBLE}}
            WHEN contains(b, '<article') THEN {{'class': 'blog', 'score': 0.3::DOUBLE}}
            ELSE {{'class': 'other', 'score': 0.0::DOUBLE}} END AS c FROM p)""",
    "exact_duplicate_classes": "SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS class_rep, count(*) OVER (PARTITION BY coalesce(text, '')) AS copies FROM documents",
    "thin_content": r"""SELECT doc_id, n_words FROM (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')) AS n_words FROM documents) WHERE n_words < 100""",
    "issue_summary": "SELECT s AS severity, count(b.severity) AS n FROM (SELECT unnest(['critical', 'warning', 'info']) AS s) LEFT JOIN baseline_issues b ON b.severity = s GROUP BY s UNION ALL SELECT severity, count(*) FROM baseline_issues WHERE severity NOT IN ('critical', 'warning', 'info') GROUP BY 1",
    "issue_categories": "SELECT split_part(check_name, '/', 1) AS category, count(*) AS n FROM baseline_issues GROUP BY 1",
    "grouped_issues": "SELECT split_part(check_name, '/', 1) AS key, count(*) AS n FROM baseline_issues GROUP BY 1",
    "health_score": "SELECT baseline_id, CAST(greatest(0, 100 - sum(CASE severity WHEN 'critical' THEN 10 WHEN 'warning' THEN 3 WHEN 'info' THEN 1 ELSE 0 END)) AS BIGINT) AS score FROM baseline_issues GROUP BY 1",
    "category_scores": """WITH x AS (SELECT split_part(check_name, '/', 1) AS p, CASE severity WHEN 'critical' THEN 10 WHEN 'warning' THEN 3 WHEN 'info' THEN 1 ELSE 0 END AS w FROM baseline_issues),
        y AS (SELECT CASE p WHEN 'hreflang' THEN 'seo' WHEN 'tls' THEN 'security' WHEN 'external-links' THEN 'links' ELSE p END AS category, w FROM x UNION ALL SELECT 'overall', w FROM x)
        SELECT c AS category, CAST(greatest(0, 100 - coalesce(sum(w), 0)) AS BIGINT) AS score
        FROM (SELECT unnest(['overall', 'seo', 'health', 'performance', 'security', 'accessibility', 'links', 'images', 'structured-data', 'content']) AS c) LEFT JOIN y ON y.category = c GROUP BY c""",
    "top_urls": "SELECT url, count(*) AS n FROM baseline_issues GROUP BY 1 ORDER BY n DESC, url LIMIT 10",
    "filtered_issues": "SELECT check_name, severity, url, message FROM baseline_issues WHERE severity IN ('critical', 'warning') AND split_part(check_name, '/', 1) IN ('seo', 'links')",
    "first_last_diff": _ENDS + """ SELECT 'existing' AS status, check_name, url, least(n, m) AS n FROM j WHERE least(n, m) > 0
        UNION ALL SELECT 'new', check_name, url, n - m FROM j WHERE n > m UNION ALL SELECT 'resolved', check_name, url, m - n FROM j WHERE m > n""",
    "cel_rules": """SELECT 'custom/missing-csp' AS check_name, 'warning' AS severity, url FROM pages WHERE status_code = 200 AND NOT coalesce(list_contains(map_keys(headers), 'content-security-policy'), false)
        UNION ALL SELECT 'custom/secure-only', 'info', url FROM pages WHERE regexp_matches(url, '^https://[^/]*/[^/]*$') AND (depth > 2 OR NOT coalesce(in_sitemap, false))
        UNION ALL SELECT 'custom/few-links', 'info', url FROM pages WHERE coalesce(len(links), 0) < 3 AND coalesce(content_type, '') LIKE 'text/%'
        UNION ALL SELECT 'custom/fragment-links', 'critical', url FROM pages WHERE len(list_filter(coalesce(links, []), lambda l: contains(l, '#') AND l LIKE 'http%')) > 0
        UNION ALL SELECT 'custom/slow', '', url FROM pages WHERE fetch_duration_ns // 1000000 > 1000 AND length(coalesce(body, '')) >= 1000""",
    "robots_decision": r"""WITH u AS (SELECT DISTINCT url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)', 1) AS p FROM pages WHERE url IS NOT NULL)
        SELECT url, CASE WHEN regexp_matches(p, '^/.*\?id=1') THEN true WHEN regexp_matches(p, '^/.*\?id=') THEN false WHEN starts_with(p, '/info/') THEN false ELSE true END AS allowed FROM u""",
    "near_duplicate_pairs": r"""WITH d AS (SELECT coalesce(text, '') AS t, min(doc_id) AS seq FROM documents GROUP BY 1),
        w AS (SELECT seq, unnest(list_filter(string_split_regex(t, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')) AS w FROM d),
        u AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM w),
        h AS (SELECT w, list_reduce(list_transform(range(0, CAST(strlen(x) / 2 AS BIGINT)), lambda i: CAST(CAST('0x' || substr(x, 2 * i + 1, 2) AS INTEGER) AS HUGEINT)),
            lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT) AS h FROM u),
        bits AS (SELECT seq, k, sum(CASE WHEN (h // power(2::HUGEINT, k)::HUGEINT) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM w JOIN h ON w.w = h.w CROSS JOIN range(64) r(k) GROUP BY seq, k),
        sim AS (SELECT d.seq, coalesce(sum(CASE WHEN v > 0 THEN power(2::HUGEINT, k)::HUGEINT ELSE 0 END), 0)::HUGEINT AS sim FROM d LEFT JOIN bits ON bits.seq = d.seq GROUP BY d.seq),
        reps AS (SELECT sim, min(seq) AS seq FROM sim GROUP BY sim)
        SELECT a.seq AS seq_a, b.seq AS seq_b, CAST(bit_count(xor(a.sim, b.sim)) AS INTEGER) AS distance FROM reps a JOIN reps b ON a.seq < b.seq WHERE bit_count(xor(a.sim, b.sim)) <= 3
        UNION ALL SELECT r.seq, s.seq, 0 FROM sim s JOIN reps r ON r.sim = s.sim WHERE s.seq <> r.seq""",
    "speed_summary": D._FLAT + f""", t AS ({D._table_sql('lighthouse')}) SELECT count(*) AS n, round(coalesce(avg(coalesce(performance_score, 0)), 0), 6) AS avg_performance, round(coalesce(avg(coalesce(accessibility_score, 0)), 0), 6) AS avg_accessibility,
        round(coalesce(avg(coalesce(best_practices_score, 0)), 0), 6) AS avg_best_practices, round(coalesce(avg(coalesce(seo_score, 0)), 0), 6) AS avg_seo, round(coalesce(avg(CASE WHEN performance_score >= 90 THEN 100.0::DOUBLE ELSE 0 END), 0), 6) AS pass_rate FROM t""",
    "slowest_pages": D._FLAT + f", t AS ({D._table_sql('lighthouse')}) SELECT url, performance_score AS score FROM t ORDER BY score NULLS FIRST, url LIMIT 5",
    "low_pagerank": _pagerank_sql(
        "SELECT 'links/low-internal-pagerank' AS check_name, url FROM RANKS WHERE rank <= (SELECT rank FROM (SELECT rank, row_number() OVER (ORDER BY rank) AS rn FROM RANKS) WHERE rn = (SELECT CAST(floor(0.1 * count(*)) AS BIGINT) + 1 FROM RANKS))"
    ),
    "offline_crawl": _crawl_sql(5),
    "changed_since_cache": """WITH f AS (SELECT seq, url, fetched_at, coalesce(headers['etag'][1], '') AS e, coalesce(body, '') AS b, min(seq) OVER (PARTITION BY url) AS s0 FROM pages WHERE url IS NOT NULL),
        o AS (SELECT url, e, b FROM f WHERE seq = s0),
        n AS (SELECT url, arg_max(e, (fetched_at, seq)) AS e, arg_max(b, (fetched_at, seq)) AS b FROM f WHERE seq <> s0 GROUP BY url),
        c AS (SELECT n.url FROM n JOIN o ON n.url = o.url WHERE CASE WHEN n.e <> '' AND o.e <> '' THEN n.e <> o.e ELSE n.b <> o.b END)
        SELECT seq, url FROM f WHERE seq <> s0 AND url IN (SELECT url FROM c)""",
    "frontier_level": f"""WITH f AS (SELECT url AS src, seq, depth + 1 AS depth, unnest(links) AS dst, generate_subscripts(links, 1) AS k FROM pages)
        SELECT dst AS url, CAST(arg_min(depth, (seq, k)) AS BIGINT) AS depth FROM f WHERE dst NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)
        AND {_AUTH.format('dst')} = (SELECT {_AUTH.format('arg_min(url, (-coalesce(len(links), 0), seq))')} FROM pages WHERE url IS NOT NULL) GROUP BY dst""",
}
SQL["stream_page_issues"] = f"SELECT check_name, count(*) AS n FROM ({SQL['health_issues']}) GROUP BY 1"
_TEXT = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"
_IMG_EXT = r"lower(regexp_extract(regexp_replace(i.src, '[?#].*$', ''), '\.([A-Za-z]+)$', 1))"
SQL["dom_issues"] = f"""WITH p AS (SELECT url, coalesce(body, '') AS b, headers FROM pages WHERE lower(content_type) LIKE '%text/html%'),
    h AS (SELECT url, b, headers, CASE WHEN contains(b, '</head>') THEN split_part(b, '</head>', 1) ELSE '' END AS head, {_TEXT.format("regexp_extract(b, '<meta name=.description. content=.([^\"]*).', 1)")} AS descr,
        len(regexp_extract_all(b, '<h1[ >]')) AS h1, regexp_extract_all(b, '<h([1-6])[ >]', 1) AS levels, regexp_extract_all(b, '<img src="([^"]*)"', 1) AS imgs, regexp_extract_all(b, '<a href="([^"]*)"', 1) AS anchors FROM p),
    css AS (SELECT url, b, unnest(regexp_extract_all(head, '<link rel="stylesheet" href="([^"]*)"', 1)) AS src FROM h),
    js AS (SELECT url, b, unnest(regexp_extract_all(head, '<script src="([^"]*)"', 1)) AS src FROM h),
    i AS (SELECT url, unnest(imgs) AS src, generate_subscripts(imgs, 1) AS n FROM h),
    k AS (SELECT url, levels[n] AS x, levels[n + 1] AS y FROM (SELECT url, levels, unnest(range(1, len(levels))) AS n FROM h) WHERE CAST(levels[n + 1] AS INTEGER) > CAST(levels[n] AS INTEGER) + 1),
    skips AS (SELECT url, 'heading level skips from h' || x || ' to h' || y AS message FROM k),
    said AS (SELECT url, lower(trim(unnest(regexp_extract_all(b, '<a href="[^"]*">([^<]*)</a>', 1)))) AS t FROM h)
    SELECT 'seo/missing-meta-description' AS check_name, 'warning' AS severity, 'page is missing a meta description' AS message, url FROM h WHERE descr = ''
    UNION ALL SELECT 'seo/meta-description-length', 'info', 'meta description length is ' || strlen(descr) || ' characters, expected 70-155', url FROM h WHERE descr <> '' AND strlen(descr) NOT BETWEEN 70 AND 155
    UNION ALL SELECT 'seo/missing-h1', 'warning', 'page is missing an <h1> tag', url FROM h WHERE h1 = 0
    UNION ALL SELECT 'seo/multiple-h1', 'warning', 'page has ' || h1 || ' <h1> tags, expected 1', url FROM h WHERE h1 > 1
    UNION ALL SELECT 'seo/missing-canonical', 'warning', 'page is missing a canonical link', url FROM h WHERE NOT contains(b, 'rel="canonical"')
    UNION ALL SELECT 'seo/missing-lang', 'warning', 'page is missing a lang attribute on the <html> tag', url FROM h WHERE NOT regexp_matches(b, '<html[^>]* lang=')
    UNION ALL SELECT 'seo/missing-og-' || o, 'info', 'page is missing an og:' || o || ' meta tag', url FROM h, (SELECT unnest(['title', 'description', 'image']) AS o) WHERE NOT contains(b, 'property="og:' || o || '"')
    UNION ALL SELECT 'seo/missing-twitter-card', 'info', 'page is missing a twitter:card meta tag', url FROM h WHERE NOT contains(b, 'twitter:card')
    UNION ALL SELECT 'seo/missing-viewport', 'critical', 'page is missing a viewport meta tag', url FROM h WHERE NOT contains(b, 'name="viewport"')
    UNION ALL SELECT 'performance/large-html', 'warning', 'HTML size is ' || strlen(b) || ' bytes (' || printf('%.0f', strlen(b) / 1024.0) || ' KB), maximum recommended is 102400 bytes', url FROM h WHERE strlen(b) > 102400
    UNION ALL SELECT 'performance/no-compression', 'warning', 'HTML response is not compressed (missing gzip or br Content-Encoding)', url FROM h WHERE NOT regexp_matches({_H.format('content-encoding')}, 'gzip|br')
    UNION ALL SELECT 'performance/render-blocking-script', 'warning', 'render-blocking script in <head>: ' || src, url FROM js
    UNION ALL SELECT 'performance/excessive-css', 'info', 'page has ' || count(*) || ' stylesheets in <head>, maximum recommended is 3', url FROM css GROUP BY url, b HAVING count(*) > 3
    UNION ALL SELECT 'performance/render-blocking-css', 'warning', 'render-blocking stylesheet in <head>: ' || src, url FROM css
    UNION ALL SELECT 'performance/missing-resource-hints', 'info', 'page has no <link rel="preconnect"> or <link rel="dns-prefetch"> resource hints', url FROM h WHERE NOT regexp_matches(b, 'rel=.(preconnect|dns-prefetch)')
    UNION ALL SELECT 'performance/missing-cache-headers', 'warning', 'response has no Cache-Control header', url FROM h WHERE {_H.format('cache-control')} = ''
    UNION ALL SELECT 'performance/no-http2', 'info', 'no Alt-Svc header indicating HTTP/2 or HTTP/3 support detected', url FROM h WHERE NOT regexp_matches({_H.format('alt-svc')}, 'h2|h3')
    UNION ALL SELECT 'security/missing-sri', 'info', 'external script "' || src || '" is missing integrity attribute', js.url FROM js WHERE {_AUTH.format('src')} <> {_AUTH.format('js.url')} AND {_AUTH.format('src')} <> ''
    UNION ALL SELECT 'security/missing-sri', 'info', 'external stylesheet "' || src || '" is missing integrity attribute', css.url FROM css WHERE {_AUTH.format('src')} <> {_AUTH.format('css.url')} AND {_AUTH.format('src')} <> ''
    UNION ALL SELECT 'accessibility/missing-skip-nav', 'info', 'page is missing a skip navigation link', url FROM h WHERE len(list_filter(anchors[1:3], lambda a: starts_with(a, '#') AND strlen(a) > 1)) = 0
    UNION ALL SELECT 'accessibility/heading-hierarchy', 'warning', message, url FROM skips
    UNION ALL SELECT 'accessibility/missing-table-header', 'info', 'table element is missing header cells (<th>)', url FROM (SELECT url, unnest(regexp_extract_all(b, '<table[ >]')) FROM h WHERE NOT contains(b, '<th>'))
    UNION ALL SELECT 'accessibility/missing-landmarks', 'warning', 'page has no ARIA landmark regions', url FROM h WHERE NOT regexp_matches(b, '<(main|nav|header|footer)[ >]')
    UNION ALL SELECT 'images/legacy-format', 'info', 'image uses legacy format (' || {_IMG_EXT} || '), consider WebP or AVIF: ' || i.src, url FROM i WHERE {_IMG_EXT} IN ('jpg', 'jpeg', 'gif', 'bmp', 'tiff')
    UNION ALL SELECT 'images/missing-lazy-loading', 'info', 'image is missing loading="lazy" attribute: ' || src, url FROM i WHERE n > 3
    UNION ALL SELECT 'images/missing-dimensions', 'warning', 'image is missing width and height attributes: ' || src, url FROM i
    UNION ALL SELECT 'images/missing-responsive', 'info', 'image is missing srcset and sizes attributes: ' || src, url FROM i WHERE starts_with(src, 'http')
    UNION ALL SELECT 'links/generic-anchor-text', 'info', 'link has generic anchor text "' || t || '"', url FROM said WHERE t IN ('click here', 'read more', 'learn more', 'here', 'more', 'link', 'this')
    UNION ALL SELECT 'links/excessive-links', 'info', 'page has ' || len(anchors) || ' links, which exceeds the recommended maximum of 100', url FROM h WHERE len(anchors) > 100
    UNION ALL SELECT 'structured-data/missing-json-ld', 'info', 'page has no JSON-LD structured data', url FROM h WHERE NOT contains(b, 'application/ld+json')
    UNION ALL SELECT 'content/no-paragraphs', 'info', 'page contains no <p> tags', url FROM h WHERE b <> '' AND NOT regexp_matches(b, '<p[ >]')
    UNION ALL SELECT 'content/heading-hierarchy-skip', 'warning', message, url FROM skips WHERE true"""
SQL["lighthouse_issues"] = D._FLAT + f""", t AS ({D._table_sql('lighthouse')})
    SELECT 'lighthouse/performance' AS check_name, CASE WHEN performance_score < 50 THEN 'critical' ELSE 'warning' END AS severity,
        'performance score ' || printf('%.0f', performance_score) || ' is below ' || CASE WHEN performance_score < 50 THEN '50' ELSE '90' END AS message, url FROM t WHERE performance_score < 90
    UNION ALL SELECT 'lighthouse/accessibility', 'warning', 'accessibility score ' || printf('%.0f', accessibility_score) || ' is below 90', url FROM t WHERE accessibility_score < 90
    UNION ALL SELECT 'lighthouse/seo', 'warning', 'seo score ' || printf('%.0f', seo_score) || ' is below 90', url FROM t WHERE seo_score < 90"""
SQL["noindex_listed"] = "SELECT 'seo/noindex-in-sitemap' AS check_name, url FROM pages WHERE in_sitemap AND lower(content_type) LIKE '%text/html%' AND regexp_matches(body, '<meta name=.robots. content=.[^>]*noindex')"
SQL["target_sources"] = f"""WITH e AS (SELECT seq, url AS src, unnest(list_concat(coalesce(links, []), coalesce(assets, []))) AS url FROM pages),
    o AS (SELECT e.url, src, min(seq) AS seq FROM e WHERE {_HOST.format('e.url')} <> '' AND {_HOST.format('e.url')} <> (SELECT {_HOST.format('arg_min(url, seq)')} FROM pages) GROUP BY ALL)
    SELECT url, 0::INTEGER AS block, string_agg(src, ' ' ORDER BY seq, src) AS sources FROM o GROUP BY url"""
SQL["redirect_rows"] = """WITH r AS (SELECT redirect_chain[1] AS f, url AS t, array_to_string(list_append(redirect_chain, url), ' -> ') AS chain, len(redirect_chain) AS hops FROM pages WHERE len(redirect_chain) > 0),
    l AS (SELECT DISTINCT src, f FROM (SELECT url AS src, unnest(links) AS f FROM pages)), b AS (SELECT f, string_agg(src, ' ' ORDER BY src) AS linked FROM l GROUP BY f)
    SELECT r.f AS "from", t AS "to", chain, hops, coalesce(linked, '') AS linked_by FROM r LEFT JOIN b ON b.f = r.f"""
_STORED = "SELECT check_name, coalesce(severity, '') AS severity, coalesce(message, '') AS message, coalesce(url, '') AS url, coalesce(detail, '') AS detail FROM baseline_issues"
SQL["sink_jsonl"] = SQL["sink_parquet"] = _STORED
_CELL = "CASE WHEN regexp_matches({0}, '^[=+@\\t\\r-]') THEN chr(9) || {0} ELSE {0} END AS {0}"
SQL["sink_csv"] = f"SELECT {', '.join(_CELL.format(c) for c in ISSUE_COLS)} FROM ({_STORED})"
SQL["stored_cache"] = """SELECT url, arg_max(coalesce(headers['last-modified'][1], ''), (fetched_at, seq)) AS last_modified, arg_max(coalesce(headers['etag'][1], ''), (fetched_at, seq)) AS etag,
    arg_max(sha256(coalesce(body, '')), (fetched_at, seq)) AS content_hash FROM pages WHERE url IS NOT NULL GROUP BY url"""
SQL["stored_baseline"] = "SELECT 'existing' AS status, check_name, count(*) AS n FROM baseline_issues GROUP BY check_name"
SQL["seo_issues"] = f"""SELECT check_name, severity, count(*) AS n FROM (SELECT check_name, severity FROM ({SQL['dom_issues']}) WHERE starts_with(check_name, 'seo/')
    UNION ALL SELECT check_name, CASE WHEN check_name = 'seo/missing-title' THEN 'critical' ELSE 'warning' END FROM ({SQL['title_issues']})
    UNION ALL SELECT 'seo/url-issues', 'info' FROM pages WHERE lower(content_type) LIKE '%text/html%' AND {_REASONS} <> '') GROUP BY ALL"""
SQL["structured_data_issues"] = f"SELECT check_name, count(*) AS n FROM ({SQL['dom_issues']}) WHERE starts_with(check_name, 'structured-data/') GROUP BY 1"
SQL["body_links"] = """SELECT seq, len(regexp_extract_all(b, '<a href="(?i)https?://')) AS n_links, len(regexp_extract_all(b, '<(img|script) src="https?://')) + len(regexp_extract_all(b, '<link rel="stylesheet" href="https?://')) AS n_assets
    FROM (SELECT seq, coalesce(body, '') AS b FROM pages WHERE contains(content_type, 'text/html'))"""
SQL["speed_issues"] = f"""WITH m AS ({SQL['speed_summary']}), i AS ({SQL['lighthouse_issues']})
    SELECT check_name, severity, count(*) AS n FROM i GROUP BY ALL
    UNION ALL SELECT 'lighthouse/poor-site-performance', 'warning', 1 FROM m WHERE n > 0 AND avg_performance < 50
    UNION ALL SELECT 'lighthouse/poor-site-accessibility', 'warning', 1 FROM m WHERE n > 0 AND avg_accessibility < 90
    UNION ALL SELECT 'lighthouse/low-pass-rate', 'info', 1 FROM m WHERE n > 0 AND pass_rate < 50"""
