"""Site-wide checks that join pages, their links and language links. A crawl is one DataFrame of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import host, quoted
from auditloom.model import CRITICAL, INFO, ISSUE_COLS, WARNING, issue


def as_issues(df: DataFrame, one: Column) -> DataFrame:
    return df.select(one.alias("i")).select("i.*")


def union_issues(*dfs: DataFrame) -> DataFrame:
    out = dfs[0].select(*ISSUE_COLS)
    for d in dfs[1:]:
        out = out.unionByName(d.select(*ISSUE_COLS))
    return out


def link_rows(pages: DataFrame) -> DataFrame:
    """``(src_seq, src, dst)``, one row per link, repeats kept."""
    return pages.where(F.col("links").isNotNull()).select(F.col("seq").alias("src_seq"), F.col("url").alias("src"), F.explode("links").alias("dst"))


def noindex_in_sitemap(pages: DataFrame) -> DataFrame:
    robots = F.lower(F.coalesce(F.try_element_at(F.col("d.meta"), F.lit("robots")), F.lit("")))
    return as_issues(pages.where(F.col("in_sitemap") & F.contains(robots, F.lit("noindex"))), issue("seo/noindex-in-sitemap", CRITICAL, "page has noindex but is included in the sitemap"))


def duplicate_titles(titles: DataFrame, title: str = "title", url: str = "url", seq: str = "seq") -> DataFrame:
    """One issue per trimmed, non-empty title of several pages, at the first page."""
    t = titles.select(F.trim(F.col(title)).alias("t"), F.col(url).alias("u"), F.col(seq).alias("s")).where("t <> ''")
    g = t.groupBy("t").agg(F.count("*").alias("n"), F.min_by("u", "s").alias("u")).where("n > 1")
    return as_issues(g, issue("seo/duplicate-titles", WARNING, F.concat(F.lit("title "), quoted(F.col("t")), F.format_string(" is shared by %d pages", F.col("n"))), url=F.col("u")))


def broken_internal(pages: DataFrame) -> DataFrame:
    """One issue per link whose target page answered 400-599; its URL is the target."""
    bad = pages.where(F.col("status_code").between(400, 599)).select(F.col("url").alias("dst"), "status_code")
    j = link_rows(pages).join(bad, "dst")
    return as_issues(j, issue("links/broken-internal", CRITICAL, F.format_string("broken internal link (HTTP %d), linked from %s", F.col("status_code"), F.col("src")), url=F.col("dst")))


def orphan_pages(pages: DataFrame) -> DataFrame:
    """Pages below the start that no link of any page names; a link to itself counts."""
    targets = link_rows(pages).select(F.col("dst").alias("url")).distinct()
    return as_issues(pages.where("depth <> 0").select("url").join(targets, "url", "left_anti"), issue("links/orphan-page", WARNING, "page has no internal links pointing to it"))


def deep_pages(pages: DataFrame, most: int = 4) -> DataFrame:
    return as_issues(pages.where(F.col("depth") > most), issue("links/deep-page", INFO, F.format_string(f"page is at depth %d, maximum recommended is {most}", F.col("depth"))))


def hreflang_site(entries: DataFrame) -> DataFrame:
    """``entries(seq, url, hreflang array<struct<lang,href>>)``: targets that don't link back, and pages that don't name themselves.

    Targets are looked up without their trailing slash among page URLs as written. Of several pages of a
    URL with such links the last one counts.
    """
    strip = lambda c: F.regexp_replace(c, "/+$", "")
    known = entries.where(F.size("hreflang") > 0).groupBy("url").agg(F.max_by("hreflang", "seq").alias("hreflang"))
    e = known.select(F.col("url").alias("src"), F.explode("hreflang").alias("h")).select("src", F.col("h.href").alias("href"))
    e = e.withColumn("to", strip(F.col("href")))
    back = e.select(F.col("src").alias("b_src"), F.col("to").alias("b_to")).distinct()
    asked = e.where(F.col("to") != strip(F.col("src"))).join(known.select(F.col("url").alias("to")), "to", "left_semi")
    gone = asked.join(back, (asked["to"] == back["b_src"]) & (strip(asked["src"]) == back["b_to"]), "left_anti")
    own = e.where(F.col("to") == strip(F.col("src"))).select(F.col("src").alias("url")).distinct()
    alone = known.select("url").join(own, "url", "left_anti")
    return union_issues(
        as_issues(gone, issue("hreflang/missing-return-link", WARNING, F.concat(F.lit("page has hreflang pointing to "), F.col("to"), F.lit(", but that page does not link back")), url=F.col("src"))),
        as_issues(alone, issue("hreflang/self-reference-missing", INFO, "page has hreflang annotations but does not include itself")),
    )


def missing_security_txt(pages: DataFrame) -> DataFrame:
    """One issue at the first page unless some page is the security.txt; with no pages its URL is empty."""
    g = pages.agg(F.min_by("url", "seq").alias("first"), F.coalesce(F.max(F.endswith("url", F.lit("/.well-known/security.txt"))), F.lit(False)).alias("has"))
    return as_issues(g.where("NOT has"), issue("security/missing-security-txt", INFO, "site does not have a /.well-known/security.txt file", url=F.coalesce("first", F.lit(""))))


#: Linking pages named in one row.
SOURCES = 1000


def _blocks(pairs: DataFrame, key: list[str], item: str, most: int = SOURCES) -> DataFrame:
    """The pairs with a block number, such that a block of a key has about ``most`` items at most."""
    n = pairs.groupBy(*key).agg(F.ceil(F.count("*") / most).cast("int").alias("n_blocks"))
    return pairs.join(n, key).withColumn("block", F.pmod(F.xxhash64(item), F.col("n_blocks")).cast("int")).drop("n_blocks")


def external_targets(pages: DataFrame) -> DataFrame:
    """``(url, block, sources)`` of links and assets outside the first page's host; the distinct linking pages in page order.

    A target has one row, but for targets of more than SOURCES linking pages, which have one a block of
    them, so no row grows with the crawl. The pairs themselves are ``external_pairs``.
    """
    p = _blocks(external_pairs(pages), ["url"], "src")
    return p.groupBy("url", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "src"))), lambda x: x["src"]).alias("sources"))


def external_pairs(pages: DataFrame) -> DataFrame:
    """``(url, src, seq)``: each external target with each page that names it, once."""
    first = pages.agg(host(F.min_by("url", "seq")).alias("own"))
    none = F.array().cast("array<string>")
    e = pages.select("seq", F.col("url").alias("src"), F.explode(F.concat(F.coalesce("links", none), F.coalesce("assets", none))).alias("url"))
    e = e.withColumn("h", host(F.col("url"))).where("h <> ''")
    return e.join(F.broadcast(first), F.col("h") != F.col("own")).groupBy("url", "src").agg(F.min("seq").alias("seq"))  # one row


def external_issues(targets: DataFrame, probes: DataFrame) -> DataFrame:
    """Issues of probed targets: timeout before error before redirect before status; their URL is the target."""
    j = targets.join(probes, "url")
    sources = F.concat(F.lit("linked from: "), F.array_join("sources", ", "))
    code = F.col("status_code")
    timeout = F.coalesce("timeout", F.lit(False))
    err = F.coalesce("err", F.lit(""))
    loc = F.coalesce("location", F.lit(""))
    one = (
        F.when(timeout, issue("external-links/timeout", INFO, "external link timed out", detail=sources))
        .when(err != "", issue("external-links/broken", WARNING, F.concat(F.lit("external link returned error: "), err), detail=sources))
        .when(code.between(300, 399) & (loc != ""), issue("external-links/redirect", INFO, F.format_string("external link redirects (HTTP %d)", code), detail=F.concat(F.lit("redirects to: "), loc, F.lit("; "), sources)))
        .when(code >= 400, issue("external-links/broken", WARNING, F.format_string("external link returned HTTP %d", code), detail=sources))
    )
    return as_issues(j.where(one.isNotNull()), one)


def image_probe_issues(pages: DataFrame, probes: DataFrame) -> DataFrame:
    """Broken and oversized images by probed status and length, one issue per image element."""
    imgs = pages.select("url", F.explode("d.imgs").alias("i")).select(F.col("url").alias("page"), F.col("i.src").alias("src")).where(F.rlike("src", F.lit("^https?://")))
    j = imgs.join(probes.select(F.col("url").alias("src"), "status_code", "content_length"), "src")
    size, code = F.col("content_length"), F.col("status_code")
    from auditloom.functions.columns import rounded

    return union_issues(
        as_issues(j.where(code >= 400), issue("images/broken-src", CRITICAL, F.format_string("image returned HTTP %d: %s", code, F.col("src")), url=F.col("page"))),
        as_issues(
            j.where((size > 512_000) & (code < 400)),
            issue("images/large-image", WARNING, F.concat(F.lit("image is "), size.cast("string"), F.lit(" bytes ("), rounded(size / 1024), F.lit(" KB): "), F.col("src")), url=F.col("page")),
        ),
    )


_VERSIONS = {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}


def tls_issues(pages: DataFrame, probes: DataFrame, now: Column | None = None) -> DataFrame:
    """Protocol and certificate issues of https pages, by their host's probe."""
    now = F.current_timestamp() if now is None else now
    j = pages.where(F.startswith("url", F.lit("https://")) & (F.col("status_code") != 0)).select("url", host(F.col("url")).alias("host")).join(probes, "host")
    left = F.unix_timestamp("not_after") - F.unix_timestamp(now.cast("timestamp"))
    day = F.date_format("not_after", "yyyy-MM-dd")
    name = F.create_map(*[F.lit(x) for kv in _VERSIONS.items() for x in kv])
    ids = F.col("authority_key_id").isNull() | F.col("subject_key_id").isNull() | (F.octet_length("authority_key_id") == 0) | (F.octet_length("subject_key_id") == 0) | (F.col("authority_key_id") == F.col("subject_key_id"))
    names = F.transform(F.coalesce("dns_names", F.array().cast("array<string>")), lambda n: F.lower(n))
    wild = F.concat(F.lit("*."), F.regexp_replace("host", r"^[^.]*\.", ""))
    match = F.array_contains(names, F.col("host")) | (F.contains("host", F.lit(".")) & F.array_contains(names, wild))
    return union_issues(
        as_issues(j.where("version < 771"), issue("tls/weak-protocol", WARNING, F.concat(F.lit("server negotiated "), F.coalesce(F.try_element_at(name, F.col("version")), F.concat(F.lit("unknown (0x"), F.lpad(F.lower(F.hex(F.col("version").cast("bigint"))), 4, "0"), F.lit(")"))), F.lit(", minimum recommended is TLS 1.2")))),
        as_issues(j.where(left < 0), issue("tls/certificate-expired", CRITICAL, F.concat(F.lit("certificate expired on "), day))),
        as_issues(j.where((left >= 0) & (left < 30 * 86400)), issue("tls/certificate-expiring-soon", WARNING, F.concat(F.lit("certificate expires in "), F.floor(left / 86400).cast("string"), F.lit(" days ("), day, F.lit(")")))),
        as_issues(j.where((F.col("issuer") == F.col("subject")) & ids), issue("tls/self-signed", WARNING, "certificate is self-signed")),
        as_issues(j.where(~match), issue("tls/hostname-mismatch", CRITICAL, F.concat(F.lit("certificate does not match hostname "), quoted(F.col("host")), F.lit(": it is valid for "), F.array_join(names, ", ")))),
    )
