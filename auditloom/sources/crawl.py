"""Pages from tables, files and the network: sitemaps, URL files, the frontier, its snapshots, and fetching."""

from __future__ import annotations

import gzip
import io
import ipaddress
import json
import socket
import time
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from auditloom.functions.columns import authority, glob_regex, path
from auditloom.logs import log
from auditloom.model import PAGES
from auditloom.session import map_arrow, materialise
from auditloom.sources.robots import decide, robots_rules

MAX_BODY, MAX_REDIRECTS, URL_FILE_LINES, SITEMAP_LEVELS = 10 * 1024 * 1024, 10, 10_000, 2


# --- addresses ----------------------------------------------------------------------------------

def normalise_url(url: str) -> str:
    return url if "://" in url else "https://" + url


def read_url_file(spark: SparkSession, file: str, strict: bool = False) -> DataFrame:
    """URLs of a file in their order, without blanks and ``#`` comments. Beyond 10,000 they are cut off, or an error if ``strict``."""
    lines = spark.read.text(file, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    urls = lines.select("n", F.trim("line").alias("url")).where((F.col("url") != "") & ~F.startswith("url", F.lit("#")))
    if strict and urls.count() > URL_FILE_LINES:
        raise ValueError(f"{file} has more than {URL_FILE_LINES} URLs")
    return urls.orderBy("n").limit(URL_FILE_LINES).select("url")


def is_safe_url(url: str) -> bool:
    """The host resolves, and to public addresses only."""
    host = urlsplit(url).hostname
    if not host:
        return False
    try:
        found = {i[4][0] for i in socket.getaddrinfo(host, None)}
    except OSError:
        return False
    return bool(found) and all(ipaddress.ip_address(a.split("%")[0]).is_global for a in found)


# --- sitemaps -----------------------------------------------------------------------------------

def gunzip(data: bytes, most: int = MAX_BODY) -> bytes:
    """Unpacked data if it is packed, cut at ``most`` bytes."""
    if data[:2] != b"\x1f\x8b":
        return data[:most]
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        return f.read(most)


def parse_sitemap(data: bytes) -> tuple[list[str], list[str]]:
    """``(page URLs, nested sitemaps)``; unreadable XML has none."""
    try:
        root = ElementTree.fromstring(gunzip(data))
    except (ElementTree.ParseError, OSError, EOFError):
        return [], []
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    locs = [(c.text or "").strip() for e in root for c in e if local(c) == "loc"]
    locs = [x for x in locs if x]
    return ([], locs) if local(root) == "sitemapindex" else (locs, [])


def sitemap_urls(start: str, fetch: Callable[[str], bytes | None]) -> list[str]:
    """Page URLs of a sitemap and its nested ones on the same host, at most two levels down."""
    host, out, level, seen = urlsplit(start).netloc.lower(), [], [start], {start}
    for _ in range(SITEMAP_LEVELS + 1):
        below: list[str] = []
        for u in level:
            data = fetch(u)
            if data:
                urls, nested = parse_sitemap(data)
                out += [x for x in urls if urlsplit(x).netloc.lower() == host]
                below += [x for x in nested if urlsplit(x).netloc.lower() == host and x not in seen]
                seen.update(below)
        level = below
    return out


def sitemap_table(spark: SparkSession, files: str) -> DataFrame:
    """``(loc)`` of stored sitemap files, read by the XML source."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string").load(files).where("loc IS NOT NULL").select(F.trim("loc").alias("loc"))


# --- frontier -----------------------------------------------------------------------------------

def path_allowed(url, include: list[str], exclude: list[str]):
    """The path matches some include pattern, if any is given, and no exclude pattern; malformed patterns match nothing."""
    p = path(url)
    hit = lambda globs: [F.rlike(p, F.lit(r)) for r in map(glob_regex, globs) if r]
    ok = F.lit(True)
    if include:
        ok = F.lit(False)
        for c in hit(include):
            ok = ok | c
    for c in hit(exclude):
        ok = ok & ~c
    return ok


def add_to_frontier(seen: DataFrame, found: DataFrame, seed: str, max_pages: int | None, max_depth: int | None, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """New tasks ``(url, depth, seq)`` out of ``found(url, depth, seq)``.

    Unseen URLs of the seed's host whose path is allowed, each once at its first place, in order, as
    many as the cap on seen URLs leaves. None stands for no cap and no bound of depth.
    """
    host = urlsplit(seed).netloc.lower()
    c = found.where((F.lower(authority(F.col("url"))) == host) & (F.lit(True) if max_depth is None else F.col("depth") <= max_depth) & path_allowed(F.col("url"), list(include), list(exclude)))
    new = c.groupBy("url").agg(F.min(F.struct("seq", "depth")).alias("m")).select("url", "m.depth", "m.seq").join(seen.select("url"), "url", "left_anti")
    return new if max_pages is None else new.orderBy("seq", "url").limit(max(0, max_pages - seen.count()))


def _linked(got: DataFrame) -> DataFrame:
    """Links ``(url, depth, seq)`` of a level's pages, numbered anew in the order of the pages and their places in them.

    Numbers count links and so don't grow with the level: pages are sorted by ``seq`` over all partitions,
    and a page's first number is the sum of what stands before it.
    """
    spark = got.sparkSession
    sizes = materialise(got.where(F.size("links") > 0).groupBy("seq").agg(F.max(F.size("links")).cast("long").alias("n")).orderBy("seq").withColumn("part", F.spark_partition_id()))
    lots = sizes.groupBy("part").agg(F.sum("n").alias("n"), F.min("seq").alias("least")).orderBy("least").collect()  # one row a partition
    before, total = [], 0
    for r in lots:
        before.append((r["part"], total))
        total += r["n"]
    base = spark.createDataFrame(before, "part int, base long")
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.join(F.broadcast(base), "part").select("seq", (F.col("base") + F.coalesce(F.sum("n").over(own), F.lit(0))).alias("first"))
    return got.join(first, "seq").select((F.col("depth") + 1).alias("depth"), "first", F.posexplode("links").alias("k", "url")).select("url", "depth", (F.col("first") + F.col("k")).alias("seq"))


def crawl(spark: SparkSession, seed: str, fetch_level: Callable[[DataFrame], DataFrame], *, sitemap: list[str] = (), max_pages: int | None = 500, max_depth: int | None = 5, include: list[str] = (), exclude: list[str] = (), checkpoint: str | None = None, resume: str | None = None, robots: DataFrame | None = None, agent: str = "auditloom/1.0") -> DataFrame:
    """Breadth-first crawl, a level a round. ``fetch_level`` turns ``(url, depth, seq)`` into pages.

    ``robots(host, text)`` holds the robots files: addresses they disallow count as seen and towards the
    cap, but are not fetched. Hosts without a row allow everything.
    Sitemap URLs go first with depth 1, then the seed with depth 0; the first entry of a URL counts.
    With ``resume``, the crawl goes on from a snapshot of its frontier and returns the pages still to fetch.
    """
    start = [(u, 1, i) for i, u in enumerate(sitemap)] + [(seed, 0, len(sitemap))]
    found = spark.createDataFrame(start, "url string, depth int, seq long")
    seen = spark.createDataFrame([], "url string, depth int, seq long")
    state = load_frontier(spark, resume) if resume else None
    if state is not None:
        seen = materialise(state.where("state = 'seen'").select("url", "depth", "seq"))
        found = materialise(state.where("state = 'queued'").select("url", "depth", "seq"))
    listed = spark.createDataFrame([(u,) for u in sitemap], "url string").distinct()
    rules = materialise(robots_rules(robots, agent)) if robots is not None else None
    levels: list[DataFrame] = []
    while True:
        tasks = materialise(add_to_frontier(seen, found, seed, max_pages, max_depth, include, exclude))
        if tasks.isEmpty():
            break
        seen = materialise(seen.unionByName(tasks))
        got = materialise(fetch_level(tasks if rules is None else tasks.join(decide(tasks, rules).where("allowed"), "url", "left_semi")))
        levels.append(got)
        log.info("crawl of %s: level %d fetched", seed, len(levels) - 1)
        if checkpoint:
            save_frontier(seen, tasks, checkpoint, seed)
        found = _linked(got)
    out = levels[0] if levels else spark.createDataFrame([], PAGES)
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.drop("in_sitemap").join(F.broadcast(listed.withColumn("in_sitemap", F.lit(True))) if len(sitemap) <= 50_000 else listed.withColumn("in_sitemap", F.lit(True)), "url", "left").withColumn("in_sitemap", F.coalesce("in_sitemap", F.lit(False)))


def robots_files(seeds: list[str], fetch: Callable[[str], dict]) -> list[tuple[str, str]]:
    """``(host, text)`` of the robots files of the seeds' hosts, each asked once; a file that doesn't answer with 200 is empty."""
    out = {}
    for u in map(urlsplit, map(normalise_url, seeds)):
        if u.netloc.lower() not in out:
            try:
                got = fetch(f"{u.scheme}://{u.netloc}/robots.txt")
                out[u.netloc.lower()] = got["body"] if got["status_code"] == 200 else ""
            except (OSError, ValueError):
                out[u.netloc.lower()] = ""
    return sorted(out.items())


def crawl_sites(spark: SparkSession, seeds: list[str], fetch_level: Callable[[DataFrame], DataFrame], parallel: int = 3, **options) -> DataFrame:
    """Crawls of several sites, ``parallel`` of them at a time, as one table of pages."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        parts = list(pool.map(lambda s: crawl(spark, s, fetch_level, **options), dict.fromkeys(map(normalise_url, seeds))))
    out = parts[0] if parts else spark.createDataFrame([], PAGES)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save_frontier(seen: DataFrame, queue: DataFrame, folder: str, seed: str) -> None:
    """A snapshot from which a crawl can go on: seen and waiting URLs."""
    state = seen.join(queue.select("url").withColumn("w", F.lit(True)), "url", "left").select("url", "depth", "seq", F.when(F.col("w"), "queued").otherwise("seen").alias("state"), F.lit(seed).alias("seed"))
    materialise(state).write.mode("overwrite").parquet(folder)


def load_frontier(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(folder)
    except Exception:
        return None


def delete_frontier(spark: SparkSession, folder: str) -> None:
    from auditloom.session import _delete

    _delete(spark, folder)


# --- incremental cache --------------------------------------------------------------------------

CACHE = "url string, last_modified string, etag string, content_hash string"


def cache_rows(pages: DataFrame) -> DataFrame:
    """The cache entry of each URL's latest fetch."""
    from auditloom.functions.columns import header

    entry = F.struct("fetched_at", "seq", header("last-modified").alias("last_modified"), header("etag").alias("etag"), F.sha2(F.coalesce("body", F.lit("")), 256).alias("content_hash"))
    return pages.where("url IS NOT NULL").groupBy("url").agg(F.max(entry).alias("m")).select("url", "m.last_modified", "m.etag", "m.content_hash")


def save_cache(rows: DataFrame, folder: str) -> None:
    materialise(rows).write.mode("overwrite").json(folder)


def load_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The stored cache, or an empty one if there is none."""
    try:
        return spark.read.schema(CACHE).json(folder)
    except Exception:
        return spark.createDataFrame([], CACHE)


def changed_pages(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages that the cache doesn't hold with the same ETag or, without one, the same content."""
    now = cache_rows(pages)
    old = cache.select(F.col("url"), F.col("etag").alias("e0"), F.col("content_hash").alias("h0"))
    fresh = now.join(old, "url", "left").where(F.col("h0").isNull() | F.when((F.col("etag") != "") & (F.col("e0") != ""), F.col("etag") != F.col("e0")).otherwise(F.col("content_hash") != F.col("h0")))
    return pages.join(fresh.select("url"), "url", "left_semi")


# --- network ------------------------------------------------------------------------------------

def fetch_page(url: str, timeout: float = 10.0, agent: str = "auditloom/1.0", allow_private: bool = False) -> dict:
    """One GET with redirects recorded; every address is checked before it is asked. Raises on loops and too many hops."""
    import http.client

    chain: list[str] = []
    now, began = url, time.monotonic_ns()
    while True:
        if not allow_private and not is_safe_url(now):
            raise ValueError(f"address not allowed: {now}")
        u = urlsplit(now)
        con = (http.client.HTTPSConnection if u.scheme == "https" else http.client.HTTPConnection)(u.netloc, timeout=timeout)
        try:
            con.request("GET", (u.path or "/") + (f"?{u.query}" if u.query else ""), headers={"User-Agent": agent, "Accept-Encoding": "gzip"})
            r = con.getresponse()
            to = r.getheader("Location")
            if r.status in (301, 302, 303, 307, 308) and to:
                now = urljoin(now, to)
                if now in chain or now == url or len(chain) >= MAX_REDIRECTS:
                    raise ValueError(f"redirect loop or too many redirects at {now}")
                chain.append(now)
                continue
            data = r.read(MAX_BODY)
            headers: dict[str, list[str]] = {}
            for k, v in r.getheaders():
                headers.setdefault(k.lower(), []).append(v)
            body = gunzip(data).decode("utf-8", "replace")
            return {"url": now, "status_code": r.status, "content_type": (r.getheader("Content-Type") or "").split(";")[0].strip(), "redirect_chain": chain, "body": body, "headers": headers, "fetch_duration_ns": time.monotonic_ns() - began}
        finally:
            con.close()


def http_fetcher(rate_per_partition: float = 5.0, **options) -> Callable[[DataFrame], DataFrame]:
    """A ``fetch_level`` that asks each host from one task, at a limited rate; failures yield no page."""

    schema = to_arrow_schema(_parse_datatype_string(PAGES))

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from auditloom.functions.dom import links_and_assets

        for b in batches:
            rows = []
            for t in b.to_pylist():
                time.sleep(1 / rate_per_partition)
                try:
                    p = fetch_page(t["url"], **options)
                except (OSError, ValueError):
                    continue
                ct = p["content_type"].lower()
                links, assets = links_and_assets(p["body"], p["url"]) if "text/html" in ct or "application/xhtml" in ct else ([], [])
                rows.append({**p, "headers": list(p["headers"].items()), "seq": t["seq"], "site": urlsplit(p["url"]).hostname, "links": links, "assets": assets, "depth": t["depth"], "fetched_at": int(time.time() * 1e6), "in_sitemap": False})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return lambda tasks: map_arrow(tasks.repartition(F.lower(authority(F.col("url")))), each, PAGES)


def probe_link(url: str, timeout: float = 10.0, allow_private: bool = False) -> dict:
    """One HEAD, or GET where HEAD isn't allowed, without following redirects."""
    import http.client

    out = {"url": url, "status_code": 0, "location": "", "content_length": 0, "timeout": False, "err": ""}
    if not allow_private and not is_safe_url(url):
        return {**out, "err": "address not allowed"}
    u = urlsplit(url)
    for method in ("HEAD", "GET"):
        con = (http.client.HTTPSConnection if u.scheme == "https" else http.client.HTTPConnection)(u.netloc, timeout=timeout)
        try:
            con.request(method, (u.path or "/") + (f"?{u.query}" if u.query else ""))
            r = con.getresponse()
            out |= {"status_code": r.status, "location": r.getheader("Location") or "", "content_length": int(r.getheader("Content-Length") or 0)}
            if r.status != 405:
                break
        except TimeoutError:
            return {**out, "timeout": True, "err": "timeout"}
        except (OSError, ValueError, http.client.HTTPException) as e:
            return {**out, "err": str(e) or type(e).__name__, "timeout": "timeout" in str(e).lower() or "timed out" in str(e).lower()}
        finally:
            con.close()
    return out


def probe_links(targets: DataFrame, per_second: float = 2.0, **options) -> DataFrame:
    """The probe table of ``targets(url)``: each host is asked from one task, at a limited rate."""
    from auditloom.model import LINK_PROBE

    schema = to_arrow_schema(_parse_datatype_string(LINK_PROBE))

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for url in b.column("url").to_pylist():
                rows.append(probe_link(url, **options))
                time.sleep(1 / per_second)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    urls = targets.select("url").where("url IS NOT NULL").distinct().repartition(F.lower(authority(F.col("url"))))
    return map_arrow(urls, each, LINK_PROBE)


def table_fetcher(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A ``fetch_level`` that answers from stored pages: crawls without a network."""
    stored = pages.drop("depth", "seq")
    return lambda tasks: tasks.join(stored, "url").select(*[c.split()[0] for c in PAGES.split(", ")])


def lighthouse_from_api(raw: str, url: str, source: str) -> dict:
    """Scores of 0 to 100 out of an API answer; missing ones are 0."""
    cats = (json.loads(raw).get("lighthouseResult") or {}).get("categories") or {}
    s = lambda k: float((cats.get(k) or {}).get("score") or 0) * 100
    return {"url": url, "performance_score": s("performance"), "accessibility_score": s("accessibility"), "best_practices_score": s("best-practices"), "seo_score": s("seo"), "source": source}


def lighthouse_runner(mode: str):
    """The parser of a mode's answers; the request itself is the caller's, as it needs a network."""
    if mode not in ("psi", "browserless"):
        raise ValueError(f"unknown lighthouse mode {mode!r}")
    return lambda raw, url: lighthouse_from_api(raw, url, mode)

