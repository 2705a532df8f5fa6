"""Command line: audit stored or crawled pages, check one page, show settings and scores."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import functions as F

from auditloom.config import Config, dump, load_config
from auditloom.logs import log, set_up
from auditloom.model import PAGES
from auditloom.operators.baseline import baseline_diff, load_baseline, save_baseline
from auditloom.plans.audit import Registry, page_issues
from auditloom.report.writers import Result, prometheus, write_reports
from auditloom.session import local_session, materialise
from auditloom.site import summary as S


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="auditloom")
    p.add_argument("--config", default="")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("crawl", "crawl a site, or take stored pages, and audit them"), ("check", "audit one page"), ("lighthouse", "report stored page-speed scores"), ("validate", "show the resolved settings")):
        c = sub.add_parser(name, help=text)
        if name in ("crawl", "check"):
            c.add_argument("url", nargs="?", default="")
            c.add_argument("--pages", help="a table of pages instead of the network")
            c.add_argument("--analysis", action="store_true")
            c.add_argument("--metrics-file", default="")
            c.add_argument("--watch", type=float, default=0.0, help="seconds between repeated checks")
            for flag in ("max-depth", "max-pages", "rate-limit", "output", "output-file", "fail-on", "filter-severity", "filter-category", "rules-file", "schema-path", "save-baseline", "compare-baseline", "checkpoint-file"):
                c.add_argument("--" + flag)
            c.add_argument("--include", action="append")
            c.add_argument("--exclude", action="append")
        elif name == "lighthouse":
            c.add_argument("scores", help="a table of scores")
            c.add_argument("--output")
            c.add_argument("--output-file")
            c.add_argument("--fail-on")
    return p


def _flags(a: argparse.Namespace) -> dict:
    known = set(Config.__dataclass_fields__)
    return {k: v for k, v in vars(a).items() if k in known and v is not None}


def _rules(cfg: Config):
    if not cfg.rules_file:
        return None
    from auditloom.rules.cel import load_rules, rule_checks

    return rule_checks(load_rules(cfg.rules_file))


def run_audit(spark, pages, cfg: Config, seed: str, analysis: bool = False, metrics_file: str = "", began: float | None = None) -> int:
    """Audit, baseline, metrics, filters, reports, exit code: in this order."""
    began = time.time() if began is None else began
    reg = Registry()
    issues = materialise((reg.with_analysis() if analysis else reg).run(pages, rules=_rules(cfg), registry_path=cfg.schema_path or None))
    if cfg.save_baseline:
        save_baseline(issues, cfg.save_baseline, seed)
    if cfg.compare_baseline:
        now = issues.withColumn("seq", F.monotonically_increasing_id())
        issues = materialise(baseline_diff(now, load_baseline(spark, cfg.compare_baseline)).where("status = 'new'").drop("status"))
    result = Result(seed, issues, pages.count(), time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), int((time.time() - began) * 1e9))
    if metrics_file:
        with open(metrics_file, "w") as f:
            f.write(prometheus(result))
    log.info("%s: %d pages, %s issues in %.1f s", seed, result.pages, sum(result.counts().values()), result.duration_ns / 1e9)
    result.issues = S.filter_issues(issues, cfg.filter_severity.split(","), cfg.filter_category.split(","))
    write_reports(result, cfg.formats(), cfg.output_file)
    return S.exit_code(result.issues, cfg.fail_on) if cfg.fail_on else 0


def _pages(spark, a, cfg: Config):
    if a.pages:
        return spark.read.parquet(a.pages)
    from auditloom.sources.crawl import crawl, fetch_page, http_fetcher, normalise_url, robots_files, sitemap_urls

    seed = normalise_url(a.url)
    if a.command == "check":
        p = fetch_page(seed, cfg.request_timeout, cfg.user_agent)
        row = {**p, "seq": 0, "site": "", "links": [], "assets": [], "depth": 0, "fetched_at": None, "in_sitemap": False}
        return spark.createDataFrame([tuple(row[c.split()[0]] for c in PAGES.split(", "))], PAGES)

    def raw(u):
        try:
            return fetch_page(u, cfg.request_timeout, cfg.user_agent)["body"].encode()
        except (OSError, ValueError):
            return None

    listed = sitemap_urls(seed.rstrip("/") + "/sitemap.xml", raw)[: cfg.max_pages]
    robots = None
    if cfg.respect_robots:
        robots = spark.createDataFrame(robots_files([seed], lambda u: fetch_page(u, cfg.request_timeout, cfg.user_agent)), "host string, text string")
    return materialise(crawl(spark, seed, http_fetcher(cfg.rate_limit / 8, timeout=cfg.request_timeout, agent=cfg.user_agent), robots=robots, agent=cfg.user_agent, sitemap=listed, max_pages=cfg.max_pages, max_depth=cfg.max_depth, include=cfg.include, exclude=cfg.exclude, checkpoint=cfg.checkpoint_file or None))


def main(argv: list[str] | None = None) -> int:
    a = _arguments().parse_args(argv)
    cfg = load_config(a.config, **_flags(a))
    set_up(cfg.log_level, cfg.log_format)
    if a.command == "validate":
        sys.stdout.write(dump(cfg))
        return 0
    spark = local_session()
    if a.command == "lighthouse":
        from auditloom.checks.media import lighthouse

        scores = spark.read.parquet(a.scores)
        issues = page_issues(scores, {"lighthouse": lighthouse})
        result = Result("", issues, scores.count(), lighthouse=scores.drop("fetched_at"))
        write_reports(result, cfg.formats(), cfg.output_file)
        return S.exit_code(issues, cfg.fail_on) if cfg.fail_on else 0
    while True:
        began = time.time()
        code = run_audit(spark, _pages(spark, a, cfg), cfg, a.url or a.pages, a.analysis, a.metrics_file, began)
        if a.command != "check" or not a.watch or code:
            return code
        time.sleep(a.watch)


if __name__ == "__main__":
    sys.exit(main())
