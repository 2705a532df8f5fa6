"""Aggregates over issues and crawls: score, summary, filters, crawl budget, page-speed averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.columns import one_decimal, rounded
from auditloom.model import CRITICAL, INFO, LEVELS, WARNING, category, issue, level
from auditloom.site.links import as_issues, union_issues

CATEGORIES = ["seo", "health", "performance", "security", "accessibility", "links", "images", "structured-data", "content"]
#: Check prefixes that count for another category.
ALIASES = {"hreflang": "seo", "tls": "security", "external-links": "links"}
DEDUCTION = {CRITICAL: 10, WARNING: 3, INFO: 1}


def _deduction():
    s = F.col("severity")
    return F.when(s == CRITICAL, 10).when(s == WARNING, 3).when(s == INFO, 1).otherwise(0)


def score_category():
    p = category(F.col("check_name"))
    for a, b in ALIASES.items():
        p = F.when(category(F.col("check_name")) == a, b).otherwise(p)
    return p


def health_scores(issues: DataFrame) -> DataFrame:
    """``(category, score)`` of ``overall`` and the nine categories, each 100 less deductions, within 0 and 100."""
    spark = issues.sparkSession
    names = spark.createDataFrame([(c,) for c in ["overall", *CATEGORIES]], "category string")
    d = issues.select(F.explode(F.array(F.lit("overall"), score_category())).alias("category"), _deduction().alias("x")).groupBy("category").agg(F.sum("x").alias("x"))
    return names.join(d, "category", "left").select("category", F.greatest(F.lit(0), F.lit(100) - F.coalesce("x", F.lit(0))).cast("int").alias("score"))


def by_severity(issues: DataFrame) -> DataFrame:
    """Counts of the three severities, zeros included, and of any other that occurs."""
    base = issues.sparkSession.createDataFrame([(s,) for s in LEVELS], "severity string")
    n = issues.groupBy("severity").agg(F.count("*").alias("n"))
    return base.join(n, "severity", "full").select("severity", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def by_category(issues: DataFrame) -> DataFrame:
    return issues.groupBy(category(F.col("check_name")).alias("category")).agg(F.count("*").alias("n"))


def top_urls(issues: DataFrame, k: int = 10) -> DataFrame:
    return issues.groupBy("url").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "url").limit(k)


def filter_issues(issues: DataFrame, severities: list[str] = (), categories: list[str] = ()) -> DataFrame:
    """Issues of the named severities and categories; an empty list means all."""
    sev = [s.strip().lower() for s in severities if s.strip()]
    cat = [c.strip().lower() for c in categories if c.strip()]
    out = issues
    if sev:
        out = out.where(F.col("severity").isin(*sev))
    if cat:
        out = out.where(F.lower(category(F.col("check_name"))).isin(*cat))
    return out


def group_issues(issues: DataFrame, by: str = "severity") -> DataFrame:
    """``(key, n, first)``: the size of each group and its first issue in report order. Unknown keys group by severity."""
    key = {"category": category(F.col("check_name")), "url": F.col("url")}.get(by, F.col("severity"))
    order = F.struct(-level(F.col("severity")), F.col("url"), F.col("check_name"), F.col("message"))
    return issues.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min_by(F.struct("check_name", "severity", "message", "url", "detail"), order).alias("first"))


def exit_code(issues: DataFrame, fail_on: str) -> int:
    """1 if any issue is at least as severe; ``any`` for any issue; 0 for unknown thresholds."""
    t = fail_on.strip().lower()
    if t == "any":
        return int(not issues.isEmpty())
    if t not in LEVELS:
        return 0
    return int(not issues.where(level(F.col("severity")) >= LEVELS[t]).isEmpty())


def crawl_budget_issues(pages: DataFrame) -> DataFrame:
    """Site-wide findings on depth, parameters, links per page and the sitemap; no pages give none."""
    g = pages.agg(
        F.count("*").alias("n"), F.count_if(F.col("depth") > 3).alias("deep"), F.count_if(F.contains("url", F.lit("?"))).alias("params"),
        F.avg(F.coalesce(F.when(F.col("links").isNotNull(), F.size("links")), F.lit(0))).alias("links"), F.count_if(~F.coalesce("in_sitemap", F.lit(False))).alias("out"),
    ).where("n > 0")
    share = lambda c: rounded(F.col(c) * 100 / F.col("n"))
    at = F.lit("")
    return union_issues(
        as_issues(g.where("deep / n > 0.1"), issue("crawl-budget/deep-pages", WARNING, F.concat(F.format_string("%d of %d pages (", F.col("deep"), F.col("n")), share("deep"), F.lit("%) are at depth > 3")), url=at)),
        as_issues(g.where("params > 0"), issue("crawl-budget/parameter-urls", INFO, F.format_string("%d URLs contain query parameters that could waste crawl budget", F.col("params")), url=at)),
        as_issues(g.where("links < 3"), issue("crawl-budget/low-internal-links", INFO, F.concat(F.lit("average internal links per page is "), one_decimal(F.col("links")), F.lit(", recommended minimum is 3")), url=at)),
        as_issues(g.where("out / n > 0.2"), issue("crawl-budget/large-sitemap-gap", WARNING, F.concat(F.format_string("%d of %d crawled pages (", F.col("out"), F.col("n")), share("out"), F.lit("%) are not in the sitemap")), url=at)),
    )


SCORES = ["performance_score", "accessibility_score", "best_practices_score", "seo_score"]


def speed_summary(lighthouse: DataFrame) -> DataFrame:
    """``(n, avg_*, pass_rate)``: averages and the share in percent of pages with performance of at least 90."""
    return lighthouse.agg(
        F.count("*").alias("n"), *[F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0)).alias("avg_" + c.removesuffix("_score")) for c in SCORES],
        F.coalesce(F.avg(F.when(F.col("performance_score") >= 90, 100.0).otherwise(0.0)), F.lit(0.0)).alias("pass_rate"),
    )


def slowest(lighthouse: DataFrame, score: str = "performance_score", k: int = 5) -> DataFrame:
    return lighthouse.select("url", F.col(score).alias("score")).orderBy(F.col("score").asc_nulls_first(), "url").limit(k)


def speed_issues(lighthouse: DataFrame) -> DataFrame:
    s = speed_summary(lighthouse).where("n > 0")
    at = F.lit("")
    return union_issues(
        as_issues(s.where("avg_performance < 50"), issue("lighthouse/poor-site-performance", WARNING, F.concat(F.lit("average site performance score is "), one_decimal(F.col("avg_performance")), F.lit(" (threshold: 50)")), url=at)),
        as_issues(s.where("avg_accessibility < 90"), issue("lighthouse/poor-site-accessibility", WARNING, F.concat(F.lit("average site accessibility score is "), one_decimal(F.col("avg_accessibility")), F.lit(" (threshold: 90)")), url=at)),
        as_issues(s.where("pass_rate < 50"), issue("lighthouse/low-pass-rate", INFO, F.concat(F.lit("only "), one_decimal(F.col("pass_rate")), F.lit("% of pages pass the performance threshold (>= 90)")), url=at)),
    )
