"""Schemas and severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGES = (
    "seq bigint, site string, url string, status_code int, content_type string, redirect_chain array<string>, body string, "
    "headers map<string,array<string>>, links array<string>, assets array<string>, depth int, fetched_at timestamp, "
    "fetch_duration_ns bigint, in_sitemap boolean"
)
ISSUE = "check_name string, severity string, message string, url string, detail string"
LIGHTHOUSE = "url string, performance_score double, accessibility_score double, best_practices_score double, seo_score double, fetched_at timestamp, source string"
LINK_PROBE = "url string, status_code int, location string, content_length bigint, timeout boolean, err string"
TLS_PROBE = "host string, version int, not_after timestamp, issuer string, subject string, authority_key_id binary, subject_key_id binary, dns_names array<string>"
ISSUE_COLS = ["check_name", "severity", "message", "url", "detail"]

CRITICAL, WARNING, INFO = "critical", "warning", "info"
LEVELS = {CRITICAL: 3, WARNING: 2, INFO: 1}


def level(severity: Column) -> Column:
    """3 critical, 2 warning, 1 info, 0 anything else."""
    return F.when(severity == CRITICAL, 3).when(severity == WARNING, 2).when(severity == INFO, 1).otherwise(0)


def parse_severity(text: str) -> str:
    s = text.strip().lower()
    if s not in LEVELS:
        raise ValueError(f"unknown severity {text!r}")
    return s


def issue(check: str, severity: str, message: Column | str, url: Column | None = None, detail: Column | None = None) -> Column:
    """One issue as a struct column."""
    return F.struct(
        F.lit(check).alias("check_name"),
        F.lit(severity).alias("severity"),
        (F.lit(message) if isinstance(message, str) else message).cast("string").alias("message"),
        (F.col("url") if url is None else url).cast("string").alias("url"),
        (F.lit("") if detail is None else F.coalesce(detail, F.lit(""))).cast("string").alias("detail"),
    )


def ordered(issues: DataFrame) -> DataFrame:
    """The total order of reports: severest first, then URL, check, message, detail."""
    return issues.orderBy(level(F.col("severity")).desc(), "url", "check_name", "message", "detail")


def category(check_name: Column) -> Column:
    return F.split_part(check_name, F.lit("/"), F.lit(1))
