"""Checks of status, redirects, timing and transport."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.checks import guarded, when
from auditloom.functions.columns import duration, header, is_html
from auditloom.model import CRITICAL, INFO, WARNING, issue

MAX_HOPS, MAX_TTFB_NS = 2, 2_000_000_000


def checks() -> Column:
    code, url, chain = F.col("status_code"), F.col("url"), F.coalesce("redirect_chain", F.array().cast("array<string>"))
    https = F.startswith(url, F.lit("https://"))
    plain = F.filter(F.coalesce("assets", F.array().cast("array<string>")), lambda a: F.startswith(a, F.lit("http://")))
    server = header("server")
    status = F.format_string("page returned HTTP %d", code)
    return guarded(
        F.lit(True),
        [
            when(code.between(400, 499), issue("health/4xx", CRITICAL, status)),
            when(code.between(500, 599), issue("health/5xx", CRITICAL, status)),
            when(F.size(chain) > MAX_HOPS, issue("health/redirect-chain", WARNING, F.format_string("redirect chain has %d hops, maximum is 2", F.size(chain)))),
            when(F.array_contains(chain, url), issue("health/redirect-loop", CRITICAL, "page URL appears in its own redirect chain")),
            when(F.col("fetch_duration_ns") > MAX_TTFB_NS, issue("health/slow-ttfb", WARNING, F.concat(F.lit("time to first byte is "), duration(F.col("fetch_duration_ns")), F.lit(", maximum is 2s")))),
            when(https & (F.size(plain) > 0), issue("health/mixed-content", WARNING, F.format_string("HTTPS page loads %d HTTP assets", F.size(plain)), detail=F.array_join(plain, "\n"))),
            when(F.rlike(server, F.lit(r"\d+\.\d+")), issue("health/server-version-leak", INFO, F.concat(F.lit("Server header reveals version: "), server))),
            when(
                https & F.startswith(F.try_element_at(chain, F.lit(1)), F.lit("http://")) & code.isin(302, 307),
                issue("health/https-redirect-not-permanent", WARNING, F.format_string("HTTP to HTTPS redirect uses non-permanent status %d; prefer 301 or 308", code)),
            ),
            when(
                is_html() & ~F.contains(F.lower("content_type"), F.lit("charset")),
                issue("health/missing-charset", WARNING, F.concat(F.lit("Content-Type header is missing charset: "), F.col("content_type"))),
            ),
        ],
    )
