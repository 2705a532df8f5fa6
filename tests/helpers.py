"""Small fixtures: pages from keyword facts."""

from __future__ import annotations

import datetime

from auditloom.model import PAGES

NAMES = [c.split()[0] for c in PAGES.split(", ")]
NOW = datetime.datetime(2025, 3, 1, 12, 0)
BASE = {
    "seq": 1, "site": "example.com", "url": "https://example.com", "status_code": 200, "content_type": "text/html; charset=utf-8", "redirect_chain": [], "body": "", "headers": {},
    "links": [], "assets": [], "depth": 0, "fetched_at": NOW, "fetch_duration_ns": 1_000_000, "in_sitemap": False,
}


def pages(spark, *facts: dict):
    rows = [{**BASE, "seq": i + 1, **f} for i, f in enumerate(facts)]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], PAGES)


def names(df, col: str = "check_name") -> list[str]:
    return sorted(r[col] for r in df.collect())
