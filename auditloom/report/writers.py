"""Reports of an audit. Large results are written by Spark; single documents stream rows in report order."""

from __future__ import annotations

import html as _html
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import __version__
from auditloom.model import ISSUE_COLS, ordered
from auditloom.site import summary as S

FORMATS = ("terminal", "json", "csv", "markdown", "html", "sarif", "junit", "jsonl", "pdf")
_LEVEL = {"critical": "error", "warning": "warning", "info": "note"}


@dataclass
class Result:
    """What a report shows: a crawl's facts and its issues."""

    seed_url: str
    issues: DataFrame
    pages: int = 0
    crawled_at: str = ""
    duration_ns: int = 0
    lighthouse: list[dict] | DataFrame = field(default_factory=list)
    page_rows: list[dict] = field(default_factory=list)

    def rows(self) -> Iterator[dict]:
        """Issues in report order, a partition at a time."""
        for r in ordered(self.issues.select(*ISSUE_COLS)).toLocalIterator():
            yield {c: r[c] or "" for c in ISSUE_COLS}

    def scores(self) -> Iterator[dict]:
        """All score rows by URL, a partition at a time; given lists keep their order."""
        if isinstance(self.lighthouse, list):
            yield from self.lighthouse
            return
        for r in self.lighthouse.orderBy("url").toLocalIterator():
            yield r.asDict(recursive=True)

    def counts(self) -> dict[str, int]:
        return {r["severity"]: r["n"] for r in S.by_severity(self.issues).collect()}


def _seconds(ns: int) -> str:
    return f"{ns / 1e9:.1f}s"


def safe_cell(s: str) -> str:
    """A cell that no spreadsheet takes for a formula."""
    return "\t" + s if s[:1] in ("=", "+", "-", "@", "\t", "\r") else s


def safe_markdown(s: str) -> str:
    return re.sub(r"([\\`*_{}\[\]<>|#])", r"\\\1", s).replace("\n", " ")


def _issue_json(r: dict) -> dict:
    return {k: v for k, v in r.items() if k != "detail" or v}


def _dumps(x, **kw) -> str:
    """JSON with <, > and & escaped, so it can stand in a page."""
    return json.dumps(x, ensure_ascii=False, **kw).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


def summary(result: Result) -> dict:
    return {
        "total_issues": sum(result.counts().values()),
        "by_severity": result.counts(),
        "by_category": {r["category"]: r["n"] for r in S.by_category(result.issues).orderBy("category").collect()},
        "top_urls": [{"url": r["url"], "count": r["n"]} for r in S.top_urls(result.issues).collect()],
        "pages_scanned": result.pages,
    }


def to_json(result: Result) -> Iterator[str]:
    yield _dumps(
        {
            "seed_url": result.seed_url, "pages": result.page_rows, "issues": [_issue_json(r) for r in result.rows()], "lighthouse": list(result.scores()), "crawled_at": result.crawled_at,
            "duration": result.duration_ns, "summary": summary(result),
        },
        indent=2,
    ) + "\n"


def to_jsonl(result: Result) -> Iterator[str]:
    n: dict[str, int] = {}
    for r in result.rows():
        n[r["severity"]] = n.get(r["severity"], 0) + 1
        yield _dumps(_issue_json(r), separators=(",", ":")) + "\n"
    yield _dumps(
        {"type": "summary", "seed_url": result.seed_url, "pages": result.pages, "issues": sum(n.values()), "critical": n.get("critical", 0), "warning": n.get("warning", 0), "info": n.get("info", 0), "duration": _seconds(result.duration_ns)},
        separators=(",", ":"),
    ) + "\n"


def to_csv(result: Result) -> Iterator[str]:
    import csv
    import io

    def line(cells):
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerow(cells)
        return out.getvalue()

    yield line(["url", "severity", "check", "message", "detail"])
    for r in result.rows():
        yield line([safe_cell(r[c]) for c in ("url", "severity", "check_name", "message", "detail")])


def to_markdown(result: Result) -> Iterator[str]:
    n = result.counts()
    yield f"# Site Audit Report\n\n**URL:** {safe_markdown(result.seed_url)}\n**Crawled:** {result.crawled_at}\n**Pages:** {result.pages}\n**Duration:** {_seconds(result.duration_ns)}\n\n"
    yield "## Summary\n\n| Severity | Count |\n| -------- | ----- |\n" + "".join(f"| {s.capitalize()} | {n.get(s, 0)} |\n" for s in _LEVEL)
    last = None
    for r in result.rows():
        if r["severity"] in _LEVEL:
            if r["severity"] != last:
                last = r["severity"]
                yield f"\n## {last.capitalize()} Issues\n\n"
            yield f"- [{safe_markdown(r['check_name'])}] {safe_markdown(r['url'])}: {safe_markdown(r['message'])}\n"
    for k, x in enumerate(result.scores()):
        if k == 0:
            yield "\n## Lighthouse Scores\n\n| URL | Performance | Accessibility | Best Practices | SEO |\n| --- | ----------- | ------------- | -------------- | --- |\n"
        yield f"| {safe_markdown(x['url'] or '')} | " + " | ".join(f"{x.get(c) or 0:.0f}" for c in S.SCORES) + " |\n"


def score_percent(s: float) -> int:
    """Scores up to 1 are shares; others are cut to whole numbers."""
    return int(s) if s > 1 else int(s * 100)


def to_html(result: Result) -> Iterator[str]:
    n = result.counts()
    e = _html.escape
    yield (
        "<!DOCTYPE html>\n<html lang=\"en\"><head><meta charset=\"utf-8\"><title>Site Audit Report</title>\n"
        "<style>body{font-family:sans-serif;margin:2em}table{border-collapse:collapse;width:100%}td,th{border:1px solid #ccc;padding:.3em;text-align:left}"
        ".critical{color:#a00}.warning{color:#a60}.info{color:#06a}</style></head><body>\n"
        f"<h1>Site Audit Report</h1>\n<p>{e(result.seed_url)} &middot; {result.pages} pages &middot; {e(result.crawled_at)} &middot; {_seconds(result.duration_ns)}</p>\n<ul>"
        + "".join(f"<li class=\"{s}\">{s}: {n.get(s, 0)}</li>" for s in _LEVEL)
        + "</ul>\n<label>Severity <select id=\"s\"><option value=\"\">all</option>" + "".join(f"<option>{s}</option>" for s in _LEVEL) + "</select></label> <label>Filter <input id=\"q\"></label>\n<table id=\"t\"><thead><tr><th>Severity</th><th>Check</th><th>URL</th><th>Message</th><th>Detail</th></tr></thead><tbody>\n"
    )
    for r in result.rows():
        yield f"<tr class=\"{e(r['severity'])}\"><td>{e(r['severity'])}</td><td>{e(r['check_name'])}</td><td>{e(r['url'])}</td><td>{e(r['message'])}</td><td>{e(r['detail'])}</td></tr>\n"
    yield "</tbody></table>\n"
    k = -1
    for k, x in enumerate(result.scores()):
        if k == 0:
            yield "<table><tr><th>URL</th>" + "".join(f"<th>{c.removesuffix('_score').replace('_', ' ')}</th>" for c in S.SCORES) + "</tr>"
        yield f"<tr><td>{e(x['url'] or '')}</td>" + "".join(f"<td>{score_percent(x.get(c) or 0)}</td>" for c in S.SCORES) + "</tr>"
    if k >= 0:
        yield "</table>\n"
    yield (
        "<script>(function(){var q=document.getElementById('q'),s=document.getElementById('s');function show(){var w=q.value.toLowerCase();document.querySelectorAll('#t tbody tr').forEach(function(r){"
        "r.style.display=r.textContent.toLowerCase().indexOf(w)<0||s.value&&r.className!==s.value?'none':''})}q.addEventListener('input',show);s.addEventListener('change',show)})()</script>\n</body></html>\n"
    )


def to_sarif(result: Result) -> Iterator[str]:
    rules: dict[str, dict] = {}
    found = []
    for r in result.rows():
        lv = _LEVEL.get(r["severity"], "none")
        rules.setdefault(r["check_name"], {"id": r["check_name"], "shortDescription": {"text": r["check_name"]}, "defaultConfiguration": {"level": lv}})
        text = f"{r['message']}: {r['detail']}" if r["detail"] else r["message"]
        found.append({"ruleId": r["check_name"], "level": lv, "message": {"text": text}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["url"]}}}]})
    yield _dumps(
        {
            "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0",
            "runs": [{"tool": {"driver": {"name": "auditloom", "version": __version__, "informationUri": "", "rules": list(rules.values())}}, "results": found}],
        },
        indent=2,
    ) + "\n"


def to_junit(result: Result) -> Iterator[str]:
    suites: dict[str, list[dict]] = {}
    for r in result.rows():
        suites.setdefault(r["check_name"].split("/", 1)[0], []).append(r)
    total = sum(map(len, suites.values()))
    yield f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuites name="auditloom" tests="{total}" failures="{total}" time="{result.duration_ns / 1e9:.3f}">\n'
    for name, rows in suites.items():
        yield f"  <testsuite name={quoteattr(name)} tests=\"{len(rows)}\" failures=\"{len(rows)}\">\n"
        for r in rows:
            yield (
                f"    <testcase name={quoteattr(r['check_name'])} classname={quoteattr(r['url'])}>\n      <failure message={quoteattr(r['message'])} type={quoteattr(r['severity'])}>"
                f"{escape(r['detail'])}</failure>\n    </testcase>\n"
            )
        yield "  </testsuite>\n"
    yield "</testsuites>\n"


def to_terminal(result: Result, colour: bool = False) -> Iterator[str]:
    paint = {"critical": "\033[31m", "warning": "\033[33m", "info": "\033[36m"} if colour else {}
    n = result.counts()
    yield f"Site audit of {result.seed_url}: {result.pages} pages in {_seconds(result.duration_ns)}\n\n"
    for s in _LEVEL:
        yield f"  {paint.get(s, '')}{s:<9}{'\033[0m' if paint else ''} {n.get(s, 0)}\n"
    yield "\n"
    for r in S.by_category(result.issues).orderBy("category").collect():
        yield f"  {r['category']:<18} {r['n']}\n"
    last = None
    for r in result.rows():
        if r["severity"] != last:
            last = r["severity"]
            yield f"\n{(last or 'other').upper()}\n"
        yield f"  [{r['check_name']}] {r['url']}: {r['message']}\n"


def to_pdf(result: Result) -> Iterator[str]:
    raise NotImplementedError("pdf is printed by a browser from the html report; write html and print that")


WRITERS = {"terminal": to_terminal, "json": to_json, "csv": to_csv, "markdown": to_markdown, "html": to_html, "sarif": to_sarif, "junit": to_junit, "jsonl": to_jsonl, "pdf": to_pdf}


def write_reports(result: Result, formats: list[str], file: str = "") -> None:
    """One format goes to the file itself, several to the file with their names appended, none to standard output."""
    for f in formats:
        if f not in WRITERS:
            raise ValueError(f"unknown output format {f!r}")
    for f in formats:
        if not file:
            for part in WRITERS[f](result):
                sys.stdout.write(part)
            continue
        name = file if len(formats) == 1 else f"{file}.{f}"
        with open(name, "w", encoding="utf-8") as out:
            for part in WRITERS[f](result):
                out.write(part)


def write_issues(issues: DataFrame, folder: str, kind: str = "csv") -> None:
    """Issues of any number as a folder of files."""
    if kind == "csv":
        safe = [F.when(F.rlike(c, F.lit("^[=+\\-@\\t\\r]")), F.concat(F.lit("\t"), F.col(c))).otherwise(F.col(c)).alias(c) for c in ISSUE_COLS]
        issues.select(*safe).write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(folder)
    elif kind == "jsonl":
        issues.select(*ISSUE_COLS).write.mode("overwrite").json(folder)
    elif kind == "parquet":
        issues.select(*ISSUE_COLS).write.mode("overwrite").parquet(folder)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def prometheus(result: Result, namespace: str = "auditloom") -> str:
    """Gauges in text exposition form; the score is 100 less deductions, floored at 0."""
    n = result.counts()
    score = max(0, 100 - sum(S.DEDUCTION.get(k, 0) * v for k, v in n.items()))
    esc = lambda s: s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    out = []

    def gauge(name, text, rows):
        out.append(f"# HELP {namespace}_{name} {text}\n# TYPE {namespace}_{name} gauge")
        out.extend(f"{namespace}_{name}{{{k}=\"{esc(v)}\"}} {x}" if k else f"{namespace}_{name} {x}" for k, v, x in rows)

    gauge("issues_total", "Total number of audit issues found.", [("severity", k, v) for k, v in n.items()])
    gauge("pages_crawled", "Number of pages crawled.", [("", "", result.pages)])
    gauge("crawl_duration_seconds", "Total crawl duration in seconds.", [("", "", result.duration_ns / 1e9)])
    gauge("health_score", "Overall site health score (0-100).", [("", "", score)])
    gauge("issues_by_category", "Number of issues by category.", [("category", r["category"], r["n"]) for r in S.by_category(result.issues).orderBy("category").collect()])
    return "\n".join(out) + "\n"
