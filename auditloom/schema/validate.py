"""Checks of JSON-LD objects against the registry, as ``(code, severity, message, path)``."""

from __future__ import annotations

import datetime
import re

from auditloom.functions.text import go_quote

MAX_DEPTH = 3
_DATE = re.compile(r"^\d{4}-\d\d-\d\d$")
# fixed values: the contexts that name the vocabulary
CONTEXTS = ("http://schema.org", "https://schema.org")


def types_of(v) -> list[str]:
    if isinstance(v, str):
        return [v]
    return [x for x in v if isinstance(x, str)] if isinstance(v, list) else []


def is_date(s: str) -> bool:
    """The first ten bytes are a calendar date."""
    s = s.encode()[:10].decode(errors="replace")
    if not _DATE.match(s):
        return False
    try:
        datetime.date.fromisoformat(s)
        return True
    except ValueError:
        return False


def is_url(s: str) -> bool:
    return s.startswith(("http://", "https://", "/"))


def _known_context(s) -> bool:
    return isinstance(s, str) and s.rstrip("/") in CONTEXTS


def _context(obj: dict):
    if "@context" not in obj:
        yield "missing-context", "info", "JSON-LD block has no @context", "@context"
        return
    c = obj["@context"]
    if isinstance(c, str):
        if not _known_context(c):
            yield "wrong-context", "warning", f"@context does not point to schema.org: {c}", "@context"
    elif isinstance(c, dict):
        v = c.get("@vocab")
        if isinstance(v, str) and not _known_context(v):
            yield "wrong-context", "warning", f"@context @vocab does not point to schema.org: {v}", "@context.@vocab"
    elif isinstance(c, list):
        if not any(_known_context(x) or isinstance(x, dict) and _known_context(x.get("@vocab")) for x in c):
            yield "wrong-context", "warning", "@context array does not contain a schema.org reference", "@context"


def _at(path: str, name: str) -> str:
    return f"{path}.{name}" if path else name


def _object(obj: dict, registry: dict, path: str = "", depth: int = 0):
    if depth >= MAX_DEPTH:
        return
    graph = obj.get("@graph")
    if depth == 0 and isinstance(graph, list):
        for item in graph:
            if isinstance(item, dict):
                yield from _object(item, registry, path, depth)
        return
    if "@type" not in obj:
        yield "missing-type", "warning", "JSON-LD block has no @type field", _at(path, "@type")
        return
    for name in types_of(obj["@type"]):
        t = registry.get(name)
        if t is None:
            yield "unknown-type", "info", f"JSON-LD @type {go_quote(name)} is not a commonly recognised Schema.org type", _at(path, "@type")
            continue
        for f in t.required:
            if f not in obj:
                yield "missing-required-field", "warning", f"{name} is missing required field {go_quote(f)}", _at(path, f)
        for prop, p in t.properties.items():
            if prop in obj:
                yield from _property(prop, obj[prop], p, registry, _at(path, prop), depth)


def _property(name: str, v, p, registry: dict, path: str, depth: int):
    q = go_quote(name)
    if p.is_date:
        if not isinstance(v, str):
            yield "invalid-date-format", "warning", f"JSON-LD field {q} has a non-string value; expected ISO 8601 date", path
        elif not is_date(v):
            yield "invalid-date-format", "warning", f"JSON-LD field {q} has invalid date value {go_quote(v)}; expected ISO 8601 format (YYYY-MM-DD)", path
    if p.is_url:
        bad = [x for x in (v if isinstance(v, list) else [v]) if isinstance(x, str) and not is_url(x)]
        for x in bad:
            yield "invalid-url-field", "warning", f"JSON-LD field {q} has invalid URL value {go_quote(x)}; expected http://, https://, or /", path
        if not isinstance(v, (str, list, dict)):
            yield "invalid-url-field", "warning", f"JSON-LD field {q} has a non-string/non-array value; expected a URL", path
    if p.enum and isinstance(v, str) and v not in p.enum:
        yield "invalid-enum-value", "warning", f"JSON-LD field {q} has value {go_quote(v)}; expected one of: {', '.join(p.enum)}", path
    if p.expected and isinstance(v, dict) and "@type" in v:
        ts = types_of(v["@type"])
        if ts and not set(ts) & set(p.expected):
            yield "invalid-nested-type", "warning", f"JSON-LD field {q} has nested @type {go_quote(', '.join(ts))}; expected one of: {', '.join(p.expected)}", f"{path}.@type"
        yield from _object(v, registry, path, depth + 1)


def _google(obj: dict, registry: dict):
    for name in types_of(obj.get("@type")):
        t = registry.get(name)
        if t is None:
            continue
        if not t.eligible:
            yield "not-google-eligible", "info", f"{name} is not eligible for Google Rich Results", "@type"
            continue
        for fields, code, sev, what in ((t.google_required, "google-missing-required", "warning", "required"), (t.google_recommended, "google-missing-recommended", "info", "recommended")):
            gone = [f for f in fields if f not in obj]
            if gone:
                yield code, sev, f"Google Rich Results: {name} is missing {what} fields: {', '.join(gone)}", "@type"


def _across(objects: list[dict]):
    counts: dict[str, int] = {}
    for o in objects:
        for t in types_of(o.get("@type")):
            counts[t] = counts.get(t, 0) + 1
    for t in sorted(k for k, n in counts.items() if n > 1):
        yield "duplicate-type", "info", f"multiple JSON-LD blocks declare @type {go_quote(t)} ({counts[t]} occurrences)", ""
    for o in objects:
        if "BreadcrumbList" in types_of(o.get("@type")) and isinstance(o.get("itemListElement"), list):
            for i, item in enumerate(o["itemListElement"]):
                pos = item.get("position") if isinstance(item, dict) else None
                if isinstance(pos, (int, float)) and not isinstance(pos, bool) and pos != i + 1:
                    yield "breadcrumb-positions", "warning", f"BreadcrumbList item at index {i} has position {pos:.0f}; expected {i + 1}", ""
                    break
    for o in objects:
        act = o.get("potentialAction")
        if "WebSite" in types_of(o.get("@type")) and isinstance(act, dict) and "SearchAction" in types_of(act.get("@type")):
            target = act.get("target")
            if isinstance(target, dict):
                target = target.get("urlTemplate")
            if isinstance(target, str) and target and "{search_term_string}" not in target:
                yield "search-action-template", "warning", "WebSite SearchAction target is missing {search_term_string} template variable", ""


def page_findings(values: list, registry: dict) -> list[tuple[str, str, str, str]]:
    """Findings of all blocks of a page: context, types and fields, search-result rules, then across blocks.

    A null block counts as an empty object; scalars count for nothing. Context and search-result rules
    look at outer objects only, the cross checks at the members of ``@graph``.
    """
    tops: list[dict] = []
    for v in values:
        if v is None:
            tops.append({})
        elif isinstance(v, dict):
            tops.append(v)
        elif isinstance(v, list):
            tops += [x for x in v if isinstance(x, dict)]
    flat = [m for o in tops for m in ([x for x in o["@graph"] if isinstance(x, dict)] if isinstance(o.get("@graph"), list) else [o])]
    out: list = []
    for o in tops:
        out += [*_context(o), *_object(o, registry), *_google(o, registry)]
    return out + list(_across(flat))
