"""Checks of security headers, cookies and subresource integrity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.checks import each, guarded, none, when
from auditloom.functions.columns import header, header_values, host, is_html, quoted
from auditloom.model import INFO, WARNING, issue

HSTS_LEAST = 31_536_000


def _max_age(value: Column) -> Column:
    """The first max-age directive, -1 if missing or no number."""
    part = F.try_element_at(F.filter(F.transform(F.split(value, ";"), lambda x: F.lower(F.trim(x))), lambda x: F.startswith(x, F.lit("max-age="))), F.lit(1))
    return F.coalesce(F.trim(F.substring(part, 9, 30)).try_cast("bigint"), F.lit(-1))


def _cookie(raw: Column) -> Column:
    low = F.lower(raw)
    name = F.when(F.contains(raw, F.lit("=")), F.trim(F.split_part(raw, F.lit("="), F.lit(1)))).otherwise(raw)
    gone = F.array_compact(F.array(*[F.when(~F.contains(low, F.lit(f.lower())), F.lit(f)) for f in ("HttpOnly", "Secure", "SameSite")]))
    return F.when(F.size(gone) > 0, F.concat(F.lit("cookie "), quoted(name), F.lit(" is missing "), F.array_join(gone, ", "), F.lit(" flag(s)")))


def external(url: Column) -> Column:
    """The URL names a host other than the page's."""
    h = host(url)
    return (h != "") & (h != host(F.col("url")))


def checks() -> Column:
    hsts, csp, ref = header("strict-transport-security"), header("content-security-policy"), header("referrer-policy")
    age = _max_age(hsts)
    https = F.startswith(F.col("url"), F.lit("https://"))
    unsafe = F.array_compact(F.array(*[F.when(F.contains(csp, F.lit(x)), F.lit(x)) for x in ("'unsafe-inline'", "'unsafe-eval'")]))
    cookies = F.filter(F.transform(header_values("set-cookie"), _cookie), lambda x: x.isNotNull())
    scripts = F.filter("d.scripts", lambda s: (F.coalesce(s["src"], F.lit("")) != "") & external(s["src"]) & ~s["integrity"])
    css = F.filter("d.css", lambda c: (c["href"] != "") & external(c["href"]) & ~c["integrity"])
    sri = lambda kind: lambda u: issue("security/missing-sri", INFO, F.concat(F.lit(f"external {kind} "), quoted(u), F.lit(" is missing integrity attribute")))
    low_ref = F.lower(F.trim(ref))
    return guarded(
        F.col("status_code") == 200,
        [
            when(https & (hsts == ""), issue("security/missing-strict-transport-security", WARNING, "HTTPS page is missing the Strict-Transport-Security header")),
            when((hsts != "") & https & (age >= 0) & (age < HSTS_LEAST), issue("security/weak-hsts", INFO, F.format_string("HSTS max-age is %d seconds, recommended minimum is 31536000 (1 year)", age))),
            when(csp == "", issue("security/missing-content-security-policy", WARNING, "page is missing the Content-Security-Policy header")),
            when(F.size(unsafe) > 0, issue("security/csp-unsafe", WARNING, F.concat(F.lit("Content-Security-Policy contains "), F.array_join(unsafe, " and ")))),
            when(F.lower(header("x-content-type-options")) != "nosniff", issue("security/missing-x-content-type-options", WARNING, "page is missing X-Content-Type-Options: nosniff")),
            when(~F.upper(header("x-frame-options")).isin("DENY", "SAMEORIGIN"), issue("security/missing-x-frame-options", INFO, "page is missing X-Frame-Options (expected DENY or SAMEORIGIN)")),
            when(ref == "", issue("security/missing-referrer-policy", INFO, "page is missing the Referrer-Policy header")),
            when(low_ref.isin("unsafe-url", "no-referrer-when-downgrade"), issue("security/insecure-referrer-policy", WARNING, F.concat(F.lit("Referrer-Policy "), quoted(low_ref), F.lit(" leaks the full URL on cross-origin requests")))),
            when(header("permissions-policy") == "", issue("security/missing-permissions-policy", INFO, "page is missing the Permissions-Policy header")),
            each(cookies, lambda t: issue("security/insecure-cookies", WARNING, t)),
            when(F.trim(header("access-control-allow-origin")) == "*", issue("security/cors-wildcard", WARNING, "Access-Control-Allow-Origin is set to wildcard (*)")),
            F.when(
                F.coalesce(is_html() & (F.octet_length("body") > 0), F.lit(False)),
                F.concat(each(F.transform(scripts, lambda s: s["src"]), sri("script")), each(F.transform(css, lambda c: c["href"]), sri("stylesheet"))),
            ).otherwise(none()),
        ],
    )
