"""Column helpers for URLs, headers, globs and number formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTH = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def header(name: str) -> Column:
    """First value of a response header, '' if absent."""
    return F.coalesce(F.try_element_at(F.try_element_at(F.col("headers"), F.lit(name)), F.lit(1)), F.lit(""))


def header_values(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("headers"), F.lit(name)), F.array().cast("array<string>"))


def authority(url: Column) -> Column:
    """Host with port, without user info, as written; also of ``//host/path``."""
    a = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(a, r"^.*@", "")


def host(url: Column) -> Column:
    """Lower-case host without port; '' if the URL names none."""
    return F.lower(F.regexp_replace(authority(url), r":\d*$", ""))


def path(url: Column) -> Column:
    """Path of an absolute URL, without query and fragment."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def is_html(content_type: Column = None) -> Column:
    c = F.col("content_type") if content_type is None else content_type
    return F.coalesce(F.contains(F.lower(c), F.lit("text/html")), F.lit(False))


def mime(content_type: Column) -> Column:
    """The media type without parameters."""
    return F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))


def glob_regex(glob: str) -> str | None:
    """A shell pattern as an anchored regex: ``*`` and ``?`` stay within a path segment. None for a malformed one."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            j = i + 1
            if j < len(glob) and glob[j] == "^":
                j += 1
            k = glob.find("]", j + 1)
            if k < 0 or k == j:
                return None
            body = glob[i + 1 : k]
            if body.endswith("-") or body.startswith("-"):
                return None
            out += "[" + body.replace("\\", "\\\\") + "]"
            i = k
        elif c == "\\":
            i += 1
            if i >= len(glob):
                return None
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def rounded(x: Column) -> Column:
    """Half-to-even rounding to a whole number, as text."""
    return F.bround(x.cast("double"), 0).cast("long").cast("string")


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", F.bround(x.cast("double"), 1))


def quoted(x: Column) -> Column:
    """Text in double quotes with backslash escapes."""
    e = x
    for a, b in (("\\\\", "\\\\\\\\"), ('"', '\\\\"'), ("\n", "\\\\n"), ("\t", "\\\\t"), ("\r", "\\\\r")):
        e = F.regexp_replace(e, a, b)
    return F.concat(F.lit('"'), e, F.lit('"'))


def duration(ns: Column) -> Column:
    """Nanoseconds rounded to milliseconds in the form 1h2m3.5s, 2.5s or 15ms."""
    ms = F.round(ns / 1_000_000, 0).cast("long")
    h, m = F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000)
    s = (ms % 60_000) / F.lit(1000.0)
    sec = F.concat(F.regexp_replace(F.regexp_replace(F.format_string("%.3f", s), "0+$", ""), r"\.$", ""), F.lit("s"))
    return (
        F.when(ms == 0, "0s")
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(h > 0, F.concat(h.cast("string"), F.lit("h"), m.cast("string"), F.lit("m"), sec))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m"), sec))
        .otherwise(sec)
    )
