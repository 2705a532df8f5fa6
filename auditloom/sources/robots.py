"""Robots rules as a table: parsing, pattern compilation and decisions by join."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.columns import authority
from auditloom.session import ship

LONGEST_PATTERN = 500
_RULES = T.ArrayType(T.StructType([T.StructField("pattern", T.StringType()), T.StructField("allow", T.BooleanType()), T.StructField("regex", T.StringType())]))


def pattern_regex(pattern: str) -> str:
    """Anchored regex of a path pattern: ``*`` is any text, a final ``$`` ends the path; very long ones are plain prefixes."""
    if len(pattern.encode()) > LONGEST_PATTERN or not ("*" in pattern or pattern.endswith("$")):
        return "^" + re.escape(pattern)
    end = pattern.endswith("$")
    body = ".*".join(re.escape(p) for p in (pattern[:-1] if end else pattern).split("*"))
    return f"^{body}{'$' if end else ''}"


def parse_robots(text: str, user_agent: str) -> list[tuple[str, bool, str]]:
    """``(pattern, allow, regex)`` of the groups for this agent, or else of the groups for all."""
    own_agent = user_agent.lower()
    groups: list[tuple[list[str], list[tuple[str, bool]]]] = []
    naming = False
    for line in text.splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not naming:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            naming = True
            continue
        naming = False
        if key in ("allow", "disallow") and value and groups:
            groups[-1][1].append((value, key == "allow"))
    mine = [g for g in groups if any(a != "*" and a in own_agent for a in g[0])]
    rest = [g for g in groups if "*" in g[0]]
    return [(p, allow, pattern_regex(p)) for _, rules in (mine or rest) for p, allow in rules]


def robots_rules(files: DataFrame, user_agent: str) -> DataFrame:
    """``files(host, text)`` to ``(host, pattern, allow, regex)``; hosts without rules have no row."""
    ship(files.sparkSession)

    @F.pandas_udf(_RULES)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"pattern": p, "allow": a, "regex": r} for p, a, r in parse_robots(t or "", user_agent)])

    return files.select("host", F.explode(run("text")).alias("r")).select("host", "r.*")


def decide(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``(url, allowed)``: the longest matching pattern decides, allow wins ties, no rule allows."""
    target = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    u = urls.select(url).distinct().select(F.col(url).alias("url"), F.lower(authority(F.col(url))).alias("host"), F.when(target == "", F.lit("/")).otherwise(target).alias("p"))
    j = u.join(rules, "host").where(F.rlike("p", F.col("regex")))
    best = j.groupBy("url").agg(F.max(F.struct(F.octet_length("pattern").alias("n"), F.col("allow").alias("allow"))).alias("m"))
    return u.select("url").join(best, "url", "left").select("url", F.coalesce("m.allow", F.lit(True)).alias("allowed"))
