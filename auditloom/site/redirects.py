"""Redirect entries of a crawl and their issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.model import INFO, WARNING, issue
from auditloom.site.links import _blocks, as_issues, link_rows, union_issues


def redirect_map(pages: DataFrame) -> DataFrame:
    """``(from, to, chain, hops)`` of pages reached by redirect, longest chains first."""
    r = pages.where(F.size("redirect_chain") > 0).select(
        F.col("redirect_chain")[0].alias("from"), F.col("url").alias("to"), F.concat("redirect_chain", F.array("url")).alias("chain"), F.size("redirect_chain").alias("hops")
    )
    return r


def linked_by(pages: DataFrame) -> DataFrame:
    """``(from, src)``: each page that links to a redirecting address, once per entry."""
    r = redirect_map(pages).select("from", "to")
    return link_rows(pages).select("src", F.col("dst").alias("from")).distinct().join(r, "from")


def redirect_issues(pages: DataFrame) -> DataFrame:
    r = redirect_map(pages)
    f, t = F.col("from"), F.col("to")
    chained = r.join(r.select(F.col("from").alias("to")).distinct(), "to", "left_semi")
    return union_issues(
        as_issues(r.where("hops > 2"), issue("redirects/long-chain", WARNING, F.concat(F.format_string("redirect chain has %d hops (", F.col("hops")), F.array_join("chain", " -> "), F.lit(")")), url=f)),
        as_issues(linked_by(pages), issue("redirects/internal-redirect", INFO, F.concat(F.lit("links to "), f, F.lit(" which redirects to "), t, F.lit(" (update link to final URL)")), url=F.col("src"))),
        as_issues(chained, issue("redirects/redirect-to-redirect", WARNING, F.concat(F.lit("redirects to "), t, F.lit(" which is itself a redirect")), url=f)),
    )


def redirect_csv(pages: DataFrame) -> DataFrame:
    """Rows of the redirect file, ordered by hops descending, then source; one more row for each further SOURCES linking pages."""
    by = _blocks(linked_by(pages), ["from", "to"], "src").groupBy("from", "to", "block").agg(F.array_sort(F.collect_set("src")).alias("linked"))
    return (
        redirect_map(pages).join(by, ["from", "to"], "left")
        .orderBy(F.col("hops").desc(), "from", "block")
        .select("from", "to", F.array_join("chain", " -> ").alias("chain"), "hops", F.coalesce(F.array_join("linked", " "), F.lit("")).alias("linked_by"))
    )
