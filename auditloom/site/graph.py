"""The internal link graph, its ranks and exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from auditloom.functions.columns import authority
from auditloom.model import INFO, issue
from auditloom.session import bucketed, materialise, release
from auditloom.site.links import as_issues, link_rows

DAMPING, ITERATIONS, HIGH_OUT = 0.85, 20, 100


def graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes(url), edges(src, dst, n))``: links between known pages of one host, without self-links.

    Repeated links are one edge with their number as weight, so they are combined before the shuffle.
    """
    nodes = pages.where(F.col("url").isNotNull()).select("url").distinct()
    raw = link_rows(pages).where((F.col("src") != F.col("dst")) & (F.lower(authority(F.col("src"))) == F.lower(authority(F.col("dst")))))
    edges = raw.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return nodes, edges.join(nodes.withColumnRenamed("url", "dst"), "dst", "left_semi").select("src", "dst", "n")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """``(url, rank)``; rank of pages without outgoing links is spread evenly.

    The edges are written once in buckets of their source, so no round shuffles them: a round is one job that
    takes the ranks to the edges and sums what each page gets, within the buckets first. What pages receive is written and its sum counted
    while writing; the rest of the total rank of one lay on pages without links, so their share is a
    number in the next round's expression, not a second branch of its plan.
    """
    nodes = materialise(nodes)
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("rank", F.lit(0.0))
    edges = materialise(edges)
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    weighted = bucketed(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("w")), "src", edges.count())
    state, even = nodes.withColumn("got", F.lit(0.0)), 1.0 / n
    for _ in range(iterations):
        ranks = state.select(F.col("url").alias("src"), (F.lit(even) + F.lit(damping) * F.col("got")).alias("rank"))
        got = weighted.join(ranks, "src").groupBy(F.col("dst").alias("url")).agg(F.sum(F.col("w") * F.col("rank")).alias("got"))
        total = Observation()
        step = nodes.join(got, "url", "left").select("url", F.coalesce("got", F.lit(0.0)).alias("got"))
        now = materialise(step.observe(total, F.sum("got").alias("got")))
        even = (1 - damping) / n + damping * (1.0 - total.get["got"]) / n
        release(state)
        state = now
    release(weighted, edges)
    return state.select("url", (F.lit(even) + F.lit(damping) * F.col("got")).alias("rank"))


def low_rank_issues(ranks: DataFrame) -> DataFrame:
    """Pages at or below the rank at position ``int(n / 10)`` of the ascending order."""
    n = ranks.count()
    if n <= 1:
        return as_issues(ranks.limit(0), issue("links/low-internal-pagerank", INFO, "", url=F.col("url")))
    at = int(0.1 * n)
    cut = ranks.orderBy("rank").offset(at).limit(1).select(F.col("rank").alias("cut"))
    low = ranks.join(F.broadcast(cut), F.col("rank") <= F.col("cut"))  # one row
    return as_issues(low, issue("links/low-internal-pagerank", INFO, F.format_string("page has low internal PageRank score (%.6f)", F.col("rank"))))


def high_outgoing_issues(edges: DataFrame, most: int = HIGH_OUT) -> DataFrame:
    g = edges.groupBy(F.col("src").alias("url")).agg(F.sum("n").alias("out")).where(F.col("out") > most)
    return as_issues(g, issue("links/high-outgoing-links", INFO, F.format_string(f"page has %d outgoing internal links, maximum recommended is {most}", F.col("out"))))


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(edges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))))


def _label(url: str) -> str:
    rest = url.split("://", 1)[-1]
    return "/" + rest.split("/", 1)[1] if "/" in rest and rest.split("/", 1)[1] else rest if "/" not in rest else "/"


def export_dot(nodes: DataFrame, edges: DataFrame) -> str:
    """The graph as text for graph viewers; meant for graphs a viewer can show."""
    esc = lambda s: s.replace("\\", "\\\\").replace('"', '\\"')
    out = ["digraph linkgraph {", "  rankdir=LR;"]
    for r in nodes.orderBy("url").toLocalIterator():
        out.append(f'  "{esc(r.url)}" [label="{esc(_label(r.url))}"];')
    for r in edges.orderBy("src", "dst").toLocalIterator():
        out += [f'  "{esc(r.src)}" -> "{esc(r.dst)}";'] * r.n
    return "\n".join([*out, "}"]) + "\n"


def export_json(nodes: DataFrame, edges: DataFrame) -> str:
    return json.dumps(
        {
            "nodes": [{"url": r.url} for r in nodes.orderBy("url").toLocalIterator()],
            "edges": [{"from": r.src, "to": r.dst} for r in edges.orderBy("src", "dst").toLocalIterator() for _ in range(r.n)],
        },
        indent=2,
    )
