"""Exact and near duplicates of page bodies, and thin pages."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.columns import rounded
from auditloom.model import INFO, WARNING, issue
from auditloom.session import materialise, ship
from auditloom.site.links import as_issues, union_issues

HAMMING, THIN = 3, 100
#: The 64 bits in BANDS bands; each KEEP of them key one table, so hashes that differ in BANDS - KEEP bits at most agree in one.
BANDS, KEEP = 6, 3
#: Members of one block of a hot band; two blocks meet in one task.
BLOCK = 2000


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """64-bit SimHash over white-space separated words, each hashed by FNV-1a; 0 for empty text."""
    import numpy as np

    seen: dict[str, int] = {}

    def word(w: str) -> int:
        h = seen.get(w)
        if h is None:
            h = 0xCBF29CE484222325
            for b in w.encode():
                h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
            seen[w] = h
        return h

    out = []
    for t in texts:
        ws = t.split() if t else []
        if not ws:
            out.append(0)
            continue
        bits = np.unpackbits(np.array([word(w) for w in ws], dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        up = bits.sum(axis=0, dtype=np.int64) * 2 > len(ws)
        out.append(int(np.packbits(up, bitorder="little").view(np.int64)[0]))
    return pd.Series(out)


def body_classes(rows: DataFrame, key: str = "seq", body: str = "body", text: str = "text", url: str = "url") -> DataFrame:
    """``(seq, url, sha, sim, n_words)``, one row per record; ``text`` is the visible text."""
    ship(rows.sparkSession)
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\u0085   -     　]+"), lambda x: x != ""))
    return rows.select(
        F.col(key).alias("seq"), F.col(url).alias("url"), F.sha2(F.coalesce(body, F.lit("")), 256).alias("sha"),
        simhash(F.coalesce(text, F.lit(""))).alias("sim"), words.alias("n_words"),
    )


def exact_issues(classes: DataFrame, all_pairs: bool = False) -> DataFrame:
    """Copies of one body. By default the first page has an issue for each later copy, ``n - 1`` for a group of ``n``.

    ``all_pairs`` gives one issue for each pair, a quadratic number. The first page is a minimum taken
    before the shuffle; copies are never sorted or gathered.
    """
    if all_pairs:
        a, b = classes.alias("a"), classes.alias("b")
        pairs = a.join(b, (F.col("a.sha") == F.col("b.sha")) & (F.col("a.seq") < F.col("b.seq"))).select(F.col("a.url").alias("u"), F.col("b.url").alias("v"))
    else:
        first = classes.groupBy("sha").agg(F.min(F.struct("seq", "url")).alias("m"))
        pairs = classes.join(first, "sha").where(F.col("seq") != F.col("m.seq")).select(F.col("m.url").alias("u"), F.col("url").alias("v"))
    return as_issues(pairs, issue("content/exact-duplicate", WARNING, F.concat(F.lit("page is an exact duplicate of "), F.col("v")), url=F.col("u")))


def _keys(sim):
    """``struct(table, masked hash)`` of every table."""
    edge = [round(64 * i / BANDS) for i in range(BANDS + 1)]
    for n, bands in enumerate(combinations(range(BANDS), KEEP)):
        mask = sum(((1 << (edge[b + 1] - edge[b])) - 1) << edge[b] for b in bands)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        yield F.struct(F.lit(n).alias("k"), sim.bitwiseAND(F.lit(mask).cast("long")).alias("v"))


def near_pairs(classes: DataFrame, most: int = HAMMING) -> DataFrame:
    """``(seq_a, seq_b, distance)`` between the first pages of different bodies whose SimHashes differ in ``most`` bits at most.

    Two such hashes agree in all bands but ``most``, so in one table's key: the search is exact, and keys of
    about 32 bits keep chance meetings rare for any number of pages. Bodies with one hash are paired with
    the first of them only, and a key that many hashes share is joined in blocks.
    """
    if most > BANDS - KEEP:
        raise ValueError(f"at most {BANDS - KEEP} bits")
    bodies = materialise(classes.groupBy("sha").agg(F.min("seq").alias("seq"), F.first("sim").alias("sim")))
    hashes = materialise(bodies.groupBy("sim").agg(F.min("seq").alias("seq")))
    same = bodies.join(hashes.withColumnRenamed("seq", "first"), "sim").where("seq <> first")
    idx = hashes.select("seq", "sim", F.explode(F.array(*_keys(F.col("sim")))).alias("b")).select("seq", "sim", "b.k", "b.v")
    sized = idx.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1").select("k", "v", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    live = idx.join(sized, ["k", "v"]).withColumn("blk", F.pmod(F.xxhash64("sim"), F.col("nb")).cast("int"))
    span = F.sequence(F.lit(0), F.col("nb") - 1)
    left = live.select("k", "v", F.col("seq").alias("sa"), F.col("sim").alias("ha"), F.col("blk").alias("i"), F.explode(span).alias("j"))
    right = live.select("k", "v", F.col("seq").alias("sb"), F.col("sim").alias("hb"), F.explode(span).alias("i"), F.col("blk").alias("j"))
    d = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    across = left.join(right, ["k", "v", "i", "j"]).where("sa < sb").withColumn("distance", d).where(F.col("distance") <= most).select(F.col("sa").alias("seq_a"), F.col("sb").alias("seq_b"), "distance").distinct()
    return across.unionByName(same.select(F.col("first").alias("seq_a"), F.col("seq").alias("seq_b"), F.lit(0).alias("distance")))


def all_near_pairs(classes: DataFrame, most: int = HAMMING) -> DataFrame:
    """``(seq_a, seq_b, distance)``, seq_a < seq_b, of all pages with different bodies whose SimHashes differ in ``most`` bits at most.

    The pairs of hashes come from ``near_pairs``; their pages meet BLOCK pages against BLOCK a task. The
    number of pairs is quadratic in the pages of a hash.
    """
    classes = materialise(classes.select("seq", "sha", "sim"))
    sims = materialise(classes.groupBy("sim").agg(F.min("seq").alias("seq"), F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")))
    firsts = sims.select("seq", F.col("sim").cast("string").alias("sha"), "sim")  # each hash as one body
    met = near_pairs(firsts, most)
    named = lambda x: sims.select(F.col("seq").alias(f"seq_{x}"), F.col("sim").alias(f"s{x}"), F.col("nb").alias(f"n{x}"))
    pairs = met.join(named("a"), "seq_a").join(named("b"), "seq_b").select("sa", "na", "sb", "nb", "distance")
    pairs = pairs.unionByName(sims.select(F.col("sim").alias("sa"), F.col("nb").alias("na"), F.col("sim").alias("sb"), "nb", F.lit(0).alias("distance")))
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    at = classes.join(sims.select("sim", "nb"), "sim").withColumn("blk", F.pmod(F.xxhash64("seq"), F.col("nb")).cast("int"))
    left = at.select(F.col("seq").alias("x"), F.col("sha").alias("hx"), F.col("sim").alias("sa"), F.col("blk").alias("i"))
    right = at.select(F.col("seq").alias("y"), F.col("sha").alias("hy"), F.col("sim").alias("sb"), F.col("blk").alias("j"))
    out = pairs.select("sa", "i", "sb", "j", "distance").join(left, ["sa", "i"]).join(right, ["sb", "j"]).where("hx <> hy AND (sa <> sb OR x < y)")
    return out.select(F.least("x", "y").alias("seq_a"), F.greatest("x", "y").alias("seq_b"), "distance")


def near_issues(classes: DataFrame, all_pairs: bool = False) -> DataFrame:
    """Near-duplicates that are no exact ones, at the earlier page, with their similarity in percent.

    By default between the first pages of bodies and hashes; ``all_pairs`` gives one issue for each pair of pages.
    """
    urls = classes.select("seq", "url")
    p = (all_near_pairs(classes) if all_pairs else near_pairs(classes)).join(urls.select(F.col("seq").alias("seq_a"), F.col("url").alias("ua")), "seq_a").join(urls.select(F.col("seq").alias("seq_b"), F.col("url").alias("ub")), "seq_b")
    pct = rounded((64 - F.col("distance")) / 64 * 100)
    return as_issues(p, issue("content/near-duplicate", INFO, F.concat(F.lit("page is near-duplicate of "), F.col("ub"), F.lit(" (similarity: "), pct, F.lit("%)")), url=F.col("ua")))


def thin_issues(classes: DataFrame, least: int = THIN) -> DataFrame:
    least = least if least > 0 else THIN
    return as_issues(classes.where(F.col("n_words") < least), issue("content/thin-content", INFO, F.format_string("page has only %d words of text content", F.col("n_words"))))


def duplicate_issues(classes: DataFrame, thin: int = THIN) -> DataFrame:
    c = materialise(classes)
    return union_issues(exact_issues(c), near_issues(c), thin_issues(c, thin))
