"""Issues against a saved baseline, as multisets of (check, URL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.model import ISSUE, ISSUE_COLS


def baseline_diff(current: DataFrame, baseline: DataFrame, seq: str = "seq") -> DataFrame:
    """``(status, *issue)``: of a key with N current and M baseline issues, the first min(N, M) are ``existing``, the rest
    ``new``; the first M - N of the baseline are ``resolved``. Order is by ``seq``.

    Only counts are joined, so a key of very many issues doesn't multiply, and rows are numbered only where
    a key's issues fall on both sides.
    """
    key = ["check_name", "url"]
    current, baseline = current.fillna("", key), baseline.fillna("", key)  # a null key is an empty one
    n_cur = current.groupBy(*key).agg(F.count("*").alias("n_cur"))
    n_base = baseline.groupBy(*key).agg(F.count("*").alias("n_base"))
    both = n_cur.join(n_base, key, "full").select(*key, F.coalesce("n_cur", F.lit(0)).alias("n_cur"), F.coalesce("n_base", F.lit(0)).alias("n_base"))
    now = _first(current.join(both, key), key, seq, F.least("n_cur", "n_base"), F.col("n_cur"))
    old = _first(baseline.join(both.where("n_base > n_cur"), key), key, seq, F.col("n_base") - F.col("n_cur"), F.col("n_base"))
    a = now.select(F.when(F.col("_first"), "existing").otherwise("new").alias("status"), *ISSUE_COLS)
    return a.unionByName(old.where("_first").select(F.lit("resolved").alias("status"), *ISSUE_COLS))


def _first(rows: DataFrame, key: list[str], seq: str, k, n) -> DataFrame:
    """``_first``: whether the row is among the first ``k`` of its key's ``n``."""
    t = rows.withColumn("_k", k).withColumn("_n", n)
    w = Window.partitionBy(*key).orderBy(seq, "message", "detail")
    plain = t.where((F.col("_k") == 0) | (F.col("_k") >= F.col("_n"))).withColumn("_first", F.col("_k") > 0)
    split = t.where((F.col("_k") > 0) & (F.col("_k") < F.col("_n"))).withColumn("_first", F.row_number().over(w) <= F.col("_k"))
    return plain.unionByName(split)


def save_baseline(issues: DataFrame, path: str, seed_url: str) -> None:
    """One folder of JSON lines, each issue with its place, beside the seed and version."""
    if "seq" not in issues.columns:
        issues = issues.withColumn("seq", F.monotonically_increasing_id())
    issues.select("seq", *ISSUE_COLS, F.lit(seed_url).alias("seed_url"), F.lit("1").alias("version"), F.current_timestamp().alias("created_at")).write.mode("overwrite").json(path)


def load_baseline(spark, path: str) -> DataFrame:
    return spark.read.schema(f"seq long, {ISSUE}, seed_url string, version string, created_at timestamp").json(path)
