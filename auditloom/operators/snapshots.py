"""What changed between consecutive full snapshots of a table.

EXCEPT ALL in both directions, as one signed count: every row stands once for its snapshot as the later
of a pair and once as the earlier; rows that both hold equally often cancel out, a positive rest is what
the one direction leaves and a negative rest what the other does. Both residues then meet by key and
label additions, removals and changes. All of it is partitioned once, by series and key, so neither the
two directions nor the meeting of their residues shuffles again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_chain(snapshots: DataFrame, series: str, snapshot_id: str, taken_at: str) -> DataFrame:
    """Each snapshot with the one before it in its series, as ``(cur_id, prev_id, _series)``.

    Order is ``taken_at``, then ``snapshot_id``; a null time sorts first. The first snapshot of
    a series has no predecessor and yields no row. Repeated rows of one snapshot count once.
    Snapshots without a series or an id yield nothing.
    """
    one = (
        snapshots.select(
            F.col(series).alias("_series"), F.col(snapshot_id).alias("cur_id"), F.col(taken_at).alias("_at")
        )
        .where(F.col("_series").isNotNull() & F.col("cur_id").isNotNull())
        .groupBy("_series", "cur_id")
        .agg(F.max("_at").alias("_at"))
    )
    w = Window.partitionBy("_series").orderBy(F.col("_at").asc_nulls_first(), F.col("cur_id"))
    return one.select("cur_id", F.lag("cur_id").over(w).alias("prev_id"), "_series").where(F.col("prev_id").isNotNull())


def snapshot_diff(
    snapshots: DataFrame,
    rows: DataFrame,
    *,
    series: str,
    snapshot_id: str,
    taken_at: str,
    row_snapshot_id: str,
    position: str,
    keys: list[str],
    values: dict[str, Column],
    tie: str,
) -> DataFrame:
    """``(snapshot id, *keys, change)`` for each key that differs from the snapshot before.

    ``added``/``removed``: the key occurs in one of the two only; ``changed``: in both, with
    different multisets of ``values``, which are compared by a 64-bit hash. Rows of equal snapshot and
    ``position`` are one row, the one with the lowest ``tie``; rows without a position are kept apart.
    Null keys are keys like any other. Rows of unknown snapshots yield nothing. Empty inputs give an
    empty result.
    """
    key_cols = [f"k{i}" for i in range(len(keys))]
    # nulls and texts of any length are told apart: each value goes in with whether it is there
    value = F.xxhash64(*[c for v in values.values() for c in (v.isNull(), v)])
    picked = rows.select(
        F.col(row_snapshot_id).alias("_snap"), F.col(position).alias("_pos"), F.col(tie).alias("_tie"),
        F.struct(*[F.col(k).alias(c) for k, c in zip(keys, key_cols)], value.alias("v")).alias("_r"),
    ).where(F.col("_snap").isNotNull())
    once = (
        picked.withColumn("_solo", F.when(F.col("_pos").isNull(), F.col("_tie")))
        .groupBy("_snap", "_pos", "_solo")
        .agg(F.min(F.struct("_tie", "_r")).alias("_m"))
        .select("_snap", "_m._r.*")
    )
    chain = snapshot_chain(snapshots, series, snapshot_id, taken_at)
    roles = chain.select(F.col("cur_id").alias("_snap"), F.struct(F.col("cur_id").alias("pair"), F.lit(1).alias("sign")).alias("role"), "_series").unionByName(
        chain.select(F.col("prev_id").alias("_snap"), F.struct(F.col("cur_id").alias("pair"), F.lit(-1).alias("sign")).alias("role"), "_series")
    )
    roles = roles.groupBy("_snap", "_series").agg(F.collect_list("role").alias("roles"))  # two at most
    at = once.join(roles, "_snap").repartition("_series", *key_cols)
    signed = at.select("_series", *key_cols, "v", F.explode("roles").alias("role")).select("_series", *key_cols, "v", "role.pair", "role.sign")
    rest = signed.groupBy("_series", *key_cols, "pair", "v").agg(F.sum("sign").alias("net"), F.max("sign").alias("later"), F.min("sign").alias("earlier"))
    by_key = rest.groupBy("_series", *key_cols, "pair").agg(F.max(F.abs("net")).alias("residue"), F.max("later").alias("later"), F.min("earlier").alias("earlier")).where("residue > 0")
    change = F.when(F.col("earlier") > 0, F.lit("added")).when(F.col("later") < 0, F.lit("removed")).otherwise(F.lit("changed"))
    return by_key.select(F.col("pair").alias(snapshot_id), *[F.col(c).alias(k) for c, k in zip(key_cols, keys)], change.alias("change"))


def issue_changes(baselines: DataFrame, baseline_issues: DataFrame) -> DataFrame:
    """Changes of issues by ``(check_name, url)`` between the baselines of each seed URL."""
    return snapshot_diff(
        baselines,
        baseline_issues,
        series="seed_url",
        snapshot_id="baseline_id",
        taken_at="created_at",
        row_snapshot_id="baseline_id",
        position="seq",
        keys=["check_name", "url"],
        values={
            "severity": F.col("severity"),
            "message": F.col("message"),
            "detail": F.coalesce(F.col("detail"), F.lit("")),
        },
        tie="row_id",
    )
