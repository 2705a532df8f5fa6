"""Audits of pages as they arrive, and change of pages between fetches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.features import with_features
from auditloom.model import PAGES
from auditloom.plans.audit import page_issues


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 16, name: str = "") -> DataFrame:
    """New parquet files of a folder as a stream of pages; with ``name``, the folder or the file of that name in it."""
    r = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch)
    if name:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
            return r.parquet(f"{folder}/{name}")
        r = r.option("pathGlobFilter", name)
    return r.parquet(folder)


def stream_issues(stream: DataFrame) -> DataFrame:
    """Per-page issues of a stream; no state is kept."""
    return page_issues(with_features(stream))


def deduplicated(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """The same fetch delivered twice is dropped, as long as its time is within the watermark."""
    return stream.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["url", "fetched_at"])


def audit_into(stream: DataFrame, folder: str, checkpoint: str, site_checks: Callable[[DataFrame], DataFrame] | None = None):
    """Write each batch's issues to the folder; site-wide checks, if any, see one batch at a time."""

    def batch(df: DataFrame, n: int) -> None:
        p = df.persist()
        try:
            out = page_issues(with_features(p))
            if site_checks is not None:
                out = out.unionByName(site_checks(p))
            out.withColumn("batch", F.lit(n)).write.mode("append").parquet(folder)
        finally:
            p.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_changes(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """``(url, fetched_at, change)``: whether a fetch is the first of its URL, like the last one or changed.

    State is one hash per URL and is dropped when the URL isn't fetched for longer than ``late``, the watermark's delay.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    keep = int(pd.Timedelta(late).total_seconds() * 1000)

    def each(key, batches, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"url": [], "fetched_at": [], "change": []})
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("fetched_at")
        out = []
        for h in rows["hash"]:
            out.append("first" if last is None else "same" if h == last else "changed")
            last = h
        state.update((last,))
        state.setTimeoutTimestamp(int(rows["fetched_at"].max().timestamp() * 1000) + keep)
        yield pd.DataFrame({"url": rows["url"], "fetched_at": rows["fetched_at"], "change": out})

    hashed = stream.withWatermark("fetched_at", late).select("url", "fetched_at", F.sha2(F.coalesce("body", F.lit("")), 256).alias("hash"))
    return hashed.groupBy("url").applyInPandasWithState(each, "url string, fetched_at timestamp, change string", "hash string", "append", GroupStateTimeout.EventTimeTimeout)


def issue_counts(issues: DataFrame, time: str = "fetched_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Windowed counts by check over a stream that carries a time."""
    return issues.withWatermark(time, late).groupBy(F.window(time, window), "check_name").agg(F.count("*").alias("n"))
