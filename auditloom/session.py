"""Session helpers: the shared folder for cut lineage, materialised steps, table readers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_WORK: dict[str, list[str]] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and single-node runs."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("auditloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="auditloom-")
        spark.conf.set("spark.checkpoint.dir", named)
        _WORK.setdefault("own", []).append(named)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application; they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        out = Path(tempfile.mkdtemp(prefix="auditloom-code-")) / "auditloom.zip"
        with zipfile.ZipFile(out, "w") as z:
            for f in sorted(root.rglob("*")):
                if f.suffix in (".py", ".json", ".txt"):
                    z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan dealt out to all cores, if it has fewer partitions than there are cores.

    Python work on few small files would leave cores idle. Inputs of any size to speak of have more
    partitions than cores and are not shuffled; frames behind a shuffle are left as they are.
    """
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the workers, on all cores."""
    ship(df.sparkSession)
    return (df if df.isStreaming else spread(df)).mapInArrow(fn, schema)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed at exit."""
    path = f"{shared_folder(spark)}/steps/{uuid.uuid4().hex}"
    _WORK.setdefault("steps", []).append(path)
    return path


def materialise(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    This cuts the lineage like ``checkpoint()`` does and survives the loss of executors, but
    keeps column pruning and takes a fraction of the disk.
    """
    spark = df.sparkSession
    path = scratch(spark)
    w = df.write.mode("error").option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    schema = df.schema
    out = spark.read.schema(schema).parquet(path)
    out._step_path = path
    return out


def bucketed(df: DataFrame, by: str, rows: int) -> DataFrame:
    """``df`` written like ``materialise`` does, in buckets of ``by``: joins and groups on it don't shuffle it again."""
    spark = df.sparkSession
    path, name = scratch(spark), f"auditloom_{uuid.uuid4().hex}"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 5_000_000))
    df.repartition(n, by).write.mode("error").option("compression", "zstd").option("path", path).bucketBy(n, by).sortBy(by).saveAsTable(name)
    out = spark.table(name)
    out._step_path, out._table = path, name
    return out


def release(*dfs: DataFrame | None) -> None:
    """Delete the tables behind superseded materialised steps."""
    for df in dfs:
        path = getattr(df, "_step_path", None)
        if getattr(df, "_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _cleanup() -> None:
    """At exit: by the file system where the folder is one, as the JVM may be gone; else through Spark."""
    for path in _WORK.get("steps", []) + _WORK.get("own", []):
        if path.startswith("file:") or path.startswith("/"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
            continue
        try:
            spark = SparkSession.getActiveSession()
            if spark is not None:
                _delete(spark, path)
        except Exception:
            return


atexit.register(_cleanup)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
