"""Session creation and lineage cutting for iterative jobs."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job here relies on: AQE re-plans joins from runtime sizes
# (small frontiers become broadcast joins only after their size is measured),
# splits skewed shuffle partitions and coalesces tiny ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Rows in a bucket of a table dealt by a key on disk.
BUCKET_ROWS = 250_000

#: Rows of names that a join may hold in every task.
FEW_ROWS = 100_000

#: Applications whose intermediate tables are dropped at the driver's end.
_CLEANED: set[str] = set()


def get_spark(master: str | None = None, app: str = "procweave",
              shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Return the active session or build one with :data:`DEFAULT_CONF`.

    On a cluster ``master`` stays ``None`` and the launcher decides.
    """
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # local mode runs everything in the driver JVM: give it the heap
        settings.setdefault("spark.driver.memory", os.environ.get("PROCWEAVE_DRIVER_MEMORY", "8g"))
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure reliable checkpoints have a shared directory.

    The cluster names it in ``spark.checkpoint.dir``; that value is used as is.
    Only a local-mode session without any setting (tests) gets a fresh
    directory under the system temp folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote session: only the configured folder can be used
        if configured:
            return configured
        raise RuntimeError("spark.checkpoint.dir is not set")
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative jobs need a shared "
            "checkpoint directory on a cluster")
    path = tempfile.mkdtemp(prefix="procweave-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint: cuts lineage and survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet under the checkpoint directory and read it back.

    Used by iterative jobs to cut lineage each round. Compared with
    ``checkpoint()`` it computes the frame once (a reliable RDD checkpoint
    re-runs the plan unless cached) and keeps it columnar. The folder is the
    shared one the cluster names in ``spark.checkpoint.dir``, so the result
    survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{job_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitioned(df: DataFrame, flag: str, tag: str = "step") -> dict[bool, DataFrame]:
    """Like :func:`materialize`, in one pass, as two frames: the rows whose boolean ``flag`` is true, and the others.

    Each is a folder of its own, so that Spark plans with the size of that part only.
    """
    spark = df.sparkSession
    path = f"{job_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").partitionBy(flag).parquet(path)
    rest = df.drop(flag)
    # a part without rows has no folder
    return {v: (spark.read.schema(rest.schema).parquet(f"{path}/{flag}={str(v).lower()}") if exists(spark, f"{path}/{flag}={str(v).lower()}")
                else rest.limit(0)) for v in (True, False)}


def bucketed(df: DataFrame, key: str, rows: int, tag: str = "step") -> DataFrame:
    """Like :func:`materialize`, dealt by ``key`` on disk, so that a join on it moves the other side only.

    ``rows`` is about the number of rows: it sets the number of buckets, by which a bucket stays as large as the input grows.
    """
    spark = df.sparkSession
    name = f"{tag}-{uuid.uuid4().hex}".replace("-", "_")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", f"{job_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def few(df: DataFrame) -> DataFrame:
    """A written table marked for broadcast if it has at most :data:`FEW_ROWS` rows, else as it is."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def job_dir(spark: SparkSession) -> str:
    """The application's own folder for intermediate tables, dropped when the driver ends."""
    app = spark.sparkContext.applicationId
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/procweave/{app}"
    if app not in _CLEANED:
        _CLEANED.add(app)
        atexit.register(drop_intermediate, spark)
    return path


def drop_intermediate(spark: SparkSession) -> None:
    """Delete every intermediate table of this application (frames that read them must be done)."""
    sc = spark.sparkContext
    if sc._jsc is None:  # the session has been stopped
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(job_dir(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Spread a scan over the cluster's cores when it yields fewer splits than there are.

    A big input that arrives in many splits is returned as
    is; a file of one row group (one task) that feeds CPU-heavy per-row work
    (regexes, scoring, vectors) is dealt round-robin. With ``task_rows`` the rows
    are counted (of Parquet only the footers are read, by tasks) and dealt
    into as many parts as keep a task at that many rows: a task's
    work stays the same as the input grows.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if task_rows:
        target = max(target, -(-df.count() // task_rows))
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
