"""Session and shared-storage helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

LOCAL_SCRATCH = "/tmp/panelworks"
_claimed: set[str] = set()


def build_session(app: str = "panelworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; cluster sizing stays with the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.scheduler.mode", "FAIR")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors must share.

    Only a local master may do without: there one machine holds all executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{LOCAL_SCRATCH}/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path in the shared folder."""
    top = f"{shared_folder(spark)}/panelworks/{spark.sparkContext.applicationId}"
    if top not in _claimed:  # the application's own tables go when it ends
        _claimed.add(top)
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a columnar table in the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads the table instead of recomputing
    the job behind it, and later readers still get column pruning and pushdown.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


T = TypeVar("T")


def concurrently(spark: SparkSession, jobs: dict[str, Callable[[], T]], at_once: int = 4) -> dict[str, T]:
    """Results of independent jobs by name, up to ``at_once`` of them at a time.

    Each runs in a scheduler pool of its own, so under fair scheduling many small
    stages of one fill the cores that another one leaves idle. The first failure
    is raised once all have ended.
    """
    def run(name: str, job: Callable[[], T]) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        return job()

    with ThreadPoolExecutor(max(1, min(at_once, len(jobs)))) as pool:
        started = {name: pool.submit(inheritable_thread_target(spark)(run), name, job) for name, job in jobs.items()}
    return {name: future.result() for name, future in started.items()}


def fan_out(df: DataFrame, *columns: str) -> DataFrame:
    """Spread a small table over all cores before it is multiplied.

    A fixed partition count is not merged again at run time, so rows that each
    turn into hundreds are not all multiplied in one task.
    """
    spark = df.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(wanted, *columns)
