"""Session helpers: settings used locally and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "paisaflow") -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own: on a cluster a
    machine-local folder would not outlive the executor that wrote it.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    folder = tempfile.mkdtemp(prefix="paisaflow-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and continue from its files.

    Later steps read only the columns they need and plan with true sizes, and a lost executor
    costs a re-read instead of the whole chain of earlier steps. The shuffle files of the job
    are not needed once the table is there and go at once.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that no later step reads; other frames are left alone."""
    for table in tables:
        path = getattr(table, "_cut_path", None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def side_by_side(
    step: Callable[[DataFrame], DataFrame], *frames: DataFrame
) -> list[DataFrame]:
    """``step`` on independent frames at once: their jobs share the executors, so one job's
    last tasks do not leave the rest of the cluster idle."""
    # threads that keep the caller's job group, pool and tags
    run = inheritable_thread_target(frames[0].sparkSession)(step)
    with ThreadPoolExecutor(max_workers=len(frames)) as pool:
        return list(pool.map(run, frames))
