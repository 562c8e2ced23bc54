"""Session set-up and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.dataFrameQueryContext.enabled": "false",
    "spark.ui.enabled": "false",
}

#: Folders of staged frames that are in use, by frame.
_FOLDERS: dict[int, str] = {}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, driver_memory: str = "12g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = SparkSession.builder.master(master).appName("duewise").config("spark.driver.memory", driver_memory)
    for key, value in LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the checkpoint must be on
    storage that every executor reaches, so a missing setting is an error there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = os.path.join(tempfile.gettempdir(), f"duewise-checkpoint-{os.getpid()}")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder so that later reads all see the same rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and read it back.

    Used where several branches of a plan read the same derived table: they then share one computation,
    still read only the columns they need, and a lost executor costs a re-read, not a recomputation.
    """
    root = ensure_checkpoint_dir(df.sparkSession)
    folder = f"{root.rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    atexit.register(_delete, df.sparkSession, folder)
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
    _FOLDERS[id(out)] = folder
    weakref.finalize(out, _FOLDERS.pop, id(out), None)
    return out


def drop_staged(staged: DataFrame) -> None:
    """Delete the folder of a frame that ``stage`` returned, when no later step reads it."""
    _delete(staged.sparkSession, _FOLDERS[id(staged)])


def _delete(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
