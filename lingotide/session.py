"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution splits skewed join partitions and coalesces small shuffles;
# everything else is left to the cluster's own configuration.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # streaming state lies on disk, beside the heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "lingotide", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings the operators rely on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared folder (``spark.checkpoint.dir``).

    Only where that setting is absent, as in local tests, a temporary folder is used and recorded
    as the session's checkpoint folder so that later calls share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="lingotide-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _given.append(path)
    return path


# folders handed out in this process and not released yet
_given: list[str] = []


def release_staged(spark: SparkSession) -> int:
    """Delete all intermediate tables of this process; for the end of a job, once its results are written.

    Frames that still read one of them cannot be used afterwards. Returns the number of folders released.
    """
    released = 0
    while _given:
        path = spark._jvm.org.apache.hadoop.fs.Path(_given.pop())
        released += path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    return released


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Used where several later steps read the same expensive result: it is worked out once, lost
    executors do not force a recomputation of everything before it, and plans stay short.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input that is read in fewer tasks than there are cores; larger inputs stay as they are.

    Meant for small compressed tables whose rows are about to grow, such as texts cut into words.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
