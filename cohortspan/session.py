"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # one patient may hold a third of all rows: split such join partitions even
    # when that costs one more exchange above the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
SESSION_CONF = {
    **ADAPTIVE_CONF,
    "spark.sql.session.timeZone": "UTC",
    # call-site capture costs milliseconds per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # checkpoint files go when the frame that owns them does
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(app: str = "cohortspan", cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def adapt(spark: SparkSession) -> SparkSession:
    """Turn on skew handling in a session that was made elsewhere."""
    for key, value in ADAPTIVE_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that outlives lost executors.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local session without that setting gets a folder of its own.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """:func:`durable` for a long table that is read several times, a few columns at a time: Parquet files in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own for files that are read again, in the shared folder; it goes when the application ends."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _shared_folder(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="cohortspan-checkpoint-")
        context.setCheckpointDir(folder)
    _delete_at_exit(context)
    return context.getCheckpointDir()


def _delete_at_exit(context: SparkContext) -> None:
    """Let the application's own checkpoint folder go when it ends, whatever the session's settings.

    ``spark.cleaner.referenceTracking.cleanCheckpoints`` frees files earlier, but can only be
    set before a session starts.
    """
    folder = context.getCheckpointDir()
    if getattr(context, "_cohortspan_cleans", None) != folder:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        context._cohortspan_cleans = folder
