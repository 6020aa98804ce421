"""Session defaults. A cluster's own settings always win; nothing here is needed for results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE does the sizing: a generous initial partition count that coalesces on small inputs and
# splits skewed join partitions on large ones.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "haulmark",
                  memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the local bench."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", memory)
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


TEXT_ROWS = 1000

_local_dirs: dict[str, str] = {}
_staged: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a fresh temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="haulmark-")
    return _local_dirs[context.applicationId]


def staged_path(df: DataFrame, name: str) -> str:
    """The path of the frame, written to the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read back.

    Used for tables that a plan reads several times, pre-aggregates for the most part: their source is
    scanned once, a lost executor costs no recomputation, and the optimizer sees the real size.
    """
    return df.sparkSession.read.schema(df.schema).parquet(staged_path(df, name))


def staged_texts(df: DataFrame, name: str) -> DataFrame:
    """``staged`` for a plan that hands whole texts to Python, in batches of ``TEXT_ROWS`` rows at most.

    Spark's own batches of 10,000 rows hold tens of megabytes beside the heap in each task.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = conf.get(key)
    if 0 < int(rows) <= TEXT_ROWS:
        return staged(df, name)
    conf.set(key, str(TEXT_ROWS))
    try:
        return staged(df, name)
    finally:
        conf.set(key, rows)


def discard_staged(spark: SparkSession) -> int:
    """Delete every staged table of this application; frames that read them become unusable."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)
