"""Session settings, and where a job may cut its lineage."""

from __future__ import annotations

import atexit
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
WAREHOUSE_CONF = "spark.sql.warehouse.dir"
# Pages are large rows: a batch by number alone would hold gigabytes on both sides.
ARROW_BATCH_BYTES = str(16 << 20)

# Folder of the run by application.
_runs: dict[str, str] = {}


def build_session(master: str | None = None, app_name: str = "glossweave", **conf: str) -> SparkSession:
    """A session with the settings the jobs were measured with."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)
        # Records a call site per Column call, which large expressions feel.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def name_scratch(spark: SparkSession) -> None:
    """Name a folder for intermediate tables where the session names none: one in the
    warehouse, which all executors reach as well."""
    if not (spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()):
        spark.conf.set(CHECKPOINT_CONF, spark.conf.get(WAREHOUSE_CONF).rstrip("/") + "/_scratch")


def scratch_dir(spark: SparkSession) -> str:
    """Folder of this run for intermediate tables, below the shared one that the session names.

    It is removed when the process ends, or by :func:`remove_scratch`.
    """
    application = spark.sparkContext.applicationId
    if application not in _runs:
        shared = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
        if not shared:
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        _runs[application] = f"{shared.rstrip('/')}/run-{uuid.uuid4().hex}"
        atexit.register(_remove_at_exit, spark)
    return _runs[application]


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this run has written for itself; its tables cannot be read afterwards."""
    folder = _runs.pop(spark.sparkContext.applicationId, None)
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _remove_at_exit(spark: SparkSession) -> None:
    # The session may have been stopped before.
    with suppress(Exception):
        remove_scratch(spark)


def new_scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the scratch folder and read it back.

    What follows neither repeats the work nor depends on the executors that did
    it, and still prunes columns, which a checkpoint would not.
    """
    spark = df.sparkSession
    path = new_scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
