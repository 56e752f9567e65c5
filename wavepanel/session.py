"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC for the naive timestamps of the inputs,
# AQE for runtime re-planning (coalescing, skew-join splits, broadcast
# conversion when a side turns out small).
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "wavepanel", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**SESSION_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(k, v)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); library code
    only reads it and never falls back to a machine-local folder."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        raise RuntimeError("spark.checkpoint.dir is not set: name the cluster's shared folder there")
    return current


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Local sessions only: use ``spark.checkpoint.dir`` when set, otherwise
    create a scratch folder for this local run and set it."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    local = tempfile.mkdtemp(prefix="wavepanel-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


_written: dict[str, SparkSession] = {}


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, for plans that read it several times.

    The lineage is cut in a way that survives lost executors.  The copy goes
    when the driver ends.  Without ``spark.checkpoint.dir`` a local session
    takes a folder of its own; on a cluster that is an error.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.master.split("[")[0] == "local":
        ensure_checkpoint_dir(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/wavepanel-once-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(schema).parquet(path)


@atexit.register
def _delete_written() -> None:
    for path, spark in list(_written.items()):
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already; nothing is lost but disk
            pass
        _written.pop(path, None)
